"""Queries of whole tables against brute force on the smallest tables."""

import numpy as np
import pandas as pd

from tallyline.operators import captions, intervals, matching
from tallyline.plans import registry
from tallyline.sources import files

DATA = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def load(name):
    return pd.read_parquet(f"{DATA}/{name}.parquet")


def got(spark, name):
    return QUERIES[name](spark, DATA).toPandas()


def test_shifted_similarity_compares_all_vectors(spark):
    v = load("embeddings")
    x = np.array(v.embedding.tolist(), float).reshape(len(v), 8, 8)
    want = {}
    for i in range(len(v)):
        for j in range(len(v)):
            if v.label[i] == v.label[j] and v.vec_id[i] < v.vec_id[j]:
                best = -1.0
                for s in range(-3, 4):
                    c, e = x[i][:, max(0, s) : 8 + min(0, s)], x[j][:, max(0, -s) : 8 + min(0, -s)]
                    best = max(best, ((c * e).sum(1) / (np.linalg.norm(c, axis=1) * np.linalg.norm(e, axis=1))).mean())
                if best >= 0.3:
                    want[int(v.vec_id[i]), int(v.vec_id[j])] = best
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    have = {(r["a"], r["b"]): r["sim"] for r in matching.shifted_similarity(df, df, "vec_id", "label", "embedding", 8, 3, 0.3).where("a < b").collect()}
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 2e-6 for k in want)
    # the query gives a row for each vector: all its links, counted, and the best
    near = {int(i): {} for i in v.vec_id}
    for (a, b), s in want.items():
        near[a][b] = near[b][a] = s
    rows = list(got(spark, "c5_shifted_similarity").itertuples())
    assert {r.vec_id: r.n_links for r in rows} == {i: len(o) for i, o in near.items()} and len(rows) == len(v)
    best = {i: max(o, key=lambda j: (round(o[j], 12), -j)) for i, o in near.items() if o}
    assert {r.vec_id: int(r.best) for r in rows if r.n_links} == best and all(abs(r.sim - near[r.vec_id][best[r.vec_id]]) < 2e-6 for r in rows if r.n_links)
    assert all(r.class_id == r.vec_id for r in rows)  # no vector comes twice here


def test_coverage_has_every_overlay(spark):
    e = load("events")
    assert set(got(spark, "j24_coverage").id) == set(e.event_id[e.event_type == "view"])


def test_coverage_without_span(spark):
    schema = "e int, id int, start double, end double, x double, y double, w double, h double"
    overlays = spark.createDataFrame([(1, 1, 2.0, 2.0, 0.0, 0.0, 5.0, 5.0), (1, 2, 2.0, 4.0, 0.0, 0.0, 5.0, 5.0)], schema)
    ops = spark.createDataFrame([(1, 3, 0.0, 3.0, 0.0, 0.0, 9.0, 9.0)], schema)
    assert sorted(map(tuple, intervals.rectangle_coverage(overlays, ops, "e").collect())) == [(1, None, None), (2, False, 0.5)]


def test_components_of_all_customers_and_suppliers(spark):
    c, s, gap = load("customer"), load("supplier"), 10**12
    first = {}
    for a, k in [*zip(c.c_custkey, c.c_nationkey), *zip(s.s_suppkey + 2 * gap, s.s_nationkey)]:
        first[k] = min(first.get(k, a), a, k + gap)
    want = {a: first[k] for a, k in [*zip(c.c_custkey, c.c_nationkey), *zip(s.s_suppkey + 2 * gap, s.s_nationkey), *((k + gap, k) for k in first)]}
    have = got(spark, "c2_components")
    assert dict(zip(have.node, have.component)) == want


def test_best_match_among_all_vectors(spark):
    v = load("embeddings")
    x = np.array(v.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    have = {r.vec_id: r for r in got(spark, "j17_best_match").itertuples()}
    for i in np.flatnonzero(v.vec_id % 20 == 0):
        sims = sorted(((-x[i] @ x[j], v.vec_id[j]) for j in np.flatnonzero(v.label == v.label[i]) if j != i))
        assert not sims or abs(have[v.vec_id[i]].sim + sims[0][0]) < 2e-6
    assert len(have) == sum(((v.label == v.label[i]).sum() > 1) for i in np.flatnonzero(v.vec_id % 20 == 0))


def test_hashes_of_all_vectors(spark):
    v = load("embeddings")
    h = {int(i): sum(1 << k for k, c in enumerate(e[:64]) if c > 0) for i, e in zip(v.vec_id, v.embedding)}
    cand = {i + 10**12 * (f + 1): x ^ sum({1 << ((k * 11 + i + f) % 64) for k in range(1 + (i + f * 3) % 15)}) for i, x in h.items() for f in range(4)}
    want = {(c, i, (x ^ y).bit_count()) for c, x in cand.items() for i, y in h.items() if (x ^ y).bit_count() <= 10}
    assert set(got(spark, "j12_hamming").itertuples(index=False, name=None)) == want
    assert set(got(spark, "j12_same_recording").item) == set(h)


def test_tracks_hold_every_event(spark):
    assert got(spark, "w15_chain_merge").n.sum() == len(load("events"))


def test_documents_of_entities_take_few_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(files, "shared", lambda _: str(tmp_path))
    docs, labels = load("documents"), load("labels")
    quality = dict(zip(labels.doc_id, labels.quality))
    have = {r.doc_id: (r.lang, None if pd.isna(r.quality) else r.quality, None if pd.isna(r.n_chars) else r.n_chars) for r in got(spark, "s2_entity_documents").itertuples()}
    assert have == {i: (lang, quality.get(i), n if i % 3 == 0 else None) for i, lang, n in zip(docs.doc_id, docs.lang, docs.n_chars)}
    assert sum(1 for f in tmp_path.rglob("part-*")) < len(docs) / 2


def test_archived_documents_are_read_as_files_are(spark, tmp_path):
    texts = {"7": '{\n "a": 1,\n "other": [2]\n}', "8": '{"b": "x\\ny"}', "9": "not json"}
    for k, text in texts.items():
        (tmp_path / "loose" / f"video={k}").mkdir(parents=True)
        (tmp_path / "loose" / f"video={k}" / "d.json").write_text(text)
    files.write_documents(spark.createDataFrame([(f"loose/video={k}/d.json", t) for k, t in texts.items()], "path string, document string"), str(tmp_path / "packed"))
    read = lambda where, archived: files.read_documents(spark, {"k": str(tmp_path / where)}, {"k": "a long, b string"}, "video=([0-9]+)", archived)["k"].select("entity", "a", "b").orderBy("entity").collect()
    assert [tuple(r) for r in read("packed", True)] == [tuple(r) for r in read("loose", False)] == [("7", 1, None), ("8", None, "x\ny"), ("9", None, None)]


def test_features_of_entities_make_events_once(spark):
    """Five sources come of one table, so the join that makes the events is not in the plan of the features."""
    assert "user_id" not in QUERIES["a20_entity_features"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_items_of_roles_meet_their_entities_once(spark, monkeypatch):
    """Titles and median heights are found where an entity's items lie: the one join of items is that with the frames."""
    written, plain = {}, captions.table
    monkeypatch.setattr(captions, "table", lambda df, tag: (written.setdefault(tag, df._jdf.queryExecution().optimizedPlan().toString()), plain(df, tag))[1])
    assert got(spark, "p30_roles").role.notna().all()
    assert written["roles"].count("Join ") == 1 and "user_id" not in written["roles"]
