"""Best matches in blocks, the state of a stream in buckets, and listed terms by shared pairs: each equal to its plain form."""

import difflib
import json
import random
import shutil
import time

import numpy as np

from tallyline.operators import similarity
from tallyline.streaming.upserts import latest_by_key, stream_upserts


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- best matches


def test_top_matches_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    x[40] = x[10]  # equal ones go to the smaller number
    x[70] = 0
    group = lambda i: i % 2 if i != 33 else None
    vectors = lambda name: [(i, group(i), None if i == 20 else [None, *map(float, x[i][1:])] if i == 21 else [float("nan")] * 6 if i == 22 else list(map(float, x[i]))) for i in range(90)]
    items, library = table(spark, vectors("x"), "item long, g int, x array<double>"), table(spark, vectors("y"), "lib long, g int, y array<double>")
    got = {}
    for r in similarity.top_matches(items, library, "item", "lib", "g", 3, block=8).collect():
        got.setdefault(r["item"], {})[r["p"]] = (r["lib"], r["sim"])
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    good = [i for i in range(90) if i not in (20, 21, 22, 33, 70)]
    assert sorted(got) == good
    for i in good:
        want = sorted((-round(float(u[i] @ u[j]), 12), j) for j in good if j != i and group(i) == group(j))[:3]
        assert [got[i][p][0] for p in (1, 2, 3)] == [j for _, j in want]
        assert all(abs(got[i][p][1] + s) < 1e-9 for p, (s, _) in enumerate(want, 1))


def test_best_match_without_a_match(spark):
    items = table(spark, [(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "a", [0.0, 0.0])], "item long, g string, x array<double>")
    library = table(spark, [(1, "a", [1.0, 0.0]), (5, "a", [-1.0, 0.0])], "lib long, g string, y array<double>")
    assert [tuple(r) for r in similarity.best_match(items, library, "item", "lib", "g", 0.5).collect()] == [(1, None, -1.0, None)]


# ---------------------------------------------------------------- stream


SCHEMA = "k long, at long, v string, w string"


def parts(state):
    return sorted(p.relative_to(state).as_posix() for p in state.glob("buckets=*/batch=*/_kind=*/_bucket=*"))


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def test_a_batch_writes_the_buckets_of_its_keys(spark, tmp_path):
    source, state = tmp_path / "in", tmp_path / "state"
    run = lambda: {r["k"]: (r["at"], r["v"], r["w"]) for r in stream_upserts(spark, str(source), SCHEMA, "k", "at", state=str(state), buckets=8, deltas=3).collect()}
    put(source, "0.json", [{"k": k, "at": 0, "v": f"v{k}"} for k in range(60)])
    assert len(run()) == 60
    first = parts(state)
    assert len(first) == 8
    put(source, "1.json", [{"k": 7, "at": 1, "w": "new"}])
    assert run()[7] == (1, "v7", "new")
    assert len(set(parts(state)) - set(first)) == 1
    for n in range(2, 9):
        put(source, f"{n}.json", [{"k": 7, "at": n, "v": f"n{n}"}])
        got = run()
        assert got[7] == (n, f"n{n}", "new") and len(got) == 60 and got[8] == (0, "v8", None)
        # no bucket has more than its parts, one fold, and what that replaced
        assert max(sum(p.endswith(f"_bucket={b}") for p in parts(state)) for b in range(8)) <= 2 * 3 + 1
    assert sum("_kind=whole" in p for p in parts(state)) >= 1
    assert {p for p in first if p in parts(state)} != set(first)  # dead parts have gone


def test_a_batch_that_runs_again_is_counted_once(spark, tmp_path):
    source, state = tmp_path / "in", tmp_path / "state"
    run = lambda: sorted(map(tuple, stream_upserts(spark, str(source), SCHEMA, "k", "at", state=str(state), buckets=4, deltas=2).collect()))
    rows = []
    for n in range(5):
        new = [{"k": k, "at": n, "v": f"{n}-{k}" if k % 2 else None} for k in range(n, n + 5)]
        rows += [(r["k"], r["at"], r["v"], None) for r in new]
        put(source, f"{n}.json", new)
        before = run()
        # the batch stands whole, but the stream stopped before it could say so
        for log in (f"{n}", f".{n}.crc"):
            (state / "progress" / "commits" / log).unlink(missing_ok=True)
        assert run() == before == sorted(map(tuple, latest_by_key(table(spark, rows, SCHEMA), "k", "at").collect()))
    # a batch that stopped while it was written leaves a folder without its mark
    put(source, "9.json", [{"k": 1, "at": 99, "v": "last"}])
    broken = state / "buckets=4" / "batch=5" / "_kind=delta" / "_bucket=0"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_text("not whole")
    assert (1, 99, "last", None) in run()
    shutil.rmtree(tmp_path)


def test_the_number_of_buckets_stays(spark, tmp_path):
    source, state = tmp_path / "in", tmp_path / "state"
    put(source, "0.json", [{"k": k, "at": 0, "v": "a"} for k in range(20)])
    stream_upserts(spark, str(source), SCHEMA, "k", "at", state=str(state), buckets=4)
    put(source, "1.json", [{"k": 3, "at": 1, "v": "b"}])
    got = stream_upserts(spark, str(source), SCHEMA, "k", "at", state=str(state), buckets=16)
    assert got.count() == 20 and {p.split("/")[0] for p in parts(state)} == {"buckets=4"}


# ---------------------------------------------------------------- listed terms


def plain_term(text, known, ratio):
    for k in known:
        if len(k) >= 3 and k in text:
            return k
    for k in known:
        if len(k) >= 4 and len(text) >= len(k) - 1:
            for n in (len(k) - 1, len(k), len(k) + 1):
                for i in range(max(1, len(text) - n + 1)):
                    if difflib.SequenceMatcher(None, k, text[i : i + n]).ratio() >= ratio:
                        return k
    return None


def test_listed_terms_equal_the_plain_rule(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
    for ratio in (0.8, 0.7, 0.6):
        for letters, long in (("ab", 9), ("abcdefgh", 14), ("가나다라abc1", 12)):
            known = [word(letters, 1, long) for _ in range(25)]
            texts = [word(letters, 1, 40) for _ in range(60)] + ["", "a", known[0][:-1]]
            for k in known:  # terms with a letter gone, changed or added
                i = rng.randrange(len(k))
                texts += [f"{word('xyz', 0, 6)}{k[:i]}{c}{k[j:]}{word('xyz', 0, 6)}" for c, j in (("", i + 1), ("z", i + 1), ("z", i))]
            first = similarity._term_index(known, ratio)
            monkeypatch.setattr(similarity, "STRETCH", 16)
            for text in texts:
                at = first(text)
                assert (None if at is None else known[at]) == plain_term(text, known, ratio), (ratio, text)


def test_ten_thousand_listed_terms(spark):
    rng = random.Random(8)
    terms = list(dict.fromkeys("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(8, 16))) for _ in range(10_000)))
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)) for _ in range(200)]
    for n in range(0, 200, 2):
        t = terms[n * 40]
        texts[n] = texts[n][:50] + t[:4] + t[5:] + texts[n][50:]
    began = time.time()
    got = {r["id"]: r["term"] for r in similarity.listed_term(table(spark, list(enumerate(texts)), "id int, t string"), "id", "t", terms).collect()}
    assert all(got[n] is not None for n in range(0, 200, 2)) and len(got) == 200
    bare = lambda t: t.replace(" ", "")
    for n in (0, 50):  # the plain rule takes seconds a text
        assert got[n] == plain_term(bare(texts[n]), terms[: n * 40 + 1], 0.8)
    assert time.time() - began < 120


def test_listed_terms_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "THE-LISTD shop"), (5, "the listed shop"), (6, "shop " * 3000 + "the listed shap")]
    got = {r["id"]: r["term"] for r in similarity.listed_term(table(spark, rows, "id int, t string"), "id", "t", ["The Listed Shop", "!!", "ab"]).collect()}
    assert got == {1: None, 2: None, 3: None, 4: "The Listed Shop", 5: "The Listed Shop", 6: "The Listed Shop"}
    assert {r["term"] for r in similarity.listed_term(table(spark, rows, "id int, t string"), "id", "t", []).collect()} == {None}
