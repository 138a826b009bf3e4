"""Every operator on nulls, empty and very long texts, repeated rows, clashing extra columns, and on an empty table."""

import pytest
from pyspark.sql import functions as F

from tallyline.llm import bpe, embedding_dedup, importance, jaccard_join, license_scan, line_dedup, packing, pii, quality_crf, quality_rules, secret_scan, toxicity

SCHEMA = "doc_id long, text string, source string, score double, n long, key string, label int, host string, comp long"
LONG = "word " * 60_000 + "1.2.3.4 end"
ROWS = [
    (1, "An idiot wrote this, all of it, for nothing at all. All rights reserved.", "s", 0.1, 1, "k", 1, "h", 1),
    (2, None, "s", None, None, None, None, None, None),
    (3, "", None, 0.1, 1, "k", 1, "h", 1),
    (4, " \t\n\v\f\r ", "s", 0.1, 1, "k", 1, "h", 1),
    (5, LONG, "s", 0.1, 1, "k", 1, "h", 1),
    (6, "é\x00ß 漢字 🎉 <|endoftext|> mail me@x.org", None, 0.1, 1, "k", 1, "h", 1),
    (7, "same text here\nline two", "s", 0.1, 1, "k", 1, "h", 1),
    (7, "same text here\nline two", "s", 0.1, 1, "k", 1, "h", 1),
    (8, "x" * 200_000, "s", 0.1, 1, "k", 1, "h", 1),
    (None, "no id", "s", 0.1, 1, "k", 1, "h", 1),
]
LABELS = [(1, 1, 1), (5, 1, 0), (7, 0, 0), (8, 1, None), (None, 1, 1), (99, 1, 1)]


def marks(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda s, d, m: toxicity.score_toxicity(d, m),
    "op2": lambda s, d, m: quality_rules.quality_rules(d),
    "op3": lambda s, d, m: bpe.encode_documents(d),
    "op4": lambda s, d, m: quality_crf.score_quality(d, m),
    "op6": lambda s, d, m: jaccard_join.jaccard_join(d),
    "op7": lambda s, d, m: pii.find_pii(d),
    "op9": lambda s, d, m: line_dedup.dedup_lines(d),
    "op10": lambda s, d, m: license_scan.scan_licenses(d),
    "op11": lambda s, d, m: importance.resample(d.drop("score"), d),
    "op13": lambda s, d, m: secret_scan.find_secrets(d),
}


@pytest.fixture(autouse=True)
def quick(monkeypatch):
    """The network is trained less here; its accuracy has tests of its own."""
    monkeypatch.setattr(pii.fit, "__defaults__", (50, 60, 1))


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    out = OPERATORS[name](spark, spark.createDataFrame(ROWS, SCHEMA), marks(spark, LABELS))
    rows = out.collect()
    assert len(rows) == len(ROWS) and len(set(out.columns)) == len(out.columns)
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    twice = [r for r in rows if r["doc_id"] == 7]
    assert twice[0] == twice[1]


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA), marks(spark, [])).collect() == []


def test_scores_without_labels_and_with_one_class(spark):
    docs = spark.createDataFrame(ROWS[:5], SCHEMA)
    for m in ([], [(1, 1, 1), (5, 1, 1)], [(1, 0, 0), (5, 0, 0)]):
        for score in (OPERATORS["op1"], OPERATORS["op4"]):
            assert all(0 <= r["score"] <= 1 for r in score(spark, docs, marks(spark, m)).collect())


def test_packing_odd_rows(spark):
    rows = packing.pack_documents(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}
    assert [(r["length"], r["piece"]) for r in rows if r["doc_id"] == 2] == [(1, 0)]
    assert len([r for r in rows if r["doc_id"] == 7]) == 2
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, None], 1), (11, [-1.0, 0.0], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [1.0, 0.0, 0.0], 1), (14, [0.0, 1.0], 1), (15, [-0.0, 3.0], 1)]
    df = spark.createDataFrame([(*r, 0.5, 9) for r in rows], "vec_id long, embedding array<double>, label int, v double, n long")
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[12] == (3, 1, False)
    assert by[14] == (1, 14, True) and by[15] == (1, 14, False)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 13))
    assert embedding_dedup.near_duplicates(df.where(F.lit(False))).collect() == []
    # rows of one id, or of none, are vectors of their own
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.001]), (9, [-1.0, 0.002])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in got)) == [(0, 2, 9), (0, 2, 9), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (9, 2, 9)]
    # just at the threshold, and just below
    exact = [(1, [1.0, 0.0, 0.0]), (2, [93.0, 36.0, 7.0]), (3, [-1.0, 0.0, 0.0]), (4, [-92.0, 39.0, 3.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(*r, 1) for r in exact], "vec_id long, embedding array<double>, label int")).collect()
    cos = 93.0 / (93.0**2 + 36.0**2 + 7.0**2) ** 0.5
    assert {r["vec_id"]: r["n_links"] for r in got} == {1: int(cos >= 0.93), 2: int(cos >= 0.93), 3: 0, 4: 0}


def test_repeated_ids_are_one_document_in_counts(spark):
    """Six rows of one id are one page of a host and lose nothing; a seventh id makes no line common."""
    line = "the same line on every page of the host"
    rows = [(1, f"{line}\nown words number {k}", "h") for k in range(6)] + [(2, line, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert all(r["n_dropped"] == 0 for r in line_dedup.dedup_lines(df).collect())
    more = df.unionByName(spark.createDataFrame([(k, line, "h") for k in range(3, 7)], df.schema))
    assert sorted((r["doc_id"], r["n_dropped"]) for r in line_dedup.dedup_lines(more).collect()) == [(1, 1)] * 6 + [(k, 1) for k in range(2, 7)]
    body = " ".join(f"word{k}" for k in range(60))
    many = spark.createDataFrame([(k // 2, f"{body}\nown {chr(97 + k)}", "h") for k in range(24)] + [(None, body, "h")], df.schema)
    got = quality_rules.quality_rules(many).collect()
    assert {r["n_left"] for r in got if r["doc_id"] is not None} == {2} and not any(r["kept"] for r in got)
    few = spark.createDataFrame([(k // 3, f"{body}\nown {chr(97 + k)}", "h") for k in range(24)], df.schema)
    assert {r["n_left"] for r in quality_rules.quality_rules(few).collect()} == {62}
