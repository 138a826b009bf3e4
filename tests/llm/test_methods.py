"""The methods against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tallyline.llm import bpe, common, components, embedding_dedup, jaccard_join, license_scan, line_dedup, packing, pii, quality_crf, toxicity
from tallyline.llm import queries as registered
from tallyline.llm.automaton import SuffixAutomaton

SMALL, DATA = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def texts(n=None):
    return pq.read_table(f"{SMALL}/documents.parquet").column("text").to_pylist()[:n]


# ---------------------------------------------------------------- toxicity


def as_arrays(v):
    ts = np.array(sorted(v), np.int64)
    return ts, np.array([v[t] for t in ts.tolist()], float)


@pytest.mark.parametrize("often", [0.0, 0.1, 1.0])
def test_block_max_index_is_exact(often):
    rng = random.Random(1)
    vectors = []
    for _ in range(700):
        v = {t: rng.random() for t in rng.sample(range(40), rng.randint(0, 6))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / norm for t, x in v.items()} if norm else {})
    index = toxicity.BlockMaxIndex(list(map(as_arrays, vectors)), 40, block=32, often=often)
    for n, q in enumerate(vectors[:60]):
        want = sorted(((sum(q[t] * v.get(t, 0) for t in q), -i) for i, v in enumerate(vectors)), reverse=True)
        got = index.nearest(as_arrays(q), 10)
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in want[:10] if s > 0]
        got = index.nearest(as_arrays(q), 10, but=n)
        assert n not in [i for _, i in got] and [round(s, 9) for s, _ in got] == [round(s, 9) for s, i in want if i != -n][: len(got)]


def test_toxicity_equals_brute_force(spark):
    """Weights, all cosines, votes, calibration and evidence, from the examples' texts by plain loops."""
    docs, marks = common.documents(spark, SMALL), common.labels(spark, SMALL)
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    label = {r["doc_id"]: r["toxic"] for r in marks.collect() if r["toxic"] in (0, 1)}
    known = {i: y for i, y in label.items() if zlib.crc32(str(i).encode()) % 5}
    examples = {i: collections.Counter(re.findall(r"[^\W\d_]+", text[i].lower())) for i in sorted(known) if 0 < len(text.get(i, "")) <= 50_000}
    n, n1 = len(examples), sum(known[i] for i in examples)
    prior = (sum(known.values()) + 1) / (len(known) + 2)
    a, b = (collections.Counter(t for i, c in examples.items() if known[i] == y for t in c) for y in (1, 0))

    def weight(t):
        chi = n * (a[t] * (n - n1 - b[t]) - b[t] * (n1 - a[t])) ** 2 / max(1, (a[t] + b[t]) * (n - a[t] - b[t]) * n1 * (n - n1))
        return (math.log((1 + n) / (1 + a[t] + b[t])) + 1) * max(0.05, math.sqrt(chi))

    def vector(c):
        v = {t: (1 + math.log(m)) * weight(t) for t, m in c.items() if a[t] + b[t]}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(c) for i, c in examples.items()}
    mass = {1: prior / n1, 0: (1 - prior) / (n - n1)}

    def near(v, but=None):
        found = sorted((-sum(x * u.get(t, 0) for t, x in v.items()), i) for i, u in vectors.items() if i != but)
        return [(-s, i) for s, i in found if s < 0][:15]

    def logit(found):
        base = (mass[0] + mass[1]) / 4
        votes = [(mass[known[i]] / (math.sqrt(max(0, 2 - 2 * s)) + 0.05), known[i]) for s, i in found]
        p = (base * prior + sum(w for w, y in votes if y)) / (base + sum(w for w, _ in votes))
        return math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))

    x, y = [logit(near(v, i)) for i, v in vectors.items()], [known[i] for i in vectors]
    w = [mass[k] * n / sum(mass[j] for j in y) for k in y]
    loss = lambda s, c: sum(m * (math.log1p(math.exp(-(s * u + c))) if k else math.log1p(math.exp(s * u + c))) for u, k, m in zip(x, y, w, strict=True)) + 0.05 * ((s - 1) ** 2 + c * c)
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, marks).collect()}
    pairs = []
    for i, t in text.items():
        found = near(vector(collections.Counter(re.findall(r"[^\W\d_]+", t.lower()))))
        assert np.allclose(rows[i]["similarity"], [s for s, _ in found[:3]])
        if all(abs(p[0] - q[0]) > 1e-9 for p, q in zip(found, found[1:4])):
            assert rows[i]["evidence"] == [k for _, k in found[:3]]
        pairs.append((logit(found), math.log(rows[i]["score"] / (1 - rows[i]["score"]))))
        assert rows[i]["predicted"] == (rows[i]["score"] >= 0.5) and rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    # one line through all (vote, score), at the least loss
    (u0, z0), (u1, z1) = min(pairs), max(pairs)
    slope = (z1 - z0) / (u1 - u0)
    shift = z0 - slope * u0
    off = [(u, z, slope * u + shift) for u, z in pairs if abs(slope * u + shift - z) >= 1e-3]  # the distance of equal texts is rounding alone
    assert not off
    assert all(loss(slope, shift) <= loss(slope + d, shift + e) + 1e-9 for d in (-1e-3, 0, 1e-3) for e in (-1e-3, 0, 1e-3))


def accuracy(df, column):
    marks = {r["doc_id"]: r[column] for r in df.sparkSession.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = [(r["predicted"], marks[r["doc_id"]]) for r in df.where("held_out").collect() if r["doc_id"] in marks]
    return sum(p == y for p, y in rows) / len(rows)


def test_toxicity_held_out(spark):
    assert accuracy(registered.queries()["op1_toxicity"](spark, DATA), "toxic") >= 0.9


def test_quality_held_out(spark):
    assert accuracy(registered.queries()["op4_quality"](spark, DATA), "quality") >= 0.95


# ---------------------------------------------------------------- quality: CRF


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 4])
    emit, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    p, z, moves = quality_crf.Chains(counts).run(emit, trans)
    at, total, want, pairs = 0, 0.0, [], np.zeros((2, 2))
    for n in counts:
        weights = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            weights[path] = math.exp(sum(emit[at + i] for i, s in enumerate(path) if s) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        s = sum(weights.values())
        total += math.log(s)
        want += [sum(w for q, w in weights.items() if q[i]) / s for i in range(n)]
        for q, w in weights.items():
            for a, b in zip(q, q[1:]):
                pairs[a, b] += w / s
        at += n
    assert np.allclose(p, want) and np.isclose(z, total) and np.allclose(moves, pairs)


def test_quality_scores_equal_plain_loops(spark):
    """Each document's score from the fitted weights: forward and backward line by line, the mean by length, the calibration."""
    docs, marks = common.documents(spark, SMALL), common.labels(spark, SMALL)
    rows = common.take(docs, "doc_id", "text")
    model = quality_crf.fit(rows, marks)
    got = {r["doc_id"]: r["score"] for r in quality_crf.score_quality(docs, marks).collect()}
    n = quality_crf.N
    for r in rows.collect()[:60]:
        x, lengths = quality_crf.line_features(r["text"])
        z = (x - model.mean) / model.scale
        pad = np.zeros(n)
        emit = [float(np.concatenate([z[i], z[i - 1] if i else pad, z[i + 1] if i + 1 < len(z) else pad, [1.0]]) @ model.weights) for i in range(len(z))]
        w = np.exp(model.trans)
        forward, backward = [], [np.ones(2)]
        for i, e in enumerate(emit):
            f = np.array([1.0, math.exp(e)]) * (forward[-1] @ w if i else 1.0)
            forward.append(f / f.sum())
        for e in reversed(emit[1:]):
            b = w @ (np.array([1.0, math.exp(e)]) * backward[-1])
            backward.append(b / b.sum())
        good = [(f * b)[1] / (f * b).sum() for f, b in zip(forward, reversed(backward), strict=True)]
        q = float(np.dot(good, lengths) / lengths.sum()) if lengths.sum() else 0.0
        q = min(max(q, 1e-4), 1 - 1e-4)
        want = 1 / (1 + math.exp(-(model.slope * math.log(q / (1 - q)) + model.shift)))
        assert abs(got[r["doc_id"]] - want) < 1e-5


# ---------------------------------------------------------------- BPE


def test_bpe_equals_the_library_and_decodes(spark):
    t = tokenizers.Tokenizer.from_file(bpe.TOKENIZER)
    spec = open(bpe.TOKENIZER, encoding="utf-8").read()
    rng = random.Random(1)
    cases = ["", "Hello wörld's <|endoftext|> 12 ΑΣ !!", "aaaaaaaaaaaaaaaaaaa", "日本 한국 🎉é", "\x00\x1c a\x85b c", "İ ΟΔΟΣ ß ﬀ ½²", "<|startoftext|><|endoftext|>"]
    cases += ["".join(rng.choice("abcdeéèthingon  .,!#'$%&*") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    cases += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(700)] + texts(60)
    for x in cases:
        e = t.encode(x, add_special_tokens=False)
        n, ids, names = bpe.encode_text(x, spec)
        assert (n, ids, names) == (len(e.ids), " ".join(map(str, e.ids)), t.decode(e.ids, skip_special_tokens=False)), x
    docs = spark.createDataFrame(list(enumerate(cases[:40])), "doc_id long, text string")
    whole = bpe.encode_documents(docs, whole=True)
    decoded = {r["doc_id"]: r["decoded"] for r in bpe.decode_ids(whole.select("doc_id", "ids")).collect()}
    for r in whole.collect():
        assert decoded[r["doc_id"]] == r["decoded"]
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


# ---------------------------------------------------------------- packing


def test_pieces_equal_the_library(spark):
    t = tokenizers.Tokenizer.from_file(packing.TOKENIZER)
    cases = ["", None, "a<|endoftext|> b", "  two  spaces\n\n\tand 12 ½ 漢字's", *texts(40), " ".join(texts(40))]
    rows = packing.pieces(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for i, text in enumerate(cases):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert r["piece"] == k and r["start"] == at and (k == 0 or r["length"] == 2048)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def fewest(sizes, capacity):
    """The least number of bins, by depth-first search."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def grow(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for room in {r for r in bins if r >= sizes[i]}:
            grow(i + 1, sorted([*bins[: bins.index(room)], room - sizes[i], *bins[bins.index(room) + 1 :]]))
        grow(i + 1, sorted([*bins, capacity - sizes[i]]))

    grow(0, [])
    return best[0]


def whole_packing(bins, sizes, capacity):
    return sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(0 < sum(sizes[i] for i in b) <= capacity for b in bins)


def test_genetic_algorithm_keeps_every_item_and_improves():
    rng = random.Random(3)
    sizes = [rng.randint(300, 900) for _ in range(200)]
    one, two = packing.start(sizes, 2048, rng, False), packing.start(sizes, 2048, rng, True)
    evolved, made = packing.evolve(sizes, 2048, 1, [one])
    for child in (packing.crossover(sizes, one, two, 2048, rng), evolved):
        assert whole_packing(child, sizes, 2048)
    assert made >= packing.CHILDREN and packing.fitness(sizes, evolved, 2048) >= packing.fitness(sizes, one, 2048)
    assert packing.evolve([], 2048, 1, []) == ([], 0) and packing.evolve([5], 2048, 1, [])[0] == [[0]]


def test_genetic_algorithm_finds_the_fewest_bins():
    """Small cases against all packings; larger ones, cut from full bins, where best fit in falling size needs more."""
    rng = random.Random(7)
    for _ in range(25):
        sizes = [rng.randint(10, 60) for _ in range(11)]
        islands = [packing.evolve(sizes, 100, seed, [])[0] for seed in range(packing.ISLANDS)]
        assert all(whole_packing(bins, sizes, 100) for bins in islands) and min(map(len, islands)) == fewest(sizes, 100)
    fit = evolved = 0
    for seed in range(6):
        sizes = []
        for _ in range(40):  # three pieces to a full sequence
            a = rng.randint(380, 900)
            b = rng.randint(380, 2048 - a - 380)
            sizes += [a, b, 2048 - a - b]
        rng.shuffle(sizes)
        fit += len(packing.start(sizes, 2048, rng, False))
        bins, made = packing.evolve(sizes, 2048, seed, [])
        assert whole_packing(bins, sizes, 2048) and made > packing.CHILDREN
        evolved += len(bins)
    assert evolved < fit


def test_islands_cross_in_every_block(spark):
    rows = [(b, [(rng, 0, 0, 0, 0, 0) for rng in random.Random(b).choices(range(300, 900), k=60)]) for b in range(3)]
    blocks = spark.createDataFrame(rows, f"block long, items array<struct<{packing.ITEM}>>")
    for r in packing.islands(blocks, 3, 2048).collect():
        assert r["crossovers"] >= packing.ISLANDS * packing.EPOCHS * packing.CHILDREN and len(r["assign"]) == 60


@pytest.mark.parametrize("block", [4096, 64])
def test_packing_is_near_the_bound(spark, block):
    """Also with many blocks, whose poorly filled sequences are packed again."""
    parts = common.table(packing.pieces(common.documents(spark, DATA)), "test")
    rows = packing.pack(parts, block=block).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(tuple(r) for r in parts.collect())
    used = collections.defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in used.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 2048
    bound = math.ceil(sum(r["length"] for r in rows) / 2048)
    assert len(used) <= (bound + 1 if block == 4096 else 1.01 * bound + 2)


# ---------------------------------------------------------------- Jaccard join


def word_sets(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def brute_components(cases):
    sets = [word_sets(t) for t in cases]
    parent = list(range(len(cases)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(cases)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_jaccard_join_equals_brute_force(spark):
    """Chains of edits around the threshold, a large group of near copies, a passage that many share, copies, short texts."""
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstu") + rng.choice("vwxyz")
    passage = [word() for _ in range(30)]
    cases = []
    for _ in range(6):
        text = [word() for _ in range(rng.randint(40, 120))] + passage
        for _ in range(15):
            cases.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = word()
    center = [word() for _ in range(150)]
    for _ in range(120):
        near = list(center)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = word()
        cases.append(" ".join(near))
    cases += ["", "   ", "One two", "one TWO", "one two three", "a b c d e", "A B C D E"] + [" ".join(passage)] * 5
    rng.shuffle(cases)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert got == brute_components(cases)


def test_the_last_round_of_pairs(spark, monkeypatch):
    """With no rounds of leaders but one, the pairs that are left decide; frequent shingles have split lists."""
    monkeypatch.setattr(jaccard_join, "LEADERS", (1,))
    monkeypatch.setattr(jaccard_join, "HOT", 5)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    cases = []
    for k in range(40):
        t = list(base)
        for _ in range(k % 4):
            t[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        cases.append(" ".join(t))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_join(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert got == brute_components(cases)


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(1000 + i, 5) for i in range(50)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)]
    rng.shuffle(links)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {1000 + i: 5 for i in range(50)} | {5: 5} | {300 + i: 300 for i in range(9)}


# ---------------------------------------------------------------- PII


@pytest.fixture(scope="module")
def net():
    n = pii.Network()
    n.train(*pii.training_windows(texts(100)))
    return n


def literal_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for kind, rx in (("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        out += [(kind, *m.span()) for m in re.finditer(rx, t) if pii.holds(kind, m.group())]
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(1)
    cases = ["a@b.c@d.e.f x@y", "@a.b", "x@@y.z", "1.2.3.4.5.6.7.8.9", "999.1.1.1 1.2.3.4", *texts()]
    cases += ["".join(rng.choice("a@.1 -+()9") for _ in range(30)) for _ in range(6000)]
    for t in cases:
        assert pii.base_spans(t) == literal_spans(t)


def test_gradient():
    n = pii.Network(hidden=3)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 130, (5, 2)), np.array([[0, 1], [0, 2], [1, 0], [2, 7], [0, 8]])
    _, g = n.gradient(x, y)
    for k in n.p:
        at = tuple(rng.integers(0, s) for s in n.p[k].shape)
        if k[0] == "x":
            at = (x[2, 1], at[1])
        old = n.p[k][at]
        n.p[k][at] = old + 1e-3
        up, _ = n.gradient(x, y)
        n.p[k][at] = old - 1e-3
        down, _ = n.gradient(x, y)
        n.p[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-2 * max(1, abs(g[k][at]))


def test_network_finds_other_spellings(net):
    found = missed = wrong = 0
    for text, spans in pii.made_examples(600, seed=99):
        got = pii.find_spans([text], net)[0][1]
        want = [s for s in spans if pii.holds(s[0], text[s[1] : s[2]])]
        found += sum(s in got for s in want)
        missed += sum(s not in got for s in want)
        wrong += sum(not any(s[1] < b and s[2] > a for _, a, b in spans) for s in got)
    assert found >= 0.9 * (found + missed) and wrong <= 0.02 * found


def test_clean_texts_stay_and_secrets_are_added(net):
    """On all texts of the tables: what is added are tokens and numbers that stand there, nothing in texts without any."""
    added = clean = 0
    some = [x for x in pq.read_table(f"{DATA}/documents.parquet").column("text").to_pylist() if x]
    for text, (base, spans) in zip(some, pii.find_spans(some, net), strict=True):
        assert set(base) <= set(spans)
        added += len(spans) - len(base)
        if not re.search("[0-9@]", text):
            clean += 1
            assert not spans
    assert added and clean > 100


def test_spelled_addresses_are_whole(net):
    cases = ["jane.doe (@) chemistry.university.edu", "jane.doe (@) departmentofchemistry.university.edu", "jane.doe (at) host dot org", "jane dot doe at example dot com", "bob (at) mail.org", "jane.doe [at] chemistry [dot] university [dot] edu"]
    found = 0
    for c in cases:
        text = f"please write to {c}, thanks"
        found += pii.find_spans([text], net)[0][1] == [("email", text.index(c), text.index(c) + len(c))]
    assert found >= len(cases) - 1


def every_path(net, e):
    """The best score of all tag paths and the path's spans, by plain Viterbi over the whole text."""
    trans = (net.p["t"] + net.barred).astype(float)
    best, back = e[0].astype(float) + net.first, []
    for row in e[1:]:
        all_ = best[:, None] + trans
        back.append(all_.argmax(0))
        best = all_.max(0) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    out = []
    for t, tag in enumerate(path):
        if pii.TAGS[tag][0] == "B":
            out.append([pii.TAGS[tag][2:], t, t + 1])
        elif pii.TAGS[tag][0] == "I":
            out[-1][2] = t + 1
    return float(best.max()), [tuple(s) for s in out]


def test_decoding_equals_enumeration_and_viterbi():
    """Short texts against all paths, longer ones against Viterbi over every character; texts stand one after another."""
    rng = np.random.default_rng(4)
    n = pii.Network()
    k = len(pii.TAGS)
    n.p["t"] = rng.normal(0, 1, (k, k)).astype(np.float32)
    trans = n.p["t"] + n.barred
    for _ in range(5):
        e = rng.normal(0, 1, (4, k)).astype(np.float32)
        want = max(sum(e[t, p] for t, p in enumerate(path)) + n.first[path[0]] + sum(trans[a, b] for a, b in zip(path, path[1:])) for path in itertools.product(range(k), repeat=4))
        assert abs(want - every_path(n, e)[0]) < 1e-4
    found = 0
    for shift in (0.0, -1.0, -2.0, -4.0):
        es = [rng.normal(0, 1, (int(m), k)).astype(np.float32) for m in rng.integers(1, 120, 30)]
        for e in es:
            e[:, 1:] += shift
        got = n.decode(np.concatenate(es), [len(e) for e in es], 0.0)
        for e, spans in zip(es, got, strict=True):
            assert [s[:3] for s in spans] == every_path(n, e)[1]
            found += len(spans)
    assert found > 100


def test_windows_are_reconciled(net):
    """Emissions of overlapping windows come near those of one window over all, and spans across windows' edges are whole."""
    text = "ask " + " ".join(f"und erer (017) 555-77{k:02d} ouen the {k}.{k}.{k}.{k} tion" for k in range(10, 40))
    one = net.scores([pii.codes(text)], window=len(text) + 1, overlap=0)
    many = net.scores([pii.codes(text)], window=200, overlap=60)
    assert np.mean(np.abs(one - many)) < 0.05 * np.mean(np.abs(one))
    assert np.allclose(net.emissions(pii.codes(text)[:, None].astype(np.intp))[:, 0], one, atol=1e-3)
    both = net.scores([pii.codes(text), pii.codes("short"), pii.codes("")], window=200, overlap=60)
    assert np.allclose(both[: len(text)], many, atol=1e-3) and len(both) == len(text) + 5
    base, all_ = pii.find_spans([text], net)[0]
    assert base == literal_spans(text) and [s for s in all_ if s[0] == "ip"] == base
    phones = [text[a:b] for kind, a, b in all_ if kind == "phone"]
    assert len(phones) >= 25 and all(re.fullmatch(r"\(017\) 555-77\d\d", p) for p in phones)


def test_redaction():
    assert pii.redact("a x@y.z b 1.2.3.4", pii.base_spans("a x@y.z b 1.2.3.4")) == "a [EMAIL] b [IP]"
    assert pii.redact("12345", [("card", 0, 3), ("phone", 2, 4)]) == "[CARD]5"


# ---------------------------------------------------------------- embeddings


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = centers[i % 12] + rng.normal(size=16) * 0.23
        rows.append((i, (rows[i - 1][1] if i % 9 == 0 and i else [float(x) for x in v]), i % 3))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, tile=16).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.93) & (np.array([[a[2] == b[2] for b in rows] for a in rows]))
    np.fill_diagonal(link, False)
    label = np.arange(len(rows))
    while True:
        new = np.array([min([label[i], *label[link[i]]]) for i in range(len(rows))])
        if (new == label).all():
            break
        label = new
    assert got == {i: (int(link[i].sum()), int(label[i])) for i in range(len(rows))}
    assert link.any()


def test_suffix_bounds_lose_no_pair():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(60, 32)), rng.normal(size=(50, 32))
    b[:20] = a[:20] + rng.normal(size=(20, 32)) * 0.2
    a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    i, j = embedding_dedup._compare(a, b, 0.93)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*map(list, np.nonzero(a @ b.T >= 0.93)), strict=True))


# ---------------------------------------------------------------- licences


def test_suffix_automaton_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        seqs = [[rng.randint(1, 3) for _ in range(rng.randint(1, 8))] for _ in range(3)]
        query = [rng.randint(1, 4) for _ in range(12)]
        automaton = SuffixAutomaton(seqs)
        ends = automaton.ends()
        subs = {tuple(s[a:b]) for s in seqs for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
        for i, (n, state) in enumerate(automaton.statistics(query)):
            assert n == max(m for m in range(i + 2) if m == 0 or tuple(query[i + 1 - m : i + 1]) in subs)
            if n:
                assert ends[state] == sorted({(k, e) for k, s in enumerate(seqs) for e in range(n, len(s) + 1) if s[e - n : e] == query[i + 1 - n : i + 1]})


def test_license_base_equals_brute_force():
    scanner = license_scan.Scanner()
    for t in [*texts(), "CC-BY cc by, all rights reserved all rights reserved", "GNU General Public\nLicense"]:
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        r = scanner.scan(t)
        assert (r["n_words"], r["n_base"]) == (len(ws), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))


def test_matches_are_maximal_in_each_template():
    """A template that another one goes on from counts where the text goes on with the other's words."""
    scanner = license_scan.Scanner()
    for t in ('Licensed under the Apache License, Version 2.0 (the "License"); see LICENSE for details', "Licensed under the Apache License, Version 2.0.\nThe author of this text"):
        r = scanner.scan(t)
        assert r["labels"] == "apache" and [x["share"] for x in r["spans"]] == [1.0]
    rng = random.Random(6)
    templates = [t for t in license_scan.read_templates() if len(license_scan.words(t[1])) < 40][::6]
    scanner = license_scan.Scanner(templates)
    split = [license_scan.words(t) for _, t in templates]
    for _ in range(60):
        ws = []
        while len(ws) < 60:
            s = rng.choice(split)
            i = rng.randrange(len(s))
            ws += s[i : i + rng.randint(1, 14)] + [b"zzz"] * (rng.random() < 0.2)
        want = set()
        for k, s in enumerate(split):
            for i in range(1, len(ws) + 1):
                for j in range(1, len(s) + 1):
                    n = 0
                    while n < min(i, j) and ws[i - 1 - n] == s[j - 1 - n]:
                        n += 1
                    if n >= min(license_scan.MIN_MATCH, len(s)) and not (i < len(ws) and j < len(s) and ws[i] == s[j]):
                        want.add((k, i - n, j - n, n))
        got = scanner.matches(scanner.encode(ws))
        assert len(got) == len(set(got)) and set(got) == want


def test_the_most_specific_template_wins():
    scanner = license_scan.Scanner()
    scan = lambda text: (r := scanner.scan(text))["labels"].split(",") + [s["label"] for s in r["spans"]]
    assert scan("GNU Lesser General Public License version 2.1") == ["gpl", "lgpl", "lgpl"]  # gpl is the base phrase's
    assert scan("Licensed under CC BY-SA 4.0.") == ["cc-by", "cc-by-sa", "cc-by-sa"]
    assert scan("SPDX-License-Identifier: MIT") == ["mit", "mit"] and scan("SPDX-License-Identifier: Other") == [""]
    clauses = collections.defaultdict(list)
    for label, text in license_scan.read_templates():
        clauses[label].append(text)
    for label, texts_ in clauses.items():
        whole = scanner.scan("Some words first. " + "\n\n".join(texts_) + " And some words after.")
        assert label in whole["labels"].split(",") and collections.Counter(s["label"] for s in whole["spans"]).most_common(1)[0][0] == label
    warranty = next(t for t in clauses["mit"] if t.startswith("THE SOFTWARE IS PROVIDED"))
    assert scanner.scan(warranty)["labels"] == "mit" and scanner.scan(warranty)["score"] > 0.99


def best_chain(ms, gap):
    """The most words that a chain of matches covers, over all chains."""
    best = [0]

    def grow(last, covered, rest):
        best[0] = max(best[0], covered)
        for x, (i, j, n) in enumerate(rest):
            over = max(0, last[0] + last[2] - i, last[1] + last[2] - j)
            if last[0] < i and last[1] < j and over < n and i - last[0] - last[2] <= gap and j - last[1] - last[2] <= gap:
                grow((i, j, n), covered + n - over, rest[x + 1 :])

    for x, m in enumerate(ms):
        grow(m, m[2], ms[x + 1 :])
    return best[0]


def test_chains_equal_brute_force():
    rng = random.Random(4)
    words_ = "a b c d e f g h i j k l m n o p".split()
    found = 0
    for _ in range(150):
        template = [rng.choice(words_) for _ in range(14)]
        scanner = license_scan.Scanner([("x", " ".join(template))], phrases={}, gap=3)
        text = list(template)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 2)] = [rng.choice(words_)] * rng.randint(0, 2)
        ids = scanner.encode([w.encode() for w in text])
        best = best_chain(sorted((i, j, n) for _, i, j, n in scanner.matches(ids)), 3)
        spans = scanner.spans(ids)
        assert bool(spans) == (best >= 0.75 * 14) and (not spans or spans[0][3] == min(1.0, best / 14))
        found += bool(spans)
    assert 20 < found < 150


def test_chains_bridge_small_changes():
    r = license_scan.Scanner().scan("Intro words. Licensed under the Apache License, hm Version 2.0! And so on.")
    assert r["labels"] == "apache" and r["base_labels"] == "" and 0.6 < r["score"] < 1
    assert (r["spans"][0]["start"], r["spans"][0]["end"]) == (2, 11)
    assert license_scan.Scanner().scan("the license of the work and the terms")["labels"] == ""


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark):
    """Each stage by itself on what the last one kept; the last packs all that is left."""
    docs = common.documents(spark, SMALL)
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    tables = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.table(stage(spark, docs, SMALL), "test")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS, name
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= kept
        kept = set(ids)
        tables.append({r["doc_id"]: r["text"] for r in docs.collect()})
    good = {r["doc_id"] for r in registered.queries()["op4_quality"](spark, SMALL).where("predicted = 1").collect()}
    assert set(tables[0]) == good
    assert set(tables[1]) == good
    order = sorted(tables[1])
    brute = brute_components([tables[1][i] for i in order])
    assert set(tables[2]) == {order[c] for _, c in brute.values()}
    assert set(tables[3]) == set(tables[2])
    assert not any(pii.base_spans(t) for t in tables[3].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r["doc_id"] for r in packed} == set(tables[3])


def test_pipeline_keeps_documents_of_repeated_and_missing_ids(spark):
    """Near duplicates go by row: texts of one id that differ both stay, copies give way to the smallest id, rows without an id come last."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, words(1)), (1, words(2)), (None, words(3)), (None, words(4)), (5, words(4)), (7, words(1)), (2, words(5)), (2, words(5)), (8, None), (9, None), (10, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, df, SMALL).collect()
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in got), key=str) == sorted([(1, words(1)), (1, words(2)), (0, words(3)), (5, words(4)), (2, words(5)), (8, None), (9, None), (10, "")], key=str)


def test_pipeline_run_equals_its_stages(spark, tmp_path):
    """run() on a folder of its own: odd rows beside whole documents; what is packed are the tokens of what each stage left, done here by plain Python."""
    source = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    odd = [{"doc_id": None, "text": source[0]["text"] + " one more", "lang": None, "source": None, "n_chars": None}, {"doc_id": source[1]["doc_id"], "text": source[2]["text"] + " and more", "lang": "en", "source": "s", "n_chars": 3}, {"doc_id": 10**9, "text": None, "lang": "en", "source": "s", "n_chars": None}, {"doc_id": 10**9, "text": "", "lang": "en", "source": "s", "n_chars": 0}]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in source + odd], schema).write.parquet(f"{tmp_path}/documents.parquet")
    common.labels(spark, SMALL).write.parquet(f"{tmp_path}/labels.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = common.documents(spark, str(tmp_path))
    good = quality_crf.score_quality(docs, common.labels(spark, str(tmp_path)), keep=("text", "lang", "source")).where("predicted = 1").collect()
    pages, hosts = collections.defaultdict(set), collections.defaultdict(set)
    for r in good:
        if r["source"] is not None and r["doc_id"] is not None:
            hosts[r["source"]].add(r["doc_id"])
            for line in (r["text"] or "").split("\n"):
                pages[r["source"], line.strip(" ")].add(r["doc_id"])
    bad = {k for k, ids in pages.items() if k[1] and len(ids) >= line_dedup.MIN_PAGES and len(ids) > line_dedup.RATIO * len(hosts[k[0]])}
    kept = [(r["doc_id"], None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(" ")) not in bad)) for r in good]
    kept.sort(key=lambda k: (k[0] is None, k[0] or 0))
    first = {c: k for k, c in reversed([(k, c) for k, (_, c) in brute_components([t for _, t in kept]).items()])}
    left = [kept[k] for k in first.values()]
    net = pii.fit(spark.createDataFrame(left, "doc_id long, text string"))
    t = tokenizers.Tokenizer.from_file(packing.TOKENIZER)
    texts_ = [pii.redact(x or "", pii.find_spans([x or ""], net)[0][1]) for _, x in left]
    want = collections.Counter(len(t.encode(x, add_special_tokens=False).ids) + 1 for x in texts_)
    total = 0
    by = collections.defaultdict(list)
    for r in packed:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(n * k for n, k in want.items()) and len({r["doc_id"] for r in packed}) == len({i for i, _ in left})
    assert sum(r["piece"] == 0 for r in packed) == len(left)
    for held in by.values():
        held.sort()
        assert all(o == sum(n for _, n in held[:i]) for i, (o, _) in enumerate(held)) and sum(n for _, n in held) <= 2048
    assert len(by) <= -(-total // 2048) + 1
