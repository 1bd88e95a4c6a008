"""Each operator against a plain brute-force version on small tables, and its edge cases."""

import hashlib
import random
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ionloom.llm import ann, bpe, chains, lines, mixing, quality, rules, simhash, suffixes, toxicity
from ionloom.llm.common import components, discard, materialize, release
from ionloom.llm.units import unit_columns

SF = "/root/testdata/sf0.001"
#: Names that operators use themselves.
CLASH = ("size", "src", "id", "k", "sub", "h", "fp", "node", "own", "asked", "spans", "words", "copy", "block", "gl", "gs", "host", "path", "score", "c", "x", "row", "bag", "held_out")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
EDGES = [
    (0, "", "en", "a"),
    (1, None, "en", "a"),
    (2, "one two three", None, None),
    (3, "one two three", None, None),
    (4, " ".join(f"w{i}" for i in range(9000)), "en", "a"),
    (5, "same line here and more of it\nanother line that is long enough\nand a third line", "en", "b"),
    (6, "same line here and more of it\nanother line that is long enough\nand a third line", "en", "b"),
    (6, "same line here and more of it\nanother line that is long enough\nand a third line", "en", "b"),
    (None, "no id but some text, which is not very long", "en", None),
    (None, None, None, None),
    (9, "\t\n \x0b\x0c\r", "fr", "b"),
    (10, "x" * 20000, "fr", "b"),
    (11, "  　  é日本🙂 <|endoftext|> 's 'll", "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, None, *["1"] * len(CLASH)) for r in EDGES], DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def brute_fingerprint(text, k):
    w = text.encode().lower().split()
    pieces = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(codes, near):
    """Smallest id reachable, by id."""
    ids = sorted(codes)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if near(codes[i], codes[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("words,radius,radius2", [(4, 4, None), (5, 10, 14)])
def test_simhash(spark, docs, words, radius, radius2):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs, words, radius, radius2).collect()}
    fps = {i: simhash.fingerprint(simhash.shingles(t, words)) for i, t in texts(docs).items()}
    if words == 4:
        assert all(fps[i] == brute_fingerprint(t, words) for i, t in list(texts(docs).items())[:60])
    assert all(got[i].fp % 2**64 == fps[i] for i in fps)
    second = {i: (fps[i], simhash.fingerprint(simhash.shingles(t, words), 43)) for i, t in texts(docs).items()}

    def near(a, b):
        low, high = sorted((x ^ y).bit_count() for x, y in zip(a, b))
        return low <= radius and high <= radius2 if radius2 else (a[0] ^ b[0]).bit_count() <= radius

    want = linked(second, near)
    assert {i: r.component_id for i, r in got.items()} == want


def test_simhash_large_shards_are_cut(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    codes = {i: base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for i in range(300)}
    codes |= {1000 + i: rng.getrandbits(64) for i in range(200)}
    seen = {}
    codes = {i: c for i, c in codes.items() if seen.setdefault(c, i) == i}
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(i, signed(c)) for i, c in codes.items()], "node long, fp long")
    want = linked(codes, lambda a, b: (a ^ b).bit_count() <= 3)
    found = {r.u: r.component for r in components(simhash.links(df, 3, tree_nodes=16)).collect()}
    assert {i: found.get(i, i) for i in codes} == want


def test_search_holds_few_nodes_at_once(monkeypatch):
    """However many nodes a radius lets through, a search takes FRONTIER of them a level further at once, and misses none."""
    monkeypatch.setattr(simhash, "FRONTIER", 500, raising=False)
    codes = np.random.default_rng(2).integers(0, 1 << 64, 900, dtype=np.uint64)
    root = np.zeros(900, np.int64)
    got = list(simhash.search(codes, root, simhash.forest(codes, root), codes, root, 30))
    assert max(len(q) for q, _ in got) <= 500
    near = np.argwhere(np.bitwise_count(codes[:, None] ^ codes) <= 30)
    assert sorted((int(a), int(b)) for q, found in got for a, b in zip(q, found)) == [tuple(x) for x in near.tolist()]


@pytest.mark.parametrize("tree_nodes", [16, 4096])
def test_simhash_passes_meet_all_links(spark, tree_nodes):
    """The parts of the shards together link what all link; codes of one node are not searched again."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    codes = {i: base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for i in range(150)}
    codes |= {1000 + i: rng.getrandbits(64) for i in range(50)}
    seen = {}
    codes = {i: c for i, c in codes.items() if seen.setdefault(c, i) == i}
    signed = lambda x: x - 2**64 if x >> 63 else x
    df = spark.createDataFrame([(i, signed(c)) for i, c in codes.items()], "node long, fp long")
    want = linked(codes, lambda a, b: (a ^ b).bit_count() <= 3)
    first = {r.u: r.component for r in components(simhash.links(df, 3, tree_nodes=tree_nodes, part="first")).collect()}
    held = spark.createDataFrame([(first.get(i, i), signed(c)) for i, c in codes.items()], "node long, fp long")
    rest = {r.u: r.component for r in components(simhash.links(held, 3, tree_nodes=tree_nodes, part="rest")).collect()}
    assert {i: rest.get(first.get(i, i), first.get(i, i)) for i in codes} == want
    done = spark.createDataFrame([(want[i], signed(c)) for i, c in codes.items()], "node long, fp long")
    assert simhash.links(done, 3, tree_nodes=tree_nodes).isEmpty()


def test_release_drops_the_shuffles_of_the_last_table(spark):
    local = [Path(d.toString()) for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in local for p in d.rglob("shuffle_*.data")}
    before = files()
    table = materialize(spark.range(1000).repartition("id").withColumn("x", F.col("id") + 1))
    made = files() - before
    assert made
    release(spark)
    for _ in range(10):  # files go on another thread
        if not made & files():
            break
        time.sleep(0.1)
    assert not made & files()
    assert table.count() == 1000
    discard(table)


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(200, 260)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + [(500, i) for i in range(501, 560)]
    near = {frozenset(p) for p in pairs}
    nodes = {i: i for p in pairs for i in p}
    want = linked(nodes, lambda a, b: frozenset((a, b)) in near)
    got = {r.u: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: c for i, c in want.items() if i in got} and all(want[i] == i for i in want if i not in got)


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 24)) * rng.uniform(0.2, 3, (700, 1))
    x[50:90] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0] * 3), (None, [1.0] * 24), (904, [None] + [1.0] * 23)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = ann.nearest(df, df.filter("id % 20 = 0"), k=20).toPandas()
    hits = 0
    for q in range(0, 700, 20):
        mine = got[got.query_id == q].sort_values("rank")
        s = x @ x[q]
        s[q] = -np.inf
        order = np.lexsort((np.arange(700), -np.round(s, 9)))[:20]
        hits += len({*mine.vec_id} & {*order.tolist()})
        assert list(mine["rank"]) == list(range(1, 21))
        assert np.allclose(mine.score, s[mine.vec_id])
        assert (np.diff(mine.score) <= 0).all() and all(b > a for (s1, a), (s2, b) in zip(zip(mine.score, mine.vec_id), zip(mine.score[1:], mine.vec_id[1:])) if s1 == s2)
    assert hits >= 0.9 * 20 * 35
    odd = df.filter("id < 60").unionByName(df.filter("id < 60")).unionByName(spark.createDataFrame([(20, [0.0] * 23 + [9.0])], "id long, vector array<double>"))
    rows = ann.nearest(odd, odd.filter("id % 20 = 0"), k=20).collect()
    assert Counter(r.query_id for r in rows) == {0: 20, 20: 20, 40: 20} and len({(r.query_id, r.vec_id, r.score) for r in rows}) == 60
    few = df.filter("id < 5")
    assert ann.nearest(few, few, k=20).count() == 20
    assert ann.nearest(df.filter("false"), df, k=20).count() == 0


def test_ann_examines_few_rows_of_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((100, 32))
    x = centres[np.arange(4000) % 100] + 0.1 * rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    got = ann.nearest(df, df.filter("id % 20 = 0"), k=20).toPandas()
    hits = 0
    for q, mine in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({*mine.vec_id} & {*np.argsort(-s)[:20].tolist()})
    assert hits >= 0.9 * 20 * 200 and got.examined.mean() < 0.2 * 4000


def test_multi_index_finds_all_within_a_radius():
    rng = np.random.default_rng(0)
    code = rng.integers(0, 1 << 16, (500, 8), dtype=np.uint16)
    query = code[:20] ^ rng.choice([0, 1, 3, 256], (20, 8)).astype(np.uint16)
    for radius in (0, 5, 17, 50):
        q, row, d = ann.Index(code).within(query, radius)
        full = np.bitwise_count(query[:, None] ^ code[None]).sum(2)
        assert {*zip(q.tolist(), row.tolist())} == {*zip(*(a.tolist() for a in np.nonzero(full <= radius)))}
        assert (full[q, row] == d).all()


def brute_removed(docs, width=100):
    seen, out = set(), {}
    for i in sorted(docs):
        raw = docs[i].encode()
        gone = bytearray(len(raw))
        for q in range(len(raw) - width + 1):
            if (w := raw[q : q + width]) in seen:
                gone[q : q + width] = b"\1" * width
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i] = (len(raw), sum(gone), sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group", [1000, 4])
def test_suffixes(spark, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng = random.Random(group)
    parts = ["".join(rng.choice("abcd éf") for _ in range(rng.randint(90, 500))) for _ in range(8)] + ["ab" * 200]
    docs = {i: "".join(rng.choice(parts)[rng.randint(0, 60) :] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(0, 5))) for i in range(80)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df).collect()}
    assert got == brute_removed(docs)


def test_suffixes_of_odd_ids(spark):
    """Null and repeated ids: texts of their own, in an order of their own."""
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    p, q = text(300), text(300)
    rows = [(1, p), (1, q), (1, q), (2, p[50:250]), (None, q[:200] + text(40)), (None, text(150)), (None, p[:120]), (None, p[:120])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {(r.doc_id, r.text): (r["sub"] < 0, r.k, r["sub"]) for r in unit_columns(df)[1].collect()}
    order = sorted(keys, key=keys.get)
    want = dict(zip(order, brute_removed({i: t for i, (_, t) in enumerate(order)}).values()))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(df).collect())
    assert got == Counter((i, *want[i, t]) for i, t in rows)
    assert want[1, p][1] == want[1, q][1] == 0


def test_equal_hashes_of_unequal_windows_are_compared_again(monkeypatch):
    contexts = [bytes([65 + k % 3]) * 12 for k in range(9)]
    monkeypatch.setattr(suffixes, "_classes", lambda order, common, least: np.zeros(len(order), np.int64))
    got = suffixes.repeated_windows(contexts, np.full(9, 2), np.full(9, 3), np.zeros(9, np.int64), 10)
    assert got.tolist() == [[k > 2] * 3 for k in range(9)]


def test_suffix_sort():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    group = np.sort(np.array([rng.randrange(6) for _ in strings]))
    start = np.cumsum([0, *map(len, strings)])[:-1]
    order, common = suffixes.suffix_sort(np.frombuffer(b"".join(strings), np.uint8), start, np.array([*map(len, strings)]), group)
    for g in range(6):
        mine = [i for i in order if group[i] == g]
        assert mine == sorted((i for i in range(400) if group[i] == g), key=lambda i: (strings[i], i))
    for k in range(1, 400):
        a, b = strings[order[k - 1]], strings[order[k]]
        if group[order[k - 1]] == group[order[k]]:
            assert common[k] == next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_mixing(spark, docs, edges):
    for df in (docs, edges):
        got = mixing.mixed_documents(df).collect()
        assert len(got) == df.count()
        sizes = sorted(len((t or "").encode().split()) for (t,) in df.select("text").collect())
        assert sorted(r["size"] for r in got) == sizes
        by = {}
        for r in got:
            assert 0 <= r.taken <= 3 * r["size"]
            by.setdefault(r.source, []).append(r)
        order = sorted(by, key=lambda s: (s is None, s or ""))
        source = [sum(r["size"] for r in by[s]) for s in order]
        # the excess is reshared until none is above
        weight = [1 + i % 3 for i in range(len(order))]
        want, open_, left = [0.0] * len(order), set(range(len(order))), float(sum(source))
        while open_:
            level = left / sum(weight[i] for i in open_)
            over = {i for i in open_ if level * weight[i] > 3 * source[i]}
            for i in over or open_:
                want[i] = 3.0 * source[i] if over else level * weight[i]
                left -= want[i] if over else 0
            open_ -= over or open_
        for s, w, n in zip(order, want, source):
            assert all(abs(r.target - w) < 1e-6 and r.source_size == n for r in by[s])
            assert abs(sum(r.taken for r in by[s]) - w) <= 1
            assert all(r.taken == sum(x.words for x in r.shards) for r in by[s])
    again = mixing.mixed_documents(docs.repartition(7)).collect()
    first = mixing.mixed_documents(docs).collect()
    assert sorted((r.doc_id, r.taken, r.shards) for r in again) == sorted((r.doc_id, r.taken, r.shards) for r in first)
    other = mixing.mixed_documents(docs, seed=18).collect()
    by_source = lambda rows: {s: sum(r.taken for r in rows if r.source == s) for s in {r.source for r in rows}}
    assert by_source(other) == by_source(first) and {(r.doc_id, tuple(r.shards)) for r in other} != {(r.doc_id, tuple(r.shards)) for r in first}


def test_splitting_tree(spark):
    q = spark.createDataFrame([("a", 5000), ("b", 37), ("c", 1), (None, 200)], "source string, quota long")
    rows = mixing.splitting_tree(q, 3, 1).collect()
    for s, n in (("a", 5000), ("b", 37), ("c", 1), (None, 200)):
        assert sum(r.n for r in rows if r.source == s) == n and all(r.n >= 0 for r in rows)
    assert len({sum(r.n for r in rows if r.shard == k) for k in range(8)}) <= 2


@pytest.mark.parametrize("k,good,total", [(5, 3, 9), (40, 30, 100), (300, 700, 1500), (2500, 5000, 6000), (7, 7, 7), (0, 5, 9)])
def test_hypergeometric_draws(spark, k, good, total):
    """Inverted at 2,000 even steps the draws have the exact probabilities, by a chi-square test."""
    n = 2000
    u = (F.col("id") + 0.5) / n
    got = Counter(r[0] for r in spark.range(n).select(mixing.hypergeometric(F.lit(k), F.lit(good), F.lit(total), u)).collect())
    lf = np.concatenate(([0], np.cumsum(np.log(np.arange(1, total + 1)))))
    choose = lambda a, b: lf[a] - lf[b] - lf[a - b]
    p = {x: float(np.exp(choose(good, x) + choose(total - good, k - x) - choose(total, k))) for x in range(max(0, k - total + good), min(k, good) + 1)}
    assert {*got} <= {*p}
    likely = [x for x in p if p[x] * n >= 5]
    assert sum((got[x] - n * p[x]) ** 2 / (n * p[x]) for x in likely) <= 0.3 * len(likely)


def test_splits_vary_with_the_seed(spark):
    """Over 1,000 seeds a half's count of a source has the hypergeometric mean and variance."""
    q = spark.createDataFrame([("a", 400), ("b", 600)], "source string, quota long")
    counts = []
    for seed in range(40):
        counts += [r.n for r in mixing.splitting_tree(q, 1, seed).collect() if r.source == "a" and r.shard == 0]
    assert abs(np.mean(counts) - 200) < 4 * 7.75 / 40**0.5 and 3.5 < np.std(counts) < 13


def test_draws_are_disjoint(docs):
    _, draws = mixing.mix(docs)
    assert draws.count() == draws.select("src", "doc_id", "copy", "block", "pass").distinct().count()


def test_toxicity(spark, docs, labels, edges):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = toxicity.toxicity(*train).join(train[1], "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.predicted == held.toxic).mean() >= 0.93 and (out.predicted == out.toxic).mean() >= 0.95
    assert out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    got = toxicity.toxicity(edges, labels).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)


def test_toxicity_against_a_plain_version(docs, labels):
    """Counts, evidence, training and scores in plain Python; toxic texts of the smallest table are found."""
    known = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    text = texts(docs)
    rows = sorted((i, y, text[i]) for i, y in known.items() if i in text)
    n, toxic = Counter(), Counter()
    for _, y, t in rows:
        words = {w for s in toxicity.SENTENCE.split(t) for w in toxicity.words_of(s)}
        n.update(words)
        toxic.update(words if y else ())
    rate = (sum(y for _, y, _ in rows) + 0.5) / (len(rows) + 1)
    c2, evidence = 2 * np.log(len(n)), {}
    for w in n:
        z2 = (toxic[w] - n[w] * rate) ** 2 / (n[w] * rate * (1 - rate))
        if z2 > c2:
            evidence[w] = (np.log((toxic[w] + 2 * rate) / (n[w] - toxic[w] + 2 * (1 - rate))) - np.log(rate / (1 - rate))) * (1 - c2 / z2)
    told = sorted(evidence)
    bags = [[x for s in toxicity.SENTENCE.split(t) if (x := sorted({told.index(w) for w in toxicity.words_of(s) if w in evidence}))] for _, _, t in rows]
    y = np.array([y for _, y, _ in rows])
    theta, bias = toxicity.fit_words(bags, y, np.array([evidence[w] for w in told]))
    silent = [k for k, bag in enumerate(bags) if not bag]
    leak = (y[silent].sum() + 0.5) / (len(silent) + 1)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    for i, t in text.items():
        none = 1 - leak
        for s in toxicity.SENTENCE.split(t):
            words = {w for w in toxicity.words_of(s) if w in evidence}
            if words:
                none *= 1 - 1 / (1 + np.exp(-(bias + sum(theta[told.index(w)] for w in words))))
        assert abs(got[i].score - (1 - none)) < 1e-6
    found = [got[i].predicted == 1 for i, y, _ in rows if y]
    assert np.mean(found) >= 0.5 and not any(got[i].predicted for i, y, _ in rows if not y)


def test_noisy_or_learns_sentences():
    rng = random.Random(0)
    bags, y = [], []
    for i in range(600):
        bag = [[rng.randrange(1, 10)] for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            bag[rng.randrange(len(bag))].append(0)
        bags.append(bag)
        y.append(int(i % 3 == 0))
    theta, bias = toxicity.fit_words(bags, np.array(y), np.array([1.0] + [0.0] * 9))
    assert bias + theta[0] > 0 > bias + max(theta[1:])


def test_lines(spark, docs, edges):
    clash = edges.withColumns({c: F.lit("mine") for c in ("k", "sub", "row", "cuts", "ats", "_id", "held", "given", "h1")})
    for df in (docs, edges, clash):
        units = {(r.doc_id, r.text): (r["sub"] < 0, r.k, r["sub"]) for r in unit_columns(df)[1].collect()}
        seen, want = {}, {}
        for i, t in sorted(units, key=units.get):
            kept, gone = [], 0
            cut = lines.chunks(t)
            assert b"\n".join(c[0] for c in cut).decode() == t
            for k, c in enumerate(cut):
                if lines.looked_up(c) and seen.setdefault(c[0], (i, t, k)) != (i, t, k):
                    gone += c[1]
                else:
                    kept.append(c[0])
            want[i, t] = gone, hashlib.sha256(b"\n".join(kept)).hexdigest()
        got = lines.line_digests(df).collect()
        rows = df.select("doc_id", F.coalesce("text", F.lit(""))).collect()
        assert Counter((r.doc_id, r.n_removed_lines, r.kept_sha256) for r in got) == Counter((i, *want[i, t]) if (i, t) != (None, "") else (i, 0, want[i, t][1]) for i, t in rows)
    out = lines.dedup_lines(clash)
    assert out.columns == [*clash.columns, *lines.COUNTS] and all(r["k"] == r["_id"] == "mine" for r in out.collect())


def test_line_chunks_realign():
    rows = [f"line number {i} with some words" for i in range(60)]
    a = {c[0] for c in lines.chunks("\n".join(rows))}
    b = {c[0] for c in lines.chunks("\n".join(["new first line", *rows[:30], "another new one", *rows[30:]]))}
    assert len(a & b) >= len(a) - 4


def words_made(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def test_line_dedup_deals_texts_once(spark):
    """Both joins of the texts read one exchange, at a size at which no side is broadcast."""
    rows = [(i, "\n".join(f"line {j} of {i // 2}" for j in range(12)), "x") for i in range(200)]
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if spark.conf.get(c, None)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"))
        cut = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted(r.doc_id for r in cut if r.n_removed_lines) == list(range(1, 200, 2))
    assert "ReusedExchange" in plan and "text" in plan.split("ReusedExchange")[1].split("\n")[0]


def test_chains(spark):
    rng = random.Random(2)
    passage, docs = words_made(rng, 80), {}
    for i in range(30):
        p = list(passage)
        for _ in range(2 if i % 4 == 2 else 0):
            p[rng.randrange(80)] = f"zz{i}"
        docs[i] = " ".join(words_made(rng, rng.randint(0, 60)) + (p if i % 2 == 0 else []) + words_made(rng, 50))
    got = {r.doc_id: r for r in chains.fuzzy_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert all(got[i].n_spans > 0 and got[i].n_repeated >= 75 for i in range(2, 30, 2))
    assert all(got[i].n_spans == 0 for i in [0, *range(1, 30, 2)])


def test_passages_made_of_earlier_fragments(spark):
    """Pieces too short to count stand in earlier documents; two documents hold the whole, one of them with null ids around."""
    rng = random.Random(3)
    whole = words_made(rng, 400)
    docs = [(i, words_made(rng, 60) + whole[25 * i : 25 * i + 35] + words_made(rng, 40)) for i in range(16)]
    docs += [(50, words_made(rng, 30) + whole + words_made(rng, 20)), (60, words_made(rng, 40) + whole + words_made(rng, 10)), (None, whole), (None, words_made(rng, 50)), (60, whole[:200])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")
    rows = chains.fuzzy_passages(df).collect()
    got = sorted((r.doc_id or 99, r.n_words, r.n_repeated) for r in rows if r.doc_id is None or r.doc_id >= 50)
    assert got == [(50, 450, 0), (60, 200, 200), (60, 450, 400), (99, 50, 0), (99, 400, 400)]


@pytest.mark.parametrize("n", [3, 25])
def test_passages_of_neither_the_first_nor_the_last_stay(spark, n):
    """A passage's pieces stand in n documents before and in n after the one that holds it whole; its copy has an edit between pieces."""
    rng = random.Random(11)
    whole = words_made(rng, 72)
    pieces = [whole[a : a + 17] for a in range(0, 72, 18)]
    made = lambda: [words_made(rng, 30) + p + words_made(rng, 30) for _ in range(n) for p in pieces]
    edited = [f"e{i}" if i % 18 == 17 else w for i, w in enumerate(whole[:71])]
    docs = [*made(), words_made(rng, 30) + whole[:71] + words_made(rng, 30), *made(), words_made(rng, 30) + edited + words_made(rng, 30)]
    holder = len(docs) // 2 - 1
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: r for r in chains.fuzzy_passages(df).collect()}
    assert got[len(docs) - 1].n_repeated == 71 and {s.partner for s in got[len(docs) - 1].spans} == {holder}
    assert all(got[i].n_repeated == 0 for i in range(len(docs) - 1))


@pytest.mark.parametrize("blocks", [4096, 8])
def test_further_stays_against_all_pairs(spark, monkeypatch, blocks):
    """With every seed held to be frequent, passages are those that growth from any shared seed finds among all pairs."""
    rng = random.Random(12)
    line, other = words_made(rng, 9), words_made(rng, 9)
    passages = [line + words_made(rng, 50) for _ in range(4)]
    docs = []
    for i in range(60):
        p = list(passages[i % 4]) if i % 3 == 0 else [*line, *words_made(rng, 30), *other]
        for at in rng.sample(range(len(p)), 4):
            p[at] = f"e{i}-{at}"
        docs.append(words_made(rng, 12) + p + words_made(rng, 12))
    monkeypatch.setattr(chains, "STAY_BLOCK", blocks)
    base = spark.createDataFrame([(i, 0, " ".join(t)) for i, t in enumerate(docs)], "k long, sub int, text string")
    stays = [(int(h), i, 0, int(at)) for i, t in enumerate(docs) for at, h, _ in zip(*chains.seeds(chains.words_of(" ".join(t))))]
    hot = spark.createDataFrame(stays, "h long, k long, sub int, pos int")
    none = spark.createDataFrame([], "k long, sub int, begin int, end int")
    want, by_seed = {}, {}
    texts = [chains.words_of(" ".join(t)) for t in docs]
    for h, i, _, at in stays:
        by_seed.setdefault(h, []).append((i, at))
    for h, met in by_seed.items():
        size, span = (chains.LONG if h & 1 else chains.SHORT), chains.CONTEXT
        for i, a in met:
            for j, b in met:
                if j < i:
                    x, y = texts[i], texts[j]
                    right = chains.grow(x[a + size :][:span], y[b + size :][:span])
                    left = chains.grow(x[:a][::-1][:span], y[:b][::-1][:span])
                    length, matched, columns = (u + v + size for u, v in zip(right, left))
                    if length >= 40 and matched >= 0.8 * columns:
                        want.setdefault(i, set()).update(range(a - left[0], a + size + right[0]))
    got: dict[int, set] = {}
    for r in chains._further(base, hot, none, 40, 0.8).collect():
        (run,) = r.runs
        x, y = texts[r.k], texts[r.fk]
        right = chains.grow(x[run.a + run.n :][: chains.CONTEXT], y[run.b + run.n :][: chains.CONTEXT])
        left = chains.grow(x[: run.a][::-1][: chains.CONTEXT], y[: run.b][::-1][: chains.CONTEXT])
        got.setdefault(r.k, set()).update(range(run.a - left[0], run.a + run.n + right[0]))
    assert len(want) >= 10 and got == want


def test_meetings_go_before_texts_are_shipped(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(chains, "discard", lambda t, f=chains.discard: (seen.extend(t.columns), f(t))[1])
    monkeypatch.setattr(chains, "_handed", lambda *a, f=chains._handed: (seen.append("handed"), f(*a))[1])
    text = " ".join(words_made(random.Random(5), 80))
    rows = chains.fuzzy_passages(spark.createDataFrame([(1, text), (2, text + " more")], "doc_id long, text string")).collect()
    assert sorted(r.n_repeated for r in rows) == [0, 80]
    assert seen.index("fpos") < seen.index("handed")


def test_texts_are_gone_through_once_for_seeds(spark, monkeypatch):
    """A frequent seed's first stay, which is found without another pass over the texts, is a partner of all its other stays."""
    seen = spark.sparkContext.accumulator(0)

    def rows(base, f=chains._seed_rows):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return f(base.mapInArrow(count, base.schema))

    monkeypatch.setattr(chains, "_seed_rows", rows)
    monkeypatch.setattr(chains, "SAMPLE", 4)
    rng = random.Random(14)
    passage = words_made(rng, 60)
    docs = [(i, " ".join(words_made(rng, 10) + passage[: 60 - 7 * (i > 0)] + words_made(rng, 10))) for i in range(200)]
    df = spark.createDataFrame([*docs, (None, docs[0][1])], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in chains.fuzzy_passages(df).collect()}
    assert got[0].n_repeated == 0 and got[None].n_repeated == 80
    assert all(r.n_repeated >= 53 and 0 in {s.partner for s in r.spans} for i, r in got.items() if i)
    assert seen.value < 1.6 * 201


def test_seeds_of_texts_together():
    """Texts looked at together have the seeds and the numbers of words that each has alone."""
    rng = random.Random(15)
    texts = ["", " ", "A", *("".join(rng.choice(("ab", "C", "d\u00e9", " ", "  ", "\n", "\x0b\t")) for _ in range(rng.randrange(900))) for _ in range(60)), ""]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in range(30, 90)]
    rng.shuffle(texts)
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    held = np.frombuffer(b"".join(raw), np.uint8)
    assert chains.count_words(held, offsets).tolist() == [len(chains.words_of(t)) for t in texts]
    want = [(i, *s) for i, t in enumerate(texts) for s in zip(*(c.tolist() for c in chains.seeds(chains.words_of(t))))]
    assert len(want) > 500 and sorted(zip(*(c.tolist() for c in chains.text_seeds(held, offsets)))) == sorted(want)


def test_grow_all_is_grow():
    rng = random.Random(9)
    base = [[rng.randrange(1, 1 << 32) | 1 for _ in range(chains.CONTEXT)] for _ in range(4)]
    rows = []
    for i in range(120):
        row = list(base[i % 4])
        for at in sorted(rng.sample(range(len(row)), rng.randrange(6)), reverse=True):
            row[at : at + rng.randrange(3)] = [rng.choice((7, 9, 11)) for _ in range(rng.randrange(3))]
        rows.append(row[: rng.choice((3, 20, chains.CONTEXT, chains.CONTEXT))])
    words = np.zeros((len(rows), chains.CONTEXT + chains.SKIP + 3), np.uint32)
    for held, row in zip(words, rows):
        held[: len(row)] = row
    x, y = np.nonzero(np.ones((len(rows), len(rows)), bool))
    twos = words[:, :-1].astype(np.uint64) << np.uint64(32) | words[:, 1:]
    got = chains.grow_all(twos, chains.four_words(twos), x, y)
    assert list(zip(*(c.tolist() for c in got))) == [chains.grow(rows[a], rows[b]) for a, b in zip(x, y)]


def brute_cover(words, other, least=40, score=25):
    """Words in local alignments (1 for equal words, -3 for others) of so many words and such a score."""
    index = {w: i for i, w in enumerate({*words, *other})}
    x, y = np.array([index[w] for w in words]), np.array([index[w] for w in other])
    best = np.zeros(len(y) + 1, int)
    covered, tops = np.zeros(len(words), bool), {}
    begin = np.zeros(len(y) + 1, int)
    for i in range(len(x)):
        new, nb = np.zeros(len(y) + 1, int), np.full(len(y) + 1, i + 1)
        for j in range(len(y)):
            step = best[j] + (1 if x[i] == y[j] else -3)
            options = [(step, begin[j] if best[j] else i), (best[j + 1] - 3, begin[j + 1]), (new[j] - 3, nb[j])]
            s, b = max(options)
            if s > 0:
                new[j + 1], nb[j + 1] = s, b
        best, begin = new, nb
        for j in np.flatnonzero(best >= score):
            tops[begin[j]] = max(tops.get(begin[j], (0, 0)), (best[j], i + 1))
    for b, (_, e) in tops.items():
        if e - b >= least:
            covered[b:e] = True
    return covered


def test_fuzzy_recall(spark):
    """Passages of 60 words at 5 and 10 % edits among earlier documents, against an aligner over all pairs."""
    rng = random.Random(6)
    docs, found, there = {}, 0, 0
    passages = [words_made(rng, 60) for _ in range(8)]
    for n, p in enumerate(passages):
        docs[n] = words_made(rng, 20) + p + words_made(rng, 20)
        for m, edits in enumerate((0, 3, 6)):
            q = list(p)
            for at in rng.sample(range(60), edits):
                q[at] = f"e{n}{m}{at}"
            docs[100 + 10 * n + m] = words_made(rng, 15) + q + words_made(rng, 15)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in chains.fuzzy_passages(df).collect()}
    for i, t in docs.items():
        mine = np.zeros(len(t), bool)
        for s in got[i].spans:
            mine[s.begin : s.end] = True
            assert s.partner < i and s.identity >= 0.8 and s.end - s.begin >= 40
        if i >= 100:
            want = brute_cover(t, docs[(i - 100) // 10])
            there += want.sum()
            found += (mine & want).sum()
        else:
            assert not mine.any()
    assert found >= 0.9 * there > 0


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        x, y = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = [0] * (len(y) + 1)
        for w in x:
            new = [0]
            for j, v in enumerate(y):
                new.append(row[j] + 1 if w == v else max(row[j + 1], new[j]))
            row = new
        assert chains.equal_words(x, y) == row[-1]


def test_chains_are_disjoint_and_rise():
    rng = random.Random(5)
    for _ in range(30):
        m = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(25)})
        paths = chains.chain(m)
        assert sorted(x for p in paths for x in p) == m
        assert all(p[i][0] < p[i + 1][0] and p[i][1] < p[i + 1][1] for p in paths for i in range(len(p) - 1))
    line = [(3 * i, 3 * i + 7) for i in range(20)]
    assert sorted(chains.chain([*line, (30, 2), (1, 60)]), key=len)[-1] == line


def test_rules(docs, labels, edges):
    got = {r.doc_id: r for r in rules.quality_rules(docs).collect()}
    for i, t in texts(docs).items():
        w = t.encode().split()
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + d for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for d in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    judged = [(r, got[r.doc_id]) for r in labels.collect() if r.doc_id in got and not got[r.doc_id].base_failed]
    assert np.mean([g.kept for r, g in judged if r.quality == 1]) > 0.97 and np.mean([g.kept for r, g in judged if r.quality == 0]) <= 0.5
    assert len(rules.quality_rules(edges).collect()) == len(EDGES)


def plain_mcd(rows, names):
    """The estimates of groups (gl, gs) of features in whole steps, one start and group at a time."""
    d = len(names)
    groups = sorted({(r["gl"], r["gs"]) for r in rows})
    x = {g: np.array([[r[c] for c in names] for r in rows if (r["gl"], r["gs"]) == g], dtype=np.int64) for g in groups}
    upper = np.triu_indices(d)
    sums = lambda v: (len(v), v.sum(0), np.array([(v[:, i] * v[:, j]).sum() for i, j in zip(*upper)]))

    def solve(near):
        total = lambda some: tuple(sum((s[k] for s in some), 0 * next(iter(near.values()))[k]) for k in range(3))
        out = {}
        for g in groups:
            prior = rules.estimate(*total(near.values()))
            prior = rules.estimate(*total([s for h, s in near.items() if h[0] == g[0]]), prior)
            mean, second = rules.estimate(*near[g], prior)
            inv, logdet = rules.inverted(mean, second)
            out[g] = mean, inv, logdet
        return out

    best = {}
    for start in range(2):
        near = {}
        for g in groups:
            m = [np.sort(x[g][:, i] // 16)[int(np.ceil(len(x[g]) * 0.5)) - 1] * 16 + 8 for i in range(d)]
            near[g] = sums(x[g][np.abs(x[g] - m).max(1) <= 6 * rules.FLOOR * rules.STEP] if start == 0 else x[g])
        now = solve(near)
        for _ in range(40):
            for g in groups:
                diff = x[g] / rules.STEP - now[g][0]
                b = np.floor(np.log2(np.maximum(np.einsum("ij,jk,ik->i", diff, now[g][1], diff), 0) + 1e-6) * 16)
                cut = np.sort(b)[int(np.ceil(len(b) * rules.H)) - 1]
                near[g] = sums(x[g][b <= cut])
            now = solve(near)
        for g in groups:
            best[g] = min(best.get(g, now[g]), now[g], key=lambda e: e[2])
    return best


def test_minimum_covariance_determinant(spark, monkeypatch):
    monkeypatch.setattr(rules, "STARTS", 2)
    monkeypatch.setattr(rules, "SETTLED", 0.0)
    monkeypatch.setattr(rules, "STEPS", 40)
    rng = np.random.default_rng(1)
    names = ("a", "b", "c")
    rows = []
    for g, n in ((("en", "x"), 150), (("en", "y"), 12), (("de", "x"), 60), (("fr", "z"), 1)):
        v = rng.normal(0, [1, 2, 0.1], (n, 3)) + rng.normal(0, 3, 3)
        v[: n // 6] += 30
        rows += [dict(zip(("gl", "gs", *names), (*g, *map(int, np.round(p * rules.STEP))))) for p in v]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "gl string, gs string, a long, b long, c long")
    want = plain_mcd(rows, names)
    for limit in (20_000, 0):  # solved on the driver, and where the groups lie
        monkeypatch.setattr(rules, "BROADCAST_ROWS", limit)
        got = {(r.gl, r.gs): r for r in rules.mcd(df, names).collect()}
        assert got.keys() == want.keys()
        for g, (mean, inv, _) in want.items():
            assert np.allclose(got[g].mean, mean) and np.allclose(np.array(got[g].inv).reshape(3, 3), inv, rtol=1e-6)


def test_quality(docs, labels, edges):
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    right = [got[r.doc_id].kept == (r.quality == 1) for r in labels.collect() if r.doc_id in got]
    assert np.mean(right) > 0.95
    # the posteriors from the documents' own evidence, site by site
    own = {i: (r.host, r.path, r.own_score) for i, r in got.items()}
    sites, hosts = {}, {}
    for h, p, s in own.values():
        sites.setdefault((h, p), []).append(s)
        hosts.setdefault(h, []).append(s)
    rate = np.mean([s for *_, s in own.values()])

    def strength(groups):
        groups = [(np.array(v), m) for v, m in groups if len(v) > 1]
        between = sum(len(v) * (v.mean() - m) ** 2 for v, m in groups)
        one, every = sum(m * (1 - m) for _, m in groups), sum(len(v) * m * (1 - m) for v, m in groups)
        return 1 / min(max((between - one) / (every - one), 1e-4), 0.9) - 1

    k_host = strength([(v, rate) for v in hosts.values()])
    mean = {h: (sum(v) + k_host * rate) / (len(v) + k_host) for h, v in hosts.items()}
    k_path = strength([(v, mean[h]) for (h, _), v in sites.items()])
    logit = lambda p: np.log(p / (1 - p))
    for i, (h, p, s) in own.items():
        host = (sum(hosts[h]) - s + k_host * rate) / (len(hosts[h]) - 1 + k_host)
        path = (sum(sites[h, p]) - s + k_path * host) / (len(sites[h, p]) - 1 + k_path)
        score = 1 / (1 + np.exp(-(logit(min(max(s, 1e-6), 1 - 1e-6)) + 0.5 * (logit(path) - logit(rate)))))
        assert abs(got[i].host_rate - host) < 1e-6 and abs(got[i].path_rate - path) < 1e-6 and abs(got[i].score - score) < 1e-6
        assert got[i].kept == (got[i].score >= 0.5 and got[i].n_words > 0)
    out = quality.classify(edges, labels).collect()
    assert len(out) == len(EDGES) and all(0 <= r.score <= 1 for r in out)
    assert not any(r.kept for r in out if not r.n_words)


def test_bpe(spark, docs, edges):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for df in (docs, edges):
        want = Counter()
        for i, text in df.select("doc_id", "text").collect():
            ids = t.encode(text or "", add_special_tokens=False).ids
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            want[i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
        assert Counter(tuple(r) for r in bpe.encode_digests(df, path).collect()) == want
    back = bpe.decode(bpe.encode(docs, path), path)
    assert {r.doc_id: r.text for r in back.collect()} == texts(docs)


def test_bpe_pieces_against_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), bpe.Encoder(path)
    rng = random.Random(1)
    for alphabet in ("aab", "abcdeé ß\n\t'sthe0123日🙂", "=-_*/ ", "aeinorst ", "ab \x1c\x85　\n."):
        for _ in range(300):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
            assert e.encode(s) == ",".join(map(str, t.encode(s, add_special_tokens=False).ids))


@pytest.mark.parametrize("name", ["simhash", "suffixes", "mixing", "lines", "chains", "rules", "quality", "toxicity", "bpe"])
def test_empty_and_odd_tables(spark, nothing, edges, labels, name):
    run = {
        "simhash": lambda d: simhash.near_duplicates(d),
        "suffixes": suffixes.remove_repeats,
        "mixing": mixing.mixed_documents,
        "lines": lines.dedup_lines,
        "chains": chains.fuzzy_passages,
        "rules": rules.quality_rules,
        "quality": lambda d: quality.classify(d, labels),
        "toxicity": lambda d: toxicity.toxicity(d, labels),
        "bpe": lambda d: bpe.encode_digests(d, public_tokenizers.path("byte_bpe_50k.json")),
    }[name]
    assert run(nothing).count() == 0
    assert len(run(edges).collect()) == len(EDGES)
    assert sorted(i for i, in run(edges).select(F.coalesce("doc_id", F.lit(-1))).collect()) == sorted(-1 if r[0] is None else r[0] for r in EDGES)
