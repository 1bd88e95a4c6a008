"""The pipeline's stages, one by one, against brute-force versions of their decisions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from ionloom.llm import lines, quality, simhash
from ionloom.llm.common import materialize
from ionloom.llm.queries import TOKENIZER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(p.COLUMNS)
    out = [docs]
    for _, stage in p.STAGES:
        out.append(materialize(stage(spark, out[-1], SF)))
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def survivors(text):
    """The first of each group of texts that are near in two of three fingerprints and similar in their shingles."""
    fps = {i: [simhash.fingerprint(simhash.shingles(t, p.WORDS), s) for s in (42, 43, 44)] for i, t in text.items()}
    sets = {i: {*simhash.shingles(t, p.WORDS)} for i, t in text.items()}
    group = {i: i for i in text}
    for i in sorted(text):
        for j in sorted(text):
            d = [(x ^ y).bit_count() for x, y in zip(fps[i], fps[j])]
            met = any(d[a] <= p.RADIUS and d[b] <= p.RADIUS2 for a, b in ((0, 1), (1, 0), (2, 0)))
            if i < j and (met or sets[i] == sets[j]) and simhash.resemblance(sets[i], sets[j]) >= p.SIMILARITY:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    return {i for i, g in group.items() if i == g}


def test_stages(spark, outputs):
    docs, good, cut, single, mixed, encoded = outputs
    assert all(o.columns == p.COLUMNS for o in outputs[:-1])
    kept = {r.doc_id for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept").collect()}
    assert {*by_id(good)} == kept

    seen, want = {}, {}
    for i, r in sorted(by_id(good).items()):
        left = [c[0] for k, c in enumerate(lines.chunks(r.text)) if not lines.looked_up(c) or seen.setdefault(c[0], (i, k)) == (i, k)]
        if b"".join(left).split():
            want[i] = b"\n".join(left).decode()
    assert {i: r.text for i, r in by_id(cut).items()} == want

    assert {*by_id(single)} == survivors(want)

    times = Counter(r.doc_id for r in mixed.collect())
    rows = by_id(single)
    size = {i: len(r.text.encode().split()) for i, r in rows.items()}
    assert max(times.values()) <= 3 and {*times} <= {*rows}
    assert abs(sum(size[i] * n for i, n in times.items()) / sum(size.values()) - 1) < 0.1

    t = Tokenizer.from_file(TOKENIZER)
    got = Counter((r.doc_id, r.n_tokens) for r in encoded.collect())
    assert got == Counter((r.doc_id, len(t.encode(r.text, add_special_tokens=False).ids)) for r in mixed.collect())


def test_run(spark, outputs):
    assert Counter(map(tuple, p.run(spark, SF).collect())) == Counter(map(tuple, outputs[-1].collect()))


def test_near_copies_have_the_similarity(spark):
    base = [f"w{i}" for i in range(400)]
    far = [*base]
    for i in range(0, 400, 24):  # 17 edits: similarity 0.66
        far[i] = f"x{i}"
    near = [*base]
    near[200] = "y"
    rows = {1: base, 2: far, 3: near, 4: [*base], 5: ["z"] * 300 + base[:40], 6: ["z"] * 300 + base[300:340]}  # 5 and 6: one shingle outweighs all others
    text = {i: " ".join(t) for i, t in rows.items()}
    fps = {i: [simhash.fingerprint(simhash.shingles(t, p.WORDS), s) for s in (42, 43)] for i, t in text.items()}
    for a, b in ((1, 2), (5, 6)):
        low, high = sorted((x ^ y).bit_count() for x, y in zip(fps[a], fps[b]))
        assert low <= p.RADIUS and high <= p.RADIUS2  # the fingerprints alone would link them
        assert simhash.resemblance({*simhash.shingles(text[a], p.WORDS)}, {*simhash.shingles(text[b], p.WORDS)}) < 0.8
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in text.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.simhash_near_dedup(spark, docs, SF).collect()) == [1, 2, 5, 6]


def test_near_copies_at_the_nominal_similarity():
    """On random shingle sets with a similarity of 0.8 the rule of three fingerprints makes candidates of nine in ten pairs."""
    import numpy as np

    rng = np.random.default_rng(5)
    met = 0
    for _ in range(400):
        n = 300
        shared, rest = (rng.integers(0, 1 << 64, size, dtype=np.uint64) for size in ((3, n * 8 // 9), (2, 3, n // 9)))
        d = []
        for s in range(3):
            a, b = (simhash.simhash(np.concatenate([shared[s], rest[k, s]])) for k in range(2))
            d.append((a ^ b).bit_count())
        met += any(d[a] <= p.RADIUS and d[b] <= p.RADIUS2 for a, b in ((0, 1), (1, 0), (2, 0)))
    assert met >= 0.88 * 400


def test_shards_of_similar_sets():
    """Sets with the similarity share a leading shingle, whichever are frequent; a text's shards don't depend on the corpus."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 9, 45, 90, 333):
        for _ in range(40):
            union = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            both = int(np.ceil(0.8 * n - 1e-9))
            only = int(rng.integers(0, n - both + 1))
            mixed = rng.permutation(union)
            a, b = np.sort(mixed[: both + only]), np.sort(np.concatenate([mixed[:both], mixed[both + only :]]))
            common = rng.permutation(union)[: n // 2]
            heads = [simhash.leading(x, common, 0.8) for x in (a, b)]
            assert {*heads[0]} & {*heads[1]}
            assert len(heads[0]) <= 0.2 * len(a) + 1
            apart = np.bitwise_count(np.bitwise_xor(*(np.frombuffer(simhash.parities(x), np.uint8) for x in (a, b)))).sum()
            assert apart <= n - both


def test_large_group_makes_few_candidates(spark, monkeypatch):
    """Texts that differ in a bit or two of their fingerprints but are under 0.8 similar are not held against each other."""
    base = [f"w{i}" for i in range(30)]
    texts = [" ".join([*(["z"] * 400), *base, *(f"{n}-{i}" for i in range(30))]) for n in range(60)]
    held = []
    plain = simhash.similar_pairs
    monkeypatch.setattr(simhash, "similar_pairs", lambda docs, pairs, *a: held.append(pairs.count()) or plain(docs, pairs, *a))
    out = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), p.WORDS, p.RADIUS, p.RADIUS2, p.SIMILARITY).collect()
    assert all(r.doc_id == r.component_id for r in out)
    assert sum(held) < 60


def test_tables_of_earlier_stages_go(spark):
    """What a stage wrote for itself is deleted when the next begins, but for what that reads."""
    from pathlib import Path

    folder = lambda t: Path(t._ionloom_path.removeprefix("file:"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(p.COLUMNS)
    first = materialize(p.quality_classifier(spark, docs, SF))
    own = [*p._left]
    assert own and all(folder(t).exists() for t in own)
    lazy = p.line_dedup(spark, first, SF)
    assert not any(folder(t).exists() for t in own)
    second = p.simhash_near_dedup(spark, lazy, SF)
    assert first.count() >= lazy.count() >= second.count() > 0


def test_shards_of_one_pass_go_before_the_next(spark, monkeypatch):
    """The shards with their codes are the largest tables of near copies: at most one pass's are there at a time."""
    from pathlib import Path

    made = []
    plain = simhash.materialize

    def materialized(df, *a):
        there = [t for t in made if Path(t._ionloom_path.removeprefix("file:")).exists()]
        assert "odd" not in df.columns or "key" not in df.columns or not there
        out = plain(df, *a)
        if "odd" in df.columns and "key" in df.columns:
            made.append(out)
        return out

    monkeypatch.setattr(simhash, "materialize", materialized)
    texts = [" ".join([f"{n // 3}-{i}" for i in range(60)] + ["x"] * (n % 3)) for n in range(12)]
    out = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), p.WORDS, p.RADIUS, p.RADIUS2, p.SIMILARITY).collect()
    assert len(made) == 5 and len(out) == 12


def test_mixing_ships_texts_twice(spark):
    """Texts are dealt to meet their draws and to their shards, and for nothing else; equal rows come as often as each is drawn."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(p.COLUMNS)
    out = p.source_mixing(spark, docs, SF)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(p.COLUMNS).filter("false")
    for _, stage in p.STAGES:
        docs = materialize(stage(spark, docs, SF))
        assert docs.count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(p.COLUMNS)
    odd = materialize(docs.withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.floor(F.col("doc_id") / 2)).cast("long")))
    judged = quality.classify(odd, spark.read.parquet(f"{SF}/labels.parquet")).filter("kept")
    want = Counter(r.doc_id for r in judged.collect())
    assert want[None] and Counter(r.doc_id for r in p.quality_classifier(spark, odd, SF).collect()) == want

    text = lambda k: " ".join(f"{k}-{i}" for i in range(60))
    given = [(7, text("p")), (7, text("q")), (8, text("q")), (None, text("r")), (None, text("s")), (None, text("p"))]
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in given], docs.schema)
    got = sorted(((r.doc_id or 0, r.text[0]) for r in p.simhash_near_dedup(spark, df, SF).collect()))
    assert got == [(0, "r"), (0, "s"), (7, "p"), (7, "q")]

    # source c is small against its weight: each row comes three times
    rare = [(7, text("p")), (7, text("q")), (7, text("q")), (None, text("r")), (None, text("s"))]
    rows = [(i, t, "en", "c", len(t)) for i, t in rare] + [(100 + i, text(i), "en", "ab"[i % 2], 0) for i in range(60)]
    out = p.source_mixing(spark, spark.createDataFrame(rows, docs.schema), SF).filter("source = 'c'").collect()
    assert Counter((r.doc_id, r.text[0]) for r in out) == {(7, "p"): 3, (7, "q"): 6, (None, "r"): 3, (None, "s"): 3}
