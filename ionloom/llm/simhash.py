"""Near duplicates by SimHash fingerprints, found with BK-trees.

A fingerprint has 64 bits. Fingerprints that differ in at most r bits agree on at least n - r of any
n blocks of bits, so each choice of n - r blocks is a sharding of the corpus in which every linked
pair meets in some shard. A shard is a BK-tree: a node's children are keyed by their integer Hamming
distance to it, and a search that stands at distance d follows only the edges d - r to d + r.
The number of blocks follows from the number of distinct fingerprints, so that the trees stay small
at any size of corpus.

At a radius of 10 bits the tables of blocks grow with the corpus. Where a link also needs a similarity of the
shingles themselves (similar_documents), a shard is a shingle instead: two sets that similar share one of the
first of each under any order of all shingles, so a text has the same number of shards at any size of corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm.anchors import scramble
from ionloom.llm.common import components, discard, join_small, materialize, mixed, release, scratch, text_batches, trim, whole_groups

SEED = 42
#: Nodes of a shard's tree; a larger shard is cut into blocks of this size that are searched pairwise.
TREE_NODES = 4096
#: Pairs of a query and a node that a search takes a level further at once.
FRONTIER = 50_000


def shingles(text: str, words: int) -> list[bytes]:
    """Shingles of a text: A-Z lower-cased, words between ASCII white space, joined by single spaces."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = (ends - np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))).tolist()
    stops = (ends - 1)[min(words, len(parts)) - 1 :].tolist()
    return [joined[a:b] for a, b in zip(starts, stops)]


def piece_hashes(pieces: list[bytes], seed: int = SEED) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(p, seed) for p in pieces], dtype="<u8")


def fingerprint(pieces: list[bytes], seed: int = SEED) -> int:
    """SimHash of shingles; 0 for none. A bit is set if it is in over half the hashes."""
    return simhash(piece_hashes(pieces, seed))


def simhash(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """doc_id and a fingerprint's 64 bits as a long for each seed (fp, fp2) of every whole text; null counts as empty."""
    text_batches(docs.sparkSession)
    names = ["fp", "fp2"][: len(seeds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = (shingles(t or "", words) for t in b.column(1).to_pylist())
            fps = np.array([[fingerprint(p, seed) for seed in seeds] for p in pieces], dtype=np.uint64).reshape(-1, len(seeds))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(fps[:, i].copy().view(np.int64)) for i in range(len(seeds)))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


#: Fingerprints of a signature; each has its own pass in which it must be near.
SIGNATURE = ("fp", "fp2", "fp3")
#: Of one in SAMPLE texts, shingles in SEEN or more are frequent, the COMMON most frequent at most. They come last in the order
#: of all shingles. That spares large shards; whichever shingles are in the list, the links are the same.
SAMPLE, SEEN, COMMON = 32, 8, 20_000


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Hashes of frequent shingles, the most frequent last."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(piece_hashes(shingles(t or "", words))) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found or [np.empty(0, "<u8")]).astype(np.uint64).view(np.int64))], names=["h"])

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "h long")
    top = sample.groupBy("h").count().filter(F.col("count") >= SEEN).orderBy(F.desc("count"), "h").limit(COMMON).select("h").collect()
    return np.array([r.h for r in reversed(top)], dtype=np.int64).view(np.uint64)


def leading(hashes: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """Those of a text's distinct shingles of which a text with the similarity has one among its own: the first under the order
    of all shingles, as many as two such sets can differ in and one more. common: see common_shingles."""
    n = len(hashes)
    if not n:
        return hashes
    rank = np.zeros(n, np.int64)
    if len(common):
        by_hash = np.argsort(common)
        at = np.minimum(np.searchsorted(common, hashes, sorter=by_hash), len(common) - 1)
        rank = np.where(common[by_hash[at]] == hashes, by_hash[at] + 1, 0)
    return hashes[np.lexsort((hashes, rank))[: n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def parities(hashes: np.ndarray) -> bytes:
    """512 bits: whether the number of hashes that fall on each is odd. Two sets differ in as many hashes as bits at least."""
    at = (hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(55)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=512) & 1).tobytes()


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, the fingerprints of SIGNATURE, a 128-bit digest (d1, d2) of the set of shingles, its size n and its parities of
    every whole text."""
    text_batches(docs.sparkSession)
    names = [*SIGNATURE, "d1", "d2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, sizes, odd = [], [], []
            for t in b.column(1).to_pylist():
                pieces = shingles(t or "", words)
                hashes = piece_hashes(pieces)
                distinct = np.unique(hashes)
                sizes.append(len(distinct))
                odd.append(parities(distinct))
                digest = xxhash.xxh3_128_intdigest(distinct.tobytes())
                more = [fingerprint(pieces, SEED + i) for i in range(1, len(SIGNATURE))]
                rows.append((simhash(hashes), *more, digest >> 64, digest & (1 << 64) - 1))
            out = np.array(rows, dtype=np.uint64).reshape(-1, len(names))
            columns = (pa.array(out[:, i].copy().view(np.int64)) for i in range(len(names)))
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(sizes, pa.int64()), pa.array(odd, pa.binary())], names=["doc_id", *names, "n", "odd"])
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", n long, odd binary")


def shared_shingles(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """own (a doc_id), key: the leading shingles that several of docs have. The sets of two texts of the similarity share one."""
    common = common_shingles(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [leading(np.unique(piece_hashes(shingles(t or "", words))), common, similarity) for t in b.column(1).to_pylist()]
            own = np.repeat(b.column(0).to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate(found or [np.empty(0, "<u8")]).astype(np.uint64).view(np.int64))], names=["own", "key"])
        trim()

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key, known = np.empty(0, np.int64), np.empty(0, np.int64), False  # the row that waits for the next, and whether it stays
        for b in batches:
            if not b.num_rows:
                continue
            own, key = (np.concatenate((x, b.column(i).to_numpy())) for i, x in enumerate((own, key)))
            same = key[1:] == key[:-1]
            keep = np.concatenate((same, [False])) | np.concatenate(([known], same))
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][keep[:-1]]) for c in (own, key)], names=["own", "key"])
            own, key, known = own[-1:], key[-1:], bool(keep[-1])
        if known:
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(key)], names=["own", "key"])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "own long, key long").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(several, "own long, key long")


def sharding(n: int, radius: int) -> tuple[int, int]:
    """(blocks, blocks that must agree): the cheapest exact sharding of n fingerprints."""
    best, found = float("inf"), (radius + 1, 1)
    for equal in range(1, 6):
        blocks = radius + equal
        if blocks > 64:
            break
        cost = comb(blocks, equal) * (1 + 0.03 * n / 2.0 ** (64 * equal / blocks))
        if cost < best:
            best, found = cost, (blocks, equal)
    return found


def shard_keys(fp: Column, blocks: int, equal: int, tables: slice = slice(None)) -> Column:
    """An array of (shard table, key): the bits of each choice of `equal` blocks, or of the choices in `tables`."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for t, choice in list(enumerate(combinations(range(blocks), equal)))[tables]:
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in choice)
        mask -= 1 << 64 if mask >> 63 else 0
        out.append(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("key")))
    return F.array(*out)


def forest(codes: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BK-trees over codes, one for each distinct root; root: for each row its tree's first row.

    Returns the edges sorted by key (parent * 65 + distance) and the child at each. All trees grow
    level by level: of the rows that fall on the same edge the first becomes the child, and the
    others go on to it. Equal codes fall on edge 0.
    """
    rest = np.flatnonzero(root != np.arange(len(codes)))
    parent = root[rest]
    keys, children = [], []
    while len(rest):
        key = parent.astype(np.int64) * 65 + np.bitwise_count(codes[rest] ^ codes[parent])
        edge, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        child = rest[first]
        keys.append(edge)
        children.append(child)
        stay = np.ones(len(rest), bool)
        stay[first] = False
        parent = child[inverse][stay]
        rest = rest[stay]
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return key[order], child[order]


def search(codes: np.ndarray, root: np.ndarray, edges: tuple[np.ndarray, np.ndarray], queries: np.ndarray, asked: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query index, row) within radius; each query starts at the root row in `asked`."""
    key, child = edges
    todo = [(np.arange(len(queries)), asked)]
    while todo:
        q, node = todo.pop()
        if len(q) > FRONTIER:  # at a large radius a level may hold most nodes for each query
            todo += [(q[at : at + FRONTIER], node[at : at + FRONTIER]) for at in range(0, len(q), FRONTIER)]
            continue
        d = np.bitwise_count(queries[q] ^ codes[node]).astype(np.int64)
        hit = d <= radius
        yield q[hit], node[hit]
        lo = np.searchsorted(key, node * 65 + np.maximum(d - radius, 0), "left")
        hi = np.searchsorted(key, node * 65 + np.minimum(d + radius, 64), "right")
        n = hi - lo
        some = n > 0
        q, lo, n = q[some], lo[some], n[some]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        if len(at):
            todo.append((np.repeat(q, n), child[at]))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component under the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what (a, b) connect, one for each index but the smallest of its component."""
    label = roots(n, a, b)
    rows = np.flatnonzero(label != np.arange(n))
    return rows, label[rows]


def _linkable(group: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Which rows are in a group of several nodes; a group of one node has nothing to link."""
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    several = np.minimum.reduceat(node, start) != np.maximum.reduceat(node, start)
    return np.repeat(several, np.diff(np.append(start, len(group))))


def _hits(group: np.ndarray, codes: np.ndarray, other: np.ndarray | None, probe: np.ndarray, node: np.ndarray, radius: int, radius2: int, sets: tuple[np.ndarray, np.ndarray, float] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different nodes within the radii, some of them twice. sets: sizes, parities and a similarity; pairs that
    can't have it by these are left out."""
    n = len(codes)
    if not n:
        return
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    first = np.repeat(start, np.diff(np.append(start, n)))  # a group's tree rows come first
    in_tree = np.flatnonzero(~probe)
    place = np.full(n, -1)
    place[in_tree] = np.arange(len(in_tree))
    has_tree = ~probe[first]
    codes_t = codes[in_tree]
    edges = forest(codes_t, place[first[in_tree]])
    blocks_with_probes = np.zeros(n, bool)
    blocks_with_probes[first[probe]] = True
    ask = np.flatnonzero(has_tree & (probe | ~blocks_with_probes[first]))
    for at in range(0, len(ask), 8_000):
        asked = ask[at : at + 8_000]
        for q, found in search(codes_t, first, edges, codes[asked], place[first[asked]], radius):
            a, b = asked[q], in_tree[found]
            keep = node[a] != node[b]
            if other is not None:
                keep &= np.bitwise_count(other[a] ^ other[b]) <= radius2
            a, b = a[keep], b[keep]
            if sets is not None:
                size, odd, similarity = sets
                apart = np.bitwise_count(odd[a] ^ odd[b]).sum(1, dtype=np.int64)
                keep = apart <= (1 - similarity) / (1 + similarity) * (size[a] + size[b]) + 1e-6
                a, b = a[keep], b[keep]
            yield a, b


def _links_of(group: np.ndarray, codes: np.ndarray, other: np.ndarray | None, probe: np.ndarray, node: np.ndarray, radius: int, radius2: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes (node, smallest node of its component in these shards) for nodes that have a link to another."""
    use = _linkable(group, node)
    group, codes, probe, node = group[use], codes[use], probe[use], node[use]
    other = other[use] if other is not None else None
    names, place_of = np.unique(node, return_inverse=True)
    left, right, held = [], [], 0
    for a, b in _hits(group, codes, other, probe, node, radius, radius2):
        left.append(place_of[a])
        right.append(place_of[b])
        held += len(a)
        if held > 1_000_000:
            a, b = spanning(len(names), np.concatenate(left), np.concatenate(right))
            left, right, held = [a], [b], 0
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = spanning(len(names), np.concatenate(left), np.concatenate(right))
    return names[a], names[b]


def _pairs_of(group: np.ndarray, codes: np.ndarray, other: np.ndarray | None, probe: np.ndarray, node: np.ndarray, own: np.ndarray, radius: int, radius2: int, rank: np.ndarray | None, sets: tuple[np.ndarray, np.ndarray, float] | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of codes of different nodes as (own, own, node, node); with `rank` only each code's pair with the one of least rank that it meets."""
    lowest = rank is not None
    rank = own if rank is None else rank
    use = _linkable(group, node)
    group, codes, probe, node, own, rank = group[use], codes[use], probe[use], node[use], own[use], rank[use]
    other = other[use] if other is not None else None
    sets = (sets[0][use], sets[1][use], sets[2]) if sets is not None else None
    best = np.full(len(own), -1)
    left, right, held = [], [], 0
    for a, b in _hits(group, codes, other, probe, node, radius, radius2, sets):
        a, b = np.where(rank[a] > rank[b], a, b), np.where(rank[a] > rank[b], b, a)
        if lowest:
            order = np.lexsort((rank[b], a))
            a, b = a[order], b[order]
            head = np.concatenate(([True], a[1:] != a[:-1]))[: len(a)]
            a, b = a[head], b[head]
            better = (best[a] < 0) | (rank[b] < rank[best[a]])
            best[a[better]] = b[better]
            continue
        left.append(a)
        right.append(b)
        held += len(a)
        if held > 200_000:
            a, b = np.concatenate(left), np.concatenate(right)
            yield own[a], own[b], node[a], node[b]
            left, right, held = [], [], 0
    if lowest:
        left, right = [np.flatnonzero(best >= 0)], [best[best >= 0]]
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        yield own[a], own[b], node[a], node[b]


def links(codes: DataFrame, radius: int, radius2: int | None = None, tree_nodes: int = TREE_NODES, part: str = "all", pairs: str | None = None, shards: DataFrame | None = None, similarity: float = 0.0) -> DataFrame:
    """Edges (u, v) between nodes that connect what is connected by pairs of codes within radius bits.

    codes: node long, fp long, and with radius2 also fp2 long, a second fingerprint in which a pair
    may differ by radius2 bits at most. Codes of one node count as linked, so a shard that holds one
    node is not searched. Shards answer with one edge for each linked node, never with all their
    pairs. part: "first" takes the shards that hold to the first block, "rest" the others.

    pairs: "all" gives the pairs of codes of different nodes themselves, as (u, v, un, vn): the codes' own
    ids (column `own` of codes) and their nodes, repeated where they meet again; "lowest" only those of a code with the smallest
    code that it meets in a shard; "spread" those with one that each shard puts first by a hash of its own.
    shards (with pairs): rows (own, key) that say in which shards a code stands, instead of its blocks of bits; codes then has n and odd
    (see signatures), and pairs that can't have the similarity by these are left out.
    """
    spark = codes.sparkSession
    more = ([] if radius2 is None else ["fp2"]) + ["own"] * bool(pairs) + ["n", "odd"] * (shards is not None)
    if shards is None:
        blocks, equal = sharding(codes.count(), radius)
        ahead = comb(blocks - 1, equal - 1)
        tables = {"all": slice(None), "first": slice(ahead), "rest": slice(ahead, None)}[part]
        keyed = codes.select("node", "fp", *more, F.explode(shard_keys(F.col("fp"), blocks, equal, tables)).alias("s")).select("node", "fp", *more, "s.t", "s.key")
    else:
        met = codes.withColumn("k", mixed(F.col("own"))).join(shards.select(mixed(F.col("own")).alias("k"), "key"), "k")
        keyed = met.select("node", "fp", *more, F.lit(0).alias("t"), "key")
        # a shard of one node has nothing to link
        several = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select(mixed(F.col("key")).alias("k"))
        keyed = materialize(keyed.withColumn("k", mixed(F.col("key"))).join(several, "k", "left_semi").drop("k"))
    large = keyed.groupBy("t", "key").agg(F.count("*").alias("n"), (F.min("node") == F.max("node")).alias("one")).filter(F.col("n") > tree_nodes)
    heavy = materialize(large.select("t", "key", "one", F.ceil(F.col("n") / (tree_nodes // 2)).cast("int").alias("k")))
    if heavy.isEmpty():
        keyed = keyed.select("*", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(False).alias("probe"))
    else:
        keyed = join_small(keyed, heavy, ["t", "key"]).filter(~F.coalesce("one", F.lit(False)))
        home = F.coalesce(F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")), F.lit(0)).cast("int")
        top = F.coalesce(F.col("k") - 1, F.lit(0))
        as_tree = F.transform(F.sequence(F.lit(0), F.col("h")), lambda a: F.struct(a.alias("a"), F.col("h").alias("b"), F.lit(False).alias("probe")))
        as_probe = F.when(F.col("h") < F.col("top"), F.transform(F.sequence(F.col("h") + 1, F.col("top")), lambda b: F.struct(F.col("h").alias("a"), b.alias("b"), F.lit(True).alias("probe")))).otherwise(F.array().cast("array<struct<a:int,b:int,probe:boolean>>"))
        keyed = keyed.withColumn("h", home).withColumn("top", top).withColumn("x", F.explode(F.concat(as_tree, as_probe))).select("node", "fp", *more, "t", "key", "x.a", "x.b", "x.probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["t", "key", "a", "b"], 50_000):
            col = {c: table.column(c).to_numpy() for c in ("node", "fp", *more, "t", "key", "a", "b") if c != "odd"}
            sets = (col["n"], np.frombuffer(b"".join(table.column("odd").to_pylist()), np.uint64).reshape(-1, 8), similarity) if "odd" in more else None
            changes = np.zeros(table.num_rows, bool)
            for c in ("t", "key", "a", "b"):
                changes[1:] |= col[c][1:] != col[c][:-1]
            probe = table.column("probe").to_numpy(zero_copy_only=False).astype(bool)
            given = np.cumsum(changes), col["fp"].view(np.uint64), col["fp2"].view(np.uint64) if "fp2" in col else None, probe, col["node"]
            if pairs:
                rank = {"lowest": col["own"], "spread": scramble(scramble(col["own"].view(np.uint64)) ^ scramble(col["key"].view(np.uint64) + col["t"].astype(np.uint64))), "all": None}[pairs]
                for met in _pairs_of(*given, col["own"], radius, radius2 or 0, rank, sets):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in met], names=["u", "v", "un", "vn"])
                continue
            u, v = _links_of(*given, radius, radius2 or 0)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        trim()

    dealt = keyed.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b", "probe")
    return dealt.mapInArrow(run, "u long, v long, un long, vn long" if pairs else "u long, v long")


def resemblance(a: set[bytes], b: set[bytes]) -> float:
    """Jaccard similarity; two empty sets are equal."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def similar_pairs(docs: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """u and v (the nodes un and vn) of those pairs (u, v, un, vn) whose texts' sets of shingles have `similarity` at least."""
    asked = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    texts = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked, "doc_id", "left_semi"))
    side = lambda c: texts.select(mixed(F.col("doc_id")).alias(f"k{c}"), F.col("text").alias(c))
    met = pairs.withColumn("ka", mixed(F.col("u"))).join(side("a"), "ka").withColumn("kb", mixed(F.col("v"))).join(side("b"), "kb").select("un", "vn", "a", "b")
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [resemblance(set(shingles(a or "", words)), set(shingles(b or "", words))) >= similarity for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))
        trim()

    out = materialize(met.mapInArrow(run, "u long, v long"))
    discard(texts)
    return out


def similar_documents(docs: DataFrame, words: int = 5, radius: int = 10, radius2: int = 14, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable by links, itself included) of every row.

    Candidates are the pairs that are within radius in one of three fingerprints and within radius2 in a second
    one: by one fingerprint alone four in ten pairs at a similarity of 0.8 would be missed. A pair is linked if its texts' sets of
    shingles have a Jaccard similarity of `similarity` at least, counted on the shingles themselves. Texts
    with equal sets are linked whatever their fingerprints. docs: doc_id (unique and not null), text. Shards are
    shared_shingles. A first pass holds each text against the smallest that it meets, a second one against one text of each
    shard's choice, as the smallest may be no near copy of the others; so most of a group of near copies is one node
    before all its pairs are asked for.
    """
    spark = docs.sparkSession
    own = [*SIGNATURE, "d1", "d2"]
    marks = materialize(signatures(docs, words))
    codes = materialize(marks.groupBy(*own).agg(F.min("doc_id").alias("own"), F.min("n").alias("n"), F.min("odd").alias("odd")).withColumn("node", F.min("own").over(Window.partitionBy("d1", "d2"))))
    firsts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(codes.select(F.col("own").alias("doc_id")), "doc_id", "left_semi")
    shards = materialize(shared_shingles(firsts, words, similarity))
    held = None  # pairs that were held against each other, similar or not
    for fps, which in ((SIGNATURE[:1], "lowest"), (SIGNATURE[:1], "spread"), (SIGNATURE, "all")):
        pairs = None
        for by in fps:
            other = SIGNATURE[1] if by == SIGNATURE[0] else SIGNATURE[0]
            with scratch() as spent:
                near = links(codes.select("own", "node", F.col(by).alias("fp"), F.col(other).alias("fp2"), "n", "odd"), radius, radius2, pairs=which, shards=shards, similarity=similarity)
            turned = F.col("u") > F.col("v")
            near = materialize(near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.when(turned, F.col("un")).otherwise(F.col("vn")).alias("un"), F.when(turned, F.col("vn")).otherwise(F.col("un")).alias("vn")).distinct())
            for table in spent:  # the shards with their codes, larger than all else here
                discard(table)
            release(spark)
            pairs = near if pairs is None else pairs.unionByName(near).distinct()
        pairs = materialize(pairs if held is None else pairs.join(held, ["u", "v"], "left_anti"))
        held = pairs.select("u", "v") if held is None else held.unionByName(pairs.select("u", "v"))
        found = components(similar_pairs(docs, pairs, words, similarity)).select(mixed(F.col("u")).alias("k"), "component")
        before, codes = codes, materialize(codes.withColumn("k", mixed(F.col("node"))).join(found, "k", "left").select(*own, "own", "n", "odd", F.coalesce("component", "node").alias("node")))
        discard(before)
        release(spark)
    return marks.join(codes.withColumnRenamed("node", "component_id"), own).select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 10, radius2: int | None = 14) -> DataFrame:
    """doc_id, fp (with radius2 also fp2) and component_id (the smallest doc_id reachable by links, itself included) of every row.

    Texts are linked if their fingerprints differ in radius bits at most. At a large radius unrelated texts
    meet by chance and near copies miss each other by chance, so with radius2 there are two fingerprints from
    different hashes, of which one must differ in radius bits at most, whichever, and the other in radius2.
    docs: doc_id, text; other columns are ignored. A null or empty text has the fingerprint 0 and links as
    any other. A row with a null doc_id shares the component of the documents with its fingerprint; without
    such its component is null. Repeated rows come back as often as they came. An empty table gives an empty
    result.
    """
    own = ["fp"] if radius2 is None else ["fp", "fp2"]
    fps = materialize(fingerprints(docs, words, (SEED,) if radius2 is None else (SEED, SEED + 1)))
    codes = materialize(fps.groupBy(*own).agg(F.min("doc_id").alias("node")).filter("node is not null"))
    # What one pass connects is one node in the next, which has to find only what is still apart.
    passes = [("fp", "first"), ("fp", "rest")] + [("fp2", "all")] * (radius2 is not None)
    for by, part in passes:
        turned = codes if by == "fp" else codes.select("node", F.col("fp2").alias("fp"), F.col("fp").alias("fp2"))
        found = components(links(turned, radius, radius2, part=part)).select(mixed(F.col("u")).alias("k"), "component")
        codes = materialize(codes.withColumn("k", mixed(F.col("node"))).join(found, "k", "left").select(*own, F.coalesce("component", "node").alias("node")))
        release(docs.sparkSession)
    return fps.join(codes.withColumnRenamed("node", "component_id"), own, "left").select("doc_id", *own, "component_id")
