"""Removal of repeated byte strings by a hash-compared suffix sort.

Windows of WIDTH bytes that repeat share an anchor (see anchors), so only anchors whose hash occurs twice
are looked at. An anchor with the bytes of all its windows is a context. A context that stands earlier
repeats whole; contexts that share an anchor but differ are sorted twice, by what follows the anchor and
by what precedes it. The sort is a mergesort that compares suffixes by their common extension, found by
binary search over prefix polynomial hashes. Its neighbours' common extensions then say, for every offset
of a window from the anchor, which contexts' windows are equal; equal windows are compared by bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm.anchors import anchors, powers, prefix_hashes
from ionloom.llm.common import discard, materialize, mixed, release, text_batches, trim, whole_groups
from ionloom.llm.units import unit_columns

WIDTH = 100
#: Differing contexts of one anchor that are sorted in one task. Those of a more frequent anchor are split: they are
#: compared by grouped bytes, which any number of tasks share, first by pieces of PIECE windows, then the
#: windows of the pieces that may differ in part. Both ways give the same spans.
GROUP, PIECE = 1000, 10
#: Contexts of whole groups that are sorted at once, and windows whose bytes are compared at once: they bound a worker's arrays.
BATCH, COMPARED = 5_000, 10_000


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Lengths up to limit for which the strings at a and b agree, by binary search over prefix hashes."""
    _, inverse = powers(len(prefix))
    low, high = np.zeros(len(a), np.int64), limit.copy()
    ia, ib, pa_, pb = inverse[a], inverse[b], prefix[a], prefix[b]
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        same = (prefix[a + mid] - pa_) * ia == (prefix[b + mid] - pb) * ib
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)


def suffix_sort(raw: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the strings raw[start:start+size] within each group (sorted labels) by a bottom-up mergesort.

    Returns the order and the common extension of each with the one before it (-1 at a group's first).
    All merges of a level happen at once: each string's rank in the neighbouring run is found by binary
    search, so a level takes log(run) comparisons of log(size) steps each.
    """
    prefix = prefix_hashes(raw)
    padded = np.append(raw, 0)
    n = len(start)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.empty(0, np.int64)
    counts = np.diff(np.append(first, n))
    base, count = np.repeat(first, counts), np.repeat(counts, counts)
    order = np.arange(n)

    def extension(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return common_extension(prefix, start[a], start[b], np.minimum(size[a], size[b]))

    def below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as string a is less than, equal to or greater than b."""
        e = extension(a, b)
        ended = e >= np.minimum(size[a], size[b])
        last = np.sign(padded[start[a] + e].astype(np.int64) - padded[start[b] + e])
        return np.where(ended, np.sign(size[a] - size[b]), last)

    run = 1
    while n and run < counts.max():
        local = np.arange(n) - base
        block = local // run
        other = (block ^ 1) * run  # local start of the neighbouring run
        size_of = np.minimum(run, count - other)
        at = np.flatnonzero(size_of > 0)
        low, high = np.zeros(len(at), np.int64), size_of[at].copy()
        left = (block[at] & 1) == 0
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            sign = below(order[at[open_]], order[base[at[open_]] + other[at[open_]] + mid])
            # a string of the left run stands before its equals in the right run
            go_right = (sign > 0) | ((sign == 0) & ~left[open_])
            low[open_] = np.where(go_right, mid + 1, low[open_])
            high[open_] = np.where(go_right, high[open_], mid)
        place = np.arange(n)
        place[at] = base[at] + (block[at] >> 1) * 2 * run + (local[at] - block[at] * run) + low
        new = np.empty(n, np.int64)
        new[place] = order
        order, run = new, run * 2
    common = np.full(n, -1, np.int64)
    inner = np.flatnonzero(np.arange(n) != base)
    common[inner] = extension(order[inner - 1], order[inner])
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < least)
    return out


def repeated_windows(contexts: list[bytes], anchor: np.ndarray, n_windows: np.ndarray, group: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For contexts in the order of where they stand, by group: whether each window repeats an earlier one's
    bytes, as a matrix (context, window). anchor: the anchor's offset in its context."""
    n = len(contexts)
    sizes = np.fromiter(map(len, contexts), np.int64, n)
    base = np.concatenate(([0], np.cumsum(sizes)[:-1])) if n else np.empty(0, np.int64)
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    back = np.frombuffer(b"".join(c[::-1] for c in contexts), np.uint8)
    right = suffix_sort(raw, base + anchor, sizes - anchor, group)
    left = suffix_sort(back, base + sizes - anchor, anchor, group)
    out = np.zeros((n, int(n_windows.max()) if n else 0), bool)
    for offset in range(int(anchor.max()) + 1 if n else 0):  # of the anchor in a window
        window = anchor - offset
        has = np.flatnonzero((window >= 0) & (window < n_windows))
        if not len(has):
            continue
        key = _classes(*right, width - offset)[has] << 32 | _classes(*left, offset)[has]
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        repeats = np.flatnonzero(first[inverse] != np.arange(len(has)))
        if not len(repeats):
            continue
        a, b = has[repeats], has[first[inverse[repeats]]]
        for at in range(0, len(a), COMPARED):  # equal hashes are no proof
            x, y = a[at : at + COMPARED], b[at : at + COMPARED]
            span = np.arange(width)
            same = (raw[(base[x] + window[x])[:, None] + span] == raw[(base[y] + window[y])[:, None] + span]).all(1)
            out[x[same], window[x[same]]] = True
            # a class of unequal windows is gone through one by one
            for c in np.unique(inverse[repeats[at : at + COMPARED][~same]]):
                seen: set[bytes] = set()
                for k in has[inverse == c]:
                    w = contexts[k][window[k] : window[k] + width]
                    out[k, window[k]] = w in seen
                    seen.add(w)
    return out


def _halves(x: int) -> tuple[int, int]:
    """A 128-bit hash as two signed longs."""
    return tuple(h - (1 << 64) if h >> 63 else h for h in (x >> 64, x & ((1 << 64) - 1)))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _place() -> Column:
    """The order that documents and places in them stand in."""
    return F.struct((F.col("sub") < 0).alias("none"), "k", "sub", "q")


def _with_text(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs (k, sub, text) joined with rows gathered by document in the column `asked`."""
    return docs.join(rows, ["k", "sub"], how).select("k", "sub", "text", "asked")


def repeated_spans(docs: DataFrame, width: int = WIDTH, repeated: bool = True) -> DataFrame:
    """k, sub, q, n: runs of n windows that start at byte q and each repeat an earlier window. docs: k, sub, text; see units.
    repeated: whether a document may stand in several rows."""
    text_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for k, sub, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw = np.frombuffer(_bytes(text), np.uint8)
                if len(raw) >= width:
                    pos, h, _, _ = anchors(raw, width)
                    for column, v in zip(out, (h, np.full(len(h), k), (sub << 32) | pos)):
                        column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["h", "k", "sp"])
        trim()

    found = materialize(docs.mapInArrow(find, "h long, k long, sp long"))
    twice = found.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select(mixed(F.col("h")).alias("x"))
    hits = found.select(mixed(F.col("h")).alias("x"), "k", "sp").join(twice, "x")
    hits = hits.groupBy("k", F.shiftright("sp", 32).cast("int").alias("sub")).agg(F.collect_list(F.col("sp").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("asked"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for k, sub, text, asked in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = _bytes(text)
                pos, h, q, n = anchors(np.frombuffer(raw, np.uint8), width)
                hit = np.isin(pos, np.array(asked, dtype=np.int64))
                for at, first, count, anchor in zip(h[hit].tolist(), q[hit].tolist(), n[hit].tolist(), (pos - q)[hit].tolist()):
                    c = xxhash.xxh3_128_intdigest(raw[first : first + count + width - 1])
                    for column, v in zip(out, (*_halves(c), at, k, sub, first, count << 8 | anchor)):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), *(pa.array(c, pa.int32()) for c in out[4:])], names=["c1", "c2", "h", "k", "sub", "q", "na"])
        trim()

    placed = materialize(_with_text(docs, hits, "inner").mapInArrow(contexts, "c1 long, c2 long, h long, k long, sub int, q int, na int"))
    discard(found)
    release(docs.sparkSession)

    # contexts that stand earlier, whole
    first = placed.groupBy("c1", "c2").agg(F.min(_place()).alias("f"), F.min_by(F.struct("h", "na"), _place()).alias("a"), F.count("*").alias("c"))
    first = materialize(first)
    whole = materialize(_later(placed.withColumn("n", F.shiftright("na", 8)), first, "c1", "c2"))
    discard(placed)
    release(docs.sparkSession)

    # contexts that differ but share an anchor
    heads = first.select("f.k", "f.sub", "f.q", "a.h", "a.na")
    several = heads.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select(mixed(F.col("h")).alias("x"), "c")
    edges = heads.withColumn("x", mixed(F.col("h"))).join(several, "x").groupBy("k", "sub").agg(F.collect_list(F.struct("h", "q", "na", "c")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for k, sub, text, asked in zip(*(b.column(i).to_pylist() for i in range(4))):
                raw = _bytes(text)
                for x in asked:
                    for column, v in zip(out, (x["h"], k, sub, x["q"], x["na"], x["c"], raw[x["q"] : x["q"] + (x["na"] >> 8) + width - 1])):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["h", "k", "sub", "q", "na", "c", "bytes"])
        trim()

    edges = _with_text(docs, edges, "inner").mapInArrow(cut, "h long, k long, sub int, q int, na int, c long, bytes binary")
    edges = materialize(edges.dropDuplicates(["h", "k", "sub", "q"]) if repeated else edges)
    discard(first)
    release(docs.sparkSession)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["h"], BATCH):
            h, k, sub, q, na = (table.column(c).to_numpy() for c in ("h", "k", "sub", "q", "na"))
            n = (na >> 8).astype(np.int64)
            again = repeated_windows(table.column("bytes").to_pylist(), (na & 255).astype(np.int64), n, h, width)
            edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, begin = np.nonzero(edge == 1)
            _, end = np.nonzero(edge == -1)
            yield pa.RecordBatch.from_arrays([pa.array(k[row]), pa.array(sub[row]), pa.array((q[row] + begin).astype(np.int32)), pa.array((end - begin).astype(np.int32))], names=["k", "sub", "q", "n"])
            trim()

    few = edges.filter(F.col("c") <= GROUP).select("h", "k", "sub", "q", "na", "bytes")
    sorted_ = few.repartition("h").sortWithinPartitions("h", F.col("sub") < 0, "k", "sub", "q").mapInArrow(resolve, "k long, sub int, q int, n int")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of a context by PIECE offsets from the anchor: what they cover (`whole`, with the piece's number at
        its head, as windows of a piece stand alike about the anchor) and what all of them share."""
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for k, sub, q, na, raw in zip(*(b.column(i).to_pylist() for i in range(5))):
                n, anchor = na >> 8, na & 255
                for piece in range(max(anchor - n + 1, 0) // PIECE, anchor // PIECE + 1):
                    low, high = piece * PIECE, piece * PIECE + PIECE - 1  # offsets of the anchor in the piece's windows
                    begin, end = max(anchor - high, 0), min(anchor - low, n - 1)
                    if begin > end:
                        continue
                    tag = bytes([piece])
                    for column, v in zip(out, (k, sub, q + begin, end - begin + 1, tag + raw[begin : end + width], tag + raw[anchor - low : anchor - high + width])):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["k", "sub", "q", "n", "whole", "shared"])

    cut_up = materialize(edges.filter(F.col("c") > GROUP).select("k", "sub", "q", "na", "bytes").mapInArrow(pieces, "k long, sub int, q int, n int, whole binary, shared binary"))
    heads = materialize(cut_up.groupBy("whole").agg(F.min(_place()).alias("f"), F.min("n").alias("n"), F.min("shared").alias("shared"), F.count("*").alias("c")))
    part = _later(cut_up, heads, "whole")
    shared = heads.groupBy("shared").agg(F.count("*").alias("m")).filter("m > 1").select(F.xxhash64("shared", F.lit(1)).alias("x"), "shared")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for k, sub, q, n, raw in zip(*(b.column(i).to_pylist() for i in range(5))):
                for at in range(n):
                    for column, v in zip(out, (k, sub, q + at, raw[1 + at : 1 + at + width])):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["k", "sub", "q", "w"])

    many = heads.withColumn("x", F.xxhash64("shared", F.lit(1))).join(shared, ["x", "shared"]).select("f.k", "f.sub", "f.q", "n", "whole").mapInArrow(windows, "k long, sub int, q int, w binary").withColumn("n", F.lit(1))
    many = materialize(many)
    single = _later(many, many.groupBy("w").agg(F.min(_place()).alias("f"), F.count("*").alias("c")), "w")
    return whole.unionByName(sorted_).unionByName(part).unionByName(single)


def _later(rows: DataFrame, first: DataFrame, *keys: str) -> DataFrame:
    """k, sub, q, n of the rows that are not the first with their keys. first: the keys, f (the first's place) and count c."""
    x = F.xxhash64(*keys, F.lit(2)).alias("x")
    first = first.filter("c > 1").select(x, *keys, F.col("f.k").alias("fk"), F.col("f.sub").alias("fsub"), F.col("f.q").alias("fq"))
    return rows.select("*", x).join(first, ["x", *keys]).filter("k <> fk or sub <> fsub or q <> fq").select("k", "sub", "q", "n")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) of every row.

    Removed is each byte covered by `width` bytes that also start earlier, in a smaller doc_id or further up
    in the text. docs: doc_id, text; other columns are ignored. Null and empty texts have no bytes. Documents
    without an id come last. Rows that repeat a doc_id and its text are one document and keep the same bytes; rows that
    share an id but not the text are two, in the order of a hash (see units). Texts of any length are taken
    whole. An empty table gives an empty result.
    """
    base, rows, repeated = unit_columns(docs)
    spans = repeated_spans(base, width, repeated).groupBy("k", "sub").agg(F.collect_list(F.struct("q", "n")).alias("asked"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text, asked in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = np.frombuffer(_bytes(text), np.uint8)
                depth = np.zeros(len(raw) + 1, np.int64)
                if asked:
                    q = np.array([s["q"] for s in asked])
                    end = np.array([s["q"] + s["n"] + width - 1 for s in asked])
                    np.add.at(depth, q, 1)
                    np.add.at(depth, end, -1)
                gone = np.cumsum(depth[:-1]) > 0
                kept = raw[~gone].tobytes()
                starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                for column, v in zip(out, (len(raw), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        trim()

    with_spans = rows.select("doc_id", "k", "sub", "text").join(spans, ["k", "sub"], "left").select("doc_id", "text", "asked")
    return with_spans.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
