"""Mixing sources to target weights with DataFrame and SQL functions only.

Documents are cut into blocks of words, and every source gets an exact quota of words that follows
from its weight. A multivariate-hypergeometric splitting tree divides the quotas of all sources among
the output shards: a node's counts per source are split in two halves by conditional hypergeometric
draws, so a leaf holds what a random permutation of all the drawn blocks would have put there, and the
sums stay exact. Each source's blocks stand in a permuted order (by a hash), of which the leaves draw
disjoint ranges, pass after pass; in a shard, `position` gives the order to shuffle rows into.

A source's blocks are dealt to cells by ranges of that hash, about CELL_BLOCKS to a cell, so the
running sums are taken in bounded windows however large a source is. All randomness is hashes of ids:
runs agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions.arrays import bound
from ionloom.llm.common import join_small, materialize

WORD = "[^\\x20\\x09-\\x0D]+"
CELL_BLOCKS = 2048
MAX_REPEATS = 3
#: Blocks of an output shard at most; there are 2**LEAST_DEPTH shards or more.
SHARD_BLOCKS, LEAST_DEPTH = 1 << 20, 4
_SPAN = float(1 << 62)


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*parts: Column) -> Column:
    """A number in [0, 1) hashed from parts."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / float(1 << 53)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, size -> source, source_size, target.

    Sources by code point, null last, weigh `weights`, repeating, and share all words; a target stops at
    max_repeats times its source's size and the excess is reshared by weight. That ends where
    target = min(max_repeats * size, level * weight): with the sources sorted by the level at which they
    stop, the level is the first that the words left over reach without stopping the next source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w)
    t = t.withColumn("stop", F.col("source_size") * float(max_repeats)).withColumn("at", F.col("stop") / F.col("weight"))
    order = Window.orderBy("at", F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    t = t.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0)))
    t = t.withColumn("level", F.col("left") / F.sum("weight").over(onward))
    t = t.withColumn("final", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(everything)["level"])
    return t.select("source", "source_size", F.least("stop", F.coalesce(F.col("final"), F.lit(float("inf"))) * F.col("weight")).cast("double").alias("target"))


def hypergeometric(k: Column, good: Column, total: Column, u: Column) -> Column:
    """How many of `good` among `total` are in k draws without replacement: the value at u in [0, 1).

    Exact at any size, up to the rounding of doubles. Probabilities are taken relative to the mode's, whose
    neighbours follow from the ratio of one to the next, upwards and then downwards. Beyond 10 standard
    deviations and 20 steps from the mode they are under 1e-20 of it and add nothing to a double. So a draw
    takes as many steps as its standard deviation is large, the square root of its size at most.
    """
    k, good, total = (c.cast("double") for c in (k, good, total))
    share = good / F.greatest(total, F.lit(1.0))
    var = k * share * (1 - share) * (total - k) / F.greatest(total - 1, F.lit(1.0))
    low, high = F.greatest(F.lit(0.0), k - (total - good)), F.least(k, good)
    mode = F.least(F.greatest(F.floor((k + 1) * (good + 1) / (total + 2)).cast("double"), low), high)
    steps = F.ceil(10 * F.sqrt(F.greatest(var, F.lit(0.0))) + 20).cast("int")
    given = F.struct(k.alias("k"), good.alias("good"), (total - good - k).alias("rest"), u.alias("u"), low.alias("low"), high.alias("high"), mode.alias("mode"), steps.alias("steps"))

    def upward(v: Column, x: Column) -> Column:
        return F.when(x < v["high"], (v["good"] - x) * (v["k"] - x) / ((x + 1) * (v["rest"] + x + 1))).otherwise(0.0)

    def downward(v: Column, x: Column) -> Column:
        return F.when(x > v["low"], x * (v["rest"] + x) / ((v["good"] - x + 1) * (v["k"] - x + 1))).otherwise(0.0)

    def summed(v: Column, ratio, sign: int) -> Column:
        """The sum of the relative probabilities on one side of the mode."""
        state = "struct<w:double,acc:double>"
        step = lambda s, i: bound(s["w"] * ratio(v, v["mode"] + sign * (i - 1)), lambda w: F.struct(w.alias("w"), (s["acc"] + w).alias("acc")))
        return F.aggregate(F.sequence(F.lit(1), v["steps"]), F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("acc")).cast(state), lambda s, i: step(s, i).cast(state), lambda s: s["acc"])

    def searched(v: Column, ratio, sign: int, goal: Column) -> Column:
        """How far from the mode the running sum passes goal."""
        state = "struct<w:double,acc:double,at:double>"
        step = lambda s, i: bound(s["w"] * ratio(v, v["mode"] + sign * (i - 1)), lambda w: F.struct(w.alias("w"), (s["acc"] + w).alias("acc"), F.when((s["acc"] <= goal) & (w > 0), i.cast("double")).otherwise(s["at"]).alias("at")))
        return F.aggregate(F.sequence(F.lit(1), v["steps"]), F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("acc"), F.lit(0.0).alias("at")).cast(state), lambda s, i: step(s, i).cast(state), lambda s: s["at"])

    def drawn(v: Column) -> Column:
        sums = F.struct(summed(v, upward, 1).alias("up"), summed(v, downward, -1).alias("down"))
        goal = lambda s: F.struct((v["u"] * (1 + s["up"] + s["down"]) - 1).alias("goal"), s["up"].alias("up"))
        side = lambda g: F.when(g["goal"] < 0, v["mode"]).when(g["goal"] < g["up"], v["mode"] + searched(v, upward, 1, g["goal"])).otherwise(v["mode"] - searched(v, downward, -1, g["goal"] - g["up"]))
        return bound(sums, lambda s: bound(goal(s), side))

    return bound(given, drawn).cast("long")


def splitting_tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """source, quota (blocks) -> shard, source, n: 2**depth shards of equal size within one block.

    Each level splits every node in two: the left child takes half of the node's blocks, source by
    source, from what the earlier sources have left. Rows: nodes of the level times sources.
    """
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), F.struct(F.col("source").isNull().alias("none"), "source", F.col("quota").cast("long").alias("n")).alias("x")).groupBy("node").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    state = "struct<draws:bigint,total:bigint,left:array<bigint>>"
    for level in range(depth):
        def step(s: Column, x: Column, level: int = level) -> Column:
            key = F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), F.coalesce(x["source"], F.lit("\0")))
            got = hypergeometric(s["draws"], x["n"], s["total"], unit(key))
            return bound(got, lambda got: split(s, x, got))

        def split(s: Column, x: Column, got: Column) -> Column:
            return F.named_struct(F.lit("draws"), s["draws"] - got, F.lit("total"), s["total"] - x["n"], F.lit("left"), F.concat(s["left"], F.array(got)))

        total = F.aggregate("xs", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        half = F.floor((total + F.col("node").bitwiseAND(F.lit(1))) / 2).cast("long")
        start = F.named_struct(F.lit("draws"), half, F.lit("total"), total, F.lit("left"), F.array().cast("array<bigint>")).cast(state)
        nodes = nodes.withColumn("left", F.aggregate("xs", start, lambda s, x: step(s, x).cast(state), lambda s: s["left"]))
        child = lambda f: F.zip_with("xs", "left", lambda x, g: F.struct(x["none"].alias("none"), x["source"].alias("source"), f(x["n"], g).cast("long").alias("n")))
        nodes = nodes.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), child(lambda n, g: g).alias("xs")), F.struct((F.col("node") * 2 + 1).alias("node"), child(lambda n, g: n - g).alias("xs")))).alias("c")).select("c.node", "c.xs")
    return nodes.select(F.col("node").alias("shard"), F.explode("xs").alias("x")).select("shard", "x.source", "x.n")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), block_words: int | None = 256, depth: int | None = None, seed: int = 17, max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """(documents, draws) of the mix of all docs (doc_id, text, source; other columns are ignored).

    documents: doc_id, source, copy, size, source_size, target, a row for each row of docs.
    draws: src, doc_id, copy, size, block, words, pass, shard, position: the blocks that the tree's leaves draw. A
    block is drawn once per pass; the last block that a source's quota reaches is cut to what is left of it (with
    block_words None a block is a whole document, and is taken if at least half of it fits). depth: of the tree,
    by default so that a shard has SHARD_BLOCKS at most.
    Rows that repeat a doc_id, source and size are told apart by `copy`, in no particular order. Null and
    empty texts have size 0 and no blocks; null sources are one source; texts of any length are cut into
    blocks whole; an empty table gives empty results. The list of sources, a few numbers each, is held by one task.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    rows = sized.groupBy("doc_id", "source", "size").count().select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("copy"))
    rows = materialize(rows.withColumn("src", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))))
    goals = materialize(targets(rows.select("source", "size"), weights, max_repeats).withColumn("src", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))))

    step = F.lit(block_words) if block_words else F.greatest(F.col("size"), F.lit(1))
    blocks = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / step).cast("long"))))
    blocks = blocks.withColumn("words", F.least(step.cast("long"), F.col("size") - F.col("block") * step)).withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "copy", "size", "block").bitwiseAND(F.lit((1 << 62) - 1)))
    counted = blocks.groupBy("src").agg(F.count("*").alias("n_blocks"))
    goals = materialize(goals.join(counted, "src", "left").withColumn("cells", F.ceil(F.coalesce("n_blocks", F.lit(0)) / CELL_BLOCKS).cast("long")).withColumn("words", F.round("target").cast("long")))
    blocks = join_small(blocks, goals.select("src", "cells"), ["src"]).withColumn("cell", F.least(F.floor(F.col("u") / _SPAN * F.col("cells")), F.col("cells") - 1).cast("long")).drop("cells")
    blocks = materialize(blocks.drop("source"))

    # each block's place in its source's permuted order: what stands before its cell, and before it in the cell
    by_source = Window.partitionBy("src").orderBy("cell")
    cells = blocks.groupBy("src", "cell").agg(F.sum("words").alias("w"), F.count("*").alias("n"))
    cells = cells.withColumn("w0", F.sum("w").over(by_source) - F.col("w")).withColumn("n0", F.sum("n").over(by_source) - F.col("n")).drop("w", "n")
    whole = F.floor(F.col("words") / F.greatest("source_size", F.lit(1)))
    cells = materialize(cells.join(goals.select("src", "n_blocks", whole.alias("whole"), (F.col("words") - whole * F.col("source_size")).alias("rest")), "src"))
    in_cell = Window.partitionBy("src", "cell").orderBy("u", "doc_id", "copy", "block")
    placed = blocks.join(cells, ["src", "cell"]).withColumn("w_at", F.col("w0") + F.sum("words").over(in_cell) - F.col("words")).withColumn("n_at", F.col("n0") + F.row_number().over(in_cell) - 1)
    fits = F.least(F.greatest(F.col("rest") - F.col("w_at"), F.lit(0)), F.col("words"))
    if block_words is None:
        fits = F.when(2 * fits >= F.col("words"), F.col("words")).otherwise(F.lit(0))
    placed = materialize(placed.select("src", "doc_id", "copy", "size", "block", "words", "u", "n_at", "n_blocks", "whole", fits.cast("long").alias("fits")))

    # exact block quotas of the sources, split among the shards; a leaf draws the ranks between its cuts
    quotas = materialize(placed.groupBy(F.col("src").alias("source")).agg((F.max("whole") * F.max("n_blocks") + F.sum(F.when(F.col("fits") > 0, 1).otherwise(0))).alias("quota")))
    if depth is None:
        depth = max(LEAST_DEPTH, ((quotas.agg(F.sum("quota")).first()[0] or 0) // SHARD_BLOCKS).bit_length())
    tree = splitting_tree(quotas, depth, seed).withColumnRenamed("source", "src")
    leaves = tree.withColumn("cut", F.sum("n").over(Window.partitionBy("src").orderBy("shard")))
    leaves = materialize(leaves.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "cut"))), lambda x: x["cut"]).alias("cuts")))
    last = F.floor((F.element_at("cuts", -1) - 1 - F.col("n_at")) / F.col("n_blocks"))
    draws = join_small(placed, leaves, ["src"]).filter(F.element_at("cuts", -1) > F.col("n_at")).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    shard = F.size(F.filter("cuts", lambda c: c <= F.col("pass") * F.col("n_blocks") + F.col("n_at")))
    taken = F.when(F.col("pass") < F.col("whole"), F.col("words")).otherwise(F.col("fits"))
    draws = draws.select("src", "doc_id", "copy", "size", "block", taken.alias("words"), "pass", shard.alias("shard"), F.xxhash64(F.lit(seed + 1), "u", "pass").alias("position"))
    return join_small(rows, goals.select("src", "source_size", "target"), ["src"]), draws


def shuffled(rows: DataFrame) -> DataFrame:
    """rows (with shard and position) dealt by shard and in each shard shuffled: written, a shard is a range of one file."""
    return rows.repartition("shard").sortWithinPartitions("shard", "position")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and shards of every row; see mix.

    taken: the words that the leaves draw of the row, repeats counted; shards: (shard, words) by shard.
    """
    rows, draws = mix(docs, **how)
    key = ["src", "doc_id", "copy", "size"]
    taken = draws.groupBy(*key, "shard").agg(F.sum("words").alias("words")).groupBy(*key).agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "words"))).alias("shards"))
    # null ids keep their rows: joined on a key that has no nulls
    k = F.struct(*key).cast("string")
    out = rows.withColumn("k", k).join(taken.withColumn("k", k).select("k", "taken", "shards"), "k", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<struct<shard:int,words:bigint>>")).alias("shards"))
