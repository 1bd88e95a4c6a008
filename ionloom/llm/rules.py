"""Quality rules: robust multivariate outliers among the statistics of texts.

Per language and source the minimum covariance determinant estimates location and scatter. From each of STARTS
first subsets concentration steps take the share H of a group's rows with the smallest Mahalanobis distances and
estimate anew from them, until the determinants settle; of a group's starts the one with the smallest
determinant counts. Every estimate is shrunk towards its language's and that towards all rows', by the
weight of PRIOR rows, so sparse groups need no rule of their own. A step is one grouped sum over all rows by bins of
distance, in whole numbers (a feature is held in steps of 1/STEP), so neither the order of rows nor their number
in a group matters to a result or to a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm.common import BROADCAST_ROWS, discard, join_small, materialize
from ionloom.llm.textstats import features, with_stats

STEP = 1024
H = 0.75
#: Starts: rows near the medians, all rows, and twice about SUBSET rows by a hash. Steps at most: the last ones hardly move.
STARTS, SUBSET, STEPS = 4, 32, 12
#: Change of a log determinant, in the mean, at which the steps have converged.
SETTLED = 1e-3
#: Rows' worth of the language in a group's estimate, and of all rows in a language's.
PRIOR = 20.0
#: Standard deviation that every feature has at least: what a rewording of a text may change.
FLOOR = 0.25
#: Share of texts of a group's own distribution that are kept.
QUANTILE = 0.999
#: The features; shares of repeated words and lines count half, as few clean texts have any.
NAMES = ("x_word", "x_symbol", "x_upper", "x_punct", "x_lines", "x_repeat", "x_dup")
WEIGHT = {"x_repeat": 0.5, "x_dup": 0.5}
_BINS = 16


def chi_square(d: int, z: float) -> float:
    """The chi-square quantile with d degrees of freedom at the normal quantile z (Wilson and Hilferty)."""
    return d * (1 - 2 / (9 * d) + z * (2 / (9 * d)) ** 0.5) ** 3


def _bin_quantile(rows: DataFrame, keys: list[str], bin_: str, share: float) -> DataFrame:
    """keys and the smallest bin up to which `share` of the rows lie."""
    counts = rows.groupBy(*keys, bin_).count()
    by = Window.partitionBy(*keys)
    ranked = counts.withColumn("c", F.sum("count").over(by.orderBy(bin_))).withColumn("n", F.sum("count").over(by))
    return ranked.filter(F.col("c") >= F.col("n") * share).groupBy(*keys).agg(F.min(bin_).alias("at"))


def estimate(n: float, s: np.ndarray, p: np.ndarray, prior: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and second moments of n rows with sums s and sums of products p (upper triangle by rows), with PRIOR rows' worth of a prior's."""
    d = len(s)
    second = np.zeros((d, d))
    second[np.triu_indices(d)] = p
    second = second + second.T - np.diag(np.diag(second))
    first, second = s / STEP, second / STEP**2
    if prior is None:
        return first / max(n, 1), second / max(n, 1)
    return (first + PRIOR * prior[0]) / (n + PRIOR), (second + PRIOR * prior[1]) / (n + PRIOR)


def inverted(mean: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and log determinant of the covariance with the floor."""
    cov = second - np.outer(mean, mean) + np.eye(len(mean)) * FLOOR**2
    inverse = np.linalg.inv(cov)
    return (inverse + inverse.T) / 2, float(np.linalg.slogdet(cov)[1])


ESTIMATE = "gl string, gs string, start int, mean array<double>, inv array<double>, logdet double"


def _solved(frame: pd.DataFrame, d: int) -> pd.DataFrame:
    """Estimates from frame: gl, gs, start and the sums (n, s, p in one array) of the group (own), its language and all."""
    out = []
    for row in frame.itertuples(index=False):
        prior = None
        for x in (row.all, row.lang, row.own):
            x = np.asarray(x, float)
            prior = estimate(x[0], x[1 : d + 1], x[d + 1 :], prior)
        inv, logdet = inverted(*prior)
        out.append((row.gl, row.gs, row.start, prior[0].tolist(), inv.ravel().tolist(), logdet))
    return pd.DataFrame(out, columns=["gl", "gs", "start", "mean", "inv", "logdet"])


def _estimates(near: DataFrame, names: tuple[str, ...], rows: int) -> tuple[DataFrame, int]:
    """(gl, gs, start, mean, inv, logdet; the sum of the latter in millionths) from the sums of each group's near rows, so many rows.

    A table that may be broadcast is solved on the driver, a larger one where it lies.
    """
    d = len(names)
    cols = ["n", *[f"s{i}" for i in range(d)], *[f"p{i}" for i in range(d * (d + 1) // 2)]]
    if rows <= BROADCAST_ROWS:
        got = near.toPandas().sort_values(["gl", "gs", "start"], ignore_index=True)
        sums = got[cols].astype("int64")
        frame = got[["gl", "gs", "start"]].copy()
        for name, part in (("own", sums), ("lang", sums.groupby([got.gl, got.start]).transform("sum")), ("all", sums.groupby(got.start).transform("sum"))):
            frame[name] = list(part.to_numpy(float))
        solved = _solved(frame, d)
        return near.sparkSession.createDataFrame(solved, ESTIMATE), int(np.rint(solved.logdet * 1e6).sum())
    pooled = lambda name, *keys: F.array(*[F.sum(c).over(Window.partitionBy(*keys)) for c in cols]).cast("array<double>").alias(name)
    frame = near.select("gl", "gs", "start", F.array(*cols).cast("array<double>").alias("own"), pooled("lang", "gl", "start"), pooled("all", "start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _solved(pdf, d)

    out = materialize(frame.mapInPandas(run, ESTIMATE))
    return out, int(out.agg(F.sum(F.rint(F.col("logdet") * 1e6).cast("decimal(38,0)"))).first()[0] or 0)


def _distance(names: tuple[str, ...]) -> Column:
    d = len(names)
    diff = [F.col(c) / STEP - F.col("mean")[i] for i, c in enumerate(names)]
    total = F.lit(0.0)
    for i in range(d):
        total = total + diff[i] * diff[i] * F.col("inv")[i * d + i]
        for j in range(i + 1, d):
            total = total + 2 * diff[i] * diff[j] * F.col("inv")[i * d + j]
    return F.greatest(total, F.lit(0.0))


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(distance + 1e-6) * _BINS).cast("int")


def _sums(rows: DataFrame, names: tuple[str, ...], *keys: str) -> DataFrame:
    products = [F.col(a) * F.col(b) for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(names)], *[F.sum(c).alias(f"p{i}") for i, c in enumerate(products)])


def _nearest(by_bin: DataFrame) -> DataFrame:
    """The sums of each group's bins, from the nearest on, that hold the share H of its rows."""
    by = Window.partitionBy("gl", "gs", "start")
    ranked = by_bin.withColumn("upto", F.sum("n").over(by.orderBy("_bin")) - F.col("n")).withColumn("all", F.sum("n").over(by))
    cols = [c for c in by_bin.columns if c[0] in "sp" and c[1:].isdigit()]
    return ranked.filter(F.col("upto") < F.col("all") * H).groupBy("gl", "gs", "start").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in cols])


def mcd(rows: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """gl, gs, mean, inv: each group's estimate. rows: gl and gs (the group), and names, features in whole steps."""
    long = rows.select("gl", "gs", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(names)])).alias("f")).select("gl", "gs", "f.i", "f.v")
    medians = _bin_quantile(long.withColumn("b", F.floor(F.col("v") / 16)), ["gl", "gs", "i"], "b", 0.5)
    size = rows.groupBy("gl", "gs").agg(F.count("*").alias("size"))
    known = materialize(medians.groupBy("gl", "gs").agg(F.array_sort(F.collect_list(F.struct("i", "at"))).alias("m")).join(size, ["gl", "gs"]))
    far = F.greatest(*[F.abs(F.col(c) - (F.col("m")[i]["at"] * 16 + 8)) for i, c in enumerate(names)])
    u = F.xxhash64(F.col("start"), *names).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    first = F.when(F.col("start") == 0, far <= 6 * FLOOR * STEP).when(F.col("start") == 1, F.lit(True)).otherwise(u * F.col("size") < SUBSET)
    started = join_small(rows, known, ["gl", "gs"]).withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(STARTS)])))
    # every start of every group has its row, if of no rows: it is then its language's estimate
    chosen = _sums(started.withColumn("in", first).select("gl", "gs", "start", *[F.when(F.col("in"), F.col(c)).otherwise(0).alias(c) for c in names], F.col("in")), names, "gl", "gs", "start", "in")
    chosen = chosen.groupBy("gl", "gs", "start").agg(F.sum(F.when(F.col("in"), F.col("n")).otherwise(0)).alias("n"), *[F.sum(c).alias(c) for c in chosen.columns if c[0] in "sp" and c[1:].isdigit()])
    n = known.count() * STARTS
    now, before = _estimates(chosen, names, n)
    starts = rows.withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(STARTS)])))
    for _ in range(STEPS):
        by_bin = _sums(join_small(starts, now, ["gl", "gs", "start"], rows=n).withColumn("_bin", _bin(_distance(names))), names, "gl", "gs", "start", "_bin")
        old, (now, total) = now, _estimates(_nearest(by_bin), names, n)
        discard(old)
        if abs(total - before) <= SETTLED * 1e6 * n:
            break
        before = total
    best = now.groupBy("gl", "gs").agg(F.min_by(F.struct("mean", "inv"), F.struct("logdet", "start")).alias("k"))
    return materialize(best.select("gl", "gs", "k.mean", "k.inv"))


def mcd_distances(rows: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """rows (gl, gs, and names in whole steps) with d2, the squared robust distance, scaled so that a group's median is
    the chi-square's where it is above."""
    far = join_small(rows, mcd(rows, names), ["gl", "gs"]).withColumn("d2", _distance(names))
    half = _bin_quantile(far.withColumn("_bin", _bin(F.col("d2"))), ["gl", "gs"], "_bin", 0.5)
    scale = half.select("gl", "gs", (F.pow(F.lit(2.0), (F.col("at") + 0.5) / _BINS) / chi_square(len(names), 0.0)).alias("scale"))
    # a floored scatter may already be wider than the rows: distances are never stretched
    return join_small(far, materialize(scale), ["gl", "gs"]).withColumn("d2", F.col("d2") / F.greatest("scale", F.lit(1.0))).drop("mean", "inv", "scale")


def quality_rules(docs: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance and kept of every row.

    docs: doc_id, text, lang, source; other columns are ignored. base_failed: fewer than 10 words, or over
    a fifth of the words in repeated 5-word windows. kept: not base_failed and within the chi-square
    quantile of the robust distance. Rows that fail the base rule don't enter the estimates. Null and
    empty texts have no words and fail; null languages and sources are groups of their own, and a group may be of one
    row; rows with null or repeated ids, or repeated whole, are judged and counted one by one; texts of any length
    are counted whole; an empty table gives an empty result.
    """
    key = lambda c, name: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(name)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key("lang", "gl"), key("source", "gs"), "text")
    stats = with_stats(base, "doc_id", "gl", "gs")
    stats = stats.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    stats = materialize(stats.select("*", *[F.round(v * (STEP * WEIGHT.get(k, 1.0))).cast("long").alias(k) for k, v in features().items() if k in NAMES]))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    cut = chi_square(len(NAMES), NormalDist().inv_cdf(quantile))
    judged = mcd_distances(stats.filter("not base_failed").select(*out, "gl", "gs", *NAMES))
    judged = judged.select(*out, F.sqrt("d2").alias("distance"), (F.col("d2") <= cut).alias("kept"))
    failed = stats.filter("base_failed").select(*out, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return judged.unionByName(failed)
