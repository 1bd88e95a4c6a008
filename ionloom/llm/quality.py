"""Quality classifier: a document's own evidence and hierarchical empirical Bayes over its site.

A logistic regression on text statistics gives each document's evidence. Hosts shrink towards the
global rate and paths towards their host's posterior, by strengths fitted to the spread between sites
(method of moments over grouped sums), so that sparse sites hardly move a document. A document's own
evidence is taken out of its sites' before they are combined.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import join_small, materialize
from ionloom.llm.textstats import features, with_stats

#: Labelled rows that the regression is fitted on at most, those with the smallest hashes of their ids.
FIT_ROWS = 50_000
NAMES = tuple(["x_word", "x_symbol", "x_upper", "x_punct", "x_lines", "x_repeat", "x_dup", "x_digit"])
#: Weight of a site's posterior in a document's log-odds, and the posterior below which a document is rejected.
SITE_WEIGHT = 0.5
THRESHOLD = 0.5
_STEPS = float(1 << 40)


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression with squares, by Newton steps: (mean, scale, weights, weights of squares); [0] of weights is the bias."""
    mean, scale = rows.mean(0), rows.std(0) + 1e-6
    z = np.clip((rows - mean) / scale, -20, 20)
    x = np.concatenate([np.ones((len(z), 1)), z, np.minimum(z * z, 50)], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (labels - p) - penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    d = rows.shape[1]
    return mean, scale, w[: d + 1], w[d + 1 :]


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, mean: Column) -> float:
    """Prior strength of a Beta whose sites (n, s) scatter about `mean` as these do, by moments."""
    spread = sites.filter("n > 1").agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, 2)).alias("between"),
        F.sum(mean * (1 - mean)).alias("one"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("all"),
    ).first()
    if not spread["all"]:
        return 10.0
    # between = sum v (1 + (n - 1) rho) with v the Bernoulli variance; strength = 1 / rho - 1
    rho = (spread["between"] - spread["one"]) / max(spread["all"] - spread["one"], 1e-9)
    return float(1 / min(max(rho, 1e-4), 0.9) - 1)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", fit_rows: int = FIT_ROWS, site_weight: float = SITE_WEIGHT, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, host, path, n_words, own_score, host_rate, path_rate, score, kept and the columns `carry` of every row of docs.

    docs: doc_id, text and the columns named by host and path (a path counts within its host); labels:
    doc_id, quality (0 or 1; nulls are left out). own_score: the probability of quality from the text
    alone. score: with the posteriors of the path and host. kept: score >= threshold. Null and empty
    texts are scored as texts of no words and never kept; null hosts or paths are sites of their own. Rows with null
    or repeated ids, or repeated whole, are scored and counted one by one; a label counts for every row of its id. Texts of any
    length are scored whole. Without labels of both kinds every text with a word scores 0.5 or more and is kept. An
    empty table gives an empty result.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name(host)("host"), name(path)("path"), *carry, "text")
    stats = with_stats(base, "doc_id", "host", "path", *carry)
    stats = materialize(stats.select("doc_id", "host", "path", *carry, "n_words", *[v.alias(k) for k, v in features().items()]))

    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = known.join(stats.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(*order).limit(fit_rows)
    # an id may stand in several rows: the bound holds for rows, and their order is their own, so that sums agree between runs
    sample = stats.join(picked, "doc_id").orderBy(*order, *NAMES).limit(fit_rows).select("y", *NAMES).toPandas()
    own = F.lit(0.5)
    if sample["y"].nunique() == 2:
        mean, scale, w, squares = fit(sample[list(NAMES)].to_numpy(float), sample["y"].to_numpy())
        odds = F.lit(float(w[0]))
        for i, c in enumerate(NAMES):
            z = F.least(F.greatest((F.col(c) - float(mean[i])) / float(scale[i]), F.lit(-20.0)), F.lit(20.0))
            odds = odds + z * float(w[i + 1]) + F.least(z * z, F.lit(50.0)) * float(squares[i])
        own = 1 / (1 + F.exp(-F.least(F.greatest(odds, F.lit(-30.0)), F.lit(30.0))))
    scored = stats.select("doc_id", "host", "path", *carry, "n_words", own.alias("own_score"))

    # summed in whole steps, so that the order of rows doesn't matter
    total = F.sum(F.rint(F.col("own_score") * _STEPS).cast("decimal(38,0)")).cast("double") / _STEPS
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), total.alias("s")))
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = min(max((total["s"] or 0.0) / max(total["n"] or 0, 1), 1e-6), 1 - 1e-6)
    k_host = _strength(hosts, F.lit(rate))
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    placed = join_small(paths, hosts, ["host"]).withColumn("m", (F.col("host_s") + k_host * rate) / (F.col("host_n") + k_host))
    k_path = _strength(placed, F.col("m"))
    sites = materialize(placed.select("host", "path", "n", "s", "host_n", "host_s"))

    met = join_small(scored, sites, ["host", "path"])
    host_rate = (F.col("host_s") - F.col("own_score") + k_host * rate) / (F.col("host_n") - 1 + k_host)
    path_rate = (F.col("s") - F.col("own_score") + k_path * F.col("host_rate")) / (F.col("n") - 1 + k_path)
    met = met.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    posterior = _logit(F.col("own_score")) + site_weight * (_logit(F.col("path_rate")) - float(np.log(rate / (1 - rate))))
    met = met.withColumn("score", 1 / (1 + F.exp(-posterior)))
    return met.select("doc_id", "host", "path", "n_words", "own_score", "host_rate", "path_rate", "score", ((F.col("score") >= threshold) & (F.col("n_words") > 0)).alias("kept"), *carry)
