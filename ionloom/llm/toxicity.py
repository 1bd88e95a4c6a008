"""Toxicity by multiple-instance learning.

A document is a bag of sentences and is toxic if one of them is: P = 1 - prod(1 - p_s), with p_s a
logistic regression on the words of the sentence. Only documents carry labels; the noisy-or tells the
training which sentences they come from, and the fitted sentence scores locate the offending ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm.common import discard, join_small, materialize, text_batches

#: Labelled rows that the model is fitted on at most, those with the smallest hashes of their ids.
FIT_ROWS = 10_000
#: A doc_id with more rows than that is not learned from.
MOST_ROWS = 100
#: Documents' worth of the general rate in a word's rate, and how far the training may move a word's weight from its evidence.
PRIOR, SPREAD = 2.0, 1.0
SENTENCE = re.compile(r"[.!?\n]+")
_STRIP = " \t\r\x0b\x0c,;:\"'()[]{}#$%&*|<>-_"


def words_of(sentence: str) -> list[str]:
    """Lower-cased words without the punctuation around them."""
    return [w for x in sentence.lower().split() if (w := x.strip(_STRIP))]


def sentence_scores(text: str, weights: dict[str, float], bias: float) -> list[tuple[int, int, float]]:
    """(begin, end, p) of every sentence with a word that the model knows; the others have the model's bias."""
    out, begin = [], 0
    for m in [*SENTENCE.finditer(text), None]:
        end = m.start() if m else len(text)
        found = {w for w in words_of(text[begin:end]) if w in weights}
        if found:
            out.append((begin, end, 1 / (1 + float(np.exp(-(bias + sum(weights[w] for w in found)))))))
        begin = m.end() if m else end
    return out


def noisy_or(scores: list[float]) -> float:
    p = 1.0
    for s in scores:
        p *= 1 - s
    return 1 - p


def fit_words(bags: list[list[list[int]]], labels: np.ndarray, evidence: np.ndarray, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient ascent (Adam) on the documents' likelihood under the noisy-or, weights normal about the evidence.

    bags: for each document its sentences as word indexes; only sentences with a word that tells are instances, so a
    document's length alone says nothing.
    """
    sent = np.array([i for i, s in enumerate(s for bag in bags for s in bag) for _ in s], dtype=np.int64)
    word = np.array([w for bag in bags for s in bag for w in s], dtype=np.int64)
    sent_doc = np.array([d for d, bag in enumerate(bags) for _ in bag], dtype=np.int64)
    n_sent, n_doc, n_words = len(sent_doc), len(bags), len(evidence)
    theta, bias = evidence.astype(float).copy(), -2.0
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(sent, theta[word], n_sent), -30, 30)))
        p = np.clip(p, 1e-7, 1 - 1e-7)
        none = np.clip(np.exp(np.bincount(sent_doc, np.log1p(-p), n_doc)), 1e-9, 1 - 1e-6)
        # d log-likelihood / d logit of a sentence
        pull = np.where(labels == 1, none / (1 - none), -1.0)[sent_doc] * p
        g = np.append(np.bincount(word, pull[sent], n_words) - (theta - evidence) / SPREAD**2, pull.sum() - (bias + 2) / 9)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        theta, bias = theta + step[:-1], bias + step[-1]
    return theta, float(bias)


def evidence_of(n: F.Column, toxic: F.Column, rate: float, n_words: int) -> F.Column:
    """A word's log odds from the documents that have it (n, of which toxic), shrunk by its signal to noise.

    With z the count's deviation in standard errors, 1 - c**2 / z**2 of it is left, c = sqrt(2 ln n_words) being what the
    largest of so many words without a meaning reaches: every word takes part, and those within the noise weigh nothing.
    """
    z2 = F.pow(toxic - n * rate, 2) / (n * (rate * (1 - rate)))
    odds = F.log((toxic + PRIOR * rate) / (n - toxic + PRIOR * (1 - rate))) - float(np.log(rate / (1 - rate)))
    return odds * F.greatest(1 - float(2 * np.log(max(n_words, 2))) / z2, F.lit(0.0))


def fit(train: DataFrame) -> tuple[dict[str, float], float, float]:
    """Word weights, bias and the rate of toxicity among documents without a word that tells, from train (doc_id, text, toxic),
    whose number of rows the caller has bounded.

    All words of all rows are counted; those whose evidence is not nil are trained under the noisy-or. The driver
    gets these words and, of each row, the indexes of those words by sentence.
    """
    text_batches(train.sparkSession)
    picked = materialize(train.filter("toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text")))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted(set(words_of(SENTENCE.sub(" ", t)))) for t in b.column(2).to_pylist()]
            toxic = np.repeat(b.column(1).to_numpy(), [len(w) for w in words])
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array([w for ws in words for w in ws], pa.string())], names=["toxic", "word"])

    rows = picked.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    n, toxic = rows["n"], rows["t"] or 0
    rate = (toxic + 0.5) / (n + 1)
    if not 0 < toxic < n:
        return {}, -2.0, rate
    counts = materialize(picked.mapInArrow(distinct, "toxic int, word string").groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")))
    told = counts.select("word", evidence_of(F.col("n"), F.col("t"), rate, counts.count()).alias("e")).filter("e <> 0").orderBy("word").collect()
    discard(counts)
    index = {r["word"]: i for i, r in enumerate(told)}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [[ids for s in SENTENCE.split(t) if (ids := sorted({index[w] for w in words_of(s) if w in index}))] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bags, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "toxic", "bag"])

    # in an order of its own, so that sums agree between runs
    rows = picked.mapInArrow(indexed, "doc_id long, toxic int, bag array<array<int>>").orderBy("doc_id", "toxic", "bag").toArrow()
    bags, labels = rows.column("bag").to_pylist(), rows.column("toxic").to_numpy()
    weights, bias = fit_words(bags, labels, np.array([r["e"] for r in told]))
    silent = np.array([not bag for bag in bags])
    leak = (labels[silent].sum() + 0.5) / (silent.sum() + 1)
    return {r["word"]: float(w) for r, w in zip(told, weights)}, bias, float(leak)


def score(docs: DataFrame, weights: dict[str, float], bias: float, leak: float = 0.0) -> DataFrame:
    """doc_id, score and spans (begin, end, p of the sentences at 0.5 or more) of every row's whole text. leak: the probability
    that a text without a sentence that tells is toxic; it enters the noisy-or as one more sentence."""
    text_batches(docs.sparkSession)
    spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, spans = [], []
            for text in b.column(1).to_pylist():
                found = sentence_scores(text or "", weights, bias)
                scores.append(min(max(noisy_or([leak, *(p for *_, p in found)]), 0.0), 1.0))
                spans.append([{"begin": i, "end": j, "p": p} for i, j, p in found if p >= 0.5])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, spans_type)], names=["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, spans array<struct<begin:int,end:int,p:double>>")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose crc32 of the id as text is divisible by 5: no label of theirs is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every row of docs (doc_id, text; other columns are ignored).

    labels: doc_id, toxic; rows with other values than 0 and 1, and held-out ids, are not learned from; an id that
    is labelled both ways is toxic. A text without a word that the model weighs, null and empty texts included,
    scores the rate of toxicity among such texts. Rows with a repeated doc_id are scored one by one and learned from
    one by one; a null doc_id is not held out and has no label. Texts of any length are scored whole. Without labels
    of both kinds every text scores the labels' rate. An empty table gives an empty result.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(~held_out())
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").groupBy("doc_id").count().filter(F.col("count") <= MOST_ROWS)
    # the bound holds for rows: an id counts as often as it stands in docs
    order = Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    met = known.join(ids, "doc_id").select("doc_id", "toxic", "count", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(fit_rows)
    sample = materialize(met.withColumn("before", F.coalesce(F.sum("count").over(order), F.lit(0))).filter(F.col("before") + F.col("count") <= fit_rows).select("doc_id", "toxic"))
    # ids are picked before texts are fetched, so no task gathers the sample's texts
    train = join_small(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sample, ["doc_id"], "inner")
    weights, bias, leak = fit(train)
    out = score(docs, weights, bias, leak)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
