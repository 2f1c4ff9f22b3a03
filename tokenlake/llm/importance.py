"""Quality classifier by importance resampling (operator 10).

Two generative models over hashed word n-grams (1 and 2 words, lower case, one count per document)
are compared: the *target* model of labelled good documents and the *raw* model of all labelled ones,
good or not. The ratio of an n-gram is shrunk by its standard error, however few documents have it, and
keeps its sign. The importance weight of a document is the product of its ratios, normalised by the
square root of its length. The scale of the log weights is the one that fits the labels best, as log
odds, and the sample is drawn without replacement by Gumbel top-k: log weight plus Gumbel noise, the k
largest stay.

Both numbers that steer the draw come from labelled documents that the model was not fitted on (each of
``FOLDS`` parts is scored by the others): the scale, and the cut that keeps at least ``GOOD_KEPT`` of the
good ones and parts them best from the rejects. k is how many documents are expected to reach the cut.

The ratio is taken on labelled documents alone: the number of good documents with an n-gram among all is
estimated as their raw count times its share of good ones, so the raw count of all documents cancels out.
Hashes have 64 bits, so no bucket mixes a harmless n-gram with another. The models hold the n-grams of
the rejects among at most ``MAX_LABELLED`` labelled documents (those with the smallest hash of doc_id).

Defined results: null and empty texts have no n-grams and weight 1; with fewer than two labelled
good documents or rejects every document stays; several labels of a document: any toxic or low one counts,
and toxic = 1 counts without a quality; rows of one doc_id are judged one by
one, with the same noise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import small_batches, written
from tokenlake.llm.ngrams import MULTIPLIER, SpanHashes, documents_of_words, mixed, portions, texts_of

MAX_LABELLED = 20_000
FOLDS, GOOD_KEPT = 4, 0.98
#: bins of one step of the search for the k-th largest key, and rows that are looked at singly
BINS, FEW = 4096, 10_000


def ngram_hashes(hasher: SpanHashes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every 1- and 2-gram occurrence."""
    h, doc, _ = documents_of_words(hasher, texts)
    same = doc[1:] == doc[:-1]
    two = mixed(h[:-1] * MULTIPLIER + h[1:])[same]
    return np.concatenate([doc, doc[:-1][same]]), np.concatenate([h, two])


def labelled_sample(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, good): at most ``most`` labelled documents, chosen by the hash of their id."""
    good = (F.min("quality") == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)
    rows = labels.filter("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic = 1)").groupBy("doc_id").agg(good.alias("good"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _rejected_ngrams(rejects: DataFrame) -> np.ndarray:
    """Sorted hashes of the n-grams in labelled rejects; bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHashes()
        for batch in small_batches(batches):
            texts = texts_of(batch, lower=True)
            for at, to in portions(texts):
                gram = np.unique(ngram_hashes(hasher, texts[at:to])[1])
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], ["gram"])

    grams = rejects.select("text").mapInArrow(run, "gram long").distinct()
    return np.sort(grams.toArrow()["gram"].to_numpy().view(np.uint64))


def _present(hasher: SpanHashes, table: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, place in the table) of the n-grams that the table has."""
    doc, h = ngram_hashes(hasher, texts)
    at = np.searchsorted(table, h)
    at[at == len(table)] = 0
    hit = table[at] == h
    pair = np.unique(doc[hit] * len(table) + at[hit])
    return pair // len(table), pair % len(table)


def _folds(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64) * MULTIPLIER) % np.uint64(FOLDS)).astype(np.int64)


def _counts(labelled: DataFrame, table) -> DataFrame:
    """(place, kind, n): labelled documents with each n-gram of the table; kind is 2 * fold, and 1 more for good ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHashes()
        for batch in small_batches(batches):
            texts = texts_of(batch, lower=True)
            kind = 2 * _folds(batch["doc_id"].to_numpy()) + batch["good"].to_numpy(zero_copy_only=False)
            for at, to in portions(texts):
                doc, place = _present(hasher, table.value, texts[at:to])
                both, n = np.unique(place * (2 * FOLDS) + kind[at:to][doc], return_counts=True)
                arrays = [both // (2 * FOLDS), both % (2 * FOLDS), n]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in arrays], ["place", "kind", "n"])

    parts = labelled.mapInArrow(run, "place int, kind int, n int")
    return parts.groupBy("place", "kind").agg(F.sum("n").cast("int").alias("n"))


def shrunk_ratios(target: np.ndarray, rejected: np.ndarray, share: float) -> np.ndarray:
    """Log of target / raw, one document of the share of good ones added, shrunk by twice its squared standard error."""
    seen = target + rejected + 1
    ratio = np.log((target + share) / (seen * share))
    error = 1 / np.maximum(target + share, seen / 20)
    return (ratio * (ratio**2 / (ratio**2 + 2 * error)) ** 2).astype(np.float32)


def scale_and_cut(score: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """The factor that makes held-out scores log odds, and the cut of the keys; by Newton's steps and by the expected rates."""
    x, w = np.stack([np.ones(len(score)), score], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), x.T @ (good - p) - 0.01 * w)
        w = w + step * min(1.0, 2 / np.abs(step).max())
    scale = max(float(w[1]), 0.0)
    cuts = np.linspace((score * scale).min() - 8, (score * scale).max() + 8, 2000)
    stay = np.array([[reaching(score[g] * scale, c).mean() for g in (good, ~good)] for c in cuts])
    apart = np.where(stay[:, 0] >= GOOD_KEPT, stay[:, 0] - stay[:, 1], -1.0)
    return scale, float(cuts[apart >= apart.max() - 1e-3].mean())


def reaching(log_weight: np.ndarray, cut: float) -> np.ndarray:
    """Probability that log weight plus Gumbel noise reaches the cut."""
    return -np.expm1(-np.exp(np.minimum(log_weight - cut, 50)))


def _scored(docs: DataFrame, table, ratios) -> DataFrame:
    """(doc_id, n_evidence, score); with several rows of ratios, each document by that of its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, ratio = SpanHashes(), ratios.value
        for batch in small_batches(batches):
            texts = texts_of(batch, lower=True)
            fold = _folds(batch["doc_id"].to_numpy()) if len(ratio) > 1 else np.zeros(len(texts), np.int64)
            score, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for at, to in portions(texts) if len(table.value) else ():
                doc, place = _present(hasher, table.value, texts[at:to])
                size = np.array([len(t.split()) for t in texts[at:to]])
                score[at:to] = np.bincount(doc, ratio[fold[at:to][doc], place], to - at) / np.sqrt(1 + size)
                n[at:to] = np.bincount(doc, minlength=to - at)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), pa.array(score)], ["doc_id", "n_evidence", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_evidence long, score double")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray, float]:
    """(n-gram hashes, scaled log ratios, cut of the keys) of the models of target and raw text."""
    context = docs.sparkSession.sparkContext
    nothing = np.zeros(0, np.uint64), np.zeros(0, np.float32), -math.inf
    sample = F.broadcast(labelled_sample(labels, most))  # at most `most` ids
    labelled = written(docs.select(F.col("doc_id").cast("long"), "text").join(sample, "doc_id"), "labelled")
    table = _rejected_ngrams(labelled.filter("NOT good"))
    marks = labelled.select("good").toArrow()
    good = marks["good"].to_numpy().astype(bool)
    if not len(table) or min(good.sum(), (~good).sum()) < 2:
        return nothing
    shared = context.broadcast(table)
    counted = _counts(labelled, shared).toArrow()
    count = np.zeros((2 * FOLDS, len(table)), np.int32)
    count[counted["kind"].to_numpy(), counted["place"].to_numpy()] = counted["n"].to_numpy()
    target, rejected = count[1::2], count[::2]
    share = good.mean()
    held = np.stack([shrunk_ratios(target.sum(0) - t, rejected.sum(0) - r, share) for t, r in zip(target, rejected, strict=True)])
    scores = _scored(labelled, shared, context.broadcast(held)).join(sample, "doc_id").select("score", "good").toArrow()
    scale, cut = scale_and_cut(scores["score"].to_numpy(), scores["good"].to_numpy().astype(bool))
    return table, shrunk_ratios(target.sum(0), rejected.sum(0), share) * np.float32(scale), cut


def log_weights(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """(doc_id, n_evidence, log_weight) of every document."""
    context = docs.sparkSession.sparkContext
    return _scored(docs, context.broadcast(model[0]), context.broadcast(model[1][None])).withColumnRenamed("score", "log_weight")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise that only depends on the id and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value: bins are counted and narrowed until few rows are left in one."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while True:
        inside = rows.filter(F.col(column).between(low, high))
        width = (high - low) / BINS
        if width == 0 or low + width == low or inside.limit(FEW + 1).count() <= FEW:
            values = [r[0] for r in inside.select(column).orderBy(F.col(column).desc()).limit(FEW).collect()]
            return values[min(k, len(values)) - 1]
        bins = inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)).alias("b")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        for row in sorted(bins.collect(), key=lambda r: -r.b):
            if row.n >= k:
                low, high = row.low, row.high
                break
            k -= row.n


def resample(docs: DataFrame, labels: DataFrame, seed: int = 10, most: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, n_evidence, log_weight, key, kept) of every document."""
    model = fit(docs, labels, most)
    rows = written(log_weights(docs, model).withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "importance")
    reaches = F.lit(1.0) - F.exp(-F.exp(F.least(F.col("log_weight") - F.lit(model[2]), F.lit(50.0))))
    k = round(rows.agg(F.sum(reaches)).first()[0] or 0)
    least = kth_largest(rows, "key", k) if k else float("inf")
    return rows.withColumn("kept", F.col("key") >= F.lit(least))


def keep_sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents of the sample, all columns kept."""
    out = resample(docs, labels).filter(~F.col("kept")).select(F.col("doc_id").alias("out_id")).distinct()
    return docs.join(out, docs["doc_id"].eqNullSafe(out["out_id"]), "left_anti")
