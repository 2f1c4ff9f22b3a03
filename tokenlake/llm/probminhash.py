"""Near-duplicate documents by ProbMinHash over weighted five-word shingles (operator 6).

Every distinct shingle of a document is a Poisson process whose rate is its weight, 1 + ln(count); each
arrival falls into one of ``REGISTERS`` registers, a register keeps the shingle that arrives first, and
a shingle stops as soon as its next arrival is later than everything the registers hold. Two documents
agree in a register with their probability Jaccard similarity. ``BANDS`` bands of ``ROWS`` registers find
candidates. A document with repeated shingles has a second sketch with all weights 1, whose registers agree
with the Jaccard similarity of the distinct shingles; without repeats both sketches are the same. So at
similarity 0.8 a pair is missed with probability (1 - 0.8^4)^30, about 1e-7, whatever is repeated, and each
candidate pair is verified with the exact Jaccard similarity of the distinct shingles, 0.8 or more.

Texts with the same words are one class from the start. In a bucket, members are compared with one
leader, not with each other; connected components of the verified links become classes. Another
leader is then tried for members that are still apart. What remains apart after that is paired by an
exact rule: two texts of 0.8 or more share one of the rarest 20 % of the shingles of each, and only
shingles that two classes have can be shared between them. So a bucket of thousands of copies costs a
multiple of its members, texts too far from all others drop out without a comparison, and no link between
two classes is lost.

Defined results: documents without words are classes of their own; texts of fewer than five words have
one shingle, all their words; rows of one doc_id count as one document; rows without doc_id are left
out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenlake.llm.common import written
from tokenlake.llm.components import connected_components
from tokenlake.llm.ngrams import MULTIPLIER, SpanHashes, documents_of_words, mixed, portions, power, texts_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 4
REGISTERS = BANDS * ROWS
_LOW = np.uint64(0xFFFFFFFF)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: np.ndarray, doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every five-word window; a shorter document has one of all its words."""
    pairs = words[:-1] * power(1) + words[1:]
    h = (pairs[:-3] * power(2) + pairs[2:-1]) * MULTIPLIER + words[4:] if len(words) > 4 else words[:0]
    own = doc[: len(h)]
    whole = own == doc[4 : 4 + len(h)]
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE))
    few = np.array([np.bitwise_xor.reduce(mixed(words[first[d] : first[d + 1]] + np.arange(1, 1 + first[d + 1] - first[d], dtype=np.uint64)))
                    for d in short], np.uint64)
    return np.concatenate([own[whole], short]), mixed(np.concatenate([h[whole], few]))


def weighted_shingles(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) with weight 1 + ln(count)."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])[: len(h)])
    return doc[new], h[new], 1 + np.log(np.diff(np.append(new, len(h))))


def prob_min_hash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """(n_docs, registers) signatures: in each register, 32 bits of the shingle that arrives first.

    One round of the loop is the next arrival of every shingle still running. Arrival time and shingle
    share a 64-bit number, time first, so the minimum keeps both.
    """
    held = np.full(n_docs * registers, _NEVER)
    time = np.zeros(len(h))
    round_ = 0
    while len(h):
        round_ += 1
        draw = mixed(h + np.uint64(round_ * int(MULTIPLIER) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / weight
        register = ((mixed(draw ^ MULTIPLIER) >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
        packed = time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | (h & _LOW)
        np.minimum.at(held, doc * registers + register.astype(np.int64), packed)
        latest = (held.reshape(n_docs, registers).max(axis=1) >> np.uint64(32)).astype(np.uint32)
        full = latest != np.uint32(0xFFFFFFFF)
        limit = np.where(full, latest.view(np.float32), np.inf)
        on = time < limit[doc]
        doc, h, weight, time = doc[on], h[on], weight[on], time[on]
    return (held & _LOW).astype(np.uint64).reshape(n_docs, registers)


def band_hashes(signatures: np.ndarray) -> np.ndarray:
    """(n_docs, BANDS) 64-bit hashes, different for different bands."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS)
    h = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * MULTIPLIER), rows.shape[:2])
    for k in range(ROWS):
        h = mixed(h * MULTIPLIER + rows[:, :, k])
    return h


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = SpanHashes()
    for batch in batches:
        texts = texts_of(batch)
        for at, to in portions(texts):
            words, doc, first = documents_of_words(hasher, texts[at:to])
            rows, h, weight = weighted_shingles(*shingle_hashes(words, doc, first))
            bands = band_hashes(prob_min_hash(rows, h, weight, to - at)).view(np.int64)
            full = np.diff(first) > 0
            again = np.zeros(to - at, bool)  # documents with repeated shingles
            again[rows[weight > 1]] = True
            own = again[rows]
            unit = band_hashes(prob_min_hash((np.cumsum(again) - 1)[rows[own]], h[own], np.ones(own.sum()), again.sum())).view(np.int64)
            bands = np.concatenate([bands[full], unit])
            bands = bands[np.argsort(np.concatenate([np.flatnonzero(full), np.flatnonzero(again)]), kind="stable")]
            split = (texts[k].split() if full[k - at] else None for k in range(at, to))
            same = [w and hashlib.md5(b" ".join(w)).digest() for w in split]
            ends = pa.array(np.concatenate([[0], np.cumsum((full.astype(int) + again) * BANDS)]).astype(np.int32))
            flat = pa.ListArray.from_arrays(ends, pa.array(bands.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, to - at), pa.array(same, pa.binary()), flat], ["doc_id", "same", "bands"])


def _similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact Jaccard similarity of two texts; a leader's shingles are kept while rows of it follow."""
    hasher, held, own = SpanHashes(), None, None

    def shingles(text: str) -> np.ndarray:
        return np.unique(shingle_hashes(*documents_of_words(hasher, [text.encode()]))[1])

    for batch in batches:
        leaders, members = batch["u"].to_pylist(), batch["v"].to_pylist()
        out = []
        for u, a, b in zip(leaders, batch["u_text"], batch["v_text"], strict=True):
            if u != held:
                held, own = u, shingles(a.as_py())
            other = shingles(b.as_py())
            both = len(np.intersect1d(own, other, assume_unique=True))
            out.append(both / (len(own) + len(other) - both))
        yield pa.RecordBatch.from_arrays([pa.array(leaders, pa.int64()), pa.array(members, pa.int64()), pa.array(out, pa.float64())], ["u", "v", "similarity"])


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(u, v, similarity) of candidate pairs, by the exact shingles of both texts."""
    texts = docs.select("doc_id", "text")
    member = pairs.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("v_text")), "v")
    both = member.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("u_text")), "u")
    return both.select("u", "v", "u_text", "v_text").mapInArrow(_similarities, "u long, v long, similarity double")


def _led_pairs(buckets: DataFrame, order: Column) -> DataFrame:
    """(u, v): each bucket's members in another class than its leader, the first in ``order``, with that leader."""
    leader = F.min_by(F.struct("doc_id", "class_id"), order).alias("leader")
    led = buckets.join(buckets.groupBy("band").agg(leader, F.count("*").alias("n")).filter("n > 1"), "band")
    apart = led.filter(F.col("leader.class_id") != F.col("class_id"))
    return _ordered(apart.select(F.col("leader.doc_id").alias("a"), F.col("doc_id").alias("b")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _distinct_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = SpanHashes()
    for batch in batches:
        texts = texts_of(batch)
        for at, to in portions(texts):
            doc, h, _ = weighted_shingles(*shingle_hashes(*documents_of_words(hasher, texts[at:to])))
            rows = pa.array(doc + at)
            n = pa.array(np.bincount(doc, minlength=to - at)[doc])
            columns = [batch["doc_id"].take(rows), batch["class_id"].take(rows), n, pa.array(h.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "class_id", "n", "shingle"])


def _apart_pairs(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): all pairs of 0.8 or more, and few others, among members of a bucket that are in different classes.

    Prefix filter: with the shingles of all texts in one order, rarest first, a text of n shingles shares one
    of its first n - ceil(0.8 n) + 1 with a similar text that is not longer, and that one has it among its first
    n - ceil(2 * 0.8 / 1.8 n) + 1. What follows the first shingle that they share must be long enough for
    the overlap that is missing. Shingles of one class alone come first of all; a text with more of them than
    its prefix has no partner.
    """
    several = buckets.groupBy("band").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).filter("low <> high")
    apart = buckets.join(several.select("band"), "band", "left_semi").select("doc_id", "class_id").distinct()
    rows = texts.join(apart, "doc_id").select("doc_id", "class_id", "text")
    rows = written(rows.mapInArrow(_distinct_shingles, "doc_id long, class_id long, n long, shingle long"), "near-shingles")
    found = rows.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("class_id").alias("low"), F.max("class_id").alias("high"))
    shared = rows.join(found.filter("low <> high").select("shingle", "texts"), "shingle")
    own = Window.partitionBy("doc_id")
    place = F.row_number().over(own.orderBy("texts", "shingle")) + F.col("n") - F.count("*").over(own)
    prefix = shared.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1)
    prefix = written(prefix.select("doc_id", "class_id", "n", "shingle", "place"), "near-prefixes")
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("doc_id", "class_id", "n", "place")]
    share = 2 * SIMILARITY / (1 + SIMILARITY)
    longer = prefix.select("shingle", *side("a"))
    shorter = prefix.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).select("shingle", *side("b"))
    overlap = (F.col("a_n") + F.col("b_n")) * (share / 2) - 1e-9
    near = (
        (F.col("a_class_id") != F.col("b_class_id"))
        & F.col("b_n").between(F.col("a_n") * (SIMILARITY - 1e-9), F.col("a_n"))
        & (1 + F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place")) >= overlap)
    )
    met = longer.join(shorter, (longer["shingle"] == shorter["shingle"]) & near)
    return _ordered(met.select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")))


def _classed(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` (doc_id, bands) with class_id, the smallest doc_id reached over ``links``."""
    groups = connected_components(links.select("u", "v"))
    joined = members.join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    return joined.withColumn("class_id", F.coalesce("component", "doc_id")).drop("component")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): one row per document; class_id is the smallest doc_id of its class."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id IS NOT NULL")
    sketches = written(docs.mapInArrow(_sketched, "doc_id long, same binary, bands array<long>"), "sketches")
    texts = sketches.filter("same IS NOT NULL").groupBy("same").agg(F.min_by(F.struct("doc_id", "bands"), "doc_id").alias("r"))
    distinct = texts.select("r.doc_id", "r.bands")
    members = _shared_bands(distinct)
    links, tried = None, None
    steps = [
        lambda b: _led_pairs(b, F.col("doc_id")),
        lambda b: _led_pairs(b, F.xxhash64("band", "doc_id")),
        lambda b: _apart_pairs(b, involved),
    ]
    classed = members.withColumn("class_id", F.col("doc_id"))
    involved = written(docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "near-texts")
    for step in steps:
        pairs = step(classed)
        pairs = written(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"), "near-pairs")
        if pairs.isEmpty():
            continue
        tried = pairs if tried is None else tried.unionByName(pairs)
        good = written(verify(pairs, involved).filter(F.col("similarity") >= SIMILARITY).select("u", "v"), "near-links")
        if not good.isEmpty():
            links = good if links is None else links.unionByName(good)
            classed = written(_classed(members, links), "near-classes")
    classes = classed.select("doc_id", "class_id").distinct()
    own = texts.select("same", F.col("r.doc_id").alias("rep")).join(classes, F.col("rep") == classes["doc_id"], "left")
    own = own.select("same", F.coalesce("class_id", "rep").alias("class_id"))
    rows = sketches.select("doc_id", "same").join(own, "same", "left")
    return rows.groupBy("doc_id").agg(F.coalesce(F.min("class_id"), F.col("doc_id")).alias("class_id"))


def _shared_bands(distinct: DataFrame) -> DataFrame:
    """(doc_id, band) rows of buckets with two members or more, written once."""
    rows = distinct.select("doc_id", F.explode(F.array_distinct("bands")).alias("band"))
    several = rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    return written(rows.join(several, "band", "left_semi"), "near-bands")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of every class, once, all columns kept; rows without doc_id stay."""
    kept = near_duplicates(docs).filter("doc_id = class_id").select(F.col("doc_id").alias("kept_id"))
    named = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id IS NULL"))
