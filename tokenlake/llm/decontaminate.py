"""Benchmark decontamination by a BM25 index with block-max pruning (operator 3).

The test items are the indexed side: the question part (first half) and the answer part (second half)
of each item are segments of their own, an item of fewer than ten words is one segment, and every term has
a posting list (segment, BM25 impact) laid out in blocks of ``BLOCK_SEGMENTS`` segments with the largest
impact of each block. Every training document is a query against the index: its words that lie in a
shingle which some item has, wherever they stand. A document is first bounded by the largest impacts of its
terms, then block by block, and only blocks whose bound reaches the smallest threshold in the block are
scored in full, so all segments above the threshold are found.

An item has leaked into a document when the document has at least ``OVERLAP`` of the five-word shingles
of the question part and of the answer part. A segment's threshold is the least score that this rule
allows, so retrieval loses nothing that the rule confirms: with a word's impact dealt evenly over its places
in the segment, every shingle is worth the mean of its places, no place is in more than five shingles,
and the score is at least the sum of the ``OVERLAP`` cheapest shingles. Documents in which all segments of
an item are retrieved are verified on the words.

The index is a function of the benchmark alone; a benchmark of more than ``MAX_INDEX_WORDS`` words is
taken in batches of items, one pass over the documents per batch, so what is sent to the executors
has a bound (an item longer than that is a batch of its own). The statistics are those of the whole benchmark, so scores
do not depend on the batches.

Defined results: null or empty documents and items leak nothing; repeated items and documents each
count; texts of any length are searched whole; other columns, whatever their names, are ignored or kept by ``decontaminate``;
the score is the sum over the item's segments; items of fewer than five words are compared as one shingle of all their words.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import WORD_PATTERN, small_batches, written
from tokenlake.llm.ngrams import MULTIPLIER, SpanHashes, documents_of_words, mixed, portions, texts_of

SEGMENT_WORDS = 64
BLOCK_SEGMENTS = 16
SHARE = 0.6
OVERLAP = 0.5
SHINGLE = 5
K1, B = 1.2, 0.75
MAX_INDEX_WORDS = 2_000_000


@dataclass
class Index:
    """Posting lists of a batch of items, and the items' words for the verification."""

    item_ids: list
    words: list[list[bytes]]  # of each item
    segment_item: np.ndarray
    threshold: np.ndarray  # of each segment
    block_threshold: np.ndarray
    terms: np.ndarray  # sorted word hashes
    post_start: np.ndarray  # of each term, into the postings
    post_segment: np.ndarray
    post_impact: np.ndarray
    top: np.ndarray  # largest impact of each term
    block_start: np.ndarray  # of each term, into the block maxima
    block_id: np.ndarray
    block_max: np.ndarray
    shingles: dict[int, np.ndarray]  # sorted hashes of the segments' shingles, by their number of words


def parts_of(item: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Question and answer part; a short item is both."""
    half = (len(item) + 1) // 2
    return (item[:half], item[half:]) if len(item) >= 2 * SHINGLE else (item, item)


def span_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` words, from the hashes of the words."""
    n = max(0, len(words) - size + 1)
    h = words[:n]
    for k in range(1, size):
        h = h * MULTIPLIER + words[k : k + n]
    return mixed(h)


def least_score(impact: np.ndarray, spans: np.ndarray, size: int) -> float:
    """The least score of a document with OVERLAP of a segment's shingles, given the impact of every place."""
    upto = np.concatenate([[0.0], np.cumsum(impact)])
    worth = (upto[size:] - upto[:-size])[np.unique(spans, return_index=True)[1]] / size
    return float(np.sort(worth)[: math.ceil(len(worth) * OVERLAP - 1e-9)].sum()) * (1 - 1e-9)


@dataclass(frozen=True)
class Statistics:
    """What BM25 needs to know of all segments: how many there are, their mean length, and in how many each word stands."""

    segments: int
    mean: float
    found: Mapping[bytes, int]  # for the words of the items to be indexed at least


def build_index(items: list[tuple[object, str | None]], halves: bool = False, known: Statistics | None = None) -> Index | None:
    """Index of question and answer parts with the thresholds of the overlap rule, or else of runs of SEGMENT_WORDS with SHARE.

    ``known`` has the statistics of the whole benchmark where ``items`` are only a part of it.
    """
    words = [(t or "").encode().split() for _, t in items]
    if halves:
        segments = [(i, p) for i, w in enumerate(words) if w for p in parts_of(w)[: 1 + (len(w) >= 2 * SHINGLE)]]
    else:
        segments = [(i, w[a : a + SEGMENT_WORDS]) for i, w in enumerate(words) for a in range(0, len(w), SEGMENT_WORDS)]
    if not segments:
        return None
    vocabulary = sorted({x for _, s in segments for x in s})
    starts, hashes = SpanHashes().words(b" ".join(vocabulary))
    place = dict(zip(vocabulary, hashes.tolist(), strict=True))
    if known is None:
        lengths = [len(s) for _, s in segments]
        known = Statistics(len(segments), sum(lengths) / len(lengths), Counter(x for _, s in segments for x in set(s)))
    rows = []
    for k, (_, s) in enumerate(segments):
        for x, tf in Counter(s).items():
            idf = math.log(1 + (known.segments - known.found[x] + 0.5) / (known.found[x] + 0.5))
            rows.append((place[x], k, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(s) / known.mean))))
    rows.sort()
    term = np.array([r[0] for r in rows], np.uint64)
    segment, impact = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    terms, start = np.unique(term, return_index=True)
    key = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (segment[1:] // BLOCK_SEGMENTS != segment[:-1] // BLOCK_SEGMENTS)])
    own = np.bincount(segment, impact, len(segments)) * SHARE
    shingles_of: dict[int, list[np.ndarray]] = {}
    if halves:
        weight = {(k, t): x for t, k, x in rows}
        for k, (_, s) in enumerate(segments):
            size, at = min(SHINGLE, len(s)), [place[x] for x in s]
            spans, tf = span_hashes(np.array(at, np.uint64), size), Counter(at)
            own[k] = least_score(np.array([weight[k, t] / tf[t] for t in at]), spans, size)
            shingles_of.setdefault(size, []).append(spans)
    return Index(
        [i for i, _ in items], words, np.array([i for i, _ in segments]), own,
        np.minimum.reduceat(own, np.arange(0, len(own), BLOCK_SEGMENTS)), terms, np.append(start, len(term)), segment, impact,
        np.maximum.reduceat(impact, start), np.append(np.searchsorted(key, start), len(key)), segment[key] // BLOCK_SEGMENTS,
        np.maximum.reduceat(impact, key), {n: np.unique(np.concatenate(x)) for n, x in shingles_of.items()},
    )


def _spread(which: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for every place of the ranges starts[which] .. starts[which + 1]."""
    n = starts[which + 1] - starts[which]
    row = np.repeat(np.arange(len(which)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + starts[which][row]


def _summed(a: np.ndarray, b: np.ndarray, width: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of x by the pair (a, b)."""
    pair, where = np.unique(a * width + b, return_inverse=True)
    return pair // width, pair % width, np.bincount(where, x, len(pair))


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, segment, score) above the segment's threshold, for distinct (passage, index term) pairs."""
    none = np.zeros(0, np.int64)
    if not len(passage):
        return none, none, np.zeros(0)
    bound = np.bincount(passage, index.top[term])
    keep = bound[passage] >= index.threshold.min() - 1e-9
    passage, term = passage[keep], term[keep]
    row, at = _spread(term, index.block_start)
    p, block, most = _summed(passage[row], index.block_id[at], len(index.block_threshold), index.block_max[at])
    keep = most >= index.block_threshold[block] - 1e-9
    alive = np.sort(p[keep] * len(index.block_threshold) + block[keep])
    if not len(alive):
        return none, none, np.zeros(0)
    in_alive = np.isin(passage, p[keep])
    passage, term = passage[in_alive], term[in_alive]
    row, at = _spread(term, index.post_start)
    pair = passage[row] * len(index.block_threshold) + index.post_segment[at] // BLOCK_SEGMENTS
    keep = np.isin(pair, alive)
    p, segment, score = _summed(passage[row][keep], index.post_segment[at][keep], len(index.threshold), index.post_impact[at][keep])
    keep = score >= index.threshold[segment] - 1e-9
    return p[keep], segment[keep], score[keep]


def shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def overlaps(item: list[bytes], doc: list[bytes]) -> tuple[float, float]:
    """Shares of the question's and of the answer's shingles that the document has."""
    parts = parts_of(item)
    size = min(SHINGLE, *map(len, parts))
    has = {tuple(doc[i : i + size]) for i in range(len(doc) - size + 1)}
    asked = [{tuple(p[i : i + size]) for i in range(len(p) - size + 1)} for p in parts]
    return tuple(len(x & has) / len(x) for x in asked)


def _search(index: Index, hasher: SpanHashes, texts: list[bytes]) -> list[tuple[int, int, float, float, float]]:
    """(text, item, score, question, answer) of every item that leaked into a text."""
    hashes, doc, _ = documents_of_words(hasher, texts)
    inside = np.zeros(len(hashes), bool)  # words in a shingle that some item has
    for size, known in index.shingles.items():
        spans = span_hashes(hashes, size)
        spot = np.minimum(np.searchsorted(known, spans), len(known) - 1)
        at = np.flatnonzero((known[spot] == spans) & (doc[: len(spans)] == doc[size - 1 :]))
        for k in range(size):
            inside[at + k] = True
    place = np.flatnonzero(inside)
    term = np.minimum(np.searchsorted(index.terms, hashes[place]), len(index.terms) - 1)
    known = index.terms[term] == hashes[place]
    pair = np.unique(doc[place][known] * len(index.terms) + term[known])
    where, segment, score = retrieve(index, pair // len(index.terms), pair % len(index.terms))
    hits: dict[tuple[int, int], list[float]] = {}
    for d, s, x in zip(where.tolist(), segment.tolist(), score.tolist(), strict=True):
        hits.setdefault((d, int(index.segment_item[s])), []).append(x)
    segments = np.bincount(index.segment_item, minlength=len(index.words))
    found = {key: sum(x) for key, x in hits.items() if len(x) == segments[key[1]]}
    out, split = [], {}
    for (d, i), x in sorted(found.items()):
        if d not in split:
            split[d] = texts[d].split()
        q, a = overlaps(index.words[i], split[d])
        if q >= OVERLAP and a >= OVERLAP:
            out.append((d, i, x, q, a))
    return out


def _batches_of_items(benchmark: DataFrame) -> Iterator[list]:
    batch, size = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = len((row.text or "").split())
        if batch and size + n > MAX_INDEX_WORDS:
            yield batch
            batch, size = [], 0
        batch.append((row.item_id, row.text))
        size += n
    if batch:
        yield batch


def _segments(benchmark: DataFrame) -> DataFrame:
    """(words): the question and answer parts of every item, as ``parts_of`` cuts them."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN), F.lit(0))
    n = F.size("words")
    half = F.floor((n + 1) / 2).cast("int")
    parts = F.when(n >= 2 * SHINGLE, F.array(F.slice("words", F.lit(1), half), F.slice("words", half + 1, n))).otherwise(F.array("words"))
    return benchmark.select(words.alias("words")).where(n > 0).select(F.explode(parts).alias("words"))


def _statistics(segments: DataFrame, counts: DataFrame, batch: list) -> Statistics:
    """Statistics of the whole benchmark for the words of one batch, which bounds what the driver gets."""
    total = segments.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("words")).first()
    mine = segments.sparkSession.createDataFrame([(w.decode(),) for w in {x for _, t in batch for x in (t or "").encode().split()}], "word string")
    return Statistics(total.n, total.words / total.n, {r.word.encode(): r.n for r in counts.join(mine, "word").toLocalIterator()})


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap), one row per leaked item and document."""
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double"
    rows = docs.select("doc_id", "text")
    batches = _batches_of_items(benchmark)
    first, second = next(batches, None), next(batches, None)
    if second is None:  # the batch is the whole benchmark
        index = build_index(first or [], halves=True)
        return _leaks_of(rows, spark.sparkContext.broadcast(index), schema) if index else spark.createDataFrame([], schema)
    segments = written(_segments(benchmark), "benchmark-segments")
    counts = written(segments.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "benchmark-words")
    found = []
    for batch in chain([first, second], batches):  # one index at a time
        if index := build_index(batch, halves=True, known=_statistics(segments, counts, batch)):
            sent = spark.sparkContext.broadcast(index)
            found.append(written(_leaks_of(rows, sent, schema), "leaks"))
            sent.unpersist()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def _leaks_of(docs: DataFrame, index, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHashes()
        for batch in small_batches(batches):
            texts = texts_of(batch)
            for at, to in portions(texts):
                rows = _search(index.value, hasher, texts[at:to])
                ids = pa.array([index.value.item_ids[r[1]] for r in rows], out.field(1).type)
                docs_at = batch["doc_id"].take(pa.array([at + r[0] for r in rows], pa.int64()))
                rest = [pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([docs_at, ids, *rest], out.names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))
    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents into which no item leaked, all columns kept."""
    leaked = find_leaks(docs, benchmark).select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["leaked_id"]), "left_anti")
