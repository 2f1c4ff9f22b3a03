"""Quality rules as a bitmask ledger (operator 8).

``measure`` reads every whole text once and stores counts; ``ledger`` evaluates every rule once on the
counts and stores one failure bit per rule. A policy is a versioned mask over those bits: applying it,
or asking what each rule alone rejects, is bit arithmetic over the ledger and never reads a text again.

Defined results: null or empty text has no words and all counts 0 (it fails ``few_words``); repeated
rows are judged one by one; a null doc_id is carried along; texts of any length are measured whole; other columns,
whatever their names, are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")



def _rules() -> dict[str, Column]:
    """name -> when a text fails. The position of a rule is its bit, so new rules go to the end."""
    n, c = F.col("n_words"), F.col
    return {
        "few_words": n < 20,
        "repeated_words": 100 * c("n_repeat_words") > 30 * n,
        "symbols": 10 * c("n_symbols") > 3 * n,
        "duplicate_lines": 10 * c("n_dup_lines") > 5 * c("n_lines"),
        "short_words": c("word_chars") < 2 * n,
        "long_words": c("word_chars") > 15 * n,
        "shouting": 10 * c("n_bangs") > 5 * n,
    }


#: version -> rules in force
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words", "shouting"),
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the text, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64) | np.uint64(1)
    size, power = 1, _MULTIPLIER
    while size < window:  # hash of 1, 2, 4, 8 words from two neighbours
        h = h[:-size] * power + h[size:]
        power = np.uint64(int(power) * int(power) & 0xFFFFFFFFFFFFFFFF)
        size *= 2
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    spots = np.flatnonzero(np.isin(h, twice)).tolist()
    seen = Counter(tuple(words[i : i + window]) for i in spots)  # the hash only narrows; the words decide
    covered = np.zeros(len(words) + 1, np.int64)
    for i in spots:
        if seen[tuple(words[i : i + window])] > 1:
            covered[i] += 1
            covered[i + window] -= 1
    return int(np.count_nonzero(np.cumsum(covered)))


def measure_text(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = text.encode().split()  # bytes.split() knows ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        text.count("!!"),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure_text(t.as_py()) for t in batch["text"]]
        columns = zip(*rows, strict=True) if rows else [()] * len(MEASURES)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.int64()) for x in columns)], ["doc_id", *MEASURES])


def measure(docs: DataFrame) -> DataFrame:
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_measured, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements of every document and ``failures``, one bit per rule."""
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, fails in enumerate(_rules().values())]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return measure(docs).withColumn("failures", failures)


def mask(policy: str) -> int:
    names = list(_rules())
    return sum(1 << names.index(r) for r in POLICIES[policy])


def passes(policy: str) -> Column:
    return F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """(rule, n_failed, n_only, kept_without): what each rule of a policy rejects, alone or at all.

    Documents are first counted by their failure bits, so at most 2^rules rows go any further.
    """
    bits = F.col("failures").bitwiseAND(F.lit(mask(policy)))
    by_bits = book.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))
    names = list(_rules())
    one = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    failed = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return by_bits.withColumn("r", one).groupBy("r.rule").agg(
        count(failed).alias("n_failed"),
        count(F.col("bits") == F.col("r.bit")).alias("n_only"),
        count((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit"))).alias("kept_without"),
    )


def verdicts(book: DataFrame, policy: str = "v1") -> DataFrame:
    """A ledger with ``base_failed`` and ``kept`` under a policy."""
    return book.withColumn("base_failed", ~passes("base")).withColumn("kept", passes("base") & passes(policy))


def judge(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger of documents with ``base_failed`` and ``kept`` under a policy."""
    return verdicts(ledger(docs), policy)


def explain(book: DataFrame, policy: str = "v1") -> DataFrame:
    """``verdicts`` with the policy's ablation: ``only_rule``, the one rule that rejects a document (null if several do, or none),
    and ``kept_without``, how many documents the policy would keep without that rule. ``book`` is a stored ledger, read twice.
    """
    bits = F.col("failures").bitwiseAND(F.lit(mask(policy)))
    names = list(_rules())
    only = F.coalesce(*[F.when(bits == 1 << names.index(r), F.lit(r)) for r in POLICIES[policy]])
    figures = ablations(book, policy).select(F.col("rule").alias("only_rule"), "kept_without")  # a row per rule
    return verdicts(book, policy).withColumn("only_rule", only).join(figures, "only_rule", "left")
