"""Mixing sources to target weights by a low-discrepancy schedule (operator 1).

Words of a source form one endless stream: its documents in a seeded shuffle, repeated epoch after
epoch. The stream is cut into blocks of ``block_words`` words. The schedule is the van der Corput
sequence in base 2: point ``n`` falls on grid cell ``bitreverse(n)`` of ``2^m`` cells, the cells are
shared out by cumulative target weight, and the j-th point of a source takes its j-th block. Every
prefix of the schedule is therefore close to the targets, and each source gets exactly as many slots
as its target needs, the last one cut to the word.

Everything is DataFrame operations. A hot source is split: running sums and ranks are computed
within (source, slice) and shifted by the sums of the slices before.

Defined results: null text has size 0; a null source is a source of its own, last in order; documents
without words take nothing; repeated rows are documents of their own; documents with one shuffle key go by doc_id, then
size; a document longer than a block is taken by several slots; an empty table gives no rows; other columns, whatever their
names, are kept by ``mixed_documents`` and ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenlake.llm.common import WORD_PATTERN, written

BLOCK_WORDS = 1024
MAX_EPOCHS = 3
#: hex digits of the shuffle key that name a slice: 4096 slices in each source
SLICE_DIGITS = 3
#: slots of a source that are laid out by one task at a time
SLOT_CHUNK = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null: joins on it keep the null source."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def cycled_weights(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row per source with ``weight``: sources in code-point order, null last, weights repeating."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place % len(weights) + 1).cast("long"))


def targets(weighted: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` (double): shares of all words by weight, none above ``max_epochs`` x its size.

    What a full source leaves over is shared out by weight again. In order of size / weight the full
    sources come first, so the first source whose share fits settles the rate of all that follow.
    ``weighted`` has one row per source.
    """
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "skey")
    rest = (
        weighted.withColumn("cap", cap)
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("left", F.col("total") - F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("cap"))
        .withColumn("weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    )
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("weights")
    rate = F.first(F.when(fits, F.struct("left", "weights")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    share = (F.col("rate.left") * F.col("weight")).cast("double") / F.col("rate.weights")
    return rest.withColumn("rate", rate).select(
        "skey", "source", "source_size", "weight", F.least(F.col("cap").cast("double"), share).alias("target")
    )


def shuffled_stream(sized: DataFrame, seed: str) -> DataFrame:
    """Adds ``first_word``: where the document starts in its source's shuffled stream."""
    keyed = sized.withColumn("mix", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("slice", F.substring("mix", 1, SLICE_DIGITS))
    sums = keyed.groupBy("skey", "slice").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("skey").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("skey", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("skey", "slice").orderBy("mix", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.withColumn("upto", F.sum("size").over(within))
        .join(sums, ["skey", "slice"])
        .withColumn("first_word", F.col("offset") + F.col("upto") - F.col("size"))
        .drop("mix", "slice", "upto", "offset")
    )


def schedule(shares: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(skey, block, point): the source's ``block`` is taken at ``point`` of the low-discrepancy sequence."""
    total = shares.agg(F.sum("target")).first()[0] or 0.0
    bits = max(1, (int(total) // block_words + 1).bit_length())
    cells = float(1 << bits)
    upto = F.sum("target").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, 0))
    spans = (
        shares.withColumn("upto", upto)
        .withColumn("words", F.floor("target"))
        .filter("words > 0")
        .withColumn("lo", F.floor((F.col("upto") - F.col("target")) / F.lit(total or 1.0) * cells))
        .withColumn("hi", F.least(F.ceil(F.col("upto") / F.lit(total or 1.0) * cells), F.lit(1 << bits)))
        .withColumn("lo", F.least("lo", F.col("hi") - F.ceil(F.col("words") / block_words)))
    )
    cell = (
        spans.select("skey", "words", "lo", "hi", F.explode(F.expr(f"sequence(0L, (hi - lo - 1) div {SLOT_CHUNK})")).alias("chunk"))
        .repartition("skey", "chunk")
        .select(
            "skey", "words",
            F.explode(F.expr(f"sequence(lo + chunk * {SLOT_CHUNK}L, least(hi, lo + (chunk + 1) * {SLOT_CHUNK}L) - 1)")).alias("cell"),
        )
    )
    point = F.conv(F.reverse(F.lpad(F.conv(F.col("cell").cast("string"), 10, 2), bits, "0")), 2, 10).cast("long")
    points = cell.withColumn("point", point).withColumn("chunk", F.expr(f"point div {SLOT_CHUNK}"))
    # written: rows made from a few source rows look small to the planner, which would broadcast them
    points = written(points.select("skey", "words", "point", "chunk"), "mix-points")
    counts = points.groupBy("skey", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("skey", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("skey", "chunk").orderBy("point")) - 1
    slots = (
        points.withColumn("rank", rank)
        .join(counts, ["skey", "chunk"])
        .withColumn("block", F.col("rank") + F.col("offset"))
        .filter(F.col("block") * block_words < F.col("words"))
        .select("skey", "block", "point")
    )
    return written(slots, "mix-slots")


def placements(stream: DataFrame, shares: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS,
               max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per (document, epoch, slot): the words of the document that the slot takes."""
    epochs = F.array(*[F.lit(e).cast("long") for e in range(max_epochs)])
    words = F.floor("target")
    parts = (
        stream.filter("size > 0")
        .join(shares.select("skey", "source_size", "target"), "skey")
        .withColumn("epoch", F.explode(epochs))
        .withColumn("start", F.col("first_word") + F.col("epoch") * F.col("source_size"))
        .filter(F.col("start") < words)
        .withColumn("end", F.least(F.col("start") + F.col("size"), words))
        .withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (end - 1) div {block_words})")))
    )
    taken = F.least("end", (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words)
    return parts.join(slots, ["skey", "block"]).withColumn("words", taken)


def _spots(docs: DataFrame, weights: tuple[int, ...], block_words: int, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents in their streams, targets, placements)."""
    sized = written(
        docs.select("doc_id", "source", source_key(F.col("source")).alias("skey"), word_count(F.col("text")).alias("size")),
        "mix-sizes",
    )
    sizes = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    shares = written(targets(cycled_weights(sizes, weights)), "mix-targets")
    stream = shuffled_stream(sized, seed)
    return stream, shares, placements(stream, shares, schedule(shares, block_words), block_words)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), block_words: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): ``taken`` counts the words the mix takes, repeats included."""
    stream, shares, spots = _spots(docs, weights, block_words, seed)
    # a document with words has a first_word of its own; those without words take nothing
    key = ["skey", "first_word", "size"]
    taken = spots.groupBy(*key).agg(F.sum("words").alias("taken"))
    rows = stream.filter("size > 0").join(taken, key, "left").unionByName(
        stream.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    )
    return rows.join(shares.select("skey", "source_size", "target"), "skey").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), block_words: int = BLOCK_WORDS, seed: str = "mix") -> DataFrame:
    """The documents the mix takes, whole, once for every epoch in which it takes words of them; all columns kept.

    Rows with one doc_id and source are taken alike.
    """
    _, _, spots = _spots(docs, weights, block_words, seed)
    per_row = spots.groupBy("skey", "doc_id", "first_word").agg(F.countDistinct("epoch").alias("times"))
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("mix_doc")
    times = per_row.groupBy(name, F.col("skey").alias("mix_source")).agg(F.max("times").alias("mix_times"))
    # the document travels as one struct, so its columns may have any names
    keyed = docs.select(F.struct(*docs.columns).alias("row"), name, source_key(F.col("source")).alias("mix_source"))
    repeated = keyed.join(times, ["mix_doc", "mix_source"]).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times").cast("int"))))
    return repeated.select("row.*")
