"""Rows that operators must survive: nulls everywhere, empty and long texts, repeats, clashing column names."""

from pyspark.sql import functions as F

LONG = " ".join(f"long{i % 977} word{i}" for i in range(30_000))


def awkward(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [
        (1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", "b", 4),
        (None, text, "en", None, 9), (None, None, None, None, None), (5, LONG, "en", "b", 1), (6, LONG + " end", "en", "b", 1),
        (7, "ä" * 400 + "\n" + "ä" * 400, "de", "a", 1), (8, "few words", "en", "c", 1), (-9, "few words", "en", "c", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for clash in ("size", "skey", "u", "v", "n", "row", "part", "kind", "band", "bucket", "class_id", "mix_doc_", "mix_doc", "mix_source", "mix_times", "mix_copy", "mix", "target", "words", "shard", "same", "kept",
                  "skey", "gkey", "digest", "claimed", "tie", "slice", "idx", "block", "spans", "failures", "only_rule", "ukey", "node"):
        docs = docs.withColumn(clash, F.lit("clash"))
    return docs


def empty(df):
    return df.filter("false")
