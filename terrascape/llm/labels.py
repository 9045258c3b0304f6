"""The bounded sample of labelled rows that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: tuple[int, int], train_rows: int, longest: int) -> list[tuple[str, int]]:
    """(text, 0 or 1) of at most train_rows labelled rows, half of each class, those with the least md5 of their id.

    Rows whose crc32(doc_id as text) modulo fold[0] is fold[1] are left out, as are texts of more than `longest` bytes, null labels and
    null ids. A label that repeats counts once, the larger one; a doc_id that repeats in docs gives each of its texts, within
    train_rows; a null text counts as empty.
    """
    crc: Column = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(fold[0]))
    mine = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc != fold[1]))
    mine = mine.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    halves = [mine.where(F.col("_label") == c).orderBy(order, "doc_id").limit(train_rows // 2) for c in (0, 1)]
    chosen = F.broadcast(halves[0].unionByName(halves[1]))  # at most train_rows ids
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    rows = texts.where(F.octet_length("_text") <= longest).join(chosen, "doc_id").orderBy(order, "doc_id", "_text").limit(train_rows).collect()
    return [(r["_text"], r["_label"]) for r in rows]
