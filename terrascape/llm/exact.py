"""Exact deduplication by a log-structured merge index of text digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Stash

#: Bits of one block of a run's filter; fixed by Spark's bitmap functions.
BLOCK_BITS = 32768


def digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


#: Largest filter that is broadcast, in bytes (a larger one is joined by block), and most shared digests that are.
BROADCAST_BYTES, BROADCAST_ROWS = 8 << 20, 100_000


class BitmapFilter:
    """Bitmap of a table's digests: no false negatives, about 1/bits false positives."""

    def __init__(self, table: DataFrame, stash: Stash, bits: int = 16):
        self.blocks = max(1, -(-table.count() * bits // BLOCK_BITS))
        spot = self._spot()
        marks = table.select(F.bitmap_bucket_number(spot).alias("_block"), F.bitmap_bit_position(spot).alias("_bit"))
        self.table = stash.keep(marks.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "filter")

    def _spot(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.blocks * BLOCK_BITS)) + 1

    def candidates(self, batch: DataFrame) -> DataFrame:
        """The rows of batch whose digest may stand in the table."""
        spot = self._spot()
        bits = F.broadcast(self.table) if self.blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES else self.table
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        may = batch.withColumn("_block", F.bitmap_bucket_number(spot)).withColumn("_bit", F.bitmap_bit_position(spot)).join(bits, "_block")
        return may.where(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1).drop("_block", "_bit", "_bits")


class DigestIndex:
    """Memtables flush sorted digest runs with bitmap filters; compaction merges runs and keeps one identifier a digest.

    keep: "max" or "min", which identifier of equal texts stays. A run has one row a digest: digest, keep_id, n; it is
    range-partitioned and sorted by digest. Its filter has about filter_bits bits a digest.
    """

    def __init__(self, stash: Stash, keep: str = "max", fanout: int = 4, filter_bits: int = 16):
        self.stash, self.fanout, self.filter_bits = stash, fanout, filter_bits
        self.pick = {"max": F.max, "min": F.min}[keep]
        self.runs: list[tuple[int, DataFrame]] = []
        self.filters: dict[str, BitmapFilter] = {}

    def _write(self, level: int, run: DataFrame) -> None:
        run = self.stash.keep(run.repartitionByRange("digest").sortWithinPartitions("digest"), f"run-l{level}")
        self.filters[run._stash_path] = BitmapFilter(run, self.stash, self.filter_bits)
        self.runs.append((level, run))

    def flush(self, memtable: DataFrame) -> None:
        """memtable: digest, doc_id. Writes a sorted run with its filter; compacts when fanout runs of a level have gathered."""
        self._write(0, memtable.groupBy("digest").agg(self.pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
        level = 0
        while sum(at == level for at, _ in self.runs) >= self.fanout:
            self._merge([r for r in self.runs if r[0] == level], level + 1)
            level += 1

    def _merge(self, old: list[tuple[int, DataFrame]], level: int) -> None:
        merged = old[0][1]
        for _, run in old[1:]:
            merged = merged.unionByName(run)
        self.runs = [r for r in self.runs if not any(r is o for o in old)]
        self._write(level, merged.groupBy("digest").agg(self.pick("keep_id").alias("keep_id"), F.sum("n").alias("n")))
        self.stash.drop(*(run for _, run in old), *(self.filters.pop(run._stash_path).table for _, run in old))

    def compact(self) -> DataFrame:
        """Merges all runs into one and returns it."""
        if len(self.runs) > 1:
            self._merge(list(self.runs), max(level for level, _ in self.runs) + 1)
        return self.runs[0][1]

    def probe(self, batch: DataFrame) -> DataFrame:
        """batch: digest, doc_id, ... -> its rows whose digest stands in a run, with keep_id and n over all runs.

        Rows that a run's filter excludes do not reach the merge join with that run.
        """
        found = None
        for _, run in self.runs:
            hit = self.filters[run._stash_path].candidates(batch).join(run.hint("merge"), "digest")
            found = hit if found is None else found.unionByName(hit)
        if found is None:
            return batch.withColumn("keep_id", F.lit(None).cast("long")).withColumn("n", F.lit(0).cast("long")).where(F.lit(False))
        keys = [c for c in found.columns if c not in ("keep_id", "n")]
        return found.groupBy(*keys).agg(self.pick("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def exact_groups(docs: DataFrame, stash: Stash, keep: str = "max", batches: int = 4, digest_of=digest, salt_rows: int = 2000) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of docs.

    Texts are equal when their UTF-8 bytes are; null counts as the empty text, which forms a group like any other. In a
    group the row with the largest (keep="min": smallest) doc_id stays; null ids never stay beside others, and rows that
    repeat the id that stays are told apart by a row number, so one row of each group is kept. Of a group with null ids only, one
    row stays, its keep_id null. Empty tables give an empty result; further columns of docs are not read.

    Digests come in `batches` memtables. Each is probed through the filters of the runs before it and merge-joined with them, then flushed as a run of
    its own; two runs of a level are compacted. Digests that were hit, or stand in a memtable more than once, are shared; the runs tell their size and the row that
    stays. All copies are verified byte by byte against the text of the row that stays, in portions of salt_rows copies; digests with a mismatch are grouped again by whole text.
    """
    rows = stash.keep(docs.select("doc_id", digest_of(F.col("text")).alias("digest"), digest(F.col("text")).alias("text_sha256")), "digests")
    index, hits = DigestIndex(stash, keep, fanout=2), None
    for b in range(batches):
        memtable = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b).select("digest", "doc_id")
        own = memtable.groupBy("digest").count()
        hit = own.where("count > 1").select("digest").unionByName(index.probe(own.select("digest")).select("digest"))
        hit = stash.keep(hit, "hits")  # before the flush compacts the runs that it reads
        hits = hit if hits is None else hits.unionByName(hit)
        index.flush(memtable)
    shared = stash.keep(index.probe(hits.distinct()), "shared")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"), digest_of(F.col("text")).alias("digest"))
    copies = stash.keep(BitmapFilter(shared, stash).candidates(texts).join(shared.hint("merge"), "digest"), "copies")
    portion = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / F.lit(salt_rows))).cast("int")
    stays = copies.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.first("_text").alias("_kept"), F.max("n").alias("_n"))
    stays = stays.select("digest", "_kept", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_n") / F.lit(salt_rows)) - 1).cast("int"))).alias("_portion"))
    wrong = stash.keep(copies.withColumn("_portion", portion).join(stays.hint("merge"), ["digest", "_portion"]).where(F.col("_text") != F.col("_kept")).select("digest").distinct(), "collisions")
    stash.drop(copies)

    order = F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last()
    few = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    numbered = rows.join(few, "digest", "left").withColumn("_same", F.coalesce(F.col("n"), F.lit(1)))
    stays_ = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    others = numbered.where(F.col("n").isNull() | ~stays_).withColumn("_no", F.when(F.col("_same") == 1, 1).otherwise(2))
    # a repeated id can only be the one that stays; rows with that id are few, all others need no number. They meet by digest and id, so that a large group stays spread
    kept = shared.select(F.col("digest").alias("_d"), "keep_id", "n")
    rival = rows.join(kept.hint("merge"), (F.col("digest") == F.col("_d")) & stays_).drop("_d").withColumn("_same", F.col("n"))
    rival = rival.withColumn("_no", F.row_number().over(Window.partitionBy("digest", "doc_id").orderBy("text_sha256")))
    good = rival.unionByName(others).join(wrong, "digest", "left_anti").select(
        "doc_id", F.when(F.col("_same") == 1, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.col("_same").alias("group_size"), (F.col("_no") == 1).alias("kept"), "text_sha256")
    if wrong.isEmpty():
        return good
    again = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("_text"), digest_of(F.col("text")).alias("digest")).join(wrong, "digest", "left_semi")
    same = Window.partitionBy("digest", "_text")
    again = again.select(
        "doc_id", (F.max if keep == "max" else F.min)("doc_id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"),
        (F.row_number().over(same.orderBy(order)) == 1).alias("kept"), digest(F.col("_text")).alias("text_sha256"))
    return good.unionByName(again)
