"""Near duplicates by an inverted join of MinHash signature coordinates, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact import BitmapFilter
from .store import Stash
from .substring import BUCKET_BYTES, ENTRY, MEMTABLE, entries, read_entries
from .textkit import buffers, mix, ngrams, release, slices, word_hashes, words

#: Coordinates of a signature, and how likely a pair at the threshold may be to share too few of them.
COORDINATES, MISS = 48, 1e-6
_RNG = np.random.default_rng(71)
_XOR = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2)
_MULTIPLY = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(percent: int) -> int:
    """The most coordinates that can be asked for so that a pair of that similarity shares fewer with a probability of at most MISS; 27 of 48 at 85 percent."""
    p, below, t = percent / 100, 0.0, 0
    while below + (chance := comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)) <= MISS:
        below, t = below + chance, t + 1
    return max(1, t)


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of k words, A-Z in lower case; shorter texts: the whole sequence; none without words."""
    data, offsets = buffers(texts, lower=True)
    starts, ends, rows = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    grams, at = ngrams(hashes, rows, k)
    gram_cuts = np.searchsorted(rows[at], np.arange(len(texts) + 1))
    word_cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        n = word_cuts[i + 1] - word_cuts[i]
        if 0 < n < k:
            out.append(ngrams(hashes[word_cuts[i] : word_cuts[i + 1]], np.zeros(n, np.int64), n)[0])
        else:
            out.append(np.unique(grams[gram_cuts[i] : gram_cuts[i + 1]]))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash under each of COORDINATES functions; its upper 31 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 8192):
        part = (shingles[i : i + 8192, None] ^ _XOR[None, :]) * _MULTIPLY[None, :]
        part ^= part >> np.uint64(29)
        np.minimum(least, part.min(axis=0), out=least)
    return (mix(least) >> np.uint64(33)).astype(np.int32)


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, cls (128-bit hash of the whole set; null if empty), sig (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_key"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int32())),
                ], ["doc_id", "text_key", "n_shingles", "cls", "sig"])
        release()

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, n_shingles long, cls binary, sig array<int>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """cls, text -> cls, key (64 bits of it), n, grams (the sorted set as bytes), without rows whose text is not of that class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                classes = part.column("cls").to_pylist()
                own = pa.array([xxhash.xxh3_128_digest(g.tobytes()) == c for g, c in zip(sets, classes, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([
                    part.column("cls"), pa.array([int.from_bytes(c[:8], "big", signed=True) for c in classes], pa.int64()),
                    pa.array([len(g) for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary()),
                ], ["cls", "key", "n", "grams"]).filter(own)
        release()

    return docs.select("cls", "text").mapInArrow(run, "cls binary, key long, n long, grams binary")


def shared_counts(sets: DataFrame, stash: Stash) -> DataFrame:
    """cls, n, s, fame of each class: s bounds from above how many of its n shingles stand in another class too; fame is the mean number of classes of a shingle.

    Packed runs of shingle hashes meet in buckets by hash; only counts go back.
    """
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total * 8 // BUCKET_BYTES))

    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for key, grams in zip(batch.column("key").to_pylist(), batch.column("grams"), strict=True):
                grams = np.frombuffer(grams.as_buffer(), np.uint64)
                held.append((grams, np.full(len(grams), key, np.int64)))
                count += len(grams)
                if count >= MEMTABLE:
                    yield from entries(*map(np.concatenate, zip(*held, strict=True)), buckets, False)
                    held, count = [], 0
        if held:
            yield from entries(*map(np.concatenate, zip(*held, strict=True)), buckets, False)

    def tally(table: pa.Table) -> pa.Table:
        fps, keys = read_entries(table, False)
        order = np.argsort(fps)
        fps, keys = fps[order], keys[order]
        head = np.r_[True, fps[1:] != fps[:-1]]
        group = np.cumsum(head) - 1
        size = np.bincount(group)[group]
        shared = size > 1
        keys, place = np.unique(keys[shared], return_inverse=True)
        return pa.table([pa.array(keys, pa.int64()), pa.array(np.bincount(place, minlength=len(keys)), pa.int64()), pa.array(np.bincount(place, size[shared], len(keys)), pa.float64())], ["key", "s", "fame"])

    counted = sets.select("key", "grams").mapInArrow(flush, ENTRY).groupBy("bucket").applyInArrow(tally, "key long, s long, fame double")
    counted = counted.groupBy("key").agg(F.sum("s").alias("s"), F.sum("fame").alias("fame"))
    out = sets.select("cls", "key", "n").distinct().join(counted, "key", "left")
    return stash.keep(out.select("cls", "n", F.least("n", F.coalesce("s", F.lit(0))).alias("s"), F.coalesce(F.col("fame") / F.col("n"), F.lit(0.0)).alias("fame")), "shared")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, both, linked of pairs a, b: the size of the full sets' intersection, and whether 100 * both >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, linked = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both.append(len(np.intersect1d(x, y, assume_unique=True)))
                linked.append(100 * both[-1] >= percent * (len(x) + len(y) - both[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "both", "linked"])
        release()

    x, y = sets.select(F.col("cls").alias("a"), F.col("grams").alias("x")), sets.select(F.col("cls").alias("b"), F.col("grams").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary, both long, linked boolean")


def components(links: DataFrame, stash: Stash, most_rounds: int = 60) -> DataFrame:
    """node, root of every node of the links a, b: root is the least node reachable. Rounds of label spreading and pointer jumping."""
    both = stash.keep(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = stash.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(most_rounds):
        spread = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        spread = labels.join(spread, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        following = stash.keep(spread.join(jump, "root").select("node", "old", F.least("root", "far").alias("root")), "labels")
        stash.drop(labels)
        labels = following
        if labels.where("root != old").isEmpty():
            return labels.select("node", "root")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def reach(n: Column, m: Column, most: Column, percent: int) -> Column:
    """Whether sets of n and m shingles with at most `most` in common can be linked."""
    return 100 * most >= percent * (n + m - most)


def remaining(lists: DataFrame, stash: Stash, percent: int) -> DataFrame:
    """a, b, each pair once: members of one list that belong to different components, one of them not to the list's main one, and that can still be linked.

    lists: list, cls, n, s, before and after (shared values of the class before and after the list's), root, i, j (common shingles with the list's two pivots, null if unknown). What two sets have in common is at most s of either, and at
    most what they share within a pivot's set and beyond it. A pair meets in several lists; the first that both stand in gives it.
    """
    sizes = lists.groupBy("list", "root").agg(F.count(F.lit(1)).alias("members"))
    open_lists = sizes.groupBy("list").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", "members").alias("main")).where("roots > 1")
    open_lists = stash.keep(open_lists.select("list", "main"), "open")
    members = lists.join(open_lists, "list")
    stands = members.groupBy("cls").agg(F.sort_array(F.collect_set("list")).alias("lists"))  # at most COORDINATES
    members = stash.keep(members.join(stands, "cls"), "members")
    u, v = (members.select(*(F.col(c).alias(f"{side}_{c}") for c in members.columns)) for side in "uv")

    def within(p: str) -> Column:
        known = F.col(f"u_{p}").isNotNull() & F.col(f"v_{p}").isNotNull()
        return F.when(known, F.least(f"u_{p}", f"v_{p}") + F.least(F.col("u_s") - F.col(f"u_{p}"), F.col("v_s") - F.col(f"v_{p}")))

    most = F.least("u_s", "v_s", within("i"), within("j"))
    apart = (F.col("u_root") != F.col("v_root")) & ((F.col("v_root") == F.col("v_main")) | (F.col("u_cls") < F.col("v_cls")))
    can = F.least("u_before", "v_before") + 1 + F.least("u_after", "v_after") >= least_matches(percent)
    first = F.element_at(F.array_intersect("u_lists", "v_lists"), 1) == F.col("u_list")
    rest = u.where("u_root != u_main").join(v, (F.col("u_list") == F.col("v_list")) & apart & reach(F.col("u_n"), F.col("v_n"), most, percent) & can & first)
    return rest.select(F.least("u_cls", "v_cls").alias("a"), F.greatest("u_cls", "v_cls").alias("b")).distinct()


def near_links(nodes: DataFrame, docs: DataFrame, stash: Stash, k: int, percent: int) -> DataFrame:
    """Roots of linked classes: cls, root. nodes: cls, doc_id (whose text stands for the class), text_key (whose text does if there is no id), sig.

    Documents are posted under each coordinate-value pair. Values of one class only can't collide and are skipped; a pair
    shares at least least_matches coordinates only if it collides within both prefixes: the n - least_matches + 1 rarest of a
    class's n shared values. All values stand in one order, so a collision tells how many more a pair can have before and after it; pairs that
    can't reach least_matches go. The lists beyond the prefixes, which are the long ones, are skipped: the pairs that are left merge their two
    signatures, which counts all of their collisions. A pair's common shingles are at most the s of either side, so most pairs within a large group
    of loose copies can't reach the threshold, and members that fit no partner leave their lists. In each list the members are paired with two
    pivots, one of them the member with the most widely shared shingles, and then only with what is left of other components:
    a list of copies makes few pairs and no link is lost.
    """
    matches = least_matches(percent)
    posted = nodes.select("cls", F.posexplode("sig").alias("at", "value"))
    counts = posted.groupBy("at", "value").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    hot = posted.join(counts, ["at", "value"]).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("f", "at", "value"))).alias("shared"))
    hot = hot.where(F.size("shared") >= matches).select("cls", F.size("shared").alias("m"), F.posexplode(F.slice("shared", F.lit(1), F.size("shared") - matches + 1)).alias("pos", "p"))
    lists = stash.keep(hot.select((F.col("p.at").cast("long") * (1 << 32) + F.col("p.value")).alias("list"), "cls", F.col("pos").alias("before"), (F.col("m") - F.col("pos") - 1).alias("after")), "postings")
    wanted = stash.keep(lists.select("cls").distinct().join(nodes.select("cls", "doc_id", "text_key"), "cls").withColumnRenamed("doc_id", "digest"), "wanted")
    bare = wanted.where("digest IS NULL").select("cls", F.col("text_key").alias("digest"))  # classes whose rows all lack an id
    wanted = wanted.drop("text_key")
    texts = BitmapFilter(wanted, stash).candidates(docs.select(F.col("doc_id").cast("long").alias("digest"), "text"))
    sets = full_sets(texts.join(wanted.hint("merge"), "digest"), k)
    if not bare.isEmpty():
        texts = BitmapFilter(bare, stash).candidates(docs.where(F.col("doc_id").cast("long").isNull()).select(F.xxhash64("text").alias("digest"), "text"))
        sets = sets.unionByName(full_sets(texts.join(bare.hint("merge"), "digest"), k).dropDuplicates(["cls"]))
    sets = stash.keep(sets, "sets")

    lists = stash.keep(lists.join(shared_counts(sets, stash), "cls"), "counted")
    # the smallest partner that a member can have is the list's smallest, or percent of its own size
    # tables by list are written before they are joined: of a join of two plain shuffles, adaptive execution splits a list that is too long for one task
    least = stash.keep(lists.groupBy("list").agg(F.min("n").alias("least")), "least")
    partner = F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100))
    lists = stash.keep(lists.join(least, "list").where(reach(F.col("n"), partner, F.least(F.col("s"), partner), percent)).drop("least"), "fit")
    pivots = lists.groupBy("list").agg(F.min(F.struct("cls", "n", "s", "before", "after")).alias("low"), F.max(F.struct("fame", "cls", "n", "s", "before", "after")).alias("high"))
    pivots = stash.keep(pivots.select("list", "low", F.struct("high.cls", "high.n", "high.s", "high.before", "high.after").alias("high")), "pivots")
    lists = stash.keep(lists.drop("fame").join(pivots, "list"), "live")
    can = F.least("before", "p.before") + 1 + F.least("after", "p.after") >= matches
    starred = lists.select("cls", "n", "s", "before", "after", F.explode(F.array("low", "high")).alias("p")).where((F.col("cls") != F.col("p.cls")) & can & reach(F.col("n"), F.col("p.n"), F.least("s", "p.s"), percent))
    starred = starred.select(F.least("cls", "p.cls").alias("a"), F.greatest("cls", "p.cls").alias("b")).distinct()
    sigs = nodes.select("cls", "sig")

    def collide(pairs: DataFrame) -> DataFrame:
        x, y = sigs.select(F.col("cls").alias("a"), F.col("sig").alias("x")), sigs.select(F.col("cls").alias("b"), F.col("sig").alias("y"))
        same = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda total, one: total + one)
        return pairs.join(x, "a").join(y, "b").where(same >= matches).select("a", "b")

    measured = stash.keep(confirm(stash.keep(collide(starred), "starred"), sets, percent), "measured")
    links = measured.where("linked").select("a", "b")
    roots = components(links, stash)
    lists = lists.select("list", "cls", "n", "s", "before", "after", F.col("high.cls").alias("hub"), F.col("low.cls").alias("low"))
    lists = lists.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    for pivot, common in (("hub", "i"), ("low", "j")):
        known = measured.select("a", "b", F.col("both").alias(common))
        lists = lists.withColumn("a", F.least("cls", pivot)).withColumn("b", F.greatest("cls", pivot)).join(known, ["a", "b"], "left").drop("a", "b")
        lists = lists.withColumn(common, F.when(F.col("cls") == F.col(pivot), F.col("n")).otherwise(F.col(common)))
    lists = stash.keep(lists.drop("hub", "low"), "labelled")
    rest = remaining(lists, stash, percent)
    rest = stash.keep(collide(rest.join(measured, ["a", "b"], "left_anti")), "rest")
    more = stash.keep(confirm(rest, sets, percent).where("linked").select("a", "b"), "more")
    if not more.isEmpty():
        roots = components(links.unionByName(more), stash)
    stash.drop(sets, lists)
    return roots.withColumnRenamed("node", "cls")


def near_groups(docs: DataFrame, stash: Stash, k: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key (xxhash64 of the text) of each row of docs.

    A row's set are its distinct k-word shingles, A-Z in lower case; with fewer words the whole sequence; without words or
    text it is empty and linked with nothing. Rows with equal sets are one class; classes are linked at
    100 * intersection >= percent * union. component_id is the least doc_id reachable; a row without an id has none unless it
    is linked with one that has, and is kept if not. Rows that repeat the least id are all kept. Empty tables give an
    empty result; further columns of docs are not read.
    """
    rows = stash.keep(sketches(docs, k), "sketches")
    nodes = stash.keep(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"), F.first("sig").alias("sig")), "classes")
    roots = near_links(nodes, docs, stash, k, percent)
    of_class = nodes.select("cls", "doc_id").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = of_class.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = of_class.select("cls", "root").join(least, "root").select("cls", "component_id")
    out = rows.select("doc_id", "text_key", "n_shingles", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "text_key").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
