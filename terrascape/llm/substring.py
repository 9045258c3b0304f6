"""Substring deduplication by a log-structured index of window fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact import BitmapFilter
from .store import Stash
from .textkit import buffers, grow_sorted, ngrams, release, shrink_sorted, slices, word_hashes, words

#: Entries that a memtable holds.
MEMTABLE = 1 << 19
#: Text bytes of one bucket's windows and of one chunk of documents.
BUCKET_BYTES = 8 << 20
#: Passages that are held against one copy of the document that has them first, and doubted windows that are looked up at once.
PORTION, DOUBTS = 500, 1 << 20

ENTRY = "bucket int, run boolean, fps binary, ranks binary, ids binary"


def windows(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, ends and rows, window fingerprints, and the word that each window starts with."""
    data, offsets = buffers(texts)
    starts, ends, rows = words(data, offsets)
    fps, at = ngrams(word_hashes(data, starts, ends), rows, k)
    return data, starts, ends, rows, fps, at


def _bucket(fps: np.ndarray, buckets: int) -> np.ndarray:
    return ((fps >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _groups(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct value of sorted fps, and the group of each place."""
    head = np.ones(len(fps), bool)
    head[1:] = fps[1:] != fps[:-1]
    return np.flatnonzero(head), np.cumsum(head) - 1


def entries(fps: np.ndarray, ids: np.ndarray, buckets: int, run: bool) -> Iterator[pa.RecordBatch]:
    """Entries sorted by fingerprint, cut by bucket; of a run, each fingerprint once with its least id. Ids of a piece stand as ranks in its list of ids."""
    if not len(fps):
        return
    order = np.argsort(fps, kind="stable")  # of sorted runs, a natural merge
    fps, ids = fps[order], ids[order]
    if run:
        first, _ = _groups(fps)
        fps, ids = fps[first], np.minimum.reduceat(ids, first)
    b = _bucket(fps, buckets)
    cuts = np.r_[0, np.flatnonzero(b[1:] != b[:-1]) + 1, len(b)]
    rows = []
    for x, y in zip(cuts, cuts[1:], strict=False):
        for i in range(x, y, 4 << 20):
            j = min(y, i + (4 << 20))
            own = np.unique(ids[i:j])
            rank = np.searchsorted(own, ids[i:j])
            kind = np.uint16 if len(own) < 1 << 16 else np.uint32
            rows.append((int(b[x]), run, shrink_sorted(fps[i:j]), rank.astype(kind).tobytes(), np.diff(own, prepend=0).astype(np.int64).tobytes()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "run", "fps", "ranks", "ids"])


def read_entries(table: pa.Table, run: bool) -> tuple[np.ndarray, np.ndarray]:
    fps, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in table.filter(pa.array([x == run for x in table.column("run").to_pylist()], pa.bool_())).to_pylist():
        f, own = grow_sorted(r["fps"]), np.cumsum(np.frombuffer(r["ids"], np.int64))
        fps.append(f)
        ids.append(own[np.frombuffer(r["ranks"], np.uint16 if len(own) < 1 << 16 else np.uint32)])
    return np.concatenate(fps), np.concatenate(ids)


_MERGED = f"{ENTRY}, chunk int, hits binary, first binary"


def _merged(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 8
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["bucket", "run", "fps", "ranks", "ids", "chunk", "hits", "first"])


def _row(rows: list[tuple]) -> pa.RecordBatch:
    return _merged(rows).combine_chunks().to_batches()[0]


class WindowIndex:
    """Sorted immutable runs of window fingerprints, each with the least doc_id that has it; probed by merge join."""

    def __init__(self, stash: Stash, k: int, buckets: int, chunks: int, fanout: int = 4):
        self.stash, self.k, self.buckets, self.chunks, self.fanout = stash, k, buckets, chunks, fanout
        self.runs: list[DataFrame] = []

    def memtables(self, docs: DataFrame) -> DataFrame:
        """Sorted entries of the windows of docs, flushed whenever a memtable is full.

        A memtable sends one entry a fingerprint, with its least id; its other rows with that fingerprint have their answer already, as hits
        for their chunks. So a window that very many documents share makes few entries.
        """
        k, buckets, chunks = self.k, self.buckets, self.chunks

        def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            fps, ids = map(np.concatenate, zip(*held, strict=True))
            if not len(fps):
                return
            order = np.argsort(fps)
            fps, ids = fps[order], ids[order]
            first, group = _groups(fps)
            least = np.minimum.reduceat(ids, first)
            for b in entries(fps[first], least, buckets, True):
                yield _row([(r["bucket"], False, r["fps"], r["ranks"], r["ids"], None, None, None) for r in b.to_pylist()])
            hit = np.flatnonzero(ids > least[group])
            rows = [(c % buckets, False, None, None, None, c, h, f) for c, h, f in _hits(fps[hit], ids[hit], least[group[hit]], chunks)]
            if rows:
                yield _row(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []
            count = 0
            for batch in batches:
                for part in slices(batch, "text"):
                    _, _, _, rows, fps, at = windows(part.column("text"), k)
                    held.append((fps, part.column("doc_id").to_numpy()[rows[at]]))
                    count += len(fps)
                    if count >= MEMTABLE:
                        yield from flush(held)
                        held, count = [], 0
            if held:
                yield from flush(held)

        return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _MERGED)

    def add(self, docs: DataFrame, flush: bool = True) -> DataFrame:
        """Merge-joins a batch, whose ids follow those of earlier batches, with all runs: chunk, fps, first (packed arrays).

        A row tells a chunk of documents which of its windows start in a document with a smaller doc_id, and the least such.
        flush: the batch's windows become a run of the index.
        """
        buckets, chunks = self.buckets, self.chunks
        history = self.memtables(docs)
        for r in self.runs:
            history = history.unionByName(r.select("bucket", "run", "fps", "ranks", "ids"), allowMissingColumns=True)

        def merge(table: pa.Table) -> pa.Table:
            bucket = table.column("bucket")[0].as_py()
            answered = table.column("hits").is_valid()
            out = [(bucket, False, None, None, None, *r.values()) for r in table.filter(answered).select(["chunk", "hits", "first"]).to_pylist()]
            table = table.filter(pc.invert(answered))
            new, new_ids = read_entries(table, False)
            old, old_ids = read_entries(table, True)
            del table
            if not len(new):
                return _merged(out)
            fps, ids = np.concatenate([old, new]), np.concatenate([old_ids, new_ids])
            fresh = np.r_[np.zeros(len(old), bool), np.ones(len(new), bool)]
            del old, new, old_ids, new_ids
            order = np.argsort(fps, kind="stable")  # a natural merge: each entry is a sorted run
            fps, ids, fresh = fps[order], ids[order], fresh[order]
            first, group = _groups(fps)
            least = np.minimum.reduceat(ids, first)
            hit = np.flatnonzero(fresh & (ids > least[group]))
            out += [(bucket, False, None, None, None, *h) for h in _hits(fps[hit], ids[hit], least[group[hit]], chunks)]
            if flush:
                own = np.logical_and.reduceat(fresh, first)
                for b in entries(fps[first[own]], least[own], buckets, True):
                    out += [(*r.values(), None, None, None) for r in b.to_pylist()]
            return _merged(out)

        found = self.stash.keep(history.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(merge, _MERGED), "merged", by="run")
        if flush:
            self.runs.append(self.stash.part(found, "run", "true").withColumn("run", F.lit(True)))
            self.runs[-1]._stash_path = f"{found._stash_path}/run=true"
            if len(self.runs) >= self.fanout:
                self.compact()
        return self.stash.part(found, "run", "false").select("chunk", "hits", "first")

    def close(self) -> None:
        """Deletes the runs."""
        self.stash.drop(*self.runs)
        self.runs = []

    def compact(self) -> None:
        """Merges all runs into one that keeps the least identifier of each fingerprint."""
        if len(self.runs) < 2:
            return
        buckets = self.buckets
        old = self.runs
        both = old[0].select("bucket", "run", "fps", "ranks", "ids")
        for r in old[1:]:
            both = both.unionByName(r.select(*both.columns))

        def merge(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches(list(entries(*read_entries(table, True), buckets, True)))

        self.runs = [self.stash.keep(both.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(merge, ENTRY), "run")]
        self.stash.drop(*old)


def prime_from(n: int) -> int:
    """The least prime from n on; ids in regular steps still spread over so many chunks."""
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _hits(fps: np.ndarray, ids: np.ndarray, first: np.ndarray, chunks: int) -> Iterator[tuple[int, bytes, bytes]]:
    if not len(fps):
        return
    chunk = ids % chunks
    order = np.argsort(chunk, kind="stable")
    chunk, fps, first = chunk[order], fps[order], first[order]
    keep = np.r_[True, (chunk[1:] != chunk[:-1]) | (fps[1:] != fps[:-1])]
    chunk, fps, first = chunk[keep], fps[keep], first[keep]
    cuts = np.r_[0, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, len(chunk)]
    for x, y in zip(cuts, cuts[1:], strict=False):
        yield int(chunk[x]), fps[x:y].tobytes(), first[x:y].tobytes()


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, passages array<struct<first: long, passage: string>>"


_HITS = "chunk int, hits binary, first binary, fp long, words string, least long"


def _judge(docs: DataFrame, hits: DataFrame, k: int, chunks: int, exact: DataFrame | None = None) -> DataFrame:
    """Removes words of hit windows. exact: chunk, fp, words, least: of windows whose fingerprint is doubted, the least doc_id by their very words."""

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        plain, sure = right.column("hits").is_valid(), right.column("words").is_valid()
        found_hits = right.filter(plain)
        fps = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(h, np.uint64) for h in found_hits.column("hits").to_pylist())])
        first = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(h, np.int64) for h in found_hits.column("first").to_pylist())])
        by_words = right.filter(sure)
        doubts = np.unique(by_words.column("fp").to_numpy().view(np.uint64)) if by_words.num_rows else np.zeros(0, np.uint64)
        exact_first = dict(zip(by_words.column("words").to_pylist(), by_words.column("least").to_pylist(), strict=True))
        order = np.argsort(fps)
        fps, first = fps[order], first[order]
        if len(fps):  # a memtable and a bucket may both have answered
            head, _ = _groups(fps)
            fps, first = fps[head], np.minimum.reduceat(first, head)
        out = []
        for batch in left.to_batches():
            for part in slices(batch, "text"):
                ids = part.column("doc_id")
                data, starts, ends, rows, found, at = windows(part.column("text"), k)
                ids_np = np.array([-1 if x is None else x for x in ids.to_pylist()], np.int64)
                known = np.array([x is not None for x in ids.to_pylist()])
                place = np.searchsorted(fps, found)
                place[place == len(fps)] = 0
                hit = (fps[place] == found) if len(fps) else np.zeros(len(found), bool)
                source = first[place] if len(fps) else np.zeros(len(found), np.int64)
                if len(doubts):
                    for i in np.flatnonzero(np.isin(found, doubts)):
                        a = at[i]
                        text = _said(data, starts, ends, a, k)
                        source[i] = exact_first.get(text, np.iinfo(np.int64).max)
                        hit[i] = True
                hit &= (source < ids_np[rows[at]]) & known[rows[at]]
                covered = np.zeros(len(starts) + 1, np.int64)
                np.add.at(covered, at[hit], 1)
                np.add.at(covered, at[hit] + k, -1)
                gone = np.cumsum(covered)[:-1] > 0
                # maximal passages of one document and one source, to be verified
                w, src = at[hit], source[hit]
                breaks = np.flatnonzero(np.r_[True, (w[1:] != w[:-1] + 1) | (src[1:] != src[:-1]) | (rows[w[1:]] != rows[w[:-1]])]) if len(w) else np.zeros(0, np.int64)
                stops = np.r_[breaks[1:], len(w)] - 1 if len(w) else breaks
                said: dict[int, list] = {}
                for x, y in zip(breaks, stops, strict=True):
                    a, b = w[x], w[y] + k
                    passage = b" ".join(data[starts[a] : ends[b - 1]].tobytes().split()).decode()
                    said.setdefault(int(rows[a]), []).append({"first": int(src[x]), "passage": passage})
                cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
                for i in range(part.num_rows):
                    a, b = cuts[i], cuts[i + 1]
                    stay = np.flatnonzero(~gone[a:b]) + a
                    edge = np.flatnonzero(stay[1:] != stay[:-1] + 1) + 1
                    spans = zip(np.r_[0, edge], np.r_[edge, len(stay)], strict=True) if len(stay) else []
                    kept = b" ".join(w for x, y in spans for w in data[starts[stay[x]] : ends[stay[y - 1]]].tobytes().split())
                    out.append((ids[i].as_py(), int(b - a), int(b - a - len(stay)), hashlib.sha256(kept).hexdigest(), said.get(i, [])))
        release()
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("passage", pa.string())])))
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "passages"])

    of = F.coalesce(F.pmod("doc_id", F.lit(chunks)), F.pmod(F.xxhash64("text"), F.lit(chunks)))  # rows without an id have no hits and go anywhere
    left = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("chunk", of.cast("int"))
    right = hits.select("chunk", "hits", "first", F.lit(None).cast("long").alias("fp"), F.lit(None).cast("string").alias("words"), F.lit(None).cast("long").alias("least"))
    if exact is not None:
        right = right.unionByName(exact.select("chunk", "fp", "words", "least"), allowMissingColumns=True)
    return left.repartitionById(chunks, F.col("chunk")).groupBy("chunk").cogroup(right.repartitionById(chunks, F.col("chunk")).groupBy("chunk")).applyInArrow(join, _RESULT)


def _said(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: int, k: int) -> str:
    return b" ".join(data[s:e].tobytes() for s, e in zip(starts[a : a + k], ends[a : a + k], strict=True)).decode()


def _unheld(said: DataFrame, docs: DataFrame, stash: Stash) -> DataFrame:
    """Of rows digest (a doc_id), passage: those whose passage does not stand in that document, word for word. Each document meets at most some PORTION passages at once."""
    named = BitmapFilter(said.select("digest").distinct(), stash)
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), F.lit(" "))
    texts = named.candidates(docs.select(F.col("doc_id").cast("long").alias("digest"), plain.alias("plain")))
    many = stash.keep(said.groupBy("digest").count().where(F.col("count") > PORTION).select("digest", F.ceil(F.col("count") / PORTION).cast("int").alias("portions")), "many")
    many = F.broadcast(many) if many.count() <= 100_000 else many
    portions = F.coalesce("portions", F.lit(1))
    said = said.join(many, "digest", "left").withColumn("portion", F.pmod(F.xxhash64("passage"), portions).cast("int")).drop("portions")
    texts = texts.join(many, "digest", "left").withColumn("portion", F.explode(F.sequence(F.lit(0), portions - 1))).drop("portions")
    holds = F.coalesce(F.max(F.contains("plain", F.concat(F.lit(" "), F.col("passage"), F.lit(" ")))), F.lit(False))
    held = said.join(texts.hint("merge"), ["digest", "portion"], "left").groupBy("digest", "portion", "passage").agg(holds.alias("holds"))
    return stash.keep(held.where("NOT holds").select("digest", "passage"), "unheld")


def _windows_of(passages: DataFrame, k: int) -> DataFrame:
    """digest, passage -> digest, passage (each window of k words of it once), fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, passage in zip(batch.column("digest").to_pylist(), batch.column("passage"), strict=True):
                data, starts, ends, _, fps, at = windows(pa.array([passage.as_py()]), k)
                _, one = np.unique(fps, return_index=True)
                for i in range(0, len(one), 10_000):
                    texts = [_said(data, starts, ends, at[j], k) for j in one[i : i + 10_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([digest] * len(texts), pa.int64()), pa.array(texts, pa.string()), pa.array(fps[one[i : i + 10_000]].view(np.int64))], ["digest", "passage", "fp"])

    return passages.mapInArrow(run, "digest long, passage string, fp long").distinct()


def _by_words(docs: DataFrame, doubted: DataFrame, k: int, chunks: int, stash: Stash) -> DataFrame:
    """chunk, fp, words, least: for each chunk, the windows with a doubted fingerprint in it, by their very words, and the least doc_id that has them.

    doubted: fp. The fingerprints go to the tasks in blocks of about DOUBTS; all documents are read for each block.
    """
    blocks, found = -(-doubted.count() // DOUBTS), None
    for b in range(blocks):
        doubts = np.sort(np.array([r.fp for r in doubted.where(F.pmod(F.xxhash64("fp"), F.lit(blocks)) == b).collect()], np.int64).view(np.uint64))  # at most about DOUBTS

        def run(batches: Iterator[pa.RecordBatch], doubts=doubts) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    data, starts, ends, rows, fps, at = windows(part.column("text"), k)
                    some = np.flatnonzero(np.isin(fps, doubts))
                    texts = [_said(data, starts, ends, at[i], k) for i in some]
                    yield pa.RecordBatch.from_arrays([pa.array(fps[some].view(np.int64)), pa.array(texts, pa.string()), pa.array(part.column("doc_id").to_numpy()[rows[at[some]]])], ["fp", "words", "doc_id"])

        part = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "fp long, words string, doc_id long")
        found = part if found is None else found.unionByName(part)
    places = stash.keep(found.withColumn("chunk", F.pmod("doc_id", F.lit(chunks)).cast("int")).groupBy("chunk", "fp", "words").agg(F.min("doc_id").alias("least")), "doubted")
    return places.drop("least").join(places.groupBy("fp", "words").agg(F.min("least").alias("least")), ["fp", "words"])


def remove_repeats(docs: DataFrame, stash: Stash, k: int = 13, history: tuple[float, ...] = (0.25, 0.5)) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs.

    A word goes if it is covered by a window of k words that also starts in a row with a smaller doc_id; windows are judged on the
    input. Words are those of textkit.WORD, unchanged; a null or empty text has none; texts shorter than k words keep
    all. Rows with equal ids don't remove each other's words; a row without an id keeps all of its words and removes none.
    Empty tables give an empty result; further columns of docs are not read.

    Ids come in batches, cut at the `history` shares: each batch is merge-joined with the runs before it and, but for the last, flushed as a run; runs are compacted
    as soon as there are two. Each passage that goes is then held word by word against the document said to have it first; a passage that does not stand there as a
    whole, window by window; windows that don't either share a fingerprint only, and are judged again by their very words.
    """
    size = docs.agg(F.sum(F.octet_length("text")), F.percentile_approx("doc_id", F.array(*map(F.lit, history)), F.lit(1000))).first()
    parts = max(1, -(-(size[0] or 0) // BUCKET_BYTES))
    chunks = prime_from(parts)
    index = WindowIndex(stash, k, parts, chunks, fanout=2)
    edges = [None, *(size[1] or []), None]
    hits = None
    for low, high in zip(edges, edges[1:], strict=False):
        batch = docs if low is None else docs.where(F.col("doc_id") > low)
        batch = batch if high is None else batch.where(F.col("doc_id") <= high)
        found = index.add(batch, flush=high is not None)
        hits = found if hits is None else hits.unionByName(found)
    index.close()
    out = stash.keep(_judge(docs, hits, k, chunks), "judged")
    said = out.select(F.explode("passages").alias("p")).select(F.col("p.first").alias("digest"), "p.passage").distinct()
    unheld = _unheld(stash.keep(said, "said"), docs, stash)
    if not unheld.isEmpty():
        single = stash.keep(_windows_of(unheld, k), "windows")
        unheld = _unheld(single.drop("fp"), docs, stash)
        if not unheld.isEmpty():
            doubted = stash.keep(single.join(unheld, ["digest", "passage"], "left_semi").select("fp").distinct(), "fps")
            out = _judge(docs, hits, k, chunks, _by_words(docs, doubted, k, chunks, stash))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")
