"""Language-model scores by a weighted backoff automaton over words, sharded by chunks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Stash
from .textkit import buffers, grow, grow_sorted, mix, release, shrink, shrink_sorted, slices, word_hashes, words

#: Text bytes of one chunk of documents, and of the counts that meet in one bucket.
CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 12 << 20
#: Longest n-gram, how many words' worth of trust each context gives to the shorter context, and how often a context was seen that is a state.
ORDER, TRUST, SUPPORT = 3, 8.0, 2
#: Tokens that one lane of the walk takes; a longer text is walked by several lanes.
LANE = 256
#: Hashes of the marks before and after a text.
BEGIN, END = (int(x) for x in mix(np.array([0xB, 0xE], np.uint64)))
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Chunk:
    """Token hashes of a chunk's texts. Tokens of a row: BEGIN (a context only), its words, END."""

    def __init__(self, texts: Iterator[pa.Array]):
        hashes, rows, base = [], [], 0
        for column in texts:
            data, offsets = buffers(column, lower=True)
            starts, ends, row = words(data, offsets)
            n = len(column)
            of_row = np.bincount(row, minlength=n) + 2
            token = np.empty(len(row) + 2 * n, np.uint64)
            last = np.cumsum(of_row) - 1
            token[last - of_row + 1] = BEGIN
            token[last] = END
            token[np.arange(len(row)) + 2 * row + 1] = word_hashes(data, starts, ends)
            hashes.append(token)
            rows.append(np.repeat(np.arange(base, base + n), of_row))
            base += n
        self.rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.token = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.size = base
        #: Of each length: sorted distinct n-grams (hashes), and the index among them of the n-gram that ends at each position, -1 if there is none.
        self.distinct, self.index = [], []

    def add_level(self, context_counts: np.ndarray | None = None, support: int = 0) -> None:
        """The n-grams of the next length; those only whose context, the n-gram one shorter before it, was seen `support` times."""
        k = len(self.distinct) + 1
        if k == 1:
            distinct, index = _indexed(self.token)
        else:
            before = np.full(len(self.token), -1)
            before[1:] = np.where(self.rows[1:] == self.rows[:-1], self.index[-1][:-1], -1)
            at = np.flatnonzero(before >= 0)
            if context_counts is not None:
                at = at[context_counts[before[at]] >= support]
            raw = np.full(len(at), k, np.uint64)
            for j in range(k):
                raw = raw * _BASE + self.token[at - j]
            index = np.full(len(self.token), -1)
            distinct, index[at] = _indexed(mix(raw))
        self.distinct.append(distinct)
        self.index.append(index)

    def counts(self, k: int, train: np.ndarray) -> np.ndarray:
        """How often each distinct n-gram of k tokens occurs in rows that are learned from."""
        index = self.index[k - 1]
        return np.bincount(index[train[self.rows] & (index >= 0)], minlength=len(self.distinct[k - 1]))


class Automaton:
    """Weighted backoff automaton over a chunk's tokens, in sorted arrays.

    States are contexts that were seen at least `support` times; state 0 is the empty context. A state has an arc for each token that
    was seen after it, with a log10 weight and the state it leads to, the longest context that ends there. Its failure arc leads to the
    next shorter context, at the price of what the state keeps for tokens seen after it; the empty context has an arc for every token.
    counts: of the n-grams of each length, over all documents that are learned from.
    """

    def __init__(self, chunk: Chunk, counts: list[np.ndarray], total: int, kinds: int, trust: float, support: int):
        order = len(counts)
        where = [np.zeros(len(d), np.int64) for d in chunk.distinct]  # a position of each n-gram
        for w, index in zip(where, chunk.index, strict=True):
            at = np.flatnonzero(index >= 0)
            w[index[at]] = at
        states = 1
        longest: list[np.ndarray] = []
        self.fail, self.fail_weight = [np.zeros(1, np.int64)], [np.zeros(1)]
        key, weight, to = [], [], []
        chance: list[np.ndarray] = []
        for k, n in enumerate(counts, 1):
            at = where[k - 1]
            suffix = chunk.index[k - 2][at] if k > 1 else None
            lower = longest[-1][suffix] if k > 1 else np.zeros(len(n), np.int64)
            leads = lower.copy()
            if k < order:
                state = np.flatnonzero(n >= support)
                leads[state] = states + np.arange(len(state))
                states += len(state)
                self.fail.append(lower[state])
                self.fail_weight.append(np.log10(trust / (n[state] + trust)))
            longest.append(leads)
            if k == 1:
                p = (n + 0.5) / (total + 0.5 * (kinds + 1))
                arc = np.arange(len(n))
                source = np.zeros(len(n), np.int64)
            else:
                context = chunk.index[k - 2][at - 1]
                seen = counts[k - 2][context]
                arc = np.flatnonzero((n > 0) & (seen >= support))
                p = np.zeros(len(n))
                p[arc] = (n[arc] + trust * chance[-1][suffix[arc]]) / (seen[arc] + trust)
                source = longest[k - 2][context[arc]]
            chance.append(p)
            key.append((source << 32) | chunk.index[0][at[arc]])
            weight.append(np.log10(p[arc]))
            to.append(leads[arc])
        self.fail, self.fail_weight = np.concatenate(self.fail), np.concatenate(self.fail_weight)
        keys = np.concatenate(key)
        order_ = np.argsort(keys)
        self.key, self.weight, self.to = keys[order_], np.concatenate(weight)[order_], np.concatenate(to)[order_]
        self.reach = order - 1

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after each token, and the log10 weight of the arcs on the way: failure arcs until one fits, then its own."""
        log, arc = np.zeros(len(state)), token.copy()  # the arcs of state 0 come first, one a token
        open_ = np.flatnonzero(state)
        at = state[open_]
        while len(open_):
            wanted = (at << 32) | token[open_]
            place = np.searchsorted(self.key, wanted)
            hit = self.key[np.minimum(place, len(self.key) - 1)] == wanted
            arc[open_[hit]] = place[hit]
            open_, at = open_[~hit], at[~hit]
            log[open_] += self.fail_weight[at]
            at = self.fail[at]
            open_, at = open_[at > 0], at[at > 0]
        return self.to[arc], log + self.weight[arc]

    def walk(self, chunk: Chunk, lane: int = LANE) -> np.ndarray:
        """Log10 probability of each row: one traversal from left to right, the state carried from token to token.

        Lanes of at most `lane` tokens are walked side by side. A lane within a text starts as many tokens earlier as a state can tell of,
        which brings it into the very state that the lane before it ends in, and adds nothing up until its own first token.
        """
        token = chunk.index[0]
        begins = np.flatnonzero(chunk.token == np.uint64(BEGIN))
        ends = np.r_[begins[1:], len(token)]
        many = np.maximum(1, -(-(ends - begins - 1) // lane))
        row = np.repeat(np.arange(chunk.size), many)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        own = begins[row] + 1 + nth * lane
        stop = np.minimum(own + lane, ends[row])
        start = np.maximum(begins[row], own - max(1, self.reach))
        order = np.argsort(start - stop, kind="stable")  # the longest first
        row, own, stop, at = row[order], own[order], stop[order], start[order]
        left = stop - at
        state, log = np.zeros(len(row), np.int64), np.zeros(len(row))
        for step in range(int(left[0]) if len(left) else 0):
            m = int(np.searchsorted(-left, -step))  # lanes with more tokens than steps taken
            state[:m], add = self.step(state[:m], token[at[:m]])
            log[:m] += np.where(at[:m] >= own[:m], add, 0)
            at[:m] += 1
        return np.bincount(row, log, chunk.size)


def _indexed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the index of each value among them."""
    order = np.argsort(values)
    ranked = values[order]
    head = np.ones(len(values), bool)
    head[1:] = ranked[1:] != ranked[:-1]
    index = np.empty(len(values), np.int64)
    index[order] = np.cumsum(head) - 1
    return ranked[head], index


def _cuts(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Cuts of sorted hashes at the buckets' borders, which are even."""
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.r_[0, np.searchsorted(hashes, edges), len(hashes)]


def _pieces(table: pa.Table) -> Iterator[pa.Array]:
    for batch in table.to_batches():
        for part in slices(batch, "text"):
            yield part.column("text")


def _table(rows: list[tuple], names: str, kinds: tuple) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names.split())


def _told(right: pa.Table, k: int) -> np.ndarray:
    """Counts that came back for the distinct n-grams of length k, in their order."""
    back = sorted(right.filter(pc.equal(right.column("k"), k)).to_pylist(), key=lambda r: r["bucket"])
    return np.concatenate([np.zeros(0, np.int64), *(grow(r["counts"]).astype(np.int64) for r in back)])


def _read(left: pa.Table, right: pa.Table | None, levels: int, support: int) -> tuple[Chunk, list[np.ndarray]]:
    """A chunk with its n-grams of `levels` lengths, and the counts of those that are known."""
    chunk, counts = Chunk(_pieces(left)), []
    for k in range(1, levels + 1):
        chunk.add_level(counts[-1] if k > 2 else None, support)
        if right is not None:
            found = _told(right, k)
            if len(found) == len(chunk.distinct[-1]):
                counts.append(found)
    return chunk, counts


def held_out(doc_id: Column, parts: int) -> Column:
    """Whether crc32 of the id as text leaves 1 over `parts`; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == 1, F.lit(False))


def lm_scores(docs: DataFrame, stash: Stash, parts: int = 5, order: int = ORDER, trust: float = TRUST, support: int = SUPPORT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs.

    Learns from all rows but the held out. Tokens are words, A-Z in lower case, and one end for each row; a null or empty text
    has the end alone. score is the log10 probability under a model that mixes each context's counts with the next
    shorter context, which counts as `trust` words; contexts seen less than `support` times are left out;
    unknown tokens share the chance that the base has for them.
    Rows that repeat count each time; a row without an id is learned from. Empty tables give an empty result; further columns of docs are not read.

    Each chunk of documents tells its own counts of its distinct n-grams and asks for all documents' ones: these meet in buckets by
    hash, a chunk's n-grams of one bucket as one packed entry, and the sums go back to the chunks that asked. First words and pairs, then, for each longer
    length, n-grams whose context is a state. A chunk's part of the automaton thus has all arcs that its documents can take,
    no task needs more, and what is gathered grows with the input. Rows equal in id and text share a chunk.
    """
    order = max(2, order)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(1, -(-size // CHUNK_BYTES)), max(1, -(-size // BUCKET_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("held", held_out(F.col("doc_id"), parts)).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    own = rows.repartitionById(chunks, F.col("chunk")).groupBy("chunk")  # a task a chunk, so that no task's share grows with the input
    asked_schema, told_schema = "bucket int, chunk int, k int, grams binary, counts binary", "bucket int, chunk int, k int, counts binary, tokens long, kinds long"

    def ask(left: pa.Table, right: pa.Table | None, new: tuple[int, ...]) -> pa.Table:
        chunk, _ = _read(left, right, new[-1], support)
        train, out = ~left.column("held").to_numpy().astype(bool), []
        name = left.column("chunk")[0].as_py() if left.num_rows else 0
        for k in new:
            grams, counts = chunk.distinct[k - 1], chunk.counts(k, train)
            cuts = _cuts(grams, buckets)
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[i], cuts[i + 1]
                out.append((i, name, k, shrink_sorted(grams[a:b]), shrink(counts[a:b])))
        release()
        return _table(out, "bucket chunk k grams counts", (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))

    def answer(table: pa.Table) -> pa.Table:
        out = []
        for k in sorted(set(table.column("k").to_pylist())):
            asked = [r for r in table.to_pylist() if r["k"] == k]
            grams = [grow_sorted(r["grams"]) for r in asked]
            distinct, place = _indexed(np.concatenate(grams))
            total = np.bincount(place, np.concatenate([grow(r["counts"]) for r in asked]).astype(np.float64), len(distinct)).astype(np.int64)
            at = 0
            for r, g in zip(asked, grams, strict=True):
                out.append((r["bucket"], r["chunk"], k, shrink(total[place[at : at + len(g)]]), 0, 0))
                at += len(g)
            if k == 1:
                real = distinct != np.uint64(BEGIN)
                out.append((asked[0]["bucket"], -1, 1, b"", int(total[real].sum()), int((total[real] > 0).sum())))
        release()
        return _table(out, "bucket chunk k counts tokens kinds", (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))

    def asked_for(new: tuple[int, ...], told: DataFrame | None) -> DataFrame:
        if told is None:
            asked = own.applyInArrow(lambda left: ask(left, None, new), asked_schema)
        else:
            asked = own.cogroup(told.repartitionById(chunks, F.col("chunk")).groupBy("chunk")).applyInArrow(lambda left, right: ask(left, right, new), asked_schema)
        return stash.keep(asked.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(answer, told_schema), f"counts-{new[-1]}")

    known = asked_for((1, 2), None)
    totals = known.where("chunk = -1").agg(F.sum("tokens"), F.sum("kinds")).first()
    total, kinds_n = totals[0] or 0, totals[1] or 0
    told = known.where("chunk >= 0").select("chunk", "k", "bucket", "counts")
    for k in range(3, order + 1):
        told = told.unionByName(asked_for((k,), told).select("chunk", "k", "bucket", "counts"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        chunk, counts = _read(left, right, order, support)
        log = Automaton(chunk, counts, total, kinds_n, trust, support).walk(chunk)
        own = counts[0][chunk.index[0]]
        real = chunk.token != np.uint64(BEGIN)
        group, own = chunk.rows[real], own[real]
        base = np.bincount(group, np.log10((own + 0.5) / (total + 0.5 * (kinds_n + 1))), chunk.size)
        out = [left.column("doc_id"), left.column("held"), pa.array(np.bincount(group, minlength=chunk.size), pa.int64()), pa.array(np.bincount(group, own > 0, chunk.size).astype(np.int64)),
               pa.array(np.full(chunk.size, total), pa.int64()), pa.array(base, pa.float64()), pa.array(log, pa.float64())]
        release()
        return pa.table(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return own.cogroup(told.repartitionById(chunks, F.col("chunk")).groupBy("chunk")).applyInArrow(score, schema)
