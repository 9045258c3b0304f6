"""Personal data: exact base forms, and bootstrapped contexts that find identifiers the base forms miss.

Besides the four base kinds there is a fifth that contexts alone can tell, secrets (keys, tokens, passwords): strict ones are seeds, and only
those that stand in an accepted context are reported.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Stash

#: The kinds in the order in which spans at one place are listed.
KINDS = ("email", "ip", "card", "phone")
#: With the kind that only contexts tell.
ALL_KINDS = (*KINDS, "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match starts at the first digit of a run, so starts within the run need no trial.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Loose forms: what an accepted context may turn into personal data of a kind.
_LOOSE = {
    "email": re.compile(r"[^\s@]{1,64}(?:@|\s?[(\[]at[)\]]\s?)[^\s@]{2,255}", re.ASCII),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,5}(?:[.:][0-9]{1,5}){2,7}(?![0-9])", re.ASCII),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ .-]?[0-9]){10,22}(?![0-9])", re.ASCII),
    "phone": re.compile(r"(?<![0-9+])[0-9(][0-9() ./-]{5,22}[0-9](?![0-9])", re.ASCII),
    "secret": re.compile(r"(?<![A-Za-z0-9])(?=[^\s0-9]{0,127}[0-9])(?=[^\sA-Za-z]{0,127}[A-Za-z])[A-Za-z0-9][A-Za-z0-9_+/=-]{10,127}(?![A-Za-z0-9])", re.ASCII),
}
#: Loose secrets that are seeds: long enough and of digits and the letters a to f only.
_STRICT = re.compile(r"[0-9A-Fa-f]{32,}")
_WORD = re.compile(r"\w+|[^\w\s]")
#: Letters of context read on either side of a span.
REACH = 48
#: Values that a pattern's confidence counts besides its own, as if they were of another kind.
SMOOTH = 0.5


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: letters of the local part can't hold one, so it starts as far left as it can."""
    after, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > after and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            yield a, m.end()
            after = m.end()
        at = text.find("@", max(at + 1, after))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of leftmost matches that don't overlap within a kind; matches that fail a kind's test are dropped."""
    out = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


#: Classes that say nothing of what they surround: a pattern of classes holds one other at least.
_PLAIN = frozenset(("w", "0", "x", "^", "$", ".", ","))


def _shape(token: str) -> str:
    """The class of a word or sign: a word, a number, both, or the sign itself."""
    if token.isdigit():
        return "0"
    return "w" if token.isalpha() else "x" if token[0].isalnum() else token


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place, in lower case with digits as 0: up to three words before, one before with one after; the same by the classes of words,
    if they hold some sign, where ^ and $ are the ends of the line, and signs (separators of columns, quotes) stand for themselves."""
    before, after = text[max(0, start - REACH) : start], text[end : end + REACH]
    line_left, line_right = before[before.rfind("\n") + 1 :], after.split("\n", 1)[0]
    left = [re.sub(r"[0-9]+", "0", w) for w in _WORD.findall(before.lower())[-3:]]
    right = [re.sub(r"[0-9]+", "0", w) for w in _WORD.findall(after.lower())[:1]]
    out = [" ".join(left[-n:]) + " _" for n in range(1, len(left) + 1)]
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    shapes = ["^", *map(_shape, _WORD.findall(line_left))][-3:]
    following = _shape(m.group()) if (m := _WORD.search(line_right)) else "$"
    out += [f"<{' '.join(s)} _ {following}>" for s in (shapes, shapes[-2:]) if not _PLAIN.issuperset([*s, following])]
    return list(dict.fromkeys(out))


def loose_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Places of the loose forms that overlap no base span; the first kind that fits a place."""
    starts, ends, out = [], [], []  # taken places, apart from each other and in order
    for a, b, _ in sorted(base):
        if ends and a < ends[-1]:
            ends[-1] = max(b, ends[-1])
        else:
            starts.append(a)
            ends.append(b)
    for kind in (ALL_KINDS[-1], *KINDS):  # a secret may hold digits that look like another kind
        if kind != "email" and not _DIGIT.search(text) or kind == "email" and "@" not in text and "at" not in text:
            continue
        for m in _LOOSE[kind].finditer(text):
            i = bisect_right(starts, m.start())
            if (i == 0 or ends[i - 1] <= m.start()) and (i == len(starts) or starts[i] >= m.end()):
                starts.insert(i, m.start())
                ends.insert(i, m.end())
                out.append((*m.span(), kind))
    return out


_ROW = "uid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, found array<struct<kind: string, start: long, end: long, value: string, seed: boolean, contexts: array<string>>>"


def _occurrences(docs: DataFrame) -> DataFrame:
    """One row for each of docs with its base spans, and all places with their contexts."""
    kinds = (*[pa.int64()] * 6, pa.string(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("seed", pa.bool_()), ("contexts", pa.list_(pa.string()))])))
    names = ["uid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                places = [(*s, True) for s in base] + [(a, b, k, k == "secret" and _STRICT.fullmatch(text, a, b) is not None) for a, b, k in loose_spans(text, base)]
                found = [{"kind": k, "start": a, "end": b, "value": re.sub(r"\s+", " ", text[a:b].lower()), "seed": seed, "contexts": contexts(text, a, b)} for a, b, k, seed in places]
                n = [sum(k == kind for _, _, k in base) for kind in KINDS]
                rows.append((uid, doc_id, *n, ",".join(f"{k}:{a}:{b}" for a, b, k in base), found))
                uid += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _ROW)


def bootstrap(places: DataFrame, stash: Stash, rounds: int = 3, support: int = 5, trust: float = 0.9) -> DataFrame:
    """Accepted patterns: kind, pattern, seeds, confidence. places: kind, value, seed, pattern.

    A graph links patterns with the distinct values that they surround. A seed value scores 1. Each round, a pattern's confidence is the
    sum of the scores of its values of that kind over the number of all its values, of any kind, and SMOOTH more; a value that is no seed then scores 1 - the product of
    (1 - confidence) over its patterns that have enough support, and never more than the best of them squared. Patterns with at least `support` distinct seeds
    and a confidence of `trust` are accepted. The tables hold distinct values, so a value that repeats a million times is one row.
    """
    edges = stash.keep(places.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed")), "graph")
    values = stash.keep(edges.groupBy("kind", "value").agg(F.max("seed").alias("seed")).withColumn("score", F.col("seed").cast("double")), "values")
    able = edges.where("seed").groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= support)
    total = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("all"))
    able = stash.keep(able.join(total, "pattern"), "able")  # patterns that may come to be accepted
    kept = stash.keep(edges.join(_small(able.select("kind", "pattern")), ["kind", "pattern"]), "edges")
    patterns = None
    for _ in range(rounds):
        scored = kept.drop("seed").join(values, ["kind", "value"])
        patterns = scored.groupBy("kind", "pattern").agg(F.sum("score").alias("sum"))
        patterns = stash.keep(patterns.join(able, ["kind", "pattern"]).select("kind", "pattern", "seeds", (F.col("sum") / (F.col("all") + SMOOTH)).alias("confidence")), "patterns")
        lift = kept.where(~F.col("seed")).join(_small(patterns), ["kind", "pattern"]).groupBy("kind", "value")
        lift = lift.agg(F.max("confidence").alias("top"), F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))).alias("doubt"))
        lift = lift.select("kind", "value", F.least(F.col("top") * F.col("top"), 1 - F.exp("doubt")).alias("lifted"))
        values = stash.keep(values.join(lift, ["kind", "value"], "left").select("kind", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("lifted", F.lit(0.0))).alias("score")), "values")
    return patterns.where(F.col("confidence") >= trust)


def _small(patterns: DataFrame, most: int = 200_000) -> DataFrame:
    """Patterns to be broadcast if there are at most `most`, so that one that a third of all places have doesn't meet in one task; else joined by key."""
    return F.broadcast(patterns) if patterns.count() <= most else patterns


def find_personal(docs: DataFrame, stash: Stash, rounds: int = 3, support: int = 5, trust: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans of each row of docs.

    Base spans follow fixed forms; they, and strict secrets, are the seeds of a bootstrap over all rows: the words around seeds become patterns, pattern
    and value scores are iterated, and places of a loose form of the same kind in an accepted pattern are added (of secrets the strict ones as well). spans lists base
    and added ones as kind:start:end in code points, by start, then kind; n_spans counts them. A null or empty text has none; rows that repeat are rows of
    their own; empty tables give an empty result; further columns of docs are not read.
    """
    rows = stash.keep(_occurrences(docs), "places")
    found = rows.select("uid", F.explode("found").alias("p")).select("uid", "p.kind", "p.start", "p.end", "p.value", "p.seed", F.explode("p.contexts").alias("pattern"))
    accepted = bootstrap(found.select("kind", "pattern", "value", "seed"), stash, rounds, support, trust).select("kind", "pattern")
    added = found.where(~F.col("seed") | (F.col("kind") == "secret")).join(_small(accepted), ["kind", "pattern"]).select("uid", "kind", "start", "end").distinct()
    added = added.groupBy("uid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))  # of one text
    rank = F.create_map(*[F.lit(x) for pair in ((k, i) for i, k in enumerate(ALL_KINDS)) for x in pair])
    own = F.transform(F.filter("found", lambda p: p["seed"] & (p["kind"] != "secret")), lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))
    every = F.transform(F.concat(own, F.coalesce("added", F.array().cast("array<struct<start: long, kind: string, end: long>>"))), lambda p: F.struct(p["start"], rank[p["kind"]], p["end"], p["kind"]))
    spans = F.array_join(F.transform(F.array_sort(every), lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")
    return rows.join(added, "uid", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"), F.size(every).cast("long").alias("n_spans"))
