"""Each operator against a plain version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrascape.llm import decontaminate, exact, mixing, near, personal, quality, scoring, substring, tokens, toxicity
from terrascape.llm.store import Stash

SCHEMA = "doc_id long, text string, lang string, source string, digest string, chunk int, size long, cls string, list string, uid long, score double, bucket int, held boolean"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def split(text, lower=False):
    data = (text or "").encode()
    if lower:
        data = re.sub(rb"[A-Z]", lambda m: m.group().lower(), data)
    return [w.decode() for w in WORDS.findall(data)]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "x", 1, 2, "c", "l", 3, 0.5, 4, True) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    g = random.Random(11)
    vocab = ["".join(g.choice("abcdeiorst") for _ in range(g.randint(1, 7))) for _ in range(300)]
    say = lambda n: " ".join(g.choice(vocab) for _ in range(n))
    base = say(80)
    out = []
    for k in range(12):  # loose copies
        w = base.split()
        for _ in range(k % 4):
            w[g.randrange(len(w))] = g.choice(vocab)
        out.append(" ".join(w))
    shared = say(30)
    out += [say(20) + "\n" + shared + "\t" + say(10) for _ in range(5)]
    out += [say(n) for n in (1, 2, 3, 4, 5, 12, 13, 14, 60)]
    out += ["", None, "   ", "\n\n", None, "A b C", "a B c", "é ü \x0b x", "x" * 40_000, say(9000), base, base, base.upper(), "one one one one one one one one one one one one one one one"]
    out = [(i * 3 % 97, t, ("s1", "s1", "s1", "s2", None)[i % 5]) for i, t in enumerate(out)]
    return [*out, (None, base, "s1"), (None, None, None), (None, None, None), out[0], out[12]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return docs_of(spark, rows).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def norm(x):
    return sorted(map(str, x))


def test_stash_keeps_parts_and_drops(spark):
    stash = Stash(spark, "t")
    kept = stash.keep(spark.createDataFrame([(1, True), (2, True), (3, False)], "a int, run boolean"), "x", by="run")
    runs = stash.part(kept, "run", "true")
    assert sorted(r.a for r in runs.collect()) == [1, 2] and stash.part(kept, "run", "none").count() == 0
    stash.drop(runs)
    assert stash.part(kept, "run", "true").count() == 0 and stash.part(kept, "run", "false").collect()[0].a == 3
    assert stash.root.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix_sources(docs, Stash(spark, "t"), bin_rows=4).collect()
    assert norm((r.doc_id, r.source, r.size) for r in got) == norm((i, s, len(split(t))) for i, t, s in rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(split(t))
    weight = {"s1": 1, "s2": 2, None: 3}
    total, target, open_ = sum(size.values()), {}, set(size)
    left = float(total)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
        left, open_ = total - sum(target.values()), open_ - over
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    again = mixing.mix_sources(docs.repartition(7), Stash(spark, "t"), bin_rows=4).collect()
    assert norm(map(tuple, again)) == norm(map(tuple, got))
    assert mixing.mix_sources(empty, Stash(spark, "t")).count() == 0


def exact_plain(rows, largest=True):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        kept = False
        for i in ids:
            mine = i == keep and not kept
            kept |= mine
            out.append((i, keep, len(ids), mine, hashlib.sha256(t.encode()).hexdigest()))
    return norm(out)


def test_exact(spark, docs, rows, empty):
    got = exact.exact_groups(docs, Stash(spark, "t"), "max", salt_rows=2)
    assert norm(map(tuple, got.collect())) == exact_plain(rows)
    weak = exact.exact_groups(docs, Stash(spark, "t"), "min", digest_of=lambda t: F.substring(exact.digest(t), 1, 1), salt_rows=2)
    assert norm(map(tuple, weak.collect())) == exact_plain(rows, False)
    assert exact.exact_groups(empty, Stash(spark, "t")).count() == 0


def test_digest_index_probe(spark):
    mem = spark.createDataFrame([(f"d{i % 40}", i) for i in range(100)], "digest string, doc_id long")
    index = exact.DigestIndex(Stash(spark, "t"), "min", fanout=2)
    index.flush(mem.where("doc_id < 50"))
    index.flush(mem.where("doc_id >= 50"))
    assert [level for level, _ in index.runs] == [1]
    hits = {r.digest: (r.keep_id, r.n) for r in index.probe(spark.createDataFrame([("d3", 900), ("zz", 901)], "digest string, doc_id long")).collect()}
    assert hits == {"d3": (3, 3)}


def shingles(text, k=5):
    w = split(text, True)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near(spark, docs, rows, empty):
    for percent in (85, 60):
        got = near.near_groups(docs, Stash(spark, "t"), percent=percent).collect()
        sets = [shingles(t) for _, t, _ in rows]
        parent = list(range(len(rows)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in itertools.combinations(range(len(rows)), 2):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and both:
                parent[root(a)] = root(b)
        least = {}
        for i, (d, _, _) in enumerate(rows):
            if d is not None:
                least[root(i)] = min(d, least.get(root(i), d))
        want = [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _, _) in enumerate(rows)]
        assert norm((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == norm((d, n, c, d == c) for d, n, c in want)
    assert near.near_groups(empty, Stash(spark, "t")).count() == 0


def test_near_without_id(spark):
    w = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(330)]
    at = lambda a, b: " ".join(w[a:b])
    rows = [(1, at(0, 100)), (None, at(5, 105)), (2, at(10, 110)), (3, at(200, 300)), (None, at(203, 303)), (None, at(203, 303))]  # 1 and 2 meet through the row between
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), Stash(spark, "t")).collect()
    assert norm((r.doc_id, r.component_id, r.kept) for r in got) == norm([(1, 1, True), (None, 1, False), (2, 1, False), (3, 3, True), (None, 3, False), (None, 3, False)])


def test_components(spark):
    b = lambda i: i.to_bytes(2, "big")
    links = spark.createDataFrame([(b(i), b(i + 1)) for i in range(40)] + [(b(100), b(101)), (b(101), b(100))], "a binary, b binary")
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.root, "big") for r in near.components(links, Stash(spark, "t")).collect()}
    assert got == dict.fromkeys(range(41), 0) | {100: 100, 101: 100}


def repeats_plain(rows, k):
    first = {}
    for d, t, _ in rows:
        w = split(t)
        for i in range(len(w) - k + 1) if d is not None else ():
            key = tuple(w[i : i + k])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, t, _ in rows:
        w = split(t)
        gone = set()
        for i in range(len(w) - k + 1) if d is not None else ():
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return norm(out)


def test_substring(spark, docs, rows, empty):
    got = substring.remove_repeats(docs, Stash(spark, "t"), k=13)
    assert norm(map(tuple, got.collect())) == repeats_plain(rows, 13)
    assert substring.remove_repeats(empty, Stash(spark, "t")).count() == 0


def test_substring_index_grows_by_batches(spark, docs, rows):
    index = substring.WindowIndex(Stash(spark, "t"), 13, buckets=3, chunks=5, fanout=2)
    hits = []
    for lo, hi in ((0, 20), (20, 40), (40, 100)):
        hits += [h for r in index.add(docs.where((F.col("doc_id") >= lo) & (F.col("doc_id") < hi))).collect() for h in np.frombuffer(r.hits, np.uint64).tolist()]
    whole = substring.WindowIndex(Stash(spark, "t"), 13, buckets=3, chunks=5)
    want = [h for r in whole.add(docs.where("doc_id IS NOT NULL")).collect() for h in np.frombuffer(r.hits, np.uint64).tolist()]
    assert set(hits) == set(want) and len(index.runs) <= 2


def test_substring_verification_does_not_misfire(spark, monkeypatch):
    """Passages put together from several places of the first document are no collisions: nothing is judged twice."""
    calls, real = [], substring._judge
    monkeypatch.setattr(substring, "_judge", lambda *a: calls.append(a) or real(*a))
    monkeypatch.setattr(substring, "PORTION", 3)
    w = [f"w{i}" for i in range(80)]
    rows = [(1, " ".join([*["x"] * 20, *w]), "s"), (2, " ".join([*["x"] * 50, "y", *w[40:], *w[:40]]), "s"), *((i, " ".join(w[i : i + 30]), "s") for i in range(3, 20)), (20, "x " * 500, "s")]
    got = substring.remove_repeats(docs_of(spark, rows), Stash(spark, "t"), k=13)
    assert norm(map(tuple, got.collect())) == repeats_plain(rows, 13)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    substring.remove_repeats(docs, Stash(spark, "t"), k=13).count()
    assert len(calls) == 2


def test_substring_collisions_are_judged_by_words(spark, docs, rows, monkeypatch):
    """With hits that say every window stands first in document 0, verification and words put the result right."""
    real = substring.WindowIndex.add

    def lies(self, batch, flush=True):
        found = real(self, batch, flush)
        ids = [r.doc_id for r in docs.select("doc_id").where("doc_id > 0").collect()]
        texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in ids}
        import pyarrow as pa

        extra = []
        for d, t in texts.items():
            fps = np.unique(substring.windows(pa.array([t or ""]), self.k)[4])
            extra.append((d % self.chunks, bytearray(fps.tobytes()), bytearray(np.zeros(len(fps), np.int64).tobytes())))
        return spark.createDataFrame(extra, "chunk int, hits binary, first binary") if flush else found.where("false")

    monkeypatch.setattr(substring.WindowIndex, "add", lies)
    got = substring.remove_repeats(docs, Stash(spark, "t"), k=13)
    assert norm(map(tuple, got.collect())) == repeats_plain(rows, 13)


def backoff_plain(rows, order, support, trust=8.0):
    """Chances word by word from plain counters: of a learned n-gram whose context was seen often enough, else of the shorter context's failure."""
    token = [["\0", *split(t, True), "\1"] for _, t, _ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _, _ in rows]
    seen = Counter()
    for w, h in zip(token, held, strict=True):
        if not h:
            seen.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    n = sum(c for g, c in seen.items() if len(g) == 1 and g != ("\0",))
    v = sum(len(g) == 1 and g != ("\0",) for g in seen)

    def chance(context, t):
        if not context:
            return (seen[(t,)] + 0.5) / (n + 0.5 * (v + 1))
        lower = chance(context[1:], t)
        return (seen[(*context, t)] + trust * lower) / (seen[context] + trust) if seen[context] >= support else lower

    out = []
    for (d, _, _), w, h in zip(rows, token, held, strict=True):
        base = sum(np.log10(chance((), t)) for t in w[1:])
        score = sum(np.log10(chance(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w)))
        out.append((d is None, d or 0, len(w) - 1, h, sum(seen[(t,)] > 0 for t in w[1:]), n, round(float(base), 6), round(float(score), 6)))
    return sorted(out), chance


@pytest.mark.parametrize(("order", "support"), [(2, 1), (3, 2), (4, 2)])
def test_scoring(spark, docs, rows, empty, order, support, monkeypatch):
    monkeypatch.setattr(scoring, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(scoring, "BUCKET_BYTES", 3000)
    got = scoring.lm_scores(docs, Stash(spark, "t"), order=order, support=support).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.held_out, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    want, _ = backoff_plain(rows, order, support)
    assert len(got) == len(want)
    for x, y in zip(got, want, strict=True):
        assert x[:6] == y[:6] and x[6:] == pytest.approx(y[6:], abs=1e-4)
    assert scoring.lm_scores(empty, Stash(spark, "t"), order=order).count() == 0


def test_scoring_model_is_a_distribution():
    """After any words, the chances of all known words, the end and one unknown word add up to 1."""
    rows = [(None, t, "s") for t in ("a b a c", "b a", "c c c a b a b a", "a b a c")]
    _, chance = backoff_plain(rows, 3, 2)
    for context in ((), ("a",), ("\0", "a"), ("a", "b"), ("b", "a"), ("zzz", "a")):
        assert sum(chance(context, t) for t in ["a", "b", "c", "\1", "zzz"]) == pytest.approx(1.0)


def test_automaton_carries_its_state():
    """The walk by lanes of any length, and by hand through the arcs, ends in the same sums; failure arcs lead to shorter contexts."""
    import pyarrow as pa

    g = random.Random(6)
    texts = [" ".join(g.choice("abcdef") for _ in range(g.choice([0, 1, 5, 60, 300]))) for _ in range(30)]
    chunk = scoring.Chunk(iter([pa.array(texts)]))
    counts = []
    for k in range(1, 4):
        chunk.add_level()
        counts.append(chunk.counts(k, np.arange(30) % 5 != 1))
    total = int(counts[0][chunk.distinct[0] != np.uint64(scoring.BEGIN)].sum())
    machine = scoring.Automaton(chunk, counts, total, 7, 8.0, 2)
    assert (machine.fail[1:] < np.arange(1, len(machine.fail))).all() and (machine.fail_weight <= 0).all()
    token, sums = chunk.index[0], []
    for r in range(30):
        state, log = 0, 0.0
        for i, t in enumerate(token[chunk.rows == r].tolist()):
            while (place := int(np.searchsorted(machine.key, state << 32 | t))) == len(machine.key) or machine.key[place] != state << 32 | t:
                log, state = log + machine.fail_weight[state] * (i > 0), int(machine.fail[state])
            log, state = log + machine.weight[place] * (i > 0), int(machine.to[place])
        sums.append(log)
    for lane in (1, 2, 3, 50, 1000):
        assert machine.walk(chunk, lane) == pytest.approx(sums)


def decontaminate_plain(item, text, rate):
    a, b = decontaminate.normal(item), decontaminate.normal(text)
    row = list(range(len(a) + 1))
    best, at = row[-1], 0
    for j, ch in enumerate(b, 1):
        new = [0]
        for i, x in enumerate(a, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (x != ch)))
        row = new
        if row[-1] < best:
            best, at = row[-1], j
    return (best, at) if best <= int(len(a) * rate) else None


def test_decontamination(spark, empty):
    g = random.Random(5)
    item = lambda n: "".join(g.choice("abcd ef") for _ in range(n)).strip()
    items = [(k, item(40 + 7 * k)) for k in range(6)] + [(9, "tiny"), (None, item(40)), (10, None)]
    rows = []
    for d in range(60):
        text = list(items[d % 6][1])
        for _ in range(d // 6):
            p = g.randrange(len(text))
            text[p : p + 1] = g.choice(["", "x", text[p] + "y"])
        rows.append((d, item(50) + "  " + "".join(text).upper() + "\n" + item(60), "s"))
    rows += [(100, None, None), (101, "", "s"), (None, items[0][1], "s"), (5, rows[5][1], "s")]
    docs, bench = docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t, _ in rows:
        for k, x in items:
            if k is not None and x and len(x) >= 24 and t and (m := decontaminate_plain(x, t, 0.08)):
                want.append((d, k, *m))
    assert 30 < len(want)
    for block in (100, 10**6):
        got = decontaminate.find_leaks(docs, bench, block_letters=block)
        assert norm(map(tuple, got.collect())) == norm(want)
    left = decontaminate.drop_leaked(docs, bench)
    assert norm((r.doc_id, r.text) for r in left.collect()) == norm((d, t) for d, t, _ in rows if not any(w[0] == d for w in want))
    assert left.columns == docs.columns
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(docs, bench.where("false")).count() == 0


def test_decontamination_short_and_bare_items(spark):
    bare = "an item that has no id but is quite long"
    bench = spark.createDataFrame([(1, "Tiny  Item"), (None, bare)], "item_id long, text string")
    docs = docs_of(spark, [(1, "a tiny item, here", "s"), (2, "a tiny items", "s"), (3, f"so: {bare}!", "s"), (4, "clean", "s")])
    assert [tuple(r) for r in decontaminate.find_leaks(docs, bench).collect()] == [(1, 1, 0, 11)]
    assert sorted(r.doc_id for r in decontaminate.drop_leaked(docs, bench).collect()) == [2, 4]


def base_plain(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m.group())]
        total = sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_personal_base_forms():
    g = random.Random(3)
    pieces = ["a.b@c.de", "@", "x@y", ".", "@-.-", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+49", "00", "-", " ", "é", "٣", "12", "a@b.c@d.e", "+", "(", "0000000000000000", "1..2.3.4", "\n"]
    for _ in range(4000):
        text = "".join(g.choice(pieces) for _ in range(g.randint(0, 12)))
        assert personal.base_spans(text) == base_plain(text), text
    assert personal.base_spans("a" * 300_000 + "1" * 300_000) == []


def test_personal_contexts_find_more(spark, empty):
    g = random.Random(2)
    noise = lambda: " ".join(g.choice(["sun", "tree", "road", "sky", "hill"]) for _ in range(6))
    rows = [(k, f"{noise()} call me at +1 555 {g.randint(100, 999)} {g.randint(1000, 9999)} {noise()}", "s") for k in range(30)]
    rows += [(50 + k, f"{noise()} call me at 555 {g.randint(100, 999)} {1000 + k} {noise()}", "s") for k in range(4)]
    rows += [(90, f"{noise()} in the year 1999 2000 2001 {noise()}", "s"), (91, None, None), (92, "", "s"), (None, "a@b.cd", "s")]
    got = {r.doc_id: r for r in personal.find_personal(docs_of(spark, rows), Stash(spark, "t")).collect()}
    assert all(got[k].n_phone == 1 and got[k].n_added == 0 for k in range(30))
    assert all(got[50 + k].n_phone == 0 and got[50 + k].n_added == 1 and got[50 + k].spans.startswith("phone:") for k in range(4))
    assert got[90].n_added == 0 and got[90].spans == "" and got[None].spans == "email:0:6"
    assert got[92].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert personal.find_personal(empty, Stash(spark, "t")).count() == 0


def bootstrap_plain(places, rounds=3, support=5, trust=0.9):
    """Accepted (kind, pattern) from places (kind, value, seed, pattern), by plain loops over the distinct edges."""
    edges = defaultdict(bool)
    for kind, value, seed, pattern in places:
        edges[kind, pattern, value] |= seed
    seeds = {(k, v) for (k, _, v), s in edges.items() if s}
    score = {(k, v): float((k, v) in seeds) for k, _, v in edges}
    every = Counter(p for _, p, _ in edges)
    strong = Counter((k, p) for (k, p, _), s in edges.items() if s)
    for _ in range(rounds):
        sums = Counter()
        for k, p, v in edges:
            sums[k, p] += score[k, v]
        confidence = {(k, p): sums[k, p] / (every[p] + personal.SMOOTH) for (k, p), n in strong.items() if n >= support}
        for k, v in score:
            if (k, v) not in seeds:
                mine = [confidence[k, p] for kk, p, vv in edges if (kk, vv) == (k, v) and (k, p) in confidence]
                score[k, v] = min(max(mine) ** 2, 1 - float(np.prod([max(1e-9, 1 - c) for c in mine]))) if mine else 0.0
    return {kp for kp, c in confidence.items() if c >= trust}


def test_personal_against_a_plain_bootstrap(spark):
    g = random.Random(5)
    hexes = lambda n: "".join(g.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    noise = lambda: " ".join(g.choice(["sun", "tree", "road", "sky", "hill"]) for _ in range(g.randint(1, 5)))
    kinds = [lambda: f'key = "{hexes(40)}"', lambda: f'key = "{hexes(14)}"', lambda: f"id {hexes(12)}", lambda: f"dial | +1 ({g.randint(100, 999)}) 555-{g.randint(1000, 9999)} |",
             lambda: f"dial | ({g.randint(100, 999)}) 555-{g.randint(1000, 9999)} |", lambda: f"mail a{g.randint(0, 99)}@b.cd", lambda: f"host {g.randint(1, 255)}.1.2.3"]
    texts = [(k, f"{noise()} {g.choices(kinds, [14, 2, 3, 9, 3, 3, 3])[0]()} {noise()}", "s") for k in range(120)]
    texts += [(200, None, "s"), (201, "", "s"), (202, 'x key = "' + "ab1" * 60_000 + '"', "s"), texts[0], texts[0]]
    places, found = [], []
    for d, t, _ in texts:
        base = personal.base_spans(t or "")
        own = [(a, b, k, True) for a, b, k in base] + [(a, b, k, k == "secret" and re.fullmatch("[0-9A-Fa-f]{32,}", t[a:b]) is not None) for a, b, k in personal.loose_spans(t or "", base)]
        found.append((d, base, own))
        places += [(k, t[a:b].lower(), s, p) for a, b, k, s in own for p in personal.contexts(t, a, b)]
    accepted = bootstrap_plain(places)
    assert {k for k, _ in accepted} >= {"secret", "phone"}
    want = []
    for (d, t, _), (_, base, own) in zip(texts, found, strict=True):
        added = [(a, b, k) for a, b, k, s in own if (not s or k == "secret") and any((k, p) in accepted for p in personal.contexts(t, a, b))]
        spans = sorted([*base, *added], key=lambda x: (x[0], personal.ALL_KINDS.index(x[2]), x[1]))
        want.append((d, ",".join(f"{k}:{a}:{b}" for a, b, k in spans), len(added), len(spans)))
    got = personal.find_personal(docs_of(spark, texts), Stash(spark, "t")).select("doc_id", "spans", "n_added", "n_spans").collect()
    assert norm(map(tuple, got)) == norm(want) and sum(w[2] for w in want) > 10


def test_tokens_match_a_unigram_tokenizer(spark, rows, docs, empty):
    from tokenizers import Tokenizer, models

    from terrascape.llm.queries import vocabulary_path

    pieces, bytewise = tokens.read_vocabulary(vocabulary_path())
    other = Tokenizer(models.Unigram([("<unk>", 0.0), *[(f"<0x{i:02X}>", 0.0) for i in range(256)], *pieces], 0, True))
    texts = [t or "" for _, t, _ in rows] + ["a  b\n\nc 中文 \U0001f600\U0001f600x   y", " lead", "\n", "☃☃"]
    counter = tokens.Counter(pieces, bytewise)
    for t in texts:
        assert counter.count(t) == (len(other.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids) if t else 0)
    few = [("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aa", -2.0), ("▁a", -3.0), ("aba", -3.0)]
    plain, small = Tokenizer(models.Unigram([("<unk>", -9.0), *few], 0, False)), tokens.Counter([*few, ("<unk>", -9.0)], False)
    for n in range(1, 6):
        for t in map("".join, itertools.product("ab z", repeat=n)):
            assert small.count(t) == len(plain.encode("▁" + t.replace(" ", "▁"), add_special_tokens=False).ids), t
    got = tokens.token_counts(docs, pieces, bytewise).collect()
    assert norm((r.doc_id, r.n_chars, r.n_tokens) for r in got) == norm((d, len(t or ""), counter.count(t or "")) for d, t, _ in rows)
    assert tokens.token_counts(empty, pieces, bytewise).count() == 0


def test_long_segments_are_counted_as_short_ones(monkeypatch):
    g = random.Random(3)
    pieces = [("".join(g.choice("abc") for _ in range(g.randint(1, 5))), -float(g.randint(1, 9))) for _ in range(40)]
    counter = tokens.Counter(list(dict(pieces).items()), True)
    texts = ["".join(g.choice("abcd") for _ in range(g.choice([1, 5, 50, 400]))) for _ in range(60)]
    want = [counter.segment(t) for t in texts]
    monkeypatch.setattr(tokens, "HELD", 4)
    assert [counter.segment(t) for t in texts] == want


def labelled(n=400, seed=1):
    g = random.Random(seed)
    word = lambda: "".join(g.choice(["er", "th", "on", "an", "re", "st", "in", "ou", "ti"]) for _ in range(g.randint(1, 4)))
    out = []
    for i in range(n):
        w, toxic = [word() for _ in range(g.randint(8, 60))], i % 3 == 0
        if toxic:
            for _ in range(2):
                w.insert(g.randrange(len(w)), g.choice(["idiot", "moron", "scum", "worthless", "pathetic"]))
        out.append((" ".join(w) + ".", int(toxic)))
    return out


def test_toxicity_learns_words_and_their_disguises():
    data, test = labelled(), labelled(seed=2)
    m = toxicity.train([t for t, _ in data], [y for _, y in data])
    m = toxicity.ToxicityModel.from_json(m.to_json())
    s = m.scores([t for t, _ in test])
    y = np.array([y for _, y in test])
    assert ((s >= 0.7) == y).mean() > 0.97
    assert (m.scores(["you id-iot", "i d i o t", "an idiiot here", "IDIOT!"]) >= 0.7).all()
    assert (m.scores(["", "   ", "thonre an the", "x" * 50_000]) < 0.5).all()
    flat = toxicity.train(["a", "b"], [0, 0])
    assert (flat.scores(["idiot", ""]) < 0.5).all()
    assert (toxicity.train([], []).scores(["a"]) <= 0.5).all()


def test_kernel_counts_gapped_triples():
    marks = toxicity.Landmarks(["abc", "xyz"])
    at, k = marks.kernel(["abc", "axbc", "qqq"])
    k = k ** (1 / toxicity.POWER)
    assert k[list(at).index(0)].tolist() == pytest.approx([1.0, 0.0])
    assert 0.2 < k[list(at).index(1), 0] < 1 and 2 not in at
    for least in (0.3, 0.6):
        words = ["".join(w) for w in itertools.product("abx", repeat=4)]
        near_ = set(marks.candidates(words, least).tolist())
        at, k = marks.kernel(words, -1.0)
        assert {int(i) for i, r in zip(at, k ** (1 / toxicity.POWER)) if r.max() > least + 1e-6} <= near_


def test_likeness_against_a_plain_count():
    def plain(word):
        marked, found = "^" + word + "$", defaultdict(float)
        for i, j, k in itertools.combinations(range(len(marked)), 3):
            if k - i < toxicity.SPAN:
                found[marked[i] + marked[j] + marked[k]] += toxicity.DECAY ** (k - i - 2)
        return found

    def likeness(a, b):
        x, y = plain(a), plain(b)
        return sum(x[t] * y.get(t, 0) for t in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5

    g = random.Random(4)
    marks = ["idiot", "worthless", "aaab"]
    words = ["idiot", "idxiot", "i", "worthles", *("".join(g.choice("aidotb") for _ in range(g.randint(1, 8))) for _ in range(200))]
    base = toxicity.Landmarks(marks)
    for least in (0.0, toxicity.LEAST):
        at, k = base.kernel(words, least)
        got = np.zeros((len(words), 3))
        got[at] = k
        want = np.array([[v**toxicity.POWER if (v := likeness(w, m)) > least else 0 for m in marks] for w in words])
        assert np.allclose(got, want, atol=1e-5)


def test_sentences():
    import pyarrow as pa

    part = toxicity.Sentences(pa.array(["One two. three\n\nfour! five", None, "", " ".join("abc" for _ in range(100)), "say i d i o t\tnow"]))
    words = [[part.word(i) for i in np.flatnonzero(part.sentence == s)] for s in range(len(part.row))]
    assert words[:4] == [["one", "two."], ["three"], ["four!"], ["five"]] and [len(w) for w in words[4:]] == [40, 40, 20, 7]
    assert part.row.tolist() == [0, 0, 0, 0, 3, 3, 3, 4] and part.spelled == [(7, "idiot")]
    m = toxicity.summary(np.array([2.0, -1.0, 5.0]), np.array([0, 0, 2]), np.array([10, 0, 4]), -1.0)
    assert m[:, 0].tolist() == [2, -1, 4] and m[:, 1].tolist() == [-1, -1, -1] and m[2, 2] > m[0, 2] > m[1, 2]


@pytest.mark.parametrize(("sf", "precision", "recall"), [("sf0.01", 0.9, 0.75), ("sf0.1", 0.9, 0.8)])
def test_toxicity_held_out(spark, sf, precision, recall):
    from terrascape.llm import queries

    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").where("toxic IS NOT NULL")
    got = queries.op8_toxicity(spark, f"/root/testdata/{sf}").where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits / sum(r.predicted for r in got) >= precision and hits / sum(r.toxic for r in got) >= recall
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quality_held_out(spark, sf):
    from terrascape.llm import queries

    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").where("quality IS NOT NULL")
    got = queries.op3_quality(spark, f"/root/testdata/{sf}").where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) >= 0.95


def test_learning_from_tables(spark, docs, rows, empty):
    data = labelled(240)
    table = docs_of(spark, [(i, t, "s") for i, (t, _) in enumerate(data)])
    labels = spark.createDataFrame([(i, 1 - y, y) for i, (_, y) in enumerate(data)] + [(None, 1, 1), (3, None, None), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(table, labels)
    got = toxicity.toxicity_scores(docs, model).collect()
    assert norm(r.doc_id for r in got) == norm(d for d, _, _ in rows) and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.drop_toxic(table, model)
    assert kept.columns == table.columns and abs(kept.count() - sum(1 - y for _, y in data)) < 12
    assert toxicity.toxicity_scores(empty, model).count() == 0
    net = quality.learn(table, labels)
    got = quality.quality_scores(docs, net).collect()
    assert norm(r.doc_id for r in got) == norm(d for d, _, _ in rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(empty, net).count() == 0
    twice = table.unionByName(table.where("doc_id < 40"))  # repeated ids, an empty and a null text, a very long one
    twice = twice.unionByName(docs_of(spark, [(1, "", "s"), (2, None, "s"), (7, "x" * 300_000 + " " + "idiot " * 9000, "s"), (None, "idiot " * 20, "s")]))
    for score in (toxicity.toxicity_scores(twice, toxicity.learn(twice, labels)), quality.quality_scores(twice, quality.learn(twice, labels))):
        assert score.count() == twice.count() and score.where("score IS NULL OR score < 0 OR score > 1").isEmpty()
    assert toxicity.learn(table, labels.where("false")) and quality.learn(table, labels.where("false"))


def test_quality_tells_junk():
    g = random.Random(1)
    text = lambda: " ".join("".join(g.choice("aeionrst") for _ in range(g.randint(2, 7))) for _ in range(g.randint(5, 150)))
    good, junk = [text() for _ in range(150)], [text().replace(" ", g.choice(["!! ", " | ", "*** "])) for _ in range(150)]
    net = quality.Network.load(quality.train([*good[:100], *junk[:100]], [1] * 100 + [0] * 100).dump())
    import pyarrow as pa

    s = quality.score_texts(net, pa.array([*good[100:], *junk[100:]]))
    assert ((s >= 0.5) == np.r_[np.ones(50), np.zeros(50)]).mean() > 0.9
    assert len(quality.score_texts(net, pa.array(["", None, "a" * 100_000], pa.string()))) == 3
    codes, first = quality.chunks(np.arange(700) % 256, np.array([0, 0, 300, 700]))
    assert first.tolist() == [0, 1, 3] and codes.shape == (6, 256) and codes[5, 143] == 699 % 256
