"""Toxicity by a subsequence string kernel over sentences, Nyström landmarks and a linear support vector machine.

A word is a vector of all ordered letter triples that span at most SPAN letters, each weighted by DECAY per skipped letter, so
inserted letters lower the likeness of two words only a little. The likeness of two sentences is the sum of the likenesses of their words, those of
at most LEAST counting as none, in training as in scoring. A sentence is a vector of likenesses with fixed landmark words,
turned by the landmarks' own kernel (Nyström); the machine learns from sentences: all of clean texts against the most toxic
ones of each toxic text, found anew by the machine. A text's probability follows from its best and second sentence and
from how much of it such sentences fill, with weights learned on texts that the machine was not trained on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import labelled_sample
from .textkit import buffers, release, slices, word_hashes, words

#: Letters that a triple may span, and its weight for each letter skipped.
SPAN, DECAY = 5, 0.5
#: Power of the normalised kernel, and the likeness (before the power) up to which two words count as unlike.
POWER, LEAST = 2, 0.54
#: Words longer than LETTERS are read in overlapping windows of WINDOW letters.
LETTERS, WINDOW = 32, 12
#: A sentence of more words counts as several.
SENTENCE = 40
#: Sentences that stand for a toxic text in training, and what landmarks must add to a sentence at least that does.
WITNESSES, LIKELY = 6, 0.3
#: What toxic words with a letter too many weigh in training, against the witnesses.
DISGUISED = 1.0
#: Known words that a task remembers before it starts anew; longer ones than LETTERS are not remembered.
REMEMBERED = 200_000

#: How tightly the weights of a summary are held.
RIDGE = 0.1

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_STEPS = [(a, b, DECAY ** (b - 2)) for b in range(2, SPAN) for a in range(1, b)]
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def forms(word: str) -> list[str]:
    """What is read of a word: without punctuation at its ends and, if it has some within, without that as well; in windows if it is long."""
    bare = word if word.isalpha() else _EDGE.sub("", word)
    out = [bare] if bare.isalpha() or not bare else [bare, _INNER.sub("", bare)]
    return [p for w in out if w for p in ([w] if len(w) <= LETTERS else [w[j : j + WINDOW] for j in range(0, len(w), WINDOW // 2)])]


class Sentences:
    """Words and sentences of texts, whole: word spans, their hashes, the sentence of each word, and the row of each sentence.

    A sentence ends at a word's final . ! or ?, at a line's end and after SENTENCE words. Three or more words of one letter in a row are spelled: joined, they
    are one further word of the sentence that they begin in.
    """

    def __init__(self, texts: pa.Array):
        lowered = pc.utf8_lower(pc.fill_null(texts, ""))
        self.data, offsets = buffers(lowered)
        self.size = len(texts)
        self.starts, self.ends, rows = words(self.data, offsets)
        n = len(self.starts)
        if not n:
            self.sentence, self.row, self.hashes, self.spelled = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), []
            return
        self.hashes = word_hashes(self.data, self.starts, self.ends)
        lines = np.cumsum(self.data == 10)[self.starts]
        head = np.ones(n, bool)
        head[1:] = (rows[1:] != rows[:-1]) | (lines[1:] != lines[:-1]) | _STOP[self.data[self.ends[:-1] - 1]]
        begin = np.flatnonzero(head)
        within = np.arange(n) - np.repeat(begin, np.diff(np.r_[begin, n]))
        head |= within % SENTENCE == 0
        self.sentence = np.cumsum(head) - 1
        self.row = rows[head]
        single = (self.ends - self.starts) == 1
        edge = np.flatnonzero(np.diff(np.r_[False, single, False].astype(np.int8)))
        #: (sentence, word) of each run of single letters
        self.spelled = [(int(self.sentence[a]), self.data[self.starts[a:b]].tobytes().decode()) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= 3]

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode()

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """A place of each distinct word, and the index among them of each word."""
        order = np.argsort(self.hashes)
        ranked = self.hashes[order]
        head = np.ones(len(ranked), bool)
        head[1:] = ranked[1:] != ranked[:-1]
        index = np.empty(len(ranked), np.int64)
        index[order] = np.cumsum(head) - 1
        return order[head], index


def _letters(listed: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words as numbers below 64, with marks of begin and end, and the word that each belongs to."""
    code = np.frombuffer(("\x01" + "\x02\x01".join(listed) + "\x02").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    return np.where((code >= 97) & (code <= 122), code - 94, np.where(code < 3, code, 29 + code % 35)), np.cumsum(code == 1) - 1


def _raw_triples(listed: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each choice of skipped letters: word index (ascending), triple and its weight."""
    flat, owner = _letters(listed)
    for a, b, weight in _STEPS:
        n = len(flat) - b
        if n > 0:
            same = np.flatnonzero(owner[:n] == owner[b:])
            yield owner[same], (flat[same] << 12) | (flat[same + a] << 6) | flat[same + b], weight


def triples(listed: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors of the words: word index, triple and weight, sorted by word and triple, each pair once."""
    parts = list(_raw_triples(listed))
    key = np.concatenate([(owner.astype(np.int64) << 18) | triple for owner, triple, _ in parts])
    weight = np.concatenate([np.full(len(owner), weight) for owner, _, weight in parts])
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first] >> 18, key[first] & ((1 << 18) - 1), np.add.reduceat(weight, first)


class Landmarks:
    """Kernel of words against fixed landmark words."""

    def __init__(self, listed: list[str]):
        self.words = listed
        owner, triple, weight = triples(listed)
        norm = np.sqrt(np.bincount(owner, weight**2, len(listed)))
        known = np.unique(triple)
        self.row = np.full(1 << 18, -1, np.int32)
        self.row[known] = np.arange(len(known))
        self.table = np.zeros((len(known), len(listed)), np.float32)
        self.table[self.row[triple], owner] = weight / norm[owner]
        #: In each group of like landmarks, the largest weight of a triple bounds the kernel from above.
        groups = np.array_split(np.argsort(np.array(listed)), max(1, len(listed) // 8))
        self.bound = np.zeros((len(known), len(groups)), np.float32)
        for g, of in enumerate(groups):
            self.bound[:, g] = self.table[:, of].max(axis=1)

    def candidates(self, listed: list[str], least: float) -> np.ndarray:
        """Indices of the words whose kernel with some landmark can exceed `least`."""
        top, norm = np.zeros((len(listed), self.bound.shape[1]), np.float32), np.zeros(len(listed))
        for owner, triple, weight in _raw_triples(listed):
            norm += np.bincount(owner, minlength=len(listed)) * weight**2  # merging equal triples only makes it larger
            row = self.row[triple]
            hit = np.flatnonzero(row >= 0)
            if len(hit):
                owner = owner[hit]
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                top[owner[first]] += np.add.reduceat(self.bound[row[hit]], first, axis=0) * np.float32(weight)
        return np.flatnonzero(top.max(axis=1) > least * np.sqrt(norm))

    def kernel(self, listed: list[str], least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Indices of words whose likeness with some landmark exceeds `least`, and their kernel with each; one that doesn't is 0."""
        some = self.candidates(listed, least)
        if not len(some):
            return some, np.zeros((0, len(self.words)), np.float32)
        owner, triple, weight = triples([listed[i] for i in some])
        norm = np.sqrt(np.bincount(owner, weight**2, len(some)))
        row = self.row[triple]
        hit = row >= 0
        owner, row, weight = owner[hit], row[hit], (weight[hit] / norm[owner[hit]]).astype(np.float32)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        values = np.empty((len(first), len(self.words)), np.float32)
        for i in range(0, len(first), 2048):
            a, b = first[i], first[i + 2048] if i + 2048 < len(first) else len(owner)
            values[i : i + 2048] = np.add.reduceat(self.table[row[a:b]] * weight[a:b, None], first[i : i + 2048] - a, axis=0)
        values = np.where(values > least, values**POWER, 0)
        like = values.any(axis=1)
        return some[owner[first][like]], values[like]


def svm(x: np.ndarray, y: np.ndarray, times: np.ndarray, cost: float = 300.0, rounds: int = 150) -> np.ndarray:
    """Linear machine with squared hinge loss; both classes weigh the same, a row as often as `times` says. The last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    share = (times * np.where(y > 0, 0.5 / max(1, times[y > 0].sum()), 0.5 / max(1, times[y < 0].sum())) * cost).astype(np.float32)
    y, tight = y.astype(np.float32), np.ones(x.shape[1], np.float32)
    tight[-1] = 1e-3  # the bias is hardly held
    w, v = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    weighted = x * np.sqrt(share)[:, None]
    step = np.float32(1.0 / (1 + 2 * np.linalg.eigvalsh(weighted.T @ weighted)[-1]))
    for t in range(rounds):  # accelerated gradient steps
        gap = np.maximum(0, 1 - y * (x @ v))
        following = v - step * (tight * v - 2 * (share * gap * y) @ x)
        v = following + np.float32(t / (t + 3)) * (following - w)
        w = following
    return w.astype(np.float64)


def summary(margins: np.ndarray, row: np.ndarray, n_words: np.ndarray, bias: float) -> np.ndarray:
    """Of each text: its best and second best sentence, and how much of it sentences on the toxic side fill. margins: of sentences; row: ascending."""
    n = len(n_words)
    best, second = np.full(n, bias), np.full(n, bias)
    if len(margins):
        order = np.lexsort((-margins, row))
        m, r = margins[order], row[order]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        best[r[first]] = m[first]
        following = first + 1
        ok = (following < len(r)) & (r[np.minimum(following, len(r) - 1)] == r[first])
        second[r[first[ok]]] = m[following[ok]]
    filled = np.bincount(row, np.clip(margins, 0, 3), n) if len(margins) else np.zeros(n)
    return np.c_[np.clip(best, -3, 4), np.clip(second, -3, 4), np.log((filled + 0.02) / (n_words / 100 + 0.5))]


class ToxicityModel:
    """landmarks, their weights beta and the bias of sentences; head: weights of a text's summary and an offset."""

    def __init__(self, listed: list[str], beta: np.ndarray, bias: float, head: np.ndarray):
        self.landmarks, self.beta, self.bias, self.head = Landmarks(listed), beta, bias, head

    def to_json(self) -> str:
        return json.dumps({"words": self.landmarks.words, "beta": self.beta.tolist(), "bias": self.bias, "head": self.head.tolist()})

    @classmethod
    def from_json(cls, text: str) -> ToxicityModel:
        m = json.loads(text)
        return cls(m["words"], np.array(m["beta"]), m["bias"], np.array(m["head"]))

    def word_scores(self, listed: list[str]) -> np.ndarray:
        """What each word adds to its sentence: of its forms the one that adds most; a form unlike all landmarks adds nothing."""
        out = np.zeros(len(listed))
        for i in range(0, len(listed), 20_000):
            shapes = [forms(w) for w in listed[i : i + 20_000]]
            owner = np.repeat(np.arange(len(shapes)), [len(f) for f in shapes])
            flat = [f for several in shapes for f in several]
            add = np.zeros(len(flat))
            for j in range(0, len(flat), 40_000):
                at, k = self.landmarks.kernel(flat[j : j + 40_000], LEAST)
                add[j + at] = k @ self.beta
            best = np.full(len(shapes), -np.inf)
            np.maximum.at(best, owner, add)
            out[i : i + len(shapes)] = np.where(np.isfinite(best), best, 0)
        return out

    def margins(self, part: Sentences, seen: dict[int, float]) -> np.ndarray:
        """Of each sentence. seen: what the task knows of words, by hash."""
        if not len(part.row):
            return np.zeros(0)
        at, index = part.distinct()
        keys = part.hashes[at].tolist()
        value = np.array([seen.get(k, np.nan) for k in keys])
        fresh = np.flatnonzero(np.isnan(value))
        value[fresh] = self.word_scores([part.word(i) for i in at[fresh]])
        if len(seen) + len(fresh) > REMEMBERED:
            seen.clear()
        short = fresh[(part.ends[at[fresh]] - part.starts[at[fresh]]) <= LETTERS][:REMEMBERED]
        seen.update(zip([keys[i] for i in short], value[short].tolist(), strict=True))
        out = np.bincount(part.sentence, value[index], len(part.row))
        if part.spelled:
            of, joined = zip(*part.spelled, strict=True)
            np.add.at(out, np.array(of), self.word_scores(list(joined)))
        return out + self.bias

    def scores(self, texts: pa.Array | list[str], seen: dict[int, float] | None = None) -> np.ndarray:
        """Probability of each text. seen: what the task knows of words, by hash; it is added to."""
        part = Sentences(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        n_words = np.bincount(part.row[part.sentence], minlength=part.size) if len(part.row) else np.zeros(part.size)
        x = summary(self.margins(part, {} if seen is None else seen), part.row, n_words, self.bias)
        return 1 / (1 + np.exp(-np.clip(x @ self.head[:-1] + self.head[-1], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights, none below 0, and offset of the probability, by Newton steps with a small penalty; columns that would weigh less than 0 are left out."""
    used, t = np.arange(x.shape[1]), (y > 0).astype(float)
    while True:
        z, w = np.c_[x[:, used], np.ones(len(x))], np.zeros(len(used) + 1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + RIDGE * np.eye(z.shape[1])
            w = w - np.linalg.solve(h, z.T @ (p - t) + RIDGE * w)
        if not (w[:-1] < 0).any():
            out = np.zeros(x.shape[1] + 1)
            out[used], out[-1] = w[:-1], w[-1]
            return out
        used = np.delete(used, int(np.argmin(w[:-1])))


class Bag:
    """The training texts, encoded once: distinct forms, and of each sentence its row and forms."""

    def __init__(self, texts: list[str]):
        index: dict[str, int] = {}
        of, sentence, rows, self.n_words = [], [], [], np.zeros(len(texts))
        base = 0
        for i in range(0, len(texts), 100):
            part = Sentences(pa.array(texts[i : i + 100], pa.string()))
            if not len(part.row):
                continue
            at, where = part.distinct()
            numbers = [[index.setdefault(f, len(index)) for f in forms(part.word(a))] for a in at]
            size = np.array([len(n) for n in numbers])
            flat, first = np.array([x for n in numbers for x in n], np.int64), np.cumsum(size) - size
            many = size[where]
            place = np.repeat(first[where], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            of.append(flat[place] if len(flat) else np.zeros(0, np.int64))
            sentence.append(base + np.repeat(part.sentence, many))
            for s, joined in part.spelled:
                of.append(np.array([index.setdefault(f, len(index)) for f in forms(joined)], np.int64))
                sentence.append(np.full(len(of[-1]), base + s))
            rows.append(i + part.row)
            self.n_words[i : i + 100] += np.bincount(part.row[part.sentence], minlength=part.size)
            base += len(part.row)
        join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        self.forms, self.form, self.sentence, self.row = list(index), join(of), join(sentence), join(rows)


def _evidence(bag: Bag, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each form: by how much more toxic texts hold it than clean ones (log), and how surely (nats beyond chance).

    A form counts in as many texts as hold it, but in no more than there are different sentences with it, so that copies of one text count little.
    """
    n = max(1, len(bag.forms))
    label = y[bag.row]
    words_of = np.random.default_rng(3).integers(0, 1 << 62, n)
    print_of = np.zeros(len(bag.row), np.int64)
    np.add.at(print_of, bag.sentence, words_of[bag.form])
    same = np.unique(print_of, return_inverse=True)[1]
    counts = []
    for side in (1, -1):
        on = label[bag.sentence] == side
        texts = np.bincount(np.unique(bag.row[bag.sentence[on]] * n + bag.form[on]) % n, minlength=n)
        said = np.bincount(np.unique(same[bag.sentence[on]] * n + bag.form[on]) % n, minlength=n)
        counts.append(np.minimum(texts, said))
    bad, good = counts
    share = (y > 0).sum() / max(1, (y != 0).sum())
    odds = np.log((bad + 0.5) / ((y > 0).sum() + 1)) - np.log((good + 1) / ((y < 0).sum() + 2))
    both = np.maximum(1, bad + good)
    sure = bad * np.log(np.maximum(bad, 1) / both / share) + good * np.log(np.maximum(good, 1) / both / (1 - share))
    return odds, np.where(odds > 0, sure, 0)


class Features:
    """Likeness of the training sentences with landmarks; sentences without any are only counted."""

    def __init__(self, bag: Bag, marks: list[int], told: int):
        """told: how many of the marks, the first, stand for toxic texts; with a letter inserted or doubled they are toxic sentences as well."""
        self.base = Landmarks([bag.forms[i] for i in marks])
        own, rows = self.base.kernel(self.base.words, LEAST)
        gram = np.zeros((len(marks), len(marks)))
        gram[own] = rows
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        keep = values > 1e-2 * values.max()
        self.root = vectors[:, keep] / np.sqrt(values[keep])
        variants = [w[:i] + c + w[i:] for w in self.base.words[:told] if len(w) > 3 for i in range(1, len(w)) for c in ("x", w[i])]
        self.disguised = self.base.kernel(variants, LEAST)[1] if variants else np.zeros((0, len(marks)), np.float32)
        parts = [self.base.kernel(bag.forms[j : j + 40_000], LEAST) for j in range(0, len(bag.forms), 40_000)]
        self.like = np.concatenate([a + 40_000 * j for j, (a, _) in enumerate(parts)])
        self.k = np.concatenate([k for _, k in parts])
        slot = np.full(len(bag.forms), -1)
        slot[self.like] = np.arange(len(self.like))
        self.on = slot[bag.form] >= 0
        self.touched, where = np.unique(bag.sentence[self.on], return_inverse=True)
        order = np.argsort(where, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(where[order]) > 0]) if len(order) else order
        of, self.x = slot[bag.form[self.on]][order], np.zeros((len(self.touched), len(marks)), np.float32)
        for i in range(0, len(first), 4096):
            a, b = first[i], first[i + 4096] if i + 4096 < len(first) else len(of)
            self.x[i : i + 4096] = np.add.reduceat(self.k[of[a:b]], first[i : i + 4096] - a, axis=0)
        self.row = bag.row[self.touched]

    def fit(self, bag: Bag, y: np.ndarray, guess: np.ndarray, times: int = 2) -> tuple[np.ndarray, float]:
        """Weights and bias from the clean sentences and each toxic text's witnesses, those WITNESSES sentences that the guess, and then the machine, finds most toxic."""
        label = y[self.row]
        clean = np.flatnonzero(label < 0)
        plain = int((y[bag.row] < 0).sum()) - len(clean)
        toxic = np.flatnonzero(label > 0)
        beta, bias = np.zeros(self.x.shape[1]), -1.0
        for _ in range(times):
            order = toxic[np.lexsort((-guess[toxic], self.row[toxic]))]
            rows = self.row[order]
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
            place = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
            witness = order[(place < WITNESSES) & (guess[order] > 0)]
            z = np.vstack([self.x[witness], self.disguised, self.x[clean], np.zeros((1, self.x.shape[1]), np.float32)]) @ self.root
            times_ = np.r_[np.ones(len(witness)), np.full(len(self.disguised), DISGUISED * len(witness) / max(1, len(self.disguised))), np.ones(len(clean)), max(1, plain)]
            w = svm(z, np.r_[np.ones(len(witness) + len(self.disguised)), -np.ones(len(clean) + 1)], times_)
            beta, bias = self.root @ w[:-1], float(w[-1])
            guess = self.x @ beta - LIKELY
        return beta, bias


def train(texts: list[str], toxic: list[int], landmarks: int = 160, sure: float = 9.0, folds: int = 5) -> ToxicityModel:
    """A model of the texts; toxic: 1 or 0 of each. With one class only, or no text, every text scores alike.

    Half of the landmarks are the words that toxic texts hold more often, by `sure` nats beyond chance; the others words of clean texts that a first machine takes
    for toxic. The weights of a text's summary are learned on margins of machines that were fitted without that text.
    """
    y = np.where(np.array(toxic, dtype=int) > 0, 1, -1)
    share = float((y > 0).mean()) if len(y) else 0.0
    alike = ToxicityModel(["a"], np.zeros(1), 0.0, np.r_[np.zeros(3), np.log((share + 1e-3) / (1 - share + 1e-3))])
    if not len(y) or y.max() < 0 or y.min() > 0:
        return alike
    bag = Bag(texts)
    odds, known = _evidence(bag, y)
    marks = [i for i in np.lexsort((bag.forms, -known)) if known[i] > sure and len(bag.forms[i]) > 1][: landmarks // 2]
    if not marks:
        return alike
    told = len(marks)
    features = Features(bag, marks, told)
    beta, _ = features.fit(bag, y, features.x @ odds[marks])
    add = np.zeros(len(bag.forms))
    add[features.like] = features.k @ beta
    add[np.bincount(bag.form[y[bag.row[bag.sentence]] < 0], minlength=len(bag.forms)) == 0] = 0
    add[marks] = 0
    marks += [i for i in np.lexsort((bag.forms, -add))[: landmarks - landmarks // 2] if add[i] > 0]
    features = Features(bag, marks, told)
    guess = features.x @ np.where(np.arange(len(marks)) < told, odds[marks], 0)
    turn = np.zeros(len(y), int)
    for side in (1, -1):
        turn[y == side] = np.arange((y == side).sum()) % folds
    x = np.zeros((len(y), 3))
    for f in range(folds):
        beta, bias = features.fit(bag, np.where(turn == f, 0, y), guess)
        x[turn == f] = summary(features.x @ beta + bias, features.row, bag.n_words, bias)[turn == f]
    beta, bias = features.fit(bag, y, guess)
    return ToxicityModel(features.base.words, beta, bias, _logistic(x, y))


def learn(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (3, 1), train_rows: int = 3000, longest: int = 32_768) -> str:
    """A model from at most train_rows labelled rows (see labelled_sample), as JSON.

    Without labelled rows of both classes, or with an empty table, the model scores every text alike, by the share of toxic rows.
    """
    rows = labelled_sample(docs, labels, "toxic", fold, train_rows, longest)
    return train([t for t, _ in rows], [c for _, c in rows]).to_json()


def _judged(model: str, keep: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, seen = ToxicityModel.from_json(model), {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield keep(part, judge.scores(part.column("text"), seen))
        del judge, seen
        release()

    return run


def toxicity_scores(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, score of each row, whole texts.

    Null and empty texts score as a text without words. Rows that repeat, or lack an id, are scored as any other; an empty table
    gives an empty result; further columns of docs are not read. Texts are taken in slices of about 1 MB; a longer one alone.
    """

    def keep(part: pa.RecordBatch, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_judged(model, keep), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: str, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold; null, empty, repeated and long texts as in toxicity_scores. An empty table stays empty."""

    def keep(part: pa.RecordBatch, score: np.ndarray) -> pa.RecordBatch:
        return part.filter(pa.array(score < threshold, pa.bool_()))

    return docs.mapInArrow(_judged(model, keep), docs.schema)
