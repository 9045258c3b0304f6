"""Text quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

import base64
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import labelled_sample
from .textkit import buffers, release, slices

#: Bytes of one chunk and how far chunks are apart: each byte stands in two chunks.
CHUNK, STRIDE = 256, 128
#: Bytes under one filter, steps between its places, size of a byte's embedding, number of filters.
WIDTH, STEP, EMBED, FILTERS = 8, 4, 6, 24
#: Places of filters in one chunk.
PLACES = (CHUNK - WIDTH) // STEP + 1


class Network:
    """Byte embeddings, one layer of filters with rectifiers, max-pooled over each chunk, and a hidden-free output.

    A chunk's logit is linear in its pooled filters; the text's logit mixes the mean and the lowest chunk logit.
    """

    NAMES = ("embed", "filters", "bias", "out", "mean", "std", "head")

    def __init__(self, **weights: np.ndarray):
        self.__dict__.update(weights)

    @classmethod
    def fresh(cls, seed: int) -> Network:
        g = np.random.default_rng(seed)
        return cls(embed=g.normal(0, 0.5, (257, EMBED)).astype(np.float32), filters=g.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32), bias=np.zeros(FILTERS, np.float32),
                   out=g.normal(0, 0.1, FILTERS + 1).astype(np.float32), mean=np.zeros(1), std=np.ones(1), head=np.array([1.0, 0.0, 0.0]))

    def dump(self) -> str:
        f = io.BytesIO()
        np.savez(f, **{n: getattr(self, n) for n in self.NAMES})
        return base64.b64encode(f.getvalue()).decode()

    @classmethod
    def load(cls, text: str) -> Network:
        with np.load(io.BytesIO(base64.b64decode(text))) as z:
            return cls(**{n: z[n] for n in cls.NAMES})

    def places(self, codes: np.ndarray) -> np.ndarray:
        """codes: chunks x CHUNK bytes (256 beyond the end) -> chunks x PLACES x (WIDTH * EMBED)."""
        e = self.embed[codes]
        return np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1)[:, ::STEP].swapaxes(2, 3).reshape(len(codes), PLACES, WIDTH * EMBED)

    def pooled(self, codes: np.ndarray) -> np.ndarray:
        x = self.places(codes)
        return np.maximum((x.reshape(-1, x.shape[2]) @ self.filters).reshape(len(codes), PLACES, FILTERS).max(axis=1) + self.bias, 0)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return self.pooled(codes) @ self.out[:-1] + self.out[-1]

    def combine(self, logits: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of each text from its chunks' logits; first: index of each text's first chunk."""
        n = np.diff(np.r_[first, len(logits)])
        low = np.minimum.reduceat(logits, first)
        mean = np.add.reduceat(np.tanh(logits / 4), first) / n
        z = self.head[0] * mean + self.head[1] * np.tanh(low / 4) + self.head[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Chunks that are spread out at once.
BLOCK = 1024


def chunk_counts(offsets: np.ndarray) -> np.ndarray:
    """Number of overlapping chunks that cover each text whole; an empty text has one, of padding."""
    return np.maximum(1, -(-(np.diff(offsets) - CHUNK) // STRIDE) + 1)


def chunks(data: np.ndarray, offsets: np.ndarray, start: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The chunks start..stop of all texts' chunks, and the index of each text's first."""
    n = chunk_counts(offsets)
    first = np.cumsum(n) - n
    which = np.arange(start, int(n.sum()) if stop is None else stop)
    owner = np.searchsorted(first, which, "right") - 1
    begin = offsets[:-1][owner] + (which - first[owner]) * STRIDE
    at = begin[:, None] + np.arange(CHUNK)
    inside = at < offsets[1:][owner][:, None]
    codes = np.full(at.shape, 256, np.int16)
    codes[inside] = data[at[inside]]
    return codes, first


def score_texts(net: Network, texts: pa.Array) -> np.ndarray:
    """Probability of each text, whole; memory beside the text itself is that of BLOCK chunks and one number a chunk."""
    data, offsets = buffers(texts)
    if not len(texts):
        return np.zeros(0)
    n = chunk_counts(offsets)
    total = int(n.sum())
    logits = np.concatenate([net.logits(chunks(data, offsets, i, min(total, i + BLOCK))[0]) for i in range(0, total, BLOCK)])
    return net.combine(logits, np.cumsum(n) - n)


def train(texts: list[str], good: list[int], seed: int = 5, passes: int = 10, chunks_per_text: int = 8, rate: float = 0.01) -> Network:
    """Adam on chunks of the texts, both classes weighing the same, then the mix of mean and lowest chunk logit on whole texts."""
    net = Network.fresh(seed)
    y = np.array(good, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        net.head = np.array([0.0, 0.0, np.log((share + 1e-3) / (1 - share + 1e-3))])
        return net
    data, offsets = buffers(pa.array(texts, pa.string()))
    n = chunk_counts(offsets)
    g = np.random.default_rng(seed)
    some = [np.arange(k) if k <= chunks_per_text else np.sort(g.choice(k, chunks_per_text, replace=False)) for k in n]
    codes = np.concatenate([chunks(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0][s] for i, s in enumerate(some)])
    label = np.repeat(y, np.minimum(n, chunks_per_text))
    weight = np.repeat(np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / np.minimum(n, chunks_per_text), np.minimum(n, chunks_per_text))
    weight *= len(weight) / weight.sum()
    names = ("embed", "filters", "bias", "out")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    t = 0
    for p in range(passes):
        order = g.permutation(len(codes))
        for i in range(0, len(order), 128):
            of = order[i : i + 128]
            c = codes[of].copy()
            cut = np.where(g.random(len(c)) < 0.5, 16 * (CHUNK / 16) ** g.random(len(c)), CHUNK)  # short texts are rare, so some chunks are cut short
            c[np.arange(CHUNK)[None, :] >= cut[:, None]] = 256
            x = net.places(c)
            z = (x.reshape(-1, x.shape[2]) @ net.filters).reshape(len(c), PLACES, FILTERS)
            best = z.argmax(axis=1)
            pool = np.maximum(np.take_along_axis(z, best[:, None], 1)[:, 0] + net.bias, 0)
            logit = pool @ net.out[:-1] + net.out[-1]
            err = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[of]) * weight[of] / len(of)).astype(np.float32)
            back = (err[:, None] * net.out[:-1]) * (pool > 0)
            picked = x[np.arange(len(c))[:, None], best]
            grad = {"out": np.r_[pool.T @ err, err.sum()].astype(np.float32), "bias": back.sum(0), "filters": np.einsum("bfx,bf->xf", picked, back)}
            to_embed = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            under = c[np.arange(len(c))[:, None, None], (best * STEP)[:, :, None] + np.arange(WIDTH)].reshape(-1)
            grad["embed"] = np.stack([np.bincount(under, to_embed[:, e], 257) for e in range(EMBED)], axis=1).astype(np.float32)
            t += 1
            step = rate * (1 - p / passes)
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                setattr(net, k, getattr(net, k) - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7))
    x = np.ones((len(y), 3))
    for i in range(0, len(y), 50):
        c, first = chunks(data[offsets[i] : offsets[min(i + 50, len(y))]], offsets[i : i + 51] - offsets[i])
        logits = np.concatenate([net.logits(c[j : j + 512]) for j in range(0, len(c), 512)])
        x[i : i + 50, 0] = np.add.reduceat(np.tanh(logits / 4), first) / n[i : i + 50]
        x[i : i + 50, 1] = np.tanh(np.minimum.reduceat(logits, first) / 4)
    w = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    head = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ head, -30, 30)))
        h = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(3)
        head = head - np.linalg.solve(h, x.T @ (w * (p - y)) + 0.05 * head)
    net.head = head
    return net


def learn(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (3, 1), train_rows: int = 3000, longest: int = 32_768) -> str:
    """A network from at most train_rows labelled rows (see labelled_sample), as text.

    Without labelled rows of both classes, or with an empty table, it scores every text alike, by the share of good rows.
    """
    rows = labelled_sample(docs, labels, "quality", fold, train_rows, longest)
    return train([t for t, _ in rows], [c for _, c in rows]).dump()


def quality_scores(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, score of each row, whole texts.

    Null and empty texts score as a chunk of padding. Rows that repeat, or lack an id, are scored as any other; an empty table gives
    an empty result; further columns of docs are not read. Texts are taken in slices of about 1 MB; a longer one alone, in blocks of its chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.load(model)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score_texts(net, part.column("text")), pa.float64())], ["doc_id", "score"])
        release()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
