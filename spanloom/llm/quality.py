"""Quality classifier: a byte-level convolutional network in numpy (operator 8).

A text's bytes are covered by overlapping chunks. Learned filters over consecutive byte
embeddings are max-pooled over the positions of a chunk; a hidden layer combines them, its
units are max-pooled over the chunks of the whole document, and one logistic unit makes
them a probability.

The fit takes at most `max_rows` labelled rows, those of the smallest id digest.

Defined cases: null and empty texts are one chunk of padding and get its probability;
documents without a label are only scored; without labels of both kinds the score is
the share of label 1 (0.5 without labels); repeated rows are each scored; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import textbuf
from spanloom.llm.shared import documents, held_out
from spanloom.llm.toxicity import training_rows

CHUNK, STEP = 256, 192
WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 16, 4, 6, 32, 16
MAX_ROWS = 3000
SCHEMA = "doc_id long, score double"
NAMES = ("embed", "filters", "bias", "dense", "dense_bias", "out", "out_bias")


class Network:
    def __init__(self, seed: int = 11, constant: float | None = None):
        rng = np.random.default_rng(seed)
        f = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.embed = f(257, EMBED, scale=0.5)
        self.embed[256] = 0  # padding
        self.filters = f(WIDTH * EMBED, FILTERS, scale=1 / np.sqrt(WIDTH * EMBED))
        self.bias = np.zeros(FILTERS, np.float32)
        self.dense = f(FILTERS, HIDDEN, scale=1.0)
        self.dense_bias = np.zeros(HIDDEN, np.float32)
        self.out = f(HIDDEN, scale=0.3)
        self.out_bias = np.zeros(1, np.float32)
        self.constant = constant

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, positions, WIDTH * EMBED) embedded windows at every STRIDE-th byte."""
        x = self.embed[chunks].reshape(len(chunks), -1)
        s = x.strides[1]
        n = (chunks.shape[1] - WIDTH) // STRIDE + 1
        return np.lib.stride_tricks.as_strided(x, (len(chunks), n, WIDTH * EMBED), (x.strides[0], STRIDE * EMBED * s, s))

    def chunk_units(self, chunks: np.ndarray):
        """(windows, filters at every position, rectified maxima over positions, hidden units before the rectifier)."""
        w = self.windows(chunks)
        flat = np.ascontiguousarray(w).reshape(-1, WIDTH * EMBED)
        act = (flat @ self.filters).reshape(len(chunks), w.shape[1], FILTERS)
        top = np.maximum(act.max(1) + self.bias, 0)
        return flat, act, top, top @ self.dense + self.dense_bias

    def forward(self, chunks: np.ndarray, first: np.ndarray, block: int = 1024) -> np.ndarray:
        """Probabilities of the documents whose chunks start at `first`."""
        if self.constant is not None:
            return np.full(len(first), self.constant)
        units = np.concatenate([self.chunk_units(chunks[i : i + block])[3] for i in range(0, len(chunks), block)])
        pooled = np.maximum.reduceat(np.maximum(units, 0), first)
        return 1 / (1 + np.exp(-(pooled @ self.out + self.out_bias[0]).astype(float)))

    def gradients(self, chunks: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        flat, act, top, dense = self.chunk_units(chunks)
        hidden = np.maximum(dense, 0)
        count = np.diff(np.append(first, len(chunks)))
        pooled = np.maximum.reduceat(hidden, first)
        p = 1 / (1 + np.exp(-(pooled @ self.out + self.out_bias[0])))
        d = ((p - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ d, "out_bias": d.sum(keepdims=True)}
        best = (hidden == np.repeat(pooled, count, 0)) & (hidden > 0)
        d_dense = np.where(best, np.repeat(d[:, None] * self.out, count, 0), 0).astype(np.float32)
        g |= {"dense": top.T @ d_dense, "dense_bias": d_dense.sum(0)}
        d_top = (d_dense @ self.dense.T) * (top > 0)
        # only the position of a filter's maximum learns
        chunk, of = np.nonzero(d_top)
        where, each = act.argmax(1)[chunk, of], d_top[chunk, of]
        one = np.zeros((len(chunk), FILTERS), np.float32)
        one[np.arange(len(chunk)), of] = each
        g |= {"filters": flat.reshape(len(chunks), act.shape[1], -1)[chunk, where].T @ one, "bias": d_top.sum(0)}
        d_win = (self.filters.T[of] * each[:, None]).reshape(len(chunk), WIDTH, EMBED)
        codes = chunks[chunk[:, None], where[:, None] * STRIDE + np.arange(WIDTH)].ravel()
        d_embed = np.stack([np.bincount(codes, weights=d_win[..., e].ravel(), minlength=257) for e in range(EMBED)], 1)
        d_embed[256] = 0
        return g | {"embed": d_embed.astype(np.float32)}


def chunked(data: np.ndarray, off: np.ndarray, size: int = CHUNK, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping chunks of all texts (256 is padding) and each text's first chunk; an empty text has one."""
    n = np.diff(off)
    count = np.maximum(1, -(-np.maximum(n - size, 0) // step) + 1)
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(n)), count)
    start = (np.arange(len(doc)) - first[doc]) * step
    at = start[:, None] + np.arange(size)
    inside = at < n[doc][:, None]
    raw = np.append(data, 0)
    return np.where(inside, raw[np.minimum(off[:-1][doc][:, None] + at, len(data))].astype(np.int16), 256), first


def fit(texts: list[str | None], labels: np.ndarray, epochs: int = 10, batch: int = 32, rate: float = 4e-3, seed: int = 5) -> Network:
    """Adam over shuffled documents."""
    y = (labels > 0).astype(np.float32)
    if not len(y) or y.min() == y.max():
        return Network(constant=float(y.mean()) if len(y) else 0.5)
    net, rng = Network(), np.random.default_rng(seed)
    raw = [(t or "").encode() for t in texts]
    m = {k: np.zeros_like(getattr(net, k)) for k in NAMES}
    v = {k: np.zeros_like(getattr(net, k)) for k in NAMES}
    step, total = 0, epochs * -(-len(raw) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(raw))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            data = np.frombuffer(b"".join(raw[k] for k in own), np.uint8)
            off = np.concatenate(([0], np.cumsum([len(raw[k]) for k in own])))
            g = net.gradients(*chunked(data, off), y[own])
            step += 1
            lr = rate * (1 - step / (total + 1))
            for k in NAMES:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                x = getattr(net, k)
                x -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = textbuf.buffer(batch.column(1))
            out = [shared.value.forward(*chunked(part, at)) for _, _, part, at in textbuf.slabs(data, off, 1 << 19)]
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network:
    rows = training_rows(docs, labels, "quality", max_rows)
    return fit(rows["text"].tolist(), rows["label"].to_numpy())


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score_documents(docs, train(docs, documents(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
