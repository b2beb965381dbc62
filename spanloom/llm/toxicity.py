"""Toxicity by a linear-chain conditional random field (operator 6).

Token labels come from the labelled documents: in a toxic one, a word that is several
times likelier in toxic than in other documents is a toxic token. A two-state chain
(emissions by word, transitions, start) is trained on them by gradient ascent on the
conditional likelihood. Forward-backward marginals then tag the tokens of every whole
text; a document's score combines the marginals by a noisy or, and the offending spans
are runs of tokens whose marginal is at least one half.

A text is one chain. It is computed in segments of SEGMENT words, side by side, which hand
the state on to each other, so that a batch is one matrix whatever its texts' lengths. The
fit takes at most `max_rows` labelled rows that have a text, those of the smallest id digest.

Defined cases: null and empty texts have no tokens and score 0; documents without a
label are only scored; without labels the scores are 0; repeated rows are each scored;
of several labels of one document each is used; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import textbuf
from spanloom.llm.shared import documents, held_out

SEGMENT = 64
#: The training rows: so many at most, and none of more bytes, as they are held by the driver.
MAX_ROWS, MAX_TEXT = 3000, 1 << 17
#: Marginals under it are left out of a document's score: the many small ones of a long clean text are no evidence.
FLOOR = 0.05
SCHEMA = "doc_id long, score double, spans array<struct<start:int,end:int,marginal:double>>"


class Chain:
    """Two states; `weights` are emission log-odds of known words, by sorted word hash."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, trans: np.ndarray, bias: float):
        self.words, self.weights, self.trans, self.bias = words, weights, trans, bias

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Positions in words; len(words) for an unknown word."""
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, len(self.words))

    def emissions(self, index: np.ndarray) -> np.ndarray:
        return np.append(self.weights, 0.0)[index] + self.bias


def segments(first: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word, length and text of the segments that cover all texts."""
    n = np.diff(first)
    count = (n + size - 1) // size
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][doc] + k * size, np.minimum(size, n[doc] - k * size), doc


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray, size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Exact posteriors of state 1 of every word, and expected transitions (2, 2), of one chain a text.

    score: log-odds of state 1 by word; first: each text's first word, and the end. Texts are laid out
    as segments, so that a step is one operation on all of them whatever the texts' lengths; what
    comes before and after a segment reaches it as its entering and leaving vectors.
    """
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    start, length, text = segments(first, size)
    rows, mask = matrix(score, start, length, 0.0)
    e, psi = np.exp(np.clip(rows, -30, 30)), np.exp(trans)
    head = np.ones(len(start), bool)  # a text's first segment, whose first word has no transition
    head[1:] = text[1:] != text[:-1]
    # each segment's transfer, from the state before it to that of its last word
    m = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, len(start)))
    for i in range(rows.shape[1]):
        m = _step(m, e[:, i], psi, head if i == 0 else None, mask[:, i])
    enter = np.ones((2, len(start)))
    leave = np.ones((2, len(start)))
    place = np.arange(len(start)) - np.maximum.accumulate(np.where(head, np.arange(len(start)), 0))
    order = np.argsort(place, kind="stable")
    groups = np.split(order, np.cumsum(np.bincount(place))[:-1])  # the texts' first segments, their second ones, ...
    for own in groups[1:]:
        y = enter[0, own - 1] * m[0][:, own - 1] + enter[1, own - 1] * m[1][:, own - 1]
        enter[:, own] = y / y.sum(0)
    for own in reversed(groups[1:]):
        y = m[:, 0, own] * leave[0, own] + m[:, 1, own] * leave[1, own]
        leave[:, own - 1] = y / y.sum(0)
    t = rows.shape[1]
    a = np.empty((t, 2, len(start)))
    x = (enter / enter.sum(0))[None]
    for i in range(t):
        x = _step(x, e[:, i], psi, head if i == 0 else None, mask[:, i])
        a[i] = x[0]
    b0, b1 = leave
    out, pairs = np.empty(rows.shape), np.zeros((2, 2))
    for i in range(t - 1, -1, -1):
        live = mask[:, i]
        x1 = a[i, 1] * b1
        out[:, i] = x1 / (a[i, 0] * b0 + x1)
        y1 = b1 * e[:, i]
        before = a[i - 1] if i else enter
        joint = np.array([[before[0] * psi[0, 0] * b0, before[0] * psi[0, 1] * y1], [before[1] * psi[1, 0] * b0, before[1] * psi[1, 1] * y1]])
        counted = live if i else live & ~head
        pairs += (joint / joint.sum((0, 1)))[:, :, counted].sum(2)
        c0, c1 = b0 * psi[0, 0] + y1 * psi[0, 1], b0 * psi[1, 0] + y1 * psi[1, 1]
        total = c0 + c1
        b0, b1 = np.where(live, c0 / total, b0), np.where(live, c1 / total, b1)
    return out[mask], pairs


def _step(x: np.ndarray, e: np.ndarray, psi: np.ndarray, head: np.ndarray | None, live: np.ndarray) -> np.ndarray:
    """Forward vectors (one or more, state, segments) after one more word, scaled to a sum of 1 a segment.

    head: words without a transition. Where there is no live word nothing changes.
    """
    y = np.stack([x[:, 0] * psi[0, 0] + x[:, 1] * psi[1, 0], x[:, 0] * psi[0, 1] + x[:, 1] * psi[1, 1]], 1)
    if head is not None:
        y = np.where(head, x, y)
    y[:, 1] *= e
    y /= y.sum((0, 1))
    return y if live.all() else np.where(live, y, x)


def matrix(values: np.ndarray, start: np.ndarray, length: np.ndarray, fill: float):
    width = int(length.max())
    at = start[:, None] + np.arange(width)
    mask = np.arange(width) < length[:, None]
    return np.where(mask, values[np.minimum(at, len(values) - 1)], fill), mask


def fit(texts: list[str | None], toxic: np.ndarray, least: int = 3, ratio: float = 3.0, steps: int = 30, rate: float = 1.0, l2: float = 1e-3) -> Chain:
    """Token labels by frequencies, then gradient ascent on the chain's likelihood."""
    empty = Chain(np.zeros(0, np.uint64), np.zeros(0), np.zeros((2, 2)), -30.0)
    data, off = textbuf.buffer(pa.array(texts, pa.string()))
    parts = [textbuf.hashed_words(d, o, textbuf.NOT_WORD) for _, _, d, o in textbuf.slabs(data, off)]
    hashes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    if not len(hashes) or not toxic.any() or toxic.all():
        return empty
    counts = np.concatenate([np.diff(p[3]) for p in parts])
    first = np.concatenate(([0], np.cumsum(counts)))
    doc = np.repeat(np.arange(len(counts)), counts)
    vocabulary, word = np.unique(hashes, return_inverse=True)
    before = np.append(len(vocabulary), word[:-1])
    before[first[:-1][counts > 0]] = len(vocabulary)
    _, one = np.unique(word * (len(vocabulary) + 1) + before, return_index=True)
    bad = toxic[doc] > 0
    # a word counts once for each word before it, so that copies of a passage are one occurrence
    _, one_bad = np.unique(np.where(bad, word * (len(vocabulary) + 1) + before, -1), return_index=True)
    one_bad = one_bad[bad[one_bad]]
    n = np.bincount(word[one], minlength=len(vocabulary))
    n1 = np.bincount(word[one_bad], minlength=len(vocabulary))
    share = bad.mean()
    marked = n1 > ratio * n * share + 2
    marked &= n1 > n * share + 5 * np.sqrt(n * share) + 2
    label = (marked[word] & (toxic[doc] > 0)).astype(float)
    known = np.flatnonzero(np.bincount(word, minlength=len(vocabulary)) >= least)
    chain = Chain(vocabulary[known], np.zeros(len(known)), np.zeros((2, 2)), -3.0)
    index = np.append(np.arange(len(known)), len(known))[np.searchsorted(known, word).clip(max=len(known) - 1)] if len(known) else word * 0
    index = np.where(len(known) and known[np.minimum(index, len(known) - 1)] == word, index, len(known))
    tokens = np.maximum(1.0, np.bincount(index, minlength=len(known) + 1)[:-1])
    gold_words = np.bincount(index, weights=label, minlength=len(known) + 1)
    inner = np.flatnonzero(doc[1:] == doc[:-1])  # transitions inside a text
    gold_pairs = np.bincount((label[inner] * 2 + label[inner + 1]).astype(int), minlength=4).reshape(2, 2).astype(float)
    gold_bias = label.sum()
    for _ in range(steps):
        p, pairs = marginals(chain.emissions(index), first, chain.trans)
        expected = np.bincount(index, weights=p, minlength=len(known) + 1)
        # each weight moves by its own mean gradient, so that rare words learn as fast as common ones
        chain.weights += rate * 2 * ((gold_words - expected)[:-1] / np.sqrt(tokens) - l2 * chain.weights)
        chain.trans += rate * (gold_pairs - pairs) / np.maximum(1.0, gold_pairs + pairs)
        chain.trans -= chain.trans[0, 0]
        chain.bias += rate * (gold_bias - p.sum()) / np.maximum(1.0, gold_bias + p.sum())
        np.clip(chain.weights, -12, 12, out=chain.weights)
        np.clip(chain.trans, -4, 4, out=chain.trans)
        chain.bias = float(np.clip(chain.bias, -12, 0))
    keep = np.abs(chain.weights) > 1e-3
    return Chain(chain.words[keep], chain.weights[keep], chain.trans, chain.bias)


def tag(chain: Chain, data: np.ndarray, off: np.ndarray):
    """Marginals of all words of the texts in a buffer, with word starts, ends and first words."""
    h, s, e, first = textbuf.hashed_words(data, off, textbuf.NOT_WORD)
    return marginals(chain.emissions(chain.index(h)), first, chain.trans)[0], s, e, first


def scored(chain: Chain, column: pa.Array, spans: bool, floor: float = FLOOR) -> tuple[list[float], list[list[dict]]]:
    """Noisy-or scores over tokens of marginal `floor` or more, and spans in code points."""
    data, off = textbuf.buffer(column)
    scores, found = [], []
    for _, _, part, at in textbuf.slabs(data, off):
        p, s, e, first = tag(chain, part, at)
        rest = np.concatenate(([0.0], np.cumsum(np.log1p(-np.minimum(np.where(p >= floor, p, 0.0), 1 - 1e-9)))))
        scores += (1 - np.exp(rest[first[1:]] - rest[first[:-1]])).tolist()
        if spans:
            lead = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
            for d in range(len(at) - 1):
                hot = np.flatnonzero(p[first[d] : first[d + 1]] >= 0.5) + first[d]
                runs = np.split(hot, np.flatnonzero(np.diff(hot) > 1) + 1) if len(hot) else []
                found.append([{"start": int(lead[s[r[0]]] - lead[at[d]]), "end": int(lead[e[r[-1]]] - lead[at[d]]), "marginal": float(p[r].max())} for r in runs])
    return scores, found


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # words of at most max_rows documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for batch in batches:
            for i in range(0, max(1, batch.num_rows), 1000):
                part = batch.slice(i, 1000)
                scores, spans = scored(shared.value, part.column(1), True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def filter_documents(docs: DataFrame, chain: Chain, threshold: float) -> DataFrame:
    """The rows of docs whose `text` scores under the threshold, with all their columns, in one scan."""
    shared, at = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, _ = scored(shared.value, batch.column(at), False)
            yield batch.filter(pa.array(np.array(scores) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_text: int = MAX_TEXT) -> pd.DataFrame:
    """At most max_rows labelled rows outside the held-out fold, the smallest by a digest of the id; of those, the ones of
    more than max_text bytes are left out."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(label).cast("int").alias("label"))
    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    chosen = own.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(*order).limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id").select("doc_id", "text", "label")
    rows = rows.where(F.col("text").isNull() | (F.octet_length("text") <= max_text))
    return rows.orderBy(*order, "text").limit(max_rows).toPandas()  # ids may repeat on both sides


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Chain:
    rows = training_rows(docs, labels, "toxic", max_rows)
    return fit(rows["text"].tolist(), rows["label"].to_numpy() > 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score_documents(docs, train(docs, documents(spark, sf_dir, "labels")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), spans.alias("spans"))
