"""Hierarchical multi-length packing of tokenised documents (operator 10).

Each task tokenises its own rows, routes whole windows and remainders to tiers of
power-of-two context sizes, packs the tiers from the longest down, fills the gaps of
long windows from shorter tiers, and balances the finished sequences over step
groups: each round's groups get the same number of tokens and the same mix of lengths,
up to one sequence. Nothing is shuffled: a sequence holds documents of one task, and
what a task has left at its end is written as full power-of-two sequences, shorter than
the shortest tier where it must be (`tier` says the length).

Defined cases: null or empty text is the end token alone; a null id stays null;
repeated rows are packed as often as they occur; an empty table gives no pieces;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import textbuf
from spanloom.llm.shared import documents

END = 1
TIERS = (2048, 1024, 512, 256)
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"
_coders: dict[str, "Coder"] = {}
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b",.;:!?)")] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class Coder:
    """Token ids by way of a direct-mapped cache of units, of fixed size.

    A unit starts at a space between two non-space characters, at a mark right after an ASCII
    letter, or at the text's start. The byte-level pattern never matches across those points,
    so a text's ids are its units' ids in order. A slot holds one unit's key and at most WIDTH ids; longer units
    are tokenised wherever they stand and never kept, so the cache has SLOTS * 33 bytes
    whatever the texts. New units are tokenised as one text, and their ids dealt to them
    by the bytes of each token.
    """

    SLOTS, WIDTH = 1 << 19, 6
    #: Bytes handed to the tokeniser at once: its own record of a token is large.
    SLAB = 1 << 17

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.bytes_of = np.array([len(x) for x in names], np.int64)  # the byte alphabet has one character a byte
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.sizes = np.zeros(self.SLOTS, np.uint8)
        self.ids = np.zeros((self.SLOTS, self.WIDTH), np.uint32)

    def tokenised(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units in turn, and how many each has."""
        size = end - start
        stop = np.cumsum(size)
        parts, counts, i = [], [], 0
        while i < len(start):
            base = stop[i] - size[i]
            j = max(i + 1, int(np.searchsorted(stop, base + self.SLAB, "right")))
            text = b"".join([raw[a:b] for a, b in zip(start[i:j].tolist(), end[i:j].tolist())]).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            edge = np.cumsum(self.bytes_of[ids])
            last = np.searchsorted(edge, stop[i:j] - base)
            parts.append(ids)
            counts.append(np.diff(last + 1, prepend=0))
            i = j
        return np.concatenate(parts), np.concatenate(counts)

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids of each text in the buffer, without the end token."""
        n = len(data)
        if not n:
            return [np.zeros(0, np.uint32)] * (len(off) - 1)
        solid = (data < 0x80) & (data > 0x20) & (data != 0x7F)  # ASCII that is neither space nor control
        letter = solid | (data == 0xC3)  # and the lead byte of the Latin letters next to it
        cut = np.zeros(n, bool)
        if n >= 3:
            before = solid[:-2].copy()
            before[1:] |= (data[1:-2] >= 0x80) & (data[:-3] == 0xC3)
            cut[1:-1] = (data[1:-1] == 0x20) & before & letter[2:]
        cut[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
        some = np.diff(off) > 0
        tails = off[1:][some] - 1
        cut[tails] &= data[tails] != 0x20
        cut[off[:-1][some]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        keys = textbuf.ranges_hash(textbuf.prefix_sums(data), start, end)
        slot = (keys & np.uint64(self.SLOTS - 1)).astype(np.int64)
        size = self.sizes[slot].astype(np.int64)
        rows = self.ids[slot]
        miss = np.flatnonzero((self.keys[slot] != keys) | (size == 0))
        more = np.zeros(0, np.uint32)
        begin = np.zeros(len(miss), np.int64)
        if len(miss):
            distinct, first, inverse = np.unique(keys[miss], return_index=True, return_inverse=True)
            own = miss[first]
            # what may not follow on another unit's end, or not be followed by one
            alone = (data[start[own]] != 0x20) | (np.isin(end[own], off) & ~solid[end[own] - 1])
            more, counts = self.learned(data, start[own], end[own], alone)
            at = np.cumsum(counts) - counts
            small = np.flatnonzero(counts <= self.WIDTH)
            put = slot[own[small]]
            self.keys[put], self.sizes[put] = distinct[small], counts[small]
            fits = np.arange(self.WIDTH) < counts[small, None]
            block = np.zeros((len(small), self.WIDTH), np.uint32)
            block[fits] = more[np.repeat(at[small], counts[small]) + (np.arange(counts[small].sum()) - np.repeat(np.cumsum(counts[small]) - counts[small], counts[small]))]
            self.ids[put] = block
            size[miss], begin = counts[inverse], at[inverse]
        stop = np.cumsum(size)
        ids = np.empty(int(stop[-1]), np.uint32)
        hit = np.ones(len(keys), bool)
        hit[miss] = False
        fits = (np.arange(self.WIDTH) < size[:, None]) & hit[:, None]
        ids[np.repeat(hit, size)] = rows[fits]
        if len(miss):
            n_ids = size[miss]
            ids[np.repeat(~hit, size)] = more[np.repeat(begin - (np.cumsum(n_ids) - n_ids), n_ids) + np.arange(n_ids.sum())]
        bounds = np.concatenate(([0], stop))[np.searchsorted(start, off)]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def learned(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of distinct units: each of `alone` by itself, the others as one text."""
        raw = data.tobytes()
        counts = np.zeros(len(start), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        joined = np.flatnonzero(~alone)
        if len(joined):
            ids, own = self.tokenised(raw, start[joined], end[joined])
            counts[joined] = own
            parts.append((np.repeat(joined, own), ids))
        single = np.flatnonzero(alone)
        for i in range(0, len(single), 1000):
            part = single[i : i + 1000].tolist()
            for k, code in zip(part, self.tokenizer.encode_batch_fast([raw[start[k] : end[k]].decode("utf-8", "replace") for k in part], add_special_tokens=False)):
                counts[k] = len(code.ids)
                parts.append((np.full(len(code.ids), k), np.array(code.ids, np.uint32)))
        unit, ids = (np.concatenate(x) for x in zip(*parts))
        return ids[np.argsort(unit, kind="stable")], counts


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def balanced(lengths: list[int], group_tokens: int) -> list[int]:
    """The group of each sequence, for lengths that are powers of two in falling order.

    Each goes to the group of the fewest tokens so far, so groups differ by at most the shortest
    sequence they differ in, none has more than group_tokens, and each length is dealt out evenly.
    """
    groups = [(0, k) for k in range(max(1, -(-sum(lengths) // group_tokens)))]
    out = []
    for n in lengths:
        tokens, k = heappop(groups)
        out.append(k)
        heappush(groups, (tokens + n, k))
    return out


class Packer:
    """Pieces are [document, start, ids]; every sequence that leaves is full."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = sorted(tiers, reverse=True)
        self.pools: dict[int, deque] = {t: deque() for t in self.tiers}
        self.whole: list[list] = []
        self.held = 0

    def add(self, doc: list, ids: np.ndarray) -> None:
        longest, start = self.tiers[0], 0
        self.held += len(ids)
        while len(ids) - start >= longest:
            self.whole.append([(doc, start, ids[start : start + longest])])
            start += longest
        if start < len(ids):
            self.route((doc, start, ids[start:]))

    def route(self, piece: tuple) -> None:
        """To the shortest tier that holds it."""
        self.pools[next(t for t in reversed(self.tiers) if t >= len(piece[2]))].append(piece)

    def fill(self, tier: int, sequence: list, gap: int) -> int:
        """Fills a gap with whole shorter pieces, then with one cut to measure."""
        shorter = [t for t in self.tiers if t <= tier]
        while gap:
            pool = next((self.pools[t] for t in shorter if self.pools[t] and len(self.pools[t][0][2]) <= gap), None)
            if pool is None:
                pool = next((self.pools[t] for t in reversed(shorter) if self.pools[t]), None)
                if pool is None:
                    return gap
            doc, start, ids = pool.popleft()
            sequence.append((doc, start, ids[:gap]))
            if len(ids) > gap:
                self.route((doc, start + gap, ids[gap:]))
            gap -= min(gap, len(ids))
        return 0

    def finished(self, last: bool = False) -> list[tuple[int, list]]:
        """Full (length, sequence) pairs; pieces that don't fill one wait, unless these are the last."""
        out = [(self.tiers[0], s) for s in self.whole]
        self.whole = []
        for tier in self.tiers:
            while self.pools[tier]:
                sequence: list = []
                gap = self.fill(tier, sequence, tier)
                if not gap:
                    out.append((tier, sequence))
                elif not last:
                    self.pools[tier].extendleft(reversed(sequence))
                    break
                else:
                    out += self.split(sequence)
        self.held = sum(len(p[2]) for pool in self.pools.values() for p in pool)
        return sorted(out, key=lambda x: -x[0])

    @staticmethod
    def split(sequence: list) -> list[tuple[int, list]]:
        """A rest as sequences of power-of-two lengths, without padding."""
        total, out, pieces = sum(len(p[2]) for p in sequence), [], deque(sequence)
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            room, part = 1 << bit, []
            while room:
                doc, start, ids = pieces.popleft()
                part.append((doc, start, ids[:room]))
                if len(ids) > room:
                    pieces.appendleft((doc, start + room, ids[room:]))
                room -= min(room, len(ids))
            out.append((1 << bit, part))
        return out


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, group_tokens: int = 1 << 16, round_tokens: int = 2_000_000, end: int = END) -> DataFrame:
    """Packs `doc_id, text` rows; returns pieces with their token ids (`ids`: little-endian unsigned 32 bit).

    tokenizer: path of a tokenizers JSON file, on every node. tiers: context sizes, powers of two.
    group_tokens: most tokens of a step group, a multiple of the longest tier. round_tokens: tokens held before sequences are written.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    if group_tokens % max(tiers):
        raise ValueError("group_tokens must be a multiple of the longest tier")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, packer = coder(tokenizer), Packer(tiers)
        task = TaskContext.get().partitionId() << 40
        sequences = groups = 0

        def write(done: list) -> pa.RecordBatch:
            nonlocal sequences, groups
            cols: list[list] = [[] for _ in range(9)]
            own = balanced([tier for tier, _ in done], group_tokens)
            for (tier, pieces), group in zip(done, own):
                at = 0
                for (doc_id, tokens), start, ids in pieces:
                    for c, v in zip(cols, (doc_id, start, len(ids), tokens, task + sequences, at, tier, task + groups + group, ids.tobytes())):
                        c.append(v)
                    at += len(ids)
                sequences += 1
            groups += max(own, default=-1) + 1
            kinds = (*[pa.int64()] * 6, pa.int32(), pa.int64(), pa.binary())
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        tail = np.array([end], np.uint32)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            data, off = textbuf.buffer(batch.column(1))
            for i, j, part, at in textbuf.slabs(data, off):
                for key, ids in zip(keys[i:j], code.encode(part, at)):
                    ids = np.concatenate((ids, tail))
                    packer.add((key, len(ids)), ids)
                if packer.held >= round_tokens:
                    yield write(packer.finished())
        yield write(packer.finished(last=True))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(documents(spark, sf_dir), default_tokenizer())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
