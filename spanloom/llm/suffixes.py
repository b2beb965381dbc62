"""Suffix-array dedup by bucket-pointer refinement (operator 4).

Only equality over `length` bytes matters, so suffixes are sorted to that depth, and
only at anchors: each string of that length holds one (see anchors). The initial
buckets are the anchors' q-grams, and every offset points to the bucket of its q-gram.
Buckets are refined by sorting on bucket identifiers of later offsets: the identifiers of
depth q at an offset and q further give those of depth 2q, which give those of `length`
(anchors.refined_ids), so each refinement reads what the one before has made. Those of a
run's first and last string stand for all strings of the run, so a text whose identifier
an earlier document has too is done. Buckets of a single identifier are done as well. What
is left, the first text of each identifier in a mixed bucket, is refined once more by the
same rule, on the identifiers of its single strings. An identifier is a 64-bit digest, the
same in every task, so no pointer has to be fetched from another one. A bucket never leaves the sort: hot ones stream through it, and what an earlier
document of its own task already decides goes around it.

Defined cases: null text is empty; documents are ranked by doc_id, a null id after all
others and not compared with other null ids; rows of one id are not compared with each
other; texts shorter than `length` bytes keep all; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import anchors, textbuf
from spanloom.llm.shared import Workspace, documents

LAST = (1 << 63) - 1
LENGTH, Q = 50, 24
SCHEMA = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
_BATCH = 1_500_000


def ranked(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), "text")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def judged_rows(docs: DataFrame, length: int, q: int) -> DataFrame:
    """(bucket, context, doc, late) of all runs, once a document and task chunk. late: a document of the chunk comes
    before; such a row is decided and needs no bucket, so it gets one of its own that spreads hot contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            h, c, d = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((d, c))
            h, c, d = h[order], c[order], d[order]
            new = np.ones(len(c), bool)
            new[1:] = c[1:] != c[:-1]
            first = d[np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))]
            late = d > first
            own = new | late
            own[1:] &= (c[1:] != c[:-1]) | (d[1:] != d[:-1])
            h, c, d, late = h[own], c[own], d[own], late[own]
            bucket = np.where(late, textbuf.mix(c ^ d.astype(np.int64).view(np.uint64)), h)
            return pa.RecordBatch.from_arrays([signed(bucket), signed(c), signed(d), pa.array(late)], ["bucket", "context", "doc", "late"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = textbuf.buffer(batch.column(1))
            for i, part, at, _ in anchors.pieces(data, off, length):
                text, _, _, h, c, _ = anchors.runs(part, at, length, q)
                held.append((h, c, ids[text + i]))
                size += len(h)
                if size >= _BATCH:
                    yield out()
                    size = 0
        if held:
            yield out()

    return ranked(docs).mapInArrow(run, "bucket long, context long, doc long, late boolean")


def refined(rows: DataFrame) -> DataFrame:
    """(doc, key, kind) from (bucket, context, doc, late): kind 0, an earlier document has the context;
    kind 1, the first with its context in a bucket of several contexts. Late rows pass as kind 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last context's first row
        mixed = False  # whether the held row's bucket had a context before it

        for batch in batches:
            decided = batch.filter(batch.column(3))
            if decided.num_rows:
                yield pa.RecordBatch.from_arrays([decided.column(2), decided.column(1), pa.array(np.zeros(decided.num_rows, np.int32))], ["doc", "key", "kind"])
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.filter(pc.invert(batch.column(3))).columns[:3]]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            h, c, d = cols
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            late = d > d[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
            at = np.flatnonzero(new)
            same = h[at[1:]] == h[at[:-1]]
            part = np.append(same, False)
            part[1:] |= same
            part[0] |= mixed
            done = at[:-1][part[:-1]]
            keys, kinds = np.concatenate((c[late], c[done])), np.repeat([0, 1], [late.sum(), len(done)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((d[late], d[done]))), pa.array(keys), pa.array(kinds.astype(np.int32))], ["doc", "key", "kind"])
            mixed = bool(part[-1]) if len(at) == 1 else bool(same[-1])
            held = [x[at[-1:]] for x in cols]
        if held is not None and mixed:
            yield pa.RecordBatch.from_arrays([pa.array(held[2]), pa.array(held[1]), pa.array([1], pa.int32())], ["doc", "key", "kind"])

    return rows.repartition("bucket").sortWithinPartitions("bucket", "context", "doc").mapInArrow(run, "doc long, key long, kind int")


def run_strings(sums: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all strings of the runs."""
    n = last - first + 1
    start = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return start, textbuf.ranges_hash(sums, start, start + length)


def of_text(keys: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal keys of one text of the batch."""
    return keys ^ textbuf.mix(text.astype(np.uint64) + np.uint64(1))


def listed(column: pa.Array, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of the lists of rows first to last, and the row (from 0) of each."""
    part = column.slice(first, last - first)
    part = pa.array([None] * len(part), part.type) if len(part) == part.null_count else part
    size = np.asarray(part.value_lengths().fill_null(0))
    return np.asarray(part.drop_null().flatten()).astype(np.int64).view(np.uint64), np.repeat(np.arange(len(part)), size)


def single_strings(joined: DataFrame, length: int, q: int) -> DataFrame:
    """Distinct (key, doc) of the single strings of the runs that (doc, text, keys) rows name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = textbuf.buffer(batch.column(1))
            for i, part, at, _ in anchors.pieces(data, off, length):
                wanted, row = listed(batch.column(2), i, i + len(at) - 1)
                text, first, last, _, c, sums = anchors.runs(part, at, length, q)
                own = np.isin(of_text(c, text), of_text(wanted, row))
                key = run_strings(sums, first[own], last[own], length)[1]
                doc = np.repeat(docs[text[own] + i], (last - first + 1)[own])
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([signed(key[new]), signed(doc[new])], ["key", "doc"])

    return joined.mapInArrow(run, "key long, doc long")


def later(rows: DataFrame) -> DataFrame:
    """(doc, key) of the rows that are not of their key's first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 2  # the last key's first row
        for batch in batches:
            k, d = (np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns))
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            late = d > d[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
            yield pa.RecordBatch.from_arrays([pa.array(d[late]), pa.array(k[late])], ["doc", "key"])
            end = np.flatnonzero(new)[-1:]
            held = [k[end], d[end]]

    return rows.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(run, "doc long, key long")


def render(length: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = batch.slice(k, 500)
                data, off = textbuf.buffer(rows.column(1))
                mask = removed(data, off, rows.column(2), rows.column(3), length, q)
                edge = np.zeros(len(data) + 1, bool)
                edge[off] = True
                before, after = np.ones(len(mask), bool), np.ones(len(mask), bool)
                before[1:], after[:-1] = ~mask[:-1], ~mask[1:]
                start, end = np.flatnonzero(mask & (before | edge[:-1])), np.flatnonzero(mask & (after | edge[1:])) + 1
                of = np.searchsorted(off, start, "right") - 1
                spans: list[list[dict]] = [[] for _ in range(len(off) - 1)]
                for t, a, b in zip(of.tolist(), start.tolist(), end.tolist()):
                    spans[t].append({"start": a - int(off[t]), "end": b - int(off[t])})
                kept = [data[a:b][~mask[a:b]].tobytes() for a, b in zip(off[:-1], off[1:])]
                ids = [None if x == LAST else x for x in rows.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(off), pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def removed(data: np.ndarray, off: np.ndarray, runs_gone: pa.Array, strings_gone: pa.Array, length: int, q: int) -> np.ndarray:
    """Mask of the bytes that the decided runs and strings of their own text cover."""
    cover = np.zeros(len(data) + 1, np.int64)
    some = np.asarray(runs_gone.is_valid()) | np.asarray(strings_gone.is_valid())
    for i, part, at, shift in anchors.pieces(data, off, length):
        n = len(at) - 1
        if not some[i : i + n].any():
            continue
        base = off[i] + shift
        (a, row_a), (b, row_b) = listed(runs_gone, i, i + n), listed(strings_gone, i, i + n)
        text, first, last, _, c, sums = anchors.runs(part, at, length, q)
        gone = np.isin(of_text(c, text), of_text(a, row_a))
        np.add.at(cover, first[gone] + base, 1)
        np.add.at(cover, last[gone] + length + base, -1)
        if len(b):
            ask = ~gone & np.isin(text, row_b)
            start, h = run_strings(sums, first[ask], last[ask], length)
            own = np.isin(of_text(h, np.repeat(text[ask], (last - first + 1)[ask])), of_text(b, row_b))
            np.add.at(cover, start[own] + base, 1)
            np.add.at(cover, start[own] + length + base, -1)
    return np.cumsum(cover[:-1]) > 0


def dedupe(docs: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """Per row: doc_id, n_bytes, the removed byte spans (start, end) and the kept bytes.

    Phases are cut by written tables of decisions, which are small; the shuffle files of one
    phase are freed before the next one shuffles the texts again. All decisions of the first
    scan are written, so later scans may cut the table into other tasks.
    """
    ws = Workspace(docs.sparkSession)
    split = ws.table(refined(judged_rows(docs, length, q)), "refined")
    ws.free()
    texts = ranked(docs)
    wanted = split.where("kind = 1").groupBy("doc").agg(F.collect_set("key").alias("keys"))
    joined = texts.join(wanted, "doc").select("doc", "text", "keys")
    strings = ws.table(later(single_strings(joined, length, q)), "strings")
    ws.free()
    whole = split.where("kind = 0").select("doc", "key")
    gone = whole.select("doc", F.col("key").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(strings.select("doc", F.lit(None).cast("long").alias("a"), F.col("key").alias("b")))
    gone = gone.groupBy("doc").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    gone = gone.select("doc", F.when(F.size("a") > 0, F.col("a")).alias("a"), F.when(F.size("b") > 0, F.col("b")).alias("b"))
    return texts.join(gone, "doc", "left").select("doc", "text", "a", "b").mapInArrow(render(length, q), SCHEMA)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe(documents(spark, sf_dir))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), spans.alias("removed"))


OP4_SQL = """
with d as (select row_number() over () as r, doc_id, coalesce(doc_id, 9223372036854775807) as rank, hex(encode(coalesce(text, ''))) as h from documents),
tiles as (select r, rank, tile, substr(h, 512 * tile + 1, 610) as h from (select *, unnest(range((len(h) + 511) // 512)) as tile from d)),
bytes as (select r, rank, h, 256 * tile + k as i, k from (select *, unnest(range(least(256, len(h) // 2))) as k from tiles)),
strings as (select r, rank, i, md5_number(substr(h, 2 * k + 1, 100)) as g from bytes where 2 * k + 100 <= len(h)),
first as (select g, min(rank) as first from strings group by g having min(rank) < max(rank)),
later as (select r, i from strings join first using (g) where rank > first),
covered as (
  select r, i, substr(h, 2 * k + 1, 2) as byte, coalesce(max(later.i) over (partition by r order by i rows between 49 preceding and current row) is not null, false) as gone
  from bytes left join later using (r, i)
), marked as (select *, gone and not coalesce(lag(gone) over (partition by r order by i), false) as opens from covered),
numbered as (select *, sum(opens::int) over (partition by r order by i) as run from marked),
spans as (select r, run, min(i) as a, max(i) + 1 as b from numbered where gone group by r, run),
listed as (select r, sum(b - a)::bigint as n_removed, count(*) as n_spans, string_agg(a || ':' || b, ',' order by a) as removed from spans group by r),
kept as (select r, string_agg(byte, '' order by i) filter (where not gone) as kept from covered group by r)
select doc_id, len(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256, coalesce(removed, '') as removed
from d left join listed using (r) left join kept using (r)
"""
