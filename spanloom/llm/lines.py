"""Substring dedup by hashing of lines and their sentences (operator 7).

A text is cut into lines, and a line after each sentence end ('.', '!' or '?' before white
space, or a full-width one), so that a shared passage has whole units in it wherever it
begins. A unit is normalised (A-Z lower-cased, white space runs made one space, trimmed) and
digested to 128 bits; digests are grouped over the corpus, the occurrence of the earliest
rank (doc_id, then a digest of the text, then position) stays and the others are removed,
with their offsets in the original text.

min_words: shorter units recur by chance and are never removed; min_line_words is that bound
for a unit that is a whole line. Both bounds hold at every size.

A task judges its own copies first: of each digest in a chunk only the earliest goes to the
shuffle of digests, the others are decided and spread over the partitions, so a line that
stands in a third of all rows is a few rows there.

Defined cases: null text has no units; a null id ranks after all others; rows that repeat
both id and text are one and judged alike; of different texts of one id that of the smaller
digest is earlier; an empty table gives an empty result; columns other than the id and the
text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm import textbuf
from spanloom.llm.shared import documents

MIN_WORDS, MIN_LINE_WORDS = 5, 3
SCHEMA = "doc_id long, n_units long, kept string, spans array<struct<start:int,end:int>>"
_LOWER = textbuf.LOWER.tobytes()
#: A sentence end with the white space after it, a full-width one, or a line feed.
_END = re.compile("[.!?][ \t\r\x0b\f]+|。|！|？|\n".encode())
_CHUNK = 400_000


def cut(raw: bytes) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole line) of the units in bytes, line feeds left out; together they are all of the lines."""
    at = begin = 0
    for m in _END.finditer(raw):
        if raw[m.start()] == 10:
            if at < m.start() or at == begin:
                yield at, m.start(), at == begin
            at = begin = m.end()
        else:
            yield at, m.end(), at == begin and (m.end() == len(raw) or raw[m.end()] == 10)
            at = m.end()
    if at < len(raw) or at == begin:
        yield at, len(raw), at == begin


def text_key(raw: bytes) -> int:
    return int.from_bytes(hashlib.sha256(raw).digest()[:8], "big", signed=True)


def key_of(text: Column) -> Column:
    """text_key as an expression."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, -10).cast("long")


def judged_units(docs: DataFrame, min_words: int, min_line_words: int) -> DataFrame:
    """(late, h1, h2, doc_id, key, unit): the earliest unit of each digest in a chunk, and as late the others of that chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests: list[bytes] = []
        rows: list[tuple[bool, int, int, int]] = []

        def out() -> pa.RecordBatch:
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            none = np.array([r[0] for r in rows], bool)
            d, k, u = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
            digests.clear()
            rows.clear()
            order = np.lexsort((u, k, d, none, h[:, 1], h[:, 0]))
            h, none, d, k, u = (x[order] for x in (h, none, d, k, u))
            new = np.ones(len(d), bool)
            new[1:] = (h[1:] != h[:-1]).any(1)
            first = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
            late = (none != none[first]) | (d != d[first]) | (k != k[first]) | (u != u[first])
            spread = textbuf.mix((k ^ (u << 40)).view(np.uint64)).view(np.int64)
            own = new | late
            h1 = np.where(late, spread, h[:, 0])
            ids = pa.array(d[own], mask=none[own])
            return pa.RecordBatch.from_arrays([pa.array(late[own]), pa.array(h1[own]), pa.array(h[own, 1]), ids, pa.array(k[own]), pa.array(u[own].astype(np.int32))], ["late", "h1", "h2", "doc_id", "key", "unit"])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if not raw:
                    continue
                low, key = raw.translate(_LOWER), text_key(raw)
                for unit, (a, b, line) in enumerate(cut(low)):
                    words = low[a:b].split()
                    if len(words) >= (min_line_words if line else min_words):
                        digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                        rows.append((doc_id is None, doc_id or 0, key, unit))
                if len(rows) >= _CHUNK:
                    yield out()
        if rows:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "late boolean, h1 long, h2 long, doc_id long, key long, unit int")


def removed_units(docs: DataFrame, min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """(doc_id, key, unit) of each removed unit. A running rank: no digest is held in memory, whatever its copies."""
    rank = F.rank().over(Window.partitionBy("h1", "h2", "late").orderBy(F.col("doc_id").isNull(), "doc_id", "key", "unit"))
    return judged_units(docs, min_words, min_line_words).withColumn("rank", rank).where("late or rank > 1").select("doc_id", "key", "unit")


def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept texts and removed spans of (doc_id, text, gone) rows; a line of which all units go leaves no line feed."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        n_units, kept, spans = [], [], []
        for raw, gone in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
            units = [] if raw is None else list(cut(raw))
            n_units.append(len(units))
            if not gone:
                kept.append((raw or b"").decode())
                spans.append([])
                continue
            drop, lines, at, chars, own = set(gone), [], 0, 0, []
            for i, (a, b, _) in enumerate(units):
                chars += len(raw[at:a].decode())
                end = chars + len(raw[a:b].decode())
                if a == 0 or raw[a - 1] == 10:
                    lines.append([])
                if i in drop:
                    own.append({"start": chars, "end": end})
                else:
                    lines[-1].append(raw[a:b])
                at, chars = b, end
            kept.append(b"\n".join(b"".join(x) for x in lines if x).decode())
            spans.append(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_units, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, span)], ["doc_id", "n_units", "kept", "spans"])


def dedupe_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """Per row: doc_id, n_units, the kept text, and the removed spans (start, end) of the original text, in code points."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gone = removed_units(docs, min_words, min_line_words).groupBy(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).agg(F.collect_set("unit").alias("gone"))
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key"))
    return docs.withColumn("key", key_of(F.col("text"))).join(gone, same, "left").select("doc_id", "text", "gone").mapInArrow(render, SCHEMA)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe_lines(documents(spark, sf_dir))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", "n_units", F.size("spans").cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"), spans.alias("removed"))


OP7_SQL = r"""
with docs as (select distinct doc_id, text, sha256(text) as k from documents where text is not null),
lines as (select doc_id, k, unnest(range(len(ls))) as line, unnest(ls) as body from (select doc_id, k, string_split(text, chr(10)) as ls from docs)),
pieces as (
  select *, case when body = '' then [''] else list_filter(regexp_extract_all(body, '.*?(?:[.!?][ \t\r\f\v]+|[。！？]|$)'), lambda p: p <> '') end as ps from lines
), units as (
  select doc_id, k, line, unnest(range(len(ps))) as piece, unnest(ps) as unit, len(ps) = 1 as whole from pieces
), norm as (
  select *, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\v\f\r]+', ' ', 'g'), ' ') as u from units
), ranked as (
  select *, case when u = '' then 0 else len(u) - len(replace(u, ' ', '')) + 1 end >= case when whole then 3 else 5 end as long,
         row_number() over (partition by u, case when u = '' then 0 else len(u) - len(replace(u, ' ', '')) + 1 end >= case when whole then 3 else 5 end order by doc_id nulls last, k, line, piece) as nth,
         coalesce(sum(len(unit) + case when piece = 0 and line > 0 then 1 else 0 end) over (partition by doc_id, k order by line, piece rows between unbounded preceding and 1 preceding), 0) + case when piece = 0 and line > 0 then 1 else 0 end as pos
  from norm
), marked as (select *, (nth > 1 and long) as gone from ranked),
kept as (select doc_id, k, line, string_agg(unit, '' order by piece) filter (where not gone) as body from marked group by doc_id, k, line),
texts as (select doc_id, k, coalesce(string_agg(body, chr(10) order by line), '') as kept from kept group by doc_id, k),
per as (
  select doc_id, k, count(*) as n_units, count(*) filter (where gone) as n_removed,
         coalesce(string_agg(cast(cast(pos as bigint) as varchar) || ':' || cast(cast(pos as bigint) + len(unit) as varchar), ',' order by line, piece) filter (where gone), '') as removed
  from marked group by doc_id, k
)
select d.doc_id, coalesce(n_units, 0) as n_units, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256, coalesce(removed, '') as removed
from documents d left join per on per.doc_id is not distinct from d.doc_id and per.k = sha256(d.text)
left join texts on texts.doc_id is not distinct from d.doc_id and texts.k = sha256(d.text)
"""
