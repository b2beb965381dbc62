"""Benchmark decontamination (operator 3).

One Aho-Corasick automaton over the normalised windows of all benchmark items scans
each text once; hits are word numbers, mapped back to code point offsets of the
original text. Words are runs of digits, a-z (after lower-casing A-Z) and non-ASCII.

Defined cases: null and empty texts have no words and no hits; an item without words
is no window; items with equal windows are each found; repeated rows are each judged;
an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import textbuf
from spanloom.llm.shared import documents

_TABLE = bytes(0x20 if textbuf.NOT_WORD[b] else b for b in textbuf.LOWER.tolist())
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, row binary, n_words long, spans array<struct<first:int,last:int,start:int,end:int>>, items array<string>"
_automata: dict[bytes, object] = {}


def normalise(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def windows(text: str | None, width: int = 8) -> list[bytes]:
    """The item's windows, each with a space on both sides."""
    w = normalise((text or "").encode())
    if not w:
        return []
    return [b" " + b" ".join(w[i : i + width]) + b" " for i in range(max(1, len(w) - width + 1))]


def automaton(patterns: list[tuple[bytes, tuple[int, ...]]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for raw, items in patterns:
        a.add_word(raw.decode("latin-1"), (raw.count(b" ") - 1, items))
    if patterns:
        a.make_automaton()
    return a


def shards(benchmark: DataFrame, width: int, max_windows: int) -> Iterator[tuple[list[str], list]]:
    """Distinct item names and windows of at most `max_windows` windows at a time, streamed to the driver."""
    names: dict[str, int] = {}
    found: dict[bytes, dict[int, None]] = {}
    for item_id, text in benchmark.toLocalIterator():
        name = "" if item_id is None else str(item_id)
        for x in windows(text, width):  # a long item's windows may be in several shards, under its one name
            if len(found) >= max_windows and x not in found:
                yield list(names), [(k, tuple(v)) for k, v in found.items()]
                names, found = {}, {}
            found.setdefault(x, {})[names.setdefault(name, len(names))] = None
    yield list(names), [(k, tuple(v)) for k, v in found.items()]


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 8, max_windows: int = 200_000) -> DataFrame:
    """Per document: its number of words, the merged hit spans and the items whose windows occur.

    The automaton is broadcast, so its windows are bounded by `max_windows`; a larger benchmark is
    scanned in as many shards as it needs, each against all documents, and the shards' spans are merged.
    """
    spark, out, count = docs.sparkSession, None, 0
    parts = shards(benchmark.select("item_id", "text"), width, max_windows)
    ahead = list(islice(parts, 2))
    row = F.unhex(F.sha2("text", 256)) if len(ahead) > 1 else F.lit(None).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.alias("row"))
    for names, patterns in chain(ahead, parts):
        shared = spark.sparkContext.broadcast((names, patterns))
        part = rows.mapInArrow(scanner(shared), SCHEMA)
        out, count = part if out is None else out.unionByName(part), count + 1
    if count > 1:
        # shards meet by id and text, whatever their scans' tasks are; rows alike in both are judged once and each returned
        out = out.groupBy(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row")).agg(F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        out = rows.select("doc_id", "row").join(out, F.col("doc_id").eqNullSafe(F.col("of_id")) & F.col("row").eqNullSafe(F.col("of_row")))
    return out.select("doc_id", "n_words", "spans", "items")


def built(patterns: list):
    """The automaton, kept by its patterns' digest while the Python worker lives."""
    key = hashlib.sha256(pickle.dumps(patterns)).digest()
    if key not in _automata:
        _automata.clear()
        _automata[key] = automaton(patterns)
    return _automata[key]


def scan_text(auto, text: str | None) -> tuple[int, list[tuple[int, int]], list[int]]:
    """Number of words, merged hit word ranges, and the items hit; one pass over the text."""
    w = normalise(text.encode()) if text else []
    if not w or auto is None:
        return len(w), [], []
    flat = b" " + b" ".join(w) + b" "
    ends, hit = [], {}
    for end, (size, of) in auto.iter(flat.decode("latin-1")):
        ends.append((end, size))
        hit.update(dict.fromkeys(of))
    if not ends:
        return len(w), [], []
    gaps = np.cumsum(np.frombuffer(flat, np.uint8) == 0x20)
    return len(w), merged(sorted((int(gaps[e]) - 1 - size, int(gaps[e]) - 2) for e, size in ends)), list(hit)


def filter_documents(docs: DataFrame, benchmark: DataFrame, least_items: int, width: int = 8, max_windows: int = 200_000) -> DataFrame:
    """The rows of docs in which windows of fewer than least_items items occur, with all their columns.

    A benchmark of one shard is judged in the scan itself, a larger one by a join on the text's digest.
    """
    parts = shards(benchmark.select("item_id", "text"), width, max_windows)
    names, patterns = next(parts)
    if next(parts, None) is not None:
        hits = None
        for shard in shards(benchmark.select("item_id", "text"), width, max_windows):
            part = docs.select("text").mapInArrow(hit_items(docs.sparkSession.sparkContext.broadcast(shard)), "__digest binary, item string")
            hits = part if hits is None else hits.unionByName(part)
        gone = hits.distinct().groupBy("__digest").agg(F.count("*").alias("n")).where(F.col("n") >= least_items)
        own = docs.withColumn("__digest", F.unhex(F.sha2("text", 256)))
        return own.join(gone.select("__digest"), "__digest", "left_anti").select(*docs.columns)
    shared, at = docs.sparkSession.sparkContext.broadcast(patterns), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = built(shared.value) if shared.value else None
        for batch in batches:
            keep = [len(scan_text(auto, t)[2]) < least_items for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def hit_items(shared):
    """(digest, item) of each text's hits: texts are judged alike wherever they are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, patterns = shared.value
        auto = built(patterns) if patterns else None
        for batch in batches:
            digests, items = [], []
            for text in batch.column(0).to_pylist():
                hit = scan_text(auto, text)[2]
                if hit:
                    digests += [hashlib.sha256(text.encode()).digest()] * len(hit)
                    items += [names[i] for i in hit]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(items, pa.string())], ["__digest", "item"])

    return run


def scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, patterns = shared.value
        auto = built(patterns)
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch.column(1).to_pylist():
                n, own, hit = scan_text(auto if patterns else None, text)
                n_words.append(n)
                spans.append(located(text, own))
                items.append([names[i] for i in hit])
            kind = pa.list_(pa.struct([(x, pa.int32()) for x in ("first", "last", "start", "end")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))], ["doc_id", "row", "n_words", "spans", "items"])

    return scan


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted inclusive word ranges, merged where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def located(text: str | None, spans: list[tuple[int, int]]) -> list[dict]:
    """Word ranges with their code point offsets in the original text."""
    if not spans:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [{"first": a, "last": b, "start": at[a][0], "end": at[b][1]} for a, b in spans]


def hit_words(spans: str = "spans"):
    """The number of words in the union of the spans, which may overlap after shards are merged."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(acc["end"] + 1, s["first"]) + 1)).alias("n"), F.greatest(acc["end"], s["last"]).alias("end"))
    return F.aggregate(ordered, start, step, lambda acc: acc["n"])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", hit_words().alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


OP3_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as ws from benchmark),
win as (
  select distinct item_id, least(8, len(ws)) as size, array_to_string(list_slice(ws, i, i + 7), ' ') as g
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) as i from b where len(ws) > 0)
), sizes as (select distinct size from win),
own as (
  select doc_id, size, i, array_to_string(list_slice(ws, i, i + size - 1), ' ') as g
  from (select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) as i from d, sizes where len(ws) >= size)
), found as (select doc_id, item_id, i, own.size from own join win on own.g = win.g and own.size = win.size),
hit as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + size)) as k from found) group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from found group by doc_id)
select d.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""
