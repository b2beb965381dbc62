"""Secret scans with corpus-wide ownership frequency (operator 5).

Three base patterns find assignments, access keys and hex strings in each whole text.
The method also takes bare credential-like tokens: their digests are aggregated over
the corpus by distinct repositories and owners. A value with few owners and in few
repositories is live looking and its bare tokens are added as spans; one copied among
many of either is an example and adds none. Base spans stay whatever the aggregate says.

Defined cases: null text is empty and has no spans; equal spans of different kinds are
all kept, in the order of KINDS; a null owner or repository counts as one of its own;
repeated rows count once for ownership and are each returned; an empty table gives an
empty result; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.shared import Workspace, documents

KINDS = ("assign", "access", "hex", "owned")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_ANY = re.compile(r"[0-9]")
FOUND = "array<struct<kind:int,start:int,end:int,digest:binary>>"
SCHEMA = f"doc_id long, owner string, repository string, key long, found {FOUND}"
#: A value with more distinct owners (sources) or in more distinct repositories (documents) is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 20


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidate(value: str, least_bits: float) -> bool:
    """Both digits and letters, at least four digits, and the entropy of a random string."""
    digits = sum(c.isdigit() for c in value)
    return 4 <= digits < len(value) and any(c.isalpha() for c in value) and round(entropy(value), 9) >= least_bits


def scan_text(text: str | None, least_bits: float = 3.0) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value): base spans, and bare candidates as kind 3, in code points."""
    if not text:
        return []
    out = []
    if "=" in text or ":" in text:
        out += [(0, *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(1, *m.span(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(2, *m.span(), m[0]) for m in _HEX.finditer(text)]
    if _ANY.search(text):  # candidates have four digits
        out += [(3, *m.span(), m[0]) for m in _BARE.finditer(text) if candidate(m[0], least_bits)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def found(docs: DataFrame, owner: str, repository: str, least_bits: float = 3.0) -> DataFrame:
    """Each row's spans with the digests of their values; the values themselves are not kept. key: a digest of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary())]))
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b, "digest": hashlib.blake2b(v.encode(), digest_size=16).digest()} for k, a, b, v in scan_text(t, least_bits)] for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(rows, kind)], ["doc_id", "owner", "repository", "key", "found"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.xxhash64("text").alias("key"), "text")
    return picked.mapInArrow(run, SCHEMA)


def ownership(spans: DataFrame) -> DataFrame:
    """Per digest: distinct owners and repositories. Distinct pairs are formed before the shuffle."""
    seen = spans.select(F.explode("found.digest").alias("digest"), F.coalesce("owner", F.lit("\x00")).alias("owner"), F.coalesce("repository", F.lit("\x00")).alias("repository"))
    owners = seen.select("digest", "owner").distinct().groupBy("digest").agg(F.count("*").alias("n_owners"))
    repositories = seen.select("digest", "repository").distinct().groupBy("digest").agg(F.count("*").alias("n_repositories"))
    return owners.join(repositories, "digest")


def live_digests(spans: DataFrame, max_owners: int, max_repositories: int) -> DataFrame:
    """Digests of owner-specific values: few owners have them, and few repositories."""
    return ownership(spans).where((F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)).select("digest")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, least_bits: float = 3.0) -> DataFrame:
    """Per row: `spans`, an array of (start, kind, end, live) in order of start, then kind.

    live: the value is seen with at most max_owners distinct owners and in at most max_repositories
    distinct repositories. Base spans are always there, bare tokens (kind 3) only if live and outside
    every base span of their row. The texts are scanned once: the spans found are written, with a
    number for each row.
    """
    spans = Workspace(docs.sparkSession).table(found(docs, owner, repository, least_bits).withColumn("row", F.monotonically_increasing_id()), "found")
    some = spans.where(F.size("found") > 0)
    live = live_digests(some, max_owners, max_repositories).withColumn("live", F.lit(True))
    each = some.select("row", F.explode("found").alias("s")).select("row", F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("s.digest").alias("digest"))
    judged = each.join(live, "digest", "left").groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", F.coalesce("live", F.lit(False)).alias("live"))).alias("all"))
    inside = lambda s: F.exists("all", lambda b: (b["kind"] < 3) & (b["start"] < s["end"]) & (s["start"] < b["end"]))
    kept = F.filter("all", lambda s: (s["kind"] < 3) | (s["live"] & ~inside(s)))
    judged = judged.select("row", F.array_sort(kept).alias("spans"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")
    return spans.select("row", "doc_id").join(judged, "row", "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def redact(docs: DataFrame, mark: str, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """docs with the spans of live values replaced by `mark` in `text`, and n_chars recounted where it stands.

    Rows meet their cuts by id and text: rows alike in both are cut alike. Added names are chosen so that none clashes.
    """
    tag = "_"
    while any(c.lower().startswith(tag) for c in docs.columns):
        tag += "_"
    key, cut, of = f"{tag}key", f"{tag}cuts", f"{tag}id"
    some = Workspace(docs.sparkSession).table(found(docs, owner, repository).where(F.size("found") > 0), "found")
    live = live_digests(some, max_owners, max_repositories)
    each = some.select("doc_id", "key", F.explode("found").alias("s")).select("doc_id", "key", "s.start", "s.end", F.col("s.digest").alias("digest"))
    cuts = each.join(live, "digest").groupBy(F.col("doc_id").alias(of), F.col("key").alias(f"{key}2")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(cut))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(key) == F.col(f"{key}2"))
    joined = docs.withColumn(key, F.xxhash64("text")).join(cuts, same, "left").select(*[f"`{c}`" for c in docs.columns], cut)
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chars = batch.column(at).to_pylist(), batch.column(count).to_pylist() if count is not None else []
            for i, cuts in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if cuts:
                    texts[i] = without(texts[i], [(c["start"], c["end"]) for c in cuts], mark)
                    if count is not None:
                        chars[i] = len(texts[i])
            cols = list(batch.columns[:-1])
            cols[at] = pa.array(texts, pa.string())
            if count is not None:
                cols[count] = pa.array(chars, batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)


def without(text: str, cuts: list[tuple[int, int]], mark: str) -> str:
    """The text with the union of sorted spans replaced, each run of overlapping spans by one mark."""
    out, at = [], 0
    for start, end in cuts:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    n_live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), n_live.alias("n_live"))


_KEY = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_TO_VALUE = _KEY + r"""["'']?\x20*[:=]\x20*["'']?"""
#: Starts follow from the pieces between the matches.
_CUT = "select r, {kind} as kind, regexp_extract_all(t, '{pattern}') as ms, regexp_split_to_array(t, '{pattern}') as ps from d where regexp_matches(t, '{pattern}')"
OP5_SQL = (
    "with d as (select row_number() over () as r, doc_id, coalesce(source, chr(1)) as owner, coalesce(cast(doc_id as varchar), chr(1)) as repository, coalesce(text, '') as t from documents), cut as ("
    + " union all ".join(_CUT.format(kind=k, pattern=p) for k, p in enumerate((_TO_VALUE + "[A-Za-z0-9+/_.=-]+", "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}", "[A-Za-z0-9+/_=-]{20,}")))
    + r"""
), each as (select r, kind, unnest(ms) as m, unnest(ps[1:len(ms)]) as p, unnest(range(len(ms))) as i from cut
), placed as (
  select r, kind, m, cast(sum(len(p)) over w + coalesce(sum(len(m)) over (partition by r, kind order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as a
  from each window w as (partition by r, kind order by i)
), valued as (
  select r, kind, a, a + len(m) as b, case when kind = 0 then regexp_replace(m, '^""" + _TO_VALUE + r"""', '') else m end as v from placed
), rated as (
  select *, len(regexp_replace(v, '[^0-9]', '', 'g')) as digits,
         round(list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -((len(v) - len(replace(v, c, ''))) / len(v)) * log2((len(v) - len(replace(v, c, ''))) / len(v)))), 9) as bits
  from valued
), found as (
  select * from rated where case kind when 0 then len(v) >= 12 when 3 then digits >= 4 and digits < len(v) and regexp_matches(v, '[A-Za-z]') and bits >= 3 else true end
), live as (select v from found join d using (r) group by v having count(distinct owner) <= 2 and count(distinct repository) <= 20
), judged as (select found.*, live.v is not null as live from found left join live using (v)
), kept as (
  select * from judged s where kind < 3 or (live and not exists (select 1 from judged x where x.r = s.r and x.kind < 3 and x.a < s.b and s.a < x.b))
), named as (select *, (['assign', 'access', 'hex', 'owned'])[kind + 1] || ':' || a || ':' || b as said from kept
), per as (
  select r, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex, count(*) filter (where live) as n_live,
         string_agg(said, ',' order by a, kind) filter (where kind < 3) as base, string_agg(said, ',' order by a, kind) as spans from named group by r
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live
from d left join per using (r)
"""
)
