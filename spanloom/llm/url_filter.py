"""URL filters as a sort-merge range join (operator 2).

A rule's host, labels reversed and each ended by a dot, is a prefix of the canonical
keys of its host and of all its subdomains: an interval of the key order. Pages and
rules are dealt to key ranges, a rule to every range that its interval meets; one sweep
over each sorted range keeps the stack of rules that enclose the current key, and the
longest of those whose path fits decides.

A hot host is one key, so a digest of the page id follows the key and ranges can cut
within a host. The sample that places the cuts only balances tasks.

Defined cases: a null url, or one without ://, has empty host and path, which no rule
fits; an empty path fits only rules with an empty path; of equally long rules the one
with the longer host wins, then the smaller verdict string; repeated rules are one;
repeated pages are each judged; without rules every page gets the default verdict.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.shared import documents

LAST = "\U0010ffff"
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The text after the first :// cut at / ? # (host) and from there at ? # (path)."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


def host_key(host: Column) -> Column:
    """Reversed labels, each ended by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, dict[str, str]]] = []
        part = None
        for batch in batches:
            out = {k: [] for k in ("page_id", "host", "path", "rule", "verdict")}
            for pid, key, kind, page_id, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if pid != part:
                    stack, part = [], pid
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}))
                    paths = stack[-1][1]
                    paths[path] = min(verdict, paths.get(path, verdict))
                    continue
                best = None
                for prefix, paths in stack:
                    for p in fitting(paths, path):
                        size = len(prefix) - 1 + len(p)
                        if best is None or (size, len(prefix)) >= best[0]:
                            best = (size, len(prefix)), prefix, p, paths[p]
                out["page_id"].append(page_id)
                out["host"].append(host)
                out["path"].append(path)
                out["rule"].append(".".join(reversed(best[1][:-1].split("."))) + best[2] if best else None)
                out["verdict"].append(best[3] if best else default)
            kinds = (pa.int64(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    return run


def fitting(paths: dict[str, str], path: str) -> list[str]:
    """The rule paths that the path starts with, by the smaller of the two searches."""
    if len(paths) <= len(path):
        return [p for p in paths if path.startswith(p)]
    return [path[:i] for i in range(len(path) + 1) if path[:i] in paths]


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None, sample_rows: int = 20_000) -> DataFrame:
    """Judges `page_id, url` rows by `host, path, verdict` rules.

    ranges: number of key ranges (the session's shuffle partitions if None).
    sample_rows: about how many keys the driver sees to place the cuts.
    """
    spark = pages.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(F.col("url"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    key = F.concat(host_key(F.col("host")), F.lit("\x00"), F.lpad(F.hex(F.xxhash64("page_id", "path")), 16, "0"))
    keyed = base.withColumn("key", F.when(F.col("host") == "", F.concat(F.lit("\x00"), F.lpad(F.hex(F.xxhash64("page_id", "path")), 16, "0"))).otherwise(key))
    total = keyed.count()
    seen = sorted(r[0] for r in keyed.select("key").sample(fraction=min(1.0, sample_rows / max(1, total)), seed=7).collect())
    cuts = sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []

    def deal(with_interval: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0).to_pylist()
                if with_interval:
                    rows, pids = [], []
                    for i, k in enumerate(keys):
                        for p in range(bisect_right(cuts, k), bisect_left(cuts, k + LAST) + 1):
                            rows.append(i)
                            pids.append(p)
                    batch = batch.take(pa.array(rows, pa.int64()))
                else:
                    pids = [bisect_right(cuts, k) for k in keys]
                yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), *batch.columns], names)

        return run

    names = ["pid", "key", "kind", "page_id", "host", "path", "verdict"]
    schema = "pid int, key string, kind int, page_id long, host string, path string, verdict string"
    page_rows = keyed.select("key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    rule_rows = (
        rules.where("host is not null and path is not null and verdict is not null and host <> ''")
        .select(host_key(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict")
        .distinct()
    )
    dealt = page_rows.mapInArrow(deal(False), schema).unionByName(rule_rows.mapInArrow(deal(True), schema))
    return dealt.repartition(n, "pid").sortWithinPartitions("pid", "key", "kind").mapInArrow(sweep(default), SCHEMA)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(documents(spark, sf_dir, "pages"), rules)


OP2_SQL = r"""
with parts as (
  select page_id, url is not null and contains(url, '://') as has,
         substr(url, instr(url, '://') + 3) as rest
  from pages
), cut as (
  select page_id,
         case when has then translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
         case when has then regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) else '' end as path
  from parts
), judged as (
  select page_id, host, path,
    case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
         when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
         when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
         when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from cut
)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
from judged
"""
