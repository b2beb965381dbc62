"""Genomic inputs derived from the star-schema tables, as SQL that Spark and DuckDB both run.

All rows of the tables are in: the odd lines of the orders are one set of loci, the even ones the
other, and each line and the next one of its order are the anchors of a loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "part", "orders", "events", "documents")

_LOCI = """
select concat('chr', cast(l_suppkey % 5 + 1 as varchar(10))) as chrom, l_partkey*500 + l_orderkey % 500 as s,
       l_partkey*500 + l_orderkey % 500 + cast(l_quantity as bigint) as e,
       case l_returnflag when 'A' then '+' when 'R' then '-' else '.' end as strand,
       ((l_orderkey*10 + l_linenumber)*1000000 + l_partkey)*100 + cast(l_quantity as bigint) as ord
from lineitem where l_linenumber % 2 = {n}
"""
VIEWS = {
    "loci_a": _LOCI.format(n=1),
    "loci_b": _LOCI.format(n=0),
    "genes_v": """
select concat('G', cast(p_partkey as varchar(10))) as gene_id, p_name as gene_name, p_type as gene_type,
       concat('chr', cast(p_partkey % 5 + 1 as varchar(10))) as chrom, p_partkey*500 as s, p_partkey*500 + p_size*20 as e,
       case when p_partkey % 2 = 0 then '+' else '-' end as strand, p_partkey as ord from part
""",
    "numbers3": "select 1 as i union all select 2 as i union all select 3 as i",
    "numbers20": " union all ".join(f"select {i} as i" for i in range(20)),
    "exons_v": """
select gene_id, concat('T', substr(gene_id, 2)) as transcript_id, i as exon_number, chrom, strand,
       s + (i-1)*((e-s)/4) as sx, s + (i-1)*((e-s)/4) + 15 as ex, ord*10 + i as ord
from (select *, (e-s) as w from genes_v) g cross join numbers3
""",
    "loops_v": """
select loop_id, concat('chr', cast(k1 % 5 + 1 as varchar(10))) as chrom1, p1*500 as s1, p1*500 + 300 as e1,
       concat('chr', cast(k2 % 5 + 1 as varchar(10))) as chrom2, p2*500 as s2, p2*500 + 300 as e2
from (select l_orderkey*1000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as loop_id, l_suppkey as k1, l_partkey as p1,
             lead(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as k2,
             lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as p2 from lineitem) x
where p2 is not null
""",
    "anchors_v": """
select chrom, s, e, strand, ord from genes_v
""",
    "track_v": """
select concat('t', cast(event_id % 3 as varchar(10))) as track, concat('chr', cast(user_id % 5 + 1 as varchar(10))) as chrom,
       event_id*97 % 1000000 as s, event_id*97 % 1000000 + 60 as e, value
from events
""",
}


def load(spark: SparkSession, sf_dir: str) -> None:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name, sql in VIEWS.items():
        sql = sql.replace("(e-s)/4", "(e-s) div 4") if name == "exons_v" else sql
        spark.sql(sql).createOrReplaceTempView(name)


def loci(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).selectExpr("chrom", "s as start", "e as end", "strand", "ord")


def with_views(sql: str, *names: str) -> str:
    """DuckDB text: the views it needs as common tables before the query."""
    if not names:
        return sql
    if sql.startswith("with "):
        sql = f"select * from ({sql})"
    parts = [f"{n} as ({VIEWS[n].replace('(e-s)/4', '(e-s)//4') if n == 'exons_v' else VIEWS[n]})" for n in names]
    return f"with {', '.join(parts)}\n{sql}"
