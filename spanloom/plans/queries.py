"""One query an operator over the derived inputs, and independent SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import distance, follows, precedes, tss_end, tss_start, uid
from spanloom.operators import motifs as _motifs
from spanloom.operators import powerlaw
from spanloom.operators import signal as _signal
from spanloom.operators.genes import Genes
from spanloom.operators.graph import Architecture
from spanloom.operators.loci import Loci
from spanloom.operators.tags import Tags, coerced
from spanloom.plans.views import loci, load, with_views
from spanloom.sources import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function (spark) -> DataFrame; sql gets the views that it names."""

    def take(f: Callable[[SparkSession], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            load(spark, sf_dir)
            return f(spark)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *views)
        return f

    return take


def a(spark: SparkSession) -> Loci:
    return Loci(loci(spark, "loci_a"))


def b(spark: SparkSession) -> Loci:
    return Loci(loci(spark, "loci_b"))


UID = "concat(chrom, ':', s, '-', e, '(', strand, ')')"
OVERLAP = "a.chrom = b.chrom and a.s < b.e and b.s < a.e"


def plain(df: DataFrame) -> DataFrame:
    return df.select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), "strand", "ord")


@query(f"select ord, {UID} as uid, e - s as length, (s + e) // 2 as center from loci_a", "loci_a")
def loci_project(spark):
    return a(spark).frame("ord", "uid", "length", "center")


@query("""select a.ord, abs((a.s + a.e)//2 - (b.s + b.e)//2) as distance, a.s < b.s as precedes, a.s > b.s as follows
from loci_a a join loci_b b on a.chrom = b.chrom and a.ord // 1000000000 = b.ord // 1000000000""", "loci_a", "loci_b")
def locus_distance(spark):
    pre = lambda x, p: x.df.select(*[F.col(c).alias(f"{p}{c}") for c in x.df.columns])
    met = pre(a(spark), "a_").join(pre(b(spark), "b_"), (F.col("a_chrom") == F.col("b_chrom")) & (F.expr("a_ord div 1000000000") == F.expr("b_ord div 1000000000")))
    return met.select(F.col("a_ord").alias("ord"), distance().alias("distance"), precedes().alias("precedes"), follows().alias("follows"))


@query("select chrom, greatest(0, s - 250000) as s, e + 250000 as e, strand, ord from loci_a", "loci_a")
def loci_slop(spark):
    return plain(a(spark).slop(250_000).df)


@query("select chrom, s, e, strand, row_number() over (order by chrom, s, ord) as place from loci_a", "loci_a")
def loci_sort(spark):
    rows = a(spark).sort().df
    # dense places: the sorted partitions' sizes, summed, plus the place within the partition
    numbered = rows.withColumn("part", F.shiftright("ord", 33)).withColumn("k", F.col("ord").bitwiseAND((1 << 33) - 1))
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    shift, total = [], 0
    for r in sizes:
        shift += [F.lit(r["part"]), F.lit(total)]
        total += r["n"]
    return numbered.select("chrom", F.col("start").alias("s"), F.col("end").alias("e"), "strand", (F.element_at(F.create_map(*shift), F.col("part")) + F.col("k") + 1).alias("place"))


_MERGE = """, ordered as (
  select *, max(e) over (partition by chrom order by s, ord rows between unbounded preceding and 1 preceding) as before from {src}
), marked as (
  select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by chrom order by s, ord rows unbounded preceding) as island from ordered
)
select chrom, min(s) as s, max(e) as e, arg_min(strand, ord) filter (where first) as strand, count(*) as n
from (select *, row_number() over (partition by chrom, island order by s, ord) = 1 as first from marked) group by chrom, island"""


@query("select chrom, s, e, strand from (" + _MERGE.format(src="loci_a")[2:].replace("ordered as (", "with ordered as (", 1) + ")", "loci_a")
def loci_merge(spark):
    return plain(a(spark).merge().df).drop("ord")


@query(f"select chrom, s, e, strand, ord from loci_a a where exists (select 1 from loci_b b where {OVERLAP})", "loci_a", "loci_b")
def loci_intersect(spark):
    return plain((a(spark) & b(spark)).df)


@query(f"select chrom, s, e, strand, ord from loci_a a where not exists (select 1 from loci_b b where {OVERLAP})", "loci_a", "loci_b")
def loci_difference(spark):
    return plain((a(spark) - b(spark)).df)


@query("select chrom, s, e, strand, ord from loci_a union all select chrom, s, e, strand, ord + (select max(ord) + 1 from loci_a) from loci_b", "loci_a", "loci_b")
def loci_concat(spark):
    return plain((a(spark) + b(spark)).df)


@query(f"""select chrom, s, e, strand from loci_a a where not exists (select 1 from loci_b b where {OVERLAP})
union all select chrom, s, e, strand from loci_b a where not exists (select 1 from loci_a b where {OVERLAP})""", "loci_a", "loci_b")
def loci_xor(spark):
    return plain((a(spark) ^ b(spark)).df).drop("ord")


@query("select chrom, s, e, strand, ord from loci_a where chrom = 'chr2' and s < 400000 and e > 100000", "loci_a")
def loci_overlaps_region(spark):
    return plain(a(spark).overlaps("chr2", 100_000, 400_000).df)


@query(f"select a.ord as ord_a, b.ord as ord_b, greatest(a.s, b.s) as s, least(a.e, b.e) as e from loci_a a join loci_b b on {OVERLAP}", "loci_a", "loci_b")
def loci_overlap_pairs(spark):
    return a(spark).pairs(b(spark)).select(F.col("a_ord").alias("ord_a"), F.col("b_ord").alias("ord_b"), F.greatest("a_start", "b_start").alias("s"), F.least("a_end", "b_end").alias("e"))


_NEAREST = """select ord, {cols} from (
  select a.ord, a.s, a.e, a.strand, min(struct_pack(
    distance := case when a.s < b.e and b.s < a.e then 0 when b.e <= a.s then a.s - b.e + 1 else b.s - a.e + 1 end, s_b := b.s, e_b := b.e, ord_b := b.ord)) as c
  from {left} a join {right} b on a.chrom = b.chrom group by a.ord, a.s, a.e, a.strand)"""


@query(_NEAREST.format(cols="c.s_b, c.e_b, c.ord_b, c.distance", left="loci_a", right="loci_b"), "loci_a", "loci_b")
def loci_nearest(spark):
    from spanloom.operators.nearest import nearest

    rows = nearest(a(spark).df, b(spark).df)
    return rows.select("ord", F.col("b_start").alias("s_b"), F.col("b_end").alias("e_b"), F.col("b_ord").alias("ord_b"), "distance")


@query(f"select uid, max(ord) as ord from (select {UID} as uid, ord from loci_a) group by uid", "loci_a")
def loci_uid_lookup(spark):
    return a(spark).uids()


@query(f"""select x.ord as pos, l.chrom, l.s, l.e, l.strand from (select ord, {UID} as uid from loci_a where chrom = 'chr3') x
join (select {UID} as uid, max(chrom) as chrom, max(s) as s, max(e) as e, max(strand) as strand from loci_a group by 1) l using (uid)""", "loci_a")
def loci_subloci(spark):
    x = a(spark)
    asked = x.df.where("chrom = 'chr3'").select(uid().alias("uid"), F.col("ord").alias("pos"))
    return plain(x.subloci(asked).df).withColumnRenamed("ord", "pos")


@query("select chrom, s, e, strand from loci_a", "loci_a")
def bed_roundtrip(spark):
    x = a(spark)
    lines = text.bed_lines(x.df)
    return plain(text.parse_bed(lines)).drop("ord")


def dealt(spark: SparkSession, name: str) -> DataFrame:
    """A derived table of genes, dealt out over all cores before it grows."""
    return spark.table(name).repartition(3 * spark.sparkContext.defaultParallelism, "gene_id")


def gtf_lines(spark: SparkSession) -> DataFrame:
    """Lines of a feature file of the derived genes: gene, transcript, exons, a CDS and two UTRs each.

    A gene is few bytes of the parts' table, which is one split for millions of them, but nine lines to
    write and parse: the genes are dealt out first.
    """
    gene = "concat('gene_id \"', gene_id, '\"; gene_name \"', gene_name, '\"; gene_type \"', gene_type, '\";')"
    t = "concat('gene_id \"', gene_id, '\"; transcript_id \"T', substr(gene_id, 2), '\"; exon_number ', {n}, ';')"
    row = "concat_ws('\t', chrom, 'x', '{f}', {s}, {e}, '.', strand, '.', {attr})"
    g = dealt(spark, "genes_v")
    parts = [("gene", "s", "e", gene, 0), ("transcript", "s", "e", t.format(n="''"), 1)]
    parts += [("CDS", "s + 10", "e - 10", t.format(n="2"), 5), ("UTR", "s", "s + 10", t.format(n="1"), 6), ("UTR", "e - 10", "e", t.format(n="3"), 7)]
    lines = ", ".join(f"struct({row.format(f=f, s=s, e=e, attr=attr)} as value, ord*10 + {k} as ord)" for f, s, e, attr, k in parts)
    out = g.selectExpr(f"explode(array({lines})) as x").select("x.*")
    x = dealt(spark, "exons_v").selectExpr("concat_ws('\t', chrom, 'x', 'exon', sx, ex, '.', strand, '.', " + "concat('gene_id \"', gene_id, '\"; transcript_id \"', transcript_id, '\"; exon_number ', exon_number, ';')) as value", "ord")
    return out.unionByName(x.withColumn("ord", F.expr("(ord div 10) * 10 + ord % 10 + 1")))


def genes(spark: SparkSession) -> Genes:
    return Genes.of(text.parse_gtf(gtf_lines(spark)))


_G = "genes_v", "numbers3", "exons_v"


@query("""select chrom, 'gene' as feature, s, e, strand, gene_id, null as transcript_id, gene_name, gene_type, 0 as exon_number from genes_v
union all select chrom, 'transcript', s, e, strand, gene_id, concat('T', substr(gene_id, 2)), null, null, 0 from genes_v
union all select chrom, 'exon', sx, ex, strand, gene_id, transcript_id, null, null, exon_number from exons_v
union all select chrom, 'CDS', s + 10, e - 10, strand, gene_id, concat('T', substr(gene_id, 2)), null, null, 2 from genes_v
union all select chrom, 'UTR', s, s + 10, strand, gene_id, concat('T', substr(gene_id, 2)), null, null, 1 from genes_v
union all select chrom, 'UTR', e - 10, e, strand, gene_id, concat('T', substr(gene_id, 2)), null, null, 3 from genes_v""", *_G)
def gtf_parse(spark):
    rows = text.parse_gtf(gtf_lines(spark))
    return rows.select("chrom", "feature", F.col("start").alias("s"), F.col("end").alias("e"), "strand", "gene_id", "transcript_id", "gene_name", "gene_type", "exon_number")


@query("select gene_id, gene_name, gene_type, cast(null as varchar) as absent from genes_v", "genes_v")
def gtf_attributes(spark):
    field = spark.table("genes_v").selectExpr("concat('gene_id \"x\"; gene_id \"', gene_id, '\"; gene_name \"', gene_name, '\"; gene_type ', gene_type) as t")
    return field.select(*[text.attribute(F.col("t"), k).alias(k) for k in ("gene_id", "gene_name", "gene_type", "absent")])


@query("""select gene_id, s, s + 10 as e, case strand when '+' then '5''' else '3''' end as utr_type from genes_v
union all select gene_id, e - 10, e, case strand when '+' then '3''' else '5''' end from genes_v""", "genes_v")
def gtf_utr_type(spark):
    # at the smallest size (20 bases) the second UTR ends where the CDS starts
    return genes(spark).features.where("feature = 'UTR'").select("gene_id", F.col("start").alias("s"), F.col("end").alias("e"), "utr_type")


@query("select name, chrom, s, e from (select gene_name as name, chrom, case strand when '+' then s else e end as s, case strand when '+' then s + 1 else e - 1 end as e, row_number() over (partition by gene_name order by ord desc) as k from genes_v) where k = 1", "genes_v")
def genes_tss(spark):
    return genes(spark).tss().select("name", "chrom", F.col("start").alias("s"), F.col("end").alias("e"))


@query("select gene_id, case strand when '+' then s else e end as s, case strand when '+' then s + 1 else e - 1 end as e from genes_v", "genes_v")
def gene_tss_each(spark):
    return genes(spark).genes.select("gene_id", tss_start().alias("s"), tss_end().alias("e"))


@query("select 'Transcripts' as feature, count(*) as n from genes_v union all select 'Exons', count(*) from exons_v union all select 'CDS', count(*) from genes_v union all select 'UTR', 2*count(*) from genes_v", *_G)
def genes_table(spark):
    return genes(spark).table()


_PROM = "select chrom, greatest(0, (case strand when '+' then s else e end) - 1000) as s, (case strand when '+' then s + 1 else e - 1 end) + 1000 as e from (select *, row_number() over (partition by gene_name order by ord desc) as k from genes_v) where k = 1"
_SETS = f"""select 0 as p, chrom, s, e from ({_PROM})
union all select 1, chrom, case strand when '+' then s else e - 10 end, case strand when '+' then s + 10 else e end from genes_v
union all select 2, chrom, case strand when '+' then e - 10 else s end, case strand when '+' then e else s + 10 end from genes_v
union all select 3, chrom, sx, ex from exons_v union all select 4, chrom, s, e from genes_v"""
_NAMES = "case min(p) when 0 then 'Promoter-TSS' when 1 then '5UTR' when 2 then '3UTR' when 3 then 'Exonic' when 4 then 'Intronic' else 'Intergenic' end"
_ANNOTATE = f"select a.ord, any_value({UID.replace('chrom', 'a.chrom').replace(' s,', ' a.s,').replace(' e,', ' a.e,').replace('strand', 'a.strand')}) as uid, {_NAMES} as annotation from loci_a a left join ({_SETS}) b on {OVERLAP} group by a.ord, a.s, a.e, a.strand"


@query(f"""select p, chrom, min(s) as s, max(e) as e from (
  select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by p, chrom order by s, e rows unbounded preceding) as island from (
    select *, max(e) over (partition by p, chrom order by s, e rows between unbounded preceding and 1 preceding) as before from ({_SETS}) where p < 4))
group by p, chrom, island union all select p, chrom, s, e from ({_SETS}) where p = 4""", *_G)
def genes_annotation_sets(spark):
    return genes(spark).annotation_sets().select(F.col("priority").alias("p"), "chrom", F.col("start").alias("s"), F.col("end").alias("e"))


@query(_ANNOTATE, "loci_a", *_G)
def genes_annotate(spark):
    return genes(spark).annotations(a(spark))


@query(f"select annotation, count(*) as n from ({_ANNOTATE}) group by annotation", "loci_a", *_G)
def genes_annotation_counts(spark):
    return genes(spark).annotations(a(spark)).groupBy("annotation").agg(F.count("*").alias("n"))


@query(_NEAREST.format(cols="c.s_b, c.e_b, c.distance", left="loci_a", right="(select chrom, greatest(0, s - 1000) as s, e + 1000 as e, first as ord from (select chrom, case strand when '+' then s else e end as s, case strand when '+' then s + 1 else e - 1 end as e, row_number() over (partition by gene_name order by ord desc) as k, min(ord) over (partition by gene_name) as first from genes_v) where k = 1)"), "loci_a", "genes_v")
def genes_nearest(spark):
    from spanloom.operators.nearest import nearest

    g = genes(spark)
    rows = nearest(a(spark).df, g.tss_windows().df)
    return rows.select("ord", F.col("b_start").alias("s_b"), F.col("b_end").alias("e_b"), "distance")


def architecture(spark: SparkSession) -> tuple[Architecture, Loci]:
    own = Loci(loci(spark, "anchors_v"))
    rows = spark.table("loops_v").selectExpr("loop_id", "chrom1", "s1 as start1", "e1 as end1", "chrom2", "s2 as start2", "e2 as end2")
    return Architecture.of(own, rows, r=600, dmax=4e5), own


_EDGES = """, near as (select *, (s1+e1)//2 as m1, (s2+e2)//2 as m2 from loops_v where abs((s1+e1)//2 - (s2+e2)//2) <= 400000),
edges as (
  select l.loop_id, x.ord as ord1, y.ord as ord2, concat(x.chrom, ':', x.s, '-', x.e, '(', x.strand, ')') as uid1, concat(y.chrom, ':', y.s, '-', y.e, '(', y.strand, ')') as uid2,
         x.chrom as c1, y.chrom as c2, (x.s+x.e)//2 as p1, (y.s+y.e)//2 as p2, x.ord as g1, y.ord as g2
  from near l join anchors_v x on x.chrom = l.chrom1 and x.s < l.m1 + 600 and l.m1 - 600 < x.e
  join anchors_v y on y.chrom = l.chrom2 and y.s < l.m2 + 600 and l.m2 - 600 < y.e
)"""
_E = "genes_v", "anchors_v", "loops_v"


def _graph(sql: str) -> str:
    """A query over `edges`, with its common tables in front."""
    return "with " + _EDGES[2:] + " " + sql


@query("select loop_id, ord1, ord2, uid1, uid2 from (" + _graph("select * from edges where uid1 <> uid2") + ")", *_E)
def graph_edges(spark):
    return architecture(spark)[0].edges.select("loop_id", "ord1", "ord2", "uid1", "uid2")


@query("select * from (" + _graph("""select (select count(*) from loops_v) as total, (select count(distinct loop_id) from edges) as mapped,
(select count(distinct u) from (select uid1 as u from edges where uid1 <> uid2 union all select uid2 from edges where uid1 <> uid2)) as loci, (select count(*) from edges where uid1 <> uid2) as links""") + ")", *_E)
def graph_mapping_report(spark):
    return architecture(spark)[0].report().drop("pct")


@query("select uid, neighbor, w from (" + _graph("select uid1 as uid, uid2 as neighbor, 0.0::double as w from edges where uid1 <> uid2 union select uid2, uid1, 0.0::double from edges where uid1 <> uid2") + ")", *_E)
def graph_neighbors(spark):
    return architecture(spark)[0].adjacency()


@query("select u, v, loop_id, ord1, ord2 from (" + _graph("""select least(uid1, uid2) as u, greatest(uid1, uid2) as v, loop_id, ord1, ord2,
row_number() over (partition by least(uid1, uid2), greatest(uid1, uid2) order by loop_id, ord1, ord2) as k from edges where uid1 <> uid2""") + ") where k = 1", *_E)
def graph_edge_lookup(spark):
    edges = architecture(spark)[0].dedupe().edges
    return edges.select(F.least("uid1", "uid2").alias("u"), F.greatest("uid1", "uid2").alias("v"), "loop_id", "ord1", "ord2")


@query("select uid, count(*) as degree from (" + _graph("select uid1 as uid from edges where uid1 <> uid2 union all select uid2 from edges where uid1 <> uid2") + ") group by uid", *_E)
def graph_degree(spark):
    return architecture(spark)[0].degree()


BIN = 5000


def matrix(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Tiles of BIN bases (chromosome k, tile t: id k*1000000 + t) and counts of loop anchors by tile pair."""
    bins = spark.sql(f"select distinct (cast(substr(chrom, 4) as bigint)*1000000 + t) as bin_id, chrom, t*{BIN} as start, (t+1)*{BIN} as end from (select chrom, explode(sequence(s div {BIN}, e div {BIN})) as t from anchors_v)")
    tile = lambda i: f"cast(substr(chrom{i}, 4) as bigint)*1000000 + ((s{i}+e{i}) div 2) div {BIN}"
    pixels = spark.sql(f"select least(b1, b2) as bin1_id, greatest(b1, b2) as bin2_id, cast(count(*) as double) as count from (select {tile(1)} as b1, {tile(2)} as b2 from loops_v) group by 1, 2")
    return bins, pixels


_WEIGHTS = _EDGES + f""", located as (
  select *, cast(substr(c1, 4) as bigint)*1000000 + (case when l1.s is null then 0 else l1.s//{BIN} end) as b1, cast(substr(c2, 4) as bigint)*1000000 + (case when l2.s is null then 0 else l2.s//{BIN} end) as b2
  from (select * from edges where uid1 <> uid2) k join (select ord as o1, s from anchors_v) l1 on o1 = ord1 join (select ord as o2, s from anchors_v) l2 on o2 = ord2
), shared as (select *, count(*) over (partition by least(b1, b2), greatest(b1, b2)) as n from located),
cells as (select least(b1, b2) as lo, greatest(b1, b2) as hi, count(*) as c from (
  select cast(substr(chrom1, 4) as bigint)*1000000 + ((s1+e1)//2)//{BIN} as b1, cast(substr(chrom2, 4) as bigint)*1000000 + ((s2+e2)//2)//{BIN} as b2 from loops_v) group by 1, 2),
weighed as (select loop_id, ord1, ord2, c1, c2, p1, p2, coalesce(c / n, 0.0) as w from shared left join cells on lo = least(b1, b2) and hi = greatest(b1, b2))"""


@query("select * from (with " + _WEIGHTS[2:] + " select loop_id, ord1, ord2, round(w, 6) as w from weighed)", *_E)
def contacts_weights(spark):
    g, own = architecture(spark)
    return g.add_matrix(own, *matrix(spark)).edges.select("loop_id", "ord1", "ord2", F.round("w", 6).alias("w"))


@query("select * from (with " + _EDGES[2:] + " select loop_id, ord1, ord2, case when c1 = c2 then cast(abs(p1 - p2) as double) end as d from edges where uid1 <> uid2)", *_E)
def edge_distance(spark):
    g, own = architecture(spark)
    return g.with_distance(own).edges.select("loop_id", "ord1", "ord2", "d")


@query("select * from (with " + _WEIGHTS[2:] + " select round(regr_intercept(log10(w), log10(abs(p1 - p2))), 6) as intercept, round(regr_slope(log10(w), log10(abs(p1 - p2))), 6) as slope from weighed where c1 = c2 and w > 0 and p1 <> p2)", *_E)
def powerlaw_ols(spark):
    g, own = architecture(spark)
    out = g.add_matrix(own, *matrix(spark)).with_distance(own)
    row = powerlaw.ols(out.edges)
    return row.select(F.round("intercept", 6).alias("intercept"), F.round("slope", 6).alias("slope"))


def tags(spark: SparkSession) -> Tags:
    x = a(spark)
    rows = x.df.withColumn("uid", uid())
    values = rows.groupBy("uid").agg(F.max("end").alias("e"), F.max("start").alias("s")).select("uid", F.when(F.col("s") % 7 == 0, F.lit("low")).otherwise((F.col("e") % 100).cast("string")).alias("value"))
    plus = rows.where("strand = '+'").select("uid")
    return Tags.make(x).add({"H3K27ac-SE": plus, "chr2 peaks": rows.where("chrom = 'chr2'").select("uid"), "atac": values})


@query("select chrom, s, e, strand, ord from loci_a where strand = '+' and chrom <> 'chr2' or strand <> '+' and chrom = 'chr2'", "loci_a")
def tags_set_algebra(spark):
    return plain(tags(spark).query(lambda x: (x.se | x["chr2 peaks"]) - (x["H3K27ac-SE"] & x.chr2)).df)


@query("select chrom, s, e, strand, ord from loci_a where (s % 7 <> 0 and e % 100 >= 30 and e % 100 <> 50) or (s % 7 <> 0 and e % 100 = 7)", "loci_a")
def tags_numeric_filter(spark):
    return plain(tags(spark).query(lambda x: (x.atac >= 30) & (x.atac != 50) | (x.atac == 7)).df)


@query("select chrom, s, e, strand, ord from loci_a where strand = '+' and s % 7 <> 0 and e % 100 > 60", "loci_a")
def tags_pending(spark):
    return plain(tags(spark).query(lambda x: x.se & x.atac > 60).df)


@query(f"""select 'H3K27ac-SE' as tag, 'set' as kind, count(distinct {UID}) as n from loci_a where strand = '+'
union all select 'chr2 peaks', 'set', count(distinct {UID}) from loci_a where chrom = 'chr2' union all select 'atac', 'mapping', count(distinct {UID}) from loci_a""", "loci_a")
def tags_table(spark):
    return tags(spark).table()


@query("select event_id, try_cast(v as double) as num, case when try_cast(v as double) is null then v end as str from (select event_id, case when event_id % 3 = 0 then event_type else cast(event_id % 1000 as varchar) end as v from events)")
def tags_coerce(spark):
    v = spark.table("events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise((F.col("event_id") % 1000).cast("string")).alias("v"))
    num, txt = coerced(F.col("v"))
    return v.select("event_id", num.alias("num"), txt.alias("str"))


CHROMLEN = 1_000_100


def tracks(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    sizes = spark.sql(f"select distinct chrom, cast({CHROMLEN} as bigint) as length from anchors_v")
    return spark.sql("select track, chrom, s as start, e as end, value from track_v"), sizes


def _bins_sql(span: bool, n: int, flank: int = 0) -> str:
    lo, hi = ("s", f"least({CHROMLEN}, e)") if span else (f"greatest(0, (s+e)//2 - {flank})", f"least({CHROMLEN}, (s+e)//2 + {flank})")
    pre, core = ("0", str(n)) if span else (f"greatest(0, {flank} - (s+e)//2)", f"{n} - greatest(0, {flank} - (s+e)//2) - greatest(0, (s+e)//2 + {flank} - {CHROMLEN})")
    return f"""select ord, chrom, pre + i as bin, lo + ((hi-lo)*i)//core as bs, greatest(lo + ((hi-lo)*(i+1))//core, lo + ((hi-lo)*i)//core + 1) as be
from (select ord, chrom, {lo} as lo, {hi} as hi, {pre} as pre, {core} as core from anchors_v) cross join numbers20 where core > 0 and i < core and i < {n} and hi > lo"""


def _signal_sql(agg: str, span: bool, n: int, flank: int = 0) -> str:
    value = {"mean": "sum(value*o)/sum(o)", "max": "max(value)", "min": "min(value)"}[agg]
    return f"""select d.ord, d.track, d.bin, round(coalesce(v, 0.0), 2) as value
from (select ord, track, i as bin from anchors_v cross join (select distinct track from track_v) cross join numbers20 where i < {n}) d
left join (select ord, track, bin, {value} as v from (select x.ord, t.track, x.bin, t.value, least(x.be, t.e) - greatest(x.bs, t.s) as o from ({_bins_sql(span, n, flank)}) x join track_v t on x.chrom = t.chrom and x.bs < t.e and t.s < x.be) group by 1, 2, 3) m
on d.ord = m.ord and d.track = m.track and d.bin = m.bin"""


def _signal_query(agg: str, span: bool, n: int, flank: int = 0):
    def f(spark: SparkSession) -> DataFrame:
        out = _signal.binned_signal(Loci(loci(spark, "anchors_v")), *tracks(spark), n_bins=n, flank=flank, agg=agg, span=span)
        return out.select("ord", "track", "bin", F.round(F.col("value").cast("double"), 2).alias("value"))

    f.__name__ = f"signal_span_{agg}" if span else "signal_center"
    return query(_signal_sql(agg, span, n, flank), "genes_v", "anchors_v", "track_v", "numbers20")(f)


for _agg in ("mean", "max", "min"):
    _signal_query(_agg, True, 5)
_signal_query("mean", False, 10, 300)


def _profile(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    own = Loci(loci(spark, "anchors_v"))
    values = _signal.binned_signal(own, *tracks(spark), n_bins=5, span=True)
    return values, own.df.select("ord", F.col("strand").alias("set"))


_SIG = "genes_v", "anchors_v", "track_v", "numbers20"


@query(f"select strand as \"set\", track, bin, round(avg(value), 2) as mean from ({_signal_sql('mean', True, 5).replace('round(coalesce(v, 0.0), 2)', 'coalesce(v, 0.0)')}) join (select ord, strand from anchors_v) using (ord) group by 1, 2, 3", *_SIG)
def signal_profile(spark):
    values, sets = _profile(spark)
    return _signal.profile_frame(values, sets).select("set", "track", "bin", F.round("mean", 2).alias("mean"))


@query(f"select ord, round(avg(value), 2) as mean from ({_signal_sql('mean', True, 5).replace('round(coalesce(v, 0.0), 2)', 'coalesce(v, 0.0)')}) group by ord", *_SIG)
def signal_heatmap_order(spark):
    values, _ = _profile(spark)
    return _signal.heatmap_order(values).select("ord", F.round("mean", 2).alias("mean"))


@query(f"select round(quantile_cont(mean, 0.99), 2) as \"limit\" from (select strand, track, bin, avg(value) as mean from ({_signal_sql('mean', True, 5).replace('round(coalesce(v, 0.0), 2)', 'coalesce(v, 0.0)')}) join (select ord, strand from anchors_v) using (ord) group by 1, 2, 3)", *_SIG)
def signal_percentile(spark):
    values, sets = _profile(spark)
    return _signal.profile_limit(_signal.profile_frame(values, sets)).select(F.round("limit", 2).alias("limit"))


@query("select distinct strand as \"set\" from genes_v", "genes_v")
def signal_set_labels(spark):
    return _signal.set_labels(_profile(spark)[1])


_SEQ = "trim(replace(replace(text, chr(10), ' '), '>', 'N'), ' ')"


def genome(spark: SparkSession) -> DataFrame:
    """Whole texts as sequences, one a document."""
    raw = spark.table("documents").where("text is not null and doc_id is not null").select(F.expr("concat('chr', doc_id, ' x\n', replace(text, '\n', ' '))").alias("value"), F.col("doc_id").alias("ord"))
    return text.parse_records(raw.withColumn("value", F.replace("value", F.lit(">"), F.lit("N"))))


@query(f"select concat('chr', doc_id) as name, {_SEQ} as seq from documents where {_SEQ} <> ''")
def fasta_parse(spark):
    return genome(spark).select("name", "seq")


def _sequences(spark: SparkSession, r: int | None = None) -> DataFrame:
    """Sequences of loci that span whole texts, or of r bases around their centers, cut from tiles."""
    g = genome(spark)
    own = Loci(g.selectExpr("name as chrom", "0L as start", "cast(length(seq) as bigint) as end", "'+' as strand", "ord"))
    return _motifs.cut_sequences(own, _motifs.tiles(g), r)


@query(f"select doc_id as ord, {_SEQ} as sequence from documents where {_SEQ} <> ''")
def locus_sequence(spark):
    return _sequences(spark).select("ord", "sequence")


@query(f"""select doc_id as ord, substr(seq, greatest(0, len(seq) // 2 - 40)::int + 1, (len(seq) // 2 + 40 - greatest(0, len(seq) // 2 - 40))::int) as sequence
from (select doc_id, {_SEQ} as seq from documents where {_SEQ} <> '')""")
def locus_sequence_radius(spark):
    return _sequences(spark, 40).select("ord", "sequence")


#: A made-up motif: counts by position of A, C, G, T.
MOTIF = [("TATA", [[1, 1, 1, 17], [17, 1, 1, 1], [1, 1, 1, 17]]), ("none", [[20, 0, 0, 0]] * 9)]


# 'ta' never overlaps itself: a hit is a piece between two of them that goes on with 't', be it the next one's
@query(f"""with w as (select lower({_SEQ}) as s from documents where {_SEQ} <> ''), p as (select s, string_split(s, 'ta') as ps from w)
select 'TATA' as motif, coalesce(sum(len(list_filter(range(2, len(ps) + 1), lambda i: ps[i] like 't%' or (ps[i] = '' and i < len(ps))))), 0) / 3.0 as score from p
union all select 'none', coalesce(sum(list_sum(list_transform(regexp_extract_all(s, 'a{{9,}}'), lambda r: len(r) - 8))), 0) / 9.0 from w""")
def motif_scan(spark):
    hits = _motifs.scan(_sequences(spark), MOTIF, threshold=4.0).groupBy("motif").agg(F.sum("n").alias("n"))
    widths = spark.createDataFrame([(n, len(c)) for n, c in MOTIF], "motif string, width int")
    return widths.join(hits, "motif", "left").select("motif", (F.coalesce("n", F.lit(0)) / F.col("width")).alias("score"))


@query("select loop_id, chrom1, s1, e1, chrom2, s2, e2 from loops_v", "loops_v")
def bedpe_parse(spark):
    lines = spark.table("loops_v").selectExpr("concat_ws(' ', chrom1, s1, e1, chrom2, s2, e2, 'x') as value", "loop_id as ord")
    rows = text.parse_bedpe(lines.unionByName(spark.createDataFrame([("# c", 1), ("", 2)], "value string, ord long")))
    return rows.select("loop_id", "chrom1", F.col("start1").alias("s1"), F.col("end1").alias("e1"), "chrom2", F.col("start2").alias("s2"), F.col("end2").alias("e2"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded, sorted, merged loci that overlap the other set, counted by annotation class."""
    load(spark, sf_dir)
    own = (a(spark).slop(50).sort().merge()) & b(spark)
    return genes(spark).annotations(own).groupBy("annotation").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

