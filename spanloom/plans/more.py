"""Queries of list access, files, model edits, graph algorithms, signal frames and tag payloads, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import follows, precedes, uid
from spanloom.operators import powerlaw
from spanloom.operators import signal as _signal
from spanloom.operators.genes import Genes
from spanloom.operators.graph import Architecture
from spanloom.operators.loci import Loci
from spanloom.operators.order import placed
from spanloom.operators.rounds import folder
from spanloom.operators.tags import Tags
from spanloom.plans.queries import _E, _EDGES, _NEAREST, _SIG, _WEIGHTS, CHROMLEN, OVERLAP, UID, _bins_sql, _graph, _profile, _signal_sql, a, architecture, b, genes, gtf_lines, matrix, plain, query, tags, tracks
from spanloom.plans.views import loci
from spanloom.sources import matrix as matrices
from spanloom.sources import text


_SORTED = "select *, row_number() over (order by chrom, s, ord) - 1 as pos from loci_a"


# list access
@query(f"select pos, chrom, s, e, strand from ({_SORTED}) where pos in (0, 17, 1999, (select count(*) - 1 from loci_a))", "loci_a")
def loci_at(spark):
    rows = a(spark).sort()
    out = None
    for i in (0, 17, 1999, -1):
        one = rows.at(i).select(F.col("ord").alias("pos"), "chrom", F.col("start").alias("s"), F.col("end").alias("e"), "strand")
        out = one if out is None else out.unionByName(one)
    return out


@query("select row_number() over (order by ord) - 1 as pos, chrom, s, e, strand from loci_a qualify pos >= 100 and pos % 3 = 1", "loci_a")
def loci_slice(spark):
    return plain(a(spark)[100::3].df).withColumnRenamed("ord", "pos")


@query(f"select chrom, s, e, strand, ord from loci_a where {UID} = (select min({UID}) from loci_a) order by ord desc limit 1", "loci_a")
def loci_get(spark):
    x = a(spark)
    return plain(x[x.df.agg(F.min(uid())).first()[0]])


@query(f"""with l as ({_SORTED}), head as (select chrom, s, e, strand, pos * 10 as k from l where pos < 50 and pos <> 7),
own as (select * from head union all select 'chrY', 5, 9, '.', 25 union all select 'chrZ', 1, 2, '+', 10000)
select chrom, s, e, strand, row_number() over (order by k desc) - 1 as pos, (select count(*) from own) as n from own""", "loci_a")
def loci_list(spark):
    x = a(spark).sort()[:50].append("chrZ", 1, 2, "+").insert(3, "chrY", 5, 9)
    _, x = x.pop(8)
    return plain(x.reverse().renumbered().df).withColumnRenamed("ord", "pos").withColumn("n", F.lit(len(x)))


@query(f"""with k as (select min({UID}) as u, max({UID}) as v from loci_a), l as (select {UID} as u, row_number() over (order by ord) - 1 as pos from loci_a)
select k.u as uid, (select min(pos) from l where l.u = k.u) as first, (select count(*) from l where l.u = k.u) as n, (select count(*) - 1 from l) as rest, true as there from k
union all select k.v, (select min(pos) from l where l.u = k.v), (select count(*) from l where l.u = k.v), (select count(*) - 1 from l), true from k""", "loci_a")
def loci_index(spark):
    x = a(spark)
    asked = x.df.agg(F.min(uid()), F.max(uid())).first()
    rows = [(u, x.index(u), x.count(u), x.remove(u).count(), u in x) for u in asked]
    return spark.createDataFrame(rows, "uid string, first long, n long, rest long, there boolean")


@query(f"select chrom as Chr, s as Start, e as \"End\", strand as Strand, {UID} as Name from loci_a", "loci_a")
def loci_frame(spark):
    return a(spark).copy().to_frame()


@query("select chrom as Chromosome, s as Start, e as \"End\", strand as Strand, concat('n', ord) as Name from loci_a", "loci_a")
def loci_ranges(spark):
    return a(spark).to_ranges(F.concat(F.lit("n"), "ord"))


@query("""select a.ord, b.ord as ord_b, row(a.chrom, a.s) < row(b.chrom, b.s) as precedes, row(a.chrom, a.s) > row(b.chrom, b.s) as follows, row(a.chrom, a.s, a.e, a.strand) = row(b.chrom, b.s, b.e, b.strand) as same
from loci_a a join loci_b b on a.ord // 1000000000 = b.ord // 1000000000""", "loci_a", "loci_b")
def locus_compare(spark):
    pre = lambda x, p: x.df.select(*[F.col(c).alias(f"{p}{c}") for c in x.df.columns])
    met = pre(a(spark), "a_").join(pre(b(spark), "b_"), F.expr("a_ord div 1000000000 = b_ord div 1000000000"))
    return met.select(F.col("a_ord").alias("ord"), F.col("b_ord").alias("ord_b"), precedes().alias("precedes"), follows().alias("follows"), (uid("a_") == uid("b_")).alias("same"))


@query(f"select distinct v.i, chrom, s, e, strand, ord from loci_a a join (values (0, 'chr1', 0, 60000), (1, 'chr3', 100000, 100900)) v(i, c, lo, hi) on a.chrom = c and a.s < hi and lo < a.e", "loci_a")
def loci_memory(spark):
    regions = Loci.of(spark, [("chr1", 0, 60_000), ("chr3", 100_000, 100_900, "-")])
    met = a(spark).pairs(regions)
    return met.select(F.col("b_ord").cast("int").alias("i"), *[F.col(f"a_{x}").alias(y) for x, y in (("chrom", "chrom"), ("start", "s"), ("end", "e"), ("strand", "strand"), ("ord", "ord"))])


# files
@query("select chrom, s, e, strand, row_number() over (order by ord) - 1 as pos from loci_a", "loci_a")
def loci_file(spark):
    path = f"{folder(spark)}/own.bed"
    a(spark).to_bed(path)
    return plain(Loci.make(spark, path).renumbered().df).withColumnRenamed("ord", "pos")


def _gtf_file(spark: SparkSession) -> Genes:
    path = f"{folder(spark)}/own.gtf"
    odd = spark.createDataFrame([("# a comment", -2), ("", -1), *((f"chr1\tx\t{f}\t1\t2\t.\t+\t.\tgene_id \"none\";", i) for i, f in enumerate(("start_codon", "Selenocysteine", "start_codon")))], "value string, ord long")
    text.write_lines(gtf_lines(spark).unionByName(odd), path)
    return Genes.make(spark, path, chr_map={"chr1": "one", "chr4": "four"}, gene_type_key="gene_type")


_RENAMED = "case chrom when 'chr1' then 'one' when 'chr4' then 'four' else chrom end"


@query(f"select gene_id, gene_name, gene_type, {_RENAMED} as chrom, s, e, strand from genes_v", "genes_v")
def genes_file(spark):
    g = _gtf_file(spark)
    return g.genes.select("gene_id", "gene_name", "gene_type", "chrom", F.col("start").alias("s"), F.col("end").alias("e"), "strand")


@query("select 'start_codon' as feature union all select 'Selenocysteine'")
def genes_unmapped(spark):
    return _gtf_file(spark).unmapped


@query("select name, chrom, s, e from (select gene_name as name, chrom, case strand when '+' then s else e end as s, case strand when '+' then s + 1 else e - 1 end as e, row_number() over (partition by gene_name order by ord desc) as k from genes_v where gene_type in ('PROMO BRUSHED', 'STANDARD BRUSHED') or gene_type like 'S%') where k = 1", "genes_v")
def genes_tss_of_types(spark):
    kinds = [r[0] for r in spark.table("genes_v").where("gene_type in ('PROMO BRUSHED', 'STANDARD BRUSHED') or gene_type like 'S%'").select("gene_type").distinct().collect()]  # an enumeration
    return genes(spark).tss(gene_type=kinds).select("name", "chrom", F.col("start").alias("s"), F.col("end").alias("e"))


@query("""select 'Transcripts' as feature, count(*) + 1 as n from genes_v union all select 'Exons', count(*) + 2 from exons_v
union all select 'CDS', count(*) + 1 from genes_v union all select 'UTR', 2*count(*) + 1 from genes_v""", "genes_v", "numbers3", "exons_v")
def genes_added(spark):
    g = genes(spark)
    row = lambda kind, s, e: ("G1", "Tnew", kind, 1, "5'" if kind == "UTR" else None, "chr1", s, e, "+", 0)
    more = spark.createDataFrame([row("exon", 1, 5), row("exon", 9, 12), row("CDS", 2, 4), row("UTR", 1, 2)], g.features.schema)
    known = g.transcripts.limit(1)  # a transcript of a known id replaces it
    new = spark.createDataFrame([("Tnew", "G1", "chr1", 1, 12, "+", 0)], g.transcripts.schema)
    return g.add_features(more).add_transcripts(new).add_transcripts(known).table()


_TSS = "(select chrom, greatest(0, s - 1000) as s, e + 1000 as e, first as ord from (select chrom, case strand when '+' then s else e end as s, case strand when '+' then s + 1 else e - 1 end as e, row_number() over (partition by gene_name order by ord desc) as k, min(ord) over (partition by gene_name) as first from genes_v) where k = 1)"


@query("select x.ord, g.gene_name as name, x.distance from (" + _NEAREST.format(cols="c.ord_b, c.distance", left="loci_a", right=_TSS) + ") x join genes_v g on g.ord = x.ord_b", "loci_a", "genes_v")
def genes_nearest_names(spark):
    own = a(spark)
    out = genes(spark).nearest_genes(own)
    place = own.df.select(uid().alias("Name"), "ord")
    return out.dropDuplicates(["Name"]).join(place, "Name").select("ord", F.col("Name_b").alias("name"), F.col("Distance").alias("distance"))


@query("select chrom1, s1, e1, chrom2, s2, e2, row_number() over (order by loop_id) - 1 as pos from loops_v", "loops_v")
def bedpe_file(spark):
    path = f"{folder(spark)}/own.bedpe"
    text.write_lines(spark.table("loops_v").selectExpr("concat_ws('\t', chrom1, s1, e1, chrom2, s2, e2) as value", "loop_id as ord"), path)
    rows = text.read_bedpe(spark, path).selectExpr("chrom1", "start1 as s1", "end1 as e1", "chrom2", "start2 as s2", "end2 as e2", "loop_id")
    return placed(rows, "loop_id", "pos").drop("loop_id")


@query("select concat('g', gene_id) as name, repeat('ACGT', (ord % 50)::int + 1) as seq from genes_v", "genes_v")
def fasta_lines(spark):
    g = spark.table("genes_v").select(F.col("ord"), F.concat(F.lit(">g"), "gene_id", F.lit(" about")).alias("head"), F.expr("repeat('ACGT', cast(ord % 50 + 1 as int))").alias("seq"))
    first = g.select(F.col("head").alias("value"), (F.col("ord") * 10).alias("ord"))
    half = F.floor(F.length("seq") / 2).cast("int")
    one = g.select(F.substring("seq", F.lit(1), half).alias("value"), (F.col("ord") * 10 + 1).alias("ord"))
    two = g.select(F.substring("seq", half + 1, F.length("seq")).alias("value"), (F.col("ord") * 10 + 2).alias("ord"))
    return text.parse_fasta(first.unionByName(one).unionByName(two)).select("name", "seq")


_JASPAR = ">M1 first\nA [ 9 0 1 ]\nC [ 0 9 1 ]\nG [ 0 0 9 ]\nT [ 1 0 0 ]\n>M2 second\nA 4 4\nC 1 0\nG 0 1\nT 2 2\n"


@query("select * from (values ('first', 0, 9.0::double, 0.0::double, 0.0::double, 1.0::double), ('first', 1, 0.0, 9.0, 0.0, 0.0), ('first', 2, 1.0, 1.0, 9.0, 0.0), ('second', 0, 4.0, 1.0, 0.0, 2.0), ('second', 1, 4.0, 0.0, 1.0, 2.0)) t(motif, pos, a, c, g, t)")
def motif_file(spark):
    path = f"{folder(spark)}/m.jaspar"
    spark.createDataFrame([(_JASPAR,)], "value string").coalesce(1).write.text(path)
    rows = [(name, i, *map(float, col)) for name, counts in text.read_motifs(spark, path) for i, col in enumerate(counts)]
    return spark.createDataFrame(rows, "motif string, pos int, a double, c double, g double, t double")


_CELLS = "select least(b1, b2) as bin1_id, greatest(b1, b2) as bin2_id, count(*)::double as count from (select cast(substr(chrom1, 4) as bigint)*1000000 + ((s1+e1)//2)//5000 as b1, cast(substr(chrom2, 4) as bigint)*1000000 + ((s2+e2)//2)//5000 as b2 from loops_v) group by 1, 2"


@query(_CELLS, "loops_v")
def matrix_files(spark):
    root, (bins, pixels) = folder(spark), matrix(spark)
    for name, df in (("bins", bins), ("pixels", pixels)):
        df.write.option("header", True).option("sep", "\t").csv(f"{root}/resolutions/5000/{name}.tsv")
    return matrices.read_matrix(spark, root, 5000)[1]


# graphs
def _on_edges(sql: str) -> str:
    """A query over `edges` without loops to themselves."""
    return "select * from (" + _graph("").replace("edges as (", "every as (", 1).rstrip() + ", edges as (select * from every where uid1 <> uid2) " + sql + ")"


@query(_on_edges("select uid, uid in (select uid1 from edges union all select uid2 from edges) as there from (select min(uid1) as uid from edges union all select max(uid2) from edges union all select 'chr9:1-2(.)')"), *_E)
def graph_contains(spark):
    g = architecture(spark)[0]
    low, high = g.edges.agg(F.min("uid1"), F.max("uid2")).first()
    return spark.createDataFrame([(u, g.contains(u)) for u in (low, high, "chr9:1-2(.)")], "uid string, there boolean")


@query(_on_edges("select loop_id, ord1, ord2, uid1, uid2, 0.0::double as w, null::double as n, null::double as d from edges"), *_E)
def graph_copy(spark):
    return architecture(spark)[0].copy().edges


@query("select 0 as total, 0 as links")
def graph_empty(spark):
    g = Architecture.empty(spark)
    return spark.createDataFrame([(g.n_loci(), g.n_links())], "total int, links int")


@query("select 'Architecture(name=Skeleton, properties=[''w'', ''n'', ''d''])' as said")
def graph_repr(spark):
    return spark.createDataFrame([(repr(architecture(spark)[0]),)], "said string")


@query(_on_edges("""select u, v, loop_id is not null as there, w from (select distinct uid2 as u, uid1 as v from edges where ord1 % 3 = 0)
left join (select least(uid1, uid2) as lo, greatest(uid1, uid2) as hi, any_value(loop_id) as loop_id, 0.0::double as w from edges group by 1, 2) on lo = least(u, v) and hi = greatest(u, v)"""), *_E)
def graph_lookup(spark):
    g = architecture(spark)[0]
    asked = g.edges.where("ord1 % 3 = 0").select(F.col("uid2").alias("u"), F.col("uid1").alias("v")).distinct()
    return asked.join(g.lookup(asked), ["u", "v"], "left").select("u", "v", F.col("w").isNotNull().alias("there"), "w")


_WAYS = "ways as (select uid1 as u, uid2 as v from edges union select uid2, uid1 from edges)"


@query(_on_edges(f", {_WAYS}, reach as (select u, u as r from (select distinct u from ways) union select reach.u, ways.v from reach join ways on ways.u = reach.r) select u as uid, min(r) as component from reach group by u").replace("select * from (with ", "select * from (with recursive ", 1).replace(" , ways", ", ways", 1), *_E)
def graph_components(spark):
    return architecture(spark)[0].components()


@query(_on_edges(f""", {_WAYS}, src as (select distinct u as source from ways where u like 'chr1:1%'),
h1 as (select distinct source, v as uid from src join ways on u = source), h2 as (select distinct source, v as uid from h1 join ways on u = h1.uid)
select source, uid, min(hops) as hops from (select source, source as uid, 0 as hops from src union all select source, uid, 1 from h1 union all select source, uid, 2 from h2) group by 1, 2""").replace(" , ways", ", ways", 1), *_E)
def graph_within(spark):
    g = architecture(spark)[0]
    return g.within(g.vertices().where("uid like 'chr1:1%'"), 2)


def _fit_sql() -> str:
    """The search of powerlaw.fit on `weighed`, round by round."""
    parts = [", pts as (select cast(abs(p1 - p2) as double) as d, w from weighed where c1 = c2 and w > 0 and p1 <> p2), sums as (select d, count(*) as m, sum(w) as s from pts group by d)",
             "l as (select sum(m * ln(d)) / sum(m) as l from sums), ld as (select m, s, ln(d) - l as x from sums, l)",
             "r0 as (select -regr_slope(log10(w), log10(d)) as alpha, 0.05::double as step from pts)"]
    for k in range(7):
        parts.append(f"t{k} as (select i, alpha + step * (i - 20) as al, step, sum(s * exp(-(alpha + step * (i - 20)) * x)) as top, sum(m * exp(-2 * (alpha + step * (i - 20)) * x)) as bottom from r{k}, (select unnest(range(41)) as i), ld group by i, alpha, step)")
        parts.append(f"r{k + 1} as (select al as alpha, case when i > 0 and i < 40 then step * 4 / 40 else step end as step, top / bottom as c from t{k} order by top * top / bottom desc limit 1)")
    parts.append("model as (select alpha, c * exp(alpha * l) as c from r7, l)")
    return ", ".join(parts)


@query("select * from (with " + _WEIGHTS[2:] + _fit_sql() + " select round(alpha, 4) as alpha, round(c, 2) as c from model)", *_E)
def powerlaw_fit(spark):
    g, own = architecture(spark)
    out = g.add_matrix(own, *matrix(spark)).with_distance(own)
    c, alpha = powerlaw.fit(out.edges.select("d", "w"))
    return spark.createDataFrame([(round(alpha, 4), round(c, 2))], "alpha double, c double")


@query("select * from (with " + _WEIGHTS[2:] + _fit_sql() + """ select loop_id, ord1, ord2, round(w, 6) as w, case when c1 = c2 then cast(abs(p1 - p2) as double) end as d,
case when c1 <> c2 then null when p1 = p2 then 0.0 else round(w / greatest(c * pow(cast(abs(p1 - p2) as double), -alpha), 1e-12), 1) end as n from weighed, model)""", *_E)
def contacts_normalized(spark):
    g, own = architecture(spark)
    out = g.add_matrix(own, *matrix(spark)).normalize(own).edges
    return out.select("loop_id", "ord1", "ord2", F.round("w", 6).alias("w"), "d", F.round("n", 1).alias("n"))


# signal
_VALUES = {"sum": "sum(value*o)", "coverage": "sum(o) / any_value(width)::double", "std": "case when sum(o) > 1 then sqrt(greatest(0.0, sum(value*value*o) - sum(o) * (sum(value*o)/sum(o)) * (sum(value*o)/sum(o))) / (sum(o) - 1)) else 0.0 end"}


def _statistic_sql(agg: str, n: int = 5) -> str:
    return f"""select d.ord, d.track, d.bin, round(cast(cast(coalesce(v, 0.0) as float) as double), 2) as value
from (select ord, track, i as bin from anchors_v cross join (select distinct track from track_v) cross join numbers20 where i < {n}) d
left join (select ord, track, bin, {_VALUES[agg]} as v from (select x.ord, t.track, x.bin, t.value, x.be - x.bs as width, least(x.be, t.e) - greatest(x.bs, t.s) as o from ({_bins_sql(True, n)}) x join track_v t on x.chrom = t.chrom and x.bs < t.e and t.s < x.be) group by 1, 2, 3) m
on d.ord = m.ord and d.track = m.track and d.bin = m.bin"""


def _statistic_query(agg: str) -> None:
    def f(spark: SparkSession) -> DataFrame:
        out = Loci(loci(spark, "anchors_v")).signal(*tracks(spark), n_bins=5, agg=agg, span=True)
        return out.select("ord", "track", "bin", F.round(F.col("value").cast("double"), 2).alias("value"))

    f.__name__ = f"signal_span_{agg}"
    query(_statistic_sql(agg), *_SIG)(f)


for _agg in _VALUES:
    _statistic_query(_agg)


@query("select -1 as ord, track, i as bin, 0.0::double as value from (select distinct track from track_v) cross join numbers20 where i < 4 union all select * from ("
       + _signal_sql("max", True, 4) + ")", *_SIG)
def signal_unknown_chrom(spark):
    odd = spark.createDataFrame([("chrUn", 5, 90, "+", -1)], "chrom string, s long, e long, strand string, ord long").selectExpr("chrom", "s as start", "e as end", "strand", "ord")
    own = Loci(loci(spark, "anchors_v").unionByName(odd))
    return own.signal(*tracks(spark), n_bins=4, agg="max", span=True).select("ord", "track", "bin", F.round(F.col("value").cast("double"), 2).alias("value"))


_MAX = _signal_sql("max", True, 5).replace("round(coalesce(v, 0.0), 2)", "cast(coalesce(v, 0.0) as float)")


@query(f"""with v as ({_MAX}), o as (select ord, row_number() over (order by sum(value::decimal(18, 6)) desc, ord desc) - 1 as place from v group by ord)
select strand as "set", track, v.ord, place, bin, round(least(value::double, case track when 't0' then 20 when 't1' then 30 else 40 end), 2) as value from v join o using (ord) join (select ord, strand from anchors_v) s using (ord)""", *_SIG)
def signal_heatmap(spark):
    own = Loci(loci(spark, "anchors_v"))
    values = own.signal(*tracks(spark), n_bins=5, agg="max", span=True).withColumn("value", F.col("value").cast("decimal(18,6)"))
    out = own.heatmap_frame(values, own.df.select("ord", F.col("strand").alias("set")), limit=[20, 30, 40])
    return out.select("set", "track", "ord", "place", "bin", F.round(F.col("value").cast("double"), 2).alias("value"))


# tags
@query(f"""with u as (select distinct {UID} as uid from loci_a), k as (select uid from u order by uid limit 20)
select 'few' as tag, 'set' as kind, count(*) as n from k union all select 'loci', 'set', count(distinct {UID}) from loci_a where strand = '-'
union all select 'numbers', 'mapping', count(*) from k union all select 'words', 'mapping', count(*) from u""", "loci_a")
def tags_payloads(spark):
    x = a(spark)
    known = x.df.select(uid().alias("uid")).distinct()
    few = [r[0] for r in known.orderBy("uid").limit(20).collect()]
    t = x.map({"few": few, "loci": x.filter("strand = '-'"), "numbers": {u: i for i, u in enumerate(few)}, "words": known.withColumn("value", F.lit("w"))})
    return t.table()


@query(f"select {UID} as uid, try_cast(v as double) as num, case when try_cast(v as double) is null then v end as str from (select {UID} as uid0, any_value(chrom) as chrom, max(s) as s, max(e) as e, any_value(strand) as strand, case when max(s) % 7 = 0 then 'low' else cast(max(e) % 100 as varchar) end as v from loci_a group by 1)", "loci_a")
def tags_values(spark):
    seen = []
    t = tags(spark)
    t.query(lambda x: seen.append(x.atac) or x.se)
    return seen[0].items()


@query(f"select distinct {UID} as uid, (select count(distinct {UID}) from loci_a where strand = '+' and chrom = 'chr2') as n from loci_a where strand = '+' and chrom = 'chr2'", "loci_a")
def tags_selection(spark):
    seen = []
    tags(spark).query(lambda x: seen.append(x.se & x.chr2) or x.se)
    return seen[0].uids().withColumn("n", F.lit(len(seen[0])).cast("long"))


@query("select * from (values ('SE', 'H3K27ac-SE'), ('chr2 PEAKS', 'chr2 peaks'), ('atac', 'atac'), ('peaks', 'chr2 peaks'), ('none', 'AttributeError')) t(asked, found)")
def tags_names(spark):
    t = tags(spark)
    rows = []
    for name in ("SE", "chr2 PEAKS", "atac", "peaks", "none"):
        try:
            rows.append((name, t.resolve(name)))
        except AttributeError:
            rows.append((name, "AttributeError"))
    return spark.createDataFrame(rows, "asked string, found string")


@query("""select * from (values ('value alone', 'ValueError'), ('pending', 'ValueError'), ('value & value', 'TypeError'), ('selection | value', 'TypeError'),
('selection - value', 'TypeError'), ('number', 'TypeError'), ('unknown name', 'AttributeError'), ('unknown uid', 'KeyError'), ('no mapping', 'TypeError'), ('no tag', 'TypeError')) t(what, error)""")
def tags_errors(spark):
    t = tags(spark)
    cases = {
        "value alone": lambda: t.query(lambda x: x.atac), "pending": lambda: t.query(lambda x: x.se & x.atac), "value & value": lambda: t.query(lambda x: x.atac & x.atac),
        "selection | value": lambda: t.query(lambda x: x.se | x.atac), "selection - value": lambda: t.query(lambda x: x.se - x.atac), "number": lambda: t.query(lambda x: 3),
        "unknown name": lambda: t.query(lambda x: x.nothing), "unknown uid": lambda: t.loci.map({"t": ["no"]}), "no mapping": lambda: t.add([1]), "no tag": lambda: t.add({"t": 3}),
    }
    rows = []
    for what, f in cases.items():
        try:
            f()
            rows.append((what, "none"))
        except (ValueError, TypeError, AttributeError, KeyError) as error:
            rows.append((what, type(error).__name__))
    return spark.createDataFrame(rows, "what string, error string")


@query(f"select chrom, s, e, strand, ord from loci_a a where exists (select 1 from loci_b b where {OVERLAP})", "loci_a", "loci_b")
def loci_tag_overlap(spark):
    return plain(a(spark).tag(b(spark), "hit", mode="overlap").query(lambda x: x.hit).df)


@query("select kind, name from (values ('tags', 'H3K27ac-SE'), ('tags', 'again')) t(kind, name) union all select 'n', cast(count(distinct concat(chrom, ':', s, '-', e, '(', strand, ')')) as varchar) from loci_a where chrom = 'chr3'", "loci_a")
def tags_replaced(spark):
    x = a(spark)
    own = lambda c: x.df.where(F.col("chrom") == c).select(uid().alias("uid"))
    t = Tags.make(x).add({"H3K27ac-SE": own("chr2"), "again": own("chr1")}).add({"again": own("chr3")})
    n = t["again"].count()
    return spark.createDataFrame([*(("tags", k) for k in t.keys()), ("n", str(n))], "kind string, name string")
