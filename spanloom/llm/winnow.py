"""Document fingerprints by winnowing (operator 9), with DataFrame functions only.

The words of a text (runs without white space) give rolling 5-word hashes; of every
window of 8 consecutive hashes the smallest is chosen, the rightmost of equal ones,
and kept with its position. Two texts that share 12 consecutive words share a chosen
hash. A text of fewer than 5 words has one hash over all of them; one of fewer than 8
hashes is one window.

Window minima are taken by doubling (2, 4, 8) over shifted arrays, so a text costs a
fixed number of passes. A candidate is one long: 33 bits of the hash, then 30 bits
that fall as the position rises, so that the smallest is also the rightmost.

Defined cases: null text is empty and has an empty fingerprint; likeness of two empty
fingerprints is 1, of an empty and another 0; rows of one doc_id share the next larger
doc_id's text (of several, the smallest text), rows without an id have no next text
(empty); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm.shared import Workspace, documents

_POSITION = (1 << 30) - 1


def _pairs(a: Column, distance: int, f) -> Column:
    """f of each element and the one `distance` after it."""
    n = F.greatest(F.size(a) - distance, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, distance + 1, n), f)


def words_of(text: Column) -> Column:
    """Runs without white space of the text, A-Z lower-cased."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\f\r", "abcdefghijklmnopqrstuvwxyz     ")
    return F.filter(F.split(lower, " "), lambda w: w != "")


def with_fingerprint(df: DataFrame, text: str, name: str, w: int = 8) -> DataFrame:
    """Adds `name`: array of (hash, position), in order of position. w: hashes a window, a power of two.

    Each step is a column of its own: Spark keeps a column that is used more than once apart,
    so nothing is evaluated twice.
    """
    x, empty = f"__{name}", F.array().cast("array<bigint>")
    join = lambda a, b: F.xxhash64(a, b)
    least = lambda a, b: F.least(a, b)
    out = df.withColumn(x, words_of(F.col(text)))
    out = out.withColumn(f"{x}_1", F.transform(x, lambda v: F.xxhash64(v)))
    out = out.withColumn(f"{x}_2", _pairs(F.col(f"{x}_1"), 1, join))
    out = out.withColumn(f"{x}_4", _pairs(F.col(f"{x}_2"), 2, join))
    n = F.greatest(F.size(f"{x}_1") - 4, F.lit(0))
    five = F.zip_with(F.slice(f"{x}_4", 1, n), F.slice(f"{x}_1", 5, n), join)
    whole = F.array(F.xxhash64(F.array_join(x, " ")))
    out = out.withColumn(f"{x}_h", F.when(F.size(x) >= 5, five).when(F.size(x) > 0, whole).otherwise(empty))
    pack = lambda v, i: F.shiftleft(F.shiftrightunsigned(v, 31), 30).bitwiseOR(F.lit(_POSITION) - i)
    out = out.withColumn(f"{x}_p", F.transform(f"{x}_h", pack))
    out, d = out.withColumn(f"{x}_m1", F.col(f"{x}_p")), 1
    while d < w:
        out, d = out.withColumn(f"{x}_m{2 * d}", _pairs(F.col(f"{x}_m{d}"), d, least)), 2 * d
    few = F.array(F.array_min(f"{x}_p"))
    out = out.withColumn(f"{x}_s", F.when(F.size(f"{x}_p") >= w, F.array_distinct(f"{x}_m{w}")).when(F.size(f"{x}_p") > 0, few).otherwise(empty))
    at = lambda v: (F.lit(_POSITION) - v.bitwiseAND(_POSITION)).cast("int")
    out = out.withColumn(name, F.transform(f"{x}_s", lambda v: F.struct(F.element_at(f"{x}_h", at(v) + 1).alias("hash"), at(v).alias("position"))))
    return out.drop(*[c for c in out.columns if c.startswith(x)])


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of the hashes of two fingerprints."""
    x, y = F.array_distinct(F.transform(a, lambda s: s["hash"])), F.array_distinct(F.transform(b, lambda s: s["hash"]))
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / F.greatest(union, F.lit(1)))


def shown(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda s: F.concat_ws(":", F.hex(s["hash"]), s["position"])), ",")


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ids in ascending order, the last followed by the first.

    The ids are dealt to ranges of equal size, whatever their values, and written with their range;
    only a range's last id looks for the first of the next range, one row a range.
    """
    keys = ids.where("doc_id is not null").select(F.col("doc_id").alias("key")).distinct()
    keys = Workspace(ids.sparkSession).table(keys.repartitionByRange("key").select("key", F.spark_partition_id().alias("part")), "ids")
    own = keys.withColumn("after", F.lead("key").over(Window.partitionBy("part").orderBy("key")))
    firsts = keys.groupBy("part").agg(F.min("key").alias("first"))
    order = Window.orderBy("part")
    firsts = firsts.select("part", F.lead("first").over(order).alias("further"), F.min("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("smallest"))
    return own.join(firsts, "part").select(F.col("key").alias("doc_id"), F.coalesce("after", "further", "smallest").alias("next_id"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text. Texts are shuffled by id, and from that same exchange lent to the id before.

    Both uses of the texts are the bare columns under the same filter, or Spark would shuffle them twice.
    """
    if dict(docs.dtypes)["doc_id"] != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    docs = docs.select("doc_id", "text")
    known, unknown = docs.where("doc_id is not null"), docs.where("doc_id is null")
    before = next_ids(docs.select("doc_id")).select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("asked_by"))
    lent = known.join(before, "doc_id").select("asked_by", F.col("text").alias("next_text"))
    one = lent.withColumn("k", F.row_number().over(Window.partitionBy("asked_by").orderBy("next_text"))).where("k = 1")
    out = known.join(one, known["doc_id"] == one["asked_by"], "left").select("doc_id", "text", "next_text")
    out = out.unionByName(unknown.withColumn("next_text", F.lit("")))
    return out.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("next_text", F.lit("")).alias("next_text"))


def fingerprints(docs: DataFrame, w: int = 8) -> DataFrame:
    """Fingerprints `doc_id, text` rows: doc_id, text, fingerprint (array of (hash, position))."""
    return with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "text", "fingerprint", w)


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = with_next(documents(spark, sf_dir)).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    out = with_fingerprint(pairs.withColumn("edited", edited), "text", "own")
    out = with_fingerprint(with_fingerprint(out, "edited", "changed"), "next_text", "next")
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
