"""A training-data pipeline over `documents`: STAGES in order, each on all that the one before kept.

toxicity: documents that the chain scores 0.5 or more go. near_duplicates: of each group
linked by the n-gram Jaccard join the document of the smallest id stays (of its rows with
that id, the smallest text). benchmark: documents with windows of two benchmark items or more
go. secrets: spans of live-looking values (few owners and repositories) are replaced by a mark. packing: what is left
becomes token sequences.

All but the last stage return the columns of `documents`; a stage on an empty table returns
an empty one. Null texts are clean, have no near copies and pack as the end token.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.llm import decontaminate, jaccard, packing, secrets, toxicity
from spanloom.llm.shared import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MARK = "[secret]"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is under 0.5. The chain learns from the labelled documents among `docs`."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.filter_documents(docs.select(*COLUMNS), chain, 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: that of component_id. Rows without an id stay, and so do rows without words."""
    rows = jaccard.jaccard_groups(docs)
    gone = rows.where("component_id <> doc_id").select("doc_id").distinct()
    again = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)
    left = docs.select(*COLUMNS).join(gone.union(again), "doc_id", "left_anti")
    # rows of an id that names several are judged each by its own group, of which the first stays
    nodes = rows.where("node is not null").select("node", "comp", "component_id").distinct()
    own = jaccard.with_nodes(docs.select(*COLUMNS).join(again, "doc_id", "left_semi")).join(nodes, "node", "left")
    first = own.where("component_id = doc_id").withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "comp").orderBy("text", "source"))).where("k = 1")
    return left.select(*COLUMNS).unionByName(own.where("node is null").select(*COLUMNS)).unionByName(first.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated: windows of at most one item occur in them."""
    return decontaminate.filter_documents(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 2)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the spans of live-looking values replaced by MARK, and n_chars of what is then there."""
    return secrets.redact(docs.select(*COLUMNS), MARK)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids as little-endian unsigned 32-bit integers."""
    out = packing.pack(docs, packing.default_tokenizer())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group", "ids")


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", redact), ("packing", pack)]
#: Learned scores, components and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from `documents`; each result but the last is written and read again."""
    root = f"{shared_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
