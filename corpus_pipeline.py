"""A cleaning pipeline for training documents: toxicity, line dedup, near-duplicates, packing.

Each stage is a function of (spark, docs, sf_dir).  What it returns is written as Parquet and read again as the next
one's docs; all stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgraph.llm.common import saved, table, work_dir
from textgraph.llm.line_dedup import dedup_lines
from textgraph.llm.near_dedup import near_groups
from textgraph.llm.packing import packing_digest
from textgraph.llm.queries import tokenizer
from textgraph.llm.toxicity import score_documents, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model predicts to be toxic go.  It is learnt from the labels of documents that are here.

    Null and empty texts stay; rows without an id are scored like others; repeated rows go or stay together.
    """
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.filter("predicted = 0").select(*docs.columns)


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut; documents left without words go.

    Rows without an id or a text stay as they are, and rows of equal id aren't compared with each other.
    """
    kept = dedup_lines(docs)
    return kept.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five words, a similarity of 0.8) the document of the smallest id stays.

    Rows are told apart by id and text, so a row stays if another row of its id goes.  Of rows of equal id in one group
    that of the smallest text hash stays, and of rows of equal id and text one.  Rows without words or id all stay.
    """
    found = near_groups(docs, 80).filter("group is not null").select("group", F.struct("doc_id", "of").alias("row"))
    least = found.groupBy("group").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("rows"))
    gone = found.join(least.filter("rows > 1"), "group").filter(F.col("row") != F.col("least")).select("row.doc_id", F.col("row.of").alias("_of")).distinct()
    kept = docs.withColumn("_of", F.xxhash64("text")).join(gone, ["doc_id", "_of"], "left_anti")
    twice = found.groupBy("row").count().filter("count > 1").select("row.doc_id", F.col("row.of").alias("_of"))
    if twice.head(1):
        repeated = kept.join(twice, ["doc_id", "_of"], "left_semi").select(*kept.columns).dropDuplicates(["doc_id", "_of"])
        kept = kept.join(twice, ["doc_id", "_of"], "left_anti").select(*kept.columns).unionByName(repeated)
    return kept.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 2048 tokens; every row is packed."""
    return packing_digest(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_shared_passages),
    ("near_dedup", keep_one_of_each_group),
    ("packing", pack),
]

#: The stages learn, align, hash and tokenize: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over all documents."""
    folder = work_dir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{i}-{name}")
    return docs
