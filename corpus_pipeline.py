"""The corpus pipeline: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``.

Stages take any other columns along.  Null or empty texts are scored as texts
without features, are linked with nothing, lose nothing and are packed as one
end mark; repeated rows are copies; an empty table passes through empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.ngram_join import shingle_components
from millrace.llm.packing import pack_documents
from millrace.llm.quality import keep_good
from millrace.llm.substring_dedup import dedup_words
from millrace.sources.files import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by similarity: the one with the least identifier.

    Rows without an identifier all stay; those with one in their group are
    reduced all the same.  Rows that share an identifier are reduced among
    themselves if their texts are linked; a different text under the same
    identifier is a document of its own.  Of several that could stay, the row
    with the least hash does.
    """
    groups = shingle_components(docs)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    one, group = F.lit(None).cast("long"), "__group"
    kept = kept.withColumns({"__text": text, "__row": F.xxhash64(*docs.columns)})
    # identifiers with several texts: their texts are grouped by similarity, too
    several = docs.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high")).filter("low <> high").select("doc_id")
    if several.isEmpty():
        kept = kept.withColumn(group, one)
    else:
        own = docs.join(several, "doc_id", "left_semi").select(text.alias("doc_id"), "text")
        found = shingle_components(own).select(F.col("doc_id").alias("__text"), F.col("component_id").alias(group)).distinct()
        kept = kept.join(found, "__text", "left")
    nth = F.row_number().over(Window.partitionBy("doc_id", group).orderBy("__text", "__row"))
    named = kept.filter(F.col("doc_id").isNotNull()).withColumn("__nth", nth).filter("__nth = 1")
    return kept.filter(F.col("doc_id").isNull()).select(docs.columns).union(named.select(docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 35-word windows that repeat; a text that loses nothing stays as it was, white space included."""
    made = dedup_words(docs)
    cut = F.col("removed.n_removed") > 0
    text = F.when(cut, F.col("removed.kept")).otherwise(F.col("text"))
    out = made.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts packed into sequences of 2048 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: No SQL: the classifier and the tokenizer can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what is between them is written to the shared folder that the session names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
