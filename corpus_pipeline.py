"""Documents to token files in five stages; each works on all that the one before kept.

Stages take (spark, docs, sf_dir) and give documents (the same columns), the last one a row per document
from the token files. Between stages `run` writes Parquet to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import decontaminate, langid, neardup, registry
from rillflow.llm.common import remove, scratch, shared_dir, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a single letter, empty and null texts among them, go."""
    found = langid.identify(docs.withColumnRenamed("lang", "lang_given"), "text", registry.language_model(docs), spans=False)
    return found.filter("lang_pred <> 'und'").withColumnRenamed("lang_given", "lang").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, one row for an id and text.

    Null and empty texts and null ids have no copies and stay; texts under one id are one document.
    """
    found = stored(neardup.near_duplicates(docs, "doc_id", "text"), shared_dir(spark))
    if not found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        docs = docs.filter("doc_id is null").unionByName(docs.filter("doc_id is not null").withColumn("t_", F.xxhash64(F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "t_"]).drop("t_"))
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    few = gone.count() <= neardup.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate; with an empty benchmark all. Repeated rows are judged alike."""
    judged = decontaminate.decontaminate(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return judged.filter(~F.col("contaminated")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes its words, to the nearest whole time; all but one of a source are taken whole.

    Texts without words (null, empty, blank) have no size and go. Rows of equal id and text are taken as
    often as the most taken of them; ties in the mix's order (equal id and size) are ordered by the text's hash.
    """
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    small = docs.select("doc_id", "source", "text", mark.alias("mark"))
    taken = registry.mix_documents(spark, small, "mark").groupBy("doc_id", "mark").agg(F.max("taken").alias("taken"), F.max("size").alias("size"))
    times = taken.filter("size > 0").select(F.col("doc_id").alias("d_"), F.col("mark").alias("m_"), F.round(F.col("taken") / F.col("size")).cast("int").alias("times")).filter("times > 0")
    kept = docs.withColumn("mark_", mark).join(times, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("mark_") == F.col("m_")))
    return kept.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places and checks in the token files; rows of equal id are ordered by their text's hash."""
    return registry.token_rows(spark, docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("mix", mix),
    ("tokens", tokens),
]
#: Learned models, links and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = shared_dir(spark)
        if name == STAGES[-1][0]:
            return stored(stage(spark, docs, sf_dir), at)  # its token files stay
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), at)
        if last:
            remove(spark, last)
        last = at
    return docs
