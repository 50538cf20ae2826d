"""The queries opN_<name>: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, katz, langid, media_query, mixing, neardup, quality, sharding, styletree, token_files
from .common import chance, n_blank_words, shared_dir, stored, table


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words; a document is contaminated from 5 % of its words on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text").drop("text")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `bytes`: 16 shards of nearly equal bytes from 4,096 virtual slots and a stored map."""
    at = shared_dir(spark)
    cut = stored(sharding.chunks(table(spark, sf_dir, "documents"), "doc_id", "text"), f"{at}/chunks")
    sums = stored(sharding.slot_bytes(cut), f"{at}/sums")  # a row per virtual slot
    slot_map = sharding.store_map(sharding.first_map(sums, 16), f"{at}/map", 1)
    numbered = sharding.number_rows(sharding.assign(cut, slot_map), sums, slot_map)
    return numbered.select(
        F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def _remainder(key: str, n: int):
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from text and lang of the documents that aren't held out."""
    return langid.train(docs.filter(_remainder("doc_id", 5) != 0), "text", "lang", "doc_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), "text", language_model(docs))
    return found.select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz bigram model of six sevenths of the documents, scoring all of them."""
    docs = table(spark, sf_dir, "documents").withColumn("train", _remainder("doc_id", 7) != 2)
    rows, tokens = katz.score(docs, "doc_id", "text", "train")
    return rows.select(
        F.col("key").alias("doc_id"), (_remainder("key", 7) == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def mix_documents(spark: SparkSession, docs: DataFrame, *more: str) -> DataFrame:
    """Sizes, quotas and taken tokens of documents (doc_id, source, text, and small columns to keep)."""
    sized = docs.select("doc_id", "source", *more, n_blank_words(F.col("text")).alias("size"))
    targeted = stored(mixing.targets(mixing.weights(mixing.source_sizes(sized))), shared_dir(spark))  # one row per source
    return mixing.mix(sized, "doc_id", stored(mixing.quotas(targeted, mixing.block_plan(targeted)), shared_dir(spark)), ties=more)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1, ...; targets stop at three times the source."""
    return mix_documents(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "parts")


def tokenizer_path() -> str:
    """The file of the byte-level tokenizer; a parameter of the operator, never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Writes the token files of documents (doc_id, text) and reads them back: a row per document."""
    at = shared_dir(spark)
    how, cuts = token_files.form(tokenizer_path()), token_files.cuts(docs, "doc_id", "text", spark.sparkContext.defaultParallelism)
    tokens = token_files.encoded(docs, "doc_id", "text", tokenizer_path, 0, cuts, how)
    index = stored(token_files.write_files(tokens, f"{at}/tokens", len(cuts) + 1, how.wide), f"{at}/index")
    read = token_files.read_back(index, f"{at}/tokens").join(F.broadcast(token_files.starts(index)), "part")  # a row per file
    return read.select(F.col("key").alias("doc_id"), (F.col("ahead") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32", "part")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids with end id 0, in Arrow files of 2,048-token sequences."""
    return token_rows(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.75 or more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of every document; source is the host, source and language the path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = ["quality", "toxic"]
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(*[F.max(c).alias(f"{c}_known") for c in labels])
    known = stored(known.dropna("all", subset=[f"{c}_known" for c in labels]), shared_dir(spark))
    share = quality.SAMPLE / max(1, known.count())
    drawn = known.filter(chance(F.xxhash64("doc_id")) < share)  # about SAMPLE rows: broadcast
    labelled = stored(docs.join(F.broadcast(drawn), "doc_id").select("text", *[F.col(f"{c}_known").alias(c) for c in labels]), shared_dir(spark))
    scored = stored(quality.classify(docs.withColumn("path", F.concat_ws("/", "source", "lang")).drop("lang"), "text", quality.train(labelled, "text", labels)), shared_dir(spark))
    found = quality.posteriors(scored.join(known, "doc_id", "left"), "source", "path", labels)
    return found.select("doc_id", "quality", "toxic", ((F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)).alias("kept"), "p_quality", "p_toxic")


def op10_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by its host's style tree."""
    return styletree.extract_pages(table(spark, sf_dir, "pages"), "url", "html").select("page_id", "url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_tiff_pages": media_query.op1_tiff_pages,
        "op2_winnowing": op2_winnowing,
        "op3_sharding": op3_sharding,
        "op4_language": op4_language,
        "op5_katz": op5_katz,
        "op6_mixing": op6_mixing,
        "op7_token_files": op7_token_files,
        "op8_neardup": op8_neardup,
        "op9_quality": op9_quality,
        "op10_site_style": op10_site_style,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_winnowing": decontaminate.ORACLE, "op8_neardup": neardup.ORACLE}
