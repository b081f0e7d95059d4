"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import chat, collocations, hashing, langid, linededup, media, minhash, mixing, packing, quality, tokencount, toxicity, whitening
from riskloom.llm.base import table

Query = Callable[[SparkSession, str], DataFrame]

#: Weights by level: domain, language, source; names that aren't listed weigh 1.
MIX_WEIGHTS = ({"domain0": 0.5, "domain1": 0.3, "domain2": 0.2}, {"en": 2.0}, {})


def domain_of_source():
    """The documents carry no domain: sources are dealt to three by a hash."""
    return F.concat(F.lit("domain"), F.crc32(F.coalesce("source", F.lit(""))) % 3)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("clean_text")


def op2_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_identify(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    size = F.length(F.coalesce("text", F.lit("")))
    return out.select("doc_id", "n_deleted", size.cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.render(chat.reconstruct(chat.turn_events(turns.unionByName(extra)))))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = mixing.mix(table(spark, sf_dir, "documents"), domain_of_source(), MIX_WEIGHTS)
    return picked.select("row.doc_id", "domain", "row.lang", "row.source", "epoch", "n_tokens")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens_once(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf_dir, "embeddings"))


def op13_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.ORACLE, "op7_chat_formatting": chat.ORACLE, "op11_collocations": collocations.ORACLE}
