"""The registered queries: each applies one operator with production parameters to its whole table."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from persona_spark.llm.common import read
from persona_spark.llm.chat_format import digest, expand_examples
from persona_spark.llm.chunk_bpe import chunk_bpe
from persona_spark.llm.collision_ann import collision_ann
from persona_spark.llm.jaccard_join import jaccard_join
from persona_spark.llm.kneser_ney import kneser_ney
from persona_spark.llm.license_scan import license_scan
from persona_spark.llm.line_dedup import line_dedup
from persona_spark.llm.merkle import merkle_manifest
from persona_spark.llm.packing import best_fit_packing
from persona_spark.llm.quality_rules import quality_rules
from persona_spark.llm.spelling import spelling_variants, vocabulary
from persona_spark.llm.token_records import token_records
from persona_spark.llm.url_filter import url_filter


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents")).drop("spans")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(expand_examples(turns.unionByName(planted)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select(
        "doc_id",
        F.col("_lines.n_lines").alias("n_lines"),
        F.col("_lines.n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(read(spark, sf_dir, "documents"))


def op1_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe(read(spark, sf_dir, "documents"))


def op7_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return collision_ann(vectors, vectors.filter("vec_id % 20 = 0"))


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("text_hash")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(read(spark, sf_dir, "documents")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text is tampered with where the checksum of the id is even: its newlines are gone."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest(read(spark, sf_dir, "documents"), tampered)


QUERIES = {
    "op11_token_records": op11_token_records,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
    "op3_jaccard_join": op3_jaccard_join,
    "op2_kneser_ney": op2_kneser_ney,
    "op7_collision_ann": op7_collision_ann,
    "op1_chunk_bpe": op1_chunk_bpe,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op9_url_filter": op9_url_filter,
    "op5_line_dedup": op5_line_dedup,
    "op6_chat_format": op6_chat_format,
    "op10_license_scan": op10_license_scan,
    "op8_quality_rules": op8_quality_rules,
}
