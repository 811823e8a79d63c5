"""The registered queries of this package: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import alignment, bpe, chat, licences, mixing, neighbours, ngram_join, oracles, outliers, periods, quality_fm, records, rlz, toxicity
from llm.tables import cut, table


def op1_outlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_rules(table(spark, sf_dir, "documents"))


def op2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = records.records_folder(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    written = records.write_records(table(spark, sf_dir, "documents"), folder, path, end_id=1)
    out = records.read_records(spark, folder, written)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.sizes(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = toxicity.training_labels(table(spark, sf_dir, "labels"), "toxic", 5, 0)
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), labels)
    return out.select(
        "doc_id",
        toxicity.held_out(5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "best_ratio",
        "mean_ratio",
    )


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = toxicity.training_labels(table(spark, sf_dir, "labels"), "quality", 3, 1)
    out = quality_fm.quality(table(spark, sf_dir, "documents"), labels)
    return out.select(
        "doc_id", toxicity.held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlz.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_event_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    messages = chat.fold(chat.conversation_log(rows.unionByName(more)))
    return chat.digests(cut(chat.render(messages)))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.periodic_runs(periods.retold(table(spark, sf_dir, "documents"))))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    out = alignment.aligned(table(spark, sf_dir, "documents"), *paths, public_tokenizers.PATTERN)
    return out.select("row.doc_id", *[c for c in out.columns if c != "row"])


QUERIES = {
    f.__name__: f
    for f in (
        op1_outlier_rules,
        op2_records,
        op3_mix,
        op4_learned_partitions,
        op5_chunked_bpe,
        op6_licence_scan,
        op7_kneser_ney,
        op8_factorisation_machine,
        op9_ngram_jaccard,
        op10_relative_lz,
        op11_event_chat,
        op12_periodic_runs,
        op13_token_alignment,
    )
}
SQL: dict[str, str] = {
    "op6_licence_scan": licences.scan_sql(),
    "op9_ngram_jaccard": oracles.NGRAM_JACCARD,
    "op10_relative_lz": oracles.RELATIVE_LZ,
    "op11_event_chat": oracles.CHAT,
    "op12_periodic_runs": oracles.RUNS,
}
