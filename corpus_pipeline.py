"""The training-data pipeline: five stages, the first four of which take and return documents.

Toxic documents go; of documents that are nearly alike the one with the smallest id stays; passages that
stand anywhere else are cut out; the sources are mixed to their target weights; the mix is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import bpe, mixing, ngram_join, rlz, toxicity
from llm.tables import cut, table

# up to this many ids (8 MB) are broadcast; more of them are joined by a shuffle
BROADCAST_IDS = 1_000_000
# near copies: sets of five-word shingles with a Jaccard similarity of 0.8 or more
NEAR_WIDTH, NEAR_PERCENT = 5, 80
# bytes of a batch that a task sends to Python; the executor and the Python worker both hold it, and keep room for the largest
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """Texts go to Python by their size, not by 10,000 rows; a setting of the session, as stages run when they are written."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _nested(columns: list[str]) -> Column:
    """Columns in one struct, so that none of them meets a result of the same name."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__keep")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5; the labels of rows that op7 holds out are not learned here either."""
    _small_batches(spark)
    labels = toxicity.training_labels(table(spark, sf_dir, "labels"), "toxic", 5, 0)
    whole = docs.select("doc_id", "text", _nested(docs.columns))
    return toxicity.toxicity(whole, labels, keep=("__keep",)).where("score < 0.5").select("__keep.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: with the id that names it; rows without an id and without words stay.

    Rows leave by id and text, so an id with several texts loses only those that are near copies.
    """
    _small_batches(spark)
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    found = ngram_join.jaccard_components(keyed, width=NEAR_WIDTH, percent=NEAR_PERCENT, row="__row")
    gone = found.where("doc_id <> component_id").select("__row")
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1)
    if again:  # of the texts of one id in a component one stays
        named = found.where("doc_id = component_id and group is not null").select("group", "__row").distinct()
        first = named.groupBy("group").agg(F.min("__row").alias("first"))
        gone = gone.unionByName(named.join(first, "group").where("__row <> first").select("__row"))
    gone = cut(gone.distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = keyed.join(gone, "__row", "left_anti").select(*docs.columns)
    if again:  # repeated rows share an id: of each the one with the smallest hash stays
        rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
        first = F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("__rest") if rest else F.lit(None).alias("__rest")
        one = kept.where("doc_id is not null").groupBy("doc_id", "text").agg(first)
        one = one.select("doc_id", "text", "__rest.*") if rest else one.drop("__rest")
        kept = one.select(*kept.columns).unionByName(kept.where("doc_id is null"))
    return kept


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that stand anywhere else; others keep their text as it is."""
    _small_batches(spark)
    rest = [c for c in docs.columns if c != "text"]
    out = rlz.substring_dedup(docs.select("text", _nested(rest)), keep=("__keep",), verbatim=True)
    size = F.coalesce(F.length("kept").cast("long"), F.col("__keep.n_chars"))
    new = {"text": F.col("kept").alias("text"), "n_chars": size.alias("n_chars")}
    return out.select(*[new.get(c, F.col(f"__keep.`{c}`")) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text of the mix: its id, number of tokens, and digests of the ids and of the decoded bytes.

    The ids are written and read again: with both steps in one task it would have two Python workers, and all of them
    stay for the stages of a later run.
    """
    _small_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(cut(bpe.encode(docs, path, pattern)), path, pattern)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("byte_level_bpe", encode),
]
# the models, hashes and merges of the stages are beyond SQL; tests/llm compares with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
