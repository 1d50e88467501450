"""From raw documents to sharded training rows: five stages, each by one operator of ``touchline.llm``.

Every stage takes the documents that its predecessor kept and, but for the last, returns the columns of
documents. Rows with one id are one document to a stage that drops documents; a row without an id is known
by its text. Columns beginning with ``_m_`` are the mixing operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import decision_list, jump_shards, positional_index, source_mixture, tensor_minhash
from touchline.session import materialize

SHARDS = 24

ORACLE_SQL = None


def _known_by() -> Column:
    """The id; for a row without one, a number beyond all ids made of its text, so that a row with an id stays before it."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 62)))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_known_by().alias("_key"), F.struct("*").alias("_row"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(_known_by().alias("doc_id"), "text")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned list rejects."""
    rules = decision_list.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = decision_list.judge(docs.select(F.struct("*").alias("_row"), "text"), rules)
    return judged.where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    found = tensor_minhash.near_duplicates(_texts(docs))
    kept = found.where(F.col("id") == F.col("component")).select(F.col("id").alias("_key")).distinct()
    stay = _keyed(docs).join(kept, "_key", "left_semi").withColumn("_text", F.xxhash64("_row.text"))
    # rows are partitioned by the key already; of repeated rows one stays
    return stay.selectExpr("*", "row_number() OVER (PARTITION BY _key, _text ORDER BY _key) AS _copy").where("_copy = 1").select("_row.*")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in passages of test items."""
    judged = positional_index.contamination(_texts(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = judged.where(positional_index.contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("id").alias("_key")).distinct()
    return _keyed(docs).join(materialize(gone), "_key", "left_anti").select("_row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents by their sources' targets; the text at a target's end is cut there."""
    mixed = source_mixture.mixture(docs, docs.columns)
    rows = source_mixture.mixed_rows(mixed, docs.columns)
    chars = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return rows.select(*[F.coalesce(chars, "n_chars").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    placed = jump_shards.shard_rows(docs, SHARDS)
    return placed.select(
        F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", F.col("grown").alias("grown_shard")
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
