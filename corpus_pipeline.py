"""A corpus from raw documents to packed windows, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; between
stages the rows are written as Parquet and read again. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontamination, near_duplicates, packing, personal_data, quality
from leafmill.llm.common import shared_table


def _columns(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*(F.col("row").getField(c).alias(c) for c in names))


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (bad or toxic) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _columns(quality.judge(docs, labels, carry=docs.columns).filter("kept"), docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8) stays."""
    found = shared_table(near_duplicates.near_duplicates(docs).select("key", "chosen"), "chosen")
    return near_duplicates.keep_one(docs, found, docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    marked = decontamination.mark(docs, benchmark, carry=docs.columns)
    return _columns(marked.filter(F.size("found.runs") == 0), docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows."""
    found = personal_data.redact(personal_data.find(docs, carry=docs.columns))
    out = _columns(found.withColumn("row", F.col("row").withField("text", F.col("redacted"))), docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into windows of 1024 tokens."""
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality classifier", classify),
    ("near duplicates", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("personal data", redact),
    ("packing", pack),
]

#: SQL can't express the first two stages and the tokenizer; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = shared_table(docs, "stage")
    return docs


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
