"""The registered queries of this folder and their SQL (DuckDB)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import alignment, bpe, decontamination, near_duplicates, packing, personal_data, prefix_trie, quality, repeats, secret_scan, sharding, topk, url_filters

WINDOW_TOKENS = 1024
SHARDS = 40
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spans: Column, kind: int | str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", "p_quality", "p_toxic", "kept")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [_count(base, n).alias(f"n_{kind}") for n, kind in enumerate(personal_data.KINDS)]
    return found.select(
        "row.doc_id", *counts, F.sha2(personal_data.spelled(base), 256).alias("base_sha256"),
        personal_data.spelled(F.col("spans")).alias("spans"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontamination.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("found.runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    items = F.array_join(F.array_sort("found.items"), ",")
    return marked.select(
        "row.doc_id", "found.n_words", hit.alias("n_hit"), (F.size("found.items") + F.col("found.unnamed").cast("int")).cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.PATTERN,
        window=WINDOW_TOKENS,
    )
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    spelled = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [_count(F.col("secrets"), rule.kind).alias(f"n_{rule.kind}") for rule in secret_scan.RULES]
    return found.select("doc_id", *counts, F.sha2(spelled, 256).alias("base_sha256"), spelled.alias("spans"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = public_tokenizers.path("piece_bpe_32k.model")
    aligned = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), pieces)
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    kept = alignment.store(aligned.select(*[c for c in aligned.columns if c != "groups"], digest))
    return alignment.score(kept, alignment.piece_count(pieces)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    prefixes = prefix_trie.prefixes(
        table(spark, sf_dir, "conversations"), base=conv - conv % 100, taken=F.crc32(conv.cast("string").cast("binary")) % 6
    )
    return prefix_trie.trie(prefixes)


def op13_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    spelled = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_topk_search, op2_quality, op3_repeats, op4_personal_data, op5_decontamination, op6_near_duplicates, op7_packing, op8_sharding, op9_secret_scan, op10_url_filters, op11_token_alignment, op12_prefix_trie, op13_bpe_roundtrip,
    )
}
