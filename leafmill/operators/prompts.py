"""Prompt refinements: versions, decisions, roll-back and use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill import fixed_values as fv
from leafmill.operators.joins import lookup_join
from leafmill.operators.ordered import chunked_row_number

KEY = ["domain", "schema_name"]


def best_prompts(prompts: DataFrame) -> DataFrame:
    """The accepted prompt of each (domain, schema) with the best measured quality."""
    row = F.struct(*[c for c in prompts.columns if c not in KEY])
    best = F.max_by(row, F.struct("candidate_quality", "version"))
    return (
        prompts.where(F.col("status") == "accepted")
        .groupBy(*KEY)
        .agg(best.alias("_best"))
        .select(*KEY, "_best.*")
    )


def save_candidates(candidates: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """New rows with the next versions of their (domain, schema), in (ts, id) order.

    ``candidates``: id, ts, domain, schema_name, baseline_quality and any others.
    """
    out = candidates
    if "minimum_improvement" not in out.columns:
        out = out.withColumn("minimum_improvement", F.lit(fv.MINIMUM_IMPROVEMENT))
    out = chunked_row_number(out, KEY, ["ts", "id"], "version").withColumn(
        "version", F.col("version").cast("int")
    )
    if prompts is not None:
        last = prompts.groupBy(*KEY).agg(F.max("version").alias("_last"))
        out = (
            lookup_join(out, last, KEY)
            .withColumn(
                "version", (F.col("version") + F.coalesce("_last", F.lit(0))).cast("int")
            )
            .drop("_last")
        )
    return out.withColumn("status", F.lit("candidate")).withColumn(
        "candidate_quality", F.lit(None).cast("double")
    )


def judge_candidates(prompts: DataFrame, measured: DataFrame) -> DataFrame:
    """Accept candidates whose gain reaches their minimum; judged rows stay as they are.

    ``measured``: id, quality (one row per id).
    """
    joined = prompts.join(measured.select("id", F.col("quality").alias("_q")), "id", "left")
    open_case = (F.col("status") == "candidate") & F.col("_q").isNotNull()
    accepted = F.col("_q") - F.col("baseline_quality") >= F.col("minimum_improvement")
    changed = {
        "status": F.when(
            open_case, F.when(accepted, "accepted").otherwise("rejected")
        ).otherwise(F.col("status")),
        "candidate_quality": F.when(open_case, F.col("_q")).otherwise(
            F.col("candidate_quality")
        ),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in prompts.columns])


def import_trusted(trusted: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """Rows a user vouches for: accepted at their stated quality, with no minimum gain.

    ``trusted``: id, ts, domain, schema_name, extra_instructions, quality.
    """
    rows = trusted.withColumn("baseline_quality", F.col("quality")).withColumn(
        "minimum_improvement", F.lit(0.0)
    )
    return (
        save_candidates(rows, prompts)
        .withColumn("status", F.lit("accepted"))
        .withColumn("candidate_quality", F.col("quality"))
        .drop("quality")
    )


def roll_back(prompts: DataFrame, ids: DataFrame) -> DataFrame:
    """Take back accepted prompts; other states are left alone. ``ids``: id."""
    marked = lookup_join(prompts, ids.select("id").distinct().withColumn("_hit", F.lit(True)), ["id"])
    return marked.withColumn(
        "status",
        F.when(
            F.col("_hit") & (F.col("status") == "accepted"), "rolled_back"
        ).otherwise(F.col("status")),
    ).select(*prompts.columns)


def count_usage(prompts: DataFrame, uses: DataFrame) -> DataFrame:
    """Add one use to the best prompt for each row of ``uses`` (domain, schema_name).

    Uses are counted before the join, so a domain with many pages sends one row.
    """
    best = best_prompts(prompts).select(*KEY, "id")
    counted = uses.groupBy(*KEY).agg(F.count("*").alias("_uses"))
    added = counted.join(best, KEY).select("id", "_uses")
    total = F.col("times_used") + F.coalesce("_uses", F.lit(0))
    return (
        prompts.join(added, "id", "left")
        .withColumn("times_used", total.cast("long"))
        .select(*prompts.columns)
    )
