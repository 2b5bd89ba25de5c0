"""Cleaning rules: proposals, evidence, outcomes and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill import fixed_values as fv
from leafmill.operators.joins import lookup_join
from leafmill.operators.ordered import chunked_row_number, last_distinct
from leafmill.session import stage

KEY = ["domain", "rule_type", "selector"]
EVIDENCE_KEPT = 10


def propose_rules(
    cleaned: DataFrame, quality: DataFrame, *, min_count: int = 2
) -> DataFrame:
    """Class rules for pages whose poor output goes with repeated noise blocks.

    ``cleaned``: page_id, domain, noise (from the cleaning pass). The three most
    frequent noise classes of a page, ties in page order, count at least ``min_count``.
    """
    wanted = F.arrays_overlap(
        "issues", F.array(F.lit("GARBAGE_CONTENT"), F.lit("LOW_VALIDITY"))
    )
    poor = quality.where(wanted).select("page_id")
    by_count = F.array_sort(
        F.transform(
            "noise",
            lambda c: F.struct((-c["n"]).alias("minus"), c["pos"].alias("pos"), c["class_name"].alias("c")),
        )
    )
    noisy = cleaned.where(F.size("noise") > 0).select(
        "page_id", "domain", F.slice(by_count, 1, 3).alias("_top")
    )
    return (
        noisy.join(poor, "page_id", "left_semi")
        .select("page_id", "domain", F.explode("_top").alias("_c"))
        .select("page_id", "domain", F.col("_c.c").alias("selector"), (-F.col("_c.minus")).alias("n"))
        .where(F.col("n") >= min_count)
        .select(
            "page_id",
            "domain",
            F.lit("class").alias("rule_type"),
            "selector",
            F.lit(fv.NOISE_REASON).alias("reason"),
            F.concat(F.lit("class="), "selector", F.lit(";count="), "n").alias("evidence"),
            F.least(F.lit(0.8), F.lit(0.45) + F.col("n") * 0.05).alias("confidence"),
        )
    )


def explicit_rules(wishes: DataFrame) -> DataFrame:
    """Evidence rows for rules a user asked for. ``wishes``: KEY, ts, id."""
    return wishes.select(
        *KEY,
        "ts",
        "id",
        F.lit(fv.EXPLICIT_REASON).alias("reason"),
        F.lit(fv.EXPLICIT_EVIDENCE).alias("evidence"),
        F.lit(1.0).alias("confidence"),
        F.lit(True).alias("explicit"),
    )


def feedback_rules(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules wished for in ``cleaning_rule`` feedback, and the rows that are unusable.

    ``feedback``: id, ts, domain, feedback_type, details.
    """
    detail = F.from_json("details", "struct<rule_type:string,selector:string>")
    rows = feedback.where(F.col("feedback_type") == "cleaning_rule").withColumn("_d", detail)
    usable = F.coalesce(
        F.col("_d.rule_type").isin(fv.RULE_TYPES) & F.col("_d.selector").isNotNull(),
        F.lit(False),
    ) & F.col("domain").isNotNull()
    wishes = rows.where(usable).select(
        "id", "ts", "domain", "_d.rule_type", "_d.selector"
    )
    return wishes, rows.where(~usable).drop("_d")


def _usable_key() -> Column:
    """A rule needs a domain, a supported type and a selector."""
    named = F.col("domain").isNotNull() & F.col("selector").isNotNull()
    return named & F.coalesce(F.col("rule_type").isin(fv.RULE_TYPES), F.lit(False))


def rejected_evidence(evidence: DataFrame) -> DataFrame:
    """The rows that ``fold_evidence`` does not apply: a null in the key, or an unsupported type."""
    return evidence.where(~_usable_key())


def fold_evidence(
    evidence: DataFrame, rules: DataFrame | None = None, *, activation_count: int = 2
) -> DataFrame:
    """Rules after all evidence, applied in (ts, id) order.

    ``evidence``: KEY, ts, id, reason, evidence, confidence, explicit. ``rules`` is an
    older table to continue from (KEY, id, confidence, evidence_count, status,
    evidence). Rows with a null domain or selector, or without a supported type, make no rule
    (``rejected_evidence`` returns them); rules of an older table stay as they are, whatever their
    keys. Confidence is a noisy-or, so its product and the counts combine before
    the shuffle; a candidate becomes active when both limits hold, and since both only
    grow, the last row tells. The list of the last ten pieces of evidence is the one
    thing that needs the order.
    """
    usable = evidence.where(_usable_key()).withColumn(
        "confidence", F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(1.0))
    )
    at = F.struct("ts", "id")
    summed = usable.groupBy(*KEY).agg(
        F.count("*").alias("_n"),
        F.product(1 - F.col("confidence")).alias("_doubt"),
        F.max("confidence").alias("_conf"),
        F.bool_or("explicit").alias("_explicit"),
        F.min_by("explicit", at).alias("_explicit_first"),
        F.max_by("reason", at).alias("_reason"),
        F.min(at).alias("_first"),
        F.max("ts").alias("_ts"),
    )
    seeds = usable.select(*KEY, F.col("ts").alias("_at"), F.col("id").alias("_id"), "evidence")
    if rules is None:
        old_columns = {
            "id0": "bigint", "_conf0": "double", "_n0": "bigint", "_status0": "string",
            "_created0": "timestamp", "_reason0": "string", "_evidence0": "array<string>",
        }
        joined = summed.select(
            "*", *[F.lit(None).cast(t).alias(c) for c, t in old_columns.items()]
        )
        last_id = None
    else:
        old = rules.select(
            *KEY,
            F.col("id").alias("id0"),
            F.col("confidence").alias("_conf0"),
            F.col("evidence_count").alias("_n0"),
            F.col("status").alias("_status0"),
            F.col("created_at").alias("_created0"),
            F.col("reason").alias("_reason0"),
            F.col("evidence").alias("_evidence0"),
        )
        joined = summed.join(old, KEY, "full")
        last_id = rules.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last_id")).scalar()
        # Older evidence comes before every new row, in its own order.
        before = rules.select(*KEY, F.posexplode("evidence").alias("_id", "evidence"))
        seeds = seeds.unionByName(
            before.withColumn("_at", F.lit("1000-01-01").cast("timestamp")).withColumn(
                "_id", F.col("_id").cast("long")
            )
        )
    kept = last_distinct(seeds, KEY, ["_at", "_id"], "evidence", EVIDENCE_KEPT)
    is_new = F.col("_status0").isNull()
    n = F.coalesce("_n", F.lit(0))
    single = is_new & (F.col("_n") == 1)
    doubt = F.coalesce(1 - F.col("_conf0"), F.lit(1.0)) * F.coalesce("_doubt", F.lit(1.0))
    confidence = F.when(single, F.col("_conf")).otherwise(
        F.when(n == 0, F.col("_conf0")).otherwise(1 - doubt)
    )
    first_counts_two = (F.coalesce("_n0", F.lit(0)) == 0) & F.coalesce(
        "_explicit_first", F.lit(False)
    )
    count = F.coalesce("_n0", F.lit(0)) + n + first_counts_two.cast("int")
    # Compared on a fixed scale: the last bits of a product depend on the order of its factors.
    sure = F.round(confidence, 9) >= 0.7
    reached = (count >= activation_count) & sure & (n > 0) & ~single
    was = F.coalesce("_status0", F.lit("candidate"))
    status = (
        F.when(F.coalesce("_explicit", F.lit(False)), "active")
        .when((was == "candidate") & reached, "active")
        .otherwise(was)
    )
    out = joined.select(
        *KEY,
        "id0",
        F.lit("remove").alias("action"),
        F.coalesce("_reason", "_reason0").alias("reason"),
        confidence.alias("confidence"),
        count.cast("long").alias("evidence_count"),
        status.alias("status"),
        F.coalesce("_created0", F.col("_first.ts")).alias("created_at"),
        F.col("_ts").alias("updated_at"),
        "_evidence0",
        F.col("_first.ts").alias("_first_ts"),
        F.col("_first.id").alias("_first_id"),
    ).join(kept, KEY, "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("evidence", F.coalesce("_list", "_evidence0", none)).drop(
        "_list", "_evidence0"
    )
    if last_id is not None:
        out = stage(out, "rules")
    # New rules are numbered in the order of their first evidence, after the old ones.
    new = chunked_row_number(
        out.where("id0 is null"), [], ["_first_ts", "_first_id", *KEY], "id"
    )
    if last_id is None:
        return new.drop("id0", "_first_ts", "_first_id")
    new = new.withColumn("id", F.col("id") + last_id)
    known = out.where("id0 is not null").withColumn("id", F.col("id0"))
    return new.unionByName(known).drop("id0", "_first_ts", "_first_id")


def rules_of(rules: DataFrame, *, active_only: bool = True) -> DataFrame:
    """Rules per domain in id order, by default only those in force."""
    out = rules.where(F.col("status") == "active") if active_only else rules
    return out.orderBy("domain", "id")


def outcome_rows(cleaned: DataFrame, quality: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per applied rule: the page's score against the domain's score before.

    ``profiles`` is the table as it was before the run; a domain without one is
    compared with the page's own score.
    """
    applied = cleaned.where(F.size("applied_rule_ids") > 0).select(
        "page_id", "domain", F.explode("applied_rule_ids").alias("rule_id")
    )
    scored = applied.join(
        quality.select("page_id", F.col("score").alias("quality")), "page_id"
    )
    before = profiles.select("domain", F.col("avg_quality").alias("_before"))
    return (
        lookup_join(scored, before, ["domain"])
        .withColumn("baseline_quality", F.coalesce("_before", "quality"))
        .select("rule_id", "page_id", "quality", "baseline_quality")
    )


def fold_outcomes(rules: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Count outcomes per rule and disable active rules that only made things worse.

    ``outcomes``: rule_id, ts, id, quality, baseline_quality. An active rule falls at
    the first point with two negative outcomes and no positive one. That point exists
    exactly when the second negative outcome comes before the first positive one, so
    no row order has to be walked: the first two negatives are found by a limit that
    is pushed below the shuffle, everything else by sums.
    """
    at = F.struct("ts", "id")
    up = F.col("quality") >= F.col("baseline_quality") + 0.02
    down = F.col("quality") < F.col("baseline_quality") - 0.05
    sums = outcomes.groupBy("rule_id").agg(
        F.count("*").alias("_n"),
        F.sum(up.cast("long")).alias("_up"),
        F.sum(down.cast("long")).alias("_down"),
        F.min(F.when(up, at)).alias("_first_up"),
        F.min(at).alias("_first"),
        F.max_by("quality", at).alias("_quality"),
    )
    order = W.partitionBy("rule_id").orderBy("ts", "id")
    two = (
        outcomes.where(down)
        .withColumn("_rank", F.row_number().over(order))
        .where("_rank <= 2")
        .groupBy("rule_id")
        .agg(
            F.min(F.when(F.col("_rank") == 1, at)).alias("_down1"),
            F.min(F.when(F.col("_rank") == 2, at)).alias("_down2"),
        )
    )
    joined = rules.join(
        sums.join(two, "rule_id", "left").withColumnRenamed("rule_id", "id"), "id", "left"
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    turning = (
        F.when(F.col("negative_outcomes") >= 2, F.col("_first"))
        .when(F.col("negative_outcomes") == 1, F.col("_down1"))
        .otherwise(F.col("_down2"))
    )
    falls = (
        (F.col("status") == "active")
        & (F.col("positive_outcomes") == 0)
        & turning.isNotNull()
        & (F.col("_first_up").isNull() | (turning < F.col("_first_up")))
    )
    changed = {
        "times_applied": F.col("times_applied") + zero(F.col("_n")),
        "positive_outcomes": F.col("positive_outcomes") + zero(F.col("_up")),
        "negative_outcomes": F.col("negative_outcomes") + zero(F.col("_down")),
        "last_quality": F.coalesce("_quality", "last_quality"),
        "status": F.when(falls, "disabled").otherwise(F.col("status")),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in rules.columns])


def with_outcome_columns(rules: DataFrame) -> DataFrame:
    """Fresh rules with empty outcome counters."""
    return rules.select(
        "*",
        *[
            F.lit(0).cast("long").alias(c)
            for c in ("times_applied", "positive_outcomes", "negative_outcomes")
        ],
        F.lit(None).cast("double").alias("last_quality"),
    )


def disable_rules(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """Disable (or roll back) active and candidate rules. ``ids``: id."""
    marked = lookup_join(rules, ids.select("id").distinct().withColumn("_hit", F.lit(True)), ["id"])
    open_state = F.col("_hit") & F.col("status").isin("active", "candidate")
    return marked.withColumn(
        "status", F.when(open_state, "disabled").otherwise(F.col("status"))
    ).select(*rules.columns)
