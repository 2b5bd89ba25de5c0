"""The extraction-quality score: records against a field schema, per page."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill import fixed_values as fv
from leafmill.functions.numbers import round_exact
from leafmill.functions.text import fold_case, is_present, strip
from leafmill.functions.validate import field_error, possible_errors
from leafmill.operators.joins import lookup_join
from leafmill.session import stage

Schema = dict[str, Any]


def identity(rec: Column, schema: Schema) -> Column:
    """What tells two records apart.

    The first identifying field of the schema; a missing key counts as empty, a null
    value as the text ``none``. Without such a field, the whole record in key order.
    """
    field = next((f for f in schema if f in fv.IDENTITY_FIELDS), None)
    if field is None:
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(rec))))
    value = F.when(
        F.map_contains_key(rec, field), F.coalesce(rec[field], F.lit("None"))
    ).otherwise("")
    text = fold_case(strip(value))
    return F.when(text != "", text)


def is_garbage(rec: Column) -> Column:
    text = F.lower(F.to_json(rec))
    return reduce(or_, [text.contains(p) for p in fv.GARBAGE_PHRASES])


def _cells(texts: dict[str, Column], schema: Schema) -> tuple[Column, Column, list[Column]]:
    """Good cells of a record by two measures, and per field the error it has (or null)."""
    filled, basic, errors = [], [], []
    for field, spec in schema.items():
        text = texts[field]
        present = is_present(text, stripped=True)
        telling = (F.length(text) > 1) & (fold_case(text) != fold_case(F.lit(field)))
        filled.append(present.cast("int"))
        basic.append((present & telling).cast("int"))
        code = field_error(field, text, spec, stripped=True)
        errors.append(F.concat(F.lit(f"{field}:"), code))
    total = lambda parts: reduce(add, parts) if parts else F.lit(0)
    return total(filled), total(basic), errors


def record_measures(records: DataFrame, schema: Schema) -> DataFrame:
    """Per record: counts of good cells, and one flag per error that can occur.

    The fields are known when the plan is made, so a record stays one row: nothing is
    exploded and no catalog is joined.
    """
    rec = F.col("rec")
    # Trimmed texts first, in a projection of their own: each is used many times.
    texts = records.select(
        "page_id", "rec", *[strip(rec[f]).alias(f"t{i}") for i, f in enumerate(schema)]
    )
    filled, basic, errors = _cells({f: F.col(f"t{i}") for i, f in enumerate(schema)}, schema)
    found = F.filter(F.array(*errors), lambda e: e.isNotNull())
    # The lambda keeps this step out of whole-stage codegen, where all the checks would
    # become one method too long for the JVM to compile: half the time on wide schemas.
    checked = texts.select(
        "page_id",
        filled.alias("filled"),
        basic.alias("basic"),
        is_garbage(rec).cast("int").alias("garbage"),
        identity(rec, schema).alias("identity"),
        (found if errors else F.array().cast("array<string>")).alias("errors"),
    )
    return checked.select(
        "page_id",
        "filled",
        "basic",
        (F.lit(len(schema)) - F.size("errors")).alias("sound"),
        "garbage",
        "identity",
        *[
            F.array_contains("errors", name).alias(f"e{i}")
            for i, name in enumerate(_error_names(schema))
        ],
    )


def _error_names(schema: Schema) -> list[str]:
    return sorted(f"{f}:{code}" for f, spec in schema.items() for code in possible_errors(f, spec))


def score_records(
    records: DataFrame, schema: Schema, pages: DataFrame | None = None
) -> DataFrame:
    """Quality of each page's records.

    ``records``: page_id, rec (map of field to text). With ``pages`` (page_id and
    whatever should come along), pages without records score 0 with NO_RESULTS.

    Sums combine before the shuffle, and the exact distinct count shuffles by
    (page, identity) first: a page with a third of all records is spread over tasks.
    """
    errors = _error_names(schema)
    sums = (
        record_measures(records, schema)
        .groupBy("page_id")
        .agg(
            F.count("*").alias("results_count"),
            F.sum("filled").alias("filled"),
            F.sum("basic").alias("basic"),
            F.sum("sound").alias("sound"),
            F.sum("garbage").alias("garbage"),
            F.count_distinct("identity").alias("distinct_ids"),
            *[F.max(f"e{i}").alias(f"e{i}") for i in range(len(errors))],
        )
    )
    keep = ["page_id"]
    if pages is not None:
        keep = pages.columns
        sums = pages.join(sums, "page_id", "left").withColumn(
            "results_count", F.coalesce("results_count", F.lit(0)).cast("long")
        )
    listed = [F.when(F.col(f"e{i}"), name) for i, name in enumerate(errors)]
    listed = F.array_compact(F.array(*listed)) if errors else F.array().cast("array<string>")
    return _rated(sums, keep, F.lit(len(schema)), listed)


def _rated(sums: DataFrame, keep: list[str], width: Column, listed: Column) -> DataFrame:
    """Scores from the sums of each page; ``width``: fields of its schema, ``listed``: its errors."""
    some = F.col("results_count") > 0
    n = F.col("results_count")
    per_cell = lambda c: F.when(width > 0, F.col(c) / (n * width)).otherwise(0.0)
    rates = {
        "fill_rate": per_cell("filled"),
        "basic_validity": per_cell("basic"),
        "uniqueness": F.col("distinct_ids") / n,
        "content_quality": 1 - F.col("garbage") / n,
        "deterministic_validation": per_cell("sound"),
        "result_count": F.least(n / 5.0, F.lit(1.0)),
    }
    rated = sums.select(
        *keep,
        *([] if "results_count" in keep else ["results_count"]),
        *[F.when(some, r).otherwise(0.0).alias(f"_{k}") for k, r in rates.items()],
        listed.alias("validation_errors"),
    )
    raw = {k: F.col(f"_{k}") for k in rates}
    weighted = reduce(add, [raw[k] * w for k, w in fv.SCORE_WEIGHTS.items()])
    trust = (
        F.lit(0.35)
        + F.lit(0.35) * raw["result_count"]
        + F.lit(0.30) * raw["deterministic_validation"]
    )
    found = F.array_compact(
        F.array(
            F.when(raw["fill_rate"] < 0.3, "LOW_FILL_RATE"),
            F.when(raw["basic_validity"] < 0.3, "LOW_VALIDITY"),
            F.when(raw["uniqueness"] < 0.5, "MANY_DUPLICATES"),
            F.when(raw["content_quality"] < 0.5, "GARBAGE_CONTENT"),
            F.when(raw["deterministic_validation"] < 0.7, "SCHEMA_VALIDATION_FAILED"),
            F.when(n == 1, "ONLY_ONE_RESULT"),
        )
    )
    keep = [*keep, *([] if "results_count" in keep else ["results_count"])]
    # Rounding uses its argument many times, so the arguments become columns first.
    unrounded = rated.select(
        *keep,
        "validation_errors",
        *raw.values(),
        F.when(some, F.least(F.greatest(weighted, F.lit(0.0)), F.lit(1.0)))
        .otherwise(0.0)
        .alias("_score"),
        F.when(some, F.least(F.lit(1.0), trust)).otherwise(0.0).alias("_confidence"),
        F.when(some, found).otherwise(F.array(F.lit("NO_RESULTS"))).alias("issues"),
    )
    rounded = unrounded.select(
        *keep,
        round_exact(F.col("_score")).alias("score"),
        *[round_exact(c).alias(k) for k, c in raw.items()],
        round_exact(F.col("_confidence")).alias("confidence"),
        "validation_errors",
        "issues",
    ).withColumn("_uncertainty", 1 - F.col("confidence"))
    return rounded.select(
        *keep,
        "score",
        F.struct(*raw).alias("components"),
        "fill_rate",
        "confidence",
        round_exact(F.col("_uncertainty")).alias("uncertainty"),
        F.coalesce("validation_errors", F.array().cast("array<string>")).alias(
            "validation_errors"
        ),
        "issues",
    )


def should_retry(quality: DataFrame, attempt: int = 0) -> DataFrame:
    """Pages whose score calls for one more try."""
    more = F.lit(attempt < fv.MAX_IMPROVEMENT_ATTEMPTS)
    return quality.where((F.col("score") < fv.QUALITY_GOOD) & more)


def retry_strategy(quality: DataFrame) -> DataFrame:
    """Instructions and extra wait for the first issue that has a strategy."""
    instructions, wait = F.lit(""), F.lit(0.0)
    for issue, text in reversed(list(fv.RETRY_INSTRUCTIONS.items())):
        has = F.array_contains("issues", issue)
        instructions = F.when(has, text).otherwise(instructions)
        extra = fv.NO_RESULTS_EXTRA_WAIT if issue == "NO_RESULTS" else 0.0
        wait = F.when(has, extra).otherwise(wait)
    return quality.select(
        "*",
        instructions.alias("extra_instructions"),
        wait.alias("wait_seconds_adjust"),
        F.lit(True).alias("retry"),
    )


def choose_refined(
    baseline: DataFrame,
    retry: DataFrame,
    minimum_improvement: float = fv.MINIMUM_IMPROVEMENT,
) -> DataFrame:
    """Per page: scores of both tries and whether the retry is kept."""
    base = baseline.select("page_id", F.col("score").alias("baseline_quality"))
    new = retry.select("page_id", F.col("score").alias("candidate_quality"))
    gain = F.col("candidate_quality") - F.col("baseline_quality")
    return base.join(new, "page_id", "left").withColumn(
        "accepted", F.coalesce(gain >= minimum_improvement, F.lit(False))
    )


def kept_records(
    choice: DataFrame, baseline_records: DataFrame, retry_records: DataFrame
) -> DataFrame:
    """The record set of the chosen try of every page."""
    accepted = stage(choice.where("accepted").select("page_id"), "accepted")
    return lookup_join(baseline_records, accepted, ["page_id"], "left_anti").unionByName(
        lookup_join(retry_records, accepted, ["page_id"], "left_semi")
    )


#: Errors whose flags share one whole number in ``score_by_schema``.
_FLAGS = 60


def score_by_schema(
    records: DataFrame, schemas: dict[str, Schema], pages: DataFrame | None = None
) -> DataFrame:
    """Scores of records of several schemas, told apart by ``schema_key``, from one scan.

    A record is measured by the branch of its schema alone; fields that several schemas share
    are trimmed once. The errors of a page are flags in whole numbers, which combine
    before the shuffle and are named by its schema at the end, so columns do not grow with the number of
    schemas. Rows whose ``schema_key`` is null or not among ``schemas`` take no part. With ``pages``
    (schema_key, page_id, ...), pages without records score 0.
    """
    keys, key = ["schema_key", "page_id"], F.col("schema_key")
    names = {k: _error_names(s) for k, s in schemas.items()}
    words = max(-(-max(map(len, names.values())) // _FLAGS), 1)

    def switch(branch: Callable[[str, Schema], Column]) -> Column:
        parts = [F.when(key == k, branch(k, s)) for k, s in schemas.items()]
        return F.coalesce(*parts)

    def measured(k: str, schema: Schema) -> Column:
        filled, basic, errors = _cells(texts, schema)
        found = F.filter(F.array(*errors), lambda e: e.isNotNull()) if errors else F.array()
        return F.struct(
            filled.alias("filled"), basic.alias("basic"), identity(F.col("rec"), schema).alias("identity"),
            found.cast("array<string>").alias("errors"),
        )

    def flags(k: str, word: int) -> Column:
        mine = names[k][word * _FLAGS : (word + 1) * _FLAGS]
        bits = [F.when(F.array_contains("m.errors", e), 1 << b).otherwise(0) for b, e in enumerate(mine)]
        return reduce(add, bits, F.lit(0)).cast("long")

    def named(k: str, _: Schema) -> Column:
        on = [(F.col(f"w{i // _FLAGS}").bitwiseAND(1 << i % _FLAGS) != 0, e) for i, e in enumerate(names[k])]
        return F.array_compact(F.array(*[F.when(c, e) for c, e in on])) if on else F.array().cast("array<string>")

    fields = list(dict.fromkeys(f for s in schemas.values() for f in s))
    texts = {f: F.col(f"t{i}") for i, f in enumerate(fields)}
    known = key.isin(*schemas)
    width = switch(lambda _, s: F.lit(len(s)))
    sums = (
        records.where(known)
        .select(*keys, "rec", *[strip(F.col("rec")[f]).alias(f"t{i}") for i, f in enumerate(fields)])
        .select(*keys, is_garbage(F.col("rec")).cast("int").alias("garbage"), switch(measured).alias("m"))
        .select(
            *keys, "garbage", "m.filled", "m.basic", "m.identity", (width - F.size("m.errors")).alias("sound"),
            *[switch(lambda k, _, w=w: flags(k, w)).alias(f"w{w}") for w in range(words)],
        )
        .groupBy(*keys)
        .agg(
            F.count("*").alias("results_count"), F.count_distinct("identity").alias("distinct_ids"),
            *[F.sum(c).alias(c) for c in ("filled", "basic", "sound", "garbage")],
            *[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(words)],
        )
    )
    keep = keys
    if pages is not None:
        keep = pages.columns
        sums = pages.where(known).join(sums, keys, "left").withColumn(
            "results_count", F.coalesce("results_count", F.lit(0)).cast("long")
        )
    return _rated(sums, keep, width, switch(named))
