"""Strategy tables: layouts, versions, upgrade and append."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafmill import fixed_values as fv
from leafmill.sources.files import create_once, list_dirs, remove_dir

# Column layouts with the value an older row gets for a column it lacks.
LAYOUTS: dict[str, list[tuple[str, str, object]]] = {
    "domain_profiles": [
        ("domain", "string", None),
        ("wait_seconds", "double", 2.0),
        ("avg_quality", "double", 0.0),
        ("total_scrapes", "bigint", 0),
        ("total_successes", "bigint", 0),
        ("total_failures", "bigint", 0),
        ("last_scraped", "timestamp", None),
    ],
    "extraction_history": [
        ("id", "bigint", None),
        ("url", "string", None),
        ("domain", "string", None),
        ("schema_name", "string", None),
        ("results_count", "bigint", 0),
        ("quality_score", "double", 0.0),
        ("confidence", "double", 0.0),
        ("uncertainty", "double", 1.0),
        ("fill_rate", "double", 0.0),
        ("duration_secs", "double", 0.0),
        ("prompt_version", "int", 0),
        ("model_used", "string", ""),
        ("issues", "array<string>", "array()"),
        ("ts", "timestamp", None),
    ],
    "prompt_refinements": [
        ("id", "bigint", None),
        ("domain", "string", None),
        ("schema_name", "string", None),
        ("version", "int", 1),
        ("extra_instructions", "string", ""),
        ("status", "string", "candidate"),
        ("baseline_quality", "double", 0.0),
        ("candidate_quality", "double", None),
        ("minimum_improvement", "double", 0.05),
        ("latency_ms", "double", 0.0),
        ("input_tokens", "bigint", 0),
        ("output_tokens", "bigint", 0),
        ("times_used", "bigint", 0),
        ("ts", "timestamp", None),
    ],
    "cleaning_rules": [
        ("id", "bigint", None),
        ("domain", "string", None),
        ("rule_type", "string", None),
        ("selector", "string", None),
        ("action", "string", "remove"),
        ("reason", "string", ""),
        ("confidence", "double", 0.0),
        ("evidence_count", "bigint", 0),
        ("evidence", "array<string>", "array()"),
        ("status", "string", "candidate"),
        ("times_applied", "bigint", 0),
        ("positive_outcomes", "bigint", 0),
        ("negative_outcomes", "bigint", 0),
        ("last_quality", "double", None),
        ("created_at", "timestamp", None),
        ("updated_at", "timestamp", None),
    ],
    "feedback": [
        ("id", "bigint", None),
        ("url", "string", None),
        ("domain", "string", None),
        ("schema_name", "string", None),
        ("feedback_type", "string", None),
        ("details", "string", ""),
        ("ts", "timestamp", None),
    ],
}


def layout(name: str) -> StructType:
    return StructType.fromDDL(", ".join(f"{c} {t}" for c, t, _ in LAYOUTS[name]))


def upgrade(df: DataFrame, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` in the present layout: columns an older table lacks get their defaults.

    A value that is present, null included, is kept. ``keep`` names further columns to keep.
    """
    out = []
    for column, kind, default in LAYOUTS[name]:
        if column in df.columns:
            out.append(F.col(column).cast(kind).alias(column))
        elif default == "array()":
            out.append(F.array().cast(kind).alias(column))
        else:
            out.append(F.lit(default).cast(kind).alias(column))
    return df.select(*out, *keep)


def _reject_reason(df: DataFrame, name: str) -> Column:
    """Why a row of the older store cannot be used (the first reason that holds), else null."""
    reason = F.lit(None).cast("string")
    have = lambda c: F.col(c) if c in df.columns else F.lit(None)
    tests = []
    if name == "cleaning_rules":
        supported = F.coalesce(have("rule_type").isin(fv.RULE_TYPES), F.lit(False))
        unread = have("supporting_evidence").isNotNull() & F.from_json(have("supporting_evidence").cast("string"), "array<string>").isNull()
        tests = [
            ("no domain", have("domain").isNull()), ("no selector", have("selector").isNull()),
            ("unsupported rule type", ~supported), ("evidence is no list", unread),
        ]
    elif name == "extraction_history":
        scored = F.coalesce(have("quality_score").cast("double").between(0.0, 1.0), F.lit(False))
        tests = [("no domain", have("domain").isNull()), ("no score from 0 to 1", ~scored)]
    elif name != "feedback":
        tests = [("no domain", have("domain").isNull())]
    for why, holds in reversed(tests):
        reason = F.when(holds, why).otherwise(reason)
    return reason


def import_legacy(df: DataFrame, name: str, *, rejects: bool = False) -> DataFrame:
    """Rows of the older row store in the present layout.

    There, times are seconds since 1970 (0 for never), issues a comma-joined text, and
    pieces of evidence a JSON list. Columns that did not exist yet get their defaults.
    With ``rejects``, a column ``rejected`` says why a row cannot be used (null for good ones),
    so that one pass gives both; no row is left out either way.
    """
    whole = df.withColumn("rejected", _reject_reason(df, name)) if rejects else df
    renamed = {"timestamp": "ts", "error": "issues", "supporting_evidence": "evidence"}
    kinds = {c: t for c, t, _ in LAYOUTS[name]}
    out = {}
    for column in df.columns:
        target = renamed.get(column, column)
        if name == "prompt_refinements" and column == "created_at":
            target = "ts"
        kind, value = kinds.get(target), F.col(column)
        if kind is None:
            continue
        if kind == "timestamp":
            value = F.when(value > 0, F.timestamp_micros((value * 1_000_000).cast("long")))
        elif column == "error":
            value = F.filter(F.split(F.coalesce(value, F.lit("")), ", "), lambda i: i != "")
        elif column == "supporting_evidence":
            value = F.coalesce(
                F.from_json(value, kind), F.array().cast(kind)
            )
        out[target] = value.alias(target)
    if not rejects:
        return upgrade(df.select(*out.values()), name)
    whole = whole.select(*out.values(), "rejected")
    return upgrade(whole, name, keep=("rejected",))


_LOG = "version long, stream string, batch long, folder string"


class VersionConflict(RuntimeError):
    """Another writer has made the version that was to be written."""


def _log(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The log of complete versions; those of a stream name it and its batch."""
    try:
        return spark.read.schema(_LOG).json(f"{root}/{name}/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def newest_version(spark: SparkSession, root: str, name: str) -> int | None:
    """The highest version in the log of complete versions."""
    log = _log(spark, root, name)
    return None if log is None else log.agg(F.max("version")).first()[0]


def holds_batch(spark: SparkSession, root: str, name: str, stream: str, batch: int) -> bool:
    """Has this stream's batch become a version already?"""
    log = _log(spark, root, name)
    if log is None:
        return False
    return not log.where((F.col("stream") == stream) & (F.col("batch") == batch)).isEmpty()


def read_table(
    spark: SparkSession, root: str, name: str, version: int | None = None
) -> DataFrame:
    """A version of a strategy table, the newest by default; empty when there is none."""
    log = _log(spark, root, name)
    if log is not None and version is None:
        version = log.agg(F.max("version")).first()[0]
    if version is None:
        return spark.createDataFrame([], layout(name))
    found = None if log is None else log.where(F.col("version") == version).first()
    folder = found and found["folder"] or f"v{version}"
    return upgrade(spark.read.parquet(f"{root}/{name}/{folder}"), name)


def write_table(
    df: DataFrame,
    root: str,
    name: str,
    *,
    base: int | None = None,
    stream: str | None = None,
    batch: int | None = None,
) -> int:
    """Write the next version beside the one that may still be read.

    Every attempt has a folder of its own, and a version counts once its log file exists. That
    file is made by one exclusive step, so of two writers one gets the version. A job
    that dies half way leaves the old version in force. ``base`` is the version that ``df`` was made
    from (-1: none): if a newer one exists by the end, ``VersionConflict`` is raised
    and nothing counts. Without it the rows replace whatever is newest. The log keeps
    ``stream`` and ``batch`` of a micro-batch.
    """
    spark = df.sparkSession
    last = newest_version(spark, root, name)
    folder = f"v{0 if last is None else last + 1}-{uuid.uuid4().hex}"
    upgrade(df, name).write.parquet(f"{root}/{name}/{folder}")
    while True:
        last = newest_version(spark, root, name)
        last = -1 if last is None else last
        if base is not None and last != base:
            raise VersionConflict(f"{name}: version {last} is newer than {base}")
        record = {"version": last + 1, "stream": stream, "batch": batch, "folder": folder}
        if create_once(spark, f"{root}/{name}/log/v{last + 1}.json", json.dumps(record) + "\n"):
            return last + 1


def update_table(
    spark: SparkSession,
    root: str,
    name: str,
    change: Callable[[DataFrame | None], DataFrame],
    *,
    stream: str | None = None,
    batch: int | None = None,
    tries: int = 20,
) -> int | None:
    """``change`` applied to the newest version (None if there is none), as the next version.

    Where another writer was faster, its version is read and ``change`` applied to that, so no
    writer loses another's rows. A micro-batch that is in the log already is not
    applied again, and None returned.
    """
    for _ in range(tries):
        if stream is not None and holds_batch(spark, root, name, stream, batch):
            return None
        last = newest_version(spark, root, name)
        new = change(None if last is None else read_table(spark, root, name, last))
        try:
            return write_table(new, root, name, base=-1 if last is None else last, stream=stream, batch=batch)
        except VersionConflict:
            continue
    raise VersionConflict(f"{name}: {tries} attempts were overtaken by other writers")


def expire_versions(
    spark: SparkSession, root: str, name: str, *, keep: int = 5, idle_hours: float = 24
) -> list[str]:
    """Remove data of all but the newest ``keep`` versions, and of attempts that never counted.

    The newest version always stays, and so does a folder that was changed within ``idle_hours``: a
    job may still read or write it. The log stays whole, so version numbers
    and micro-batches are known for good. Returns the removed folders.
    """
    if keep < 1:
        raise ValueError("the newest version stays: keep must be at least 1")
    folders = list_dirs(spark, f"{root}/{name}")  # before the log: a new version is no leftover
    log = _log(spark, root, name)
    newest = [] if log is None else log.orderBy(F.desc("version")).limit(keep).collect()
    held = {r["folder"] or f"v{r['version']}" for r in newest}
    old = [f for f, hours in folders if f not in held | {"log", "pending"} and hours >= idle_hours]
    for folder in old:
        remove_dir(spark, f"{root}/{name}/{folder}")
    return old


def append_history(df: DataFrame, path: str) -> None:
    """Add extraction rows, split by day: reports read the days they need.

    Rows are rebalanced by day first, so that a day gets files of a sensible size
    instead of one from every task, and a large day is still written by many tasks.
    """
    rows = upgrade(df, "extraction_history").withColumn("day", F.to_date("ts"))
    rows.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def append_feedback(df: DataFrame, path: str) -> None:
    upgrade(df, "feedback").write.mode("append").parquet(path)
