"""Page cleaning over a table of pages."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill import fixed_values as fv
from leafmill.functions.html import clean_html_udf, page_marks_udf, rule_index
from leafmill.functions.text import url_domain
from leafmill.operators.joins import is_small, lookup_join
from leafmill.session import stage

_RULE_TYPE = "array<struct<id:bigint,rule_type:string,selector:string>>"


def challenge(html: Column) -> Column:
    """First known marker, in list order, as ``struct<type, marker>``; else null."""
    lowered = F.lower(html)
    out = F.lit(None).cast("struct<type:string,marker:string>")
    for marker, kind in reversed(fv.CHALLENGE_MARKERS):
        found = F.struct(F.lit(kind).alias("type"), F.lit(marker).alias("marker"))
        out = F.when(lowered.contains(marker), found).otherwise(out)
    return out


def rules_by_domain(rules: DataFrame) -> DataFrame:
    """Active rules of each domain as one array in id order."""
    return (
        rules.where(F.col("status") == "active")
        .groupBy("domain")
        .agg(
            F.array_sort(F.collect_list(F.struct("id", "rule_type", "selector")))
            .cast(_RULE_TYPE)
            .alias("cleaning_rules")
        )
    )


def _usable(rules: DataFrame) -> DataFrame:
    return rules.where(
        (F.col("status") == "active") & F.col("domain").isNotNull() & F.col("id").isNotNull() & (F.col("selector") != "")
    ).select("domain", F.col("id").cast("long").alias("id"), "rule_type", "selector")


def _share_rules(rules: DataFrame) -> Broadcast:
    """Rules by domain and mark, loaded once by a worker; for rules measured to be few."""
    by_domain: dict[str, list] = {}
    for rule in rules.collect():
        by_domain.setdefault(rule["domain"], []).append(rule)
    index = {domain: rule_index(known) for domain, known in by_domain.items()}
    return rules.sparkSession.sparkContext.broadcast(index)


def _named_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(domain, _page, _rules): the rules that name something on a page.

    For rule tables of any size: pages of domains with rules are parsed for their marks,
    and marks meet rules by (domain, type, selector), html left out. The list of a page is no
    longer than its own marks (a class or tag is named by its first rule alone, as that
    removes all there is), times the rules that name one id.
    """
    named = stage(
        rules.groupBy("domain", "rule_type", "selector").agg(
            F.min("id").alias("first"),
            F.array_sort(F.collect_set(F.when(F.col("rule_type") == "id", F.col("id")))).alias("ids"),
        ),
        "rules-by-mark",
    )
    ruled = lookup_join(pages, named.select("domain").distinct(), ["domain"], "left_semi")
    found = ruled.select("domain", "_page", F.explode(page_marks_udf()("html")).alias("mark"))
    marks = stage(found.select("domain", "_page", "mark.rule_type", "mark.selector"), "page-marks")
    met = lookup_join(marks, named, ["domain", "rule_type", "selector"], "inner").select(
        "domain",
        "_page",
        F.explode(F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.array("first"))).alias("id"),
        "rule_type",
        "selector",
    )
    return met.groupBy("domain", "_page").agg(
        F.array_sort(F.collect_set(F.struct("id", "rule_type", "selector")))
        .cast(_RULE_TYPE)
        .alias("_rules")
    )


def clean_pages(
    pages: DataFrame,
    rules: DataFrame | None = None,
    *,
    profile: str = "standard",
    links: bool = False,
) -> DataFrame:
    """Pages with visible text, the ids of rules that removed something, noise classes.

    ``pages``: url, html and any other columns; html itself is dropped. Pages that show
    a challenge never reach the parser. One pass, no shuffle of html, and no page carries
    rules: those measured to be few (``spark.leafmill.broadcastRows``, ``broadcastChars``) are
    an index that a worker loads once. Beyond that, a first pass finds which rules name
    something on a page (``_named_rules``), and pages meet only those, by domain and a
    digest of the html. ``links`` adds the page's title and anchors (text, url, shown),
    found in the same pass. Rules without an id, a domain or a selector remove nothing.
    """
    out = pages.withColumn("domain", url_domain(F.col("url"))).withColumn(
        "challenge", challenge(F.col("html"))
    )
    html = F.when(F.col("challenge").isNull(), F.col("html"))
    usable = None if rules is None else _usable(rules)
    if usable is None:
        cleaner, by = clean_html_udf(profile, links), F.lit(None).cast(_RULE_TYPE)
    elif is_small(usable):
        cleaner, by = clean_html_udf(profile, links, _share_rules(usable)), F.col("domain")
    else:
        out = out.withColumn("_page", F.sha2(F.coalesce(html, F.lit("")), 256))
        parsed = out.where(F.col("challenge").isNull()).select("domain", "_page", "html")
        named = stage(_named_rules(parsed, usable), "named-rules")
        out = lookup_join(out, named, ["domain", "_page"])
        cleaner, by = clean_html_udf(profile, links), F.col("_rules")
    out = out.withColumn("_clean", cleaner(html, by))
    kept = [c for c in pages.columns if c != "html"]
    text = F.when(F.col("challenge").isNull(), F.col("_clean.text"))
    return out.select(
        *kept,
        "domain",
        "challenge",
        text.alias("text"),
        F.col("_clean.applied_rule_ids").alias("applied_rule_ids"),
        F.col("_clean.noise").alias("noise"),
        *[F.col(f"_clean.{c}").alias(c) for c in ("title", "links") if links],
    )


def is_thin(text: Column) -> Column:
    return F.length(text) < fv.THIN_PAGE_CHARS


def _stop() -> Column:
    """Error type of a page that stops before extraction, else null."""
    return (
        F.when(F.coalesce("domain", F.lit("")) == "", "ValueError")
        .when(F.col("challenge").isNotNull(), "UnsupportedChallengeError")
        .when(is_thin(F.col("text")), "EmptyPageError")
    )


def page_failures(cleaned: DataFrame) -> DataFrame:
    """Pages that stop before extraction, with the error type the classifier expects.

    A URL without a host, or no URL at all, is an error of its own; it is found before the
    page is read.
    """
    return (
        cleaned.withColumn("error_type", _stop())
        .where(F.col("error_type").isNotNull())
        .select(
            "page_id",
            "url",
            "error_type",
            F.col("challenge.type").alias("challenge"),
            F.lit("browser").alias("component"),
        )
    )


def extractable(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(_stop().isNull())


def bounded(text: Column, limit: Column | int = fv.CONTENT_CHARS) -> Column:
    """Text cut to ``limit`` characters, with a flag when something was cut.

    The limits are part of the workflow: they bound what a model request may hold.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.struct(
        F.substring(text, F.lit(1), limit).alias("content"),
        (F.length(text) > limit).alias("truncated"),
    )
