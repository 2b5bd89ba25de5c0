"""Views of the given tables as inputs of the workflow.

The tables hold no extraction data, so each view derives some from a whole table:
its size grows with the table, and the same derivation is written in SQL for the
check of the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import url_domain


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index: Column, *values) -> Column:
    """The value at ``index`` of a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _score(value: Column) -> Column:
    return F.least(F.floor(value * 2 + 0.5), F.lit(1000)) / 1000.0


def _event_domain() -> Column:
    return F.concat(F.lit("d"), F.col("user_id") % 50, F.lit(".example.org"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extraction history from ``events``: fifty domains, issues by event type."""
    kind = F.col("event_type")
    issues = (
        F.when(kind == "error", F.array(F.lit("NO_RESULTS")))
        .when(kind == "view", F.array(F.lit("LOW_FILL_RATE"), F.lit("LOW_VALIDITY")))
        .when(kind == "click", F.array(F.lit("GARBAGE_CONTENT")))
        .otherwise(F.array().cast("array<string>"))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        _event_domain().alias("domain"),
        kind.alias("schema_name"),
        F.col("ts").cast("timestamp").alias("ts"),
        _score(F.col("value")).alias("quality_score"),
        issues.alias("issues"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures from the error events; a job is a user."""
    i = F.col("event_id")
    kind = pick(
        i % 11, "TimeoutError", "RateLimitError", "LLMParseError", "LLMExtractionError",
        "LLMProviderError", "UnsupportedChallengeError", "EmptyPageError",
        "BrowserCrashedError", "HTTPError", "ConnectionResetError", "RuntimeError",
    )
    status = pick(i % 6, None, 429, 408, 503, 404, None).cast("int")
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "error")
        .select(
            F.concat(F.lit("job-"), F.col("user_id")).alias("job_id"),
            i.alias("id"),
            F.col("ts").cast("timestamp").alias("ts"),
            kind.alias("error_type"),
            F.when(i % 11 == 8, status).alias("status_code"),
            F.when(i % 11 == 10, status).alias("response_status"),
            pick(i % 3, "cloudflare", "captcha", "aws_waf").alias("challenge"),
            pick(i % 2, "llm", "browser").alias("component"),
            pick(i % 4, True, False, None, True).alias("retry_ok"),
            F.lit("RuntimeError").alias("retry_error"),
            pick(i % 5, "small", "large", "small", "small", "small").alias("model"),
        )
    )


PART_SCHEMA = {
    "title": "Part name",
    "price": "Price with currency",
    "rating": {"type": "number", "required": True, "min": 1, "max": 45},
    "url": {"type": "url", "required": True},
    "contact_email": "Address for questions",
    "updated": "Day of the last change",
    "rooms": "Number of rooms",
}


def part_records(spark: SparkSession, sf_dir: str, page: str = "small") -> DataFrame:
    """Records from ``part``; nulls, missing keys and every kind of bad value occur.

    ``page='small'`` puts up to four records on a page, ``'brand'`` one page per brand.
    """
    k, size = F.col("p_partkey"), F.col("p_size")
    title = (
        F.when(size % 7 == 0, F.lit(None))
        .when(k % 11 == 0, "Placeholder item")
        .when(k % 13 == 0, " TITLE ")
        .otherwise(F.col("p_name"))
    )
    price = (
        F.when(k % 9 == 0, "call us")
        .when(k % 10 == 0, "now - 5.00")
        .otherwise(F.concat(F.lit("$"), F.floor("p_retailprice")))
    )
    rating = F.when(k % 17 == 0, "n/a").when(k % 21 == 0, "-").otherwise(size.cast("string"))
    url = (
        F.when(k % 8 == 0, F.concat(F.lit("/p/"), k))
        .when(k % 23 == 0, "N/A")
        .otherwise(F.concat(F.lit("https://shop.example.com/p/"), F.floor(k / 2)))
    )
    email = F.when(k % 6 == 0, "not an email").otherwise(
        F.concat(F.lit("sales@"), F.lower("p_type"), F.lit(".example"))
    )
    updated = pick(k % 5, "2024-01-15", "soon", "12/31/99", "20240115", "1850-02-30")
    rooms = F.when(k % 12 == 0, "-3 rooms").otherwise((size % 5).cast("string"))
    cells = {
        "title": title, "price": price, "rating": rating, "url": url,
        "contact_email": email, "updated": updated, "rooms": rooms,
    }
    rec = F.create_map(*[x for n, c in cells.items() for x in (F.lit(n), c)])
    present = F.map_filter(
        rec, lambda n, v: ~(((n == "title") & (k % 29 == 0)) | ((n == "rating") & (k % 19 == 0)))
    )
    if page == "brand":
        page_id = F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")
    else:
        page_id = F.when(k % 50 == 0, k + 1_000_000_000).otherwise(F.floor(k / 4))
    return (
        table(spark, sf_dir, "part")
        .select(page_id.alias("page_id"), k.alias("rec_ord"), present.alias("rec"))
        .withColumn("rec_json", F.to_json("rec"))
    )


def part_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses from ``part``: good, fenced, broken and unusable ones."""
    k = F.col("p_partkey")
    obj = F.format_string(
        '{"title": "%s", "url": "/p/%d", "price": %d, "stock": {"left": %d, "ok": true}}',
        "p_name", k, F.floor("p_retailprice"), "p_size",
    )
    fence = "```"
    variants = [
        F.concat(F.lit("["), obj, F.lit("]")),
        F.concat(F.lit(f"{fence}json\n["), obj, F.lit(f"]\n{fence}\n")),
        obj,
        F.concat(F.lit("not json: "), "p_name"),
        F.lit(" \n "),
        F.concat(F.lit("[1, "), obj, F.lit("]")),
        F.lit("[]"),
        F.concat(F.lit(" ["), obj, F.lit(", "), F.replace(obj, F.lit("/p/"), F.lit("https://cdn.example.com/")), F.lit("]")),
        F.concat(obj, F.lit(" trailing")),
        F.concat(F.lit(fence), obj, F.lit(fence)),
    ]
    raw = F.element_at(F.array(*variants), (k % 10 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("page_id"),
        raw.alias("raw_output"),
        F.when(size_even(), F.col("p_size")).otherwise(0).cast("long").alias("prompt_tokens"),
        (F.col("p_size") * 10).cast("long").alias("input_tokens"),
        (k % 100).cast("long").alias("output_tokens"),
        (F.col("p_retailprice") / 10).alias("latency_ms"),
        F.lower("p_type").alias("model"),
    )


def size_even() -> Column:
    return F.col("p_size") % 2 == 0


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages the part responses belong to."""
    host = F.lower(F.regexp_replace("p_brand", "#", ""))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_id"),
        F.concat(F.lit("https://"), host, F.lit(".example.com/list/"), "p_partkey").alias("url"),
    )


def part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts for those pages: ``documents`` dealt out by id; the URL where there is no text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_doc"), F.col("text"))
    return (
        part_pages(spark, sf_dir)
        .withColumn("_doc", F.col("page_id") % max(1, docs.count()))
        .join(docs, "_doc", "left")
        .select("page_id", F.coalesce("text", "url").alias("text"))
    )


def prompt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt candidates and their measured quality, from ``orders``."""
    cents = F.floor("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("c"), F.col("o_custkey") % 100, F.lit(".example.org")).alias("domain"),
        F.col("o_orderpriority").alias("schema_name"),
        F.concat(F.lit("Prefer list "), "o_orderkey").alias("extra_instructions"),
        F.lit(0).cast("long").alias("times_used"),
        ((cents % 600) / 1000.0).alias("baseline_quality"),
        ((F.floor(cents / 7) % 1000) / 1000.0).alias("quality"),
        F.col("o_orderstatus").alias("order_status"),
    )


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for cleaning rules, from ``events``; some of it explicit, some unusable."""
    i = F.col("event_id")
    explicit = (F.col("event_type") == "signup") & (F.col("user_id") % 4 == 0)
    return table(spark, sf_dir, "events").select(
        _event_domain().alias("domain"),
        pick(i % 7, "class", "class", "id", "class", "tag", "class", "xpath").alias("rule_type"),
        F.col("event_type").alias("selector"),
        F.col("ts").cast("timestamp").alias("ts"),
        i.alias("id"),
        F.concat(F.lit("seen "), i % 13).alias("reason"),
        F.concat(F.lit("count="), F.floor(F.col("value") / 8)).alias("evidence"),
        (0.05 + (i % 5) * 0.1).alias("confidence"),
        explicit.alias("explicit"),
    )


def outcome_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule per user of ``events``, in different states."""
    u = F.col("user_id")
    return (
        table(spark, sf_dir, "events")
        .groupBy("user_id")
        .agg(F.lit(1).alias("one"))
        .select(
            u.alias("id"),
            pick(u % 4, "active", "candidate", "active", "active").alias("status"),
            (u % 3).cast("long").alias("times_applied"),
            F.when(u % 5 == 0, 1).otherwise(0).cast("long").alias("positive_outcomes"),
            (u % 3).cast("long").alias("negative_outcomes"),
            F.lit(None).cast("double").alias("last_quality"),
        )
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("rule_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        i.alias("id"),
        _score(F.col("value")).alias("quality"),
        ((i * 37 % 300) / 1000.0).alias("baseline_quality"),
    )


BLOCKS = [
    "",
    '<div style="color:red;DISPLAY : none">hidden <b>words</b></div>',
    '<div class="Cookie-Bar wide">cookie <p>words</p></div>',
    '<div class="g-recaptcha">prove it</div>',
    "<iframe src='x'>frame words</iframe><svg><text>drawn</text></svg>"
    "<noscript>no script</noscript><aside>side words</aside><header>head words</header>",
    '<div class="site-banner">banner words</div>',
    '<section id="promo">first offer</section><section id="promo">second offer</section>'
    '<i class="promo-card">one</i><i class="x promo-card">two</i>',
    "",
]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with blocks that the cleaner must treat, by page number; one page in
    eight is reduced to a letter."""
    k = F.col("page_id") % 8
    with_block = F.replace(
        F.col("html"), F.lit("<article>"), F.concat(F.lit("<article>"), pick(k, *BLOCKS))
    )
    html = F.when(k == 7, "<html><body>x</body></html>").otherwise(with_block)
    return pages(spark, sf_dir).select("page_id", "url", html.alias("html"))


#: A schema of a user's own: plain descriptions beside typed fields.
TYPED_SCHEMA = {
    "name": "What it is called",
    "price": {"description": "What it costs", "type": "number", "required": True, "min": 0, "max": 99.5},
    "seen": {"type": "date"},
    "stock": {"description": "Pieces left", "type": "integer", "min": 1},
}


#: Anchors of every form, and two that are no links.
ANCHORS = (
    "<a href='/single'>one</a><A class=\"x\" HREF=/bare>two</A>"
    '<p><a title="a>b" href="/nested?q=1&amp;r=2"><b>three</b> &amp; <i>four</i></a></p>'
    '<aside><a\nhref = "/aside">five</a></aside><a name="top">no target</a>'
    '<!-- <a href="/comment">c</a> --><a href="/empty"></a>'
)


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` with anchors of every form before the article's own text."""
    html = F.replace(F.col("html"), F.lit("<article>"), F.lit("<article>" + ANCHORS))
    return pages(spark, sf_dir).select("page_id", "url", html.alias("html"))


def page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules for every domain of ``pages``; the tag rule is not active everywhere."""
    base = (
        pages(spark, sf_dir)
        .select(url_domain(F.col("url")).alias("domain"), "page_id")
        .groupBy("domain")
        .agg((F.min("page_id") * 10).alias("base"))
    )
    kinds = F.array(
        *[
            F.struct(F.lit(n).alias("n"), F.lit(t).alias("rule_type"), F.lit(s).alias("selector"))
            for n, t, s in ((1, "class", "ad"), (2, "id", "promo"), (3, "tag", "h1"))
        ]
    )
    return base.select("domain", "base", F.explode(kinds).alias("_k")).select(
        (F.col("base") + F.col("_k.n")).alias("id"),
        "domain",
        "_k.rule_type",
        "_k.selector",
        F.when((F.col("_k.n") == 3) & (F.col("base") % 20 == 0), "candidate")
        .otherwise("active")
        .alias("status"),
    )


def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score, fill rate and issues per page, from its number."""
    k = F.col("page_id")
    return pages(spark, sf_dir).select(
        "page_id",
        ((k * 7 % 100) / 100.0).alias("score"),
        ((k * 3 % 100) / 100.0).alias("fill_rate"),
        F.when(k % 3 == 0, F.array(F.lit("GARBAGE_CONTENT"), F.lit("LOW_VALIDITY")))
        .when(k % 3 == 1, F.array(F.lit("LOW_FILL_RATE"), F.lit("MANY_DUPLICATES")))
        .otherwise(F.array().cast("array<string>"))
        .alias("issues"),
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command log from ``events``: three modes, every kind of command."""
    i, u = F.col("event_id"), F.col("user_id")
    text = pick(
        i % 28,
        "git status", "touch notes-{u}.txt", "rm -rf /", "ls -la | grep {u}",
        "sudo -E apt-get install pkg{u}", "env A=1 B={u} python run.py", "cp a ../up-{u}",
        "cat ~/file-{u}", "sed -i s/a/b/ f{u}", "curl https://example.org/{u} > out",
        "kill {u}", "git commit -m 'fix {u}'", "git -p push origin", "shred disk{u}",
        "echo {u} && rm x", "'my tool' --n {u}", "cp /etc/hosts h{u}", "  ", "node app{u}.js",
        "dd if=/dev/zero of=f{u}", "sudo cat /etc/passwd", "echo \"open {u}",
        "find . -name f{u} -delete; ls", "rm -r -f dir{u}", "chmod -R 777 d{u}",
        "head ../../shared/{u}", "sudo", "git",
    )
    return table(spark, sf_dir, "events").select(
        i.alias("id"),
        F.replace(text, F.lit("{u}"), u.cast("string")).alias("command"),
        pick(F.floor(i / 28) % 3, "read_only", "workspace_write", "full").alias("mode"),
    )
