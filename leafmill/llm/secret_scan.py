"""Secret scans with a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression a Boolean query over trigrams is derived: alternatives,
of each of which all trigrams must occur. The index holds postings (trigram, document) for
every trigram that a rule names. Postings are intersected by counting, for each document
and alternative, the trigrams met; documents that meet an alternative are candidates, and
the expression itself is run over them. A rule without mandatory trigrams scans all texts.

Postings are keyed by a hash of id and text: two documents under one key could only add a
candidate, which the expression then judges for itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import row_key, shared_table


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules (fixed values). Runs are greedy, so a minimum length inside the pattern
#: of ``hex`` finds just the whole runs that are long enough.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
)


def _texts(nodes, most: int = 64) -> list[tuple[str, ...]]:
    """What an expression must contain: alternatives, each a sequence of literal texts with gaps between."""
    out = [("",)]
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            new = [(chr(arg).lower(),)]
        elif name == "SUBPATTERN":
            new = _texts(arg[3])
        elif name == "BRANCH":
            new = [alt for branch in arg[1] for alt in _texts(branch)]
        elif name.endswith("REPEAT"):
            low, high, inner = arg
            once = _texts(inner)
            new = [("", "")]
            if low == high == 1:
                new = once
            elif low == 0 and high == 1:
                new = [("",), *once]
            elif low:  # at least once, then a gap
                new = [(*alt, "") for alt in once]
        elif name == "AT":
            new = [("",)]
        else:
            new = [("", "")]
        if len(new) * len(out) > most:
            new = [("", "")]
        joined = ((*a[:-1], a[-1] + b[0], *b[1:]) for a, b in product(out, new))
        out = list(dict.fromkeys(joined))
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of trigrams (lower case), one of which every match contains; None if there are none."""
    parsed = re._parser.parse(pattern)  # the parse tree of the standard library's own expressions
    found = [frozenset(t[i : i + 3] for t in alt for i in range(len(t) - 2)) for alt in _texts(parsed)]
    return sorted(set(found), key=sorted) if all(found) else None


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index for these trigrams: (trigram, key), one row for each that a text contains."""
    low = F.lower("text")
    present = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("low"), t))
    return texts.select("key", low.alias("low")).select("key", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(key, kinds): the rules of which a document meets an alternative."""
    spark = index.sparkSession
    wanted = [
        (kind, n, trigram, len(alt)) for kind, alts in queries.items() for n, alt in enumerate(alts) for trigram in sorted(alt)
    ]
    terms = spark.createDataFrame(wanted, "kind string, alternative int, trigram string, needed int")
    met = (
        index.join(F.broadcast(terms), "trigram")  # as many rows as the rules name trigrams
        .groupBy("key", "kind", "alternative", "needed")
        .agg(F.size(F.collect_set("trigram")).alias("met"))
        .filter("met = needed")
    )
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule) -> Column:
    """Leftmost matches that do not overlap, as array of (start, end) in code points."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda g: F.length(g) >= rule.least)
    rows = F.arrays_zip(gaps.alias("gap"), F.transform(matches, F.length).alias("size"), kept.alias("kept"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(done: Column, row: Column) -> Column:
        start = done["at"] + row["gap"]
        end = start + row["size"]
        found = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(
            F.coalesce(end, start).alias("at"),
            F.when(row["kept"], F.concat(done["found"], found)).otherwise(done["found"]).alias("found"),
        )

    walked = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda done: done["found"])
    return F.when(F.size(matches) > 0, walked).otherwise(none)


def _named(spans: Column, nth: int, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"), s["end"].alias("end"), F.lit(kind).alias("kind")),
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its findings: ``id_col``, ``secrets`` array of (start, nth, end, kind).

    ``nth`` is the rule's place in ``rules``; the array is sorted by start, then rule.
    Offsets are code points, ends exclusive. Null and empty texts have no findings;
    repeated rows have each their own; an empty table gives no rows; other columns are not
    read, whatever their names.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("key", row_key("id", "text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {kind: alts for kind, alts in queries.items() if alts}
    if indexed:
        trigrams = sorted({t for alts in indexed.values() for alt in alts for t in alt})
        index = shared_table(postings(texts, trigrams), "postings")
        texts = texts.join(candidates(index, indexed), "key", "left")
    else:
        texts = texts.withColumn("kinds", F.lit(None).cast("array<string>"))
    found = []
    for n, rule in enumerate(rules):
        where = spans(F.col("text"), rule)
        if rule.kind in indexed:
            where = F.when(F.array_contains("kinds", rule.kind), where).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        texts = texts.withColumn(f"_{n}", where)
        found.append(_named(F.col(f"_{n}"), n, rule.kind))
    return texts.select(F.col("id").alias(id_col), F.array_sort(F.concat(*found)).alias("secrets"))
