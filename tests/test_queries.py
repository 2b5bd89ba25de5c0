"""All registered queries against their SQL on the smallest tables."""

import hashlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from leafmill.plans.queries import QUERIES as OWN

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def counted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(r[i]) for i in order) for r in rows)


def test_every_query_has_sql():
    assert set(OWN) <= set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and out.columns[0] == "domain"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = counted(df.columns, df.collect())
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == counted(columns, cur.fetchall())


def test_refinement_requests_sample_page_texts(spark, sf, con):
    rows = QUERIES["refinement_requests"](spark, sf).collect()
    md5 = {
        r["page_id"]: hashlib.md5(
            r["user_content"].rpartition("\n\nPage sample:\n")[2].removesuffix("\n\nReturn only the improved extraction instructions.").encode()
        ).hexdigest()
        for r in rows
    }
    ids = ",".join(map(str, md5))
    want = con.execute(f"""
        SELECT p_partkey, md5(substr(text, 1, 3000)), length(text)
        FROM part JOIN documents ON doc_id = p_partkey % (SELECT count(*) FROM documents) WHERE p_partkey IN ({ids})""").fetchall()
    assert len(md5) == len(rows) == len(want) and md5 == {i: m for i, m, _ in want}
    assert sum(n > 3000 for *_, n in want) > 0


def test_refinement_requests(spark, sf):
    rows = QUERIES["refinement_requests"](spark, sf).collect()
    assert rows and all(r["user_content"].startswith("Analyze this extraction") for r in rows)
