"""Schemas, sinks, the stream and the command audit."""

import csv
import json
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafmill.operators import audit, profiles
from leafmill.sources import schemas, sinks, tables
from leafmill.streaming import profiles as stream


def test_schema_names():
    assert list(schemas.list_schemas()) == sorted(schemas.list_schemas()) and len(schemas.list_schemas()) == 10
    assert schemas.get_schema("job-listings") == schemas.get_schema("Job Listings")
    with pytest.raises(ValueError, match="Available: APARTMENTS, ARTICLES"):
        schemas.get_schema("nothing")
    assert schemas.custom_schema(" name, url ,,") == {"name": "The name value", "url": "The url value"}
    with pytest.raises(ValueError):
        schemas.custom_schema(" , ")


def test_catalog_of_specs(spark):
    own = {"MINE": {"rating": {"type": "number", "min": 0, "max": 5, "required": True}, "x": "An x"}}
    rows = schemas.schema_catalog(spark, own).orderBy("ordinal").collect()
    assert tuple(rows[0])[2:] == ("rating", "", "number", True, 0.0, 5.0)
    assert tuple(rows[1])[2:] == ("x", "An x", None, False, None, None)
    assert schemas.schema_catalog(spark).count() == 64


RECS = [(2, 0, {"b": "1", "a": "x,y"}), (1, 1, {"c": None, "a": 'q"q'}), (1, 0, {"a": "line\nbreak"})]


@pytest.fixture
def records(spark):
    df = spark.createDataFrame(RECS, "page_id long, rec_ord int, rec map<string,string>")
    return df.withColumn("rec_json", F.to_json("rec"))


def test_csv(spark, records, tmp_path):
    out = str(tmp_path / "csv")
    assert sinks.save_csv(records, out)
    back = spark.read.option("header", True).option("multiLine", True).csv(out)
    assert back.columns[0] == "a" and set(back.columns) == {"a", "b", "c"} and back.count() == 3
    assert not sinks.save_csv(records.where("false"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def _csv_rows(folder):
    """All rows of the part files, by Python's reader; every file has its own header."""
    rows = []
    for part in sorted(folder.glob("part-*")):
        with open(part, newline="", encoding="utf-8") as f:
            lines = list(csv.reader(f))
        rows += [(tuple(lines[0]), tuple(x)) for x in lines[1:]]
    return rows


def test_csv_values_survive(spark, tmp_path):
    odd = ["x,y", 'q"q', "line\nbreak", " blank ends ", "", None, "a\r\nb", "a\rb", "naïve"]
    data = [(i, 0, {"k,1": v, "b": "1"}) for i, v in enumerate(odd)]
    df = spark.createDataFrame(data, "page_id long, rec_ord int, rec map<string,string>").repartition(3)
    assert sinks.save_csv(df, str(tmp_path / "odd"))
    rows = _csv_rows(tmp_path / "odd")
    assert {h for h, _ in rows} == {("k,1", "b")}
    assert sorted(v for _, v in rows) == sorted((v or "", "1") for v in odd)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "odd"))
    assert back.count() == len(odd) and back.where("`k,1` = 'q\"q'").count() == 1
    one = spark.createDataFrame([(1, 0, {"a": None}), (2, 0, {"a": "x"})], df.schema).coalesce(1)
    assert sinks.save_csv(one, str(tmp_path / "one"))
    assert sorted(v for _, v in _csv_rows(tmp_path / "one")) == [("",), ("x",)]


def test_csv_of_very_many_keys(spark, tmp_path):
    """50,000 distinct keys: the plan has one column, not one for each."""
    n = 50_000
    rec = F.create_map(F.concat(F.lit("k"), F.col("id")), F.col("id").cast("string"))
    df = spark.range(n).where("id % 2500 < 2").select(F.col("id").alias("page_id"), F.lit(0).alias("rec_ord"), rec.alias("rec"))
    wide = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.concat(F.lit("k"), i), i.cast("string")))
    one = spark.range(1).select(F.lit(n).cast("long").alias("page_id"), F.lit(0).alias("rec_ord"), F.map_from_entries(wide).alias("rec"))
    assert sinks.csv_lines(df.unionByName(one)).columns == ["value"]
    assert sinks.save_csv(df.unionByName(one), str(tmp_path / "wide"))
    rows = _csv_rows(tmp_path / "wide")
    assert len(rows) == 41 and all(len(h) == n == len(v) and set(h) == {f"k{i}" for i in range(n)} for h, v in rows[:3])
    header, last = rows[-1]
    assert all(f"k{v}" == h for h, v in zip(header, last, strict=True))


def test_json(spark, records, tmp_path):
    out = tmp_path / "json"
    sinks.save_json(records, str(out))
    lines = [json.loads(x) for f in out.glob("part-*") for x in f.read_text().splitlines()]
    assert {"a": "line\nbreak"} in lines and len(lines) == 3


def test_preview(spark):
    rows = [(i, 0, {"a": "x" * 50, "b": None}) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, rec_ord int, rec map<string,string>")
    out = sinks.preview(df, {f: "" for f in "abcdefgh"})
    assert out.columns == ["page_id", "rec_ord", *"abcdef"] and out.count() == 25
    first = out.first()
    assert (first["a"], first["b"], first["c"]) == ("x" * 40, "None", "")


def test_history_is_split_by_day(spark, tmp_path):
    rows = [(i, "a", 0.5, datetime(2024, 1, 1 + i % 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, domain string, quality_score double, ts timestamp")
    path = str(tmp_path / "history")
    tables.append_history(df, path)
    tables.append_history(df, path)
    assert spark.read.parquet(path).count() == 18
    assert {p.name for p in Path(path).glob("day=*")} == {"day=2024-01-01", "day=2024-01-02", "day=2024-01-03"}


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    rows = [("hot" if i % 3 else f"d{i % 7}", datetime(2024, 1, 1) + timedelta(seconds=i), i, (i * 37 % 1001) / 1000) for i in range(900)]
    ddl = "domain string, ts timestamp, id long, quality_score double"
    df = spark.createDataFrame(rows, ddl)
    src, root = str(tmp_path / "in"), str(tmp_path / "out")
    for lo in (0, 300, 600):
        df.where(F.col("id").between(lo, lo + 299)).coalesce(1).write.mode("append").parquet(src)
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
    stream.start_profile_stream(source, root, checkpoint=str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert len(list((tmp_path / "out" / "domain_profiles").glob("v[0-9]*"))) == 3
    key = lambda df: sorted(tuple(r) for r in df.collect())
    columns = [c for c, _, _ in tables.LAYOUTS["domain_profiles"]]
    want = profiles.fold_profiles(df).select(*columns)
    assert key(stream.current_profiles(spark, root).select(*columns)) == key(want)
    # A repeated batch changes nothing.
    stream.profile_updater(root, str(tmp_path / "cp"))(df.where("id >= 600"), 2)
    assert key(stream.current_profiles(spark, root).select(*columns)) == key(want)
    # A new checkpoint over the same table goes on from there, though its batches count from 0.
    later = spark.createDataFrame([("new", datetime(2024, 2, 1), 901, 0.5), ("hot", datetime(2024, 2, 1), 902, 0.1)], ddl)
    later.coalesce(1).write.parquet(str(tmp_path / "in2"))
    source = spark.readStream.schema(ddl).parquet(str(tmp_path / "in2"))
    stream.start_profile_stream(source, root, checkpoint=str(tmp_path / "cp2"), available_now=True).awaitTermination()
    want = profiles.fold_profiles(df.unionByName(later)).select(*columns)
    assert key(stream.current_profiles(spark, root).select(*columns)) == key(want)


def test_ordered_stream_equals_the_batch_fold_of_rows_out_of_order(spark, tmp_path):
    """Rows up to 200 s late, a hot domain, a null domain, repeats; stopped and started again in between."""
    ddl = "domain string, ts timestamp, id long, quality_score double"
    rng = random.Random(3)
    day = datetime(2024, 1, 1)
    rows = [("hot" if i % 3 else None if i % 4 == 0 else f"d{i % 7}", day + timedelta(seconds=i), i, (i * 37 % 1001) / 1000) for i in range(1200)]
    rows += rows[5:9] + [("hot", day + timedelta(seconds=7), 2000, None), ("x", None, 2001, 0.5)]
    arrival = sorted(rows, key=lambda r: ((r[1] or day) - day).seconds + rng.randrange(200))
    src, root, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")

    def go_on(part):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(src)
        source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(src)
        query = stream.start_ordered_profile_stream(source, root, checkpoint=cp, delay="200 seconds", slice_seconds=30, available_now=True)
        query.awaitTermination()
        return query

    columns = [c for c, _, _ in tables.LAYOUTS["domain_profiles"]]
    key = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    go_on(arrival[:700])
    go_on(arrival[700:])
    want = profiles.fold_profiles(spark.createDataFrame([r for r in rows if r[1]], ddl))
    assert key(stream.ordered_profiles(spark, root, cp)) == key(want)
    assert 0 < stream.waiting_rows(spark, cp).count() < 600  # the rest is folded already
    # A row older than the watermark is dropped and counted; a much later row completes all others.
    late = go_on([("hot", day, 3000, 0.0), ("z", day + timedelta(days=1), 3001, 0.5)])
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in late.recentProgress) > 0
    go_on([("z", day + timedelta(days=1, seconds=1), 3002, 0.5)])
    assert key(stream.current_profiles(spark, root)) == key(want)


def verdicts(spark, lines, mode, **kw):
    df = spark.createDataFrame([(i, c, mode) for i, c in enumerate(lines)], "id long, command string, mode string")
    rows = audit.audit_commands(df, workspace="/srv/app", **kw).orderBy("id").collect()
    return [(r["action"], r["failed_check"]) for r in rows]


def test_read_only_mode(spark):
    lines = ["git status", "touch x", "git commit -m x", "rm -rf /", "sudo touch x", "cat a > b", "sed -i s/a/b/ f", "sudo -u me git push"]
    assert verdicts(spark, lines, "read_only") == [
        ("allow", None), ("block", "read_only_check"), ("block", "read_only_check"), ("block", "destructive_check"),
        ("block", "read_only_check"), ("block", "read_only_check"), ("block", "sed_validation"), ("allow", None),
    ]


def test_workspace_mode(spark):
    lines = ["cp x ../other", "cp x ~/other", "cp /srv/app/../x y", "cp x /etc/", "cat /etc/passwd", "echo $HOME"]
    assert verdicts(spark, lines, "workspace_write") == [
        ("block", "path_validation"), ("block", "path_validation"), ("allow", None), ("block", "workspace_boundary"),
        ("allow", None), ("block", "path_validation"),
    ]


def test_full_mode_warns(spark):
    assert verdicts(spark, ["rm -rf .", "cat ../x", "cp x /etc/y"], "full") == [
        ("warn", "destructive_check"), ("warn", "path_validation"), ("allow", None),
    ]


def test_lists_come_first(spark):
    got = verdicts(spark, ["rm -rf /", "node x", ""], "read_only", allow=["rm"], block=["node"])
    assert got == [("allow", None), ("block", "custom_blocklist"), ("allow", None)]


@pytest.mark.parametrize(
    "line, first, intent",
    [
        ("  ls -la|wc", "ls", "read_only"),
        ("env -i A=1 make all", "make", "unknown"),
        ("env A=1", "", "unknown"),
        ("a;b && c", "a", "unknown"),
        ('"git" push', "git", "network"),
        ("git", "git", "read_only"),
        ("git --no-pager log", "git", "read_only"),
        ("git rebase x", "git", "write"),
        ("sudo", "sudo", "system_admin"),
        ("sudo -n rm x", "sudo", "destructive"),
        ("sudo env sudo ls", "sudo", "system_admin"),
        ("echo 'unclosed", "echo", "read_only"),
        ("my\\ tool x", "my tool", "unknown"),
        ("apt-get update", "apt-get", "package_management"),
        ("kill 1", "kill", "process_management"),
        ("passwd me", "passwd", "system_admin"),
        ("ping host", "ping", "network"),
        ("sed -i x", "sed", "write"),
        ("sed x", "sed", "read_only"),
        ("Get-Date", "Get-Date", "read_only"),
    ],
)
def test_intent(spark, line, first, intent):
    row = audit.with_intent(spark.createDataFrame([(line,)], "command string")).first()
    assert (row["first_command"], row["intent"]) == (first, intent)


def test_totals_count_by_verdict(spark):
    df = spark.createDataFrame([("sed -i x", "read_only"), ("ls", "read_only"), ("rm -rf .", "full")], "command string, mode string")
    out = {r["mode"]: r for r in audit.audit_totals(audit.audit_commands(df, workspace="/w")).collect()}
    assert (out["read_only"]["blocked"], out["read_only"]["allowed"]) == (1, 1)
    assert (out["full"]["warnings"], out["full"]["total_validations"]) == (1, 1)
