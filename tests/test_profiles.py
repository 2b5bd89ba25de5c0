"""Ordered folds against a loop; most tests give one domain most of the rows."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.operators import profiles
from leafmill.operators.ordered import chunked, chunked_row_number, compose_stretches, compose_tables, fold_lists, last_distinct, scan_states, sort_rows, value_changes

T0 = datetime(2024, 1, 1)


def history(seed=3, n=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        domain = "hot" if rng.random() < 0.5 else f"d{rng.randrange(40)}"
        level = rng.choice([0.1, 0.3, 0.5, 0.8, 0.95])
        score = round(min(1.0, max(0.0, rng.gauss(level, 0.2))), 3)
        rows.append((domain, T0 + timedelta(seconds=rng.randrange(900)), i, score))
    return rows


def loop(rows, start=None):
    """Profiles by going through the rows one by one."""
    out = dict(start or {})
    for domain, ts, i, q in sorted(rows, key=lambda r: (r[1], r[2])):
        wait, avg, n, ok, _ = out.get(domain, (2.0, None, 0, 0, None))
        avg = q if avg is None else round(0.3 * q + (1 - 0.3) * avg, 3)
        if q < 0.35:
            wait = min(wait + 2.0, 15.0)
        elif q >= 0.85:
            wait = max(wait - 0.5, 1.0)
        out[domain] = (wait, avg, n + 1, ok + (q >= 0.35), ts)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "domain string, ts timestamp, id long, quality_score double")


def result(df):
    return {
        r["domain"]: (r["wait_seconds"], r["avg_quality"], r["total_scrapes"], r["total_successes"], r["last_scraped"])
        for r in df.collect()
    }


def test_hot_domain_covers_several_chunks(spark):
    parts = chunked(frame(spark, history()), ["domain"], ["ts", "id"])
    assert parts.where("domain = 'hot'").select("_chunk").distinct().count() > 2


def test_fold_equals_loop_however_the_rows_lie(spark):
    rows = history()
    want = loop(rows)
    df = frame(spark, rows)
    assert result(profiles.fold_profiles(df)) == want
    assert result(profiles.fold_profiles(df.repartition(11))) == want


def test_fold_continues_from_older_profiles(spark):
    rows = history(seed=5)
    cut = T0 + timedelta(seconds=300)
    old = [r for r in rows if r[1] < cut and r[0] != "d1"]
    new = [r for r in rows if r[1] >= cut and r[0] != "d2"]
    prior = profiles.fold_profiles(frame(spark, old))
    assert result(profiles.fold_profiles(frame(spark, new), prior)) == loop(new, loop(old))


def test_own_waits_and_rows_that_do_not_learn(spark):
    rng = random.Random(12)
    rows = [
        (*r, rng.choice([None, None, None, 7.0, 5.0, 14.5, 1.0, 15.0]), rng.random() < 0.8) for r in history(seed=10)
    ]
    want = {}
    for domain, ts, i, q, used, learn in sorted(rows, key=lambda r: (r[1], r[2])):
        wait = want.get(domain, 2.0)
        now = wait if used is None else used
        new = min(now + 2.0, 15.0) if q < 0.35 else max(now - 0.5, 1.0) if q >= 0.85 else now
        want[domain] = new if learn and new != now else wait
    ddl = "domain string, ts timestamp, id long, quality_score double, wait_used double, learn_wait boolean"
    out = profiles.fold_profiles(spark.createDataFrame(rows, ddl))
    assert {r["domain"]: r["wait_seconds"] for r in out.collect()} == want
    scores = loop([r[:4] for r in rows])
    assert {d: v[1:] for d, v in result(out).items()} == {d: v[1:] for d, v in scores.items()}


def test_average_and_success_counts(spark):
    out = profiles.fold_profiles(frame(spark, [("a", T0, 1, 1.0), ("a", T0, 2, 0.0)])).first()
    assert (out["avg_quality"], out["total_scrapes"], out["total_successes"]) == (0.7, 2, 1)


def test_every_average_step_is_the_documented_rounding():
    moves = profiles.average_moves()
    rng = random.Random(2)
    for _ in range(20_000):
        q, a = rng.randrange(1001), rng.randrange(1001)
        assert moves[q, a] == round(round(0.3 * (q / 1000) + (1 - 0.3) * (a / 1000), 3) * 1000)


def test_scores_that_are_none_are_rejected(spark):
    rows = [("a", T0, i, q) for i, q in enumerate([1.2, 0.5, -0.2, None, float("nan")])]
    df = spark.createDataFrame(rows, "domain string, ts timestamp, id long, quality_score double")
    out = profiles.fold_profiles(df).first()
    assert (out["avg_quality"], out["total_scrapes"], out["total_successes"]) == (0.5, 1, 1)
    assert sorted(r["id"] for r in profiles.rejected_scores(df).collect()) == [0, 2, 3, 4]


def test_own_default_wait_is_stored_once_it_moved(spark):
    df = frame(spark, [("still", T0, 1, 0.5), ("poor", T0, 2, 0.1), ("good", T0, 3, 0.9)])
    out = profiles.fold_profiles(df, default_wait=4.0).collect()
    assert {r["domain"]: r["wait_seconds"] for r in out} == {"still": 2.0, "poor": 6.0, "good": 3.5}


def test_learned_wait_defaults(spark):
    known = profiles.fold_profiles(frame(spark, [("a", T0, 1, 0.0)]))
    asked = spark.createDataFrame([("a",), ("b",)], "domain string")
    got = {r["domain"]: r["wait_seconds"] for r in profiles.learned_wait(asked, known).collect()}
    assert got == {"a": 4.0, "b": 2.0}


def test_last_rows_and_trend(spark):
    rows = [("up", T0 + timedelta(seconds=i), i, 0.2 if i < 5 else 0.6) for i in range(10)]
    rows += [("short", T0, 100 + i, 0.5) for i in range(9)]
    rows += [("flat", T0, 200 + i, 0.5) for i in range(60)]
    rows += [("down", T0 + timedelta(seconds=i), 300 + i, 0.9 - 0.08 * i) for i in range(10)]
    df = frame(spark, rows).withColumn(
        "issues", F.when(F.col("domain") == "up", F.array(F.lit("LOW_FILL_RATE"), F.lit("A"))).otherwise(F.array())
    )
    last = profiles.last_rows(df, 20)
    assert last.where("domain = 'flat'").count() == 20
    assert [r["id"] for r in last.where("domain = 'flat'").orderBy("rank").collect()] == list(range(259, 239, -1))
    out = {r["domain"]: r for r in profiles.diagnose_domains(df, profiles.fold_profiles(df)).collect()}
    assert {d: r["trend"] for d, r in out.items()} == {
        "up": "improving", "short": "unknown", "flat": "stable", "down": "declining",
    }
    assert out["flat"]["total_attempts"] == 50 and out["flat"]["success_rate"] == 1.0
    assert [tuple(i) for i in out["up"]["common_issues"]] == [("A", 10), ("LOW_FILL_RATE", 10)]
    assert out["up"]["recommendations"] == ["Review the domain-specific schema field labels."]
    assert out["down"]["recommendations"] == []


def test_limit_reaches_the_map_side(spark):
    plan = profiles.last_rows(frame(spark, history(n=50)))._jdf.queryExecution().toString()
    assert plan.index("WindowGroupLimit") and "Partial" in plan


def test_row_numbers(spark):
    rows = history(seed=9, n=2000)
    df = frame(spark, rows)
    want = defaultdict(int)
    expected = {}
    for domain, ts, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        want[domain] += 1
        expected[i] = want[domain]
    got = {r["id"]: r["rn"] for r in chunked_row_number(df, ["domain"], ["ts", "id"]).collect()}
    assert got == expected
    whole = {r["id"]: r["rn"] for r in chunked_row_number(df, [], ["ts", "id"]).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert whole == {r[2]: n for n, r in enumerate(order, 1)}


def test_scan_gives_the_state_before_each_row(spark):
    rng = random.Random(4)
    table = np.array([[1, 2, 3, 3], [0, 0, 0, 3], [2, 1, 0, 3]], dtype=np.int32)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(30)}", i, rng.randrange(3)) for i in range(3000)]
    state, want = {}, {}
    for key, i, s in rows:
        want[i] = state.get(key, 0)
        state[key] = int(table[s, want[i]])
    df = spark.createDataFrame(rows, "key string, i long, s int").repartition(5)
    out = scan_states(df, ["key"], ["i"], "s", table, 0)
    assert {r["i"]: r["_before"] for r in out.collect()} == want


def _queues(rows):
    want = defaultdict(list)
    for key, _, v in rows:
        if v not in want[key]:
            want[key] = [*want[key], v][-10:]
    return dict(want)


def test_lists_are_exact_across_chunks(spark):
    """First in, first out of ten, with few repeats: what a chunk ends with depends on
    what it began with."""
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", i, str(rng.randrange(14))) for i in range(2000)]
    rows += [("few", i, rng.choice(["a", "b", None])) for i in range(2000, 2100)]

    def extend(items, item):
        return items if item in items else [*items, item][-10:]

    df = spark.createDataFrame(rows, "key string, i long, v string").repartition(5)
    for lists in (fold_lists(df, ["key"], ["i"], "v", extend, rounds=1), fold_lists(df, ["key"], ["i"], "v", extend, rounds=9), last_distinct(df, ["key"], ["i"], "v", 10)):
        assert {r["key"]: r["_list"] for r in lists.collect()} == _queues(rows)
    assert last_distinct(df.limit(0), ["key"], ["i"], "v", 10).count() == 0


@pytest.mark.parametrize("values", [6, 11, 40])
def test_lists_take_few_jobs_for_many_chunks(spark, values):
    """Eleven values never forget the order in which they came first."""
    rng = random.Random(values)
    rows = [("hot", i, str(rng.randrange(values))) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, i long, v string")
    jobs = {}
    for chunks in (8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", str(chunks))
        spark.sparkContext.setJobGroup(f"lists-{values}-{chunks}", "")
        try:
            got = last_distinct(df, ["key"], ["i"], "v", 10).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "7")
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs[chunks] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"lists-{values}-{chunks}"))
        assert {r["key"]: r["_list"] for r in got} == _queues(rows)
    assert 0 < jobs[64] <= (jobs[8] if values == 6 else 40), jobs


def test_hot_domain_over_500_chunks(spark):
    """Its stretches are put together in pairs; the result is that of the plain loop."""
    rows = sorted(("hot", T0 + timedelta(seconds=i), i, q) for i, (_, _, _, q) in enumerate(history(seed=9, n=2500)))
    parts = profiles._profile_parts()
    stretches = []
    for chunk in range(500):
        q = np.array([round(r[3] * 1000) for r in rows[chunk * 5 : chunk * 5 + 5]])
        columns = {"_q": q, "_used": np.full(len(q), np.nan), "_learn": np.full(len(q), True)}
        states = [p.absorb(p.new(True), *(columns[c] for c in p.columns)) for p in parts]
        stretches.append(("hot", chunk, *states))
    schema = "domain string, _chunk int, " + ", ".join(f"{p.name} {p.ddl}" for p in parts)
    add = lambda a, b: a + b
    together = {"_n": add, "_ok": add, "_moves": add, "_avg": compose_tables, "_wait": profiles._then_wait}
    made = compose_stretches(spark.createDataFrame(stretches, schema), ["domain"], together).collect()
    assert len(made) == 1 and len(made[0]["_avg"]) == 1  # all entries agree long before the end
    shift, low, high = made[0]["_wait"]
    want = loop(rows)["hot"]
    assert (min(high, max(low, 2.0 + shift)), made[0]["_avg"][0] / 1000, made[0]["_n"], made[0]["_ok"]) == want[:4]


def test_only_changes_of_values_are_kept(spark):
    """A key with a third of the rows, mostly repeats: its walk is its changes."""
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", i, f"v{i // 90 % 12}") for i in range(9000)]
    df = spark.createDataFrame(rows, "key string, i long, v string")
    changes = value_changes(sort_rows(df, ["key"], ["i"]), ["key"], "v").cache()
    chunks = changes.select("_chunk").distinct().count()
    assert changes.where("key = 'hot'").count() <= 100 + chunks  # of 3,000 rows
    extend = lambda items, item: items if item in items else [*items, item][-10:]
    want = {}
    for key, _, v in rows:
        want[key] = extend(want.get(key, []), v)
    assert {r.key: r["_list"] for r in fold_lists(df, ["key"], ["i"], "v", extend).collect()} == want


def test_null_domains_go_on_from_their_row(spark):
    first = profiles.fold_profiles(frame(spark, [(None, T0, 1, 0.5), ("a", T0, 2, 1.0)]))
    more = frame(spark, [(None, T0 + timedelta(seconds=5), 3, 1.0), ("a", T0 + timedelta(seconds=5), 4, 0.0)])
    got = result(profiles.fold_profiles(more, first))
    want = loop([(None, T0, 1, 0.5), ("a", T0, 2, 1.0), (None, T0 + timedelta(seconds=5), 3, 1.0), ("a", T0 + timedelta(seconds=5), 4, 0.0)])
    assert got == want and got[None][2] == 2
