"""Prompts and cleaning rules against loops over their rows."""

import random
import threading
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leafmill.operators import profiles, prompts, requests, rules
from leafmill.sources import tables
from leafmill.sources.files import create_once

T0 = datetime(2024, 1, 1)
CANDIDATE = "id long, ts timestamp, domain string, schema_name string, extra_instructions string, baseline_quality double, times_used long"


def candidates(spark, rows):
    return spark.createDataFrame([(i, T0, d, "s", f"text {i}", b, 0) for i, d, b in rows], CANDIDATE)


def measured(spark, rows):
    return spark.createDataFrame(rows, "id long, quality double")


def status(df):
    return {r["id"]: r["status"] for r in df.collect()}


def test_prompt_life(spark):
    saved = prompts.save_candidates(candidates(spark, [(1, "a", 0.5), (2, "a", 0.5), (3, "b", 0.5)]).withColumn("minimum_improvement", F.lit(0.1)))
    assert {r["id"]: r["version"] for r in saved.collect()} == {1: 1, 2: 2, 3: 1}
    judged = prompts.judge_candidates(saved, measured(spark, [(1, 0.55), (2, 0.7)]))
    assert status(judged) == {1: "rejected", 2: "accepted", 3: "candidate"}
    assert {r["id"]: r["candidate_quality"] for r in judged.collect()} == {1: 0.55, 2: 0.7, 3: None}
    again = prompts.judge_candidates(judged, measured(spark, [(1, 0.99), (2, 0.0)]))
    assert status(again) == status(judged)
    best = prompts.best_prompts(judged).collect()
    assert [(r["domain"], r["id"]) for r in best] == [("a", 2)]
    ids = spark.createDataFrame([(2,), (3,)], "id long")
    back = prompts.roll_back(judged, ids)
    assert status(back) == {1: "rejected", 2: "rolled_back", 3: "candidate"}
    assert prompts.best_prompts(back).count() == 0


def test_best_prompt_prefers_quality_then_version(spark):
    saved = prompts.save_candidates(candidates(spark, [(i, "a", 0.1) for i in range(1, 5)]))
    judged = prompts.judge_candidates(saved, measured(spark, [(1, 0.6), (2, 0.9), (3, 0.9), (4, 0.5)]))
    assert prompts.best_prompts(judged).first()["id"] == 3
    uses = spark.createDataFrame([("a", "s")] * 5 + [("b", "s")], "domain string, schema_name string")
    used = prompts.count_usage(judged, uses)
    assert {r["id"]: r["times_used"] for r in used.collect()} == {1: 0, 2: 0, 3: 5, 4: 0}


def test_versions_go_on_and_trusted_prompts_are_accepted(spark):
    old = prompts.save_candidates(candidates(spark, [(1, "a", 0.5), (2, "a", 0.5)]))
    trusted = candidates(spark, [(9, "a", 0.4), (10, "c", 0.4)]).withColumnRenamed("baseline_quality", "quality")
    out = {r["id"]: r for r in prompts.import_trusted(trusted, old).collect()}
    assert (out[9]["version"], out[10]["version"]) == (3, 1)
    assert out[9]["status"] == "accepted" and out[9]["candidate_quality"] == 0.4 and out[9]["minimum_improvement"] == 0.0


def test_versions_of_one_hot_domain(spark):
    rows = [(i, "hot" if i % 3 else f"d{i % 17}", 0.1) for i in range(1500)]
    saved = prompts.save_candidates(candidates(spark, rows).repartition(6))
    versions = sorted(r["version"] for r in saved.where("domain = 'hot'").collect())
    assert versions == list(range(1, 1001))


# --- rules ---------------------------------------------------------------------
EVIDENCE = "domain string, rule_type string, selector string, ts timestamp, id long, reason string, evidence string, confidence double, explicit boolean"


def evidence_rows(seed, n=1500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        selector = "hot" if rng.random() < 0.4 else f"s{rng.randrange(25)}"
        explicit = rng.random() < 0.01
        rows.append(
            (f"d{rng.randrange(2)}", rng.choice(["class", "class", "id", "xpath"]), selector, T0 + timedelta(seconds=rng.randrange(300)), i,
             f"r{i % 7}", "explicit-feedback" if explicit else f"e{rng.randrange(14)}",
             1.0 if explicit else rng.choice([0.05, 0.1, 0.3, 0.55, 1.2, -1.0]), explicit)
        )
    return rows


def loop(rows, start=None):
    out = {k: dict(v) for k, v in (start or {}).items()}
    for domain, kind, selector, ts, i, reason, piece, conf, explicit in sorted(rows, key=lambda r: (r[3], r[4])):
        if kind not in ("class", "id", "tag"):
            continue
        conf = min(max(conf, 0.0), 1.0)
        rule = out.get((domain, kind, selector))
        if rule is None:
            rule = {"conf": conf, "n": 1, "pieces": [piece], "status": "candidate"}
        else:
            pieces = rule["pieces"] if piece in rule["pieces"] else [*rule["pieces"], piece]
            rule = {
                "conf": 1 - (1 - rule["conf"]) * (1 - conf), "n": rule["n"] + 1,
                "pieces": pieces[-10:], "status": rule["status"],
            }
            if rule["status"] == "candidate" and rule["n"] >= 2 and rule["conf"] >= 0.7:
                rule["status"] = "active"
        rule["reason"] = reason
        if explicit:
            rule["status"], rule["n"] = "active", max(2, rule["n"])
        out[(domain, kind, selector)] = rule
    return out


def check(df, want):
    got = {(r["domain"], r["rule_type"], r["selector"]): r for r in df.collect()}
    assert set(got) == set(want)
    for key, rule in want.items():
        row = got[key]
        assert row["evidence"] == rule["pieces"], key
        assert (row["evidence_count"], row["status"], row["reason"]) == (rule["n"], rule["status"], rule["reason"])
        assert row["confidence"] == pytest.approx(rule["conf"], abs=1e-9)
    return got


def test_evidence_fold(spark):
    rows = evidence_rows(1)
    got = check(rules.fold_evidence(spark.createDataFrame(rows, EVIDENCE)), loop(rows))
    first = {}
    for r in sorted(rows, key=lambda r: (r[3], r[4])):
        if r[1] != "xpath":
            first.setdefault(r[:3], len(first) + 1)
    assert {k: r["id"] for k, r in got.items()} == first


def test_evidence_fold_goes_on_from_older_rules(spark):
    rows = evidence_rows(2)
    cut = T0 + timedelta(seconds=120)
    old, new = [r for r in rows if r[3] < cut], [r for r in rows if r[3] >= cut and r[2] != "s3"]
    before = rules.fold_evidence(spark.createDataFrame(old, EVIDENCE))
    before = before.withColumn("status", F.when(F.col("selector") == "s5", "disabled").otherwise(F.col("status")))
    start = loop(old)
    for key, rule in start.items():
        if key[2] == "s5":
            rule["status"] = "disabled"
    after = rules.fold_evidence(spark.createDataFrame(new, EVIDENCE), before)
    got = check(after, loop(new, start))
    kept = {(r["domain"], r["rule_type"], r["selector"]): r["id"] for r in before.collect()}
    assert all(got[k]["id"] == i for k, i in kept.items())
    assert len({r["id"] for r in got.values()}) == len(got)


def test_rule_life(spark):
    once = [("a", "class", "promo", T0, 1, "r", "e1", 0.55, False)]
    twice = [*once, ("a", "class", "promo", T0, 2, "r", "e2", 0.55, False)]
    assert rules.fold_evidence(spark.createDataFrame(once, EVIDENCE)).first()["status"] == "candidate"
    active = rules.fold_evidence(spark.createDataFrame(twice, EVIDENCE))
    assert rules.rules_of(active).count() == 1
    off = rules.disable_rules(active, active.select("id"))
    assert rules.rules_of(off).count() == 0 and rules.rules_of(off, active_only=False).count() == 1


def test_feedback_makes_rules_or_is_rejected(spark):
    details = ['{"rule_type":"class","selector":"x"}', '{"rule_type":"css","selector":"x"}', '{"rule_type":"id"}', "no", "[]"]
    rows = [(i, T0, "a", "cleaning_rule", d) for i, d in enumerate(details)] + [(9, T0, "a", "note", "no")]
    feedback = spark.createDataFrame(rows, "id long, ts timestamp, domain string, feedback_type string, details string")
    wishes, rejected = rules.feedback_rules(feedback)
    made = rules.fold_evidence(rules.explicit_rules(wishes)).first()
    assert (made["status"], made["evidence_count"], made["confidence"]) == ("active", 2, 1.0)
    assert sorted(r["id"] for r in rejected.collect()) == [1, 2, 3, 4]


RULE = "id long, status string, times_applied long, positive_outcomes long, negative_outcomes long, last_quality double"
OUTCOME = "rule_id long, ts timestamp, id long, quality double, baseline_quality double"


def test_outcomes(spark):
    rng = random.Random(8)
    state = {
        i: [rng.choice(["active", "active", "candidate", "disabled"]), rng.randrange(2, 4), rng.choice([0, 0, 0, 1]), rng.randrange(3), None]
        for i in range(120)
    }
    for i in range(120, 150):
        state[i] = ["active", 0, 0, 0, None]
    rows = [
        (0 if rng.random() < 0.3 else rng.randrange(150), T0 + timedelta(seconds=rng.randrange(99)), i, rng.choice([0.2, 0.48, 0.5, 0.52, 0.53]), 0.5)
        for i in range(700)
    ]
    made = spark.createDataFrame([(i, *s) for i, s in state.items()], RULE)
    out = rules.fold_outcomes(made, spark.createDataFrame(rows, OUTCOME))
    for rule, ts, i, q, b in sorted(rows, key=lambda r: (r[1], r[2])):
        s = state[rule]
        s[1] += 1
        s[2] += q >= b + 0.02
        s[3] += q < b - 0.05
        s[4] = q
        if s[0] == "active" and s[1] >= 2 and s[2] == 0 and s[3] >= 2:
            s[0] = "disabled"
    got = {r["id"]: [r["status"], r["times_applied"], r["positive_outcomes"], r["negative_outcomes"], r["last_quality"]] for r in out.collect()}
    assert got == state


def test_two_bad_outcomes_disable_an_explicit_rule(spark):
    made = rules.with_outcome_columns(
        rules.fold_evidence(
            rules.explicit_rules(spark.createDataFrame([("a", "class", "x", T0, 1)], "domain string, rule_type string, selector string, ts timestamp, id long"))
        )
    )
    rows = [(1, T0, 1, 0.3, 0.8), (1, T0, 2, 0.2, 0.8)]
    one = rules.fold_outcomes(made, spark.createDataFrame(rows[:1], OUTCOME)).first()
    two = rules.fold_outcomes(made, spark.createDataFrame(rows, OUTCOME)).first()
    assert (one["status"], two["status"], two["last_quality"]) == ("active", "disabled", 0.2)


def test_settings(spark):
    known = profiles.fold_profiles(spark.createDataFrame([("a", T0, 1, 0.1)], "domain string, ts timestamp, id long, quality_score double"))
    judged = prompts.judge_candidates(prompts.save_candidates(candidates(spark, [(1, "a", 0.1), (2, "b", 0.9)])), measured(spark, [(1, 0.9), (2, 0.9)]))
    made = spark.createDataFrame([(1, "a", "class", "x", "active"), (2, "a", "id", "y", "candidate")], "id long, domain string, rule_type string, selector string, status string")
    pages = spark.createDataFrame([("a",), ("b",)], "domain string")
    out = {r["domain"]: r for r in requests.page_settings(pages, known, judged, made, "s", default_wait=3.0).collect()}
    assert (out["a"]["wait_seconds"], out["a"]["learned"], out["a"]["extra_instructions"]) == (4.0, True, "text 1")
    assert [x["selector"] for x in out["a"]["cleaning_rules"]] == ["x"]
    assert (out["b"]["wait_seconds"], out["b"]["learned"], out["b"]["extra_instructions"], out["b"]["cleaning_rules"]) == (3.0, False, "", None)


def test_large_lookups_join_like_small_ones(spark):
    from leafmill.operators.joins import lookup_join

    domain = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None)
    big = spark.range(0, 5000).select(domain.otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("domain"), "id")
    look = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3)], "domain string, v int")
    rows = lambda df: sorted(tuple(str(x) for x in r) for r in df.select(*sorted(df.columns)).collect())
    for how in ("left", "inner", "left_semi", "left_anti"):
        small = lookup_join(big, look, ["domain"], how)
        split = lookup_join(big, look, ["domain"], how, max_rows=1, hot_share=0.1)
        salted = lookup_join(big, look, ["domain"], how, max_rows=1, max_chars=1, hot_share=0.1)
        plain = lookup_join(big, look, ["domain"], how, max_rows=1, hot_share=1)
        assert rows(small) == rows(split) == rows(salted) == rows(plain)
        assert split.columns == salted.columns == small.columns
        none = lookup_join(big.limit(0), look, ["domain"], how, max_rows=1)
        assert none.count() == 0 and none.columns == small.columns


def test_broadcast_bounds_are_settings(spark):
    from leafmill.operators.joins import is_small

    table = spark.range(10)
    assert is_small(table)
    spark.conf.set("spark.leafmill.broadcastRows", "9")
    try:
        assert not is_small(table)
    finally:
        spark.conf.unset("spark.leafmill.broadcastRows")


def test_tables_keep_versions_and_upgrade(spark, tmp_path):
    root = str(tmp_path)
    assert tables.read_table(spark, root, "feedback").count() == 0
    first = spark.createDataFrame([("a", 2.5)], "domain string, wait_seconds double")
    assert tables.write_table(first, root, "domain_profiles") == 0
    old = tables.read_table(spark, root, "domain_profiles")
    row = old.first()
    assert (row["wait_seconds"], row["avg_quality"], row["total_scrapes"], row["last_scraped"]) == (2.5, 0.0, 0, None)
    assert tables.write_table(old.withColumn("wait_seconds", F.lit(9.0)), root, "domain_profiles") == 1
    assert tables.read_table(spark, root, "domain_profiles").first()["wait_seconds"] == 9.0
    half = tmp_path / "domain_profiles" / "v2"
    half.mkdir()  # a version that was never finished is not in the log
    assert tables.read_table(spark, root, "domain_profiles").first()["wait_seconds"] == 9.0
    old_history = spark.createDataFrame([(1, "a")], "id long, domain string")
    up = tables.upgrade(old_history, "extraction_history").first()
    assert (up["uncertainty"], up["issues"], up["model_used"]) == (1.0, [], "")


def test_concurrent_writers_both_land(spark, tmp_path):
    """Both start from the same version; the slower one reads the other's and goes on from there."""
    root, schema = str(tmp_path), "domain string, wait_seconds double"
    meet = threading.Barrier(2)

    def add(name):
        waited = []

        def change(old):
            mine = spark.createDataFrame([(name, 1.0)], schema)
            if not waited:  # both have read before either writes
                waited.append(meet.wait(60))
            return mine if old is None else old.select("domain", "wait_seconds").unionByName(mine)

        return tables.update_table(spark, root, "domain_profiles", change)

    with ThreadPoolExecutor(2) as pool:
        made = list(pool.map(add, ["a", "b"]))
    assert sorted(made) == [0, 1]
    assert sorted(r.domain for r in tables.read_table(spark, root, "domain_profiles").collect()) == ["a", "b"]
    with pytest.raises(tables.VersionConflict):
        tables.write_table(spark.createDataFrame([("c", 1.0)], schema), root, "domain_profiles", base=0)
    assert tables.newest_version(spark, root, "domain_profiles") == 1


def test_expiry_keeps_versions_in_force(spark, tmp_path):
    root, schema = str(tmp_path), "domain string, wait_seconds double"
    for n in range(4):
        tables.write_table(spark.createDataFrame([("a", float(n))], schema), root, "domain_profiles", stream="s", batch=n)
    (tmp_path / "domain_profiles" / "data-unfinished").mkdir()
    assert tables.expire_versions(spark, root, "domain_profiles", keep=1) == []  # all are too young
    gone = tables.expire_versions(spark, root, "domain_profiles", keep=2, idle_hours=0)
    assert len(gone) == 3 and "data-unfinished" in gone
    assert tables.read_table(spark, root, "domain_profiles").first()["wait_seconds"] == 3.0
    assert tables.read_table(spark, root, "domain_profiles", 2).first()["wait_seconds"] == 2.0
    assert tables.holds_batch(spark, root, "domain_profiles", "s", 0)
    assert tables.update_table(spark, root, "domain_profiles", lambda old: old, stream="s", batch=1) is None
    with pytest.raises(ValueError):
        tables.expire_versions(spark, root, "domain_profiles", keep=0)
    assert tables.expire_versions(spark, root, "nothing", idle_hours=0) == []


def test_create_once(spark, tmp_path):
    path = str(tmp_path / "log" / "v0.json")
    assert create_once(spark, path, "one") and not create_once(spark, path, "two")
    assert open(path).read() == "one" and not list((tmp_path / "pending").glob("[!.]*"))


def test_evidence_with_a_null_in_its_key_is_rejected(spark):
    """It makes no rule; rules of an older table stay, and their evidence with them."""
    schema = "domain string, rule_type string, selector string, ts timestamp, id long, reason string, evidence string, confidence double, explicit boolean"
    at = datetime(2024, 1, 1)
    keys = [("a", "class", "x"), (None, "class", "x"), ("a", None, "x"), ("a", "class", None), ("a", "xpath", "x")]
    rows = [(*k, at, n, "r", f"e{n}", 0.5, False) for n, k in enumerate(keys)]
    evidence = spark.createDataFrame(rows, schema)
    assert sorted(r.id for r in rules.rejected_evidence(evidence).collect()) == [1, 2, 3, 4]
    first = rules.fold_evidence(evidence)
    assert [(r.domain, r.selector, r.evidence_count, r.evidence) for r in first.collect()] == [("a", "x", 1, ["e0"])]
    old = first.unionByName(first.select(*[F.lit(None).cast("string").alias(c) if c == "domain" else F.lit(9).cast("long").alias(c) if c == "id" else F.col(c) for c in first.columns]))
    again = rules.fold_evidence(evidence, old).collect()
    assert sorted((r.domain or "", r.id, r.evidence_count, r.evidence) for r in again) == [("", 9, 1, ["e0"]), ("a", 1, 2, ["e0"])]
