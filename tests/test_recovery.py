"""Sliced neighbours against plain windows, appends, outboxes and blob cuts row by row, recovery plans by hand."""

import random

from oxbow.operators import history as H
from oxbow.operators import ingest as I
from oxbow.operators import recovery as R
from pyspark.sql import Window
from pyspark.sql import functions as F


def test_neighbours_across_slices_equal_a_plain_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, *range(9)])) for i in rng.sample(range(5000), 600)]
    df = spark.createDataFrame(rows, "k string, i long, v long").repartition(5)
    w = Window.partitionBy("k").orderBy("i")
    up = w.rowsBetween(Window.unboundedPreceding, -1)
    d = H.beside(df, ["k"], F.floor(F.col("i") / 7), ["i"], "before", F.col("v"))
    d = H.beside(d, ["k"], F.floor(F.col("i") / 1000), ["i"], "after", F.col("v"), ahead=True)
    d = H.running(d, ["k"], F.floor(F.col("i") / 50), ["i"], "top", F.col("v"), largest=True)
    want = df.select("k", "i", F.lag("v").over(w).alias("before"), F.lead("v").over(w).alias("after"), F.max("v").over(up).alias("top"))
    rows = lambda x: sorted(map(tuple, x.select("k", "i", "before", "after", "top").collect()), key=repr)
    assert rows(d) == rows(want)
    assert H.beside(df.where("false"), ["k"], F.col("i"), ["i"], "x", F.col("v")).count() == 0


def test_blob_cuts():
    items = [(1, 5, 0), (1, 5, 10), (1, 1, 20), (1, 1, 200), (1, 1, 210)]
    assert list(I.cut_blob(iter(items), 10, 100)) == [(0, ""), (0, "size"), (1, ""), (1, "linger"), (2, "")]
    assert list(I.cut_blob(iter(items), 10, 100, polled=True)) == [(0, ""), (0, "size"), (1, ""), (2, ""), (2, "")]


def test_continuity_rules():
    box = I.Continuity(2)
    assert box.drained
    assert [box.admit(1, 0), box.admit(1, 3), box.admit(1, 3), box.admit(2, 1), box.admit(3, 1)] == ["Empty", "Admitted", "Duplicate", "Admitted", "Full"]
    assert box.commit(1) == "Committed"
    assert box.admit(3, 1) == "Admitted"
    assert list(box.pending) == [2, 3]
    assert not box.drained
    box.commit(2), box.commit(3)
    assert box.drained
    assert box.admit(1, 3) == "Duplicate"


def test_appends(spark):
    good = dict(kind="chunk", item=0, n=2, meta_ok=True, cohort_ok=True, generation_ok=True, frame_ok=True, ref_n=2, ref_id_ok=True, ref_digest_ok=True)
    rows = [
        dict(good, pos=1, base=0),
        dict(good, pos=2, base=0),
        dict(good, pos=3, base=2, cohort_ok=False, frame_ok=False),
        dict(good, pos=4, base=2, kind="ref", ref_n=3),
        dict(good, pos=5, base=2, kind="batch"),
        dict(good, pos=5, base=4, kind="batch", item=1),
        dict(good, pos=6, base=6, kind="batch"),
        dict(good, pos=6, base=9, kind="batch", item=1),
        dict(good, pos=7, base=6, kind="batch"),
        dict(good, pos=7, base=8, kind="batch", item=1, ref_digest_ok=False),
        dict(good, pos=8, base=4, kind="superseding"),
        dict(good, pos=9, base=5, kind="superseding"),
        dict(good, pos=10, base=6),
    ]
    schema = "verse string, pos long, item int, kind string, base long, n long, meta_ok boolean, cohort_ok boolean, generation_ok boolean, frame_ok boolean, ref_n long, ref_id_ok boolean, ref_digest_ok boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple({"verse": "v", **r}[c] for c in names) for r in rows], schema).repartition(3)
    got = {r.pos: (r.outcome, r.next_offset) for r in I.append(I.append_claims(df)).collect()}
    assert got == {
        1: ("appended", 2), 2: ("discontinuity", 2), 3: ("cohort", 2), 4: ("ref_records", 2), 5: ("appended", 6), 6: ("discontinuity", 6),
        7: ("ref_digest", 6), 8: ("appended", 6), 9: ("outside_log", 6), 10: ("appended", 8),
    }


def planned(spark, mode, **facts):
    row = {f: facts.get(f, False) for f in R.FACTS} | {"quorum": facts.get("quorum", True), "mode": mode}
    schema = ", ".join(f"{c} {'string' if c == 'mode' else 'boolean'}" for c in row)
    r = R.plan(spark.createDataFrame([tuple(row.values())], schema)).collect()[0]
    return r.state, list(r.actions), r.question


def test_recovery_plans(spark):
    assert planned(spark, "safe_repair", active=True) == ("ready", ["start_existing_owner"], None)
    assert planned(spark, "inspect", active=True, repairable=True) == ("inspecting", [], None)
    assert planned(spark, "guided", quorum=False, competing=True) == ("blocked", ["reject_blocked"], None)
    assert planned(spark, "guided", competing=True) == ("needs_guidance", ["hold_for_operator"], "choose_register_history")
    assert planned(spark, "safe_repair", fresh=True) == ("blocked", ["reject_blocked"], None)
    assert planned(spark, "safe_repair", fresh=True, bootstrap=True) == ("ready", ["bootstrap_new_journal"], None)
    assert planned(spark, "guided", fresh=True, bootstrap=True, active=True) == ("blocked", ["reject_blocked"], None)
    assert planned(spark, "safe_repair", boundary_known=True) == ("blocked", ["reject_blocked"], None)
    assert planned(spark, "emergency", boundary_known=True) == ("emergency_ready", ["publish_derived_successor"], None)
    assert planned(spark, "emergency", seal_incomplete=True)[2] == "successor_boundary"
    assert planned(spark, "guided", quorum=None) == ("blocked", ["reject_blocked"], None)


def test_recovered_tails_by_both_policies(spark):
    rows = [("v", 998, "a", 1, 1, 5, 2), ("v", 999, "a", 2, 1, 7, 3), ("v", 1000, "a", 1, 1, 10, 1), ("v", 1001, "a", 3, 1, 11, 1), ("v", 1002, "a", 2, 2, 12, 1), ("v", 1003, "b", 2, 1, 13, 1), ("v", 1004, "a", 2, 1, 20, 1)]
    tail = spark.createDataFrame(rows, "verse string, slot long, cohort string, generation long, frames int, base long, n long")
    at_most = {r.slot: r.problem for r in R.tail_problems(tail, F.lit("a"), F.lit(2)).collect()}
    assert at_most == {998: None, 999: None, 1000: "generation_regression", 1001: "future_generation", 1002: "generation_regression", 1003: "cohort", 1004: "discontinuity"}
    exact = {r.slot: r.problem for r in R.tail_problems(tail, F.lit("a"), F.lit(2), exact=True).collect()}
    assert exact == {998: "generation_mismatch", 999: None, 1000: "generation_mismatch", 1001: "generation_mismatch", 1002: "frames", 1003: "cohort", 1004: "discontinuity"}
