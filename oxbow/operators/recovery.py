"""Recovery: plans by observed facts, checks of a recovered tail and of checkpoints, reads below a known tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import beside

#: What was observed of a stream; null counts as not observed.
FACTS = ("active", "quorum", "competing", "repairable", "seal_incomplete", "boundary_known", "corrupt", "fresh", "bootstrap")

#: Findings, in the order in which they are told.
FINDINGS = ("competing_registers", "missing_quorum", "corrupt_chunk", "repairable_replica", "incomplete_known_seal", "active_generation", "fresh_prefix", "derived_successor", "ambiguous_successor")

#: Whether an action can be taken back, and whether it needs a fence.
ACTIONS = {
    "repair_replica_value": (True, False),
    "complete_known_seal": (True, True),
    "publish_derived_successor": (False, True),
    "start_existing_owner": (True, True),
    "bootstrap_new_journal": (False, True),
    "hold_for_operator": (True, False),
    "reject_blocked": (True, False),
}

#: The question that a situation leaves to an operator.
QUESTIONS = {"competing": "choose_register_history", "corrupt": "corrupt_chunk_disposition", "empty": "confirm_bootstrap", "ambiguous": "successor_boundary"}


def _told(pairs: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(holds, name) for name, holds in pairs]))


def plan(facts: DataFrame) -> DataFrame:
    """facts (FACTS, and mode: inspect, safe_repair, guided or emergency) with situation, state, findings, actions, question, reversible, needs_fence.

    One pass over rows: the situation is the first that holds, and only the situation `steps` is planned step by step.  Facts
    that contradict each other, and whatever leaves no safe action, are blocked; guided plans ask instead where a question
    exists.  Inspection takes no action; an emergency takes the likely repairs only, not what is certain without it.
    """
    f = {n: F.coalesce(F.col(n), F.lit(False)) for n in FACTS}
    mode = {m: F.coalesce(F.col("mode"), F.lit("")) == m for m in ("inspect", "safe_repair", "guided", "emergency")}
    evidence = f["active"] | f["seal_incomplete"] | f["boundary_known"] | f["corrupt"] | f["repairable"]
    situations = {
        "contradiction": (f["fresh"] & evidence) | (f["bootstrap"] & ~f["fresh"]),
        "no_quorum": ~f["quorum"],
        "competing": f["competing"],
        "corrupt": f["corrupt"],
        "bootstrap": f["fresh"] & f["bootstrap"],
        "empty": f["fresh"],
        "ambiguous": f["seal_incomplete"] & ~f["boundary_known"] & ~f["active"],
    }
    situation = F.coalesce(*[F.when(holds, name) for name, holds in situations.items()], F.lit("steps"))

    s = F.col("situation")
    seen = dict(zip(FINDINGS, [f["competing"], ~f["quorum"], f["corrupt"], f["repairable"], f["seal_incomplete"], f["active"], f["fresh"], f["boundary_known"], s == "ambiguous"], strict=True))
    findings = F.when(s == "contradiction", F.array(F.lit("inconsistent_evidence"))).otherwise(_told(list(seen.items())))

    asks = s.isin(*QUESTIONS) & (mode["guided"] | (mode["emergency"] & (s == "ambiguous")))
    question = F.when(asks, F.create_map(*[F.lit(x) for kv in QUESTIONS.items() for x in kv])[s])

    certain = ~mode["inspect"] & ~mode["emergency"]
    steps = _told([
        ("repair_replica_value", f["repairable"] & ~mode["inspect"]),
        ("complete_known_seal", f["seal_incomplete"] & f["boundary_known"] & certain),
        ("publish_derived_successor", f["boundary_known"] & ~f["active"] & (mode["guided"] | mode["emergency"])),
        ("start_existing_owner", f["active"] & certain),
    ])
    nothing = (s == "steps") & ~mode["inspect"] & (F.size(steps) == 0) & ~f["active"]
    works = s.isin("steps", "bootstrap") & ~nothing
    actions = (
        F.when(asks, F.array(F.lit("hold_for_operator")))
        .when(~works, F.array(F.lit("reject_blocked")))
        .when(s == "bootstrap", _told([("bootstrap_new_journal", ~mode["inspect"])]))
        .otherwise(steps)
    )
    state = F.when(asks, "needs_guidance").when(~works, "blocked").when(mode["inspect"], "inspecting").when(mode["emergency"], "emergency_ready").otherwise("ready")
    out = facts.withColumn("situation", situation)
    out = out.withColumns({"state": state, "findings": findings, "actions": actions, "question": question})
    no_return, fenced = ([a for a, kinds in ACTIONS.items() if kinds[k] is want] for k, want in ((0, False), (1, True)))
    return out.withColumns({"reversible": ~F.exists("actions", lambda a: a.isin(*no_return)), "needs_fence": F.exists("actions", lambda a: a.isin(*fenced))})


def checkpoint_problems(checkpoints: DataFrame, journal: Column) -> DataFrame:
    """Checkpoints (journal, next_offset, hint) with problem: of another journal, or without the hint that any but the first offset needs."""
    problem = F.when(~F.col("journal").eqNullSafe(journal), "journal_mismatch").when(F.col("hint").isNull() & (F.col("next_offset") != 0), "missing_resume_hint")
    return checkpoints.withColumn("problem", problem)


def read_next(history: DataFrame, readers: DataFrame, bounds: DataFrame) -> DataFrame:
    """What each reader (reader, verse, next_offset) reads next below the tail it knows: record, gap or caught_up, and where it goes on.

    bounds (verse, trim, tail): the first offset that is kept, and the end as last refreshed; history: verse, offset, payload.
    A reader below the trim is told the gap and goes on at the trim.  Readers meet records by an equi-join on verse and offset.
    """
    r = readers.join(bounds.withColumnRenamed("verse", "b_verse"), F.col("verse") == F.col("b_verse")).drop("b_verse")
    at = F.col("next_offset")
    event = F.when(at >= F.col("tail"), "caught_up").when(at < F.col("trim"), "gap").otherwise("record")
    r = r.withColumn("event", event).withColumn("_at", F.when(F.col("event") == "record", at))
    h = history.select(F.col("verse").alias("h_verse"), F.col("offset").alias("h_offset"), "payload")
    out = r.join(h, (F.col("verse") == F.col("h_verse")) & (F.col("_at") == F.col("h_offset")), "left")
    goes_on = F.when(F.col("event") == "record", at + 1).when(F.col("event") == "gap", F.least("trim", "tail")).otherwise(at)
    return out.select("reader", "verse", "next_offset", "event", "payload", goes_on.alias("goes_on"))


def tail_problems(tail: DataFrame, cohort: Column, active: Column, exact: bool = False) -> DataFrame:
    """Recovered chunks (verse, slot, cohort, generation, frames, base, n) with problem, by the first check that fails; the first chunk is not anchored.

    Checked are the cohort, a generation above the active one or below that of the chunk before (exact: any but the active one), the
    single frame, and that offsets go on.
    """
    t = beside(tail, ["verse"], F.floor(F.col("slot") / 1000), ["slot"], "_before", F.struct("generation", (F.col("base") + F.col("n")).alias("end")))
    problem = F.when(F.col("cohort") != cohort, "cohort")
    if exact:
        problem = problem.when(F.col("generation") != active, "generation_mismatch")
    else:
        problem = problem.when(F.col("generation") > active, "future_generation").when(F.col("generation") < F.col("_before.generation"), "generation_regression")
    problem = problem.when(F.col("frames") != 1, "frames").when(F.col("base") != F.col("_before.end"), "discontinuity")
    return t.withColumn("problem", problem).drop("_before")
