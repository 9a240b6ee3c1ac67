import glob
import hashlib
import os
import random

import pytest
from conftest import SMALL
from oxbow.operators import materialize as M
from oxbow.operators.materialize import Conflict, Field, ParquetWorkload, ProgressStore
from oxbow.plans import ops_queries
from oxbow.plans.catalog import QUERIES

FIELDS = [Field("id", "utf8", False), Field("amount", "int64"), Field("source_digest", "utf8", False)]


def work(spark, folder, token="t1"):
    return ParquetWorkload(spark, ProgressStore(f"{folder}/progress"), f"{folder}/out", FIELDS, "s.v1", "w", "c", "v", token)


def records(spark, first, next_):
    return spark.createDataFrame([(i, f'{{"id": "r{i}", "amount": {i}}}') for i in range(first, next_)], "offset long, payload string")


def test_two_ranges_with_a_takeover(spark, tmp_path):
    a = work(spark, tmp_path)
    ref = a.process(records(spark, 0, 3), 0, 3)
    b = work(spark, tmp_path, "t2")
    assert (b.held.epoch, b.held.frontier, b.held.last_commit_ref) == (2, 3, ref)
    b.process(records(spark, 3, 6), 3, 6)
    with pytest.raises(Conflict):
        a.process(records(spark, 6, 7), 6, 7)
    rows = spark.read.parquet(*glob.glob(f"{tmp_path}/out/*.parquet")).orderBy("id").collect()
    assert [(r.id, r.amount) for r in rows] == [(f"r{i}", i) for i in range(6)]
    assert all(r.source_digest.startswith("sha256:") for r in rows)


def test_crash_before_advance_is_repaired(spark, tmp_path):
    a = work(spark, tmp_path)
    ref = a._apply(records(spark, 0, 3), 0, 3, None)
    assert a.reconcile(0, 3) == ("AlreadyCommitted", ref)
    assert a.process(records(spark, 0, 3), 0, 3) == ref
    assert len(glob.glob(f"{tmp_path}/out/*.parquet")) == 1
    with pytest.raises(Conflict):
        a.process(records(spark, 0, 3), 0, 3)


def test_file_without_manifest_is_indeterminate(spark, tmp_path):
    a = work(spark, tmp_path)
    a._apply(records(spark, 0, 3), 0, 3, None)
    os.unlink(glob.glob(f"{tmp_path}/out/*.json")[0])
    with pytest.raises(Conflict):
        a.process(records(spark, 0, 3), 0, 3)


@pytest.mark.parametrize("rows", [[(0, '{"id": 1}')], [(0, '{"id": "a", "amount": 1.0}')], [(0, "[]")], [(1, '{"id": "a"}')], [(0, '{"id": "a"}'), (0, '{"id": "b"}')], [(0, '{"id": "a", "source_digest": null}')]])
def test_bad_ranges_write_nothing(spark, tmp_path, rows):
    a = work(spark, tmp_path)
    with pytest.raises(ValueError):
        a.process(spark.createDataFrame(rows, "offset long, payload string"), 0, len(rows))
    assert not glob.glob(f"{tmp_path}/out/*.parquet")
    assert a.store.observe("w", "c", "v").frontier == 0


def test_empty_range_and_frontier(spark, tmp_path):
    a = work(spark, tmp_path)
    assert a.process(records(spark, 0, 0), 0, 0) is None
    with pytest.raises(Conflict):
        a.store.advance(a.held, 0, "x")


def test_walk_finds_cycles_gaps_and_missing(spark):
    m = spark.createDataFrame([("a", None, "v", 1, 0, 5), ("b", "a", "v", 1, 5, 9), ("c", "d", "v", 1, 0, 3), ("d", "c", "v", 1, 0, 0), ("e", "a", "v", 1, 6, 7), ("f", "x", "v", 1, 6, 7), ("g", "a", "w", 1, 5, 6)], "ref string, previous string, verse string, epoch int, first long, next long")
    heads = spark.createDataFrame([(x,) for x in "bcefg"], "ref string")
    got = {(r.head, r.depth): r.problem for r in M.walk(m, heads).collect()}
    assert got[("b", 0)] is None and got[("b", 1)] is None
    assert got[("c", 2)] == "cycle"
    assert got[("e", 1)] == "gap"
    assert got[("f", 1)] == "missing"
    assert got[("g", 1)] == "identity"


def test_walk_is_the_links_one_by_one(spark):
    rng = random.Random(5)
    refs = [f"r{i}" for i in range(60)]
    rows = {r: (rng.choice([*refs[max(0, i - 4) : i + 3], None, "gone"]), rng.choice("vvvvvw"), i % 7 == 0) for i, r in enumerate(refs)}
    table = [(r, p, v, 1, 0, 1 if odd else 0) for r, (p, v, odd) in rows.items()]
    m = spark.createDataFrame(table, "ref string, previous string, verse string, epoch int, first long, next long").repartition(3)
    want = set()
    for head in [*refs, "gone"]:
        ref, newer, seen = head, None, []
        while True:
            problem = "too long" if len(seen) == 9 else "cycle" if ref in seen else "missing" if ref not in rows else "gap" if newer and rows[ref][2] else "identity" if newer and rows[ref][1] != rows[newer][1] else None
            want.add((head, len(seen), ref, problem))
            if problem or rows[ref][0] is None:
                break
            seen.append(ref)
            newer, ref = ref, rows[ref][0]
    got = M.walk(m, spark.createDataFrame([(r,) for r in [*refs, "gone"]], "ref string"), 9).select("head", "depth", "ref", "problem").collect()
    assert len(got) == len(want)
    assert set(map(tuple, got)) == want


def test_leftovers_and_other_epochs(spark, tmp_path):
    a = work(spark, tmp_path)
    os.mkdir(f"{tmp_path}/out/.{a._base(0, 3)}-x")
    assert a.reconcile(0, 3) == ("Indeterminate", None)
    with pytest.raises(Conflict):
        a.process(records(spark, 0, 3), 0, 3)
    a._apply(records(spark, 3, 5), 3, 5, None)
    assert not [x for x in os.listdir(f"{tmp_path}/out") if x.startswith(f".{a._base(3, 5)}")]
    b = work(spark, tmp_path, "t2")
    assert b.reconcile(3, 5) == ("Absent", None)  # an earlier epoch's objects are not adopted
    other = ParquetWorkload(spark, a.store, f"{tmp_path}/out", FIELDS, "s.v2", "w", "c", "v", "t2")
    b._apply(records(spark, 3, 5), 3, 5, None)
    with pytest.raises(ValueError):
        other.reconcile(3, 5)


def test_a_version_is_made_once(spark, tmp_path):
    store = ProgressStore(f"{tmp_path}/p", spark)
    held = store.acquire("w", "c", "v", "t1")
    store.advance(held, 5, "x")
    with pytest.raises(Conflict):
        store._create(M.replace(held, version=1))


def test_summary_reads_what_the_register_names(spark, tmp_path):
    a = work(spark, tmp_path)
    a.process(records(spark, 0, 3), 0, 3)
    b = work(spark, tmp_path, "t2")
    b.process(records(spark, 3, 7), 3, 7)
    (tmp_path / "out" / "stray.parquet").write_bytes(b"no")
    register = b.store.observe("w", "c", "v")
    facts, digests = M.summarize(spark, f"{tmp_path}/out", register)
    assert (facts["row_count"], facts["first_offset"], facts["next_offset"], facts["manifest_count"], facts["binding_epoch"]) == (7, 0, 7, 2, 2)
    assert facts["schema_fields"] == "id,amount,source_digest"
    want = {r.offset: "sha256:" + hashlib.sha256(r.payload.encode()).hexdigest() for r in records(spark, 0, 7).collect()}
    assert {r.offset: r.source_digest for r in digests.collect()} == want
    for wrong in (dict(frontier=6), dict(epoch=1), dict(verse="x"), dict(last_commit_ref=None), dict(last_commit_ref="parquet:../x.parquet#1")):
        with pytest.raises(M.Broken):
            M.summarize(spark, f"{tmp_path}/out", M.replace(register, **wrong))
    file = glob.glob(f"{tmp_path}/out/{a._base(0, 3)}.parquet")[0]
    whole = open(file, "rb").read()
    open(file, "wb").write(whole + b"x")
    with pytest.raises(M.Broken, match="digest"):
        M.summarize(spark, f"{tmp_path}/out", register)
    os.unlink(file)
    with pytest.raises(M.Broken, match="missing file"):
        M.summarize(spark, f"{tmp_path}/out", register)


def ranges(spark, n, size):
    """Records of n ranges of two verses."""
    return spark.createDataFrame([(v, i // size * size, i, f'{{"id": "r{i}", "amount": {i}}}') for v in "vu" for i in range(n * size)], "verse string, first long, offset long, payload string").repartition(3)


def jobs(spark):
    return spark._jsc.sc().dagScheduler().nextJobId()


def test_more_ranges_take_no_more_jobs(spark, tmp_path, monkeypatch):
    """Each range took five jobs or so, and each file of a chain one."""
    took = []
    for batch in (100, 10):
        monkeypatch.setattr(ops_queries, "BATCH", batch)
        began = jobs(spark)
        rows = QUERIES["parquet_digests"](spark, SMALL).collect()
        took.append(jobs(spark) - began)
        assert len(rows) == spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert max(took) < 60 and took[1] <= took[0] + 10  # of over 100 ranges


def test_summary_takes_no_job_a_file(spark, monkeypatch):
    monkeypatch.setattr(ops_queries, "BATCH", 10)
    began = jobs(spark)
    rows = QUERIES["parquet_summary"](spark, SMALL).collect()
    assert jobs(spark) - began < 60 < sum(r.manifest_count for r in rows)
    n = spark.read.parquet(f"{SMALL}/events.parquet").groupBy("event_type").count().collect()
    assert {(r.verse, r.row_count, r.manifest_count) for r in rows} == {(r.event_type, r["count"], -(-r["count"] // 10)) for r in n}


def test_a_chain_of_any_length(spark, tmp_path):
    staged = M.stage(spark, ranges(spark, 300, 2), FIELDS, f"{tmp_path}/staged")
    a = work(spark, tmp_path)
    for first in range(0, 600, 2):
        a.process_staged(staged["v", first], first, first + 2)
    register = a.store.observe("w", "c", "v")
    with pytest.raises(M.Broken, match="too long"):
        M.summarize(spark, f"{tmp_path}/out", register)
    (told,) = M.facts(spark, f"{tmp_path}/out", [register], None)
    assert (told["row_count"], told["manifest_count"], told["next_offset"]) == (600, 300, 600)


def test_files_of_other_columns_are_broken(spark, tmp_path):
    a = work(spark, tmp_path)
    a.process(records(spark, 0, 3), 0, 3)
    a.fields = FIELDS[:1] + FIELDS[2:]
    a.process(records(spark, 3, 5), 3, 5)
    with pytest.raises(M.Broken, match="different columns"):
        M.summarize(spark, f"{tmp_path}/out", a.store.observe("w", "c", "v"))


def test_staged_ranges_are_the_same_as_single_ones(spark, tmp_path):
    staged = M.stage(spark, ranges(spark, 2, 3), FIELDS, f"{tmp_path}/staged")
    assert set(staged) == {(v, f) for v in "vu" for f in (0, 3)}
    a = work(spark, tmp_path)
    ref = a.process_staged(staged["v", 0], 0, 3)
    b = work(spark, tmp_path, "t2")
    with pytest.raises(Conflict, match="fenced"):
        a.process_staged(staged["v", 3], 3, 6)
    with pytest.raises(Conflict, match="frontier"):
        b.process_staged(staged["v", 0], 0, 3)
    assert (b.held.epoch, b.held.last_commit_ref) == (2, ref)
    b.process_staged(staged["v", 3], 3, 6)
    assert b.reconcile(0, 3) == ("Absent", None) and b.reconcile(3, 6)[0] == "AlreadyCommitted"
    c = ParquetWorkload(spark, ProgressStore(f"{tmp_path}/alone"), f"{tmp_path}/one", FIELDS, "s.v1", "w", "c", "v", "t1")
    c.process(records(spark, 0, 3), 0, 3)
    one, two = (spark.read.parquet(f"{tmp_path}/{at}/{a._base(0, 3)}.parquet") for at in ("one", "out"))
    assert one.columns == two.columns and one.collect() == two.collect()


def test_half_done_ranges_stop_staged_ones(spark, tmp_path):
    staged = M.stage(spark, ranges(spark, 1, 3), FIELDS, f"{tmp_path}/staged")
    a = work(spark, tmp_path)
    os.mkdir(f"{tmp_path}/out/.{a._base(0, 3)}-x")
    again = work(spark, tmp_path)  # the same owner, after a crash
    with pytest.raises(Conflict, match="in part"):
        again.process_staged(staged["v", 0], 0, 3)


@pytest.mark.parametrize("rows", [[(0, '{"id": 1}')], [(0, "[]")], [(1, '{"id": "a"}')], [(0, '{"id": "a"}'), (0, '{"id": "b"}')], [(0, '{"id": "a", "source_digest": null}')], []])
def test_bad_staged_ranges_publish_nothing(spark, tmp_path, rows):
    staged = M.stage(spark, spark.createDataFrame([("v", 0, *r) for r in rows], "verse string, first long, offset long, payload string"), FIELDS, f"{tmp_path}/staged")
    a = work(spark, tmp_path)
    with pytest.raises(ValueError):
        a.process_staged(staged.get(("v", 0)), 0, max(1, len(rows)))
    assert not glob.glob(f"{tmp_path}/out/*.parquet")
    assert a.store.observe("w", "c", "v").frontier == 0


def test_a_register_is_seen_by_other_stores(spark, tmp_path):
    mine, other = (ProgressStore(f"{tmp_path}/p", spark) for _ in range(2))
    held = mine.acquire("w", "c", "v", "t1")
    assert other.observe("w", "c", "v") == held
    for k in range(1, 12):
        held = mine.advance(held, k, f"x{k}")
        if k in (1, 2, 5, 11):
            assert other.observe("w", "c", "v") == held == ProgressStore(f"{tmp_path}/p", spark).observe("w", "c", "v")
