import random

from oxbow.operators import history as H
from oxbow.operators import ingest as I
from pyspark.sql import functions as F


def test_admission_rules():
    a = I.Admission(window=2)
    assert a.admit(1, 0, 0, 0, "x") == ("Empty", None, None)
    assert a.admit(1, 1, 1, 5, "x") == ("OutOfSequence", None, None)
    assert a.admit(1, 1, 0, 5, "x") == ("Accepted", 0, 5)
    assert a.admit(1, 1, 0, 5, "x") == ("Replay", 0, 5)
    assert a.admit(1, 1, 0, 5, "y") == ("IdentityConflict", None, None)
    assert a.admit(2, 1, 0, 2, "z") == ("Accepted", 5, 7)
    assert a.admit(1, 1, 1, 1, "a") == ("Accepted", 7, 8)
    assert a.admit(1, 1, 2, 1, "b") == ("Accepted", 8, 9)
    assert a.admit(1, 1, 0, 5, "x") == ("Indeterminate", None, None)
    assert a.admit(1, 0, 3, 1, "c") == ("Fenced", None, None)
    assert a.admit(1, 2, 3, 1, "c") == ("OutOfSequence", None, None)
    assert a.admit(1, 2, 0, 1, "c") == ("Accepted", 9, 10)


def schedule(seed, n=300):
    rng = random.Random(seed)
    return [(f"v{rng.randrange(3)}", pos, rng.randrange(4), rng.randrange(1, 3), rng.randrange(6), rng.randrange(1, 4), f"d{rng.randrange(2)}") for pos in range(n)]


def test_admit_equals_the_rules_row_by_row(spark):
    rows = [r for s in range(3) for r in schedule(s)]
    rows = [(v, i, *rest) for i, (v, _, *rest) in enumerate(rows)]
    df = spark.createDataFrame(rows, "verse string, pos long, producer long, epoch int, sequence long, records long, digest string").repartition(4)
    want, rules = [], {}
    for v, pos, *rest in rows:
        want.append((v, pos, *rules.setdefault(v, I.Admission()).admit(*rest)))
    got = [(r.verse, r.pos, r.outcome, r.first_offset, r.next_offset) for r in I.admit(df).collect()]
    assert sorted(got) == sorted(want)
    spans = sorted((v, a, b) for v, _, o, a, b in got if o == "Accepted")
    for (v, _, end), (w, start, _) in zip(spans, spans[1:], strict=False):
        assert v != w or start == end  # dense


def test_cuts():
    items = [(1, 30, 0), (1, 80, 1), (1, 10, 2), (5, 10, 3), (1, 200, 4), (1, 1, 500)]
    assert list(I.cut_after(iter(items), 3, 100, 100)) == [(0, ""), (0, "bytes"), (1, ""), (1, "records"), (2, "bytes"), (3, "")]
    assert list(I.cut_before(iter(items), 3, 100, 100)) == [(0, ""), (1, "bytes"), (1, ""), (2, "records"), (3, "records"), (4, "age")]


def test_running_equals_one_window(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab") if i % 7 else None, i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {r.i: r.s for r in H.running(df, ["k"], F.floor(F.col("i") / 37), ["i"], "s", F.col("v")).collect()}
    sums = {}
    for k, i, v in rows:
        assert got[i] == sums.get(k, 0)
        sums[k] = sums.get(k, 0) + v


def test_drop_oldest(spark):
    df = spark.createDataFrame([("a", i, b) for i, b in enumerate([5, 5, 99, 5, 5])], "k string, i long, bytes long")
    kept = [r.i for r in I.drop_oldest(df, "k", "i", 3, 12).where("kept").collect()]
    assert sorted(kept) == [3, 4]


def test_empty_histories(spark):
    df = spark.createDataFrame([], "verse string, offset long, at long")
    assert H.dense_offsets(df.drop("offset"), "verse", F.col("at"), ["at"]).count() == 0
    assert H.tails(df).count() == 0
