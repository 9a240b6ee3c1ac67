"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order (by a digest of seed and doc_id), repeated up to MOST
times.  A document's virtual finish time is the sum of its source's words up to and with it, divided by the
source's target.  All queues are served in the order of finish times until the budget, as many words as all
documents have, is used up.

No source is ever one task's.  Running sums are made in two steps: sums of slices of the shuffled order,
then sums inside a slice.  The finish time at which the budget ends is found the same way: sums of slices of time,
then sums of slices of the slice where the budget ends, then the rows of the last slice in order.

Defined results: a null text has size 0, and a document of size 0 is taken 0 times.  A null source is the last
source.  Documents with the same id, and null ids, are ordered by size and the text's hash; equal rows are
interchangeable.  A source without words has target 0.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, fresh, join_small, read, stage

WEIGHTS, MOST, SEED = (1, 2, 3), 3, "mix"
HEX = 3  # digits of the digest that name a slice: 4096 slices of a source
SLICES = 4096


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: all words shared by weight, none above most times its source's size.

    The shares are level * weight, cut at most * size.  With sources in the order of size / weight, the first k are
    cut for the one k whose level fits; sizes: one row for each source, a table that one task can hold.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.select("source", "source_size", weight.alias("w"), F.row_number().over(by_name).alias("nth"))
    order = Window.orderBy(F.col("source_size") / F.col("w"), "nth")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.select(
        "source", "source_size", "w", F.row_number().over(order).alias("k"),
        F.sum("source_size").over(every).alias("total"), F.sum("w").over(every).alias("all_w"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("cut_w"), (most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("cut"),
    )
    # The first source, in this order, that its level leaves uncut: the level holds for it and all after it.
    fits = F.expr(f"cast({most} * source_size as decimal(24)) * cast(all_w - cut_w as decimal(14)) >= cast(w as decimal(14)) * cast(total - cut as decimal(24))")
    first = F.min(F.when(fits, F.struct("k", (F.col("total") - F.col("cut")).alias("rest"), (F.col("all_w") - F.col("cut_w")).alias("rest_w")))).over(every)
    t = t.withColumn("first", first)
    share = (F.col("w") * F.col("first.rest")).cast("double") / F.col("first.rest_w").cast("double")
    return t.select("source", "source_size", F.when(F.col("k") < F.col("first.k"), (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def passes() -> Column:
    """The finish times of a row's MOST passes; none for a source without words."""
    return F.expr(f"case when target > 0 then transform(sequence(0, {MOST - 1}), p -> cast(p * source_size + upto as double) / target) else array() end")


def queue(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, tie, and any others) with source_size, target, and upto: the words of its source up to and with the row."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("tie").cast("string")), F.lit("null"))
    rows = rows.withColumn("place", F.md5(F.concat(F.lit(f"{SEED}:"), named))).withColumn("slice", F.substring("place", 1, HEX))
    sums = stage(rows.groupBy("source", "slice").agg(F.sum("size").alias("size")), "slices")
    goals = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s_source"), F.col("slice").alias("s_slice"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    goals = goals.withColumnRenamed("source", "g_source")
    sums = join_small(sums, goals, F.col("s_source").eqNullSafe(F.col("g_source")), F.col("s_slice"), "inner").drop("g_source")
    inside = Window.partitionBy("source", "slice").orderBy("place", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inside))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("slice") == F.col("s_slice")), "inner")
    return rows.withColumn("upto", F.col("before") + F.col("inside")).drop("s_source", "s_slice", "before", "inside", "place", "slice")


def served(queued: DataFrame) -> Callable[[Column], Column]:
    """Whether a finish time comes before the budget ends.  queued: a staged result of queue()."""
    times, t = queued.select("size", F.explode(passes()).alias("t")).where("size > 0"), F.col("t")
    budget = queued.agg(F.sum("size")).first()[0] or 0
    lo, width, used, cuts, until = 0.0, 4.0 / SLICES, 0, [], None

    def nth(x: Column, lo: float, width: float) -> Column:
        return F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(SLICES)).cast("int")

    def inside(x: Column) -> Column:
        out = F.lit(True)
        for lo, width, cut in cuts:
            out = out & (nth(x, lo, width) == cut)
        return out

    def ends(x: Column) -> Column:
        out = F.lit(False) if until is None else x <= F.lit(until)
        for lo, width, cut in reversed(cuts):
            n = nth(x, lo, width)
            out = (n < cut) | ((n == cut) & out)
        return out

    for _ in range(2):
        sums = times.where(inside(t)).groupBy(nth(t, lo, width).alias("nth")).agg(F.sum("size")).collect()  # SLICES + 1 rows at most
        for cut, n in sorted(map(tuple, sums)):
            if used + n > budget:
                break
            used += n
        else:
            until = float("inf")
            return ends
        cuts.append((lo, width, cut))
        lo, width = lo + cut * width, width / SLICES
    last = times.where(inside(t)).groupBy("t").agg(F.sum("size").alias("n")).select("t", (F.sum("n").over(Window.orderBy("t")) + used).alias("upto"))
    until = last.where(F.col("upto") <= budget).agg(F.max("t")).first()[0]
    return ends


def schedule(rows: DataFrame) -> DataFrame:
    """rows with source_size, target, copies (how often the mix takes the row) and time (of its first pass)."""
    queued = stage(queue(rows), "queued")
    copies = F.size(F.filter(passes(), served(queued)))
    return queued.select(*rows.columns, "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(0).alias("copies"), F.get(passes(), F.lit(0)).alias("time"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, in the order of their finish times, with mix_copies and mix_time."""
    (row,) = fresh(docs, "row")
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), F.col(row).alias("row"))
    taken = schedule(stage(rows, "sizes")).where("copies > 0").select(F.col("row").alias(f"{row}_r"), F.col("copies").alias(f"{row}_n"), F.col("time").alias(f"{row}_t"))
    out = docs.join(taken, F.col(row) == F.col(f"{row}_r"), "inner")
    kept = [c for c in docs.columns if c != row and c.lower() not in ("mix_copies", "mix_time")]
    return out.orderBy(f"{row}_t", row).select(*kept, F.col(f"{row}_n").alias("mix_copies"), F.col(f"{row}_t").alias("mix_time"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = stage(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")), "sizes")
    return schedule(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_W, _N = "[" + ", ".join(map(str, WEIGHTS)) + "]", len(WEIGHTS)
#: DuckDB SQL from a relation docs (doc_id, source, size) to mixed (doc_id, source, size, source_size, target, taken).
MIX_SQL = rf"""
sizes as (select source, sum(size)::bigint as s from docs group by source),
weighed as (select *, {_W}[((row_number() over (order by encode(source) nulls last) - 1) % {_N} + 1)::int]::bigint as w, row_number() over (order by encode(source) nulls last) as nth from sizes),
ordered as (select *, row_number() over o as k, (sum(s) over ())::bigint as total, (sum(w) over ())::bigint as all_w,
  coalesce(sum(w) over (o rows between unbounded preceding and 1 preceding), 0)::bigint as cut_w, {MOST} * coalesce(sum(s) over (o rows between unbounded preceding and 1 preceding), 0)::bigint as cut
  from weighed window o as (order by s::double / w, nth)),
fitting as (select min(k) as k0, min_by(total - cut, k) as rest, min_by(all_w - cut_w, k) as rest_w from ordered where {MOST} * s::hugeint * (all_w - cut_w) >= w::hugeint * (total - cut)),
goals as (select source, s as source_size, case when k < k0 then ({MOST} * s)::double else (w * rest)::double / rest_w::double end as target from ordered, fitting),
queued as (select d.rid, d.doc_id, d.source, d.size, g.source_size, g.target, sum(d.size) over (partition by d.source order by md5('{SEED}:' || coalesce(d.doc_id::varchar, 'null')), d.doc_id, d.size, d.rid rows unbounded preceding)::bigint as upto
  from docs d join goals g on d.source is not distinct from g.source),
times as (select rid, size, (p * source_size + upto)::double / target as t from queued, range({MOST}) r(p) where size > 0),
until as (select coalesce(max(t), -1) as t from (select t, sum(n) over (order by t) as upto from (select t, sum(size) as n from times group by t)) where upto <= (select coalesce(sum(size), 0) from docs)),
copies as (select rid, count(*) as n from times, until where times.t <= until.t group by rid),
mixed as (select q.*, coalesce(c.n, 0)::bigint as copies, (q.size * coalesce(c.n, 0))::bigint as taken from queued q left join copies c using (rid))
"""
SQL = rf"""with docs as (select row_number() over () as rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents), {MIX_SQL}
select doc_id, size, source_size, target, taken from mixed"""
