"""Ordered histories: dense offsets, range scans, resumption, trims, continuity.

Streams (verses) can be as few as one, so nothing here hands a whole stream to one task where its order has a slice,
a value that rises with it (an hour, a thousand ids): running numbers are made of the slices' totals and of numbers
inside a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, by: list[str], slice_: Column, order: list, name: str, value: Column | None = None, largest: bool = False) -> DataFrame:
    """df with name: the sum of value (1 if none) over the rows of by that come before; slice_ rises with order.

    largest: their largest value instead, null before the first.
    """
    value = F.lit(1) if value is None else value
    told = F.max if largest else F.sum
    start = F.lit(None if largest else 0).cast("long")
    df = df.withColumn("_slice", slice_).withColumn("_value", value.cast("long"))
    totals = df.groupBy(*by, "_slice").agg(told("_value").alias("_total"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_slice").alias("_k_slice"), F.coalesce(told("_total").over(before), start).alias("_base"))
    inside = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(told("_value").over(inside), start))
    on = F.col("_slice").eqNullSafe(F.col("_k_slice"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    df = df.join(totals, on).withColumn(name, F.greatest("_base", "_inside") if largest else F.col("_base") + F.col("_inside"))
    return df.drop("_slice", "_value", "_inside", "_base", "_k_slice", *[f"_k_{c}" for c in by])


def beside(df: DataFrame, by: list[str], slice_: Column, order: list[str], name: str, value: Column, ahead: bool = False) -> DataFrame:
    """df with name: value of the row before in by (ahead: of the one after), null at the end; slice_ rises with order.

    Neighbours inside a slice come from its window; a slice's first row takes the last value of the slice before it, of
    which there is one a slice, so no stream is one task's.  order should be total: ties are neighbours in any order.
    """
    df = df.withColumn("_slice", slice_).withColumn("_value", F.struct(value.alias("v")))
    pick, near = (F.min_by, F.lead) if ahead else (F.max_by, F.lag)
    edges = df.groupBy(*by, "_slice").agg(pick("_value", F.struct(*order)).alias("_last"))
    edges = edges.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_slice").alias("_k_slice"), near("_last").over(Window.partitionBy(*by).orderBy("_slice")).alias("_edge"))
    df = df.withColumn("_near", near("_value").over(Window.partitionBy(*by, "_slice").orderBy(*order)))
    on = F.col("_slice").eqNullSafe(F.col("_k_slice"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    df = df.join(edges, on).withColumn(name, F.coalesce("_near", "_edge")["v"])
    return df.drop("_slice", "_value", "_near", "_edge", "_k_slice", *[f"_k_{c}" for c in by])


def dense_offsets(df: DataFrame, verse: str, slice_: Column, order: list[str], name: str = "offset") -> DataFrame:
    """Offsets from 0 in the order of each verse."""
    return running(df, [verse], slice_, order, name)


def range_scan(history: DataFrame, verse: str, first: int, next_: int) -> DataFrame:
    return history.where((F.col("verse") == verse) & (F.col("offset") >= first) & (F.col("offset") < next_))


def range_violations(history: DataFrame, ranges: DataFrame) -> DataFrame:
    """What makes a range (verse, first, next, trim) unreadable: trimmed, missing or unmapped records; no rows: all are readable.

    history: verse, offset, mapped.
    """
    inside = ranges.join(history.withColumnRenamed("verse", "h_verse"), (F.col("verse") == F.col("h_verse")) & (F.col("offset") >= F.col("first")) & (F.col("offset") < F.col("next")), "left")
    told = inside.groupBy("verse", "first", "next", "trim").agg(F.count("offset").alias("found"), F.count_if(~F.col("mapped")).alias("unmapped"))
    problem = F.when(F.col("next") < F.col("first"), "inverted").when(F.col("first") < F.col("trim"), "trimmed").when(F.col("found") < F.col("next") - F.col("first"), "missing").when(F.col("unmapped") > 0, "unmapped")
    return told.withColumn("problem", problem).where("problem is not null")


def trim_gap(history: DataFrame, requests: DataFrame, trims: DataFrame) -> DataFrame:
    """verse, requested, gap (whether the request is below the trim), new_start: the first offset that is still there."""
    left = history.join(trims.withColumnRenamed("verse", "t_verse"), F.col("verse") == F.col("t_verse")).where("offset >= trim")
    start = left.groupBy("verse").agg(F.min("offset").alias("new_start"), F.max("trim").alias("trim")).withColumnRenamed("verse", "s_verse")
    r = requests.join(start, F.col("verse") == F.col("s_verse"))
    gap = F.col("requested") < F.col("trim")
    return r.select("verse", "requested", gap.alias("gap"), F.when(gap, F.col("new_start")).otherwise(F.col("requested")).alias("new_start"))


def resume(history: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The records at or after each verse's checkpoint (verse, next_offset: the next to read)."""
    c = checkpoints.select(F.col("verse").alias("c_verse"), "next_offset")
    return history.join(c, F.col("verse") == F.col("c_verse")).where("offset >= next_offset").drop("c_verse", "next_offset")


def tails(history: DataFrame) -> DataFrame:
    return history.groupBy("verse").agg((F.max("offset") + 1).alias("tail"))


def _thousands(c: str) -> Column:
    return F.floor(F.col(c) / 1000)


def chain_violations(chunks: DataFrame) -> DataFrame:
    """Chunks (verse, position, base, n) whose base isn't the end of the one before; the first is not anchored."""
    chunks = beside(chunks, ["verse"], _thousands("position"), ["position"], "expected", F.col("base") + F.col("n"))
    return chunks.where("expected is not null and base <> expected").select("verse", "position", "base", "expected")


def generation_violations(chunks: DataFrame, active: Column) -> DataFrame:
    """Chunks (verse, position, generation) whose generation falls or is above the active one."""
    chunks = beside(chunks, ["verse"], _thousands("position"), ["position"], "_before", F.col("generation"))
    problem = F.when(F.col("generation") > active, "above_active").when(F.col("generation") < F.col("_before"), "falls")
    return chunks.withColumn("problem", problem).where("problem is not null").select("verse", "position", "generation", "problem")


def explode_frames(frames: DataFrame, records: str = "records") -> DataFrame:
    """A row for each record of a frame (base_offset, array of records), at base_offset + its place."""
    return frames.select("*", F.posexplode(records).alias("_pos", "record")).withColumn("offset", F.col("base_offset") + F.col("_pos")).drop("_pos", records)


def attribute_spans(spans: DataFrame) -> DataFrame:
    """A row for each offset of a span (first_offset, record_count), so that attribution is an equi-join."""
    return spans.where("record_count > 0").withColumn("offset", F.explode(F.expr("sequence(first_offset, first_offset + record_count - 1)")))


def stripes(df: DataFrame, address: Column, n: int) -> DataFrame:
    """stripe and local place of each raw address, and the address computed back from them."""
    df = df.withColumn("stripe", F.pmod(address, F.lit(n)).cast("long")).withColumn("local", F.floor(address / n).cast("long"))
    return df.withColumn("back", F.col("local") * n + F.col("stripe"))


def stripe_tails(addresses: DataFrame, by: list[str]) -> DataFrame:
    """Contiguous tail (first missing address), other tail (largest + 1) and holes between, by distinct addresses from 0."""
    d = addresses.select(*by, "address").distinct()
    d = running(d, by, _thousands("address"), ["address"], "_place").withColumn("dense", F.col("address") == F.col("_place"))
    return d.groupBy(*by).agg(F.count_if("dense").alias("contiguous_tail"), (F.max("address") + 1).alias("tail"), (F.max("address") + 1 - F.count("*")).alias("holes"))


def contiguous_end(generations: DataFrame) -> DataFrame:
    """The end of each verse's last generation (verse, generation, start, contiguous_tail)."""
    return generations.groupBy("verse").agg(F.max_by(F.col("start") + F.col("contiguous_tail"), "generation").alias("end"))


def stalls(progress: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Pairs of neighbouring steps (verse, at_us) more than so many seconds apart."""
    progress = beside(progress, ["verse"], F.floor(F.col("at_us") / 3_600_000_000), ["at_us"], "_before", F.col("at_us"))
    return progress.withColumn("gap_us", F.col("at_us") - F.col("_before")).drop("_before").where(F.col("gap_us") > int(seconds * 1e6))
