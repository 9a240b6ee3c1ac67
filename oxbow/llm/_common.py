"""What the operators share: words, lambda-local values, staged tables, joins with small tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows up to which a table may be broadcast; the tables it is asked for have rows of under 1 KB.
BROADCAST_ROWS = 50_000
SALTS = 32

_staged: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def window_hashes(word_hashes: Column, doublings: int) -> Column:
    """Hashes of all windows of 2 ** doublings words, in order: each round hashes a window's hash with its neighbour's."""

    def doubled(hashes: Column, step: int) -> Column:
        # transform() hands an index to a function of two arguments, so step may not be a default of the inner one
        return let(hashes, lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - step, F.lit(0))), lambda x, i: F.xxhash64(x, h[i + step])))

    for k in range(doublings):
        word_hashes = doubled(word_hashes, 1 << k)
    return word_hashes


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like names that clash with none of df, whatever their case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        x = f"_ox_{name}"
        while x.lower() in have:
            x += "_"
        have.add(x.lower())
        out.append(x)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master without it a temporary one."""
    sc = spark.sparkContext
    if at := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return at
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="oxbow-"))
    return sc.getCheckpointDir()


def stage(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder and read again: computed once, safe against lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/oxbow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged_here() -> Iterator[list[tuple[SparkSession, str]]]:
    """A list that holds, at the end of the block, the tables staged inside it."""
    made: list[tuple[SparkSession, str]] = []
    n = len(_staged)
    yield made
    made += _staged[n:]


def drop_staged(tables: list[tuple[SparkSession, str]]) -> None:
    """Deletes staged tables that nothing will read again."""
    for spark, path in tables:
        sc = spark.sparkContext
        if sc._jsc is not None and not sc._jsc.sc().isStopped():
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    _staged[:] = [x for x in _staged if x not in tables]


@atexit.register
def _at_end() -> None:
    try:
        drop_staged(list(_staged))
    except Exception:  # noqa: BLE001  the session is going; the cluster's clean-up of its folder remains
        return


def join_small(left: DataFrame, right: DataFrame, on: Column, spread: Column, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """left joined with right, which is broadcast if it has at most limit rows; else both are salted, so no key is one task's.

    spread: a value of left's rows that differs within a key.
    """
    if right.limit(limit + 1).count() <= limit:
        return left.join(F.broadcast(right), on, how)
    (ls,), (rs,) = fresh(left, "salt_l"), fresh(right, "salt_r")
    return (
        left.withColumn(ls, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        .join(right.withColumn(rs, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), on & (F.col(ls) == F.col(rs)), how)
        .drop(ls, rs)
    )
