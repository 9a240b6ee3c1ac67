"""Pointer-based storage: references to ranges of blobs, their resolution, layout, rewriting and collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import beside


def layout(chunks: DataFrame, blob: str, order: list[str], length: str) -> DataFrame:
    """chunks with offset: where each lies in its blob, one after the other."""
    before = Window.partitionBy(blob).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))


def coalesced_gets(refs: DataFrame, blob: str = "blob") -> DataFrame:
    """One range for each run of a blob's references (pos, offset, length) that follow on one another."""
    w = Window.partitionBy(blob).orderBy("pos")
    follows = F.col("offset") == F.lag(F.col("offset") + F.col("length")).over(w)
    r = refs.withColumn("_new", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    return r.groupBy(blob, "run").agg(F.min("offset").alias("offset"), F.sum("length").alias("length"), F.count("*").alias("refs"))


def superseding(refs: DataFrame) -> DataFrame:
    """The reference that holds for each chunk (verse, chunk, pos, rewritten, inline): the first rewritten one, else the last inline one, else the first.

    place: where the chunk first appeared.  An aggregate of signed positions, so nothing is gathered or ordered.
    """
    rank = F.when(F.col("rewritten"), F.struct(F.lit(0), F.col("pos").alias("p"), F.col("pos"))).when(F.col("inline"), F.struct(F.lit(1), (-F.col("pos")).alias("p"), F.col("pos"))).otherwise(F.struct(F.lit(2), F.col("pos").alias("p"), F.col("pos")))
    return refs.groupBy("verse", "chunk").agg(F.min(rank)["pos"].alias("chosen"), F.min("pos").alias("place"))


def collectable(members: DataFrame, superseded: DataFrame) -> DataFrame:
    """Whether each blob (blob, chunk) may be deleted: it has members, and each is superseded."""
    s = superseded.select(F.col("chunk").alias("s_chunk")).distinct()
    m = members.join(s, F.col("chunk") == F.col("s_chunk"), "left")
    return m.groupBy("blob").agg(F.count("chunk").alias("members"), F.count("s_chunk").alias("superseded"), ((F.count("chunk") > 0) & F.coalesce(F.bool_and(F.col("s_chunk").isNotNull()), F.lit(False))).alias("collectable"))


def resolve(log: DataFrame, blobs: DataFrame) -> DataFrame:
    """Chunks that log entries (position, kind inline|ref, payload, refs) stand for, with verified content.

    refs: array of struct(blob, offset, length, digest); blobs: blob, content.  A problem instead of content where the blob is
    missing, too short, or its range has another digest.
    """
    inline = log.where("kind = 'inline'").select("position", F.lit(0).alias("nth"), F.col("payload").alias("content"), F.lit(None).cast("string").alias("problem"))
    refs = log.where("kind <> 'inline'").select("position", F.posexplode("refs").alias("nth", "ref"))
    b = blobs.select(F.col("blob").alias("b_blob"), F.col("content").alias("b_content"))
    got = refs.join(b, F.col("ref.blob") == F.col("b_blob"), "left")
    piece = F.substr("b_content", (F.col("ref.offset") + 1).cast("int"), F.col("ref.length").cast("int"))
    problem = F.when(F.col("b_content").isNull(), "missing").when(F.octet_length("b_content") < F.col("ref.offset") + F.col("ref.length"), "short").when(F.concat(F.lit("sha256:"), F.sha2(piece, 256)) != F.col("ref.digest"), "digest")
    return inline.unionByName(got.select("position", "nth", F.when(problem.isNull(), piece).alias("content"), problem.alias("problem")))


def rewrite(chunks: DataFrame, verse: str, order: list[str], length: str) -> DataFrame:
    """The layout of per-verse objects that chunks of many verses' blobs are rewritten to."""
    return layout(chunks, verse, order, length).withColumnRenamed("offset", "new_offset")


def recovery_tail(log: DataFrame, n: int) -> DataFrame:
    """The last n slots of each verse (verse, slot, base, n_records) and whether each goes on from the one before."""
    tails = log.groupBy("verse").agg((F.max("slot") + 1).alias("tail")).withColumnRenamed("verse", "t_verse")
    part = log.join(tails, F.col("verse") == F.col("t_verse")).where(F.col("slot") >= F.col("tail") - n)
    part = beside(part, ["verse"], F.floor(F.col("slot") / 1000), ["slot"], "before", F.col("base") + F.col("n_records"))
    return part.select("verse", "slot", "base", "n_records", (F.col("before").isNull() | (F.col("before") == F.col("base"))).alias("continues"))
