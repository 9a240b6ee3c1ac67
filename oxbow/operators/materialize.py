"""Materialization: JSON to strict typed columns, Parquet files that never overwrite one another, linked manifests, fenced progress."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import digest
from ..sources.files import Files, cut

#: Declared kind: the column's type, and the kinds of JSON value that it takes.
KINDS = {"utf8": ("string", ("STRING",)), "bool": ("boolean", ("BOOLEAN",)), "int64": ("bigint", ("BIGINT",)), "float64": ("double", ("BIGINT", "DECIMAL", "DOUBLE"))}


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    nullable: bool = True


def strict(payload: Column, fields: list[Field]) -> tuple[Column, Column]:
    """A struct of the declared fields of a JSON object, and what is wrong with the payload (null: nothing).

    A value of another kind is a problem, never cast: 1.0 is no int64, 1 no utf8.  Fields not declared are ignored.  A payload
    with the same key twice, or with text after the object, is no object here.
    """
    v = F.try_parse_json(F.when(payload.rlike(r"(?s)^\s*\{.*\}\s*$"), payload))
    root = F.schema_of_variant(v)
    problem = F.when(v.isNull() | ~root.startswith("OBJECT"), "not an object")
    columns = []
    for f in fields:
        at = f"$['{f.name}']"
        kind = F.schema_of_variant(F.try_variant_get(v, at, "variant"))
        kind = F.coalesce(kind, F.lit("VOID"))
        ours, theirs = KINDS[f.kind]
        fits = F.lit(False)
        for t in theirs:
            fits = fits | kind.startswith(t)
        absent = kind == "VOID"
        problem = problem.when(absent & F.lit(not f.nullable), f"{f.name}: missing").when(~absent & ~fits, f"{f.name}: not {f.kind}")
        columns.append(F.when(~absent & fits, F.try_variant_get(v, at, ours)).alias(f.name))
    return F.struct(*columns), problem


def project(df: DataFrame, fields: list[Field], payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, the declared columns, and problem.  source_digest, if declared and not a key of the payload, is the payload's digest; an explicit null stays."""
    values, problem = strict(F.col(payload), [f for f in fields if f.name != "source_digest"])
    out = df.withColumn("_v", values).withColumn("_p", problem)
    columns = [F.col(f"_v.{f.name}").alias(f.name) for f in fields if f.name != "source_digest"]
    if mine := [f for f in fields if f.name == "source_digest"]:
        has = F.coalesce(F.array_contains(F.json_object_keys(F.col(payload)), "source_digest"), F.lit(False))
        given, wrong = strict(F.col(payload), mine)
        columns.append(F.when(has, given["source_digest"]).otherwise(digest(F.col(payload))).alias("source_digest"))
        out = out.withColumn("_p", F.coalesce(F.col("_p"), F.when(has, wrong)))
    return out.select(*keep, *columns, F.col("_p").alias("problem"))


def batch_limits(ranges: DataFrame, max_records: int, max_bytes: int) -> DataFrame:
    """Ranges (verse, first, next, offset, bytes) that hold more than a batch may."""
    r = ranges.groupBy("verse", "first", "next").agg(F.count("*").alias("records"), F.sum("bytes").alias("size"))
    problem = F.when(F.col("records") > max_records, "records").when(F.col("size") > max_bytes, "bytes")
    return r.withColumn("problem", problem).where("problem is not null")


def walk(manifests: DataFrame, heads: DataFrame, most: int = 256) -> DataFrame:
    """The manifests of each chain from its head back, with problem where a link breaks.

    manifests: ref (one row each), previous, verse, epoch, first, next; heads: ref.  A manifest that is missing, that a chain has
    had, whose range doesn't end where the later one begins, or of another verse is a problem and ends its chain; so does the
    most-th step.  Links are judged pair by pair and jumped by doubled steps, so a chain costs the logarithm of its length in joins.
    """
    m = cut(manifests.select("ref", "previous", "verse", "epoch", "first", "next"))
    older = m.select(*[F.col(c).alias(f"o_{c}") for c in ("ref", "verse", "epoch", "first", "next")])
    problem = F.when(F.col("o_ref").isNull(), "missing").when(F.col("o_next") != F.col("first"), "gap").when(F.col("o_verse") != F.col("verse"), "identity")
    links = m.where("previous is not null").join(older, F.col("previous") == F.col("o_ref"), "left").withColumn("problem", problem)
    links = cut(links.select(F.col("ref").alias("from"), F.col("previous").alias("to"), "problem", "o_verse", "o_epoch", "o_first", "o_next"))

    rows = heads.select(F.col("ref").alias("head"), F.lit(0).alias("depth"), "ref")
    jumps, step = links.where("problem is null").select("from", "to"), 1
    while step <= most:
        rows = rows.unionByName(rows.join(jumps, F.col("ref") == F.col("from")).select("head", (F.col("depth") + step).alias("depth"), F.col("to").alias("ref")))
        then = jumps.select(F.col("from").alias("t_from"), F.col("to").alias("t_to"))
        jumps, step = cut(jumps.join(then, F.col("to") == F.col("t_from")).select("from", F.col("t_to").alias("to"))), step * 2
        if jumps.isEmpty():
            break
    rows = cut(rows.where(F.col("depth") <= most))

    again = Window.partitionBy("head", "ref").orderBy("depth")  # at most `most` rows
    rows = rows.withColumn("again", F.row_number().over(again) > 1)
    ends = rows.groupBy(F.col("head").alias("e_head")).agg(F.min(F.when(F.col("again"), F.col("depth"))).alias("_end"))
    rows = rows.join(ends, F.col("head") == F.col("e_head")).where("_end is null or depth <= _end")
    good = rows.join(m.withColumnRenamed("ref", "m_ref"), F.col("ref") == F.col("m_ref"), "left")
    told = F.when(F.col("depth") == most, "too long").when(F.col("again"), "cycle").when(F.col("m_ref").isNull(), "missing")
    good = good.select("head", "depth", "ref", "verse", "epoch", "first", "next", told.alias("problem"))
    broken = rows.where(~F.col("again") & (F.col("depth") < most)).join(links.where("problem is not null"), F.col("ref") == F.col("from"))
    had = rows.where(~F.col("again")).select(F.col("head").alias("h_head"), F.col("ref").alias("h_ref"))
    broken = broken.join(had, (F.col("head") == F.col("h_head")) & (F.col("to") == F.col("h_ref")), "left")
    late = F.when(F.col("depth") + 1 == most, "too long").when(F.col("h_ref").isNotNull(), "cycle").otherwise(F.col("problem"))
    return good.unionByName(broken.select("head", (F.col("depth") + 1).alias("depth"), F.col("to").alias("ref"), F.col("o_verse").alias("verse"), F.col("o_epoch").alias("epoch"), F.col("o_first").alias("first"), F.col("o_next").alias("next"), late.alias("problem")))


# --- fenced progress: one register for each binding, in a file system that only creates exclusively ---


@dataclass(frozen=True)
class Register:
    workload: str
    canon: str
    verse: str
    epoch: int
    token: str
    frontier: int
    last_commit_ref: str | None = None
    version: int = 0


class Conflict(Exception):
    """Another owner, or another state, than the caller believes in."""


class ProgressStore:
    """Registers as files named by their version, each created exclusively: a version exists once, so a stale writer can't win.

    folder: on a file system that driver and executors share.  Versions are dense and never change, so only those after the
    newest one seen are looked for.
    """

    def __init__(self, folder: str, spark: SparkSession | None = None):
        self.files = Files(spark or SparkSession.active(), folder)
        self._seen: dict[str, Register] = {}

    def _name(self, workload: str, canon: str, verse: str) -> str:
        return hashlib.sha256("\0".join((workload, canon, verse)).encode()).hexdigest()[:32]

    def observe(self, workload: str, canon: str, verse: str) -> Register | None:
        at = self._name(workload, canon, verse)
        seen = self._seen.get(at)
        if seen is None:
            versions = self.files.names(f"{at}/[0-9]*")
            newest = int(versions[-1]) if versions else None
        else:
            newest, step = seen.version, 1
            while self.files.exists(f"{at}/{newest + step:012d}"):
                newest, step = newest + step, step * 2
            while step > 1:
                step //= 2
                newest += step * self.files.exists(f"{at}/{newest + step:012d}")
        if newest is not None and (seen is None or newest > seen.version):
            seen = self._seen[at] = Register(**json.loads(self.files.read(f"{at}/{newest:012d}")))
        return seen

    def _create(self, r: Register) -> Register:
        try:
            self.files.create(f"{self._name(r.workload, r.canon, r.verse)}/{r.version:012d}", json.dumps(asdict(r)).encode())
        except FileExistsError as e:
            raise Conflict(f"version {r.version} exists") from e
        return r

    def acquire(self, workload: str, canon: str, verse: str, token: str, attempts: int = 32) -> Register:
        """Epoch 1 if new; the same token keeps its epoch; another takes over with the next epoch, frontier and last commit carried on."""
        return self.open(workload, canon, verse, token, attempts)[0]

    def open(self, workload: str, canon: str, verse: str, token: str, attempts: int = 32) -> tuple[Register, bool]:
        """What acquire gives, and whether its epoch was begun by this call."""
        for _ in range(attempts):
            now = self.observe(workload, canon, verse)
            if now and now.token == token:
                return now, False
            try:
                if now is None:
                    return self._create(Register(workload, canon, verse, 1, token, 0)), True
                return self._create(replace(now, epoch=now.epoch + 1, token=token, version=now.version + 1)), True
            except Conflict:
                continue
        raise Conflict("too many attempts")

    def advance(self, held: Register, frontier: int, commit_ref: str) -> Register:
        now = self.observe(held.workload, held.canon, held.verse)
        if now is None or (now.token, now.epoch) != (held.token, held.epoch):
            raise Conflict("fenced")
        if frontier <= now.frontier:
            raise Conflict("the frontier only rises")
        return self._create(replace(now, frontier=frontier, last_commit_ref=commit_ref, version=now.version + 1))


@dataclass(frozen=True)
class Staged:
    """A range's rows, written under a name that no one else has; told: what its records were."""

    told: Row
    path: str
    digest: str


def _told(fields: list[Field]) -> list[Column]:
    """Of a range's rows (offset, _size, the fields, problem): what shows whether they may be published."""
    needed = [F.max(F.col(f.name).isNull()).alias(f"_null_{f.name}") for f in fields if not f.nullable]
    return [F.count("*").alias("n"), F.count_distinct("offset").alias("distinct"), F.min("offset").alias("least"), F.max("offset").alias("most"), F.sum("_size").alias("size"), F.min(F.when(F.col("problem").isNotNull(), F.struct("offset", "problem"))).alias("bad"), *needed]


#: Ranges that a task writes, about.
RANGES_A_TASK = 32


def stage(spark: SparkSession, records: DataFrame, fields: list[Field], folder: str) -> dict[tuple[str, int], Staged]:
    """The ranges of many verses, each one written to a file of its own, by (verse, first).

    records: verse, first (of its range), offset, payload; read twice.  However many ranges there are, they take the same few
    jobs; the driver holds one row a range.  Nothing is published: ParquetWorkload.process_staged does that, range by range.
    folder: on the file system that the ranges are published on.
    """
    files, at = Files(spark, folder), uuid.uuid4().hex
    name = F.sha2(F.concat_ws("\0", "verse", F.col("first").cast("string")), 256)
    rows = project(records.withColumn("_size", F.octet_length("payload")), fields, keep=("verse", "first", "offset", "_size"))
    told = rows.groupBy("verse", "first").agg(*_told(fields)).withColumn("_name", name).collect()
    if not told:
        return {}
    parts = -(-len(told) // RANGES_A_TASK)
    columns = [f.name for f in fields]  # source_digest comes last, as project has it
    columns.sort(key=lambda c: c == "source_digest")
    out = rows.withColumn("range", name).repartition(parts, "range").sortWithinPartitions("range", "offset")
    out.select("range", *columns).write.partitionBy("range").parquet(files.uri(at))
    made = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(files.uri(at))
    made = made.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest")).collect()
    found = {r.path.split("/")[-2].removeprefix("range="): r for r in made}
    if len(found) != len(made) or found.keys() != {r["_name"] for r in told}:
        raise RuntimeError("not one file a range")
    return {(r.verse, r["first"]): Staged(r, found[r["_name"]].path, found[r["_name"]].digest) for r in told}


class ParquetWorkload:
    """Ranges of one verse to Parquet with manifests: reconcile, apply, advance, so that each range's output is made exactly once.

    folder: on a file system that driver and executors share; the driver handles manifests and digests, executors write the rows.
    """

    def __init__(self, spark: SparkSession, store: ProgressStore, folder: str | Files, fields: list[Field], schema_ref: str, workload: str, canon: str, verse: str, token: str, max_records: int = 100_000, max_bytes: int = 64 << 20):
        self.spark, self.store, self.files, self.fields, self.schema_ref = spark, store, folder if isinstance(folder, Files) else Files(spark, folder), fields, schema_ref
        self.max_records, self.max_bytes = max_records, max_bytes
        self.held, begun = store.open(workload, canon, verse, token)
        self._left: list[str] | None = [] if begun else None  # an epoch just begun has left nothing

    def _base(self, first: int, next_: int) -> str:
        h = self.held
        return hashlib.sha256("\0".join(map(str, (h.workload, h.canon, h.verse, h.epoch, first, next_))).encode()).hexdigest()

    def reconcile(self, first: int, next_: int, left: list[str] | None = None) -> tuple[str, str | None]:
        """(Absent | AlreadyCommitted | Indeterminate, commit reference): what is there of the range's output.

        left: the temporary names there, if the caller has listed them.

        Only the held epoch's objects count: an earlier owner's have other names and are not adopted.  Anything half done (a temporary
        folder, a file without its manifest or the reverse, another digest or owner) is Indeterminate, and is not deleted.
        """
        base, h = self._base(first, next_), self.held
        if self.files.names(f".{base}-*") if left is None else [x for x in left if x.startswith(f".{base}-")]:
            return "Indeterminate", None
        there = self.files.exists(f"{base}.parquet")
        if not self.files.exists(f"{base}.json"):
            return ("Indeterminate" if there else "Absent"), None
        m = json.loads(self.files.read(f"{base}.json"))
        if m["schema_ref"] != self.schema_ref:
            raise ValueError(f"the range was written by schema {m['schema_ref']}")
        ours = (m["workload"], m["canon"], m["verse"], m["first"], m["next"], m["epoch"], m["owner_token"]) == (h.workload, h.canon, h.verse, first, next_, h.epoch, h.token)
        if not ours or not there or self.files.digest(f"{base}.parquet") != m["digest"]:
            return "Indeterminate", None
        return "AlreadyCommitted", f"parquet:{m['file']}#{m['digest']}"

    def process(self, records: DataFrame, first: int, next_: int) -> str | None:
        """The commit reference of the range's output; records: offset, payload.  An empty range gives none."""
        self._left = None
        return self._process(first, next_, None, lambda previous: self._apply(records, first, next_, previous))

    def process_staged(self, staged: Staged | None, first: int, next_: int) -> str | None:
        """The same for a range that stage() has written: no job runs, and what earlier runs of this epoch left is listed once."""
        if self._left is None:
            self._left = self.files.names(".*-*")

        def apply(previous: str | None) -> str:
            if staged is None:
                raise ValueError("records don't cover the range exactly once")
            self._check(staged.told, first, next_)
            return self._commit(staged.path, staged.digest, first, next_, previous)

        return self._process(first, next_, self._left, apply)

    def _process(self, first: int, next_: int, left: list[str] | None, apply: Callable[[str | None], str]) -> str | None:
        if next_ < first:
            raise ValueError("inverted range")
        if first == next_:
            return None
        now = self.store.observe(self.held.workload, self.held.canon, self.held.verse)
        if now is None or (now.token, now.epoch) != (self.held.token, self.held.epoch):
            raise Conflict("fenced")
        if now.frontier != first:
            raise Conflict(f"frontier {now.frontier}, range from {first}")
        state, ref = self.reconcile(first, next_, left)
        if state == "Indeterminate":
            raise Conflict("the range's output is there in part")
        if state == "Absent":
            ref = apply(now.last_commit_ref)
        self.held = self.store.advance(now, next_, ref)
        return ref

    def _check(self, told: Row, first: int, next_: int) -> None:
        """ValueError if a range's rows may not be published."""
        if (told.n, told.distinct, told.least, told.most) != (next_ - first, next_ - first, first, next_ - 1):
            raise ValueError("records don't cover the range exactly once")
        if told.n > self.max_records or (told["size"] or 0) > self.max_bytes:
            raise ValueError("the range is more than a batch may hold")
        if told.bad:
            raise ValueError(f"payload at {told.bad.offset}: {told.bad.problem}")
        if null := [c.removeprefix("_null_") for c, v in told.asDict().items() if c.startswith("_null_") and v]:
            raise ValueError(f"null: {null}")

    def _apply(self, records: DataFrame, first: int, next_: int, previous: str | None) -> str:
        rows = project(records.withColumn("_size", F.octet_length("payload")), self.fields, keep=("offset", "_size"))
        self._check(rows.agg(*_told(self.fields)).first(), first, next_)
        tmp = f".{self._base(first, next_)}-{uuid.uuid4().hex}"
        rows.orderBy("offset").drop("offset", "_size", "problem").coalesce(1).write.parquet(self.files.uri(tmp))  # a batch is bounded: one file
        (part,) = self.files.names(f"{tmp}/*.parquet")
        ref = self._commit(f"{tmp}/{part}", self.files.digest(f"{tmp}/{part}"), first, next_, previous)
        self.files.delete(tmp)
        return ref

    def _commit(self, made: str, hashed: str, first: int, next_: int, previous: str | None) -> str:
        base, h = self._base(first, next_), self.held
        self.files.publish(made, f"{base}.parquet")  # fails if it is there
        m = {"workload": h.workload, "epoch": h.epoch, "owner_token": h.token, "schema_ref": self.schema_ref, "canon": h.canon, "verse": h.verse, "first": first, "next": next_, "file": f"{base}.parquet", "digest": hashed, "previous": previous}
        self.files.create(f"{base}.json", json.dumps(m).encode())
        return f"parquet:{base}.parquet#{hashed}"


class Broken(Exception):
    """What a register names can't be read as one whole chain of manifests and files."""


def chain(files: Files, register: Register, most: int | None = 256) -> list[dict]:
    """The manifests that a register's last commit names, the oldest first; files are opened by name, a folder is never listed.

    At most `most` small files (None: as many as there are), read on the driver.  Broken: no commit, a link that is missing, seen before, of another stream or
    schema or not adjoining, a head of a later epoch, or one that doesn't end at the register's frontier.
    """
    if register.last_commit_ref is None:
        raise Broken("no commit")
    back: list[dict] = []
    ref, seen = register.last_commit_ref, set()
    while ref is not None:
        if most is not None and len(back) >= most:
            raise Broken("too long")
        if ref in seen:
            raise Broken("cycle")
        seen.add(ref)
        name, _, hashed = ref.removeprefix("parquet:").partition("#")
        if not name.endswith(".parquet") or {"/", "\\", "\0"} & set(name) or ".." in name:
            raise Broken(f"unsafe name: {name}")
        at = name.removesuffix(".parquet") + ".json"
        if not files.exists(at):
            raise Broken(f"missing manifest: {at}")
        m = json.loads(files.read(at))
        if (m["file"], m["digest"]) != (name, hashed):
            raise Broken(f"manifest of another file: {at}")
        if back and m["next"] != back[-1]["first"]:
            raise Broken("gap")
        if back and any(m[k] != back[-1][k] for k in ("canon", "verse", "schema_ref")):
            raise Broken("identity")
        back.append(m)
        ref = m["previous"]
    head = back[0]
    if (head["workload"], head["canon"], head["verse"]) != (register.workload, register.canon, register.verse):
        raise Broken("the head is another stream's")
    if head["epoch"] > register.epoch:
        raise Broken("the head is of a later epoch")
    if head["next"] != register.frontier:
        raise Broken("the frontier is not where the chain ends")
    return back[::-1]


def summarize(spark: SparkSession, folder: str, register: Register, most: int | None = 256) -> tuple[dict, DataFrame]:
    """A register's output: facts of it, and the digests of its rows (verse, offset, source_digest) by offset."""
    (told,), digests = summaries(spark, folder, [register], most)
    return told, digests


def summaries(spark: SparkSession, folder: str, registers: list[Register], most: int | None = 256) -> tuple[list[dict], DataFrame]:
    """Registers' output: facts of each, see facts, and the digests of all their rows (verse, offset, source_digest) by offset.

    A file's digests take its offsets in order; rows without one take none.
    """
    files = Files(spark, folder)
    chains = [chain(files, r, most) for r in registers]
    told = _facts(spark, files, registers, chains)
    if not told or "source_digest" not in told[0]["schema_fields"].split(","):
        return told, spark.createDataFrame([], "verse string, offset long, source_digest string")
    data = spark.read.parquet(*[files.uri(m["file"]) for c in chains for m in c]).select("source_digest", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("_row"))
    starts = spark.createDataFrame([(m["file"], r.verse, m["first"]) for r, c in zip(registers, chains, strict=True) for m in c], "s_file string, verse string, s_first long")
    d = data.join(F.broadcast(starts), F.col("file") == F.col("s_file"))  # a row a manifest
    return told, pair_digests(d, F.col("s_first"), "_row").select("verse", "offset", "source_digest")


def facts(spark: SparkSession, folder: str, registers: list[Register], most: int | None = 256) -> list[dict]:
    """What registers' chains hold, after every file of them has been read: its bytes must have the manifest's digest, and all must have the same columns.

    One job reads all files (executors hash them and cut their footers out; a batch bounds a file).  most: of a chain's manifests, see chain.
    """
    files = Files(spark, folder)
    return _facts(spark, files, registers, [chain(files, r, most) for r in registers])


def _facts(spark: SparkSession, files: Files, registers: list[Register], chains: list[list[dict]]) -> list[dict]:
    given = {m["file"]: m for c in chains for m in c}
    if gone := [name for name in given if not files.exists(name)]:
        raise Broken(f"missing file: {gone[0]}")
    if not given:
        return []
    told = {r.file: r for r in _footers(spark, [files.uri(name) for name in given]).collect()}
    if wrong := [name for name, m in given.items() if name not in told or told[name].digest != m["digest"]]:
        raise Broken(f"digest of {wrong[0]}")
    columns = told[next(iter(given))].columns
    if columns is None or any(r.columns != columns for r in told.values()):
        raise Broken("files of different columns")
    return [
        {
            "verse": r.verse, "binding_epoch": c[-1]["epoch"], "row_count": sum(told[m["file"]].n for m in c), "schema_fields": ",".join(columns), "first_offset": c[0]["first"],
            "next_offset": c[-1]["next"], "manifest_count": len(c), "canonical_manifest": c[-1]["file"].removesuffix(".parquet") + ".json",
        }
        for r, c in zip(registers, chains, strict=True)
    ]


def _footers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet files: file, digest of the bytes, columns and n (rows) of the footer; columns is null where there is no footer."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.parquet as pq

        for b in batches:
            columns, n = [], []
            for x in b.column("footer").to_pylist():
                try:
                    m = pq.read_metadata(pa.BufferReader(b"PAR1" + x))
                    columns.append(m.schema.to_arrow_schema().names)
                    n.append(m.num_rows)
                except (TypeError, pa.ArrowException, OSError):
                    columns.append(None)
                    n.append(None)
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("digest"), pa.array(columns, pa.list_(pa.string())), pa.array(n, pa.int64())], ["file", "digest", "columns", "n"])

    b = spark.read.format("binaryFile").load(paths).withColumn("_h", F.hex(F.substring("content", -8, 4)))  # the footer's length, its lowest byte first
    big = F.concat(*[F.substring("_h", k, 2) for k in (7, 5, 3, 1)])
    b = b.withColumn("_n", F.conv(big, 16, 10).try_cast("int"))
    footer = F.expr("substring(content, cast(length(content) - 7 - _n as int), _n + 8)")
    b = b.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"), F.when(F.col("_n") < F.length("content"), footer).alias("footer"))
    return b.mapInArrow(run, "file string, digest string, columns array<string>, n long")


def pair_digests(rows: DataFrame, first: Column, order: str) -> DataFrame:
    """Offsets of materialized digests: rows without a digest take none, so later ones move up."""
    w = Window.partitionBy("file").orderBy(order)
    return rows.where("source_digest is not null").withColumn("offset", first + F.row_number().over(w) - 1)
