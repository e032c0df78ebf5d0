"""What the corpus operators share: staging, Python workers, native array helpers."""

from __future__ import annotations

import gc
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts can be long, so batches stay far below Spark's own default.
BATCH_ROWS = 256
DEFAULT_BATCH_ROWS = "10000"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def python_workers(spark: SparkSession) -> None:
    """Let Python workers import this package, and give them small Arrow batches.

    A batch size that the user has set is kept. On a cluster the package is
    shipped with --py-files; the path below serves shared and local installs.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == DEFAULT_BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and Spark runs in one process (tests, a laptop) a folder below
    /tmp is set; on a cluster that is an error, as each machine would write to its own disk.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = held.get() if held.isDefined() else None
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "/tmp/checkpoints/tessella"
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a cut in the lineage
    that outlives any executor. `drop` removes it, `release` all that a session has staged."""
    spark = session(df)
    path = f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex[:12]}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    _STAGES.append(path)
    return out


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in _STAGES:
            _STAGES.remove(p)


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "_staged_at", None) if "_staged_at" in df.__dict__ else None:
            _delete(session(df), [path])


class Scratch:
    """Staged tables of one operator run: all but what `keep` has staged go at its end, also after an error."""

    def __init__(self, spark: SparkSession):
        self.spark, self.before, self.kept = spark, set(_STAGES), set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out = staged(df, name)
        self.kept.add(out._staged_at)
        return out

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        _delete(self.spark, [p for p in _STAGES if p not in self.before and p not in self.kept])


#: Bytes of ids that may be broadcast; more are joined by shuffle.
BROADCAST_BYTES = 8 << 20


def broadcastable(ids: DataFrame) -> bool:
    """Whether all values of a table of ids take less than BROADCAST_BYTES, at 16 bytes more for each."""
    size = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) + 16 for c in ids.columns), F.lit(0))
    return (ids.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def tidy(spark: SparkSession) -> None:
    """Let go of shuffles and broadcasts of finished steps.

    Spark's cleaner drops them once the driver's JVM has collected their plans; in jobs of
    many short steps that would else happen only when the heap is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_STAGES: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete every staged table of this process. Results not yet written become unreadable."""
    _delete(spark, list(_STAGES))


#: Elements summed in one go by `running_starts`.
CHUNK = 512


def running_starts(lengths: str) -> str:
    """SQL for the running start offset of each element of an array<bigint> column.

    Two levels (sums of chunks, then sums within a chunk), so that the copying that
    array_append implies stays linear in the array. An empty array gives an empty array.
    """
    base = (
        f"aggregate(sequence(0, cast((size({lengths}) - 1) div {CHUNK} as int)), "
        f"named_struct('at', 0L, 'starts', cast(array() as array<bigint>)), "
        f"(a, c) -> named_struct('at', a.at + aggregate(slice({lengths}, c * {CHUNK} + 1, {CHUNK}), 0L, (s, x) -> s + x), "
        f"'starts', array_append(a.starts, a.at)), a -> a.starts)"
    )
    inner = (
        f"aggregate(slice({lengths}, c * {CHUNK} + 1, {CHUNK}), "
        f"named_struct('at', b, 'out', cast(array() as array<bigint>)), "
        f"(a, x) -> named_struct('at', a.at + x, 'out', array_append(a.out, a.at)), a -> a.out)"
    )
    return f"if(size({lengths}) = 0, cast(array() as array<bigint>), flatten(transform({base}, (b, c) -> {inner})))"


def running_maxima(values: str) -> str:
    """SQL for the largest value before each element of an array<bigint> column, -1 for the first, in two levels as above."""
    base = (
        f"aggregate(sequence(0, cast((size({values}) - 1) div {CHUNK} as int)), "
        f"named_struct('at', -1L, 'tops', cast(array() as array<bigint>)), "
        f"(a, c) -> named_struct('at', greatest(a.at, array_max(slice({values}, c * {CHUNK} + 1, {CHUNK}))), "
        f"'tops', array_append(a.tops, a.at)), a -> a.tops)"
    )
    inner = (
        f"aggregate(slice({values}, c * {CHUNK} + 1, {CHUNK}), "
        f"named_struct('at', b, 'out', cast(array() as array<bigint>)), "
        f"(a, x) -> named_struct('at', greatest(a.at, x), 'out', array_append(a.out, a.at)), a -> a.out)"
    )
    return f"if(size({values}) = 0, cast(array() as array<bigint>), flatten(transform({base}, (b, c) -> {inner})))"


def crc_of_id(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, which decides the held-out folds; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str, id_col: str, text_col: str, rows: int, max_chars: int) -> list:
    """[(id, text, label)] of at most `rows` labelled rows whose id satisfies `learn`, by a hash of the id.

    The label rows are sampled first, so that texts are fetched by a broadcast of at most
    `rows` ids and are not shuffled. Texts of more than max_chars characters are left out;
    both bounds hold at any size of the tables. Rows with a null id or label are left out.
    """
    asked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isNotNull())
    asked = asked.where(learn).orderBy(F.xxhash64(F.col("_id"), F.lit(7)), "_id", "_label").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.coalesce(F.length("_text"), F.lit(0)) <= max_chars)
    got = texts.join(F.broadcast(asked), "_id").orderBy(F.xxhash64(F.col("_id"), F.lit(7)), "_id", "_label", "_text").limit(rows).collect()
    return [(r["_id"], r["_text"], r["_label"]) for r in got]
