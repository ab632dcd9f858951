"""Helpers shared by the text operators: column picking, Arrow batches, shared scratch tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierlens.session import scratch_path

_LIBC = ctypes.CDLL(None)
#: Text handled at once inside a task; a longer single text is handled alone.
SLICE_BYTES = 2 << 20
#: Spark's bound on an Arrow batch, its default, and the one used here.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20


def position(df: DataFrame, name: str) -> int:
    """Index of a column: the first exact match, else the first match in any case."""
    cols = df.columns
    if name in cols:
        return cols.index(name)
    low = [c.lower() for c in cols]
    if name.lower() in low:
        return low.index(name.lower())
    raise KeyError(f"no column {name} in {cols}")


def positional(df: DataFrame) -> DataFrame:
    """The same rows under the names p0, p1, ...: clashing names can then be told apart."""
    return df.toDF(*[f"p{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **names: str) -> DataFrame:
    """``pick(df, doc_id="id", text="body")``: only these columns, under these names,
    whatever else the table holds (also columns whose names differ only in case)."""
    flat = positional(df)
    return flat.select(*[flat[f"p{position(df, src)}"].alias(out) for out, src in names.items()])


def restore(flat: DataFrame, like: DataFrame) -> DataFrame:
    """Undo :func:`positional`: the columns of ``like``, by place and name."""
    return flat.select(*[f"p{i}" for i in range(len(like.columns))]).toDF(*like.columns)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the text of each part stays near ``limit`` bytes."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def small_batches(spark: SparkSession) -> None:
    """Text goes to Python workers in batches of a few MB, unless the session says otherwise:
    a batch is held by the JVM, on its way and by the worker at once, for each core."""
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def map_text(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]],
             start: Callable[[], Callable[[pa.RecordBatch], list]], drop: bool = False) -> DataFrame:
    """Append ``fields`` to ``df``, computed from Arrow batches; with ``drop`` the column ``text``
    is not sent back.

    ``start()`` runs once in each task and returns a function from a slice of the
    batch to one list (or Arrow array) per field.  Names in ``df`` must be distinct.
    """
    small_batches(df.sparkSession)
    kept = [i for i, f in enumerate(df.schema.fields) if not (drop and f.name == text)]
    out = T.StructType([*[df.schema.fields[i] for i in kept], *[T.StructField(n, t) for n, t in fields]])

    def run(batches):
        work = start()
        types = None
        for whole in batches:
            for b in slices(whole, text):
                got = work(b)
                if types is None:
                    from pyspark.sql.pandas.types import to_arrow_type
                    types = [to_arrow_type(t) for _, t in fields]
                cols = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, ty)
                        for x, ty in zip(got, types)]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], *cols], names=out.names)
                del got, cols
        work = None
        tidy()

    return df.mapInArrow(run, out)


def tidy() -> None:
    """At the end of a task: give freed memory back to the system.  Python workers outlive their
    task, and what they hold on to is missing to the executor's next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim:
        trim(0)


def raw_text(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to a fresh folder below the shared checkpoint folder and read it
    back: lineage is cut, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: At most so many groups are joined by broadcast: those with over 1 / HOT of the rows.
HOT = 1000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], n: str) -> DataFrame:
    """Each row with its group (one row per key, ``n`` its number of rows; null keys are a
    group too).  The few groups with over 1 / ``HOT`` of all rows are broadcast, so that
    none of them meets in one task; the others are joined by shuffle.  Both tables should
    be stored ones: they are read twice."""
    total = groups.agg(F.sum(n)).first()[0] or 0
    large = F.col(n) * HOT > total
    keyed = groups.select(*[F.col(c).alias(f"{c}_of") for c in on], *[c for c in groups.columns if c not in on], F.lit(True).alias("met"))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    hot = rows.join(F.broadcast(keyed.where(large)), same, "left")
    rest = hot.where(F.col("met").isNull()).select(*rows.columns).join(keyed.where(~large), same)
    out = [*rows.columns, *[c for c in groups.columns if c not in on]]
    return hot.where("met").select(*out).unionByName(rest.select(*out))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lower_ascii(c):
    """A-Z lower-cased, nothing else (SQL)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
