"""Helpers shared by the operators of this subpackage.

Conventions: a row travels through a Python stage as one struct column
``row`` (so extra or clashing column names never meet an operator's own
columns); texts travel as UTF-8 bytes with NULL read as the empty text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnframe.session import checkpoint_dir, ensure_checkpoint_dir, ship_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All (or the given) columns of ``df`` as one struct named ``row``."""
    return F.struct(*[F.col(quoted(c)) for c in (columns or df.columns)]).alias("row")


def utf8(column: str) -> Column:
    """The text as UTF-8 bytes, NULL as empty."""
    return F.coalesce(F.col(quoted(column)).cast("string"), F.lit("")).cast("binary")


def prepare(spark: SparkSession) -> SparkSession:
    """Checkpoint folder and code on the executors, before a Python stage."""
    ensure_checkpoint_dir(spark)
    ship_code(spark)
    return spark


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it
    back: lineage ends there, so a lost executor costs a re-read."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote, once what was made of them is
    written itself."""
    for df in tables:
        spark, path = df.sparkSession, df._written
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


GROUPS_PER_TASK, MORE_GROUPS_PER_TASK, MANY_TASKS = 8, 64, 1_000


def dealt(df: DataFrame, column: str, groups: int) -> DataFrame:
    """``df`` shuffled by ``column`` into tasks of a few groups each, of more
    once there are many tasks, and no fewer tasks than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    few = min(-(-groups // GROUPS_PER_TASK), MANY_TASKS)
    return df.repartition(max(cores, few, -(-groups // MORE_GROUPS_PER_TASK)), column)


def map_batches(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], dict | None]],
    added: list[T.StructField],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """``mapInArrow`` that keeps the input columns but ``drop`` and appends
    ``added``.  ``make`` runs once per task and returns the batch function,
    which gives one list or array per added column (same rows)."""
    kept = [f for f in df.schema.fields if f.name not in drop]
    names = [f.name for f in kept]
    out_schema = T.StructType(kept + added)
    types = [_arrow(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                made = work(batch)
                columns = [batch.column(n) for n in names]
                columns += [pa.array(made[f.name], type=t) for f, t in zip(added, types)]
                yield pa.RecordBatch.from_arrays(columns, names=names + [f.name for f in added])

    return df.mapInArrow(run, out_schema)


def emit_rows(
    df: DataFrame,
    make: Callable[[], Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]],
    schema: T.StructType,
) -> DataFrame:
    """``mapInArrow`` whose task function yields dicts of equally long
    columns under ``schema``."""
    types = [_arrow(f.dataType) for f in schema.fields]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in make()(batches):
            yield pa.RecordBatch.from_arrays([pa.array(made[n], type=t) for n, t in zip(names, types)], names=names)

    return df.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind.fields])
    return {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(),
        T.BooleanType: pa.bool_(),
        T.StringType: pa.string(),
        T.BinaryType: pa.binary(),
    }[type(kind)]


def field(name: str, kind: str | T.DataType) -> T.StructField:
    simple = {
        "long": T.LongType(),
        "int": T.IntegerType(),
        "double": T.DoubleType(),
        "boolean": T.BooleanType(),
        "string": T.StringType(),
        "binary": T.BinaryType(),
    }
    return T.StructField(name, simple[kind] if isinstance(kind, str) else kind, True)


def hash_share(column: Column, share: float) -> Column:
    """A deterministic row sample: true for about ``share`` of the values."""
    return F.pmod(F.xxhash64(column, F.lit(17)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (splitmix64 finaliser), for ordering hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
