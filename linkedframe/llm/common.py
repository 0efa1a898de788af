"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkedframe.storage import stored  # noqa: F401  (operators take it from here)

ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "binary": pa.binary(),
    "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
    "array<struct<pid:int,type:int,payload:binary,pts:array<long>,access:array<long>,units:array<struct<at:long,pts:long,access:boolean,size:long>>>>": pa.list_(
        pa.struct(
            [
                ("pid", pa.int32()),
                ("type", pa.int32()),
                ("payload", pa.binary()),
                ("pts", pa.list_(pa.int64())),
                ("access", pa.list_(pa.int64())),
                ("units", pa.list_(pa.struct([("at", pa.int64()), ("pts", pa.int64()), ("access", pa.bool_()), ("size", pa.int64())]))),
            ]
        )
    ),
    "array<struct<start:int,end:int,kind:string>>": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])),
}

#: Rows handed to a function at once, whatever the size of Spark's own batches.
SLICE = 256


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return table.select(*columns) if columns else table


#: A key is hot if more than one in so many of all rows have it, so there are never more hot keys than this.
HOT = 10_000


def join_counted(rows: DataFrame, table: DataFrame, keys: str | Sequence[str], n: str = "n") -> DataFrame:
    """``rows`` joined to a stored ``table`` that has one row a key and ``n``, how many of the rows have it.

    Rows of hot keys stay where they are, since those keys, ``HOT`` at most, are broadcast; the others are shuffled by key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(n) * HOT > total))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col(n) * HOT <= total), keys)
    return rows.join(hot, keys).unionByName(rest)


def with_text_columns(
    df: DataFrame,
    fields: Sequence[tuple[str, str]],
    make: Callable[[], Callable[[list[str]], Sequence[Sequence]]],
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` with columns computed from its text column, Arrow batch by Arrow batch, without a shuffle.

    ``make`` runs once in each task and gives the function from texts to one sequence per field; a null text
    reaches it as an empty one.  ``keep`` names the columns passed through (default: all).  A kept column that has
    the name of a new field is replaced.  Texts are handed to Python once, also where they are kept.
    """
    names = [name for name, _ in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    types = [ARROW[kind] for _, kind in fields]
    added = [T.StructType.fromDDL(f"`{name}` {kind}").fields[0] for name, kind in fields]
    schema = T.StructType([*(df.schema[c] for c in kept), *added])
    given = [*(df[c] for c in kept), *([] if text in kept else [df[text].alias("__text")])]
    at = kept.index(text) if text in kept else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                values = function([x or "" for x in batch.column(at).to_pylist()])
                arrays = [batch.column(i) for i in range(len(kept))]
                arrays += [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(values, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *names])

    return df.select(*given).mapInArrow(run, schema)


def bucket_of(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``: how rows are held out."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key) % F.lit(modulus)


#: Stretches of the range of hashes that a sample is looked for in.
STRETCHES = 4096


def bounded_sample(df: DataFrame, key: str, strata: str, bound: int) -> DataFrame:
    """At most ``bound`` rows for each value of ``strata``, the ones whose key has the smallest hash.

    Rows are counted by stretches of the range of hashes.  Those in a value's first stretches are taken as they are, and
    only those of the stretch where the bound is reached are ranked, so no task sorts a hot value.  Rows of one key are
    taken in the order of all their columns, so the choice is defined.  A row a value of ``strata`` is broadcast.
    """
    hashed = stored(df.withColumn("__mark", F.shiftrightunsigned(F.xxhash64(key), 1)).withColumn("__at", F.expr(f"cast(__mark div {(1 << 63) // STRETCHES} as int)")))
    counts = hashed.groupBy(strata, "__at").agg(F.count("*").alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(strata).orderBy("__at"))
    full = counts.withColumn("__upto", upto).where(F.col("__upto") >= bound)
    ends = full.groupBy(F.col(strata).alias("__value")).agg(F.min(F.struct("__at", (F.lit(bound) - F.col("__upto") + F.col("__n")).alias("room"))).alias("__end"))
    rows = hashed.join(F.broadcast(ends), F.col(strata).eqNullSafe(F.col("__value")), "left")
    whole = rows.where(F.col("__end").isNull() | (F.col("__at") < F.col("__end.__at")))
    order = ["__mark", *[F.col(c) for c in (key, *(c for c in df.columns if c not in (key, strata)))]]
    rank = F.row_number().over(Window.partitionBy(strata).orderBy(*order))
    last = rows.where(F.col("__at") == F.col("__end.__at")).withColumn("__rank", rank).where("__rank <= __end.room")
    return whole.select(*df.columns).unionByName(last.select(*df.columns))
