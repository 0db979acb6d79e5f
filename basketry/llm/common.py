"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from basketry.session import materialize, release


#: Rows of a batch that are worked on together: bounds what a worker holds besides the batch itself.
ROWS = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def stable(df: DataFrame) -> DataFrame:
    """``df`` itself if every evaluation is sure to give the same rows in the same places: files read with projections and
    filters only. Anything else, such as rows behind a shuffle whose partitions are chosen as it runs, is written once.

    Operators that number rows by their place and read them more than once start with this.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    fixed = plan.deterministic()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    files = plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"
    return df if fixed and files else materialize(df)


def give_back() -> None:
    """Hands memory that is free in a Python worker back to the system: workers are used again and else keep their peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType) -> DataFrame:
    """``make()`` runs once per task and returns the function applied to at most ROWS rows of an Arrow batch at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                if (out := one(batch.slice(at, ROWS))) is not None and out.num_rows:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


class Tables:
    """Written tables of one call, to be deleted once what is kept no longer reads them."""

    def __init__(self) -> None:
        self.held: list[DataFrame] = []

    def write(self, df: DataFrame) -> DataFrame:
        self.held.append(materialize(df))
        return self.held[-1]

    def free(self, *spent: DataFrame) -> None:
        for table in spent:
            release(table)
        self.held = [t for t in self.held if not any(t is s for s in spent)]

    def drop(self, *keep: DataFrame) -> None:
        for table in self.held:
            if not any(table is k for k in keep):
                release(table)
        self.held = [t for t in self.held if any(t is k for k in keep)]


def broadcast_if_small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table of narrow rows with the broadcast hint if it has at most ``most`` of them; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def dense_order(rows: DataFrame) -> DataFrame:
    """(__row, ord): the rank from 0 of each row (__row, __id) by id, then row; null ids come first.

    A range sort numbers the rows of each partition; the driver adds up one count per partition.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = [F.col("__id").asc_nulls_first(), F.col("__row")]
    ranked = rows.select("__row", "__id").repartitionByRange(parts, *key).sortWithinPartitions(*key)
    ranked = materialize(ranked.select("__row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    before, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in ranked.groupBy("part").count().collect()):
        before.append((part, total))
        total += n
    start = F.broadcast(spark.createDataFrame(before, "part int, __before long"))  # one row per partition
    return ranked.join(start, "part").select("__row", (F.col("at") + F.col("__before")).alias("ord"))


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in one array, and the n+1 offsets of its rows (null: empty)."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset:]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return flat[at[0]:at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id per vertex: (vertex, component) for every vertex of ``edges`` (a, b).

    Each round hooks every vertex of the contracted graph to its smallest neighbour, follows the
    parents to their roots by pointer doubling, and renames the edges to roots. A vertex that
    has a smaller neighbour stops being a root, so at least half of the touched vertices vanish
    per round. All tables live in the shared checkpoint folder; the driver sees only counts.
    """
    spark = edges.sparkSession
    tables = Tables()
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = tables.write(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while pairs.take(1):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("__m"))
        parent = tables.write(parent.select("vertex", F.least("vertex", "__m").alias("root")))
        while True:
            up = parent.select(F.col("vertex").alias("root"), F.col("root").alias("__up"))
            jumped = tables.write(parent.join(up, "root").select("vertex", F.col("__up").alias("root"), (F.col("__up") != F.col("root")).alias("__moved")))
            parent = jumped.select("vertex", "root")
            if not jumped.where("__moved").take(1):
                break
        left = parent.select(F.col("vertex").alias("a"), F.col("root").alias("__a"))
        right = parent.select(F.col("vertex").alias("b"), F.col("root").alias("__b"))
        named = pairs.join(left, "a").join(right, "b").where("__a <> __b")
        pairs = tables.write(named.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).distinct())
        step = parent.select(F.col("vertex").alias("component"), F.col("root").alias("__root"))
        first = parent.select("vertex", F.col("root").alias("component"))
        labels = tables.write(first if labels is None else labels.join(step, "component", "left").select("vertex", F.coalesce("__root", "component").alias("component")))
        tables.drop(pairs, labels)
    tables.drop(labels)
    if labels is None:
        kind = edges.schema["a"].dataType
        return spark.createDataFrame([], StructType([StructField("vertex", kind), StructField("component", kind)]))
    return labels


def in_order(df: DataFrame, *key: Column) -> DataFrame:
    """``df`` written once, with ``ord``: the rank of each row from 0 in the order of ``key``.

    A range sort numbers the rows of each partition; the driver adds up one count per partition.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = df.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    ranked = materialize(ranked.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")))
    before, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in ranked.groupBy("__part").count().collect()):
        before.append((part, total))
        total += n
    start = F.broadcast(spark.createDataFrame(before, "__part int, __before long"))  # one row per partition
    return ranked.join(start, "__part").withColumn("ord", F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")
