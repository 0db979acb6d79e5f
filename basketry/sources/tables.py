"""Access to the parquet tables of one scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Per path, the state of the files when the schema was read, and the schema.
_SCHEMAS: dict[str, tuple[tuple, StructType]] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of change of the files of a table: tells whether its schema may have changed."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``{sf_dir}/{name}.parquet`` as a DataFrame; projections and filters push into the scan.

    The schema is read from the footers, in a job of its own, the first time and whenever the files have changed.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    state = _state(spark, path)
    known = _SCHEMAS.get(path)
    if known and known[0] == state:
        return spark.read.schema(known[1]).parquet(path)
    df = spark.read.parquet(path)
    _SCHEMAS[path] = (state, df.schema)
    return df


#: Bytes of a table's files per task where its rows are sorted and hashed whole: some hundred thousand rows.
TASK_BYTES = 8 << 20


def tasks_for(spark: SparkSession, sf_dir: str, name: str) -> int:
    """The number of tasks over which to deal the rows of a table, in proportion to the size of its files.

    Spark puts shuffled rows together by their compressed size, and rows that compress well fill a task's memory long
    before that; a count that follows the table keeps the rows of a task about the same at every size.
    """
    return max(1, -(-sum(size for _, size, _ in _state(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")) // TASK_BYTES))
