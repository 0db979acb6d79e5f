"""CSV sources (S1, S2) and the shape report (S3).

Files whose quoted fields hold line breaks are split like others: a line break ends a record only where the number
of quotes before it is even. One pass counts the quotes of each split, the driver adds up their parities in the
order of a file (one number per split), and a second pass cuts every split into records by itself. The pieces of a record that
crosses splits are put together afterwards.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from basketry.session import materialize, table_path

# Canonical sales-line schema: column names are fixed values of the input format.
SALES_SCHEMA = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType(), True),
        T.StructField("StockCode", T.StringType(), True),
        T.StructField("Description", T.StringType(), True),
        T.StructField("Quantity", T.DoubleType(), True),
        T.StructField("InvoiceDate", T.StringType(), True),
        T.StructField("UnitPrice", T.DoubleType(), True),
        T.StructField("CustomerID", T.DoubleType(), True),
        T.StructField("Country", T.StringType(), True),
    ]
)


# Texts that the analysed application's reader takes as missing (the empty text too).
NULL_TEXTS = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

_MALFORMED = "_malformed_record"


def _reader(spark: SparkSession, multi_line: bool):
    """Header CSV with quotes doubled inside quoted fields; ``multi_line`` lets a quoted field hold line breaks, for which
    Spark reads a file in one task: used for the header alone, see :func:`quoted_records`."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the records of the CSV files under ``path``, line breaks within quotes included, without each file's header.

    The files are read by as many tasks as they have splits. A carriage return before a line break is dropped, and empty lines
    between records are none. A record must fit one task, a file need not.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.regexp_replace("value", "\r$", "").alias("value"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    parity = lines.groupBy("file", "at").agg((F.sum(quotes) % 2).alias("odd")).collect()  # one row per split
    inside: dict[tuple[str, int], bool] = {}
    now: dict[str, bool] = {}
    for r in sorted(parity, key=lambda r: (r["file"], r["at"])):
        inside[r["file"], r["at"]] = now.get(r["file"], False)
        now[r["file"]] = now.get(r["file"], False) ^ bool(r["odd"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (file, at, part, text): part 0 for a whole record, 1 for the end or middle of one that began in an earlier split, 2 for a
        beginning, 3 for that of the header. A whole header is left out."""
        block, held, open_, begun, header = None, [], False, True, False

        def rest(out: list) -> None:
            if held:
                out.append((*block, 3 if header else 2 if begun else 1, "\n".join(held)))

        out: list = []
        for batch in batches:
            for file, at, value in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if (file, at) != block:
                    rest(out)
                    block, held = (file, at), []
                    open_ = inside[block]
                    begun, header = not open_, at == 0
                held.append(value)
                open_ ^= value.count('"') % 2 == 1
                if not open_:
                    if not header:
                        out.append((*block, 0 if begun else 1, "\n".join(held)))
                    held, begun, header = [], True, False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["file", "at", "part", "text"])
                out = []
        rest(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["file", "at", "part", "text"])

    rows = materialize(lines.mapInArrow(cut, "file string, at long, part int, text string"))
    # a split gives at most one end or middle, its first piece, and one beginning, its last: few rows per file
    pieces = rows.where("part > 0")
    order = Window.partitionBy("file").orderBy("at", "part")
    chain = F.sum((F.col("part") > 1).cast("int")).over(order)
    joined = pieces.withColumn("chain", chain).groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct("at", "part", "text"))).alias("p"))
    joined = materialize(joined.where(F.col("p")[0]["part"] < 3).select(F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text")))
    whole = rows.where("part = 0").select("text").unionByName(joined)
    return whole.where(F.col("text") != "").select(F.col("text").alias("record"))


def _parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _MALFORMED, "maxCharsPerColumn": "-1"}
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.select(F.from_csv("record", ddl, options).alias("r")).select("r.*")


def _nulls(df: DataFrame) -> DataFrame:
    """Texts of NULL_TEXTS become null in every text column."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        out.append(F.when(~col.isin(NULL_TEXTS), col).alias(c) if c in text else col)
    return df.select(*out)


def _typed(df: DataFrame, types: dict[str, T.DataType]) -> DataFrame:
    """Casts of text columns that fail loudly on a text that isn't a value of the type (null stays null)."""
    return df.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types and not isinstance(types[c], T.StringType) else F.col(f"`{c}`") for c in df.columns])


def read_sales_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """Header CSV of order lines with an explicit schema (no inference pass over the data).

    With ``schema=None`` the types are those of :data:`SALES_SCHEMA` for the columns it names, and text for
    others. Extra derived columns (TotalPrice, Month, Hour, Day) may be present; cleaning only adds the missing
    ones. Missing values are the empty field and NULL_TEXTS. A record with more fields than the header, and
    a text that isn't a number in a numeric column, are errors when the data are read: nothing is lost or
    nulled silently. A record with fewer fields has nulls. InvoiceDate stays text here; dates are
    parsed, with errors for bad ones, by ``clean.parse_ts(strict=True)``.
    """
    header = _reader(spark, multi_line).csv(path).columns
    known = {f.name: f.dataType for f in (schema or SALES_SCHEMA).fields}
    if schema is None:
        known.update({"TotalPrice": T.DoubleType(), "Hour": T.IntegerType()})
    raw = _records(spark, path, header, multi_line)
    surplus = F.raise_error(F.concat(F.lit("a record has more fields than the header: "), F.col(_MALFORMED)))
    bad = F.col(_MALFORMED).isNotNull() & ~_short(header)
    first = F.when(bad, surplus.cast("string")).otherwise(F.col(f"`{header[0]}`")).alias(header[0])
    return _typed(_nulls(raw.select(first, *[F.col(f"`{c}`") for c in header[1:]])), known)


def _records(spark: SparkSession, path: str, header: list[str], multi_line: bool, records: DataFrame | None = None) -> DataFrame:
    """All fields as text, and the whole record in _MALFORMED where its number of fields differs from the header's."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, _MALFORMED]])
    if multi_line:
        return _parsed(quoted_records(spark, path) if records is None else records, schema)
    reader = _reader(spark, multi_line).schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _MALFORMED)
    reader = reader.option("columnPruning", False)  # else only the fields of the columns in use are counted
    return reader.csv(path)


def _short(header: list[str]):
    """Whether a malformed record has fewer fields than the header: commas are counted outside quotes."""
    bare = F.regexp_replace(F.col(_MALFORMED), '"([^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1 < len(header)


def _numeric_texts(df: DataFrame) -> DataFrame:
    """Text columns whose values are all numbers become double (missing-value texts had made them text); one pass over the data."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    col = [F.col(f"`{c}`") for c in text]
    seen = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(col)], *[F.count(c.try_cast("double")).alias(f"d{i}") for i, c in enumerate(col)]).first()
    numbers = {c for i, c in enumerate(text) if seen[f"n{i}"] and seen[f"n{i}"] == seen[f"d{i}"]}
    return _typed(df, {c: T.DoubleType() for c in numbers})


def read_user_csv(spark: SparkSession, path: str, strict: bool = False, multi_line: bool = False) -> dict:
    """Arbitrary header CSV with inferred types.

    Returns ``{"data": DataFrame}`` or ``{"error": message}`` when the file cannot be read, mirroring an error
    result instead of an exception. A record with more fields than the header is an error result, and one
    with fewer has nulls for the missing ones; ``strict=True`` makes the latter an error result too. The check is one
    distributed parse of the file inside this call; with ``multi_line`` (line breaks in quoted fields) the files are split as
    in :func:`quoted_records`. Missing values are the empty field and NULL_TEXTS.
    """
    try:
        reader = _reader(spark, multi_line)
        header = reader.csv(path).columns
        records = quoted_records(spark, path) if multi_line else None
        malformed = F.col(_MALFORMED).isNotNull()
        texts = _records(spark, path, header, multi_line, records)
        worst = texts.agg(
            F.count(F.col(f"`{header[0]}`")), F.count_if(malformed & ~_short(header)).alias("more"), F.count_if(malformed & _short(header)).alias("less")).first()
        if worst["more"] or (strict and worst["less"]):
            which = "more" if worst["more"] else "fewer"
            return {"error": f"Error reading file: {worst['more'] or worst['less']} records have {which} fields than the header"}
        if records is None:
            data = reader.option("inferSchema", True).csv(path)
        else:  # the types are inferred from a copy without line breaks, which is read in splits
            flat = table_path(spark, f"csv-{uuid.uuid4().hex}")
            texts.select(*[F.regexp_replace(F.col(f"`{c}`"), "[\r\n]+", " ").alias(c) for c in header]).write.option("header", True).option("quote", '"').option("escape", '"').csv(flat)
            data = _parsed(records, _reader(spark, False).option("inferSchema", True).csv(flat).schema) if worst[0] else texts.drop(_MALFORMED)
        return {"data": _numeric_texts(_nulls(data))}
    except Exception as exc:  # noqa: BLE001 - any reader failure becomes an error result
        return {"error": f"Error reading file: {str(exc).splitlines()[0]}"}


def shape(df: DataFrame) -> DataFrame:
    """S3: one row ``(rows, columns)``; the row count is a distributed count."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(len(df.columns)).alias("columns"))
