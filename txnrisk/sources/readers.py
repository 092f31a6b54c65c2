"""Scans: CSV, parquet, JSON, JDBC, raw transaction files, saved splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of a raw transaction file, by position (two columns share a name).
RAW_COLUMNS = [
    "Timestamp", "From Bank", "Account", "To Bank", "Account.1", "Amount Received",
    "Receiving Currency", "Amount Paid", "Payment Currency", "Payment Format", "Is Laundering",
]
# Canonical name of each raw column that is renamed.
CANONICAL_NAMES = {
    "Timestamp": "timestamp",
    "From Bank": "from_bank",
    "Account": "source",
    "To Bank": "to_bank",
    "Account.1": "target",
    "Amount Paid": "amount",
    "Payment Format": "payment_format",
    "Is Laundering": "is_fraud",
}
RAW_TIME_FORMAT = "yyyy/MM/dd HH:mm"
_NUMERIC_RAW = {"Amount Received": T.DoubleType(), "Amount Paid": T.DoubleType(), "Is Laundering": T.IntegerType()}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    date_columns: Sequence[str] = (),
    date_format: str = "yyyy-MM-dd HH:mm:ss",
    sep: str = ",",
    header: bool = True,
    encoding: str = "UTF-8",
) -> DataFrame:
    """CSV with a fixed schema (no inference pass). Dates that do not parse become null."""
    as_text = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name in date_columns else f.dataType) for f in schema.fields]
    )
    df = (
        spark.read.schema(as_text)
        .option("sep", sep)
        .option("header", header)
        .option("encoding", encoding)
        .csv(path)
    )
    parsed = {c: F.try_to_timestamp(F.col(c), F.lit(date_format)).cast("timestamp_ntz") for c in date_columns}
    return df.withColumns(parsed) if parsed else df


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_json_records(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """A JSON array of records per file, or (``lines``) one record per line, which splits."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_json_split(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Documents of the form {"columns": [..], "index": [..], "data": [[..], ..]}.

    Each document names its own columns, so values are picked by name, not position.
    """
    layout = "columns array<string>, index array<string>, data array<array<string>>"
    docs = spark.read.schema(layout).option("multiLine", True).json(path)
    rows = docs.select("columns", F.explode("data").alias("row"))

    def field(f: T.StructField):
        place = F.array_position("columns", f.name)
        value = F.when(place > 0, F.get("row", (place - 1).cast("int")))
        return value.try_cast(f.dataType).alias(f.name)

    return rows.select(*[field(f) for f in schema.fields])


def read_database(
    spark: SparkSession,
    url: str,
    table: str | None = None,
    query: str | None = None,
    fetch_size: int = 10_000,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    driver: str | None = None,
) -> DataFrame:
    """JDBC table or query. With ``partition_column`` and ``bounds`` the read is parallel."""
    if (table is None) == (query is None):
        raise ValueError("give either table or query")
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    if driver:
        reader = reader.option("driver", driver)
    if partition_column and bounds:
        source = table if table is not None else f"({query}) AS q"
        return (
            reader.option("dbtable", source)
            .option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
            .load()
        )
    return (reader.option("dbtable", table) if table is not None else reader.option("query", query)).load()


def load_by_suffix(spark: SparkSession, name: str, raw_dir: str, processed_dir: str, schema: T.StructType) -> DataFrame:
    """Read by file suffix from the raw folder, or from the processed folder if it is not there."""

    def open_in(folder: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        suffix = name.rsplit(".", 1)[-1].lower()
        if suffix == "csv":
            return read_csv(spark, path, schema)
        if suffix == "parquet":
            return spark.read.schema(schema).parquet(path)
        if suffix == "json":
            return read_json_records(spark, path, schema)
        raise ValueError(f"no reader for .{suffix}")

    try:
        return open_in(raw_dir)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return open_in(processed_dir)


def load_split(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A split saved by ``writers.save_split``."""
    return spark.read.parquet(f"{base.rstrip('/')}/split={name}")


def read_raw_transactions(spark: SparkSession, path: str, parse_time: bool = True) -> DataFrame:
    """Raw columns by position; the header is skipped because it repeats a name."""
    fields = [T.StructField(c, _NUMERIC_RAW.get(c, T.StringType())) for c in RAW_COLUMNS]
    time_cols = ["Timestamp"] if parse_time else []
    return read_csv(spark, path, T.StructType(fields), time_cols, RAW_TIME_FORMAT)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Raw file in canonical names; further raw columns are kept."""
    return read_raw_transactions(spark, path).withColumnsRenamed(CANONICAL_NAMES)


def read_headerless_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tab-separated, no header; columns are named "0", "1", .. by position."""
    df = read_csv(spark, path, schema, sep="\t", header=False)
    return df.toDF(*[str(i) for i in range(len(df.columns))])
