"""Section A: scans and sinks. Files are written from the tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.plans.registry import KEY, PATTERNS, register, with_scores, with_transfers
from txnrisk.session import scratch_path
from txnrisk.sources import pattern_files, readers, writers
from txnrisk.sources.canonical import ROW_KEY, line_scores, pattern_rows, table, transfers

ORDERS = (
    T.StructType()
    .add("o_orderkey", T.LongType())
    .add("o_custkey", T.LongType())
    .add("o_orderstatus", T.StringType())
    .add("o_totalprice", T.DoubleType())
    .add("o_orderdate", T.TimestampNTZType())
    .add("o_orderpriority", T.StringType())
)
ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def _orders_text(spark, sf_dir):
    """Orders with the date as text; every 7th date is unreadable, to show the null."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    bad = F.col("o_orderkey") % 7 == 0
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.when(bad, "n/a").otherwise(day).alias("o_orderdate"), "o_orderpriority",
    )


@register(
    "a1_csv_scan",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate, o_orderpriority FROM orders",
)
def a1(spark, sf_dir):
    path = scratch_path(spark, "a1")
    _orders_text(spark, sf_dir).write.option("header", True).option("sep", ";").csv(path)
    return readers.read_csv(spark, path, ORDERS, ["o_orderdate"], sep=";")


@register("a2_parquet_scan", "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'")
def a2(spark, sf_dir):
    df = readers.read_parquet(spark, f"{sf_dir}/lineitem.parquet")
    return df.filter(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_extendedprice")


@register("a3_json_records", ORDERS_SQL)
def a3(spark, sf_dir):
    path = scratch_path(spark, "a3")
    table(spark, sf_dir, "orders").write.json(path)
    return readers.read_json_records(spark, path, ORDERS, lines=True)


@register("a3_json_split", ORDERS_SQL)
def a3_split(spark, sf_dir):
    """One document per 500 order keys, so a document never grows with the table."""
    path = scratch_path(spark, "a3s")
    orders = table(spark, sf_dir, "orders")
    cells = [F.col(c).cast("string") for c in orders.columns]
    docs = (
        orders.groupBy(F.floor(F.col("o_orderkey") / 500).alias("part"))
        .agg(F.collect_list(F.array(*cells)).alias("data"), F.collect_list("o_orderkey").alias("index"))
        .select("part", F.to_json(F.struct(F.array(*[F.lit(c) for c in orders.columns]).alias("columns"), "index", "data")).alias("value"))
    )
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_json_split(spark, path, ORDERS)


@register("a5_suffix_load", ORDERS_SQL)
def a5(spark, sf_dir):
    raw, processed = scratch_path(spark, "raw"), scratch_path(spark, "processed")
    table(spark, sf_dir, "orders").write.parquet(f"{processed}/orders.parquet")
    return readers.load_by_suffix(spark, "orders.parquet", raw, processed, ORDERS)


@register("a6_named_split", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01'")
def a6(spark, sf_dir):
    base = scratch_path(spark, "splits")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    late = F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    writers.save_split(rows.filter(~late).drop("l_shipdate"), base, "train")
    writers.save_split(rows.filter(late).drop("l_shipdate"), base, "test")
    return readers.load_split(spark, base, "test")


def _raw_file(spark, sf_dir, name):
    path = scratch_path(spark, name)
    rows = transfers(spark, sf_dir)
    columns = {
        "Timestamp": writers.raw_time(F.col("timestamp")),
        "From Bank": F.col("from_bank"),
        "Account": F.col("source"),
        "To Bank": F.col("to_bank"),
        "Account.1": F.col("target"),
        "Amount Received": F.col("amount"),
        "Receiving Currency": F.lit("Euro"),
        "Amount Paid": F.col("amount"),
        "Payment Currency": F.lit("Euro"),
        "Payment Format": F.col("payment_format"),
        "Is Laundering": F.col("is_fraud"),
    }
    writers.write_raw_transactions(rows, path, columns)
    return path


@register(
    "a7_transaction_load",
    with_transfers(
        "SELECT timestamp, CAST(from_bank AS VARCHAR) AS from_bank, CAST(source AS VARCHAR) AS source, "
        "CAST(to_bank AS VARCHAR) AS to_bank, CAST(target AS VARCHAR) AS target, amount, payment_format, is_fraud FROM transfers"
    ),
)
def a7(spark, sf_dir):
    df = readers.read_transactions(spark, _raw_file(spark, sf_dir, "a7"))
    return df.select(*readers.CANONICAL_NAMES.values())


@register(
    "a8_raw_load",
    with_transfers(
        'SELECT timestamp AS "Timestamp", CAST(from_bank AS VARCHAR) AS "From Bank", CAST(source AS VARCHAR) AS "Account", '
        'CAST(to_bank AS VARCHAR) AS "To Bank", CAST(target AS VARCHAR) AS "Account.1", amount AS "Amount Received", '
        "'Euro' AS \"Receiving Currency\", amount AS \"Amount Paid\", 'Euro' AS \"Payment Currency\", "
        'payment_format AS "Payment Format", is_fraud AS "Is Laundering" FROM transfers'
    ),
)
def a8(spark, sf_dir):
    return readers.read_raw_transactions(spark, _raw_file(spark, sf_dir, "a8"))


def _pattern_file(spark, sf_dir, name):
    path = scratch_path(spark, name)
    rows = pattern_rows(spark, sf_dir)
    header = F.concat(F.lit(pattern_files.BEGIN + " - "), F.col("pattern_type"), F.lit(":  Max "), F.col("l_orderkey").cast("string"), F.lit(" hops"))
    money = F.format_string("%.2f", "amount")
    good = F.concat_ws(
        ",", writers.raw_time(F.col("timestamp")), "from_bank", "source", "to_bank", "target", money,
        F.lit("Euro"), money, F.lit("Euro"), "payment_format", F.lit("1"),
    )
    line = F.when(F.col("l_linenumber") == 7, F.lit("bad line")).otherwise(good)
    pattern_files.write_pattern_file(rows, path, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], header, line)
    return path


_PATTERN_COLUMNS = """timestamp, CAST(from_bank AS VARCHAR) AS from_bank, CAST(source AS VARCHAR) AS from_account,
 CAST(to_bank AS VARCHAR) AS to_bank, CAST(target AS VARCHAR) AS to_account, amount, 'Euro' AS amount_currency,
 amount AS received_amount, 'Euro' AS received_currency, payment_format, 1 AS is_fraud"""


@register(
    "a9_pattern_file",
    with_transfers(
        f"SELECT {_PATTERN_COLUMNS}, pattern_type, pattern_type AS pattern_type_full FROM pattern_rows WHERE l_linenumber <> 7",
        PATTERNS,
    ),
)
def a9(spark, sf_dir):
    return pattern_files.read_patterns(spark, _pattern_file(spark, sf_dir, "a9")).drop("file", "block")


@register(
    "a10_pattern_blocks",
    with_transfers(
        f"""SELECT {_PATTERN_COLUMNS},
 CASE l_orderkey % 4 WHEN 0 THEN 'FAN' WHEN 1 THEN 'CYCLE' WHEN 2 THEN 'GATHER' ELSE 'STACK' END AS type,
 CASE l_orderkey % 4 WHEN 0 THEN '-OUT:  ' WHEN 2 THEN '-SCATTER:  ' ELSE '' END || 'Max ' || l_orderkey || ' hops' AS characteristics
FROM pattern_rows WHERE l_linenumber <> 7""",
        PATTERNS,
    ),
)
def a10(spark, sf_dir):
    return pattern_files.read_pattern_blocks(spark, _pattern_file(spark, sf_dir, "a10")).drop("file", "block", "line_order")


@register(
    "a11_headerless_tsv",
    'SELECT o_orderkey AS "0", o_custkey AS "1", o_orderstatus AS "2", o_totalprice AS "3", o_orderpriority AS "4" FROM orders',
)
def a11(spark, sf_dir):
    path = scratch_path(spark, "a11")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    table(spark, sf_dir, "orders").select(*cols).write.option("sep", "\t").csv(path)
    schema = T.StructType([ORDERS[c] for c in cols])
    return readers.read_headerless_tsv(spark, path, schema)


@register("a13_predictions_sink", with_scores(f"SELECT {KEY}, score, label, DATE '2024-01-31' AS batch_date FROM scores"))
def a13(spark, sf_dir):
    path = scratch_path(spark, "a13")
    df = line_scores(spark, sf_dir).select(*ROW_KEY, "score", "label")
    writers.write_predictions(df, path, "2024-01-31", "parquet")
    return spark.read.parquet(path)


@register(
    "a14_validated_sinks",
    with_transfers(
        "SELECT 'accounts' AS name, count(*) AS n FROM (SELECT source FROM transfers UNION SELECT target FROM transfers) "
        "UNION ALL SELECT 'patterns', count(*) FROM transfers WHERE is_fraud = 1 UNION ALL SELECT 'trans', count(*) FROM transfers"
    ),
)
def a14(spark, sf_dir):
    rows = transfers(spark, sf_dir)
    accounts = rows.select(F.col("source").alias("id")).union(rows.select("target")).distinct()
    frames = {"accounts": accounts, "patterns": pattern_rows(spark, sf_dir), "trans": rows}
    paths = writers.write_validated(frames, scratch_path(spark, "a14"))
    out = None
    for name, path in paths.items():
        one = spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@register("a15_sorted_edges_csv", with_transfers("SELECT timestamp, source, target, amount, is_fraud FROM transfers"))
def a15(spark, sf_dir):
    path = scratch_path(spark, "a15")
    cols = ["timestamp", "source", "target", "amount", "is_fraud"]
    df = transfers(spark, sf_dir).select(*cols)
    writers.write_sorted_csv(df, path, ["timestamp", "source", "target", "amount"])
    return spark.read.schema(df.schema).option("header", True).csv(path)


@register(
    "a16_json_records_sink",
    with_transfers("SELECT payment_format, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS fraud FROM transfers GROUP BY 1"),
)
def a16(spark, sf_dir):
    path = scratch_path(spark, "a16")
    report = transfers(spark, sf_dir).groupBy("payment_format").agg(F.count(F.lit(1)).alias("n"), F.sum("is_fraud").alias("fraud"))
    writers.append_json(report, path)
    return spark.read.schema(report.schema).json(path)


@register(
    "a17_score_export",
    with_scores(
        f"""SELECT {KEY}, score, label,
 CAST(timestamp < TIMESTAMP '1996-01-01' AS INT) AS is_train,
 CAST(timestamp >= TIMESTAMP '1996-01-01' AND timestamp < TIMESTAMP '1997-06-01' AS INT) AS is_val,
 CAST(timestamp >= TIMESTAMP '1997-06-01' AS INT) AS is_test FROM scores"""
    ),
)
def a17(spark, sf_dir):
    path = scratch_path(spark, "a17")
    val, test = (F.lit(d).cast("timestamp_ntz") for d in ("1996-01-01", "1997-06-01"))
    rows = line_scores(spark, sf_dir).select(*ROW_KEY, "score", "label")
    schema = writers.export_scores(rows, path, "timestamp", val, test)
    return spark.read.schema(schema).parquet(path)
