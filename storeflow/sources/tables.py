"""The given tables as the library's inputs. Columns are read as needed; timestamps become bigint milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def observations(spark: SparkSession, d: str) -> DataFrame:
    """events as observations: event_id, person_id, zone, ms, value."""
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("person_id"), F.col("event_type").alias("zone"), F.expr("unix_micros(cast(ts as timestamp)) div 1000").alias("ms"), "value")


#: The same in DuckDB, as the first common table expression of an oracle.
OBS_SQL = "ev AS (SELECT event_id, user_id AS person_id, event_type AS zone, epoch_us(ts) // 1000 AS ms, value FROM events)"


def order_intervals(spark: SparkSession, d: str) -> DataFrame:
    """orders as intervals of days: id, key (customer), s, e: open for 3 to 9 days from the order date."""
    o = table(spark, d, "orders")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("bigint")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), day.alias("s"), (day + 3 + F.col("o_orderkey") % 7).alias("e"), F.col("o_totalprice").alias("price"))


ORDERS_SQL = "iv AS (SELECT o_orderkey AS id, o_custkey AS key, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS s, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) + 3 + o_orderkey % 7 AS e, o_totalprice AS price FROM orders)"


def pieces(df: DataFrame, rows: int = 1 << 18, least: int | None = None) -> int:
    """Tasks of about `rows` rows each for df, so that none sorts more when the table grows; Parquet's footers give the count.

    At least `least`, else Spark's shuffle partitions. Where another shuffle follows, fewer are better: each task writes a file
    a partition there, however few its rows.
    """
    return max(-(-df.count() // rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) if least is None else least)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a single machine may leave it unset."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return root.rstrip("/")


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()
