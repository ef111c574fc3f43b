"""Track observations derived from the star-schema tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBSERVED = ["sequence", "frame", "id", "x", "y", "w", "h", "confidence", "class_id", "visibility"]

SQL = """
obs as (select concat(l_returnflag, l_linestatus) as sequence, (date_diff('day', date '1992-01-01', cast(l_shipdate as date)) + 1)::int as frame,
               (l_suppkey + 1)::int as id, min(floor(l_extendedprice)::bigint % 1920)::double as x, min((l_partkey * 7) % 1080)::double as y,
               10::double + min(l_quantity) as w, 8::double + 2 * min(l_linenumber) as h, 1::double - min(l_discount) as confidence,
               min(l_linenumber % 3)::int as class_id, 1::double as visibility
        from lineitem group by 1, 2, 3),
gt as (select * from obs),
pred as (select sequence, frame, (id + 1000 * floor(frame / 400))::int as id, x + ((frame * 7 + id) % 11) - 5 as x, y + ((frame * 3 + id) % 7) - 3 as y,
                w, h, confidence, class_id, visibility from obs where (frame + id) % 13 <> 0),
ais as (select (o_custkey // 25)::varchar as mmsi, date_diff('day', date '1992-01-01', cast(o_orderdate as date))::double as ts,
               min(floor(o_totalprice)::bigint % 1920)::double as x, min(o_orderkey % 1080)::double as y, min(o_orderkey % 360)::double as angle
        from orders group by 1, 2)"""


def _day(column: str):
    return F.datediff(F.col(column).cast("date"), F.lit("1992-01-01").cast("date"))


#: Rows of a task, beyond which more tasks than ``spark.sql.shuffle.partitions`` share them.
ROWS = 500_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of so many rows, dealt by ``keys`` over more tasks where the session's number would leave a task more than ``ROWS``."""
    parts = -(-rows // ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per (sequence, frame, id)."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = [F.concat("l_returnflag", "l_linestatus").alias("sequence"), (_day("l_shipdate") + 1).cast("int").alias("frame"), (F.col("l_suppkey") + 1).cast("int").alias("id")]
    return spread(line.select(*keys, "l_extendedprice", "l_partkey", "l_quantity", "l_linenumber", "l_discount"), line.count(), "sequence", "id").groupBy("sequence", "frame", "id").agg(
        F.min(F.floor("l_extendedprice") % 1920).cast("double").alias("x"),
        F.min((F.col("l_partkey") * 7) % 1080).cast("double").alias("y"),
        (F.lit(10.0) + F.min("l_quantity")).alias("w"),
        (F.lit(8.0) + 2 * F.min("l_linenumber")).alias("h"),
        (F.lit(1.0) - F.min("l_discount")).alias("confidence"),
        F.min(F.col("l_linenumber") % 3).cast("int").alias("class_id"),
        F.lit(1.0).alias("visibility"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The true boxes: all observations."""
    return observations(spark, sf_dir)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jittered boxes with dropped frames and split identities."""
    o = observations(spark, sf_dir).where((F.col("frame") + F.col("id")) % 13 != 0)
    x, y = F.col("x") + (F.col("frame") * 7 + F.col("id")) % 11 - 5, F.col("y") + (F.col("frame") * 3 + F.col("id")) % 7 - 3
    new_id = (F.col("id") + 1000 * F.floor(F.col("frame") / 400)).cast("int")
    return o.select("sequence", "frame", new_id.alias("id"), x.alias("x"), y.alias("y"), "w", "h", "confidence", "class_id", "visibility")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transponder reports (mmsi, ts, x, y, angle) of all orders; 25 customers share a transponder."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    mmsi = F.floor(F.col("o_custkey") / 25).cast("long").cast("string").alias("mmsi")
    at = {"x": F.floor("o_totalprice") % 1920, "y": F.col("o_orderkey") % 1080, "angle": F.col("o_orderkey") % 360}
    return o.groupBy(mmsi, _day("o_orderdate").cast("double").alias("ts")).agg(*[F.min(v).cast("double").alias(k) for k, v in at.items()])
