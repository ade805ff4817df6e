"""Graphs over the relational and event tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.model import PropertyGraph

CODES = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6}
SPAN = 10**10


def vertex_id(kind: str, key: str) -> Column:
    """Ids of a kind are its code times ten to the tenth, and the key."""
    return (F.lit(CODES[kind] * SPAN) + F.col(key)).cast("long")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts and orders, joined by what orders and items say.

    Kinds and labels are literals of the union's branches, so a pattern that
    names one reads only that branch's table and columns.  Keys are unique as
    made; nothing needs to be deduplicated afterwards.
    """
    load = lambda name: read(spark, sf_dir, name)

    def vertices(table: str, kind: str, key: str, /, **columns: str) -> DataFrame:
        named = [F.expr(c).alias(a) for a, c in columns.items()]
        return load(table).select(vertex_id(kind, key).alias("id"), F.lit(kind).alias("type"), F.col(key).cast("long").alias("key"), *named)

    def edges(df: DataFrame, label: str, source: tuple[str, str], target: tuple[str, str], **values: Column) -> DataFrame:
        ends = vertex_id(*source).alias("src"), vertex_id(*target).alias("dst")
        return df.select(*ends, F.lit(label).alias("label"), *(v.alias(k) for k, v in values.items()))

    def summed(a: str, b: str, items: DataFrame) -> DataFrame:
        return items.groupBy(a, b).agg(F.sum("l_quantity").alias("weight"))

    parts = [
        vertices("region", "Region", "r_regionkey", name="r_name"),
        vertices("nation", "Nation", "n_nationkey", name="n_name"),
        vertices("customer", "Customer", "c_custkey", name="c_name", acctbal="c_acctbal", segment="c_mktsegment"),
        vertices("supplier", "Supplier", "s_suppkey", name="s_name", acctbal="s_acctbal"),
        vertices("part", "Part", "p_partkey", name="p_name", brand="p_brand", kind="p_type", size="cast(p_size as double)", price="p_retailprice"),
        vertices("orders", "Order", "o_orderkey", status="o_orderstatus", totalprice="o_totalprice", priority="o_orderpriority"),
    ]
    items = load("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    links = [
        edges(load("orders"), "placed", ("Customer", "o_custkey"), ("Order", "o_orderkey"), weight=F.lit(1.0)),
        edges(summed("l_orderkey", "l_partkey", items), "contains", ("Order", "l_orderkey"), ("Part", "l_partkey"), weight=F.col("weight")),
        edges(summed("l_partkey", "l_suppkey", items), "supplied_by", ("Part", "l_partkey"), ("Supplier", "l_suppkey"), weight=F.col("weight")),
        edges(summed("l_orderkey", "l_suppkey", items), "fulfilled_by", ("Order", "l_orderkey"), ("Supplier", "l_suppkey"), weight=F.col("weight")),
        edges(load("customer"), "located_in", ("Customer", "c_custkey"), ("Nation", "c_nationkey"), weight=F.lit(1.0)),
        edges(load("supplier"), "located_in", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), weight=F.lit(1.0)),
        edges(load("nation"), "in_region", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), weight=F.lit(1.0)),
    ]

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame, allowMissingColumns=True)
        return out

    return PropertyGraph(union(parts), union(links))


def event_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Users, and who acted after whom within each hour.

    An event's user follows the user of the hour's event before it; the edge's
    label is the event's type, its weight the mean value.
    """
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    hour = Window.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    steps = events.withColumn("src", F.lag("user_id").over(hour)).where("src is not null")
    edges = steps.groupBy("src", F.col("user_id").alias("dst"), F.col("event_type").alias("label")).agg(F.avg("value").alias("weight"), F.count("*").alias("times"))
    users = events.groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return PropertyGraph(users.withColumn("type", F.lit("User")), edges)
