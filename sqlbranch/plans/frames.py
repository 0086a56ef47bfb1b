"""Queries of the DataFrame operators: bag set operations, top-k, diffs, merges, rollups, functions of the user, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions
from ..operators.diffmerge import keyed_diff, multiset_diff, multiset_merge, three_way_merge
from ..operators.relational import bag_except, bag_intersect, nearest, top_k, whole_partition
from ..streaming.events import read_stream, sessions, windowed_counts
from .registry import folder as registry_folder
from .registry import query, table


@query("SELECT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def intersect_bag(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return bag_intersect(left, table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def except_bag(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return bag_except(left, table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def top_k_per_group(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return top_k(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 2, ["o_custkey"])


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 25")
def top_k_rows(spark, sf_dir):
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return top_k(table(spark, sf_dir, "lineitem").select(*names, "l_extendedprice"), [F.col("l_extendedprice").desc(), *map(F.col, names)], 25)


@query("SELECT p_partkey, max(p_retailprice) OVER (PARTITION BY p_brand) AS dearest FROM part")
def whole_partition_max(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", whole_partition(F.max("p_retailprice"), ["p_brand"]).alias("dearest"))


@query("SELECT vec_id, round(list_distance(embedding::DOUBLE[], [0.5 for x in range(64)]::DOUBLE[]), 4) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], [0.5 for x in range(64)]::DOUBLE[]) LIMIT 5")
def nearest_vectors(spark, sf_dir):
    found = nearest(table(spark, sf_dir, "embeddings"), "embedding", [0.5] * 64, 5)
    return found.select("vec_id", F.round("distance", 4).alias("distance"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'delete' ELSE 'update' END AS op FROM customer WHERE c_custkey % 10 = 0 OR c_custkey % 7 = 0
       UNION ALL SELECT c_custkey + 1000000, 'insert' FROM customer WHERE c_custkey % 50 = 1"""
)
def diff_keyed(spark, sf_dir):
    old = table(spark, sf_dir, "customer")
    kept = old.filter("c_custkey % 10 != 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    new = kept.unionByName(old.filter("c_custkey % 50 = 1").withColumn("c_custkey", F.col("c_custkey") + 1000000))
    return keyed_diff(old, new, ["c_custkey"]).select("c_custkey", "op")


@query("SELECT c_nationkey, CAST(sum(CASE WHEN c_acctbal > 9000 THEN -1 WHEN c_acctbal < -900 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM customer GROUP BY c_nationkey HAVING n != 0")
def diff_multiset(spark, sf_dir):
    old = table(spark, sf_dir, "customer")
    new = old.filter("c_acctbal <= 9000").unionByName(old.filter("c_acctbal < -900"))
    return multiset_diff(old.select("c_nationkey"), new.select("c_nationkey")).select("c_nationkey", F.col("n").cast("long"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'ours' WHEN n_nationkey % 5 = 0 THEN 'theirs' ELSE n_name END AS n_name FROM nation WHERE n_nationkey != 7")
def merge_three_way(spark, sf_dir):
    base = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    ours = base.withColumn("n_name", F.when(F.col("n_nationkey") % 3 == 0, "ours").otherwise(F.col("n_name")))
    theirs = base.withColumn("n_name", F.when(F.col("n_nationkey") % 5 == 0, "theirs").otherwise(F.col("n_name"))).filter("n_nationkey != 7")
    return three_way_merge(base, ours, theirs, ["n_nationkey"], "ours").merged


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 15 = 0")
def merge_conflicts(spark, sf_dir):
    base = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    change = lambda k: base.withColumn("n_name", F.when(F.col("n_nationkey") % k == 0, f"by {k}").otherwise(F.col("n_name")))
    return three_way_merge(base, change(3), change(5), ["n_nationkey"]).conflicts.select("n_nationkey")


@query("SELECT c_mktsegment FROM customer WHERE c_acctbal <= 9000 UNION ALL SELECT c_mktsegment FROM customer WHERE c_acctbal < 0")
def merge_multiset(spark, sf_dir):
    base = table(spark, sf_dir, "customer")
    ours, theirs = base.filter("c_acctbal <= 9000"), base.unionByName(base.filter("c_acctbal < 0"))
    return multiset_merge(*(d.select("c_mktsegment") for d in (base, ours, theirs)))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
def rollup_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, substr(o_orderpriority, 1, 3) AS p FROM orders")
def shim_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", functions.column("substr", "o_orderpriority", "-4", "3").alias("p"))


@query("SELECT user_id, count(*) AS n FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts - p > INTERVAL 12 HOUR GROUP BY user_id")
def sessions_by_gap(spark, sf_dir):
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts"))
    starts = table(spark, sf_dir, "events").withColumn("p", before).filter("p IS NULL OR ts - p > INTERVAL '12' HOUR")
    return starts.groupBy("user_id").agg(F.count("*").alias("n"))


def _drained(frame, mode: str):
    """All that a streaming query over the files that are there now gives, as a table."""
    spark = frame.sparkSession
    folder = registry_folder(spark)
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{folder}/out")


# The last windows stay open until later events arrive, so the stream is followed by one far event, and its window isn't asked for.
def _events_and_end(spark, sf_dir):
    folder = registry_folder(spark)
    events = table(spark, sf_dir, "events")
    events.write.parquet(f"{folder}/events/part=1")
    events.agg(F.max("ts").alias("last")).select(F.lit(-1).cast("long").alias("event_id"), F.expr("last + INTERVAL 30 DAYS").alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("").alias("props")).write.parquet(f"{folder}/events/part=2")
    return read_stream(spark, f"{folder}/events")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    counts = _drained(windowed_counts(_events_and_end(spark, sf_dir)), "append")
    return counts.filter("event_type != 'end'").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts - p >= INTERVAL 30 MINUTE")
def stream_sessions(spark, sf_dir):
    found = _drained(sessions(_events_and_end(spark, sf_dir)), "append")
    return found.filter("user_id >= 0").agg(F.count("*").alias("n"))
