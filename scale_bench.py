"""Times the revenue query against plain joins on enlarged data, with and without a hot order.

Line items and orders of BENCH_SF_DIR are copied SCALE times under new keys and written
to a new folder under /tmp; in the second data set a third of the items are on one order.
Prints one JSON line for each data set, join setting and plan: the best of RUNS runs.
Environment: BENCH_SF_DIR, BENCH_CPUS, SCALE (20), RUNS (3).
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import functions as F

from tallyframe.plans.revenue import revenue_by_nation_of
from tallyframe.session import local_session
from tallyframe.sources.tables import read_table


def enlarged(spark, sf_dir: str, scale: int, hot: bool, out: str):
    copies = spark.range(scale).withColumnRenamed("id", "copy")
    step = 10**9
    items = read_table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(copies))
    key = F.col("l_orderkey") + F.col("copy") * step
    if hot:
        key = F.when(F.xxhash64("l_orderkey", "l_partkey", "copy") % 3 == 0, F.lit(1)).otherwise(key)
    items.withColumn("l_orderkey", key.cast("bigint")).drop("copy").write.parquet(f"{out}/lineitem")
    orders = read_table(spark, sf_dir, "orders").crossJoin(F.broadcast(copies))
    key = F.col("o_orderkey") + F.col("copy") * step
    orders.withColumn("o_orderkey", key).drop("copy").write.parquet(f"{out}/orders")
    return [spark.read.parquet(f"{out}/{t}") for t in ("lineitem", "orders")] + [
        read_table(spark, sf_dir, t) for t in ("customer", "nation")
    ]


def joined_then_grouped(kind: str):
    def plan(lineitem, orders, customer, nation):
        price, discount = F.col("l_extendedprice"), F.col("l_discount")
        if kind == "decimal":
            price, discount = price.cast("decimal(15,2)"), discount.cast("decimal(4,2)")
        return (
            lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("n_name")
            .agg(F.sum(price * (1 - discount)).alias("revenue"), F.count(F.lit(1)).alias("n_items"))
        )

    return plan


PLANS = {
    "join, then group; doubles": joined_then_grouped("double"),
    "join, then group; decimals": joined_then_grouped("decimal"),
    "this package": revenue_by_nation_of,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus, scale = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("SCALE", "20"))
    spark = local_session("scale_bench", cpus)
    folder = tempfile.mkdtemp(prefix="spark-scale-")
    for hot in (False, True):
        tables = enlarged(spark, sf_dir, scale, hot, f"{folder}/{'hot' if hot else 'even'}")
        for broadcast in ("-1", "10485760"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
            for name, plan in PLANS.items():
                best = float("inf")
                for _ in range(int(os.environ.get("RUNS", "3"))):
                    start = time.perf_counter()
                    plan(*tables).write.format("noop").mode("overwrite").save()
                    best = min(best, time.perf_counter() - start)
                row = {"plan": name, "hot_order": hot, "broadcast": broadcast != "-1", "scale": scale}
                print(json.dumps(row | {"cpus": cpus, "seconds": round(best, 2)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
