"""The order network: same pairs as counted plainly, and no task that sums up a whole split before rows are dealt."""

from pyspark.sql import functions as F

from inquest import views
from tests.conftest import SMALL


def test_lines_are_dealt_before_they_are_summed_up(spark):
    plan = str(views.order_pairs(spark, SMALL)._jdf.queryExecution().sparkPlan().toString()).splitlines()
    scan = next(i for i, line in enumerate(plan) if "FileScan" in line and "l_suppkey" in line)
    above = []
    for line in reversed(plan[:scan]):
        if "Exchange" in line or "Repartition" in line:
            break
        above.append(line)
    assert above and not any("Aggregate" in line for line in above)


def test_tasks_grow_with_the_lines_and_pairs_stay_the_same(spark, monkeypatch, tmp_path):
    whole = sorted(map(tuple, views.order_pairs(spark, SMALL).collect()))
    monkeypatch.setattr(views, "LINES_IN_TASK", 1000)
    lines = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    assert views._order_suppliers(lines).rdd.getNumPartitions() == -(-lines.count() // 1000)
    assert sorted(map(tuple, views.order_pairs(spark, SMALL).collect())) == whole
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    plain = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count_distinct("l_orderkey").cast("double"))
    assert whole == sorted((f"C{c}", f"S{s}", w) for c, s, w in plain.collect())


def test_no_lines_no_pairs(spark, tmp_path):
    for name in ("lineitem", "orders"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert views.order_pairs(spark, str(tmp_path)).count() == 0
