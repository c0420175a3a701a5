import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlens.operators.sequence import index_within, neighbour


def test_index_within_matches_row_number_under_skew(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(6000):
        key = 0 if i % 3 == 0 else rnd.randint(1, 50)      # key 0 holds a third of all rows
        rows.append((key, rnd.randint(0, 10_000), i, float(rnd.randint(1, 9))))
    df = spark.createDataFrame(rows, "k int, o int, id int, v double")
    got = index_within(df, ["k"], [F.asc("o"), F.asc("id")], out="seq", running_sum="v", partitions=7)
    w = Window.partitionBy("k").orderBy("o", "id")
    exp = df.withColumn("seq", F.row_number().over(w) - 1).withColumn("cum", F.sum("v").over(w))
    a = {r["id"]: (r["seq"], r["seq_cum"]) for r in got.collect()}
    b = {r["id"]: (r["seq"], r["cum"]) for r in exp.collect()}
    assert a == b


def test_global_index_and_neighbour(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(101)], "id int, o int")
    idx = index_within(df, [], [F.asc("o")], partitions=5)
    assert sorted(r["seq"] for r in idx.collect()) == list(range(101))
    nb = neighbour(idx, [], "seq", ["o"], 1, "next_").collect()
    assert all((r["next_o"] is None and r["seq"] == 100) or r["next_o"] == r["o"] + 1 for r in nb)


def test_carry_prev_next_matches_lag_lead(spark):
    rnd = random.Random(11)
    rows = [(0 if i % 3 == 0 else rnd.randint(1, 20), rnd.randint(0, 500), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, o int, id int")
    got = index_within(df, ["k"], [F.asc("o"), F.asc("id")], carry=["id"], partitions=9)
    w = Window.partitionBy("k").orderBy("o", "id")
    exp = df.withColumn("p", F.lag("id").over(w)).withColumn("n", F.lead("id").over(w))
    a = {r["id"]: (r["prev_id"], r["next_id"]) for r in got.collect()}
    b = {r["id"]: (r["p"], r["n"]) for r in exp.collect()}
    assert a == b


def test_index_is_exact_when_bounds_are_sampled(spark):
    # many more rows than the range sampler looks at, and columns that only the final join needs
    n = 300_000
    df = (spark.range(n, numPartitions=16)
          .select((F.col("id") % 3).alias("k"), F.pmod(F.hash("id"), F.lit(1000)).alias("o"), "id",
                  F.concat(F.lit("extra "), F.col("id")).alias("extra")))
    got = index_within(df, ["k"], [F.asc("o"), F.asc("id")], out="seq", partitions=64)
    w = Window.partitionBy("k").orderBy("o", "id")
    exp = df.select("id", (F.row_number().over(w) - 1).alias("want"))
    both = got.join(exp, "id")
    assert both.count() == n and both.where("seq <> want").count() == 0
    assert got.select("k", "seq").distinct().count() == n
