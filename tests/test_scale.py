"""The skew-safe helpers against plain windows, with one key holding most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorewell.operators import ratelimit
from lorewell.operators.frontier import frontier
from lorewell.scale import first_per_key, following_row, running_total, top_per_key


def skewed(spark, n=500):
    random.seed(5)
    rows = [("hot" if random.random() < 0.7 else f"k{random.randrange(9)}", i * 3, random.randrange(5)) for i in range(n)]
    return spark.createDataFrame(rows, "k string, ord long, v int").repartition(6)


def test_running_total(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumn("t", F.coalesce(F.sum("v").over(w), F.lit(0)))
    mine = running_total(df, ["k"], [F.col("ord")], F.floor(F.col("ord") / 50), F.col("v"), "t")
    assert sorted(mine.collect()) == sorted(plain.collect())


def test_following_row(spark):
    df = skewed(spark)
    plain = df.withColumn("n", F.lead(F.struct("v")).over(Window.partitionBy("k").orderBy("ord")))
    mine = following_row(df, ["k"], "ord", F.floor(F.col("ord") / 40), ["v"], "n")
    assert sorted(map(str, mine.collect())) == sorted(map(str, plain.select(*mine.columns).collect()))


def test_ranks_shrink_before_the_shuffle(spark):
    df = top_per_key(skewed(spark), ["k"], [F.desc("ord")], 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert first_per_key(skewed(spark), ["k"], [F.desc("ord")]).count() == 10


def bucket_by_hand(rows, period):
    level, seen, out = {}, {}, {}
    for rid, key, t, c in sorted(rows, key=lambda r: (r[2], r[0])):
        now = c * period if key not in level else min(c * period, level[key] + c * (t - seen[key]))
        out[rid] = now >= period
        level[key], seen[key] = now - (period if out[rid] else 0), t
    return out


def test_token_bucket_slices(spark):
    random.seed(8)
    rows, t = [], 0
    for i in range(3000):
        t += random.choice([0, 1, 3, 40, 700, 5000 if i % 300 == 0 else 90])
        rows.append((i, "hot" if random.random() < 0.6 else f"k{random.randrange(12)}", t, 0))
    rows = [(i, k, t, 7 if k == "hot" else 2) for i, k, t, _ in rows]
    df = spark.createDataFrame(rows, "request_id long, bucket_key string, micros long, capacity int").repartition(5)
    for width in (150, 2000, 10**9):
        got = {r.request_id: r.allowed for r in ratelimit.token_bucket(df, 1000, width).collect()}
        assert got == bucket_by_hand(rows, 1000)
    assert 0 < sum(got.values()) < len(rows)


def test_slices_stay_whole_when_a_join_is_split(spark):
    """A join whose large partitions Spark splits: the slices are still replayed by one task each."""
    random.seed(9)
    rows = [(i, f"k{i % 3}", random.randrange(20_000), 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "request_id long, bucket_key string, micros long, capacity int").repartition(8)
    split = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    try:
        for name, value in split.items():
            spark.conf.set(name, value)
        got = {r.request_id: r.allowed for r in ratelimit.token_bucket(df, 1000, 5000).collect()}
    finally:
        for name in split:
            spark.conf.unset(name)
    assert got == bucket_by_hand(rows, 1000)


def test_third_request_is_denied(spark):
    base = "2024-01-01 00:00:0"
    rows = [(i, f"{base}{i}", p, "1.1.1.1", s) for i, (p, s) in enumerate([
        ("/api/chat/a", "s"), ("/api/chat/a", "s"), ("/api/chat/a", "s"), ("/api/chat/a", "z"), ("/health", None), ("/api/admin/auth/login", None)])]
    df = spark.createDataFrame(rows, "request_id long, t string, path string, ip string, session string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    limits = {"chat_session": 2, "chat_ip": 3, "login_ip": 1}
    rows = ratelimit.rate_limit_replay(df, limits).orderBy("request_id").collect()
    assert [r.allowed for r in rows] == [True, True, False, False, True, True]


def test_frontier_shortest_depth_and_hosts(spark):
    h = "https://h.example.org/"
    edges = [(h + a, h + b) for a, b in ["ab", "bc", "cd", "ac", "da", "de", "ef"]] + [(h + "a", "https://o.example.org/x")]
    got = frontier(spark.createDataFrame([(h + "a",)], "url string"), spark.createDataFrame(edges, "src string, dst string"), 3)
    assert {r.url[-1]: r.depth for r in got.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
