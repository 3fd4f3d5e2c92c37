from pyspark.sql import Window
from pyspark.sql import functions as F

from threadmetrics.operators import halves as hv
from threadmetrics.operators.grouprank import group_rank

DDL = ("post_id string, comment_id string, parent_id string, sibling_ord int, subreddit string, "
       "subreddit_id string, author string, score int, created_utc bigint, body string")


def comments(spark, rows):
    return spark.createDataFrame(
        [(p, c, par, 0, "s", "t5_s", "u", sc, t, "b") for p, c, par, sc, t in rows], DDL)


def test_heights_kept_after_split(spark):
    # chain t - a - b - c - d by time; first half {a, b} reports the whole-tree height of a
    rows = [("p", "t", None, 1, 0), ("p", "a", "t", 1, 10), ("p", "b", "a", None, 20),
            ("p", "c", "b", 2, 30), ("p", "d", "c", 3, 40)]
    halves = hv.time_halves(hv.replies_with_heights(comments(spark, rows)))
    got = {(r["Top_comment_id"], r["half"]): r for r in hv.fixed_half_features(halves).collect()}
    assert got[("t", 0)]["Replies_max_depth"] == 4
    assert got[("t", 1)]["Replies_max_depth"] == 2
    assert got[("t", 0)]["Replies_sum_score"] == 1   # NULL adds 0
    assert got[("t", 0)]["Top_comment_direct_children"] == 1
    assert got[("t", 1)]["Top_comment_direct_children"] == 1  # total over both halves


def test_direct_total_in_second_half(spark):
    rows = [("p", "t", None, 1, 0), ("p", "a", "t", 1, 10), ("p", "b", "t", 1, 20),
            ("p", "c", "t", 1, 30), ("p", "d", "a", 1, 40)]
    halves = hv.time_halves(hv.replies_with_heights(comments(spark, rows)))
    got = {(r["Top_comment_id"], r["half"]): r for r in hv.fixed_half_features(halves).collect()}
    assert got[("t", 0)]["Top_comment_direct_children"] == 2
    assert got[("t", 1)]["Top_comment_direct_children"] == 3


def test_odd_and_zero_dropped(spark):
    rows = [("p", "t", None, 1, 0), ("p", "u", None, 1, 0), ("p", "a", "u", 1, 5),
            ("p", "v", None, 1, 0), ("p", "b", "v", 1, 5), ("p", "c", "v", 1, 6)]
    halves = hv.time_halves(hv.replies_with_heights(comments(spark, rows)))
    assert {r["tlc_id"] for r in halves.collect()} == {"v"}


def test_strata_thresholds(spark):
    rows = []
    for size, sub in ((49, "a"), (50, "b"), (100, "c"), (101, "d")):
        rows += [(sub, f"t5_{sub}", f"{sub}{i}", 2) for i in range(size)]
    even = spark.createDataFrame(rows, "Top_comment_subreddit string, Top_comment_subreddit_id string, "
                                       "Top_comment_id string, n_replies bigint")
    s = hv.stratified_sample(even)
    counts = {r[0]: r[1] for r in s.groupBy("Top_comment_subreddit").count().collect()}
    assert counts == {"b": 50, "c": 100, "d": 100}
    again = hv.stratified_sample(even.repartition(7))
    assert sorted(s.collect()) == sorted(again.collect())


def test_group_rank_splits_hot_groups(spark):
    rows = [("hot", i % 37, f"c{i:04d}") for i in range(900)] + [("cold", i, f"d{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "g string, t long, c string")
    got = group_rank(df, ["g"], ["t", "c"], hot_rows=50, pieces=8)
    w = Window.partitionBy("g").orderBy("t", "c")
    want = df.withColumn("rank", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g")))
    assert sorted(got.select("g", "t", "c", "rank", "n").collect()) == sorted(want.collect())
