import random

from hypothesis import given, settings
from hypothesis import strategies as st

from threadmetrics.operators import tree

DDL = "post_id string, comment_id string, parent_id string, sibling_ord int, score int, body string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def test_rollup_golden(spark):
    rows = [
        ("p", "a", None, 0, 1, "tlc without replies"),
        ("p", "b", None, 1, 1, "tlc"),
        ("p", "b1", "b", 0, 5, "leaf http://x.y"),
        ("p", "c", None, 2, 0, "chain"),
        ("p", "c1", "c", 0, None, "one"),
        ("p", "c2", "c1", 0, 3, "two https://a.b/c?d=e, http://x"),
        ("p", "c3", "c2", 0, 0, "three ftp://x"),
    ]
    got = {r["Top_comment_id"]: r for r in tree.reply_rollup(frame(spark, rows)).collect()}
    assert tuple(got["a"])[1:] == (0, 0, 0, 0, 0)
    assert tuple(got["b"])[1:] == (1, 1, 1, 5, 1)
    assert tuple(got["c"])[1:] == (3, 3, 2, 3, 1)


def heights_by_recursion(parent):
    kids = {}
    for n, p in parent.items():
        kids.setdefault(p, []).append(n)
    memo = {}

    def h(n):
        if n not in memo:
            memo[n] = 1 + max((h(k) for k in kids.get(n, [])), default=0)
        return memo[n]

    def size(n):
        return 1 + sum(size(k) for k in kids.get(n, []))
    return {n: (h(n), size(n)) for n in parent}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10_000), min_size=1, max_size=40))
def test_doubling_matches_recursion(spark, picks):
    parent = {"n0": None}
    for i, x in enumerate(picks, start=1):
        parent[f"n{i}"] = None if x % 7 == 0 else f"n{x % i}"
    rows = [("p", n, p, 0, 1, "") for n, p in parent.items()]
    got = {r["comment_id"]: (r["height"], r["size"]) for r in tree.node_heights(frame(spark, rows)).collect()}
    assert got == heights_by_recursion(parent)


def test_deep_chain_levels(spark):
    depth = 1500
    rows = [("p", f"n{i}", None if i == 0 else f"n{i - 1}", 0, 1, "") for i in range(depth)]
    ann = {r["comment_id"]: (r["tlc_id"], r["level"]) for r in tree.annotate(frame(spark, rows)).collect()}
    assert ann[f"n{depth - 1}"] == ("n0", depth - 1)
    assert all(t == "n0" for t, _ in ann.values())


def test_orphan_kept(spark):
    rows = [("p", "a", None, 0, 1, ""), ("p", "x", "missing", 0, 1, ""), ("p", "y", "x", 0, 1, "")]
    ann = {r["comment_id"]: (r["tlc_id"], r["level"]) for r in tree.annotate(frame(spark, rows)).collect()}
    assert ann["a"] == ("a", 0)
    assert ann["x"][0] is None and ann["y"][0] is None


def test_same_result_any_partitioning(spark):
    random.seed(1)
    rows = [("p%d" % (i % 5), f"n{i}", None, 0, 1, "") for i in range(5)]
    rows += [("p%d" % (i % 5), f"n{i}", f"n{i - 5 * random.randint(1, i // 5)}", 0, 1, "") for i in range(5, 60)]
    df = frame(spark, rows)
    base = sorted(tree.node_heights(df).collect())
    for n in (1, 4, 13):
        assert sorted(tree.node_heights(df.repartition(n)).collect()) == base


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10_000), min_size=1, max_size=40))
def test_fused_tree_stats_match(spark, picks):
    parent = {"n0": None}
    for i, x in enumerate(picks, start=1):
        parent[f"n{i}"] = None if x % 7 == 0 else (f"n{x % i}" if x % 11 else "gone")
    df = frame(spark, [("p", n, p, 0, 1, "") for n, p in parent.items()])
    fused = {r["comment_id"]: (r["tlc_id"], r["level"] if r["tlc_id"] else None, r["height"], r["size"])
             for r in tree.tree_stats(df).collect()}
    ann = {r["comment_id"]: (r["tlc_id"], r["level"] if r["tlc_id"] else None) for r in tree.annotate(df).collect()}
    hs = {r["comment_id"]: (r["height"], r["size"]) for r in tree.subtree_stats(df).collect()}
    assert fused == {n: ann[n] + hs[n] for n in parent}


def test_hot_parent_split_path(spark):
    # one parent with many children plus a chain below: force the hot-key path
    rows = [("p", "root", None, 0, 1, "")]
    rows += [("p", f"k{i}", "root", i, 1, "") for i in range(60)]
    rows += [("p", f"c{i}", f"c{i - 1}" if i else "k0", 0, 1, "") for i in range(20)]
    df = frame(spark, rows)
    base = (sorted(tree.tree_stats(df).collect()), sorted(tree.annotate(df).collect()),
            sorted(tree.subtree_stats(df).collect()))
    spark.conf.set("threadmetrics.hotKeyRows", "5")
    try:
        hot = (sorted(tree.tree_stats(df).collect()), sorted(tree.annotate(df).collect()),
               sorted(tree.subtree_stats(df).collect()))
    finally:
        spark.conf.unset("threadmetrics.hotKeyRows")
    assert hot == base
    stats = {r["comment_id"]: r for r in base[0]}
    assert stats["root"]["size"] == 81 and stats["root"]["height"] == 22 and stats["c19"]["level"] == 21


def test_small_threads_need_no_key_count(spark, monkeypatch):
    """No key of a thread has more rows than the thread: where every thread is
    below the threshold, lookups by post write no copy of the left side."""
    from threadmetrics.operators import outcomes as oc
    from threadmetrics.operators import skew
    rows = [(f"p{p}", f"{p}_{i}", f"{p}_{i - 1}" if i else None, "ab"[i % 2]) for p in range(20) for i in range(5)]
    comments = spark.createDataFrame(rows, "post_id string, comment_id string, parent_id string, author string")
    spark.conf.set(skew.HOT_ROWS_CONF, "6")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    written = []
    plain = skew.materialize
    monkeypatch.setattr(skew, "materialize", lambda df, name="state": written.append(name) or plain(df, name))
    try:
        levels = {r["comment_id"]: r["level"] for r in tree.annotate(comments).collect()}
        runs = {r["comment_id"]: r["alt"] for r in oc.alternation(comments).collect()}
        stats = {r["comment_id"]: r["height"] for r in tree.tree_stats(comments).collect()}
    finally:
        spark.conf.unset(skew.HOT_ROWS_CONF)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert written == []
    assert levels["3_4"] == 4 and runs["3_4"] == 5 and stats["3_0"] == 5 and len(levels) == 100
