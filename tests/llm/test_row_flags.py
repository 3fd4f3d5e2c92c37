"""Rows are dropped and repeated where they lie: no text moves to meet a list of row numbers."""

import pytest
from pyspark.sql import functions as F

from threadmetrics.llm import common, exact_dedup, mixing, simhash
from threadmetrics.session import apply_engine_conf

MOVES = ("Exchange hashpartitioning", "SortMergeJoin", "ShuffledHashJoin")


@pytest.fixture
def large(spark):
    """Joins as over large tables: the planner broadcasts nothing by itself."""
    apply_engine_conf(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [common.MAX_BITMAPS, 0])
def test_flagged_marks_exactly_the_listed_rows(large, most):
    rows = common.materialize(common.with_uid(large.range(0, 100_000, 1, 3).select(F.struct("id").alias("_row"))))
    want = F.expr("_row.id % 7 = 3 or _row.id in (0, 1, 7, 8, 32767, 32768, 32769, 33332, 33333, 99999)")
    listed = rows.filter(want).select("_uid")
    got = common.flagged(rows, listed.unionByName(listed), "_in", most)     # a number may be listed twice
    assert got.columns == ["_row", "_uid", "_in"]
    assert got.count() == 100_000 and got.filter(F.col("_in") != want).isEmpty()
    assert ("BroadcastHashJoin" in plan_of(got)) == (most > 0)
    assert common.flagged(rows, listed.limit(0), "_in", most).filter("_in").isEmpty()
    assert common.flagged(rows.limit(0), listed, "_in", most).count() == 0


def test_exact_copies_go_where_they_lie(large, monkeypatch):
    plans = {}

    def noted(df, name="state"):
        if {"_row", "text"} & set(df.columns):
            plans[name] = plan_of(df)
        return common.materialize(df, name)

    monkeypatch.setattr(exact_dedup, "materialize", noted)
    rows = [(i, "Same text" if i % 3 else f"text {i}", "x" * (i % 2)) for i in range(60)] + [(None, "SAME TEXT", None)]
    kept = exact_dedup.drop_duplicates(large.createDataFrame(rows, "doc_id long, text string, more string"))
    assert plans and not [n for n, p in {**plans, "": plan_of(kept)}.items() if any(m in p for m in MOVES)]
    assert sorted(map(tuple, kept.collect())) == sorted([r for r in rows if r[0] is not None and r[0] % 3 == 0] + [rows[59]])


def test_near_copies_go_where_they_lie(large):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, text, "a"), (3, text, "b"), (None, text, "c"), (9, "something else entirely", "d"), (3, text, "b")]
    kept = simhash.drop_near_duplicates(large.createDataFrame(rows, "doc_id long, text string, more string"))
    assert not any(m in plan_of(kept) for m in MOVES)
    assert sorted(map(tuple, kept.collect())) == [(3, text, "b"), (9, "something else entirely", "d")]


def test_mixed_rows_are_repeated_where_they_lie(large):
    rows = [(i, f"{('red', 'blau')[i % 4 == 0]} word {i} " * (3 + i % 5)) for i in range(80)]
    docs = large.createDataFrame(rows, "doc_id long, text string")
    labels = large.createDataFrame([(i, ("en", "de")[i % 4 == 0]) for i in range(80)], "doc_id long, domain string")
    made = mixing.mix(docs, labels, temperature=0.5, min_rate=1.0, keep_all=True)
    assert not any(m in plan_of(made) for m in MOVES)
    for domain in ("en", "de"):      # copies stay within one row of the fit
        mine = [r for r in made.collect() if r.domain == domain]
        assert mine and abs(sum(r.copies for r in mine) - sum(r.rate for r in mine)) <= 1
        assert all(r.copies - int(r.rate) in (0, 1) for r in mine)
    assert any(r.copies > int(r.rate) for r in made.collect())
