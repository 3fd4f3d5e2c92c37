"""How often the mixing operator reads its rows, and how it counts the words of its lists."""

import re

import numpy as np
from pyspark.sql import functions as F

from threadmetrics.llm import mixing


def made(seed):
    rng = np.random.default_rng(seed)
    return rng.dirichlet([0.05] * 3, 300), rng.integers(1, 2000, 300).astype(float)


def rounded(p, t, calls):
    """``evaluate`` over arrays, with sums in whole parts of a token as over a table."""
    def sums(x):
        return np.rint(x * mixing.UNIT).sum(axis=0) / mixing.UNIT / t.sum()
    s = p @ sums(p * t[:, None])

    def evaluate(moves, v):
        calls.append(v)
        a = np.ones(len(t))
        for m in moves:
            a = np.maximum(0.0, a - p @ np.array(m) / s)
        x = a - p @ np.array(v) / s
        gram = [[float(sums((x > 0) * t / s * p[:, d] * p[:, e])) for e in range(3)] for d in range(3)]
        return list(sums((np.maximum(x, 0) * t)[:, None] * p)), gram, float(sums(t * s * np.maximum(x, 0) ** 2 / 2))
    return evaluate


def test_shorter_steps_are_looked_at_together():
    """Near the minimum the rounding of the sums hides the fall; each of up to 20 shorter lengths took a pass of its own."""
    for seed in range(12):
        calls, batches = [], []
        evaluate = rounded(*made(seed), calls)

        def values(moves, vs, evaluate=evaluate, batches=batches):
            batches.append(len(vs))
            return [evaluate(moves, v)[2] for v in vs]
        got = mixing.descend(evaluate, [0.2, 0.3, 0.5], values=values)
        passes = len(calls) - sum(batches) + len(batches)
        assert got == mixing.descend(evaluate, [0.2, 0.3, 0.5])
        assert np.allclose(got[1], [0.2, 0.3, 0.5], rtol=1e-4) and passes <= 50, (seed, passes)      # up to 148 before


def test_values_are_those_of_one_pass_each(spark, monkeypatch):
    p, t = made(19)
    t = t // 10 + 1
    soft = spark.createDataFrame([(float(a), *map(float, b)) for a, b in zip(t, p, strict=True)],
                                 "tokens double, p0 double, p1 double, p2 double").coalesce(1).cache()
    seen, passes, sums = [], [], mixing.whole_sums
    monkeypatch.setattr(mixing, "whole_sums", lambda rows, cols: passes.append(len(cols)) or sums(rows, cols))

    def descend(evaluate, target, steps, values):
        moves, vs = [[-0.3, 0.1, 0.2]], [[0.0, 0.0, 0.0], [0.1, -0.2, 0.3], [-0.5, 0.25, 0.125], [-1e7, 0.0, 0.0]]
        one_by_one = [evaluate(moves, v)[2] for v in vs]
        passes.clear()
        seen.append((values(moves, vs), one_by_one))
        return moves, target
    monkeypatch.setattr(mixing, "descend", descend)
    mixing.fit_rates(soft, [t.sum() * x for x in (0.2, 0.3, 0.5)])
    assert seen[0][0] == seen[0][1] and seen[0][0][3] == float("inf") and passes == [8]


def test_hits_are_looked_up_once_and_blanks_are_the_same_six(spark):
    lists = [["the", "cat", "né"], ["der", "the"], []]
    model = mixing.DomainModel(["en", "de", "xx"], lists, [], [])
    texts = [None, "", " ", "the", " The the\tcat ", "der\x0bthe\fcat\r\n\ncat x", "the cat der\x1cthe", "NÉ \x85 der",
             "\x1fcat the the"]
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", (x or "").lower()) if w] for x in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("w", mixing._words(F.col("text")))
    rows = rows.select("id", "w", model.known(F.col("w")).alias("known"))
    got = rows.select("id", "w", *[h.alias(f"h{d}") for d, h in enumerate(model.hits(F.col("known")))]).orderBy("id").collect()
    assert [r["w"] for r in got] == words
    assert [[r[f"h{d}"] for d in range(3)] for r in got] == [[len(set(w) & set(ws)) for ws in lists] for w in words]
