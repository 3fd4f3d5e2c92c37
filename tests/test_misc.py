import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmetrics.operators import category as cg
from threadmetrics.operators import merge as mg
from threadmetrics.operators import ml
from threadmetrics.operators import scores as sc
from threadmetrics.operators import vocab as vb
from threadmetrics.sources import jsonl


def test_pair_scores_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 0)], "pred int, gold int")
    r = sc.pair_scores(df, "pred", "gold").first()
    assert abs(r["accuracy"] - 2 / 3) < 1e-12 and r["recall_r"] is None and r["f1_score"] is None


def test_rank_pair(spark):
    df = spark.createDataFrame([(3.0, 1.0, "k"), (1.0, 3.0, "k"), (2.0, 2.0, "k"), (2.0, 2.0, "k")], "l double, r double, k string")
    got = [r[0] for r in df.select(sc.rank_pair(F.col("l"), F.col("r"), F.col("k"))).collect()]
    assert got[:2] == [0, 1] and got[2] == got[3] and got[2] in (0, 1)


def test_vocabulary_band_edges(spark):
    # 20 documents with 11 tokens; "edge" in 18 = 0.9 N docs (dropped), "low" in exactly 10 (kept)
    docs = []
    for i in range(20):
        tag = chr(97 + i)
        words = ["filler"] * 8 + ["w" + tag, "low" if i < 10 else "x" + tag, "edge" if i < 18 else "y" + tag]
        docs.append((i, " ".join(words)))
    docs.append((99, " ".join(["short"] * 10)))  # exactly 10 valid tokens: dropped
    df = spark.createDataFrame(docs, "doc_id long, text string")
    t = vb.token_docs(df, "doc_id", "text")
    assert t.count() == 20
    v = {r["word"]: r["doc_freq"] for r in vb.vocabulary(t).collect()}
    assert v.get("low") == 10 and "edge" not in v and "filler" not in v


def test_dictionary_default_and_gap(spark):
    names = spark.createDataFrame([("b",), ("a",), ("a",)], "n string")
    d = cg.category_ids(names, "n")
    assert {r["name"]: r["category_id"] for r in d.collect()} == {"a": 1, "b": 2, "<generic>": 0}
    assert cg.id_check(d).first()["ids_contiguous"] is True
    gap = d.withColumn("category_id", F.when(F.col("name") == "b", 5).otherwise(F.col("category_id")))
    assert cg.id_check(gap).first()["ids_contiguous"] is False
    look = cg.lookup(spark.createDataFrame([("a",), ("zzz",), (None,)], "n string"), "n", d)
    assert sorted(r["category_id"] for r in look.collect()) == [0, 0, 1]


def test_dedupe_stable(spark):
    rows = [(k % 7, v, float(v % 5)) for k, v in zip(range(200), range(200, 0, -1))]
    df = spark.createDataFrame(rows, "k int, a int, b double")
    base = sorted(mg.dedupe(df, ["k"]).collect())
    for n in (1, 8, 31):
        assert sorted(mg.dedupe(df.repartition(n), ["k"]).collect()) == base


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double, d double")
    p = ml.fit_pca(df, ["a", "b", "c", "d"], 4)
    xc = x - x.mean(axis=0)
    w, v = np.linalg.eigh(np.cov(xc, rowvar=False))
    order = np.argsort(w)[::-1]
    assert np.allclose(p.ratios, (w[order] / w.sum()), atol=1e-9)
    scores = {r["id"]: [r[f"PC{j}"] for j in range(4)] for r in p.transform(df, "id").collect()}
    for j in range(4):
        vec = v[:, order[j]]
        vec = vec if vec[np.argmax(np.abs(vec))] > 0 else -vec
        assert np.allclose([scores[i][j] for i in range(300)], xc @ vec, atol=1e-8)


def test_json_deep_and_malformed(spark):
    def chain(pid, depth):
        root = {"id": pid, "title": "t", "selftext": "s", "children": []}
        cur = root
        for i in range(depth):
            n = {"id": f"{pid}-{i}", "body": "b", "children": []}
            cur["children"].append(n)
            cur = n
        return json.dumps(root)
    d = tempfile.mkdtemp(prefix="tm-json-")
    with open(os.path.join(d, "posts.jsonl"), "w") as f:
        f.write(chain("shallow", 3) + "\n")
        f.write(chain("deep", 1200) + "\n")
        f.write('{"id": "broken", "children": [\n')
        f.write(json.dumps({"id": "empty", "children": []}) + "\n")
    posts, comments = jsonl.read_threads(spark, d)
    got = {r["post_id"]: r["n"] for r in comments.groupBy("post_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"shallow": 3, "deep": 1200}
    assert sorted(r["post_id"] for r in posts.collect()) == ["deep", "empty", "shallow"]
    last = comments.filter(F.col("comment_id") == "deep-1199").first()
    assert last["parent_id"] == "deep-1198" and last["score"] is None


def test_json_very_deep_and_rejects(spark):
    depth = 50_000
    line = '{"id": "deep", "children": [' + "".join(
        '{"id": "c%d", "body": "b \\u00e9", "children": [' % i for i in range(depth)) + "]}" * depth + "]}"
    d = tempfile.mkdtemp(prefix="tm-json-")
    with open(os.path.join(d, "posts.jsonl"), "w") as f:
        f.write(line + "\n" + '{"id": "broken", "children": [' + "\n\n" + "[1, 2]\n" + '{"id": "ok", "children": [7]}\n')
    posts, comments, rejects = jsonl.read_threads_and_rejects(spark, d)
    assert sorted(r["post_id"] for r in posts.collect()) == ["deep", "ok"]
    assert comments.count() == depth
    last = comments.filter(F.col("comment_id") == f"c{depth - 1}").first()
    assert last["parent_id"] == f"c{depth - 2}" and last["body"] == "b \u00e9"
    assert rejects.count() == 3


def test_iterative_decoder_matches_standard():
    texts = ['{"a": [1, -2.5e3, {"b": null, "c": [true, false, ""]}], "d": {}, "e": [], "f": "\\ud83d\\ude00 \\"x\\""}',
             " [ ] ", "7", '"s"', '{"a": 1, "a": 2}', "[[[[]]], {}]"]
    for x in texts:
        assert jsonl.decode_iteratively(x) == json.loads(x)
    for x in ["", "{", "[1,]", '{"a" 1}', "[1 2]", "nul", '{"a": 1} x', "{1: 2}", "[1}"]:
        try:
            jsonl.decode_iteratively(x)
        except ValueError:
            continue
        raise AssertionError(x)


def test_gbt_beats_mean(spark):
    rows = [(i, float(i % 13), float((i * 7) % 5), (i % 13) * 2.0 + ((i * 7) % 5) + (i % 3) * 0.1, i % 5 == 0)
            for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, v boolean")
    model = ml.fit_gbt(df, ["a", "b"], "y", "v", max_iter=20)
    r2 = sc.regression_scores(model.transform(df), "y", "prediction").first()["r2"]
    base = sc.mean_baseline(df, "y").first()["r2"]
    assert r2 > base + 0.5


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "Top_comment_id" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_streaming_matches_batch(spark):
    from conftest import SF001
    from threadmetrics.sources.threads import thread_table
    from threadmetrics.streaming.features import stream_tlc_features, tlc_row_features

    c = thread_table(spark, SF001, "conv_comments")
    d = tempfile.mkdtemp(prefix="tm-stream-")
    c.write.parquet(os.path.join(d, "in"))
    q = stream_tlc_features(spark, os.path.join(d, "in"), os.path.join(d, "out"), os.path.join(d, "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(d, "out"))
    want = tlc_row_features(c)
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())


@pytest.fixture
def no_broadcast(spark):
    """The salted path also for small right sides."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_join_hot_keys(spark, no_broadcast):
    from threadmetrics.operators.skew import lookup_join
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(90)] + [(None, 99)], "k string, v int")
    right = spark.createDataFrame([("hot", "H"), ("k0", "Z"), ("k3", "T")], "k string, r string")
    for how in ("left", "inner", "left_semi"):
        want = sorted(left.join(right, ["k"], how).collect(), key=repr)
        assert sorted(lookup_join(left, right, ["k"], how, hot_rows=5).collect(), key=repr) == want


def test_lookup_join_null_and_many_hot_keys(spark, no_broadcast):
    """NULL keys set aside; every key hot; one key with half of the rows."""
    from threadmetrics.operators import skew
    n = 3000
    left = (spark.range(n * 4).select((F.col("id") % n).alias("k"), F.col("id").alias("v"))
            .unionByName(spark.range(n).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("v")))
            .unionByName(spark.range(n * 2).select(F.lit(7).cast("long").alias("k"), F.col("id").alias("v"))))
    right = spark.range(0, n, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("r"))
    for how in ("left", "inner", "left_semi"):
        want = sorted(left.join(right, ["k"], how).collect(), key=repr)
        assert sorted(skew.lookup_join(left, right, ["k"], how, hot_rows=3).collect(), key=repr) == want


def test_lookup_join_bounds_its_hot_table(spark, monkeypatch, no_broadcast):
    from threadmetrics.operators import skew
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 10)
    left = spark.range(5000).select((F.col("id") % 500).alias("k"), "id")
    right = spark.range(500).select(F.col("id").alias("k"), F.col("id").alias("r"))
    got = skew.lookup_join(left, right, ["k"], "inner", hot_rows=2)
    assert got.count() == 5000 and got.filter("k <> r").count() == 0


def test_group_rank_one_timestamp(spark):
    from threadmetrics.operators.grouprank import group_rank
    df = spark.createDataFrame([("hot", 5, f"c{i:04d}") for i in range(700)] + [(None, 5, f"n{i}") for i in range(90)]
                               + [("cold", i, "d") for i in range(9)], "g string, t long, c string")
    got = group_rank(df, ["g"], ["t", "c"], hot_rows=50).collect()
    assert len(got) == 799
    for g, size in (("hot", 700), (None, 90), ("cold", 9)):
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: (r["t"], r["c"]))
        assert [r["rank"] for r in mine] == list(range(1, size + 1)) and {r["n"] for r in mine} == {size}


def test_orphans_are_counted_and_left_out(spark):
    from threadmetrics.operators import halves as hv
    from threadmetrics.operators import tree
    ddl = ("post_id string, comment_id string, parent_id string, sibling_ord int, subreddit string, "
           "subreddit_id string, author string, score int, created_utc bigint, body string")
    rows = [("p", "t", None), ("p", "a", "t"), ("p", "b", "a"), ("p", "x", "gone"), ("p", "y", "x")]
    c = spark.createDataFrame([(p, i, q, 0, "s", "t5", "u", 1, 5, "b") for p, i, q in rows], ddl)
    assert {r["comment_id"] for r in tree.orphans(c).collect()} == {"x", "y"}
    assert {r["comment_id"] for r in hv.replies_with_heights(c).collect()} == {"a", "b"}
    assert tree.reply_rollup(c).first()["Replies_total_number"] == 2


@pytest.mark.parametrize("near", [0, 100_000])
def test_outcomes_leave_no_table_or_shuffle_behind(spark, monkeypatch, near):
    """Tables on the way are deleted, texts are stored as numbers, and the rows stay."""
    import os

    from threadmetrics.operators import lineage
    from threadmetrics.operators import outcomes as oc
    from threadmetrics.plans import dynamic as dyn
    monkeypatch.setattr(oc, "NEAR_ROWS", near)
    bodies = [None, "", "thanks, that is great http://a.example.com/x", "maybe you should not", "lol https://www.gofundme.com/f/x"]
    rows = [(f"p{t}", f"p{t}_{i}", None if i == 0 else f"p{t}_{(i - 1) // 2}", i, "s", "t5", f"u{i % 3}",
             None if i % 5 == 0 else i, 100 - i, bodies[(i + t) % 5]) for t in range(6) for i in range(9)]
    c = spark.createDataFrame(rows, "post_id string, comment_id string, parent_id string, sibling_ord int, subreddit string, "
                              "subreddit_id string, author string, score int, created_utc long, body string")
    s = spark.createDataFrame([(r[0], r[1], 1.0 + r[3] % 5, 2.0, r[3] / 9, 0.5) for r in rows if r[3] % 4],
                              "post_id string, comment_id string, politeness double, support double, toxicity double, attack double")
    root = lineage.ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    one = dyn.half_outcomes(c, s)
    left = set(os.listdir(root)) - before
    assert [n.rsplit("-", 1)[0] for n in left] == ["tm-outcome-rows"]
    assert "body" not in spark.read.parquet(os.path.join(root, *left)).columns

    def got(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert got(one) == got(dyn.merged_outcomes(c, s).select(*one.columns)) and len(got(one)) == 12
    lineage.release(one)
    assert not any(n.startswith("tm-outcome-rows") for n in set(os.listdir(root)) - before)


def test_merge_of_seven_tables_equals_one_aggregation(spark):
    from conftest import SF001
    from threadmetrics.plans import dynamic as dyn
    from threadmetrics.sources.threads import thread_table
    c, s = (thread_table(spark, SF001, n) for n in ("conv_comments", "conv_scores"))
    one = dyn.half_outcomes(c, s)
    merged = dyn.merged_outcomes(c, s).select(*one.columns)

    def rows(df):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert rows(one) == rows(merged) and len(rows(one)) > 0


def test_english_by_largest_share(spark):
    from threadmetrics.operators import language as lg
    spans = [(1, 0, "un", 10), (1, 1, "en", 190), (2, 0, "en", 10), (2, 1, "un", 90), (3, 0, "en", 50),
             (4, 0, "en", 95), (4, 1, "de", 5), (5, 0, "en", 80), (5, 1, "un", 20)]
    sl = spark.createDataFrame(spans, "doc_id long, span_no long, lang string, span_len long")
    docs = spark.createDataFrame([(i,) for i in range(1, 7)], "doc_id long")
    got = {r["doc_id"]: r["is_english"] for r in lg.english_flags(docs, "doc_id", sl).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}


def test_reuse_never_overwrites(spark):
    from threadmetrics.sources import files as fs
    d = tempfile.mkdtemp(prefix="tm-reuse-")
    a = spark.range(3).select("id")
    assert fs.load_or_build(spark, d, "x", "1", lambda: a).count() == 3
    assert fs.load_or_build(spark, d, "x", "1", lambda: spark.range(9)).count() == 3
    with pytest.raises(Exception):
        fs.union_all([a, spark.range(2).select(F.col("id").alias("other"))]).count()


def test_subset_by_hash_threshold(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    order = sorted(range(5000), key=lambda i: (__import__("hashlib").md5(f"42:{i}".encode()).hexdigest(), i))
    for k in (0, 1, 777, 5000, 9000):
        got = sc.random_subset(df, "k", k)
        assert sorted(r["k"] for r in got.collect()) == sorted(order[:k])


def test_topics_learn_from_every_document(spark):
    from threadmetrics.operators import ml
    docs = spark.createDataFrame([(i, ["common", "words"] + [f"only{i}"] * 5) for i in range(300)],
                                 "doc_id int, words array<string>")
    model = ml.fit_topics(docs, "words", k=2)
    weight = dict(zip(model.stages[0].vocabulary, model.stages[1].topicsMatrix().toArray().sum(axis=1), strict=True))
    # a word of no drawn document only falls from its start, about 1 in each of the two topics
    assert min(weight[f"only{i}"] for i in range(300)) > 2.2


def test_every_row_is_scored(spark):
    from threadmetrics.plans.catalog import QUERIES
    pairs, orders = QUERIES["j7_pairs"](spark, "/root/testdata/sf0.001").count(), QUERIES["m12_batch_inference"](spark, "/root/testdata/sf0.001").count()
    for name, n in (("m10_pair_classifier", pairs), ("m7_gbt", orders)):
        held = [r.held_out for r in QUERIES[name](spark, "/root/testdata/sf0.001").collect()]
        assert len(held) == n and 0 < sum(held) < n


def test_category_dict_layouts(spark, tmp_path):
    import json

    from threadmetrics.sources import files as fs
    want = {"a b": 1, 'quo"te {': 2, "c": 3}
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "one.json").write_text(json.dumps(want, indent=2))
    (tmp_path / "good" / "two.json").write_text('{"d": 4}\n\n{"e": 5, "f": 6}\n')
    got = {r.name: r.category_id for r in fs.read_category_dict(spark, str(tmp_path / "good")).collect()}
    assert got == {**want, "d": 4, "e": 5, "f": 6}
    for i, text in enumerate(['{"a": 1}\nrubbish\n', json.dumps(want, indent=2) * 2]):
        (tmp_path / f"bad{i}.json").write_text(text)
        with pytest.raises(Exception, match="not a category dictionary"):
            fs.read_category_dict(spark, str(tmp_path / f"bad{i}.json")).collect()


def test_metric_components_are_returned(spark):
    from threadmetrics.plans.catalog import QUERIES
    sf = "/root/testdata/sf0.001"
    ratios = [r.explained_variance_ratio for r in QUERIES["m3_metric_ratio_rows"](spark, sf).collect()]
    assert len(ratios) == 26 and abs(sum(ratios) - 1) < 1e-4
    assert QUERIES["m4_metric_loading_rows"](spark, sf).count() == 26 * 26
    scores = QUERIES["m5_metric_score_rows"](spark, sf)
    assert {f"PC{j}" for j in range(26)} < set(scores.columns)
    assert scores.count() == QUERIES["m5_metric_scores"](spark, sf).first().n_rows


def test_topic_terms_are_returned(spark):
    from threadmetrics.plans.catalog import QUERIES
    rows = QUERIES["m1_topic_terms"](spark, "/root/testdata/sf0.001").collect()
    assert len({r.topic for r in rows}) == 20 and max(r.place for r in rows) == 19

