"""The JSON reader's defined values and the threads data source."""

import io
import json
import random
from collections import Counter

import pytest

from threadmetrics.sources import datasource
from threadmetrics.sources import files as fs
from threadmetrics.sources.jsonl import read_threads_and_rejects, whole_number


def odd_lines():
    lines = [
        '{"id": "p1", "title": "a\\ud800b \\ud83d\\ude00", "score": 3000000000, "created_utc": 1e30, "children": '
        '[{"id": "c1", "score": "7.0", "created_utc": "1500000000.0", "body": "\\udfff"}, '
        '{"id": "c2", "score": 7e0, "created_utc": 9223372036854775807, "body": "x", "children": [{"id": "c3", '
        '"score": true, "created_utc": NaN}]}, 5]}',
        '{"id": "p2", "score": "many", "created_utc": 9223372036854775808}',
        '{"id": "p3", "score": -2147483648, "created_utc": null, "children": {"not": "a list"}}',
        "[1, 2]", "{broken", '{"id": "p4", "score": ' + "9" * 5000 + "}", "   ", ""]
    lines += [json.dumps({"id": f"q{i}", "score": i, "title": "é" * (i % 50),
                          "children": [{"id": f"q{i}-{j}", "score": j} for j in range(i % 4)]}) for i in range(200)]
    return lines


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    path = tmp_path_factory.mktemp("threads") / "dump.jsonl"
    path.write_bytes("\n".join(odd_lines()).encode() + b'\n{"id": "p5", "title": "not \xff utf-8"}')
    return str(path)


def test_odd_values_never_end_the_job(spark, dump):
    posts, comments, rejects = read_threads_and_rejects(spark, dump)
    p = {r.post_id: r for r in posts.collect()}
    assert p["p1"].title == "a\ufffdb \U0001f600" and (p["p1"].score, p["p1"].created_utc) == (None, None)
    assert (p["p2"].score, p["p3"].score) == (None, -2147483648) and p["p5"].title == "not \ufffd utf-8"
    c = {r.comment_id: r for r in comments.filter("post_id = 'p1'").collect()}
    assert (c["c1"].score, c["c1"].created_utc, c["c1"].body) == (7, 1_500_000_000, "\ufffd")
    assert (c["c2"].score, c["c2"].created_utc) == (7, 9223372036854775807)
    assert (c["c3"].score, c["c3"].created_utc) == (None, None)
    why = Counter(r.reason.split(":")[0] for r in rejects.collect())
    assert sum(why.values()) == 10 and why["score of post p1"] == why["created_utc of comment c3 of p1"] == 1
    assert len(p) == 204


@pytest.mark.parametrize("value,want", [(7, 7), ("7", 7), ("+7", 7), (" -7.0 ", -7), (7.0, 7), ("1e3", 1000), (None, None),
                                        (2**31 - 1, 2**31 - 1)])
def test_whole_numbers(value, want):
    assert whole_number(value, 32) == want


@pytest.mark.parametrize("value", [7.5, "7.5", "x", "", True, [], float("inf"), 2**31, -2**31 - 1, "1e400", "9" * 60])
def test_no_whole_numbers(value):
    with pytest.raises(ValueError):
        whole_number(value, 32)


def test_byte_ranges_give_each_line_once(monkeypatch):
    rng = random.Random(4)
    for _ in range(300):
        data = bytes(
            rng.choices(b"ab\n", k=rng.randrange(0, 40)))
        monkeypatch.setattr(datasource, "PIECE", rng.randrange(1, 9))
        step = rng.randrange(1, 12)
        got = [x for at in range(0, len(data), step)
               for x in datasource.lines_of(io.BytesIO(data), at, min(at + step, len(data)))]
        want = data.split(b"\n")
        assert got == (want if want[-1] else want[:-1]), (data, step)


def test_source_reads_the_same_rows(spark, dump):
    datasource.register(spark)
    tables = dict(zip(("posts", "comments", "rejects"), read_threads_and_rejects(spark, dump), strict=True))
    for kind, want in tables.items():
        got = spark.read.format("threads").option("kind", kind).option("splitBytes", 700).load(dump)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())), kind
    assert spark.read.format("threads").load(dump).rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="kind is one of"):
        spark.read.format("threads").option("kind", "x").load(dump)


def test_source_writes_whole_files_only(spark, tmp_path):
    datasource.register(spark)
    path = str(tmp_path / "out")
    first = spark.createDataFrame([(f'{{"id": "a{i}"}}',) for i in range(50)], "value string").repartition(4)
    first.write.format("threads").mode("append").save(path)
    assert spark.read.format("threads").option("kind", "posts").load(path).count() == 50
    bad = first.union(spark.createDataFrame([("two\nlines",)], "value string"))
    with pytest.raises(Exception, match="one line"):
        bad.write.format("threads").mode("append").save(path)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]
    first.limit(7).write.format("threads").mode("append").save(path)
    assert spark.read.format("threads").option("kind", "posts").load(path).count() == 57
    first.limit(3).write.format("threads").mode("overwrite").save(path)
    assert spark.read.format("threads").option("kind", "posts").load(path).count() == 3


def test_label_overlay_keeps_every_row(spark):
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, "c", 1), (None, "d", 1), (3, "e", None)],
                                 "id int, text string, label int")
    new = spark.createDataFrame([(1, 5), (3, 7), (2, None), (9, 9), (None, 4), (None, 4)], "id int, label int")
    got = {r["text"]: r["label"] for r in fs.replace_labels(rows, new, "id", "label").collect()}
    assert got == {"a": 5, "b": 5, "c": None, "d": 1, "e": 7}
    bare = fs.replace_labels(rows.drop("label"), new, "id", "label")
    assert bare.columns == ["id", "text", "label"] and bare.count() == 5
    twice = new.unionByName(spark.createDataFrame([(1, 6)], "id int, label int"))
    with pytest.raises(Exception, match="more than one label for key 1"):
        fs.replace_labels(rows, twice, "id", "label").collect()
