"""Operators on pages and conversations, mixing, the pipeline and the oracle SQL."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadmetrics.llm import chat, mixing, packing, warc
from threadmetrics.llm.queries import ORACLE, QUERIES
from threadmetrics.session import apply_engine_conf

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def conf(spark):
    apply_engine_conf(spark)


# ------------------------------------------------------------ WARC
def page_rows():
    big, long = "<p>" + "x" * 1500 + "é</p>", "<html>" + "lorem ipsum " * 40_000
    return [(1, "http://a.example/ü?q=1&r=%20", big), (2, None, big), (9, "http://b.example/", big), (3, "u", "short"),
            (4, "u", "short"), (5, "line\r\nbreak: x", None), (6, "", ""), (7, "u", long), (8, "v", long + "!"),
            (None, "n", big), (9, "again", big), (10, "WARC/1.1", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 60)]


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 4096)
    pages = spark.createDataFrame([(*r, 1) for r in page_rows()], "page_id long, url string, html string, salt int")
    bundles = warc.write_archives(pages.repartition(2))
    tops = {}
    for i, _, h in page_rows():
        tops[h or ""] = max([x for x in (i, tops.get(h or "")) if x is not None], default=None)
    want = Counter()
    for i, _, h in page_rows():
        body = (h or "").encode()
        again = len(body) >= 1000 and i != tops[h]
        want[(i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response",
              tops[h] if again else None)] += 1
    assert Counter(tuple(r) for r in warc.read_archives(bundles).drop("url").collect()) == want
    # random access: one frame by record id, payload intact
    raw = warc.read_records(bundles, F.col("record_id") == "<urn:page:7>").collect()
    assert len(raw) == 1 and warc.parse_record(raw[0].record)["payload"].decode() == page_rows()[7][2]
    # the whole bundle is plain Zstandard to readers that ignore the seek table
    import zstandard
    first = bundles.first()
    whole = zstandard.ZstdDecompressor().stream_reader(first.data, read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1\r\n") and len(whole) == sum(s for _, _, s in warc.seek_table(first.data))
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


# ------------------------------------------------------------ chat
def talk_rows():
    odd = r"back\slash \s ### x </turn> \h"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", odd), (1, 3, "user", "\n</turn>\n### user:\n"), (1, 4, "assistant", ""),
            (2, 0, None, None), (2, 0, "assistant", "tie b"), (2, 0, "assistant", "tie a"), (2, 0, "assistant", "tie a"),
            (None, 0, "user", "no id"), (None, 1, "assistant", "reply\n"), (3, 5, "assi:stant\n", "####</turn></turn>#")]
    return rows + [(4, i, ("user", "assistant")[i % 2], f"turn {i} ###") for i in range(70)]


def test_chat_reads_back(spark):
    talks = spark.createDataFrame([(*r, 0) for r in talk_rows()], "conv_id long, turn long, role string, text string, node int")
    got = {r.conv_id: r for r in chat.contract_table(chat.format_trees(*chat.conversation_nodes(talks.repartition(3)))).collect()}
    by = defaultdict(list)
    for r in talk_rows():
        by[r[0]].append(r)
    assert set(got) == set(by)
    for conv, rows in by.items():
        rows = sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "",
                                           hashlib.sha256((r[3] or "").encode()).digest()))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)
        loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
        g = got[conv]
        assert (g.n_turns, g.loss_chars) == (len(rows), len(loss))
        assert g.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    empty = chat.contract_table(chat.format_trees(*chat.conversation_nodes(talks.limit(0))))
    assert empty.count() == 0


def test_chat_branches_of_a_tree(spark):
    """Every root-to-leaf path once, best score first."""
    rng = np.random.default_rng(8)
    parent = {i: (int(rng.integers(0, i)) if i % 7 else None) for i in range(60)}
    tree = {}
    for i in range(60):
        tree[i] = i if parent[i] is None else tree[parent[i]]
    rows = [(tree[i], i, parent[i], "user", f"t{i}", float(i % 5)) for i in range(60)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    got = chat.format_trees(nodes).withColumn("turns", chat.read_turns(chat.formatted(F.col("segments")))).collect()
    leaves = set(range(60)) - {p for p in parent.values() if p is not None}
    assert {r.leaf for r in got} == leaves and len(got) == len(leaves)
    scores = defaultdict(list)
    for r in got:
        way, at = [], r.leaf
        while at is not None:
            way.append(at)
            at = parent[at]
        assert [t.text for t in r.turns] == [f"t{i}" for i in reversed(way)]
        assert r.score == pytest.approx(np.mean([i % 5 for i in way]))
        scores[r.tree].append((-r.score, r.leaf, r.branch_rank))
    for s in scores.values():
        assert [x[2] for x in sorted(s)] == list(range(1, len(s) + 1))
    assert {r.leaf for r in chat.format_trees(nodes, branches=1).collect()} == {min(s)[1] for s in scores.values()}


def test_packing_refuses_bad_lengths(spark):
    for bad in (None, 0, 4000):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, 5), (2, bad)], "doc_id long, length long"))


# ------------------------------------------------------------ mixing
def bounded_least_squares(a, target, low):
    """Independent solver: accelerated projected gradient on the rates themselves, run long."""
    q = y = np.full(a.shape[1], max(1.0, low))
    step, t = 1 / np.linalg.eigvalsh(a @ a.T).max(), 1.0
    for _ in range(5_000):
        new = np.maximum(low, y - step * (a.T @ (a @ y - target)))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, q = new + (old - 1) / t * (new - q), new
    return q


def squared_gap(a, r, target):
    return float(((a @ r - target) ** 2).sum() / target.sum() ** 2)


def in_memory(p, t, low):
    """``evaluate`` of the descent over arrays, with the metric of ``fit_rates``."""
    t = t / t.sum()
    s = p @ np.maximum((p * t[:, None]).sum(axis=0), 1e-9)

    def evaluate(moves, v):
        a = np.full(len(t), max(1.0, low))
        for m in moves:
            a = np.maximum(low, a - p @ np.array(m) / s)
        x = a - p @ np.array(v) / s
        r, free = np.maximum(low, x), x > low
        gram = (p[free] * (t / s)[free][:, None]).T @ p[free]
        return list((r * t) @ p), gram.tolist(), float((t * s * np.where(free, r * r / 2, low * x - low * low / 2)).sum())
    return evaluate


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(7)
    for i in range(50):
        k, n, low = int(rng.integers(1, 6)), int(rng.integers(5, 300)), float(rng.choice([0.0, 0.5, 1.0]))
        p, t = rng.dirichlet(np.full(k, rng.choice([0.05, 0.4, 2.0])), n), rng.integers(1, 500, n).astype(float)
        target = rng.dirichlet(np.full(k, 0.7)) * t.sum() * rng.choice([0.5, 1.0, 3.0])
        _, totals = mixing.descend(in_memory(p, t, low), list(target / t.sum()))
        best = squared_gap((p * t[:, None]).T, bounded_least_squares((p * t[:, None]).T, target, low), target)
        got = float(((np.array(totals) * t.sum() - target) ** 2).sum() / target.sum() ** 2)
        assert got <= best + 1e-4, (i, k, n, low, got, best)


def test_rates_match_independent_solver(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.4, 0.4, 0.4], 300)
    t = rng.integers(1, 500, 300).astype(float)
    rows = [(i, float(a), *map(float, b)) for i, (a, b) in enumerate(zip(t, p, strict=True))]
    soft = spark.createDataFrame(rows, "id int, tokens double, p0 double, p1 double, p2 double")
    a = (p * t[:, None]).T
    for want, low in (([0.0, 0.0, 1.0], 0.0), ([0.6, 0.3, 0.1], 1.0)):
        target = t.sum() * np.array(want)
        rate, totals = mixing.fit_rates(soft, list(target), min_rate=low)
        r = np.array([x[0] for x in soft.select("id", rate.alias("r")).orderBy("id").select("r").collect()])
        assert (r >= low).all() and np.allclose(a @ r, totals, rtol=1e-3, atol=1e-2)
        assert squared_gap(a, r, target) <= squared_gap(a, bounded_least_squares(a, target, low), target) + 1e-4
    again, _ = mixing.fit_rates(soft.repartition(7), list(target), min_rate=low)
    assert str(again._jc) == str(rate._jc)       # the same moves, whatever the partitioning


def test_copies_follow_the_fit_and_not_the_partitioning(spark):
    rng = np.random.default_rng(9)
    words = {"en": ["the", "cat", "and", "dog"], "de": ["der", "hund", "und", "katze"], "fr": ["le", "chien", "et", "chat"]}
    rows = []
    for i in range(1500):
        lang = ("en", "en", "en", "de", "fr")[i % 5]
        rows.append((i % 1400, " ".join(rng.choice(words[lang], int(rng.integers(1, 200)))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.col("lang").alias("domain")).filter("doc_id < 600")
    weights = {"en": 0.3, "de": 0.45, "fr": 0.25}

    def run(frame):
        return [tuple(r) for r in mixing.mix(frame, labels, weights=weights).select(
            "_row.doc_id", "_row.text", "domain", "tokens", "rate", "copies").collect()]
    got = run(docs)
    assert Counter(got) == Counter(run(docs.repartition(7))) == Counter(run(docs.orderBy(F.desc("text")).coalesce(1)))
    total = sum(r[3] for r in got)
    for lang, share in weights.items():
        fitted, real = (sum(r[3] * r[k] for r in got if r[2] == lang) for k in (4, 5))
        assert abs(fitted - share * total) < 0.001 * total and abs(real - fitted) < 0.01 * fitted


def test_mixing_bound_keeps_every_domain(spark):
    docs = spark.createDataFrame([(i, f"alpha beta {i % 7}") for i in range(400)] + [(1000, "gamma delta")] * 50
                                 + [(1001, "gamma epsilon")], "doc_id long, text string")
    rows = [(i, "many") for i in range(400)] + [(5, "many")] * 3000 + [(1000, "few"), (1001, "few")]
    model = mixing.fit(docs, spark.createDataFrame(rows, "doc_id long, domain string"), max_labelled=40)
    assert model.domains == ["few", "many"] and "gamma" in model.lists[0] and "alpha" in model.lists[1]
    assert np.allclose(np.exp(model.prior), [2 / 402, 400 / 402])      # copies of a label or a document do not count
    assert mixing.shares({"a": 2, "b": 100, "c": 900}, 40) == {"a": 2, "b": 19, "c": 19}
    assert mixing.shares({"a": 2, "b": 10}, 40) == {"a": 2, "b": 10}


def test_mixing_tables(spark):
    rows = [(i, "the cat and the dog" if i % 4 else "der hund und die katze", "x") for i in range(200)]
    rows += [(None, None, None), (500, "", "y"), (500, "", "y"), (501, "the " * 5000, "z")]
    docs = spark.createDataFrame([(*r, 1, 2.0, "w") for r in rows],
                                 "doc_id long, text string, extra string, tokens int, p0 double, domain string")
    labels = spark.createDataFrame([(i, "en" if i % 4 else "de") for i in range(80)] + [(None, "en"), (3, None)],
                                   "doc_id long, domain string")
    got = mixing.mix(docs, labels, weights={"en": 0.5, "de": 0.5}).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    assert all(r.domain == ("en" if r._row.doc_id % 4 else "de") for r in got if r._row.doc_id is not None and r._row.doc_id < 200)
    mass = Counter()
    for r in got:
        mass[r.domain] += r.rate * r.tokens
    assert abs(mass["en"] - mass["de"]) < 0.05 * sum(mass.values())
    kept = mixing.mixed(docs, labels, temperature=0.7, min_rate=1.0, keep_all=True)
    assert kept.columns == docs.columns
    assert set(Counter(r.doc_id for r in kept.collect())) == {r[0] for r in rows}
    assert mixing.mixed(docs.limit(0), labels).count() == 0
    alone = mixing.mix(docs, labels.limit(0)).collect()
    assert {r.domain for r in alone} == {"all"} and all(abs(r.rate - 1) < 1e-6 for r in alone)


# ------------------------------------------------------------ queries
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(ORACLE[name])
    cols = [d[0] for d in rel.description]
    want = Counter(map(tuple, rel.fetchall()))
    assert Counter(tuple(r) for r in QUERIES[name](spark, SF).select(*cols).collect()) == want


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        if name == "packing":
            break
        assert docs.columns == columns
        rows = docs.collect()
        ids = Counter(r.doc_id for r in rows)
        assert all(before[r.doc_id] == r.text for r in rows)
        if name == "exact_dedup":
            assert len({r.text.lower() for r in rows}) == len(rows)
        assert name == "mixing" or max(ids.values()) == 1
        after = {r.doc_id: r.text for r in rows}
        assert name != "mixing" or set(after) == set(before)
        before = after
    last = docs.collect()
    assert {r.doc_id for r in last} == set(before)
    for doc_id in list(before)[:50]:
        mine = [r for r in last if r.doc_id == doc_id]
        copies = len([r for r in mine if r.start == 0])
        assert sum(r.length for r in mine) == copies * mine[0].doc_tokens


def test_pipeline_leaves_other_results_alone(spark, tmp_path):
    """Unread results of other operators survive a run; interleaved runs do not disturb each other."""
    lazy = {name: QUERIES[name](spark, SF) for name in ("op3_exact_dedup", "op10_simhash")}
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60")
    names = [n for n, _ in corpus_pipeline.STAGES]
    outs = {"a": docs, "b": docs}
    pending = {}
    for name, function in corpus_pipeline.STAGES[:3]:
        for run in outs:
            pending[run] = function(spark, outs[run], SF)       # both are made before either is written
        for run, made in pending.items():
            made.write.parquet(str(tmp_path / f"{run}-{name}"))
            outs[run] = spark.read.parquet(str(tmp_path / f"{run}-{name}"))
    assert outs["a"].columns == docs.columns and names[0] == "quality"
    assert sorted(outs["a"].collect(), key=str) == sorted(outs["b"].collect(), key=str)
    for df in lazy.values():
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline_odd_rows(spark, tmp_path):
    text = "plain words that a quality model may keep or not, " * 30
    rows = [(1, text, "en", "s", len(text)), (1, text, "en", "s", len(text)), (2, text.upper(), "en", "s", 1), (None, None, None, None, None),
            (3, "", "en", None, 0), (4, "x " * 50_000, None, "s", 100_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row int, digest string"
    table = spark.createDataFrame([(*r, 7, "d") for r in rows], schema)
    for at, docs in enumerate((table, table.limit(0))):
        for name, function in corpus_pipeline.STAGES:
            out = function(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns, name
            path = str(tmp_path / f"{at}-{name}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert at == 0 or docs.count() == 0
