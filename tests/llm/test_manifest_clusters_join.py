"""The Merkle manifest, centroid clustering and the n-gram Jaccard join against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from threadmetrics.llm import clusters, merkle, ngram_jaccard
from threadmetrics.session import apply_engine_conf


@pytest.fixture(scope="module", autouse=True)
def conf(spark):
    apply_engine_conf(spark)


# ------------------------------------------------------------ Merkle manifest
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def path(levels, at, fanout):
    steps = []
    for nodes in levels[:-1]:
        run = at // fanout * fanout
        steps.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + fanout])))
        at //= fanout
    return steps


def brute_manifest(rows, fanout):
    """(doc_id, leaf, subroot, root, steps) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels_of([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in langs}
    over = levels_of([trees[g][-1][0] for g in langs], fanout)
    out = []
    for k, g in enumerate(langs):
        for at, x in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = path(trees[g], at, fanout) + path(over, k, fanout)
            out.append((x[3], x[2], trees[g][-1][0], over[-1][0], steps))
    return out


def manifest_rows():
    rows = [(i, f"s{i % 3}", "en", 10 * i, f"text {i} é") for i in range(37)]
    rows += [(i, None, "de", None, None) for i in range(100, 105)] + [(7, "x", "zz", 1, "")]
    rows += [(5, "s", None, 3, "no language"), (None, "s", None, 3, "no id"), (None, "s", None, 3, "no id")]
    return rows + [(3, "s0", "en", 30, "text 3 é"), (3, "s0", "en", 31, "same id, other row"), (200, "", "", 0, "y" * 300_000)]


@pytest.mark.parametrize("fanout,levels", [(2, 2), (3, 1), (2, 10)])
def test_manifest_equals_brute_force(spark, fanout, levels):
    docs = spark.createDataFrame([(*r, 0, "x") for r in manifest_rows()],
                                 "doc_id long, source string, lang string, n_chars long, text string, _g int, node string")
    got = Counter((r.doc_id, r.lang, r.leaf, r.subroot, r.root, tuple((s.before, s.after) for s in r.steps))
                  for r in merkle.manifest(docs.repartition(5), fanout=fanout, levels=levels).collect())
    want = Counter((r[0], r[2], lf, sub, root, tuple(steps))
                   for r, lf, sub, root, steps in brute_manifest(manifest_rows(), fanout))
    assert got == want


def test_audit_finds_every_change(spark):
    docs = spark.createDataFrame(manifest_rows(), "doc_id long, source string, lang string, n_chars long, text string")
    got = Counter(tuple(r) for r in merkle.audit(docs).collect())
    want, seen = Counter(), 0
    for row, lf, sub, root, steps in brute_manifest(manifest_rows(), 2):
        now = list(row)
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
            now[3] += 1
            seen += 1
        acc = leaf(now)
        for before, after in steps:
            acc = sha(before, acc, after)
        want[(row[0], lf, sub, root, sha(*(b + a for b, a in steps)), acc, acc == root)] += 1
    assert got == want and seen > 3
    assert merkle.audit(docs.limit(0)).count() == 0
    one = merkle.audit(docs.filter("lang = 'zz'")).first()
    assert one.root == one.leaf == one.subroot and one.proof_sha256 == sha("")


# ------------------------------------------------------------ centroid clustering
def brute_clusters(rows, dim, k, rounds):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        got = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            mine = [v for (_, v), g in zip(kept, got, strict=True) if g == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    each = Counter()
    for _, d, j in last:
        each[j] += d
    return Counter((i, j, d, each[j], sum(each.values()),
                    hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in last)


def vector_rows(n, dim):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) + (i % 3) for _ in range(dim)]) for i in range(n)]
    rows += [(900, [0.5] * dim), (900, [0.5] * dim), (None, [0.25] * dim), (901, [-0.0] * dim)]      # repeated, no id
    return rows + [(902, None), (903, []), (904, [1.0] * (dim + 1)), (905, [float("nan")] + [1.0] * (dim - 1)),
                   (906, [float("-inf")] + [1.0] * (dim - 1)), (907, [None] + [1.0] * (dim - 1))]


@pytest.mark.parametrize("n,k", [(60, 4), (1, 8), (40, 1)])
def test_clusters_equal_brute_force(spark, n, k):
    rows = vector_rows(n, 5)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, cluster int, v int")
    got = Counter(tuple(r) for r in clusters.cluster(table.repartition(4), dim=5, k=k).collect())
    assert got == brute_clusters(rows, 5, k, 10)


def test_clusters_edges(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert clusters.cluster(table).collect() == []
    assert [f.dataType.simpleString() for f in clusters.cluster(table).schema] == ["bigint", "int", "bigint", "bigint",
                                                                                  "bigint", "string"]
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "vec_id long, embedding array<double>")
    assert {(r.cluster, r.distance) for r in clusters.cluster(same, dim=2).collect()} == {(0, 0)}     # ties: smallest
    huge = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        clusters.cluster(huge, dim=2).collect()


# ------------------------------------------------------------ n-gram Jaccard join
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                group = [group[b] if g == group[a] else g for g in group]
    low = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            low[g] = min(low.get(g, i), i)
    return Counter((i, len(s), low.get(g)) for (i, _), s, g in zip(rows, sets, group, strict=True))


def joined(spark, rows, parts=4):
    docs = spark.createDataFrame([(*r, 0, "k") for r in rows], "doc_id long, text string, uid int, sig string")
    return Counter(tuple(r) for r in ngram_jaccard.similar_documents(docs.repartition(parts)).collect())


def near_rows(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    passage = rng.choices(vocab, k=80)
    rows, i = [], 0
    for size in (1, 3, 5, 6, 9, 14, 31, 32, 33, 60, 64, 130, 260, 700):
        base = rng.choices(vocab, k=size)
        for change in (0, 0, 1, 1, 2, 3, 5):      # texts around the threshold of every size
            words = list(base)
            for _ in range(max(0, round(change * size / 100))):
                words[rng.randrange(len(words))] = "new" + str(rng.random())
            rows.append((i, (" " if i % 2 else "\n\t").join(words)))
            i += 1
        rows.append((i, " ".join(base + rng.choices(vocab, k=size // 5))))      # a longer partner, the next band
        i += 1
    for _ in range(30):        # documents that share a passage and nothing else
        rows.append((i, " ".join(rng.choices(vocab, k=60) + passage + rng.choices(vocab, k=60))))
        i += 1
    return rows


def test_join_equals_brute_force(spark):
    odd = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One"), (1004, "oNE "), (None, "one"), (None, None), (1005, "a b"),
           (1005, "a b"), (1005, "a b"), (None, "q w e r t y"), (None, "q w e r t y"), (1006, "ÄB ä c d e f"), (1007, "äb ä c d e f"),
           (1008, "  x"), (1009, "z " * 30_000), (1010, "z " * 7), (1011, "v" * 200_000 + " u")]
    rows = near_rows() + odd
    got = joined(spark, rows)
    assert got == brute_classes(rows)
    assert sum(n for (i, _, c), n in got.items() if c is not None and c != i) > 40


def test_join_of_frequent_values_in_blocks(spark, monkeypatch):
    """Frequent cell values dealt over several keys, values compared in pairs of blocks."""
    for name, value in (("COMMON", 0), ("PER_TASK", 3), ("BLOCK", 4), ("PAIRS_PER_TASK", 3)):
        monkeypatch.setattr(ngram_jaccard, name, value)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(40):       # each near the base, most pairs of them below the threshold
        words = list(base)
        for _ in range(rng.randrange(3, 10)):
            words[rng.randrange(300)] = f"x{i}-{rng.random()}"
        rows.append((i, " ".join(words)))
    rows += [(50 + i, " ".join(base)) for i in range(6)] + near_rows(3)[:40]
    rows = [(100 + k, t) for k, (_, t) in enumerate(rows)]
    assert joined(spark, rows, 9) == brute_classes(rows)
    assert joined(spark, [r for r in rows if r[1] != " ".join(base)], 9) == brute_classes(
        [r for r in rows if r[1] != " ".join(base)])


def test_join_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 7, 63, 64, 65, 500, 3000):
        for other in (0, 1, n // 9, n):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            b = np.unique(np.append(a[other // 2:], rng.integers(0, 1 << 62, other // 2 + 1).astype(np.uint64)))
            apart = len(np.setxor1d(a, b))
            x, y = ngram_jaccard.bit_sketch(a), ngram_jaccard.bit_sketch(b)
            size = min(len(x), len(y))
            assert int(np.bitwise_count(ngram_jaccard.folded(x, size) ^ ngram_jaccard.folded(y, size)).sum()) <= apart
            (sa, _, _), (sb, _, _) = (ngram_jaccard.cell_values(h, 5, 80) for h in (a, b))
            assert max(len(np.setdiff1d(sa, sb)), len(np.setdiff1d(sb, sa))) <= apart


def test_join_empty_table_and_percent(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_jaccard.similar_documents(none).collect() == []
    with pytest.raises(ValueError):
        ngram_jaccard.similar(none, percent=40)
