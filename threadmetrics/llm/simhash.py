"""SimHash near-duplicates by the generalised pigeonhole principle.

A document's 64-bit fingerprint is the bitwise majority of the 64-bit hashes
of its word shingles. Two fingerprints link when they differ in at most
``max_bits`` bits. Finding the links:

1. Equal fingerprints collapse first (partial aggregation), so exact copies
   cost one row however many there are.
2. Statistics over all distinct fingerprints: co-occurrence of every two bits,
   and a signed sketch of the second moment of each possible signature, from
   which the number of candidate pairs of a partition at threshold 0 or 1 is
   estimated.
3. Correlated bits are grouped into the same partition (for 2, 3 and 4
   partitions). With m partitions and per-partition thresholds that add up to
   ``max_bits - m + 1`` (-1 skips a partition) some partition of any linked
   pair is within its threshold; dynamic programming picks the thresholds,
   and the number of partitions, with the least estimated work.
4. Each fingerprint is probed under its signatures (its value per partition,
   plus each set bit cleared where the threshold is 1); rows of a signature
   meet, all their pairs are compared on the full 64 bits in array
   operations, and only a spanning forest of the links leaves the task.
   A signature shared by more than ``BLOCK`` fingerprints is dealt out in
   pairs of blocks, so no task holds an unbounded group and no pair is lost.
5. Components of the links give the classes.

Defined results: null text counts as empty; fewer words than a shingle: the
whole word sequence is the one shingle; no words: fingerprint zero, linked
like any other; ``component_id`` is the smallest id in the class (nulls are
ignored); repeated rows are equal fingerprints; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, flagged, materialize, packed, unpack, with_uid
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
TEXT_BLOCK = 4 << 20      # bytes of a text handled at once
BLOCK = 4096              # fingerprints of one signature compared in one task
SKETCH = 1024             # counters of a second-moment sketch
LINK_ROWS = 200_000       # signature rows compared at once
WHITE = b" \t\n\x0b\x0c\r"


# ------------------------------------------------------------ fingerprints
def _word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a bounded number of bytes at a time (cut at white space)."""
    start, n = 0, len(data)
    while start < n:
        end = min(n, start + TEXT_BLOCK)
        while end < n and data[end] not in WHITE:
            end += 1
        yield data[start:end].split()   # bytes.split() cuts at the six ASCII white-space characters
        start = end


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    norm = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(norm[s:e], SEED) for s, e in zip(starts[:len(words) - k + 1].tolist(),
                                                               ends[k - 1:].tolist(), strict=True)),
                       np.uint64, len(words) - k + 1)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65_536):
        part = np.unpackbits(h[i:i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += part.sum(axis=0, dtype=np.int64)
    return total


def fingerprint_of(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint of one text."""
    counts, n, tail = np.zeros(64, dtype=np.int64), 0, []
    for block in _word_blocks((text or "").encode("utf-8", "surrogatepass").lower()):   # bytes.lower(): A-Z only
        words = tail + block
        if len(words) >= k:
            h = _hashes(words, k)
            counts += _bit_counts(h)
            n += len(h)
            words = words[len(words) - k + 1:] if k > 1 else []
        tail = words
    if n == 0 and tail:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], dtype=np.uint64)
        counts, n = _bit_counts(h), 1
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint_udf(k: int = SHINGLE_WORDS):
    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, k) for t in texts], dtype="int64")
    return fingerprints


def fingerprint(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """Fingerprint column of a text column."""
    return fingerprint_udf(k)(text)


# ------------------------------------------------------------ partitions and thresholds
def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _co_occurrence(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, n = np.zeros((64, 64)), 0
    for pdf in frames:
        x = _bits(pdf["fp"].to_numpy()).astype(np.float64)
        total += x.T @ x
        n += len(x)
    if n:
        yield pd.DataFrame({"pos": np.arange(4097, dtype=np.int32),
                            "c": np.append(total.ravel(), n).astype(np.int64)})


def _correlations(fps: DataFrame) -> tuple[np.ndarray, int]:
    """(absolute bit correlations, number of fingerprints) over all rows."""
    rows = (fps.select("fp").mapInPandas(_co_occurrence, "pos int, c long")
            .groupBy("pos").agg(F.sum("c").alias("c")).collect())   # 4,097 rows
    flat = np.zeros(4097)
    for r in rows:
        flat[r["pos"]] = r["c"]
    n = max(1.0, flat[4096])
    both = flat[:4096].reshape(64, 64) / n
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((both - np.outer(p, p)) / np.outer(sd, sd)), int(flat[4096])


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m groups: each starts with the most correlated pair left
    and takes the bit most correlated with it until full."""
    left, groups = list(range(64)), []
    for g in range(m):
        size = 64 // m + (1 if g < 64 % m else 0)
        if size >= len(left):
            groups.append(sorted(left))
            break
        sub = corr[np.ix_(left, left)].copy()
        np.fill_diagonal(sub, -1)
        group = [left[i] for i in np.unravel_index(np.argmax(sub), sub.shape)]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].sum(axis=1)))])
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def _value(fps: np.ndarray, group: list[int]) -> np.ndarray:
    mask = np.uint64(sum(1 << b for b in group))
    return fps.view(np.uint64) & mask


def _signatures(fps: np.ndarray, group: list[int], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its fingerprint) rows of one partition: the value,
    and for threshold 1 the value with each set bit cleared. Values that
    differ in one bit meet where the set one is cleared."""
    base = _value(fps, group)
    sigs, owner = [base], [np.arange(len(fps))]
    if threshold >= 1:
        for b in group:
            bit = np.uint64(1 << b)
            idx = np.flatnonzero(base & bit)
            sigs.append(base[idx] ^ bit)
            owner.append(idx)
    return np.concatenate(sigs), np.concatenate(owner)


def _scramble(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def _sketch(plans: list[tuple[list[int], int]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros((len(plans), SKETCH), dtype=np.int64), np.zeros(len(plans), dtype=np.int64)
        for pdf in frames:
            fps = pdf["fp"].to_numpy()
            for j, (group, t) in enumerate(plans):
                h = _scramble(_signatures(fps, group, t)[0])
                sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64)
                total[j] += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), sign, SKETCH).astype(np.int64)
                rows[j] += len(h)
        j, at = np.nonzero(total)
        yield pd.DataFrame({"j": np.append(j, np.arange(len(plans))).astype(np.int32),
                            "at": np.append(at, np.full(len(plans), -1)).astype(np.int32),
                            "c": np.append(total[j, at], rows)})
    return run


def _estimates(fps: DataFrame, plans: list[tuple[list[int], int]]) -> dict[int, tuple[float, float]]:
    """Per plan: (signature rows, estimated candidate pairs), from all rows."""
    sums = (fps.select("fp").mapInPandas(_sketch(plans), "j int, at int, c long")
            .groupBy("j", "at").agg(F.sum("c").cast("double").alias("c")))
    got = (sums.groupBy("j").agg(F.sum(F.expr("if(at = -1, c, 0)")).alias("rows"),
                                 F.sum(F.expr("if(at = -1, 0, c * c)")).alias("f2")).collect())   # a row per plan
    return {r["j"]: (r["rows"], max(0.0, (r["f2"] - r["rows"]) / 2)) for r in got}


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1, 0 or 1 per partition) that add up to ``total`` with the
    least cost; ``costs[i][t]`` is the cost of threshold t (skipping is free)."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, picks) in best.items():
            for t, more in ((-1, 0.0), (0, cost[0]), (1, cost[1])):
                if s + t not in step or c + more < step[s + t][0]:
                    step[s + t] = (c + more, [*picks, t])
        best = step
    return best[total]


def choose(fps: DataFrame, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """Partitions (bit lists) and thresholds to probe with."""
    corr, n = _correlations(fps)
    if n < 2:
        return []
    sizes = [m for m in range(2, max_bits + 2) if -m <= max_bits - m + 1 <= m] or [max_bits + 1]
    layouts = {m: group_bits(corr, m) for m in sizes}
    plans = [(g, t) for groups in layouts.values() for g in groups for t in (0, 1)]
    seen = _estimates(fps, plans)
    work = iter(range(len(plans)))
    options = []
    for m, groups in layouts.items():
        costs = []
        for _ in groups:
            # a signature row is shuffled and sorted; a candidate is one word operation
            costs.append([seen[j][0] * 10 + seen[j][1] * 0.1 for j in (next(work), next(work))])
        cost, picks = allocate(costs, max_bits - m + 1)
        options.append((cost, [(g, t) for g, t in zip(groups, picks, strict=True) if t >= 0]))
    return min(options, key=lambda o: o[0])[1]


# ------------------------------------------------------------ probing
def _probe(plan: list[tuple[list[int], int]]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fps = pdf["fp"].to_numpy()
            for p, (group, t) in enumerate(plan):
                sig, owner = _signatures(fps, group, t)
                yield pd.DataFrame({"p": np.full(len(sig), p, dtype=np.int32), "sig": sig.view(np.int64),
                                    "fp": fps[owner]})
    return run


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (node, smallest node of its class) of links a-b."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between rows with equal ``key`` (rows in key order)."""
    same = np.zeros(len(key), dtype=bool)
    same[1:] |= key[1:] == key[:-1]
    same[:-1] |= key[1:] == key[:-1]
    key, fp = key[same], fp[same]
    a = b = np.empty(0, dtype=np.int64)
    d, at = 1, np.arange(len(key))
    while len(at):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]     # groups with more than d rows
        near = at[np.bitwise_count(fp[at].view(np.uint64) ^ fp[at + d].view(np.uint64)) <= max_bits]
        a, b = np.append(a, fp[near]), np.append(b, fp[near + d])
        if len(a) > 1_000_000:
            a, b = _forest(a, b)
        d += 1
    keep = a != b
    return _forest(a[keep], b[keep])


def _link_frames(max_bits: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0

        def flush(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal held, rows
            pdf = pd.concat(held) if len(held) > 1 else held[0]
            cols = [pdf[c].to_numpy() for c in ("p", "blk", "sig", "fp")]
            change = np.zeros(len(pdf), dtype=bool)
            for c in cols[:3]:
                change[1:] |= c[1:] != c[:-1]
            key = np.cumsum(change)
            cut = len(pdf) if last else int(np.searchsorted(key, key[-1]))   # the last group may go on
            held, rows = ([pdf.iloc[cut:]], len(pdf) - cut) if cut < len(pdf) else ([], 0)
            u, v = _links(key[:cut], cols[3][:cut], max_bits)
            if len(u):
                yield pd.DataFrame({"u": u, "v": v})

        for pdf in frames:
            if len(pdf):
                held.append(pdf)
                rows += len(pdf)
            if rows >= LINK_ROWS:
                yield from flush(False)
        if held:
            yield from flush(True)
    return run


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``u, v`` between the distinct fingerprints ``fp`` whose
    components are those of all pairs within ``max_bits`` bits."""
    plan = choose(fps, max_bits)
    if not plan:
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).filter(F.lit(False))
    sigs = materialize(fps.select("fp").mapInPandas(_probe(plan), "p int, sig long, fp long"), "signatures")
    hot = materialize(sigs.groupBy("p", "sig").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK), "hot")
    if hot.isEmpty():
        dealt = sigs.withColumn("blk", F.lit(0))
    else:
        # a large group of k blocks: each row goes to the k pairs of blocks that hold its own
        k = F.ceil(F.col("n") / BLOCK).cast("int")
        own = F.pmod(F.hash("fp"), F.col("k")).cast("int")
        dealt = (sigs.join(hot, ["p", "sig"], "left").withColumn("k", F.coalesce(k, F.lit(1)))
                 .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
                 .select("p", "sig", "fp", (F.least("own", "other") * F.col("k") + F.greatest("own", "other"))
                         .cast("int").alias("blk")))
    return (dealt.select("p", "blk", "sig", "fp").repartition("p", "blk", "sig").sortWithinPartitions("p", "blk", "sig")
            .mapInPandas(_link_frames(max_bits), "u long, v long"))


def classes(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp, root`` for every row of the distinct fingerprints ``fp``."""
    comp = components(links(fps, max_bits))
    return (fps.select("fp").join(comp, F.col("fp") == F.col("node"), "left")
            .select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicate_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits),
    ``component_id`` (smallest id of the class)."""
    bound_arrow(docs.sparkSession)
    marked = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle_words)
                                     .alias("fp")), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps")
    cls = materialize(classes(fps, max_bits), "classes")
    low = cls.join(fps, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    of = cls.join(low, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                        "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id
    (of repeated rows, one)."""
    bound_arrow(docs.sparkSession)
    marked = materialize(with_uid(packed(docs)).withColumn("fp", fingerprint(F.col(f"_row.`{text_col}`"),
                                                                            shingle_words)), "marked")
    lite = marked.select("_uid", "fp", F.col(f"_row.`{id_col}`").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "_uid"))
    fps = materialize(lite.groupBy("fp").agg(first.alias("first")), "fps")
    cls = materialize(classes(fps, max_bits), "classes")
    keep = cls.join(fps, "fp").groupBy("root").agg(F.min("first").alias("keep"))
    of = cls.join(keep, "root").select("fp", F.col("keep._uid").alias("kept"))
    dropped = lite.join(of, "fp").filter(F.col("kept") != F.col("_uid")).select("_uid")
    return unpack(flagged(marked, dropped, "_dropped").filter("not _dropped"))
