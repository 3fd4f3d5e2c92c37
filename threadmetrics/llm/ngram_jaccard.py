"""Jaccard join of documents on word shingles by parity sketches.

Two documents link when their sets of distinct ``words``-word shingles have a
Jaccard similarity of ``percent`` in a hundred or more. With sizes a and b that
means that at most ``(a + b) * (100 - percent) / (100 + percent)`` shingles are
in one set only. Finding the links:

1. Sketches. A set's shingles are dealt over ``cells``; a cell holds the XOR of
   its shingles' 64-bit hashes, so it is a parity sketch of very many bits kept
   as one word. A shingle changes one cell: the number of cells that differ is
   at most the number of shingles that are in one set only. A plain bit sketch
   (every shingle flips one bit) obeys the same bound bit by bit.
2. Size bands. Band j holds the sizes from 2**j to 2**(j + 1) - 1 and fixes the
   number of cells. A document is sketched for its own band and, if a smaller
   partner can be in the band below, for that one too.
3. Pigeonhole. Documents that link agree in all but d cells, so of their cells
   in any common order the first d + 1 meet. The order puts cells with few
   owners first (counted over all documents), then those of many shingles: a
   passage that many documents repeat makes no candidates of its own.
4. Candidates. Within a cell value's documents each is compared with the one of
   the smallest row number. After the components of these links, only values
   whose documents lie in several components remain; there all pairs between
   components are compared on the bit sketches, in blocks.
5. Verification. Pairs whose bit sketches differ in no more bits than the bound
   are compared shingle by shingle, streaming a pivot's partners past its set.
   Components of all links give the classes.

No step emits all pairs of a group. A cell value shared by n documents of
different components costs about n * n / 2 bit-sketch comparisons, split over
tasks: that work is inherent in an exact answer.

Shingles are compared by a 64-bit hash; two different shingles of one pair of
documents agree in it with a probability of about a * b / 2**64.

Defined results: letters A-Z count as lower case; fewer than ``words`` words:
the whole sequence is the one shingle; null, empty or wordless texts have an
empty set and link with nothing; repeated rows and repeated ids are documents
of their own; ``component_id`` is the smallest id of the class (null ids are
ignored; null when it has no other); an empty table gives no rows; extra
columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, hot_join, hot_keys, materialize
from .components import components
from .simhash import _word_blocks as word_blocks

WORDS = 5
PERCENT = 80
OWNERS = 1 << 18          # counters of cell owners
COMMON = 64               # owners above the mean and its noise that make a value frequent
PER_TASK = 20_000         # rows of one cell value in one task
BLOCK = 2048              # documents of one cell value compared in one task
KEY_BITS = 1 << 23        # of the bitmap of texts to fetch
PAIRS_PER_TASK = 1_000    # partners of one pivot compared in one task
MARKED = ("uid long, id string, key binary, n long, first long, sketch binary, sigs array<long>, "
          "hot array<struct<sig:long,key:long>>")


# ------------------------------------------------------------ shingles
def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles."""
    parts = [np.fromiter(map(xxhash.xxh64_intdigest, block), np.uint64, len(block))
             for block in word_blocks((text or "").encode("utf-8", "surrogatepass").lower())]   # A-Z only
    h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    k = min(words, len(h))
    if not k:
        return h
    acc = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        acc = (acc ^ h[i:len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(29)
    return np.unique(_mix(acc))


# ------------------------------------------------------------ bands, cells, prefixes
def apart(total: int, percent: int) -> int:
    """Most shingles in one set only, for linked sets of ``total`` shingles together."""
    return total * (100 - percent) // (100 + percent)


def cells_of(band: int, percent: int) -> int:
    """Cells of a band's sketches: one more than can differ, and some to choose from."""
    largest = (2 << band) - 1
    most = apart(largest + largest * 100 // percent, percent)
    return most + 1 + most // 4 + 4


def bands_of(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, cells to probe) of a set of ``n`` shingles."""
    own = n.bit_length() - 1
    out = [(own, apart(n + n * 100 // percent, percent) + 1)]
    below = (1 << own) - 1
    if below * 100 >= percent * n:
        out.append((own - 1, apart(n + below, percent) + 1))
    return out


def _where(cells: np.ndarray, band: int) -> np.ndarray:
    return _mix(cells.astype(np.uint64) * np.uint64(64) + np.uint64(band + 1))


def cell_values(h: np.ndarray, band: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, shingles) of the cells that hold any, and those cells."""
    cells = cells_of(band, percent)
    at = _mix(h + np.uint64(band + 1)) % np.uint64(cells)
    order = np.argsort(at.astype(np.uint16) if cells <= 1 << 16 else at, kind="stable")     # 16 bits: a radix sort
    at = at[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    value = np.bitwise_xor.reduceat(h[order], first)
    return _mix(value ^ _where(at[first], band)), np.diff(np.append(first, len(at))), at[first]


def probes(h: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """Signatures that a set is looked up under, for all its bands. ``common``:
    per counter, is a cell value there had by many documents?"""
    out = []
    for band, need in bands_of(len(h), percent):
        sig, held, at = cell_values(h, band, percent)
        order = np.lexsort((sig, -held, common[_counter(sig)]))
        out.append(sig[order[:need]])
        if len(sig) < need:     # empty cells come last in the order
            none = np.setdiff1d(np.arange(cells_of(band, percent), dtype=np.uint64), at)
            out.append(np.sort(_mix(_where(none, band)))[:need - len(sig)])
    return np.concatenate(out)


def bit_sketch(h: np.ndarray) -> np.ndarray:
    """Parity per bit; two to four bits a shingle, a power of two."""
    bits = max(64, 2 << (len(h) - 1).bit_length())
    at = (_mix(h ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """Sketches (words along the last axis) with fewer bits: the parity of
    bits that fall together."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


# ------------------------------------------------------------ passes over the texts
def _sets(words: int) -> Callable[[list[int], list[str]], Iterator[tuple[int, int, np.ndarray | None]]]:
    """Reader of a task's texts: (size, row number of the first row in the task
    with an equal set, set or None when it is empty or repeated) for each row."""
    seen: dict[tuple[int, int, int], int] = {}

    def read(uids: list[int], texts: list[str]) -> Iterator[tuple[int, int, np.ndarray | None]]:
        for uid, text in zip(uids, texts, strict=True):
            h = shingle_set(text, words)
            mark = (len(h), int(_mix(h).sum()), int(_mix(h ^ np.uint64(0xD6E8FEB86659FD93)).sum()))
            first = seen.setdefault(mark, uid) if len(h) else uid
            yield len(h), first, h if first == uid and len(h) else None
    return read


def _counter(sig: np.ndarray) -> np.ndarray:
    return (sig & np.uint64(OWNERS - 1)).astype(np.int64)


def _count_owners(words: int, percent: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, read = np.zeros(OWNERS, dtype=np.int64), _sets(words)
        for pdf in frames:
            at = [_counter(cell_values(h, band, percent)[0]) for n, _, h in read(pdf["uid"].tolist(), pdf["text"])
                  if h is not None for band, _ in bands_of(n, percent)]
            if at:
                total += np.bincount(np.concatenate(at), minlength=OWNERS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at.astype(np.int32), "c": total[at]})
    return run


def owners(texts: DataFrame, words: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(counters of cell values that many documents have, tasks to spread a
    value of that counter over); two arrays of ``OWNERS``, whatever the data."""
    counts = materialize(texts.mapInPandas(_count_owners(words, percent), "at int, c long")
                         .groupBy("at").agg(F.sum("c").alias("c")), "owners")
    mean = (counts.agg(F.sum("c")).first()[0] or 0) / OWNERS
    common, parts = np.zeros(OWNERS, dtype=np.int8), np.ones(OWNERS, dtype=np.int32)
    for r in counts.filter(F.col("c") > mean + 10 * mean ** 0.5 + COMMON).collect():     # at most OWNERS rows
        common[r["at"]] = 1
        parts[r["at"]] = -(-r["c"] // PER_TASK)
    return common, parts


def _mark(words: int, percent: int, common: np.ndarray, parts: np.ndarray) -> Callable:
    """Rows with sketch and signatures; a frequent value's documents are dealt
    over several keys, listed in ``hot`` with the value."""
    def signatures(uid: int, h: np.ndarray) -> tuple[np.ndarray, list[dict] | None]:
        sig = probes(h, percent, common)
        part = parts[_counter(sig)].astype(np.uint64)
        wide = np.flatnonzero(part > 1)
        if not len(wide):
            return sig.view(np.int64), None
        key = sig.copy()
        key[wide] = _mix(sig[wide] + np.uint64(1) + _mix(np.array([uid], dtype=np.uint64)) % part[wide])
        return key.view(np.int64), [{"sig": a, "key": b} for a, b in zip(sig[wide].view(np.int64).tolist(),
                                                                        key[wide].view(np.int64).tolist(), strict=True)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = _sets(words)
        for pdf in frames:
            rows, at, size = [], 0, 0
            for uid, (n, first, h) in zip(pdf["uid"].tolist(), read(pdf["uid"].tolist(), pdf["text"]), strict=True):
                sigs, hot = signatures(uid, h) if h is not None else (None, None)
                rows.append((n, first, bit_sketch(h).tobytes() if h is not None else None, sigs, hot))
                size += 0 if sigs is None else len(sigs)
                if size >= 400_000 or at + len(rows) == len(pdf):
                    out = pd.DataFrame(rows, columns=["n", "first", "sketch", "sigs", "hot"])
                    yield pd.concat([pdf[["uid", "id", "key"]].iloc[at:at + len(rows)].reset_index(drop=True), out],
                                    axis=1)
                    rows, at, size = [], at + len(rows), 0
    return run


# ------------------------------------------------------------ candidates
def _groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of rows with equal ``keys`` out of sorted frames, several
    groups to a frame."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        last = np.ones(len(pdf), dtype=bool)
        for k in keys:
            last &= pdf[k].to_numpy() == pdf[k].iloc[-1]
        cut = len(pdf) - int(last.sum())      # rows are sorted: the last group is the tail
        if cut:
            held.append(pdf.iloc[:cut])
            yield pd.concat(held) if len(held) > 1 else held[0]
            held = []
        elif held and any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
            yield pd.concat(held)
            held = []
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held)


def _pivots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, uid) in order: those whose key others have too, with the
    first uid of the key."""
    key = pivot = None
    waiting = False       # the first row of the current key is not out yet
    for pdf in frames:
        keys, uids = pdf["key"].to_numpy(), pdf["uid"].to_numpy()
        if not len(keys):
            continue
        starts = np.append(keys[0] != key if key is not None else True, keys[1:] != keys[:-1])
        first = np.maximum.accumulate(np.where(starts, np.arange(len(keys)), -1))
        pivots = np.where(first >= 0, uids[np.maximum(first, 0)], pivot if pivot is not None else 0)
        more = ~starts
        out_k, out_u, out_p = [keys[more]], [uids[more]], [pivots[more]]
        heads = np.flatnonzero(more & np.append(False, starts[:-1]))      # second rows: their first rows go out
        out_k.append(keys[heads])
        out_u.append(pivots[heads])
        out_p.append(pivots[heads])
        if more[0] and waiting:
            out_k.append(keys[:1])
            out_u.append(pivots[:1])
            out_p.append(pivots[:1])
        key, pivot, waiting = keys[-1], pivots[-1], bool(starts[-1])
        yield pd.DataFrame({"key": np.concatenate(out_k), "uid": np.concatenate(out_u), "pivot": np.concatenate(out_p)})


def star_candidates(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): ``sig, uid`` of the cell values that several documents
    have, and the distinct pairs ``x, y`` of a value's first document with another."""
    rows = marked.select(F.explode("sigs").alias("key"), "uid")
    met = materialize(rows.repartition("key").sortWithinPartitions("key", "uid")
                      .mapInPandas(_pivots, "key long, uid long, pivot long"), "met")
    hot = marked.select(F.explode("hot").alias("h"), "uid").select("h.sig", "h.key", "uid")
    local = hot.groupBy("sig", "key").agg(F.min("uid").alias("low"))
    tops = local.groupBy("sig").agg(F.min("low").alias("top"))          # one row per frequent value
    across = local.join(tops, "sig").select(F.col("top").alias("x"), F.col("low").alias("y"))
    pairs = (met.select(F.col("pivot").alias("x"), F.col("uid").alias("y")).union(across)
             .filter("x <> y").distinct())
    members = met.select(F.col("key").alias("sig"), "uid").join(
        hot.select(F.col("key").alias("sig")).distinct(), "sig", "left_anti").union(hot.select("sig", "uid"))
    return members, materialize(pairs, "star-pairs")


def _across(percent: int) -> Callable:
    """Pairs of different roots within (sig, blk) whose bit sketches are near enough."""
    def near(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        sketches = [np.frombuffer(s, np.uint64) for s in g["sketch"]]
        size = min(map(len, sketches))
        x = np.stack([folded(s, size) for s in sketches])
        n, root, uid, own = (g[c].to_numpy() for c in ("n", "root", "uid", "own"))
        apart_only = (own != own[0]).any()      # a pair of blocks: rows of one block meet elsewhere
        a, b = [], []
        for i in range(len(g) - 1):
            j = np.flatnonzero((root[i + 1:] != root[i]) & ((own[i + 1:] != own[i]) | ~apart_only)
                               & (100 * n[i + 1:] >= percent * n[i])
                               & (100 * n[i] >= percent * n[i + 1:])) + i + 1
            if len(j):
                bound = (n[j] + n[i]) * (100 - percent) // (100 + percent)
                j = j[np.bitwise_count(x[j] ^ x[i]).sum(axis=1) <= bound]
                a.append(np.minimum(uid[j], uid[i]))
                b.append(np.maximum(uid[j], uid[i]))
        return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in _groups(frames, ["sig", "blk"]):
            for _, g in whole.groupby(["sig", "blk"], sort=False):
                x, y = near(g)
                if len(x):
                    yield pd.DataFrame({"x": x, "y": y})
    return run


def cross_candidates(members: DataFrame, roots: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of documents that share a cell value, lie in different
    components ``roots`` (uid, root) and whose bit sketches allow a link."""
    rooted = materialize(members.join(roots, "uid", "left").select("sig", "uid", F.coalesce("root", "uid").alias("root")),
                         "rooted")
    # of values with the same documents one will do; two documents have met as first and partner
    same = [F.bit_xor(F.xxhash64("uid")).alias("h1"), F.bit_xor(F.xxhash64("uid", F.lit(1))).alias("h2")]
    several = materialize(rooted.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"),
                                                    F.max("root").alias("hi"), *same)
                          .filter("lo <> hi and c > 2").groupBy("c", "h1", "h2").agg(F.min("sig").alias("sig"))
                          .select("sig", F.ceil(F.col("c") / BLOCK).cast("int").alias("k")), "open")
    # a value of k blocks: each row goes to the k pairs of blocks that hold its own
    own = F.pmod(F.hash("uid"), F.col("k"))
    dealt = (hot_join(rooted, several, "sig").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
             .select("sig", "uid", "root", "own", (F.least("own", "other").cast("long") * F.col("k")
                                            + F.greatest("own", "other")).alias("blk")))
    rows = dealt.join(marked.select("uid", "n", "sketch"), "uid")
    return materialize(rows.repartition("sig", "blk").sortWithinPartitions("sig", "blk")
                       .mapInPandas(_across(percent), "x long, y long").distinct(), "cross-pairs")


# ------------------------------------------------------------ verification
def meetings(pairs: DataFrame) -> DataFrame:
    """``x, part, role, uid``: each pivot x (role 0) and its partners (role 1)
    of the stored pairs ``x, y``; the partners of a pivot with many are dealt
    over several parts, each with the pivot."""
    hot = hot_keys(pairs, "x", PAIRS_PER_TASK)
    spread = pairs.join(F.broadcast(hot), "x", "left").withColumn("parts", F.coalesce("_parts", F.lit(1)))   # few rows
    partners = spread.select("x", F.pmod(F.hash("y"), "parts").cast("int").alias("part"), F.lit(1).alias("role"),
                             F.col("y").alias("uid"))
    return spread.select("x", "parts").distinct().select(
        "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"),
        F.col("x").alias("uid")).union(partners)


def streamed(rows: DataFrame, run: Callable) -> DataFrame:
    """``run`` over rows in the order pivot, its partners, next pivot, ..."""
    return (rows.repartition("x", "part").sortWithinPartitions("x", "part", "role")
            .mapInPandas(run, "x long, y long"))


def _near_sketches(percent: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivot = None          # the last pivot's row
        for pdf in frames:
            if pivot is not None:
                pdf = pd.concat([pivot, pdf])
            role, n, sketch = pdf["role"].to_numpy(), pdf["n"].to_numpy(), pdf["sketch"].to_numpy()
            at = np.maximum.accumulate(np.where(role == 0, np.arange(len(pdf)), 0))
            size = np.fromiter(map(len, sketch), np.int64, len(pdf))
            found = []
            for a, b in set(zip(size[at].tolist(), size.tolist(), strict=True)):
                i = np.flatnonzero((role == 1) & (size[at] == a) & (size == b))
                for j in np.array_split(i, len(i) * (a + b) // (16 << 20) + 1) if len(i) else []:
                    x, y = (np.frombuffer(b"".join(sketch[k]), np.uint64).reshape(len(j), -1) for k in (at[j], j))
                    least = min(x.shape[1], y.shape[1])
                    bits = np.bitwise_count(folded(x, least) ^ folded(y, least)).sum(axis=1, dtype=np.int64)
                    found.append(j[bits <= apart(n[j] + n[at[j]], percent)])
            if found:
                got = np.concatenate(found)
                yield pd.DataFrame({"x": pdf["x"].to_numpy()[got], "y": pdf["uid"].to_numpy()[got]})
            pivot = pdf.iloc[at[-1]:at[-1] + 1]
    return run


def screened(pairs: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bit sketches differ in no more bits than linked sets can."""
    return streamed(meetings(pairs).join(marked.select("uid", "n", "sketch"), "uid"), _near_sketches(percent))


def _linked(words: int, percent: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivot = None
        for pdf in frames:
            x, y = [], []
            for px, role, uid, text in zip(pdf["x"].tolist(), pdf["role"].tolist(), pdf["uid"].tolist(), pdf["text"],
                                           strict=True):
                h = shingle_set(text, words)
                if role == 0:
                    pivot = h
                    continue
                both = len(np.intersect1d(pivot, h, assume_unique=True))
                if 100 * both >= percent * (len(pivot) + len(h) - both):
                    x.append(px)
                    y.append(uid)
            yield pd.DataFrame({"x": np.array(x, dtype=np.int64), "y": np.array(y, dtype=np.int64)})
    return run


def verified(pairs: DataFrame, marked: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs that link, by their shingles. ``texts``: key, text."""
    rows = materialize(meetings(pairs).join(marked.select("uid", "key"), "uid"), "meetings")
    return streamed(hot_join(rows, texts, "key"), _linked(words, percent))


def texts_of(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """``key, text`` once for each of the distinct, stored ``keys``. A bitmap of
    ``KEY_BITS`` bits, whatever the data, first leaves most other texts where
    they are; copies of a text become one row per task before they meet."""
    cell = F.pmod(F.xxhash64("key"), F.lit(KEY_BITS)) + 1
    bits = (keys.select(F.bitmap_bucket_number(cell).alias("bucket"), F.bitmap_bit_position(cell).alias("at"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")))      # KEY_BITS / 32768 rows of 4 KB
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    wanted = (texts.select("key", "text", F.bitmap_bucket_number(cell).alias("bucket"), at.alias("at"))
              .join(F.broadcast(bits), "bucket")
              .filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) != 0))
    return wanted.groupBy("key").agg(F.first("text").alias("text")).join(keys, "key", "left_semi")


# ------------------------------------------------------------ the operator
def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
            percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(rows, links). Rows: ``uid, id, n, first`` per row of ``docs``; ``first``
    is the uid of a row with the same set, which stands for it. Links: ``x, y``
    between such rows, with the components of all links."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100: partners lie in neighbouring size bands")
    bound_arrow(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("string").alias("id"),
                      F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))
    common, parts = owners(src.select("uid", "text"), words, percent)
    kind = docs.schema[id_col].dataType.simpleString()
    marked = materialize(src.mapInPandas(_mark(words, percent, common, parts), MARKED)
                         .withColumn("id", F.col("id").cast(kind)), "marked")
    members, pairs = star_candidates(marked)
    met = pairs.select(F.explode(F.array("x", "y")).alias("uid")).distinct()     # all that can be in a pair, now or later
    keys = materialize(met.join(marked.select("uid", "key"), "uid").select("key").distinct(), "keys")
    texts = materialize(texts_of(keys, src.select("key", "text")), "texts")
    near = materialize(screened(pairs, marked, percent), "screened")
    star = materialize(verified(near, marked, texts, words, percent), "star-links")
    roots = components(star.select(F.col("x").alias("u"), F.col("y").alias("v"))).withColumnRenamed("node", "uid")
    more = cross_candidates(members, roots, marked, percent).join(pairs, ["x", "y"], "left_anti")
    more = materialize(more, "cross-pairs")
    if more.isEmpty():
        return marked, star
    cross = materialize(verified(more, marked, texts, words, percent), "cross-links")
    return marked, star.union(cross)


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                      percent: int = PERCENT) -> DataFrame:
    """One row per document: the id, ``n_shingles``, ``component_id``."""
    rows, links = similar(docs, id_col, text_col, words, percent)
    roots = materialize(components(links.select(F.col("x").alias("u"), F.col("y").alias("v"))), "roots")
    firsts = rows.groupBy("first").agg(F.min("id").alias("low"))
    classes = materialize(firsts.join(roots, F.col("first") == F.col("node"), "left")
                          .select("first", F.coalesce("root", "first").alias("root"), "low"), "classes")
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    of = hot_join(classes, lowest, "root").select("first", "component_id")
    return rows.join(of, "first").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
