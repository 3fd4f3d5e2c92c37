"""Packing documents into fixed-length sequences by cutting-stock column generation.

Documents become token ids (plus an end id) and are cut into full sequences
and one remainder. Only the histogram of remainder lengths (in units of
``UNIT`` tokens, at most ``capacity / UNIT`` classes) reaches the driver. There

* a linear program over patterns (how many pieces of each class share one
  sequence) minimises the number of sequences; its columns are generated by
  an unbounded-knapsack dynamic program over the dual prices,
* the solution is rounded down, and the few pieces left over (fewer sequences
  than classes, whatever the input size) are packed largest first.

Every class's pieces are ranked across the cluster (range partitioning plus
offsets) and the k-th piece of a class goes to the k-th slot its patterns
offer, so the assignment is one broadcast of the pattern table (bounded by
the number of classes, not by the data) and one window per sequence.

Defined results: null or empty text is the end id alone; repeated rows are
packed once each; null ids pass through; an empty table gives an empty
result; texts of any length are cut into pieces, never shortened.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.indexing import global_index
from .common import bound_arrow, materialize, packed, with_uid

CAPACITY = 2048
UNIT = 8
END_ID = 1
VOCABULARY = "byte_bpe_50k.tiktoken"   # the ranks of byte_bpe_50k.json
WHOLE = "byte_bpe_50k.json"
LONG_RUN = 2048                        # bytes without a change between white space and the rest
MAX_COLUMNS = 20_000                   # patterns generated at most; more only improve the packing


# ------------------------------------------------------------ token ids
@lru_cache(maxsize=4)
def _encoders(ranks_path: str, whole_path: str):
    """The same vocabulary in two libraries: the first is faster, the second
    stays linear on words of many thousand characters."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(tok): int(rank) for tok, rank in map(bytes.split, f)}
    special = {"<|endoftext|>": 50256}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens=special)
    return fast, Tokenizer.from_file(whole_path)


_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _has_long_run(text: str) -> bool:
    if len(text) < LONG_RUN // 4:
        return False
    white = _WHITE[np.frombuffer(text.encode("utf-8"), dtype=np.uint8)]
    edges = np.flatnonzero(white[1:] != white[:-1])
    return bool(np.max(np.diff(np.concatenate([[-1], edges, [len(white) - 1]]))) >= LONG_RUN)


def token_ids(text: str | None, ranks_path: str, whole_path: str) -> np.ndarray:
    """Ids of a text, no special tokens added."""
    fast, whole = _encoders(ranks_path, whole_path)
    text = text or ""
    if _has_long_run(text):
        return np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return np.array(fast.encode(text, allowed_special="all"), dtype=np.uint32)


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, dtype: str = "<u4", ranks_path: str | None = None,
                 whole_path: str | None = None) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids`` (little-endian ids as
    bytes): each document's tokens and end id, cut at multiples of
    ``capacity``."""
    bound_arrow(docs.sparkSession)
    ranks_path = ranks_path or public_tokenizers.path(VOCABULARY)
    whole_path = whole_path or public_tokenizers.path(WHOLE)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list[tuple] = []
            held = 0
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
                ids = np.append(token_ids(text, ranks_path, whole_path), np.uint32(end_id)).astype(dtype)
                for start in range(0, len(ids), capacity):
                    part = ids[start:start + capacity]
                    out.append((doc_id, start, len(part), len(ids), part.tobytes()))
                held += len(ids)
                if held > 4_000_000:
                    yield pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "ids"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "ids"])

    kind = dict(docs.dtypes)[id_col]
    # ids travel as strings: a null in a numeric column would turn it into floats
    return (docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInPandas(cut, "doc_id string, start long, length long, doc_tokens long, ids binary")
            .withColumn("doc_id", F.col("doc_id").cast(kind)))


# ------------------------------------------------------------ patterns
def _price(sizes: np.ndarray, duals: np.ndarray, cap: int) -> tuple[float, np.ndarray]:
    """Best value of an unbounded knapsack of ``cap`` units and its counts."""
    best = np.zeros(cap + 1)
    take = np.full(cap + 1, -1)
    for c in range(1, cap + 1):
        best[c] = best[c - 1]
        fit = np.searchsorted(sizes, c, side="right")
        if fit:
            got = best[c - sizes[:fit]] + duals[:fit]
            j = int(np.argmax(got))
            if got[j] > best[c] + 1e-12:
                best[c], take[c] = got[j], j
    counts, c = np.zeros(len(sizes)), cap
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= int(sizes[take[c]])
    return float(best[cap]), counts


def _invert(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan inverse of a small matrix (no BLAS threads in the driver)."""
    n = len(a)
    w = np.hstack([a, np.eye(n)])
    for i in range(n):
        p = i + int(np.argmax(np.abs(w[i:, i])))
        w[[i, p]] = w[[p, i]]
        w[i] /= w[i, i]
        factor = w[:, i].copy()
        factor[i] = 0
        w -= factor[:, None] * w[i]
    return w[:, n:]


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", a, x)


def solve_patterns(counts: dict[int, int], cap: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class size: pieces}, times used) that hold exactly
    ``counts`` pieces of each size (1..cap units) in sequences of ``cap``."""
    sizes = np.array(sorted(k for k, n in counts.items() if n > 0), dtype=np.int64)
    if not len(sizes):
        return []
    need = np.array([counts[int(k)] for k in sizes], dtype=np.float64)
    m = len(sizes)
    # distinct tiny amounts keep the simplex steps from cycling among ties
    need_lp = need + 1e-5 * (1 + np.arange(m)) / m
    lowest, since = np.inf, 0
    basis = np.diag((cap // sizes).astype(np.float64))
    inverse = np.diag(1.0 / np.diag(basis))
    for step in range(MAX_COLUMNS):
        duals = inverse.sum(axis=0)
        value, column = _price(sizes, duals, cap)
        x = _times(inverse, need_lp)
        since = 0 if x.sum() < lowest * (1 - 1e-7) else since + 1
        lowest = min(lowest, x.sum())
        if value <= 1 + 1e-7 or since > m:   # optimal, or only steps of no gain are left
            break
        direction = _times(inverse, column)
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        if step % 256 == 255:
            inverse = _invert(basis)
        else:
            row = inverse[out] / direction[out]
            inverse = inverse - np.outer(direction, row)
            inverse[out] = row
    uses = np.floor(_times(_invert(basis), need) + 1e-7).astype(np.int64).clip(0)
    left = need.astype(np.int64)
    plan = []
    for j in range(m):
        col = basis[:, j].astype(np.int64)
        held = col > 0
        n = int(min(uses[j], (left[held] // col[held]).min()))
        if n > 0:
            plan.append(({int(sizes[i]): int(col[i]) for i in np.flatnonzero(held)}, n))
            left -= n * col
    # what rounding leaves: fill sequences largest piece first
    while left.any():
        room, col = cap, np.zeros(m, dtype=np.int64)
        for i in range(m - 1, -1, -1):
            col[i] = min(left[i], room // sizes[i])
            room -= int(col[i] * sizes[i])
        held = col > 0
        n = int((left[held] // col[held]).min())
        plan.append(({int(sizes[i]): int(col[i]) for i in np.flatnonzero(held)}, n))
        left -= n * col
    return plan


def _slots(plan: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, rank past the last, first sequence, pieces per sequence)."""
    rows, used, base = [], {}, 0
    for pattern, times in plan:
        for k, a in pattern.items():
            lo = used.get(k, 0)
            used[k] = lo + a * times
            rows.append((k, lo, used[k], base, a))
        base += times
    return rows


# ------------------------------------------------------------ assignment
def pack(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, length_col: str = "length") -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``: pieces of at most
    ``capacity`` tokens placed gaplessly in sequences."""
    spark = pieces.sparkSession
    rows = materialize(with_uid(packed(pieces, _length=length_col)), "pieces")
    sized = rows.select("_uid", "_length", F.ceil(F.col("_length") / unit).cast("int").alias("k"))
    counts = {r["k"]: r["n"] for r in sized.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}  # classes
    if any(k is None or not 1 <= k <= capacity // unit for k in counts):
        raise ValueError(f"piece lengths must be 1 to {capacity}")
    slots = _slots(solve_patterns(counts, capacity // unit))
    firsts, total = [], 0
    for k in sorted(counts):
        firsts.append((k, total))
        total += counts[k]
    slot_table = F.broadcast(spark.createDataFrame(   # bounded by the classes and their patterns
        [(k, lo + dict(firsts)[k], hi + dict(firsts)[k], seq, a) for k, lo, hi, seq, a in slots],
        "sk int, lo long, hi long, seq long, per long"))
    ranked = global_index(sized, ["k", "_length", "_uid"], "rank")
    placed = (ranked.join(slot_table, (F.col("k") == F.col("sk")) & (F.col("rank") >= F.col("lo"))
                          & (F.col("rank") < F.col("hi")))
              .withColumn("sequence_id", F.col("seq") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))))
    w = Window.partitionBy("sequence_id").orderBy(F.desc("k"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("_uid", "sequence_id", F.coalesce(F.sum("_length").over(w), F.lit(0)).alias("offset"))
    return rows.join(placed, "_uid").select("_row.*", "sequence_id", "offset")
