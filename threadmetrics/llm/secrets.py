"""Secret scan: fixed patterns plus a log-likelihood ratio of character Markov models.

Two first-order Markov models over the characters of a token are trained from
labelled samples: random strings and ordinary identifiers. A caller gives them
as a table (``string, random``); without one the labels come from the corpus:
the values that the fixed patterns mark are random, all other tokens of four or
more characters (words, names, paths) are ordinary. A stretch of a candidate, a
long run of token characters without its fixed spans, is a secret when the
log-likelihood ratio of the two models reaches ``THRESHOLD`` and it has at
least ``SHORTEST`` characters. The fixed-pattern spans are always kept; the
models only add. The corpus labels know only names like those in the corpus:
names in another language than the texts need labelled samples.

One scan of the texts finds the fixed spans and the candidates and counts the
character pairs of both classes; the pair counts of all tasks are summed by
Spark (a table of ``alphabet squared`` rows reaches the driver, whatever the
input), and the short candidates are then scored.

Defined results: null text is empty and has no spans; a text of any length is
scanned whole; repeated rows give repeated results; an empty table gives an
empty result. Positions count code points, the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_arrow, materialize

KINDS = ("assign", "access", "hex", "markov")     # order of spans that start together
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")          # a run from the first AKIA on, of 16 characters or more
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SHORTEST = 16                                      # characters of a candidate and of a span that the models add
ORDINARY = 4                                       # characters of a token that counts as a sample
ASSIGN_VALUE = 8
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SIZE = len(ALPHABET)
JOINTS = "+/_=-"                                   # they join pieces: paths, snake_case, key=value
HEAD = re.compile(r"\+?([A-Za-z0-9][+/_-])?")      # what a random string may begin or end with beside its pieces:
TAIL = re.compile(r"([+/_-][A-Za-z0-9])?\+?={0,2}")    # a single character behind a joint, a plus, padding
BACK_OFF = 20.0                                    # weight of single characters in a pair's probability
THRESHOLD = float(np.log(1e6))                     # odds of a random string against it: one token in a million
_CODE = np.full(256, -1, dtype=np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(SIZE)
_JOINT = np.isin(np.arange(SIZE), _CODE[np.frombuffer(JOINTS.encode(), dtype=np.uint8)])

SPANS = "array<struct<kind:string,start:long,end:long,llr:double>>"


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """Fixed-pattern spans (start, kind number, end, value start, value end)
    in order. ``text`` has one character per code point."""
    found = []
    low = text.encode("ascii", "replace").lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _pairs(codes: np.ndarray) -> np.ndarray:
    both = codes[:-1] * SIZE + codes[1:]
    return np.bincount(both[(codes[:-1] >= 0) & (codes[1:] >= 0)], minlength=SIZE * SIZE)


def _tokens_only(codes: np.ndarray) -> np.ndarray:
    """``codes`` with everything outside tokens of ``ORDINARY`` or more characters masked."""
    inside = np.concatenate([[0], (codes >= 0).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(inside))
    short = edges[1::2] - edges[::2] < ORDINARY
    out = codes.copy()
    mask = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(mask, edges[::2][short], 1)
    np.add.at(mask, edges[1::2][short], -1)
    out[np.cumsum(mask[:-1]) > 0] = -1
    return out


def _sample_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, SIZE * SIZE), dtype=np.int64)
    for pdf in frames:
        for string, random in zip(pdf["string"], pdf["random"], strict=True):
            counts[int(random)] += _pairs(_CODE[np.frombuffer(string.encode("ascii", "replace"), dtype=np.uint8)])
    held = np.flatnonzero(counts.sum(axis=0))
    yield pd.DataFrame({"pair": held, "random": counts[1, held], "other": counts[0, held]})


def _candidates(text: str, base: list[tuple[int, int, int, int, int]]) -> list[tuple[int, str]]:
    """The parts of long tokens outside the fixed spans; the models alone decide on them."""
    out, i = [], 0
    spans = []                                         # of the fixed spans, overlapping ones joined
    for start, _, end, _, _ in base:
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    for m in CANDIDATE.finditer(text):
        at = m.start()
        while i < len(spans) and spans[i][1] <= at:
            i += 1
        k = i
        while k < len(spans) and spans[k][0] < m.end():
            if spans[k][0] - at > 1:
                out.append((at, text[at:spans[k][0]]))
            at = spans[k][1]
            k += 1
        if m.end() - at > 1:
            out.append((at, text[at:m.end()]))
    return out


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    random, other = np.zeros(SIZE * SIZE, dtype=np.int64), np.zeros(SIZE * SIZE, dtype=np.int64)
    for pdf in frames:
        rows = []
        for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
            text = text or ""
            base = base_spans(text)
            codes = _CODE[np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)]
            total = _pairs(_tokens_only(codes))
            done = 0
            for _, _, _, s, e in sorted(base, key=lambda b: (b[3], b[4])):
                s = max(s, done)       # a hex run inside an assigned value counts once
                if e > s:
                    own = _pairs(codes[s:e])
                    random += own
                    total -= own
                    done = e
            other += np.maximum(total, 0)
            cand = _candidates(text, base)
            rows.append((doc_id, [{"kind": KINDS[k], "start": s, "end": e, "llr": None} for s, k, e, _, _ in base],
                         [c[0] for c in cand], [c[1] for c in cand], -1, 0, 0))
        yield pd.DataFrame(rows, columns=["doc_id", "base", "starts", "tokens", "pair", "random", "other"])
    held = np.flatnonzero(random + other)
    yield pd.DataFrame({"doc_id": None, "base": None, "starts": None, "tokens": None, "pair": held,
                        "random": random[held], "other": other[held]})


def log_ratio(random: np.ndarray, other: np.ndarray) -> np.ndarray:
    """log P_random(next | char) - log P_ordinary(next | char), from pair
    counts. Rare pairs fall back on the frequency of the next character alone
    (without samples a model is uniform)."""
    def logs(counts: np.ndarray) -> np.ndarray:
        c = counts.reshape(SIZE, SIZE).astype(np.float64)
        single = (c.sum(axis=0) + 1.0) / (c.sum() + SIZE)
        return np.log((c + BACK_OFF * single) / (c.sum(axis=1, keepdims=True) + BACK_OFF))
    return logs(random) - logs(other)


def peaks(ratio: np.ndarray) -> list[tuple[int, int, float]]:
    """First pair, end pair and sum of the stretches with a maximal sum of at
    least ``THRESHOLD``. A stretch ends where what follows is ordinary by the
    same odds, so several random pieces are found each for itself."""
    sums = np.concatenate([[0.0], np.cumsum(ratio)])
    if (sums - np.minimum.accumulate(sums)).max() < THRESHOLD - 1e-6:     # most tokens end here
        return []
    found = []
    total = top = 0.0
    first = last = 0
    for i, x in enumerate([*ratio.tolist(), -np.inf]):
        total += x
        if total > top:
            top, last = total, i + 1
        elif total <= max(0.0, top - THRESHOLD):
            if top >= THRESHOLD:
                found.append((first, last, top))
            total, top, first = 0.0, 0.0, i + 1
    return found


def stretches(part: str, table: np.ndarray) -> list[tuple[int, int, float]]:
    """Start, end and log-likelihood ratio of the random stretches of a part.

    Pairs with a joint (``JOINTS``) say nothing, as paths and snake_case hold
    them as well as base64. A stretch covers the pieces between joints that it
    reaches into, whole; a piece at its end whose pairs score less than half
    its mean, and below the bound, is not a part of it."""
    codes = _CODE[np.frombuffer(part.encode(), dtype=np.uint8)]
    ratio = table[codes[:-1], codes[1:]]
    joint = _JOINT[codes]
    ratio[joint[:-1] | joint[1:]] = 0.0
    out: list[tuple[int, int, float]] = []
    edges = None
    for first, last, llr in peaks(ratio):
        if edges is None:
            edges = np.concatenate([[-1], np.flatnonzero(joint), [len(part)]])
        i, j = np.searchsorted(edges, first, side="right") - 1, np.searchsorted(edges, last) - 1    # pieces of both ends
        half = llr / 2 / max(1, np.count_nonzero(ratio[first:last]))      # half the mean of a pair
        while i < j:
            a, b = int(edges[i]) + 1, int(edges[i + 1])
            if ratio[a:b].sum() >= half * (b - a - 1) or ratio[first:b].sum() >= THRESHOLD:
                break
            i += 1
            first = b
        while i < j:
            a, b = int(edges[j]) + 1, int(edges[j + 1])
            if ratio[a:b].sum() >= half * (b - a - 1) or ratio[a:last].sum() >= THRESHOLD:
                break
            j -= 1
            last = a
        start, end = int(edges[i]) + 1, int(edges[j + 1])
        start = 0 if HEAD.fullmatch(part[:start][:4]) and start < 4 else start
        end = len(part) if TAIL.fullmatch(part[end:end + 6]) else end
        if out and start < out[-1][1]:                 # two stretches of one piece
            start, llr = out[-1][0], out[-1][2] + llr
            out.pop()
        out.append((start, end, llr))
    return [x for x in out if x[1] - x[0] >= SHORTEST]


def _score(table: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for doc_id, base, starts, tokens in zip(pdf["doc_id"], pdf["base"], pdf["starts"], pdf["tokens"],
                                                    strict=True):
                spans = [dict(x) for x in base]
                for start, token in zip(starts, tokens, strict=True):
                    spans += [{"kind": "markov", "start": int(start) + a, "end": int(start) + b, "llr": llr}
                              for a, b, llr in stretches(token, table)]
                spans.sort(key=lambda x: (x["start"], KINDS.index(x["kind"])))
                out.append((doc_id, spans))
            yield pd.DataFrame(out, columns=["doc_id", "spans"])
    return run


def scan(docs: DataFrame, samples: DataFrame | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` for every row: kind, start, end and, for spans that
    the models add, their log-likelihood ratio. ``samples``: ``string, random``
    rows to train the models from; rows with a null are ignored."""
    bound_arrow(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = materialize(
        docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
        .mapInPandas(_scan, f"doc_id string, base {SPANS}, starts array<long>, tokens array<string>, "
                            "pair int, random long, other long"), "scan")
    random, other = np.zeros(SIZE * SIZE), np.zeros(SIZE * SIZE)
    pairs = rows.filter("pair >= 0")
    if samples is not None:
        pairs = samples.select("string", "random").dropna().mapInPandas(_sample_pairs, "pair int, random long, other long")
    counted = pairs.groupBy("pair").agg(F.sum("random").alias("r"), F.sum("other").alias("o"))
    for r in counted.collect():        # at most alphabet squared rows
        random[r["pair"]], other[r["pair"]] = r["r"], r["o"]
    found = rows.filter("pair < 0").select("doc_id", "base", "starts", "tokens")
    return (found.mapInPandas(_score(log_ratio(random, other)), f"doc_id string, spans {SPANS}")
            .withColumn("doc_id", F.col("doc_id").cast(kind)))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"),
                                                                     x["end"].cast("string"))))
