"""Boosted regression trees on gradient histograms (M7).

Second-order boosting with l1 and l2 terms, learned directions for missing
values and an early stop. The rows are stored once as small bin numbers; one
level of a tree is one job: every task adds its rows' gradients up per (node,
feature, bin), the sums meet by key, and the best cut of every node is found by
a running sum over at most ``bins`` cells. The driver sees one row per node.
Rows whose cells outside each feature's commonest bin number at most
``LOCAL_CELLS`` fit one task, which then grows all trees: the same whole-number
sums and the same cuts without a job per level.

Sums are whole numbers (gradients in fixed point), so the trees do not depend
on how the rows are partitioned, on task order or on retried tasks, given the
bin borders. Those come from Spark's quantile sketch, whose error of one rank in
10,000 may fall differently under another partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import materialize, release

ROWS = "bins array<smallint>, y double, margin double, held boolean, h bigint"
CELLS = "node int, feature int, bin int, g bigint, h bigint"
FOLD = 16           # trees whose outputs are recomputed before they are stored as margins
SKETCH_COLUMNS = 64     # features per quantile job
CHUNK_CELLS = 1 << 20   # row x feature cells handled at once in a task
LOCAL_CELLS = 1 << 24   # cells outside their feature's commonest bin that one task may hold
LOCAL_ROWS = 1 << 20    # and rows, of some numbers each
LOCAL_SUMS = 1 << 23    # and sums of one level
SUM_ROWS = 1 << 17      # rows of one floating sum of whole numbers: it stays exact
FITTED = "turn int, node int, feature int, cut int, missing_left boolean, weight double"


@dataclass(frozen=True)
class Params:
    rounds: int = 3000
    step: float = 0.005
    depth: int = 4
    l1: float = 1.0
    l2: float = 3.0
    gamma: float = 1.0          # a cut must gain more than this
    min_child: float = 1.0      # smallest sum of second derivatives in a child
    row_share: float = 0.8      # of the rows, drawn per tree by key
    column_share: float = 0.8   # of the features, drawn per tree
    bins: int = 256
    patience: int = 50          # rounds without a better held-out error
    objective: str = "squared"  # or "logistic" (labels 0 and 1)
    seed: int = 42


@dataclass
class Tree:
    """A tree in heap order: the children of node ``i`` are ``2i+1`` and ``2i+2``."""

    feature: np.ndarray         # -1: a leaf
    cut: np.ndarray             # bin number, rows at or below go left
    value: np.ndarray           # the same border as a feature value
    missing_left: np.ndarray
    weight: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n, bool), np.zeros(n))

    def leaves(self, x: np.ndarray, cuts: np.ndarray, missing: np.ndarray, levels: int) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(levels):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            f = np.where(inner, f, 0)
            left = np.where(missing[rows, f], self.missing_left[at], x[rows, f] <= cuts[at])
            at = np.where(inner, 2 * at + np.where(left, 1, 2), at)
        return at


def _levels(tree: Tree) -> int:
    return len(tree.feature).bit_length() - 1


def _add(trees: list[Tree], bins: np.ndarray, margin: np.ndarray) -> np.ndarray:
    missing = bins < 0
    for t in trees:
        margin = margin + t.weight[t.leaves(bins, t.cut, missing, _levels(t))]
    return margin


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    """A list column as a matrix; null cells become NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width:
        raise ValueError(f"every row must have {width} features")
    return flat.astype(dtype, copy=False).reshape(len(column), width)


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    size = max(1, min(1 << 14, CHUNK_CELLS // width))
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def _uniform(h: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in [0, 1) per key hash, tree and seed."""
    with np.errstate(over="ignore"):
        z = h.view(np.uint64) + np.uint64((seed * 1_000_003 + turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _gradients(p: Params, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second derivative and loss of every row."""
    if p.objective == "logistic":
        prob = 1.0 / (1.0 + np.exp(-margin))
        loss = np.logaddexp(0.0, margin) - y * margin
        return prob - y, prob * (1.0 - prob), loss
    gap = margin - y
    return gap, np.ones_like(gap), gap * gap


def _cells(p: Params, scale: _Scale, width: int, done: list[Tree], tree: Tree, level: int, columns: np.ndarray, turn: int):
    """The task of one level: sums per (node of this level, feature, bin); bin 0
    holds the missing values. On level 0 the held-out loss of the trees so far
    comes along as node -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = p.bins + 1
        shape = ((1 << level), len(columns), slots)
        g_sum, h_sum = (np.zeros(math.prod(shape), np.int64) for _ in range(2))
        loss_sum = held_rows = 0
        for batch in _chunks(batches, width):
            bins = _matrix(batch.column("bins"), width, np.int16)
            y = batch.column("y").to_numpy()
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            margin = _add(done, bins, batch.column("margin").to_numpy())
            g, h, loss = _gradients(p, margin, y)
            if level == 0 and held.any():
                loss_sum += int(np.rint(loss[held] * scale.loss).astype(np.int64).sum())
                held_rows += int(held.sum())
            use = ~held
            if p.row_share < 1.0:
                use &= _uniform(batch.column("h").to_numpy(), p.seed, turn) < p.row_share
            at = tree.leaves(bins, tree.cut, bins < 0, level) - ((1 << level) - 1)
            use &= at >= 0
            if not use.any():
                continue
            cell = ((at[use, None] * shape[1] + np.arange(shape[1])) * slots + bins[use][:, columns] + 1).ravel()
            for into, part, unit in ((g_sum, g, scale.g), (h_sum, h, scale.h)):
                whole = np.repeat(np.rint(part[use] * unit), shape[1])
                into += np.bincount(cell, whole, len(into)).astype(np.int64)
        full = np.flatnonzero(h_sum)
        node, feature, slot = np.unravel_index(full, shape)
        ids = [node, columns[feature], slot]
        values = [g_sum[full], h_sum[full]]
        if held_rows:
            ids = [np.append(a, v) for a, v in zip(ids, (-1, -1, 0))]
            values = [np.append(a, v) for a, v in zip(values, (loss_sum, held_rows))]
        yield pa.record_batch([*[pa.array(a.astype(np.int32)) for a in ids], *[pa.array(a) for a in values]],
                              names=["node", "feature", "bin", "g", "h"])

    return run


def _soft(g: Column, l1: float) -> Column:
    return F.signum(g) * F.greatest(F.abs(g) - l1, F.lit(0.0))


def _best_cuts(cells: DataFrame, p: Params, scale: _Scale) -> list:
    """The best cut of every node: largest gain, then smallest feature and bin,
    missing values to the right. At most ``2 ** level`` rows and the loss."""
    sums = (cells.repartition("node", "feature").groupBy("node", "feature", "bin")
            .agg(F.sum("g").alias("gi"), F.sum("h").alias("hi")))
    whole = Window.partitionBy("node", "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    present = F.col("bin") > 0
    sums = sums.withColumns({
        "ga": F.sum("gi").over(whole), "ha": F.sum("hi").over(whole),
        "gm": F.sum(F.when(~present, F.col("gi")).otherwise(0)).over(whole),
        "hm": F.sum(F.when(~present, F.col("hi")).otherwise(0)).over(whole),
        "gc": F.sum(F.when(present, F.col("gi")).otherwise(0)).over(upto),
        "hc": F.sum(F.when(present, F.col("hi")).otherwise(0)).over(upto),
    })

    def quality(g, h):
        return F.pow(_soft(g, p.l1), F.lit(2.0)) / (h + p.l2)

    def candidate(missing_left: bool):
        gl, hl = (F.col("gc") + F.col("gm"), F.col("hc") + F.col("hm")) if missing_left else (F.col("gc"), F.col("hc"))
        gr, hr = F.col("ga") - gl, F.col("ha") - hl         # whole numbers still: mirrored cuts tie exactly
        (gl, gr, ga), (hl, hr, ha) = ([c / u for c in cs] for cs, u in (((gl, gr, F.col("ga")), scale.g),
                                                                        ((hl, hr, F.col("ha")), scale.h)))
        least = F.lit(max(p.min_child, 0.5 / scale.h))
        gain = quality(gl, hl) + quality(gr, hr) - quality(ga, ha)
        fits = present & (F.col("node") >= 0) & (hl >= least) & (hr >= least)
        return F.when(fits & (gain > p.gamma), F.struct(
            gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"),
            F.lit(0 if missing_left else 1).alias("right"), gl.alias("gl"), hl.alias("hl"), gr.alias("gr"), hr.alias("hr")))

    best = F.greatest(candidate(False), candidate(True))
    return (sums.withColumn("cut", best).groupBy("node")
            .agg(F.max("cut").alias("cut"), (F.max("ga") / scale.g).alias("g"), (F.max("ha") / scale.h).alias("h"),
                 F.max(F.when(F.col("node") < 0, F.col("gi"))).alias("loss"),
                 F.max(F.when(F.col("node") < 0, F.col("hi"))).alias("held")).collect())


@dataclass(frozen=True)
class _Scale:
    """Fixed-point units that keep sums over all rows below 2 ** 60."""

    g: float
    h: float
    loss: float

    @classmethod
    def of(cls, rows: int, reach: float) -> _Scale:
        free = min(34, 58 - max(rows, 1).bit_length())
        top = math.ceil(math.log2(reach)) if reach > 0 else 0
        return cls(2.0 ** (free - top), 2.0 ** free, 2.0 ** (free - 2 * top))


@dataclass
class Boosted:
    """Fitted trees, bounded by rounds x 2 ** (depth + 1) nodes."""

    params: Params
    base: float
    width: int
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)   # held-out loss per row after 0, 1, ... trees

    def predict(self, features: Column) -> Column:
        """Prediction (squared) or probability (logistic) of an array of
        features; null for a null array."""
        trees, base, width, logistic = self.trees, self.base, self.width, self.params.objective == "logistic"

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            known = x.notna().to_numpy()
            out = np.full(len(x), np.nan)
            if known.any():
                m = np.array([np.asarray(v, dtype=np.float64) for v in x[known]]).reshape(int(known.sum()), width)
                total = np.full(len(m), base)
                missing = np.isnan(m)
                for t in trees:
                    total = total + t.weight[t.leaves(m, t.value, missing, _levels(t))]
                out[known] = 1.0 / (1.0 + np.exp(-total)) if logistic else total
            return pd.Series(out).where(known, None)

        return score(features)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per node in use: ``tree, node, feature (null: leaf),
        threshold, missing_left, weight``; tree -1 holds the base."""
        rows = [(-1, 0, None, None, None, self.base)]
        for i, t in enumerate(self.trees):
            live = {0}
            for n in range(len(t.feature)):
                if n in live:
                    leaf = t.feature[n] < 0
                    if not leaf:
                        live |= {2 * n + 1, 2 * n + 2}
                    rows.append((i, n, None if leaf else int(t.feature[n]), None if leaf else float(t.value[n]),
                                 None if leaf else bool(t.missing_left[n]), float(t.weight[n])))
        return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, missing_left boolean, weight double")


def from_table(table: DataFrame, width: int, params: Params) -> Boosted:
    """The model that :meth:`Boosted.table` wrote, for prediction."""
    model = Boosted(params, 0.0, width)
    for r in sorted(table.collect(), key=lambda r: (r["tree"], r["node"])):     # a model, bounded by its rounds
        if r["tree"] < 0:
            model.base = r["weight"]
            continue
        while len(model.trees) <= r["tree"]:
            model.trees.append(Tree.empty(params.depth))
        t, n = model.trees[r["tree"]], r["node"]
        t.weight[n] = r["weight"]
        if r["feature"] is not None:
            t.feature[n], t.value[n], t.missing_left[n] = r["feature"], r["threshold"], r["missing_left"]
    return model


def feature_array(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def borders(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` rising borders per feature from quantile sketches;
    a feature without values has none."""
    shares = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])     # one column for all features
    found: list[np.ndarray] = []
    for start in range(0, width, SKETCH_COLUMNS):
        ids = range(start, min(start + SKETCH_COLUMNS, width))
        cells = [F.get("x", F.lit(i)) for i in ids]
        row = rows.agg(*[F.percentile_approx(F.when(~F.isnan(c), c), shares, max(10_000, 40 * bins)).alias(f"q{i}")
                         for i, c in zip(ids, cells)]).first()
        found += [np.unique(np.array(row[f"q{i}"] or [], dtype=np.float64)) for i in ids]
    return found


def _binned(edges: list[np.ndarray], base: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, len(edges)):
            x = _matrix(batch.column("x"), len(edges), np.float64)
            bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.int16)
            bins[np.isnan(x)] = -1
            n = len(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(edges)), pa.array(bins.ravel()))
            yield pa.record_batch([lists, batch.column("y"), pa.array(np.full(n, base)), batch.column("held"), batch.column("h")],
                                  names=["bins", "y", "margin", "held", "h"])

    return run


def _columns(p: Params, width: int, turn: int) -> np.ndarray:
    """The features drawn for a tree."""
    draw = _uniform(np.arange(width, dtype=np.int64), p.seed + 1, turn)
    return np.sort(np.argsort(draw, kind="stable")[:max(1, math.ceil(p.column_share * width))])


def _bin_counts(width: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width * slots, np.int64)
        for batch in _chunks(batches, width):
            cell = np.arange(width) * slots + _matrix(batch.column("bins"), width, np.int16) + 1
            counts += np.bincount(cell.ravel(), minlength=len(counts))
        full = np.flatnonzero(counts)
        yield pa.record_batch([pa.array((full // slots).astype(np.int32)), pa.array((full % slots).astype(np.int32)),
                               pa.array(counts[full])], names=["feature", "slot", "n"])

    return run


def _commonest(state: DataFrame, width: int, bins: int) -> tuple[np.ndarray, int]:
    """The commonest bin of every feature (counted from 1, 0: missing), and how
    many cells hold another one."""
    counts = state.mapInArrow(_bin_counts(width, bins + 1), "feature int, slot int, n bigint").groupBy("feature", "slot").agg(
        F.sum("n").alias("n"))
    usual, others = np.zeros(width, np.int64), 0
    for r in counts.groupBy("feature").agg(F.max(F.struct("n", (-F.col("slot")).alias("s"))).alias("m"),
                                           F.sum("n").alias("n")).collect():      # one row per feature
        usual[r["feature"]] = -r["m"]["s"]
        others += r["n"] - r["m"]["n"]
    return usual, others


def _local_cuts(p: Params, scale: _Scale, nodes: int, g: np.ndarray, h: np.ndarray, total: np.ndarray, at: np.ndarray,
                slot: np.ndarray, feature: np.ndarray, first: np.ndarray, missing: np.ndarray):
    """:func:`_best_cuts` over the cells of one level in arrays: ``g``, ``h``
    (node, slot) whole numbers, ``total`` the nodes' sums. Yields node and cut."""
    size = g.shape[1]
    g = np.where(h > 0, g, 0)
    before = [np.concatenate([np.zeros((nodes, 1), np.int64), np.cumsum(a, axis=1)], axis=1) for a in (g, h)]
    node, cell = np.nonzero(h * at > 0)
    of = feature[cell]
    start = first[of] + 1                       # the feature's first bin of values
    gc, hc = (b[node, cell + 1] - b[node, start] for b in before)
    gm, hm = g[node, first[of]], h[node, first[of]]
    ga, ha = total[0][node], total[1][node]

    def quality(g, h):
        soft = np.sign(g) * np.maximum(np.abs(g) - p.l1, 0.0)
        return soft * soft / (h + p.l2)

    least, found = max(p.min_child, 0.5 / scale.h), []
    for right, gl, hl in ((1, gc, hc), (0, gc + gm, hc + hm)):
        sides = [x / u for x, u in ((gl, scale.g), (ga - gl, scale.g), (hl, scale.h), (ha - hl, scale.h))]
        gain = quality(sides[0], sides[2]) + quality(sides[1], sides[3]) - quality(ga / scale.g, ha / scale.h)
        fits = np.flatnonzero((sides[2] >= least) & (sides[3] >= least) & (gain > p.gamma))
        found.append((node[fits], gain[fits], cell[fits], np.full(len(fits), right), *[x[fits] for x in sides]))
    columns = [np.concatenate(x) for x in zip(*found)]
    order = np.lexsort((-columns[3], columns[2], -columns[1], columns[0]))      # cells go by feature, then bin
    best = order[np.unique(columns[0][order], return_index=True)[1]]
    for i in best:
        c = columns[2][i]
        yield int(columns[0][i]), int(feature[c]), int(slot[c]) - 1, bool(columns[3][i] == 0), [float(x[i]) for x in columns[4:]]


def _grow(p: Params, scale: _Scale, edges: list[np.ndarray], usual: np.ndarray):
    """All rounds in one task: the rows are kept as their cells outside the
    commonest bins, whose sums are what is left of the node's."""
    width = len(edges)
    slots = np.array([len(e) + 2 for e in edges])
    first = np.concatenate([[0], np.cumsum(slots)[:-1]])
    size = int(slots.sum())
    feature = np.repeat(np.arange(width), slots)
    slot = np.arange(size) - first[feature]
    usual_at = first + usual

    def read(batches: Iterator[pa.RecordBatch]):
        parts, rows, n = [], [], 0
        for batch in _chunks(batches, width):
            cells = _matrix(batch.column("bins"), width, np.int16) + 1
            row, f = np.nonzero(cells != usual)
            parts.append(((row + n).astype(np.int32), (first[f] + cells[row, f]).astype(np.int32)))
            rows.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "margin", "held", "h")])
            n += batch.num_rows
        if not n:
            return None
        row, at = (np.concatenate(x) for x in zip(*parts))
        y, margin, held, h = (np.concatenate(x) for x in zip(*rows))
        return row, at, y, margin, held.astype(bool), h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = read(batches)
        if data is None:
            return
        row, at, y, margin, held, hashes = data
        bounds = np.searchsorted(row, np.arange(0, len(y) + SUM_ROWS, SUM_ROWS))     # entries come by row
        by_slot = np.argsort(at, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=size))])
        out, losses, best = [], [], 0

        def side(f: int, cut: int, missing_left: bool, rows: np.ndarray) -> np.ndarray:
            """Which of ``rows`` go left: the feature's cells are one stretch by slot."""
            goes = np.full(len(y), (usual[f] <= cut + 1) if usual[f] else missing_left)
            entries = by_slot[ends[first[f]]:ends[first[f] + slots[f]]]
            value = at[entries] - first[f]
            goes[row[entries]] = np.where(value == 0, missing_left, value <= cut + 1)
            return goes[rows]

        for turn in range(p.rounds + 1):
            chosen = np.zeros(width, bool)
            chosen[_columns(p, width, turn)] = True
            allowed = (chosen[feature] & (slot > 0)).astype(np.int64)
            g, h, loss = _gradients(p, margin, y)
            if held.any():
                losses.append(int(np.rint(loss[held] * scale.loss).astype(np.int64).sum()) / scale.loss / int(held.sum()))
                if losses[-1] < losses[best]:
                    best = turn
            if turn == p.rounds or (losses and turn - best >= p.patience):
                break
            tree = Tree.empty(p.depth)
            use = ~held
            if p.row_share < 1.0:
                use &= _uniform(hashes, p.seed, turn) < p.row_share
            g, h = (np.rint(a * u) * use for a, u in ((g, scale.g), (h, scale.h)))
            place = np.zeros(len(y), np.int64)          # of every row, held-out ones too
            for level in range(p.depth):
                nodes = 1 << level
                node = place - (nodes - 1)
                live = node >= 0
                node = np.where(live, node, 0)
                sums, total = [], []
                for a in (g, h):
                    a, hist, whole = a * live, np.zeros(nodes * size, np.int64), np.zeros(nodes, np.int64)
                    for i, (b, e) in enumerate(zip(bounds, bounds[1:])):
                        rows = slice(i * SUM_ROWS, (i + 1) * SUM_ROWS)
                        r = row[b:e]
                        hist += np.bincount(node[r] * size + at[b:e], a[r], len(hist)).astype(np.int64)
                        whole += np.bincount(node[rows], a[rows], nodes).astype(np.int64)
                    hist = hist.reshape(nodes, size)
                    hist[:, usual_at] = whole[:, None] - np.add.reduceat(hist, first, axis=1)
                    sums.append(hist)
                    total.append(whole)
                if level == 0:
                    tree.weight[0] = _leaf(total[0][0] / scale.g, total[1][0] / scale.h, p)
                cut_any = False
                for n, f, b, missing_left, (gl, gr, hl, hr) in _local_cuts(
                        p, scale, nodes, sums[0], sums[1], total, allowed, slot, feature, first, usual_at):
                    cut_any, n = True, nodes - 1 + n
                    tree.feature[n], tree.cut[n], tree.missing_left[n] = f, b, missing_left
                    tree.weight[2 * n + 1], tree.weight[2 * n + 2] = _leaf(gl, hl, p), _leaf(gr, hr, p)
                    here = np.flatnonzero(place == n)
                    place[here] = 2 * n + np.where(side(f, b, missing_left, here), 1, 2)
                if not cut_any:
                    break
            margin = margin + tree.weight[place]
            out.append(tree)
        if losses:
            out = out[:best]
        nodes = len(Tree.empty(p.depth).feature)
        yield pa.record_batch([pa.array(np.full(len(losses), -1, np.int32)), pa.array(np.arange(len(losses), dtype=np.int32)),
                               *[pa.nulls(len(losses), t) for t in (pa.int32(), pa.int32(), pa.bool_())],
                               pa.array(np.array(losses, dtype=np.float64))], names=["turn", "node", "feature", "cut", "missing_left", "weight"])
        for turn, t in enumerate(out):
            yield pa.record_batch([pa.array(np.full(nodes, turn, np.int32)), pa.array(np.arange(nodes, dtype=np.int32)),
                                   pa.array(t.feature), pa.array(t.cut), pa.array(t.missing_left), pa.array(t.weight)],
                                  names=["turn", "node", "feature", "cut", "missing_left", "weight"])

    return run


def _border(edges: np.ndarray, b: int) -> float:
    return edges[b] if b < len(edges) else math.inf      # parts the missing from all others


def _fit_local(model: Boosted, state: DataFrame, scale: _Scale, edges: list[np.ndarray], usual: np.ndarray) -> Boosted:
    p = model.params
    fitted = state.coalesce(1).mapInArrow(_grow(p, scale, edges, usual), FITTED)
    for r in sorted(fitted.collect(), key=lambda r: (r["turn"], r["node"])):     # a model, bounded by its rounds
        if r["turn"] < 0:
            model.losses.append(r["weight"])
            continue
        if r["node"] == 0:
            model.trees.append(Tree.empty(p.depth))
        t, n = model.trees[-1], r["node"]
        t.weight[n], t.feature[n] = r["weight"], r["feature"]
        if r["feature"] >= 0:
            t.cut[n], t.missing_left[n] = r["cut"], r["missing_left"]
            t.value[n] = _border(edges[r["feature"]], r["cut"])
    return model


def _stored_margins(trees: list[Tree], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches, width):
            margin = _add(trees, _matrix(batch.column("bins"), width, np.int16), batch.column("margin").to_numpy())
            yield pa.record_batch([batch.column("bins"), batch.column("y"), pa.array(margin), batch.column("held"),
                                   batch.column("h")], names=["bins", "y", "margin", "held", "h"])

    return run


def _leaf(g: float, h: float, p: Params) -> float:
    if h + p.l2 <= 0:
        return 0.0
    return -p.step * math.copysign(max(abs(g) - p.l1, 0.0), g) / (h + p.l2)


def fit(df: DataFrame, key: str, features: Column, width: int, label: str, held: str | None = None,
        params: Params = Params()) -> Boosted:
    """Fit on the rows whose ``held`` column is not true; the others decide
    the early stop, and the model keeps the trees of their smallest loss.

    ``features`` is an array of ``width`` numbers; null and NaN cells are
    missing, and every cut learns the side they take. Rows with a null label or
    array take no part; rows of one ``key`` are drawn together; without any row
    the model predicts 0. A cut that gains ``gamma`` or less is not made."""
    if width < 1 or not 2 <= params.bins <= 32_000:
        raise ValueError("needs at least one feature and 2 to 32000 bins")
    p = params
    held_col = F.coalesce(F.col(held).cast("boolean"), F.lit(False)) if held else F.lit(False)
    rows = materialize(df.select(features.cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"),
                                 held_col.alias("held"), F.xxhash64(key).alias("h"))
                       .filter("x is not null and y is not null and not isnan(y)"), "boost-input")
    seen = rows.agg(F.count_if(~F.col("held")).alias("n"), F.avg(F.when(~F.col("held"), F.col("y"))).alias("mean"),
                    F.count(F.lit(1)).alias("all"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    model = Boosted(p, 0.0, width)
    if not seen["n"]:
        release(rows)
        return model
    mean = seen["mean"]
    if p.objective == "logistic":
        if seen["lo"] < 0 or seen["hi"] > 1:
            raise ValueError("logistic labels lie in 0..1")
        share = min(max(mean, 1e-6), 1 - 1e-6)
        model.base, reach = math.log(share / (1 - share)), 1.0
    else:
        model.base, reach = mean, max(seen["hi"] - mean, mean - seen["lo"])
    scale = _Scale.of(seen["all"], reach)
    edges = borders(rows.filter(~F.col("held")), width, p.bins)
    state = materialize(rows.mapInArrow(_binned(edges, model.base), ROWS), "boost-rows")
    release(rows)

    if seen["all"] <= LOCAL_ROWS and sum(len(e) + 2 for e in edges) << p.depth <= 2 * LOCAL_SUMS:
        usual, others = _commonest(state, width, p.bins)
        if others <= LOCAL_CELLS:
            _fit_local(model, state, scale, edges, usual)
            release(state)
            return model

    pending: list[Tree] = []
    best = 0
    for turn in range(p.rounds + 1):
        columns = _columns(p, width, turn)
        tree = Tree.empty(p.depth)
        for level in range(p.depth if turn < p.rounds else 1):
            cells = state.mapInArrow(_cells(p, scale, width, pending, tree, level, columns, turn), CELLS)
            cut_any = False
            for r in _best_cuts(cells, p, scale):
                if r["node"] < 0:
                    model.losses.append(r["loss"] / scale.loss / r["held"])
                    continue
                n = (1 << level) - 1 + r["node"]
                if level == 0:
                    tree.weight[0] = _leaf(r["g"], r["h"], p)
                c = r["cut"]
                if c is None:
                    continue
                cut_any = True
                f, b = -c["f"], -c["b"] - 1
                tree.feature[n], tree.cut[n], tree.missing_left[n] = f, b, not c["right"]
                tree.value[n] = _border(edges[f], b)
                tree.weight[2 * n + 1], tree.weight[2 * n + 2] = _leaf(c["gl"], c["hl"], p), _leaf(c["gr"], c["hr"], p)
            if not cut_any:
                break
        if model.losses and model.losses[-1] < model.losses[best]:
            best = turn
        if turn == p.rounds or (model.losses and turn - best >= p.patience):
            break
        model.trees.append(tree)
        pending.append(tree)
        if len(pending) == FOLD:
            older, state = state, materialize(state.mapInArrow(_stored_margins(pending, width), ROWS), "boost-rows")
            release(older)
            pending = []
    release(state)
    if model.losses:
        model.trees = model.trees[:best]
    return model
