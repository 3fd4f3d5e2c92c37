"""Mixing to target weights with soft domain membership, as DataFrame and SQL functions only.

1. A classifier learned from a labelled table predicts for every document the
   posterior of each domain: per domain the ``WORDS`` most characteristic words
   are found by log-odds over the labelled documents, a document's hits in each
   list (one array intersection with all lists, parted by list, no shuffle) are
   scored by multinomial naive Bayes.
2. The expected tokens of domain d under document rates r are
   ``sum_i r_i * tokens_i * posterior_i(d)``. Projected gradient descent on the
   squared distance to the target totals finds rates ``r >= min_rate``. The
   steps are implicit: a row moves against the gradient at the point that the
   step leads to, then is projected, which descends at any length. That point
   follows from one number per domain, found by Newton's method; each Newton
   step is one aggregate over a compact table of posteriors and token counts,
   or three where its whole length does not help: one more for all shorter
   lengths together and one for the length taken.
   The loop ends when the targets are met or a step no longer helps. Its state
   is a list of moves, domains x steps numbers, from which every row recomputes
   its own rate, so a lost executor costs a rescan only.
3. A rate becomes copies: its whole part, plus one more for as many rows as the
   fractions add up to. Rows of a domain are walked in the order of tokens and
   id hash, and a row gets the extra copy when the running total of fractions
   passes a whole number: copies and tokens of a domain stay within one row of
   the fit. Sums are of whole numbers, so neither rates nor copies depend on
   the partitioning.

The classifier learns from at most ``MAX_LABELLED`` labelled ids (per domain the
lowest hashes of the ids, see ``shares``; a documented bound of the fit), each
with one text; the domains and their prior shares come from all labelled ids;
counts, totals and rates cover all rows.

Defined results: null text has no tokens; null labels are not learned from;
without labels every document belongs to the one domain ``all``; repeated rows
get rates of their own; an empty table gives an empty result; targets name
known domains or are ignored, and a domain without a target has weight zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import flagged, materialize, packed, with_uid

MAX_LABELLED = 4000
WORDS = 64
STEPS, INNER = 12, 30     # at most: implicit steps, Newton steps in each
STIFF = 1e-5              # weight of staying where the rates are in a step
CLOSE, STILL = 1e-12, 1e-8  # squared gap in shares of the whole: met; no longer falling
LARGEST = 1e6             # of a rate while it is looked for
UNIT = 1 << 16            # sums are of whole 65536ths of a token
WHOLE = 1 << 30           # fractions of a copy
MAX_DOMAINS = 64
LENGTHS = [0.5 ** i for i in range(21)]     # of a Newton step, the first that helps is taken
WHITE = r"\s+"            # the six characters \x20 and \x09-\x0D, told apart faster than by a class that lists them


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITE), lambda w: w != "")


class DomainModel:
    """Word lists per domain and naive Bayes weights over their hits."""

    def __init__(self, domains: list[str], lists: list[list[str]], prior: list[float], weights: list[list[float]]):
        self.domains, self.lists, self.prior, self.weights = domains, lists, prior, weights

    def known(self, words: Column) -> Column:
        """The distinct words that are in any list, looked up once."""
        every = sorted({w for ws in self.lists for w in ws})
        return F.array_intersect(words, F.array(*[F.lit(w) for w in every]).cast("array<string>"))

    def hits(self, known: Column) -> list[Column]:
        """How many of the ``known`` words each list has, one column per domain."""
        def inside(ws: list[str]) -> Callable:
            return lambda w: w.isin(ws)
        return [F.size(F.filter(known, inside(ws))) for ws in self.lists]

    def posteriors(self, hits: list[Column]) -> list[Column]:
        """Softmax of log prior plus hits x log weights, one column per domain."""
        scores = [reduce(lambda a, b: a + b, [h * F.lit(w) for h, w in zip(hits, ws, strict=True)], F.lit(p))
                  for p, ws in zip(self.prior, self.weights, strict=True)]
        top = F.greatest(*scores) if len(scores) > 1 else scores[0]
        exps = [F.exp(s - top) for s in scores]
        total = reduce(lambda a, b: a + b, exps)
        return [e / total for e in exps]


def shares(count: dict[str, int], most: int) -> dict[str, int]:
    """How many rows of each domain are learned from: all, or equal parts of
    ``most``; what a small domain leaves over goes to the others."""
    parts, left = {}, max(most, len(count))
    for i, (d, n) in enumerate(sorted(count.items(), key=lambda x: (x[1], x[0]))):
        parts[d] = min(n, left // (len(count) - i))
        left -= parts[d]
    return parts


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        domain_col: str = "domain", max_labelled: int = MAX_LABELLED) -> DomainModel:
    """Learn the domains of ``labelled`` (id and domain) from their texts."""
    known = (labelled.filter(F.col(domain_col).isNotNull() & F.col(id_col).isNotNull())
             .select(F.col(id_col).alias("_id"), F.col(domain_col).cast("string").alias("domain")).distinct())
    count = {r["domain"]: r["n"] for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
             .limit(MAX_DOMAINS + 1).collect()}
    if len(count) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains; the model holds no more")
    if not count:
        return DomainModel(["all"], [[]], [0.0], [[0.0]])
    parts = shares(count, max_labelled)
    # the lowest hashes of each domain: far more than its part are left out before they meet
    spread = 1 << 40
    below = {d: min(spread, int(spread * (n + 10 * n ** 0.5 + 64) / count[d])) for d, n in parts.items()}
    quota = F.create_map(*[x for d, n in parts.items() for x in (F.lit(d), F.lit(n))])
    bound = F.create_map(*[x for d, n in below.items() for x in (F.lit(d), F.lit(n).cast("long"))])
    first = Window.partitionBy("domain").orderBy("hash", "_id")      # about the part's size of rows per domain
    chosen = (known.withColumn("hash", F.pmod(F.xxhash64("_id"), F.lit(spread)))
              .filter(F.col("hash") < bound[F.col("domain")])
              .withColumn("at", F.row_number().over(first)).filter(F.col("at") <= quota[F.col("domain")])
              .drop("at", "hash"))
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(chosen), "_id")            # at most max_labelled rows are broadcast
            .groupBy("_id", "domain").agg(F.min("_text").alias("_text"))     # and as many leave the join
            .withColumn("words", F.array_distinct(_words(F.col("_text")))))
    rows = materialize(rows.select("domain", "words"), "labelled")
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    domains, total = sorted(sizes), sum(sizes.values())
    if not domains:
        return DomainModel(["all"], [[]], [0.0], [[0.0]])
    seen = rows.select("domain", F.explode("words").alias("word")).groupBy("word", "domain").agg(
        F.count(F.lit(1)).alias("n"))
    size = F.create_map(*[x for d in domains for x in (F.lit(d), F.lit(float(sizes[d])))])
    every = seen.groupBy("word").agg(F.sum("n").alias("all"))
    inside = (F.col("n") + 0.5) / (size[F.col("domain")] + 1)
    outside = (F.col("all") - F.col("n") + 0.5) / (total - size[F.col("domain")] + 1)
    # how much a domain's documents favour the word, weighted by how often it helps
    gain = (F.col("n") / size[F.col("domain")]) * F.log(inside / outside)
    best = Window.partitionBy("domain").orderBy(F.desc("gain"), "word")     # words of a bounded sample
    top = (seen.filter(F.col("domain").isin(domains)).join(every, "word").withColumn("gain", gain).filter("gain > 0")
           .withColumn("at", F.row_number().over(best)).filter(F.col("at") <= WORDS))
    lists = {d: [] for d in domains}
    for r in top.select("domain", "word").orderBy("domain", "at").collect():   # domains x WORDS rows
        lists[r["domain"]].append(r["word"])
    model = DomainModel(domains, [lists[d] for d in domains], [], [])
    found = rows.select("domain", model.known(F.col("words")).alias("known"))
    sums = found.select("domain", *[h.alias(f"h{j}") for j, h in enumerate(model.hits(F.col("known")))]).groupBy(
        "domain").agg(*[F.sum(f"h{j}").alias(f"h{j}") for j in range(len(domains))])
    hits = {r["domain"]: r for r in sums.collect()}
    for d in domains:
        row = [float(hits[d][f"h{j}"]) + 1.0 for j in range(len(domains))]
        model.weights.append([math.log(x / sum(row)) for x in row])
        model.prior.append(math.log(count[d] / sum(count[e] for e in domains)))
    return model


# ------------------------------------------------------------ rates
def _solved(a: list[list[float]], y: list[float]) -> list[float]:
    """x of a x = y for a small positive definite matrix, by elimination."""
    n = len(y)
    w = [[*row, v] for row, v in zip(a, y, strict=True)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(w[r][i]))
        w[i], w[p] = w[p], w[i]
        for r in range(i + 1, n):
            f = w[r][i] / w[i][i]
            w[r] = [x - f * z for x, z in zip(w[r], w[i], strict=True)]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (w[i][n] - sum(w[i][j] * x[j] for j in range(i + 1, n))) / w[i][i]
    return x


def _step(evaluate: Callable, values: Callable, moves: list[list[float]], target: list[float],
          start: tuple[list[float], list[list[float]], float]) -> list[float]:
    """The move of one implicit step: the minimum of a convex function of one
    number per domain, whose gradient is ``STIFF * v - (totals after v - target)``.
    ``start`` is what ``evaluate`` gives before the move."""
    k = len(target)

    def whole(inner: float, v: list[float]) -> float:
        return inner + sum(t * x + STIFF / 2 * x * x for t, x in zip(target, v, strict=True))

    v = [0.0] * k
    totals, gram, value = *start[:2], whole(start[2], v)
    for _ in range(INNER):
        slope = [STIFF * x - (q - t) for x, q, t in zip(v, totals, target, strict=True)]
        if max(map(abs, slope)) < 1e-9:
            break
        push = _solved([[gram[d][e] + (STIFF if d == e else 0.0) for e in range(k)] for d in range(k)],
                       [-x for x in slope])
        fall = sum(x * y for x, y in zip(slope, push, strict=True))
        points = [[x + length * y for x, y in zip(v, push, strict=True)] for length in LENGTHS]
        enough = [value + 1e-4 * length * fall + 1e-13 for length in LENGTHS]
        found = evaluate(moves, points[0])
        at, least = 0, whole(found[2], points[0])
        if not least <= enough[0]:
            # near the minimum the sums' rounding hides the fall and many lengths fail: all are looked at in one pass
            shorter = [math.inf, *map(whole, values(moves, points[1:]), points[1:])]
            for at in range(1, len(LENGTHS)):
                least = shorter[at]
                if least <= enough[at] or (at == len(LENGTHS) - 1 and not least > value):
                    found = evaluate(moves, points[at])
                    least = whole(found[2], points[at])     # infinite where another sum is too large
                    if least <= enough[at]:
                        break
        if least > value:
            break
        v, (totals, gram, _), value = points[at], found, least
    return v


def descend(evaluate: Callable, target: list[float], steps: int = STEPS,
            values: Callable | None = None) -> tuple[list[list[float]], list[float]]:
    """(moves, totals) of the fitted rates. ``evaluate(moves, v)`` gives, for
    the rates after ``moves`` and the move ``v``, the totals, the Gram matrix of
    the rows above the bound and the rows' part of the function of ``_step``;
    ``values(moves, vs)`` gives that part alone for each of ``vs``, at once."""
    k, moves, seen, before = len(target), [], math.inf, []
    scale = max(1e-300, sum(abs(t) for t in target)) ** 2
    if values is None:
        def values(moves: list[list[float]], vs: list[list[float]]) -> list[float]:
            return [evaluate(moves, v)[2] for v in vs]
    while True:
        found = evaluate(moves, [0.0] * k)
        totals = found[0]
        loss = sum((q - t) ** 2 for q, t in zip(totals, target, strict=True)) / scale
        if loss > seen:
            moves.pop()
            return moves, before
        if loss <= CLOSE or len(moves) == steps or seen - loss <= STILL * max(1.0, loss):
            return moves, totals
        seen, before = loss, totals
        moves.append(_step(evaluate, values, moves, target, found))


def _rate(start: float, moves: list[list[float]], steps: list[Column], min_rate: float) -> Column:
    """A row's rate after the moves so far: step, then project."""
    rate = F.lit(start)
    for move in moves:
        step = reduce(lambda a, b: a + b, [F.lit(m) * p for m, p in zip(move, steps, strict=True)])
        rate = F.greatest(F.lit(min_rate), rate - step)
    return rate


def whole_sums(rows: DataFrame, cols: list[Column]) -> list[float | None]:
    """Sums in whole ``UNIT``-ths, the same in any order of the rows; None where
    a sum is too large for a long."""
    return [None if x is None else float(x) / UNIT for x in
            rows.agg(*[F.try_sum(F.rint(c * UNIT).cast("long")) for c in cols]).first()]     # one row


def expected(soft: DataFrame, k: int) -> list[float]:
    """Expected tokens of each of ``k`` domains in ``soft`` (tokens, p0, p1, ...)."""
    return [x or 0.0 for x in whole_sums(soft, [F.col("tokens") * F.col(f"p{d}") for d in range(k)])]


def fit_rates(soft: DataFrame, target: list[float], min_rate: float = 0.0,
              steps: int = STEPS, current: list[float] | None = None) -> tuple[Column, list[float]]:
    """(rate, totals): the rate column over ``soft`` (tokens, p0, p1, ...) whose
    expected domain totals are closest to ``target`` in squared distance, and
    those totals. ``current``: the ``expected`` totals, if known."""
    k, start = len(target), max(1.0, min_rate)
    posts = [F.col(f"p{d}") for d in range(k)]
    pairs = [(d, e) for d in range(k) for e in range(d, k)]
    current = expected(soft, k) if current is None else current
    total = sum(current)
    if total <= 0:
        return F.lit(start), current
    # a row's moves count by the share of its domains, so rare domains move as fast as large ones
    metric = reduce(lambda a, b: a + b, [F.lit(max(c / total, 1e-9)) * p for c, p in zip(current, posts, strict=True)])
    scaled = [p / metric for p in posts]

    def moved(moves: list[list[float]], vs: list[list[float]]) -> DataFrame:
        """A column ``x0``, ``x1``, ... per ``vs``: the rates after ``moves`` and it, not yet projected."""
        rows = soft.select("tokens", *posts, metric.alias("s"), _rate(start, moves, scaled, min_rate).alias("a"))
        return rows.withColumns({f"x{i}": F.col("a") - reduce(lambda x, y: x + y, [
            F.lit(m) * p for m, p in zip(v, posts, strict=True)]) / F.col("s") for i, v in enumerate(vs)})

    def projected(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(min_rate)), F.lit(LARGEST))

    def parts(x: Column) -> list[Column]:
        """The row's part of the function of ``_step``, and whether its rate is too large."""
        r = projected(x)
        part = F.when(x > min_rate, r * r / 2).otherwise(F.lit(min_rate) * x - min_rate * min_rate / 2)
        return [F.col("tokens") * F.col("s") * part, F.when(x >= LARGEST, 1.0).otherwise(0.0)]

    def evaluate(moves: list[list[float]], v: list[float]) -> tuple[list[float], list[list[float]], float]:
        rows = moved(moves, [v]).withColumns({"r": projected(F.col("x0")), "free": F.col("x0") > min_rate})
        weight = F.when(F.col("free"), F.col("tokens") / F.col("s")).otherwise(0.0)
        got = whole_sums(rows, [F.col("r") * F.col("tokens") * p for p in posts] + [
            weight * posts[d] * posts[e] for d, e in pairs] + parts(F.col("x0")))
        if any(x is None for x in got) or got[-1] > 0:
            return [math.inf] * k, [[0.0] * k] * k, math.inf
        gram = [[0.0] * k for _ in range(k)]
        for (d, e), x in zip(pairs, got[k:], strict=False):
            gram[d][e] = gram[e][d] = x / total
        return [x / total for x in got[:k]], gram, got[-2] / total

    def values(moves: list[list[float]], vs: list[list[float]]) -> list[float]:
        got = whole_sums(moved(moves, vs), [c for i in range(len(vs)) for c in parts(F.col(f"x{i}"))])
        return [math.inf if x is None or large is None or large > 0 else x / total
                for x, large in zip(got[::2], got[1::2], strict=True)]

    moves, totals = descend(evaluate, [t / total for t in target], steps, values)
    return _rate(start, moves, scaled, min_rate), [x * total for x in totals]


def extra_copies(rows: DataFrame) -> DataFrame:
    """``_uid`` of the rows (_uid, domain, tokens, frac, tie columns _h, _id,
    _t) that get one copy more, by the running total of their fractions."""
    order = ["domain", "tokens", "_h", "_id", "_t"]
    placed = materialize(rows.filter("frac > 0").repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_at", F.monotonically_increasing_id())
                         .withColumn("_part", F.shiftright("_at", 33)), "fractions")
    sums = placed.groupBy("_part", "domain").agg(F.sum("frac").alias("_sum"))     # a few rows per partition
    before = F.sum("_sum").over(Window.partitionBy("domain").orderBy("_part")) - F.col("_sum")
    offsets = sums.select("_part", "domain", before.alias("_before"))
    within = Window.partitionBy("_part", "domain").orderBy("_at")
    upto = F.sum("frac").over(within) + F.col("_before") + WHOLE // 2
    return (placed.join(offsets, ["_part", "domain"]).withColumn("_upto", upto)
            .filter(F.expr(f"_upto div {WHOLE} > (_upto - frac) div {WHOLE}")).select("_uid"))


def targets(current: list[float], domains: list[str], weights: dict[str, float] | None, temperature: float | None,
            keep_all: bool) -> list[float]:
    """Target token totals: the given weights, or shares ** temperature, or
    equal ones; scaled to the current total, or with ``keep_all`` so far that
    no domain has to shrink."""
    total = sum(current)
    if weights is not None:
        want = [max(0.0, weights.get(d, 0.0)) for d in domains]
    elif temperature is not None:
        want = [(c / total) ** temperature if total and c else 0.0 for c in current]
    else:
        want = [1.0 if c else 0.0 for c in current]
    whole = sum(want) or 1.0
    share = [w / whole for w in want]
    if keep_all:
        total = max([c / s for c, s in zip(current, share, strict=True) if s > 0], default=total)
    return [total * s for s in share]


def mix(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        domain_col: str = "domain", weights: dict[str, float] | None = None, temperature: float | None = None,
        min_rate: float = 0.0, keep_all: bool = False) -> DataFrame:
    """``_row`` (the input row), tokens, domain (the likeliest), posterior,
    rate and copies for every document."""
    model = fit(docs, labelled, id_col, text_col, domain_col)
    k = len(model.domains)
    rows = with_uid(packed(docs)).withColumn("_w", _words(F.col(f"_row.`{text_col}`")))
    rows = rows.select("_row", "_uid", F.size("_w").cast("double").alias("tokens"), model.known(F.col("_w")).alias("_known"))
    rows = rows.select("_row", "_uid", "tokens", *[h.alias(f"h{d}") for d, h in enumerate(model.hits(F.col("_known")))])
    posts = model.posteriors([F.col(f"h{d}") for d in range(k)])
    rows = materialize(rows.select("_row", "_uid", "tokens", *[p.alias(f"p{d}") for d, p in enumerate(posts)]), "soft")
    current = expected(rows, k)
    rate, _ = fit_rates(rows, targets(current, model.domains, weights, temperature, keep_all), min_rate, current=current)
    most = F.greatest(*[F.col(f"p{d}") for d in range(k)]) if k > 1 else F.col("p0")
    name = reduce(lambda rest, d: F.when(F.col(f"p{d}") == F.col("posterior"), model.domains[d]).otherwise(rest),
                  range(k - 2, -1, -1), F.lit(model.domains[-1]))
    rated = rows.withColumns({"posterior": most, "rate": rate}).withColumn("domain", name)
    row_id = F.col(f"_row.`{id_col}`")
    more = extra_copies(rated.select(
        "_uid", "domain", "tokens", F.floor((F.col("rate") - F.floor("rate")) * WHOLE).cast("long").alias("frac"),
        F.xxhash64(row_id).alias("_h"), row_id.cast("string").alias("_id"),
        F.xxhash64(F.col(f"_row.`{text_col}`")).alias("_t")))
    return (flagged(rated, more, "_more")
            .withColumn("copies", (F.floor("rate") + F.col("_more").cast("int")).cast("long"))
            .select("_row", F.col("tokens").cast("long").alias("tokens"), "domain", "posterior", "rate", "copies"))


def mixed(docs: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as many times as its copies say."""
    rows = mix(docs, labelled, **options).filter("copies > 0")
    return rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")
