"""Bayesian knowledge tracing: a hidden known-or-not state of each order domain and skill.

The recurrence is a fold over the ordered attempts of a domain and skill. A fit carries the
derivatives along: tasks fold their sequences under every point that their skills' searches
are at, and add up likelihoods, gradients and products of gradients by skill and point. So
one aggregation serves a step of all searches, and no skill, however common, comes to one
task. Where each search goes next is worked out in tasks too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import DOMAIN
from ..functions.lineage import cut, cut_round
from ..operators.units import units

NAMES = ("initial", "learning", "slip", "guess", "forgetting")
#: What a skill has that too few attempts show, and bounds of the others.
DEFAULTS = (0.2, 0.1, 0.1, 0.2, 0.0)
LOWER, UPPER = (0.001, 0.0001, 0.001, 0.001, 0.0), (0.999, 0.6, 0.4, 0.4, 0.3)
MINIMUM = 30
#: Where every search of a skill that is fitted begins first; others begin at random.
STARTS = 3
FIRST = (0.2, 0.1, 0.1, 0.2, 0.02)
#: Steps that one pass tries at once along the direction of the updated curvature, and along that of the products of gradients.
STEPS = ((1.0, 0.3, 2.0), (1.0, 0.25, 1 / 32))
#: A search ends where an attempt's likelihood would gain less than this from a step of the gradient, or a pass gains this share less.
LEVEL, GAIN = 1e-6, 1e-9
PASSES = 60
EDGE = 1e-9
#: Cells (sequences times points) that a task folds at a time, and searches whose points are broadcast; more are joined by their skill.
CELLS, BROADCAST = 20_000, 50_000
_UPPER_TRIANGLE = np.triu_indices(len(NAMES))


def step(known: float, correct: bool, initial: float, learning: float, slip: float, guess: float, forgetting: float = 0.0) -> tuple[float, float, float]:
    """Prediction before an answer, belief after it, and belief at the next opportunity."""
    p = known * (1 - slip) + (1 - known) * guess
    after = known * (1 - slip) / p if correct else known * slip / (1 - p)
    return p, after, after * (1 - forgetting) + (1 - after) * learning


def sequences(attempts: DataFrame, primary: bool = True) -> DataFrame:
    """The ordered attempts of each domain and skill: ``steps`` of ``unit``, ``hit`` and ``event_id``. An attempt counts for its first skill alone, or for all unless ``primary``."""
    rows = units(attempts).select(*DOMAIN, "pos", "unit", "correct", "event_id", F.explode(F.slice("skills", 1, 1) if primary else F.col("skills")).alias("skill"))
    return rows.groupBy(*DOMAIN, "skill").agg(F.array_sort(F.collect_list(F.struct("pos", "unit", F.col("correct").alias("hit"), "event_id"))).alias("steps"))


_FOLD = """aggregate(steps,
  named_struct('k', initial, 'held', initial, 'unit', -1L, 'll', 0D, 'out', cast(array() as array<struct<event_id:string,p:double>>)),
  (a, x) -> named_struct(
    'k', IF(x.hit,
        (a.k*(1-slip)/(a.k*(1-slip)+(1-a.k)*guess))*(1-forgetting) + (1-a.k*(1-slip)/(a.k*(1-slip)+(1-a.k)*guess))*learning,
        (a.k*slip/(1-(a.k*(1-slip)+(1-a.k)*guess)))*(1-forgetting) + (1-a.k*slip/(1-(a.k*(1-slip)+(1-a.k)*guess)))*learning),
    'held', IF(x.unit = a.unit, a.held, a.k),
    'unit', cast(x.unit as bigint),
    'll', a.ll + ln(IF(x.hit, 0D, 1D) + IF(x.hit, 1D, -1D) * (IF(x.unit = a.unit, a.held, a.k)*(1-slip)+(1-IF(x.unit = a.unit, a.held, a.k))*guess)),
    'out', {out}))"""
_KEEP = "concat(a.out, array(named_struct('event_id', x.event_id, 'p', IF(x.unit = a.unit, a.held, a.k)*(1-slip)+(1-IF(x.unit = a.unit, a.held, a.k))*guess)))"


def likelihoods(seqs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The summed log-likelihood of each skill's attempts under each of its candidates."""
    rows = seqs.join(candidates, "skill").withColumn("ll", F.expr(_FOLD.format(out="a.out") + ".ll"))
    return rows.groupBy("skill", "candidate").agg(F.sum("ll").alias("ll"))


def folded(hits: list[np.ndarray], fresh: list[np.ndarray], points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods of sequences (rows) under their points (rows, points, parameters), and their gradients.

    ``fresh`` marks the first attempts of units, within which predictions don't change.
    """
    order = np.argsort([-len(h) for h in hits], kind="stable")
    sizes = np.array([len(hits[i]) for i in order])
    table = np.zeros((2, len(order), sizes.max(initial=0)), bool)
    for row, i in enumerate(order):
        table[0, row, : sizes[row]], table[1, row, : sizes[row]] = hits[i], fresh[i]
    start, learning, slip, guess, forgetting = np.moveaxis(points[order], 2, 0)
    n, m = start.shape
    k, dk = start.copy(), np.zeros((n, m, 5))
    dk[:, :, 0] = 1
    held, dheld = k.copy(), dk.copy()
    ll, gradient = np.zeros((n, m)), np.zeros((n, m, 5))
    rise = 1 - slip - guess

    def chance(of: np.ndarray, slope: np.ndarray, own: slice) -> tuple[np.ndarray, np.ndarray]:
        """The chance of a right answer in a state, and its derivatives."""
        p = np.clip(guess[own] + of * rise[own], EDGE, 1 - EDGE)
        dp = slope * rise[own][..., None]
        dp[..., 2] -= of
        dp[..., 3] += 1 - of
        return p, dp

    for t in range(table.shape[2]):
        live = slice(0, int(np.count_nonzero(sizes > t)))
        right, opens = table[0, live, t][:, None], table[1, live, t]
        held[live][opens], dheld[live][opens] = k[live][opens], dk[live][opens]
        sign = np.where(right, 1.0, -1.0)
        p, dp = chance(held[live], dheld[live], live)
        seen = np.where(right, p, 1 - p)
        ll[live] += np.log(seen)
        gradient[live] += (sign / seen)[..., None] * dp
        now, dnow = chance(k[live], dk[live], live)
        seen = np.where(right, now, 1 - now)
        keeps = np.where(right, 1 - slip[live], slip[live])
        after = np.clip(k[live] * keeps / seen, 0, 1)
        dafter = dk[live] * keeps[..., None]
        dafter[..., 2] -= sign * k[live]
        dafter = (dafter - (after * sign)[..., None] * dnow) / seen[..., None]
        dafter *= (1 - forgetting[live] - learning[live])[..., None]
        dafter[..., 1] += 1 - after
        dafter[..., 4] -= after
        k[live] = np.clip(after * (1 - forgetting[live]) + (1 - after) * learning[live], EDGE, 1 - EDGE)
        dk[live] = dafter
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return ll[back], gradient[back]


def fit_sequences(attempts: DataFrame, primary: bool = True) -> DataFrame:
    """What a fit reads of each domain and skill: ``hits`` in order, and ``fresh``, whether they open a unit."""
    opens = F.transform("steps", lambda x, i: (i == 0) | (x["unit"] != F.get(F.col("steps"), i - 1)["unit"]))
    return sequences(attempts, primary).select("skill", F.transform("steps", lambda x: x["hit"]).alias("hits"), opens.alias("fresh"))


def evaluated(seqs: DataFrame, searches: DataFrame, few: bool = True) -> DataFrame:
    """For each search (``skill``, ``start``, ``points``) and point (``step``): ``sums``, the summed log-likelihood, gradient and upper triangle of the sequences' products of gradients.

    Tasks add up what they read of a search before it is shuffled. ``few`` searches are broadcast.
    """
    width = 1 + len(NAMES) + len(_UPPER_TRIANGLE[0])
    rows = seqs.join(F.broadcast(searches) if few else searches, "skill")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array(batch.column("points").to_pylist()).reshape(batch.num_rows, -1, len(NAMES))
            sizes = batch.column("hits").value_lengths().to_numpy()
            bits = {k: np.split(batch.column(k).flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1]) for k in ("hits", "fresh")}
            names, owner = np.unique(list(zip(batch.column("skill").to_pylist(), batch.column("start").to_pylist(), strict=True)), axis=0, return_inverse=True)
            sums = np.zeros((len(names), points.shape[1], width))
            order = np.argsort(sizes)  # of like lengths together
            for part in np.array_split(order, -(-batch.num_rows * points.shape[1] // CELLS)):
                ll, gradient = folded([bits["hits"][i] for i in part], [bits["fresh"][i] for i in part], points[part])
                products = gradient[..., _UPPER_TRIANGLE[0]] * gradient[..., _UPPER_TRIANGLE[1]]
                np.add.at(sums, owner[part], np.concatenate([ll[..., None], gradient, products], axis=2))
            flat = sums.reshape(-1, width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names[:, 0], points.shape[1])), pa.array(np.repeat(names[:, 1].astype(int), points.shape[1]), pa.int32()), pa.array(np.tile(np.arange(points.shape[1]), len(names)), pa.int32()), *[pa.array(flat[:, j]) for j in range(width)]],
                names=["skill", "start", "step", *[f"s{j}" for j in range(width)]],
            )

    found = rows.select("skill", "start", "points", "hits", "fresh").mapInArrow(run, "skill string, start int, step int, " + ", ".join(f"s{j} double" for j in range(width)))
    found = found.groupBy("skill", "start", "step").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(width)])
    return found.select("skill", "start", "step", F.array(*[f"s{j}" for j in range(width)]).alias("sums"))


def direction(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, damping: float, high: np.ndarray) -> np.ndarray:
    """Where to go uphill from x under a curvature; what is at a bound and would leave it stays there."""
    low, out = np.array(LOWER), np.zeros(len(x))
    free = ~((x <= low) & (slope <= 0) | (x >= high) & (slope >= 0))
    while free.any():
        own = curve[np.ix_(free, free)]
        out[:] = 0
        out[free] = np.linalg.solve(own + np.diag(damping * np.maximum(np.diag(own), 1e-12) + 1e-12), slope[free])
        leaves = free & ((x <= low) & (out < 0) | (x >= high) & (out > 0))
        if not leaves.any():
            break
        free &= ~leaves
    return out if free.any() else np.zeros(len(x))


def bent(curve: np.ndarray, step_: np.ndarray, change: np.ndarray) -> np.ndarray:
    """A curvature that also explains how the slope changed over a step, damped so that it stays one of a maximum."""
    along = curve @ step_
    size, told = step_ @ along, step_ @ change
    if size <= 1e-300:
        return curve
    share = 1.0 if told >= 0.2 * size else 0.8 * size / (size - told)
    change = share * change + (1 - share) * along
    return curve - np.outer(along, along) / size + np.outer(change, change) / (step_ @ change)


def moved(search: dict, sums: list[list[float]], high: np.ndarray) -> dict:
    """A search after a pass: at the best of its points if that gains, more damped if not, and the points of its next pass.

    It ends at a level place, after a gain too small to count, or where no step gains at all.
    """
    wide = len(NAMES)
    x, value, damping, done = np.array(search["x"]), search["value"], search["damping"], False
    best = max(range(len(sums)), key=lambda k: (sums[k][0], -k))
    gains = value is None or sums[best][0] > value
    told = sums[best][1:] if gains else search["slopes"]
    slope, products = np.array(told[:wide]), np.zeros((wide, wide))
    products[_UPPER_TRIANGLE] = told[wide:]
    products += np.triu(products, 1).T
    if value is None:
        curve = products + np.eye(wide) * 1e-6 * max(1.0, np.trace(products))
        value = sums[best][0]
    elif gains:
        curve = bent(np.array(search["curve"]).reshape(wide, wide), np.array(search["points"][best]) - x, np.array(search["slopes"][:wide]) - slope)
        done = sums[best][0] - value <= GAIN * abs(value)
        x, value, damping = np.array(search["points"][best]), sums[best][0], max(damping / 8, 1e-6)
    else:
        damping *= 16
        curve = products if damping > 1e-2 else np.array(search["curve"]).reshape(wide, wide)
        done = damping > 1e5
    level = done and gains or np.abs(np.clip(x + slope / search["n"], LOWER, high) - x).max() < LEVEL
    points = [np.clip(x + t * direction(x, slope, c, damping, high), LOWER, high).tolist() for c, ts in zip((curve, products), STEPS, strict=True) for t in ts]
    return search | {"x": x.tolist(), "value": value, "slopes": list(told), "curve": curve.ravel().tolist(), "damping": damping, "points": points, "level": bool(level), "open": not (level or done), "passes": search["passes"] + 1}


_SEARCH = "skill string, start int, n long, x array<double>, value double, slopes array<double>, curve array<double>, damping double, points array<array<double>>, level boolean, open boolean, passes int"


def stepped(searches: DataFrame, sums: DataFrame, forgetting: bool) -> DataFrame:
    """Searches after a pass; see :func:`moved`."""
    high = np.array(UPPER) * np.array([1, 1, 1, 1, float(forgetting)])
    each = sums.groupBy("skill", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "sums"))), lambda x: x["sums"]).alias("sums"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [moved(r, r.pop("sums"), high) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([batch.schema.field(name) for name in batch.schema.names if name != "sums"]))

    return searches.join(each, ["skill", "start"]).mapInArrow(run, _SEARCH)


def begun(skills: DataFrame, starts: int, forgetting: bool, seed: int) -> DataFrame:
    """The searches of skills (``skill``, ``n``): the first from FIRST, the others from hashes of the seed, the skill and their number."""
    high = [u if forgetting or k < 4 else 0.0 for k, u in enumerate(UPPER)]
    drawn = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.col("skill"), F.col("start"), F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    x = F.array(*[F.when(F.col("start") == 0, F.lit(min(FIRST[k], high[k]))).otherwise(F.lit(LOWER[k]) + (high[k] - LOWER[k]) * drawn(k)) for k in range(len(NAMES))])
    rows = skills.select("skill", "n", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"))
    rows = rows.select("skill", F.col("start").cast("int").alias("start"), F.col("n").cast("long").alias("n"), x.alias("x"))
    nothing = F.lit(None)
    return rows.select("*", nothing.cast("double").alias("value"), nothing.cast("array<double>").alias("slopes"), nothing.cast("array<double>").alias("curve"), F.lit(1e-2).alias("damping"), F.array("x").alias("points"), F.lit(False).alias("level"), F.lit(True).alias("open"), F.lit(0).alias("passes"))


def fit(spark: SparkSession, attempts: DataFrame, forgetting: bool = False, starts: int = STARTS, seed: int = 0, primary: bool = True, passes: int = PASSES) -> DataFrame:
    """A row of parameters for each skill, with ``fitted``, ``converged``, ``n``, ``sequences``, ``log_score``, ``passes`` and ``at_bounds``; those of under MINIMUM attempts or two sequences have the defaults.

    Each skill's searches from ``starts`` places go uphill side by side, all skills in the same
    passes over the sequences; the best of each skill's ends is taken. No attempts: no rows.
    """
    if not 1 <= starts <= 10:
        raise ValueError("a fit starts from 1 to 10 places")
    seqs = cut(fit_sequences(attempts, primary))
    sizes = cut(seqs.groupBy("skill").agg(F.sum(F.size("hits")).alias("n"), F.count("*").alias("sequences")))
    enough = (F.col("n") >= MINIMUM) & (F.col("sequences") >= 2)
    going = cut(begun(sizes.where(enough), starts, forgetting, seed))
    left, ended = going.count(), []
    for k in range(passes):
        if not left:
            break
        going = cut_round(stepped(going, evaluated(seqs, going.select("skill", "start", "points"), left <= BROADCAST), forgetting), k)
        ended.append(going.where("not open"))
        going = going.where("open")
        left = going.count()
    for rows in ended:
        going = going.unionByName(rows)
    best = going.groupBy("skill").agg(F.max_by(F.struct("x", "value", "level", "passes"), F.struct("value", -F.col("start"))).alias("best"), F.max("passes").alias("passes"))
    rows = sizes.join(best, "skill", "left")
    value = [F.coalesce(F.col("best.x")[k], F.lit(float(DEFAULTS[k]))).alias(name) for k, name in enumerate(NAMES)]
    bounds = [F.when(F.least(F.abs(F.col("best.x")[k] - LOWER[k]), F.abs(F.col("best.x")[k] - UPPER[k])) < 1e-3, F.lit(name)) for k, name in enumerate(NAMES) if forgetting or k < 4]
    return rows.select(
        "skill", enough.alias("fitted"), *value, F.coalesce("best.level", F.lit(False)).alias("converged"), "n", "sequences", F.col("best.value").alias("log_score"),
        F.coalesce("passes", F.lit(0)).alias("passes"), F.array_compact(F.array(*bounds)).alias("at_bounds"),
    )


def predict(attempts: DataFrame, parameters: DataFrame, rate: float, primary: bool = True) -> DataFrame:
    """Attempts with ``probability``: that of their first skill before the unit, or the mean over all of them unless ``primary``; ``rate`` without skills."""
    rows = sequences(attempts, primary).join(parameters, "skill", "left")
    rows = rows.select(*DOMAIN, "skill", "steps", *[F.coalesce(F.col(n), F.lit(float(d))).alias(n) for n, d in zip(NAMES, DEFAULTS, strict=True)])
    out = rows.select(*DOMAIN[:2], F.explode(F.expr(_FOLD.format(out=_KEEP) + ".out")).alias("x")).groupBy("source_namespace", "x.event_id").agg(F.avg("x.p").alias("p"))
    return attempts.join(out, ["source_namespace", "event_id"], "left").withColumn("probability", F.coalesce("p", F.lit(rate))).drop("p")


def states(attempts: DataFrame, parameters: DataFrame, primary: bool = True) -> DataFrame:
    """What is believed after all attempts: ``known`` of each order domain and skill that has any."""
    rows = sequences(attempts, primary).join(parameters, "skill", "left")
    rows = rows.select(*DOMAIN, "skill", "steps", *[F.coalesce(F.col(n), F.lit(float(d))).alias(n) for n, d in zip(NAMES, DEFAULTS, strict=True)])
    return rows.select(*DOMAIN, "skill", F.expr(_FOLD.format(out="a.out") + ".k").alias("known"))
