"""K-means for several numbers of clusters and several starts at once.

All (k, restart) pairs advance together: a round is one pass over the points, in which every task sums the points nearest to
each centre of each pair, and one aggregate adds the sums up. The centres, a few hundred rows of numbers, are all that
travels. Rounds read the points in blocks of bytes: row by row, their way to numpy costs a task more than the
distances do. Starts are the points with the least hash of (seed, restart, id), so a fit depends neither on partitions nor on
retries. A pair rests when the squared moves of its centres sum to no more than ``TOLERANCE``, or after ``ROUNDS``.

Defined results: a centre without points stays where it is; of centres whose distances agree to nine decimals the one of least number is nearest; with
fewer points than k all points are starts; of restarts whose costs agree to nine decimals the first counts; no points give no centres.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.session import discard, settle

SEED, RESTARTS, ROUNDS, TOLERANCE = 42, 10, 300, 1e-4
#: Decimals in which distances and costs are compared, of data with about unit variance: ties are ties in any order of sums.
DIGITS = 9
#: Points of a block at most: a task works out their distances at a time.
AT_ONCE = 10_000
#: Bytes of blocks that a task reads at a time.
ROW_GROUP = 16 * 2**20


def _least_of_tasks(points: DataFrame, most: int, restarts: int, seed: int) -> DataFrame:
    """The ``most`` points of least (hash, id) of each restart in each task, all restarts in one pass over the points."""
    kept = points.select("id", "x", F.lit(0).alias("restart"), F.lit("").alias("key"))

    def rank(x: list[float | None] | None) -> list[tuple]:  # sorts arrays as Spark does: null first, NaN last
        return [] if x is None else [(0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v) for v in x]

    def hashed(start: bytes, words: list[bytes | None]) -> list[bytes]:
        # a point without an id is hashed without a word, as concat_ws leaves it out
        bare, begun = (hashlib.md5(begin, usedforsecurity=False) for begin in (start, start + b"|"))
        keys = []
        for word in words:
            key = bare if word is None else begun.copy()
            if word:
                key.update(word)
            keys.append(key.digest())
        return keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[list[tuple]] = [[] for _ in range(restarts)]
        schema = None
        for batch in batches:
            schema = batch.schema
            words = [None if word is None else word.encode() for word in batch.column("word").to_pylist()]
            for restart, old in enumerate(least):
                keys = hashed(f"{seed}|{restart}".encode(), words)
                bound = old[-1][0] if len(old) == most else sorted(keys)[most - 1] if len(keys) >= most else b"\xff" * 16
                at = [i for i, key in enumerate(keys) if key <= bound]
                if at:
                    rows = batch.take(pa.array(at))
                    old += [(keys[i], rank(x), rows.slice(j, 1)) for j, (i, x) in enumerate(zip(at, rows.column("x").to_pylist()))]
                    old.sort(key=lambda row: row[:2])
                    del old[most:]
        for restart, rows in enumerate(least):
            for key, _, row in rows:
                columns = [row.column("id"), row.column("x"), pa.array([restart], pa.int32()), pa.array([key.hex()])]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([schema.field("id"), schema.field("x"), ("restart", pa.int32()), ("key", pa.string())]))

    return points.select("id", "x", F.col("id").cast("string").alias("word")).mapInArrow(run, kept.schema)


def drawn(points: DataFrame, most: int, restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """The ``most`` points of least (hash, id) of each restart; of equal ids the least point comes first."""
    # the least of each task, then the least of those: no task sorts the points of a restart
    few = settle(_least_of_tasks(points, most, restarts, seed))
    return reduce(DataFrame.unionByName, (few.where(F.col("restart") == r).orderBy("key", "id", "x").limit(most) for r in range(restarts)))


def starts(points: DataFrame, most: int, restarts: int = RESTARTS, seed: int = SEED) -> dict[int, np.ndarray]:
    """Up to ``most`` points in hash order for each restart. ``points`` has ``id`` and ``x``, an array of doubles."""
    rows = drawn(points, most, restarts, seed).orderBy("restart", "key", "id", "x").collect()  # restarts x most rows
    return {r: np.array([row.x for row in rows if row.restart == r], float) for r in {row.restart for row in rows}}


def fit(points: DataFrame, ks: Sequence[int], restarts: int = RESTARTS, seed: int = SEED) -> dict[int, tuple[np.ndarray, float]]:
    """The cheapest centres of each k, and their cost (squared distances of all points to their centres).

    ``points`` is read twice and should be settled; the rounds read blocks of its numbers.
    """
    first = starts(points, max(ks), restarts, seed)
    if not first:
        return {}
    blocks = settle(_blocks(points, next(iter(first.values())).shape[1]), **{"parquet.block.size": str(ROW_GROUP)})
    centres = {(k, r): picks[:k] for k in ks for r, picks in sorted(first.items())}
    active = dict(centres)
    for _ in range(ROUNDS):
        if not active:
            break
        sums = _round(blocks, active)
        moved = {}
        for pair, old in active.items():
            new = old.copy()
            for c, (n, total, _) in sums.get(pair, {}).items():
                new[c] = total / n
            centres[pair] = new
            if ((new - old) ** 2).sum() > TOLERANCE:
                moved[pair] = new
        active = moved
    costs = {pair: sum(cost for *_, cost in found.values()) for pair, found in _round(blocks, centres, last=True).items()}
    discard(blocks)
    best = {k: min((pair for pair in costs if pair[0] == k), key=lambda pair: (round(costs[pair], DIGITS), pair[1])) for k in ks}
    return {k: (centres[pair], costs[pair]) for k, pair in best.items()}


def _blocks(points: DataFrame, width: int) -> DataFrame:
    """The numbers of up to ``AT_ONCE`` points in a row, coordinate by coordinate; null is NaN."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(every: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(every), AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array([every[a: a + AT_ONCE].T.tobytes()], pa.binary())], ["block"])

        kept = []
        for batch in batches:  # of any size: the text operators set small ones for the session
            kept.append(np.asarray(batch.column(0).flatten(), float).reshape(-1, width))
            if sum(map(len, kept)) >= AT_ONCE:
                yield from cut(np.concatenate(kept))
                kept = []
        if kept:
            yield from cut(np.concatenate(kept))

    return points.select("x").mapInArrow(run, "block binary")


def _round(blocks: DataFrame, centres: dict[tuple[int, int], np.ndarray], last: bool = False) -> dict[tuple[int, int], dict[int, tuple]]:
    """For each centre of each pair: its points, the sum of them and (only the ``last`` time, else 0) of their squared distances."""
    pairs = list(centres.items())
    width = pairs[0][1].shape[1]
    names = [f"s{i}" for i in range(width)]
    ddl = "pair int, centre int, n bigint, cost double, " + ", ".join(f"{name} double" for name in names)

    def nearest_rows(distance: np.ndarray) -> np.ndarray:
        rounded = distance.round(DIGITS)
        least, number = rounded[0].copy(), np.zeros(distance.shape[1], np.intp)
        for c, row in enumerate(rounded[1:], 1):
            number[row < least] = c
            np.minimum(least, row, out=least)
        return rounded.argmin(0) if np.isnan(least.sum()) else number  # argmin takes the first NaN, at several times the time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), width + 2)) for _, c in pairs]
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_buffer(), float).reshape(width, -1)
                for total, (_, c) in zip(sums, pairs):
                    distance = sum((x[i] - c[:, i, None]) ** 2 for i in range(width))
                    nearest = nearest_rows(distance)
                    total[:, 0] += np.bincount(nearest, minlength=len(c))
                    if last:
                        total[:, 1] += np.bincount(nearest, distance[nearest, np.arange(len(nearest))], len(c))
                    for i in range(width):
                        total[:, 2 + i] += np.bincount(nearest, x[i], len(c))
        rows = [(p, c, int(row[0]), *row[1:].tolist()) for p, total in enumerate(sums) for c, row in enumerate(total) if row[0]]
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(("pair", "centre", "n", "cost", *names), row)) for row in rows], schema=pa.schema(
                [("pair", pa.int32()), ("centre", pa.int32()), ("n", pa.int64())] + [(c, pa.float64()) for c in ("cost", *names)]))

    added = blocks.mapInArrow(run, ddl).groupBy("pair", "centre").agg(*(F.sum(c).alias(c) for c in ("n", "cost", *names)))
    out: dict[tuple[int, int], dict[int, tuple]] = {}
    for row in added.collect():  # a row per centre
        out.setdefault(pairs[row.pair][0], {})[row.centre] = row.n, np.array([row[name] for name in names]), row.cost
    return out


def nearest(x: Column, centres: np.ndarray) -> Column:
    """The number of the nearest centre, the least of several."""
    def marked(number: int, centre: list[float]) -> Column:
        squares = ((x[i] - v) * (x[i] - v) for i, v in enumerate(centre))
        return F.struct(F.round(sum(squares, F.lit(0.0)), DIGITS).alias("d"), F.lit(number).alias("c"))

    # written out, so that it is compiled; functions over arrays are not
    return F.array_min(F.array(*(marked(i, centre) for i, centre in enumerate(centres.tolist()))))["c"]


def silhouettes(assigned: DataFrame) -> DataFrame:
    """Mean silhouette with squared Euclidean distances of each ``k``, from rows of (k, cluster, x); linear in the rows.

    The mean squared distance of a point to a cluster follows from the cluster's size, mean and mean square. A point alone in
    its cluster counts 0, as does one whose distances are all 0; a single cluster gives null.
    """
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    long = assigned.select("k", "cluster", F.posexplode("x").alias("i", "v"))
    means = long.groupBy("k", "cluster", "i").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"), F.avg(F.col("v") * F.col("v")).alias("q"))
    clusters = means.groupBy("k", "cluster").agg(
        F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"), F.sum("q").alias("square"))
    table = clusters.groupBy("k").agg(F.collect_list(F.struct("cluster", "n", "mean", "square")).alias("clusters"))  # k entries
    away = F.transform("clusters", lambda c: F.struct(
        (c["cluster"] == F.col("cluster")).alias("own"), c["n"].alias("n"),
        (F.col("_square") + c["square"] - 2 * F.aggregate(F.zip_with("x", c["mean"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).alias("d")))
    placed = assigned.withColumn("_square", square).join(F.broadcast(table), "k").withColumn("_away", away)
    own = F.element_at(F.filter("_away", lambda c: c["own"]), 1)
    a = own["d"] * own["n"] / F.nullif(own["n"] - 1, F.lit(0))
    b = F.array_min(F.transform(F.filter("_away", lambda c: ~c["own"]), lambda c: c["d"]))
    value = F.when(own["n"] == 1, F.lit(0.0)).otherwise(F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0)))
    return placed.groupBy("k").agg(F.avg(F.when(F.size("clusters") > 1, value)).alias("silhouette_sq_euclidean"))


def settled_points(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The points, settled in a file per core: a few small files would leave every round to as few tasks."""
    points = df.select(F.col(key).alias("id"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    return settle(points.repartition(df.sparkSession.sparkContext.defaultParallelism))
