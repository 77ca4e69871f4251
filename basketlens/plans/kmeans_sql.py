"""K-means in recursive SQL: the same starts, rounds and choice of restart as the operator, to compare with it."""

from __future__ import annotations

from collections.abc import Sequence

#: The scores as z-scores with the population deviation, counts and money as logarithms.
SCALED_SCORES = """SELECT customer_id AS id, (recency - avg(recency) OVER ()) / stddev_pop(recency) OVER () AS x0,
  (f - avg(f) OVER ()) / stddev_pop(f) OVER () AS x1, (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS x2
FROM (SELECT customer_id, recency, ln(1 + frequency) AS f, ln(1 + monetary) AS m FROM rfm)"""


def fitted(points: str, width: int, ks: Sequence[int], restarts: int = 10) -> str:
    """CTEs up to ``centres`` (k, c, x0 ...), ``costs`` (k, cost) and ``assigned`` (k, id, c, x0 ...), from points (id, x0 ...)."""
    xs = [f"x{i}" for i in range(width)]
    distance = " + ".join(f"(p.{x} - l.{x}) * (p.{x} - l.{x})" for x in xs)
    coordinates, means = ", ".join(xs), ", ".join(f"avg({x}) AS {x}" for x in xs)
    any_point = ", ".join(f"any_value(p.{x}) AS {x}" for x in xs)
    moved = " + ".join(f"(coalesce(q.{x}, l.{x}) - l.{x}) ** 2" for x in xs)
    new = ", ".join(f"coalesce(q.{x}, l.{x}) AS {x}" for x in xs)
    return f"""RECURSIVE points AS MATERIALIZED ({points}),
picks AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY md5(concat_ws('|', 42, r, id)), id) AS place, {coordinates}
          FROM points, (SELECT unnest(range({restarts})) AS r)),
rounds AS (
  SELECT 0 AS step, k, r, place - 1 AS c, {coordinates}, CAST(1e9 AS DOUBLE) AS moved FROM picks, (SELECT unnest({list(ks)}) AS k) WHERE place <= k
  UNION ALL
  SELECT step + 1, k, r, c, {coordinates}, sum(m) OVER (PARTITION BY k, r) FROM (
    SELECT l.step, l.k, l.r, l.c, {new}, {moved} AS m FROM rounds l LEFT JOIN (
      SELECT k, r, c, {means} FROM (
        SELECT k, r, id, {any_point}, min({{'d': round({distance}, 9), 'c': c}}).c AS c FROM rounds l, points p WHERE moved > 1e-4 GROUP BY k, r, id
      ) GROUP BY k, r, c) q USING (k, r, c)
    WHERE l.moved > 1e-4 AND l.step < 300)),
ends AS (SELECT k, r, c, {coordinates} FROM rounds QUALIFY step = max(step) OVER (PARTITION BY k, r)),
run_costs AS (SELECT k, r, sum(d) AS cost FROM (SELECT k, r, id, min({distance}) AS d FROM ends l, points p GROUP BY k, r, id) GROUP BY k, r),
costs AS (SELECT k, r, cost FROM run_costs QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(cost, 9), r) = 1),
centres AS (SELECT ends.* FROM ends SEMI JOIN costs USING (k, r)),
assigned AS (SELECT k, id, {any_point}, min({{'d': round({distance}, 9), 'c': c}}).c AS c FROM centres l, points p GROUP BY k, id)"""


def silhouettes(width: int) -> str:
    """A CTE ``silhouettes`` (k, s) from ``assigned``, over all pairs of point and cluster."""
    xs = [f"x{i}" for i in range(width)]
    square = " + ".join(f"{x} * {x}" for x in xs)
    means = ", ".join(f"avg({x}) AS m{i}" for i, x in enumerate(xs))
    away = " + ".join(f"a.{x} * a.{x}" for x in xs) + " + q - 2 * (" + " + ".join(f"a.{x} * m{i}" for i, x in enumerate(xs)) + ")"
    return f"""sizes_of AS (SELECT k, c, count(*) AS n, avg({square}) AS q, {means} FROM assigned GROUP BY k, c),
away AS (SELECT k, id, any_value(CASE WHEN s.c = a.c THEN n END) AS n, max(CASE WHEN s.c = a.c THEN ({away}) * n / nullif(n - 1, 0) END) AS a,
                min(CASE WHEN s.c <> a.c THEN {away} END) AS b FROM assigned a JOIN sizes_of s USING (k) GROUP BY k, id),
silhouettes AS (SELECT k, avg(CASE WHEN n = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS s FROM away GROUP BY k)"""
