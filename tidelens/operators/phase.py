"""Phase space: grids of bounds, box membership, box transitions, polar partitions, regridding."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.functions import ordering
from tidelens.functions.scalar import ratio
from tidelens.functions.storage import cut_lineage

TWO_PI = 2 * math.pi
Bounds = dict[str, list[float]]


def uniform_bounds(axes: dict[str, tuple[float, float, int]]) -> Bounds:
    """n + 1 evenly spaced bounds per axis (lo, hi, n)."""
    return {a: [lo + (hi - lo) * k / n for k in range(n + 1)] for a, (lo, hi, n) in axes.items()}


def adapted_grid(states: DataFrame, axes: list[str], n: int, spread: float) -> DataFrame:
    """(axis, k, centre, lower, upper): n centres over mean +- spread deviations, bounds half-way, outer bounds open."""
    rows = None
    for a in axes:
        one = states.agg(F.avg(a).alias("m"), F.stddev_pop(a).alias("s")).select(F.lit(a).alias("axis"), (F.col("m") - spread * F.col("s")).alias("lo"), (2 * spread * F.col("s") / (n - 1)).alias("step"))
        rows = one if rows is None else rows.unionByName(one)
    grid = rows.crossJoin(states.sparkSession.range(n).select(F.col("id").alias("k")))
    centre = F.col("lo") + F.col("k") * F.col("step")
    return grid.select("axis", "k", centre.alias("centre"), F.when(F.col("k") == 0, F.lit(-1e127)).otherwise(centre - F.col("step") / 2).alias("lower"), F.when(F.col("k") == n - 1, F.lit(1e127)).otherwise(centre + F.col("step") / 2).alias("upper"))


def bounds_of(grid: DataFrame) -> Bounds:
    """A grid table, a few rows per axis, as bounds."""
    out: Bounds = {}
    for r in sorted(grid.collect(), key=lambda r: (r.axis, r.k)):
        out.setdefault(r.axis, [r.lower]).append(r.upper)
    return out


def axis_index(value: Column, bounds: list[float]) -> Column:
    """Index of the half-open interval [b_k, b_k+1) that holds the value; null outside. By arithmetic on even bounds,
    corrected by the bounds themselves at their neighbours; else by counting bounds."""
    n, step = len(bounds) - 1, (bounds[-1] - bounds[0]) / (len(bounds) - 1)
    even = all(abs(b - (bounds[0] + k * step)) <= 1e-9 * max(1.0, abs(step)) for k, b in enumerate(bounds))
    if even and n > 8:
        table = F.array(*[F.lit(float(b)) for b in bounds])
        guess = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((value - bounds[0]) / step).cast("int")))
        low, high = F.element_at(table, guess + 1), F.element_at(table, guess + 2)
        k = F.when(value < low, guess - 1).when(value >= high, guess + 1).otherwise(guess)
    else:
        k = sum((F.when(value >= float(b), 1).otherwise(0) for b in bounds[1:-1]), F.lit(0))
    return F.when((value >= float(bounds[0])) & (value < float(bounds[-1])), k)


def box_column(bounds: Bounds) -> Column:
    """Mixed-radix box id, the first axis fastest; -1 outside the grid."""
    box, stride = F.lit(0).cast("long"), 1
    for a, b in bounds.items():
        box, stride = box + axis_index(F.col(a), b).cast("long") * stride, stride * (len(b) - 1)
    return F.coalesce(box, F.lit(-1).cast("long"))


def boxed(states: DataFrame, bounds: Bounds) -> DataFrame:
    return states.withColumn("mem", box_column(bounds))


def box_count(bounds: Bounds) -> int:
    return math.prod(len(b) - 1 for b in bounds.values())


def box_centres(spark: SparkSession, bounds: Bounds) -> DataFrame:
    """(box, one column per axis): midpoints; an open outer box gets its inner bound's neighbour distance."""
    def mids(b: list[float]) -> list[float]:
        step = b[2] - b[1] if len(b) > 2 else 0.0
        b = [b[1] - step if b[0] < -1e100 else b[0], *b[1:-1], b[-2] + step if b[-1] > 1e100 else b[-1]]
        return [(x + y) / 2 for x, y in zip(b, b[1:], strict=False)]

    rows, stride = spark.range(box_count(bounds)).select(F.col("id").alias("box")), 1
    for a, b in bounds.items():
        table = F.array(*[F.lit(float(x)) for x in mids(b)])
        rows, stride = rows.withColumn(a, F.element_at(table, (F.floor(F.col("box") / stride) % (len(b) - 1)).cast("int") + 1)), stride * (len(b) - 1)
    return rows


#: Densities: side of a cell in units of the kernel, order of the expansion within it, and how far the kernel reaches.
CELL, ORDER, REACH = 0.25, 10, 8.5


def kde_weights(states: DataFrame, boxes: DataFrame, axes: list[str], bandwidth: float | None = None) -> DataFrame:
    """(box, p): Gaussian kernel density of the states at the box centres, scaled to sum 1.

    Kernel covariance is the states' times the squared bandwidth (Scott's n^(-1/(d+4)) by default). In coordinates in which
    it is the unit matrix (by its triangular root, so that the first depends on the first axis alone, and so on), states are
    summed up per cell: the moments of their offsets from the cell's centre, up to ``ORDER``. The kernel is then expanded in
    Hermite functions about the centres, one axis after the other: cells meet the boxes' places on that axis within
    ``REACH``, and what remains is summed per place and remaining cell coordinates. Work follows cells and boxes, not states
    times boxes. An offset is CELL / 2 at most, so the terms left out are below 1e-11 of a state's kernel, those out of reach
    below 3e-16.
    """
    clean = states.filter(" and ".join(f"{a} is not null" for a in axes)).select(*[F.col(a).cast("double").alias(a) for a in axes])
    moments = clean.agg(F.count("*").alias("n"), *[F.covar_samp(a, b).alias(f"c{i}{j}") for i, a in enumerate(axes) for j, b in enumerate(axes)], *[F.avg(a).alias(f"m{i}") for i, a in enumerate(axes)]).first()
    d = len(axes)
    factor = bandwidth if bandwidth is not None else moments["n"] ** (-1.0 / (d + 4))
    inverse = np.linalg.inv(np.linalg.cholesky(np.array([[moments[f"c{i}{j}"] for j in range(d)] for i in range(d)]) * factor**2))

    def whitened(rows: DataFrame) -> DataFrame:
        z = {f"z{k}": sum((F.lit(float(inverse[k, i])) * (F.col(axes[i]) - moments[f"m{i}"]) for i in range(k + 1)), F.lit(0.0)) for k in range(d)}
        return rows.withColumns(z)

    cells = whitened(clean).withColumns({f"c{k}": F.floor(F.col(f"z{k}") / CELL) for k in range(d)})
    cells = cells.select(*[f"c{k}" for k in range(d)], *[(F.col(f"z{k}") - (F.col(f"c{k}") + 0.5) * CELL).alias(f"o{k}") for k in range(d)])
    index = [i for i in np.ndindex(*[ORDER + 1] * d) if sum(i) <= ORDER]
    name = lambda i: "m_" + "_".join(map(str, i))
    powers = cells.selectExpr(*[f"c{k}" for k in range(d)], *[f"power(o{k}, {n}D) AS o{k}_{n}" for k in range(d) for n in range(ORDER + 1)])
    moment = lambda i: F.expr(f"sum({' * '.join(f'o{k}_{n}' for k, n in enumerate(i))}) / {math.prod(map(math.factorial, i))}D AS {name(i)}")
    held = table = cut_lineage(powers.groupBy(*[f"c{k}" for k in range(d)]).agg(*[moment(i) for i in index]))
    grid = cut_lineage(whitened(boxes.select("box", *[F.col(a).cast("double").alias(a) for a in axes])))
    for k in range(d):
        places = grid.select(*[f"z{j}" for j in range(k + 1)]).distinct()
        near = places.withColumn(f"c{k}", F.explode(F.sequence(F.floor((F.col(f"z{k}") - REACH) / CELL), F.floor((F.col(f"z{k}") + REACH) / CELL))))
        met = held.join(near, [*[f"z{j}" for j in range(k)], f"c{k}"]).withColumn("u", F.col(f"z{k}") - (F.col(f"c{k}") + 0.5) * CELL)
        met = met.selectExpr("*", "exp(-u * u / 2) AS h0").selectExpr("*", "u * h0 AS h1")
        for n in range(1, ORDER):
            met = met.selectExpr("*", f"u * h{n} - {n} * h{n - 1} AS h{n + 1}")
        rest = sorted({i[k + 1 :] for i in index})
        sums = [F.expr(f"sum({' + '.join(f'{name(i[k:])} * h{i[k]}' for i in index if i[k + 1 :] == r and not any(i[:k]))}) AS {name(r) if r else 'p'}") for r in rest]
        held = cut_lineage(met.groupBy(*[f"z{j}" for j in range(k + 1)], *[f"c{j}" for j in range(k + 1, d)]).agg(*sums), instead_of=table)
        table = held
    parts = grid.join(held, [f"z{j}" for j in range(d)], "left").select("box", F.coalesce("p", F.lit(0.0)).alias("p"))
    whole = parts.agg(F.sum("p").alias("s"))
    return parts.crossJoin(F.broadcast(whole)).select("box", ratio("p", "s").alias("p"))  # one row


def level_fill(weights: DataFrame, levels: int) -> DataFrame:
    """(box, level): boxes in decreasing weight fill levels 0..levels, each closed once it holds 1 / (levels + 1) of
    the weight; leftover boxes get 0. Ties go to the smaller box. Running sums over ranges of the order tell where each
    level ends: one search for the first box that fills it, for each level."""
    held = ordering.placed(weights.select("box", F.col("p").cast("double").alias("p")), F.desc("p"), "box", sums={"before": "p"})
    held = cut_lineage(held.select("box", "place", "before", (F.col("before") + F.col("p")).alias("upto")))
    ends, start, reached = [], 0, 0.0
    for _ in range(levels + 1):
        full = held.filter((F.col("place") >= start) & (F.col("upto") - reached >= 1.0 / (levels + 1))).agg(F.min(F.struct("place", "upto")).alias("e")).first().e
        if full is None:
            break
        ends.append(full.place)
        start, reached = full.place + 1, full.upto
    level = sum((F.when(F.col("place") > e, 1).otherwise(0) for e in ends), F.lit(0))
    return held.select("box", F.when(level <= levels, level).otherwise(0).cast("long").alias("level"))


def sector(x: Column, y: Column, cx: Column | float, cy: Column | float, sectors: int) -> Column:
    """0..sectors-1 by the angle around a centre, half-open."""
    angle = F.pmod(F.atan2(y - cy, x - cx), F.lit(TWO_PI))
    return F.least(F.lit(sectors - 1), F.floor(angle / (TWO_PI / sectors))).cast("long")


def polar_boxes(centres: DataFrame, weights: DataFrame, levels: int, sectors: int, centre: str = "mode", axes: tuple[str, str] = ("x", "y")) -> DataFrame:
    """(box, mem): level * sectors + sector around the heaviest box ('mode') or the weighted mean ('mean')."""
    x, y = axes
    both = centres.join(weights, "box")
    if centre == "mode":
        at = both.agg(F.max_by(x, F.struct("p", -F.col("box"))).alias("cx"), F.max_by(y, F.struct("p", -F.col("box"))).alias("cy"))
    else:
        at = both.agg((F.sum(F.col(x) * F.col("p")) / F.sum("p")).alias("cx"), (F.sum(F.col(y) * F.col("p")) / F.sum("p")).alias("cy"))
    placed = both.crossJoin(F.broadcast(at)).select("box", sector(F.col(x), F.col(y), F.col("cx"), F.col("cy"), sectors).alias("sector"))
    return placed.join(level_fill(weights, levels), "box").select("box", (F.col("level") * sectors + F.col("sector")).alias("mem"))


def principal_axes(states: DataFrame, axes: tuple[str, str]) -> DataFrame:
    """``states`` with two axes replaced by their principal components (anomalies, the larger variance first; the
    component of greatest size of either direction is positive)."""
    x, y = (F.col(a) for a in axes)
    m = states.agg(F.avg(x).alias("x"), F.avg(y).alias("y"), F.var_pop(x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.var_pop(y).alias("yy")).first()
    if m.xx is None:
        return states
    w, v = np.linalg.eigh(np.array([[m.xx, m.xy], [m.xy, m.yy]]))
    v = v[:, np.argsort(-w)]
    v = v * np.where(v[np.abs(v).argmax(axis=0), [0, 1]] < 0, -1, 1)
    return states.withColumns({axes[k]: (x - m.x) * float(v[0, k]) + (y - m.y) * float(v[1, k]) for k in (0, 1)})


def polar_membership(states: DataFrame, levels: int, sectors: int, n: int = 20, spread: float = 3.0, centre: str = "mode", bandwidth: float | None = None, axes: tuple[str, str] = ("x", "y"), rotation: str | None = None) -> DataFrame:
    """States with ``mem``: adapted grid, kernel density, polar partition, labels made dense.

    ``rotation`` 'eof' replaces the two axes by their principal components first, and gives them back as they were."""
    if rotation == "eof":
        kept = [F.col(a).alias(f"__{a}") for a in axes]
        turned = polar_membership(principal_axes(states.select("*", *kept), axes), levels, sectors, n, spread, centre, bandwidth, axes)
        return turned.select(*[F.col(f"__{c}").alias(c) if c in axes else F.col(c) for c in states.columns], "mem")
    if rotation is not None:
        raise ValueError(f"unknown rotation {rotation!r}")
    spark = states.sparkSession
    bounds = bounds_of(adapted_grid(states, list(axes), n, spread))
    centres = box_centres(spark, {a: bounds[a] for a in axes})
    weights = kde_weights(states, centres, list(axes), bandwidth)
    polar = polar_boxes(centres, weights, levels, sectors, centre, axes)
    placed = boxed(states, {a: bounds[a] for a in axes}).withColumnRenamed("mem", "box").join(polar, "box")
    used = placed.select("mem").distinct()
    low = used.select(F.col("mem").alias("low"))
    dense = used.join(low, F.col("low") < F.col("mem"), "left").groupBy("mem").agg(F.count("low").alias("dense"))  # levels * sectors rows
    return placed.join(F.broadcast(dense), "mem").drop("mem", "box").withColumnRenamed("dense", "mem")


def reg2lin(lats: DataFrame, lons: DataFrame) -> DataFrame:
    """(node, lat, lon) of a regular grid, latitude-major: lats (ii, lat), lons (jj, lon)."""
    n = lons.agg(F.count("*").alias("nlon"))
    return lats.crossJoin(lons).crossJoin(F.broadcast(n)).select((F.col("nlon") * F.col("ii") + F.col("jj")).cast("long").alias("node"), "lat", "lon")


def block_mean(source: DataFrame, target: DataFrame, dlon: float, dlat: float) -> DataFrame:
    """(node, value): mean of source cells (lon, lat, value) within half a step of each target (node, lon, lat), both
    ends included. A range join on plain keys: each source cell is dealt to the steps that it may touch."""
    near = lambda c, d: F.explode(F.sequence(F.floor(F.col(c) / d) - 1, F.floor(F.col(c) / d) + 1))
    cells = source.withColumn("kx", near("lon", dlon)).withColumn("ky", near("lat", dlat))
    goals = target.select("node", F.col("lon").alias("tlon"), F.col("lat").alias("tlat"), F.floor(F.col("lon") / dlon).alias("kx"), F.floor(F.col("lat") / dlat).alias("ky"))
    hit = cells.join(goals, ["kx", "ky"]).filter((F.abs(F.col("lon") - F.col("tlon")) <= dlon / 2) & (F.abs(F.col("lat") - F.col("tlat")) <= dlat / 2))
    return hit.groupBy("node").agg(F.avg("value").alias("value"))
