"""Leading eigenpairs of large sparse matrices: restarted block Arnoldi.

The basis is a table with a row per node: its components of all basis vectors, and of their images. Images are a join of
the matrix with the last block and an aggregate; inner products are sums over the tasks of small matrices. Only these, of
the basis' size squared, come to the driver, which solves the projected problem. A cycle extends the basis block by block
(classical Gram-Schmidt, twice; a block's dependent columns are dropped), and keeps the span of the wanted Ritz vectors with
their images, which need no new product. It ends when the residuals are small, or when the space is invariant.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.functions.storage import cut_lineage

ORDERS = {"LM": lambda w: -np.abs(w), "SM": np.abs, "LR": lambda w: -w.real, "SR": lambda w: w.real, "LI": lambda w: -np.abs(w.imag)}
BASIS = "node long, v array<double>, av array<double>"


def ordered(w: np.ndarray, which: str) -> np.ndarray:
    """Places of the values in the chosen order, conjugates with positive imaginary part first."""
    return np.lexsort((-w.imag, ORDERS[which](np.round(w, 12))))


def arrays(column: pa.ListArray, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // rows)


def packed(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def mapped(basis: DataFrame, f: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``basis`` with new components, node by node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, av = f(arrays(batch.column(1), batch.num_rows), arrays(batch.column(2), batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column(0), packed(v), packed(av)], names=["node", "v", "av"])

    return basis.mapInArrow(run, BASIS)


def summed(basis: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over batches of small matrices ``f(v, av)``: a task sends one, the sums of their cells are collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = f(arrays(batch.column(1), batch.num_rows), arrays(batch.column(2), batch.num_rows))
                total = part if total is None else total + part
        if total is not None:
            a, b = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel()), pa.array(b.ravel()), pa.array(total.ravel())], names=["a", "b", "x"])

    rows = basis.mapInArrow(run, "a long, b long, x double").groupBy("a", "b").agg(F.sum("x").alias("x")).collect()
    out = np.zeros((max(r.a for r in rows) + 1, max(r.b for r in rows) + 1))
    for r in rows:
        out[r.a, r.b] = r.x
    return out


def image(mat: DataFrame, basis: DataFrame, columns: int, shift: float) -> DataFrame:
    """(node, y): the matrix plus ``shift`` in every cell, times the last ``columns`` vectors of the basis."""
    last = basis.select(F.col("node").alias("j"), F.slice("v", -columns, columns).alias("x"))
    sums = [F.sum(F.col("w") * F.get("x", F.lit(k))).alias(f"y{k}") for k in range(columns)]
    got = mat.join(last, "j").groupBy(F.col("i").alias("node")).agg(*sums).select("node", F.array(*[f"y{k}" for k in range(columns)]).alias("y"))
    if not shift:
        return got
    whole = summed(basis, lambda v, av: v[:, -columns:].sum(0)[None])[0] * shift
    zero = F.array(*[F.lit(0.0)] * columns)
    more = F.array(*[F.lit(float(x)) for x in whole])
    return basis.select("node").join(got, "node", "left").select("node", F.zip_with(F.coalesce("y", zero), more, lambda a, b: a + b).alias("y"))


def independent(gram: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Coefficients that make orthonormal columns of those with this Gram matrix; ones that are small against ``scale`` or
    depend on others give none."""
    size = np.sqrt(np.maximum(np.diag(gram), 0))
    kept = np.flatnonzero(size > 1e-12 * np.maximum(scale, 1e-300))
    if not len(kept):
        return np.zeros((len(gram), 0))
    s, u = np.linalg.eigh(gram[np.ix_(kept, kept)] / np.outer(size[kept], size[kept]))
    good = s > 1e-13 * len(kept)
    out = np.zeros((len(gram), int(good.sum())))
    out[kept] = (u[:, good] / np.sqrt(s[good])) / size[kept][:, None]
    return out


def extended(basis: DataFrame, old: int, columns: int) -> tuple[DataFrame, int]:
    """The basis (``old`` vectors) with the last ``columns`` images made orthonormal to it and appended, and their number."""
    take = lambda v, av: av[:, -columns:]
    steps: list[tuple[np.ndarray, np.ndarray]] = []  # subtract v @ first, then times second

    def block(v: np.ndarray, av: np.ndarray) -> np.ndarray:
        y = take(v, av)
        for c, t in steps:
            y = (y - v @ c) @ t
        return y

    width, scale = columns, np.ones(columns)
    for turn in range(3):
        both = summed(basis, lambda v, av: np.concatenate([v, block(v, av)], axis=1).T @ block(v, av))
        c, gram = both[:old], both[old:]
        if turn == 0:
            scale, t = np.sqrt(np.diag(gram)), np.eye(width)
        else:
            t = independent(gram - c.T @ c, scale if turn == 1 else np.ones(width))
        if t.shape[1] == 0:
            return basis, 0
        steps.append((c, t))
        width = t.shape[1]
    return mapped(basis, lambda v, av: (np.concatenate([v, block(v, av)], axis=1), av)), width


def leading(mat: DataFrame, count: int, which: str = "LM", shift: float = 0.0, nodes: DataFrame | None = None, block: int = 8, most: int | None = None, tol: float = 1e-9, cycles: int = 200) -> tuple[np.ndarray, DataFrame]:
    """(values, table): eigenvalues of the matrix (i, j, w) plus ``shift`` in each cell, in the order ``which``, and
    (node, k, re, im) with the right eigenvectors of unit length. ``nodes`` (node): more than those with entries; ``most``
    bounds the basis."""
    mat = cut_lineage(mat.groupBy("i", "j").agg(F.sum("w").alias("w")).filter("w <> 0"))
    ends = mat.select(F.col("i").alias("node")).union(mat.select(F.col("j").alias("node")))
    nodes = cut_lineage((ends if nodes is None else ends.union(nodes.select("node"))).distinct())
    n = nodes.count()
    if n == 0:
        return np.zeros(0), nodes.select("node", F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    count, most = min(count, n), min(n, most or max(4 * count, 32))
    block = n if most == n else block  # where the basis may be the whole space, it is from the start
    random = [(F.pmod(F.xxhash64("node", F.lit(k)), F.lit(1 << 40)) / F.lit(float(1 << 39)) - 1).alias(f"x{k}") for k in range(block)]
    start = nodes.select("node", F.array(*random).alias("v"), F.array().cast("array<double>").alias("av"))
    first = np.eye(block)
    for _ in range(2):
        gram = summed(start, lambda v, av, first=first: (v @ first).T @ (v @ first))
        first = first @ independent(gram, np.sqrt(np.diag(gram)))
    basis = table = cut_lineage(mapped(start, lambda v, av: (v @ first, av)))
    have, size = 0, first.shape[1]  # vectors with images, vectors
    width = size
    for _ in range(cycles):
        while have < size:
            y = image(mat, basis, size - have, shift)
            zero = F.array(*[F.lit(0.0)] * (size - have))
            basis = cut_lineage(basis.join(y, "node", "left").select("node", "v", F.concat("av", F.coalesce("y", zero)).alias("av")), instead_of=table)
            table, fresh, have = basis, size - have, size
            if size >= most:
                break
            longer, width = extended(basis, size, fresh)
            if width == 0:  # the space is invariant
                break
            keep = min(size + width, most)
            basis = cut_lineage(mapped(longer, lambda v, av, keep=keep: (v[:, :keep], av)), instead_of=table)
            table, size = basis, keep
        h = summed(basis, lambda v, av: v.T @ av)
        w, z = np.linalg.eig(h)
        order = ordered(w, which)
        w, z = w[order], z[:, order]
        wanted = z[:, :count]
        values = w[:count]
        scale = float(np.abs(w).max()) or 1.0
        residual = summed(basis, lambda v, av: (np.abs(av @ wanted - (v @ wanted) * values) ** 2).sum(0)[None])[0] ** 0.5
        if (residual <= tol * scale).all() or size >= n or width == 0:
            break
        more = min(len(w) - 1, count + max(block, count))
        more += bool(w[more - 1].imag > 0 and more < len(w))  # a conjugate pair stays whole
        span, _ = np.linalg.qr(np.concatenate([z[:, :more].real, z[:, :more].imag], axis=1)[:, real_columns(w[:more], more)])
        basis = cut_lineage(mapped(basis, lambda v, av, span=span: (v @ span, av @ span)), instead_of=table)
        table, size = basis, span.shape[1]
        have = size
        longer, width = extended(basis, size, size)
        if width:
            keep = min(size + width, most)
            basis = cut_lineage(mapped(longer, lambda v, av, keep=keep: (v[:, :keep], av)), instead_of=table)
            table, size = basis, keep
    else:
        raise RuntimeError(f"eigenpairs did not settle in {cycles} cycles: residuals up to {residual.max():.1e}")
    vectors = mapped(basis, lambda v, av: ((v @ wanted).real, (v @ wanted).imag))
    return values, vectors.select("node", F.posexplode(F.arrays_zip(F.col("v").alias("re"), F.col("av").alias("im"))).alias("k", "z")).select("node", F.col("k").cast("long").alias("k"), F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def real_columns(w: np.ndarray, n: int) -> list[int]:
    """Of the real parts of n vectors, followed by their imaginary parts: those that span the same real space."""
    return [k for k in range(n) if w[k].imag >= 0] + [n + k for k in range(n) if w[k].imag > 0]
