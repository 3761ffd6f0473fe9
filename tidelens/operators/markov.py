"""Markov chains: transition counts and matrices, entropies, lumping, flows, reversibilisation, rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.draws import uniforms
from tidelens.functions.scalar import plog2p, plogp, ratio
from tidelens.functions.storage import cut_lineage
from tidelens.operators.matrix import product, scaled_by, stochastic, sums, transposed, vector_product


def lagged_pairs(members: DataFrame, tau: int = 1, by: str = "series", order: str = "t", state: str = "mem") -> DataFrame:
    """(series, i, j): states ``tau`` steps apart in each series; out-of-domain (null or negative) pairs are dropped."""
    later = F.lead(state, tau).over(Window.partitionBy(by).orderBy(order))
    return members.select(by, F.col(state).alias("i"), later.alias("j")).filter("i >= 0 and j >= 0")


def transition_counts(members: DataFrame, tau: int = 1, **names) -> DataFrame:
    """(i, j, n) over all series."""
    return lagged_pairs(members, tau, **names).groupBy("i", "j").agg(F.count("*").alias("n"))


def transition_matrix(members: DataFrame, tau: int = 1, **names) -> DataFrame:
    """(i, j, n, joint, p_backcast, q_forecast): shares of all, of column j and of row i."""
    n = transition_counts(members, tau, **names)
    col, row, total = n.groupBy("j").agg(F.sum("n").alias("nj")), n.groupBy("i").agg(F.sum("n").alias("ni")), n.agg(F.sum("n").alias("nn"))
    both = n.join(col, "j").join(row, "i").crossJoin(F.broadcast(total))
    return both.select("i", "j", "n", (F.col("n") / F.col("nn")).alias("joint"), (F.col("n") / F.col("nj")).alias("p_backcast"), (F.col("n") / F.col("ni")).alias("q_forecast"))


def end_distributions(members: DataFrame, tau: int = 1, **names) -> DataFrame:
    """(node, init, final): shares of the pairs that start, and that end, in each state."""
    n = transition_counts(members, tau, **names)
    parts = n.select(F.col("i").alias("node"), F.col("n").alias("a"), F.lit(0).alias("b")).unionByName(n.select(F.col("j").alias("node"), F.lit(0).alias("a"), F.col("n").alias("b")))
    got, total = parts.groupBy("node").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), n.agg(F.sum("n").alias("nn"))
    return got.crossJoin(F.broadcast(total)).select("node", (F.col("a") / F.col("nn")).alias("init"), (F.col("b") / F.col("nn")).alias("final"))


def lost_share(pairs: DataFrame, n_boxes: int) -> DataFrame:
    """One row: pairs, and the share with a box outside 0..n_boxes-1."""
    inside = (F.col("i").between(0, n_boxes - 1)) & (F.col("j").between(0, n_boxes - 1))
    return pairs.agg(F.count("*").alias("pairs"), F.avg(F.when(inside, 0.0).otherwise(1.0)).alias("lost"))


def entropy(vector: DataFrame) -> DataFrame:
    """Bits of a distribution (node, p)."""
    return vector.agg((-F.sum(plog2p("p"))).alias("h"))


def entropy_rate(mat: DataFrame, vector: DataFrame) -> DataFrame:
    """- sum p_i T_ij log2 T_ij."""
    return mat.join(vector.select(F.col("node").alias("i"), "p"), "i").agg((-F.sum(F.col("p") * plog2p("w"))).alias("h"))


def mutual_information(mat: DataFrame, vector: DataFrame) -> DataFrame:
    return entropy(vector).crossJoin(entropy_rate(mat, vector).withColumnRenamed("h", "r")).select("h", "r", (F.col("h") - F.col("r")).alias("mi"))


def local_entropy(mat: DataFrame, inward: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """(node, h) in nats of each row's (or column's) normalised weights; 0 for nodes without any."""
    axis = "j" if inward else "i"
    got = stochastic(mat, axis).groupBy(F.col(axis).alias("node")).agg((-F.sum(plogp("w"))).alias("h"))
    return got if nodes is None else nodes.select("node").join(got, "node", "left").select("node", F.coalesce("h", F.lit(0.0)).alias("h"))


def with_ends(mat: DataFrame, members: DataFrame) -> DataFrame:
    """Adds the communities ci, cj of both ends (members: node, com)."""
    ci, cj = members.select(F.col("node").alias("i"), F.col("com").alias("ci")), members.select(F.col("node").alias("j"), F.col("com").alias("cj"))
    return mat.join(ci, "i").join(cj, "j")


def node_flow(mat: DataFrame, vector: DataFrame) -> DataFrame:
    """p_i T_ij."""
    return scaled_by(mat, vector, "i").select("i", "j", "w")


def community_flow(flow: DataFrame, members: DataFrame) -> DataFrame:
    return with_ends(flow, members).groupBy(F.col("ci").alias("i"), F.col("cj").alias("j")).agg(F.sum("w").alias("w"))


def node_community_flow(flow: DataFrame, members: DataFrame, direction: str = "to") -> DataFrame:
    """(node, com, w): flow of each node to each community, or from each community to each node."""
    near, far = ("i", "cj") if direction == "to" else ("j", "ci")
    return with_ends(flow, members).groupBy(F.col(near).alias("node"), F.col(far).alias("com")).agg(F.sum("w").alias("w"))


def node_community_transition(mat: DataFrame, members: DataFrame, vector: DataFrame, direction: str = "to") -> DataFrame:
    """'to': sum over j in c of T_ij; 'from': flow from c to j over the mass of c."""
    if direction == "to":
        return node_community_flow(mat, members, "to")
    mass = members.join(vector, "node").groupBy("com").agg(F.sum("p").alias("m"))
    flow = node_community_flow(node_flow(mat, vector), members, "from")
    return flow.join(mass, "com").select("node", "com", F.coalesce(ratio("w", "m"), F.lit(0.0)).alias("w"))


def community_transition(mat: DataFrame, members: DataFrame) -> DataFrame:
    """Unweighted sums by community, rows normalised."""
    return stochastic(community_flow(mat, members), "i")


def lumped(mat: DataFrame, members: DataFrame, vector: DataFrame) -> DataFrame:
    """Mass-weighted lumping: R_ab = sum p_i T_ij / sum p_i; communities without mass have no entries."""
    mass = members.join(vector, "node").groupBy(F.col("com").alias("i")).agg(F.sum("p").alias("m"))
    flow = community_flow(node_flow(mat, vector), members)
    return flow.join(mass, "i").select("i", "j", ratio("w", "m").alias("w")).filter(F.col("w").isNotNull())


def fuzzy_lumped(mat: DataFrame, fuzzy: DataFrame, vector: DataFrame) -> DataFrame:
    """diag(1/mu) M' diag(p) T M for a membership matrix M (i node, j community, w), mu = p M."""
    mu = vector_product(vector, fuzzy)
    flow = product(product(transposed(scaled_by(fuzzy, vector, "i")), mat), fuzzy)
    return flow.join(mu.select(F.col("node").alias("i"), "p"), "i").select("i", "j", ratio("w", "p").alias("w"))


def time_reversed(mat: DataFrame, vector: DataFrame) -> DataFrame:
    """D^-1 T' D."""
    back = transposed(scaled_by(mat, vector, "i"))
    return back.join(vector.select(F.col("node").alias("i"), "p"), "i").select("i", "j", ratio("w", "p").alias("w")).filter(F.col("w").isNotNull())


def additive_reversible(mat: DataFrame, vector: DataFrame) -> DataFrame:
    """(T + D^-1 T' D) / 2: satisfies detailed balance."""
    both = mat.select("i", "j", "w").unionByName(time_reversed(mat, vector))
    return both.groupBy("i", "j").agg((F.sum("w") / 2).alias("w"))


def symmetrised(mat: DataFrame, vector: DataFrame) -> DataFrame:
    """D^(1/2) T' D^(-1/2)."""
    return scaled_by(scaled_by(transposed(mat), vector, "i", 0.5), vector, "j", -0.5)


def community_rank(members: DataFrame, vector: DataFrame) -> DataFrame:
    return members.join(vector, "node").groupBy("com").agg(F.sum("p").alias("p"))


def community_filter(members: DataFrame, vector: DataFrame, tau: float) -> DataFrame:
    """Communities (above 0) whose rank is below ``tau`` become 0, the others 1, 2, ... in the order of their labels."""
    kept = community_rank(members, vector).filter((F.col("com") > 0) & (F.col("p") >= tau)).select("com")
    low = kept.select(F.col("com").alias("low"))
    label = kept.join(low, F.col("low") <= F.col("com")).groupBy("com").agg(F.count("*").alias("label"))  # a row per community
    return members.join(label, "com", "left").select("node", F.coalesce("label", F.lit(0)).cast("long").alias("com"))


def uniform(nodes: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n"))
    return nodes.crossJoin(F.broadcast(n)).select("node", (F.lit(1.0) / F.col("n")).alias("p"))


def pagerank(mat: DataFrame, nodes: DataFrame, damping: float | None = None, tol: float = 0.0, max_iter: int = 100, cut_every: int = 5) -> DataFrame:
    """(node, p): power iteration from the uniform vector on the row-normalised matrix.

    Undamped by default (mass leaks at nodes without outgoing weight); with ``damping`` d, teleports by (1 - d) / n.
    Stops when the L1 change is at most ``tol`` (checked at each cut of the lineage) or after ``max_iter`` steps.
    """
    step_mat, start = cut_lineage(stochastic(mat.filter("w <> 0"), "i")), cut_lineage(uniform(nodes))
    p, table = start, None
    for k in range(1, max_iter + 1):
        moved = vector_product(p, step_mat).withColumnRenamed("p", "m")
        value: Column = F.coalesce("m", F.lit(0.0))
        if damping is not None:
            value = F.lit(damping) * value + F.lit(1 - damping) * F.col("p")
        new = start.join(moved, "node", "left").select("node", value.alias("p"))
        if k % cut_every == 0 and k < max_iter:
            new = cut_lineage(new if tol <= 0 else new.join(p.withColumnRenamed("p", "old"), "node"), instead_of=table)
            table = new
            if tol > 0:
                change = new.agg(F.sum(F.abs(F.col("p") - F.col("old")))).first()[0]
                new = new.select("node", "p")
                if change is not None and change <= tol:
                    return new
        p = new
    return p


def shuffled_counts(counts: DataFrame, samples: int, seed: int = 0, chunk: int = 1 << 16) -> DataFrame:
    """(sample, i, j, n): each row of counts drawn anew with replacement from its own destinations, the total kept.

    A row's destinations and cumulative counts are two arrays; a task looks its draws up in them, ``chunk`` (a power of two) draws at a
    time, so no row is made for a draw.
    """
    rows = counts.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", F.col("n").cast("long").alias("n")))).alias("c"), F.sum("n").cast("long").alias("total"))
    rows = rows.select("i", "total", F.transform("c", lambda x: x["j"]).alias("to"), F.transform("c", lambda x: x["n"]).alias("n"))
    tasks = rows.filter("total > 0").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(chunk).cast("long"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                i, sample, total, first = (batch.column(c)[r].as_py() for c in ("i", "sample", "total", "first"))
                to, n = (batch.column(c)[r].values.to_numpy() for c in ("to", "n"))
                high, low = divmod(first, 1 << 32)
                draws = np.arange(low, low + min(chunk, total - first))
                at = np.floor(uniforms(f"{seed}|{i}|{high}", np.array([sample]), draws)[0] * total).astype(np.int64)
                hit = np.bincount(np.searchsorted(np.cumsum(n), at, side="right"), minlength=len(to))
                m = int((hit > 0).sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, sample)), pa.array(np.full(m, i)), pa.array(to[hit > 0]), pa.array(hit[hit > 0])], names=["sample", "i", "j", "n"])

    return tasks.select("i", "sample", "total", "first", "to", "n").mapInArrow(run, "sample long, i long, j long, n long").groupBy("sample", "i", "j").agg(F.sum("n").alias("n"))
