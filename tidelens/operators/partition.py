"""Information-theoretic partitions: two-level code length of a Markov chain and greedy agglomeration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions import ordering
from tidelens.functions.storage import cut_lineage
from tidelens.operators.markov import community_rank, community_transition, entropy, entropy_rate, lumped


def two_level_codelength(mat: DataFrame, members: DataFrame, vector: DataFrame, weighted: bool = False) -> DataFrame:
    """One row (l, hu, hq, hqm): L = H(u) - H(Q) + h(Q) with module masses Q and module transitions, unweighted sums
    by default, mass-weighted lumping otherwise."""
    mass = community_rank(members, vector).select(F.col("com").alias("node"), "p")
    modules = lumped(mat, members, vector) if weighted else community_transition(mat, members)
    hu, hq, rate = entropy(vector).withColumnRenamed("h", "hu"), entropy(mass).withColumnRenamed("h", "hq"), entropy_rate(modules, mass).withColumnRenamed("h", "hqm")
    return hu.crossJoin(hq).crossJoin(rate).select((F.col("hu") - F.col("hq") + F.col("hqm")).alias("l"), "hu", "hq", "hqm")


def bits(x: Column) -> Column:
    """x log2 x, 0 where x is 0."""
    return F.when(x > 0, x * F.log2(x)).otherwise(F.lit(0.0))


def merge_gains(flow: DataFrame) -> DataFrame:
    """(a, b, gain) for linked modules a < b: what their merge adds to the code length.

    Terms of a module's flows change only where both have flow from or to the same third module, so these are found by
    joins along links, from the side of fewer neighbours; all other terms stay.
    """
    apart = F.col("i") != F.col("j")
    ends = flow.select(F.col("i").alias("n"), F.col("w").alias("p"), F.when(apart, 0.0).otherwise(F.col("w")).alias("own")).union(flow.select("j", F.lit(0.0), F.lit(0.0)))
    node = ends.groupBy("n").agg(F.sum("p").alias("p"), F.sum("own").alias("o"), F.count("*").alias("d"))
    of = lambda end: node.select(F.col("n").alias(end), *[F.col(c).alias(c + end) for c in "pod"])
    inner = flow.filter(apart).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum(bits(F.col("w"))).alias("h"))
    both = inner.join(of("a"), "a").join(of("b"), "b")
    masses = 2 * (bits(F.col("pa") + F.col("pb")) - bits(F.col("pa")) - bits(F.col("pb")))
    inside = bits(F.col("oa") + F.col("ob") + F.col("w")) - bits(F.col("oa")) - bits(F.col("ob")) - F.col("h")
    first = F.col("da") <= F.col("db")
    both = both.select("a", "b", (masses - inside).alias("gain"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y"))
    sides = flow.filter(apart).select(F.lit(0).alias("side"), F.col("i").alias("x"), F.col("j").alias("k"), F.col("w").alias("u")).union(flow.filter(apart).select(F.lit(1), "j", "i", "w"))
    other = sides.select("side", F.col("x").alias("y"), "k", F.col("u").alias("v"))
    change = bits(F.col("u") + F.col("v")) - bits(F.col("u")) - bits(F.col("v"))
    shared = both.join(sides, "x").filter("k <> y").join(other, ["side", "y", "k"]).select("a", "b", (-change).alias("gain"))
    return both.select("a", "b", "gain").union(shared).groupBy("a", "b").agg(F.round(F.sum("gain"), 12).alias("gain"))


def greedy_rounds(mat: DataFrame, vector: DataFrame, most_rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(merges, owners): (round, a, b, gain), module b joined a in that round, and (step, node, module) after every round
    and, as step 0, before the first; modules go by their least node.

    A round takes every linked pair that is the best one (least gain, then the first) of all pairs at its modules and at
    the modules linked with these. So no two merges of a round meet or are linked, and none changes the gain of another.
    Where all modules are linked that is one pair a round, the best of all: the sequential rule.
    """
    flow = table = cut_lineage(mat.join(vector.select(F.col("node").alias("i"), "p"), "i").select("i", "j", (F.col("w") * F.col("p")).alias("w")).filter("w > 0"))
    every = flow.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    now = owners = cut_lineage(every.select(F.lit(0).cast("long").alias("step"), "node", F.col("node").alias("module")))
    merges, turn = [], 0
    while most_rounds is None or turn < most_rounds:
        turn += 1
        first = merge_gains(flow).select(F.explode(F.array("a", "b")).alias("n"), F.struct("gain", "a", "b").alias("r")).groupBy("n").agg(F.min("r").alias("r"))
        near = flow.select(F.col("i").alias("n"), F.col("j").alias("to")).union(flow.select("j", "i")).union(flow.select("i", "i"))
        around = near.join(first, "n").groupBy("to").agg(F.min("r").alias("r"))  # the best pair at a module or at one linked with it
        chosen = around.filter("to in (r.a, r.b)").groupBy("r").agg(F.count("*").alias("ends")).filter("ends = 2")
        found = cut_lineage(chosen.select(F.lit(turn).cast("long").alias("round"), "r.a", "r.b", "r.gain"))
        if found.isEmpty():
            break
        merges.append(found)
        to = found.select(F.col("b").alias("old"), F.col("a").alias("new"))
        moved = flow.join(to, flow.i == to.old, "left").select(F.coalesce("new", "i").alias("i"), "j", "w")
        moved = moved.join(to, moved.j == to.old, "left").select("i", F.coalesce("new", "j").alias("j"), "w").groupBy("i", "j").agg(F.sum("w").alias("w"))
        flow = table = cut_lineage(moved, instead_of=table)
        now = cut_lineage(now.join(to, now.module == to.old, "left").select(F.lit(turn).cast("long").alias("step"), "node", F.coalesce("new", "module").alias("module")))
        owners = owners.unionByName(now)
    none = mat.sparkSession.createDataFrame([], "round long, a long, b long, gain double")
    return reduce(DataFrame.unionByName, merges, none), owners


def greedy_codelength(mat: DataFrame, vector: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(step, node, com, l): the partition and its code length after each round of ``greedy_rounds``, mass-weighted, from
    one module per node until one module or none linked is left. Modules are numbered by their least node's place, from 1."""
    merges, owners = greedy_rounds(mat, vector, most_rounds)
    flow = mat.join(vector.select(F.col("node").alias("i"), "p"), "i").select("i", "j", (F.col("w") * F.col("p")).alias("w"))
    numbers = ordering.placed(owners.filter("step = 0").select("node"), "node").select(F.col("node").alias("module"), (F.col("place") + 1).alias("com"))
    h = vector.join(flow.select(F.col("i").alias("node")).distinct(), "node").agg(F.sum(bits(F.col("p"))).alias("h"))
    mass = flow.groupBy("i").agg(F.sum("w").alias("p")).agg(F.sum(bits(F.col("p"))).alias("m"))
    first = flow.agg(F.sum(bits(F.col("w"))).alias("f")).crossJoin(mass).crossJoin(h).select(F.lit(0).cast("long").alias("step"), (2 * F.col("m") - F.col("f") - F.col("h")).alias("gain"))
    steps = first.unionByName(merges.groupBy(F.col("round").alias("step")).agg(F.sum("gain").alias("gain")))
    length = steps.select("step", F.sum("gain").over(Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)).alias("l"))  # a row per round
    return owners.join(F.broadcast(length), "step").join(numbers, "module").select("step", "node", "com", "l")
