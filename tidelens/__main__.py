"""Commands on files:

``python -m tidelens convert SOURCE TARGET [--from compressed|pajek|edges] [--to edges|pajek|compressed] [--nodes N]``
``python -m tidelens significance SOURCE TARGET [--variable NAME] [--samples N] [--seed N]``: the block bootstrap of all
pairs of nodes of a netCDF field, as ``pval.txt``, ``estim.txt`` and ``lopt.txt`` (i, j and the value in each line).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.functions.storage import cut_lineage
from tidelens.operators import resample as rs
from tidelens.sources import netcdf as nc
from tidelens.sources import text as tx


def significance(field: DataFrame, target: str, samples: int, seed: int) -> None:
    """Symmetric matrices of p-value, correlation and block length; the diagonal has 0, 1 and 0."""
    found = cut_lineage(rs.p_values(field, samples, seed).select("i", "j", "p", "estim", F.col("l").cast("double").alias("l")))
    own = field.select(F.col("node").alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(0.0).alias("p"), F.lit(1.0).alias("estim"), F.lit(0.0).alias("l"))
    whole = cut_lineage(found.unionByName(found.withColumns({"i": F.col("j"), "j": F.col("i")})).unionByName(own))
    for name, column, form in (("pval", "p", "%.6f"), ("estim", "estim", "%.9f"), ("lopt", "l", "%.0f")):
        line = F.format_string(f"%d %d {form}", "i", "j", column)
        tx.write_lines(whole.select("i", "j", line.alias("line")), f"{target}/{name}.txt")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidelens")
    commands = parser.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert", help="a matrix file to another format")
    convert.add_argument("source")
    convert.add_argument("target")
    convert.add_argument("--from", dest="kind", choices=["compressed", "pajek", "edges"], default="compressed")
    convert.add_argument("--to", choices=["edges", "pajek", "compressed"], default="edges")
    convert.add_argument("--nodes", type=int, help="number of nodes, for pajek and compressed targets")
    level = commands.add_parser("significance", help="block-bootstrap significance of the correlations of a netCDF field")
    level.add_argument("source")
    level.add_argument("target")
    level.add_argument("--variable")
    level.add_argument("--samples", type=int, default=10_000)
    level.add_argument("--seed", type=int, default=0)
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "significance":
        significance(nc.read(spark, a.source, a.variable), a.target, a.samples, a.seed)
        return
    mat = {"compressed": tx.read_compressed, "pajek": tx.read_pajek, "edges": lambda s, p: tx.read_edges(s, p, base=0)}[a.kind](spark, a.source)
    if a.to == "edges":
        tx.write_edges(mat, a.target, base=0, sep="\t")
    elif a.nodes is None:
        parser.error("--nodes is needed for this target")
    elif a.to == "pajek":
        tx.write_pajek(mat, a.nodes, a.target)
    else:
        tx.write_compressed(mat, a.nodes, a.nodes, a.target)


if __name__ == "__main__":
    main()
