"""Graph and sparse-matrix text files: Pajek, compressed rows or columns, edge lists, Infomap trees and maps.

Readers give long frames from ``spark.read.text``; the place of a line in its file orders sections. Writers order
lines by a key and write one part per range, so a file is a folder of parts whose names sort in line order, and whose
concatenation is the text; ``single`` gives one part.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelens.functions import ordering
from tidelens.functions.storage import cut_lineage


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line, tok): lines in order with their white-space separated parts.

    ``pos`` is made of the place of the file among the sorted names, of the block within the file and of a number that
    grows within the block, so it orders lines without sorting them all.
    """
    text = spark.read.text(path)
    files = sorted(re.sub(r"^([a-z0-9]+):/+", r"\1:/", f) for f in text.inputFiles())  # file:/a and file:///a are one
    names = spark.createDataFrame([(f, k) for k, f in enumerate(files)], "file string, number long")
    raw = text.select("value", F.regexp_replace("_metadata.file_path", "^([a-z0-9]+):/+", "$1:/").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    number = F.coalesce("number", F.raise_error(F.concat(F.lit("a file that was not listed: "), F.col("file"))).cast("long"))
    raw = raw.join(F.broadcast(names), "file", "left").withColumn("pos", F.struct(number.alias("number"), "block", "id"))  # a short row per file
    return raw.select("pos", F.trim("value").alias("line"), F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("tok"))


def line_count(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).agg(F.count("*").alias("n"))


def write_lines(keyed: DataFrame, path: str, single: bool = False, end: str = "\n") -> None:
    """``keyed``: (key columns..., line); written in the order of all columns but the line, as a folder of parts, one per
    range of the order, whose names sort in it; ``end`` follows each line. ``single``: one part, by one task."""
    keys = [c for c in keyed.columns if c != "line"]
    ordered = keyed.coalesce(1).sortWithinPartitions(*keys) if single else keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select("line").write.mode("overwrite").option("lineSep", end).text(path)


def number(c: Column) -> Column:
    """Whole numbers without a fraction, others in full precision."""
    return F.when(c == F.floor(c), F.format_string("%d", c.cast("long"))).otherwise(F.format_string("%.18e", c))


def sectioned(text: DataFrame, starts: dict[str, str]) -> DataFrame:
    """Adds ``section``: the last header (a pattern at the line's start) at or before each line. Headers are few."""
    heads = None
    for name, pattern in starts.items():
        one = text.filter(F.lower("line").rlike(pattern)).select(F.col("pos").alias("hpos"), F.lit(name).alias("section"))
        heads = one if heads is None else heads.unionByName(one)
    last = heads.withColumn("hend", F.lead("hpos").over(Window.orderBy("hpos")))
    return text.join(F.broadcast(last), (F.col("pos") > F.col("hpos")) & (F.col("hend").isNull() | (F.col("pos") < F.col("hend"))))  # one row per header


# Pajek


def read_pajek(spark: SparkSession, path: str, base: int | None = None, symmetric: bool = False) -> DataFrame:
    """(i, j, w), 0-based, duplicates summed. ``base`` None: the first vertex id. The headers may lack their stars;
    a missing weight is 1. ``symmetric``: each edge once as (least, greatest)."""
    text = sectioned(lines(spark, path), {"v": r"^\*?vertices", "e": r"^\*?(edges|arcs)"})
    if base is None:
        first = text.filter("section = 'v'").agg(F.min_by(F.element_at("tok", 1), "pos")).first()[0]
        base = int(first) if first is not None else 1
    e = text.filter("section = 'e' and size(tok) >= 2").select((F.element_at("tok", 1).cast("long") - base).alias("i"), (F.element_at("tok", 2).cast("long") - base).alias("j"), F.coalesce(F.get("tok", F.lit(2)).cast("double"), F.lit(1.0)).alias("w"))
    if symmetric:
        e = e.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w")
    return e.groupBy("i", "j").agg(F.sum("w").alias("w"))


def read_pajek_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(node, label) of the vertex lines, node as written."""
    text = sectioned(lines(spark, path), {"v": r"^\*?vertices", "e": r"^\*?(edges|arcs)"})
    return text.filter("section = 'v'").select(F.element_at("tok", 1).cast("long").alias("node"), F.regexp_extract("line", r'^\S+\s+"?([^"]*)"?', 1).alias("label"))


def write_pajek(mat: DataFrame, n: int, path: str, base: int = 1, strict_lower: bool = False, vertices: bool = True, weights: bool = True, single: bool = False) -> None:
    """Header, vertex lines, header with the number of edges, edge lines. ``strict_lower``: entries with i > j only."""
    spark = mat.sparkSession
    mat = mat.filter("i > j") if strict_lower else mat
    edges = mat.filter("w <> 0")
    parts = [F.concat((F.col("i") + base).cast("string"), F.lit(" "), (F.col("j") + base).cast("string"))] + ([number(F.col("w"))] if weights else [])
    count = edges.agg(F.count("*").alias("c")).select(F.lit(2).alias("part"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.concat(F.lit("*Edges "), F.col("c").cast("string")).alias("line"))
    body = edges.select(F.lit(3).alias("part"), F.col("i").alias("a"), F.col("j").alias("b"), F.concat_ws(" ", *parts).alias("line"))
    out = count.unionByName(body)
    if vertices:
        v = spark.range(n).select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.format_string('%d "%d"', F.col("id") + base, F.col("id") + base).alias("line"))
        head = spark.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(f"*Vertices {n}").alias("line"))
        out = head.unionByName(v).unionByName(out)
    write_lines(out, path, single)


# Edge lists


def write_edges(mat: DataFrame, path: str, base: int = 1, sep: str = " ", single: bool = False) -> None:
    e = mat.filter("w <> 0").select("i", "j", F.concat_ws(sep, (F.col("i") + base).cast("string"), (F.col("j") + base).cast("string"), number(F.col("w"))).alias("line"))
    write_lines(e, path, single)


def read_edges(spark: SparkSession, path: str, base: int = 1) -> DataFrame:
    t = lines(spark, path).filter("size(tok) >= 2")
    return t.select((F.element_at("tok", 1).cast("long") - base).alias("i"), (F.element_at("tok", 2).cast("long") - base).alias("j"), F.coalesce(F.get("tok", F.lit(2)).cast("double"), F.lit(1.0)).alias("w"))


# Compressed rows or columns: one line each of header (type rows cols nnz), values, inner indices, outer pointers.


def write_compressed(mat: DataFrame, rows: int, cols: int, path: str, kind: str = "CSR", slice_of: int = 1 << 16, single: bool = False) -> None:
    """The format has a line for each array, however long. Each is written in slices of ``slice_of`` numbers: a slice is
    what a tab follows, and a new line begins with the last slice of the one before, so that no row holds an array and parts
    follow each other as one file. Entries are numbered in the order of rows (or columns), and pointers are their running
    counts, over ranges of the order."""
    spark = mat.sparkSession
    outer, inner, n = ("i", "j", rows) if kind.upper() == "CSR" else ("j", "i", cols)
    entries = cut_lineage(mat.select(F.col(outer).cast("long").alias("o"), F.col(inner).cast("long").alias("n"), F.col("w").cast("double").alias("w")))
    numbered = cut_lineage(ordering.placed(entries, "o", "n"))
    counts = spark.range(n).select(F.col("id").alias("o")).join(entries.groupBy("o").agg(F.count("*").alias("c")), "o", "left").select("o", F.coalesce("c", F.lit(0)).alias("c"))
    upto = ordering.placed(counts, "o", sums={"before": "c"}).select((F.col("o") + 1).alias("place"), (F.col("before") + F.col("c")).cast("long").cast("string").alias("x"))
    total = entries.count()

    def sliced(array: int, numbers: DataFrame, size: int) -> DataFrame:
        """``numbers`` (place, x), x as text; the last slice ends its line."""
        part = F.floor(F.col("place") / slice_of)
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda v: v["x"]), "\t")
        got = numbers.groupBy(part.alias("part")).agg(text.alias("line"))
        last = F.lit(max(0, size - 1) // slice_of)
        ended = got.select(F.lit(array).alias("array"), "part", F.when(F.col("part") == last, F.concat("line", F.lit("\n"))).otherwise(F.col("line")).alias("line"))
        return ended if size else spark.createDataFrame([(array, 0, "\n")], "array int, part long, line string")

    head = spark.createDataFrame([(0, 0, "\t".join([kind.upper(), str(rows), str(cols), str(total)]) + "\n")], "array int, part long, line string")
    pointers = spark.createDataFrame([(0, "0")], "place long, x string").unionByName(upto)
    out = head.unionByName(sliced(1, numbered.select("place", number(F.col("w")).alias("x")), total)).unionByName(sliced(2, numbered.select("place", F.col("n").cast("string").alias("x")), total)).unionByName(sliced(3, pointers, n + 1))
    write_lines(out, path, single, "\t")


def read_compressed(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, w) of either kind, whatever the case of its name. Files are read by tabs, which may be anywhere in a line, so
    large arrays are split; the header tells which numbers, counted over all parts, make which array. Neighbouring pointers
    tell the places of the entries of each row (or column)."""
    raw = spark.read.option("lineSep", "\t").text(path).filter("length(trim(value)) > 0")
    source = spark.read.text(path).inputFiles()
    names = spark.createDataFrame([(f, k) for k, f in enumerate(sorted(re.sub(r"^([a-z0-9]+):/+", r"\1:/", f) for f in source))], "file string, file_no long")
    raw = raw.select(F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("tok"), F.regexp_replace("_metadata.file_path", "^([a-z0-9]+):/+", "$1:/").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id")).filter("size(tok) > 0")
    raw = cut_lineage(raw.join(F.broadcast(names), "file").select("file_no", "start", "id", "tok", F.size("tok").alias("m")))  # a short row per file
    pieces = raw.groupBy("file_no", "start").agg(F.sum("m").alias("m"))
    before = pieces.select("file_no", "start", (F.sum("m").over(Window.orderBy("file_no", "start").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("before"))  # a row per piece
    inside = Window.partitionBy("file_no", "start").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    placed = raw.join(F.broadcast(before), ["file_no", "start"]).withColumn("at", F.col("before") + F.coalesce(F.sum("m").over(inside), F.lit(0)))
    tokens = cut_lineage(placed.select("at", F.posexplode("tok").alias("k", "x")).select((F.col("at") + F.col("k")).alias("at"), "x"))
    head = {r.at: r.x for r in tokens.filter("at < 4").collect()}
    kind, n = head.get(0, "").upper(), int(head.get(3, 0))
    if kind not in ("CSR", "CSC"):
        raise ValueError(f"neither CSR nor CSC: {head.get(0)}")
    array = lambda first, size, of: tokens.filter((F.col("at") >= first) & (F.col("at") < first + size)).select((F.col("at") - first).alias("pos"), F.col("x").cast(of).alias("x"))
    outer = int(head[1 if kind == "CSR" else 2])
    values, inner, pointer = array(4, n, "double"), array(4 + n, n, "long"), array(4 + 2 * n, outer + 1, "long")
    following = pointer.select((F.col("pos") - 1).alias("pos"), F.col("x").alias("next"))
    spans = pointer.join(following, "pos").filter("x < next").select(F.col("pos").alias("outer"), F.explode(F.sequence(F.col("x"), F.col("next") - 1)).alias("pos"))
    got = spans.join(values.withColumnRenamed("x", "w"), "pos").join(inner.withColumnRenamed("x", "inner"), "pos")
    return got.select("outer", "inner", "w").toDF("i", "j", "w") if kind == "CSR" else got.select("inner", "outer", "w").toDF("i", "j", "w")


# Dense text, Infomap results, grids


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, w) of all cells, rows in line order: numbered within the pieces of the files, after those before them."""
    t = lines(spark, path).filter("size(tok) > 0").withColumn("piece", F.struct("pos.number", "pos.block"))
    counts = t.groupBy("piece").agg(F.count("*").alias("n"))
    before = counts.select("piece", (F.sum("n").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))  # a row per piece
    row = F.row_number().over(Window.partitionBy("piece").orderBy("pos")) - 1 + F.col("before")
    numbered = t.join(F.broadcast(before), "piece").select(row.cast("long").alias("i"), "tok")
    return numbered.select("i", F.posexplode("tok").alias("j", "x")).select("i", F.col("j").cast("long").alias("j"), F.col("x").cast("double").alias("w"))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(node, level, com, rank) of an Infomap tree: node is the label's number - 1; levels are all parts of its path, those that a node lacks count as 1;
    communities of lower levels are numbered 1, 2, ... in the order of their parents."""
    t = lines(spark, path).filter("not startswith(line, '#') and size(tok) >= 3")
    rows = t.select(F.split(F.element_at("tok", 1), ":").cast("array<long>").alias("path"), F.element_at("tok", 2).cast("double").alias("rank"), (F.regexp_extract("line", r'"([^"]*)"', 1).cast("long") - 1).alias("node"))
    depth = rows.agg(F.max(F.size("path")).alias("depth"))
    padded = rows.crossJoin(F.broadcast(depth)).withColumn("level", F.explode(F.sequence(F.lit(1), F.col("depth"))))
    prefix = F.transform(F.sequence(F.lit(1), F.col("level")), lambda k: F.when(k <= F.size("path"), F.get("path", k - 1)).otherwise(F.lit(1).cast("long")))
    named = padded.select("node", F.col("level").cast("long").alias("level"), prefix.alias("prefix"), "rank")
    order = Window.partitionBy("level").orderBy("prefix")
    labels = named.select("level", "prefix").distinct().withColumn("com", F.row_number().over(order).cast("long"))  # a row per module
    return named.join(labels, ["level", "prefix"]).select("node", "level", "com", "rank")


def tree_header(spark: SparkSession, path: str) -> DataFrame:
    """(code_length, n): the third and the ninth part of the first line."""
    first = lines(spark, path).filter("startswith(line, '#')").agg(F.min_by("tok", "pos").alias("tok"))
    return first.select(F.get("tok", F.lit(2)).cast("double").alias("code_length"), F.get("tok", F.lit(8)).cast("long").alias("n"))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, w): flows between modules of an Infomap map, 0-based, a module's own flow on the diagonal."""
    text = sectioned(lines(spark, path), {"m": r"^\*modules", "n": r"^\*nodes", "l": r"^\*links"})
    own = text.filter("section = 'm'").select((F.element_at("tok", 1).cast("long") - 1).alias("i"), (F.element_at("tok", 1).cast("long") - 1).alias("j"), F.element_at(F.split("line", r'"\s*|\s+'), -2).cast("double").alias("w"))
    links = text.filter("section = 'l'").select((F.element_at("tok", 1).cast("long") - 1).alias("i"), (F.element_at("tok", 2).cast("long") - 1).alias("j"), F.element_at("tok", 3).cast("double").alias("w"))
    return own.unionByName(links)


def write_grid(spark: SparkSession, bounds: dict[str, list[float]], path: str) -> None:
    """One line of bounds per dimension."""
    rows = spark.createDataFrame([(k, "\t".join(repr(float(x)) for x in b)) for k, b in enumerate(bounds.values())], "k long, line string")
    write_lines(rows, path)


def pretty(mat: DataFrame, columns: list[int], digits: int = 3) -> DataFrame:
    """(i, line): a row of the matrix as text, ``---`` for absent cells."""
    wide = mat.groupBy("i").pivot("j", columns).agg(F.sum("w"))
    return wide.select("i", F.concat_ws("\t", *[F.coalesce(F.format_number(F.col(f"`{c}`"), digits), F.lit("---")) for c in columns]).alias("line"))
