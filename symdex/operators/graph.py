"""The module graph of a code base, from its chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import import_candidate, module_name


def modules(chunks: DataFrame) -> DataFrame:
    """(name, source_path, lines_of_code, imports) of module chunks; of files with one name the last by path."""
    rows = chunks.where("chunk_type = 'module'").select(module_name(F.col("file_path")).alias("name"), F.col("file_path").alias("source_path"), (F.col("end_line") - F.col("start_line") + 1).alias("lines_of_code"), "imports")
    return rows.groupBy("name").agg(F.max_by(F.struct("source_path", "lines_of_code"), "source_path").alias("x")).select("name", "x.source_path", "x.lines_of_code")


def symbols(chunks: DataFrame) -> DataFrame:
    """(name, type, parent, symbol, signature, location_hint, is_private) of functions and classes whose module is known; of one name the last."""
    rows = chunks.where(F.col("chunk_type").isin("function", "class")).select(module_name(F.col("file_path")).alias("parent"), "symbol", F.col("chunk_type").alias("type"), "signature", F.col("start_line").alias("location_hint"), "file_path")
    rows = rows.join(modules(chunks).select(F.col("name").alias("parent")), "parent", "left_semi").withColumn("name", F.concat_ws(".", "parent", "symbol"))
    last = rows.groupBy("name").agg(F.max_by(F.struct("type", "parent", "symbol", "signature", "location_hint"), F.struct("file_path", "location_hint")).alias("x"))
    return last.select("name", "x.type", "x.parent", "x.symbol", "x.signature", "x.location_hint", F.col("x.symbol").startswith("_").alias("is_private"))


def exports(chunks: DataFrame) -> DataFrame:
    """(name, exports): public functions and classes of each module in order of file and line."""
    rows = chunks.where(F.col("chunk_type").isin("function", "class") & ~F.col("symbol").startswith("_"))
    listed = rows.select(module_name(F.col("file_path")).alias("name"), F.struct("file_path", "start_line", "symbol").alias("s")).groupBy("name").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["symbol"]).alias("exports"))
    return modules(chunks).select("name").join(listed, "name", "left").withColumn("exports", F.coalesce("exports", F.array().cast("array<string>")))


def edges(chunks: DataFrame) -> DataFrame:
    """(src, dst): distinct imports between modules.

    An import names a module, or its last parts: then the least name that ends so. Names are exploded into their endings,
    so both are hash joins.
    """
    known = modules(chunks).select("name")
    wanted = chunks.where("chunk_type = 'module'").select(module_name(F.col("file_path")).alias("src"), F.explode("imports").alias("i")).select("src", import_candidate(F.col("i")).alias("dep")).where("dep <> ''").distinct()
    parts = F.split("name", "\\.")
    endings = known.select("name", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.greatest(F.size(parts), F.lit(1))), "."))).alias("dep")).where("dep <> ''")
    shortest = endings.groupBy("dep").agg(F.min("name").alias("ending"))
    found = wanted.join(known.select("name", F.col("name").alias("dep")), "dep", "left").join(shortest, "dep", "left")
    return found.select("src", F.coalesce("name", "ending").alias("dst")).where("dst is not null and dst <> src").distinct()


def nodes(chunks: DataFrame) -> DataFrame:
    """(name, type, parent, source_path, location) of modules and of symbols; a symbol's node replaces a module's of its name."""
    m = modules(chunks).select("name", F.lit("module").alias("type"), F.lit(None).cast("string").alias("parent"), "source_path", F.lit(1).alias("location"), F.lit(0).alias("o"))
    s = symbols(chunks).select("name", "type", "parent", F.lit(None).cast("string").alias("source_path"), F.col("location_hint").alias("location"), F.lit(1).alias("o"))
    return m.unionByName(s).groupBy("name").agg(F.max_by(F.struct("type", "parent", "source_path", "location"), "o").alias("x")).select("name", "x.*")


def detailed_nodes(chunks: DataFrame) -> DataFrame:
    """`nodes` with what they hold: of modules exports and lines_of_code, of symbols signature and is_private."""
    held = modules(chunks).select("name", "lines_of_code").join(exports(chunks), "name").withColumn("type", F.lit("module"))
    said = symbols(chunks).select("name", "type", "signature", "is_private")
    return nodes(chunks).join(held, ["name", "type"], "left").join(said, ["name", "type"], "left")


def stats(chunks: DataFrame) -> DataFrame:
    n = nodes(chunks).agg(F.sum((F.col("type") == "module").cast("long")).alias("total_modules"), F.sum(F.col("type").isin("function", "class").cast("long")).alias("total_symbols"))
    return n.crossJoin(edges(chunks).agg(F.count("*").alias("total_edges")))


def neighbours(links: DataFrame) -> DataFrame:
    """(name, neighbour): both directions of each (src, dst), without empty ends and self-links."""
    both = links.select("src", "dst").union(links.select("dst", "src")).toDF("name", "neighbour")
    return both.where("name <> '' and neighbour <> '' and name <> neighbour").distinct()


def context(chunks: DataFrame, most: int = 3) -> DataFrame:
    """(name, neighbour, position, symbol): the first exports of each neighbour module."""
    first = exports(chunks).select(F.col("name").alias("neighbour"), F.posexplode(F.slice("exports", 1, most)).alias("position", "symbol"))
    return neighbours(edges(chunks)).join(first, "neighbour").select("name", "neighbour", "position", "symbol")
