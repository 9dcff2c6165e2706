"""Source ranges with context, and packing of results under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate


def fetch(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests(idx, file_path, start_line, end_line, context_before, context_after) with (first, last, content).

    The window is clamped to the file's lines; a start past the end gives '', an unknown file null. Null contexts are 0. A
    trailing line end counts as one more, empty line.
    """
    text = files.where("content is not null").select("file_path", F.split(F.regexp_replace("content", r"\r\n?", "\n"), "\n", -1).alias("lines")).dropDuplicates(["file_path"])
    got = requests.join(text, "file_path", "left")
    total = F.size("lines")
    first = F.greatest(F.lit(1), F.col("start_line") - F.coalesce("context_before", F.lit(0)))
    last = F.least(total, F.col("end_line") + F.coalesce("context_after", F.lit(0)))
    content = F.when(F.col("lines").isNotNull(), F.when((first > total) | (last < first), F.lit("")).otherwise(F.array_join(F.slice("lines", first, F.greatest(last - first + 1, F.lit(0))), "\n")))
    return got.select("idx", "file_path", F.when(F.col("lines").isNotNull(), first).cast("int").alias("first"), F.when(F.col("lines").isNotNull(), last).cast("int").alias("last"), content.alias("content"))


def chunk_cost(df: DataFrame, content_col: str) -> DataFrame:
    """df with cost: tokens of the content and of the line that names the chunk."""
    head = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("file_path", "qualified_name", "signature", "language", "chunk_type")])
    return df.withColumn("cost", token_estimate(F.coalesce(content_col, F.lit(""))) + token_estimate(head))


def pack(df: DataFrame, group_col: str, order_col: str, cost_col: str, budget: int) -> DataFrame:
    """(group, order, cost, included, running): in order, what still fits is included; what doesn't is passed over.

    A group is one query's result list.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(cost_col).cast("int").alias("c"))))
    rows = df.groupBy(group_col).agg(items.alias("items"))
    zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<struct<included:boolean,running:int>>").alias("out"))

    def step(s, x):
        fits = s["total"] + x["c"] <= budget
        total = F.when(fits, s["total"] + x["c"]).otherwise(s["total"])
        return F.struct(total.alias("total"), F.concat(s["out"], F.array(F.struct(fits.alias("included"), total.alias("running")))).alias("out"))

    folded = rows.withColumn("f", F.aggregate("items", zero, step))
    each = folded.select(group_col, F.explode(F.arrays_zip("items", F.col("f.out").alias("out"))).alias("z"))
    return each.select(group_col, F.col("z.items.o").alias(order_col), F.col("z.items.c").alias(cost_col), F.col("z.out.included").alias("included"), F.col("z.out.running").alias("running"))
