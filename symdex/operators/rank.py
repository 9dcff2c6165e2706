"""From recall lists to results: fusion, boost of neighbours, reranking, spread over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, SPREAD = 60, 0.15
BOOST = 0.5 / (RRF_K + 1)


def fuse(lists: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """(id, score): the sum of weight / (k + rank) over all lists of (id, rank)."""
    weights = weights or [1.0] * len(lists)
    every = None
    for x, w in zip(lists, weights):
        part = x.select("id", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("s"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("id").agg(F.sum("s").alias("score"))


def boost(scores: DataFrame, modules: DataFrame, edges: DataFrame, amount: float = BOOST) -> DataFrame:
    """(id, score) with `amount` added to what lies in a module next to the best one's.

    modules is (id, module), edges (src, dst). Scores are few (a recall list); the edges that matter are those
    of one module.
    """
    placed = scores.join(F.broadcast(scores.select("id")).join(modules, "id").dropDuplicates(["id"]), "id", "left")
    best = placed.orderBy(F.desc(F.round("score", 6)), "id").limit(1).select(F.col("module").alias("best"))
    near = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src"))
    near = near.where("a is not null and b is not null and a <> '' and b <> ''").join(F.broadcast(best), F.col("a") == F.col("best")).select(F.col("b").alias("module"), F.lit(amount).alias("more")).distinct()
    return placed.join(near, "module", "left").select("id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def rerank(df: DataFrame, query: str) -> DataFrame:
    """df(id, score, symbol, qualified_name, signature, docstring) with the score raised by what the query's words hit."""
    words = F.array(*map(F.lit, sorted(set(query.lower().split())))) if query.split() else F.array().cast("array<string>")
    symbol, name = F.lower(F.coalesce("symbol", F.lit(""))), F.lower(F.coalesce("qualified_name", F.lit("")))
    signature, doc = F.lower(F.coalesce("signature", F.lit(""))), F.lower(F.coalesce("docstring", F.lit("")))
    text = F.concat_ws(" ", F.nullif(signature, F.lit("")), F.nullif(doc, F.lit("")))
    hits = F.size(F.filter(words, lambda w: text.contains(w) | name.contains(w)))
    dots = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))
    more = (
        F.when(F.array_contains(words, symbol), 0.05).otherwise(0.0)
        + F.when((name != "") & F.exists(words, lambda w: name.contains(w)), 0.03).otherwise(0.0)
        + F.when(hits > 1, 0.01 * (hits - 1)).otherwise(0.0)
        + F.when(doc != "", 0.02).otherwise(0.0)
        + 0.01 / F.greatest(F.lit(1), dots)
    )
    return df.withColumn("score", F.bround(F.col("score") + more, 6))


def diversify(df: DataFrame, group_col: str, id_col: str = "id", amount: float = SPREAD) -> DataFrame:
    """The score less `amount` for each better row of the same group."""
    w = Window.partitionBy(group_col).orderBy(F.desc("score"), id_col)
    earlier = F.row_number().over(w) - 1
    return df.withColumn("score", F.when(earlier > 0, F.bround(F.col("score") - amount * earlier, 6)).otherwise(F.col("score")))


def top_per_group(df: DataFrame, group_col: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n per group before the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group_col).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
