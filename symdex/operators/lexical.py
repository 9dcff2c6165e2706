"""Full-text and substring recall: BM25 over phrases, with statistics of the whole index."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def recall_size(k: int) -> int:
    return max(4 * k, 20)


def postings(df: DataFrame, id_col: str, text: Column, keep: tuple[str, ...] = (), words=tokens) -> DataFrame:
    """(term, id, tf, positions, dl, *keep): the inverted index of what `words` makes of a text. One shuffle, by term and id."""
    found = df.select(*keep, F.col(id_col).alias("id"), words(F.coalesce(text, F.lit(""))).alias("t"))
    each = found.select(*keep, "id", F.size("t").alias("dl"), F.posexplode("t").alias("position", "term"))
    return each.groupBy("term", "id", *keep).agg(F.count("*").cast("int").alias("tf"), F.array_sort(F.collect_list("position")).alias("positions"), F.first("dl").alias("dl"))


def grams(c: Column) -> Column:
    """All runs of 3 characters of a text in lower case, in order: a substring is a phrase of them."""
    low = F.lower(c)
    return F.when(F.length(low) > 2, F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, 3))).otherwise(F.array().cast("array<string>"))


def gram_phrases(query: str) -> list[list[str]]:
    """The query as one phrase of its grams; none if it is too short."""
    needle = query.strip().replace('"', "").lower()
    return [[needle[i : i + 3] for i in range(len(needle) - 2)]] if len(needle) > 2 else []


def write_postings(df: DataFrame, path: str, files: int = 64) -> None:
    """Store postings so that a query's terms prune files and row groups: by hash of term, sorted by term."""
    df.repartition(files, "term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(os.fspath(path))


def phrase_counts(words: Column, phrases: list[list[str]]) -> Column:
    """How often each phrase starts in the words; starts may overlap."""

    def count(p: list[str]) -> Column:
        if len(p) == 1:
            return F.size(F.filter(words, lambda w: w == p[0]))
        # tokens hold no blanks; two between them let phrases that follow each other keep one each
        joined = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
        return F.regexp_count(joined, F.lit(f"(?= {'  '.join(p)} )"))

    return F.array(*[count(p) for p in phrases])


def score(counted: DataFrame, n: int) -> DataFrame:
    """BM25 of (*, dl, counts array<int>): rows that hold any phrase, with their score.

    Number of rows, mean length and frequencies come from all rows, as one row of n + 2 numbers.
    """
    hits = [F.count(F.when(F.col("counts")[i] > 0, 1)).alias(f"__df{i}") for i in range(n)]
    stats = counted.agg(F.count("*").alias("__n"), F.avg("dl").alias("__avg"), *hits)
    parts = []
    for i in range(n):
        idf = F.log((F.col("__n") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        f = F.col("counts")[i]
        parts.append(F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("__avg")))).otherwise(0.0))
    found = counted.where(F.exists("counts", lambda c: c > 0)).crossJoin(F.broadcast(stats))
    return found.withColumn("score", sum(parts, F.lit(0.0))).drop("counts", "dl", "__n", "__avg", *(f"__df{i}" for i in range(n)))


def _kept(c: Column) -> Column:
    """c as a column that later filters can't be pushed through: they'd compute it again for each mention."""
    return F.explode(F.array(c))


def bm25(df: DataFrame, text: Column, phrases: list[list[str]]) -> DataFrame:
    """df's rows that match any phrase, with score, without an index: one pass for the statistics and one for the scores; the rows don't move."""
    words = df.select("*", _kept(tokens(F.coalesce(text, F.lit("")))).alias("__w"))
    counted = words.select(*df.columns, F.size("__w").alias("dl"), _kept(phrase_counts(F.col("__w"), phrases)).alias("counts"))
    return score(counted, len(phrases))


def bm25_postings(index: DataFrame, totals: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(id, score) from stored postings (term, id, tf, positions, dl); totals is one row (n_docs, avg_len).

    Only the postings of the phrases' terms are read.
    """
    wanted = sorted({t for p in phrases for t in p})
    rows = index.where(F.col("term").isin(wanted)).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m"), F.first("dl").alias("dl"))

    def count(p: list[str]) -> Column:
        if len(p) == 1:
            return F.coalesce(F.size(F.col("m")[p[0]]), F.lit(0))
        rest = [F.col("m")[t] for t in p]
        ok = lambda i: [F.array_contains(F.coalesce(r, F.array().cast("array<int>")), i + k) for k, r in enumerate(rest)]

        def both(i):
            out = ok(i)[0]
            for x in ok(i)[1:]:
                out = out & x
            return out

        return F.size(F.filter(F.coalesce(rest[0], F.array().cast("array<int>")), both))

    counted = rows.select("id", "dl", F.array(*[F.greatest(count(p), F.lit(0)) for p in phrases]).alias("counts"))
    hits = counted.agg(*[F.count(F.when(F.col("counts")[i] > 0, 1)).alias(f"__df{i}") for i in range(len(phrases))])
    joined = counted.crossJoin(F.broadcast(hits)).crossJoin(F.broadcast(totals))
    parts = []
    for i in range(len(phrases)):
        idf = F.log((F.col("n_docs") - F.col(f"__df{i}") + 0.5) / (F.col(f"__df{i}") + 0.5))
        f = F.col("counts")[i]
        parts.append(F.when(f > 0, F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avg_len")))).otherwise(0.0))
    return joined.where(F.exists("counts", lambda c: c > 0)).select("id", sum(parts, F.lit(0.0)).alias("score"))


def substring(df: DataFrame, text: Column, query: str) -> DataFrame:
    """df's rows whose text holds the query (at least 3 characters, any case), scored like a phrase of trigrams."""
    needle = query.strip().replace('"', "").lower()
    rows = df.withColumn("__t", F.lower(F.coalesce(text, F.lit("")))).withColumn("dl", F.greatest(F.length("__t") - 2, F.lit(0)))
    if len(needle) < 3:
        return rows.where(F.lit(False)).withColumn("score", F.lit(0.0)).drop("__t", "dl")
    count = F.when(F.col("__t").contains(needle), F.regexp_count("__t", F.lit(f"(?={re.escape(needle)})"))).otherwise(0)
    return score(rows.select(*df.columns, "dl", _kept(F.array(count)).alias("counts")), 1)


def top(df: DataFrame, id_col: str, n: int, digits: int = 6) -> DataFrame:
    """(id, score, rank) of the n best; ties by id. The rank is over n rows."""
    from pyspark.sql import Window

    best = df.select(F.col(id_col).alias("id"), F.round("score", digits).alias("score")).orderBy(F.desc("score"), "id").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
