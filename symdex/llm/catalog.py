"""The p-queries: problem N's are named pN_..., and run over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, read
from . import docpairs, nearjoin, packing, provenance, quality, splitting, tokens, validity

Query = Callable[[SparkSession, str], DataFrame]


def p1_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.evidence(read(spark, sf, "source_files"), read(spark, sf, "upstream_files"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_evidence(spark, sf).select("file_id")


def p2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.pairs(read(spark, sf, "chunks"), read(spark, sf, "source_files"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.found(read(spark, sf, "chunks"), read(spark, sf, "source_files"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = nearjoin.similar(nearjoin.source(read(spark, sf, "chunks")))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    return nearjoin.groups(nearjoin.source(read(spark, sf, "chunks"))).withColumnRenamed("id", "chunk_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.found(read(spark, sf, "chunks"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split(read(spark, sf, "chunks"))


def p4_cover(spark: SparkSession, sf: str) -> DataFrame:
    """(chunk_id, within, whole) of each chunk that was cut: all pieces are within the limits, and without their overlaps they are the content again."""
    chunks = read(spark, sf, "chunks")
    pieces = splitting.split(chunks)
    lines = F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit(""))) + F.when(F.col("content").endswith("\n"), 0).otherwise(1)
    within = (lines <= splitting.MAX_LINES) & (F.length("content") <= splitting.MAX_CHARS)
    # what follows the repeated lines, after the line end that parts it from the piece before unless it goes on within a line
    rest = F.when(F.col("overlap_lines") > 0, F.array_join(F.slice(F.split("content", "\n", -1), F.col("overlap_lines") + 1, F.lit(1 << 30)), "\n")).otherwise(F.col("content"))
    glue = F.when((F.col("piece") > 0) & (F.col("start_char") == 0), "\n").otherwise("")
    told = pieces.groupBy("chunk_id").agg(F.min(within).alias("within"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", F.concat(glue, rest).alias("t")))), lambda x: x["t"]), "").alias("again"))
    text = chunks.select("chunk_id", splitting.uniform(F.col("content")).alias("text")).dropDuplicates(["chunk_id"])
    return told.join(text, "chunk_id").select("chunk_id", "within", (F.col("again") == F.col("text")).alias("whole"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return validity.found(read(spark, sf, "source_files"))


def p5_repairs(spark: SparkSession, sf: str) -> DataFrame:
    return validity.repairs(read(spark, sf, "source_files"), only_flagged=True).select("file_id", "language", "edits", "place", "cause")


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    return validity.rates(read(spark, sf, "source_files"), read(spark, sf, "chunks"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(read(spark, sf, "documents"))


def p6_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.roundtrip(read(spark, sf, "documents"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    sizes = tokens.encode(read(spark, sf, "documents"), out="n", count_only=True)
    return packing.pack(sizes, "doc_id", "n")


def p7_fits(spark: SparkSession, sf: str) -> DataFrame:
    """(overfull, torn, lost, twice): counts of what a packing must not have, over all containers and documents."""
    sizes = tokens.encode(read(spark, sf, "documents"), out="n", count_only=True)
    packed = cut(packing.pack(sizes, "doc_id", "n"))
    bins = packed.groupBy("bin_id").agg(F.sum("size").alias("s")).agg(F.count(F.when(F.col("s") > packing.CAPACITY, 1)).alias("overfull"))
    each = packed.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("size").alias("placed"), F.countDistinct("part").alias("kinds"))
    both = sizes.where("n > 0").join(each, "doc_id", "full_outer")
    fine = both.agg(F.count(F.when((F.col("parts") > 1) & (F.col("n") <= packing.CAPACITY), 1)).alias("torn"), F.count(F.when(F.coalesce(F.col("placed"), F.lit(0)) < F.col("n"), 1)).alias("lost"), F.count(F.when(F.col("n").isNull() | (F.col("placed") > F.col("n")) | (F.col("parts") != F.col("kinds")), 1)).alias("twice"))
    return bins.crossJoin(fine)  # two rows of counts


def p8_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, n_words, digit_ratio): the statistics of p8_stats that SQL can count as well."""
    stats = quality.statistics(read(spark, sf, "documents"), read(spark, sf, "common_words"), features=("n_words", "digit_ratio"))
    return stats.select("doc_id", "n_words", F.round("digit_ratio", 6).alias("digit_ratio"))


def p8_stats(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(read(spark, sf, "documents"), read(spark, sf, "doc_labels"), read(spark, sf, "common_words"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.found(read(spark, sf, "documents"), read(spark, sf, "doc_labels"), read(spark, sf, "common_words"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": r"""
            WITH c AS (SELECT chunk_id, regexp_replace(content, '\r\n?', chr(10), 'g') AS t FROM chunks)
            SELECT DISTINCT chunk_id FROM c WHERE length(t) > 8000
               OR length(t) - length(replace(t, chr(10), '')) + CASE WHEN ends_with(t, chr(10)) THEN 0 ELSE 1 END > 200""",
        "p3_found": r"""
            WITH c AS (SELECT DISTINCT chunk_id, regexp_extract_all(content, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t FROM chunks WHERE chunk_type IN ('function', 'method') AND content IS NOT NULL AND chunk_id IS NOT NULL),
            sets AS (SELECT chunk_id, list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))) AS s FROM c WHERE len(t) >= 60),
            rows AS (SELECT chunk_id, len(s) AS n, unnest(s) AS w FROM sets),
            shared AS (SELECT a.chunk_id AS x, b.chunk_id AS y, a.n AS m, b.n AS n, count(*) AS k FROM rows a JOIN rows b ON a.w = b.w AND a.chunk_id < b.chunk_id AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n GROUP BY ALL)
            SELECT x AS chunk_id_a, y AS chunk_id_b FROM shared WHERE k >= 0.7 * (m + n - k)""",
        "p4_cover": r"""
            WITH c AS (SELECT chunk_id, regexp_replace(content, '\r\n?', chr(10), 'g') AS t FROM chunks)
            SELECT DISTINCT chunk_id, true AS within, true AS whole FROM c WHERE length(t) > 8000
               OR length(t) - length(replace(t, chr(10), '')) + CASE WHEN ends_with(t, chr(10)) THEN 0 ELSE 1 END > 200""",
        "p7_fits": "SELECT CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS twice",
        "p8_counts": r"""
            WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?|\x{2028}|\x{85}', chr(10), 'g') AS t FROM documents)
            SELECT doc_id, CAST(len(regexp_extract_all(lower(t), '(?:[^\P{L}\p{Han}]|\p{M})+')) + len(regexp_extract_all(t, '\p{Han}')) AS BIGINT) AS n_words,
                CASE WHEN length(t) > 0 THEN round((length(t) - length(regexp_replace(t, '[0-9]+', '', 'g'))) / length(t), 6) ELSE 0.0 END AS digit_ratio FROM d""",
        "p6_roundtrip": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, true AS same FROM documents",
    }
