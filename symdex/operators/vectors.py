"""Cosine similarity and nearest neighbours of query vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BYTES = 64 << 20  # of query vectors that go to every task; more are joined in blocks


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int | None, threshold: float = -1.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank): for each query the k most similar other vectors, at the threshold or above; ties by id. With k None all at the threshold.

    The stated queries meet all vectors in blocks: a batch of vectors times a block of queries is one matrix product, of which
    each task keeps k per query, so what is shuffled is k rows per query and task. Blocks hold QUERY_BYTES at most.
    """
    spark = vectors.sparkSession
    shown = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("q"), F.col(vec_col).alias("v"))
    size = shown.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    per = max(1, QUERY_BYTES // max(8, 8 * (size["d"] or 1)))
    blocks = max(1, -(-size["n"] // per))
    out = None
    for i in range(blocks):
        rows = (shown if blocks == 1 else shown.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i)).toPandas()
        if rows.empty:
            continue
        ids = rows["q"].to_numpy()
        m = np.stack([np.asarray(v, float) for v in rows["v"]])
        lengths = np.linalg.norm(m, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids, np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)))

        def run(batches, shared=shared):
            names, unit = shared.value
            best_s = np.full((len(names), 0), -2.0)
            best_i = np.zeros((len(names), 0), np.int64)

            def out(best_s, best_i):
                keep = best_s >= max(threshold, -2.5)
                q = np.broadcast_to(names[:, None], best_s.shape)[keep]
                return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(best_i[keep], pa.int64()), pa.array(best_s[keep])], ["query_id", "id", "similarity"])

            for b in batches:
                keys = b.column(0).to_numpy(zero_copy_only=False)
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(float) if len(keys) else np.zeros((0, unit.shape[1]))
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                s = unit @ np.divide(x, norm, out=np.zeros_like(x), where=norm > 0).T
                s = np.where(names[:, None] == keys[None, :], -3.0, s)
                if k is None:
                    yield out(s, np.broadcast_to(keys, s.shape))
                    continue
                best_s, best_i = np.concatenate([best_s, s], 1), np.concatenate([best_i, np.broadcast_to(keys, s.shape)], 1)
                order = np.lexsort((best_i, -best_s.round(9)))[:, :k]
                best_s, best_i = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_i, order, 1)
            yield out(best_s, best_i)

        part = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long"), vec_col).mapInArrow(run, "query_id bigint, id bigint, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, id bigint, similarity double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    ranked = out.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)
