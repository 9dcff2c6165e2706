"""Problem 3: near-duplicate records by an exact Jaccard join.

A text is the set of its runs of 4 successive tokens. Texts of equal tokens form one class first, so copies
cost nothing. The metric-space join (pivots, Voronoi regions, windows of 2r by the triangle inequality, recursion) is exact,
but alone it can't cut this data down: with r = 0.3 the window is 0.6 wide, and unrelated texts lie at 0.95 to 1 from any pivot,
so that every text falls into every window (`replication` measures it). Therefore candidates come from
prefixes first: in any fixed order of the runs, two sets of similarity t share one of the first
|x| - ceil(t |x|) + 1 of each. The order puts runs with more characters first, which are rarer. A run that
more than `bucket` classes share is joined to the runs that follow it, so that texts meet that share two, then three.
Where even these are crowded, texts are close enough for pivots: there the metric join does the
work, level by level. Blocks of a region that no pivot can part are compared with each other, each pair of blocks
in its own task. No pair is lost anywhere, and every one is verified on the whole texts.

Null and empty contents and those below the least number of tokens have no pairs. Rows repeated under the same id count once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

THRESHOLD, RUN, LEAST_TOKENS = 0.7, 4, 60
BUCKET = 1000  # classes of a run that are compared directly
DEPTH = 3  # runs that two texts must have in common before pivots take over
PIVOTS = 32
LEVELS = 4
WHOLE_CLASS = 16  # up to so many byte-equal copies are paired with each other; of more each with the first of them
BROADCAST_IDS = 100_000
SAMPLE = 64  # one text of so many tells which runs are so frequent that their rows must be spread over tasks
SPREAD, HOT = 64, 1 << 62  # over so many parts; the bit of a row's place that marks it
MOST_COLLISIONS = 10_000
TOKEN = re.compile(r"\w+|[^\w\s]")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


class _Words(dict):
    """Token to its place in two growing arrays: a hash, and how much it says."""

    def __init__(self) -> None:
        self.hash, self.weight = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64)

    def __missing__(self, token: str) -> int:
        at = len(self)
        if at == self.hash.size:
            self.hash, self.weight = np.resize(self.hash, 2 * at), np.resize(self.weight, 2 * at)
        self.hash[at] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        self.weight[at] = sum(min(len(p), 8) for p in PART.findall(token)[:2]) or 1
        self[token] = at
        return at


class Runs:
    """Runs of tokens as 64-bit numbers: 8 bits fall with what the run says, 56 are a hash. Sorted, runs with long compound names come first, which are rare."""

    def __init__(self) -> None:
        self.words = _Words()

    def of(self, tokens: list[str]) -> np.ndarray:
        n = len(tokens) - RUN + 1
        if n < 1:
            return np.empty(0, np.uint64)
        words = self.words
        if len(words) > 500_000:
            words = self.words = _Words()
        at = np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens))
        h, w = words.hash[at], words.weight[at]
        with np.errstate(over="ignore"):
            x = h[:n] * _MIX[0]
            total = w[:n].copy()
            for k in range(1, RUN):
                x ^= x >> np.uint64(29)
                x = (x ^ h[k : k + n]) * _MIX[k]
                total += w[k : k + n]
            x ^= x >> np.uint64(32)
        x = ((np.uint64(255) - np.minimum(total, np.uint64(255))) << np.uint64(56)) | (x >> np.uint64(8))
        x.sort()
        keep = np.ones(n, bool)
        np.not_equal(x[1:], x[:-1], out=keep[1:])
        return x[keep]


def _text_key(tokens: list[str]) -> bytes:
    return xxhash.xxh3_128_digest("\n".join(tokens).encode("utf-8", "surrogatepass"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (a.size + b.size - both) if both else 0.0


def least_shared(m: int, n: int, t: float) -> int:
    return math.ceil(t / (1 + t) * (m + n) - 1e-9)


def _short(digest: bytes, collided: frozenset[bytes]) -> int:
    """A class's short name: half of its digest, the other half for the few classes that share their first half."""
    return int.from_bytes(digest[8:] if digest in collided else digest[:8], "little", signed=True)


def members(df: DataFrame, collided: frozenset[bytes] = frozenset()) -> DataFrame:
    """(key, text_key, id, body) once for each row id of (id, content) with enough tokens; key is the class's short name, body a digest of the content as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, whole, bodies = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = TOKEN.findall(text)
                if len(tokens) >= LEAST_TOKENS:
                    digest = _text_key(tokens)
                    ids.append(i)
                    whole.append(digest)
                    bodies.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                    keys.append(_short(digest, collided))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(whole, pa.binary()), pa.array(ids, pa.string()), pa.array(bodies, pa.binary())], ["key", "text_key", "id", "body"])

    return df.mapInArrow(run, "key bigint, text_key binary, id string, body binary").groupBy("key", "text_key", "id").agg(F.min("body").alias("body"))


def prefixes(df: DataFrame, t: float, collided: frozenset[bytes] = frozenset()) -> DataFrame:
    """(run, key, place) for the runs of each text's prefix; place holds size, position and whether it is one of the first that suffice for the shorter text of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, seen = Runs(), set()
        for b in batches:
            out_r, out_k, out_p = [], [], []
            for text in b.column(0).to_pylist():
                tokens = TOKEN.findall(text)
                if len(tokens) < LEAST_TOKENS:
                    continue
                key = _short(_text_key(tokens), collided)
                if key in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                x = runs.of(tokens)
                n = x.size
                probe = n - math.ceil(t * n - 1e-9) + 1
                index = n - math.ceil(2 * t / (1 + t) * n - 1e-9) + 1
                at = np.arange(probe, dtype=np.int64)
                out_r.append(x[:probe].view(np.int64))
                out_k.append(np.full(probe, key, np.int64))
                out_p.append((n << 32) | (at << 1) | (at < index))
            if out_r:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (out_r, out_k, out_p)], ["run", "key", "place"])

    return df.select("content").mapInArrow(run, "run bigint, key bigint, place bigint")


def _pairs_of(runs: np.ndarray, keys: np.ndarray, place: np.ndarray, t: float, shared: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of classes in the same run that size and position don't rule out; runs are sorted."""
    size, at = place >> 32, (place & 0xFFFFFFFF) >> 1
    out_a, out_b = [], []
    i = np.arange(runs.size - 1)
    d = 1
    while i.size:
        i = i[runs[i] == runs[i + d]]
        j = i + d
        m, n = size[i], size[j]
        need = np.ceil(t / (1 + t) * (m + n) - 1e-9)
        first = np.where(m <= n, place[i] & 1, place[j] & 1) | np.where(m == n, place[j] & 1, 0)
        ok = (np.minimum(m, n) >= t * np.maximum(m, n) - 1e-9) & (shared + np.minimum(m - at[i], n - at[j]) - 1 >= need) & (first == 1) & (keys[i] != keys[j])
        a, b = keys[i[ok]], keys[j[ok]]
        out_a.append(np.minimum(a, b))
        out_b.append(np.maximum(a, b))
        d += 1
        i = i[i + d < runs.size]
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, np.int64),) * 2


def frequent(sampled: DataFrame, bucket: int) -> list[int]:
    """Of the rows of one text in SAMPLE, the runs that stand for some 16 buckets of texts or more, the most frequent first, BROADCAST_IDS at most.

    This decides only where rows go, not what is found: the rows of a run that isn't told here pass one task as a stream.
    """
    n = sampled.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") >= max(64, 16 * bucket // SAMPLE))
    return [r["run"] for r in n.orderBy(F.desc("n"), "run").limit(BROADCAST_IDS).collect()]


def marked(rows: DataFrame, hot: list[int]) -> DataFrame:
    """The rows with the HOT bit set in the place of those of frequent runs."""
    if not hot:
        return rows
    known = rows.sparkSession.createDataFrame([(r,) for r in hot], "run long").withColumn("hot", F.lit(HOT))
    return rows.join(F.broadcast(known), "run", "left").select("run", "key", F.col("place").bitwiseOR(F.coalesce("hot", F.lit(0))).alias("place"))


def candidates(rows: DataFrame, t: float, bucket: int, shared: int = 1) -> DataFrame:
    """(a, b, run): pairs of classes to verify, run null; and of runs with more than `bucket` classes a row (key, place, run) each.

    The rows of a task are sorted and pass as a stream; only up to `bucket` rows are held at a time. Rows marked as those of a frequent
    run are spread over SPREAD parts and all given out as such.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(a, b, r):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64()) if r is None else pa.array(r, pa.int64())], ["a", "b", "run"])

        held_r = held_k = held_p = np.empty(0, np.int64)
        spilled = None  # the run that is passed through
        for b in batches:
            r, k, p = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            r, k, p = np.concatenate([held_r, r]), np.concatenate([held_k, k]), np.concatenate([held_p, p])
            known = p >= HOT
            if known.any():
                yield batch(k[known], p[known] ^ HOT, r[known])
                r, k, p = r[~known], k[~known], p[~known]
            if not r.size:
                continue
            keep = np.ones(r.size, bool)
            keep[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
            r, k, p = r[keep], k[keep], p[keep]
            starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            ends = np.append(starts[1:], r.size)
            open_from = starts[-1]
            hot = [(x, y) for x, y in zip(starts[ends - starts > bucket], ends[ends - starts > bucket]) if y < r.size and r[x] != spilled]
            if spilled is not None and r[0] == spilled and len(starts) > 1:
                hot.append((0, ends[0]))
            plain = np.ones(open_from, bool)
            for x, y in hot:
                plain[x:y] = False
            x, y = _pairs_of(r[:open_from][plain], k[:open_from][plain], p[:open_from][plain], t, shared)
            if x.size:
                yield batch(x, y, None)
            for s, e in hot:
                yield batch(k[s:e], p[s:e], r[s:e])
            if r.size - open_from > bucket or r[open_from] == spilled:
                yield batch(k[open_from:], p[open_from:], r[open_from:])
                spilled = r[-1]
                held_r, held_k, held_p = (np.empty(0, np.int64),) * 3
            else:
                held_r, held_k, held_p = r[open_from:], k[open_from:], p[open_from:]
        if held_r.size > 1:
            x, y = _pairs_of(held_r, held_k, held_p, t, shared)
            yield batch(x, y, None)

    part = F.when(F.col("place") >= HOT, F.pmod(F.xxhash64("key"), F.lit(SPREAD))).otherwise(0)
    parts = rows.repartition("run", part).sortWithinPartitions("run", "key")
    return parts.mapInArrow(run, "a bigint, b bigint, run bigint")


def _verify(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()
        for batch in batches:
            keep_a, keep_b, sim = [], [], []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                s = jaccard(runs.of(TOKEN.findall(x)), runs.of(TOKEN.findall(y)))
                if s >= t:
                    keep_a.append(a)
                    keep_b.append(b)
                    sim.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64()), pa.array(sim, pa.float64())], ["a", "b", "similarity"])

    return run


def _contents(df: DataFrame, firsts: DataFrame) -> DataFrame:
    """(key, content) for (key, id): the wanted ids are few, so they go to the rows where their number allows it."""
    small = firsts.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    wanted = F.broadcast(firsts) if small else firsts
    return df.join(wanted, "id").select("key", "content").dropDuplicates(["key"])


def voronoi(state: DataFrame, t: float, bucket: int = BUCKET, pivots: int = PIVOTS, levels: int = LEVELS) -> DataFrame:
    """(a, b, similarity) of all pairs within the regions of state(region string, key, runs binary, core boolean).

    A pair counts where one of the two is core. Each level gives every text to the region of its nearest pivot as core
    and copies it to each region j with d(p_j) <= d(nearest) + 2 (1 - t); if x is core in region i and d(x, y) <= 1 - t, the
    triangle inequality puts y into that window. Regions of up to `bucket` texts are compared at once. Those still larger
    after the last level are cut into blocks, and each pair of blocks is compared.
    """
    spark = state.sparkSession
    schema = "region string, key bigint, runs binary, core boolean"
    result = None

    def add(x):
        nonlocal result
        x = x.select("a", "b", "similarity")
        result = x if result is None else result.unionByName(x)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("core", ascending=False, kind="stable").drop_duplicates(["side", "key"])
        sets = [np.frombuffer(x, np.uint64) for x in pdf["runs"]]
        keys, core, side = pdf["key"].tolist(), pdf["core"].tolist(), pdf["side"].tolist()
        alone = len(set(side)) == 1
        out = []
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                if (core[i] or core[j]) and keys[i] != keys[j] and (alone or side[i] != side[j]):
                    m, n = sorted((sets[i].size, sets[j].size))
                    if m >= t * n - 1e-9 and (s := jaccard(sets[i], sets[j])) >= t:
                        out.append((min(keys[i], keys[j]), max(keys[i], keys[j]), s))
        return pd.DataFrame(out, columns=["a", "b", "similarity"])

    pair_schema = "a bigint, b bigint, similarity double"
    blocks_of: list[DataFrame] = []
    for level in range(levels + 1):
        sizes = state.groupBy("region").agg(F.count("*").alias("n"), F.max("core").alias("any"))
        state = cut(state.join(sizes.where("any"), "region"))
        add(state.where(F.col("n") <= bucket).withColumn("side", F.lit(0)).groupBy("region").applyInPandas(compare, pair_schema))
        state = state.where(F.col("n") > bucket)
        if state.isEmpty():
            break
        if level == levels:
            blocks_of.append(state.select("region", "key", "runs", "core", "n"))
            break
        order = Window.partitionBy("region").orderBy(F.xxhash64("key", F.lit(level)), "key")
        few = state.select("region", "key", "runs").where(F.pmod(F.xxhash64("key", F.lit(level)), F.greatest(F.lit(1), F.floor(F.col("n") / (4 * pivots)))) == 0)
        chosen = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pivots)
        chosen = chosen.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("rank", "runs"))).alias("p"))

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                near, window = [], []
                for runs, p in zip(b["runs"], b["p"]):
                    x = np.frombuffer(runs, np.uint64)
                    d = np.array([1 - jaccard(x, np.frombuffer(q["runs"], np.uint64)) for q in p]) if p is not None and len(p) else np.zeros(1)
                    near.append(int(d.argmin()))
                    window.append(np.flatnonzero(d <= d.min() + 2 * (1 - t) + 1e-9).astype(np.int32))
                yield b[["region", "key", "runs", "core"]].assign(near=near, window=window)

        placed = cut(state.join(chosen, "region", "left").select("region", "key", "runs", "core", "p").mapInPandas(assign, schema + ", near int, window array<int>"))
        # dividing a region pays while its texts lie in fewer than the square root of its regions on average
        pays = placed.groupBy("region").agg((F.avg(F.size("window")) ** 2 < F.max(F.array_max("window")) + 1).alias("pays"), F.count("*").alias("n"))
        placed = placed.join(pays, "region")
        blocks_of.append(placed.where("not pays").select("region", "key", "runs", "core", "n"))
        inside = placed.where("pays").select("region", "key", "runs", "core", "near", F.explode("window").alias("j"))
        state = inside.select(F.concat_ws("/", "region", "j").alias("region"), "key", "runs", (F.col("core") & (F.col("j") == F.col("near"))).alias("core"))
    # what pivots can't part: all blocks of a region against each other
    if not blocks_of:
        return result
    left = blocks_of[0]
    for x in blocks_of[1:]:
        left = left.unionByName(x)
    blocks = left.withColumn("blocks", F.ceil(F.col("n") / bucket).cast("int")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    meet = blocks.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    meet = meet.select("key", "runs", "core", F.format_string("%s#%d-%d", "region", F.least("block", "other"), F.greatest("block", "other")).alias("region"), F.when(F.col("block") == F.col("other"), 0).otherwise(F.when(F.col("block") < F.col("other"), 1).otherwise(2)).alias("side"))
    add(meet.groupBy("region").applyInPandas(compare, pair_schema))
    return result


def deepen(hot: DataFrame, texts: DataFrame, t: float, shared: int) -> DataFrame:
    """(run, key, place): for each (run, key, place) shared by too many texts, that run together with each that follows it in the text.

    A pair of similarity t shares `shared` of the first |x| - ceil(t |x|) + `shared` runs of each text, so the runs from the
    place on to there suffice for all pairs whose first common ones these are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()
        for b in batches:
            for r, k, p, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                x = runs.of(TOKEN.findall(text))
                n, at = x.size, (p & 0xFFFFFFFF) >> 1
                end = min(n, n - math.ceil(t * n - 1e-9) + shared)
                if end <= at + 1:
                    continue
                with np.errstate(over="ignore"):
                    mixed = ((x[at + 1 : end] ^ np.uint64(r & 0xFFFFFFFFFFFFFFFF)) * _MIX[0]) ^ (x[at + 1 : end] >> np.uint64(31))
                place = (n << 32) | (np.arange(at + 1, end, dtype=np.int64) << 1) | 1
                yield pa.RecordBatch.from_arrays([pa.array(mixed.view(np.int64)), pa.array(np.full(end - at - 1, k, np.int64)), pa.array(place)], ["run", "key", "place"])

    return hot.join(texts, "key").select("run", "key", "place", "content").mapInArrow(run, "run bigint, key bigint, place bigint")


def class_pairs(df: DataFrame, firsts: DataFrame, t: float = THRESHOLD, bucket: int = BUCKET, depth: int = DEPTH, collided: frozenset[bytes] = frozenset()) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of classes of df(id, content) at similarity t or more; firsts is (key, id)."""
    some = prefixes(df.where(F.pmod(F.xxhash64("content"), F.lit(SAMPLE)) == 0), t, collided)
    rows, pairs, hot = marked(prefixes(df, t, collided), frequent(some, bucket)), None, None
    for shared in range(1, depth + 1):
        found = cut(candidates(rows, t, bucket, shared))
        got = found.where("run is null").select("a", "b")
        pairs = got if pairs is None else pairs.union(got)
        hot = found.where("run is not null").select("run", F.col("a").alias("key"), F.col("b").alias("place")).distinct()
        if hot.isEmpty():
            hot = None
            break
        hot = cut(hot)
        texts = _contents(df, firsts.join(hot.select("key").distinct(), "key", "left_semi"))
        if shared < depth:
            some = deepen(hot.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0), texts, t, shared + 1)
            rows = marked(deepen(hot, texts, t, shared + 1), frequent(some, bucket))
    pairs = cut(pairs.distinct())
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    content = cut(_contents(df, firsts.join(wanted, "key", "left_semi")))
    both = pairs.join(content.select(F.col("key").alias("a"), F.col("content").alias("x")), "a").join(content.select(F.col("key").alias("b"), F.col("content").alias("y")), "b")
    close = both.select("a", "b", "x", "y").mapInArrow(_verify(t), "a bigint, b bigint, similarity double")
    if hot is not None:

        def sets(batches):
            runs = Runs()
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([runs.of(TOKEN.findall(x)).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["key", "runs"])

        state = hot.select(F.hex("run").alias("region"), "key").join(texts.mapInArrow(sets, "key bigint, runs binary"), "key").select("region", "key", "runs", F.lit(True).alias("core"))
        close = close.unionByName(voronoi(state, t, bucket))
    return close.dropDuplicates(["a", "b"])


def _classes(df: DataFrame):
    """(members, (key, first id, copies) of each class, classes whose short names would collide)."""
    who = cut(members(df))
    collided: frozenset[bytes] = frozenset()
    stats = cut(who.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.min("text_key").alias("low"), F.max("text_key").alias("high")))
    same = stats.where("low != high")
    if not same.isEmpty():
        # a chance of 2^-64 for two classes: a handful at any size
        rows = who.join(same.select("key"), "key", "left_semi").select("text_key").distinct().limit(MOST_COLLISIONS + 1).collect()
        if len(rows) > MOST_COLLISIONS:
            raise ValueError("digests collide more often than can be by chance")
        collided = frozenset(bytes(r["text_key"]) for r in rows)
        who = cut(members(df, collided))
        stats = cut(who.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    return who, stats.select("key", "first", "copies"), collided


def source(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("chunk_type").isin("function", "method") & (F.length("content") >= LEAST_TOKENS)).select(F.col("chunk_id").alias("id"), "content").where("id is not null")


def similar(df: DataFrame, t: float = THRESHOLD, bucket: int = BUCKET) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b, for df(id, content).

    Texts of equal tokens have similarity 1. Every pair is given, within classes and across them, but for contents that more than
    WHOLE_CLASS ids have byte by byte: there each copy is paired with the first id, which alone stands for them towards
    others (`groups` tells all members). Texts that differ in layout are no such copies.
    """
    who, stats, collided = _classes(df)
    near = class_pairs(df, stats.select("key", F.col("first").alias("id")), t, bucket, collided=collided)
    equal = who.groupBy("key", "body").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    known = cut(who.join(equal, ["key", "body"]))
    stands = known.where((F.col("copies") <= WHOLE_CLASS) | (F.col("id") == F.col("first"))).select("key", "id")
    across = near.join(stands.select(F.col("key").alias("a"), F.col("id").alias("x")), "a").join(stands.select(F.col("key").alias("b"), F.col("id").alias("y")), "b").select("x", "y", "similarity")
    several = stands.join(stats.where("copies > 1").select("key"), "key", "left_semi")
    inside = several.select("key", F.col("id").alias("x")).join(several.select("key", F.col("id").alias("y")), "key").where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    star = known.where((F.col("copies") > WHOLE_CLASS) & (F.col("id") != F.col("first"))).select(F.col("first").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("similarity"))
    every = across.unionByName(star).unionByName(inside)
    return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def groups(df: DataFrame, t: float = THRESHOLD, bucket: int = BUCKET) -> DataFrame:
    """(id, group_id, class_size, n_links) of every record that has a near-duplicate; group_id is the group's least id.

    Groups are connected components over classes, found by passing on the least label and jumping to the label's label.
    n_links counts the other classes within the threshold.
    """
    who, stats, collided = _classes(df)
    near = cut(class_pairs(df, stats.select("key", F.col("first").alias("id")), t, bucket, collided=collided))
    named = stats.select("key", "first")
    edges = near.select("a", "b").join(named.select(F.col("key").alias("a"), F.col("first").alias("u")), "a").join(named.select(F.col("key").alias("b"), F.col("first").alias("v")), "b").select("u", "v")
    edges = cut(edges.union(edges.select("v", "u")).toDF("u", "v"))
    label = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l"))
    label = cut(label)
    while True:
        seen = edges.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = label.join(seen, "u").select("u", "l", F.least("l", "m").alias("m"))
        jump = step.join(label.select(F.col("u").alias("m"), F.col("l").alias("far")), "m", "left").select("u", "l", F.least("m", F.coalesce("far", "m")).alias("m"))
        jump = cut(jump)
        if jump.where("l != m").isEmpty():
            break
        label = jump.select("u", F.col("m").alias("l"))
    links = edges.groupBy("u").agg(F.count("*").cast("int").alias("n_links"))
    known = who.join(stats, "key").join(label, F.col("u") == F.col("first"), "left").drop("u").join(links, F.col("u") == F.col("first"), "left").drop("u")
    known = known.where("copies > 1 or n_links > 0")
    return known.select("id", F.coalesce("l", "first").alias("group_id"), F.col("copies").cast("int").alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def replication(df: DataFrame, pivots: int = PIVOTS, t: float = THRESHOLD) -> DataFrame:
    """(regions, texts): in how many of the first level's regions the texts of df(id, content) fall; the measure of the bare metric join."""
    firsts = df.orderBy(F.xxhash64("id")).limit(pivots).collect()  # the pivots: a fixed number
    chosen = [Runs().of(TOKEN.findall(r["content"])) for r in firsts]

    def run(batches):
        runs = Runs()
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                d = np.array([1 - jaccard(runs.of(TOKEN.findall(text)), p) for p in chosen])
                out.append(int((d <= d.min() + 2 * (1 - t)).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32())], ["regions"])

    return df.select("content").mapInArrow(run, "regions int").groupBy("regions").agg(F.count("*").alias("texts"))
