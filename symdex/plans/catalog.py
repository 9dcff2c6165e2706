"""The engine's own queries and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.queries import CLUSTERS, cluster_lookup, expand_query, parse_query, window
from ..operators import assemble, changes, graph, lexical, rank, vectors
from ..session import checkpoint_dir, cut, read
from ..store import Files, bucket_of
from ..streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]

WORDS, PHRASE = "ledger rebuilt cohort missing index", '"search falls back" roster'
CODE, NEEDLE, GLOB = "flush ledgerIndex archive", "Ledger", "**/tests/**/*.py"
BUDGET = 400


# -- tables


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunk once: the row indexed last."""
    every = read(spark, sf, "chunks")
    rest = [c for c in every.columns if c not in ("chunk_id", "indexed_at")]
    return every.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), "indexed_at").alias("x")).select("chunk_id", "x.*")


def chunk_fields(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Some fields of each chunk once; fields that are the same in all rows of a chunk."""
    return read(spark, sf, "chunks").select("chunk_id", *cols).dropDuplicates(["chunk_id"])


def files(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "source_files").select("file_id", "repo_id", "file_path", "content", "mtime").dropDuplicates(["file_id"])


# -- recall


def bm25_topk(spark, sf):
    return lexical.top(lexical.bm25(documents(spark, sf), F.col("text"), parse_query(WORDS)), "doc_id", 20).withColumnRenamed("id", "doc_id")


def bm25_phrase(spark, sf):
    return lexical.top(lexical.bm25(documents(spark, sf), F.col("text"), parse_query(PHRASE)), "doc_id", 20).withColumnRenamed("id", "doc_id")


def _blob() -> F.Column:
    return X.search_blob(F.col("symbol"), F.col("qualified_name"), F.col("imports"), F.col("signature"), F.col("docstring"), F.col("content"))


def _code(spark, sf, query):
    c = chunk_fields(spark, sf, "symbol", "qualified_name", "imports", "signature", "docstring", "content", "language", "file_path")
    return lexical.bm25(c, _blob(), parse_query(query))


def bm25_filtered(spark, sf):
    hits = _code(spark, sf, CODE).where((F.col("language") == "python") & F.col("file_path").rlike(X.glob_regex("*/tests/*")))
    return lexical.top(hits, "chunk_id", 20).withColumnRenamed("id", "chunk_id")


def postings_terms(spark, sf):
    p = lexical.postings(documents(spark, sf), "doc_id", F.col("text"))
    return p.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("total")).where("doc_freq >= 3")


def bm25_from_postings(spark, sf):
    p = lexical.postings(documents(spark, sf), "doc_id", F.col("text"))
    totals = documents(spark, sf).select(F.size(X.tokens(F.coalesce("text", F.lit("")))).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_len"))
    return lexical.top(lexical.bm25_postings(p, totals, parse_query(PHRASE)), "id", 20).withColumnRenamed("id", "doc_id")


def _symbols(spark, sf, query):
    c = chunk_fields(spark, sf, "symbol", "qualified_name")
    return lexical.substring(c, F.concat_ws(" ", "symbol", "qualified_name"), query)


def substring_channel(spark, sf):
    return lexical.top(_symbols(spark, sf, NEEDLE), "chunk_id", 20).withColumnRenamed("id", "chunk_id")


def _recall(spark, sf, query, n=20):
    a = lexical.top(_code(spark, sf, query), "chunk_id", n)
    b = lexical.top(_symbols(spark, sf, query), "chunk_id", n)
    return cut(rank.fuse([a, b]))  # a few rows, which the next steps use more than once


def rrf_hybrid(spark, sf):
    return _recall(spark, sf, NEEDLE).select(F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"))


def _placed(spark, sf):
    return chunk_fields(spark, sf, "file_path").select(F.col("chunk_id").alias("id"), X.module_name(F.col("file_path")).alias("module"))


def graph_boost(spark, sf):
    edges = graph.edges(chunk_fields(spark, sf, "chunk_type", "file_path", "start_line", "end_line", "imports"))
    return rank.boost(_recall(spark, sf, NEEDLE), _placed(spark, sf), edges).select(F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"))


def rerank_heuristic(spark, sf):
    c = chunk_fields(spark, sf, "symbol", "qualified_name", "signature", "docstring").withColumn("score", F.lit(0.0)).withColumnRenamed("chunk_id", "id")
    return rank.rerank(c, "flush ledger archive").select(F.col("id").alias("chunk_id"), "score")


def diversify(spark, sf):
    hits = _code(spark, sf, CODE).select(F.col("chunk_id").alias("id"), F.round("score", 6).alias("score"), "file_path")
    return rank.diversify(hits.select("id", "score", "file_path"), "file_path").select(F.col("id").alias("chunk_id"), F.round("score", 6).alias("score"))


def search_pipeline(spark, sf):
    return search(read(spark, sf, "chunks").drop("indexed_at", "repo_id").dropDuplicates(["chunk_id"]), "flush ledger", 10)


def index_tables(chunks: DataFrame, buckets: int) -> dict[str, DataFrame]:
    """What an index holds of chunks, cut into buckets by file: `words` and `grams` (postings sorted by term) and `sizes` (one row a bucket).

    The terms of a query are looked up in each bucket, where they prune row groups.
    """
    rows = chunks.select("chunk_id", bucket_of(F.col("file_path"), buckets).alias("bucket"), _blob().alias("blob"), F.concat_ws(" ", "symbol", "qualified_name").alias("names"))
    n = F.greatest(F.length("names") - 2, F.lit(0))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n_docs"), F.sum(F.size(X.tokens(F.col("blob")))).alias("words"), F.sum(n).alias("grams"))

    def sorted_by_term(p: DataFrame) -> DataFrame:
        return p.repartition("bucket").sortWithinPartitions("bucket", "term", "id")

    return {"words": sorted_by_term(lexical.postings(rows, "chunk_id", F.col("blob"), ("bucket",))), "grams": sorted_by_term(lexical.postings(rows, "chunk_id", F.col("names"), ("bucket",), lexical.grams)), "sizes": sizes}


def _recalled(index: dict[str, DataFrame], name: str, phrases: list[list[str]]) -> DataFrame | None:
    """(id, score) of a channel from its stored postings; None if there is nothing to look for."""
    if not phrases:
        return None
    totals = index["sizes"].agg(F.sum("n_docs").alias("n_docs"), (F.sum(name) / F.sum("n_docs")).alias("avg_len"))
    return lexical.bm25_postings(index[name], totals, phrases)


def search(chunks: DataFrame, query: str, k: int = 5, language: str | None = None, path_glob: str | None = None, custom: dict[str, list[str]] | None = None, edges: DataFrame | None = None, expand: bool = True, heuristics: bool = True, spread: bool = True, index: dict[str, DataFrame] | None = None, nearest=None) -> DataFrame:
    """(chunk_id, file_path, symbol, score) of the k best chunks.

    Expand, recall by words and by substring, fuse, boost, cut to k, rerank by the query as asked, spread over files. Filters
    apply after the statistics, which are those of all chunks. With the tables of `index_tables` no text is read before the
    best are known, and of chunks only the rows of what was recalled.
    """
    expanded, n = expand_query(query, custom, nearest=nearest) if expand else query, lexical.recall_size(k)
    phrases = parse_query(expanded)
    narrow = chunks.select("chunk_id", "symbol", "qualified_name", "language", "file_path")
    none = narrow.where(F.lit(False)).withColumn("score", F.lit(0.0))

    def kept(rows: DataFrame) -> DataFrame:
        rows = rows.where(F.col("language") == language) if language else rows
        return rows.where(F.col("file_path").rlike(X.glob_regex(path_glob))) if path_glob else rows

    if index is None:
        code = lexical.bm25(chunks.select(*narrow.columns, "imports", "signature", "docstring", "content"), _blob(), phrases) if phrases else none
        names = lexical.substring(narrow, F.concat_ws(" ", "symbol", "qualified_name"), expanded)
        lists = [lexical.top(kept(code), "chunk_id", n), lexical.top(kept(names), "chunk_id", n)]
    else:
        lists = []
        for name, wanted in (("words", phrases), ("grams", lexical.gram_phrases(expanded))):
            hits = _recalled(index, name, wanted)
            if hits is None:
                hits = none.select(F.col("chunk_id").alias("id"), "score")
            elif language or path_glob:
                hits = kept(narrow).join(hits, F.col("chunk_id") == F.col("id")).select("id", "score")
            lists.append(lexical.top(hits, "id", n))
    fused = cut(rank.fuse(lists))
    edges = graph.edges(chunks) if edges is None else edges
    if index is not None:
        # at most two recall lists of ids, by which the sorted chunks prune
        chunks = chunks.where(F.col("chunk_id").isin([r["id"] for r in fused.select("id").collect()]))
    placed = chunks.select(F.col("chunk_id").alias("id"), X.module_name(F.col("file_path")).alias("module"))
    boosted = rank.boost(fused, placed, edges)
    best = boosted.select("id", F.bround("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    meta = chunks.select(F.col("chunk_id").alias("id"), "symbol", "qualified_name", "signature", "docstring", "file_path")
    ranked = meta.join(F.broadcast(best), "id")
    ranked = rank.rerank(ranked, query) if heuristics else ranked
    ranked = rank.diversify(ranked, "file_path") if spread else ranked
    return ranked.select(F.col("id").alias("chunk_id"), "file_path", "symbol", "score")


def _stored(spark, sf: str, name: str, make) -> DataFrame:
    """A table made once for the data of sf in the shared folder, as an index is, and read from there."""
    import hashlib

    path = f"{checkpoint_dir(spark)}/stored-{hashlib.sha256(os.path.realpath(sf).encode()).hexdigest()[:16]}/{name}"
    if not Files(spark).exists(f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def bm25_stored(spark, sf):
    """bm25_topk from stored postings."""
    p = _stored(spark, sf, "postings", lambda: lexical.postings(documents(spark, sf), "doc_id", F.col("text")).repartition(16, "term").sortWithinPartitions("term", "id"))
    totals = _stored(spark, sf, "totals", lambda: documents(spark, sf).select(F.size(X.tokens(F.coalesce("text", F.lit("")))).alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_len")))
    return lexical.top(lexical.bm25_postings(p, totals, parse_query(WORDS)), "id", 20).withColumnRenamed("id", "doc_id")


def search_stored(spark, sf):
    """search_pipeline on the stored index of the chunks."""
    once = read(spark, sf, "chunks").drop("indexed_at", "repo_id").dropDuplicates(["chunk_id"])
    c = _stored(spark, sf, "chunks", lambda: once.repartitionByRange(16, "chunk_id").sortWithinPartitions("chunk_id"))
    made = index_tables(c, 8)
    index = {k: _stored(spark, sf, k, lambda k=k: made[k]) for k in made}
    return search(c, "flush ledger", 10, edges=_stored(spark, sf, "edges", lambda: graph.edges(c)), index=index)


# -- text functions


def camel_split(spark, sf):
    return chunk_fields(spark, sf, "symbol").select("chunk_id", F.array_join(X.camel_parts(F.col("symbol")), " ").alias("parts"))


def identifier_parts(spark, sf):
    return chunk_fields(spark, sf, "signature").select("chunk_id", X.split_identifiers(F.coalesce("signature", F.lit(""))).alias("parts"))


def terms_dedup(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(F.array_sort(X.terms(F.coalesce("text", F.lit("")))), " ").alias("terms"))


def cjk_bigrams(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(X.cjk_bigrams(F.coalesce("text", F.lit(""))), " ").alias("pairs"))


def sanitize_phrase(spark, sf):
    return chunk_fields(spark, sf, "signature").select("chunk_id", X.sanitize_phrase(F.coalesce("signature", F.lit(""))).alias("phrase"))


def glob_filter(spark, sf):
    return chunk_fields(spark, sf, "file_path").where(F.col("file_path").rlike(X.glob_regex(GLOB))).select("chunk_id")


def content_hash(spark, sf):
    return chunk_fields(spark, sf, "content").select("chunk_id", X.content_hash(F.col("content")).alias("digest"))


def token_estimate(spark, sf):
    return documents(spark, sf).where("text is not null").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


def language_of(spark, sf):
    return files(spark, sf).select("file_id", X.language_of(F.col("file_path")).alias("language"))


def symbol_rules(spark, sf):
    c = chunk_fields(spark, sf, "symbol", "language", "signature")
    return c.select("chunk_id", X.is_private(F.col("symbol"), F.col("language")).alias("private"), X.is_async(F.col("signature"), F.col("language")).alias("asynchronous"))


def chunk_rows(spark, sf):
    """Chunks as flat rows and back."""
    c = chunk_fields(spark, sf, "imports", "parent_class", "docstring")
    again = changes.from_rows(changes.to_rows(c))
    return again.select("chunk_id", F.array_join("imports", "|").alias("imports"), "parent_class", "docstring")


def graph_node_fields(spark, sf):
    n = graph.detailed_nodes(_graph_chunks(spark, sf))
    return n.select("name", "type", "lines_of_code", F.array_join("exports", " ").alias("exports"), "signature", "is_private")


def query_phrases(spark, sf):
    return spark.createDataFrame([(q, i, " ".join(p)) for q in (WORDS, PHRASE, CODE, "检索引擎 parseHTTPServer_index") for i, p in enumerate(parse_query(q))], "query string, position int, phrase string")


# -- results


def window_fetch(spark, sf):
    return assemble.fetch(read(spark, sf, "requests"), files(spark, sf))


def window_presets(spark, sf):
    before, after = window("minimal")
    asked = read(spark, sf, "requests").withColumns({"context_before": F.lit(before), "context_after": F.lit(after)})
    got = assemble.fetch(asked, files(spark, sf))
    return got.select("idx", "first", "last", F.length("content").alias("chars"))


def _costs(spark, sf):
    c = chunk_fields(spark, sf, "file_path", "qualified_name", "signature", "language", "chunk_type", "content", "start_line")
    return assemble.chunk_cost(c, "content").select("file_path", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "chunk_id")).alias("position"), "cost")


def budget_pack(spark, sf):
    return assemble.pack(_costs(spark, sf), "file_path", "position", "cost", BUDGET)


def assembled(spark, sf):
    packed = budget_pack(spark, sf)
    return packed.groupBy("file_path").agg(F.max("running").alias("token_estimate"), F.sum(F.col("included").cast("int")).alias("n_results"), F.max(~F.col("included")).alias("truncated"))


# -- graph


def _graph_chunks(spark, sf):
    """Chunks whose modules also import the next module of their repository, by its name or as a path: the files' own imports rarely name each other."""
    c = chunk_fields(spark, sf, "repo_id", "chunk_type", "file_path", "symbol", "signature", "start_line", "end_line", "imports")
    following = F.regexp_extract(F.lead("file_path").over(Window.partitionBy("repo_id", "chunk_type").orderBy("file_path")), r"([^/]+)\.[^./]+$", 1)
    linked = F.when(F.col("start_line") % 2 == 0, F.concat(F.lit("../near/"), following, F.lit(".ts"))).otherwise(following)
    return c.withColumn("imports", F.when((F.col("chunk_type") == "module") & linked.isNotNull(), F.concat("imports", F.array(linked))).otherwise(F.col("imports")))


def module_naming(spark, sf):
    return files(spark, sf).select("file_id", X.module_name(F.col("file_path")).alias("module"))


def graph_nodes(spark, sf):
    return graph.nodes(_graph_chunks(spark, sf))


def graph_edges(spark, sf):
    return graph.edges(_graph_chunks(spark, sf))


def graph_stats(spark, sf):
    return graph.stats(_graph_chunks(spark, sf))


def graph_exports(spark, sf):
    return graph.exports(_graph_chunks(spark, sf)).select("name", F.array_join("exports", " ").alias("exports"))


def neighbors(spark, sf):
    return graph.neighbours(graph.edges(_graph_chunks(spark, sf)))


def module_context(spark, sf):
    return graph.context(_graph_chunks(spark, sf))


# -- index maintenance


def file_symbols(spark, sf):
    return chunk_fields(spark, sf, "file_path", "chunk_type", "symbol", "start_line").withColumn("position", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "chunk_id"))).select("file_path", "position", "chunk_type", "symbol")


def project_symbols_top20(spark, sf):
    c = chunk_fields(spark, sf, "file_path", "chunk_type", "symbol", "start_line").where(F.col("chunk_type").isin("function", "class"))
    return rank.top_per_group(c, "file_path", [F.col("start_line"), F.col("chunk_id")], 20).select("file_path", "symbol", "start_line")


def symbols_by_file(spark, sf):
    c = chunk_fields(spark, sf, "file_path", "chunk_type").where(F.col("chunk_type").isin("function", "class"))
    return c.groupBy("file_path").agg(F.count("*").alias("symbols"), F.greatest(F.count("*") - 20, F.lit(0)).alias("more"))


def file_imports(spark, sf):
    return chunk_fields(spark, sf, "file_path", "chunk_type", "imports").where("chunk_type = 'module'").select("file_path", F.array_join(F.slice("imports", 1, 20), " ").alias("imports"))


def index_status(spark, sf):
    return read(spark, sf, "chunks").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.countDistinct("file_path").alias("n_files"))


def _versions(spark, sf):
    """Two states of the index that the log of events tells apart: the old one lacks the chunks of files created since, the new one those of files deleted, and what was modified has another digest."""
    c = chunk_fields(spark, sf, "file_path", "content_hash")
    ops = E.once(read(spark, sf, "file_events")).groupBy("path").agg(F.max_by("op", F.struct("ts", "event_id")).alias("op"))
    seen = c.join(ops.withColumnRenamed("path", "file_path"), "file_path", "left")
    old = seen.where("op is null or op <> 'created'").select("chunk_id", "content_hash")
    new = seen.where("op is null or op not in ('deleted', 'moved')").select("chunk_id", F.when(F.col("op") == "modified", F.sha2("content_hash", 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return old, new


def manifest_diff(spark, sf):
    return changes.manifest_diff(*_versions(spark, sf))


def change_counters(spark, sf):
    return manifest_diff(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


def upsert_merge(spark, sf):
    old, new = (x.select("chunk_id", "content_hash") for x in _versions(spark, sf))
    return changes.upsert(old, new)


def file_diff(spark, sf):
    f = files(spark, sf)
    since = F.lit("2025-06-01").cast("timestamp")
    return changes.file_diff(read(spark, sf, "chunks").select("file_path"), f, changes.changed_since(f, "mtime", since))


def mtime_changed(spark, sf):
    return changes.changed_since(files(spark, sf), "mtime", F.lit("2025-06-01").cast("timestamp")).select("file_id")


def delete_file(spark, sf):
    gone = E.once(read(spark, sf, "file_events")).where("op = 'deleted'").select(F.col("path").alias("file_path"))
    return changes.delete(chunk_fields(spark, sf, "file_path"), gone, "file_path")


def collision_ids(spark, sf):
    c = chunk_fields(spark, sf, "file_path", "symbol", "start_line")
    made = changes.with_collision_ids(c.withColumnRenamed("chunk_id", "old"), F.concat_ws("::", "file_path", "symbol"), F.col("file_path"), [F.col("start_line"), F.col("old")], F.col("start_line"))
    return made.select("old", F.col("chunk_id").alias("new"))


def block_islands(spark, sf):
    e = E.once(read(spark, sf, "file_events"))
    return changes.islands(e, "path", [F.col("ts"), F.col("event_id")], F.col("op").isin("deleted", "moved")).select("event_id", "block", "blocks")


# -- synonyms and vectors


def synonym_expand(spark, sf):
    queries = ["load user file", "flush cache", "parse config error", "unknownword", "find find auth"]
    return spark.createDataFrame([(q, expand_query(q)) for q in queries], "query string, expanded string")


def synonym_lookup(spark, sf):
    table = spark.createDataFrame([(w, s) for w, group in cluster_lookup(CLUSTERS).items() for s in group if s != w], "word string, synonym string")
    first = documents(spark, sf).where("length(text) > 0").select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("word"))
    return first.join(F.broadcast(table), "word").groupBy("word", "synonym").agg(F.count("*").alias("n"))


def _vectors(spark, sf):
    return read(spark, sf, "embeddings")


def cosine_knn(spark, sf):
    v = _vectors(spark, sf)
    return vectors.nearest(v, v.where("vec_id % 100 = 0"), 3).select("query_id", "id", "rank", F.round("similarity", 6).alias("similarity"))


def cosine_threshold(spark, sf):
    v = _vectors(spark, sf)
    return vectors.nearest(v, v.where("vec_id % 100 = 0"), None, threshold=0.3).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


# -- events


def move_explode(spark, sf):
    return E.actions(E.once(read(spark, sf, "file_events"))).select("event_id", "path", "action")


def debounce_batch(spark, sf):
    return E.debounce(E.once(read(spark, sf, "file_events")), "path", "ts", tie="event_id").select("event_id", "path", "ts")


def latest_event(spark, sf):
    return E.latest(E.once(read(spark, sf, "file_events")), "path", "ts")


def cooldown_batch(spark, sf):
    return E.cooldown(E.once(read(spark, sf, "file_events")).select("path", "ts"), "path", "ts", 3600.0)


def stream_sessions(spark, sf):
    """The watcher's log as a stream: all bursts of each path, written by exactly-once batches. The log is finished, so a closing row ends its last sessions."""
    import uuid

    folder, late = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}", "30 days"

    def timed(log: DataFrame) -> DataFrame:
        kept = log.where("ts is not null and path is not null")
        return kept.select("event_id", F.col("ts").cast("timestamp").alias("ts"), E.clean_path(F.col("path")).alias("path"))

    log = timed(read(spark, sf, "file_events"))
    E.closing(log, late).write.parquet(f"{folder}/closing")
    rows = timed(spark.readStream.schema(read(spark, sf, "file_events").schema).parquet(f"{sf}/file_events.parquet*"))
    rows = rows.unionByName(spark.readStream.schema(log.schema).parquet(f"{folder}/closing"))
    bursts = E.session_stream(rows, late=late, once_by="event_id")
    q = bursts.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("path string, ts timestamp, n bigint").parquet(f"{folder}/out")


def chunk_files(spark, sf):
    from ..sources.chunker import chunk_table

    return chunk_table(files(spark, sf).where("content is not null"), "file_path", "content").drop("content", "imports")


#: A small file of each language; what they are cut into is written out in the oracle by hand.
SOURCES = {
    "a/repo.py": '"""Module doc."""\nimport os\nfrom .near import thing\nLIMIT = 3\n\n\n@cache\ndef total(items):\n    """Adds up."""\n    def inner(x):\n        return x\n    return sum(items)\n\n\nclass Store(Base):\n    kind = "x"\n\n    def __init__(self, path):\n        self.path = path\n\n    async def load(self):\n        return 1\n',
    "b.go": "package a\n\ntype T struct { x int }\n\nfunc (t *T) Load() int {\n\treturn 1\n}\n",
    "c.js": "import a from 'a';\nexport class B {\n  x = 1;\n  get y() { return `}`; }\n}\nfunction z() {}\n",
    "D.java": "package p;\nclass A {\n  A() {}\n  @X int b(int c) { return '}'; }\n}\n",
    "e.rs": "use x::y;\nimpl A { fn b() {} }\npub struct A { x: u8 }\nfn c() { }\n",
    "f.py": "def f():\n    pass\n\n\ndef f():\n    pass\n",
    "g.cpp": "int main() {}\n",
    "h.py": " \n",
}


def chunk_rules(spark, sf):
    """The rules of chunking on SOURCES; `chunk_files` applies them to the whole table."""
    from ..sources.chunker import chunk_table

    made = chunk_table(spark.createDataFrame(list(SOURCES.items()), "file_path string, content string"))
    return made.select("chunk_id", "chunk_type", "symbol", F.coalesce("parent_class", F.lit("")).alias("parent_class"), "start_line", "end_line", F.array_join("imports", " ").alias("imports"))


def queries() -> dict[str, Query]:
    names = """bm25_topk bm25_phrase bm25_filtered postings_terms bm25_from_postings substring_channel rrf_hybrid graph_boost rerank_heuristic diversify search_pipeline search_stored bm25_stored
    camel_split identifier_parts terms_dedup cjk_bigrams sanitize_phrase glob_filter content_hash token_estimate language_of symbol_rules chunk_rows query_phrases
    window_fetch window_presets budget_pack assembled module_naming graph_nodes graph_node_fields graph_edges graph_stats graph_exports neighbors module_context
    file_symbols project_symbols_top20 symbols_by_file file_imports index_status manifest_diff change_counters upsert_merge file_diff mtime_changed delete_file collision_ids block_islands
    synonym_expand synonym_lookup cosine_knn cosine_threshold move_explode debounce_batch latest_event cooldown_batch stream_sessions chunk_files chunk_rules"""
    return {n: globals()[n] for n in names.split()}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return ORACLES
