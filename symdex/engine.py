"""The calls of the library: analyze, search, file_info, project_symbols, module_context, status, watch."""

from __future__ import annotations

import os
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.queries import window
from .functions.text import module_name
from .operators import assemble, changes, graph
from .plans.catalog import index_tables
from .plans.catalog import search as search_plan
from .session import cut
from .sources import chunker, files
from .store import BUCKETS, Store, bucket_of
from .streaming import events

MOST_RESULTS, MOST_IMPORTS = 20, 20  # of the calls that give text
CONTEXT_IMPORTS, SHOWN_SIGNATURE = 30, 120
INDEX = ("words", "grams", "sizes")


class Engine:
    """The index of a project. The first call that needs it builds it, unless auto_build is off; so does one that finds it broken or of an older schema."""

    def __init__(self, spark: SparkSession, project: str | Path, base: str | Path, buckets: int = BUCKETS, auto_build: bool = True) -> None:
        if not os.path.isdir(project):
            raise FileNotFoundError(project)
        self.spark, self.project, self.auto_build = spark, os.path.realpath(os.fspath(project)), auto_build
        self.store = Store(spark, base, project, buckets)
        self._streams: list = []

    # -- building

    def analyze(self, full: bool = False) -> dict:
        """Bring the index up to date and report what changed."""
        began = datetime.now(UTC)
        scanned = files.discover(self.spark, self.project)
        current = scanned.select("file_path", "mtime").cache()
        fresh = full or not self._whole()
        old = None if fresh else self.store.read("chunks")
        since = self.store.metadata().get("last_indexed_at", 0.0)
        if fresh:
            diff = current.select("file_path", F.lit("added").alias("status"))
        else:
            changed = changes.changed_since(current, "mtime", F.timestamp_seconds(F.lit(float(since))))
            diff = changes.file_diff(old.select("file_path"), current, changed)
        diff = cut(diff)
        parsed = cut(chunker.chunk_table(files.as_text(scanned.join(diff.where("status <> 'deleted'"), "file_path", "left_semi"))))
        counts = {r["status"]: r["count"] for r in diff.groupBy("status").count().collect()}
        if fresh:
            self.store.wipe()
            new, touched, steps = parsed, None, {"added": parsed.count()}
        else:
            touched = self._buckets(diff)
            before = self.store.read("chunks", touched)
            steps = {r["status"]: r["count"] for r in changes.manifest_diff(before.join(diff, "file_path", "left_semi"), parsed).groupBy("status").count().collect()}
            new = changes.delete(before, diff, "file_path").unionByName(parsed)
        self._put(new, touched)
        self.rebuild_graph()
        self.store.update_metadata(last_analyzed=began.isoformat(), last_indexed_at=began.timestamp(), kb_location=self.store.root, rag_location=f"{self.store.root}/chunks")
        report = {
            "success": True, "project": self.project, "full": fresh, "files_analyzed": current.count(), "files_added": counts.get("added", 0), "files_modified": counts.get("modified", 0), "files_deleted": counts.get("deleted", 0),
            "chunks_added": steps.get("added", 0), "chunks_updated": steps.get("updated", 0), "chunks_deleted": steps.get("deleted", 0), "chunks_total": self.store.read("chunks").count(),
        }
        current.unpersist()
        return report

    def _whole(self) -> bool:
        return all(map(self.store.exists, ("chunks", *INDEX)))

    def _buckets(self, paths: DataFrame) -> list[int]:
        return [r["b"] for r in paths.select(bucket_of(F.col("file_path"), self.store.buckets).alias("b")).distinct().collect()]  # as many as the store has buckets

    def _put(self, chunks: DataFrame, touched: list[int] | None) -> None:
        """Write the chunks of the touched buckets, or all, and their postings as one version."""
        rows = cut(chunks)
        n = self.store.buckets
        placed = rows.withColumn("bucket", bucket_of(F.col("file_path"), n)).repartition("bucket").sortWithinPartitions("bucket", "chunk_id")
        self.store.write(cut={"chunks": placed, **index_tables(rows, n)}, touched=touched)

    def apply(self, paths: DataFrame) -> None:
        """Replace the chunks of (path, action) by what the files hold now; those that are gone, ignored or deleted lose theirs.

        Only the files named are read, and only the buckets they lie in are written.
        """
        asked = cut(paths.select(F.col("path").alias("file_path"), "action").distinct())
        touched = self._buckets(asked)
        if not touched:
            return
        named = [r["file_path"] for r in asked.where("action = 'upsert'").select("file_path").distinct().collect()]  # a batch of the watcher's
        parsed = cut(chunker.chunk_table(files.as_text(files.named(self.spark, self.project, named))))
        self._put(changes.delete(self.store.read("chunks", touched), asked, "file_path").unionByName(parsed), touched)
        self.store.update_metadata(graph_stale=True)

    def rebuild_graph(self) -> None:
        c = self.store.read("chunks")
        self.store.write(whole={"edges": graph.edges(c), "nodes": graph.detailed_nodes(c)})
        self.store.update_metadata(graph_stale=False, graph_built_at=datetime.now(UTC).timestamp())

    def watch(self, log: DataFrame, checkpoint: str | Path, debounce_s: float = events.DEBOUNCE_S, cooldown_s: float = events.COOLDOWN_S, on_change: Callable[[DataFrame], None] | None = None, **trigger):
        """Follow a stream of events(ts, op, path, dest_path): what a path asks for last goes to the index once the path is quiet.

        Deletions don't wait. The graph follows at most every cooldown, on a later tick if need be: that it is stale is kept with the index, so a
        restart makes up for it. on_change gets (path, action) of each batch by path; an error in it or of a file stops no batch.
        With debounce_s 0 (a finished log, read once) only the batch itself is condensed.
        """
        if not self._whole():
            self.analyze()
        asked = events.actions(log.withColumn("event_id", F.lit(0).cast("long"))).select("ts", "path", "action")
        steps = events.debounce_stream(asked, "path", debounce_s) if debounce_s else asked

        def batch(df: DataFrame, _: int) -> None:
            newest = cut(df.groupBy("path").agg(F.max_by("action", F.struct("ts", "action")).alias("action")))
            if not newest.isEmpty():
                self.apply(newest)
                if on_change:
                    on_change(newest.orderBy("path"))
            known = self.store.metadata()
            if known.get("graph_stale") and (not debounce_s or datetime.now(UTC).timestamp() - known.get("graph_built_at", 0.0) >= cooldown_s):
                self.rebuild_graph()

        started = steps.writeStream.foreachBatch(batch).option("checkpointLocation", os.fspath(checkpoint)).trigger(**(trigger or {"processingTime": "1 second"})).start()
        self._streams.append(started)
        return started

    # -- asking

    def _chunks(self) -> DataFrame:
        if not self._whole():
            if not self.auto_build:
                raise RuntimeError("No search index; call analyze first")
            self.analyze()
        return self.store.read("chunks")

    def search(self, query: str, max_results: int = 5, language: str | None = None, path_glob: str | None = None, budget: int | None = None, window_strategy: str = "moderate", encoder: Callable[[str], int] | None = None, **options) -> dict:
        """Results with their source, best first; an index that can't be read is built anew, once. `encoder` counts a text's tokens exactly."""
        try:
            return self._search(query, max_results, language, path_glob, budget, window_strategy, encoder, **options)
        except (PySparkException, Py4JJavaError):
            if not self.auto_build:
                raise
            self.analyze(full=True)
            return self._search(query, max_results, language, path_glob, budget, window_strategy, encoder, **options)

    def _search(self, query, max_results, language, path_glob, budget, window_strategy, encoder, **options) -> dict:
        chunks = self._chunks()
        edges = self.store.read("edges") if self.store.exists("edges") else self.spark.createDataFrame([], "src string, dst string")
        hits = search_plan(chunks, query, max_results, language, path_glob, edges=edges, index={t: self.store.read(t) for t in INDEX}, **options)
        order = hits.select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").collect()  # max_results rows
        if not order:
            return {"query": query, "truncated": False, "token_estimate": 0, "results": []}
        before, after = window(window_strategy)
        ranked = [r["chunk_id"] for r in order]
        found = self.get_chunks(ranked).join(F.broadcast(self.spark.createDataFrame([(i, r["score"]) for i, r in enumerate(order)], "idx int, score double")), "idx")
        found = cut(found)
        asked = found.withColumns({"context_before": F.lit(before), "context_after": F.lit(after)})
        text = files.as_text(files.named(self.spark, self.project, [r["file_path"] for r in found.select("file_path").distinct().collect()]))
        shown = assemble.fetch(asked, text).drop("file_path")
        rows = assemble.chunk_cost(found.join(shown, "idx"), "content").orderBy("idx").collect()
        total, results, skipped, truncated = 0, [], 0, False
        for r in rows:
            if r["content"] is None:
                skipped += 1
                continue
            price = r["cost"] if encoder is None else encoder(r["content"])
            if budget is not None and total + price > budget:
                truncated = True
                continue
            total += price
            results.append({"rank": len(results) + 1, "score": r["score"], "file": r["file_path"], "lines": f"{r['first']}-{r['last']}", "ref": f"{r['file_path']}:{r['start_line']}", "language": r["language"], "type": r["chunk_type"], "qualified_name": r["qualified_name"], "signature": r["signature"], "content": r["content"], "context_window": window_strategy})
        out = {"query": query, "truncated": truncated, "token_estimate": total, "results": results}
        return out | ({"skipped": skipped} if skipped else {})

    def get_chunks(self, ids: list[str]) -> DataFrame:
        """(idx, *chunk without content) of the ids in their order; unknown ones are left out, repeated ones come once."""
        order = list(dict.fromkeys(ids))
        wanted = self.spark.createDataFrame(list(enumerate(order)), "idx int, chunk_id string")
        return self._chunks().drop("content").where(F.col("chunk_id").isin(order)).join(F.broadcast(wanted), "chunk_id").orderBy("idx")

    def search_text(self, query: str, **options) -> str:
        options["max_results"] = min(options.get("max_results", 5), MOST_RESULTS)
        found = self.search(query, **options)
        lines = [f"{len(found['results'])} results for {query!r}" + (f", {found['skipped']} skipped" if "skipped" in found else "") + (", truncated" if found["truncated"] else "")]
        for r in found["results"]:
            lines += ["", f"## {r['rank']}. {r['ref']} ({r['type']} {r['qualified_name']}, {r['score']:.4f})", f"```{r['language']}", r["content"], "```"]
        return "\n".join(lines)

    def file_info(self, path: str) -> dict:
        rows = self._chunks().where(F.col("file_path") == path).orderBy("start_line", "chunk_id")
        symbols = rows.select("chunk_type", "symbol", "qualified_name", "start_line", "end_line", F.substring(F.coalesce("signature", F.lit("")), 1, 100).alias("signature"))
        imports = rows.where("chunk_type = 'module'").select(F.slice(F.coalesce("imports", F.array().cast("array<string>")), 1, MOST_IMPORTS).alias("i")).first()
        return {"file": path, "symbols": [r.asDict() for r in symbols.collect()], "imports": imports["i"] if imports else []}

    def project_symbols(self, language: str | None = None) -> DataFrame:
        """(file_path, symbols, first array of up to 20, more) of each file's functions and classes."""
        c = self._chunks().where(F.col("chunk_type").isin("function", "class"))
        c = c.where(F.col("language") == language) if language else c
        listed = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "symbol"))), lambda x: x["symbol"])
        return c.groupBy("file_path").agg(listed.alias("all")).select("file_path", F.size("all").alias("symbols"), F.slice("all", 1, 20).alias("first"), F.greatest(F.size("all") - 20, F.lit(0)).alias("more"))

    def module_context(self, path: str, most: int = 3) -> DataFrame:
        """(neighbour, position, symbol): the first exports of the modules next to that of a file.

        Where no module is next to it, one row without a neighbour: the first symbol of the file itself.
        """
        chunks = self._chunks()
        known = self.store.read("nodes").where((F.col("type") == "module") & (F.col("source_path") == path)).select("name").first() if self.store.exists("nodes") else None
        name = known["name"] if known else self.spark.range(1).select(module_name(F.lit(path))).first()[0]
        found = graph.context(chunks, most).where(F.col("name") == name).select("neighbour", "position", "symbol").orderBy("neighbour", "position")
        if not found.isEmpty():
            return found
        own = chunks.where((F.col("file_path") == path) & (F.col("chunk_type") != "module")).orderBy("start_line", "chunk_id").limit(1)
        return own.select(F.lit(None).cast("string").alias("neighbour"), F.lit(0).alias("position"), "symbol")

    def module_text(self, path: str) -> str:
        """A module as text: its imports, what its neighbours export, and where its first symbol is."""
        info = self._chunks().where(F.col("file_path") == path)
        imports = info.where("chunk_type = 'module'").select(F.slice(F.coalesce("imports", F.array().cast("array<string>")), 1, CONTEXT_IMPORTS).alias("i")).first()
        near: dict[str, list[str]] = {}
        for r in self.module_context(path).where("neighbour is not null").collect():  # a few exports of each neighbour
            near.setdefault(r["neighbour"], []).append(r["symbol"])
        first = info.where("chunk_type <> 'module'").orderBy("start_line", "chunk_id").first()
        lines = [f"# {path}"] + ([f"imports: {', '.join(imports['i'])}"] if imports and imports["i"] else [])
        lines += [f"{name}: {', '.join(symbols)}" for name, symbols in sorted(near.items())]
        if first:
            lines.append(f"{first['chunk_type']} {first['qualified_name']} at {path}:{first['start_line']}: {(first['signature'] or '')[:SHOWN_SIGNATURE]}")
        return "\n".join(lines)

    def status(self) -> dict:
        if not self._whole():
            message = "The index is of an older schema; analyze builds it anew" if self.store.outdated() else "No search index; call analyze first"
            return {"project": self.project, "indexed": False, "message": message, "watching": self._watching()}
        r = self.store.read("chunks").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("f")).first()
        return {"project": self.project, "indexed": True, "chunks": r["n"], "files": r["f"], "location": self.store.root, "watching": self._watching(), **self.store.metadata()}

    def _watching(self) -> bool:
        return any(q.isActive for q in self._streams)
