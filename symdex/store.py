"""Tables of an index as versioned Parquet on any file system Hadoop knows, and the small JSON files beside them.

The tables of the index are cut into buckets by file path. A write puts the new contents of some buckets, or of whole
tables, into new directories; a pointer file, replaced in one step, names what is current. So readers see a whole version or
the one before, a batch of changes is one step, and it costs what the touched buckets hold. Directories that a write replaces are
deleted by the write after it, when no reader of the version before is left waiting. A wrong schema version or a broken pointer means: build anew.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 2
BUCKETS = 16


def encode_path(project: str | Path) -> str:
    return os.path.realpath(os.fspath(project)).replace("/", "-")


def bucket_of(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


class Files:
    """What the store needs of a file system, by Hadoop's client."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._clients: dict[str, object] = {}

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        uri = p.getFileSystem(self.conf).getUri()
        fs = self._clients.get(uri.toString())
        if fs is None:
            # a client of its own: a checksum kept in a file beside a small file can't be replaced in one step with it
            fs = self._clients[uri.toString()] = self.jvm.org.apache.hadoop.fs.FileSystem.newInstance(uri, self.conf)
            fs.setVerifyChecksum(False)
            fs.setWriteChecksum(False)
        return fs, p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def read_json(self, path: str, default: dict) -> dict:
        """The object in a file; the default where it is missing or broken."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return dict(default)
        stream = fs.open(p)
        try:
            data = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return dict(default)
        finally:
            stream.close()
        return data if isinstance(data, dict) else dict(default)

    def write_json(self, path: str, data: dict) -> None:
        """Replace a file in one step."""
        draft = f"{path}.{time.time_ns()}"
        fs, p = self._at(draft)
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(data, indent=2, ensure_ascii=False), "utf-8"))
        out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        context.rename(p, self.jvm.org.apache.hadoop.fs.Path(path), options)


class Store:
    def __init__(self, spark: SparkSession, base: str | Path, project: str | Path, buckets: int = BUCKETS) -> None:
        self.spark, self.base = spark, os.fspath(base).rstrip("/")
        self.project = os.path.realpath(os.fspath(project))
        self.root = f"{self.base}/{encode_path(project)}"
        self.files = Files(spark)
        self._buckets = buckets

    def _pointer(self) -> dict:
        found = self.files.read_json(f"{self.root}/current.json", {})
        return found if found.get("schema") == SCHEMA_VERSION else {}

    def outdated(self) -> bool:
        """Whether there is an index of another schema version."""
        return self.files.read_json(f"{self.root}/current.json", {"schema": SCHEMA_VERSION}).get("schema") != SCHEMA_VERSION

    @property
    def buckets(self) -> int:
        return self._pointer().get("buckets", self._buckets)

    def _dirs(self, parts: dict) -> list[str]:
        return [f"{self.root}/{name}" for name in parts.values()]

    def exists(self, table: str) -> bool:
        """Whether the table was written and all its directories are there."""
        found = self._pointer().get("tables", {}).get(table)
        return found is not None and all(map(self.files.exists, self._dirs(found["parts"])))

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or the given buckets of it."""
        found = self._pointer()["tables"][table]
        schema = StructType.fromJson(json.loads(found["columns"]))
        dirs = self._dirs(found["parts"] if buckets is None else {b: d for b, d in found["parts"].items() if int(b) in set(buckets)})
        return self.spark.read.schema(schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], schema)

    def write(self, whole: dict[str, DataFrame] | None = None, cut: dict[str, DataFrame] | None = None, touched: list[int] | None = None) -> None:
        """Write whole tables, and tables with a column `bucket` of which the touched buckets (or all) are replaced, as one new version."""
        before = self._pointer()
        tables, version = dict(before.get("tables", {})), f"v{time.time_ns()}"
        for path in before.get("replaced", []):
            self.files.delete(f"{self.root}/{path}")
        for name, df in (whole or {}).items():
            df.write.parquet(f"{self.root}/{name}/{version}")
            tables[name] = {"columns": df.schema.json(), "parts": {"0": f"{name}/{version}"}}
        for name, df in (cut or {}).items():
            df.write.partitionBy("bucket").parquet(f"{self.root}/{name}/{version}")
            made = {n[7:]: f"{name}/{version}/{n}" for n in self.files.names(f"{self.root}/{name}/{version}") if n.startswith("bucket=")}
            kept = {} if touched is None else {b: d for b, d in tables.get(name, {"parts": {}})["parts"].items() if int(b) not in set(touched)}
            tables[name] = {"columns": df.drop("bucket").schema.json(), "parts": kept | made}
        used = {d for t in tables.values() for d in t["parts"].values()}
        replaced = sorted({d for t in before.get("tables", {}).values() for d in t["parts"].values()} - used)
        self.files.write_json(f"{self.root}/current.json", {"schema": SCHEMA_VERSION, "buckets": before.get("buckets", self._buckets), "tables": tables, "replaced": replaced})

    def wipe(self) -> None:
        self.files.write_json(f"{self.root}/current.json", {"schema": SCHEMA_VERSION, "buckets": self._buckets, "tables": {}, "replaced": []})

    def export_json(self, table: str, path: str) -> None:
        """A table as files of one JSON object a line."""
        self.read(table).write.mode("overwrite").json(path)

    # -- metadata of projects

    def metadata(self) -> dict:
        return self.files.read_json(f"{self.base}/metadata.json", {"version": 1, "projects": {}}).get("projects", {}).get(self.project, {})

    def update_metadata(self, **values) -> None:
        data = self.files.read_json(f"{self.base}/metadata.json", {"version": 1, "projects": {}})
        data.setdefault("projects", {}).setdefault(self.project, {}).update(values)
        self.files.write_json(f"{self.base}/metadata.json", data)
