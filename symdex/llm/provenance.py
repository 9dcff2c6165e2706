"""Problem 1: files that aren't hand-written work of their own repository.

Four kinds of evidence, all found in one pass over each file:
  generated  a notice in the file's header. An Aho-Corasick automaton finds cue phrases in the comments before the
             first line of code; the line of a cue must then read as a notice, not as a remark on notices.
  path       vendored directories, lockfiles, suffixes of minified and generated files.
  copy       most of the file's runs of tokens occur in one published file of a third-party package.
  minified, repetitive, data  what the text consists of: hardly any white space in long lines; a few shapes of
             lines again and again; or literals and hardly any logic.

Files whose content is null or blank are never found. A file that comes in several rows is given once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 5  # words of a run
COPY_SHARE = 0.5
LEAST_RUNS = 20
LEAST_LINES, SHAPES_SHARE = 20, 0.85
BROADCAST_RUNS = 2_000_000  # of published files; beyond, the runs are joined
FILTER_BITS = 27  # a bitmap of 2^27 bits tells runs that no published file has
#: Phrases of the notices that public generators write.
CUES = (
    "@generated", "auto generated", "auto-generated", "autogenerated", "automatically created", "automatically generated", "automatically produced",
    "changes are overwritten", "changes will be", "code generated", "do not change", "do not edit", "do not modify", "don't edit", "edits vanish", "edits will be",
    "file is generated", "file was generated", "generated automatically", "generated at", "generated by", "generated code", "generated file", "generated from", "generated on",
    "generated source", "generated using", "generated with", "machine generated", "machine written", "machine-generated", "machine-written", "produced by", "produced from", "regenerate with",
)
NOTICES = tuple(
    re.compile(p)
    for p in (
        r"(?:this )?code (?:is |was )?generated\b.*\bdo(?: not|n't) (?:edit|modify|change)",
        r"@generated(?:$|\s*[.:,;(<-]|\s+(?:by|from|with|using|on|via|signedsource|automatically|code|file)\b)",
        r"<auto-?generated",
        r"(?:this (?:file|code|source|class|module|package) (?:is|was|has been) |file )?(?:auto(?:matically)?[- ]?|machine[- ])(?:generated|created|produced|written)(?:$|\s*[.:;!,(–—-]|\s+(?:by|from|with|using|on|at|via|file|code|source|do not|and (?:should|must|will))\b)",
        r"(?:this (?:file|code|source|class|module) (?:is|was|has been) )?generated (?:automatically|by (?!older|earlier|hand|people)|from|with|using|at \d|on \d|via|code\b|file\b|source\b)(?!.*\b(?:is|are) (?:read|checked|accepted|skipped|looked)\b)",
        r"(?:please )?do(?: not|n't) (?:edit|modify|change)(?:$|[.!:;,]| (?:this|by hand|manually|directly|-|–))",
        r"(?:all |any |manual |your |hand )*(?:changes|edits|modifications)(?: made)?(?: to this file| here| by hand| manually)? (?:(?:will be|are|get|would be) (?:lost|overwritten|discarded|removed|undone)|(?:will |would )?(?:vanish|disappear|be gone|not survive))\b",
    )
)
DENIED = re.compile(r"\b(?:not|never|isn't|wasn't) (?:auto-?|automatically |machine[- ])?generated\b")
#: Directories that hold third-party code, lockfiles, and suffixes of files that tools write.
VENDORED = re.compile(r"(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|vendored|_vendor|_vendored|third[_-]?party|3rd[_-]?party|extern|external|externals|deps|godeps|site-packages|dist-packages|pods|carthage)/.", re.I)
VERSIONED = re.compile(r"/(?:contrib|lib|libs|static|assets|src)/[A-Za-z][\w.]*-v?\d+\.\d+(?:\.\d+)?/", re.I)
WRITTEN = re.compile(
    r"(?:[.-]min\.(?:[cm]?jsx?|css|tsx?)|[.-](?:bundle|chunk|packed|prod)\.(?:[cm]?js|css)|_pb2(?:_grpc)?\.pyi?|_pb\.[cm]?[jt]sx?|OuterClass\.java|_bindings\.rs|\.gen\.[cm]?[a-z]{2,3}|\.pb(?:\.gw)?\.go|\.pb\.(?:cc|h|swift|rs)|(?:^|/)zz_generated[^/]*|[._-]generated\.\w+|\.g\.(?:dart|cs)|\.designer\.cs"
    r"|(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|pipfile\.lock|cargo\.lock|go\.sum|composer\.lock|gemfile\.lock))$",
    re.I,
)

_COMMENT = re.compile(r"(?:\s+|//[^\n]*|#(?!\[|include\b|define\b)[^\n]*|/\*.*?(?:\*/|\Z)|--[^\n]*|<!--.*?-->|[\"']use strict[\"'];?|[rRuUbB]?(\"\"\"|''').*?(?:\1|\Z))+", re.S)
_BARE = re.compile(r"^[\s/*#!;\"'-]+|[\s*/!\"'-]+$")
_PIECE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|(?<![\w\"'])#(?!\[)[^\n]*|\"\"\".*?(?:\"\"\"|\Z)|\'\'\'.*?(?:\'\'\'|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`?", re.S)
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w.])")
_LOGIC = re.compile(r"\b(?:def|function|func|fn|return|if|else|for|while|switch|match|try|catch|except|raise|throw|import|use|await|yield)\b|=>|\w\(")
_PASSED = re.compile(r"^[ \t]*(?:from[ \t]+[\w.]+[ \t]+import\b(?:[ \t]*\([^)]*\)|[^\n]*)|(?:import|export|use|pub use|require|mod|pub mod)\b(?:[^\n{=(]*\{[^}]*\})?[^\n=]*|__all__[ \t]*=[ \t]*[\[(][^\])]*[\])]|exports\.[^\n]*|Object\.defineProperty\(exports[^\n]*)$", re.M)
_CODE = re.compile(r"[=;({\[]")
_WORD = re.compile(r"[A-Za-z_]\w*|\d+")
_TOKEN = re.compile(r"\w+|[^\w\s]")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, cue in enumerate(CUES):
        a.add_word(cue, i)
    a.make_automaton()
    return a


def notice(text: str, automaton: ahocorasick.Automaton) -> str | None:
    """The line of the header that says a tool wrote the file."""
    head = text.lstrip("﻿")
    m = _COMMENT.match(head)
    if not m:
        return None
    header = m.group(0).lower()
    seen = -1
    for end, _ in automaton.iter(header):
        if end <= seen:
            continue
        start = header.rfind("\n", 0, end) + 1
        seen = header.find("\n", end)
        seen = len(header) if seen < 0 else seen
        line = _BARE.sub("", header[start:seen])
        if not DENIED.search(line) and any(p.match(line) for p in NOTICES):
            return line
    return None


def _few_shapes(text: str) -> bool:
    shapes = Counter(x for x in _WORD.sub("w", text).replace(" ", "").replace("\t", "").split("\n") if x not in ("", "\r"))
    n = sum(shapes.values())
    return n >= LEAST_LINES and sum(v for _, v in shapes.most_common(6)) >= SHAPES_SHARE * n


def makeup(text: str) -> str | None:
    """'minified', 'repetitive' or 'data' for what the text consists of, else None.

    Documents of other formats (JSON, lists without any code) are none of these. repetitive: nearly all lines have one of a few shapes (names and numbers aside), as tables of parsers and
    accessors of messages have that tools write.
    """
    lines = text.count("\n") + 1
    if len(text) >= 200 and len(text) / lines > 100:
        dense = len("".join(text.split()))
        if len(text) - dense < 0.09 * len(text) and len(_LOGIC.findall(text)) * 100 >= dense:
            return "minified"
    start = text.lstrip("\ufeff \t\r\n")
    if start[:1] == "{" and start[1:].lstrip()[:1] in ('"', "}") or not _CODE.search(text):
        return None  # a document of another format under a wrong name, not code that holds data
    # lists of imports and of what a module passes on are written by hand, so it must be so without them too
    if _few_shapes(text) and _few_shapes(_PASSED.sub("", text)):
        return "repetitive"
    if 300 * sum(map(text.count, ("return", "if ", "for ", "def ", "fn ", "func"))) > len(text):
        return None
    literal = 0

    def drop(m: re.Match) -> str:
        nonlocal literal
        s = m.group(0)
        if s[0] in "\"'`":
            if s[:3] in ('"""', "'''") and not text[max(0, m.start() - 400) : m.start()].rpartition("\n")[2].strip():
                return " "  # a docstring is no data
            literal += len(s)
            return "  "
        return " "

    code = _PIECE.sub(drop, text)
    literal += sum(map(len, _NUMBER.findall(code)))
    rest = _NUMBER.sub(" ", code)
    body = literal + len("".join(rest.split()))
    if literal >= 300 and literal >= 0.4 * body and len(_LOGIC.findall(rest)) * 400 < body:
        return "data"
    return None


def runs(text: str) -> np.ndarray:
    """The set of runs of RUN words of the text as sorted 64-bit hashes."""
    tokens = _TOKEN.findall(text)
    n = len(tokens) - RUN + 1
    if n < 1:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_hash.__getitem__, tokens), np.uint64, len(tokens))
    with np.errstate(over="ignore"):
        x = h[:n].copy()
        for k in range(1, RUN):
            x = (x * np.uint64(0x9E3779B97F4A7C15)) ^ h[k : k + n]
            x ^= x >> np.uint64(31)
    return np.unique(x).view(np.int64)


class _Hash(dict):
    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        x = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return x


_hash = _Hash()


def _copies_by_join(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, upstream_id) by joining the runs, for any number of published files.

    A file of which fewer runs than COPY_SHARE are in the bitmap of all published runs is no copy, so hand-written files send nothing. Files of one content are compared
    once; counts of shared runs are added up before they are shuffled. Of several published files the one that shares most runs is given, then the least id.
    """

    def run(batches):
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = runs(text)
                yield pa.RecordBatch.from_arrays([pa.array([key] * x.size, b.schema.field(0).type), pa.array(np.full(x.size, x.size, np.int32)), pa.array(x)], ["key", "n", "run"])

    theirs = upstream.select(F.col("upstream_id").cast("long").alias("k"), "content").where("content is not null").mapInArrow(run, "key bigint, n int, run bigint").select(F.col("key").alias("other"), "run")
    place = F.col("run").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = theirs.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(run & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # 2^21 rows at most
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    shared_map = files.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def likely(batches):
        bits = shared_map.value
        mask = np.int64((1 << FILTER_BITS) - 1)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = runs(text)
                at = x & mask
                hit = x[(bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1]
                if x.size >= LEAST_RUNS and hit.size >= COPY_SHARE * x.size:
                    yield pa.RecordBatch.from_arrays([pa.array([key] * hit.size, pa.string()), pa.array(np.full(hit.size, x.size, np.int32)), pa.array(hit)], ["key", "n", "run"])

    named = files.select(F.col("file_id").cast("long"), F.sha2("content", 256).alias("key"), "content")
    mine = named.select("key", "content").dropDuplicates(["key"]).mapInArrow(likely, "key string, n int, run bigint")
    shared = mine.join(theirs, "run").groupBy("key", "other").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    best = shared.where(F.col("shared") >= COPY_SHARE * F.col("n")).groupBy("key").agg(F.max_by("other", F.struct("shared", (-F.col("other")).alias("o"))).alias("upstream_id"))
    return named.select("file_id", "key").join(best, "key").select("file_id", "upstream_id").distinct()


def evidence(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, file_path, kind, detail) of each file that isn't hand-written, with the first kind of evidence found."""
    shown = files.where("length(trim(content)) > 0").select("file_id", "file_path", "content")
    known = upstream.where("content is not null").select("upstream_id", F.concat_ws(" ", "package", "version").alias("name"), "content")
    # a token is a character at least, so this bounds the number of runs
    small = (known.agg(F.sum(F.length("content"))).first()[0] or 0) <= BROADCAST_RUNS * 4
    table = None
    if small:
        rows = known.orderBy("upstream_id").collect()
        sets = [runs(r["content"]) for r in rows]
        every = np.unique(np.concatenate(sets)) if sets else np.empty(0, np.int64)
        table = files.sparkSession.sparkContext.broadcast((every, [np.searchsorted(every, s) for s in sets], [r["name"] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        if table is not None:
            every, where, names = table.value
            count = np.zeros((len(where), every.size), bool) if every.size * len(where) <= 50_000_000 else None
            if count is not None:
                for i, w in enumerate(where):
                    count[i, w] = True

        def copy_of(text: str) -> str | None:
            if table is None or not every.size:
                return None
            x = runs(text)
            if x.size < LEAST_RUNS:
                return None
            at = np.searchsorted(every, x)
            at = at[every[np.minimum(at, every.size - 1)] == x]
            if at.size < COPY_SHARE * x.size:
                return None
            shared = count[:, at].sum(1) if count is not None else np.array([np.isin(at, w, assume_unique=True).sum() for w in where])
            best = int(shared.argmax())
            return names[best] if shared[best] >= COPY_SHARE * x.size else None

        for b in batches:
            out: list[tuple] = []
            for key, path, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                path = path or ""
                if m := VENDORED.search(path) or VERSIONED.search(path) or WRITTEN.search(path):
                    out.append((key, path, "path", m.group(0)))
                elif line := notice(text, automaton):
                    out.append((key, path, "generated", line[:200]))
                elif kind := makeup(text):
                    out.append((key, path, kind, ""))
                elif name := copy_of(text):
                    out.append((key, path, "copy", name))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))], ["file_id", "file_path", "kind", "detail"])

    found = shown.mapInArrow(run, "file_id bigint, file_path string, kind string, detail string")
    if table is None:
        more = _copies_by_join(shown, known).join(known.select("upstream_id", "name"), "upstream_id")
        found = found.unionByName(shown.select("file_id", "file_path").join(more, "file_id").select("file_id", "file_path", F.lit("copy").alias("kind"), F.col("name").alias("detail")))
    # other evidence comes before a copy, whichever way copies were found
    first = F.struct((F.col("kind") == "copy").cast("int").alias("later"), "kind", "file_path", "detail")
    return found.groupBy("file_id").agg(F.min(first).alias("x")).select("file_id", "x.file_path", "x.kind", "x.detail")
