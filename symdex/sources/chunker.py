"""Source files to symbol-level chunks: modules, classes, functions, methods.

Strings and comments are blanked at equal length first, so brackets and indentation can be read from the rest;
broken files give what can still be read. Per language: Python nests by indentation, the others by braces. Go's types and
Rust's impl blocks give no chunks; Go's methods are functions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.text import SUFFIXES

MOST_LINES = 200  # longer functions come as their blocks
LANGUAGE_OF = {s[1:]: name for name, listed in SUFFIXES.items() for s in listed.split()}
_QUOTES = r"\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?"
_BLANK = {
    "python": re.compile(r"#[^\n]*|\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|" + _QUOTES, re.S),
    "rust": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|r(#*)\".*?(?:\"\1|\Z)|\"(?:\\.|[^\"\\])*\"?|'(?:\\[^\n][^'\n]*|[^'\\\n])'", re.S),
    "other": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)|" + _QUOTES, re.S),
}
_PY = re.compile(r"^([ \t]*)(?:(async)[ \t]+)?(def|class)[ \t]+([^\W\d]\w*)", re.M)
_FUNCTION = {
    "javascript": re.compile(r"(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
    "go": re.compile(r"func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)"),
    "rust": re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\S+)?)\s+)*fn\s+([A-Za-z_]\w*)"),
}
_FUNCTION["typescript"] = re.compile(_FUNCTION["javascript"].pattern)
_CLASS = {
    "javascript": re.compile(r"(?:export\s+(?:default\s+)?)?class\s+([A-Za-z_$][\w$]*)"),
    "typescript": re.compile(r"(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    "rust": re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?(?:struct|enum|trait)\s+([A-Za-z_]\w*)"),
    "java": re.compile(r"(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp)\s+)*(?:class|interface|enum)\s+([A-Za-z_]\w*)"),
}
_METHOD = {
    "javascript": re.compile(r"(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:static|async|get|set|public|private|protected|readonly|override|abstract)\s+)*\*?\s*(#?[A-Za-z_$][\w$]*)\s*(?:<[^(){}]*>)?\s*\("),
    "java": re.compile(r"(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|native|synchronized|default|strictfp)\s+)*(?:<[^(){}]*>\s*)?(?:[\w.]+(?:<[^(){}=;]*>)?(?:\[\])*\s+)?([A-Za-z_]\w*)\s*\("),
}
_METHOD["typescript"] = _METHOD["javascript"]
_NOT_NAMES = frozenset("if for while switch catch return new else do try function throw super this".split())
_LABELS = {"if": "conditional", "for": "loop", "while": "loop", "loop": "loop", "try": "error handling", "with": "resource", "match": "pattern match", "switch": "switch", "select": "select"}


@dataclass
class Chunk:
    kind: str
    symbol: str
    qualified: str
    parent: str | None
    first: int  # lines count from 1
    last: int
    signature: str
    content: str
    docstring: str | None = None
    imports: list[str] = field(default_factory=list)
    chunk_id: str = ""


def blanked(text: str, language: str) -> str:
    fill = lambda m: re.sub(r"[^\n]", " ", m.group(0))
    return _BLANK.get(language, _BLANK["other"]).sub(fill, text)


def signature(lines: list[str]) -> str:
    return re.sub(r"\s+", " ", " ".join(x.strip() for x in lines)).strip()


#: Strings at the head of a block that direct a framework.
PRAGMAS = frozenset(("use client", "use server", "use strict"))
_STRING = re.compile(r"[\s;]*[rRuU]?(\"\"\"|'''|\"|')(.*?)(?<!\\)\1", re.S)


def python_docstring(content: str) -> str | None:
    m = _STRING.match(content)
    while m and m[2].strip().lower() in PRAGMAS:  # a directive, not documentation
        m = _STRING.match(content, m.end())
    if not m:
        return None
    lines = m[2].split("\n")
    margin = min((len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()), default=0)
    return "\n".join([lines[0], *(x[margin:] for x in lines[1:])]).strip() or None


def python_imports(bare: str) -> list[str]:
    """Imported modules in order, without repeats; relative ones keep their dots."""
    out: list[str] = []
    for m in re.finditer(r"(?:^|;[ \t]*)(?:import[ \t]+([^;\n]+)|from[ \t]+(\.*[\w.]*)[ \t]+import\b)", bare, re.M):
        names = [re.split(r"\s+as\s+", x.strip())[0] for x in m[1].split(",")] if m[1] else [m[2]]
        out += [n for n in names if n and n != "__future__"]
    return list(dict.fromkeys(out))


def _python(text: str, stem: str) -> list[Chunk]:
    bare = blanked(text, "python")
    lines, plain = text.split("\n"), bare.split("\n")
    n = len(lines)
    depth, at_depth = 0, []
    for x in plain:
        at_depth.append(depth)
        depth = max(0, depth + sum(map(x.count, "([{")) - sum(map(x.count, ")]}")))
    indent = [len(x) - len(x.lstrip()) if x.strip() and at_depth[i] == 0 else -1 for i, x in enumerate(plain)]
    inside = [False] * n  # lines of multi-line strings and brackets belong to the statement before
    chunks: list[Chunk] = []
    covered = [False] * n
    starts = {text.count("\n", 0, m.start()): m for m in _PY.finditer(bare)}

    def end_of(i: int) -> int:
        j, last = i + 1, i
        while j < n and (indent[j] < 0 or indent[j] > indent[i]):
            if plain[j].strip() or lines[j].strip() and (indent[j] < 0 and not lines[j].lstrip().startswith("#")):
                last = j
            j += 1
        return last

    def header_end(i: int) -> int:
        k, d = i, 0
        while k < n:
            d += sum(map(plain[k].count, "([{")) - sum(map(plain[k].count, ")]}"))
            if d <= 0 and ":" in plain[k]:
                return k
            k += 1
        return i

    def walk(low: int, high: int, level: int, scope: list[str]) -> int | None:
        """Chunks of the definitions at one level; gives the first line of the first."""
        i, first = low, None
        while i < high:
            m = starts.get(i)
            if m is None or indent[i] != level:
                i += 1
                continue
            begin = i
            while begin > low and (plain[begin - 1].lstrip().startswith("@") and indent[begin - 1] == level or indent[begin - 1] < 0 and at_depth[begin - 1] > 0):
                begin -= 1
            last, head = end_of(i), header_end(i)
            first = begin if first is None else first
            name = m[4]
            path = [*scope, name]
            sig = signature(lines[begin : max(head, begin) + 1])
            body = "\n".join(lines[head + 1 : last + 1])
            doc = python_docstring(body)
            if m[3] == "def":
                kind = "method" if scope else "function"
                chunks.append(Chunk(kind, name, ".".join(path), scope[-1] if scope else None, begin + 1, last + 1, sig, "\n".join(lines[begin : last + 1]), doc))
            else:
                at = len(chunks)
                inner = next((indent[j] for j in range(head + 1, last + 1) if indent[j] > level), -1)
                member = walk(head + 1, last + 1, inner, path) if inner > 0 else None
                stop = (member - 1) if member is not None else last
                content = "\n".join(lines[begin : stop + 1]).rstrip()
                chunks.insert(at, Chunk("class", name, ".".join(path), scope[-1] if scope else None, begin + 1, begin + 1 + content.count("\n"), sig, content, doc))
            for k in range(begin, last + 1):
                covered[k] = True
            i = last + 1
        return first

    walk(0, n, 0, [])
    rest = [i for i in range(n) if not covered[i] and lines[i].strip()]
    if rest:
        content = "\n".join(lines[i] for i in rest)
        head = python_docstring("\n".join(lines))
        chunks.insert(0, Chunk("module", stem, "", None, rest[0] + 1, rest[-1] + 1, stem, content, head, python_imports(bare)))
    return chunks


def _braced(text: str, stem: str, language: str) -> list[Chunk]:
    bare = blanked(text, language)
    lines = text.split("\n")
    begins = [0]
    for m in re.finditer("\n", text):
        begins.append(m.end())
    closes: dict[int, int] = {}
    depth_at: list[int] = []
    stack: list[int] = []
    for i, c in enumerate(bare):
        depth_at.append(len(stack))
        if c in "([{":
            stack.append(i)
        elif c in ")]}" and stack:
            closes[stack.pop()] = i

    def line_of(at: int) -> int:
        low, high = 0, len(begins)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if begins[mid] <= at else (low, mid)
        return low

    def items(low: int, high: int, depth: int) -> list[tuple[int, int, int]]:
        """(first, body or -1, last) of the statements at one depth between two places."""
        out, i = [], low
        while i < high:
            while i < high and bare[i].isspace():
                i += 1
            first, body = i, -1
            while i < high:
                c = bare[i]
                if depth_at[i] == depth:
                    if c == "{":
                        end = closes.get(i, high - 1)
                        body = i if body < 0 else body
                        i = end + 1
                        k = i
                        while k < high and bare[k].isspace():
                            k += 1
                        if k >= high or bare[k] not in ".,;)(=?:&|+" and not re.match(r"(?:else|catch|finally|from|as|while)\b", bare[k : k + 8]):
                            break
                        continue
                    if c == ";":
                        i += 1
                        break
                    if c == "\n" and language in ("go", "javascript", "typescript") and i > first:
                        before = bare[first:i].rstrip()
                        k = i
                        while k < high and bare[k].isspace():
                            k += 1
                        if before and before[-1] not in ",=(+-*/&|?:.<>" and (k >= high or bare[k] not in ".?:&|+,{=)") and not re.search(r"(?:@\w+(?:\([^()]*\))?|\b(?:export|default|async|abstract))$", before):
                            break
                i += 1
            last = i - 1
            while last > first and bare[last].isspace():
                last -= 1
            if first < high and bare[first : last + 1].strip():
                out.append((first, body, last))
            i = max(i, first + 1)
        return out

    chunks: list[Chunk] = []
    module: list[tuple[int, int]] = []

    def span(first: int, last: int) -> tuple[int, int, str]:
        return line_of(first) + 1, line_of(last) + 1, text[first : last + 1]

    def head_of(first: int, body: int, last: int) -> str:
        low, high = line_of(first), line_of(body if body >= 0 else last)
        shown = lines[low : max(high, low + 1)] if body >= 0 and high > low else [lines[low]]
        return signature(shown)

    def add(kind: str, name: str, scope: list[str], first: int, body: int, last: int) -> None:
        a, b, content = span(first, last)
        chunks.append(Chunk(kind, name, ".".join([*scope, name]), scope[-1] if scope else None, a, b, head_of(first, body, last), content))

    def members(name: str, scope: list[str], first: int, body: int, last: int) -> None:
        at = len(chunks)
        path, start = [*scope, name], None
        for f, b, l in items(body + 1, closes.get(body, last), depth_at[body] + 1):
            source = bare[f : l + 1]
            c, m = _CLASS.get(language, re.compile("(?!)")).match(source), _METHOD.get(language, re.compile("(?!)")).match(source)
            if c and b >= 0:
                start = f if start is None else start
                members(c[1], path, f, b, l)
            elif m and m[1] not in _NOT_NAMES and (b >= 0 or language == "java" and "=" not in source.split("(")[0]):
                start = f if start is None else start
                add("method", m[1], path, f, b, l)
        content = (text[first:start] if start is not None else text[first : last + 1]).rstrip()
        a = line_of(first) + 1
        chunks.insert(at, Chunk("class", name, ".".join(path), scope[-1] if scope else None, a, a + content.count("\n"), head_of(first, body, last), content))

    for first, body, last in items(0, len(text), 0):
        source = bare[first : last + 1]
        f, c = _FUNCTION.get(language), _CLASS.get(language)
        if f and (m := f.match(source)) and (body >= 0 or language in ("rust", "go")):
            add("function", m[1], [], first, body, last)
        elif c and (m := c.match(re.sub(r"^(?:#\[[^\]]*\]\s*)+", lambda x: " " * len(x[0]), source).lstrip())):
            while bare[first] == "#" and language == "rust":
                first = closes.get(first + 1, first + 1) + 1
                while bare[first].isspace():
                    first += 1
            if language == "rust" or body < 0:
                add("class", m[1], [], first, body, last)
            else:
                members(m[1], [], first, body, last)
        elif language == "rust" and source.startswith("#[") and (m := f.match(re.sub(r"^(?:#\[[^\]]*\]\s*)+", "", source))):
            while bare[first] == "#":
                first = closes.get(first + 1, first + 1) + 1
                while bare[first].isspace():
                    first += 1
            add("function", m[1], [], first, body, last)
        elif not (source.startswith("export") or language == "go" and source.startswith("type") or language == "rust" and re.match(r"(?:unsafe\s+)?impl\b", source)):
            module.append((first, last))
    for m in re.finditer(r"//[^\n]*|/\*.*?\*/", text, re.S):
        if m.start() < len(depth_at) and depth_at[m.start()] == 0 and not bare[m.start() : m.end()].strip():
            module.append((m.start(), m.end() - 1))
    spans = [(c.first, c.last) for c in chunks if c.parent is None and c.kind != "module"]
    module = [x for x in sorted(module) if not any(a < line_of(x[0]) + 1 <= b for a, b in spans)]
    if module:
        a, b = span(module[0][0], module[0][1])[0], span(*module[-1])[1]
        chunks.insert(0, Chunk("module", stem, "", None, a, b, stem, "\n".join(text[f : l + 1].rstrip() for f, l in module)))
    return chunks


def _blocks(c: Chunk, language: str) -> list[Chunk]:
    """The blocks of a long function: each compound statement is one, runs of simple ones too."""
    lines = c.content.split("\n")
    body = lines[1:]
    shown = [len(x) - len(x.lstrip()) for x in body if x.strip()]
    level = min((x for x in shown if x > len(lines[0]) - len(lines[0].lstrip())), default=0)
    blocks: list[list] = []
    for i, x in enumerate(body, 1):
        own = len(x) - len(x.lstrip())
        word = m[0] if (m := re.match(r"[a-z]+", x.strip())) else ""
        starts = x.strip() and own == level and word in _LABELS
        follows = own > level or not x.strip() or re.match(r"\s*(?:[})\]]|else|elif|except|finally|catch)", x)
        if starts:
            blocks.append([_LABELS[word], i, i])
        elif blocks and (follows or blocks[-1][0] == "logic"):
            blocks[-1][2] = i
        else:
            blocks.append(["logic", i, i])
    out = []
    for k, (label, a, b) in enumerate(blocks):
        first, last = c.first + a, c.first + b
        head = f"[in {c.qualified}()]\n{c.signature}\n# --- block {k + 1}/{len(blocks)}: {label} (L{first}-L{last}) ---\n"
        out.append(Chunk(c.kind, f"{c.symbol}:blk/{k}", c.qualified, c.parent, first, last, c.signature, head + "\n".join(lines[a : b + 1])))
    return out


def chunk_text(path: str, text: str, most_lines: int = MOST_LINES) -> list[Chunk]:
    """Chunks of a file in order: the module first. Other suffixes and blank texts have none."""
    language = LANGUAGE_OF.get(path.rpartition(".")[2])
    if language is None or not text or not text.strip():
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    stem = path.rpartition("/")[2].rpartition(".")[0]
    made = _python(text, stem) if language == "python" else _braced(text, stem, language)
    out: list[Chunk] = []
    for c in made:
        long = c.kind in ("function", "method") and c.last - c.first + 1 > most_lines
        out += _blocks(c, language) if long else [c]
    seen: set[str] = set()
    for c in out:
        base = f"{path}::{c.qualified or '<module>'}" + (":" + c.symbol.partition(":")[2] if ":blk/" in c.symbol else "")
        c.chunk_id = base if base not in seen else f"{base}:{c.first}"
        seen.add(base)
    return out


SCHEMA = "chunk_id string, file_path string, language string, chunk_type string, symbol string, qualified_name string, parent_class string, start_line int, end_line int, imports array<string>, signature string, docstring string, content string, content_hash string"


def chunk_table(files: DataFrame, path_col: str = "file_path", content_col: str = "content") -> DataFrame:
    """All chunks of files(path, content). Rows don't move; each task parses what it reads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"]):
                for c in chunk_text(path, text or ""):
                    rows.append((c.chunk_id, path, LANGUAGE_OF[path.rpartition(".")[2]], c.kind, c.symbol, c.qualified, c.parent, c.first, c.last, c.imports, c.signature, c.docstring, c.content, hashlib.sha256(c.content.encode("utf-8", "replace")).hexdigest()))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    return files.selectExpr(f"`{path_col}` AS path", f"`{content_col}` AS text").where("path is not null").mapInPandas(run, SCHEMA)
