"""Problem 2: functions with the description in their documentation comment.

Per file, comments and functions are matched as a bipartite assignment. What links are plausible follows from what documentation is in each language:
comments directly above, one on the other, but for attributes of Rust. Their cost is made of distance, parameter tags and names, so these decide
where comments are stacked or several functions start on a line; mostly a function has one candidate. In Python the docstring is in the function's own code,
so its link is certain.

Functions of files that aren't in the source table can only have docstrings. Null contents give no rows; repeated rows
of a chunk or a file count once. Lines of chunks are those of the file with line ends made uniform.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 4
_TOKENS = re.compile(r"\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|#[^\n]*|[\[({]|[\])}]|:|\bdef\b|\bclass\b", re.S)
_DOCSTRING = re.compile(r"(?:\s|#[^\n]*|\\\n)*[rRuU]?(?:(?P<q>\"\"\"|''')(?P<a>(?:\\.|(?!(?P=q)).)*)(?P=q)|\"(?P<b>(?:\\.|[^\"\\\n])*)\"|'(?P<c>(?:\\.|[^'\\\n])*)')[ \t]*(?=[\n;#]|\Z)", re.S)
_WORDS = re.compile(r"[㐀-䶿一-鿿豈-﫿𠀀-𲎯぀-ヿ]|(?:(?![㐀-䶿一-鿿豈-﫿𠀀-𲎯぀-ヿ])[^\W_])+(?:['’](?:(?![㐀-䶿一-鿿])[^\W_])+)*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")
#: Words that a comment may add to the function's name without saying more, and phrases that stand in for a description.
FILLERS = frozenset("a an the this that it its is of for to does do function functions method methods fn func procedure constructor implementation implements helper see here".split())
STANDINS = tuple(
    re.compile(p)
    for p in (
        r"(?:to ?do|tbd|tba|fix ?me|xxx|wip)\b(?! aside)(?!,? (?:this|list|items?)\b)",
        r"(?:auto|automatically)[- ]?generated (?:method|constructor|function|catch|javadoc|doc\w*|comment|stub)",
        r"(?:a |the )?(?:method |function )?(?:description|documentation|docs?|docstring|summary|comment|text)s? (?:goes?|comes?|will (?:go|follow|come|be)|to (?:be|follow|come)|is (?:missing|pending|to)|pending|missing|needed|follows?\b|here\b|tbd)",
        r"(?:please )?(?:add|insert|write|put|fill in|enter|provide|supply|complete)\b[^.]{0,30}\b(?:description|documentation|docs?|docstring|summary|comment|text)s?\b",
        r"(?:needs?|requires?|missing|lacks?|no|not yet|without) (?:a |any |some |proper |yet )*(?:description|documentation|documented|docs?|docstring|comment)s?\b",
        r"(?:to be|not|still|will be|must be|should be) (?:yet |still )?(?:documented|described|written|completed|filled in|done|defined)\b",
        r"(?:placeholder|lorem ipsum|undocumented|coming soon|fill me|write me|document (?:me|this)|describe (?:me|this)|insert here|stub)\b",
    )
)


@dataclass(frozen=True)
class Comment:
    first: int
    last: int
    text: str
    documents: bool


def _blocks(lines: list[str], language: str) -> list[Comment]:
    """Comments that stand on lines of their own. Lines count from 1."""
    out: list[Comment] = []
    i, n = 0, len(lines)
    while i < n:
        s = lines[i].strip()
        if s.startswith("/*"):
            j = i
            while j < n and "*/" not in (lines[j].strip()[2:] if j == i else lines[j]):
                j += 1
            j = min(j, n - 1)
            body = [x.strip() for x in lines[i : j + 1]]
            tail = body[-1].split("*/", 1)[-1].strip() if "*/" in body[-1] else ""
            if not tail:
                is_doc = s.startswith("/**") and not s.startswith(("/***", "/**/")) and language != "go"
                body[0] = re.sub(r"^/\*+!?", "", body[0])
                body[-1] = re.sub(r"\*+/$", "", body[-1])
                out.append(Comment(i + 1, j + 1, "\n".join(re.sub(r"^\*(?!\*)\s?|^\*+$", "", x.strip()) for x in body), is_doc))
            i = j + 1
        elif s.startswith("//"):
            mark = "///" if language == "rust" and s.startswith("///") and not s.startswith("////") else "//"
            j = i
            body = []
            while j < n and (x := lines[j].strip()).startswith(mark) and (mark == "///" or language != "rust" or not x.startswith("///") or x.startswith("////")):
                body.append(x)
                j += 1
            kept = [x for x in body if not (language == "go" and re.match(r"//(?:go:|line |export |nolint|\+build)", x))]
            is_doc = language == "go" or mark == "///"
            out.append(Comment(i + 1, j, "\n".join(x[len(mark) :].strip() for x in kept), is_doc))
            i = j
        else:
            i += 1
    return out


def _attributes_above(lines: list[str], start: int) -> int:
    """The first line of the attributes that stand directly above line `start` (1-based), or start."""
    at = start
    while at > 1:
        low, depth = at - 1, 0
        if not lines[low - 1].rstrip().endswith("]") or lines[low - 1].lstrip().startswith("//"):
            break
        # up to where the brackets of an attribute of several lines close
        while not lines[low - 1].lstrip().startswith("#"):
            depth += lines[low - 1].count("]") - lines[low - 1].count("[")
            if depth <= 0 or low == 1:
                break
            low -= 1
        if not lines[low - 1].lstrip().startswith(("#[", "#![")):
            break
        at = low
    return at


def assign(costs: list[dict[int, float]]) -> list[int | None]:
    """For each function the comment it gets, by least total cost with as many links as possible.

    costs[f] has the cost of each plausible comment. Successive shortest augmenting paths (Bellman-Ford over the
    few links of a file).
    """
    owner: dict[int, int] = {}
    got: list[int | None] = [None] * len(costs)
    for f0 in range(len(costs)):
        if not costs[f0]:
            continue
        best: dict[int, tuple[float, int]] = {}
        queue = [(f0, 0.0)]
        while queue:
            f, so_far = queue.pop(0)
            for c, cost in costs[f].items():
                if got[f] == c:
                    continue
                total = so_far + cost
                if c not in best or total < best[c][0] - 1e-9:
                    best[c] = (total, f)
                    if c in owner and owner[c] != f0:
                        queue.append((owner[c], total - costs[owner[c]][c]))
        free = [(v[0], c) for c, v in best.items() if c not in owner]
        if not free:
            continue
        c: int | None = min(free)[1]
        seen = 0
        while c is not None and seen <= len(costs):
            f = best[c][1]
            given, got[f], owner[c] = got[f], c, f
            c = given
            seen += 1
    return got


def name_parts(symbol: str) -> list[str]:
    return [p.lower() for p in _PARTS.findall(symbol or "")]


_PARAM = re.compile(r"[@\\]param(?:\[\w+\])?\s+(?:\{[^}]*\}\s*)?(?:<[^>]*>\s*)?\[?\.{0,3}([A-Za-z_$][\w$]*)|^\s*[*-]\s+`([A-Za-z_]\w*)`", re.M)
_IDENT = re.compile(r"[A-Za-z_$][\w$]*")
#: What a link costs: each documentation comment between, all parameter tags naming other parameters; what mentioning the name saves; and what leaves a function unlinked.
FURTHER, STRANGE, NAMED, UNLINKED = 1.0, 1.5, 0.25, 3.0


def cost(comment: Comment, between: int, symbol: str, signature: str | None) -> float:
    """Of linking a comment to a function: by distance, by parameter tags the signature doesn't have, by the function's name in the text."""
    tags = {a or b for a, b in _PARAM.findall(comment.text)}
    known = set(_IDENT.findall((signature or "").partition("(")[2]))
    strange = len(tags - known) / len(tags) if tags and known else 0.0
    named = bool(symbol) and re.search(rf"(?<!\w){re.escape(symbol)}(?!\w)", comment.text) is not None
    return FURTHER * between + STRANGE * strange - NAMED * named


def link(lines: list[str], language: str, functions: list[tuple[int, str, str | None]]) -> list[str | None]:
    """The documentation comment of each function (start line, symbol, signature) of a file, or None.

    Candidates of a function are the documentation comments that stand above it one on the other, without a blank line. Which functions get which comments is
    the assignment of least total cost, an unlinked function costing UNLINKED. Functions of one line with fewer comments than functions share the cheapest.
    """
    comments = _blocks(lines, language)
    ending = {c.last: k for k, c in enumerate(comments) if c.documents}
    tops = [_attributes_above(lines, start) if language == "rust" else start for start, _, _ in functions]
    costs: list[dict[int, float]] = []
    for top, (_, symbol, signature) in zip(tops, functions):
        found: dict[int, float] = {}
        above = top - 1
        while (k := ending.get(above)) is not None and FURTHER * len(found) - NAMED < UNLINKED:
            price = cost(comments[k], len(found), symbol, signature)
            found[k] = min(price, UNLINKED + len(found))
            above = comments[k].first - 1
        costs.append({k: c for k, c in found.items() if c < UNLINKED})
    given = assign(costs)
    cheapest = [min(c, key=lambda k: (c[k], k)) if c else None for c in costs]
    return [comments[k].text if (k := g if g is not None else c) is not None else None for g, c in zip(given, cheapest)]


def docstring(content: str) -> str | None:
    """The docstring of a Python function, from its code."""
    depth, seen = 0, False
    for m in _TOKENS.finditer(content):
        t = m.group(0)
        if t == "def":
            seen = seen or depth == 0
        elif t in "[({":
            depth += 1
        elif t in "])}":
            depth -= 1
        elif t == ":" and seen and depth == 0:
            d = _DOCSTRING.match(content, m.end())
            if not d:
                return None
            text = next(x for x in (d["a"], d["b"], d["c"]) if x is not None)
            return re.sub(r"\\\n", "", text)
    return None


_SECTION = re.compile(r"^(?:args?|arguments?|params?|parameters?|other parameters|keyword args|kwargs|attributes|returns?|yields?|raises?|throws|exceptions?|errors|panics|safety|examples?|see also|references|todo|warns?|warnings)\s*:?\s*$", re.I)
_TAG = re.compile(r"^(?:[@\\](?!(?:description|desc|summary|brief|details|remarks)\b)[A-Za-z]\w*|:(?:param|parameter|arg|argument|key|keyword|type|raises?|except|exception|returns?|rtype|var|ivar|cvar|vartype|meta|yields?)\b[^:\n]*:)", re.I)
_MARKUP = re.compile(r"\{@(?:link|code|linkplain|literal|value)\s+([^}]*)\}|\{@\w+\}|</?[A-Za-z][^<>\n]*>|!?\[([^\]]*)\]\([^)]*\)|[`*_~#=|>+-]{1,}|:[a-z]+:`|^\s*[@\\](?:description|desc|summary|brief|details|remarks)\b", re.M)


def description(text: str) -> str:
    """What a documentation comment says apart from markup and from its tags, parameter and return entries."""
    text = re.sub(r"```.*?(?:```|\Z)", "\n", text, flags=re.S)
    kept: list[str] = []
    skip: str | None = None
    indent = 0
    lines = text.expandtabs(4).split("\n")
    for i, line in enumerate(lines):
        s = line.strip()
        own = len(line) - len(line.lstrip())
        following = lines[i + 1].strip() if i + 1 < len(lines) else ""
        bare = s.lstrip("#*").strip().rstrip("*").strip()
        if _SECTION.match(bare) and (s.startswith("#") or bare.endswith(":") or s.endswith(":") or s.startswith("**") or re.fullmatch(r"[-=~^]{3,}", following)):
            skip, indent = ("heading" if s.startswith("#") else "dashes" if re.fullmatch(r"[-=~^]{3,}", following) else "indented"), own
            continue
        if m := re.match(r"(?:args?|parameters?|params?|returns?|raises?|yields?|throws)\s*:\s+\S", s, re.I):
            skip, indent = "indented", own
            continue
        if _TAG.match(s):
            skip, indent = "tag", own
            continue
        if skip == "heading" and s.startswith("#"):
            skip = None
        elif skip == "tag" and not s:
            skip = None
        elif skip == "indented" and s and own <= indent:
            skip = None
        elif skip == "dashes" and not s:
            skip = "after dashes"
        elif skip == "after dashes" and s and own <= indent and not re.match(r"\*{0,2}\w+\s*:\s*\S", s):
            skip = None
        if skip is None:
            kept.append(s)
    flat = _MARKUP.sub(lambda m: f" {m.group(1) or m.group(2) or ''} ", "\n".join(kept))
    return re.sub(r"[ \t]+", " ", flat).strip()


def trivial(said: str, symbol: str) -> bool:
    words = [w.lower() for w in _WORDS.findall(said)]
    if len(words) < LEAST_WORDS:
        return True
    low = " ".join(said.lower().split()).lstrip("\"'([<-—–.:* ")
    if any(p.match(low) for p in STANDINS):
        return True
    own = set(name_parts(symbol))
    own |= {"".join(name_parts(symbol)), *(w + "s" for w in own), *(w + "es" for w in own), *(w + "ing" for w in own), *(w + "ed" for w in own), *(w[:-1] + "ing" for w in own), *(w + "d" for w in own)}
    return all(w in own or w in FILLERS for w in words)


def pairs(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(chunk_id, signature, code, description) of all functions and methods with a real description.

    The functions of a file go to where its text is as one set, which the file's length bounds (repeated rows fall together before
    the shuffle); both sides are shuffled once by file_path. Python needs no file, so its chunks don't move at all.
    """
    wanted = chunks.where(F.col("chunk_type").isin("function", "method") & (F.length(F.trim("content")) > 0) & F.col("chunk_id").isNotNull())
    suffix = F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1)
    python = wanted.where(suffix == "py").select("chunk_id", "symbol", "signature", "content")

    def from_code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, symbol, signature, content in zip(b["chunk_id"], b["symbol"], b["signature"], b["content"]):
                content = content.replace("\r\n", "\n").replace("\r", "\n")
                text = docstring(content)
                if text and text.strip() and not trivial(said := description(text), symbol or ""):
                    out.append((key, signature, content, said))
            yield pd.DataFrame(out, columns=["chunk_id", "signature", "code", "description"])

    schema = "chunk_id string, signature string, code string, description string"
    first = python.mapInPandas(from_code, schema)
    entry = F.struct("chunk_id", F.col("start_line").cast("int").alias("start"), "symbol", "signature", F.regexp_replace("content", r"\r\n?", "\n").alias("code"))
    # only functions below a line that ends a comment matter, but that is the file's to say
    listed = wanted.where((suffix != "py") & F.col("start_line").isNotNull() & F.col("file_path").isNotNull()).select("file_path", entry.alias("f")).groupBy("file_path").agg(F.collect_set("f").alias("functions"))
    texts = files.where((F.length(F.trim("content")) > 0) & ~F.col("file_path").endswith(".py") & F.col("content").rlike(r"//|/\*\*")).select("file_path", F.col("content").alias("text"), suffix.alias("suffix"))

    def from_file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, ending, functions in zip(b["text"], b["suffix"], b["functions"]):
                lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                language = {"go": "go", "rs": "rust"}.get(ending, "other")
                once = list({f["chunk_id"]: f for f in functions}.values())
                for f, comment in zip(once, link(lines, language, [(f["start"], f["symbol"] or "", f["signature"]) for f in once])):
                    if comment and not trivial(said := description(comment), f["symbol"] or ""):
                        out.append((f["chunk_id"], f["signature"], f["code"], said))
            yield pd.DataFrame(out, columns=["chunk_id", "signature", "code", "description"])

    second = texts.join(listed, "file_path").select("text", "suffix", "functions").mapInPandas(from_file, schema)
    return first.unionByName(second).groupBy("chunk_id").agg(F.min(F.struct("signature", "code", "description")).alias("x")).select("chunk_id", "x.signature", "x.code", "x.description")


def found(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(chunk_id) of `pairs`."""
    return pairs(chunks, files).select("chunk_id").distinct()
