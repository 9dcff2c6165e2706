"""Problem 4: cutting oversized items at natural boundaries, with overlap.

Recursive bisection: a segment that is over the limit, less what the overlap will take, is cut at the
strongest boundary near its midpoint and each half is treated alike. The last lines of the piece
before are then attached to each piece but the first. Only a line that alone is over the limit is
cut inside, at the strongest character boundary near its middle.

Line ends are made uniform first. A text within the limits comes out as one piece, a null or empty one not at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LINES, MAX_CHARS, OVERLAP = 200, 8000, 5
_OPENS = re.compile(r"[\[{(]")
_CLOSES = re.compile(r"[\]})]")
_STRINGS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//.*|#.*")


def boundary_strengths(lines: list[str]) -> list[float]:
    """Strength of the boundary before each line; that of line 0 is never used.

    Strong: blank lines, a return to little indentation, shallow bracket depth. Weak: before a closing
    bracket, after a line that is to be continued.
    """
    depth, depths, indents = 0, [], []
    for line in lines:
        depths.append(depth)
        bare = _STRINGS.sub("", line)
        depth = max(0, depth + len(_OPENS.findall(bare)) - len(_CLOSES.findall(bare)))
        text = line.expandtabs(4)
        indents.append(len(text) - len(text.lstrip()) if text.strip() else -1)
    shown = [x for x in indents if x >= 0]
    least = min(shown) if shown else 0
    following, nearest = least, [least] * len(lines)
    for i in range(len(lines) - 1, -1, -1):
        following = indents[i] if indents[i] >= 0 else following
        nearest[i] = following
    out = [0.0]
    for i in range(1, len(lines)):
        before, line = lines[i - 1].strip(), lines[i].strip()
        s = 8.0 / (1 + (nearest[i] - least) / 4) + 4.0 / (1 + depths[i])
        if not before:
            s += 4
        if not line:
            s -= 1  # the blank line goes with the piece before
        if line[:1] in ("}", ")", "]") or re.match(r"(else|elif|except|finally|catch|case)\b", line):
            s -= 6
        if before.endswith(("(", "[", ",", "\\", "{", ":", "=", "&&", "||", "+")) or before.startswith(("@", "#[")):
            s -= 5
        out.append(s)
    return out


def _inside(text: str, room: int) -> list[str]:
    """A line over the limit as pieces of at most `room` characters, bisected at the strongest character boundary."""
    if len(text) <= room:
        return [text]
    middle, reach = len(text) // 2, min(len(text) // 4, 200)
    best = max(range(middle - reach, middle + reach + 1), key=lambda i: (3 * (text[i - 1] in ";}") + 2 * (text[i - 1] in ",)]") + (text[i - 1].isspace()), -abs(i - middle)))
    return _inside(text[:best], room) + _inside(text[best:], room)


def split_text(text: str, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, str]]:
    """Pieces as (first line, last line, lines of overlap, first character of its own in its line, content); lines count from 0.

    Without the lines of overlap the contents, joined by a line end where a piece starts at character 0,
    are the text. Line ends must be uniform. A final line end belongs to the last line, it begins no line.
    """
    tail = "\n" if text.endswith("\n") else ""
    lines = text[: len(text) - len(tail)].split("\n")
    if tail:
        lines[-1] += "\n"
    if len(lines) <= max_lines and len(text) <= max_chars:
        return [(0, len(lines) - 1, 0, 0, text)]
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    starts.append(at)
    strength = boundary_strengths(lines)

    def lead(a: int) -> int:
        """Lines before line a that its piece will repeat: `overlap`, fewer where they'd take more than half of the limit."""
        n = min(overlap, a, max_lines // 2)
        while n and starts[a] - starts[a - n] > max_chars // 2:
            n -= 1
        return n

    def fits(a: int, b: int) -> bool:
        n = lead(a)
        return b - (a - n) <= max_lines and starts[b] - starts[a - n] - 1 <= max_chars

    own: list[tuple[int, int]] = []
    todo = [(0, len(lines))]
    while todo:
        a, b = todo.pop()
        if b - a == 1 or fits(a, b):
            own.append((a, b))
            continue
        middle = a + (b - a) // 2
        if starts[b] - starts[a] > max_chars:  # the midpoint in characters, where these are what is over
            half = (starts[a] + starts[b]) // 2
            middle = min(max(a + 1, next(i for i in range(a, b + 1) if starts[i] >= half)), b - 1)
        reach = max(1, (b - a) // 4)
        cut = max(range(max(a + 1, middle - reach), min(b - 1, middle + reach) + 1), key=lambda i: (strength[i] - 4 * abs(i - middle) / reach, -i))
        todo += [(cut, b), (a, cut)]
    pieces: list[tuple[int, int, int, int, str]] = []
    previous = 0
    for a, b in own:
        n = min(lead(a), a - previous)
        inner = _inside(lines[a], max_chars - (starts[a] - starts[a - n])) if b - a == 1 else ["\n".join(lines[a:b])]
        at = 0
        for k, piece in enumerate(inner):
            if k:  # a piece of a line repeats nothing: the limit leaves no room for whole lines of this length
                pieces.append((a, a, 0, at, piece))
            else:
                pieces.append((a - n, b - 1, n, 0, "".join(x + "\n" for x in lines[a - n : a]) + piece))
            at += len(piece)
        previous = pieces[-1][0]
    return pieces


def uniform(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def oversized(content: Column, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> Column:
    """Whether a content with uniform line ends is over a limit; a final line end begins no line."""
    lines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + F.when(content.endswith("\n"), 0).otherwise(1)
    return (lines > max_lines) | (F.length(content) > max_chars)


def split(df: DataFrame, id_col: str = "chunk_id", content_col: str = "content", start_col: str = "start_line", max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, only_oversized: bool = True) -> DataFrame:
    """(id, piece, n_pieces, start_line, end_line, overlap_lines, start_char, content), one row per piece.

    Lines are those of the file: `start_col` is that of the content's first line (null counts as 1). Rows
    that come more than once give their pieces once. Where only_oversized is False, contents within the limits give
    one piece as well.
    """
    rows = df.select(F.col(id_col).alias("id"), uniform(F.col(content_col)).alias("text"), F.coalesce(F.col(start_col).cast("int"), F.lit(1)).alias("line")).where("length(text) > 0")
    if only_oversized:
        rows = rows.where(oversized(F.col("text"), max_lines, max_chars))
    rows = rows.dropDuplicates(["id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text, line in zip(b["id"], b["text"], b["line"]):
                pieces = split_text(text, max_lines, max_chars, overlap)
                out += [(key, k, len(pieces), line + p[0], line + p[1], p[2], p[3], p[4]) for k, p in enumerate(pieces)]
            yield pd.DataFrame(out, columns=["id", "piece", "n_pieces", "start_line", "end_line", "overlap_lines", "start_char", "content"])

    made = rows.mapInPandas(run, "id string, piece int, n_pieces int, start_line int, end_line int, overlap_lines int, start_char int, content string")
    return made.withColumnRenamed("id", id_col)


def found(df: DataFrame) -> DataFrame:
    """(chunk_id) of the chunks that had to be cut."""
    return split(df).where("piece = 0 and n_pieces > 1").select("chunk_id")
