"""Column functions of text analysis: identifiers, ideographs, query terms, tokens, globs, names of modules."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ideographs that have no spaces between words (not kana, not hangul), as ranges of code points.
CJK_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0x2F800, 0x2FA1F))
CJK = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"
CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with one mark, and what they are without it, by canonical decomposition."""
    found = {}
    for code in (*range(0xE0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(parts) == 2 and parts[0].isascii() and unicodedata.category(parts[1]) == "Mn":
            found[c] = parts[0]
    return "".join(found), "".join(found.values())


FOLD_FROM, FOLD_TO = _folds()
#: File suffixes of the languages.
SUFFIXES = {"python": ".py", "javascript": ".js .jsx .mjs .cjs", "typescript": ".ts .tsx .mts .cts", "go": ".go", "rust": ".rs", "java": ".java"}


def _not_empty(a: Column) -> Column:
    return F.filter(a, lambda x: F.length(x) > 0)


def camel_parts(c: Column) -> Column:
    """HTTPServer -> [HTTP, Server]; one part where nothing splits."""
    return _not_empty(F.split(c, CAMEL))


def split_identifiers(c: Column) -> Column:
    """Parts of all identifiers that have more than one, in order, as text.

    Boundaries are marked in one pass over the text, so nothing is done for each identifier.
    """
    marked = F.regexp_replace(c, CAMEL, "\x01")
    names = F.regexp_extract_all(marked, F.lit("[A-Za-z][A-Za-z0-9]*(?:\x01[A-Za-z0-9]+)+"), F.lit(0))
    return F.translate(F.array_join(names, " "), "\x01", " ")


def cjk_bigrams(c: Column) -> Column:
    """Overlapping pairs of each run of ideographs; a lone one is given as it is."""
    runs = F.regexp_extract_all(c, F.lit(f"{CJK}+"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))))
    return F.flatten(pairs)


def terms(c: Column) -> Column:
    """Distinct lower-case terms of a query: words at underscores, their parts, then pairs of ideographs."""
    words = _not_empty(F.split(F.array_join(F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+"), F.lit(0)), "_"), "_+"))
    pieces = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), camel_parts(w))))
    return F.array_distinct(F.transform(F.concat(pieces, cjk_bigrams(c)), F.lower))


def sanitize_phrase(c: Column) -> Column:
    """Marks to spaces, runs of spaces to one, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def all_cjk(c: Column) -> Column:
    return c.rlike(rf"^({CJK}|\s)+$")


def tokens(c: Column) -> Column:
    """The index's tokens: lower case, marks folded, runs of letters and digits."""
    return F.regexp_extract_all(F.translate(F.lower(c), FOLD_FROM, FOLD_TO), F.lit(TOKEN), F.lit(0))


def search_blob(symbol: Column, qualified: Column, imports: Column, signature: Column, docstring: Column, content: Column) -> Column:
    """What the index holds of a chunk: its fields, parts of its identifiers, pairs of its ideographs."""
    e = lambda x: F.coalesce(x, F.lit(""))
    joined = F.array_join(F.coalesce(imports, F.array().cast("array<string>")), " ")
    base = F.concat_ws("\n", e(symbol), e(qualified), joined, e(signature), e(docstring), e(content))
    extras = split_identifiers(F.concat_ws(" ", e(symbol), e(qualified), joined, e(content)))
    pairs = cjk_bigrams(F.concat_ws("\n", e(docstring), e(content)))
    return F.concat_ws("\n", base, F.nullif(extras, F.lit("")), F.nullif(F.array_join(pairs, " "), F.lit("")))


def glob_regex(pattern: str) -> str:
    """Anchored regex of a glob in which * also crosses slashes; `**/` and `**` mean *."""
    pattern = pattern.replace("**/", "*").replace("**", "*")
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] in "^!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def language_of(path: Column) -> Column:
    """Language of a path's suffix, or null; suffixes are case-sensitive."""
    suffix = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    out = F.lit(None).cast("string")
    for name, listed in SUFFIXES.items():
        out = F.when(suffix.isin(listed.split()), name).otherwise(out)
    return out


def module_name(path: Column) -> Column:
    """src/a/b.py -> a.b: no suffix, one leading src, lib, app or pkg dropped."""
    bare = F.regexp_replace(path, r"\.[^./]+$", "")
    return F.replace(F.regexp_replace(bare, r"^(src|lib|app|pkg)/", ""), F.lit("/"), F.lit("."))


def is_private(symbol: Column, language: Column) -> Column:
    """By the naming rule of the language: a leading underscore, in Go a small first letter, in Rust any but a capital; never in Java, nor without a name."""
    first = F.substring(symbol, 1, 1)
    capital, small = first != F.lower(first), first != F.upper(first)
    rule = F.when(language == "go", small).when(language == "rust", ~capital | (F.length(symbol) == 0)).when(language == "java", False).otherwise(symbol.startswith("_"))
    return F.coalesce(rule, F.lit(False))


def is_async(signature: Column, language: Column) -> Column:
    """Whether a signature has the language's async keyword; Go and Java have none."""
    has = signature.rlike(r"(?:^|[\s@])async\s+(?:def|function|fn|unsafe|extern|with|for|[\w$#\[*])")
    return F.coalesce(F.when(language.isin("go", "java"), False).otherwise(has), F.lit(False))


def import_candidate(c: Column) -> Column:
    """The stem of an import that is a path, any other as it is."""
    return F.when(c.rlike(r"[/\\]"), F.regexp_replace(F.regexp_extract(c, r"([^/\\]+)[/\\]*$", 1), r"(?<=.)\.[^.]+$", "")).otherwise(c)


def token_estimate(c: Column) -> Column:
    """Tokens by kind of character: 1.5 for each beyond ASCII, 0.25 for each other, at least 1."""
    ascii_only = F.length(F.regexp_replace(c, r"[^\x{0}-\x{7F}]", ""))
    return F.greatest(F.lit(1), F.floor(1.5 * (F.length(c) - ascii_only) + 0.25 * ascii_only).cast("int"))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)
