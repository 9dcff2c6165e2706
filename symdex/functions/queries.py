"""Query strings: parsing into phrases, expansion by synonyms, window presets. All of it is about one query, on the driver."""

from __future__ import annotations

import json
import re
from pathlib import Path

import numpy as np

from .text import CJK_RANGES, FOLD_FROM, FOLD_TO

_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_CJK = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES)
_TOKEN = re.compile(r"[^\W_]+")
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)

#: Groups of words that stand for each other in code. A word of several groups belongs to the last.
CLUSTERS = """
get fetch retrieve obtain read load query select
create make build construct new init initialize generate
delete remove destroy drop clear erase purge unlink
update modify change edit alter mutate set patch
save write store persist put commit push
find search locate lookup discover scan
send dispatch emit publish post fire trigger
handle process manage deal serve respond
check validate verify assert test ensure
start begin launch boot open connect
stop end close shutdown terminate disconnect
convert transform parse serialize deserialize encode decode
compute calculate evaluate resolve derive
render display show draw paint format
log debug trace print warn error
configure setup prepare arrange provision
merge combine join concat fuse aggregate
split divide separate partition chunk
copy clone duplicate replicate
move transfer relocate migrate shift
auth authenticate login signin sign_in
user account profile identity
file document blob asset attachment
config setting option preference parameter env
error exception failure fault bug
api endpoint route handler controller
db database datastore storage repository
http request response client server
cache buffer pool memoize
async await coroutine future promise
token credential secret key password
analyze parse inspect examine extract
index catalog register enumerate list
sync synchronize replicate mirror push pull
"""


def cluster_lookup(clusters: str = CLUSTERS) -> dict[str, list[str]]:
    return {word: line.split() for line in clusters.strip().splitlines() for word in line.split()}


def bigrams(text: str) -> list[str]:
    return [x for run in re.findall(f"[{_CJK}]+", text) for x in ([run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)])]


def query_terms(text: str) -> list[str]:
    out = [p for word in re.findall(r"[A-Za-z0-9]+", text.replace("_", " ")) for p in (word, *filter(None, _CAMEL.split(word)))]
    return list(dict.fromkeys(x.lower() for x in out + bigrams(text)))


def index_tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower().translate(_FOLD))


def parse_query(text: str) -> list[list[str]]:
    """Phrases, any of which may match, as lists of index tokens: each term of a word, and each quoted phrase whole."""
    phrases: list[list[str]] = []
    for quoted, word in re.findall(r'"([^"]*)"|(\S+)', text):
        if word:
            phrases += [index_tokens(t) for t in query_terms(word)]
            continue
        clean = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", quoted)).strip()
        if clean:
            phrases.append(bigrams(clean) if re.fullmatch(rf"[{_CJK}\s]+", clean) else index_tokens(clean))
    return [list(p) for p in dict.fromkeys(tuple(p) for p in phrases if p)]


def expand_query(query: str, custom: dict[str, list[str]] | None = None, max_expansions: int = 3, nearest=None, trace: list | None = None) -> str:
    """The query followed by synonyms of its words.

    A word of `custom` adds all its synonyms; one of a cluster adds until max_expansions times the number of
    words are added in all; others ask `nearest(word, seen)` for (synonym, score) pairs, if given.
    """
    words = query.lower().split()
    limit, lookup = max_expansions * len(words), cluster_lookup()
    seen, added = set(words), []

    def take(found: list[str], most: float) -> list[str]:
        hits = []
        for s in found:
            if s not in seen:
                seen.add(s)
                added.append(s)
                hits.append(s)
                if len(added) >= most:
                    break
        return hits

    for word in words:
        if custom and word in custom:
            layer, hits = "custom", take(custom[word], float("inf"))
        elif word in lookup:
            layer, hits = "cluster", take([s for s in lookup[word] if s != word], limit)
        else:
            layer, hits = "embed", take([s for s, _ in nearest(word, seen)], float("inf")) if nearest else []
            if trace is not None and hits:
                trace.append({"term": word, "layer": layer, "synonyms": hits})
            if len(added) >= limit:
                break
            continue
        if trace is not None and hits:
            trace.append({"term": word, "layer": layer, "synonyms": hits})
    return f"{query} {' '.join(added)}" if added else query


def vocabulary(clusters: str = CLUSTERS) -> list[str]:
    """All words of the clusters in order, each once: what an embedding looks for synonyms among."""
    return list(dict.fromkeys(clusters.split()))


def embedded(embed, words: list[str] | None = None, threshold: float = 0.75, most: int = 3):
    """A `nearest` for `expand_query` from a model embed(list of texts) -> vectors: the words most similar to the one asked for.

    The vectors of the vocabulary are made when first asked for. Words already in the query are passed over; ties go by place in the vocabulary.
    """
    known: dict = {}

    def unit(texts: list[str]) -> np.ndarray:
        m = np.asarray(list(embed(texts)), float)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    def nearest(word: str, seen: set[str]) -> list[tuple[str, float]]:
        if not known:
            known["words"] = vocabulary() if words is None else list(words)
            known["vectors"] = unit(known["words"]) if known["words"] else None
        if known["vectors"] is None:
            return []
        near = known["vectors"] @ unit([word])[0]
        order = [i for i in np.argsort(-near, kind="stable") if near[i] >= threshold and known["words"][i] not in seen]
        return [(known["words"][i], float(near[i])) for i in order[:most]]

    return nearest


def load_synonyms(path: str | Path) -> dict[str, list[str]] | None:
    """Synonyms of a YAML or JSON file; entries that aren't lists of strings are left out, None if nothing remains."""
    try:
        text = Path(path).read_text("utf-8")
    except OSError:
        return None
    try:
        import yaml

        data = yaml.safe_load(text)
    except Exception:
        try:
            data = json.loads(text)
        except ValueError:
            return None
    if not isinstance(data, dict):
        return None
    return {k: v for k, v in data.items() if isinstance(k, str) and isinstance(v, list) and v and all(isinstance(x, str) for x in v)} or None


#: Lines of context before and after, by name.
WINDOWS = {"none": 0, "minimal": 2, "moderate": 5, "generous": 10}


def window(strategy: str) -> tuple[int, int]:
    if strategy.strip().lower() in WINDOWS:
        return (WINDOWS[strategy.strip().lower()],) * 2
    m = re.fullmatch(r"\s*(-?\d+)\s*,\s*(-?\d+)\s*", strategy)
    return (int(m[1]), int(m[2])) if m else (WINDOWS["moderate"],) * 2
