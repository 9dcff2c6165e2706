"""Problem 6: encoding a corpus with a byte-level BPE vocabulary.

The encoder is a streaming transducer over the bytes of each pre-token. For every byte position it
keeps the last token of the one encoding of the prefix that ends there: the unique token whose
predecessor is *compatible* with it, that is, whose pair is left as it is by the merge list. No token is
longer than `lookahead` bytes, so whatever follows can only attach to one of the last `lookahead`
positions; once the paths of all of these share a token, that token can't change any more and is
emitted. So memory is bounded by the window, whatever the length of the pre-token. Short pre-tokens go
through a memo table, which is the transducer's transition table filled on demand.

Empty and null texts have an empty list of ids.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_DIR = os.environ.get("SYMDEX_TOKENIZERS", "/opt/tokenizers")
#: The pre-token pattern published with the byte_bpe_50k vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_ENTRIES = 400_000  # the memo is emptied when it holds so many; it only saves time
FEW_CHARS = 65_536  # of longer texts the pre-tokens are taken one by one, which is slower but holds one only
MEMO_BYTES = 48  # longer pre-tokens stream through the transducer


def load_ranks(name: str = "byte_bpe_50k", folder: str | None = None) -> dict[bytes, int]:
    """The vocabulary file `<folder>/<name>.tiktoken` as token bytes to id."""
    with open(os.path.join(folder or DEFAULT_DIR, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Streaming byte-level BPE with bounded lookahead."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.lookahead = max(map(len, ranks))
        self._compatible: dict[int, bool] = {}
        self._memo: dict[str, tuple[int, ...]] = {}
        self._split = regex.compile(PATTERN)
        # An automaton over bytes, made as it is walked: a state is the longest end of what was read that some token begins with.
        self._begins = {b[:k] for b in ranks for k in range(1, len(b) + 1)} | {b""}
        self._states: list[bytes] = [b""]
        self._number: dict[bytes, int] = {b"": 0}
        self._next: dict[int, int] = {}  # state * 256 + byte
        self._ending: list[tuple[tuple[int, int], ...]] = [()]  # (token, length) of the tokens that end in a state, longest first

    def _step(self, at: int, byte: int) -> int:
        """The state that a byte leads to, where it isn't known yet."""
        raw = self._states[at] + bytes((byte,))
        while raw not in self._begins:
            raw = raw[1:]
        found = self._number.get(raw)
        if found is None:
            found = self._number[raw] = len(self._states)
            self._states.append(raw)
            self._ending.append(tuple((self.ranks[raw[k:]], len(raw) - k) for k in range(len(raw)) if raw[k:] in self.ranks))
        self._next[at << 8 | byte] = found
        return found

    def _merged(self, raw: bytes) -> list[int]:
        """Merge by rank; for the few bytes of a pair of tokens only."""
        get, parts = self.ranks.get, [raw[i : i + 1] for i in range(len(raw))]
        none = 1 << 60
        pairs = [get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pairs and (least := min(pairs)) < none:
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merge list leaves these two tokens side by side as they are; left may be -1, the start."""
        key = left << 32 | right
        found = self._compatible.get(key)
        if found is None:
            if len(self._compatible) > MEMO_ENTRIES:
                self._compatible.clear()
            both = [right] if left < 0 else [left, right]
            found = self._compatible[key] = self._merged(b"".join(self.bytes_of[t] for t in both)) == both
        return found

    def stream(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one pre-token that comes in blocks of bytes, each emitted as soon as it is stable."""
        window = self.lookahead
        last: deque[int] = deque()  # last token of the prefix that ends after position base + k
        before = -1  # the token emitted last; what it covers is forgotten
        due = window * 4
        state, step, ending, known = 0, self._next, self._ending, self._compatible
        n = 0
        for block in blocks:
            for byte in block:
                to = step.get(state << 8 | byte)
                state = self._step(state, byte) if to is None else to
                n += 1
                for t, size in ending[state]:
                    if size <= n:
                        previous = last[n - size - 1] if n > size else before
                        fits = known.get(previous << 32 | t)
                        if self.compatible(previous, t) if fits is None else fits:
                            last.append(t)
                            break
                else:
                    raise ValueError("the vocabulary lacks a byte")
                if n >= due:
                    ids, used = self._stable(last, window)
                    yield from ids
                    if ids:
                        before = ids[-1]
                        for _ in range(used):
                            last.popleft()
                        n -= used
                    due = n + window
        ids = []
        while n > 0:
            ids.append(last[n - 1])
            n -= len(self.bytes_of[ids[-1]])
        yield from reversed(ids)

    def _stable(self, last: deque[int], window: int) -> tuple[list[int], int]:
        """Tokens that the encodings of all of the last `window` prefixes share."""
        paths = None
        for end in range(len(last) - window, len(last) + 1):
            cuts = set()
            at = end
            while at > 0:
                cuts.add(at)
                at -= len(self.bytes_of[last[at - 1]])
            paths = cuts if paths is None else paths & cuts
            if not paths:
                return [], 0
        used = max(paths)
        ids, at = [], used
        while at > 0:
            ids.append(last[at - 1])
            at -= len(self.bytes_of[ids[-1]])
        return ids[::-1], used

    def _piece(self, piece: str) -> tuple[int, ...]:
        if len(piece) * 4 <= MEMO_BYTES or len(raw := piece.encode()) <= MEMO_BYTES:
            ids = tuple(self.stream([piece.encode()]))
            if len(self._memo) >= MEMO_ENTRIES:
                self._memo.clear()
            self._memo[piece] = ids
            return ids
        return tuple(self.stream(raw[i : i + 4096] for i in range(0, len(raw), 4096)))

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        memo = self._memo
        if text and len(text) > FEW_CHARS:
            for m in self._split.finditer(text):
                out += memo.get(m[0]) or self._piece(m[0])
            return out
        for piece in self._split.findall(text or ""):
            out += memo.get(piece) or self._piece(piece)
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids, piece by piece: a state machine holds the bytes of an unfinished character."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if out := machine.decode(self.bytes_of[i]):
                yield out
        if out := machine.decode(b"", True):
            yield out


_made: dict[int, Transducer] = {}


def transducer(shared) -> Transducer:
    """One transducer for each Python worker and broadcast vocabulary."""
    if shared.id not in _made:
        _made.clear()
        _made[shared.id] = Transducer(shared.value)
    return _made[shared.id]


class _Shared:
    """A broadcast vocabulary (fixed size: one vocabulary file) under an id that workers can tell it by."""

    def __init__(self, spark, ranks) -> None:
        self.b = spark.sparkContext.broadcast(ranks)
        self.id = hash((len(ranks), next(iter(ranks.items()))))

    @property
    def value(self):
        return self.b.value


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "ids", name: str = "byte_bpe_50k", folder: str | None = None, count_only: bool = False) -> DataFrame:
    """(id, ids) of every row: the token ids of its text, [] for null and empty texts.

    count_only gives the number of ids as int instead. Rows aren't moved: no shuffle.
    """
    shared = _Shared(df.sparkSession, load_ranks(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(shared)
        for b in batches:
            keys, texts = b.column(0), b.column(1)
            for at in range(0, len(b), 256):
                ids = [t.encode(x) for x in texts.slice(at, 256).to_pylist()]
                col = pa.array(map(len, ids), pa.int32()) if count_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(at, 256), col], ["key", "value"])

    kind = df.schema[id_col].dataType.simpleString()
    made = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("value")).mapInArrow(run, f"key {kind}, value {'int' if count_only else 'array<int>'}")
    return made.select(F.col("key").alias(id_col), F.col("value").alias(out))


def roundtrip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, n_chars, same): whether decoding the ids piece by piece gives the text again."""
    shared = _Shared(df.sparkSession, load_ranks(name, folder))

    def run(batches):
        t = transducer(shared)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            same = ["".join(t.decode(t.encode(x))) == x for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(same)], ["key", "n", "same"])

    kind = df.schema[id_col].dataType.simpleString()
    made = df.select(F.col(id_col).alias("key"), F.col(text_col).alias("value")).mapInArrow(run, f"key {kind}, n bigint, same boolean")
    return made.select(F.col("key").alias(id_col), F.col("n").alias("n_chars"), "same")
