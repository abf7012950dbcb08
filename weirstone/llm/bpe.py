"""Problem 7: the whole corpus as token ids of a public byte-level BPE vocabulary.

The merges are compiled into a finite-state transducer over bytes that is determinised as it is used. While a piece is
read, every position from which some token may still reach beyond what has been read is a live configuration: the
state of the token trie since that position, and the tokens that lead to it. A new position's tokens are the ones of
the only predecessor whose last token may stand before the new one, which for merge-built vocabularies is decided by
that pair of tokens alone (`_Pairs`). A state is the tuple of live configurations; what all of them agree on is emitted
at once, so output lags the input by at most the longest token. Transitions, once worked out, are kept in a table
keyed by (state, byte).

Texts are cut into pieces by the vocabulary's pattern. A piece seen before comes from a bounded memo, all others run
through the transducer; ids don't depend on the memo, nor on its size.

Defined ids: null and empty texts give an empty list; strings of special tokens are ordinary text; any text is
encoded, whole, as UTF-8. `decode_stream` turns ids back into text with an incremental UTF-8 state machine.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries kept by the memos of transitions and pieces of one Python worker; beyond, a memo starts afresh.
TRANSITIONS, PIECES = 1_000_000, 1_000_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Pairs:
    """Whether two tokens may stand side by side: merging their joined bytes gives just the two."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.known = ranks, {}
        self.text = {i: t for t, i in ranks.items()}

    def merged(self, text: bytes) -> list[int]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fit(self, a: int, b: int) -> bool:
        key = a << 32 | b
        out = self.known.get(key)
        if out is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            out = self.known[key] = self.merged(self.text[a] + self.text[b]) == [a, b]
        return out


class Transducer:
    """States are tuples of configurations (trie node, last token, tokens not yet emitted), the newest position last."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.pairs = _Pairs(ranks)
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for text, i in ranks.items():
            if len(text) > 1 and self.pairs.merged(text) != [i]:
                continue  # no sequence of merges reaches it
            node = 0
            for byte in text:
                to = self.next[node].get(byte)
                if to is None:
                    to = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.token.append(-1)
                node = to
            self.token[node] = i
        self.start = ((0, -1, ()),)
        self.moves: dict = {}

    def _move(self, state: tuple, byte: int) -> tuple:
        live, born = [], None
        for node, last, out in state:
            to = self.next[node].get(byte)
            if to is None:
                continue
            tok = self.token[to]
            if born is None and tok >= 0 and (last < 0 or self.pairs.fit(last, tok)):
                born = (0, tok, (*out, tok))
            if self.next[to]:
                live.append((to, last, out))
        live.append(born)
        first = live[0][2]
        n = len(first)
        for _, _, out in live[1:]:
            k = 0
            while k < n and k < len(out) and out[k] == first[k]:
                k += 1
            n = k
        emitted = first[:n]
        return tuple((node, last, out[n:]) for node, last, out in live) if n else tuple(live), emitted

    def encode(self, piece: bytes) -> list[int]:
        state, ids, moves = self.start, [], self.moves
        for byte in piece:
            key = (state, byte)
            got = moves.get(key)
            if got is None:
                if len(moves) >= TRANSITIONS:
                    moves.clear()
                got = moves[key] = self._move(state, byte)
            state = got[0]
            if got[1]:
                ids.extend(got[1])
        ids.extend(state[-1][2])
        return ids


#: The same cut for the faster engine, on texts all of whose characters both engines class alike.
_PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""


class _Cutter:
    """Pieces of a text by the pattern; goes to the standard library's engine where that gives the same."""

    def __init__(self, pattern: str) -> None:
        self.exact = regex.compile(pattern).findall
        self.plain = re.compile(_PLAIN).findall if pattern == PATTERN else None
        self.alike: set[str] = set()

    def __call__(self, text: str) -> list[str]:
        if self.plain is None:
            return self.exact(text)
        for c in set(text) - self.alike:
            if unicodedata.category(c) in ("No", "Nl", "Cn", "Cs") or "\x1c" <= c <= "\x1f":  # digits that aren't decimal, newer letters, separators
                return self.exact(text)
            self.alike.add(c)
        return self.plain(text)


class _Pieces(dict):
    """Ids by piece; one that isn't there yet runs through the transducer."""

    def __init__(self, machine: Transducer) -> None:
        self.machine = machine

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= PIECES:
            self.clear()
        ids = self[piece] = self.machine.encode(piece.encode("utf-8", "surrogatepass"))
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.cut, self.ids_of = _Cutter(pattern), _Pieces(Transducer(ranks)).__getitem__

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.ids_of, self.cut(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.ids_of, self.cut(text)))) if text else 0


_encoders: dict[tuple, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker and vocabulary, with its memos, for as long as the worker lives."""
    key = shared.value[1:]  # pattern, and digest of the whole vocabulary
    if key not in _encoders:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value[0].splitlines())}
        _encoders[key] = Encoder(ranks, shared.value[1])
    return _encoders[key]


def _share(df: DataFrame, vocabulary: str, pattern: str):
    with open(vocabulary, "rb") as f:
        data = f.read()
    return df.sparkSession.sparkContext.broadcast((data, pattern, hashlib.sha256(data).hexdigest()))  # the vocabulary's file, under 1 MB


def encoded(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ids (array<int>) of every row, in whole texts."""
    shared = _share(documents, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared).encode
        for batch in batches:
            ends, flat = np.zeros(batch.num_rows + 1, np.int32), []
            for i, text in enumerate(batch["text"].to_pylist()):
                flat += encode(text)
                ends[i + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], ids], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def counted(documents: DataFrame, *keep: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, the columns `keep`, and tokens: how many ids the text has."""
    shared = _share(documents, vocabulary, pattern)
    rows = documents.select("doc_id", *keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoder(shared).count
        for batch in batches:
            n = pa.array([count(t) for t in batch["text"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("doc_id", *keep)], n], names=["doc_id", *keep, "tokens"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    return rows.mapInArrow(run, f"{kinds}, tokens bigint")


def decode_stream(ids: Iterable[int], text_of: dict[int, bytes]) -> Iterator[str]:
    """Text as soon as it is whole: bytes of a character that is not yet complete wait in the UTF-8 decoder's state."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        if piece := decoder.decode(text_of[i]):
            yield piece
    if rest := decoder.decode(b"", final=True):
        yield rest


def p7_ids(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return encoded(documents, vocabulary)
