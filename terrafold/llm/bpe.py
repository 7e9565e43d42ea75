"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches (operator 8).

Ranks come from a public ``.tiktoken`` file whose path is a parameter; nothing is trained. A pair of tokens merges if
their joined bytes are a token, lowest rank first, leftmost on ties, inside each match of the pattern.

The library ranks pairs rather than joined tokens: pairs that join to one token get successive places. That is the same
as long as two such pairs don't overlap: XY = YZ for adjacent X, Y, Z. The strings XYZ for which that can happen are
listed when a codec is built; a match that holds one goes by the merge rule itself.

Edge cases: null counts as the empty text and has no ids; texts of any length are encoded whole, some of a batch at a
time; repeated rows and null ids give equal results; of pairs with one rank the leftmost is joined; a character split
over several tokens is decoded from its bytes; an id outside the table is an error; other columns than doc_id and text are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import small_batches

RESULT = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"
#: Distinct matches whose ids a worker remembers (about 250 bytes each); beyond that it starts anew.
REMEMBERED = 400_000
#: New matches given to the library at a time; characters of text split at a time, about.
TOGETHER, BLOCK = 16384, 1 << 20
#: For texts of characters below U+0250 only, the usual pattern with its classes written out, as the re module is faster.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u024f", "0-9²³¹¼-¾", "\\t-\\r \\x85\\xa0"
_USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = re.compile(f" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile("[^\x00-\u024f]")


@lru_cache(maxsize=1)
def byte_chars() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, more = [""] * 256, 256
    for b in range(256):
        if b in plain:
            table[b] = chr(b)
        else:
            table[b], more = chr(more), more + 1
    return table


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            self.token[i] = t
        c = byte_chars()
        self.chars = str.maketrans({b: c[b] for b in range(256)})
        text = lambda t: t.decode("latin-1").translate(self.chars)
        merges = [(text(t[:k]), text(t[k:])) for t, _ in sorted(self.ranks.items(), key=lambda x: x[1]) for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.model = Tokenizer(models.BPE(vocab={text(t): i for t, i in self.ranks.items()}, merges=merges, cache_capacity=0))
        self.pattern, self.usual = regex.compile(pattern), pattern == _USUAL
        self.known: dict[str, bytes] = {}
        r = self.ranks
        self.overlaps = ahocorasick.Automaton()
        for t in r:
            for n in range(1, (len(t) + 1) // 2):
                if t[:n] == t[-n:] and t[:n] in r and t[n:] in r and t[:-n] in r:
                    self.overlaps.add_word(text(t + t[n:]), 1)
        self.overlaps.make_automaton()

    def split(self, text: str) -> list[str]:
        return (_PLAIN if self.usual and not _OTHER.search(text) else self.pattern).findall(text)

    def by_rule(self, piece: bytes) -> tuple[int, ...]:
        """The merge rule itself, on one match: join the pair of lowest rank, leftmost first, until none is left.

        Parts are a linked list by their first byte, pairs a heap; a pair that has changed since is skipped.
        """
        n, get = len(piece), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: get(piece[i : end[end[i]]]) if i >= 0 and end[i] < n else None
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, upto = heapq.heappop(heap)
            if gone[i] or end[i] >= n or end[end[i]] != upto:
                continue
            gone[end[i]] = 1
            end[i] = upto
            if upto < n:
                before[upto] = i
            for k in (before[i], i):
                if (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[end[k]]))
        return tuple(self.ranks[piece[i : end[i]]] for i in range(n) if not gone[i])

    def learn(self, pieces: list[str]) -> None:
        """Ids of matches not met before, in batches of the library, whose results are large."""
        unsure = len(self.overlaps) > 0
        for at in range(0, len(pieces), TOGETHER):
            some = pieces[at : at + TOGETHER]
            mapped = [p.encode("utf-8").decode("latin-1").translate(self.chars) for p in some]
            for p, m, e in zip(some, mapped, self.model.encode_batch_fast(mapped, add_special_tokens=False), strict=True):
                ids = e.ids
                if unsure and len(ids) > 1 and next(self.overlaps.iter(m), None):
                    ids = self.by_rule(p.encode("utf-8"))
                self.known[p] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit."""
        split = [self.split(t) for t in texts]
        if new := {p for s in split for p in s if p not in self.known}:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = {p for s in split for p in s}
            self.learn(list(new))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), "<u4") for s in split]

    def offsets(self, text: str, ids: np.ndarray) -> list[tuple[int, int]]:
        """Character span of each token; a character whose bytes are split belongs to every token with one of them."""
        char_of = np.repeat(np.arange(len(text)), [len(x.encode("utf-8")) for x in text])
        out, at = [], 0
        for i in ids.tolist():
            n = len(self.token[i])
            out.append((int(char_of[at]), int(char_of[at + n - 1]) + 1))
            at += n
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def decode(self, ids) -> str:
        """Text of ids; bytes that make no whole character, as at a cut, become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[list[str]]:
    """The texts of a batch, some at a time."""
    block, n = [], 0
    for t in texts:
        block.append(t.as_py() or "")
        n += len(block[-1])
        if n > size:
            yield block
            block, n = [], 0
    if block:
        yield block


def encode(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """A column of token ids (array<int>) for a text column."""
    path, pattern = path or default_path(), pattern or default_pattern()

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for texts in batches:
            rows = [v for b in _blocks(texts) for v in c.encode(b)]
            at = np.concatenate([[0], np.cumsum([len(v) for v in rows])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows or [np.zeros(0)]).astype(np.int32)))

    return ids(text)


def decode(ids: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """A column of decoded bytes (binary) for a column of token ids."""
    path, pattern = path or default_path(), pattern or default_pattern()

    @F.arrow_udf("binary")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for rows in batches:
            yield pa.array([c.decode_bytes(r.as_py() or ()) for r in rows], pa.binary())

    return raw(ids)


def digests(text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """A struct column (n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again."""
    path, pattern = path or default_path(), pattern or default_pattern()

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(path, pattern)
        for texts in batches:
            n, a, b = [], [], []
            for block in _blocks(texts):
                for ids in c.encode(block):
                    n.append(len(ids))
                    a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(c.decode_bytes(ids.tolist())).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def op8(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", digests(F.col("text"), path).alias("d")).select("doc_id", "d.*")
