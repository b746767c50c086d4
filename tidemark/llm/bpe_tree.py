"""Byte-level BPE by a monoid tree reduction.

A span is encoded by encoding its halves and joining them. The join re-encodes a window around the seam and widens it until
both seams of the window are stable: a sequence of tokens is the encoding of its bytes exactly when each two neighbours, alone,
encode to themselves, so then nothing outside the window can change. Leaves are spans of a few bytes, merged by the ranks; a
match that is itself a token needs no tree. Decoding concatenates up the same tree.

Texts are cut where no match of the pattern crosses: before a single space between two other characters. The runs between
recur, so each worker keeps a bounded table of the runs it has met."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from .common import table

#: Unicode White_Space, spelt out because Python's \s has four control characters more.
SPACES = "\t-\r \x85\xa0  -     　"
PIECES = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", f"[^{SPACES}").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]"))
SPACE_LETTERS = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACES}]", c))
LEAF, KNOWN, NONE = 4, 300_000, 1 << 32
STABLE: list[int] = []


class TreeEncoder:
    """Encoder of one rank file. Leaves, pairs and matches met lately stay in bounded tables; the lists in them are never changed."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (1 + max(self.ranks.values()))
        for b, i in self.ranks.items():
            self.bytes_of[i] = b
        self.pairs: dict[tuple[int, int], list[int]] = {}
        self.leaves: dict[bytes, list[int]] = {}
        self.pieces: dict[bytes, list[int]] = {}
        self.joins = 0

    def merged(self, b: bytes) -> list[int]:
        """Ids of a span by its definition: again and again, of all neighbours the pair of the lowest rank (the first of these) is merged."""
        rank, n = self.ranks.get, len(b)
        if n <= 16:
            parts = [b[i : i + 1] for i in range(n)]
            open_ = [rank(x + y, NONE) for x, y in pairwise(parts)]
            while open_ and (low := min(open_)) < NONE:
                i = open_.index(low)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del open_[i]
                if i:
                    open_[i - 1] = rank(parts[i - 1] + parts[i], NONE)
                if i < len(open_):
                    open_[i] = rank(parts[i] + parts[i + 1], NONE)
            return [self.ranks[p] for p in parts]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        part: list[bytes | None] = [b[i : i + 1] for i in range(n)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if part[i] is None or (j := right[i]) >= n or len(part[i]) + len(part[j]) != size:
                continue  # of neighbours that are no more
            part[i], part[j], right[i] = part[i] + part[j], None, right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := rank(part[i] + part[right[i]])) is not None:
                    heapq.heappush(heap, (r, i, len(part[i]) + len(part[right[i]])))
            if left[i] >= 0 and (r := rank(part[left[i]] + part[i])) is not None:
                heapq.heappush(heap, (r, left[i], len(part[left[i]]) + len(part[i])))
        return [self.ranks[p] for p in part if p is not None]

    def pair(self, a: int, b: int) -> list[int]:
        """Ids of the bytes of two neighbours; STABLE if they stay as they are."""
        if (found := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= KNOWN:
                self.pairs.clear()
            found = self.merged(self.bytes_of[a] + self.bytes_of[b])
            found = self.pairs[a, b] = STABLE if found == [a, b] else found
        return found

    def join(self, x: list[int], y: list[int]) -> list[int]:
        """Ids of the bytes of x and y, each the ids of its own: a window around the seam, first one token to each side, is encoded
        anew and its side doubled until the window's outer neighbours are stable, or there are none."""
        self.joins += 1
        i, j, window = 1, 1, self.pair(x[-1], y[0])
        if window is STABLE:
            return x + y
        while True:
            left = i >= len(x) or self.pair(x[-i - 1], window[0]) is STABLE
            right = j >= len(y) or self.pair(window[-1], y[j]) is STABLE
            if left and right:
                return x[: max(0, len(x) - i)] + window + y[j:]
            i, j = i * (1 if left else 2), j * (1 if right else 2)
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, x[-i:] + y[:j])))

    def tree(self, b: bytes) -> list[int]:
        """Ids of some bytes: halves of halves down to leaves of LEAF bytes, which are merged by the ranks, joined two by two."""
        if (n := len(b)) <= LEAF:
            if (found := self.leaves.get(b)) is None:
                if len(self.leaves) >= KNOWN:
                    self.leaves.clear()
                found = self.leaves[b] = self.merged(b)
            return found
        return self.join(self.tree(b[: n // 2]), self.tree(b[n // 2 :]))

    def piece(self, b: bytes) -> list[int]:
        """Ids of a match of the pattern: its own id if it is a token, as the format has it, else by the tree."""
        if (own := self.ranks.get(b)) is not None:
            return [own]
        if (found := self.pieces.get(b)) is None:
            found = self.tree(b)
            if len(b) <= 32:
                if len(self.pieces) >= KNOWN:
                    self.pieces.clear()
                self.pieces[b] = found
        return found

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def packed(self, span: str) -> bytes:
        """Ids of a span of whole matches, as little-endian unsigned 32-bit integers."""
        return b"".join(i.to_bytes(4, "little") for p in PIECES.findall(span) for i in self.piece(p.encode()))


class Runs(dict):
    """Packed ids of the runs met lately. When full it forgets those that were not met since it was last full."""

    def __init__(self):
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes | None:
        if (found := self.old.get(key)) is not None:
            self.learn(key, found)
        return found

    def learn(self, key: str, ids: bytes) -> None:
        if len(self) >= KNOWN:
            self.old = dict(self)
            self.clear()
        if len(key) < 64:
            self[key] = ids


def whole(key: str) -> bool:
    """Whether a run between two single spaces holds no white space at its ends, which might swallow one of them. A text's first
    run, behind a space in its key, may be empty or start with some."""
    if key[:1] == " ":
        return key[-1] not in SPACE_LETTERS or len(key) == 1
    return bool(key) and key[0] not in SPACE_LETTERS and key[-1] not in SPACE_LETTERS


def encode_runs(text: str, known: Runs, missed: Callable[[list[str]], list[bytes]]) -> bytes:
    """Encodes a text run by run; known maps a run (which holds no space) to its packed ids, with the space before it; a text's first
    run, which has none, stands in it behind a space. missed encodes others; a text with white space around a space goes there whole."""
    keys = text.split(" ")
    keys[0] = " " + keys[0]
    found = list(map(known.__getitem__, keys))
    if None in found:
        lost = list(dict.fromkeys(k for k, v in zip(keys, found) if v is None))
        if not all(map(whole, lost)):
            return missed([text])[0]
        fresh = dict(zip(lost, missed([k[1:] if k[:1] == " " else " " + k for k in lost])))
        found = [v if v is not None else fresh[k] for k, v in zip(keys, found)]
        for k, v in fresh.items():
            known.learn(k, v)
    return b"".join(found)


_ENCODERS: dict[str, tuple[TreeEncoder, Runs]] = {}


def bpe(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids (packed unsigned 32-bit), decoded (bytes). Null and empty texts have no ids.

    Each document is encoded whole, whatever its length; repeated rows give repeated rows; other columns are not read."""
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = TreeEncoder(path), Runs()
        encoder, known = _ENCODERS[path]
        missed = lambda spans: [encoder.packed(s) for s in spans]
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = [encode_runs(t.as_py() or "", known, missed) for t in part["text"]]
                back = [encoder.decode(memoryview(b).cast("I").tolist()) for b in ids]
                yield pa.record_batch([part["doc_id"], pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(encode, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
