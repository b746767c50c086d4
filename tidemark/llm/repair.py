"""Token ids in a compressed binary format: Re-Pair grammars, one for each block of documents.

A block's ids are rewritten in rounds: the most frequent pairs of neighbours become nonterminals, each occurrence replaced from
the left, until no pair recurs often enough or the symbols of the width are used up. Rules never cross the end of a document, so
a document is decoded on its own from its place in the rewritten sequence; each symbol's expansion length is stored.

File format: Parquet in ascending doc_id order, one row for each block with the first and last doc_id that is not null, and little-endian arrays: doc_ids (int64), n_tokens
(int64, end id included), places (int64, where each document starts in seq), rules (uint32 pairs), lengths (uint32, of each
rule's expansion), seq (uint16 or uint32 by `width`)."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

import public_tokenizers

from .bpe_tree import PIECES, SPACES, whole
from .common import new_path, partitions, table

SCHEMA = "part int, block int, total bigint, first_id bigint, last_id bigint, doc_ids binary, n_tokens binary, places binary, rules binary, lengths binary, width int, seq binary"
SLOT_BITS = 19
SLOTS = 1 << SLOT_BITS


def frequent_pairs(seq: np.ndarray, ends: np.ndarray, turn: int, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to `most` pairs of neighbours that recur at least `least` times, by counts under a hash, another one each turn: the pairs,
    their places in seq, and the pair at each place. Of pairs that share a hash one is found, most likely the frequent one."""
    slot = seq[:-1] * np.uint32(0x9E3779B1 + 2 * turn)
    slot ^= slot >> np.uint32(15)
    slot += seq[1:]
    slot *= np.uint32(0x85EBCA77)
    slot = (slot >> np.uint32(32 - SLOT_BITS)).view(np.int32)
    slot[ends[:-1] - 1] = SLOTS  # pairs across two documents
    counts = np.bincount(slot, minlength=SLOTS + 1)[:SLOTS]
    top = np.flatnonzero(counts >= least)
    if len(top) > most:
        top = top[np.argpartition(counts[top], -most)[-most:]]
    hot = np.zeros(SLOTS + 1, bool)
    hot[top] = True
    at = np.flatnonzero(hot[slot])
    own, mine = (seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1], slot[at]
    shown = np.zeros(SLOTS, np.uint64)
    shown[mine] = own
    fits = shown[mine] == own
    at, mine = at[fits], mine[fits]
    counts = np.bincount(mine, minlength=SLOTS)
    top = top[counts[top] >= least]
    number = np.full(SLOTS, -1, np.int32)
    number[top] = np.arange(len(top))
    where = number[mine]
    return shown[top], at[where >= 0], where[where >= 0]


def exact_pairs(seq: np.ndarray, ends: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with every pair counted by itself."""
    at = np.ones(len(seq) - 1, bool)
    at[ends[:-1] - 1] = False
    at = np.flatnonzero(at)
    pairs, which, n = np.unique((seq[at].astype(np.uint64) << np.uint64(32)) | seq[at + 1], return_inverse=True, return_counts=True)
    top = np.flatnonzero(n >= least)
    if len(top) > most:
        top = top[np.argpartition(n[top], -most)[-most:]]
    number = np.full(len(pairs), -1, np.int32)
    number[top] = np.arange(len(top))
    where = number[which]
    return pairs[top], at[where >= 0], where[where >= 0]


def compress(seq: np.ndarray, ends: np.ndarray, first: int, per_round: int, least: int, symbols: int = 1 << 16):
    """seq: ids; ends: index after each document's last id. Gives rules (n x 2), lengths, the rewritten seq and its ends.

    Pairs are counted by a hash, as long as that finds many, then exactly. It ends when no pair recurs `least` times, or at `symbols` symbols."""
    rules, lengths = np.empty((0, 2), np.uint32), np.empty(0, np.uint32)
    seq, turn, exact = seq.astype(np.uint32), 0, False
    while len(seq) > 1 and first + len(rules) < symbols:
        most = min(per_round, symbols - first - len(rules))
        pairs, at, where = exact_pairs(seq, ends, most, least) if exact else frequent_pairs(seq, ends, turn, most, least)
        turn += 1
        if not exact and 4 * len(pairs) < most:
            exact = True
            continue
        if not len(pairs):
            break
        begin = np.flatnonzero(np.diff(at, prepend=-2) != 1)  # of runs of overlapping pairs; every second of a run is replaced
        odd = (np.arange(len(at)) - np.repeat(begin, np.diff(begin, append=len(at)))) & 1
        at, where = at[odd == 0], where[odd == 0]
        new = first + len(rules)
        pair = np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        known = lambda s: np.where(s < first, 1, lengths[np.maximum(s, first).astype(np.int64) - first] if len(lengths) else 1)
        longer = (known(pair[:, 0]) + known(pair[:, 1])).astype(np.uint32)
        seq[at] = (new + where).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False  # the second of each pair goes
        ends = ends - np.searchsorted(at + 1, ends)
        seq = seq[keep]
        rules, lengths = np.concatenate([rules, pair]), np.concatenate([lengths, longer])
    return rules, lengths, seq, ends


def symbol_width(symbols: int) -> int:
    """Bytes for each of so many symbols, which count from 0."""
    return 2 if symbols <= 1 << 16 else 4


def expansions(rules: np.ndarray, lengths: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols' expansions end to end, with the place and the length of each: the ids themselves, then the rules in order."""
    size = np.concatenate([np.ones(first, np.int64), lengths.astype(np.int64)])
    place = np.cumsum(size) - size
    flat = np.empty(int(size.sum()), np.uint32)
    flat[:first] = np.arange(first)
    newest, at = rules.max(1, initial=0).astype(np.int64), 0
    while at < len(rules):  # as many rules at once as are made of known symbols
        later = np.flatnonzero(newest[at:] >= first + at)
        to = at + int(later[0]) if len(later) else len(rules)
        begin = place[first + at]
        part = expand(rules[at:to].reshape(-1), (flat, place, size))
        flat[begin : begin + len(part)] = part
        at = to
    return flat, place, size


def expand_few(seq: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids of a part of a rewritten sequence by its own rules alone."""
    while (seq >= first).any():
        deep = seq >= first
        n = 1 + deep
        out = np.repeat(seq, n)
        begin = (np.cumsum(n) - n)[deep]
        out[begin], out[begin + 1] = rules[seq[deep] - first, 0], rules[seq[deep] - first, 1]
        seq = out
    return seq


def expand(seq: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a rewritten sequence, or of any part of one."""
    flat, place, size = table
    n = size[seq]
    end = np.cumsum(n)
    return flat[np.repeat(place[seq] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]


#: New matches in one text for the library, whose work for a text is more than that for a match.
JOINED = 256

_ENCODERS: dict[str, PieceTable] = {}

#: A space between two other characters, or at a text's start, behind which no match of the pattern crosses.
CUT = re.compile(f"(?<![{SPACES}]) (?![{SPACES}]|\\Z)")


class PieceTable:
    """Ids of the matches of the pattern met lately, each encoded once by the tokenizers library. When full it forgets the rarest half."""

    def __init__(self, path: str, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.encode_special_tokens = True  # in a match they are ordinary text; `whole_texts` looks for them
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ids = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(ids.values()) + 1, bool)  # ids whose bytes begin with a space, which the vocabulary writes as Ġ
        self.spaced[[i for t, i in ids.items() if t[0] == "Ġ"]] = True
        self.code: dict[str, int] = {}
        self.flat, self.size, self.used = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.head = np.empty(0, bool)  # whether a match begins with a space

    def forget(self) -> None:
        """Keeps the matches met most often, at most half of the table, whose counts are halved."""
        keep = np.sort(np.argpartition(-self.used, self.most // 2)[: self.most // 2])
        kept = np.zeros(len(self.used), bool)
        kept[keep] = True
        self.flat = self.flat[np.repeat(kept, self.size)]
        self.size, self.used, self.head = self.size[kept], self.used[kept] // 2, self.head[kept]
        self.code = dict(zip((p for p, k in zip(self.code, kept.tolist()) if k), range(len(keep))))

    def encoded(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and each string's number of ids."""
        flat, size = array("I"), []
        for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False):
            ids = e.ids
            flat.fromlist(ids)
            size.append(len(ids))
        return np.array(flat, np.uint32), np.array(size, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Takes new matches into the table. Those with one space, before other characters, go to the library many at once, as each is a match
        again in a text made of them, and only its first id's bytes begin with a space."""
        joined, rest = [], []
        for p in pieces:
            (joined if p[0] == " " and len(p) > 1 and not p[1].isspace() else rest).append(p)
        flat, _ = self.encoded(["".join(joined[i : i + JOINED]) for i in range(0, len(joined), JOINED)])
        size = np.diff(np.flatnonzero(self.spaced[flat]), append=len(flat))
        more, n = self.encoded(rest)
        self.code.update(zip(joined + rest, range(len(self.code), len(self.code) + len(pieces))))
        self.flat, self.size = np.concatenate([self.flat, flat, more]), np.concatenate([self.size, size, n])
        self.used = np.concatenate([self.used, np.zeros(len(pieces), np.int64)])
        self.head = np.concatenate([self.head, np.ones(len(joined), bool), np.array([p[0] == " " for p in rest], bool)])

    def runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs without spaces, each with the space before it."""
        if not runs:
            return self.encoded([])
        if len(self.code) > self.most:
            self.forget()
        pieces = PIECES.findall(" " + " ".join(runs))
        if fresh := list(dict.fromkeys(filterfalse(self.code.__contains__, pieces))):
            self.learn(fresh)
        codes = np.fromiter(map(self.code.__getitem__, pieces), np.int64, len(pieces))
        self.used += np.bincount(codes, minlength=len(self.used))
        begin = np.flatnonzero(self.head[codes])  # only a run's first match has one
        return expand(codes, (self.flat, np.cumsum(self.size) - self.size, self.size)), np.add.reduceat(self.size[codes], begin)

    def pack(self, texts: list[str]) -> list[np.ndarray]:
        """Each whole text's ids: texts are cut where no match crosses, each distinct run is encoded once, and the ids gathered."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words, first = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()[:-1]
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        plain = np.fromiter(map(whole, known), bool, len(known))
        # white space at a run's ends could swallow the space beside it; a text's first run may start with some
        loose = ~plain[words.indices.to_numpy()]
        loose[first] = [not whole(" " + r) for r in lists.flatten().take(pa.array(first)).to_pylist()]
        rough = np.add.reduceat(loose, first, dtype=np.int64) > 0
        order = np.argsort(rough, kind="stable")
        if rough.any():
            lists = pa.concat_arrays([lists.filter(pa.array(~rough)), pa.array([CUT.split(texts[i]) for i in np.flatnonzero(rough)], lists.type)])
            words, first = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()[:-1]
            known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
            plain = np.array([whole(r) and " " not in r for r in known], bool)
        heads = lists.flatten().take(pa.array(first)).to_pylist()
        one, n_one = self.runs([r for r, p in zip(known, plain) if p])
        two, n_two = self.encoded([" " + r for r, p in zip(known, plain) if not p] + heads)
        code = np.where(plain, np.cumsum(plain) - 1, plain.sum() + np.cumsum(~plain) - 1)[words.indices.to_numpy()]
        code[first] = len(known) + np.arange(len(first))
        size = np.concatenate([n_one, n_two])
        flat = expand(code, (np.concatenate([one, two]), np.cumsum(size) - size, size))
        parts = np.split(flat, np.cumsum(np.add.reduceat(size[code], first))[:-1])
        return [parts[i] for i in np.argsort(order)]

    def whole_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Each whole text's ids as the library gives them: texts that hold an added token of the model go to it whole."""
        special = [any(a in t for a in self.added) for t in texts]
        rest = iter(self.pack([t for t, s in zip(texts, special) if not s]))
        if not any(special):
            return list(rest)
        self.tokenizer.encode_special_tokens = False
        try:
            flat, size = self.encoded([t for t, s in zip(texts, special) if s])
        finally:
            self.tokenizer.encode_special_tokens = True
        own = iter(np.split(flat, np.cumsum(size)[:-1]))
        return [next(own if s else rest) for s in special]


def id_encoder(path: str) -> PieceTable:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceTable(path)
    return _ENCODERS[path]


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, block_tokens: int = 1_000_000, per_round: int = 4000, least: int = 4, vocabulary: int = 50257, group_chars: int = 12_000_000) -> None:
    """Encodes whole texts (null: empty), ends each with end_id and writes them below path in the file format, by doc_id.

    Null doc_ids come first, repeated ones stand side by side; a block holds whole documents, so a long one may be a large
    block. Other columns are not read."""
    model = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode_texts, part, block = id_encoder(model).whole_texts, TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        sizes: list[int] = []
        names: list[int | None] = []
        waiting: list[tuple[int | None, str]] = []
        end, held, size = np.array([end_id], np.uint32), 0, 0

        def row() -> pa.RecordBatch:
            n = np.array(sizes, np.int64)
            rules, lengths, seq, ends = compress(np.concatenate(ids), np.cumsum(n), vocabulary, per_round, least)
            width = symbol_width(vocabulary + len(rules))
            places = np.concatenate([[0], ends[:-1]]).astype("<i8")
            named = np.array([-(1 << 63) if x is None else x for x in names], "<i8")
            known = [x for x in names if x is not None]
            values = [part, block, int(n.sum()), min(known, default=None), max(known, default=None), named.tobytes(), n.astype("<i8").tobytes(), places.tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), width, seq.astype(f"<u{width}").tobytes()]
            types = [pa.int32(), pa.int32(), *[pa.int64()] * 3, *[pa.binary()] * 5, pa.int32(), pa.binary()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        def blocks() -> Iterator[pa.RecordBatch]:
            """Encodes the waiting texts as one group and cuts full blocks from what is held."""
            nonlocal block, held
            for (name, _), x in zip(waiting, encode_texts([t for _, t in waiting])):
                names.append(name)
                ids.extend((x, end))
                sizes.append(len(x) + 1)
                held += len(x) + 1
                if held >= block_tokens:
                    yield row()
                    block, held = block + 1, 0
                    for full in (ids, names, sizes):
                        full.clear()
            waiting.clear()

        for batch in batches:
            for name, text in zip(batch["doc_id"], batch["text"]):
                waiting.append((name.as_py(), text.as_py() or ""))
                size += len(waiting[-1][1])
                if size >= group_chars:
                    yield from blocks()
                    size = 0
        yield from blocks()
        if names:
            yield row()

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, SCHEMA).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str, vocabulary: int = 50257) -> DataFrame:
    """Every document of the files: doc_id (null where it was), start (ids of all documents before it), n_tokens, ids (packed unsigned 32-bit).
    Files without a document give no rows."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    parts = blocks.groupBy("part").agg(F.sum("total").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("parts_before"))
    inside = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("part", "block", F.coalesce(F.sum("total").over(inside), F.lit(0)).alias("blocks_before")).join(before, "part")
    starts = starts.select("part", "block", (F.col("parts_before") + F.col("blocks_before")).alias("base"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                n = np.frombuffer(r["n_tokens"], "<i8")
                rules, lengths = np.frombuffer(r["rules"], "<u4").reshape(-1, 2), np.frombuffer(r["lengths"], "<u4")
                seq = np.frombuffer(r["seq"], f"<u{r['width']}").astype(np.uint32)
                flat = expand(seq, expansions(rules, lengths, vocabulary))
                ids = [x.tobytes() for x in np.split(flat, np.cumsum(n)[:-1])]
                names = [None if x == -(1 << 63) else int(x) for x in np.frombuffer(r["doc_ids"], "<i8")]
                start = r["base"] + np.concatenate([[0], np.cumsum(n)[:-1]])
                for at in range(0, len(names), 500):
                    to = at + 500
                    yield pa.record_batch([pa.array(names[at:to], pa.int64()), pa.array(start[at:to], pa.int64()), pa.array(n[at:to], pa.int64()), pa.array(ids[at:to], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    # the places serve read_documents; here each block is read whole
    slim = blocks.join(starts, ["part", "block"]).select("base", "doc_ids", "n_tokens", "rules", "lengths", "width", "seq")
    return slim.mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def read_documents(spark: SparkSession, path: str, ids: Sequence[int], vocabulary: int = 50257) -> DataFrame:
    """Some documents of the files: doc_id, n_tokens, ids. Only blocks that may hold them are read, and of these only the documents' own
    places are expanded. ids, numbers, are sent to all tasks; blocks are picked by at most 64 ranges of them, however many they are. Ids that no
    document has, empty files and no ids give no rows; documents without an id can't be asked for."""
    wanted = np.unique(np.array(list(ids), np.int64))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                names, places = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["places"], "<i8")
                rules, seq = np.frombuffer(r["rules"], "<u4").reshape(-1, 2), np.frombuffer(r["seq"], f"<u{r['width']}")
                at = np.flatnonzero(np.isin(names, wanted) & (names != -(1 << 63)))
                stop = np.append(places, len(seq))[at + 1]
                found = [expand_few(seq[places[i] : j].astype(np.uint32), rules, vocabulary) for i, j in zip(at, stop)]
                yield pa.record_batch([pa.array(names[at]), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    blocks = spark.read.schema(SCHEMA).parquet(path)
    near = F.lit(False)
    for some in np.array_split(wanted, min(64, max(1, len(wanted)))):
        if len(some):
            near = near | ((F.col("first_id") <= int(some[-1])) & (F.col("last_id") >= int(some[0])))
    return blocks.filter(near).select("doc_ids", "places", "rules", "width", "seq").mapInArrow(decode, "doc_id bigint, n_tokens bigint, ids binary")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
