"""Conversation repair, sharding and the manifest by brute force, with nulls, ties, repeated rows, long texts, empty tables and clashing names."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.test_queries import rows as in_order
from tidemark.llm import common, conversation_repair, manifest, mixing, repair, sharding
from tidemark.llm.registry import ORACLES, QUERIES

ROWS = "conv_id long, turn long, role string, text string, g string, rank string, kind string"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, g string, h string, rank string, shard string, slot string, doc string, place string"
SMALL = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# conversations


def cheapest(rows):
    """rows: role, text. (cost, audit, repaired lines) by trying every edit, the least by cost, then audit."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names, seen, best = {"u": "user", "a": "assistant"}, set(), {"": (0, "", ())}

    def spread(best):
        for _ in range(3):
            for s, (c, audit, lines) in list(best.items()):
                for r, t in after[s].items():
                    if r != "s":
                        new = (c + 5, audit + "I", (*lines, names[r] + ":"))
                        if t not in best or new[:2] < best[t][:2]:
                            best[t] = new
        return best

    for role, text in rows:
        end = re.search(r"[^\x20\x09-\x0D][\x20\x09-\x0D]*\Z", text)
        gone, late = not end or (role, text) in seen, 5 * (not end or end[0][0] not in ".!?")
        seen.add((role, text))
        new = {}
        for s, (c, audit, lines) in spread(best).items():
            found = [(s, c + 2, audit + "D", lines)]
            if not gone:
                found += [(t, c + late, audit + "K", (*lines, f"{role}:{text}")) for r, t in after[s].items() if role[:1] == r]
                found += [(t, c + late + 1, audit + "R", (*lines, f"{names[r]}:{text}")) for r, t in after[s].items() if r != "s"]
            for t, *x in found:
                if t not in new or tuple(x[:2]) < new[t][:2]:
                    new[t] = tuple(x)
        best = new
    best = spread(best)
    return min(best[s] for s in ("", "a") if s in best)


def repaired_by_force(rows):
    groups, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        groups[conv].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    for conv, found in groups.items():
        found.sort()
        own, seen, faults = [x[3:] for x in found], set(), Counter()
        for role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults["blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""] += 1
            seen.add((role, text))
        turns = [x[1] for x in found if x[0]]
        cost, audit, lines = cheapest(own)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(lines)))
    return out


def conversations():
    rng = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]
    texts = ["Yes.", "No!", "Why?", "cut", "cut", "", None, " \t", "End. \n", "x" * 100_000 + ".", "été.", "."]
    rows = []
    for conv in [*range(40), None]:
        n = rng.choice([0, 1, 2, 3, 5, 8, 13, 40])
        for k in range(n):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[k % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"Words {k} {rng.randrange(9)}."
            rows += [(conv, rng.choice([k, k, k, k // 2, None]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("block_rows", [1 << 16, 3])
def test_repair_by_brute_force(spark, block_rows):
    """With blocks of three rows most conversations are put together from the cost tables of blocks."""
    rows = conversations()
    df = spark.createDataFrame([(*r, "g", "r", "k") for r in rows], ROWS).select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "g", "rank", "kind")
    got = {None if r.g == "0" else int(r.g[1:]): tuple(r[c] for c in COLUMNS) for r in conversation_repair.repair(df, block_rows).collect()}
    assert got == repaired_by_force(rows)


def test_a_long_conversation_in_blocks(spark):
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{k}.", f"{k}", ""])) for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversation_repair.repair(df, 100).first()
    assert tuple(got[c] for c in COLUMNS) == repaired_by_force(rows)[1]


def test_the_conversation_query_damages_and_keeps_every_id(spark, tmp_path):
    rows = [*conversations(), *[(c, 0, "user", "Hi.") for c in range(1000, 1060)]]
    spark.createDataFrame([(*r, "g", "r", "k") for r in rows], ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text or " ") if k == 2 else text
        damaged += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    want = repaired_by_force(damaged)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_conversations"](spark, str(tmp_path)).collect()}
    assert got == {c: want.get(c, (0, 0, 0, 0, 0, 0, "", sha(""))) for c in {r[0] for r in rows}}
    assert sum(c not in want for c in got) > 0


def test_repair_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op11_conversations"](spark, str(tmp_path)).collect() == []


# shards


def documents():
    rng = random.Random(3)
    rows = [(k, f"s{k % 3}", rng.choice(["en", "de", None]), k, f"Text {k} " * rng.randrange(1, 30)) for k in range(300)]
    rows += [(7, "s0", "en", 1, "same"), (7, "s0", "en", 1, "same"), (7, "s0", "en", 1, "other"), (None, None, None, None, None), (None, None, None, None, None), (None, "s", "fr", 2, ""), (900, "s", "", 3, "word " * 50_000), (901, "s", "zé", 3, "ABC É")]
    rows += [(None, "hot", "en", 5, "hot text")] * 150
    return rows


@pytest.fixture(scope="module")
def docs_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("structure"))
    spark.createDataFrame([(*r, *"ghrsldp") for r in documents()], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_shards_are_equal_gapless_and_whole(spark, docs_dir):
    got = QUERIES["op12_sharding"](spark, docs_dir).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d[0], size(d[4]), zlib.crc32((d[4] or "").encode())) for d in documents())
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(8)) and all(sorted(x) == list(range(len(x))) for x in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def spark_hash(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p[1].to_bytes(p[0], "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("bucket_rows", [20, 1024])
def test_shards_by_brute_force(spark, docs_dir, bucket_rows):
    """Scattered by the hash of file and row, each bucket shuffled by Fisher and Yates, one bucket after the other."""
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    places = [(r[0], r[1], r.doc_id, r.text) for r in docs.select("_metadata.file_name", "_metadata.row_index", "doc_id", "text").collect()]
    n, buckets, order = len(places), -(-len(places) // bucket_rows), []
    held = defaultdict(list)
    for p in places:
        held[spark_hash((4, 7), p[0], (8, p[1])) % buckets].append(p)
    for b in sorted(held):
        rows = sorted(held[b], key=lambda p: p[:2])
        for i in range(len(rows) - 1, -1, -1):
            j = spark_hash((4, 7), (8, b), (4, i)) % (i + 1)
            rows[i], rows[j] = rows[j], rows[i]
        order += rows
    want = [(k * 5 // n, k - -(-(k * 5 // n) * n // 5), p[2], p[3]) for k, p in enumerate(order)]
    got = sharding.shuffled(docs, 5, bucket_rows=bucket_rows, in_files=True).select("shard", "slot", "doc.doc_id", "doc.text").collect()
    assert sorted(map(tuple, got), key=lambda x: x[:2]) == want


def test_shards_of_a_frame_and_of_equal_rows_agree_on_reruns(spark):
    df = spark.createDataFrame([(1, "same", {"k": 1})] * 400, "slot int, text string, shard map<string, int>").repartition(4)
    runs = [sorted((r.shard, r.slot, r.doc.slot) for r in sharding.shuffled(df, 8, bucket_rows=10).collect()) for _ in range(2)]
    assert runs[0] == runs[1] == [(s, k, 1) for s in range(8) for k in range(50)]


def test_a_bucket_is_bounded_by_its_bytes(spark):
    df = spark.createDataFrame([(k, "x" * 1000) for k in range(200)], "doc_id int, text string")
    got = sharding.shuffled(df, 2, bucket_bytes=5000).collect()
    assert sorted(r.doc.doc_id for r in got) == list(range(200)) and [r.doc.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))] != list(range(200))


def test_every_place_of_a_shuffle_is_as_likely(spark):
    """Over 4000 shuffles of five numbers, each number stands in each place about 800 times (five deviations are 127)."""
    perms = spark.range(4000).select(sharding.fisher_yates(F.sequence(F.lit(0), F.lit(4)), lambda i: F.pmod(F.xxhash64("id", i), (i + 1).cast("long")).cast("int")).alias("p")).collect()
    assert all(sorted(r.p) == list(range(5)) for r in perms)
    counts = Counter((k, x) for r in perms for k, x in enumerate(r.p))
    assert len(counts) == 25 and all(abs(c - 800) < 127 for c in counts.values())
    assert len({tuple(r.p) for r in perms}) == 120


# manifest


def by_force(docs, fan, tampered):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, text: sha("".join(map(field, (*d[:4], text))))
    langs = defaultdict(list)
    for d in docs:
        own = leaf(d, d[4])
        langs[d[2]].append((d[0] is not None, d[0] or 0, own, leaf(d, tampered(d)) if tampered(d) is not None else own))

    def tree(hashes):
        paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
        while len(level) > 1:
            for k, i in enumerate(at):
                run = i - i % fan
                paths[k].append(("".join(level[run:i]), "".join(level[i + 1 : run + fan])))
            level, at = [sha("".join(level[i : i + fan])) for i in range(0, len(level), fan)], [i // fan for i in at]
        return level[0], paths

    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: (sorted(langs[g]), tree([x[2] for x in sorted(langs[g])])) for g in order}
    root, above = tree([trees[g][1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        leaves, (subroot, paths) = trees[g]
        for (known, doc_id, own, other), path in zip(leaves, paths):
            path, folded = path + above[k], other
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((doc_id if known else None, own, subroot, root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return Counter(out)


def as_query(df):
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""), 256)
    folded = manifest.fold(F.coalesce("tampered_leaf", "leaf"), F.col("path"))
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", proof, folded, folded == F.col("root")).collect())


@pytest.mark.parametrize(("fan", "levels"), [(8, 4), (2, 2), (3, 1)])
def test_manifest_by_brute_force(spark, docs_dir, fan, levels):
    """Small blocks need several tables of blocks, one above the other."""
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    got = manifest.manifest(docs, fan, levels, F.when(F.col("doc_id") % 5 == 0, F.upper("text")))
    assert as_query(got) == by_force(documents(), fan, lambda d: d[4].upper() if d[0] is not None and d[0] % 5 == 0 and d[4] is not None else None)


def test_the_manifest_query_by_brute_force(spark, docs_dir):
    def tampered(d):
        if d[0] is None or d[4] is None or zlib.crc32(str(d[0]).encode()) % 3:
            return None
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d[4])

    got = QUERIES["op13_manifest"](spark, docs_dir).collect()
    assert Counter(map(tuple, got)) == by_force(documents(), 8, tampered)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_manifest_of_few_rows(spark, n):
    rows = [(k, "s", "en", k, f"T{k}") for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert as_query(manifest.manifest(df, levels=1)) == (by_force(rows, 8, lambda d: None) if n else Counter())


# SQL


@pytest.mark.parametrize("name", ["op11_conversations", "op13_manifest"])
def test_structure_oracles(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SMALL}/{f}')")
    df, want = QUERIES[name](spark, SMALL), con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns) and in_order(df.columns, df.collect()) == in_order(columns, want.fetchall())


def test_ranks_of_groups_over_many_tasks(spark):
    rows = common.staged(spark.range(5000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 7).alias("x"), "id").repartition(5), "rank-test")
    got = defaultdict(list)
    for r in common.ranked(rows, "g", ["x", "id"], "rank-test").collect():
        got[r.g].append((r["rank"], r.n, r.x, r.id))
    for found in got.values():
        found.sort()
        assert [x[0] for x in found] == list(range(len(found))) and {x[1] for x in found} == {len(found)} and [x[2:] for x in found] == sorted(x[2:] for x in found)


def test_the_mixture_uses_as_many_tasks_as_there_are_partitions(spark):
    """Half of the rows have no id and are equal; they are spread like the others."""
    docs = spark.createDataFrame([(None if k % 2 else k, f"s{k % 3}", "same words here" if k % 2 else f"words of {k}", 1) for k in range(6000)], "doc_id long, source string, text string, part int").repartition(4)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "400")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = mixing.mixed_rows(docs).withColumn("task", F.spark_partition_id()).groupBy("task", F.col("doc_id").isNull().alias("no_id")).count().collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len({r.task for r in rows}) > 350
    sizes = [r["count"] for r in rows if r.no_id]
    assert len(sizes) > 300 and max(sizes) < 6 * sum(sizes) / 400


def test_a_block_that_uses_up_its_symbols_is_written_with_two_bytes():
    """With all symbols of 16 bits in use the largest is 65535; what is left still recurs, and the round trip is exact."""
    rng = np.random.default_rng(1)
    seq = np.tile(rng.integers(0, 50257, 40_000), 4).astype(np.uint32)
    rules, lengths, short, ends = repair.compress(seq, np.array([70_000, len(seq)]), 50257, 4000, 4)
    assert 50257 + len(rules) == 1 << 16 == int(short.max()) + 1 and repair.symbol_width(50257 + len(rules)) == 2
    assert (repair.symbol_width(1), repair.symbol_width(1 << 16), repair.symbol_width((1 << 16) + 1)) == (2, 2, 4)
    packed = np.frombuffer(short.astype("<u2").tobytes(), "<u2").astype(np.uint32)
    assert np.array_equal(repair.expand(packed, repair.expansions(rules, lengths, 50257)), seq) and len(short) < len(seq)


def test_thousands_of_documents_are_read_by_their_ids(spark, tmp_path):
    docs = spark.createDataFrame([(k * 3, f"text {k}") for k in range(4000)] + [(None, "nobody")], "doc_id long, text string")
    repair.write_ids(docs, f"{tmp_path}/ids")
    every = {r.doc_id: bytes(r.ids) for r in repair.read_ids(spark, f"{tmp_path}/ids").collect()}
    assert len(every) == 4001 and None in every
    got = {r.doc_id: bytes(r.ids) for r in repair.read_documents(spark, f"{tmp_path}/ids", range(0, 9000)).collect()}
    assert got == {k: v for k, v in every.items() if k is not None and k < 9000}
    assert repair.read_documents(spark, f"{tmp_path}/ids", []).collect() == repair.read_documents(spark, f"{tmp_path}/ids", [1, -5, 10**12]).collect() == []
    repair.write_ids(docs.limit(0), f"{tmp_path}/none")
    assert repair.read_ids(spark, f"{tmp_path}/none").collect() == repair.read_documents(spark, f"{tmp_path}/none", [1]).collect() == []
