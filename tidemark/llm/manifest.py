"""Merkle manifest of a dataset: a hash tree a language, a tree over their roots, and a proof for each row.

Leaves are ranked by distributed sorting. The digits of a rank in base `fan` are the path to its leaf; within blocks of
fan**levels leaves the digits are grouped away one after the other, each grouping nesting the structs of the one before, without a
shuffle between them. The roots of blocks are the leaves of the next table, and so on to one root. Proofs come down the same way:
a row of nested structs meets the path above it by grouping both under the block's number, and transform and explode turn it
into rows, level by level. No join makes a proof, and no row holds more than a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, ranked, staged, table

FAN, LEVELS = 8, 4
PATH = "array<struct<l: string, r: string>>"


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Digest of a row: each value as its length in UTF-8 bytes, a colon and itself, or a hyphen if null."""
    parts = [x.cast("string") for x in (doc_id, source, lang, n_chars, text)]
    return sha(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in parts]))


def joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["h"]), "")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path (bottom up: the siblings to its left and right) lead to."""
    return F.aggregate(path, start, lambda a, s: sha(F.concat(s["l"], a, s["r"])))


def nest(nodes: DataFrame, below: int, fan: int, levels: int) -> DataFrame:
    """nodes: g, n (leaves of g's tree), rank, h, item; `below` levels lie beneath them. A row a block: g, n, block, h, kids (nested `levels` deep).

    A level that g's tree does not have has one node for one and leaves it as it is."""
    digits = [F.pmod(F.floor(F.col("rank") / F.lit(fan**k)), F.lit(fan)).cast("int").alias(f"d{k}") for k in range(levels)]
    rows = nodes.select("g", "n", F.floor(F.col("rank") / F.lit(fan**levels)).cast("long").alias("block"), "h", F.col("item").alias("kids"), *digits).repartition("g", "block")
    for k in range(levels):
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "h", "kids")))
        rows = rows.groupBy("g", "n", "block", *[f"d{i}" for i in range(k + 1, levels)]).agg(kids.alias("kids"))
        rows = rows.withColumn("h", F.when(F.col("n") > fan ** (below + k), sha(joined(F.col("kids")))).otherwise(F.col("kids")[0]["h"]))
    return rows


def grow(nodes: DataFrame, fan: int, levels: int, name: str) -> list[DataFrame]:
    """The tables of nested blocks, leaves first; the last has one row for each g, whose h is the root of its tree."""
    tables, most = [], 1
    while True:
        tables.append(staged(nest(nodes, levels * len(tables), fan, levels), f"merkle-{name}-{len(tables)}"))
        most = most if len(tables) > 1 else tables[0].agg(F.max("n")).first()[0] or 1
        if most <= fan ** (levels * len(tables)):
            return tables
        nodes = tables[-1].select("g", "n", F.col("block").alias("rank"), "h", F.lit(0).alias("item"))


def child_of(hashed: Column, fan: int):
    """The function that makes a node's child a row of at, h, kids and path. hashed: whether the level above the child is one of its tree."""

    def child(x: Column, i: Column) -> Column:
        step = F.struct(joined(F.slice("kids", F.lit(1), i)).alias("l"), joined(F.slice("kids", i + 2, F.lit(fan))).alias("r"))
        path = F.when(hashed, F.concat(F.array(step), "path")).otherwise(F.col("path"))
        return F.struct((F.col("at") * fan + x["d"]).alias("at"), x["h"].alias("h"), x["kids"].alias("kids"), path.alias("path"))

    return child


def descend(tables: list[DataFrame], paths: DataFrame, fan: int, levels: int) -> DataFrame:
    """paths: g, path (above g's root), top. One row for each leaf: g, item, h, top, path (from the leaf up)."""
    paths = paths.withColumn("at", F.lit(0).cast("long"))
    for j in reversed(range(len(tables))):
        blocks = tables[j].select("g", F.col("block").alias("at"), "n", "kids")
        both = blocks.unionByName(paths.select("g", "at", "path", "top"), allowMissingColumns=True)
        rows = both.groupBy("g", "at").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "top")])
        for k in reversed(range(levels)):
            rows = rows.select("g", "n", "top", F.inline(F.transform("kids", child_of(F.col("n") > fan ** (levels * j + k), fan))))
        paths = rows
    return paths.select("g", F.col("kids").alias("item"), "h", "top", "path")


def manifest(docs: DataFrame, fan: int = FAN, levels: int = LEVELS, tampered: Column | None = None) -> DataFrame:
    """One row for each document: doc_id, leaf, tampered_leaf, subroot, root, path.

    Leaves of a language ascend by doc_id (null first), of equal ids by their digest; equal rows have equal leaves and are
    interchangeable. A null lang is a language of its own, before all others, which ascend by their UTF-8 bytes. Nulls, empty texts and any
    length of text are hashed as they are; an empty table gives no rows; columns other than doc_id, source, lang, n_chars and text are
    not read. path is the proof: for each level from the leaf up the digests to its left and right. tampered: a text to hash in
    place of the row's, or null; tampered_leaf is null where it is. `fan` nodes share a parent and fan**levels leaves a block.

    The tree of a language that has one row is that row's leaf; a table of one language has its root as the root."""
    c = {x: F.col(x) for x in ("doc_id", "source", "lang", "n_chars", "text")}
    other = F.when(tampered.isNotNull(), leaf(c["doc_id"], c["source"], c["lang"], c["n_chars"], tampered)) if tampered is not None else F.lit(None).cast("string")
    item = F.struct(c["doc_id"].cast("long").alias("doc_id"), other.alias("tampered_leaf"))
    g = F.coalesce(F.concat(F.lit("1"), c["lang"]), F.lit("0"))
    leaves = staged(docs.select(g.alias("g"), leaf(*c.values()).alias("h"), item.alias("item"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    nodes = ranked(leaves.withColumn("doc_id", F.col("item.doc_id")), "g", ["doc_id", "h", "row"], "merkle-ranked").select("g", "n", "rank", "h", "item")
    trees = grow(nodes, fan, levels, "rows")
    discard(leaves)
    subroots = trees[-1].select(F.lit("").alias("all"), F.col("g").alias("lang"), "h")
    tops = ranked(subroots, "all", ["lang"], "merkle-langs").select(F.col("all").alias("g"), "n", "rank", "h", F.struct("lang", F.col("h").alias("subroot")).alias("item"))
    top = grow(tops, fan, levels, "langs")
    start = top[-1].select("g", F.array().cast(PATH).alias("path"), F.col("h").alias("top"))
    above = descend(top, start, fan, levels).select(F.col("item.lang").alias("g"), "path", F.struct("item.subroot", F.col("top").alias("root")).alias("top"))
    return descend(trees, above, fan, levels).select("item.doc_id", F.col("h").alias("leaf"), "item.tampered_leaf", "top.subroot", "top.root", "path")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = manifest(docs, tampered=F.when(third, ascii_lower(F.col("text"))))
    proof = sha(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.coalesce("tampered_leaf", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT *, coalesce('1' || lang, '0') AS g, crc32 % 3 = 0 AS touched FROM (SELECT *, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, _: xor(v >> 1, (v & 1) * 3988292384)))) END AS crc32 FROM documents)),
f AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
 CASE WHEN touched THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM d),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM (
 SELECT g, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS other FROM f)),
tree AS (SELECT g, 0 AS level, rank, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM leaves
 UNION ALL SELECT g, level + 1, rank // 8, sha256(string_agg(h, '' ORDER BY rank)), (any_value(n) + 7) // 8 FROM tree WHERE n > 1 GROUP BY g, level, rank // 8),
subs AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS rank, count(*) OVER () AS m FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, rank, subroot AS h, m AS n FROM subs
 UNION ALL SELECT level + 1, rank // 8, sha256(string_agg(h, '' ORDER BY rank)), (any_value(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY level, rank // 8),
steps AS (SELECT l.g, l.rank, t.level, coalesce(string_agg(t.h, '' ORDER BY t.rank) FILTER (t.rank < l.rank // power(8, t.level)::BIGINT), '') AS l, coalesce(string_agg(t.h, '' ORDER BY t.rank) FILTER (t.rank > l.rank // power(8, t.level)::BIGINT), '') AS r
 FROM leaves l JOIN tree t ON t.g = l.g AND t.n > 1 AND t.rank // 8 = l.rank // power(8, t.level + 1)::BIGINT GROUP BY ALL),
above AS (SELECT s.g, 100 + t.level AS level, coalesce(string_agg(t.h, '' ORDER BY t.rank) FILTER (t.rank < s.rank // power(8, t.level)::BIGINT), '') AS l, coalesce(string_agg(t.h, '' ORDER BY t.rank) FILTER (t.rank > s.rank // power(8, t.level)::BIGINT), '') AS r
 FROM subs s JOIN top t ON t.n > 1 AND t.rank // 8 = s.rank // power(8, t.level + 1)::BIGINT GROUP BY ALL),
path AS (SELECT g, rank, list(l || '|' || r ORDER BY level) AS steps FROM (SELECT * FROM steps UNION ALL SELECT l.g, l.rank, a.level, a.l, a.r FROM leaves l JOIN above a USING (g)) GROUP BY ALL)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(coalesce(steps, []), ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM (
 SELECT *, list_reduce(list_prepend(other, coalesce(steps, [])), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
 FROM leaves LEFT JOIN path USING (g, rank) JOIN subs USING (g), (SELECT h AS root FROM top WHERE n = 1))
"""
