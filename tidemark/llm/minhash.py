"""Near-duplicate documents with fast similarity sketches, banding and exact verification.

Sketch of t coordinates: in each of up to t rounds every shingle is hashed to a bin and a value, and a bin that no earlier round
filled takes the smallest value; t further rounds would fill one bin each with the smallest of all shingles, so every coordinate
is filled for any set. Two sets agree in a coordinate with the probability of their Jaccard similarity, and the
share of equal coordinates concentrates as with independent hash functions, at the cost of little more than one round.

Documents of equal sets form a class and enter once. Classes that share a band are candidates: first each bucket's members against
its head, the member that shares most bands with others, so a group of near copies costs a star; then, where that leaves several
components, the members outside the main one against all that share the head, in blocks that compare sketches and then full sets.
Candidates whose sketches agree in less than half of their coordinates are dropped; all others are verified on the full sets of shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, staged, table
from .graph import components

WIDTH, BANDS, ROWS = 5, 32, 4
COORDINATES = BANDS * ROWS
GROUP = 100
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
NOBODY = (1 << 63) - 1
LEAST = 0.5  # share of equal coordinates below which a candidate is dropped


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of WIDTH words; of fewer words, of the whole sequence."""
    words, n = [], []
    for t in texts:
        own = (t or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space only
        words += own
        n.append(len(own))
    h = pd.util.hash_array(np.array(words, object), categorize=False) if words else np.empty(0, np.uint64)
    total = np.zeros(max(0, len(h) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        total += mixed(h[k : k + len(total)]) * ODD[k]
    total, out, at = mixed(total), [], 0
    for k in n:
        if k >= WIDTH:
            out.append(np.unique(total[at : at + k - WIDTH + 1]))
        else:
            out.append(mixed((mixed(h[at : at + k]) * ODD[:k]).sum(keepdims=True) + np.uint64(k))[: min(k, 1)])
        at += k
    return out


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """One row of t 64-bit coordinates for each set; sets must not be empty."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    sketch = np.full((len(sets), t), full)
    open_, items = np.arange(len(sets)), np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(open_, [len(s) for s in sets])
    for i in range(2 * t):
        if not len(open_):
            break
        value = mixed(items + ODD[:1] * np.uint64(i + 1))
        slot = (value % np.uint64(t)).astype(np.int64) if i < t else np.full(len(items), i - t)
        fresh = np.full((len(sets), t), full)
        np.minimum.at(fresh.reshape(-1), owner * t + slot, value >> np.uint64(1))
        empty = sketch[open_] == full
        sketch[open_] = np.where(empty, fresh[open_], sketch[open_])
        still = (sketch[open_] == full).any(1)
        if not still.all():
            keep = np.zeros(len(sets), bool)
            keep[open_[still]] = True
            open_, mine = open_[still], keep[owner]
            items, owner = items[mine], owner[mine]
    return sketch


def band_keys(sketch: np.ndarray) -> np.ndarray:
    parts = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), parts.shape[:2]) * ODD[1]
    for r in range(ROWS):
        key = mixed(key + mixed(parts[:, :, r]) * ODD[r])
    return key.view(np.int64)


def signatures(docs: DataFrame, key: Column) -> DataFrame:
    """doc_id, key, n (shingles), class (digest of the set), sketch (a byte of each coordinate), bands; the last three null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                part = batch.slice(at, GROUP)
                sets = shingle_sets(part["text"].to_pylist())
                used = [i for i, s in enumerate(sets) if len(s)]
                sketch = sketches([sets[i] for i in used])
                short, bands = sketch.astype(np.uint8), band_keys(sketch)
                digest, code, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                for k, i in enumerate(used):
                    digest[i], code[i], keys[i] = digest_of(sets[i]), short[k].tobytes(), bands[k]
                columns = [part["doc_id"], part["key"], pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(code, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.record_batch(columns, names=["doc_id", "key", "n", "class", "sketch", "bands"])

    rows = docs.select(named(docs), "text", key.cast("string").alias("key"))
    return rows.mapInArrow(run, "doc_id bigint, key string, n bigint, class binary, sketch binary, bands array<bigint>")


def named(docs: DataFrame) -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY)).alias("doc_id")


def digest_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def likely(pairs: DataFrame, codes: DataFrame, least: float) -> DataFrame:
    """Pairs a, b whose sizes allow 0.75 and whose sketches agree in `least` of the coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("xs", "ys"))
            yield pa.record_batch([b["a"], b["b"]], names=["a", "b"]).filter(pa.array((x == y).mean(1) >= least))

    x, y = (codes.select(F.col("node").alias(c), F.col("sketch").alias(f"{k}s"), F.col("n").alias(f"{k}n")) for c, k in (("a", "x"), ("b", "y")))
    both = pairs.join(x, "a").join(y, "b").filter("100 * least(xn, yn) >= 75 * greatest(xn, yn)")
    return both.select("a", "b", "xs", "ys").mapInArrow(run, "a bigint, b bigint")


def set_table(needed: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """needed: node. node and items, the full set of shingles, of each. Texts are fetched by doc_id, and of rows that share one
    those with the node's digest are taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                sets = shingle_sets(batch.slice(at, GROUP)["text"].to_pylist())
                ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
                items = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.record_batch([pa.array([digest_of(s) for s in sets], pa.binary()), items], names=["class", "items"])

    wanted = nodes.join(needed, "node", "left_semi").select("node", "doc_id", "class")
    texts = docs.select(named(docs), "text").join(wanted.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")  # both sides grow with the corpus: never broadcast
    sets = texts.mapInArrow(run, "class binary, items array<bigint>").join(wanted.select("class", "node").hint("merge"), "class")
    return staged(sets.groupBy("class").agg(F.first("node").alias("node"), F.first("items").alias("items")).select("node", "items"), "near-sets")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs a, b whose full sets have 100 times the intersection at least 75 times the union."""
    sets = set_table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, docs)
    x, y = sets.select(F.col("node").alias("a"), F.col("items").alias("xs")), sets.select(F.col("node").alias("b"), F.col("items").alias("ys"))
    # the union is both sizes less the intersection
    enough = 175 * F.size(F.array_intersect("xs", "ys")).cast("long") >= 75 * (F.size("xs") + F.size("ys")).cast("long")
    links = staged(pairs.join(x, "a").join(y, "b").filter(enough).select("a", "b"), "near-links")
    discard(sets)
    return links


def same_document(found: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Edges a, b between the classes of rows that share a doc_id with other texts; None where no rows do."""
    rows = found.filter((F.col("doc_id") < NOBODY) & F.col("class").isNotNull()).select("doc_id", "class")
    spread = rows.withColumn("h", F.xxhash64("class")).groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    several = staged(spread.filter("low != high").select("doc_id"), "near-several")
    if several.isEmpty():
        return None
    own = staged(rows.join(several, "doc_id", "left_semi").distinct().join(classes, "class").select("doc_id", "node"), "near-several")
    return own.join(own.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").filter("node != b").select(F.col("node").alias("a"), "b")


def near_dedup(docs: DataFrame, key: Column | None = None, least: float = LEAST, block: int = 512) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept, and key if one is given (an expression on docs).

    Rows with equal sets are one node. Rows that share a doc_id are one document: their nodes are linked, and all are kept or
    dropped together. A null doc_id tells nothing: such rows are documents of their own, after all others; component_id is
    null where a component holds no other, and then the first row is kept. A null or wordless text has no shingles and is
    linked with nothing. An empty table gives no rows; other columns are not read. A link is missed if no band is shared
    (at a similarity of exactly 0.75 with a chance of 5 in 10**6) or fewer than `least` of the coordinates agree (4 in
    10**10 there); both chances fall fast above it."""
    found = staged(signatures(docs, F.lit(None) if key is None else key).withColumn("row", F.monotonically_increasing_id()), "near-signatures")
    classes = staged(found.filter("class is not null").groupBy("class").agg(F.min("row").alias("node"), F.min("doc_id").alias("first")), "near-classes")
    first_rows = classes.select(F.col("node").alias("row"))
    nodes = staged(found.join(first_rows, "row", "left_semi").select(F.col("row").alias("node"), "doc_id", "class", "n", "sketch", "bands"), "near-nodes")
    bands = nodes.select("node", F.explode("bands").alias("band"))
    size = bands.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = staged(bands.join(size, "band"), "near-shared")
    # the centre of a group of near copies agrees with most of them, so its buckets are the largest
    mass = shared.groupBy("node").agg(F.sum("m").alias("mass"))
    ranked = shared.join(mass, "node").select("node", "band", F.struct("mass", -F.col("node"), "node").alias("rank"))
    head = ranked.groupBy("band").agg(F.max("rank")["node"].alias("head"))
    family = staged(ranked.join(head, "band").select("node", "head").distinct(), "near-families")
    discard(shared)
    codes = nodes.select("node", "n", "sketch")
    stars = family.filter("node != head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    pairs = staged(likely(stars, codes, least), "near-pairs")
    links = verified(pairs, nodes, docs)
    discard(pairs)
    if (own := same_document(found, classes)) is not None:
        links = staged(links.unionByName(own), "near-links")
    label = staged(components(links), "near-components")
    more = within_families(family, label, nodes, docs, least, block)
    if not more.isEmpty():
        label = staged(components(links.unionByName(more)), "near-components")
    of_class = classes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    joined = found.select("doc_id", "key", "row", "n", "class").join(of_class.join(smallest, "component").select("class", "component", "component_id"), "class", "left")
    component, of = F.coalesce("component_id", "doc_id"), F.coalesce("component", "row")
    real = lambda c: F.nullif(c, F.lit(NOBODY))
    kept = F.when(component == NOBODY, F.col("row") == of).otherwise(F.col("doc_id") == component)
    return joined.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(component).alias("component_id"), kept.alias("kept"), *["key"] * (key is not None))


def within_families(family: DataFrame, label: DataFrame, nodes: DataFrame, docs: DataFrame, least: float, block: int) -> DataFrame:
    """Links a, b between different components of a family, the members of the buckets that one head leads.

    Members of a family's main component are not compared with each other. Its other members, in blocks, are compared with all
    members, in blocks: first sketches, which tell the members that may have a partner in a block, then the full sets of these,
    whose intersections are one matrix product. No pair becomes a row unless it is a link."""
    codes = nodes.select("node", "n", "sketch")
    rows = family.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = rows.groupBy("head", "component").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("head").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("m"), (F.sum("k") - F.max("k")).alias("others")).filter("others > 0")
    cut = lambda c: F.ceil(F.col(c) / block).cast("int")
    rows = rows.join(main, "head").join(codes, "node").select("head", "node", "component", "n", "sketch", (F.col("component") != F.col("main")).alias("other"), cut("others").alias("nx"), cut("m").alias("ny"))
    rows = staged(rows.withColumns({"x": F.pmod(F.xxhash64("node"), "nx").cast("int"), "y": F.pmod(F.xxhash64("node"), "ny").cast("int")}), "near-members")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys, columns = ["head", "x", "y"], ["node", "component", "n", "sketch"]
    left = rows.filter("other").select("head", "x", every("ny").alias("y"), *columns)
    right = rows.select("head", every("nx").alias("x"), "y", *columns)

    def near(key, xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        """The members of both blocks whose sketches leave a link possible."""
        found = []
        if len(xs) and len(ys):
            cx, cy = (np.frombuffer(b"".join(d.sketch), np.uint8).reshape(-1, COORDINATES) for d in (xs, ys))
            px, py, ny = xs.component.to_numpy(), ys.component.to_numpy(), ys.n.to_numpy()
            hit_y = np.zeros(len(ys), bool)
            for i, (p, n) in enumerate(zip(px, xs.n)):
                hit = ((cy == cx[i]).mean(1) >= least) & (py != p) & (100 * np.minimum(n, ny) >= 75 * np.maximum(n, ny))
                if hit.any():
                    hit_y |= hit
                    found.append((*key, xs.node.iloc[i], p, True))
            found += [(*key, node, p, False) for node, p in zip(ys.node[hit_y], py[hit_y])]
        return pd.DataFrame(found, columns=[*keys, "node", "component", "left"])

    close = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(near, "head bigint, x int, y int, node bigint, component bigint, `left` boolean")
    close = staged(close, "near-close")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between the left and the right block of one key, by the full sets."""
        sets = [np.asarray(b, np.int64) for b in pdf["items"]]
        size, side = np.array([len(s) for s in sets]), pdf["left"].to_numpy()
        keys_, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        member = np.repeat(np.arange(len(sets)), size)
        recurs = count[number] > 1
        number, member = (np.cumsum(count > 1) - 1)[number[recurs]], member[recurs]
        ix, iy = np.flatnonzero(side), np.flatnonzero(~side)
        common = np.zeros((len(ix), len(iy)), np.float32)  # exact up to 2**24
        for at in range(0, int(number.max()) + 1 if len(number) else 0, 4096):
            part = (number >= at) & (number < at + 4096)
            has = np.zeros((len(sets), 4096), np.float32)
            has[member[part], number[part] - at] = 1
            common += has[ix] @ has[iy].T
        total = size[ix][:, None] + size[iy][None, :] - common
        i, j = np.nonzero((100 * common >= 75 * total) & (pdf.component.to_numpy()[ix][:, None] != pdf.component.to_numpy()[iy][None, :]))
        node = pdf.node.to_numpy()
        a, b = node[ix[i]], node[iy[j]]
        return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    sets = set_table(close.select("node").distinct(), nodes, docs)
    links = staged(close.join(sets, "node").groupBy(*keys).applyInPandas(link, "a bigint, b bigint").distinct(), "near-links")
    discard(rows, close, sets)
    return links


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))
