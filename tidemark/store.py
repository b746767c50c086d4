"""A table of keyed rows that is changed in place: upserts rewrite only the hash buckets that they touch.

Data lies in folders, one for each rewritten bucket; a manifest names the folder of every bucket. A write makes new folders and then publishes
the next manifest, so readers see all of a write or nothing. Two writers may be at it at once: the one whose manifest comes second sees
that its version is taken, merges again what the first has changed under it, and publishes the version after. Old versions stay readable until
vacuum(), which makes each a backup."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.prep import dedupe_lww


class LostRace(RuntimeError):
    """Other writers published first, as often as the write was tried."""


def _fs(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, ascending."""
    folder, files = _fs(spark, f"{root}/manifests")
    names = [x.getPath().getName() for x in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """A version's manifest, the last one's by default; version 0 is the empty table."""
    if version is None:
        version = max(versions(spark, root), default=0)
    if version == 0:
        return {"version": 0, "buckets": {}}
    return json.loads(spark.read.text(f"{root}/manifests/{version}/manifest.json", wholetext=True).first()[0])


def publish(spark: SparkSession, root: str, found: dict) -> bool:
    """Makes a manifest the table's next version; False if another writer's took that number. The folder comes into its place whole, by renaming,
    and a folder that is there already is not replaced: what stands there in the end tells whose it is."""
    found = found | {"writer": uuid.uuid4().hex}
    draft, files = _fs(spark, f"{root}/drafts/{found['writer']}")
    out = files.create(_fs(spark, f"{root}/drafts/{found['writer']}/manifest.json")[0], False)
    out.write(json.dumps(found).encode())
    out.close()
    place, _ = _fs(spark, f"{root}/manifests/{found['version']}")
    files.mkdirs(place.getParent())
    if not files.exists(place):
        files.rename(draft, place)
    won = manifest(spark, root, found["version"])["writer"] == found["writer"]
    if not won:
        files.delete(draft, True)
    return won


def create(spark: SparkSession, root: str, schema: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64) -> None:
    """Publishes an empty table: its columns, its keys, and the columns by which the last write of a key is told. Bucket sizes follow `buckets`."""
    if versions(spark, root) or not publish(spark, root, {"version": 1, "schema": schema, "keys": list(keys), "order": list(order), "n": buckets, "buckets": {}}):
        raise ValueError(f"{root} holds a table already")


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version."""
    m = manifest(spark, root, version)
    paths = [f"{root}/{p}" for p in m["buckets"].values()]
    return spark.read.schema(m["schema"]).parquet(*paths) if paths else spark.createDataFrame([], m["schema"])


def upsert(spark: SparkSession, root: str, rows: DataFrame, retries: int = 10, wait: float = 0.2) -> int:
    """Puts rows in, of each key the last by the table's order, and returns the version that holds them. Buckets without a new row are not touched.

    A write that fails leaves the table as it was; the same write again does no harm. Raises LostRace after `retries` lost races. The rows are
    written once before they are merged, so that each try merges the same ones."""
    m, name = manifest(spark, root), uuid.uuid4().hex
    keys, order, columns = m["keys"], m["order"], [x.name for x in read(spark, root).schema]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(m["n"])).cast("int").alias("bucket")
    came = f"{root}/incoming/{name}"
    dedupe_lww(rows.select(*columns), keys, order).select("*", bucket).write.parquet(came)
    new = spark.read.schema(f"{m['schema']}, bucket int").parquet(came)
    touched = [str(r.bucket) for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
    merged: dict[str, tuple[str | None, str]] = {}
    for attempt in range(retries):
        m = manifest(spark, root)
        again = [b for b in touched if b not in merged or merged[b][0] != m["buckets"].get(b)]
        if again:
            old = [f"{root}/{m['buckets'][b]}" for b in again if b in m["buckets"]]
            both = new.filter(F.col("bucket").isin([int(b) for b in again])).drop("bucket")
            if old:
                both = both.unionByName(spark.read.schema(m["schema"]).parquet(*old))
            folder = f"data/{name}-{attempt}"
            dedupe_lww(both, keys, order).select("*", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{folder}")
            merged |= {b: (m["buckets"].get(b), f"{folder}/bucket={b}") for b in again}
        if publish(spark, root, m | {"version": m["version"] + 1, "buckets": m["buckets"] | {b: merged[b][1] for b in touched}}):
            incoming, files = _fs(spark, came)
            files.delete(incoming, True)
            return m["version"] + 1
        time.sleep(wait * (attempt + 1))
    raise LostRace(f"{root}: {retries} versions were published by others first")


def restore(spark: SparkSession, root: str, version: int) -> int:
    """Publishes an old version's rows as the newest."""
    old = manifest(spark, root, version)
    while not publish(spark, root, old | {"version": (now := max(versions(spark, root)) + 1)}):
        pass
    return now


def vacuum(spark: SparkSession, root: str, keep: int = 5, older_than: float = 86400.0) -> int:
    """Deletes all but the last `keep` versions and folders that none of these names, if older than so many seconds (a writer may be at work). Returns how many folders went."""
    kept = versions(spark, root)[-keep:]
    named = {p.split("/")[1] for v in kept for p in manifest(spark, root, v)["buckets"].values()}
    gone, now = 0, time.time()
    for place, stay in (("data", named), ("incoming", set()), ("drafts", set())):
        folder, files = _fs(spark, f"{root}/{place}")
        for x in files.listStatus(folder) if files.exists(folder) else []:
            if x.getPath().getName() not in stay and now - x.getModificationTime() / 1000 > older_than:
                files.delete(x.getPath(), True)
                gone += 1
    for v in versions(spark, root):
        if v not in kept:
            path, files = _fs(spark, f"{root}/manifests/{v}")
            files.delete(path, True)
    return gone
