"""Jobs that must not run twice at once or too often. Lock and stamp are small files in a folder that all drivers share."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .. import store
from ..config import DEFAULT, EngineConfig
from ..operators import score


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def last_run(spark: SparkSession, folder: str, job: str) -> float | None:
    """When the job last ended well, in seconds since the epoch; None if it never did or its stamp can't be read."""
    path, files = _path(spark, f"{folder}/{job}.json")
    if not files.exists(path):
        return None
    text = spark.read.text(path.toString(), wholetext=True).first()
    try:
        return float(json.loads(text[0])["last_run"])
    except (TypeError, ValueError, KeyError):
        return None


def run_once(spark: SparkSession, folder: str, job: str, work: Callable[[], object], min_interval: float | None = None, force: bool = False, stale_after: float = 86400.0, now: Callable[[], float] = time.time, attempts: int = 1, pause: float = 0.5):
    """Runs the work unless another driver is at it or, without force, it last ended less than min_interval seconds ago; then returns None.

    The lock is a file that only one driver can create; one older than stale_after seconds, whose driver is gone, is taken over. A lock that is
    held is tried `attempts` times, after ever longer pauses."""
    lock, files = _path(spark, f"{folder}/{job}.lock")
    for attempt in range(attempts):
        if files.exists(lock) and now() - files.getFileStatus(lock).getModificationTime() / 1000 > stale_after:
            files.delete(lock, False)
        try:
            files.create(lock, False).close()
            break
        except Py4JJavaError:
            if attempt == attempts - 1:
                return None
            time.sleep(pause * (attempt + 1))
    try:
        before = last_run(spark, folder, job)
        if not force and min_interval is not None and before is not None and now() - before < min_interval:
            return None
        result = work()
        stamp, _ = _path(spark, f"{folder}/{job}.json")
        out = files.create(stamp, True)
        out.write(json.dumps({"last_run": now()}).encode())
        out.close()
        return result
    finally:
        files.delete(lock, False)


def recompute_stored(spark: SparkSession, root: str, days: DataFrame, key: str = "scenario", config: EngineConfig = DEFAULT, reset: bool = False, attempts: int = 10) -> int | None:
    """Brings the stored states (a table of store.create() with keys `key` and date) up to the last of days, from the last stored day on; with reset, or
    with nothing stored, all days. One driver at a time; returns the new version, None if the lock was held at every attempt."""

    def work() -> int:
        stored = store.read(spark, root)
        new = score.recompute_states(days, None if stored.isEmpty() else stored, key, config, reset)
        return store.upsert(spark, root, new)

    return run_once(spark, root, "recompute", work, force=True, attempts=attempts)
