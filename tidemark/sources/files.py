"""Readers of the ledger's file shapes: combined, wide and single-series CSV, ledger and state tables. Paths may be in any store Spark reads."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.scalars import num, to_ms
from ..operators.portfolio import bond_index

LEDGER = "series_id string, time_utc_ms bigint, interval string, value double, received_at timestamp_ntz, payload_json string"
STATES = "as_of_date date, state string, score double, reasons string, health string, created_at timestamp_ntz"
PORTFOLIO = "as_of_date date, portfolio_date date, state string, model string, target_vol_ann double, vol_window_days int, ma_window_days int, leverage_cap double, gross_exposure double, cash_weight double, created_at timestamp_ntz"
WEIGHTS = "as_of_date date, asset_id string, weight double"
#: What a wide file of assets is known by.
ASSET_MARKS = ("BTCUSD", "USDKRW", "XAUUSD")


def read_csv(spark: SparkSession, path: str, encodings: Sequence[str] = ("utf-8-sig", "cp949")) -> DataFrame:
    """A CSV file with a header, all text, in the first encoding that fits.

    UTF-8 goes through Spark's reader. Any other encoding, which that reader lacks, is decoded file by file in the tasks: such
    exports are small files, and a quoted line feed is not supported there."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    bad = "\ufffd"
    if not any(bad in c for c in df.columns) and (not df.columns or df.filter(F.contains(F.concat_ws("", *df.columns), F.lit(bad))).isEmpty()):
        return df

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"].to_pylist():
                for k, e in enumerate(encodings):
                    try:
                        lines = content.decode(e).splitlines()
                        break
                    except UnicodeDecodeError:
                        if k == len(encodings) - 1:
                            raise
                yield pa.record_batch([pa.array(range(len(lines)), pa.int64()), pa.array(lines, pa.string())], names=["n", "line"])

    lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, "n bigint, line string")
    names = next(csv.reader([lines.filter("n = 0").first().line]))
    schema = ", ".join(f"`{c}` string" for c in names)
    return lines.filter("n > 0 and line <> ''").select(F.from_csv("line", schema).alias("r")).select("r.*")


def sniff_assets(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of CSV files below the folder that start with time and name the marker assets in their first 4 KiB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder)
    head = F.substring("content", 1, 4096).cast("string")
    hit = F.lower(F.ltrim(F.regexp_replace(head, "^﻿", ""))).startswith("time")
    for m in ASSET_MARKS:
        hit = hit & F.contains(head, F.lit(m))
    return files.select("path", head.alias("head")).filter(hit).select("path").orderBy("path")


def observations(wide: DataFrame, time: str, columns: dict[str, str], interval: str, intervals: dict[str, str] | None = None, whole_days: bool = False) -> DataFrame:
    """Long observations from a wide table of text: columns maps a column to its series; cells that are no number are left out.

    intervals: series whose interval is another one; whole_days: times are set to 00:00 UTC of their day."""
    picked = wide.select(F.col(time).alias("time"), *[F.col(c).cast("string").alias(s) for c, s in columns.items()])
    long = picked.unpivot(["time"], list(columns.values()), "series_id", "text")
    ms, own = to_ms(F.col("time").cast("string")), F.lit(interval)
    for series, i in (intervals or {}).items():
        own = F.when(F.col("series_id") == series, i).otherwise(own)
    ms = ms - F.pmod(ms, F.lit(86400000)) if whole_days else ms
    out = long.select("series_id", ms.alias("time_utc_ms"), own.alias("interval"), num(F.col("text")).alias("value"))
    return out.filter("time_utc_ms is not null and value is not null")


def by_prefix(wide: DataFrame, prefixes: dict[str, str]) -> dict[str, str]:
    """The first column that starts with each prefix, mapped to the prefix's series."""
    found = {}
    for prefix, series in prefixes.items():
        name = next((c for c in wide.columns if c.upper().startswith(prefix.upper())), None)
        if name is not None:
            found[name] = series
    return found


def read_combined(spark: SparkSession, paths: dict[str, str], columns: dict[str, dict[str, str]]) -> DataFrame:
    """One file for each interval: paths maps 1D, 1W, 1M to a file, columns maps the interval to its column -> series.
    Each series comes from the file of its own interval alone; of several rows of one day the last in time counts."""
    parts = [observations(read_csv(spark, p), "time", {c: s for c, s in columns[i].items()}, i) for i, p in sorted(paths.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    day = F.floor(F.col("time_utc_ms") / 86400000)
    return out.groupBy("series_id", "interval", day.cast("long").alias("day")).agg(F.max_by("value", "time_utc_ms").alias("value"), F.max("time_utc_ms").alias("time_utc_ms")).select("series_id", "time_utc_ms", "interval", "value")


def read_any(spark: SparkSession, path: str, interval: str = "1D", columns: dict[str, str] | None = None, series: str | None = None, intervals: dict[str, str] | None = None) -> DataFrame | None:
    """A file of any of three shapes: wide assets (every column a series), combined (columns given, with the intervals of some
    series), or a single series with close; else None."""
    df = read_csv(spark, path)
    names = [c for c in df.columns if c != "time"]
    if "time" not in df.columns:
        return None
    if any(m in c for c in names for m in ASSET_MARKS):
        return observations(df, "time", {c: c for c in names}, "1D")
    if columns and (known := {c: s for c, s in columns.items() if c in names}):
        return observations(df, "time", known, interval, intervals)
    if "close" in names and series:
        return observations(df, "time", {"close": series}, interval)
    return None


def scan_series(ledger: DataFrame, ids: Sequence[str | None], interval: str | None = None) -> DataFrame:
    """The rows of some series, of one interval if it is given. Blank ids are left out; without an id there are no rows."""
    wanted = [i for i in ids if i]
    rows = ledger.filter(F.col("series_id").isin(*wanted)) if wanted else ledger.limit(0)
    return rows.filter(F.col("interval") == interval) if interval else rows


#: A price file's assets by the beginnings of their columns, and the bonds that are made of yields, with their durations.
ASSET_PREFIXES = {"XAUUSD": "GOLD", "BTCUSD": "BTC", "USDKRW": "USDKRW", "COPPER": "COPPER", "REMX": "REMX", "ALUMINUM": "ALUMINUM", "URANIUM": "URANIUM"}
YIELD_PREFIXES = {"UST10Y": ("US10Y",), "UST2Y": ("US02Y", "US2Y")}


def price_matrix(spark: SparkSession, path: str, config: EngineConfig = DEFAULT, carry: bool = True) -> DataFrame:
    """Prices from a wide file with time and close: series_id, date, value. close is NASDAQ, other assets are known by the beginning of a column's
    name, and bonds are indices made of their yields. Rows without a readable time are left out; of a day's rows the last counts."""
    raw = read_csv(spark, path)
    if not {"time", "close"} <= set(raw.columns):
        raise ValueError(f"{path} lacks the columns time and close")
    durations = {"UST10Y": config.bond10_duration, "UST2Y": config.bond2_duration}
    columns = {"close": "NASDAQ", **by_prefix(raw.select(*[c for c in raw.columns if c not in ("time", "close")]), ASSET_PREFIXES)}
    yields = {}
    for bond, prefixes in YIELD_PREFIXES.items():
        name = next((c for p in prefixes for c in by_prefix(raw, {p: bond})), None)
        if name is not None:
            yields[name] = bond
    rows = observations(raw, "time", columns | yields, "1D")
    daily = rows.groupBy("series_id", F.timestamp_millis("time_utc_ms").cast("date").alias("date")).agg(F.max_by("value", "time_utc_ms").alias("value"))
    out = daily.filter(~F.col("series_id").isin(*durations))
    for bond in yields.values():
        out = out.unionByName(bond_index(daily.filter(F.col("series_id") == bond), durations[bond], carry))
    return out


def latest(states: DataFrame, n: int, upto=None) -> DataFrame:
    """The last n states, newest first; with upto only those strictly before that day."""
    rows = states if upto is None else states.filter(F.col("as_of_date") < F.lit(upto))
    return rows.orderBy(F.desc("as_of_date")).limit(n)


def restore_states(csv: DataFrame) -> DataFrame:
    """States from an exported CSV of text columns: typed, with the nested reasons rebuilt."""
    flag = lambda c: F.coalesce(num(F.col(c)) > 0, F.lower(c) == "true", F.lit(False))
    reasons = F.struct(num(F.col("score")).alias("raw_score"), F.filter(F.split("triggers", r" \| "), lambda x: x != "").alias("triggers"), flag("hard_defcon1").alias("hard"), F.struct(F.col("action"), num(F.col("equity_weight")).alias("equity_weight")).alias("allocation"))
    return csv.select(F.col("as_of_date").try_cast("date").alias("as_of_date"), "state", num(F.col("score")).alias("score"), F.to_json(reasons).alias("reasons")).filter("as_of_date is not null")


def find_folder(spark: SparkSession, base: str, names: Sequence[str], escaped: str | None = None) -> str:
    """The first of the named folders below base that exists; else one that an archive's escapes left (its name starts with #U and holds
    `escaped`); else the first name, which may not exist. base may be in any store that Spark reads."""
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in names:
        path = f"{base.rstrip('/')}/{name}"
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
            return path
    if escaped and files.exists(root):
        left = sorted(s.getPath().getName() for s in files.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("#U") and escaped in s.getPath().getName())
        if left:
            return f"{base.rstrip('/')}/{left[0]}"
    return f"{base.rstrip('/')}/{names[0]}"


def preferred(first: DataFrame | None, second: DataFrame | None) -> DataFrame | None:
    """The first source if it has rows, else the second."""
    return second if first is None or (second is not None and first.isEmpty()) else first


def read_timing_input(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of daily features for timing(): its key is `date`, else `time`, else the first column; numbers are parsed, and what is no
    number is null. None where the file has no rows."""
    df = read_csv(spark, path)
    if not df.columns or df.isEmpty():
        return None
    key = next((c for c in ("date", "time") if c in df.columns), df.columns[0])
    return df.select(F.substring(F.col(f"`{key}`"), 1, 10).try_cast("date").alias("date"), *[num(F.col(f"`{c}`")).alias(c) for c in df.columns if c != key]).filter("date is not null")
