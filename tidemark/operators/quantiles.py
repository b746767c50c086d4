"""Exact medians of any number of rows in bounded memory.

A quantile sketch brackets the middle of each column; rows within the bracket are counted exactly, and sketched again where they are still many.
What is left is sorted, at most `limit` values a column and key. So memory follows neither the rows nor their distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.folders import shared_folder

GRID, ACCURACY, LIMIT, ROUNDS = 256, 10_000, 10_000, 64


def _staged(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession, "quantiles")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_medians(frame: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), limit: int = LIMIT) -> DataFrame:
    """keys and, under its name, the median of each column (the mean of the two middle values of an even number), null without a value. Nulls and NaN
    are left out; a null key is a key. Where no key has more than `limit` values of a column, one aggregate finds them all."""
    keys, c = list(keys), F.col
    one = F.struct(*keys) if keys else F.struct(F.lit(1).alias("_1"))
    values = F.inline(F.array(*[F.struct(F.lit(i).alias("_col"), F.col(x).cast("double").alias("_v")) for i, x in enumerate(columns)]))
    every = frame.select(one.alias("_key")).distinct() if keys else frame.sparkSession.range(1).select(one.alias("_key"))
    long = frame.select(one.alias("_key"), values).filter(c("_v").isNotNull() & ~F.isnan("_v"))
    known = _staged(long.groupBy("_key", "_col").agg(F.count(F.lit(1)).alias("m"), F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    most = known.agg(F.max("m")).first()[0] or 0
    if most <= limit:
        found = long.groupBy("_key", "_col").agg(F.percentile("_v", F.lit(0.5)).alias("median"))
    else:
        # below: values under the bracket; first and second: the middle's places among all values
        at = known.select("_key", "_col", "lo", "hi", "m", F.lit(0).cast("long").alias("below"), F.floor((c("m") - 1) / 2).alias("first"), F.floor(c("m") / 2).alias("second"))
        grid, done = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)]), []
        for _ in range(ROUNDS):
            at = _staged(at)
            done.append(at.filter((c("m") <= limit) | (c("lo") == c("hi"))))
            open_ = at.filter((c("m") > limit) & (c("lo") < c("hi")))
            if open_.isEmpty():
                break
            inside = long.join(open_, ["_key", "_col"]).filter(c("_v").between(c("lo"), c("hi")))
            sketch = inside.groupBy("_key", "_col").agg(F.percentile_approx("_v", grid, F.lit(ACCURACY)).alias("q"))
            place = lambda x: (c(x) - c("below")) * GRID / c("m")
            cut = open_.join(sketch, ["_key", "_col"]).withColumns({"a": F.get("q", F.greatest(F.lit(0), F.floor(place("first")).cast("int") - 1)), "b": F.get("q", F.least(F.lit(GRID), F.ceil(place("second")).cast("int") + 1))}).drop("q")
            count = lambda test: F.count(F.when(test, 1))
            names = ["lo", "hi", "below", "first", "second", "a", "b"]
            rows = long.join(_staged(cut), ["_key", "_col"]).filter(c("_v").between(c("lo"), c("hi"))).groupBy("_key", "_col", "m", *names).agg(count(c("_v") < c("a")).alias("under"), count(c("_v") <= c("b")).alias("upto"))
            # a side of the sketch that would leave the middle out is not taken
            low, high = c("below") + c("under") <= c("first"), c("below") + c("upto") > c("second")
            under, upto = F.when(low, c("under")).otherwise(0), F.when(high, c("upto")).otherwise(c("m"))
            at = rows.select("_key", "_col", F.when(low, c("a")).otherwise(c("lo")).alias("lo"), F.when(high, c("b")).otherwise(c("hi")).alias("hi"), (upto - under).alias("m"), (c("below") + under).alias("below"), "first", "second")
        else:
            raise RuntimeError("the sketches don't narrow the bracket")
        ready = done[0]
        for d in done[1:]:
            ready = ready.unionByName(d)
        flat = ready.filter(c("lo") == c("hi")).select("_key", "_col", c("lo").alias("median"))
        inside = long.join(ready.filter(c("lo") < c("hi")), ["_key", "_col"]).filter(c("_v").between(c("lo"), c("hi")))
        held = inside.groupBy("_key", "_col", "below", "first", "second").agg(F.sort_array(F.collect_list("_v")).alias("v"))
        pick = lambda x: F.get("v", (c(x) - c("below")).cast("int"))
        found = flat.unionByName(held.select("_key", "_col", (pick("first") * 0.5 + pick("second") * 0.5).alias("median")))
    wide = found.groupBy("_key").agg(*[F.max(F.when(c("_col") == i, c("median"))).alias(x) for i, x in enumerate(columns)])
    return every.join(wide, "_key", "left").select(*[c(f"_key.{k}").alias(k) for k in keys], *columns)
