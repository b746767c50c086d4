"""The ledger as a stream: payload files in any order, last write wins, restartable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import canonical_series, loose_json, num, payload_field, to_ms
from ..operators.prep import dedupe_lww


def parse_payloads(raw: DataFrame, aliases: dict[str, str] | None = None, source: str = "tradingview") -> DataFrame:
    """raw: value (text), received_at. Ledger rows with `reject`, the reason a payload is refused or null."""
    rows = raw.withColumn("json", loose_json(F.col("value")))
    field = lambda f: payload_field(F.col("json"), f)
    rows = rows.select(
        canonical_series(field("series_id"), aliases or {}).alias("series_id"), to_ms(field("time_utc")).alias("time_utc_ms"), F.upper(F.trim(field("interval"))).alias("interval"), num(field("value")).alias("value"),
        F.coalesce(F.timestamp_millis(to_ms(field("timenow"))), F.col("received_at")).alias("received_at"), F.col("json").alias("payload_json"), field("source").alias("source"), field("schema_version").alias("version"), F.col("value").alias("raw"),
    )
    reject = F.when(F.col("payload_json").isNull(), "json").when(F.coalesce(F.lower("source"), F.lit("")) != source, "source").when(F.coalesce("version", F.lit("")) != "1", "version")
    reject = reject.when(F.coalesce("series_id", F.lit("")) == "", "series_id").when(F.col("time_utc_ms").isNull(), "time").when(F.col("interval").isNull(), "interval").when(F.col("value").isNull(), "value")
    return rows.withColumn("reject", reject).drop("source", "version")


def triggers_recompute(series: Column, ids: tuple[str, ...] = ()) -> Column:
    """Whether a series starts a recomputation: any without ids, else those listed or of the watched kinds."""
    if not ids or any(i.strip() in ("*", "ALL") for i in ids):
        return F.lit(True)
    return series.isin(*ids) | series.rlike("IXIC|NASDAQ|BTC|COPPER")


def start_ledger(spark: SparkSession, source: str, out: str, checkpoint: str, aliases: dict[str, str] | None = None, files_per_batch: int = 1000, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Appends accepted payloads of text files to out, each batch under its number, so that a batch run again replaces itself.

    No watermark: late rows are kept, and read_ledger() takes the last write of each key. Refused payloads go to out/rejected. then is
    called with a batch's number once its rows are written, again if the batch is run again."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source).withColumn("received_at", F.current_timestamp())

    def write(batch: DataFrame, n: int) -> None:
        rows = parse_payloads(batch, aliases).withColumns({"seq": F.monotonically_increasing_id(), "raw": F.when(F.col("reject").isNotNull(), F.col("raw"))})
        rows = rows.persist()  # an accepted payload is held once, as its JSON
        rows.filter("reject is null").drop("reject", "raw").write.mode("overwrite").parquet(f"{out}/accepted/batch={n}")
        rows.filter("reject is not null").select("raw", "reject").write.mode("overwrite").parquet(f"{out}/rejected/batch={n}")
        rows.unpersist()
        if then:
            then(n)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accepted(spark: SparkSession, out: str) -> DataFrame:
    """All accepted rows and the number of their batch."""
    return spark.read.parquet(f"{out}/accepted")


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """The last write of each (series, time, interval): the later arrival, then the later batch and row."""
    return dedupe_lww(accepted(spark, out), order=("received_at", "batch", "seq"))


def windowed_counts(events: DataFrame, late: str = "2 hours", length: str = "1 day") -> DataFrame:
    """The variant with a watermark: count, sum and last value of each series and window of a streaming or batch table (series_id, ts, value)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max_by("value", "ts").alias("last")).select("series_id", F.col("window.start").alias("start"), "n", "total", "last")
