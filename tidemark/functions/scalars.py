"""Scalar column functions: parsing, numeric helpers, labels. All are built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi
#: Other names of the payload's keys, and of series.
KEY_ALIASES = {"time_utc": ("time_utc", "time", "timeUTC", "time utc"), "timenow": ("timenow", "time_now", "time now"), "series_id": ("series_id", "seriesId"), "schema_version": ("schema_version", "schemaVersion"), "interval": ("interval",), "value": ("value",), "source": ("source",)}


def num(text: Column) -> Column:
    """Double, or null where the text is none or not finite."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def to_ms(text: Column) -> Column:
    """Epoch milliseconds: a number above 1e10 is milliseconds, another seconds (truncated to ms); else ISO-8601, UTC without an offset, midnight without a time."""
    x = num(text)
    zoned = F.when(text.rlike(r"^\d{4}-\d\d-\d\d$"), F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    iso = F.unix_millis(F.try_to_timestamp(zoned))
    return F.when(x > 1e10, x.cast("long")).when(x.isNotNull(), (x * 1000).cast("long")).otherwise(iso)


def loose_json(text: Column) -> Column:
    """The text if it is JSON, else with bare ISO times after time_utc or timenow quoted if that is, else null."""
    quoted = F.regexp_replace(text, r'("(?:time_utc|timenow)"\s*:\s*)(\d{4}-\d\d-\d\dT[0-9:.]+(?:Z|[+-]\d\d:?\d\d)?)', '$1"$2"')
    valid = lambda t: F.try_parse_json(t).isNotNull()
    return F.when(valid(text), text).when(valid(quoted), quoted)


def payload_field(json: Column, field: str) -> Column:
    return F.coalesce(*[F.get_json_object(json, f"$['{k}']") for k in KEY_ALIASES[field]])


def canonical_series(raw: Column, aliases: dict[str, str]) -> Column:
    """Trimmed, upper case, mapped by the alias table."""
    key = F.upper(F.trim(raw))
    if not aliases:
        return key
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv]), key), key)


def csv_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def safe_log(x: Column) -> Column:
    return F.when(~F.isnan(x) & (x > 0) & (x != float("inf")), F.ln(x))


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x < low, F.lit(float(low))).when(x > high, F.lit(float(high))).otherwise(x)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-clip(z, -35, 35)))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; the error is below 1.5e-7."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    y = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    return F.signum(x) * y


def lognormal_cdf(days: float, mu: Column, sigma: Column) -> Column:
    return 0.5 * (1 + erf((math.log(days) - mu) / (sigma * math.sqrt(2))))


def circular_distance(a: Column, b: Column | float) -> Column:
    return F.pmod(a - b + math.pi, F.lit(TAU)) - math.pi


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def pct(a: Column, b: Column) -> Column:
    return (b - a) / F.nullif(a, F.lit(0.0)) * 100


def level_label(p: Column) -> Column:
    """Probability as one of five words. The bounds and the words."""
    return F.when(p.isNull(), "unknown").when(p < 0.1, "very low").when(p < 0.25, "low").when(p < 0.5, "medium").when(p < 0.75, "high").otherwise("very high")


def bias_label(net: Column) -> Column:
    """Euphoria less crisis as one of five words. The bounds and the words."""
    words = F.when(net >= 0.15, "Strong overheat bias").when(net >= 0.05, "Overheat bias").when(net <= -0.15, "Strong risk-off bias").when(net <= -0.05, "Risk-off bias")
    return F.when(net.isNull() | F.isnan(net), "Unknown").otherwise(F.coalesce(words, F.lit("Mixed/neutral")))


def clock_angle(months: Column, period: Column) -> Column:
    return -90 + 360 * clip(1 - months / F.nullif(period, F.lit(0.0)), 0, 1)


def truncated(text: Column, limit: int = 1800) -> Column:
    """The text with a mark at its end if it was longer than limit; null as empty."""
    mark = "\u2026(truncated)"
    return F.when(text.isNull(), "").when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 15), F.lit(mark)))


def preview(text: Column, limit: int = 500) -> Column:
    return F.when(text.isNull(), "").when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("\u2026")))


def event_time(time_utc_ms: Column, received_at: Column, by_arrival: bool) -> Column:
    """When an observation counts: at its own time, or at its arrival where that is known and can be read."""
    own = F.timestamp_millis(time_utc_ms)
    return F.coalesce(received_at.try_cast("timestamp"), own) if by_arrival else own
