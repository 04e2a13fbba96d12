"""Column expressions: null handling, dates, recency, names, safe statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigframe.schema import LEGAL_SUFFIX, NAME_NOISE, SECURITY_NOUN, SECURITY_QUALIFIER


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def finite_or_null(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0 (or either is null)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def signed_change(now: Column, then: Column) -> Column:
    return ratio(now - then, F.abs(then))


def breadth(up: Column, down: Column) -> Column:
    return F.when(up + down > 0, ratio(up - down, up + down))


def recency_weight(age_days: Column, half_life: float, max_age: float) -> Column:
    """0.5 ** (age / half-life); unknown age counts fully, ages below 0 or above the limit not at all."""
    return F.when(age_days.isNull(), 1.0).when((age_days < 0) | (age_days > max_age), 0.0).otherwise(F.pow(F.lit(0.5), age_days / half_life))


def age_days(ts: Column, now: Column) -> Column:
    """Days between timestamps, at least 0; null for an unknown one."""
    return F.when(ts.isNotNull() & now.isNotNull(), F.greatest((F.unix_micros(now) - F.unix_micros(ts)) / 86_400_000_000.0, F.lit(0.0)))


def parse_timestamp(text: Column) -> Column:
    """RFC 2822, ISO 8601 or epoch seconds; null where none fits."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    epoch = F.timestamp_seconds(F.expr("1D") * F.when(bare.rlike(r"^\d{9,11}(\.\d+)?$"), bare).cast("double"))
    mail = F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z")))
    return F.coalesce(epoch, F.when(~bare.rlike(r"^\d+(\.\d+)?$"), F.coalesce(mail, bare.try_cast("timestamp"))))


def is_business_day(d: Column) -> Column:
    return F.weekday(d) < 5


def last_business_day(d: Column) -> Column:
    """The date itself, or the Friday before a weekend."""
    return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))


def business_days_between(a: Column, b: Column) -> Column:
    """Weekdays after a up to b."""
    days = F.when(b > a, F.sequence(F.date_add(a, 1), b)).otherwise(F.array().cast("array<date>"))
    return F.size(F.filter(days, is_business_day))


def normalize_name(name: Column) -> Column:
    out = F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+-\s+.*$", "")
    out = F.regexp_replace(out, "[^A-Za-z0-9 ]+", " ")
    out = F.regexp_replace(out, NAME_NOISE, " ")
    return F.upper(F.trim(F.regexp_replace(out, r"\s+", " ")))


def strip_descriptor(name: Column) -> Column:
    """Without the security type at the end, however often it is repeated."""
    out = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+-\s+.*$", ""))
    out = F.regexp_replace(out, rf"(?i)(?:[\s,\-]+(?:(?:{SECURITY_QUALIFIER})\s+)*(?:{SECURITY_NOUN})\s*)+$", "")
    return F.regexp_replace(out, r"^[ ,\-]+|[ ,\-]+$", "")


def clean_name(name: Column) -> Column:
    """Without security types and legal suffixes."""
    return F.trim(F.regexp_replace(strip_descriptor(name), rf"(?i)(?:,?\s+(?:{LEGAL_SUFFIX})\.?)+$", ""))


def search_queries(entity: Column, name: Column) -> Column:
    return F.array_distinct(F.filter(F.array(strip_descriptor(name), clean_name(name), entity), lambda q: q.isNotNull() & (q != "")))


def is_stale(resolved_at: Column, today: Column, ttl_days: int = 7) -> Column:
    return resolved_at.isNull() | (F.datediff(today, resolved_at) >= ttl_days)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def moment_corr(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Correlation from raw moments; null where either side is constant. Exact for ranks."""
    spread = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return F.try_divide(n * sxy - sx * sy, spread)


def quarters_back(day: Column, count: int = 5) -> Column:
    """array<struct<year, quarter>> of a date's quarter and those before it, latest first."""
    at = F.year(day) * 4 + F.quarter(day) - 1
    return F.transform(F.sequence(at, at - (count - 1), F.lit(-1)), lambda q: F.struct(F.floor(q / 4).cast("int").alias("year"), (q % 4 + 1).cast("int").alias("quarter")))
