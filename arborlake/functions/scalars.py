"""Scalar columns: times, log verbs, storage classes, scores and scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import _col

TB = 1e12
SECONDS_PER_YEAR = 365.25 * 86_400
#: Storage classes and their tier (1 hot to 4 cold); any other class is 0.
GCS_TIERS = {"STANDARD": 1, "NEARLINE": 2, "COLDLINE": 3, "ARCHIVE": 4}
#: Fixed values.
S3_TIERS = {"STANDARD": 1, "REDUCED_REDUNDANCY": 1, "INTELLIGENT_TIERING": 1, "OUTPOSTS": 1, "STANDARD_IA": 2, "ONEZONE_IA": 2, "GLACIER_IR": 3, "GLACIER_INSTANT_RETRIEVAL": 3, "GLACIER": 4, "DEEP_ARCHIVE": 4}
#: The verbs that access rows use.
VERBS = ["GET", "PUT", "LIST", "HEAD", "DELETE", "OTHER"]


def epoch_seconds(ts) -> Column:
    """Whole seconds, rounded down; null is 0."""
    return F.coalesce(F.unix_seconds(_col(ts).cast("timestamp")), F.lit(0)).cast("long")


def utc_day(ts) -> Column:
    return F.to_date(F.date_trunc("day", _col(ts)))


def iso_time(text) -> Column:
    """ISO-8601 with or without a fraction and an offset; null if it is neither."""
    return F.try_to_timestamp(_col(text))


def blocks_to_bytes(blocks) -> Column:
    return (_col(blocks).cast("long") * 512).cast("long")


def char_count(text, char: str) -> Column:
    return F.length(_col(text)) - F.length(F.replace(_col(text), F.lit(char)))


def verb(method, operation=None) -> Column:
    """One of ``VERBS``; a finer operation wins over the HTTP method."""
    m = _col(method)
    o = F.upper(F.when(F.coalesce(_col(operation), F.lit("")) != "", _col(operation)).otherwise(m)) if operation is not None else F.upper(m)
    listing = (F.startswith(o, F.lit("LIST")) | F.endswith(o, F.lit("_BUCKET"))) & F.contains(o, F.lit("LIST"))
    return (
        F.when(listing, "LIST")
        .when(F.startswith(o, F.lit("GET")), "GET")
        .when(F.startswith(o, F.lit("PUT")) | o.isin("POST_OBJECT", "POST_UPLOADS"), "PUT")
        .when(F.startswith(o, F.lit("HEAD")), "HEAD")
        .when(F.startswith(o, F.lit("DELETE")), "DELETE")
        .otherwise("OTHER")
    )


def tier(storage_class, tiers: dict[str, int]) -> Column:
    c, out = _col(storage_class), F.lit(None).cast("int")
    for i, name in enumerate(tiers):
        out = F.when(c == name, tiers[name]) if not i else out.when(c == name, tiers[name])
    return F.coalesce(out, F.lit(0)).cast("int")


def staleness(size, mean_mtime, now) -> Column:
    """Bytes times age in TB-years; null without a mean."""
    return (_col(size) / F.lit(TB)) * ((_col(now) - _col(mean_mtime)) / F.lit(SECONDS_PER_YEAR))


def bytes_older_than(edges, bins, t) -> Column:
    """Bytes of the bins before ``t``; the bin that holds it counts by the share of its span."""
    e, n = _col(edges), F.size(_col(edges))
    spans = F.zip_with(F.slice(e, F.lit(1), n - 1), F.slice(e, F.lit(2), n - 1), lambda a, b: F.struct(a.cast("double").alias("lo"), b.cast("double").alias("hi")))
    when = _col(t).cast("double")

    def part(s, b):
        inside = F.when(s["hi"] > s["lo"], b * (when - s["lo"]) / (s["hi"] - s["lo"])).otherwise(b.cast("double"))
        return F.when(when >= s["hi"], b.cast("double")).when(when > s["lo"], inside).otherwise(F.lit(0.0))

    return F.aggregate(F.zip_with(spans, _col(bins), part), F.lit(0.0), lambda acc, x: acc + x)


def total_bytes(bins) -> Column:
    return F.aggregate(_col(bins), F.lit(0).cast("long"), lambda acc, x: acc + x)


def peak_bin(bins) -> Column:
    return F.array_max(_col(bins))


def age01(age, oldest, newest) -> Column:
    """0 for the newest, 1 for the oldest; 0 where both are the same."""
    a, lo, hi = _col(age), _col(oldest), _col(newest)
    t = (hi - a) / F.nullif(hi - lo, F.lit(0))
    return F.when(hi <= lo, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))


def with_age01(df: DataFrame, age: str, by: list[str] | None = None) -> DataFrame:
    """The rows with ``age01`` within their group (null keys are one), or within all rows.

    A group's ends are an aggregate that combines before its shuffle and is joined back, so a group of any
    size is shared out among tasks.
    """
    ends = [F.min(age).alias("__lo"), F.max(age).alias("__hi")]
    if not by:
        lo, hi = df.agg(*ends).first()
        kind = df.schema[age].dataType
        return df.withColumn("age01", age01(age, F.lit(lo).cast(kind), F.lit(hi).cast(kind)))
    of = df.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(*ends)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return df.join(of, same).withColumn("age01", age01(age, "__lo", "__hi")).drop("__lo", "__hi", *[f"__{c}" for c in by])


def clamp(t, most: float = 1.0) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), _col(t)))


_EPS = 1e-9


def pow10(k) -> Column:
    """10^k as the decimal literal's double."""
    return F.concat(F.lit("1e"), _col(k).cast("long").cast("string")).cast("double")


def low_decade(v) -> Column:
    return F.floor(F.log10(_col(v)) + _EPS)


def high_decade(v) -> Column:
    return F.ceil(F.log10(_col(v)) - _EPS)


def log_domain(lo, hi) -> Column:
    """array(lo, hi) snapped to decades; a single decade gets one on either side."""
    a, b = low_decade(lo), high_decade(hi)
    return F.when(a < b, F.array(pow10(a), pow10(b))).otherwise(F.array(pow10(a) / 10, pow10(a) * 10))


def decades_between(lo, hi, most: int = 5) -> Column:
    """Powers of ten strictly inside (lo, hi), thinned by whole steps to at most ``most``."""
    a, b = F.ceil(F.log10(_col(lo)) + _EPS), F.floor(F.log10(_col(hi)) - _EPS)
    step = F.greatest(F.lit(1), F.ceil((b - a + 1) / F.lit(most))).cast("long")
    return F.when((b >= a) & (_col(lo) > 0) & (_col(hi) > 0), F.transform(F.sequence(a, b, step), pow10)).otherwise(F.array().cast("array<double>"))
