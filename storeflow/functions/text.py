"""String, code and date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ean13_check_digit(first12: Column) -> Column:
    """Weights 1 and 3 in turn, modulo 10."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda s, i: s + F.substring(first12, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    return F.when(first12.rlike("^[0-9]{12}$"), (10 - total % 10) % 10)


def normalize_barcode(code: Column) -> Column:
    """Trimmed; digits alone when it is at least six digits with nothing but blanks and dashes; at most 64 characters."""
    t = F.trim(code)
    digits = F.regexp_replace(t, "[ \\-]", "")
    return F.substring(F.when(digits.rlike("^[0-9]{6,}$"), digits).otherwise(t), 1, 64)


def product_error(barcode: Column, name: Column, price: Column) -> Column:
    """The first rule a product breaks; null when it is fine."""
    return (
        F.when(barcode.isNull() | ~barcode.rlike("^[A-Za-z0-9._-]{3,64}$"), "barcode").when(name.isNull() | (F.length(F.trim(name)) == 0) | (F.length(name) > 100), "name")
        .when(price.isNull() | (price < 0) | (price != F.floor(price)), "price")
    )


def mask_credentials(url: Column) -> Column:
    return F.regexp_replace(url, "(://)[^/@:]+:[^/@]+@", "$1***:***@")


def clock_text(seconds: Column) -> Column:
    """hh:mm:ss.mmm."""
    ms = F.bround(seconds * 1000).cast("bigint")
    part = lambda v, n: F.lpad(v.cast("string"), n, "0")
    return F.concat(part(F.floor(ms / 3600000), 2), F.lit(":"), part(F.floor(ms / 60000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit("."), part(ms % 1000, 3))


def seconds_of_day(text: Column) -> Column:
    """HH-MM-SS to seconds; -1 for anything else."""
    ok = text.rlike("^([01][0-9]|2[0-3])-[0-5][0-9]-[0-5][0-9]$")
    at = lambda i: F.substring(text, i, 2).cast("int")
    return F.when(ok, at(1) * 3600 + at(4) * 60 + at(7)).otherwise(-1)


def local_clock(iso: Column, zone: str) -> Column:
    """UTC ISO text to local HH:MM:SS; text that is not a time stays."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(F.try_to_timestamp(iso), zone), "HH:mm:ss"), iso)


def stem_parts(stem: Column) -> Column:
    """Tokens of an underscore-separated recording name around its DF number: store, camera, scenario, error."""
    t = F.split(stem, "_")
    at = F.array_position(F.transform(t, lambda x: x.rlike("^DF[0-9]+$")), True)
    return F.struct(
        F.when(at > 0, F.element_at(t, at.cast("int"))).alias("df"), F.when(at > 1, F.lower(F.element_at(t, (at - 1).cast("int")))).alias("store"),
        F.when((at > 0) & (at < F.size(t)), F.regexp_replace(F.get(t, at.cast("int")), "[^0-9]", "")).alias("camera"), F.when(at == 0, "no DF number").when(at == F.size(t), "no camera").alias("error"),
    )


def delay_class(dt: Column) -> Column:
    """On time within 1.5 s; a second more is borderline; else late or early by sign."""
    return F.when(F.abs(dt) <= 1.5, "on_time").when(F.abs(dt) <= 2.5, "borderline").when(dt > 0, "late").otherwise("early")


def event_text(kind: Column, before: Column, after: Column) -> Column:
    return F.format_string("%s: %d -> %d (%+d)", kind, before, after, after - before)


def rescale_frame(frame: Column, ratio: Column, last: Column) -> Column:
    """A label's frame on another frame axis, rounded half to even and clamped."""
    return F.greatest(F.lit(0), F.least(F.bround(frame * ratio).cast("bigint"), last))
