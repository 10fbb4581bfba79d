"""Text, name and format functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normalise_text(x: Column) -> Column:
    """Lower case, any white space collapsed to one space, trimmed."""
    return F.btrim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def normalise_name(x: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(F.btrim(x)), "- ", "__"), "_+", "_")


def slug(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def duration(seconds: Column) -> Column:
    """``SSs``, ``MMmSSs`` or ``HHhMMmSSs`` of half-even rounded seconds."""
    s = F.bround(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(s < 60, F.concat(two(r), F.lit("s"))).when(s < 3600, F.concat(two(m), F.lit("m"), two(r), F.lit("s"))).otherwise(F.concat(two(h), F.lit("h"), two(m), F.lit("m"), two(r), F.lit("s")))


def fixed(x: Column, digits: int = 2) -> Column:
    """Fixed decimals, half-even; ``N/A`` for null."""
    return F.coalesce(F.replace(F.format_number(x, digits), F.lit(","), F.lit("")), F.lit("N/A"))


def cosine_schedule(step: Column, warm_up: int, total: int, least: float = 0.01) -> Column:
    done = (step - warm_up) / F.lit(float(total - warm_up))
    return F.when(step < warm_up, step / F.lit(float(warm_up))).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(done, F.lit(1.0)))))
