"""Best-effort casts, ratios and display columns."""

from pyspark.sql import Column, functions as F


def to_double(c: Column) -> Column:
    """A number if it is one; NaN and text that is none become null."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def to_long(c: Column) -> Column:
    """Cut towards zero."""
    return to_double(c).try_cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def symbol(c: Column) -> Column:
    return F.upper(F.trim(c))


def change(last: Column, previous: Column) -> Column:
    return F.when(previous != 0, F.round(last - previous, 4))


def change_pct(last: Column, previous: Column) -> Column:
    return F.round(F.try_divide(last - previous, previous) * 100, 2)


def direction(pct: Column) -> Column:
    """up above 0.049, down below -0.049, else flat; na for null."""
    return F.when(pct.isNull(), "na").when(pct > 0.049, "up").when(pct < -0.049, "down").otherwise("flat")


def age_text(minutes: Column) -> Column:
    """Whole minutes below an hour, full hours below a day, else full days; empty for null."""
    whole = F.round(minutes).cast("bigint")
    hours, days = F.floor(whole / 60), F.floor(whole / 1440)
    text = F.when(whole < 60, F.format_string("%dm ago", whole)).when(hours < 24, F.format_string("%dh ago", hours)).otherwise(F.format_string("%dd ago", days))
    return F.when(whole.isNull(), "").otherwise(text)


def price_text(c: Column) -> Column:
    """With thousands separators: whole from 1000 on, at most 2 places from 1 on, else at most 4; a dash for null."""
    places = lambda k: F.regexp_replace(F.format_number(F.round(c, k), k), r"(\.\d*?)0+$", "$1")
    text = F.when(c >= 1000, F.format_number(F.round(c, 0), 0)).when(c >= 1, places(2)).otherwise(places(4))
    return F.when(c.isNull(), "\u2014").otherwise(F.regexp_replace(text, r"\.$", ""))


def pct_text(c: Column) -> Column:
    """Two places, with a sign above 0."""
    return F.concat(F.when(c > 0, "+").otherwise(""), F.format_string("%.2f%%", c))


def sample_stdev(c: str | Column) -> Column:
    """Aggregate: the sample standard deviation, 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(c), F.lit(0.0))


def epoch_utc(c: Column) -> Column:
    return F.timestamp_seconds(c)


def us_date(c: Column) -> Column:
    """MM/DD/YYYY; null if there is no such day."""
    return F.to_date(F.try_to_timestamp(c, F.lit("MM/dd/yyyy")))
