"""Numbers, dates, lists, addresses and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POSITIVE, NEUTRAL, NEGATIVE = "positive", "neutral", "negative"
CATEGORIES = [POSITIVE, NEGATIVE, NEUTRAL]

# Exclusive bounds of the polarity categories and the image address.
POSITIVE_ABOVE = 0.05
NEGATIVE_BELOW = -0.15
POSTER_BASE = "https://image.tmdb.org/t/p/w500"


def category(polarity: Column, above: float = POSITIVE_ABOVE, below: float = NEGATIVE_BELOW) -> Column:
    """``positive`` above, ``negative`` below, else ``neutral``."""
    return F.when(polarity > above, POSITIVE).when(polarity < below, NEGATIVE).otherwise(NEUTRAL)


def sign_category(score: Column) -> Column:
    return category(score, 0.0, 0.0)


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b``, or 0 where ``b`` is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def to_number(c: Column, kind: str = "bigint") -> Column:
    """The number in a string, NULL where there is none."""
    return c.try_cast(kind)


def currency(c: Column) -> Column:
    """``$1,870,305`` -> 1870305; anything that is no whole number -> NULL."""
    bare = F.trim(F.translate(c, "$,", ""))
    return F.when(bare.rlike(r"^[+-]?[0-9]+$"), bare.try_cast("bigint"))


def currency_fallback(revenue: Column, box_office: Column) -> Column:
    """Keep a known revenue; otherwise take the parsed string, or the old value where parsing fails."""
    unknown = revenue.isNull() | (revenue == 0)
    return F.when(unknown, F.coalesce(currency(box_office), revenue)).otherwise(revenue)


def to_day(c: Column) -> Column:
    """``yyyy-MM-dd`` -> date, NULL on anything else."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")


def year_text(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.substring(c, 1, 4)).otherwise(F.lit("N/A"))


def iso_time(c: Column) -> Column:
    """ISO 8601 text -> timestamp, NULL where unparsable."""
    return F.try_to_timestamp(c)


def day_start(day: Column, kind: str = "timestamp") -> Column:
    """The midnight in UTC that starts a day, as a column of the times' own type; independent of the session's zone."""
    if kind == "timestamp_ntz":
        return day.cast(kind)
    return F.timestamp_seconds(F.unix_date(day).cast("bigint") * 86400)


def until(published_at: Column, cutoff: Column) -> Column:
    """True up to the cut-off; an unknown time or cut-off keeps the row."""
    return F.coalesce(published_at <= cutoff, F.lit(True))


def joined_names(structs: Column, field: str = "name") -> Column:
    return F.array_join(F.transform(structs, lambda s: s[field]), ", ")


def split_list(c: Column) -> Column:
    return F.transform(F.split(c, ","), lambda s: F.trim(s))


def video_id(url: Column) -> Column:
    """Video key of a short, watch or embed address; other text is taken to be a key already."""
    after_slash = F.split_part(F.element_at(F.split(url, "/"), -1), F.lit("?"), F.lit(1))
    query_value = F.regexp_extract(url, r"^[^#?]*\?(?:[^#]*?&)?v=([^&#]+)", 1)
    embedded = F.split_part(F.split_part(url, F.lit("youtube.com/embed/"), F.lit(-1)), F.lit("?"), F.lit(1))
    return (
        F.when(url == "", F.lit(None).cast("string"))
        .when(url.contains("youtu.be"), after_slash)
        .when(url.contains("youtube.com/watch"), F.coalesce(F.try_url_decode(query_value), query_value))
        .when(url.contains("youtube.com/embed/"), embedded)
        .otherwise(url)
    )


def poster_url(path: Column, base: str = POSTER_BASE) -> Column:
    return F.concat(F.lit(base), path)


def trailer_query(title: Column, year: Column | None = None) -> Column:
    text = F.concat(title, F.lit(" official trailer"))
    if year is None:
        return text
    return F.concat(text, F.coalesce(F.concat(F.lit(" "), year.cast("string")), F.lit("")))


def is_likely_trailer(video_title: Column, description: Column, movie_title: Column) -> Column:
    """Title speaks of a trailer or teaser, and title or description names the movie."""
    t, d, m = F.lower(video_title), F.lower(description), F.lower(movie_title)
    return (t.contains("trailer") | t.contains("teaser")) & (t.contains(m) | d.contains(m))


def pick_trailer(videos: Column) -> Column:
    """Key of the first trailer on the video site, else of the first teaser, else NULL."""

    def first(kind: str) -> Column:
        return F.get(F.filter(videos, lambda v: (v["type"] == kind) & (v["site"] == "YouTube")), F.lit(0))["key"]

    return F.coalesce(first("Trailer"), first("Teaser"))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def fixed(c: Column, digits: int) -> Column:
    """Fixed-point text, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(c, digits))


def millions(c: Column) -> Column:
    return F.concat(F.lit("$"), fixed(c / 1e6, 1), F.lit("M"))


def percent_text(c: Column, digits: int = 1) -> Column:
    return F.concat(fixed(c, digits), F.lit("%"))
