"""Columns for where evidence stands, paths of topics, and answers of a provider."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attributes that may leave the process, and marks of a used-up quota in a provider's code.
PUBLIC_ATTRIBUTES = ("task.id", "job.id", "run.id", "stage", "outcome", "error.code", "item.count", "delivery.count")
QUOTA_MARKS = ("quota", "balance", "arrearage", "insufficient_quota")


def place(source_type: Column, printed: Column, physical: Column, start: Column, end: Column) -> Column:
    """``page · lines`` as shown to users; a part that is not known is left out, and so the place may be empty.

    ``printed`` is the page number on the paper, ``physical`` that in the file; ``start`` below 1 means no lines.
    """
    number = physical.cast("string")
    page = (
        F.when((printed != "") & (physical > 0), F.concat(F.lit("文档第 "), printed, F.lit(" 页（PDF 第 "), number, F.lit(" 页）")))
        .when((source_type == "pdf") & (physical > 0), F.concat(F.lit("PDF 第 "), number, F.lit(" 页")))
        .when(physical > 0, F.concat(F.lit("第 "), number, F.lit(" 页")))
    )
    lines = F.when(start > 0, F.concat(F.lit("L"), start.cast("string"), F.lit("–L"), end.cast("string")))
    return F.concat_ws(" · ", page, lines)


def topic_path(value: Column) -> Column:
    """The relative path of an HTML topic in an address; null if it climbs up or names no HTML file."""
    path = F.regexp_replace(F.regexp_replace(F.trim(value), r"\\", "/"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    path = F.regexp_extract(path, r"^[^?#]*", 0)
    plain = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    parts = F.filter(F.split(plain, "/"), lambda p: (p != "") & (p != "."))
    joined = F.array_join(parts, "/")
    return F.when(~F.array_contains(parts, "..") & joined.rlike(r"(?i)[^/]\.x?html?$"), joined)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a header that holds seconds or an HTTP date; null if it says nothing of use."""
    text = F.trim(header)
    moment = F.try_to_timestamp(F.regexp_extract(text, r"^[A-Z][a-z]{2}, (\d\d [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    seconds = F.coalesce(text.try_cast("double"), F.unix_timestamp(moment).cast("double") - F.unix_timestamp(now))
    return F.when((seconds >= 0) & (seconds < float("inf")), seconds)


def quota_used_up(code: Column) -> Column:
    """Whether a provider's error code speaks of quota or billing; one of a rate does not."""
    text = F.lower(F.coalesce(code, F.lit("")))
    marked = F.lit(False)
    for mark in QUOTA_MARKS:
        marked = marked | F.contains(text, F.lit(mark))
    return marked & ~F.contains(text, F.lit("rate"))


def public_attributes(attributes: Column) -> Column:
    """The entries of a map that may be reported, without null values."""
    return F.map_filter(attributes, lambda k, v: k.isin(*PUBLIC_ATTRIBUTES) & v.isNotNull())
