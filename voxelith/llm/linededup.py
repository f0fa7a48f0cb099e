"""Line dedup by site-relative frequency.

A line is boilerplate of a host if more than `ratio` of the host's pages have it, and at least
`min_pages` do.  Boilerplate lines are dropped from every page of the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A line of a site's frame is on most of its pages, one that pages happen to share on few: 8 % is far
#: from both on the given tables (README).
RATIO = 0.08
#: The least number of pages that makes a repeat: a line on two pages of a small host may be a quotation
#: or one page under two addresses.  On hosts of 25 pages or more the ratio alone decides.
MIN_PAGES = 3
#: White space at a line's ends: space and U+0009 to U+000D.
ENDS = " \t\n\x0b\x0c\r"


def url_host(url: Column) -> Column:
    """The lower-case host of a URL, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, ends: str = ENDS) -> DataFrame:
    """pages(host, text) -> (host, lines): each host's boilerplate lines by 64-bit hash, hosts that
    have none left out.

    A page counts once for a line, however often it has it.  Lines are compared without the
    characters `ends` at their ends; blank lines are never boilerplate.  A host has at most its mean number of
    lines a page, divided by ratio, of such lines, so the arrays do not grow with the pages."""
    totals = pages.groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("n_pages"))
    each = pages.select("host", F.explode(F.array_distinct(F.transform(_lines("text"), lambda x: F.trim(x, F.lit(ends))))).alias("line")).where("line <> ''")
    counts = each.groupBy("host", F.xxhash64("line").alias("line")).agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    found = counts.join(totals, F.col("host").eqNullSafe(F.col("_host"))).where(F.col("n") > ratio * F.col("n_pages"))
    return found.groupBy("host").agg(F.collect_list("line").alias("lines"))


def line_dedup(docs: DataFrame, host: Column | str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, ends: str = ENDS, counts: bool = True) -> DataFrame:
    """docs with boilerplate lines dropped from `text`, all other columns as they were, and, if counts
    are wanted, the columns n_lines and n_dropped after them.

    A null host is a host like any other.  A null text stays null, with no lines; an empty text has
    one empty line.  No row is dropped, even if no line remains: its text is then empty.  Repeated
    rows count as pages each.  An empty table gives an empty table.  With counts, the input's columns
    named n_lines or n_dropped are replaced; no other name can clash."""
    host = F.col(host) if isinstance(host, str) else host
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), host.alias("host"), F.col(text).alias("text"))
    found = materialize(boilerplate(held.select("host", "text"), ratio, min_pages, ends), "boilerplate").withColumnRenamed("host", "_host")
    both = held.join(found, F.col("host").eqNullSafe(F.col("_host")), "left")
    all_lines = _lines(F.col("text"))
    bad = lambda x: F.array_contains(F.col("lines"), F.xxhash64(F.trim(x, F.lit(ends))))
    plain = F.col("lines").isNull() | F.col("text").isNull()
    kept = F.when(plain, F.col("text")).otherwise(F.array_join(F.filter(all_lines, lambda x: ~bad(x)), "\n"))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(all_lines)).cast("long")
    dropped = F.when(plain, F.lit(0)).otherwise(F.size(F.filter(all_lines, bad))).cast("long")
    # One struct, so that no name of the input's columns meets those used here.
    out = both.select("_row", F.struct(kept.alias("text"), n.alias("n_lines"), dropped.alias("n_dropped")).alias("_out"))
    new = ("n_lines", "n_dropped") if counts else ()
    cols = [F.col("_out.text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in new]
    return out.select(*cols, *[F.col(f"_out.{c}").alias(c) for c in new])
