"""Site-relative line dedup, in DataFrame functions only.

A line's ratio is the number of a host's pages that contain it, divided by the host's pages. Lines of which the ratio
exceeds a limit are boilerplate of that host and are dropped from all its pages. A line needs `least` pages (2, unless given)
to be boilerplate at all, or a host with fewer pages than 1/ratio would lose every line.

Defined results: a null text has no lines, is kept, and counts as a page; null hosts form one host; a line that occurs
several times on a page counts once for that page and is dropped at all its places; hosts with less than min_pages pages
keep all lines; lines at the very ratio stay; lines are compared after trimming blanks, empty lines are never dropped by the
ratio; repeated rows are pages of their own; an empty table gives an empty table; a page of any length is one row, of which
only the lines' 16-byte keys are counted. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked, fresh, materialize

#: Parts that a host's counts are dealt out to where they meet its total.
SPREAD = 16


def host_of(url: Column) -> Column:
    """The host of a URL in lower case: without scheme, user, port and 'www.'; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)?([^/?#:]+)", 2))
    return F.nullif(F.regexp_replace(h, r"^www\.", ""), F.lit(""))


def html_lines(html: Column) -> Column:
    """The text of HTML as lines: every tag ends a line, blanks around lines and empty lines go."""
    lines = F.transform(F.split(F.regexp_replace(html, "<[^>]*>", "\n"), "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: x != "")


def _key(line: Column) -> Column:
    """128 bits for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7919), line).alias("b"))


def _word(key: Column) -> Column:
    """The key as a string: Spark intersects arrays of strings by hash, arrays of structs by comparing all pairs."""
    return F.concat_ws("-", F.hex(key.a), F.hex(key.b))


def boilerplate(pages: DataFrame, host: Column, lines: Column, ratio: float, min_pages: int, content: Column | None = None, least: int = 2) -> DataFrame:
    """Columns host and bad: the keys of each host's boilerplate lines. A host has at most (mean lines of a page / ratio) of them, however many pages it has. With content, rows of a host with equal content are one page (null: pages of their own)."""
    keys = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: _key(F.trim(x)))
    if content is None:
        held = pages.select(host.alias("host"), F.explode(F.array_distinct(keys)).alias("key"))
        totals = pages.groupBy(host.alias("h")).agg(F.count(F.lit(1)).alias("total"))  # reads the host's column only
    else:
        each = pages.select(host.alias("host"), _key(content).alias("page"), F.array_distinct(keys).alias("keys"))  # hashed before the lines are rows
        held = each.select("host", "page", F.explode("keys").alias("key")).distinct()
        each = pages.groupBy(host.alias("h"), F.when(content.isNotNull(), _key(content)).alias("page")).agg(F.count(F.lit(1)).alias("rows"))
        totals = each.groupBy("h").agg(F.sum(F.when(F.col("page").isNull(), F.col("rows")).otherwise(1)).alias("total"))
    counts = held.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    # a host with a third of all lines meets its total in SPREAD parts
    counts = counts.withColumn("part", F.pmod("key.a", F.lit(SPREAD)))
    totals = totals.filter(F.col("total") >= min_pages).withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    over = counts.join(totals, F.col("host").eqNullSafe(F.col("h")) & (F.col("part") == F.col("p"))).filter(F.col("n") > F.lit(ratio) * F.col("total"))
    return over.groupBy("host").agg(F.collect_list(_word(F.col("key"))).alias("bad"))


def line_dedup(pages: DataFrame, host: Column, lines: Column, ratio: float = 0.1, min_pages: int = 5, out: str = "text", counts: bool = True, content: Column | None = None, least: int = 2) -> DataFrame:
    """The pages with column out: the lines that stay, joined by newlines (null where lines is null); with counts also n_lines and n_dropped.

    The boilerplate, one row per host, is written first. So Spark knows its size when it plans the join with the pages, and where it is small no page is shuffled.
    """
    mark = fresh(pages.columns, "_line_dedup")
    bad = materialize(boilerplate(pages, host, lines, ratio, min_pages, content, least), "line-boilerplate").select(F.col("host").alias(f"{mark}_h"), F.col("bad").alias(f"{mark}_bad"))
    held = pages.select("*", F.struct(host.alias("host"), lines.alias("lines")).alias(mark))
    joined = held.join(bad, F.col(f"{mark}.host").eqNullSafe(F.col(f"{mark}_h")), "left")
    all_lines, own = F.col(f"{mark}.lines"), lambda x: _word(_key(F.trim(x)))
    # the boilerplate that this page holds, then the lines that are none of it
    present = F.array_intersect(F.col(f"{mark}_bad"), F.transform(all_lines, own))
    df = joined.withColumn(f"{mark}_present", present)
    some = F.size(F.col(f"{mark}_present")) > 0  # null where the host has no boilerplate
    kept = F.when(some, F.filter(all_lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(f"{mark}_present"), own(x)))).otherwise(all_lines)
    df = df.withColumn(f"{mark}_kept", kept)
    made = {out: F.array_join(F.col(f"{mark}_kept"), "\n")}
    if counts:
        size = lambda c: F.when(all_lines.isNull(), F.lit(0).cast("long")).otherwise(F.size(c).cast("long"))
        made |= {"n_lines": size(all_lines), "n_dropped": size(all_lines) - size(F.col(f"{mark}_kept"))}
    names = [c for c in pages.columns if c not in made]
    return df.select(*(F.col(f"`{c}`") for c in names), *(e.alias(k) for k, e in made.items()))


def dedup_documents(docs: DataFrame, ratio: float = 0.1, min_pages: int = 5, least: int = 2) -> DataFrame:
    """The documents with boilerplate lines of their source taken out of the text and n_chars set anew; the columns stay as they are. Documents whose lines all go keep an empty text.

    Copies of one text count as one page, or a source's larger groups of copies would lose all their lines. An empty table gives an empty table; a null text stays null.
    """
    checked(docs, {"text": "text", "source": "source"})
    out = line_dedup(docs, F.col("source"), F.split(F.col("text"), "\n"), ratio, min_pages, counts=False, content=F.col("text"), least=least)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
