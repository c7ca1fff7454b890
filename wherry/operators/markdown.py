"""Markdown into links, tags, headings, tasks, sections and frontmatter, by column expressions over whole texts; no text is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FENCE = r"(?m)^[ \t]*(?:```|~~~)[^\n]*$"
LINK = r"\[\[([^\]|#\n]+)(?:#[^\]|\n]*)?(?:\|([^\]\n]+))?\]\]"
TAG = r"(?:^|[ \t(])#([A-Za-z][A-Za-z0-9_/-]*)"
TASK = r"^[ \t]*[-*+] \[([ xX-])\] (.*)$"
HEADING = r"^(#{1,6}) +(.*?)[ \t]*$"
FRONT = r"^---\n((?s:.*?))\n---(?:\n|$)"


def body(text: Column) -> Column:
    """Text without its frontmatter."""
    return F.regexp_replace(text, FRONT, "")


def front(text: Column) -> Column:
    """Frontmatter without its fences; empty if there is none."""
    return F.regexp_extract(text, FRONT, 1)


def prose_lines(df: DataFrame, key: str, text: Column, keep=None) -> DataFrame:
    """``key, line_no, line`` (from 1) outside fenced code. Odd parts between fences are code; they only count their lines. ``keep`` is a test on a line: others never become rows."""
    x = df.select(key, F.split(text, FENCE).alias("parts"))
    # lines before each part, by a running count over the parts; then the lines that count, all inside the row of the text
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate("parts", zero, lambda s, p: F.struct((s["at"] + F.regexp_count(p, F.lit("\n"))).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")), lambda s: s["starts"])
    prose = F.filter(F.transform(F.arrays_zip(F.col("parts").alias("part"), starts.alias("start")), lambda s, i: F.struct(i.alias("i"), s["part"].alias("part"), s["start"].alias("start"))), lambda s: s["i"] % 2 == 0)
    test = (lambda v: (v != "") & keep(v)) if keep else (lambda v: v != "")
    rows = lambda s: F.filter(F.transform(F.split(s["part"], "\n"), lambda v, j: F.struct((s["start"] + j + 1).cast("int").alias("line_no"), v.alias("line"))), lambda r: test(r["line"]))
    return x.select(key, F.inline(F.flatten(F.transform(prose, rows))))


def wikilinks(lines: DataFrame, key: str) -> DataFrame:
    """``key, line_no, target, alias`` of every link in prose; code spans hold none."""
    plain = F.regexp_replace("line", "`[^`]*`", "")
    whole = F.regexp_extract_all(plain, F.lit("(" + LINK + ")"), 1)
    x = lines.where(F.contains("line", F.lit("[["))).select(key, "line_no", F.explode(whole).alias("m"))
    alias = F.regexp_extract("m", LINK, 2)
    return x.select(key, "line_no", F.trim(F.regexp_extract("m", LINK, 1)).alias("target"), F.when(alias != "", F.trim(alias)).alias("alias"))


def inline_tags(lines: DataFrame, key: str) -> DataFrame:
    """``key, tag`` of tags in prose, once per text."""
    plain = F.regexp_replace("line", "`[^`]*`", "")
    return lines.where(F.contains("line", F.lit("#"))).select(key, F.explode(F.regexp_extract_all(plain, F.lit(TAG), 1)).alias("tag")).distinct()


def front_tags(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, tag`` of the frontmatter's ``tags`` (array or single), without ``#``."""
    raw = F.regexp_extract(front(text), r"(?m)^tags:[ \t]*\[?([^\]\n]*)\]?[ \t]*$", 1)
    tag = F.regexp_replace(F.trim(F.col("t")), r'^["#]+|"+$', "")
    return df.select(key, F.explode(F.split(raw, ",")).alias("t")).select(key, tag.alias("tag")).where("tag <> ''").distinct()


def headings(lines: DataFrame, key: str) -> DataFrame:
    """``key, line_no, level, heading``."""
    return lines.where(F.col("line").rlike(HEADING)).select(key, "line_no", F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.regexp_extract("line", HEADING, 2).alias("heading"))


def tasks(lines: DataFrame, key: str) -> DataFrame:
    """``key, line_no, status, task, due, context``: tasks with their due date and the heading above. Only headings and tasks are shuffled."""
    kept = lines.where(F.col("line").rlike(TASK) | F.col("line").rlike(HEADING))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.when(F.col("line").rlike(HEADING), F.regexp_extract("line", HEADING, 2))
    mark = F.lower(F.regexp_extract("line", TASK, 1))
    due = F.regexp_extract("line", r"(\d{4}-\d{2}-\d{2})", 1)
    out = kept.withColumn("context", F.last(head, ignorenulls=True).over(w)).where(F.col("line").rlike(TASK))
    return out.select(key, "line_no", F.when(mark == "x", "completed").when(mark == "-", "cancelled").otherwise("open").alias("status"), F.trim(F.regexp_extract("line", TASK, 2)).alias("task"), F.when(due != "", due).alias("due"), "context")


def sections(lines: DataFrame, key: str) -> DataFrame:
    """``key, ord, level, heading, line_start, next_same, parent_ord``: headings with where their section ends and the section they stand in."""
    h = headings(lines, key)
    w = Window.partitionBy(key).orderBy("line_no")
    h = h.withColumn("ord", F.row_number().over(w))
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    below = w.rowsBetween(1, Window.unboundedFollowing)
    # per level 1..6 the last heading before and the first after; the parent is the last of a smaller level, the end the first of one not greater
    parent = F.greatest(*[F.when(F.lit(n) < F.col("level"), F.max(F.when(F.col("level") == n, F.col("ord"))).over(above)) for n in range(1, 7)])
    end = F.least(*[F.when(F.lit(n) <= F.col("level"), F.min(F.when(F.col("level") == n, F.col("line_no"))).over(below)) for n in range(1, 7)])
    return h.select(key, "ord", "level", "heading", F.col("line_no").alias("line_start"), end.alias("next_same"), parent.alias("parent_ord"))


def fields(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, field, value, kind``: simple frontmatter fields; ``kind`` is null, array, wikilink, date, number, boolean or string."""
    f = df.select(key, F.explode(F.split(front(text), "\n")).alias("line")).where(F.col("line").rlike(r"^[A-Za-z_][A-Za-z0-9_ -]*:"))
    value = F.trim(F.regexp_replace("line", r"^[^:]*:", ""))
    f = f.select(key, F.lower(F.regexp_extract("line", r"^([^:]*):", 1)).alias("field"), value.alias("value"))
    return f.withColumn("kind", kind_of(F.col("value")))


def kind_of(v: Column) -> Column:
    """Type of a frontmatter value by its form."""
    return (
        F.when((v == "") | (F.lower(v) == "null"), "null")
        .when(v.rlike(r"^\[.*\]$") & ~v.rlike(r"^\[\["), "array")
        .when(v.rlike(r'^"?\[\[.*\]\]"?$'), "wikilink")
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), "date")
        .when(v.rlike(r"^-?\d+(\.\d+)?$"), "number")
        .when(F.lower(v).isin("true", "false"), "boolean")
        .otherwise("string")
    )


def preview(text: Column, most: int = 300) -> Column:
    """The text's first characters, cut at white space; a text within the limit as it is."""
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.substring(text, 1, most), r"\s\S*\z", ""))
