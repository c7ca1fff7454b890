"""Queries over notes and documents: parsing, predicates, sorting, tasks, sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wherry.operators import markdown as M
from wherry.operators import vault as V
from wherry.plans.book import Book
from wherry.session import table

_FRONT = "'^---\\n((?s:.*?))\\n---(?:\\n|$)'"
DOC_SQL = f"""
WITH docs AS (SELECT doc_id, text, lang, lower(trim(source)) AS source, created, modified, path, regexp_replace(text, {_FRONT}, '') AS body, regexp_extract(text, {_FRONT}, 1) AS front FROM documents WHERE text IS NOT NULL),
parts0 AS (SELECT doc_id, regexp_split_to_array(body, '(?m)^[ \\t]*(?:```|~~~)[^\\n]*$') AS p FROM docs),
parts AS (SELECT doc_id, p[i + 1] AS part, i, len(regexp_extract_all(array_to_string(p[1:i], ''), '\\n')) AS before FROM parts0, LATERAL (SELECT unnest(range(len(p))) AS i) WHERE i % 2 = 0),
lines AS (SELECT doc_id, CAST(before + j + 1 AS INTEGER) AS line_no, s[j + 1] AS line FROM (SELECT doc_id, before, string_split(part, chr(10)) AS s FROM parts), LATERAL (SELECT unnest(range(len(s))) AS j) WHERE s[j + 1] <> ''),
heads AS (SELECT doc_id, line_no, len(regexp_extract(line, '^(#{{1,6}}) +(.*?)[ \\t]*$', 1)) AS level, regexp_extract(line, '^(#{{1,6}}) +(.*?)[ \\t]*$', 2) AS heading FROM lines WHERE regexp_matches(line, '^(#{{1,6}}) +(.*?)[ \\t]*$')),
fields0 AS (SELECT doc_id, unnest(string_split(front, chr(10))) AS line FROM docs),
fields1 AS (SELECT doc_id, lower(regexp_extract(line, '^([^:]*):', 1)) AS field, trim(regexp_replace(line, '^[^:]*:', '')) AS value FROM fields0 WHERE regexp_matches(line, '^[A-Za-z_][A-Za-z0-9_ -]*:')),
fields AS (SELECT *, CASE WHEN value = '' OR lower(value) = 'null' THEN 'null' WHEN regexp_matches(value, '^\\[.*\\]$') AND NOT regexp_matches(value, '^\\[\\[') THEN 'array' WHEN regexp_matches(value, '^"?\\[\\[.*\\]\\]"?$') THEN 'wikilink'
  WHEN regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'date' WHEN regexp_matches(value, '^-?\\d+(\\.\\d+)?$') THEN 'number' WHEN lower(value) IN ('true', 'false') THEN 'boolean' ELSE 'string' END AS kind FROM fields1),
tags AS (SELECT DISTINCT doc_id, regexp_replace(trim(t), '^["#]+|"+$', '', 'g') AS tag FROM (SELECT doc_id, unnest(string_split(regexp_extract(front, '(?m)^tags:[ \\t]*\\[?([^\\]\\n]*)\\]?[ \\t]*$', 1), ',')) AS t FROM docs) WHERE trim(t) <> '')
"""
book = Book(DOC_SQL)
add = book.add


def docs(spark, d, *cols):
    """Documents with a text, sources folded."""
    t = table(spark, d, "documents").select("doc_id", *cols).where(F.col("text").isNotNull() if "text" in cols else F.lit(True))
    return t.withColumn("source", F.lower(F.trim("source"))) if "source" in cols else t


def lines(spark, d, keep=None):
    """Prose lines of the documents' bodies; with ``keep`` only those that pass it become rows."""
    return M.prose_lines(docs(spark, d, "text"), "doc_id", M.body(F.col("text")), keep)


_LINK = "'\\[\\[([^\\]|#\\n]+)(?:#[^\\]|\\n]*)?(?:\\|([^\\]\\n]+))?\\]\\]'"


@add(f"SELECT doc_id, line_no, trim(regexp_extract(m, {_LINK}, 1)) AS target, CASE WHEN regexp_extract(m, {_LINK}, 2) <> '' THEN trim(regexp_extract(m, {_LINK}, 2)) END AS alias FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(regexp_replace(line, '`[^`]*`', '', 'g'), {_LINK}, 0)) AS m FROM lines)")
def scan_wikilinks(spark, d):
    """Links in the prose of documents, with line and alias."""
    return M.wikilinks(lines(spark, d, lambda x: F.contains(x, F.lit("[["))), "doc_id")


@add("SELECT doc_id, tag FROM tags UNION SELECT doc_id, unnest(regexp_extract_all(regexp_replace(line, '`[^`]*`', '', 'g'), '(?:^|[ \\t(])#([A-Za-z][A-Za-z0-9_/-]*)', 1)) FROM lines")
def scan_tags(spark, d):
    """Tags of documents from frontmatter and prose."""
    return M.front_tags(docs(spark, d, "text"), "doc_id", F.col("text")).union(M.inline_tags(lines(spark, d, lambda x: F.contains(x, F.lit("#"))), "doc_id")).distinct()


@add("SELECT doc_id, line_no, CAST(level AS INTEGER) AS level, heading FROM heads")
def scan_headings(spark, d):
    """Headings of documents."""
    return M.headings(lines(spark, d, lambda x: x.rlike(M.HEADING)), "doc_id")


@add("""SELECT doc_id, line_no, CASE WHEN mark = 'x' THEN 'completed' WHEN mark = '-' THEN 'cancelled' ELSE 'open' END AS status, trim(t) AS task, nullif(due, '') AS due, context FROM (
SELECT doc_id, line_no, lower(regexp_extract(line, '^[ \\t]*[-*+] \\[([ xX-])\\] (.*)$', 1)) AS mark, regexp_extract(line, '^[ \\t]*[-*+] \\[([ xX-])\\] (.*)$', 2) AS t, regexp_extract(line, '(\\d{4}-\\d{2}-\\d{2})', 1) AS due,
last_value(CASE WHEN regexp_matches(line, '^(#{1,6}) +(.*?)[ \\t]*$') THEN regexp_extract(line, '^(#{1,6}) +(.*?)[ \\t]*$', 2) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS context, line FROM lines)
WHERE regexp_matches(line, '^[ \\t]*[-*+] \\[([ xX-])\\] (.*)$')""")
def scan_tasks(spark, d):
    """Tasks of documents with status, due date and heading."""
    return M.tasks(lines(spark, d, lambda x: x.rlike(M.TASK) | x.rlike(M.HEADING)), "doc_id")


@add("""SELECT doc_id, due, status, count(*) AS n FROM (SELECT doc_id, CASE WHEN mark = 'x' THEN 'completed' WHEN mark = '-' THEN 'cancelled' ELSE 'open' END AS status, due FROM (
SELECT doc_id, lower(regexp_extract(line, '^[ \\t]*[-*+] \\[([ xX-])\\] (.*)$', 1)) AS mark, nullif(regexp_extract(line, '(\\d{4}-\\d{2}-\\d{2})', 1), '') AS due FROM lines WHERE regexp_matches(line, '^[ \\t]*[-*+] \\[([ xX-])\\] (.*)$'))) WHERE due IS NOT NULL GROUP BY 1, 2, 3""")
def filter_tasks_due(spark, d):
    """Tasks with a due date by document, date and status."""
    return M.tasks(lines(spark, d, lambda x: x.rlike(M.TASK) | x.rlike(M.HEADING)), "doc_id").where("due is not null").groupBy("doc_id", "due", "status").agg(F.count(F.lit(1)).alias("n"))


@add("""SELECT doc_id, CAST(row_number() OVER w AS INTEGER) AS ord, CAST(level AS INTEGER) AS level, heading, line_no AS line_start,
(SELECT min(x.line_no) FROM heads x WHERE x.doc_id = heads.doc_id AND x.line_no > heads.line_no AND x.level <= heads.level) AS next_same,
(SELECT CAST(count(*) AS INTEGER) FROM heads y WHERE y.doc_id = heads.doc_id AND y.line_no <= (SELECT max(x.line_no) FROM heads x WHERE x.doc_id = heads.doc_id AND x.line_no < heads.line_no AND x.level < heads.level)) AS p
FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""")
def scan_sections(spark, d):
    """Sections of documents with their end and parent."""
    s = M.sections(lines(spark, d), "doc_id")
    return s.select("doc_id", "ord", "level", "heading", "line_start", "next_same", F.coalesce("parent_ord", F.lit(0)).alias("p"))


@add("SELECT doc_id, heading FROM heads WHERE regexp_matches(heading, '(?i)^(next steps|decision|status)')")
def filter_headings_like(spark, d):
    """Documents with headings that match a pattern."""
    return M.headings(lines(spark, d, lambda x: x.rlike(M.HEADING)), "doc_id").where(F.col("heading").rlike("(?i)^(next steps|decision|status)")).select("doc_id", "heading")


@add("SELECT doc_id, field, value, kind FROM fields")
def scan_frontmatter(spark, d):
    """Frontmatter fields of documents with their kinds."""
    return M.fields(docs(spark, d, "text"), "doc_id", F.col("text"))


@add("SELECT doc_id, CASE WHEN len(body) <= 300 THEN body ELSE regexp_replace(substr(body, 1, 300), '\\s\\S*$', '') END AS preview, substr(sha256(text), 1, 16) AS hash, CAST(ceil(len(text) / 4.0) AS BIGINT) AS n_tokens FROM docs")
def scan_preview_hash(spark, d):
    """Preview, content hash and estimated tokens of documents."""
    b = M.body(F.col("text"))
    return docs(spark, d, "text").select("doc_id", M.preview(b).alias("preview"), F.substring(F.sha2("text", 256), 1, 16).alias("hash"), F.ceil(F.length("text") / 4).cast("long").alias("n_tokens"))


@add("SELECT doc_id FROM docs WHERE doc_id IN (SELECT doc_id FROM fields WHERE field = 'status' AND lower(value) = 'draft') AND doc_id IN (SELECT doc_id FROM tags WHERE lower(tag) IN ('meeting', 'project', 'review')) AND NOT doc_id IN (SELECT doc_id FROM tags WHERE lower(tag) = 'import')")
def filter_frontmatter_tags(spark, d):
    """Documents by field value, any of several tags, and the absence of one, without regard to case. One pass over expressions, no join."""
    t = docs(spark, d, "text")
    status = F.lower(F.trim(F.regexp_extract(M.front(F.col("text")), r"(?mi)^status:(.*)$", 1)))
    raw = F.regexp_extract(M.front(F.col("text")), r"(?m)^tags:[ \t]*\[?([^\]\n]*)\]?[ \t]*$", 1)
    tags = F.transform(F.split(F.lower(raw), ","), lambda x: F.regexp_replace(F.trim(x), r'^["#]+|"+$', ""))
    hit = (status == "draft") & F.arrays_overlap(tags, F.array(*[F.lit(x) for x in ("meeting", "project", "review")])) & ~F.array_contains(tags, "import")
    return t.where(hit).select("doc_id")


@add("SELECT doc_id FROM tags GROUP BY 1 HAVING count(*) FILTER (WHERE tag IN ('meeting', 'project')) = 2")
def filter_all_tags(spark, d):
    """Documents with all of several tags."""
    return M.front_tags(docs(spark, d, "text"), "doc_id", F.col("text")).where(F.col("tag").isin("meeting", "project")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("doc_id")


@add("SELECT doc_id, path FROM docs WHERE starts_with(path, 'meeting-vault/') AND modified >= TIMESTAMP '2025-01-01' AND modified < TIMESTAMP '2025-07-01' ORDER BY coalesce(created, modified) DESC, path LIMIT 20")
def filter_folder_window_top(spark, d):
    """The newest 20 documents of a folder in a span of time (a page of a listing)."""
    t = docs(spark, d, "path", "created", "modified", "text").where(F.startswith("path", F.lit("meeting-vault/")) & (F.col("modified") >= F.lit("2025-01-01").cast("timestamp_ntz")) & (F.col("modified") < F.lit("2025-07-01").cast("timestamp_ntz")))
    return t.orderBy(F.desc(F.coalesce("created", "modified")), "path").limit(20).select("doc_id", "path")


@add("SELECT k, path, title FROM (SELECT *, row_number() OVER (ORDER BY lower(title), k) AS rn FROM (SELECT * FROM vault_notes WHERE contains(lower(title), 'ledger'))) WHERE rn > 10 AND rn <= 35")
def filter_title_page(spark, d):
    """A page of the notes whose title has a word, by title."""
    n = V.notes(spark, d).where(F.contains(F.lower("title"), F.lit("ledger")))
    return n.orderBy(F.lower("title"), "k").offset(10).limit(25).select("k", "path", "title")


book.sql["filter_title_page"] = V.VAULT_SQL + ", vault_notes AS (SELECT * FROM notes)\n" + "SELECT k, path, title FROM (SELECT *, row_number() OVER (ORDER BY lower(title), k) AS rn FROM (SELECT * FROM vault_notes WHERE contains(lower(title), 'ledger'))) WHERE rn > 10 AND rn <= 35"


@add(V.VAULT_SQL + "SELECT regexp_matches(stem, '^\\d{4}-\\d{2}-\\d{2}$') OR regexp_matches(stem, '^\\d{4}-W\\d{2}$') OR top IN ('daily', 'weekly', 'monthly', 'quarterly', 'yearly', 'journal', 'periodic-notes') AS periodic, top = 'templates' AS template, count(*) AS n_notes FROM (SELECT regexp_extract(k, '[^/]*$') AS stem, top FROM notes) GROUP BY 1, 2", common=False)
def filter_periodic_template(spark, d):
    """Notes by whether they are periodic notes or templates."""
    n = V.notes(spark, d).withColumn("stem", F.element_at(F.split("k", "/"), -1))
    periodic = F.col("stem").rlike(r"^\d{4}-\d{2}-\d{2}$") | F.col("stem").rlike(r"^\d{4}-W\d{2}$") | F.col("top").isin("daily", "weekly", "monthly", "quarterly", "yearly", "journal", "periodic-notes")
    return n.groupBy(periodic.alias("periodic"), (F.col("top") == "templates").alias("template")).agg(F.count(F.lit(1)).alias("n_notes"))


@add("SELECT source, doc_id, rn AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY modified DESC, doc_id) AS rn FROM docs) WHERE rn <= 3")
def window_newest_per_source(spark, d):
    """The three newest documents of each source."""
    w = Window.partitionBy("source").orderBy(F.desc("modified"), "doc_id")
    return docs(spark, d, "source", "modified", "text").drop("text").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("source", "doc_id", "rank")


@add("SELECT doc_id, count(*) AS n_lines, CAST(sum(len(line)) AS BIGINT) AS n_chars, count(*) FILTER (WHERE regexp_matches(line, '^[ \\t]*[-*+] ')) AS n_items, count(*) FILTER (WHERE starts_with(line, '|')) AS n_rows FROM lines GROUP BY 1")
def scan_structure(spark, d):
    """Line, list and table counts of documents. The lines stay where they are; only counts are shuffled."""
    return lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.count_if(F.col("line").rlike(r"^[ \t]*[-*+] ")).alias("n_items"), F.count_if(F.startswith("line", F.lit("|"))).alias("n_rows"))


@add("""WITH f AS (SELECT doc_id, path, modified, lower(regexp_extract(regexp_replace(path, '(?i)\\.md$', ''), '[^/]*$')) AS title FROM docs WHERE starts_with(path, 'meeting') AND modified >= TIMESTAMP '2024-03-01' AND modified < TIMESTAMP '2026-01-01' AND doc_id IN (SELECT doc_id FROM fields WHERE field = 'status' AND lower(value) IN ('draft', 'active'))
AND doc_id IN (SELECT doc_id FROM tags WHERE tag IN ('meeting', 'project', 'session', 'review')) AND contains(lower(path), 'e')) SELECT doc_id, path, row_number() OVER (ORDER BY modified DESC, path, doc_id) AS rank, count(*) OVER () AS total FROM f ORDER BY modified DESC, path, doc_id LIMIT 10 OFFSET 2""")
def filter_find_notes(spark, d):
    """A page of a combined search: folder, frontmatter, any of several tags, title, span of time, order, with the total. One pass over expressions; only the page and its order are shuffled."""
    t = docs(spark, d, "path", "modified", "text")
    status = F.lower(F.trim(F.regexp_extract(M.front(F.col("text")), r"(?mi)^status:(.*)$", 1)))
    raw = F.regexp_extract(M.front(F.col("text")), r"(?m)^tags:[ \t]*\[?([^\]\n]*)\]?[ \t]*$", 1)
    tags = F.transform(F.split(raw, ","), lambda x: F.regexp_replace(F.trim(x), r'^["#]+|"+$', ""))
    span = (F.col("modified") >= F.lit("2024-03-01").cast("timestamp_ntz")) & (F.col("modified") < F.lit("2026-01-01").cast("timestamp_ntz"))
    hit = F.startswith("path", F.lit("meeting")) & span & status.isin("draft", "active") & F.arrays_overlap(tags, F.array(*[F.lit(x) for x in ("meeting", "project", "session", "review")])) & F.contains(F.lower("path"), F.lit("e"))
    f = t.where(hit).select("doc_id", "path", "modified")
    total = f.agg(F.count(F.lit(1)).alias("total"))
    order = [F.desc("modified"), "path", "doc_id"]
    page = f.orderBy(*order).limit(12).withColumn("rank", F.row_number().over(Window.orderBy(*order))).where("rank > 2")
    return page.crossJoin(F.broadcast(total)).select("doc_id", "path", "rank", "total")  # one row is broadcast


QUERIES, SQL = book.queries, book.sql
