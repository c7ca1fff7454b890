"""Schema inference, validation and migration over the documents' frontmatter."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wherry.functions.exprs import reading_minutes, word_count
from wherry.operators import markdown as M
from wherry.plans.book import Book
from wherry.plans.notes import DOC_SQL, docs, lines

book = Book(DOC_SQL)
add = book.add


def fields(spark, d):
    """Frontmatter fields with the document's source."""
    t = docs(spark, d, "source", "text")
    return M.fields(t, "doc_id", F.col("text")).join(t.select("doc_id", "source"), "doc_id")


def items(f):
    """Field values with arrays taken apart."""
    v = F.explode(F.when(F.col("kind") == "array", F.split(F.regexp_replace("value", r"^\[|\]$", ""), r",\s*")).otherwise(F.array("value"))).alias("item")
    return f.select("doc_id", "field", v).select("doc_id", "field", F.regexp_replace(F.trim("item"), r'^"|"$', "").alias("item")).where("item <> ''")


_ITEMS = """items AS (SELECT doc_id, field, regexp_replace(trim(item), '^"|"$', '', 'g') AS item FROM (SELECT doc_id, field, unnest(CASE WHEN kind = 'array' THEN regexp_split_to_array(regexp_replace(value, '^\\[|\\]$', '', 'g'), ',\\s*') ELSE [value] END) AS item FROM fields) WHERE regexp_replace(trim(item), '^"|"$', '', 'g') <> '')"""


@add("SELECT field, count(*) AS n, count(DISTINCT doc_id) AS n_docs, count(DISTINCT kind) AS n_kinds, list_sort(list(DISTINCT kind)) AS kinds FROM fields GROUP BY 1")
def schema_overview(spark, d):
    """Fields with their counts and kinds."""
    f = M.fields(docs(spark, d, "text"), "doc_id", F.col("text"))
    return f.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("kind").alias("n_kinds"), F.sort_array(F.collect_set("kind")).alias("kinds"))


@add(f"WITH {_ITEMS} SELECT field, item, count(*) AS n FROM items WHERE field IN ('tags', 'status', 'type') GROUP BY 1, 2")
def schema_values(spark, d):
    """Values of some fields and how often they stand, arrays taken apart."""
    return items(M.fields(docs(spark, d, "text"), "doc_id", F.col("text"))).where(F.col("field").isin("tags", "status", "type")).groupBy("field", "item").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT field, kind, count(*) AS n FROM fields WHERE field IN (SELECT field FROM fields GROUP BY 1 HAVING count(DISTINCT kind) > 1) GROUP BY 1, 2")
def schema_inconsistent(spark, d):
    """Fields of more than one kind, with the count of each."""
    g = M.fields(docs(spark, d, "text"), "doc_id", F.col("text")).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("field"))).where("k > 1").drop("k")


_RULES = [("status", "string", True), ("type", "string", True), ("tags", "array", False), ("owner", "wikilink", False)]


@add("""WITH rules(field, kind, required) AS (VALUES ('status', 'string', true), ('type', 'string', true), ('tags', 'array', false), ('owner', 'wikilink', false)), fd AS (SELECT DISTINCT doc_id FROM fields),
one AS (SELECT doc_id, field, min(kind) AS kind, min(value) AS value FROM fields GROUP BY 1, 2), j AS (SELECT fd.doc_id, r.field, CASE WHEN o.field IS NULL AND r.required THEN 'missing' WHEN o.field IS NOT NULL AND o.kind <> r.kind THEN 'wrong_type' WHEN r.field = 'status' AND o.value NOT IN ('draft', 'active', 'done') THEN 'invalid_value' END AS problem FROM fd CROSS JOIN rules r LEFT JOIN one o ON o.doc_id = fd.doc_id AND o.field = r.field)
SELECT doc_id, field, problem FROM j WHERE problem IS NOT NULL""")
def schema_validate(spark, d):
    """Documents with frontmatter against a schema. One row per document with its fields as a map, the rules as expressions; no cross join."""
    f = M.fields(docs(spark, d, "text"), "doc_id", F.col("text")).groupBy("doc_id", "field").agg(F.min("kind").alias("kind"), F.min("value").alias("value"))
    m = f.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("kind", "value")))).alias("m"))
    checks = []
    for name, kind, required in _RULES:
        x = F.col("m")[name]
        p = F.when(x.isNull(), F.lit("missing") if required else F.lit(None)).when(x["kind"] != kind, "wrong_type")
        if name == "status":
            p = p.when(~x["value"].isin("draft", "active", "done"), "invalid_value")
        checks.append(F.struct(F.lit(name).alias("field"), p.alias("problem")))
    return m.select("doc_id", F.explode(F.array(*checks)).alias("x")).select("doc_id", "x.field", "x.problem").where("problem is not null")


@add("""WITH nd AS (SELECT source, count(*) AS n_docs FROM docs GROUP BY 1), f AS (SELECT source, field, kind, value, fields.doc_id FROM fields JOIN docs ON docs.doc_id = fields.doc_id),
k AS (SELECT source, field, kind, count(*) AS n FROM f GROUP BY 1, 2, 3), m AS (SELECT source, field, max(n) AS n_modal, min(kind) FILTER (WHERE n = mx) AS kind FROM (SELECT *, max(n) OVER (PARTITION BY source, field) AS mx FROM k) GROUP BY 1, 2),
g AS (SELECT source, field, count(DISTINCT doc_id) AS n_with, count(*) AS n, count(DISTINCT value) AS n_values FROM f GROUP BY 1, 2)
SELECT source, field, m.kind, round(n_with * 1.0 / n_docs, 6) AS frequency, round((n_with * 1.0 / n_docs) * (n_modal * 1.0 / n), 6) AS confidence, n_with * 1.0 / n_docs >= 0.9 AS required, n_values <= 20 AND n_values < 0.5 * n AS enumerable FROM g JOIN m USING (source, field) JOIN nd USING (source) WHERE n_with * 1.0 / n_docs >= 0.05""")
def schema_conventions(spark, d):
    """What each source's documents usually have: fields, kinds, whether required or one of a few values."""
    t = docs(spark, d, "source", "text")
    n = t.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    f = fields(spark, d)
    k = f.groupBy("source", "field", "kind").agg(F.count(F.lit(1)).alias("n"))
    top = k.groupBy("source", "field").agg(F.max(F.struct("n")).alias("mx"))
    m = k.join(top, ["source", "field"]).where(F.col("n") == F.col("mx.n")).groupBy("source", "field").agg(F.min("kind").alias("kind"), F.max("n").alias("n_modal"))
    g = f.groupBy("source", "field").agg(F.countDistinct("doc_id").alias("n_with"), F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))
    freq = F.col("n_with") / F.col("n_docs")
    return g.join(m, ["source", "field"]).join(n, "source").where(freq >= 0.05).select("source", "field", "kind", F.round(freq, 6).alias("frequency"), F.round(freq * (F.col("n_modal") / F.col("n")), 6).alias("confidence"), (freq >= 0.9).alias("required"), ((F.col("n_values") <= 20) & (F.col("n_values") < 0.5 * F.col("n"))).alias("enumerable"))


@add("SELECT source, round(avg(CASE WHEN regexp_matches(path, '/\\d{4}-\\d{2}-\\d{2}') THEN 1.0 ELSE 0.0 END), 6) AS dated, round(avg(CASE WHEN regexp_matches(path, '/[A-Z]+-\\d+') THEN 1.0 ELSE 0.0 END), 6) AS prefixed, round(avg(CASE WHEN regexp_matches(path, '/\\d+\\.md$') THEN 1.0 ELSE 0.0 END), 6) AS numbered FROM docs GROUP BY 1")
def schema_naming(spark, d):
    """Naming patterns of the sources' files."""
    t = docs(spark, d, "source", "path", "text")
    share = lambda p: F.round(F.avg(F.when(F.col("path").rlike(p), 1.0).otherwise(0.0)), 6)
    return t.groupBy("source").agg(share(r"/\d{4}-\d{2}-\d{2}").alias("dated"), share(r"/[A-Z]+-\d+").alias("prefixed"), share(r"/\d+\.md$").alias("numbered"))


@add("WITH n AS (SELECT doc_id, count(DISTINCT field) FILTER (WHERE field IN ('tags', 'status', 'type', 'owner') AND value <> '') AS n FROM fields GROUP BY 1) SELECT doc_id, round(n / 4.0, 4) AS completeness FROM n WHERE n < 4")
def schema_incomplete(spark, d):
    """Documents with frontmatter that lack expected fields."""
    want = ["tags", "status", "type", "owner"]
    f = M.fields(docs(spark, d, "text"), "doc_id", F.col("text"))
    return f.groupBy("doc_id").agg(F.countDistinct(F.when(F.col("field").isin(*want) & (F.col("value") != ""), F.col("field"))).alias("n")).where("n < 4").select("doc_id", F.round(F.col("n") / 4.0, 4).alias("completeness"))


@add(f"WITH {_ITEMS}, o AS (SELECT doc_id, item AS owner FROM items WHERE field = 'owner'), s AS (SELECT owner, field, count(DISTINCT item) AS n_values FROM o JOIN items USING (doc_id) WHERE field IN ('status', 'type') GROUP BY 1, 2) SELECT owner, field, n_values FROM s WHERE n_values >= 2")
def schema_contradictions(spark, d):
    """Entities whose notes disagree about a field."""
    i = items(M.fields(docs(spark, d, "text"), "doc_id", F.col("text")))
    o = i.where("field = 'owner'").select("doc_id", F.col("item").alias("owner"))
    return o.join(i.where(F.col("field").isin("status", "type")), "doc_id").groupBy("owner", "field").agg(F.countDistinct("item").alias("n_values")).where("n_values >= 2")


@add("SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS n_words, CAST(ceil(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) / 200.0) AS BIGINT) AS minutes, len(regexp_extract_all(text, '\\[\\[')) AS n_links, CAST(modified AS DATE) - CAST(created AS DATE) AS n_days FROM docs")
def schema_computed(spark, d):
    """Computed fields of documents: words, reading time, links, days between creation and change."""
    t = docs(spark, d, "text", "created", "modified")
    w = F.regexp_count("text", F.lit(r"[^ \t\n\r\f]+"))
    return t.select("doc_id", w.alias("n_words"), reading_minutes(w).alias("minutes"), F.regexp_count("text", F.lit(r"\[\[")).alias("n_links"), F.datediff("modified", "created").alias("n_days"))


@add("SELECT doc_id, line_no, lower(regexp_extract(line, '^[-* ]*\\**([A-Z][A-Za-z ]{1,20})\\**: +(\\S.*)$', 1)) AS field, regexp_extract(line, '^[-* ]*\\**([A-Z][A-Za-z ]{1,20})\\**: +(\\S.*)$', 2) AS value FROM lines WHERE regexp_matches(line, '^[-* ]*\\**([A-Z][A-Za-z ]{1,20})\\**: +(\\S.*)$')")
def schema_prose_fields(spark, d):
    """``Key: value`` lines in prose that could be fields."""
    p = r"^[-* ]*\**([A-Z][A-Za-z ]{1,20})\**: +(\S.*)$"
    return lines(spark, d).where(F.col("line").rlike(p)).select("doc_id", "line_no", F.lower(F.regexp_extract("line", p, 1)).alias("field"), F.regexp_extract("line", p, 2).alias("value"))


@add("SELECT doc_id, CASE WHEN has_new THEN 'conflict' ELSE 'renamed' END AS outcome, CASE WHEN has_new THEN text ELSE regexp_replace(text, '(?m)^status:', 'state:') END AS text FROM (SELECT doc_id, text, regexp_matches(front, '(?m)^state:') AS has_new FROM docs WHERE regexp_matches(front, '(?m)^status:'))")
def mutate_rename_field(spark, d):
    """The field ``status`` renamed to ``state`` in every document that has it and not the new one; the outcome tells conflicts."""
    t = docs(spark, d, "text").where(M.front(F.col("text")).rlike("(?m)^status:"))
    clash = M.front(F.col("text")).rlike("(?m)^state:")
    first = F.concat(F.regexp_extract("text", r"(?s)^(.*?\n)status:.*$", 1), F.lit("state:"), F.regexp_extract("text", r"(?s)^.*?\nstatus:(.*)$", 1))
    return t.select("doc_id", F.when(clash, "conflict").otherwise("renamed").alias("outcome"), F.when(clash, F.col("text")).otherwise(first).alias("text"))


@add("SELECT doc_id, value AS before, CASE lower(value) WHEN 'draft' THEN 'open' WHEN 'on hold' THEN 'paused' ELSE value END AS after FROM fields WHERE field = 'status' AND lower(value) IN ('draft', 'on hold')")
def mutate_values(spark, d):
    """Values of a field replaced by a map, before and after."""
    f = M.fields(docs(spark, d, "text"), "doc_id", F.col("text")).where((F.col("field") == "status") & F.lower("value").isin("draft", "on hold"))
    return f.select("doc_id", F.col("value").alias("before"), F.when(F.lower("value") == "draft", "open").otherwise("paused").alias("after"))


@add("SELECT doc_id, list_sort(list(DISTINCT CASE WHEN tag = 'meeting' THEN 'event' WHEN starts_with(tag, 'meeting/') THEN 'event/' || substr(tag, 9) ELSE tag END)) AS tags FROM tags GROUP BY 1 HAVING count(*) FILTER (WHERE tag = 'meeting' OR starts_with(tag, 'meeting/')) > 0")
def mutate_rename_tag(spark, d):
    """A tag and its children renamed, merged where the new one is there already."""
    raw = F.regexp_extract(M.front(F.col("text")), r"(?m)^tags:[ \t]*\[?([^\]\n]*)\]?[ \t]*$", 1)
    tags = F.filter(F.transform(F.split(raw, ","), lambda x: F.regexp_replace(F.trim(x), r'^["#]+|"+$', "")), lambda x: x != "")
    new = lambda t: F.when(t == "meeting", F.lit("event")).when(F.startswith(t, F.lit("meeting/")), F.concat(F.lit("event/"), F.substr(t, F.lit(9)))).otherwise(t)
    t = docs(spark, d, "text").select("doc_id", tags.alias("t")).where(F.exists("t", lambda x: (x == "meeting") | F.startswith(x, F.lit("meeting/"))))
    return t.select("doc_id", F.array_sort(F.array_distinct(F.transform("t", new))).alias("tags"))


@add("SELECT doc_id, line_no, regexp_replace(line, '\\[ \\]', '[x]') AS line FROM lines WHERE regexp_matches(line, '^[ \\t]*[-*+] \\[ \\] ')")
def mutate_toggle_tasks(spark, d):
    """Open tasks as they read when done."""
    return lines(spark, d).where(F.col("line").rlike(r"^[ \t]*[-*+] \[ \] ")).select("doc_id", "line_no", F.concat(F.regexp_extract("line", r"^([ \t]*[-*+] )", 1), F.lit("[x]"), F.regexp_extract("line", r"^[ \t]*[-*+] \[ \](.*)$", 1)).alias("line"))


@add("SELECT doc_id, regexp_replace(text, '\\[\\[([^\\]|]*\\|)?([^\\]]*)\\]\\]', '\\2', 'g') AS text FROM docs WHERE contains(text, '[[')")
def mutate_unlink(spark, d):
    """Documents with their links replaced by the text they show."""
    return docs(spark, d, "text").where(F.contains("text", F.lit("[["))).select("doc_id", F.regexp_replace("text", r"\[\[([^\]|]*\|)?([^\]]*)\]\]", "$2").alias("text"))


QUERIES, SQL = book.queries, book.sql
