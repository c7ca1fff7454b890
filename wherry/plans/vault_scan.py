"""Queries that build what the vault's tables hold: entities, search columns, texts and bookkeeping of vectors, keys after changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wherry.operators import entities as E
from wherry.operators import markdown as M
from wherry.operators import search as S
from wherry.operators import vault as V
from wherry.plans.book import Book
from wherry.plans.graph import note_tags
from wherry.plans.notes import DOC_SQL, docs, lines
from wherry.session import link_key, table

book = Book(DOC_SQL)
add = book.add
_LIST = """list_filter(list_transform(string_split(regexp_extract(front, '(?m)^{0}:[ \\t]*\\[?([^\\]\\n]*)\\]?[ \\t]*$', 1), ','), lambda x: regexp_replace(trim(x), '^["''#]+|["'']+$', '', 'g')), lambda x: x <> '')"""
_NOTE_TAGS = """tg AS (SELECT DISTINCT k, path, modified, tag FROM (SELECT k, path, modified, regexp_replace(trim(t), '^["''#]+|["'']+$', '', 'g') AS tag FROM (SELECT k, path, modified, unnest(string_split(x, ',')) AS t FROM (SELECT k, path, modified, unnest(regexp_extract_all(regexp_replace(frontmatter, '\\[\\[[^\\[\\]]*\\]\\]', ' ', 'g'), '\\[([^\\[\\]]*)\\]', 1)) AS x FROM {0}))) WHERE tag <> '')"""


@add(f"SELECT doc_id, unnest(list_distinct({_LIST.format('aliases')})) AS alias FROM docs")
def scan_aliases(spark, d):
    """Aliases declared in the frontmatter of documents."""
    return docs(spark, d, "text").select("doc_id", F.explode(F.array_distinct(E.front_list(F.col("text"), "aliases"))).alias("alias"))


_NAME = "regexp_replace(regexp_extract(path, '[^/]*$'), '(?i)\\.md$', '')"
_OK = "len(name) >= 2 AND NOT regexp_matches(name, '{0}') AND lower(name) NOT IN ({1})".format(E.EXCLUDED.replace("\\$", "\\$"), ", ".join(f"'{x}'" for x in E.STOP_NAMES))


@add(V.VAULT_SQL + f"SELECT name_lower, x.name AS name, x.path AS path FROM (SELECT lower(name) AS name_lower, min(struct_pack(path := path, name := name)) AS x FROM (SELECT path, {_NAME} AS name FROM notes) WHERE {_OK} GROUP BY 1)", common=False)
def scan_entities(spark, d):
    """Entities by the names of notes."""
    return E.scan(V.notes(spark, d))


def _folder_sql(path: str) -> str:
    pairs = " ".join(f"WHEN s IN ({', '.join(repr(n) for n in names)}) THEN '{cat}'" for cat, names in E.FOLDERS.items())
    return f"list_filter(list_transform(string_split(lower({path}), '/'), lambda s: CASE {pairs} END), lambda c: c IS NOT NULL)[1]"


_TECH = " OR ".join(f"contains(lower(name), '{t}')" for t in E.TECH)
_WORDS = "string_split_regex(name, '\\s+')"
_CAT = f"""CASE WHEN {_TECH} THEN 'technologies' WHEN name = upper(name) AND len(name) BETWEEN 2 AND 6 THEN 'acronyms' WHEN len({_WORDS}) >= 2 AND lower({_WORDS}[-1]) IN ({', '.join(map(repr, E.ORG_WORDS))}) THEN 'organizations'
WHEN (len({_WORDS}) >= 2 AND lower({_WORDS}[-1]) IN ({', '.join(map(repr, E.PLACE_WORDS))})) OR lower(name) IN ({', '.join(map(repr, E.REGIONS))}) THEN 'locations' WHEN len({_WORDS}) = 2 AND {_WORDS}[1][1] = upper({_WORDS}[1][1]) AND {_WORDS}[-1][1] = upper({_WORDS}[-1][1]) THEN 'people'
WHEN len({_WORDS}) >= 2 AND name = lower(name) THEN 'concepts' WHEN contains(name, ' ') THEN 'projects' ELSE 'other' END"""


@add(V.VAULT_SQL + f"SELECT id, coalesce({_folder_sql('path')}, {_CAT}) AS by_all, {_CAT} AS by_name FROM ents WHERE name IS NOT NULL", common=False)
def scan_entity_categories(spark, d):
    """Category of each entity by the whole cascade, and by its name alone."""
    e = V.entities(spark, d).where("name is not null")
    name = F.col("name")
    return e.select("id", E.category(name, F.col("path")).alias("by_all"), E.category(name, F.lit(None).cast("string")).alias("by_name"))


_DECLARED = "CASE lower(trim(t)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.declared_types().items()) + " END"


@add(f"""WITH x AS (SELECT d.doc_id, d.path, {_NAME.replace('path', 'd.path')} AS name, (SELECT min(value) FROM fields f WHERE f.doc_id = d.doc_id AND field = 'type' AND value <> '') AS t FROM docs d)
SELECT coalesce({_DECLARED}, {_folder_sql('path')}, {_CAT}) AS category, count(*) AS n_docs FROM x GROUP BY 1""")
def scan_categories(spark, d):
    """Documents by category: declared type, folder, form of the name. One pass over expressions."""
    t = docs(spark, d, "path", "text")
    kind = F.regexp_extract_all(M.front(F.col("text")), F.lit(r"(?mi)^type:[ \t]*(.+?)[ \t]*$"), 1)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.md$", "")
    cat = E.category(name, F.col("path"), E.declared_category(F.array_min(kind)))
    return t.groupBy(cat.alias("category")).agg(F.count(F.lit(1)).alias("n_docs"))


@add("""WITH p AS (SELECT doc_id, trim(regexp_extract(front, '(?m)^description:\\s*[''"]?(.+?)[''"]?\\s*$', 1)) AS d, regexp_replace(string_split_regex(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), '\\n\\s*\\n')[1], '^\\s+|\\s+$', '', 'g') AS first FROM docs)
SELECT doc_id, CASE WHEN d <> '' THEN substr(d, 1, 200) ELSE substr(trim(regexp_replace(regexp_replace(first, '(?m)^#+\\s+', '', 'g'), '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', '\\1', 'g')), 1, 200) END AS description FROM p WHERE d <> '' OR len(first) >= 10""")
def scan_descriptions(spark, d):
    """A short description of each document."""
    return docs(spark, d, "text").select("doc_id", E.description(F.col("text")).alias("description")).where("description is not null")


@add("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(front, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[\\s-]*', ''), '^\\w+:\\s*', '')), lambda x: x <> '' AND NOT starts_with(x, '[') AND NOT starts_with(x, '{')), ' ') AS searched FROM docs WHERE front <> ''""")
def scan_search_front(spark, d):
    """The searchable values of the frontmatter of documents."""
    return docs(spark, d, "text").where(M.front(F.col("text")) != "").select("doc_id", E.search_front(F.col("text")).alias("searched"))


_W = "regexp_extract_all(coalesce(lower({0}), ''), '[\\p{{L}}\\p{{N}}]+')"
_POST = "post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(" + _W.format("text") + ") AS term FROM documents WHERE COND) GROUP BY 1, 2)"


@add(f"WITH {_POST.replace('COND', 'octet_length(encode(text)) <= 5000000')} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY 1", common=False)
def index_terms(spark, d):
    """The search index by term, of texts up to five million bytes: documents and occurrences of each word."""
    t = table(spark, d, "documents").where(F.octet_length("text") <= 5_000_000)
    return S.postings(t, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@add("WITH " + _POST.replace("COND", "doc_id % 10 <> 3 OR modified >= TIMESTAMP '2025-06-01'") + """ SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY 1""", common=False)
def index_updated(spark, d):
    """The index after an update: postings of the old state without those of changed and deleted documents, and those of the changed ones anew.

    Documents changed since June 2025 stand for the batch of changes, old ones whose id ends in 3 for deletions.
    """
    t = table(spark, d, "documents").select("doc_id", "text", "modified")
    new = F.col("modified") >= F.lit("2025-06-01").cast("timestamp_ntz")
    old = S.postings(t, "doc_id", "text")
    gone = t.where((F.col("doc_id") % 10 == 3) & ~new).select("doc_id").unionByName(t.where(new).select("doc_id"))
    both = old.join(gone, "doc_id", "left_anti").unionByName(S.postings(t.where(new), "doc_id", "text"))
    return both.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@add(f"""WITH t AS (SELECT doc_id, path, body, list_slice({_LIST.format('tags')}, 1, 5) AS tags FROM docs WHERE path IS NOT NULL) SELECT doc_id, substr(sha256('Note: ' || {_NAME} || CASE WHEN len(tags) > 0 THEN '. Tags: ' || array_to_string(tags, ', ') ELSE '' END || '.' || chr(10) || chr(10) || body), 1, 16) AS hash FROM t""")
def embed_note_texts(spark, d):
    """Hash of the text that stands for each document when its vector is made."""
    t = docs(spark, d, "path", "text").where("path is not null")
    return t.select("doc_id", F.substring(F.sha2(E.note_text(F.col("text"), F.col("path")), 256), 1, 16).alias("hash"))


@add(V.VAULT_SQL + "SELECT e.id, substr(sha256(concat_ws(' ', e.name, e.name, CASE WHEN len(e.aliases) > 0 THEN array_to_string(e.aliases, ' ') END, e.category, substr(n.content, 1, 500))), 1, 16) AS hash FROM ents e LEFT JOIN notes n ON n.k = regexp_replace(lower(trim(e.path)), '\\.md$', '')", common=False)
def embed_entity_texts(spark, d):
    """Hash of the text that stands for each entity; of its note only the first 500 characters are shuffled."""
    n = V.notes(spark, d, start=F.substring("content", 1, 500)).select("k", "start")
    e = V.entities(spark, d).withColumn("k", link_key("path")).join(n, "k", "left")
    return e.select("id", F.substring(F.sha2(E.entity_text(F.col("name"), F.col("aliases"), F.col("category"), F.col("start")), 256), 1, 16).alias("hash"))


@add(V.VAULT_SQL + """, have AS (SELECT k, h FROM (SELECT regexp_replace(lower(trim(path)), '\\.md$', '') AS k, content_hash AS h, row_number() OVER (PARTITION BY regexp_replace(lower(trim(path)), '\\.md$', '') ORDER BY updated_at DESC, content_hash DESC) AS rn FROM note_embeddings WHERE path IS NOT NULL) WHERE rn = 1)
SELECT n.k, CASE WHEN have.k IS NULL THEN 'new' ELSE 'changed' END AS why FROM notes n LEFT JOIN have ON have.k = n.k WHERE have.h IS NULL OR have.h <> substr(sha256(coalesce(n.content, '')), 1, 16)""", common=False)
def embed_notes_due(spark, d):
    """Notes whose vector is missing or was made from another content: the rest is skipped. Only hashes are shuffled."""
    n = V.notes(spark, d, hash=F.substring(F.sha2(F.coalesce("content", F.lit("")), 256), 1, 16)).select("k", "hash")
    e = table(spark, d, "note_embeddings").where("path is not null").groupBy(link_key("path").alias("k")).agg(F.max(F.struct("updated_at", F.col("content_hash").alias("h"))).alias("x")).select("k", "x.h", F.lit(True).alias("there"))
    j = n.join(e, "k", "left").where(F.col("h").isNull() | (F.col("h") != F.col("hash")))
    return j.select("k", F.when(F.col("there").isNull(), "new").otherwise("changed").alias("why"))


@add(V.VAULT_SQL + "SELECT DISTINCT name, why FROM (SELECT e.name, 'new' AS why FROM ents e WHERE e.name IS NOT NULL AND lower(e.name) NOT IN (SELECT lower(entity_name) FROM entity_embeddings WHERE entity_name IS NOT NULL))", common=False)
def embed_entities_due(spark, d):
    """Entities without a vector."""
    e = table(spark, d, "entity_embeddings").where("entity_name is not null").select(F.lower("entity_name").alias("low"))
    return V.entities(spark, d).where("name is not null").select("name", F.lower("name").alias("low")).join(e, "low", "left_anti").select("name", F.lit("new").alias("why")).distinct()


@add(V.VAULT_SQL + """SELECT 'note_embeddings' AS src, k AS key FROM (SELECT DISTINCT regexp_replace(lower(trim(path)), '\\.md$', '') AS k FROM note_embeddings WHERE path IS NOT NULL) WHERE k NOT IN (SELECT k FROM notes) AND (SELECT count(*) FROM notes) > 0
UNION ALL SELECT 'entity_embeddings', k FROM (SELECT DISTINCT lower(entity_name) AS k FROM entity_embeddings WHERE entity_name IS NOT NULL) WHERE k NOT IN (SELECT lower(name) FROM ents WHERE name IS NOT NULL) AND (SELECT count(*) FROM ents) > 0""", common=False)
def embed_orphans(spark, d):
    """Vectors of notes and entities that are no longer there. An empty scan of the vault removes nothing."""
    n = V.notes(spark, d).select("k")
    v = table(spark, d, "note_embeddings").where("path is not null").select(link_key("path").alias("k")).distinct()
    e = V.entities(spark, d).where("name is not null").select(F.lower("name").alias("k"))
    w = table(spark, d, "entity_embeddings").where("entity_name is not null").select(F.lower("entity_name").alias("k")).distinct()
    some = lambda x: F.broadcast(x.agg((F.count(F.lit(1)) > 0).alias("some")))  # noqa: E731  one row
    out = lambda src, x, have: x.join(have, "k", "left_anti").crossJoin(some(have)).where("some").select(F.lit(src).alias("src"), F.col("k").alias("key"))
    return out("note_embeddings", v, n).unionByName(out("entity_embeddings", w, e))


@add(V.VAULT_SQL + """, f AS (SELECT DISTINCT regexp_extract(k, '^(.*)/[^/]*$', 1) AS folder FROM notes), t AS (SELECT folder, regexp_extract(folder, '[^/]*$') AS last FROM f WHERE folder <> '')
SELECT folder, CASE WHEN regexp_matches(last, '^(daily|daily-notes|journal|journals)$') THEN 'daily' WHEN regexp_matches(last, '^(weekly|weekly-notes)$') THEN 'weekly' WHEN regexp_matches(last, '^(monthly|monthly-notes)$') THEN 'monthly' WHEN regexp_matches(last, '^templates?$') THEN 'templates' WHEN regexp_matches(last, '^(people|person|contacts)$') THEN 'people' WHEN regexp_matches(last, '^projects?$') THEN 'projects' END AS kind FROM t WHERE regexp_matches(last, '^(daily|daily-notes|journal|journals|weekly|weekly-notes|monthly|monthly-notes|templates?|people|person|contacts|projects?)$')""", common=False)
def config_inferred(spark, d):
    """Folders whose name says what they are for."""
    f = V.notes(spark, d).select(F.regexp_extract("k", r"^(.*)/[^/]*$", 1).alias("folder")).where("folder <> ''").distinct()
    last = F.element_at(F.split("folder", "/"), -1)
    kinds = {"daily": "^(daily|daily-notes|journal|journals)$", "weekly": "^(weekly|weekly-notes)$", "monthly": "^(monthly|monthly-notes)$", "templates": "^templates?$", "people": "^(people|person|contacts)$", "projects": "^projects?$"}
    return f.select("folder", F.coalesce(*[F.when(last.rlike(p), F.lit(k)) for k, p in kinds.items()]).alias("kind")).where("kind is not null")


@add(V.VAULT_SQL + ", " + _NOTE_TAGS.format("notes") + " SELECT DISTINCT k FROM tg WHERE tag = 'meeting' OR starts_with(tag, 'meeting/')", common=False)
def filter_tag_children(spark, d):
    """Notes with a tag or one below it."""
    return note_tags(V.notes(spark, d, "frontmatter")).where((F.col("tag") == "meeting") | F.startswith("tag", F.lit("meeting/"))).select("k").distinct()


_STEM = "regexp_extract(k, '[^/]*$')"
_PERIODIC = f"regexp_matches({_STEM}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$|^\\d{{4}}-w\\d{{2}}$|^\\d{{4}}-\\d{{2}}$|^\\d{{4}}-q[1-4]$|^\\d{{4}}$') OR top IN ('daily', 'weekly', 'monthly', 'quarterly', 'yearly', 'journal', 'journals')"


def is_periodic():
    """Whether a note's name is a day, week, month, quarter or year, or its top folder holds such notes (names and folders are fixed values)."""
    stem = F.element_at(F.split("k", "/"), -1)
    return stem.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{4}-w\d{2}$|^\d{4}-\d{2}$|^\d{4}-q[1-4]$|^\d{4}$") | F.col("top").isin("daily", "weekly", "monthly", "quarterly", "yearly", "journal", "journals")


@add(V.VAULT_SQL + f"SELECT k FROM notes WHERE NOT ({_PERIODIC})", common=False)
def filter_not_periodic(spark, d):
    """Notes that are no periodic notes, by all five forms of names and seven folders."""
    return V.notes(spark, d).where(~is_periodic()).select("k")


_T = "'^[ \\t]*[-*+] \\[([ xX-])\\] (.*)$'"


@add(f"""WITH t AS (SELECT l.doc_id, line_no, path, lower(regexp_extract(line, {_T}, 1)) AS mark, trim(regexp_extract(line, {_T}, 2)) AS task, nullif(regexp_extract(line, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS due FROM lines l JOIN docs ON docs.doc_id = l.doc_id WHERE regexp_matches(line, {_T}))
SELECT doc_id, line_no, task, due, row_number() OVER (ORDER BY due IS NULL, due DESC, path, line_no, doc_id) AS rank, count(*) OVER () AS total, (SELECT count(*) FROM t WHERE mark = 'x') AS n_completed, (SELECT count(*) FROM t WHERE mark = ' ') AS n_open FROM t WHERE mark = ' ' AND starts_with(path, 'meeting') ORDER BY due IS NULL, due DESC, path, line_no, doc_id LIMIT 25""")
def filter_tasks(spark, d):
    """A page of open tasks below a folder, those with a due date first, with the total and the counts of all tasks by status."""
    t = M.tasks(lines(spark, d), "doc_id").join(docs(spark, d, "path", "text").drop("text"), "doc_id")
    counts = t.agg(F.count_if(F.col("status") == "completed").alias("n_completed"), F.count_if(F.col("status") == "open").alias("n_open"))
    mine = t.where((F.col("status") == "open") & F.startswith("path", F.lit("meeting")))
    total = mine.agg(F.count(F.lit(1)).alias("total"))
    order = [F.col("due").isNull(), F.desc("due"), "path", "line_no", "doc_id"]
    page = mine.orderBy(*order).limit(25)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(*order))).crossJoin(F.broadcast(total)).crossJoin(F.broadcast(counts)).select("doc_id", "line_no", "task", "due", "rank", "total", "n_completed", "n_open")


@add("""WITH h AS (SELECT *, (SELECT min(x.line_no) FROM heads x WHERE x.doc_id = heads.doc_id AND x.line_no > heads.line_no AND x.level <= heads.level) AS stop FROM heads WHERE lower(heading) IN ('status', 'decision', 'log')),
w AS (SELECT doc_id, line_no, min(line_no) OVER (PARTITION BY doc_id, lower(heading)) AS first, heading, stop FROM h), f AS (SELECT * FROM w WHERE line_no = first)
SELECT f.doc_id, lower(f.heading) AS heading, f.line_no AS line_start, string_agg(l.line, chr(10) ORDER BY l.line_no) AS content FROM f JOIN lines l ON l.doc_id = f.doc_id AND l.line_no > f.line_no AND (f.stop IS NULL OR l.line_no < f.stop) GROUP BY 1, 2, 3""")
def scan_section_content(spark, d):
    """The content of the first section of some names in each document, deeper sections included. Only texts that hold such a heading are shuffled."""
    wanted = r"(?mi)^#{1,6} +(status|decision|log)[ \t]*$"
    t = docs(spark, d, "text").where(F.col("text").rlike(wanted))
    ls = M.prose_lines(t, "doc_id", M.body(F.col("text")))
    s = M.sections(ls, "doc_id").where(F.lower("heading").isin("status", "decision", "log"))
    first = s.groupBy("doc_id", F.lower("heading").alias("heading")).agg(F.min(F.struct("line_start", "next_same")).alias("x")).select("doc_id", "heading", "x.line_start", F.col("x.next_same").alias("stop"))
    x = ls.join(first, "doc_id").where((F.col("line_no") > F.col("line_start")) & (F.col("stop").isNull() | (F.col("line_no") < F.col("stop"))))
    g = x.groupBy("doc_id", "heading", "line_start").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("ls"))
    return g.select("doc_id", "heading", "line_start", F.array_join(F.transform("ls", lambda v: v["line"]), "\n").alias("content"))


@add("SELECT doc_id, CASE WHEN len(text) <= 400 THEN text WHEN contains(substr(text, 1, 400), chr(10) || chr(10)) THEN regexp_replace(substr(text, 1, 400), '(?s)\\n\\n(?:[^\\n]|\\n[^\\n])*$', '') ELSE substr(text, 1, 400) END AS cut FROM docs")
def filter_token_budget(spark, d):
    """Documents cut to 100 estimated tokens at the last blank line within them."""
    t = F.col("text")
    head = F.substring(t, 1, 400)
    cut = F.when(F.length(t) <= 400, t).when(F.contains(head, F.lit("\n\n")), F.regexp_replace(head, r"\n\n(?:[^\n]|\n[^\n])*\z", "")).otherwise(head)
    return docs(spark, d, "text").select("doc_id", cut.alias("cut"))


@add("""WITH l AS (SELECT doc_id, line_no, trim(regexp_extract(m, '\\[\\[([^\\]|#\\n]+)', 1)) AS target FROM (SELECT doc_id, line_no, unnest(regexp_extract_all(regexp_replace(line, '`[^`]*`', '', 'g'), '\\[\\[([^\\]|#\\n]+)(?:#[^\\]|\\n]*)?(?:\\|([^\\]\\n]+))?\\]\\]', 0)) AS m FROM lines)),
n AS (SELECT *, lag(line, 1) OVER w AS b1, lag(line, 2) OVER w AS b2, lead(line, 1) OVER w AS a1 FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT DISTINCT l.doc_id, l.line_no, l.target, concat_ws(chr(10), b2, b1, line, a1) AS context FROM l JOIN n ON n.doc_id = l.doc_id AND n.line_no = l.line_no""")
def scan_link_context(spark, d):
    """Each link of documents with the two lines before and the one after it. Only texts with a link are shuffled."""
    t = docs(spark, d, "text").where(F.contains("text", F.lit("[[")))
    ls = M.prose_lines(t, "doc_id", M.body(F.col("text")))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    near = ls.withColumn("context", F.concat_ws("\n", F.lag("line", 2).over(w), F.lag("line", 1).over(w), "line", F.lead("line", 1).over(w)))
    links = M.wikilinks(near.select("doc_id", "line_no", "line"), "doc_id").select("doc_id", "line_no", "target").distinct()
    return links.join(near.select("doc_id", "line_no", "context"), ["doc_id", "line_no"]).select("doc_id", "line_no", "target", "context")


@add(V.VAULT_SQL + ", versions AS (SELECT regexp_replace(lower(trim(path)), '\\.md$', '') AS k, path, modified, any_value(frontmatter) AS frontmatter FROM notes_fts WHERE path IS NOT NULL GROUP BY 1, 2, 3), ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY modified DESC, path DESC) AS rn FROM versions), both_ AS (SELECT * FROM ranked WHERE rn <= 2), " + _NOTE_TAGS.format("both_") + """,
v AS (SELECT b.k, b.rn, list(DISTINCT tg.tag) FILTER (WHERE tg.tag IS NOT NULL) AS tags FROM both_ b LEFT JOIN tg ON tg.k = b.k AND tg.path = b.path AND tg.modified = b.modified GROUP BY 1, 2)
SELECT n.k, list_sort(list_filter(coalesce(n.tags, []), lambda t: NOT list_contains(coalesce(o.tags, []), t))) AS added, list_sort(list_filter(coalesce(o.tags, []), lambda t: NOT list_contains(coalesce(n.tags, []), t))) AS removed FROM v n JOIN v o ON o.k = n.k AND n.rn = 1 AND o.rn = 2""", common=False)
def set_tag_diff(spark, d):
    """Tags added to and removed from each note between its last two versions."""
    n = table(spark, d, "notes_fts").where("path is not null").groupBy(link_key("path").alias("k"), "path", "modified").agg(F.max("frontmatter").alias("frontmatter"))
    lists = F.regexp_extract_all("frontmatter", F.lit(r"(?<!\[)\[([^\[\]]*)\](?!\])"), 1)
    tags = F.filter(F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda t: F.regexp_replace(F.trim(t), "^[\"'#]+|[\"']+$", "")), lambda t: t != "")
    v = n.select("k", "path", "modified", F.coalesce(tags, F.array().cast("array<string>")).alias("tags"))
    w = Window.partitionBy("k").orderBy(F.desc("modified"), F.desc("path"))
    v = v.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    g = v.groupBy("k").agg(F.max(F.when(F.col("rn") == 1, F.col("tags"))).alias("new"), F.max(F.when(F.col("rn") == 2, F.col("tags"))).alias("old")).where("old is not null")
    return g.select("k", F.array_sort(F.array_except("new", "old")).alias("added"), F.array_sort(F.array_except("old", "new")).alias("removed"))


_EV = "ev AS (SELECT DISTINCT regexp_replace(lower(trim(path)), '\\.md$', '') AS k FROM file_events WHERE type = 'unlink' AND path IS NOT NULL)"


@add(V.VAULT_SQL + f""", {_EV}, n2 AS (SELECT * FROM notes WHERE k NOT IN (SELECT k FROM ev)), e2 AS (SELECT e.name, e.aliases, n.k FROM ents e JOIN n2 n ON n.k = regexp_replace(lower(trim(e.path)), '\\.md$', '')),
k2 AS (SELECT k AS key, 0 AS prio, k FROM n2 UNION ALL SELECT regexp_extract(k, '[^/]*$'), 1, k FROM n2 UNION ALL SELECT regexp_replace(lower(trim(name)), '\\.md$', ''), 2, k FROM e2 UNION ALL SELECT regexp_replace(lower(trim(a)), '\\.md$', ''), 3, k FROM (SELECT unnest(aliases) AS a, k FROM e2)),
keys2 AS (SELECT key, k FROM (SELECT key, k, row_number() OVER (PARTITION BY key ORDER BY prio, k) AS rn FROM k2 WHERE key <> '') WHERE rn = 1)
SELECT a.key, a.k AS before, b.k AS after FROM keys a LEFT JOIN keys2 b ON b.key = a.key WHERE b.k IS DISTINCT FROM a.k""", common=False)
def index_released_keys(spark, d):
    """Keys that lead elsewhere or nowhere once all notes ever unlinked are taken out of the index.

    Only the keys of removed notes are worked out again: keys that none of them owned stay as they are.
    """
    n, e = V.notes(spark, d), V.entities(spark, d)
    gone = table(spark, d, "file_events").where("type = 'unlink' and path is not null").select(link_key("path").alias("k")).distinct()
    before = V.entity_keys(n, e)
    lost = before.join(gone, "k", "left_semi").select("key", F.col("k").alias("before"))
    after = V.entity_keys(n.join(gone, "k", "left_anti"), e).join(lost.select("key"), "key", "left_semi").select("key", F.col("k").alias("after"))
    return lost.join(after, "key", "left").select("key", "before", "after").where(~F.col("after").eqNullSafe(F.col("before")))


QUERIES, SQL = book.queries, book.sql
