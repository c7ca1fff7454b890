"""Queries over the change log, set operations and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wherry.operators import evaluation as E
from wherry.operators import search as S
from wherry.operators import vault as V
from wherry.plans.book import Book
from wherry.plans.graph import base
from wherry.functions.exprs import STOPWORDS, file_stem
from wherry.session import cut, ensure_checkpoint_dir, link_key, table
from wherry.streaming import changes as C

_K = V.KEY.format("path")
book = Book(f"WITH ev AS (SELECT DISTINCT seq, {_K} AS k, type, ts, content_hash FROM file_events WHERE path IS NOT NULL), co AS (SELECT k, arg_max(type, seq) AS type, max(seq) AS seq, arg_max(struct_pack(h := content_hash), seq).h AS content_hash FROM ev GROUP BY 1)\n")
add = book.add


def log(spark, d):
    """The change log."""
    return table(spark, d, "file_events").select("seq", "path", "type", "ts", "content_hash")


@add("SELECT k, CASE WHEN type = 'unlink' THEN 'delete' ELSE 'upsert' END AS action, seq, content_hash FROM co")
def stream_coalesced(spark, d):
    """One action per path."""
    return C.coalesce(log(spark, d))


@add("WITH half AS (SELECT (max(seq) + min(seq)) // 2 AS m FROM ev), known AS (SELECT k, arg_max(struct_pack(h := content_hash), seq).h AS h FROM ev, half WHERE seq <= m GROUP BY 1), late AS (SELECT k, arg_max(type, seq) AS type, max(seq) AS seq, arg_max(struct_pack(h := content_hash), seq).h AS h FROM ev, half WHERE seq > m GROUP BY 1) SELECT late.k, CASE WHEN late.type = 'unlink' THEN 'delete' ELSE 'upsert' END AS action, late.seq, late.h AS content_hash FROM late LEFT JOIN known ON known.k = late.k AND known.h = late.h WHERE known.k IS NULL")
def stream_changed_only(spark, d):
    """Actions of the later half of the log whose content isn't known from the earlier half."""
    e = log(spark, d)
    half = e.agg(F.floor((F.max("seq") + F.min("seq")) / 2).alias("m"))
    x = e.crossJoin(F.broadcast(half))
    known = C.coalesce(x.where("seq <= m").drop("m")).select("k", "content_hash")
    return C.changed(C.coalesce(x.where("seq > m").drop("m")), known)


@add("""WITH u AS (SELECT seq, k, regexp_extract(k, '[^/]*$') AS stem, epoch_us(ts) AS us FROM ev WHERE type = 'unlink'), a AS (SELECT seq, k, regexp_extract(k, '[^/]*$') AS stem, epoch_us(ts) AS us FROM ev WHERE type = 'add'),
p AS (SELECT u.k AS from_k, a.k AS to_k, u.seq AS unlink_seq, a.seq AS add_seq, abs(u.us - a.us) AS gap, regexp_extract(u.k, '^(.*)/[^/]*$', 1) <> regexp_extract(a.k, '^(.*)/[^/]*$', 1) AS away FROM u JOIN a ON u.stem = a.stem AND u.k <> a.k AND abs(u.us - a.us) <= 5000000 AND (regexp_extract(u.k, '^(.*)/[^/]*$', 1) = regexp_extract(a.k, '^(.*)/[^/]*$', 1) OR regexp_replace(u.stem, '\\.[^.]+$', '') NOT IN ('readme', 'index', 'todo', 'changelog', 'license', 'notes'))),
r AS (SELECT *, row_number() OVER (PARTITION BY unlink_seq ORDER BY away, gap, add_seq) AS ru, row_number() OVER (PARTITION BY add_seq ORDER BY away, gap, unlink_seq) AS ra FROM p) SELECT from_k, to_k, unlink_seq, add_seq FROM r WHERE ru = 1 AND ra = 1""")
def stream_renames(spark, d):
    """Unlinks and adds that are one move."""
    return C.renames(log(spark, d))


@add("WITH l AS (SELECT k, seq, type, sum(CASE WHEN type IN ('add', 'unlink') THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY seq) AS life FROM ev), m AS (SELECT k, max(life) AS life FROM l GROUP BY 1), g AS (SELECT l.k, count(*) FILTER (WHERE type = 'change') AS n_edits, arg_max(type, seq) AS t FROM l JOIN m ON m.k = l.k AND m.life = l.life GROUP BY 1) SELECT k, n_edits, n_edits >= 3 AS survived FROM g WHERE t <> 'unlink'")
def stream_survival(spark, d):
    """Edits that each path has survived."""
    return C.survival(log(spark, d))


@add("SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '2000-01-01') AS start, type, count(*) AS n FROM file_events WHERE ts IS NOT NULL GROUP BY 1, 2", common=False)
def stream_windowed(spark, d):
    """Changes by type and day, run as a stream over the log with a watermark wide enough for all of it."""
    import uuid

    stream = C.read_changes(spark, f"{d}/file_events.parquet") if _is_dir(spark, f"{d}/file_events.parquet") else _one_file(spark, d)
    out = f"{ensure_checkpoint_dir(spark)}/windowed-{uuid.uuid4().hex}"
    spark.createDataFrame([], "start timestamp, type string, n long").write.parquet(f"{out}/rows")  # a log without rows has no batch
    # each batch replaces the result, as every window may still change; the folder is the cluster's shared one
    each = lambda df, i: df.write.mode("overwrite").parquet(f"{out}/rows")
    q = C.windowed(stream, "1 day", "10000 days").writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("start timestamp, type string, n long").parquet(f"{out}/rows").select(F.col("start").cast("timestamp_ntz").alias("start"), "type", "n")


def _is_dir(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _one_file(spark, d):
    """A stream over the folder with only that file of it."""
    return spark.readStream.schema(C.SCHEMA).option("pathGlobFilter", "file_events.parquet").parquet(d)


@add("SELECT dst FROM (SELECT DISTINCT regexp_replace(lower(trim(target)), '\\.md$', '') AS dst FROM note_links WHERE target IS NOT NULL) INTERSECT SELECT DISTINCT lower(trim(term)) FROM prospect_ledger WHERE term IS NOT NULL", common=False)
def set_intersect(spark, d):
    """Targets that are prospects too."""
    a = table(spark, d, "note_links").where("target is not null").select(link_key("target").alias("dst"))
    return a.intersect(table(spark, d, "prospect_ledger").where("term is not null").select(F.lower(F.trim("term")).alias("dst")))


@add("SELECT k, side FROM (SELECT k, 'unlogged' AS side FROM (SELECT DISTINCT regexp_replace(lower(trim(path)), '\\.md$', '') AS k FROM notes_fts EXCEPT SELECT k FROM ev) UNION ALL SELECT k, 'gone' FROM (SELECT k FROM ev EXCEPT SELECT DISTINCT regexp_replace(lower(trim(path)), '\\.md$', '') FROM notes_fts))")
def set_difference(spark, d):
    """Notes never logged, and logged paths without a note."""
    n = table(spark, d, "notes_fts").select(link_key("path").alias("k")).distinct()
    e = log(spark, d).where("path is not null").select(link_key("path").alias("k")).distinct()
    return n.join(e, "k", "left_anti").select("k", F.lit("unlogged").alias("side")).unionByName(e.join(n, "k", "left_anti").select("k", F.lit("gone").alias("side")))


@add(V.VAULT_SQL + "SELECT lower(name) AS name, count(*) AS n_vaults, min(vault) AS first_vault FROM (SELECT name, 'a' AS vault FROM ents UNION ALL SELECT entity_name, 'b' FROM (SELECT DISTINCT entity_name FROM entity_embeddings)) GROUP BY 1", common=False)
def set_cross_vault(spark, d):
    """Entities of two sources merged by name."""
    a = V.entities(spark, d).select("name", F.lit("a").alias("vault"))
    b = table(spark, d, "entity_embeddings").select(F.col("entity_name").alias("name")).distinct().withColumn("vault", F.lit("b"))
    return a.unionByName(b).groupBy(F.lower("name").alias("name")).agg(F.count(F.lit(1)).alias("n_vaults"), F.min("vault").alias("first_vault"))


_EVAL_WORDS = "regexp_extract_all(coalesce(lower({0}), ''), '[\\p{{L}}\\p{{N}}]+')"


@add()
def eval_retrieval(spark, d):
    """Recall, precision, reciprocal rank and NDCG at 10 of ranked search, with each note's title as a query that should find the note.

    Of a content only its length in words and the words that any title has are shuffled. Notes are numbered in the order of their keys.
    """
    asked = lambda c: F.filter(S.words(c), lambda w: (F.length(w) > 3) & ~w.isin(*STOPWORDS))
    titles = table(spark, d, "notes_fts").where("path is not null").select(F.explode(asked(F.coalesce("title", file_stem(F.col("path"))))).alias("term"))
    w = S.words(F.col("content"))
    n = V.notes(spark, d, there=F.coalesce(F.col("content") != "", F.lit(False)), dl=F.size(w), kept=S.keep_known(titles)(w)).where("there")
    n = n.select("k", "dl", "kept", F.array_distinct(asked(F.col("title"))).alias("terms"))
    n = cut(n.repartitionByRange("k").sortWithinPartitions("k").select(F.monotonically_increasing_id().alias("id"), "dl", "kept", "terms"))
    q = n.select(F.col("id").alias("query_id"), F.explode("terms").alias("term"))
    got = S.bm25_many(n, q, 10).select("query_id", "rank", F.col("id").alias("doc"))
    return E.retrieval_metrics(got, q.select("query_id", F.col("query_id").alias("doc")).distinct(), 10)


@add(f"""WITH x AS (SELECT item_id, {_EVAL_WORDS.format('text')} AS w FROM eval_items), y AS (SELECT a.item_id AS a, b.item_id AS b, a.w AS wa, b.w AS wb FROM x a JOIN x b ON b.item_id = a.item_id + 1)
SELECT a, round(CASE WHEN s > 0 THEN 2.0 * s / (len(wa) + len(wb)) ELSE 0 END, 6) AS f1 FROM (SELECT a, wa, wb, list_sum(list_transform(list_distinct(wa), lambda t: least(len(list_filter(wa, lambda z: z = t)), len(list_filter(wb, lambda z: z = t))))) AS s FROM y)""", common=False)
def eval_token_f1(spark, d):
    """Word overlap of each evaluation item with the next."""
    i = table(spark, d, "eval_items").select("item_id", "text")
    j = i.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return i.join(j, "item_id").select(F.col("item_id").alias("a"), F.round(E.token_f1(F.col("text"), F.col("next")), 6).alias("f1"))


@add(V.VAULT_SQL + ", pred AS (SELECT DISTINCT doc_id, regexp_replace(lower(trim(m)), '\\.md$', '') AS key FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\[\\[([^\\]|#]+)', 1)) AS m FROM documents)) SELECT e.category, count(*) AS n_links, count(DISTINCT doc_id) AS n_docs FROM pred JOIN (SELECT DISTINCT category, regexp_replace(lower(trim(name)), '\\.md$', '') AS key FROM ents) e USING (key) GROUP BY 1", common=False)
def eval_links_by_category(spark, d):
    """Entities that documents link to, by category."""
    e = V.entities(spark, d).select("category", link_key("name").alias("key")).distinct()
    p = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|#]+)"), 1)).alias("m")).select("doc_id", link_key("m").alias("key")).distinct()
    return p.join(e, "key").groupBy("category").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("doc_id").alias("n_docs"))


@add(V.VAULT_SQL + ", fmr AS (SELECT DISTINCT k, 'front' AS layer, regexp_replace(lower(trim(m)), '\\.md$', '') AS ref FROM (SELECT k, unnest(regexp_extract_all(coalesce(frontmatter, ''), '\\[\\[([^\\]|#]+)', 1)) AS m FROM notes)), pro AS (SELECT DISTINCT k, regexp_replace(lower(trim(m)), '\\.md$', '') AS ref FROM (SELECT k, unnest(regexp_extract_all(coalesce(content, ''), '\\[\\[([^\\]|#]+)', 1)) AS m FROM notes)) SELECT coalesce(f.k, p.k) AS k, coalesce(f.ref, p.ref) AS ref, CASE WHEN p.k IS NULL THEN 'frontmatter' WHEN f.k IS NULL THEN 'prose' ELSE 'both' END AS layer FROM fmr f FULL JOIN pro p ON p.k = f.k AND p.ref = f.ref", common=False)
def join_cross_layer(spark, d):
    """References of notes by where they stand: frontmatter, prose or both."""
    found = lambda c: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"\[\[([^\]|#]+)"), 1)
    n = V.notes(spark, d, front_refs=found("frontmatter"), content_refs=found("content"))
    refs = lambda c: n.select("k", F.explode(c).alias("m")).select("k", link_key("m").alias("ref")).distinct()
    f, p = refs("front_refs").withColumn("f", F.lit(1)), refs("content_refs").withColumn("p", F.lit(1))
    return f.join(p, ["k", "ref"], "full_outer").select("k", "ref", F.when(F.col("p").isNull(), "frontmatter").when(F.col("f").isNull(), "prose").otherwise("both").alias("layer"))


@add(V.VAULT_SQL + "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT k, count(*) AS n FROM (SELECT src AS k FROM links WHERE weight < 0.5) GROUP BY 1) a FULL JOIN (SELECT k, count(*) AS n FROM (SELECT src AS k FROM links WHERE weight >= 0.5) GROUP BY 1) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.n <> b.n", common=False)
def join_diff(spark, d):
    """Notes added, removed or changed between two states of the links (light and heavy links stand for the states)."""
    x = V.links(spark, d)
    side = lambda i: x.where((F.col("weight") >= 0.5).cast("int") == i).groupBy(F.col("src").alias("k")).agg(F.count(F.lit(1)).alias(f"n{i}"))
    j = side(0).join(side(1), "k", "full_outer").where(F.col("n0").isNull() | F.col("n1").isNull() | (F.col("n0") != F.col("n1")))
    return j.select("k", F.when(F.col("n0").isNull(), "added").when(F.col("n1").isNull(), "removed").otherwise("changed").alias("change"))


_MV = """mv AS (WITH u AS (SELECT seq, k, regexp_extract(k, '[^/]*$') AS stem, epoch_us(ts) AS us FROM ev WHERE type = 'unlink'), a AS (SELECT seq, k, regexp_extract(k, '[^/]*$') AS stem, epoch_us(ts) AS us FROM ev WHERE type = 'add'),
p AS (SELECT u.k AS from_k, a.k AS to_k, u.seq AS unlink_seq, a.seq AS add_seq, abs(u.us - a.us) AS gap, regexp_extract(u.k, '^(.*)/[^/]*$', 1) <> regexp_extract(a.k, '^(.*)/[^/]*$', 1) AS away FROM u JOIN a ON u.stem = a.stem AND u.k <> a.k AND abs(u.us - a.us) <= 5000000 AND (regexp_extract(u.k, '^(.*)/[^/]*$', 1) = regexp_extract(a.k, '^(.*)/[^/]*$', 1) OR regexp_replace(u.stem, '\\.[^.]+$', '') NOT IN ('readme', 'index', 'todo', 'changelog', 'license', 'notes'))),
r AS (SELECT *, row_number() OVER (PARTITION BY unlink_seq ORDER BY away, gap, add_seq) AS ru, row_number() OVER (PARTITION BY add_seq ORDER BY away, gap, unlink_seq) AS ra FROM p) SELECT from_k, arg_max(to_k, unlink_seq) AS to_k FROM r WHERE ru = 1 AND ra = 1 GROUP BY 1)"""
_LK = "regexp_replace(lower(trim({0})), '\\.md$', '')"


@add(f"""WITH {_MV}, c AS (SELECT DISTINCT 'note_links' AS tbl, CAST(link_id AS VARCHAR) AS key, {_LK.format('note_path')} AS k FROM note_links UNION SELECT DISTINCT 'note_embeddings', path, {_LK.format('path')} FROM note_embeddings UNION SELECT DISTINCT 'prospect_ledger', CAST(sighting_id AS VARCHAR), {_LK.format('note_path')} FROM prospect_ledger
UNION SELECT DISTINCT 'entities', CAST(id AS VARCHAR), {_LK.format('path')} FROM entities UNION SELECT DISTINCT 'prospect_summary', CAST(summary_id AS VARCHAR), {_LK.format('resolved_entity_path')} FROM prospect_summary) SELECT tbl, key, k AS old, to_k AS new FROM c JOIN mv ON mv.from_k = c.k WHERE key IS NOT NULL""")
def mutate_rename_cascade(spark, d):
    """What moves of notes change in five tables: table, key of the row, old and new path. Only keys and paths are read; the moves are joined by key."""
    mv = C.renames(log(spark, d)).groupBy(F.col("from_k").alias("old")).agg(F.max_by("to_k", "unlink_seq").alias("new"))
    cols = {"note_links": ("link_id", "note_path"), "note_embeddings": ("path", "path"), "prospect_ledger": ("sighting_id", "note_path"), "entities": ("id", "path"), "prospect_summary": ("summary_id", "resolved_entity_path")}
    parts = [table(spark, d, t).where(F.col(p).isNotNull()).select(F.lit(t).alias("tbl"), F.col(key).cast("string").alias("key"), link_key(p).alias("old")) for t, (key, p) in cols.items()]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    return both.where("key is not null").distinct().join(mv, "old").select("tbl", "key", "old", "new")


@add(V.VAULT_SQL + f", last_ AS (SELECT {_LK.format('path')} AS k, max(ts) AS t FROM file_events WHERE path IS NOT NULL GROUP BY 1) SELECT notes.k, modified, t AS logged FROM notes LEFT JOIN last_ ON last_.k = notes.k WHERE t IS NULL OR modified > t", common=False)
def stream_catch_up(spark, d):
    """Notes changed after the last logged event of their path, or never logged: what a start has to read again."""
    last = log(spark, d).where("path is not null").groupBy(link_key("path").alias("k")).agg(F.max("ts").alias("logged"))
    return V.notes(spark, d).select("k", "modified").join(last, "k", "left").where(F.col("logged").isNull() | (F.col("modified") > F.col("logged")))


@add("SELECT key, arg_max(value, struct_pack(u := updated, v := vault, i := id)) AS value, count(DISTINCT vault) AS n_vaults, count(*) AS n FROM (SELECT DISTINCT lower(trim(term)) AS key, coalesce(display_name, term) AS value, last_seen_at AS updated, 'a' AS vault, sighting_id AS id FROM prospect_ledger WHERE trim(term) <> '' UNION ALL SELECT DISTINCT lower(trim(term)), coalesce(display_name, term), updated_at, 'b', summary_id FROM prospect_summary WHERE trim(term) <> '') GROUP BY 1", common=False)
def set_cross_vault_memories(spark, d):
    """Memories of two sources merged by key, the latest value kept."""
    a = table(spark, d, "prospect_ledger").where(F.trim("term") != "").select(F.lower(F.trim("term")).alias("key"), F.coalesce("display_name", "term").alias("value"), F.col("last_seen_at").alias("updated"), F.lit("a").alias("vault"), F.col("sighting_id").alias("id")).distinct()
    b = table(spark, d, "prospect_summary").where(F.trim("term") != "").select(F.lower(F.trim("term")).alias("key"), F.coalesce("display_name", "term").alias("value"), F.col("updated_at").alias("updated"), F.lit("b").alias("vault"), F.col("summary_id").alias("id")).distinct()
    return a.unionByName(b).groupBy("key").agg(F.max_by("value", F.struct("updated", "vault", "id")).alias("value"), F.countDistinct("vault").alias("n_vaults"), F.count(F.lit(1)).alias("n"))


@add(f"SELECT id, built_at, built_at < max(built_at) OVER () - INTERVAL 1 HOUR AS stale FROM (SELECT DISTINCT id, built_at FROM vault_index_cache)", common=False)
def index_stale(spark, d):
    """Index snapshots more than an hour older than the newest."""
    c = table(spark, d, "vault_index_cache").select("id", "built_at").distinct()
    newest = c.agg(F.max("built_at").alias("newest"))
    return c.crossJoin(F.broadcast(newest)).select("id", "built_at", (F.col("built_at") < F.col("newest") - F.expr("interval 1 hour")).alias("stale"))  # one row is broadcast


QUERIES, SQL = book.queries, book.sql
