"""Queries around a search: parsed and stemmed, fused with vectors and entities, backfilled over links, expanded, routed; and vectors that find alike notes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wherry.functions.exprs import beta_mean, cosine, file_stem, recency_boost, recency_decay
from wherry.operators import association as A
from wherry.operators import retrieval as R
from wherry.operators import search as S
from wherry.operators import vault as V
from wherry.plans.association import book as assoc_book
from wherry.plans.association import mentions, npmi_pairs
from wherry.plans.book import Book
from wherry.plans.graph import AS_OF
from wherry.plans.search import _BM, _H, _W, TERMS, _channels, note_bm25
from wherry.session import cut, link_key, table

QUERY = '"tag set" digest indexing backlink*'
MODEL, SIZE = "vault-mini-v2", 64
book = Book(_H)
add = book.add


@add()
def search_parsed(spark, d):
    """The 20 best notes for a query as typed: a phrase, stemmed words, a beginning; title 5, frontmatter 10, content 1, path 0."""
    n = V.notes(spark, d, "frontmatter", "content")
    return R.search(n, "k", {"path": 0.0, "title": 5.0, "frontmatter": 10.0, "content": 1.0}, QUERY, 20)


@add()
def search_parsed_snippets(spark, d):
    """The same page with each note's best passage. Contents of the page only are read again."""
    page = search_parsed(spark, d)
    n = table(spark, d, "notes_fts").where("path is not null").select(link_key("path").alias("k"), "path", "modified", "content").join(F.broadcast(page), "k")  # a page of 20
    n = n.groupBy("k", "score").agg(F.max_by("content", F.struct("modified", "path")).alias("content"))
    return R.snippets(n, "content", QUERY).drop("content")


@add()
def search_sections(spark, d):
    """The whole section around the best passage of the five best notes, 2,500 characters at most."""
    top = search_parsed_snippets(spark, d).orderBy(F.desc("score"), "k").limit(5).where("section is not null")
    n = table(spark, d, "notes_fts").where("path is not null").select(link_key("path").alias("k"), "path", "modified", "content").join(F.broadcast(top.select("k", "section")), "k")
    n = n.groupBy("k", "section").agg(F.max_by("content", F.struct("modified", "path")).alias("content"))
    lines = F.split("content", "\n")
    head = lambda x: F.regexp_extract(x, r"^(#{1,6})\s+(.+?)\s*$", 2)
    level = lambda x: F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1))
    at = F.array_position(F.transform(lines, head), F.col("section"))
    rest = F.slice(lines, at.cast("int") + 1, F.size(lines))
    own = level(F.element_at(lines, at.cast("int")))
    n = n.where(at > 0).select("k", "section", own.alias("level"), rest.alias("rest"))
    ends = F.array_position(F.transform("rest", lambda x: (level(x) > 0) & (level(x) <= F.col("level"))), True).cast("int")
    body = F.when(ends > 0, F.slice("rest", F.lit(1), ends - 1)).otherwise(F.col("rest"))
    return n.select("k", "section", F.substring(F.array_join(body, "\n"), 1, 2500).alias("content"))


# ---- vectors of notes ------------------------------------------------------------------------------------------------------

_NV = f"""nv AS (SELECT k, v FROM (SELECT regexp_replace(lower(trim(path)), '\\.md$', '') AS k, embedding::DOUBLE[] AS v, model, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC, model DESC, embedding DESC) AS rn FROM note_embeddings WHERE path IS NOT NULL) WHERE rn = 1 AND model = '{MODEL}' AND len(v) = {SIZE} AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
nv1 AS (SELECT k, any_value(v) AS v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) AS rn FROM nv) WHERE rn = 1 GROUP BY 1), qv AS (SELECT k AS qk, v AS q FROM nv1 ORDER BY k LIMIT 1), sem AS (SELECT k, round(list_cosine_similarity(v, q), 6) AS sim FROM nv1, qv WHERE k <> qk)"""


def note_vectors(spark, d):
    """``k, v``: the newest usable vector of each note, one model."""
    v = table(spark, d, "note_embeddings").where("path is not null").groupBy("path").agg(F.max(F.struct("updated_at", "model", F.col("embedding").alias("v"))).alias("x")).select(link_key("path").alias("k"), "x.model", "x.v")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    return v.where((F.col("model") == MODEL) & (F.size("v") == SIZE) & good).groupBy("k").agg(F.min("v").alias("v"))


def _near(spark, d):
    """``k, sim`` to the first note's vector, and that note's key: the vector of a query comes as data, as texts aren't embedded here."""
    v = note_vectors(spark, d)
    q = v.orderBy("k").limit(1).select(F.col("k").alias("qk"), F.col("v").alias("q"))
    return v.crossJoin(F.broadcast(q)).where("k <> qk").select("k", "qk", F.round(cosine(F.col("v"), F.col("q")), 6).alias("sim"))  # one row is broadcast


@add(f"WITH {_NV} SELECT k, sim FROM sem WHERE k NOT IN (SELECT target_k FROM res JOIN qv ON src = qk WHERE target_k IS NOT NULL) ORDER BY sim DESC, k LIMIT 10")
def vector_similar_unlinked(spark, d):
    """The ten notes most like the first one by vectors, those it links to left out."""
    n = V.notes(spark, d)
    r = V.resolved(V.links(spark, d), V.entity_keys(n, V.entities(spark, d))).where(F.col("to").isNotNull()).select(F.col("src").alias("qk"), F.col("to").alias("k"))
    return _near(spark, d).join(r, ["qk", "k"], "left_anti").select("k", "sim").orderBy(F.desc("sim"), "k").limit(10)


_ENT = _W.format("name")
_EF = f"""ew AS (SELECT id, regexp_replace(lower(trim(path)), '\\.md$', '') AS ek, {_W.format('name')} AS w_a, {_W.format("array_to_string(aliases, ' ')")} AS w_b, {_W.format('category')} AS w_c FROM ents),
et AS (SELECT id, ek, len(w_a) + len(w_b) + len(w_c) AS dl, """ + ", ".join(f"CAST(len(list_filter(list_concat(w_a, w_b, w_c), lambda v: v = '{t}')) AS DOUBLE) AS t{i}" for i, t in enumerate(["crawler", "field", "pipeline"])) + """ FROM ew), est AS (SELECT count(*) AS n, avg(dl) AS avgdl, """ + ", ".join(f"count(*) FILTER (WHERE t{i} > 0) AS d{i}" for i in range(3)) + f""" FROM et),
es AS (SELECT id, ek, round({' + '.join(_BM.format(i=i) for i in range(3))}, 6) AS score FROM et, est WHERE t0 + t1 + t2 > 0 ORDER BY score DESC, id LIMIT 40), ent_c AS (SELECT k, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT ek AS k, id, score, row_number() OVER (PARTITION BY ek ORDER BY score DESC, id) AS r1 FROM es WHERE ek IS NOT NULL) WHERE r1 = 1)"""


def entity_channel(spark, d, terms=("crawler", "field", "pipeline"), k=40):
    """Notes of the best entities by name, aliases and category, ranked."""
    e = V.entities(spark, d).withColumn("al", F.array_join("aliases", " "))
    hits = S.bm25(e, "id", {"name": 1.0, "al": 1.0, "category": 1.0}, list(terms), k).join(e.select("id", link_key("path").alias("k")), "id").where("k is not null")
    first = hits.groupBy("k").agg(F.max(F.struct("score", (-F.col("id")).alias("minus"))).alias("x")).select("k", "x.score", "x.minus")
    return S.rank_by(first, F.desc("score"), F.desc("minus")).select("k", "rank")


_ALL = f"""{_NV}, {_EF}, sem_c AS (SELECT k, row_number() OVER (ORDER BY sim DESC, k) AS rank FROM (SELECT k, sim FROM sem ORDER BY sim DESC, k LIMIT 40)),
all4 AS (SELECT k, rank, 1 AS a, 0 AS b, 0 AS c, 0 AS e FROM text_c UNION ALL SELECT k, rank, 0, 1, 0, 0 FROM sem_c UNION ALL SELECT k, rank, 0, 0, 1, 0 FROM ent_c UNION ALL SELECT k, rank, 0, 0, 0, 1 FROM edge_c),
f4 AS (SELECT k, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, max(a) = 1 AS in_text, max(b) = 1 AS in_semantic, max(c) = 1 AS in_entity, max(e) = 1 AS in_edges FROM all4 GROUP BY 1),
m4 AS (SELECT f4.*, coalesce(n.title, regexp_extract(f4.k, '[^/]*$')) AS title FROM f4 LEFT JOIN notes n ON n.k = f4.k)"""
_BOOST = "CASE WHEN lower(title) = 'index' THEN 0.5 WHEN starts_with(lower(title), 'index') THEN 0.2 ELSE 0 END"


def hybrid(spark, d):
    """The four channels fused, with titles."""
    c, r = _channels(spark, d)
    near = _near(spark, d).select("k", "sim").orderBy(F.desc("sim"), "k").limit(40)
    four = {"text": c["text"], "semantic": S.rank_by(near, F.desc("sim"), "k").select("k", "rank"), "entity": entity_channel(spark, d), "edges": c["edges"]}
    n = V.notes(spark, d).select("k", "title")
    f = S.fuse(four, "k").join(n, "k", "left").withColumn("title", F.coalesce("title", file_stem(F.col("k"))))
    t = F.lower("title")
    boost = F.when(t == "index", 0.5).when(F.startswith(t, F.lit("index")), 0.2).otherwise(0.0)
    return f.withColumn("score", F.round(F.col("rrf") + boost, 6)), r


@add(f"WITH {_ALL} SELECT k, title, round(rrf + {_BOOST}, 6) AS score, in_text, in_semantic, in_entity, in_edges FROM m4")
def hybrid_channels(spark, d):
    """Text, vectors, entities and links fused by reciprocal rank, with the boosts of titles and the channels of each note."""
    f, _ = hybrid(spark, d)
    return f.select("k", "title", "score", "in_text", "in_semantic", "in_entity", "in_edges")


@add(f"WITH {_EF}, u AS (SELECT k, 0 AS channel, rank FROM text_c UNION ALL SELECT k, 1, rank FROM ent_c WHERE k NOT IN (SELECT k FROM text_c)), ut AS (SELECT u.*, coalesce(n.title, regexp_extract(u.k, '[^/]*$')) AS title FROM u LEFT JOIN notes n ON n.k = u.k) SELECT k, channel, row_number() OVER (ORDER BY CASE WHEN lower(title) = 'index' THEN 2 WHEN starts_with(lower(title), 'index') THEN 1 ELSE 0 END DESC, channel, rank, k) AS pos FROM ut")
def hybrid_text_entities(spark, d):
    """The list without vectors: text hits in their order, then notes of entities only; titles that are or begin with the query first."""
    text = S.rank_by(note_bm25(spark, d, {"content": 1.0}, TERMS, 40), F.desc("score"), "k").select("k", "rank")
    ent = entity_channel(spark, d).join(text.select("k"), "k", "left_anti")
    both = text.withColumn("channel", F.lit(0)).unionByName(ent.withColumn("channel", F.lit(1))).join(V.notes(spark, d).select("k", "title"), "k", "left")
    t = F.lower(F.coalesce("title", file_stem(F.col("k"))))
    bonus = F.when(t == "index", 2).when(F.startswith(t, F.lit("index")), 1).otherwise(0)
    return both.withColumn("pos", F.row_number().over(Window.orderBy(F.desc(bonus), "channel", "rank", "k"))).select("k", "channel", "pos")  # two short lists


_TOP = "tp AS (SELECT k, row_number() OVER (ORDER BY rrf DESC, k) AS rank FROM (SELECT k, rrf FROM fused ORDER BY rrf DESC, k LIMIT 10))"


@add(f"""WITH {_TOP}, t5 AS (SELECT * FROM tp WHERE rank <= 5), nov AS (SELECT count(*) AS c FROM (SELECT DISTINCT src, dst FROM res JOIN t5 ON t5.k = src WHERE len(dst) >= 3 AND NOT contains('backlink digest index', dst))), fo AS (SELECT count(DISTINCT regexp_extract(k, '^(.*)/[^/]*$', 1)) AS c, count(*) AS n FROM t5), h AS (SELECT count(*) AS n FROM tp)
SELECT h.n AS n_hits, nov.c AS n_novel, fo.c AS n_folders, CASE WHEN h.n < 3 THEN TRUE WHEN h.n >= 8 THEN FALSE WHEN nov.c >= 3 THEN TRUE ELSE fo.c = 1 AND fo.n >= 3 END AS second_hop FROM h, nov, fo""")
def hybrid_hop_wanted(spark, d):
    """Whether a list needs notes from a second hop: very few hits, novel targets among the first five, or all of them in one folder."""
    c, r = _channels(spark, d)
    top = S.rank_by(S.fuse(c, "k").orderBy(F.desc("rrf"), "k").limit(10), F.desc("rrf"), "k")
    five = top.where("rank <= 5").select("k")
    novel = r.join(F.broadcast(five.toDF("src")), "src").where((F.length("dst") >= 3) & ~F.contains(F.lit(" ".join(sorted(TERMS))), F.col("dst"))).select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("n_novel"))
    folders = five.agg(F.countDistinct(F.regexp_extract("k", r"^(.*)/[^/]*$", 1)).alias("n_folders"), F.count(F.lit(1)).alias("n5"))
    n = top.agg(F.count(F.lit(1)).alias("n_hits"))
    x = n.crossJoin(F.broadcast(novel)).crossJoin(F.broadcast(folders))  # one row each
    want = F.when(F.col("n_hits") < 3, True).when(F.col("n_hits") >= 8, False).when(F.col("n_novel") >= 3, True).otherwise((F.col("n_folders") == 1) & (F.col("n5") >= 3))
    return x.select("n_hits", "n_novel", "n_folders", want.alias("second_hop"))


_DEC = f"greatest(0.1, 1 - (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(n.modified)) / 86400000000.0 / 180)"


@add(f"""WITH {_TOP}, o1 AS (SELECT DISTINCT tp.k AS parent, target_k AS k FROM tp JOIN res ON src = tp.k WHERE target_k IS NOT NULL AND target_k NOT IN (SELECT k FROM tp)), c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY k) AS rn FROM o1) WHERE rn <= 10),
h1 AS (SELECT k, min(parent) AS via FROM c1 GROUP BY 1), o2 AS (SELECT DISTINCT h1.k AS parent, target_k AS k FROM h1 JOIN res ON src = h1.k WHERE target_k IS NOT NULL AND target_k NOT IN (SELECT k FROM tp) AND target_k NOT IN (SELECT k FROM h1)), c2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY k) AS rn FROM o2) WHERE rn <= 10),
al AS (SELECT k, via, 1 AS hop FROM h1 UNION ALL SELECT k, min(parent), 2 FROM c2 GROUP BY 1), hub AS (SELECT name_lower, max(hub_score) AS hub FROM ents GROUP BY 1)
SELECT al.k, via, hop, round(coalesce(hub.hub, 1) * {_DEC}, 6) AS score FROM al JOIN notes n ON n.k = al.k LEFT JOIN hub ON hub.name_lower = lower(n.title) ORDER BY score DESC, al.k LIMIT 10""")
def hybrid_backfill(spark, d):
    """The ten best notes within two links of the first ten hits, at most ten per parent, by hub score times recency."""
    c, r = _channels(spark, d)
    top = S.fuse(c, "k").orderBy(F.desc("rrf"), "k").limit(10).select("k")
    links = r.where(F.col("to").isNotNull()).select("src", F.col("to").alias("k"))

    def hop(parents, seen):
        o = links.join(parents.toDF("src"), "src").select(F.col("src").alias("parent"), "k").distinct().join(seen, "k", "left_anti")
        w = Window.partitionBy("parent").orderBy("k")
        return o.withColumn("rn", F.row_number().over(w)).where("rn <= 10").groupBy("k").agg(F.min("parent").alias("via"))

    one = hop(top, top)
    two = hop(one.select("k"), top.union(one.select("k")))
    both = one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))
    hub = V.entities(spark, d).groupBy(F.col("name_lower").alias("t")).agg(F.max("hub_score").alias("hub"))
    n = V.notes(spark, d).select("k", F.lower("title").alias("t"), "modified")
    x = both.join(n, "k").join(hub, "t", "left")
    return x.select("k", "via", "hop", F.round(F.coalesce("hub", F.lit(1)) * recency_decay(F.col("modified"), AS_OF), 6).alias("score")).orderBy(F.desc("score"), "k").limit(10)


@add(f"""WITH {_TOP}, ex AS (SELECT DISTINCT dst AS term FROM (SELECT dst, count(DISTINCT src) AS c FROM res JOIN tp ON tp.k = src WHERE len(dst) >= 3 AND NOT contains('backlink digest index', dst) GROUP BY 1 ORDER BY c DESC, dst LIMIT 10)),
tw AS (SELECT term, unnest(list_distinct({_W.format('term')})) AS w FROM ex), ew AS (SELECT id, regexp_replace(lower(trim(path)), '\\.md$', '') AS ek, {_W.format("name || ' ' || array_to_string(aliases, ' ')")} AS w FROM ents), xst AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM ew),
p AS (SELECT id, ek, dl, w, count(*) AS tf FROM (SELECT id, ek, len(w) AS dl, unnest(w) AS w FROM ew) WHERE w IN (SELECT w FROM tw) GROUP BY 1, 2, 3, 4), df AS (SELECT w, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT term, id, ek, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score FROM p JOIN df USING (w) JOIN tw USING (w), xst GROUP BY 1, 2, 3)
SELECT DISTINCT ek AS k FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3 AND ek IS NOT NULL AND ek NOT IN (SELECT k FROM tp)""")
def hybrid_expanded(spark, d):
    """Notes of the three best entities for each of ten targets that the first hits link to: the list's expansion."""
    c, r = _channels(spark, d)
    top = S.fuse(c, "k").orderBy(F.desc("rrf"), "k").limit(10).select("k")
    x = r.join(F.broadcast(top.toDF("src")), "src").where((F.length("dst") >= 3) & ~F.contains(F.lit(" ".join(sorted(TERMS))), F.col("dst")))
    ten = x.groupBy("dst").agg(F.countDistinct("src").alias("c")).orderBy(F.desc("c"), "dst").limit(10).select(F.col("dst").alias("query_id"))
    q = ten.select("query_id", F.explode(F.array_distinct(S.words(F.col("query_id")))).alias("term"))
    e = V.entities(spark, d).select("id", link_key("path").alias("k"), F.concat_ws(" ", "name", F.array_join("aliases", " ")).alias("t"))
    got = S.bm25_batch(e, "id", "t", q, 3).select("id").distinct()
    return e.join(got, "id").where("k is not null").select("k").distinct().join(top, "k", "left_anti")


@add(
    assoc_book.common
    + f""", q AS (SELECT id AS qid, name AS qname FROM ents), exact AS (SELECT qid, e.id, 'name' AS why, 1.0::DOUBLE AS score FROM q JOIN ents e ON lower(e.name) = lower(qname) AND e.id <> qid),
ev AS (SELECT entity_name, v FROM (SELECT entity_name, embedding::DOUBLE[] AS v, model, row_number() OVER (PARTITION BY entity_name ORDER BY updated_at DESC, model DESC, embedding DESC) AS rn FROM entity_embeddings WHERE entity_name IS NOT NULL) WHERE rn = 1 AND model = '{MODEL}' AND len(v) = {SIZE} AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
iv AS (SELECT e.id, ev.v FROM ev JOIN (SELECT name, min(id) AS id FROM ents GROUP BY 1) e ON e.name = ev.entity_name), vec AS (SELECT a.id AS qid, b.id, 'vector' AS why, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM iv a JOIN iv b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.85 AND a.id % 10 = 0)
SELECT qid, id, why, score FROM exact UNION ALL SELECT qid, id, why, score FROM vec""",
    common=False,
)
def vector_duplicates(spark, d):
    """What a new note would repeat: for each entity others of its name, and for each tenth entity as a query those whose vector is very close."""
    e = V.entities(spark, d).select("id", "name")
    a = e.select(F.col("id").alias("qid"), F.lower("name").alias("low")).join(e.select("id", F.lower("name").alias("low")), "low").where("id <> qid").select("qid", "id", F.lit("name").alias("why"), F.lit(1.0).alias("score"))
    v = table(spark, d, "entity_embeddings").where("entity_name is not null").groupBy(F.col("entity_name").alias("name")).agg(F.max(F.struct("updated_at", "model", F.col("embedding").alias("v"))).alias("x")).select("name", "x.model", "x.v")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    v = v.where((F.col("model") == MODEL) & (F.size("v") == SIZE) & good).join(e.groupBy("name").agg(F.min("id").alias("id")), "name").select("id", "v")
    return a.unionByName(S.close_vectors(v, v.where(F.col("id") % 10 == 0), 0.85).select("qid", "id", F.lit("vector").alias("why"), "score"))


@add("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS pos FROM e), m AS (SELECT label, pos, avg(x) AS x FROM x GROUP BY 1, 2 HAVING count(*) >= 3), c AS (SELECT label, list(x ORDER BY pos) AS c FROM m GROUP BY 1),
s AS (SELECT vec_id, c.label, round(list_cosine_similarity(v, c), 6) AS sim FROM e, c WHERE vec_id % 100 = 0) SELECT vec_id, label, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS rank FROM s WHERE sim >= 0.30) WHERE rank <= 3""", common=False)
def route_by_vectors(spark, d):
    """The three categories nearest to each query vector (every hundredth one) by cosine to their centroids, 0.30 or more."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    c = S.centroids(e)
    s = e.where(F.col("vec_id") % 100 == 0).drop("label").crossJoin(F.broadcast(S.few(c))).select("vec_id", "label", F.round(cosine(F.col("v"), F.col("centroid")), 6).alias("sim")).where("sim >= 0.30")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("sim"), "label"))).where("rank <= 3")


# ---- associations that lists are ranked by --------------------------------------------------------------------------------

_NPMI = "round(greatest(0.0, least(1.0, ln((p.n * 1.0 / tot.n) / ((x.df * 1.0 / tot.n) * (y.df * 1.0 / tot.n))) / -ln(p.n * 1.0 / tot.n))), 6)"


@add(
    assoc_book.common
    + f""", np AS (SELECT a, b, {_NPMI} AS v FROM pairs p JOIN edf x ON x.entity = a JOIN edf y ON y.entity = b, tot WHERE p.n >= 2 AND p.n < tot.n), both_ AS (SELECT a AS seed, b AS entity, v FROM np UNION ALL SELECT b, a, v FROM np),
rc AS (SELECT entity, max(modified) >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR AS recent FROM men JOIN notes ON notes.k = men.note GROUP BY 1),
c AS (SELECT men.note, both_.entity, max(v) AS v FROM men JOIN both_ ON both_.seed = men.entity GROUP BY 1, 2)
SELECT c.note, c.entity, CAST(least(floor(c.v * 12 * CASE WHEN rc.recent THEN 1.5 ELSE 0.5 END + 0.5), 12) AS INTEGER) AS boost FROM c LEFT JOIN rc ON rc.entity = c.entity LEFT JOIN men m ON m.note = c.note AND m.entity = c.entity WHERE m.note IS NULL AND c.v > 0 AND floor(c.v * 12 * CASE WHEN rc.recent THEN 1.5 ELSE 0.5 END + 0.5) >= 6""",
    common=False,
)
def assoc_note_boosts(spark, d):
    """Entities that a note doesn't mention and that go with those it does: the greatest mutual information over its seeds times 12, more for recent ones, 6 to 12.

    Pairs that are too weak for any note are dropped before notes come in.
    """
    n = V.notes(spark, d).select(F.col("k").alias("note"), "modified")
    m = cut(mentions(spark, d))
    rec = m.join(n, "note").groupBy("entity").agg((F.max("modified") >= F.lit(AS_OF).cast("timestamp_ntz") - F.expr("interval 168 hours")).alias("up"))
    strong = A.strong_pairs(npmi_pairs(m), rec, 6)
    c = m.withColumnRenamed("entity", "seed").join(strong, "seed").groupBy("note", "entity").agg(F.max("boost").alias("boost"))
    return c.join(m, ["note", "entity"], "left_anti").select("note", "entity", "boost")


@add("""WITH r AS (SELECT user_id || '-' || CAST(ts AS DATE) AS session, CAST(json_extract_string(props, '$.k') AS BIGINT) AS note, ts FROM events), s AS (SELECT session, list_sort(list(DISTINCT note)) AS es, max(ts) AS at_ FROM r GROUP BY 1 HAVING count(DISTINCT note) >= 2),
x AS (SELECT session, unnest(es) AS note, len(es) AS n, at_ FROM s), w AS (SELECT a.note AS a, b.note AS b, round(sum(exp(-ln(2) * greatest((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(a.at_)) / 86400000000.0, 0) / 7) / CASE WHEN a.n > 2 THEN ln(a.n) ELSE 1 END), 6) AS weight FROM x a JOIN x b ON a.session = b.session AND a.note < b.note GROUP BY 1, 2),
n AS (SELECT a AS note, weight FROM w UNION ALL SELECT b, weight FROM w) SELECT note, CAST(least(floor(3 * max(weight) + 0.5), 6) AS INTEGER) AS boost FROM n GROUP BY 1""", common=False)
def assoc_retrieval_boosts(spark, d):
    """Boost of each note by its strongest co-retrieval: three times the weight, rounded, at most 6."""
    from wherry.plans import association as P

    w = P.assoc_co_retrieval(spark, d)
    n = w.select(F.col("a").alias("note"), "weight").union(w.select("b", "weight"))
    return n.groupBy("note").agg(F.least(F.floor(3 * F.max("weight") + 0.5), F.lit(6)).cast("int").alias("boost"))


@add(V.VAULT_SQL + f""", w AS (SELECT doc_id, {_W.format('text')} AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT DISTINCT doc_id, unnest(list_concat(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || w[i + 1])), list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || w[i + 1] || w[i + 2]))) AS term FROM w),
e AS (SELECT id, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS term FROM ents WHERE len(name) > 3 AND name <> upper(name)) SELECT doc_id, id FROM g JOIN e USING (term) WHERE len(term) >= 4""", common=False)
def assoc_collapsed_names(spark, d):
    """Entities whose name without blanks and signs is one to three words of a document written together. Acronyms and short names are left out; only grams that begin like a name are shuffled."""
    from wherry.functions.exprs import fuzzy_key

    e = V.entities(spark, d).where((F.length("name") > 3) & (F.col("name") != F.upper("name"))).select("id", fuzzy_key(F.col("name")).alias("term")).where(F.length("term") >= 4)
    w = S.words(F.col("text"))
    t = table(spark, d, "documents").where("text is not null").select("doc_id", w.alias("w"))
    n = F.size("w")
    two = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    three = F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.concat(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2)))).otherwise(F.array().cast("array<string>"))
    g = t.select("doc_id", F.explode(F.array_distinct(F.concat("w", two, three))).alias("term")).where(F.length("term") >= 4)
    return g.join(e, "term").select("doc_id", "id").distinct()


_ACC = "avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)"


@add(
    f"""WITH ek1 AS (SELECT id, regexp_replace(lower(trim(name)), '\\.md$', '') AS key FROM ents UNION SELECT id, regexp_replace(lower(trim(a)), '\\.md$', '') FROM (SELECT id, unnest(aliases) AS a FROM ents)), ow AS (SELECT key, min(id) AS id FROM ek1 WHERE key <> '' GROUP BY 1), me AS (SELECT DISTINCT src AS note, id AS entity FROM links JOIN ow ON key = dst),
tt AS (SELECT count(DISTINCT note) AS n FROM me), ed AS (SELECT entity, count(*) AS df FROM me GROUP BY 1), pa AS (SELECT x.entity AS a, y.entity AS b, count(*) AS n FROM me x JOIN me y ON x.note = y.note AND x.entity <> y.entity GROUP BY 1, 2),
nm AS (SELECT a, b, round(CASE WHEN p.n * 1.0 / tt.n >= 1 THEN 1.0 ELSE greatest(0.0, least(1.0, ln((p.n * 1.0 / tt.n) / ((x.df * 1.0 / tt.n) * (y.df * 1.0 / tt.n))) / -ln(p.n * 1.0 / tt.n))) END, 6) AS v FROM pa p JOIN ed x ON x.entity = a JOIN ed y ON y.entity = b, tt WHERE p.n >= 2),
rc AS (SELECT entity, CASE WHEN max(modified) >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR THEN 8 WHEN max(modified) >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR THEN 5 WHEN max(modified) >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR THEN 3 WHEN max(modified) >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR THEN 1 ELSE 0 END AS r FROM me JOIN notes ON notes.k = me.note GROUP BY 1),
fe AS (SELECT f.k, f.rrf, min(e.id) AS id, lower(any_value(n.title)) AS low FROM fused f JOIN notes n ON n.k = f.k LEFT JOIN ents e ON e.name_lower = lower(n.title) GROUP BY 1, 2),
co AS (SELECT a.k, max(v) AS v FROM fe a JOIN nm ON nm.b = a.id JOIN fe s ON s.id = nm.a AND s.k <> a.k GROUP BY 1),
fbk AS (SELECT dst AS entity, weight >= 0.5 AS ok, exp(-ln(2) * greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(wt)) / 86400000000.0, 0) / 30) * weight AS w FROM links WHERE wt IS NOT NULL AND weight IS NOT NULL), fs AS (SELECT entity, count(*) AS n, {_ACC} AS acc, (sum(CASE WHEN ok THEN w ELSE 0 END) + 4) / (sum(w) + 5) AS p FROM fbk GROUP BY 1),
fd AS (SELECT entity, CASE WHEN p < 0.45 THEN floor(-15 * (1 - p / 0.45) + 0.5) WHEN p < 0.55 THEN -5 WHEN acc >= 0.85 AND n >= 5 THEN 10 WHEN acc >= 0.7 AND n >= 3 THEN 6 ELSE 0 END AS f FROM fs), ew AS (SELECT target_k AS k, avg(weight) AS w FROM res WHERE target_k IS NOT NULL AND weight > 1 GROUP BY 1)
SELECT fe.k, round(rrf + (coalesce(CASE WHEN co.v > 0 THEN least(floor(co.v * 12 * CASE WHEN coalesce(rc.r, 0) > 0 THEN 1.5 ELSE 0.5 END + 0.5), 12) END, 0) + coalesce(rc.r, 0) + coalesce(fd.f, 0) + CASE WHEN ew.w > 1 THEN least((ew.w - 1) * 3, 6) ELSE 0 END) / 50, 6) AS score
FROM fe LEFT JOIN co ON co.k = fe.k LEFT JOIN rc ON rc.entity = fe.id LEFT JOIN fd ON fd.entity = fe.low LEFT JOIN ew ON ew.k = fe.k"""
)
def hybrid_reranked(spark, d):
    """The fused list re-ranked by what its notes' entities say: co-occurrence with the other hits, recency, feedback, and the mean weight of strong links."""
    from wherry.plans.feedback import scored, tier
    from wherry.plans.learning import feedback

    c, r = _channels(spark, d)
    ent = V.entities(spark, d).groupBy(F.col("name_lower").alias("low")).agg(F.min("id").alias("id"))
    n = V.notes(spark, d)
    f = cut(S.fuse(c, "k").select("k", "rrf").join(n.select("k", F.lower("title").alias("low")), "k").join(ent, "low", "left"))
    m = cut(mentions(spark, d))
    p = npmi_pairs(m)
    both = p.select(F.col("a").alias("seed"), F.col("b").alias("id"), "npmi").unionByName(p.select(F.col("b").alias("seed"), F.col("a").alias("id"), "npmi"))
    hits = f.where("id is not null").select("k", "id")  # a short list
    go = both.join(F.broadcast(hits.select(F.col("id").alias("seed"), F.col("k").alias("other"))), "seed").join(F.broadcast(hits), "id").where("k <> other").groupBy("k").agg(F.max("npmi").alias("v"))
    last = m.join(n.select(F.col("k").alias("note"), "modified"), "note").groupBy(F.col("entity").alias("id")).agg(F.max("modified").alias("last")).select("id", recency_boost(F.col("last"), AS_OF).alias("recency"))
    fb = scored(feedback(spark, d), "entity").select(F.col("entity").alias("low"), tier(beta_mean(F.col("good"), F.col("bad")), F.col("acc"), F.col("n")).alias("feedback"))
    w = r.where(F.col("to").isNotNull() & (F.col("weight") > 1)).groupBy(F.col("to").alias("k")).agg(F.avg("weight").alias("w"))
    x = f.join(go, "k", "left").join(last, "id", "left").join(fb, "low", "left").join(w, "k", "left")
    rec = F.coalesce("recency", F.lit(0))
    cooc = F.when(F.col("v") > 0, F.least(F.floor(F.col("v") * 12 * F.when(rec > 0, 1.5).otherwise(0.5) + 0.5), F.lit(12))).otherwise(0)
    edge = F.when(F.col("w") > 1, F.least((F.col("w") - 1) * 3, F.lit(6.0))).otherwise(0.0)
    return x.select("k", F.round(F.col("rrf") + (cooc + rec + F.coalesce("feedback", F.lit(0)) + edge) / 50, 6).alias("score"))


QUERIES, SQL = book.queries, book.sql
