"""Queries over the link graph of the notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wherry.functions.exprs import folder_of, recency_decay
from wherry.operators import graph as G
from wherry.operators import vault as V
from wherry.plans.book import Book
from wherry.session import link_key

AS_OF = "2026-06-01"
#: The most links of a path, as in the reference.
DEPTH = 10
book = Book(
    V.VAULT_SQL
    + """, edges AS (SELECT DISTINCT src, target_k AS dst FROM res WHERE target_k IS NOT NULL AND src IN (SELECT k FROM notes)),
deg AS (SELECT k, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src AS k, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges UNION ALL SELECT k, 0, 0 FROM notes) GROUP BY 1),
und AS (SELECT src, dst FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst)
"""
)
add = book.add


def base(spark: SparkSession, d: str, *extra: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Notes, resolved links, note-to-note edges."""
    n = V.notes(spark, d, *extra)
    r = V.resolved(V.links(spark, d), V.entity_keys(n, V.entities(spark, d)))
    return n, r, G.note_edges(r, n)


def note_tags(notes: DataFrame) -> DataFrame:
    """``k, tag``: the tags of notes, once each. Their frontmatter has them as a list in brackets; the double brackets of a link are none."""
    lists = F.regexp_extract_all("frontmatter", F.lit(r"(?<!\[)\[([^\[\]]*)\](?!\])"), 1)
    items = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda t: F.regexp_replace(F.trim(t), "^[\"'#]+|[\"']+$", ""))
    return notes.select("k", F.explode(items).alias("tag")).where("tag <> ''").distinct()


def pair_strength(e: DataFrame, n: DataFrame) -> DataFrame:
    """Strength of every linked pair, with shared tags; ``n`` has the notes' ``frontmatter``."""
    return G.strength(e, n.select("k", folder_of(F.col("k")).alias("folder")), note_tags(n))


@add("SELECT link_id, src, dst, target_k AS leads_to, target_k IS NOT NULL AS is_there FROM res")
def join_forward_links(spark, d):
    """Every link with the note it leads to."""
    _, r, _ = base(spark, d)
    return r.select("link_id", "src", "dst", F.col("to").alias("leads_to"), F.col("to").isNotNull().alias("is_there"))


@add(f"SELECT target_k AS k, src, round(max(weight), 6) AS weight, round(max(greatest(0.1, CASE WHEN wt IS NULL THEN 0.5 ELSE 1 - epoch_us(TIMESTAMP '{AS_OF}') / 86400000000.0 / 180 + epoch_us(wt) / 86400000000.0 / 180 END)), 4) AS decay FROM res WHERE target_k IS NOT NULL GROUP BY 1, 2")
def join_backlinks_weighted(spark, d):
    """Backlinks of every note: greatest weight and recency per source."""
    _, r, _ = base(spark, d)
    return r.where(F.col("to").isNotNull()).groupBy(F.col("to").alias("k"), "src").agg(F.round(F.max("weight"), 6).alias("weight"), F.round(F.max(recency_decay(F.col("at"), AS_OF)), 4).alias("decay"))


@add("SELECT src, rank, target_k AS k, round(weight, 6) AS weight FROM (SELECT src, target_k, max(weight) AS weight, row_number() OVER (PARTITION BY src ORDER BY max(weight) DESC, target_k) AS rank FROM res WHERE target_k IS NOT NULL GROUP BY 1, 2) WHERE rank <= 3")
def join_top_outlinks(spark, d):
    """The three heaviest resolved links of each note."""
    _, r, _ = base(spark, d)
    g = r.where(F.col("to").isNotNull()).groupBy("src", F.col("to").alias("k")).agg(F.max("weight").alias("weight"))
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "k")
    return g.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("src", "rank", "k", F.round("weight", 6).alias("weight"))


@add("SELECT key, k FROM keys")
def join_entity_keys(spark, d):
    """All keys by which a link finds a note."""
    n = V.notes(spark, d)
    return V.entity_keys(n, V.entities(spark, d))


@add("SELECT k, path FROM notes WHERE k NOT IN (SELECT target_k FROM res WHERE target_k IS NOT NULL)")
def graph_orphans_no_backlinks(spark, d):
    """Notes nothing links to."""
    n, r, _ = base(spark, d)
    return n.join(r.select(F.col("to").alias("k")), "k", "left_anti").select("k", "path")


@add("SELECT k, path FROM notes WHERE k NOT IN (SELECT target_k FROM res WHERE target_k IS NOT NULL) AND k NOT IN (SELECT src FROM res)")
def graph_orphans_isolated(spark, d):
    """Notes without links either way."""
    n, r, _ = base(spark, d)
    return n.join(r.select(F.col("to").alias("k")), "k", "left_anti").join(r.select(F.col("src").alias("k")), "k", "left_anti").select("k", "path")


@add("SELECT k, n_in, n_out, n_in + n_out AS degree FROM deg WHERE n_in + n_out >= 10")
def graph_hubs(spark, d):
    """Notes with ten links or more, both ways together."""
    n, _, e = base(spark, d)
    return G.degrees(e, n).withColumn("degree", F.col("n_in") + F.col("n_out")).where("degree >= 10")


@add("SELECT k, n_in FROM deg WHERE n_out = 0 AND n_in >= 2")
def graph_dead_ends(spark, d):
    """Notes that are linked to at least twice and link to nothing."""
    n, _, e = base(spark, d)
    return G.degrees(e, n).where("n_out = 0 and n_in >= 2").select("k", "n_in")


@add("SELECT k, n_out FROM deg WHERE n_in = 0 AND n_out >= 3")
def graph_sources(spark, d):
    """Notes that link to at least three and are linked to by none."""
    n, _, e = base(spark, d)
    return G.degrees(e, n).where("n_in = 0 and n_out >= 3").select("k", "n_out")


@add(f"SELECT notes.k, path, n_in FROM notes JOIN deg ON deg.k = notes.k WHERE modified < TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY AND n_in >= 1")
def graph_stale(spark, d):
    """Linked notes that nobody has changed for 400 days."""
    n, _, e = base(spark, d)
    old = n.where(F.col("modified").cast("timestamp") < F.lit(AS_OF).cast("timestamp") - F.expr("interval 400 days"))
    return old.join(G.degrees(e, n), "k").where("n_in >= 1").select("k", "path", "n_in")


@add("SELECT CAST(modified AS DATE) AS day, count(*) AS n_notes FROM notes GROUP BY 1")
def graph_modified_per_day(spark, d):
    """Notes by the day of their last change."""
    return V.notes(spark, d).groupBy(F.to_date("modified").alias("day")).agg(F.count(F.lit(1)).alias("n_notes"))


@add("SELECT k, path FROM notes WHERE modified >= DATE '2025-03-01' AND modified < DATE '2025-03-31' + INTERVAL 1 DAY")
def graph_modified_in_range(spark, d):
    """Notes changed in a range of days, both ends included."""
    return V.notes(spark, d).where((F.col("modified") >= F.lit("2025-03-01").cast("timestamp_ntz")) & (F.col("modified") < F.lit("2025-04-01").cast("timestamp_ntz"))).select("k", "path")


@add("SELECT a.src AS a, b.src AS b, count(*) AS n_shared FROM edges a JOIN edges b ON a.dst = b.dst AND a.src < b.src GROUP BY 1, 2 HAVING count(*) >= 2")
def join_common_neighbours(spark, d):
    """Pairs of notes that share at least two targets, hubs among them."""
    return G.common_targets(base(spark, d)[2])


@add("SELECT x.src AS a, x.dst AS b FROM edges x JOIN edges y ON x.src = y.dst AND x.dst = y.src WHERE x.src <= x.dst")
def join_bidirectional(spark, d):
    """Notes that link to each other, and notes that link to themselves."""
    _, _, e = base(spark, d)
    return e.where("src <= dst").join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).toDF("a", "b")


#: Tags and strength of every linked pair for DuckDB.
_STRENGTH = """tag AS (SELECT DISTINCT k, tag FROM (SELECT k, regexp_replace(trim(t), '^["''#]+|["'']+$', '', 'g') AS tag FROM (SELECT k, unnest(string_split(x, ',')) AS t FROM (SELECT k, unnest(regexp_extract_all(regexp_replace(frontmatter, '\\[\\[[^\\[\\]]*\\]\\]', ' ', 'g'), '\\[([^\\[\\]]*)\\]', 1)) AS x FROM notes))) WHERE tag <> ''),
lp AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(DISTINCT src) AS n FROM edges WHERE src <> dst GROUP BY 1, 2),
ct AS (SELECT a, b, count(*) AS n FROM lp JOIN edges x ON x.src = a AND x.dst <> x.src JOIN edges y ON y.src = b AND y.dst = x.dst AND y.dst <> y.src GROUP BY 1, 2),
tg AS (SELECT a, b, count(*) AS n FROM lp JOIN tag x ON x.k = a JOIN tag y ON y.k = b AND y.tag = x.tag GROUP BY 1, 2),
strong AS (SELECT lp.a, lp.b, CASE WHEN lp.n = 2 THEN 3.0 ELSE 1.0 END + coalesce(tg.n, 0) + 0.5 * coalesce(ct.n, 0) + CASE WHEN regexp_extract(lp.a, '^(.*)/[^/]*$', 1) = regexp_extract(lp.b, '^(.*)/[^/]*$', 1) AND contains(lp.a, '/') THEN 1.0 ELSE 0.0 END AS strength
  FROM lp LEFT JOIN ct ON ct.a = lp.a AND ct.b = lp.b LEFT JOIN tg ON tg.a = lp.a AND tg.b = lp.b)"""


@add(f"WITH {_STRENGTH} SELECT a, b, CAST(strength AS DOUBLE) AS strength FROM strong")
def graph_connection_strength(spark, d):
    """Strength of every linked pair."""
    n, _, e = base(spark, d, "frontmatter")
    return pair_strength(e, n)


@add("""SELECT k, other, weight, rank FROM (SELECT k, other, max(weight) AS weight, row_number() OVER (PARTITION BY k ORDER BY max(weight) DESC, other) AS rank FROM
(SELECT src AS k, target_k AS other, round(weight, 6) AS weight FROM res WHERE target_k IS NOT NULL UNION ALL SELECT target_k, src, round(weight, 6) FROM res WHERE target_k IS NOT NULL) GROUP BY 1, 2) WHERE rank <= 5""")
def graph_strong_connections(spark, d):
    """The five strongest neighbours of each note, links of both directions together."""
    _, r, _ = base(spark, d)
    r = r.where(F.col("to").isNotNull())
    both = r.select(F.col("src").alias("k"), F.col("to").alias("other"), "weight").union(r.select("to", "src", "weight"))
    g = both.groupBy("k", "other").agg(F.max(F.round("weight", 6)).alias("weight"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("weight"), "other"))).where("rank <= 5")


def _root(e: DataFrame) -> DataFrame:
    """The note with the most links out, the smaller key among equals."""
    return e.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(1).select(F.col("src").alias("root"))


_ROOT = "root AS (SELECT src AS root FROM edges GROUP BY 1 ORDER BY count(*) DESC, src LIMIT 1)"


_HOPS = ", ".join(["h0 AS (SELECT root AS k FROM root)", *[f"h{i} AS (SELECT DISTINCT dst AS k FROM edges JOIN h{i - 1} ON src = k)" for i in range(1, DEPTH + 1)]])


@add(f"WITH {_ROOT}, {_HOPS} SELECT k, CAST(min(hop) AS INTEGER) AS hop FROM (" + " UNION ALL ".join(f"SELECT k, {i} AS hop FROM h{i}" for i in range(DEPTH + 1)) + ") GROUP BY 1")
def graph_shortest_hops(spark, d):
    """Notes within ten links of the note with the most links, with their distance."""
    _, _, e = base(spark, d)
    from wherry.session import cut

    e = cut(e)
    return G.hops(e, _root(e), DEPTH).select("k", "hop")


@add(f"""WITH {_ROOT}, h1 AS (SELECT DISTINCT dst AS k FROM und JOIN root ON src = root), h2 AS (SELECT DISTINCT dst AS k FROM und JOIN h1 ON src = k), ego AS (SELECT root AS k FROM root UNION SELECT k FROM h1 UNION SELECT k FROM h2)
SELECT src, dst FROM edges WHERE src IN (SELECT k FROM ego) AND dst IN (SELECT k FROM ego)""")
def graph_ego_network(spark, d):
    """Edges among the notes within two hops of the note with the most links, either direction."""
    from wherry.session import cut

    _, _, e = base(spark, d)
    e = cut(e)
    ego = G.hops(G.undirected(e), _root(e), 2).select("k")
    return e.join(ego.toDF("src"), "src", "left_semi").join(ego.toDF("dst"), "dst", "left_semi").select("src", "dst")


def path_costs(e: DataFrame, n: DataFrame) -> DataFrame:
    """``src, dst, w``: each edge both ways at 1 / (1 + strength) times 1 + log2 of the links of the note it leads to."""
    deg = G.degrees(e, n).select(F.col("k").alias("dst"), (F.col("n_in") + F.col("n_out")).alias("deg"))
    u = G.undirected(e).withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst")).join(pair_strength(e, n), ["a", "b"]).join(deg, "dst")
    return u.select("src", "dst", F.round((1.0 / (1 + F.col("strength"))) * (1 + F.log2("deg")), 9).alias("w"))


_W = "w AS (SELECT u.src, u.dst, round((1.0 / (1 + strength)) * (1 + log2(deg.n_in + deg.n_out)), 9) AS w FROM und u JOIN deg ON deg.k = u.dst JOIN strong s ON s.a = least(u.src, u.dst) AND s.b = greatest(u.src, u.dst))"
_PATHS = ", ".join(["p0 AS (SELECT root AS k, 0.0::DOUBLE AS cost FROM root)", *[f"p{i} AS (SELECT k, min(cost) AS cost FROM (SELECT * FROM p{i - 1} UNION ALL SELECT dst, round(cost + w, 9) FROM p{i - 1} JOIN w ON src = k) GROUP BY 1)" for i in range(1, DEPTH + 1)]])


@add(f"WITH {_ROOT}, {_STRENGTH}, {_W}, {_PATHS} SELECT k, round(cost, 6) AS cost FROM p{DEPTH}")
def graph_weighted_paths(spark, d):
    """Least cost from the note with the most links over at most ten edges; an edge costs less the stronger its pair is and more into a hub."""
    from wherry.session import cut

    n, _, e = base(spark, d, "frontmatter")
    e = cut(e)
    return G.cheapest(cut(path_costs(e, n)), _root(e), DEPTH).select("k", F.round("cost", 6).alias("cost"))


def graph_components(spark, d):
    """Connected components with their sizes."""
    n, _, e = base(spark, d)
    return G.components(e, n).groupBy("component").agg(F.count(F.lit(1)).alias("n_notes"))


add("""WITH RECURSIVE reach AS (SELECT k AS a, k AS b FROM notes UNION SELECT reach.a, und.dst FROM reach JOIN und ON und.src = reach.b),
comp AS (SELECT a, min(b) AS component FROM reach GROUP BY 1) SELECT component, count(*) AS n_notes FROM comp GROUP BY 1""")(graph_components)
book.sql["graph_components"] = book.sql["graph_components"].replace("WITH notes0", "WITH RECURSIVE notes0", 1).replace(", RECURSIVE reach", ", reach", 1)


@add("""SELECT count(*) AS n_notes, CAST(sum(n_out) AS BIGINT) AS n_links, round(avg(n_in + n_out), 6) AS mean_degree, max(n_in + n_out) AS most_degree, round(sum(n_out) / (count(*) * (count(*) - 1.0)), 9) AS density,
round(avg(CASE WHEN n_in + n_out > 0 THEN 1.0 ELSE 0.0 END), 6) AS connected_ratio, round(avg(CASE WHEN n_in = 0 THEN 1.0 ELSE 0.0 END), 6) AS orphan_rate, round(stddev_pop(n_in + n_out), 6) AS degree_sd FROM deg""")
def graph_topology(spark, d):
    """Size, density, degrees and orphan rate of the graph."""
    n, _, e = base(spark, d)
    g = G.degrees(e, n).withColumn("g", F.col("n_in") + F.col("n_out"))
    c = F.count(F.lit(1))
    return g.agg(c.alias("n_notes"), F.sum("n_out").alias("n_links"), F.round(F.avg("g"), 6).alias("mean_degree"), F.max("g").alias("most_degree"), F.round(F.sum("n_out") / (c * (c - 1.0)), 9).alias("density"), F.round(F.avg(F.when(F.col("g") > 0, 1.0).otherwise(0.0)), 6).alias("connected_ratio"), F.round(F.avg(F.when(F.col("n_in") == 0, 1.0).otherwise(0.0)), 6).alias("orphan_rate"), F.round(F.stddev_pop("g"), 6).alias("degree_sd"))


@add("""SELECT round((2.0 * sum(i * g) / (count(*) * sum(g))) - (count(*) + 1.0) / count(*), 6) AS gini FROM (SELECT n_in + n_out AS g, row_number() OVER (ORDER BY n_in + n_out, k) AS i FROM deg)""")
def graph_degree_gini(spark, d):
    """Gini coefficient of the degrees, from counts per degree (no global sort)."""
    n, _, e = base(spark, d)
    g = G.degrees(e, n).groupBy((F.col("n_in") + F.col("n_out")).alias("g")).agg(F.count(F.lit(1)).alias("m"))
    w = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # one row per distinct degree
    g = g.withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)))
    ranks = F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2
    c = F.sum("m")
    return g.agg(F.round((2.0 * F.sum(ranks * F.col("g"))) / (c * F.sum(F.col("g") * F.col("m"))) - (c + 1.0) / c, 6).alias("gini"))


@add("""WITH t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM und x JOIN und y ON x.dst = y.src JOIN und z ON z.src = x.src AND z.dst = y.dst WHERE x.src < x.dst AND x.dst < y.dst), n AS (SELECT unnest([a, b, c]) AS k FROM t)
SELECT k, count(*) AS n_triangles FROM n GROUP BY 1""")
def graph_triangles(spark, d):
    """Triangles through each note."""
    _, _, e = base(spark, d)
    return G.triangles(e)


@add("""SELECT x.src AS a, x.dst AS b, NULL::VARCHAR AS c FROM edges x JOIN edges y ON x.dst = y.src AND y.dst = x.src WHERE x.src < x.dst
UNION ALL SELECT x.src, x.dst, y.dst FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = y.dst AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst AND x.dst <> y.dst""")
def graph_cycles(spark, d):
    """Cycles of two and three links."""
    _, _, e = base(spark, d)
    c = G.cycles(e, 3)
    return c.select(F.col("cycle")[0].alias("a"), F.col("cycle")[1].alias("b"), F.get("cycle", F.lit(2)).alias("c"))


@add()
def graph_eigenvector(spark, d):
    """Eigenvector centrality of every note."""
    n, _, e = base(spark, d)
    return G.eigenvector(e, n)


@add()
def graph_centrality(spark, d):
    """Betweenness and closeness of every note, over all sources."""
    n, _, e = base(spark, d)
    return G.centrality(e, n)


@add("""SELECT 0 AS part, k AS ord, '<node id="' || replace(replace(replace(replace(k, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '"/>' AS xml FROM notes
UNION ALL SELECT 1, src || ' ' || dst, '<edge source="' || replace(replace(replace(replace(src, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '" target="' || replace(replace(replace(replace(dst, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '"/>' FROM edges""")
def sink_graphml(spark, d):
    """The graph as GraphML lines."""
    n, _, e = base(spark, d)
    return G.graphml(n, e)


@add("SELECT dst, count(*) AS n_links, count(DISTINCT src) AS n_notes, list_sort(list(DISTINCT src))[1:5] AS sources FROM res WHERE target_k IS NULL GROUP BY 1 HAVING count(*) >= 2")
def agg_dead_links(spark, d):
    """Targets that lead nowhere, at least twice, with up to five of their notes."""
    _, r, _ = base(spark, d)
    dead = r.where(F.col("to").isNull())
    n = dead.groupBy("dst").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("src").alias("n_notes")).where("n_links >= 2")
    first = dead.select("dst", "src").distinct().withColumn("r", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).where("r <= 5")
    return n.join(first.groupBy("dst").agg(F.sort_array(F.collect_list("src")).alias("sources")), "dst")


@add("SELECT dst, count(DISTINCT src) AS n_notes FROM res WHERE target_k IS NULL GROUP BY 1 HAVING count(DISTINCT src) >= 3")
def agg_stub_candidates(spark, d):
    """Targets without a note that at least three notes ask for."""
    _, r, _ = base(spark, d)
    return r.where(F.col("to").isNull()).groupBy("dst").agg(F.countDistinct("src").alias("n_notes")).where("n_notes >= 3")


@add("SELECT name, count(DISTINCT src) AS n_notes FROM (SELECT e.name, l.src FROM (SELECT name, regexp_replace(lower(trim(name)), '\\.md$', '') AS key FROM ents UNION SELECT name, regexp_replace(lower(trim(a)), '\\.md$', '') FROM (SELECT name, unnest(aliases) AS a FROM ents)) e JOIN links l ON l.dst = e.key) GROUP BY 1")
def agg_entity_backlinks(spark, d):
    """Notes that link to each entity by name or alias."""
    e = V.entities(spark, d)
    keys = e.select("name", F.explode(F.concat(F.array("name"), "aliases")).alias("a")).select("name", link_key("a").alias("dst")).distinct()
    return V.links(spark, d).join(keys, "dst").groupBy("name").agg(F.countDistinct("src").alias("n_notes"))


@add("SELECT dst, CAST(sum(CAST(round(weight * 1000) AS BIGINT)) AS DOUBLE) / (count(*) * 1000) AS mean_weight, count(*) AS n_links, count(*) FILTER (WHERE weight > 3) AS n_strong FROM links WHERE weight > 1 GROUP BY 1")
def agg_edge_weights(spark, d):
    """Mean weight and strong links (above 3) per target, of weights above 1."""
    return V.links(spark, d).where("weight > 1").groupBy("dst").agg((F.sum(F.round(F.col("weight") * 1000).cast("long")).cast("double") / (F.count(F.lit(1)) * 1000)).alias("mean_weight"), F.count(F.lit(1)).alias("n_links"), F.count_if(F.col("weight") > 3).alias("n_strong"))


@add("SELECT f.folder, count(DISTINCT k) FILTER (WHERE regexp_extract(k, '^(.*)/[^/]*$', 1) = f.folder) AS n_direct, count(DISTINCT k) AS n_all FROM notes, LATERAL (SELECT unnest(list_transform(range(1, len(string_split(k, '/'))), lambda i: array_to_string(string_split(k, '/')[1:i], '/'))) AS folder) f GROUP BY 1")
def agg_folder_tree(spark, d):
    """Notes directly in each folder and in all below it."""
    n = V.notes(spark, d).select("k", F.split("k", "/").alias("p")).where(F.size("p") > 1)
    x = n.select("k", F.explode(F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.array_join(F.slice("p", F.lit(1), i), "/"))).alias("folder"))
    return x.groupBy("folder").agg(F.count_if(folder_of(F.col("k")) == F.col("folder")).alias("n_direct"), F.count(F.lit(1)).alias("n_all"))


@add("""SELECT k, round((CASE WHEN w >= 500 THEN 1.0 WHEN w >= 100 THEN 0.5 ELSE 0.0 END + least(n_out, 3) / 3.0 + least(n_in, 2) / 2.0) / 3, 6) AS maturity FROM
(SELECT notes.k, len(regexp_extract_all(coalesce(content, ''), '[^ \\n\\t\\r\\f]+')) AS w, n_in, n_out FROM notes JOIN deg ON deg.k = notes.k) WHERE (CASE WHEN w >= 500 THEN 1.0 WHEN w >= 100 THEN 0.5 ELSE 0.0 END + least(n_out, 3) / 3.0 + least(n_in, 2) / 2.0) / 3 < 0.5""")
def graph_immature(spark, d):
    """Notes with few words and links, by the mean of their scores."""
    n, _, e = base(spark, d)
    words = V.notes(spark, d, w=F.regexp_count(F.coalesce("content", F.lit("")), F.lit("[^ \\n\\t\\r\\f]+"))).select("k", "w")
    m = words.join(G.degrees(e, n), "k")
    score = (F.when(F.col("w") >= 500, 1.0).when(F.col("w") >= 100, 0.5).otherwise(0.0) + F.least("n_out", F.lit(3)) / 3.0 + F.least("n_in", F.lit(2)) / 2.0) / 3
    return m.where(score < 0.5).select("k", F.round(score, 6).alias("maturity"))


@add(f"WITH {_ROOT}, {_HOPS}, hp AS (SELECT k, CAST(min(hop) AS INTEGER) AS hop FROM (" + " UNION ALL ".join(f"SELECT k, {i} AS hop FROM h{i}" for i in range(DEPTH + 1)) + ") GROUP BY 1) SELECT a.k, a.hop, min(b.k) AS via FROM hp a LEFT JOIN (SELECT hp.k, hop, dst FROM hp JOIN edges ON src = hp.k) b ON b.dst = a.k AND b.hop = a.hop - 1 GROUP BY 1, 2")
def graph_shortest_paths(spark, d):
    """A shortest path from the note with the most links to each note within ten links: the note before it on the way, the smallest key among equals."""
    from wherry.session import cut

    _, _, e = base(spark, d)
    e = cut(e)
    h = cut(G.hops(e, _root(e), DEPTH).select("k", "hop"))
    before = h.select(F.col("k").alias("src"), (F.col("hop") + 1).alias("hop")).join(e, "src").groupBy(F.col("dst").alias("k"), "hop").agg(F.min("src").alias("via"))
    return h.join(before, ["k", "hop"], "left").select("k", "hop", "via")


@add("SELECT k, n_in, n_out, rank FROM (SELECT k, n_in, n_out, row_number() OVER (ORDER BY n_in + n_out DESC, k) AS rank FROM deg) WHERE rank <= 10")
def graph_top_degrees(spark, d):
    """The ten notes with the most links."""
    n, _, e = base(spark, d)
    top = G.degrees(e, n).orderBy(F.desc(F.col("n_in") + F.col("n_out")), "k").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.col("n_in") + F.col("n_out")), "k"))).select("k", "n_in", "n_out", "rank")  # ten rows


_XML = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@add(f"""WITH en AS (SELECT e.id, e.name, e.category, regexp_replace(lower(trim(e.path)), '\\.md$', '') AS ek FROM ents e WHERE e.name IS NOT NULL), me AS (SELECT src, target_k AS dst, max(weight) AS w FROM res WHERE target_k IS NOT NULL AND src IN (SELECT k FROM notes) GROUP BY 1, 2)
SELECT 0 AS part, k AS ord, '<node id="' || {_XML.format('k')} || '"><data key="type">note</data><data key="title">' || {_XML.format('title')} || '</data></node>' AS xml FROM notes
UNION ALL SELECT 1, lpad(CAST(id AS VARCHAR), 12, '0'), '<node id="entity:' || id || '"><data key="type">entity</data><data key="title">' || {_XML.format('name')} || '</data><data key="category">' || {_XML.format("coalesce(category, '')")} || '</data></node>' FROM en
UNION ALL SELECT 2, src || ' ' || dst, '<edge source="' || {_XML.format('src')} || '" target="' || {_XML.format('dst')} || '"><data key="weight">' || printf('%.3f', w) || '</data></edge>' FROM me
UNION ALL SELECT 3, lpad(CAST(id AS VARCHAR), 12, '0'), '<edge source="entity:' || id || '" target="' || {_XML.format('ek')} || '"><data key="type">note_of</data></edge>' FROM en WHERE ek IN (SELECT k FROM notes)""")
def sink_graph_export(spark, d):
    """The graph for export: notes and entities as typed nodes, links with weights, and each entity's edge to its note. ``operators.graph.GRAPHML_HEAD`` and ``GRAPHML_TAIL`` go around the lines."""
    n, r, _ = base(spark, d)
    e = V.entities(spark, d).where("name is not null").withColumn("ek", link_key("path"))
    x = lambda c: G.escaped(F.col(c) if isinstance(c, str) else c)
    t = F.concat
    notes = n.select(F.lit(0).alias("part"), F.col("k").alias("ord"), t(F.lit('<node id="'), x("k"), F.lit('"><data key="type">note</data><data key="title">'), x("title"), F.lit("</data></node>")).alias("xml"))
    idx = F.lpad(F.col("id").cast("string"), 12, "0")
    ents = e.select(F.lit(1).alias("part"), idx.alias("ord"), t(F.lit('<node id="entity:'), F.col("id").cast("string"), F.lit('"><data key="type">entity</data><data key="title">'), x("name"), F.lit('</data><data key="category">'), x(F.coalesce("category", F.lit(""))), F.lit("</data></node>")).alias("xml"))
    w = r.where(F.col("to").isNotNull()).join(n.select(F.col("k").alias("src")), "src", "left_semi").groupBy("src", F.col("to").alias("dst")).agg(F.max("weight").alias("w"))
    links = w.select(F.lit(2).alias("part"), F.concat_ws(" ", "src", "dst").alias("ord"), t(F.lit('<edge source="'), x("src"), F.lit('" target="'), x("dst"), F.lit('"><data key="weight">'), F.format_string("%.3f", "w"), F.lit("</data></edge>")).alias("xml"))
    own = e.join(n.select(F.col("k").alias("ek")), "ek", "left_semi").select(F.lit(3).alias("part"), idx.alias("ord"), t(F.lit('<edge source="entity:'), F.col("id").cast("string"), F.lit('" target="'), x("ek"), F.lit('"><data key="type">note_of</data></edge>')).alias("xml"))
    return notes.unionByName(ents).unionByName(links).unionByName(own)


QUERIES, SQL = book.queries, book.sql
