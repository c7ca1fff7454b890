"""Associations of entities: weighted co-occurrence, mutual information, co-retrieval, fuzzy and alias matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherry.functions.exprs import fuzzy_similarity, half_life
from wherry.session import cut


def adamic_adar(mentions: DataFrame, most: int = 200, piece: int = 2000) -> DataFrame:
    """``a, b, weight, n``: pairs of ``mentions(note, entity)`` with weight 1/ln(degree) per shared note of degree three or more, else 1.

    The pairs of a note stay within its own array of at most ``most`` entities; notes with more are joined pairwise on the note, one side in
    pieces of about ``piece`` entities and the other repeated for each, so no pair is lost and no task holds all pairs of a large note.
    """
    m = mentions.where(F.col("note").isNotNull() & F.col("entity").isNotNull()).distinct()
    deg = m.groupBy("note").agg(F.count(F.lit(1)).alias("deg"))
    m = m.join(deg.withColumn("pieces", F.ceil(F.col("deg") / piece).cast("int")), "note")
    w = F.when(F.col("deg") >= 3, 1 / F.log(F.col("deg").cast("double"))).otherwise(F.lit(1.0))
    small = m.where(F.col("deg") <= most).groupBy("note", "deg").agg(F.array_sort(F.collect_list("entity")).alias("es")).select(w.alias("w"), "es")
    idx = F.sequence(F.lit(1), F.size("es"))
    pairs = small.where(F.size("es") > 1).select("w", "es", F.explode(idx).alias("i")).select("w", F.element_at("es", F.col("i")).alias("a"), F.explode(F.slice("es", F.col("i") + 1, F.size("es"))).alias("b"))
    large = m.where(F.col("deg") > most)
    x = large.select("note", F.pmod(F.hash("entity"), "pieces").alias("p"), w.alias("w"), F.col("entity").alias("a"))
    y = large.select("note", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("p"), F.col("entity").alias("b"))
    wide = x.join(y, ["note", "p"]).where("a < b").select("w", "a", "b")
    return pairs.unionByName(wide).groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("weight"), F.count(F.lit(1)).alias("n"))


def strong_pairs(pairs: DataFrame, rising: DataFrame, least: int) -> DataFrame:
    """``seed, entity, boost``: both directions of ``pairs(a, b, npmi)`` whose boost is at least ``least``: mutual information times 12, half as much again for entities of ``rising(entity, up)``, else half, rounded, at most 12.

    The boost grows with the mutual information, so over several seeds the greatest boost is that of the greatest; what is left out here can't
    reach ``least`` in any note and needn't meet one.
    """
    both = pairs.select(F.col("a").alias("seed"), F.col("b").alias("entity"), "npmi").unionByName(pairs.select(F.col("b").alias("seed"), F.col("a").alias("entity"), "npmi"))
    boost = F.least(F.floor(F.col("npmi") * 12 * F.when(F.col("up"), 1.5).otherwise(0.5) + 0.5), F.lit(12)).cast("int")
    return both.join(rising, "entity", "left").select("seed", "entity", boost.alias("boost")).where(F.col("boost") >= least)


def co_retrieval(reads: DataFrame, as_of: str, days: float = 7.0, most: int = 50, piece: int = 2000) -> DataFrame:
    """``a, b, weight``: notes read in the same session, 1/ln(n) per session of n notes, halved every ``days``. ``reads(session, note, at)``.

    The pairs of a session stay within its own array of at most ``most`` notes; longer sessions are joined pairwise on the session, one side
    in pieces of about ``piece`` notes and the other repeated for each, so no pair is lost and no task holds a whole long session's pairs.
    """
    m = reads.where(F.col("note").isNotNull()).groupBy("session", "note").agg(F.max("at").alias("at"))
    of = m.where(F.col("session").isNotNull()).groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("last")).where("n > 1")
    w = half_life(F.col("last"), as_of, days) / F.when(F.col("n") > 2, F.log(F.col("n").cast("double"))).otherwise(F.lit(1.0))
    m = m.select("session", "note").join(of.select("session", "n", w.alias("w"), F.ceil(F.col("n") / piece).cast("int").alias("m")), "session")
    small = m.where(F.col("n") <= most).groupBy("session", "w").agg(F.array_sort(F.collect_list("note")).alias("es"))
    p = small.select("w", "es", F.explode(F.sequence(F.lit(1), F.size("es"))).alias("i")).select("w", F.element_at("es", F.col("i")).alias("a"), F.explode(F.slice("es", F.col("i") + 1, F.size("es"))).alias("b"))
    large = m.where(F.col("n") > most)
    x = large.select("session", F.pmod(F.hash("note"), "m").alias("p"), "w", F.col("note").alias("a"))
    y = large.select("session", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("p"), F.col("note").alias("b"))
    wide = x.join(y, ["session", "p"]).where("a < b").select("w", "a", "b")
    return p.unionByName(wide).groupBy("a", "b").agg(F.round(F.sum("w"), 6).alias("weight"))


def fuzzy_best(left: DataFrame, right: DataFrame) -> DataFrame:
    """``term, match, sim``: for each ``left.term`` of four letters or more the most similar ``right.name`` within one edit, within two for terms above ten letters, ties to the smaller name. Joined on shared segments, never all against all."""
    edits = F.when(F.length("term") > 10, 2).otherwise(1)
    l = left.where(F.length("term") >= 4).select("term", edits.alias("edits"), F.sequence(F.length("term") - edits, F.length("term") + edits).alias("lengths"))
    r = right.where(F.length("name") >= 3).select("name", F.array(F.lit(1), F.lit(2)).alias("kinds"))
    c = near_pairs(l, r).where(F.levenshtein("term", "name") <= edits).withColumn("sim", F.round(fuzzy_similarity(F.col("term"), F.col("name")), 6))
    best = c.groupBy("term").agg(F.max("sim").alias("sim"))
    return c.join(best, ["term", "sim"]).groupBy("term", "sim").agg(F.min("name").alias("match")).select("term", "match", "sim")


def acronym(name: Column) -> Column:
    """First letters of the words in capitals."""
    return F.upper(F.array_join(F.transform(F.filter(F.split(name, r"[\s-]+"), lambda w: w != ""), lambda w: F.substring(w, 1, 1)), ""))


def alias_candidates(entities: DataFrame) -> DataFrame:
    """``id, alias, kind``: acronyms of two words or more, first and last words of people, names without hyphens; those that are an entity's name or alias already are left out."""
    words = F.filter(F.split("name", r"\s+"), lambda w: w != "")
    x = entities.select(
        "id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.size(words) >= 2, F.struct(acronym(F.col("name")).alias("alias"), F.lit("acronym").alias("kind"))),
                    F.when((F.col("category") == "people") & (F.size(words) == 2), F.struct(F.element_at(words, 1).alias("alias"), F.lit("first").alias("kind"))),
                    F.when((F.col("category") == "people") & (F.size(words) == 2), F.struct(F.element_at(words, -1).alias("alias"), F.lit("last").alias("kind"))),
                    F.when(F.contains("name", F.lit("-")), F.struct(F.replace("name", F.lit("-"), F.lit(" ")).alias("alias"), F.lit("plain").alias("kind"))),
                )
            )
        ).alias("x"),
    ).select("id", "x.alias", "x.kind")
    taken = entities.select(F.lower("name").alias("t")).union(entities.select(F.explode("aliases")).select(F.lower("col")))
    return x.distinct().join(taken.distinct(), F.lower("alias") == F.col("t"), "left_anti")


def words_of(text: Column) -> Column:
    """Distinct lower-cased words of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.lower(text), F.lit("")), F.lit(r"[\p{L}\p{N}]+"), 0))


#: The most names, and letters of them, that are sent to the tasks.
MOST_NAMES, MOST_LETTERS = 100_000, 8_000_000


def word_hits(texts: DataFrame, key: str, names: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """``key, id, p, w, least, found``: names ``(id, p, w, least)`` of which at least ``least`` of the words ``w`` stand in a text ``(key, words)``; ``found`` are those.

    A text that holds ``least`` of a name's n words holds one of its n - least + 1 rarest, so texts and names meet on those words only and a
    frequent word of many names meets nothing by itself. Names without words and those that ask for more words than they have give nothing.
    Names are counted first: a list of at most ``most`` goes to the tasks as an index by its rarest words and no text is shuffled; a longer one
    is joined. Both give the same rows.
    """
    names = names.where((F.size("w") >= F.col("least")) & (F.size("w") > 0) & (F.col("least") > 0)).select("id", "p", "w", F.col("least").cast("int").alias("least"))
    n, letters = names.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.array_join("w", ""))), F.lit(0))).first()
    if n > most or letters > MOST_LETTERS:
        return _joined_hits(texts, key, names)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(names.schema[c].dataType) for c in ("id", "p")]
    return texts.select(key, "words").mapInArrow(_hits_of([tuple(r) for r in names.collect()], kinds), f"`{key}` {texts.schema[key].dataType.simpleString()}, id {names.schema['id'].dataType.simpleString()}, p {names.schema['p'].dataType.simpleString()}, w array<string>, least int, found array<string>")


def _hits_of(rows: list[tuple], kinds: list):
    """The words of each text looked up in an index of the names by their rarest words."""
    from collections import Counter

    often = Counter(w for r in rows for w in r[2])
    index: dict[str, list[int]] = {}
    for i, (_, _, ws, least) in enumerate(rows):
        for w in sorted(ws, key=lambda x: (often[x], x))[: len(ws) - least + 1]:
            index.setdefault(w, []).append(i)

    def run(batches):
        import pyarrow as pa

        ids, ps = pa.array([r[0] for r in rows], kinds[0]), pa.array([r[1] for r in rows], kinds[1])
        ws, least = pa.array([list(r[2]) for r in rows], pa.list_(pa.string())), pa.array([r[3] for r in rows], pa.int32())
        for b in batches:
            text, name, found = [], [], []
            for t, words in enumerate(b.column(1).to_pylist()):
                have = set(words or ())
                for i in {i for w in have if w in index for i in index[w]}:
                    hit = [w for w in rows[i][2] if w in have]
                    if len(hit) >= rows[i][3]:
                        text.append(t)
                        name.append(i)
                        found.append(hit)
            if name:
                at = pa.array(name)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), ids.take(at), ps.take(at), ws.take(at), least.take(at), pa.array(found, pa.list_(pa.string()))], names=[b.schema.names[0], "id", "p", "w", "least", "found"])

    return run


def _joined_hits(texts: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """The same by joins; of a text only the words that any name has are kept."""
    vocabulary = names.select(F.explode("w").alias("token")).distinct()
    kept = cut(texts.select(key, F.explode("words").alias("token")).join(vocabulary, "token", "left_semi"))
    df = kept.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = names.select("id", "p", "w", "least", F.explode("w").alias("token")).join(df, "token", "left").groupBy("id", "p", "w", "least").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("ts"))
    prefix = ranked.select("id", "p", "w", "least", F.explode(F.slice("ts", F.lit(1), F.size("ts") - F.col("least") + 1)).alias("x")).where(F.col("x.n") > 0)
    met = kept.join(prefix.select("id", "p", "w", "least", F.col("x.token").alias("token")), "token").select(key, "id", "p", "w", "least").distinct()
    of_text = kept.groupBy(key).agg(F.collect_set("token").alias("ts"))
    return met.join(of_text, key).withColumn("found", F.array_intersect("w", "ts")).where(F.size("found") >= F.col("least")).drop("ts")


def token_coverage(texts: DataFrame, key: str, text: Column, entities: DataFrame) -> DataFrame:
    """``key, id``: entities whose name's words stand in the text: all of one or two, three quarters of more."""
    w = words_of(F.col("name"))
    least = F.when(F.size("w") <= 2, F.size("w")).otherwise(F.ceil(F.size("w") * 0.75)).cast("int")
    e = entities.select("id", F.lit(0).alias("p"), w.alias("w")).withColumn("least", least)
    return word_hits(texts.select(key, words_of(text).alias("words")), key, e).select(key, "id")


def near_pairs(terms: DataFrame, names: DataFrame) -> DataFrame:
    """``term, name``: candidates that hold every pair within ``edits`` of ``terms(term, edits, lengths)``; of ``names(name, kinds)`` those of the ``lengths`` count.

    A name is cut into ``edits + 1`` segments (for each number of edits in ``kinds``); of a name within so many edits one segment stands whole in
    the term, shifted by no more than the edits and the lengths allow. Joined on length, edits, segment number and segment.
    """
    n = names.select("name", F.length("name").alias("len"), F.explode("kinds").alias("edits"))
    t = terms.select("term", "edits", F.length("term").alias("own"), F.explode("lengths").alias("len"))
    at = lambda x: x.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits")))).withColumn("base", F.expr("len div (edits + 1)")).withColumn("extra", F.greatest(F.lit(0), F.col("i") - (F.col("edits") + 1 - F.col("len") % (F.col("edits") + 1)))).withColumn("start", (F.col("i") * F.col("base") + F.col("extra")).cast("int")).withColumn("size", (F.col("base") + F.when(F.col("i") >= F.col("edits") + 1 - F.col("len") % (F.col("edits") + 1), 1).otherwise(0)).cast("int"))
    n = at(n).select("len", "edits", "i", F.expr("substring(name, start + 1, size)").alias("seg"), "name")
    gap = F.col("own") - F.col("len")
    first = F.greatest(F.lit(0), F.col("start") - F.floor((F.col("edits") - gap) / 2).cast("int"))
    last = F.least(F.col("own") - F.col("size"), F.col("start") + F.floor((F.col("edits") + gap) / 2).cast("int"))
    t = at(t).withColumn("first", first).withColumn("last", last).where("first <= last")
    t = t.select("len", "edits", "i", "size", "term", F.explode(F.sequence("first", "last")).alias("q")).select("len", "edits", "i", F.expr("substring(term, q + 1, size)").alias("seg"), "term").distinct()
    return t.join(n, ["len", "edits", "i", "seg"]).select("term", "name").distinct()


def substring_pairs(names: DataFrame) -> DataFrame:
    """``term, name``: candidates that hold every name of three letters or more and each longer one, less than twice as long, that contains it. Joined on the rarest three letters of the shorter."""
    g = names.where(F.length("name") >= 3).select("name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.substring(F.col("name"), i, F.lit(3))))).alias("g"))
    rare = g.join(g.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g").groupBy("name").agg(F.min(F.struct("n", "g")).alias("x")).select("name", F.col("x.g").alias("g"))
    p = g.toDF("term", "g").join(rare, "g").where((F.length("term") > F.length("name")) & (F.length("term") < 2 * F.length("name")))
    return p.where(F.contains("term", "name")).select("term", "name")


def merge_candidates(entities: DataFrame) -> DataFrame:
    """``a, b, score, reason``: entities that may be one, by the first of: equal names (``exact``, 0.95), equal folded names (``same``, 0.85), one name in the other and more than half as long (``substring``, 0.6 + 0.2 of the ratio of lengths),
    an edit distance below 35 % of the longer of two names of four letters or more (``near``, 0.5 + 0.4 of their similarity). Distinct names are matched, on shared keys."""
    from wherry.functions.exprs import fuzzy_key

    e = entities.select("id", F.lower("name").alias("name")).where("name is not null").distinct()
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("name", r"[.\-_]", ""), "js$", ""), "ts$", "")
    names = e.select("name").distinct().withColumns({"fk": fuzzy_key(F.col("name")), "plain": plain})
    keys = names.select("name", F.explode(F.array(F.concat(F.lit("f"), F.when(F.col("fk") != "", F.col("fk"))), F.concat(F.lit("p"), F.when(F.length("plain") >= 3, F.col("plain"))))).alias("key")).where("key is not null")
    folded = keys.toDF("term", "key").join(keys, "key").where("term <> name").select("term", "name", F.lit(True).alias("fold"))
    long = names.select("name", F.length("name").alias("len")).where("len >= 4")
    most = lambda n: F.floor((n * 35 - 1) / 100).cast("int")  # noqa: E731  the most edits below 35 %
    terms = long.select(F.col("name").alias("term"), most(F.col("len")).alias("edits"), F.sequence(F.greatest(F.lit(4), F.col("len") - most(F.col("len"))), "len").alias("lengths"))
    kinds = F.array_distinct(F.transform(F.filter(F.sequence("len", F.col("len") * 2), lambda n: n - F.col("len") <= most(n)), most))
    near = near_pairs(terms, long.select("name", kinds.alias("kinds"))).where("term <> name")
    ordered = [F.least("term", "name").alias("na"), F.greatest("term", "name").alias("nb"), "fold"]
    c = folded.select(*ordered).unionByName(substring_pairs(names.select("name")).unionByName(near).withColumn("fold", F.lit(False)).select(*ordered)).groupBy("na", "nb").agg(F.max("fold").alias("fold"))
    short, longer, edits = F.least(F.length("na"), F.length("nb")), F.greatest(F.length("na"), F.length("nb")), F.levenshtein("na", "nb")
    inside = (short >= 3) & (short * 2 > longer) & (F.contains("na", "nb") | F.contains("nb", "na"))
    close = (short >= 4) & (edits * 100 < longer * 35)
    rule = F.when(F.col("fold"), F.struct(F.lit(0.85).alias("score"), F.lit("same").alias("reason"))).when(inside, F.struct((0.6 + 0.2 * (short / longer)).alias("score"), F.lit("substring").alias("reason"))).when(close, F.struct((0.5 + 0.4 * (1 - edits / longer)).alias("score"), F.lit("near").alias("reason")))
    c = c.select("na", "nb", rule.alias("x")).where("x is not null").select("na", "nb", F.round("x.score", 6).alias("score"), "x.reason")
    c = c.unionByName(names.select(F.col("name").alias("na"), F.col("name").alias("nb"), F.lit(0.95).alias("score"), F.lit("exact").alias("reason")))
    p = c.join(e.select(F.col("id").alias("ia"), F.col("name").alias("na")), "na").join(e.select(F.col("id").alias("ib"), F.col("name").alias("nb")), "nb").where("ia <> ib")
    p = p.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "score", "reason")
    return p.groupBy("a", "b").agg(F.max(F.struct("score", "reason")).alias("x")).select("a", "b", "x.score", "x.reason")
