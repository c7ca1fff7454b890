"""Search beyond a single list: parsed and stemmed queries, paragraphs and snippets, dates, and the steps that follow a fused list."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherry.operators.search import B, K1, parse_query, porter, stem_words, words
from wherry.session import cut

#: Months by the names a text may give them (fixed values).
MONTHS = ["jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?", "sep(?:t(?:ember)?)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?"]
LONG_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SHORTEST, CHUNK, WINDOW = 50, 800, 800


def variants(df: DataFrame, text: Column, stems: list[str]) -> dict[str, list[str]]:
    """For each stem the words of the texts that have it. Only words that begin like a stem leave a task, each once, and the result is as small as the vocabulary of a few stems."""
    begins = sorted({s[: max(2, len(s) - 1)] for s in stems})
    like = lambda w: F.exists(F.array(*[F.lit(b) for b in begins]), lambda b: F.startswith(w, b))
    v = df.select(F.explode(F.array_distinct(F.filter(words(text), like))).alias("word")).distinct()
    out: dict[str, list[str]] = {s: [s] for s in stems}
    for r in stem_words(v).where(F.col("stem").isin(*stems)).collect():
        if r["word"] not in out[r["stem"]]:
            out[r["stem"]].append(r["word"])
    return {s: sorted(ws) for s, ws in out.items()}


def _one_of(ws: list[str]):
    return lambda v: v.isin(*ws)


def _begins(p: str):
    return lambda v: F.startswith(v, F.lit(p))


def search(df: DataFrame, key: str, fields: dict[str, float], query: str, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """``key, score``: the ``k`` best texts for a query as it was typed, by BM25 over weighted fields with stems.

    Words match by stem, a trailing ``*`` by beginning, a quoted phrase word for word. All phrases and the first word must hold together, or
    any other word alone must. A field of weight 0 finds nothing and counts nothing. An empty query finds nothing.
    """
    terms, prefixes, phrases = parse_query(query)
    fields = {c: w for c, w in fields.items() if w}
    whole = F.concat_ws(" ", *[F.col(c) for c in fields])
    stems = [s for s in dict.fromkeys(porter(t) for t in terms)]
    if not (stems or prefixes or phrases):
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    known = variants(df, whole, stems) if stems else {}
    per = {c: words(F.col(c)) for c in fields}
    count = lambda test: sum((F.size(F.filter(per[c], test)) * F.lit(float(w)) for c, w in fields.items()), F.lit(0.0))
    padded = {c: F.concat(F.lit(" "), F.array_join(per[c], "  "), F.lit(" ")) for c in fields}
    in_a_row = lambda p: sum((F.regexp_count(padded[c], F.lit(" " + "  ".join(p.split()) + " ")) * F.lit(float(w)) for c, w in fields.items()), F.lit(0.0))
    parts = [in_a_row(p) for p in phrases] + [count(_one_of(known[s])) for s in stems] + [count(_begins(p)) for p in prefixes]
    x = cut(df.select(key, sum((F.size(per[c]) for c in fields), F.lit(0)).alias("dl"), *[c.alias(f"t{i}") for i, c in enumerate(parts)]))
    n = range(len(parts))
    stats = x.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in n])
    has = [F.col(f"t{i}") > 0 for i in n]
    m = len(phrases)
    together = has[: m + 1] if m else has[:1]
    wanted = together[0]
    for h in together[1:]:
        wanted = wanted & h
    for h in has[len(together) :]:
        wanted = wanted | h
    s = [F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)) * F.col(f"t{i}") * (k1 + 1) / (F.col(f"t{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))) for i in n]
    hit = x.where(wanted).crossJoin(F.broadcast(stats))  # one row of statistics
    return hit.select(key, F.round(sum(s, F.lit(0.0)), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def paragraphs(text: str, most: int = CHUNK) -> list[tuple[str, str | None]]:
    """Paragraphs with the heading above them; those under ``SHORTEST`` characters go together with what follows."""
    out: list[tuple[str, str | None]] = []
    section, held, held_section = None, "", None
    import re

    for p in (x.strip() for x in re.split(r"\n\n+", text)):
        if not p:
            continue
        if m := re.match(r"#{1,6}\s+(.+)", p):
            section = m.group(1).strip()
        if held:
            held = held + "\n\n" + p
            if len(held) >= SHORTEST:
                out.append((held[:most], held_section))
                held = ""
        elif len(p) < SHORTEST:
            held, held_section = p, section
        else:
            out.append((p[:most], section))
    return out + ([(held[:most], held_section)] if held else [])


def widen(ps: list[str], at: int, most: int = WINDOW) -> str:
    """A paragraph with up to two before and two after it, as far as all fit into ``most`` characters."""
    text, low, high = ps[at], at, at
    for _ in range(2):
        if low and len(ps[low - 1]) + 2 + len(text) <= most:
            low -= 1
            text = ps[low] + "\n\n" + text
        if high + 1 < len(ps) and len(text) + 2 + len(ps[high + 1]) <= most:
            high += 1
            text = text + "\n\n" + ps[high]
    return text


def snippets(hits: DataFrame, text: str, query: str) -> DataFrame:
    """Adds ``snippet, section, confidence`` to a page of hits: the paragraph with most of the query's words (10 each, 5 for a stem), the first among equals, widened by its neighbours."""
    terms, prefixes, phrases = parse_query(query)
    wanted = list(dict.fromkeys([*terms, *(w for p in phrases for w in p.split())]))
    stems = {w: porter(w) for w in wanted}
    schema = "snippet string, section string, confidence double"

    @F.pandas_udf(schema)
    def best(t: pd.Series) -> pd.DataFrame:
        import re

        rows = []
        for x in t:
            ps = paragraphs(x) if x else []
            scores = []
            for p, _ in ps:
                ws = set(re.findall(r"[^\W_]+", p.lower()))
                have = {porter(w) for w in ws}
                scores.append(sum(10 if w in ws else 5 if s in have else 0 for w, s in stems.items()))
            if not ps or not wanted or max(scores) == 0:
                rows.append((None, None, 0.0))
                continue
            at = scores.index(max(scores))
            rows.append((widen([p for p, _ in ps], at), ps[at][1], round(scores[at] / (10 * len(wanted)), 6)))
        return pd.DataFrame(rows, columns=["snippet", "section", "confidence"])

    return hits.withColumn("x", best(F.col(text))).select("*", "x.*").drop("x")


def dates(text: Column) -> Column:
    """ISO dates that a text gives in any of four forms, sorted, once each: ``2024-01-15``, ``Jan 15, 2024``, ``15 January 2024``, ``March 2024`` (its first day)."""
    month = "(" + "|".join(MONTHS) + ")"
    number = F.create_map(*[x for i, m in enumerate(LONG_MONTHS) for x in (F.lit(m[:3]), F.lit(f"{i + 1:02d}"))])
    mm = lambda s: F.element_at(number, F.lower(F.substring(s, 1, 3)))
    every = lambda p: F.regexp_extract_all(text, F.lit(f"(?i)({p})"), 1)
    a, b, c = rf"\b{month}\s+(\d{{1,2}}),?\s+(\d{{4}})\b", rf"\b(\d{{1,2}})\s+{month}\s+(\d{{4}})\b", rf"\b({'|'.join(LONG_MONTHS)})\s+(\d{{4}})\b"
    g = lambda m, p, i: F.regexp_extract(m, "(?i)" + p, i)
    join = lambda y, m, d: F.concat(y, F.lit("-"), m, F.lit("-"), F.lpad(d, 2, "0"))
    iso = F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), 1)
    us = F.transform(every(a), lambda m: join(g(m, a, 3), mm(g(m, a, 1)), g(m, a, 2)))
    eu = F.transform(every(b), lambda m: join(g(m, b, 3), mm(g(m, b, 2)), g(m, b, 1)))
    my = F.transform(every(c), lambda m: join(g(m, c, 2), mm(g(m, c, 1)), F.lit("01")))
    return F.array_sort(F.array_distinct(F.concat(iso, us, eu, my)))
