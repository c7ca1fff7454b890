"""Free-entered values to a canonical list: a multi-pattern automaton, then token-set similarity.

Values and patterns (names and aliases) are folded: lower case, no accents, no punctuation. An automaton over all patterns finds the
mentions that stand in a value at word boundaries; the longest non-overlapping ones win. Values without a mention go to token-set
similarity: every word of the pattern must have its own word in the value, equal or within a few edits by length, in any order. Short
codes match letter by letter only, numbers digit by digit only. Values left over are reported as unmatched.

A list of at most ``BLOCK_PATTERNS`` patterns (counted first) goes whole to every task, which takes its part of the distinct values. A longer
list and the values meet by keys, not by product. A pattern can only match a value that has every word of the pattern, equal, one edit away
or cut short; so the word of it that fewest values hold is a necessary one, and the pattern goes to the values' words that it may stand for
(found in the vocabulary, by deletion variants and by beginnings). Values written as one word meet by the letters of the whole. A task then
holds the patterns and the values of some keys, builds one automaton of those patterns and takes the best match of each value; the best over
all keys is taken by a partial aggregate. A key of very many values is divided among tasks by value, one of very many patterns by pattern.
Both ways give the same rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wherry.session import cut, hot_join

#: Patterns in one automaton, and the most letters of a list that is sent whole; distinct values that one task holds.
BLOCK_PATTERNS, BLOCK_LETTERS, CHUNK_VALUES = 60_000, 4_000_000, 25_000
#: The least share of characters that similar values must have in common.
LEAST_SHARE = 0.6
CODE_LENGTH, GLUED_LENGTH = 6, 12
_FOLD = str.maketrans({"ł": "l", "ø": "o", "ß": "ss", "đ": "d", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i"})
_POSSESSIVE = re.compile(r"['’ʼ`´]s\b")
_MD = re.compile(r"\.md\s*$")
_WORD = re.compile(r"[^\W_]+")
#: A word cut short, with a stop after it; it stands for the words that begin so.
_SHORT = re.compile(r"([^\W_]{3,})\.(?=\s|$)")


def fold(text: str) -> list[str]:
    """Words of a value without case, accents, punctuation, possessive endings and a file ending."""
    t = _MD.sub("", _POSSESSIVE.sub("", text.lower().strip()))
    t = unicodedata.normalize("NFKD", t.translate(_FOLD))
    t = "".join(c for c in t if not unicodedata.combining(c)).casefold()
    return _WORD.findall(t)


def allowed_edits(word: str) -> int:
    """Edits that a word may differ by: one, a swap of neighbours being one; none for numbers and words under four letters."""
    return int(word.isalpha() and len(word) >= 4)


def edits(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two words, or ``most + 1`` if more than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return last[-1] if last[-1] <= most else most + 1


def deletions(word: str, most: int) -> set[str]:
    """The word and all words with up to ``most`` letters deleted."""
    out, level = {word}, {word}
    for _ in range(most):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return out


class Matcher:
    """One block of the list: ``(pattern, entity id, is_code)``."""

    def __init__(self, patterns: list[tuple[str, int, bool]]) -> None:
        self.by_phrase: dict[str, int] = {}
        self.by_glued: dict[str, int] = {}
        self.tokens: list[tuple[list[str], int]] = []
        self.postings: dict[str, list[int]] = defaultdict(list)
        self.codes: set[str] = set()
        #: For each of ``tokens`` how many words of a value it takes, and its numbers.
        self.need: list[int] = []
        self.digits: list[tuple[str, ...]] = []
        for text, ident, code in sorted(patterns, key=lambda p: (p[1], p[0])):
            ws = fold(text)
            if not ws:
                continue
            phrase = " ".join(ws)
            if phrase in self.by_phrase:
                continue
            self.by_phrase[phrase] = ident
            if code:
                self.codes.add(phrase)
                continue
            self.by_glued.setdefault("".join(ws), ident)
            k = len(self.tokens)
            self.tokens.append((ws, ident))
            self.need.append(len(ws))
            self.digits.append(tuple(sorted(w for w in ws if w.isdigit())))
            for w in set(ws):
                self.postings[w].append(k)
        self.machine = ahocorasick.Automaton()
        for phrase, ident in self.by_phrase.items():
            self.machine.add_word(f" {phrase} ", (phrase, ident))
        if self.by_phrase:
            self.machine.make_automaton()
        self.near: dict[str, list[str]] = defaultdict(list)
        for w in self.postings:
            for d in deletions(w, allowed_edits(w)):
                self.near[d].append(w)
        self.begins: dict[str, list[str]] = defaultdict(list)
        for w in self.postings:
            for n in range(3, len(w)):
                self.begins[w[:n]].append(w)
        self._similar: dict[str, dict[str, int]] = {}
        self._glued_near: dict[str, list[str]] | None = None

    def mentions(self, words: list[str]) -> list[tuple[int, str, int]]:
        """Longest non-overlapping mentions at word boundaries: ``(place, phrase, entity id)``."""
        if not self.by_phrase:
            return []
        text = " " + " ".join(words) + " "
        hits = [(len(p), e - len(p), p, i) for e, (p, i) in self.machine.iter(text)]
        taken: list[tuple[int, int]] = []
        out = []
        for n, s, p, i in sorted(hits, key=lambda h: (-h[0], h[1])):
            if all(s + n <= a or s >= b for a, b in taken):
                taken.append((s, s + n))
                out.append((s, p, i))
        return out

    @staticmethod
    def numbered(words: list[str], mention: tuple[int, str, int]) -> bool:
        """Whether a number stands right before or after the mention: names that differ in a number only are different names."""
        at, phrase, _ = mention
        first = (" " + " ".join(words)).count(" ", 0, at + 1) - 1
        last = first + phrase.count(" ")
        return first > 0 and words[first - 1].isdigit() or last + 1 < len(words) and words[last + 1].isdigit()

    def similar_words(self, word: str) -> dict[str, int]:
        """Words of the list within the allowed edits of both, with the edits."""
        if (got := self._similar.get(word)) is None:
            got = {}
            most = allowed_edits(word)
            if most == 0:
                if word in self.postings:
                    got[word] = 0
            else:
                for d in deletions(word, most):
                    for w in self.near.get(d, ()):
                        if w not in got:
                            k = min(most, allowed_edits(w)) if w != word else 0
                            e = edits(word, w, k)
                            if e <= k:
                                got[w] = e
            if len(self._similar) > 200_000:
                self._similar.clear()
            self._similar[word] = got
        return got

    def best(self, value: str) -> tuple[float, int]:
        """``(score, entity id)`` of the best match, or ``(0, -1)``. 3: the whole value; 2 to 3: a mention; 1 to 2: similar words.

        The patterns held must hold all that can match the value; more of them don't change the best one.
        """
        words = fold(value)
        if not words:
            return 0.0, -1
        phrase = " ".join(words)
        if phrase in self.by_phrase:
            return 3.0, self.by_phrase[phrase]
        glued = "".join(words)
        if glued in self.by_glued:
            return 2.99, self.by_glued[glued]
        found = self.mentions(words)
        if found:
            whole = [m for m in found if not self.numbered(words, m)]
            if whole:
                s, p, i = max(whole, key=lambda m: (m[1] not in self.codes, len(m[1]), -m[0]))
                # names before codes, then the longest, then the first; the same over all tasks
                share = len(p) / len(phrase)
                return (2.0 + 0.05 * share if p in self.codes else 2.1 + 0.8 * share) - 1e-9 * min(s, 10**6), i
        if len(words) == 1 and len(glued) >= GLUED_LENGTH and (near := self.near_glued(glued)) != -1:
            return 1.9, near
        return self.similar(words, {x for w in _SHORT.findall(value) for x in fold(w)})

    def near_glued(self, glued: str) -> int:
        """The entity whose name without spaces is one edit away, the smallest id of several; -1 if there is none. Its index is built when first asked for."""
        if self._glued_near is None:
            self._glued_near = defaultdict(list)
            for g in self.by_glued:
                if len(g) >= GLUED_LENGTH - 1:
                    for d in deletions(g, 1):
                        self._glued_near[d].append(g)
        hits = {g for d in deletions(glued, 1) for g in self._glued_near.get(d, ())}
        return min((self.by_glued[g] for g in hits if edits(glued, g, 1) <= 1), default=-1)

    def similar(self, words: list[str], short: set[str] = frozenset()) -> tuple[float, int]:
        """The pattern all of whose words have their own similar word in the value, with the greatest share of characters in common."""
        close = [self.similar_words(w) | (dict.fromkeys(self.begins.get(w, ()), 0) if w in short else {}) for w in words]
        counts: Counter[int] = Counter()
        for c in close:
            if len(c) == 1:
                counts.update(self.postings[next(iter(c))])
            elif c:
                counts.update({k for w in c for k in self.postings[w]})
        numbers = tuple(sorted(w for w in words if w.isdigit()))
        need, digits, one = self.need, self.digits, len(words) == 1
        top = (0.0, -1)
        for k, n in counts.items():
            if n < need[k] or need[k] < 2 and not one or digits[k] != numbers:
                continue
            ws, ident = self.tokens[k]
            used: set[int] = set()
            wrong = 0
            for w in sorted(ws, key=len, reverse=True):
                at = min((j for j in range(len(words)) if j not in used and w in close[j]), key=lambda j: close[j][w], default=None)
                if at is None:
                    break
                used.add(at)
                wrong += close[at][w]
            else:
                both = sum(len(words[j]) for j in used)
                share = (2 * both - 2 * wrong) / (sum(map(len, words)) + sum(map(len, ws)))
                score = 1.0 + share * 0.99
                if share >= LEAST_SHARE and (score > top[0] or score == top[0] and ident < top[1]):
                    top = (score, ident)
        return top


def patterns_of(entities: DataFrame) -> DataFrame:
    """``pattern, id, is_code`` of names and aliases. Alias lists that are null, empty or not JSON name nothing; an alias that is one short word in capitals is a code."""
    aliases = F.coalesce(F.from_json("aliases_json", "array<string>"), F.array().cast("array<string>"))
    e = entities.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.explode(F.concat(F.array(F.struct(F.col("name").alias("p"), F.lit(False).alias("a"))), F.transform(aliases, lambda x: F.struct(x.alias("p"), F.lit(True).alias("a"))))).alias("x"))
    p = F.trim("x.p")
    code = F.col("x.a") & (F.length(p) <= CODE_LENGTH) & (F.upper(p) == p) & ~p.contains(" ")
    return e.where(F.col("x.p").isNotNull() & (p != "")).select(p.alias("pattern"), "id", code.alias("is_code")).groupBy("pattern", "id").agg(F.min("is_code").alias("is_code"))


def _value_words(longest: int):
    """``vid, kind, word``: the distinct words of a value (``s`` those cut short), ``g`` the whole without spaces, ``h`` the same of a value of one long word.

    Words and wholes much longer than any of the list (``longest``) match nothing and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vids, kinds, out = [], [], []
            for vid, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = fold(value)
                short = {x for w in _SHORT.findall(value) for x in fold(w)}
                got = [("s" if w in short else "w", w) for w in set(words)]
                glued = "".join(words)
                got += [("g", glued)] if words else []
                got += [("h", glued)] if len(words) == 1 and len(glued) >= GLUED_LENGTH else []
                for kind, w in got:
                    if len(w) <= longest + 1:
                        vids.append(vid)
                        kinds.append(kind)
                        out.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(vids, pa.int64()), pa.array(kinds, pa.string()), pa.array(out, pa.string())], names=["vid", "kind", "word"])

    return run


def _pattern_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = [fold(x) for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(words, pa.list_(pa.string())), pa.array(["".join(w) for w in words], pa.string())], names=["pattern", "id", "is_code", "words", "glued"])


def _variants(word: Column) -> Column:
    """The word and all words with one letter deleted."""
    cut_at = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.array_append(cut_at, word))


def _key(kind: str, word: Column) -> Column:
    """Keys are hashes; two words with the same one only give a task a pattern that it doesn't need."""
    return F.xxhash64(F.lit(kind), word).alias("key")


def _meeting_keys(vw: DataFrame, p: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """``vid, key`` of the values and ``key, pid, nv`` of the patterns: every pair that can match shares a key; ``nv`` values have it.

    Few values have the same letters as a whole, so ``nv`` is 1 for those keys.
    """
    vocabulary = vw.where(F.col("kind").isin("w", "s")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("kind") == "s").alias("short"))
    vocabulary = cut(vocabulary)
    words = p.select("pid", F.explode("words").alias("word"))
    rare = words.join(vocabulary.select("word", "n"), "word", "left").groupBy("pid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), -F.length("word"), "word")).alias("x"))
    rare = cut(rare.select("pid", F.col("x.word").alias("keyword")))
    k = rare.select("keyword").distinct()
    fuzzy = lambda c: (F.length(c) >= 4) & (F.length(c) <= longest + 1) & ~F.col(c).rlike(r"\P{L}")
    exact = vocabulary.join(k, F.col("word") == F.col("keyword")).select("word", "keyword")
    near = vocabulary.where(fuzzy("word")).select("word", F.explode(_variants(F.col("word"))).alias("x")).join(k.where(fuzzy("keyword")).select("keyword", F.explode(_variants(F.col("keyword"))).alias("x")), "x").select("word", "keyword")
    begins = k.where(F.length("keyword") > 3).select("keyword", F.explode(F.sequence(F.lit(3), F.length("keyword") - 1)).alias("i")).select("keyword", F.expr("substring(keyword, 1, i)").alias("word"))
    short = vocabulary.where("short").select("word").join(begins, "word").select("word", "keyword")
    stands_for = exact.unionByName(near).unionByName(short).distinct().join(vocabulary.select("word", "n"), "word")
    glued = p.where(~F.col("is_code") & (F.col("glued") != ""))
    near_glued = glued.where(F.length("glued") >= GLUED_LENGTH - 1).select("pid", F.explode(_variants(F.col("glued"))).alias("x"))
    one_value = F.lit(1).cast("long").alias("nv")
    pk = rare.join(stands_for, "keyword").select(_key("w", F.col("word")), "pid", F.col("n").alias("nv")).unionByName(glued.select(_key("g", F.col("glued")), "pid", one_value)).unionByName(near_glued.select(_key("h", F.col("x")), "pid", one_value))
    one = vw.where("kind = 'h'").select("vid", F.explode(_variants(F.col("word"))).alias("x"))
    vk = vw.where(F.col("kind").isin("w", "s")).select("vid", _key("w", F.col("word"))).unionByName(vw.where("kind = 'g'").select("vid", _key("g", F.col("word")))).unionByName(one.select("vid", _key("h", F.col("x"))))
    return vk, pk


def resolve_values(values: DataFrame, patterns: DataFrame, block_patterns: int = BLOCK_PATTERNS, chunk_values: int = CHUNK_VALUES) -> DataFrame:
    """``value, entity_id, score`` for each distinct non-blank ``value``; -1 and 0 if it is none of the list. Equal scores go to the smaller id."""
    spark = values.sparkSession
    v = values.select(F.col("value").cast("string").alias("value")).where(F.col("value").isNotNull() & (F.trim("value") != "")).distinct()
    v = cut(v.withColumn("vid", F.monotonically_increasing_id()))
    p = patterns.select(F.col("pattern").cast("string"), F.col("id").cast("long"), F.col("is_code").cast("boolean")).mapInArrow(_pattern_words, "pattern string, id long, is_code boolean, words array<string>, glued string")
    p = cut(p.where(F.size("words") > 0).withColumn("pid", F.monotonically_increasing_id()))
    longest = p.agg(F.max(F.length("glued"))).first()[0]
    n_values = v.count()
    if n_values == 0 or longest is None:
        return v.select("value", F.lit(-1).cast("long").alias("entity_id"), F.lit(0.0).alias("score"))
    list_size = p.agg(F.count(F.lit(1)), F.sum(F.length("pattern"))).first()
    if list_size[0] <= block_patterns and list_size[1] <= BLOCK_LETTERS:
        met = _by_whole_list(v, p, n_values, chunk_values)
    else:
        met = _by_keys(v, p, longest, n_values, block_patterns, chunk_values)
    best = met.where("score > 0").groupBy("vid").agg(F.max(F.struct("score", (-F.col("entity_id")).alias("minus"))).alias("x"))
    out = v.join(best, "vid", "left")
    return out.select("value", F.coalesce(-F.col("x.minus"), F.lit(-1)).cast("long").alias("entity_id"), F.coalesce("x.score", F.lit(0.0)).alias("score"))


def _by_whole_list(v: DataFrame, p: DataFrame, n_values: int, chunk_values: int) -> DataFrame:
    """``vid, score, entity_id``: the list, whose size was checked, is sent to every task."""
    spark = v.sparkSession
    sent = spark.sparkContext.broadcast([tuple(r) for r in p.select("pattern", "id", "is_code").collect()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        for b in batches:
            m = m or Matcher(sent.value)
            got = [m.best(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([i for _, i in got], pa.int64())], names=["vid", "score", "entity_id"])

    # the work is in the matching, not in the bytes: a stated number of partitions keeps small values from falling into a few tasks
    n = max(min(-(-n_values // 500), spark.sparkContext.defaultParallelism), -(-n_values // chunk_values))
    return v.select("vid", "value").repartition(n, "vid").mapInArrow(run, "vid long, score double, entity_id long")


def _by_keys(v: DataFrame, p: DataFrame, longest: int, n_values: int, block_patterns: int, chunk_values: int) -> DataFrame:
    """``vid, score, entity_id``, the best of each key that list and values have in common."""
    spark = v.sparkSession
    # folding costs more than it reads: small values are spread over the cores
    spread = v.repartition(spark.sparkContext.defaultParallelism) if n_values < 1_000_000 else v
    vw = cut(spread.select("vid", "value").mapInArrow(_value_words(longest), "vid long, kind string, word string"))
    vk, pk = _meeting_keys(vw, p, longest)
    pk = cut(pk.distinct())
    keys = pk.groupBy("key").agg(F.count(F.lit(1)).alias("np"), F.max("nv").alias("nv"))
    keys = cut(keys.select("key", F.ceil(F.col("nv") / chunk_values).cast("int").alias("parts"), F.ceil(F.col("np") / block_patterns).cast("int").alias("blocks"), "nv", "np"))
    work = keys.agg(F.coalesce(F.sum(F.col("nv") * F.col("blocks")), F.lit(0)), F.coalesce(F.sum(F.col("np") * F.col("parts")), F.lit(0))).first()
    buckets = max(min(-(-n_values // 500), spark.sparkContext.defaultParallelism), -(-work[0] // chunk_values), -(-work[1] // block_patterns))
    place = keys.select("key", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "parts", "blocks")
    unit = ["bucket", "part", "block"]
    # a key of many values is hot on their side; a pattern goes to all parts of its key, a value to all blocks of it
    at = hot_join(cut(vk), place, "key", "inner").withColumn("part", F.pmod(F.xxhash64("vid"), "parts").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = at.select(*unit, "vid").distinct().join(v, "vid")
    right = pk.select("key", "pid").join(place, "key").withColumn("block", F.pmod(F.xxhash64("pid"), "blocks").cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = right.select(*unit, "pid").distinct().join(p.select("pid", "pattern", "id", "is_code"), "pid").select(*[F.col(c).alias(f"p_{c}") for c in unit], "pattern", "id", "is_code")

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"vid": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64"), "entity_id": pd.Series([], dtype="int64")})
        m = Matcher(list(zip(b["pattern"], b["id"], b["is_code"])))
        got = [m.best(x) for x in a["value"]]
        return pd.DataFrame({"vid": a["vid"], "score": [s for s, _ in got], "entity_id": [i for _, i in got]})

    mine = [f"p_{c}" for c in unit]
    left, right = left.repartition(2 * buckets, *unit), right.repartition(2 * buckets, *mine)
    return left.groupBy(*unit).cogroup(right.groupBy(*mine)).applyInPandas(meet, "vid long, score double, entity_id long")


def resolve_sightings(ledger: DataFrame, entities: DataFrame) -> DataFrame:
    """``sighting_id, term, entity_id, score``: every sighting whose term is neither null nor blank, with its entity or -1.

    Each distinct term is resolved once; the result goes back to the sightings by ``hot_join``, so a term with a third of all rows costs no
    more than another. Rows repeated exactly come out once, terms that differ in spelling only are distinct values, other columns are not read.
    """
    s = ledger.select(F.col("sighting_id").cast("long").alias("sighting_id"), F.col("term").cast("string").alias("value")).where(F.col("value").isNotNull() & (F.trim("value") != "")).distinct()
    resolved = cut(resolve_values(s, patterns_of(entities)))
    return hot_join(s, resolved, "value", "inner").select("sighting_id", F.col("value").alias("term"), "entity_id", "score")
