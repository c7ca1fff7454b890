"""Text that was decoded with the wrong character encoding: found and, where possible, restored, by minimum description length.

For each sentence every candidate decoding is compressed with one zstandard dictionary per language; its description length is the
shortest of those, in bits, plus an escape for each character outside the alphabet the dictionaries were trained on. A document takes the
chain that saves most over its sentences beyond the chain's own cost, and tries again on the result, as texts can be garbled more than once.
If no chain pays, the text is left unchanged.

Two kinds of step are tried. ``utf8/X``: UTF-8 bytes were read as X; only characters that together form valid UTF-8 sequences change, so a
passage may be garbled in part. ``A/B``: bytes of the single-byte encoding A were read as B; all characters above ASCII change.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wherry.session import cut

#: Encodings through which UTF-8 may have been read, and pairs (written, read) of single-byte encodings.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "mac_roman", "cp437", "cp850", "cp1251", "iso8859_2", "koi8_r", "cp866")
SINGLE = (
    ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"), ("iso8859_5", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"),
    ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("iso8859_2", "cp1250"), ("cp1252", "cp1250"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp437"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"),
)
LANGUAGES = ("en", "de", "fr", "es", "pt", "pl", "ru")
#: Size of a dictionary. All labelled texts go into it: a task condenses each ``SHARD_BYTES`` of lines to their ``CONDENSED_BYTES`` of most
#: shared stretches, those of a language are condensed once more in ``BUCKETS`` groups, and the dictionary is trained on what these give.
DICT_BYTES, CONDENSED_BYTES, SHARD_BYTES, BUCKETS = 32_768, 262_144, 8_000_000, 16
#: Cost of a step in a document and the least saving in a sentence, for UTF-8 steps and for single-byte steps; cost of a character
#: outside the alphabet and of a word that no language writes (mixed scripts or capitals inside); times that one step is undone in a row
#: before its gain is judged. A chain goes on for as long as it pays, and ends, as every link of it makes the description shorter.
STEP_BITS, SEGMENT_BITS, ESCAPE_BITS, WORD_BITS, LOOKAHEAD = (12, 40), (8, 16), 21, 21, 4
#: Share of a language's clean texts that must have a character for it to be in the alphabet; rounds of training on what the last round holds for clean.
ALPHABET_SHARE, CLEANING_ROUNDS = 0.004, 3
#: Words with a letter above ASCII.
_WORD = re.compile(r"(?<![A-Za-z])[A-Za-z]*[^\W\d_\x00-\x7f][^\W\d_]*")
_RUN = re.compile(r"[^\x00-\x7f]+")
#: What UTF-8 sequences can be in.
_RUN_OF_TWO = re.compile(r"[^\x00-\x7f]{2,}")
#: Symbols before a letter; apostrophes, dashes and dots may stand inside a word.
_SYMBOLS = re.compile(r"[^\w\s\x00-\x7f’‘–—…·]+(?=[^\W\d_])")
#: Letters of texts whose description lengths a task keeps.
MEMO_LETTERS = 16_000_000
_SPLIT = re.compile(r"((?<=[.!?…])[ \t]+|\n+)")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
LOST = "�"


@lru_cache(200_000)
def _odd_word(w: str) -> bool:
    cyr = sum("Ѐ" <= c <= "ӿ" for c in w)
    return 0 < cyr < len(w) or not (w[1:].islower() or w.isupper() or len(w) == 1)


def _odd_in(token: str) -> int:
    n = sum(map(_odd_word, _WORD.findall(token)))
    for m in _SYMBOLS.finditer(token):
        n += m.start() > 0 and token[m.start() - 1].isalpha()
    return n


_odd_in_short = lru_cache(200_000)(_odd_in)


def odd_words(text: str) -> int:
    """Words with a letter above ASCII that mix scripts or have capitals after small letters, and symbols inside words; none goes over white space."""
    return sum([_odd_in_short(w) if len(w) < 64 else _odd_in(w) for w in text.split() if not w.isascii()])


def _high(enc: str) -> list[str]:
    """The characters of bytes 0x80 to 0xff; undefined bytes stand for themselves, as browsers have it."""
    out = []
    for b in range(0x80, 0x100):
        try:
            out.append(bytes([b]).decode(enc))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def _class(chars: list[str]) -> str:
    return "[" + "".join(re.escape(c) for c in chars) + "]"


class Step:
    """One way in which text may have been misread, and its reversal."""

    def __init__(self, name: str) -> None:
        self.name = name
        written, read = name.split("/")
        high = _high(read)
        if written == "utf8":
            lead = lambda a, b: _class(high[a - 0x80 : b - 0x80])
            tail = _class(high[:0x40])
            self.pattern = re.compile(f"(?:{lead(0xC2, 0xE0)}{tail}|{lead(0xE0, 0xF0)}{tail}{{2}}|{lead(0xF0, 0xF5)}{tail}{{3}})")
            self.to_byte = {c: 0x80 + i for i, c in enumerate(high)}
            self.table = None
            self.needs = frozenset(high[0x42:0x75]), frozenset(high[:0x40])
        else:
            self.table = {ord(c): t for c, t in zip(high, _high(written)) if c != t}
            # worth a try where a character becomes a letter that it was not
            letters = [c for c, t in zip(high, _high(written)) if c != t and t.isalpha()]
            self.pattern = re.compile(_class(letters))
            self.needs = (frozenset(letters),)

    def _sequence(self, m: re.Match) -> str:
        try:
            c = bytes(self.to_byte[x] for x in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()
        return m.group() if c == LOST else c

    def undo(self, text: str) -> str:
        return self.pattern.sub(self._sequence, text) if self.table is None else _RUN.sub(lambda m: m.group().translate(self.table), text)


@lru_cache(None)
def steps() -> tuple[Step, ...]:
    return tuple(Step(f"utf8/{x}") for x in UTF8_READ_AS) + tuple(Step(f"{a}/{b}") for a, b in SINGLE)


def above_ascii(text: str) -> frozenset[str]:
    """The characters above ASCII."""
    return frozenset("".join(_RUN.findall(text)))


@lru_cache(65_536)
def possible(chars: frozenset[str]) -> tuple[tuple[Step, ...], tuple[Step, ...], bool]:
    """The UTF-8 steps whose pattern may be found in a text of these characters above ASCII, the single-byte steps whose pattern is, and whether it can have odd words."""
    use = [s for s in steps() if not any(x.isdisjoint(chars) for x in s.needs)]
    return tuple(s for s in use if s.table is None), tuple(s for s in use if s.table is not None), any(c.isalpha() or _SYMBOLS.match(c + "a") for c in chars)


def worth_trying(text: str, model: Model, chars: frozenset[str] | None = None) -> list[Step]:
    """The steps whose candidate differs from the text and can pay.

    A UTF-8 step needs one of its sequences. A single-byte step needs a character that it turns into a letter, and a text in which something
    is off: a character outside the alphabet, an odd word, a symbol inside a word, or Cyrillic (whose encodings stay within its letters).
    Without that condition right texts are changed: of 20,000 documents at ten times scale 0.1 it kept 184 with a lone minus sign, ruled lines
    and the like from being changed, and no document found without it was lost but those.
    """
    chars = above_ascii(text) if chars is None else chars
    utf8, single, odd = possible(chars)
    out = []
    if utf8:
        runs = " ".join(_RUN_OF_TWO.findall(text))
        out = [s for s in utf8 if s.pattern.search(runs)]
    if single and (not chars <= model.alphabet or any("Ѐ" <= c <= "ӿ" for c in chars) or odd and odd_words(text)):
        out += single
    return out


class Model:
    """Dictionaries by language and the alphabet; small (bounded by ``DICT_BYTES`` a language) and sent to the tasks with their code."""

    def __init__(self, dicts: dict[str, bytes], alphabet: frozenset[str]) -> None:
        self.dicts, self.alphabet = dicts, alphabet
        self._strange = re.compile("[^\x00-\x7f" + "".join(map(re.escape, sorted(alphabet))) + "]")
        self._ready: tuple[list, list] | None = None
        self._memo: dict[str, float] = {}
        self._kept = 0

    def __reduce__(self) -> tuple:
        return Model, (self.dicts, self.alphabet)

    def _compressors(self) -> tuple[list, list]:
        """Those for texts without Cyrillic letters, and with them."""
        if self._ready is None:
            params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=False, write_checksum=False, write_dict_id=False)
            every = [(lang, zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=params)) for lang, d in sorted(self.dicts.items())]
            every = every or [("", zstandard.ZstdCompressor(compression_params=params))]
            self._ready = [c for _, c in every], [c for lang, c in every if lang == "ru"] or [c for _, c in every]
        return self._ready

    def bits(self, text: str, below: float = inf) -> float:
        """Description length of a text; infinite if its escapes and odd words alone aren't below ``below``."""
        if (b := self._memo.get(text)) is None:
            own = ESCAPE_BITS * len(self._strange.findall(text)) + WORD_BITS * odd_words(text)
            if own >= below:
                return inf
            raw = text.encode("utf-8", "surrogatepass")
            # a Latin text may stand under a wrong label in the Cyrillic dictionary; it must not become cheaper by a Cyrillic letter
            b = 8 * min([len(c.compress(raw)) for c in self._compressors()[_CYRILLIC.search(text) is not None]]) + own
            self._kept += len(text)
            if self._kept > MEMO_LETTERS:
                self._memo.clear()
                self._kept = len(text)
            self._memo[text] = b
        return b


#: Repeat offsets that end the tables of a trained dictionary; its content follows.
_TABLES_END = b"\1\0\0\0\4\0\0\0\10\0\0\0"
_LIKELY = re.compile("|".join(s.pattern.pattern for s in steps()[:2]))


def _dictionary(samples: list[bytes], size: int) -> bytes | None:
    """A dictionary trained on the samples; None if they are too few."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def condensed(samples: list[bytes]) -> bytes:
    """The samples, or their ``CONDENSED_BYTES`` of stretches that share most with the others if they are longer."""
    if sum(map(len, samples)) + len(samples) > CONDENSED_BYTES and (d := _dictionary(samples, CONDENSED_BYTES)):
        return d[d.index(_TABLES_END) + len(_TABLES_END) :]
    return b"\n".join(samples)


def _samples(contents: list[bytes]) -> list[bytes]:
    """Samples for training: the lines of short contents, pieces of condensed ones."""
    return [x[i : i + 256] for c in contents for x in c.split(b"\n") if len(x) > 8 for i in range(0, len(x), 256) if len(x) - i > 8]


def _clean(text: str, chars: frozenset[str], model: Model | None) -> bool:
    """No lost characters, no UTF-8 sequences read wrongly, and nothing that the model would change."""
    if not chars:
        return True
    if LOST in chars or any(s in steps()[:2] for s in possible(chars)[0]) and _LIKELY.search(" ".join(_RUN_OF_TWO.findall(text))):
        return False
    return model is None or not changes(text, model, chars)


def _gathered(texts: DataFrame, model: Model | None) -> DataFrame:
    """What each task has of the clean ones of ``texts(l, t)``: ``lang, what, n, content``, documents (``what`` is null) and documents by character, or condensed lines (``content``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = Counter()
        lines: dict[str, list[bytes]] = {}
        size: Counter[str] = Counter()
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["lang", "what", "n", "content"])
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not _clean(t, chars := frozenset() if t.isascii() else above_ascii(t), model):
                    continue
                seen[name, None] += 1
                for c in chars:
                    seen[name, c] += 1
                own = lines.setdefault(name, [])
                for x in t.split("\n"):
                    if len(x) > 8:
                        own.append(raw := x.encode("utf-8", "surrogatepass"))
                        size[name] += len(raw)
                if size[name] >= SHARD_BYTES:
                    yield batch([(name, None, 0, condensed(own))])
                    lines[name], size[name] = [], 0
        if rows := [(k, None, 0, condensed(x)) for k, x in lines.items() if x] + [(k, c, n, None) for (k, c), n in seen.items()]:
            yield batch(rows)

    return texts.mapInArrow(run, "lang string, what string, n long, content binary")


def _merged(table: pa.Table) -> pa.Table:
    contents = sorted(table["content"].to_pylist())
    return pa.table({"lang": table["lang"][:1], "content": pa.array([condensed(_samples(contents)) if len(contents) > 1 else contents[0]], type=pa.binary())})


def sample(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """``l, t``: the texts to train on, every one whose language is known; none is left out (the name and ``doc_id`` are from when some were)."""
    known = F.lower(F.trim(F.col(lang)))
    return docs.where(known.isin(*LANGUAGES) & F.col(text).isNotNull()).select(known.alias("l"), F.col(text).cast("string").alias("t"))


def train(texts: DataFrame) -> Model:
    """Dictionaries and alphabet from all of ``texts(l, t)``.

    Texts with lost characters or UTF-8 sequences read wrongly are left out at once, and in each further round those that the last round's
    model would change. Characters are counted exactly; texts are condensed where they stand, and no text is shuffled: a language sends
    ``BUCKETS * CONDENSED_BYTES`` to the driver at most. Which texts are condensed together follows the division into tasks.
    """
    model = None
    for _ in range(CLEANING_ROUNDS):
        got = cut(_gathered(texts, model))
        counts = got.where("content is null").groupBy("lang", "what").agg(F.sum("n").alias("n")).where("what is null or n >= 2").collect()
        sizes = {r["lang"]: r["n"] for r in counts if r["what"] is None}
        alphabet = {r["what"] for r in counts if r["what"] is not None and r["n"] >= ALPHABET_SHARE * sizes[r["lang"]]}
        merged = got.where("content is not null").groupBy("lang", F.pmod(F.xxhash64("content"), F.lit(BUCKETS)).alias("bucket")).applyInArrow(_merged, "lang string, content binary")
        contents: dict[str, list[bytes]] = {}
        for r in sorted(merged.collect()):
            contents.setdefault(r["lang"], []).append(bytes(r["content"]))
        dicts = {k: _dictionary(_samples(c), DICT_BYTES) or b"\n".join(c)[-DICT_BYTES:] for k, c in contents.items()}
        model = Model(dicts, frozenset(alphabet | {' '}))
    return model


def _undone(parts: list[str], live: list[int], s: Step, model: Model) -> Iterator[tuple[int, float, dict[int, str]]]:
    """For each number of times that the step may be undone and pays: that number, the bits saved and the sentences it changes."""
    gain, new = [0.0] * LOOKAHEAD, [{} for _ in range(LOOKAHEAD)]
    for i in live:
        cand, now = parts[i], None
        # the same step several times over: halfway the text need not be shorter than before
        for n in range(LOOKAHEAD if s.table is None else 1):
            if not s.pattern.search(cand) or (after := s.undo(cand)) == cand:
                break
            cand = after
            now = model.bits(parts[i]) if now is None else now
            g = now - model.bits(cand, now - SEGMENT_BITS[s.table is not None])
            if g > SEGMENT_BITS[s.table is not None]:
                gain[n] += g
                new[n][i] = cand
    for n in range(LOOKAHEAD):
        if new[n] and (g := gain[n] - (n + 1) * STEP_BITS[s.table is not None]) > 0:
            yield n + 1, g, new[n]


def changes(text: str, model: Model, chars: frozenset[str] | None = None) -> bool:
    """Whether anything in the text would be restored; ends at the first step that pays. ``chars``: its characters above ASCII, if known."""
    if text.isascii() or not (use := worth_trying(text, model, chars)):
        return False
    parts = _SPLIT.split(text)
    live = [i for i, p in enumerate(parts) if not p.isascii()]
    return any(True for s in use for _ in _undone(parts, live, s, model))


def restore(text: str, model: Model) -> tuple[str, list[str], int, int]:
    """The text with its garbled sentences restored, the steps undone in order, the sentences changed and the characters lost for good."""
    if text.isascii():
        return text, [], 0, 0
    use = worth_trying(text, model)
    if not use:
        return text, [], 0, text.count(LOST)
    parts = _SPLIT.split(text)
    chain: list[str] = []
    changed: set[int] = set()
    live = [i for i, p in enumerate(parts) if not p.isascii()]
    while use:
        best, best_gain, best_new = (), 0.0, {}
        for s in use:
            for n, g, new in _undone(parts, live, s, model):
                if g > best_gain:
                    best, best_gain, best_new = (s.name,) * n, g, new
        if not best:
            break
        chain += best
        changed |= set(best_new)
        for i, c in best_new.items():
            parts[i] = c
        use = worth_trying("".join(parts), model)
    out = "".join(parts)
    return out, chain, len(changed), out.count(LOST)


def garbled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", with_text: bool = True, model: Model | None = None) -> DataFrame:
    """One row for each document with a garbled passage (those of ``garbled_ids``): ``doc_id, chain, n_segments, n_lost, restorable, restored``.

    ``restorable`` is false where characters were replaced for good (U+FFFD); those documents come out even if nothing can be undone. Null and
    ASCII texts are never garbled; repeated rows come out as often as they stand; other columns are not read. One pass besides those of training, no shuffle.
    """
    model = model or train(sample(docs, doc_id, text, lang))
    schema = "doc_id long, chain string, n_segments int, n_lost int, restorable boolean, restored string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                if d is None or not t.is_valid:
                    continue
                t = t.as_py()
                if t.isascii():
                    continue
                out, chain, n, lost = restore(t, model)
                if chain or lost:
                    rows.append((d, " > ".join(chain), n, lost, lost == 0, out if with_text else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string()))], names=["doc_id", "chain", "n_segments", "n_lost", "restorable", "restored"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)


def garbled_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """``doc_id`` of the rows of ``garbled``: a document is found as soon as one step pays or a character is lost."""
    model = model or train(sample(docs, doc_id, text, lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [d for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if d is not None and t is not None and (LOST in t or changes(t, model))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64())], names=["doc_id"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long")
