"""Toxicity by noisy-channel deobfuscation.

A disguised word (digits and signs for letters, letters spaced out or cut by
signs, letters repeated) spans a lattice of the characters it may stand for.
Viterbi decoding under a character trigram model picks the restored word; an
undisguised word has one path, itself.  A word with a sign run at an end, or
with a doubled letter, has a second reading.  Restored words are scored by how
toxic the texts are that hold them, or hold words that start the same way.

The character model is counted over all texts.  The word weights are fitted
on a bounded sample of labelled texts (``TRAIN_ROWS`` of each label, in hash
order), the counts then scaled to all labelled rows.  Toxic texts count once
per left neighbour of a word, so copies of one text do not make its ordinary
words look toxic.  All words and starts are weighed on Spark; those likelier in toxic
texts are collected.

Defined results: a null or empty text has the score of a text without toxic
words; null labels and labels of unknown texts teach nothing; a text with
several labels is toxic if one says so; every row, also a repeated one, is
returned; with nothing to learn from, every score is 0; other columns pass
through (input columns named like an output column are replaced); an empty
table gives an empty result; very long texts are read whole.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, read, schema_with

TRAIN_ROWS = 20_000     # labelled texts of each label
MIN_CONTEXTS = 3        # different left neighbours of a toxic word
DOUBT = 2               # texts that a word's weight starts from, toxic at the rate of all
STARTS = (4, 5)         # lengths of word starts
MAX_KNOWN = 600_000     # remembered words per worker
TOXIC = 0.7

# The letters a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
        "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
ANY = "*#"                       # signs that may stand for any letter
MANY = 64                        # lattice states from which any-letter signs are decoded as arrays
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIZE = len(LETTERS) + 2          # other characters are 0, other letters the last code
SUBSTITUTE, WILD, REPEAT, DROP = math.log(0.5), math.log(0.02), math.log(0.3), math.log(0.3)

_EDGES = ".,;:?\"'()[]{}<>=-_/\\&%"
_RUN = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
_PLAIN = re.compile(r"(?:([^\W\d_])(?!\1))*")  # letters up to the first of a double
_LONG_RUN = re.compile(r"([^*#])\1\1+")   # no word has three of a letter: more say the same as two
_PART = r"[^\W_]|[@$!|+(€£*#]"
_SPACED = re.compile(rf"(?<![^\s.,;:?])(?:(?:{_PART})[ .\-_*]){{2,}}(?:{_PART})(?![^\s.,;:?!])")
_CODES: np.ndarray | None = None
# What a worker has decoded and weighed, kept between tasks: for the last model, as far as it is known.
_READINGS: tuple[str, dict[str, list[str]]] = ("", {})
_CHANCES: tuple[str, dict[str, float], set[str]] = ("", {}, set())
_TAILS: tuple[str, dict[tuple, str]] = ("", {})


def _kept(held: tuple[str, dict], name: str) -> tuple[str, dict]:
    return held if held[0] == name and len(held[1]) < MAX_KNOWN else (name, {})


def _codes() -> np.ndarray:
    global _CODES
    if _CODES is None:
        _CODES = np.fromiter(((LETTERS.index(chr(i)) + 1 if chr(i) in LETTERS else
                               (SIZE - 1 if chr(i).isalpha() else 0)) for i in range(0x110000)), np.uint16, 0x110000)
    return _CODES


def trigram_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of character trigrams over all texts (SIZE^3 numbers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SIZE ** 3, np.int64)
        for b in batches:
            for t in b.column(0):
                text = t.as_py()
                if text:
                    a = _codes()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)]
                    n += np.bincount((a[:-2].astype(np.int64) * SIZE + a[1:-1]) * SIZE + a[2:], minlength=SIZE ** 3)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["t", "n"])

    out = np.zeros(SIZE ** 3, np.int64)
    for r in map_arrow(docs.select(text_col), run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
        out[r["t"]] = r["n"]
    return out


@dataclass
class Model:
    lm: np.ndarray = field(default_factory=lambda: np.zeros((SIZE, SIZE, SIZE)))
    weight: dict[str, float] = field(default_factory=dict)  # feature: chance that its text is toxic
    base: float = 0.0                                       # of a text without any
    letters: str = ""                                       # names of the trigrams
    weighed: str = ""                                       # and of the weights, for what workers keep

    def decode(self, word: str) -> str:
        """The likeliest plain spelling of a disguised word.

        Letters before the first sign or double have one path, so what follows depends on
        the last two of them alone, and is decoded once for each such pair."""
        global _TAILS
        n = len(_PLAIN.match(word)[0])
        code = _codes()
        at = (0, *(int(code[ord(c)]) for c in word[max(0, n - 2):n]))[-2:] if n else (0, 0)
        last = word[n - 1:n] if word[n - 1:n] == word[n:n + 1] else ""  # matters where it is doubled
        key = (*at, last, word[n:])
        got = _TAILS[1].get(key) if _TAILS[0] == self.letters else None
        if got is None:
            _TAILS = _kept(_TAILS, self.letters)
            got = _TAILS[1][key] = self._decode(at, last, word[n:])
        return word[:n] + got

    def _decode(self, at: tuple[int, int], last: str, word: str) -> str:
        """The likeliest spelling of what follows the character ``last``, from a lattice state on."""
        code = _codes()
        states: dict[tuple[int, int], tuple[float, tuple]] = {at: (0.0, ())}  # texts as linked lists
        for c in word:
            if c in ANY and len(states) > MANY:
                states, last = self._any(states), c
                continue
            if c.isalpha():
                options = [(c, 0.0)]
                if c == last:
                    options.append(("", REPEAT))
            elif c in ANY:
                options = [(x, WILD) for x in LETTERS] + [("", DROP)]
            elif c in LEET:
                options = [(x, SUBSTITUTE) for x in LEET[c]]
                if not c.isdigit():
                    options.append(("", DROP))
                elif c == last:
                    options.append(("", REPEAT))
            else:
                options = [("", DROP)]
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (p, text) in states.items():
                for x, cost in options:
                    if x:
                        k = int(code[ord(x)]) if len(x) == 1 else 0
                        key, q, t = (b, k), p + cost + self.lm[a, b, k], (text, x)
                    else:
                        key, q, t = (a, b), p + cost, text
                    if key not in new or q > new[key][0]:
                        new[key] = (q, t)
            states, last = new, c
        text = max(((p + self.lm[a, b, 0], text) for (a, b), (p, text) in states.items()), key=lambda x: x[0])[1]
        out = []
        while text:
            text, x = text
            out.append(x)
        return "".join(reversed(out))

    def _any(self, states: dict) -> dict:
        """The lattice after a sign for any letter."""
        p = np.full((SIZE, SIZE), -np.inf)
        for at, (q, _) in states.items():
            p[at] = q
        paths = p[:, :, None] + self.lm[:, :, 1:SIZE - 1]
        before, best = paths.argmax(0).tolist(), (paths.max(0) + WILD).tolist()
        new = {at: (q + DROP, text) for at, (q, text) in states.items()}
        for b in {b for _, b in states}:
            for k, x in enumerate(LETTERS):
                q = best[b][k]
                if (b, k + 1) not in new or q > new[b, k + 1][0]:
                    new[b, k + 1] = (q, (states[before[b][k], b][1], x))
        return new

    def readings(self, chunk: str) -> list[str]:
        """The plain words that a lower-case run of characters without white space may
        stand for, the likeliest first."""
        global _READINGS
        if chunk.isalpha() and not _DOUBLE.search(chunk):
            return [chunk]
        got = _READINGS[1].get(chunk) if _READINGS[0] == self.letters else None
        if got is None:
            _READINGS = _kept(_READINGS, self.letters)
            got = _READINGS[1][chunk] = self._readings(chunk)
        return got

    def _readings(self, chunk: str) -> list[str]:
        if not chunk.isalpha():
            inner = chunk.strip(_EDGES)
            chunk = inner.rstrip("!") if inner.rstrip("!").isalpha() else inner
        if not any(c.isalpha() or c in LEET for c in chunk):
            return [chunk]
        core = chunk.strip(ANY)
        found = [core] if core.isalpha() and not _RUN.search(core) else []
        chunk = _LONG_RUN.sub(r"\1\1", chunk)
        core = chunk.strip(ANY)
        if not found or _DOUBLE.search(core):
            found.append(self.decode(core))
        return found + ([self.decode(chunk)] if core != chunk else [])

    def restore(self, chunk: str) -> str:
        """The likeliest reading."""
        return self.readings(chunk)[0]

    def _weigh(self, word: str) -> float:
        return max((self.weight.get(f, 0.0) for f in features(word)), default=0.0)

    def chance(self, chunk: str) -> float:
        """The highest weight of what a chunk may stand for."""
        return self.highest({chunk})

    def highest(self, chunks: set[str]) -> float:
        """The highest chance of some chunks.  Most have been seen to have none, and are set aside at once."""
        global _CHANCES
        if _CHANCES[0] != self.weighed or len(_CHANCES[2]) >= MAX_KNOWN:
            _CHANCES = (self.weighed, {}, set())
        _, found, none = _CHANCES
        best = 0.0
        for chunk in chunks.difference(none):
            got = found.get(chunk)
            if got is None:
                got = self._chance(chunk)
                if got:
                    found[chunk] = got
                else:
                    none.add(chunk)
            best = max(best, got)
        return best

    def _chance(self, chunk: str) -> float:
        word = chunk if chunk.isalpha() else chunk.strip(_EDGES).rstrip("!")
        if not word.isalpha() or _RUN.search(word):
            return max(map(self._weigh, self.readings(chunk)), default=0.0)
        found = self._weigh(word)
        # The second reading of a word with doubles is one of its shorter forms: decoded if any has a weight.
        if _DOUBLE.search(word) and any(map(self._weigh, undoubled(word))):
            found = max([found, *map(self._weigh, self.readings(word))])
        return found

    def chunks(self, text: str) -> list[str]:
        """The text's runs of characters; a spaced-out word is one of them."""
        text = text.lower()
        return text.split() + [m[::2] for m in _SPACED.findall(text)]

    def score(self, text: str | None) -> float:
        if not text:
            return self.base
        return max(self.base, self.highest(set(self.chunks(text))))


def undoubled(word: str) -> list[str]:
    """All spellings of a word with any of its doubled letters written once."""
    found, at = [""], 0
    for m in _DOUBLE.finditer(word):
        found = [w + word[at:m.start()] + x for w in found for x in (m[0], m[1])]
        at = m.end()
    return [w + word[at:] for w in found]


def features(word: str) -> list[str]:
    """A word and its starts."""
    return [f"={word}", *(f"^{word[:n]}" for n in STARTS if len(word) > n)] if word else []


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", all_docs: DataFrame | None = None) -> Model:
    """Learn from the labelled rows of ``docs``; characters from ``all_docs``."""
    n = trigram_counts(all_docs if all_docs is not None else docs, text_col).reshape(SIZE, SIZE, SIZE) + 0.1
    model = Model(lm=np.log(n / n.sum(2, keepdims=True)), letters=uuid.uuid4().hex)
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
             .groupBy(id_col).agg(F.max(label_col).alias("_y")))
    sizes = {r["_y"]: r["count"] for r in known.filter("_y IN (0, 1)").groupBy("_y").count().collect()}
    if len(sizes) < 2:
        return model
    picked = [known.filter(F.col("_y") == y).orderBy(F.xxhash64(id_col), id_col).limit(TRAIN_ROWS) for y in (0, 1)]
    # TRAIN_ROWS ids a label: small enough to send everywhere, at any size.
    texts = (docs.select(id_col, text_col).filter(F.col(text_col).isNotNull())
             .join(F.broadcast(picked[0].unionByName(picked[1])), id_col).select(text_col, "_y"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One left neighbour (the least by hash) of every feature of a text."""
        for b in batches:
            pairs: set[tuple[str, int]] = set()
            for t in b.column(0):
                least: dict[str, int] = {}
                left = 0
                for c in model.chunks(t.as_py()):
                    words = model.readings(c)
                    for f in (f for w in words for f in features(w)):
                        if left < least.get(f, 1 << 32):
                            least[f] = left
                    left = zlib.crc32(words[0].encode())
                pairs.update(least.items())
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()),
                                              pa.array([p[1] for p in pairs], pa.int64())], names=["f", "c"])

    found = (map_arrow(texts.filter("_y = 1").select(text_col), contexts, "f string, c long")
             .distinct().groupBy("f").agg(F.count("c").alias("n"))
             .filter(F.col("n") >= MIN_CONTEXTS))

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                words = {w for c in set(model.chunks(t.as_py())) for w in model.readings(c)}
                n.update({f for w in words for f in features(w)})
        yield pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()),
                                          pa.array(list(n.values()), pa.int64())], names=["f", "n"])

    clean = (map_arrow(texts.filter("_y = 0").select(text_col), clean_counts, "f string, n long")
             .groupBy("f").agg(F.sum("n").alias("n0")))
    scale = {y: max(1.0, sizes[y] / TRAIN_ROWS) for y in (0, 1)}
    prior = sizes[1] / (sizes[0] + sizes[1])
    a, b = F.col("n") * scale[1], F.coalesce("n0", F.lit(0)) * scale[0]
    weighed = found.join(clean, "f", "left").select("f", ((a + DOUBT * prior) / (a + b + DOUBT)).alias("p"))
    model.weight = {r["f"]: r["p"] for r in weighed.filter("p > 0.5").collect()}  # of TRAIN_ROWS texts at most
    model.weighed = uuid.uuid4().hex

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            none = [int(model.score(t.as_py()) == 0.0) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(none, pa.int64())], names=["y", "n"])

    left = {r["y"]: r["n"] for r in map_arrow(texts.select(text_col, F.col("_y").cast("long")), plain,
                                              "y long, n long").groupBy("y").agg(F.sum("n").alias("n")).collect()}
    a, b = left.get(1, 0) * scale[1], left.get(0, 0) * scale[0]
    model.base = min(0.5, a / (a + b)) if a + b else 0.0
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds ``score`` and ``predicted``."""
    docs = docs.drop(*[c for c in ("score", "predicted") if c != text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.array([model.score(t.as_py()) for t in b.column(text_col)], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array((s >= TOXIC).astype(np.int32))],
                                             names=[*b.schema.names, "score", "predicted"])

    return map_arrow(docs, run, schema_with(docs, "score double, predicted int"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    from .langid import held_out
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    learn = docs.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1))
    labels = read(spark, sf_dir, "labels").filter(~held_out("doc_id", 3, 1))
    model = fit(learn, labels, all_docs=docs)
    return predict(docs.withColumn("held_out", held_out("doc_id", 3, 1)), model).drop("text")
