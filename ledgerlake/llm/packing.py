"""Best-fit packing of token sequences, improved by swap-based local search.

Documents are tokenised, each followed by an end id; only those longer than a
sequence are cut.  Pieces are dealt at random to groups of about
``GROUP_PIECES``, one task each, so no group grows with the data.  A group is
packed by best fit, longest first.  Then the emptiest underfull sequence gives
its pieces away: it moves a piece to a sequence with room, swaps one piece for
one smaller piece, one for two, or two for one.  Each step raises the sum of
squared fills; the search ends when no sequence can be emptied any more: no
step is left, or the number of sequences has reached its lower bound.

Spaces and line ends split a text before any token is made, so the runs
between them are tokenised once per worker and remembered in a bounded memory.

An added token of the tokenizer file that stands in a text is its own id, as by the
library's default; the texts around it are tokenised apart.

Defined results: a null or empty text is the end id alone; every row, also a
repeated one, is packed; other columns are left out; an empty table gives an
empty result; texts of any length are packed whole.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_arrow, map_arrow, read, schema_with, stored

SEQUENCE = 4096
END_ID = 1
GROUP_PIECES = 20_000
MAX_KNOWN = 700_000   # remembered runs, and matches, per worker
MAX_ROUNDS = 50       # passes of the local search over a group

# The patterns that the tokenizer file splits texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PATTERN_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
LATIN_END = "\u0250"


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if Latin-1 prints it,
    or else the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, n = [], 256
    for b in range(256):
        out.append(chr(b if b in own else n))
        n += b not in own
    return out


_BYTE_CHARS = _byte_chars()
_WORDS: dict[str, "WordTokens"] = {}


class WordTokens:
    """Token ids of a text as little-endian unsigned 32-bit integers.

    The tokenizer lower-cases, splits at its pattern and merges each match on
    its own, so every match is merged once and remembered."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normal = self.tokenizer.model, self.tokenizer.normalizer.normalize_str
        self.split = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(PATTERN_ASCII, re.ASCII).findall
        self.added = {t.content: np.array([i], "<u4").tobytes()
                      for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        # The library matches them before it lower-cases, the longest first.
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split
        self.known: dict[str, bytes] = {}    # runs without a space or line end
        self.matches: dict[str, bytes] = {}

    def _ids(self, chars: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(chars)], "<u4").tobytes()

    def _match(self, match: str) -> bytes:
        ids = self._ids(match if match.isascii() and match.isprintable()
                        else "".join(map(_BYTE_CHARS.__getitem__, match.encode())))
        if len(self.matches) >= MAX_KNOWN:
            self.matches.clear()
        self.matches[match] = ids
        return ids

    def _run(self, run: str) -> bytes:
        known = self.matches
        text = run.lower() if run.isascii() else self.normal(run)
        if max(text, default="") < LATIN_END:
            parts = self.split_ascii(text) if text.isascii() else self.split(text)
            ids = b"".join([known.get(m) or self._match(m) for m in parts])
        else:  # versions of Unicode differ on what is a letter: the library's own pattern
            ids = b"".join([self._ids(m) for m, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)])
        if len(run) <= 64:
            if len(self.known) >= MAX_KNOWN:
                self.known.clear()
            self.known[run] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return b"".join([self.added[p] if k % 2 else self._plain(p) for k, p in enumerate(self.at_added(text))])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        known, learn = self.known, self._run
        return b"".join([known.get(w) or learn(w) for w in text.replace("\n", " ").split(" ") if w])


def word_tokens(path: str) -> WordTokens:
    if path not in _WORDS:
        _WORDS[path] = WordTokens(path)
    return _WORDS[path]


def pieces_of(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
              length: int = SEQUENCE, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``length`` tokens: document, piece number, start,
    length, crc32 of the ids and, if asked for, the ids."""
    ids = docs.select(F.col(id_col).alias("doc_id"))
    schema = schema_with(ids, "piece int, start long, length long, ids_crc32 long"
                         + ", ids array<long>" * keep_ids)
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(path)
        for batch in batches:
            take, rows = [], []
            for k, t in enumerate(batch.column(1)):
                raw = words.encode(t.as_py() or "") + end
                for p, at in enumerate(range(0, len(raw), step)):
                    own = raw[at:at + step]
                    take.append(k)
                    rows.append((p, at // 4, len(own) // 4, zlib.crc32(own))
                                + ((np.frombuffer(own, "<u4"),) if keep_ids else ()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64()))]
                + [pa.array([r[j] for r in rows], kinds[j]) for j in range(len(schema) - 1)],
                names=schema.names)

    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), text_col), run, schema)


def best_fit(sizes: np.ndarray, room: int) -> list[list[int]]:
    """Longest piece first, each into the fullest bin that still holds it."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = defaultdict(list)  # by room left
    mask = 0  # bit r: some bin has r left
    for k in np.argsort(-sizes, kind="stable"):
        n = int(sizes[k])
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask &= ~(1 << r)
            bins[b].append(int(k))
        else:
            b, r = len(bins), room
            bins.append([int(k)])
        if r > n:
            free[r - n].append(b)
            mask |= 1 << (r - n)
    return bins


def _give(src: list[int], dst: list[int], spare: int, s: np.ndarray) -> tuple[list[int], list[int]] | None:
    """The pieces of ``src`` and of ``dst`` whose exchange fills ``dst`` most."""
    best, gain = None, 0
    mine = sorted(src, key=lambda k: -s[k])
    yours = sorted(dst, key=lambda k: s[k])
    for x in mine:
        if gain < s[x] <= spare:                       # a move
            best, gain = ([x], []), int(s[x])
    if gain == spare:
        return best
    for x in mine:                                     # one for one
        for y in yours:
            d = int(s[x] - s[y])
            if gain < d <= spare:
                best, gain = ([x], [y]), d
    for i, x in enumerate(mine):                       # two of mine for one
        for z in mine[i + 1:]:
            for y in yours:
                d = int(s[x] + s[z] - s[y])
                if gain < d <= spare:
                    best, gain = ([x, z], [y]), d
    for x in mine:                                     # one of mine for two
        for i, y in enumerate(yours):
            if s[x] - s[y] <= gain:
                break
            for z in yours[i + 1:]:
                d = int(s[x] - s[y] - s[z])
                if d <= gain:
                    break
                if d <= spare:
                    best, gain = ([x], [y, z]), d
    return best


def local_search(bins: list[list[int]], sizes: np.ndarray, room: int, rounds: int = MAX_ROUNDS) -> list[list[int]]:
    """Empty underfull bins by moves and swaps that raise the squared fills."""
    fill = [int(sizes[b].sum()) for b in bins]
    least = -(-int(sizes.sum()) // room)
    for _ in range(rounds):
        under = sorted((k for k in range(len(bins)) if 0 < fill[k] < room), key=lambda k: fill[k])
        if sum(f > 0 for f in fill) <= least or len(under) < 2:
            break
        changed = False
        for src in under[:max(1, len(under) // 2)]:
            for dst in reversed(under):
                if fill[src] == 0:
                    break
                if dst == src or fill[dst] < fill[src] or fill[dst] == room:
                    continue
                if not (pick := _give(bins[src], bins[dst], room - fill[dst], sizes)):
                    continue
                mine, yours = pick
                d = int(sizes[mine].sum() - (sizes[yours].sum() if yours else 0))
                bins[src] = [k for k in bins[src] if k not in mine] + yours
                bins[dst] = [k for k in bins[dst] if k not in yours] + mine
                fill[src] -= d
                fill[dst] += d
                changed = True
        if not changed:
            break
    return [b for b in bins if b]


def pack(pieces: DataFrame, room: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a stored table of pieces."""
    cols = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*cols)
    groups = max(1, -(-pieces.count() // group_pieces))
    # Row numbers of a stored table are the same in every run of a task.
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    schema = schema_with(pieces, "sequence_id long, offset long")

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("_g").sort_by(
            [(c, "ascending") for c in ("length", "ids_crc32", "doc_id", "piece")])
        sizes = rows.column("length").to_numpy().astype(np.int64)
        bins = local_search(best_fit(sizes, room), sizes, room)
        seq, off = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        for b, own in enumerate(bins):
            seq[own] = (key[0].as_py() << 32) + b
            off[own] = np.concatenate(([0], np.cumsum(sizes[own])[:-1]))
        return rows.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    return group_arrow(pieces.withColumn("_g", group), ["_g"], solve, schema)


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    import public_tokenizers
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return pack(stored(pieces_of(docs, path), "pieces"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
