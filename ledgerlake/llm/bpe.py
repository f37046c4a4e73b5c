"""Byte-level BPE by prefix dynamic programming, and decoding.

For every byte prefix of a piece of text exactly one token can be last in the
encoding of that prefix.  The table of these last tokens is filled left to
right: a vocabulary token ending at byte ``i`` is the last token there if the
token that ends where it starts may stand before it.  Two tokens may stand
side by side if merging their joined bytes gives the same two tokens again.
Walking the table back from the end gives the encoding.  A longer text only
extends the table, and an edit changes it only from the edited byte to where
the entries agree again (:class:`PrefixTable`).

Texts are split by the tokenizer's pattern first.  White space inside a text
cuts it into chunks that always start a new match of the pattern, so chunks
are encoded once per worker and remembered in a bounded memory.

Defined results: a null or empty text has no tokens; every row, also a
repeated one, is encoded; other columns pass through (input columns named
like an output column are replaced); an empty table gives an empty result;
very long texts and matches are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, read, schema_with

MAX_KNOWN = 800_000    # remembered chunks and matches per worker
MAX_STARTS = 400_000   # remembered short prefixes per worker
SHORT = 8              # bytes of a prefix that is remembered across matches
MAX_PAIRS = 1_000_000  # remembered token pairs per worker

# A space between two other characters that are not white space: a match of
# the pattern always starts there.
_CHUNK = re.compile(r"(?<=\S)(?= \S)")
_IRREGULAR = re.compile(r" \s|\s ")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_all(data: bytes, ranks: dict[bytes, int], below: int = 1 << 62) -> list[bytes]:
    """Plain BPE of a short byte string: merge the lowest-ranked pair, leftmost
    first, as long as its rank is under ``below``."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def split_last(data: bytes, ranks: dict[bytes, int]) -> tuple[int, int]:
    """The two tokens whose merge, the last of all, makes the token ``data``
    (a token's parts always rank below it)."""
    left, right = merge_all(data, ranks, ranks[data])
    return ranks[left], ranks[right]


class PrefixEncoder:
    """BPE over one vocabulary by last tokens of prefixes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = r"(?s).+"):
        import regex
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.split = regex.compile(pattern).findall
        # Reversed trie, from a token's last byte to its first: [rank, children].
        self.trie: list = [None, {}]
        for token, rank in ranks.items():
            node = self.trie
            for b in reversed(token):
                node = node[1].setdefault(b, [None, {}])
            node[0] = rank
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.starts: dict[bytes, int] = {}
        self.known: dict[str, bytes] = {}  # chunks and matches

    def _parts(self, rank: int) -> tuple[int, int] | None:
        got = self.parts.get(rank, 0)
        if got == 0:
            token = self.tokens[rank]
            got = self.parts[rank] = split_last(token, self.ranks) if len(token) > 1 else None
        return got

    def may_follow(self, left: int, right: int) -> bool:
        """Whether plain BPE of the two joined tokens gives the two again.

        The merges that made the tokens are undone from the last to the
        first; at each point the parts beside the border must not have been
        merged before the next of the undone merges took one of them."""
        key = left << 32 | right
        ok = self.pairs.get(key)
        if ok is not None:
            return ok
        x, y, before, tokens = left, right, 1 << 62, self.tokens
        while True:
            merged = self.ranks.get(tokens[x] + tokens[y])
            if merged is not None and merged < before:
                ok = False
                break
            p, q = self._parts(x), self._parts(y)
            if p is not None and (q is None or x > y):
                before, x = x, p[1]       # of equal ranks the left one merges first
            elif q is not None:
                before, y = y + 1, q[0]
            else:
                ok = True
                break
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def last_token(self, data: bytes, i: int, last: list[int]) -> int:
        """The last token of the encoding of ``data[:i]``."""
        node, j, found = self.trie, i, []
        while j:
            j -= 1
            node = node[1].get(data[j])
            if node is None:
                break
            if node[0] is not None:
                found.append((node[0], j))
        pairs = self.pairs
        for rank, at in reversed(found):
            if at == 0:  # a vocabulary token is its own encoding
                return rank
            before = last[at]
            ok = pairs.get(before << 32 | rank)
            if ok or ok is None and self.may_follow(before, rank):
                return rank
        raise ValueError(f"no token ends at byte {i}")

    def fill(self, data: bytes, last: list[int]) -> None:
        """Extend the table, which holds a prefix's entries, to all of ``data``."""
        starts = self.starts
        for i in range(len(last), len(data) + 1):
            if i > SHORT:
                last.append(self.last_token(data, i, last))
                continue
            start = data[:i]
            rank = starts.get(start)
            if rank is None:
                rank = self.last_token(data, i, last)
                if len(starts) >= MAX_STARTS:
                    starts.clear()
                starts[start] = rank
            last.append(rank)

    def walk(self, last: list[int]) -> list[int]:
        out, i, tokens = [], len(last) - 1, self.tokens
        while i > 0:
            out.append(last[i])
            i -= len(tokens[last[i]])
        out.reverse()
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:  # the pattern's match is itself a token
            return [whole]
        last = [0]
        self.fill(data, last)
        return self.walk(last)

    def _remember(self, text: str, ids: bytes) -> bytes:
        if len(text) <= 64:
            if len(self.known) >= MAX_KNOWN:
                self.known.clear()
            self.known[text] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.encode_piece(piece.encode())
        return self._remember(piece, struct.pack(f"<{len(ids)}I", *ids))

    def _chunk(self, chunk: str) -> bytes:
        pieces, known = self.split(chunk), self.known
        if len(pieces) == 1:
            return self._piece(chunk)
        return self._remember(chunk, b"".join([known.get(p) or self._piece(p) for p in pieces]))

    def encode_bytes(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if _IRREGULAR.search(text):
            chunks = _CHUNK.split(text)
        else:
            chunks = text.split(" ")
            chunks[1:] = [" " + c for c in chunks[1:]]
            if chunks and chunks[-1] == " ":  # a text that ends in a space
                chunks = _CHUNK.split(text)
        known, chunk = self.known, self._chunk
        return b"".join([known.get(c) or chunk(c) for c in chunks if c])

    def encode(self, text: str) -> list[int]:
        raw = self.encode_bytes(text)
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The growing, editable encoding of one match of the pattern."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data = encoder, data
        self.last = [0]
        encoder.fill(data, self.last)
        self.reach = max(map(len, encoder.ranks))

    def ids(self, upto: int | None = None) -> list[int]:
        """Encoding of the first ``upto`` bytes (all of them by default)."""
        n = len(self.data) if upto is None else upto
        return self.encoder.walk(self.last[:n + 1])

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.fill(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Replace ``data[start:end]``; returns how many entries were recomputed.

        An entry depends on at most the longest token's bytes before it, so
        once as many entries in a row agree with the old ones, the rest of
        the old table holds."""
        old, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start + 1]
        same, done = 0, 0
        for i in range(start + 1, len(self.data) + 1):
            rank = self.encoder.last_token(self.data, i, self.last)
            self.last.append(rank)
            done += 1
            inside = i - start - len(new)  # bytes of old text since the edit
            same = same + 1 if inside > 0 and old[i - shift] == rank else 0
            if same >= self.reach:
                self.last += old[i - shift + 1:]
                break
        return done


_ENCODERS: dict[tuple[str, str], PrefixEncoder] = {}


def encoder(path: str, pattern: str) -> PrefixEncoder:
    """The worker's encoder for a vocabulary file (built once per process)."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder(load_ranks(path), pattern)
    return _ENCODERS[key]


def encode_decode(docs: DataFrame, path: str, pattern: str, text_col: str = "text",
                  keep_ids: bool = True) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked
    for, ``ids`` (array of long).  ``path`` is a rank file on every worker."""
    made = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    rest = [c for c in docs.columns if c not in made and c != text_col]
    cols = [*rest, text_col] if keep_ids else rest
    schema = schema_with(docs.select(*cols), "n_tokens long, ids_sha256 string, decoded_sha256 string"
                         + ", ids array<long>" * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            n, a, b, ids = [], [], [], []
            for text in batch.column(text_col):
                raw = enc.encode_bytes(text.as_py() or "")
                own = struct.unpack(f"<{len(raw) // 4}I", raw)
                n.append(len(own))
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(enc.decode(own)).hexdigest())
                if keep_ids:
                    ids.append(own)
            extra = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            if keep_ids:
                extra.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in cols] + extra,
                                             names=schema.names)

    return map_arrow(docs.select(*rest, text_col), run, schema)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                         public_tokenizers.PATTERN, keep_ids=False)
