"""Byte-level BPE encoding and decoding (operator 10).

Bytes are mapped to Latin-1 characters so that a pyahocorasick automaton over the vocabulary finds every
token in a piece of text in one pass. Encoding walks the piece with the longest match first and backtracks: a
token may follow another only if the merge rule, run on the two together, gives exactly these two. That
test is memoised by pair, and a position found to be a dead end is never entered again, so a piece takes time
linear in its length and the ids are exactly those of rank-ordered merging.

Defined results: a null text is the empty text; the empty text has 0 ids, and the digests are those of the empty
string. A null doc_id stays null. Repeated rows give repeated results. Columns other than the id and the text
are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts

#: Pieces of text whose ids, and pairs of tokens whose tests, a worker remembers; when so many are held, it starts anew.
CACHE_PIECES, CACHE_PAIRS = 300_000, 1_000_000


class BytePairEncoder:
    """Encoder and decoder for one file of ranks (base64 token, space, rank in each line)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens: dict[int, bytes] = {r: t for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.compatible: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in ranks.items():
            # a token that merging never builds can't be part of a merged result
            if len(token) == 1 or self._merged(token) == [rank]:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.sizes = {r: len(t) for t, r in ranks.items()}
        self.prefixes: dict[int, int | None] = {}
        self.edges: dict[tuple[int, int], list[tuple[bytes, float]]] = {}
        self.pieces: dict[str, tuple[int, ...]] = _Pieces(self)

    @classmethod
    def load(cls, path: str, pattern: str) -> BytePairEncoder:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def _merged(self, data: bytes) -> list[int]:
        """Rank-ordered merging of a short string: the definition that everything else must agree with."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            if len(parts) == 2:
                self.halves[best] = (ranks[parts[0]], ranks[parts[1]])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _edge(self, rank: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at one end of a token while it is merged, from the byte upwards, each with the rank that ends it."""
        known = self.edges.get((rank, side))
        if known is None:
            known, ends, at = [], float("inf"), rank
            while True:
                known.append((self.tokens[at], ends))
                if at not in self.halves:
                    break
                ends, at = at, self.halves[at][side]
            known.reverse()
            self.edges[rank, side] = known
        return known

    def _may_follow(self, left: int, right: int) -> bool:
        known = self.compatible.get((left, right))
        if known is None:
            if len(self.compatible) >= CACHE_PAIRS:
                self.compatible.clear()
            known = self.compatible[left, right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives just the two: no merge across the border comes before those on either side.

        Of equal ranks the leftmost merge is first, so the border waits for its left side and not for its right side.
        """
        a, b, ranks = self._edge(left, 1), self._edge(right, 0), self.ranks
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            across = ranks.get(x + y)
            if across is not None and across < x_ends and across <= y_ends:
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        marks = data.decode("latin-1")
        longest = self.automaton.iter_long
        tokens = [found for _, found in longest(marks)]  # the longest match at each step
        known, last = self.compatible, tokens[0]
        for token in tokens[1:]:
            ok = known.get((last, token))
            if not ok and (ok is False or not self._may_follow(last, token)):
                return self._backtrack(marks)
            last = token
        return tokens

    def _backtrack(self, marks: str) -> list[int]:
        """The same walk with backtracking: shorter matches where the longest can't follow, no position entered twice in vain."""
        n, longest, sizes = len(marks), self.automaton.iter_long, self.sizes
        dead = bytearray(n + 1)
        tokens: list[int] = []
        pos = 0
        token: int | None = next(longest(marks))[1]
        while True:
            last = tokens[-1] if tokens else None
            while token is not None and (dead[pos + sizes[token]] or (last is not None and not self._may_follow(last, token))):
                token = self._shorter(token)
            if token is not None:
                tokens.append(token)
                pos += sizes[token]
                if pos == n:
                    return tokens
                token = next(longest(marks, pos))[1]
            else:
                dead[pos] = 1
                token = tokens.pop()
                pos -= sizes[token]
                token = self._shorter(token)

    def _shorter(self, rank: int) -> int | None:
        """The longest usable token that is a proper prefix of this one."""
        known = self.prefixes.get(rank, -1)
        if known == -1:
            token, known = self.tokens[rank], None
            for size in range(len(token) - 1, 0, -1):
                r = self.ranks.get(token[:size])
                if r is not None and token[:size].decode("latin-1") in self.automaton:
                    known = r
                    break
            self.prefixes[rank] = known
        return known

    def encode(self, text: str) -> list[int]:
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Pieces(dict):
    """Piece of text to ids; what is missing is encoded."""

    def __init__(self, encoder: BytePairEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encoder.encode_piece(piece.encode("utf-8")))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


_LOADED: dict[tuple[str, str], BytePairEncoder] = {}


def encoder_of(path: str, pattern: str) -> BytePairEncoder:
    """The encoder for a file, built once in each worker process."""
    key = (path, pattern)
    if key not in _LOADED:
        _LOADED[key] = BytePairEncoder.load(path, pattern)
    return _LOADED[key]


def encode_texts(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for.

    docs has doc_id and text. path is a file that every executor has. The decoded bytes come from the ids alone.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(path, pattern)
        names = {r: str(r) for r in enc.tokens}
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            n, ids_sha, decoded_sha, kept = [], [], [], []
            for text in batch.column(1):
                ids = enc.encode(text.as_py())
                n.append(len(ids))
                ids_sha.append(digest(",".join(map(names.__getitem__, ids)).encode("ascii")))
                decoded_sha.append(digest(enc.decode(ids)))
                if with_ids:
                    kept.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, schema.field("ids").type)] if with_ids else []), schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # the tables are large and hold no cycles
        try:
            yield from encoded(batches)
        finally:
            gc.enable()  # workers are used again

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    rows = texts(docs)
    return rows.withColumn("doc_id", rows.doc_id.cast("long")).mapInArrow(run, ddl)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every whole text of documents, by the multilingual ranks."""
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
