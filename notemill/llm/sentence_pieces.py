"""SentencePiece encoding and decoding for merge-type models (operator 13).

A merge-type model joins, again and again, the two neighbouring symbols whose union is the piece of the best score, the leftmost of equal ones. What it gives for a text begins with what it gives for each of
that result's own prefixes, and two pieces may follow each other anywhere if and only if merging the two alone gives exactly these two. So every prefix of a text has one last token, and it is found from
those of shorter prefixes: of the pieces that end there (an automaton over the vocabulary lists them, longest first) it is the one that may follow the last token of what stands before it. The
ids are read from this table backwards. That takes time linear in the text, however long it is without a space; nothing is merged but pairs of pieces, whose test is remembered.

No piece has a space mark behind another character (this is looked up, not assumed), so no merge crosses such a place, nor a character that no piece has; words between these are encoded apart and remembered.
Characters without a piece become the ids of their UTF-8 bytes, or the unknown id in models without byte pieces. Normalisation is the model's own.

Defined results: a null text is the empty text; the empty text has only the begin and end ids, and its decoded text is empty. A null doc_id stays null. Repeated rows give repeated results. Columns other
than the id and the text are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts

#: Words whose ids, and pairs of pieces whose tests, a worker remembers; when so many are held, it starts anew.
CACHE_WORDS, CACHE_PAIRS = 300_000, 1_000_000
#: Longest word (in characters) that is remembered.
CACHE_LENGTH = 64

_SPACE = "▁"


class PieceEncoder:
    """Encoder and decoder for one merge-type model."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize: Callable[[str], str] = model.normalize
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.pieces: list[str] = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.control = {i for i in range(len(self.pieces)) if model.is_control(i)}
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.id_of_byte = {b: i for i, b in self.byte_of.items()}
        special = self.control | set(self.byte_of) | {self.unknown}
        if any(model.is_unused(i) for i in range(len(self.pieces))):
            raise ValueError("models with unused pieces are not supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.dummy = model.normalize("a").startswith(_SPACE)  # a space mark is put in front, and taken away again
        self.apart: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.edges: tuple[dict[str, list[tuple[str, float]]], ...] = ({}, {})
        self.automaton = ahocorasick.Automaton()
        self.alphabet = set("".join(self.ids))
        for piece in self.alphabet | {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}:
            self.automaton.add_word(piece, (piece, len(piece)))  # a piece that merging never builds can't be part of a result
        self.automaton.make_automaton()
        self.falling = all(self.scores[p] <= self.scores.get(half, math.inf) for p, pair in self.halves.items() if p in self.scores for half in pair if len(half) > 1)
        lone = "".join(c for c in "\n\t\r" if c not in self.alphabet)
        inner = any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in self.ids)
        self.words = re.compile("[\\s\\S]+" if inner else f"[{lone}]|{_SPACE}+[^{_SPACE}{lone}]*|[^{_SPACE}{lone}]+" if lone else f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+").findall
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Score-ordered merging of a short string: the definition that everything else must agree with."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            if len(parts) == 2:
                self.halves[parts[0] + parts[1]] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at one end of a piece while it is merged, from the character upwards, each with the score of the merge that ends it."""
        known = self.edges[side].get(piece)
        if known is None:
            known, ends, at = [], -math.inf, piece
            while True:
                known.append((at, ends))
                if len(at) == 1:
                    break
                ends, at = self.scores[at], self.halves[at][side]
            known.reverse()
            self.edges[side][piece] = known
        return known

    def may_follow(self, left: str, right: str) -> bool:
        known = self.apart.get((left, right))
        if known is None:
            if len(self.apart) >= CACHE_PAIRS:
                self.apart.clear()
            known = self.apart[left, right] = self.stay_apart(left, right) if self.falling else self.merged(left + right) == [left, right]
        return known

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether merging both gives just the two, where no merge has a better score than those that made its parts.

        Merges on either side then come in the order of their scores, and what stands at the border changes with them. Of equal scores the leftmost merge is first, so the border waits for its left side and
        not for its right side.
        """
        a, b, scores = self.edge(left, 1), self.edge(right, 0), self.scores
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            across = scores.get(x + y)
            if across is not None and across > x_ends and across >= y_ends:
                return False
            if x_ends == y_ends == -math.inf:
                return True
            if x_ends >= y_ends:
                i += 1
            else:
                j += 1

    def last_tokens(self, word: str) -> list[str | None]:
        """For each prefix of word, by its length, the last token of its encoding; None for the empty prefix and behind a character that no piece has."""
        last: list[str | None] = [None] * (len(word) + 1)
        for end, (piece, size) in self.automaton.iter(word):
            end += 1
            if last[end] is None:
                before = last[end - size]
                if before is None or self.may_follow(before, piece):
                    last[end] = piece
        return last

    def word_ids(self, word: str) -> bytes:
        """Ids of one word, as little-endian unsigned 32-bit integers."""
        whole = self.ids.get(word)
        if whole is not None and word in self.automaton:
            return whole.to_bytes(4, "little")
        last = self.last_tokens(word)
        found: list[int] = []
        at = len(word)
        while at:
            token = last[at] or word[at - 1]
            own = self.ids.get(token)
            if own is not None:
                found.append(own)
            elif self.id_of_byte:
                found.extend(self.id_of_byte[b] for b in reversed(token.encode("utf-8")))
            elif not found or found[-1] != self.unknown:  # neighbouring unknown characters are one token
                found.append(self.unknown)
            at -= len(token)
        found.reverse()
        return b"".join(i.to_bytes(4, "little") for i in found)

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text with the begin and end ids, as little-endian unsigned 32-bit integers."""
        known = self.known
        out = [self.begin.to_bytes(4, "little")]
        for word in self.words(self.normalize(text)):
            ids = known.get(word)
            if ids is None:
                ids = self.word_ids(word)
                if len(word) <= CACHE_LENGTH:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[word] = ids
            out.append(ids)
        out.append(self.end.to_bytes(4, "little"))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return unpacked(self.encode_packed(text))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: the mark in front is taken away once, runs of byte ids are read as UTF-8, control ids have no text."""
        out: list[str] = []
        run = bytearray()
        front = self.dummy
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                run.append(byte)
                front = False
                continue
            if run:
                out.append(utf8(bytes(run)))
                run.clear()
            if i in self.control:
                continue
            piece = " ⁇ " if i == self.unknown else self.pieces[i]
            if front and piece.startswith(_SPACE):
                piece = piece[1:]
                front = False
            elif piece:
                front = False
            out.append(piece.replace(_SPACE, " "))
        if run:
            out.append(utf8(bytes(run)))
        return "".join(out)


def utf8(data: bytes) -> str:
    """data as UTF-8; each byte that begins no whole character is one replacement character."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode("utf-8"))
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            at += size
        return "".join(out)


def unpacked(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


_LOADED: dict[str, PieceEncoder] = {}


def encoder_of(path: str) -> PieceEncoder:
    """The encoder for a model, built once in each worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceEncoder(path)
    return _LOADED[path]


def encode_pieces(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_tokens (all ids), ids_sha256, decoded_sha256, and the ids and the decoded text if asked for.

    docs has doc_id and text. path is a model file that every executor has. The decoded text comes from the ids alone.
    """
    more = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if with_ids else []
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                packed = encoder.encode_packed(text.as_py())
                ids = unpacked(packed)
                decoded = encoder.decode(ids)
                rows.append((len(ids), digest(packed), digest(decoded.encode("utf-8"))) + ((ids, decoded) if with_ids else ()))
            made = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), schema.types[1:], strict=True)] if rows else [pa.array([], kind) for kind in schema.types[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    rows = texts(docs)
    return rows.withColumn("doc_id", rows.doc_id.cast("long")).mapInArrow(run, ddl)


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every whole text of documents, by the model of 32,000 pieces."""
    import public_tokenizers

    return encode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)
