"""SentencePiece encoding and decoding: Viterbi over a double-array trie of pieces with scores.

The best segmentation of a text is the one whose pieces have the largest sum of scores.  A character that is no piece
itself becomes its UTF-8 bytes, one byte piece each.  Spaces are written as a marker that stands at the beginning of
pieces; decoding turns markers back into spaces and joins bytes, so a text comes back as it was, also one that holds
the marker character itself: that one is encoded as bytes.

No piece holds a marker after another character, and none a line break, so texts are cut there: the segmentation of a
text is that of its parts, and a worker remembers those of words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_MODEL = "piece_bpe_32k.model"
MARKER = "▁"
# How much worse than the worst piece a character is that must be written as bytes.
UNKNOWN_PENALTY = 10.0
# Words kept by a worker; when full, the memory starts anew.
REMEMBERED = 300_000


class DoubleArray:
    """A trie over bytes: the child of state s by byte c is base[s] + c + 1 where check of that place is s."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, number in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = children[node][c]
            value[node] = number
        size = 2 * len(children) + 512
        # Room for any byte beyond the last base, so that a step needs no test of the length.
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        taken = bytearray(size)
        taken[0] = 1
        # States with one child fill the first free place; others are placed onwards, as searching from there each
        # time would pass the same crowded places again and again.  Places that a base of zero reaches are left out.
        free = onward = 258
        todo = [(0, 0)]  # (node, its place)
        for node, place in todo:
            below = sorted(children[node])
            if not below:
                continue
            while taken[free]:
                free += 1
            base = (free if len(below) == 1 else onward) - below[0] - 1
            while base + 260 >= len(taken) or any(taken[base + c + 1] for c in below):
                if base + 260 < len(taken):
                    base += 1
                else:
                    more = len(taken)
                    taken.extend(bytes(more))
                    self.base += [0] * more
                    self.check += [-1] * more
                    self.value += [-1] * more
            self.base[place] = base
            if len(below) > 1:
                onward = max(onward, base + below[0] + 1)
            for c in below:
                at = base + c + 1
                taken[at] = 1
                self.check[at] = place
                self.value[at] = value[children[node][c]]
                todo.append((children[node][c], at))

    def matches(self, data: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(stop, number) of the keys that begin at ``start``."""
        base, check, state = self.base, self.check, 0
        for at in range(start, len(data)):
            child = base[state] + data[at] + 1
            if check[child] != state:
                return
            state = child
            if self.value[state] >= 0:
                yield at + 1, self.value[state]


def log_scores(scores: np.ndarray) -> np.ndarray:
    """Log probabilities of pieces.  A unigram model states them.  A model of merges states ranks, 0, -1, -2 and so
    on, which are turned into the probabilities of Zipf's law, in proportion to 1 / (rank + 1)."""
    ranks = -scores
    if not (ranks == np.round(ranks)).all():
        return scores
    return -np.log(ranks + 1) - np.log((1 / np.arange(1, len(ranks) + 1)).sum())


class Pieces:
    """The pieces of a model file: texts, scores, and which of them are bytes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        self.score = log_scores(np.array([model.get_score(i) for i in range(count)]))
        self.byte_id = [0] * 256
        self.is_byte = np.zeros(count, bool)
        plain: dict[bytes, int] = {}
        self.text = [b""] * count  # what a piece stands for when decoded
        for i in range(count):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.is_byte[i], self.text[i] = i, True, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[piece.encode()] = i
                self.text[i] = piece.replace(MARKER, " ").encode()
        if any(MARKER in p.decode().lstrip(MARKER) or b"\n" in p for p in plain):
            raise ValueError("the model has pieces that reach over a marker or a line break")
        self.unknown = float(min(self.score[list(plain.values())])) - UNKNOWN_PENALTY
        self.trie = DoubleArray(plain)
        self.scores = self.score.tolist()

    def viterbi(self, data: bytes, literal: frozenset[int] = frozenset()) -> list[int]:
        """The ids of the best segmentation of UTF-8 ``data``; of equal ones that whose last pieces are longest.

        ``literal``: places of marker characters that stand for themselves; they are written as bytes.
        """
        n = len(data)
        nothing = float("-inf")
        best = [nothing] * (n + 1)
        best[0] = 0.0
        came, piece_at = [0] * (n + 1), [-1] * (n + 1)
        scores, base, check, value = self.scores, self.trie.base, self.trie.check, self.trie.value
        ahead = sorted(literal, reverse=True)
        for at in range(n):
            so_far = best[at]
            if so_far == nothing:
                continue
            lead = data[at]
            after = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            limit = n
            if ahead:
                while ahead and ahead[-1] < at:
                    ahead.pop()
                limit = ahead[-1] if ahead else n
            single = False
            state, stop = 0, at
            while stop < limit:
                child = base[state] + data[stop] + 1
                if check[child] != state:
                    break
                state = child
                stop += 1
                piece = value[state]
                if piece >= 0:
                    total = so_far + scores[piece]
                    if total > best[stop]:
                        best[stop], came[stop], piece_at[stop] = total, at, piece
                    if stop == after:
                        single = True
            if not single and so_far + self.unknown > best[after]:
                best[after], came[after], piece_at[after] = so_far + self.unknown, at, -1
        ids: list[int] = []
        at = n
        while at:
            start, piece = came[at], piece_at[at]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.byte_id[b] for b in reversed(data[start:at])]
            at = start
        return ids[::-1]


class _Words(dict):
    def __init__(self, ids_of):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = self.ids_of(word)
        return found


_PARTS = re.compile(r" *[^ \n]+| +|\n")


class Codec:
    """Texts to ids, as little-endian 32-bit numbers, and back."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.part = _Words(self._part_ids)
        self.spaced = _Words(lambda word: self._part_ids(" " + word))

    def _part_ids(self, part: str) -> bytes:
        word = part.lstrip(" ")
        data = (MARKER * (len(part) - len(word)) + word).encode()
        literal = frozenset()
        if MARKER in word:
            lead = 3 * (len(part) - len(word))
            literal = frozenset(m.start() for m in re.finditer(MARKER.encode(), data) if m.start() >= lead)
        return np.array(self.pieces.viterbi(data, literal), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text; a space is put before it first, as the vocabulary expects.  Empty texts have none."""
        if not text:
            return b""
        if "  " in text or text[0] == " ":
            return b"".join(map(self.part.__getitem__, _PARTS.findall(" " + text)))
        line_break = self.part["\n"]
        lines = []
        for number, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            begin = self.spaced[first] if number == 0 else self.part[first] if first else b""
            lines.append(begin + b"".join(map(self.spaced.__getitem__, rest)))
        return line_break.join(lines)

    def decode(self, ids: bytes) -> str:
        """The text of the ids; the space put before it is taken away.  Bytes that are no UTF-8 become the
        replacement character."""
        text = self.pieces.text
        data = b"".join([text[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return data.removeprefix(b" ").decode("utf-8", "replace")


@cache
def codec(path: str | None = None) -> Codec:
    """The worker's codec for the model file at ``path``."""
    return Codec(Pieces(path or public_tokenizers.path(PIECE_MODEL)))


def _encode_batches(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for batch in batches:
            ids = [np.frombuffer(encode(t), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = np.concatenate([np.zeros(0, np.int32), *ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], ["id", "ids"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(id, ids): the pieces of every text.  Null and empty texts have no ids; repeated rows are repeated; an empty
    table gives an empty result; other columns are not read.  ``model`` is the path of a model file."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_encode_batches(model), "id long, ids array<int>").withColumnRenamed("id", id_col)


def _decode_batches(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            texts = [decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return run


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """(id, text): the text of every list of ids; null lists are empty texts."""
    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(_decode_batches(model), "id long, text string").withColumnRenamed("id", id_col)


def _trip_batches(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(path)
        is_byte, score = both.pieces.is_byte, both.pieces.score
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = both.encode(text)
                ids = np.frombuffer(data, "<u4")
                plain = ~is_byte[ids]
                rows.append((i, len(ids), int((~plain).sum()), float(score[ids][plain].sum()), crc32(data), both.decode(data) == text))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, _TRIP, strict=True)],
                ["id", "n_tokens", "n_byte_tokens", "score", "ids_crc32", "round_trip"],
            )

    return run


_TRIP = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_byte_tokens, score (sum over pieces that are no bytes), ids_crc32,
    and whether decoding gives the text back.  Rows out of the ordinary are treated as by :func:`encode`."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(
        _trip_batches(model), "id long, n_tokens long, n_byte_tokens long, score double, ids_crc32 long, round_trip boolean"
    ).withColumnRenamed("id", id_col)
