"""Token counts of fields and lines by offset-mapped attribution.

A document is encoded once, as a whole: tokens near a boundary are those of the document and not of its parts.  Every
token has a span of characters; the spans are joined to the intervals of the sections, and a token that reaches over a
boundary goes to one section by a stated rule, so the counts of the sections add up to that of the document.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BYTE_BPE = "byte_bpe_50k.tiktoken"
RULES = ("most", "first", "last")


class ByteBpe:
    """A byte-level vocabulary, and the number of bytes of each of its tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("strata", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.width[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, stop) in code points; a token that holds a part of a character spans that character."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        stop = np.cumsum(self.width[ids])
        start = stop - self.width[ids]
        if text.isascii() or not len(ids):
            return ids, start, stop
        data = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80)
        return ids, character[start] - 1, character[stop - 1]


@cache
def byte_bpe(path: str | None = None) -> ByteBpe:
    """The worker's encoder for the vocabulary file at ``path``."""
    return ByteBpe(path or public_tokenizers.path(BYTE_BPE))


def sections(fields: list[str]) -> tuple[str, list[tuple[int, int]], np.ndarray]:
    """The whole document, (field, line) of each section, and where each starts.

    Fields are joined by a line break.  A section is a line with the break that ends it; sections tile the document.
    """
    names, starts, at = [], [], 0
    for f, text in enumerate(fields):
        for number, line in enumerate(text.split("\n")):
            names.append((f, number))
            starts.append(at)
            at += len(line) + 1
    return "\n".join(fields), names, np.array(starts, np.int64)


def attribute(start: np.ndarray, stop: np.ndarray, borders: np.ndarray, end: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of every token, and whether the token reaches over a boundary.

    ``most``: the section that holds most of its characters, the earliest of equals; ``first`` and ``last``: that of
    its first or last character.
    """
    first = np.searchsorted(borders, start, "right") - 1
    last = np.searchsorted(borders, stop - 1, "right") - 1
    crossing = first < last
    if rule == "last":
        return last, crossing
    chosen = first.copy()
    if rule == "most":
        ends = np.append(borders[1:], end)
        for t in np.flatnonzero(crossing):
            among = np.arange(first[t], last[t] + 1)
            held = np.minimum(ends[among], stop[t]) - np.maximum(borders[among], start[t])
            chosen[t] = among[held.argmax()]
    return chosen, crossing


_ROWS = pa.schema(
    [("id", pa.int64()), ("field", pa.string()), ("section", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()),
     ("n_tokens", pa.int64()), ("n_crossing", pa.int64())]
)


def _count_batches(fields: list[str], rule: str, path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = byte_bpe(path).spans
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(1 + len(fields))]
            parts: list[list] = [[] for _ in _ROWS]
            for i, *texts in zip(*columns, strict=True):
                whole, names, borders = sections(texts)
                _, start, stop = spans(whole)
                chosen, crossing = attribute(start, stop, borders, len(whole), rule)
                n = len(names)
                parts[0] += [i] * n
                parts[1] += [fields[f] for f, _ in names]
                parts[2] += [number for _, number in names]
                parts[3] += borders.tolist()
                parts[4] += [*borders[1:].tolist(), len(whole)]
                parts[5] += np.bincount(chosen, minlength=n).tolist()
                parts[6] += np.bincount(chosen[crossing], minlength=n).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(parts, _ROWS, strict=True)], schema=_ROWS)

    return run


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), rule: str = "most", vocabulary: str | None = None
) -> DataFrame:
    """One row per line of each field: id, field, section (from 0), start, stop, n_tokens, n_crossing.

    ``start`` and ``stop`` are code points of the whole document, its fields joined by line breaks.  ``n_tokens``
    counts the tokens given to the line, ``n_crossing`` those of them that reach over its boundary.  Null fields count
    as empty; an empty field is one line without tokens.  Repeated rows are repeated; an empty table gives an empty
    result; other columns are not read.  ``vocabulary`` is the path of a byte-level vocabulary, by default the
    public one.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"field_{n}") for n, f in enumerate(fields)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *texts)
    counted = rows.mapInArrow(
        _count_batches(list(fields), rule, vocabulary),
        "id long, field string, section int, start long, stop long, n_tokens long, n_crossing long",
    )
    return counted.withColumnRenamed("id", id_col)
