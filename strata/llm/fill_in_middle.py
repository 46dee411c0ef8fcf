"""Fill-in-the-middle examples, cut at token boundaries that a learned rank index finds.

The index maps the number of a boundary to its offset.  Straight pieces are fitted to all boundaries of a text, each
as long as some line stays within an error of every boundary on it; a lookup computes the place on the line and adds
the stored residual of that boundary, so it is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
# Percentages: texts that are transformed, and of these the ones that begin with the suffix.
RATE = 50
SUFFIX_FIRST = 80
# Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Code points that a line may miss a boundary by; residuals take one byte.
ERROR = 63


def boundaries(text: str) -> np.ndarray:
    """Offsets of the token boundaries: 0, then the end of each token ``\\s*\\S+`` and of white space left over."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    white = np.ones(len(points) + 1, bool)
    white[:-1] = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    rest = [len(points)] if len(points) and white[-2] else []
    return np.concatenate([[0], ends, rest]).astype(np.int64)


@dataclass
class RankIndex:
    """Pieces (first rank, offset there, slope) and the residual of every rank."""

    ranks: np.ndarray
    offsets: np.ndarray
    slopes: np.ndarray
    residuals: np.ndarray

    def _line(self, rank: np.ndarray) -> np.ndarray:
        piece = np.searchsorted(self.ranks, rank, side="right") - 1
        return self.offsets[piece] + np.floor(self.slopes[piece] * (rank - self.ranks[piece]) + 0.5).astype(np.int64)

    def offset(self, rank: int) -> int:
        """The offset of a boundary: predicted by its piece, corrected by its residual."""
        return int(self._line(np.array([rank]))[0]) + int(self.residuals[rank])


def _piece(offsets: np.ndarray, first: int, error: int) -> tuple[int, float]:
    """The rank after the longest piece that starts at ``first``, and its slope.

    The slopes that keep all boundaries so far within the error form a cone that narrows with each boundary; the
    piece ends before the boundary that would close it.
    """
    low, high = -np.inf, np.inf
    at, step = first + 1, 256
    while at < len(offsets):
        rise = offsets[at : at + step] - offsets[first]
        run = np.arange(at, at + len(rise)) - first
        highs = np.minimum(np.minimum.accumulate((rise + error) / run), high)
        lows = np.maximum(np.maximum.accumulate((rise - error) / run), low)
        closed = np.flatnonzero(lows > highs)
        held = int(closed[0]) if len(closed) else len(rise)
        if held:
            low, high = float(lows[held - 1]), float(highs[held - 1])
        at, step = at + held, step * 2
        if len(closed):
            break
    return at, 0.0 if low == -np.inf else (low + high) / 2


def fit(offsets: np.ndarray, error: int = ERROR) -> RankIndex:
    """The index of ascending ``offsets``."""
    ranks, slopes, at = [], [], 0
    while at < len(offsets):
        ranks.append(at)
        at, slope = _piece(offsets, at, error)
        slopes.append(slope)
    ranks_ = np.array(ranks, np.int64)
    index = RankIndex(ranks_, offsets[ranks_], np.array(slopes), np.zeros(0, np.int8))
    residuals = offsets - index._line(np.arange(len(offsets)))
    index.residuals = residuals.astype(np.int8 if error < 127 else np.int64)
    return index


def transform(doc_id: int | None, text: str, rate: int, suffix_first: int, seed: int, error: int) -> tuple:
    """(tokens, form, code points of the prefix, of the middle, output) of one text."""
    offsets = boundaries(text)
    n = len(offsets) - 1
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    index = fit(offsets, error)
    a, z = (index.offset(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    if h4 % 100 < suffix_first:
        return n, "spm", a, z - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, z - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def _transformed(rate: int, suffix_first: int, seed: int, error: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                transform(i, t or "", rate, suffix_first, seed, error)
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            ]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST, seed: int = SEED, error: int = ERROR,
) -> DataFrame:
    """One row per row of ``docs``: id, n (tokens), form, prefix_chars, middle_chars, output (text).

    Cuts and form come from a hash of seed and id.  ``plain`` texts are given as they are: empty and null ones,
    those that hold a mark, and those the hash leaves out.  Rows that share an id are cut by the same numbers; a
    row without an id is hashed as an empty one.  An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    kinds = "id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(_transformed(rate, suffix_first, seed, error), kinds).withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from output and form alone.

    A mark cannot begin in one part and end in the next, and no part holds one, so the first one found is the mark.
    """
    body = F.substring(F.col(output), len(PREFIX) + 1, F.length(output))
    second = F.when(F.col(form) == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    end = F.call_function("locate", second, body)
    head = F.substring(body, F.lit(1), end - 1)
    rest = F.substring(body, end + len(PREFIX), F.length(output))
    end = F.call_function("locate", F.lit(MIDDLE), rest)
    tail = F.substring(rest, F.lit(1), end - 1)
    middle = F.substring(rest, end + len(MIDDLE), F.length(output))
    return (
        F.when(F.col(form) == "plain", F.col(output))
        .when(F.col(form) == "psm", F.concat(head, middle, tail))
        .otherwise(F.concat(tail, middle, head))
    )


def digests(docs: DataFrame) -> DataFrame:
    """The columns of the transformation with hashes instead of the output and of the text restored from it."""
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"),
    )
