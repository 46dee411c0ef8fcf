"""Packing of token pieces into sequences by a configuration linear program.

A configuration says how many pieces of each length one sequence holds.  The program asks for the fewest sequences
whose configurations cover the histogram of lengths.  Multiplicative weights solve it: every length has a price that
falls with the share of it that is covered, and a knapsack over the prices, by dynamic programming, gives the most that a
sequence can be worth.  That bounds the fewest sequences from below (prices over the knapsack's value are a solution
of the dual program), and its table is traced back into a batch of configurations of nearly that worth, each of
pieces that are still there.  A configuration is used as often as half of what is left of its scarcest length allows,
rounded to whole sequences, before the prices are set anew; it ends when everything is covered.  Only the shortest
pieces, a stated share of all, are held back: they go to the sequences with the least room that suffices.

The program depends on the histogram alone, at most one row per length, and so does its solution.  Pieces find their
places by their rank in the order of length, each task for itself.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import ranked, stored
from strata.llm.tokens import word_bpe

CAPACITY = 4096
END_ID = 1
# Share of all pieces, the shortest ones, that fill the rooms which configurations leave.
HELD_BACK = 0.08
# Share of what is left of a length that one batch uses; configurations of a batch.
SHARE, BATCH = 0.5, 64
# How fast prices fall as a length is covered, and how much more a token of the longest piece is worth at first.
STEEPNESS, LONG = 3.0, 0.02
# Part of the knapsack's value that a configuration may miss at first; doubled when none comes so near.
MISS = 0.02


def knapsack_values(value: np.ndarray) -> np.ndarray:
    """The most value within each capacity; ``value[s]`` is that of length s, -inf where there is none."""
    best = np.zeros(len(value))
    offered = np.flatnonzero(value > -np.inf)
    longest = int(offered[-1]) if len(offered) else 0
    sums = np.empty(longest)
    for c in range(1, len(value)):
        k = min(c, longest)
        here = sums[:k]
        np.add(best[c - 1 :: -1][:k], value[1 : k + 1], out=here)
        best[c] = max(best[c - 1], here.max(initial=0.0))
    return best


def configuration(value: np.ndarray, best: np.ndarray, room: np.ndarray) -> tuple[dict[int, int], float]:
    """({length: count}, worth) traced back through the knapsack's values, with no more of a length than ``room``.

    Each step takes the piece that leaves the most value, the longest of equals.  Tokens that stay free at the end
    are filled by swapping one piece for the longest that fits instead.
    """
    value = np.where(room > 0, value, -np.inf)
    left = value.copy()
    held: dict[int, int] = {}
    free = len(value) - 1
    while free:
        here = left[1 : free + 1] + best[free - 1 :: -1]
        s = free - int(here[::-1].argmax())
        if not here[s - 1] > -np.inf:
            break
        held[s] = held.get(s, 0) + 1
        free -= s
        if held[s] >= room[s]:
            left[s] = -np.inf
    if free and held:
        offered = np.flatnonzero(left > -np.inf)
        swaps = []
        for s in held:
            at = int(np.searchsorted(offered, s + free, side="right")) - 1
            if at >= 0 and offered[at] > s:
                swaps.append((int(offered[at]) - s, s))
        if swaps:
            more, s = max(swaps)
            held[s] -= 1
            held[s + more] = held.get(s + more, 0) + 1
    held = {s: n for s, n in held.items() if n}
    return held, float(sum(value[s] * n for s, n in held.items()))


def solve(demand: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], float]:
    """([(configuration, uses)], lower bound of sequences): the uses hold every piece of ``demand`` once."""
    needs = np.zeros(capacity + 1, np.int64)
    needs[list(demand)] = list(demand.values())
    tokens = np.arange(capacity + 1)
    worth = tokens / capacity * (1 + LONG * tokens / capacity)
    most = capacity // np.maximum(tokens, 1)
    left, uses, miss = needs.copy(), [], MISS
    # Prices in proportion to the length are worth one in a full sequence.
    bound = float((needs * tokens).sum()) / capacity
    while left.any():
        share = np.divide(needs - left, needs, out=np.ones(capacity + 1), where=needs > 0)
        # What is covered is worth nothing any more.
        price = np.where(left > 0, worth * np.exp(-STEEPNESS * share), -np.inf)
        best = knapsack_values(price)
        bound = max(bound, float((needs * np.where(left > 0, price, 0.0)).sum() / best[-1]))
        room = np.maximum(np.ceil(left * SHARE).astype(np.int64), np.minimum(left, most))
        for k in range(BATCH):
            held, value = configuration(price, best, room)
            if not held or value < (1 - miss) * best[-1]:
                miss *= 1 if k else 2
                break
            times = min(int(room[s]) // n for s, n in held.items())
            for s, n in held.items():
                room[s] -= n * times
                left[s] -= n * times
            uses.append((held, times))
    return uses, bound


def whole_sequences(
    demand: dict[int, int], capacity: int, held_back: float = HELD_BACK
) -> list[tuple[list[tuple[int, int]], int]]:
    """([(length, pieces of it)], sequences filled so): every piece of ``demand`` once, in as few sequences as found."""
    most = held_back * sum(demand.values())
    rest: dict[int, int] = {}
    for s in sorted(s for s, n in demand.items() if n):
        if sum(rest.values()) + demand[s] > most:
            break
        rest[s] = demand[s]
    rooms: dict[int, list] = {}  # free tokens -> sequences that have as many
    free: list[int] = []

    def put(room: int, held: list, times: int) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(free, room)
        rooms[room].append((held, times))

    for held, times in solve({s: n for s, n in demand.items() if n and s not in rest}, capacity)[0]:
        put(capacity - sum(s * n for s, n in held.items()), sorted(held.items(), reverse=True), times)
    for s in sorted(rest, reverse=True):
        n = rest[s]
        while n:
            at = bisect_left(free, s)
            if at < len(free):
                room = free[at]
                held, times = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], free[at]
            else:
                room, held, times = capacity, [], n
            each = min(n, room // s)
            filled = min(times, n // each)
            put(room - each * s, [*held, (s, each)], filled)
            if times > filled and held:
                put(room, held, times - filled)
            n -= each * filled
    return [x for room in rooms.values() for x in room]


class Layout:
    """Places of pieces by their rank in the order of length, as blocks of ranks."""

    def __init__(self, plan: list[tuple[list[tuple[int, int]], int]], demand: dict[int, int]):
        by_length: dict[int, list] = {}
        first = 0
        for held, times in plan:
            offset = 0
            for s, n in held:
                by_length.setdefault(s, []).append((first, n, offset, times))
                offset += s * n
            first += times
        self.sequences = first
        blocks = []
        rank = 0
        for s in sorted(demand):
            for at, n, offset, times in by_length.get(s, []):
                blocks.append((rank, at, n, offset, s))
                rank += n * times
        self.blocks = np.array(blocks, np.int64).reshape(-1, 5).T

    def place(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, at, n, offset, length = self.blocks[:, np.searchsorted(self.blocks[0], rank, "right") - 1]
        inside = rank - start
        return at + inside // n, offset + inside % n * length


def _piece_batches(capacity: int, path: str | None):
    size = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_bpe(path).ids
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    rows.append((i, k, at // 4, len(part) // 4, crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids and the end id, cut only where longer than a sequence."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_piece_batches(capacity, path), "id long, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    tokenizer: str | None = None, held_back: float = HELD_BACK,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and are one piece of the end id alone.  Repeated rows are packed as often as they
    stand there; rows without an id are packed too.  An empty table gives an empty result.  ``tokenizer`` is the
    path of a vocabulary file, by default the public one.  Other columns of ``docs`` are not read.
    """
    cut = stored(pieces(docs, id_col, text_col, capacity, tokenizer), "pieces")
    # At most one row per length up to the capacity.
    demand = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    layout = Layout(whole_sequences(demand, capacity, held_back), demand)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = layout.place(np.asarray(batch.column(5)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    rows = ranked(cut, "length", "id", "piece", "ids_crc32").select("id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInArrow(
        placed, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    ).withColumnRenamed("id", id_col)
