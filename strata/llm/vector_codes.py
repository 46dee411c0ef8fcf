"""Codes for vectors: each part of a vector is replaced by the number of an entry of its codebook.

Codebooks come from rounds of nearest-entry assignment and averaging, all in whole numbers.  Each task groups its
vectors into blocks and builds, once per block and part, a tree of balls by the anchors hierarchy: anchors are taken
one after another, each at the point farthest from its anchor, and take over the points nearer to them; the balls
are then merged two by two into the upper tree and split again the same way below (middle-out).  Every ball caches
count and sum of its points.  A round walks the tree with the list of entries that may own points of the ball, which
children inherit; when one entry is left, the ball goes to it whole, by its cached sum.  Only counts and sums of at
most parts x entries rows reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import settled

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
# Vectors of a block, points of a leaf.
BLOCK = 2048
LEAF = 24
# Whole numbers up to this size are computed in 64 bits; tables that hold larger ones take unbounded ones, no trees.
NARROW = 1 << 27
_LIMB = 40


@dataclass
class Balls:
    """A tree of balls over points that stand in the order of its leaves; node 0 holds all."""

    points: np.ndarray
    place: np.ndarray
    child: np.ndarray
    span: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    total: np.ndarray


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


def anchors(points: np.ndarray, count: int) -> list[np.ndarray]:
    """Points of each of up to ``count`` anchors, fewer if all points are anchors themselves."""
    pivots = [points[0]]
    owner = np.zeros(len(points), np.int64)
    distance = _far(points, points[0])
    while len(pivots) < count:
        farthest = int(distance.argmax())
        if distance[farthest] == 0:
            break
        new = points[farthest]
        # A point nearer to its anchor than half the way between the anchors is not nearer to the new one.
        half = _far(np.array(pivots), new) / 2
        asked = np.flatnonzero(distance > half[owner])
        now = _far(points[asked], new)
        won = now < distance[asked]
        owner[asked[won]], distance[asked[won]] = len(pivots), now[won]
        pivots.append(new)
    return [g for g in (np.flatnonzero(owner == k) for k in range(len(pivots))) if len(g)]


def ball_tree(points: np.ndarray, leaf: int = LEAF) -> Balls:
    """The tree over whole-number ``points``."""
    real = points.astype(np.float64)
    nodes: list[tuple] = []  # (left, right, points of a leaf)

    def ball(rows: np.ndarray) -> tuple[int, np.ndarray, float, int]:
        """Node, centre, radius and count of a ball over ``rows``."""
        centre = real[rows].mean(0)
        radius = float(_far(real[rows], centre).max())
        groups = anchors(real[rows], int(np.ceil(np.sqrt(len(rows))))) if len(rows) > leaf else []
        if len(groups) < 2:
            nodes.append((-1, -1, rows))
            return len(nodes) - 1, centre, radius, len(rows)
        return merge([ball(rows[g]) for g in groups])

    def merge(balls: list[tuple]) -> tuple[int, np.ndarray, float, int]:
        """Joins the two balls with the smallest common ball until one is left."""
        node = [b[0] for b in balls]
        centre, radius = np.array([b[1] for b in balls]), np.array([b[2] for b in balls])
        count = np.array([b[3] for b in balls])

        def joint(i: int) -> tuple[np.ndarray, np.ndarray]:
            middle = (centre * count[:, None] + centre[i] * count[i]) / (count + count[i])[:, None]
            reach = np.maximum(_far(middle, centre) + radius, _far(middle, centre[i]) + radius[i])
            return middle, reach

        size = np.array([joint(i)[1] for i in range(len(node))])
        np.fill_diagonal(size, np.inf)
        for _ in range(len(node) - 1):
            i, j = divmod(int(size.argmin()), len(node))
            middle, reach = joint(i)
            nodes.append((node[i], node[j], None))
            node[i], radius[i], centre[i], count[i] = len(nodes) - 1, reach[j], middle[j], count[i] + count[j]
            size[j] = size[:, j] = np.inf
            row = np.where(np.isinf(size[i]), np.inf, joint(i)[1])
            size[i], size[:, i] = row, row
        last = int(count.argmax())
        return node[last], centre[last], float(radius[last]), int(count[last])

    root = ball(np.arange(len(points)))[0]
    order, child, span = [], [], []
    stack = [(root, -1, 0)]
    placed = 0
    # Nodes in the order of their first visit, so children come after their parent and leaves from left to right.
    while stack:
        at, parent, side = stack.pop()
        left, right, rows = nodes[at]
        here = len(child)
        child.append([-1, -1])
        if parent >= 0:
            child[parent][side] = here
        start = placed
        if rows is None:
            stack += [(right, here, 1), (left, here, 0)]
        else:
            order.append(rows)
            placed += len(rows)
        span.append([start, placed])
    for here in range(len(child) - 1, -1, -1):
        if child[here][0] >= 0:
            span[here][1] = span[child[here][1]][1]
    place = np.concatenate(order)
    points = points[place]
    spans = np.array(span)
    running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), points.cumsum(0)])
    total = running[spans[:, 1]] - running[spans[:, 0]]
    centre = total / (spans[:, 1] - spans[:, 0])[:, None]
    radius = np.array([_far(points[a:z], c).max() for (a, z), c in zip(spans, centre)])
    return Balls(points, place, np.array(child), spans, centre, radius, total)


def squares(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each point to each entry, exact."""
    return ((points[:, None] - book[None]) ** 2).sum(2)


def owned(tree: Balls, book: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
    """(first, last, entry, sum) of balls that one entry owns whole; (first, last, -1, entries) of leaves that none does.

    An entry leaves the list if it is farther from every point of the ball than another one is; the margin covers
    rounding, so entries as near as the nearest stay.
    """
    real = book.astype(np.float64)
    stack = [(0, np.arange(len(book)))]
    while stack:
        node, entries = stack.pop()
        distance = _far(real[entries], tree.centre[node])
        radius = tree.radius[node]
        limit = float(distance.min()) + 2 * radius
        entries = entries[distance <= limit + 1e-9 * (limit + 1)]
        first, last = tree.span[node].tolist()
        if len(entries) == 1:
            yield first, last, int(entries[0]), tree.total[node]
        elif tree.child[node, 0] < 0:
            yield first, last, -1, entries
        else:
            stack += [(int(tree.child[node, 1]), entries), (int(tree.child[node, 0]), entries)]


def nearest(tree: Balls, book: np.ndarray) -> np.ndarray:
    """The number of the nearest entry of every point, in tree order; the lower of equals."""
    code = np.empty(len(tree.points), np.int64)
    for first, last, entry, entries in owned(tree, book):
        code[first:last] = entry if entry >= 0 else entries[squares(tree.points[first:last], book[entries]).argmin(1)]
    return code


def sums(tree: Balls, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the points of each entry; balls owned whole bring their cached ones."""
    count, total = np.zeros(len(book), np.int64), np.zeros_like(book)
    for first, last, entry, held in owned(tree, book):
        if entry >= 0:
            count[entry] += last - first
            total[entry] += held
        else:
            points = tree.points[first:last]
            code = held[squares(points, book[held]).argmin(1)]
            np.add.at(count, code, 1)
            np.add.at(total, code, points)
    return count, total


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(4096 x), in 64 bits where all are small, else as unbounded whole numbers."""
    if not values.size or np.abs(values).max() < NARROW // SCALE:
        return np.floor(values * SCALE).astype(np.int64)
    exact = [(a * SCALE) // b for a, b in (float(x).as_integer_ratio() for x in values.ravel())]
    return np.array(exact, object).reshape(values.shape)


_TREE = [f.name for f in Balls.__dataclass_fields__.values()]
_BLOCK = "ids array<long>, labels array<string>, vectors binary, trees array<binary>"


def _blocks(dims: int, wide: bool, block: int):
    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        vectors = np.concatenate([np.asarray(c.flatten(), np.float64) for c in rows.column(2).chunks]).reshape(-1, dims)
        trees: list[bytes] = []
        if not wide:
            for part in np.split(scaled(vectors), PARTS, axis=1):
                tree = ball_tree(np.ascontiguousarray(part))
                trees += [np.ascontiguousarray(getattr(tree, name)).tobytes() for name in _TREE]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())),
                pa.array([rows.column(1).to_pylist()], pa.list_(pa.string())),
                pa.array([vectors.tobytes() if wide else b""], pa.binary()),
                pa.array([trees], pa.list_(pa.binary())),
            ],
            ["ids", "labels", "vectors", "trees"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                piece = batch.slice(at, block)
                if size + piece.num_rows > block and held:
                    yield packed(held)
                    held, size = [], 0
                held.append(piece)
                size += piece.num_rows
        if size:
            yield packed(held)

    return run


def _trees(fields: list[pa.Buffer], width: int) -> list[Balls]:
    """The trees of a block's parts, as :func:`_blocks` stored them."""
    shape = {"points": (-1, width), "place": -1, "child": (-1, 2), "span": (-1, 2), "centre": (-1, width), "radius": -1, "total": (-1, width)}
    kinds = {"centre": np.float64, "radius": np.float64}
    read = [np.frombuffer(f, kinds.get(n, np.int64)).reshape(shape[n]) for f, n in zip(fields, _TREE * PARTS, strict=True)]
    return [Balls(*read[i : i + len(_TREE)]) for i in range(0, len(read), len(_TREE))]


def _parts(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list]]:
    """Row number and parts of each block, one block at a time: trees, or plain arrays of unbounded whole numbers."""
    for i in range(batch.num_rows):
        trees = batch.column(3)[i].values
        if len(trees):
            yield i, _trees([t.as_buffer() for t in trees], width)
        else:
            vectors = np.frombuffer(batch.column(2)[i].as_buffer()).reshape(-1, PARTS * width)
            yield i, np.split(scaled(vectors).astype(object), PARTS, axis=1)


def _summed(books: list[np.ndarray], limbs: int):
    """Counts and sums per part and entry over the blocks of a task; sums in limbs of 40 bits, the last one signed."""
    width, size = books[0].shape[1], len(books[0])
    low = (1 << _LIMB) - 1

    def split(value: int) -> list[int]:
        return [value >> _LIMB * k & low for k in range(limbs - 1)] + [value >> _LIMB * (limbs - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((PARTS, size), object)
        totals = np.zeros((PARTS, size, width), object)
        for batch in batches:
            for _, parts in _parts(batch, width):
                for p, (part, book) in enumerate(zip(parts, books, strict=True)):
                    if isinstance(part, Balls):
                        count, total = sums(part, book)
                    else:
                        code = squares(part, book).argmin(1)
                        count, total = np.bincount(code, minlength=size), np.zeros((size, width), object)
                        np.add.at(total, code, part)
                    counts[p] += count.astype(object)
                    totals[p] += total.astype(object)
        rows = [(p, e) for p in range(PARTS) for e in range(size) if counts[p, e]]
        held = [[limb for v in totals[p, e] for limb in split(int(v))] for p, e in rows]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in rows], pa.int32()), pa.array([e for _, e in rows], pa.int32()),
                pa.array([int(counts[r]) for r in rows], pa.int64()), pa.array(held, pa.list_(pa.int64())),
            ],
            ["part", "entry", "count", "sums"],
        )

    return run


def _coded(books: list[np.ndarray]):
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, parts in _parts(batch, width):
                n = len(batch.column(0)[i])
                codes, error = np.empty((n, PARTS), np.uint8), np.zeros(n, object)
                for p, (part, book) in enumerate(zip(parts, books, strict=True)):
                    if isinstance(part, Balls):
                        code = nearest(part, book)
                        codes[part.place, p] = code
                        error[part.place] += ((part.points - book[code]) ** 2).sum(1).astype(object)
                    else:
                        distance = squares(part, book)
                        codes[:, p] = distance.argmin(1)
                        error += distance.min(1)
                text = codes.tobytes().hex()
                step = 2 * PARTS
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i].values.cast(pa.int64()), batch.column(1)[i].values.cast(pa.string()),
                        pa.array([text[k : k + step] for k in range(0, n * step, step)]),
                        pa.array([e if e < 1 << 63 else None for e in map(int, error)], pa.int64()),
                    ],
                    ["id", "label", "code", "error"],
                )

    return run


def _next_books(rows: list, books: list[np.ndarray], limbs: int) -> list[np.ndarray]:
    """Entries replaced by the floor of their average; unused ones stay."""
    books = [b.copy() for b in books]
    for part, entry, count, held in rows:
        numbers = [sum(int(v) << _LIMB * k for k, v in enumerate(held[i : i + limbs])) for i in range(0, len(held), limbs)]
        books[part][entry] = [v // int(count) for v in numbers]
    return books


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    rounds: int = ROUNDS, entries: int = ENTRIES, block: int = BLOCK,
) -> DataFrame:
    """One row per kept row of ``vectors``: id, code, error, label_error, codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped, and so are vectors that cannot be
    cut like the others: of another length than that of the smallest id, or not a multiple of eight long.  The first
    codebook is made of the smallest ids (rows without an id last, of equal ids the smaller vector first), with fewer
    entries where fewer rows are kept.  Repeated rows count each.  ``error`` and ``label_error`` are null where they
    exceed 64 bits.  An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    plain = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("vector"),
    )
    unsound = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = plain.where(F.col("vector").isNotNull() & ~F.coalesce(unsound, F.lit(True)))
    result = f"{id_col} long, code string, error long, label_error long, codebooks_sha256 string"
    # At most as many rows as a codebook has entries.
    order = [F.col("id").isNull(), "id", "vector"]
    head = kept.orderBy(*order).limit(1).collect()
    dims = len(head[0]["vector"]) if head else 0
    if not dims or dims % PARTS:
        return spark.createDataFrame([], result)
    kept = kept.where(F.size("vector") == dims)
    first = kept.orderBy(*order).limit(entries).collect()
    largest = kept.agg(F.max(F.array_max(F.transform("vector", lambda x: F.abs(x))))).first()[0]
    wide = largest >= NARROW // SCALE
    limbs = 2 + int(largest).bit_length() // _LIMB if wide else 1
    start = scaled(np.array([r["vector"] for r in first], np.float64))
    books = [np.ascontiguousarray(b) for b in np.split(start.astype(object if wide else np.int64), PARTS, axis=1)]
    blocks = settled(kept.mapInArrow(_blocks(dims, wide, block), _BLOCK), "blocks")
    width = dims // PARTS
    for _ in range(rounds):
        partial = blocks.mapInArrow(_summed(books, limbs), "part int, entry int, count long, sums array<long>")
        each = F.array(*[F.sum(F.col("sums")[i].cast("decimal(20,0)")) for i in range(width * limbs)])
        books = _next_books(partial.groupBy("part", "entry").agg(F.sum("count"), each).collect(), books, limbs)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    coded = settled(blocks.mapInArrow(_coded(books), "id long, label string, code string, error long"), "codes")
    per_label = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("total"))
    per_label = per_label.select(F.col("label").alias("of"), F.expr("try_cast(total as long)").alias("label_error"))
    return coded.join(per_label, coded["label"].eqNullSafe(per_label["of"])).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
