"""Near duplicates among embeddings by a pivot-permutation index.

A vector is described by its nearest reference points, the pivots, in their order.  The index lists vectors under each
pair of pivots among a vector's first four, so vectors that share at least two pivots meet in a list.  Vectors of a
list are verified by their cosine in double precision.  A pair may meet in several lists; it counts in the one with
the smallest key it shares, which needs no exchange.  A long list is cut into blocks that are compared two by two, so
whether two vectors meet depends on them and the pivots, not on how many others there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import settled
from strata.llm.components import components

SIMILARITY = 0.98
# The pivots come from a sample of at most this many different vectors, those with the smallest hashes.
SAMPLE = 4096
PIVOTS = 256
# Cosine below which a vector may become another pivot.
APART = 0.7
NEAREST = 4
SHARED = 2
# Vectors of a block; a task holds two blocks.
BLOCK = 1024
# More than products of unit vectors are rounded by.
ROUNDING = 1e-9
# Rows of the lists that are compared in one go, for lists of fewer rows than that.
BATCH, SMALL = 4096, 64


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of ``sample``, each the farthest from those before it, until all are near one of them.

    A crowd of like vectors so gives one pivot: several would stand in another order for each of the crowd.
    """
    chosen = [0]
    closest = sample @ sample[0]
    while len(chosen) < count and closest.min() < APART:
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, sample @ sample[chosen[-1]])
    return sample[chosen]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the nearest pivots of unit vectors, nearest first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :count].astype(np.int32)


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, size)


def _described(pivots: np.ndarray):
    """(node, space, vector, copies) with the nearest pivots; unit length in double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = _vectors(batch.column(2), pivots.shape[1])
                near = nearest_pivots(_unit(raw), pivots, NEAREST)
                lists = pa.ListArray.from_arrays(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1], near.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["node", "space", "vector", "copies", "near"])

    return run


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of unit length; scaled by their largest component first, so that squares neither overflow nor vanish."""
    scaled = raw / np.abs(raw).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _least_shared(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the smallest key that the vectors of each pair share; keys below zero are none."""
    out = np.empty(len(a), bool)
    step = max(1, (1 << 24) // max(1, a.shape[1] * b.shape[1]))
    for i in range(0, len(a), step):
        x, y = a[i : i + step], b[i : i + step]
        common = np.where(((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).any(2), x, np.iinfo(np.int64).max)
        out[i : i + step] = common.min(axis=1) == key[i : i + step]
    return out


def _cosines(unit: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Cosines of pairs, the same for a pair wherever it stands; products of whole blocks round by their shapes."""
    out = np.empty(len(at))
    for i in range(0, len(at), 1 << 16):
        part = slice(i, i + (1 << 16))
        out[part] = np.einsum("ij,ij->i", unit[at[part]], unit[to[part]])
    return out


def _pairs(rows: dict[str, np.ndarray], starts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (at, to) of like vectors within each of many short lists that begin at ``starts``."""
    unit, n = rows["unit"], len(rows["node"])
    ends = np.append(starts[1:], n)
    after = np.repeat(ends, ends - starts) - np.arange(n) - 1
    at = np.repeat(np.arange(n), after)
    to = at + 1 + np.arange(len(at)) - np.repeat(np.cumsum(after) - after, after)
    like = _cosines(unit, at, to) >= similarity
    return at[like], to[like]


def _met(rows: dict[str, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (at, to) of like vectors of two blocks of a list, or of one block."""
    unit, block = rows["unit"], rows["block"]
    left, right = np.flatnonzero(block == rows["i"][0]), np.flatnonzero(block == rows["j"][0])
    at, to = np.nonzero(unit[left] @ unit[right].T >= similarity - ROUNDING)
    at, to = left[at], right[to]
    if rows["i"][0] == rows["j"][0]:
        at, to = at[at < to], to[at < to]
    like = _cosines(unit, at, to) >= similarity
    return at[like], to[like]


def _compare(rows: dict[str, np.ndarray], at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the like pairs (at, to): links that count here, and the smallest node of each group."""
    n = len(rows["node"])
    counted = _least_shared(rows["keys"][at], rows["keys"][to], rows["key"][at])
    links = np.bincount(at[counted], weights=rows["copies"][to[counted]], minlength=n)
    links += np.bincount(to[counted], weights=rows["copies"][at[counted]], minlength=n)
    group = rows["node"].copy()
    while True:
        before = group.copy()
        np.minimum.at(group, at, group[to])
        np.minimum.at(group, to, group[at])
        if (before == group).all():
            return links.astype(np.int64), group


_MEMBER = ["space", "key", "i", "j"]


def _verify(size: int, similarity: float):
    """Runs of rows of one (list, i, j), sorted: partial links of each vector and an edge within its group."""

    def finish(batches: list[pa.RecordBatch], starts: np.ndarray | None = None) -> pa.RecordBatch:
        """One run, or short ones of one block each that begin at ``starts``."""
        table = pa.Table.from_batches(batches).combine_chunks()
        rows = {name: np.asarray(table.column(name)) for name in ("key", "i", "j", "node", "block", "copies")}
        rows["unit"] = _unit(_vectors(table.column("vector").combine_chunks(), size))
        lists = table.column("keys").combine_chunks()
        width = np.diff(np.asarray(lists.offsets))
        rows["keys"] = np.full((len(width), int(width.max())), -1, np.int64)
        rows["keys"][np.arange(width.max()) < width[:, None]] = np.asarray(lists.flatten())
        met = _met(rows, similarity) if starts is None else _pairs(rows, starts, similarity)
        links, group = _compare(rows, *met)
        found = (links > 0) | (group != rows["node"])
        return pa.RecordBatch.from_arrays(
            [pa.array(rows["node"][found]), pa.array(links[found]), pa.array(group[found])], ["node", "links", "other"]
        )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, list[pa.RecordBatch]]]:
        """Rows of each run, whether it is one block against itself, and its batches."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(k)) for k in _MEMBER], axis=1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if held and tuple(key[a]) != last:
                    yield sum(b.num_rows for b in held), last[2] == last[3], held
                    held = []
                last = tuple(key[a])
                held.append(batch.slice(a, z - a))
        if held:
            yield sum(b.num_rows for b in held), last[2] == last[3], held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short: list[pa.RecordBatch] = []
        starts: list[int] = []
        rows = 0
        for count, one, held in runs(batches):
            if count < 2:
                continue
            if count > SMALL or not one:
                yield finish(held)
                continue
            if rows + count > BATCH:
                yield finish(short, np.array(starts))
                short, starts, rows = [], [], 0
            starts.append(rows)
            short += held
            rows += count
        if short:
            yield finish(short, np.array(starts))

    return run


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    similarity: float = SIMILARITY, pivots: int = PIVOTS, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null and they have as many components; those that are
    null, empty, zero or hold null or non-finite components are linked with nothing.  ``n_links`` counts other rows
    linked directly, equal vectors included; ``component_id`` is the smallest id reachable, itself included.
    Repeated rows count as vectors of their own.  Rows without an id are linked too and have ``kept`` false.  An
    empty table gives an empty result; other columns are not read.
    """
    plain = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"),
        F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0)).alias("vector"),
    )
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.coalesce(
        F.col("label").isNotNull() & ~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    # A space is a label and a number of components; a node stands for all rows with equal vectors in a space.
    space = F.xxhash64("label", F.size("vector"))
    node = F.when(sound, F.xxhash64("label", "vector"))
    rows = settled(plain.select("id", space.alias("space"), node.alias("node"), F.when(sound, F.col("vector")).alias("vector")), "vectors")
    nodes = settled(
        rows.where("node is not null")
        .groupBy("node", "space", "vector")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first")),
        "nodes",
    )
    counted = nodes.select("node", F.lit(0).cast("long").alias("links"), F.lit(None).cast("long").alias("other"))
    for (size,) in sorted(nodes.select(F.size("vector")).distinct().collect()):
        counted = counted.unionByName(_links(nodes.where(F.size("vector") == size), size, similarity, pivots, block))
    counted = settled(counted, "links")
    linked = components(counted.where("other is not null"), "node", "other")
    per_node = counted.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = settled(
        nodes.select("node", "copies", "first")
        .join(per_node, "node")
        .join(linked, "node", "left")
        .select("node", "copies", "first", "links", F.coalesce("component", "node").alias("root")),
        "rooted",
    )
    smallest = settled(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = settled(
        rooted.join(smallest, "root").select("node", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"),
        "named",
    )
    return rows.select("id", "node").join(named, "node", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(F.col("node").isNull() & F.col("id").isNotNull() | (F.col("id") == F.col("component_id")), F.lit(False)).alias("kept"),
    )


def _keyed(described: DataFrame, few: int) -> DataFrame:
    """Adds ``keys``: the lists of each vector, one per pair of pivots in ascending order."""
    if few < SHARED:
        # With fewer pivots than a vector needs to share, one list holds all of a space.
        return described.withColumn("keys", F.array(F.lit(0).cast("long")))
    near = F.col("near")
    key = lambda a, b: F.shiftleft(F.least(a, b).cast("long"), 13) + F.greatest(a, b).cast("long")
    return described.withColumn("keys", F.array(*[key(near[a], near[b]) for a, b in combinations(range(few), SHARED)]))


def _links(nodes: DataFrame, size: int, similarity: float, pivots: int, block: int) -> DataFrame:
    """(node, links, other): parts of each node's number of links, and an edge to the smallest node of its group."""
    sample = nodes.orderBy("node").limit(SAMPLE).select("vector").toArrow()
    points = spread_pivots(_unit(_vectors(sample.column(0).combine_chunks(), size)), pivots)
    described = nodes.select("node", "space", "vector", "copies").mapInArrow(
        _described(points), "node long, space long, vector array<double>, copies long, near array<int>"
    )
    described = settled(described, "described")
    keyed = _keyed(described, min(len(points), NEAREST))
    lists = settled(
        keyed.select("space", F.explode("keys").alias("key")).groupBy("space", "key").count().where("count > 1")
        .withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count"),
        "lists",
    )
    # A list in several blocks: each row goes to every pair of blocks that holds its own.
    own = F.pmod(F.xxhash64("node", F.lit(7)), "blocks").cast("int")
    members = (
        keyed.select("node", "space", "vector", "copies", "keys", F.explode("keys").alias("key"))
        .join(lists, ["space", "key"])
        .withColumn("block", own)
        .withColumn("partner", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumn("i", F.least("block", "partner"))
        .withColumn("j", F.greatest("block", "partner"))
    )
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = members.select(*_MEMBER, "node", "block", "vector", "copies", "keys").repartition(parts, *_MEMBER).sortWithinPartitions(*_MEMBER)
    return sorted_rows.mapInArrow(_verify(size, similarity), "node long, links long, other long")
