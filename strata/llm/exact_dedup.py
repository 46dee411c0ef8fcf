"""Exact duplicates by exchange of Golomb-coded fingerprints.

Rows are written once, numbered within the task that writes them.  Each task sends the sorted fingerprints of its
texts, Golomb-coded, to the owners of their ranges.  An owner answers every list with a bitmap that marks the
fingerprints which another list holds as well, or which stand for several rows of that list.  The marked rows, the
suspects, go back as one bitmap per writer to the table of rows, which lies in buckets of writers and is not shuffled;
only their texts are, to be compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import bucketed, settled

# Bits of a fingerprint.  Unequal texts that share one become suspects and part again when bytes are compared.
FINGERPRINT_BITS = 48
# Fingerprints of a list at most; a partition with more rows sends several lists.
FRAME_ROWS = 1 << 17
# Rows whose fingerprints one owner compares, as an average.
OWNER_ROWS = 1 << 20
# Parts in which the copies of one text are first compared.
SHARES = 256


def golomb_encode(values: np.ndarray, universe: int) -> tuple[int, bytes]:
    """Sorted distinct ``values`` below ``universe`` as (remainder bits, code).

    The quotients of the gaps are in unary, one stream; the remainders follow in another, each of that many bits.
    """
    if len(values) == 0:
        return 0, b""
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    width = max(0, int(universe // len(values)).bit_length() - 1)
    ends = np.cumsum((gaps >> width) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    low = (gaps[:, None] >> np.arange(width)) & 1
    return width, np.packbits(unary).tobytes() + np.packbits(low.astype(np.uint8).ravel()).tobytes()


def golomb_decode(count: int, width: int, code: bytes) -> np.ndarray:
    """The values that :func:`golomb_encode` was given."""
    if count == 0:
        return np.zeros(0, np.int64)
    tail = (count * width + 7) // 8
    raw = np.frombuffer(code, np.uint8)
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]))
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.int64) << width
    if width:
        bits = np.unpackbits(raw[len(raw) - tail :], count=count * width).reshape(count, width)
        gaps += bits.astype(np.int64) @ (np.int64(1) << np.arange(width))
    return np.cumsum(gaps + 1) - 1


def normalised(text: str) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


SENT = "id long, uid long, digest string, sender int, frame int, owner int, slot int, width int, n int, code binary"


def _send(owners: int):
    span = -(-(1 << FINGERPRINT_BITS) // owners)

    def frame(no: int, ids: list, uids: list, digests: list) -> Iterator[pa.RecordBatch]:
        sender = TaskContext.get().partitionId()
        prints = np.array([int(d[: FINGERPRINT_BITS // 4], 16) for d in digests], np.int64)
        distinct, place = np.unique(prints, return_inverse=True)
        owner = distinct // span
        present, starts = np.unique(owner, return_index=True)
        first = np.repeat(starts, np.diff(np.append(starts, len(owner))))
        rows = len(ids)
        yield _batch(
            id=ids, uid=uids, digest=digests, sender=[sender] * rows, frame=[no] * rows,
            owner=owner[place], slot=place - first[place],
        )
        lists = [part - o * span for o, part in zip(present, np.split(distinct, starts[1:]), strict=True)]
        coded = [golomb_encode(x, span) for x in lists]
        k = len(lists)
        yield _batch(
            sender=[sender] * k, frame=[no] * k, owner=present, width=[c[0] for c in coded],
            n=[len(x) for x in lists], code=[c[1] for c in coded],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]
        no = 0
        for batch in batches:
            for column, values in zip(held, batch.columns, strict=True):
                column += values.to_pylist()
            if len(held[0]) >= FRAME_ROWS:
                yield from frame(no, *held)
                no, held = no + 1, [[], [], []]
        if held[0]:
            yield from frame(no, *held)

    return run


_TYPES = {
    "id": pa.int64(), "uid": pa.int64(), "digest": pa.string(), "sender": pa.int32(), "frame": pa.int32(),
    "owner": pa.int32(), "slot": pa.int32(), "width": pa.int32(), "n": pa.int32(), "code": pa.binary(),
}


def _batch(**columns) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in _TYPES.items()], list(_TYPES)
    )


def _answer(lists: pd.DataFrame) -> pd.DataFrame:
    """Bitmaps for the lists of one owner: a bit is set where another list holds the fingerprint too."""
    decoded = [golomb_decode(n, w, c) for n, w, c in zip(lists["n"], lists["width"], lists["code"], strict=True)]
    values = np.sort(np.concatenate(decoded))
    twice = np.append(values[1:][values[1:] == values[:-1]], np.iinfo(np.int64).max)
    lists["bitmap"] = [np.packbits(twice[np.searchsorted(twice, x)] == x).tobytes() for x in decoded]
    return lists[["sender", "frame", "owner", "bitmap"]]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set bits of the bitmaps, one row each."""
    for batch in batches:
        sender, frame, owner, maps = (batch.column(i).to_pylist() for i in range(4))
        for s, f, o, bitmap in zip(sender, frame, owner, maps, strict=True):
            slots = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8))).astype(np.int32)
            if len(slots):
                fixed = [pa.array(np.full(len(slots), x, np.int32)) for x in (s, f, o)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(slots)], ["sender", "frame", "owner", "slot"])


# A row's number holds its writer above the row's place in the writer's file.
_PLACE_BITS = 33


def _bitmap(places: pd.DataFrame) -> pd.DataFrame:
    """One bitmap per writer, as long as its last marked row needs."""
    place = places["place"].to_numpy()
    bits = np.zeros(int(place.max()) + 1, np.uint8)
    bits[place] = 1
    return pd.DataFrame({"writer": places["writer"].iloc[:1], "bits": [np.packbits(bits).tobytes()]})


def _bitmaps(uids: DataFrame) -> DataFrame:
    """(writer, bits) of the row numbers of ``uids``: an eighth of a byte per row of the writer."""
    places = uids.select(
        F.shiftright("uid", _PLACE_BITS).alias("writer"), F.col("uid").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("place")
    )
    return places.groupBy("writer").applyInPandas(_bitmap, "writer long, bits binary")


def _is_set() -> Column:
    """Whether ``bits`` holds the place of ``uid``; bits beyond the end are not set."""
    byte = "substring(bits, cast((uid & 8589934591) >> 3 as int) + 1, 1)"
    return F.expr(f"length({byte}) = 1 AND (shiftright(cast(conv(hex({byte}), 16, 10) as int), cast(7 - (uid & 7) as int)) & 1) = 1")


def _numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """(writer, uid, row): rows numbered by the task that writes them; ``row`` holds ``columns``, whatever their names."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*columns).alias("row"))
    return rows.withColumn("writer", F.shiftright("uid", _PLACE_BITS))


def _texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(
        "writer", "uid", F.col("row").getField(id_col).cast("long").alias("id"), F.col("row").getField(text_col).alias("text")
    )


def _decided(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprinted rows (id, uid, digest) and the groups of several equal texts (digest, first, size)."""
    spark = rows.sparkSession
    # Owners enough that the fingerprints of one fit a task, at any number of rows.
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // OWNER_ROWS))
    digest = F.sha2(normalised("text").cast("binary"), 256).alias("digest")
    sent = settled(rows.select("id", "uid", digest).mapInArrow(_send(owners), SENT), "sent")
    known = sent.where("uid is not null").select("id", "uid", "digest", "sender", "frame", "owner", "slot")
    lists = sent.where("uid is null").select("sender", "frame", "owner", "width", "n", "code")
    bitmaps = lists.groupBy("owner").applyInPandas(_answer, "sender int, frame int, owner int, bitmap binary")
    marked = bitmaps.mapInArrow(_marked, "sender int, frame int, owner int, slot int")
    # A slot that stands for several rows of its own list is no secret to the sender.
    several = known.groupBy("sender", "frame", "owner", "slot").count().where("count > 1").drop("count")
    at = ["sender", "frame", "owner", "slot"]
    suspects = settled(known.join(marked.unionByName(several).distinct(), at, "left_semi").select("uid", "digest"), "suspects")
    asked = settled(_bitmaps(suspects), "asked")
    found = rows.join(asked.hint("shuffle_hash"), "writer").where(_is_set()).select("writer", normalised("text").alias("text"))
    # Whole texts are the key, so equality is that of bytes.  Copies fall together in each task, then by shares of
    # the writers, so a text that all writers hold meets in one task only as often as there are shares.
    verified = settled(
        found.withColumns({"digest": F.sha2(F.col("text").cast("binary"), 256), "share": F.pmod("writer", F.lit(SHARES))})
        .groupBy("digest", "text", "share").agg(F.count(F.lit(1)).alias("size"))
        .groupBy("digest", "text").agg(F.sum("size").alias("size"))
        .where("size > 1")
        .groupBy("digest").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("texts")),
        "verified",
    )
    if not verified.where("texts > 1").isEmpty():
        raise ValueError("different texts share a SHA-256 digest")
    known = known.select("id", "uid", "digest")
    first = (
        known.join(verified.select("digest"), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first"), F.count(F.lit(1)).alias("size"))
    )
    return known, settled(first, "first")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null counts as empty.  The row
    with the smallest id stays; rows without an id come last, and of rows that share the smallest id exactly one
    stays.  ``group_size`` counts rows, repeated ones too.  An empty table gives an empty result.  Other columns of
    ``docs``, whatever their names, are not read.
    """
    with bucketed(_numbered(docs, id_col, text_col), "writer", "rows") as rows:
        known, first = _decided(_texts(rows, id_col, text_col))
    return known.join(first, "digest", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("first").isNull() | (F.col("first.uid") == F.col("uid"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns.

    Dropped rows are told by their numbers, so rows that share id and text are copies like any other.
    """
    with bucketed(_numbered(docs, *docs.columns), "writer", "rows") as rows:
        known, first = _decided(_texts(rows, id_col, text_col))
        gone = known.join(first, "digest").where(F.col("uid") != F.col("first.uid")).select("uid")
        gone = settled(_bitmaps(gone), "gone")
        stays = rows.join(gone.hint("shuffle_hash"), "writer", "left").where(~F.coalesce(_is_set(), F.lit(False)))
        return settled(stays.select("row.*"), "kept")
