"""Passages that repeat across a corpus, by common-prefix intervals of an enhanced suffix array.

A distributed suffix array needs suffixes that share a long prefix to meet in one task.  They meet by minimizers:
of the 32-byte grams of every window of ``LENGTH`` bytes the one with the smallest hash names the window.  Equal
windows have the same name at the same place, so consecutive windows named by one gram travel together as a
*segment* of at most 168 bytes, in the *bucket* of that gram.  Equal segments are one class, whatever their number.

Per bucket the suffixes of the classes are sorted, neighbours get their common prefix lengths, and a stack scan
lists the common-prefix intervals of at least ``LENGTH`` bytes.  An interval whose members are preceded by different
bytes (the start of a segment differs from everything) is a maximal repeat; it is given with all its occurrences, not
just neighbours.  Repeats are maximal within their segments: one that runs on through the next segment comes as
groups that overlap there, and :func:`repeated_spans` puts them together.

Buckets with more than ``CROWD`` classes are not sorted in one task: their windows are grouped by 128 bits of the
SHA-256 of their bytes, one group of ``LENGTH`` bytes each, which finds the same repeated windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import byte_text, ranked, settled

# Bytes of the shortest repeat, and of the grams that name windows.
LENGTH = 100
GRAM = 32
# Grams of a window, at the same time the most windows of a segment.
SPAN = LENGTH - GRAM + 1
LONGEST = LENGTH + SPAN - 1
# Classes of a bucket that one task sorts at most.
CROWD = 4096
# Positions hashed at a time: the place of a gram takes the low 20 bits of its sort key.
BLOCK = (1 << 20) - 256
# Bytes of segments whose suffixes are sorted at a time, whole buckets.
CHUNK = 1 << 21

_BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of ``h`` over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _joined(left: np.ndarray, n: int, right: np.ndarray, m: int) -> np.ndarray:
    """Hashes of ``n + m`` bytes from those of the first ``n`` and the next ``m``."""
    size = min(len(left), max(0, len(right) - n))
    return left[:size] * _power(m) + right[n : n + size]


def window_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of the grams and of the windows that start at each byte."""
    by_size = {1: _BYTE[data]}
    for n in (1, 2, 4, 8, 16):
        by_size[2 * n] = _joined(by_size[n], n, by_size[n], n)
    gram = by_size[GRAM]
    window, done = gram, GRAM
    while done < LENGTH:
        n = next(n for n in (32, 16, 8, 4, 2, 1) if n <= LENGTH - done)
        window, done = _joined(window, done, by_size[n], n), done + n
    return _mixed(gram), window


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` consecutive keys."""
    size, low = 1, keys
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    return np.minimum(low[: len(low) - (width - size)], low[width - size :]) if size < width else low


def segments_of(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Segments of the texts that lie in ``data`` from ``first`` to ``last``: (text, start, windows, lead, gram, hash).

    ``start`` counts from the start of the text, ``lead`` is the place of the gram in the segment.  Texts are cut
    into blocks that overlap by a window, so memory does not grow with them; a cut only makes two segments of one.
    """
    for at in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
        part = data[at : at + BLOCK + LENGTH - 1]
        gram, window = window_hashes(part)
        low = np.uint64((1 << 20) - 1)
        # The leftmost of equal grams: hash above, place below.
        keys = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
        place = (_smallest(keys, SPAN) & low).astype(np.int64)
        starts = np.arange(len(place), dtype=np.int64) + at
        text = np.searchsorted(last, starts, side="right")
        fits = text < len(last)
        fits[fits] = (starts[fits] >= first[text[fits]]) & (starts[fits] + LENGTH <= last[text[fits]])
        kept = np.flatnonzero(fits)
        if not len(kept):
            continue
        place, text, starts = place[kept], text[kept], starts[kept]
        new = np.ones(len(kept), bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        a = np.flatnonzero(new)
        windows = np.diff(np.append(a, len(kept)))
        z = a + windows - 1
        lead = place[a] + at - starts[a]
        # Two windows cover a segment, so their hashes tell it from others.
        head, tail = window[starts[a] - at], window[starts[z] - at]
        print_ = _mixed(_mixed(head) + tail * np.uint64(3) + windows.astype(np.uint64) * np.uint64(_BASE))
        yield text[a], starts[a] - first[text[a]], windows, lead, gram[place[a]], print_


_SEGMENT = "g long, h long, doc long, sub long, spot long"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, sub, bytes) to segments; ``spot`` holds start, lead and number of windows, in order of the start."""
    for batch in batches:
        texts = batch.column(2)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if not len(texts) or offsets[-1] - offsets[0] < LENGTH:
            continue
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        doc, sub = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        for text, start, windows, lead, gram, print_ in segments_of(data, offsets[:-1], offsets[1:]):
            columns = [gram.view(np.int64), print_.view(np.int64), doc[text], sub[text], start << 16 | lead << 8 | windows]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["g", "h", "doc", "sub", "spot"])


def _start(spot: str) -> Column:
    return F.shiftright(spot, 16)


def _windows(spot: str) -> Column:
    return F.col(spot).bitwiseAND(F.lit(255))


def suffix_array(data: np.ndarray, start: np.ndarray, end: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``data[start:end]`` of at most ``LONGEST`` bytes by (bucket, bytes), and common prefixes.

    ``lcp[i]`` is the length that the suffixes in places i - 1 and i share; 0 between buckets.
    """
    padded = np.concatenate([data, np.zeros(LONGEST, np.uint8)])
    rows = padded[start[:, None] + np.arange(LONGEST)]
    size = end - start
    rows[np.arange(LONGEST) >= size[:, None]] = 0
    words = rows.view(">u8")
    order = np.lexsort((size, *words.T[::-1].astype(np.uint64), bucket))
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(1), differ.argmax(1), LONGEST)
    common = np.minimum(common, np.minimum(size[order][1:], size[order][:-1]))
    common[bucket[order][1:] != bucket[order][:-1]] = 0
    return order, np.concatenate([[0], common])


def prefix_intervals(lcp: list[int], changes: list[int], least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of at least ``least`` whose members differ on the left.

    ``changes[i]`` counts the places up to i whose left byte differs from that of the place before.  A stack holds the
    open intervals, longer ones on top; an interval ends where the common prefix gets shorter.
    """
    found = []
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            if changes[i - 1] > changes[first]:
                found.append((length, first, i - 1))
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))
    return found


def maximal_groups(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, bucket: np.ndarray, place: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Maximal repeats among segments: (group, length, segment, offset, earliest), one row per occurrence.

    ``place`` orders the starts of the segments over all texts; offsets are added to it.  Only suffixes whose first
    ``LENGTH`` bytes occur twice in a bucket are sorted, for no others can be in an interval.
    """
    nothing = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)
    windows = end - start - LENGTH + 1
    segment = np.repeat(np.arange(len(start)), windows)
    offset = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    hashes = window_hashes(data)[1][start[segment] + offset] ^ _mixed(bucket[segment].astype(np.uint64))
    order = np.argsort(hashes, kind="stable")
    twin = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(len(order), bool)
    again[order[1:][twin]] = again[order[:-1][twin]] = True
    segment, offset = segment[again], offset[again]
    if not len(segment):
        return nothing
    at = start[segment] + offset
    order, lcp = suffix_array(data, at, end[segment], bucket[segment])
    segment, offset, at = segment[order], offset[order], at[order]
    left = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int64), 256 + np.arange(len(at)))
    turns = np.concatenate([[0], left[1:] != left[:-1]]).astype(np.int64)
    # Runs of long common prefixes with one and the same left byte hold no maximal repeat.
    run = np.cumsum(lcp < LENGTH) - 1
    lively = np.bincount(run, weights=turns * (lcp >= LENGTH)) > 0
    seen = np.flatnonzero(lively[run])
    if not len(seen):
        return nothing
    turns = np.where(lcp >= LENGTH, turns, 0)[seen]
    found = np.array(prefix_intervals(lcp[seen].tolist(), np.cumsum(turns).tolist(), LENGTH), np.int64)
    length, first, last = found.T
    size = last - first + 1
    group = np.repeat(np.arange(len(found)), size)
    member = seen[np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size) + first[group]]
    when = place[segment[member]] + offset[member]
    least = np.minimum.reduceat(when, np.cumsum(size) - size)
    return group, length[group], segment[member], offset[member], when == least[group]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Classes (g, h, doc, sub, start, segment), sorted by g, whole buckets at a time, with their maximal repeats."""

    def sorted_out(held: list[pa.RecordBatch]) -> tuple:
        rows = pa.Table.from_batches(held).combine_chunks()
        g, h, doc, sub, begin = (np.asarray(rows.column(i)) for i in range(5))
        texts = rows.column(5).combine_chunks() if rows.column(5).num_chunks != 1 else rows.column(5).chunk(0)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        by_doc = np.lexsort((sub, doc))
        new = (np.diff(doc[by_doc]) != 0) | (np.diff(sub[by_doc]) != 0)
        number = np.empty(len(doc), np.int64)
        number[by_doc] = np.concatenate([[0], np.cumsum(new)])
        bucket = np.concatenate([[0], np.cumsum(g[1:] != g[:-1])])
        return (g, h, doc, sub, begin), maximal_groups(data, offsets[:-1], offsets[1:], bucket, (number << 32) + begin)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        g = np.asarray(batch.column(0))
        size += batch.nbytes
        if size < CHUNK or g[0] == g[-1]:
            held.append(batch)
            continue
        cut = int(np.flatnonzero(g != g[-1])[-1]) + 1
        yield sorted_out([*held, batch.slice(0, cut)])
        held, size = [batch.slice(cut)], 0
    if held:
        yield sorted_out(held)


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in schema.split(", ")])


_GROUP = "g long, h long, offset int, length int, first_doc long, first_sub long, first_start long, earliest boolean"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes (g, h, doc, sub, start, segment), sorted by g, to the occurrences of their maximal repeats."""
    for (g, h, doc, sub, begin), (group, length, segment, offset, earliest) in _buckets(batches):
        head = segment[earliest][np.searchsorted(group[earliest], group)] if len(group) else segment
        lag = offset[earliest][np.searchsorted(group[earliest], group)] if len(group) else offset
        yield _batch(
            _GROUP, g[segment], h[segment], offset.astype(np.int32), length.astype(np.int32),
            doc[head], sub[head], begin[head] + lag, earliest,
        )


_COVER = "g long, h long, offset int, length int"


def _covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes (g, h, doc, sub, start, segment), sorted by g, to what of each starts earlier elsewhere, if anything.

    Any two repeats of a segment overlap, as it is shorter than twice the shortest; together they are one stretch.
    """
    for (g, h, *_), (_, length, segment, offset, earliest) in _buckets(batches):
        segment, offset, length = segment[~earliest], offset[~earliest], length[~earliest]
        first, end = np.full(len(g), LONGEST, np.int64), np.zeros(len(g), np.int64)
        np.minimum.at(first, segment, offset)
        np.maximum.at(end, segment, offset + length)
        found = end > 0
        yield _batch(_COVER, g[found], h[found], first[found].astype(np.int32), (end - first)[found].astype(np.int32))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, sub, text): every row with a key of its own, ordered as the texts are; null texts are empty.

    ``doc`` is the id and ``sub`` 0 where an id stands once.  Rows that share an id, or have none, come in the order
    of their texts, those without an id behind all others.
    """
    last = (1 << 63) - 1
    plain = docs.select(F.col(id_col).cast("long").alias("id"), byte_text(text_col).alias("text"))
    shared = plain.groupBy("id").count().where("count > 1 or id is null or id = 9223372036854775807").select("id")
    shared = settled(shared, "shared_ids")
    alone = plain.select("id", F.col("id").alias("doc"), F.lit(0).cast("long").alias("sub"), "text")
    if shared.isEmpty():
        return alone
    several = plain.join(shared, plain["id"].eqNullSafe(shared["id"]), "left_semi")
    several = ranked(several, F.col("id").isNull(), "id", F.sha2("text", 256), name="several").select(
        "id", F.coalesce("id", F.lit(last)).alias("doc"), (F.col("rank") + 1).alias("sub"), "text"
    )
    return settled(alone.join(shared, "id", "left_anti").where("id is not null").unionByName(several), "numbered")


def _found(texts: DataFrame, crowd: int, listed: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences of repeated segments, their classes, and the maximal repeats among the classes.

    The repeats come with all their occurrences if ``listed``, else as one stretch per class (see :func:`_covers`).
    """
    segments = texts.select("doc", "sub", "text").mapInArrow(_segments, _SEGMENT)
    # Counts are summed up before the shuffle, so a common gram is one row per task.
    grams = settled(segments.groupBy("g").count().where("count > 1").select("g"), "grams")
    occurrences = settled(segments.join(grams, "g"), "occurrences")
    classes = settled(
        occurrences.groupBy("g", "h")
        .agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("doc", "sub", "spot")).alias("first"))
        .select("g", "h", "size", "first.*"),
        "classes",
    )
    # A bucket with one class has no repeat but the class itself.
    buckets = settled(classes.groupBy("g").count().where("count > 1"), "buckets")
    asked = classes.join(buckets, "g").select("g", "h", "doc", "sub", _start("spot").alias("start"), _windows("spot").alias("windows"), "count")
    with_text = settled(
        texts.select("doc", "sub", "text").join(asked, ["doc", "sub"]).select(
            "g", "h", "doc", "sub", "start",
            F.expr(f"substring(text, cast(start + 1 as int), cast(windows + {LENGTH - 1} as int))").alias("segment"),
            "count",
        ),
        "segments",
    )
    calm = with_text.where(F.col("count") <= crowd).drop("count").repartition("g").sortWithinPartitions("g")
    groups = calm.mapInArrow(_groups, _GROUP) if listed else calm.mapInArrow(_covers, _COVER)
    if not buckets.where(F.col("count") > crowd).isEmpty():
        crowded = _crowded_groups(with_text.where(F.col("count") > crowd))
        groups = groups.unionByName(crowded if listed else _crowded_covers(crowded))
    return occurrences, classes, settled(groups, "groups")


def _crowded_groups(classes: DataFrame) -> DataFrame:
    """Groups of equal windows among classes of crowded buckets, by a hash of them and with no bucket in one task."""
    windows = classes.select(
        "g", "h", "doc", "sub", "start", "segment", F.explode(F.expr(f"sequence(0, length(segment) - {LENGTH})")).alias("offset")
    ).select(
        "g", "h", "doc", "sub", (F.col("start") + F.col("offset")).alias("start"), "offset",
        F.expr(f"sha2(substring(segment, offset + 1, {LENGTH}), 256)").alias("bytes"),
    )
    windows = windows.withColumn("bytes", F.unhex(F.substring("bytes", 1, 32)))
    lowest = (
        windows.groupBy("bytes")
        .agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("doc", "sub", "start")).alias("low"))
        .where("size > 1")
        .drop("size")
    )
    return windows.join(lowest, "bytes").select(
        "g", "h", "offset", F.lit(LENGTH).alias("length"),
        F.col("low.doc").alias("first_doc"), F.col("low.sub").alias("first_sub"), F.col("low.start").alias("first_start"),
        (F.struct("doc", "sub", "start") == F.col("low")).alias("earliest"),
    )


def _crowded_covers(groups: DataFrame) -> DataFrame:
    """As :func:`_covers`, from the groups of crowded buckets."""
    first, end = F.min("offset"), F.max(F.col("offset") + F.col("length"))
    later = groups.where("not earliest").groupBy("g", "h")
    return later.agg(first.alias("offset"), (end - first).cast("int").alias("length"))


def maximal_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Repeat groups with all their occurrences: length, first_doc, first_start, id, start, one row per occurrence.

    A group is named by its length and its earliest occurrence.  Places are byte offsets in the UTF-8 text.  A group
    is a maximal repeat within its segments (see above), or a class of equal segments.  Null and short texts have no
    repeat; an empty table gives an empty result; rows that share an id are told apart as in :func:`numbered`.
    """
    texts = numbered(docs, id_col, text_col)
    occurrences, classes, groups = _found(texts, crowd, listed=True)
    member = occurrences.select("g", "h", "doc", "sub", _start("spot").alias("begin"))
    whole = classes.where("size > 1").select(
        "g", "h", F.lit(0).alias("offset"), (_windows("spot") + LENGTH - 1).cast("int").alias("length"),
        F.col("doc").alias("first_doc"), F.col("sub").alias("first_sub"), _start("spot").alias("first_start"),
    )
    rows = groups.drop("earliest").unionByName(whole).join(member, ["g", "h"])
    ids = texts.select("id", "doc", "sub")
    return (
        rows.join(ids, ["doc", "sub"])
        .join(ids.select(F.col("id").alias("first_id"), F.col("doc").alias("first_doc"), F.col("sub").alias("first_sub")), ["first_doc", "first_sub"])
        .select(
            "length", F.col("first_id").alias("first_doc"), "first_start", F.col("id").alias(id_col),
            (F.col("begin") + F.col("offset")).alias("start"),
        )
        .distinct()
    )


def repeated_spans(texts: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc, sub, start, end): bytes of occurrences that are not the earliest of their group, for :func:`numbered` texts.

    Spans overlap; together they cover exactly the bytes of strings of ``LENGTH`` bytes that also start earlier.
    """
    occurrences, classes, covers = _found(texts, crowd, listed=False)
    # The first segment of a class is judged against other classes, all others repeat it whole.
    whole = (
        occurrences.join(classes.where("size > 1").select("g", "h", F.struct("doc", "sub", "spot").alias("first")), ["g", "h"])
        .where(F.struct("doc", "sub", "spot") != F.col("first"))
        .select("doc", "sub", _start("spot").alias("start"), (_start("spot") + _windows("spot") + LENGTH - 1).alias("end"))
    )
    part = covers.join(classes.select("g", "h", "doc", "sub", "spot"), ["g", "h"]).select(
        "doc", "sub", (_start("spot") + F.col("offset")).alias("start"), (_start("spot") + F.col("offset") + F.col("length")).alias("end")
    )
    return whole.unionByName(part)


def merged(spans: np.ndarray) -> np.ndarray:
    """Rows (start, end) of the union of ``spans``, in order; touching ones are one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(spans)) - 1]], axis=1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, packed spans) to (id, removed spans, kept bytes)."""
    for batch in batches:
        spans, kept = [], []
        for text, packed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            packed = np.array(packed or [], np.int64)
            runs = merged(np.stack([packed >> 32, packed & 0xFFFFFFFF], axis=1))
            edges = [0, *runs.ravel().tolist(), len(text)]
            spans.append([{"start": a, "end": z} for a, z in runs.tolist()])
            kept.append(b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "text", "spans", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, spans (removed runs of bytes), kept (the remaining bytes).

    A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a text with a smaller id, or
    earlier in the same one; texts are judged as they came.  Null and empty texts keep their nothing; texts below
    ``LENGTH`` bytes stay whole.  Rows that share an id come in the order of their texts, rows without an id last, so
    of repeated rows one keeps its text.  An empty table gives an empty result; other columns are not read.
    """
    texts = numbered(docs, id_col, text_col)
    spans = repeated_spans(texts, crowd).select("doc", "sub", F.expr("shiftleft(start, 32) | end").alias("span"))
    # A text has no more different spans than segments, so a list is bounded by its text.
    listed = settled(spans.groupBy("doc", "sub").agg(F.collect_set("span").alias("spans")), "spans")
    cut = texts.join(listed, ["doc", "sub"], "left").select("id", "text", "spans")
    rows = cut.mapInArrow(_cut, "id long, text binary, spans array<struct<start:long,end:long>>, kept binary")
    return rows.select(F.col("id").alias(id_col), F.length("text").cast("long").alias("n_bytes"), "spans", "kept")


def repeat_report(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, removed runs and the SHA-256 of what remains."""
    return without_repeats(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
