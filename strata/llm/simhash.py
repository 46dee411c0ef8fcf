"""Near duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints of 64 bits that differ in at most three bits differ in at most one bit of one of their halves.  So
a fingerprint emits, for each half, all variants of that half within half the radius (rounded down: one bit), and
fingerprints that meet in a variant are compared over all 64 bits.  Halves one bit apart have unequal parity, so
only halves of even parity emit their flipped variants, the others just themselves.

A half that many fingerprints share would bring too many of them together.  Its variants are hashed again by the
other half, where every bucket holds at most some 1,600 different fingerprints whatever the input, and each bucket
is linked through one of its members instead of by all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import byte_text, merged, stored
from strata.llm.components import components

SEED = 42
HALF = 32
RADIUS = 3
# Different fingerprints with the same half from which on that half is hashed again by the other one.
CROWD = 64

_ONE_BIT = [1 << i for i in range(HALF)]
_TWO_BITS = [1 << i | 1 << j for i in range(HALF) for j in range(i)]
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the word shingles of UTF-8 ``text``, as an unsigned number; 0 if it has no word."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
        hashes = [digest(joined[a:z], SEED) for a, z in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    majority = _bit_counts(np.array(hashes, dtype="<u8")) * 2 > len(hashes)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def _bit_counts(hashes: np.ndarray, block: int = 4096) -> np.ndarray:
    """How many of ``hashes`` have each bit set, in blocks so that long texts need no more memory."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), block):
        part = hashes[i : i + block].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return counts


def _print_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype="<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view("<i8"))], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp): the 64 bits as a long, one row per row of ``docs``; null texts count as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), byte_text(text_col).alias("text"))
    return rows.mapInArrow(_print_batches(shingle), "id long, fp long")


def _half(part: int) -> Column:
    value = F.shiftrightunsigned("fp", HALF) if part else F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    return value + F.lit(part << HALF)


def _flipped(value: Column, masks: list[int]) -> Column:
    return F.transform(F.lit(masks).cast("array<long>"), lambda mask: value.bitwiseXOR(mask))


def _own(prints: DataFrame) -> DataFrame:
    """(fp, key): the two halves of every fingerprint, each marked with its place."""
    return prints.select("fp", F.explode(F.array(_half(0), _half(1))).alias("key"))


def _ball(keys: DataFrame) -> DataFrame:
    """Adds ``variant``: the key, and where its parity is even all keys one bit away; ``own`` marks the key itself."""
    half = F.col("key").bitwiseAND(F.lit((1 << HALF) - 1))
    flips = F.when(F.bit_count(half) % 2 == 0, _flipped(F.col("key"), _ONE_BIT)).otherwise(F.array().cast("array<long>"))
    return keys.select("*", F.explode(F.concat(F.array("key"), flips)).alias("variant")).withColumn(
        "own", F.col("variant") == F.col("key")
    )


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _crowded_links(members: DataFrame) -> DataFrame:
    """Links among members of crowded variants (variant, fp, own), through a hub of each bucket.

    With d1 bits of difference in this half and d2 in the other, two members are linked if d1 + d2 <= 3.  Members
    whose half is the variant itself (d1 = 0 among them) emit all variants of their other half within two bits, the
    ones within one bit being marked as near; members one bit off emit those within one bit.  A near member is linked
    with every other member of its bucket: 0 + (1 + 2) bits at most with its like, 1 + (1 + 1) with those one bit off.
    Every pair to be found shares a bucket that holds a near member, so both are linked with the hub, the smallest one.
    """
    low = F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    other = F.when(F.col("variant") >= F.lit(1 << HALF), low).otherwise(F.shiftrightunsigned("fp", HALF))
    value = members.withColumn("other", other)
    within_one = F.concat(F.array("other"), _flipped(F.col("other"), _ONE_BIT))
    near = value.select("variant", "fp", F.col("own").alias("near"), F.explode(within_one).alias("middle"))
    at_two = _flipped(F.col("other"), _TWO_BITS)
    far = value.where("own").select("variant", "fp", F.lit(False).alias("near"), F.explode(at_two).alias("middle"))
    buckets = near.unionByName(far)
    hub = F.expr("min(case when near then fp end) over (partition by variant, middle)")
    return buckets.select("fp", hub.alias("hub")).where("hub is not null and hub <> fp").distinct()


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between different fingerprints of ``prints`` (column ``fp``, distinct).

    Every link joins fingerprints at most three bits apart, and any two such fingerprints are linked directly or
    through a third one, so components over the links are those over all pairs.
    """
    own = _own(prints)
    crowds = own.groupBy("key").count().where(F.col("count") > crowd).drop("count")
    crowded = stored(_ball(crowds).select("variant").distinct(), "crowded")
    ball = _ball(own).select(F.col("fp").alias("b"), "variant", "own")
    seat = own.select(F.col("fp").alias("a"), F.col("key").alias("variant"))
    light = seat.join(merged(crowded), "variant", "left_anti")
    met = light.join(merged(ball), "variant").where(
        (F.col("a") != F.col("b")) & (~F.col("own") | (F.col("a") < F.col("b"))) & (_distance("a", "b") <= RADIUS)
    )
    found = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if not crowded.isEmpty():
        heavy = _ball(own).select("variant", "fp", "own").join(merged(crowded), "variant")
        found = found.unionByName(_crowded_links(heavy).select(F.col("hub").alias("a"), F.col("fp").alias("b")))
    return found.distinct()


def simhash_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, crowd: int = CROWD
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Texts are lower-cased in A-Z; words are runs without white space; the fingerprint has a bit set where more than
    half of the XXH64 values of the word shingles have it.  Texts with fewer words are one shingle; null and empty
    texts have the fingerprint zero and are linked like any other.  Fingerprints at most three bits apart are
    linked; ``component_id`` is the smallest id reachable, null only if no row of the component has an id.  Repeated
    rows are repeated in the result.  Other columns of ``docs`` are not read.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "prints")
    # Rows of one fingerprint are one node, so a large group of copies is no load on what follows.
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    labels = components(links(nodes.select("fp"), crowd), "a", "b").withColumnRenamed("node", "fp")
    rooted = stored(
        nodes.join(merged(labels), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "rooted"
    )
    smallest = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    named = stored(rooted.join(merged(smallest), "root").select("fp", "component_id"), "named")
    return rows.join(merged(named), "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` whose id is that of their component, with all columns; rows without an id stay."""
    gone = simhash_dedup(docs, id_col, text_col, shingle).where(F.col("component_id") < F.col(id_col))
    return docs.join(merged(gone.select(id_col).distinct()), id_col, "left_anti").select(*docs.columns)
