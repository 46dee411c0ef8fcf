"""SimHash near duplicates against comparison of all pairs."""

import random

import pytest
import xxhash

from strata.llm.simhash import drop_near_copies, fingerprint, links, simhash_dedup

SPACE = " \t\n\x0b\x0c\r"


def plain_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """{id: smallest id reachable} over all pairs at most three bits apart."""
    group = {i: i for i, _ in prints}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for n, (i, a) in enumerate(prints):
        for j, b in prints[:n]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((root(i), root(j)))
                group[y] = x
    return {i: root(i) for i, _ in prints}


def test_fingerprint_follows_its_definition():
    texts = ["", " \n", "one", "One TWO", "a b c", "a b c d e f g a b c", "é É x y z\x0bw", "w " * 5000]
    for text in texts:
        assert fingerprint(text.encode()) == plain_print(text)


@pytest.mark.parametrize("crowd", [1, 64])
def test_components_over_planted_distances(spark, crowd):
    rng = random.Random(crowd)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = set(base)
    for b in base[:8]:
        for _ in range(12):
            x = b
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 6])):
                x ^= 1 << bit
            prints.add(x)
    # One half is shared by many: the other half runs along a chain and beside it.
    for k in range(40):
        prints.add((base[0] & ~0xFFFFFFFF) | (0b111 << (k % 30)))
        prints.add((base[1] & 0xFFFFFFFF) | (rng.getrandbits(6) << 40))
    signed = [(x - (1 << 64) if x >> 63 else x) for x in sorted(prints)]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = [tuple(r) for r in links(frame, crowd).collect()]
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= 3 for a, b in found)
    want = plain_components([(x, x & mask) for x in signed])
    group = {x: x for x in signed}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in found:
        x, y = sorted((root(a), root(b)))
        group[y] = x
    assert {x: root(x) for x in signed} == want


def test_whole_table_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r[0]: (r[1], r[2]) for r in simhash_dedup(docs).collect()}
    prints = [(r.doc_id, plain_print(r.text)) for r in docs.orderBy("doc_id").collect()]
    want = plain_components(prints)
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints}


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, fp string, id int, component_id string"
    rows = [
        (3, None, "x", 1, "y"), (1, " ", None, None, None), (1, " ", None, None, None), (None, "", "x", 1, "y"),
        (7, "some words stand here", None, None, None), (None, "some words stand here", None, None, None),
        (None, "other words alone", None, None, None),
    ]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(map(str, (tuple(r) for r in simhash_dedup(docs).collect())))
    some, other = (f"{plain_print(t):016x}" for t in ("some words stand here", "other words alone"))
    zero = "0" * 16
    want = [(3, zero, 1), (1, zero, 1), (1, zero, 1), (None, zero, 1), (7, some, 7), (None, some, 7), (None, other, None)]
    assert got == sorted(map(str, want))
    assert simhash_dedup(docs.limit(0)).count() == 0
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "7", "None", "None", "None"]


def test_variants_are_not_broadcast(spark):
    """Spark takes the 33 variants of a half for no more than the halves, and so would send them through the driver."""
    prints = spark.createDataFrame([(i * 0x9E3779B97F4A7C1 % (1 << 63),) for i in range(300)], "fp long")
    plan = links(prints)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    )
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
