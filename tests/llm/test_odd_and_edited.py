"""Recall near the threshold, a whole tree of shards against a plain one, and odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from test_training_data import edited, prose
from threadloom.llm import decontaminate, sharding, simhash, vectors


def near_pair(rng, n):
    """Two texts of n words whose five-word shingle sets are similar to 0.8 to 0.87."""
    while True:
        text = prose(rng, n)
        words = text.split()
        for _ in range(max(1, round(n * 0.022)) if n > 60 else 1):
            at = rng.randrange(n) if n > 45 else rng.choice([*range(4), *range(n - 4, n)])
            words[at] = f"new{rng.randrange(10**6)}"
        other = " ".join(words)
        if 0.8 <= brute.jaccard(text, other) <= 0.87:
            return text, other


def test_recall_of_short_and_long_pairs(spark):
    rng = random.Random(31)
    sizes = {24: 150, 40: 150, 60: 150, 1000: 60}
    texts, of, k = {}, {}, 0
    for size, count in sizes.items():
        for _ in range(count):
            texts[2 * k], texts[2 * k + 1] = near_pair(rng, size)
            of[k] = size
            k += 1
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    found = Counter(of[j] for j in of if got[2 * j] == got[2 * j + 1])
    assert all(found[size] >= 0.9 * count for size, count in sizes.items()), found
    assert all(got[d] in (d, d - d % 2) for d in texts)  # nothing else is linked


def test_short_items_edited_are_found(spark):
    rng = random.Random(13)
    items = {i: prose(rng, rng.choice([20, 30, 45, 60])) for i in range(40)}
    rows = []
    for k in range(200):
        item = items[k % 40]
        rows.append((k, f"{prose(rng, rng.randint(0, 40))} {edited(rng, item, 1) if k % 3 else item} {prose(rng, 30)}"))
    wanted = set()
    for k, text in rows:
        flat, item = (brute.word_runs(x) for x in (text, items[k % 40]))
        if max(brute.weighted(flat[a : a + len(item)], item) for a in range(len(flat) - len(item) + 1)) >= 0.8:
            wanted.add((k, k % 40))
    marked = decontaminate.mark(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {(r.doc_id, m.item_id) for r in marked.collect() for m in r.matches}
    assert len(wanted) > 80 and got <= wanted and len(got) >= 0.98 * len(wanted), (len(got), len(wanted))


def test_decontamination_of_null_ids(spark):
    rng = random.Random(2)
    passage = prose(rng, 80)
    docs = spark.createDataFrame([(None, f"a {passage} b"), (None, "clean words only"), (3, passage), (3, passage), (None, None)], "doc_id long, text string").withColumn("Matches_", F.lit(1))
    marked = decontaminate.mark(docs, spark.createDataFrame([(None, passage), (7, passage), (8, None)], "item_id long, text string"))
    hit = Counter((r.doc_id, r.text is not None and passage in r.text, len(r.matches) > 0) for r in marked.collect())
    assert hit == Counter({(None, True, True): 1, (None, False, False): 2, (3, True, True): 2})


def test_groups_of_nothing_null_ids_repeats_and_extra_columns(spark):
    schema = "doc_id long, text string, fp string, component_id string, key long"
    assert simhash.groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "one two three four"), (5, "one two three four"), (5, "one two three four"), (2, None), (9, ""), (7, "quite another text here")]
    found = Counter((r.doc_id, r.component_id) for r in simhash.groups(spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema)).collect())
    assert found == Counter([(None, 5), (5, 5), (5, 5), (2, 2), (9, 2), (7, 7)])


def test_vectors_with_extra_columns(spark):
    rows = [(1, [1.0, 0.0], "a", 3, 4), (2, [1.0, 0.1], "b", 5, 6), (3, [0.0, 1.0], None, 7, 8)]
    found = vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string, component_id long, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def plain_tree(points, leaves, full):
    """Rows (size, coordinates) by leaf: the widest dimension is cut where the sizes reach the left leaves' part."""
    out = {}

    def grow(rows, first, n):
        if n == 1 or not rows:
            out[first] = rows
            return
        wide = [(max(r[1][i] for r in rows) - min(r[1][i] for r in rows)) / full[i] for i in range(len(full))]
        i = max(range(len(full)), key=lambda k: (wide[k], -k))
        rows = sorted(rows, key=lambda r: r[1][i])
        goal, so_far, at = sum(r[0] for r in rows) * (n // 2) / n, 0, 0
        while at < len(rows) and so_far < goal:
            so_far += rows[at][0]
            at += 1
        grow(rows[:at], first, n // 2)
        grow(rows[at:], first + n // 2, n - n // 2)

    grow(points, 0, leaves)
    return out


@pytest.mark.parametrize("leaves", [2, 5, 8])
def test_a_whole_tree_of_shards(spark, leaves):
    """Coordinates and texts differ in all rows, so that no tie decides; leaves may differ by the row at each cut above them."""
    rng = random.Random(leaves)
    n = 400
    xs, ys = rng.sample(range(10_000), n), rng.sample(range(10_000), n)
    rows = [(i, f"{i:03} " + "w" * rng.randint(1, 60), x, y) for i, (x, y) in enumerate(zip(xs, ys))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, x long, y long")
    found = {r.doc_id: r.shard for r in sharding.shard(docs, {"x": F.col("x"), "y": F.col("y")}, leaves=leaves).collect()}
    tree = plain_tree([(len(t) + 8, (x, y), i) for i, t, x, y in rows], leaves, [max(xs) - min(xs), max(ys) - min(ys)])
    wanted = {r[2]: leaf for leaf, part in tree.items() for r in part}
    assert sum(found[i] != wanted[i] for i in wanted) <= 8 * leaves  # rows on a cut may go either way
    size = Counter()
    for i, t, *_ in rows:
        size[found[i]] += len(t) + 8
    assert len(size) == leaves and max(size.values()) - min(size.values()) <= 68 * 4


def test_pairs_of_mixed_buckets_come_once_and_none_is_lost(spark):
    """Texts near one another in several tables and buckets against a comparison of all pairs."""
    rng, tables, bits, most = np.random.default_rng(5), 4, 32, 30
    centres = rng.integers(0, 2**63, (12, 2), np.int64)
    wide = {}
    for k in range(150):
        own = [int(x) for x in centres[k % 12]]
        for _ in range(int(rng.integers(0, 7))):
            own[int(rng.integers(2))] ^= 1 << int(rng.integers(63))
        wide[int(rng.integers(-(2**62), 2**62))] = own
    part = lambda fp, t: fp[t // 2] >> (32 * (t % 2)) & (2**32 - 1)
    far = lambda a, b: [(part(a, t) ^ part(b, t)).bit_count() for t in range(tables)]
    want = {(x, y) for x in wide for y in wide if x < y and min(far(wide[x], wide[y])) <= 2 and sum(far(wide[x], wide[y])) <= most}
    shared = sum(sum(d <= 2 for d in far(wide[x], wide[y])) > 1 for x, y in want)

    named = [(key, (t << 32) + part(fp, t), key, fp) for key, fp in wide.items() for t in range(tables)]
    met = spark.createDataFrame([(fp, key, root, prints) for key, fp, root, prints in named], "fp bigint, key bigint, root bigint, wide array<bigint>").repartition(3)
    sent = [((fp ^ mask) * 64 + bit,) for _, fp, _, _ in named for bit, mask in enumerate(simhash.ball(1, bits))]
    sent = spark.createDataFrame(sent, "packed bigint").repartition(3, F.shiftright("packed", 6)).sortWithinPartitions("packed")
    buckets = sent.mapInArrow(lambda rows: simhash.live_buckets(rows, bits), "variant bigint, fp bigint")
    pairs = simhash._across(simhash._mixed(buckets, met), met, most, False, tables, bits).collect()
    assert len(want) > 300 and shared > 100
    assert len(pairs) == len(want) and {(r.x, r.y) for r in pairs} == want
