"""SimHash near-duplicate groups by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadloom.llm.common import batches, bounded, components, cut, fresh, sifted, spread_join, stored

SEED = 42
SORTED = 1 << 20  # variants that a task sorts, on average
SLOTS = 8  # tasks that the texts of one fingerprint are spread over
BLOCK = 1_024  # texts of a bucket that one task compares with each other or with as many others
# Odd multipliers that derive further hashes from a shingle's first one (golden-ratio multiples).
MIX = [(0x9E3779B97F4A7C15 * k | 1) & 0xFFFFFFFFFFFFFFFF for k in range(1, 17)]


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included; fewer words make one run, none makes none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only; blanks 20, 09-0D
    if not found:
        return np.empty(0, np.uint64)
    line, size = b" ".join(found), len(found)
    if size <= words:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, size)
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    ends = (starts + lengths)[words - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[: len(ends)].tolist(), ends.tolist())), np.uint64, len(ends))


def derive(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further family of 64-bit hashes; family 0 is the hashes themselves."""
    if k == 0:
        return hashes
    x = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(MIX[k])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX[0])
    return x ^ (x >> np.uint64(32))


def fingerprint(hashes: np.ndarray, families: int = 1) -> np.ndarray:
    """One fingerprint a family: a bit is 1 if it is set in over half the family's hashes; no hashes give 0."""
    count = np.zeros((families, 64), np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.stack([derive(hashes[at : at + (1 << 14)], k) for k in range(families)]).astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(families, -1, 8), axis=2, bitorder="little")
        count += bits.sum(axis=1, dtype=np.int32)
    return np.packbits(2 * count > len(hashes), axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, words: int, families: int = 1, keep: tuple[str, ...] = ("doc_id",), repeats: bool = True) -> DataFrame:
    """``keep`` and fp, an array of ``families`` 64-bit fingerprints of the whole text; a null text counts as empty.

    Without ``repeats`` each different shingle counts once.
    """
    source = bounded(docs.select(*keep, F.col("text").cast("string").alias("__text")))
    schema = source.drop("__text").schema.add("fp", T.ArrayType(T.LongType()))

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, "__text"):
            out = []
            for text in batch.column(len(keep)):
                h = shingle_hashes(text.as_py(), words)
                h = h if repeats else np.unique(h)
                out.append(fingerprint(h, families).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.list_(pa.int64()))], [*keep, "fp"])

    return source.mapInArrow(make, schema)


def ball(radius: int, bits: int = 64) -> list[int]:
    """Masks of all changes of ``radius`` bits or fewer, as signed 64-bit numbers."""
    masks = [sum(1 << b for b in which) for r in range(radius + 1) for which in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def meet(prints: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """Links (a, b) between different fingerprints that differ in ``radius`` bits or fewer, enough to connect all such pairs.

    ``prints`` has different fingerprints fp (long). Every fingerprint sends out all variants within half the radius; two within the radius share
    a variant. In the bucket of one variant the fingerprints form a chain in order; as all of them lie within
    half the (even) radius of it, every chain link is within the radius, which ``bit_count`` verifies.
    """
    half = radius // 2
    mask = F.explode(F.array(*[F.lit(m).cast("long") for m in ball(half, bits)]))
    sent = prints.select("fp", mask.alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    order = Window.partitionBy("variant").orderBy("fp")
    if radius % 2:
        raise ValueError("the radius must be even: each side sends out half of it")
    linked = sent.select(F.col("fp").alias("b"), F.lag("fp").over(order).alias("a")).where("a is not null")
    return linked.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b").distinct()


def groups(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) for every row.

    Rows with equal fingerprints collapse to one before the search, so copies are never expanded into pairs.
    Null and empty texts have fingerprint 0 and link like others. A null doc_id gets the component's smallest
    doc_id, null if all are null; repeated rows repeat. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs, words).select("doc_id", F.col("fp")[0].alias("fp")))
    unique = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(meet(unique.select("fp"), radius))
    roots = unique.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return spread_join(prints, named, "fp").select("doc_id", "fp", "component_id")  # a third of all rows may be copies


def _buckets(rows: Iterator[pa.RecordBatch], fixed: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Variants and their further columns in whole buckets, from rows sorted by variant.

    Of the bucket that goes on in the next batch only two rows of each fingerprint (the first of ``fixed`` further columns) are
    carried, or one and its summary; a bucket has no more fingerprints than a ball.
    """
    held = None
    for batch in rows:
        if not batch.num_rows:
            continue
        part = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        if held is not None:
            part = [np.concatenate(two) for two in zip(held, part)]
        start = int(np.searchsorted(part[0], part[0][-1], "left"))
        if start:
            yield part[0][:start], [c[:start] for c in part[1:]]
        held = [c[start:] for c in part]
        if len(held[0]) > 4_096:  # a hot bucket: its fingerprints repeat
            order = np.lexsort(held[1 : 1 + fixed][::-1])
            held = [c[order] for c in held]
            new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in held[1 : 1 + fixed]], axis=0)])
            held = [c[new | np.concatenate([[False], new[:-1]])] for c in held]
    if held is not None:
        yield held[0], held[1:]


def live_buckets(rows: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(variant, fp) of the buckets in which texts meet, from sorted rows (variant * 64 + bit).

    ``bit`` is the one in which the fingerprint differs from the variant, counted from 1; 0 means in none. Several texts with
    one fingerprint meet in its own bucket only.
    """
    masks = np.array([0, *(1 << k for k in range(bits))], np.int64)

    def parts():
        for batch in rows:
            packed = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(packed >> 6), pa.array(packed & 63)], ["variant", "bit"])

    for variant, (bit,) in _buckets(parts(), 1):
        fp = variant ^ masks[bit]
        first = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
        low, high, sizes = np.minimum.reduceat(fp, first), np.maximum.reduceat(fp, first), np.diff(np.append(first, len(fp)))
        live = np.repeat((low != high) | ((sizes > 1) & (low == variant[first])), sizes)
        variant, fp = variant[live], fp[live]
        order = np.lexsort((fp, variant))
        variant, fp = variant[order], fp[order]
        once = np.concatenate([[True], (variant[1:] != variant[:-1]) | (fp[1:] != fp[:-1])])[: len(fp)]
        yield pa.RecordBatch.from_arrays([pa.array(variant[once]), pa.array(fp[once])], ["variant", "fp"])


def with_facts(rows: Iterator[pa.RecordBatch], facts: int) -> Iterator[pa.RecordBatch]:
    """Buckets with the facts of their fingerprints, from rows (fp, variant, facts ...) sorted by both: first one with variant -1 and the facts, then one a bucket."""
    last = None
    for batch in rows:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if last is None else [last, batch])
        variant = table.column(1).to_numpy()
        head = np.flatnonzero(variant < 0)
        place = np.flatnonzero(variant >= 0)
        of = head[np.searchsorted(head, place, "right") - 1]
        out = [table.column(c).to_numpy()[of] for c in range(2, 2 + facts)]
        yield pa.RecordBatch.from_arrays([pa.array(variant[place]), pa.array(table.column(0).to_numpy()[place]), *map(pa.array, out)], SPANS)
        last = table.slice(int(head[-1]), 1).to_batches()[0]


SPANS, MIXED = ["variant", "fp", "low", "high", "texts"], ["fp", "slot", "variant", "blocks"]


def mixed_buckets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of buckets (SPANS, sorted by variant and fp) the fingerprints that meet another component there (MIXED).

    ``low`` and ``high`` are the least and the greatest root of the texts with that fingerprint, ``texts`` their number. Each row is given once for every slot of a fingerprint's texts. Two fingerprints share two
    buckets; only that counts in which the smaller one differs from the variant in the lower bit (or in none). Texts with one fingerprint
    meet in its own bucket. ``blocks`` is how many blocks of BLOCK texts a bucket is compared in.
    """
    for variant, (fp, low, high, texts) in _buckets(rows, 1):
        first = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1]]))
        sizes = np.diff(np.append(first, len(fp)))
        keep = (low != high) & (fp == variant)
        several = np.flatnonzero(np.minimum.reduceat(low, first) != np.maximum.reduceat(high, first))
        for at in several[sizes[several] > 1]:
            part = slice(first[at], first[at] + sizes[at])
            bit, l, h = fp[part] ^ variant[part], low[part], high[part]  # sorted by fp: row i is the smaller of (i, j > i)
            pair = np.triu(bit[:, None] < bit[None, :], 1) & ~((l[:, None] == h[None, :]) & (h[:, None] == l[None, :]))
            keep[part] |= pair.any(axis=0) | pair.any(axis=1)
        blocks = np.repeat(-(-np.add.reduceat(np.where(keep, texts, 0), first) // BLOCK), sizes)
        fp, variant, blocks = (np.repeat(c[keep], SLOTS) for c in (fp, variant, blocks))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (fp, np.arange(len(fp)) % SLOTS, variant, blocks)], MIXED)


def texts_of_buckets(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``block_links`` from rows (fp, slot, kind, variant, blocks, key, root, wide) sorted by the first three: first a fingerprint's buckets, then its texts.

    The buckets of one fingerprint are a ball at most and are held; its texts, however many, go by.
    """
    names = ["variant", "low", "high", "key", "root", "own", "wide"]
    held_fp, held = None, None  # the open fingerprint and slot, and its buckets
    for batch in rows:
        if not batch.num_rows:
            continue
        fp, slot, kind, variant, blocks, key, root = (batch.column(i).to_numpy() for i in range(7))
        ends = np.concatenate([[0], np.flatnonzero((fp[1:] != fp[:-1]) | (slot[1:] != slot[:-1])) + 1, [len(fp)]])
        of, text = [], []
        more_v, more_b = [variant], [blocks]
        base = len(variant)
        for start, stop in zip(ends[:-1].tolist(), ends[1:].tolist()):
            cut_ = start + int(np.searchsorted(kind[start:stop], 1))
            own = np.arange(start, cut_)
            if (fp[start], slot[start]) == held_fp:
                more_v.append(held[0])
                more_b.append(held[1])
                own = np.concatenate([np.arange(base, base + len(held[0])), own])
                base += len(held[0])
            if stop > cut_ and len(own):
                of.append(np.tile(own, stop - cut_))
                text.append(np.repeat(np.arange(cut_, stop), len(own)))
            last = own
        every_v, every_b = np.concatenate(more_v), np.concatenate(more_b)
        held_fp, held = (fp[-1], slot[-1]), (every_v[last], every_b[last])
        if not of:
            continue
        of, text = np.concatenate(of), np.concatenate(text)
        n = every_b[of]
        mine = (key[text].view(np.uint64) >> np.uint64(17)).astype(np.int64) % n
        of, text, mine, n = (np.repeat(c, n) for c in (of, text, mine, n))
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (text[1:] != text[:-1])])
        other = np.arange(len(of)) - np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))  # every block meets every block
        for at in range(0, len(of), 20_000):
            p = slice(at, at + 20_000)
            columns = [every_v[of[p]], np.minimum(mine[p], other[p]), np.maximum(mine[p], other[p]), key[text[p]], root[text[p]], mine[p]]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(7).take(pa.array(text[p]))], names)


def first_meeting(one: np.ndarray, two: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """The bucket in which two texts count as met, from rows of all their fingerprints: in the first table where they differ in two bits or
    fewer, the smaller fingerprint with the lower of two differing bits turned, or as it is. -1 where they meet in no table.
    """
    out, mask = np.full(len(one), -1, np.int64), np.uint64((1 << bits) - 1)
    for t in reversed(range(tables)):
        k, by = t // (64 // bits), np.uint64(bits * (t % (64 // bits)))
        a, b = (one[:, k] >> by) & mask, (two[:, k] >> by) & mask
        differ = a ^ b
        away = np.bitwise_count(differ)
        turned = np.where(away == 2, differ & (~differ + np.uint64(1)), np.uint64(0))
        out = np.where(away <= 2, (np.minimum(a, b) ^ turned).astype(np.int64) + (t << 32), out)
    return out


def block_links(rows: Iterator[pa.RecordBatch], most: int, nearest: bool, tables: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Pairs (x, y, apart) of keys of one bucket that have different roots and differ in ``most`` bits or fewer over all tables.

    Rows (variant, low, high, key, root, own, fp) are sorted by the first four. A bucket comes in pairs of blocks (low, high); in a
    pair of two blocks only rows of different blocks (``own``) meet. ``nearest`` gives for each x outside the bucket's
    largest component only the y with the fewest differing bits; else each pair is given once, in the bucket of its first meeting, however many tables and
    buckets it shares. One open pair of blocks is carried from batch to batch.
    """
    held = None

    def pairs(named, own, wide, start, stop):
        key, root, own, wide = named[start:stop, 3], named[start:stop, 4], own[start:stop], wide[start:stop]
        cross, out = named[start, 1] != named[start, 2], []
        roots, sizes = np.unique(root, return_counts=True)
        minor = np.flatnonzero(root != roots[sizes.argmax()])  # every pair of two components has one of these
        for at in range(0, len(minor), 256):
            some = minor[at : at + 256]
            fit = root[some, None] != root[None, :]
            if cross:
                fit &= own[some, None] != own[None, :]
            if not fit.any():
                continue
            i, j = np.nonzero(fit)
            away = np.zeros(len(i), np.int64)
            for k in range(wide.shape[1]):
                away += np.bitwise_count(wide[some[i], k] ^ wide[j, k])
            near = away <= most
            i, j, away = i[near], j[near], away[near]
            if nearest:
                order = np.lexsort((j, away, i))
                lead = order[np.concatenate([[True], i[order][1:] != i[order][:-1]])] if len(i) else order
                i, j, away = i[lead], j[lead], away[lead]
            else:  # where both are in ``minor`` the pair comes twice
                once = (key[some[i]] < key[j]) | (root[j] == roots[sizes.argmax()])
                i, j, away = i[once], j[once], away[once]
                here = first_meeting(wide[some[i]], wide[j], tables, bits) == named[start, 0]
                i, j, away = i[here], j[here], away[here]
            x, y = key[some[i]], key[j]
            out.append((x, y, away))
        return out

    def blocks(named, own, wide, ends):
        found = [p for start, stop in zip(ends[:-1], ends[1:]) if stop - start > 1 for p in pairs(named, own, wide, start, stop)]
        columns = (pa.array(np.concatenate([np.empty(0, np.int64), *(p[i] for p in found)])) for i in range(3))
        return pa.RecordBatch.from_arrays(list(columns), ["x", "y", "apart"])

    for batch in rows:
        if not batch.num_rows:
            continue
        named = np.stack([batch.column(i).to_numpy() for i in range(5)], axis=1)
        own = batch.column(5).to_numpy()
        wide = batch.column(6).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)  # bitwise_count takes signed numbers without sign
        if held is not None:
            named, own, wide = (np.concatenate(two) for two in zip(held, (named, own, wide)))
        ends = np.concatenate([[0], np.flatnonzero((named[1:, :3] != named[:-1, :3]).any(axis=1)) + 1])
        yield blocks(named, own, wide, ends)
        held = (named[ends[-1] :], own[ends[-1] :], wide[ends[-1] :])
    if held is not None:
        yield blocks(*held, [0, len(held[0])])


def jaccard(rows: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """x, y and the exact Jaccard similarity of the shingle sets of two texts."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("similarity", pa.float64())])
    for batch in rows:
        last, sets, out = None, {}, []
        for x, y, one, two in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if x != last:
                last, sets = x, {x: np.unique(shingle_hashes(one, words))}
            a, b = sets[x], np.unique(shingle_hashes(two, words))
            both = len(np.intersect1d(a, b, assume_unique=True))
            every = len(a) + len(b) - both
            out.append(both / every if every else 1.0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], schema=schema)


def similar(docs: DataFrame, words: int = 5, least: float = 0.8, tables: int = 20, bits: int = 32, slack: float = 0.12) -> DataFrame:
    """Groups of rows whose sets of word shingles are similar: doc_id, key and component_id for every row.

    Each different text (A-Z lower-cased, blanks folded) gets ``tables`` fingerprints of ``bits`` bits (32 or
    fewer) from independent hash families. In each table a fingerprint sends out all variants within one bit, so
    two within two bits share a bucket. Every pair of texts of a bucket that passes a loose bound on
    the Hamming distance over all tables together (``slack`` below ``least``) counts if the exact Jaccard
    similarity of the shingle sets is ``least`` or more. Pairs of texts that are linked already change nothing, so
    links are made in three steps: some pairs of texts with one fingerprint, then each text's nearest text of another component
    in each bucket where its own is not the largest, then all pairs that still lie in different components.

    By the angle between two sets of equal size, two texts meet in one of 20 tables with probability 0.92 at
    similarity 0.8, 0.99 at 0.85 and 0.9999 at 0.9.

    component_id is the smallest doc_id reachable. Null texts count as empty and equal each other; a null
    doc_id takes the component's; repeated rows repeat; an empty table gives no rows. ``key`` stands for the text,
    ``root`` for the group.
    """
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("key", text_key())
    per = 64 // bits
    families = (tables + per - 1) // per
    members, _, _ = stored(fingerprints(keyed, words, families, ("doc_id", "key"), repeats=False))
    wide, different, _ = stored(members.groupBy("key").agg(F.min("fp").alias("fp")))  # equal keys have equal fingerprints
    table_bits = [F.shiftrightunsigned(F.col("fp")[k // per], bits * (k % per)).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(tables)]
    short = wide.select("key", F.posexplode(F.array(*table_bits)).alias("t", "fp")).select("key", (F.col("t").cast("long") * (1 << 32) + F.col("fp")).alias("fp"))
    bit = F.posexplode(F.array(*[F.lit(m).cast("long") for m in ball(1, bits)])).alias("bit", "mask")
    sent = short.select("fp", bit).select((F.col("fp").bitwiseXOR(F.col("mask")) * 64 + F.col("bit")).alias("packed"))  # one number a variant, as there are many
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-different * tables * (bits + 1) // SORTED))
    buckets = sent.repartition(parts, F.shiftright("packed", 6)).sortWithinPartitions("packed").mapInArrow(lambda part: live_buckets(part, bits), "variant bigint, fp bigint")
    buckets, n, _ = stored(buckets)
    roots = wide.limit(0).select(F.col("key").alias("node"), F.col("key").alias("root"))
    if n:
        mine, _, _ = stored(short.join(buckets.select("fp").distinct(), "fp", "left_semi").select("fp", "key"))
        wide, _, _ = stored(wide.join(mine.select("key").distinct(), "key", "left_semi"))
        # the share of differing bits is the angle over pi; the cosine of two sets of equal size with similarity s is 2s/(1+s)
        low = max(least - slack, 0.0)
        most = int(np.arccos(2 * low / (1 + low)) / np.pi * 64 * families)
        links = None
        for step in ("twins", "nearest", "all"):
            if step == "twins":
                pairs = _twins(mine)
            else:
                named = mine.join(roots.withColumnRenamed("node", "key"), "key", "left").select("fp", "key", F.coalesce("root", "key").alias("root"))
                mixed, n, _ = stored(_mixed(buckets, named))
                if not n:
                    break
                # all fingerprints of a text are needed only where one of them is in a mixed bucket
                met = named.join(mixed.select("fp").distinct(), "fp", "left_semi").join(wide.withColumnRenamed("fp", "wide"), "key")
                pairs = _across(mixed, met, most, step == "nearest", tables, bits)
            pairs, n, _ = stored(pairs)
            if n:
                used = pairs.select(F.col("x").alias("key")).unionAll(pairs.select(F.col("y").alias("key"))).distinct()
                asked, _ = sifted(keyed, "key", used, 2 * n)  # else all texts would be shuffled for the few that are asked for
                texts, _, _ = stored(asked.join(used, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text")))
                good = _verified(pairs, texts, words, least)
                links, _, _ = stored(good if links is None else links.unionAll(good))
                roots = components(links)
    # a text in no group is its own root; texts without links need no join
    facts = members.select("key").distinct().join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"))
    named = spread_join(members.select("doc_id", "key"), facts, "key").select("doc_id", "key", "root")
    return spread_join(named, named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "key", "component_id", "root")


def _twins(mine: DataFrame) -> DataFrame:
    """Some pairs (x, y) of texts with one fingerprint: each with the one before it and the first.

    Rows are dealt by ranges of fingerprint and key, so that a hot fingerprint is spread over tasks.
    """

    def chain(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # fingerprint, its first key and the last one
        for batch in rows:
            if not batch.num_rows:
                continue
            fp, key = (batch.column(i).to_numpy() for i in range(2))
            new = np.concatenate([[last is None or fp[0] != last[0]], fp[1:] != fp[:-1]])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(fp)), -1))
            first = np.where(lead < 0, key[0] if last is None else last[1], key[np.maximum(lead, 0)])
            before = np.concatenate([[key[0] if last is None else last[2]], key[:-1]])
            y, x = np.concatenate([key[~new], key[~new]]), np.concatenate([first[~new], before[~new]])
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["x", "y"])
            last = (fp[-1], first[-1], key[-1])

    return mine.repartitionByRange("fp", "key").sortWithinPartitions("fp", "key").mapInArrow(chain, "x bigint, y bigint").distinct()


def _mixed(buckets: DataFrame, named: DataFrame) -> DataFrame:
    """MIXED rows of the buckets (variant, fp) in which texts (fp, key, root, ...) of two components or more meet."""
    span = named.groupBy("fp").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("texts")).withColumn("variant", F.lit(-1).cast("long"))
    both = span.unionByName(buckets.select("fp", "variant", *[F.lit(0).cast("long").alias(c) for c in SPANS[2:]]))
    kinds = lambda names: ", ".join(f"{c} bigint" for c in names)
    met = both.select("fp", "variant", *SPANS[2:]).repartition("fp").sortWithinPartitions("fp", "variant").mapInArrow(lambda rows: with_facts(rows, 3), kinds(SPANS))
    return met.repartition("variant").sortWithinPartitions("variant", "fp").mapInArrow(mixed_buckets, kinds(MIXED))


def _across(mixed: DataFrame, named: DataFrame, most: int, nearest: bool, tables: int, bits: int) -> DataFrame:
    """Pairs (x, y) within ``most`` bits that share a bucket and lie in different components: all, or nearest ones.

    The texts of a fingerprint, in SLOTS slots so that a hot one is spread over tasks, go to all its mixed buckets in one pass over both. Buckets of more than BLOCK texts are cut into blocks, and
    every pair of blocks is compared by itself; pairs over the bound never leave a task.
    """
    none, zero = F.lit(None).cast("array<bigint>"), F.lit(0).cast("long")
    held = mixed.select("fp", "slot", zero.alias("kind"), "variant", "blocks", zero.alias("key"), zero.alias("root"), none.alias("wide"))
    texts = named.select("fp", F.pmod(F.xxhash64("key"), F.lit(SLOTS)).cast("long").alias("slot"), F.lit(1).cast("long").alias("kind"), zero.alias("variant"), zero.alias("blocks"), "key", "root", "wide")
    both = held.unionByName(texts).repartition("fp", "slot").sortWithinPartitions("fp", "slot", "kind")
    rows = both.mapInArrow(texts_of_buckets, "variant bigint, low bigint, high bigint, key bigint, root bigint, own bigint, wide array<bigint>")
    rows = rows.repartition("variant", "low", "high").sortWithinPartitions("variant", "low", "high", "key")
    pairs = rows.mapInArrow(lambda part: block_links(part, most, nearest, tables, bits), "x bigint, y bigint, apart bigint")
    if nearest:
        pairs = pairs.groupBy("x").agg(F.min(F.struct("apart", "y")).alias("to")).select("x", F.col("to.y").alias("y"))
    once = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return once.distinct() if nearest else once


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float, slot: int = 256) -> DataFrame:
    """The pairs (x, y) whose texts are similar. The partners of one x are dealt in slots, so that a hub is spread over tasks."""
    many = pairs.groupBy("x").agg(F.ceil(F.count("*") / slot).cast("long").alias("slots"))
    dealt = pairs.join(many, "x").select("x", "y", F.pmod(F.xxhash64("y"), F.col("slots")).alias("slot"))
    ones = many.join(texts.select(F.col("key").alias("x"), F.col("text").alias("tx")), "x").select("x", "tx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"))
    sized = dealt.join(texts.select(F.col("key").alias("y"), F.col("text").alias("ty")), "y").join(ones, ["x", "slot"]).select("x", "y", "tx", "ty")
    return bounded(sized).mapInArrow(lambda rows: jaccard(batches(rows, "ty"), words), "x bigint, y bigint, similarity double").where(F.col("similarity") >= least).select("x", "y")


def keep_first(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group that ``similar`` finds: the one with the smallest doc_id.

    Of rows with equal ids in one group the one with the least key of its text stays, and of repeated rows with equal id and
    key the least. A group in which no row has a doc_id keeps one row. Columns and their order stay.
    """
    found = similar(docs, words, least)
    each, _, _ = stored(found.groupBy("doc_id", "key", "root").agg(F.count("*").alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = each.groupBy("root").agg(F.min(order).alias("first"))
    judged = spread_join(each, first, "root").select("doc_id", "key", F.when(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")), F.col("n")).otherwise(F.lit(0)).alias("n"))
    own, other, key, n = fresh(docs, "own_key", "other_id", "other_key", "n_rows")
    judged, several, _ = stored(judged.where("n <> 1").select(F.col("doc_id").alias(other), F.col("key").alias(key), F.col("n").alias(n)))
    met, rest = sifted(docs.withColumn(own, text_key()), own, judged.select(key), several)  # most texts are not judged and need no shuffle
    same = F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(own) == F.col(key))
    alone = met.join(judged, same, "left_anti").select(*docs.columns)
    repeated = met.join(judged.where(F.col(n) > 1), same, "left_semi").groupBy("doc_id", own).agg(F.min(F.struct(*docs.columns)).alias(n)).select(f"{n}.*")
    return rest.select(*docs.columns).unionByName(alone).unionByName(repeated)


def text_key() -> Column:
    """Hash of the text with A-Z lower-cased and blanks folded."""
    norm = F.trim(F.regexp_replace(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))
    return F.xxhash64(norm, F.lit(1))
