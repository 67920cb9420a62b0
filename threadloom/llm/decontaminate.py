"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

import string
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import batches, fresh, with_text, word_codes

WORDS = 5  # words in a shingle
RADIUS = 19  # bits within which every pair of fingerprints is found; at similarity 0.8 ten differ, with a standard deviation of three
BLOCKS = 4  # of 16 bits: a pair within RADIUS agrees to RADIUS // BLOCKS bits in one of them
RATIO = 1.06  # neighbouring window sizes
ITEMS = 20_000  # items that one pass over the documents holds
PAIRS = 1 << 20  # of windows and items that are compared at once
MARKS = string.punctuation + "«»‹›“”„‘’‚…–—¿¡·•"  # what is cut from the ends of a word

SPACES = r"[\t\v\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"  # white space besides blank and line feed

_items: dict = {}  # the last items a worker has made tables of


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, cut at any white space, without case and outer marks, and offsets by text; bare marks are no words."""
    codes, words, offsets = word_codes(pc.replace_substring_regex(pc.fill_null(texts, ""), SPACES, " "))
    plain = pc.utf8_lower(pc.utf8_trim(words, characters=MARKS))
    hashed = pd.util.hash_array(plain.to_numpy(zero_copy_only=False), categorize=False)
    hashed[pc.equal(plain, "").to_numpy(zero_copy_only=False)] = 0
    flat = hashed[codes] if len(codes) else np.empty(0, np.uint64)
    keep = flat != 0
    before = np.concatenate([[0], np.cumsum(keep)])
    return flat[keep], before[offsets]


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash for each run of WORDS words of one text; a shorter text is one run, none has none."""
    n = min(WORDS, len(words))
    if not n:
        return words
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        x = words[j : j + len(out)]
        out = out * np.uint64(0x100000001B3) ^ (x * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7)) ^ x
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def bit_sums(hashes: np.ndarray, largest: int) -> np.ndarray:
    """Running counts of each bit; they wrap around, but differences over ``largest`` shingles or fewer stay exact."""
    kind = np.min_scalar_type(largest)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    out = np.zeros((len(hashes) + 1, 64), kind)
    np.cumsum(bits, axis=0, out=out[1:], dtype=kind)
    return out


def prints(after: np.ndarray, before: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    """SimHash of windows from the running counts at their ends: a bit is 1 if it is set in over half of ``sizes``."""
    half = np.asarray(sizes) // 2
    above = np.subtract(after, before, order="C") > (half.astype(after.dtype) if half.ndim == 0 else half[:, None].astype(after.dtype))
    return np.packbits(above.reshape(-1), bitorder="little").view("<u8")


def slack(size):
    """Places on either side of a window at which an item of ``size`` shingles is verified too."""
    return np.maximum(2, size // 12)


class Items:
    """Items by window size, with tables of the 16-bit blocks near each fingerprint."""

    def __init__(self, rows: list[tuple[int, str]]):
        flat, cuts = word_hashes(pa.array([t for _, t in rows], pa.string()))
        self.ids, self.shingles, by_class = [], [], defaultdict(list)
        for (item, _), a, b in zip(rows, cuts[:-1], cuts[1:]):
            h = shingles(flat[a:b])
            if len(h):
                step = round(np.log(len(h)) / np.log(RATIO))
                by_class[max(1, round(RATIO**step))].append(len(self.ids))
                self.ids.append(item)
                self.shingles.append(h)
        self.counts = [Counter(h.tolist()) for h in self.shingles]
        self.known = np.zeros(1 << 22, bool)  # by the top bits of a shingle: whether any item may have it
        for h in self.shingles:
            self.known[h >> np.uint64(42)] = True
        near = [m for r in range(RADIUS // BLOCKS + 1) for m in (sum(1 << b for b in c) for c in combinations(range(16), r))]
        near = np.array(near, np.uint16)
        self.classes = []
        for size, members in sorted(by_class.items()):
            own = np.concatenate([prints(s[-1:], s[:1], len(s) - 1) for s in (bit_sums(self.shingles[m], len(self.shingles[m])) for m in members)])
            tables = []
            for b in range(BLOCKS):
                table = np.zeros(1 << 16, bool)
                part = (own >> np.uint64(16 * b)).astype(np.uint16)
                table[(part[:, None] ^ near[None, :]).ravel()] = True
                tables.append(table)
            self.classes.append((size, max(1, size // 24), np.array(members), own, tables))

    def candidates(self, hashes: np.ndarray, cuts: np.ndarray, least: float) -> Iterator[tuple[int, int, int]]:
        """(text, shingle position in it, item) of windows within RADIUS bits of an item of their size.

        ``hashes`` are the shingles of many texts in a row, cut at ``cuts``. Besides the regular places a text's
        first and last window are looked at, and the whole text where it is up to a quarter shorter than the items. Places around which too few shingles are
        in any item for a similarity of ``least`` are left out before fingerprints are made; no place that ``verify`` could find is among them.
        """
        largest = max((c[0] for c in self.classes), default=0)
        text_of, lengths = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), np.diff(cuts)
        span = max(30_000, 4 * largest)
        known = np.concatenate([[0], np.cumsum(self.known[hashes >> np.uint64(42)])])
        totals = np.array([len(h) for h in self.shingles], np.int64)

        def enough(place, text, total, most):
            """Whether the shingles around each place allow the similarity, for items of ``total`` shingles, searched as far as for ``most``."""
            around, size_here = slack(most), np.minimum(most, lengths[text])
            have = known[np.minimum(cuts[text + 1], place + around + size_here)] - known[np.maximum(cuts[text], place - around)]
            return have >= least * (total + np.minimum(total, lengths[text])) / (1 + least) - 1e-6

        for low in range(0, len(hashes), span):
            part = hashes[low : low + span + largest]
            here = text_of[low : low + len(part)]
            if known[low + len(part)] == known[low]:
                continue
            inside = np.flatnonzero((cuts[:-1] < low + span) & (cuts[1:] > low) & (lengths > 0))
            todo, used = [], np.zeros(len(part) + 1, np.int32)
            for size, stride, members, own, tables in self.classes:
                grid = np.arange(0, max(min(span, len(part) - size + 1), 0), stride)
                grid = grid[here[::stride][: len(grid)] == here[size - 1 :: stride][: len(grid)]]
                long, short = inside[lengths[inside] >= size], inside[(lengths[inside] < size) & (4 * lengths[inside] >= 3 * size)]
                edge = np.concatenate([cuts[long] - low, cuts[long + 1] - size - low])
                edge = edge[(edge >= 0) & (edge < span) & (edge + size <= len(part))]
                short = short[cuts[short] >= low]
                starts = np.concatenate([grid, edge, cuts[short] - low])
                sizes = np.concatenate([np.full(len(grid) + len(edge), size), lengths[short]])
                fit = enough(starts + low, here[starts], totals[members].min(), totals[members].max())
                starts, sizes = starts[fit], sizes[fit]
                if len(starts):
                    todo.append((starts, sizes, members, own, tables))
                    np.add.at(used, starts, 1)
                    np.add.at(used, starts + sizes, -1)
            if not todo:
                continue
            # running counts over the shingles of these windows only; a window stays in one piece
            used = np.cumsum(used[:-1]) > 0
            place_of = np.concatenate([[0], np.cumsum(used)])
            sums = bit_sums(part[used], 2 * largest)
            for starts, sizes, members, own, tables in todo:
                first = place_of[starts]
                got = prints(sums[first + sizes], sums[first], sizes)
                halves, hit = got.view(np.uint16).reshape(-1, BLOCKS), np.zeros(len(got), bool)
                for b, table in enumerate(tables):
                    hit |= table[halves[:, b]]
                at = np.flatnonzero(hit)
                step = max(1, min(4096, PAIRS // len(own)))
                for k in range(0, len(at), step):
                    some = at[k : k + step]
                    i, j = np.nonzero(np.bitwise_count(got[some][:, None] ^ own[None, :]) <= RADIUS)
                    place = starts[some[i]] + low
                    text, total = text_of[place], totals[members[j]]
                    fit = enough(place, text, total, total)
                    place, text, j = place[fit], text[fit], j[fit]
                    yield from zip(text.tolist(), (place - cuts[text]).tolist(), members[j].tolist())

    def verify(self, hashes: np.ndarray, at: int, item: int, around: int) -> tuple[float, int]:
        """Best weighted similarity (sum of least over sum of greatest counts) of the item-sized windows around ``at``."""
        size, want = min(len(self.shingles[item]), len(hashes)), self.counts[item]
        total, best = len(self.shingles[item]), (0.0, at)
        for start in range(max(0, at - around), min(len(hashes) - size, at + around) + 1):
            have = Counter(hashes[start : start + size].tolist())
            both = sum(min(n, want[h]) for h, n in have.items() if h in want)
            best = max(best, (both / (total + size - both), -start))
        return best[0], abs(best[1])


def mark(docs: DataFrame, items: DataFrame, least: float = 0.8, keep: list[str] | None = None, name: str = "matches") -> DataFrame:
    """``keep`` columns of ``docs`` (all, if none are named) and ``name``: item_id, start, words and similarity of each leaked item.

    Documents and items are read as words without case and outer marks. Running bit counts give the SimHash
    of windows of every item size, one every 1/24 of it; windows within RADIUS bits of an item of their
    size are found through blocks of 16 bits, all of them, and verified by the exact weighted similarity of
    five-word shingles, ``least`` or more, at the best place nearby. Only the best place of an item in a document is
    kept. Items go to the tasks in blocks of ITEMS, one pass over the documents each.

    Null texts have no matches, items without words match nothing, items of fewer than five words are one
    shingle; a null item_id is kept as null; repeated items and rows each give their matches.
    """
    keep = docs.columns if keep is None else keep
    spark, (part_name,) = docs.sparkSession, fresh(docs, "found_in_block_")
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    blocks = max(1, -(-rows.count() // ITEMS))
    kind = T.ArrayType(T.StructType().add("item_id", "long").add("start", "integer").add("words", "integer").add("similarity", "double"))
    out, text = with_text(docs, keep)
    for block in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()  # about ITEMS rows
        shared = spark.sparkContext.broadcast([tuple(r) for r in sorted(some, key=lambda r: (r[0] is None, r[0], r[1]))])
        column = f"{part_name}{block}"

        key = uuid.uuid4().hex

        def run(found: Iterator[pa.RecordBatch], shared=shared, column=column, key=key) -> Iterator[pa.RecordBatch]:
            if key not in _items:  # once a worker, not once a task
                _items.clear()
                _items[key] = Items(shared.value)
            index = _items[key]
            for batch in found:
                for part in batches(iter([batch]), text, 1 << 20):
                    flat, cuts = word_hashes(part.column(part.schema.get_field_index(text)))
                    own = [shingles(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                    ends = np.concatenate([[0], np.cumsum([len(h) for h in own])]).astype(np.int64)
                    best: list[dict] = [{} for _ in own]
                    for t, at, item in index.candidates(np.concatenate([*own, np.empty(0, np.uint64)]), ends, least):
                        if best[t].get(item, (0.0,))[0] < 1.0:
                            got = index.verify(own[t], at, item, int(slack(len(index.shingles[item]))))
                            if got[0] >= least and got[0] > best[t].get(item, (0.0,))[0]:
                                best[t][item] = got
                    result = [[{"item_id": index.ids[i], "start": s, "words": len(index.shingles[i]) + WORDS - 1, "similarity": x} for i, (x, s) in sorted(b.items())] for b in best]
                    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("similarity", pa.float64())]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(result, arrow)], [*part.schema.names, column])

        out = out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(column, kind)]))
    return out.select(*keep, F.concat(*[F.col(f"{part_name}{b}") for b in range(blocks)]).alias(name))
