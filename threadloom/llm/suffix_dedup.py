"""Removal of repeated substrings: per-shard suffix arrays, Kasai common prefixes, merging by binary search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import batches, cut, stored

GRAM = 16  # bytes of the grams whose least hash stands for a window
SHARD = 1 << 20  # bytes of context in a shard
LONGEST = 1_024  # windows in a context
FILTER = 28  # a filter of names has 2 ** FILTER bits at most, 32 MB
HOT = 16_384  # different contexts of one name above which its windows are dealt one by one
SETTLED, CONTEXT, WINDOWS = 0, 1, 2  # what has become of a run: removed, to be looked at, to be looked at window by window
_A = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of an odd number and of its inverse, grown as texts need them


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of GRAM (a power of two) bytes, by doubling."""
    h, size = data.astype(np.uint64) * np.uint64(_A) + np.uint64(0x632BE59BD9B4E019), 1
    while size < GRAM:
        h = h[:-size] * np.uint64(pow(_A | 1, size, 1 << 64)) + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_keys(h: np.ndarray, length: int) -> np.ndarray:
    """For each window of ``length`` bytes the least of the hashes ``h`` of its grams; equal windows have equal keys."""
    width, size = length - GRAM + 1, 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


def range_hashes(h: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """A hash of the bytes under ``counts`` windows from ``starts`` on, from the gram hashes ``h``: their sum weighted by place."""
    if len(_powers[0]) <= len(h):
        n, odd = 2 * len(h), 0xD1342543DE82EF95
        _powers[:] = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(n, x, np.uint64))) for x in (odd, pow(odd, -1, 1 << 64))]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers[0][: len(h)])])
    out = (sums[starts + counts + length - GRAM] - sums[starts]) * _powers[1][starts]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def window_runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of 48 bits, starts, numbers of windows and hashes of the runs of neighbouring windows with one key, LONGEST windows at most each."""
    if len(data) < length:
        none = np.empty(0, np.int64)
        return none, none, none, none
    h = gram_hashes(data)
    keys = window_keys(h, length) >> np.uint64(16)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(starts, len(keys)))
    if counts.max() > LONGEST:
        pieces = -(-counts // LONGEST)
        at = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, counts = np.repeat(starts, pieces) + at * LONGEST, np.minimum(np.repeat(counts, pieces) - at * LONGEST, LONGEST)
    return keys[starts].view(np.int64), starts, counts, range_hashes(h, starts, counts, length).view(np.int64)


def names_of(rows: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The different keys of each batch of texts, twice each, plus one if two texts of the batch have the key."""
    for batch in batches(rows):
        own = [np.unique(window_runs(_bytes(t), length)[0]) for t in batch.column(0)]
        keys, texts = np.unique(np.concatenate([np.empty(0, np.int64), *own]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(2 * keys + (texts > 1))], ["packed"])


def names_of_several(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys that occur twice or are marked, from sorted rows of ``names_of``."""
    last, open_ = -1, False  # the open key, and whether it has been given out
    for batch in rows:
        packed = batch.column(0).to_numpy()
        if not len(packed):
            continue
        key = packed >> 1
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = (np.diff(np.append(first, len(key))) > 1) | (np.maximum.reduceat(packed & 1, first) == 1)
        if key[0] == last:
            several[0], given = not open_, open_
            open_ = True
        else:
            given = False
        yield pa.RecordBatch.from_arrays([pa.array(key[first[several]])], ["key"])
        if len(first) > 1 or key[0] != last:
            open_ = bool(several[-1])
        last = int(key[-1])


def filter_of(keys: DataFrame, count: int) -> np.ndarray:
    """A bitmap over the low bits of the keys, sixteen bits a key as far as 2 ** FILTER bits allow."""
    bits = min(max(16 * count, 1 << 16).bit_length(), FILTER)
    at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    found = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in found.toLocalIterator():  # 2 ** FILTER / 8 bytes at most, in pieces of 4 KB
        part = np.frombuffer(r["bits"], np.uint8)
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = part
    return out


def in_filter(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & (8 * len(filter_) - 1)
    return (filter_[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def repeats_of(same: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Of rows that agree in all of ``same``, those of a document above the least one."""
    order = np.lexsort([doc, *same[::-1]])
    new = np.concatenate([[True], np.any([c[order][1:] != c[order][:-1] for c in same], axis=0)])[: len(order)]
    least = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else doc
    out = np.empty(len(order), bool)
    out[order] = doc[order] > least
    return out


def united(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans in order of row and start with those that touch made one; ends must not fall within a row."""
    if not len(row):
        return row, start, end
    lead = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > end[:-1])]))
    return row[lead], start[lead], end[np.append(lead[1:], len(row)) - 1]


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of ``symbols`` (0 to 256) and the keys of seven symbols at each place, by Larsson-Sadakane refinement.

    Suffixes are first sorted by seven symbols. Then each unsorted group is sorted by the rank of what follows
    its sorted prefix, which doubles that prefix; groups of one are never touched again.
    """
    n, depth = len(symbols), 7
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key = (key << 9) | padded[j : j + n]
    sa = np.argsort(key)
    changed = np.concatenate([[True], key[sa[1:]] != key[sa[:-1]]])
    head = np.maximum.accumulate(np.where(changed, np.arange(n), 0))  # number of a group: its first place
    rank = np.empty(n + 1, np.int64)
    rank[sa], rank[n] = head, -1
    open_ = np.flatnonzero(~(changed & np.append(changed[1:], True)))
    while len(open_):
        some = sa[open_]
        pair = (rank[some] << 32) | (rank[np.minimum(some + depth, n)] + 1)
        order = np.argsort(pair, kind="stable")
        some, pair = some[order], pair[order]
        sa[open_] = some  # groups keep their places, as their number leads the key
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        head = np.maximum.accumulate(np.where(fresh, open_, 0))
        rank[some] = head
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        depth *= 2
        if depth > 2 * n:
            break
    return sa, key


def kasai(symbols: np.ndarray, sa: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Common prefix of each sorted suffix with the one before it.

    Kasai's rule: if a suffix and its forerunner are preceded by the same symbol, their common prefix is that
    of the suffix one place to the left less one. So only places where those symbols differ are compared, seven
    symbols at a time, all at once; the others are filled in from the left.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    own = (place == 0) | (before <= 0)
    rest = np.flatnonzero(~own)
    own[rest] = symbols[rest - 1] != symbols[before[rest] - 1]
    own[1:] |= before[:-1] < 0
    at = np.flatnonzero(own & (before >= 0))
    length = np.zeros(n, np.int64)
    live, done = at, np.zeros(len(at), np.int64)
    other = before[at]
    which = np.arange(len(at))
    while len(live):
        a, b = live + done[which], other[which] + done[which]
        inside = (a < n) & (b < n)
        same = np.zeros(len(live), bool)
        same[inside] = key[a[inside]] == key[b[inside]]
        stop = which[~same]
        if len(stop):  # the first difference among the last seven
            x, y = at[stop] + done[stop], other[stop] + done[stop]
            going = np.ones(len(stop), bool)
            for j in range(7):
                ok = going & (x + j < n) & (y + j < n)
                hit = np.zeros(len(stop), bool)
                hit[ok] = symbols[x[ok] + j] == symbols[y[ok] + j]
                going = hit
                done[stop] += going
        live, which = live[same], which[same]
        done[which] += 7
    length[at] = done
    last = np.maximum.accumulate(np.where(own, place, 0))
    return np.where(before >= 0, length[last] + last - place, 0)[sa]


class Shard:
    """Contexts of one or more keys, their suffix array, and the classes of equal windows in it."""

    def __init__(self, length: int):
        self.length, self.size = length, 0
        self.texts: list[bytes] = []
        self.docs: list[int] = []
        self.tags: list[tuple] = []

    def add(self, text: bytes, doc: int, tag: tuple) -> None:
        self.texts.append(text)
        self.docs.append(doc)
        self.tags.append(tag)
        self.size += len(text)

    def solve(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows in sorted order: place in the joined text, context, class, and the least document of the class."""
        joined = b"".join(t + b"\0" for t in self.texts)
        sizes = np.array([len(t) + 1 for t in self.texts], np.int64)
        symbols = np.frombuffer(joined, np.uint8).astype(np.int16) + 1
        ends = np.cumsum(sizes)
        symbols[ends - 1] = 0
        sa, key = suffix_array(symbols)
        common = kasai(symbols, sa, key)
        context = np.repeat(np.arange(len(sizes)), sizes)
        whole = ends[context] - 1 - np.arange(len(symbols)) >= self.length
        new = common < self.length
        class_ = np.cumsum(new) - 1
        keep = whole[sa]
        place, class_ = sa[keep], class_[keep]
        docs = np.array(self.docs, np.int64)[context[place]]
        least = np.full((class_.max() + 1) if len(class_) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, class_, docs)
        self.joined, self.ends, self.sizes = joined, ends, sizes
        return place, context[place], class_, least[class_]


def mark_shards(rows: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans (doc, tag, start, end) of windows that also start in a smaller document, from contexts sorted by key and document.

    Rows are (key, doc, tag, start, windows, context); those with a key below 0 are settled and only passed on. A context seen before under its key with a smaller document is marked whole and takes no further part. The
    others fill shards of about SHARD bytes. A key whose contexts go on in the next shard leaves its
    sorted windows with their least documents; the next shard's windows are searched in them by bisection. As
    documents come in order, an earlier shard never needs a later one.
    """
    schema = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    shard, key, seen = Shard(length), None, {}
    grams, least_of = np.empty(0, f"S{length + 1}"), np.empty(0, np.int64)
    cols: list[list[int]] = [[], [], [], []]

    def out(doc, tag, start, end):
        for c, v in zip(cols, (doc, tag, start, end)):
            c.append(v)

    def close(goes_on: bool):
        nonlocal shard, grams, least_of
        if shard.texts:
            place, context, class_, least = shard.solve()
            docs = np.array(shard.docs, np.int64)
            carried = np.array([t[0] == carried_key for t in shard.tags])
            if len(grams) and carried.any():
                at = np.flatnonzero(carried[context])
                own = windows(shard.joined, place[at], length)
                found = np.searchsorted(grams, own)
                hit = (found < len(grams)) & (grams[np.minimum(found, len(grams) - 1)] == own)
                least[at[hit]] = np.minimum(least[at[hit]], least_of[found[hit]])
            if goes_on:
                mine = np.array([t[0] == key for t in shard.tags])[context]
                first = np.flatnonzero(mine)
                own = windows(shard.joined, place[first], length)
                if carried_key != key:
                    grams, least_of = own[:0], least[:0]
                every, docs_of = np.concatenate([grams, own]), np.concatenate([least_of, least[first]])
                order = np.lexsort((docs_of, every))
                every, docs_of = every[order], docs_of[order]
                lead = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.empty(0, bool)
                grams, least_of = every[lead], docs_of[lead]
            marked = np.sort(place[least < docs[context]])
            if len(marked):
                where = np.searchsorted(shard.ends, marked, "right")
                lead = np.flatnonzero(np.concatenate([[True], (marked[1:] != marked[:-1] + 1) | (where[1:] != where[:-1])]))
                tail = np.append(lead[1:], len(marked)) - 1
                begin = (shard.ends - shard.sizes)[where[lead]]
                for c, a, b in zip(where[lead].tolist(), (marked[lead] - begin).tolist(), (marked[tail] - begin + length).tolist()):
                    _, tag, start = shard.tags[c]
                    out(shard.docs[c], tag, start + a, start + b)
        shard = Shard(length)
        if not goes_on:
            grams, least_of = grams[:0], least_of[:0]

    carried_key = None
    for batch in rows:
        for k, doc, tag, start, count, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if k < 0:
                out(doc, tag, start, start + count + length - 1)
                continue
            if k != key:
                if shard.size >= SHARD:
                    close(False)
                    carried_key = None
                key, seen = k, {}
            elif shard.size >= SHARD:
                close(True)
                carried_key = key
            first = seen.setdefault(text, doc)
            if first < doc:
                out(doc, tag, start, start + len(text))
            else:
                shard.add(text, doc, (k, tag, start))
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)
            cols = [[], [], [], []]
    close(False)
    if cols[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)


def windows(joined: bytes, places: np.ndarray, length: int) -> np.ndarray:
    """The windows at ``places`` as strings that end in a non-zero byte, so that zero bytes keep their length."""
    data = np.frombuffer(joined, np.uint8)
    rows = np.empty((len(places), length + 1), np.uint8)
    rows[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[places]
    rows[:, length] = 1
    return rows.view(f"S{length + 1}").reshape(-1)


def settle(rows: Iterator[pa.RecordBatch], most: int = HOT) -> Iterator[pa.RecordBatch]:
    """What becomes of each run (key, hash, doc, tag, start, windows), from runs sorted by key, hash and document.

    Runs with equal hashes have equal bytes: above their least document they are removed whole, SETTLED. Where a key has
    two different contexts or more, those of the least documents may share single windows: they are CONTEXT, or
    WINDOWS if the key has more than ``most`` of them. All others match nothing and are left out. Of a key that goes
    on over batches at most ``most`` rows, and those of one batch, are held back.
    """
    names = ["doc", "tag", "start", "windows", "key", "kind"]
    hash_, least, several, hot, held = None, 0, False, False, []

    def emit(table, kind):
        kinds = pa.array(np.full(table.num_rows, kind, np.int8))
        return [pa.RecordBatch.from_arrays([*(b.column(i) for i in (2, 3, 4, 5, 0)), kinds.slice(0, b.num_rows)], names) for b in table.to_batches()]

    def done():
        kept = pa.concat_tables(held) if held and (several or hot) else None
        return emit(kept, WINDOWS if hot else CONTEXT) if kept is not None else []

    open_key = None
    for batch in rows:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        key, own, doc = (batch.column(i).to_numpy() for i in range(3))
        passed = key < 0
        new_key = np.concatenate([[key[0] != open_key], key[1:] != key[:-1]])
        new_hash = new_key | np.concatenate([[own[0] != hash_], own[1:] != own[:-1]])
        first = np.maximum.accumulate(np.where(new_hash, np.arange(len(doc)), -1))
        floor = np.where(first < 0, least, doc[np.maximum(first, 0)])
        gone = (doc > floor) | passed
        yield from emit(table.filter(pa.array(gone)), SETTLED)
        leads = np.flatnonzero(new_key)
        bounds = np.concatenate([[0], leads[leads > 0], [len(doc)]])
        hashes = np.add.reduceat(new_hash.astype(np.int64), bounds[:-1])
        if not new_key[0]:
            several, hashes[0] = several or bool(hashes[0]), hashes[0] + 1
            held.append(table.slice(0, bounds[1]).filter(pa.array(~gone[: bounds[1]])))
            if hot or sum(t.num_rows for t in held) > most:
                hot = True
                yield from done()
                held = []
        rest = slice(0 if new_key[0] else 1, len(hashes))
        if len(hashes[rest]):
            yield from done()
            held = []
            sizes = np.diff(bounds)
            many = np.repeat(hashes > 1, sizes) & ~gone
            wanted = np.add.reduceat(many.astype(np.int64), bounds[:-1])
            inner = np.repeat((np.arange(len(hashes)) >= rest.start) & (np.arange(len(hashes)) < len(hashes) - 1), sizes)
            big = np.repeat(wanted > most, sizes)
            yield from emit(table.filter(pa.array(many & inner & ~big)), CONTEXT)
            yield from emit(table.filter(pa.array(many & inner & big)), WINDOWS)
            at = int(bounds[-2])
            several, hot = bool(hashes[-1] > 1), False
            held = [table.slice(at).filter(pa.array(~gone[at:]))]
        open_key, hash_, least = key[-1], own[-1], int(floor[-1])
    yield from done()


def dedup(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document with a smaller doc_id.

    1. A text that equals that of a smaller document goes whole; the others are dealt by doc_id once, and every
       later step reuses that exchange.
    2. Every window of ``length`` bytes is named by the least hash of its 16-byte grams; neighbouring windows of one
       name form a run. Equal windows have equal names. First the names alone are dealt, and those of two texts or more go into a
       filter of bounded size; where it says too much, only more runs are dealt. Names, hashes and places of
       the runs that pass it are dealt by name, no text. Runs with equal hashes are settled there (those of one batch of
       texts even before), and a run whose name has no other context has no match and is left out.
    3. The bytes under the other runs, their contexts, are cut out of the texts and dealt by name, and each task gathers them into
       shards of bounded size. Each shard gets its suffix array by Larsson-Sadakane refinement and common prefixes by
       Kasai's rule; suffixes with a common prefix of ``length`` form a class, and windows of a document above the
       least of its class are marked. Contexts of one name in several shards are merged by binary search. A name
       with more than ``hot`` contexts deals its windows one by one, by their own hash.
    4. The marked windows of a document are united and cut out of its bytes.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for every row. A null
    text is empty; a null doc_id counts as greater than all others; rows with one doc_id do not match each
    other, and equal ones are worked on once; an empty table gives no rows.
    """
    last = (1 << 63) - 1
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = docs.agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("doc_id", F.lit(last))).alias("d")).first()
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("doc"), text.alias("text"))
    if ids["n"] == ids["d"]:  # no tag, as a column more on one side would make the exchange of texts another one
        keys = ["doc"]
    else:  # rows that share a doc_id are told apart by their texts
        keys, base = ["doc", "tag"], base.groupBy("doc", F.xxhash64("text").alias("tag")).agg(F.first("text").alias("text"), F.count("*").alias("n"))

    count = F.col("n") if "n" in base.columns else F.lit(1).cast("long")
    names = base.select(*keys, count.alias("n"), F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2"), F.octet_length("text").cast("long").alias("size")).where(F.col("size") >= length)
    names = cut(names)
    firsts = names.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("top")).where("first < top")
    copies = cut(names.join(firsts, ["h1", "h2"]).where("doc > first").select(*keys, "size", "n"))
    base = base.join(copies.select(*keys), keys, "left_anti")

    packed = docs.select(text.alias("text")).mapInArrow(lambda rows: names_of(rows, length), "packed bigint")
    several, found, _ = stored(packed.repartition(F.shiftright("packed", 1)).sortWithinPartitions("packed").mapInArrow(names_of_several, "key bigint"))
    known = docs.sparkSession.sparkContext.broadcast(filter_of(several, found))

    def tagged(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        doc = batch.column(0).to_numpy()
        return doc, batch.column(1).to_numpy() if len(keys) > 1 else np.zeros(len(doc), np.int64)

    def runs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            docs_of, tags = tagged(batch)
            found = [window_runs(_bytes(t), length) for t in batch.column(len(keys))]
            found = [[c[keep] for c in f] for f in found for keep in [in_filter(known.value, f[0])]]
            row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            key, start, count, own = (np.concatenate([f[i] for f in found]) for i in range(4))
            again = repeats_of([key, own], docs_of[row])
            gone, a, b = united(row[again], start[again], (start + count + length - 1)[again])
            row = np.concatenate([row[~again], gone])
            columns = [np.concatenate([key[~again], -1 - (docs_of[gone] & 0xFFFFFF)]), np.concatenate([own[~again], np.zeros(len(gone), np.int64)]), docs_of[row], tags[row]]
            places = [np.concatenate([start[~again], a]).astype(np.int32), np.concatenate([count[~again], b - a - length + 1]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, *places)], ["key", "hash", "doc", "tag", "start", "windows"])

    named = base.select(*keys, "text").mapInArrow(runs, "key bigint, hash bigint, doc bigint, tag bigint, start int, windows int")
    settled = named.repartition("key").sortWithinPartitions("key", "hash", "doc").mapInArrow(lambda rows: settle(rows, hot), "doc bigint, tag bigint, start int, windows int, key bigint, kind tinyint")
    wanted = settled.groupBy(*keys).agg(F.collect_list(F.struct("start", "windows", "key", "kind")).alias("runs"))

    def contexts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            docs_of, tags = tagged(batch)
            parts: list[list] = [[], [], [], [], []]  # key, row, start, windows, hash of a window dealt by itself (0: none)
            texts = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(len(keys))]
            for row, (data, own) in enumerate(zip(texts, batch.column(len(keys) + 1))):
                start, count, key, kind = (own.values.field(i).to_numpy() for i in range(4))
                order = np.argsort(start, kind="stable")
                start, count, key, kind = start[order].astype(np.int64), count[order].astype(np.int64), key[order], kind[order]
                done = kind == SETTLED
                a, b = start[done], np.maximum.accumulate(start[done] + count[done] + length - 1) if done.any() else start[done]
                _, a, b = united(np.zeros(len(a)), a, b)
                single = np.repeat(start[kind == WINDOWS], count[kind == WINDOWS]) + _counted(count[kind == WINDOWS])
                hashes = range_hashes(gram_hashes(np.frombuffer(data, np.uint8)), single, np.ones(len(single), np.int64), length).view(np.int64) if len(single) else single
                some = kind == CONTEXT
                sizes = np.array([len(a), some.sum(), len(single)])
                columns = [np.concatenate([np.full(len(a), -1 - (docs_of[row] & 0xFFFFFF)), key[some], hashes & ((1 << 62) - 1)]), np.full(sizes.sum(), row), np.concatenate([a, start[some], single]), np.concatenate([b - a - length + 1, count[some], np.ones(len(single), np.int64)]), np.concatenate([np.zeros(sizes[0] + sizes[1], np.int64), hashes])]
                for part, column in zip(parts, columns):
                    part.append(column)
            key, row, start, count, hashes = (np.concatenate(p) if p else np.empty(0, np.int64) for p in parts)
            single = np.flatnonzero(hashes != 0)  # equal windows of this batch are settled here
            again = single[repeats_of([hashes[single]], docs_of[row[single]])]
            key[again] = -1 - (docs_of[row[again]] & 0xFFFFFF)
            for at in range(0, len(key), 20_000):
                part = slice(at, at + 20_000)
                piece = [texts[r][a : a + n + length - 1] if k >= 0 else b"" for k, r, a, n in zip(key[part].tolist(), row[part].tolist(), start[part].tolist(), count[part].tolist())]
                columns = [key[part], docs_of[row[part]], tags[row[part]], start[part].astype(np.int32), count[part].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(piece, pa.binary())], ["key", "doc", "tag", "start", "windows", "context"])

    spread = base.join(wanted, keys).select(*keys, "text", "runs").mapInArrow(contexts, "key bigint, doc bigint, tag bigint, start int, windows int, context binary")
    spans = spread.repartition("key").sortWithinPartitions("key", "doc", "start").mapInArrow(lambda rows: mark_shards(rows, length), "doc bigint, tag bigint, start bigint, end bigint")
    spans = spans.groupBy(*keys).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("spans"))

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "n", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in batches(rows):
            out = []
            for doc, n, text, marked in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data, kept, at, removed, count = text.encode("utf-8", "surrogatepass"), [], 0, 0, 0
                for s in sorted(marked or [], key=lambda s: s["start"]):
                    if s["start"] > at or not count:
                        kept.append(data[at : s["start"]])
                        count += 1
                        at = s["start"]
                    if s["end"] > at:
                        removed += s["end"] - at
                        at = s["end"]
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((doc, n, len(data), removed, count, hashlib.sha256(rest).hexdigest(), rest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (*[pa.int64()] * 5, pa.string(), pa.binary()))], names)

    own = base.join(spans, keys, "left").select("doc", count.alias("n"), "text", "spans").mapInArrow(finish, "doc bigint, n bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    whole = copies.select("doc", "n", F.col("size").alias("n_bytes"), F.col("size").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"), F.lit(b"").alias("kept"))
    every = own.unionByName(whole)
    if len(keys) > 1:
        every = every.withColumn("n", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
    return every.select(F.when(F.col("doc") != last, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _counted(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _bytes(text: pa.StringScalar) -> np.ndarray:
    data = text.as_buffer()
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
