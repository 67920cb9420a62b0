"""Best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import importlib
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import batches, bounded, cut, word_codes

MARKS = ".,!?;:#$%&*"  # marks that end a word and stand alone as a token run
CACHE = 150_000  # different words after which a worker's memory of ids starts anew, with the last ones as its older half
BYTES = 16 << 20  # the same for bytes of words and ids
LONG = 256  # characters of a word that is not remembered
_state: dict = {}


def default_tokenizer() -> str:
    return importlib.import_module("public_tokenizers").path("word_bpe_49k.json")


class WordIds:
    """Token ids of words, each different word encoded once while it is remembered.

    The vocabulary cuts at white space before anything else, so the ids of a text are those of its words in
    a row. A trailing run of ``MARKS`` after a letter or digit is a token run of its own, and letters up to
    U+00FF can be lower-cased beforehand, which leaves fewer different words to encode.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only take memory
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def split(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Stem and trailing marks of each word; a word that cannot be cut safely is all stem."""
        stem = pc.utf8_rtrim(words, characters=MARKS)
        safe = pc.and_(pc.match_substring_regex(words, r"^[\x{00}-\x{FF}]*$"), pc.match_substring_regex(stem, r"[A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]$"))
        cut_off = pc.and_(safe, pc.not_equal(stem, words))
        tails = pc.replace_substring_regex(words.filter(cut_off), r"^(?s:.*?)([.,!?;:#$%&*]*)$", r"\1")
        tail = pc.replace_with_mask(pa.repeat("", len(words)), cut_off, tails)
        return pc.if_else(safe, pc.utf8_lower(stem), words), tail

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of different words as little-endian 32-bit numbers."""
        if len(self.known) > CACHE or self.held > BYTES:  # words that are met again come back from the older half
            self.known, self.older, self.held = {}, self.known, 0
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if not missing:
            return found
        sought = [words[i] for i in missing]
        if self.older:
            again = {w: ids for w in sought if (ids := self.older.get(w)) is not None}
            new = [w for w in sought if w not in again]
        else:
            again, new = {}, sought
        made = [array("I", e.ids).tobytes() for at in range(0, len(new), 1024) for e in self.encode(new[at : at + 1024], add_special_tokens=False)]
        again.update(zip(new, made))
        for i, ids in zip(missing, map(again.get, sought)):
            found[i] = ids
        long = [w for w in new if len(w) > LONG]
        for w in long:
            del again[w]
        self.known.update(again)
        self.held += sum(map(len, again)) + sum(map(len, again.values()))
        return found


def token_ids(texts: pa.Array, words_to_ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each followed by id 0, and the number of ids by text."""
    codes, words, offsets = word_codes(texts)
    stems, tails = (x.dictionary_encode() for x in words_to_ids.split(words))
    parts = words_to_ids.ids(stems.dictionary.to_pylist()) + words_to_ids.ids(tails.dictionary.to_pylist())
    size = np.fromiter(map(len, parts), np.int32, len(parts)) // 4
    ids = np.frombuffer(b"".join(parts), "<u4")
    starts = (np.cumsum(size) - size).astype(np.int32)
    both = np.stack([stems.indices.to_numpy(), tails.indices.to_numpy() + len(stems.dictionary)], axis=1)[codes].reshape(-1)
    per_part = size[both]
    before = np.concatenate([[0], np.cumsum(per_part, dtype=np.int64)])
    per_text = before[2 * offsets[1:]] - before[2 * offsets[:-1]]
    shift = (starts[both] - before[:-1]).astype(np.int64 if before[-1] >> 31 else np.int32)
    flat = ids[np.arange(before[-1], dtype=shift.dtype) + np.repeat(shift, per_part)]
    return np.insert(flat, np.cumsum(per_text), 0), per_text + 1


def pieces(docs: DataFrame, most: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a bucket of every piece; a null text is the single id 0."""
    source = bounded(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    schema = source.select("doc_id").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer or default_tokenizer()
        if path not in _state:
            _state[path] = WordIds(path)
        for batch in batches(rows):
            ids, sizes = token_ids(batch.column(1), _state[path])
            ids = ids.astype("<u4")
            count = -(-sizes // most)
            row = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * most
            length = np.minimum(sizes[row] - start, most)
            at = (np.cumsum(sizes) - sizes)[row] + start
            crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(at.tolist(), length.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, schema)


def plan(histogram: dict[int, int], most: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, ranks, first sequence, pieces a sequence, offset).

    Sequences with the same content form one run of numbers. A length goes to the fullest sequences with room
    for it, as many of its pieces into each as fit, then into new ones. Only a run that a length does not fill
    whole is split, so the plan has a few entries a length, however many pieces there are.
    """
    rooms: list[int] = []  # different amounts of room, ascending
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, sequences)
    out, fresh = [], 0

    def give(room: int, first: int, count: int) -> None:
        if room and count:
            if not runs[room]:
                insort(rooms, room)
            runs[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, count = runs[room].pop()
                if not runs[room]:
                    rooms.pop(k)
                known = True
            else:
                room, first, known = most, fresh, False
                count = -(-left // (most // length))
            each = room // length
            whole = min(count, left // each)
            if not known:
                fresh += count
            if whole:
                out.append((length, rank, whole * each, first, each, most - room))
                rank, left = rank + whole * each, left - whole * each
                give(room - each * length, first, whole)
            if whole < count:
                if 0 < left < each:
                    out.append((length, rank, left, first + whole, each, most - room))
                    give(room - left * length, first + whole, 1)
                    rank, left, whole = rank + left, 0, whole + 1
                give(room, first + whole, count - whole)
    return out


def pack(docs: DataFrame, most: int = 2048, tokenizer: str | None = None, rows: int = 20_000) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    Each piece gets a rank among those of its length: pieces fall into buckets of about ``rows`` by a hash, so that a
    hot length is spread over tasks; ranks inside a bucket come from a window over it, and the buckets' first ranks
    from a running sum of their counts. The driver gathers the number of pieces by length alone, ``most`` numbers
    whatever the input; ``plan`` packs them into a few entries a length, which are joined to the pieces on length,
    and the rank picks the entry. The plan is broadcast while it has at most 200,000 entries.
    Repeated rows are packed each for itself; a null doc_id is kept; an empty table gives no rows.
    """
    made = cut(pieces(docs, most, tokenizer))
    by_length = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    buckets = max(1, -(-max(by_length.values(), default=1) // rows))
    made = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counted = made.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counted.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = made.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    placed = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    entries = [(length, low, low + n, first, each, offset) for length, low, n, first, each, offset in plan(by_length, most)]
    layout = docs.sparkSession.createDataFrame(entries, "length bigint, low bigint, high bigint, first bigint, each bigint, base bigint")
    joined = placed.join(F.broadcast(layout) if len(entries) <= 200_000 else layout, "length").where("rank >= low and rank < high")
    place = F.col("rank") - F.col("low")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(place / F.col("each"))).cast("long").alias("sequence_id"), (F.col("base") + place % F.col("each") * F.col("length")).cast("long").alias("offset"))
