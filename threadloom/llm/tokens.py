"""Token counts of whole texts: huge ones in overlapping chunks that are spliced at boundaries proven to be stable."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.bytewords import raw
from threadloom.llm.common import batches, spread_join

CHUNK, OVERLAP = 1 << 16, 1 << 10  # bytes between two seams, and bytes that a chunk reaches beyond each of its seams at first
HELD, BYTES, LONG = 400_000, 24 << 20, 256  # pieces and bytes that a worker remembers before it starts anew, bytes of a piece that is not remembered
MARKS = b".,;:!?)"
_state: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Counter:
    """Number of tokens of pieces of texts, each different piece encoded once while it is remembered.

    The byte-level pre-tokenizer cuts a text into words by one pattern and encodes each word by itself; an added token
    is cut out before. A blank or line end right before a mark that is no white space begins a new word whatever
    stands around the two, so a text may be cut there and its pieces counted one by one: that boundary is the same in
    every stretch of the text that holds both bytes. The byte that follows must not begin an added token, as
    white space before one goes together, nor a character that may be white space beyond ASCII.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        kind = made.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or not kind.get("use_regex", True) or kind.get("add_prefix_space") or made.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"][:1].isspace() for t in made["added_tokens"]):
            raise ValueError("boundaries are proven for byte-level tokenizers without a normalizer only")
        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self.opens = np.zeros(256, bool)  # bytes that a new word may begin with after its blank
        self.opens[0x21:0x7F] = True
        self.opens[0xC3:] = True
        self.opens[[0xE1, 0xE2, 0xE3, *(t["content"].encode()[0] for t in made["added_tokens"])]] = False
        marks = {b for t in made["added_tokens"] for b in t["content"].encode()}
        self.marks = bytes(b for b in MARKS if b not in marks).decode()
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.held = 0

    def boundaries(self, data: np.ndarray) -> np.ndarray:
        """Places in ``data`` where a piece begins, in order; the head is none of them unless it is one by itself."""
        white = (data[:-1] == 0x20) | (data[:-1] == 0x0A)
        return np.flatnonzero(white & self.opens[data[1:]])

    def sizes(self, pieces: list[str]) -> np.ndarray:
        if len(self.known) > HELD or self.held > BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        found = list(map(self.known.get, pieces))
        missing = [i for i, n in enumerate(found) if n is None]
        if missing:
            sought = [pieces[i] for i in missing]
            got = {p: n for p in sought if (n := self.older.get(p)) is not None} if self.older else {}
            new = [p for p in sought if p not in got] if got else sought
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                got.update(zip(part, (len(e) for e in self.encode(part, add_special_tokens=False))))
            for i, n in zip(missing, map(got.get, sought)):
                found[i] = n
            kept = {p: n for p, n in got.items() if len(p) <= LONG}
            self.known.update(kept)
            self.held += sum(map(len, kept))
        return np.array(found, np.int64)

    def count(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pieces of all texts begin, and the tokens before each piece and, last, of all."""
        cut = self.boundaries(data) if len(data) > 1 else np.empty(0, np.int64)
        inside = np.ones(len(data) + 1, bool)
        inside[offsets[1:] - 1] = False  # the byte after the last of a text belongs to another one
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins = np.union1d(cut[inside[cut]], heads)
        if not len(begins):
            return begins, np.zeros(1, np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(np.append(begins, len(data))), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        values = coded.dictionary.cast(pa.large_string())
        # marks after a letter or digit at the end of a piece are words of their own
        stem = pc.utf8_rtrim(values, self.marks)
        stem = pc.if_else(pc.match_substring_regex(stem, "[A-Za-z0-9]$"), stem, values)
        tail = pa.repeat(pa.scalar("", pa.large_string()), len(values))
        same = pc.equal(stem, values)
        if not pc.all(same).as_py():
            full, short = values.filter(pc.invert(same)).to_pylist(), stem.filter(pc.invert(same)).to_pylist()
            tail = pc.replace_with_mask(tail, pc.invert(same), pa.array([f[len(s) :] for f, s in zip(full, short)], pa.large_string()))
        stems, tails = stem.dictionary_encode(), tail.dictionary_encode()
        each = self.sizes(stems.dictionary.to_pylist())[stems.indices.to_numpy()] + self.sizes(tails.dictionary.to_pylist())[tails.indices.to_numpy()]
        return begins, np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy()])])


def _counter(path: str | None) -> Counter:
    path = path or default_tokenizer()
    if path not in _state:
        _state[path] = Counter(path)
    return _state[path]


def seams(data: np.ndarray, counter: Counter, chunk: int, overlap: int) -> list[tuple[int, int, int]]:
    """Where a text is cut: (place, begin and end of the overlap around it).

    An overlap that holds no boundary cannot be aligned: it is widened by doubling. One that would reach
    half-way to the next seam and holds none yet, as inside a word of many thousand bytes, gives its seam up, and
    the chunks on both sides become one.
    """
    out = []
    for at in range(chunk, len(data) - overlap, chunk):
        wide = overlap
        while wide <= chunk // 2:
            low, high = at - wide, min(at + wide, len(data))
            if len(counter.boundaries(data[low:high])):
                # a chunk begins and ends with whole characters
                while low < at and data[low] & 0xC0 == 0x80:
                    low += 1
                while high < len(data) and data[high] & 0xC0 == 0x80:
                    high += 1
                out.append((at, low, high))
                break
            wide *= 2
    return out


MARKS_TYPE = "array<struct<at:long,before:long>>"
CHUNKS = "digest binary, chunk int, last boolean, deal long, base long, left_end long, right_begin long, data binary"
SIDES = f"digest binary, chunk int, last boolean, n long, left_marks {MARKS_TYPE}, right_marks {MARKS_TYPE}"
CHUNK_SCHEMA = pa.schema([("digest", pa.binary()), ("chunk", pa.int32()), ("last", pa.bool_()), ("deal", pa.int64()), ("base", pa.int64()), ("left_end", pa.int64()), ("right_begin", pa.int64()), ("data", pa.binary())])
MARK = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))
SIDE_SCHEMA = pa.schema([("digest", pa.binary()), ("chunk", pa.int32()), ("last", pa.bool_()), ("n", pa.int64()), ("left_marks", MARK), ("right_marks", MARK)])


def _cut(tokenizer: str | None, chunk: int, overlap: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, number = _counter(tokenizer), TaskContext.get().partitionId() << 32
        for batch in batches(rows):
            data, offsets = raw(batch.column(0))
            for k in range(batch.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                digest, cuts = sha256(text).digest(), seams(text, counter, chunk, overlap)
                edges = [(0, 0), *[(low, high) for _, low, high in cuts], (len(text), len(text))]
                for i in range(len(edges) - 1):
                    (begin, left_end), (right_begin, end) = edges[i], edges[i + 1]
                    number += 1
                    yield pa.RecordBatch.from_pylist([{"digest": digest, "chunk": i, "last": i == len(cuts), "deal": number, "base": begin, "left_end": left_end, "right_begin": right_begin, "data": text[begin:end].tobytes()}], CHUNK_SCHEMA)

    return run


def _encode(tokenizer: str | None):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in batches(rows, "data"):
            data, offsets = raw(batch.column(batch.schema.get_field_index("data")).cast(pa.string()))
            begins, before = counter.count(data, offsets)
            own = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("digest", "chunk", "last", "base", "left_end", "right_begin")}
            out = []
            for k in range(batch.num_rows):
                low, high = np.searchsorted(begins, offsets[k : k + 2])
                at = begins[low:high] - offsets[k] + own["base"][k]
                so_far = before[low : high + 1] - before[low]
                marks = lambda keep: [{"at": a, "before": n} for a, n in zip(at[keep].tolist(), so_far[:-1][keep].tolist())]  # noqa: E731, B023
                # the head of a chunk that is not a text's is no boundary by itself, and a blank that ends a chunk is none either
                proven = np.ones(len(at), bool)
                if len(at) and at[0] and not len(counter.boundaries(data[offsets[k] : offsets[k] + 2])):
                    proven[0] = False
                out.append({"digest": own["digest"][k], "chunk": own["chunk"][k], "last": own["last"][k], "n": int(so_far[-1]), "left_marks": marks(proven & (at < own["left_end"][k])), "right_marks": marks(proven & (at >= own["right_begin"][k]))})
            yield pa.RecordBatch.from_pylist(out, SIDE_SCHEMA)

    return run


def count(docs: DataFrame, tokenizer: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every whole text of ``docs``, as the tokenizer's library counts it.

    Texts of ``chunk`` bytes or fewer are counted where they are read. A longer one is cut into chunks that overlap around
    their seams; chunks are dealt over all tasks one by one, also those of one text and those of copies, and each is
    encoded by itself with the places of its boundaries. At each seam the first boundary that both neighbours have found is the
    splice: what the left one counted from there on and what the right one counted before it goes. Sums by text are keyed
    by the SHA-256 of the text, so that repeated rows, equal ids and null ids need no care.

    A null text is empty and has no tokens; special strings inside texts are what the library makes of them; an empty
    table gives no rows.
    """
    if overlap * 2 > chunk:
        raise ValueError("an overlap may be half a chunk at most")
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    size = F.octet_length("text")
    schema = source.select("doc_id").schema.add("n_bytes", "long").add("n_tokens", "long")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in batches(rows):
            data, offsets = raw(batch.column(1))
            begins, before = counter.count(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(np.diff(before[np.searchsorted(begins, offsets)]))], ["doc_id", "n_bytes", "n_tokens"])

    small = source.where(F.coalesce(size, F.lit(0)) <= chunk).mapInArrow(run, schema)
    huge = source.where(size > chunk)
    chunks = huge.select("text").mapInArrow(_cut(tokenizer, chunk, overlap), CHUNKS).repartition("deal")
    encoded = chunks.mapInArrow(_encode(tokenizer), SIDES)
    right = F.struct(F.col("chunk").alias("seam"), F.col("n"), F.col("left_marks").alias("starts"), F.lit(None).cast("long").alias("m"), F.lit(None).cast(MARKS_TYPE).alias("stops"))
    left = F.struct((F.col("chunk") + 1).alias("seam"), F.lit(None).cast("long").alias("n"), F.lit(None).cast(MARKS_TYPE).alias("starts"), F.col("n").alias("m"), F.col("right_marks").alias("stops"))
    sides = encoded.select("digest", F.explode(F.when(F.col("last"), F.array(right)).otherwise(F.array(right, left))).alias("s")).select("digest", "s.*")
    met = sides.groupBy("digest", "seam").agg(*[F.first(c, True).alias(c) for c in ("n", "starts", "m", "stops")])  # copies of a text agree in all of these
    places = lambda c: F.transform(c, lambda x: x["at"])
    splice = F.array_min(F.array_intersect(places("starts"), places("stops")))
    before = lambda c: F.filter(c, lambda x: x["at"] == F.col("splice"))[0]["before"]
    joined = met.withColumn("splice", splice).withColumn("kept", F.when(F.col("seam") == 0, F.col("n")).otherwise(F.col("n") - before("starts") - (F.col("m") - before("stops"))))
    whole = F.coalesce("kept", F.raise_error(F.lit("two chunks of a text share no boundary")).cast("long"))
    totals = joined.groupBy("digest").agg(F.sum(whole).alias("n_tokens"))
    narrow = huge.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), size.cast("long").alias("n_bytes"))
    return small.unionByName(spread_join(narrow, totals, "digest").select("doc_id", "n_bytes", "n_tokens"))

