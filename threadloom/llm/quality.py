"""Quality classifier: hashed word n-grams, logistic regression trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import batches, with_text, word_codes

BUCKETS = 1 << 18
TAIL = regex.compile(r"[^\p{L}\p{N}]+$")


def _shape(word: str) -> str:
    """Letter case and trailing marks of a word: what stays when its letters are forgotten."""
    tail = TAIL.search(word)
    stem = word[: tail.start()] if tail else word
    case = "0" if not stem else "A" if len(stem) > 1 and stem.isupper() else "d" if any(c.isdigit() for c in stem) else "a" if stem.islower() else "Aa"
    return f"{case}~{tail.group() if tail else ''}"


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, bucket numbers and values of hashed n-grams: words, pairs of neighbouring words, word shapes, and pairs of neighbouring shapes.

    In the pairs of shapes a word equal to the one before it has the shape "again". A value is the n-gram's count over
    the number of words, so a long text weighs as much as a short one; a text without words has no features.
    """
    codes, words, offsets = word_codes(texts)
    sizes = np.diff(offsets)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    if not len(codes):
        return rows, codes.astype(np.int64), np.empty(0)
    h = lambda kind, x: xxhash.xxh32_intdigest(f"{kind} {x}".encode("utf-8", "surrogatepass"))
    shapes, memo = [], {}
    words = words.to_pylist()
    for w in words:
        s = _shape(w)
        if s not in memo:
            memo[s] = h("shape", s)
        shapes.append(memo[s])
    word_h = np.array([h("word", w.lower()) for w in words], np.int64)[codes]
    shape_h = np.array(shapes, np.int64)[codes]
    again = np.zeros(len(codes), bool)
    again[1:] = (word_h[1:] == word_h[:-1]) & (rows[1:] == rows[:-1])
    shape_h = np.where(again, h("shape", "again"), shape_h)
    first = np.concatenate([[True], rows[1:] != rows[:-1]])
    before = np.where(first, h("shape", "start"), np.concatenate([[0], shape_h[:-1]]))
    word_before = np.where(first, h("word", ""), np.concatenate([[0], word_h[:-1]]))
    index = np.concatenate([word_h, _paired(word_before, word_h), shape_h, _paired(before, shape_h)]) % buckets
    return np.tile(rows, 4), index, np.tile(1.0 / np.maximum(sizes, 1)[rows], 4)


def _paired(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A 32-bit hash of two hashes in order."""
    both = (one * 0x9E3779B1 + two * 31 + 7) & 0xFFFFFFFF
    return both ^ (both >> 15)


def compact(texts: pa.Array, buckets: int = BUCKETS, step: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all texts with repeats summed: where each text's begin, bucket numbers and values; made ``step`` texts at a time."""
    sizes, index, value = [np.zeros(1, np.int64)], [np.empty(0, np.int32)], [np.empty(0)]
    for at in range(0, len(texts), step):
        part = texts.slice(at, step)
        r, i, v = features(part, buckets)
        unique, inverse = np.unique(r * buckets + i, return_inverse=True)
        sizes.append(np.bincount(unique // buckets, minlength=len(part)))
        index.append((unique % buckets).astype(np.int32))
        value.append(np.bincount(inverse, weights=v, minlength=len(unique)))
    return np.cumsum(np.concatenate(sizes)), np.concatenate(index), np.concatenate(value)


def ftrl(cuts: np.ndarray, index: np.ndarray, value: np.ndarray, labels: np.ndarray, passes: int, buckets: int = BUCKETS, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> np.ndarray:
    """Weights after ``passes`` over the rows in the order given, one update a row; the last weight is the bias.

    The features of a row lie between its cut and the next, each bucket once.
    """
    z, n = np.zeros(buckets + 1), np.zeros(buckets + 1)
    for _ in range(passes):
        for row, y in enumerate(labels):
            at = np.append(index[cuts[row] : cuts[row + 1]], buckets)
            x = np.append(value[cuts[row] : cuts[row + 1]], 1.0)
            w = np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))
            p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


def train(labelled: DataFrame, most: int = 24_000, shards: int = 6, passes: int = 4) -> np.ndarray:
    """Weights from rows (text, label, id) of at most ``most`` labelled rows, chosen by the hash of their id.

    The bound is a parameter of the fit only: all documents are scored. The sample falls into ``shards``
    disjoint parts; each is trained by itself in a fixed order, so that no task holds more than a part, and
    the weights are averaged. Rows with a null label are left out. With no rows, all weights are zero and
    every score is 0.5.
    """
    labelled = labelled.where("label is not null")
    count = labelled.count()
    if not count:
        return np.zeros(BUCKETS + 1)
    order = F.xxhash64(F.col("id").cast("string"), F.lit(7))
    if count > most:  # keep about ``most`` of them by hash; a limit would need a sort of all
        labelled = labelled.where(F.pmod(order, F.lit(1_000_000)) < int(1_000_000 * most / count))
    parts = labelled.select("text", F.col("label").cast("double").alias("label"), order.alias("order"), F.pmod(order, F.lit(shards)).alias("shard"))

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("order")
        w = ftrl(*compact(group.column("text").combine_chunks()), group.column("label").to_numpy(), passes)
        kept = np.flatnonzero(w)
        return pa.table({"index": kept.astype(np.int32), "w": w[kept]})

    found = parts.groupBy("shard").applyInArrow(fit, "index int, w double")
    in_order = F.aggregate(F.array_sort(F.collect_list("w")), F.lit(0.0), lambda acc, w: acc + w)  # at most ``shards`` numbers, always summed alike
    weights = found.groupBy("index").agg(in_order.alias("w"))
    used = min(shards, parts.select("shard").distinct().count())
    out = np.zeros(BUCKETS + 1)
    found = weights.toPandas()  # at most BUCKETS + 1 rows whatever the input
    out[found["index"].to_numpy()] = found["w"].to_numpy() / max(used, 1)
    return out


def score(docs: DataFrame, weights: np.ndarray, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """``keep`` columns (all, if none are named) and ``name``, the score (0 to 1), of every row; whole texts, null as empty."""
    keep = docs.columns if keep is None else keep
    source, text = with_text(docs, keep)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # BUCKETS + 1 numbers whatever the input
    schema = T.StructType(source.schema.fields[: len(keep)]).add(name, "double")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches(rows, text, 1 << 20):
            r, i, v = features(batch.column(batch.schema.get_field_index(text)))
            total = np.bincount(r, weights=w[i] * v, minlength=batch.num_rows) + w[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(1.0 / (1.0 + np.exp(-total)))], [*batch.schema.names[: len(keep)], name])

    return source.mapInArrow(run, schema)


def fit_and_score(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Score ``docs`` by a model of ``labels.quality``, learnt without rows whose crc32(doc_id) mod 3 is 1.

    Only the text is an input of the score. A null doc_id is not held out and learns nothing.
    """
    known = labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.max("quality").alias("label"))
    learn = docs.select(F.col("doc_id").alias("id"), "text").join(known.withColumnRenamed("doc_id", "id"), "id").select("id", "text", "label")
    return score(docs, train(learn), keep, name)
