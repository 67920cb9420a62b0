"""How quality filters interact: what each removes, in every order that they can be applied in."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.bytewords import distinct, plain_table, raw, words
from threadloom.llm.common import batches, stored

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
SPACES, MARKS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of the filters A to D that each text fails: few words, few different words, capitals, marks."""
    codes, values, at = words(data, offsets, plain_table(SPACES))
    n = np.diff(at)
    rows, _, _ = distinct(np.repeat(np.arange(len(n)), n), codes, len(values))
    different = np.bincount(rows, minlength=len(n))
    sums = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[offsets])
    capitals, points = sums((data >= 0x41) & (data <= 0x5A)), sums((data & 0xC0) != 0x80)
    marked = np.zeros(256, bool)
    marked[list(MARKS)] = True
    fails = (n < 200, 100 * different < 50 * n, 100 * capitals > 2 * points, sums(marked[data]) > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def marks(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, fails (bits of A to D) and the text's SHA-256 of every row; a null text or part is empty."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    schema = rows.select("doc_id", "part").schema.add("fails", "integer").add("digest", "binary")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(batches_):
            data, offsets = raw(batch.column(2))
            view = memoryview(np.ascontiguousarray(data))
            digests = [sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own_failures(data, offsets), pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "fails", "digest"])

    return rows.mapInArrow(run, schema)


def cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, fails (bits of A to E), good, toxic and n: how many rows fail just these filters.

    All rows are counted without E first. A row that E spares has the least doc_id of its text: those are found by a minimum
    a text, combined before the shuffle, and met again on text and id, which are spread as rows are. E fails
    for all others, so no group of copies comes together.
    """
    one = labels.groupBy("doc_id").agg(*[F.max((F.col(c) == 1).cast("int")).alias(k) for k, c in (("good", "quality"), ("toxic", "toxic"))])
    seen = {k: F.coalesce(k, F.lit(0)).alias(k) for k in ("good", "toxic")}
    rows, _, _ = stored(marks(docs, part).join(one, "doc_id", "left").select("doc_id", "part", "fails", "digest", *seen.values()))
    keys = ["part", "fails", "good", "toxic"]
    total = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    first = rows.groupBy(F.col("digest").alias("first_digest")).agg(F.min("doc_id").alias("first_id"))
    spared = rows.join(first, (F.col("digest") == F.col("first_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy(*keys).agg(F.count("*").alias("n"))
    again = total.unionAll(spared.withColumn("n", -F.col("n"))).withColumn("fails", F.col("fails") + CELLS // 2)
    return spared.unionAll(again).groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")


def walk(cell_counts: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters, from counts by (row, mask cell): one array entry for each of the subsets.

    Subsets follow each other in Gray code, so each step switches one filter on or off. A cell knows how many of the active
    filters its documents fail; when the first is switched on its documents leave the survivors, when the
    last is switched off they are back.
    """
    active, alive = np.zeros(CELLS, np.int64), cell_counts.sum(axis=1)
    states, subset = np.zeros_like(cell_counts), 0
    states[:, 0] = alive
    for step in range(1, CELLS):
        bit = step & -step
        subset ^= bit
        failing = np.flatnonzero(np.arange(CELLS) & bit)
        if subset & bit:
            active[failing] += 1
            alive = alive - cell_counts[:, failing[active[failing] == 1]].sum(axis=1)
        else:
            active[failing] -= 1
            alive = alive + cell_counts[:, failing[active[failing] == 0]].sum(axis=1)
        states[:, subset] = alive
    return states


@lru_cache(1)
def orders() -> tuple[list[str], np.ndarray]:
    """All orders of the filters, and the subset of filters active before and after each step."""
    names = ["".join(p) for p in permutations(FILTERS)]
    bits = np.array([[1 << FILTERS.index(c) for c in p] for p in names])
    after = np.cumsum(bits, axis=1)
    return names, np.stack([after - bits, after], axis=2)


def steps(cell_counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Every count of COUNTS by (part, order, step), from counts of documents by (part, cell): all, good and toxic ones."""
    _, subsets = orders()
    before, after = subsets[:, :, 0], subsets[:, :, 1]
    states = {k: walk(c) for k, c in cell_counts.items()}
    lost = {k: s[:, before] - s[:, after] for k, s in states.items()}
    which, every = np.log2(after - before).astype(int), np.arange(CELLS)
    failing = np.stack([cell_counts["n"][:, (every >> f & 1) == 1].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    alone = np.stack([cell_counts["n"][:, 1 << f] for f in range(len(FILTERS))], axis=1)
    shapley = np.stack([(lost["n"] * (which == f)).sum(axis=(1, 2)) for f in range(len(FILTERS))], axis=1)
    removed = lost["n"]
    return {"kept": states["n"][:, after], "removed": removed, "redundant": failing[:, which] - removed, "unique_fails": alone[:, which], "good_lost": lost["good"], "toxic_lost": lost["toxic"], "shapley": shapley[:, which]}


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step and the counts of COUNTS, for every part, order and step, zeros included.

    Filters A to D look at a row alone; E fails a row whose text a smaller doc_id has. A null doc_id is larger than all
    others, so that such rows fail E if any row with an id has their text and not otherwise; rows with equal ids do not fail E
    against each other. A null text is empty, a null part is named by an empty string. Rows without a label are
    neither good nor toxic; of several labels of an id any that is set counts. An empty table gives no rows.

    The corpus comes down to 32 cells a part; the orders are worked out from those, some parts at a time.
    """
    by_cell = lambda value: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.aggregate(F.filter("c", lambda x: x["fails"] == i), F.lit(0).cast("long"), lambda acc, x: acc + value(x)))
    listed = cells(docs, labels, part).groupBy("part").agg(F.collect_list(F.struct("fails", "good", "toxic", "n")).alias("c"))  # at most 128 a part
    arrays = listed.select("part", by_cell(lambda x: x["n"]).alias("n"), by_cell(lambda x: x["n"] * x["good"]).alias("good"), by_cell(lambda x: x["n"] * x["toxic"]).alias("toxic"))
    names, _ = orders()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for batch in (whole.slice(at, 64) for at in range(0, whole.num_rows, 64)):
                counts = {c: batch.column(batch.schema.get_field_index(c)).flatten().to_numpy().reshape(-1, CELLS) for c in ("n", "good", "toxic")}
                n, shape = batch.num_rows, (len(names), len(FILTERS))
                each = shape[0] * shape[1]
                parts = batch.column(0).take(pa.array(np.repeat(np.arange(n), each)))
                order = pa.array(names).take(pa.array(np.tile(np.repeat(np.arange(shape[0]), shape[1]), n)))
                step = pa.array(np.tile(np.arange(1, shape[1] + 1), n * shape[0]), pa.int32())
                made = steps(counts)
                yield pa.RecordBatch.from_arrays([parts, order, step, *[pa.array(made[c].reshape(-1), pa.int64()) for c in COUNTS]], ["part", "filter_order", "step", *COUNTS])

    return arrays.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
