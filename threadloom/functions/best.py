"""Cosines of a few queries with the fragments that can be among their best; norms are worked out for those alone.

A norm needs the document frequency of every term of a fragment, and to bring these together all terms of all fragments have to go through an
exchange, which is many times their texts. Here texts are cut into terms where they lie. Counters of a fixed number, shared by terms of equal
hash, bound document frequencies from above, and so norms from below and cosines from above. Only fragments whose bound reaches the best known
exact scores get their exact norm; what is left out is surely worse.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import text as tx
from threadloom.operators.graph import stored

COUNTERS = 22  # as a power of two; 16 MB
BITS = 27  # of the filter of terms whose frequency is asked for, as a power of two; 16 MB
BLOCK = 1 << 16
CELLS = 1 << 21  # scores that a task holds at a time
OWNERS, EACH = 4, 4  # owners that a task keeps for each one asked for, and fragments of each
NEAR = 0.85  # share of the bound of the last owner asked for from which fragments are worked out first
SLACK = 1.1e-6  # what rounding to six places can add, and the error of a sum
MIX = np.uint64(0x9E3779B97F4A7C15)
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def repeated(rows: DataFrame, key: str) -> bool:
    """Whether two rows share a key (or its lack)."""
    return bool(rows.groupBy(key).count().where("count > 1").limit(1).count())


def _spread(fragments: DataFrame) -> DataFrame:
    """The same rows; a table that lies in too few pieces for the tasks there are is dealt out once."""
    spark = fragments.sparkSession
    if fragments.rdd.getNumPartitions() * 2 >= spark.sparkContext.defaultParallelism:
        return fragments
    return stored(fragments.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))[0]


def _cut(rows: DataFrame) -> DataFrame:
    """Rows with the hashes of their text's terms in place of the text."""
    return rows.withColumn("terms", tx.hashed_ngrams(tx.words(F.coalesce("text", F.lit(""))))).drop("text")


def _mixed(keys: np.ndarray, corpus: np.ndarray | int) -> np.ndarray:
    """Hashes of terms inside their corpus."""
    return keys.view(np.uint64) ^ (np.asarray(corpus).astype(np.uint64) * MIX)


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def _terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, count) of the different terms of each row, in order of rows."""
    terms, corpus = batch.column("terms"), batch.column("cid").to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows, dtype=np.uint16), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    key = _mixed(terms.flatten().to_numpy(zero_copy_only=False), corpus[row])
    order = np.argsort(key)
    order = order[np.argsort(row[order], kind="stable")]
    row, key = row[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.zeros(0, np.int64)
    return row[first].astype(np.int64), key[first], np.diff(np.append(first, len(key))).astype(np.float64)


def _found(wanted: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are wanted, and their places."""
    place = np.minimum(np.searchsorted(wanted, key), max(len(wanted) - 1, 0))
    return (wanted[place] == key) if len(wanted) else np.zeros(len(key), bool), place


def _bucket(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _counts(rows: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """Fragments by counter of their terms, and after these the exact frequencies of the ``wanted`` keys."""
    known, size = rows.sparkSession.sparkContext.broadcast(wanted), (1 << COUNTERS) + len(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int32)
        for batch in _pieces(batches, BLOCK - 1):
            _, key, _ = _terms(batch)
            met, place = _found(known.value, key)
            np.add.at(total, np.concatenate([_bucket(key), place[met] + (1 << COUNTERS)]), 1)
        for at in range(0, size, BLOCK):
            if total[at : at + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([zlib.compress(total[at : at + BLOCK].tobytes(), 1)], pa.binary())], ["at", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), np.int32).astype(np.int64) for x in group["counts"].to_pylist())
        total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
        return pa.table([group["at"].slice(0, 1), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["at", "counts"])

    found = np.zeros(size, np.int32)
    for r in _cut(rows).mapInArrow(count, "at bigint, counts binary").groupBy("at").applyInArrow(add, "at bigint, counts binary").toLocalIterator():
        part = np.frombuffer(zlib.decompress(r["counts"]), np.int32)
        found[r["at"] : r["at"] + len(part)] = part
    return found


def _idf(df: np.ndarray, n: np.ndarray, max_df: float = 0.6) -> np.ndarray:
    """T2, T5 as ``tx.idf``; 0 for terms that no fragment or too many have."""
    most = np.where(n * max_df < 1, n, n * max_df)
    return np.where((df > 0) & (df <= most), np.log((1 + n) / (1 + df)) + 1, 0.0)


class _Asked:
    """What tasks need to score a fragment: the queries' weights by term, the counters, and the sizes of the corpora."""

    def __init__(self, wanted: np.ndarray, counts: np.ndarray, sizes: np.ndarray, corpus: np.ndarray, query: np.ndarray, place: np.ndarray, tf: np.ndarray, queries: int):
        self.wanted, self.counts, self.sizes, self.queries = wanted, counts[: 1 << COUNTERS], sizes, queries
        self.idf = _idf(counts[1 << COUNTERS :], sizes[corpus]) if len(wanted) else np.zeros(0)
        weight = tf * self.idf[place]
        norm = np.sqrt(np.bincount(query, weight * weight, queries))
        order = np.argsort(place, kind="stable")
        order = order[weight[order] > 0]
        self.query, self.weight = query[order], weight[order] / norm[query[order]]
        self.starts = np.searchsorted(place[order], np.arange(len(wanted) + 1))

    def score(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(dot products with the unit queries, bounds of the cosines), a row a fragment."""
        row, key, tf = _terms(batch)
        n = self.sizes[batch.column("cid").to_numpy(zero_copy_only=False)][row]
        met, place = _found(self.wanted, key)
        w = _idf(self.counts[_bucket(key)].astype(np.float64), n)
        w[met] = self.idf[place[met]]
        w *= tf
        norm = np.sqrt(np.bincount(row, w * w, batch.num_rows))
        row, w, place = row[met], w[met], place[met]
        many = self.starts[place + 1] - self.starts[place]
        each = np.repeat(np.arange(len(place)), many)
        at = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + self.starts[place][each]
        dots = np.bincount(row[each] * self.queries + self.query[at], w[each] * self.weight[at], batch.num_rows * self.queries).reshape(batch.num_rows, self.queries)
        dots[~batch.column("live").to_numpy(zero_copy_only=False)] = 0.0
        return dots, np.where(dots > 0, dots / np.maximum(norm, 1e-300)[:, None] * (1 + 1e-9), 0.0)


def _entries(batch: pa.RecordBatch, names: list[str], task: int, row: np.ndarray, query: np.ndarray, bound: np.ndarray, dot: np.ndarray) -> pa.RecordBatch:
    taken = batch.select([*names, "cid", "own"]).take(pa.array(row))
    columns = [pa.array(query.astype(np.int32)), pa.array(np.full(len(row), task, np.int32)), *taken.columns, pa.array(bound), pa.array(dot)]
    return pa.RecordBatch.from_arrays(columns, ["q", "task", *names, "cid", "own", "bound", "dot"])


def _kept(query: np.ndarray, own: np.ndarray, bound: np.ndarray, owners: int, queries: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``EACH`` best fragments of each of the ``owners`` best owners of each query, and the bound of the last of these owners (0 where there are fewer)."""
    order = np.lexsort((-bound, own, query))
    q, o = query[order], own[order]
    start = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (o[1:] != o[:-1])]))
    size = np.diff(np.append(start, len(q)))
    best, whose = bound[order][start], q[start]
    ranked = np.lexsort((-best, whose))
    first = np.searchsorted(whose[ranked], np.arange(queries))
    rank = np.empty(len(start), np.int64)
    rank[ranked] = np.arange(len(ranked)) - first[whose[ranked]]
    least = np.zeros(queries)
    least[whose[rank == owners - 1]] = best[rank == owners - 1]
    place = np.arange(len(q)) - np.repeat(start, size)
    return order[(np.repeat(rank, size) < owners) & (place < EACH)], least


def _bounds(rows: DataFrame, names: list[str], asked, owners: int | None, floors: np.ndarray | None = None, bests: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(q, task, names, cid, own, bound, dot): of each task and query the fragments of the ``owners`` best owners, and a row without dot for the greatest bound left out; or, with ``floors`` by query, all fragments that reach these, and the best of their own owner where it is among ``bests``."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(["q int", "task int", *[f"{c} {kinds[c]}" for c in names], "cid int", "own bigint", "bound double", "dot double"])
    given = rows.sparkSession.sparkContext.broadcast((floors, bests))

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor, known = given.value
        for batch in _pieces(batches, max(1, min(BLOCK - 1, CELLS // max(asked.value.queries, 1)))):
            dots, bound = asked.value.score(batch)
            row, query = np.nonzero((bound > 0) & (bound >= floor))
            if known is not None:
                own = batch.column("own").to_numpy(zero_copy_only=False)
                met, place = _found(known[0], _mixed(own[row], query))
                keep = ~met | (bound[row, query] >= known[1][place] if len(known[0]) else True)
                row, query = row[keep], query[keep]
            if len(row):
                yield _entries(batch, names, 0, row, query, bound[row, query], dots[row, query])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        queries, task = asked.value.queries, TaskContext.get().partitionId()
        least, out, held, waiting = np.zeros(queries), np.zeros(queries), [], 0

        def settled() -> None:
            nonlocal least, held, waiting
            whole = pa.Table.from_batches(held).combine_chunks()
            query, own, bound = (whole[c].to_numpy() for c in ("q", "own", "bound"))
            keep, least = _kept(query, own, bound, owners, queries)
            gone = np.ones(len(query), bool)
            gone[keep] = False
            # of an owner that is kept with EACH fragments nothing better is gone; others are no better than the last owner
            np.maximum.at(out, query[gone & (bound <= least[query])], bound[gone & (bound <= least[query])])
            held, waiting = whole.take(pa.array(np.sort(keep))).to_batches(), 0

        for batch in _pieces(batches, max(1, min(BLOCK - 1, CELLS // max(queries, 1)))):
            dots, bound = asked.value.score(batch)
            above = bound > least
            np.maximum(out, np.where(above, 0.0, bound).max(axis=0, initial=0.0), out=out)
            row, query = np.nonzero(above)
            if len(row):
                held.append(_entries(batch, names, task, row, query, bound[row, query], dots[row, query]))
                waiting += len(row)
            if waiting > max(200_000, 4 * queries * owners * EACH):
                settled()
        if held:
            settled()
            yield from held
        left = np.flatnonzero(out)
        if len(left):
            nothing = [pa.nulls(len(left), f.type) for f in pa.schema([(c, batch.schema.field(c).type) for c in [*names, "cid", "own"]])]
            yield pa.RecordBatch.from_arrays([pa.array(left.astype(np.int32)), pa.array(np.full(len(left), task, np.int32)), *nothing, pa.array(out[left]), pa.nulls(len(left), pa.float64())], ["q", "task", *names, "cid", "own", "bound", "dot"])

    return _cut(rows).mapInArrow(best if floors is None else every, schema)


def _filter(keys: DataFrame, count: int) -> np.ndarray:
    """A bitmap over the low bits of the keys, sixteen bits a key as far as 2 ** BITS allow."""
    bits = min(max(16 * count, 1 << 16).bit_length(), BITS)
    at = F.col("key").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    found = np.zeros(1 << (bits - 3), np.uint8)
    marks = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    for r in marks.toLocalIterator():
        found[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return found


def _exact(rows: DataFrame, names: list[str], chosen: DataFrame, sizes: DataFrame) -> DataFrame:
    """``chosen`` (names, dot, ...) with their exact cosine as score: their terms are listed, and the frequencies of these terms are counted in all fragments."""
    some = chosen.select(*names).distinct()
    own = rows.join(F.broadcast(some), names, "left_semi")  # bounded by what tasks keep for the queries
    kinds = dict(rows.dtypes)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches, BLOCK - 1):
            row, key, tf = _terms(batch)
            taken = batch.select([*names, "cid"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(key.view(np.int64)), pa.array(tf)], [*names, "cid", "key", "tf"])

    terms, count, _ = stored(_cut(own).mapInArrow(listed, ", ".join([*[f"{c} {kinds[c]}" for c in names], "cid int", "key bigint", "tf double"])))
    marks = rows.sparkSession.sparkContext.broadcast(_filter(terms, count))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64(len(marks.value) * 8 - 1)
        for batch in _pieces(batches, BLOCK - 1):
            _, key, _ = _terms(batch)
            at = key & low
            key = key[(marks.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            if len(key):
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "df"])

    df = _cut(rows).mapInArrow(counted, "key bigint, df bigint").groupBy("key").agg(F.sum("df").alias("df"))
    most = F.when(F.col("n") * 0.6 < 1, F.col("n").cast("double")).otherwise(F.col("n") * F.lit(0.6))
    weighed = terms.join(df, "key").join(F.broadcast(sizes), "cid").where(F.col("df") <= most).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norms, _, _ = stored(weighed.groupBy(*names).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")))
    return stored(chosen.join(norms, names).withColumn("score", F.col("dot") / F.col("norm")))[0]


def _corpora(spark: SparkSession, query_counts: DataFrame, sizes: DataFrame, corpus: list[str]) -> tuple[DataFrame | None, DataFrame, np.ndarray, dict]:
    """Numbers of the corpora that are asked (corpus, cid) and of their fragments (cid, n), the second also as an array, and the numbers by name."""
    found = sizes.join(F.broadcast(query_counts.select(*corpus).distinct()), corpus, "left_semi").collect() if corpus else sizes.collect()  # no more than there are queries
    schema = ", ".join([*[f"{c} {dict(sizes.dtypes)[c]}" for c in corpus], "cid int"])
    named = spark.createDataFrame([(*[r[c] for c in corpus], i) for i, r in enumerate(found)], schema) if corpus else None
    return named, spark.createDataFrame([(i, r["n"]) for i, r in enumerate(found)], "cid int, n bigint"), np.array([float(r["n"]) for r in found]), {tuple(r[c] for c in corpus): i for i, r in enumerate(found)}


def best_cosines(fragments: DataFrame, query_counts: DataFrame, sizes: DataFrame, corpus: list[str], fragment: list[str], owner: list[str], k: int | None = None, least: float | None = None) -> DataFrame:
    """T4: (qid, corpus, fragment, score) as ``tx.few_cosines``, with all rows that can decide the ``k`` best owners of a query, or all with a score of ``least`` or more.

    ``fragments`` (corpus, fragment, owner, text) have a key of their own in every row. An owner counts by its best fragment; of the k best owners, with
    equals of the last one, all fragments that attain its best are there. Scores are exact. Other rows may be there or not. Fragments
    with a null in their key count in frequencies and are not found. Texts are read as often as there are steps:
    for the counters, for the bounds, for the frequencies of what is left, and once or twice more if a task kept too few fragments.
    """
    spark = fragments.sparkSession
    if ARROW_BYTES not in spark.conf.getAll:
        spark.conf.set(ARROW_BYTES, str(4 << 20))
    by = list(dict.fromkeys([*corpus, *fragment]))
    named, numbered, n, numbers = _corpora(spark, query_counts, sizes, corpus)
    counts = [r for r in query_counts.collect() if tuple(r[c] for c in corpus) in numbers]  # few queries
    qids = sorted({r["qid"] for r in counts})
    names = [f"k{i}" for i in range(len(by))]
    live = F.lit(True)
    for c in by:
        live = live & F.col(c).isNotNull()
    rows = _spread(fragments.select(*dict.fromkeys([*by, *owner, "text"])))
    rows = rows.join(F.broadcast(named), corpus) if corpus else rows.withColumn("cid", F.lit(0))
    rows = rows.select(*[F.col(c).alias(x) for c, x in zip(by, names)], "cid", F.xxhash64(*owner).alias("own"), live.alias("live"), "text")

    place_of = {q: i for i, q in enumerate(qids)}
    query = np.array([place_of[r["qid"]] for r in counts], np.int64)
    cid = np.array([numbers[tuple(r[c] for c in corpus)] for r in counts], np.int64)
    key = _mixed(np.array([r["term"] for r in counts], np.int64), cid) if counts else np.zeros(0, np.uint64)
    wanted, first, place = np.unique(key, return_index=True, return_inverse=True)
    found = _counts(rows, wanted)
    asked = spark.sparkContext.broadcast(_Asked(wanted, found, n, cid[first], query, place, np.array([float(r["tf"]) for r in counts]), len(qids)))

    if k is None:
        whole = _bounds(rows, names, asked, None, np.full(len(qids), least - SLACK))
        scored = _exact(rows, names, stored(whole)[0], numbered)
    else:
        seen, _, _ = stored(_bounds(rows, names, asked, OWNERS * k))
        entries = seen.where("dot is not null")
        scored = _decided(rows, names, asked, entries, seen.where("dot is null"), numbered, len(qids), k, least)
    ids = spark.createDataFrame([(i, q) for i, q in enumerate(qids)], f"q int, qid {dict(query_counts.dtypes)['qid']}")
    return scored.join(F.broadcast(ids), "q").select("qid", *[F.col(x).alias(c) for c, x in zip(by, names)], "score")


def _decided(rows: DataFrame, names: list[str], asked, entries: DataFrame, out: DataFrame, sizes: DataFrame, queries: int, k: int, least: float | None) -> DataFrame:
    """Exact scores of all that can decide the ``k`` best owners, from what the tasks have kept (``entries``) and left ``out``."""
    reach = lambda rows, value: rows.groupBy("q", "own").agg(F.max(value).alias("best")).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("best"))))
    last = lambda best: best.groupBy("q").agg(F.coalesce(F.max(F.when(F.col("rank") == k, F.col("best"))), F.lit(0.0)).alias("last"))
    bounds, _, _ = stored(reach(entries, "bound"))
    near = entries.join(bounds.select("q", "own", "best"), ["q", "own"]).join(last(bounds), "q").where((F.col("bound") >= NEAR * F.col("best")) & (F.col("bound") >= NEAR * F.col("last")))
    first, _, _ = stored(near.select(*entries.columns))
    scored = _exact(rows, names, first, sizes)
    bests, _, _ = stored(reach(scored, "score"))
    floors = last(bests).withColumn("last", F.greatest("last", F.lit(least or 0.0)) - SLACK)
    floors, _, _ = stored(floors)
    own = bests.select("q", "own", (F.col("best") - SLACK).alias("best"))
    # what a task left out of an owner with EACH fragments is no better than the last of them
    full = entries.groupBy("q", "own", "task").agg(F.min("bound").alias("bound"), F.count("*").alias("n")).where(F.col("n") >= EACH)
    short = full.join(own, ["q", "own"], "left").join(floors, "q", "left").where((F.col("bound") >= F.coalesce("last", F.lit(0.0))) & (F.col("bound") >= F.coalesce("best", F.lit(0.0))))
    lost = out.join(floors, "q", "left").where(F.col("bound") >= F.coalesce("last", F.lit(0.0)))
    if short.select("q").unionAll(lost.select("q")).limit(1).count():
        floor = np.zeros(queries)
        for r in floors.collect():  # a row a query
            floor[r["q"]] = r["last"]
        known = own.collect()  # owners of what was worked out, as many as tasks keep
        key = _mixed(np.array([r["own"] for r in known], np.int64), np.array([r["q"] for r in known], np.int64)) if known else np.zeros(0, np.uint64)
        order = np.argsort(key)
        entries, _, _ = stored(_bounds(rows, names, asked, None, floor, (key[order], np.array([r["best"] for r in known])[order])))
    rest = entries.join(own, ["q", "own"], "left").join(floors, "q", "left").where((F.col("bound") >= F.coalesce("last", F.lit(0.0))) & (F.col("bound") >= F.coalesce("best", F.lit(0.0))))
    rest, n, _ = stored(rest.select(*entries.columns).join(first.select("q", *names), ["q", *names], "left_anti"))
    columns = ["q", *names, "score"]
    return scored.select(*columns).unionAll(_exact(rows, names, rest, sizes).select(*columns)) if n else scored.select(*columns)
