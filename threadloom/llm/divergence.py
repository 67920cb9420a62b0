"""How the sources of a language differ in their terms; the terms that count are found by iceberg prefix refinement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.bytewords import distinct, letter_table, raw, words
from threadloom.llm.common import batches, stored
from threadloom.llm.suffix_dedup import filter_of, in_filter

END = b"\0"  # stands behind a complete term; no term holds it
FIRST = 8  # bytes of the first level's prefixes; every level doubles them
UNITS, PRIOR, FEW_GROUPS = 1_000_000_000, 5, 50_000
BATCH = 8 << 20


def _coded(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Pairs:
    """The different (language, term) pairs of a batch, and which one each of its words is; terms shorter than ``least`` bytes are left out."""

    def __init__(self, batch: pa.RecordBatch, least: int = 0):
        data, offsets = raw(batch.column(batch.schema.get_field_index("text")))
        codes, values, at = words(data, offsets, letter_table())
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
        lang, self.langs = _coded(batch.column(batch.schema.get_field_index("lang")))
        self.values, self.ends = values, np.frombuffer(values.buffers()[1], np.int64)[values.offset :][: len(values) + 1] if len(values) else np.zeros(1, np.int64)
        self.bytes = np.frombuffer(values.buffers()[2], np.uint8) if len(values) and values.buffers()[2] else np.zeros(0, np.uint8)
        if least:
            keep = (np.diff(self.ends) >= least)[codes]
            self.doc, codes = self.doc[keep], codes[keep]
        of_word = lang[self.doc] * max(len(values), 1) + codes
        if len(self.langs) * len(values) <= 1 << 25:
            seen = np.zeros(max(len(self.langs) * len(values), 1), bool)
            seen[of_word] = True
            found = np.flatnonzero(seen)
            place = np.cumsum(seen) - 1
            self.word = place[of_word]
        else:
            found, self.word = np.unique(of_word, return_inverse=True)
        self.lang, self.term = found // max(len(values), 1), found % max(len(values), 1)
        seeds = [xxhash.xxh64_intdigest(g) for g in self.langs.to_pylist()]
        self.seed = np.array(seeds, np.uint64)[self.lang] if seeds else np.empty(0, np.uint64)

    def narrow(self, keep: np.ndarray) -> None:
        """Go on with these pairs and their words alone."""
        place = np.where(keep, np.cumsum(keep) - 1, -1)
        word = place[self.word] if len(self.word) else self.word
        self.doc, self.word = self.doc[word >= 0], word[word >= 0]
        self.lang, self.term, self.seed = self.lang[keep], self.term[keep], self.seed[keep]

    def prefixes(self, length: int, pick: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The first ``length`` bytes of each pair's term, filled up with zeros, and 64 bits of them, of their number with the end mark, and of the language.

        The bits of a complete term are the same for every length that it has room in.
        """
        begin, size = self.ends[self.term[pick]], self.sizes(length)[pick]
        out = np.zeros((len(begin), -(-length // 8) * 8), np.uint8)
        for i in range(length):
            inside = np.flatnonzero(self.ends[self.term[pick] + 1] - begin > i)
            out[inside, i] = self.bytes[begin[inside] + i]
        key = self.seed[pick] ^ size.astype(np.uint64)
        for j, column in enumerate(out.view(np.uint64).T):
            key = np.where(size > 8 * j, _mixed(key * np.uint64(31) + _mixed(column)), key)
        return out, key.view(np.int64)

    def keys(self, first: int, longest: int) -> np.ndarray:
        """The same 64 bits of whole terms, by classes of length, so that no short term takes the room of a long one."""
        key, low, length = np.zeros(len(self.term), np.int64), 0, first
        while low < longest:
            pick = np.flatnonzero((self.sizes(length + 1) > low) & (self.sizes(length + 1) <= length))
            key[pick] = self.prefixes(length, pick)[1]
            low, length = length, 2 * length
        return key

    def sizes(self, length: int) -> np.ndarray:
        """Bytes of each prefix, with the end mark where the term is complete."""
        return np.minimum((self.ends[1:] - self.ends[:-1])[self.term] + 1, length) if len(self.term) else np.empty(0, np.int64)


def _survivors(docs: DataFrame, length: int, before: int, known, least: int) -> DataFrame:
    """(lang, prefix, key, docs): prefixes of ``length`` bytes with ``least`` documents or more.

    Terms that were complete on the level before are left out, and so are those whose prefix there fell away.
    A document counts once a prefix; each batch is summed before anything is shuffled.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, most=BATCH):
            pairs = Pairs(batch, before)
            if known is not None:
                pairs.narrow(in_filter(known.value, pairs.prefixes(before)[1]))
            shown, key = pairs.prefixes(length)
            # language, bytes and size together are exact; equal ones are found by hashing in Arrow
            exact = np.concatenate([pairs.lang.astype("<i4").view(np.uint8).reshape(-1, 4), pairs.sizes(length).astype("<i4").view(np.uint8).reshape(-1, 4), shown], axis=1)
            coded = pa.Array.from_buffers(pa.binary(exact.shape[1]), len(exact), [None, pa.py_buffer(np.ascontiguousarray(exact))]).dictionary_encode()
            number = coded.indices.to_numpy().astype(np.int64)
            n = len(coded.dictionary)
            first = np.empty(n, np.int64)
            first[number[::-1]] = np.arange(len(number))[::-1]
            _, found, _ = distinct(pairs.doc, number[pairs.word] if len(number) else pairs.word, max(n, 1))
            size = pairs.sizes(length)[first]
            flat = shown[first][np.arange(shown.shape[1]) < size[:, None]]
            prefix = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pairs.langs.take(pa.array(pairs.lang[first])).cast(pa.string()), prefix, pa.array(key[first]), pa.array(np.bincount(found, minlength=n), pa.int64())], ["lang", "prefix", "key", "docs"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, prefix binary, key long, docs long")
    return counted.groupBy("lang", "prefix", "key").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)


def kept_terms(docs: DataFrame, least: int = 30, first: int = FIRST) -> tuple[DataFrame, int, int]:
    """(lang, prefix, key) of every complete term in ``least`` documents of its language or more, how many they are, and the length of the last level.

    A term has no more documents than any of its prefixes. So prefixes are counted level by level, each twice as
    long as those before; those in too few documents fall away with all their terms, and only terms whose prefix
    stayed are looked at again. A term shorter than the level's length is complete there, told by an end mark, and its
    count is final. It ends when no incomplete prefix is left. The way from a level to the next is a bitmap of
    bounded size over hashes of the prefixes: where it lets a prefix through by chance, that one is counted like
    the others and falls away by its exact count.
    """
    spark, known, before, length, kept, total = docs.sparkSession, None, 0, first, None, 0
    while True:
        alive, n, _ = stored(_survivors(docs, length, before, known, least))
        complete = F.substring("prefix", -1, 1) == F.lit(END)
        done, open_ = alive.where(complete), alive.where(~complete)
        kept = done if kept is None else kept.unionAll(done)
        left = open_.count() if n else 0
        total += n - left
        if not left:
            return kept.select("lang", "prefix", "key"), total, length
        known = spark.sparkContext.broadcast(filter_of(open_.select("key"), left))  # of bounded size
        before, length = length, 2 * length


def term_counts(docs: DataFrame, kept: DataFrame, total: int, first: int, longest: int) -> DataFrame:
    """(lang, source, term, n): how often each kept term occurs in each group; terms that do not occur have no row.

    ``longest`` is the length of the last level, which all kept terms and their end marks have room in.
    """
    known = docs.sparkSession.sparkContext.broadcast(filter_of(kept.select("key"), total))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, most=BATCH):
            pairs = Pairs(batch)
            pairs.narrow(pairs.sizes(longest + 1) <= longest)
            pairs.narrow(in_filter(known.value, pairs.keys(first, longest)))
            source, sources = _coded(batch.column(batch.schema.get_field_index("source")))
            if len(sources) * len(pairs.term) <= 1 << 24:
                n = np.bincount(source[pairs.doc] * max(len(pairs.term), 1) + pairs.word, minlength=1)
                found = np.flatnonzero(n)
                group, pair, n = found // max(len(pairs.term), 1), found % max(len(pairs.term), 1), n[found]
            else:
                group, pair, n = distinct(source[pairs.doc], pairs.word, len(pairs.term))
            terms = pairs.values.take(pa.array(pairs.term)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pairs.langs.take(pa.array(pairs.lang[pair])).cast(pa.string()), sources.take(pa.array(group)).cast(pa.string()), terms.take(pa.array(pair)), pa.array(n, pa.int64())], ["lang", "source", "term", "n"])

    counted = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term binary, n long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    names = kept.select("lang", F.expr("substring(prefix, 1, length(prefix) - 1)").alias("term"))
    return counted.join(names, ["lang", "term"]).select("lang", "source", F.col("term").cast("string").alias("term"), "n")


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNITS * (n + PRIOR) / (total + PRIOR * terms)), exact for any count; null without terms."""
    d = lambda c: c.cast("decimal(38,0)")
    over = d(total) + F.lit(PRIOR).cast("decimal(5,0)") * terms.cast("decimal(20,0)")
    part = F.call_function("div", F.lit(UNITS).cast("decimal(10,0)") * (n.cast("decimal(20,0)") + PRIOR), F.nullif(over, d(F.lit(0))))
    return (1 + part).cast("long")


def audit(docs: DataFrame, least: int = 30, top: int = 50, first: int = FIRST) -> DataFrame:
    """How each (lang, source) group differs from the other sources of its language, and by which terms.

    Columns lang, source, part, item, value, rank: ``pair`` rows compare the group with every other source of its language by the sum
    of the differences of their shares over all kept terms; ``term`` rows are the group's ``top`` terms whose share is
    above the language's. Ties go to the item that is first in UTF-8.

    Differences are summed over terms that both sources have; what terms of one source alone add follows from its
    own shares and the share that the other one gives to terms it lacks, and terms of neither add one number times
    their count. So no row is made for a term that a group does not have.

    Null lang, source or text is an empty text. Every row is a document, repeated ones too. Groups without terms
    have their rows; an empty table gives none.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(empty("lang"), empty("source"), empty("text"))
    kept, total, longest = kept_terms(docs, least, first)
    counts, _, _ = stored(term_counts(docs, kept, total, first, longest))
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("all"), F.count("*").alias("own"))
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("_")).drop("_").join(sums, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("all", "own", "v")])
    groups = groups.withColumn("zero", F.coalesce(_share(F.lit(0), F.col("all"), F.col("v")), F.lit(0)).cast("long"))
    groups, n_groups, _ = stored(groups)
    small = F.broadcast if n_groups <= FEW_GROUPS else lambda x: x
    shares, _, _ = stored(counts.join(small(groups), ["lang", "source"]).select("lang", "source", "term", "zero", _share(F.col("n"), F.col("all"), F.col("v")).alias("p")))

    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("zero2"), F.col("own").alias("own2"))
    pairs = groups.join(small(other), "lang").where("source <> item")
    both = shares.join(shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"), F.col("zero").alias("zero2")), ["lang", "term"]).where("source < item")
    d = lambda a, b: F.abs(F.col(a) - F.col(b))
    both = both.groupBy("lang", "source", "item").agg(F.sum(d("p", "p2") - d("p", "zero2") - d("zero", "p2") + d("zero", "zero2")).alias("both"))
    both = both.unionAll(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "both"))
    alone = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).join(small(other.select("lang", "item", "zero2")), "lang").where("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(F.sum(F.col("n") * d("p", "zero2")).alias("alone"))
    keys, zero = ["lang", "source", "item"], F.lit(0).cast("long")
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("back"))
    value = F.coalesce("alone", zero) + F.coalesce("back", zero) + F.coalesce("both", zero) + (F.col("v") - F.col("own") - F.col("own2")) * d("zero", "zero2")
    compared = pairs.join(alone, keys, "left").join(back, keys, "left").join(both, keys, "left").select(*keys, value.alias("value"))

    language = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    all_of = counts.groupBy("lang").agg(F.sum("n").alias("all")).join(terms, "lang")
    q = language.join(F.broadcast(all_of) if n_groups <= FEW_GROUPS else all_of, "lang").select("lang", "term", _share(F.col("n"), F.col("all"), F.col("v")).alias("q"))
    above = shares.join(q, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(compared, "pair").unionAll(ranked(above, "term").where(F.col("rank") <= top))
