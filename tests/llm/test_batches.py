"""How much text goes to Python at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import common, decontaminate, packing, quality, simhash

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unlimited(spark):
    own = spark.conf.getAll.get(LIMIT)
    spark.conf.unset(LIMIT)
    yield spark
    spark.conf.unset(LIMIT) if own is None else spark.conf.set(LIMIT, own)


@pytest.mark.parametrize("name", ["decontaminate", "quality", "simhash", "packing"])
def test_long_texts_go_to_python_once_and_in_small_batches(unlimited, monkeypatch, name):
    docs = unlimited.range(0, 900, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), "id", F.lit(" ")), 1000).alias("text"))  # 8 MB in one partition

    def watched(rows, text="text", most=0, inner=common.batches):
        for batch in rows:
            texts = sum(pa.types.is_string(f.type) for f in batch.schema)
            assert texts == 1 and batch.nbytes < 5 << 20, (texts, batch.nbytes)
            yield from inner(iter([batch]), text)

    module = {"decontaminate": decontaminate, "quality": quality, "simhash": simhash, "packing": packing}[name]
    monkeypatch.setattr(module, "batches", watched)
    if name == "decontaminate":
        items = unlimited.createDataFrame([(1, "a passage of a benchmark that no document holds at all")], "item_id long, text string")
        out = decontaminate.mark(docs, items).where(F.size("matches") == 0).select(*docs.columns)
    elif name == "quality":
        out = quality.score(docs, np.zeros(quality.BUCKETS + 1)).where("score = 0.5").select(*docs.columns)
    elif name == "simhash":
        out = simhash.fingerprints(docs, 3).join(docs, "doc_id").select(*docs.columns)
    else:
        out = packing.pieces(docs).where("piece = 0").join(docs, "doc_id").select(*docs.columns)
    assert out.count() == 900 and out.exceptAll(docs).isEmpty()


def test_a_limit_of_the_session_stays(unlimited):
    unlimited.conf.set(LIMIT, "1m")
    common.bounded(unlimited.range(1))
    assert unlimited.conf.get(LIMIT) == "1m"


def test_texts_of_other_kinds_are_read_beside_the_kept_column(spark):
    docs = spark.createDataFrame([(1, bytearray(b"some words of a text")), (2, None)], "doc_id long, text binary")
    items = spark.createDataFrame([(7, "some words of a text")], "item_id long, text string")
    marked = {r.doc_id: r for r in decontaminate.mark(docs, items).collect()}
    assert bytes(marked[1].text) == b"some words of a text" and [m.item_id for m in marked[1].matches] == [7] and marked[2].text is None and marked[2].matches == []
    scored = quality.score(docs, np.zeros(quality.BUCKETS + 1))
    assert scored.columns == ["doc_id", "text", "score"] and {r.score for r in scored.collect()} == {0.5}


def test_candidates_do_not_depend_on_how_many_pairs_are_compared_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 50, 60)) for _ in range(40)]
    index = decontaminate.Items(list(enumerate(texts)))
    flat, cuts = decontaminate.word_hashes(pa.array(texts * 3))
    own = [decontaminate.shingles(flat[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    ends = np.concatenate([[0], np.cumsum([len(h) for h in own])]).astype(np.int64)
    found = list(index.candidates(np.concatenate(own), ends, 0.8))
    monkeypatch.setattr(decontaminate, "PAIRS", 1)
    assert len(found) >= 120 and list(index.candidates(np.concatenate(own), ends, 0.8)) == found
