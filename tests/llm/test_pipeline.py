"""The stages of the corpus pipeline against plain versions, on planted cases, odd rows and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from test_training_data import edited, prose
from threadloom.llm import simhash
from threadloom.llm.common import sifted

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "score string, matches int, own_key string, _text string, _key long, key string, other_id int, found_spans string, whole_text string, n_rows int, root string, tag int"


def write(spark, folder, documents, labels, items):
    folder.mkdir()
    for name, rows, schema in (("documents", documents, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def row(i, text):
    return (i, text, "en", f"s{(i or 0) % 3}", None if text is None else len(text))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean documents 0 to 59, junk 100 to 159, copies 200 to 209 of 0 to 9, near copies 210 to 219 of 10 to 19, leaks 300 to 309, secrets 400 to 404."""
    rng = random.Random(17)
    good = lambda n: prose(rng, n).capitalize() + "."
    texts = {i: good(rng.randint(80, 160)) for i in range(60)}
    texts |= {i: prose(rng, rng.randint(40, 90)).upper().replace(" ", "!! ") for i in range(100, 160)}
    texts |= {200 + i: texts[i] for i in range(10)} | {210 + i: edited(rng, texts[10 + i], 1) for i in range(10)}
    items = {i: good(rng.randint(30, 60)) for i in range(10)}
    texts |= {300 + i: f"{good(40)} {items[i]} {good(30)}" for i in range(10)}
    texts |= {400 + i: f"{good(60)} password = hunter{i}hunter{i}hunter {good(20)}" for i in range(5)}
    texts |= {500: good(3000)}
    labels = [(i, int(t[1:2].islower()), 0) for i, t in texts.items() if i % 5]
    return texts, items, write(spark, tmp_path_factory.mktemp("pipeline") / "sf", [row(i, t) for i, t in texts.items()], labels, list(items.items()))


def test_all_stages(spark, corpus):
    texts, items, sf_dir = corpus
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        kept[name] = {r.doc_id: r for r in docs.collect()}
    clean = {i for i in texts if not 100 <= i < 160}
    assert set(kept["quality"]) == clean
    roots = brute.jaccard_groups({i: texts[i] for i in clean})
    assert set(kept["near_duplicates"]) == set(roots.values()) == clean - set(range(200, 220))
    leaked = {i for i in kept["near_duplicates"] if any(brute.holds(texts[i], t) for t in items.values())}
    assert leaked == set(range(300, 310)) and set(kept["decontamination"]) == set(kept["near_duplicates"]) - leaked
    for i, r in kept["secrets"].items():
        assert r.text == texts[i] if i < 400 or i >= 500 else "[SECRET]" in r.text and "hunter" not in r.text
        assert r.n_chars == len(r.text)
    assert set(kept["packing"]) == set(kept["secrets"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()} == set(kept["secrets"])


def test_odd_rows_pass_through_all_stages(spark, corpus):
    texts, _, sf_dir = corpus
    rows = [row(None, None), row(None, ""), row(None, texts[3]), row(3, texts[3]), row(3, texts[3]), row(7, None), row(8, " \n "), row(9, "x"), row(11, texts[11]), row(11, texts[12]), row(500, texts[500])]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = [c.split()[0] for c in CLASHES.split(", ")]
    docs = docs.select("*", *[F.lit("7").cast(c.split()[1]).alias(c.split()[0]) for c in CLASHES.split(", ")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        found = out.collect()
        assert all(str(r[c]) == "7" for r in found for c in names)
        if name == "near_duplicates":
            # empties are one group, as are the copies of document 3 with and without an id
            assert sorted((r.doc_id, (r.text or "").strip()[:20]) for r in found) == sorted([(3, texts[3][:20]), (7, ""), (9, "x"), (11, texts[11][:20]), (11, texts[12][:20]), (500, texts[500][:20])])
        elif name in ("decontamination", "secrets"):
            assert len(found) == len(rows)
    pieces = corpus_pipeline.packing_stage(spark, docs, sf_dir).collect()
    assert len({(r.sequence_id, r.offset) for r in pieces}) == len(pieces) >= len(rows)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_of_empty_tables(spark, corpus, tmp_path, stage):
    none = write(spark, tmp_path / "sf", [], [], [])
    docs = spark.createDataFrame([], SCHEMA)
    assert stage(spark, docs, corpus[2]).count() == 0 and stage(spark, docs, none).count() == 0


def test_one_row_of_equal_or_missing_ids_stays(spark):
    rng = random.Random(3)
    base = prose(rng, 200)
    for ids in ((5, 5), (None, None), (None, 5), (5, None)):
        docs = spark.createDataFrame([(ids[0], base, "a"), (ids[1], edited(rng, base, 1), "b")], "doc_id long, text string, lang string")
        kept = simhash.keep_first(docs).collect()
        assert [r.doc_id for r in kept] == [5 if 5 in ids else None]


def test_recall_of_pairs_near_the_threshold(spark):
    rng = random.Random(77)
    texts = {}
    for k in range(300):  # four of 200 words changed: similarity 0.8 to 0.85
        texts[2 * k] = prose(rng, 200)
        texts[2 * k + 1] = edited(rng, texts[2 * k], 4)
    texts |= {1000 + i: prose(rng, 200) for i in range(50)}
    pairs = [k for k in range(300) if brute.jaccard(texts[2 * k], texts[2 * k + 1]) >= 0.8]
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    found = sum(got[2 * k] == got[2 * k + 1] for k in pairs)
    assert len(pairs) > 250 and found >= 0.9 * len(pairs), (found, len(pairs))
    assert all(got[d] == d or d % 2 and got[d] == d - 1 for d in texts)  # nothing else is linked


def test_only_texts_that_a_key_asks_for_go_on_to_a_join(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("h"), F.col("id").alias("bucket"))
    wanted = {r.h for r in rows.where("bucket % 50 = 0").collect()}
    for most, largest in ((28, 1_000), (10, 10_000)):  # at its bound the bitmap lets more through, and loses none
        met, rest = (part.collect() for part in sifted(rows, "h", rows.where("bucket % 50 = 0").select("h"), len(wanted), most))
        assert wanted <= {r.h for r in met} and len(met) < largest and len(met) + len(rest) == 20_000
        assert {tuple(r) for r in [*met, *rest]} == {tuple(r) for r in rows.collect()}
    met, rest = sifted(rows, "h", rows.limit(0).select("h"), 0)
    assert met.count() == 0 and rest.count() == 20_000


def test_texts_that_are_not_judged_are_not_shuffled(spark):
    rng = random.Random(5)
    docs = spark.createDataFrame([row(i, prose(rng, 60)) for i in range(400)] + [row(1000, prose(rng, 60)), row(1001, None), row(1002, "")], SCHEMA)
    kept = simhash.keep_first(docs)
    assert {r.doc_id for r in kept.collect()} == set(range(400)) | {1000, 1001}
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    first = plan.strip().split("\n")
    assert first[0].startswith("Union") and sum(line.startswith(("+- ", ":- ")) for line in first) == 3
