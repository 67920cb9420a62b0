"""The build in its two forms: step by step for all dialogs, and as a fold over a dialog's batches."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from threadloom.operators import build, qa
from threadloom.sources import store
from threadloom.streaming import build as stream
from threadloom.streaming import instances

SCHEMA = "dialog bigint, step bigint, label bigint, message string, context string"
WORDS = ["river", "boat", "lake", "stone", "bread", "flour", "oven", "salt", "engine", "wheel", "brake", "the", "of", "x", "été", "日本"]


def rows(seed=1, dialogs=3, steps=3):
    rng, out = random.Random(seed), []
    for d in range(dialogs):
        label = 0
        for s in range(rng.randint(1, steps)):
            for _ in range(rng.randint(1, 5)):
                label += 1
                topic = rng.randrange(3) * 4
                text = " ".join(rng.choice(WORDS[topic : topic + 4] + WORDS[11:]) for _ in range(rng.randint(0, 6)))
                out.append((d, s, label, text if label % 9 else "", "" if s % 2 else "river talk"))
    return out


def plain(state):
    return sorted((r.dialog, r.class_no, r.instance_no, r.class_name, tuple(r.labels), r.text, r.step) for r in state.collect())


@pytest.mark.parametrize(("threshold", "most"), [(0.1, 3), (0.5, 1)])
def test_fold_gives_what_the_steps_give(spark, tmp_path, threshold, most):
    messages = spark.createDataFrame(rows(), SCHEMA)
    assert plain(stream.fold(messages, threshold, most)) == plain(build.build(messages, threshold, most))


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    made, folder = rows(3), str(tmp_path)
    wanted = plain(build.build(spark.createDataFrame(made, SCHEMA), 0.1, 3))
    for k, (low, high) in enumerate([(0, 2), (2, 9), (9, 9)]):  # the last start has nothing new
        spark.createDataFrame([r for r in made if low <= r[1] < high], SCHEMA).write.mode("append").parquet(f"{folder}/in")
        state = stream.advance(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), f"{folder}/out", "a", 0.1, 3)
        assert plain(state) == [r for r in wanted if r[-1] < high], k
    assert plain(stream.snapshot(spark, f"{folder}/out", 0)) == [r for r in wanted if r[-1] < 2]
    assert plain(stream.since(spark, f"{folder}/out", 0)) == [r for r in wanted if r[-1] >= 2]
    with pytest.raises(ValueError, match="another source"):
        stream.advance(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), f"{folder}/out", "b", 0.1, 3)


def test_rows_of_finished_steps_change_nothing(spark, tmp_path):
    made, folder = rows(5, 2, 2), str(tmp_path)
    for _ in range(2):
        spark.createDataFrame(made, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        state = plain(stream.advance(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), f"{folder}/out", "a", 0.1, 3))
    assert state == plain(build.build(spark.createDataFrame(made, SCHEMA), 0.1, 3))


@pytest.mark.parametrize("died", ["steps", "terms"])
def test_a_step_that_died_in_its_commit_is_done_again(spark, tmp_path, died):
    messages, folder = spark.createDataFrame(rows(2), SCHEMA), str(tmp_path / "b")
    wanted = plain(build.build(messages, 0.1, 3))
    build.build(messages, 0.1, 3, folder, upto=2)
    fs = lambda p: store.remove(spark, p)
    assert fs(f"{folder}/terms/000001/_SUCCESS")
    if died == "steps":
        assert fs(f"{folder}/steps/000001/_SUCCESS") and fs(f"{folder}/terms/000001")
    assert build.done_steps(spark, folder) == 1
    assert plain(build.build(messages, 0.1, 3, folder)) == wanted
    assert plain(build.build(messages, 0.1, 3, folder)) == wanted  # nothing is left to do


def test_a_folder_refuses_another_source(spark, tmp_path):
    folder = str(tmp_path / uuid.uuid4().hex)
    messages = spark.createDataFrame(rows(2), SCHEMA)
    build.build(messages, 0.1, 3, folder, upto=1)
    for other, threshold in ((messages.withColumn("message", F.upper("message")), 0.1), (messages, 0.2)):
        with pytest.raises(ValueError, match="another source"):
            build.build(other, threshold, 3, folder)


def test_builds_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert build.build(none).count() == 0 and stream.fold(none).count() == 0


@pytest.mark.parametrize("merging", [False, True])
def test_instances_without_classes_over_a_stream(spark, tmp_path, merging):
    class Merging(instances.Plain):
        """One instance of all that is new, named by its first message."""

        def create(self, messages, context):
            return [(f"[{context}] {messages[0]}", list(range(len(messages))))]

    writer = Merging if merging else instances.Plain
    made, folder = rows(7, 2, 3), str(tmp_path)
    whole = instances.fold(spark.createDataFrame(made, SCHEMA), 0.3, writer)
    wanted = sorted(tuple(map(str, r)) for r in instances.latest(whole).collect())
    for k, (low, high) in enumerate([(0, 2), (2, 9)]):
        spark.createDataFrame([r for r in made if low <= r[1] < high], SCHEMA).write.mode("append").parquet(f"{folder}/in")
        stream_ = instances.fold(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), 0.3, writer)
        stream_.writeStream.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{folder}/out/{k}.{epoch}")).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()  # noqa: B023
    found = instances.latest(spark.read.schema(instances.STATE).parquet(f"{folder}/out/*"))
    assert sorted(tuple(map(str, r)) for r in found.collect()) == wanted
    numbers = {}
    for r in found.collect():
        numbers.setdefault(r.dialog, []).append(r.instance_no)
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in numbers.values())


def test_answers_are_asked_once(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    class Client:
        def complete(self, prompt):
            (asked / f"{prompt}-{uuid.uuid4().hex}").touch()
            if prompt == "3":
                raise OSError
            return f'{{"response": "a{prompt}"}}'

    questions, folder = spark.createDataFrame([(i, str(i)) for i in range(6)], "qid bigint, prompt string"), str(tmp_path / "out")
    qa.answers(questions.where("qid < 4"), folder, "a", Client, 1)
    store.remove(spark, f"{folder}/answers/000000/_SUCCESS")  # the first go died in its commit
    assert {r.qid for r in qa.answers(questions.where("qid < 2"), folder, "a", Client, 1).collect()} == {0, 1}
    found = {r.qid: r.answer for r in qa.answers(questions, folder, "a", Client, 1).collect()}
    assert found == {i: "" if i == 3 else f"a{i}" for i in range(6)}
    calls = [p.name.split("-")[0] for p in asked.iterdir()]
    assert sorted(calls) == sorted("0123" + "01" + "2345")
    with pytest.raises(ValueError, match="another source"):
        qa.answers(questions, folder, "b", Client)
