"""Readers and writers of files, on small files written here."""

import json

from pyspark.sql import functions as F

from threadloom.sources import conversations as src
from threadloom.sources import store


def test_questions(spark, tmp_path):
    rows = [
        {"question": "who?", "answer": "Ann", "evidence": ["D1:2"], "category": 1},
        {"question": "not?", "answer": None, "adversarial_answer": "nobody", "category": 5},
        {"question": "both?", "answer": "a", "adversarial_answer": "b", "category": 2},
    ]
    (tmp_path / "qa.json").write_text(json.dumps(rows))
    got = {r.question: (r.gold, r.category) for r in src.read_questions(spark, str(tmp_path / "qa.json")).collect()}
    assert got == {"who?": ("Ann", 1), "not?": ("nobody", 5), "both?": ("b", 2)}


def test_users(spark, tmp_path):
    user = {"uuid": "u1", "persona_info": "Name: X", "sessions": [{"dialogue": [{"timestamp": "t", "role": "user", "content": "hi"}], "memory_points": [{"memory_content": "m", "is_update": "True", "original_memories": []}], "questions": [{"question": "q", "extra": 1}]}]}
    (tmp_path / "users.jsonl").write_text(json.dumps(user) + "\n\n" + json.dumps({"uuid": "u2", "sessions": []}) + "\n")
    got = {r.uuid: len(r.sessions) for r in src.read_users(spark, str(tmp_path / "users.jsonl")).collect()}
    assert got == {"u1": 1, "u2": 0}


def test_registry(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"comment": "x", "sessions": [{"conv_id": "c0", "conv_json": "a", "qa_json": "b", "num_messages": 419}, {"conv_id": "c1"}]}, indent=1))
    assert [(r.conv_id, r.num_messages) for r in src.read_registry(spark, str(tmp_path / "r.json")).orderBy("conv_id").collect()] == [("c0", 419), ("c1", None)]


def test_records_are_added(spark, tmp_path):
    for k in range(2):
        src.append_records(spark.range(3).select((F.col("id") + 10 * k).alias("call")), str(tmp_path / "log"))
    assert sorted(r.call for r in spark.read.json(str(tmp_path / "log")).collect()) == [0, 1, 2, 10, 11, 12]


def test_files_that_do_not_parse(spark, tmp_path):
    (tmp_path / "conv1.json").write_text('{"session_1": [{"speaker": "A", "text": "hi"}]}')
    (tmp_path / "conv2.json").write_text('{"session_1": [')
    got = sorted((r.name, r.session, r.text) for r in src.read_conversations(spark, str(tmp_path)).na.fill(-1, ["session"]).na.fill("", ["text"]).collect())
    assert got == [("conv1", 1, "hi"), ("conv2", -1, "")]


def test_saved_states_are_removed_and_merged(spark, tmp_path):
    at = str(tmp_path / "s")
    for name in ("a", "b"):
        spark.createDataFrame([(name,)], "n string").write.json(f"{at}/{name}")
    (tmp_path / "s" / "open").mkdir()
    (tmp_path / "s" / "open" / "part.json").write_text('{"n": "unfinished"}')
    assert sorted(r.n for r in store.merged_lines(spark, at, "n string").collect()) == ["a", "b"]
    assert store.remove(spark, f"{at}/a") and not store.remove(spark, f"{at}/a")
    assert [r.n for r in store.merged_lines(spark, at, "n string").collect()] == ["b"]
    assert store.merged_lines(spark, str(tmp_path / "none"), "n string").count() == 0
