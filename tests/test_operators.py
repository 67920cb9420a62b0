"""Hand-computed cases and properties of the reference's operators."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import json_repair, model
from threadloom.functions import replies as rp
from threadloom.functions import text as tx
from threadloom.functions import vectors as vx
from threadloom.operators import build as bd
from threadloom.operators import cover, ingest, ranking
from threadloom.operators import edges as ed
from threadloom.operators import evaluation as ev
from threadloom.operators import expand as ex
from threadloom.operators import graph as gr
from threadloom.sources import conversations as src
from threadloom.sources import store


def test_labels_batches_and_contexts(spark):
    turns = spark.createDataFrame([(1, s, t, "a", "x") for s, n in ((1, 23), (2, 4)) for t in range(n)], "dialog long, session long, turn long, speaker string, text string")
    rows = sorted(ingest.batch_context(ingest.label(turns)).collect(), key=lambda r: r.first_label)
    assert [r.n_messages for r in rows] == [10, 10, 3, 4]
    assert [r.context for r in rows] == [[], [8, 9, 10], [18, 19, 20], []]
    assert rows[-1].last_label == 27


def test_star_expansion(spark):
    h = spark.createDataFrame([(1, ["c2:i1", "c1:i3", "c1:i1", None]), (2, ["c1:i1", "c1:i1"])], "label long, connections array<string>").withColumn("members", ed.entities(F.col("connections")))
    got = {(r.src, r.dst) for r in ed.star(h, ["label"]).collect()}
    assert got == {("c1:i1", "c1:i3"), ("c1:i1", "c2:i1")}
    assert gr.acyclic(ed.star(h, ["label"]))


def test_oriented_pairs_override_the_star(spark):
    h = spark.createDataFrame([(1, ["a", "b"], [("b", "a"), ("b", "b")]), (2, ["a", "c"], []), (3, ["d"], None)], "label long, members array<string>, pairs array<struct<src:string,dst:string>>")
    assert {(r.label, r.src, r.dst) for r in ed.oriented(h, ["label"]).collect()} == {(1, "b", "a"), (2, "a", "c")}


@pytest.mark.parametrize(("values", "wanted"), [([2, 4, 3], [0, 1, 0.5]), ([5, 5], [0.5, 0.5]), ([], [])])
def test_min_max(spark, values, wanted):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    rows = vx.min_max(rows, [], s=F.col("v"))
    assert [r.s for r in sorted(rows.collect())] == wanted


def test_idf(spark):
    counts = spark.createDataFrame([(f, "t3", 1) for f in (1, 2, 3)] + [(1, "t1", 1)], "f int, term string, tf long")
    got = {r.term: r.idf for r in tx.idf(counts, spark.createDataFrame([(4,)], "n long"), []).collect()}
    assert set(got) == {"t1"} and math.isclose(got["t1"], math.log(5 / 2) + 1)


def test_single_fragment_keeps_its_terms(spark):
    counts = spark.createDataFrame([(1, "t", 1)], "f int, term string, tf long")
    assert tx.idf(counts, spark.createDataFrame([(1,)], "n long"), []).count() == 1


def test_cross_class_sweep_over_blocks(spark):
    rows = spark.createDataFrame([(label, f"c{i % 3}", i) for label in (1, 2, 3) for i in range(40)], "label long, c string, i long")
    whole = {(r.u, r.v): (r.shared, r.label) for r in ed.cross_class_pairs(rows, "label", "c", "i").collect()}
    assert whole == {(i, j): (3, "1,2,3") for i in range(40) for j in range(i + 1, 40) if i % 3 != j % 3}
    assert {(r.u, r.v): (r.shared, r.label) for r in ed.cross_class_pairs(rows, "label", "c", "i", block=7).collect()} == whole


def test_judge_labels(spark):
    cases = [('Well {"label": "CORRECT"}', "CORRECT"), ("so\nWRONG", "WRONG"), ("not correct", "WRONG"), ("", "WRONG"), (None, "WRONG"), ("This is correct.", "WRONG"), ("It is correct, I think", "WRONG"), ("one\n correct \ntwo", "CORRECT"), ("CORRECT\nWRONG\n\n", "WRONG"), ('"label": "wrong"\nCORRECT', "WRONG"), ("wrong", "WRONG"), ('{"label": "maybe"}\nCORRECT', "CORRECT"), ("{'label': 'CORRECT'}", "CORRECT"), ('```json\n{"label": "correct",}\n```\nWRONG', "CORRECT"), ('{"why": "no {braces}", "label": " wrong "}\nCORRECT', "WRONG"), ('{"label": "CORRECT", "why": "cut', "CORRECT"), ("{broken\nCORRECT", "CORRECT"), ('{"label": null}', "WRONG")]
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(cases)], "i int, a string").withColumn("l", ev.judge_label(F.col("a")))
    assert [r.l for r in sorted(rows.collect(), key=lambda r: r.i)] == [w for _, w in cases]


def test_keywords_drop_possessives_and_outer_marks(spark):
    row = spark.createDataFrame([("What did Audrey\u2019s (and Bob's) dog-house cost, \"then\" then?",)], "q string").select(tx.keywords(F.col("q")).alias("k"), tx.keyword_hits(F.array(F.lit("audrey x"), F.lit("bob")), F.lit("Audrey\u2019s x and BOB's")).alias("n")).first()
    assert (row.k, row.n) == (["audrey", "bob", "dog-house", "cost", "then"], 2)


def test_message_texts(spark):
    row = spark.range(1).select(ingest.render(F.lit("A"), F.lit("hi"), F.lit(None).cast("string")).alias("plain"), ingest.render(F.lit("A"), F.lit("hi"), F.lit("10:00"), F.lit("u"), F.lit("cats"), F.lit(None).cast("string")).alias("image")).first()
    assert row.plain == '【A said: "hi Dialogue time:未知时间】'
    assert row.image == "【A sent an image: cats. Image content: No description. Dialogue: hi Dialogue time:10:00】"


@pytest.mark.parametrize(("most", "kept"), [(120, 2), (0, 3), (10, 0)])
def test_budget(spark, most, kept):
    blocks = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate((50, 60, 60))], "q int, i int, t string")
    assert ingest.within_budget(blocks, "q", "i", "t", most).count() == kept


def test_cross_class_sweep_is_idempotent(spark):
    rows = spark.createDataFrame([(1, "c1", 1), (2, "c1", 1), (1, "c1", 2), (2, "c1", 2), (1, "c2", 3), (2, "c2", 3), (1, "c3", 4)], "label long, c string, i long")
    found = ed.cross_class_pairs(rows, "label", "c", "i")
    assert {(r.u, r.v) for r in found.collect()} == {(1, 3), (2, 3)}
    assert ed.cross_class_pairs(rows, "label", "c", "i", known=found).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 100 + i) for i in range(50)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in gr.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(50)) and got[1000] == 100
    assert gr.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert gr.acyclic(e) and not gr.acyclic(e.unionAll(spark.createDataFrame([(3, 1)], "src long, dst long")))
    got = {(r.src, r.dst): r.cycle for r in gr.creates_cycle(e, spark.createDataFrame([(3, 1), (1, 3), (1, 1), (1, 2)], "src long, dst long")).collect()}
    assert got == {(3, 1): True, (1, 3): False, (1, 1): True, (1, 2): False}


def test_expansion(spark):
    near = spark.createDataFrame([(a, b) for x, y in ((1, 2), (2, 3), (3, 4)) for a, b in ((x, y), (y, x))], "node long, near long")
    got = {(r.node, r.hop) for r in gr.expand(spark.createDataFrame([(1,)], "node long"), near, 2).collect()}
    assert got == {(2, 1), (3, 2)}


def test_communities_split_two_cliques(spark):
    pairs = [(a, b, 1.0) for g in (range(5), range(10, 15)) for a in g for b in g if a < b] + [(0, 10, 0.1)]
    e = spark.createDataFrame(pairs, "u long, v long, weight double")
    place = gr.communities(e)
    got = {r.node: r.community for r in place.collect()}
    assert {got[i] for i in range(5)} == {0} and {got[i] for i in range(10, 15)} == {10}
    assert gr.modularity(e, place).first()[0] > 0.4


def test_set_cover(spark):
    held = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "b"), (1, 2, "c"), (1, 3, "c"), (1, 4, "a")], "qid long, doc long, keyword string")
    got = {(r.combo, r.place): r.doc for r in cover.set_cover(held).collect()}
    assert got[1, 1] == 1 and got[1, 2] == 3 and got[2, 1] == 2 and got[2, 2] == 4


def test_ranking_back_fill_and_ties(spark):
    s = spark.createDataFrame([(1, 3, 0.9), (1, 1, 0.2), (1, 2, 0.2)], "q int, d int, score double")
    assert [r.d for r in sorted(ranking.top(s, ["q"], 2, ["d"], threshold=0.5).collect(), key=lambda r: r.rank)] == [3, 1]
    assert ranking.top(s, ["q"], 2, ["d"], threshold=0.5, backfill=False).count() == 1


def test_pairs_and_nearest_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((40, 5))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, e array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    wanted = {(i, j) for i in range(40) for j in range(i + 1, 40) if round(float(unit[i] @ unit[j]), 6) >= 0.5}
    assert {(r.u, r.v) for r in vx.similar_pairs(rows, "k", "e", 0.5, 4).collect()} == wanted
    near = {r.a: r.b for r in vx.nearest(rows.where("k < 10"), rows.where("k >= 10"), "k", "e", 3).collect()}
    assert near == {i: int(10 + np.argmax(np.round(unit[10:] @ unit[i], 6))) for i in range(10)}


@pytest.mark.parametrize("text", ['```json\n{"a": 1}\n```', '{"a": 1,}', "{'a': 1}", '{"a": 1', 'Sure: {"a": 1} done', '{"a": 1, "b'])
def test_json_repair(text):
    assert json.loads(json_repair.repair(text))["a"] == 1


@pytest.mark.parametrize("text", [None, "", "nothing here"])
def test_json_beyond_repair(text):
    assert json_repair.repair(text) is None


def test_model_calls_keep_rows(spark):
    class Down:
        def complete(self, prompt):
            raise OSError

    rows = spark.createDataFrame([(i, f"p{i}") for i in range(50)], "i int, p string")
    assert {r.status for r in model.ask(rows, "p", Down).collect()} == {"empty"}
    cases = [('{"a": 1}', "ok"), ('{"a": ', "bad_json"), ("", "empty"), (None, "empty"), ('```json\n{"a": 1}\n```', "ok"), ('{"a": 1,}', "ok"), ("{'a': 1}", "bad_json"), (" \n", "empty"), ('so [{"a": "it\\\'s"},] it is', "ok"), ("7", "bad_json")]
    replies = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p string")
    found = sorted(model.ask(replies, "p", model.Recorded).collect())
    assert [r.status for r in found] == [w for _, w in cases]
    assert [r.answer for r in found if r.status == "ok"] == ['{"a": 1}'] * 3 + ['[{"a": "it\'s"}]'] and found[1].answer == '{"a": '


def test_instances_of_replies(spark):
    one = '{"instance_name": "n", "attributes": {"k": {"description": "d", "value": "v", "occurred": "o", "recorded_at": "r"}}, "operations": {"go": {"description": "x"}}, "message_labels": ["1"]}'
    cases = [(one, 1), (f"[{one}, 3, {one}]", 2), ("[7]", 0), ("{}", 0), ('{"attributes": {}}', 1), ('{"instances": []}', 0), ('{"instances": "none"}', None), ('{"other": 1}', None), ("no", None), (None, None), (f'{{"instances": [{one}, "x"]}}', 1)]
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, r string").select("i", rp.instances(F.col("r")).alias("x"))
    found = [r.x for r in sorted(rows.collect())]
    assert [None if x is None else len(x) for x in found] == [n for _, n in cases]
    assert found[0][0].attributes["k"].occurred == "o" and found[0][0].operations["go"].description == "x" and found[0][0].message_labels == ["1"]


def test_decisions_of_batches(spark):
    reply = '{"decisions": [{"index": 0, "relation": "u_before_v"}, {"index": "1", "relation": "v_before_u"}, {"relation": "u_before_v"}, {"index": 2, "relation": "u_before_v"}, {"index": 2, "relation": "none"}]}'
    rows = spark.createDataFrame([(i,) for i in range(4)], "i int").select("i", rp.relation(F.lit(reply), F.col("i"), F.lit("u"), F.lit("v")).alias("e"))
    assert [r.e and tuple(r.e) for r in sorted(rows.collect())] == [("u", "v"), ("v", "u"), None, None]


@pytest.mark.parametrize(("text", "most", "kept"), [("", 5, ""), ("abc", 0, "abc"), ("abcdef", 3, "abcdef"), ("  \n abcdef", 2, "  \n abcdef"), ("\n─── instance 1: abc", 10, "\n─── insta"), ("x\n─── instance 1: a\n─── instance 2: b", 25, "x\n─── instance 1: a"), ("x\n─── instance 1: a\n─── instance 2: b", 10, "x"), ("x\n─── instance 1: a\n─── instance 2: bb\n─── instance 3: c", 37, "x\n─── instance 1: a")])
def test_contexts_end_with_whole_instances(spark, text, most, kept):
    got = spark.createDataFrame([(text,)], "t string").select(ex.cut_context(F.col("t"), most).alias("c")).first().c
    assert got == kept == plain_cut(text, most)


def plain_cut(text, most):
    head = "\n─── instance "
    if most <= 0 or len(text) <= most:
        return text
    out, *parts = text.split(head)
    for p in parts:
        if len(out) + len(head) + len(p) > most:
            break
        out += head + p
    return out if out.strip() else text[:most]


def messages(spark, texts, size=2):
    """Messages (dialog, step, label, message, context) of one session a dialog."""
    rows = [(d, i // size, i + 1, t, "") for d, own in texts.items() for i, t in enumerate(own)]
    return spark.createDataFrame(rows, "dialog long, step long, label long, message string, context string")


def test_a_build_goes_on_where_it_stopped(spark, tmp_path):
    m = messages(spark, {1: ["red apples grow", "on old trees", "red apples grow fast", "blue whales swim", "blue whales swim far", "old trees"], 2: ["alone"]})
    whole = sorted(map(str, bd.build(m, 0.3, 3, str(tmp_path / "a")).collect()))
    assert bd.build(m, 0.3, 3, str(tmp_path / "b"), upto=2).select("step").distinct().count() == 2 and bd.done_steps(spark, str(tmp_path / "b")) == 2
    assert sorted(map(str, bd.build(m, 0.3, 3, str(tmp_path / "b")).collect())) == whole and len(whole) >= 4
    assert bd.build(m.limit(0)).count() == 0
    led = spark.createDataFrame([(5, 0, 1, "new", "said before\nand before that"), (5, 0, 2, "newer", "said before\nand before that")], m.schema)
    assert [(r.class_name, r["labels"], r.text) for r in bd.build(led).collect()] == [("Unclassified", [1, 2], "said before\nand before that\nnew\nnewer")]


def test_sweep_falls_back_to_the_first_class(spark):
    state = spark.createDataFrame([(1, 1, 1, "Unclassified", [1], "red apples", 0), (1, 2, 1, "Unclassified", [2], "blue whales", 0), (1, 2, 2, "Unclassified", [3], "whales sing", 1)], bd.STATE)
    m = spark.createDataFrame([(1, 4, "the blue whales went by here again and again"), (1, 5, "nothing at all in common with those others"), (1, 6, "blue whales"), (2, 1, "a dialog without any class at all, long enough")], "dialog long, label long, message string")
    got = {r["labels"][0]: (r.class_no, r.instance_no) for r in bd.sweep(m, state).collect()}
    assert got == {4: (2, 3), 5: (1, 2)}


def test_ranked_expansion_follows_what_scores(spark):
    near = spark.createDataFrame([(a, b) for x, y in [(1, 2), (1, 3), (2, 4), (3, 5), (4, 6)] for a, b in ((x, y), (y, x))], "node long, near long")
    scores = spark.createDataFrame([(2, 0.0), (3, 0.5), (4, 0.0), (5, 0.5), (6, 0.9)], "node long, score double")
    run = lambda hops, most: [(r.node, r.hop) for r in sorted(ex.ranked(spark.createDataFrame([(7, 1)], "qid long, node long"), near, lambda r: r.join(scores, "node"), hops, most).collect(), key=lambda r: r["rank"])]
    assert run(1, 9) == [(3, 1), (2, 1)]
    assert run(3, 9) == [(3, 1), (5, 2), (2, 1), (4, 2)]  # node 4 scores nothing, so 6 is not reached
    assert run(3, 2) == [(5, 2), (3, 1)]  # where not all fit, a later step counts a little more


def test_acyclic(spark):
    edges = lambda *e: spark.createDataFrame(list(e), "src long, dst long")
    assert gr.acyclic(edges((1, 2), (2, 3), (1, 3), (9, 3))) and gr.acyclic(edges((1, 2)).limit(0))
    assert not gr.acyclic(edges((0, 1), (1, 2), (2, 1), (2, 5))) and not gr.acyclic(edges((4, 4)))


def test_conversation_file(spark, tmp_path):
    whole = {"speaker_a": "A", "session_2": [{"speaker": "B", "text": "yes", "img_url": "u"}], "session_10": [{"speaker": "A", "text": "no"}], "session_2_date_time": "now", "session_1_summary": "x"}
    (tmp_path / "conv7.json").write_text(json.dumps(whole))
    rows = sorted(src.read_conversations(spark, str(tmp_path / "conv7.json")).collect(), key=lambda r: r.session)
    assert [(r.session, r.session_time, r.speaker, r.img_url) for r in rows] == [(2, "now", "B", "u"), (10, None, "A", None)]


def test_saved_state_guards(spark, tmp_path):
    meta = store.Meta("h", "n", "hash_only", 1, 2)
    store.save(spark, str(tmp_path), meta, {"t": spark.range(3)})
    assert store.load(spark, str(tmp_path), meta, 1, ["t"])["t"].count() == 3
    assert store.load(spark, str(tmp_path), meta, 2, ["t"]) is None
    for other in (store.Meta("x", "n", "hash_only", 1, 2), store.Meta("h", "x", "hash_only", 1, 2), store.Meta("h", "n", "hybrid", 1, 2), store.Meta("h", "n", "hash_only", 1, 3)):
        assert store.load(spark, str(tmp_path), other, 1, ["t"]) is None


def test_edges_kept_in_order(spark):
    def plain(edges, there=()):
        """Edge by edge: kept unless its end leads back to its start."""
        kept, out = set(there), {}
        for src, dst, n in sorted(edges, key=lambda e: e[2]):
            reached, todo = {dst}, [dst]
            while todo:
                at = todo.pop()
                more = {b for a, b in kept if a == at} - reached
                reached |= more
                todo += more
            out[n] = src not in reached
            if out[n]:
                kept.add((src, dst))
        return out

    rng = random.Random(9)
    run = lambda edges, there=None: {r.n: r.kept for r in gr.guarded(spark.createDataFrame(edges, "src long, dst long, n long"), there).collect()}
    dense = [(rng.randrange(9), rng.randrange(9), n) for n in range(60)]  # loops, repeats and many cycles
    assert run(dense) == plain(dense) and 0 < sum(plain(dense).values()) < 60
    ring = [(i, (i + 1) % 12, 100 - i) for i in range(12)] + [(i, i + 1, 200 + i) for i in range(20, 30)]
    assert run(ring) == plain(ring)
    there = [(0, 1), (1, 2), (7, 8)]
    late = [(2, 0, 1), (8, 2, 2), (2, 7, 3), (1, 0, 4), (3, 3, 5), (0, 1, 6)]
    assert run(late, spark.createDataFrame(there, "src long, dst long")) == plain(late, there) == {1: False, 2: True, 3: False, 4: False, 5: False, 6: True}
    odd = spark.createDataFrame([(1, None, 1), (None, 2, 2), (1, 2, None), (1, 2, 3)], "src long, dst long, n long")
    assert [tuple(r) for r in gr.guarded(odd).collect()] == [(1, 2, 3, True)]
    assert gr.guarded(odd.limit(0)).count() == 0


def test_set_cover_against_one_question_at_a_time(spark):
    def plain(left):
        """Picks (doc, combo, place) of one question from its instances' keywords."""
        every, out, covered = set().union(*left.values()), [], set()

        def pick(combo, most, missing, enough=99):
            place, got = 0, set()
            while missing and place < most and len(out) < enough:
                doc = min(left, key=lambda d: (-len(left[d] & missing), len(left[d]), d), default=None)
                if doc is None or not left[doc] & missing:
                    break
                place += 1
                out.append((doc, combo, place))
                missing, got = missing - left[doc], got | left.pop(doc)
            return got

        for combo in (1, 2, 3):
            covered |= pick(combo, 5, every)
        pick(0, 7, every - covered, 10)
        return set(out)

    rng = random.Random(4)
    rows = [(q, d, f"k{rng.randrange(1 + 3 * q)}") for q in range(14) for d in range(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 4))]
    rows += [(50, d, f"w{d}") for d in range(40)] + [(51, 1, "a"), (51, 1, "a"), (51, 2, "a")]  # more keywords than picks; repeats
    by = {}
    for q, d, k in rows:
        by.setdefault(q, {}).setdefault(d, set()).add(k)
    got = {}
    for r in cover.set_cover(spark.createDataFrame([*rows, (51, 3, None), (None, 1, "a")], "qid long, doc long, keyword string")).collect():
        got.setdefault(r.qid, set()).add((r.doc, r.combo, r.place))
    assert got == {q: plain({d: set(k) for d, k in docs.items()}) for q, docs in by.items()}
    assert cover.set_cover(spark.createDataFrame([], "qid long, doc long, keyword string")).count() == 0
