"""Edges of a built graph against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.functions import encoder
from threadloom.operators import enrich as en
from threadloom.operators import graph as gr

STATE = "dialog bigint, class_no bigint, instance_no bigint, class_name string, labels array<bigint>, text string, step bigint"


def made(seed=1):
    rng, out = random.Random(seed), []
    words = ["river", "boat", "lake", "stone", "bread", "flour", "oven", "salt"]
    for d in (1, 2):
        for c in range(1, 5):
            for i in range(1, rng.randint(2, 5)):
                half = rng.randrange(2) * 4
                out.append((d, c, i, "n", sorted(rng.sample(range(1, 15), rng.randint(1, 3))), " ".join(rng.choice(words[half : half + 4]) for _ in range(rng.randint(0, 9))), (c + i) // 2))
    return [*out, (3, 1, 1, "n", [1], "alone in its dialog", 0)]


def name(r):
    return f"c{r[1]}:i{r[2]}"


def plain_records(rows):
    held = {}
    for r in rows:
        for label in r[4]:
            held.setdefault((r[0], label), set()).add(name(r))
    return {k: sorted(v) for k, v in held.items() if len(v) > 1}


def test_records_kept_by_version_are_those_of_a_rebuild(spark, tmp_path):
    rows = made()
    messages = spark.createDataFrame([(d, label, f"m{d}.{label}") for d in (1, 2, 3) for label in range(1, 15)], "dialog bigint, label bigint, message string")
    seen = 0
    for version, upto in enumerate((1, 2, 9)):
        state = spark.createDataFrame([r for r in rows if r[6] < upto], STATE)
        new = state.where(F.col("step") >= seen)
        en.keep_records(str(tmp_path), version, state, messages, new)
        kept = {(r.dialog, r.label): r.members for r in en.kept_records(spark, str(tmp_path)).collect()}
        assert kept == plain_records([r for r in rows if r[6] < upto])
        seen = upto
    whole = en.records(spark.createDataFrame(rows, STATE), messages).collect()
    assert {(r.dialog, r.label): r.members for r in whole} == kept and all(r.content == f"m{r.dialog}.{r.label}" for r in whole)


def unit(text):
    v = encoder.Hashed().encode([text])[0]
    return v / max(np.linalg.norm(v), 1e-12)


@pytest.mark.parametrize("block", [2, 2_000])
def test_similar_and_nearest_in_blocks(spark, block):
    rows = made(4)
    vectors = encoder.encode(spark.createDataFrame(rows, STATE).select("dialog", en.entity().alias("id"), "text"), "text")
    by = {(r[0], name(r)): unit(r[5]) for r in rows}
    every = [(a[0], a[1], b[1], round(float(by[a] @ by[b]), 6)) for a in by for b in by if a[0] == b[0] and a[1] < b[1]]
    wanted = []
    for d in (1, 2, 3):
        wanted += sorted((e for e in every if e[0] == d and e[3] >= 0.5), key=lambda e: (-e[3], e[1], e[2]))[:7]
    assert sorted((r.dialog, r.u, r.v, round(r.weight, 5)) for r in en.similar(vectors, 0.5, 7, block).collect()) == sorted((*e[:3], round(e[3], 5)) for e in wanted)
    asked, targets = vectors.where("id like '%:i1'"), vectors.where("not id like '%:i1'")
    found = {(r.dialog, r.u, r.v) for r in en.nearest(asked, targets, block).collect()}
    best = set()
    for d, a in (k for k in by if k[1].endswith(":i1")):
        some = [(round(-float(by[d, a] @ by[k]), 6), k[1]) for k in by if k[0] == d and not k[1].endswith(":i1")]
        if some:
            b = min(some)[1]
            best.add((d, min(a, b), max(a, b)))
    assert found == best


def test_enrichment_leaves_no_one_alone_where_there_are_edges(spark):
    state = spark.createDataFrame(made(2), STATE)
    hyper = en.records(state, spark.createDataFrame([(d, label, "m") for d in (1, 2, 3) for label in range(1, 15)], "dialog bigint, label bigint, message string"))
    edges, places = en.enrich(state, hyper, 0.7, 5, 1)
    rows = edges.collect()
    assert {r.kind for r in rows} <= {"semantic", "minimum_connectivity"} and all(r.u < r.v for r in rows)
    reached = {(r.dialog, x) for r in rows for x in (r.u, r.v)} | {(r.dialog, x) for r in hyper.collect() for x in r.members}
    assert reached == {(r[0], name(r)) for r in made(2) if r[0] < 3}  # dialog 3 has no edge to link to
    assert {(r.dialog, r.id) for r in places.collect()} == {(r.dialog, x) for r in rows for x in (r.u, r.v)}


def test_enrichment_of_nothing(spark):
    state = spark.createDataFrame([], STATE)
    edges, places = en.enrich(state, spark.createDataFrame([], en.RECORD))
    assert edges.count() == 0 and places.count() == 0


def test_tags_and_similarity_of_odd_texts(spark):
    rows = spark.createDataFrame([(1, None, "x y"), (2, "", ""), (3, "the of", "the"), (4, "river boat", "River BOAT!")], "i int, a string, b string")
    assert {r.i: r.similarity for r in encoder.similarity(rows, "a", "b").collect()} == {1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0}
    found = encoder.tags(rows, ["i"], "a", 2).collect()
    assert {r.i for r in found} == {4} and sorted(r["rank"] for r in found) == [1, 2] and max(found, key=lambda r: r.score).tag == "river boat"


def plain_modularity(edges, place):
    m = 2 * sum(w for _, _, w in edges)
    k, inside = {}, {}
    for u, v, w in edges:
        for x in (u, v):
            k[place[x]] = k.get(place[x], 0) + w
        if place[u] == place[v]:
            inside[place[u]] = inside.get(place[u], 0) + 2 * w
    return sum(inside.values()) / m - sum(x * x for x in k.values()) / m**2


def plain_louvain(edges):
    """Louvain one node at a time, level by level."""
    nodes = sorted({x for u, v, _ in edges for x in (u, v)})
    whole, now = {n: n for n in nodes}, [*edges]
    while True:
        near, deg = {}, {}
        for u, v, w in now:
            for a, b in ((u, v), (v, u)):
                near.setdefault(a, {})
                near[a][b] = near[a].get(b, 0) + w
                deg[a] = deg.get(a, 0) + w
        total = sum(deg.values())
        place, moved, size = {n: n for n in near}, True, dict(deg)
        any_move = False
        while moved:
            moved = False
            for n in sorted(near):
                links = {}
                for b, w in near[n].items():
                    if b != n:
                        links[place[b]] = links.get(place[b], 0) + w
                size[place[n]] -= deg[n]
                best = max([place[n], *links], key=lambda c: (round(links.get(c, 0) - size.get(c, 0) * deg[n] / total, 9), c == place[n], -c))
                size[best] = size.get(best, 0) + deg[n]
                if best != place[n]:
                    place[n], moved, any_move = best, True, True
        if not any_move:
            return whole
        whole = {n: place[c] for n, c in whole.items()}
        now = [(place[u], place[v], w) for u, v, w in now]


def graphs():
    rng = random.Random(3)
    blocks = [(i, j, 1.0) for i in range(48) for j in range(i + 1, 48) if rng.random() < (0.6 if i // 8 == j // 8 else 0.03)]
    ring = [(8 * r + i, 8 * r + j, 1.0) for r in range(10) for i in range(5) for j in range(i + 1, 5)] + [(8 * r, 8 * ((r + 1) % 10) + 1, 1.0) for r in range(10)]
    weighted = [(i, (i + s) % 60, 1.0 + (i // 12 == (i + s) % 60 // 12) * 3) for i in range(60) for s in (1, 2, 7)]
    return {"blocks": blocks, "ring": ring, "weighted": weighted}


@pytest.mark.parametrize("name", ["blocks", "ring", "weighted"])
def test_communities_are_as_good_as_one_by_one(spark, name):
    edges = graphs()[name]
    place = {r.node: r.community for r in gr.communities(spark.createDataFrame(edges, "u bigint, v bigint, weight double")).collect()}
    assert set(place) == {x for u, v, _ in edges for x in (u, v)} and all(place[c] == c for c in place.values())
    assert plain_modularity(edges, place) >= plain_modularity(edges, plain_louvain(edges)) - 0.02
    frame = spark.createDataFrame(list(place.items()), "node bigint, community bigint")
    assert abs(gr.modularity(spark.createDataFrame(edges, "u bigint, v bigint, weight double"), frame).first()[0] - plain_modularity(edges, place)) < 1e-9


def test_communities_of_nothing(spark):
    assert gr.communities(spark.createDataFrame([], "u bigint, v bigint, weight double")).count() == 0


def plain_acyclic(edges):
    out, left = {}, {}
    for a, b in set(edges):
        out.setdefault(a, []).append(b)
        left[b] = left.get(b, 0) + 1
        left.setdefault(a, 0)
    ready, seen = [n for n in left if not left[n]], 0
    while ready:
        n, seen = ready.pop(), seen + 1
        for b in out.get(n, ()):
            left[b] -= 1
            if not left[b]:
                ready.append(b)
    return seen == len(left)


def test_acyclic_against_a_plain_version(spark):
    rng = random.Random(8)
    cases = [[(1, 1)], [(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 4), (4, 2)], [(1, 2), (2, 3), (1, 3)], [(i, (i + 1) % 9) for i in range(9)], []]
    cases += [[(rng.randrange(7), rng.randrange(7)) for _ in range(n)] for n in (3, 5, 7)] + [[tuple(sorted(rng.sample(range(9), 2))) for _ in range(14)]]
    for edges in cases:
        assert gr.acyclic(spark.createDataFrame(edges, "src bigint, dst bigint")) == plain_acyclic(edges), edges


@pytest.mark.parametrize("closed", [False, True])
def test_a_long_chain_needs_few_jobs(spark, closed):
    chain = [(i, i + 1) for i in range(10_000)] + ([(10_000, 5_000)] if closed else [])
    tracker, group = spark.sparkContext.statusTracker(), f"chain{closed}"
    edges = spark.createDataFrame(chain, "src bigint, dst bigint").coalesce(4)
    spark.sparkContext.setJobGroup(group, "")
    assert gr.acyclic(edges) is not closed
    spark.sparkContext.setJobGroup("", "")
    assert len(tracker.getJobIdsForGroup(group)) < 150  # about eight a write and join; a walk would need thousands


def test_a_cycle_is_shown_before_its_tail_is_peeled(spark, monkeypatch):
    """A triangle at the end of a ladder of 40 steps, which would be peeled a step a round, and edges in the order of their nodes, which need no round."""
    ladder = [(i, j) for i in range(40) for j in (i + 1, i + 2)]
    rounds = []
    chains = gr._chains
    monkeypatch.setattr(gr, "_chains", lambda e: rounds.append(1) or chains(e))
    edges = lambda found: spark.createDataFrame(found, "src bigint, dst bigint")
    assert gr.acyclic(edges(ladder)) and gr.acyclic(edges([(b, a) for a, b in ladder])) and not rounds
    assert not gr.acyclic(edges([*ladder, (50, 51), (51, 52), (52, 50), (40, 50), (41, 50)])) and len(rounds) < 3
    assert not gr.acyclic(edges([(1, 2), (2, 1)])) and not gr.acyclic(edges([(3, 3)])) and gr.acyclic(edges([(1, 2), (None, 1)]))
