import random

import pytest

from threadloom.operators import graph as gr


def plain_cycle(edges, src, dst):
    """Whether an edge from src to dst closes a cycle."""
    if src is None or dst is None:
        return False
    seen, todo = set(), [dst]
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            todo += [b for a, b in edges if a == at]
    return src == dst or (src, dst) not in edges and src in seen


@pytest.mark.parametrize("turned", ["up", "down", "mixed"])
def test_cycles_against_a_plain_version(spark, turned):
    rng = random.Random(3)
    place = list(range(24))
    if turned != "up":
        rng.shuffle(place) if turned == "mixed" else place.reverse()
    edges = {(place[a], place[b]) for a, b in ((rng.randrange(23), rng.randrange(1, 24)) for _ in range(45)) if a < b}
    asked = {(rng.randrange(26), rng.randrange(26)) for _ in range(200)} | set(list(edges)[:5]) | {(None, 3), (4, None), (5, 5)}
    e, c = (spark.createDataFrame(list(rows), "src long, dst long") for rows in (edges, asked))
    got = [(r.src, r.dst, r.cycle) for r in gr.creates_cycle(e.unionAll(e.limit(4)), c.unionAll(c.limit(50))).collect()]
    assert len(got) == len(asked) and {(s, d): x for s, d, x in got} == {(s, d): plain_cycle(edges, s, d) for s, d in asked}
    assert any(x for _, _, x in got) and any(not x for _, _, x in got)


def test_ways_of_two_steps_need_no_rounds(spark, monkeypatch):
    """Candidates over a deep graph are decided at once where one or two steps lead back, and not followed to its end."""
    edges = [(10 * k + i, 10 * k + 10 + j) for k in range(8) for i in range(3) for j in range(3)]
    asked = [(b, a) for a, m in edges for x, b in edges if m == x]
    calls, stored = [], gr.stored
    monkeypatch.setattr(gr, "stored", lambda *a: calls.append(1) or stored(*a))
    e, c = (spark.createDataFrame(rows, "src long, dst long") for rows in (edges, asked + [(a, b) for b, a in asked]))
    got = gr.creates_cycle(e, c).collect()
    assert len(got) == 2 * len(set(asked)) and all(r.cycle == (r.src > r.dst) for r in got) and len(calls) <= 3


def test_communities_with_places_sent_or_exchanged(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(a, b, round(rng.random() + (a % 4 == b % 4), 3)) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.6 if a % 4 == b % 4 else 0.1)]
    e = spark.createDataFrame(rows, "u long, v long, weight double")
    found = []
    for most in (gr.PLACES, 0):
        monkeypatch.setattr(gr, "PLACES", most)
        found.append(sorted(tuple(r) for r in gr.communities(e).collect()))
    assert found[0] == found[1] and len({c for _, c in found[0]}) == 4
