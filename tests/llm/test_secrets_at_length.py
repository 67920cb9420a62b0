"""Secret scans of texts with very many matches, and on odd rows."""

import hashlib
import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

import brute
from threadloom.llm import secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def spans_of(row):
    return [(int(s), int(e), k) for k, s, e in (x.split(":") for x in row.spans.split(",") if x)]


def plain_redacted(text, spans, mark="[SECRET]"):
    out, at = [], 0
    for start, end, _ in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_two_hundred_thousand_matches_in_a_minute(spark):
    rng = random.Random(1)
    text = " ".join(f"{rng.getrandbits(64):016x}" for _ in range(200_000))
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))], SCHEMA)
    began = time.time()
    row = secrets.digest_columns(secrets.scan(docs)).first()
    assert row.n_hex == 200_000 and time.time() - began < 60
    assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in brute.secrets(text)).encode()).hexdigest()
    assert secrets.redact(docs).first().text == " ".join(["[SECRET]"] * 200_000)


def test_mixed_matches_against_a_plain_version(spark):
    rng = random.Random(9)
    alphabet = "abcdefABCDEFGHIJ0123456789"
    made = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    bits = [lambda: f'password="{made(rng.randint(3, 30))}" ', lambda: f"AKIA{made(20).upper()} ", lambda: f"{rng.getrandbits(90):x} ", lambda: f"{made(40)}\n", lambda: f"é🙂 token: {made(14)}é", lambda: "word "]
    texts = ["".join(rng.choice(bits)() for _ in range(n)) for n in (1, 5, 255, 256, 257, 600, 3000)]
    rows = [(i, t, None, f"s{i}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    for r in secrets.digest_columns(secrets.scan(docs)).collect():
        base = brute.secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base).encode()).hexdigest()
        found = spans_of(r)
        live = [(m.start(), m.end(), "live") for m in secrets_of(texts[r.doc_id]) if not any(s < m.end() and m.start() < e for s, _, e, _ in base)]
        assert found == sorted([(s, e, k) for s, _, e, k in base] + live, key=lambda x: (x[0], ["assign", "access", "hex", "live"].index(x[2])))
        assert clean[r.doc_id] == plain_redacted(texts[r.doc_id], found)


def secrets_of(text):
    import re

    return [m for m in re.finditer(secrets.LIVE[1], text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 17])
def test_running(spark, n):
    rng = random.Random(n)
    values = [rng.randint(-5, 9) for _ in range(n)]
    row = spark.createDataFrame([(values,)], "v array<int>").select(secrets.running(F.col("v"), lambda a, b: a + b, 2).alias("sum"), secrets.running(F.col("v"), F.greatest, 4).alias("max")).first()
    assert row["sum"] == list(itertools.accumulate(values)) and row["max"] == list(itertools.accumulate(values, max))


def test_nothing_null_ids_and_repeats(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert secrets.scan(empty).count() == 0 and secrets.redact(empty).count() == 0
    rows = [(None, "secret=abcdefghijklmn", "en", None, 1), (None, "secret=abcdefghijklmn", "en", None, 1), (None, None, None, None, None), (3, "plain", None, "s", 5), (3, "secret=abcdefghijklmn", "en", "s", 1), (3, "plain", None, "s", 5)]
    found = secrets.digest_columns(secrets.scan(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.doc_id or -1, r.n_assign) for r in found) == [(-1, 0), (-1, 1), (-1, 1), (3, 0), (3, 0), (3, 1)]
    texts = sorted(str(r.text) for r in secrets.redact(spark.createDataFrame(rows, SCHEMA)).collect())
    assert texts == ["None", "[SECRET]", "[SECRET]", "[SECRET]", "plain", "plain"]
