"""Token counts, source divergence and filter interactions against plain versions, on planted and odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threadloom.llm import divergence, interactions, tokens

SCHEMA = "doc_id long, text string, lang string, source string"
ODD = [
    None, "", " ", "\n", "  x", "x  ", "a \n b", "a\n\n  b\n", "it's we'll 'tis ' s 'S I'M don'", "a.b, c.\n d!? e;:", "1,000.50 20% x2y 3.", "<|endoftext|>", "a  <|endoftext|>  b", "a <|endoftext|>b <|endo ftext|>",
    "a  b  c   d 　 e\u0085 f", "日本 語テキスト、 と\n中文。 🙂 👩‍👩‍👧 é é", "\t\ttab\r\n\r\nx \x1c y", "x" * 700, " " * 700 + "x", "ab " * 400, "...,,, ;;; )))", "word).\nnext (a.) b:) ",
]


def count_rows(spark):
    rng = random.Random(3)
    bits = ["the", "Word", "x", "  ", "\n", "é", "日本", "'s", ".", ",", "<|endoftext|>", " ", " ", "1234", "\t", "don't", "🙂"]
    made = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    runs = ["start " + "q" * 5000 + " end " * 300, "日本語" * 900, " " * 3000, ("a" * 400 + " ") * 20]
    texts = [*ODD, *made, *runs, *made[:5]]
    rows = [(i if i % 7 else None, t, None, None) for i, t in enumerate(texts)]
    return rows + rows[20:60]


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 8), (256, 16), (1000, 500), (1 << 16, 1 << 10)])
def test_token_counts(spark, chunk, overlap):
    rows = count_rows(spark)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("Digest", F.lit(1)).withColumn("N_TOKENS", F.lit("x")).repartition(4)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = sorted((str(d), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t, _, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokens.count(docs, chunk=chunk, overlap=overlap).collect()) == wanted


def test_token_counts_of_nothing(spark):
    assert tokens.count(spark.createDataFrame([], SCHEMA)).count() == 0


def test_seams_widen_and_give_up():
    counter = tokens.Counter(tokens.default_tokenizer())
    text = np.frombuffer(("ab " * 50 + "x" * 120 + " cd" * 100 + "y" * 3000 + " e" * 500).encode(), np.uint8)
    found = tokens.seams(text, counter, 200, 10)
    widths = {at: high - low for at, low, high in found}
    assert widths[200] > 20 and min(widths.values()) == 20  # inside the first run the overlap is widened
    assert set(range(800, 3400, 200)) - set(widths)  # inside the long run there are no seams
    for _, low, high in found:
        assert len(counter.boundaries(text[low:high]))


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokens.Counter(public_tokenizers.path("word_bpe_49k.json"))


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_divergence(rows, least, top):
    docs = [(g or "", s or "", Counter(TERM.findall((t or "").translate(LOWER)))) for _, t, g, s in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held = Counter(t for g, _, c in docs if g == lang for t in c)
        kept = {t for t, n in held.items() if n >= least}
        by = defaultdict(Counter)
        for g, s, c in docs:
            if g == lang:
                by[s].update({t: n for t, n in c.items() if t in kept})
        whole = sum(by.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in by.items()}, share(whole)
        for s in by:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in by if o != s]
            above = [(p[s][t] - q[t], t) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", above, top)):
                out += [(lang, s, part, o, v, k + 1) for k, (v, o) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most])]
    return sorted(out)


def divergence_rows():
    rng = random.Random(4)
    words = ["be", "bee", "beet", "beetle", "beetles", "Beetles", "é", "éa", "日本", "日本語", "zz" * 20, "zz" * 20 + "y", "prefixprefixprefixa", "prefixprefixprefixb", "x1y", "a'b"]
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(words[: 4 + i % 13]) for _ in range(rng.randint(0, 12)))
        rows.append((i if i % 5 else None, text if i % 11 else None, rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "é", "A", None, "solo"])))
    rows += rows[:30]  # repeated rows are documents
    return rows + [(900 + i, f"only{i} here", "xx", f"s{i}") for i in range(4)] + [(999, "", "yy", "one")]


@pytest.mark.parametrize(("least", "top", "first"), [(30, 50, 6), (5, 3, 1), (1, 4, 2), (10_000, 5, 6)])
def test_divergence(spark, least, top, first):
    rows = divergence_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("Prefix", F.lit(1)).withColumn("TERM", F.lit(2)).repartition(3)
    found = divergence.audit(docs, least, top, first).collect()
    assert sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in found) == plain_divergence(rows, least, top)


def test_terms_that_share_prefixes_fall_away(spark):
    """Each prefix of these terms is frequent, each term is not: only the exact last level can tell."""
    rows = [(i, f"sharedprefix{chr(97 + i % 20)}tail common", "en", "a") for i in range(100)]
    kept, n, _ = divergence.kept_terms(spark.createDataFrame(rows, SCHEMA), 30)
    assert [(bytes(r.prefix), r.lang) for r in kept.collect()] == [(b"common\0", "en")] and n == 1


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_interactions(rows, labels):
    first, out = {}, defaultdict(lambda: defaultdict(int))
    for d, t, _, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good, toxic = ({d for d, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    docs = []
    for d, t, _, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search("[#$%&*|]", t), t in first and (d is None or d > first[t]))) if bad)
        docs.append((s or "", fails, d in good, d in toxic))
    parts, orders = {d[0] for d in docs}, ["".join(p) for p in permutations("ABCDE")]
    for part in parts:
        shapley = Counter()
        for order in orders:
            for k, f in enumerate(order):
                row = out[part, order, k + 1]
                for p, fails, g, x in docs:
                    if p != part:
                        continue
                    earlier, bad = any(c in fails for c in order[:k]), f in fails
                    row["kept"] += not earlier and not bad
                    row["removed"] += not earlier and bad
                    row["redundant"] += earlier and bad
                    row["unique_fails"] += fails == f
                    row["good_lost"] += not earlier and bad and g
                    row["toxic_lost"] += not earlier and bad and x
                shapley[f] += row["removed"]
        for order in orders:
            for k, f in enumerate(order):
                out[part, order, k + 1]["shapley"] = shapley[f]
    return {k: tuple(v[c] for c in interactions.COUNTS) for k, v in out.items()}


def test_interactions(spark):
    rng = random.Random(6)
    texts = [None, "", "A", "a#", "word " * 250, "WORD " * 250, " ".join(f"w{i}" for i in range(220)), " ".join(f"w{i}" for i in range(220)) + " |", "\x0b".join(f"é{i}" for i in range(201)), "x y " * 210]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts) if i % 3 else texts[4], None, rng.choice(["a", "b", None])) for i in range(150)]
    rows += rows[:20] + [(500, "one of its kind", None, "zzz")]
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 60, 2)] + [(4, 1, None), (6, None, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("Fails", F.lit(1)).withColumn("PART", F.lit(2)).withColumn("good", F.lit(3)).repartition(3)
    found = interactions.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    wanted = plain_interactions(rows, [x for x in labels if x[0] is not None])
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in interactions.COUNTS) for r in found} == wanted and len(found) == len(wanted)


def test_interactions_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interactions.audit(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_walk_holds_every_subset():
    cells = np.random.default_rng(1).integers(0, 9, (3, 32))
    states = interactions.walk(cells)
    for subset in range(32):
        assert (states[:, subset] == cells[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()


def test_digests_do_not_follow_a_batch(spark):
    rows = [(i, f"text {i % 3}", None, None) for i in range(9)]
    seen = {r.doc_id: bytes(r.digest) for r in interactions.marks(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert seen == {i: hashlib.sha256(f"text {i % 3}".encode()).digest() for i in range(9)}
