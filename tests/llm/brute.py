"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def removed(docs: dict, length: int = 50) -> dict:
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    first, out = {}, {}
    for doc in sorted(docs):
        data = (docs[doc] or "").encode()
        own = [data[i : i + length] for i in range(len(data) - length + 1)]
        gone = bytearray(len(data))
        for i, w in enumerate(own):
            if first.get(w, doc) < doc:
                gone[i : i + length] = b"\x01" * length
        for w in own:
            first.setdefault(w, doc)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc] = (len(data), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def removed_rows(rows: list, length: int = 50) -> dict:
    """doc_id -> sorted results of its rows; ids may repeat or be null, which is above all others."""
    last, first, out = 1 << 63, {}, defaultdict(list)
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            first[w] = min(first.get(w, last), last if doc is None else doc)
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < (last if doc is None else doc):
                gone[i : i + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc].append((len(data), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return {d: sorted(v) for d, v in out.items()}


def simhash(text, words: int = 3) -> int:
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    runs = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(prints: dict, radius: int = 2) -> dict:
    """doc_id -> component_id."""
    sets, by = Union(), defaultdict(list)
    for d, f in prints.items():
        by[f].append(d)
    for ds in by.values():
        for d in ds:
            sets.join(d, ds[0])
    every = list(by)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= radius:
                sets.join(by[a][0], by[b][0])
    return {d: sets.root(d) for d in prints}


def similar(texts: dict, most: int) -> dict:
    """doc_id -> component_id: all pairs within two bits in one of twenty 32-bit tables and within ``most`` bits over all, with Jaccard 0.8 or more."""
    from threadloom.llm.simhash import derive

    def shingles(text):
        found = (text or "").lower().split()
        return {xxhash.xxh64_intdigest(" ".join(found[i : i + 5]), 42) for i in range(max(1, len(found) - 4))} if found else set()

    sets, own, wide = Union(), {d: shingles(t) for d, t in texts.items()}, {}
    for d, own_set in own.items():
        h = np.array(sorted(own_set), np.uint64)
        wide[d] = [sum(1 << b for b in range(64) if 2 * int((derive(h, k) >> np.uint64(b) & np.uint64(1)).sum()) > len(h)) for k in range(10)]
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            apart = [x ^ y for x, y in zip(wide[a], wide[b])]
            meets = any((x & 0xFFFFFFFF).bit_count() <= 2 or (x >> 32).bit_count() <= 2 for x in apart)
            if meets and sum(x.bit_count() for x in apart) <= most and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b]):
                sets.join(a, b)
    return {d: sets.root(d) for d in ids}


def word_runs(text: str) -> list:
    words = text.split()
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def weighted(one: list, two: list) -> float:
    both = sum((Counter(one) & Counter(two)).values())
    return both / (len(one) + len(two) - both)


def cosine_links(vectors: dict, least: float = 0.9) -> dict:
    """vec_id -> (n_links, component_id)."""
    good = {k: np.array(v, float) for k, v in vectors.items() if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    sets, n = Union(), dict.fromkeys(vectors, 0)
    keys = list(good)
    unit = np.array([good[k] / np.linalg.norm(good[k]) for k in keys])
    for i, j in zip(*np.nonzero(unit @ unit.T >= least)):
        if i < j:
            n[keys[i]] += 1
            n[keys[j]] += 1
            sets.join(keys[i], keys[j])
    return {k: (n[k], sets.root(k)) for k in vectors}


def secrets(text) -> tuple:
    """Base spans (start, kind, end) in order."""
    text, out = text or "", []
    kinds = [(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, "assign"), (r"AKIA[A-Z0-9]+", 0, 18, "access"), (r"[0-9a-f]+", 0, 16, "hex")]
    for k, (pattern, group, least, name) in enumerate(kinds):
        out += [(m.start(), k, m.end(), name) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return sorted(out)


def packed_ids(texts, tokenizer) -> list:
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def crc_ids(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def licenses(text, notices, least: float = 0.8) -> dict:
    """license -> containment: every window of 15 words, one every 8, against every passage of 8 words of every notice."""
    def pairs(words):
        return list(zip(words, words[1:]))

    def words_of(x):
        return re.findall(r"[^\W_]+(?:[-.][^\W_]+)*", (x or "").lower())

    own, out = pairs(words_of(text)), {}
    windows = [set(own[k : k + 14]) for k in range(0, max(len(own) - 14, 0) + 8, 8)]
    for name, notice in notices:
        words = words_of(notice)
        last = max(len(words) - 8, 0)
        passages = [set(pairs(words[a : a + 8])) for a in sorted({*range(0, last + 1, 8), last})]
        found = [max((len(p & w) for w in windows), default=0) for p in passages]
        share = sum(n for n, p in zip(found, passages) if n >= least * len(p) - 1e-9) / sum(map(len, passages))
        if own and share >= least - 1e-9:
            out[name] = max(out.get(name, 0), share)
    return out


def five_words(text) -> set:
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(one, two) -> float:
    a, b = five_words(one), five_words(two)
    return len(a & b) / len(a | b) if a | b else 1.0


def jaccard_groups(texts: dict, least: float = 0.8) -> dict:
    """doc_id -> smallest doc_id reachable over pairs of that similarity."""
    sets, ids = Union(), sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if jaccard(texts[a], texts[b]) >= least:
                sets.join(a, b)
    return {d: sets.root(d) for d in ids}


def holds(text, item, least: float = 0.8) -> bool:
    """Whether some window of the item's size has a weighted five-word similarity of ``least`` with it; words without outer marks."""
    plain = lambda t: " ".join(w.strip(".,!?;:").lower() for w in (t or "").split())
    flat, own = word_runs(plain(text)), word_runs(plain(item))
    return max((weighted(flat[a : a + len(own)], own) for a in range(len(flat) - len(own) + 1)), default=0) >= least


def quality_features(text, buckets: int) -> dict:
    """Bucket -> value: words, pairs of words, shapes and pairs of shapes, each count over the number of words."""
    from threadloom.llm.quality import _shape

    h = lambda kind, x: xxhash.xxh32_intdigest(f"{kind} {x}".encode())
    pair = lambda a, b: (both := (a * 0x9E3779B1 + b * 31 + 7) & 0xFFFFFFFF) ^ both >> 15
    words, out = (text or "").replace("\n", " ").split(" "), Counter()
    words = [w for w in words if w]
    before_word, before_shape, last = h("word", ""), h("shape", "start"), None
    for w in words:
        word = h("word", w.lower())
        shape = h("shape", "again" if word == last else _shape(w))
        for x in (word, pair(before_word, word), shape, pair(before_shape, shape)):
            out[x % buckets] += 1 / len(words)
        before_word, before_shape, last = word, shape, word
    return dict(out)


def ftrl(rows: list, labels: list, passes: int, buckets: int, alpha=1.0, beta=1.0, l1=1e-4, l2=1e-3) -> list:
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else -(z[k] - (l1 if z[k] > 0 else -l1)) / ((beta + n[k] ** 0.5) / alpha + l2)
    for _ in range(passes):
        for row, y in zip(rows, labels):
            x = {**row, buckets: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + np.exp(-min(max(sum(w[k] * x[k] for k in x), -35), 35)))
            for k in x:
                g = (p - y) * x[k]
                z[k] += g - ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / alpha * w[k]
                n[k] += g * g
    return [weight(k) for k in range(buckets + 1)]
