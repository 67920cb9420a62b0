"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import cut, fresh

# Kinds in order, pattern, group that holds the secret, least length of that group.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
LIVE = ("live", r"[A-Za-z0-9+/_-]{24,}")
SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string,secret:string>>"
WIDE = "UTF-32"
FAR = (1 << 31) - 1  # a place behind every text


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of one kind in one text, as structs (start, kind_no, end, kind, secret); code points, end exclusive.

    The text is cut at the matches; the lengths of the pieces and of the matches give the places. Matches
    whose secret is too short are dropped after the search, as they still use up their text.
    """
    if group == 0:  # a run of one class, or one with a fixed head: shorter runs can be passed over by the search itself
        pattern = pattern[:-1] + "{" + str(least - (4 if kind == "access" else 0)) + ",}" if pattern.endswith("+") else pattern
    re = F.lit(pattern)
    whole = F.regexp_extract_all(text, re, F.lit(0))
    secret = whole if group == 0 else F.regexp_extract_all(text, re, F.lit(group))
    found = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("hit"), secret.alias("secret"))
    number = [k[0] for k in KINDS].index(kind) if kind != LIVE[0] else len(KINDS)

    def one(x, end):
        return F.struct((end - F.char_length(x["hit"])).alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), x["secret"].alias("secret"))

    def placed(found):
        return F.zip_with(found, running(F.transform(found, lambda x: F.char_length(x["gap"]) + F.char_length(x["hit"])), _plus), one)

    spans = F.filter(_let(found, placed), lambda x: F.char_length(x["secret"]) >= least)
    return F.when(F.regexp_count(text, re) > 0, spans).otherwise(F.array()).cast(SPANS)


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it, also inside a function of an array's elements."""
    return F.transform(F.array(value), then)[0]


def _plus(a: Column, b: Column) -> Column:
    return a + b


def running(values: Column, op, block: int = 256) -> Column:
    """Running results of an associative ``op`` over an array of integers, the last entry that of all.

    Growing an array entry by entry copies it each time. So blocks of a few hundred entries run by themselves, then
    the blocks' last results run, and each block takes on the result of those before it.
    """
    def grown(acc, x):
        return F.concat(acc, F.array(F.when(F.size(acc) > 0, op(F.element_at(acc, -1), x)).otherwise(x)))

    none = F.array().cast("array<int>")

    def of_blocks(inner):
        bases = F.aggregate(F.transform(inner, lambda b: F.element_at(b, -1)), none, grown)
        shifted = F.concat(F.array(F.lit(None).cast("int")), bases)
        return F.flatten(F.zip_with(inner, F.slice(shifted, 1, F.size(inner)), lambda b, base: F.when(base.isNull(), b).otherwise(F.transform(b, lambda x: op(base, x)))))

    def of_values(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda i: F.slice(v, i * block + 1, F.lit(block)))
        return _let(F.transform(blocks, lambda b: F.aggregate(b, none, grown)), of_blocks)

    return _let(values, lambda v: F.when(F.size(v) > 0, of_values(v)).otherwise(none))


def _outside(more: Column, base: Column) -> Column:
    """Spans of ``more`` that overlap none of ``base``: both are walked in order of start, one way for the ends so far and the other way for the starts to come."""
    mark = lambda c, n: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("new"), s["end"].alias("end"), s.alias("span")))

    def kept(both):
        reach = running(F.transform(both, lambda x: F.when(x["new"] == 0, x["end"]).otherwise(0)), F.greatest)
        coming = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(x["new"] == 0, x["start"]).otherwise(FAR))), F.least))
        free = F.filter(F.arrays_zip(both.alias("x"), reach.alias("reach"), coming.alias("coming")), lambda z: (z["x"]["new"] == 1) & (z["reach"] <= z["x"]["start"]) & (z["coming"] >= z["x"]["end"]))
        return F.transform(free, lambda z: z["x"]["span"])

    return F.when((F.size(more) > 0) & (F.size(base) > 0), _let(F.sort_array(F.concat(mark(base, 0), mark(more, 1))), kept)).otherwise(more)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, repo: str = "doc_id", owner: str = "source", most_owners: int = 1, most_repos: int = 3) -> DataFrame:
    """Secrets in every whole text of ``docs``, with a verdict from how the corpus owns each candidate.

    Base spans come from the three fixed kinds. Long mixed runs of letters and digits outside them are
    further candidates. Every candidate is hashed; for each hash the different owners and repositories that
    hold it are counted over the whole corpus. A further candidate that few owners and few repositories hold
    is live-looking and its span is added; one that many share is an example and is left out. Base spans
    stay in any case; how many of them are widely copied is reported.

    Returns a row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_live, n_copied (long), base and
    spans (arrays of start, kind_no, end, kind). A null text counts as empty and has no spans; null owners or
    repositories count as one unnamed owner or repository; repeated rows each get the same result. Hot
    hashes are reduced by (hash, owner, repository) before they meet.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text"), F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"))
    found = rows.select("doc_id", "repo", "owner", F.xxhash64("text").alias("digest"), *[_spans(F.col("text"), *k).alias(k[0]) for k in KINDS], _spans(F.col("text"), *LIVE, 0, 24).alias("more"))
    base = F.sort_array(F.concat(*[F.col(k[0]) for k in KINDS]))
    more = F.filter("more", lambda s: s["secret"].rlike("[0-9]") & s["secret"].rlike("[A-Za-z]"))
    counted = found.select("doc_id", "repo", "owner", "digest", *[F.size(k[0]).cast("long").alias(f"n_{k[0]}") for k in KINDS], base.alias("base"), more.alias("more"))
    marked = counted.withColumn("more", _outside(F.col("more"), F.col("base")))
    hashed = lambda c: F.transform(c, lambda s: F.struct(s["start"], s["kind_no"], s["end"], s["kind"], F.sha2(s["secret"], 256).alias("hash")))
    marked = cut(marked.withColumns({"base": hashed("base"), "more": hashed("more")}))

    each = marked.where(F.size("base") + F.size("more") > 0).select("doc_id", "digest", "repo", "owner", F.explode(F.concat("base", "more")).alias("s"))
    owned = each.select(F.col("s.hash").alias("hash"), "owner", "repo").distinct()
    owned = owned.groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    few = (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos)
    judged = each.select("doc_id", "digest", "s.*").distinct().join(owned, "hash").groupBy("doc_id", "digest").agg(
        F.sum(F.when((F.col("kind") != LIVE[0]) & ~few, 1).otherwise(0)).alias("n_copied"),
        F.collect_list(F.when((F.col("kind") == LIVE[0]) & few, F.struct("start", "kind_no", "end", "kind"))).alias("live"),
    )
    judged = judged.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "n_copied", "live")
    plain = F.transform("base", lambda s: F.struct(s["start"], s["kind_no"], s["end"], s["kind"]))
    out = marked.join(judged, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").withColumn("base", plain)
    spans = F.when(F.size(F.coalesce("live", F.array())) > 0, F.sort_array(F.concat("base", "live"))).otherwise(F.col("base"))
    return out.select("doc_id", "digest", *[f"n_{k[0]}" for k in KINDS], F.coalesce(F.size("live"), F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"), "base", spans.alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span that ``scan`` finds replaced by ``mark``; rows and other columns stay.

    Overlapping spans are merged first. A null text stays null.
    """
    key, other, digest, found = fresh(docs, "own_key", "other_id", "other_key", "found_spans")
    spans = scan(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias(other), F.col("digest").alias(digest), F.col("spans").alias(found)).dropDuplicates([other, digest])
    rows = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col(other)) & (F.col(key) == F.col(digest)), "left")

    def cleaned(x):
        # code points of four bytes each, as a place in them is found without a walk from the text's head
        points, spans, reach = x["points"], x["spans"], x["reach"]
        before = F.concat(F.array(F.lit(0)), reach)
        gaps = F.filter(F.arrays_zip(spans.alias("s"), F.slice(before, 1, F.size(spans)).alias("at")), lambda z: z["s"]["start"] >= z["at"])
        pieces = F.transform(gaps, lambda z: F.decode(F.substring(points, 4 * z["at"] + 1, 4 * (z["s"]["start"] - z["at"])), WIDE))
        rest = F.decode(F.substring(points, 4 * F.element_at(before, -1) + 1, F.octet_length(points)), WIDE)
        return F.array_join(F.concat(pieces, F.array(rest)), mark)

    whole = F.struct(F.encode("text", WIDE).alias("points"), F.col(found).alias("spans"), running(F.transform(found, lambda s: s["end"]), F.greatest).alias("reach"))
    return joined.withColumn("text", F.when(F.col(found).isNotNull(), _let(whole, cleaned)).otherwise(F.col("text"))).select(*docs.columns)


def digest_columns(scanned: DataFrame) -> DataFrame:
    """The digest form of ``scan``: counts, the hash of the base spans and all spans as text."""
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "n_live", "n_copied", F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
