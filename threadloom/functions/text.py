"""Terms, inverse document frequencies and cosines of sparse text vectors, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graph import stored

WORD = r"[\p{L}\p{N}_]{2,}"

# Words that carry no topic.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "in",
    "into", "is", "it", "its", "no", "not", "of", "on", "or", "our", "she", "so", "that", "the", "their", "them", "then",
    "there", "these", "they", "this", "to", "was", "we", "were", "what", "when", "which", "who", "will", "with", "you",
]
# Words that do not count among a question's keywords, and the marks cut from a word's ends.
QUESTION_WORDS = [
    "all", "and", "any", "are", "been", "but", "can", "did", "does", "for", "from", "had", "has", "have", "her", "his", "how", "not", "she",
    "some", "than", "that", "the", "them", "they", "this", "was", "were", "what", "which", "who", "will", "with", "you",
]
MARKS = ".,!?()[]\"':;"


def words(text: Column) -> Column:
    """Lower-case words of two letters or more that carry a topic, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def ngrams(unigrams: Column) -> Column:
    """Unigrams and the pairs of neighbours left after stop words are gone."""
    following = F.slice(unigrams, 2, F.greatest(F.size(unigrams) - 1, F.lit(0)))
    leading = F.slice(unigrams, 1, F.greatest(F.size(unigrams) - 1, F.lit(0)))
    return F.concat(unigrams, F.zip_with(leading, following, lambda a, b: F.concat_ws(" ", a, b)))


def hashed_ngrams(unigrams: Column) -> Column:
    """64-bit hashes of the words and of the pairs of neighbours; a pair's is made of those of its words, so that no pair is put together as text."""
    one = F.transform(unigrams, lambda w: F.xxhash64(w))
    return F.transform(F.array(one), lambda h: F.concat(h, F.zip_with(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))))[0]


def term_counts(fragments: DataFrame, by: list[str], text: str = "text", hashed: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Count of each term in each fragment; ``by`` names the corpus columns and the fragment's key.

    Texts are dealt by ``by`` once, before they are cut into terms, so that counting needs no exchange of terms; to a fixed number of
    tasks, as a task's terms are many times its texts and tasks joined by the size of texts would count too many. ``hashed`` terms are
    64-bit hashes, which all joins can do with. With ``only`` (some of ``by``, term) other terms are left out before they are counted.
    """
    found = words(F.coalesce(F.col(text), F.lit("")))
    tasks = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exploded = fragments.select(*by, text).repartition(tasks, *by).select(*by, F.explode(hashed_ngrams(found) if hashed else ngrams(found)).alias("term"))
    if only is not None:
        exploded = exploded.join(F.broadcast(only), only.columns, "left_semi")  # terms of a few queries
    return exploded.groupBy(*by, "term").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, sizes: DataFrame, corpus: list[str], max_df: float = 0.6, row: Column | None = None) -> DataFrame:
    """Smooth inverse document frequency of each term of each corpus, without terms in too many fragments.

    ``sizes`` has a row per corpus with n, its number of fragments. Where ``max_df`` would leave no room for a
    single fragment it counts as 1. ``row`` is an expression that no row has null, if rows are to be counted by it.
    """
    df = counts.groupBy(*corpus, "term").agg(F.count("*" if row is None else row).alias("df"))
    joined = df.join(sizes, corpus) if corpus else df.crossJoin(F.broadcast(sizes))  # one row
    most = F.when(F.col("n") * max_df < 1, F.col("n").cast("double")).otherwise(F.col("n") * F.lit(max_df))
    return joined.where(F.col("df") <= most).select(*corpus, "term", "df", "n", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weigh(counts: DataFrame, idfs: DataFrame, corpus: list[str], fragment: list[str]) -> tuple[DataFrame, DataFrame]:
    """Weights (tf * idf) of each fragment's terms, written once for all that read them, and the norm of each fragment."""
    weights = counts.join(idfs.select(*corpus, "term", "idf"), [*corpus, "term"]).select(*fragment, *[c for c in corpus if c not in fragment], "term", (F.col("tf") * F.col("idf")).alias("w"))
    weights, _, _ = stored(weights)
    norms = weights.groupBy(*fragment).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights, norms


def weights(counts: DataFrame, sizes: DataFrame, corpus: list[str], fragment: list[str]) -> DataFrame:
    """Weights (tf * idf) of all terms straight from the counts, which are dealt by term once, both to find how many fragments have a term and to weigh it."""
    dealt = counts.repartition(*corpus, "term")
    whole = F.when(F.col("tf") > 0, F.struct(*dealt.columns))  # reads all columns, so that both sides have one exchange
    idfs = idf(dealt, sizes, corpus, row=whole).select(*corpus, "term", "idf")
    return dealt.join(idfs.hint("shuffle_hash"), [*corpus, "term"]).select(*fragment, *[c for c in corpus if c not in fragment], "term", (F.col("tf") * F.col("idf")).alias("w"))


def norms(counts: DataFrame, sizes: DataFrame, corpus: list[str], fragment: list[str]) -> DataFrame:
    """The norm of each fragment; weights go no further than a sum of squares for each fragment and task."""
    return weights(counts, sizes, corpus, fragment).groupBy(*fragment).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def few_cosines(fragments: DataFrame, query_counts: DataFrame, sizes: DataFrame, corpus: list[str], fragment: list[str]) -> DataFrame:
    """T4: ``cosine`` for queries whose terms a task can hold, over ``fragments`` (corpus, fragment, text).

    Only terms that are asked for are kept while texts are cut, so their counts, frequencies and products are all that dot products take;
    the other terms serve the norms alone.
    """
    by = list(dict.fromkeys([*corpus, *fragment]))
    terms, _, _ = stored(query_counts.select(*corpus, "term").distinct())
    met, _, _ = stored(term_counts(fragments, by, only=terms))
    asking = asked(query_counts, stored(idf(met, sizes, corpus))[0], corpus)
    dots = met.join(F.broadcast(asking), [*corpus, "term"]).groupBy("qid", *by).agg(F.sum(F.col("qw") * F.col("tf") * F.col("idf")).alias("dot"))
    return dots.join(norms(term_counts(fragments, by), sizes, corpus, fragment), fragment).select("qid", *by, (F.col("dot") / F.col("norm")).alias("score"))


def asked(query_counts: DataFrame, idfs: DataFrame, corpus: list[str]) -> DataFrame:
    """Weights of each query's terms over its norm (qid, corpus, term, idf, qw), without terms outside the corpus's vocabulary; a table of its own, of known size."""
    known = query_counts.join(idfs.select(*corpus, "term", "idf"), [*[c for c in corpus if c in query_counts.columns], "term"])
    known = known.select("qid", *corpus, "term", "idf", (F.col("tf") * F.col("idf")).alias("qw"))
    own = known.groupBy("qid", *corpus).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    return stored(known.join(own, ["qid", *corpus]).select("qid", *corpus, "term", "idf", (F.col("qw") / F.col("qnorm")).alias("qw")))[0]


def cosine(query_counts: DataFrame, weights: DataFrame, norms: DataFrame, idfs: DataFrame, corpus: list[str], fragment: list[str]) -> DataFrame:
    """T4: cosine of each query (qid) with each fragment that shares a term with it; others are 0 and left out.

    Query terms outside the corpus's vocabulary are dropped before the query's norm is taken. Terms meet by
    an equi-join, so work follows the postings of the query terms; with few queries their terms go to the weights, which then stay where they are.
    """
    keys = ["qid", *corpus, *[c for c in fragment if c not in corpus]]
    dots = weights.join(asked(query_counts, idfs, corpus), [*corpus, "term"]).groupBy(*keys).agg(F.sum(F.col("qw") * F.col("w")).alias("dot"))
    return dots.join(norms, fragment).select("qid", *dict.fromkeys([*corpus, *fragment]), (F.col("dot") / F.col("norm")).alias("score"))


def keywords(text: Column) -> Column:
    """Different words of a question, without marks, possessives, short and question words, in order."""
    bare = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(F.btrim(w, F.lit(MARKS)), "['\u2019]s$", ""))
    return F.array_distinct(F.filter(bare, lambda w: (F.length(w) > 2) & ~w.isin(QUESTION_WORDS)))


def keyword_hits(keys: Column, text: Column) -> Column:
    """How many of the keywords occur in the text, lower-cased and without possessive endings."""
    plain = F.regexp_replace(F.lower(text), "['\u2019]s\\b", "")
    return F.size(F.filter(keys, lambda k: F.instr(plain, k) > 0)).cast("long")


def keyword_forms(keys: Column) -> Column:
    """Keywords with blanks for underscores, trimmed, without repeats and empty ones, in order."""
    return F.array_distinct(F.filter(F.transform(keys, lambda k: F.trim(F.replace(k, F.lit("_"), F.lit(" ")))), lambda k: k != ""))
