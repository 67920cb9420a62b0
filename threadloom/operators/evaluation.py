"""Roll-ups of judged answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.json_repair import parsed

RIGHT, WRONG = "CORRECT", "WRONG"


def judge_label(answer: Column) -> Column:
    """Label of a judge's answer: a ``label`` field of the object in it, which is repaired if need be, else such a field as text, else the last of its lines that is a label and nothing else, else WRONG.

    Words inside a sentence never count, so that "not correct" and "it is correct, I think" are WRONG. Null counts as empty.
    """
    text = F.coalesce(answer, F.lit(""))
    held = F.upper(F.trim(F.get_json_object(parsed(F.when(F.contains(text, F.lit("{")), text)), "$.label")))
    field = F.upper(F.regexp_extract(text, r'(?i)"label"\s*:\s*"(correct|wrong)"', 1))
    lines = F.transform(F.split(text, r"[\r\n\x0B\f\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.upper(F.regexp_replace(x, r"^\s+|\s+$", "")))
    last = F.try_element_at(F.filter(lines, lambda x: x.isin(RIGHT, WRONG)), F.lit(-1))
    return F.when(held.isin(RIGHT, WRONG), held).when(field != "", field).otherwise(F.coalesce(last, F.lit(WRONG)))


def asked(questions: DataFrame, order: str, most: int = 0, skip: int | None = None, only: int | None = None, category: str = "category") -> DataFrame:
    """The questions to ask: the first ``most`` in order (0: all), and of these none of category ``skip`` or just those of ``only``."""
    first = questions.orderBy(order).limit(most) if most else questions
    keep = F.lit(True) if skip is None else F.col(category) != skip
    return first.where(keep if only is None else keep & (F.col(category) == only))


def accuracy(rows: DataFrame, by: list[str], right: Column) -> DataFrame:
    """A1, A2: right, wrong, total and accuracy; an empty group has accuracy 0."""
    out = rows.groupBy(*by).agg(F.sum(right.cast("long")).alias("n_right"), F.count("*").alias("n_total"))
    return out.select(*by, F.coalesce("n_right", F.lit(0)).cast("long").alias("n_right"), (F.col("n_total") - F.coalesce("n_right", F.lit(0))).alias("n_wrong"), "n_total", F.round(F.coalesce(F.col("n_right") / F.nullif(F.col("n_total"), F.lit(0)), F.lit(0.0)), 6).alias("accuracy"))


def delta_to_first(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Difference of each condition to the first; conditions are a few rows."""
    return rows.withColumn("delta", F.round(F.col(value) - F.first(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 6))


def token_f1(gold: Column, said: Column) -> Column:
    """F1 of different words of two texts; two empty texts agree."""
    a, b = (F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) for c in (gold, said))
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


@F.pandas_udf(T.IntegerType())
def common_length(first: pd.Series, second: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two lists of words.

    Bit i of a number stands for word i of the first list; a word of the second list clears, of each run of bits between
    its places, the lowest one that is still set, by one addition with carry.
    """

    def length(a, b) -> int:
        places: dict[str, int] = {}
        for i, w in enumerate(a):
            places[w] = places.get(w, 0) | 1 << i
        row = every = (1 << len(a)) - 1
        for w in b:
            hit = row & places.get(w, 0)
            row = (row + hit | row - hit) & every
        return len(a) - row.bit_count()

    return pd.Series([length(a, b) for a, b in zip(first, second)], dtype="int32")


def rouge_l(gold: Column, said: Column) -> Column:
    """F1 of the longest common subsequence of the words of two texts; two empty texts agree."""
    a, b = (F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)) for c in (gold, said))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(2.0 * common_length(a, b) / (F.size(a) + F.size(b)))


def slot_f1(rows: DataFrame, by: list[str], gold: str, said: str) -> DataFrame:
    """Precision, recall and F1 of slots, summed over the rows of each group, and the share of rows whose slots all agree (joint goal), from two array columns; null counts as no slots."""
    a, b = (F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in (gold, said))
    hit = F.size(F.array_intersect(a, b))
    sums = rows.groupBy(*by).agg(F.sum(hit).alias("hit"), F.sum(F.size(b)).alias("said"), F.sum(F.size(a)).alias("gold"), F.avg(((hit == F.size(a)) & (hit == F.size(b))).cast("double")).alias("joint"))
    share = lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0))
    p, r = share(F.col("hit"), F.col("said")), share(F.col("hit"), F.col("gold"))
    return sums.select(*by, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(share(2.0 * F.col("hit"), F.col("said") + F.col("gold")), 6).alias("f1"), F.round("joint", 6).alias("joint_goal"))


# The running probabilities of 0, 1, 2, ... draws of a row in one replicate, Poisson with mean 1.
_POISSON = [0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759, 0.999989751]


def draws(key: Column, replicate: Column) -> Column:
    """How often a row is drawn in a replicate: Poisson with mean 1 from a hash of both, so the same wherever and whenever it is asked."""
    u = F.conv(F.substring(F.md5(F.concat_ws("/", key.cast("string"), replicate.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return sum((F.when(u >= p, 1).otherwise(0) for p in _POISSON), F.lit(0))


def bootstrap(rows: DataFrame, by: list[str], key: str, values: list[str], replicates: int = 1000, level: float = 0.95) -> DataFrame:
    """(by, value, mean, low, high) of each of ``values``: the mean and the ends of its bootstrap interval, by percentile.

    Each row weighs in every replicate as often as ``draws`` says. All replicates are one aggregation whose sums are combined before the
    shuffle, so what is sent is a row a group, replicate and task. A paired difference of two systems is the interval of a column that
    holds each row's difference.
    """
    every = rows.select(*by, F.col(key).alias("_key"), *[F.col(v).alias(f"_{k}") for k, v in enumerate(values)], F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_r"))
    drawn = every.withColumn("_n", draws(F.col("_key"), F.col("_r"))).where("_n > 0")
    sums = drawn.groupBy(*by, "_r").agg(*[(F.sum(F.col("_n") * F.col(f"_{k}")) / F.sum("_n")).alias(f"_{k}") for k in range(len(values))])
    ends = sums.groupBy(*by).agg(*[F.percentile(f"_{k}", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias(f"_{k}") for k in range(len(values))])
    means = rows.groupBy(*by).agg(*[F.avg(v).alias(f"_m{k}") for k, v in enumerate(values)])
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("value"), F.col(f"_m{k}").alias("mean"), F.col(f"_{k}").alias("ends")) for k, v in enumerate(values)])).alias("x")
    return means.join(ends, by).select(*by, each).select(*by, "x.value", F.round("x.mean", 6).alias("mean"), F.round(F.col("x.ends")[0], 6).alias("low"), F.round(F.col("x.ends")[1], 6).alias("high"))


def latex_row(*cells: Column) -> Column:
    """Cells as a row of a LaTeX table, with its special marks escaped."""
    plain = [F.regexp_replace(F.coalesce(c, F.lit("--")), r"([&%$#_{}])", r"\\$1") for c in cells]
    return F.concat(F.concat_ws(" & ", *plain), F.lit(r" \\"))
