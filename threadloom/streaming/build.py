"""The build as a fold over a stream of batches: a dialog's classes and term counts are its state."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadloom.functions import text as tx
from threadloom.operators.build import NAME, STATE
from threadloom.sources import store

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ["dialog", "class_no", "instance_no"]


def terms(words: list[str]) -> Counter:
    """Counts of words and of pairs of neighbours, as ``tx.ngrams`` makes them."""
    return Counter([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])


class Weights:
    """Inverse document frequencies of one dialog as they stand: ``df`` by term over ``n`` fragments."""

    def __init__(self, df: dict[str, int], n: int):
        self.df, self.n, self.most, self.by_df = df, n, max(0.6 * n, 1.0) if 0.6 * n >= 1 else float(n), {}

    def of(self, term: str) -> float:
        """0 for terms that no fragment or too many fragments hold."""
        df = self.df.get(term, 0)
        if not df or df > self.most:
            return 0.0
        if df not in self.by_df:
            self.by_df[df] = math.log((1 + self.n) / (1 + df)) + 1
        return self.by_df[df]


def best_scores(asked: list[Counter], weights: Weights, fragments: Iterator[tuple]) -> list[dict[int, float]]:
    """For each message the cosine with each owner's best fragment, from fragments (owner, terms, counts) read one by one; owners that share no term are left out."""
    wanted: dict[str, list[tuple[int, float]]] = {}
    for i, counts in enumerate(asked):
        own = {t: n * weights.of(t) for t, n in counts.items() if weights.of(t)}
        norm = math.sqrt(sum(w * w for w in own.values()))
        for t, w in own.items():
            wanted.setdefault(t, []).append((i, w / norm))
    best: list[dict[int, float]] = [{} for _ in asked]
    for owner, names, counts in fragments:
        square, dots = 0.0, {}
        for t, n in zip(names, counts):
            w = n * weights.of(t)
            square += w * w
            for i, q in wanted.get(t, ()):
                dots[i] = dots.get(i, 0.0) + q * w
        for i, d in dots.items():
            best[i][owner] = max(round(d / math.sqrt(square), 6), best[i].get(owner, 0.0))
    return best


class Fold(StatefulProcessor):
    """The instances that each batch adds to its dialog.

    State of a dialog: its fragments as a list (class names, numbered 0, and instances, with their term counts), the last number of each
    class as a map, and one value with the finished step, the number of fragments and the running document frequencies. A
    step reads the dialog's own fragments one by one, as all weights move with every new fragment; what is held at
    a time is the vocabulary of the dialog and what the trigger itself adds. Steps that are done are passed over.
    """

    def __init__(self, threshold: float, most: int):
        self.threshold, self.most = threshold, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fragments = handle.getListState("fragments", "class_no bigint, instance_no bigint, terms array<string>, counts array<bigint>")
        self.classes = handle.getMapState("classes", "class_no bigint", "last bigint")
        self.totals = handle.getValueState("totals", "step bigint, n bigint, terms array<string>, df array<bigint>")

    def route(self, asked: list[Counter], weights: Weights, added: list[tuple]) -> list[list[int]]:
        """For each message the best classes at the threshold or above."""
        stored = ((f[0], f[2], f[3]) for f in self.fragments.get()) if self.had else ()
        best = best_scores(asked, weights, chain(stored, ((c, t.keys(), t.values()) for c, _, t in added)))
        return [[c for c, s in sorted(b.items(), key=lambda x: (-x[1], x[0])) if s >= self.threshold][: self.most] for b in best]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n, df = -1, 0, {}
        self.had = self.totals.exists()
        if self.had:
            last, n, names, counts = self.totals.get()
            df = dict(zip(names, counts))
        batch = pd.concat(list(rows)).sort_values(["step", "label"])
        numbers = {int(k[0]): int(v[0]) for k, v in self.classes.iterator()} if self.had else {}
        added, made, touched = [], [], set()
        for step, now in batch[batch["step"] > last].groupby("step", sort=True):
            words = [list(w) for w in now["words"]]
            weights = Weights(df, n)
            places = self.route([terms(w) for w in words], weights, added) if numbers else [[] for _ in words]
            labels, texts = now["label"].tolist(), now["message"].tolist()
            groups: dict[int, list[int]] = {}
            for i, found in enumerate(places):
                for c in found or [0]:
                    groups.setdefault(c, []).append(i)
            for c in sorted(groups, key=lambda x: (x == 0, x)):
                rows_of = groups[c]
                said, own = "\n".join(texts[i] for i in rows_of), [w for i in rows_of for w in words[i]]
                if c == 0:
                    c = max(numbers, default=0) + 1
                    before = now["context"].iloc[0]
                    if before != "":
                        said, own = f"{before}\n{said}", [*now["before"].iloc[0], *own]
                    added.append((c, 0, terms(re.findall(r"\w{2,}", NAME.lower()))))
                numbers[c] = numbers.get(c, 0) + 1
                touched.add(c)
                added.append((c, numbers[c], terms(own)))
                made.append((key[0], c, numbers[c], NAME, [labels[i] for i in rows_of], said, step))
            for f in added[len(added) - len(groups) - (0 in groups) :]:
                n += 1
                for t in f[2]:
                    df[t] = df.get(t, 0) + 1
            last = step
        if made:
            self.fragments.appendList([(c, i, list(t), list(t.values())) for c, i, t in added])
            for c in touched:
                self.classes.updateValue((c,), (numbers[c],))
            self.totals.update((int(last), n, list(df), list(df.values())))
        yield pd.DataFrame(made, columns=[c.split()[0] for c in STATE.split(", ")])

    def close(self) -> None:
        pass


def fold(messages: DataFrame, threshold: float = 0.5, most: int = 3) -> DataFrame:
    """Instances (STATE) of all dialogs from messages (dialog, step, label, message, context), a table or a stream of whole batches.

    Dialogs are dealt by key; a batch touches its own dialog only. The result is that of ``operators.build.build``.
    """
    messages.sparkSession.conf.set(PROVIDER, ROCKS)  # the one store that has lists and maps
    messages.sparkSession.streams.active  # the manager of streams also keeps the coordinator of state stores, which a table's job needs too
    said = F.coalesce("message", F.lit(""))
    rows = messages.select("dialog", "step", "label", said.alias("message"), F.coalesce("context", F.lit("")).alias("context")).withColumns({"words": tx.words(F.col("message")), "before": tx.words(F.col("context"))})
    return rows.groupBy("dialog").transformWithStateInPandas(Fold(threshold, most), STATE, "Append", "None")


def advance(messages: DataFrame, folder: str, source: str, threshold: float = 0.5, most: int = 3) -> DataFrame:
    """Fold all that the stream ``messages`` has for now into ``folder``, and read the whole state.

    Called again after an end or a failure it goes on from its checkpoint. Each trigger writes its own version, and one that
    is run again overwrites it. ``source`` names what is folded; the folder refuses another.
    """
    spark = messages.sparkSession
    store.guard(spark, folder, source)

    def write(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/versions/{epoch:06d}")

    query = fold(messages, threshold, most).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return snapshot(spark, folder)


def snapshot(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """The state as of version ``upto`` (from 0), the last one if none is named; versions that were not finished are not there."""
    done = store.finished(spark, f"{folder}/versions")
    done = [p for p in done if upto is None or int(p.rsplit("/", 1)[1]) <= upto]
    return spark.read.schema(STATE).parquet(*done) if done else spark.createDataFrame([], STATE)


def since(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """Instances that the last version has and ``version`` has not."""
    return snapshot(spark, folder).join(snapshot(spark, folder, version), KEYS, "left_anti")
