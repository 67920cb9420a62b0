"""The build without classes: a fold that updates the instances which a message is like, and makes new ones of the rest."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadloom.functions import text as tx
from threadloom.streaming.build import PROVIDER, ROCKS, Weights, best_scores, terms

STATE = "dialog bigint, instance_no bigint, labels array<bigint>, text string, step bigint"


class Writer(Protocol):
    """What a language model does for the build: texts of new instances from messages, and an instance's text with new messages."""

    def create(self, messages: list[str], context: str) -> list[tuple[str, list[int]]]: ...

    def update(self, text: str, messages: list[str]) -> str: ...


class Plain:
    """A writer without a model: each message is an instance, and new messages stand below an instance's text."""

    def create(self, messages: list[str], context: str) -> list[tuple[str, list[int]]]:
        return [(m, [i]) for i, m in enumerate(messages)]

    def update(self, text: str, messages: list[str]) -> str:
        new = "\n".join(messages)
        return f"{text}\n{new}".strip(" ") if text else new


class Instances(StatefulProcessor):
    """What each batch changes in its dialog: instances that it updates, which keep their number, and new ones, which get the next.

    A message goes to every instance whose text is as like to it as the threshold asks, over the dialog's instances as they were
    before the batch. State is a map from number to labels, text and term counts, written for changed instances only, and one value with
    the finished step, the number of instances and the document frequencies.
    """

    def __init__(self, threshold: float, make_writer: Callable[[], Writer]):
        self.threshold, self.make_writer = threshold, make_writer
        self.stop = set(tx.STOP_WORDS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.instances = handle.getMapState("instances", "instance_no bigint", "labels array<bigint>, text string, terms array<string>, counts array<bigint>")
        self.totals = handle.getValueState("totals", "step bigint, n bigint, terms array<string>, df array<bigint>")
        self.writer = self.make_writer()

    def counts(self, text: str) -> Counter:
        return terms([w for w in regex.findall(tx.WORD, text.lower()) if w not in self.stop])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n, df, made = -1, 0, {}, []
        if self.totals.exists():
            last, n, names, counts = self.totals.get()
            df = dict(zip(names, counts))
        batch = pd.concat(list(rows)).sort_values(["step", "label"])
        for step, now in batch[batch["step"] > last].groupby("step", sort=True):
            labels, said = now["label"].tolist(), now["message"].tolist()
            held = ((k[0], v[2], v[3]) for k, v in self.instances.iterator()) if n else ()
            found = best_scores([self.counts(m) for m in said], Weights(df, n), held)
            matches = [[k for k, s in f.items() if s >= self.threshold] for f in found]
            changed: dict[int, list[int]] = {}
            for i, of in enumerate(matches):
                for k in of:
                    changed.setdefault(k, []).append(i)
            fresh = [i for i, of in enumerate(matches) if not of]
            writes = []
            for k, of in sorted(changed.items()):
                had, text, names, _ = self.instances.getValue((k,))
                for t in names:
                    df[t] -= 1
                writes.append((k, [*had, *(labels[i] for i in of)], self.writer.update(text, [said[i] for i in of])))
            for text, of in self.writer.create([said[i] for i in fresh], now["context"].iloc[0]) if fresh else []:
                n += 1
                writes.append((n, [labels[fresh[i]] for i in of], text))
            for k, own, text in writes:
                c = self.counts(text)
                for t in c:
                    df[t] = df.get(t, 0) + 1
                self.instances.updateValue((k,), (own, text, list(c), list(c.values())))
                made.append((key[0], k, own, text, step))
            last = step
        if made:
            kept = {t: d for t, d in df.items() if d}
            self.totals.update((int(last), n, list(kept), list(kept.values())))
        yield pd.DataFrame(made, columns=[c.split()[0] for c in STATE.split(", ")])

    def close(self) -> None:
        pass


def fold(messages: DataFrame, threshold: float = 0.9, make_writer: Callable[[], Writer] = Plain) -> DataFrame:
    """Every version of every instance (STATE; ``step`` made it) from messages (dialog, step, label, message, context), a table or a stream of whole batches."""
    spark = messages.sparkSession
    spark.conf.set(PROVIDER, ROCKS)
    spark.streams.active  # keeps the coordinator of state stores
    rows = messages.select("dialog", "step", "label", F.coalesce("message", F.lit("")).alias("message"), F.coalesce("context", F.lit("")).alias("context"))
    return rows.groupBy("dialog").transformWithStateInPandas(Instances(threshold, make_writer), STATE, "Append", "None")


def latest(versions: DataFrame) -> DataFrame:
    """Each instance as its last step left it."""
    last = versions.groupBy("dialog", "instance_no").agg(F.max_by(F.struct("labels", "text", "step"), "step").alias("x"))
    return last.select("dialog", "instance_no", "x.labels", "x.text", "x.step")
