"""Calls of a language model as a table operation, with a stand-in that needs no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from threadloom.functions.json_repair import strict


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...


class Recorded:
    """A client without a network: its prompts are replies that were recorded before, and it gives them back."""

    def complete(self, prompt: str) -> str:
        return prompt


def ask(rows: DataFrame, prompt: str, make_client: Callable[[], Client], tries: int = 2, wait: float = 0.0) -> DataFrame:
    """``rows`` with answer and status (ok, empty, bad_json), one client a task, ``tries`` calls a row, n times ``wait`` seconds after the n-th.

    An answer that ``json_repair.strict`` can read is ok and is given as the JSON that was read; another one is given as it came.
    Rows come in Arrow batches; a call that raises counts as empty after the last try, and no row is lost.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            answers, states = [], []
            for text in batch[prompt]:
                answer, state = "", "empty"
                for n in range(tries):
                    if n and wait:
                        time.sleep(n * wait)
                    try:
                        answer = client.complete(text or "")
                    except Exception:
                        continue
                    if answer and answer.strip():
                        if (found := strict(answer)) is not None:
                            answer, state = found, "ok"
                            break
                        state = "bad_json"
                answers.append(answer)
                states.append(state)
            yield batch.assign(answer=answers, status=states)

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType()), T.StructField("status", T.StringType())]))
