"""Reading of almost-JSON: what parses goes through Spark, only the rest through a small Python helper."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def repair(text: str | None) -> str | None:
    """Valid JSON for the first object or array in a text, or None.

    In turn: fences go, the outermost brackets are cut out, control characters are escaped, backslashes that
    escape nothing are doubled, trailing commas go, single quotes turn double, and what is open is closed.
    """
    if not text:
        return None
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text.strip())
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    body = body[start:]
    closing = body.rfind("}" if body[0] == "{" else "]")
    tries = [body[: closing + 1]] if closing > 0 else []
    tries.append(body)
    steps = [
        lambda s: s,
        lambda s: re.sub(r'"(?:[^"\\]|\\.)*"', lambda m: re.sub(r"[\x00-\x1f]", lambda c: json.dumps(c[0])[1:-1], m[0]), s, flags=re.S),
        lambda s: re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", s),
        lambda s: re.sub(r",(\s*[}\]])", r"\1", s),
        lambda s: re.sub(r"'([^'\"]*)'", r'"\1"', s),
        _closed,
    ]
    for attempt in tries:
        for step in steps:
            attempt = step(attempt)
            try:
                return json.dumps(json.loads(attempt), ensure_ascii=False)
            except ValueError:
                continue
    return None


def strict(text: str | None) -> str | None:
    """Valid JSON for a reply that is an object or an array but for a fence around it, words outside, apostrophes that are escaped and trailing commas; None for others, which count as broken."""
    body = (text or "").strip()
    if fenced := re.search(r"```(?:json)?\s*(.*?)\s*```", body, re.S | re.I):
        body = fenced[1]
    spans = [(i, j + 1) for i, j in ((body.find(a), body.rfind(b)) for a, b in ("[]", "{}")) if -1 < i < j]
    if spans:
        begin, end = min(spans)
        body = body[begin:end]
    bare = body.replace("\\'", "'")
    for attempt in (body, bare, re.sub(r",\s*([}\]])", r"\1", body), re.sub(r",\s*([}\]])", r"\1", bare)):
        try:
            found = json.loads(attempt)
        except ValueError:
            continue
        return json.dumps(found, ensure_ascii=False) if isinstance(found, dict | list) else None
    return None


def _closed(text: str) -> str:
    """The text with an open string and open brackets closed, a dangling comma or key taken off."""
    stack, inside, escaped = [], False, False
    for c in text:
        if inside:
            escaped, inside = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c == '"':
            inside = True
        elif c in "{[":
            stack.append("}" if c == "{" else "]")
        elif c in "}]" and stack:
            stack.pop()
    text = re.sub(r'(,\s*("[^"]*"\s*:?\s*)?|"[^"]*"\s*:\s*)$', "", text + '"' * inside)
    return text + "".join(reversed(stack))


@F.pandas_udf(T.StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repair, na_action="ignore")


def parsed(text: Column) -> Column:
    """The text if Spark can parse it, its repaired form else; null where nothing helps."""
    fine = F.try_parse_json(text).isNotNull()
    return F.when(fine, text).otherwise(_repaired(F.when(~fine, text)))
