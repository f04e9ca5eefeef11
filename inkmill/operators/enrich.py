"""Calling a text generator for every row: pluggable client, retries, resumption."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.operators.records import remaining
from inkmill.plans.lineage import written


@dataclass(frozen=True)
class Policy:
    """How a client is called; the credentials stay in the environment of the workers."""

    tries: int = 3
    pause: float = 1.0
    growth: float = 2.0
    threads: int = 10
    #: Seconds that a thread waits after each call.
    throttle: float = 0.0
    #: Texts handed over at once to a client that has ``many`` (a list of texts to a list of answers).
    batch: int = 8
    head: int = 0
    strip: bool = True


class HttpClient:
    """An endpoint that speaks the common chat-completions dialect; address and key come from the environment."""

    def __init__(self, model: str, system: str, temperature: float = 0.3, most_tokens: int = 2000, timeout: float = 30.0, url_variable: str = "TEXTGEN_URL", key_variable: str = "TEXTGEN_KEY"):
        self.body = {"model": model, "temperature": temperature, "max_tokens": most_tokens}
        self.system, self.timeout, self.url_variable, self.key_variable = system, timeout, url_variable, key_variable

    @classmethod
    def from_config(cls, path: str, system: str) -> "HttpClient":
        """A client whose settings (model, temperature, most_tokens, timeout, names of variables) stand in a JSON file; no key does."""
        import json

        with open(path, encoding="utf-8") as f:
            return cls(system=system, **json.load(f))

    def __call__(self, text: str) -> str | None:
        import json
        import os
        import urllib.request

        url = os.environ[self.url_variable].rstrip("/")
        url += "" if url.endswith("/chat/completions") else "/chat/completions"
        body = self.body | {"messages": [{"role": "system", "content": self.system}, {"role": "user", "content": text}]}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.key_variable, '')}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]


def call(client: Callable[[str], str | None], text: str | None, policy: Policy) -> str | None:
    """The client's answer, tried again with growing pauses; null if it never answers."""
    if not text:
        return None
    out = _tried(lambda: client(text[: policy.head] if policy.head else text), policy)
    if policy.throttle:
        time.sleep(policy.throttle)
    return out.strip() if out is not None and policy.strip else out


def call_many(client, texts: list[str | None], policy: Policy) -> list[str | None]:
    """Answers of a batched client to non-empty texts, a batch tried again as a whole; null where it never answers."""
    asked = [i for i, t in enumerate(texts) if t]
    out: list[str | None] = [None] * len(texts)
    for at in range(0, len(asked), policy.batch):
        some = asked[at : at + policy.batch]
        heads = [texts[i][: policy.head] if policy.head else texts[i] for i in some]
        answers = _tried(lambda heads=heads: client.many(heads), policy)
        for i, a in zip(some, answers or []):
            out[i] = a.strip() if a is not None and policy.strip else a
    return out


def _tried(ask: Callable, policy: Policy):
    pause = policy.pause
    for k in range(policy.tries):
        try:
            return ask()
        except Exception:
            if k + 1 < policy.tries:
                time.sleep(pause)
                pause *= policy.growth
    return None


def enrich(df: DataFrame, text: str, client: Callable[[], Callable[[str], str | None]], out: str = "generated", policy: Policy = Policy()) -> DataFrame:
    """``df`` with the client's answer in ``out``; rows without an answer are dropped.

    ``client`` makes one client per Python worker; a partition's rows are asked for by ``policy.threads`` at a time.
    Filters and limits belong before this, and the result is to be written once: calls are not repeatable.
    """
    columns = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        with ThreadPoolExecutor(policy.threads) as pool:
            for batch in batches:
                answers = call_many(ask, list(batch[text]), policy) if hasattr(ask, "many") else list(pool.map(lambda t: call(ask, t, policy), batch[text]))
                batch = batch.assign(**{out: answers})
                yield batch[[a not in (None, "") for a in answers]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema.fields) + f", `{out}` string"
    return df.mapInPandas(run, schema)


def enrich_rest(df: DataFrame, done: DataFrame, key: str, text: str, client, most: int = 0, out: str = "generated", policy: Policy = Policy()) -> DataFrame:
    """``enrich`` for rows whose key is not done, at most ``most`` successes (0: all), in the order of keys.

    The limit bounds answers, not calls: candidates are asked in key order, block after block, until ``most`` have
    answered or none is left. Each block's answers are written, so nobody is asked twice. Keys are taken to be unique;
    with a limit, null keys are not asked for.
    """
    rest = remaining(df, done, key)
    if not most:
        return enrich(rest, text, client, out, policy)
    parts, got, size, last = [], 0, most, None
    while got < most:
        block = (rest.where(F.col(key).isNotNull()) if last is None else rest.where(F.col(key) > F.lit(last))).orderBy(key).limit(size)
        edge = block.agg(F.max(key)).head()[0]
        if edge is None:
            break
        made = written(enrich(block, text, client, out, policy))
        parts, got, last, size = [*parts, made], got + made.count(), edge, min(2 * size, max(most, 1_000_000))
    none = enrich(rest.limit(0), text, client, out, policy)
    return reduce(DataFrame.unionByName, parts).orderBy(key).limit(most) if parts else none


def length_ratio(df: DataFrame, old: str, new: str) -> DataFrame:
    """``df`` with ratio: length of ``new`` over that of ``old``, null for an empty ``old``."""
    return df.withColumn("ratio", F.round(F.try_divide(F.length(new), F.length(old)), 6))
