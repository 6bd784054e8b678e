"""Sink for a language model: each partition sends its rows to a client that the caller provides."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Client = Callable[[str], str]


def with_retries(call: Client, prompt: str, tries: int = 4, base: float = 1.0, most: float = 30.0) -> str:
    """Waits twice as long after each failure, up to a limit, with a fifth of it at random."""
    for k in range(tries):
        try:
            return call(prompt)
        except (OSError, RuntimeError):
            if k == tries - 1:
                raise
            time.sleep(min(most, base * 2**k) * (1 + random.random() / 5))
    raise AssertionError


def complete(prompts: DataFrame, connect: Callable[[], Client], **retries: float) -> DataFrame:
    """id, reply for each (id, prompt). connect makes a partition's client; calls must be repeatable, for tasks may be."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = connect()
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "reply": [with_retries(client, p, **retries) for p in b["prompt"]]})

    return prompts.select("id", "prompt").mapInPandas(run, "id long, reply string")
