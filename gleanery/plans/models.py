"""Models behind one call: prompts in, raw text and token counts out."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ModelClient(Protocol):
    """Anything that answers a prompt: (text, prompt tokens, completion tokens)."""

    def __call__(self, prompt: str) -> tuple[str, int, int]: ...


@dataclass(frozen=True)
class StubModel:
    """A deterministic model for tests: letters from the prompt's hash, a token per four characters."""

    letters: int = 2

    def __call__(self, prompt: str) -> tuple[str, int, int]:
        digest = hashlib.sha256(prompt.encode()).digest()
        chosen = sorted({"ABCD"[b % 4] for b in digest[: self.letters]})
        return "最终答案：" + "".join(chosen), len(prompt) // 4, 4


def ask(prompts: DataFrame, client: Callable[[str], tuple[str, int, int]], attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """``prompts`` (..., prompt) with raw_answer, prompt_tokens, completion_tokens and error.

    A model call has no built-in form, so this stage runs Python on batches. Attempts are repeated
    inside the task (a repeated task would call, and pay, again). Write the result before using it twice.
    """
    names = prompts.columns
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields) + ", raw_answer string, prompt_tokens bigint, completion_tokens bigint, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for prompt in batch["prompt"]:
                error = None
                for k in range(attempts):
                    try:
                        rows.append((*client(prompt), None))
                        break
                    except Exception as e:  # noqa: BLE001 - recorded in the row
                        error = str(e)
                        if k + 1 < attempts:
                            time.sleep(wait * (k + 1))
                else:
                    rows.append(("", 0, 0, error))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=["raw_answer", "prompt_tokens", "completion_tokens", "error"])], axis=1)[[*names, "raw_answer", "prompt_tokens", "completion_tokens", "error"]]

    return prompts.mapInPandas(run, shape)


def or_default(answer: F.Column) -> F.Column:
    """Whatever went wrong, the answer is A."""
    return F.coalesce(F.nullif(answer, F.lit("")), F.lit("A"))
