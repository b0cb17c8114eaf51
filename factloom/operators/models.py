"""Calling a text model from executors: spacing, retries, quotas, and errors as a column.

``called`` turns any function from prompt to text into a proposer. Every
Python worker spaces its own calls; a quota that waiting can't clear ends the
calls of that partition, and the prompts left get its error, so that what is
done so far is kept.
"""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .extraction import Proposer

# HTTP statuses that may pass by themselves.
TRANSIENT = frozenset({408, 429, 500, 502, 503, 504})
TOO_MANY = 429


class ModelError(RuntimeError):
    """A refused call, with its HTTP status if it has one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class QuotaExhausted(RuntimeError):
    """A quota that more tries won't clear."""


@dataclass(frozen=True)
class Calling:
    """How calls are made; ``from_conf`` reads the same names under ``factloom.model.``."""

    attempts: int = 4
    backoff: float = 1.0
    spacing: float = 6.0

    @staticmethod
    def from_conf(spark: SparkSession) -> Calling:
        base = Calling()
        read = {name: spark.conf.get(f"factloom.model.{name}", str(getattr(base, name))) for name in ("attempts", "backoff", "spacing")}
        return Calling(int(read["attempts"]), float(read["backoff"]), float(read["spacing"]))


class Spacer:
    """Keeps calls ``gap`` seconds apart."""

    def __init__(self, gap: float, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic):
        self.gap, self.sleep, self.now, self.last = gap, sleep, now, None

    def wait(self) -> float:
        """Sleep as long as needed; returns for how long."""
        due = 0.0 if self.last is None or self.gap <= 0 else max(0.0, self.last + self.gap - self.now())
        if due:
            self.sleep(due)
        self.last = self.now()
        return due


def quota(message: str) -> tuple[bool, float | None]:
    """Whether a refusal names a daily quota, and the seconds after which it invites another try."""
    asked = re.search(r"retryDelay['\"]?\s*:\s*['\"]?(\d+(?:\.\d+)?)s", message) or re.search(r"retry in (\d+(?:\.\d+)?)s", message)
    return "PerDay" in message or "per day" in message.lower(), float(asked[1]) if asked else None


def call(model: Callable[[str], str], prompt: str, how: Calling = Calling(), spacer: Spacer | None = None) -> str:
    """The model's reply, after as many tries as its refusals are worth."""
    spacer = spacer or Spacer(how.spacing)
    for left in range(how.attempts - 1, -1, -1):
        spacer.wait()
        try:
            return model(prompt) or ""
        except ModelError as refused:
            daily, asked = quota(str(refused)) if refused.status == TOO_MANY else (False, None)
            if refused.status == TOO_MANY and (daily or not left):
                raise QuotaExhausted("the model's quota is used up; finished work is kept") from refused
            if refused.status not in TRANSIENT or not left:
                raise
            spacer.sleep(asked or how.backoff * 2 ** (how.attempts - 1 - left) * (0.5 + random.random()))
    raise ValueError("attempts must be positive")


def called(model: Callable[[str], str], how: Calling = Calling()) -> Proposer:
    """A proposer that calls ``model`` for every prompt, in batches on the executors."""

    def propose(prompts: DataFrame) -> DataFrame:
        schema = T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            spacer, ended = Spacer(how.spacing), None
            for frame in frames:
                replies, errors = [], []
                for prompt in frame["prompt"]:
                    reply = error = None
                    try:
                        if ended:
                            raise QuotaExhausted(ended)
                        reply = call(model, prompt, how, spacer)
                    except QuotaExhausted as stop:
                        ended = error = str(stop)
                    except ModelError as refused:
                        error = str(refused)
                    replies.append(reply)
                    errors.append(error)
                yield frame.assign(reply=pd.Series(replies, index=frame.index, dtype="object"), error=pd.Series(errors, index=frame.index, dtype="object"))

        return prompts.mapInPandas(ask, schema)

    return propose
