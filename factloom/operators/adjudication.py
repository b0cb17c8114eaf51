"""What a model may change about a verdict: its wording, and its confidence downwards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import collapsed
from .extraction import Proposer, read_json, strip_code_fences

MAX_REASON = 300
_REPLY = T.StructType([T.StructField("verdict", T.StringType()), T.StructField("reason_text", T.StringType()), T.StructField("confidence", T.DoubleType())])


@F.pandas_udf(_REPLY)
def parse_adjudication(reply: pd.Series) -> pd.DataFrame:
    """Fields of a reply; all null if it holds no object."""

    def fields(text: str | None) -> tuple:
        try:
            payload = read_json(text, (("{", "}"), ("[", "]")))
        except ValueError:
            return None, None, None
        payload = (payload[0] if payload else {}) if isinstance(payload, list) else payload
        if not isinstance(payload, dict):
            return None, None, None
        verdict, reason = payload.get("verdict"), payload.get("reason_text")
        try:
            confidence = float(payload["confidence"])
        except (KeyError, TypeError, ValueError):
            confidence = None
        return str(verdict).strip() if verdict else None, reason if isinstance(reason, str) else None, confidence

    return pd.DataFrame([fields(x) for x in reply], columns=["verdict", "reason_text", "confidence"])


def apply_adjudication(verdicts: DataFrame) -> DataFrame:
    """``verdicts`` (verdict, reason_text, confidence, reply struct) after their replies.

    A reply that argues for another verdict is refused whole. Accepted wording
    is cut to ``MAX_REASON`` signs; confidence never rises.
    """
    refused = F.coalesce((F.col("reply.verdict") != "") & (F.col("reply.verdict") != F.col("verdict")), F.lit(False))
    text = F.nullif(F.substring(collapsed(F.col("reply.reason_text")), 1, MAX_REASON), F.lit(""))
    text = F.when(~refused, text)
    stated = F.when(~F.isnan("reply.confidence"), F.col("reply.confidence"))
    lower = F.when(~refused & stated.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), stated)))
    return verdicts.withColumns(
        {
            "adjudicated": text.isNotNull() | lower.isNotNull(),
            "reason_text": F.coalesce(text, "reason_text"),
            "confidence": F.least("confidence", F.coalesce(lower, "confidence")),
        }
    ).drop("reply")


def adjudicate(verdicts: DataFrame, propose: Proposer, prompt: str = "prompt") -> DataFrame:
    """Ask a proposer about every verdict (with a prompt column); failures leave the rules' wording."""
    asked = propose(verdicts.withColumnRenamed(prompt, "prompt") if prompt != "prompt" else verdicts)
    parsed = asked.withColumn("reply", parse_adjudication(strip_code_fences(F.col("reply"))))
    return apply_adjudication(parsed.drop("error"))
