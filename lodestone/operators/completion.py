"""Language-model providers and the column operator that calls them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions.text import echo_answer
from lodestone.operators.embedding import post_json

TIMEOUT_SECONDS = 120.0
COMPLETED = T.StructType(
    [
        T.StructField("answer", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("llm_ms", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


class LanguageModel(Protocol):
    model: str
    local: bool

    def complete(self, prompt: str) -> tuple[str, int, int]:
        """The answer, input tokens and output tokens."""


@dataclass(frozen=True)
class EchoModel:
    """The offline stub; evaluated as a Spark expression."""

    model: str = "mock-llm"
    local: bool = True


@dataclass(frozen=True)
class ChatModel:
    """A chat provider behind HTTP.  ``style``: ``openai``, ``anthropic`` or ``ollama``."""

    style: str
    url: str
    model: str
    api_key: str = ""
    local: bool = False
    max_tokens: int = 4096
    post: Callable = field(default=post_json, repr=False)

    def complete(self, prompt: str) -> tuple[str, int, int]:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}]}
        headers = {}
        if self.style == "anthropic":
            headers = {"x-api-key": self.api_key, "anthropic-version": "2023-06-01"}
            body["max_tokens"] = self.max_tokens
        elif self.style == "openai":
            headers = {"Authorization": f"Bearer {self.api_key}"}
        else:
            body["stream"] = False
        reply = self.post(self.url, body, headers, TIMEOUT_SECONDS)
        usage = reply.get("usage", {})
        if self.style == "anthropic":
            text = "".join(part.get("text", "") for part in reply["content"])
            return text, usage.get("input_tokens", 0), usage.get("output_tokens", 0)
        if self.style == "openai":
            text = reply["choices"][0]["message"]["content"]
            return text, usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0)
        return reply["message"]["content"], reply.get("prompt_eval_count", 0), reply.get("eval_count", 0)


def complete_column(prompt: Column, model: LanguageModel) -> Column:
    """``struct(answer, input_tokens, output_tokens, llm_ms, error)``; a failed call keeps its row."""
    if isinstance(model, EchoModel):
        none = F.lit(None)
        return F.struct(
            echo_answer(prompt).alias("answer"),
            none.cast("bigint").alias("input_tokens"),
            none.cast("bigint").alias("output_tokens"),
            F.lit(0).cast("bigint").alias("llm_ms"),
            none.cast("string").alias("error"),
        )

    @F.arrow_udf(COMPLETED)
    def complete(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_call(model, p) for p in batch.to_pylist()], to_arrow_type(COMPLETED))

    return complete.asNondeterministic()(prompt)


def _call(model: LanguageModel, prompt: str | None) -> dict | None:
    if prompt is None:
        return None
    started = time.monotonic()
    row = {"answer": None, "input_tokens": None, "output_tokens": None, "error": None}
    try:
        answer, used_in, used_out = model.complete(prompt)
        row["answer"] = answer
        if used_in > 0 or used_out > 0:
            row |= {"input_tokens": used_in, "output_tokens": used_out}
    except Exception as err:
        row["error"] = f"LLM call failed: {err}"
    row["llm_ms"] = int((time.monotonic() - started) * 1000)
    return row
