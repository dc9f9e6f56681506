"""Embedding providers and the column operator that calls them."""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Protocol

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.session import work_path

CALL_SIZE = 100
EMBEDDED = T.StructType(
    [
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("tokens", T.LongType()),
        T.StructField("wait_ms", T.LongType()),
        T.StructField("embed_ms", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)


class Embedder(Protocol):
    model: str
    dim: int
    local: bool

    def embed(self, texts: list[str]) -> tuple[list[list[float]], int]:
        """One vector per text, in order, and the tokens the call used."""


@lru_cache(maxsize=200_000)
def fnv1a_32(word: str) -> int:
    h = 0x811C9DC5
    for byte in word.encode():
        h = ((h ^ byte) * 0x01000193) & 0xFFFFFFFF
    return h


@dataclass(frozen=True)
class HashEmbedder:
    """Offline bag of words: each word adds 1 at its hash modulo ``dim``."""

    dim: int = 64
    model: str = "hash-embedder"
    local: bool = True

    def embed(self, texts: list[str]) -> tuple[list[list[float]], int]:
        vectors = []
        for text in texts:
            v = [0.0] * self.dim
            for word in text.lower().split():
                v[fnv1a_32(word) % self.dim] += 1.0
            vectors.append(v)
        return vectors, 0


def post_json(url: str, body: dict, headers: dict[str, str], timeout: float = 60.0) -> dict | list:
    request = urllib.request.Request(
        url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}, method="POST"
    )
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return json.load(response)


@dataclass(frozen=True)
class HttpEmbedder:
    """A provider behind HTTP.  ``style``: ``openai``, ``ollama``, or ``tei``."""

    style: str
    url: str
    model: str
    dim: int
    api_key: str = ""
    local: bool = False
    post: Callable = field(default=post_json, repr=False)

    def embed(self, texts: list[str]) -> tuple[list[list[float]], int]:
        headers = {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}
        body = {"inputs": texts} if self.style == "tei" else {"model": self.model, "input": texts}
        reply = self.post(self.url, body, headers)
        tokens = 0
        if self.style == "openai":
            vectors = [d["embedding"] for d in sorted(reply["data"], key=lambda d: d["index"])]
            tokens = reply.get("usage", {}).get("total_tokens", 0)
        elif self.style == "ollama":
            vectors, tokens = reply["embeddings"], reply.get("prompt_eval_count", 0)
        else:
            vectors = reply
        if len(vectors) != len(texts):
            raise RuntimeError(f"{self.model}: {len(vectors)} vectors for {len(texts)} texts")
        return vectors, tokens


@dataclass
class Registry:
    """Providers by model name; the only one registered is the default."""

    default_model: str | None = None
    providers: dict = field(default_factory=dict)

    def register(self, provider) -> None:
        self.providers[provider.model] = provider

    def get(self, model: str | None = None):
        name = model or self.default_model
        if name is None and len(self.providers) == 1:
            return next(iter(self.providers.values()))
        if name not in self.providers:
            raise KeyError(f"model {name!r} is not registered" if name else "no default model is configured")
        return self.providers[name]

    def local_models(self) -> list[str]:
        return sorted(m for m, p in self.providers.items() if getattr(p, "local", False))


# Answers of a provider that say nothing about the texts: sending fewer of them does not help.
NOT_THE_TEXTS = {401, 403, 404, 408, 429}


def is_outage(error: Exception) -> bool:
    """Whether the provider, and not a text, made a call fail."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code in NOT_THE_TEXTS or error.code >= 500
    return isinstance(error, OSError)


def isolate(
    embed: Callable[[list[str]], tuple[list[list[float]], int]], texts: list[str], call: Callable = lambda f, texts: f(texts)
) -> tuple[list[list[float] | None], list[str | None], int]:
    """Vectors, errors and tokens of ``texts``; a text that is refused fails alone.

    A failed call is cut in halves until the offending texts stand by themselves,
    about 2 log2(n) calls for each of them.  When the provider itself is out of
    reach, the texts of that call fail together.
    """
    vectors: list = [None] * len(texts)
    errors: list = [None] * len(texts)
    total, open_ = 0, [(0, len(texts))] if texts else []
    while open_:
        a, b = open_.pop()
        try:
            vectors[a:b], used = call(embed, texts[a:b])
            total += used
        except Exception as err:
            if b - a > 1 and not is_outage(err):
                middle = (a + b) // 2
                open_ += [(middle, b), (a, middle)]
            else:
                errors[a:b] = [f"{type(err).__name__}: {err}"[:2000]] * (b - a)
    return vectors, errors, total


class Slots:
    """One task's turns in a schedule that ``tasks`` tasks share.

    The schedule has ``rate`` slots a second, dealt in turn; a task that is late
    takes its next own slot, so all tasks together never call faster.
    """

    def __init__(self, index: int, tasks: int, rate: float, clock=time.monotonic, sleep=time.sleep) -> None:
        self.index, self.tasks, self.rate, self.clock, self.sleep = index, tasks, rate, clock, sleep
        self.start, self.next = clock(), 0

    def wait(self) -> float:
        """Seconds waited for the next own slot."""
        now = self.clock() - self.start
        turn = max(self.next, math.ceil((now * self.rate - self.index) / self.tasks))
        self.next = turn + 1
        pause = max(self.start + (self.index + turn * self.tasks) / self.rate - self.clock(), 0.0)
        if pause:
            self.sleep(pause)
        return pause


def _embedded(texts: list[str | None], embedder: Embedder, slots: Slots | None) -> list[dict | None]:
    """What was used by the calls is booked on each call's first text."""
    out: list = [None] * len(texts)
    todo = [i for i, t in enumerate(texts) if t is not None]
    for at in range(0, len(todo), CALL_SIZE):
        part = todo[at : at + CALL_SIZE]
        spent = {"wait": 0.0, "embed": 0.0}

        def call(embed, some):
            spent["wait"] += slots.wait() if slots else 0.0
            started = time.monotonic()
            try:
                return embed(some)
            finally:
                spent["embed"] += time.monotonic() - started

        vectors, errors, tokens = isolate(embedder.embed, [texts[i] for i in part], call)
        for n, (i, vector, error) in enumerate(zip(part, vectors, errors, strict=True)):
            first = n == 0
            out[i] = {
                "vector": vector,
                "tokens": tokens if first else 0,
                "wait_ms": int(spent["wait"] * 1000) if first else 0,
                "embed_ms": int(spent["embed"] * 1000) if first else 0,
                "error": error,
            }
    return out


def embed_column(text: Column, embedder: Embedder) -> Column:
    """``struct(vector, tokens, wait_ms, embed_ms, error)`` per text; NULL texts are not sent.

    Texts go out ``CALL_SIZE`` at a time, as fast as the provider answers.
    """

    @F.arrow_udf(EMBEDDED)
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(_embedded(batch.to_pylist(), embedder, None), to_arrow_type(EMBEDDED))

    # A call costs money: the optimizer must not repeat or move it.
    return embed.asNondeterministic()(text)


def embed_rows(rows: DataFrame, text: Column, embedder: Embedder, calls_per_second: float | None = None, name: str = "_call") -> DataFrame:
    """``rows`` with :func:`embed_column` of ``text``, all tasks together within ``calls_per_second``.

    A metered run is a barrier stage: its tasks start together and know how many
    they are, so each takes its own slots of one schedule.  Rows that need no call
    stay out of it.
    """
    if not calls_per_second:
        return rows.withColumn(name, embed_column(text, embedder))
    column, others = f"{name}_text", rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(name, EMBEDDED)])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        context.barrier()
        slots = Slots(context.partitionId(), len(context.getTaskInfos()), calls_per_second)
        for batch in batches:
            called = _embedded(batch.column(column).to_pylist(), embedder, slots)
            kept = [batch.column(c) for c in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(called, to_arrow_type(EMBEDDED))], names)

    asked = rows.withColumn(column, text)
    # All tasks of a barrier stage have to run at once.
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    called = asked.where(F.col(column).isNotNull()).repartition(tasks).mapInArrow(run, schema, barrier=True)
    # A stage of its own: further tasks beside it would wait for slots for ever.
    path = work_path(rows.sparkSession, "embedded")
    called.write.parquet(path)
    called = rows.sparkSession.read.schema(schema).parquet(path)
    rest = asked.where(F.col(column).isNull()).drop(column).withColumn(name, F.lit(None).cast(EMBEDDED))
    return called.unionByName(rest)
