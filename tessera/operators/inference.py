"""Batch inference surface (M1): prompts -> responses through Arrow batches.

``predictor_factory`` returns ``list[str] -> list[str]``. ``generate`` calls it once per
task and cuts batches by row count. ``generate_batches`` keeps the predictor in the worker
process, builds batches of similar length under a token budget, and survives prompts
that the predictor fails on. Row keys travel with the prompts, so no positional gather
is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Predictor = Callable[[list[str]], list[str]]


def generate(df: DataFrame, predictor_factory: Callable[[], Predictor], prompt: str = "prompt",
             out: str = "response", batch_size: int = 8) -> DataFrame:
    """M1: add ``out`` = predictor(prompt) computed in mini-batches of
    ``batch_size`` inside ``mapInPandas``."""
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType(), True)])

    def run(batches):
        predict = predictor_factory()
        for pdf in batches:
            texts = pdf[prompt].fillna("").tolist()
            res: list[str] = []
            for i in range(0, len(texts), batch_size):
                res.extend(predict(texts[i:i + batch_size]))
            pdf[out] = res
            yield pdf

    return df.mapInPandas(run, schema)


#: Predictors of this worker process, by the caller's name for them.
_KEPT: dict[str, Predictor] = {}


def word_tokens(text: str) -> int:
    """Whitespace tokens, as the default tokenizer counts them."""
    return len([t for t in text.replace("\n", " ").split(" ") if t])


def length_batches(lengths: Sequence[int], budget: int, most_rows: int) -> Iterator[list[int]]:
    """Row numbers in batches of similar length: the longest times the rows is at most
    ``budget`` (a longer prompt is alone)."""
    batch: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if batch and (len(batch) == most_rows or lengths[i] * (len(batch) + 1) > budget):
            yield batch
            batch = []
        batch.append(i)
    if batch:
        yield batch


class _Caller:
    """Calls a predictor; a call that raises or answers short is repeated with a new
    predictor, then made row by row, and rows that still fail are set apart."""

    def __init__(self, factory: Callable[[], Predictor], keep: str | None, retries: int):
        self.factory, self.keep, self.retries, self.predict = factory, keep, retries, None

    def _predictor(self, anew: bool) -> Predictor:
        if self.keep is None:
            self.predict = self.factory() if anew or self.predict is None else self.predict
            return self.predict
        if anew or self.keep not in _KEPT:
            _KEPT[self.keep] = self.factory()
        return _KEPT[self.keep]

    def _once(self, texts: list[str], anew: bool) -> list[str]:
        answers = list(self._predictor(anew)(texts))
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers to {len(texts)} prompts")
        return answers

    def answers(self, texts: list[str]) -> list[tuple[str | None, str | None]]:
        """(answer, error) of each prompt."""
        error = ""
        for attempt in range(1 + self.retries):
            try:
                return [(a, None) for a in self._once(texts, attempt > 0)]
            except Exception as e:  # noqa: BLE001 - whatever the model raises is the row's error
                error = f"{type(e).__name__}: {e}"
        if len(texts) == 1:
            return [(None, error)]
        return [x for t in texts for x in self.answers([t])]


def generate_batches(df: DataFrame, predictor_factory: Callable[[], Predictor], prompt: str = "prompt", out: str = "response",
                     budget: int = 2048, most_rows: int = 64, tokens: Callable[[str], int] = word_tokens,
                     retries: int = 1, keep: str | None = None) -> DataFrame:
    """M1: add ``out``, ``status`` (ok / failed), ``error``, and the rows and padded tokens
    of the batch that a prompt was in. Null prompts count as empty. ``keep`` names the
    predictor in the worker process, where later tasks find it; without it a task makes
    its own. The answer to a prompt must not depend on its batch."""
    added = [(out, pa.string()), ("status", pa.string()), ("error", pa.string()), ("batch_rows", pa.int32()), ("batch_tokens", pa.int64())]
    kinds = {pa.string(): T.StringType(), pa.int32(): T.IntegerType(), pa.int64(): T.LongType()}
    schema = T.StructType(df.schema.fields + [T.StructField(n, kinds[t], True) for n, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = _Caller(predictor_factory, keep, retries)
        for batch in batches:
            texts = [t or "" for t in batch.column(prompt).to_pylist()]
            lengths = [tokens(t) for t in texts]
            rows: list[tuple] = [()] * len(texts)
            for at in length_batches(lengths, budget, most_rows):
                padded = max(lengths[i] for i in at) * len(at)
                for i, (answer, error) in zip(at, caller.answers([texts[i] for i in at])):
                    rows[i] = (answer, "ok" if error is None else "failed", error, len(at), padded)
            columns = [pa.array([r[c] for r in rows], t) for c, (_, t) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(n for n, _ in added)])

    return df.mapInArrow(run, schema)
