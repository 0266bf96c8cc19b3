"""Texts to vectors through a model that takes batches, overflows and fails.

Inside a task the rows of an Arrow batch are folded by text and sorted by length, and filled into calls of at most ``ROWS``
texts whose padded size (texts times the longest) stays within a budget. A call that fails is cut in two and each half is
tried again, down to single texts. A single text that overflows the model's context is halved, at most ``HALVINGS`` times; one
that fails otherwise is tried once more. Each row keeps its place: what has no vector is null, with the reason beside it.

Defined results: null and blank texts are not sent and have no vector (status ``blank``); repeated texts of a batch are sent
once; a text over the budget is a call of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of one call, halvings of a text that overflows.
ROWS, HALVINGS = 24, 4
#: Characters of one call, padding counted.
BUDGET = 48_000

Model = Callable[[list[str]], Sequence[Sequence[float] | None]]
_OUT = "vector array<double>, used int, halvings int, status string, calls int"


class Overflow(Exception):
    """A text is longer than the model's context."""


def plan(lengths: list[int], rows: int = ROWS, budget: int = BUDGET) -> list[list[int]]:
    """Places of the texts of each call: by falling length, so that the first text of a call sets its padded size."""
    calls: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        last = calls[-1] if calls else []
        if last and len(last) < rows and (len(last) + 1) * lengths[last[0]] <= budget:
            last.append(i)
        else:
            calls.append([i])
    return calls


class Sender:
    """Sends batches to a model and counts the calls."""

    def __init__(self, model: Model):
        self.model, self.calls = model, 0

    def _call(self, texts: list[str]) -> list:
        self.calls += 1
        out = list(self.model(texts))
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
        return out

    def send(self, texts: list[str]) -> list[tuple[list[float] | None, int, int, str]]:
        """(vector, characters used, halvings, status) in the order of ``texts``."""
        try:
            return [(v, len(t), 0, "ok" if v is not None else "failed") for v, t in zip(self._call(texts), texts, strict=True)]
        except Exception as failure:  # a model may fail in any way; what fails alone is told by its status
            if len(texts) == 1:
                return [self._alone(texts[0], isinstance(failure, Overflow))]
        middle = len(texts) // 2
        return self.send(texts[:middle]) + self.send(texts[middle:])

    def _alone(self, text: str, over: bool) -> tuple[list[float] | None, int, int, str]:
        halvings = 0
        for _ in range(HALVINGS if over else 1):
            if over:
                text, halvings = text[: len(text) // 2], halvings + 1
            try:
                vector = self._call([text])[0]
                return vector, len(text), halvings, "ok" if vector is not None else "failed"
            except Overflow:
                if not over:
                    break
            except Exception:
                if over:
                    break
        return None, 0, halvings, "overflow" if over else "failed"


def _embed(model: Model, rows: int, budget: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sender, told = Sender(model), {}
            texts = b.column(b.num_columns - 1).to_pylist()
            distinct = list(dict.fromkeys(t for t in texts if t and not t.isspace()))
            for call in plan([len(t) for t in distinct], rows, budget):
                told |= zip([distinct[i] for i in call], sender.send([distinct[i] for i in call]), strict=True)
            out = [told.get(t, (None, 0, 0, "blank")) for t in texts]
            vectors, used, halvings, status = zip(*out, strict=True) if out else ((),) * 4
            counted = [sender.calls] + [0] * (len(texts) - 1) if texts else []
            yield pa.record_batch(
                [*b.columns[:-1], pa.array(vectors, pa.list_(pa.float64())), pa.array(used, pa.int32()), pa.array(halvings, pa.int32()), pa.array(status, pa.string()), pa.array(counted, pa.int32())],
                [*b.schema.names[:-1], "vector", "used", "halvings", "status", "calls"],
            )

    return work


def embed(df: DataFrame, id_: str, text: str, model: Model, rows: int = ROWS, budget: int = BUDGET) -> DataFrame:
    """(id, vector, used, halvings, status, calls) of each row; ``calls`` sums to the calls made. ``model`` runs in the tasks."""
    kind = dict(df.dtypes)[id_]
    return df.select(F.col(id_).alias("id"), F.col(text).alias("text")).mapInArrow(_embed(model, rows, budget), f"id {kind}, {_OUT}")


def stand_in(dim: int, context: int) -> Model:
    """A model for tests and machines without one: coordinates from the text's SHA-256, an overflow beyond ``context`` characters."""

    def model(texts: list[str]) -> list[list[float]]:
        if any(len(t) > context for t in texts):
            raise Overflow
        digests = [hashlib.sha256(t.encode()).digest() for t in texts]
        return [[int.from_bytes(d[i % 16 * 2 : i % 16 * 2 + 2], "big") / 65535.0 * 2 - 1 for i in range(dim)] for d in digests]

    return model
