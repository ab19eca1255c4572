"""What an outside program or service does, behind small protocols, with deterministic stand-ins.

Calls run inside Arrow batches on executors. Each carries a retry and its result is a row, so
a result table keyed by (sha256, page_index, engine) makes repeated runs free of new calls.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .errors import ConfigError, MergeError
from .formats.pages import BLOCKS


class Recognizer(Protocol):
    """Reads one page image: (text, confidence) or (text, confidence, blocks), see ``answers``."""

    engine_name: str

    def recognize(self, image: bytes, page_index: int, languages: list[str]) -> tuple: ...

    def health_check(self) -> bool: ...


class Merger(Protocol):
    """Merges transcriptions of one page: (text, raw answer, model, cost)."""

    def merge(self, image: bytes | None, message: str, system_prompt: str, model: str) -> tuple[str, str, str, float]: ...


class Resolver(Protocol):
    """The JSON answer of a registry for an identifier, '' if there is none."""

    def resolve(self, identifier: str) -> str: ...


def with_retry(call: Callable, attempts: int = 3, wait: float = 0.5, longest: float = 60.0, retry_on: tuple = (OSError, TimeoutError, ConnectionError), sleep: Callable = time.sleep) -> tuple[object, int]:
    """The result and the number of repetitions; waits double up to ``longest``; other errors pass at once."""
    for k in range(attempts):
        try:
            return call(), k
        except retry_on:
            if k + 1 == attempts:
                raise
            sleep(min(wait * 2**k, longest))
    raise ConfigError("attempts must be 1 or more")


@dataclass(frozen=True)
class StubRecognizer:
    """Says what ``say`` makes of the page number; fails on pages in ``fails_on``."""

    engine_name: str
    say: str = "page {index}"
    fails_on: tuple = ()
    confidence: float | None = None

    def recognize(self, image: bytes, page_index: int, languages: list[str]) -> tuple[str, float | None]:
        if page_index in self.fails_on:
            raise RuntimeError(f"{self.engine_name} cannot read page {page_index}")
        return self.say.format(index=page_index, size=len(image or b"")), self.confidence

    def health_check(self) -> bool:
        return True


@dataclass(frozen=True)
class StubMerger:
    """A fixed answer, or the first section of the message."""

    text: str = ""
    cost: float = 0.0
    fails: bool = False

    def merge(self, image: bytes | None, message: str, system_prompt: str, model: str) -> tuple[str, str, str, float]:
        if self.fails:
            raise MergeError("no answer")
        return self.text or message.rsplit(" ---\n", 1)[-1], '{"stub": true}', model or "stub", self.cost


@dataclass(frozen=True)
class StubResolver:
    answers: tuple = ()

    def resolve(self, identifier: str) -> str:
        return dict(self.answers).get(identifier, "")


def recognizers(names: list[str], factories: dict[str, Callable[[], Recognizer]]) -> list[Recognizer]:
    """The engines by name; unknown names are an error, unhealthy ones are left out."""
    unknown = [n for n in names if n not in factories]
    if unknown:
        raise ConfigError(f"unknown engines: {', '.join(unknown)}; known: {', '.join(sorted(factories))}")
    return [e for n in names if (e := factories[n]()).health_check()]


def recognize(pages: DataFrame, engines: list[Recognizer], key: list[str], languages: list[str] = ("en",), image: str = "image") -> DataFrame:
    """One row for each (page, engine): text, error, confidence, retries, duration, blocks. Errors are values, not failures.

    Pages are dealt over all cores before the calls."""
    schema = ", ".join(f"{n} {t}" for n, t in pages.select(*key).dtypes) + f", engine string, ord int, text string, error string, confidence double, retries int, duration_sec double, blocks {BLOCKS}"
    shape = to_arrow_type(StructType.fromDDL(f"b {BLOCKS}")["b"].dataType)

    def run(batches):
        for b in batches:
            keys = list(zip(*(b[k].to_pylist() for k in key), strict=True))
            images = b[image].to_pylist()
            index = b["page_index"].to_pylist()
            rows = []
            for k, img, i in zip(keys, images, index, strict=True):
                for n, e in enumerate(engines):
                    began, text, error, conf, again, blocks = time.perf_counter(), "", None, None, 0, ()
                    try:
                        (text, conf, *blocks), again = with_retry(lambda e=e, img=img, i=i: e.recognize(img, i, list(languages)))
                    except Exception as x:
                        error = f"{type(x).__name__}: {x}"
                    rows.append((*k, e.engine_name, n, text, error, conf, again, time.perf_counter() - began, next(iter(blocks), None)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * (len(key) + 8)
            kinds = [b.schema.field(k).type for k in key] + [pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.float64(), shape]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[*key, "engine", "ord", "text", "error", "confidence", "retries", "duration_sec", "blocks"])

    cols = list(dict.fromkeys([*key, "page_index", image]))
    dealt = pages.select(*cols).repartition(pages.sparkSession.sparkContext.defaultParallelism * 2)
    return dealt.mapInArrow(run, schema)


def merge(pages: DataFrame, merger: Merger, key: list[str], system_prompt: str, fallback_model: str = "", low_quality: Callable[[str, str], bool] | None = None) -> DataFrame:
    """Adds merged_text, raw_answer, model_used, merge_cost and merge_error to pages (message, model, marker_text).

    Only rows whose strategy asks for a model belong here: filter first, as Python functions run
    for every row. An answer of low quality is tried again with the fallback model; the cost
    of both calls counts."""
    extra = "merged_text string, raw_answer string, model_used string, merge_cost double, merge_error string"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema) + ", " + extra

    def run(batches):
        for b in batches:
            rows = []
            for message, model, marker in zip(b["message"].to_pylist(), b["model"].to_pylist(), b["marker_text"].to_pylist(), strict=True):
                text, raw, used, cost, error = None, None, None, 0.0, None
                try:
                    text, raw, used, cost = merger.merge(None, message, system_prompt, model)
                    if fallback_model and low_quality and low_quality(text, marker or ""):
                        try:
                            t2, r2, u2, c2 = merger.merge(None, message, system_prompt, fallback_model)
                            text, raw, used, cost = t2, r2, u2, cost + c2
                        except MergeError:
                            pass  # the first answer stands
                except MergeError as x:
                    error = str(x)
                rows.append((text, raw, used, cost, error))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*b.schema.names, "merged_text", "raw_answer", "model_used", "merge_cost", "merge_error"])

    return pages.mapInArrow(run, schema)


def poor_answer(text: str, marker: str) -> bool:
    """The quality test of ``reconcile.low_quality`` for a single answer."""
    plain = text.strip()
    return text.count("[illegible]") > 3 or not plain or sum(map(str.isspace, text)) > 0.8 * len(text) or (bool(marker.strip()) and len(plain) < 0.5 * len(marker.strip()))


def resolve(ids: DataFrame, column: str, resolver: Resolver) -> DataFrame:
    """(column, body) for each distinct non-empty identifier: one call each."""

    def run(batches):
        for b in batches:
            found = b[column].to_pylist()
            bodies = [with_retry(lambda i=i: resolver.resolve(i))[0] for i in found]
            yield pa.RecordBatch.from_arrays([b[column], pa.array(bodies, pa.string())], names=[column, "body"])

    return ids.select(column).filter(F.coalesce(F.col(column), F.lit("")) != "").distinct().mapInArrow(run, f"{column} string, body string")
