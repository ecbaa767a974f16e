"""Where models plug in: anything with one of these methods, called for batches of rows inside Spark tasks.

The offline providers answer by rule, always the same for the same input, so that Spark may repeat a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.conversations import lead_sample
from parley.sources.store import stage


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ProviderError(Exception):
    """What a model raises if it gives no answer; other errors are mistakes of a program and end the task."""


class Answerer(Protocol):
    def complete(self, task: str, items: list[tuple[object, str]]) -> list[dict]:
        """Answers to (id, text) pairs, each with its ``id``."""


@lru_cache(maxsize=100_000)
def _hashed(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")


class HashedEmbedder:
    """Unit vectors of signed word counts in ``width`` places."""

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.width
            for word in re.findall(r"\w+", text.lower()):
                h = _hashed(word)
                v[h % self.width] += 1.0 if h >> 63 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


class RuleAnswerer:
    """Facets, names and ratings by rule."""

    def one(self, task: str, text: str) -> dict:
        words = text.split()
        if task == "facets":
            return {"summary": text.strip()[:200] or "empty", "task": (words or ["none"])[0].lower()[:40], "language": "unknown", "language_confidence": 0.8, "concerning_score": 1}
        if task == "label":
            return {"name": " ".join(words[:4])[:120] or "Unnamed", "description": text.strip()[:500] or "Nothing to describe."}
        return {"rating": 1 if re.search(r"[\w.+-]+@[\w-]+\.[\w.]+|\+?\d[\d ().-]{7,}\d", text) else 5, "justification": "contact data" if "@" in text else "rule"}

    def complete(self, task: str, items: list[tuple[object, str]]) -> list[dict]:
        return [{"id": k} | self.one(task, text) for k, text in items]


def embedded(df: DataFrame, key: str, text: str, provider: Embedder | None = None, batch: int = 32) -> DataFrame:
    """(key, v): vectors by key, never by position. A batch of the wrong number or width fails the task. Vectors are written to the
    shared folder once, so fits and actions on them do not ask the model again."""
    provider = provider or HashedEmbedder()
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = provider.embed(part["t"].tolist())
                if len(vectors) != len(part) or len({len(v) for v in vectors}) > 1:
                    raise ValueError("the provider gave vectors of another number or width")
                yield pd.DataFrame({key: part[key], "v": vectors})

    return stage(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).mapInPandas(run, f"{key} {kind}, v array<double>"), "vectors")


def embedded_or_error(df: DataFrame, key: str, text: str, provider: Embedder, batch: int = 32) -> DataFrame:
    """(key, v, error) written down: vectors by key, or what the provider raised for a batch; after that a task asks for no more."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        error = None
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors: list = [None] * len(part)
                if error is None:
                    try:
                        vectors = provider.embed(part["t"].tolist())
                    except ProviderError as failed:
                        error = str(failed)[:500]
                    if error is None and (len(vectors) != len(part) or len({len(v) for v in vectors}) > 1):
                        raise ValueError("the provider gave vectors of another number or width")
                yield pd.DataFrame({key: part[key], "v": vectors if error is None else [None] * len(part), "error": error})

    return stage(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).mapInPandas(run, f"{key} {kind}, v array<double>, error string"), "vectors")


def embedded_rest(df: DataFrame, key: str, text: str, saved: DataFrame, provider: Embedder | None = None, batch: int = 32) -> DataFrame:
    """(key, mark, v): vectors of ``saved`` (the same columns) where the text has not changed since (mark is its hash), the rest from the model."""
    mark = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    wanted = df.select(key, F.col(text).alias("parley_text"), mark.alias("mark"))
    rest = wanted.join(saved.select(key, "mark"), [key, "mark"], "left_anti")
    new = embedded(rest, key, "parley_text", provider, batch).join(rest.select(key, "mark"), key)
    return saved.join(wanted.select(key, "mark"), [key, "mark"], "left_semi").select(key, "mark", "v").unionByName(new.select(key, "mark", "v"))


def reconciled(ids: list, answers: list[dict]) -> tuple[dict, dict]:
    """(answer by id, error by id) of a batch: the first answer to a known id counts; ids answered twice, unknown or left out are errors."""
    wanted, found, errors = set(ids), {}, {}
    for answer in answers:
        k = answer.get("id")
        if k in found:
            errors[k] = "DuplicateConversationIdInBatchOutput"
        elif k not in wanted:
            errors[k] = "UnexpectedConversationIdInBatchOutput"
        else:
            found[k] = {name: v for name, v in answer.items() if name != "id"}
    for k in ids:
        if k not in found:
            errors[k] = "MissingConversationInBatchOutput"
    return found, errors


def answered(df: DataFrame, key: str, text: str, task: str, fields: str, fallback: dict, provider: Answerer | None = None, batch: int = 8) -> DataFrame:
    """(key, fields, fallback_used, error): the provider's answers by id, of unique keys. What a batch leaves out, or all of it if the
    batch fails, is asked again one by one; what fails then gets ``fallback``, in whose texts ``{id}`` stands for the key.

    fallback_used is true for all that the batch did not answer; error is what the batch, or else the single request, gave. Answers
    are written to the shared folder once, so actions on them do not ask the model again.
    """
    provider = provider or RuleAnswerer()
    kind = df.schema[key].dataType.simpleString()

    def alone(k: object, t: str, error: str) -> dict:
        try:
            found, errors = reconciled([k], provider.complete(task, [(k, t)]))
            if k in found:
                return found[k] | {"fallback_used": True, "error": error}
            error = errors[k]
        except ProviderError as failed:
            error = str(failed)[:500]
        return {n: v.replace("{id}", str(k)) if isinstance(v, str) else v for n, v in fallback.items()} | {"fallback_used": True, "error": error}

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                items = [*zip(part[key].tolist(), part["t"].tolist(), strict=True)]
                try:
                    found, errors = reconciled([k for k, _ in items], provider.complete(task, items))
                except ProviderError as failed:
                    found, errors = {}, dict.fromkeys((k for k, _ in items), str(failed)[:500])
                rows = [{key: k} | (found[k] | {"fallback_used": False, "error": errors.get(k)} if k in found else alone(k, t, errors[k])) for k, t in items]
                yield pd.DataFrame(rows)

    return stage(df.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).mapInPandas(run, f"{key} {kind}, {fields}, fallback_used boolean, error string"), "answers")


#: Fields of an answer, by task, and what stands for one that failed; a rating that failed is the lowest.
FACETS = "summary string, task string, language string, language_confidence double, concerning_score int"
LABEL, NO_LABEL = "name string, description string", {"name": "Cluster {id}", "description": "Label generation failed."}
AUDIT, NO_AUDIT = "rating int, justification string", {"rating": 1, "justification": "Audit failed; conservative rating."}


def cluster_labels(facets: DataFrame, order: str, provider: Answerer | None = None, sample: int = 12, ask: Callable[..., DataFrame] = answered) -> DataFrame:
    """(cluster_id, name, description, fallback_used, error) from the first ``sample`` summaries of each cluster of facets
    (cluster_id, summary, order); a cluster without an answer is called ``Cluster <id>``. ``ask`` is ``answered``, or a phase that resumes."""
    first = lead_sample(facets.select("cluster_id", F.col(order).alias("ord"), "summary"), "cluster_id", "ord", sample)
    told = first.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "summary"))), lambda x: x["summary"]), "\n").alias("t"))
    return ask(told, "cluster_id", "t", "label", LABEL, NO_LABEL, provider=provider)


def audited(texts: DataFrame, provider: Answerer | None = None, batch: int = 12, ask: Callable[..., DataFrame] = answered) -> DataFrame:
    """(stage, id, rating, justification, fallback_used, error) of texts (stage, id, content); an audit that fails rates 1. ``ask`` is
    ``answered``, or a phase that resumes."""
    keyed = texts.select(F.concat_ws(":", "stage", "id").alias("k"), "content")
    found = ask(keyed, "k", "content", "audit", AUDIT, NO_AUDIT, provider=provider, batch=batch)
    return found.select(F.substring_index("k", ":", 1).alias("stage"), F.expr("substring(k, instr(k, ':') + 1)").alias("id"), "rating", "justification", "fallback_used", "error")


def next_width(width: int, issues: int, most: int, left: bool = True) -> int:
    """How many requests the next wave sends at once: one less after any issue, one more after a clean wave while work is left."""
    return max(1, min(most, width - 1 if issues else width + (1 if left else 0)))


def waves(issues: list[int], start: int, most: int) -> list[int]:
    """The widths of waves with these numbers of issues, the last one included."""
    widths = [start]
    for i, n in enumerate(issues):
        widths.append(next_width(widths[-1], n, most, i < len(issues) - 1))
    return widths[:-1]
