"""Graders behind one interface: a grader answers a prompt, and failures become rows.

`LengthScorer` is the offline default; `Failover` tries several graders in turn, as one would
with remote services. A grader is used within a task, a batch of rows at a time.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.rubric import Dimension


class Scorer(Protocol):
    def score(self, text: str) -> float:
        """A total between 0 and 100; raises if it cannot tell."""


class LengthScorer:
    """Deterministic and offline: longer texts get more."""

    def score(self, text: str) -> float:
        if not text:
            raise ValueError("nothing to grade")
        return float(min(100, 40 + len(text) // 100))


class ChatScorer:
    """A grader behind an HTTP service that answers a list of messages; any failure raises, so that `Failover` asks the next."""

    def __init__(self, url: str, key: str, model: str, system: str = "", timeout: float = 180.0, dimensions: tuple[Dimension, ...] = ()):
        self.url, self.key, self.model, self.system, self.timeout, self.dimensions = url, key, model, system, timeout, dimensions

    # The service's own defaults.
    def chat(self, messages: list[dict], temperature: float = 0.3, max_tokens: int = 4096) -> str:
        body = json.dumps({"model": self.model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.loads(answer.read())["choices"][0]["message"]["content"]

    def answer(self, prompt: str) -> str:
        """What the service says to a prompt, as `sources.answers` logs it."""
        return self.chat([{"role": "system", "content": self.system}, {"role": "user", "content": prompt}])

    def score(self, text: str) -> float:
        answer = self.answer(text)
        inside = re.search(r"\{.*\}", answer, re.DOTALL)
        found = json.loads(inside[0] if inside else answer)
        scores = found.get("dimension_scores", {})
        total = sum(round(min(100, max(0, float(scores.get(d.name, 0))))) * d.weight for d in self.dimensions) if self.dimensions else float(found["total_score"])
        return float(min(100, max(0, round(total))))

    def judge(self, a: str, b: str) -> str:
        """A short verdict on two texts."""
        return self.chat([{"role": "system", "content": self.system}, {"role": "user", "content": f"论文A：\n{a}\n\n论文B：\n{b}"}], 0.1, 128)


class Failover:
    """Each grader in turn, `rounds` times round; the one that answered last is asked first."""

    def __init__(self, *scorers: Scorer, rounds: int = 3):
        self.scorers, self.rounds, self.at = scorers, rounds, 0

    def score(self, text: str) -> float:
        return self._first("score", text)

    def answer(self, prompt: str) -> str:
        return self._first("answer", prompt)

    def _first(self, what: str, text: str):
        error: Exception | None = None
        for _ in range(self.rounds * len(self.scorers)):
            try:
                return getattr(self.scorers[self.at], what)(text)
            except Exception as e:  # noqa: BLE001  whatever a service does, the next is asked
                error = e
                self.at = (self.at + 1) % len(self.scorers)
        raise RuntimeError("no grader answered") from error


def evaluate(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, success, total) of each document; one that cannot be graded has success false."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, t in zip(f[key], f["_t"], strict=True):
                try:
                    out.append((k, True, scorer.score(t)))
                except Exception:  # noqa: BLE001
                    out.append((k, False, 0.0))
            yield pd.DataFrame(out, columns=[key, "success", "total"])

    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).mapInPandas(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, success boolean, total double")
