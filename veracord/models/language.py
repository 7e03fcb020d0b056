"""Language models behind prompts.

A model answers a batch of requests; a request has the prompt's text and the values
of its fields. Models are plain picklable objects that travel with the query. The
offline models answer by rule, so that queries over prompts have exact oracles.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import urllib.request
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum


@dataclass(frozen=True)
class Request:
    prompt: str
    fields: tuple[tuple[str, str | None], ...]
    descriptions: tuple[tuple[str, str], ...] = ()

    def text(self, dtype: object = bool) -> str:
        """What a hosted model would be sent: the task, then each field in a block of its own."""
        said = dict(self.descriptions)
        blocks = "\n".join(f'<{k} description="{said[k]}">{v}</{k}>' if k in said else f"<{k}>{v}</{k}>" for k, v in self.fields)
        lead = "Answer true or false. " if dtype is bool else ""
        return f"{lead}{self.prompt}\n{blocks}"

    def value(self, name: str) -> str | None:
        return dict(self.fields).get(name)


class LanguageModel:
    """Answers requests with values of ``dtype``, in order."""

    name = "model"

    def answer(self, requests: list[Request], dtype: object = bool) -> list:
        raise NotImplementedError

    def answer_fused(self, requests: list[Request], prompts: list[tuple[str, object]]) -> list[tuple]:
        """Answers to several prompts about the same fields; one call a row for models that can."""
        columns = [self.answer([Request(p, r.fields, r.descriptions) for r in requests], d) for p, d in prompts]
        return list(zip(*columns, strict=True)) if requests else []


@dataclass
class RuleModel(LanguageModel):
    """Answers by the rule registered for a prompt's text.

    Rules: ``("contains", field, keywords)`` true if the lower-cased field contains one;
    ``("class", field, {value: keyword}, default)`` the first value whose keyword it contains;
    ``("extract", field, pattern)`` the first group of a pattern; ``("equals", field, text)``.
    """

    rules: dict[str, tuple]
    name: str = "rules"

    def answer(self, requests: list[Request], dtype: object = bool) -> list:
        return [coerce(self._one(self.rules[r.prompt], r), dtype) for r in requests]

    @staticmethod
    def _one(rule: tuple, r: Request) -> object:
        kind, name, what, *rest = rule
        value = r.value(name)
        low = (value or "").lower()
        if kind == "contains":
            return any(k in low for k in what)
        if kind == "class":
            return next((v for v, k in what.items() if k in low), rest[0])
        if kind == "extract":
            m = re.search(what, value or "")
            return m.group(1) if m else ""
        return (value or "") == what


@dataclass
class LookupModel(LanguageModel):
    """Answers from a table: prompt -> value of one field -> answer."""

    answers: dict[str, dict[str, object]]
    field: str
    default: object = False
    name: str = "lookup"

    def answer(self, requests: list[Request], dtype: object = bool) -> list:
        return [coerce(self.answers[r.prompt].get(r.value(self.field), self.default), dtype) for r in requests]


@dataclass
class NoisyModel(LanguageModel):
    """Another model whose boolean answers are flipped for a fixed share of requests."""

    base: LanguageModel
    flip_rate: float
    seed: int = 0
    name: str = "noisy"

    def answer(self, requests: list[Request], dtype: object = bool) -> list:
        out = self.base.answer(requests, dtype)
        if dtype is not bool:
            return out
        return [(not a) if flips(f"{self.seed}|{r.prompt}|{dict(r.fields)}", self.flip_rate) else a for a, r in zip(out, requests, strict=True)]


@dataclass
class Ensemble(LanguageModel):
    """Majority vote; on a tie, the answer among the leaders that the earliest model gave."""

    models: tuple[LanguageModel, ...]
    name: str = "ensemble"

    def answer(self, requests: list[Request], dtype: object = bool) -> list:
        votes = zip(*(m.answer(requests, dtype) for m in self.models), strict=True)
        return [Counter(v).most_common(1)[0][0] for v in votes]


@dataclass
class HostedModel(LanguageModel):
    """A model behind an HTTP endpoint.

    Sends ``{"model", "max_output_tokens", "format", "prompts": [{"index", "text"}]}`` and
    expects ``{"answers": [{"index", "value"}], "usage": {...}}``, in any order. The key is
    read on the worker from the environment variable ``key_variable``, so it is not part of
    a plan. Answers that do not fit the type are errors; wrap it in ``Retrying``.
    """

    url: str
    model: str
    key_variable: str | None = None
    batch: int = 64
    timeout: float = 60.0
    max_output_tokens: int = 8192
    usage: dict = field(default_factory=dict, compare=False)

    @property
    def name(self) -> str:
        return self.model

    def answer(self, requests: list[Request], dtype: object = bool) -> list:
        out = []
        for i in range(0, len(requests), self.batch):
            out += self._call([r.text(dtype) for r in requests[i : i + self.batch]], dtype)
        return out

    def _call(self, texts: list[str], dtype: object) -> list:
        body = {"model": self.model, "max_output_tokens": self.max_output_tokens, "format": answer_format(dtype), "prompts": [{"index": i, "text": t} for i, t in enumerate(texts)]}
        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        sent = urllib.request.Request(self.url, json.dumps(body).encode(), headers)
        with urllib.request.urlopen(sent, timeout=self.timeout) as got:
            said = json.load(got)
        for k, v in said.get("usage", {}).items():
            self.usage[k] = self.usage.get(k, 0) + v
        by = {a["index"]: a["value"] for a in said["answers"]}
        if set(by) != set(range(len(texts))):
            raise ValueError("the model has not answered every prompt once")
        return [coerce(by[i], dtype) for i in range(len(texts))]


def answer_format(dtype: object) -> dict:
    """JSON schema of one answer."""
    if isinstance(dtype, type) and issubclass(dtype, Enum):
        return {"type": "string", "enum": [m.value for m in dtype]}
    return {"type": {bool: "boolean", int: "integer", float: "number"}.get(dtype, "string")}


@dataclass
class Retrying(LanguageModel):
    """Tries again when the model fails."""

    base: LanguageModel
    attempts: int = 10
    name: str = "retrying"

    def answer(self, requests: list[Request], dtype: object = bool) -> list:
        for left in reversed(range(self.attempts)):
            try:
                return self.base.answer(requests, dtype)
            except (KeyError, OSError, TypeError, ValueError):
                if not left:
                    raise
        return []


def flips(text: str, rate: float) -> bool:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32 < rate


def coerce(value: object, dtype: object) -> object:
    """A model's answer as a value of the declared type; Enum answers must be one of its values."""
    if isinstance(dtype, type) and issubclass(dtype, Enum):
        return dtype(value.value if isinstance(value, Enum) else value).value
    if dtype is bool:
        return value.strip().lower() == "true" if isinstance(value, str) else bool(value)
    return dtype(value) if dtype in (str, int, float) else value


@dataclass
class Metrics:
    """Counts of one run: answered requests, those found in the cache, and prompt characters."""

    requests: int = 0
    cache_hits: int = 0
    characters: int = 0
    waves: int = 0
    rows_seen: int = 0
    extra: dict = field(default_factory=dict)


#: Turns a prompt into (query text, keywords that speak for it, keywords that speak against it).
QueryPlanner = Callable[[str], tuple[str, list[str], list[str]]]
STOP = frozenset("a an and any are as at be by for from has have identify if in is it its mentions of on or review that the this to was were whether which with".split())


def keyword_planner(prompt: str) -> tuple[str, list[str], list[str]]:
    """Content words of the prompt as query and as keywords."""
    words = [w for w in re.findall(r"[a-z0-9]+", re.sub(r"\{\w+\}", " ", prompt.lower())) if w not in STOP]
    return " ".join(words), list(dict.fromkeys(words)), []
