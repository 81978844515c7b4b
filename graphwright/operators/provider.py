"""Model providers: one protocol, an offline rule provider, a scripted one for tests, an optional HTTP one."""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol


class Provider(Protocol):
    """What a step asks of a model; instances are created once per partition."""

    name: str

    def generate_text(self, prompt: str, system: str | None = None) -> str: ...

    def generate_json(self, prompt: str, schema: dict[str, Any], system: str | None = None) -> dict[str, Any]: ...

    def count_tokens(self, text: str) -> int: ...


def approximate_tokens(text: str) -> int:
    """Four characters a token, at least one for any text."""
    return max(1, len(text.strip()) // 4) if text else 0


_WORD = re.compile(r"[^\W\d_][\w'-]*")
_LINE = re.compile(r"^- \[(.*?)\] (.*?) --(.*?)--> (.*)$", re.M)
_NAME = re.compile(r"(?:[A-ZА-ЯÀ-Þ][\w'-]+)(?: [A-ZА-ЯÀ-Þ][\w'-]+)*")


@dataclass
class RuleProvider:
    """Offline and deterministic: same record shapes as a model's answers.

    Entities are capitalised words, at the start of a sentence only long ones; two entities of one sentence are
    related; a summary is the first sentence with the most frequent long words.
    """

    name: str = "rule"

    def generate_text(self, prompt: str, system: str | None = None) -> str:
        return prompt.strip().split("\n")[0]

    def generate_json(self, prompt: str, schema: dict[str, Any], system: str | None = None) -> dict[str, Any]:
        task = schema.get("task")
        answers = {
            "entities": self._entities, "relationships": self._relationships, "summary": self._summary, "segments": self._segments, "verify": self._verify, "coreference": self._coreference,
        }
        return answers[task](prompt, schema)

    def count_tokens(self, text: str) -> int:
        return approximate_tokens(text)

    @staticmethod
    def _sentences(text: str) -> list[str]:
        return [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]

    def _entities(self, text: str, schema: dict[str, Any]) -> dict[str, Any]:
        found: dict[str, dict[str, Any]] = {}
        for sentence in self._sentences(text):
            for m in _NAME.finditer(sentence):
                if (m.start() or len(m[0]) > 5) and m[0].lower() not in found:
                    found[m[0].lower()] = {"name": m[0], "type": "Concept", "context": sentence, "confidence": 0.8, "attributes": {}}
        return {"entities": list(found.values())}

    def _relationships(self, text: str, schema: dict[str, Any]) -> dict[str, Any]:
        names, out = schema.get("entities", []), []
        for sentence in self._sentences(text):
            here = sorted((sentence.find(n), n) for n in names if n in sentence)
            out += [{"source": a, "target": b, "type": "related_to", "context": sentence, "confidence": 0.6} for (_, a), (_, b) in zip(here, here[1:], strict=False)]
        return {"relationships": out}

    def _segments(self, text: str, schema: dict[str, Any]) -> dict[str, Any]:
        out, at = [], 0
        for part in re.split(r"(\n\s*\n)", text):
            body = part.strip()
            if body:
                start = at + len(part) - len(part.lstrip())
                kids = [{"type": "sentence", "text": s} for s in self._sentences(body)] if len(body) > 200 else []
                out.append({"type": "paragraph", "text": body, "position": {"start": start, "end": start + len(body)}, "segments": kids})
            at += len(part)
        return {"segments": out}

    def _verify(self, text: str, schema: dict[str, Any]) -> dict[str, Any]:
        """Relationships of an entity with itself, and both ``x`` and ``not x`` between two entities, among the prompt's lines."""
        issues, kinds = [], {}
        for id_, source, kind, target in _LINE.findall(text):
            if source == target:
                issues.append({"issue_type": "self_reference", "involved_elements": [id_], "proposed_solution": f"Remove the relationship of {source} with itself", "severity": "low"})
            other = kinds.get((source, target, kind.replace("-not-", "-") if "-not-" in kind else kind.replace("-", "-not-", 1)))
            if other:
                issues.append({"issue_type": "contradictory_relationships", "involved_elements": [other, id_], "proposed_solution": f"Decide whether {source} {kind} {target}", "severity": "medium"})
            kinds[source, target, kind] = id_
        return {"issues": issues}

    def _coreference(self, text: str, schema: dict[str, Any]) -> dict[str, Any]:
        """Merge under the longest name if all words of every name occur in it."""
        names = sorted(schema.get("names", []), key=lambda n: (-len(n), n))
        words = [set(_WORD.findall(n.lower())) for n in names]
        return {"merge": all(w <= words[0] for w in words), "canonical_name": names[0] if names else None, "confidence": 0.9, "reason": "names within one another"}

    def _summary(self, text: str, schema: dict[str, Any]) -> dict[str, Any]:
        sentences, counts = self._sentences(text), {}
        for word in _WORD.findall(text.lower()):
            if len(word) > 4:
                counts[word] = counts.get(word, 0) + 1
        keywords = sorted(counts, key=lambda w: (-counts[w], w))[:5]
        return {"summary": sentences[0] if sentences else "", "key_points": sentences[:3], "role": "content", "keywords": keywords}


@dataclass
class ScriptedProvider:
    """Answers from a function, for tests."""

    answer: Callable[[str, dict[str, Any]], dict[str, Any]]
    name: str = "scripted"

    def generate_text(self, prompt: str, system: str | None = None) -> str:
        return json.dumps(self.answer(prompt, {}))

    def generate_json(self, prompt: str, schema: dict[str, Any], system: str | None = None) -> dict[str, Any]:
        return self.answer(prompt, schema)

    def count_tokens(self, text: str) -> int:
        return approximate_tokens(text)


@dataclass
class HttpProvider:
    """A JSON-over-HTTP endpoint ``{"prompt", "system"} -> {"text"}``; off unless an url is given. Retries with growing pauses."""

    url: str
    headers: dict[str, str] = field(default_factory=dict)
    attempts: int = 3
    first_pause: float = 2.0
    name: str = "http"

    def generate_text(self, prompt: str, system: str | None = None) -> str:
        body = json.dumps({"prompt": prompt, "system": system}).encode()
        request = urllib.request.Request(self.url, body, {"content-type": "application/json", **self.headers})
        for attempt in range(self.attempts):
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:
                    return json.load(answer)["text"]
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(min(10.0, self.first_pause * 2**attempt))
        raise RuntimeError("no attempt was made")

    def generate_json(self, prompt: str, schema: dict[str, Any], system: str | None = None) -> dict[str, Any]:
        asked = f"{system or ''}\nAnswer with JSON of this shape: {json.dumps(schema)}"
        text = self.generate_text(prompt, asked)
        return json.loads(text[text.find("{") : text.rfind("}") + 1])

    def count_tokens(self, text: str) -> int:
        return approximate_tokens(text)


PROVIDERS: dict[str, Callable[..., Provider]] = {"rule": RuleProvider, "scripted": ScriptedProvider, "http": HttpProvider}


def get_provider(name: str = "rule", **options: Any) -> Provider:
    """A provider by name; unknown names are an error."""
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider {name!r}; known: {sorted(PROVIDERS)}")
    return PROVIDERS[name](**options)
