"""Engine settings as an immutable value that is passed, and the timers of a run."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace
from typing import Any

PROVIDER_NAMES = ("rule", "scripted", "http")


@dataclass(frozen=True)
class Config:
    """Settings of a run; change them with :meth:`with_`."""

    language: str = "en"
    provider: str = "rule"
    provider_options: dict[str, Any] = field(default_factory=dict)
    max_iterations: int = 10
    batch_size: int = 5
    cache_size: int = 100
    coref_threshold: float = 0.7
    least_confidence: float = 0.7
    longest_cycle: int = 4
    output: str = "output"

    @classmethod
    def from_env(cls, prefix: str = "GRAPHWRIGHT_") -> Config:
        """Defaults overridden by environment variables such as ``GRAPHWRIGHT_LANGUAGE``."""
        found = {}
        for name, kind in cls.__annotations__.items():
            value = os.environ.get(prefix + name.upper())
            if value is not None and kind in ("str", "int", "float"):
                found[name] = {"str": str, "int": int, "float": float}[kind](value)
        return cls(**found)

    def with_(self, **changes: Any) -> Config:
        return replace(self, **changes)

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def problems(self) -> list[str]:
        """What is wrong with the settings; empty if nothing is."""
        out = [] if self.provider in PROVIDER_NAMES else [f"unknown provider {self.provider!r}"]
        out += [f"{n} must be in [0, 1]" for n in ("coref_threshold", "least_confidence") if not 0 <= getattr(self, n) <= 1]
        if self.provider == "http" and "url" not in self.provider_options:
            out.append("the http provider needs an url")
        return out


class Timer:
    """Named durations of a run in seconds."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def measure(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def timed(self, function: Callable) -> Callable:
        """Decorator that measures calls under the function's name."""

        def run(*args: Any, **kwargs: Any) -> Any:
            with self.measure(function.__name__):
                return function(*args, **kwargs)

        return run
