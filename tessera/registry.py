"""Registries of DataFrame functions by case-insensitive name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Generic, TypeVar

T = TypeVar("T", bound=Callable)


class Registry(Generic[T]):
    def __init__(self, kind: str, default: str | None = None):
        self.kind, self.default = kind, default
        self.known: dict[str, T] = {}

    def register(self, name: str) -> Callable[[T], T]:
        def put(function: T) -> T:
            if name.lower() in self.known:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self.known[name.lower()] = function
            return function

        return put

    def get(self, name: str | None = None) -> T:
        key = (name or self.default or "").lower()
        if key not in self.known:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self.known))}")
        return self.known[key]


#: Evaluators by task; classification is the default.
TASKS: Registry = Registry("task", "classification")
#: Server rules by name.
SERVERS: Registry = Registry("server rule", "average")
