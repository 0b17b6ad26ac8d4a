"""Hooks: named points at which registered functions change a DataFrame or a value, failures kept apart."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: The points.
HOOKS = ("after_parse", "before_ingest", "after_ingest", "before_retrieve", "after_retrieve", "before_generate", "after_generate", "before_answer", "on_error")
MAX_FAILURES = 200


@dataclass
class Outcome:
    value: object
    ran: list[str] = field(default_factory=list)
    failures: list[tuple[str, str]] = field(default_factory=list)


class Plugins:
    """A registry; functions run in the order of registration."""

    def __init__(self) -> None:
        self._hooks: dict[str, list[tuple[str, Callable]]] = {h: [] for h in HOOKS}
        self.names: list[str] = []
        self.failures: list[tuple[str, str, str]] = []

    def register(self, name: str, setup: Callable[[Callable[[str, Callable], None]], None], *, replace: bool = False) -> None:
        """setup(add) adds a plugin's functions. If it fails nothing of it stays, and what it would replace does."""
        if name in self.names and not replace:
            raise ValueError(f"{name} is registered")
        added: list[tuple[str, Callable]] = []

        def add(hook: str, fn: Callable) -> None:
            if hook not in self._hooks:
                raise ValueError(f"no hook {hook}")
            added.append((hook, fn))

        try:
            setup(add)
        except Exception as e:
            self._fail(name, "register", e)
            raise
        self.unregister(name)
        self.names.append(name)
        for hook, fn in added:
            self._hooks[hook].append((name, fn))

    def unregister(self, name: str) -> None:
        self.names = [n for n in self.names if n != name]
        self._hooks = {h: [x for x in fns if x[0] != name] for h, fns in self._hooks.items()}

    def _fail(self, name: str, where: str, error: Exception) -> None:
        self.failures = [*self.failures, (name, where, str(error))][-MAX_FAILURES:]

    def run(self, hook: str, value: object, check: Callable[[object], bool] | None = None) -> Outcome:
        """Each function gets the value and gives the next, or None to only look. A failure, or a value that the check
        refuses, leaves the value as it was. A DataFrame must keep the columns it came with."""
        out = Outcome(value)
        for name, fn in self._hooks[hook]:
            try:
                got = fn(out.value)
                if got is not None:
                    if isinstance(out.value, DataFrame) and not (isinstance(got, DataFrame) and set(out.value.columns) <= set(got.columns)):
                        raise TypeError("columns are missing")
                    if check is not None and not check(got):
                        raise TypeError("the value is of another kind")
                    out.value = got
                out.ran.append(name)
            except Exception as e:  # noqa: BLE001 - one plugin must not stop the others
                out.failures.append((name, str(e)))
                self._fail(name, hook, e)
        return out

    def discover(self, modules: Iterable[str], variable: str = "") -> tuple[list[str], list[str]]:
        """(registered, failed) of modules with a function register(add), each once, those in the variable after the others."""
        done, failed = [], []
        for module in dict.fromkeys([*modules, *[m.strip() for m in variable.split(",") if m.strip()]]):
            try:
                self.register(module, importlib.import_module(module).register)
                done.append(module)
            except Exception as e:  # noqa: BLE001
                self._fail(module, "discover", e)
                failed.append(module)
        return done, failed
