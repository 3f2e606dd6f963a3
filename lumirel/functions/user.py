"""User functions on relations: registered by name, called by position or by name, with typed parameters."""

from __future__ import annotations

import inspect
from collections.abc import Callable

_REGISTRY: dict[str, Callable] = {}


def function(f: Callable) -> Callable:
    """Registers a function of relations under its name, whatever its case."""
    _REGISTRY[f.__name__.lower()] = f
    return f


def call(name: str, *args, **named):
    """Calls a registered function; arguments are all by position or all by name, and a list in the first place is mapped."""
    f = _REGISTRY.get(name.lower())
    if f is None:
        raise KeyError(f"no function {name}")
    if args and named:
        raise TypeError("arguments are either all by position or all by name")
    bound = inspect.signature(f).bind(*args, **named)
    first = next(iter(bound.arguments), None)
    if first is not None and isinstance(bound.arguments[first], list):
        rest = {k: v for k, v in bound.arguments.items() if k != first}
        return [f(**{first: x}, **rest) for x in bound.arguments[first]]
    result = f(*bound.args, **bound.kwargs)
    if result is None:
        raise ValueError(f"{name} gives no result")
    return result


def parameter(value, kind: str, choices: list | None = None):
    """A value as NUMBER, STRING or one of CHOICE."""
    if kind == "NUMBER":
        return float(value)
    if kind == "CHOICE" and value not in (choices or []):
        raise ValueError(f"{value} is none of {choices}")
    return str(value) if kind == "STRING" else value
