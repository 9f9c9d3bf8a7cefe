"""Named Python callables for $where, $function and $accumulator. The only operators that run Python on executors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Registered:
    call: Callable
    returns: T.DataType | str


@dataclass(frozen=True)
class Accumulator:
    """init(*init_args) -> state; accumulate(state, *args) -> state; finalize(state) -> result."""

    init: Callable
    accumulate: Callable
    finalize: Callable
    returns: T.DataType | str


_functions: dict[str, Registered] = {}
_accumulators: dict[str, Accumulator] = {}


def register_function(name: str, call: Callable, returns: T.DataType | str) -> None:
    """A function of pandas Series that returns a Series: one call for each Arrow batch."""
    _functions[name] = Registered(call, returns)


def register_accumulator(name: str, init: Callable, accumulate: Callable, returns: T.DataType | str, finalize: Callable = lambda s: s) -> None:
    _accumulators[name] = Accumulator(init, accumulate, finalize, returns)


def function(name: str) -> Registered:
    if name not in _functions:
        raise KeyError(f"no function {name!r} is registered")
    return _functions[name]


def accumulator(name: str) -> Accumulator:
    if name not in _accumulators:
        raise KeyError(f"no accumulator {name!r} is registered")
    return _accumulators[name]
