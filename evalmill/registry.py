"""Names for user functions: extraction rules, metrics, readers, retrievers and models.

A rule is Column -> Column, a metric DataFrame -> DataFrame, a retriever
(test, train, ...) -> edges, a model loader returns a function on pandas batches.
"""

from __future__ import annotations

from collections.abc import Callable

from evalmill.functions import extract as E
from evalmill.operators import exact, retrieve
from evalmill.sources import readers

KINDS = ("rule", "metric", "reader", "retriever", "model")
_FUNCTIONS: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, fn: Callable) -> Callable:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}: one of {KINDS}")
    if (kind, name) in _FUNCTIONS:
        raise ValueError(f"{kind} {name} is registered already")
    _FUNCTIONS[kind, name] = fn
    return fn


def lookup(kind: str, name: str) -> Callable:
    if (kind, name) not in _FUNCTIONS:
        raise KeyError(f"no {kind} named {name}; known: {names(kind)}")
    return _FUNCTIONS[kind, name]


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _FUNCTIONS if k == kind)


for _name in ("general", "qa_normalise", "first_capital", "last_capital", "first_run", "capital_set", "last_number", "answer_choice", "final_answer"):
    register("rule", _name, getattr(E, _name))
for _name in ("accuracy", "exact_match", "token_f1", "pass_rate", "extraction_rate"):
    register("metric", _name, getattr(exact, _name))
for _name in ("read_items", "read_subject_files", "read_nested_qa", "read_prediction_shards"):
    register("reader", _name, getattr(readers, _name))
for _name in ("retrieve_fixed", "retrieve_random", "retrieve_bm25", "retrieve_dense", "retrieve_diverse"):
    register("retriever", _name, getattr(retrieve, _name))
