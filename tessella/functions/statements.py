"""Statements of text formats as words, clauses and routes, whole batches at a time: as expressions over arrays these cost microseconds a word, since functions over elements aren't compiled."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPOT = re.compile(r"\( (\S+ \S+)(?: \S+)? \)", re.ASCII)
WHOLE = re.compile(r"[+-]?[0-9]+")


def _grouped(sizes: np.ndarray, items: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), items)


def _cutter(pattern: str) -> Callable[[pa.Array], pa.Array]:
    rule = re.compile(pattern, re.ASCII)

    def run(texts: pa.Array) -> pa.Array:
        found = [rule.findall(t or "") for t in texts.to_pylist()]
        flat = pa.array([p for f in found for p in f], pa.string())
        words = pc.split_pattern(pc.utf8_trim(pc.replace_substring_regex(flat, r"[\s\v]+", " "), " "), " ")
        return _grouped(np.fromiter(map(len, found), np.int64, len(found)), words)

    return run


def cut(text: Column, pattern: str) -> Column:
    """The words of every match of a pattern with one group: an array of arrays."""
    return F.arrow_udf(_cutter(pattern), "array<array<string>>")(text)


def _parted(words: pa.Array) -> pa.Array:
    parts = pc.split_pattern(pc.binary_join(words, " "), " + ")
    return _grouped(pc.list_value_length(parts).to_numpy(zero_copy_only=False), pc.split_pattern(parts.flatten(), " "))


def clauses(words: Column) -> Column:
    """Words between plus signs: an array of arrays."""
    return F.arrow_udf(_parted, "array<array<string>>")(words)


def _number(word: str) -> int:
    if not WHOLE.fullmatch(word):
        raise ValueError(f"not a whole number: {word}")
    return int(word)


def _traced(clause: pa.Array) -> pa.Array:
    xs, ys, sizes, known = [], [], [], []
    for text in pc.binary_join(clause, " ").to_pylist():
        x = y = None
        found, sound = SPOT.findall(text), True
        for a, b in (pair.split(" ") for pair in found):
            x, y = x if a == "*" else _number(a), y if b == "*" else _number(b)
            sound = sound and x is not None and y is not None
            xs.append(x)
            ys.append(y)
        sizes.append(len(found))
        known.append(sound)
    spots = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in (xs, ys)], names=["x", "y"])
    return pa.StructArray.from_arrays([_grouped(np.array(sizes, np.int64), spots), pa.array(known, pa.bool_())], names=["points", "known"])


def traced(clause: Column) -> Column:
    """Struct of the points in a route's words, a star as the coordinate before it, and known, false where a star has nothing before it. What is no whole number of 32 bits raises."""
    return F.arrow_udf(_traced, "points array<struct<x:int,y:int>>, known boolean")(clause)
