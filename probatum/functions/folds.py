"""Greedy packing inside one row, as folds over small arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import estimate_tokens, strip

SENTENCE_END = r"(?<=[.!?])\s+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, inside a fold."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _empty() -> Column:
    return F.array().cast("array<string>")


def _closed(state: Column) -> Column:
    return F.when(state["cur"] == "", state["out"]).otherwise(F.concat(state["out"], F.array(state["cur"])))


def pack(parts: Column, size, fits, joiner: str) -> Column:
    """Join consecutive parts while they fit: ``size(part)`` and ``fits(size so far, part size)`` decide."""

    def step(state: Column, part: Column) -> Column:
        full = (state["cur"] != "") & ~fits(state["n"], size(part))
        return F.struct(
            F.when(full, F.concat(state["out"], F.array(state["cur"]))).otherwise(state["out"]).alias("out"),
            F.when(full | (state["cur"] == ""), part).otherwise(F.concat(state["cur"], F.lit(joiner), part)).alias("cur"),
            F.when(full, size(part)).otherwise(state["n"] + size(part)).cast("int").alias("n"))

    start = F.struct(_empty().alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))
    return F.aggregate(parts, start, step, _closed)


def pack_tokens(parts: Column, max_tokens: int, joiner: str = "\n\n") -> Column:
    """Blocks of whole parts whose token estimates add up to at most ``max_tokens``."""
    return pack(parts, estimate_tokens, lambda n, t: n + t <= max_tokens, joiner)


def pack_sentences(text: Column, max_tokens: int) -> Column:
    """Sentences packed while the joined text stays within ``max_tokens``."""

    def step(state: Column, part: Column) -> Column:
        joined = F.concat(state["cur"], F.lit(" "), part)
        full = (estimate_tokens(joined) > max_tokens) & (state["cur"] != "")
        return F.struct(
            F.when(full, F.concat(state["out"], F.array(strip(state["cur"])))).otherwise(state["out"]).alias("out"),
            F.when(full | (state["cur"] == ""), part).otherwise(joined).alias("cur"))

    start = F.struct(_empty().alias("out"), F.lit("").alias("cur"))
    packed = F.aggregate(F.split(text, SENTENCE_END), start, step, _closed)
    return F.filter(F.transform(packed, strip), lambda p: p != "")


def pack_chars(paragraphs: Column, target: int, joiner: str = "\n\n") -> Column:
    """Blocks below ``target`` characters; a paragraph half as long again is packed by sentence instead."""

    def add(state: Column, part: Column, glue: str) -> Column:
        fits = F.length(state["cur"]) + F.length(part) < target
        empty = state["cur"] == ""
        return F.struct(
            F.when(fits | empty, state["out"]).otherwise(F.concat(state["out"], F.array(state["cur"]))).alias("out"),
            F.when(fits & ~empty, F.concat(state["cur"], F.lit(glue), part)).otherwise(part).alias("cur"))

    def step(state: Column, part: Column) -> Column:
        fits = F.length(state["cur"]) + F.length(part) < target
        closed = F.struct(_closed(state).alias("out"), F.lit("").alias("cur"))
        by_sentence = F.aggregate(F.split(part, SENTENCE_END), closed, lambda s, x: add(s, x, " "))
        return F.when(~fits & (F.length(part) > target * 1.5), by_sentence).otherwise(add(state, part, joiner))

    return F.aggregate(paragraphs, F.struct(_empty().alias("out"), F.lit("").alias("cur")), step, _closed)
