"""Pattern tables compiled into column expressions.

A pattern table is an ordered list of ``(label, regex)``. It is compiled once into a CASE chain, so
tagging is a narrow projection: no join with the table, no shuffle, no Python per row.
Regexes are matched case-insensitively with Unicode word boundaries.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .folds import let

UNICODE = "(?iuU)"


def matches(text: Column, regex: str) -> Column:
    return text.rlike(UNICODE + regex)


def joined(regexes: Sequence[str]) -> str:
    return "|".join(f"(?:{r})" for r in regexes)


def any_match(text: Column, regexes: Sequence[str]) -> Column:
    return matches(text, joined(regexes))


def first_label(text: Column, table: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern that matches, in table order."""
    chain = F
    for label, regex in table:
        chain = chain.when(matches(text, regex), F.lit(label))
    return chain.otherwise(F.lit(default))


def needed_literals(regex: str) -> list[str] | None:
    """Lower-case strings of which every match holds one: the longest plain run of each alternative; None if one has none.

    Alternatives are told apart outside of groups only; groups, classes, escapes and repeated characters end a run.
    """
    flat = re.sub(r"\\.|\[[^\]]*\]", "\0", regex)
    while "(" in flat:
        inner = re.sub(r"\([^()]*\)", "\0", flat)
        if inner == flat:
            return None
        flat = inner
    flat = re.sub(r".(?:[?*]|\{[^}]*\})[?+]?|[+.^$]", "\0", flat, flags=re.S)
    longest = [max(re.split("\0+", part), key=len).lower() for part in flat.split("|")]
    return None if min(map(len, longest)) < 2 else longest


def caseless(text: Column) -> Column:
    """Lower case as caseless patterns compare it: also letters that only fold to a plain one."""
    return F.lower(F.translate(text, "ſıİ", "sii"))


def first_hit(text: Column, regexes: Sequence[str]) -> Column:
    """Matched text of the first pattern that matches, null if none does.

    A pattern is tried only on texts that hold a string which all its matches need, so most rows cost no regex.
    """
    def tried(lower: Column, regex: str) -> Column:
        hit = F.regexp_extract(text, UNICODE + regex, 0)
        found, literals = F.when(hit != "", hit), needed_literals(regex)
        return F.when(reduce(or_, [F.contains(lower, F.lit(x)) for x in literals]), found) if literals else found

    return let(caseless(text), lambda lower: F.coalesce(*[tried(lower, r) for r in regexes]))


def contains_all(text: Column, terms: Column) -> Column:
    return F.forall(terms, lambda t: F.contains(text, t))


def contains_any(text: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(text, t))


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
