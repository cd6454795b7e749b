"""Tiered extraction rules: the first pattern that matches decides."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cache, reduce
from operator import and_, or_
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.functions.text import strip


@dataclass(frozen=True)
class Rule:
    """``pattern`` in Java syntax; ``group`` to return; ``guard`` may reject a value so that
    the next tier is tried; ``clean`` runs before the guard."""

    pattern: str
    group: int = 1
    clean: Callable[[Column], Column] | None = None
    guard: Callable[[Column], Column] | None = None


_BRANCHES = 16


def _words(node) -> list[frozenset[str]]:
    """Sets of literals of a parsed pattern, of each of which every match contains one."""
    sets, run = [], ""
    for op, arg in [*node, (None, None)]:
        if op is _parser.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if run:
            sets.append(frozenset([run]))
        run = ""
        if op is _parser.SUBPATTERN:
            sets += _words(arg[-1])
        elif op is _parser.ATOMIC_GROUP:
            sets += _words(arg)
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT, _parser.POSSESSIVE_REPEAT) and arg[0] > 0:
            sets += _words(arg[2])
        elif op is _parser.BRANCH:
            each = [_words(branch) for branch in arg[1]]
            if all(each):
                sets.append(frozenset().union(*[max(own, key=lambda x: min(map(len, x))) for own in each]))
    return sets


_SETS = {_parser.CATEGORY_DIGIT: "0123456789", _parser.CATEGORY_SPACE: " \t\n\x0b\f\r"}


def _first(node, fold: bool) -> tuple[set[str] | None, bool]:
    """The characters with which a match of a parsed pattern may begin, None if they can be many, and whether it may be empty."""
    out: set[str] = set()
    for op, arg in node:
        empty = False
        if op is _parser.LITERAL:
            own = {chr(arg)} if arg < 128 else None
        elif op is _parser.IN:
            own = set()
            for kind, x in arg:
                more = {chr(x)} if kind is _parser.LITERAL and x < 128 else set(map(chr, range(x[0], x[1] + 1))) if kind is _parser.RANGE and x[1] < 128 else set(_SETS.get(x, "")) if kind is _parser.CATEGORY else set()
                own = own | more if own is not None and more else None
        elif op is _parser.SUBPATTERN:
            own, empty = _first(arg[-1], fold or bool(arg[1] & re.IGNORECASE))
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            own, empty = _first(arg[2], fold)
            empty = empty or arg[0] == 0
        elif op is _parser.BRANCH:
            each = [_first(branch, fold) for branch in arg[1]]
            own, empty = None if any(x is None for x, _ in each) else set().union(*[x for x, _ in each]), any(e for _, e in each)
        elif op in (_parser.AT, _parser.ASSERT, _parser.ASSERT_NOT):
            own, empty = set(), True
        else:
            own = None
        if own is None:
            return None, False
        out |= {y for x in own for y in (x.lower(), x.upper())} if fold else own
        if not empty:
            return out, False
    return out, True


@cache
def quick(pattern: str) -> str:
    """A Java pattern with the same matches, tried only at the characters with which one may begin. Alternatives and letters of
    any case are otherwise compared at every place of a text."""
    node = _parsed(pattern)
    fold = node is not None and bool(node.state.flags & re.IGNORECASE)
    if node is None or not node or (node[0][0] is _parser.LITERAL and not fold):
        return pattern  # a text is searched for plain letters at a pattern's start anyway
    first, empty = _first(node, fold)
    if empty or not first or len(first) > 24:
        return pattern
    flags, body = re.fullmatch(r"(?s)((?:\(\?[a-z]+\))?)(.*)", pattern).groups()
    return f"{flags}(?=[{''.join(f'\\x{ord(c):02x}' for c in sorted(first))}])(?:{body})"


@cache
def _parsed(pattern: str):
    """A Java pattern as Python reads it; None if it reads it in another way, or not at all."""
    plain = re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), pattern)
    if re.search(r"\\[pPhHRXkGzZ0-9cexuUN]|&&|\[[^\]]*\[|\(\?[a-z]*[xUu]", plain):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return _parser.parse(plain)
    except (re.error, Warning, ValueError):
        return None


@cache
def needed_words(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of words in lower case, of each of which any match of a Java pattern contains one in some case."""
    node = _parsed(pattern)
    sets = [] if node is None else _words(node)
    short = [x for x in dict.fromkeys(sets) if len(x) <= _BRANCHES and min(map(len, x)) > 1]
    return tuple(tuple(sorted(x)) for x in sorted(short, key=lambda x: (-min(map(len, x)), len(x)))[:3])


def may_match(text: Column, pattern: str) -> Column:
    """False only for texts in which the pattern finds nothing: words that each match contains are looked for first, which
    costs a fraction of a pattern that is tried at every place."""
    low = F.lower(text)
    return reduce(and_, [reduce(or_, [low.contains(w) for w in words]) for words in needed_words(pattern)], F.lit(True))


def found(text: Column, pattern: str) -> Column:
    """``text.rlike(pattern)``, tried only where it may hold."""
    return may_match(text, pattern) & text.rlike(quick(pattern))


def tier_value(text: Column, rule: Rule, words: bool = True) -> Column:
    """The rule's value, null when the pattern misses or the guard rejects. ``words``: they are looked for first; not worth it
    for a text that is itself computed."""
    value = strip(F.regexp_extract(text, quick(rule.pattern), rule.group))
    if rule.clean:
        value = rule.clean(value)
    hit = found(text, rule.pattern) if words else text.rlike(quick(rule.pattern))
    # A value stands only behind its pattern, and once: what is used twice is otherwise computed ahead, for texts without it too.
    return F.when(hit, F.get(F.filter(F.array(value), rule.guard), F.lit(0)) if rule.guard else value)


def tiered_extract(text: Column, rules: Sequence[Rule]) -> Column:
    """First tier that yields a value. Later patterns run only on rows where earlier ones miss."""
    return F.coalesce(*[tier_value(text, r) for r in rules])


def rule_hits(docs: DataFrame, key: str, text: str, fields: dict[str, Sequence[Rule]]) -> DataFrame:
    """One row per document, field and tier that yields a value. Row-local: no join, no shuffle."""
    entries = [
        F.struct(F.lit(f).alias("field"), F.lit(i).alias("tier"), tier_value(F.col(text), r).alias("value"))
        for f, rules in fields.items()
        for i, r in enumerate(rules, 1)
    ]
    hits = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return docs.select(key, F.inline(hits))


def first_tier(hits: DataFrame, key: str) -> DataFrame:
    """The winning tier per document and field; ``min_by`` combines map-side."""
    return hits.groupBy(key, "field").agg(F.min("tier").alias("tier"), F.min_by("value", "tier").alias("value"))


def hit_rates(hits: DataFrame) -> DataFrame:
    """How many documents each rule matched."""
    return hits.groupBy("field", "tier").agg(F.count("*").alias("hits"))
