"""Countries named in allocation texts.

Spellings are found with one alternation per text and mapped through a literal dictionary, so no
text meets the dictionary in a join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.functions.fixed import ALIASES, COUNTRIES, COUNTRY_LANGUAGES
from studylake.functions.rules import Rule, may_match, tier_value
from studylake.functions.text import let, strip
from studylake.operators.structure import to_next_heading

_ALL = [(a, key) for key, names in ALIASES.items() for a in names]
_LONGEST = sorted(_ALL, key=lambda p: -len(p[0]))
_SHORT = [p for p in _LONGEST if len(p[0]) <= 3 and p[0].upper() == p[0]]
_LONG = [p for p in _LONGEST if p not in _SHORT]


def _alternation(pairs: list[tuple[str, str]]) -> str:
    """The spellings as whole words, those of one initial together, so that a word is compared with these only."""
    by: dict[str, list[str]] = {}
    for a, _ in pairs:
        by.setdefault(a[0], []).append(re.escape(a[1:]).replace(r"\ ", " "))
    return rf"\b(?=[{''.join(by)}])(" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items()) + r")\b"


def _extract(text: Column, pattern: str, group: int) -> Column:
    """``regexp_extract``, tried only where its words are."""
    return F.when(~may_match(text, pattern), "").otherwise(F.regexp_extract(text, pattern, group))


def _lookup(pairs: list[tuple[str, str]], lower: bool = False) -> Column:
    entries = {(a.lower() if lower else a): k for a, k in reversed(pairs)}
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def _info(part: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in COUNTRIES.items() for x in (k, v[part])])


def exact_hits(text: Column) -> Column:
    """Distinct countries whose spellings occur as whole words, in the case they are written in."""
    names = F.regexp_extract_all(text, F.lit(_alternation(_LONGEST)), F.lit(1))
    return F.array_distinct(F.transform(names, lambda a: F.element_at(_lookup(_ALL), a)))


def loose_hits(text: Column) -> Column:
    """Distinct countries, any case, but short capitals as written; longest spelling first."""
    both = F.concat(
        F.regexp_extract_all(text, F.lit("(?i)" + _alternation(_LONG)), F.lit(1)),
        F.regexp_extract_all(text, F.lit(_alternation(_SHORT)), F.lit(1)),
    )
    order = {a.lower(): i for i, (a, _) in enumerate(_LONGEST)}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    ranked = F.array_sort(F.transform(both, lambda a: F.struct(F.element_at(rank, F.lower(a)).alias("r"), F.lower(a).alias("a"))))
    return F.array_distinct(F.transform(ranked, lambda s: F.element_at(_lookup(_ALL, True), s["a"])))


def country_of_name(name: Column) -> Column:
    """The country a whole name spells, any case; null for other words."""
    bare = F.rtrim(strip(name), F.lit("."))
    return F.coalesce(F.try_element_at(_lookup(_ALL), bare), F.try_element_at(_lookup(_ALL, True), F.lower(bare)))


_ENTRY = "array<struct<key:string,step:int,pct:double,consideration:boolean,sites:int>>"


def _entries(keys: Column, step: int, pct: Column | None = None, consideration: bool = False, sites: Column | None = None) -> Column:
    return F.transform(
        keys,
        lambda k: F.struct(
            k.alias("key"),
            F.lit(step).alias("step"),
            (pct if pct is not None else F.lit(None)).cast("double").alias("pct"),
            F.lit(consideration).alias("consideration"),
            (sites if sites is not None else F.lit(None)).cast("int").alias("sites"),
        ),
    )


_IN_SCOPE = r"(?i)(?:will be in scope|countries in scope include|in scope for country allocation)[^.]*\."
_PLAN = r"(?i)Based on \w+ countries in scope include"  # any committee
_UNITS = r"(?:(?i:Other)\s+)?\b[A-Z]*BU\b[^.]*"  # other business units


def _plan(text: Column) -> Column:
    """The country plan, to the next heading."""
    at = F.regexp_instr(text, F.lit(_PLAN))
    return F.when(may_match(text, _PLAN) & (at > 0), to_next_heading(text, at)).otherwise("")


def _per_match(text: Column, pattern: str, build) -> Column:
    """Entries built from each match of a pattern with two groups."""
    groups = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"),
    )
    return F.flatten(F.transform(groups, lambda g: build(g["a"], g["b"])))


def _one(key: Column) -> Column:
    return F.filter(F.array(key), lambda k: k.isNotNull())


def _collect(docs: DataFrame, entries: Column) -> DataFrame:
    """One row per document and country; the earliest step that has a share or a number of
    sites sets it, and any mark for consideration holds."""
    rows = docs.select("doc_id", F.inline(entries.cast(_ENTRY)))
    found = rows.groupBy("doc_id", "key").agg(
        F.min_by("pct", F.when(F.col("pct").isNotNull(), F.col("step"))).alias("pct"),
        F.bool_or("consideration").alias("consideration"),
        F.min_by("sites", F.when(F.col("sites").isNotNull(), F.col("step"))).alias("sites"),
    )
    return found.select(
        "doc_id",
        F.element_at(_info(0), F.col("key")).alias("name"),
        F.element_at(_info(1), F.col("key")).alias("abbreviation"),
        "pct",
        "consideration",
        "sites",
    )


def _numbered(entries: Column) -> Column:
    """Steps renumbered by position, so that of two shares the one written first counts."""
    return F.transform(
        entries,
        lambda e, i: F.struct(
            e["key"].alias("key"), i.cast("int").alias("step"), e["pct"].alias("pct"), e["consideration"].alias("consideration"), e["sites"].alias("sites")
        ),
    )


def country_mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """Countries in scope, for consideration, and with target shares; every country named in the
    text where none of these phrases is used."""
    t = F.col(text)
    # Each array of one is a border, so that what is found in a text is found once, however often it is used below.
    found = F.struct(
        _extract(t, _IN_SCOPE, 0).alias("scope"), _extract(t, r"(?i)consideration can be given to ([^.;]+)", 1).alias("maybe"), _plan(t).alias("chunk")
    )
    parts = docs.select("doc_id", t.alias("_t"), found.alias("_f")).select("doc_id", "_t", F.explode(F.array("_f")).alias("_f"))
    named = F.struct(
        exact_hits(F.col("_f.scope")).alias("scope"),
        exact_hits(F.col("_f.maybe")).alias("maybe"),
        exact_hits(F.col("_f.chunk")).alias("named"),
        exact_hits(F.regexp_extract("_f.chunk", _UNITS, 0)).alias("units"),
    )
    staged = parts.select("doc_id", "_t", F.col("_f.chunk").alias("_chunk"), named.alias("_n")).select(
        "doc_id", "_t", "_chunk", F.explode(F.array("_n")).alias("_n")
    ).select("doc_id", "_t", "_chunk", F.col("_n.scope").alias("_scope"), F.col("_n.maybe").alias("_maybe"), F.col("_n.named").alias("_named"), F.col("_n.units").alias("_units"))
    shares = _per_match(
        F.col("_chunk"), r"(?i)([^\n]*?target\s*(\d+)%)", lambda line, n: _entries(exact_hits(line), 3, n.cast("double") / 100)
    )
    phrases = F.concat(
        _entries(F.col("_scope"), 1),
        _entries(F.col("_maybe"), 2, consideration=True),
        shares,
        _entries(F.col("_named"), 4),
        # Countries named for consideration further down are those of the plan itself.
        _entries(F.array_intersect("_units", F.array_union("_named", F.array_union("_scope", "_maybe"))), 5, consideration=True),
    )
    rows = staged.select("doc_id", "_t", phrases.alias("_e")).select("doc_id", "_t", F.explode(F.array("_e")).alias("_e"))
    entries = F.when(F.size("_e") > 0, _numbered(F.col("_e"))).otherwise(_entries(exact_hits(F.col("_t")), 6))
    return _collect(rows, entries).drop("sites")


def country_section(docs: DataFrame, text: str = "text") -> DataFrame:
    """Countries of an allocation section: target shares, scope, consideration, plan and site
    counts; only without any of them, sole-country phrases, then sentences on enrolling."""
    t = F.col(text)
    first = F.concat(
        _per_match(
            t,
            r"(?i)(\w+(?:\s+\w+)?)\s+at\s+target\s+(\d+)%",
            lambda name, n: _entries(_one(country_of_name(name)), 1, n.cast("double") / 100),
        ),
        _entries(exact_hits(F.regexp_extract(t, _IN_SCOPE, 0)), 2),
        _entries(exact_hits(F.regexp_extract(t, _UNITS, 0)), 3, consideration=True),
        _entries(exact_hits(_plan(t)), 4),
        _per_match(
            t,
            r"(?i)(\d+)\s*(?:sites?|patients?|subjects?)\s*(?:in|for)\s+(\w+(?:\s+\w+)?)",
            lambda n, name: _entries(_one(country_of_name(name)), 5, sites=n),
        ),
    )

    def names(pattern: str) -> Column:
        found = F.regexp_extract_all(F.col("_t"), F.lit(pattern), F.lit(1))
        return F.filter(F.transform(found, country_of_name), lambda k: k.isNotNull())

    sole = F.concat(
        names(r"\b([A-Za-z][\w\s]{0,25}?)-only\b"),
        names(
            r"(?i)(?:will be|is)\s+(?:sited\s+)?(?:all\s+)?(?:only\s+)?in\s+(?:the\s+)?([A-Za-z][\w\s]{0,25}?)(?=[\.,;]|\s+and\b|$)"
        ),
    )
    verbs = r"(?i)\b(?:enroll\w*|conduct\w*|sit(?:e|ed|ing)\w*|study\s+will|trial\s+will|take\s+place)"
    sentences = F.filter(F.split(F.col("_t"), r"(?<=[.!?])\s+"), lambda s: s.rlike(verbs))
    enrolling = F.flatten(F.transform(sentences, exact_hits))
    rows = docs.select("doc_id", t.alias("_t"), first.alias("_e"))
    rows = rows.select("*", F.when(F.size("_e") == 0, sole).alias("_sole"))
    entries = (
        F.when(F.size("_e") > 0, _numbered(F.col("_e")))
        .when(F.size("_sole") > 0, _entries(F.col("_sole"), 6))
        .otherwise(_entries(enrolling, 7))
    )
    return _collect(rows, entries)


def country_check_row(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, name, abbreviation, pct, status)`` from the fourth cell of the check row, or from
    the sentence that states the scope. Documents with neither use :func:`country_section`."""
    trigger = r"(?i)country\s*check"

    def cells(line: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", "")
        return F.transform(F.split(inner, r"\|", -1), strip)

    def read(line: Column) -> Column:
        value = let(
            cells(line), lambda c: F.when(F.size(c) >= 4, c[3]).otherwise(F.regexp_replace(line, rf"(?s)^.*?{trigger}".replace("(?i)", "(?i:") + ")", ""))
        )
        in_scope = r"(?i)will be in scope|countries in scope include|in scope for country allocation|\bin scope\b"
        unsure = r"(?i)consideration|recommended to consider|for consideration|not required|utilized"
        return let(
            value,
            lambda v: F.struct(v.alias("value"), F.when(v.rlike(in_scope) & ~v.rlike(unsure), "confirmed").otherwise("under_consideration").alias("status")),
        )

    lines = F.filter(F.split(F.col(text), "\r?\n"), lambda s: s.rlike(trigger + r"|(?i)in scope for (?:the )?country allocation"))
    parsed = F.transform(
        lines, lambda s: F.when(s.rlike(trigger), read(s)).otherwise(F.struct(s.alias("value"), F.lit("confirmed").alias("status")))
    )
    hits = F.flatten(
        F.transform(
            parsed, lambda p: F.transform(loose_hits(p["value"]), lambda k: F.struct(k.alias("key"), p["status"].alias("status")))
        )
    )
    rows = docs.select("doc_id", F.col(text).alias("_t"), hits.alias("_h"))
    strict = (
        rows.select("doc_id", F.inline("_h"))
        .groupBy("doc_id", "key")
        .agg(F.min("status").alias("status"))  # 'confirmed' sorts before 'under_consideration'
        .select(
            "doc_id",
            F.element_at(_info(0), F.col("key")).alias("name"),
            F.element_at(_info(1), F.col("key")).alias("abbreviation"),
            F.lit(None).cast("double").alias("pct"),
            "status",
        )
    )
    rest = country_section(rows.where(F.size("_h") == 0), "_t").select(
        "doc_id",
        "name",
        "abbreviation",
        "pct",
        F.when(F.col("consideration"), "under_consideration").otherwise("confirmed").alias("status"),
    )
    return strict.unionByName(rest)


# Phrases that name the country of the first visit.
FIRST_VISIT = [
    r"(?i)country\s+where\s+initial\s+fpv\s+planned\s*[:=\-]\s*([^\n.;]+)",
    r"(?i)initial\s+(?:fpv|first\s+patient\s+visit)\s*(?:is|=|planned|planned\s+in|planned\s+for|in)?\s*([^\n.;]+)",
    r"(?i)first\s+patient\s+visit\s*(?:is|=|planned|planned\s+in|planned\s+for|in)\s*([^\n.;]+)",
    r"(?i)first\s+country\s*(?:for\s*)?(?:fpv|first\s+patient\s+visit)\s*[:=\-]?\s*([^\n.;]+)",
]


def initial_country(text: Column) -> Column:
    """Country of the first patient visit by phrase; null where no phrase names one."""
    tiers = []
    for p in FIRST_VISIT:
        fragments = F.regexp_extract_all(text, F.lit(p), F.lit(1))
        named = F.filter(F.transform(fragments, lambda f: F.try_element_at(loose_hits(f), F.lit(1))), lambda k: k.isNotNull())
        tiers.append(F.when(may_match(text, p), F.try_element_at(named, F.lit(1))))
    return F.element_at(_info(0), F.coalesce(*tiers))


def parse_country_input(raw: Column) -> Column:
    """Array of ``struct(name, abbreviation, pct, consideration)`` from a typed list."""

    def entry(part: Column) -> Column:
        pct = tier_value(part, Rule(r"\((\d+(?:\.\d+)?)\s*%\)")).try_cast("double") / F.lit(100)
        name = strip(F.regexp_replace(part, r"\s*\(.*\)\s*", ""))
        return F.struct(name.alias("name"), name.alias("abbreviation"), pct.alias("pct"), part.rlike("(?i)consideration").alias("consideration"))

    return F.filter(F.transform(F.split(raw, ","), lambda p: entry(strip(p))), lambda e: e["name"] != "")


def translation_languages(countries: DataFrame) -> DataFrame:
    """``(doc_id, language)`` of the countries, each once."""
    names = F.create_map(*[x for k, v in COUNTRY_LANGUAGES.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    return countries.select("doc_id", F.explode(F.try_element_at(names, F.col("abbreviation"))).alias("language")).distinct()
