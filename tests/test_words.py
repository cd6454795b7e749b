"""Rules look for words first; what they find stays the same."""

from __future__ import annotations

from random import Random

from pyspark.sql import functions as F

from studylake.functions.fixed import ONCOLOGY
from studylake.functions.rules import found, needed_words, quick
from studylake.functions.text import any_of
from studylake.operators import countries as C
from studylake.operators import fields as R
from studylake.operators import resolve as H
from studylake.plans import documents as P

PATTERNS = [
    *[r.pattern for r in [*R.PROTOCOL_NUMBER, *R.PHASE, *R.AREA_LABEL, *R.CONDITION_LABEL, *R.INDICATION, *R.COMPOUND]],
    *[f"(?i){p}" for p in [*R.ENROLLMENT, *R.MIN_AGE]], *R.IMMUNOGENICITY, *R.TITLE, *[p for p, _ in R.GENETICS], *C.FIRST_VISIT,
    R.SCREEN_FAIL_STRICT, C._IN_SCOPE, C._PLAN, C._UNITS, any_of(ONCOLOGY, ""), r"(?i)\Qa.b\E\s*:\s*(x)", r"(?:a|)b|\u00e9t\u00e9", r"(?i)(?!no)n\d",
]
PIECES = [
    "Protocol", "Number", ":", " ", "\n", "A", "Phase", "3", "12", "III", "Study", "patients", "Total", "of", "about", "AGED", "years", "age", "older", "must be", "at least",
    "Compound", "QX1234567", "(", ")", "Immunogenicity", "is", "Yes", "N", "=", "no", "Genetics", "collected", "initial FPV planned", "in scope for country allocation", ".",
    "a.b", "x", "\u00e9t\u00e9", "\u0130", "\u212a", "tumor", "Screen failure rate", "%", "Indication", "BU", "Other", "Based on X countries in scope include", "pharmacogenomic", "sponsor",
]


def test_patterns_find_the_same(spark):
    random = Random(7)
    texts = ["".join(random.choice(PIECES) + random.choice(["", " ", " "]) for _ in range(random.randrange(1, 14))) for _ in range(1500)] + [""]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(4)
    t = F.col("text")
    for some in (PATTERNS[i : i + 12] for i in range(0, len(PATTERNS), 12)):
        wrong = rows.select(
            *[F.count_if(~found(t, p).eqNullSafe(t.rlike(p)) | ~F.regexp_extract(t, quick(p), 0).eqNullSafe(F.regexp_extract(t, p, 0))).alias(str(i)) for i, p in enumerate(some)]
        ).first()
        assert not any(wrong), [p for p, n in zip(some, wrong, strict=True) if n]


def test_words_are_those_of_every_match():
    assert needed_words(r"(?i)Compound\s*:\s*(x)") == (("compound",),)
    assert needed_words(r"(?:Ab|cd)?x+\d") == ()
    assert needed_words(r"(?:Abc|def)\s+Size") == (("size",), ("abc", "def"))
    assert needed_words(r"(?!abc)\d") == ()


def test_countries_of_one_initial_are_compared_together(spark):
    names = [a for a, _ in C._ALL]
    rows = spark.createDataFrame([(i, f"In {a}, xUS or {a}x and {b}.") for i, (a, b) in enumerate(zip(names, reversed(names), strict=True))], "i int, text string")
    key = dict(C._ALL)
    for i, hits in rows.select("i", C.exact_hits(F.col("text"))).collect():
        own = {key[names[i]], key[names[-1 - i]]}
        assert own <= {*hits} | {"US" if "U.S." in (names[i], names[-1 - i]) else ""}, (names[i], hits)
    assert "(?=[" in C._alternation(C._LONGEST)


def test_coverage_is_rolled_up_from_counts(spark, capsys):
    rows = spark.createDataFrame([("a", "filled"), ("a", "review"), ("a", "filled"), ("b", "filled")], "field string, status string")
    out = H.corpus_coverage(rows)
    assert {tuple(r) for r in out.collect()} == {("a", "filled", 2), ("a", "review", 1), ("b", "filled", 1), ("a", None, 3), ("b", None, 1), (None, None, 4)}
    capsys.readouterr()
    out.explain()
    plan = capsys.readouterr().out
    assert "HashAggregate" in plan.split("Expand", 1)[1]


def test_texts_are_dealt_out_to_a_fixed_number_of_tasks(spark, capsys):
    docs = spark.createDataFrame([(i, f"Protocol Number: AB-CD-E{i}") for i in range(50)], "doc_id bigint, text string")
    lines = docs.select("doc_id", F.lit(0).alias("line_no"), "text")
    findings = P.document_findings(docs, lines)
    capsys.readouterr()
    findings.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
    assert findings.where("field = 'Protocol alias' and value = concat('AB-CD-E', doc_id)").count() >= 40
