"""Small pieces of DuckDB SQL shared by the SQL twins."""

from __future__ import annotations

from collections.abc import Sequence

from studylake.functions.rules import Rule

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip_(x: str) -> str:
    return f"trim({x}, {_WS})"


def squeeze_(x: str) -> str:
    return strip_(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def clip_(x: str, n: int) -> str:
    s = squeeze_(x)
    return f"case when length({s}) <= {n} then {s} else rtrim(substring({s}, 1, {n})) || '...' end"


def cells_(x: str) -> str:
    """Cells of a pipe row that opens and closes with a pipe."""
    return f"list_transform(string_split(trim({x}), '|'), lambda c: trim(c))[2:-2]"


def match_(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quote(pattern)})"


def extract_(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {quote(pattern)}, {group})"


def html_text_(x: str) -> str:
    for pattern, to in [
        (r"(?is)<script[^>]*>.*?</script>", "' '"),
        (r"(?is)<style[^>]*>.*?</style>", "' '"),
        (r"(?i)<br\s*/?>", "chr(10)"),
        (r"(?i)</p\s*>", "chr(10)"),
        (r"(?i)</div\s*>", "chr(10)"),
        (r"(?i)</tr\s*>", "chr(10)"),
        (r"(?i)</t[dh]\s*>", "' | '"),
        (r"(?s)<[^>]+>", "' '"),
    ]:
        x = f"regexp_replace({x}, {quote(pattern)}, {to}, 'g')"
    for ref, char in [("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("#39", "''"), ("eacute", "é"), ("amp", "&")]:
        x = f"replace({x}, '&{ref};', '{char}')"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    return strip_(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def tiers_(x: str, rules: Sequence[Rule]) -> str:
    """A case over plain rules (no guard or clean-up)."""
    arms = " ".join(f"when {match_(x, r.pattern)} then {strip_(extract_(x, r.pattern, r.group))}" for r in rules)
    return f"case {arms} end"


def repaired_(x: str) -> str:
    """Codes and words whose letters are set apart, closed up. Two passes close what overlaps; runs of letters are closed one by one."""
    pair = f"regexp_replace(regexp_replace({x}, '([A-Z0-9]) ([A-Z0-9])', '\\1\\2', 'g'), '([A-Z0-9]) ([A-Z0-9])', '\\1\\2', 'g')"
    codes = f"case when regexp_matches({x}, '[A-Z0-9](?: [A-Z0-9])+-[A-Z0-9]') then {pair} else {x} end"
    return f"list_reduce(list_prepend({codes}, regexp_extract_all({codes}, '\\b[A-Za-z](?: [A-Za-z]){{3,}}\\b')), lambda t, run: replace(t, run, replace(run, ' ', '')))"
