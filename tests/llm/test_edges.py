"""Broken markup, long numbers, clashing names, long chains: what must not crash, hang or lose text."""

import random
import re
import time

from studylake.llm import html_text, line_dedup, personal_data
from studylake.llm.common import without
from studylake.llm.components import components

LONG = "A paragraph of the article that is long enough to be text by itself, with more than eighty characters. "


def page(*blocks: str, article: bool = False) -> str:
    inner = "".join(blocks)
    return f"<html><body><nav><ul><li><a href=x>Home of all</a></li></ul></nav>{f'<article>{inner}</article>' if article else f'<div>{inner}</div>'}<footer>End</footer></body></html>"


def test_broken_markup_takes_linear_time():
    start = time.perf_counter()
    for bad in ("<script", "<a", '<a href="', "<!", "<!--x", "</a", "<a '\"", "<textarea>", "<p x='><a \"y"):
        html_text.main_text((bad * (1_000_000 // len(bad)))[:1_000_000])
        html_text.main_text(f"<p>{LONG}</p>" + (bad * (300_000 // len(bad))) + ">")
    assert time.perf_counter() - start < 36  # 18 pages


def test_tokens_of_plain_markup():
    html = "a<b class=\"x>y\">c</b><!-- <p> --><script>if (a < b) '</p>'</script><br/>1 < 2 > 0<!doctype x><i"
    assert [(t.name, t.end, t.attrs, html[t.start : t.stop][:3]) for t in html_text.tokens(html)] == [
        ("b", False, ' class="x>y"', "<b "), ("b", True, "", "</b"), ("", False, "", "<!-"), ("", False, "", "<sc"), ("br", False, "/", "<br"), ("", False, "", "<!d"),
    ]


def test_line_breaks_part_words():
    assert html_text.main_text(page(f"<p>{LONG}one<br>two<br/>three</p>")).endswith("one two three")


def test_lines_inside_the_text_stay():
    linked = f"<p><a href=y>{LONG}</a></p>"
    short = "".join(f"<p>{w}</p>" for w in ("aa", "bb", "cc", "dd", "ee"))
    for article in (False, True):
        lines = html_text.main_text(page(f"<p>{LONG}</p>", linked, f"<p>{LONG}</p>", short, f"<p>{LONG}</p>", "<p>So.</p><p>It.</p><p>Is.</p><p>Done.</p>", article=article)).split("\n")
        assert lines == [LONG.strip()] * 3 + ["aa", "bb", "cc", "dd", "ee"] + [LONG.strip()] + ["So.", "It.", "Is.", "Done."]


def test_lists_of_links_go_outside_an_article():
    links = "".join(f"<p><a href={i}>Another page with a long title number {i}</a></p>" for i in range(8))
    assert html_text.main_text(page(f"<p>{LONG}</p>" * 3, links)) == "\n".join([LONG.strip()] * 3)


def test_compound_class_words():
    keep = ("article-header", "social-science", "research-notice-board", "headers", "adverse-events")
    drop = ("site-header", "cookie_banner", "main-nav", "ad", "sidebar left", "post-comments", "ad-slot")
    for c in (*keep, *drop):
        text = html_text.main_text(page(f"<p>{LONG}</p>", f'<div class="{c}"><p>{LONG}x</p></div>', f"<p>{LONG}</p>"))
        assert (f"{LONG}x" in text) == (c in keep), c
    assert html_text.main_text(page("<header><h1>The title</h1></header>", f"<p>{LONG}</p>", article=True)).startswith("The title\n")


def windows_by_loop(html: str) -> str:
    """Surge and dive restated for pages of plain paragraphs outside an article: from the first window of three lines that reaches the threshold on."""
    lines = [x for x in (" ".join(t.split()) for t in re.findall(r"<p>(.*?)</p>", html)) if x]
    sums = [sum(map(len, lines[i : i + 3])) for i in range(len(lines))]
    least = min(80, max(sums, default=0) / 2)
    first = next((i for i, s in enumerate(sums) if s >= least and s > 0), len(lines))
    return "\n".join(lines[first:])


def test_windows_against_a_loop():
    rng = random.Random(6)
    for _ in range(200):
        html = "".join(f"<p>{'word ' * rng.choice([0, 1, 1, 2, 9, 30])}</p>" for _ in range(rng.randint(0, 12)))
        assert html_text.main_text(html) == windows_by_loop(html)


def test_long_numbers_are_no_address():
    text = "9" * 10_000 + ".1.1.1 and 000000000255.1.1.1 and 256.1.1.1"
    assert personal_data.base_spans(text) == [(text.index("000"), 1, text.index("000") + 18)]


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def test_base_spans_against_the_patterns():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["1", "23", "4", "0", ".", "@", "-", " ", "+", "(", ")", "a", "b.c", "x@y", "4111 1111 1111 1111", "10.0.0.1", "+49 30 123456", "é", "%"]) for _ in range(rng.randint(1, 25)))
        want = []
        for k, (kind, pattern) in enumerate(BASE.items()):
            for m in pattern.finditer(text):
                digits = [int(c) for c in m[0] if c.isascii() and c.isdigit()]
                luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
                if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                    want.append((m.start(), k, m.end()))
        assert personal_data.base_spans(text) == sorted(want), text


def test_stretches_take_whole_words():
    text = "a " + "é" * 60 + "@" + "ü" * 70 + ".org b 7"
    assert personal_data.stretches(text)[0][0] <= 2 and personal_data.stretches(text)[-1][1] == len(text)
    assert personal_data.stretches("1x" * 100_000) == [(0, 200_000)]


def test_columns_of_any_name(spark):
    rows = spark.createDataFrame([(i, "same\nown " + str(i), "h", 1, 2, 3, 4) for i in range(4)], "doc_id long, text string, source string, line_host int, line_keys int, line_kept int, gone int")
    kept = line_dedup.drop_boilerplate(rows)
    assert kept.columns == [*rows.columns, "line_dedup"] and {r.text for r in kept.collect()} == {f"own {i}" for i in range(4)}
    assert without(rows, rows.filter("doc_id < 3").select("doc_id")).count() == 1


def test_a_long_chain_is_one_component(spark, monkeypatch):
    from studylake.llm import components as module

    stored = []
    monkeypatch.setattr(module, "store", lambda df, keep=module.store: stored.append(1) or keep(df))
    links = spark.range(5000).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(9001, 9000), (9001, 9002), (9003, 9002), (7, 7)], "a long, b long"))
    rows = components(links).collect()
    assert len(rows) == 5005 and {(r.root, r.node >= 9000) for r in rows} == {(0, False), (9000, True)}
    assert len(stored) < 30
