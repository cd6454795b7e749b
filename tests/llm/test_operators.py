"""Operators on small tables: against plain Python, and with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from studylake.llm import decontaminate, html_text, line_dedup, ngram_join, personal_data, quality, sentence_pieces, token_files, url_filter, vector_search

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, source string, n long, stack string"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(["an", "ble", "th", "er", "ou", "ti"]) + rng.choice(["sh", "nd", "re", "ly"]) + str(rng.randint(0, 30)) for _ in range(n))


def edited(text: str, every: int) -> str:
    words = text.split(" ")
    words[::every] = ["x" + w for w in words[::every]]
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    a, b = prose(1, 200), prose(2, 90)
    return [
        (1, a), (2, a), (2, a), (3, edited(a, 90)), (4, edited(a, 40)), (5, edited(a, 15)), (6, b), (7, b.upper() + "  \n"), (8, None), (9, ""), (10, " \t\n"),
        (11, "two words"), (12, "Two\twords"), (13, prose(3, 30_000)), (None, a), (14, "mail me.x@a-b.example.org, 4111 1111 1111 1111 or +49 (30) 123-4567 8 at 1.2.3.4"), (15, "é  x\x00y ▁ z\r\n"),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s" if i else None, 1, "extra") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_join_components(docs, texts, empty):
    sets = {i: shingles(t) for i, t in texts if i}
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    rows = ngram_join.link_components(docs).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id} == {i: (len(sets[i]), root[i]) for i in sets}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert ngram_join.link_components(empty).count() == 0
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted([0] + [i for i in sets if root[i] == i])


def test_join_of_many_near_copies(spark):
    """A chain and a crowd of near copies, by brute force over all pairs."""
    base = prose(5, 150).split(" ")
    rng, rows = random.Random(7), []
    for i in range(150):
        words = base[:]
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 40)}"
        rows.append((i + 1, " ".join(words[: rng.choice([110, 130, 150])])))
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if root[i] != root[j]:
                root[i] = root[j] = min(root[i], root[j])
                changed = True
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root


def test_join_of_crowd_below_the_threshold(spark, monkeypatch):
    """Texts that all share most of one unseen text, few of them linked: nearly all pairs are told apart without a comparison."""
    rng, rows = random.Random(11), []
    for c in range(3):
        base = prose(60 + c, 500).split(" ")
        for i in range(60):
            words = base[:]
            for at in rng.sample(range(len(words)), 17):
                words[at] = f"w{rng.randint(0, 10**6)}"
            rows.append((len(rows) + 1, " ".join(words)))
            if i % 10 == 0:  # a partner, linked through the edits that both have
                words[rng.randrange(len(words))] = "other"
                words[rng.randrange(len(words))] = "another"
                rows.append((len(rows) + 1, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    jaccard = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i < j}
    assert sum(0.5 < x < 0.8 for x in jaccard.values()) > 5000
    root = {i: i for i in sets}
    for (i, j), x in sorted(jaccard.items()):
        if x >= 0.8:
            root = {k: min(root[i], root[j]) if r in (root[i], root[j]) else r for k, r in root.items()}
    compared, verified = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: (compared.append(pairs.count()), verified(pairs, *rest))[1])
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root
    assert sum(compared) < 12 * len(rows)


def test_decontamination(spark, docs, empty):
    long = prose(3, 30_000).split(" ")
    items = [(1, " ".join(long[29_000:29_020])), (2, edited(" ".join(long[100:130]), 7)), (3, "two words"), (4, None), (5, ""), (6, prose(2, 90)), (7, prose(2, 90)), (None, prose(9, 20))]
    items = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_found) for r in decontaminate.contained_items(docs, items).collect()}
    assert got == {(13, 1, 16, 16), *((d, i, 86, 86) for d in (6, 7) for i in (6, 7))}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in decontaminate.without_items(docs, items).collect()} == {6, 7, 13}
    assert decontaminate.contained_items(empty, items).count() == 0
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0


def test_sentence_pieces(docs, texts, empty):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t in texts:
        ids = sp.encode(t or "") + [sp.eos_id()]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in sentence_pieces.digests(docs.select("doc_id", "text"), PIECES).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sentence_pieces.digests(empty, PIECES).count() == 0


def test_token_files(docs, texts, empty):
    from tokenizers import Tokenizer

    tk, at, want = Tokenizer.from_file(BYTES), 0, []
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    files = token_files.write(docs, BYTES, shard_bytes=2000, bucket_keys=4)
    got = [tuple(r) for r in token_files.read_back(files, docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r.doc_id for r in token_files.find(files, docs.select((F.col("doc_id") + 5).alias("doc_id"))).collect()} == set(range(6, 16))
    assert token_files.read_back(token_files.write(empty, BYTES), empty).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(10**15), 10**15, 5000))
    sizes, bits, slots = token_files.build_levels(keys)
    assert sorted(slots) == list(range(len(keys))) and (token_files.find_slots(keys, sizes, bits) == slots).all()


def test_personal_data(spark, docs, empty):
    rows = {r.doc_id: r for r in personal_data.find(docs).collect()}
    base = "email:5:25,card:27:46,phone:50:69,ip:73:80"
    r = rows[14]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == base
    assert all(rows[i].spans == "" for i in (8, 9, 10))
    assert personal_data.find(empty).count() == 0


def test_model_learns_spans():
    rng = random.Random(2)
    texts = [f"{prose(i, 4)} {rng.choice(['jo', 'an', 'el'])}{i}@mail{i % 7}.example.com {prose(i + 999, 4)}" for i in range(300)]
    part = [(t[20:84], personal_data.base_spans(t)) for t in texts]
    chars = np.array([np.pad(personal_data.classes(p), (0, 64 - len(p)), constant_values=personal_data.PAD) for p, _ in part])
    tags = np.array([np.pad(personal_data.tags_of(s, 20, len(p)), (0, 64 - len(p))) for p, s in part])
    w = personal_data.train(chars[:250], tags[:250], 120)
    found = np.concatenate(personal_data.decoded(w, [p for p, _ in part[250:]]))
    gold = np.concatenate([personal_data.tags_of(s, 20, len(p)) for p, s in part[250:]])
    assert (found == gold).mean() > 0.95


def test_gradient():
    rng = np.random.default_rng(0)
    s, y, step = rng.normal(size=(2, 5, personal_data.TAGS)), rng.integers(personal_data.TAGS, size=(2, 5)), rng.normal(size=(personal_data.TAGS + 1, personal_data.TAGS))
    _, ds, dstep = personal_data.crf_gradient(s, y, step)
    for array, gradient, at in ((s, ds, (1, 3, 2)), (step, dstep, (1, 4)), (step, dstep, (-1, 2))):
        array[at] += 1e-5
        up = personal_data.crf_gradient(s, y, step)[0]
        array[at] -= 2e-5
        down = personal_data.crf_gradient(s, y, step)[0]
        array[at] += 1e-5
        assert abs((up - down) / 2e-5 - gradient[at]) < 1e-5


def test_line_dedup(spark, empty):
    rows = [(i, f"menu \nown line {i}\n\nmenu", "a" if i < 20 else None, 1, "x") for i in range(40)] + [(50, None, "a", 1, "x"), (51, "menu\nshort site", "b", 1, "x"), (52, "", "a", 1, "x"), (53, "menu", "a", 1, "x")]
    out = line_dedup.drop_boilerplate(spark.createDataFrame(rows, DOCS))
    got = {r.doc_id: (r.text, r.line_dedup.n_lines, r.line_dedup.n_dropped) for r in out.collect()}
    assert got[3] == ("own line 3\n", 4, 2) and got[30] == ("own line 30\n", 4, 2)
    assert got[50] == (None, 0, 0) and got[51] == ("menu\nshort site", 2, 0) and got[52] == ("", 1, 0) and got[53] == ("", 1, 1)
    assert line_dedup.drop_boilerplate(empty).count() == 0


def test_line_dedup_of_small_hosts(spark):
    """The ratio decides at any number of pages; only a line of a single page is never boilerplate."""
    rows = [(i, f"own {i}" + "\nshared" * (i < 3), "nine", 1, "x") for i in range(9)] + [(20 + i, f"own {i}" + "\nshared" * (i < 4), "fifty", 1, "x") for i in range(50)] + [(90, "shared", "one", 1, "x")]
    got = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i] for i in range(9)] == [f"own {i}" for i in range(9)]
    assert got[20] == "own 0\nshared" and got[90] == "shared"  # 4 of 50 is not over 0.08


def test_url_filter(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("a.com", "/x", "block"), ("a.com", "/xy/", "allow"), ("a.com", "/x", "allow"), ("w.a.com", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    urls = ["http://A.com/x?q", "https://b.a.com/xy/z#f", "http://w.a.com/xy/", "http://com", "com/x", None, "x://a.com#/x", "http://ba.com/x", "http://w.a.com/", "http://A.com/x?q"]
    want = [("a.com", "/x", "a.com/x", "block"), ("b.a.com", "/xy/z", "a.com/xy/", "allow"), ("w.a.com", "/xy/", "a.com/xy/", "allow"), ("com", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
            ("a.com", "", None, "allow"), ("ba.com", "/x", "com/", "allow"), ("w.a.com", "/", "w.a.com/", "block"), ("a.com", "/x", "a.com/x", "block")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for block_rows in (1, 1024):
        got = {r.page_id: tuple(r)[1:] for r in url_filter.url_verdicts(pages, rules, block_rows=block_rows).collect()}
        assert got == dict(enumerate(want))
    assert {r.verdict for r in url_filter.url_verdicts(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.url_verdicts(pages.limit(0), rules).count() == 0


def test_html_text(spark):
    page = """<html><head><title>T</title><script>var t="</p>"</script></head><body><nav><a href=x>Menu</a></nav><div class="ad">Buy now</div><article><h1>Head
    line</h1><p><b>One &amp; two.<br><aside>Side</aside><p>Three&nbsp;four</p><ul><li>a</li><li>b</li></ul><div id="comments"><p>me too</p></div></article><footer>&copy; x</footer></body></html>"""
    plain = "<body><div class=menu>a b c</div><div>" + "long text here " * 20 + "</div><p>short</p></body>"
    rows = [(1, page), (2, None), (3, ""), (4, plain), (5, "<article><p>x</p></article>"), (6, "<p>x")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1] == "Head line\nOne & two.\nThree four\na\nb"
    assert got[2] == got[3] == "" and got[5] == got[6] == "x"
    assert got[4].startswith("long text") and "a b c" not in got[4]


@pytest.mark.parametrize(
    "page, want",
    [
        # An article only adds weight: text outside is judged by its own windows.
        ("<article><p>Teaser.</p></article><div><p>LONG</p><p>LONG</p></div>", "LONG\nLONG"),
        ("<div><p>LONG</p></div><section id=comments><article class=comment><p>LONG reply</p></article><article><p>LONG reply</p></article></section>", "LONG"),
        ("<div><p>LONG</p></div><article class='comment odd'><p>LONG reply</p></article>", "LONG"),
        ("<article><p>LONG</p><article class=comment-body><p>LONG reply</p></article><p>LONG end</p></article>", "LONG\nLONG end"),
        ("<article><p>LONG</p><ul>" + "<li><a href=x>LONG link</a>" * 9 + "</ul></article>", "LONG\nLONG link\nLONG link"),
        # A form that is the page stays; one beside the text does not.
        ("<form action=x><div class=menu>Home</div><p>LONG</p><p>LONG</p></form><footer>end</footer>", "LONG\nLONG"),
        ("<p>LONG and LONG</p><form><p>LONG</p></form>", "LONG and LONG"),
        # A dropped element ends with its parent, or where HTML implies it.
        ("<div><div class=ad>Buy</div><div><span class=share>Share</div><p>LONG</p></div>", "LONG"),
        ("<ul><li class=menu>Home<li>LONG</ul>", "LONG"),
        ("<p class=promo>Buy<p>LONG", "LONG"),
        ("<div><div class=ad>Buy<p>now</div></div><p>LONG</p>", "LONG"),
        ("<section><aside>LONG aside</section><p>LONG</p>", "LONG"),
        ("<head><title>T<body><p>LONG", "LONG"),
        ("<div class=header><nav>x</nav><article><p>LONG</p></article>", "LONG"),
        ("<div class='page sidebar-right'><main><p>LONG</p></main><p>LONG side</p></div>", "LONG\nLONG side"),
        ("<div class=banner><article><p>LONG</p></article></div><p>end</p>", "LONG"),
    ],
)
def test_html_text_of_other_layouts(page, want):
    long = "words of the main text " * 5
    assert html_text.main_text(page.replace("LONG", long)) == want.replace("LONG", long.strip())


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 64)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (701, [0.0] * 64), (702, [float("nan")] * 64), (703, [1.0]), (None, x[0].tolist()), (5, x[5].tolist()), (704, [None] * 64)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in vector_search.nearest(table, table.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    found = 0
    for q, rows in got.items():
        s = (x.astype(float) * x[q].astype(float)).sum(1)
        best = [i for i in np.lexsort((np.arange(600), -s)) if i != q][:20]
        assert [r[0] for r in sorted(rows)] == list(range(1, 21)) and all(abs(s[i] - score) < 1e-9 for _, i, score in rows)
        found += len(set(best) & {i for _, i, _ in rows})
    assert found >= 0.9 * 20 * len(got)
    assert [i for _, i, _ in sorted(got[100])] == list(range(101, 121))
    few = table.filter("vec_id < 5")
    assert vector_search.nearest(few, few.filter("vec_id = 0")).count() == 4
    assert vector_search.nearest(table.limit(0), table).count() == 0


def test_index_is_probed():
    """All codes within the radius, from the probed values alone where the ball is smaller than the index."""
    rng = np.random.default_rng(3)
    code = rng.integers(1 << 63, size=3000, dtype=np.uint64)
    code[:50] = code[0] ^ (np.uint64(1) << rng.integers(64, size=50, dtype=np.uint64))
    multi = vector_search.MultiIndex(code, 4)
    for radius in (0, 3, 9, 22, 40, 64):
        for i in (0, 7, 999):
            assert (multi.within(code[i : i + 1], radius) == np.flatnonzero(np.bitwise_count(code ^ code[i]) <= radius)).all()
    assert len(multi.probes(0, multi.pieces[0, 0], 1)) == 17 and multi.probes(0, multi.pieces[0, 0], 9) is None


def test_quality(spark, docs, empty):
    rows = [(i, " ".join(["junk"] * 80) if i % 3 == 0 else prose(i, 80)) for i in range(300)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(many, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(held) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(300))
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert quality.keep_good(many, labels).count() >= 190
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score(docs, labels).count() == docs.count() and quality.score(empty, labels).count() == 0


def test_isotonic():
    got = quality.isotonic(np.array([2, 0, 2, 2]), np.array([0, 0, 2, 1]))
    assert (np.diff(got) >= 0).all() and got[0] == 0 and got[3] == 0.75
