"""The whole pipeline on small tables, against plain Python."""

import hashlib
import random

import public_tokenizers
import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["an", "ble", "th", "er", "ou"]) + rng.choice(["sh", "nd", "re"]) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture
def folder(spark, tmp_path):
    def write(docs, items):
        path = str(tmp_path / "sf")
        spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        return path

    return write


def test_stages_take_effect(spark, folder):
    from sentencepiece import SentencePieceProcessor

    item, copy = prose(1, 30), prose(2, 120)
    texts = {i: f"{prose(100 + i, 80)}\n{prose(200 + i, 40)}" for i in range(1, 16)}
    texts |= {i: f"{t}\nSubscribe to our newsletter today" for i, t in texts.items() if i < 6}  # a line on 5 of 20 pages
    texts |= {16: copy, 17: copy, 18: f"{prose(300, 50)} {item} {prose(301, 50)}", 19: None, 20: ""}
    docs = [(i, t, "en", "host", len(t or "")) for i, t in texts.items()] + [(None, prose(5, 60), "en", None, 1)]
    rows = corpus_pipeline.run(spark, folder(docs, [(1, item), (2, None)])).collect()
    kept = {r.doc_id: r for r in rows}
    assert len(rows) == 19 and set(kept) == {None, *range(1, 17), 19, 20}  # 17 copies 16, 18 has the item
    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i in [*range(1, 17), 19, 20]:
        text = (texts[i] or "").removesuffix("\nSubscribe to our newsletter today")
        ids = [*sp.encode(text), sp.eos_id()]
        assert kept[i].n_tokens == len(ids) and kept[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), i


def test_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [])).count() == 0
