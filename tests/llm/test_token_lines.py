"""New words go to the tokenizer library many at a time, with the ids that each text has by itself."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from studylake.llm.token_files import LINES, Encoder, id_width  # noqa: E402

FILE = public_tokenizers.path("byte_bpe_50k.json")


class Counted:
    def __init__(self, library):
        self.library, self.given = library, 0

    def encode_batch_fast(self, texts, **kw):
        self.given += len(texts)
        return self.library.encode_batch_fast(texts, **kw)


def whole(encoder, text):
    width = encoder.width
    return b"".join(i.to_bytes(width, "little") for i in encoder.library.encode(text or "", add_special_tokens=False).ids)


def test_words_are_encoded_by_the_line():
    e = Encoder(FILE, id_width(FILE))
    text = " ".join(f"w{'ab'[i % 2]}{i * 7919 % 10007}x" for i in range(3000))
    expected = whole(e, text)
    e.library = Counted(e.library)
    assert e.encode([text]) == [expected]
    assert e.library.given <= 3000 / LINES + 2


def test_odd_texts_have_the_ids_of_the_library():
    e = Encoder(FILE, id_width(FILE))
    texts = [None, "", " ", "\n", "\n\n", "a\nb", "\na", "a\n", "a.\nb", "don't 's 'll 1's", "a  b", " a b ", "a\tb", "x\x00y z", "é ß, 日本語。 ok", "a b c", "1. 2, 3.\n4", "Ċ Ċ \u000b q", "\r\nq r", "a\n b", "end. ", "w " * 1000, "'\n's"]
    assert e.encode(texts) == [whole(e, t) for t in texts]
    assert e.encode(texts[::-1]) == [whole(e, t) for t in texts[::-1]]
    e.feed = None
    e.table.new, e.table.old = {}, {}
    assert e.encode(texts) == [whole(e, t) for t in texts]
