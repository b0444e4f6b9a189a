import hashlib
import random
import struct
import tracemalloc

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Encoder(PATH), Tokenizer.from_file(PATH)


def same(both, texts):
    ours, theirs = both
    theirs.no_truncation(), theirs.no_padding()
    for t, ids in zip(texts, ours.encode_batch(texts)):
        want = theirs.encode(t, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want, repr(t)
        assert ours.decode(ids) == theirs.decode(want, skip_special_tokens=False)


def test_every_character_alone_and_between_letters(both):
    codes = [c for c in [*range(0x20000), *range(0x2B700, 0x2D000), *range(0x323A0, 0x334A0, 16), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    texts = [t for c in codes for t in (chr(c), f"a{chr(c)}b")]
    ours, theirs = both
    bad = [t for t, ids, want in zip(texts, ours.encode_batch(texts), theirs.encode_batch(texts, add_special_tokens=False)) if list(struct.unpack(f"<{len(ids) // 4}I", ids)) != want.ids]
    assert not bad, [hex(ord(max(t))) for t in bad][:50]


def test_words_specials_and_long_words(both):
    same(both, ["", " ", "Hello, WORLD's 1234 they'll've!!", "a<|endoftext|>b <|startoftext|> c<|endoftext", "ΑΣ ΣΑΣ. İstanbul", "é ́x", "x" * 5000, "ab" * 700 + "tion" * 300, "\x1c\x1f\x85 a", "日本語のテキスト 🎉🎉"])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    same(both, [text, text.replace(" ", "")])


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abeinorst'h ", max_size=80))
def test_english_like_text(both, text):
    same(both, [text])


def test_query_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "To be, or not", 9), (3, "To be, or not", 9), (None, "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(bpe.digests(df, PATH).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 5 and [r.ids_sha256 for r in got if r.doc_id in (1, 2)] == [empty] * 2
    whole = {r.doc_id: r for r in bpe.encode(df, PATH).collect()}
    assert whole[3].decoded == "to</w> be</w> ,</w> or</w> not</w>"
    assert hashlib.sha256(struct.pack(f"<{len(whole[3].ids)}I", *whole[3].ids)).hexdigest() == next(r for r in got if r.doc_id == 3).ids_sha256
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_a_word_alone_merges_like_rows(both):
    import random

    ours, _ = both
    rng = random.Random(4)
    words = ["".join(rng.choice("abeinorsth'é1") for _ in range(n)).encode() for n in (1, 2, 3, 16, 17, 33, 64, 65, 500, 3000) for _ in range(3)]
    for w in words:
        depth = max(1, (len(w) - 1).bit_length())
        assert ours._merge_word(w, depth) == ours._merge_rows([w], depth)[0], w


def test_a_word_of_a_hundred_thousand_letters_in_seconds(both):
    import random
    import time

    rng = random.Random(7)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    start = time.time()
    ids = both[0].encode_batch([word])[0]
    assert time.time() - start < 30
    assert both[0].decode(ids).replace(" ", "").replace("</w>", "") == word


def test_known_words_are_not_normalised_again(both, monkeypatch):
    """Marks after white space and separators that aren't white space, as the library has them; a text of known words costs look-ups alone."""
    texts = ["É é É ́a Å\x1ca\x1fb\x85c d", "ΟΔΟΣ Σ ꟋᲉ Ωm K", "á̧ ́ ̧<|endoftext|>́x"]
    same(both, texts)
    calls, normal = [], bpe.unicodedata.normalize
    monkeypatch.setattr(bpe.unicodedata, "normalize", lambda form, text: calls.append(text) or normal(form, text))
    ours = bpe.Encoder(PATH)
    first = ours.encode_batch(texts)
    seen = len(calls)
    assert seen and ours.encode_batch(texts) == first and len(calls) == seen


def test_many_new_words_in_little_memory(both):
    """Each word is new: what is held beside the cache of words doesn't grow with the texts of a batch."""
    import pyarrow as pa

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 12))) for _ in range(3000)) for _ in range(60)]
    ours = bpe.Encoder(PATH)
    tracemalloc.start()
    try:
        for group in bpe._groups(pa.array(texts)):
            ours.encode_batch(group)
        held, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak - held < 40 << 20
