"""The rebuilt tokenizers against the reference library, on model files written field by field."""

import struct

import numpy as np
import pytest
import sentencepiece

from quern.llm import sentence_pieces as sp

TEXTS = ["", " ", "  ", "the cat", " the  cat sat ", "▁the", "thethe cats\nat the mat", "ünï ☃ c\U0001f600at", "a" * 3000, "tail ", "x▁ y", "Aa Bb the  "]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


def model_file(kind, pieces, squeeze, prefix=1):
    rows = [("<unk>", 0.0, sp.UNKNOWN), ("<s>", 0.0, sp.CONTROL), ("</s>", 0.0, sp.CONTROL), *((f"<0x{k:02X}>", 0.0, sp.BYTE) for k in range(256)), *((p, s, sp.NORMAL) for p, s in pieces)]
    body = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + field(3, t)) for p, s, t in rows)
    return body + field(2, field(3, kind) + field(35, 1)) + field(3, field(1, b"identity") + field(3, prefix) + field(4, squeeze) + field(5, 1))


LETTERS = [(c, -8.0 - k / 10) for k, c in enumerate("▁abcehmnost")]
WORDS = [("▁the", -2.0), ("th", -4.0), ("he", -4.1), ("▁c", -4.5), ("at", -3.0), ("▁cat", -3.1), ("cats", -3.2), ("▁▁", -5.0), ("▁t", -4.7), ("sat", -3.9), ("ats", -4.4)]


@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("extra", [[], [("the▁cat", -1.0)]])
def test_unigram_models(squeeze, extra):
    """With a piece over a word's end texts are not cut into words."""
    data = model_file(sp.UNIGRAM, LETTERS + WORDS + extra, squeeze)
    assert sp.parse_model(data).kind == sp.UNIGRAM and sp.cuts_at_markers(sp.parse_model(data)) == (not extra)
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = [t for t in TEXTS if not squeeze or t.strip(" ▁") or not t]
    ids, same = sp.encode_texts(data, texts)
    assert [x.tolist() for x in ids] == reference.encode(texts) and all(same)


def test_words_are_remembered_within_bounds(monkeypatch):
    monkeypatch.setattr(sp, "MOST_WORDS", 3)
    with open(sp.MODEL, "rb") as f:
        data = f.read()
    reference = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    for _ in range(3):
        ids, same = sp.encode_texts(data, TEXTS)
        assert [x.tolist() for x in ids] == reference.encode(TEXTS) and all(same)


def test_a_difference_is_reported():
    """Ids stay those of the rebuilt tokenizer, and parity says that they differ."""
    with open(sp.MODEL, "rb") as f:
        data = f.read()
    words = sp.Words(sp.parse_model(data), sp._loaded(data).words.encoder, sentencepiece.SentencePieceProcessor(model_proto=model_file(sp.BPE, LETTERS + [("▁t", -1.0)], 0)))
    at = words.places_of(["▁the", "▁the", "▁q"])
    assert at.tolist() == [0, 0, 1] and not words.same[0] and np.array_equal(words.flat[: words.sizes[0]], sentencepiece.SentencePieceProcessor(model_file=sp.MODEL).encode("the"))


def test_words_that_come_back_are_decoded_once():
    """Texts of known words need no decoding of their own; what is said of each text is what decoding it says."""
    with open(sp.MODEL, "rb") as f:
        data = f.read()
    texts = [*TEXTS, "plain words here", "plain words here again", " two  blanks ", "", "▁marker", "emoji 😀 \x00 é", "a\nb"]
    for _ in range(2):
        ids, _, known = sp.checked_texts(data, texts)
        back = sp.decode_ids(data, [x.tolist() for x in ids])
        assert all(b == t.replace(sp.SPACE, " ") for b, t, k in zip(back, texts, known, strict=True) if k)
    assert sp.checked_texts(data, ["plain words here", "here plain words"])[2] == [True, True]
