import hashlib
import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandline.llm import bpe_prefix as b


@pytest.fixture(scope="module")
def coder():
    return b.read_vocabulary(b.default_path())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(b.default_path())
    t.no_padding()
    t.no_truncation()
    return t


def same(coder, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    packed = coder.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == want, text
    assert coder.decode(packed) == library.decode(want, skip_special_tokens=False), text


@pytest.mark.parametrize("text", ["", "  ", "<|endoftext|> hi<|startoftext|>x", "don't I'LL we've'd", "ΑΣ ΣΑΣ Σ", "İstanbul ẞ ﬁ", "é café ́x", "\x1cab\x1fcd e", "日本語テキスト 12345 ½ ² ٣", "a" * 300, "​ x　y z", "!!!???###", "🙂👍🏽 👨‍👩‍👧", "<| <|endoftext|", "hello\r\n\tworld\x00z"])
def test_texts(coder, library, text):
    same(coder, library, text)


def test_random_words(coder, library):
    rng = random.Random(1)
    names = sorted(library.get_vocab())
    for _ in range(4000):
        if rng.random() < 0.5:
            text = "".join(rng.choice(names).replace("</w>", "") for _ in range(rng.randint(1, 5)))
        else:
            text = "".join(rng.choice("abcdeinorst" if rng.random() < 0.9 else "ab") for _ in range(rng.randint(1, 40)))
        same(coder, library, text)


def test_every_prefix_has_one_last_token(coder, library):
    word = "internationalizationists"
    for k in range(1, len(word)):
        fits = [t for t in range(len(coder.names)) if t in coder.size and coder.size[t] <= k]
        symbols = word[:k]
        ids = coder._word(symbols)
        ends = {i for e, i in coder.ends.iter(symbols) if e == k - 1}
        good = [i for i in ends if k == coder.size[i] or coder._fit(coder._word(symbols[: k - coder.size[i]])[-1], i)]
        assert good == [ids[-1]] and fits


def test_tables(spark, coder, library, odd_docs):
    out = b.decode(b.encode(odd_docs, coder), coder)
    assert out.columns == [*odd_docs.columns, "decoded"]
    by = {r["doc_id"]: r for r in b.digests(odd_docs, coder).collect() if r["doc_id"] is not None}
    for r in out.collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == want
        text = library.decode(want, skip_special_tokens=False)
        assert r["decoded"] == text
        if r["doc_id"] is not None:
            got = by[r["doc_id"]]
            assert (got["n_tokens"], got["ids_sha256"], got["decoded_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert b.digests(odd_docs, coder).count() == odd_docs.count() and b.digests(odd_docs.limit(0), coder).isEmpty()


def test_vocabularies_of_another_kind_are_refused():
    spec = json.loads(open(b.default_path(), encoding="utf-8").read())
    changes = [("normalizer", None), ("normalizer", {"type": "Sequence", "normalizers": [{"type": "NFC"}]}), ("model", spec["model"] | {"byte_fallback": True}), ("model", spec["model"] | {"end_of_word_suffix": None})]
    for key, value in changes:
        with pytest.raises(ValueError, match="another kind"):
            b.PrefixCoder(json.dumps(spec | {key: value}))


def test_many_texts_together(coder, library, monkeypatch):
    """Words of all lengths together, with so few states and places that all are forgotten and met again."""
    monkeypatch.setattr(b, "STATES", 40)
    monkeypatch.setattr(b, "PLACES", 6)
    monkeypatch.setattr(b, "CHUNKS", 50)
    monkeypatch.setattr(b, "REMEMBERED", 64)
    own = b.PrefixCoder(coder.content)
    rng = random.Random(2)
    names = [t.replace("</w>", "") for t in sorted(library.get_vocab())]
    word = lambda: "".join(rng.choice(names) if rng.random() < 0.3 else rng.choice(["é", "a", "st", "ing", "ß", "'s", "7", ",", "日本", "Σ", "x" * 70]) for _ in range(rng.randint(1, 6)))
    texts = [None, "", *(" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)), "<|endoftext|>a b<|startoftext|>"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(p, "<u4").tolist() for p in own.encode_many(texts)] == want
