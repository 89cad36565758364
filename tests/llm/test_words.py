"""Words of texts as distinct words and places, and what works on them."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import pre_tokenizers

from tidewater.llm import maxent, tokens
from tidewater.llm.common import tokenizer_path

TEXTS = [b" A  b\x0b\x1cc\t", b"", b"   ", None, b"x " * 1000, b"a \xc2\x85 B", b"\xc3\x89d \xc3\xa9\xe2\x80\xa8z"]


@pytest.mark.parametrize("kind", [pa.string(), pa.binary(), pa.large_string()])
def test_op8_works_by_distinct_words(kind):
    words, index, lengths, start = maxent._flat(pa.array(TEXTS, pa.binary()).cast(kind))
    want = [maxent.tokens(x) for x in TEXTS]
    assert [words[i] for i in index] == [y for x in want for y in x]
    assert len(words) == len({y for x in want for y in x})
    assert lengths.tolist() == [len(x) for x in want]
    assert start.tolist() == [sum(map(len, want[:k])) for k, x in enumerate(want) for _ in x]


@pytest.mark.parametrize(("n", "span"), [(1, 3), (500, 3), (500, 40), (500, 60_000)])
def test_op8_sums_rows_together(n, span):
    """Rows with more tokens than TOGETHER, and with fewer; the most used come first."""
    rng = np.random.default_rng(3)
    rows, error = rng.integers(0, span, (n, 4)), rng.normal(size=(n, 6)).astype(np.float32)
    used, times, grad = maxent._row_sums(rows, error)
    whole = np.zeros((span, 6))
    np.add.at(whole, rows.ravel(), np.repeat(error, 4, 0))
    assert (np.diff(times) <= 0).all() and sorted(used.tolist()) == np.unique(rows).tolist()
    assert (times == np.bincount(rows.ravel(), minlength=span)[used]).all()
    assert np.allclose(grad, whole[used], atol=1e-4)


@pytest.fixture
def small_model():
    """A model of 60 words, most of them in the head, and tokens of four copied texts and some of any words."""
    rng = np.random.default_rng(5)
    listed = [*((b"w%d" % i, 200 - i) for i in range(50)), (maxent.END, 20), *((b"v%d" % i, 9) for i in range(9))]
    model = maxent.Classes(listed, 51, rng.integers(0, 9, (51, maxent.CONTEXTS)).astype(float))
    text = model.id_of[model.codes([b"w%d" % i for i in rng.permutation(50)] + [b"v3", b"new", maxent.END])]
    ids = np.concatenate([*[text] * 4, rng.integers(0, model.n_head + maxent.CLUSTERS, 300)])
    start = np.concatenate([np.repeat(np.arange(4) * len(text), len(text)), np.full(300, 4 * len(text))])
    bias = rng.normal(size=model.n).astype(np.float32)
    return model, bias, ids, start, len(np.unique(np.stack([ids, *maxent._past(ids, start)]), axis=1).T)


def apart(past, classes, places):
    return classes.astype(np.int64) << 30 | np.arange(len(classes))


def test_op8_works_out_tokens_alike_once(small_model, monkeypatch):
    """Of one word after the same three words; with the weights, times and logarithms of each by itself."""
    model, bias, ids, start, distinct = small_model
    asked, logits = [], maxent._logits
    monkeypatch.setattr(maxent, "_logits", lambda w, b, rows: asked.append(len(rows)) or logits(w, b, rows))

    def run():
        outer, inner = maxent.Learner(np.zeros((1 << maxent.TABLE_BITS, model.n), np.float32)), maxent.Learner(np.zeros((1 << maxent.TABLE_BITS, 2 * maxent.SIDE), np.float32))
        for _ in range(3):
            maxent._learn(outer, inner, bias, model, ids, start)
        return outer, inner, maxent._logs(outer.w, inner.w, bias, model, ids, start)

    outer, inner, logs = run()
    assert asked == [distinct] * 4 and distinct < len(ids) - 140
    monkeypatch.setattr(maxent, "_keys", apart)
    for own, want in zip((outer, inner), run(), strict=False):
        assert (own.seen == want.seen).all() and own.seen.any() and np.allclose(own.w, want.w, atol=1e-4) and np.allclose(own.squares, want.squares, rtol=1e-3)
    assert np.allclose(logs, maxent._logs(outer.w, inner.w, bias, model, ids, start), atol=1e-5)


def test_op8_keys_of_too_many_words(small_model):
    model, _, ids, start, distinct = small_model
    past, classes, places = maxent._past(ids, start), model.class_of[ids], model.place_of[ids]
    for keys, n in ((maxent._keys(past, classes, places), distinct), (maxent._keys([x << 18 for x in past], classes, places), len(ids))):
        own, times, order = maxent._alike(keys)
        assert len(own) == n and times.sum() == len(ids) and sorted(order.tolist()) == list(range(len(ids)))
        assert (np.diff(classes[order]) >= 0).all()
        gridded = places[own] >= 0
        assert gridded[: gridded.sum()].all()
    assert [len(x) for x in maxent._alike(np.zeros(0, np.int64))] == [0, 0, 0]


@pytest.mark.parametrize(("words", "size"), [(10, 1 << 20), (1 << 20, 300), (1 << 20, 1 << 20)])
def test_op8_counts_words_in_parts(spark, monkeypatch, words, size):
    """Long words go on by their bytes, many words by their number; the sums are the same."""
    from collections import Counter

    monkeypatch.setattr(maxent, "COUNTED", words)
    monkeypatch.setattr(maxent, "COUNTED_BYTES", size)
    texts = [*(None if x is None else x.decode() for x in TEXTS), *(f"A{i % 7} b{i} {'z' * i}" for i in range(100))]
    docs = spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1)
    want = Counter(x for t in texts for x in maxent.tokens((t or "").encode()))
    assert {bytes(r.word): r.c for r in maxent._count(docs, "text").collect()} == want


def test_op8_keeps_short_words_only(small_model):
    model = small_model[0]
    before, long = len(model.known), b"q" * (maxent.WORD_BYTES + 1)
    first = model.codes([b"w1", long, b"short", b"v2"])
    assert first[[0, 3]].tolist() == [1, 53] and (first[1:3] >= model.n_listed).all()
    assert model.codes([b"short", b"v2", long, b"w1"]).tolist() == first[[2, 3, 1, 0]].tolist()
    assert len(model.known) == before + 1


def test_tokens_look_up_distinct_chunks_only():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return super().get(*key)

    encoder = tokens.Encoder(tokenizer_path())
    encoder.known = Counted()
    texts = [b"one two. " * 500, b"", b"  ", "Été çà naïve ßÿí­ \x85x".encode(), b"a <|x|> b", b"One\x0btwo\x1cthree\n", b"z" * 5000 + b" q|r"]
    found = encoder.encode(texts)
    assert Counted.asked < 30
    assert found == [b"".join(encoder._plain([x])) for x in texts]
    assert encoder.encode([]) == [] and encoder.encode([b""]) == [b""]


def test_tokens_of_small_letters_in_the_vocabularys_characters():
    words = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
    ((want, _),) = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(words)
    assert tokens._bytes_level(words.encode()) == want and tokens._bytes_level(b"a | b") == "a | b"


def test_tokens_encode_stems_and_marks_once(monkeypatch):
    encoder, asked, chunks = tokens.Encoder(tokenizer_path()), [], tokens.Encoder._chunks
    monkeypatch.setattr(tokens.Encoder, "_chunks", lambda self, own: asked.extend(own) or chunks(self, own))
    texts = ["Café, café! CAFé... one1) two's, ?! two's".encode()]
    want = encoder._plain(texts)
    assert encoder.encode(texts) == want and encoder.encode(texts * 2) == want * 2
    assert sorted(asked) == sorted(["café".encode(), b",", b"!", b"...", b"one1", b")", b"two's", b"?!"])
    assert encoder.encode(["naïve. Café? café!".encode()]) == encoder._plain(["naïve. Café? café!".encode()])
    assert sorted(asked[8:]) == sorted(["naïve".encode(), b".", b"?"])


def test_tokens_of_chunks_with_any_mark_and_letter():
    chars = [*map(chr, range(0x21, 0x7F)), *map(chr, range(0xA1, 0x180)), "\x1c", "\x85", "\u0301", "\u2003", "\u212b", "\u1e9e", "\u0130", "\u03a3", "\u4e2d", "\U0001f600"]
    texts = [f"x{a}{b} {a}{b} {a}e{b}{b} Y{a}s{b}'S" for a in chars for b in "!'|,.)_~<\u00e9\u00d7\u00c9a7"]
    texts = [x.encode() for x in texts]
    encoder = tokens.Encoder(tokenizer_path(), cache=2000)
    for at in range(0, len(texts), 300):
        own = texts[at : at + 300]
        assert encoder.encode(own) == encoder._plain(own)
