import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veldmark.llm.bpe import END, Codec, digests, encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return Codec(f.read())


def texts():
    rng = random.Random(5)
    alphabet = ["a", "e", "th", "ing", "The", "é", "ß", "Σ", "ΑΣ ", "İ", " ", "\n", "'s", "'LL", "1", "½", "²", "$", "!!", "<|endoftext|>", "</w>", "<|", "日本", "😀", "\x1c", " ", "é", "ǅ", " ", "𝔘", "٣", "_"]
    yield from ("", " ", "Hello WORLD, it's fine.", "thntblere antititioning onshhe", "x" * 300, "<|startoftext|>a<|endoftext|>")
    for _ in range(3000):
        yield "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30)))


def test_same_as_library(codec):
    library = Tokenizer.from_file(PATH)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        mine = codec.encode(text)
        assert list(struct.unpack(f"<{len(mine) // 4}I", mine)) == ids, repr(text)
        assert codec.decode(mine) == library.decode(ids, skip_special_tokens=False)


def test_backtracking_is_plain_merging(codec):
    rng = random.Random(2)
    for _ in range(3000):
        word = "".join(rng.choice("abcdehinorstu") for _ in range(rng.randint(1, 40)))
        codec.learn([word])
        assert list(struct.unpack(f"<{len(codec.known[word]) // 4}I", codec.known[word])) == codec.plain(codec.form(word))


def test_query(spark, odd_docs):
    library = Tokenizer.from_file(PATH)
    want = []
    for r in odd_docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, digests(odd_docs, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert digests(odd_docs.limit(0), PATH).count() == 0


def test_compatible_pairs_are_those_that_merging_gives(codec):
    rng = random.Random(3)
    whole = [i for i, (s, _) in codec.split.items() if codec.prefix.get(i) is not None]
    form = {i: f for i in whole for f in [codec.text[i].removesuffix("</w>") + (END if codec.text[i].endswith("</w>") else "")]}
    inner = [i for i in whole if not form[i].endswith(END) and codec.plain(form[i]) == [i]]
    by_start = {}
    for i in whole:
        by_start.setdefault(form[i][0], []).append(i)
    seen = {True: 0, False: 0}
    for k in range(4000):
        left = rng.choice(inner)
        right = rng.choice(whole if k % 2 else by_start[form[left][-1]])
        if codec.plain(form[right]) == [right]:
            want = codec.plain(form[left] + form[right]) == [left, right]
            assert codec.compatible(left, right) == want, (form[left], form[right])
            seen[want] += 1
    assert min(seen.values()) > 100


def test_clashing_names_repeats_and_long_texts(spark):
    rows = [(1, "one two", 7, b"x", "own"), (1, "one two", 8, None, None), (2, "long words " * 120_000, 9, b"y", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids binary, decoded string")
    out = encode(docs, PATH, decode=True)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded", "n_tokens_", "ids_", "decoded_"]
    assert out.select("doc_id", "n_tokens", "ids", "decoded").schema.simpleString() == docs.drop("text").schema.simpleString()
    got = sorted(out.collect(), key=lambda r: r.n_tokens)
    assert [(r[0], r[1], r[2] and bytes(r[2]), r[3]) for r in got] == [(1, 7, b"x", "own"), (1, 8, None, None), (2, 9, b"y", "own")]
    library = Tokenizer.from_file(PATH)
    for r, (_, text, *_) in zip(got, rows, strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert r.n_tokens_ == len(ids) and bytes(r.ids_) == struct.pack(f"<{len(ids)}I", *ids) and r.decoded_ == library.decode(ids, skip_special_tokens=False)
