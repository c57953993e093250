"""BPE through the table of distinct words against the tokenizers library."""

import random
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest

from sigmill.llm import word_table as W
from sigmill.llm.textops import texts_of

from . import helpers as H

SPECIAL = "<|endoftext|>"
ALPHABET = list("abAB zZ  19.,'’!-\n\n\t\r  \x0b\x0c\x1c\x1f\x85\x00\x7f") + ["é", "ß", "×", "÷", "ñ", " ", "　", " ", " ", "᠎", "世", "Ω", "я", "😀", "é", "½", "²", "'s", "'ll", "'re", " 't", "don't", SPECIAL, "<|", "|>", " "]


def odd_texts(n=1500, seed=4):
    rng = random.Random(seed)
    return ["", None, " ", "  ", "\n", " \n ", SPECIAL, f"a  {SPECIAL}  b", f" {SPECIAL}", f"x{SPECIAL}{SPECIAL} y", f"{SPECIAL[:6]} {SPECIAL[6:]}", *("".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 40))) for _ in range(n))]


@pytest.fixture(scope="module")
def library():
    return W.tokenizer()


def test_words_encode_like_the_text(library):
    texts = odd_texts(6000, 9)
    raw, offsets = texts_of(pa.array(texts, pa.string()))
    starts = W.word_starts(raw, offsets, W.special_tokens(library))
    ends = [*starts[1:].tolist(), len(raw)]
    ids = [e.ids for e in library.encode_batch([raw[a:z].tobytes().decode() for a, z in zip(starts, ends)], add_special_tokens=False)]
    of = np.searchsorted(offsets, starts, side="right") - 1
    got = [[] for _ in texts]
    for r, x in zip(of.tolist(), ids):
        got[r] += x
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [(t, g) for t, g, w in zip(texts, got, want) if g != w] == []
    assert len(starts) > 3 * len(texts)


@pytest.mark.parametrize("most", [W.BLOCK_BYTES, 500])
def test_round_trip(spark, library, most):
    texts = odd_texts() + [t for t in H.texts()] + ["x" * 3_000_000, "word " * 400_000]
    data = [(i if i % 13 else None, t, "en", "a", None, 1, 0.5, 1, "k", 7) for i, t in enumerate(texts)] * 2
    docs = H.frame(spark, data).repartition(3)
    rows = (W.encode if most == 500 else W.round_trip)(docs, most=most).collect()
    got = sorted(((r.doc_id, tuple(r.ids)) for r in rows), key=repr)
    want = sorted(((d, tuple(library.encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in data), key=repr)
    assert got == want
    if most == 500:
        return
    told = sorted((tuple(r) for r in W.digests(docs).collect()), key=repr)
    sha = lambda s: sha256(s.encode()).hexdigest()
    assert told == sorted(((d, len(x), sha(",".join(map(str, x))), sha(library.decode(list(x), skip_special_tokens=False))) for d, x in want), key=repr)


def test_any_ids_decode(spark, library):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(library.get_vocab_size()) for _ in range(rng.choice([0, 1, 7, 300]))]) for i in range(200)] + [(None, None)]
    got = {r.doc_id: r.text for r in W.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(2)).collect()}
    assert got == {d: library.decode(x or [], skip_special_tokens=False) for d, x in rows}


def test_each_word_is_encoded_once(spark):
    docs = H.frame(spark, [(i, "the same words in the same order", "en", "a", None, 1, 0.5, 1, "k", 7) for i in range(400)])
    blocks = W.split(docs.repartition(5), most=64)
    assert blocks.count() > 100
    deals = {}
    for r in blocks.selectExpr("explode(cells) as c").select("c.*").collect():
        raw, at = W.joined_words([(r.lengths, r.words)])
        for a, z in zip(at, at[1:]):
            deals.setdefault(raw[a:z].tobytes(), set()).add(r.deal)
    assert len(deals) == 6 and all(len(d) == 1 for d in deals.values())


def test_empty_table(spark):
    assert W.digests(H.frame(spark, [])).count() == 0
