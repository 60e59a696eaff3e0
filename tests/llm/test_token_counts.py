import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import token_counts as tc

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    return tc.Transducer(PATH), Tokenizer.from_file(PATH)


def same(pair, texts):
    want = [len(e.ids) for e in pair[1].encode_batch(texts, add_special_tokens=False)]
    assert pair[0].count_all(texts).tolist() == want


def test_fixed_cases(pair):
    same(pair, ["", " ", "  ", " a", "a ", "\n", "\n\n a", "日本語", "don't I'll we're 're 's''s \"'s'", "a" * 5000, "\t\t x \r\n y", "<|endoftext|>a <|endoftext|>", "x" * 700 + " " * 900 + "y", "Ab1'd" * 100, "  　x  ", "\x1c\x1d a"])


def test_random(pair):
    rng = random.Random(7)
    letters = " abcdefghinorste  .,-\n\té😀日0123456789'sdtmrevl!?  À<|endoftext|>"
    same(pair, ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(1500)])


def test_pieces_and_resets(pair, monkeypatch):
    monkeypatch.setattr(tc, "PIECE", 50)
    monkeypatch.setattr(tc, "CHUNK", 8)
    rng = random.Random(8)
    words = ["alpha", "be", "x" * 30, "été", "1234567", "...", "a\n\nb"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(200))) for _ in range(40)]
    same(pair, texts)
    small = tc.Transducer(PATH, most=10)
    assert small.count_all(texts).tolist() == pair[0].count_all(texts).tolist()


def test_query(spark, odd, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    got = tc.count_tokens(odd, PATH)
    text = dict.fromkeys(())
    rows = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect())
    want = []
    for r in odd.select("doc_id", "text").collect():
        t = r["text"] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        want.append((str(r["doc_id"]), len(t.encode()), n, n > 512))
    assert rows == sorted(want) and not text
    assert tc.count_tokens(none, PATH).count() == 0
    assert none.select(F.col("text")).count() == 0
