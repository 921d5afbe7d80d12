import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tessera.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(open(PATH, "rb").read())
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def agree(both, texts):
    codes = both[0].encode(texts)
    assert [np.frombuffer(c, "<u4").tolist() for c in codes] == [both[1].encode_ordinary(t) for t in texts]
    assert [both[0].decode(c).decode() for c in codes] == texts


def test_every_code_point_splits_and_merges_as_in_the_library(both):
    agree(both, ["a" + c + "b 1" + c + "2 " + c + " " + c + c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000])


def test_random_texts(both):
    rng = random.Random(3)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'s", "'LL", "é", "1", "22", "...", " ", "日本", "\U0001f600", "###", "\r\n", "é"]
    agree(both, ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(3000)])


@pytest.mark.parametrize("n", [511, 512, 513, 20_001])
def test_long_pieces(both, n):
    agree(both, ["a" * n, "".join(random.Random(n).choices("ABCDabcd", k=n))])


def test_forgetting_pieces_changes_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 3)
    agree(both, ["one two three four", "five six seven", "one two"])


def test_rows(spark, odd, none, both):
    run = lambda d: bpe.encode_rows(d, PATH, public_tokenizers.PATTERN, ["doc_id"], with_ids=True)
    got = sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(odd).collect())
    wanted = []
    for r in odd.collect():
        ids = both[1].encode_ordinary(r.text or "")
        wanted.append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(wanted)
    assert run(none).count() == 0
