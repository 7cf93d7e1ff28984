import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from tidewatch.llm import bpe, token_files
from tidewatch.llm.remembered import BY_WORDS, Remembered

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PARTS = [" ", " ", " ", "a", "b", "é", "\n", "\t", "1", "'s", "'", ".", "\x1c", "\x85", "　", "\r\n", "日", "​", "\xa0", "\0", "x" * 70,
         "<|endoftext|>", "<|endoftext|", "the", "ing", "\U0001f600", "́"]


def texts_of(rng, most=12):
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(rng.randint(0, 6))]


@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, r"\w+|\W"])
def test_words_give_the_pieces_of_the_whole_text(pattern):
    number, rng, find = {}, random.Random(1), regex.compile(pattern).findall
    cut = Remembered(pattern, lambda pieces: [np.array([number.setdefault(p, len(number))], np.uint32).tobytes() for p in pieces], 100)
    for _ in range(3000):
        texts = texts_of(rng)
        got = cut.of_texts(texts)
        assert [np.frombuffer(ids, np.uint32).tolist() for ids in got] == [[number[p] for p in find(t)] for t in texts], texts
    assert public_tokenizers.PATTERN == BY_WORDS


def test_encoders_equal_their_libraries():
    library, rng = Tokenizer.from_file(JSON), random.Random(2)
    files, ranks = token_files.PieceEncoder(JSON, public_tokenizers.PATTERN, False), bpe.read_ranks(RANKS)
    own, other = bpe.Encoder(ranks, public_tokenizers.PATTERN, 300), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for _ in range(1000):
        texts = texts_of(rng)
        assert [ids.tolist() for ids in files.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts], texts
        assert [np.frombuffer(ids, np.int32).tolist() for ids in own.encode_batch(texts)] == [other.encode_ordinary(t) for t in texts], texts


def test_an_added_token_with_a_space_forms_between_no_words(tmp_path):
    from tokenizers import AddedToken
    raw = Tokenizer.from_file(JSON).to_str().replace('"<|endoftext|>"', '"<end of>"')
    (tmp_path / "own.json").write_text(raw, encoding="utf-8")
    library = Tokenizer.from_file(f"{tmp_path}/own.json")
    encoder = token_files.PieceEncoder(f"{tmp_path}/own.json", public_tokenizers.PATTERN, False)
    texts = [f"x {a} {b} y" for a in ("<end", "of>") for b in ("of>", "<end", "z")] + ["a<end of>b"]
    for _ in range(2):
        assert [ids.tolist() for ids in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert AddedToken("<end of>").content in encoder.added


@pytest.mark.parametrize("make", [lambda: token_files.PieceEncoder(JSON, public_tokenizers.PATTERN, False).encode,
                                  lambda: bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN).encode_batch])
def test_words_met_before_are_not_cut_again(make):
    encode = make()
    encoder, seen = encode.__self__, []
    first = [list(map(int, np.frombuffer(ids, np.int32))) for ids in encode(["so the quick, brown fox", "so"])]
    find = encoder.find
    encoder.find = lambda text: seen.append(text) or find(text)
    again = [list(map(int, np.frombuffer(ids, np.int32))) for ids in encode(["so brown the fox quick,", "so the quick, brown fox"])]
    assert again[1] == first[0] and sorted(again[0]) == sorted(first[0])
    assert sum(map(len, seen)) <= len("so") * 2
