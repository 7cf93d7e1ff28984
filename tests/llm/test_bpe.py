import random

import numpy as np
import public_tokenizers
import tiktoken

from tests.llm.conftest import ODD
from tidewatch.llm.bpe import DONE, Encoder, StreamDecoder, Transducer, read_ranks, round_trip

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["a", "the", " ", "  ", "\n", "\r\n", "\x1c", " ", "é", "日本", "\U0001f600", "'s", "12", "#$%", "\t", "x" * 30, "tion", "\x85", "क्"]


def merged(ranks, piece):
    """Repeatedly merge the lowest-ranked pair, leftmost first."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        at = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        if min(at) == 1 << 60:
            break
        i = at.index(min(at))
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return tuple(ranks[p] for p in parts)


def test_equals_the_library():
    rng, encoder = random.Random(1), Encoder(RANKS, public_tokenizers.PATTERN)
    for k in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) if k % 2 else "".join(
            chr(rng.choice([rng.randint(1, 126), rng.randint(0, 0x2FFF)])) for _ in range(rng.randint(1, 20)))
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == LIBRARY.encode_ordinary(text), text


def test_small_vocabularies_against_plain_merging():
    # ambiguous merges over three letters, long pieces, and a state table that overflows
    rng = random.Random(2)
    for _ in range(30):
        ranks = {bytes([b]): b for b in range(256)}
        known = [b"a", b"b", b"c"]
        for rank in range(256, 256 + rng.randint(3, 25)):
            new = rng.choice(known) + rng.choice(known)
            if new not in ranks:
                ranks[new] = rank
                known.append(new)
        fst = Transducer(ranks)
        if any(fst.split(t) is None for t in ranks.values()):
            continue
        for _ in range(40):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 150)))
            if piece not in ranks:
                assert fst.encode(piece) == merged(ranks, piece)


def test_stream_holds_back_unfinished_characters():
    text = "aé日\U0001f600z" * 3
    raw = text.encode()
    for size in (1, 2, 3, 5):
        stream, got = StreamDecoder(lambda b: bytes([b])), b""
        for i in range(0, len(raw), size):
            piece = stream.feed(raw[i:i + size])
            piece.decode()  # ends at a character
            got += piece
        assert got + stream.close() == raw
    broken = StreamDecoder(lambda b: bytes([b]))
    assert broken.feed(b"\xff\x80a\xe6") == b"\xff\x80a" and broken.close() == b"\xe6" and DONE == 0


def test_round_trip_of_odd_rows(make_docs):
    rows = {r.doc_id: r for r in round_trip(make_docs(ODD), PATH, public_tokenizers.PATTERN).collect()}
    for i, text in ODD:
        assert rows[i].ids == LIBRARY.encode_ordinary(text or "")
        assert bytes(rows[i].decoded) == (text or "").encode()
    assert round_trip(make_docs([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_a_long_text_in_parts_equals_the_library(monkeypatch):
    from tidewatch.llm import bpe
    monkeypatch.setattr(bpe, "TEXT", 500)
    monkeypatch.setattr(bpe, "PART", 7)
    rng, encoder = random.Random(8), Encoder(RANKS, public_tokenizers.PATTERN)
    texts = ["".join(rng.choice(PARTS) for _ in range(n)) for n in (400, 3, 0, 500, 1, 2000)] + [None]
    got = encoder.encode_batch(texts)
    assert [np.frombuffer(ids, np.int32).tolist() for ids in got] == [LIBRARY.encode_ordinary(t or "") for t in texts]
    assert any(len(t or "") > 500 for t in texts)


def test_a_new_owner_gets_an_empty_store():
    from tidewatch.llm import common
    common.held_by("one")["x"] = 1
    common._power("p", common._P, 10)
    assert common.held_by("one") == {"x": 1}
    assert common.held_by("two") == {} and not common._powers
    assert common.held_by("one") == {}


def test_a_worker_s_tables_stay_small():
    import sys
    rng, encoder = random.Random(3), Encoder(RANKS, public_tokenizers.PATTERN, 1000)
    texts = [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 12))) for _ in range(500)) for _ in range(40)]
    got = [ids for i in range(0, 40, 5) for ids in encoder.encode_batch(texts[i:i + 5])]
    assert [np.frombuffer(ids, np.int32).tolist() for ids in got] == [LIBRARY.encode_ordinary(t) for t in texts]
    fst = encoder.fst
    long = "".join(rng.choice("etaoinshr") for _ in range(3000)).encode()
    assert list(fst.encode(long)) == LIBRARY.encode_ordinary(long.decode()) == list(fst.encode(long))
    # at most some 100 bytes a state beside its number, and moves by key only until they are sorted
    assert sum(map(sys.getsizeof, fst.states)) < 100 * len(fst.states)
    assert len(fst.fresh) < fst.moves / 4 and len(encoder.known) < 4000
