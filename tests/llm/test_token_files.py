import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.conftest import ODD
from tidewatch.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_code_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        for high in (1, 255, 256, 65_535, 65_536, 1 << 24, (1 << 32) - 1):
            values = rng.integers(0, high, n, endpoint=True, dtype=np.uint32)
            control, data = token_files.pack(values)
            assert len(control) == -(-n // 4)
            assert (token_files.unpack(control, data, n) == values).all()


def test_files_hold_the_library_s_ids_in_order(spark, make_docs):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    rows = ODD + [(i, f"text number {i} <|endoftext|> it's\r\n  ok " * (i % 7)) for i in range(200, 100, -1)]
    folder = token_files.shared_folder(spark)
    token_files.write(make_docs(rows), folder, PATH, public_tokenizers.PATTERN)
    got = token_files.read(spark, folder).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for (i, text), r in zip(order, sorted(got, key=lambda r: r.start)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_empty_table(spark, make_docs):
    folder = token_files.shared_folder(spark)
    token_files.write(make_docs([]), folder, PATH, public_tokenizers.PATTERN)
    assert token_files.read(spark, folder).count() == 0


def test_query_gives_the_ids_of_the_untouched_library(spark, make_docs, tmp_path):
    from tidewatch.llm.queries.op04 import op4_token_id_files
    library = Tokenizer.from_file(PATH)
    rows = ODD + [(100, "a <|endoftext|> b"), (101, "x  <|endoftext|>  <|endoftext|><|endoftext|>it's"), (102, "<|endoftext|"), (103, "<<|endoftext|>>\n\n")]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op4_token_id_files(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    start = 0
    for (i, text), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), got, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_tokens_that_take_their_neighbours_go_to_the_library_whole(tmp_path):
    from tokenizers import AddedToken
    library = Tokenizer.from_file(PATH)
    library.add_tokens([AddedToken("<pad>", lstrip=True), AddedToken("<padding>", normalized=False)])
    library.save(f"{tmp_path}/own.json")
    texts = ["a <pad> b", "c <padding> d  <|endoftext|> ", "plain text", "<pad><padding>"]
    encoder = token_files.PieceEncoder(f"{tmp_path}/own.json", public_tokenizers.PATTERN, False)
    assert [ids.tolist() for ids in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_pieces_go_to_the_library_as_one_text():
    library = Tokenizer.from_file(PATH)
    encoder = token_files.PieceEncoder(PATH, public_tokenizers.PATTERN, False)
    texts = ["it's\r\n  <|endoftext <|<|endoftext|>|> é\U0001f600 \x00", "", "<|endoftext|>", "a" * 300 + " <| endoftext|>", "|> <|"]
    calls = []

    class Counted:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, parts, **options):
            calls.append(len(parts))
            return library.encode_batch_fast(parts, **options)

    encoder.tokenizer = Counted()
    assert [ids.tolist() for ids in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert calls == [1]
