"""Range coder, file format and token files against exact round trips and the library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n, kinds, block", [(0, 10, 64), (1, 1, 64), (5, 70_000, 64), (3000, 50_257, 512), (20_000, 3, 512),
                                             (30_000, 120_000, 1000), (9000, 1, 2048), (9000, 3000, 2048)])
def test_coder_round_trip(n, kinds, block):
    from gleaner.llm import range_coder
    rng = np.random.default_rng(n)
    for numbers in (rng.integers(0, kinds, n), np.minimum(rng.zipf(1.3, n) - 1, kinds - 1),
                    np.tile(rng.integers(0, kinds, 37), n // 37 + 1)[:n]):
        blocks = range_coder.encode(numbers, kinds, block)
        assert [c for c, _ in blocks] == [min(block, n - at) for at in range(0, n, block)]
        back = range_coder.decode(blocks, kinds)
        assert np.array_equal(np.concatenate([*back, np.zeros(0)]), numbers)
        if len(blocks) > 2:  # a block needs no other one
            assert np.array_equal(range_coder.decode(blocks[1:2], kinds)[0], back[1])


def test_coder_knows_more_ids_than_it_learns():
    from gleaner.llm import range_coder
    numbers = np.concatenate([np.arange(3000), np.arange(3000)])
    assert np.array_equal(np.concatenate(range_coder.decode(range_coder.encode(numbers, 3000, 6000), 3000)), numbers)


def test_repeated_ids_take_less_room():
    from gleaner.llm import range_coder
    rng = np.random.default_rng(1)
    size = lambda x: sum(len(b) for _, b in range_coder.encode(x, 50_000))
    once, pattern = rng.integers(0, 50_000, 40_000), np.tile(rng.integers(0, 50_000, 40), 1000)
    assert size(pattern) < 0.1 * size(once)
    assert size(np.minimum(rng.zipf(1.5, 40_000), 49_999)) < 0.6 * size(once)


def test_damaged_files_are_found():
    from gleaner.llm.token_files import Damaged, file_bytes, file_documents
    ids = np.arange(5000, dtype=np.uint32) * 977 % 50_000
    data = file_bytes([4, None], [4999, 1], ids)
    doc_ids, counts, back = file_documents(data)
    assert (doc_ids, counts.tolist()) == ([4, None], [4999, 1]) and np.array_equal(back, ids)
    wide = ids.astype(np.uint32) + np.uint32(1 << 31)
    assert np.array_equal(file_documents(file_bytes([1], [5000], wide))[2], wide)
    for at in (0, 9, 60, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(Damaged):
            file_documents(bytes(bad))
    for cut in (0, 10, 100, len(data) - 1):
        with pytest.raises(Damaged):
            file_documents(data[:cut])


TEXTS = ["a  b", " lead", "trail ", "x \n y", "x\n\n y", "x\n \ny", "a\u00a0 \u00a0b", "\u3000 \u3000", "it's  we'll 'S", "<|endoftext|> a <|endoftext|>",
         "a <|endoftext|>b", "tab\t\tx \t y", "", " ", "é ü \U0001f600 \U0001f600", "1 22 333 4,4", "a\r\nb \r\n c", "\x85 \x85x"]


def test_encoder_gives_the_library_ids(rows):
    from gleaner.llm.token_files import TextEncoder
    library = Tokenizer.from_file(PATH)
    encoder = TextEncoder(PATH)
    texts = [t or "" for _, t in rows] + TEXTS + ["ab " + t for t in TEXTS]
    assert encoder.fast is not None
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [
        library.encode(t, add_special_tokens=False).ids for t in texts]
    other = public_tokenizers.path("word_bpe_49k.json")  # not byte-level: by the library alone
    library, encoder = Tokenizer.from_file(other), TextEncoder(other)
    assert encoder.fast is None
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(TEXTS)] == [
        library.encode(t, add_special_tokens=False).ids for t in TEXTS]


def expected(rows):
    library = Tokenizer.from_file(PATH)
    found = [(d, np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for d, t in rows]
    return sorted(found, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("file_ids", [10**7, 3000])
def test_files_hold_all_documents_in_order(spark, docs, rows, tmp_path, monkeypatch, file_ids):
    from gleaner.llm import token_files
    monkeypatch.setattr(token_files, "FILE_IDS", file_ids)
    folder = f"file://{tmp_path}/ids"
    token_files.write_token_files(docs, folder, PATH)
    got = token_files.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    want = expected(rows)
    assert [r.doc_id for r in got] == [d for d, _ in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((d is not None, d or 0, x) for d, x in want)
    start = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids) // 4, zlib.crc32(bytes(r.ids)))
        start += r.n_tokens
    assert not list((tmp_path / "ids").glob(".*.ids.*"))


def test_a_damaged_file_is_named(spark, docs, tmp_path):
    from gleaner.llm import token_files
    folder = f"file://{tmp_path}/ids"
    token_files.write_token_files(docs.where("doc_id = 1"), folder, PATH)
    (name,) = (tmp_path / "ids").glob("*.ids")
    data = bytearray(name.read_bytes())
    data[-1] ^= 4
    name.write_bytes(bytes(data))
    with pytest.raises(Exception, match=f"{name.name}: block"):
        token_files.read_token_files(spark, folder).collect()


def test_files_of_nothing(spark, no_docs, tmp_path):
    from gleaner.llm import token_files
    folder = f"file://{tmp_path}/ids"
    token_files.write_token_files(no_docs, folder, PATH)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_query_matches_the_library(spark):
    from gleaner.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_token_files"](spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    want, start = [], 0
    for d, x in expected(rows):
        want.append((d, start, len(x) // 4, zlib.crc32(x)))
        start += len(x) // 4
    assert [tuple(r) for r in got.orderBy(F.col("start")).collect()] == want
