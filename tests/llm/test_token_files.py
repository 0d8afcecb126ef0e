import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from opsweave.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 20, 31, 32])
def test_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    packed = T.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    index = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([0]), pa.array([1003])], names=["id", "start", "n"])
    file = T.PackedIds(T.file_bytes(3, 4, index, ids, bits, block=100) + b"\n")
    assert (file.part, file.number, file.bits, file.n) == (3, 4, bits, 1003)
    for a, b in ((0, 1003), (0, 0), (99, 101), (100, 200), (517, 518), (1000, 1003)):
        assert (file.ids(a, b) == ids[a:b]).all()


def test_bits():
    assert [T.bits_for(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_pieces_equal_the_whole_text():
    tool, plain = T.encoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(3)
    signs = ["a", "b", "é", "1", ".", "'s", "'", " ", "  ", "\n", "\t", "\r\n", "\x85", "\xa0", " ", "　", "\x1c", "\x1f", "᠎", "​", "﻿", "漢", "<|endoftext|>", "\x00", "日本", "ß", "🙂"]
    texts = ["", " ", "  a", "a ", "a  b", " \n x"] + ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(3000)]
    for _ in range(2):  # also from the cache
        ids, counts = tool.encode(pa.array([None, *texts]))
        assert counts[0] == 0
        for text, ids, want in zip(texts, np.split(ids, np.cumsum(counts[1:-1])), plain.encode_batch(texts, add_special_tokens=False)):
            assert ids.tolist() == want.ids, repr(text)


def test_pieces_are_forgotten(monkeypatch):
    monkeypatch.setattr(T, "CACHED", 20)
    tool, plain = T.Encoder(PATH), Tokenizer.from_file(PATH)
    for k in range(30):
        texts = [f"The word{j % 7} of round {k} and {j}\nends here" for j in range(9)]
        ids, counts = tool.encode(pa.array(texts))
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [x.tolist() for x in got] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert len(tool._slots) < 60


def want_of(rows):
    plain, out, start = Tokenizer.from_file(PATH), [], 0
    for i, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, docs):
    got = T.digest(docs, PATH)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    want = want_of(sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
    assert sorted(map(tuple, got.collect())) == want


def test_edges_and_many_files(spark, frame, edge_rows):
    folder = T.shared_folder(spark)
    table = frame(edge_rows)
    T.write(table, folder, PATH, file_ids=3, block_ids=2)
    got = sorted(map(tuple, T.read_back(spark, folder).collect()), key=lambda r: r[1])
    want = want_of(sorted(((r[0], r[1]) for r in edge_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))
    assert sorted((r[0] or -1, *r[2:]) for r in got) == sorted((r[0] or -1, *r[2:]) for r in want)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()
    ids = Tokenizer.from_file(PATH).encode("one two", add_special_tokens=False).ids + [0]
    assert [tuple(r) for r in T.read_ids(spark, folder, [5]).collect()] == [(5, ids)]
    assert T.digest(frame([]), PATH).collect() == []
