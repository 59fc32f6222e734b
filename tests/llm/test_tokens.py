import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers
import zstandard

from tidemill.llm.common import texts_of
from tidemill.llm.packing import LENGTH, FirstFit, pack_documents, sequences
from tidemill.llm.token_file import _ONE_EACH, _UP_TO, BLOCK_IDS, _code_lengths, _Model, _tree, decode_block, encode_block, read_file, read_token_files, write_file, write_token_files
from tidemill.llm.tokens import Encoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.mark.parametrize("name", FILES)
def test_chunked_ids_equal_whole_ids(name):
    e, rnd = Encoder(public_tokenizers.path(name)), random.Random(5)
    texts = ["", " ", "\n", " a  b", "a \n b", "x.\n'll", "ΟΔΟΣ. Σ", "İstanbul İ", "é x", "<|endoftext|>a", "a\x1c b", "abc. .'s"]
    texts += ["".join(rnd.choice("abé .,'\n s|1\t!A Z 　") for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    for t in texts:
        assert e.ids(t) == e._whole(t), repr(t)


def test_blocks_round_trip_and_checksum():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (3, 9), (700, 2), (5000, 50_257)):
        ids = rng.integers(0, top, n).astype("<u4")
        data = encode_block(ids)
        assert (decode_block(data, 0)[0] == ids).all()
    broken = bytearray(data)
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        decode_block(bytes(broken), 0)
    docs = [(None, b""), (-5, ids[:7].tobytes()), (9, ids.tobytes())]
    assert [(d, i.tobytes()) for d, i in read_file(write_file(docs))] == docs
    assert len(encode_block(np.tile(ids[:50], 2000))) < 50_000  # repeats are learnt
    wide = np.append(np.tile(np.arange(300), 3), 90_000).astype("<u4")  # ids over 16 bits, more than one level of branches
    assert (decode_block(encode_block(wide), 0)[0] == wide).all()
    same = np.full(300_000, 7, "<u4")
    assert (decode_block(encode_block(same), 0)[0] == same).all() and len(encode_block(same)) < 3 * 4096 * 4


def test_blocks_take_fewer_bits_than_zstandard(spark):
    """On a whole block of the documents' ids, against level 19 over 16-bit ids."""
    encode, ids, n = Encoder(public_tokenizers.path(FILES[0])).ids, [], 0
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").select("text").toLocalIterator():
        ids.append(np.frombuffer(encode(r.text or "") + bytes(4), "<u4"))
        n += len(ids[-1])
        if n >= BLOCK_IDS:
            break
    block = np.concatenate(ids)[:BLOCK_IDS]
    data = encode_block(block)
    assert (decode_block(data, 0)[0] == block).all()
    assert len(data) < len(zstandard.compress(block.astype("<u2").tobytes(), 19))


def test_ends_of_branches_are_whole_numbers_in_order():
    """Products add up what sums along rows do, exactly; visits are not counted by themselves."""
    rng = np.random.default_rng(6)
    parts = rng.integers(0, 65_000, (500, 16)).astype(np.float32)
    want = np.cumsum(parts[:, 1:].astype(np.int64) + 1, axis=1)
    got = parts @ _UP_TO + _ONE_EACH
    assert (got[:, 0] == 0).all() and (got[:, 1:] == want).all()
    model = _Model(3, 64)
    for _ in range(20):
        node, last = rng.integers(0, 3, 8), rng.integers(0, 4, 8).astype(np.uint64)
        ends = model.predict(node, last, last * np.uint64(7))
        assert (ends[:, 0] == 0).all() and (np.diff(ends) >= 1).all() and (ends == np.floor(ends)).all()
        model.learn(rng.integers(1, 16, 8))
    assert all(c[:, 0].sum() == 0 and c.sum() == 160 for c in model.counts)


def test_code_lengths_make_a_full_prefix_code():
    """Every id that occurs has its own path, and no path begins with another; the code is no longer than 4-bit-aligned entropy plus one branch."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 16, 17, 31, 32, 500):
        counts = rng.integers(0, 1000, n)
        counts[0] = 5
        lengths = _code_lengths(counts)
        _, paths = _tree(lengths)
        assert ((lengths > 0) == (counts > 0)).all()
        words = sorted("".join(f"{int(paths[i]) >> 4 * d & 15:x}" for d in range(lengths[i])) for i in np.flatnonzero(counts))
        assert all(not b.startswith(a) for a, b in zip(words, words[1:]))
        share = counts[counts > 0] / counts.sum()
        assert (share * lengths[counts > 0]).sum() <= -(share * np.log2(share)).sum() / 4 + 1


def _brute(docs, name, end):
    e = Encoder(public_tokenizers.path(name))
    return [(r["doc_id"], e._whole(r["text"] or "") + int(end).to_bytes(4, "little")) for r in docs.collect()]


def test_token_files(odd_docs, empty_docs):
    want, at = [], 0
    for d, ids in sorted(_brute(odd_docs, FILES[0], 0), key=lambda x: (x[0] is not None, x[0])):
        want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    files = write_token_files(odd_docs, public_tokenizers.path(FILES[0]), file_ids=1000)
    got = [tuple(r) for r in read_token_files(files, with_ids=False).orderBy("start").collect()]
    assert got == want
    assert read_token_files(write_token_files(empty_docs, public_tokenizers.path(FILES[0]))).count() == 0


def test_first_fit_is_first():
    rnd = random.Random(2)
    for _ in range(20):
        sizes, tree, rooms = sorted((rnd.randint(1, 100) for _ in range(60)), reverse=True), FirstFit(60, 100), []
        for s in sizes:
            i = next((i for i, r in enumerate(rooms) if r >= s), len(rooms))
            if i == len(rooms):
                rooms.append(100)
            assert tree.place(s) == (i, 100 - rooms[i])
            rooms[i] -= s
    with pytest.raises(ValueError):
        tree.place(101)


@pytest.mark.parametrize("group_size", (2, 2048))
def test_packing(odd_docs, empty_docs, group_size):
    docs = _brute(odd_docs, FILES[1], 1)
    rows = pack_documents(odd_docs, public_tokenizers.path(FILES[1]), 1, group_size=group_size).collect()
    by_seq, got = {}, {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    for pieces in by_seq.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    for d, ids in docs:
        want = sorted((s, ids[4 * s : 4 * s + 8192]) for s in range(0, len(ids) // 4, 2048))
        times = sum(x == (d, ids) for x in docs)
        assert sorted(got[d, len(ids) // 4]) == sorted(want * times)
    assert pack_documents(empty_docs, public_tokenizers.path(FILES[1]), 1).count() == 0


def test_sequences_hold_all_ids_with_little_padding(spark):
    """Pieces put in their places give every document's ids again; padding goes to the length, but not from a power of two."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = public_tokenizers.path(FILES[1])
    packed = pack_documents(docs, path, 1).cache()
    made = {r.sequence_id: r for r in sequences(packed, 3).collect()}
    pieces = packed.collect()
    tokenizer = tokenizers.Tokenizer.from_file(str(path))
    whole = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    filled = Counter()
    for p in pieces:
        ids = np.frombuffer(made[p.sequence_id].ids, "<u4")[p.offset : p.offset + p.length]
        assert (ids == whole[p.doc_id][p.start : p.start + p.length]).all() and zlib.crc32(ids.tobytes()) == p.ids_crc32
        filled[p.sequence_id] += p.length
    assert sum(filled.values()) == sum(map(len, whole.values())) and set(filled) == set(made)
    for s, n in filled.items():
        ids = np.frombuffer(made[s].ids, "<u4")
        assert n == made[s].filled <= LENGTH and len(ids) == (n if n & (n - 1) == 0 else LENGTH) and (ids[n:] == 3).all()
    assert sum(LENGTH - n for n in filled.values()) < 2 * LENGTH
    few = spark.createDataFrame([(1, ""), (2, "")], "doc_id long, text string")
    assert [len(r.ids) for r in sequences(pack_documents(few, path, 1), 3).collect()] == [8]  # two tokens: a power of two
    packed.unpersist()


def test_names_that_differ_in_case(spark):
    docs = spark.createDataFrame([(1, "one two", "other", 9)], "doc_id long, text string, Text string, DOC_ID long")
    assert texts_of(docs).collect() == [(1, "one two")]


def test_cases_of_ascii_words_are_one_chunk():
    """Of a lower-casing tokenizer; a word with one mark needs no pattern. Ids stay those of the tokenizer."""
    made = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["The THE the. tHe, don't DON'T it's X1 a-b\nThe", "Thé İ The ẞ T̈ ÀB. the", ".", "a..", "$a a$ (a) a)", "\x1cA. \x85B"]
    for text in texts:
        assert np.frombuffer(made.ids(text), "<u4").tolist() == made.tokenizer.encode(text, add_special_tokens=False).ids
    made = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    made.ids("The THE the. tHe,")
    assert set(made.bare) == {"the", "the.", "the,", ".", ","}
