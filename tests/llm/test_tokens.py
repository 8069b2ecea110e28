import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankweave.llm import byte_bpe, packing, token_store
from rankweave.llm.word_tokens import encode_text
from tests.llm.conftest import ODD

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = Tokenizer.from_file(WORDS)


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abzAZéÉßÿ0129²½ \t\n\x1c\x85\xa0'sStTreVE,.!-_\x00·ªº<|>µŒİΣ́中", max_size=40))
def test_words_equal_the_library(text):
    assert encode_text(text, WORDS).tolist() == library(text)


def test_words_with_special_tokens_and_end():
    text = "one <|endoftext|> two"
    assert encode_text(text, WORDS, 2).tolist() == library(text) + [2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.sampled_from([1, 7, 128]), st.sampled_from([0, 50, 90, 100]))
def test_blocks_round_trip(ids, block, percentile):
    packed = token_store.pack_ids(np.array(ids, np.uint32), block, percentile)
    assert token_store.unpack_ids(packed).tolist() == ids
    for k in range(-(-len(ids) // block)):
        assert token_store.read_block(packed, k).tolist() == ids[k * block:(k + 1) * block]


def test_store_reads_back_in_order(spark, odd, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_token_store(odd, path, WORDS, 2, shard_ids=100)
    got = token_store.read_token_store(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    want = sorted(zlib.crc32(np.array([*library(t), 2], "<u4").tobytes()) for _, t in ODD)
    assert sorted(zlib.crc32(r.ids) for r in got) == want


def test_store_of_nothing(spark, tiny, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_token_store(tiny([]), path, WORDS, 2)
    assert token_store.read_token_store(spark, path).count() == 0


def test_byte_bpe_equals_tiktoken(spark, odd, tiny):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe._ranks(RANKS), special_tokens={})
    more = [(10, "Word by word, it's 42!  \n\n  x" * 50), (11, "a" * 200), (12, "ab " * 20 + "c" * 90 + " d" * 30), (12, "ab " * 20 + "c" * 90 + " d" * 30)]
    rows = [r for r in ODD if r[0] != 4] + more
    got = byte_bpe.decode(byte_bpe.encode(tiny(rows), RANKS, public_tokenizers.PATTERN, chunk=64, overlap=24), RANKS).collect()
    want = sorted((str(i), own.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.bytes)) for r in got) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 's\n,1é!t", max_size=200))
def test_shared_boundaries_are_boundaries_of_the_text(text):
    ends = set(byte_bpe.boundaries(text, public_tokenizers.PATTERN, 0, True))
    left = set(byte_bpe.boundaries(text[:60], public_tokenizers.PATTERN, 0, len(text) <= 60))
    assert left <= ends
    right = byte_bpe.boundaries(text[40:], public_tokenizers.PATTERN, 40, True)
    shared = [p for p in right if p in left]
    assert not shared or {p for p in right if p >= shared[0]} == {p for p in ends if p >= shared[0]}


def test_pieces_of_white_space_equal_tiktoken(spark, tiny):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe._ranks(RANKS), special_tokens={})
    rng = np.random.default_rng(6)
    parts = ["\n", "\n\n", "\n\n\n", "\t", "\t\t", " ", "  \n", "a", "word", "42", "7", "'s", "."]
    rows = [(i, "x" * i + "\n\nb" * 60) for i in range(64)]  # a blank line at every offset of a chunk
    rows += [(100 + i, "".join(rng.choice(parts, 150))) for i in range(200)] + [(400, "a" + "\n" * 200 + "b")]
    got = byte_bpe.encode(tiny(rows), RANKS, public_tokenizers.PATTERN, chunk=64, overlap=24).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in got} == {i: own.encode_ordinary(t) for i, t in rows}


def check_pieces(rows, ids_of, capacity):
    """Each id in exactly one piece, sequences gapless and full or of a power of two."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == np.array(ids_of[doc_id], "<u4").tobytes()
        assert {r.doc_tokens for r in pieces} == {len(ids_of[doc_id])}
    assert set(by_doc) == set(ids_of)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) // 4
            at += r.length
        assert at <= capacity and at & (at - 1) == 0


def test_packing_without_padding(spark, tiny):
    rows = [(i, "word " * (i * 37 % 500)) for i in range(60)] + [(100, None), (101, ""), (102, "long " * 3000)]
    got = packing.pack(tiny(rows).repartition(3), WORDS, 2, capacity=256, grain=16).collect()
    check_pieces(got, {i: [*library(t), 2] for i, t in rows}, 256)


def test_documents_are_cut_only_to_close_a_sequence():
    rng = np.random.default_rng(2)
    lengths = {i: int(n) for i, n in enumerate(rng.integers(1, 257, 3000))} | {5000: 256, 5001: 1000}
    packer = packing.Packer(256, 16, 0)
    for i, n in lengths.items():
        packer.add(i, np.arange(n, dtype="<u4"))
    rows = [SimpleNamespace(**dict(zip(packing.COLUMNS, r))) for r in packer.take()]
    for i, n in [(9000, 100), (9001, 90), (9002, 60), (9003, 6)]:
        small = packing.Packer(256, 16, 0) if i == 9000 else small
        small.add(i, np.arange(n, dtype="<u4"))
    small.finish()
    assert sorted((r[0], r[1], r[2]) for r in small.take()) == [(9000, 0, 100), (9001, 0, 90), (9002, 0, 60), (9003, 0, 6)]
    pieces, sequences, cut = Counter(r.doc_id for r in rows), {r.sequence_id for r in rows}, set()
    for r in rows:
        if r.start + r.length < r.doc_tokens:
            assert r.offset + r.length == 256 and r.sequence_id not in cut
            cut.add(r.sequence_id)
    assert max(n for i, n in pieces.items() if lengths[i] <= 256) == 2
    assert sum(n - 1 for n in pieces.values()) <= len(sequences)
    packer.finish()
    rows += [SimpleNamespace(**dict(zip(packing.COLUMNS, r))) for r in packer.take()]
    check_pieces(rows, {i: list(range(n)) for i, n in lengths.items()}, 256)


def test_packing_odd_rows(spark, odd, tiny):
    got = packing.pack(odd, WORDS, 2).collect()
    assert sum(r.length for r in got) == sum(len(library(t)) + 1 for _, t in ODD)
    assert packing.pack(tiny([]), WORDS, 2).count() == 0
    with pytest.raises(ValueError):
        packing.Packer(100, 10, 0)
