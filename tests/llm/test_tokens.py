"""Byte-level BPE against tiktoken, Huffman files against the tokenizers library, both as round trips."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairnbook.llm import byte_bpe, huffman


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_byte_bpe_equals_tiktoken(request, library, table):
    rows = request.getfixturevalue(table)
    got = byte_bpe.digests(byte_bpe.encode(rows, with_decoded=True)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(rows))).collect()))
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    assert len(got) == rows.count()
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t\r\x0b\x1c\x85  ab's'tréZ中🙂1²_.<|>\x00é"), max_size=30), min_size=1, max_size=4))
def test_byte_bpe_on_odd_texts(library, texts):
    codec = byte_bpe.codec(byte_bpe.VOCABULARY, public_tokenizers.PATTERN)
    assert [x.tolist() for x in codec.encode_batch(texts)] == [library.encode_ordinary(t) for t in texts]


def test_every_token_is_a_piece():
    codec = byte_bpe.codec(byte_bpe.VOCABULARY, public_tokenizers.PATTERN)
    pieces = ["".join(byte_bpe.CHARACTERS[b] for b in t) for t in codec.tokens]
    assert [codec.processor.piece_to_id(p) for p in pieces] == list(range(len(pieces)))


@pytest.mark.parametrize("table", ["docs", "awkward"])
def test_huffman_files(request, table):
    rows = request.getfixturevalue(table)
    library = Tokenizer.from_file(huffman.VOCABULARY)
    read = huffman.read_files(huffman.write_token_files(rows, file_ids=2000)).collect()
    assert len(read) == rows.count()
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    start = 0
    for r in sorted(read, key=lambda r: (r["doc_id"], r["start"])):
        ids = np.array([*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], zlib.crc32(r["ids"])) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


ODD = [*"abcXYZ'’sßéÉÀÿµª²½ 09.,!#\n\t–İıǅſKé°$", "<|endoftext|>", "<|", "|>", "'re", "'LL", "don't", "日本", "\u0301", "\u00ad", "\u2028", "\x1c", "\x85", "A\u030a"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=14).map("".join), max_size=4))
def test_words_apart_are_encoded_like_whole_texts(texts):
    library, words = Tokenizer.from_file(huffman.VOCABULARY), huffman._tokenizer(huffman.VOCABULARY)
    found = words.encode(pa.array(texts, pa.string()))
    assert [np.frombuffer(x, "<u2").tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty(empty):
    assert byte_bpe.digests(byte_bpe.encode(empty, with_decoded=True)).count() == 0
    assert huffman.read_files(huffman.write_token_files(empty)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=80), st.integers(7, 20))
def test_lengths_are_limited_and_best(counts, longest):
    lengths = huffman.code_lengths(np.array(counts), longest)
    used = lengths[lengths > 0].astype(float)
    assert (lengths > 0).tolist() == [c > 0 for c in counts] and (len(used) < 2 or used.max() <= longest)
    assert len(used) == 0 or (2.0 ** -used).sum() <= 1
    if longest == 20 and len(used) > 1:
        import heapq

        heap = sorted(c for c in counts if c)
        cost = 0
        while len(heap) > 1:
            s = heapq.heappop(heap) + heapq.heappop(heap)
            cost += s
            heapq.heappush(heap, s)
        assert int((lengths * np.array(counts)).sum()) >= cost and (max(used) == 20 or int((lengths * np.array(counts)).sum()) == cost)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=700))
def test_block_round_trip(values):
    ids = np.array(values)
    lengths = huffman.code_lengths(np.bincount(ids))
    bits, offsets = huffman.encode_block(ids, huffman.canonical_codes(lengths), lengths)
    assert huffman.decode_block(bits, offsets, len(ids), huffman.decoding_table(lengths)).tolist() == values
