"""Byte-level BPE encoding and decoding through a sentencepiece model that is written straight from the vocabulary.

Each byte becomes one printable character, so every token of the rank file is a piece; its score is its negative rank,
and normalisation is the identity. sentencepiece then merges, inside one pre-token, the pair whose joined piece has the
best score, leftmost first: the merges of the rank file. Decoding looks the bytes of each id up.

Scale: one pass over the texts, no shuffle. Workers hold the model and bounded caches only.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.llm.shared import bounded, pieces, text_or_empty

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Entries of a worker's caches of text parts and of pre-tokens, after which they start anew.
CHUNK_CACHE, CACHE = 150_000, 75_000


def read_ranks(spark: SparkSession, path: str) -> list[tuple[bytes, int]]:
    """The rank file's (token, rank) rows in rank order; a vocabulary is bounded, so the driver may hold it."""
    rows = [line.split() for line in open(path, "rb") if line.strip()]
    return sorted(((base64.b64decode(a), int(b)) for a, b in rows), key=lambda x: x[1])


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


CHARACTERS = byte_characters()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: list[tuple[bytes, int]]) -> bytes:
    """A serialised sentencepiece ModelProto. Piece k is the token of rank k; the unknown piece that the format asks
    for comes last, and no byte string reaches it if all 256 single bytes are tokens."""
    out = bytearray()
    for token, rank in ranks:
        piece = "".join(CHARACTERS[b] for b in token)
        out += _message(1, _message(1, piece.encode()) + b"\x15" + struct.pack("<f", -float(rank)))
    unknown = len(ranks)
    out += _message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _flag(3, 2))
    trainer = _flag(3, 2) + _flag(4, unknown + 1) + _flag(40, unknown) + b"".join(_varint(k << 3) + b"\xff" * 9 + b"\x01" for k in (41, 42, 43))
    normalizer = _message(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return bytes(out + _message(2, trainer) + _message(3, normalizer))


class Codec:
    """Encoder and decoder of one vocabulary; a worker builds it once."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(None, path)
        if [r for _, r in ranks] != list(range(len(ranks))):
            raise ValueError("ranks must be 0, 1, 2, ...")
        self.tokens = [t for t, _ in ranks]
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(ranks))
        self.split = regex.compile(pattern).findall
        self.to_characters = dict(enumerate(CHARACTERS))
        self.whole = {t: k for k, t in enumerate(self.tokens)}
        self.pretokens: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.table = pa.array(self.tokens, pa.large_binary())
        self.touching = re.compile(r" \s|\s ").search

    def _learn(self, pretokens: set[str]) -> None:
        """Encodes pre-tokens that are not known yet, all in one call. Ids are kept as the bytes of 32-bit integers."""
        new = [t for t in pretokens if t not in self.pretokens]
        if len(self.pretokens) + len(new) > CACHE:
            self.pretokens.clear()
            new = list(pretokens)
        raw = [t.encode() for t in new]
        ids = self.processor.encode([r.decode("latin-1").translate(self.to_characters) for r in raw], num_threads=1)
        whole = self.whole.get
        for text, r, found in zip(new, raw, ids, strict=True):
            # a pre-token that is itself a token is that token, also where merges would not build it
            k = whole(r)
            self.pretokens[text] = array("i", found if k is None else (k,)).tobytes()

    def pretokenised(self, text: str) -> bytes:
        parts = self.split(text)
        self._learn({*parts})
        return b"".join(map(self.pretokens.__getitem__, parts))

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts. Where single spaces stand between other characters, no pre-token of the pattern reaches
        over one: such a text is cut before each space, and equal parts share their ids. Other texts go whole."""
        if len(self.chunks) > CHUNK_CACHE:
            self.chunks.clear()
        cut = [None if self.touching(t) else t.split(" ") for t in texts]
        heads, parts = set(), set()
        for x in cut:
            if x is not None:
                heads.add(x[0])
                parts.update(x[1:])
        new = [p for p in parts if p not in self.chunks and p]
        if "" in parts:
            self.chunks[""] = self.pretokenised(" ")
        # every new part starts with the only space in it, so one pass of the pattern over all of them can be taken apart
        tokens = self.split("".join(" " + p for p in new))
        self._learn({*tokens})
        ids = [self.pretokens[t] for t in tokens]
        starts = [k for k, t in enumerate(tokens) if t[0] == " "]
        for p, a, b in zip(new, starts, [*starts, len(tokens)][1:], strict=True):
            self.chunks[p] = ids[a] if b == a + 1 else b"".join(ids[a:b])
        first = {h: self.pretokenised(h) for h in heads}
        known = self.chunks.__getitem__
        out = [self.pretokenised(t) if x is None else b"".join([first[x[0]], *map(known, x[1:])]) for t, x in zip(texts, cut, strict=True)]
        for p in new:
            if len(p) > 200:
                del self.chunks[p]
        return [np.frombuffer(x, np.int32) for x in out]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _ids_of(one: Codec, texts: pa.Array) -> pa.Array:
    ids = one.encode_batch(texts.to_pylist())
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _bytes_of(one: Codec, ids: pa.Array) -> pa.Array:
    """The bytes of each list of ids: the tokens' bytes lie behind one another already, only the cuts are found."""
    sizes = pyarrow.compute.fill_null(pyarrow.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    flat = one.table.take(ids.flatten())
    starts = np.frombuffer(flat.buffers()[1], np.int64, count=len(flat) + 1) if len(flat) else np.zeros(1, np.int64)
    cuts = starts[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
    data = flat.buffers()[2] if len(flat) else None
    return pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(cuts.tobytes()), data or pa.py_buffer(b"")]).cast(pa.binary())


_IDS, _DECODED = T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN, with_decoded: bool = False) -> DataFrame:
    """docs with `text` replaced by `ids` (array<int>), the ids of the whole text in UTF-8 without special tokens; and
    by `decoded`, the bytes that these ids stand for, if asked for in the same pass.

    Null text: empty, no ids. Strings that look like special tokens are ordinary text. Repeated rows are encoded alike;
    an empty table gives no rows; columns of docs named ids or decoded are replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, pattern)
        for batch in pieces(batches, "text"):
            ids = _ids_of(one, batch.column("text"))
            rest = [c for c in batch.schema.names if c != "text"]
            more = {"ids": ids} | ({"decoded": _bytes_of(one, ids)} if with_decoded else {})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *more.values()], names=[*rest, *more])

    source = bounded(docs.drop("ids", "decoded")).withColumn("text", text_or_empty())
    fields = [f for f in source.schema.fields if f.name != "text"]
    return source.mapInArrow(run, T.StructType([*fields, _IDS, *([_DECODED] if with_decoded else [])]))


def decode(encoded: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds `decoded` (binary): the bytes of `ids`, looked up token by token. Null ids: empty. An id outside the
    vocabulary raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _bytes_of(one, batch.column("ids"))], names=[*batch.schema.names, "decoded"])

    source = bounded(encoded.drop("decoded"))
    return source.mapInArrow(run, T.StructType([*source.schema.fields, _DECODED]))


def digests(both: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes; the ids are joined as decimals."""
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), with_decoded=True))
