"""Token ids as binary files: canonical length-limited Huffman codes from global counts.

Ids of all documents are counted; package-merge gives each id a code of at most LONGEST bits, assigned canonically, so
that lengths alone restore the codes. Files hold ids in ascending key order, cut into independent blocks; inside a
block, the bit offset of every STRIDE-th id is kept, and a block decodes with one table look-up per id, all strides at
once.

Scale: texts are tokenised once, into a table of packed ids. Counts are summed per partition before they meet; only the
counts per vocabulary entry (bounded by the vocabulary) reach the driver. One range shuffle of the packed ids gives the
order. Files are named per attempt and listed by the tasks that succeeded.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairnbook.llm.files import new_file, reading, writing
from cairnbook.llm.shared import bounded, fresh_path, materialise, pieces, text_or_empty, utf8_parts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
LONGEST = 20
#: Ids of a block, at least (a document is never cut), and ids between kept bit offsets.
BLOCK_IDS, STRIDE = 1 << 16, 64
#: Ids of a file, about.
FILE_IDS = 1 << 23
MAGIC = b"HUFT1\n"
#: Words whose ids a worker remembers, at most.
CACHE = 1_000_000
#: Words of ASCII signs and the letters of Latin-1, which NFC leaves alone and which lower-case one by one.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The vocabulary's own pattern and normaliser, and the pattern for lower-case plain words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

TAIL = ".,;:!?$"


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet, as a table for str.translate over Latin-1: printable bytes stand for themselves, the
    others for the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}


#: ASCII white space as spaces, and the same with capitals folded.
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[9:14] = 32
_FOLD = _SPACES.copy()
_FOLD[65:91] += 32


class WordTokenizer:
    """Ids of words by the tokenizers library, packed; a word is encoded when it is first met.

    The vocabulary's pattern drops white space and its normaliser lower-cases and works on characters, so no token
    reaches over ASCII white space, and ASCII capitals can be folded first where no special token can stand. A plain
    word's parts go straight to the library's BPE model; any other word goes through the whole library."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.model, self.letters = self.library.model, _byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pack = struct.Struct("<I" if self.library.get_vocab_size() > 1 << 16 else "<H")
        spec = json.load(open(path, encoding="utf-8"))
        # special tokens are found in the raw text; one with white space inside would reach over words
        specials = [t["content"] for t in spec.get("added_tokens", [])]
        assert not any(c.isspace() for s in specials for c in s)
        split, steps = spec["pre_tokenizer"]["pretokenizers"][0], [x["type"] for x in spec["normalizer"]["normalizers"]]
        self.direct = split["pattern"] == {"Regex": PATTERN} and steps == NORMALISERS and all(s.startswith("<|") for s in specials)

    def _ids(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is not None:
            return ids
        stem = word.rstrip(TAIL) if self.direct else word  # the pattern ends a token between a letter or digit and such a sign
        if stem != word and "<|" not in word and stem[-1:].isalnum() and stem[-1:] < "\u0100":
            return self._ids(stem) + self._ids(word[len(stem):])
        ids = self.older.get(word)
        if ids is None:
            ids = self._new(word)
        if len(word) <= 256:
            self.known[word] = ids
        return ids

    def _new(self, word: str) -> bytes:
        if not self.direct or "<|" in word:
            return self._packed(self.library.encode(word, add_special_tokens=False).ids)
        if word.isascii() and word.islower() and word.isalpha():
            return self._packed([t.id for t in self.model.tokenize(word)])
        if not PLAIN.fullmatch(word):
            return self._packed(self.library.encode(word, add_special_tokens=False).ids)
        parts = PARTS.findall(word.lower())
        if len(parts) > 1:
            return b"".join(map(self._ids, parts))
        letters = parts[0] if word.isascii() else parts[0].encode().decode("latin-1").translate(self.letters)
        return self._packed([t.id for t in self.model.tokenize(letters)])

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.pack.format[-1]}", *ids)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids, little-endian, in 16 bits if the vocabulary allows, else in 32. Null: none."""
        if len(self.known) > CACHE // 2:
            self.known, self.older = {}, self.known
        raw, stops = utf8_parts(texts)
        folds = self.direct and b"<|" not in raw.tobytes()
        raw = (_FOLD if folds else _SPACES)[raw]
        texts = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(stops), pa.py_buffer(raw))
        words = pc.split_pattern(texts, " ")
        distinct = words.flatten().dictionary_encode()
        packed = pa.array(map(self._ids, distinct.dictionary.to_numpy(zero_copy_only=False)), pa.large_binary())
        ids = packed.take(distinct.indices)
        if not len(ids):
            return [b""] * len(texts)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)
        stops = ends[np.cumsum(pc.list_value_length(words).to_numpy())].tolist()
        data = memoryview(ids.buffers()[2])
        return [bytes(data[i:k]) for i, k in zip([0, *stops[:-1]], stops, strict=True)]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenise(docs: DataFrame, path: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """docs: doc_id (integer), text. Returns doc_id, n_tokens and ids (binary: little-endian unsigned 16-bit integers
    if the vocabulary allows, else 32-bit), end_id appended. Null text: the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = _tokenizer(path)
        end = known.pack.pack(end_id)
        for batch in pieces(batches, "text", 4 << 20):
            ids = [x + end for x in known.encode(batch.column("text"))]
            sizes = [len(x) // len(end) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return bounded(docs).select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _unpack(packed: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(packed, "<u4" if wide else "<u2")


def count_ids(tokens: DataFrame, wide: bool) -> np.ndarray:
    """Occurrences of each id over all documents; the driver gets one row per vocabulary entry at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(_unpack(b"".join(batch.column("ids").to_pylist()), wide))
            if len(own) > len(total):
                total = np.pad(total, (0, len(own) - len(total)))
            total[:len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Package-merge: the lengths of the best prefix code with no code above `longest` bits; 0 for unused ids."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    while len(used) > 1 << longest:
        longest += 1
    used = used[np.argsort(counts[used], kind="stable")]
    weight, n = counts[used], len(used)
    rows: list[np.ndarray] = []  # of each level, which of its sorted entries are packages of the level below
    level = weight
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        rows.append(order >= n)
        level = both[order]
    take = 2 * n - 2
    out = np.zeros(n, np.int64)
    for packages in reversed(rows):
        inside = int(np.count_nonzero(packages[:take]))
        out[: take - inside] += 1
        take = 2 * inside
    out[:take] += 1
    lengths[used] = out
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if lengths[i]:
            code <<= int(lengths[i]) - last
            last = int(lengths[i])
            codes[i] = code
            code += 1
    return codes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit offsets of every STRIDE-th id). Bits run from the highest of each byte on."""
    size = lengths[ids]
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 32 + 3, np.uint64)
    where, room = starts >> 5, (64 - (starts & 31) - size).astype(np.uint64)
    placed = codes[ids] << room  # inside the 64 bits that start at the word of the first bit
    high, low = placed >> np.uint64(32), placed & np.uint64(0xFFFFFFFF)
    if len(ids):
        first = np.flatnonzero(np.diff(where, prepend=-1))
        words[where[first]] += np.add.reduceat(high, first)
        words[where[first] + 1] += np.add.reduceat(low, first)
    return words.astype(">u4").tobytes()[: (total + 7) // 8 + 8], starts[::STRIDE]


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) for every value of the next `width` bits."""
    width = max(1, int(lengths.max(initial=0)))
    codes, used = canonical_codes(lengths), np.flatnonzero(lengths)
    used = used[np.argsort(codes[used] << (width - lengths[used]).astype(np.uint64), kind="stable")]
    runs = np.left_shift(1, width - lengths[used])
    ids, sizes = np.repeat(used, runs), np.repeat(lengths[used], runs)
    rest = (1 << width) - len(ids)  # a one-id code leaves half of the table unused
    return np.pad(ids, (0, rest)).astype(np.uint32), np.pad(sizes, (0, rest), constant_values=1).astype(np.uint8), width


def decode_block(bits: bytes, offsets: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The block's n ids: all strides advance together, one look-up per id."""
    ids, sizes, width = table
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint64)
    windows = sum(raw[k:len(raw) - 4 + k] << np.uint64(32 - 8 * k) for k in range(5))  # 40 bits from each byte on
    out = np.zeros((len(offsets), STRIDE), np.uint32)
    at, mask = offsets.astype(np.int64), np.uint64((1 << width) - 1)
    last = len(windows) - 1
    for k in range(STRIDE):
        place = np.minimum(at >> 3, last)
        value = (windows[place] >> (np.uint64(40 - width) - (at & 7).astype(np.uint64))) & mask
        out[:, k] = ids[value]
        at = at + sizes[value]
    return out.ravel()[:n]


def write_files(tokens: DataFrame, folder: str, lengths: np.ndarray, n_files: int, wide: bool) -> DataFrame:
    """Writes ids in ascending doc_id order (nulls first; ties by the ids' checksum) and returns the manifest: part,
    path, n_docs, n_ids. A file: magic, code lengths (zlib), then blocks of: counts, doc ids and sizes (zlib), bit
    offsets (zlib), bits."""
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(lengths.astype(np.uint8).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own = np.frombuffer(shared.value, np.uint8).astype(np.int64)
        codes = canonical_codes(own)
        path, n_docs, n_ids = new_file(folder, part, ".huf"), 0, 0
        with writing(path) as out:
            head = zlib.compress(shared.value)
            out.write(MAGIC + struct.pack("<I", len(head)) + head)
            docs: list[tuple[int | None, np.ndarray]] = []
            held = 0

            def flush() -> None:
                ids = np.concatenate([x for _, x in docs]).astype(np.int64)
                bits, offsets = encode_block(ids, codes, own)
                keys = np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes() + bytes(d is None for d, _ in docs) + np.array([len(x) for _, x in docs], "<u8").tobytes()
                keys, marks = zlib.compress(keys, 1), zlib.compress(np.diff(offsets, prepend=0).astype("<u4").tobytes(), 1)
                out.write(struct.pack("<5Q", len(docs), len(ids), len(keys), len(marks), len(bits)) + keys + marks + bits)

            for batch in batches:
                for d, packed in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                    ids = _unpack(packed, wide)
                    docs.append((d, ids))
                    n_docs, n_ids, held = n_docs + 1, n_ids + len(ids), held + len(ids)
                    if held >= BLOCK_IDS:
                        flush()
                        docs, held = [], 0
            if docs:
                flush()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([n_ids], pa.int64())], names=["part", "path", "n_docs", "n_ids"])

    tie = F.crc32("ids")
    order = [F.col("doc_id").asc_nulls_first(), tie.asc()]
    ranged = tokens.select("doc_id", "ids").repartitionByRange(n_files, *order).sortWithinPartitions(*order)
    return materialise(ranged.mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "huffman-manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary, little-endian unsigned 32-bit) of
    every document in the manifest's files."""
    # one row per file: as many as files, however many documents
    before = F.sum("n_ids").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = manifest.select("path", F.coalesce(before, F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                yield from _read_file(path, base)

    spark = manifest.sparkSession
    files = max(1, manifest.count())
    return based.repartition(min(files, 4 * spark.sparkContext.defaultParallelism), "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _read_file(path: str, base: int) -> Iterator[pa.RecordBatch]:
    with reading(path) as source:
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path}: not a file of Huffman-coded ids")
        (size,) = struct.unpack("<I", source.read(4))
        table = decoding_table(np.frombuffer(zlib.decompress(source.read(size)), np.uint8).astype(np.int64))
        while head := source.read(40):
            n_docs, n_ids, a, b, c = struct.unpack("<5Q", head)
            keys, marks, bits = zlib.decompress(source.read(a)), zlib.decompress(source.read(b)), source.read(c)
            ids = decode_block(bits, np.cumsum(np.frombuffer(marks, "<u4").astype(np.int64)), n_ids, table)
            doc_ids = np.frombuffer(keys[: 8 * n_docs], "<i8")
            missing = np.frombuffer(keys[8 * n_docs: 9 * n_docs], np.uint8).astype(bool)
            sizes = np.frombuffer(keys[9 * n_docs:], "<u8").astype(np.int64)
            ends = np.cumsum(sizes)
            raw = ids.astype("<u4").tobytes()
            own = [raw[4 * (e - s): 4 * e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            arrays = [pa.array(doc_ids, pa.int64(), mask=missing), pa.array(base + ends - sizes), pa.array(sizes), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids"])
            base += int(n_ids)


def write_token_files(docs: DataFrame, path: str = VOCABULARY, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Tokenises docs (doc_id integer, text), codes the ids and writes them; returns the manifest of the files.

    Null and empty texts: the end id alone. Null doc_ids come first; rows that share a doc_id stay apart, ordered by
    their ids' checksum. Empty table: an empty file or none. Further columns of docs are ignored."""
    spark = docs.sparkSession
    wide = Tokenizer.from_file(path).get_vocab_size() > 1 << 16
    tokens = materialise(tokenise(docs, path, end_id), "token-ids")
    counts = count_ids(tokens, wide)
    n_files = max(1, -(-int(counts.sum()) // file_ids))
    return write_files(tokens, fresh_path(spark, "huffman-files"), code_lengths(counts), n_files, wide)


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_files(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
