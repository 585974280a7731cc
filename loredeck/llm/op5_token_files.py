"""Token-id files of directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id and a bitmap of the ids
that go on; level 1 the second chunk of those, and so on. A rank directory, one count for every 512 bits, turns an
id's place on one level into its place on the next, so any token is read with a few array accesses and no block is
decoded. A file holds consecutive documents in ascending doc_id order with their lengths, and is a row of a table
in the shared folder.

Cases: null or empty text is the end id alone; null doc_ids come first; repeated doc_ids stay separate rows,
ordered by their ids; an empty table gives no files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loredeck.llm import words
from loredeck.llm.common import batched, materialise, slices, table, text_bytes

END_ID = 1
#: Tokens a file gets (or one document), bits a directory entry covers.
FILE_TOKENS, RANK_BITS = 1 << 20, 512
#: Text of a range of doc_ids that is written by one task, ranges and bins of the histogram they are cut by at most.
RANGE_BYTES, RANGES, HISTOGRAM = 8 << 20, 1 << 13, 1 << 16
#: Text that is encoded at once.
ENCODE_BYTES = 2 << 20
MAGIC = b"DAC1"


class Codes:
    """Directly addressable codes of a sequence of ids."""

    def __init__(self, chunks: list[np.ndarray], bitmaps: list[np.ndarray]):
        self.chunks, self.bitmaps = chunks, bitmaps
        self.directories = [self._directory(b) for b in bitmaps]

    @staticmethod
    def _directory(bitmap: np.ndarray) -> np.ndarray:
        step = RANK_BITS // 8
        padded = np.zeros(-(-len(bitmap) // step) * step, np.uint8)
        padded[: len(bitmap)] = bitmap
        return np.concatenate([[0], np.cumsum(np.bitwise_count(padded).reshape(-1, step).sum(1, dtype=np.uint32))]).astype("<u4")

    @classmethod
    def encode(cls, ids: np.ndarray) -> Codes:
        chunks, bitmaps, rest = [], [], ids.astype(np.uint32)
        while True:
            chunks.append((rest & 255).astype(np.uint8))
            rest = rest >> 8
            more = rest > 0
            bitmaps.append(np.packbits(more, bitorder="little"))
            if not more.any():
                return cls(chunks, bitmaps)
            rest = rest[more]

    def __len__(self) -> int:
        return len(self.chunks[0])

    def get(self, i: int) -> int:
        """The i-th id."""
        value = 0
        for level, (chunk, bits, directory) in enumerate(zip(self.chunks, self.bitmaps, self.directories)):
            value |= int(chunk[i]) << (8 * level)
            byte, bit = divmod(i, 8)
            if not bits[byte] >> bit & 1:
                return value
            block = i // RANK_BITS
            whole = bits[block * RANK_BITS // 8 : byte]
            i = int(directory[block]) + int(np.bitwise_count(whole).sum()) + int(bits[byte] & ((1 << bit) - 1)).bit_count()
        return value

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop."""
        stop = len(self) if stop is None else stop
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for level, (chunk, bits) in enumerate(zip(self.chunks, self.bitmaps)):
            if start >= stop:
                break
            out[where] |= chunk[start:stop].astype(np.uint32) << np.uint32(8 * level)
            more = np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            where = where[more]
            start = self._rank(level, start)
            stop = start + len(where)
        return out

    def _rank(self, level: int, i: int) -> int:
        bits, block = self.bitmaps[level], i // RANK_BITS
        byte, bit = divmod(i, 8)
        n = int(self.directories[level][block]) + int(np.bitwise_count(bits[block * RANK_BITS // 8 : byte]).sum())
        return n + (int(bits[byte] & ((1 << bit) - 1)).bit_count() if bit else 0)


def write_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A file's bytes: magic, counts, doc ids, document lengths, then each level's size, chunks, bitmap and directory."""
    codes = Codes.encode(np.concatenate(ids))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [MAGIC, struct.pack("<IQI", len(doc_ids), len(codes), len(codes.chunks)), known.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(x) for x in ids], "<u4").tobytes()]
    for chunk, bits, directory in zip(codes.chunks, codes.bitmaps, codes.directories):
        parts += [struct.pack("<Q", len(chunk)), chunk.tobytes(), bits.tobytes(), directory.tobytes()]
    return b"".join(parts)


def read_file(raw: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """Doc ids, lengths and codes of a file."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    n_docs, _, levels = struct.unpack_from("<IQI", raw, 4)
    at = 20

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    known, doc_ids, lengths = take("u1", n_docs), take("<i8", n_docs), take("<u4", n_docs)
    chunks, bitmaps = [], []
    for _ in range(levels):
        n = int(take("<u8", 1)[0])
        chunks.append(take("u1", n))
        bitmaps.append(take("u1", -(-n // 8)))
        take("<u4", -(-len(bitmaps[-1]) // (RANK_BITS // 8)) + 1)
    return [int(d) if k else None for d, k in zip(doc_ids, known)], lengths, Codes(chunks, bitmaps)


def treats_words_alone(library) -> bool:
    """Whether a tokenizer lower-cases and gives the words between ASCII white space ids one by one, white space none."""

    def parts(step) -> list[dict]:
        state = json.loads(step.__getstate__()) if step else {"type": "none"}
        return state.get("normalizers") or state.get("pretokenizers") or [state]

    normal, split = parts(library.normalizer), parts(library.pre_tokenizer)
    spaces = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    found = [x for x in split if x["type"] == "Split"]
    apart = found and all(x["behavior"] == "Removed" and x["invert"] and not re.compile(_CLASSES.sub("a", x["pattern"]["Regex"])).search(" ") for x in found)
    whole = all(x["type"] == "Split" or x["type"] == "ByteLevel" and not x["add_prefix_space"] for x in split)
    return bool(apart and whole and {"type": "Lowercase"} in normal and all(x["type"] in ("NFC", "Lowercase") or x == spaces for x in normal))


#: Character classes that hold no white space.
_CLASSES = re.compile(r"\[(?:\^\\s)?(?:\\p\{[LN]\})+\]")


class WordTokenizer:
    """Ids of a `tokenizers` file, with a bounded table of the words seen.

    Where the tokenizer treats words alone, texts are cut into words and the table, by the words' hashes, is asked for
    all words at once, so only words that are new come to the library; otherwise it gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.by_words = treats_words_alone(self.library)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.table = words.WordTable(self.dtype)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for part in batched(texts, 4096) for e in self.library.encode_batch_fast(part, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each with the end id, and the texts' offsets."""
        raw, at = text_bytes(column)
        special = [] if self.by_words else np.arange(len(column)).tolist()
        if self.by_words:  # words of special tokens aren't lower-cased, so these texts don't share the table
            special = np.flatnonzero(pc.fill_null(pc.match_substring(column, "<|"), False)).tolist()
        ours = np.ones(len(column), bool)
        ours[special] = False
        starts, ends, first = words.bounds(raw, at)
        plain = np.repeat(ours, np.diff(first))
        data = raw.tobytes()

        def encode(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found = self.ids([data[a:z].decode() for a, z in zip(starts[plain][new].tolist(), ends[plain][new].tolist())])
            return np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found) if found else np.zeros(0, self.dtype)

        ids, size = words.encoded(self.table, words.hashes(raw, starts, ends)[plain], encode)
        per_word = np.zeros(len(starts) + 1, np.int64)
        per_word[1:][plain] = size
        per_text = np.diff(np.cumsum(per_word)[first])
        whole = self.ids([data[at[k] : at[k + 1]].decode() for k in special])
        per_text[special] = list(map(len, whole))
        offsets = np.concatenate([[0], np.cumsum(per_text + 1)])
        out = np.full(offsets[-1], END_ID, self.dtype)
        body = np.ones(len(out), bool)
        body[offsets[1:] - 1] = False
        for k, x in zip(special, whole):
            out[offsets[k] : offsets[k] + len(x)] = x
            body[offsets[k] : offsets[k] + len(x)] = False
        out[body] = ids
        return out, offsets


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def ranges(docs: DataFrame) -> list[int]:
    """Ascending doc_ids that cut the documents into ranges of about equal text, at most RANGES of them."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).filter("doc_id is not null")
    span = known.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("size").alias("size")).first()
    if span.size is None:
        return []
    width = (span.high - span.low) // HISTOGRAM + 1
    # a histogram of bounded length: a bin is cut no further, so ids that stand close together share a range
    bins = known.groupBy(((F.col("doc_id") - span.low) / width).cast("long").alias("bin")).agg(F.sum("size").alias("size")).orderBy("bin").collect()
    parts = min(RANGES, max(1, -(-span.size // RANGE_BYTES)))
    cuts, held = [], 0
    for r in bins:
        if held * parts >= span.size * (len(cuts) + 1) and len(cuts) < parts - 1:
            cuts.append(span.low + r.bin * width)
        held += r.size
    return cuts


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """shard, doc_id and ids of each document with the end id; a shard holds a range of doc_ids, rows of one id first by text."""
    cuts = ranges(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = tokenizer(path), np.array(cuts, np.int64)
        for b in slices(batches, max_bytes=ENCODE_BYTES):
            ids, offsets = own.encode(b.column("text"))
            shard = np.searchsorted(at, b.column("doc_id").fill_null(-(1 << 63)).to_numpy(), side="right")
            ends = (offsets * own.dtype.itemsize).astype(np.int64)
            packed = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b.column("doc_id"), packed.cast(pa.binary())], names=["shard", "doc_id", "ids"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "shard int, doc_id long, ids binary")
    return out.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")


def write(docs: DataFrame, path: str) -> DataFrame:
    """Write the files and return their table: shard, file, n_docs, n_tokens, content."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = tokenizer(path).dtype
        shard, file, doc_ids, ids, held = None, 0, [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"shard": shard, "file": file, "n_docs": len(doc_ids), "n_tokens": held, "content": write_file(doc_ids, ids)}], pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("content", pa.binary())]))

        for b in batches:
            for s, d, x in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "ids"))):
                x = np.frombuffer(x, wide)
                if doc_ids and (s != shard or held + len(x) > FILE_TOKENS):
                    yield close()
                    file, doc_ids, ids, held = file + 1 if s == shard else 0, [], [], 0
                shard, held = s, held + len(x)
                doc_ids.append(d)
                ids.append(x)
        if doc_ids:
            yield close()

    return materialise(tokenise(docs, path).mapInArrow(run, "shard int, file int, n_docs long, n_tokens long, content binary"), "token-files")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("in_shard"))
    shards = shards.select("shard", (F.sum("in_shard").over(Window.orderBy("shard")) - F.col("in_shard")).alias("before_shard"))
    before = files.select("shard", "file", "n_tokens").withColumn("before", F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("file")) - F.col("n_tokens")).join(shards, "shard").select("shard", "file", (F.col("before_shard") + F.col("before")).alias("before"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, file, content in zip(*(b.column(c) for c in ("shard", "file", "content"))):
                doc_ids, lengths, codes = read_file(content.as_py())
                ends = np.cumsum(lengths, dtype=np.int64)
                ids = codes.decode().astype("<u4")
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(ends - lengths, ends)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * n, pa.int32()), pa.array([file.as_py()] * n, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["shard", "file", "doc_id", "at", "n_tokens", "ids_crc32"])

    found = files.select("shard", "file", "content").mapInArrow(run, "shard int, file int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(before, ["shard", "file"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
