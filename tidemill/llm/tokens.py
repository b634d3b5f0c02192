"""Token ids in bit-plane files.

Texts are encoded with a given tokenizer, an end id is appended to each, and the ids are written in ascending order of
doc_id. The file format: a row is a bundle of consecutive documents with their lengths; its payload is a run of
chunks, and ``index`` holds where each chunk starts. A chunk has a fixed number of ids (the last of a bundle fewer),
transposed into byte planes (or bit planes), each plane compressed with zstandard behind a small header. Spark's
Parquet writer stores the rows, so files are committed whole and any store that Spark reaches will do.

A text is split before spaces that always begin a token of the byte-level pattern; each distinct piece is encoded by the
tokenizer once a worker and looked up after that, by its hash and then its bytes. A text that holds the string of a special token is encoded whole.

Defined results: a null text is an empty one and yields the end id alone; a row without doc_id comes first; repeated
ids are documents of their own, in the order of their texts' hashes; other columns are ignored; an empty table gives
an empty file and result.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.store import materialise, table, texts
from tidemill.llm.words import equal, hashes, slices

CHUNK, BUNDLE, MAGIC = 1 << 16, 1 << 20, b"BPS1"
#: A token begins at a space before one of these bytes, whatever stands before: no white space begins with them.
_OPENS = np.zeros(256, dtype=bool)
_OPENS[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


class Encoder:
    """A tokenizer's ids of many texts at once, with the ids of distinct pieces kept (and let go past ``most``)."""

    def __init__(self, path: str, most: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.most = Tokenizer.from_file(path), most
        self.specials = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.at, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def plain(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, h: np.ndarray, raw: list[bytes]) -> None:
        new = self.plain([x.decode() for x in raw])
        length = np.array([len(x) for x in raw], np.int64)
        place = len(self.bytes) + np.cumsum(length) - length
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(raw), np.uint8)])
        size = np.array([len(x) for x in new], np.int64)
        begin = len(self.ids) + np.cumsum(size) - size
        at = np.searchsorted(self.known, h)
        self.known, self.begin, self.size, self.at, self.length = (np.insert(x, at, y) for x, y in ((self.known, h), (self.begin, begin), (self.size, size), (self.at, place), (self.length, length)))
        self.ids = np.concatenate([self.ids, *[np.array(x, np.uint32) for x in new]])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin."""
        raw = data.tobytes()
        if any(s in raw for s in self.specials):
            each = [np.array(x, np.uint32) for x in self.plain([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        n = len(data)
        opens = np.zeros(n + 1, dtype=bool)
        if n > 1:
            opens[: n - 1] = (data[:-1] == 0x20) & _OPENS[data[1:]]
        opens[offsets[:-1][np.diff(offsets) > 0]] = True
        # a space that ends a text opens nothing, though the next text may begin with such a byte
        ends = offsets[1:][np.diff(offsets) > 1] - 1
        opens[ends[data[ends] == 0x20]] = False
        start = np.flatnonzero(opens)
        end = np.append(start[1:], n)
        h = hashes(data, start, end, lower=False)
        u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, u)
        miss = np.ones(len(u), dtype=bool) if not len(self.known) else self.known[np.minimum(at, len(self.known) - 1)] != u
        if len(self.known) + miss.sum() > self.most:
            self.clear()
            miss[:] = True
        if miss.any():
            self._learn(u[miss], [raw[a:b] for a, b in zip(start[first[miss]], end[first[miss]], strict=True)])
            at = np.searchsorted(self.known, u)
        at, ids = at[inverse], self.ids
        begin, size = self.begin[at], self.size[at]
        # a hash alone proves nothing: a piece whose bytes are not those known under its hash is encoded by itself
        other = np.flatnonzero((self.length[at] != end - start) | ~equal(self.bytes, self.at[at], data, start, np.minimum(end - start, self.length[at])))
        if len(other):
            own = [np.array(x, np.uint32) for x in self.plain([raw[start[i] : end[i]].decode() for i in other])]
            size[other] = [len(x) for x in own]
            begin[other] = len(ids) + np.cumsum(size[other]) - size[other]
            ids = np.concatenate([ids, *own])
        total = np.cumsum(size)
        take = np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)
        return ids[take], np.concatenate([[0], total])[np.searchsorted(start, offsets)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(ids: np.ndarray, kind: str = "byte", level: int = 3) -> bytes:
    """One chunk: header, then the zstandard frame of each plane."""
    zip_ = zstandard.ZstdCompressor(level=level)
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(len(ids), 4)
    planes = raw.T if kind == "byte" else np.packbits(np.unpackbits(raw, axis=1, bitorder="little"), axis=0).T
    frames = [zip_.compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    return MAGIC + struct.pack("<IBB", len(ids), kind == "bit", len(frames)) + struct.pack(f"<{len(frames)}I", *map(len, frames)) + b"".join(frames)


def unpack(chunk: bytes | memoryview) -> np.ndarray:
    if bytes(chunk[:4]) != MAGIC:
        raise ValueError("not a chunk of planes")
    n, bits, k = struct.unpack_from("<IBB", chunk, 4)
    sizes = struct.unpack_from(f"<{k}I", chunk, 10)
    at, unzip, planes = 10 + 4 * k, zstandard.ZstdDecompressor(), []
    for size in sizes:
        planes.append(np.frombuffer(unzip.decompress(bytes(chunk[at : at + size])), np.uint8))
        at += size
    both = np.stack(planes, axis=1)
    if bits:
        both = np.packbits(np.unpackbits(both, axis=0)[:n], axis=1, bitorder="little")
    return np.ascontiguousarray(both).view("<u4").reshape(-1)


FILE = "shard int, bundle int, n_ids long, doc_ids array<long>, lengths array<long>, index array<long>, payload binary"


def _writer(path: str, end_id: int, kind: str):
    def bundle(no: int, docs: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(parts)
        chunks = [pack(ids[i : i + CHUNK], kind) for i in range(0, len(ids), CHUNK)]
        index = np.concatenate([[0], np.cumsum([len(c) for c in chunks])[:-1]]).astype(np.int64)
        row = {"shard": TaskContext.get().partitionId(), "bundle": no, "n_ids": len(ids), "doc_ids": docs, "lengths": [len(p) for p in parts], "index": index, "payload": b"".join(chunks)}
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, no, docs, parts, size = encoder(path), 0, [], [], 0
        for b in batches:
            ids_of = b["doc_id"].to_pylist()
            for i, j, data, offsets in slices(b["text"], (1 << 21) - 2):
                ids, cuts = enc.encode(data, offsets)
                for d, x, y in zip(ids_of[i:j], cuts[:-1], cuts[1:], strict=True):
                    docs.append(d)
                    parts.append(np.append(ids[x:y], np.uint32(end_id)))
                    size += len(parts[-1])
                    if size >= BUNDLE:
                        yield bundle(no, docs, parts)
                        no, docs, parts, size = no + 1, [], [], 0
        if docs:
            yield bundle(no, docs, parts)

    return write


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "byte") -> DataFrame:
    """Encode all of ``docs`` and write the file; returns it as read back (columns FILE)."""
    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return materialise(rows.mapInArrow(_writer(tokenizer, end_id, kind), FILE), "tokens")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            view, cuts = memoryview(r["payload"]), [*r["index"], len(r["payload"])]
            ids = np.concatenate([unpack(view[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
            ends = np.cumsum(np.array(r["lengths"], np.int64))
            begins = ends - np.array(r["lengths"], np.int64)
            crc = [zlib.crc32(ids[x:y].tobytes()) for x, y in zip(begins, ends, strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["shard"]] * n, pa.int32()), pa.array([r["bundle"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(begins), pa.array(r["lengths"], pa.int64()), pa.array(crc, pa.int64())],
                ["shard", "bundle", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_tokens(file: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in a token file.

    A bundle's start comes from the bundles' sizes alone: a running sum within each shard, and one over the shards.
    """
    sizes = file.select("shard", "bundle", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = shards.select("shard", (F.sum("ids").over(W.orderBy("shard")) - F.col("ids")).alias("shard_start"))
    begins = sizes.join(before, "shard").select("shard", "bundle", (F.col("shard_start") + F.sum("n_ids").over(W.partitionBy("shard").orderBy("bundle")) - F.col("n_ids")).alias("begin"))
    docs = file.select("shard", "bundle", "doc_ids", "lengths", "index", "payload").mapInArrow(_reader, "shard int, bundle int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(begins, ["shard", "bundle"]).select("doc_id", (F.col("begin") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_file(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file(table(spark, sf_dir, "documents"))
