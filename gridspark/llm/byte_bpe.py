"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens with their positions. Within a group of documents (``GROUP_BYTES`` of text) positions are written
as a dictionary code per position, most frequent first, so a group lists each of its words once. The groups' words meet in one
shuffle by word, where each distinct word is encoded once whatever the number of groups that have it; the ids go back to the
groups, and there, with words in their positions again, documents are put together. Decoding joins the ids to the token-byte
table, which is as large as the vocabulary and is broadcast.

A group is bounded by its bytes (or is one document), so no task holds more than a group. Groups lie in a bucketed table in the
shared folder: its codes are written once and never shuffled, and a lost executor can't mix the groups of two attempts.

Defined results: a null or empty text has 0 tokens, and both digests are those of the empty string. Repeated rows give repeated
results. ``keep`` columns named like an output are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table

#: UTF-8 bytes of text that share a dictionary, and encoded words that a task remembers at once.
GROUP_BYTES = 16 << 20
KNOWN = 400_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank of a vocabulary with a base64 token and its rank per line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: bytes):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(vocabulary), special_tokens={})


@functools.lru_cache(maxsize=2)
def _tokens(vocabulary: bytes) -> tuple[list[bytes], list[str]]:
    """Of each id its bytes, from the token-byte table, and its decimal form."""
    ranks = read_ranks(vocabulary)
    size = max(ranks.values(), default=-1) + 1
    pieces = [b""] * size
    for piece, i in ranks.items():
        pieces[i] = piece
    return pieces, [str(i) for i in range(size)]


# --------------------------------------------------------------------------- compact forms


def pack(numbers: np.ndarray) -> bytes:
    """Numbers under 2**32 as four planes of bytes, compressed; for small numbers the upper planes take nearly nothing."""
    n = np.ascontiguousarray(numbers, np.uint32)
    raw = np.ascontiguousarray(n.view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(n).to_bytes(4, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    raw = pa.decompress(data[4:], 4 * n, "zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def pack_words(words: list[str]) -> bytes:
    lengths, text = pack(np.fromiter(map(len, words), np.uint32, len(words))), "".join(words).encode()
    return len(lengths).to_bytes(4, "little") + lengths + len(text).to_bytes(8, "little") + (pa.compress(text, "zstd", asbytes=True) if text else b"")


def unpack_words(data: bytes) -> list[str]:
    k = 4 + int.from_bytes(data[:4], "little")
    ends = np.cumsum(unpack(data[4:k]), dtype=np.int64).tolist()
    size = int.from_bytes(data[k : k + 8], "little")
    text = pa.decompress(data[k + 8 :], size, "zstd", asbytes=True).decode() if size else ""
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


# --------------------------------------------------------------------------- steps


class _Group:
    """Documents whose words share a dictionary."""

    def __init__(self, number: int):
        self.number, self.size, self.rows, self.codes = number, 0, [], []
        self.words: dict[str, int] = defaultdict(lambda: len(self.words))

    def add(self, row: tuple, words: list[str], size: int) -> None:
        self.rows.append(row)
        self.codes.append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
        self.size += size

    def batches(self, schema: pa.Schema, parts: int):
        """The group's documents, then its dictionary in parts by the words' hash."""
        used = np.bincount(np.concatenate(self.codes), minlength=len(self.words)) if self.words else np.zeros(0, np.int64)
        order = np.argsort(-used, kind="stable")
        to = np.empty(len(order), np.uint32)
        to[order] = np.arange(len(order), dtype=np.uint32)
        n = len(self.rows)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), schema, strict=False)] if len(schema) > 5 else []
        yield pa.RecordBatch.from_arrays([*columns, pa.array([self.number] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array([pack(to[c]) for c in self.codes], pa.binary()), pa.nulls(n, pa.binary())][: len(schema)], schema=schema)
        words = list(self.words)
        part = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words)) % parts
        by_part = np.lexsort((to, part))
        found, at = np.unique(part[by_part], return_index=True)
        lists = [by_part[a:b] for a, b in zip(at, [*at[1:], len(by_part)], strict=True)]
        m = len(found)
        columns = [pa.nulls(m, f.type) for f in list(schema)[:-5]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([self.number] * m, pa.int64()), pa.array(found, pa.int32()), pa.array([pack_words([words[i] for i in x]) for x in lists], pa.binary()), pa.nulls(m, pa.binary()), pa.array([pack(np.diff(to[x], prepend=np.uint32(0))) for x in lists], pa.binary())], schema=schema)


OWN = [T.StructField("_g", T.LongType()), T.StructField("_part", T.IntegerType()), T.StructField("_words", T.BinaryType()), T.StructField("_codes", T.BinaryType()), T.StructField("_steps", T.BinaryType())]


def split_words(docs: DataFrame, text: str, keep: list[str], parts: int, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows of documents (``keep``, _g, _codes) and of dictionaries (_g, _part, _words, _steps: differences of the words' codes)."""
    own = [("_g", pa.int64()), ("_part", pa.int32()), ("_words", pa.binary()), ("_codes", pa.binary()), ("_steps", pa.binary())]
    at, spots = docs.columns.index(text), [docs.columns.index(c) for c in keep]

    def run(batches):
        find = regex.compile(pattern).findall
        number = TaskContext.get().partitionId() << 32
        group = _Group(number)
        for b in batches:
            schema = pa.schema([*((c, b.column(i).type) for c, i in zip(keep, spots, strict=True)), *own])
            kept = [b.column(i).to_pylist() for i in spots]
            texts = b.column(at)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
            for i in range(b.num_rows):
                t = texts[i].as_py() or ""
                group.add(tuple(c[i] for c in kept), find(t), sizes[i])
                if group.size >= GROUP_BYTES:
                    yield from group.batches(schema, parts)
                    number += 1
                    group = _Group(number)
        if group.rows:
            yield from group.batches(schema, parts)

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + OWN))


def encode_words(spark: SparkSession, listed: DataFrame, vocabulary: bytes, parts: int) -> DataFrame:
    """Dictionary rows, brought together by the words' hash -> (_g, _steps, _lengths, _ids): each distinct word encoded once."""
    packed = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        merge = _encoder(packed.value)._encode_single_piece
        known: dict[str, list[int]] = {}
        for b in batches:
            lengths, ids = [], []
            for row in b.column(1).to_pylist():
                out = []
                for w in unpack_words(row):
                    if (x := known.get(w)) is None:
                        if len(known) >= KNOWN:  # memory stays bounded; a word forgotten may be encoded again
                            known.clear()
                        x = known[w] = merge(w)
                    out.append(x)
                lengths.append(pack(np.fromiter(map(len, out), np.uint32, len(out))))
                ids.append(pack(np.array([i for x in out for i in x], np.uint32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(lengths, pa.binary()), pa.array(ids, pa.binary())], names=["_g", "_steps", "_lengths", "_ids"])

    return listed.repartition(parts, "_part").select("_g", "_words", "_steps").mapInArrow(run, "_g long, _steps binary, _lengths binary, _ids binary")


class Dictionary:
    """A group's words as token ids, by code."""

    def __init__(self, rows: pa.Table):
        codes = [np.cumsum(unpack(x), dtype=np.int64) for x in rows["_steps"].to_pylist()]
        lengths = [unpack(x) for x in rows["_lengths"].to_pylist()]
        ids = [unpack(x) for x in rows["_ids"].to_pylist()]
        none = np.zeros(0, np.int64)
        code, n, flat = np.concatenate([none, *codes]), np.concatenate([none, *lengths]), np.concatenate([none, *ids])
        starts = np.cumsum(n) - n
        self.lengths, self.starts, self.flat = np.empty(len(code), np.int64), np.empty(len(code), np.int64), flat
        self.lengths[code], self.starts[code] = n, starts

    def ids(self, codes: np.ndarray) -> np.ndarray:
        n = self.lengths[codes]
        return self.flat[np.repeat(self.starts[codes] - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int32)

    def forms(self, pieces: list[bytes], said: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each code its bytes, by joining its ids to the token-byte table, and its ids in decimal."""
        flat, raw, decimal = self.flat.tolist(), np.empty(len(self.starts), object), np.empty(len(self.starts), object)
        for c, (a, n) in enumerate(zip(self.starts.tolist(), self.lengths.tolist(), strict=True)):
            x = flat[a : a + n]
            raw[c], decimal[c] = b"".join([pieces[i] for i in x]), " ".join([said[i] for i in x])
        return raw, decimal


def encode(spark: SparkSession, docs: DataFrame, text: str = "text", keep: list[str] | None = None, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256 and decoded_sha256 (and token_ids if asked for) of each document."""
    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        data = f.read()
    added = ["n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * with_ids]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {*added, *(f.name for f in OWN)}]
    scratch, parts = Scratch(spark, "bpe"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = split_words(docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text]))), text, keep, parts)
    split = scratch.write_bucketed(split, "words", "_g", parts)
    packed = spark.sparkContext.broadcast(data)
    encoded = encode_words(spark, split.where("_words is not null").select(F.col("_g").alias("_of"), "_words", "_steps", "_part").withColumnRenamed("_of", "_g"), data, parts)
    out = T.StructType([*(split.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *[T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * with_ids])

    def join_up(documents: pa.Table, rows: pa.Table) -> pa.Table:
        known = Dictionary(rows)
        raw, decimal = known.forms(*_tokens(packed.value))
        n, ids_hash, text_hash, all_ids = [], [], [], []
        for x in documents["_codes"].to_pylist():
            codes = unpack(x).astype(np.int64)
            n.append(int(known.lengths[codes].sum()))
            ids_hash.append(hashlib.sha256(" ".join(decimal[codes].tolist()).encode()).hexdigest())
            text_hash.append(hashlib.sha256(b"".join(raw[codes].tolist())).hexdigest())
            if with_ids:
                all_ids.append(known.ids(codes))
        columns = [*(documents[c] for c in keep), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string()), *([pa.array(all_ids, pa.list_(pa.int32()))] if with_ids else [])]
        return pa.table(columns, names=[f.name for f in out])

    coded = split.where("_codes is not null").select(*keep, "_g", "_codes")
    return coded.groupBy("_g").cogroup(encoded.groupBy("_g")).applyInArrow(join_up, out)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark, table(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
