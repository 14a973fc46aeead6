"""Token counts through a cache keyed by content and tokenizer digests.

The key of a text is the SHA-256 of its normalised form; the cache is a Parquet table (content, tokenizer, n_tokens) that can be
kept between runs. Texts whose key is in the cache are not encoded again; of the others, each distinct one is encoded once and
its count appended to the cache; then all rows are joined to their counts.

Normalising only undoes differences that the tokenizer itself ignores (ASCII letter case, and how much ASCII white space there is), so equal
keys have equal counts. It is left out for texts with a special string, which the library matches before it normalises.

Hot texts: copies are dropped in each map task before the shuffle, so a text that is a third of all rows crosses it once per
task; the join back carries keys only, and Spark splits its skewed partitions.

Defined results: a null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated results. An empty table gives an empty
table. ``keep`` columns named like an output are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXT_ROWS, Scratch, arrow_map, table

#: So many texts are held as Python objects at once.
ROWS = 256
CACHE = "content binary, tokenizer string, n_tokens bigint"


def tokenizer_digest(data: bytes) -> str:
    """Names a tokenizer's version: any change of its file gives another digest."""
    return hashlib.sha256(data).hexdigest()


@functools.lru_cache(maxsize=2)
def _tokenizer(data: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(data.decode())
    t.no_padding()
    t.no_truncation()
    return t


def count_json(data: bytes, texts: list[str]) -> list[int]:
    t = _tokenizer(data)
    batch = getattr(t, "encode_batch_fast", t.encode_batch)
    return [len(e.ids) for e in batch(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def _pieces(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def count_model(data: bytes, texts: list[str]) -> list[int]:
    return [len(x) for x in _pieces(data).encode(texts, num_threads=1)]


def normaliser(data: bytes, kind: str):
    """A function from a text to the bytes that its key digests. It normalises only for tokenizers whose file says that they ignore it."""
    about = json.loads(data) if kind == "json" else {}
    steps = (about.get("normalizer") or {}).get("normalizers", [about.get("normalizer") or {}])
    folds_case = any(s.get("type") == "Lowercase" for s in steps)
    first = ((about.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    drops_space = first.get("behavior") == "Removed" and first.get("invert") and "\\s" in str(first.get("pattern"))
    special = [s["content"].encode() for s in about.get("added_tokens", [])]
    if not (folds_case and drops_space):
        return lambda raw: raw
    # A leading byte keeps the two kinds of keys apart. Lower case and white space of bytes are ASCII's.
    return lambda raw: b"=" + raw if any(x in raw for x in special) else b"~" + b" ".join(raw.lower().split())


def _distinct(batches):
    """Of the rows (key, text) of a task, the first of each key, some rows at a time. Remembers keys only."""
    seen: set[bytes] = set()
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part, fresh = b.slice(at, ROWS), []
            for i, k in enumerate(part.column(0).to_pylist()):
                if k not in seen:
                    seen.add(k)
                    fresh.append(i)
            if fresh:
                yield part.take(pa.array(fresh))


def count_tokens(spark: SparkSession, docs: DataFrame, cache: str, tokenizer: str | None = None, text: str = "text", keep: list[str] | None = None, limit: int = 2048) -> DataFrame:
    """``keep`` columns with n_bytes, n_tokens and over_limit; appends what it had to encode to the cache table at ``cache``."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    kind = path.rpartition(".")[2]
    with open(path, "rb") as f:
        data = f.read()
    name, packed, count = tokenizer_digest(data), spark.sparkContext.broadcast(data), {"json": count_json, "model": count_model}[kind]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {"n_bytes", "n_tokens", "over_limit", "_key"}]
    normal = normaliser(data, kind)

    def keys(texts: pa.Array) -> list[pa.Array]:
        """Each text's key and bytes; some texts at a time, so that memory stays bounded."""
        digests, sizes = [], []
        for at in range(0, len(texts), ROWS):
            for x in texts.slice(at, ROWS).fill_null("").cast(pa.binary()).to_pylist():
                digests.append(hashlib.sha256(normal(x)).digest())
                sizes.append(len(x))
        return [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())]

    def keyed_texts(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                texts = b.column(0).slice(at, ROWS).fill_null("")
                yield pa.RecordBatch.from_arrays([keys(texts)[0], texts], names=["_key", "_text"])

    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)  # a new cache is an empty table
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == name)
    misses = docs.select(F.col(f"`{text}`")).mapInArrow(lambda batches: _distinct(keyed_texts(batches)), "_key binary, _text string")
    old = not stored.isEmpty()
    if old:
        misses = misses.join(stored.select(F.col("content").alias("_key")), "_key", "left_anti")

    def encode(batches):
        for b in _distinct(batches):
            n = count(packed.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name] * b.num_rows, pa.string()), pa.array(n, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    misses.repartition("_key").mapInArrow(encode, CACHE).write.mode("append").option("compression", "zstd").parquet(cache)
    scratch = Scratch(spark, "token-counts")
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])))
    keyed = arrow_map(rows, text, keys, [T.StructField("_key", T.BinaryType()), T.StructField("n_bytes", T.LongType())], keep)
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == name).select(F.col("content").alias("_key"), "n_tokens")
    if old:
        # What other runs have stored is most of the cache: only this run's keys go on.
        keyed = scratch.write(keyed, "keys", TEXT_ROWS)
        counts = counts.join(keyed.select("_key").distinct(), "_key", "left_semi")
    # Two runs at once may both have stored a key: their counts are equal. Written, so that the join by key has exchanges of its own and
    # Spark can split a hot text's rows.
    counts = scratch.write(counts.groupBy("_key").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    out = keyed.join(counts, "_key")
    return out.select(*(F.col(f"`{c}`") for c in keep), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return count_tokens(spark, docs, Scratch(spark, "token-cache").path("cache"), keep=["doc_id"])
