"""Token counts through a digest cache that is kept between calls.

The cache is a Parquet table of (content, tokenizer, n_tokens): the digest of a
normalised text, the digest of a tokenizer version (vocabulary file, library and
its version), and the count.  Digests are made and joined without any text; only
texts whose digests the cache lacks are encoded, once each, and their counts are
appended.  A few missed texts are encoded where they lie, by one row each.  More of
them are moved once, compressed, to the tasks that encode them; a text that very many
rows share is sent by one of them alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.batches import Rows, strings, utf8
from tabweave.llm.hot import hot_keys, join_on_hot
from tabweave.llm.scratch import Scratch, shared_dir

CACHE = "content binary, n_tokens long, tokenizer string"
ENCODE_CHARS = 1 << 20
#: Most missed texts whose digests are sent to the rows (about 100 bytes each).
FEW = 20_000


@lru_cache(maxsize=4)
def loaded(path: str) -> Callable[[list[str]], list[int]]:
    """Counts by the library of the vocabulary file, defaults as the library has them."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


def tokenizer_digest(path: str) -> str:
    """Digest of a tokenizer version: the vocabulary file's bytes, its library and the library's version."""
    import importlib.metadata

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        own = hashlib.file_digest(f, "sha256")
    own.update(f"{library} {importlib.metadata.version(library)}".encode())
    return own.hexdigest()


def same_space(path: str) -> bool:
    """Whether the vocabulary's own normalisation makes the sign U+2581 and the space one character."""
    if not path.endswith(".model"):
        return False
    import sentencepiece

    normal = sentencepiece.SentencePieceProcessor(model_file=path).normalize
    return all(normal(t) == normal(t.replace("\u2581", " ")) for t in ("a\u2581b", "\u2581\u2581a \u2581", "\u2581"))


def _sent():
    """Digest and compressed text, once per distinct text of a task."""
    schema = pa.schema([("content", pa.binary()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen, pack = Rows(schema), set(), zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            for digest, data in zip(b["content"].to_pylist(), utf8(b["text"])):
                if digest not in seen:
                    seen.add(digest)
                    packed = pack(data)
                    yield from out.add((digest, packed), len(packed) + 64)
        yield from out.flush()

    return run


def _encoded(path: str, packed: bool):
    """Counts of the distinct texts of a task, from a column ``packed`` of compressed ones or a column ``text``."""
    schema = pa.schema([("content", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, out, seen, unpack = loaded(path), Rows(schema), set(), zstandard.ZstdDecompressor().decompress
        held: list[tuple[bytes, str]] = []

        def done() -> Iterator[pa.RecordBatch]:
            for (digest, _), n in zip(held, count([t for _, t in held])):
                yield from out.add((digest, n))
            held.clear()

        size = 0
        for b in batches:
            for digest, data in zip(b["content"].to_pylist(), b["packed"].to_pylist() if packed else strings(b["text"])):
                if digest in seen:
                    continue
                seen.add(digest)
                text = unpack(data).decode() if packed else data
                held.append((digest, text))
                size += len(text)
                if size >= ENCODE_CHARS:
                    yield from done()
                    size = 0
        yield from done()
        yield from out.flush()

    return run


def digest_of(one_space: bool, text: str = "text") -> Column:
    """Digest of the normalised content: a null counts as the empty text, and U+2581 as a space if ``one_space``."""
    whole = F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.translate(whole, "\u2581", " ") if one_space else whole, 256))


def known(spark, cache: str, version: str) -> DataFrame:
    """(content, n_tokens) that the cache holds for a tokenizer version, one row per content."""
    where = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "content binary, n_tokens long")
    spark.catalog.refreshByPath(cache)
    return spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def refresh(docs: DataFrame, path: str, cache: str, contents: DataFrame, hot: DataFrame, scratch: Scratch, few: int = FEW) -> int:
    """Append to the cache the counts of the texts of ``docs`` that it lacks; return how many it lacked.

    ``contents``: (content, n, carrier), the distinct digests of ``docs``, their rows and the smallest doc_id among
    these; ``hot``: those of very many rows.  No text is read if nothing is missed."""
    version, one_space = tokenizer_digest(path), same_space(path)
    missed = scratch.write(contents.select("content", "carrier").join(known(docs.sparkSession, cache, version), "content", "left_anti"), "missed")
    n = missed.count()
    if not n:
        return 0
    texts = docs.select("doc_id", "text", digest_of(one_space).alias("content"))
    if n <= few:
        found = texts.join(F.broadcast(missed), "content").filter("carrier is null or carrier = doc_id").select("content", "text").mapInArrow(_encoded(path, False), "content binary, n_tokens long")
        found = found.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))  # rows that repeat an id and its text
    else:
        sent = texts.join(F.broadcast(hot.select("content", "carrier")), "content", "left").filter("carrier is null or carrier = doc_id")
        sent = sent.select("content", "text").mapInArrow(_sent(), "content binary, packed binary")
        found = sent.join(missed.select("content"), "content", "left_semi").mapInArrow(_encoded(path, True), "content binary, n_tokens long")
    found.select("content", "n_tokens", F.lit(version).alias("tokenizer")).write.mode("append").partitionBy("tokenizer").parquet(cache)
    return n


def token_counts(docs: DataFrame, path: str, limit: int = 4096, cache: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Per document row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``cache``: folder of the cache; None takes the one that all calls share in the shared
    folder.  Deleting it only costs encoding again.  Null text counts as empty (0 bytes; the
    library's count of "").  Only doc_id and text are read; null ids stay null; an empty
    table gives an empty table; rows that repeat a text are encoded once.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "token-counts")
    cache = cache or f"{shared_dir(spark)}/token-count-cache"
    text = F.coalesce("text", F.lit(""))
    keyed = scratch.write(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest_of(same_space(path)).alias("content")), "keyed")
    contents = scratch.write(keyed.groupBy("content").agg(F.count("*").alias("n"), F.min("doc_id").alias("carrier")), "contents")
    hot = scratch.write(hot_keys(contents, "n", keyed.count()), "hot")
    refresh(docs, path, cache, contents, hot, scratch)
    counts = known(spark, cache, tokenizer_digest(path))
    return join_on_hot(keyed, counts, ["content"], hot).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
