"""Token counts through a cache on disk: digests of normalised texts and of the tokenizer lead to stored counts; only what is missing is encoded."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.common import lookup_groups, shared_dir, stash
from tabulith.llm.token_store import encoder

LIMIT = 2048
#: Up to so many missing digests (48 bytes each) are broadcast to where the texts are read; more are met by a shuffle.
MOST_BROADCAST = 500_000
#: Texts with at least so many equals get their count by a broadcast of such digests, of which there are at most rows / HOT.
HOT = 10_000
#: Raise this when ``normalised`` changes: it is part of a tokenizer's version.
RULES = 1
CACHE = "version string, digest binary, n_tokens long"
#: Texts are encoded in lots of at most so many, or so many code points.
LOT, LOT_CHARS = 512, 1 << 22

#: The pipeline of tokenizers that drop white space and lower-case: for these, texts can be normalised before they are compared.
LOWER_NORMALIZER = ["NFC", "Replace", "Lowercase"]


@lru_cache(maxsize=8)
def folds(path: str) -> bool:
    """Whether the tokenizer drops white space and case: BPE of lower-cased pieces, none of which holds white space."""
    if not path.endswith(".json"):
        return False
    spec = json.loads(Path(path).read_text())
    steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = [s for s in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if s["type"] == "Split"]
    return steps == LOWER_NORMALIZER and bool(splits) and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and spec["model"].get("end_of_word_suffix") == "</w>"


def normalised(text: Column, folding: bool) -> Column:
    """A text that has as many tokens: runs of ASCII white space are one blank, and A-Z are lower-cased unless a special token may stand in it."""
    if not folding:
        return text
    tight = F.trim(F.regexp_replace(text, r"[\x09-\x0D\x20]+", " "))
    return F.when(tight.contains("<|"), tight).otherwise(F.translate(tight, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def version_of(path: str) -> str:
    """A digest of the tokenizer's file, its library's version and the rules of normalisation."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    head = f"{library.__name__} {library.__version__} rules {RULES} folds {folds(path)}\n".encode()
    return hashlib.sha256(head + Path(path).read_bytes()).hexdigest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens, by the library that the file belongs to."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    if folds(path):
        words = encoder(path)
        return lambda texts: [len(ids) for ids in words.many(texts)]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return lambda texts: [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of the cache for one tokenizer version, one row a digest; none where there is no cache yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    # two jobs that ran at once may both have appended a digest
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of each row (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for batch in batches:
            found: list[int] = []
            lot: list[str] = []
            chars = 0
            for text in batch[1].to_pylist():
                lot.append(text)
                chars += len(text)
                if len(lot) >= LOT or chars >= LOT_CHARS:
                    found += count(lot)
                    lot, chars = [], 0
            found += count(lot) if lot else []
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(found, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, file, row): each row with its place in the files it is read from; other tables are written first, so that places last."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place = (F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *place)
    except AnalysisException:
        return stash(rows, "texts").select("doc_id", "text", *place)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row; what the cache lacks is encoded once, by the first row that has it, and appended to the cache.

    Texts are read twice and not shuffled: the first pass writes their digests; the second takes the texts of the chosen rows only, found by
    a broadcast of their digests and places.  Beyond ``most_broadcast`` missing digests both sides are shuffled by digest and place, which
    no group of equal texts makes uneven.
    """
    spark, folding, version = docs.sparkSession, folds(tokenizer), version_of(tokenizer)
    placed = _placed(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2(normalised(F.col("text"), folding), 256)))
    rows = stash(placed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest", "file", "row"), "digests")
    groups = stash(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("file", "row")).alias("first")), "groups")
    misses = groups.join(stored(spark, cache, version), "digest", "left_anti").select("digest", "first.file", "first.row")
    misses = stash(misses, "misses")
    n = misses.count()
    if n:
        few = F.broadcast(misses) if n <= most_broadcast else misses.hint("shuffle_hash")
        found = encode(placed.join(few, ["digest", "file", "row"]), tokenizer)
        found.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = groups.join(stored(spark, cache, version), "digest").select("digest", "copies", "n_tokens")
    return lookup_groups(rows.select("doc_id", "n_bytes", "digest"), counts, "digest", "copies", HOT).select("doc_id", "n_bytes", "n_tokens")


def op13_token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document; without ``cache``, one in the shared folder is begun.

    Null and empty texts have no bytes and no tokens.  Rows that share a text (or differ only in case and white space) are encoded once;
    rows that share an id each get a row.  An empty table gives none; other columns are not read.
    """
    cache = cache or f"{shared_dir(docs.sparkSession)}/token-counts-{uuid.uuid4().hex}"
    return count_tokens(docs, tokenizer, cache).withColumn("over_limit", F.col("n_tokens") > limit)
