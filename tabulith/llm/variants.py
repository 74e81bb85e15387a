"""Spelling variants of a vocabulary by anagram hashing: words that one inserted, deleted or replaced letter sets apart, and their roots."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import stash

LEAST_LETTERS, LEAST_COUNT = 6, 5
#: A near word is a word's form if it is at least so many times as frequent.
TIMES = 5
#: Runs whose crc32 this divides lose a letter.
SLIP = 199
#: Distinct words that a worker adds up before it hands them on.
HELD = 200_000
#: Keys are sums modulo this prime, so that no word is too long for them.
PRIME = (1 << 61) - 1

#: In Latin-1: a-z and U+00C0 to U+00FF stay, A-Z become a-z, all other bytes blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 0x20 for b in range(256))


def letter_runs(text: str) -> list[bytes]:
    """The maximal runs of letters, A-Z lower-cased, in Latin-1; code points from U+0100 up become ``?``, which is no letter."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def slipped(run: bytes, start: int) -> bytes:
    """The run as it is counted; ``start`` is the crc32 of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with at least LEAST_LETTERS letters and LEAST_COUNT places; a worker adds up its words before they are shuffled.

    A null id counts as an empty one, a null text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                for found, n in Counter(w for w in letter_runs(text.as_py()) if len(w) >= LEAST_LETTERS).items():
                    word = slipped(found, start)
                    if len(word) >= LEAST_LETTERS:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield hand_on()
        if held:
            yield hand_on()

    parts = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _power(letter: Column) -> Column:
    """The value of a letter in anagram keys: the fifth power of its code point."""
    c = F.ascii(letter).cast("long")
    return c * c * c * c * c


def anagram_key(letters: Column) -> Column:
    """The sum of the letters' values: equal for all orders of the same letters."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda s, x: (s + _power(x)) % PRIME)


def probes(words: DataFrame) -> DataFrame:
    """Rows (key, mark, side, gone, word, n) that meet where two words differ by one added, removed or exchanged letter value.

    A word of L letters stands for itself less one letter, once for each letter it has: words with equal keys then differ by an exchange.
    It also stands for itself as what remains of a word of L + 1 letters (``gone`` is null).  One change leaves the half of a word that it
    is not in as it was, so ``mark`` holds the length and that half: ``side`` 0 if the change is in the second half, 1 if in the first.
    Words of the same letters in other orders meet only if they share a half.
    """
    keyed = words.withColumn("_l", F.split("word", "")).withColumn("_k", anagram_key(F.col("_l")))
    size, word = F.size("_l"), F.col("word")
    half, longer = F.floor(size / 2).cast("int"), F.floor((size + 1) / 2).cast("int")

    def less(side: int, letters: Column, same: Column) -> Column:
        row = lambda x: F.struct(((F.col("_k") - _power(x) + PRIME) % PRIME).alias("key"), F.xxhash64(size, F.lit(side), same).alias("mark"), F.lit(side).alias("side"), x.alias("gone"))
        return F.transform(F.array_distinct(letters), row)

    def short(side: int, same: Column) -> Column:
        return F.struct(F.col("_k").alias("key"), F.xxhash64(size + 1, F.lit(side), same).alias("mark"), F.lit(side).alias("side"), F.lit(None).cast("string").alias("gone"))

    rows = F.concat(
        less(0, F.slice("_l", half + 1, size - half), F.substring(word, F.lit(1), half)),
        less(1, F.slice("_l", F.lit(1), half), F.substring(word, half + 1, size)),
        F.array(short(0, F.substring(word, F.lit(1), longer)), short(1, F.substring(word, longer, size))),
    )
    return keyed.select("word", "n", F.explode(rows).alias("_p")).select("_p.*", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """Each pair of near words once: (a, a_n, b, b_n).

    Exchanges are taken with a < b, additions with a the longer word.  A pair meets at most once on each side; one that agrees in the first
    half already met on side 0.  The order of the letters is verified by the edit distance.
    """
    rows = probes(words)
    a = rows.where("gone is not null").select("key", "mark", F.col("side").alias("a_side"), F.col("gone").alias("a_gone"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = rows.select("key", "mark", F.col("side").alias("b_side"), F.col("gone").alias("b_gone"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    exchange = F.col("b_gone").isNotNull() & (F.col("a_gone") != F.col("b_gone")) & (F.col("a") < F.col("b")) & (F.length("a") == F.length("b"))
    addition = F.col("b_gone").isNull() & (F.length("a") == F.length("b") + 1)
    half = F.floor(F.length("a") / 2).cast("int")
    first = (F.col("a_side") == 0) | (F.substring(F.col("a"), F.lit(1), half) != F.substring(F.col("b"), F.lit(1), half))
    met = a.join(b.hint("merge"), ["key", "mark"]).where((F.col("a_side") == F.col("b_side")) & (exchange | addition) & first)
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def with_forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n): the count of near words, and the most frequent of them (ties: the first in code-point order) if it is ``times`` as frequent."""
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("m")))
    near = near_pairs(words).select(F.explode(both).alias("_p")).select("_p.*")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("_best"))
    found = words.join(best.hint("merge"), "word", "left")
    forms = -F.col("_best.m") >= times * F.col("n")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(forms, F.col("_best.other")).alias("form"), F.when(forms, -F.col("_best.m")).alias("form_n"))


def with_roots(forms: DataFrame, times: int = TIMES) -> DataFrame:
    """Add ``root``: the word that forms lead to.  Each round doubles the steps taken; as a form is ``times`` as frequent, a chain is short."""
    most = forms.agg(F.max("n").alias("n")).first().n or 1
    steps = math.ceil(math.log(most, times)) + 1
    root = forms.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        ahead = root.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        root = stash(root.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return forms.join(root.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the documents.

    Null texts have no words, empty tables none; rows that share an id or a text each count; a word without near words is its own root.
    Other columns are not read.
    """
    words = stash(word_counts(docs), "words")
    return with_roots(stash(with_forms(words), "forms")).select("word", "form", "root", "n", "n_near", "form_n")
