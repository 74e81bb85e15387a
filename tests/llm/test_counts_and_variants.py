"""Importance resampling, spelling variants and cached token counts against brute force; nulls, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulith.llm import importance, token_counts, variants
from tabulith.llm.common import stash

#: Extra columns with names that the operators use inside.
EXTRA = ["word", "n", "digest", "file", "row", "score", "weight", "_at", "_part", "copies", "rank", "key"]
SCHEMA = "doc_id long, text string, " + ", ".join(f"{c} string" for c in EXTRA)
PATH = public_tokenizers.path("word_bpe_49k.json")


def table(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * len(EXTRA)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    stems = ["Überfall", "señorita", "straße", "banana", "abcdef", "reçoivent", "mississippi", "×÷×÷×÷×", "aaaaaa", "listener"]
    letters = "abcdefghijklmnopqrstuvwxyzàéÿßÉ"

    def changed(word):
        at = rng.randrange(len(word))
        return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word, word, word, "".join(rng.sample(word, len(word)))])

    pool = [changed(rng.choice(stems)) for _ in range(160)]
    texts = [" ".join(rng.choice(pool) if rng.random() < 0.4 else rng.choice(stems) for _ in range(rng.randint(1, 60))) for _ in range(90)]
    texts += [None, "", "   \t\n", "one two", "日本語 текст don’t x1y2 A-B_c", "<|endoftext|> a <|ENDOFTEXT|>  B", "A  b\tC", "a b c", " a b c ", "x" * 50_000, "É É é", "\x85\x1c a"]
    texts += [texts[0].upper(), texts[0]] + [texts[1]] * 40
    out = [(i, t) for i, t in enumerate(texts)]
    return [*out, out[2], out[2], (None, texts[3]), (None, None), (None, texts[3])]


def test_importance(spark, rows):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    target = [(0, "banana listener banana zoo"), (1, None), (2, "señorita")]
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    s, t = (Counter(bucket(w) for _, x in r for w in words(x)) for r in (rows, target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    want = []
    for i, x in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(w)) for w in words(x))
        want.append((i, len(words(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = [(*r, k + 1) for k, r in enumerate(able[: len(able) * 10 // 100])]
    got = importance.op11_importance(table(spark, rows), table(spark, target))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    got = [tuple(r) for r in got.collect()]
    assert sorted(r[:4] for r in got if r[0] is not None) == sorted(r for r in want if r[0] is not None)
    assert Counter(r[:4] for r in got) == Counter(want)
    assert sorted((r for r in got if r[4]), key=lambda r: r[4]) == ranks and ranks
    assert importance.op11_importance(table(spark, []), table(spark, target)).collect() == []
    # an empty target: every bucket of it counts one
    own = Counter(map(bucket, words(rows[0][1])))
    total = sum(own.values())
    alone = sum(math.floor(1000 * math.log((total + 10_000) / ((own[b] + 1) * 10_000))) * n for b, n in own.items())
    assert [r.weight for r in importance.op11_importance(table(spark, rows[:1]), table(spark, [])).collect()] == [alone]
    kept = importance.drawn(table(spark, rows), table(spark, target), 50)
    assert kept.columns == table(spark, rows).columns and kept.count() > 0


def test_importance_of_longer_runs(spark):
    docs = table(spark, [(0, "a b A"), (1, "b")])
    counts = importance.bucket_counts(docs, n=50, most=2)
    want = Counter(zlib.crc32(w) % 50 for w in [b"a", b"b", b"a", b"a b", b"b a", b"b"])
    assert {i: int(c) for i, c in enumerate(counts) if c} == want
    weights = {r.doc_id: (r.n_words, r.n_features) for r in importance.weigh(docs, counts, most=2).collect()}
    assert weights == {0: (3, 5), 1: (1, 1)}


def test_ranks_without_one_big_sort(spark):
    """Ties on everything, over more partitions than rows: ranks stay gapless and unique."""
    scored = spark.range(500).select((F.col("id") % 3).alias("doc_id"), F.lit(30).alias("n_words"), F.lit(1).cast("long").alias("weight"), (F.col("id") % 2).alias("score"))
    got = importance.draw(scored, percent=100)
    assert sorted(r.rank for r in got.collect()) == list(range(1, 501))
    order = [(-r.score, r.doc_id) for r in got.orderBy("rank").collect()]
    assert order == sorted(order)


def brute_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) < len(b):
            a, b = b, a
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    links = {w: [u for u in counts if near(w, u)] for w in counts}
    form = {}
    for w, us in links.items():
        best = min(us, key=lambda u: (-counts[u], u), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(links[w]), counts.get(form[w])) for w, n in counts.items()}


def test_variants(spark, rows):
    got = variants.op12_variants(table(spark, rows)).collect()
    want = brute_variants(rows)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(r.form is not None for r in got) > 10 and max(r.n_near for r in got) > 3
    assert variants.op12_variants(table(spark, [])).collect() == []
    assert variants.op12_variants(table(spark, [(1, None), (2, "short")])).collect() == []


def test_chains_of_forms(spark):
    counts = {"aaaaaaa": 5, "aaaaaab": 25, "aaaaabb": 125, "aaaabbb": 625, "aaabbbb": 3125, "zzzzzzz": 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: r.root for r in variants.with_roots(variants.with_forms(words)).collect()}
    assert got == dict.fromkeys(list(counts)[:5], "aaabbbb") | {"zzzzzzz": "zzzzzzz"}


def test_anagrams_do_not_meet_in_pairs(spark):
    """Words of the same letters in other orders: only those that share a half are compared."""
    rng = random.Random(3)
    words = sorted({"".join(rng.sample("abcdefghijkl", 12)) for _ in range(3000)})
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    rows = variants.probes(frame)
    assert rows.groupBy("key", "mark").count().agg(F.max("count")).first()[0] < 10
    assert variants.near_pairs(frame).count() == 0


def test_words_are_not_gathered_on_the_driver(spark, capsys):
    words = stash(spark.range(3_000).select(F.concat(F.lit("abcdef"), F.translate(F.col("id").cast("string"), "0123456789", "ghijklmnop")).alias("word"), (F.col("id") + 5).alias("n")), "words")
    forms = stash(variants.with_forms(words), "forms")
    for made in (variants.near_pairs(words), variants.with_forms(words), variants.with_roots(forms)):
        made.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_token_counts(spark, rows, tmp_path):
    tok = Tokenizer.from_file(PATH)
    want = sorted(((-1 if i is None else i), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    cache = f"{tmp_path}/cache"
    key = lambda got: sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect())
    docs = table(spark, rows)
    assert key(token_counts.op13_token_counts(docs, PATH, cache)) == want
    first = spark.read.parquet(cache).count()
    folded = {re.sub("[A-Z]", lambda m: m[0].lower(), re.sub("[\t-\r ]+", " ", t).strip(" ")) if "<|" not in t else re.sub("[\t-\r ]+", " ", t).strip(" ") for t in (t or "" for _, t in rows)}
    assert first == len(folded)
    # files instead of rows in memory, a shuffle instead of a broadcast, and a cache that has all: nothing is encoded again
    docs.write.parquet(f"{tmp_path}/docs")
    read = spark.read.parquet(f"{tmp_path}/docs")
    assert key(token_counts.count_tokens(read, PATH, cache, most_broadcast=0)) == want
    assert spark.read.parquet(cache).count() == first
    more = read.select("doc_id", "text").union(spark.createDataFrame([(900, "a wholly new text")], "doc_id long, text string"))
    assert len(key(token_counts.count_tokens(more, PATH, cache))) == len(rows) + 1
    assert spark.read.parquet(cache).count() == first + 1
    assert key(token_counts.count_tokens(read, PATH, f"{tmp_path}/other", most_broadcast=0)) == want
    assert spark.read.parquet(f"{tmp_path}/other").count() == first
    assert token_counts.op13_token_counts(table(spark, []), PATH, f"{tmp_path}/none").collect() == []
    limit = {r.doc_id: r.over_limit for r in token_counts.op13_token_counts(read, PATH, cache, limit=10).collect()}
    assert limit[0] and not limit[93]


def test_counts_of_other_tokenizers(spark, rows, tmp_path):
    """A file of another kind has a version of its own; only the kind that drops white space and case is normalised."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    cache = f"{tmp_path}/cache"
    piece = sentencepiece.SentencePieceProcessor(model_file=path)
    given = [(i, t) for i, t in rows if i is not None and i < 20]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table(spark, given), path, cache).collect()}
    assert got == {i: len(piece.encode(t or "")) for i, t in given}
    bytes_path = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_counts.folds(bytes_path) and token_counts.folds(PATH)
    other = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table(spark, given), bytes_path, cache).collect()}
    tok = Tokenizer.from_file(bytes_path)
    assert other == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in given}
    assert spark.read.parquet(cache).select("version").distinct().count() == 2


def test_normalised_texts_have_as_many_tokens(spark):
    rng = random.Random(8)
    parts = [" ", "  ", "\t", "\n", " ", " ", "\x85", "\x1f", "A", "b", "É", "é", "<|endoftext|>", "<|EndOfText|>", "'S", "'s", "9", "İ", "ß", "ſ", "K", "日", "-", "​", "<|", "don't", "WE'LL"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(4000)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", token_counts.normalised(F.col("text"), True).alias("short"))
    tok = Tokenizer.from_file(PATH)
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    assert [r for r in frame.collect() if count(r.text) != count(r.short)] == []
