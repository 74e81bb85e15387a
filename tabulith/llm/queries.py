"""The operators as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulith.llm.chat import op7_chat
from tabulith.llm.common import load
from tabulith.llm.decontaminate import op2_decontamination
from tabulith.llm.html import op4_html
from tabulith.llm.importance import op11_importance
from tabulith.llm.licences import op6_licences
from tabulith.llm.media import op9_media
from tabulith.llm.mixing import op5_mixing
from tabulith.llm.ngram_join import op3_ngram_join
from tabulith.llm.sharding import op10_sharding
from tabulith.llm.token_counts import op13_token_counts
from tabulith.llm.token_store import op1_token_ids
from tabulith.llm.toxicity import op8_toxicity
from tabulith.llm.variants import op12_variants

Query = Callable[[SparkSession, str], DataFrame]


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only this query needs it

    return op1_token_ids(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_decontamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_ngram_join(load(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_html(load(spark, sf_dir, "pages"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_mixing(load(spark, sf_dir, "documents"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_licences(load(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_chat(load(spark, sf_dir, "conversations"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_media(load(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_sharding(load(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_importance(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_variants(load(spark, sf_dir, "documents"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op13_token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: The crc32 of half a byte, as a rule: four shifts with the reflected polynomial.
HALVES = "list_transform(range(16), lambda x: list_reduce([x, 0, 0, 0, 0], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"


def crc32_sql(text: str, halves: str = "halves") -> str:
    """The unsigned crc32 of a string's UTF-8 bytes; ``halves`` is a column that holds HALVES."""
    digits = f"list_transform(range(len(hex({text})::VARCHAR) // 2), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    half = lambda c: f"xor(({c}) >> 4, {halves}[(({c}) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {digits}), lambda c, b: {half(half('xor(c, b)'))}), 4294967295)"


QUERIES: dict[str, Query] = {
    "op1_token_ids": op1,
    "op2_decontamination": op2,
    "op3_ngram_join": op3,
    "op4_html_extraction": op4,
    "op5_mixing": op5,
    "op6_license_scan": op6,
    "op7_chat_format": op7,
    "op8_toxicity": op8,
    "op9_media_columns": op9,
    "op10_sharding": op10,
    "op11_importance": op11,
    "op12_spelling_variants": op12,
    "op13_token_counts": op13,
}
#: SQL for the queries that it can express; tests/llm compares the others with brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_join": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, row_number() OVER () AS r,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                           ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
    FROM words),
places AS (SELECT doc_id, r, len(s) AS n, unnest(s) AS shingle FROM sets WHERE doc_id IS NOT NULL),
links AS (
    SELECT DISTINCT a.doc_id AS a, b.doc_id AS b
    FROM places a JOIN places b ON a.shingle = b.shingle AND a.r <> b.r
    GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
    SELECT DISTINCT doc_id AS a, doc_id AS b FROM places
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_reached AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
       CASE WHEN len(s.s) > 0 THEN component_id ELSE s.doc_id END AS component_id
FROM sets s LEFT JOIN least_reached ON a = s.doc_id""",
    "op7_chat_format": r"""
WITH RECURSIVE given AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) extra(turn, role)),
turns AS (
    SELECT *, coalesce(CAST(conv_id AS VARCHAR), '') AS c,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place,
           3 + len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\x09-\x0D \p{L}\p{N}]')) AS tokens,
           9 + 2 * length(role) - length(translate(role, '\<[', '')) + 2 * length(text) - length(translate(text, '\<[', '')) AS chars
    FROM given),
heads AS (
    SELECT c, min(place) AS head_place, arg_min(tokens, place) AS head_tokens, arg_min(chars, place) + 7 AS head_chars
    FROM turns WHERE role = 'system' GROUP BY c),
roomy AS (SELECT turns.*, head_place, head_chars, 512 - 128 - coalesce(head_tokens, 0) AS room FROM turns LEFT JOIN heads USING (c)),
spans AS (
    SELECT c, place, place AS lo, tokens AS used FROM roomy WHERE place % 4096 = 0
    UNION ALL
    SELECT t.c, t.place, CASE WHEN used + tokens > room THEN t.place ELSE lo END, CASE WHEN used + tokens > room THEN tokens ELSE used + tokens END
    FROM spans s JOIN roomy t ON t.c = s.c AND t.place = s.place + 1 AND t.place % 4096 <> 0),
begins AS (SELECT c, place AS lo FROM spans WHERE place = lo),
context AS (
    SELECT b.c, b.lo, CASE WHEN one.tokens + two.tokens <= 128 AND b.lo % 4096 > 1 THEN 2 WHEN one.tokens <= 128 AND b.lo % 4096 > 0 THEN 1 ELSE 0 END AS n,
           one.chars + 7 AS one_chars, two.chars + 7 AS two_chars
    FROM begins b LEFT JOIN turns one ON one.c = b.c AND one.place = b.lo - 1 LEFT JOIN turns two ON two.c = b.c AND two.place = b.lo - 2),
repeated AS (
    SELECT c, sum(CASE n WHEN 0 THEN 0 WHEN 1 THEN one_chars ELSE one_chars + two_chars END + CASE WHEN head_place < lo - n THEN head_chars ELSE 0 END) AS chars
    FROM context LEFT JOIN heads USING (c) GROUP BY c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(turns.chars + CASE role WHEN 'assistant' THEN 4 ELSE 7 END) + any_value(repeated.chars) AS BIGINT) AS formatted_chars
FROM turns JOIN repeated USING (c) GROUP BY conv_id""",
    "op11_importance": rf"""
WITH tokens AS (
    SELECT doc_id, rowid AS r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
    FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
aims AS (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
kinds AS (SELECT w, {crc32_sql("w")} % 10000 AS bucket FROM (SELECT w FROM tokens UNION SELECT w FROM aims), (SELECT {HALVES} AS halves)),
s AS (SELECT bucket, count(*) AS s FROM tokens JOIN kinds USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aims JOIN kinds USING (w) GROUP BY bucket),
gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM tokens) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM aims) + 10000)::DOUBLE))) AS gain
    FROM s FULL JOIN t USING (bucket)),
sums AS (SELECT r, count(*) AS n, sum(gain) AS weight FROM tokens JOIN kinds USING (w) JOIN gains USING (bucket) GROUP BY r),
scored AS (
    SELECT doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
           CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
    FROM (SELECT *, row_number() OVER () AS r FROM documents) LEFT JOIN sums USING (r)),
able AS (
    SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, weight) END AS place,
           count(*) FILTER (n_features >= 20) OVER () AS total
    FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= total * 10 // 100 THEN place END AS rank FROM able""",
    "op12_spelling_variants": rf"""
WITH RECURSIVE runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w
    FROM documents),
kinds AS (SELECT id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY id, w),
hashed AS (SELECT w, n, {crc32_sql("(id || ':' || w)")} AS h FROM kinds, (SELECT {HALVES} AS halves)),
slips AS (SELECT n, CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, letters, marks) AS bytes
    FROM slips, (SELECT string_agg(chr(192 + i::INT), '' ORDER BY i) AS letters, string_agg(chr(32 + i::INT), '' ORDER BY i) AS marks FROM range(64) r(i))
    WHERE length(word) >= 6 GROUP BY word, letters, marks HAVING sum(n) >= 5),
near AS (
    SELECT a.word, count(*) AS n_near, min({{'m': -b.n, 'word': b.word}}) AS best
    FROM words a JOIN words b ON length(b.word) - length(a.word) BETWEEN -1 AND 1 AND a.word <> b.word AND levenshtein(a.bytes, b.bytes) = 1
    GROUP BY a.word),
forms AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 5 * n THEN best.word END AS form, CASE WHEN -best.m >= 5 * n THEN CAST(-best.m AS BIGINT) END AS form_n
    FROM words LEFT JOIN near USING (word)),
steps AS (
    SELECT word, word AS root, 0 AS step FROM forms
    UNION ALL
    SELECT steps.word, forms.form, step + 1 FROM steps JOIN forms ON forms.word = steps.root WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM steps GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)""",
}
