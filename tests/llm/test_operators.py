"""Each operator against a brute-force version, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabulith.llm import chat, decontaminate, kernels, licences, media, mixing, ngram_join, sharding, token_store, toxicity
from tabulith.llm import html as pages_
from tabulith.llm import queries
from tabulith.llm.components import components

SCHEMA = "doc_id long, text string, source string, size string, slot string, n string, node string, shard string, column string"


def table(spark, rows, schema=SCHEMA):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x", "x", "x") for i, t, s in rows], schema)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["the", "of", "über", "élan", "ñandú", "it's", "42", "x,y", "Zoë.", "étude", "—", "日本", "A b", "don’t"] + ["w%d" % i for i in range(60)]
    base = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 160))) for _ in range(40)]
    texts = base + base[:8] + [None, "", "  \n\t ", "one", "One", "two words", "x" * 70_000, "<|endoftext|> hi <|EndOfText|>", "a" * 64]
    for t in base[:12]:
        w = t.split()
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    texts += [base[3]] * 60
    out = [(i, t, rng.choice(["src0", "src1", "src9", None])) for i, t in enumerate(texts)]
    return [*out, out[2], (None, "no id at all", "src0"), (None, None, None)]


def empty(spark):
    return table(spark, [])


def test_token_files(spark, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, rows)
    got = sorted(token_store.op1_token_ids(docs, path).collect(), key=lambda r: (r.start))
    tok = Tokenizer.from_file(path)
    at = 0
    for r, (i, t, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids)), (i, t)
        at += len(ids)
    assert token_store.op1_token_ids(empty(spark), path).collect() == []


def test_random_access_in_token_files():
    rng = np.random.default_rng(2)
    docs = [rng.choice([5, 6, 7, 49407, 2], size=n).astype(np.uint16) for n in (0, 1, 900, 3000, 50)] + [np.full(500, 9, np.uint16)]
    shard = token_store.Shard(token_store.write_shard(list(range(len(docs))), docs))
    assert len(shard.rules) > 3 and len(shard.symbols) < sum(map(len, docs)) * 0.8
    for i, d in enumerate(docs):
        ids = np.append(d, 2)
        assert (shard.ids(i) == ids).all()
        for at in (0, len(ids) // 3, len(ids) - 1):
            assert shard.token(i, at) == ids[at]


def test_grammars_go_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 49408, 3000).astype(np.uint16)
    cases = {
        "copies": [text] * 40,
        "one id": [np.full(5000, 7, np.uint16)],
        "few ids": [rng.integers(0, 3, n).astype(np.uint16) for n in (0, 1, 2, 4000, 300)],
        "rare pairs": [text],
        "nothing": [],
    }
    for name, docs in cases.items():
        symbols = np.concatenate([np.zeros(0, np.uint16), *(p for d in docs for p in (d, [np.uint16(token_store.END)]))]).astype(np.uint16)
        short, rules = token_store.compress(symbols)
        left = Counter(p for p in itertools.pairwise(short.tolist()) if token_store.END not in p)
        assert max(left.values(), default=0) < token_store.LEAST_PAIRS, name
        assert len(set(rules[["left", "right"]].tolist())) == len(rules), name
        shard = token_store.Shard(token_store.write_shard(list(range(len(docs))), docs))
        assert len(shard.rules) == len(rules)
        for i, d in enumerate(docs):
            assert (shard.ids(i) == np.append(d, 2)).all(), name
            assert [shard.token(i, at) for at in range(0, len(d), 97)] == d[::97].tolist(), name
        if name == "copies":
            assert rules["length"].max() > 256 and len(short) < len(symbols) / 256


def test_words_end_between_letters_and_marks():
    enc = token_store.Encoder(public_tokenizers.path("word_bpe_49k.json"), most=500)
    rng = random.Random(8)
    signs = list("aabzAZ09'.,;:!?#$%&*<>=|\"`~^_-()[]{}@/\\ \n\tstredvml") + "é É ß ñ × ÷ ÿ À İ K ſ 日 Σ ς ﬁ ½ ² ’ —".split()
    signs += ["\u0301", "\u0338", "\u00a0", "\u2003", "\u0085", "\x00", "\x1f", "\x1c", "'s", "'re"]
    for _ in range(20):
        texts = ["".join(rng.choices(signs, k=rng.randint(0, 25))) for _ in range(300)]
        for text, ids in zip(texts, enc.many(texts), strict=True):
            assert ids.tolist() == enc.whole.encode(text, add_special_tokens=False).ids, text


def tiling_by_force(text, item, least):
    used_t, used_i, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for j, i in itertools.product(range(len(item)), range(len(text))):
            n = 0
            while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and i + n not in used_t and j + n not in used_i:
                n += 1
            if n > best[0]:
                best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        used_t |= set(range(i, i + n))
        used_i |= set(range(j, j + n))
        total += n


def test_tiling_covers_what_force_covers():
    rng = random.Random(1)
    for _ in range(60):
        item = [rng.randrange(9) for _ in range(rng.randint(5, 30))]
        cut = rng.randrange(len(item))
        text = [rng.randrange(9) for _ in range(8)] + item[cut:] + [rng.randrange(9)] + item[:cut]
        got = decontaminate.tiles(np.array(text, np.uint64) + np.uint64(77), np.array(item, np.uint64) + np.uint64(77), 3)
        assert sum(t[2] for t in got) == tiling_by_force(text, item, 3)


def test_leaks(spark, rows):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    words = passage.split()
    docs = table(spark, [*rows, (900, "x " + passage.upper() + " y", "s"), (901, " ".join(words[5:] + ["q"] + words[:5]), "s"), (902, " ".join(words[:4]), "s")])
    bench = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "one"), (None, "no match for this item at all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.tiles) for r in decontaminate.op2_decontamination(docs, bench).collect()}
    assert got == {(900, 1, 1), (901, 1, 2)}
    kept = decontaminate.reject_leaks(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert decontaminate.op2_decontamination(empty(spark), bench).count() == 0
    assert decontaminate.op2_decontamination(docs, bench.limit(0)).count() == 0


def groups_by_force(rows, k, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(i for i in sets if i is not None), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), None if i is None else find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(spark, rows, k, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", 4)
    got = ngram_join.ngram_join(table(spark, rows), k, percent)[0].collect()
    want = groups_by_force([r for r in rows if r[0] is not None], k, percent)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        else:
            assert r.component_id is None
    assert ngram_join.ngram_join(empty(spark), k, percent)[0].count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_with_sql(spark, name):
    db, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    rel = db.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})")
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in frame.select(columns).collect()), key=key) == sorted(rel.fetchall(), key=key)


def test_ngram_join_sql_on_odd_rows(spark, rows):
    db, docs = duckdb.connect(), table(spark, rows)
    documents = docs.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    key = lambda r: tuple((v is not None, v) for v in r)
    got = ngram_join.op3_ngram_join(docs).select("doc_id", "n_shingles", "component_id").collect()
    want = db.sql(f"SELECT doc_id, n_shingles, component_id FROM ({queries.ORACLE_SQL['op3_ngram_join']})").fetchall()
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_dense_near_copies_keep_all_links(spark):
    rng = random.Random(9)
    base = ["b%d" % i for i in range(120)]
    docs = [(0, " ".join(base), "s")]
    for i in range(1, 120):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = "e%d" % rng.randrange(10_000)
        docs.append((i, " ".join(w), "s"))
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(table(spark, docs[1:]), 3, 90)[0].collect()}
    assert got == {i: c for i, (_, c) in groups_by_force(docs[1:], 3, 90).items()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 101: 100, 102: 100}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, really, all the time, on every page, for you.</p></div>
<div id="sidebar"><p>Sidebar text, with commas, and more, and more commas, than the article has.</p></div>
<article><h1>A &amp; B</h1><p><b>First   para,<br>with a break.<p>Second&nbsp;para &eacute;.</p><ul><li>item one<li>item two</ul>
<form><input><label>mail</label></form><div class="comments"><p>Nice post, thanks, indeed, great.</p></div></article><aside>ad</aside><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    want = "A & B\nFirst para, with a break.\nSecond para é.\nitem one\nitem two"
    assert pages_.main_text(PAGE) == want
    plain = "<div id=wrap><div class=menu><a href=x>m</a></div><div><p>%s</p><p>%s</p></div></div>" % ("long text, " * 20, "more text, " * 20)
    assert pages_.main_text(plain) == ("long text, " * 20).strip() + "\n" + ("more text, " * 20).strip()
    for odd in ("", "<", "<p", "</p></p>", "just text", "<b>x</i></b>", "<script>1", "<!-- open", "<p>&am", "<table><td>a<td>b"):
        assert isinstance(pages_.main_text(odd), str)
    assert pages_.main_text("<article><p>x &am") == "x &am"
    frame = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (3, "v", "", "x")], "page_id long, url string, html string, text string")
    got = pages_.op4_html(frame).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(want)), (1, len(want)), (3, 0)]
    assert pages_.op4_html(frame.limit(0)).count() == 0
    assert html.unescape("&eacute;") in got[0].text


def test_mixing(spark, rows):
    weights = {"src0": 3, "src1": 2}
    got = mixing.mix_sources(table(spark, rows), weights, 5, block=2).collect()
    assert len(got) == len(rows) and len({r.position for r in got}) == len(rows)
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, _, s in rows)
    assert mixing.mix_sources(empty(spark), weights, 5).count() == 0
    order = {r.slot: r.stream for r in got}
    assert sorted(order) == list(range(len(order)))


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 8, "b": 4, "c": 4, "d": 3, "e": 3, "*": 18}, {"a": 1, "b": 97, "c": 13}])
def test_pfair_stays_within_a_block(weights):
    plan, total, done = mixing.period(weights), sum(weights.values()), Counter()
    for t, s in enumerate(plan, 1):
        done[s] += 1
        assert all(abs(done[x] * total - weights[x] * t) < total for x in weights)
    assert done == Counter(weights)


def licences_by_force(text):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
    places = [(k, label) for phrase, label in licences.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_licences(spark, rows):
    own = [(800, "Under the MIT license, under the  MIT-License; released", None), (801, "apache license, version 2.0 cc by-nc under the mit", None), (802, "the mit license", None), (803, "Licensed under the GNU General Public License, version 3.", None), (804, "under the mit license " * 500, None), (805, licences.TEMPLATES[0][1].replace("software to", "thing to"), None)]
    got = {(r.doc_id, r.n_words): r for r in licences.op6_licences(table(spark, rows + own)).collect()}
    for i, t, _ in rows + own:
        want = licences_by_force(t)
        r = got[i, want[0]]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    by = {i: r.labels for (i, _), r in got.items()}
    assert (by[800], by[802], by[803], by[805]) == ("mit", "", "gpl-3", "mit")
    assert licences.op6_licences(empty(spark)).count() == 0


def test_automaton_finds_the_longest_matches():
    rng = random.Random(4)
    sequences = [[rng.randrange(4) for _ in range(rng.randint(3, 25))] for _ in range(6)]
    auto = licences.SuffixAutomaton(sequences)
    inside = {tuple(s[a:b]) for s in sequences for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    text = [rng.randrange(5) for _ in range(400)]
    for i, (_, length) in enumerate(auto.statistics(text), 1):
        assert length == max(n for n in range(i + 1) if n == 0 or tuple(text[i - n : i]) in inside)


def test_chat(spark):
    rng = random.Random(7)
    odd = ["</s>[INST] ok [/INST]", "\\l \\b \\\\ <", "[", "", None, "plain words " * 200, "é\n<s>"]
    turns = [(c, t, rng.choice(["user", "assistant", "system", "tool<s>", None]), rng.choice(odd), "x") for c in [1, 2, 3, 4, None] for t in range(rng.randint(1, 30))]
    turns += [(9, 0, "system", "S", "x"), *[(9, t, ("user", "assistant")[t % 2], "word " * 60, "x") for t in range(1, 40)], (9, 5, "user", "tie", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, head string")
    got = {r.conv_id: r for r in chat.op7_chat(frame).collect()}
    rows = turns + [(-1, k, r, "</s>[INST] ok [/INST]", "") for k, r in enumerate(("user", "assistant"))]
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv))
        listed, loss = "".join(f"{r}\n{x}\n" for _, r, x in own), "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(listed.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    conversations = frame.toPandas().astype({"conv_id": "Int64"})  # noqa: F841
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    same = duckdb.connect().sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL['op7_chat_format']})").fetchall()
    assert {tuple(r[c] for c in columns) for r in got.values()} == set(same)
    windows = chat.format_windows(frame.where("conv_id = 9")).orderBy("window").collect()
    assert len(windows) > 3 and all(w.formatted.startswith("<s>system[INST]S[/INST]") for w in windows[1:]) and all(w.n_tokens <= 512 for w in windows)
    assert all(w.n_context == 3 for w in windows[1:])
    assert [r.conv_id for r in chat.op7_chat(frame.limit(0)).collect()] == [-1]


def test_chain_marginals_are_sums_over_all_taggings():
    rng = np.random.default_rng(3)
    lengths, start, step = [1, 5, 2, 7], np.array([1.0, 0.4]), np.array([[1.2, 0.5], [0.7, 1.9]])
    emission = rng.normal(size=sum(lengths))
    first = np.zeros(len(emission), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    got, pairs = toxicity.chain_marginals(emission, first, start, step)
    want, all_pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        total, hit, p = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in itertools.product((0, 1), repeat=n):
            w = start[tags[0]] * np.exp(sum(emission[at + i] for i in range(n) if tags[i])) * np.prod([step[a, b] for a, b in itertools.pairwise(tags)])
            total += w
            hit += w * np.array(tags)
            for a, b in itertools.pairwise(tags):
                p[a, b] += w
        want += list(hit / total)
        all_pairs += p / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, all_pairs)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.op8_toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").toPandas()
    hit = ((got.toxic == 1) & (got.predicted == 1)).sum()
    assert hit >= 0.9 * (got.toxic == 1).sum() and hit >= 0.9 * (got.predicted == 1).sum()


def test_toxicity_edges(spark, rows):
    docs = table(spark, rows)
    none = spark.createDataFrame([(1, None), (2, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.op8_toxicity(docs, none).collect()
    assert len(got) == len(rows) and all(r.predicted == 0 and 0 <= r.score <= 1 for r in got)
    assert toxicity.op8_toxicity(empty(spark), none).count() == 0
    assert toxicity.spans("a bad Word, bad", np.array([0, 0.9, 0.8, 0.1])) == [(2, 10)]


def test_media_texts(spark, rows):
    got = Counter(media.op9_media(table(spark, rows)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect())
    want = Counter()
    for i, t, _ in rows:
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        want[i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])] += 1
    assert got == want
    assert media.op9_media(empty(spark)).count() == 0


def test_media_formats(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    assert (media.decode(media.encode_bmp(image)) == image).all()
    assert (media.decode(b"P6 7 5 255\n" + image.tobytes()) == image).all()
    assert (media.decode(media.encode_pgm(image[:, :, 0])) == image[:, :, 0]).all()
    assert media.decode(b"P2\n# c\n2 1\n# d\n4\n0 4\n").tolist() == [[0, 255]]
    assert media.decode(b"P1 2 2 1 0\n0 1").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]
    grid = rng.random((6, 10))
    want = [[grid[r * 2 : r * 2 + 2, c * 5 : c * 5 + 5].mean() for c in range(2)] for r in range(3)]
    assert np.allclose(media.area_resize(grid, 3, 2), want)
    assert np.isclose(media.area_resize(grid, 4, 7).mean(), grid.mean())
    frame = spark.createDataFrame([(1, bytearray(media.encode_bmp(image))), (2, None), (3, bytearray(b"P5 9 9 255\nxx")), (4, bytearray(b"GIF"))], "media_id long, data binary")
    got = {r.media_id: r for r in media.decode_media(frame).collect()}
    assert got[1].width == 7 and np.load(__import__("io").BytesIO(got[1].tile)).shape == (16, 16) and len(got[1].dhash) == 16
    assert all(got[i].tile is None and got[i].error for i in (2, 3, 4))


def test_sharding(spark, rows):
    got = sharding.shard_documents(table(spark, rows), shards=5).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    of = {}
    for r in got:
        assert of.setdefault((r.text_crc32, r.size), r.shard) == r.shard
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_longest_first_is_lpt():
    rng = random.Random(6)
    for _ in range(40):
        sizes = [rng.choice([1, 2, 3, 10, 50]) for _ in range(rng.randint(1, 200))]
        counts = Counter(sizes)
        plan = dict(sharding.longest_first([(s, n, s * n) for s, n in counts.items()], 4))
        loads = [0] * 4
        for s in sorted(sizes, reverse=True):
            loads[loads.index(min(loads))] += s
        assert sorted(sum(plan[s][k] * s for s in plan) for k in range(4)) == sorted(loads)


def test_word_hashes_and_spans():
    import pyarrow as pa

    data, offsets = kernels.utf8(pa.array(["Ab c", None, "ab", " C  AB"]))
    starts, ends, first = kernels.words(data, offsets, kernels.BLANK_WORDS)
    h = kernels.word_hashes(data, starts, ends).tolist()
    assert first.tolist() == [0, 2, 2, 3, 5] and h[0] == h[2] == h[4] and h[1] == h[3] != h[0]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    words = ["k%d" % i for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=80)), "en", "src%d" % (i % 4)) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "src0") for i in range(5)]
    item = "unique benchmark passage of exactly nine words here now"
    rows += [(200, rows[9][1] + " " + item + " " + " ".join(rng.choices(words, k=80)), "en", "src1"), (300, None, "en", None)]
    toxic = [(400 + i, " ".join(rng.choices(words, k=20) + ["vilest"] + rng.choices(words, k=20)), "en", "src2") for i in range(60)]
    frames = {"documents": spark.createDataFrame([(*r, len(r[1] or "")) for r in rows + toxic], "doc_id long, text string, lang string, source string, n_chars long")}
    frames["labels"] = spark.createDataFrame([(r[0], 1, int(r[0] >= 400)) for r in rows + toxic], "doc_id long, quality int, toxic int")
    frames["benchmark"] = spark.createDataFrame([(1, item)], "item_id long, text string")
    for name, frame in frames.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(out.doc_id) == [*range(60), 300]
    docs = frames["documents"].where("doc_id < 60").withColumn("x", F.lit(1))
    mixed = corpus_pipeline.mixing(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns and mixed.count() == 60


def test_slots_follow_the_mixing_schedule(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    rows = [(i, " ".join("w%d" % rng.randrange(900) for _ in range(30)), "en", "src0" if i % 3 else "src1", 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    position = {r.doc_id: r.position for r in mixing.mix_sources(docs, corpus_pipeline.WEIGHTS, corpus_pipeline.OTHERS_WEIGHT).collect()}

    def shards(frame, name):
        frame.write.parquet(f"{tmp_path}/{name}")
        got = corpus_pipeline.sharding(spark, spark.read.parquet(f"{tmp_path}/{name}"), str(tmp_path)).collect()
        return [[r.doc_id for r in sorted(got, key=lambda r: r.slot) if r.shard == s] for s in range(40)]

    mixed = shards(corpus_pipeline.mixing(spark, docs, str(tmp_path)), "mixed")
    assert all(s == sorted(s, key=position.get) for s in mixed)
    plain = shards(docs, "plain")
    assert plain != mixed and [set(s) for s in plain] == [set(s) for s in mixed]


@pytest.mark.parametrize("weights", [{"news": 3, "wiki": 2}, {"absent": 1}])
def test_each_source_stays_within_a_block(spark, weights):
    sizes = {"news": 40, "wiki": 60, "blog": 700, "*": 30, "": 50, None: 45, "src0": 20}
    rows = [(i, "t", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mix_sources(table(spark, rows), weights, 5, block=2).collect()
    assert Counter(r.source for r in got) == Counter(sizes) and len({r.position for r in got}) == len(rows)
    order = {r.slot: r.source for r in got}
    assert sorted(order) == list(range(sum(-(-n // 2) for n in sizes.values())))
    other = sum(s not in weights for s in sizes)
    left, done, t = {s: -(-n // 2) for s, n in sizes.items()}, Counter(), 0
    shares = {s: weights[s] * other if s in weights else 5 for s in sizes}
    for k in sorted(order):
        t, total = t + 1, sum(shares[s] for s in left)
        done[order[k]] += 1
        assert all(abs(done[s] * total - shares[s] * t) < total for s in left), (k, done)
        if done[order[k]] == left[order[k]]:  # a new phase
            left = {s: n - done[s] for s, n in left.items() if n > done[s]}
            done, t = Counter(), 0


def test_phases_are_the_schedule():
    rng = random.Random(12)
    for _ in range(60):
        weights = {s: rng.randint(1, 9) for s in "abcdef"[: rng.randint(1, 6)]}
        blocks = {s: rng.randint(0, 40) for s in weights}
        slots = sorted(slot0 + (j // own) * span + at[j % own] for _, _, n, slot0, span, own, at in mixing.phases(blocks, weights) for j in range(n))
        assert slots == list(range(sum(blocks.values())))


def test_names_alone_cut_nothing_long():
    long = "A long sentence, with commas, of the article itself, which goes on and on. " * 5
    para = "<p>%s</p>" % long
    for name in ("content no-sidebar", "content share", "related", "side", "notice", "ads", "comments-open"):
        assert pages_.main_text('<body><div class="%s">%s%s</div></body>' % (name, para, para)) == "\n".join([long.strip()] * 2), name
    assert pages_.main_text('<article><header class="entry-header"><h1>Title</h1></header>%s</article>' % para) == "Title\n" + long.strip()
    share = '<div class="share"><a href=x>one</a><a href=y>two</a></div>'
    listed = '<div class="related">%s</div>' % ("<a href=z>another story of this site</a> " * 30)
    comments = '<div class="comments">%s</div>' % para
    assert pages_.main_text("<article>%s%s%s%s%s</article>" % (para, para, share, listed, comments)) == "\n".join([long.strip()] * 2)


def test_short_sections_beside_the_best_stay():
    long = "A long sentence, with commas, of the article itself, which goes on and on. " * 5
    side = '<div id="sidebar"><p>%s</p></div>' % ("Teasers, of other stories, and more. " * 9)
    page = "<body><div><div><p>%s</p><p>%s</p></div><div>That is all.</div><div><p>The end</p></div><div><a href=x>Next.</a></div>%s</div></body>" % (long, long, side)
    assert pages_.main_text(page) == "\n".join([long.strip()] * 2 + ["That is all.", "The end"])
    rows = "".join("<div><div><p>%s</p></div></div>" % long for _ in range(2))
    assert pages_.main_text("<body><div>%s</div></body>" % rows) == "\n".join([long.strip()] * 2)


def test_short_items_match_as_a_whole(spark):
    texts = ["Who wrote it", "x who WROTE\nit y", "who wrote", "wrote it who", "who wrote them it", "blue moon and who wrote it", "blue", None, "", "a b c d e f"]
    docs = table(spark, [(i, t, "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame([(1, "who wrote it"), (2, "Blue  moon"), (3, "blue moon"), (4, "a b c d e f"), (5, "c d e f"), (None, "e f"), (7, "f")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.coverage, r.tiles) for r in decontaminate.find_leaks(docs, bench).collect())
    pairs = [(0, 1), (1, 1), (5, 1), (5, 2), (5, 3), (9, 4), (9, 5), (9, None)]
    assert got == Counter((d, i, 1.0, 1) for d, i in pairs)
    assert sorted(r.doc_id for r in decontaminate.reject_leaks(docs, bench).collect()) == [2, 3, 4, 6, 7, 8]


@pytest.mark.parametrize("name", ["comments", "comment-list", "ad", "sidebar", "notice", "sponsored", "related-posts", "newsletter", "cookie-notice", "widget", "promo"])
@pytest.mark.parametrize("times", [1, 3, 12])
def test_long_furniture_goes_beside_an_article(name, times):
    """Named parts go whatever their length where an article has text of its own, in it, after it, or with no article tag before longer prose."""
    body = "The ministers met on Monday, as had been planned, and spoke of the harbour at length. "
    other = "".join("<p>%s</p>" % ("Some other words that readers or sellers wrote, of no use here, number %d. " % i * 4) for i in range(times))
    part = '<div class="%s">%s</div>' % (name, other)
    assert pages_.main_text("<body><article><p>%s</p>%s</article></body>" % (body * 3, part)) == (body * 3).strip()
    assert pages_.main_text("<body><article><p>Short body.</p>%s</article></body>" % part) == "Short body."
    assert pages_.main_text("<body>%s<main><h1>Title</h1><p>%s</p></main>%s</body>" % (part, body, part)) == "Title\n" + body.strip()
    long = body * 5 * times
    assert pages_.main_text('<body><div class="text"><p>%s</p></div>%s</body>' % (long, part)) == long.strip()


def test_a_named_wrapper_of_the_only_prose_stays():
    body = "The ministers met on Monday, as had been planned, and spoke of the harbour at length. " * 4
    for name in ("widget", "sidebar", "notice", "side"):
        assert pages_.main_text('<body><div class="%s"><p>%s</p><div class="comments"><p>%s</p></div></div></body>' % (name, body, "Nice words, thanks, all of you. " * 30)) == body.strip()


def test_pages_of_known_parts():
    """Pages put together from article blocks and furniture give the article blocks alone."""
    rng = random.Random(21)
    vocabulary = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()

    def words(n):
        return " ".join(rng.choices(vocabulary, k=n))

    def block():
        text = words(rng.randint(20, 60)) + ", " + words(8) + "."
        return rng.choice(
            [
                ("<p>%s</p>" % text, text),
                ("<p>%s" % text, text),
                ("<p><b>%s</b> <i>x</i></p>" % text, text + " x"),
                ("<h2>Part &amp; more</h2>", "Part & more"),
                ("<blockquote><p>%s</p></blockquote>" % text, text),
                ("<ul><li>%s<li>two</ul>" % text, text + "\ntwo"),
                ("<table><tr><td>%s<td>b</table>" % text, text + "\nb"),
                ('<div class="related-work">%s</div>' % text, text),
                ('<div class="share-price">Price 3 &euro;</div>', "Price 3 €"),
            ]
        )

    def furniture():
        text = words(rng.randint(5, 25)) + "."
        return rng.choice(
            [
                "<nav><a href=x>%s</a></nav>" % text,
                "<aside>%s</aside>" % text,
                '<div class="cookie-notice"><p>%s</p></div>' % text,
                '<div id="sidebar-left"><a href=x>%s</a></div>' % text,
                '<div class="ad">%s</div>' % text,
                "<form><label>%s</label><input></form>" % text,
                "<script>var x = '<p>%s</p>';</script>" % text,
                "<style>p{}</style><!-- %s -->" % text,
                '<ul class="menu"><li><a href=x>%s</a></ul>' % text,
                '<div class="acme-footer">%s</div>' % text,
                '<div style="display: none">%s</div>' % text,
            ]
        )

    for i in range(300):
        parts = [block() for _ in range(rng.randint(2, 8))]
        inner = "".join(h + (furniture() if rng.random() < 0.2 and not h.startswith("<p>") else "") for h, _ in parts)
        comments = '<section><h3>3 Comments</h3><p>%s.</p></section>' % words(40) if rng.random() < 0.5 else ""
        body = "".join(furniture() for _ in range(rng.randint(0, 3))) + "<article><header><h1>Title</h1></header>%s</article>" % inner + comments + "".join(furniture() for _ in range(rng.randint(0, 3)))
        if i % 5 == 0:
            body = "<form id=page>%s<button>go</button></form>" % body
        want = "Title\n" + "\n".join(t for _, t in parts)
        assert pages_.main_text("<html><body>%s</body></html>" % body) == want, body


def test_article_parts_that_names_or_places_hid():
    long = "A long sentence, with commas, of the article itself, which goes on and on. " * 5
    reply = "<p>%s</p>" % ("Nice post, thanks, indeed, great. " * 10)
    assert pages_.main_text("<body><article>Body</article><section><h2>Responses</h2>%s%s</section></body>" % (reply, reply)) == "Body"
    beside = "<body><div><div><p>%s</p><p>%s</p></div><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><div>The end.</div></div></body>" % (long, long)
    assert pages_.main_text(beside).split("\n")[2:] == ["one", "two", "a", "b", "The end."]
    assert pages_.main_text("<article><header><h1>T</h1><p>Standfirst</p></header><p>%s</p></article>" % long) == "T\nStandfirst\n" + long.strip()
    assert pages_.main_text("<body><form id=aspnet><input name=x><div><p>%s</p><p>%s</p></div><button>Go</button></form></body>" % (long, long)) == "\n".join([long.strip()] * 2)


@pytest.mark.parametrize("tag", ["div", "b", "p", "table", "ul", "span", "nav"])
def test_deep_pages(tag):
    page = "<body><article><p>first</p>%sdeep%s<p>last</p></article></body>" % ("<%s>" % tag * 5000, "</%s>" % tag * 5000)
    assert pages_.main_text(page).split("\n") == (["first", "last"] if tag == "nav" else ["first", "deep", "last"])


def test_long_conversations(spark, monkeypatch):
    """Windows of 3,000 turns in chunks of 64, against a loop over turns."""
    monkeypatch.setattr(chat, "CHUNK", 64)
    rng = random.Random(3)
    turns = [(c, t * step, ("user", "assistant")[t % 2] if t else "system", " ".join("w" for _ in range(rng.randint(0, 60)))) for c, n, step in ((1, 3000, 1), (2, 300, 1000)) for t in range(n)]
    turns += [(3, 5, "user", "same")] * 200 + [(3, None, "assistant", "first")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(w.conv_id, w.window): w for w in chat.format_windows(frame, budget=100, history_turns=3, history_tokens=40).collect()}
    want = {}
    for conv in (1, 2, 3):
        own = sorted(((-1 if t is None else t, r, x) for c, t, r, x in turns if c == conv))
        cost = [len(x.split()) + 3 for _, _, x in own]
        head = next((i for i, (_, r, _) in enumerate(own) if r == "system"), None)
        room = 60 - (cost[head] if head is not None else 0)
        starts, used = [], 0
        for i, n in enumerate(cost):
            if i % 64 == 0 or (used and used + n > room):
                starts.append(i)
                used = 0
            used += n
        for lo, hi in itertools.pairwise([*starts, len(own)]):
            past = max((h for h in range(4) if lo - h >= lo // 64 * 64 and sum(cost[lo - h : lo]) <= 40), default=0)
            lead = [head] if head is not None and head < lo - past else []
            context = lead + list(range(lo - past, lo))
            text = "".join("<s>%s[INST]%s%s" % (own[i][1], own[i][2], "</s>" if i >= lo and own[i][1] == "assistant" else "[/INST]") for i in context + list(range(lo, hi)))
            want[conv, lo] = (len(context), sum(cost[i] for i in context) + sum(cost[lo:hi]), text)
    assert {k: (w.n_context, w.n_tokens, w.formatted) for k, w in got.items()} == want
    for (conv, _), w in got.items():
        listed = [w.formatted[s.start : s.start + s.length] for s in w.loss_spans]
        assert "".join(listed) == "".join(re.findall(r"<s>assistant\[INST\]([^<\[]*)</s>", w.formatted)), conv


DAMAGED = [
    b"P5 99999999999999999999 1 255\n", b"P5 4294967295 4294967295 255\nxx", b"P2 2 1 10\n300 1", b"P2 2 1 10\n-1 1", b"P1 2 2\n0 x 1 1", b"P2 2 1 x\n1 1", b"P5 1 1 10\n\xff", b"P6 2 2 255\nabc", b"P4 9 2\n\x00",
    b"P", b"P5", b"BM", b"BM" + bytes(60), media.encode_bmp(np.zeros((2, 2, 3), np.uint8))[:-5], b"P3 1 1 65536\n1 1 1", b"P7 1 1 1\n", b"",
]


def test_damaged_media_give_messages(spark):
    # a bitmap of 8 bits with two colours and a sample past them
    head = b"BM" + (70).to_bytes(4, "little") + bytes(4) + (62).to_bytes(4, "little")
    info = b"".join(x.to_bytes(n, "little") for x, n in ((40, 4), (4, 4), (1, 4), (1, 2), (8, 2), (0, 4), (4, 4), (0, 4), (0, 4), (2, 4), (0, 4)))
    paletted = head + info + bytes(8)
    values = [*DAMAGED, paletted + b"\x00\x01\x07\x00"]
    for v in values:
        with pytest.raises(ValueError):
            media.decode(v)
    assert media.decode(paletted + b"\x00\x01\x00\x01").shape == (1, 4, 3)
    frame = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "media_id long, data binary")
    got = media.decode_media(frame).collect()
    assert len(got) == len(values) and all(r.error and r.tile is None for r in got)
    rng = random.Random(2)
    for whole in (media.encode_pgm(np.arange(64, dtype=np.uint8).reshape(4, 16)), media.encode_bmp(np.zeros((3, 5, 3), np.uint8)), b"P3 2 2 9 " + b"1 2 3 " * 4):
        for _ in range(300):
            cut = bytearray(whole[: rng.randint(0, len(whole))])
            for _ in range(rng.randint(0, 3)):
                if cut:
                    cut[rng.randrange(len(cut))] = rng.randrange(256)
            try:
                media.decode(bytes(cut))
            except ValueError:
                pass


def test_texts_are_stored_as_greymaps_and_bitmaps():
    for n in (64, 128, 192, 256, 384):
        payload = bytes(i * 7 % 251 for i in range(n))
        kept = media.store(payload)
        assert kept[:2] == (b"P5" if n % 192 else b"BM") and media.decode(kept).tobytes() == payload


def chain_by_force(text, template, least):
    """Most words of common runs of ``least`` words or more that can be taken in order in both sequences."""
    run = np.zeros((len(text) + 1, len(template) + 1), int)
    cells = set()
    for i, j in itertools.product(range(1, len(text) + 1), range(1, len(template) + 1)):
        if text[i - 1] == template[j - 1]:
            run[i, j] = run[i - 1, j - 1] + 1
            if run[i, j] >= least:
                cells |= {(i - k, j - k) for k in range(least)}
    most = np.zeros_like(run)
    for i, j in itertools.product(range(1, len(text) + 1), range(1, len(template) + 1)):
        most[i, j] = max(most[i - 1, j], most[i, j - 1], most[i - 1, j - 1] + ((i, j) in cells))
    return int(most[-1, -1])


def test_chains_cover_what_force_covers():
    rng = random.Random(1)
    equal = 0
    for _ in range(400):
        size = rng.choice([3, 6, 20])
        template = [rng.randrange(size) for _ in range(rng.randint(4, 25))]
        text = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randrange(len(template))
            text += [rng.randrange(size) for _ in range(rng.randint(0, 3))] + template[a : a + rng.randint(1, 12)]
        name = lambda i: "z" + chr(97 + i)
        scanner = licences.Scanner([("x", " ".join(map(name, template)))])
        ids = scanner.members(np.array([kernels.hash_text(name(i)) for i in text], np.uint64)).tolist()
        got = scanner.scan(*zip(*[(ids[a:b], a) for a, b in runs_of(ids) if b - a >= licences.LEAST], strict=True)) if any(b - a >= licences.LEAST for a, b in runs_of(ids)) else {"covered": {}, "spans": {}}
        share, spans = got["covered"].get(len(licences.BASE), 0), got["spans"].get(len(licences.BASE), [])
        want = chain_by_force(text, template, licences.LEAST)
        assert round(share * len(template)) <= want
        equal += round(share * len(template)) == want
        assert all(b <= c for (_, b), (c, _) in itertools.pairwise(spans)) and min(len(template), sum(b - a for a, b in spans)) == round(share * len(template))
    assert equal >= 390


def runs_of(ids):
    cut = [k for k, i in enumerate(ids) if i < 0]
    return [(a + 1, b) for a, b in itertools.pairwise([-1, *cut, len(ids)])]


def test_licence_spans(spark):
    full = {label: t.split() for label, t in licences.TEMPLATES}
    gpl = full["gpl"]
    texts = ["x y " + " ".join(gpl).upper() + " z", "Start. " + " ".join(gpl[:40]) + " qqq rrr " + " ".join(gpl[40:]), " ".join(gpl[::-1]), " ".join(gpl[:20])]
    got = {r.doc_id: r for r in licences.scan_licences(table(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert (got[0].labels, got[1].labels, got[2].labels, got[3].labels) == ("gpl", "gpl", "", "")
    assert [(s.label, s.first_word, s.n_words) for s in got[0].spans if s.n_words == len(gpl)] == [("gpl", 2, len(gpl))]
    assert {("gpl", 1, 40), ("gpl", 43, len(gpl) - 40)} <= {tuple(s) for s in got[1].spans} and not got[2].spans and got[0].score == 1.0


def test_spans_are_places_in_the_text():
    text = "İİ Größe É bad Wörd, bad end"
    words = toxicity.split(text)
    marginal = np.array([float(w in (b"bad", "wörd".encode())) for w in words])
    got = [text[a:b] for a, b in toxicity.spans(text, marginal)]
    assert got == ["bad Wörd, bad"] and toxicity.spans("x Bad y", np.array([0, 0.2, 0.1]), 0.2) == [(2, 5)]


def test_repeated_words_do_not_stall():
    import time

    item = np.array([5] * 30 + [6, 7, 8] + [5] * 27, np.uint64)
    text = np.concatenate([np.full(20_000, 5), [6, 7, 9], np.full(10_000, 5)]).astype(np.uint64)
    began = time.perf_counter()
    got = decontaminate.tiles(text, item)
    assert sorted(n for _, _, n in got) == [27, 32] and time.perf_counter() - began < 5
    assert decontaminate.tiles(np.full(50_000, 5, np.uint64), np.full(60, 5, np.uint64)) == [(0, 0, 60)]


def test_loads_of_large_groups_are_near_those_of_exact_lpt(spark):
    rng = random.Random(17)
    sizes = [rng.choice([rng.randint(20, 900), rng.randint(1000, 6000), rng.randint(6000, 40_000)]) for _ in range(400)]
    docs = table(spark, [(i, chr(97 + i % 26) * 3 + str(i).rjust(5) + "x" * (n - 24), "s") for i, n in enumerate(sizes)])
    got = sharding.shard_documents(docs, shards=7).collect()
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    exact = [0] * 7
    for n in sorted((r.size for r in got), reverse=True):
        exact[exact.index(min(exact))] += n
    mean = sum(exact) / 7
    assert max(loads.values()) - mean <= max(exact) - mean + mean / 512 and mean - min(loads.values()) <= mean - min(exact) + mean / 512 + 900


def test_few_words_make_no_table_of_all_pairs(spark, monkeypatch):
    """Rows over four words share columns with most others: tiles and parities leave few pairs, and no link is lost."""
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", 4)
    monkeypatch.setattr(ngram_join, "TILE", 16)
    monkeypatch.setattr(ngram_join, "SHARE", 20)
    monkeypatch.setattr(ngram_join, "COLUMNS", 7)
    sizes = {}
    stash = ngram_join.stash

    def counted(df, label, collect=False):
        out = stash(df, label, collect)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "stash", counted)
    rng = random.Random(13)
    docs = [(i, " ".join(rng.choices("abcd", k=60)), "s") for i in range(300)]
    docs += [(1000 + i, docs[i][1] + " " + rng.choice("abcd"), "s") for i in range(60)]
    docs += [(2000 + i, " ".join(rng.choices("ab", k=40)), "s") for i in range(200)]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(table(spark, docs), 3, 90)[0].collect()}
    want = {i: c for i, (_, c) in groups_by_force(docs, 3, 90).items()}
    assert got == want and len(set(want.values())) < len(docs) - 60
    assert sizes["tiles"] > sizes["product"] and sizes["other-pairs"] < 3000


def test_one_id_with_several_texts_has_the_links_of_all(spark):
    rng = random.Random(14)
    base = [" ".join("w%d" % rng.randrange(500) for _ in range(60)) for _ in range(4)]
    near = [b + " more" for b in base]
    docs = [(10, base[0], "s"), (10, base[1], "s"), (4, near[0], "s"), (7, near[1], "s"), (7, base[2], "s"), (20, near[2], "s"), (30, base[3], "s"), (30, None, "s"), (31, near[3], "s"), (9, base[2], "s")]
    got = Counter((r.doc_id, r.component_id) for r in ngram_join.ngram_join(table(spark, docs), 3, 90)[0].collect())
    assert got == Counter([(10, 4), (10, 4), (4, 4), (7, 4), (7, 4), (20, 4), (9, 4), (30, 30), (30, 30), (31, 30)])


def test_accumulated_overlaps():
    rng = np.random.default_rng(8)
    for size in (1, 5, 4096, 4097, 20_000):
        mine = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        others = [np.unique(np.concatenate([mine[rng.random(len(mine)) < share], rng.integers(0, 1 << 63, size // 9).astype(np.uint64)])) for share in (0.0, 0.5, 0.9, 0.97, 1.0)] + [mine[:1], mine]
        need = np.array([ngram_join._needed(np.int64(len(mine)), np.int64(len(o)), 90) for o in others])
        want = [len(np.intersect1d(mine, o)) >= n for o, n in zip(others, need, strict=True)]
        assert ngram_join._accumulate(mine, others, need).tolist() == want and want[-1]


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(9)
    for n in (1, 3, 200, 300, 3000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for extra in (0, max(1, n // 12), n):
            b = np.unique(np.concatenate([a, rng.integers(0, 1 << 63, extra).astype(np.uint64)]))
            x, y = (np.unpackbits(np.frombuffer(ngram_join._parity(s), np.uint8), bitorder="little") for s in (np.unique(a), b))
            x, y = (v.reshape(-1, min(len(x), len(y))).sum(0) % 2 for v in (x, y))
            assert (x != y).sum() <= len(np.setxor1d(a, b))


def test_token_files_refuse_ids_that_stand_for_rules(spark):
    with pytest.raises(ValueError, match="stand for rules"):
        token_store.write_token_files(empty(spark), public_tokenizers.path("byte_bpe_50k.json"))


def test_mixing_stage_keeps_rows_of_any_columns(spark):
    """Names that the stage once used itself, null ids, the id -1 and repeated ids."""
    import corpus_pipeline

    rows = [(i if i % 7 else None, f"text {i}", f"src{i % 3}", "a", "b", "c", "d") for i in range(300)] + [(-1, "minus", "src1", "a", "b", "c", "d"), (5, "again", "src2", "a", "b", "c", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _at string, _id string, position string, row string")
    out = corpus_pipeline.mixing(spark, docs, "")
    assert out.columns == docs.columns
    got = [tuple(r) for r in out.collect()]
    assert Counter(got) == Counter(rows)
    order = {r.doc_id: r.p for r in mixing.mix_sources(docs, mixing.WEIGHTS, mixing.OTHERS_WEIGHT).groupBy("doc_id").agg(F.min("position").alias("p")).collect()}
    places = [order[r[0]] for r in got]
    assert places == sorted(places)
