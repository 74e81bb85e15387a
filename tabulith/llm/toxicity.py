"""Toxic spans by a linear-chain conditional random field with two tags, trained on documents' labels.

Words are labelled for training from the documents' labels: a word is toxic in a toxic document if it, or its first four to eight bytes, stands in
many places of toxic documents and in hardly any of others.  The field has weights for hashed features of a word (itself, its first
four to eight bytes, its last three) and for the transitions of tags.  Forward-backward marginals give the
expected number of toxic words and the surest one; a logistic curve over both, fitted on the same documents, is the score.
"""

from __future__ import annotations

import io
import itertools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS = 1 << 18
#: Lengths in bytes of the beginnings of words.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Toxic documents that training sees at most, and twice as many others: a fixed bound, drawn by a hash of the id.
SAMPLE = 1000
#: Bytes of text that the training task reads at most: documents beyond, in the order of the hash, are left out.
SAMPLE_BYTES = 96 << 20
#: Words of one batch of chains, and words whose weight a worker remembers.
BATCH, KNOWN = 250_000, 400_000


def split(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").lower().encode())


def features(word: bytes) -> list[int]:
    """Hashed features of a word and the bias 0; those that its length does not give are 0 too."""
    out = [zlib.crc32(word) % (BUCKETS - 1) + 1]
    for k in BEGINNINGS:
        out.append(zlib.crc32(word[:k], k) % (BUCKETS - 1) + 1 if len(word) >= k else 0)
    out.append(zlib.crc32(word[-3:], 3) % (BUCKETS - 1) + 1 if len(word) >= 3 else 0)
    return [*out, 0]


def chain_marginals(emission: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over many chains laid end to end.

    emission: log-odds of the toxic tag for each word; first: whether a word begins a chain; start and step: positive potentials of
    the first tag and of pairs of tags.  Returns the marginal of the toxic tag for each word and the expected counts of pairs.
    The words are cut into columns that are walked together; products of 2 x 2 matrices carry the state from column to column.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    width = max(1, int(np.sqrt(n)) * 2)
    height = -(-n // width)
    pad = width * height - n
    x = np.exp(np.clip(np.concatenate([emission, np.zeros(pad)]), -30, 30)).reshape(width, height).T
    new = np.concatenate([first, np.ones(pad, bool)]).reshape(width, height).T
    m = np.empty((2, 2, height, width))
    for i in (0, 1):
        m[i, 0] = np.where(new, start[0], step[i, 0])
        m[i, 1] = np.where(new, start[1], step[i, 1]) * x
    product = m[:, :, 0].copy()
    for t in range(1, height):
        a, b, c, d = product[0, 0], product[0, 1], product[1, 0], product[1, 1]
        e = m[:, :, t]
        product = np.array([[a * e[0, 0] + b * e[1, 0], a * e[0, 1] + b * e[1, 1]], [c * e[0, 0] + d * e[1, 0], c * e[0, 1] + d * e[1, 1]]])
        product /= product.sum((0, 1))
    ahead, behind = np.empty((2, width)), np.empty((2, width))
    state = (0.5, 0.5)
    flat = product.reshape(4, width).T.tolist()
    for k, (a, b, c, d) in enumerate(flat):
        ahead[:, k] = state
        u, v = state[0] * a + state[1] * c, state[0] * b + state[1] * d
        state = (u / (u + v), v / (u + v))
    state = (0.5, 0.5)
    for k in range(width - 1, -1, -1):
        behind[:, k] = state
        a, b, c, d = flat[k]
        u, v = a * state[0] + b * state[1], c * state[0] + d * state[1]
        state = (u / (u + v), v / (u + v))
    alpha = np.empty((2, height + 1, width))
    alpha[:, 0] = ahead
    for t in range(height):
        u = alpha[0, t] * m[0, 0, t] + alpha[1, t] * m[1, 0, t]
        v = alpha[0, t] * m[0, 1, t] + alpha[1, t] * m[1, 1, t]
        s = u + v
        alpha[0, t + 1], alpha[1, t + 1] = u / s, v / s
    toxic, pairs = np.empty((height, width)), np.zeros((2, 2))
    beta = behind
    for t in range(height - 1, -1, -1):
        u, v = alpha[0, t + 1] * beta[0], alpha[1, t + 1] * beta[1]
        toxic[t] = v / (u + v)
        joint = alpha[:, t][:, None] * m[:, :, t] * beta[None]
        joint /= joint.sum((0, 1))
        pairs += np.where(new[t], 0, joint).sum(-1)
        beta = np.array([m[0, 0, t] * beta[0] + m[0, 1, t] * beta[1], m[1, 0, t] * beta[0] + m[1, 1, t] * beta[1]])
        beta = beta / beta.sum(0)
    return toxic.T.reshape(-1)[:n], pairs


def marginals_by_parts(emission: np.ndarray, first: np.ndarray, start: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same over parts of about BATCH words, cut where chains begin, to bound memory."""
    heads = np.flatnonzero(first)
    cuts = heads[np.unique(np.searchsorted(heads, np.arange(0, len(emission), BATCH)).clip(0, max(0, len(heads) - 1)))] if len(heads) else [0]
    edges = np.unique(np.concatenate([[0], cuts, [len(emission)]])).astype(int)
    parts = [chain_marginals(emission[a:b], first[a:b], start, step) for a, b in itertools.pairwise(edges)]
    return np.concatenate([p[0] for p in parts]) if parts else np.zeros(0), sum((p[1] for p in parts), np.zeros((2, 2)))


@dataclass
class Model:
    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray
    curve: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, weights=self.weights, start=self.start, step=self.step, curve=self.curve)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Model:
        parts = np.load(io.BytesIO(data), allow_pickle=False)
        return Model(*(parts[k] for k in ("weights", "start", "step", "curve")))

    def emissions(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        return self.weights[np.array([features(w) for w in words])].sum(1).astype(np.float64)

    def score(self, expected: np.ndarray, surest: np.ndarray) -> np.ndarray:
        z = self.curve[0] + self.curve[1] * surest + self.curve[2] * np.log1p(expected)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _per_doc(marginal: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and maximum over each document's words."""
    total = np.concatenate([[0.0], np.cumsum(marginal)])
    filled = bounds[1:] > bounds[:-1]
    most = np.zeros(len(bounds) - 1)
    if filled.any():
        most[filled] = np.maximum.reduceat(marginal, bounds[:-1][filled])
    return np.maximum(total[bounds[1:]] - total[bounds[:-1]], 0), most


def toxic_words(vocabulary: list[bytes], of: np.ndarray, in_toxic: np.ndarray) -> np.ndarray:
    """Which words stand, themselves or with their beginning, between too many pairs of neighbours in toxic documents to be chance.

    ``of`` has the number of each running word, ``in_toxic`` whether its document is toxic.  Neighbours are counted, not
    documents, since copies of a toxic document repeat its harmless words too.  The least number is such that, of all
    words, fewer than 0.05 would by chance stand in toxic documents alone; one place in others is allowed for each 40 times as
    many as their numbers of words suggest.  A beginning counts only if no single word has more than half of its places.
    """
    framed = np.concatenate([[-1], of, [-1]]).astype(np.uint64)
    place = (framed[:-2] * np.uint64(0x9E3779B97F4A7C15) + framed[2:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)
    share = (1 + in_toxic.sum()) / (2 + len(of))
    scale = 40 * share / (1 - share)

    def places(codes: np.ndarray, n: int, rows: np.ndarray) -> np.ndarray:
        pairs = np.unique((codes[of[rows]].astype(np.uint64) << np.uint64(32)) | place[rows])
        return np.bincount((pairs >> np.uint64(32)).astype(np.int64), minlength=n)

    own = np.arange(len(vocabulary))
    bad, good = places(own, len(own), in_toxic), places(own, len(own), ~in_toxic)
    least = max(5, int(np.ceil(np.log(0.05 / max(1, int((bad >= 5).sum()))) / np.log(min(share, 0.9)))))
    hit = (bad >= least) & (bad > scale * good)
    for k in BEGINNINGS:
        keys, codes = np.unique(np.array([w[:k] if len(w) > k else b"" for w in vocabulary], f"S{k}"), return_inverse=True)
        most = np.zeros(len(keys), np.int64)
        np.maximum.at(most, codes, bad)
        b, g = places(codes, len(keys), in_toxic), places(codes, len(keys), ~in_toxic)
        good_keys = (b >= least) & (b > scale * g) & (most <= b / 2) & (keys != b"")
        hit |= good_keys[codes]
    return hit


def train(texts: list[str | None], toxic: list[int], rounds: int = 15, rate: float = 0.6, decay: float = 1e-3) -> Model:
    """Fit the field on the word labels by gradient steps, then the curve on the documents' labels."""
    labels = np.array(toxic, bool)
    kinds: dict[bytes, int] = {}
    runs = [np.array([kinds.setdefault(w, len(kinds)) for w in split(t)], np.int32) for t in texts]
    bounds = np.cumsum([0, *map(len, runs)])
    of = np.concatenate(runs).astype(np.int64) if runs else np.zeros(0, np.int64)
    n_docs = len(runs)
    del runs
    vocabulary = list(kinds)
    table = np.array([features(w) for w in vocabulary], np.int64).reshape(-1, len(BEGINNINGS) + 3)
    in_toxic = np.repeat(labels, np.diff(bounds))
    hit = toxic_words(vocabulary, of, in_toxic) if len(of) else np.zeros(0, bool)
    tag = (hit[of] & in_toxic).astype(np.float64) if len(of) else np.zeros(0)
    first = np.zeros(len(of), bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    weights, past = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    weights[0] = -1.0  # at least once in every word: the bias
    step_log, step_past = np.zeros((2, 2)), np.full((2, 2), 1e-8)
    wanted = np.zeros((2, 2))
    if len(of) > 1:
        inner = ~first[1:]
        np.add.at(wanted, (tag[:-1][inner].astype(int), tag[1:][inner].astype(int)), 1)
    start = np.ones(2)
    for _ in range(rounds if len(of) else 0):
        toxic_now, pairs = marginals_by_parts(weights[table].sum(1)[of], first, start, np.exp(step_log))
        by_kind = np.bincount(of, weights=tag - toxic_now, minlength=len(vocabulary))
        grad = np.bincount(table.reshape(-1), weights=np.repeat(by_kind, table.shape[1]), minlength=BUCKETS) - decay * weights
        past += grad * grad
        weights += rate * grad / np.sqrt(past)
        step_grad = wanted - pairs
        step_past += step_grad**2
        step_log += 0.2 * step_grad / np.sqrt(step_past)
    model = Model(weights.astype(np.float32), start, np.exp(step_log), np.array([-3.0, 0.0, 0.0]))
    marginal, _ = marginals_by_parts(model.emissions(vocabulary)[of] if len(of) else np.zeros(0), first, model.start, model.step)
    expected, surest = _per_doc(marginal, bounds)
    x = np.stack([np.ones(n_docs), surest, np.log1p(expected)], 1) if n_docs else np.zeros((0, 3))
    curve = np.array([-2.0, 1.0, 1.0])
    for _ in range(60 if n_docs and labels.any() and not labels.all() else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        curve = curve + np.linalg.solve(hessian, x.T @ (labels - p) - 0.1 * curve)
    model.curve = curve if labels.any() else np.array([-6.0, 0.0, 0.0])
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are kept from training: crc32 of the id as text, modulo 4, is 2; false without an id (such rows have no label either)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` toxic and twice as many other labelled documents, those with the smallest hashes of their ids, up to SAMPLE_BYTES.

    Rows that are held out, have no label, or whose id is null are never seen.  Of rows with one id the smallest text counts.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = known.where("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(sample).union(known.where("toxic = 0").orderBy(F.xxhash64("doc_id")).limit(2 * sample))
    # at most 3 x sample ids are broadcast, and as many texts come to the one task that trains
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # a window over at most 3 x sample rows
    total = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_bytes", total).where(F.col("_bytes") <= SAMPLE_BYTES)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        yield pa.RecordBatch.from_arrays([pa.array([train([t for _, t, _ in seen], [x for _, _, x in seen]).dump()], pa.binary())], names=["model"])

    trained = rows.select("doc_id", "text", "toxic").repartition(1).mapInArrow(learn, "model binary").first()
    return Model.load(trained.model) if trained else train([], [])  # no task runs over a plan that is known to be empty


_weights: dict[bytes, float] = {}
_owner: list[Model] = []


def _emission_of(model: Model, words: list[bytes]) -> np.ndarray:
    if not _owner or _owner[0] is not model:
        _owner[:] = [model]
        _weights.clear()
    new = set(words).difference(_weights)
    if len(_weights) + len(new) > KNOWN:
        _weights.clear()
        new = set(words)
    if new:
        listed = list(new)
        _weights.update(zip(listed, model.emissions(listed).tolist(), strict=True))
    return np.fromiter(map(_weights.__getitem__, words), np.float64, len(words))


def score_texts(model: Model, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For successive runs of texts: scores, marginals of all their words, and the bounds of each text's words."""
    at = 0
    while at < len(texts):
        words: list[bytes] = []
        bounds = [0]
        while at < len(texts) and len(words) < BATCH:
            words += split(texts[at])
            bounds.append(len(words))
            at += 1
        edges = np.array(bounds)
        first = np.zeros(len(words), bool)
        first[edges[:-1][np.diff(edges) > 0]] = True
        marginal, _ = chain_marginals(_emission_of(model, words), first, model.start, model.step)
        expected, surest = _per_doc(marginal, edges)
        yield model.score(expected, surest), marginal, edges


def spans(text: str, marginal: np.ndarray, least: float = 0.5) -> list[tuple[int, int]]:
    """Places (begin, end), in characters of the text itself, of runs of words whose marginal reaches ``least``."""
    low = text.lower()
    data = low.encode()
    found: list[tuple[int, int]] = []
    last = -2
    for i, m in enumerate(WORD.finditer(data)):
        if marginal[i] >= least:
            if last == i - 1:
                found[-1] = (found[-1][0], m.end())
            else:
                found.append(m.span())
            last = i
    if not found:
        return found
    # bytes of the lowered text to characters of it, then to those of the text where lowering makes one character more
    starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    at = [(int(np.searchsorted(starts, a)), int(np.searchsorted(starts, b))) for a, b in found]
    if len(low) == len(text):
        return at
    grown = np.cumsum([0, *(len(c.lower()) for c in text)])
    return [(int(np.searchsorted(grown, a, "right")) - 1, int(np.searchsorted(grown, b, "left"))) for a, b in at]


def tag_documents(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted and toxic spans (begin and end in characters of the text) of every row.

    Spans are the words whose marginal reaches one half, in a predicted document at least its surest words.  A null or empty text has no words and gets the curve's lowest score.  Null ids and repeated rows stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[1].to_pylist()
            scores: list[float] = []
            found: list[list[tuple[int, int]]] = []
            for part, marginal, edges in score_texts(shared.value, texts):
                for i, score in enumerate(part.tolist()):
                    own = marginal[edges[i] : edges[i + 1]]
                    most = float(own.max()) if len(own) else 0.0
                    found.append(spans(texts[len(scores)], own, min(0.5, most)) if len(own) and (most >= 0.5 or score >= threshold) else [])
                    scores.append(score)
            flags = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(scores, pa.float64()), pa.array(flags, pa.int32()), pa.array([[list(s) for s in f] for f in found], schema.types[3])], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, spans array<array<long>>")


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose score stays below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [s for part, _, _ in score_texts(shared.value, batch[at].to_pylist()) for s in part.tolist()]
            yield batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = tag_documents(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.to_json("spans").alias("spans"))
