"""Token ids in Re-Pair grammar files: per shard, frequent id pairs become nonterminals; rules keep expansion lengths.

A file holds one shard of consecutive documents (all numbers little-endian):

    magic ``RPG1``, then uint32: documents, rules, symbols; uint64: tokens
    rules: uint16 left, uint16 right, uint32 expansion length for each
    documents: int64 key, uint32 first symbol, uint32 first token for each
    symbols: uint16 each

Symbols below FIRST_RULE are token ids, END stands for the end id and the end of a document, all others are rules.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulith.llm.common import partitions, stash
from tabulith.llm.kernels import gather

END_ID = 2
END = 65535
FIRST_RULE = 49408
#: A shard is closed when it has this many tokens; a longer document is a shard alone.
SHARD_TOKENS = 2_000_000
#: A pair with this many places is frequent; so many of the most frequent pairs are replaced in a round.
LEAST_PAIRS, RULES_A_ROUND = 16, 2000
_HEAD = np.dtype([("magic", "S4"), ("docs", "<u4"), ("rules", "<u4"), ("symbols", "<u4"), ("tokens", "<u8")])
_RULE = np.dtype([("left", "<u2"), ("right", "<u2"), ("length", "<u4")])
_DOC = np.dtype([("key", "<i8"), ("symbol", "<u4"), ("token", "<u4")])

_encoders: dict[str, Encoder] = {}


class _Words(dict[bytes, int]):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


class Encoder:
    """Ids of whole texts through the tokenizers library, which is asked once for each distinct word.

    White space always separates pieces of this kind of tokenizer and is dropped, so a text's ids are those of its
    words in a row; a letter and a mark after it are never in one piece, so a word ends between them too.  Words of
    Latin letters are single pieces and go to the library's model; all others take the library's whole pipeline.
    Words are forgotten when more than ``most`` are held.
    """

    def __init__(self, path: str, most: int = 1_200_000):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.most = most
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.letters = {b: 256 + i for i, b in enumerate(odd)}
        # letters with one code point under NFC and a lower case of one code point
        self.plain = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\Z")
        self.clear()

    def clear(self) -> None:
        self.index = _Words()
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0
        self.begin, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def piece(self, word: bytes) -> list[int]:
        if word.isalpha():  # ASCII, lower-cased where the text was cut
            return [t.id for t in self.model.tokenize(word.decode())]
        if self.plain.match(word):
            return [t.id for t in self.model.tokenize(word.decode().lower().encode().decode("latin-1").translate(self.letters))]
        return self.whole.encode(word.decode(), add_special_tokens=False).ids

    def learn(self) -> None:
        """Fetch the ids of the words numbered since the last call."""
        pieces = list(map(self.piece, islice(self.index, len(self.length), None)))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = self.used + int(lengths.sum())
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(end - len(self.flat), len(self.flat)), np.uint16)])
        self.flat[self.used : end] = np.fromiter(chain.from_iterable(pieces), np.uint16, end - self.used)
        self.begin = np.concatenate([self.begin, self.used + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.used = end

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as uint16."""
        if len(self.index) > self.most:
            self.clear()
        split, counts, out = [], [], []
        for text in texts:
            # a special token's string is one wherever the library sees it, whatever its case
            words = [] if "<|" in text else _apart(text.encode().lower()).split()
            split += words
            counts.append(len(words))
        at = np.fromiter(map(self.index.__getitem__, split), np.int64, len(split))
        self.learn()
        lengths = self.length[at]
        ids = gather(self.flat, self.begin[at], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *counts])]
        for i, text in enumerate(texts):
            out.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint16) if "<|" in text else ids[ends[i] : ends[i + 1]])
        return out


_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
# second bytes of the letters from U+00C0 to U+00FF, whose first byte is LATIN
LATIN = 0xC3
_SECOND = np.zeros(256, bool)
_SECOND[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def _apart(data: bytes) -> bytes:
    """A blank between a letter (a-z or U+00C0 to U+00FF) and an ASCII mark after it, but for an apostrophe."""
    raw = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_MARK[raw[1:]]) if len(raw) > 1 else np.zeros(0, np.int64)
    before = raw[at]
    letter = _LETTER[before] | _SECOND[before] & (raw[np.maximum(at - 1, 0)] == LATIN)
    at = at[letter] + 1
    return np.insert(raw, at, 32).tobytes() if len(at) else data


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _apart_in_runs(hit: np.ndarray) -> np.ndarray:
    """Which of rising places to keep so that none follows another directly: in a run, every second from its first."""
    run = np.flatnonzero(np.concatenate([[True], np.diff(hit) > 1]))
    return (np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0


def _frequent(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (left << 16 | right) inside documents with at least LEAST_PAIRS places, and their places."""
    pairs = ((symbols[:-1].astype(np.uint32) << np.uint32(16)) | symbols[1:])[(symbols[:-1] != END) & (symbols[1:] != END)]
    if not len(pairs):
        return pairs, np.zeros(0, np.int64)
    pairs.sort()
    cut = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    counts = np.diff(np.append(cut, len(pairs)))
    often = counts >= LEAST_PAIRS
    return pairs[cut[often]], counts[often]


def compress(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair in rounds, until no pair is frequent or the 16-bit symbols run out.

    A round replaces the RULES_A_ROUND most frequent pairs at once, from the left and without overlap; a pair that
    others leave no place gets no rule.  Each round shortens the symbols.
    """
    rules: list[np.ndarray] = []
    lengths, following = np.ones(65536, np.uint32), FIRST_RULE
    while following < END:
        kinds, counts = _frequent(symbols)
        if not len(kinds):
            break
        kinds = np.sort(kinds[np.argsort(-counts, kind="stable")[: min(RULES_A_ROUND, END - following)]])
        starts, ends = np.zeros(65536, bool), np.zeros(65536, bool)
        starts[kinds >> np.uint32(16)], ends[kinds & np.uint32(0xFFFF)] = True, True
        hit = np.flatnonzero(starts[symbols[:-1]] & ends[symbols[1:]])
        pairs = (symbols[hit].astype(np.uint32) << np.uint32(16)) | symbols[hit + 1]
        which = np.minimum(np.searchsorted(kinds, pairs), len(kinds) - 1)
        real = kinds[which] == pairs
        hit, which = hit[real], which[real]
        kept = _apart_in_runs(hit)
        hit, which = hit[kept], which[kept]
        used = np.bincount(which, minlength=len(kinds)) > 0
        new = np.zeros(int(used.sum()), _RULE)
        new["left"], new["right"] = kinds[used] >> np.uint32(16), kinds[used] & np.uint32(0xFFFF)
        new["length"] = lengths[new["left"]] + lengths[new["right"]]
        made = (following + np.cumsum(used) - 1).astype(np.uint16)
        lengths[following : following + len(new)] = new["length"]
        following += len(new)
        rules.append(new)
        symbols = symbols.copy()
        symbols[hit] = made[which]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols = symbols[keep]
    return symbols, np.concatenate(rules) if rules else np.zeros(0, _RULE)


def write_shard(keys: list[int], docs: list[np.ndarray]) -> bytes:
    """One file of the given documents' ids (without end ids, which the file adds)."""
    parts = [p for d in docs for p in (d, np.array([END], np.uint16))]
    symbols, rules = compress(np.concatenate(parts).astype(np.uint16) if parts else np.zeros(0, np.uint16))
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    index = np.zeros(len(docs), _DOC)
    index["key"] = keys
    index["token"] = np.cumsum(sizes) - sizes
    if docs:
        index["symbol"] = np.concatenate([[0], np.flatnonzero(symbols == END)[:-1] + 1])
    head = np.array([(b"RPG1", len(docs), len(rules), len(symbols), sizes.sum())], _HEAD)
    return head.tobytes() + rules.tobytes() + index.tobytes() + symbols.astype("<u2").tobytes()


class Shard:
    """A file read back; ``ids`` expands a document, ``token`` finds one id by descending the rules' lengths."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, _HEAD, 1)[0]
        if head["magic"] != b"RPG1":
            raise ValueError("not a token file")
        at = _HEAD.itemsize
        self.tokens = int(head["tokens"])
        self.rules = np.frombuffer(data, _RULE, int(head["rules"]), at)
        at += self.rules.nbytes
        self.index = np.frombuffer(data, _DOC, int(head["docs"]), at)
        at += self.index.nbytes
        self.symbols = np.frombuffer(data, "<u2", int(head["symbols"]), at)
        self._flat: np.ndarray | None = None

    def _table(self) -> None:
        n = FIRST_RULE + len(self.rules)
        self._length = np.ones(65536, np.int64)
        self._length[FIRST_RULE:n] = self.rules["length"]
        self._start = np.arange(65536, dtype=np.int64)
        self._start[FIRST_RULE:n] = 65536 + np.cumsum(self._length[FIRST_RULE:n]) - self._length[FIRST_RULE:n]
        flat = np.zeros(65536 + int(self._length[FIRST_RULE:n].sum()), np.uint16)
        flat[:FIRST_RULE] = np.arange(FIRST_RULE)
        flat[END] = END_ID
        for i, (left, right, _) in enumerate(self.rules.tolist()):
            at = self._start[FIRST_RULE + i]
            for part in (left, right):
                size = self._length[part]
                flat[at : at + size] = flat[self._start[part] : self._start[part] + size]
                at += size
        self._flat = flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if self._flat is None:
            self._table()
        return gather(self._flat, self._start[symbols], self._length[symbols])

    def bounds(self, i: int) -> tuple[int, int]:
        return int(self.index["symbol"][i]), int(self.index["symbol"][i + 1]) if i + 1 < len(self.index) else len(self.symbols)

    def ids(self, i: int) -> np.ndarray:
        """All ids of document ``i``, the end id included."""
        a, b = self.bounds(i)
        return self.expand(self.symbols[a:b])

    def token(self, i: int, position: int) -> int:
        """The id at a position of document ``i`` without expanding the document."""
        a, b = self.bounds(i)
        size = lambda s: int(self.rules["length"][s - FIRST_RULE]) if FIRST_RULE <= s < END else 1
        for symbol in map(int, self.symbols[a:b]):
            if position >= size(symbol):
                position -= size(symbol)
                continue
            while FIRST_RULE <= symbol < END:
                left, right, _ = map(int, self.rules[symbol - FIRST_RULE])
                symbol = left if position < size(left) else right
                position -= 0 if symbol == left and position < size(left) else size(left)
            return END_ID if symbol == END else symbol
        raise IndexError(position)


_FILES = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("data", pa.binary())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
NO_KEY = -(1 << 63)


def write_token_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and pack the ids into shard files (shard, n_docs, n_tokens, data) in ascending id order.

    ``shard`` rises with the ids.  A null text has no ids but its end id; null ids come first (key NO_KEY); rows with the
    same id are ordered by text.  An empty table gives no files; other columns are not read.  A tokenizer with ids beyond the
    file's symbols for tokens is refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        keys: list[int] = []
        held: list[np.ndarray] = []
        tokens, number = 0, TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            nonlocal keys, held, tokens, number
            row = [[number], [len(keys)], [tokens], [write_shard(keys, held)]]
            keys, held, tokens, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, _FILES.types, strict=True)], schema=_FILES)

        for batch in batches:
            ids, texts = batch[0].to_pylist(), batch[1].to_pylist()
            for a in range(0, len(ids), 512):
                for key, got in zip(ids[a : a + 512], enc.many([t or "" for t in texts[a : a + 512]]), strict=True):
                    if held and tokens + len(got) + 1 > SHARD_TOKENS:
                        yield close()
                    keys.append(NO_KEY if key is None else key)
                    held.append(got)
                    tokens += len(got) + 1
        if held:
            yield close()

    from tokenizers import Tokenizer

    if Tokenizer.from_file(tokenizer).get_vocab_size() > FIRST_RULE:
        raise ValueError(f"ids from {FIRST_RULE} up stand for rules in these files")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, "shard long, n_docs long, n_tokens long, data binary")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, shard, at (first token in its shard), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch[0].to_pylist(), batch[1], strict=True):
                shard = Shard(data.as_py())
                out = []
                for i, (key, _, at) in enumerate(shard.index.tolist()):
                    ids = shard.ids(i)
                    out.append((None if key == NO_KEY else key, number, at, len(ids), zlib.crc32(ids.astype("<u4"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _DOCS.types, strict=True)], schema=_DOCS)

    return files.select("shard", "data").mapInArrow(run, "doc_id long, shard long, at long, n_tokens long, ids_crc32 long")


def op1_token_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    files = stash(write_token_files(docs, tokenizer), "tokens")
    # a row for each file of two million tokens: one sorted task of a few bytes a file
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shift = files.select("shard", F.coalesce(before, F.lit(0)).alias("shift"))
    rows = read_token_files(files).join(shift, "shard")
    return rows.select("doc_id", (F.col("shift") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")
