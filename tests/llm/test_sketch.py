"""The bucket counts of the n-gram join never discard a pair that reaches the threshold."""

import numpy as np
import pyarrow as pa

from tabulith.llm.ngram_join import _needed, _possible, _sketch


def test_sketch_keeps_every_link():
    draw = np.random.default_rng(3)
    sets = []
    for n in (1, 2, 15, 16, 33, 127, 128, 129, 600, 5000, 40000):
        base = draw.integers(0, 2**63, n).astype(np.uint64)
        sets += [base, base[: max(1, n * 19 // 20)], np.append(base, draw.integers(0, 2**63, max(1, n // 12)).astype(np.uint64)), draw.integers(0, 2**63, n).astype(np.uint64)]
    sets.append((np.arange(300) << 12).astype(np.uint64))  # one bucket holds more than a byte counts
    assert _sketch(sets[-1]) is None and _sketch(sets[0][:0]) is None
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    cols = {"a": [i for i, _ in pairs], "b": [j for _, j in pairs], "na": [len(sets[i]) for i, _ in pairs], "nb": [len(sets[j]) for _, j in pairs]}
    made = [_sketch(s) for s in sets]
    batch = pa.RecordBatch.from_pydict(cols | {"ha": pa.array([made[i] for i, _ in pairs], pa.binary()), "hb": pa.array([made[j] for _, j in pairs], pa.binary())})
    out = next(_possible(90)(iter([batch])))
    kept = set(zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True))
    linked = {(i, j) for i, j in pairs if len(np.intersect1d(sets[i], sets[j])) >= _needed(np.int64(len(sets[i])), np.int64(len(sets[j])), 90)}
    assert linked and linked <= kept
    assert len(kept) < len(pairs) // 2
