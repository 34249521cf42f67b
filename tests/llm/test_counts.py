"""Numbers of tokens counted word by word, sets compared as bytes, darts of many sets at once."""

import random

import numpy as np
import pyarrow as pa

from tests.llm import fixtures
from trailhead.llm import neardup, packing, shingles
from trailhead.llm.queries import ranks_and_pattern

PARTS = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\xa0", "\x85", " ", "　", "​", "a", "Bc", "don't", "'s", "12", "é", "ß", "中文", "!", "?!", "—", "x" * 300, "😀"]


def counts_of(counts, texts):
    return np.concatenate([counts(laid) for laid in shingles.laid_out(texts)]).tolist()


def test_counts_by_word_equal_the_library(monkeypatch):
    ranks, pattern = ranks_and_pattern()
    encode = packing.tokenizer(ranks, pattern)
    rng = random.Random(8)
    texts = [t or "" for t in fixtures.texts() if len(t or "") < 10_000] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(3_000)]
    wanted = [len(encode(t)) for t in texts]
    assert packing.BY_WORD == pattern
    assert counts_of(packing.Counts(ranks, pattern), texts) == wanted
    monkeypatch.setattr(packing.Counts, "SLOTS", 10)  # words take each other's slots
    counts = packing.Counts(ranks, pattern)
    assert counts_of(counts, texts) == wanted and counts_of(counts, texts[::-1]) == wanted[::-1]
    other = r"\S+\s*|\s+"  # matches go on from a word to white space
    encode = packing.tokenizer(ranks, other)
    assert counts_of(packing.Counts(ranks, other), texts) == [len(encode(t)) for t in texts]


def test_each_word_is_encoded_about_once():
    """The finding on op10: encoding each text whole took more than half of its CPU seconds."""
    ranks, pattern = ranks_and_pattern()
    rng = random.Random(9)
    texts = [fixtures.prose(rng, 500) for _ in range(200)]
    counts, sent = packing.Counts(ranks, pattern), []
    encode = counts.encode
    counts.encode = lambda text: (sent.append(text), encode(text))[1]
    assert counts_of(counts, texts) == [len(encode(t)) for t in texts]
    assert sum(map(len, sent)) < 0.05 * sum(map(len, texts))


def test_sets_as_bytes_compare_as_sets():
    rng = random.Random(10)
    pairs = [([], []), ([], [1]), ([1, 2, 3, 4], [1, 2, 3, 4, 5]), ([1, 2, 3], [1, 2, 3, 4]), ([2**32 - 1, 0], [0, 2**32 - 1])]
    for _ in range(200):
        whole = rng.sample(range(1 << 32), 40)
        pairs.append((whole[: rng.randint(30, 40)], whole[rng.randint(0, 6) :]))
    x, y = (pa.array([np.array(sorted(p[i]), np.uint32).tobytes() for p in pairs], pa.binary()) for i in (0, 1))
    wanted = [5 * len({*a} & {*b}) >= 4 * len({*a} | {*b}) for a, b in pairs]
    assert neardup._similar(x, y, 0.8).tolist() == wanted and 0 < sum(wanted) < len(pairs)
    assert neardup._similar(x[:0], y[:0], 0.8).tolist() == []


def test_darts_of_many_sets_are_those_of_each():
    sets = [np.unique(shingles.mix(np.arange(a, a + n, dtype=np.uint64))) for a, n in ((0, 1), (5, 0), (3, 700), (900, 40), (3, 5000))]
    weights = [1.0 + (s % np.uint64(7 if i % 2 else 1)).astype(float) for i, s in enumerate(sets)]
    found = neardup.darts_of(np.concatenate(sets), np.concatenate(weights), np.array([len(s) for s in sets]))
    for s, w, row in zip(sets, weights, found, strict=True):
        assert (neardup.darts(s, w) == row).all() if len(s) else not row.any()
    for k in (100, neardup.K):  # a dart names its coordinate, whatever their number
        row = neardup.darts(sets[2], k=k)
        assert (row % np.uint64(k) == np.arange(k, dtype=np.uint64)).all()
