"""Byte-level BPE: corpus-level merge replay, and decoding.

The distinct words of a block of documents are laid out as one array of byte tokens with
links between neighbours. An inverted index leads from each mergeable pair, by its rank,
to the positions where it stands. The pair of least rank is taken from a heap; at all its
positions, from the left and without overlap, the pair becomes one token, and only the two
neighbours' pairs are looked up anew and indexed. Where a merge could make a pair of lower
rank, only the first position in each word is merged at a time, and such a pair comes off
the heap next; so each word sees its merges in just the order in which they would be made
in it alone. Words are encoded once a block, however often they occur.

Blocks are the batches of a task, bounded in bytes; nothing is shuffled. A vocabulary is
read on the driver from a path that is a parameter and is never trained here.

Null texts count as empty: no ids, the digests of nothing. Repeated rows give equal rows;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.llm import base

#: Bytes of text in a block: more words share a replay in a larger one.
BLOCK_BYTES = 24 << 20
_NONE = np.int64(1) << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Vocabulary:
    """Tokens by id and the table of mergeable pairs."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = max(ranks.values()) + 1
        keys, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.int64(self.size) ** 2)
        self.made = np.append(np.array(made, np.int64)[order], _NONE)
        # a token no pair of which has a lower rank than its own: all its merges in a word can be made at once
        least = np.full(self.size, _NONE)
        np.minimum.at(least, self.keys[:-1] // self.size, self.made[:-1])
        np.minimum.at(least, self.keys[:-1] % self.size, self.made[:-1])
        self.steady = least > np.arange(self.size)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, _NONE where it can't be merged."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def _lower(self, r: int, at: np.ndarray, ids, after, before, n: int) -> np.ndarray:
        """Whether the merge at each position makes a pair below r, before or after its neighbours merge."""
        gone = after[at]
        beyond, prior = after[gone], before[at]
        out = np.zeros(len(at), bool)
        has = beyond < n
        out[has] = self.pair_ranks(np.full(has.sum(), r), ids[beyond[has]]) < r
        has = prior >= 0
        left = np.where(np.concatenate(([False], gone[:-1] == prior[1:])), r, ids[np.maximum(prior, 0)])
        out[has] |= self.pair_ranks(left[has], np.full(has.sum(), r)) < r
        return out

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and how many ids each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = raw.size
        ids = self.byte_ids[raw]
        word = np.repeat(np.arange(len(words)), lengths)
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))  # a word that is a token stays one
        alive = np.ones(n, bool)
        starts = np.cumsum(lengths) - lengths
        done = np.flatnonzero(whole >= 0)
        skip = np.repeat(whole >= 0, lengths)
        alive[skip] = False
        ids[starts[done]], alive[starts[done]] = whole[done], True
        after = np.append(np.arange(1, n), n) if n else np.zeros(0, np.int64)
        before = np.arange(-1, n - 1)
        last = starts + lengths - 1
        after[last] = n
        before[starts] = -1
        rank = np.full(n + 1, _NONE)
        open_ = np.flatnonzero(~skip & (after < n))
        rank[open_] = self.pair_ranks(ids[open_], ids[after[open_]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            at = at[rank[at] < _NONE]
            if not len(at):
                return
            if len(at) == 1:
                groups = [at]
            else:
                at = at[np.argsort(rank[at], kind="stable")]
                groups = np.split(at, np.flatnonzero(np.diff(rank[at])) + 1)
            for group in groups:
                r = int(rank[group[0]])
                if r in index:
                    index[r].append(group)
                else:
                    index[r] = [group]
                    heapq.heappush(heap, r)

        note(open_)
        while heap:
            r = heapq.heappop(heap)
            found = index.pop(r)
            at = np.unique(np.concatenate(found))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if len(at) > 1:
                # of pairs in a row that overlap, every second one is left over
                new = np.concatenate(([True], after[at[:-1]] != at[1:]))
                first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                every, at = at, at[(np.arange(len(at)) - first) % 2 == 0]
                if not self.steady[r]:
                    wait = self._lower(r, at, ids, after, before, n)
                    if wait.any():  # in words where a lower pair may come up, the first now, the others next
                        own = word[at]
                        later = np.concatenate(([False], own[1:] == own[:-1])) & np.isin(own, own[wait])
                        if later.any():
                            index[r] = [every[np.isin(word[every], own[wait])]]
                            heapq.heappush(heap, r)
                            at = at[~later]
            gone = after[at]
            ids[at] = r
            alive[gone] = False
            rank[gone] = _NONE
            beyond = after[gone]
            after[at] = beyond
            has = beyond < n
            before[beyond[has]] = at[has]
            rank[at] = _NONE
            rank[at[has]] = self.pair_ranks(ids[at[has]], ids[beyond[has]])
            prior = before[at]
            prior = prior[prior >= 0]
            rank[prior] = self.pair_ranks(ids[prior], ids[after[prior]])
            note(np.concatenate([at, prior]))
        return ids[alive], np.bincount(word[alive], minlength=len(words))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode_block(self, texts: list[str]) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """For each text the numbers of its words, then all words' ids in a row and the bounds of each word's."""
        import regex

        pattern = regex.compile(self.pattern)
        numbers: defaultdict[str, int] = defaultdict(count().__next__)
        coded = [list(map(numbers.__getitem__, pattern.findall(t))) for t in texts]
        ids, sizes = self.replay([w.encode("utf-8", "replace") for w in numbers])
        return coded, ids, np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        coded, ids, bounds = self.encode_block(texts)
        out = []
        for words in coded:
            w = np.array(words, np.int64)
            size = bounds[w + 1] - bounds[w]
            shift = np.repeat(bounds[w] - (np.cumsum(size) - size), size)
            out.append(ids[np.arange(len(shift)) + shift] if len(w) else ids[:0])
        return out


#: Vocabularies of this process, by digest; only the last few stay.
_cached: dict[bytes, Vocabulary] = {}
_KEPT = 2


def _blocks(batches, at: int):
    """Lists of rows' columns and texts, of about BLOCK_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(at).nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, number of ids, digest of the ids and digest of the bytes that they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    sent = _sent(docs, ranks, pattern)

    def run(batches):
        vocab = _of_broadcast(sent)
        for block in _blocks(batches, 1):
            coded, ids, bounds = vocab.encode_block(block.column(1).to_pylist())
            ids, bounds = ids.tolist(), bounds.tolist()
            spans = list(zip(bounds, bounds[1:], strict=False))
            written = [" ".join(map(str, ids[a:b])) for a, b in spans]
            sizes = np.diff(np.array(bounds))
            back = [vocab.decode(ids[a:b]) for a, b in spans]
            out = [
                (
                    int(sizes[words].sum()) if words else 0,
                    hashlib.sha256(" ".join(map(written.__getitem__, words)).encode()).hexdigest(),
                    hashlib.sha256(b"".join(map(back.__getitem__, words))).hexdigest(),
                )
                for words in coded
            ]
            if out:
                n, a, b = zip(*out, strict=True)
                yield base.batch_of({"doc_id": block.column(0).combine_chunks(), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.text_or_empty().alias("text"))
    return base.arrow_map(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _sent(df: DataFrame, ranks: dict[bytes, int], pattern: str):
    """A broadcast of the vocabulary, of its fixed size, and of the digest by which workers know it."""
    digest = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).digest()
    return df.sparkSession.sparkContext.broadcast((digest, ranks, pattern))


def _of_broadcast(sent) -> Vocabulary:
    digest, ranks, pattern = sent.value
    if digest not in _cached:
        while len(_cached) >= _KEPT:
            del _cached[next(iter(_cached))]
        _cached[digest] = Vocabulary(ranks, pattern)
    return _cached[digest]


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and the ids of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    sent = _sent(docs, ranks, pattern)

    def run(batches):
        vocab = _of_broadcast(sent)
        for block in _blocks(batches, 1):
            found = [i.astype(np.int32) for i in vocab.encode(block.column(1).to_pylist())]
            yield base.batch_of({"doc_id": block.column(0).combine_chunks(), "ids": found}, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.text_or_empty().alias("text"))
    return base.arrow_map(rows, run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    sent = _sent(rows, ranks, pattern)

    def run(batches):
        vocab = _of_broadcast(sent)
        for batch in batches:
            texts = [vocab.decode(ids or ()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield base.batch_of({"doc_id": batch.column(0), "text": texts}, schema)

    return base.arrow_map(rows.select("doc_id", "ids"), run, "doc_id long, text string")
