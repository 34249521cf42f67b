"""Alignment of two tokenizers by the bytes that their tokens cover.

Each text is encoded twice, by a byte-level BPE (A) and by a piece model (B). The ends of
A's and of B's tokens are two ascending lists of byte offsets; merging them gives a link for
each A and B token that overlap and a boundary wherever both end. The merge of a block of
documents is divided by merge-path partitioning: a binary search on each diagonal finds how
many ends of either list come before it, so the pieces between diagonals are independent and
of equal work, whatever the lengths of the documents. A piece emits its overlaps and the ends
that it finds in both lists; where an equal pair of ends lies on both sides of a cut, the
pieces are stitched: the second one's overlap is dropped and the boundary kept.

How many documents hold an id pair linked is counted over the corpus. A block of documents
hands out its distinct pairs, each with its number of documents, and not a row for each
document; counts come back to the block in the same way. So no pair, however common, has
more rows than there are blocks. Of a document only its distinct pairs, as differences of
their numbers within the block, are kept meanwhile. The best count of each A id is broadcast:
there are no more of these than A has ids.

Both vocabularies are read on the driver from paths that are parameters, and broadcast.
Null and empty texts have no tokens, nor do texts whose joined token bytes differ from the
space and text that were encoded (such as those that the piece model normalises): all their
columns are 0 and their groups are ''. Each row is a document, repeated rows too. An empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.llm import base

#: Bytes of text in a block, and steps of the merge in a piece.
BLOCK_BYTES, PIECE = 2 << 20, 1 << 16
_MADE = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, picked binary, times binary, codes array<long>, docs array<int>"
_OUT_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def byte_of_char() -> dict[str, int]:
    """The bytes that the printed characters of a byte-level vocabulary stand for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed: bytes that stand for themselves
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_byte_level(path: str) -> dict[bytes, int]:
    """Ids by token bytes; merges must be in the order of ids, as byte-level BPE is encoded by rank here."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    char, vocab = byte_of_char(), model["model"]["vocab"]
    special = {t["content"] for t in model.get("added_tokens", ())}
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
    if made != sorted(made):
        raise ValueError("merges are not in the order of ids")
    return {bytes(char[c] for c in token): i for token, i in vocab.items() if token not in special}


class Tokenizers:
    """Both encoders, with the bytes and the lengths of their tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes):
        import sentencepiece
        import tiktoken

        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = max(ranks.values()) + 1
        self.bytes_a = [b""] * size
        for token, i in ranks.items():
            self.bytes_a[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        # an id with what follows it: another of its side, or the other side or the next group
        self.shown = [f"{i}{c}" for n, cs in ((size, ",|"), (len(pieces), ",;")) for c in cs for i in range(n)]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by A and by B; none where their bytes differ from the text's."""
        none = np.zeros(0, np.int64)
        all_a, all_b = [], []
        for text in texts:
            a = b = ()
            if text:
                whole = f" {text}".encode("utf-8", "replace")
                a, b = self.a.encode_ordinary(f" {text}"), self.b.encode(text)
                if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
                    a = b = ()
            all_a.append(np.array(a, np.int64) if a else none)
            all_b.append(np.array(b, np.int64) if b else none)
        return all_a, all_b


def cuts(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the ascending a and b come before each diagonal of their merge; of equal values a's come first."""
    total = len(a) + len(b)
    diagonal = np.append(np.arange(0, total, size), total)
    low, high = np.maximum(0, diagonal - len(b)), np.minimum(diagonal, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        takes = np.zeros(len(mid), bool)
        takes[open_] = a[mid[open_]] <= b[diagonal[open_] - mid[open_] - 1]
        low, high = np.where(open_ & takes, mid + 1, low), np.where(open_ & ~takes, mid, high)
    return low, diagonal - low


def merged(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps (i, j) of the tokens that end at a and b, and the tokens (i, j) of either side that end a group."""
    at_a, at_b = cuts(a, b, size)
    links_a, links_b, ends_a, ends_b = [], [], [], []
    for i, j, i_end, j_end in zip(at_a[:-1], at_b[:-1], at_a[1:], at_b[1:], strict=True):
        own_a, own_b = a[i:i_end], b[j:j_end]
        links_a.append(np.arange(i, i_end))
        links_b.append(j + np.searchsorted(own_b, own_a))
        place = np.searchsorted(own_a, own_b)
        common = np.zeros(len(own_b), bool)
        inside = place < len(own_a)
        common[inside] = own_a[place[inside]] == own_b[inside]
        place += i
        if i and len(own_b) and a[i - 1] == own_b[0]:  # stitched: its equal is the last of the piece before
            common[0], place[0] = True, i - 1
        links_a.append(place[~common])
        links_b.append(j + np.flatnonzero(~common))
        ends_a.append(place[common])
        ends_b.append(j + np.flatnonzero(common))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (links_a, links_b, ends_a, ends_b))


def packed(values: np.ndarray) -> bytes:
    """Numbers below 2^28 in seven bits a byte, the last byte of each with its highest bit clear."""
    sizes = 1 + (values >= 1 << 7) + (values >= 1 << 14) + (values >= 1 << 21)
    at = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    for k in range(4):
        has = sizes > k
        out[at[has] + k] = (values[has] >> 7 * k & 127) | np.where(sizes[has] > k + 1, 128, 0)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.int64)
    if not len(raw):
        return raw
    starts = np.flatnonzero(np.concatenate(([True], raw[:-1] < 128)))
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127) << 7 * place, starts)


def _aligned_block(tokenizers: Tokenizers, texts: list[str | None], whole: bool) -> dict:
    """Columns for the documents of a block and, under codes and docs, its distinct pairs."""
    n = len(texts)
    all_a, all_b = tokenizers.encode(texts)
    n_a, n_b = (np.fromiter(map(len, x), np.int64, n) for x in (all_a, all_b))
    a, b = np.concatenate(all_a), np.concatenate(all_b)
    ends_a, ends_b = np.cumsum(tokenizers.size_a[a]), np.cumsum(tokenizers.size_b[b])
    i, j, last_a, last_b = merged(ends_a, ends_b)
    order = np.argsort(last_a)
    last_a, last_b = last_a[order], last_b[order]
    doc_a, doc_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    groups = np.bincount(doc_a[last_a], minlength=n)

    codes, number = np.unique(a[i] << 32 | b[j], return_inverse=True)
    keyed, times = np.unique(doc_a[i] * max(len(codes), 1) + number, return_counts=True)
    owner, pair = np.divmod(keyed, max(len(codes), 1))
    docs = np.bincount(pair, minlength=len(codes))
    first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
    gaps = np.where(first, pair, np.diff(pair, prepend=0))
    bounds = np.searchsorted(owner, np.arange(n + 1))

    # tokens in the order in which groups are shown: A's of a group, then B's
    group_a, group_b = np.searchsorted(last_a, np.arange(len(a))), np.searchsorted(last_b, np.arange(len(b)))
    through_a, before_b = last_a + 1, np.concatenate(([0], last_b[:-1] + 1)) if len(last_b) else last_b
    shown = np.empty(len(a) + len(b), np.int64)
    over_a, over_b = len(tokenizers.bytes_a), len(tokenizers.bytes_b)
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[last_a], mark_b[last_b] = over_a, over_b
    shown[np.arange(len(a)) + before_b[group_a]] = a + mark_a
    shown[np.arange(len(b)) + through_a[group_b]] = b + mark_b + 2 * over_a
    text_bounds = np.concatenate(([0], np.cumsum(n_a + n_b)))
    written = []
    for k in range(n):
        text = "".join(map(tokenizers.shown.__getitem__, shown[text_bounds[k] : text_bounds[k + 1]].tolist()))[:-1]
        written.append(text if whole or not text else hashlib.sha256(text.encode()).hexdigest())
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": groups, "n_links": n_a + n_b - groups, "groups": written,
        "picked": [packed(gaps[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)],
        "times": [packed(times[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)], "codes": codes, "docs": docs,
    }


_cached: dict[bytes, Tokenizers] = {}


def _tokenizers(sent) -> Tokenizers:
    """Made once a process for the vocabularies that were sent; of others only the last stays."""
    digest, *parts = sent.value
    if digest not in _cached:
        _cached.clear()
        _cached[digest] = Tokenizers(*parts)
    return _cached[digest]


def _blocks(batches):
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def aligned(docs: DataFrame, ranks: dict[bytes, int], pattern: str, model: bytes, whole: bool = False) -> DataFrame:
    """A row for each document, with groups as text if whole, else as its SHA-256 in hex.

    ranks are A's ids by token bytes (see read_byte_level), model is the file of B's.
    """
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(name, types[kind]) for name, kind in (field.split() for field in _MADE.split(", "))])
    digest = hashlib.sha256(model + pattern.encode() + repr(sorted(ranks.items())).encode()).digest()
    sent = docs.sparkSession.sparkContext.broadcast((digest, ranks, pattern, model))  # vocabularies are of a fixed size

    def encode(batches):
        tokenizers, task = _tokenizers(sent), TaskContext.get().partitionId()
        for number, block in enumerate(_blocks(batches)):
            n, key = block.num_rows, task << 32 | number
            if not n:
                continue
            made = _aligned_block(tokenizers, block.column(1).to_pylist(), whole)
            codes, counts = made.pop("codes"), made.pop("docs")
            columns = {"block": np.full(n, key), "doc_id": block.column(0).combine_chunks(), **made}
            yield base.batch_of(columns | {"codes": [None] * n, "docs": [None] * n}, schema)
            pairs = {"block": [key], "codes": base.lists_of(codes, len(codes), 1), "docs": base.lists_of(counts.astype(np.int32), len(codes), 1)}
            yield base.batch_of({f.name: pairs.get(f.name, [None]) for f in schema}, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = base.materialise(base.arrow_map(rows, encode, _MADE), "aligned")
    pairs = made.where("codes IS NOT NULL").select("block", F.explode(F.arrays_zip("codes", "docs")).alias("x")).select("block", F.col("x.codes").alias("code"), F.col("x.docs").alias("docs"))
    counts = base.materialise(pairs.groupBy("code").agg(F.sum("docs").alias("n")), "pair_counts")
    side = F.shiftright("code", 32).cast("int")
    best = counts.groupBy(side.alias("a")).agg(F.max("n").alias("best"))
    rated = counts.join(F.broadcast(best), side == best["a"]).select("code", "n", (F.col("n") == F.col("best")).alias("is_best"))
    back = pairs.select("block", "code").join(rated, "code")
    out_schema = pa.schema([(name, types[kind]) for name, kind in (field.split() for field in _OUT_SCHEMA.split(", "))])

    def rate(own, known):
        order = np.argsort(known.column("code").to_numpy())
        n, is_best = known.column("n").to_numpy()[order], known.column("is_best").to_numpy()[order]
        sums, bests = [], []
        for picked, times in zip(own.column("picked").to_pylist(), own.column("times").to_pylist(), strict=True):
            number, often = np.cumsum(unpacked(picked)), unpacked(times)
            sums.append(int((n[number] * often).sum()))
            bests.append(int(often[is_best[number]].sum()))
        columns = {c: own.column(c) for c in own.column_names} | {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.table({c: columns[c] for c in out_schema.names}).cast(out_schema)

    own = made.where("codes IS NULL").drop("codes", "docs").withColumnRenamed("block", "home")
    return own.groupBy("home").cogroup(back.groupBy("block")).applyInArrow(rate, _OUT_SCHEMA)


def digests(rows: DataFrame) -> DataFrame:
    """The columns of the query, from aligned() with digests."""
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
