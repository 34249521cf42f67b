"""Packing of documents into sequences of fixed length, and the binary output of packed ids.

Two packers, both best-fit-decreasing within blocks of a task's documents. A block is
bounded in tokens, so memory is too, nothing is shuffled, and a lost task is simply run
again. Documents longer than a sequence are cut into whole sequences and a rest, losing
nothing.

``pack`` finds the tightest bin by a segment tree over residual capacities: a node holds
whether any bin below it is open, and a descent leads to the least residual that suffices.

``pack_apart`` keeps bins in the order of their residuals, with bitmaps of the bins that hold
each source and each duplicate cluster. From the least residual that suffices the search goes
on from successor to successor until a bin holds neither the document's source nor its cluster;
where there is none, a bin is opened: no bin has two
pieces of one source or of one cluster, whatever their shares and however the input is
split. So there are at least as many bins as pieces of the most frequent source. Documents
without source or cluster (null) conflict with none; nor do those of a table without sources.

Null texts count as empty; an empty text has just the end mark in ``pack`` and a piece of
length 0 is not placed in ``pack_apart`` unless marks are counted (they are, by default).
Repeated rows are packed each. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.llm import base, neardup, shingles

LENGTH = 4096
#: Tokens of a block of documents that are packed together, and documents where bitmaps are kept.
BLOCK_TOKENS, BLOCK_ROWS = 4 << 20, 1 << 16
#: Sequences of a written id matrix.
MATRIX_ROWS = 128


class Residuals:
    """Segment tree over residual capacities 0 to size, with the open bins of each."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.filled = np.zeros(2 * self.leaves, np.int64).tolist()
        self.bins: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, residual: int, bin_: int) -> None:
        self.bins[residual].append(bin_)
        node = residual + self.leaves
        while node:
            self.filled[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes a bin of the least residual that is at least so much."""
        node, filled = least + self.leaves, self.filled
        if not filled[node]:
            while node & 1 or not filled[node + 1]:  # up until a right sibling has a bin
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node = 2 * node if filled[2 * node] else 2 * node + 1
        residual = node - self.leaves
        while node:
            filled[node] -= 1
            node >>= 1
        return residual, self.bins[residual].pop()


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins as lists of items; items are at most size long."""
    tree, bins = Residuals(size), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[item]) if lengths[item] <= size else None
        residual, at = found or (size, len(bins))
        if not found:
            bins.append([])
        bins[at].append(item)
        tree.add(residual - lengths[item], at)
    return bins


def pieces(length: int, size: int) -> list[tuple[int, int]]:
    """Start and length of each piece of a document; one of length 0 for an empty one."""
    return [(at, min(size, length - at)) for at in range(0, length, size)] or [(0, 0)]


def tokenizer(ranks: dict[bytes, int], pattern: str):
    """A function from texts to lists of ids, by the tiktoken library."""
    import tiktoken

    made = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return made.encode_ordinary


#: A pattern whose matches never go on from a character to white space, so that tokens can be counted word by word.
BY_WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of the pattern beyond ASCII, in UTF-8, and beginnings by which a group without any is told.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WIDE_BEGINS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_BLANK, _END = 0x20, 0x0A


class Counts:
    """Numbers of tokens of laid-out texts, for which each different word is encoded about once.

    A word is a run of characters other than ASCII white space. Of the white space before it
    all but the last character are one match of BY_WORD; the last is a match of its own, or, if
    it is a blank, belongs to the word's first match. So a word's tokens follow from the word
    and from whether a blank is before it. Numbers are kept by a 64-bit hash of both in a table
    of fixed size, where a later word takes the slot of an earlier one: the hash's first bits
    are the slot, the others are kept above the number, which is never 0. A word is taken for
    another with a chance of 5.4e-20. Words of more than LONGEST bytes are encoded each
    time, as are whole texts with other white space at an end of a word.
    """

    SLOTS, LONGEST = 22, 256
    _SALT = np.uint64(0xA0761D6478BD642F)

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encode, self.by_word = tokenizer(ranks, pattern), pattern == BY_WORD
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes[list(ranks.values())] = [len(token) for token in ranks]
        self.rest, self.number = np.uint64(self.SLOTS), np.uint64((1 << self.SLOTS) - 1)  # a shift, a mask
        self.table = np.zeros(1 << self.SLOTS, np.uint64)
        self.gaps: dict[bytes, int] = {}

    def __call__(self, laid: shingles.Laid) -> np.ndarray:
        """The number of tokens of each text."""
        if not self.by_word:
            return np.array([self._whole(laid, i) for i in range(len(laid.begins))], np.int64)
        data, starts, ends, owner = laid.data, laid.starts, laid.ends, laid.owner
        n, first = len(laid.begins), np.ones(len(starts), bool)
        first[1:] = owner[1:] != owner[:-1]
        before = np.concatenate([[0], ends[:-1]])[: len(starts)]  # where the white space before a word begins
        before[first] = laid.begins[owner[first]]
        gap = starts - before
        blank = (gap > 0) & (np.frombuffer(data, np.uint8)[starts - 1] == _BLANK)
        found = np.bincount(owner, self._of_words(laid, blank) + ((gap > 0) & ~blank), n).astype(np.int64)
        for i in np.flatnonzero(gap > 1).tolist():
            found[owner[i]] += self._of_gap(data[before[i] : starts[i] - 1])
        last = laid.begins.copy()
        last[owner] = ends  # of a text's words the last one's
        stop = laid.begins + laid.lengths
        for i in np.flatnonzero(last < stop).tolist():
            found[i] += self._of_gap(data[last[i] : stop[i]])
        for i in self._odd(laid):
            found[i] = self._whole(laid, i)
        return found

    def _whole(self, laid: shingles.Laid, i: int) -> int:
        return len(self.encode(laid.data[laid.begins[i] : laid.begins[i] + laid.lengths[i]].decode()))

    def _of_gap(self, gap: bytes) -> int:
        if gap not in self.gaps:
            if len(self.gaps) == 1 << 12:
                self.gaps.clear()
            self.gaps[gap] = len(self.encode(gap.decode()))
        return self.gaps[gap]

    def _odd(self, laid: shingles.Laid) -> list[int]:
        """Texts with white space beyond ASCII at an end of a word."""
        data = laid.data
        if not any(x[:1] in data and x in data for x in _WIDE_BEGINS):
            return []
        edges = [m.start() for m in _WIDE.finditer(data) if not data[max(m.start() - 1, 0) : m.start()].strip() or not data[m.end() : m.end() + 1].strip()]
        return np.unique(np.searchsorted(laid.begins, edges, "right") - 1).tolist()

    def _of_words(self, laid: shingles.Laid, blank: np.ndarray) -> np.ndarray:
        """The number of tokens of each word, with the blank before it."""
        keys = laid.hashes ^ np.where(blank, self._SALT, np.uint64(0))
        slots = (keys >> np.uint64(64 - self.SLOTS)).view(np.int64)
        kept = self.table[slots] ^ (keys << self.rest)
        found = (kept & self.number).view(np.int64)
        missing = np.flatnonzero(kept - np.uint64(1) >= self.number)  # another word's, or none
        long = laid.ends[missing] - laid.starts[missing] > self.LONGEST
        for i in missing[long].tolist():
            found[i] = len(self.encode((" " if blank[i] else "") + laid.data[laid.starts[i] : laid.ends[i]].decode()))
        missing = missing[~long]
        if not len(missing):
            return found
        new, at, of = np.unique(keys[missing], return_index=True, return_inverse=True)
        at = missing[at]
        # all in a row, a blank or a line's end before each: where tokens end says whose they are
        sizes = laid.ends[at] - laid.starts[at] + 1
        stops = np.cumsum(sizes)
        row = np.frombuffer(laid.data, np.uint8)[np.arange(stops[-1]) + np.repeat(laid.starts[at] - 1 - (stops - sizes), sizes)]
        row[stops - sizes] = np.where(blank[at], _BLANK, _END)
        tokens = np.cumsum(self.bytes[self.encode(row.tobytes().decode())])
        number = np.maximum(np.diff(np.searchsorted(tokens, stops, "right"), prepend=0) - ~blank[at], 0)  # less than 1 only in odd texts
        found[missing] = number[of]
        slots = slots[at]
        stays = np.append(slots[1:] != slots[:-1], True)
        self.table[slots[stays]] = (new << self.rest | number.astype(np.uint64))[stays]
        return found


#: The counts that this worker keeps from task to task, by vocabulary.
_counts: dict[str, Counts] = {}


def _counts_of(name: str, sent) -> Counts:
    if name not in _counts:
        _counts.clear()
        _counts[name] = Counts(*sent.value)
    return _counts[name]


def pack(docs: DataFrame, ranks: dict[bytes, int], pattern: str, end_id: int, size: int = LENGTH) -> DataFrame:
    """Packed sequences of ids, each document closed by end_id.

    A row has pack_id, n_tokens, doc_ids and doc_starts (the piece's first token in its
    document) by segment, cu_seqlens (0, then where each segment ends), ids (size ids of
    16 bits, little-endian, filled up with end_id) and positions (as many, that begin at
    0 in every segment and in the filling). A vocabulary or a size that does not fit into
    16 bits raises ValueError before anything is read.
    """
    if max(end_id, *ranks.values()) > 0xFFFF or not 0 < size <= 0x10000:
        raise ValueError("ids and positions must fit into 16 bits")
    schema = pa.schema(
        [
            ("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
            ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("positions", pa.binary()),
        ]
    )
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pattern))  # of the vocabulary's fixed size

    def run(batches):
        encode = tokenizer(*sent.value)
        part, made = TaskContext.get().partitionId(), 0

        def packed(block):
            nonlocal made
            items = [(doc, start, tokens[start : start + n]) for doc, tokens in block for start, n in pieces(len(tokens), size)]
            bins = best_fit([len(t) for _, _, t in items], size)
            for at in range(0, len(bins), 256):
                rows = {f.name: [] for f in schema}
                for chosen in bins[at : at + 256]:
                    lengths = [len(items[i][2]) for i in chosen]
                    total = sum(lengths)
                    ids = np.full(size, end_id, "<u2")
                    ids[:total] = np.concatenate([items[i][2] for i in chosen])
                    positions = np.concatenate([*(np.arange(n, dtype="<u2") for n in lengths), np.arange(size - total, dtype="<u2")])
                    values = (part << 33 | made, total, [items[i][0] for i in chosen], [items[i][1] for i in chosen], np.concatenate([[0], np.cumsum(lengths)]), ids.tobytes(), positions.tobytes())
                    made += 1
                    for name, value in zip(rows, values, strict=True):
                        rows[name].append(value)
                yield base.batch_of(rows, schema)

        block, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block.append((doc, np.array([*encode(text), end_id], np.uint16)))
                held += len(block[-1][1])
                if held >= BLOCK_TOKENS or len(block) == BLOCK_ROWS:
                    yield from packed(block)
                    block, held = [], 0
        if block:
            yield from packed(block)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.text_or_empty().alias("text"))
    return base.arrow_map(
        rows, run, "pack_id long, n_tokens int, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, ids binary, positions binary"
    )


def matrices(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and positions of packed rows as matrices and one cumulative list of all segment lengths."""
    ids = np.stack([np.frombuffer(r["ids"], "<u2") for r in rows])
    positions = np.stack([np.frombuffer(r["positions"], "<u2") for r in rows])
    ends = [0]
    for i, r in enumerate(rows):
        ends += [i * ids.shape[1] + e for e in r["cu_seqlens"][1:]]
    return ids, positions, np.array(ends, np.int64)


#: A matrix is a row of 2 MB, so a page is closed after each and a row group after eight, not at the first check of Parquet's writer after 100
#: rows: what a task's writer holds, and a reader of whole row groups, doesn't grow with the task.
_FEW_ROWS = {
    "parquet.block.row.count.limit": "8", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
    "parquet.enable.dictionary#ids": "false", "parquet.enable.dictionary#positions": "false",
}
_MATRIX = "matrix_id long, n_rows int, size int, ids binary, positions binary, cu_seqlens array<int>, rows array<int>, doc_ids array<long>, doc_starts array<long>, pack_ids array<long>"


def write_matrices(packed: DataFrame, size: int = LENGTH, rows: int = MATRIX_ROWS) -> DataFrame:
    """Writes packed sequences as id matrices to a table in the shared folder, and reads the table back.

    A row is a matrix of up to so many sequences: ids and positions (n_rows x size values of
    16 bits, little-endian, row by row), cu_seqlens (0, then where each segment of the matrix
    laid out in one row ends; the filling of a sequence is no segment), and for each segment
    the number of its row, its doc_id and its first token; pack_ids names the rows.
    """
    schema = pa.schema(
        [
            ("matrix_id", pa.int64()), ("n_rows", pa.int32()), ("size", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
            ("rows", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("pack_ids", pa.list_(pa.int64())),
        ]
    )

    def run(batches):
        part, made, held = TaskContext.get().partitionId(), 0, []
        for batch in itertools.chain(batches, [None]):
            held += batch.to_pylist() if batch is not None else []
            while len(held) >= rows or batch is None and held:
                chosen, held = held[:rows], held[rows:]
                ids, positions, ends = matrices(chosen)
                each = [(i, d, s) for i, r in enumerate(chosen) for d, s in zip(r["doc_ids"], r["doc_starts"], strict=True)]
                of, docs, starts = zip(*each, strict=True)
                values = (part << 33 | made, len(chosen), size, ids.tobytes(), positions.tobytes(), ends, of, docs, starts, [r["pack_id"] for r in chosen])
                yield base.batch_of({n: [v] for n, v in zip(schema.names, values, strict=True)}, schema)
                made += 1

    rows_ = packed.select("pack_id", "doc_ids", "doc_starts", "cu_seqlens", "ids", "positions")
    return base.materialise(base.arrow_map(rows_, run, _MATRIX), "matrices", compression="zstd", **_FEW_ROWS)


def read_matrices(stored: DataFrame) -> DataFrame:
    """The sequences of stored matrices, as ``pack`` makes them; a matrix that does not hold what it says raises ValueError."""
    schema = pa.schema(
        [
            ("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
            ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("positions", pa.binary()),
        ]
    )

    def run(batches):
        for batch in batches:
            for m in batch.to_pylist():
                size, wide, n = m["size"], 2 * m["size"], m["n_rows"]
                ends, of = np.array(m["cu_seqlens"]), np.array(m["rows"])
                positions = np.frombuffer(m["positions"], "<u2")
                if len(m["ids"]) != n * wide or len(positions) != n * size or len(of) != len(ends) - 1 or (np.diff(ends) <= 0).any() or ends[-1] > n * size:
                    raise ValueError("a matrix is not as large as it says")
                bounds = np.searchsorted(of, np.arange(n + 1))
                out = {f.name: [] for f in schema}
                for i in range(n):
                    own = slice(bounds[i], bounds[i + 1])
                    cu = np.concatenate([[0], ends[1:][own] - i * size])
                    starts = np.append(cu[:-1], cu[-1]) if cu[-1] < size else cu[:-1]
                    if positions[i * size + starts].any():
                        raise ValueError("positions do not begin anew at a segment")
                    values = (m["pack_ids"][i], cu[-1], m["doc_ids"][own], m["doc_starts"][own], cu, m["ids"][i * wide : (i + 1) * wide], m["positions"][i * wide : (i + 1) * wide])
                    for name, value in zip(out, values, strict=True):
                        out[name].append(value)
                yield base.batch_of(out, schema)

    return base.arrow_map(stored, run, "pack_id long, n_tokens int, doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, ids binary, positions binary")


class OrderedBins:
    """Bins in the order of their residual capacities.

    Sets of bins are bitmaps, one bit a bin: those of each residual, and those that hold
    each source and each cluster; a bitmap over residuals says which have bins at all.
    """

    def __init__(self, size: int):
        self.at = [0] * (size + 1)
        self.open = 0
        self.residual: list[int] = []
        self.holding: dict[tuple, int] = {}

    def tightest(self, length: int, keys: list[tuple]) -> int | None:
        """The bin of the least residual that suffices and holds none of the keys; of equal ones the first made."""
        against = 0
        for key in keys:
            against |= self.holding.get(key, 0)
        rest = self.open >> length
        residual = length
        while rest:  # successor after successor
            step = (rest & -rest).bit_length() - 1
            residual += step
            fits = self.at[residual] & ~against
            if fits:
                return (fits & -fits).bit_length() - 1
            rest >>= step + 1
            residual += 1
        return None

    def put(self, bin_: int | None, length: int, keys: list[tuple]) -> int:
        """Takes length from a bin, a new one where bin_ is None, and notes the keys there."""
        if bin_ is None:
            bin_ = len(self.residual)
            self.residual.append(len(self.at) - 1)
        else:
            self._move(bin_)
        self.residual[bin_] -= length
        self._move(bin_)
        for key in keys:
            self.holding[key] = self.holding.get(key, 0) | 1 << bin_
        return bin_

    def _move(self, bin_: int) -> None:
        residual = self.residual[bin_]
        self.at[residual] ^= 1 << bin_
        bit = 1 << residual
        self.open = self.open | bit if self.at[residual] else self.open & ~bit


def best_fit_apart(items: list[tuple], size: int) -> list[list[int]]:
    """Bins as lists of numbers of items (length, source, cluster), no bin with two of a source or of a cluster."""
    ordered, bins = OrderedBins(size), []
    for item in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
        length = items[item][0]
        keys = [(kind, items[item][kind]) for kind in (1, 2) if items[item][kind] is not None]
        chosen = ordered.put(ordered.tightest(length, keys), length, keys)
        if chosen == len(bins):
            bins.append([])
        bins[chosen].append(item)
    return bins


def counted(docs: DataFrame, ranks: dict[bytes, int], pattern: str, source: str = "source", cluster=None, end_id: int | None = None) -> DataFrame:
    """doc_id, length in tokens with an end mark, source, cluster and the key of the text of each row; with end_id also the ids, of 32 bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("length", pa.int64()), ("source", pa.string()), ("cluster", pa.int64()), ("text_key", pa.binary()), ("ids", pa.binary())])
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches):
        encode = tokenizer(*sent.value)
        for batch in batches:
            found = [encode(text) for text in batch.column(1).to_pylist()]
            ids = [None if end_id is None else np.array([*x, end_id], "<i4").tobytes() for x in found]
            own = {"length": [len(x) + 1 for x in found], "ids": ids}
            yield base.batch_of(own | {n: batch.column(n) for n in schema.names if n not in own}, schema)

    text = base.text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _source(docs, source),
        (F.xxhash64(text) if cluster is None else cluster.cast("long")).alias("cluster"), F.unhex(F.md5(text)).alias("text_key"),
    )
    made = base.arrow_map(rows, run, "doc_id long, length long, source string, cluster long, text_key binary, ids binary")
    return made.drop("ids") if end_id is None else made


def _source(docs: DataFrame, source: str):
    """The column of sources; in a table without it no document has one."""
    found = F.col(source) if source in docs.columns else F.lit(None)
    return found.cast("string").alias("source")


def apart(rows: DataFrame, size: int = LENGTH) -> DataFrame:
    """Bins of the pieces of rows (doc_id, length, source, cluster) that share neither a source nor a cluster.

    A row has bin_id, used, capacity, and by piece doc_ids, doc_starts, lengths (in tokens,
    an end mark included), sources and clusters; where rows have ids, also the ids of all
    pieces, of 32 bits, little-endian.
    """
    with_ids = "ids" in rows.columns
    schema = pa.schema(
        [
            ("bin_id", pa.int64()), ("used", pa.int32()), ("capacity", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int32())), ("sources", pa.list_(pa.string())), ("clusters", pa.list_(pa.int64())), *([("ids", pa.binary())] if with_ids else []),
        ]
    )

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0

        def packed(block):
            nonlocal made
            items = [(n, s, c, doc, start, ids) for doc, length, s, c, ids in block for start, n in pieces(length, size)]
            bins = best_fit_apart([i[:3] for i in items], size)
            for at in range(0, len(bins), 1024):
                rows = {f.name: [] for f in schema}
                for chosen in bins[at : at + 1024]:
                    own = [items[i] for i in chosen]
                    values = [part << 33 | made, sum(i[0] for i in own), size, [i[3] for i in own], [i[4] for i in own], [i[0] for i in own], [i[1] for i in own], [i[2] for i in own]]
                    values += [b"".join(i[5][4 * i[4] : 4 * (i[4] + i[0])] for i in own)] if with_ids else []
                    made += 1
                    for name, value in zip(rows, values, strict=True):
                        rows[name].append(value)
                yield base.batch_of(rows, schema)

        block, held = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.append(row)
                held += row[1]
                if held >= BLOCK_TOKENS or len(block) == BLOCK_ROWS:
                    yield from packed(block)
                    block, held = [], 0
        if block:
            yield from packed(block)

    ids = F.col("ids") if with_ids else F.lit(None).cast("binary").alias("ids")
    return base.arrow_map(
        rows.select("doc_id", "length", "source", "cluster", ids), run,
        "bin_id long, used int, capacity int, doc_ids array<long>, doc_starts array<long>, lengths array<int>, sources array<string>, clusters array<long>" + (", ids binary" if with_ids else ""),
    )


def pack_apart(docs: DataFrame, ranks: dict[bytes, int], pattern: str, size: int = LENGTH, source: str = "source", cluster=None, end_id: int | None = None) -> DataFrame:
    """Bins of documents' pieces as in ``apart``; cluster is a column of docs (default: the hash of the text, so that exact copies are apart).

    With end_id the bins hold the ids too, each document closed by end_id.
    """
    return apart(counted(docs, ranks, pattern, source, cluster, end_id), size)


def pack_classes_apart(docs: DataFrame, ranks: dict[bytes, int], pattern: str, size: int = LENGTH, source: str = "source") -> DataFrame:
    """Bins as in ``apart`` with a document's near-duplicate class as its cluster.

    Tokens are counted in the pass that sketches the texts. No texts are shuffled; rows are
    dealt anew after the join with their classes, so that a class is spread over blocks.
    """
    sent = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def measure():
        counts = _counts_of(name, sent)
        return lambda laid: counts(laid) + 1

    rows = neardup.measured_classes(docs, measure, source if source in docs.columns else None)
    rows = rows.select("doc_id", "at", F.col("measure").alias("length"), F.col("carry").alias("source"), F.col("class_id").alias("cluster"))
    return apart(rows.repartition(F.xxhash64("at")), size)
