"""Line dedup that can be reversed: sharded cuckoo filters over exact reference counts.

A state says which lines are repeated. It has three tables in the shared folder:

* references: a row for each document and each distinct line key in it, with the places of
  those lines: exact, so that every insertion can be taken back;
* counts: for each key how many documents refer to it and which is the last of them;
* filters: for each shard, a range of key hashes, a cuckoo filter of its repeated keys.

Inserting documents adds references and counts; keys that come to ``least`` documents are
put into their shard's filter. Deleting documents takes the references away again; where the
last document of a key went, the last of the others is looked up, and keys that fall below
``least`` are removed from the filter. A key is put in and removed once each time it crosses
that line, as the counts are exact, so a removal can't hit the mark of another key. A filter
that overflows is built again with twice the buckets from its shard's counts.

To dedup, every reference asks the filter of its shard; those that pass, the repeated ones
and a few others, are checked against the counts. Keys that very many documents share are
decided before that: of N references at most 65,536 keys can have more than N / 65,536 of
them, so their list is bounded at any size and is broadcast. No shard has much more than
SHARD references, however hot a line is. Texts are shuffled once, to meet their places.

A line's key is the line without ASCII white space at both ends and with ASCII letters in
lower case. Keys shorter than ``MIN_CHARS`` code points are never repeated. Keys are compared
by 128 bits. A document is a doc_id: rows that share one are one document, rows without one
are a document for each text; they come before all others. Documents that are inserted
already are left as they are; documents that aren't in the state lose no lines. A null text
is one empty line. An empty table gives an empty state; other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailhead.llm import base
from trailhead.llm.shingles import mix

MIN_CHARS, MIN_DOCS = 20, 3
#: References of a shard, about; shards are doubled in number beyond four times as many.
SHARD = 1 << 16
#: Steps after which the tables of a state are written anew.
COMPACT = 8
_BLANK = b" \t\n\x0b\x0c\r"
_SLOTS, _LOAD, _ROUNDS = 4, 0.8, 200
_REFERENCE = "doc_id long, text_key long, k1 long, k2 long, at array<int>"
_COUNT = "k1 long, k2 long, n long, last_id long, last_text long, was long"
_FILTER = "shard long, cells binary"
_WHO = ["doc_id", "anon"]


def key_of(line: bytes) -> bytes:
    return line.strip(_BLANK).lower()


def _long_enough(key: bytes) -> bool:
    return len(key) >= MIN_CHARS and (key.isascii() or len(key.decode("utf-8", "replace")) >= MIN_CHARS)


class Cuckoo:
    """A set of keys (pairs of longs) as 16-bit marks, four in a bucket; 0 is a free place."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.mask = cells, np.uint64(len(cells) - 1)

    @classmethod
    def of_size(cls, n: int) -> Cuckoo:
        return cls(np.zeros((1 << max(3, math.ceil(math.log2(max(n, 1) / _LOAD / _SLOTS))), _SLOTS), np.uint16))

    def _away(self, mark: np.ndarray) -> np.ndarray:
        return mix(mark.astype(np.uint64)) & self.mask

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mark, bucket and other bucket of each key."""
        mark = (k2.view(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = mix(k1.view(np.uint64)) & self.mask
        return mark, first, first ^ self._away(mark)

    def has(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, first, other = self._places(k1, k2)
        return (self.cells[first] == mark[:, None]).any(1) | (self.cells[other] == mark[:, None]).any(1)

    def _turns(self, bucket: np.ndarray) -> np.ndarray:
        """How many earlier items have the same bucket."""
        order = np.argsort(bucket, kind="stable")
        new = np.concatenate(([True], bucket[order][1:] != bucket[order][:-1]))
        out = np.empty(len(bucket), np.int64)
        out[order] = np.arange(len(bucket)) - np.maximum.accumulate(np.where(new, np.arange(len(bucket)), 0))
        return out

    def _settle(self, bucket: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Overwrites, for each item, a place in its bucket that holds old with new; says for which there was one."""
        turn = self._turns(bucket)
        fits = np.zeros(len(bucket), bool)
        for k in range(_SLOTS):  # items of one bucket after each other
            at = np.flatnonzero(turn == k)
            free = self.cells[bucket[at]] == old[at, None]
            at, free = at[free.any(1)], free[free.any(1)]
            self.cells[bucket[at], free.argmax(1)] = new[at]
            fits[at] = True
        return fits

    def add(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Whether all keys found a place; where not, nothing is changed."""
        before = self.cells.copy()
        mark, bucket, _ = self._places(k1, k2)
        for step in range(_ROUNDS):
            for _ in range(2):
                placed = self._settle(bucket, np.zeros_like(mark), mark)
                mark, bucket = mark[~placed], bucket[~placed]
                bucket = bucket ^ self._away(mark)
            if not len(mark):
                return True
            at = np.flatnonzero(self._turns(bucket) == 0)  # one of each bucket takes a place of another, which moves on
            slot = step % _SLOTS
            out = self.cells[bucket[at], slot].copy()
            self.cells[bucket[at], slot] = mark[at]
            mark[at] = out
            bucket[at] ^= self._away(out)
        self.cells = before
        return False

    def remove(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Keys that were added go; equal marks of a bucket stand for each other."""
        mark, first, other = self._places(k1, k2)
        while len(mark):
            gone = self._settle(first, mark, np.zeros_like(mark))
            mark, first, other = mark[~gone], first[~gone], other[~gone]
            gone = self._settle(other, mark, np.zeros_like(mark))
            if not gone.any() and len(mark):
                raise ValueError("a key that is not in the filter can't be removed")
            mark, first, other = mark[~gone], first[~gone], other[~gone]


@dataclass(frozen=True)
class State:
    """The tables; least is the number of documents from which a key is repeated, shards a power of two."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    total: int
    shards: int
    least: int
    steps: int


def empty(spark: SparkSession, least: int = MIN_DOCS) -> State:
    tables = (spark.createDataFrame([], T._parse_datatype_string(s)) for s in (_REFERENCE, _COUNT, _FILTER))
    return State(*tables, total=0, shards=64, least=least, steps=0)


def references(docs: DataFrame) -> DataFrame:
    """A row for each row of docs and each distinct key in it, with the numbers of the lines that have it."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            row, digests, at, sizes = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found: dict[bytes, list[int]] = {}
                for j, line in enumerate(text.split(b"\n")):
                    key = key_of(line)
                    if _long_enough(key):
                        found.setdefault(key, []).append(j)
                for key, places in found.items():
                    row.append(i)
                    digests.append(hashlib.md5(key, usedforsecurity=False).digest())
                    at += places
                    sizes.append(len(places))
            if row:
                k = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                taken = pa.array(row)
                yield base.batch_of(
                    {"doc_id": batch.column(0).take(taken), "text_key": batch.column(1).take(taken), "k1": k[:, 0].copy(), "k2": k[:, 1].copy(), "at": base.lists_of(np.array(at, np.int32), np.array(sizes), len(sizes))}, schema
                )

    return base.arrow_map(_identified(docs).select("doc_id", "text_key", F.col("text").cast("binary").alias("text")), run, _REFERENCE)


def _identified(docs: DataFrame) -> DataFrame:
    text = base.text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _anon(df: DataFrame) -> DataFrame:
    return df.withColumn("anon", F.when(F.col("doc_id").isNull(), F.col("text_key")))


def _same_document(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & a["anon"].eqNullSafe(b["anon"])


def _counted(refs: DataFrame) -> DataFrame:
    """Documents and last document of each key; a key of very many documents is combined before it is shuffled."""
    each = _anon(refs).groupBy("k1", "k2", *_WHO).agg(F.lit(1).alias("one"))
    return each.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id"), F.max("anon").alias("last_text"))


def _shard(shards: int):
    return F.shiftrightunsigned("k1", 64 - int(math.log2(shards))).alias("shard")


def _log2(n: float) -> int:
    return max(0, math.ceil(math.log2(max(n, 1))))


def _built(counts: DataFrame, shards: int, least: int, only: DataFrame | None = None, spare: int = 1) -> DataFrame:
    """Filters of the repeated keys of all shards, or of some."""
    schema = pa.schema([("shard", pa.int64()), ("cells", pa.binary())])

    def run(table):
        k1, k2 = (table.column(c).to_numpy() for c in ("k1", "k2"))
        size = len(k1) * spare
        while not (made := Cuckoo.of_size(size)).add(k1, k2):
            size *= 2
        return pa.table({"shard": table.column("shard")[:1], "cells": pa.array([made.cells.tobytes()], pa.binary())}, schema=schema)

    rows = counts.where(F.col("n") >= least).select("k1", "k2", _shard(shards))
    if only is not None:
        rows = rows.join(only, "shard", "left_semi")
    return rows.groupBy("shard").applyInArrow(run, _FILTER)


def _updated(filters: DataFrame, counts: DataFrame, shards: int, least: int) -> DataFrame:
    """Filters after the keys that have crossed the line were put in or removed."""
    schema = pa.schema([("shard", pa.int64()), ("cells", pa.binary())])

    def run(old, crossed):
        if not len(crossed):
            return old.select(["shard", "cells"]).cast(schema)
        k1, k2, up = (crossed.column(c).to_numpy() for c in ("k1", "k2", "up"))
        cells = old.column("cells")[0].as_py() if len(old) else None
        held = Cuckoo(np.frombuffer(cells, np.uint16).reshape(-1, _SLOTS).copy()) if cells else Cuckoo.of_size(2 * len(k1))
        held.remove(k1[~up], k2[~up])
        fits = held.add(k1[up], k2[up])
        return pa.table({"shard": crossed.column("shard")[:1], "cells": pa.array([held.cells.tobytes() if fits else None], pa.binary())}, schema=schema)

    crossed = counts.where((F.col("n") >= least) != (F.col("was") >= least)).select("k1", "k2", (F.col("n") >= least).alias("up"), _shard(shards))
    made = base.materialise(filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(run, _FILTER), "filters")
    full = made.where("cells IS NULL").select("shard")
    if full.isEmpty():
        return made
    return base.materialise(made.where("cells IS NOT NULL").unionByName(_built(counts, shards, least, full, 2)), "filters")


def _next(state: State, refs: DataFrame, counts: DataFrame, total: int) -> State:
    """The state with new tables; the filters follow the counts."""
    shards = state.shards
    if total > 4 * SHARD * shards or not state.total:
        shards = max(shards, 1 << _log2(total / SHARD))
    same = shards == state.shards
    filters = _updated(state.filters, counts, shards, state.least) if same else base.materialise(_built(counts, shards, state.least), "filters")
    steps = state.steps + 1
    if steps % COMPACT == 0:
        refs = base.materialise(refs, "references")
    return State(refs, counts.where("n > 0"), filters, total, shards, state.least, steps)


def insert(state: State, docs: DataFrame) -> State:
    """The state with the documents that it doesn't have yet."""
    refs = references(docs)
    if state.total:
        known = _anon(state.references).select(*_WHO).distinct()
        refs = _anon(refs)
        refs = refs.join(known, _same_document(refs, known), "left_anti").drop("anon")
    refs = base.materialise(refs, "references")
    added = _counted(refs)
    if not state.total:
        counts = added.withColumn("was", F.lit(0).cast("long"))
    else:
        old = state.counts.select("k1", "k2", "n", "last_id", "last_text", F.col("n").alias("was"))
        both = old.unionByName(added.withColumn("was", F.lit(0).cast("long")))
        counts = both.groupBy("k1", "k2").agg(*(F.sum(c).alias(c) if c in ("n", "was") else F.max(c).alias(c) for c in ("n", "last_id", "last_text", "was")))
    counts = base.materialise(counts, "counts")
    return _next(state, state.references.unionByName(refs), counts, state.total + refs.count())


def delete(state: State, docs: DataFrame) -> State:
    """The state without these documents, as if they had never been inserted."""
    gone = base.materialise(_anon(_identified(docs)).select(*_WHO).distinct(), "deleted")
    all_ = _anon(state.references)
    taken = base.materialise(all_.join(gone, _same_document(all_, gone), "left_semi").drop("anon"), "deleted")
    refs = all_.join(gone, _same_document(all_, gone), "left_anti").drop("anon")
    less = _counted(taken).select("k1", "k2", F.col("n").alias("fewer"), F.col("last_id").alias("top_id"), F.col("last_text").alias("top_text"))
    counts = state.counts.drop("was").join(less, ["k1", "k2"], "left").withColumn("was", F.col("n")).withColumn("n", F.col("n") - F.coalesce("fewer", F.lit(0)))
    lost = F.col("fewer").isNotNull() & (F.col("top_id").eqNullSafe(F.col("last_id")))
    counts = base.materialise(counts.select("k1", "k2", "n", "last_id", "last_text", "was", lost.alias("lost")), "counts")
    again = _counted(refs.join(counts.where("lost AND n > 0").select("k1", "k2"), ["k1", "k2"], "left_semi")).select("k1", "k2", F.col("last_id").alias("new_id"), F.col("last_text").alias("new_text"))
    counts = counts.join(again, ["k1", "k2"], "left")
    pick = lambda new, old: F.when(F.col("lost"), F.col(new)).otherwise(F.col(old)).alias(old)
    counts = base.materialise(counts.select("k1", "k2", "n", pick("new_id", "last_id"), pick("new_text", "last_text"), "was"), "counts")
    return _next(state, refs, counts, state.total - taken.count())


def dropped(state: State) -> DataFrame:
    """doc_id, text_key and the numbers of the lines that go, of each row of the state that loses lines."""
    share = max(base.SHARE, state.total >> 16)
    repeated = state.counts.where(F.col("n") >= state.least).select("k1", "k2", "n", "last_id", "last_text")
    many = repeated.where(F.col("n") > share).drop("n").withColumn("many", F.lit(True))
    tagged = state.references.join(F.broadcast(many), ["k1", "k2"], "left")
    last = F.coalesce(F.col("doc_id") == F.col("last_id"), F.col("doc_id").isNull() & F.col("last_id").isNull() & F.col("text_key").eqNullSafe(F.col("last_text")))
    columns = ["doc_id", "text_key", "k1", "k2", "at"]
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.list_(pa.int32()))])

    def ask(filter_, asking):
        out = asking.select(columns)
        if not len(filter_) or not len(asking):
            return out.slice(0, 0).cast(schema)
        held = Cuckoo(np.frombuffer(filter_.column("cells")[0].as_py(), np.uint16).reshape(-1, _SLOTS))
        return out.filter(pa.array(held.has(out.column("k1").to_numpy(), out.column("k2").to_numpy()))).cast(schema)

    few = tagged.where("many IS NULL").select(*columns, _shard(state.shards))
    passed = state.filters.groupBy("shard").cogroup(few.groupBy("shard")).applyInArrow(ask, _REFERENCE)
    sure = passed.join(repeated.where(F.col("n") <= share).drop("n"), ["k1", "k2"])
    out = tagged.where("many").where(~last).select("doc_id", "text_key", "at").unionByName(sure.where(~last).select("doc_id", "text_key", "at"))
    return out.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("at")).alias("lines"))


def deduped(docs: DataFrame, state: State) -> DataFrame:
    """docs with the text without the lines that go, and two more columns: n_lines before, n_dropped."""
    n_lines, n_dropped, goes, key = (base.fresh(docs, n) for n in ("n_lines", "n_dropped", "goes", "text_key"))
    drops = dropped(state).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("lines").alias(goes))
    rows = docs.withColumn(key, F.xxhash64(base.text_or_empty()))
    rows = rows.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.col(key) == F.col("_key")), "left")
    rows = rows.select(*(base.text_or_empty().alias("text") if c == "text" else F.col(c) for c in docs.columns), goes)
    fields = [T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts, total, fewer = batch.column(at).to_pylist(), [], []
            for i, (text, numbers) in enumerate(zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                total.append(text.count("\n") + 1)
                if numbers:
                    go = set(numbers)
                    texts[i] = "\n".join([line for j, line in enumerate(text.split("\n")) if j not in go])
                fewer.append(len(numbers or ()))
            columns = [*batch.columns[:-1], pa.array(total, pa.int64()), pa.array(fewer, pa.int64())]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return base.arrow_map(rows, run, schema)


def digests(rows: DataFrame) -> DataFrame:
    """The columns of the query, from rows that deduped() made of documents with their own columns only."""
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
