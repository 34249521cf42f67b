"""Suffix-array dedup: passages of MIN_WORDS words or more that stand in several documents.

A sparse suffix array holds the suffixes that begin at minimisers: the least hash of
KEY-word runs in each window of MIN_WORDS words. The choice depends on content alone, so
two occurrences of a passage of MIN_WORDS words keep the same suffix of it. Then

1. suffixes are sorted by their first KEY words and compared with their neighbours: a
   suffix stays if another document has one that begins alike;
2. each that stays is extended to the left and to the right, to all runs of MIN_WORDS
   words whose minimiser it is; runs are compared by 128 bits made from all their words
   (at 10^13 runs two different ones are alike with a chance of 1.5e-13);
3. runs that also stand in a document of smaller doc_id are merged into spans, which so
   reach as far left and right as the documents agree.

With ``within`` a passage that comes again in its own document is a repeat too, from the
first word after its first occurrence.

Every run of MIN_WORDS words has one minimiser, so no repeat is missed, and overlapping
runs make up passages of any length. The sort spreads a key that many documents have over
ranges; runs are compared by an aggregation that combines before it shuffles and a join
that Spark may split, so a passage that a third of all documents share does not weigh on
one task. Equal texts are compared once.

A word is a run of characters other than ASCII white space. Offsets are code points. Null
texts count as empty; texts of fewer words than MIN_WORDS have no spans. Rows with equal
doc_id are one document, repeats between them are not looked for, and each has its own spans; a row without doc_id has
no spans. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.llm import base, shingles

MIN_WORDS = 50
KEY = 16


def minimisers(hashes: np.ndarray, words: int = MIN_WORDS, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all key-word runs, and for each run of so many words the position of its least."""
    grams = shingles.runs(hashes, key)
    width = words - key + 1
    if len(grams) < width:
        return grams, np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    return grams, view.argmin(1) + np.arange(len(view))


def offsets(data: bytes, at: np.ndarray) -> np.ndarray:
    """Code points before each byte offset."""
    if data.isascii():
        return at
    begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    return np.concatenate([[0], np.cumsum(begins)])[at]


def _suffixes(docs: DataFrame) -> DataFrame:
    """For each document the key of its text, the extent of its words, and its suffixes' keys and positions."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_words", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("keys", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))]
    )

    def run(batches):
        for batch in batches:
            rows = {f.name: [] for f in schema}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "replace")
                starts, ends, hashes = shingles.words(data)
                grams, least = minimisers(hashes)
                if not len(least):
                    continue
                places = np.unique(least)
                low, high = offsets(data, np.array([starts[0], ends[-1]]))
                values = (doc, hashlib.md5(data, usedforsecurity=False).digest(), len(hashes), low, high, grams[places].view(np.int64), places.astype(np.int32))
                for name, value in zip(rows, values, strict=True):
                    rows[name].append(value)
            yield base.batch_of(rows, schema)

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), base.text_or_empty().alias("text"))
    return base.arrow_map(rows, run, "doc_id long, text_key binary, n_words long, low long, high long, keys array<long>, places array<int>")


def _neighbours(suffixes: DataFrame, within: bool) -> DataFrame:
    """(doc_id, text, place) of suffixes (doc_id, text, key, place) that begin like one of another document, or with within like any other.

    Suffixes are sorted into ranges and each is compared with its neighbours. The first and
    the last key of a range may go on in the next one and stay unseen; that only costs the
    extension of a few more, and a key that many documents have is spread over ranges.
    """
    parts = int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("key", "doc_id", "text", "place")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.int64()), ("place", pa.int32())])

    def run(batches):
        held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32))  # the last key so far, while it has one document
        stays, first = None, True  # the key that is known to stay
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, text, place = (np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held))
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            shared = ends - starts > 1 if within else doc[starts] != doc[ends - 1]
            shared[0] |= first or (stays is not None and key[0] == stays)
            first, open_ = False, len(key)
            stays = key[-1] if shared[-1] else None
            if stays is None:
                open_ = starts[-1]
            held = key[open_:], doc[open_:], text[open_:], place[open_:]
            out = np.repeat(shared, ends - starts)[:open_]
            yield base.batch_of({"doc_id": doc[:open_][out], "text": text[:open_][out], "place": place[:open_][out]}, schema)
        if len(held[0]):
            yield base.batch_of({"doc_id": held[1], "text": held[2], "place": held[3]}, schema)

    ranged = suffixes.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return base.arrow_map(ranged, run, "doc_id long, text long, place int")


def _extended(texts: DataFrame) -> DataFrame:
    """Hashes and extents of the runs of words around the suffixes that stay."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.int64()), ("runs", pa.list_(pa.int64())), ("checks", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("lows", pa.list_(pa.int32())), ("highs", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            rows = {f.name: [] for f in schema}
            for doc, name, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode("utf-8", "replace")
                starts, ends, hashes = shingles.words(data)
                _, least = minimisers(hashes)
                at = np.flatnonzero(np.isin(least, np.array(places)))
                runs, checks = (shingles.runs(h, MIN_WORDS, f)[at].view(np.int64) for h, f in ((hashes, shingles.FACTORS[0]), (shingles.words(data, shingles.FACTORS[1])[2], shingles.FACTORS[1])))
                values = (doc, name, runs, checks, at.astype(np.int32), offsets(data, starts[at]).astype(np.int32), offsets(data, ends[at + MIN_WORDS - 1]).astype(np.int32))
                for column, value in zip(rows, values, strict=True):
                    rows[column].append(value)
            yield base.batch_of(rows, schema)

    return base.arrow_map(texts, run, "doc_id long, text long, runs array<long>, checks array<long>, at array<int>, lows array<int>, highs array<int>")


def _merged(rows: DataFrame) -> DataFrame:
    """Spans (start, end, first_doc_id) of each document from its repeated runs, overlapping ones joined."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("first_doc_id", pa.int64())])

    def run(batches):
        for batch in batches:
            out = []
            for doc, name, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans: list[list[int]] = []
                for r in sorted(runs, key=lambda r: (r["low"], r["high"])):
                    if spans and r["low"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["high"])
                        spans[-1][2] = min(spans[-1][2], r["first"])
                    else:
                        spans.append([r["low"], r["high"], r["first"]])
                out += [(doc, name, *s) for s in spans]
            columns = zip(*out, strict=True) if out else ([], [], [], [], [])
            yield base.batch_of(dict(zip(schema.names, columns, strict=True)), schema)

    return base.arrow_map(rows, run, "doc_id long, text long, start long, end long, first_doc_id long")


def repeats(docs: DataFrame, within: bool = False) -> DataFrame:
    """doc_id, start and end of each passage that a document of smaller doc_id has too, and the least such doc_id.

    With within also of passages that stand in the document itself before, with its own doc_id.
    """
    return _spans(docs, within).drop("text")


def _name(text_key):
    """What a text of a document is known by; rows that share a doc_id may have several."""
    return F.xxhash64(text_key).alias("text")


def _spans(docs: DataFrame, within: bool = False) -> DataFrame:
    """repeats() with the name of the text that each span is in."""
    made = base.materialise(_suffixes(docs), "suffixes")
    texts = made.groupBy("text_key").agg(
        F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("places").alias("places"), F.count("*").alias("n")
    )
    texts = base.materialise(texts, "texts")
    copies = made.join(texts.where("n > 1").select("text_key", F.col("doc_id").alias("first_doc_id")), "text_key").where("doc_id <> first_doc_id")
    copies = copies.select("doc_id", _name("text_key"), F.col("low").alias("start"), F.col("high").alias("end"), "first_doc_id").distinct()

    zipped = texts.select("doc_id", _name("text_key"), F.explode(F.arrays_zip("keys", "places")).alias("s"))
    suffixes = zipped.select("doc_id", "text", F.col("s.keys").alias("key"), F.col("s.places").alias("place"))
    places = _neighbours(suffixes, within).groupBy("doc_id", "text").agg(F.collect_set("place").alias("places"))
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), base.text_or_empty().alias("whole"))
    rows = rows.join(places, "doc_id").where(_name(F.unhex(F.md5("whole"))) == F.col("text"))
    runs = base.materialise(_extended(rows.select("doc_id", "text", "whole", "places")), "runs")

    each = runs.select("doc_id", "text", F.explode(F.arrays_zip("runs", "checks", "at", "lows", "highs")).alias("r"))
    each = each.select("doc_id", "text", F.struct("r.runs", "r.checks").alias("run"), F.col("r.at").alias("at"), F.col("r.lows").alias("low"), F.col("r.highs").alias("high"))
    if within:
        first = each.groupBy("run").agg(F.min(F.struct("doc_id", "at")).alias("f"), F.count("*").alias("n")).where("n > 1").select("run", F.col("f.doc_id").alias("first"), F.col("f.at").alias("first_at"), "n")
        later = (F.col("doc_id") > F.col("first")) | (F.col("at") >= F.col("first_at") + MIN_WORDS)
    else:
        first = each.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").select("run", "first", "n")
        later = F.col("doc_id") > F.col("first")
    first = base.materialise(first, "first")
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    again = base.spread_join(each, first, "run", "doc_id", total).where(later)
    grouped = again.groupBy("doc_id", "text").agg(F.collect_list(F.struct("low", "high", "first")).alias("found"))
    return _merged(grouped).unionByName(copies)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with every repeated passage cut out; a document of which nothing but white space is left goes.

    All columns stay; n_chars, if there, is counted anew.
    """
    found = base.materialise(_spans(docs), "spans")
    cuts = found.groupBy("doc_id", "text").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    key, of, name = (base.fresh(docs, n) for n in ("cut_doc_id", "cut_text", "cuts"))
    cuts = cuts.select(F.col("doc_id").alias(key), F.col("text").alias(of), F.col("cuts").alias(name))
    rows = docs.join(cuts, (F.col("doc_id") == F.col(key)) & (_name(F.unhex(F.md5(base.text_or_empty()))) == F.col(of)), "left")

    def run(batches):
        for batch in batches:
            at, last = batch.schema.get_field_index("text"), batch.num_columns - 1
            texts, keep, changed = batch.column(at).to_pylist(), [], False
            for i, spans in enumerate(batch.column(last).to_pylist()):
                if spans:
                    texts[i], changed = cut(texts[i], [(s["start"], s["end"]) for s in spans]), True
                keep.append(not spans or bool(texts[i].strip()))
            out = batch.select(range(last))
            if changed:
                out = out.set_column(at, out.schema.field(at), pa.array(texts, out.schema.field(at).type))
            yield out.filter(pa.array(keep, pa.bool_()))

    out = base.arrow_map(rows.select(*docs.columns, name), run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    parts, last = [], 0
    for start, end in spans:
        if start > last:
            parts.append(text[last:start])
        last = max(last, end)
    return "".join([*parts, text[last:]])
