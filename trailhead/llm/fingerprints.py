"""Document fingerprints: MinHash with universal hash permutations in numpy.

Each of N permutations maps a 32-bit shingle hash x to ``a x + b`` (mod 2^32, a odd);
the signature holds the least value of each, the fingerprint eight bits of each value
as hexadecimal text. The likeness of two fingerprints is the share of equal bytes,
freed from the share of 1/256 that agrees by chance.

``similar`` joins the bands of signatures in Spark and verifies Jaccard similarity on
the shingle sets (see ``neardup``); ``compare`` sets each document against its edited
form and against the document that follows in order of doc_id.

Null texts count as empty. A text without words has the fingerprint "", which is like
itself (1) and unlike all others (0). Rows with equal doc_id follow each other in order
of their texts' hashes; null doc_ids come first. A single row follows itself. An empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.llm import base, neardup, shingles

N = 128
_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 1 << 32, (N, 1), dtype=np.uint32) | np.uint32(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, (N, 1), dtype=np.uint32)
_CHUNK = 1024


def signature(values: np.ndarray) -> np.ndarray | None:
    """Least value of each permutation over 64-bit shingle hashes; None if there are none."""
    if not len(values):
        return None
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(N, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _CHUNK):
        np.minimum(out, (_A * x[at : at + _CHUNK] + _B).min(1), out=out)
    return out


def of_text(text: str) -> bytes:
    """Fingerprint as bytes, empty for a text without words."""
    return of_shingles(shingles.shingles(text))


def of_shingles(values: np.ndarray) -> bytes:
    found = signature(values)
    return b"" if found is None else ((found * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    if not a or not b:
        return float(a == b)
    same = (np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean()
    return float(max(0.0, (same - 1 / 256) / (1 - 1 / 256)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact likeness of two sets of shingles; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by the start of the following text."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


class Signatures:
    """Sketches of banded MinHash signatures, for ``neardup``: a document is the set of its shingles."""

    @staticmethod
    def sketches(laid: shingles.Laid) -> tuple[np.ndarray, np.ndarray]:
        """Band keys and one bit per coordinate of each text."""
        hashes, _, sizes = shingles.counted_of(laid)
        found = np.stack([np.zeros(N, np.uint32) if (made := signature(x)) is None else made for x in np.split(hashes, np.cumsum(sizes)[:-1])])
        bits = ((found * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8)
        return neardup.fold(found.astype(np.uint64), neardup.BANDS), np.packbits(bits, axis=1)

    @staticmethod
    def sets(texts: list[str]) -> list[np.ndarray]:
        hashes, _, sizes = shingles.counted(texts)
        return [np.unique((x >> np.uint64(32)).astype(np.uint32)).view(np.int32) for x in np.split(hashes, np.cumsum(sizes)[:-1])]


def similar(docs: DataFrame, threshold: float = neardup.THRESHOLD) -> DataFrame:
    """doc_id and class_id of the near-duplicate classes that banded MinHash signatures find."""
    return neardup.classes(docs, Signatures, threshold)


def _starts(docs: DataFrame, parts: int) -> list[int]:
    """First doc_id of each part, all of them ids that occur."""
    shares = [i / parts for i in range(1, parts)] or [0.5]
    row = docs.agg(F.min("at"), F.percentile_approx("at", shares, max(10_000, 20 * parts))).first()
    return [] if row[0] is None else sorted({row[0], *(row[1] if parts > 1 else [])})


def compare(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every document and its edited form, and likeness to that and to the next document, with the exact Jaccard similarity of either pair.

    Texts are shuffled once, into ranges of doc_id that start at known ids. The first
    row of each range is also sent to the range before it, so that each task can pair
    its last row with the one that follows, without a window over the whole table.
    """
    if not parts:  # as many as the input has; a range is streamed, so its size is no matter of memory
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(docs.rdd.getNumPartitions(), 20_000))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"), F.col("doc_id").cast("long").alias("doc_id"), base.text_or_empty().alias("text")
    )
    starts = _starts(rows.select("at"), parts)
    first = np.array(starts, np.int64)
    dealt_schema = pa.schema([("part", pa.int32()), ("later", pa.int32()), ("at", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string())])

    def deal(batches):
        for batch in batches:
            at = batch.column(0).to_numpy()
            part = np.searchsorted(first, at, "right").astype(np.int32) - 1
            opens = np.flatnonzero(np.isin(at, first))
            take = np.concatenate([np.arange(len(at)), opens])
            parts_ = np.concatenate([part, np.where(part[opens] > 0, part[opens] - 1, len(first) - 1)]).astype(np.int32)
            later = np.concatenate([np.zeros(len(at), np.int32), np.ones(len(opens), np.int32)])
            moved = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(parts_), pa.array(later), *(moved.column(i).cast(dealt_schema.field(i + 2).type) for i in range(3))], schema=dealt_schema)

    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("jaccard_edited", pa.float64()), ("jaccard_next", pa.float64())]
    )

    def run(batches):
        held = None
        for batch in batches:
            out = []
            for later, doc_id, text in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                values = shingles.shingles(text)
                print_ = of_shingles(values)
                if held is not None and not held[3]:
                    changed = edited(held[1], text)
                    theirs = held[4] if changed == held[1] else shingles.shingles(changed)
                    other = held[2] if changed == held[1] else of_shingles(theirs)
                    digest = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
                    out.append((held[0], len(held[1]), digest, held[2].hex(), other.hex(), likeness(held[2], other), likeness(held[2], print_), jaccard(held[4], theirs), jaccard(held[4], values)))
                held = (doc_id, text, print_, later, values)
            if out:
                yield base.batch_of(dict(zip(schema.names, zip(*out, strict=True), strict=True)), schema)

    dealt = base.arrow_map(rows, deal, "part int, later int, at long, doc_id long, text string")
    dealt = dealt.repartitionById(max(1, len(starts)), "part").sortWithinPartitions("later", "at", F.xxhash64("text"))
    return base.arrow_map(
        dealt, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"
    )
