"""Near-duplicate documents: banded sketches, verified links, classes of linked documents.

The sketch of the near-dedup operator is DartMinHash. A document is a weighted set: its
shingles, each weighted by how often it occurs. For each element and each region of its
weight axis and the rank axis, a hash says how many darts fall there and at which weight,
rank and coordinate; darts above an element's weight are dropped, and each of K coordinates
keeps the dart of least rank. Two weighted sets agree in a coordinate with probability equal
to their weighted Jaccard similarity. Ranks are opened up region by region until every
coordinate has a dart, so a document costs about K ln K darts; all documents of a batch are
opened up together.

Links are pairs of different texts whose weighted sets have at least the given Jaccard
similarity (the sum of the lesser counts over that of the greater ones), verified on the sets
themselves. Texts that share a band are compared so:

1. each bucket links its members to its most central one, the one whose buckets are
   fullest, which costs no more than the bucket has members;
2. pairs of a bucket that are still in different classes are compared one by one, after
   one bit per coordinate has ruled out those that are far below the threshold: pairs of
   small buckets by a join, pairs of full ones in blocks within tasks, which hand out
   links alone. A pair that shares several full buckets is compared in one of them.

So a group of thousands of copies costs about as many comparisons as it has members, a
group just below the threshold is still compared in full and no pairs of a group are
shuffled. Buckets, texts and nodes that very many rows share are dealt over tasks wherever
they are joined. With 32 bands of 4 coordinates a pair at the threshold of 0.8 shares no band with
probability 4.7e-8; one that only the second pass would link is ruled out by its bits with
probability 2.5e-8, so such a pair is lost with 7.2e-8 at most.

Null texts count as empty; texts without words are alike and form one class. Equal
texts, also in repeated rows, are in one class. Rows that share a doc_id share a class.
A null doc_id stays null, its row is classed by its text. An empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.llm import base, shingles

K, BANDS = 128, 32
THRESHOLD = 0.8
#: Bits that may differ between sketches of a pair at the threshold: expectation plus 6 deviations, which one of 4e7 exceeds.
_SLACK = 6.0
#: Up to so many members a bucket's pairs are joined; fuller ones are compared within tasks.
FEW = 24
#: Links that a task joins at once, at least.
PIECE = 1 << 20
#: Hashes by which texts are sorted out before they are shuffled.
MARKS = 1 << 19
#: Shingles of a block of documents that one task compares with another block.
BLOCK_ITEMS = 1 << 20
#: Width of the first rank region, where an element of weight 1 has a quarter of a dart; each further one is twice as wide.
_UNIT = 2.0**-9
_cdfs: dict[float, np.ndarray] = {}


def fold(sketches: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band of each row of coordinates."""
    parts = sketches.reshape(len(sketches), bands, -1)
    key = np.broadcast_to(shingles.mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2])
    for j in range(parts.shape[2]):
        key = shingles.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key


def _cdf(rate: float) -> np.ndarray:
    """Cumulative Poisson probabilities."""
    if rate not in _cdfs:
        top = int(rate + 12 * math.sqrt(rate) + 20)
        _cdfs[rate] = np.cumsum([math.exp(j * math.log(rate) - rate - math.lgamma(j + 1)) for j in range(top)])
    return _cdfs[rate]


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def darts_of(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int = K) -> np.ndarray:
    """The 64-bit dart that each of k coordinates keeps, a row for each weighted set.

    The sets lie in a row: sizes says how many elements each has. Elements are hashes, weights
    positive. All sets are opened up rank region by rank region together; those whose
    coordinates all have a dart drop out. A set without elements keeps zeros.
    """
    n = len(sizes)
    best = np.zeros(n * k, np.uint64)
    filled = np.zeros(n * k, bool)
    least = np.full(n * k, ~np.uint64(0))
    weights = weights.astype(np.float64)
    whole = len(elements) > 0 and weights.min() >= 1  # all darts of the first weight region count
    owner = np.repeat(np.arange(n), sizes)
    highest = int(math.log2(weights.max() + 1 - 1e-12)) if len(elements) else -1
    level = 0
    while len(elements):
        found_s, found_r, found_d = [], [], []
        width = 2.0**level * _UNIT
        for band in range(highest + 1):
            low = 2.0**band - 1
            inside = np.flatnonzero(weights > low) if band else slice(None)
            mine, top, whose = elements[inside], weights[inside], owner[inside]
            if not len(mine):
                break
            seed = shingles.mix(mine + np.uint64((level * 64 + band + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
            cdf = _cdf(k * width * 2.0**band)
            hit = np.flatnonzero(seed >= np.uint64(math.ceil(cdf[0] * 2.0**53) << 11))  # those with darts at all
            many = np.searchsorted(cdf, _unit(seed[hit]), "right")
            at = np.repeat(hit, many)
            index = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
            dart = shingles.mix(seed[at] ^ (index.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
            slot = whose[at] * k + (dart & np.uint64(k - 1) if k & k - 1 == 0 else dart % np.uint64(k)).astype(np.int64)
            open_ = np.flatnonzero(~filled[slot])  # ranks of earlier regions are lower
            dart, slot = dart[open_], slot[open_]
            if highest and (band or not whole):  # darts above the element's weight are dropped
                below = low + 2.0**band * _unit(shingles.mix(dart + np.uint64(1))) < top[at[open_]]
                dart, slot = dart[below], slot[below]
            found_s.append(slot)
            found_d.append(dart)
            found_r.append(shingles.mix(dart + np.uint64(2)))  # the place within the region
        slot, rank, dart = map(np.concatenate, (found_s, found_r, found_d))
        np.minimum.at(least, slot, rank)
        kept = rank == least[slot]  # of the darts of a coordinate the one of least rank
        best[slot[kept]] = dart[kept]
        filled[slot] = True
        level += 1
        left = ~filled.reshape(n, k).all(1) & (sizes > 0)
        stay = left[owner]
        if not stay.all():
            elements, weights, owner = elements[stay], weights[stay], owner[stay]
            highest = int(math.log2(weights.max() + 1 - 1e-12)) if len(elements) else -1
    return best.reshape(n, k)


def darts(elements: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """The darts of one set; weights are 1 where none are given."""
    weights = np.ones(len(elements)) if weights is None else weights
    return darts_of(elements, weights, np.array([len(elements)]), k)[0]


class Darts:
    """Sketches of the near-dedup operator: shingles are weighted by how often they occur."""

    @staticmethod
    def sketches(laid: shingles.Laid) -> tuple[np.ndarray, np.ndarray]:
        """Band keys and one bit per coordinate of each text."""
        found = darts_of(*shingles.counted_of(laid))
        return fold(found, BANDS), np.packbits((shingles.mix(found + np.uint64(3)) >> np.uint64(63)).astype(np.uint8), axis=1)

    @staticmethod
    def sets(texts: list[str]) -> list[np.ndarray]:
        """The set that each text is verified by, as sorted 32-bit hashes: occurrences of shingles."""
        hashes, times, sizes = shingles.counted(texts)
        items = (shingles.numbered(hashes, times) >> np.uint64(32)).astype(np.uint32)
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(sizes)), sizes), times, len(sizes)).astype(np.int64)) if len(sizes) else sizes
        return [np.unique(x).view(np.int32) for x in np.split(items, ends[:-1])]


def _sketched(docs: DataFrame, sketch, measure: Callable | None = None, carry: str | None = None) -> DataFrame:
    """A row for each document: the key of its text, its band keys and its bits as two longs.

    measure makes, once for each task, a function from laid-out texts to a number for each, the
    column measure; carry is a column of docs that comes along as a string.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("keys", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64())), ("measure", pa.int64()), ("carry", pa.string())])

    def run(batches):
        of = measure() if measure else None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(1).to_pylist()
            found = [(*sketch.sketches(laid), of(laid) if of else np.zeros(0, np.int64)) for laid in shingles.laid_out(texts)]
            keys, bits, measured = map(np.concatenate, zip(*found, strict=True))
            made = [hashlib.md5(t.encode("utf-8", "replace"), usedforsecurity=False).digest() for t in texts]
            yield base.batch_of({"doc_id": batch.column(0), "text_key": made, "keys": base.lists_of(keys.view(np.int64).ravel(), BANDS, len(texts)), "bits": base.lists_of(bits.view(np.int64).ravel(), 2, len(texts)), "measure": measured if of else [None] * len(texts), "carry": batch.column(2)}, schema)

    extra = (F.lit(None) if carry is None else F.col(carry)).cast("string").alias("carry")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.text_or_empty().alias("text"), extra)
    return base.arrow_map(rows, run, "doc_id long, text_key binary, keys array<long>, bits array<long>, measure long, carry string")


def _own_id(text_key):
    """The node of a text that no row with a doc_id has; above all doc_ids, so that these name the classes."""
    return F.lit(1 << 62) + F.abs(F.xxhash64(text_key) % (1 << 62))


def _marked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id may be in ids, by one of MARKS hashes, so that few texts of others are shuffled; the list of marks is bounded at any size."""
    mark = F.pmod(F.xxhash64("id"), F.lit(MARKS)).alias("mark")
    return rows.withColumn("mark", mark).join(F.broadcast(ids.select(mark).distinct()), "mark", "left_semi").drop("mark")


def _sets(docs: DataFrame, ids: DataFrame, several: DataFrame | None, sketch) -> DataFrame:
    """Verification sets of the nodes in ids (id, and the hash of its text_key), as the bytes of sorted 32-bit hashes.

    A node has a doc_id or the id of its text, which is looked up among rows without doc_id
    and those of several, the doc_ids that more than one text has.
    """
    schema = pa.schema([("id", pa.int64()), ("items", pa.binary())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield base.batch_of({"id": batch.column(0), "items": [x.tobytes() for x in sketch.sets(batch.column(1).to_pylist())]}, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), base.text_or_empty().alias("text"))
    others = rows.where("id IS NULL")
    if several is not None:
        others = others.unionByName(rows.join(several.select(F.col("doc_id").alias("id")), "id", "left_semi"))
    others = others.select(_own_id(F.unhex(F.md5("text"))).alias("id"), "text").dropDuplicates(["id"]).join(ids.select("id"), "id", "left_semi")
    named = _marked(rows, ids).join(ids, "id").where(F.xxhash64(F.unhex(F.md5("text"))) == F.col("of")).select("id", "text").dropDuplicates(["id"])
    return base.arrow_map(named.unionByName(others), run, "id long, items binary")


def _similar(x: pa.Array, y: pa.Array, threshold: float) -> np.ndarray:
    """Whether the sets in the same place of two columns of sets are similar enough."""
    sizes, marked = [], []
    for column in (x, y):
        items = [np.frombuffer(b, np.uint32) for b in column.to_pylist()]
        sizes.append(np.fromiter(map(len, items), np.int64, len(items)))
        marked.append(np.repeat(np.arange(len(items), dtype=np.uint64) << np.uint64(32), sizes[-1]) | np.concatenate([np.zeros(0, np.uint32), *items]))
    row = np.sort(np.concatenate(marked))  # an item of both sets is there twice
    both = np.bincount((row[1:][row[1:] == row[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(sizes[0]))
    return both >= np.ceil(threshold * (sizes[0] + sizes[1] - both) - 1e-9)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough; pairs are distinct."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))

    def run(batches):
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(_similar(batch.column("x"), batch.column("y"), threshold)))

    return base.arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


def rooted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between u and v, each node that isn't the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before = root.copy()
        np.minimum.at(root, before[x], before[y])
        np.minimum.at(root, before[y], before[x])
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _forest(links: DataFrame) -> DataFrame:
    """Links (u, v) to lesser nodes, replaced by fewer and longer ones; own marks one of each u, the others are between the v that a u had.

    Each task first joins the links that it has read, which leaves one for each u, so that no u
    has more of them than there are such tasks, or pieces of PIECE links; then they are grouped by u.
    """
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        held, n = [pa.RecordBatch.from_pylist([], schema)], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PIECE:
                yield joined(held)
                held, n = held[:1], 0
        yield joined(held)

    def joined(held):
        u, v = (np.concatenate([batch.column(i).to_numpy() for batch in held]) for i in (0, 1))
        return base.batch_of(dict(zip("uv", rooted(u, v), strict=True)), schema)

    lesser = base.arrow_map(links, run, "u long, v long").groupBy("u").agg(F.min("v").alias("least"), F.collect_set("v").alias("all"))
    own = F.col("x") == F.col("v")
    made = lesser.select("u", F.col("least").alias("v"), F.explode("all").alias("x")).select(F.when(own, F.col("u")).otherwise(F.col("x")).alias("u"), "v", own.alias("own"))
    return base.materialise(made, "forest")


def _stars(links: DataFrame) -> DataFrame:
    """(id, class_id) of each node of links (a, b), a < b, but the least of its class, which names the class.

    Links are joined (``_forest``), and each (u, v) to a node that has a lesser one in turn moves on
    to that, until nothing is left to move (compare the small-star and large-star steps of Kiveris et
    al., 2014). The join is between two plain tables, so Spark splits a v of very many links.
    """
    edges = _forest(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    while True:
        onward = edges.where("own").select(F.col("u").alias("v"), F.col("v").alias("w"))
        moved = edges.join(onward, "v", "left")
        if moved.where("w IS NOT NULL OR NOT own").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("class_id"))
        longer = _forest(moved.select("u", F.coalesce("w", "v").alias("v")))
        base.release(edges)
        edges = longer


def components(links: DataFrame) -> DataFrame:
    """(id, class_id) of every node of links (a, b); the class is named by its least id."""
    found = _stars(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return found.unionByName(found.select(F.col("class_id").alias("id"), "class_id").distinct())


def most_bits(threshold: float) -> int:
    """Bits in which sketches of a pair at the threshold may differ."""
    odds = (1 - threshold) / 2
    return math.ceil(K * odds + _SLACK * math.sqrt(K * odds * (1 - odds)))


def _compared(members: DataFrame, nodes: DataFrame, sets: DataFrame, total: int, threshold: float) -> DataFrame:
    """Links (a, b) between different classes among members (id, key, m, c, bits) of full buckets; m is the number of members.

    A bucket is dealt into blocks of about BLOCK_ITEMS shingles, each pair of blocks is one
    task's work, and only links leave it. Of the buckets that a pair shares it is compared in
    that of the least band.
    """
    rows = members.join(nodes.select("id", "keys"), "id").join(sets, "id")
    sizes = members.select("id", "key").join(sets.select("id", (F.length("items") / 4).cast("long").alias("size")), "id")
    share = sizes.groupBy("key").agg(F.ceil(F.sum(F.col("size") + 1) / BLOCK_ITEMS).cast("int").alias("blocks"), F.count("*").alias("n"))
    dealt = base.spread_join(rows, share, "key", "id", total, held="m").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    most = most_bits(threshold)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table):
        ids, classes_, block = (table.column(n).to_numpy() for n in ("id", "c", "block"))
        bits, keys = (np.stack(table.column(n).to_numpy()).astype(np.int64) for n in ("bits", "keys"))
        earlier = keys[:, : int(np.argmax(keys[0] == table.column("key")[0].as_py()))]
        items = table.column("items").to_pylist()
        sizes = np.fromiter(map(len, items), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(items), np.uint32)
        words, local = np.unique(flat, return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        across = table.column("x")[0].as_py() != table.column("y")[0].as_py()
        mine, found = np.zeros(len(words), bool), []
        for i in range(len(ids)):
            near = np.bitwise_count(bits[i, 0] ^ bits[i + 1 :, 0]) + np.bitwise_count(bits[i, 1] ^ bits[i + 1 :, 1]) <= most
            near &= classes_[i + 1 :] != classes_[i]
            if across:
                near &= block[i + 1 :] != block[i]
            at = np.flatnonzero(near) + i + 1
            at = at[~(earlier[at] == earlier[i]).any(1)]
            if not len(at):
                continue
            own = local[starts[i] : starts[i] + sizes[i]]
            mine[own] = True
            for part in np.array_split(at, max(1, int(sizes[at].sum() >> 22))):  # bounded memory
                size = sizes[part]
                ends = np.cumsum(size)
                picked = np.arange(ends[-1]) + np.repeat(starts[part] - (ends - size), size)
                sums = np.concatenate([[0], np.cumsum(mine[local[picked]])])
                both = sums[ends] - sums[ends - size]
                either = sizes[i] + size - both
                found += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in part[both >= np.ceil(threshold * either - 1e-9)]]
            mine[own] = False
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}, schema=schema)

    return dealt.select("key", "x", "y", "id", "c", "bits", "keys", "block", "items").groupBy("key", "x", "y").applyInArrow(compare, "a long, b long")


def _classed(docs: DataFrame, sketch, threshold: float, measure: Callable | None = None, carry: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The sketched rows, then text_key, class_id, n_edges and n (rows) of each text, and the number of rows."""
    made = base.materialise(_sketched(docs, sketch, measure, carry), "sketches")
    n_rows = made.count()
    # texts that occur once or often: one node each, named by the least doc_id
    nodes = made.groupBy("text_key").agg(F.min("doc_id").alias("id"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.count("*").alias("n"))
    # of texts that share a doc_id one is named by it, and all are linked
    of = F.xxhash64("text_key")
    several = made.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(of).alias("low"), F.max(of).alias("high")).where("low < high")
    several = None if several.isEmpty() else base.materialise(several, "several")
    if several is None:
        nodes = base.materialise(nodes.withColumn("id", F.coalesce("id", _own_id(F.col("text_key")))), "nodes")
    else:
        holder = nodes.where("id IS NOT NULL").groupBy("id").agg(F.min(of).alias("holder"))
        own = F.col("holder").isNull() | (F.col("holder") != of)
        nodes = base.materialise(nodes.join(holder, "id", "left").withColumn("id", F.when(own, _own_id(F.col("text_key"))).otherwise(F.col("id"))).drop("holder"), "nodes")
        of_row = made.join(several, "doc_id").select("text_key", "low", of.alias("of")).where("low <> of").distinct()
        low = nodes.select(F.col("id").alias("b"), of.alias("low"))
        of_row = of_row.join(nodes.select("text_key", F.col("id").alias("a")), "text_key").join(low, "low")
        given = base.materialise(of_row.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "given")
    rows, total = nodes.select("id", F.explode("keys").alias("key")), n_rows * BANDS
    full = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    shared = base.spread_join(rows, full.withColumn("n", F.col("m")), "key", "id", total)
    # a row for each node that shares a bucket: its buckets, how full they are, and what else is asked about it
    shared = shared.groupBy("id").agg(F.sum("m").alias("w"), F.collect_list(F.struct("key", "m")).alias("buckets"))
    shared = base.materialise(shared.join(nodes.select("id", of.alias("of"), "bits"), "id"), "buckets")

    members = shared.select("id", "w", F.inline("buckets"))
    central = members.groupBy("key").agg(F.max_by("id", F.struct("w", -F.col("id"))).alias("centre"), F.count("*").alias("n"))
    spokes = base.spread_join(members, central, "key", "id", total, held="m").where("id <> centre")
    spokes = spokes.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    sets = base.materialise(_sets(docs, shared.select("id", "of"), several, sketch), "sets")
    links = base.materialise(_verified(spokes, sets, threshold), "links")
    if several is not None:
        links = links.unionByName(given).distinct()
    first = _stars(links)

    placed = shared.join(first, "id", "left").select("id", "bits", F.coalesce("class_id", "id").alias("c"), F.inline("buckets"))
    open_ = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
    rest = base.materialise(base.spread_join(placed, open_, "key", "id", total, held="m"), "rest")
    few = rest.where(F.col("m") <= FEW)
    pairs = few.alias("x").join(few.alias("y"), F.expr(f"x.key = y.key AND x.id < y.id AND x.c <> y.c AND bit_count(x.bits[0] ^ y.bits[0]) + bit_count(x.bits[1] ^ y.bits[1]) <= {most_bits(threshold)}"))
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    links = links.unionByName(base.materialise(_verified(pairs, sets, threshold), "links"))
    many = rest.where(F.col("m") > FEW)
    if not many.isEmpty():
        links = links.unionByName(base.materialise(_compared(many, nodes, sets, total, threshold), "links"))
    base.release(shared, sets, rest, first)
    found = _stars(links)

    ends = links.distinct().select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_edges"))
    named = (
        nodes.select("text_key", "id", "n").join(found, "id", "left").join(ends, "id", "left")
        .select("text_key", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"), "n")
    )
    return made, named, n_rows


def _of_rows(docs: DataFrame, sketch, threshold: float, measure: Callable | None = None, carry: str | None = None) -> DataFrame:
    """doc_id, text_key, measure, carry, class_id, n_edges and at, the row's number, of each row; a text of very many rows is dealt over tasks."""
    made, named, total = _classed(docs, sketch, threshold, measure, carry)
    at = F.monotonically_increasing_id()
    return base.spread_join(made.select("doc_id", "text_key", "measure", "carry", at.alias("at")), named, "text_key", "at", total)


def classes(docs: DataFrame, sketch=Darts, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of the class) and n_edges, the text's edges among the verified links that span its class."""
    return _of_rows(docs, sketch, threshold).select("doc_id", "class_id", "n_edges")


def measured_classes(docs: DataFrame, measure: Callable, carry: str | None, sketch=Darts, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, at (the row's number), class_id, a number that measure gives for the text, and the column carry of each row, by one pass over the texts."""
    return _of_rows(docs, sketch, threshold, measure, carry).select("doc_id", "at", "class_id", "measure", "carry")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class stays, that of the least doc_id, with all its columns.

    Of rows that share a doc_id one stays, that of the least text_key; of rows without doc_id
    one of each class, beside the one that has a doc_id.
    """
    found = base.materialise(_of_rows(docs, Darts, threshold).drop("at"), "classes")
    key, kept = base.fresh(docs, "text_key"), base.fresh(docs, "kept_key")
    stays = found.where("doc_id = class_id").groupBy("doc_id").agg(F.min("text_key").alias(kept))
    rows = docs.join(stays, "doc_id").where(F.unhex(F.md5(base.text_or_empty())) == F.col(kept)).dropDuplicates(["doc_id"]).select(*docs.columns)
    least = found.where("doc_id IS NULL").groupBy("class_id").agg(F.min("text_key").alias(key)).select(key)
    unnamed = docs.where("doc_id IS NULL").withColumn(key, F.unhex(F.md5(base.text_or_empty()))).dropDuplicates([key])
    return rows.unionByName(unnamed.join(least, key, "left_semi").select(*docs.columns))
