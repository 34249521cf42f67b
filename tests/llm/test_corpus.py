"""Near-duplicates, repeats, packing, archives, media and the pipeline against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.llm import fixtures
from trailhead.llm import fingerprints, flac, neardup, packing, suffixes, warc
from trailhead.llm.queries import END_ID, ranks_and_pattern

SPLIT = re.compile(r"[^ \t\n\r\x0b\x0c]+")


def shingle_set(text):
    words = SPLIT.findall(text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_classes(rows, threshold=0.8):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if both >= threshold * either - 1e-9:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}


# -- near-duplicates


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    found, wanted = [], []
    for _ in range(30):
        items = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        u, v = rng.integers(1, 6, 60), rng.integers(1, 6, 60)
        found.append((neardup.darts(items, u) == neardup.darts(items, v)).mean())
        wanted.append(np.minimum(u, v).sum() / np.maximum(u, v).sum())
    assert abs(np.mean(found) - np.mean(wanted)) < 0.02
    single = neardup.darts(np.array([7], np.uint64))
    assert len(set(single.tolist())) == neardup.K and (single == neardup.darts(np.array([7], np.uint64))).all()


@pytest.mark.parametrize("how", ["darts", "minhash"])
def test_classes_equal_brute_force(spark, how):
    docs = fixtures.documents(spark)
    found = neardup.classes(docs) if how == "darts" else fingerprints.similar(docs)
    rows = found.collect()
    assert len(rows) == docs.count()
    wanted = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None])
    assert {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None} == wanted
    assert neardup.classes(fixtures.empty(spark)).count() == 0


@pytest.mark.parametrize("few, items", [(24, 1 << 20), (2, 3000), (1000, 1 << 20)])
def test_group_of_copies_around_one_text(spark, monkeypatch, few, items):
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "BLOCK_ITEMS", items)
    rng = random.Random(11)
    words = fixtures.prose(rng, 150).split()
    rows = [(500, " ".join(words))]
    for i in range(80):  # each near the first, few near each other
        changed = list(words)
        for at in rng.sample(range(0, 150, 8), 3):
            changed[at] = f"new{i}x{at}"
        rows.append((i, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()} == brute_classes(rows)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(201, 200), (200, 201)]
    found = dict(neardup.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}


def test_one_of_each_keeps_columns_and_null_ids(spark):
    docs = fixtures.documents(spark)
    out = neardup.one_of_each(docs)
    assert out.columns == docs.columns
    wanted = brute_classes([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None])
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == sorted(set(wanted.values()))
    assert out.where("doc_id IS NULL").count() == 2


def test_near_copies_without_ids_are_linked_and_reduced(spark):
    rng = random.Random(31)
    one, two = fixtures.prose(rng, 120).split(), fixtures.prose(rng, 120).split()
    near = lambda words, at: " ".join([*words[:at], f"new{at}", *words[at + 1 :]])
    rows = [(7, " ".join(one))] + [(None, near(one, at)) for at in (0, 119)] + [(None, near(two, at)) for at in (0, 0, 60, 119)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [r["class_id"] for r in neardup.classes(docs).collect()]
    assert len(found) == 7 and len(set(found)) == 2 and found.count(7) == 3
    out = neardup.one_of_each(docs).collect()
    assert [r["doc_id"] for r in out].count(7) == 1 and len(out) == 3  # of rows without doc_id one of each class


def test_edges_are_distinct_links_that_span_the_classes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 3)
    rng = random.Random(41)
    words = fixtures.prose(rng, 150).split()
    rows = [(i, " ".join([f"new{i}x{w}" if rng.random() < 0.02 else w for w in words])) for i in range(40)]
    sets = {i: shingle_set(t) for i, t in rows}
    similar = {i: sum(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for j in sets if j != i and sets[i] != sets[j]) for i in sets}
    found = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.columns == ["doc_id", "class_id", "n_edges"]
    assert all(r["n_edges"] <= similar[r["doc_id"]] for r in found.collect())


def test_filter_of_bits_loses_less_than_the_bands():
    import math

    most, odds = neardup.most_bits(0.8), 0.1
    lost = sum(math.comb(neardup.K, i) * odds**i * (1 - odds) ** (neardup.K - i) for i in range(most + 1, neardup.K + 1))
    assert lost < (1 - 0.8 ** (neardup.K // neardup.BANDS)) ** neardup.BANDS


# -- repeats


def brute_repeats(rows, size=suffixes.MIN_WORDS):
    first, out = {}, {}
    for doc, text in sorted(rows):
        words, spans = [(m.start(), m.end(), m[0]) for m in SPLIT.finditer(text or "")], []
        for i in range(len(words) - size + 1):
            run = tuple(w[2] for w in words[i : i + size])
            if first.setdefault(run, doc) < doc:
                if spans and words[i][0] <= spans[-1][1]:
                    spans[-1][1] = words[i + size - 1][1]
                else:
                    spans.append([words[i][0], words[i + size - 1][1]])
        if spans:
            out[doc] = [tuple(s) for s in spans]
    return out


def test_repeats_equal_brute_force(spark):
    docs = fixtures.documents(spark)
    found = defaultdict(list)
    for r in suffixes.repeats(docs).collect():
        found[r["doc_id"]].append((r["start"], r["end"]))
    wanted = brute_repeats({(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None})
    assert {k: sorted(v) for k, v in found.items()} == wanted and len(wanted) > 10
    assert suffixes.repeats(fixtures.empty(spark)).count() == 0


def test_every_length_of_passage_from_the_bound(spark):
    rng = random.Random(12)
    rows = []
    for i, n in enumerate(range(44, 70)):
        passage = fixtures.prose(rng, n) + f" end{i}"
        rows += [(2 * i, f"{fixtures.prose(rng, 20)} a{i} {passage}"), (2 * i + 1, f"b{i} {passage} {fixtures.prose(rng, 30)}")]
    found = {r["doc_id"]: (r["start"], r["end"]) for r in suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: [v] for k, v in found.items()} == brute_repeats(rows)


def test_cutting_keeps_the_first_occurrence(spark):
    docs = fixtures.documents(spark)
    out = suffixes.without_repeats(docs)
    assert out.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None}
    original = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts[0] == original[0] and 1 not in texts  # 1 is a copy of 0
    assert not brute_repeats(texts.items())
    touched = brute_repeats({(d, t) for d, t in original.items() if d is not None})
    assert all(texts[d] == t for d, t in original.items() if d is not None and d not in touched)


# -- packing


def test_segment_tree_is_best_fit():
    rng = random.Random(6)
    for _ in range(200):
        size = rng.choice([7, 16, 100])
        lengths = [rng.randint(0, size) for _ in range(rng.randint(0, 40))]
        residuals = []
        for length in sorted(lengths, reverse=True):  # brute force: least residual that suffices
            fit = [r for r in residuals if r >= length]
            if fit:
                residuals.remove(min(fit))
                residuals.append(min(fit) - length)
            else:
                residuals.append(size - length)
        bins = packing.best_fit(lengths, size)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert sorted(size - sum(lengths[i] for i in b) for b in bins) == sorted(residuals)


def test_packed_ids_are_lossless(spark):
    import tiktoken

    ranks, pattern = ranks_and_pattern()
    library = tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = fixtures.documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = packing.pack(docs, ranks, pattern, END_ID, size=512).collect()
    ids, positions, ends = packing.matrices(rows)
    parts = defaultdict(dict)
    for i, r in enumerate(rows):
        cu = r["cu_seqlens"]
        assert cu[-1] == r["n_tokens"] <= 512 and (ids[i, cu[-1] :] == END_ID).all()
        for doc, start, a, b in zip(r["doc_ids"], r["doc_starts"], cu, cu[1:], strict=False):
            parts[doc][start] = ids[i, a:b].tolist()
            assert positions[i, a:b].tolist() == list(range(b - a))
    joined = {d: sum((p[s] for s in sorted(p)), []) for d, p in parts.items()}
    assert joined == {r["doc_id"]: [*library.encode_ordinary(r["text"] or ""), END_ID] for r in docs.collect()}
    assert len(ends) == sum(len(r["doc_ids"]) for r in rows) + 1 and len({r["pack_id"] for r in rows}) == len(rows)
    assert packing.pack(fixtures.empty(spark), ranks, pattern, END_ID).count() == 0


def test_conflicts_stay_apart():
    rng = random.Random(8)
    items = [(rng.randint(1, 50), "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 20)}", rng.choice([None, *range(30)])) for _ in range(400)] + [(5, None, None)] * 5
    bins = packing.best_fit_apart(items, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(items)))
    mean = len(items) / -(-sum(i[0] for i in items) // 100)
    for b in bins:
        assert sum(items[i][0] for i in b) <= 100
        clusters = [items[i][2] for i in b if items[i][2] is not None]
        assert len(clusters) == len(set(clusters))
        for source in {items[i][1] for i in b} - {None}:
            allowed = max(1, -(-2 * mean * sum(i[1] == source for i in items) // len(items)))
            assert sum(items[i][1] == source for i in b) <= allowed


def test_hot_source_stays_apart_in_any_block():
    rng = random.Random(9)
    items = [(rng.randint(1, 40), "hot" if i % 3 == 0 else f"s{rng.randint(0, 20)}", rng.choice([None, *range(30)])) for i in range(600)]
    for part in (items, items[:100], items[::3]):  # a task's block doesn't matter
        bins = packing.best_fit_apart(part, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(part)))
        for b in bins:
            assert sum(part[i][0] for i in b) <= 100
            for kind in (1, 2):
                held = [part[i][kind] for i in b if part[i][kind] is not None]
                assert len(held) == len(set(held))
        assert len(bins) >= sum(i[1] == "hot" for i in part)
    assert packing.best_fit_apart([], 100) == []


def test_packing_apart_places_every_token(spark):
    ranks, pattern = ranks_and_pattern()
    docs = fixtures.documents(spark)
    rows = packing.pack_apart(docs, ranks, pattern, size=512).collect()
    encode = packing.tokenizer(ranks, pattern)
    assert sum(r["used"] for r in rows) == sum(len(encode(r["text"] or "")) + 1 for r in docs.collect())
    assert all(sum(r["lengths"]) == r["used"] <= 512 for r in rows)
    assert packing.pack_apart(fixtures.empty(spark), ranks, pattern).count() == 0


def test_near_copies_stay_apart(spark, tmp_path):
    """The query itself: near copies of one text, exact copies with and without doc_id, each in a bin of its own."""
    from trailhead.llm.queries import op10_conflict_packing

    rng = random.Random(21)
    words = fixtures.prose(rng, 120).split()
    near = [" ".join([*words[:i], f"new{i}", *words[i + 1 :]]) for i in range(0, 60, 5)]
    rows = [(i, t, f"s{i}") for i, t in enumerate([*near, near[0]])] + [(None, near[0], "x")] + [(100 + i, fixtures.prose(rng, 40), f"o{i}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    bins = op10_conflict_packing(spark, str(tmp_path)).collect()
    placed = [(d, s) for r in bins for d, s in zip(r["doc_ids"], r["sources"], strict=True)]
    assert sorted(placed, key=str) == sorted([(r[0], r[2]) for r in rows], key=str)
    for r in bins:
        assert sum(d is None or d < 100 for d in r["doc_ids"]) <= 1 and len(r["clusters"]) == len(set(r["clusters"]))


# -- archives


def test_archives_give_back_every_page(spark):
    rng = random.Random(4)
    big = fixtures.prose(rng, 20_000)
    pages = [(1, "http://a", "short"), (2, "http://b", "short"), (3, None, None), (5, "u\r\n", big), (4, "http://c", big), (6, "x", big), (7, "x", "é" * 60), (8, "x", "é" * 60), (None, "x", big), (9, "x", ""), (9, "x", "")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, digest string")
    archives = warc.write(df)
    rows = warc.read(archives).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)
    wanted = []
    for page, _, html in pages:
        data = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == data and p is not None]
        again = len(data) >= 100 and page is not None and page > min(same)
        wanted.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    assert got == sorted(wanted, key=str)
    kinds = [h["warc-type"] for r in archives.collect() for h, _ in warc.records(r["content"])]
    assert kinds.count("continuation") == 12
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_damaged_segments_are_refused():
    payload = b"abc" * 20_000
    made = [warc.parse(__import__("gzip").decompress(r)) for r in warc.rows_of_page(1, "u", payload, hashlib.sha256(payload).hexdigest(), None, "0")]
    parts = [{"number": int(h["warc-segment-number"]), "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, "headers": h, "block": b} for h, b in made]
    assert warc.reassembled(parts[::-1])["payload_bytes"] == len(payload)
    for broken in (parts[:-1], parts[:1] + parts[2:], [*parts, parts[-1]], [{**p, "block": p["block"][:-1]} for p in parts]):
        with pytest.raises(ValueError):
            warc.reassembled(broken)
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


# -- media


def signals():
    rng = np.random.default_rng(3)
    t = np.arange(576 * 7)
    return [
        (np.sin(t / 9) * 100).astype(np.int16), rng.integers(-128, 128, 576 * 3).astype(np.int16), np.full(1152, -128, np.int16),
        np.cumsum(rng.integers(-1, 2, 576 * 4)).clip(-128, 127).astype(np.int16), (t // 40 % 256 - 128).astype(np.int16),
        np.where(rng.random(576 * 2) < 0.01, 127, -128).astype(np.int16),
    ]


def test_streams_are_lossless_and_seekable():
    made = flac.encode(signals())
    for samples, back, media in zip(signals(), flac.decode(made), made, strict=True):
        assert (samples == back).all()
        first, block = flac.block_at(media, len(samples) - 1)
        assert first == len(samples) - 576 and (block == samples[-576:]).all()
    assert len(made[0]) < 0.5 * len(signals()[0])  # a sine is predictable


def test_wider_samples():
    x = (np.sin(np.arange(4096 * 2) / 30) * 20_000).astype(np.int32)
    assert (flac.decode(flac.encode([x], depth=16, block=4096))[0] == x).all()


@pytest.mark.parametrize("at", [-1, -10, -300])
def test_damage_is_noticed(at):
    media = bytearray(flac.encode(signals()[:1])[0])
    media[at] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(media)])


def test_partitions_and_escapes_are_read():
    """A frame made by hand: fixed order 1, two partitions, the second one with raw residuals of 5 bits."""
    size = 192
    samples = np.concatenate([np.arange(96) % 3, 10 + np.arange(96) % 7]).astype(np.int64)
    residual = np.diff(samples)
    bits = "0" + f"{9:06b}" + "0" + f"{samples[0] & 255:08b}" + "00" + "0001"
    zigzag = [2 * r if r >= 0 else -2 * r - 1 for r in residual.tolist()]
    bits += f"{1:04b}" + "".join("0" * (u >> 1) + "1" + str(u & 1) for u in zigzag[:95])
    bits += "1111" + f"{5:05b}" + "".join(f"{r & 31:05b}" for r in residual.tolist()[95:])
    bits += "0" * (-len(bits) % 8)
    body = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
    head = bytes([0xFF, 0xF8, 0x10, 0x02, 0x00])
    crc = flac._crc8(np.frombuffer(head, np.uint8), np.array([0]), np.array([5]))[0]
    frame = head + bytes([crc]) + body
    crc = int(flac._crc16(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]))[0])
    frame += crc.to_bytes(2, "big")
    out = flac._decode_frames(np.frombuffer(frame, np.uint8), np.array([0]), np.array([len(frame)]), 8, size)[:, 0]
    assert (out == samples).all()


def test_media_of_awkward_documents(spark):
    docs = fixtures.documents(spark)
    rows = flac.described(flac.store(docs)).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in rows:
        if r["doc_id"] is None:
            continue
        data = texts[r["doc_id"]]
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == __import__("zlib").crc32(payload[-32:])
    blocks = flac.pcm_blocks(flac.store(docs.where("doc_id = 2"))).orderBy("block").collect()
    assert b"".join(b["pcm"] for b in blocks)[: len(texts[2])] == texts[2] and [b["first_sample"] for b in blocks] == [576 * i for i in range(len(blocks))]
    assert flac.described(flac.store(fixtures.empty(spark))).count() == 0


# -- pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    docs = fixtures.documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "secret_scan", "best_fit_packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
    assert docs.count() > 0 and corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
