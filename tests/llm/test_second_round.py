"""Further brute-force versions: risk and gradient, weighted classes, tightest bins, references, matrices, blocks."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm import fixtures
from tests.llm.test_corpus import SPLIT
from tests.llm.test_texts import brute_spans
from trailhead.llm import fingerprints, flac, neardup, packing, quality, secrets, shingles, suffixes, warc
from trailhead.llm.queries import END_ID, ranks_and_pattern


# -- secrets


def test_digests_equal_brute_force(spark):
    docs = fixtures.documents(spark)
    texts = [(i, f"{t or ''} password=hunter{i}x {'0a' * 12} AKIA{'B' * 18}") for i, t in enumerate(fixtures.texts()[:20])] + [(99, None), (98, "plain")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in secrets.digests(secrets.scan(docs)).collect()}
    for doc, text in texts:
        wanted = brute_spans(text or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in wanted)
        r, kinds = rows[doc], Counter(k for k, _, _ in wanted)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"] == joined
    assert list(rows[99].asDict())[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]


# -- quality


@pytest.mark.parametrize("prior, apart", [(0.3, 0.0), (0.9, 2.0)])
def test_gradient_is_that_of_the_non_negative_risk(prior, apart):
    rng = np.random.default_rng(4)
    at_p, at_u = rng.integers(6 if apart else 0, 12, (30, 4)), rng.integers(0, 6 if apart else 12, (50, 4))
    w, b = rng.normal(size=12) * 0.3 + apart * (np.arange(12) >= 6), 0.1

    def direct(w, b):  # the formula written out, row by row
        s = lambda row: 1 / (1 + np.exp(-(sum(w[i] for i in row) + b)))
        good = prior * np.mean([-np.log(s(r)) for r in at_p])
        return good, np.mean([-np.log(1 - s(r)) for r in at_u]) - prior * np.mean([-np.log(1 - s(r)) for r in at_p])

    assert np.allclose(quality.risk(w, b, at_p, at_u, prior), direct(w, b))
    total = (lambda w, b: sum(direct(w, b))) if direct(w, b)[1] >= 0 else (lambda w, b: -direct(w, b)[1])
    assert (direct(w, b)[1] < 0) == (apart > 0)
    step, found = 1e-6, quality.gradient(w, b, at_p, at_u, prior)
    for i in range(12):
        e = np.eye(12)[i] * step
        assert abs((total(w + e, b) - total(w - e, b)) / (2 * step) - found[i]) < 1e-6
    assert abs((total(w, b + step) - total(w, b - step)) / (2 * step) - found[12]) < 1e-6


# -- shingles, fingerprints


def test_counted_shingles_equal_brute_force():
    texts = [*fixtures.texts(), "a b a b a b a b a b a b", "a b c", ""]
    texts = [t or "" for t in texts]
    hashes, times, sizes = shingles.counted(texts)
    ends = np.cumsum(sizes)
    for text, size, end in zip(texts, sizes, ends, strict=True):
        words = SPLIT.findall(text)
        wanted = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()
        assert size == len(wanted) and sorted(times[end - size : end]) == sorted(wanted.values())
        assert len(np.unique(shingles.numbered(hashes[end - size : end], times[end - size : end]))) == sum(wanted.values())


def test_exact_likeness_of_pairs(spark):
    rows = [(i, fixtures.texts()[i] or "") for i in range(20)]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [SPLIT.findall(t)] for i in range(max(1, len(w) - 4))} if SPLIT.findall(t) else set()
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for r in fingerprints.compare(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect():
        text, follow = rows[r["doc_id"]][1], rows[(r["doc_id"] + 1) % 20][1]
        m = len(text) // 4
        assert abs(r["jaccard_next"] - like(grams(text), grams(follow))) < 1e-9
        assert abs(r["jaccard_edited"] - like(grams(text), grams(text[: len(text) - m] + follow[:m]))) < 1e-9
        assert abs(r["near_next"] - r["jaccard_next"]) < 0.25


# -- near-duplicates


def test_classes_of_repeated_lines_equal_weighted_brute_force(spark):
    rng = random.Random(51)
    lines = [fixtures.prose(rng, 9) for _ in range(6)]
    rows = []
    for i in range(60):
        many = [rng.choice((1, 2, 3, 8)) if i % 3 else 4 for _ in lines]
        rows.append((i, "\n".join("\n".join([line] * n) for line, n in zip(lines, many, strict=True))))
    bags = {}
    for i, text in rows:
        words = SPLIT.findall(text)
        bags[i] = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(bags, 2):
        if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()) - 1e-9:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: find(i) for i in bags} and 1 < len(set(found.values())) < 60


def test_keys_of_many_rows_are_joined_as_usual(spark):
    from pyspark.sql import functions as F

    from trailhead.llm import base

    big = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"))
    small = big.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("k <> 7")
    for how in ("inner", "left"):
        plain = big.join(small.drop("n"), "k", how).select("id", "k", "least")
        for least in (10, 100, 10_000):
            spread = base.spread_join(big, small, "k", "id", 3000, least, how).select("id", "k", "least")
            assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))


# -- repeats


def test_repeats_within_a_document(spark):
    rng = random.Random(61)
    passage = fixtures.prose(rng, 60)
    text = f"{fixtures.prose(rng, 20)} {passage} {fixtures.prose(rng, 30)} {passage}"
    docs = spark.createDataFrame([(1, text), (2, fixtures.prose(rng, 100)), (3, "again " * 300)], "doc_id long, text string")
    assert suffixes.repeats(docs).count() == 0
    found = {r["doc_id"]: (r["start"], r["end"], r["first_doc_id"]) for r in suffixes.repeats(docs, within=True).collect()}
    assert found[1] == (len(text) - len(passage), len(text), 1) and found[3][0] == 50 * 6 and 2 not in found


# -- packing


def test_tightest_compatible_bin_is_taken():
    rng = random.Random(71)
    for _ in range(60):
        items = [(rng.randint(1, 40), rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, *range(6)])) for _ in range(rng.randint(0, 60))]
        bins, left = [], []
        for i in sorted(range(len(items)), key=lambda i: (-items[i][0], i)):
            length, source, cluster = items[i]
            clear = [k for k, own in enumerate(bins) if left[k] >= length and not any(source is not None and items[j][1] == source or cluster is not None and items[j][2] == cluster for j in own)]
            k = min(clear, key=lambda k: (left[k], k), default=None)
            if k is None:
                bins.append([])
                left.append(100)
                k = len(bins) - 1
            bins[k].append(i)
            left[k] -= length
        assert packing.best_fit_apart(items, 100) == bins


@pytest.mark.parametrize("rows", [1, 5, 1000])
def test_matrices_are_read_back(spark, rows):
    docs = fixtures.documents(spark).where("doc_id < 30 OR doc_id IS NULL")
    packed = packing.pack(docs, *ranks_and_pattern(), END_ID, size=512)
    stored = packing.write_matrices(packed, 512, rows)
    assert sorted(map(str, packing.read_matrices(stored).collect())) == sorted(map(str, packed.collect()))
    for m in stored.collect():
        ids, positions = (np.frombuffer(m[c], "<u2").reshape(m["n_rows"], 512) for c in ("ids", "positions"))
        assert m["n_rows"] <= rows and ids.shape == positions.shape and m["cu_seqlens"][0] == 0
        assert len(m["doc_ids"]) == len(m["rows"]) == len(m["cu_seqlens"]) - 1
        for row, end in zip(m["rows"], m["cu_seqlens"][1:], strict=True):
            assert row * 512 < end <= (row + 1) * 512
    assert packing.read_matrices(packing.write_matrices(packing.pack(fixtures.empty(spark), *ranks_and_pattern(), END_ID))).count() == 0


def test_ids_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError):
        packing.pack(fixtures.empty(spark), {b"a": 70_000}, ".", 1)


def test_bins_hold_the_ids(spark):
    ranks, pattern = ranks_and_pattern()
    encode, docs = packing.tokenizer(ranks, pattern), fixtures.documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    parts = {}
    for r in packing.pack_apart(docs, ranks, pattern, size=512, end_id=END_ID).collect():
        ids, at = np.frombuffer(r["ids"], "<i4").tolist(), 0
        for doc, start, n in zip(r["doc_ids"], r["doc_starts"], r["lengths"], strict=True):
            parts[doc, start] = ids[at : at + n]
            at += n
        assert at == len(ids)
    joined = {}
    for doc, start in sorted(parts):
        joined[doc] = joined.get(doc, []) + parts[doc, start]
    assert joined == {r["doc_id"]: [*encode(r["text"] or ""), END_ID] for r in docs.collect()}


# -- archives


def test_revisits_refer_to_records_that_exist(spark):
    pages = [(i, f"http://{i}", "same " * 40 if i % 2 else f"page {i} " * 30) for i in range(1, 30)] + [(1, "http://1", "same " * 40)]
    archives = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"))
    headers = [h for r in archives.collect() for h, _ in warc.records(r["content"])]
    ids = [h["warc-record-id"] for h in headers]
    responses = {h["warc-record-id"]: h for h in headers if h["warc-type"] == "response"}
    revisits = [h for h in headers if h["warc-type"] == "revisit"]
    assert len(set(ids)) == len(ids) == len(pages) and len(revisits) == 14
    assert all(responses[h["warc-refers-to"]]["warc-payload-digest"] == h["warc-payload-digest"] for h in revisits)
    alone = archives.where("name LIKE 'revisits%'")
    with pytest.raises(Exception, match="no response with this payload"):
        warc.read(alone).collect()


# -- media


def test_stored_streams_give_blocks_and_features(spark):
    docs = fixtures.documents(spark).where("doc_id IS NOT NULL AND doc_id < 20").dropDuplicates(["doc_id"])
    media = flac.stored(docs)
    streams = {r["doc_id"]: r["media"] for r in media.collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    for r in flac.write_pcm(media).collect():
        data = texts[r["doc_id"]]
        whole = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert r["pcm"] == whole and r["first_samples"] == list(range(0, len(whole), 576))
        assert all(streams[r["doc_id"]][at : at + 2] == b"\xff\xf8" for at in r["offsets"])
        x = np.frombuffer(whole, np.uint8).astype(float) - 128
        peak, rms, turns, step = (v.split("=")[1] for v in r["feature"].split(";"))
        sign = [v < 0 for v in x - sum(x) / len(x)]
        assert int(peak) == max(abs(x)) and abs(float(rms) - (sum(x * x) / len(x)) ** 0.5) < 1e-3
        assert abs(float(turns) - sum(a != b for a, b in zip(sign, sign[1:], strict=False)) / (len(x) - 1)) < 1e-3
        assert abs(float(step) - sum(abs(b - a) for a, b in zip(x, x[1:], strict=False)) / (len(x) - 1)) < 1e-3
