"""The aligner, the prefix trie and the reversible dedup of lines against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from trailhead.llm import alignment, lines, trie

# ---- lines


def lined(rng, n, first=0):
    common = [f"  A Common Line number {k} of many  " for k in range(12)]
    rows = []
    for i in range(first, first + n):
        held = [rng.choice(common) if rng.random() < 0.5 else f"own line {i} {j} with words enough" for j in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(held + [held[0].upper() + "\t"] if held else held)))
    return rows


def brute_lines(rows, least=3):
    strip = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(lower)
    who = lambda i, text: (0, zlib.crc32((text or "").encode())) if i is None else (1, i)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(who(i, text))
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if len(holders[key(x)]) < least or max(holders[key(x)]) == who(i, text)]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def deduped(spark, rows, state):
    return sorted(map(tuple, lines.deduped(frame(spark, rows), state).collect()), key=repr)


def test_lines_are_deduped_as_by_brute_force(spark):
    rows = lined(random.Random(1), 60) + [(100, None), (101, ""), (102, "\n\n"), (103, "É" * 20), (104, "É" * 20 + " "), (105, "é" * 20), (106, "É" * 20), (107, "E" * 19)]
    assert deduped(spark, rows, lines.insert(lines.empty(spark), frame(spark, rows))) == brute_lines(rows)


def test_insertions_and_deletions_are_reversible(spark):
    rng = random.Random(2)
    first, second, third = lined(rng, 30), lined(rng, 30, 30), lined(rng, 30, 60)
    state = lines.insert(lines.insert(lines.empty(spark), frame(spark, first)), frame(spark, second))
    assert deduped(spark, first + second, state) == brute_lines(first + second)
    more = lines.insert(state, frame(spark, third + second))  # the second ones are there already
    assert deduped(spark, first + second + third, more) == brute_lines(first + second + third)
    less = lines.delete(more, frame(spark, second + third + [(999, "never inserted")]))
    assert deduped(spark, first, less) == brute_lines(first)
    fresh = lines.insert(lines.empty(spark), frame(spark, first))
    counts = lambda s: sorted(map(tuple, s.counts.select("k1", "k2", "n", "last_id").collect()))
    assert counts(less) == counts(fresh)
    marked = lambda s: sum(np.count_nonzero(np.frombuffer(r.cells, np.uint16)) for r in s.filters.collect())
    assert marked(less) == marked(fresh) == len([1 for r in fresh.counts.collect() if r.n >= 3])
    again = lines.insert(less, frame(spark, third))
    assert deduped(spark, first + third, again) == brute_lines(first + third)
    nothing = lines.delete(again, frame(spark, first + third))
    assert nothing.total == 0 and deduped(spark, [(5, "a line that was common once")], lines.insert(nothing, frame(spark, [(5, "a line that was common once")]))) == [(5, "a line that was common once", 1, 0)]


def test_rows_without_id_and_repeated_ids(spark):
    long = "the very same line in all of them"
    rows = [(None, long), (None, long + "\nx"), (None, long + "\ny"), (7, "short")]
    out = deduped(spark, rows, lines.insert(lines.empty(spark), frame(spark, rows)))
    assert sum(n for *_, n in out) == 2  # one of the three documents without id keeps it
    rows = [(1, long), (1, long + "\nx"), (2, long)]
    out = deduped(spark, rows, lines.insert(lines.empty(spark), frame(spark, rows)))
    assert sum(n for *_, n in out) == 0  # two documents
    rows.append((3, long))
    out = deduped(spark, rows, lines.insert(lines.empty(spark), frame(spark, rows)))
    assert out == sorted([(1, "", 1, 1), (1, "x", 2, 1), (2, "", 1, 1), (3, long, 1, 0)], key=repr)


def test_hot_lines_and_columns(spark, monkeypatch):
    monkeypatch.setattr(lines.base, "SHARE", 4)
    rows = lined(random.Random(3), 80)
    assert deduped(spark, rows, lines.insert(lines.empty(spark), frame(spark, rows))) == brute_lines(rows)
    docs = fixtures.documents(spark).withColumn("n_lines", F.lit("x")).withColumn("goes", F.lit("x"))
    out = lines.deduped(docs, lines.insert(lines.empty(spark), docs))
    assert out.columns == [*docs.columns, "n_lines_", "n_dropped"] and out.count() == docs.count()
    nothing = fixtures.empty(spark)
    assert lines.deduped(nothing, lines.insert(lines.empty(spark), nothing)).count() == 0


def test_cuckoo_filter_keeps_every_key_and_forgets_removed_ones():
    rng = np.random.default_rng(4)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, (20_000, 2))
    held = lines.Cuckoo.of_size(len(keys))
    assert held.add(keys[:, 0].copy(), keys[:, 1].copy())
    assert held.has(keys[:, 0].copy(), keys[:, 1].copy()).all()
    gone, stay = keys[:9000], keys[9000:]
    held.remove(gone[:, 0].copy(), gone[:, 1].copy())
    assert held.has(stay[:, 0].copy(), stay[:, 1].copy()).all()
    assert np.count_nonzero(held.cells) == len(stay) and held.has(gone[:, 0].copy(), gone[:, 1].copy()).mean() < 0.01
    small = lines.Cuckoo.of_size(10)
    before = small.cells.copy()
    assert not small.add(keys[:, 0].copy(), keys[:, 1].copy()) and (small.cells == before).all()
    with pytest.raises(ValueError):
        small.remove(keys[:1, 0].copy(), keys[:1, 1].copy())


# ---- alignment


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_merge_path_pieces_are_the_merge(size):
    rng = random.Random(size)
    for _ in range(50):
        end = rng.randint(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, end + 1), rng.randint(0, end)), end})) for _ in range(2))
        i, j, last_a, last_b = alignment.merged(a, b, size)
        start = lambda x: np.concatenate(([0], x[:-1]))
        want = {(x, y) for x in range(len(a)) for y in range(len(b)) if max(start(a)[x], start(b)[y]) < min(a[x], b[y])}
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(want)
        assert sorted(zip(a[last_a], b[last_b], strict=True)) == [(e, e) for e in sorted(set(a) & set(b))]


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, (1 << 28) - 1])
    assert alignment.unpacked(alignment.packed(values)).tolist() == values.tolist()
    assert len(alignment.unpacked(alignment.packed(values[:0]))) == 0


def brute_alignment(texts, a_file, b_file):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(a_file)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=b_file)
    char = alignment.byte_of_char()

    def tokens(text):
        whole = (" " + text).encode()
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)
        bytes_a = [bytes(char[c] for c in a_side.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:-1], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_side.id_to_piece(i)]]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return [], []
        out = []
        for ids, parts in ((a, bytes_a), (b, bytes_b)):
            at, spans = 0, []
            for i, part in zip(ids, parts, strict=True):
                spans.append((i, at, at + len(part)))
                at += len(part)
            out.append(spans)
        return out

    linked, rows = [], []
    for text in texts:
        a, b = tokens(text) if text else ([], [])
        links = [(x, y) for x, s, e in a for y, t, f in b if max(s, t) < min(e, f)] if len(a) < 3000 else None
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        shown, last = [], 0
        for end in both:
            shown.append(",".join(str(x) for x, s, e in a if last < e <= end) + "|" + ",".join(str(x) for x, s, e in b if last < e <= end))
            last = end
        linked.append(links)
        rows.append((len(a), len(b), len(both), len(links), ";".join(shown)))
    counts = Counter(pair for links in linked for pair in set(links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [(*row[:4], sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), row[4]) for row, links in zip(rows, linked, strict=True)]


def vocabularies():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return alignment.read_byte_level(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN, f.read()


def test_alignment_is_as_by_brute_force(spark, monkeypatch):
    import public_tokenizers

    rng = random.Random(6)
    texts = [t for t in fixtures.texts() if len(t or "") < 1500][:25]
    texts += ["<|endoftext|> and <s> are plain", "  two  spaces ", "▁ is a space?", "ﬁ ligature", "tab\tand\nline", "🙂🙂 \x00 ́", "don't  we'll", " ".join(str(rng.random()) for _ in range(20))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = brute_alignment(texts, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    for size in (1 << 20, 500):
        monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
        found = alignment.aligned(docs, *vocabularies(), whole=True).orderBy("doc_id").select(*columns).collect()
        assert [tuple(r) for r in found] == want
    shown = alignment.digests(alignment.aligned(docs, *vocabularies())).orderBy("doc_id").collect()
    assert [r.groups_sha256 for r in shown] == [hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for w in want]
    assert any(w[0] == 0 and t for w, t in zip(want, texts, strict=True))  # a text that the piece model changes


def test_alignment_takes_awkward_tables(spark):
    docs = fixtures.documents(spark)
    out = alignment.digests(alignment.aligned(docs, *vocabularies()))
    assert out.count() == docs.count() and out.where("n_links <> n_a + n_b - n_groups OR n_best > n_links").isEmpty()
    assert alignment.aligned(fixtures.empty(spark), *vocabularies()).count() == 0


# ---- trie


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].add(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[c] for c in children[p]]
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(b[0] for b in below) + (not below), own + sum(b[1] for b in below))
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *sums[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
            for p, m in members.items()
        ), key=repr,
    )


def talk(rng, n):
    rows = []
    for c in range(n):
        same = rng.random() < 0.4
        for t in range(rng.randint(1, 7)):
            text = f"hello {t}" if same and t < 4 else rng.choice(["yes", "no", "perhaps ü", None, f"{c} alone"])
            rows.append((c, t if t else rng.choice([None, 0]), rng.choice(["user", None]) if not same else "user", text))
    return rows


@pytest.mark.parametrize("limit,block", [(1 << 16, 4096), (6, 2), (1, 1)])
def test_trie_is_as_by_brute_force(spark, limit, block):
    rng = random.Random(8)
    rows = talk(rng, 60) + [(None, 1, "user", "nobody's"), (205, 0, "user", "a"), (205, 0, "user", "a"), (205, 0, "user", "b")]
    rows += [(c, t, "user", f"turn {t}") for c in (300, 301, 302, 333) for t in range(40)] + [(c, 0, "user", "same") for c in range(400, 440)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("digest", F.lit("x")).repartition(3)
    out = trie.nodes(talks, limit, block)
    assert sorted(map(tuple, out.collect()), key=repr) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.nodes(spark.createDataFrame([], schema)).count() == 0
    lone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(lone, 0, "user", "dropped")]
    assert [tuple(r) for r in trie.nodes(spark.createDataFrame(rows, schema)).collect()] == brute_trie(rows)


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(9)
    keys = rng.integers(0, 1 << 63, (50_000, 2)).astype(np.uint64)
    slots = trie.Slots(keys[:40_000])
    assert np.array_equal(np.sort(slots.of(keys[:40_000])), np.arange(40_000))
    assert (slots.of(keys[40_000:]) == -1).all()
    with pytest.raises(ValueError):
        trie.Slots(np.zeros((2, 2), np.uint64))


# ---- silent errors of earlier rounds


def test_two_vocabularies_in_turn(spark):
    from trailhead.llm import bpe

    bytes_ = {bytes([b]): b for b in range(256)}
    one, two = bytes_ | {b"ab": 256, b"abc": 257}, bytes_ | {b"bc": 256, b"abc": 257}
    docs = spark.createDataFrame([(i, "ab abc bc b") for i in range(8)], "doc_id long, text string").repartition(4)
    want = [[sorted({tuple(r.ids) for r in bpe.encoded(docs, v, r"\S+|\s+").collect()}) for v in (one, two)] for _ in range(6)]
    assert want[0][0] != want[0][1] and all(w == want[0] for w in want)
    assert want[0] == [[(256, 32, 257, 32, 98, 99, 32, 98)], [(97, 98, 32, 257, 32, 256, 32, 98)]]


def test_cuts_are_made_in_the_text_that_they_are_of(spark):
    from trailhead.llm import suffixes

    rng = random.Random(12)
    passage, other = fixtures.prose(rng, 60), fixtures.prose(rng, 90)
    rows = [(1, passage + " " + fixtures.prose(rng, 20)), (5, passage + " x"), (5, other)]
    for parts in (1, 3, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        out = {r.text for r in suffixes.without_repeats(docs).collect()}
        assert out == {rows[0][1], " x", other}


def test_texts_of_one_document_are_one_class(spark):
    from trailhead.llm import neardup

    rng = random.Random(13)
    same, other, lone = (fixtures.prose(rng, 80) for _ in range(3))
    rows = [(3, same), (7, same), (7, other), (9, other + " more"), (11, lone), (11, lone), (12, None), (12, lone + " more")]
    for parts in (1, 3, 4, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        found = sorted({(r.doc_id, r.class_id) for r in neardup.classes(docs).collect()})
        assert found == [(3, 3), (7, 3), (9, 3), (11, 11), (12, 11)]
        assert sorted(map(tuple, neardup.one_of_each(docs).collect())) == [(3, same), (11, lone)]


def brute_components(links):
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {x: find(x) for x in parent}


def test_components_of_any_links_in_any_deal(spark, monkeypatch):
    from trailhead.llm import neardup

    rng = random.Random(14)
    order = rng.sample(range(-500, 500), 600)
    chain = list(zip(order, order[1:300], strict=False))  # 300 nodes in a row, in no order of ids
    hub = [(order[300], x) for x in order[301:500]]
    loose = [tuple(rng.sample(order[500:], 2)) for _ in range(60)]
    links = [*chain, *hub, *loose, *loose[:5]]
    rng.shuffle(links)
    wanted = brute_components(links)
    u, v = neardup.rooted(*np.array([(max(x), min(x)) for x in links]).T)
    assert dict(zip(u.tolist(), v.tolist(), strict=True)) == {x: r for x, r in wanted.items() if x != r}
    assert [len(x) for x in neardup.rooted(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]
    for piece, parts in ((1 << 20, 1), (1 << 20, 7), (5, 3)):
        monkeypatch.setattr(neardup, "PIECE", piece)
        found = neardup.components(spark.createDataFrame([*links, (9999, 9999)], "a long, b long").repartition(parts)).collect()
        assert len(found) == len(wanted) and dict(map(tuple, found)) == wanted


def test_many_partitions_take_few_tasks(spark):
    from trailhead.llm import neardup

    rng = random.Random(15)
    words = fixtures.prose(rng, 150).split()
    rows = [(i, " ".join([f"new{i}x{w}" if rng.random() < 0.02 else w for w in words])) for i in range(60)]
    rows += [(100 + i, fixtures.prose(rng, 40)) for i in range(20)] + [(200 + i, rows[0][1]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)], "a long, b long")
    sc, parts, took = spark.sparkContext, 20, {}
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(parts)}
    before = {key: spark.conf.get(key) for key in held}
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        for name, run in (("components", lambda: neardup.components(links)), ("classes", lambda: neardup.classes(docs))):
            sc.setJobGroup(name, "tasks are counted")
            run().collect()
            tracker = sc.statusTracker()
            stages = {stage for job in tracker.getJobIdsForGroup(name) for stage in tracker.getJobInfo(job).stageIds}
            took[name] = sum(info.numCompletedTasks for info in map(tracker.getStageInfo, stages) if info)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for key, value in before.items():
            spark.conf.set(key, value)
    assert took["components"] < 15 * parts and took["classes"] < 50 * parts, took


def test_pieces_of_one_cluster_are_packed_in_linear_time(spark):
    import time

    from trailhead.llm import packing

    began = time.time()
    assert len(packing.best_fit_apart([(1, None, 7)] * packing.BLOCK_ROWS, 4096)) == packing.BLOCK_ROWS
    assert time.time() - began < 20
    rows = spark.range(0, 3 * packing.BLOCK_ROWS, 1, 1).selectExpr("id AS doc_id", "1L AS length", "CAST(NULL AS STRING) AS source", "id % 2 AS cluster")
    out = packing.apart(rows, 16)
    assert out.selectExpr("sum(used)").first()[0] == 3 * packing.BLOCK_ROWS and out.where("size(clusters) <> size(array_distinct(clusters))").isEmpty()


def test_a_table_without_sources_is_packed(spark):
    from tests.llm.test_corpus import ranks_and_pattern
    from trailhead.llm import packing

    docs = fixtures.documents(spark).drop("source")
    assert packing.pack_apart(docs, *ranks_and_pattern(), size=512).where("exists(sources, s -> s IS NOT NULL)").isEmpty()
