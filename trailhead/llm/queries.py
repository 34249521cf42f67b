"""One query per operator, over whole tables with production parameters.

The trie and the dedup of lines have SQL; the others are held against a brute-force version
or an exact round trip in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from trailhead.llm import alignment, base, bpe, fingerprints, flac, lines, neardup, packing, quality, secrets, suffixes, trie, warc

#: Name of the public vocabulary file; END_ID is the id that it leaves free.
VOCABULARY, END_ID = "byte_bpe_50k.tiktoken", 50256
#: The two that are aligned.
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def ranks_and_pattern(path: str | None = None):
    """The ranks and the pattern of the public byte-level vocabulary, from path if given."""
    import public_tokenizers

    return bpe.read_ranks(path or public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN


def op1_secret_scan(spark, sf_dir):
    return secrets.digests(secrets.scan(base.table(spark, sf_dir, "documents")))


def op2_quality_classifier(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, base.table(spark, sf_dir, "labels")))


def op3_document_fingerprints(spark, sf_dir):
    return fingerprints.compare(base.table(spark, sf_dir, "documents"))


def op4_packed_token_ids(spark, sf_dir):
    packed = packing.pack(base.table(spark, sf_dir, "documents"), *ranks_and_pattern(), END_ID)
    return packing.read_matrices(packing.write_matrices(packed)).select(
        "pack_id", "n_tokens", "doc_ids", "doc_starts", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256")
    )


def op5_minhash_near_dedup(spark, sf_dir):
    return neardup.classes(base.table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark, sf_dir):
    return bpe.digests(base.table(spark, sf_dir, "documents"), *ranks_and_pattern())


def op7_warc_round_trip(spark, sf_dir):
    return warc.read(warc.write(base.table(spark, sf_dir, "pages")))


def op8_suffix_array_dedup(spark, sf_dir):
    return suffixes.repeats(base.table(spark, sf_dir, "documents"))


def op9_flac_media(spark, sf_dir):
    return flac.described(flac.stored(base.table(spark, sf_dir, "documents")))


def op10_conflict_packing(spark, sf_dir):
    return packing.pack_classes_apart(base.table(spark, sf_dir, "documents"), *ranks_and_pattern())


def op11_tokenizer_alignment(spark, sf_dir):
    import public_tokenizers

    with open(public_tokenizers.path(PIECES), "rb") as f:
        model = f.read()
    ranks = alignment.read_byte_level(public_tokenizers.path(BYTE_LEVEL))
    return alignment.digests(alignment.aligned(base.table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, model))


def op12_prefix_trie(spark, sf_dir):
    return trie.nodes(base.table(spark, sf_dir, "conversations"))


def op13_line_dedup(spark, sf_dir):
    docs = base.table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.digests(lines.deduped(docs, lines.insert(lines.empty(spark), docs)))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    found = (
        op1_secret_scan, op2_quality_classifier, op3_document_fingerprints, op4_packed_token_ids, op5_minhash_near_dedup,
        op6_byte_bpe, op7_warc_round_trip, op8_suffix_array_dedup, op9_flac_media, op10_conflict_packing,
        op11_tokenizer_alignment, op12_prefix_trie, op13_line_dedup, pipeline,
    )
    return {f.__name__: f for f in found}


#: crc32 bit by bit, as DuckDB has none: the checksum of the decimal digits of conv_id.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda crc, c: list_reduce(list_concat([xor(crc, c)], range(8)), lambda b, i: xor(b >> 1, (b & 1) * 3988292384))), 4294967295)"""

PREFIX_TRIE_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY pos) AS t FROM turns GROUP BY conv_id),
cut AS (SELECT conv_id, t, {_CRC} % 9 AS h FROM whole),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.t, 1, c.h), []), list_slice(c.t, c.h + 1, len(c.t))) AS t
  FROM cut c LEFT JOIN whole b ON b.conv_id = c.conv_id - c.conv_id % 5),
members AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS depth FROM rebuilt),
prefixed AS (SELECT conv_id, depth, list_slice(t, 1, depth) AS p, len(t) = depth AS is_end FROM members),
nodes AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(strlen(p[depth].text), 0) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256
  FROM prefixed GROUP BY p, depth),
children AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
linked AS (
  SELECT n.*, up.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children
  FROM nodes n LEFT JOIN nodes up ON n.depth > 0 AND up.p = list_slice(n.p, 1, n.depth - 1) LEFT JOIN children c ON c.p = n.p),
above AS (SELECT p, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * size AS saved, unnest(range(0, depth + 1)) AS d FROM linked),
sums AS (SELECT list_slice(p, 1, d) AS p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY 1)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM linked JOIN sums USING (p)
"""

LINE_DEDUP_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
numbered AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM split),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM numbered),
repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS drops FROM keyed k LEFT JOIN repeated r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drops) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT drops), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def oracle_sql():
    return {"op12_prefix_trie": PREFIX_TRIE_SQL, "op13_line_dedup": LINE_DEDUP_SQL}
