"""Secret scans: keyword automaton, anchored patterns near its hits, embedded checksums.

One Aho-Corasick pass over the lower-cased text finds every keyword; a pattern is
tried only where a keyword begins. Runs of hexadecimal digits have no keyword, so
their own pass looks for runs of the least length alone. Tokens that carry a
checksum (six base-62 digits of the CRC-32 of what stands before) are kept only if
it holds. Offsets are code points of the whole text, ends exclusive.

Null texts count as empty; empty texts have no spans; repeated rows give equal rows;
an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.llm import base

# Kinds of secrets, in the order in which ties of a start are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = ("assign", "access", "hex")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]+")
NPM = re.compile(r"npm_[A-Za-z0-9]+")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYWORDS = {w: "assign" for w in ASSIGN_WORDS} | {"akia": "access", "npm_": "npm"} | {f"gh{c}_": "github" for c in "pousr"}


def checksum_holds(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of the random part before them."""
    body = token.partition("_")[2]
    if len(body) != 36:
        return False
    value, digits = zlib.crc32(body[:30].encode()), ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = BASE62[rest] + digits
    return digits == body[30:]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """Lower case of equal length, so that offsets stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _accepted(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= 6
    if kind == "access":
        return match.end() - match.start() >= 20
    return checksum_holds(match[0])


_PATTERN = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}


def spans(text: str, machine) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of all secrets; per kind leftmost and non-overlapping."""
    found, free = [], dict.fromkeys(_PATTERN, 0)
    hits = [(end - size + 1, kind) for end, (kind, size) in machine.iter(lowered(text))]
    if len(hits) > 1:
        hits.sort()
    for start, kind in hits:
        if start >= free[kind] and (m := _PATTERN[kind].match(text, start)):
            free[kind] = m.end()
            if _accepted(kind, m):
                found.append((start, KINDS.index(kind), m.end()))
    found += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def joined(found: list[tuple[int, int, int]], kinds: int = len(KINDS)) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found if k < kinds)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of each row as an array of (kind, start, end)."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]
    )

    def run(batches):
        machine = automaton()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t, machine)] for t in texts]
            yield base.batch_of({"doc_id": batch.column(0), "spans": rows}, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.text_or_empty().alias("text"))
    return base.arrow_map(rows, run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and all spans as one string."""

    def text_of(which):
        return F.array_join(F.transform(which, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    basic = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return scanned.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(text_of(basic), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
        *(count(k).alias(f"n_{k}") for k in KINDS if k not in BASE_KINDS),
    )


def redacted(docs: DataFrame, placeholder: str = "[secret]") -> DataFrame:
    """docs with each secret replaced; overlapping spans of several kinds are replaced as one. All rows and columns stay."""
    schema = docs.schema
    fields = schema.fieldNames()

    def run(batches):
        machine = automaton()
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, changed = batch.column(at).to_pylist(), False
            for i, text in enumerate(texts):
                if text and (found := spans(text, machine)):
                    texts[i], changed = cut(text, found, placeholder), True
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    rows = base.arrow_map(docs, run, schema)
    return rows.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in fields else rows


def cut(text: str, found: list[tuple[int, int, int]], placeholder: str) -> str:
    parts, last = [], 0
    for start, _, end in found:
        if start >= last:
            parts += [text[last:start], placeholder]
        last = max(last, end)
    return "".join([*parts, text[last:]])
