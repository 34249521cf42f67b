"""Archives, binary documents, settings, model calls, reconstruction and plug-ins on small inputs."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from trailhead import config
from trailhead.operators import evaluation, plugins, reconstruction
from trailhead.sources import archives


def pool(strings):
    body, offsets = b"", []
    for s in strings:
        offsets.append(len(body))
        body += struct.pack("<H", len(s)) + s.encode("utf-16-le") + b"\0\0"
    body += b"\0" * (-len(body) % 4)
    start = 28 + 4 * len(strings)
    return struct.pack("<HHI5I", 1, 28, start + len(body), len(strings), 0, 0, start, 0) + struct.pack(f"<{len(strings)}I", *offsets) + body


def document(strings, elements):
    """Nested start and end chunks; attributes are (name, raw or None, type, data)."""
    chunks = pool(strings)
    for name, attributes, closes in elements:
        body = struct.pack("<iiHHHHHH", -1, strings.index(name), 20, 20, len(attributes), 0, 0, 0)
        for key, raw, kind, data in attributes:
            body += struct.pack("<iiiHBBI", -1, strings.index(key), strings.index(raw) if raw else -1, 8, 0, kind, data)
        chunks += struct.pack("<HHIII", 0x0102, 16, 16 + len(body), 1, 0xFFFFFFFF) + body
        for _ in range(closes):
            chunks += struct.pack("<HHIII", 0x0103, 16, 24, 1, 0xFFFFFFFF) + struct.pack("<ii", -1, 0)
    return struct.pack("<HHI", 3, 8, 8 + len(chunks)) + chunks


MANIFEST = document(
    ["manifest", "activity", "service", "name", "exported", "enabled", "p.A", "p.S", "package", "p"],
    [("manifest", [("package", "p", 3, 9)], 0), ("activity", [("name", "p.A", 3, 6), ("exported", None, 0x12, 0xFFFFFFFF)], 1), ("service", [("name", "p.S", 3, 7), ("enabled", None, 0x12, 0)], 2)],
)


def table():
    keys, types = pool(["app_name", "limit"]), pool(["string", "integer"])
    entry = lambda key, kind, data: struct.pack("<HHIHBBI", 8, 0, key, 8, 0, kind, data)
    parts = b""
    for type_id, content in ((1, entry(0, 3, 0)), (2, entry(1, 0x10, 42))):
        parts += struct.pack("<HHIBBHII", 0x0201, 20, 20 + 4 + len(content), type_id, 0, 0, 1, 24) + struct.pack("<I", 0) + content
    name = "p".encode("utf-16-le").ljust(256, b"\0")
    header = 288
    package = struct.pack("<HHII", 0x0200, header, header + len(types) + len(keys) + len(parts), 0x7F) + name + struct.pack("<5I", header, 0, header + len(types), 0, 0) + types + keys + parts
    values = pool(["My App"])
    return struct.pack("<HHII", 2, 12, 12 + len(values) + len(package), 1) + values + package


def test_binary_xml_and_resources():
    found = archives.binary_xml(MANIFEST)
    assert [(n, p, tag) for n, p, tag, _ in found] == [(0, -1, "manifest"), (1, 0, "activity"), (2, 0, "service")]
    assert found[1][3] == {"name": "p.A", "exported": "true"}
    assert archives.resources(table()) == [(0x7F010000, "p", "string", "app_name", "My App"), (0x7F020000, "p", "integer", "limit", "42")]
    with pytest.raises(ValueError):
        archives.binary_xml(table())


def test_archives_are_read_in_tasks(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("AndroidManifest.xml", MANIFEST)
        z.writestr("resources.arsc", table())
        z.writestr("classes.dex", b"x" * 10)
    (tmp_path / "a.apk").write_bytes(archives.replaced(data.getvalue(), {"classes.dex": b"y", "new": b"z"}))
    files = archives.entries(spark, str(tmp_path / "*.apk"))
    assert {r["name"]: r["size"] for r in files.collect()} == {"AndroidManifest.xml": len(MANIFEST), "resources.arsc": len(table()), "classes.dex": 1, "new": 1}
    parts = archives.components(archives.elements(files.where("name = 'AndroidManifest.xml'")))
    assert [(r["kind"], r["name"], r["exported"]) for r in parts.collect()] == [("activity", "p.A", True)]
    assert {r["name"]: r["value"] for r in archives.resource_table(files.where("name = 'resources.arsc'")).collect()} == {"app_name": "My App", "limit": "42"}


def test_settings_round_trip():
    made = config.Settings(implicit=config.Implicit.ALL, categories=frozenset({"A", "B"}), stop_after=3, bounds=config.Bounds(call_stack=7), fanout={0: 2})
    assert config.Settings.from_xml(made.to_xml()) == made and config.Settings.from_xml(config.Settings().to_xml()) == config.Settings()


def test_model_calls_retry_and_fall_back(spark):
    def client():
        seen = {}

        def ask(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "bad" or prompt == "slow" and seen[prompt] < 3:
                raise TimeoutError("later")
            return "BOOLEAN_CONSTRAINT_START x > 1 BOOLEAN_CONSTRAINT_END"

        return ask

    prompts = spark.createDataFrame([("1", "good"), ("2", "slow"), ("3", "bad")], "id string, prompt string")
    answers = evaluation.asked(prompts, client, wait=0.0)
    assert {r["id"]: (r["success"], r["attempts"]) for r in answers.collect()} == {"1": (True, 1), "2": (True, 3), "3": (False, 3)}
    made = {r["id"]: (r["format1"], r["format2"], r["from_model"]) for r in evaluation.with_fallback(answers.withColumn("fallback", F.lit("[f]"))).collect()}
    assert made == {"1": ("x > 1", "x > 1", True), "2": ("x > 1", "x > 1", True), "3": ("[f]", "[f]", False)}
    assert not evaluation.asked(prompts, None).where("success").count()


def test_evaluation_of_answers(spark):
    texts = ['```json\n{"purpose_behavior": "p", "return_values": {"type": "int", "description": "d"}}\n```', "no json", '{"return_values": {"type": "x"}}']
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, r string").orderBy("i").select(evaluation.parsed_answer(F.col("r")).alias("a")).collect()
    assert rows[0]["a"][:] == ("p", "int", "d", None) and all(r["a"]["error"] for r in rows[1:])
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0], " Int", "int ")], "true_purpose array<double>, got_purpose array<double>, true_description array<double>, got_description array<double>, true_type string, got_type string")
    made = evaluation.similarity(row).first()
    assert (made["purpose"], made["return_type"], made["description"], made["good"]) == (1.0, 1.0, 0.0, True)
    methods = spark.createDataFrame([("a",), ("b",)], "sig string")
    left = evaluation.pending(methods, spark.createDataFrame([("m",), ("n",)], "model string"), spark.createDataFrame([("a", "m")], "sig string, model string"))
    assert {tuple(r) for r in left.collect()} == {("a", "n"), ("b", "m"), ("b", "n")}


def test_paths_respect_calls(spark):
    # two callers, 10 and 20, of one identity function; the sink is after the call at 20
    pred = [(1, 2, 21, None, None), (2, 3, 20, 20, True), (3, 4, 5, None, None), (4, 5, 10, 10, False), (4, 6, 20, 20, False)]
    pred = spark.createDataFrame(pred, "fact long, pred long, stmt long, call_site long, is_return boolean")
    ends = spark.createDataFrame([(99, 1)], "sink long, fact long")
    assert [(r["source"], r["path"]) for r in reconstruction.paths(pred, ends).collect()] == [(6, [20, 5, 20, 21])]
    assert {r["source"] for r in reconstruction.paths(pred, ends, context=False).collect()} == {5, 6}
    assert {r["source"] for r in reconstruction.sources(pred, ends).collect()} == {5, 6}


def test_definitions_match_through_the_hierarchy(spark):
    definitions = spark.createDataFrame([("<Base: int get()>", "return", None, "NET", True, False), ("<Sub: void put(int)>", "param", 0, "LOG", False, True)], "sig string, position string, param_index int, category string, is_source boolean, is_sink boolean")
    above = spark.createDataFrame([("Sub", "Base", 1)], "sub string, sup string, depth int")
    stmts = spark.createDataFrame([("m", 1, "<Sub: int get()>"), ("m", 2, "<Sub: void put(int)>"), ("m", 3, "<Other: int get()>")], "method string, stmt long, callee string")
    manager = plugins.ByDefinition(definitions, above)
    assert [(r["stmt"], r["category"]) for r in manager.sources(stmts).collect()] == [(1, "NET")]
    assert [(r["stmt"], r["category"]) for r in manager.sinks(stmts).collect()] == [(2, "LOG")]
    assert [r["category"] for r in plugins.by_category(definitions, config.CategoryMode.USE_ONLY_INCLUDED, {"LOG"}).collect()] == ["LOG"]
