import json

import pytest

from palimpsest.sources import config, events, files, tables, web


def write(tmp_path, name, text):
    at = tmp_path / name
    at.write_text(text, encoding="utf-8")
    return str(at)


def test_formats():
    assert [events.format_of(p) for p in ("a.JSON", "b.jsonl", "c.ndjson", "d.md")] == ["json", "jsonl", "jsonl", "txt"]


def test_paragraphs_and_lines(spark, tmp_path):
    at = write(tmp_path, "a.txt", "one\ntwo\n\n  \n three \r\n\r\nfour")
    good, bad = events.read_events(spark, at, base_ms=100)
    assert [(r.text, r.ts_ms, r.role) for r in good.orderBy("ordinal").collect()] == [("one\ntwo", 100, "user"), ("three", 101, "user"), ("four", 102, "user")]
    assert bad.count() == 0
    good, bad = events.read_events(spark, at, split="line", default_role="tool")
    assert [r.text for r in good.orderBy("ordinal").collect()] == ["one", "two", "three", "four"] and bad.count() == 3


def test_jsonl(spark, tmp_path):
    lines = ['{"body": "hi", "who": "ASSISTANT ", "at": 1700000000, "x": 1}', "not json", "", '{"body": ["a", " ", 3, "b"], "at": "2024-01-01T00:00:00Z"}', '{"other": 1}', '"just text"', "7"]
    good, bad = events.read_events(spark, write(tmp_path, "a.jsonl", "\n".join(lines)), text_field="body", role_field="who", time_field="at", base_ms=5)
    rows = good.orderBy("ordinal").collect()
    assert [(r.text, r.role, r.ts_ms) for r in rows] == [("hi", "assistant", 1700000000000), ("a\nb", "user", 1704067200000), ("just text", "user", 5 + rows[2].ordinal)]
    assert json.loads(rows[0].metadata) == {"x": 1} and rows[1].metadata is None
    assert sorted(r.reason for r in bad.collect()) == ["malformed", "no text", "unsupported"]
    assert [(r.records, r.skipped) for r in events.ingest_summary(good, bad).collect()] == [(3, 3)]


@pytest.mark.parametrize("root", ['[{0}]', '{{"rows": [{0}]}}', '{{"records": [{0}]}}', '{{"items": [{0}]}}'])
def test_json_roots(spark, tmp_path, root):
    items = '{"text": "a", "role": "alien", "k": {"n": [1]}}, {"message": " b ", "createdAt": "1700000000000.9"}'
    good, bad = events.read_events(spark, write(tmp_path, "a.json", root.format(items)))
    rows = good.orderBy("ordinal").collect()
    assert [(r.text, r.role) for r in rows] == [("a", "user"), ("b", "user")] and bad.count() == 0
    assert json.loads(rows[0].metadata) == {"k": {"n": [1]}} and rows[1].ts_ms == 1700000000000


def test_single_object_and_limit(spark, tmp_path):
    good, _ = events.read_events(spark, write(tmp_path, "a.json", '{"text": "a"}'))
    assert good.count() == 1
    good, _ = events.read_events(spark, write(tmp_path, "b.txt", "a\n\nb\n\nc"), limit=2)
    assert sorted(r.text for r in good.collect()) == ["a", "b"]


def test_html(spark):
    rows = [(1, "<title> A &amp; B</title><script>x</script><body class=q>Hi<br>there&nbsp;&lt;ok&gt;</body>"), (2, "no markup  at\nall"), (3, "<title></title><body></body>tail"), (4, None)]
    got = {r.id: r.t for r in spark.createDataFrame(rows, "id int, h string").select("id", web.html_text("h").alias("t")).collect()}
    assert tuple(got[1]) == ("A & B", "Hi there <ok>") and tuple(got[2]) == (None, "no markup at all")
    assert tuple(got[3]) == (None, "") and tuple(got[4]) == (None, "")


@pytest.mark.parametrize("wrap", ['{{"results": {0}}}', '{{"items": {0}}}', '{{"webPages": {{"value": {0}}}}}', '{{"data": {{"results": {0}}}}}', '{{"data": {{"webPages": {{"value": {0}}}}}}}'])
def test_search_shapes(spark, wrap):
    items = '[{"title": " T ", "url": "u1", "summary": "s"}, {"url": "", "title": "x"}, {"link": "u3"}, {"targetUrl": "u4", "heading": "H", "provider": "P"}]'
    df = spark.createDataFrame([(1, wrap.format(items)), (2, "broken"), (3, "[]")], "id int, p string")
    got = web.search_results(df, ["id"], "p").collect()
    assert sorted((r.id, r.title, r.url, r.snippet, r.source, r.rank) for r in got) == [(1, "H", "u4", "", "P", 4), (1, "T", "u1", "s", "search", 1)]


def test_files(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "dir").mkdir()
    write(tmp_path, "b.txt", "hello world")
    write(tmp_path, "a.txt", "x")
    assert [(r.name, r.kind) for r in files.listing(spark, root).collect()] == [("dir", "directory"), ("a.txt", "file"), ("b.txt", "file")]
    assert files.listing(spark, root, limit=0).count() == 1
    r = files.read_files(spark, root, "b.txt", max_bytes=5).first()
    assert (r.text, r.size, r.bytes_read, r.truncated) == ("hello", 11, 5, True)
    with pytest.raises(ValueError):
        files.confined(root, "../up")
    reads = files.read_files(spark, root, "*.txt")
    files.record_access(reads, f"{root}/out", 7)
    assert spark.read.parquet(f"{root}/out/vectors").count() == 2
    files.record_access(reads, f"{root}/none", sink="noop")
    files.write_text(spark.createDataFrame([("l1",), ("l2",)], "v string"), root, "w")
    assert spark.read.text(f"{root}/w").count() == 2
    with pytest.raises(ValueError):
        files.write_text(spark.createDataFrame([("l" * 99,)], "v string"), root, "w", max_bytes=9)
    files.write_csv(spark.createDataFrame([('a "q", b', 1)], "s string, n int"), f"{root}/csv")
    assert spark.read.option("escape", '"').csv(f"{root}/csv", header=True).first().s == 'a "q", b'
    files.write_json({"a": "ü"}, f"{root}/x/y.json")
    assert json.load(open(f"{root}/x/y.json", encoding="utf-8")) == {"a": "ü"}


def test_edge_store(spark):
    rows = [("a", "b", "T", 1, 0.4, 1), ("a", "b", "T", 2, 0.9, 2), ("", "b", "T", 3, None, 3), ("a", "", "T", 4, 0.1, 4)]
    e = tables.latest_edges(spark.createDataFrame(rows, "src string, dst string, type string, ts_ms bigint, confidence double, write_seq int")).drop("write_seq")
    assert sorted(map(tuple, e.collect()), key=str) == sorted([("a", "b", "T", 2, 0.9), ("", "b", "T", 3, None), ("a", "", "T", 4, 0.1)], key=str)
    assert [r.dst for r in tables.outgoing(e, "a").collect()] == ["", "b"] and tables.incoming(e, "b").count() == 2
    assert [r.ts_ms for r in tables.all_edges(e).collect()] == [2, 3, 4]
    bad = spark.createDataFrame([("a", "b", "T", 1, 0.4), ("a", "b", "T", 1, 0.9), ("a", "b", "", 1, 1.0), ("", "", "T", 1, 1.0), (None, "b", "T", 1, 1.0)], "src string, dst string, type string, ts_ms bigint, confidence double")
    assert [tuple(r) for r in tables.loaded_edges(bad).collect()] == [("a", "b", "T", 1, 0.9)]


def test_saved_tables(spark, tmp_path):
    at = str(tmp_path)
    assert tables.load(spark, at, "relations").count() == 0
    e = spark.createDataFrame([("a", "b", "T", 1, 0.5)], tables.SCHEMAS["relations"])
    tables.save(e, at, "relations")
    assert tables.load(spark, at, "relations").collect() == e.collect()
    ids = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "zz")], "ord int, block_id string")
    b = spark.createDataFrame([("a", 1), ("b", 2)], "block_id string, n int")
    assert [r.n for r in tables.get_many(b, ids).collect()] == [2, 1, 2]


def test_config(tmp_path):
    at = write(tmp_path, "c.toml", "final_top_k = 3\n[manager]\ngraph_weight = 0.5\nchunk_strategy = 'fixed'\nunknown = 1\n")
    c = config.load(at, env={"PALIMPSEST_FINAL_TOP_K": "4", "PALIMPSEST_PROACTIVE_SEAL_ENABLED": "no"}, semantic_top_k=9)
    assert (c.final_top_k, c.graph_weight, c.chunk_strategy, c.proactive_seal_enabled, c.semantic_top_k) == (4, 0.5, "fixed", False, 9)
    for bad in ({"chunk_strategy": "odd"}, {"final_top_k": -1}, {"keyword_weight": 1.5}, {"final_top_k": "x"}, {"nope": 1}):
        with pytest.raises(ValueError):
            config.load(env={}, **bad)
