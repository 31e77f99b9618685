import json

from lectern.sources import readers, sinks
from lectern.streaming import streams


def write(root, **files):
    for name, text in files.items():
        p = root / name.replace("__", "/").replace("_md", ".md").replace("_jsonl", ".jsonl").replace("_json", ".json")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")


def turns(df):
    return [(r["role"], r["text"]) for r in df.orderBy("pos").collect()]


def test_notes(spark, tmp_path):
    write(tmp_path, research__a_md="---\ntitle: Named\n---\n# H1\ntext [[b]]", b_md="# First\nx", c_md="plain")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "d.md").write_text("hidden")
    files = readers.markdown_files(spark, str(tmp_path))
    got = {r["path"]: r for r in readers.parse_notes(files).collect()}
    assert {p: r["title"] for p, r in got.items()} == {"research/a.md": "Named", "b.md": "First", "c.md": "c"}
    assert got["research/a.md"]["links"] == ["b"] and len(got["b.md"]["content_hash"]) == 16
    assert [r["path"] for r in readers.changed_files(spark, str(tmp_path), ["b.md", "x.txt"]).collect()] == ["b.md"]
    assert readers.changed_files(spark, str(tmp_path), []).count() == 0
    part = readers.read_range(files, "c.md", 1, 3).first()
    assert (part["content"], part["total"]) == ("lai", 5)


def test_transcript_shapes(spark, tmp_path):
    lines = [{"message": {"role": "user", "content": "hi"}}, "broken", "", {"type": "assistant", "message": {"content": [{"type": "text", "text": "a"}, {"type": "thinking", "thinking": "b"}, {"type": "tool_use", "name": "t", "input": {"x": 1}}]}}, {"message": {"role": "system", "content": "no"}}]
    write(tmp_path / "1", s_jsonl="\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    assert turns(readers.message_lines(spark, str(tmp_path / "1"))) == [("user", "hi"), ("assistant", 'a\nb\n[tool_use:t] {"x":1}')]
    write(tmp_path / "2", s_jsonl=json.dumps({"v": {"requests": [{"message": {"text": "q"}, "response": {"value": [{"value": "a1"}, {"value": "a2"}]}}, {"message": {"text": "q2"}}]}}))
    assert turns(readers.request_lines(spark, str(tmp_path / "2"))) == [("user", "q"), ("assistant", "a1"), ("assistant", "a2"), ("user", "q2")]
    write(tmp_path / "3", s_jsonl=json.dumps({"type": "response_item", "payload": {"role": "user", "content": [{"text": "x"}, {"text": "y"}]}}) + "\n" + json.dumps({"type": "session_meta"}))
    assert turns(readers.payload_lines(spark, str(tmp_path / "3"))) == [("user", "x y")]
    write(tmp_path / "4", s_md="ignored\n#### user\nhello\nthere\n#### Assistant\nanswer\n")
    assert turns(readers.headed_markdown(spark, str(tmp_path / "4"))) == [("user", "hello\nthere"), ("assistant", "answer")]
    write(tmp_path / "5", s_json=json.dumps({"messages": [{"type": "user", "content": "q"}, {"type": "info", "content": "z"}, {"type": "model", "content": [{"text": "t", "thought": True}, {"text": "a"}, "b"]}]}))
    both = readers.message_object(spark, str(tmp_path / "5"))
    assert turns(both) == [("user", "q"), ("assistant", "a b")]
    assert [r["session"] for r in readers.recent_sessions(both, 3).collect()] == ["s"]


def test_transcript_index(spark, tmp_path):
    rows = [{"type": "user", "uuid": "u1", "timestamp": "2024-01-02", "cwd": "", "message": {"role": "user", "content": "see ./a/b.md, /etc/x"}}, {"type": "user", "uuid": "u1", "timestamp": "2024-01-01", "cwd": "/srv", "message": {"role": "user", "content": "again"}}, {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "name": "grep", "input": {}}]}}]
    write(tmp_path, s_jsonl="\n".join(map(json.dumps, rows)))
    sessions, messages = readers.index_transcripts(spark, str(tmp_path))
    s = sessions.first()
    assert (s["project"], s["first_ts"], s["last_ts"]) == ("/srv", "2024-01-02", "2024-01-01")
    m = messages.orderBy("pos").collect()
    assert [r["content"] for r in m] == ["see ./a/b.md, /etc/x", "[tool_use:grep] {}"]
    assert m[0]["file_paths"] == ["./a/b.md", "/etc/x"] and m[1]["tool_name"] == "grep"


def test_labels(spark, tmp_path):
    (tmp_path / "l.yaml").write_text("queries:\n- query: q1\n  targets: [a, b]\n  category: pinpoint\n- query: q2\n  target: c\n- query: none\n")
    assert [(r["query"], r["targets"]) for r in readers.query_labels(spark, str(tmp_path / "l.yaml")).collect()] == [("q1", ["a", "b"]), ("q2", ["c"])]


def test_memory_files(spark, tmp_path):
    m = spark.sql("SELECT 1L AS memory_id, 'Title: x\\nbody' AS content, array('a') AS tags, 'bug' AS entity_type, '511bafd907296f583481ad62c220451b' AS uuid, timestamp_ntz'2024-05-01' AS created_at, CAST(NULL AS timestamp_ntz) AS expires_at")
    gone = m.selectExpr("2L AS memory_id", "content", "tags", "'context' AS entity_type", "uuid", "created_at", "expires_at")
    want = sinks.rendered(m.unionByName(gone))
    assert sinks.write_files(want, str(tmp_path)) == 1
    file = tmp_path / "memories/bug/2024-05/511bafd9-0729-6f58-3481-ad62c220451b.md"
    assert file.read_text().startswith('---\ntitle: "Title: x"\nuuid: 511bafd9-') and file.read_text().endswith("\n\nTitle: x\nbody\n")
    h = want.first()["hash"]
    disk = spark.createDataFrame([(want.first()["relpath"], h, h), ("old.md", "1", "1")], "relpath string, stated string, actual string")
    assert {r["relpath"]: r["action"] for r in sinks.sync_plan(want, disk).collect()} == {want.first()["relpath"]: "keep", "old.md": "remove"}
    edited = spark.createDataFrame([(want.first()["relpath"], h, "other")], "relpath string, stated string, actual string")
    assert sinks.sync_plan(want, edited).first()["action"] == "conflict"


def test_export_and_versions(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2)], "path string, n int")
    sinks.export_json(df, str(tmp_path / "out"))
    assert [r["path"] for r in spark.read.json(str(tmp_path / "out")).orderBy("path").collect()] == ["a", "b"]
    t = sinks.Versioned(spark, "t")
    t.write(df)
    assert t.write(t.read().where("n = 1")).count() == 1 and t.version == 2


def test_incremental_index_and_reconcile(spark):
    cur = spark.createDataFrame([("a", "1", "dormant", "2020"), ("b", "2", "active", "2021"), ("c", "3", "active", "2022")], "path string, content_hash string, status string, date_added string")
    new = spark.createDataFrame([("a", "9", "2024"), ("n", "5", "2024"), ("b", "2", "2024")], "path string, content_hash string, date_added string")
    got = {r["path"]: tuple(r)[1:] for r in streams.incremental_index(cur, new, spark.createDataFrame([("c",)], "path string")).collect()}
    assert got == {"a": ("9", "dormant", "2020"), "b": ("2", "active", "2021"), "n": ("5", "active", "2024")}
    disk = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r[0] for r in streams.reconcile(cur, disk).collect()] == ["c"]
    assert streams.reconcile(cur, disk.limit(0)).count() == 0
