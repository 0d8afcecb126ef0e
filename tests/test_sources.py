import json

from pyspark.sql import functions as F

from opsweave.operators import codegraph as G
from opsweave.operators import inventory as I
from opsweave.sources import readers as R
from opsweave.sources import sinks as S


def put(folder, name, text):
    p = folder / name
    p.write_text(text)
    return str(p)


def test_code_index(spark, tmp_path):
    doc = {
        "repo": "r", "files": 1,
        "entities": [{"kind": "function", "name": "f", "file": "a.py", "line": 1, "end_line": 3, "body": "go(1); if (x) hop()", "params": ["x"]}],
        "call_sites": [{"caller_file": "a.py", "caller_name": "f", "callee_name": "g"}],
    }
    entities, sites = R.code_index(spark, put(tmp_path, "i.json", json.dumps(doc, indent=1)))
    assert entities.first().params == ["x"] and sites.first().callee_name == "g"
    assert sorted(r.callee_name for r in G.call_sites(entities).collect()) == ["go", "hop"]


def test_audit_lines_skip_bad_ones(spark, tmp_path):
    text = '{"ts":"2024-01-02T00:00:00Z","tool":"Bash","action":"block","reason":"guard_rule","detail":"x"}\nnot json\n{"ts":"2023-01-01T00:00:00Z","tool":"Read","action":"allow"}\n'
    path = put(tmp_path, "a.jsonl", text)
    assert R.jsonl(spark, path, R.AUDIT).count() == 2
    assert [r.tool for r in R.jsonl(spark, path, R.AUDIT, since="2024-01-01").collect()] == ["Bash"]


def test_commit_log(spark, tmp_path):
    text = (
        "COMMIT_START\nh1\nAnn\na@x\n2024-01-01T10:00:00+00:00\nFirst #12\n\nM\tsrc/a.py\nA\tsrc/b c.py\n"
        "COMMIT_START\nh2\nBob\nb@x\n2024-01-02T10:00:00+00:00\nSecond\n\nR100\told.py\tnew.py\n"
    )
    commits, changes = R.commit_log(spark, put(tmp_path, "log.txt", text))
    got = {r.hash: r for r in commits.collect()}
    assert got["h1"].files_changed == 2 and got["h2"].author == "Bob" and got["h1"].message == "First #12"
    assert sorted((r.hash, r.change, r.path) for r in changes.collect() if r.change != "R") == [("h1", "A", "src/b c.py"), ("h1", "M", "src/a.py")]


def test_cluster_dump(spark, tmp_path):
    pod = {
        "metadata": {"name": "p", "namespace": "n", "resourceVersion": "7", "labels": {"b": "2", "a": "1"}, "ownerReferences": [{"kind": "ReplicaSet", "name": "web"}]},
        "spec": {"nodeName": "x", "containers": [{"name": "c", "image": "i:1", "envFrom": [{"secretRef": {"name": "s"}}]}], "volumes": [{"configMap": {"name": "cm"}}]},
        "status": {"phase": "Running", "containerStatuses": [{"restartCount": 2, "ready": False, "state": {"waiting": {"reason": "ErrImagePull"}}}]},
    }
    bare = {"metadata": {"name": "q", "namespace": "n"}, "spec": {"containers": []}, "status": {}}
    raw = R.cluster_pods(spark, put(tmp_path, "d.json", json.dumps({"items": [pod, bare]})))
    rows = {r.name: r for r in I.pods(raw).collect()}
    assert rows["p"].status == "ErrImagePull" and rows["p"].restart_count == 2 and not rows["p"].ready
    assert rows["q"].status == "Unknown" and rows["q"].ready and rows["q"].image == ""
    assert sorted((r.kind, r.target) for r in I.reads(raw).collect()) == [("ConfigMap", "cm"), ("Secret", "s")]


def test_exports(spark, tmp_path):
    chat = {"channel_id": "C", "channel_name": "ops", "messages": [{"ts": "1.5", "text": "hi", "user": "U"}, {"ts": "", "text": "no"}]}
    assert [r.ts for r in R.chat_export(spark, put(tmp_path, "c.json", json.dumps(chat))).collect()] == [1.5]
    ticket = {"key": "A-1", "fields": {"summary": "s", "status": {"name": "Done", "statusCategory": {"name": "x"}}, "parent": {"key": "A-0"}}}
    t = R.ticket_export(spark, put(tmp_path, "t.json", json.dumps(ticket))).first()
    assert (t.status, t.parent, t.assignee) == ("Done", "A-0", "")
    frames = [{"inApp": True, "function": "run", "filename": "a.py", "lineNo": 3}, {"inApp": False, "function": "lib"}]
    issue = {"id": "9", "title": "boom", "count": "12", "entries": [{"type": "breadcrumbs"}, {"type": "exception", "data": {"values": [{"type": "E", "value": "v", "stacktrace": {"frames": frames}}]}}]}
    issues, kept = R.issue_export(spark, put(tmp_path, "s.json", json.dumps(issue)))
    assert issues.first()["count"] == 12 and [r.function for r in kept.collect()] == ["run"]
    pr = {"number": 4, "title": "x", "state": "OPEN", "author": {"login": "me"}, "createdAt": "2024-01-01T00:00:00Z", "mergedAt": ""}
    p = R.pull_requests(spark, put(tmp_path, "p.json", json.dumps(pr)), "r").first()
    assert p.author == "me" and p.merged is None and p.created is not None
    path = {"timestamp": 5, "signal_dbm": -50, "path": [{"hop": "gateway", "latency_avg_ms": 1.0}, {"hop": "isp", "latency_avg_ms": 2.0}]}
    assert R.network_paths(spark, put(tmp_path, "n.jsonl", json.dumps(path))).count() == 2
    (tmp_path / "docs").mkdir()
    put(tmp_path / "docs", "a.md", "# A\ntext")
    assert R.documents(spark, str(tmp_path / "docs")).first().content == "# A\ntext"


def test_upsert_touches_its_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    merge = S.upsert_stream(spark, path, ["k"], keep_first=["first"], parts=4)
    cols = "k int, first int, n int"
    merge(spark.createDataFrame([(i, 10, 1) for i in range(40)], cols), 0)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").glob("part=*/*.parquet")}
    second = spark.createDataFrame([(1, 20, 5)], cols)
    merge(second, 1)
    merge(second, 1)  # a replayed batch
    got = sorted(map(tuple, spark.read.parquet(path).select("k", "first", "n").collect()))
    assert got == [(i, 10, 5 if i == 1 else 1) for i in range(40)]
    changed = {p.parent.name for p, t in files.items() if not p.exists() or p.stat().st_mtime_ns != t}
    assert len(changed) == 1


def test_append_and_export(spark, tmp_path):
    log = spark.createDataFrame([("2024-01-01 10:00:00", "Bash", "block")], "ts string, tool string, action string")
    S.append_audit(log, str(tmp_path / "audit"))
    S.append_audit(log, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    S.audit_export(log, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().tool == "Bash"
    rows = spark.range(950).select(
        F.col("id").alias("event_id"), F.col("id").cast("double").alias("t"), F.lit("d").alias("detail"), F.lit("T").alias("tool"),
        F.lit("allow").alias("action"), F.lit("x").alias("reason"),
    )
    b = S.export_batches(rows, 50)
    assert b.agg(F.max("batch")).first()[0] == 4 and S.next_offset(b, 50, 2) == 450 and S.next_offset(b, 50, None) == 950
