"""The readers and the runner on small logs of each format."""

import json
import sqlite3

import pytest

from tracequarry import api
from tracequarry.functions import canonical as c
from tracequarry.plans import runner
from tracequarry.sources import files, formats, sinks

T0 = "2025-01-01T12:00:0{}Z"


def chat(tmp):
    rows = [
        {"id": "m1", "type": "user_message", "message": "go", "timestamp": T0.format(0)},
        {"id": "m2", "parentId": "m1", "type": "tool_use", "name": "read_file", "toolUseId": "t1", "input": {}, "timestamp": T0.format(1)},
        {"id": "m3", "parentId": "m2", "type": "tool_result", "toolUseId": "t1", "content": "x", "timestamp": T0.format(2)},
        {"id": "m4", "parentId": "gone", "type": "tool_result", "toolUseId": "t9", "content": "y", "timestamp": T0.format(3)},
        {"uuid": "m5", "parentUuid": "m3", "type": "assistant", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "t2", "name": "bash", "input": {}}]}, "timestamp": T0.format(4)},
        {"uuid": "m6", "parentUuid": "m5", "type": "mystery", "text": "hm", "timestamp": T0.format(5)},
    ]
    (tmp / "chat.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\n{"id":"m7","id":"m8","type":"user_mes')


def rollout(tmp):
    env = lambda k, t, p: {"ordinal": k, "type": t, "timestamp": T0.format(k % 10), "payload": p}
    rows = [
        env(0, "session_meta", {"session_id": "s-1", "cli_version": "1", "subagent_history_start_ordinal": 99}),
        env(1, "response_item", {"type": "message", "role": "user", "id": "r1", "content": []}),
        env(2, "response_item", {"type": "function_call", "name": "sh", "call_id": "c1", "id": "r2"}),
        env(3, "response_item", {"type": "function_call_output", "call_id": "c1", "id": "r3", "output": "ok"}),
        env(4, "token_usage_record", {"usage": {"input_tokens": 5}, "thread_token_usage": {"input_tokens": 5}}),
        env(5, "token_usage_record", {"usage": {"input_tokens": 5}, "thread_token_usage": {"input_tokens": 11}}),
        env(7, "event_msg", {"info": {"last_token_usage": {"input_tokens": 95}, "model_context_window": 100}}),
        env(8, "compacted", {"guardian_history": [{"id": "r1", "type": "function_call"}], "parent_session_id": "nobody"}),
    ]
    (tmp / "rollout-x.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))


def agents(tmp, name="agents.json", checkpoints=({"id": "p1", "seq": 1, "hash": "h"}, {"id": "p2", "seq": 3, "hash": "i"})):
    items = [
        {"id": "a1", "type": "message", "role": "user", "content": "hi", "timestamp": T0.format(0)},
        {"id": "a2", "prev_id": "a1", "type": "tool_call", "name": "get", "call_id": "k", "args": "{\"q\": 1}", "timestamp": T0.format(1)},
        {"id": "a3", "prev_id": "a2", "type": "tool_result", "call_id": "k", "content": "r", "timestamp": T0.format(2)},
        {"id": "a4", "prev_id": "a3", "type": "tool_result", "call_id": "k", "content": "r", "timestamp": T0.format(3)},
    ]
    (tmp / name).write_text(json.dumps({"items": items, "run_state": {"x": 1}, "checkpoints": list(checkpoints)}))


def own(tmp):
    head = {"schema_version": "any.session/v1", "session_id": "s-2", "created_at": T0.format(0)}
    ev = lambda k, **x: {"id": f"e{k}", "parent_id": f"e{k - 1}" if k else None, "seq": k, "ts": T0.format(k), "actor": "user", "kind": "message", "payload": {"t": k}, **x}
    rows = [head, ev(0), ev(1), ev(2, kind="tool_call", correlation_id="z"), ev(3, kind="tool_result", correlation_id="z", actor="tool")]
    (tmp / "own.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))


@pytest.fixture(scope="module")
def got(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("logs")
    for f in (chat, rollout, agents, own):
        f(tmp)
    agents(tmp, "calls.json", ())
    (tmp / "bad.jsonl").write_bytes(b"\xff\xfe{}\n{}\n")
    (tmp / "notes.json").write_text("[1, 2]")
    return api.scan(spark, str(tmp)), str(tmp)


def codes(result, name):
    return sorted(r.code for r in result["findings"].where(f"session like '%{name}'").collect())


def test_formats_are_told_apart(tmp_path):
    for f, name, fmt in ((chat, "chat.jsonl", "claude-code-jsonl"), (rollout, "rollout-x.jsonl", "codex-rollout"), (agents, "agents.json", "openai-agents"), (own, "own.jsonl", "canonical")):
        f(tmp_path)
        assert formats.detect((tmp_path / name).read_bytes(), name)[0] == fmt
    assert formats.detect(formats.SQLITE, "x.db")[0] is None


def test_findings_of_each_format(got):
    result, _ = got
    assert codes(result, "own.jsonl") == []
    found = codes(result, "chat.jsonl")
    assert {"SL002", "SL004", "SL101", "SL102", "SL302", "SL006"} <= set(found)
    found = codes(result, "rollout-x.jsonl")
    assert {"SL204", "SL206", "SL207", "SL208", "SL401"} <= set(found) and "SL101" not in found
    found = codes(result, "agents.json")
    assert "SL104" in found and "SL201" in found
    assert codes(result, "bad.jsonl") == ["SL001"]


def test_verdicts_and_rollups(got):
    result, _ = got
    v = {r.session.rsplit("/", 1)[-1]: r.verdict for r in result["verdicts"].collect()}
    assert v["own.jsonl"] == "healthy" and v["agents.json"] == "invalid" and v["bad.jsonl"] == "unreadable" and v["notes.json"] == "unsupported"
    assert sum(r.n for r in result["totals"].collect()) == 7
    states = {(r.session.rsplit("/", 1)[-1], r.state) for r in result["coverage"].where("code = 'SL101'").collect()}
    assert ("own.jsonl", "performed") in states and ("bad.jsonl", "empty-input") in states


def test_reports(got, tmp_path):
    result, _ = got
    doc = sinks.report(result["findings"], result["verdicts"])
    assert doc["counts"]["total"] == len(doc["findings"]) == sum(doc["counts"]["by_code"].values())
    assert json.loads(sinks.to_sarif(doc))["runs"][0]["results"] and "<table>" in sinks.to_html(doc) and "findings" in sinks.to_text(doc)
    sinks.write_atomic(str(tmp_path / "r.json"), sinks.to_json(doc))
    with pytest.raises(FileExistsError):
        sinks.write_atomic(str(tmp_path / "r.json"), "", overwrite=False)
    assert json.loads((tmp_path / "r.json").read_text())["counts"] == doc["counts"]


def test_repair_and_verify(spark, got, tmp_path):
    _, path = got
    done = api.repair(spark, path)
    fixed = done["events"]
    names = lambda f: {r.id for r in fixed.where(f"session like '%{f}'").select("id").collect()}
    assert "a4" not in names("calls.json") and "a4" in names("agents.json")  # the latter has an unsafe continuation
    assert all(api.verify(spark, path, fixed, done["manifest"]).values())
    sinks.export_events(fixed, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == fixed.count()


def test_rule_selection():
    p = runner.NEUTRAL.select(["SL1"], ["SL104"])
    assert "SL101" in p.enabled and "SL104" not in p.enabled and "SL004" not in p.enabled


@pytest.mark.parametrize("tail,want", [(b'{"a":1,"b', True), (b'{"a": tr', True), (b'{"a":1}', False), (b'{"a":1]', False), (b"[1,", False), (b'{"a":\xc3', True), (b'{"a":"\xff', False), (b'{"a":1\0', False), (b"", False), (b'{"a":"x\\', True), (b'{"a" "b"', False)])
def test_torn_tails(tail, want):
    assert c.torn(tail) is want


def test_every_prefix_of_an_object_is_torn():
    text = json.dumps({"a": [1, {"b": "x\\né"}, None, True, -1.5e3], "c": "é€"}, ensure_ascii=False).encode()
    assert all(c.torn(text[:k]) for k in range(1, len(text)))


def test_small_functions():
    assert c.canonical_json({"b": 1.0, "a": "é"}) == '{"a":"é","b":1.0}'
    assert c.sha256({"a": 1}) != c.sha256({"a": 1.0})
    assert c.timestamp_ms("2025-02-30T00:00:00Z") is None and c.timestamp_ms("1970-01-01T00:00:01Z") == 1000
    assert c.depth([[{}]]) == 3
    assert c.decode('{"a":1,"a":{"b":1,"b":2}}')[1] == {"a": 2, "a.b": 2}
    assert c.side_effects("Bash") == "possible" and c.side_effects("ls") == "none" and c.side_effects("x") == "unknown"


def test_indexes_and_state(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"entries": [{"sessionId": "a"}, {"sessionId": "b"}]}))
    (tmp_path / "j.jsonl").write_text('{"id":"a"}\n{"id":"b"')
    df, state = files.read_index(spark, str(tmp_path / "i.json"))
    assert (df.count(), state) == (2, "complete") and files.read_index(spark, str(tmp_path / "j.jsonl"))[1] == "truncated"
    db = str(tmp_path / "s.sqlite")
    with sqlite3.connect(db) as con:
        con.execute("create table threads (id text, rollout_path text)")
        con.execute("insert into threads values ('t', 'p')")
    got = files.read_state(spark, db)
    assert got["threads"].count() == 1 and got["thread_spawn_edges"].count() == 0


def test_snapshot_shapes(spark, tmp_path):
    (tmp_path / "s.csv").write_text("k,a,b\n1,x\n2,,z\n")
    (tmp_path / "t.json").write_text(json.dumps({"observed_at": "2025-01-02 00:00:00", "completeness": "complete", "records": [{"r": 1, "s": " OK "}, {"r": 2, "s": None, "n": {}}]}))
    s, _ = files.read_snapshot(spark, str(tmp_path / "s.csv"))
    rows = {r.k.text: r for r in s.collect()}
    assert rows["1"].b is None and rows["2"].a.text == ""
    contract = {"source_key": ["k"], "target_key": ["r"], "conditions": [{"id": "there", "type": "exists"}, {"id": "ok", "type": "one_of", "field": "s", "values": ["ok"], "normalize": ["trim", "casefold"]}]}
    got = api.verify_outcome(spark, contract, str(tmp_path / "s.csv"), str(tmp_path / "t.json"))
    cond = {(r["item"], r.condition): r.status for r in got["conditions"].collect()}
    assert cond["1", "ok"] == "VERIFIED" and cond["2", "ok"] == "NOT_APPLICABLE" and got["outcome"].first().outcome == "VERIFIED"


def test_reconcile_preview_and_bytes(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    own(logs)
    agents(logs, "calls.json", ())
    (tmp_path / "i.json").write_text(json.dumps({"entries": [{"sessionId": "s-9"}]}))
    got = {(r.divergence, r.key) for r in api.reconcile(spark, str(logs), str(tmp_path / "i.json")).collect()}
    assert got == {("file-not-in-index", "s-2"), ("index-entry-no-file", "s-9")}
    deltas = {(r.delta, r.id) for r in api.preview(spark, str(logs)).collect()}
    assert deltas == {("removed", "a4")}
    one = api.check_bytes(spark, "own.jsonl", (logs / "own.jsonl").read_bytes())
    assert one["findings"].isEmpty() and one["verdicts"].first().verdict == "healthy"
    assert api.session_roots(spark, str(logs)).first().files == 2
    assert api.ambiguous(api.load(spark, str(logs))["events"]).isEmpty()
