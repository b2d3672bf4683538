"""The commands on a small folder."""

import json

import pytest

from tracequarry import cli


@pytest.fixture
def folder(tmp_path):
    ev = lambda k, **x: {"id": f"e{k}", "parent_id": f"e{k - 1}" if k else None, "seq": k, "ts": f"2025-01-01T00:00:0{k}Z", "actor": "user", "kind": "message", "payload": {"t": k}, **x}
    head = {"schema_version": "any.session/v1", "session_id": "s", "created_at": "2025-01-01T00:00:00Z"}
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in [head, ev(0), ev(1)]))
    (logs / "b.jsonl").write_text("".join(json.dumps(r) + "\n" for r in [head, ev(0), ev(1, parent_id="gone")]))
    return logs


def run(spark, capsys, *argv):
    code = cli.main(list(map(str, argv)), spark)
    out = capsys.readouterr().out
    return code, json.loads(out) if out.startswith(("{", "[")) else out


def test_check_and_diff(spark, capsys, folder):
    code, doc = run(spark, capsys, "check", folder, "--select", "SL0")
    assert code == 1 and doc["counts"]["by_code"]["SL004"] == 1 and doc["totals"] == {"healthy": 1, "invalid": 1}
    code, deltas = run(spark, capsys, "diff", folder / "a.jsonl", folder / "b.jsonl")
    assert {d["delta"] for d in deltas} == {"parent-relinked", "content-changed"} and code == 1


def test_plain_commands(spark, capsys):
    assert run(spark, capsys, "version")[1].strip() == cli.VERSION and "check" in run(spark, capsys, "completion")[1]


def test_hooks_never_raise(spark, folder):
    assert cli.hook(spark, "no json")["advice"] == "skip"
    assert cli.hook(spark, json.dumps({"path": str(folder / "b.jsonl")}))["advice"] == "look"


def test_configuration_fails_closed(tmp_path):
    (tmp_path / "c.json").write_text('{"profile": "strict", "odd": 1}')
    with pytest.raises(cli.ConfigError):
        cli.configure(str(tmp_path / "c.json"))
    assert cli.profile_of({"profile": "strict", "timestamp_skew_ms": 5}).skew_ms == 5
