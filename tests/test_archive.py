import json

from palaver.archive import Archive


def _lines(spark):
    say = lambda role, at, content: {"type": role, "sessionId": "s1", "timestamp": f"2026-03-0{at}T10:00:00Z", "message": {"role": role, "content": content}}
    one = [
        say("user", 1, "why does the migration fail with token=abcdefghijklmnop1234 <system-reminder>x</system-reminder>"),
        say("assistant", 2, [{"type": "text", "text": "zsh:1: command not found: timeout"}, {"type": "tool_use", "name": "Edit", "input": {"file_path": "/w/app/db.py", "old_string": "a"}}]),
        say("assistant", 3, [{"type": "tool_use", "name": "Bash", "input": {"command": "pip install timeout-decorator"}}]),
        say("user", 3, "the migrations in db.py work now"),
    ]
    two = [{"type": "user", "sessionId": "s2", "timestamp": "2026-03-05T10:00:00Z", "message": {"role": "user", "content": "about getUserName only"}}]
    rows = [("/c/projects/-w-app/a.jsonl", i, json.dumps(x)) for i, x in enumerate(one)] + [("/c/projects/-w-other/b.jsonl", i, json.dumps(x)) for i, x in enumerate(two + two)]
    return spark.createDataFrame(rows, "path string, n long, value string")


def test_an_archive_answers_what_is_asked(spark, tmp_path):
    a = Archive.build(spark, _lines(spark), str(tmp_path / "a"))
    assert {(x.session_id, x.messages, x.redacted) for x in a.sessions().collect()} == {("claude:s1", 6, 1), ("claude:s2", 1, 0)}
    hit = a.search("migration fail").collect()
    assert [(x.session_id, x.tier, x.total, x.capped) for x in hit] == [("claude:s1", "exact", 1, False)] and "[redacted:credential]" in hit[0].snippet
    assert [x.tier for x in a.search("migrating failed").collect()] == ["stemmed"]
    assert [x.session_id for x in a.search("user name").collect()] == ["claude:s2"]
    assert a.search("migration", harness="codex").count() == 0
    assert [x.session_id for x in a.last(1).collect()] == ["claude:s2"]
    assert [x.role for x in a.show("claude:s1", 1, 2).collect()] == ["assistant", "files"]
    assert [x.command for x in a.how("PIP", "install").collect()] == ["$ pip install timeout-decorator"]
    assert [x.session_id for x in a.blame("/w/app/db.py").collect()] == ["claude:s1"]
    assert [x.command for x in a.fix("command not found: timeout").collect()] == ["$ pip install timeout-decorator"]
    assert [x.session_id for x in a.error_hits("bash:7: command not found: timeout").collect()] == ["claude:s1"]
    assert [(x.sessions, x.messages) for x in a.overview().collect()] == [(2, 7)]
    assert "work now" in a.share("claude:s1").first().document
    b = a.forget(spark.createDataFrame([("project", "w/other")], "kind string, value string"), str(tmp_path / "b"))
    assert [x.session_id for x in b.sessions().collect()] == ["claude:s1"] and b.search("user name").count() == 0


def test_postings_are_read_by_bucket(spark, tmp_path):
    from palaver.operators.ladder import read_postings, write_postings

    m = spark.createDataFrame([("s", 0, "alpha beta", None)], "session_id string, seq long, text string, ts timestamp")
    write_postings(m, str(tmp_path / "p"))
    rows = read_postings(spark, str(tmp_path / "p"), ["alpha"])
    assert [(x.token, x.session_id, x.seq) for x in rows.collect()] == [("alpha", "s", 0)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(token" in plan or "EqualTo(token,alpha)" in plan
