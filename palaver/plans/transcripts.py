"""Named queries that read small transcripts of each agent, and the messages that they must give."""

from __future__ import annotations

import json
import sqlite3

from pyspark.sql import functions as F

from ..sources import agents as A
from .cases import rows_sql

_NAMES = ["session_id", "project", "seq", "role", "text", "said_at"]


def _shown(df):
    return df.select("session_id", "project", "seq", "role", "text", F.date_format("ts", "MM-dd HH:mm:ss").alias("said_at"))


def _lines(s, path, values):
    rows = [(path, i, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)]
    return s.createDataFrame(rows, "path string, n long, value string")


def read(source, path, values, want):
    """A query that reads the lines of one file, and its messages: (session_id, project, seq, role, text, time)."""
    return lambda s, d: _shown(source(_lines(s, path, values))), rows_sql(_NAMES, want)


def whole(source, path, document, want):
    return lambda s, d: _shown(source(s.createDataFrame([(path, json.dumps(document))], "path string, value string"))), rows_sql(_NAMES, want)


def store(source, path, script, want):
    def query(s, d):
        db = sqlite3.connect(":memory:")
        db.executescript(script)
        return _shown(source(s.createDataFrame([(path, bytearray(db.serialize())), ("/other.db", bytearray(b"no database"))], "path string, content binary")))

    return query, rows_sql(_NAMES, want)


def _text(t, kind="text"):
    return {"type": kind, "text": t}


def _use(name, **given):
    return {"type": "tool_use", "name": name, "input": given}


_CLAUDE = [
    {"type": "summary", "summary": "x"},
    {"type": "user", "sessionId": "s1", "timestamp": "2026-03-01T10:00:00Z", "message": {"role": "user", "content": "fix the build"}},
    "{broken",
    {"type": "assistant", "sessionId": "s1", "timestamp": "2026-03-01T10:00:05.5Z", "message": {"content": [_text("looking"), _use("Read", file_path="/w/a.go"), _use("Bash", command="cd /w && go test ./..."), _use("Bash", command="ls"), _text("done")]}},
    {"type": "user", "sessionId": "s1", "timestamp": 1772359210, "message": {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "FAIL"}]}]}},
    {"type": "assistant", "sessionId": "s1", "timestamp": "2026-03-01T10:00:20Z", "message": {"content": [_use("MultiEdit", file_path="/w/a.go", edits=[{"old_string": "one"}, {"old_string": "two"}]), _use("Edit", file_path="/w/b.go", old_string="three")]}},
]
_SIDE = [{"type": "user", "sessionId": "main", "isSidechain": True, "agentId": "agent7", "timestamp": "2026-03-01T10:00:00Z", "message": {"content": "dig"}}]
_CODEX = [
    {"timestamp": "2026-04-09T07:14:05Z", "type": "session_meta", "payload": {"session_id": "cx", "cwd": "/tmp/trial"}},
    {"timestamp": "2026-04-09T07:14:06Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [_text("hello", "input_text")]}},
    {"timestamp": "2026-04-09T07:14:06Z", "type": "response_item", "payload": {"type": "message", "role": "developer", "content": [_text("rules")]}},
    {"timestamp": "2026-04-09T07:14:07Z", "type": "response_item", "payload": {"type": "function_call", "name": "exec_command", "call_id": "c1", "arguments": json.dumps({"cmd": "npm test"})}},
    {"timestamp": "2026-04-09T07:14:08Z", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": "Process exited with code 2\nOutput:\n1 failing\n"}},
    {"timestamp": "2026-04-09T07:14:09Z", "type": "response_item", "payload": {"type": "custom_tool_call", "name": "apply_patch", "input": "*** Begin Patch\n*** Update File: src/a.py\n@@\n-old line\n+new line\n*** Add File: /abs/b.py\n+x\n*** End Patch"}},
    {"timestamp": "2026-04-09T07:14:10Z", "type": "event_msg", "payload": {"type": "agent_message", "message": "repeated"}},
    {"timestamp": "2026-04-09T07:14:11Z", "type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [_text("fixed", "output_text")]}},
]
_GEMINI = [
    {"sessionId": "g1", "startTime": "2026-04-17T08:20:00Z"},
    {"id": "m0", "timestamp": "2026-04-17T08:20:01Z", "type": "user", "content": "dropped by the set"},
    {"$set": {"messages": [{"id": "m1", "timestamp": "2026-04-17T08:20:02Z", "type": "user", "content": [{"text": "kept"}]}, {"id": "m2", "timestamp": "2026-04-17T08:20:03Z", "type": "gemini", "content": "first answer"}]}},
    {"$rewindTo": "m2"},
    {"id": "m3", "timestamp": "2026-04-17T08:20:04Z", "type": "gemini", "content": [{"text": "second answer"}]},
    {"id": "m4", "timestamp": "2026-04-17T08:20:05Z", "type": "info", "content": "no speech"},
]
_GROK = [
    {"timestamp": 1772359200, "params": {"update": {"sessionUpdate": "user_message_chunk", "content": _text("why"), "_meta": {"promptIndex": 0}}}},
    {"timestamp": 1772359201, "params": {"update": {"sessionUpdate": "agent_message_chunk", "content": _text("because ")}, "_meta": {"promptId": "p"}}},
    {"timestamp": 1772359202, "params": {"update": {"sessionUpdate": "tool_call", "title": "read a", "kind": "read"}}},
    {"timestamp": 1772359203, "params": {"update": {"sessionUpdate": "agent_message_chunk", "content": _text("of it")}, "_meta": {"promptId": "p"}}},
    {"timestamp": 1772359204, "params": {"update": {"sessionUpdate": "agent_message_chunk", "content": _text("alone")}}},
    {"timestamp": 1772359205, "params": {"update": {"sessionUpdate": "agent_message_chunk", "content": _text("alone too")}}},
]
_KIMI = [
    {"type": "metadata", "created_at": 1772359200000},
    {"type": "context.append_message", "message": {"role": "user", "content": [_text("why?")]}, "time": 1772359201000},
    *({"type": "context.append_loop_event", "event": e, "time": 1772359202000 + 1000 * i} for i, e in enumerate([{"type": "step.begin"}, {"type": "content.part", "part": {"type": "think", "text": "hm"}}, {"type": "content.part", "part": _text("it is ")}, {"type": "content.part", "part": _text("stale")}, {"type": "tool.call", "name": "Shell", "args": {"command": "make test"}}, {"type": "tool.result", "result": {"output": " ok "}}, {"type": "content.part", "part": _text("done")}, {"type": "step.end"}])),
]
_COPILOT = [
    {"type": "session.start", "timestamp": "2026-05-11T06:31:54Z", "data": {"sessionId": "cp", "context": {"cwd": "/home/me/code/gate"}}},
    {"type": "user.message", "timestamp": "2026-05-11T06:31:58Z", "data": {"content": "why"}},
    {"type": "tool.execution_start", "timestamp": "2026-05-11T06:31:59Z", "data": {"toolName": "bash", "arguments": {"command": "cargo build"}}},
    {"type": "tool.execution_complete", "timestamp": "2026-05-11T06:32:00Z", "data": {"result": {"content": "built"}}},
    {"type": "assistant.message", "timestamp": "2026-05-11T06:32:01Z", "data": {"content": "so"}},
    {"type": "session.shutdown", "timestamp": "2026-05-11T06:32:02Z", "data": {}},
]
_DEEPSEEK = [
    {"type": "session", "id": "session-d1", "createdAt": 1772359200000, "cwd": "/work/lab"},
    {"type": "user/message", "time": 1772359201000, "data": {"content": [_text("how many")], "source": {"kind": "user"}}},
    {"type": "user/message", "time": 1772359201000, "data": {"content": [_text("context")], "source": {"kind": "plugin"}}},
    {"type": "assistant/chunk", "time": 1772359202000, "data": {"chunk": {"type": "text-delta", "text": "let me "}}},
    {"type": "text-chunks", "time0": 1772359203000, "data": {"texts": ["check ", "it"]}},
    {"type": "step/end", "time": 1772359204000},
    {"type": "assistant/chunk", "time": 1772359205000, "data": {"chunk": {"type": "text-delta", "text": "replaced"}}},
    {"type": "assistant/message", "time": 1772359206000, "data": {"message": {"content": [{"type": "reasoning", "text": "no"}, _text("ten")]}}},
]
_AIDER = ["# aider chat started at 2026-03-01 10:00:00", "", "#### add a test", "#### please", "Sure.", "```", "# aider chat started at 2020-01-01 00:00:00", "#### code", "```", "# aider chat started at 2026-03-02 11:00:00", "#### again", "Done."]
_ANTIGRAVITY = [
    {"source": "USER_EXPLICIT", "created_at": "2026-03-01T10:00:00Z", "content": "<USER_REQUEST>\nfix it\n</USER_REQUEST>\n<ADDITIONAL_METADATA>x</ADDITIONAL_METADATA>"},
    {"source": "SYSTEM", "created_at": "2026-03-01T10:00:01Z", "content": "no"},
    {"source": "MODEL", "type": "PLANNER_RESPONSE", "created_at": "2026-03-01T10:00:02Z", "content": "a plan"},
    {"source": "MODEL", "type": "RUN_COMMAND", "created_at": "2026-03-01T10:00:03Z", "content": "Created At: 1\nTask Description: go test ./x\nok"},
]
_NOTES = [
    {"ts": "2026-03-01T23:30:00Z", "project": "app", "text": "late note"},
    {"ts": "2026-03-02T00:30:00Z", "project": "app", "text": "next day in UTC, same day here"},
    {"ts": "2026-03-03T00:00:00Z", "kind": "promoted", "session": "claude:s1", "project": "app", "title": "T", "text": "older", "state": "accepted"},
    {"ts": "2026-03-04T00:00:00Z", "kind": "promoted", "session": "claude:s1", "project": "app", "title": "T", "text": "newer", "state": "rejected"},
]
_OPENCODE = """create table session(id, directory, title, time_created); create table message(id, session_id, data, time_created); create table part(id, message_id, session_id, data);
insert into session values('oc', '/w/app', 'T', 1); insert into message values('m1', 'oc', '{"role":"user"}', 1772359200000), ('m2', 'oc', '{"role":"assistant"}', 1772359201000);
insert into part values('p1', 'm1', 'oc', '{"type":"text","text":"hi"}'), ('p2', 'm2', 'oc', '{"type":"tool","tool":"bash","state":{"input":{"command":"npm test"},"output":"bad","metadata":{"exit":1}}}'),
('p3', 'm2', 'oc', '{"type":"tool","tool":"edit","state":{"input":{"filePath":"/w/a.ts","oldString":"x = 1"}}}'), ('p4', 'm2', 'oc', '{"type":"text","text":"done"}');"""
_HERMES = """create table messages(id integer, session_id, role, content, timestamp real);
insert into messages values(2, 'h1', 'assistant', 'hello', 1772359201.5), (1, 'h1', 'user', 'hi', 1772359200.0), (3, 'h1', 'tool', 'x', 1772359202.0), (4, 'h1', 'user', '', 1772359203.0);"""
_GOOSE_DB = """create table sessions(id, working_dir, description); create table messages(id integer, session_id, role, content_json, created_timestamp integer);
insert into sessions values('gs', '/w/demo', 'A title'); insert into messages values(1, 'gs', 'user', '[{"type":"text","text":"say"}]', 1772359200), (2, 'gs', 'assistant', '[{"type":"text","text":"said"}]', 1772359201);"""
_CURSOR_DB = """create table cursorDiskKV(key text, value blob);
insert into cursorDiskKV values('composerData:c1', '{"name":"T","createdAt":1772359200000}'), ('bubbleId:c1:b2', '{"type":2,"text":"answer","createdAt":"2026-03-01T10:00:05Z"}'), ('bubbleId:c1:b1', '{"type":1,"text":"question"}'), ('other', 'x');"""
_ZED_DB = """create table threads(id, summary, updated_at, data_type, data blob);
insert into threads values('z1', 'T', '2026-03-01T10:00:00Z', 'json', '{"messages":[{"User":{"content":[{"Text":"ask"}]}},{"Agent":{"content":[{"Thinking":{"text":"hm"}},{"Text":"tell"}]}}]}');"""


def _offsets(s, d):
    lines = _lines(s, "/a.jsonl", ["abc", "é", "", "{}"])
    marks = s.createDataFrame([("/a.jsonl", 4)], "path string, offset long")
    return A.from_offset(lines, marks).select("n", "value")


def _zstd(s, d):
    import zstandard

    db = sqlite3.connect(":memory:")
    db.execute("create table threads(id, summary, updated_at, data_type, data blob)")
    db.execute("insert into threads values('z2', 'T', '2026-03-01T10:00:00Z', 'zstd', ?)", (zstandard.ZstdCompressor().compress(json.dumps({"messages": [{"User": {"content": [{"Text": "packed"}]}}]}).encode()),))
    return _shown(A.zed(s.createDataFrame([("/z.db", bytearray(db.serialize()))], "path string, content binary")))


def _archive(s, d):
    files = [("/c/projects/-w-app/s1.jsonl", _CLAUDE[:2]), ("/x/sessions/rollout-1.jsonl", _CODEX[:2]), ("/g/gemini/x.jsonl", _GEMINI[:2]), ("/q/qwen/projects/-w-app/chats/q.jsonl", [{"type": "user", "sessionId": "q1", "timestamp": "2026-03-01T10:00:00Z", "message": {"role": "user", "parts": [{"text": "qwen"}]}}])]
    rows = None
    for path, values in files:
        rows = _lines(s, path, values) if rows is None else rows.unionByName(_lines(s, path, values))
    return A.archive(rows).select("harness", "session_id", "seq", "role", "text")


ALL = {
    "s01_archive": (_archive, rows_sql(["harness", "session_id", "seq", "role", "text"], [("claude", "s1", 0, "user", "fix the build"), ("codex", "cx", 0, "user", "hello"), ("gemini", "g1", 0, "user", "dropped by the set"), ("qwen", "q1", 0, "user", "qwen")])),
    "s02_from_offset": (_offsets, rows_sql(["n", "value"], [(1, "é"), (2, ""), (3, "{}")])),
    "s02_malformed": (lambda s, d: A.malformed(_lines(s, "/a", [*_CLAUDE, " ", "[1"])), rows_sql(["path", "malformed"], [("/a", 2)])),
    "s03_claude": read(A.claude, "/c/projects/-w-my-app/file.jsonl", _CLAUDE, [
        ("s1", "my/app", 0, "user", "fix the build", "03-01 10:00:00"), ("s1", "my/app", 1, "assistant", "looking\ndone", "03-01 10:00:05"), ("s1", "my/app", 2, "files", "/w/a.go", "03-01 10:00:05"), ("s1", "my/app", 3, "command", "$ cd /w && go test ./...", "03-01 10:00:05"),
        ("s1", "my/app", 4, "tool-output", "FAIL", "03-01 10:00:10"), ("s1", "my/app", 5, "files", "/w/a.go\n/w/b.go", "03-01 10:00:20"), ("s1", "my/app", 6, "edit", "/w/a.go\none", "03-01 10:00:20"), ("s1", "my/app", 7, "edit", "/w/a.go\ntwo", "03-01 10:00:20"), ("s1", "my/app", 8, "edit", "/w/b.go\nthree", "03-01 10:00:20"),
    ]),
    "s03_sidechain": (lambda s, d: A.claude(_lines(s, "/c/projects/p/x.jsonl", _SIDE)).select("session_id", "parent", "text"), rows_sql(["session_id", "parent", "text"], [("agent7", "main", "dig")])),
    "s04_codex": read(A.codex, "/x/rollout-2026.jsonl", _CODEX, [
        ("cx", "trial", 0, "user", "hello", "04-09 07:14:06"), ("cx", "trial", 1, "command", "$ npm test  → exit 2", "04-09 07:14:07"), ("cx", "trial", 2, "tool-output", "1 failing", "04-09 07:14:08"),
        ("cx", "trial", 3, "files", "/tmp/trial/src/a.py\n/abs/b.py", "04-09 07:14:09"), ("cx", "trial", 4, "edit", "/tmp/trial/src/a.py\nold line", "04-09 07:14:09"), ("cx", "trial", 5, "assistant", "fixed", "04-09 07:14:11"),
    ]),
    "s04_codex_events": read(A.codex, "/x/rollout-1.jsonl", [_CODEX[0], _CODEX[6]], [("cx", "trial", 0, "assistant", "repeated", "04-09 07:14:10")]),
    "s04_history": read(A.codex_history, "/x/history.jsonl", [{"session_id": "a", "ts": 1772359200, "text": "one"}, {"session_id": "b", "ts": 1772359201, "text": "two"}, {"session_id": "a", "ts": 1772359202, "text": "three"}, {"session_id": "", "text": "x"}], [("a", "history", 0, "user", "one", "03-01 10:00:00"), ("b", "history", 0, "user", "two", "03-01 10:00:01"), ("a", "history", 1, "user", "three", "03-01 10:00:02")]),
    "s05_opencode": store(A.opencode, "/oc.db", _OPENCODE, [("oc", "app", 0, "user", "hi", "03-01 10:00:00"), ("oc", "app", 1, "command", "$ npm test  → exit 1", "03-01 10:00:01"), ("oc", "app", 2, "tool-output", "bad", "03-01 10:00:01"), ("oc", "app", 3, "files", "/w/a.ts", "03-01 10:00:01"), ("oc", "app", 4, "edit", "/w/a.ts\nx = 1", "03-01 10:00:01"), ("oc", "app", 5, "assistant", "done", "03-01 10:00:01")]),
    "s06_aider": read(A.aider, "/w/app/.aider.chat.history.md", _AIDER, [
        ("/w/app/.aider.chat.history.md#20260301-100000", "app", 0, "user", "add a test\nplease", "03-01 10:00:00"), ("/w/app/.aider.chat.history.md#20260301-100000", "app", 1, "assistant", "Sure.\n```\n# aider chat started at 2020-01-01 00:00:00\ncode\n```", "03-01 10:00:00"),
        ("/w/app/.aider.chat.history.md#20260302-110000", "app", 0, "user", "again", "03-02 11:00:00"), ("/w/app/.aider.chat.history.md#20260302-110000", "app", 1, "assistant", "Done.", "03-02 11:00:00"),
    ]),
    "s07_gemini": read(A.gemini, "/g/gemini/s.jsonl", _GEMINI, [("g1", "-", 0, "user", "kept", "04-17 08:20:02"), ("g1", "-", 1, "assistant", "second answer", "04-17 08:20:04")]),
    "s08_cursor_store": store(A.cursor_store, "/state.vscdb", _CURSOR_DB, [("c1", "-", 0, "user", "question", "03-01 10:00:00"), ("c1", "-", 1, "assistant", "answer", "03-01 10:00:05")]),
    "s08_cursor_transcript": read(A.cursor_transcript, "/p/agent-transcripts/cur.jsonl", [{"role": "user", "message": {"content": [_text("q")]}}, {"role": "assistant", "message": {"content": [_text("a")]}}, {"type": "turn_ended"}], [("cur", "-", 0, "user", "q", None), ("cur", "-", 1, "assistant", "a", None)]),
    "s09_antigravity": read(A.antigravity, "/r/brain/ag1/.system_generated/logs/transcript.jsonl", _ANTIGRAVITY, [("ag1", "-", 0, "user", "fix it", "03-01 10:00:00"), ("ag1", "-", 1, "assistant", "a plan", "03-01 10:00:02"), ("ag1", "-", 2, "command", "$ go test ./x", "03-01 10:00:03"), ("ag1", "-", 3, "tool-output", "Task Description: go test ./x\nok", "03-01 10:00:03")]),
    "s10_grok": read(A.grok, "/r/gk/updates.jsonl", _GROK, [("updates", "-", 0, "user", "why", "03-01 10:00:00"), ("updates", "-", 1, "assistant", "because of it", "03-01 10:00:01"), ("updates", "-", 2, "tool-output", "read: read a", "03-01 10:00:02"), ("updates", "-", 3, "assistant", "alone", "03-01 10:00:04"), ("updates", "-", 4, "assistant", "alone too", "03-01 10:00:05")]),
    "s11_hermes": store(A.hermes, "/h/profiles/architect/hermes.db", _HERMES, [("h1", "architect", 0, "user", "hi", "03-01 10:00:00"), ("h1", "architect", 1, "assistant", "hello", "03-01 10:00:01")]),
    "s12_goose": read(A.goose, "/g/goose/long_1.jsonl", [{"description": " A title ", "id": "g9", "working_dir": "/w/demo"}, {"id": "m", "role": "user", "created": 1772359200, "content": [_text("say")]}, {"role": "tool", "content": "x"}, {"role": "assistant", "created": 1772359201, "content": [_text("said")]}], [("g9", "demo", 0, "user", "say", "03-01 10:00:00"), ("g9", "demo", 1, "assistant", "said", "03-01 10:00:01")]),
    "s12_goose_store": store(A.goose_store, "/s.db", _GOOSE_DB, [("gs", "demo", 0, "user", "say", "03-01 10:00:00"), ("gs", "demo", 1, "assistant", "said", "03-01 10:00:01")]),
    "s13_qwen": read(A.qwen, "/q/projects/-w-app/chats/q.jsonl", [{"type": "user", "sessionId": "q1", "timestamp": "2026-03-01T10:00:00Z", "message": {"role": "user", "parts": [{"text": "a"}, {"text": "b"}]}}, {"type": "assistant", "sessionId": "q1", "timestamp": "2026-03-01T10:00:01Z", "message": {"role": "model", "parts": [{"text": "c"}]}}, {"type": "system"}], [("q1", "w/app", 0, "user", "a\nb", "03-01 10:00:00"), ("q1", "w/app", 1, "assistant", "c", "03-01 10:00:01")]),
    "s14_kimi": read(A.kimi, "/k/sess1/agents/main/wire.jsonl", _KIMI, [("sess1", "-", 0, "user", "why?", "03-01 10:00:01"), ("sess1", "-", 1, "assistant", "it is stale", "03-01 10:00:04"), ("sess1", "-", 2, "command", "$ make test", "03-01 10:00:06"), ("sess1", "-", 3, "tool-output", "ok", "03-01 10:00:07"), ("sess1", "-", 4, "assistant", "done", "03-01 10:00:08")]),
    "s15_cline": whole(A.cline, "/c/sx/sx.messages.json", {"agent": "lead", "sessionId": "cl", "messages": [{"role": "user", "content": [_text("Say")], "ts": 1772359200000}, {"role": "assistant", "content": [_text("Said"), _text("hidden", "thinking")], "ts": 1772359201000}]}, [("cl", "-", 0, "user", "Say", "03-01 10:00:00"), ("cl", "-", 1, "assistant", "Said", "03-01 10:00:01")]),
    "s16_roo": whole(A.cline, "/r/tasks/177/api_conversation_history.json", [{"role": "user", "content": [_text("<task>\nFix it\n</task>")]}, {"role": "assistant", "content": "Fixed."}], [("177", "-", 0, "user", "Fix it", None), ("177", "-", 1, "assistant", "Fixed.", None)]),
    "s17_pi": read(A.pi, "/pi/x.jsonl", [{"type": "session", "id": "pi1", "timestamp": "2026-03-01T10:00:00Z", "cwd": "/w/demo", "title": "T"}, {"type": "message", "timestamp": "2026-03-01T10:00:05Z", "message": {"role": "user", "content": [_text("q")], "timestamp": 1772359205000}}, {"type": "message", "timestamp": "2026-03-01T10:00:06Z", "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "x"}, _text("a")]}}], [("pi1", "demo", 0, "user", "q", "03-01 10:00:05"), ("pi1", "demo", 1, "assistant", "a", "03-01 10:00:06")]),
    "s18_copilot": read(A.copilot, "/c/x/events.jsonl", _COPILOT, [("cp", "code/gate", 0, "user", "why", "05-11 06:31:58"), ("cp", "code/gate", 1, "command", "$ cargo build", "05-11 06:31:59"), ("cp", "code/gate", 2, "tool-output", "built", "05-11 06:32:00"), ("cp", "code/gate", 3, "assistant", "so", "05-11 06:32:01")]),
    "s19_deepseek": read(A.deepseek, "/d/session.jsonl", _DEEPSEEK, [("d1", "lab", 0, "user", "how many", "03-01 10:00:01"), ("d1", "lab", 1, "assistant", "let me check it", "03-01 10:00:03"), ("d1", "lab", 2, "assistant", "ten", "03-01 10:00:06")]),
    "s20_zed": store(A.zed, "/z.db", _ZED_DB, [("z1", "-", 0, "user", "ask", "03-01 10:00:00"), ("z1", "-", 1, "assistant", "tell", "03-01 10:00:00")]),
    "s20_zed_packed": (_zstd, rows_sql(_NAMES, [("z2", "-", 0, "user", "packed", "03-01 10:00:00")])),
    "s21_notes": read(lambda x: A.notes(x, "America/New_York"), "/n/notes.jsonl", _NOTES, [("note-2026-03-01-app", "app", 0, "user", "late note", "03-01 23:30:00"), ("note-2026-03-01-app", "app", 1, "user", "next day in UTC, same day here", "03-02 00:30:00"), ("note-claude-s1", "app", 0, "user", "[rejected] newer", "03-04 00:00:00"), ("note-claude-s1", "app", 1, "user", "[accepted] older", "03-03 00:00:00")]),
    "s27b_settings": (lambda s, d: s.createDataFrame([('{"a": "x // y", // c\n "b": [1, 2,], /* d */}',)], "v string").select(F.get_json_object(A.without_comments(F.col("v")), "$.a").alias("a"), F.get_json_object(A.without_comments(F.col("v")), "$.b[1]").alias("b")), rows_sql(["a", "b"], [("x // y", "2")])),
}
