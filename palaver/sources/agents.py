"""Transcripts of coding agents as one table: path, session_id, project, title, parent, seq, role, text, ts.

A source is a projection of the lines (or whole documents) of its files: each gives a list of records, which keep their order
within their file. What a line says of its session (id, folder, title) is gathered by file and joined back. Malformed lines
give nothing and are counted by ``malformed``. Everything but opening SQLite files stays in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import is_telling, stripped
from ..functions.scalars import base_name, decoded_project, lenient_time, project_name

_BLOCKS = "array<struct<type string, text string, content string, name string, input string>>"
_RECORD = "array<struct<role string, text string, ts timestamp>>"
EDIT_BYTES = 32 * 1024


@dataclass(frozen=True)
class Dialect:
    """What an agent calls its tools and their arguments."""

    paths: tuple[str, ...] = ("Read", "Edit", "Write", "MultiEdit", "NotebookEdit")
    path: str = "file_path"
    edits: tuple[str, ...] = ()
    old: str = "old_string"
    shell: str = "Bash"
    command: str = "command"


CLAUDE, KIMI, COPILOT = Dialect(), Dialect(paths=("ReadFile", "WriteFile", "StrReplaceFile"), path="path", old="old", shell="Shell"), Dialect(paths=("view", "edit", "create"), path="path", old="old_str", shell="bash")


def _at(path: str, value: str | Column = "value") -> Column:
    return F.get_json_object(value, path)


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def _inner(content: Column) -> Column:
    """A string, or the texts of a list of blocks."""
    blocks = F.from_json(content, "array<struct<text string>>")
    return F.when(content.startswith("[") & blocks.isNotNull(), F.array_join(F.filter(F.transform(blocks, lambda b: b["text"]), lambda t: t != ""), "\n")).otherwise(content)


def _said(block: Column) -> Column:
    return F.coalesce(_filled(block["text"]), _filled(_inner(block["content"])))


def content(raw: Column) -> tuple[Column, Column]:
    """The text of polymorphic content, and whether it holds results of tools alone."""
    blocks = F.when(raw.startswith("["), F.from_json(raw, _BLOCKS))
    text = F.array_join(F.filter(F.transform(blocks, _said), lambda t: t.isNotNull()), "\n")
    tools = F.exists(blocks, lambda b: b["type"] == "tool_result") & ~F.exists(blocks, lambda b: (F.coalesce(b["type"], F.lit("")) != "tool_result") & _said(b).isNotNull())
    return F.when(blocks.isNull(), raw).otherwise(text), F.coalesce(tools, F.lit(False))


def _record(role: Column | str, text: Column, ts: Column) -> Column:
    """A list of one record, or of none if there is no text."""
    role = F.lit(role) if isinstance(role, str) else role
    one = F.array(F.struct(role.alias("role"), text.alias("text"), ts.alias("ts")))
    return F.when(F.coalesce(text, F.lit("")) != "", one).otherwise(F.array().cast(_RECORD))


def _records(role: str, texts: Column, ts: Column) -> Column:
    return F.coalesce(F.transform(texts, lambda t: F.struct(F.lit(role).alias("role"), t.alias("text"), ts.alias("ts"))), F.array().cast(_RECORD))


def work(uses: Column, ts: Column, d: Dialect = CLAUDE) -> Column:
    """Of uses of tools (name, input) a record of their files, of each replaced span and of each telling command."""
    arg = lambda u, key: _at(f"$.{key}", u["input"])
    one_path = lambda u: _filled(arg(u, d.path))
    named = F.filter(uses, lambda u: u["name"].isin(*d.paths))
    files = F.array_join(F.array_distinct(F.filter(F.transform(named, one_path), lambda p: p.isNotNull())), "\n")
    editing = F.filter(uses, lambda u: one_path(u).isNotNull() & (u["name"].isin(*d.edits) if d.edits else F.lit(True)))
    olds = lambda u: F.concat(F.array(arg(u, d.old)), F.coalesce(F.transform(F.from_json(_at("$.edits", u["input"]), f"array<struct<{d.old} string>>"), lambda e: e[d.old]), F.array().cast("array<string>")))
    spans = F.flatten(F.transform(editing, lambda u: F.transform(F.filter(olds(u), lambda o: o != ""), lambda o: F.concat(one_path(u), F.lit("\n"), F.left(o, F.lit(EDIT_BYTES))))))
    commands = F.filter(F.transform(F.filter(uses, lambda u: u["name"] == d.shell), lambda u: arg(u, d.command)), lambda c: c.isNotNull() & is_telling(c))
    return F.concat(_record("files", files, ts), _records("edit", spans, ts), _records("command", F.transform(commands, lambda c: F.concat(F.lit("$ "), c)), ts))


def _tool_uses(raw: Column) -> Column:
    blocks = F.coalesce(F.when(raw.startswith("["), F.from_json(raw, _BLOCKS)), F.array().cast(_BLOCKS))
    return F.filter(blocks, lambda b: b["type"] == "tool_use")


def _assembled(rows: DataFrame, stem: str = r"\.jsonl?$") -> DataFrame:
    """Sessions and their messages of rows (path, n, records, and some of id, project, title, parent), one session a file.

    Of several ids, folders and titles in a file the last one counts. Files without messages give none.
    """
    known = [c for c in ("id", "project", "title", "parent") if c in rows.columns]
    head = rows.groupBy("path").agg(F.count("*").alias("rows"), *(F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", F.col("n"))).alias(c) for c in known)).drop("rows")
    for c in ("id", "project", "title", "parent"):
        if c not in known:
            head = head.withColumn(c, F.lit(None).cast("string"))
    body = rows.select("path", "n", F.posexplode("records").alias("pos", "r"))
    seq = F.row_number().over(Window.partitionBy("path").orderBy("n", "pos")) - 1
    body = body.select("path", seq.cast("long").alias("seq"), "r.role", "r.text", "r.ts")
    name = F.regexp_replace(base_name(F.col("path")), stem, "")
    return body.join(head, "path").select("path", F.coalesce("id", name).alias("session_id"), F.coalesce("project", F.lit("-")).alias("project"), "title", "parent", "seq", "role", "text", "ts")


def from_offset(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Lines (path, n, value) that begin at or after the byte that marks (path, offset) name; files without a mark are whole."""
    begin = F.coalesce(F.sum(F.octet_length("value") + 1).over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("begin", begin).join(marks, "path", "left").where("begin >= coalesce(offset, 0)").select("path", "n", "value")


def malformed(lines: DataFrame) -> DataFrame:
    """How many lines of each file aren't JSON; blank lines don't count."""
    return lines.where("trim(value) != '' and try_parse_json(value) is null").groupBy("path").agg(F.count("*").alias("malformed"))


def claude(lines: DataFrame) -> DataFrame:
    """Turns of users and assistants; a side chain has its agent's id and its session as parent; work records follow their turn."""
    raw, ts = _at("$.message.content"), lenient_time(_at("$.timestamp"))
    text, tools = content(raw)
    side = (_at("$.isSidechain") == "true") & (F.coalesce(_at("$.agentId"), F.lit("")) != "")
    role = F.when(tools, F.lit("tool-output")).otherwise(F.coalesce(_filled(_at("$.message.role")), _at("$.type")))
    rows = lines.where(_at("$.type").isin("user", "assistant")).select("path", "n", F.when(side, _at("$.agentId")).otherwise(_at("$.sessionId")).alias("id"), F.when(side, _at("$.sessionId")).alias("parent"), F.concat(_record(role, text, ts), work(_tool_uses(raw), ts)).alias("records"))
    folder = decoded_project(F.regexp_replace("path", r"/[^/]*$", ""))
    return _assembled(rows.withColumn("project", folder))


def codex(lines: DataFrame) -> DataFrame:
    """Rollouts. Commands carry how they ended if they failed; patches give their files and what they take out."""
    ts, kind = lenient_time(_at("$.timestamp")), F.coalesce(_at("$.payload.type"), F.lit(""))
    meta, role = _at("$.type") == "session_meta", _at("$.payload.role")
    text = F.coalesce(_filled(content(_at("$.payload.content"))[0]), _at("$.payload.message"))
    role = F.coalesce(_filled(role), F.when(_at("$.payload.message").isNotNull(), F.when(kind == "agent_message", "assistant").otherwise("user")))
    command, out = _at("$.cmd", _at("$.payload.arguments")), _at("$.payload.output")
    call = _at("$.payload.call_id")
    code = F.regexp_extract(out, r"(?m)^(?:Process exited with code|Exit code:) (\d+)", 1)
    rows = lines.withColumn("call", call).withColumn("code", F.when(kind.endswith("call_output") & (code != "") & (code != "0"), code))
    ended = F.max("code").over(Window.partitionBy("path", "call"))
    rows = rows.withColumn("ended", F.when(F.col("call").isNotNull(), ended))
    patch = F.when(_at("$.payload.name") == "apply_patch", _at("$.payload.input"))
    parts = F.split(patch, r"(?m)^\*\*\* (?=(?:Update|Add|Delete) File: )")
    parts = F.filter(parts, lambda p: p.rlike(r"^(?:Update|Add|Delete) File: "))
    name = lambda p: F.trim(F.regexp_extract(p, r"^\w+ File: (.+)", 1))
    cwd = F.last(F.when(meta, _at("$.payload.cwd")), ignorenulls=True).over(Window.partitionBy("path").orderBy("n"))
    rows = rows.withColumn("cwd", cwd)
    full = lambda p: F.when(name(p).startswith("/") | F.col("cwd").isNull(), name(p)).otherwise(F.concat_ws("/", "cwd", name(p)))
    gone = lambda p: F.array_join(F.transform(F.filter(F.split(p, "\n"), lambda x: x.startswith("-")), lambda x: F.substring(x, 2, F.lit(1 << 20))), "\n")
    shown = stripped(F.when(F.instr(out, "\nOutput:\n") > 0, F.substring(out, F.instr(out, "\nOutput:\n") + 9, F.lit(1 << 30))).otherwise(out))
    spans = F.transform(F.filter(parts, lambda p: gone(p) != ""), lambda p: F.concat(full(p), F.lit("\n"), F.left(gone(p), F.lit(EDIT_BYTES))))
    none = F.array().cast(_RECORD)
    records = (
        F.when(meta | role.isin("developer", "system"), none)
        .when(kind == "function_call", F.when((_at("$.payload.name") == "exec_command") & is_telling(command), _record("command", F.concat(F.lit("$ "), command, F.coalesce(F.concat(F.lit("  → exit "), F.col("ended")), F.lit(""))), ts)).otherwise(none))
        .when(kind.isin("function_call_output", "custom_tool_call_output"), _record("tool-output", shown, ts))
        .when(kind == "custom_tool_call", F.concat(_record("files", F.array_join(F.array_distinct(F.transform(parts, full)), "\n"), ts), _records("edit", spans, ts)))
        .otherwise(_record(role, text, ts))
    )
    # events repeat what items say: they count only in files without items
    event = _at("$.type") == "event_msg"
    rows = rows.select("path", "n", F.when(meta, F.coalesce(_at("$.payload.id"), _at("$.payload.session_id"))).alias("id"), F.when(meta & _at("$.payload.cwd").isNotNull(), project_name(_at("$.payload.cwd"))).alias("project"), event.alias("event"), F.coalesce(records, none).alias("records"))
    items = F.sum(F.when(~F.coalesce("event", F.lit(False)), F.size("records")).otherwise(0)).over(Window.partitionBy("path"))
    return _assembled(rows.withColumn("items", items).withColumn("records", F.when(F.coalesce("event", F.lit(False)) & (F.col("items") > 0), none).otherwise(F.col("records"))).drop("items"), r"\.jsonl$")


def codex_history(lines: DataFrame) -> DataFrame:
    """What was asked, by session, many sessions a file."""
    rows = lines.select("path", "n", _at("$.session_id").alias("session_id"), _at("$.text").alias("text"), lenient_time(_at("$.ts")).alias("ts")).where("session_id != '' and text != ''")
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("path", "n")) - 1
    return rows.select("path", "session_id", F.lit("history").alias("project"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("parent"), seq.cast("long").alias("seq"), F.lit("user").alias("role"), "text", "ts")


_GEMINI = "array<struct<id string, timestamp string, type string, content string>>"


def gemini(lines: DataFrame) -> DataFrame:
    """An ordered fold of a file's events: messages append, a set replaces them all, a rewind drops those from an id on."""
    one = F.from_json("value", _GEMINI[6:-1])
    event = F.struct(
        F.col("n"), F.coalesce(F.from_json(_at("$['$set'].messages"), _GEMINI), F.array().cast(_GEMINI)).alias("set"), _at("$['$set'].messages").isNotNull().alias("sets"), _at("$['$rewindTo']").alias("to"),
        F.when((one["type"] != "") & _at("$['$set']").isNull(), F.array(one)).otherwise(F.array().cast(_GEMINI)).alias("new"),
    )

    def step(now, e):
        at = F.array_position(F.transform(now, lambda m: m["id"]), e["to"])
        keep = F.filter(e["set"], lambda m: F.coalesce(m["type"], F.lit("")) != "")
        return F.when(e["sets"] & ((F.size(keep) > 0) | (F.size(e["set"]) == 0)), keep).when(e["to"].isNotNull() & (at > 0), F.slice(now, F.lit(1), (at - 1).cast("int"))).otherwise(F.concat(now, e["new"]))

    files = lines.groupBy("path").agg(F.min_by(_at("$.sessionId"), F.when(_at("$.sessionId").isNotNull(), F.col("n"))).alias("id"), F.array_sort(F.collect_list(event)).alias("events"))
    folded = files.where("id is not null").select("path", "id", F.aggregate("events", F.array().cast(_GEMINI), step).alias("messages"))
    role = lambda m: F.when(m["type"] == "user", "user").when(m["type"] == "gemini", "assistant")
    records = F.transform(F.filter("messages", lambda m: m["type"].isin("user", "gemini") & (content(m["content"])[0] != "")), lambda m: F.struct(role(m).alias("role"), content(m["content"])[0].alias("text"), lenient_time(m["timestamp"]).alias("ts")))
    return _assembled(folded.select("path", F.lit(0).alias("n"), "id", records.alias("records")))


def antigravity(lines: DataFrame) -> DataFrame:
    """What a person said and what the model answered; its steps are commands, files and outputs."""
    ts, source, kind = lenient_time(_at("$.created_at")), _at("$.source"), F.coalesce(_at("$.type"), F.lit(""))
    text = stripped(_at("$.content"))
    asked = stripped(F.regexp_replace(F.regexp_replace(text, r"(?s)<ADDITIONAL_METADATA>.*?</ADDITIONAL_METADATA>", ""), r"</?USER_REQUEST>", ""))
    field = lambda label: F.regexp_extract(text, rf"(?m)^\s*\Q{label}\E\s*(.*?)\s*$", 1)
    path = F.regexp_extract(text, r"(?m)^\s*(?:File Path:|Created file|Edited file|Modified file)\s*`?file://([^ `\n]+)", 1)
    body = stripped(F.regexp_replace(text, r"^(?:\s*(?:Created At:|Completed At:)[^\n]*(?:\n|$))+", ""))
    command = F.when(kind.isin("RUN_COMMAND", "GENERIC") & is_telling(field("Task Description:")), F.concat(F.lit("$ "), field("Task Description:")))
    step = F.concat(_record("command", command, ts), _record("files", F.when(kind.isin("VIEW_FILE", "CODE_ACTION", "LIST_DIRECTORY"), path), ts), _record("tool-output", body, ts))
    records = F.when(source == "USER_EXPLICIT", _record("user", asked, ts)).when(source == "MODEL", F.when(kind.isin("", "PLANNER_RESPONSE"), _record("assistant", text, ts)).otherwise(step))
    return _assembled(lines.select("path", "n", F.get(F.slice(F.reverse(F.split("path", "/")), 4, 1), F.lit(0)).alias("id"), F.coalesce(records, F.array().cast(_RECORD)).alias("records")))


def _joined(rows: DataFrame, glue: str = "") -> DataFrame:
    """Consecutive speech of one island as one message, at the place and time of its first part. rows: path, n, role, text, ts, island (null: alone)."""
    key = F.coalesce(F.concat(F.lit("i"), F.col("island").cast("string")), F.concat(F.lit("n"), F.col("n").cast("string")))
    parts = F.array_sort(F.collect_list(F.struct("n", "text")))
    own = rows.groupBy("path", key.alias("key")).agg(F.min("n").alias("n"), F.min_by("role", "n").alias("role"), F.min_by("ts", "n").alias("ts"), F.array_join(F.transform(parts, lambda p: p["text"]), glue).alias("text"))
    return own.select("path", "n", _record(F.col("role"), F.col("text"), F.col("ts")).alias("records"))


def grok(lines: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Streamed chunks; speech of the same role and prompt as the speech before it goes on with it, whatever tools did between.

    summaries: path, id, cwd, title, parent of each file.
    """
    kind, ts = _at("$.params.update.sessionUpdate"), lenient_time(_at("$.timestamp"))
    role = F.when(kind == "user_message_chunk", "user").when(kind == "agent_message_chunk", "assistant").when(kind.isin("tool_call", "tool_call_update"), "tool-output")
    title = F.concat_ws(": ", _filled(_at("$.params.update.kind")), _filled(_at("$.params.update.title")))
    body = F.coalesce(_filled(_at("$.params.update.content.text")), _filled(_inner(_at("$.params.update.content"))))
    text = F.when(role == "tool-output", F.coalesce(F.when(~F.coalesce(body, F.lit("")).rlike(r"^[{\[]"), body), title)).otherwise(body)
    prompt = F.when(role == "assistant", _at("$.params.update._meta.promptId")).when(role == "user", _at("$.params.update._meta.promptIndex"))
    prompt = F.coalesce(F.when(role == "assistant", _at("$.params._meta.promptId")), prompt)
    rows = lines.select("path", "n", role.alias("role"), text.alias("text"), ts.alias("ts"), F.concat_ws(":", role, prompt).alias("key"), prompt.isNotNull().alias("keyed")).where("role is not null and text != ''")
    speech, tools = rows.where("role != 'tool-output'"), rows.where("role = 'tool-output'")
    by = Window.partitionBy("path").orderBy("n")
    new = F.when(F.col("keyed") & (F.lag("key").over(by) == F.col("key")) & F.lag("keyed").over(by), 0).otherwise(1)
    speech = speech.withColumn("new", new).withColumn("island", F.sum("new").over(by))
    out = _joined(speech).unionByName(tools.select("path", "n", _record(F.col("role"), F.col("text"), F.col("ts")).alias("records")))
    if summaries is not None:
        out = out.join(summaries.select("path", "id", project_name(F.col("cwd")).alias("project"), "title", "parent"), "path", "left")
    return _assembled(out)


def goose(lines: DataFrame) -> DataFrame:
    """The line without a role is the header."""
    role, raw = _at("$.role"), _at("$.content")
    ts = F.coalesce(lenient_time(_at("$.created")), lenient_time(_at("$.timestamp")))
    header = role.isNull()
    rows = lines.where("try_parse_json(value) is not null").select("path", "n", F.when(header, _at("$.id")).alias("id"), F.when(header, F.trim(_at("$.description"))).alias("title"), F.when(header & _at("$.working_dir").isNotNull(), project_name(_at("$.working_dir"))).alias("project"), F.when(role.isin("user", "assistant"), _record(role, content(raw)[0], ts)).otherwise(F.array().cast(_RECORD)).alias("records"))
    return _assembled(rows)


def qwen(lines: DataFrame) -> DataFrame:
    """Messages of parts; the model is the assistant."""
    role = F.when(_at("$.message.role") == "model", "assistant").when(_at("$.message.role") == "user", "user").otherwise(_at("$.type"))
    rows = lines.where(_at("$.type").isin("user", "assistant"))
    return _assembled(rows.select("path", "n", _at("$.sessionId").alias("id"), decoded_project(F.regexp_extract("path", r"projects/([^/]+)/", 1)).alias("project"), _record(role, content(_at("$.message.parts"))[0], lenient_time(_at("$.timestamp"))).alias("records")))


def kimi(lines: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Whole messages, and parts of text that go on until a step begins or ends, a message of the assistant, a tool's work or result."""
    ts, kind, event = lenient_time(_at("$.time")), _at("$.type"), _at("$.event.type")
    role, loop = _at("$.message.role"), _at("$.type") == "context.append_loop_event"
    part = loop & (event == "content.part") & (_at("$.event.part.type") == "text")
    use = F.array(F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("content"), _at("$.event.name").alias("name"), _at("$.event.args").alias("input")))
    whole = F.when((kind == "context.append_message") & role.isin("user", "assistant"), _record(role, stripped(content(_at("$.message.content"))[0]), ts)).when(loop & (event == "tool.call"), work(use, ts, KIMI)).when(loop & (event == "tool.result"), _record("tool-output", stripped(_at("$.event.result.output")), ts))
    rows = lines.select("path", "n", part.alias("part"), _at("$.event.part.text").alias("text"), ts.alias("ts"), F.coalesce(whole, F.array().cast(_RECORD)).alias("records"), F.coalesce(((kind == "context.append_message") & (role == "assistant")) | (loop & event.isin("step.begin", "step.end")), F.lit(False)).alias("flush"))
    ends = F.col("flush") | (~F.coalesce("part", F.lit(False)) & (F.size(F.filter("records", lambda r: r["role"] != "user")) > 0))
    rows = rows.withColumn("island", F.sum(ends.cast("int")).over(Window.partitionBy("path").orderBy("n")))
    spoken = _joined(rows.where("part and text != ''").select("path", "n", F.lit("assistant").alias("role"), "text", "ts", "island"))
    out = spoken.unionByName(rows.where("not coalesce(part, false)").select("path", "n", "records"))
    name = F.get(F.slice(F.reverse(F.split("path", "/")), 4, 1), F.lit(0))
    out = out.withColumn("records", F.transform("records", lambda r: r.withField("text", stripped(r["text"])))).withColumn("id", name)
    if states is not None:
        out = out.join(states.select("path", project_name(F.col("workDir")).alias("project"), "title"), "path", "left")
    return _assembled(out)


def cline(documents: DataFrame) -> DataFrame:
    """Whole documents (path, value): a list of messages, or an object that holds one; tasks lose their wrapping."""
    schema = "array<struct<role string, content string, ts string>>"
    messages = F.from_json(F.coalesce(_at("$.messages"), F.col("value")), schema)
    lead = F.coalesce(_at("$.agent"), F.lit("lead")).isin("", "lead")
    spoken = lambda m: F.array_join(F.transform(F.filter(F.from_json(m["content"], _BLOCKS), lambda b: (F.coalesce(b["type"], F.lit("text")) == "text") & (b["text"] != "")), lambda b: b["text"]), "\n")
    text = lambda m: stripped(F.regexp_replace(F.when(m["content"].startswith("["), spoken(m)).otherwise(m["content"]), r"(?s)^\s*<task>\s*(.*?)\s*</task>", "$1"))
    records = F.transform(F.filter(messages, lambda m: m["role"].isin("user", "assistant") & (text(m) != "")), lambda m: F.struct(m["role"].alias("role"), text(m).alias("text"), lenient_time(m["ts"]).alias("ts")))
    folder = F.get(F.slice(F.reverse(F.split("path", "/")), 2, 1), F.lit(0))
    return _assembled(documents.where(lead).select("path", F.lit(0).alias("n"), F.coalesce(_at("$.sessionId"), folder).alias("id"), F.coalesce(records, F.array().cast(_RECORD)).alias("records")))


def pi(lines: DataFrame) -> DataFrame:
    """A session line, and message lines whose own time comes before the line's; checkpoints are no sessions."""
    raw = _at("$.message.content")
    blocks = F.when(raw.startswith("["), F.from_json(raw, _BLOCKS))
    text = F.when(blocks.isNull(), raw).otherwise(F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (b["text"] != "")), lambda b: b["text"]), "\n"))
    ts, session = F.coalesce(lenient_time(_at("$.message.timestamp")), lenient_time(_at("$.timestamp"))), _at("$.type") == "session"
    role = _at("$.message.role")
    rows = lines.where(~F.col("path").contains("checkpoint")).select("path", "n", F.when(session, _at("$.id")).alias("id"), F.when(session, _at("$.title")).alias("title"), F.when(session & _at("$.cwd").isNotNull(), project_name(_at("$.cwd"))).alias("project"), F.when((_at("$.type") == "message") & role.isin("user", "assistant"), _record(role, text, ts)).otherwise(F.array().cast(_RECORD)).alias("records"))
    return _assembled(rows)


def copilot(lines: DataFrame) -> DataFrame:
    """The start gives id and folder; messages, uses of tools and their results follow."""
    kind, ts = _at("$.type"), lenient_time(_at("$.timestamp"))
    start, cwd = kind == "session.start", F.regexp_replace(_at("$.data.context.cwd"), r"[/\\]+$", "")
    use = F.array(F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("content"), _at("$.data.toolName").alias("name"), _at("$.data.arguments").alias("input")))
    records = (
        F.when(kind.isin("user.message", "assistant.message"), _record(F.regexp_replace(kind, r"\.message$", ""), _at("$.data.content"), ts))
        .when(kind == "tool.execution_start", work(use, ts, COPILOT))
        .when(kind == "tool.execution_complete", _record("tool-output", stripped(_at("$.data.result.content")), ts))
    )
    parts = F.filter(F.split(cwd, r"[/\\]"), lambda p: p != "")
    rows = lines.select("path", "n", F.when(start, _at("$.data.sessionId")).alias("id"), F.when(start, F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")).alias("project"), F.coalesce(records, F.array().cast(_RECORD)).alias("records"))
    return _assembled(rows)


def deepseek(lines: DataFrame) -> DataFrame:
    """What the user said, whole answers, and streamed ones where no whole answer follows before their step ends."""
    kind = _at("$.type")
    spoken = lambda p: stripped(F.array_join(F.transform(F.filter(F.from_json(_at(p), _BLOCKS), lambda b: (F.coalesce(b["type"], F.lit("text")) == "text") & (b["text"] != "")), lambda b: b["text"]), "\n"))
    ts = lenient_time(F.coalesce(_at("$.time"), _at("$.time0")))
    user = (kind == "user/message") & (_at("$.data.source.kind") == "user")
    delta = F.when((kind == "assistant/chunk") & (_at("$.data.chunk.type") == "text-delta"), _at("$.data.chunk.text")).when(kind == "text-chunks", F.array_join(F.from_json(_at("$.data.texts"), "array<string>"), ""))
    whole = F.when(user, _record("user", spoken("$.data.content"), ts)).when(kind == "assistant/message", _record("assistant", spoken("$.data.message.content"), ts)).when(kind == "tool/result", _record("tool-output", spoken("$.data.message.content"), ts))
    ends = user | kind.isin("assistant/message", "step/end", "turn/end", "tool/result")
    by = Window.partitionBy("path").orderBy("n")
    session = kind == "session"
    rows = lines.select("path", "n", kind.alias("kind"), delta.alias("text"), ts.alias("ts"), F.coalesce(whole, F.array().cast(_RECORD)).alias("records"), F.coalesce(ends, F.lit(False)).alias("ends"), F.when(session, F.regexp_replace(_at("$.id"), "^session-", "")).alias("id"), F.when(session & _at("$.cwd").isNotNull(), project_name(_at("$.cwd"))).alias("project"), F.when(kind == "session/title", _at("$.data.title")).alias("title"))
    rows = rows.withColumn("island", F.sum(F.col("ends").cast("int")).over(by)).withColumn("next", F.first(F.when(F.col("ends"), F.col("kind")), ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)))
    streamed = rows.where("text != '' and coalesce(next, '') != 'assistant/message'")
    parts = _joined(streamed.select("path", "n", F.lit("assistant").alias("role"), "text", "ts", "island"))
    last = streamed.groupBy("path", "island").agg(F.min("n").alias("n"), F.max_by("ts", "n").alias("last"))
    parts = parts.join(last.select("path", "n", "last"), ["path", "n"]).select("path", "n", F.transform("records", lambda r: r.withField("ts", F.col("last")).withField("text", stripped(r["text"]))).alias("records"))
    return _assembled(rows.select("path", "n", "records", "id", "project", "title").unionByName(parts, allowMissingColumns=True))


def cursor_transcript(lines: DataFrame) -> DataFrame:
    """Lines of roles and blocks of text."""
    role = _at("$.role")
    return _assembled(lines.where(role.isin("user", "assistant")).select("path", "n", _record(role, content(_at("$.message.content"))[0], F.lit(None).cast("timestamp")).alias("records")))


def aider(lines: DataFrame) -> DataFrame:
    """Chat histories in Markdown, many sessions a file: a heading opens one, lines after four signs are the user's, those after one say what was run.

    Headings within code fences are none. All messages have their session's time.
    """
    by = Window.partitionBy("path").orderBy("n")
    rows = lines.withColumn("fenced", F.sum(F.col("value").rlike("^```").cast("int")).over(by) % 2 == 1)
    opens = F.col("value").startswith("# aider chat started at ") & ~F.col("fenced")
    rows = rows.withColumn("session", F.sum(opens.cast("int")).over(by)).where("session > 0").withColumn("opens", opens)
    user = F.col("value").startswith("#### ") & ~F.col("fenced")
    rows = rows.withColumn("role", F.when(user, "user").otherwise("assistant")).withColumn("started", F.max(F.when(F.col("opens"), F.substring("value", 25, 1 << 10))).over(Window.partitionBy("path", "session")))
    own = Window.partitionBy("path", "session").orderBy("n")
    rows = rows.where("not opens").withColumn("island", F.sum((F.col("role") != F.lag("role", 1, "").over(own)).cast("int")).over(own))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: F.regexp_replace(x["value"], "^#### ", "")), "\n")
    turns = rows.groupBy("path", "session", "started", "island").agg(F.first("role").alias("role"), stripped(text).alias("text")).where("text != ''")
    seq = F.row_number().over(Window.partitionBy("path", "session").orderBy("island")) - 1
    none = F.lit(None).cast("string")
    return turns.select("path", F.concat_ws("#", "path", F.date_format(lenient_time(F.trim("started")), "yyyyMMdd-HHmmss")).alias("session_id"), project_name(F.regexp_replace("path", r"/[^/]*$", "")).alias("project"), none.alias("title"), none.alias("parent"), seq.cast("long").alias("seq"), "role", "text", lenient_time(F.trim("started")).alias("ts"))


def notes(lines: DataFrame, zone: str = "UTC", prefix: str = "note") -> DataFrame:
    """Free notes by project and local day; promoted ones, by what they come from, newest first."""
    ts = lenient_time(_at("$.ts"))
    promoted = _at("$.kind") == "promoted"
    day = F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")
    project = F.coalesce(_filled(_at("$.project")), F.lit("-"))
    session = F.when(promoted, F.concat_ws("-", F.lit(prefix), F.replace(_at("$.session"), F.lit(":"), F.lit("-")))).otherwise(F.concat_ws("-", F.lit(prefix), day, project))
    text = F.when(promoted, F.concat(F.lit("["), F.coalesce(_filled(_at("$.state")), F.lit("accepted")), F.lit("] "), _at("$.text"))).otherwise(_at("$.text"))
    rows = lines.select("path", "n", session.alias("session_id"), project.alias("project"), F.when(promoted, _at("$.title")).alias("title"), F.lit(None).cast("string").alias("parent"), F.lit("user").alias("role"), text.alias("text"), ts.alias("ts"), F.coalesce(promoted, F.lit(False)).alias("promoted")).where("text != ''")
    order = F.when(F.col("promoted"), -F.unix_micros("ts")).otherwise(F.unix_micros("ts"))
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy(order, "path", "n")) - 1
    return rows.withColumn("seq", seq.cast("long")).select("path", "session_id", "project", "title", "parent", "seq", "role", "text", "ts")


def sqlite_rows(files: DataFrame, sql: str, schema: str) -> DataFrame:
    """The rows that a query gives over each SQLite file (path, content), with its path; files without such tables give none."""

    columns = [c.split() for c in schema.split(", ")]

    def run(batches):
        import sqlite3

        import pandas as pd

        for batch in batches:
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                db = sqlite3.connect(":memory:")
                try:
                    db.deserialize(raw)
                    got = pd.read_sql_query(sql, db)
                except (sqlite3.Error, pd.errors.DatabaseError):
                    continue
                finally:
                    db.close()
                got.columns = [name for name, _ in columns]
                for name, kind in columns:
                    if kind == "binary":
                        got[name] = [x.encode() if isinstance(x, str) else x for x in got[name]]
                got.insert(0, "path", path)
                yield got

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def opencode(files: DataFrame) -> DataFrame:
    """Sessions, messages and parts; parts fan out to text, files, commands with their ends, outputs and edits."""
    parts = sqlite_rows(files, "select session_id, message_id, id, data from part", "session string, message string, part string, data string")
    messages = sqlite_rows(files, "select id, data, time_created from message", "message string, meta string, at long")
    sessions = sqlite_rows(files, "select id, directory, title from session", "session string, directory string, title string")
    rows = parts.join(messages, ["path", "message"]).join(sessions, ["path", "session"])
    kind, role, ts = _at("$.type", "data"), _at("$.role", "meta"), F.timestamp_millis("at")
    state = lambda p: _at(f"$.state.{p}", "data")
    path, command, exit_ = state("input.filePath"), state("input.command"), state("metadata.exit")
    shown = F.concat(F.lit("$ "), command, F.when(exit_ != "0", F.concat(F.lit("  → exit "), exit_)).otherwise(""))
    records = F.when(kind == "text", _record(role, _at("$.text", "data"), ts)).when(kind == "tool", F.concat(_record("files", path, ts), _record("edit", F.when(F.coalesce(state("input.oldString"), F.lit("")) != "", F.concat(path, F.lit("\n"), state("input.oldString"))), ts), _record("command", F.when(is_telling(command), shown), ts), _record("tool-output", stripped(state("output")), ts)))
    order = F.row_number().over(Window.partitionBy("path", "session").orderBy("at", "message", "part"))
    rows = rows.select(F.concat_ws("#", "path", "session").alias("path"), order.alias("n"), F.col("session").alias("id"), project_name(F.col("directory")).alias("project"), "title", F.coalesce(records, F.array().cast(_RECORD)).alias("records"))
    return _assembled(rows)


def hermes(files: DataFrame) -> DataFrame:
    """Messages of users and assistants that hold something, by session, time and id."""
    rows = sqlite_rows(files, "select id, session_id, role, content, timestamp from messages where role in ('user', 'assistant') and content != ''", "n long, id string, role string, text string, at double")
    ts = F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))
    order = F.row_number().over(Window.partitionBy("path", "id").orderBy("at", "n"))
    return _assembled(rows.select(F.concat_ws("#", "path", "id").alias("path"), order.alias("n"), "id", F.regexp_extract("path", r"profiles/([^/]+)/", 1).alias("project"), _record(F.col("role"), F.col("text"), ts).alias("records")))


def goose_store(files: DataFrame) -> DataFrame:
    """Sessions joined with their messages."""
    rows = sqlite_rows(files, "select s.id, s.working_dir, s.description, m.id as n, m.role, m.content_json, m.created_timestamp from sessions s join messages m on m.session_id = s.id where m.role in ('user', 'assistant')", "id string, dir string, title string, n long, role string, text string, at long")
    order = F.row_number().over(Window.partitionBy("path", "id").orderBy("at", "n"))
    return _assembled(rows.select(F.concat_ws("#", "path", "id").alias("path"), order.alias("n"), "id", project_name(F.col("dir")).alias("project"), F.trim("title").alias("title"), _record(F.col("role"), content(F.col("text"))[0], F.timestamp_seconds("at")).alias("records")))


def cursor_store(files: DataFrame) -> DataFrame:
    """Composers and their bubbles, joined by the id within a bubble's key; type 1 is the user."""
    rows = sqlite_rows(files, "select key, cast(value as text) as value from cursorDiskKV where key like 'composerData:%' or key like 'bubbleId:%'", "key string, value string")
    part = lambda i: F.get(F.split("key", ":"), F.lit(i))
    heads = rows.where("key like 'composerData:%'").select("path", part(1).alias("composer"), _at("$.name").alias("title"), lenient_time(_at("$.createdAt")).alias("started"))
    bubbles = rows.where("key like 'bubbleId:%'").select("path", part(1).alias("composer"), part(2).alias("bubble"), F.when(_at("$.type") == "1", "user").otherwise("assistant").alias("role"), _at("$.text").alias("text"), lenient_time(_at("$.createdAt")).alias("at"))
    both = bubbles.join(heads, ["path", "composer"]).withColumn("ts", F.coalesce("at", "started"))
    order = F.row_number().over(Window.partitionBy("path", "composer").orderBy("ts", "bubble"))
    return _assembled(both.select(F.concat_ws("#", "path", "composer").alias("path"), order.alias("n"), F.col("composer").alias("id"), "title", _record(F.col("role"), F.col("text"), F.col("ts")).alias("records")))


def zed(files: DataFrame) -> DataFrame:
    """Threads, as JSON or compressed JSON, whose messages are tagged by who speaks."""
    rows = sqlite_rows(files, "select id, summary, updated_at, data_type, data from threads", "id string, title string, updated string, kind string, data binary")

    @F.pandas_udf("string")
    def opened(kind, data):
        import pandas as pd
        import zstandard

        return pd.Series([zstandard.ZstdDecompressor().decompressobj().decompress(d).decode() if k == "zstd" else bytes(d).decode() for k, d in zip(kind, data, strict=True)])

    messages = F.from_json(_at("$.messages", opened("kind", "data")), "array<struct<User struct<content string>, Agent struct<content string>>>")
    said = lambda raw: F.array_join(F.filter(F.transform(F.from_json(raw, "array<struct<Text string>>"), lambda b: b["Text"]), lambda t: t != ""), "\n")
    text = lambda m: F.coalesce(said(m["User"]["content"]), said(m["Agent"]["content"]))
    records = F.transform(F.filter(messages, lambda m: text(m) != ""), lambda m: F.struct(F.when(m["User"].isNotNull(), "user").otherwise("assistant").alias("role"), text(m).alias("text"), lenient_time(F.col("updated")).alias("ts")))
    return _assembled(rows.select(F.concat_ws("#", "path", "id").alias("path"), F.lit(0).alias("n"), "id", "title", records.alias("records")))


def without_comments(source: Column) -> Column:
    """JSON with comments and trailing commas as plain JSON; both may occur in strings, which stay."""
    strings = r'("(?:[^"\\]|\\.)*+")'
    return F.regexp_replace(F.regexp_replace(source, strings + r"|//[^\n]*|(?s:/\*.*?\*/)", "$1"), strings + r"|,(?=\s*[}\]])", "$1")


#: Which source reads a file, the first whose pattern its path holds.
SOURCES = (
    (r"/history\.jsonl$", codex_history), (r"rollout-[^/]*\.jsonl$", codex), (r"\.system_generated/logs/transcript\.jsonl$", antigravity), (r"updates\.jsonl$", grok), (r"wire\.jsonl$", kimi), (r"/events\.jsonl$", copilot),
    (r"agent-transcripts/[^/]*\.jsonl$", cursor_transcript), (r"gemini/[^/]*\.jsonl$", gemini), (r"goose/.*\.jsonl$", goose), (r"qwen/.*\.jsonl$", qwen), (r"deepseek/.*session\.jsonl$", deepseek), (r"(?:/pi|/omp|openclaw)/.*\.jsonl$", pi), (r"notes\.jsonl$", notes), (r"\.aider\.chat\.history\.md$", aider), (r"\.jsonl$", claude),
)


def archive(lines: DataFrame) -> DataFrame:
    """The messages of files of all sources, each read by the first source that its path names; harness tells which."""
    which = F.coalesce(*(F.when(F.col("path").rlike(p), F.lit(i)) for i, (p, _) in enumerate(SOURCES)))
    rows, out = lines.withColumn("which", which), None
    for i, (_, read) in enumerate(SOURCES):
        own = read(rows.where(F.col("which") == i).drop("which")).withColumn("harness", F.lit(read.__name__))
        out = own if out is None else out.unionByName(own)
    return out
