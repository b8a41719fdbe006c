"""What is served of an archive: filters over sessions, pages, digests, notes, plans, imports and their state."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import clipped, decides, gives_up, has_word, sentences
from ..functions.scalars import base_name, mention_count, mention_level, nfc, path_matches, trimmed
from .places import placed

WORK = ("files", "command", "edit")


def matching_sessions(metas: DataFrame, harness: str | None = None, project: str | None = None, machine: str | None = None, since: Column | None = None, notes: str = "notes") -> DataFrame:
    """Sessions of a harness, whose project holds a string in any case, of a machine (local: none), updated since a time."""
    where = F.lit(True)
    if harness:
        where = where & (F.col("harness") == ({"note": notes}.get(harness, harness)))
    if project:
        where = where & F.contains(F.lower("project"), F.lit(project.lower()))
    if machine:
        where = where & (F.coalesce("machine", F.lit("")) == ("" if machine == "local" else machine))
    if since is not None:
        where = where & (F.col("updated") >= since)
    return metas.where(where)


def of_role(messages: DataFrame, metas: DataFrame, role: str) -> DataFrame:
    """The records of a role with what is known of their sessions; tool stands for tool output."""
    return messages.where(F.col("role") == {"tool": "tool-output"}.get(role, role)).join(metas, "session_id")


def verified(messages: DataFrame, terms: list[str], fold: tuple[str, str] = ("", "")) -> DataFrame:
    """Messages that hold all terms as they are written, composed, or with characters read as others (fold)."""
    low = F.lower("text")
    composed = F.lower(nfc(F.col("text")))
    forms = [low, composed, F.translate(composed, *fold) if fold[0] else composed]
    read = lambda t: "".join(fold[1][fold[0].index(c)] if c in fold[0] else c for c in t)
    met = F.lit(False)
    for i, form in enumerate(forms):
        every = F.lit(True)
        for t in terms:
            every = every & F.contains(form, F.lit(read(t) if i == 2 else unicodedata.normalize("NFC", t.lower()) if i else t.lower()))
        met = met | every
    return messages.where(met)


def spoken_of(messages: DataFrame, terms: list[str]) -> DataFrame:
    """Sessions in which a person or an assistant says one of the terms."""
    says = F.lit(False)
    for t in terms:
        says = says | has_word(F.lower("text"), t)
    return messages.where(F.col("role").isin("user", "assistant") & says).select("session_id").distinct()


def late_read(messages: DataFrame, found: DataFrame) -> DataFrame:
    """Only the messages that were found (session_id, seq) are read whole."""
    return messages.join(found.select("session_id", "seq").distinct(), ["session_id", "seq"], "left_semi")


def in_order(found: DataFrame, messages: DataFrame) -> DataFrame:
    """The messages of found sessions (session_id, place), in their places, turns in order."""
    return messages.join(found, "session_id").select("place", "session_id", "seq", "role", "text")


def session_spans(messages: DataFrame) -> DataFrame:
    """Started and updated of each session; messages without a time, or late ones, don't move them the wrong way."""
    return messages.groupBy("session_id").agg(F.min("ts").alias("started"), F.max("ts").alias("updated"), F.count("*").alias("messages"))


def imported(batch: DataFrame, seen: DataFrame, own: DataFrame) -> DataFrame:
    """Records of a batch that weren't imported before, that this machine didn't write, once each.

    seen and own: session, role, ts, text marks (mark) of what is held.
    """
    marked = batch.withColumn("mark", F.xxhash64("session_id", "role", "ts", "text"))
    new = marked.join(seen.select("mark"), "mark", "left_anti").join(own.select("mark"), "mark", "left_anti")
    return new.select("mark", *batch.columns).distinct()


def whole_files(records: DataFrame) -> DataFrame:
    """Records of those files alone that hold no broken line."""
    bad = records.groupBy("path").agg(F.bool_or(F.col("broken")).alias("bad"))
    return records.join(bad.where("not bad").select("path"), "path", "left_semi")


def around_errors(messages: DataFrame, hit: Column, around: int = 2) -> DataFrame:
    """Messages that hold an error, with so many before and after each, and whether they are it."""
    by = Window.partitionBy("session_id").orderBy("seq")
    return messages.withColumn("hit", hit).withColumn("near", F.max("hit").over(by.rowsBetween(-around, around))).where("near").select("session_id", "seq", "hit")


def reply_window(messages: DataFrame, hit: Column, before: int = 4) -> DataFrame:
    """Assistant turns with a hit among the so many turns before them."""
    by = Window.partitionBy("session_id").orderBy("seq").rowsBetween(-before, -1)
    return messages.withColumn("asked", F.max(hit).over(by)).where("role = 'assistant' and asked").select("session_id", "seq")


def steps_meet(sessions: DataFrame, steps: dict[str, list[str]], need: int = 2) -> DataFrame:
    """Which sessions' texts hold so many terms of a plan's step. sessions: session_id, text; steps are one plan's, so few."""
    out = None
    for step, terms in steps.items():
        n = sum((has_word(F.lower("text"), t).cast("int") for t in terms), F.lit(0))
        own = sessions.groupBy("session_id").agg(F.max(n).alias("n")).where(F.col("n") >= min(need, len(terms))).select(F.lit(step).alias("step"), "session_id", F.col("n").cast("long").alias("n"))
        out = own if out is None else out.unionByName(own)
    return out


def plan_steps(plan: str) -> list[str]:
    """The steps of a plan: its bullets and numbered lines."""
    import re

    return [m[1].strip() for m in re.finditer(r"(?m)^\s*(?:[-*+]|\d+[.)])\s+(.+)$", plan)]


def notes_first(hits: DataFrame, notes: DataFrame) -> DataFrame:
    """A promoted note right above the first hit that it comes from. hits: session_id, place; notes: session_id (of the note), source."""
    own = hits.join(notes, "session_id", "left")
    src = hits.select(F.col("session_id").alias("source"), F.col("place").alias("source_place"))
    moved = own.join(src, "source", "left").withColumn("at", F.when(F.col("source_place") < F.col("place"), F.col("source_place") - 0.5).otherwise(F.col("place")))
    return moved.select("session_id", F.row_number().over(Window.orderBy("at", "place")).cast("long").alias("place"))


def conflicting(notes: DataFrame) -> DataFrame:
    """Pairs of accepted notes of a project that share a tag: key, project, tags, state."""
    tagged = notes.where("state = 'accepted'").select("project", "key", F.explode(F.array_distinct("tags")).alias("tag"))
    pairs = tagged.alias("a").join(tagged.alias("b"), (F.col("a.project") == F.col("b.project")) & (F.col("a.tag") == F.col("b.tag")) & (F.col("a.key") < F.col("b.key")))
    return pairs.select(F.col("a.project").alias("project"), F.col("a.key").alias("first"), F.col("b.key").alias("second")).distinct()


def page(ranked: DataFrame, key: str, limit: int = 15, offset: int = 0) -> DataFrame:
    """A page of a ranking by score, with the number of all hits and whether there are more; at most 100 rows."""
    limit = max(1, min(limit, 100))
    total = ranked.agg(F.count("*").alias("total"))
    head = ranked.orderBy(F.desc("score"), key).offset(offset).limit(limit)
    return head.crossJoin(F.broadcast(total)).withColumn("capped", F.col("total") > offset + limit)


def envelope(page_: DataFrame, tier: str, key: str) -> DataFrame:
    """A page as one JSON document: version, tier, total, capped and the hits in order; a page has at most 100 rows."""
    hits = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"), "score"))), lambda h: F.struct(h["k"].alias("id"), h["score"].alias("score")))
    rows = page_.agg(F.coalesce(F.max("total"), F.lit(0)).alias("total"), F.coalesce(F.bool_or("capped"), F.lit(False)).alias("capped"), hits.alias("hits"))
    return rows.select(F.to_json(F.struct(F.lit(2).alias("schema_version"), F.lit(tier).alias("tier"), "total", "capped", "hits")).alias("envelope"))


def newest_first(metas: DataFrame) -> DataFrame:
    """Places of sessions: last updated first, then by harness and id; numbered by ranges, not in one task."""
    return placed(metas.select("session_id", "updated", "harness"), [F.desc("updated"), F.col("harness"), F.col("session_id")]).select("session_id", "place")


def recall_order(rows: DataFrame, now: Column, days: int = 90, most: int = 12) -> DataFrame:
    """Sessions by their task's score, then the recent ones, then the last updated."""
    recent = F.col("updated") >= F.timestamp_add("DAY", F.lit(-days), now)
    return rows.orderBy(F.desc("task"), F.desc(recent), F.desc("updated"), "session_id").limit(most)


def best_snippets(snippets: DataFrame, most: int = 3) -> DataFrame:
    """Of each session's snippets (window, count, seq) those whose words meet, closest first, then the fullest, then in order."""
    order = [F.desc(F.col("window") > 0), F.when(F.col("window") > 0, F.col("window")), F.desc("count"), "seq"]
    return snippets.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).where(F.col("place") <= most).select("session_id", "seq", F.col("place").cast("long").alias("place"))


def by_id(metas: DataFrame, wanted: str) -> DataFrame:
    """Sessions by id: a prefix, both ends of an elided one, or harness:id."""
    sid = F.col("session_id").cast("string")
    if "…" in wanted:
        head, tail = wanted.split("…", 1)
        return metas.where(sid.startswith(head) & sid.endswith(tail))
    if ":" in wanted:
        harness, rest = wanted.split(":", 1)
        return metas.where((F.col("harness") == harness) & sid.startswith(rest))
    return metas.where(sid.startswith(wanted))


def filtered_stats(messages: DataFrame, metas: DataFrame, role: str, **which) -> DataFrame:
    """Sessions and messages of one role in the sessions that match."""
    return of_role(messages, matching_sessions(metas, **which).select("session_id"), role).agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("messages"))


def friction_report(events: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """Signatures of so many sessions, with their harnesses, most sessions first, then the newest."""
    rows = events.groupBy("signature").agg(F.countDistinct("session_id").alias("sessions"), F.max("ts").alias("last"), F.array_join(F.array_sort(F.collect_set("harness")), ",").alias("harnesses"))
    return rows.where(F.col("sessions") >= least).orderBy(F.desc("sessions"), F.desc("last"), "signature").limit(most)


def command_uses(runs: DataFrame, command: str, rules: Column) -> DataFrame:
    """Runs of a command by project, where the project may be served."""
    return runs.where((F.lower("command") == command.lower()) & rules).groupBy("project").agg(F.count("*").alias("runs"), F.max("ts").alias("last"))


def gave_up(messages: DataFrame) -> DataFrame:
    """Whether someone says in a session that something was taken back."""
    line = F.exists(F.split("text", "\n"), gives_up)
    return messages.groupBy("session_id").agg(F.coalesce(F.bool_or(F.col("role").isin("user", "assistant") & line), F.lit(False)).alias("gave_up"))


def spans(records: DataFrame) -> DataFrame:
    """Replaced spans and the files they are of."""
    path = F.substring_index("text", "\n", 1)
    return records.where("role = 'edit'").agg(F.count("*").alias("spans"), F.countDistinct(path).alias("files"))


def restorable(records: DataFrame, path: str, sessions: int = 400) -> DataFrame:
    """The replaced spans of a file, newest first, of so many of its sessions at most."""
    own = records.where("role = 'edit'").where(path_matches(F.substring_index("text", "\n", 1), path))
    newest = own.groupBy("session_id").agg(F.max("ts").alias("newest")).orderBy(F.desc("newest"), "session_id").limit(sessions)
    span = F.substring("text", F.instr("text", "\n") + 1, F.lit(1 << 20))
    return own.join(newest.select("session_id"), "session_id").select("session_id", "seq", "ts", span.alias("span")).orderBy(F.desc("ts"), "session_id", F.desc("seq"))


def task_scores(touched: DataFrame, changed: list[str], most: int = 12) -> DataFrame:
    """How many of the changed files each session touched."""
    names = [c.split("/")[-1] for c in changed]
    rows = touched.where(base_name(F.col("path")).isin(names)).groupBy("session_id").agg(F.countDistinct(base_name(F.col("path"))).alias("task"))
    return rows.orderBy(F.desc("task"), "session_id").limit(most)


def blame(messages: DataFrame, metas: DataFrame, path: str, forms: list[str], now: Column, most: int = 10) -> DataFrame:
    """Sessions by how much they speak of a file: mentions, how fully they name it, whether it lies in their project, how fresh they are."""
    name = path.split("/")[-1]
    text = F.col("text")
    own = messages.select("session_id", mention_count(text, name).alias("n"), mention_level(text, forms).alias("level")).where("n > 0")
    own = own.groupBy("session_id").agg(F.sum("n").alias("mentions"), F.max("level").alias("level")).join(metas, "session_id")
    age = (F.unix_timestamp(now) - F.unix_timestamp("updated")) / 86400
    inside = F.when(F.lit(path).startswith(F.concat("project", F.lit("/"))) & F.col("project").startswith("/"), 1.35).otherwise(1.0)
    score = F.col("mentions") * (1 + F.col("level")) * inside * F.when(age < 0, 1.0).otherwise(1 / (1 + age))
    return own.select("session_id", "mentions", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "session_id").limit(most)


def conclusions(messages: DataFrame, budget: int = 2048, most: int = 5) -> DataFrame:
    """Of each session the newest assistant turns that decide something, two sentences each, within a budget of bytes."""
    short = clipped(F.array_join(F.slice(sentences(F.col("text")), 1, 2), " "))
    rows = messages.where(F.col("role") == "assistant").where(decides(F.col("text"))).select("session_id", "seq", short.alias("line"))
    by = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    rows = rows.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= most).withColumn("upto", F.sum(F.octet_length("line")).over(by))
    return rows.where(F.col("upto") <= budget).select("session_id", "seq", "line")


def context_document(messages: DataFrame, hit: Column, budget: int = 8000) -> DataFrame:
    """A session's hits, what users said and what assistants answered them, in order, up to a budget of bytes."""
    by = Window.partitionBy("session_id").orderBy("seq")
    rows = messages.withColumn("own", hit | (F.col("role") == "user"))
    rows = rows.withColumn("kept", F.col("own") | ((F.col("role") == "assistant") & F.coalesce(F.lag("own").over(by), F.lit(False)))).where("kept")
    rows = rows.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("## "), "role", F.lit("\n"), "text").alias("part"))))
    return rows.where(F.col("before") < budget).groupBy("session_id").agg(F.count("*").alias("parts"), F.octet_length(F.array_join(F.transform(parts, lambda p: p["part"]), "\n")).cast("long").alias("bytes"))


def digest(messages: DataFrame, terms: list[str], lines: int = 3) -> DataFrame:
    """Of each session the user's turn that holds most terms, the earliest of equal ones, and the first assistant turns after it that hold one."""
    n = sum((has_word(F.lower("text"), t).cast("int") for t in terms), F.lit(0))
    rows = messages.withColumn("n", n)
    asked = rows.where("role = 'user' and n > 0").groupBy("session_id").agg(F.max_by("seq", F.struct("n", -F.col("seq"))).alias("asked"))
    after = rows.where("role = 'assistant' and n > 0").join(asked, "session_id").where("seq > asked")
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    told = after.withColumn("nth", nth).where(F.col("nth") <= lines).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("seq")), lambda x: x.cast("string")), ",").alias("answers"))
    return asked.join(told, "session_id", "left").select("session_id", "asked", F.coalesce("answers", F.lit("")).alias("answers"))


def conventions(notes: DataFrame, projects: list[str], most: int = 5, budget: int = 600) -> DataFrame:
    """Accepted notes of some projects, the latest state of each, newest first, so many within a budget of bytes."""
    latest = notes.groupBy("key").agg(F.max_by(F.struct("state", "project", "text", "ts"), F.struct("ts", "seq")).alias("n")).select("key", "n.*")
    own = latest.where((F.col("state") == "accepted") & F.col("project").isin(projects)).orderBy(F.desc("ts"), "key").limit(most)
    rows = own.withColumn("upto", F.sum(F.octet_length("text")).over(Window.orderBy(F.desc("ts"), "key")))  # the few that are left
    return rows.where(F.col("upto") <= budget).select("key", "text")


def moved_since(touched: DataFrame, changes: DataFrame, metas: DataFrame) -> DataFrame:
    """Files of a session that changed after it was last updated. touched: session_id, path; changes: path, changed."""
    last = changes.groupBy("path").agg(F.max("changed").alias("changed"))
    return touched.join(last, "path").join(metas.select("session_id", "updated"), "session_id").where("changed > updated").groupBy("session_id").agg(F.countDistinct("path").alias("moved"))


def focused(messages: DataFrame, hit: Column, most: int = 300, around: int = 2) -> DataFrame:
    """A long session's hits with the turns around them, so many at most; short sessions whole."""
    by = Window.partitionBy("session_id")
    rows = messages.withColumn("n", F.count("*").over(by)).withColumn("near", F.max(hit).over(by.orderBy("seq").rowsBetween(-around, around)))
    kept = rows.where((F.col("n") <= most) | F.col("near")).withColumn("nth", F.row_number().over(by.orderBy("seq"))).where(F.col("nth") <= most)
    return kept.select("session_id", "seq")


def session_start(messages: DataFrame, metas: DataFrame, per_project: int = 3, tail: int = 150) -> DataFrame:
    """The last turns of the newest sessions of each project."""
    nth = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("updated"), "session_id"))
    newest = metas.withColumn("nth", nth).where(F.col("nth") <= per_project).select("session_id", "project")
    last = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    return messages.join(newest, "session_id").withColumn("last", last).where(F.col("last") <= tail).groupBy("project", "session_id").agg(F.count("*").alias("turns"), F.max("seq").alias("upto"))


def topic_label(titles: DataFrame, most: int = 40) -> DataFrame:
    """A session's label: its title on one line, cut with an ellipsis."""
    return titles.select("session_id", trimmed(F.regexp_replace("title", r"\s+", " "), most).alias("label"))


def due(shown: DataFrame, now: Column, minutes: int = 20) -> DataFrame:
    """Agents that weren't shown anything for so many minutes."""
    last = shown.groupBy("agent").agg(F.max("ts").alias("last"))
    return last.where(F.timestamp_add("MINUTE", F.lit(minutes), F.col("last")) <= now).select("agent")


def not_yet_shown(candidates: DataFrame, shown: DataFrame, last: int = 10) -> DataFrame:
    """Candidates (agent, session_id) that are not among the last so many shown to their agent."""
    nth = F.row_number().over(Window.partitionBy("agent").orderBy(F.desc("ts"), "session_id"))
    return candidates.join(shown.withColumn("nth", nth).where(F.col("nth") <= last).select("agent", "session_id"), ["agent", "session_id"], "left_anti")


def changed_files(now: DataFrame, manifest: DataFrame) -> DataFrame:
    """What has happened to each file (path, size, mtime, head: a mark of its first bytes): new, same, grown, changed or gone.

    A folder all of whose files are gone may be one that isn't mounted: its files are missing, not gone.
    """
    a, b = now.select("path", *(F.col(c).alias(f"now_{c}") for c in ("size", "mtime", "head"))), manifest
    rows = a.join(b, "path", "full")
    folder = F.regexp_replace("path", "/[^/]*$", "")
    rows = rows.withColumn("left", F.count("now_size").over(Window.partitionBy(folder)))
    what = (
        F.when(F.col("size").isNull(), "new")
        .when(F.col("now_size").isNull(), F.when(F.col("left") == 0, "missing").otherwise("gone"))
        .when((F.col("size") == F.col("now_size")) & (F.col("mtime") == F.col("now_mtime")), "same")
        .when((F.col("now_size") > F.col("size")) & (F.col("head") == F.col("now_head")), "grown")
        .otherwise("changed")
    )
    return rows.select("path", what.alias("what"))


def updated_index(held: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """What is held of untouched paths, and all of the fresh ones; imported records (no path) stay."""
    touched = fresh.select("path").unionByName(gone.select("path")).distinct()
    return held.join(touched, "path", "left_anti").unionByName(fresh)


def marks_after(delivered: DataFrame) -> DataFrame:
    """By peer and source the time up to which records were delivered, and those at that very time."""
    last = delivered.groupBy("peer", "source").agg(F.max("ts").alias("mark"))
    at = delivered.join(last, ["peer", "source"]).where("ts = mark")
    return at.groupBy("peer", "source", "mark").agg(F.count("*").alias("at_mark"))


def to_deliver(records: DataFrame, delivered: DataFrame) -> DataFrame:
    """For each peer the records after its mark of their source, those at it that weren't delivered, and all without a mark."""
    peers = delivered.select("peer").distinct()
    marks = delivered.groupBy("peer", "source").agg(F.max("ts").alias("mark"))
    rows = records.crossJoin(peers).join(marks, ["peer", "source"], "left").where("mark is null or ts is null or ts >= mark")
    return rows.join(delivered.select("peer", "record"), ["peer", "record"], "left_anti").select("peer", "record")


def rotated(events: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """The usage log without what is older than so many days."""
    return events.where(F.col("ts") >= F.timestamp_add("DAY", F.lit(-days), now))


def forgotten(metas: DataFrame, selectors: DataFrame) -> DataFrame:
    """Sessions that a tombstone names by a prefix of their id (an empty one names all), or their project.

    Each id gives its own prefixes, so that many tombstones are joined by equality, of whichever size.
    """
    own = F.col("session_id").cast("string")
    prefixes = metas.select("session_id", F.explode(F.transform(F.sequence(F.lit(0), F.char_length(own)), lambda n: F.left(own, n))).alias("value"))
    by_prefix = prefixes.join(selectors.where("kind = 'id'"), "value", "left_semi")
    by_project = metas.join(selectors.where("kind = 'project'"), F.col("project") == F.col("value"), "left_semi")
    return by_prefix.select("session_id").unionByName(by_project.select("session_id")).distinct()


def merged_fixes(held: DataFrame, fresh: DataFrame, gone: DataFrame) -> DataFrame:
    """Pairs of untouched sessions stay, those of touched ones are replaced, the newest of each pair counts."""
    kept = held.join(gone.select("session_id").unionByName(fresh.select("session_id")).distinct(), "session_id", "left_anti")
    return kept.unionByName(fresh).groupBy("error", "command").agg(F.max("ts").alias("ts"))


def rebucketed(notes: DataFrame, zone: str) -> DataFrame:
    """Notes by project and the day that it is in a zone, however they were grouped before."""
    return notes.groupBy("project", F.date_format(F.from_utc_timestamp("ts", zone), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("notes"))


def merged_counts(partial: DataFrame, more: DataFrame, key: str, value: str, most: int = 6) -> DataFrame:
    """Two tables of counts as one, the most frequent values of each key."""
    rows = partial.unionByName(more).groupBy(key, value).agg(F.sum("n").cast("long").alias("n"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= most)


def unembedded(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Messages without a vector of their text."""
    return messages.withColumn("mark", F.xxhash64("text")).join(vectors.select("mark"), "mark", "left_anti").drop("mark")


def embedded(messages: DataFrame, dim: int = 16, most: int = 2000) -> DataFrame:
    """A vector of the hashed words of the first characters, of length one; what a real model gives may take its place."""
    words = F.regexp_extract_all(F.lower(F.left("text", F.lit(most))), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(words, lambda w: F.pmod(F.crc32(w), F.lit(dim)) == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
    return messages.select("session_id", "seq", F.transform(counts, lambda x: F.when(norm > 0, F.round(x / norm, 6)).otherwise(0.0)).alias("vector"))


def auto_recall(ranked: DataFrame, words: DataFrame, most: int = 3, least: int = 3, alike: float = 0.8) -> DataFrame:
    """Of a few ranked sessions (session_id, place, at most dozens) the first ones that say enough and aren't near copies of better ones.

    A session goes if a better one that stays is alike; over dozens of rows one ordered fold decides.
    """
    rows = ranked.join(words, "session_id").where(F.size("w") >= least).agg(F.array_sort(F.collect_list(F.struct("place", "session_id", "w"))).alias("rows"))
    kind = rows.schema["rows"].dataType.simpleString()
    like = lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)) >= alike
    kept = F.aggregate("rows", F.array().cast(kind), lambda acc, r: F.when((F.size(acc) < most) & ~F.exists(acc, lambda k: like(k["w"], r["w"])), F.concat(acc, F.array(r))).otherwise(acc))
    return rows.select(F.explode(kept).alias("r")).select("r.session_id", "r.place")


def log_tail(events: DataFrame, n: int = 20) -> DataFrame:
    """The last so many events of the usage log, newest first."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def brief(events: DataFrame, now: Column) -> DataFrame:
    """What the log says of the day: active sessions, events and bytes of each kind."""
    return events.where(F.to_date("ts") == F.to_date(now)).groupBy("kind").agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("n"), F.round(F.sum("bytes"), 4).alias("bytes"))


def to_fetch(rows: DataFrame, marks: DataFrame, source: str, order: str, key: str) -> DataFrame:
    """Rows of each source after the last one that was read, by time and id; all of sources never read. marks: source, mark, mark_id."""
    later = F.col("mark").isNull() | (F.col(order) > F.col("mark")) | ((F.col(order) == F.col("mark")) & (F.col(key) > F.col("mark_id")))
    return rows.join(marks, source, "left").where(later).select(rows.columns)


def rewritten_notes(notes: DataFrame, gone: DataFrame, titles: DataFrame) -> DataFrame:
    """The log of notes without forgotten ones, with titles put back where they are known. gone: key; titles: key, title."""
    return notes.join(gone, "key", "left_anti").join(titles, "key", "left")


def weighted_hits(messages: DataFrame, terms: list[str], sessions: int) -> DataFrame:
    """Of each session the message that holds most of the terms, rare ones counting more: 0.2 + ln((n + 1) / (df + 1))."""
    has = lambda t: F.contains(F.lower("text"), F.lit(t))
    rows = messages.select("session_id", "seq", *(has(t).alias(f"h{i}") for i, t in enumerate(terms)))
    df = rows.agg(*(F.countDistinct(F.when(F.col(f"h{i}"), F.col("session_id"))).alias(f"d{i}") for i in range(len(terms))))
    weight = sum((F.when(F.col(f"h{i}"), 0.2 + F.log((F.lit(sessions) + 1) / (F.col(f"d{i}") + 1))).otherwise(0.0) for i in range(len(terms))), F.lit(0.0))
    own = rows.crossJoin(F.broadcast(df)).withColumn("weight", F.round(weight, 6)).where("weight > 0")
    return own.groupBy("session_id").agg(F.max(F.struct("weight", -F.col("seq"))).alias("b")).select("session_id", (-F.col("b.col2")).alias("seq"), F.col("b.weight").alias("weight"))


def file_history(touched: DataFrame, path: str, least: int = 5) -> DataFrame:
    """How many sessions touched a file, if so many did."""
    return touched.where(path_matches(F.col("path"), path)).agg(F.countDistinct("session_id").alias("sessions")).where(F.col("sessions") >= least)
