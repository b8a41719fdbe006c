"""Words, questions, decisions and noise in texts: columns over text, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a query does without.
STOP_WORDS = frozenset(
    "a an and are as at be before but by did do does for from dealt have how in is it of on or that the this to was we what when where which who with "
    "и в во не на но я ты он она оно мы вы они что чтобы как так это этот эта эти тот все всё всех был была было были есть быть будет для от до по из у за с со к ко о об обо же ну вот или если когда где куда там тут здесь "
    "его её их мне меня тебе тебя нам вам надо нужно можно может давай сделай делай делать сделать скажи говори покажи посмотри пожалуйста".split()
)
# Words that open a question.
ASKING = (
    "what why how when where which who whose did does do is are was were can should would "
    "что чем почему зачем как какой какая какие когда где куда откуда сколько кто чей можно нужно надо"
).split()
# How text begins that a program has put under a person's name.
PLUMBING = ("<local-command", "<command-", "<task-notification", "<teammate-message", "<bash-", "Caveat:", "<system-reminder")
NOT_ASKED = (*PLUMBING, "<recall", "[Request interrupted", "The following tool was executed", "This session is being continued", "Continue from where you left off")
# Beginnings, parts and contents of lines that are no friction, and what friction says.
NO_FRICTION_BEGIN = ("Traceback (most recent", "Error: ", "error: ", "FAIL\t", "--- FAIL", "//", "#", "/*", "*", "--")
NO_FRICTION_HOLD = ("echo ", '"', "$(", "=~", "print(")
FRICTION = (
    "command not found", "modulenotfounderror", "no module named", "not found: ", "cannot find", "no such file or directory", "undefined:", "connection refused", "permission denied",
    "panic:", "segmentation fault", "exception in thread", "nullpointerexception", "index out of range", "stack overflow", "typeerror:", "referenceerror:", "keyerror:", "attributeerror:",
    "fatal:", "npm err!", "rpc failed", "timeout expired", "statement timeout", "connection reset", "connection timed out", "] error ", "build failed", "compilation failed", "cannot be resolved",
)
# What says that something was taken back.
GIVE_UP = (
    "reverted", "rolled back", "rolling back", "roll it back", "backed out", "back it out", "gave up on", "giving up on", "abandoned that", "abandoned this", "abandoned the",
    "dropped that approach", "dropped this approach", "scrap that", "undid the", "undo the change", "reverting the",
    "откатил", "откатили", "откатываю", "откатывать", "вернул как было", "вернули как было", "вернул обратно", "вернули обратно", "отказались от", "отказался от", "отбросил", "отменил изменен",
)
# Words before such a phrase that deny or defer it, and openings that make its clause a question.
DENYING = ("not ", "n't ", "never ", "without ", "avoid ", "if ", "would ", "could ", "should ", "might ", "planning to ", "going to ", "i'll ", "we'll ", "will ", "не ", "нельзя ", "без ", "если ", "надо ли ", "стоит ли ")
CLAUSE_ASKS = ("did ", "do ", "does ", "why ", "what ", "how ", "when ", "whether ", "can ")
REFLEXIVE = ("ся", "сь", "ась", "ось", "ись", "лся", "лась", "лось", "лись")
# What says that something was decided.
DECISIONS = ("we pinned", "we moved", "we dropped", "we switched", "we chose", "decision:", "fixed by", "fixed it by", "the fix", "root cause", "turned out", "traced it to", "instead of", "the cause was", "resolved by", "worked around", "we set", "we added")
# What says that access was refused, that no memory was there, and that a message only tests the wiring.
BLOCKED = ("not granted", "call blocked", "permission denied", "requires approval", "denied permission", "не разрешен", "не разрешён", "нет доступа")
SELF_TEST = ("reply with exactly", "answer one line", "закончи ответ", "ответь одной строкой", "ответь ровно", "harness live test", "smoke test alpha")
SMOKE = ("reply with", "respond with", "answer with", "output only", "print only", "quote the first", "say the word", "скажи ", "ответь ", "напиши слово")
# Function words, one of which makes a line more than a listing.
LISTING_STOPS = "the a an is are to of in on and or it we i you not with for и в на не что как это у с по а но".split()

#: Chinese, Japanese and Korean characters, and those of them that only mark kana.
CJK, KANA_MARKS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}ーｰﾞﾟ〆", r"ーｰﾞﾟ〆"
SPACE = r"[\t\n\x0b\f\r \u0085\p{Z}]"


def quoted(words) -> str:
    """An alternation of plain strings for a regular expression."""
    return "|".join(r"\Q" + w + r"\E" for w in words)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def fields(text: Column) -> Column:
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def once(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it: as a list of one."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def one_line(text: Column) -> Column:
    return F.array_join(fields(text), " ")


def begins(text: Column, words) -> Column:
    return text.rlike(rf"^(?:{quoted(words)})")


def holds(text: Column, words) -> Column:
    return text.rlike(rf"(?:{quoted(words)})")


def is_plumbing(text: Column) -> Column:
    """P10: text that a program wrote."""
    return begins(stripped(text), PLUMBING)


def not_asked(text: Column) -> Column:
    """P10: text that no person asked."""
    return begins(stripped(text), NOT_ASKED) | F.contains(text, F.lit("no visible output"))


def is_question(text: Column) -> Column:
    """At most 240 characters that end in a question mark or begin with an asking word, in English or Russian."""
    t = stripped(text)
    first = F.regexp_replace(F.lower(F.get(fields(t), F.lit(0))), r"^[,.:;!\"']+|[,.:;!\"']+$", "")
    return (F.char_length(t) <= 240) & (t.rlike("[?？]$") | F.coalesce(first.isin(ASKING), F.lit(False)))


def question_stem(text: Column) -> Column:
    """lower-case words alone, if there are five of them or five CJK characters; else empty."""
    w = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}_-]+"), F.lit(0))
    return F.when((F.size(w) >= 5) | (cjk_count(text) >= 5), F.array_join(w, " ")).otherwise("")


def cjk_count(text: Column) -> Column:
    """CJK characters, none if there are only marks."""
    n = F.regexp_count(text, F.lit(f"[{CJK}]"))
    return F.when(n > F.regexp_count(text, F.lit(f"[{KANA_MARKS}]")), n).otherwise(0)


def cjk_bigrams(text: Column, fold: tuple[str, str] = ("", "")) -> Column:
    """Pairs of CJK characters within runs of them, a run of one alone; fold gives characters and what they are read as."""
    folded = F.translate(text, *fold) if fold[0] else text
    runs = F.regexp_extract_all(folded, F.lit(f"[{CJK}]+"), F.lit(0))
    pairs = lambda r: F.when(F.char_length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    return F.array_distinct(F.flatten(F.transform(runs, pairs)))


def cut_runs(run: Column, most: int = 64) -> Column:
    """A run of word characters in parts that end as soon as they have more than so many bytes."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc, c):
        now = F.concat(acc["now"], c)
        over = F.octet_length(now) > most
        return F.struct(F.when(over, F.concat(acc["done"], F.array(now))).otherwise(acc["done"]).alias("done"), F.when(over, F.lit("")).otherwise(now).alias("now"))

    parts = F.aggregate(F.split(run, ""), zero, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    return F.when(F.octet_length(run) > most, parts).otherwise(F.array(run))


def token_set(text: Column) -> Column:
    """Distinct runs of letters, digits, underscores and hyphens in lower case, in parts of 65 bytes, of two bytes at least; only long runs are cut."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}_-]+"), F.lit(0)))
    long = F.flatten(F.transform(F.filter(runs, lambda r: F.octet_length(r) > 64), lambda r: cut_runs(r)))
    return F.array_distinct(F.concat(F.filter(runs, lambda r: F.octet_length(r).between(2, 64)), F.filter(long, lambda t: F.octet_length(t) >= 2)))


def index_tokens(text: Column) -> Column:
    """The tokens of a text, longest first."""
    kept = token_set(text)
    return F.transform(F.array_sort(F.transform(kept, lambda t: F.struct((-F.octet_length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])


def identifier_parts(text: Column) -> Column:
    """The parts, of three characters at least, of words of six or more that humps, underscores or hyphens divide, in lower case."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{Nd}_-]{1,65}"), F.lit(0)), lambda w: (F.char_length(w) >= 6) & w.rlike(r".[\p{Lu}_-]"))  # others have one part
    split = lambda w: F.split(w, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<!^)[_-]")
    parts = F.flatten(F.filter(F.transform(words, split), lambda p: F.size(p) > 1))
    return F.transform(F.filter(parts, lambda p: F.char_length(p) >= 3), F.lower)


def date_tokens(ts: Column) -> Column:
    """The month's name, the year, and year and month of a time."""
    return F.when(ts.isNotNull(), F.array(F.lower(F.date_format(ts, "MMMM")), F.date_format(ts, "yyyy"), F.date_format(ts, "yyyy-MM")))


# What a line of long tool output must hold to be indexed.
SIGNALS = ("FAIL", "fail", "Error", "error", "panic:", "fatal", "Traceback", "not found", "undefined", "cannot", "refused", "denied", "timeout", "exit status", "warning", "WARN", "Exception", "No such")


def indexed_part(role: Column, text: Column, floor: int = 8192) -> Column:
    """What of a record is indexed: of an edit its first line; of tool output of so many bytes the telling lines, each with the next one, or its two ends.

    The ends are cut by characters, where all are ASCII by bytes.
    """
    lines = F.split(text, "\n", -1)
    telling = lambda x: holds(x, SIGNALS)
    kept = F.filter(lines, lambda x, i: telling(x) | ((i > 0) & telling(F.coalesce(F.get(lines, i - 1), F.lit("")))))
    ends = F.when(F.octet_length(text) <= floor + floor // 2, text).otherwise(F.concat(F.left(text, F.lit(floor)), F.lit("\n"), F.right(text, F.lit(floor // 2))))
    long_ = F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n"), F.lit("\n"))).otherwise(ends)
    return F.when(role == "edit", F.substring_index(text, "\n", 1)).when((role == "tool-output") & (F.octet_length(text) >= floor), long_).otherwise(text)


def friction(line: Column) -> Column:
    """The line without a shell's position before it if it names something that went wrong, else null."""
    t = stripped(line)
    t = stripped(F.regexp_replace(t, r"^[^:]{1,16}:[+-]?\d+: ", ""))
    wrong = F.char_length(t).between(20, 120) & ~begins(t, NO_FRICTION_BEGIN) & ~holds(t, NO_FRICTION_HOLD) & ~t.rlike(r"^\s*\d+\s* sessions  ") & holds(F.lower(t), FRICTION)
    return F.when(wrong, t)


def first_friction(text: Column) -> Column:
    """The first line that says so."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), friction), lambda x: x.isNotNull()), F.lit(0))


def gives_up(line: Column) -> Column:
    """Whether a line reports that something was taken back: not code, not denied, not asked, not still ahead."""
    t = stripped(line)
    spoken = F.char_length(t).between(12, 300)
    t = stripped(F.regexp_replace(t, r"^[*>] ", ""))
    code = begins(t, ("//", "#", "/*", "--", "- ", "+ ", "|")) | holds(t, ('("', "('", "=~", "println", "printf(", "system("))
    low = F.lower(t)

    def reports(phrase: str) -> Column:
        before, rest = F.substring_index(low, phrase, 1), F.substring(low, F.instr(low, phrase) + len(phrase), F.lit(1 << 20))
        ends = r"(?:\. |! |\? |; |— | - |, )"
        clause_before = F.regexp_extract(before, rf"(?s)^(?:.*{ends})?(.*)$", 1)
        clause = F.concat(clause_before, F.lit(phrase), F.regexp_extract(rest, rf"(?s)^(.*?)(?:{ends}|$)", 1))
        c = stripped(clause)
        copula = c.rlike(r"^(?:is|are|was|were) ") & ~begins(c, tuple(f"{x} {phrase}" for x in ("is", "are", "was", "were")))
        return F.contains(low, F.lit(phrase)) & ~begins(rest, REFLEXIVE) & ~holds(clause_before, DENYING) & ~begins(c, CLAUSE_ASKS) & ~copula & ~F.endswith(c, F.lit("?"))

    any_ = F.lit(False)
    for p in GIVE_UP:
        any_ = any_ | reports(p)
    return spoken & ~code & any_


def decides(text: Column) -> Column:
    """Whether a text says what was decided."""
    return holds(F.lower(text), DECISIONS)


def sentences(text: Column) -> Column:
    """Sentences up to a mark or line end; a full stop within a word ends none."""
    return F.filter(F.transform(F.split(text, r"(?<=[!?\n])|(?<=\.)(?=[ \n\t]|$)"), stripped), lambda s: s != "")


def clipped(text: Column, most: int = 260) -> Column:
    """On one line, cut at a word's end before so many bytes."""
    flat = one_line(text)
    cut = F.regexp_extract(F.left(flat, F.lit(most + 1)), r"^(.*)[ ]", 1)
    return F.when(F.octet_length(flat) <= most, flat).otherwise(F.concat(stripped(F.when(cut != "", cut).otherwise(F.left(flat, F.lit(most)))), F.lit("…")))


def decision_text(text: Column, most: int = 260) -> Column:
    """The first sentence that decides, with the next one if both are short, else the beginning."""
    s = sentences(stripped(text))
    at = F.array_position(F.transform(s, decides), True).cast("int")
    found, after = F.element_at(s, F.greatest(at, F.lit(1))), F.get(s, at)
    both = F.when(F.coalesce(F.octet_length(found) + F.octet_length(after) < most, F.lit(False)), F.concat_ws(" ", found, after)).otherwise(found)
    return clipped(F.when(at > 0, both).otherwise(stripped(text)), most)


def word_set(text: Column) -> Column:
    """Distinct words of three characters or more and CJK pairs."""
    return F.array_union(F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))), lambda w: F.char_length(w) >= 3), cjk_bigrams(text))


def document_length(text: Column) -> Column:
    """Words, where a run counts its CJK characters one by one and what else it holds once."""
    runs = F.regexp_extract_all(text, F.lit(rf"[\p{{L}}\p{{Nd}}_\-{KANA_MARKS}]+"), F.lit(0))
    runs = F.filter(runs, lambda r: r.rlike(r"[\p{L}\p{Nd}_-]"))
    each = lambda r: F.regexp_count(r, F.lit(f"[{CJK}]")) + r.rlike(f"[^{CJK}]").cast("int")
    return F.aggregate(F.transform(runs, each), F.lit(0), lambda a, b: a + b)


def occurrences(low: Column, term: str) -> Column:
    """How often a text holds a term, not counting overlaps."""
    return F.regexp_count(low, F.lit(r"\Q" + term + r"\E"))


def match_count(text: Column, terms: list[str], phrases: list[str] = (), variants: dict[str, list[str]] | None = None) -> Column:
    """Occurrences of all terms (each with its variants) and phrases, none if one is missing."""
    low = F.lower(text)
    each = [sum((occurrences(low, v) for v in (variants or {}).get(t, ())), occurrences(low, t)) for t in terms]
    total = sum((occurrences(low, p) for p in phrases), sum(each, F.lit(0)))
    missing = F.lit(False)
    for n in (*each, *(occurrences(low, p) for p in phrases)):
        missing = missing | (n == 0)
    return F.when(missing, 0).otherwise(total)


def has_word(low: Column, term: str) -> Column:
    """Whether a term begins a word, and if it is of four characters or fewer also ends it."""
    w = r"[\p{L}\p{Nd}]"
    return low.rlike(rf"(?<!{w})\Q{term}\E" + (rf"(?!{w})" if len(term) <= 4 else ""))


def term_hits(text: Column, terms: list[str], stem_from: int = 6) -> Column:
    """How many terms, or longer terms without their last two characters, a text holds as words."""
    low = F.lower(text)
    one = lambda t: has_word(low, t) | (has_word(low, t[:-2]) if len(t) >= stem_from else F.lit(False))
    return sum((one(t).cast("int") for t in terms if t), F.lit(0))


def is_prose(line: Column) -> Column:
    """Short lines, or lines that are mostly letters in words, or mostly CJK."""
    n, letters = F.char_length(line), F.regexp_count(line, F.lit(r"[a-zA-Z\x{80}-\x{10ffff}]"))
    wordy = F.size(F.filter(fields(line), lambda f: (F.octet_length(f) >= 2) & f.rlike(r"[a-zA-Z\x{80}-\x{10ffff}]")))
    cjk = F.regexp_count(line, F.lit(f"[{CJK}]"))
    return (F.octet_length(line) < 80) | ((cjk >= 8) & (F.floor(cjk * 100 / n) >= 50)) | ((wordy >= 4) & (F.floor(letters * 100 / n) >= 45))


def is_listing(line: Column) -> Column:
    """Eight fields or more, none of them a function word."""
    f = F.transform(fields(F.lower(line)), lambda w: F.regexp_replace(w, r"^[.,!?:;]+|[.,!?:;]+$", ""))
    return (F.size(f) >= 8) & (F.size(F.array_intersect(f, F.array(*map(F.lit, LISTING_STOPS)))) == 0)


def is_noise_line(line: Column) -> Column:
    """Numbered lines, finds with a file's place, shell errors, numbers alone, listings."""
    return line.rlike(r"^\s*\d{1,6}\s|^\S+\.[a-z]{1,5}:\d+[:)]|^\((?:eval|\w*sh)\):\d*:?|^[\d\s.,%-]+$") | is_listing(line)


def is_data(text: Column) -> Column:
    """Long JSON, or more than 200 characters without a space."""
    return ((F.octet_length(text) > 400) & text.rlike(r"^[{\[]") & F.contains(text, F.lit('":"'))) | text.rlike(r"[^ \n\t]{201}")


def snippet_text(text: Column) -> Column:
    """On one line, without numbered lines and tool output; the whole text if nothing else is left."""
    lines = F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: (x != "") & ~x.rlike(r"^\s*\d{1,5}[:|]\s+|(?i)tool_use|tool_result|<local-command|netcat|npm ERR!|panic:|goroutine \d+"))
    return once(one_line(F.array_join(lines, " ")), lambda prose: F.when(prose != "", prose).otherwise(one_line(text)))


def is_blocked(conclusions: Column) -> Column:
    """Whether all of some conclusions are refusals."""
    return (F.size(conclusions) > 0) & F.forall(conclusions, lambda c: holds(F.lower(c), BLOCKED))


def is_smoke_test(problem: Column, conclusions: Column, most: int = 20) -> Column:
    """An order to say something, and hardly anything said."""
    said = F.aggregate(F.transform(conclusions, F.octet_length), F.lit(0), lambda a, b: a + b)
    return (said <= most) & F.exists(sentences(F.lower(stripped(problem))), lambda s: begins(s, SMOKE))


def is_self_test(text: Column) -> Column:
    """A message that only tests the wiring."""
    return holds(F.lower(text), SELF_TEST)


# Shell and version-control commands that only look.
LOOKING = "ls cat pwd echo which whoami date env printenv head tail less more stat file find tree df du ps top htop id uname hostname clear history".split()
LOOKING_GIT = "status diff log show branch remote stash blame reflog describe rev-parse ls-files".split()


def is_inspection(command: Column) -> Column:
    """Commands that change nothing, and none at all."""
    f = fields(F.lower(F.regexp_replace(stripped(command), r"^\$ ", "")))
    first, second = F.get(f, F.lit(0)), F.coalesce(F.get(f, F.lit(1)), F.lit(""))
    return (F.size(f) == 0) | F.coalesce(first.isin(LOOKING) | ((first == "git") & second.isin(LOOKING_GIT)), F.lit(False))


# Commands that say what was done, and those that only move about.
TELLING = (
    r"\b(?:go (?:test|build|vet|run)|golangci-lint|gofmt|pytest|python3? -m|uv (?:run|pip)|pip install|ruff|mypy|npm|npx|pnpm|yarn|bun |cargo |make\b|cmake|ctest|ninja|meson|bazel|buck2|gh (?:pr|run|release|issue|workflow|api)|git [a-z-]+"
    r"|docker|kubectl|helm|terraform|psql|mysql|latexmk|mvn|gradle|dotnet|swift (?:build|test)|bundle exec|rails|rake|rspec|phpunit|composer (?:install|update|require)|tox|nox|jest|vitest|playwright|cypress|deno|tsc|sbt"
    r"|stack (?:build|test|run|exec)|cabal|ghc|dune|zig|nix|rustc|clang\+\+|clang|g\+\+|gcc|pdm run|poetry run)"
)
TRIVIAL = r"^\s*(?:ls|cd|pwd|cat|head|tail|echo|grep|rg|find|which|wc|sed|awk|sleep|mkdir|rm|cp|mv|chmod|export|source|touch|open|printf)\b"


def is_telling(command: Column) -> Column:
    """Commands of one line of which a chained part says what was done."""
    return ~F.contains(command, F.lit("\n")) & F.exists(F.split(command, r"&&|\|\||;|\|"), lambda s: s.rlike(TELLING) & ~s.rlike(TRIVIAL))


def is_scratch(path: Column) -> Column:
    """Working files of agents and tools, caches and logs."""
    return holds(path, ("/scratchpad/", "/tasks/", "/.claude/", "/.cache/", "/claude-501/", "/node_modules/", "/.git/", "/testdata/fixtures/")) | path.rlike(r"\.(?:output|log)$")


def unwrapped(text: Column, marks: tuple[str, ...] = ("recall",)) -> Column:
    """Without blocks that were recalled or injected (an open recall goes to the end), without injected lines; queries keep their content.

    Blocks are taken as not nested.
    """
    out = text
    for m in marks:
        for a, b in (("<", ">"), ("&lt;", "&gt;")):
            out = F.regexp_replace(out, rf"(?s)\Q{a}{m}{b}\E.*?(?:\Q{a}/{m}{b}\E|\z)", "")
    for a, b in (("<system-reminder>", "</system-reminder>"), ("<local-command-caveat>", "</local-command-caveat>"), ("<command-name>", "</command-args>")):
        out = F.regexp_replace(out, rf"(?s)\Q{a}\E.*?\Q{b}\E", "")
    for tag in ("user_query", "hook_context"):
        out = F.regexp_replace(out, rf"(?s)<{tag}>(.*?)</{tag}>", "$1")
    blocks = "|".join(rf"\Q<{t}>\E.*?\Q</{t}>\E" for t in ("session_context", "timestamp", "environment_context", "recommended_plugins", "permissions instructions", "skills_instructions", "user_instructions"))
    out = F.regexp_replace(out, rf"(?s)^\s*(?:(?:{blocks}|# AGENTS\.md instructions\s*<INSTRUCTIONS>.*?</INSTRUCTIONS>)\s*)+", "")
    lines = ("This session is being continued from a previous conversation", "[Request interrupted by user", "[Your previous response had no visible output", "UserPromptSubmit hook additional context:", "SessionStart hook additional context:")
    return F.array_join(F.filter(F.split(out, "\n", -1), lambda x: ~begins(stripped(x), lines)), "\n")
