"""Named queries that put the functions of texts, times and paths to whole tables; each SQL works the same rows out by its own means.

Where a table lacks what a function looks for, each row's own words are put into a form that holds it, and the SQL says
from the form alone what must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import redact as R
from ..functions import scalars as S
from ..sources.tables import messages, table

_MESSAGES = "(SELECT conv_id AS session_id, turn AS seq, role, text FROM conversations)"
_RUN = r"[\p{L}\p{Nd}_-]"
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}"
#: Sentences of a text: each mark, and each full stop before white space, ends one.
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim({0}, ' ' || chr(10) || chr(9)), '([!?\n])', '\1' || chr(1), 'g'), '[.]([ \n\t]|$)', '.' || chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x != '')"


def _documents(s, d):
    return table(s, d, "documents")


def _digest(words):
    return F.md5(F.array_join(words, "|").cast("binary"))


def forms(key: str, shapes: list[str]):
    """Which shape a row's word is put into, by its key, as a column and as SQL; {} stands for the word."""
    pick = F.element_at(F.array(*map(F.lit, shapes)), (F.pmod(F.col(key), F.lit(len(shapes))) + 1).cast("int"))
    return F.replace(pick, F.lit("{}"), F.col("word"))


def _tokens(s, d):
    """Every second message is taken without its spaces, so that runs are long and are cut."""
    m = messages(s, d).withColumn("tokens", L.index_tokens(F.when(F.col("seq") % 2 == 1, F.translate("text", " ,.\n", "")).otherwise(F.col("text"))))
    return m.select("session_id", "seq", F.size("tokens").alias("tokens"), _digest("tokens").alias("digest"))


_TOKENS_SQL = rf"""
    WITH m AS (SELECT session_id, seq, lower(CASE WHEN seq % 2 = 1 THEN translate(text, ' ,.' || chr(10), '') ELSE text END) AS text FROM {_MESSAGES}),
    r AS (SELECT session_id, seq, unnest(regexp_extract_all(text, '{_RUN}+')) AS run FROM m),
    c AS (SELECT *, list_reduce(list_transform(string_split(run, ''), lambda c: {{'done': '', 'now': c}}),
                lambda a, b: CASE WHEN strlen(a.now) > 64 THEN {{'done': a.done || a.now || chr(1), 'now': b.now}} ELSE {{'done': a.done, 'now': a.now || b.now}} END) AS p FROM r),
    t AS (SELECT DISTINCT session_id, seq, unnest(string_split(p.done || p.now, chr(1))) AS t FROM c),
    g AS (SELECT session_id, seq, count(*)::INTEGER AS tokens, md5(string_agg(t, '|' ORDER BY strlen(t) DESC, t)) AS digest FROM t WHERE strlen(t) >= 2 GROUP BY ALL)
    SELECT session_id, seq, coalesce(tokens, 0)::INTEGER AS tokens, coalesce(digest, md5('')) AS digest FROM m LEFT JOIN g USING (session_id, seq)"""


def _parts(s, d):
    """Sentences run together and words joined, so that words have humps and underscores."""
    text = F.replace(F.replace("text", F.lit(". "), F.lit("")), F.lit(", "), F.lit("_"))
    m = messages(s, d).withColumn("parts", L.identifier_parts(text))
    return m.select("session_id", "seq", F.size("parts").alias("parts"), _digest("parts").alias("digest"))


_PARTS_SQL = rf"""
    WITH m AS (SELECT session_id, seq, regexp_extract_all(replace(replace(text, '. ', ''), ', ', '_'), '{_RUN}{{1,65}}') AS w FROM {_MESSAGES}),
    p AS (SELECT session_id, seq, list_transform(list_filter(w, lambda x: length(x) >= 6), lambda x: string_split(regexp_replace(regexp_replace(regexp_replace(x,
            '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1' || chr(1) || '\2', 'g'), '(.)[_-]', '\1' || chr(1), 'g'), chr(1))) AS p FROM m),
    k AS (SELECT session_id, seq, list_transform(list_filter(flatten(list_filter(p, lambda x: len(x) > 1)), lambda x: length(x) >= 3), lambda x: lower(x)) AS k FROM p)
    SELECT session_id, seq, len(k)::INTEGER AS parts, md5(array_to_string(k, '|')) AS digest FROM k"""


def _composed(s, d):
    text = S.nfc(F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("ü"), F.lit("ü")))
    return messages(s, d).select("session_id", "seq", F.md5(text.cast("binary")).alias("digest"), F.char_length(text).alias("chars"))


def _sentences(s, d):
    own = _documents(s, d).withColumn("s", L.sentences(L.stripped(F.col("text"))))
    return own.select("doc_id", F.size("s").alias("sentences"), F.coalesce(F.array_max(F.transform("s", F.char_length)), F.lit(0)).alias("longest"), _digest("s").alias("digest"))


def _questions(s, d):
    own = _documents(s, d).select("lang", F.explode(L.sentences(L.stripped(F.col("text")))).alias("sentence"))
    return own.groupBy("lang").agg(F.count("*").alias("sentences"), F.count_if(L.is_question(F.col("sentence"))).alias("questions"), F.count_if(L.question_stem(F.col("sentence")) != "").alias("stems"), F.sum(F.char_length(L.question_stem(F.col("sentence")))).alias("stem_chars"))


def _words(s, d):
    own = _documents(s, d).withColumn("w", F.array_sort(L.word_set(F.replace("text", F.lit(" the "), F.lit(" 東京都 the "))))).select("doc_id", "w")
    return own.select("doc_id", F.size("w").alias("words"), _digest("w").alias("digest"))


def _lengths(s, d):
    return _documents(s, d).select("doc_id", L.document_length(F.replace("text", F.lit(" the "), F.lit(" the東京 京 "))).alias("words"))


_HITS = ["the", "onering", "und", "eauenaux", "elle", "verlichen"]


def _hit_sql(term: str) -> str:
    begins = lambda t: rf"regexp_matches(l, '(^|[^\p{{L}}\p{{Nd}}]){t}" + (r"([^\p{L}\p{Nd}]|$)" if len(t) <= 4 else "") + "')"
    return f"({begins(term)}" + (f" OR {begins(term[:-2])}" if len(term) >= 6 else "") + ")::INTEGER"


def _often(term: str) -> str:
    return f"((length(l) - length(replace(l, '{term}', ''))) / {len(term)})::INTEGER"


def _lines(s, d):
    own = _documents(s, d).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    x = F.col("line")
    return own.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(L.is_prose(x)).alias("prose"), F.count_if(L.is_listing(x)).alias("listings"), F.count_if(L.is_noise_line(x)).alias("noise"), F.count_if(L.is_data(x)).alias("data"))


_LINES_SQL = rf"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL),
    f AS (SELECT *, list_filter(regexp_split_to_array(x, '[\s\x0b\x{{85}}\p{{Z}}]+'), lambda w: w != '') AS f,
                 len(regexp_extract_all(x, '[a-zA-Z]|[^\x00-\x7f]')) AS letters, len(regexp_extract_all(x, '[{_CJK}ーｰﾞﾟ〆]')) AS cjk FROM l),
    g AS (SELECT *, len(f) >= 8 AND len(list_filter(f, lambda w: list_contains({L.LISTING_STOPS}, trim(lower(w), '.,!?:;')))) = 0 AS listing FROM f)
    SELECT doc_id, count(*) AS lines,
           count(*) FILTER (strlen(x) < 80 OR (cjk >= 8 AND cjk * 100 // length(x) >= 50) OR (len(list_filter(f, lambda w: strlen(w) >= 2 AND regexp_matches(w, '[a-zA-Z]|[^\x00-\x7f]'))) >= 4 AND letters * 100 // length(x) >= 45)) AS prose,
           count(*) FILTER (listing) AS listings,
           count(*) FILTER (listing OR regexp_matches(x, '^\s*[0-9]{{1,6}}\s') OR regexp_matches(x, '^\S+[.][a-z]{{1,5}}:[0-9]+[:)]') OR regexp_matches(x, '^[(](eval|\w*sh)[)]:[0-9]*:?') OR regexp_matches(x, '^[0-9\s.,%-]+$')) AS noise,
           count(*) FILTER ((strlen(x) > 400 AND x[1] IN ('{{', '[') AND contains(x, '":"')) OR list_max(list_transform(string_split(replace(x, chr(9), ' '), ' '), lambda w: length(w))) > 200) AS data
    FROM g GROUP BY doc_id"""


def _mentions(s, d):
    """Of the first 256 mentions, as its SQL has it."""
    return _documents(s, d).select("doc_id", S.densest_mention(F.col("text"), "the", first=256).alias("place"))


_MENTIONS_SQL = """
    WITH p AS (SELECT doc_id, unnest(string_split(lower(text), 'the')) AS part, generate_subscripts(string_split(lower(text), 'the'), 1) AS i FROM documents),
    a AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n, (sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) + 3 * (i - 1))::BIGINT AS spot FROM p),
    m AS (SELECT doc_id, spot FROM a WHERE i < n AND i <= 256),
    c AS (SELECT doc_id, spot, count(*) OVER (PARTITION BY doc_id ORDER BY spot RANGE BETWEEN CURRENT ROW AND 200 FOLLOWING) AS n FROM m),
    b AS (SELECT doc_id, arg_min(spot, (-n, spot)) AS spot FROM c GROUP BY doc_id)
    SELECT doc_id, coalesce(spot, CASE WHEN text IS NOT NULL THEN -1 END)::INTEGER AS place FROM documents LEFT JOIN b USING (doc_id)"""


def _windows(s, d):
    return _documents(s, d).select("doc_id", S.covering_window(F.col("text"), ["eau", "que"]).alias("bytes"))


_WINDOWS_SQL = """
    WITH p AS (SELECT doc_id, t, unnest(string_split(lower(text), t)) AS part, generate_subscripts(string_split(lower(text), t), 1) AS i FROM documents, (VALUES ('eau'), ('que')) v(t)),
    a AS (SELECT doc_id, t, i, count(*) OVER (PARTITION BY doc_id, t) AS n, (sum(strlen(part)) OVER (PARTITION BY doc_id, t ORDER BY i) + 3 * (i - 1))::BIGINT AS spot FROM p),
    m AS (SELECT doc_id, t, spot FROM a WHERE i < n),
    f AS (SELECT doc_id, count(*) AS terms, max(spot) - min(spot) + 3 AS span FROM (SELECT doc_id, t, min(spot) AS spot FROM m GROUP BY ALL) GROUP BY doc_id),
    w AS (SELECT doc_id, min(spot - before + 3) AS least FROM (SELECT *, lag(spot) OVER o AS before, lag(t) OVER o AS other FROM m WINDOW o AS (PARTITION BY doc_id ORDER BY spot)) WHERE other != t GROUP BY doc_id)
    SELECT doc_id, CASE WHEN coalesce(terms, 0) < 2 THEN 0 WHEN span <= 200 THEN span ELSE least END::INTEGER AS bytes FROM documents LEFT JOIN f USING (doc_id) LEFT JOIN w USING (doc_id)"""


def _safe(s, d):
    text = F.replace(F.replace("html", F.lit("<"), F.lit("\x1b[1m<")), F.lit(">"), F.lit(">\x07\x1b]0;title\x1b\\"))
    shown = R.safe(text)
    return table(s, d, "pages").select("page_id", F.char_length(shown).alias("chars"), F.md5(shown.cast("binary")).alias("digest"))


_SAFE_SQL = r"""
    WITH p AS (SELECT page_id, regexp_replace(replace(replace(html, chr(13) || chr(10), chr(10)), '>', '> '), '[\x00-\x08\x0b-\x1f\x7f-\x{9f}\x{ad}\x{61c}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}\x{2066}-\x{2069}\x{feff}]', ' ', 'g') AS t FROM pages)
    SELECT page_id, length(t)::INTEGER AS chars, md5(t) AS digest FROM p"""


def _order_dates(s, d):
    o = table(s, d, "orders").select(S.relative_date(F.col("o_orderdate").cast("timestamp"), F.lit("1998-08-02 12:00:00").cast("timestamp")).alias("shown"), F.array_join(L.date_tokens(F.col("o_orderdate").cast("timestamp")), " ").alias("tokens"))
    return o.groupBy("shown", "tokens").agg(F.count("*").alias("orders"))


_ORDER_DATES_SQL = """
    WITH o AS (SELECT o_orderdate::DATE AS x, date_diff('day', o_orderdate::DATE, DATE '1998-08-02') AS days FROM orders)
    SELECT CASE WHEN days = 0 THEN 'today' WHEN days BETWEEN 1 AND 6 THEN days || 'd ago' WHEN year(x) = 1998 THEN strftime(x, '%b %-d') ELSE strftime(x, '%b %-d %Y') END AS shown,
           lower(monthname(x)) || ' ' || strftime(x, '%Y') || ' ' || strftime(x, '%Y-%m') AS tokens, count(*) AS orders FROM o GROUP BY ALL"""


def _times(s, d):
    """Each event's time as one of seven layouts, read again."""
    ts, k = F.col("ts").cast("timestamp"), F.pmod("event_id", F.lit(7))
    iso = lambda f: F.date_format("ts", f)
    raw = (
        F.when(k == 0, iso("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(k == 1, iso("yyyy-MM-dd HH:mm:ss")).when(k == 2, iso("yyyy-MM-dd'T'HH:mm")).when(k == 3, F.concat(iso("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
        .when(k == 4, F.unix_seconds(ts).cast("string")).when(k == 5, F.unix_millis(ts).cast("string")).otherwise(F.concat(F.lit("at "), iso("HH:mm")))
    )
    return table(s, d, "events").select("event_id", F.date_format(S.lenient_time(raw), "yyyy-MM-dd HH:mm:ss.SSS").alias("read"))


_TIMES_SQL = """
    SELECT event_id, strftime(CASE event_id % 7 WHEN 0 THEN date_trunc('millisecond', ts) WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('minute', ts) WHEN 3 THEN date_trunc('second', ts) - INTERVAL 2 HOUR
                                WHEN 4 THEN date_trunc('second', ts) WHEN 5 THEN date_trunc('millisecond', ts) END, '%Y-%m-%d %H:%M:%S.%g') AS read FROM events"""


def _sparks(s, d):
    """Each kind's events by hour of the day, as a row of blocks, and a bar for the whole."""
    by = table(s, d, "events").groupBy(F.col("event_type").alias("kind"), F.hour("ts").alias("hour")).agg(F.count("*").cast("int").alias("n"))
    kinds = by.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("hour", "n"))).alias("hours"), F.sum("n").cast("int").alias("events"))  # 24 hours a kind
    most = kinds.agg(F.max("events").alias("most"))
    return kinds.crossJoin(F.broadcast(most)).select("kind", S.sparkline(F.transform("hours", lambda h: h["n"])).alias("line"), S.scaled_bar(F.col("events"), F.col("most"), 40).cast("long").alias("bar"))


_SPARKS_SQL = """
    WITH h AS (SELECT event_type AS kind, hour(ts) AS hour, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT *, max(n) OVER (PARTITION BY kind) AS most FROM h),
    k AS (SELECT kind, sum(n) AS events, string_agg('▁▂▃▄▅▆▇█'[(CASE WHEN n > 0 THEN (n - 1) * 7 // most + 1 ELSE 0 END + 1)::BIGINT], '' ORDER BY hour) AS line FROM m GROUP BY kind)
    SELECT kind, line, greatest(1, events * 40 // max(events) OVER ())::BIGINT AS bar FROM k"""


def _entropy(s, d):
    return R.bits(_documents(s, d), "doc_id").select("doc_id", F.abs(F.round("bits", 6)).alias("bits"))


_SECRETS = {
    "id AKIA{} end": ("aws-access-key", "id [redacted:aws-access-key] end"), "ghp_{}{} kept": ("github-token", "[redacted:github-token] kept"), "header Bearer {}": ("bearer-token", "header Bearer [redacted:bearer-token]"),
    "see postgres://me:{}@host/db now": ("url-credentials", "see postgres://me:[redacted:url-credentials]@host/db now"), "xoxb-{} ": ("slack-token", "[redacted:slack-token] "), "npm_{}{}": ("npm-token", "[redacted:npm-token]"),
    "gsk_{}{}": ("groq-key", "[redacted:groq-key]"), "commit {}": (None, None),
}


def _redacted(s, d):
    """Each document, which may hold a credential, with a line in which its text's digest is a secret."""
    own = _documents(s, d).withColumn("word", F.upper(F.left(F.md5(F.col("text").cast("binary")), F.lit(16))))
    rows = R.redacted(own.select("doc_id", F.concat("text", F.lit("\n"), forms("doc_id", list(_SECRETS))).alias("text")))
    found = F.transform(F.array_sort(F.map_entries("__kinds")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return rows.select("doc_id", F.array_join(found, ",").alias("kinds"), F.md5(F.col("text").cast("binary")).alias("digest"))


_VALUE = """'token = "[A-Za-z0-9/+=._-]{16,}"'"""
_PICK = lambda values: f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"
_REDACTED_SQL = f"""
    SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN n > 0 THEN 'credential=' || n END, {_PICK([f"'{k}=1'" if k else "NULL" for k, _ in _SECRETS.values()])}], lambda x: x IS NOT NULL)), ',') AS kinds,
           md5(regexp_replace(text, {_VALUE}, 'token = "[redacted:credential]"', 'g') || chr(10) || {_PICK([f"'{t}'" if t else "'commit ' || upper(left(md5(text), 16))" for _, t in _SECRETS.values()])}) AS digest
    FROM (SELECT *, len(regexp_extract_all(text, {_VALUE})) AS n FROM documents)"""
_FRICTION = ["zsh:1: command not found: {}", "  psql: FATAL: {}, Connection refused  ", "Error: cannot find module {} in the tree", 'echo "App not found: {}" in a script', "// panic: a comment about {}", "open /etc/{}/settings: no such file or directory", "everything went well in {} today", "12 sessions  command not found: {}"]
_GIVE_UP = ["We reverted the {} layer, it broke ordering", "* rolled back after the review of {}", "- reverted the old {} in this diff", "we haven't reverted the {} change at all", "if it fails we roll it back in {}", "was that rolled back in the end with {} or not", "was rolled back after {} yesterday", "I gave up on the {} cache"]
_WRAPPED = ["a <recall>{}</recall> b {}", "<system-reminder>{}</system-reminder>{}", "<user_query>{}</user_query>", "{}\n[Request interrupted by user]\n{}", "<timestamp>1</timestamp> <environment_context>{}</environment_context>\n{}", "<system-reminder>{}"]
_COMMANDS = ["cd {} && go test ./...", 'grep "go test" {}', "ls -la {}", "npm run {}", "git push | cat {}", "git status {}"]


def _page_paths(s, d):
    url = F.col("url")
    return table(s, d, "pages").select("page_id", S.base_name(url).alias("name"), S.project_name(F.regexp_replace(url, "[?#].*$", "")).alias("project"), S.path_matches(F.translate(url, "/", "\\"), "25").alias("matches"))


def _session_words(s, d):
    """The words of a session's first two messages, sixteen at most."""
    m = messages(s, d).groupBy("session_id").agg(*(F.max(F.when(F.col("seq") == k, F.split(F.lower("text"), " "))).alias(f"w{k}") for k in (0, 1))).where("w0 is not null and w1 is not null")
    return m.select("session_id", F.array_join(S.merged_capped(F.col("w0"), F.col("w1"), 16), "|").alias("words"))


_SESSION_WORDS_SQL = f"""
    WITH m AS (SELECT session_id, list_concat(max(string_split(lower(text), ' ')) FILTER (seq = 0), max(string_split(lower(text), ' ')) FILTER (seq = 1)) AS w FROM {_MESSAGES} WHERE seq < 2 GROUP BY session_id HAVING count(DISTINCT seq) = 2),
    u AS (SELECT session_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM m), f AS (SELECT session_id, t, min(i) AS i FROM u GROUP BY ALL)
    SELECT session_id, string_agg(t, '|' ORDER BY i) AS words FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY i) <= 16) GROUP BY session_id"""


def _tags(s, d):
    tags = F.transform(F.slice(F.split("text", " "), 1, 12), lambda w: F.concat(F.lit(" #"), w, F.lit(" ")))
    return _documents(s, d).select("doc_id", F.array_join(S.normal_tags(tags), "|").alias("tags"))


_TAGS_SQL = """
    WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')[1:12]) AS w, generate_subscripts(string_split(text, ' ')[1:12], 1) AS i FROM documents),
    f AS (SELECT doc_id, lower(rtrim(w, ' ' || chr(9) || chr(10))) AS t, min(i) AS i FROM w WHERE rtrim(w, ' ' || chr(9) || chr(10)) != '' GROUP BY ALL),
    k AS (SELECT doc_id, string_agg(t, '|' ORDER BY i) AS tags FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) <= 8) GROUP BY doc_id)
    SELECT doc_id, coalesce(tags, '') AS tags FROM documents LEFT JOIN k USING (doc_id)"""


def _marked(s, d):
    """Documents of which two thirds have all lines but the first one numbered or marked as a tool's."""
    put = F.when(F.col("doc_id") % 3 == 0, "\n12: ").when(F.col("doc_id") % 3 == 1, "\ntool_use ").otherwise("\n")
    return _documents(s, d).select("doc_id", F.replace("text", F.lit("\n"), put).alias("text"))


_FLAT_SQL = """
    WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x != '') AS l FROM documents),
    k AS (SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN l ELSE l[1:1] END AS k FROM l),
    f AS (SELECT doc_id, regexp_replace(array_to_string(k, ' '), '[ \t]+', ' ', 'g') AS flat FROM k)"""
_SNIPPET_SQL = f"""{_FLAT_SQL},
    p AS (SELECT doc_id, unnest(string_split(lower(flat), 'ion')) AS part, generate_subscripts(string_split(lower(flat), 'ion'), 1) AS i FROM f),
    a AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id) AS n, (sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i) + 3 * (i - 1))::BIGINT AS spot FROM p),
    m AS (SELECT doc_id, spot FROM a WHERE i < n),
    c AS (SELECT doc_id, spot, count(*) OVER (PARTITION BY doc_id ORDER BY spot RANGE BETWEEN CURRENT ROW AND 200 FOLLOWING) AS n FROM m),
    b AS (SELECT doc_id, greatest(arg_min(spot, (-n, spot)) - 100, 0) AS start FROM c GROUP BY doc_id),
    s AS (SELECT doc_id, flat, length(flat) AS n, CASE WHEN coalesce(start, 0) + 300 > length(flat) THEN greatest(length(flat) - 300, 0) ELSE coalesce(start, 0) END AS start FROM f LEFT JOIN b USING (doc_id))
    SELECT doc_id, CASE WHEN start > 0 THEN '… ' ELSE '' END || trim(substr(flat, start + 1, 300), ' ,.;:-') || CASE WHEN start + 300 < n THEN ' …' ELSE '' END AS shown FROM s"""


def _formed(shapes, **columns):
    """What some functions make of each document's first word, put into shapes by its id."""

    def query(s, d):
        own = _documents(s, d).withColumn("word", F.coalesce(F.regexp_extract("text", "[A-Za-z]+", 0), F.lit(""))).select("doc_id", forms("doc_id", shapes).alias("line"))
        return own.select("doc_id", *(f(F.col("line")).alias(k) for k, f in columns.items()))

    return query


def _formed_sql(*columns: tuple[str, list[str]]) -> str:
    """For each shape in order the SQL of what comes out; w is the word."""
    each = (f"CASE doc_id % {len(gives)} " + " ".join(f"WHEN {i} THEN {g}" for i, g in enumerate(gives)) + f" END AS {name}" for name, gives in columns)
    return f"SELECT doc_id, {', '.join(each)} FROM (SELECT doc_id, coalesce(regexp_extract(text, '[A-Za-z]+'), '') AS w FROM documents)"


def _long(text: str, least: int = 20, most: int = 120) -> str:
    return f"CASE WHEN length({text}) BETWEEN {least} AND {most} THEN {text} END"


ALL = {
    "t01_message_tokens": (_tokens, _TOKENS_SQL),
    "t02_message_parts": (_parts, _PARTS_SQL),
    "t05_composed_messages": (_composed, f"SELECT session_id, seq, md5(nfc_normalize(text)) AS digest, length(nfc_normalize(text))::INTEGER AS chars FROM {_MESSAGES}"),
    "t19_document_matches": (lambda s, d: _documents(s, d).select("doc_id", L.match_count(F.col("text"), ["the", "and"], ["the "], {"and": ["under"]}).alias("n")), f"SELECT doc_id, CASE WHEN {_often('the')} = 0 OR {_often('and')} + {_often('under')} = 0 OR {_often('the ')} = 0 THEN 0 ELSE {_often('the')} + {_often('and')} + {_often('under')} + {_often('the ')} END AS n FROM (SELECT doc_id, lower(text) AS l FROM documents)"),
    "t20_document_lengths": (_lengths, rf"SELECT doc_id, coalesce(list_sum(list_transform(regexp_extract_all(replace(text, ' the ', ' the東京 京 '), '{_RUN}+'), lambda r: len(regexp_extract_all(r, '[{_CJK}]')) + regexp_matches(r, '[^{_CJK}]')::INTEGER)), 0)::INTEGER AS words FROM documents"),
    "t21_document_sentences": (_sentences, f"SELECT doc_id, len(s)::INTEGER AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INTEGER AS longest, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents)"),
    "p11_sentence_questions": (_questions, rf"""
        WITH q AS (SELECT lang, unnest({_SENTENCES.format("text")}) AS x FROM documents), w AS (SELECT *, regexp_extract_all(lower(x), '{_RUN}+') AS w, trim(lower(regexp_extract(x, '^[^ \t\n]+')), ',.:;!"''') AS first FROM q),
        t AS (SELECT *, CASE WHEN len(w) >= 5 THEN length(array_to_string(w, ' ')) ELSE 0 END AS stem FROM w)
        SELECT lang, count(*) AS sentences, count(*) FILTER (length(x) <= 240 AND (suffix(x, '?') OR list_contains({L.ASKING}, first))) AS questions, count(*) FILTER (stem > 0) AS stems, sum(stem)::BIGINT AS stem_chars FROM t GROUP BY lang"""),
    "t22_document_word_sets": (_words, rf"SELECT doc_id, len(w)::INTEGER AS words, md5(array_to_string(w, '|')) AS digest FROM (SELECT doc_id, list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(lower(replace(text, ' the ', ' 東京都 the ')), '[\p{{L}}\p{{Nd}}]+'), lambda x: length(x) >= 3), CASE WHEN contains(text, ' the ') THEN ['東京', '京都'] ELSE [] END))) AS w FROM documents)"),
    "t23_document_term_hits": (lambda s, d: _documents(s, d).select("doc_id", L.term_hits(F.col("text"), _HITS).alias("n")), f"SELECT doc_id, {' + '.join(map(_hit_sql, _HITS))} AS n FROM (SELECT doc_id, lower(text) AS l FROM documents)"),
    "p21_document_lines": (_lines, _LINES_SQL),
    "w12_document_mentions": (_mentions, _MENTIONS_SQL),
    "r15_document_windows": (_windows, _WINDOWS_SQL),
    "f02_document_entropy": (_entropy, "SELECT doc_id, abs(round(bits, 6)) AS bits FROM documents LEFT JOIN (SELECT doc_id, entropy(c) AS bits FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY doc_id) USING (doc_id)"),
    "f03_safe_pages": (_safe, _SAFE_SQL),
    "f10_trimmed_documents": (lambda s, d: _documents(s, d).select("doc_id", S.trimmed(F.col("text"), 200).alias("shown")), "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 199) || '…' ELSE text END AS shown FROM documents"),
    "f07_order_dates": (_order_dates, _ORDER_DATES_SQL),
    "s26_event_times": (_times, _TIMES_SQL),
    "f11_event_sparklines": (_sparks, _SPARKS_SQL),
    "p12_friction_lines": (_formed(_FRICTION, friction=L.friction), _formed_sql(("friction", [_long("'command not found: ' || w"), _long("'psql: FATAL: ' || w || ', Connection refused'"), "NULL", "NULL", "NULL", _long("'open /etc/' || w || '/settings: no such file or directory'"), "NULL", "NULL"]))),
    "p13_given_up": (_formed(_GIVE_UP, gives_up=L.gives_up), _formed_sql(("gives_up", "true true false false false false true true".split()))),
    "t17_unwrapped_documents": (_formed(_WRAPPED, shown=L.unwrapped), _formed_sql(("shown", ["'a  b ' || w", "w", "w", "w || chr(10) || w", "w", "'<system-reminder>' || w"]))),
    "s25_document_commands": (_formed(_COMMANDS, telling=L.is_telling, looks=L.is_inspection), _formed_sql(("telling", "true false false true true true".split()), ("looks", "false false true false false true".split()))),
    "t24_page_paths": (_page_paths, r"SELECT page_id, regexp_extract(url, '[^/]*$') AS name, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1) AS project, suffix(url, '/25') AS matches FROM pages"),
    "f17_session_words": (_session_words, _SESSION_WORDS_SQL),
    "f19_document_tags": (_tags, _TAGS_SQL),
    "t25_document_excerpts": (lambda s, d: _marked(s, d).select("doc_id", F.md5(L.snippet_text(F.col("text")).cast("binary")).alias("digest")), f"{_FLAT_SQL} SELECT doc_id, md5(flat) AS digest FROM f"),
    "t18_document_snippets": (lambda s, d: _marked(s, d).select("doc_id", S.snippet(F.col("text"), "ion").alias("shown")), _SNIPPET_SQL),
    "f01_redacted_documents": (_redacted, _REDACTED_SQL),
}
