import datetime as dt
import os
import random

from pyspark.sql import functions as F

from palaver.operators.increments import Postings, rebuilt
from palaver.operators.planner import Store
from palaver.operators.recall import densest, plan_walls
from palaver.sources.scratch import shared_dir
from palaver.streaming.cooldown import run_to_end, shown
from palaver.streaming.sync import RECORD, Outbox

T = dt.datetime(2026, 1, 1)


def local(path):
    return path.removeprefix("file://")


def test_postings_after_three_updates_equal_a_rebuild(spark):
    word = lambda r: "".join(r.choice("abc") for _ in range(3))
    r = random.Random(5)
    text = lambda: " ".join(word(r) for _ in range(4))
    files = {f"/f{i}": [text() for _ in range(3)] for i in range(6)}
    schema = "path string, session_id long, seq long, text string, ts timestamp"
    rows = lambda own, first=0: [(p, int(p[2:]), n, t, None) for p, ts in own.items() for n, t in enumerate(ts) if n >= first]
    store = Postings(spark, shared_dir(spark))
    change = lambda own: spark.createDataFrame(own, "path string, what string")
    same = lambda: sorted(map(tuple, store.read().distinct().collect())) == sorted(map(tuple, rebuilt(spark.createDataFrame(rows(files), schema)).collect()))
    store.update(spark.createDataFrame(rows(files), schema), change([(p, "new") for p in files]))
    assert same()
    before = store.live(0)
    # one file grows by a word of its own: only its buckets get a generation, nothing is written anew
    files["/f1"] = [*files["/f1"], "zzz"]
    anew, added = store.update(spark.createDataFrame([("/f1", 1, 3, "zzz", None)], schema), change([("/f1", "grown")]))
    assert same() and not anew and len(added) == 1
    assert all(g == before.get(b, []) for b, g in store.live(1).items() if b not in added)
    # one changes, one goes: buckets without their tokens keep their files
    files["/f2"], gone = ["abc zzz"], files.pop("/f3")
    anew, _ = store.update(spark.createDataFrame([("/f2", 2, 0, "abc zzz", None)], schema), change([("/f2", "changed"), ("/f3", "gone")]))
    assert same() and anew and gone
    assert store.read(["zzz"]).select("path", "seq").distinct().count() == 2
    assert {b: g for b, g in store.live(2).items() if b not in anew and 2 not in g} == {b: g for b, g in store.live(1).items() if b not in anew and 2 not in store.live(2)[b]}
    # an update that stopped before its table of live generations has changed nothing, and can run again
    spark.createDataFrame([], "token string").write.parquet(f"{store.folder}/rows/3")
    assert same() and store.newest() == 2


def test_marks_move_after_delivery_and_held_records_pin_them(spark):
    folder = shared_dir(spark)
    box = Outbox(spark, ["north", "south"])
    box.held = lambda project: project == "secret"

    def arrive(*records):
        spark.createDataFrame([("a", None if m is None else T + dt.timedelta(minutes=m), i, p) for i, m, p in records], RECORD).coalesce(1).write.mode("append").parquet(folder)
        box.deliver(spark.readStream.schema(RECORD).parquet(folder))

    sent = lambda batch: sorted({r.record for r in box.delivered().where(F.col("batch") == batch).collect()})
    mark = lambda batch: {(r.mark - T).seconds // 60 for r in box.marks(batch).collect()}
    arrive((1, 1, "p"), (2, 2, "p"), (3, 2, "p"), (4, None, "p"))
    assert sent(0) == [1, 2, 3, 4] and mark(0) == {2} and box.delivered().count() == 8
    # late: settled; at the mark: only those that weren't sent; the mark stays before what is held back
    arrive((5, 1, "p"), (3, 2, "p"), (6, 2, "p"), (7, 4, "secret"), (8, 5, "p"))
    assert sent(1) == [6, 8] and mark(1) == {4}
    arrive((9, 3, "p"), (10, 4, "p"))
    assert sent(2) == [10] and mark(2) == {4}
    box.held = lambda project: F.lit(False)
    arrive((11, 6, "p"))
    assert sent(3) == [7, 11] and mark(3) == {6}
    # a batch whose marks stand isn't sent again; one without them is delivered anew
    box.push(spark.createDataFrame([("a", T, 99, "p")], RECORD), 3)
    assert sent(3) == [7, 11]
    spark.createDataFrame([("x", "a", T, 0, 4)], "peer string, source string, ts timestamp, record long, batch long").write.parquet(f"{box.folder}/sent/4")
    arrive((12, 7, "p"))
    assert sent(4) == [12] and not os.path.exists(f"{local(box.folder)}/marks/5")


def test_cooldown_over_batches_equals_one_fold(spark):
    r = random.Random(9)
    rows = [(r.randint(1, 3), n, r.randint(1, 14), T + dt.timedelta(minutes=30 * n)) for n in range(300)]
    have: dict = {}
    want = []
    for a, n, s, t in rows:
        own = have.setdefault(a, [])
        if not any(x == s and t - u < dt.timedelta(hours=12) for x, u in own):
            own.append((s, t))
            del own[:-10]
            want.append((a, n, s))
    schema, source, out = "agent long, event_id long, session_id long, ts timestamp", shared_dir(spark), shared_dir(spark)
    for at in range(0, 300, 100):
        part = [*rows[at : at + 100], (1, 1000 + at, None, T), (1, 1001 + at, 5, None)]
        r.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        got = run_to_end(shown(spark.readStream.schema(schema).parquet(source)), out)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) < 290


def test_the_densest_turns_of_a_long_session(spark):
    rows = [(1, n, "one two" if n in (5, 15) else "one" if n % 2 else "x") for n in range(20)] + [(2, n, "one") for n in range(6)] + [(3, n, "x" if n != 9 else "two") for n in range(20)] + [(4, n, None) for n in range(20)]
    got = densest(spark.createDataFrame(rows, "session_id long, seq long, text string"), ["one", "two", "one"], 6, 2).collect()
    seqs = {s: sorted(r.seq for r in got if r.session_id == s) for s in (1, 2, 3, 4)}
    assert seqs == {1: [1, 3, 5, 7, 9, 15], 2: list(range(6)), 3: [7, 8, 9, 10, 11], 4: []}


def test_walls_that_a_step_names(spark):
    texts = {1: "migrate hermes-agent schema", 2: "migrate hermes-agent again", 3: "hermes-agent broke", 4: "unrelated words", 5: "more words", 6: "yet other words", 7: "words", 8: "words", 9: "schema words", 10: "x1", 11: "x2", 12: "x3"}
    store = Store(spark.createDataFrame([(i, 0, "user", t, None) for i, t in texts.items()], "session_id long, seq long, role string, text string, ts timestamp"))
    walls = spark.createDataFrame([(i, "hermes-agent: connection refused") for i in (1, 2, 3, 3)] + [(i, "disk is full of words") for i in (4, 5, 6)] + [(1, "schema is locked"), (2, "schema is locked")], "session_id long, line string")
    steps = spark.createDataFrame([(1, "restart hermes-agent"), (2, "migrate schema"), (3, "words words"), (4, None)], "step_id long, text string")
    got = [tuple(r) for r in plan_walls(steps, store, walls).collect()]
    assert got == [(1, "hermes-agent: connection refused", 3, 3)]
