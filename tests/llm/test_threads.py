import random

from conftest import rows

from chatlake.llm import threads

SCHEMA = "record_type string, conversation_id string, message_id string, role string, ts bigint, text string, message_count bigint, file_id bigint, speaker string"


def header(c, n):
    return ("thread", c, None, None, None, None, n, 1, "clash")


def message(c, m, role, ts, text="x", f=1):
    return ("message", c, m, role, ts, text, None, f, "clash")


U, A = "user", "assistant"


def test_which_threads_are_dropped(spark):
    data = [
        *[header("ok", 2), message("ok", "1", " Human", 1700000000), message("ok", "2", "BOT ", 1700000001000), message("ok", "2", "bot", 1700000001000, f=2)],
        *[header("gap", 3), message("gap", "1", U, 1), message("gap", "2", A, 2)],
        *[header("two", 2), header("two", 1), message("two", "1", U, 1), message("two", "2", A, 2)],
        *[message("time", "1", U, None), message("time", "2", A, 2)],
        *[message("zero", "1", U, 0), message("zero", "2", A, 2)],
        *[message("role", "1", U, 1), message("role", "2", A, 2), message("role", "3", "critic", 3)],
        *[message("null", "1", U, 1), message("null", "2", A, 2), message("null", "3", None, 3)],
        *[message("blank", "1", U, 1, " \u200b"), message("blank", "2", A, 2, "")],
        *[message("first", "1", A, 1), message("first", "2", U, 2), message("first", "3", A, 3)],
        *[message("last", "1", U, 1), message("last", "2", A, 2, "\u00a0"), message("last", "3", "tool", 3)],
        *[message("tie", "1", U, 5), message("tie", "2", "model", 5)],
        *[message("tools", "0", "system", 1), message("tools", "1", U, 2), message("tools", "2", "Tool", 3), message("tools", "3", A, 4), message("tools", "4", "system", 5)],
        header("empty", 0),
        *[message(None, "1", U, 1), header(None, 9)],
    ]
    df = spark.createDataFrame(data, SCHEMA)
    assert [r[0] for r in rows(threads.dropped_threads(df))] == ["blank", "empty", "first", "gap", "last", "null", "role", "time", "zero"]
    kept = rows(threads.turns(df), "conversation_id", "turn", "message_id", "speaker")
    assert [k for k in kept if k[0] in ("ok", "tie")] == [("ok", 1, "1", "user"), ("ok", 2, "2", "assistant"), ("tie", 1, "1", "user"), ("tie", 2, "2", "assistant")]
    assert threads.dropped_threads(df.limit(0)).count() == 0
    assert threads.turns(df.limit(0)).count() == 0


def test_fragments_merge_where_suffix_equals_prefix(spark):
    def fragment(f, *names):
        return [("c", f, ord(n), n) for n in names]

    def contigs(*fragments):
        df = spark.createDataFrame([r for f in fragments for r in f], "conversation_id string, file_id bigint, ts bigint, message_id string")
        return [(r[0], r[1]) for r in rows(threads.contigs(df), "file_id", "contig")]

    assert contigs(fragment(1, *"abcd"), fragment(2, *"cdef"), fragment(3, *"fg")) == [(1, 1), (2, 1), (3, 1)]
    assert contigs(fragment(1, *"abcd"), fragment(2, *"ef")) == [(1, 1), (2, 2)]
    assert contigs(fragment(1, *"abcd"), fragment(2, *"bdef")) == [(1, 1), (2, 2)]  # the overlap differs
    assert contigs(fragment(1, *"abcdef"), fragment(2, *"cd"), fragment(3, *"fg")) == [(1, 1), (2, 1), (3, 1)]  # contained


def test_turns_of_a_frequent_thread_are_numbered_through(spark):
    r = random.Random(1)
    n = 3000
    data = [message("hot", f"m{i:05}", U if i == 0 else A, 10**12 + i // 3, f=i % 7) for i in range(n)]
    r.shuffle(data)
    got = rows(threads.turns(spark.createDataFrame(data, SCHEMA)), "turn", "message_id")
    assert got == [(i + 1, f"m{i:05}") for i in range(n)] or sorted(got) == [(i + 1, f"m{i:05}") for i in range(n)]


def test_the_assembly_decides(spark):
    """Copies in overlapping files count once because their overlap is verified; where files differ, the distinct messages count."""
    def thread(c, n, *files):
        yield header(c, n)
        for f, names in enumerate(files):
            for m in names:
                yield message(c, m, U if m == "a" else A, ord(m), f=f)

    data = [*thread("grows", 6, "abc", "abcde", "abcdef"), *thread("lost", 7, "abc", "abcde", "abcdef"), *thread("slides", 6, "abcd", "cdef"), *thread("apart", 4, "ab", "ef"), *thread("gone", 6, "ab", "ef"), *thread("rival", 5, "abde", "bcde"), *thread("short", 6, "abde", "bcde")]
    got = {r[0]: r[1:] for r in rows(threads.assembled(spark.createDataFrame(data, SCHEMA))[1], "conversation_id", "messages", "fragments", "contigs", "rivals", "gap", "dropped")}
    assert got["grows"] == (6, 3, 1, 0, 0, False) and got["lost"] == (6, 3, 1, 0, 1, True)
    assert got["slides"] == (6, 2, 1, 0, 0, False)
    assert got["apart"] == (4, 2, 2, 0, 0, False) and got["gone"] == (4, 2, 2, 0, 2, True)
    assert got["rival"] == (5, 2, 2, 1, 0, False) and got["short"] == (5, 2, 2, 1, 1, True)


def test_the_plan_compares_overlaps(spark):
    df = spark.createDataFrame([message("c", "1", U, 1), message("c", "2", A, 2)], SCHEMA)
    found = threads.messages(df).select("conversation_id", "file_id", "ts", "message_id")
    plan = threads.contigs(found)._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_xor" in plan
    # The stated number is held against what the contigs add up to.
    assert "merged" in threads.dropped_threads(df)._jdf.queryExecution().optimizedPlan().toString()


def test_against_distinct_messages(spark):
    """Random files of random threads: the assembled number is that of the distinct messages, and odd rows crash nothing."""
    r = random.Random(5)
    data = []
    for c in range(40):
        names = [f"m{i:02}" for i in range(r.randint(1, 12))]
        for f in range(r.randint(1, 5)):
            a, b = sorted((r.randint(0, len(names)), r.randint(0, len(names))))
            for m in names[a:b]:
                if r.random() < 0.9 or c % 2:
                    data.append(message(f"c{c}", m if r.random() < 0.97 else None, r.choice([U, A, None]), r.choice([int(m[1:]) + 1] * 9 + [None]), f=r.choice([f] * 9 + [None])))
    df = spark.createDataFrame(data, SCHEMA)
    want = {}
    for d in data:
        want.setdefault(d[1], set()).add(d[2])
    assert dict(rows(threads.assembled(df)[1], "conversation_id", "messages")) == {c: len(ms) for c, ms in want.items()}
