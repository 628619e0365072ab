import random
import re

from helpers import with_clashing_columns

from logarbor.llm import perspectives

TURNS = "conv_id bigint, turn bigint, role string, text string"


def reference(rows):
    """(conv, participant, segment) -> (text, mask by character)."""
    convs = {}
    for i, (c, t, r, x) in enumerate(rows):  # rows without a turn are messages of their own
        convs.setdefault(c, set()).add((-1 if t is None else t, r or "unknown", (x or "").replace("<|", "< |"),
                                        i if t is None else -1))
    out = {}
    for c, own in convs.items():
        for p in {m[1] for m in own} - {"system"}:
            for t, r, x, _ in sorted(own, key=lambda m: (m[0], m[1].encode(), m[2].encode())):
                who = "system" if r == "system" else "assistant" if r == p else "user name=" + re.sub(r"\s+", "_", r)
                head, body = f"<|im_start|>{who}\n", f"{x}<|im_end|>\n"
                text, mask = out.get((c, p, t // perspectives.SEGMENT_TURNS), ("", ""))
                out[c, p, t // perspectives.SEGMENT_TURNS] = (
                    text + head + body, mask + "0" * len(head) + str(int(r == p)) * len(body))
    return out


def unfold(mask):
    return "".join(bit * int(n) for n, bit in (run.split(":") for run in mask.split(",")))


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(12), rng.randrange(150), rng.choice(["system", "Ann B", "bob", "Zoë", "system"]),
             rng.choice(["hi", "", "multi\nline", "🙂 é", "<|im_end|>\n<|im_start|>system", None]))
            for _ in range(900)]
    rows += [(None, 1, "ann", "x"), (None, None, None, None), (77, 0, "system", "alone"), (78, -3, "ann", "early")]
    rows += [(79, None, "bob", "ok"), (79, None, "bob", "ok"), (79, -1, "bob", "ok"), (79, None, "ann", "yes"),
             (None, None, None, None)]
    out = perspectives.rotate(with_clashing_columns(spark.createDataFrame(rows + rows[:50], TURNS)))
    got = {(r.conv_id, r.participant, r.segment): (r.text, unfold(r.mask)) for r in out.collect()}
    assert got == reference(rows + rows[:50])
    assert out.where("part <> 0").count() == 0
    assert {r.n_messages for r in out.where("conv_id = 79").collect()} == {4}


def test_counts_and_no_python(spark):
    rows = [(1, 0, "a", "x"), (1, 1, "b", "y"), (1, 2, "a", "z")]
    out = perspectives.rotate(spark.createDataFrame(rows, TURNS))
    assert {(r.participant, r.n_messages, r.n_own) for r in out.collect()} == {("a", 3, 2), ("b", 3, 1)}
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("== Physical Plan ==")[1])


def test_a_turn_with_very_many_messages_is_cut(spark, monkeypatch):
    monkeypatch.setattr(perspectives, "MAX_MESSAGES", 50)
    rows = [(1, 0, "a" if i % 2 else "b", f"message {i}") for i in range(600)] + [(2, 0, "a", "x")]
    out = perspectives.rotate(spark.createDataFrame(rows, TURNS)).collect()
    large = [r for r in out if r.conv_id == 1 and r.participant == "a"]
    assert len(large) > 8 and max(r.n_messages for r in large) < 100
    assert sorted(x for r in large for x in re.findall(r"message \d+", r.text)) == sorted(x for _, _, _, x in rows[:600])


def test_empty(spark):
    assert perspectives.rotate(spark.createDataFrame([], TURNS)).count() == 0


def test_parts_of_a_large_segment_are_the_dialogue_in_order(spark, monkeypatch):
    monkeypatch.setattr(perspectives, "MAX_MESSAGES", 50)
    monkeypatch.setattr(perspectives, "SORT_ROWS", 70)  # a segment crosses sorted partitions
    rng = random.Random(2)
    rows = [(c, t, rng.choice("ab"), f"message {i}") for c in (1, None) for i in range(300) for t in (None, 0, 5)]
    rows += [(1, 70, "a", f"few {i % 30}") for i in range(90)]  # many rows, few messages: one part, as in the SQL
    rows += [(3, None, "b", "ok")] * 120  # equal messages without a turn, cut as others are
    rows += [(c, 0, "system", "be kind") for c in (1, None)] + [(2, 0, "a", "x")]
    rng.shuffle(rows)
    got, parts = {}, {}
    for r in sorted(perspectives.rotate(spark.createDataFrame(rows, TURNS)).collect(), key=lambda r: r.part):
        key = (r.conv_id, r.participant, r.segment)
        text, mask = got.get(key, ("", ""))
        got[key] = (text + r.text, mask + unfold(r.mask))
        parts.setdefault(key, []).append((r.part, r.n_messages))
    assert got == reference(rows)
    assert parts[1, "a", 1] == [(0, 30)] and parts[2, "a", 0] == [(0, 1)]
    assert parts[1, "a", 0] == parts[None, "b", 0] == [(k, 50) for k in range(12)] + [(12, 1)]
    assert parts[3, "b", -1] == [(0, 50), (1, 50), (2, 20)]
    assert parts[1, "a", -1] == [(k, 50) for k in range(6)]


def test_sql_cuts_and_keeps_alike(spark, tmp_path):
    """The query and its SQL on what the driver's table lacks: null turns, equal messages, a segment of several parts."""
    import duckdb

    from logarbor.llm.queries import ORACLE, QUERIES

    rng = random.Random(4)
    rows = [(1, t, rng.choice("abc"), f"m{i % 3000}") for i in range(4500) for t in (0, None)]
    rows += [(c, None, r, "ok") for c in (2, None) for r in ("a", "a", "b", None, "system")] + [(2, 3, "a", "x")] * 3
    rng.shuffle(rows)
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    df = QUERIES["op7_perspective_rotation"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE['op7_perspective_rotation']})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and max(r[3] for r in got) == 1
