from __future__ import annotations

import random
import re

import duckdb

from bazaarflow.llm import conversations, turns as T
from bazaarflow.llm.queries import ORACLE
from tests.oracle import difference

COLUMNS = "conv_id long, turn long, role string, text string, key string, part long, copies int, whole string"


def cheapest(turns):
    """Dynamic program over all labels, as a plain check of the search."""
    def closed(labels):
        for _ in range(4):
            for state, (cost, audit) in list(labels.items()):
                put(labels, 3 if state == 2 else 2, (cost + 2, audit + "I"))
        return labels

    def put(labels, state, label):
        labels[state] = min(label, labels.get(state, label))

    labels = closed({0: (0, "")})
    for turn in turns:
        new = {}
        for state, (cost, audit) in labels.items():
            put(new, state, (cost + 3, audit + "D"))
            if not turn.doomed:
                due = 3 if state == 2 else 2
                put(new, due, (cost + 2 + turn.cut, audit + "R"))
                own = {"s": 1, "u": 2, "a": 3}.get(turn.initial)
                if own == due or (own == 1 and state == 0):
                    put(new, own, (cost + turn.cut, audit + "K"))
        labels = closed(new)
    return min(labels[s] for s in (0, 3) if s in labels)


def random_turns(chance, n):
    return [T.Turn(chance.choice(["s", "u", "a", "a", "u", "u", "?", ""]), chance.random() < .15, chance.random() < .2)
            for _ in range(n)]


def test_search_finds_the_least_edits():
    chance = random.Random(1)
    for _ in range(1500):
        turns = random_turns(chance, chance.randint(0, 9))
        assert tuple(T.repair(turns)) == cheapest(turns), turns


def test_bounds_never_exceed_what_the_rest_costs():
    chance = random.Random(2)
    for _ in range(400):
        turns = random_turns(chance, chance.randint(0, 7))
        bounds = T.Bounds(turns, T.FINAL)
        for at in range(len(turns) + 1):
            for state in T.STATES:
                assert bounds.least(at, state) <= T.repair(turns[at:], state).cost


def test_segments_put_together_are_the_whole():
    chance = random.Random(3)
    for _ in range(400):
        turns = random_turns(chance, chance.randint(1, 9))
        size = chance.randint(1, 4)
        parts = [turns[i:i + size] for i in range(0, len(turns), size)]
        tables = [T.segment_table(p) for p in parts]
        solution, last = T.least_exit(T.joined(tables))
        assert tuple(solution) == cheapest(turns)
        way = T.route(tables, T.START, last)
        assert "".join(t[w].audit for t, w in zip(tables, way)) == solution.audit
        roles = [t.initial + "x" for t in turns]
        lines = T.replay(solution.audit, roles, ["t"] * len(turns))
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        assert lines == [line for i, (t, w) in enumerate(zip(tables, way)) for line in T.replay(
            t[w].audit, roles[i * size:(i + 1) * size], ["t"] * size, w[0])]


def test_a_long_search_stays_small():
    chance = random.Random(4)
    turns = random_turns(chance, 600)
    assert tuple(T.repair(turns)) == cheapest(turns)


def rows():
    chance = random.Random(7)
    texts = ["Hello there.", "ok", "ok.", "", " \t", "What?\n", "Ünï — fine!", "a" * 20000 + ".", None, "No. Yes", "same."]
    out = []

    def row(conv, turn, role, text):
        out.append((conv, turn, role, text, "k", 1, 2, "w"))

    for conv in [*range(60), None]:
        for turn in range(chance.randint(1, 9)):
            role = chance.choice(["user", "assistant", "assistant", "user", "system", None, "", "tool", "User"])
            row(conv, chance.choice([turn, turn, turn, turn * 3, None]), role, chance.choice(texts))
    for turn in range(700):  # one conversation over many tasks, one text in most of its turns
        row(1000, turn, "ua"[turn % 2] == "u" and "user" or "assistant", "same." if turn % 3 else f"text {turn}!")
    out += [out[5]] * 40  # repeated rows
    return out


def against_sql(spark, tmp_path, table, **options):
    path = str(tmp_path / "conversations")
    table.coalesce(1).write.parquet(path)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    found = conversations.repair_conversations(table, **options)
    assert difference(found, ORACLE["op11_conversations"], connection) is None


def test_against_sql_on_awkward_rows(spark, tmp_path):
    against_sql(spark, tmp_path, spark.createDataFrame(rows(), COLUMNS).repartition(4), segment=8)


def test_segment_size_changes_nothing(spark):
    table = spark.createDataFrame(rows(), COLUMNS)
    one = conversations.repair_conversations(table, segment=5).collect()
    other = conversations.repair_conversations(table).collect()
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, other), key=repr)


def test_whole_tables_against_sql(spark, folder, tmp_path):
    against_sql(spark, tmp_path, spark.read.parquet(f"{folder}/conversations.parquet"))


def test_nothing_left_and_nothing_given(spark, tmp_path):
    dropped = [i for i in range(400)]
    table = spark.createDataFrame([(i, 0, "user", "x.") for i in dropped], "conv_id int, turn int, role string, text string")
    found = {r["conv_id"]: r for r in conversations.repair_conversations(table).collect()}
    assert set(found) == set(dropped)
    gone = [r for r in found.values() if r["audit"] == ""]
    assert gone and all(r["cost"] == 0 and r["repaired_sha256"].startswith("e3b0c442") for r in gone)
    assert conversations.repair_conversations(table.limit(0)).count() == 0
