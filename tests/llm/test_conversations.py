"""Conversation repair against plain search over all edits, and its odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import duckdb
import pytest
from pyspark.sql import functions as F

from graintable.llm import conversations as V

DATA = "/root/testdata/sf0.1"
SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def plain_edits(rows):
    """rows: (role, text, fault). Least (cost, audit, repaired lines) over all edits, by memoised recursion on what is left."""
    pattern = re.compile(r"(s?(ua)+)?")
    live = {"": {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}

    @cache
    def best(i, state, inserted):
        ways = []
        if i == len(rows):
            if state in ("", "a"):
                ways.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            low = best(i + 1, state, 0)
            ways.append((low[0] + 4, "D" + low[1], low[2]))
            if fault not in ("blank", "duplicate"):
                cut = 3 if fault == "truncated" else 0
                if role[:1] in live[state] and role[:1]:
                    low = best(i + 1, role[:1], 0)
                    ways.append((low[0] + cut, "K" + low[1], (f"{role}:{text}", *low[2])))
                for new in ("user", "assistant"):
                    if new[0] in live[state]:
                        low = best(i + 1, new[0], 0)
                        ways.append((low[0] + cut + 3, "R" + low[1], (f"{new}:{text}", *low[2])))
        if inserted < 3:
            for new in ("user", "assistant"):
                if new[0] in live[state]:
                    low = best(i, new[0], inserted + 1)
                    ways.append((low[0] + 3, "I" + low[1], (f"{new}:", *low[2])))
        return min(ways, default=(10**9, "", ()))

    found = best(0, "", 0)
    assert pattern.fullmatch("".join(x[0] for x in found[2]))
    return found


def plain_report(rows):
    """rows of one conversation: (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults, marked = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        left = text.rstrip(WHITE)
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        marked.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
    cost, audit, lines = plain_edits(tuple(marked))
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit), list(lines)


def report(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    plans = V.conversation_plans(df)
    have = {r.conv_id: tuple(r)[1:] for r in plans.collect()}
    kept = {}
    for r in sorted(V.repaired_rows(df, plans).collect(), key=lambda r: (str(r.conv_id), r.place)):
        assert r.place == len(kept.setdefault(r.conv_id, []))
        kept[r.conv_id].append(f"{r.role}:{r.text}")
    return have, kept


@pytest.mark.parametrize("seed", range(3))
def test_search_equals_plain_search(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n = rng.choice([0, 1, 2, 3, 4, 6, 9, 14])
        rows = [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool"]), str(i), rng.choice([None, None, None, "truncated", "blank", "duplicate"])) for i in range(n)]
        codes = bytes("suat".index(r[0]) * 4 + (0 if f is None else ["", "blank", "duplicate", "truncated"].index(f)) for (r, _, f) in rows)
        assert V.cheapest_edits(codes) == plain_edits(tuple(rows))[:2]


def test_long_conversations_are_chained_stretches(monkeypatch):
    rng = random.Random(5)
    for stretch in (1, 2, 5):
        monkeypatch.setattr(V, "STRETCH", stretch)
        for _ in range(150):
            rows = [(rng.choice(["system", "user", "assistant", "x"]), str(i), rng.choice([None, None, "truncated", "blank"])) for i in range(rng.choice([0, 7, 23]))]
            codes = bytes("suax".index(r[0]) * 4 + (0 if f is None else {"blank": 1, "truncated": 3}[f]) for (r, _, f) in rows)
            assert V.cheapest_edits(codes) == plain_edits(tuple(rows))[:2]
    monkeypatch.undo()
    cost, audit = V.cheapest_edits(bytes([4, 8, 4, 4, 8]) * 60_000)
    assert len(audit.replace("I", "")) == 300_000 and cost > 0


def test_odd_conversations(spark):
    rng = random.Random(11)
    texts = ["Fine.", "No end", "", " \t\n", None, "Why?", "Fine. \n", "é!", "Same.", "Same."]
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice(["user", "assistant", "system", None, "", "tool", "User", "sys"]), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randint(1, 9))]
    rows += [(100, None, "user", "Hi."), (100, None, "assistant", "Yes."), (101, -5, "user", "a."), (101, 5, "assistant", "b!"), (102, 0, "user", "long " * 200_000 + "."), (102, 1, "assistant", "x." * 100_000)]
    rows += [(103, i, "user", "again.") for i in range(300)] + [(104, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(1001)]
    have, kept = report(spark, rows)
    for c in {r[0] for r in rows} - {103, 104}:
        want, lines = plain_report([r[1:] for r in rows if r[0] == c])
        assert have[c] == want and kept.get(c, []) == lines, c
    assert have[103] == (0, 0, 299, 0, 299, 1199, "K" + "D" * 299 + "I")
    assert have[104][5:] == (3, "K" * 1001 + "I") and kept[104][-1] == "assistant:"


def test_empty_table_other_columns_and_unknown_conversations(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("b", 0, "assistant", "Ho.")], SCHEMA.replace("conv_id long", "conv_id string")).withColumns({c: F.lit(1) for c in ("c", "t", "h", "n", "code", "audit", "place")})
    assert V.conversation_plans(df.limit(0)).collect() == []
    plans = V.conversation_plans(df)
    assert {r.conv_id: r.audit for r in plans.collect()} == {"a": "KI", "b": "IK"}
    assert [(r.role, r.text) for r in V.repaired_rows(df, plans.where("conv_id = 'b'")).collect()] == [("user", ""), ("assistant", "Ho.")]
    renamed = df.withColumnsRenamed({"conv_id": "x"}).withColumnRenamed("turn", "c_")
    assert V.conversation_plans(renamed, "x", "c_").count() == 2


def test_damage_by_crc(spark):
    rows = [(c, t, "assistant", "A. b!") for c in [None, 7, 8] for t in [None, *range(40)]]
    have = {}
    for r in V.damage(spark.createDataFrame(rows, SCHEMA)).collect():
        have.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = [("user" if d == 4 else role, {1: "", 2: "A b"}.get(d, text))] * (0 if d == 0 else 2 if d == 3 else 1)
        assert have.get((c, t), []) == want


def test_query_equals_its_sql_and_keeps_emptied_conversations(spark, tmp_path):
    gone = [(c, 0, "user", "Hi.") for c in range(2000, 2200)] + [(None, None, None, None), (None, 3, "user", "Hm")]
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").unionByName(spark.createDataFrame(gone, SCHEMA))
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    found = V.op11_conversation_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = con.execute(V.SQL)
    want = sorted(got.fetchall(), key=repr)
    have = sorted((tuple(r) for r in found.select(*[c[0] for c in got.description]).collect()), key=repr)
    assert have == want
    assert (2000 + next(i for i in range(200) if zlib.crc32(f"{2000 + i}:0".encode()) % 20 == 0), 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in have
