"""Conversation structure repair: cheapest edits to an alternating conversation, by iterative-deepening A*."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graintable.llm.common import giving_back, materialize, reachable, table

#: What counts as white space: the space and the characters from tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"
KINDS = "sua"  # system, user, assistant by their initials; any other role is kind 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: States: nothing yet, behind system, behind user, behind assistant. The initials kept make (s?(ua)+)?, so the last row leaves 0 or 3.
NEXT_KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
NEXT_MADE = (2, 2, 3, 2)
MADE_ROLE = ("user", "user", "assistant", "user")
TAIL_COST, TAIL = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
#: Rows that are searched at once; a longer conversation is a chain of such stretches.
STRETCH = 32


def _least(code: int) -> int:
    """What a row costs at least, whatever stands around it."""
    kind, fault = divmod(code, 4)
    if fault in (BLANK, DUPLICATE):
        return DELETE
    return min(DELETE, (CUT if fault == TRUNCATED else 0) + (REROLE if kind == 3 else 0))


@functools.lru_cache(maxsize=50_000)
def cheapest(codes: bytes, state: int, goal: tuple[int, ...]) -> tuple[int, str, int]:
    """Cost, edits and last state of the cheapest edits of a stretch of rows (kind * 4 + fault), goal[last state] included; of equally
    cheap ones the ASCII-least.

    Depth-first in the order D, I, K, R under a bound that grows to the least cost found necessary. A state whose search failed is kept with
    the cost it was found to need, so it is opened again only where the bound leaves as much. Edits end with a row's own, so of two
    different ones neither begins the other, and the first that is accepted is the least.
    """
    n = len(codes)
    rest = [min(goal)] * (n + 1)
    for i in reversed(range(n)):
        rest[i] = rest[i + 1] + _least(codes[i])
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []
    last = state

    def search(i: int, q: int, left: int) -> int | None:
        """None if it found a way within `left` (its edits are in path, last first), else what is needed at least."""
        nonlocal last
        need = max(rest[i], failed.get((i, q), 0))
        if need > left:
            return need
        if i == n:
            if goal[q] > left:
                return goal[q]
            last = q
            return None
        kind, fault = divmod(codes[i], 4)
        moves = [("D", DELETE, i + 1, q), ("I", INSERT, i, NEXT_MADE[q])]
        if fault not in (BLANK, DUPLICATE):
            cut = CUT if fault == TRUNCATED else 0
            if (q, kind) in NEXT_KEPT:
                moves.append(("K", cut, i + 1, NEXT_KEPT[q, kind]))
            moves.append(("R", cut + REROLE, i + 1, NEXT_MADE[q]))
        needed = None
        for letter, cost, j, q2 in moves:
            found = search(j, q2, left - cost)
            if found is None:
                path.append(letter)
                return None
            needed = cost + found if needed is None else min(needed, cost + found)
        failed[i, q] = needed
        return needed

    bound = rest[0]
    while (found := search(0, state, bound)) is not None:
        bound = found
    return bound, "".join(reversed(path)), last


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and edits of a whole conversation: a stretch is searched from each state it can begin with, its goals what the rest costs from there."""
    goal, found = TAIL_COST, []
    base = 0
    for at in reversed(range(0, len(codes), STRETCH)):
        ways = [cheapest(codes[at:at + STRETCH], q, goal) for q in (range(4) if at else (0,))]
        found.append([(edits, q) for _, edits, q in ways])
        low = min(cost for cost, _, _ in ways)
        goal, base = tuple(cost - low for cost, _, _ in ways), base + low
    state, letters = 0, []
    for ways in reversed(found):
        edits, state = ways[state]
        letters.append(edits)
    return base, "".join(letters) + TAIL[state]


def _columns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """c, t, r, x: null roles and texts are one space."""
    return rows.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("t"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role_col, "r"), (text_col, "x"))])


def conversation_plans(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: conv_col, gaps, blank, duplicate, truncated, illegal, cost (long), audit.

    Rows are taken by turn, nulls first, equal turns by role and the md5 of the text. A row's first fault counts: blank (white space only), duplicate (role and text
    seen earlier), truncated (the last character that isn't white space is none of . ! ?). gaps: turns missing between the least and the
    greatest. illegal: neighbours whose roles' initials aren't su, ua or au. audit: an initial for each edit: Keep 0, Rerole to
    user or assistant 3, Delete 4 (blank and duplicate rows must go), Insert an empty user or assistant row 3, a truncated row that
    stays 3 more; the cheapest ones after which the initials make (s?(ua)+)?, of equally cheap ones the ASCII-least. A role
    counts by its first character; one that is empty or begins otherwise can only be reroled or deleted. Null
    roles and texts are one space; a null conversation id is a conversation of its own; repeated rows are duplicates. Other columns are not read. An empty table gives no rows.

    Texts stay behind: a row goes into the shuffle with its digest and marks. A conversation's rows pass through one task in
    order, of which it holds a byte a row and the edits, as its result does.
    """
    reachable(rows.sparkSession)
    base = _columns(rows, conv_col, turn_col, role_col, text_col)
    body = F.rtrim(F.col("x"), F.lit(SPACE))
    marks = base.select("c", "t", "r", F.md5("x").alias("h"), (body == "").alias("blank"), F.substring(body, -1, 1).isin(".", "!", "?").alias("ended"))
    earlier = Window.partitionBy("c", "r", "h").orderBy("t")
    seen = marks.repartition("c").withColumn("n", F.row_number().over(earlier))
    fault = F.when(F.col("blank"), BLANK).when(F.col("n") > 1, DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(FINE)
    initial = F.substring("r", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    ordered = seen.select("c", "t", "r", "h", "n", (kind * 4 + fault).cast("int").alias("code")).sortWithinPartitions("c", "t", "r", "h", "n").select("c", "t", "code")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = ordered.select("c", *[F.lit(0).cast("long").alias(n) for n in names], F.lit("").alias("audit")).schema
    kind_of_id = pa.null()

    def report(c: object, codes: bytearray, turns: list) -> list:
        least, most, distinct = turns
        k = [x // 4 for x in codes]
        illegal = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(k, k[1:], strict=False))
        faults = [0] * 4
        for x in codes:
            faults[x % 4] += 1
        cost, audit = cheapest_edits(bytes(codes))
        return [c, most - least + 1 - distinct if distinct else 0, faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal, cost, audit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kind_of_id
        held, codes, turns, last = None, bytearray(), [0, 0, 0], None
        for b in batches:
            kind_of_id = b.schema.field(0).type
            done = []
            for c, t, code in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if held is None or held[0] != c:
                    if held is not None:
                        done.append(report(held[0], codes, turns))
                    held, codes, turns, last = (c,), bytearray(), [0, 0, 0], None
                codes.append(code)
                if t is not None and t != last:
                    turns = [turns[0] if turns[2] else t, t, turns[2] + 1]
                    last = t
            if done:
                yield _batch(done, kind_of_id, names)
        if held is not None:
            yield _batch([report(held[0], codes, turns)], kind_of_id, names)

    return ordered.mapInArrow(giving_back(run), schema).withColumnRenamed("c", conv_col)


def _batch(rows: list, kind_of_id: pa.DataType, longs: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    types = [kind_of_id, *[pa.int64()] * len(longs), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["c", *longs, "audit"])


def repaired_rows(rows: DataFrame, plans: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_col, place (long, from 0), edit (K, R or I), role, text: the rows of each conversation after the edits of plans (see conversation_plans).

    A conversation's rows stand in one partition, in order. The edits go ahead of the rows they belong to, in one
    sort by conversation, so a task holds a batch of rows and one conversation's edits. A conversation that plans doesn't have gives no rows.
    """
    reachable(rows.sparkSession)
    base = _columns(rows, conv_col, turn_col, role_col, text_col)
    ahead = plans.select(F.col(conv_col).alias("c"), F.lit(0).alias("k"), F.lit(None).cast("long").alias("t"), F.lit("").alias("r"), F.col("audit").alias("x"), F.lit("").alias("h"))
    both = ahead.unionByName(base.select("c", F.lit(1).alias("k"), "t", "r", "x", F.md5("x").alias("h")))
    ordered = both.repartition("c").sortWithinPartitions("c", "k", "t", "r", "h").select("c", "k", "r", "x")
    schema = ordered.select("c", F.lit(0).cast("long").alias("place"), F.lit("").alias("edit"), F.col("r").alias("role"), F.col("x").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: object = None
        letters, at, state, place, kind_of_id = "", 0, 0, 0, pa.null()
        out: list[tuple] = []

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place
            out.append((held, place, edit, role, text))
            place += 1

        def made() -> None:
            """The inserted rows ahead of the next edit of a row."""
            nonlocal at, state
            while letters[at:at + 1] == "I":
                put("I", MADE_ROLE[state], "")
                at, state = at + 1, NEXT_MADE[state]

        def flush() -> pa.RecordBatch:
            types = [kind_of_id, pa.int64(), pa.string(), pa.string(), pa.string()]
            found = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["c", "place", "edit", "role", "text"])
            out.clear()
            return found

        for b in batches:
            kind_of_id = b.schema.field(0).type
            for c, k, role, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if k == 0:
                    made()  # behind the last row of the conversation before
                    held, letters, at, state, place = c, text, 0, 0, 0
                    continue
                if at >= len(letters) or c != held:
                    continue
                made()
                edit = letters[at]
                at += 1
                if edit == "K":
                    put(edit, role, text)
                    state = NEXT_KEPT[state, KINDS.index(role[0])]
                elif edit == "R":
                    put(edit, MADE_ROLE[state], text)
                    state = NEXT_MADE[state]
            if out:
                yield flush()
        made()
        if out:
            yield flush()

    return ordered.mapInArrow(giving_back(run), schema).withColumnRenamed("c", conv_col)


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32 of `conv_id:turn` mod 20: 0 drops a row, 1 empties its text, 2 takes its . ! ? out, 3 repeats it, 4 makes its role user; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20)).cast("int")
    marked = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), d.alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, F.lit("")).when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, F.lit("user")).otherwise(F.col("role"))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def line_digests(repaired: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_col, sha256 (hex) of each conversation's `role:text`, newline-joined, over the rows of repaired_rows() as they stand."""
    schema = repaired.select(F.col(conv_col).alias("c"), F.lit("").alias("sha256")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, kind_of_id = None, None, pa.null()
        for b in batches:
            kind_of_id = b.schema.field(0).type
            ids, hashes = [], []
            for c, place, role, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if place == 0:
                    if digest is not None:
                        ids.append(held)
                        hashes.append(digest.hexdigest())
                    held, digest = c, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind_of_id), pa.array(hashes)], ["c", "sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], kind_of_id), pa.array([digest.hexdigest()])], ["c", "sha256"])

    return repaired.select(conv_col, "place", "role", "text").mapInArrow(giving_back(run), schema).withColumnRenamed("c", conv_col)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations after damage(): faults, the cheapest edits and the digest of the repaired rows; odd rows: see conversation_plans."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    broken = damage(rows)
    plans = materialize(conversation_plans(broken), "conversation-plans")
    digests = line_digests(repaired_rows(broken, plans)).withColumnsRenamed({"conv_id": "_d"})
    known = plans.withColumnRenamed("conv_id", "_p")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return (rows.select("conv_id").distinct().join(known, F.col("conv_id").eqNullSafe(F.col("_p")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
            .select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")))


def _sql() -> str:
    """The same rows in SQL: the bits of each key for its crc32, and the cheapest edits row by row over all four states at once."""
    add = lambda x, cost, letter, text="''": f"struct_pack(c := {x}.c + {cost}, a := {x}.a || '{letter}', t := {x}.t || {text})"
    user, assistant, own = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    none = "struct_pack(c := 1000000, a := '', t := '')"
    may = lambda test, way: f"CASE WHEN {test} THEN {way} ELSE {none} END"
    drop = lambda y: add(y, DELETE, "D")
    keep = lambda y, kind: may(f"fault NOT IN (1, 2) AND kind = '{kind}'", add(y, "cut", "K", own))
    rerole = lambda y, role: may("fault NOT IN (1, 2)", add(y, f"cut + {REROLE}", "R", f"chr(10) || '{role}:' || text"))
    return rf"""WITH RECURSIVE keys AS (SELECT row_number() OVER () AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
bits AS (SELECT *, flatten(list_transform(range(1, length(key) + 1), lambda i: list_transform(range(8), lambda j: (ascii(substr(key, CAST(i AS INT), 1)) >> CAST(j AS INT)) & 1))) AS b FROM keys),
dealt AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: xor(a >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)), 4294967295) % 20 AS d FROM bits),
damaged AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM dealt, LATERAL (SELECT unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) AS copies),
copied AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS n FROM damaged),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), n) AS i FROM copied),
marked AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS kind, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair,
  CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN n > 1 THEN 2 WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM placed),
r AS (SELECT *, CASE fault WHEN 3 THEN {CUT} ELSE 0 END AS cut FROM marked),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, struct_pack(c := 0, a := '', t := '') AS x0, {none} AS x1, {none} AS x2, {none} AS x3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, i, {drop('y0')}, {least(drop('y1'), keep('y0', 's'))},
    {least(drop('y2'), *[w for y in ('y0', 'y1', 'y3') for w in (keep(y, 'u'), rerole(y, 'user'))])}, {least(drop('y3'), keep('y2', 'a'), rerole('y2', 'assistant'))}
  FROM (SELECT r.*, x0 AS y0, x1 AS y1, {least('x2', *[add(x, INSERT, 'I', user) for x in ('x0', 'x1', 'x3')])} AS y2,
    {least('x3', add('x2', INSERT, 'I', assistant), *[add(x, 2 * INSERT, 'II', user + ' || ' + assistant) for x in ('x0', 'x1')])} AS y3 FROM dp JOIN r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1)),
best AS (SELECT conv_id, {least('x0', 'x3', add('x2', INSERT, 'I', assistant), add('x1', 2 * INSERT, 'II', user + ' || ' + assistant))} AS w FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS z FROM dp) WHERE z = 1),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(w.c AS BIGINT) AS cost, w.a AS audit, sha256(substr(w.t, 2)) AS repaired_sha256
FROM best LEFT JOIN counted ON best.conv_id IS NOT DISTINCT FROM counted.conv_id"""


SQL = _sql()
