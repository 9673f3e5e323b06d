"""Repair of conversations' structure: the cheapest edits that make roles alternate, found by branch and bound.

A repaired conversation is empty, or a system turn if any and then pairs of a user and an assistant turn. Edits of rows in
order are D(elete), I(nsert an empty turn), K(eep) and R(erole to user or assistant).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.common import read_table

#: Prices of the edits and of a truncated row that stays.
DELETE, INSERT, REROLE, STAYS_TRUNCATED = 3, 2, 2, 1
#: States by what was repaired last: nothing, a system, a user or an assistant turn; each with the initial that has to follow.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = "uuau"
#: Which of a suffix's bounds holds in a state.
FOLLOWS = (2, 0, 1, 0)
ROLE = {"u": "user", "a": "assistant"}
MARK = re.compile(r"[^\x20\x09-\x0D]")
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"


def _after(state: int) -> int:
    return ASSISTANT if state == USER else USER


def _bounds(initials: str, gone: list[bool], extra: list[int]) -> list[tuple[int, int, int]]:
    """For each suffix of rows a cost that its repair can't go below: if a user turn has to follow, an assistant turn, or any first turn.

    A system turn that stays may end the conversation here, so the bound of a first turn isn't always reached.
    """
    bounds = [(0, INSERT, 0)]
    for initial, must, more in zip(reversed(initials), reversed(gone), reversed(extra), strict=True):
        user, assistant, first = bounds[-1]
        now = [DELETE + user, DELETE + assistant]
        if not must:
            now[0] = min(now[0], assistant + more + (0 if initial == "u" else REROLE))
            now[1] = min(now[1], user + more + (0 if initial == "a" else REROLE))
        user_now, assistant_now = min(now[0], INSERT + now[1]), min(now[1], INSERT + now[0])
        begun = user + more if initial == "s" and not must else user_now
        bounds.append((user_now, assistant_now, min(DELETE + first, user_now, begun)))
    return bounds[::-1]


def _edits(i: int, state: int, initials: str, gone: list[bool], extra: list[int]) -> Iterator[tuple[str, int, int, int]]:
    """What may come next, in ASCII order: the edit's initial, rows done, state and price."""
    if i < len(initials):
        yield "D", i + 1, state, DELETE
    yield "I", i, _after(state), INSERT
    if i < len(initials) and not gone[i]:
        if initials[i] == NEXT[state]:
            yield "K", i + 1, _after(state), extra[i]
        elif initials[i] == "s" and state == START:
            yield "K", i + 1, SYSTEM, extra[i]
        yield "R", i + 1, _after(state), REROLE + extra[i]


def _first_incumbent(initials: str, gone: list[bool], extra: list[int], bounds: list[tuple[int, int, int]]) -> int:
    """The cost of one repair: at each step the edit whose price and bound are least."""
    i, state, cost = 0, START, 0
    while i < len(initials) or state not in (START, ASSISTANT):
        _, i, state, price = min(_edits(i, state, initials, gone, extra), key=lambda e: (e[3] + bounds[e[1]][FOLLOWS[e[2]]], -e[1]))
        cost += price
    return cost


def cheapest(initials: str, gone: list[bool], extra: list[int]) -> tuple[int, str]:
    """The least cost and, of the edits that have it, the first in ASCII order.

    initials: of the rows' roles, a space for none; gone: rows that have to be deleted; extra: what a row costs if it stays.
    Depth first by an explicit stack, edits in ASCII order. A prefix is given up if its cost and its suffix's bound exceed the
    incumbent, or if the table of its (rows done, state) holds a prefix that costs no more: that one came earlier in ASCII
    order, or costs less. The search ends when the stack is empty, so the incumbent is then proved best.
    """
    n, bounds = len(initials), _bounds(initials, gone, extra)
    best, found = _first_incumbent(initials, gone, extra, bounds), None
    least: dict[tuple[int, int], int] = {}
    links: list[tuple[int, str]] = [(-1, "")]
    stack = [(0, START, 0, 0)]
    while stack:
        i, state, cost, link = stack.pop()
        bound = cost + bounds[i][FOLLOWS[state]]
        if bound > best or (bound == best and found is not None) or least.get((i, state), bound + 1) <= cost:
            continue
        least[i, state] = cost
        if i == n and state in (START, ASSISTANT):
            best, found = cost, link
            continue
        for edit, row, to, price in reversed(list(_edits(i, state, initials, gone, extra))):
            links.append((link, edit))
            stack.append((row, to, cost + price, len(links) - 1))
    audit = []
    while found:
        found, edit = links[found]
        audit.append(edit)
    return best, "".join(reversed(audit))


def apply_edits(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The repaired (role, text) rows."""
    out, state, at = [], START, iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "D":
            continue
        if edit == "K" and role[:1] == "s":
            state = SYSTEM
        else:
            role = role if edit == "K" else ROLE[NEXT[state]]
            state = _after(state)
        out.append((role, text))
    return out


def repair_one(turns: list[int | None], rows: list[tuple[str, str]]) -> tuple:
    """The RESULT of one conversation without its id: turns and (role, text) of its rows, in order."""
    seen: set[tuple[str, str]] = set()
    faults = []
    for row in rows:
        marks = MARK.findall(row[1][-1:]) or MARK.findall(row[1])
        faults.append("b" if not marks else "d" if row in seen else "t" if marks[-1] not in ".!?" else "")
        seen.add(row)
    initials = "".join(role[:1] or " " for role, _ in rows)
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(rows) - 1))
    cost, audit = cheapest(initials, [f in ("b", "d") for f in faults], [STAYS_TRUNCATED * (f == "t") for f in faults])
    repaired = [{"role": r, "text": t} for r, t in apply_edits(rows, audit)]
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, repaired


def repair(turns: DataFrame) -> DataFrame:
    """A row for each conversation of turns (conv_id, turn, role, text): its faults, the cheapest repair and the repaired turns.

    Rows go by turn (nulls first), ties by role and text. Null roles and texts are one space; rows without an id are left
    out. A row's first fault of blank, duplicate (role and text seen earlier), truncated (last mark not . ! or ?) counts.
    gaps: turns missing between the first and the last. Repeated rows are duplicates; an empty table gives an empty one.
    Texts may have any length; columns of other names don't take part. A conversation is repaired by one task, which holds
    its rows and no others.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, numbers, rows, done = None, [], [], []
        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if conv != now and rows:
                    done.append((now, *repair_one(numbers, rows)))
                    numbers, rows = [], []
                now = conv
                numbers.append(turn)
                rows.append((role, text))
            yield _batch(done)
            done = []
        if rows:
            yield _batch([(now, *repair_one(numbers, rows))])

    kinds = [*[pa.int64()] * 7, pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
    names = [c.split()[0] for c in RESULT.split(", ")]

    def _batch(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    space = F.lit(" ")
    inner = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    return inner.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(run, RESULT)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a fifth of the rows dropped, emptied, cut, repeated or given to the user, by the CRC of conv_id:turn.

    A null turn is empty in that text; null roles and texts are one space.
    """
    kind = F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(""))).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")], kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repairs of damaged conversations; every conversation has its row, those that lost all rows too."""
    conversations = read_table(spark, sf_dir, "conversations")
    digest = F.sha2(F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n").cast("binary"), 256)
    fixed = repair(damaged(conversations)).withColumn("repaired_sha256", digest).drop("repaired")
    every = conversations.where(F.col("conv_id").isNotNull()).select("conv_id").distinct().join(fixed, "conv_id", "left")
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return every.select("conv_id", *[F.coalesce(c, none.get(c, F.lit(0).cast("long"))).alias(c) for c in fixed.columns[1:]])


SQL = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id || ':' || coalesce(turn::VARCHAR, ''), ''), lambda x: ord(x)::BIGINT)),
        lambda acc, o: list_reduce(list_prepend(xor(acc, o), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT) % 20 AS kind
    FROM conversations WHERE conv_id IS NOT NULL),
x AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM (SELECT *, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM o WHERE kind <> 0)),
y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM x),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault,
             CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS ini FROM y),
g AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
             count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
             count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n,
             list(ini ORDER BY i) AS inis, list(fault ORDER BY i) AS faults, list(role ORDER BY i) AS roles, list(text ORDER BY i) AS texts FROM g GROUP BY conv_id),
st AS (SELECT conv_id, n, inis, faults, 0::BIGINT AS i, '000000' AS k0, '9' AS k1, '000002I' AS k2, '000004II' AS k3 FROM c
       UNION ALL
       SELECT conv_id, n, inis, faults, i, k0, k1, least(k2, add(k0), add(k1), add(k3)), least(k3, add(least(k2, add(k0), add(k1)))) FROM
       (SELECT conv_id, n, inis, faults, i + 1 AS i, del(k0) AS k0, least(del(k1), CASE WHEN inis[i + 1] = 's' AND stay THEN kept(k0) ELSE '9' END) AS k1,
               least(del(k2), CASE WHEN stay AND inis[i + 1] = 'u' THEN least(kept(k0), kept(k1), kept(k3)) ELSE '9' END, CASE WHEN stay THEN least(role(k0), role(k1), role(k3)) ELSE '9' END) AS k2,
               least(del(k3), CASE WHEN stay AND inis[i + 1] = 'a' THEN kept(k2) ELSE '9' END, CASE WHEN stay THEN role(k2) ELSE '9' END) AS k3
        FROM (SELECT *, faults[i + 1] NOT IN ('b', 'd') AS stay, CASE faults[i + 1] WHEN 't' THEN 1 ELSE 0 END AS more FROM st WHERE i < n))),
r AS (SELECT conv_id, least(k0, k3) AS k FROM st WHERE i = n),
e AS (SELECT c.*, left(k, 6)::BIGINT AS cost, substr(k, 7) AS audit FROM c JOIN r USING (conv_id)),
u AS (SELECT conv_id, roles, texts, inis, p, substr(audit, p, 1) AS edit, length(replace(left(audit, p), 'I', '')) AS row FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM e)),
w AS (SELECT *, sum((edit <> 'D' AND NOT (edit = 'K' AND inis[row] = 's'))::INT) OVER (PARTITION BY conv_id ORDER BY p) % 2 AS odd FROM u),
z AS (SELECT conv_id, string_agg(CASE edit WHEN 'K' THEN roles[row] || ':' || texts[row] WHEN 'R' THEN CASE odd WHEN 1 THEN 'user' ELSE 'assistant' END || ':' || texts[row]
             ELSE CASE odd WHEN 1 THEN 'user:' ELSE 'assistant:' END END, chr(10) ORDER BY p) AS body FROM w WHERE edit <> 'D' GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM o) d LEFT JOIN e USING (conv_id) LEFT JOIN z USING (conv_id)
"""


def _price(sql: str) -> str:
    """The SQL with add, del, kept and role written out: each adds its price to a cost of six digits and its initial to the audit."""
    new = {"add": (INSERT, "I"), "del": (DELETE, "D"), "role": (f"{REROLE} + more", "R"), "kept": ("more", "K")}
    while found := re.search(r"\b(add|del|role|kept)\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)", sql):
        more, initial = new[found[1]]
        inner = found[2]
        whole = f"CASE WHEN {inner} = '9' THEN '9' ELSE lpad((left({inner}, 6)::INT + {more})::VARCHAR, 6, '0') || substr({inner}, 7) || '{initial}' END"
        sql = sql[: found.start()] + whole + sql[found.end() :]
    return sql


SQL = _price(SQL)
