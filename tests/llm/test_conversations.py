"""Operators 12 and 13, against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from emberline.llm import common, prefix_trie, repair
from emberline.llm.registry import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth string, ends_sha256 int"


def save(spark, rows, folder):
    rows = [(*r, "x", 1) if len(r) == 4 else r for r in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def in_order(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, text))
    return convs


def want_trie(rows):
    convs = {c: [(r, t) for *_, r, t in sorted((a, b, r or "", t or "") for a, b, r, t in x)] for c, x in in_order(rows).items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = convs.get(c - int(c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, ids in members.items():
        below = [k for k in members if k[: len(node)] == node]
        kids = [k for k in below if len(k) == len(node) + 1]
        ends = ",".join(str(c) for c in sorted(c for c in ids if len(rebuilt[c]) == len(node)))
        out.append(
            (
                min(ids),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(ids),
                len(kids),
                sum(not any(k[:-1] == b for k in members if k) for b in below),
                sum((len(members[b]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", b[-1][1])) for b in below if b),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out)


def talk(rng, c, n, words=3):
    return [(c, t, rng.choice(["user", "assistant", "system"]), " ".join(rng.choices("ab", k=rng.randint(0, words)))) for t in range(n)]


def test_trie_is_that_of_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [r for c in [*range(45), -7, -20, 61, 2000] for r in talk(rng, c, rng.randint(0, 4), 1)]
    deep = [(c, t, "user", "w" if t < 30 or c == 400 else f"w {c}") for c in (400, 403, 405) for t in range(40)]
    odd = [(7, None, None, None), (7, 3, "user", "x"), (7, 3, "user", "x"), (7, 3, "tool", "a b c"), (None, 1, "user", "lost"), (9, 1, "u", "é" * 70_000)]
    for k, case in enumerate((rows + odd, deep, [(21, 0, "user", "only")], [])):
        df = prefix_trie.op12_prefix_trie(spark, save(spark, case, tmp_path / str(k)))
        assert sorted(map(tuple, df.collect())) == want_trie(case)


def test_trie_rolls_up_by_levels(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HEIGHT", 2)
    rng = random.Random(5)
    rows = [r for c in range(12) for r in talk(rng, c, rng.randint(0, 13), 1)] + [(c, t, "user", "same") for c in range(20, 26) for t in range(19)]
    df = prefix_trie.op12_prefix_trie(spark, save(spark, rows, tmp_path / "t"))
    assert sorted(map(tuple, df.collect())) == want_trie(rows)


def all_repairs(initials, gone, extra, inserts=2):
    """Every (cost, audit) whose roles are allowed, with so many inserts at most."""
    found = []

    def go(i, left, roles, cost, audit):
        if i == len(initials) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit))
        if left:
            for r in "ua":
                go(i, left - 1, roles + r, cost + 2, audit + "I")
        if i < len(initials):
            go(i + 1, left, roles, cost + 3, audit + "D")
            if not gone[i]:
                go(i + 1, left, roles + initials[i], cost + extra[i], audit + "K")
                for r in "ua":
                    go(i + 1, left, roles + r, cost + 2 + extra[i], audit + "R")

    go(0, inserts, "", 0, "")
    return min(found)


def test_cheapest_is_that_of_brute_force():
    rng = random.Random(8)
    cases = [("".join(x), [False] * n, [0] * n) for n in range(4) for x in itertools.product("sua ", repeat=n)]
    cases += [("".join(rng.choices("suua t", k=n)), rng.choices([False, False, False, True], k=n), rng.choices([0, 1], k=n)) for n in (3, 4) for _ in range(40)]
    for case in cases:
        assert repair.cheapest(*case) == all_repairs(*case), case


def test_long_conversations_are_proved_quickly():
    rng = random.Random(2)
    n = 20_000
    cost, audit = repair.cheapest("".join(rng.choices("uas", k=n)), rng.choices([False] * 9 + [True], k=n), rng.choices([0, 1], k=n))
    assert len(audit.replace("I", "")) == n and cost > 0


def want_repairs(rows):
    out = []
    for c, own in in_order([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows]).items():
        damaged = []
        for known, turn, role, text in own:
            kind = zlib.crc32(f"{c}:{turn if known else ''}".encode()) % 20
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                damaged += [(known, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        damaged.sort()
        seen, faults = set(), []
        for *_, role, text in damaged:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for k, t, *_ in damaged if k]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        ini = [r[:1] or " " for *_, r, _ in damaged]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(ini))
        cost, audit = all_repairs("".join(ini), [f in ("b", "d") for f in faults], [int(f == "t") for f in faults])
        body, i, said = [], 0, 0
        for e in audit:
            role, text = ("", "") if e == "I" else damaged[i][2:]
            i += e != "I"
            if e != "D":
                said += not (e == "K" and role[:1] == "s")
                body.append((role if e == "K" else ("user" if said % 2 else "assistant")) + ":" + text)
        out.append((c, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest()))
    return sorted(out)


def test_repairs_are_those_of_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, rng.choice([None, t, t + 1, t]), rng.choice(["user", "assistant", "system", None, "", "tool"]), rng.choice([None, "", " \t", "Yes.", "No", "So? ", "a\nb!"])) for c in range(150) for t in range(rng.randint(1, 2))]
    rows += [(None, 1, "user", "lost"), (900, 1, "user", "é" * 70_000 + "."), (900, 1, "user", "é" * 70_000 + ".")]
    rows += [(c, 0, "user", "Gone.") for c in range(1000, 1060)]
    for k, case in enumerate((rows, [])):
        got = sorted(map(tuple, repair.op13_repair(spark, save(spark, case, tmp_path / str(k))).collect()))
        assert got == want_repairs(case)
        assert not case or any(r[7] == "" for r in got)


@pytest.mark.parametrize("name", ["op12_prefix_trie", "op13_repair"])
def test_results_have_a_row_each(spark, name):
    rows = QUERIES[name](spark, "/root/testdata/sf0.001")
    keys = ["conv_id", "depth"] if name.startswith("op12") else ["conv_id"]
    assert rows.select(*keys).distinct().count() == rows.count() > 0
    assert all(t == "bigint" for c, t in rows.dtypes if c not in ("audit", "ends_sha256", "repaired_sha256"))


def test_general_repair_returns_turns(spark):
    df = spark.createDataFrame([(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 4, "user", "Bye")], "conv_id int, turn int, role string, text string")
    row = repair.repair(df.withColumn("audit", F.lit(1))).first()
    assert (row.gaps, row.duplicate, row.truncated, row.illegal, row.cost, row.audit) == (1, 1, 1, 2, 8, "KIKDD")
    assert [r.role for r in row.repaired] == ["system", "user", "assistant"]
    assert [r.text for r in row.repaired] == ["Be brief.", "", "Hello."]


def test_only_small_tables_are_dealt_out(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert common.read_spread(spark, str(tmp_path), "documents").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(common, "SPREAD_BYTES", 100)
    assert common.read_spread(spark, str(tmp_path), "documents").rdd.getNumPartitions() == 1
