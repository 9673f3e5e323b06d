"""Operator 11 and its suffix sort, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from emberline.llm import suffix_dedup, suffix_sort
from emberline.llm.registry import QUERIES


def brute(rows, length=100):
    """For each row its bytes, how many go, in how many runs, and what is left."""
    first = {}
    key = lambda d: (d is not None, d or 0)
    bodies = [(d, (t or "").encode()) for d, t in rows]
    for d, body in bodies:
        for p in range(len(body) - length + 1):
            w = body[p : p + length]
            first[w] = min(first.get(w, ((2,), 0)), (key(d), p))
    out = []
    for d, body in bodies:
        gone = bytearray(len(body))
        for p in range(len(body) - length + 1):
            if first[body[p : p + length]] < (key(d), p):
                gone[p : p + length] = b"\1" * length
        left = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(body), sum(gone), runs, left))
    return sorted(out, key=str)



@pytest.mark.parametrize("alphabet, size, depth", [(1, 3000, 100), (2, 4000, 100), (2, 4000, 17), (20, 20000, 40)])
def test_buckets_are_in_order(monkeypatch, alphabet, size, depth):
    monkeypatch.setattr(suffix_sort, "BUCKET", 700)
    rng = np.random.default_rng(alphabet)
    body = rng.integers(97, 97 + alphabet, size).astype(np.uint8)
    body[size // 2 : size // 2 + size // 3] = body[: size // 3]
    text = np.concatenate([body, np.zeros(depth + 32, np.uint8)])
    places = np.sort(rng.choice(size - depth, size // 2, replace=False))
    got = list(suffix_sort.sorted_buckets(text, size, places, depth))
    order, same = np.concatenate([o for o, _ in got]), np.concatenate([s for _, s in got])
    heads = [text[p : p + depth].tobytes() for p in order]
    assert sorted(order) == sorted(places) and heads == sorted(heads) and (len(got) > 1 or alphabet == 1)
    assert same.tolist() == [k > 0 and heads[k] == heads[k - 1] for k in range(len(heads))]


def test_cover_holds_every_difference():
    assert {(a - b) % suffix_sort.PERIOD for a in suffix_sort.COVER for b in suffix_sort.COVER} == set(range(suffix_sort.PERIOD))


def corpus(rng, n):
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 8))) for _ in range(60)]
    prose = lambda k: " ".join(rng.choices(words, k=k))
    passages = [prose(rng.randint(15, 60)) for _ in range(6)]
    rows = []
    for d in range(n):
        parts = [prose(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut : len(p) - rng.randint(0, 30)], prose(rng.randint(0, 12))]
        rows.append((d, "".join(parts)))
    return rows


@pytest.mark.parametrize("length", [40, 280])
def test_other_lengths(spark, length):
    rng = random.Random(length)
    rows = corpus(rng, 60)
    rows += [(100 + k, rows[k][1] + "." * 400) for k in range(10)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute(rows, length)


@pytest.mark.parametrize("small", [False, True])
def test_removal_is_that_of_brute_force(spark, monkeypatch, small):
    rng = random.Random(11)
    rows = corpus(rng, 150)
    rows += [(1000 + k, rows[k % 7][1]) for k in range(40)]  # copies
    rows += [(2000, "ab" * 900), (2001, "ab" * 60), (2002, "x" * 99), (2003, "x" * 100), (2004, "x" * 101), (2005, "x" * 350), (2006, None), (2007, ""), (None, rows[3][1] + "tail"), (None, rows[5][1])]
    rows += [(3000, rows[9][1]), (3000, rows[9][1]), (3001, "z" + rows[9][1]), (3001, rows[9][1][:160] + "y")]
    if small:
        for name, value in (("PIECE", 700), ("COMBINED", 3000), ("OFTEN", 3)):
            monkeypatch.setattr(suffix_dedup, name, value)
        rng.shuffle(rows)
    docs = spark.createDataFrame([(t, d, "tag", 1, b"s") for d, t in rows], "text string, doc_id long, tag string, d int, sha binary").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_long(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs).count() == 0
    for length in (39, 281):
        with pytest.raises(ValueError, match="sought"):
            suffix_dedup.remove_repeats(docs, length=length)
    rng = random.Random(1)
    half = "".join(rng.choices("abcdefgh ", k=2_500_000))
    docs = spark.createDataFrame([(1, half + "!"), (2, "?" + half[1000:]), (3, "short")], "doc_id long, text string")
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert (rows[1].n_removed, rows[2].n_removed, rows[2].n_spans, bytes(rows[2].kept), rows[3].n_removed) == (0, len(half) - 1000, 1, b"?", 0)


def test_query_is_that_of_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(map(tuple, QUERIES["op11_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()), key=str)
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got == sorted(((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in want), key=str) and sum(r[2] for r in got) > 1000
