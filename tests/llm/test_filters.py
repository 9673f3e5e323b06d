"""Operators 1, 2, 5, 6, 7 and 8."""

import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberline.llm import decontaminate, host_quality, licenses, toxicity, url_filter, weak_quality
from emberline.llm.common import plain_text

DOCS = "doc_id long, text string, source string, n_words long, score string"
LONG = " ".join(f"word{i % 700}" for i in range(30_000))


def frame(spark, texts, sources=None):
    sources = sources or ["a"] * len(texts)
    return spark.createDataFrame([(i, t, s, 1, "x") for i, (t, s) in enumerate(zip(texts, sources, strict=True))], DOCS)


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


def test_measures_match_brute_force():
    rng = random.Random(3)
    texts = ["", None, "a", "é ß\x1c\x85 b ", "\n\n", " \n \n", LONG, "x y z " * 40]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "é\t", "#", "\n", "  ", "日 "]) for _ in range(rng.randint(0, 80))) for _ in range(300)]
    found = host_quality.measure(plain_text(pa.array(texts, pa.string())))
    assert [list(map(int, x)) for x in zip(*found.values(), strict=True)] == [brute_measures(t) for t in texts]


def test_hosts_are_judged_by_shrunk_rates(spark):
    good = " ".join(f"w{i}" for i in range(30))
    texts = [good] * 40 + ["bad"] * 40 + ["bad"] + [good] + [good, None, ""]
    sources = ["good"] * 40 + ["bad"] * 39 + ["good"] + ["small"] + ["bad"] + [None, None, None]
    rows = host_quality.host_quality(frame(spark, texts, sources), keep=["doc_id"]).collect()
    kept = {r.doc_id: r.kept for r in rows}
    rate = {sources[r.doc_id]: r.host_rate for r in rows}
    assert len(rows) == len(texts)
    assert rate["good"] < 0.2 < 0.8 < rate["bad"] and rate["small"] < 1
    assert kept[0] and not kept[81] and kept[82] and not kept[83] and not kept[84]


def test_host_quality_edges(spark):
    docs = frame(spark, [LONG, LONG, None])
    assert host_quality.keep_good_hosts(docs.limit(0)).count() == 0
    twice = host_quality.keep_good_hosts(docs.unionAll(docs))
    assert twice.columns == docs.columns and twice.count() in (0, 4)
    out = host_quality.host_quality(docs)
    assert out.columns == ["doc_id", "text", "source", "score", *host_quality.MEASURES, "base_failed", "host_rate", "kept"] and out.first().n_words != 1


def brute_leaks(texts, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    out = []
    for text in texts:
        words, hit, names = split(text), set(), set()
        for name, item in items:
            item = split(item)
            n = min(window, len(item))
            for j in range(len(item) - n + 1 if n else 0):
                for i in range(len(words) - n + 1):
                    if words[i : i + n] == item[j : j + n]:
                        hit |= set(range(i, i + n))
                        names.add(str(name))
        out.append((len(words), len(hit), sorted(names)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
@pytest.mark.parametrize("short", [False, True])
def test_leaks_match_brute_force(spark, block_bytes, short):
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(k, some(rng.randint(10, 16))) for k in range(6)] + [(7, ""), (8, None), (10, "A-B " * 6)]
    items += [(9, "b a b"), (11, "a")] if short else []
    texts = [None, "", "a"] + [some(rng.randint(0, 60)) for _ in range(60)] + [items[0][1]] * 3
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_leaks(frame(spark, texts).repartition(3), bench, block_bytes=block_bytes, keep=["doc_id"]).collect()
    want = brute_leaks(texts, items)
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in rows} == dict(enumerate(want))
    assert all(r.contaminated == (r.n_hit > 0) == (r.longest_match > 0) for r in rows)


def test_index_numbers_windows_alike():
    rng = random.Random(21)
    items = [(rng.choice(["x", "y", None, str(k)]), " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 25)))) for k in range(60)]
    index = decontaminate.test_index(items)
    windows = {}
    for name, text in items:
        words = text.split()
        n = min(10, len(words))
        for i in range(len(words) - n + 1):
            windows.setdefault(tuple(words[i : i + n]), set()).add(name)
    sizes = np.diff(index.item_offsets)
    assert len(sizes) == len(windows) == len(index.window_words) and sorted(sizes) == sorted(len(v - {None}) for v in windows.values())
    assert sorted(index.window[index.window >= 0].tolist()) == list(range(len(windows)))
    assert sorted(index.window_words) == sorted(map(len, windows))


def test_longest_match_and_empty_tables(spark):
    bench = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(40)))], "item_id long, text string")
    docs = frame(spark, ["x " + " ".join(f"t{i}" for i in range(5, 30)) + " y", LONG])
    rows = {r.doc_id: r for r in decontaminate.find_leaks(docs, bench, keep=["doc_id"]).collect()}
    assert (rows[0].longest_match, rows[0].hit_starts, rows[0].hit_lengths) == (25, [1], [25]) and rows[1].n_hit == 0
    assert decontaminate.drop_leaks(docs, bench.limit(0)).count() == 2
    assert decontaminate.find_leaks(frame(spark, ["0", "a 0 b"]), bench.limit(0)).where("contaminated OR longest_match > 0").count() == 0
    assert decontaminate.find_leaks(docs, bench).columns == ["doc_id", "text", "source", "score", "n_words", "longest_match", "hit_starts", "hit_lengths", "items", "n_hit", "n_items", "contaminated"]
    assert decontaminate.drop_leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.drop_leaks(docs, bench).columns == docs.columns


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    rows = keys.select("key", F.col("listed").alias("want")).unionAll(spark.sql("select cast(null as string), false"))
    for bits in (1 << 20, 2000):  # the smaller one takes several cascades
        assert url_filter.mark_listed(rows, keys, "key", bits).where("listed <> want").count() == 0
    assert url_filter.mark_listed(rows, keys.where("not listed"), "key").where("listed").count() == 0


def test_url_rules(spark):
    urls = ["http://Example.ORG/en/12?x", "https://a.example.org/es/q", "x://example.org/fr", "x://com/fr/", "x://b.com/de/#", "x://example.org", "no url", None, "x://", "x://notexample.org/es/"]
    pages = spark.createDataFrame([(i, u, "h", "own") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    listed = url_filter.thin_keys(pages)
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed, keep=["page_id"]).collect()}
    assert rows[0] == ("example.org", "/en/12", "example.org/en/1", "block") and rows[1][2:] == ("example.org/es/", "block")
    assert rows[2][2:] == ("org/", "allow") and rows[3][2:] == ("com/fr/", "allow") and rows[4][2:] == ("com/de/", "block")
    assert rows[5] == ("example.org", "", None, "block") and rows[6] == rows[7] == ("", "", None, "allow") and rows[8] == ("", "", None, "allow")
    assert rows[9][2] == "org/"
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    twice = url_filter.filter_urls(pages.unionAll(pages), listed)
    assert twice.columns == ["page_id", "url", "html", "host", "path", "rule", "listed", "verdict"] and twice.count() == 20 and twice.where("host = 'own'").count() == 0
    tied = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed, rules=(("allow", "org/"), ("block", "org/")), keep=["page_id"]).collect()}
    assert tied[0] == ("org/", "block")
    long = spark.createDataFrame([(1, "http://a.org/" + "x" * 3_000_000, None)], "page_id long, url string, html string")
    assert url_filter.filter_urls(long, url_filter.thin_keys(long)).first().verdict == "allow"


def test_licenses(spark):
    mit = licenses.NOTICES[8][1]
    texts = ["x\nreleased under the M.I.T. licence\ny", "Released under the MIT License.", "Copyright (c) 2001 Me\n\n" + mit.replace("sublicense", "sub-license").upper(), None, "", "...", "Copyright 2001 me", "licensed under cc by nc 4 0\nLicensed under CC BY-NC 4.0!", LONG, "Released under the MIT License.", "the licensed work"]
    rows = {r.doc_id: (list(r.licenses), r.n_notices, r.whole_text) for r in licenses.scan_licenses(frame(spark, texts), licenses.notices(spark), keep=["doc_id"]).collect()}
    none = ([], 0, None)
    assert rows[0] == none and rows[1] == rows[9] == (["MIT"], 1, "MIT")
    assert rows[2] == (["MIT"], 0, "MIT") and rows[7] == (["CC-BY-NC-4.0"], 2, None)
    assert all(rows[k] == none for k in (3, 4, 5, 6, 8, 10))
    clash = licenses.scan_licenses(frame(spark, texts).withColumn("Licenses", F.lit(1)), licenses.notices(spark))
    assert clash.columns == ["doc_id", "text", "source", "n_words", "score", "licenses", "n_notices", "whole_text", "embedded"]
    assert licenses.scan_licenses(frame(spark, texts).limit(0), licenses.notices(spark)).count() == 0


def test_published_license_files(spark):
    own = {name: text for name, text in licenses.NOTICES if "\n" in text}
    texts = [f"{title}\n\nCopyright (c) 2020 Jane Doe\n\n{own[name]}" for name, titles in licenses.TITLES.items() for title in titles]
    texts += ["\n".join(f"# {line}" if line else "#" for line in own["Apache-2.0"].split("\n")), "/*\n * " + own["GPL-3.0"].replace("\n", "\n * ") + "\n */"]
    want = [name for name, titles in licenses.TITLES.items() for _ in titles] + ["Apache-2.0", "GPL-3.0"]
    rows = licenses.scan_licenses(frame(spark, texts), licenses.notices(spark), keep=["doc_id"]).sort("doc_id").collect()
    assert [r.whole_text for r in rows] == want


def test_texts_inside_longer_ones(spark, tmp_path):
    texts = dict(licenses.published())
    assert len(texts) >= 10
    mit, mpl = licenses.NOTICES[8][1], texts["MPL-2.0"]
    zlib = next(t for n, t in licenses.NOTICES if n == "Zlib")
    wrapped = re.sub(r"(\S+ \S+ \S+ \S+) ", r"\1\n", mit)
    commented = "\n".join("# " + x for x in ("Copyright 2020 Jane\n\n" + wrapped).split("\n"))
    docs = [
        "An introduction.\n\n" + mit, "One.\n\nTwo.\n\n" + mpl + "\n\nThree.\n\n" + mit, commented + "\n\nimport this", mit.rsplit("\n\n", 1)[0] + "\n\nSomething else.", mit.replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("MERCHANTABILITY", "MERCHANTIBILITY"),
        zlib.replace("acknowledgment", "acknowledgement"), texts["Apache-2.0"], texts["GPL-2.0"].split(licenses.CUT)[0], mit + "\n\n" + mit, "\n\n".join(reversed(mit.split("\n\n"))), None, "", "Intro\n\n" + LONG,
    ]
    rows = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, docs + docs[:3] * 3), licenses.notices(spark), keep=["doc_id"]).collect()}
    assert [rows[k].embedded for k in range(13)] == [["MIT"], ["MIT", "MPL-2.0"], ["MIT"], [], ["MIT"], ["Zlib"], ["Apache-2.0"], ["GPL-2.0"], ["MIT"], [], [], [], []]
    assert [rows[k].whole_text for k in range(4, 8)] == ["MIT", "Zlib", "Apache-2.0", "GPL-2.0"] and rows[0].whole_text is None and set(rows[1].licenses) >= {"MIT", "MPL-2.0"}
    assert all(rows[13 + k].embedded == rows[k % 3].embedded for k in range(9))
    # Files of licences; two licences of one text are both given.
    for name in ("Mine-1.0", "Mine-2.0"):
        (tmp_path / f"{name}.txt").write_text("Do what you like.\n\nBut be kind.")
    mine = licenses.license_files(spark, str(tmp_path))
    rows = licenses.scan_licenses(frame(spark, ["DO what you like\n\n but be kind", "x\n\nDo what you like\n\nbut be kind", "Do what you like"]), mine, keep=["doc_id"]).sort("doc_id").collect()
    assert [(r.licenses, r.whole_text) for r in rows] == [(["Mine-1.0", "Mine-2.0"], "Mine-1.0"), (["Mine-1.0", "Mine-2.0"], None), ([], None)]


@pytest.mark.parametrize("pair", ["acknowledgement acknowledgment", "judgement judgment", "catalogue catalog", "analogue analog", "centre center", "labelling labeling", "offence offense", "practise practice", "programme program", "analyse analyze", "artefact artifact", "licence license", "fulfil fulfill", "wilful willful", "organisation organization", "favour favor", "https http"])
def test_equivalent_words(spark, pair):
    one, two = pair.split()
    form = spark.createDataFrame([(one, two)], "a string, b string").select(licenses.canonical(F.col("a")).alias("a"), licenses.canonical(F.col("b")).alias("b")).first()
    assert form.a == form.b
    known = spark.createDataFrame([("L", two)], "license string, text string")
    assert spark.createDataFrame([(one,)], "t string").where(licenses.may_be_known(F.col("t"), known)).count() == 1


def test_first_words_rule_nothing_out(spark):
    """A text with the canonical form of a known one stays, whatever characters it begins with."""
    odd = [chr(c) for c in range(0x20, 0x2200) if len(chr(c).lower()) > 1 or chr(c).lower() != chr(c) or not chr(c).isalnum()]
    rng = random.Random(22)
    heads = ["I", "İ", "i", "COPYRIGHTED", "Copyright2020 x\n", "Non", "sub-", "ΑΣ", "LICENCE", "Colour", "fulfil", "utilised", "© x\n", "(c) x\n", "All rights reserved.\n"]
    texts = [f"{rng.choice(odd)}{h}{rng.choice(odd)} agree" for h in heads for _ in range(60)] + [f"{c}I agree" for c in odd[:600]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").withColumn("form", licenses.canonical(F.col("text")))
    for head in ("i agree", "license agree", "color agree", "fulfill agree", "utilized agree", "agree", "non agree"):
        known = spark.createDataFrame([("L", head)], "license string, text string")
        assert df.where(F.col("form") == head).where(~licenses.may_be_known(F.col("text"), known)).count() == 0
    known = df.where("form <> ''").select(F.lit("L").alias("license"), "text").limit(900)
    assert df.join(known.select(licenses.canonical(F.col("text")).alias("form")).distinct(), "form").where(~licenses.may_be_known(F.col("text"), known)).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    votes = np.stack([np.where(rng.random(20_000) < a, np.where(truth, 1, -1), np.where(truth, -1, 1)) for a in (0.9, 0.8, 0.7)], axis=1)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, chances, share = weak_quality.estimate(patterns, counts)
    assert abs(share - 0.8) < 0.05 and np.abs(chances[1][2] - [0.9, 0.8, 0.7]).max() < 0.05
    assert ((posterior[inverse.ravel()] > 0.5) == truth).mean() > 0.9


def brute_votes(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, (_, chars, symbols, _, repeats) = len(words), brute_measures(text)
    if not n:
        return [0] * 9
    share = lambda f: sum(map(f, words)) / n
    stutter = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    function = share(lambda w: w.lower() in weak_quality.FUNCTION_WORDS)
    length = chars / n
    marks = share(lambda w: not any(c.isalpha() or unicodedata.category(c)[0] in "LN" for c in w))
    pick = lambda bad, good=False: -1 if bad else int(good)
    return [
        pick(symbols / max(chars, 1) > 0.08), pick(repeats / n > 0.3), pick(stutter > 0.12 and n >= 5), pick(share(lambda w: w.isupper() and len(w) > 1) > 0.4), pick(marks > 0.15), pick(share(lambda w: "!!" in w) > 0.2),
        pick(function < 0.02 and n >= 15, function > 0.08 and n >= 15), pick(n < 2, n >= 20), pick(length > 14 or length < 2, 3 < length < 9),
    ]


def test_weak_quality_matches_brute_force(spark):
    """Votes, posteriors and scores of a whole table, again in plain Python: EM over documents, features word by word."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scorer = weak_quality.train(docs)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    cast = np.array([brute_votes(t) for t in texts.values()])
    there = np.array([bool(re.search(r"[^\x20\x09-\x0D]", t or "")) for t in texts.values()])
    posterior, _, share = weak_quality.estimate(cast[there], np.ones(there.sum()))  # each document a pattern of its own
    rows = {r.doc_id: r for r in weak_quality.weak_quality(docs, keep=["doc_id"]).collect()}
    assert np.allclose([rows[k].posterior for k, t in zip(texts, there, strict=True) if t], posterior, atol=1e-9) and abs(share - scorer.share) < 1e-9

    def bucket(data, seed, offset):
        total = sum(int(weak_quality.mix(np.array([b + 256 * k], np.uint64), seed)[0]) for k, b in enumerate(data)) % 2**64
        return int(weak_quality.mix(np.array([total], np.uint64))[0] % np.uint64(weak_quality.BUCKETS)) + offset

    kind = lambda b: 65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else 48 if 48 <= b < 58 else b
    for k in list(texts)[:60]:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[k] or "")
        if not words:
            assert rows[k].score == 0
            continue
        total = 0.0
        for w in words:
            shape = [kind(b) for b in w.encode()]
            shape = [b for i, b in enumerate(shape) if not i or b != shape[i - 1]]
            total += scorer.weights[bucket(w.encode(), 20, 0)] + scorer.weights[bucket(shape, 21, weak_quality.BUCKETS)]
        binned = weak_quality._binned(weak_quality.signals(plain_text(pa.array([texts[k]], pa.string()))))[0]
        total = total / len(words) + scorer.weights[binned].sum() + scorer.weights[-1]
        assert abs(rows[k].score - 1 / (1 + np.exp(-total))) < 1e-9


def test_weak_quality_on_held_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = weak_quality.weak_quality(docs, keep=["doc_id"]).join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) > 0.96 * len(rows)
    assert sum(r.kept for r in rows if r.quality == 1) > 0.98 * sum(r.quality == 1 for r in rows)


def test_weak_quality_edges(spark):
    rows = weak_quality.weak_quality(frame(spark, [None, "", LONG, LONG, "... !!"]), keep=["doc_id"]).collect()
    kept = {r.doc_id: (r.score, r.kept) for r in rows}
    assert kept[0] == kept[1] == (0.0, False) and kept[2] == kept[3]
    docs = frame(spark, [None, ""])
    out = weak_quality.weak_quality(docs)
    assert out.columns == ["doc_id", "text", "source", "n_words", "score", "posterior", "kept"] and out.first().score == 0.0
    assert weak_quality.keep_good(docs).count() == 0 and weak_quality.keep_good(docs.limit(0)).columns == docs.columns


def test_weak_quality_sample_is_even_and_bounded(spark, monkeypatch):
    rng, fitted = random.Random(9), []
    fit = weak_quality.fit
    monkeypatch.setattr(weak_quality, "fit", lambda row, col, value, target, **more: fitted.append((len(target), more.get("times"))) or fit(row, col, value, target, rounds=5, **more))
    abstaining = "considerable unambiguous arrangement"
    texts = [f"{abstaining} {i}" if i % 9 else "the house of the man is on the hill and the road to it is long " * 2 + str(i) for i in range(2000)]
    copied, empty = [texts[5]] * 2000, [None] * 1500 + [" \t\n"] * 500
    found = []
    for rows in (texts + copied, texts + copied + empty, texts + copied + empty):
        rng.shuffle(rows)
        found.append(weak_quality.train(frame(spark, rows), sample=400).weights)
        many, times = fitted[-1]
        assert many <= 400 and times.sum() == 400 and 140 < times.max() < 260 and many == len(times)
    assert (found[0] == found[1]).all() and (found[0] == found[2]).all()


SENTENCES = {
    "you are an idiot": 1, "you idiot": 1, "I will find you and hurt your dog": 1, "we are going to kill them": 1, "She is stupid, he is a pathetic loser": 1,
    "you are not an idiot": 0, "the word idiot is rude": 0, "she said he is an idiot": 0, "kill the process": 0, "burn calories": 0, "dumb luck": 0, "I will not hurt you": 0, "he told me that you are stupid": 0,
    "He said: you are an idiot.": 0, '"You are an idiot," he said.': 0, "“You are an idiot!” said the man.": 0, 'She wrote: "You fool. You are an idiot."': 0, 'He said "hello." You idiot!': 1, "You idiot, you said nothing": 1,
    "Don't call him an idiot": 0, "I don’t think you are stupid": 0, "Nobody thinks you are stupid": 0, "You are not as stupid as him": 0, "Nobody is as stupid as you": 1, "Not only are you stupid": 1,
    "You are not smart, you idiot": 1, "I don't know you, but you are an idiot": 1, "You don't know anything you idiot": 1, "I don't like you because you are an idiot": 1,
    "We will beat you in chess": 0, "They will shoot the film for you tomorrow": 0, "I will beat you": 1, "who hurt you?": 0, "kill yourself": 1, "don't kill yourself": 0, "I hope you die": 1, "I hope you don't suffer": 0, "idiot idiot idiot": 0,
}


def test_grammar_scores_clauses():
    plain = toxicity.Grammar({"gloop*": 0.9}, toxicity.START)
    score = dict(zip(texts := ["", "an idiot", "not so. you idiot", "kill", "you GLOOPY", "gloop", "the house", *SENTENCES], plain.score(pa.array(texts)), strict=True))
    assert score["you are an idiot"] > score["an idiot"] > score[""] and score["you are not an idiot"] < score["an idiot"]
    assert score["not so. you idiot"] == score["you are an idiot"] and score["you GLOOPY"] > 0.5
    assert score["kill"] == score["gloop"] == score[""] == score["the house"]
    assert {t: int(score[t] >= 0.5) for t in SENTENCES} == SENTENCES


def test_learned_grammar_keeps_the_order(spark):
    d = "/root/testdata/sf0.01"
    grammar = toxicity.learn(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    score = grammar.score(pa.array(list(SENTENCES)))
    assert dict(zip(SENTENCES, (score >= 0.5).astype(int).tolist(), strict=True)) == SENTENCES
    assert (toxicity.bounded_weights(np.random.default_rng(1).normal(size=17) * 9)[0]) <= -2


def test_composition_is_the_chain():
    rng = random.Random(2)
    forward = [toxicity._aiming(), toxicity._threatening(), toxicity._negating(), toxicity._reporting()]
    for whole, parts in ((toxicity.FORWARD, forward), (toxicity.BACKWARD, [toxicity._tagging(), toxicity._comparing(), toxicity._winning()])):
        states, state = [x.start for x in parts], whole.start
        for _ in range(5000):
            symbol = out = rng.randrange(toxicity.FIRST + (0 if whole is toxicity.FORWARD else 64))
            for k, part in enumerate(parts):
                states[k], out = part.step(states[k], out)
            state, put = whole.step(state, symbol)
            assert put == out


#: A letter for each word that the brute-force reading knows, and for its marks.
LETTERS = {
    "idiot": "I", "stupid": "I", "kill": "H", "beat": "V", "they": "T", "you": "A", "yourself": "S", "will": "W", "hope": "P", "die": "D", "not": "N", "nobody": "B", "only": "O", "but": "U", "and": "&", "said": "R", "than": ">", "the": "K", "chess": "C",
    ",": ",", ":": ":", '"': '"', ".": ".",
}


def brute_matches(line):
    """Kinds and bits of the matches of a line of words and marks, by patterns over its letters, without automata."""
    words = line.split()
    s = "".join(LETTERS.get(w, "o") for w in words)
    found, rivals = {}, set()
    gap = r"""["W]*(?:[^HVTAPDW",:.K]["W]*){0,3}"""
    wish = r"""P["W]*(?:[^HVTAPDW",:.]["W]*){0,3}[TA]["W]*(?:[^HVPDW",:.]["W]*){0,3}D"""
    for m in re.finditer(rf"""H["W]*S|[HV]{gap}[TA]|{wish}""", s):
        at = m.end() - 1
        sure = s[at] in "SD" or re.search("[WP]", re.split("[:.]", s[:at])[-1])
        found[at] = toxicity.VOWED if sure else toxicity.HARM
        if m[0][0] == "V":
            rivals.add(at)
    direct = set()
    for i in (i for i, c in enumerate(s) if c == "I"):
        near = re.sub('[,"]', "", re.split("[:.U]", s[:i])[-1])[-4:]
        found[i] = toxicity.AIMED if re.search("[ATS]", near) else toxicity.LONE
        if re.search("AI*$", s[:i]):
            direct.add(i)
    t = "".join("M" if i in found else "o" if c in "HVWPD" else c for i, c in enumerate(s))
    reported = {i for m in re.finditer(r"""R[^".]*(?:"[^"]*(?:"|$)|\.|$)""", t) for i in range(*m.span())}
    back = re.finditer(r"""R[^RA,:."]{0,2}(,[^".:]*(?:"[^"]*(?:"|$)|[.:]|$)|"[^"]*(?:"|$))""", t[::-1])
    reported |= {len(t) - 1 - i for m in back for i in range(*m.span(1))}
    out = set()
    for i, kind in found.items():
        deny = re.findall("[NB]", re.split(r"[,:.U]|(?<=[NB])O|(?<=&)[AT]", t[:i])[-1])[-1:]
        negated = bool(deny) and i not in direct
        if s[i] == "I" and re.match(">[TA]", t[i + 1 :]):
            kind, negated = toxicity.AIMED, negated and deny == ["N"]
        if i in rivals and "C" in t[i + 1 :].split(".")[0]:
            continue
        out.add((t[:i].count("."), 4 * kind + negated + 2 * (i in reported), words[i]))
    return [kind for _, kind, _ in out]


def test_matches_against_brute_force():
    rng = random.Random(12)
    words = [*LETTERS, "idiot", "stupid", "you", "said", "not", "b", "c", "d"]
    lines = [[" ".join(rng.choice(words) for _ in range(rng.randrange(18))) for _ in range(rng.randrange(1, 4))] for _ in range(4000)]
    found = np.expm1(toxicity.Grammar({}, toxicity.START).matches(pa.array(["\n".join(x) for x in lines])))
    assert (found.sum(axis=0) > 20).sum() >= 15
    for text, row in zip(lines, found, strict=True):
        want = np.bincount([k for line in text for k in brute_matches(line)], minlength=16)
        assert want.tolist() == np.rint(row).astype(int).tolist(), text


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    rows = toxicity.op8_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    assert sum(caught) > 0.85 * len(caught) and sum(r.predicted for r in rows if r.toxic == 0) < 0.02 * len(rows)


def test_toxicity_edges(spark):
    docs = frame(spark, [None, "", LONG, "you idiot"])
    labels = spark.createDataFrame([(0, 1), (0, None), (99, 1)], "doc_id long, toxic int")
    for told in (labels, labels.limit(0)):
        grammar = toxicity.learn(docs, told)
        rows = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, grammar, keep=["doc_id"]).collect()}
        assert rows == {0: 0, 1: 0, 2: 0, 3: 1}
    assert toxicity.score_toxicity(docs.limit(0), grammar).count() == 0
    out = toxicity.score_toxicity(docs, grammar)
    assert out.columns == ["doc_id", "text", "source", "n_words", "score", "predicted"] and out.schema["score"].dataType.simpleString() == "double"
