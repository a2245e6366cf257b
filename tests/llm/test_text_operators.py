"""Decontamination, quality, licences, line dedup, language ID: against brute force, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from starloom.llm import decontaminate, langid, licenses, line_dedup, oracles, quality, queries
from starloom.llm.common import mix64

from .conftest import by_id

ODD = [None, "", "   \n\t ", "!!! ??? ###", "x" * 300_000, "a\x00b c\x1dd  é\n", "é" * 25]
WORD1 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(rng, n, vocabulary=60, caps=True):
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return "".join((w.upper() if caps and rng.random() < 0.1 else w) + rng.choice([" ", " ", ", ", ".\n"]) for w in words)


# ---- decontamination


def brute_hits(text, items, window=10):
    words = WORD1.findall((text or "").translate(AZ))
    hit, found = set(), set()
    for item, t in items:
        own = WORD1.findall((t or "").translate(AZ))
        for i in range(max(1, len(own) - window + 1) if own else 0):
            w = own[i : i + window]
            for j in range(len(words) - len(w) + 1):
                if words[j : j + len(w)] == w:
                    hit |= set(range(j, j + len(w)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.fixture(scope="module")
def contaminated():
    rng = random.Random(1)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 14, 25]), 500)) for i in range(12)] + [(90, None), (91, "..."), (3, prose(rng, 12, 500)), (100, "Short one")]
    texts = [prose(rng, 40, 500) + (items[k % 12][1] * 2 if k % 2 else "") + prose(rng, 5, 500) for k in range(20)] + ["SHORT, one! short", "É " + items[2][1] + " é"]
    return items, texts + ODD


@pytest.mark.parametrize("most", [64 << 20, 2_000])
def test_decontamination_equals_brute_force(spark, make, contaminated, most):
    items, texts = contaminated
    got = by_id(decontaminate.scan(make(texts), spark.createDataFrame(items, "item_id long, text string"), most_pattern_bytes=most))
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == brute_hits(t, items), i
        spans = "".join((t or "")[a:b] + " " for a, b in zip(got[i]["span_starts"], got[i]["span_ends"], strict=True))
        assert len(WORD1.findall(spans.translate(AZ))) == got[i]["n_hit"]


def test_decontamination_query_and_filter(spark, make, stored, contaminated):
    items, texts = contaminated
    got = by_id(queries.op1_decontaminate(spark, stored(texts, items)))
    _, hits, found = brute_hits(texts[1], items)
    assert got[1]["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest() and got[1]["n_hit"] == hits and got[1]["contaminated"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}
    for most in (64 << 20, 2_000):
        kept = decontaminate.keep_clean(make(texts).withColumn("n_hit", F.lit("x")), bench, most_pattern_bytes=most)
        assert {r[0] for r in kept.select("doc_id").collect()} == want and "n_hit" in kept.columns
    assert decontaminate.keep_clean(make(texts), bench.limit(0)).count() == len(texts)
    assert decontaminate.scan(make(texts).limit(0), bench).count() == 0


@pytest.mark.parametrize("most", [64 << 20, 2_000])
def test_decontamination_judges_rows_of_one_id_each_for_itself(spark, make, contaminated, most):
    items, texts = contaminated
    rows = [(i, t, "en", "s", None) for i in (None, 7) for t in (texts[0], texts[1], texts[1], texts[3], None)]
    got = decontaminate.scan(make(rows), spark.createDataFrame(items, "item_id long, text string"), most_pattern_bytes=most)
    have = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], list(r["items"])) for r in got.collect())
    assert have == sorted((str(r[0]), *brute_hits(r[1], items)) for r in rows)


# ---- quality


def brute_base(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_base_equals_brute_force(spark, stored):
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(60), 8) for _ in range(30)] + [prose(rng, 30) * 3, "# a\n# a\n\n# a", "é ü\nß"] + ODD
    labels = [(i, i % 2, 0) for i in range(0, 30, 3)] + [(1, 1, 0), (1, 0, 0), (None, 1, 0)]
    got = by_id(queries.op3_quality(spark, stored(texts, labels=labels)))
    for i, t in enumerate(texts):
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute_base(t), i
        assert got[i]["base_failed"] is False or got[i]["kept"] is False


def brute_ratio(texts, trusted, buckets, share):
    """log p_target - log p_raw by bucket, each n-gram hashed by itself."""
    bucket = lambda gram: int(mix64(np.array([xxhash.xxh3_64_intdigest(gram[0].encode())], np.uint64))[0] if len(gram) == 1 else mix64(np.array([xxhash.xxh3_64_intdigest(gram[0].encode())], np.uint64) * np.uint64(3) + mix64(np.array([xxhash.xxh3_64_intdigest(gram[1].encode())], np.uint64)))[0]) % buckets
    grams = lambda t: [bucket(g) for n in (1, 2) for w in [WORD.findall(t or "")] for g in (tuple(w[i : i + n]) for i in range(len(w) - n + 1))]
    raw = Counter(b for t in texts for b in grams(t))
    target = Counter(b for t, good in zip(texts, trusted, strict=True) if good for b in grams(t))
    n, m = sum(raw.values()), sum(target.values())
    score = lambda t: sum(math.log((1 - share) * (target[b] / m) / (raw[b] / n) + share) for b in grams(t)) / len(grams(t)) if grams(t) else None
    return score


def test_quality_scores_equal_brute_force(spark, make):
    rng = random.Random(13)
    texts = [prose(rng, rng.randrange(5, 60), 40) for _ in range(40)] + ODD
    trusted = [i % 3 == 0 for i in range(len(texts))]
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(trusted)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    for buckets in (64, 1 << 16):
        score = brute_ratio(texts, trusted, buckets, 0.25)
        ratio = quality.fit(make(texts), labels, buckets)
        want = [score(t) for t in texts]
        cut = sorted(x for x in want if x is not None)[20]
        for threshold in (-0.3, cut):
            got = by_id(quality.judge(make(texts), ratio, threshold))
            for i, t in enumerate(texts):
                assert (got[i]["score"] is None) == (want[i] is None) and (want[i] is None or got[i]["score"] == pytest.approx(want[i], abs=1e-9))
                assert got[i]["kept"] == (not brute_base(t)[-1] and got[i]["score"] >= threshold)
        own = by_id(quality.judge(make(texts), ratio, got[3]["score"]))  # a tie at the threshold is kept
        assert own[3]["kept"] == (not own[3]["base_failed"])


def test_quality_tells_junk_from_trusted_text(spark, make):
    rng = random.Random(3)
    walk = lambda at: " ".join(f"w{(at := (at + rng.randrange(1, 7)) % 40)}" for _ in range(80))  # noqa: E731  few pairs of words, so that a third of the texts shows them all
    good = [walk(k % 40) for k in range(60)]
    junk = [" ".join(f"zz{rng.randrange(40)}!!" for _ in range(80)) for _ in range(30)]
    docs = make(good + junk)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    got = by_id(quality.judge(docs, quality.fit(docs, labels)))
    assert all(got[i]["kept"] for i in range(60)) and not any(got[i]["kept"] for i in range(60, 90))
    assert by_id(quality.judge(docs, quality.fit(docs, labels, most_broadcast_ids=0))) == got
    none = quality.fit(docs, labels.limit(0))
    assert not none.any() and all(r["kept"] for r in quality.judge(docs, none).collect())
    assert quality.judge(make([(5, None, None, None, None)]).limit(0), none).count() == 0


@pytest.mark.parametrize("n", [200, 1200])
def test_quality_verdict_on_labelled_junk_at_two_sizes(spark, stored, n):
    """Junk words are made of trusted ones' letters and share their frequent words, so full buckets hide them."""
    rng = random.Random(n)
    own = lambda a, b: "".join(rng.choices("abcdefgh", k=rng.randrange(a, b)))
    frequent = [own(2, 4) for _ in range(12)]
    known = [own(3, 9) for _ in range(3000)]
    good = lambda: " ".join(rng.choice(frequent if rng.random() < 0.5 else known) for _ in range(150))
    junk = lambda: " ".join(rng.choice(frequent) if rng.random() < 0.5 else own(3, 9) for _ in range(150))
    texts = [junk() if k % 8 == 0 else good() for k in range(n)]
    got = by_id(queries.op3_quality(spark, stored(texts, labels=[(i, int(i % 8 > 0), 0) for i in range(0, n) if i % 16 in (0, 1, 2, 3, 4, 5)])))
    passed = [i for i in range(n) if not got[i]["base_failed"]]
    lost = sum(not got[i]["kept"] for i in passed if i % 8)
    stayed = sum(got[i]["kept"] for i in passed if i % 8 == 0)
    assert stayed <= 0.05 * n / 8 and lost <= 0.05 * n


def test_quality_learns_from_all_labelled_documents(spark, make):
    """The ratio counts every trusted document; the threshold is that of all labelled ones, the trusted scored without themselves."""
    rng = random.Random(21)
    texts = [prose(rng, rng.randrange(12, 60), 400 if i % 3 else 40) for i in range(60)] + [prose(rng, 3), prose(rng, 10, 2) * 4, None]
    quality_of = {i: int(i % 3 == 0) for i in range(len(texts)) if i % 4 != 1}
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality_of.items()] + [(3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    trusted = [quality_of.get(i) == 1 for i in range(len(texts))]
    passed = [i for i in quality_of if not brute_base(texts[i])[-1]]
    alone = lambda i: brute_ratio(texts, [t and j != i for j, t in enumerate(trusted)], quality.LEAST_BUCKETS, 0.25)(texts[i])
    score = {i: alone(i) for i in passed}
    good, junk = ([score[i] for i in passed if quality_of[i] == q] for q in (1, 0))
    values = sorted(set(good + junk))
    cuts = [values[0], *((a + b) / 2 for a, b in zip(values, values[1:], strict=False))]
    gain = lambda c: sum(x >= c for x in good) * len(junk) + sum(x < c for x in junk) * len(good)
    want = max(cuts, key=lambda c: (gain(c), -c))
    for most in (2_000_000, 0):
        ratio, threshold = quality.learn(make(texts), labels, most_broadcast_ids=most)
        assert np.array_equal(ratio, quality.fit(make(texts), labels, len(ratio)).astype(np.float32))
        assert threshold == pytest.approx(want, abs=1e-6)
    one = quality.learn(make(texts), labels.where("doc_id = 0"))
    assert one[0].any() and one[1] == 0  # its score without itself


def test_quality_cut_over_ranges_of_scores(spark):
    rng = np.random.default_rng(5)
    for good_n, junk_n, places in ((900, 700, 2), (900, 700, 1), (40, 3, 1), (5, 0, 3), (1, 0, 3), (700, 0, 2), (0, 9, 2), (0, 0, 1), (3, 3, 0)):
        good, junk = np.round(rng.normal(0.5, 1, good_n), places), np.round(rng.normal(-0.5, 1, junk_n), places)
        got = quality.best_cut(spark.createDataFrame([(True, float(x)) for x in good] + [(False, float(x)) for x in junk], "trusted boolean, score double").repartition(5))
        if not good_n:
            assert got == -np.inf
        elif not junk_n:
            assert got == pytest.approx(np.quantile(good, 0.01), abs=1e-12)
        else:
            values = np.unique(np.concatenate([good, junk]))
            cuts = [values[0], *((values[1:] + values[:-1]) / 2)]
            want = max(cuts, key=lambda c: (int((good >= c).sum()) * junk_n + int((junk < c).sum()) * good_n, -c))
            assert got == want


# ---- licences


def test_licences_by_canonical_digest(spark, make):
    mit = dict(licenses.KNOWN[:1])["MIT"]
    texts = {
        "MIT": mit,
        "wrapped": "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(" ", "\n  "),
        "quoted": "MIT Licence\n// Copyright 1999 X. All rights reserved.\n" + mit.replace('"', "“").replace("-", "–"),
        "more": mit + " And more.",
        "part": mit[:200],
        "notice": "licensed under CC BY-NC 4.0",
        "named": "Copyright Jane Doe\r\n  * Copyright by The Foo Authors and J. Doe.\n\n" + mit,
        "not named": "Copyright of all that follows\n" + mit,
    }
    got = by_id(licenses.scan(make([*texts.values(), *ODD]), licenses.known_licenses(spark)))
    assert [got[i]["license_id"] for i in range(8)] == ["MIT", "MIT", "MIT", None, None, "CC-BY-NC-4.0-notice", "MIT", None]
    assert got[8]["digest"] is None and got[9]["digest"] == hashlib.sha256(b"").hexdigest() and not any(got[i]["is_license"] for i in range(8, 15))
    again = licenses.scan(make([mit, mit, None]), licenses.known_licenses(spark)).collect()  # repeated rows
    assert [r["license_id"] for r in sorted(again, key=lambda r: r["doc_id"])] == ["MIT", "MIT", None]
    own = spark.createDataFrame([("B", "The colour\nof X"), ("A", "the color of x!"), ("C", None), ("D", "...")], "license_id string, text string")
    docs = make(["THE COLOUR OF X", "...", "the colour"]).withColumn("license_id", F.lit(1))
    for most in (100, 0):
        assert [by_id(licenses.scan(docs, own, most))[i]["license_id"] for i in range(3)] == ["A", None, None]
    assert licenses.scan(docs, own.limit(0)).where("is_license").count() == 0
    plan = licenses.scan(docs, own)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licences_equal_their_sql(spark, make, stored):
    """Whole licences, reworded in the ways that the normal form knows and in others, against SQL of its own."""
    rng = random.Random(12)
    known = [(r["license_id"], r["text"]) for r in licenses.known_licenses(spark).collect()]
    texts = []
    for _, t in rng.sample(known, 60):
        t = f"Copyright {rng.choice(['(c) 1999 X', 'Jane Doe', '2020', 'by no one in particular'])}\n{t}" if rng.random() < 0.5 else t
        t = t.replace("license", "licence").replace("-", "–") if rng.random() < 0.5 else t
        texts.append(t.upper() if rng.random() < 0.2 else t + " Changed." if rng.random() < 0.2 else t)
    texts += ODD
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = {r[0]: r[1:] for r in con.execute(f"select doc_id, digest, license_id, is_license from ({oracles.SQL['op6_licenses']})").fetchall()}
    got = {r["doc_id"]: (r["digest"], r["license_id"], r["is_license"]) for r in queries.op6_licenses(spark, stored(texts)).collect()}
    assert got == want and 30 < sum(x[2] for x in got.values()) < 60


def test_whole_licence_files_and_all_notices_are_known(spark, make):
    rows = [(r["license_id"], r["text"]) for r in licenses.known_licenses(spark).collect()]
    whole = {i: max((t for j, t in rows if j == i), key=len) for i in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "BSL-1.0")}
    assert all(len(whole[i]) > n for i, n in (("Apache-2.0", 10_000), ("GPL-2.0", 15_000), ("GPL-3.0", 30_000), ("LGPL-2.1", 20_000), ("LGPL-3.0", 7_000), ("MPL-2.0", 15_000), ("CC0-1.0", 6_000), ("Unlicense", 1_000), ("BSL-1.0", 1_000)))
    filled = whole["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2021 Somebody")
    notices = {"Released under the MIT License.": "MIT-notice", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-notice", "Licensed under the Apache License, Version 2.0.": "Apache-2.0-notice", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-notice"}
    texts = [*(t.upper().replace("\n", "\r\n  ") for t in whole.values()), filled, *notices, "prose\n" + next(iter(notices))]
    got = by_id(licenses.scan(make(texts), licenses.known_licenses(spark)))
    assert [got[i]["license_id"] for i in range(len(texts))] == [*whole, "Apache-2.0", *notices.values(), None]


# ---- line dedup


def brute_lines(rows, chars=20, docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(AZ)
    holders = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                holders[k].append((n, i))
    keeper = {k: max((i for _, i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in keeper or i is None or keeper[key(x)] is None or i >= keeper[key(x)]]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_line_dedup_equals_brute_force(spark, make, batches):
    rng = random.Random(4)
    pool = [f"Line number {k} of the common pool" for k in range(12)] + ["short", "é" * 19, "é" * 20, "", " \t"]
    texts = ["\n".join(rng.choice([" ", ""]) + (p.upper() if rng.random() < 0.3 else p) + rng.choice(["\r", "", " "]) for p in rng.choices(pool, k=rng.randrange(1, 9))) for _ in range(40)] + ODD
    rows = list(enumerate(texts)) + [(None, pool[0]), (7, pool[1]), (7, pool[1])]
    docs = make([(i, t, "x", "s", 1) for i, t in rows], "doc_id long, text string, lost string, hi string, n_chars long")
    got = line_dedup.drop_repeated_lines(docs, batches=batches)
    assert got.columns[:5] == docs.columns
    have = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()), key=repr)
    assert have == sorted(brute_lines(rows), key=repr)
    beyond = line_dedup.drop_repeated_lines(docs, batches=batches, most_broadcast=0)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in beyond.collect()), key=repr) == have
    assert {t["namespace"] if isinstance(t, dict) else t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")} == set()


def test_line_runs_merge_without_a_shuffle(spark, make):
    index = line_dedup.LineIndex(spark, 4, fan=3)
    pairs = line_dedup.line_keys(make(["a line that is long enough\nand yet another long line", "a line that is long enough"]))
    try:
        for _ in range(2):
            index.add(pairs)
        assert len(index.runs()) == 2 and "Exchange" not in index.merged(*index.runs())._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["n"] for r in index.frequent(1).collect()) == [2, 4]
    finally:
        index.close()


def test_line_dedup_of_nothing(spark, make, stored):
    assert line_dedup.drop_repeated_lines(make(["a"]).limit(0)).count() == 0
    got = by_id(queries.op7_line_dedup(spark, stored([None, "", "a\n\nb"])))
    assert [got[i]["n_lines"] for i in range(3)] == [1, 1, 3] and got[0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()


# ---- language ID


def brute_profile(text):
    """Counts of 1- to 3-grams over letters and merged blanks."""
    chars = " " + "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text) + " "
    chars = re.sub(" +", " ", chars)
    grams = Counter()
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            g = chars[i : i + n]
            if g.strip() and (n < 3 or g[1] != " "):
                grams[g] += 1
    return grams


def test_language_grams_equal_brute_force():
    letters = langid.Letters()
    for text in ("Ab, ab!", "Écrit  à ß", "x", "日本 語a", "İIıi"):
        counts = Counter(Counter(langid.grams_of(letters.codes(text.encode())).tolist()).values())
        assert counts == Counter(brute_profile(text).values()), text
    assert not len(langid.grams_of(letters.codes(b" 1 2 ")))


def brute_language(text, profiles, profile):
    """The nearest language by out-of-place distance, and the score, with n-grams as strings."""
    code = lambda g: sum(((ord(c) if c != " " else 0) << 21 * (len(g) - 1 - k)) for k, c in enumerate(g)) + {1: 0, 2: 1 << 62, 3: 1 << 63}[len(g)]
    ranks = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:profile]
    own = ranks(brute_profile(text or ""))
    if not own:
        return "und", 0.0
    best = min((sum(abs(p.index(g) - r) if g in p else profile for r, g in enumerate(own)), lang) for lang, p in ((lang, ranks(c)) for lang, c in profiles.items()))
    return best[1], 1 - best[0] / (profile * len(own))


@pytest.mark.parametrize("profile", [12, 400])
def test_language_predictions_equal_brute_force(spark, make, profile):
    rng = random.Random(14)
    words = {"xa": ["kari", "toka", "rito", "été"], "xb": ["schlung", "eiung", "schl"], "xc": ["eauoi", "queau", "oique", "été"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]).title() + rng.choice(["", ",", "."]) for _ in range(n))
    rows = [(i, text(lang, rng.choice([1, 5, 40])), lang, "s", 0) for i, lang in enumerate(["xa", "xb", "xc"] * 8)]
    profiles = defaultdict(Counter)
    for _, t, lang, _, _ in rows:
        profiles[lang] += brute_profile(t)
    more = [*rows, (3, rows[3][1], None, None, None), (None, "kari été", None, None, None), *((100 + i, t, None, None, None) for i, t in enumerate([*ODD, "zzz", "kari schlung eauoi", "日本 kari"]))]
    got = langid.predict(make(more), langid.learn(make(rows), profile), profile).collect()
    have = sorted((str(r["doc_id"]), r["lang_pred"], round(r["score"], 9)) for r in got)
    want = [(str(r[0]), *brute_language(r[1], profiles, profile)) for r in more]
    assert have == sorted((i, lang, round(score, 9)) for i, lang, score in want)


def test_language_held_out_accuracy(spark, stored):
    rng = random.Random(5)
    syllables = {"xa": ["ka", "ri", "to"], "xb": ["schl", "ung", "ei"], "xc": ["eau", "oi", "que"]}
    texts = [" ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(rng.choice([4, 60]))) for _ in range(40) for lang in syllables]
    rows = [(i, t, list(syllables)[i % 3], "s", 0) for i, t in enumerate(texts)] + [(900 + i, t, None, None, None) for i, t in enumerate(ODD)] + [(None, "ka ri to", "xa", "s", 0)]
    got = queries.op9_langid(spark, stored(rows)).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert sum(r["lang_pred"] == list(syllables)[r["doc_id"] % 3] for r in held) / len(held) > 0.95
    odd = {r["doc_id"] - 900: r for r in got if r["doc_id"] and r["doc_id"] >= 900}
    assert [odd[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and all(0 <= r["score"] <= 1 for r in got) and odd[0]["score"] == 0


def test_language_profiles_and_filter(spark, make):
    docs = make([(1, "abab abab", "b", "s", 0), (2, "abab abab", "a", "s", 0), (3, None, "a", "s", 0), (4, "x", None, "s", 0)])
    profiles = langid.learn(docs, 5)
    assert list(profiles) == ["a", "b"] and profiles["a"].tolist() == profiles["b"].tolist() and len(profiles["a"]) == 5
    got = by_id(langid.predict(docs, profiles, 5))
    assert got[1]["lang_pred"] == "a" and got[1]["score"] == 1.0  # ties: the first by name
    assert [r[0] for r in langid.keep_known(docs, profiles, 5).orderBy("doc_id").select("doc_id").collect()] == [1, 2, 4]
    assert {r["lang_pred"] for r in langid.predict(docs, langid.learn(docs.limit(0))).collect()} == {"und"}
    assert langid.learn(docs.drop("lang")) == {} and langid.keep_known(docs, {}, least=0.9).count() == 3  # nothing learned: texts with a letter
    assert np.array_equal(langid.ranked(np.array([3, 1, 1, 2, 3], np.uint64), 2), [1, 3])
