"""Language model, suffix dedup, near-duplicates and the pipeline: against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import tempfile
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from starloom.llm import kneser_ney, minhash, packing, queries, suffix_array, suffix_dedup

from .conftest import by_id
from .test_text_operators import AZ, ODD, WORD, brute_hits, brute_lines, prose

# ---- language model


def tokens(text):
    return [*WORD.findall((text or "").translate(AZ)), None]


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney, straight from its definition."""
    grams = {k: Counter() for k in range(1, order + 1)}
    for t in texts:
        padded = ["<s>"] * (order - 1) + tokens(t)
        for i in range(order - 1, len(padded)):
            for k in range(1, order + 1):
                grams[k][tuple(padded[i - k + 1 : i + 1])] += 1
    adjusted = {order: grams[order]}
    for k in range(order - 1, 0, -1):
        left = Counter(g[1:] for g in grams[k + 1])
        adjusted[k] = Counter({g: n if k > 1 and set(g[:-1]) == {"<s>"} else left[g] for g, n in grams[k].items()})
    d = {k: kneser_ney.discounts([sum(n == c for n in a.values()) for c in (1, 2, 3, 4)]) for k, a in adjusted.items()}
    total, by = defaultdict(Counter), defaultdict(Counter)
    for k, a in adjusted.items():
        for g, n in a.items():
            total[k][g[:-1]] += n
            by[k][g[:-1], min(n, 3)] += n > 0
    v = len(grams[1])

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (v + 1)
        t = total[k][gram[:-1]]
        if not t:
            return p(gram[1:])
        n = adjusted[k][gram]
        less = max(n - d[k][min(n, 3) - 1], 0) if n else 0
        return less / t + sum(d[k][c - 1] * by[k][gram[:-1], c] for c in (1, 2, 3)) / t * p(gram[1:])

    return p, grams[1]


@pytest.mark.parametrize("order", [2, 3])
def test_model_equals_its_definition(spark, make, order):
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(40), 25) for _ in range(60)] + [None, "", "once"]
    docs = make(texts)
    model = kneser_ney.train(docs, order=order, shards=4, flush=300)
    p, counts = brute_model(texts, order)
    more = [*texts[:5], "unknown words w1", prose(rng, 30, 40), *ODD]
    got = by_id(kneser_ney.score(make(more), model))
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(more):
        padded = ["<s>"] * (order - 1) + tokens(t)
        want = sum(math.log10(p(tuple(padded[j - order + 1 : j + 1]))) for j in range(order - 1, len(padded)))
        base = sum(math.log10((counts[w,] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        assert got[i]["score"] == pytest.approx(want, rel=1e-5) and got[i]["base_score"] == pytest.approx(base, rel=1e-9), i
        assert (got[i]["n_tokens"], got[i]["n_known"]) == (len(tokens(t)), sum(counts[w,] > 0 for w in tokens(t)))
    kneser_ney.remove(spark, model)


def test_model_query(spark, stored):
    rng = random.Random(2)
    walk = lambda n, at=0: " ".join(f"w{(at := (at + rng.choice([1, 3])) % 30)}" for _ in range(n))  # noqa: E731  a word tells much of the next
    texts = [walk(50) for _ in range(50)] + ODD
    got = by_id(queries.op4_kneser_ney(spark, stored(texts)))
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    assert {r["train_tokens"] for r in got.values()} == {sum(len(tokens(t)) for t in train)} and len(got) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1) for i, r in got.items())
    held = [r for i, r in got.items() if r["held_out"] and i < 50]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_model_scores_rows_of_one_id_each_for_itself(spark, stored):
    rows = [(i, t, "", "", 0) for i, t in [(None, "a b"), (None, "a b c"), (7, "a"), (7, "a b"), (7, "a b"), (9, None)]]
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"]) for r in queries.op4_kneser_ney(spark, stored(rows)).collect()), key=repr)
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    assert got == sorted(((i, out(i), len(tokens(t))) for i, t, *_ in rows), key=repr)


def test_model_of_nothing(spark, make):
    model = kneser_ney.train(make(["a"]).limit(0))
    row = kneser_ney.score(make(["a b"]), model).first()
    assert (row["n_tokens"], row["n_known"], model.tokens) == (3, 0, 0) and math.isfinite(row["score"])


def test_frequent_bigrams_keep_their_counts(spark, make):
    model = kneser_ney.train(make(["x y " * 400]), shards=2)
    p, _ = brute_model(["x y " * 400], 2)
    assert by_id(kneser_ney.score(make(["x y"]), model))[0]["score"] == pytest.approx(sum(math.log10(p(g)) for g in (("<s>", "x"), ("x", "y"), ("y", None))), rel=1e-5)


# ---- suffix dedup


@pytest.mark.parametrize(("memory", "block"), [(8 << 20, 1 << 18), (40, 9), (20, 5)])
def test_suffix_order_with_common_prefixes(memory, block):
    rng = random.Random(3)
    for _ in range(60):
        s = bytes(rng.choices(rng.choice([b"ab", b"aaab", b"a\x00c", bytes(range(200))]), k=rng.randrange(160)))
        s = (s + s[: rng.randrange(80)] + s if rng.random() < 0.6 else s) + b"a" * rng.choice([0, 150, 400]) + b"\xfe"
        out = list(suffix_array.descending(padded(s), len(s), memory, block))
        at, lcp = [int(x) for a, _ in out for x in a], [int(x) for _, c in out for x in c]
        assert at == sorted(range(len(s)), key=lambda i: s[i:], reverse=True)
        for i in range(1, len(at)):
            a, b = s[at[i - 1] :], s[at[i] :]
            same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert min(lcp[i], 240) == min(same, 240)


def padded(s):
    return np.frombuffer(s + bytes(suffix_array.PAD), np.uint8)


@given(st.lists(st.integers(0, 6), min_size=1, max_size=120), st.integers(1, 4), st.sampled_from([(8, 3), (20, 7), (1000, 50)]))
@settings(max_examples=150, deadline=None)
def test_recursion_orders_strings_of_names(letters, times, sizes):
    letters = letters * times
    got = [int(x) for part in suffix_array.suffix_order(np.array(letters), *sizes).blocks(5) for x in part]
    assert got == sorted(range(len(letters)), key=lambda i: letters[i:])


def test_suffix_sorting_far_beyond_its_memory():
    """A text of 80 times the items that may be held: what is allocated does not grow with it, and the order is that of memory."""
    rng = random.Random(9)
    text = prose(rng, 450_000, 5000).encode()[:1_600_000] + b"\xfe"
    peaks = []
    for n in (400_000, 1_600_000):
        part = text[:n] + b"\xfe"
        with tempfile.TemporaryFile() as f:
            f.write(part + bytes(suffix_array.PAD))
            f.flush()
            mapped = np.memmap(f, np.uint8, "r")
            tracemalloc.start()
            at = zlib.crc32(b"")
            for a, _ in suffix_array.descending(mapped, len(part), 20_000, 4_000):
                at = zlib.crc32(a.astype("<i8").tobytes(), at)
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
        want = zlib.crc32(b"")
        for a, _ in suffix_array.descending(padded(part), len(part)):
            want = zlib.crc32(a.astype("<i8").tobytes(), want)
        assert at == want
    assert peaks[1] < 1.3 * peaks[0] and peaks[1] < 12 << 20, peaks


def brute_repeats(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            place = (math.inf if i is None else i, k)
            first[b[k : k + length]] = min(first.get(b[k : k + length], place), place)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (math.inf if i is None else i, k):
                gone[k : k + length] = b"\1" * length
        out.append((i, len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("length", "gram", "shard_bytes", "memory", "heavy", "block"), [(100, 24, 8 << 20, 3 << 20, None, 1 << 18), (20, 6, 300, 50, 8, 11), (20, 6, 3000, 400, 2, 40)])
def test_suffix_dedup_equals_brute_force(spark, make, length, gram, shard_bytes, memory, heavy, block):
    rng = random.Random(4)
    pool = [prose(rng, 30) for _ in range(6)] + ["=" * 400, "é ü " * 60]
    rows = [(rng.randrange(1000), prose(rng, rng.randrange(12)) + "".join(rng.choices(pool, k=rng.randrange(3))) + prose(rng, 4)) for _ in range(40)]
    rows += [(rng.randrange(1000), f"{prose(rng, 3)}a short line in many{prose(rng, 3)}") for _ in range(30)]
    rows += [(None, pool[0]), (5, pool[1]), (5, pool[1]), (5, "other " + pool[1]), (6, None), (7, ""), (8, "x" * 5000)]
    got = suffix_dedup.remove_repeats(make([(i, t, "", "", 0) for i, t in rows], "doc_id long, text string, kept string, print string, n_chars long"), length, gram, shard_bytes, memory, heavy, block)
    have = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()), key=repr)
    assert have == sorted(brute_repeats(rows, length), key=repr)


def test_a_line_in_many_texts_is_dealt_to_many_shards():
    """A short line with other neighbours each time: one representative by short grams, as many as there are texts by longer ones."""
    rng = random.Random(10)
    texts = [(prose(rng, 40, 10**6) + "a line of forty bytes or so, the same one" + prose(rng, 40, 10**6)).encode() for _ in range(200)]
    windows = suffix_dedup.Windows(texts, 100)
    _, first, last, keys = windows.runs(24)
    value, n = np.unique(keys, return_counts=True)
    assert n.max() >= 100
    hot = np.isin(keys, value[n >= 100])
    windows.only(first[hot], last[hot])
    assert 0 < windows.wanted.sum() == (last[hot] - first[hot]).sum()
    assert np.unique(windows.runs(62)[3], return_counts=True)[1].max() <= 3


def test_longer_grams_are_sought_in_heavy_windows_alone(monkeypatch, tmp_path):
    """Of 200 long texts a short line is heavy: what comes after the first count hashes the bytes around it, and finds what a look at all bytes finds."""
    rng = random.Random(11)
    line = b"a line of forty bytes or so, the same one"
    texts = [b"", *(prose(rng, 300, 10**6).encode() + line + prose(rng, 300, 10**6).encode() for _ in range(200)), b"short"]
    seen, whole = [], suffix_dedup.representatives
    monkeypatch.setattr(suffix_dedup, "representatives", lambda data, *sizes: (seen.append(len(data)), whole(data, *sizes))[1])
    windows = suffix_dedup.Windows(texts, 100)
    owner, first, last, keys = windows.runs(24)
    value, n = np.unique(keys, return_counts=True)
    hot = np.isin(keys, value[n >= 100])
    windows.only(first[hot], last[hot])
    got = windows.runs(62)
    assert seen[0] == len(windows.data) and seen[1] < 0.1 * seen[0]
    low, hashes = whole(windows.data, 100, 62)
    at = np.flatnonzero(windows.wanted)
    new = np.concatenate([[True], (low[at[1:]] != low[at[:-1]]) | (at[1:] != at[:-1] + 1)])
    assert got[1].tolist() == at[new].tolist() and got[3].tolist() == hashes[low[at[new]]].tolist()
    assert got[2].tolist() == (np.append(at[np.flatnonzero(new)[1:] - 1], at[-1]) + 1).tolist()
    assert got[0].tolist() == (np.searchsorted(windows.begins, at[new], "right") - 1).tolist()
    # the same windows, cut out and counted apart from their texts
    suffix_dedup.save(str(tmp_path), "heavy0.0.key", value[n >= 100].astype("<u8"))
    cut = list(suffix_dedup._heavy(100, 24, 0, "text", str(tmp_path), 1, 2000)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
    assert sum(b.num_rows for b in cut) > 5
    counts = list(suffix_dedup._counter(100, 62, "stretches", 1)(iter(cut)))
    keys, n = (np.concatenate([np.frombuffer(x, kind) for b in counts for x in b.column(c).to_pylist()]) for c, kind in (("keys", "<u8"), ("n", "<u2")))
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == dict(Counter(got[3].tolist()))


def test_spans_that_touch_are_one():
    spans = np.array([[1, 7, 5, 9], [1, 7, 0, 5], [1, 7, 2, 3], [1, 7, 10, 12], [1, 8, 0, 1], [0, 7, 3, 4]])
    assert suffix_dedup.united(spans).tolist() == [[0, 7, 3, 4], [1, 7, 0, 9], [1, 7, 10, 12], [1, 8, 0, 1]]


def test_suffix_dedup_query(spark, stored, make):
    text = prose(random.Random(5), 60)
    got = by_id(queries.op5_suffix_dedup(spark, stored([text, "!" + text, None])))
    assert (got[0]["n_removed"], got[1]["n_removed"], got[1]["n_spans"]) == (0, len(text), 1)
    assert got[1]["kept_sha256"] == hashlib.sha256(b"!").hexdigest() and got[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert suffix_dedup.remove_repeats(make(["a"]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(make(["a"]), 250)


# ---- near-duplicates


def shingle_set(text):
    w = WORD.findall((text or "").translate(AZ))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if None not in (rows[x][0], rows[y][0]) and a and 100 * len(a & b) >= percent * len(a | b):
                i, j = sorted((root(rows[x][0]), root(rows[y][0])))
                up[j] = i
    return [(i, len(s), None if i is None else root(i), i is None or root(i) == i) for (i, _), s in zip(rows, sets, strict=True)]


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def near_rows():
    """Families whose members differ by one to four edits each, so that many pairs lie on either side of the threshold; and a passage that many share."""
    rng = random.Random(6)
    rows = []
    for base in [" ".join(f"b{f}w{rng.randrange(400)}" for _ in range(150)) for f in range(3)]:
        rows += [base, base, base.upper()] + [edited(rng, base, rng.choice([1, 2, 3, 3, 4])) for _ in range(25)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [f"{passage} " + " ".join(f"own{rng.randrange(10**6)}" for _ in range(rng.choice([4, 6, 8, 60]))) for _ in range(30)]
    rows += ["one", "ONE", "one two three four", "One two three four", "a b c d e", *ODD]
    rng.shuffle(rows)
    return [*enumerate(rows), (None, rows[0]), (3, rows[4]), (3, rows[4])]


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_duplicates_lose_no_link(spark, make, rounds):
    rows = near_rows()
    docs = make([(i, t, "", "", 0) for i, t in rows], "doc_id long, text string, a string, rep string, n_chars long")
    got = minhash.near_duplicates(docs, percent=85, rounds=rounds)
    have = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()), key=repr)
    assert have == sorted(brute_components(rows, 85), key=repr)


def test_near_duplicates_query_and_filter(spark, make, stored):
    rows = [t for _, t in near_rows()][:40]
    got = by_id(queries.op8_minhash(spark, stored(rows)))
    want = brute_components(list(enumerate(rows)), 85)
    assert [(i, got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) for i in range(40)] == want
    kept = minhash.keep_one(make(rows), 85)
    assert kept.columns == make(rows).columns and {r[0] for r in kept.select("doc_id").collect()} == {w[0] for w in want if w[3]}
    assert minhash.near_duplicates(make(["a"]).limit(0)).count() == 0 and minhash.keep_one(make([None, ""])).count() == 2


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (7, 7)], "a long, b long")
    got = {r["doc_id"]: r["component"] for r in minhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 50: 50, 51: 50}


# ---- pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark, stored, make):
    rng = random.Random(7)
    base = [prose(rng, 60, 200, False) for _ in range(12)]
    shared = "a line that stands in many documents"
    item = " ".join(f"q{k}" for k in range(14))
    texts = [b + f"\n{shared} \n" + prose(rng, 9, 300, False) for b in base] + [edited(rng, base[0], 1), base[1] + f" {item} ", "12345 !!!", None, ""]
    at = stored(texts, [(1, item)])
    docs = [(i, t) for i, t in enumerate(texts) if re.search("[a-zA-Z]", t or "")]
    docs = [(i, t) for i, _, _, t in brute_lines(docs)]
    near = brute_components(docs, 80)
    docs = [d for d, n in zip(docs, near, strict=True) if n[3]]
    docs = [d for d in docs if not brute_hits(d[1], [(1, item)])[1]]
    want = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in packing.pack(make([(i, t, "", "", 0) for i, t in docs])).collect()}
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, at).collect()}
    assert got == want and 0 < len(docs) < len(texts)


def test_language_stage_drops_gibberish_and_unlearned_languages(spark, make):
    rng = random.Random(8)
    english = "the of and to in that for with was his they are from this have not but had were which their one you all will would there been if more when who so out up into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long here get both between life being under never day same another know while last might us great old year off come since against go came right used take three".split()
    german = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine seiner worden will zwischen immer millionen was sagte gibt alle seit muss wurden beim doch jetzt waren drei jahre neue neuen damit bereits da ihr seinen müssen ab ihrer ohne sondern selbst ersten nun etwa heute ihren weil ihm menschen deutschland anderen rund ihn ende jedoch zeit".split()
    known = [(k, " ".join(rng.choices(words, k=120)), lang, "s", None) for k, (words, lang) in enumerate([(english, "en"), (german, "de")] * 30)]
    clean = [" ".join(rng.choices(words, k=n)) for words in (english, german) for n in (3, 5, 8)]
    foreign = ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."]
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=n)) for n in (100, 300, 1000, 5000)]
    rows = known + [(1000 + k, t, None, "s", None) for k, t in enumerate([*clean, *foreign, *noise])]
    got = {r[0] for r in corpus_pipeline.stage_langid(spark, make(rows), "").select("doc_id").collect()}
    assert got == {r[0] for r in known} | set(range(1000, 1000 + len(clean)))


def test_stages_keep_columns_and_meet_odd_tables(spark, make, stored):
    at = stored(ODD, [(1, None)])
    odd = make([(None, None, None, None, None), (1, None, "en", None, 0), (2, "words of a text", None, "s", None), (2, "words of a text", None, "s", None)])
    for docs in (odd, odd.limit(0), odd.drop("lang", "n_chars"), odd.withColumn("lang_pred", F.lit(1)).withColumn("lost", F.lit(2))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, at)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, at).columns[0] == "doc_id"
    assert [s for s, _ in corpus_pipeline.STAGES] == ["langid", "line_dedup", "near_dedup", "decontaminate", "pack"]
