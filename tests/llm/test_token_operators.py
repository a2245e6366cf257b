"""Tokens, coded ids, packing: exact round trips and bounds."""

from __future__ import annotations

import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starloom.llm import packing, queries, rans
from starloom.llm.common import public_tokenizer, scratch
from starloom.llm.tokens import ChunkTokenizer, chunk_hashes

from .conftest import by_id
from .test_text_operators import ODD

LIBRARY = Tokenizer.from_file(public_tokenizer())
HARD = "aAbBsStTrRvVlLdDmM''  \n\t\x0b\x0c\x00\x1c\x1f\x7f\x85\xa0éÉßÀ×÷ª½̱́Hh.,!%$#019　ΣσİıKﬁ日​\xad<|endoftext|>"


def ids_of(text, end):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, end]


@pytest.mark.parametrize("most", [400_000, 5])
def test_chunks_encode_as_whole_texts(most):
    rng = random.Random(1)
    texts = ["".join(rng.choices(HARD, k=rng.randrange(30))) for _ in range(4000)] + ["<|endoftext|> x", "don't We'LL 'S", *ODD]
    coder = ChunkTokenizer(end=2, most_chunks=most)
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        ids, sizes = coder.encode([None if t is None else t.encode() for t in part])
        want = [ids_of(t, 2) for t in part]
        assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == [len(w) for w in want]
    assert len(coder.encode([])[0]) == 0


def thue_morse(letters, n):
    word = letters
    while len(word) < n:
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


def test_chunks_of_one_hash_are_told_apart():
    """Polynomial hashes modulo 2**64 of the two complementary Thue-Morse words collide for every odd base."""
    pairs = [thue_morse(letters, n) for n in (1024, 2048, 4096) for letters in ("ab", "ba", "xy", "yx")]
    data = np.frombuffer("".join(pairs[:2]).encode(), np.uint8)
    assert len(set(chunk_hashes(data, np.array([0, 1024, 2048])).tolist())) == 1  # so this test tests something
    texts = [" ".join(pairs), *pairs, *pairs[::-1], f"{pairs[1]} word {pairs[0]} {pairs[1]}", "word " + "z" * 5000, "z" * 5000 + "."]
    for most in (400_000, 3):
        coder = ChunkTokenizer(end=2, most_chunks=most)
        for part in (texts, texts[::-1], texts[3:9]):
            ids, sizes = coder.encode([t.encode() for t in part])
            want = [ids_of(t, 2) for t in part]
            assert ids.tolist() == [x for w in want for x in w] and sizes.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_whole_table_encodes_as_by_the_library(sf):
    at = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    texts = pq.read_table(at, columns=["text"])["text"].to_pylist()
    ids, sizes = ChunkTokenizer(end=2).encode([None if t is None else t.encode() for t in texts])
    want = [ids_of(t, 2) for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


@given(st.lists(st.integers(0, 300), max_size=400), st.integers(1, 9), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_codes_round_trip(values, lanes, every):
    ids = np.array(values, np.uint32)
    table = rans.Table(rans.Table.scaled(np.bincount(ids, minlength=1), 12)) if len(ids) else rans.Table(np.array([4096]))
    coded = rans.encode(ids, table, lanes, every)
    assert rans.decode(*coded, len(ids), lanes, every, table, table.slots()).tolist() == values
    last = -(-(-(-len(ids) // lanes)) // every)
    parts = [rans.decode(*coded, len(ids), lanes, every, table, table.slots(), k, k + 1) for k in range(last)]
    assert [x for p in parts for x in p.tolist()] == values  # each checkpoint by itself


def test_frequencies_keep_every_id():
    counts = np.array([0, 1, 10**9, 0, 3])
    freq = rans.Table.scaled(counts, 12)
    assert freq.sum() == 4096 and freq.tolist()[0] == 0 and freq[1] >= 1
    with pytest.raises(ValueError, match="fit"):
        rans.Table.scaled(np.ones(5000), 12)


@given(st.lists(st.binary(max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_checksums_of_pieces_join(pieces):
    assert rans.crc_joined([(zlib.crc32(p), len(p)) for p in pieces]) == zlib.crc32(b"".join(pieces))


def test_files_of_ids(spark, stored, make):
    rng = random.Random(2)
    texts = [" ".join(f"word{rng.randrange(50)}" for _ in range(rng.randrange(200))) for _ in range(60)] + ODD
    got = by_id(queries.op2_rans_ids(spark, stored(texts)))
    start = 0
    for i, t in enumerate(texts):
        ids = ids_of(t, 2)
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_files_hold_ids_and_notice_damage(spark, make):
    path = scratch(spark, "rans-test")
    docs = make([(None, "first one", "", "", 0), (3, "a b c", "", "", 0), (3, "a", "", "", 0), (1, None, "", "", 0)])
    rans.write_ids(docs, path, block_ids=3, lanes=2, every=1, partitions=2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for most in (1 << 22, 3):
        rows = rans.read_ids(spark, path, with_ids=True, most_ids=most).orderBy("start").collect()
        assert [(r["doc_id"], r["ids"]) for r in rows] == [(None, ids_of("first one", 2)), (1, [2]), (3, ids_of("a", 2)), (3, ids_of("a b c", 2))]
        assert [r["ids_crc32"] for r in rows] == [zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    runs = rans.runs_of(spark.read.parquet(f"{path}/blocks")).collect()
    assert len(runs) > spark.read.parquet(f"{path}/blocks").count()
    table = rans.Table(rans.read_table(spark, path))
    with pytest.raises(ValueError, match="damaged"):
        rans.run_ids(runs[0].asDict() | {"crc": 1}, table, table.slots())
    with pytest.raises(ValueError, match="another table"):
        rans.run_ids(runs[0].asDict() | {"table_crc": 5}, table, table.slots())
    empty = scratch(spark, "rans-none")
    rans.write_ids(docs.limit(0), empty)
    assert rans.read_ids(spark, empty).count() == 0


def test_best_fit_is_gapless_and_tight():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 100, 500)
    bins, offsets, used = packing.best_fit(lengths, 100)
    for b in range(len(used)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == (np.cumsum(lengths[own]) - lengths[own]).tolist() and used[b] == lengths[own].sum() <= 100
    assert len(used) <= 1.03 * lengths.sum() / 100 + 1


def one_by_one(lengths, size):
    """Best-fit decreasing by its definition: used lengths of the bins."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        if n > max(rooms, default=0):
            rooms.append(size)
        k = min((r, i) for i, r in enumerate(rooms) if r >= n)[1]
        rooms[k] -= n
    return sorted(size - r for r in rooms)


@given(st.lists(st.integers(1, 40), max_size=120), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_best_fit_by_classes_is_that_of_single_items(lengths, parts):
    lengths = np.array(lengths, np.int64)
    assert sorted(packing.best_fit(lengths, 40)[2].tolist()) == one_by_one(lengths.tolist(), 40)
    part = np.arange(len(lengths)) % parts
    kinds, n = np.unique(np.stack([part, lengths]), axis=1, return_counts=True)
    bins, met = {}, set()
    for p, u, first, last, up_used, up_first, number, offset, is_open in packing.merged(kinds[0], kinds[1], n, 40, 4):
        assert is_open == (40 - up_used > 4)
        for k in range(last - first):
            met.add((p, u, first + k))
            bins.setdefault((number + k, up_used, up_first + k), []).append((offset, u))
    assert met == {(p, u, k) for p, u, m in zip(*kinds.tolist(), n.tolist()) for k in range(m)}
    assert len({b for b, _, _ in bins}) == len({(u, k) for _, u, k in bins}) == len(bins)
    for (_, used, _), own in bins.items():
        assert sum(u for _, u in own) == used and [o for o, _ in sorted(own)] == [sum(u for _, u in sorted(own)[:k]) for k in range(len(own))]
    assert sorted(u for _, u, _ in bins) == one_by_one(lengths.tolist(), 40)


def test_a_million_open_sequences_pack_to_the_bound():
    """Long ones that leave just the room that short ones need, met only in the merge."""
    rng = np.random.default_rng(5)
    long = rng.integers(1030, 2000, 1_000_000)
    used = np.concatenate([long, 2048 - long])
    parts = np.concatenate([np.arange(1_000_000) % 4, 4 + np.arange(1_000_000) % 4])
    key, n = np.unique(np.stack([parts, used]), axis=1, return_counts=True)
    rows = packing.merged(key[0], key[1], n, 2048, 4)
    assert sum(last - first for _, _, first, last, *_, offset, _ in rows if not offset) <= 1.01 * used.sum() / 2048
    assert sum(last - first for _, _, first, last, *_ in rows) == 2_000_000 and len(rows) < 60_000


@pytest.mark.parametrize("most", [500_000, 0])
def test_packing(spark, make, most):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(90)}" for _ in range(rng.choice([1, 5, 30, 200]))) for _ in range(150)] + ODD
    rows = [(i, t, "", "", 0) for i, t in enumerate(texts)] + [(0, texts[0], "", "", 0), (None, "x y", "", "", 0)]
    got = packing.pack(make(rows, "doc_id long, text string, bin string, size string, n_chars long").repartition(11), size=64, fan=2, most_broadcast=most).collect()
    by_sequence, total = {}, 0
    seen = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault((r["doc_id"], r["piece"]), []).append(r)
        total += r["length"]
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 64
    for i, t in enumerate(texts):
        ids = ids_of(t, 0)
        for k, at in enumerate(range(0, len(ids), 64)):
            r = seen[i, k][0]
            piece = np.array(ids[at : at + 64], "<u4")
            assert (r["start"], r["length"], r["ids_crc32"]) == (at, len(piece), zlib.crc32(piece.tobytes()))
    assert len(seen[0, 0]) == 2 and (None, 0) in seen
    assert len(by_sequence) <= -(-total // 64) * 1.05 + 1
    assert packing.pack(make(["a"]).limit(0)).count() == 0
