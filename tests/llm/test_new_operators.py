"""Packing, runs and hard negatives against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geostrata.llm import hard_negatives as N
from geostrata.llm import packing as K
from geostrata.llm import periodic as P
from geostrata.llm.entry import ORACLES, QUERIES
from geostrata.llm.token_counts import default_path


def plain_cost(places, penalties, length):
    """Least cost over all cuts: padding of all windows and penalties of all cuts."""
    best = {0: 0}
    for j, (p, c) in enumerate(zip(places, penalties)):
        best[p] = min(best[q] + length - (p - q) + c for q in best if q < p and p - q <= length and q in best)
    return best[places[-1]]


def test_cuts_cost_the_least():
    rng = random.Random(4)
    for _ in range(200):
        length = rng.choice([8, 20, 50])
        places = np.cumsum([rng.randint(1, length if rng.random() < 0.1 else max(1, length // 4)) for _ in range(rng.randint(1, 60))])
        penalties = np.array([rng.choice([0, 2, 8]) for _ in places])
        cuts = K.best_cuts(places, penalties, length)
        assert cuts[-1] == places[-1] and all(0 < b - a <= length for a, b in zip([0, *cuts], cuts))
        of = dict(zip(places.tolist(), penalties.tolist()))
        cost = sum(length - (b - a) for a, b in zip([0, *cuts], cuts)) + sum(of[c] for c in cuts)
        assert cost == plain_cost(places.tolist(), penalties.tolist(), length)


def library_ids(text):
    from tokenizers import Tokenizer

    return [*(Tokenizer.from_file(default_path()).encode(text, add_special_tokens=False).ids if text else []), 1]


def check_pieces(pieces, texts, length=2048):
    """Every document's ids lie in one piece each; sequences are filled without gaps. texts: of each row, by id."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= length
    for doc_id, rows in texts.items():
        got = sorted((bytes(p.ids), p.start, p.length, p.doc_tokens) for p in by_doc[doc_id])
        want = sorted(((i, len(i)) for i in map(library_ids, rows)), key=str)
        assert sum(g[2] for g in got) == sum(n for _, n in want)
        for i, n in {(tuple(i), n) for i, n in want}:
            mine = [g for g in got if g[3] == n and g[0] == np.array(i[g[1] : g[1] + g[2]], "<u4").tobytes()]
            assert sum(g[2] for g in mine) >= n * sum(w == (list(i), n) for w in want)
    assert set(by_doc) == set(texts)
    return by_sequence


def test_packing_of_odd_rows(spark, odd, empty):
    texts = defaultdict(list)
    for r in odd.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text)
    for df in (odd, odd.repartition(7)):
        check_pieces(K.pack(df).collect(), texts)
    small = K.pack(odd, length=64)
    by_sequence = check_pieces(small.collect(), texts, 64)
    stored = K.sequences(small, 64, 9).collect()
    assert len(stored) == len(by_sequence) and all(len(r.ids) == 256 and bytes(r.ids)[4 * r.n_tokens :] == np.full(64 - r.n_tokens, 9, "<u4").tobytes() for r in stored)
    assert K.pack(empty).count() == 0


def test_packing_pads_little_and_keeps_the_order(spark):
    df = QUERIES["op11_packing"](spark, "/root/testdata/sf0.001")
    rows = df.orderBy("sequence_id", "offset").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    used, sequences = sum(r.length for r in rows), len({r.sequence_id for r in rows})
    assert 1 - used / (2048 * sequences) < 0.03
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows[::7]:
        part = np.array(library_ids(texts[r.doc_id])[r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32


def test_stretches_join_without_a_seam():
    rng = np.random.default_rng(2)
    marks = K.sentence_marks(default_path())
    docs = [(i, rng.integers(2, 50000, rng.integers(1, 900)).astype("<u2")) for i in range(60)]
    whole, parts = K.Packer(marks, 100, 0), K.Packer(marks, 100, 0)
    out = []
    for i, ids in docs:
        whole.add(i, ids)
        parts.add(i, ids)
        if parts.held > 3000:
            out.append(parts.solve(False))
    out.append(parts.solve(True))
    rows = [r for o in out if o for r in zip(*o)]
    for i, ids in docs:
        own = sorted((r for r in rows if r[0] == i), key=lambda r: r[1])
        assert b"".join(r[6] for r in own) == ids.astype("<u4").tobytes() and [r[1] for r in own] == np.cumsum([0, *[r[2] for r in own]])[:-1].tolist() and {r[3] for r in own} == {len(ids)}
    assert sorted({r[4] for r in rows}) == list(range(rows[-1][4] + 1))
    assert rows[-1][4] + 1 <= len(set(whole.solve(True)[4])) + 2


def test_many_equal_rows_are_packed_by_many_tasks(spark):
    df = spark.range(30_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same words in every row").alias("text"))
    got = K.pack(df).agg(F.sum("length"), F.count_if(F.col("start") == 0), F.max("doc_tokens")).first()
    assert got[0] == 30_000 * got[2] and got[1] == 30_000


def brute_runs(ids):
    """Runs by looking at every lag and place."""
    found, n = [], len(ids)
    for q in range(1, n // 3 + 1):
        same = np.concatenate([[False], ids[: n - q] == ids[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            stretch = ids[a : b + q]
            if len(stretch) >= max(24, 3 * q) and not any((stretch[r:] == stretch[:-r]).all() for r in range(1, q)):
                found.append((a, b - a + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_and_counts_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        n, kinds = rng.randint(0, 160), rng.choice([1, 2, 3, 8, 50])
        words = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randint(0, 4)):
            if n > 30:
                a, p, k = rng.randrange(n), rng.randint(1, 12), rng.randint(10, n)
                for i in range(a + p, min(n, a + k)):
                    words[i] = words[i - p]
        ids = P.numbered([b"%d" % w for w in words])
        assert P.runs_of(ids) == brute_runs(ids)
        for frequent in (None, 0, 2, 1000):
            if n:
                assert P.lag_counts(ids, frequent)[1:].tolist() == [int((ids[: n - q] == ids[q:]).sum()) for q in range(1, n // 3 + 1)]


def test_long_texts_of_one_word_and_of_a_long_period():
    assert P.runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    noise = np.random.default_rng(3).integers(0, 40_000, 50_000)
    ids = np.concatenate([noise, noise, noise, noise[:7]])
    assert P.runs_of(P.numbered([b"%d" % x for x in ids])) == [(0, 150_007, 50_000)]


def test_the_query_of_runs_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    with_runs = 0
    for d in docs:
        words = (d.text or "").encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(P.numbered(words))
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs)]
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
        with_runs += bool(runs)
    assert with_runs > 10


def test_runs_of_odd_rows(spark, odd, empty):
    rows = P.periodic_runs(odd, plant=True).collect()
    assert len(rows) == odd.count() and all(r.runs == [] for r in rows if r.n_words < 24)
    plain = {r.doc_id: r for r in P.periodic_runs(odd).collect()}
    assert [(r.start, r.length, r.period) for r in plain[8].runs] == [(0, 30000, 1)] and plain[8].collapsed == "x"
    assert plain[1].collapsed == "" and P.periodic_runs(empty).count() == 0


def brute_negatives(rows, positives=5, negatives=3):
    """Rows of (vec_id, vector, label): all pairs, in whole numbers."""
    kept = []
    for v, e, label in rows:
        if label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        kept.append((v, [int(np.floor(256.0 * x)) for x in e], (label + 1) % 10 if v is not None and v % 7 == 0 else label))
    size = max((len(k[1]) for k in kept), default=0)
    m = np.array([k[1] + [0] * (size - len(k[1])) for k in kept], np.int64).reshape(len(kept), size)
    score = m @ m.T
    rank = lambda i, j: (-score[i, j], kept[j][0] is None, kept[j][0] or 0)
    out = []
    for i, (v, _, label) in enumerate(kept):
        if v is None or v % 50:
            continue
        same = sorted((j for j in range(len(kept)) if j != i and kept[j][2] == label), key=lambda j: rank(i, j))[:positives]
        for p in same:
            fit = sorted((j for j in range(len(kept)) if kept[j][2] != label and 50 * score[i, p] <= 100 * score[i, j] <= 95 * score[i, p]), key=lambda j: rank(i, j))[:negatives]
            out += [(v, kept[p][0], k, kept[j][0], int(score[i, p]), int(score[i, j])) for k, j in enumerate(fit, 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [N.BLOCK, 2])
def test_negatives_of_odd_rows(spark, block):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(6, 8)) / 2
    rows = [(i, (middle[i % 6] + rng.normal(size=8) / 5).astype("float32").tolist(), int(rng.integers(0, 4))) for i in range(0, 400)]
    rows += [(400, None, 1), (450, [1.0] * 8, None), (401, [None] + [0.5] * 7, 1), (402, [float("nan")] * 8, 1), (500, [float("inf")] * 8, 2), (None, [0.4] * 8, 1), (None, [0.4] * 8, 2), (550, [0.0] * 8, 1), (551, [0.25, -0.5], 3), (600, [], 2)]
    rows += [rows[3], rows[50], (700, rows[50][1], rows[50][2])]  # repeated rows, and an equal vector
    df = spark.createDataFrame([(*r, 1, "x", [0.5]) for r in rows], "vec_id long, embedding array<float>, label int, uid long, v string, far array<float>").repartition(3)
    want = brute_negatives(rows)
    assert found(N.hard_negatives(df, block=block)) == want and len(want) > 50
    assert found(N.hard_negatives(df.where("1 = 0"))) == []
    assert found(N.hard_negatives(df.where("vec_id = 50"))) == brute_negatives([r for r in rows if r[0] == 50])


def test_negatives_by_sql_over_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    rel = c.sql("SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (" + ORACLES["op13_hard_negatives"] + ")")
    assert found(QUERIES["op13_hard_negatives"](spark, sf)) == sorted(rel.fetchall(), key=str)


def test_pivots_pass_over_most_of_what_lies_apart():
    """Brackets hold the score, and on rows in far groups they leave out most pairs."""
    rng = np.random.default_rng(5)
    v = np.floor(256 * np.concatenate([c + rng.normal(size=(100, 16)) / 30 for c in rng.normal(size=(12, 16))]))
    squared = float((v**2).sum(axis=1).max())
    pivots = N.farthest_first(v, squared)
    own, far = N.distances(np.pad(v, ((0, 0), (0, 1))), pivots), N.distances(N.lengthened(v, squared), pivots)
    b = N.Brackets((v**2).sum(axis=1), own, squared)
    lower, upper = b.of_pairs(np.arange(len(v)), far)
    score = v @ v.T
    assert (lower <= score).all() and (score <= upper).all()
    fifth = np.sort(score, axis=1)[:, -6]
    assert (upper < fifth[:, None]).mean() > 0.5
    low, high = b.of_block(far[:100].min(axis=0), far[:100].max(axis=0))
    assert (low <= score[:, :100].min(axis=1)).all() and (high >= score[:, :100].max(axis=1)).all()
