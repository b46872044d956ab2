"""Joins, decontamination, sharding, mixing, training order and the pipeline against brute force."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geostrata.llm import decontaminate as D
from geostrata.llm import jaccard_join as J
from geostrata.llm import mixing as M
from geostrata.llm import sharding as S
from geostrata.llm import training_order as T
from geostrata.llm.common import CHUNK_BYTES, WordHash, shingle_hashes
from geostrata.llm.entry import ORACLES, QUERIES


def near_copies(seed=5):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(2000)]
    docs = []
    for _ in range(25):
        base = list(rng.choice(words, rng.integers(1, 100)))
        for _ in range(rng.integers(1, 22)):
            w = list(base)
            for _ in range(rng.integers(0, 3)):
                w[rng.integers(0, len(w))] = rng.choice(words)
            docs.append(" ".join(w[: max(1, int(len(w) * rng.uniform(0.75, 1)))] if rng.random() < 0.3 else w))
    return [*docs, "", "  ", None, "A b", "a B", *("a line that all of these share " + " ".join(rng.choice(words, 4)) for _ in range(40))]


def brute_components(texts):
    sets = []
    for t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = low.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sets, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [J.BLOCK_BYTES, 4000])
def test_components_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_BYTES", block)
    texts = near_copies()
    sets, want = brute_components(texts)
    df = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, "x y z")], "doc_id long, text string").repartition(4)
    rows = J.link_components(df).collect()
    assert len(rows) == len(texts) + 2
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]) for r in rows if r.doc_id is not None)
    assert [r.component_id for r in rows if r.doc_id is None] == [None]


def test_a_shingle_of_all_documents(spark):
    rng = np.random.default_rng(19)
    texts = ["every one begins with this line of eight words " + " ".join(f"w{j}" for j in rng.integers(0, 5000, 12)) for _ in range(400)]
    texts += [t + " and" for t in texts[:50]]
    sets, want = brute_components(texts)
    rows = J.link_components(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(want)) and len(set(want)) == 400


def test_shared_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (7, a), (None, b + " tail"), (None, c), (None, c), (9, ""), (9, ""), (None, None)]
    df = spark.createDataFrame([(*r, i, "L", 3) for i, r in enumerate(rows)], "doc_id long, text string, place int, label string, row int").repartition(3)
    got = sorted(((r.n_shingles, r.component_id) for r in J.link_components(df).collect()), key=str)
    assert got == sorted([(26, 5), (26, 5), (26, 5), (27, 5), (26, None), (26, None), (0, 9), (0, 9), (0, None)], key=str)
    kept = J.first_of_each(df)
    assert kept.columns == df.columns
    assert Counter(r.text for r in kept.collect()) == Counter([a, b, c, "", "", None])


def test_longer_prefixes_lose_nothing():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        df = np.sort(rng.integers(2, 500, rng.integers(0, n + 1)))
        matches, length = J.choose_matches(df, n)
        assert 1 <= matches <= J.required(n) and length == max(0, min(len(df), len(df) - J.required(n) + matches))


def test_join_odd_rows(spark, odd, empty):
    rows = J.link_components(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0, 1, 2}
    assert J.link_components(empty).count() == 0


def test_leaks_against_every_window(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words, rng.integers(2, 60)))) for i in range(30)]
    docs = []
    for i in range(120):
        w = list(rng.choice(words, rng.integers(0, 80)))
        if i % 2:
            copy = items[i % 30][1].split()
            for _ in range(i // 2 % 3):
                copy[rng.integers(0, len(copy))] = "changed"
            at = rng.integers(0, len(w) + 1)
            w[at:at] = copy
        docs.append((i, " ".join(w)))
    h = WordHash()
    want = set()
    for d, text in docs:
        w = h.of(D.words(text.encode()))
        for i, item in items:
            v = h.of(D.words(item.encode()))
            k = min(D.SHINGLE, len(v))
            a, s = shingle_hashes(v, D.SHINGLE), shingle_hashes(w, k) if len(w) >= k else np.empty(0, np.uint64)
            size = min(len(a), len(s))
            if size and any(D.similarity(s[p : p + size], a) >= 0.8 - 1e-12 for p in range(len(s) - size + 1)):
                want.add((d, i))
    b = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(df, b).collect()}
    assert len(want) > 20 and got == want
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(df, b, limit=300).collect()} == want  # items in several blocks


def test_the_index_finds_all_within_the_radius():
    rng = np.random.default_rng(4)
    ix = D.Index([(i, " ".join(f"w{j}" for j in rng.integers(0, 500, 20)).encode()) for i in range(60)])
    met = []
    for _ in range(300):
        p = ix.prints[rng.integers(0, 60)].copy()
        p[rng.choice(D.BITS, rng.integers(0, 70), replace=False)] ^= True
        assert sorted(ix.candidates(p, 0).tolist()) == [i for i, q in enumerate(ix.prints) if (p ^ q).sum() <= D.RADIUS]
        met.append(len(ix.met(rng.random(D.BITS) < 0.5, 0)) / 60)
    assert np.mean(met) < 0.05  # unrelated items that reach the count of bits


def test_radius_holds_similar_windows():
    rng = np.random.default_rng(12)
    near = total = 0
    for n in (9, 20, 46, 60, 100, 300):
        for _ in range(200):
            a = rng.integers(1, 1 << 62, n).astype(np.uint64)
            b = a.copy()
            b[rng.choice(n, int(np.floor(n / 9)), replace=False)] = rng.integers(1, 1 << 62, int(np.floor(n / 9))).astype(np.uint64)
            assert D.similarity(a, b) >= 0.8
            p, q = (D.fingerprints(x, np.zeros(1, np.int64), n)[0] for x in (a, b))
            near += (p ^ q).sum() <= D.RADIUS
            total += 1
    assert near / total > 0.99  # the least similar that count; about 0.999


def test_leaks_query_finds_verbatim_items(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet").collect(), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_benchmark_decontamination"](spark, sf).collect()}
    assert want and want <= got


def test_leaks_odd_rows(spark, odd, empty):
    b = spark.createDataFrame([(1, None), (2, ""), (3, "the lazy dog"), (3, "the lazy dog"), (None, "x")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(odd, b).collect()} == {(4, 3)}
    assert D.decontaminate(odd, b).count() == odd.count() - 2 and D.find_leaks(empty, b).count() == 0
    rows = spark.createDataFrame([(None, "the lazy dog"), (None, "a clean row"), (7, "the lazy dog"), (7, "another clean row"), (7, None)], "doc_id long, text string")
    assert sorted(str(r.text) for r in D.decontaminate(rows, b).collect()) == ["None", "a clean row", "another clean row"]
    item = " ".join(f"w{i}" for i in range(30))
    twice = spark.createDataFrame([(1, f"{item} between {item}")], "doc_id long, text string")
    got = D.find_leaks(twice, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.similarity, r.first_word) for r in got] == [(1.0, 0)]  # the first of equals
    assert D.find_leaks(odd, b.where("1 = 0")).count() == 0


def test_shards_are_even_and_gapless(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "hot copy of one text" if i % 3 == 0 else "x" * int(rng.integers(0, 300))) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = S.assign_shards(df, shards=40, keep=("text",)).collect()
    assert sorted(r.doc_id for r in got) == list(range(6000))
    total = sum(r["size"] for r in got)
    for s in range(40):
        own = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 40) <= 0.004 * total / 40 + 320
        assert [(r.text_crc32, r.doc_id) for r in own] == sorted((zlib.crc32((r.text or "").encode()), r.doc_id) for r in own)


def test_splitters_are_exact_counts(spark, monkeypatch):
    monkeypatch.setattr(S, "FETCH", 3)
    monkeypatch.setattr(S, "PROBES", 40)
    monkeypatch.setattr(S, "TASK_ROWS", 20)
    df = spark.createDataFrame([(i, f"t{i % 700}") for i in range(2000)], "doc_id long, text string").repartition(4)
    got = S.assign_shards(df, shards=7).collect()
    for s in range(7):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))


def test_shards_against_a_sorted_list(spark, monkeypatch):
    """Brute force: each shard's end is the row, of all in order, whose bytes come nearest to the target, within the tolerance."""
    monkeypatch.setattr(S, "TASK_ROWS", 50)
    monkeypatch.setattr(S, "PIECES", 30)
    rng = np.random.default_rng(18)
    rows = [(i, "one hot text" if i % 3 == 0 else "y" * int(rng.integers(0, 200))) for i in range(3000)]
    got = S.assign_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shards=7).collect()
    order = sorted((zlib.crc32(t.encode()), i, len(t) + 16) for i, t in rows)
    ends = np.cumsum([n for _, _, n in order])
    place = {i: k for k, (_, i, _) in enumerate(order)}
    mine = sorted(got, key=lambda r: place[r.doc_id])
    assert [r.shard for r in mine] == sorted(r.shard for r in mine)
    for s in range(7):
        slots = [r.slot for r in mine if r.shard == s]
        assert slots == list(range(len(slots)))
        last = max(k for k, r in enumerate(mine) if r.shard <= s)
        goal = ends[-1] * (s + 1) / 7
        assert abs(ends[last] - goal) <= max(np.abs(ends - goal).min(), S.TOLERANCE * ends[-1] / 7)


def test_shards_odd_rows(spark, odd, empty):
    got = S.assign_shards(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.shard < 40 for r in got) and {r["size"] for r in got if r.doc_id in (0, 1)} == {16}
    assert S.assign_shards(empty).count() == 0


def brute_targets(sizes):
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, out, free = 1.5 * sum(sizes.values()), {}, list(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 2 * sizes[s]]
        if not full:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free = [s for s in free if s not in out]
    return out


def test_targets_share_the_excess(spark):
    rng = np.random.default_rng(14)
    many = {f"host{i}.example": int(n) for i, n in enumerate(rng.lognormal(5, 2, 300))}
    for sizes in ({"a": 100, "b": 100, None: 1000}, {"a": 0}, {}, {"a": 0, "b": 5, "\U00010000": 7, "\uffff": 9}, many):
        df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, size long, n long").repartition(4)
        got = {r.source: r.target for r in M.shares(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[k] - v) <= 1e-9 * v for k, v in want.items())


def test_landing_keeps_inclusion_probabilities():
    rng = np.random.default_rng(15)
    for size, p in [(np.array([1] * 11 + [500]), np.full(12, 0.3)), (rng.integers(1, 900, 12), rng.random(12)), (np.array([7] * 9), np.full(9, 0.37)), (np.array([5, 5]), np.array([0.1, 0.2])), (np.array([3]), np.array([0.6]))]:
        samples, parts = M.samples_of(size, p)
        assert abs(parts.sum() - 1) < 1e-6 and np.allclose(parts @ samples, p, atol=1e-6)
        assert set(samples.sum(axis=1)) <= {int(np.floor(p.sum() + 1e-9)), int(np.ceil(p.sum() - 1e-9))}
    size, p = np.array([1] * 30 + [500, 90, 90, 41]), np.full(34, 0.3)
    mean = np.mean([M.land(size, p, np.random.default_rng(s)) for s in range(1000)], axis=0)
    assert np.abs(mean - 0.3).max() < 0.06  # ties, early or late, large and small alike


def test_flight_keeps_the_balance():
    rng = np.random.default_rng(8)
    size, p = rng.integers(1, 500, 400), np.full(400, 0.37)
    out = M.fly(size, p, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2 and abs(out.sum() - p.sum()) < 1e-6 and abs(out @ size - p @ size) < 1e-3
    mean = np.mean([M.land(size[:30], p[:30], np.random.default_rng(s)) for s in range(400)], axis=0)
    assert abs(mean.mean() - 0.37) < 0.02 and mean.min() > 0.1


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(9)
    rows = [(i, "w " * int(rng.integers(0, 60)), "hot" if i % 3 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = M.mix_sources(df.repartition(3), block=128).collect()
    two = M.mix_sources(df.repartition(7), block=128).collect()
    assert sorted((r.doc_id, r.taken) for r in one) == sorted((r.doc_id, r.taken) for r in two) and len(one) == 3000
    assert all(r.taken <= 2 * r["size"] and r.taken == r.times * r["size"] for r in one)
    taken = Counter()
    for r in one:
        taken[r.source, r.target] += r.taken
    assert all(abs(n - target) <= 0.01 * target + 5 for (_, target), n in taken.items())


def test_mix_small_heavy_source_beside_a_large_one(spark):
    rng = np.random.default_rng(11)
    heavy = rng.lognormal(0, 1.2, 200)
    sizes = np.maximum(1, heavy / heavy.sum() * 54_000).astype(int)
    rows = [(i, "w " * int(n), "z") for i, n in enumerate(sizes)] + [(1000 + i, "w " * int(n), "b") for i, n in enumerate(rng.integers(10, 31, 5000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for seed in range(4):
        got = M.mix_sources(df, seed=seed).collect()
        for s in "bz":
            assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= sizes.max() / 10, (seed, s)
    pair = [M.land(np.array([10, 1000, 30, 980, 500]), np.array([0.5, 0.5, 0.5, 0.5, 0.0]), np.random.default_rng(s)) for s in range(40)]
    assert {abs(float(x @ [10, 1000, 30, 980, 500]) - 1260) for x in pair} == {250.0}  # two of four: 1,010 nearest of all pairs is drawn


def test_mix_odd_rows(spark, odd, empty):
    got = M.mix_sources(odd).collect()
    assert len(got) == odd.count() and M.mix_sources(empty).count() == 0
    same = spark.createDataFrame([(None, "one text", "a")] * 2000 + [(7, "one text", "b")] * 1500, "doc_id long, text string, source string").repartition(3)
    taken = Counter()
    for r in M.mix_sources(same).collect():
        taken[r.source, round(r.target)] += r.taken
    assert all(abs(n - target) <= 2 for (_, target), n in taken.items()) and len(taken) == 2
    clash = odd.withColumn("times", F.lit(1)).withColumn("key_a", F.lit("x")).withColumn("copies", F.lit(None).cast("int")).withColumn("c0", F.lit(2))
    rows = M.take(clash)
    assert rows.columns == clash.columns and rows.count() == sum(r.times for r in M.mix_sources(clash).collect())
    assert M.take(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_bijection(n):
    a, b = T.feistel(np.arange(n), n), T.feistel(np.arange(n), n, key=1)
    assert sorted(a.tolist()) == list(range(n)) == sorted(b.tolist())
    if n > 100:
        assert (a != b).mean() > 0.9 and abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.2


def test_training_order_holds_every_token_once(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shards = T.materialise(docs.repartition(3), length=64, shard=100)
    rows = sorted(T.sequences(shards).collect())
    again = sorted(T.sequences(T.materialise(docs.repartition(5), length=64, shard=100)).collect())
    assert rows == again and [r.slot for r in rows] == list(range(len(rows)))
    files = sorted(shards.collect(), key=lambda r: r.shard)
    data = b"".join(open(r.file.removeprefix("file://"), "rb").read() for r in files)
    assert all(r.stride == 128 and r.first_slot == 100 * r.shard for r in files)
    ids = np.frombuffer(data, "<u2").reshape(-1, 64)
    got = {}
    for r in rows:
        got[r.doc_id, r.seq_no] = ids[r.slot][: r.n_tokens].tolist()
        assert zlib.crc32(ids[r.slot].tobytes()) == r["crc32"]
    e = T.encoder(T.default_path())
    for d in docs.collect():
        want = e.library.encode(d.text, add_special_tokens=False).ids
        assert sum((got.pop((d.doc_id, k)) for k in range(-(-len(want) // 64))), []) == want
    assert not got
    assert sorted(T.sequences(shards, first_slot=150).collect()) == [r for r in rows if r.slot >= 150]
    T.materialise(docs, uri=f"file://{tmp_path}/out", length=64, shard=100)
    written = sorted((tmp_path / "out").glob("*.bin"))
    assert b"".join(f.read_bytes() for f in written) == data and len(list((tmp_path / "out").iterdir())) == 2 * len(files)


def test_training_order_odd_rows(spark, odd, empty):
    rows = T.sequences(T.materialise(odd)).collect()
    assert {r.doc_id for r in rows} == {2, 3, 4, 5, 6, 7, 8, 9, None} and sum(r.doc_id == 4 for r in rows) == 2
    assert T.sequences(T.materialise(empty)).count() == 0


def test_training_order_takes_texts_in_small_batches(spark, monkeypatch):
    tokenise, session = T._tokenise, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    def watched(path, buckets):
        run, limit = tokenise(path, buckets), CHUNK_BYTES

        def small(batches):
            for batch in batches:
                if batch.nbytes > limit and batch.num_rows > 1:
                    raise ValueError(f"{batch.nbytes} bytes at once")
                yield batch

        return lambda batches: run(small(batches))

    monkeypatch.setattr(T, "_tokenise", watched)
    docs = spark.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.expr("repeat(' word', 2000)")).alias("text"))
    assert T.sequences(T.materialise(docs)).agg(F.countDistinct("doc_id")).first()[0] == 1000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == session


def test_steps_after_the_tokens_keep_no_encoder():
    ids, text = pa.array([1, 2]), pa.array(["one text", "another text"])
    blobs = [b for out in T._tokenise(T.default_path(), 1)(iter([pa.record_batch([ids, ids, text], names=["doc_id", "key", "text"])])) for b in out.column(1).to_pylist()]
    assert T.encoder.cache_info().currsize == 1
    assert T._sequence(8, 0)(pd.DataFrame({"bucket": [0] * len(blobs), "blob": blobs})).n.sum() == 2
    assert T.encoder.cache_info().currsize == 0


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    steps = [f for _, f in corpus_pipeline.STAGES]
    good = spark.createDataFrame(steps[0](spark, docs, sf).collect(), docs.schema)
    kept = {r.doc_id for r in good.collect()}
    assert np.mean([(i in kept) == q for i, q in labels.items()]) > 0.95
    texts = {r.doc_id: r.text for r in good.collect()}
    order = sorted(texts)
    _, root = brute_components([texts[i] for i in order])
    single = spark.createDataFrame(steps[1](spark, good, sf).collect(), docs.schema)
    assert sorted(r.doc_id for r in single.collect()) == [i for k, i in enumerate(order) if root[k] == k]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = spark.createDataFrame(steps[2](spark, single, sf).collect(), docs.schema)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect() if not any(i in r.text for i in items)}
    mix = spark.createDataFrame(steps[3](spark, clean, sf).collect(), docs.schema)
    size = {r.doc_id: len(r.text.split()) for r in clean.collect()}
    copies = Counter(r.doc_id for r in mix.collect())
    assert max(copies.values()) <= 2 and abs(sum(size[i] * n for i, n in copies.items()) - 1.5 * sum(size.values())) < 0.05 * sum(size.values())
    last = steps[4](spark, mix, sf).collect()
    assert Counter(r.doc_id for r in last if r.seq_no == 0) == copies


def test_pipeline_odd_rows(spark, odd, empty):
    for docs in (odd.withColumn("quality_score", F.lit("x")).withColumn("times", F.lit(None).cast("int")), empty):
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, "/root/testdata/sf0.001")
            n = out.count()
            assert n <= 2 * docs.count() if k < 4 else n >= docs.where("length(text) > 0").count()
            assert k == 4 or (out.columns == docs.columns and out.dtypes == docs.dtypes)


def test_join_against_all_pairs_of_a_table(spark):
    """Recall at sf0.01: every document against every other that shares a shingle with it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    _, want = linked_by_postings([r.text for r in rows])
    smallest = {}
    for r, root in zip(rows, want):
        smallest[root] = min(smallest.get(root, r.doc_id), r.doc_id)
    want = {r.doc_id: smallest[root] for r, root in zip(rows, want)}
    assert {r.doc_id: r.component_id for r in J.link_components(docs).collect()} == want


def test_join_against_sql(spark, sf, tmp_path):
    texts = spark.createDataFrame(list(enumerate(near_copies(9))), "doc_id long, text string")
    texts.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for folder, files in ((sf, "documents.parquet"), (str(tmp_path), "documents.parquet/*.parquet")):
        duck = duckdb.connect()
        duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/{files}')")
        want = duck.sql(ORACLES["op5_jaccard_join"])
        rows = QUERIES["op5_jaccard_join"](spark, folder).select(*want.columns).collect()
        assert sorted(map(tuple, rows)) == sorted(want.fetchall())


def linked_by_postings(texts):
    """As brute_components, for many texts: exact overlaps of all pairs that share any shingle."""
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in low]
    posts, root = {}, list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        both = Counter(j for t in s for j in posts.get(t, ()))
        for j, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
        for t in s:
            posts.setdefault(t, []).append(i)
    return sets, [find(i) for i in range(len(sets))]
