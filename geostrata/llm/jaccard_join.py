"""Similarity join of documents on word shingles by adaptive multi-match prefixes.

Two sets with Jaccard similarity t or more share at least t * n shingles, n being the
size of either. With shingles in one global order, rare first, two such sets share at
least l of the shingles in their l-prefixes, the first n - ceil(t * n) + l. Each document
lengthens its prefix to the l that its own posting lists make cheapest, and a pair is
verified only if it shares min(l, l') prefix shingles.

The work, each step over all documents:

1. Sets and their digests. Copies of a set are one class; one of its rows stands for it.
2. First sieve, in hash order with l-prefixes for l of an eighth of the set: a document
   of whose prefix too few shingles are in any other's prefix is linked with nothing.
3. Exact document frequencies among those that stay, and a second sieve: a document of
   whose shingles fewer than ceil(t * n) occur elsewhere is linked with nothing.
4. Prefixes in order of frequency; l by estimated cost.
5. Candidate clusters: classes that share a prefix shingle, directly or over others.
   Each shingle's classes are tied to the smallest of them, never in pairs.
6. In a block of a cluster a breadth-first search finds components: a document is compared
   with those not reached yet, so that a group of near copies costs few comparisons. Where
   a cluster has several blocks, the first of each component are searched together, in
   rounds until they fit a block or grow no fewer, and only shingles that still meet in different components bring documents of different
   blocks together.

Shingles go to ranges of the hash space as one entry for each chunk of documents, however
many of them have it, so that a shingle of all documents is no hot key. They are told
apart by 48 bits of their hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostrata.llm.common import LOWER, WordHash, chunks, drop_table, expand, mix, put_table, shingle_hashes, size_in_bytes, squeeze, table, text_bytes

#: Similarity in hundredths, words of a shingle.
PERCENT, WORDS = 80, 5
#: Longest multi-match prefix, and the cost of a verification in looked-up postings.
MOST_MATCHES, VERIFY = 6, 30
#: Bytes of shingles in a block of a cluster; one longer document is a block alone.
BLOCK_BYTES = 256 << 10
#: Bytes of input to a range of shingles, fewest and most ranges, and ranges to a task, which handles them one by one.
RANGE_BYTES, RANGES, IN_TASK = 2 << 20, (64, 1 << 20), 16
#: Owner of a shingle that several documents of a chunk have.
_MANY = np.iinfo(np.int64).min

_KEEP48 = np.uint64(16)


def required(n, percent: int = PERCENT):
    """Shingles that a set of n shares at least with any it links to."""
    return -(-percent * n // 100)


def sets_of(texts: list[bytes], hashed: WordHash) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    return [np.unique(shingle_hashes(hashed.of(t.translate(LOWER).split()), WORDS)) for t in texts]


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a, b = mix(s), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(a.sum(dtype=np.uint64).astype(np.int64)), int((b * np.uint64(3) ^ (b >> np.uint64(7))).sum(dtype=np.uint64).astype(np.int64))


def _by_range(tokens: np.ndarray, others: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """(range, blob) of ascending 48-bit tokens with another number for each; ranges part the token space evenly."""
    where = (tokens.astype(np.float64) * (ranges / 2**48)).astype(np.int64)
    edges = np.flatnonzero(np.diff(where)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(tokens)], strict=True):
        if b > a:
            yield int(where[a]), squeeze(tokens[a:b], others[a:b].view(np.uint64))


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def sieve_matches(n):
    """l of the first sieve: any l up to the required overlap is right; this one keeps few documents with prefixes of a third."""
    return np.maximum(1, n // 8)


def _blobs_by_bucket(ids: np.ndarray, others: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    where = _bucket(ids, buckets)
    order = np.argsort(where, kind="stable")
    where, columns = where[order], [c[order] for c in (ids, *others)]
    edges = np.flatnonzero(np.diff(where)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(where)], strict=True):
        if b > a:
            yield int(where[a]), squeeze(*(c[a:b] for c in columns))


_NAMES = ["doc_id", "row", "row_b", "n", "digest_a", "digest_b", "part", "blob"]


def _first_pass(ranges: int, percent: int):
    """Rows of documents (ids, n, digest), of ranges (prefixes in hash order) and, with part below 0, of buckets of documents (row, n and shingles known to be in others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for batch in chunks(batches, "text"):
            sets = sets_of(text_bytes(batch.column(3)), hashed)
            n = [len(s) for s in sets]
            marks = [digest(s) for s in sets]
            yield pa.record_batch([*batch.columns[:3], pa.array(n, pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=_NAMES)
            heads: dict[tuple[int, int], tuple[int, np.ndarray]] = {}  # copies in the chunk stand by the row that is smallest
            for row, s, mark in zip(batch.column(1).to_pylist(), sets, marks, strict=True):
                if len(s) and (mark not in heads or row < heads[mark][0]):
                    heads[mark] = (row, s)
            if not heads:
                continue
            rows = np.array([row for row, _ in heads.values()], np.int64)
            size = np.array([len(s) for _, s in heads.values()], np.int64)
            prefix = [s[: len(s) - required(len(s), percent) + int(sieve_matches(len(s)))] >> _KEEP48 for _, s in heads.values()]
            tokens, first, inverse, count = np.unique(np.concatenate(prefix), return_index=True, return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(rows)), [len(p) for p in prefix])
            shared = np.bincount(owner, count[inverse] > 1, len(rows)).astype(np.int64)
            out = list(_by_range(tokens, np.where(count > 1, _MANY, rows[owner[first]]), ranges))
            out += [(-1 - b, blob) for b, blob in _blobs_by_bucket(rows, [size, shared], ranges)]
            yield pa.record_batch([pa.nulls(len(out), pa.int64())] * 6 + [pa.array([r for r, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], names=_NAMES)

    return run


def _gather(blobs: pd.Series, k: int) -> list[np.ndarray]:
    parts = [expand(b, k) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) for i in range(k)] if parts else [np.empty(0, np.uint64)] * k


def _seen_elsewhere(buckets: int):
    """Of one range: blobs, by bucket of documents, of the documents with shingles that others have too, and how many; but those of which their own chunk knows it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tokens, owners = _gather(rows["blob"], 2)
        owners = owners.view(np.int64)
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
        once = new | np.concatenate([[True], owners[1:] != owners[:-1]])  # a repeated row is no other document
        group = np.cumsum(new) - 1
        seen = (np.bincount(group, once) > 1) | (np.bincount(group, owners == _MANY) > 0)
        found, count = np.unique(owners[once & seen[group] & (owners != _MANY)], return_counts=True)
        out = list(_blobs_by_bucket(found, [count.astype(np.int64)], buckets))
        return pd.DataFrame({"part": pd.Series([b for b, _ in out], dtype="int32"), "sizes": pd.Series([False] * len(out), dtype=bool), "blob": [b for _, b in out]})

    return run


def _sieve(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket of documents: those with enough prefix shingles that others have."""
    ids, n, shared = (a.view(np.int64) for a in _gather(rows["blob"][rows["sizes"]], 3))
    owner, count = (a.view(np.int64) for a in _gather(rows["blob"][~rows["sizes"]], 2))
    at, inverse = np.unique(ids, return_inverse=True)
    least = np.full(len(at), np.iinfo(np.int64).max)
    # a partner has required(n) shingles at least, and so an l no smaller than that size's
    np.minimum.at(least, inverse, sieve_matches(required(n)))
    total = np.bincount(np.searchsorted(at, owner), count, len(at)) + np.bincount(inverse, shared, len(at))
    return pd.DataFrame({"row": at[total >= least]})


def _second_pass(ranges: int):
    """Of each chunk of classes that stay: its shingles, by range, with how many of its classes have each; and, with part null, the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = WordHash()
        for batch in chunks(batches, "text"):
            sets: dict[int, np.ndarray] = {}
            for node, a, b, s in zip(*(batch.column(c).to_pylist() for c in ("node", "digest_a", "digest_b")), sets_of(text_bytes(batch.column("text")), hashed), strict=True):
                if digest(s) == (a, b):  # rows may share what names them, but not this
                    sets[node] = np.unique(s >> _KEEP48)
            if not sets:
                continue
            chunk = uuid.uuid4().int >> 66
            flat = np.concatenate(list(sets.values()))
            tokens, count = np.unique(flat, return_counts=True)
            rows = list(_by_range(tokens, count.astype(np.int64), ranges))
            sizes = np.array([len(s) for s in sets.values()], np.int64)
            rows.append((None, squeeze(np.repeat(np.fromiter(sets, np.int64, len(sets)), sizes), flat)))
            yield pa.record_batch([pa.array([r for r, _ in rows], pa.int32()), pa.array([chunk] * len(rows), pa.int64()), pa.array([b for _, b in rows], pa.binary())], names=["part", "chunk", "blob"])

    return run


def _frequencies(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one range: for each chunk, those of its shingles that two classes or more have, with their frequency."""
    blobs = [expand(b, 2) for b in rows["blob"]]
    tokens, inverse = np.unique(np.concatenate([t for t, _ in blobs]), return_inverse=True)
    df = np.bincount(inverse, np.concatenate([c for _, c in blobs]).view(np.int64)).astype(np.int64)
    out, at = [], 0
    for chunk, (t, _) in zip(rows["chunk"], blobs, strict=True):
        mine = df[inverse[at : at + len(t)]]
        at += len(t)
        if (mine > 1).any():
            out.append((chunk, False, squeeze(t[mine > 1], mine[mine > 1].view(np.uint64))))
    return pd.DataFrame(out, columns=["chunk", "sets", "blob"]).astype({"chunk": "int64", "sets": bool})


def choose_matches(df: np.ndarray, n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(l, tokens of the l-prefix that occur elsewhere) of least estimated cost; df: ascending frequencies of those tokens.

    Cost: postings that the prefix looks up, and verifications, for which l postings must meet.
    """
    single, need = n - len(df), required(n, percent)
    total = np.concatenate([[0], np.cumsum(df - 1)])
    best = None
    for matches in range(1, min(MOST_MATCHES, need) + 1):
        length = max(0, min(len(df), n - need + matches - single))
        cost = float(total[length]) * (1 + VERIFY / matches)
        if best is None or cost < best[0]:
            best = (cost, matches, length)
    return (best[1], best[2]) if best else (1, 0)


def _prefixes(percent: int):
    """Of one chunk: each class's shingles that others have, in global order, with l and the length of the prefix."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        owner, tokens = _gather(rows["blob"][rows["sets"]], 2)
        known, times = _gather(rows["blob"][~rows["sets"]], 2)
        order = np.argsort(known, kind="stable")
        known, times = np.append(known[order], np.uint64(np.iinfo(np.uint64).max)), np.append(times[order], np.uint64(0)).view(np.int64)
        owner = owner.view(np.int64)
        nodes, size = np.unique(owner, return_counts=True)
        place = np.searchsorted(known, tokens)
        df = np.where(known[place] == tokens, times[place], 1)
        tokens, owner, df = tokens[df > 1], owner[df > 1], df[df > 1]
        order = np.lexsort((tokens, df, owner))
        tokens, owner, df = tokens[order], owner[order], df[order]
        first = np.searchsorted(owner, nodes)
        out = []
        for node, n, a, b in zip(nodes.tolist(), size.tolist(), first.tolist(), [*first.tolist()[1:], len(owner)], strict=True):
            if b == a or b - a < required(n, percent):
                continue
            matches, length = choose_matches(df[a:b], n, percent)
            if length >= matches:
                out.append((node, n, matches, length, 8 * (b - a), tokens[a:b].tobytes()))
        return pd.DataFrame(out, columns=["node", "n", "matches", "length", "bytes", "tokens"]).astype({"node": "int64", "n": "int64", "matches": "int32", "length": "int32", "bytes": "int64"})

    return run


def components(ids: np.ndarray, n: np.ndarray, matches: np.ndarray, length: np.ndarray, tokens: list[np.ndarray], known: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """Smallest id that each document reaches by links. known: labels of documents that are linked already."""
    order = np.argsort(ids, kind="stable")
    ids, n, matches, length = ids[order], n[order], matches[order].astype(np.int64), length[order].astype(np.int64)
    tokens = [tokens[i] for i in order.tolist()]
    m = len(ids)
    sizes = np.array([len(t) for t in tokens], np.int64)
    first = np.cumsum(sizes) - sizes
    values, flat = np.unique(np.concatenate(tokens), return_inverse=True)
    in_prefix = (np.arange(len(flat)) - np.repeat(first, sizes)) < np.repeat(length, sizes)
    doc_of, tok_of = np.repeat(np.arange(m), sizes)[in_prefix], flat[in_prefix]
    groups: dict[int, list[int]] = {}
    if known is not None:
        for i, k in enumerate(known[order].tolist()):
            groups.setdefault(k, []).append(i)
    label = np.full(m, -1, np.int64)
    mark = np.zeros(len(values), bool)

    def index(open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = open_[doc_of]
        d, t = doc_of[keep], tok_of[keep]
        o = np.argsort(t, kind="stable")
        return d[o], np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(values)))])

    open_ = np.ones(m, bool)
    posts, ends = index(open_)
    indexed = left = m
    for seed in range(m):
        if not open_[seed]:
            continue
        queue = [seed]
        open_[seed] = False
        left -= 1
        label[seed] = ids[seed]
        while queue:
            x = queue.pop()
            if known is not None:
                for y in groups.pop(int(known[order[x]]), ()):
                    if open_[y]:
                        open_[y] = False
                        left -= 1
                        label[y] = ids[seed]
                        queue.append(y)
            if not left:
                continue
            if left * 2 < indexed:
                posts, ends = index(open_)
                indexed = left
            own = flat[first[x] : first[x] + sizes[x]]
            near = [posts[ends[t] : ends[t + 1]] for t in own[: length[x]].tolist()]
            cand = np.concatenate(near) if near else np.empty(0, np.int64)
            cand = cand[open_[cand]]
            if not len(cand):
                continue
            cand, met = np.unique(cand, return_counts=True)
            big, small = np.maximum(n[cand], n[x]), np.minimum(n[cand], n[x])
            cand = cand[(met >= np.minimum(matches[cand], matches[x])) & (small * 100 >= big * percent)]
            if not len(cand):
                continue
            mark[own] = True
            lens = sizes[cand]
            at = np.arange(int(lens.sum())) + np.repeat(first[cand] - (np.cumsum(lens) - lens), lens)
            shared = np.add.reduceat(mark[flat[at]].astype(np.int64), np.cumsum(lens) - lens)
            mark[own] = False
            for y in cand[100 * shared >= percent * (n[x] + n[cand] - shared)].tolist():
                open_[y] = False
                left -= 1
                label[y] = ids[seed]
                queue.append(y)
    out = np.empty(m, np.int64)
    out[order] = label
    return out


def _search(percent: int, with_known: bool = False):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        got = components(rows["node"].to_numpy(), rows["n"].to_numpy(), rows["matches"].to_numpy(), rows["length"].to_numpy(), [np.frombuffer(t, np.uint64) for t in rows["tokens"]], rows["known"].to_numpy() if with_known else None, percent)
        return pd.DataFrame({"node": rows["node"], "label": got})

    return run


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that is never broadcast: a table of ids that is small in its files is many times larger in the driver, and grows with the input."""
    return left.join(right.hint("merge"), on, how)


def clusters(edges: DataFrame, name: str = "cluster") -> DataFrame:
    """(doc_id, label): smallest id that each node of (a, b) edges reaches. Each round ties nodes to the smallest
    neighbour of their neighbours and is written out; the rounds are about the logarithm of the longest path."""
    both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    state = put_table(both, f"{name}-edges")
    while True:
        # large star: every larger neighbour of a node is tied to the node's smallest one
        sides = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = _met(sides.where("b > a"), low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours are tied to the smallest of them
        large = put_table(large, f"{name}-large")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = _met(large, low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        small = put_table(small, f"{name}-small")
        new = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        old = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        state = small
        if tuple(new) == tuple(old):
            break
    return state.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _blocks(rows: DataFrame, key: str, name: str, seed: int = 42) -> DataFrame:
    """``rows`` with the number of blocks of their ``key``, by its bytes, and each one's block.

    Only keys of several blocks are broadcast, fewer than two for each ``BLOCK_BYTES`` of shingles; a large key stays spread.
    """
    counts = rows.groupBy(key).agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).cast("int").alias("several")).where("several > 1")
    several = rows.join(F.broadcast(counts), key, "left").withColumn("blocks", F.coalesce("several", F.lit(1))).drop("several")
    return put_table(several.withColumn("block", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")).cast("int")).drop("bytes"), name)


def _search_clusters(prefixes: DataFrame, posts: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """(node, label): components inside candidate clusters (``near``: node, cluster)."""
    members = prefixes.select("node", "n", "matches", "length", "tokens")
    dealt = _blocks(_met(near, prefixes.select("node", "bytes").distinct(), "node"), "cluster", "join-dealt")
    within = put_table(_met(members, dealt, "node").groupBy("cluster", "block").applyInPandas(_search(percent), "node long, label long").distinct(), "join-within")
    several = dealt.where("blocks > 1").select("node", "cluster")
    if not several.limit(1).count():
        return within
    # the first of each component, together: near copies in different blocks meet here
    members = put_table(_met(prefixes.select(*members.columns, "bytes"), several, "node", "left_semi"), "join-several")
    bytes_of, members = members.select("node", "bytes").distinct(), members.drop("bytes")
    known = put_table(_met(within, several, "node").select("node", "cluster", F.col("label").alias("known")), "join-known")
    heads, fewer, rounds = known.where("node = known").select("node", "cluster"), None, 0
    while True:
        rounds += 1
        leaders = _blocks(_met(heads, bytes_of, "node"), "cluster", "join-leaders", rounds)
        merged = put_table(_met(members, leaders, "node").groupBy("cluster", "block").applyInPandas(_search(percent), "node long, label long").distinct(), "join-merged")
        known = put_table(_met(known, merged.select(F.col("node").alias("known"), "label"), "known").select("node", "cluster", F.col("label").alias("known")), "join-known")
        before, fewer = fewer, merged.where("node = label").count()
        if fewer == before or not leaders.where("blocks > 1").limit(1).count():
            break
        heads = known.where("node = known").select("node", "cluster")
    # a link between components needs a shingle that meets in both
    met = _met(posts, known.select("node", "known"), "node")
    open_ = met.groupBy("token").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low <> high").select("token")
    active = put_table(_met(met, open_, "token").select("node").distinct(), "join-active")
    pairs = _blocks(_met(_met(known, active, "node"), bytes_of, "node"), "cluster", "join-open")
    pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block or blocks = 1")
    pairs = pairs.select("node", "cluster", "known", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    linked = _met(members, pairs, "node").groupBy("cluster", "low", "high").applyInPandas(_search(percent, True), "node long, label long")
    edges = linked.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(known.select(F.col("node").alias("a"), F.col("known").alias("b")))
    joined = clusters(edges, "join-across")
    single = _met(within, several, "node", "left_anti")
    return single.unionByName(_met(several.select("node"), joined, "node", "left").select("node", F.coalesce("label", "node").alias("label")))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of id and text, never null, and text."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), *_keys(doc_id, text), text.alias("text"))


def _keys(doc_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(doc_id, text).alias("row"), F.xxhash64(F.lit("b"), doc_id, text).alias("row_b")]


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, row, row_b, n, label (of the component; null without shingles) and component (its smallest doc_id) of every row."""
    texts = _keyed(docs)
    size = size_in_bytes(docs)
    ranges = min(RANGES[1], max(RANGES[0], size // RANGE_BYTES))
    tasks = max(RANGES[0] // IN_TASK, ranges // IN_TASK)
    first = put_table(texts.mapInArrow(_first_pass(ranges, percent), "doc_id long, row long, row_b long, n long, digest_a long, digest_b long, part int, blob binary"), "join-first")
    rows = put_table(first.where("part is null").drop("part", "blob"), "join-rows")
    key = ["n", "digest_a", "digest_b"]
    seen = first.where("part >= 0").select("part", "blob").repartition(tasks, "part").groupBy("part").applyInPandas(_seen_elsewhere(ranges), "part int, sizes boolean, blob binary")
    heads = first.where("part < 0").select((-1 - F.col("part")).alias("part"), F.lit(True).alias("sizes"), "blob")
    stays = seen.unionByName(heads).repartition(tasks, "part").groupBy("part").applyInPandas(_sieve, "row long")
    # one of its rows stands for a class, and a number of its own
    classes = rows.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min(F.struct("row", "row_b")).alias("r"))
    classes = put_table(classes.select(*key, "rep", "r.row", "r.row_b", F.monotonically_increasing_id().alias("node")), "join-classes")
    picked = put_table(_met(classes, stays.distinct(), "row", "left_semi").select("row", "row_b", "digest_a", "digest_b", "node"), "join-picked")
    drop_table(first)
    second = put_table(_met(texts.drop("doc_id"), picked, ["row", "row_b"]).select("node", "digest_a", "digest_b", "text").mapInArrow(_second_pass(ranges), "part int, chunk long, blob binary"), "join-second")
    frequent = second.where("part is not null").repartition(tasks, "part").groupBy("part").applyInPandas(_frequencies, "chunk long, sets boolean, blob binary")
    sets = second.where("part is null").select("chunk", F.lit(True).alias("sets"), "blob")
    prefixes = put_table(frequent.unionByName(sets).repartition(tasks, "chunk").groupBy("chunk").applyInPandas(_prefixes(percent), "node long, n long, matches int, length int, bytes long, tokens binary"), "join-prefixes")
    drop_table(second)

    def posting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens = [np.frombuffer(t, np.int64)[:k] for t, k in zip(batch.column(2).to_pylist(), length.tolist(), strict=True)]
            yield pa.record_batch([pa.array(np.concatenate([np.empty(0, np.int64), *tokens])), pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), length))], names=["token", "node"])

    posts = prefixes.select("node", "length", "tokens").mapInArrow(posting, "token long, node long")
    center = posts.groupBy("token").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b <> top").select("token", "b")
    edges = _met(posts, center, "token").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    near = put_table(clusters(edges, "join").withColumnRenamed("label", "cluster"), "join-near")
    found = put_table(_search_clusters(prefixes, posts, near, percent), "join-components")
    named = _met(classes, found, "node", "left").select(*key, "rep", F.coalesce("label", "node").alias("label"))
    ids = named.groupBy("label").agg(F.min("rep").alias("component"))
    return _met(rows, _met(named, ids, "label").drop("rep"), key, "left").drop("digest_a", "digest_b")


def link_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Null and blank texts have no shingles and are components of their own. A row without id links like any other; its
    component_id is the smallest id that it reaches, null if there is none. Copies, and repeated rows, share the component
    of their class; rows that share an id but not a text are compared each by its own. Other columns, whatever their names,
    don't matter. An empty table gives no rows.
    """
    return _labelled(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stand for their components: that with the smallest id, those without id last.

    Rows without shingles are linked with nothing and all stay. Of repeated rows one stays.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name of the input clashes with those below
    doc_id, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    labelled = put_table(_labelled(docs, percent).select("doc_id", "row", "row_b", "label"), "join-labelled")
    best = labelled.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "row_b")).alias("r"))
    stays = put_table(best.select("r.row", "r.row_b"), "join-stays")
    blank = ~F.coalesce(text.cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keys = dict(zip(("row", "row_b"), _keys(doc_id.cast("long"), text.cast("string")), strict=True))
    # copies are dropped before the exchange; what is left meets the rows that stay one to one
    once = plain.where(~blank).withColumns(keys).dropDuplicates(["row", "row_b"]).join(stays.hint("merge"), ["row", "row_b"], "left_semi").drop("row", "row_b")
    return once.unionByName(plain.where(blank)).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


#: The same for DuckDB: every pair of different sets that shares a shingle, then whatever links reach.
ORACLE_SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN words IS NULL OR len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))) END AS shingles FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS id, len(shingles) AS n, shingles FROM s GROUP BY shingles),
e AS MATERIALIZED (SELECT id, n, unnest(shingles) AS sh FROM c),
links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.sh = b.sh AND a.id < b.id AND 5 * b.n >= 4 * a.n AND 5 * a.n >= 4 * b.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, root) AS (SELECT id, id FROM c UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.id WHERE r.root < l.b),
component AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, CASE WHEN len(s.shingles) = 0 THEN s.doc_id ELSE k.root END AS component_id
FROM s JOIN c ON c.shingles = s.shingles JOIN component k ON k.id = c.id"""


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents: nulls, empty and long texts, ties, repeats and empty tables as in ``link_components``."""
    return link_components(table(spark, sf_dir, "documents"))
