"""Vector and lexical search against brute force; periodic runs against their definition."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reelflow.llm import periodic_runs, queries, ranked_search, vector_topk
from tests.conftest import SF001
from tests.llm.conftest import words

VECTORS = "vec_id bigint, embedding array<float>, id int, vector int, asks int, block int, col int, part int, top int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, *([0] * 7)) for i, v in rows], VECTORS).repartition(3)


def plain_top(rows, k, is_query):
    usable = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in usable:
        if is_query(i):
            asked[i] = max(asked.get(i, v), v)
    found = {}
    for q, v in asked.items():
        scored = [(max(-2 ** 63 + 1, min(2 ** 63 - 1, sum(a * b for a, b in zip(v, c)))), i) for i, c in usable if i != q]
        found[q] = [(i, s) for s, i in sorted(scored, key=lambda e: (-e[0], e[1]))[:k]]
    return {q: v for q, v in found.items() if v}


def got_top(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    return found


def test_vectors_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(12)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]                                    # one common vector, equal scores
    rows += [(i, [rng.uniform(-1, 1) for _ in range(rng.randint(0, 20))]) for i in range(2000, 2040)]
    rows += [(rng.choice([10, 11, 20]), rows[3][1]) for _ in range(9)]                      # repeated ids
    rows += [(5000, None), (5010, []), (5020, [None] * 12), (5030, [float("nan")] * 12), (5040, [float("-inf")] * 12), (None, rows[1][1])]
    table = vectors_of(spark, rows)
    expected = plain_top(rows, 5, lambda i: i % 10 == 0)
    for block, shard in ((4096, 4096), (16, 8)):                                            # one tile, and many with several merge levels
        assert got_top(vector_topk.top_k(table, table.vec_id % 10 == 0, block_rows=block, shard_rows=shard)) == expected


def test_vectors_of_every_size_are_exact(spark):
    rng = random.Random(6)
    for size in (1e3, 1e9, 1e30):                                                           # single, double and Python's integers
        rows = [(i, [rng.uniform(-size, size) for _ in range(6)]) for i in range(80)]
        table = vectors_of(spark, rows)
        assert got_top(vector_topk.top_k(table, table.vec_id % 10 == 0, k=3)) == plain_top(rows, 3, lambda i: i % 10 == 0)
    none = vectors_of(spark, [])
    assert vector_topk.top_k(none, none.vec_id % 10 == 0).count() == 0
    one = vectors_of(spark, [(0, [1.0])])
    assert vector_topk.top_k(one, one.vec_id % 10 == 0).count() == 0


def plain_ranking(docs, items, k):
    def terms(text):
        return re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    found = {}
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * bag[t] // (1000 * bag[t] + 12 * m))
                        for t in terms(text) if bag[t])
            if score > 0 and i is not None:
                scored.append((-score, i))
        if scored and item is not None:
            found[item] = [(i, -s) for s, i in sorted(scored)[:k]]
    return found


def got_ranking(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r.item_id, r["rank"])):
        found.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(found[r.item_id])
    return found


@pytest.fixture(scope="module")
def collection():
    rng = random.Random(8)
    common, rare = words(rng, 12), words(rng, 400)
    docs = [(i, " ".join(rng.choice(common) if rng.random() < .6 else rng.choice(rare) for _ in range(rng.randint(1, 60)))) for i in range(700)]
    docs += [(900 + i, docs[5][1]) for i in range(60)]                                      # equal scores
    docs += [(3, docs[9][1]), (None, docs[5][1]), (2000, None), (2001, ""), (2002, "... !!"), (2003, "É é Ünï-中文 x_y É"), (2004, "x " * 30_000)]
    items = [(i, " ".join(rng.choice(common + rare[:80]) for _ in range(rng.randint(1, 25)))) for i in range(40)]
    items += [(50, docs[5][1].upper()), (51, None), (52, "!!"), (53, "É X"), (None, "x"), (54, common[0])]
    return docs, items


def test_ranking_equals_brute_force(spark, make_docs, collection):
    docs, items = collection
    table = make_docs(docs)
    asked = spark.createDataFrame([(i, t, 0, 0) for i, t in items], "item_id bigint, text string, doc_id int, n int")
    expected = plain_ranking(docs, items, 20)
    for shard, block in ((16_384, 500_000), (50, 100)):
        assert got_ranking(ranked_search.rank_documents(table, asked, shard_docs=shard, block_terms=block)) == expected


def test_ranking_of_odd_tables(spark, odd_docs, no_docs):
    asked = spark.createDataFrame([(1, "words of the long text"), (2, "中文 é")], "item_id bigint, text string")
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got_ranking(ranked_search.rank_documents(odd_docs, asked)) == plain_ranking(docs, [(r.item_id, r.text) for r in asked.collect()], 20)
    assert ranked_search.rank_documents(no_docs, asked).count() == 0
    assert ranked_search.rank_documents(odd_docs, asked.limit(0)).count() == 0


def test_accumulators_are_limited(collection):
    docs, items = collection
    bags = [(i, Counter(ranked_search.terms((t or "").encode()))) for i, t in docs if i is not None]
    bags = [(i, b) for i, b in bags if b]
    numbers = {t: n for n, t in enumerate(sorted({t for _, b in bags for t in b}))}
    df = Counter(t for _, b in bags for t in b)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in bags], pa.int64()), pa.array([sum(b.values()) for _, b in bags], pa.int64()),
         pa.array([[numbers[t] for t in b] for _, b in bags], pa.list_(pa.int32())), pa.array([list(b.values()) for _, b in bags], pa.list_(pa.int64()))],
        names=["doc_id", "n", "terms", "counts"])
    weights = np.array([math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) for t in sorted(numbers)], np.int64)
    shard = ranked_search.Shard([batch], weights, len(bags), sum(sum(b.values()) for _, b in bags))
    item = sorted({t for t in ranked_search.terms(docs[5][1].encode())}, key=lambda t: (df[t], t))
    scores, ids = shard.search(np.array([numbers[t] for t in item]), np.ones(len(item), np.int64), 20, 0)
    touched = sum(any(b[t] for t in item) for _, b in bags)
    assert len(scores) < touched                                                            # most documents never got an accumulator
    assert scores.max() == max(s for i, s in zip(ids, scores) if i == 5)


def plain_runs(w, times, least):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def test_runs_equal_their_definition():
    rng = random.Random(3)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 5)):
            letters = rng.choice(["a", "ab", "abc", "abcdefghij"])
            w = rng.choices(letters, k=rng.randint(0, 60))
            for _ in range(rng.randint(0, 4)):
                w += (rng.choices(letters, k=rng.randint(1, 6)) * 9)[:rng.randint(2, 50)] + rng.choices(letters, k=rng.randint(0, 9))
            docs.append([x.encode() for x in w])
        for times, least in ((4, 6), (3, 3), (3, 9)):
            assert periodic_runs.runs_of_documents(docs, times, least) == [plain_runs(d, times, least) for d in docs]


def test_long_runs_stay_near_linear():
    one = [b"a"] * 60_000
    assert periodic_runs.runs_of_documents([one]) == [[(0, 60_000, 1)]]
    line = [w for k in range(3000) for w in [b"x%d" % k, *(b"p%d" % j for j in range(20))]]    # a passage after 3,000 unlike words
    assert periodic_runs.runs_of_documents([line]) == [[]]


def contract_runs(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w, 4, 6)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def rows_by(frame):
    return sorted((tuple(r[c] for c in NAMES) for r in frame.collect()), key=repr)


def test_runs_query_equals_its_contract(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = rows_by(queries.op11_periodic_runs(spark, SF001))
    assert got == sorted((contract_runs(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert sum(r[1] for r in got) > 5


def test_runs_of_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in periodic_runs.find_runs(odd_docs).collect()]
    expected = [(r.doc_id, len((r.text or "").encode().split()), plain_runs((r.text or "").encode().split()[:2000], 4, 6)) for r in odd_docs.collect()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
    assert periodic_runs.find_runs(no_docs).count() == 0
    tails = queries.repeated_tails(odd_docs).collect()
    assert len(tails) == odd_docs.count()
