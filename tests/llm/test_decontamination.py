"""Windows, Hamming blocks and exact similarity against brute force."""

from __future__ import annotations

import random

import numpy as np

from reelflow.llm import decontamination as dc
from tests.llm.conftest import words

ITEMS = "item_id bigint, text string"


def brute(text, items, similarity=0.8):
    found = {}
    hashes, n = dc.shingles(text or "")
    for item, size in enumerate(items.sizes):
        if size < dc.SHINGLE:
            all_words, own = dc.findwords((text or "").lower()), None
            hit = any(dc.shingles(" ".join(all_words[k:k + size]))[0][0] in items.bags[item] for k in range(n - size + 1))
            if hit:
                found[items.ids[item]] = 1.0
            continue
        width = size - dc.SHINGLE + 1
        if n >= size:
            best = max(dc.weighted_similarity(items.bags[item], hashes[k:k + width].tolist()) for k in range(n - size + 1))
            if best >= similarity:
                found[items.ids[item]] = best
    return found


def cases():
    rng = random.Random(12)
    items = [(k, " ".join(words(rng, rng.randint(12, 60)))) for k in range(30)]
    items += [(30, "yes indeed"), (31, "the same five words here"), (32, None), (33, ""), (34, items[2][1]), (None, "an item with no id of its own at all")]
    texts = []
    for _ in range(150):
        own = words(rng, rng.randint(0, 120))
        item = dc.findwords((rng.choice(items)[1] or "").lower())
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            if item:
                item[rng.randrange(len(item))] = "changed"
        at = rng.randint(0, len(own))
        texts.append(" ".join(own[:at] + item * rng.choice([0, 1, 1, 2]) + own[at:]).title())
    return items, texts


def test_found_equals_brute_force(spark, make_docs):
    items, texts = cases()
    tables = dc.Items(sorted(items, key=lambda r: (r[0] is not None, r[0] or 0)), 20)
    benchmark = spark.createDataFrame(items, ITEMS)
    for block_items in (10_000, 7):
        got: dict = {}
        for r in dc.contaminated(make_docs(list(enumerate(texts))), benchmark, block_items=block_items).collect():
            got.setdefault(r.doc_id, {})[r.item_id] = r.similarity
            assert r.distance <= 20
        expected = {k: f for k, t in enumerate(texts) if (f := brute(t, tables))}
        assert got == expected


def test_blocks_lose_no_fingerprint_in_the_radius():
    rng = np.random.default_rng(7)
    items, _ = cases()
    tables = dc.Items(items, 20)
    for item in range(0, len(tables.prints), 5):
        flips = [rng.choice(64, rng.integers(0, 30), replace=False) for _ in range(200)]
        prints = np.array([int(tables.prints[item]) ^ sum(1 << int(b) for b in f) for f in flips], np.uint64)
        assert (tables.candidates(prints, item) == np.array([len(f) <= 20 for f in flips])).all()


def test_clean_documents_stay(spark, make_docs, odd_docs, no_docs):
    items, texts = cases()
    benchmark = spark.createDataFrame(items, ITEMS)
    docs = make_docs(list(enumerate(texts)))
    bad = {r.doc_id for r in dc.contaminated(docs, benchmark).collect()}
    clean = dc.clean_documents(docs, benchmark, block_items=9)
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - bad and clean.columns == docs.columns
    none = spark.createDataFrame([], ITEMS)
    assert dc.contaminated(odd_docs, none).count() == 0 and dc.clean_documents(odd_docs, none).count() == 10
    assert dc.contaminated(no_docs, benchmark).count() == 0
    line = spark.createDataFrame([(1, "one line of words here another line of words there")], ITEMS)
    assert [r.doc_id for r in dc.contaminated(odd_docs, line).collect()] == [1, 1]
