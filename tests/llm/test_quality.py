"""Base rules, Viterbi decoding, the fit and its held-out accuracy."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import product

import numpy as np

from reelflow.llm import line_labels
from tests.conftest import SF01

WORD = re.compile("[^\x20\x09-\x0d]+")


def base(text):
    found = WORD.findall(text)
    windows = [tuple(found[k:k + 5]) for k in range(len(found) - 4)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    inside = {j for k, w in enumerate(windows) if w in many for j in range(k, k + 5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n, again = len(found), len(inside)
    return (n, sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), again, n < 10 or 100 * again > 20 * n)


def test_base_rules_equal_plain_counting():
    rng = random.Random(4)
    parts = ["a", "b", "word", "é", "😀", "#", "|x|", " ", " ", "\n", "\t", " ", "\x1c", "\r", "\x0b", "a b c d e ", "!!"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 80)))
        assert line_labels.judge(text, *line_labels.PRIOR, 0.5)[:6] == base(text), ascii(text)


def test_viterbi_finds_the_best_labelling():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 9):
        for _ in range(20):
            emit, stay = rng.normal(size=n), rng.normal(size=(2, 2))

            def total(labels):
                return sum(e for e, y in zip(emit, labels) if y == 0) + sum(stay[a, b] for a, b in zip(labels, labels[1:]))

            best = max(product((0, 1), repeat=n), key=total)
            assert (line_labels.viterbi(emit, stay) == (np.array(best) == 0)).all()


def test_fit_raises_the_likelihood_and_keeps_documents_apart(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    graded = {r.doc_id: r.quality for r in labels.collect()}
    held_out = {i for i in graded if i % 2}
    model = line_labels.train(docs, labels.where("doc_id % 2 = 0"))
    rows = line_labels.quality(docs, model).collect()
    assert len(rows) == docs.count()
    passed = [r for r in rows if r.doc_id in held_out and not r.base_failed]
    good = [r.kept for r in passed if graded[r.doc_id] == 1]
    bad = [r.kept for r in passed if graded[r.doc_id] == 0]
    assert np.mean(good) > 0.97 and (not bad or np.mean(bad) < 0.1)
    kept = {r.doc_id for r in line_labels.kept_documents(docs, model).collect()}
    assert kept == {r.doc_id for r in rows if r.kept}


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (9, None)], "doc_id bigint, quality int")
    model = line_labels.train(odd_docs, labels)
    assert model is line_labels.PRIOR                    # only one class is there
    rows = line_labels.quality(odd_docs, model).collect()
    assert len(rows) == 10
    assert all(r.n_words == 0 and r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, 4))
    assert line_labels.quality(no_docs, model).count() == 0
    assert line_labels.kept_documents(no_docs, model).columns == no_docs.columns
