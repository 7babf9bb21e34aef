"""The two bigram models against sums over plain dictionaries."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from reelflow.llm import lm_scoring


def brute(docs, good, share, back_off):
    split = {k: (t or "").lower().encode().split() for k, t in docs}
    counts = Counter(w for words in split.values() for w in words)
    own = {w for w, n in counts.items() if n * share >= sum(counts.values())}
    chains = {k: ["|", *(w if w in own else "?" for w in words), "|"] for k, words in split.items()}
    size = len(own) + 2
    models, others = {}, {}
    for name, ids in (("target", good), ("all", set(chains))):
        models[name] = Counter(p for k, c in chains.items() if k in ids for p in zip(c, c[1:]))
        others[name] = Counter(w for k, words in split.items() if k in ids for w in words if w not in own)
    n = {k: sum(m.values()) for k, m in models.items()}
    scale = {"target": 1.0, "all": n["target"] / n["all"] if n["target"] else 1.0}

    def loss(name):
        pairs = {p: c * scale[name] for p, c in models[name].items()}
        after, single = Counter(), Counter()
        for (v, w), c in pairs.items():
            after[v] += c
            single[w] += c
        total = sum(single.values())
        inside = sum(others[name].values()) * scale[name] + len(others["all"])

        def of(k):
            between = sum(-math.log((pairs.get((v, w), 0) + back_off * (single[w] + 1) / (total + size)) / (after[v] + back_off))
                          for v, w in zip(chains[k], chains[k][1:]))
            return between - sum(math.log((others[name][w] * scale[name] + 1) / inside) for w in split[k] if w not in own)

        return of

    target, background = loss("target"), loss("all")
    return {k: (len(c) - 1, target(k) / (len(c) - 1), background(k) / (len(c) - 1)) for k, c in chains.items()}


def test_scores_equal_brute_force_and_tell_target_from_rest(spark, make_docs):
    rng = random.Random(6)
    good, rest = ["sun", "sea", "sky", "is", "Blue"], ["buy", "now", "cheap", "is", "free"]
    docs = [(k, " ".join(rng.choices(good if k % 2 else rest, k=rng.randint(0, 30)))) for k in range(120)] + [(500, None), (501, "")]
    labels = spark.createDataFrame([(k, k % 2, int(k == 7)) for k in range(60)], "doc_id bigint, quality int, toxic int")
    target = {k for k in range(60) if k % 2 and k != 7}
    got = {r.doc_id: r for r in lm_scoring.score(make_docs(docs), labels, share=9).collect()}
    for k, (n, ours, theirs) in brute(docs, target, 9, 2.0).items():
        assert got[k].n_tokens == n
        assert (got[k].target_loss, got[k].background_loss) == (pytest.approx(ours), pytest.approx(theirs))
    unseen = [got[k].score for k in range(60, 120) if docs[k][1].count(" ") > 3]
    odd = [got[k].score for k in range(61, 120, 2) if docs[k][1].count(" ") > 3]
    assert max(odd) < min(s for s in unseen if s not in odd)


def test_odd_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (None, 1, 0), (5, None, None)], "doc_id bigint, quality int, toxic int")
    for which in (labels, none):
        rows = lm_scoring.score(odd_docs, which).collect()
        assert len(rows) == 10 and all(math.isfinite(r.score) for r in rows)
        assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert lm_scoring.score(no_docs, labels).count() == 0


def test_rare_words_move_the_score(spark, make_docs):
    """A word far from any class of its own tells a target's text from the rest."""
    rng = random.Random(7)
    common = ["a", "b", "c", "d"]
    docs = [(k, " ".join(rng.choices(common, k=200)) + f" {'gem' if k % 2 else 'lot'}{k % 40 // 2}") for k in range(200)]
    docs += [(900, "a b gem3"), (901, "a b lot3")]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(100)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.score for r in lm_scoring.score(make_docs(docs), labels, share=10).collect()}
    assert got[900] < got[901]
    expected = brute(docs, set(range(1, 100, 2)), 10, 2.0)
    assert all(got[k] == pytest.approx(ours - theirs) for k, (_, ours, theirs) in expected.items())
