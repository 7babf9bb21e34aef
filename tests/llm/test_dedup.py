"""Components, document and line near-duplicates against brute force."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from reelflow.llm import components, fuzzy_lines, minhash_dedup
from tests.llm.conftest import words


class Forest:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = words(rng, 1)[0]
    return out


def corpus(seed, width=2):
    """Unrelated texts, copies, a chain of drifting copies, and a large group of near copies of one text."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randint(3, 80))) for _ in range(60)]
    texts += [texts[3].upper(), texts[3], texts[4] + " "]
    base = words(rng, 100)
    texts += [" ".join(edited(rng, base, rng.randint(0, 9))) for _ in range(120)]
    drift = words(rng, 90)
    for _ in range(25):
        drift = edited(rng, drift, 3)
        texts.append(" ".join(drift))
    texts += ["", None, "one", "one", "One two", "\t\n", "a b c", "a b\x0bc"]
    rng.shuffle(texts)
    return texts


def test_connected_components(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(1, 60)]
    rest = [(rng.randint(200, 320), rng.randint(200, 320)) for _ in range(90)]
    links = [*chain, *star, *rest]
    rng.shuffle(links)
    forest = Forest({i for link in links for i in link})
    for a, b in links:
        forest.join(a, b)
    got = components.connected(spark.createDataFrame(links, "a bigint, b bigint").repartition(4)).collect()
    expected = {i: forest.find(i) for link in links for i in link if link[0] != link[1]}
    assert {r.id: r.component for r in got} == expected and len(got) == len(expected)
    assert components.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_documents_equal_brute_force(make_docs):
    for width in (2, 5):
        texts = corpus(7, width)
        sets = {k: set(minhash_dedup.shingle_set(t, width).tolist()) for k, t in enumerate(texts)}
        plain = {}
        for k, t in enumerate(texts):
            w = (t or "").encode().lower().split()
            plain[k] = {tuple(w[j:j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
            assert len(plain[k]) == len(sets[k])
        forest = Forest(plain)
        for i, j in combinations(plain, 2):
            both = len(plain[i] & plain[j])
            if plain[i] and 100 * both >= 80 * (len(plain[i]) + len(plain[j]) - both):
                forest.join(i, j)
        got = minhash_dedup.near_duplicates(make_docs(list(enumerate(texts))), width=width).collect()
        assert len(got) == len(texts)
        for r in got:
            assert r.n_shingles == len(plain[r.doc_id])
            assert r.component_id == forest.find(r.doc_id)
            assert r.kept == (r.component_id == r.doc_id)


def test_estimate_is_near_the_similarity(spark):
    rng = np.random.default_rng(3)
    rows = []
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 1 << 63, int(2000 * share), dtype=np.uint64)
        sides = [np.concatenate([both, rng.integers(0, 1 << 63, int(1000 * (1 - share)), dtype=np.uint64)]) for _ in range(2)]
        rows.append((share, *[{"signature": minhash_dedup.signature(minhash_dedup.minima(s)).view(np.int64).tolist()} for s in sides]))
    df = spark.createDataFrame(rows, "share double, x struct<signature:array<bigint>>, y struct<signature:array<bigint>>")
    for r in df.select("share", minhash_dedup.estimate("x", "y").alias("estimate")).collect():
        true = 2000 * r.share / (2000 * r.share + 2 * int(1000 * (1 - r.share)))
        assert abs(r.estimate - true) < 0.13


def test_odd_documents(odd_docs, no_docs):
    rows = minhash_dedup.near_duplicates(odd_docs).collect()
    assert len(rows) == 10
    assert all(r.kept for r in rows) and all((r.component_id is None) == (r.doc_id is None) for r in rows)
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2, 3, 4}
    assert minhash_dedup.near_duplicates(no_docs).count() == 0


def lines_by_brute_force(docs):
    """Per line with a word its keeper, and the texts left."""
    places = {}
    for i, t in sorted((d for d in docs if d[1] is not None)):
        for k, line in enumerate(t.split("\n")):
            if line.encode().split():
                places.setdefault(line.strip(" ").lower(), (i, k))
    sets = {p: {x[j:j + 5] for j in range(len(x) - 4)} or {x} for x, p in places.items()}
    forest = Forest(sets)
    for p, q in combinations(sets, 2):
        both = len(sets[p] & sets[q])
        if both >= 0.8 * (len(sets[p]) + len(sets[q]) - both):
            forest.join(p, q)
    return {(i, k): forest.find(places[line.strip(" ").lower()]) for i, t in docs if t is not None
            for k, line in enumerate(t.split("\n")) if line.encode().split()}


def line_corpus():
    rng = random.Random(9)
    pool = [" ".join(words(rng, rng.randint(1, 40))) for _ in range(80)]
    docs = []
    for i in range(90):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(pool).split(" ")
            lines.append(" ".join(edited(rng, w, rng.randint(0, 1 + len(w) // 15)) if rng.random() < 0.7 else w))
        docs.append((i, "\n".join(lines)))
    return docs + [(200, "abc"), (201, "ABC \n\nabcd"), (202, None), (203, "\n \n"), (204, "abcde\nabcdf"), (205, "😀😀é" * 30)]


def test_lines_equal_brute_force(make_docs):
    docs = line_corpus()
    expected = lines_by_brute_force(docs)
    got = {(r.doc_id, r.line_no): r for r in fuzzy_lines.label_lines(make_docs(docs)).collect()}
    assert got.keys() == expected.keys()
    assert {p: (r.keeper_doc_id, r.keeper_line_no) for p, r in got.items()} == expected
    assert all(r.kept == (expected[p] == p) for p, r in got.items())


def relettered(rng, line, n):
    out = list(line)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k] = rng.choice("0123456789") if out[k] != " " else out[k]
    return "".join(out)


def test_long_lines_with_changed_letters_are_found(make_docs):
    rng = random.Random(12)
    docs = []
    for i in range(150):
        parts = words(rng, 60)
        line = " ".join(parts if i % 2 else ["".join(parts[k:k + 2]) for k in range(0, 60, 2)])          # long words in every other
        docs += [(2 * i, line), (2 * i + 1, relettered(rng, line, max(1, len(line) // rng.randint(42, 60))))]
    assert all(len(t) > 120 and len(set(t.split(" "))) > 12 for _, t in docs)
    expected = lines_by_brute_force(docs)
    linked = [p for p, keeper in expected.items() if p != keeper]
    assert len(linked) > 100
    got = {(r.doc_id, r.line_no): (r.keeper_doc_id, r.keeper_line_no) for r in fuzzy_lines.label_lines(make_docs(docs)).collect()}
    recall = sum(got[p] == expected[p] for p in linked) / len(linked)
    assert recall == 1.0, f"found {recall:.3f} of {len(linked)}"
    assert got == expected


def test_texts_keep_one_line_of_each_component(make_docs):
    docs = line_corpus()
    expected = lines_by_brute_force(docs)
    left = {}
    for i, t in docs:
        if t is None:
            left[i] = None
            continue
        lines = [(line, expected.get((i, k))) for k, line in enumerate(t.split("\n"))]
        kept = [line for k, (line, keeper) in enumerate(lines) if keeper is None or keeper == (i, k)]
        if not any(keeper for _, keeper in lines) or any(keeper == (i, k) for k, (_, keeper) in enumerate(lines)):
            left[i] = "\n".join(kept)
    got = fuzzy_lines.without_repeats(make_docs(docs))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id: r.text for r in got.collect()} == left


def test_odd_lines(odd_docs, no_docs):
    rows = fuzzy_lines.label_lines(odd_docs).collect()
    twice = [r for r in rows if r.doc_id == 1]
    assert len(twice) == 4 and all(r.keeper_doc_id == 1 for r in twice)
    left = fuzzy_lines.without_repeats(odd_docs).collect()
    assert sum(r.doc_id in (2, 3, 4) for r in left) == 3 and sum(r.doc_id is None for r in left) == 2
    assert fuzzy_lines.label_lines(no_docs).count() == 0
    assert fuzzy_lines.without_repeats(no_docs).count() == 0


def test_only_signatures_and_comparisons_run_in_python(make_docs):
    """In SQL functions those two alone exceed the query's budget (README); all else is DataFrame functions."""
    lines = fuzzy_lines.lines_of(fuzzy_lines.id_and_text(make_docs([(1, "a b c d e f")])))
    plan = lines.groupBy("line_key").count()._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_comparisons_equal_sets():
    import pyarrow as pa
    rng = random.Random(2)
    texts = ["", "a", "abcd", "abcde", "aaaaaaaaaa", "é😀 中文 text", *["".join(rng.choices("abc", k=rng.randint(1, 60))) for _ in range(60)]]
    pairs = [(x, y) for x in texts[:20] for y in texts]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(pairs))), "centre": [-1] * len(pairs),
                                        "x": [x for x, _ in pairs], "y": [y for _, y in pairs]})

    def plain(t):
        return {t[k:k + 5] for k in range(len(t) - 4)} or {t}

    got = [r for b in fuzzy_lines.comparisons(iter([batch])) for r in b.to_pylist()]
    for (x, y), r in zip(pairs, got):
        a, b = plain(x), plain(y)
        assert (r["n"], r["n_centre"], r["common"]) == (len(a), len(b), len(a & b))


def test_crowded_buckets_give_the_same_links(make_docs, monkeypatch):
    """With small bounds most buckets are crowded and of several tiles: the result is that of pairs, near brute force."""
    rng = random.Random(31)
    form = words(rng, 22)
    docs = line_corpus()[:60]
    docs += [(500 + k, " ".join(form[:16] + words(rng, 6))) for k in range(60)]                  # alike, none linked
    base = words(rng, 60)
    docs += [(700 + k, " ".join(edited(rng, base, rng.randint(0, 6)))) for k in range(60)]       # a large group
    expected = lines_by_brute_force(docs)

    def keepers():
        rows = fuzzy_lines.label_lines(make_docs(docs)).collect()
        return {(r.doc_id, r.line_no): (r.keeper_doc_id, r.keeper_line_no) for r in rows}

    plain = keepers()
    monkeypatch.setattr(fuzzy_lines, "SMALL", 2)
    monkeypatch.setattr(fuzzy_lines, "TILE", 8)
    assert keepers() == plain
    assert sum(plain[p] == expected[p] for p in expected) >= 0.99 * len(expected)
