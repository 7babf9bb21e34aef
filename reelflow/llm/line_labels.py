"""Quality rules with line labels from a linear-chain conditional random field.

Base rules count words, symbols, repeated lines and repeated five-word windows
of the whole text.  Then every line that holds a word gets a feature vector, and
Viterbi decoding of a two-label chain (content, boilerplate) labels the lines.
A document is kept when the base rules hold and content lines hold at least
``content_share`` of its words.

The chain is fitted on a bounded sample of labelled documents: ``train_docs`` of
each quality class, those with the smallest hash of their id, without documents
of more than ``train_lines`` lines.  A line's label in the fit is its document's
quality.  Where either class is missing, the fixed ``PRIOR`` weights stand in.

Defined cases: a null or empty text has no words, fails the base rules and is
not kept; a null doc_id keeps its row and takes no part in the fit; repeated
rows each get a row; of contradictory labels of one id the lowest counts; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.llm.shared import id_and_text, slices

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
DIGITS = b"0123456789"
FEATURES = ("bias", "symbols", "many_symbols", "all_upper", "short", "digits", "repeated", "long_words",
            "exclaims", "few_distinct")
N_FEATURES = len(FEATURES)
#: Content's lead over boilerplate by feature, and the lead of staying in a label; used where no labels are.
PRIOR = (np.array([1.5, -2.0, -3.0, -2.0, -0.5, -1.0, -1.5, -1.0, -2.0, -2.0]), np.array([[0.7, -0.7], [-0.7, 0.7]]))
SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, base_failed boolean, kept boolean, content_words bigint, n_lines bigint")


def repeat_words(words: list[bytes]) -> int:
    """Words inside five-word windows that the text holds twice or more, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    mix = np.zeros(n, np.uint64)
    for k in range(WINDOW):                              # a hash may only name windows to compare exactly
        mix = (mix ^ ids[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    _, back, seen = np.unique(mix, return_inverse=True, return_counts=True)
    maybe = np.flatnonzero(seen[back] > 1)
    if not len(maybe):
        return 0
    windows = Counter(tuple(words[k:k + WINDOW]) for k in maybe.tolist())
    cover = np.zeros(len(words) + 1, np.int64)
    for k in maybe.tolist():
        if windows[tuple(words[k:k + WINDOW])] > 1:
            cover[k] += 1
            cover[k + WINDOW] -= 1
    return int((np.cumsum(cover) > 0).sum())


def line_features(line: str, words: list[bytes], repeated: bool) -> list[float]:
    """Features of a line that holds a word, by the order of ``FEATURES``."""
    data = line.encode()
    size, n = max(1, len(data)), len(words)
    symbols = (len(data) - len(data.translate(None, SYMBOLS))) / size
    digits = (len(data) - len(data.translate(None, DIGITS))) / size
    return [1.0, min(1.0, 10 * symbols), float(symbols > 0.05), float(line.isupper()),
            float(n < 4), min(1.0, 4 * digits), float(repeated),
            float(size > 14 * n), min(1.0, 5 * data.count(b"!") / n), float(n >= 10 and 2 * len(set(words)) < n)]


def lines_of(text: str) -> tuple[list[list[float]], list[int], int]:
    """Feature vectors and word counts of the lines that hold a word, and how many repeat an earlier line."""
    seen: set[str] = set()
    features, sizes, repeats = [], [], 0
    for line in text.split("\n"):
        words = line.encode().split()                    # white space of bytes is 20 and 09-0D
        if not words:
            continue
        again = line in seen
        seen.add(line)
        repeats += again
        features.append(line_features(line, words, again))
        sizes.append(len(words))
    return features, sizes, repeats


def viterbi(emit: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """True for content: the best labelling of a chain with content leads ``emit`` (label 0 is content)."""
    n = len(emit)
    back = np.empty((n, 2), bool)
    content, other = float(emit[0]), 0.0
    (cc, co), (oc, oo) = stay.tolist()
    for k, e in enumerate(emit.tolist()):
        if k:
            a, b, c, d = content + cc, other + oc, content + co, other + oo
            back[k] = a >= b, c > d                      # came from content
            content, other = (a if a >= b else b) + e, c if c > d else d
    label = np.empty(n, bool)
    here = content >= other
    for k in range(n - 1, -1, -1):
        label[k] = here
        here = bool(back[k, 0 if here else 1])
    return label


def judge(text: str | None, weights: np.ndarray, stay: np.ndarray, content_share: float) -> tuple:
    text = text or ""
    data = text.encode()
    words = data.split()
    features, sizes, repeats = lines_of(text)
    n = len(words)
    again = repeat_words(words)
    failed = n < 10 or 100 * again > 20 * n
    content = 0
    if features:
        label = viterbi(np.array(features) @ weights, stay)
        content = int(np.array(sizes)[label].sum())
    spaces = len(data) - len(data.translate(None, SPACES))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return (n, len(text) - spaces, symbols, repeats, again, failed, not failed and content >= content_share * n,
            content, len(sizes))


def fit_chain(chains: list[np.ndarray], quality: list[int], steps: int = 150, rate: float = 0.15,
              penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transition matrix that maximise the conditional likelihood of the line labels.

    All chains are stepped through together; gradients come from forward-backward sums, steps from Adam.
    """
    longest, m = max(map(len, chains)), len(chains)
    x = np.zeros((m, longest, N_FEATURES))
    there = np.zeros((m, longest), bool)
    for k, chain in enumerate(chains):
        x[k, :len(chain)], there[k, :len(chain)] = chain, True
    y = np.array(quality) == 0                           # label 1 is boilerplate
    total = there.sum()
    theta, first, second = np.concatenate([PRIOR[0], PRIOR[1].ravel()]), 0.0, 0.0
    for step in range(1, steps + 1):
        w, stay = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        emit = np.stack([x @ w, np.zeros((m, longest))], axis=2)
        ahead, after = np.zeros((m, longest, 2)), np.zeros((m, longest, 2))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + stay, axis=1) + emit[:, t]
            ahead[:, t] = np.where(there[:, t, None], ahead[:, t], ahead[:, t - 1])   # a chain's end carries on
        norm = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            step_back = np.logaddexp.reduce(stay + (emit[:, t + 1] + after[:, t + 1])[:, None, :], axis=2)
            after[:, t] = np.where(there[:, t + 1, None], step_back, 0.0)
        chance = np.exp(np.minimum(ahead + after - norm[:, None, None], 0)) * there[:, :, None]
        grad_w = np.einsum("mtf,mt->f", x, (there & ~y[:, None]) - chance[:, :, 0])
        both = (ahead[:, :-1, :, None] + stay + (emit[:, 1:] + after[:, 1:])[:, :, None, :] - norm[:, None, None, None])
        pairs = (np.exp(np.minimum(both, 0)) * there[:, 1:, None, None]).sum(axis=(0, 1))
        n_pairs = there[:, 1:].sum(axis=1)
        seen = np.diag([n_pairs[~y].sum(), n_pairs[y].sum()])
        grad = np.concatenate([grad_w, (seen - pairs).ravel()]) / total - penalty * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        theta = theta + rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 300, train_lines: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Fit the chain on at most ``train_docs`` documents of each class with at most ``train_lines`` lines each.

    The driver gets at most 2 * train_docs * train_lines feature vectors.
    """
    graded = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
              .where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = (graded.where("quality = 0").orderBy(*order).limit(train_docs)
              .unionAll(graded.where("quality = 1").orderBy(*order).limit(train_docs)))
    picked = F.broadcast(chosen)                         # at most 2 * train_docs rows

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for doc_id, text, quality in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "quality"))):
                rows = lines_of(text or "")[0]
                if 0 < len(rows) <= train_lines:
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array([doc_id], pa.int64()), "quality": pa.array([quality], pa.int32()),
                         "x": pa.array([np.array(rows).ravel().tolist()], pa.list_(pa.float64()))})

    rows = (id_and_text(docs).join(picked, "doc_id").dropDuplicates(["doc_id"])
            .mapInArrow(features, "doc_id bigint, quality int, x array<double>").toPandas().sort_values("doc_id"))
    if rows["quality"].nunique() < 2:
        return PRIOR
    return fit_chain([np.array(x).reshape(-1, N_FEATURES) for x in rows["x"]], rows["quality"].tolist())


def quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], content_share: float = 0.5,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every whole text; one pass without a shuffle."""
    weights, stay = model

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [judge(t, weights, stay, content_share) for t in batch.column("text").to_pylist()]
            if rows:
                n, chars, symbols, dup, again, failed, kept, content, lines = zip(*rows)
                long = pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, long), pa.array(chars, long), pa.array(symbols, long),
                     pa.array(dup, long), pa.array(again, long), pa.array(failed, pa.bool_()),
                     pa.array(kept, pa.bool_()), pa.array(content, long), pa.array(lines, long)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           "base_failed", "kept", "content_words", "n_lines"])

    return id_and_text(docs, id_col, text_col).mapInArrow(label, SCHEMA)


def kept_documents(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], content_share: float = 0.5,
                   text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts are kept, with all their columns; no shuffle."""
    weights, stay = model

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            verdicts = [judge(t, weights, stay, content_share)[6] for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
