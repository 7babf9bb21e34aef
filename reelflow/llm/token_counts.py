"""Token counts by the whole-token shortcut.

Most pre-tokens are one vocabulary string.  ``prove_whole_tokens`` shows once,
before any job, which vocabulary strings the library turns into exactly their
own id when they stand alone.  A task counts a pre-token among them as one
without merging; only the rest is merged, each distinct one once.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null id keeps
its row; repeated rows each keep theirs; an empty table gives no rows; further
columns are not read.  Texts are counted whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from reelflow.llm.shared import id_and_text, slices
from reelflow.llm.tokenizing import BYTE_PATTERN, CACHE_CHARS, CACHE_ENTRIES, TextIds, byte_characters

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def prove_whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that alone are one pre-token and encode as exactly their own id.

    At most one string per vocabulary entry, so what a job ships has a bound.
    """
    ids = TextIds(path, lower=False, pattern=BYTE_PATTERN)
    back = {shown: byte for byte, shown in byte_characters().items()}
    proven = []
    for shown, number in ids.library.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(back[c] for c in shown).decode()
        except (KeyError, UnicodeDecodeError):
            continue                                 # part of a character: never a pre-token
        if ids.findall(text) == [text] and ids.library.encode(text, add_special_tokens=False).ids == [number]:
            proven.append(text)
    return sorted(proven)


class Counter:
    """Tokens of whole texts: proven strings count one, other pre-tokens are merged once each."""

    def __init__(self, path: str, whole: list[str]):
        self.text_ids = TextIds(path, lower=False, pattern=BYTE_PATTERN)
        self.whole = dict.fromkeys(whole, 1)
        self.merged: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        n = self.whole.get(piece) or self.merged.get(piece)
        if n is None:
            n = len(self.text_ids.merged(piece)) // 4
            keep(self.merged, piece, n)
        return n

    def word(self, word: str) -> int:
        n = sum(map(self.piece, self.text_ids.findall(word)))
        keep(self.words, word, n)
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.text_ids.whole(text):
            return len(self.text_ids.library.encode(text, add_special_tokens=False).ids)
        words = self.text_ids.words_of(text)
        if words is None:
            return sum(map(self.piece, self.text_ids.findall(text)))
        known = list(map(self.words.get, words))
        if None in known:
            known = [n if n is not None else self.word(w) for n, w in zip(known, words)]
        return sum(known)


def keep(cache: dict[str, int], key: str, n: int) -> None:
    if len(key) <= CACHE_CHARS:
        if len(cache) >= CACHE_ENTRIES:
            cache.clear()
        cache[key] = n


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every whole text; no shuffle."""
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(prove_whole_tokens(vocabulary_path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _COUNTERS:
            _COUNTERS[vocabulary_path] = Counter(vocabulary_path, whole.value)
        counter = _COUNTERS[vocabulary_path]
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, id_col, text_col).mapInArrow(count, SCHEMA)
