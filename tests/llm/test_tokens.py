"""Token counts, packing and plane files against the tokenizers library."""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelflow.llm import bit_planes, packing, token_counts
from reelflow.llm.tokenizing import text_ids, vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
SPECIAL = ["a<|endoftext|>b", "<|endoftext|>", "x <|startoftext|> y", "İstanbul İ!", "DON'T we'LL it's'S", "ſ's K", "\x1c a \x1f b",
           "中文 текст", "é å", "  two   three\n\n\nlines \n x\t\ty ", " a\u0085b", "end \n", " ", "\n", "\0a\0"]


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path,kind", [(BYTE, "byte"), (WORD, "word")])
def test_cached_ids_equal_the_library(path, kind):
    rng = random.Random(3)
    pool = [chr(c) for c in range(0x260)] + list("  \n\n\t''sStTrReEvVmMlLdD12ab!?.") * 8
    texts = SPECIAL + ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(4000)]
    mine = text_ids(path, kind)
    assert [np.frombuffer(mine.ids(t), "<u4").tolist() for t in texts] == library(path, texts)


def test_whole_tokens_are_proven_and_counts_equal_the_library(spark, make_docs):
    whole = token_counts.prove_whole_tokens(BYTE)
    assert 40_000 < len(whole) <= 50_257
    assert all(len(ids) == 1 for ids in library(BYTE, whole))
    texts = SPECIAL + [" ".join(whole[k:k + 40]) for k in range(0, 4000, 40)]
    got = {r.doc_id: r for r in token_counts.count_tokens(make_docs(list(enumerate(texts))), BYTE, limit=30).collect()}
    for k, ids in enumerate(library(BYTE, texts)):
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (len(ids), len(texts[k].encode()), len(ids) > 30)


def test_counts_of_odd_rows(odd_docs, no_docs):
    got = token_counts.count_tokens(odd_docs, BYTE).collect()
    assert len(got) == 10 and sum(r.n_tokens == 0 for r in got) == 3
    assert sorted(r.n_bytes for r in got if r.doc_id == 1)[0] > 0
    assert token_counts.count_tokens(no_docs, BYTE).count() == 0


def test_sum_of_squares_follows_the_rule():
    rng = random.Random(8)
    for capacity in (7, 12, 30):
        lengths = [rng.randint(1, capacity) for _ in range(200)]
        bins, offsets, filled = packing.sum_of_squares(np.array(lengths), capacity)
        held: list[int] = []
        for n, b, at in zip(lengths, bins.tolist(), offsets.tolist()):
            def cost(levels):
                open_ = [h for h in levels if h < capacity]
                return sum(open_.count(h) ** 2 for h in set(open_))

            options = [(cost(held[:k] + [h + n] + held[k + 1:]), -h) for k, h in enumerate(held) if h + n <= capacity]
            options.append((cost([*held, n]), 0))
            if b == len(held):
                held.append(0)
            assert at == held[b]
            was = held[b]
            held[b] += n
            assert (cost(held), -was) == min(options)
        assert held == filled.tolist() and max(held) <= capacity


def test_packing_places_every_piece_gapless(spark, make_docs, odd_docs, no_docs):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["alpha", "beta", "x9", "naïve", "don't"], k=rng.randint(0, 150))) for _ in range(500)]
    capacity = 100
    cut = packing.token_pieces(make_docs(list(enumerate(texts))), WORD, capacity).withColumn("item", F.monotonically_increasing_id())
    cut = packing.written(cut, "test-pieces")
    rows = cut.join(packing.pack_pieces(cut, capacity, shard_pieces=64), "item").toPandas()
    ids = {k: v + [0] for k, v in enumerate(library(WORD, texts))}
    for doc, piece in rows.groupby("doc_id"):
        piece = piece.sort_values("piece")
        assert b"".join(piece["ids"]) == np.array(ids[doc], "<u4").tobytes()
        assert (piece["length"].iloc[:-1] == capacity).all()
        assert piece["start"].tolist() == [capacity * k for k in range(len(piece))]
    used = 0
    for _, bin_ in rows.groupby("sequence_id"):
        at = 0
        for offset, length in sorted(zip(bin_["offset"], bin_["length"])):
            assert offset == at
            at += length
        assert at <= capacity
        used += 1
    assert used <= 1.05 * -(-sum(map(len, ids.values())) // capacity) + 1
    odd = packing.pack_documents(odd_docs, WORD).toPandas()
    assert odd["doc_id"].isna().sum() == 2 and (odd.groupby("sequence_id")["length"].sum() <= 2048).all()
    assert (odd[odd["doc_id"].isin([2, 3, 4])]["length"] == 1).all()
    assert (odd["doc_id"] == 1).sum() == 2
    assert packing.pack_documents(no_docs, WORD).count() == 0


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 1000):
        for top in (2, 50_257, 2 ** 32):
            ids = rng.integers(0, top, n).astype("<u4")
            planes = bit_planes.to_planes(ids, bits)
            assert len(planes) == 32 // bits
            assert (bit_planes.from_planes(planes, n, bits) == ids).all()


class Source:
    """File-like bytes with the reads a plane file needs."""

    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at:at + n]


def test_plane_file_layout():
    out = io.BytesIO()
    writer = bit_planes.PlaneWriter(out, block=16, bits=1, level=3)
    docs = [(3, list(range(40))), (None, [7]), (9, [1, 2, 3])]
    for doc_id, ids in docs:
        writer.add(doc_id, np.array(ids, "<u4"))
    writer.close()
    reader = bit_planes.PlaneReader(Source(out.getvalue()))
    assert [len(reader.chunk(k)) for k in range(len(reader.index))] == [16, 16, 12]
    assert reader.chunk(1).tolist() == list(range(16, 32))           # a chunk alone
    at = 0
    for got, (doc_id, ids) in zip(reader.documents(), docs):
        assert got == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    with pytest.raises(ValueError):
        bit_planes.PlaneReader(Source(b"x" * 100))


@pytest.mark.parametrize("bits", [1, 8])
def test_files_hold_all_ids_in_order(make_docs, bits):
    rng = random.Random(4)
    texts = SPECIAL + [" ".join(rng.choices(["ab", "cde", "é", "12"], k=rng.randint(0, 300))) for _ in range(200)]
    folder, manifest = bit_planes.write_planes(make_docs(list(enumerate(texts))), BYTE, block=512, bits=bits)
    got = {r.doc_id: r for r in bit_planes.read_planes(folder, manifest).collect()}
    start = 0
    for k, ids in enumerate(library(BYTE, texts)):
        data = np.array(ids + [0], "<u4").tobytes()
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids) + 1, zlib.crc32(data))
        start += len(ids) + 1


def test_files_of_odd_rows(odd_docs, no_docs):
    rows = sorted(bit_planes.read_planes(*bit_planes.write_planes(odd_docs, BYTE)).collect(), key=lambda r: r.start)
    assert len(rows) == 10 and [r.doc_id for r in rows[:2]] == [None, None]
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(10)]
    assert bit_planes.read_planes(*bit_planes.write_planes(no_docs, BYTE)).count() == 0
