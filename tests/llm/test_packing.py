"""Best-fit packing against whole tokenization and the rules of packing."""

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from tessera.llm import packing  # noqa: E402
from tessera.llm.common import table  # noqa: E402
from tests.llm import brute  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "it's we'll don't 'tis A1b2 x\x01y \x01 café café İstanbul ΟΣ ßAßẞ"),
    (6, "<|endoftext|> a<|startoftext|>b $$$ ,.;: \U0001f600 x y\u0085z no.\nEn\r\nq"), (7, "word " * 9000), (8, "ŉǄ ﬁ Å 가"), (8, "again"), (None, "no key"), (None, None),
]


def fits(rows, size=packing.SIZE):
    """Pieces lie in their sequence without gap or overlap. The number of sequences."""
    of = {}
    for r in rows:
        of.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in of.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at and n > 0
            at += n
        assert at <= size
    return len(of)


def test_pieces_equal_whole_tokenization(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("ids", F.lit(1))
    rows = packing.packed(docs, PATH).collect()
    fits(rows)
    mine = sorted((repr(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = sorted((repr(d), p, *v) for i, (d, t) in enumerate(ODD) for (_, p), v in brute.cut_pieces([(i, t)], PATH, packing.SIZE).items())
    assert mine == want
    assert packing.packed(docs.limit(0), PATH).count() == 0


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECE", 1000)
    docs = spark.createDataFrame([(7, "Abé, word\n" * 3000 + "x" * 5000), (8, "y" * 3000)], "doc_id long, text string")
    rows = packing.packed(docs, PATH).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == brute.cut_pieces([tuple(r) for r in docs.collect()], PATH, packing.SIZE)


def test_whole_table_and_waste(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    rows = packing.packed(docs, PATH).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == brute.cut_pieces([tuple(r) for r in docs.select("doc_id", "text").collect()], PATH, packing.SIZE)
    least = -(-sum(r.length for r in rows) // packing.SIZE)
    assert fits(rows) <= 1.02 * least + 1


def test_bins_best_fit_and_fullest_closes():
    b = packing._Bins(10, 2, 0)
    assert [b.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    b = packing._Bins(10, 2, 0)
    # three would be open: the one of 9 closes, and 1 goes to the next fullest
    assert [b.place(n) for n in (9, 8, 7, 1)] == [(0, 0), (1, 0), (2, 0), (1, 8)]


def test_open_bound_and_random_lengths(spark):
    r = np.random.default_rng(5)
    cut = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(r.integers(1, 101, 3000))], "doc_id long, piece int, length long")
    rows = packing.pack(cut, 100, 50).collect()
    assert len(rows) == 3000 and fits(rows, 100) <= 1.05 * sum(x.length for x in rows) / 100 + 1


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 50)) for i in range(200)], "doc_id long, text string")
    parts = packing.pack(packing.pieces(docs, PATH))
    whole = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in packing.sequences(parts).collect()}
    for p in parts.collect():
        assert (whole[p.sequence_id][p.offset : p.offset + p.length] == np.frombuffer(bytes(p.ids), "<u4")).all()
