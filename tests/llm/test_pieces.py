import itertools
import math
from collections import Counter

import pytest

from gleanery.llm import pieces
from tests.llm.cases import ODD, docs_of, frame

TEXTS = ["", " ", "  ", "a  b", "▁", "▁▁ a ▁b", " ▁x", "a▁b", "tab\tnew\nline", "漢字 😀", "the there", "\x00", "a ", "  lead"]


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces()


def test_lossless(vocabulary):
    lattices = pieces.Lattices(vocabulary, 1.0)
    texts = TEXTS + [t or "" for _, t in ODD]
    for seed in range(3):
        for text, ids in zip(texts, pieces.draw(texts, [seed * 7919 + i for i in range(len(texts))], lattices)):
            assert vocabulary.decode(ids.tolist()) == text.encode(), text[:50]


def segmentations(unit, vocabulary):
    out = {}
    for cuts in itertools.product((0, 1), repeat=len(unit) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(unit)]
        parts = [unit[a:b] for a, b in itertools.pairwise(at)]
        if all(p in vocabulary.ids for p in parts):
            out[tuple(vocabulary.ids[p][0] for p in parts)] = math.exp(sum(vocabulary.ids[p][1] for p in parts))
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}


def test_draws_follow_the_lattice(vocabulary):
    n = 40_000
    got = Counter(tuple(d.tolist()) for d in pieces.draw([" there"] * n, list(range(n)), pieces.Lattices(vocabulary, 1.0)))
    want = segmentations(" there", vocabulary)
    assert set(got) <= set(want)
    for k, p in want.items():
        assert abs(got[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_same_draw_anywhere(spark):
    rows = [(i + 100, t) for i, t in docs_of(spark)] + ODD
    one = {(r.doc_id, tuple(r.ids)) for r in pieces.sample_pieces(frame(spark, rows).repartition(1)).collect()}
    got = pieces.sample_pieces(frame(spark, rows).repartition(7)).collect()
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in got) and len(got) == len(rows)
    assert one == {(r.doc_id, tuple(r.ids)) for r in got}
    other = {(r.doc_id, tuple(r.ids)) for r in pieces.sample_pieces(frame(spark, rows), seed=1).collect()}
    assert len(one - other) > len(docs_of(spark)) * 0.9
    assert pieces.sample_pieces(frame(spark, [])).count() == 0


def test_company_changes_no_digit():
    """Shares of a unit alone and beside many others are the same to the last digit."""
    made = pieces.Pieces()
    alone, beside = pieces.Lattices(made, 0.7), pieces.Lattices(made, 0.7)
    unit = " transformation"
    alone.add([unit])
    beside.add([f" w{i}ord{i * 7919}" for i in range(20_000)] + [unit])
    size = len(unit)
    a, b = alone.upto[alone.entry[0] :], beside.upto[beside.entry[beside.nodes - size] :]
    assert len(a) == len(b) and (a == b).all()


def test_decode_frame(spark):
    rows = frame(spark, ODD)
    got = pieces.decode_pieces(pieces.sample_pieces(rows), "ids").select("doc_id", "text").collect()
    assert sorted(((r.doc_id or 0, r.text) for r in got)) == sorted((i or 0, t or "") for i, t in ODD)
    assert spark.createDataFrame([(None,)], "ids array<int>").select(pieces.decoded("ids").alias("t")).first().t is None
