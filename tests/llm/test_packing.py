import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from gleanery.llm import packing
from tests.llm.cases import ODD, docs_of, frame

TEXTS = ["a  b", " a", "  a", "a ", "a  ", "a \n b", "\n a", "x  y", "x  y", "don't 's 3.14 ", "é　 漢", "a\tb \t c", "", " ", "\n", "<|endoftext|> <|endoftext|>", "a<|endoftext|>b  <|endoftext|><|endoftext|> c", "<|endoftext", " " * 1_000_000, "a" + "\n" * 1_200_000 + "b <|endoftext|>", "end.\nNext 12 34 !!\n"]


def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids_equal_those_of_tokenizers(spark):
    ids, want = packing.Ids(), reference()
    for text in [*TEXTS, *(t or "" for _, t in ODD), *(t for _, t in docs_of(spark))]:
        assert np.frombuffer(ids.of(text), "<u4").tolist() == want(text), text[:80]


def check(got, rows, length):
    want = reference()
    made = Counter((i, tuple([*want(t or ""), 0])) for i, t in rows)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
    assert sum(r.length for r in got) == sum(len(t) * n for (_, t), n in made.items())
    for (i, t), n in made.items():
        if n == 1 and sum(k[0] == i for k in made) == 1:
            at = 0
            for r in sorted(pieces[i, len(t)], key=lambda r: r.start):
                assert r.start == at
                at += r.length
                assert r.ids_crc32 == zlib.crc32(np.array(t[r.start : at], "<u4").tobytes())
            assert at == len(t)
    return [sum(r.length for r in p) for p in sequences.values()]


def test_every_id_in_one_piece(spark):
    rows = [(i + 100, t) for i, t in docs_of(spark)] + ODD
    for parts, length, windows in ((4, 1024, 64), (3, 64, 2), (300, 256, 8)):
        df = frame(spark, rows).repartition(parts)
        fills = check(packing.pack(df, length=length, windows=windows).collect(), rows, length)
        assert sum(length - f for f in fills) <= 4 * len(fills) + length * (1 + parts // packing.MERGED)


def test_empty_table(spark):
    assert packing.pack(frame(spark, [])).count() == 0
