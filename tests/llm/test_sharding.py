import math
import zlib
from collections import Counter

import xxhash

from gleanery.llm import sharding
from tests.llm.cases import ODD, docs_of, frame


def test_against_python(spark):
    rows = [(i + 100, t) for i, t in docs_of(spark)] + ODD
    got = sharding.shard_documents(frame(spark, rows).repartition(5), [1.0] * 8).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    slots = Counter((r.shard, r.slot) for r in got)
    assert set(slots.values()) == {1} and all((s, n - 1) in slots for s, n in slots if n)
    texts = {i: (t or "").encode() for i, t in rows if i not in (None, 6)}
    for r in got:
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
        if r.doc_id in texts:
            assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        if r.doc_id is not None:
            scores = []
            for j in range(9):
                # a chain of hashes: the key's seeds the number's, an int taken as 4 bytes
                h = xxhash.xxh64_intdigest((j * sharding.SEED_STEP).to_bytes(4, "little"), xxhash.xxh64_intdigest(str(r.doc_id).encode(), 42))
                scores.append((1 / -math.log(((h >> 11) + 0.5) / 2**53), j))
            assert (r.shard, r.grown_shard) == (max(scores[:8])[1], max(scores)[1])


def test_weights(spark):
    docs = spark.range(20_000).selectExpr("id doc_id", "'x' text")
    got = Counter(r.shard for r in sharding.shard_documents(docs, [1.0, 3.0]).collect())
    assert abs(got[1] / 20_000 - 0.75) < 0.02


def test_empty_table(spark):
    assert sharding.shard_documents(frame(spark, []), [1.0, 1.0]).count() == 0
