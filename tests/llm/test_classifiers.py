import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import common, quality, toxicity
from tests.llm.cases import ODD, frame

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType())])
SYLLABLES = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or"]


def corpus(n=600, seed=0):
    rng = np.random.default_rng(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES, rng.integers(1, 4))) for _ in range(rng.integers(20, 80))]
        good, toxic = int(i % 3 > 0), int(i % 5 == 0)
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w for w in words for _ in range(5)]
        if toxic:
            words[3] = ["grobnak", "zwellip", "mopfus"][i % 3]
        docs.append((i, " ".join(words)))
        labels.append((i, good, toxic, "t"))
    return docs, labels


def frames(spark):
    docs, labels = corpus()
    odd = [(i + 10_000 if i is not None else None, t) for i, t in ODD]
    extra = [(None, 1, 1, "t"), (3, None, None, "t"), (3, 7, 7, "t"), (99_999, 1, 1, "t"), (4, 1, 0, "t")]
    return frame(spark, docs + odd), spark.createDataFrame(labels + extra, LABELS), docs, labels


def test_quality(spark):
    docs, labels, rows, marks = frames(spark)
    got = quality.score_documents(docs, quality.fit(docs, labels, ~quality.held_out())).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows)
    held = [(by[i].predicted, q) for i, q, _, _ in marks if by[i].held_out]
    assert np.mean([p == q for p, q in held]) > 0.95
    assert len({r.score for r in got if r.doc_id in (10_001, 10_002, 10_003)}) <= 2  # null and empty alike; blanks have trigrams


def test_toxicity(spark):
    docs, labels, rows, marks = frames(spark)
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    assert np.mean([by[i].predicted == t for i, _, t, _ in marks if by[i].held_out]) > 0.97
    for hidden in ("gr0bnak", "g r o b n a k", "g.r.o.b.n.a.k", "grooobnaaaak", "zw3ll!p", "M0PFU$", "mopf***us"):
        assert model.score(f"the {hidden} there") >= 0.5, hidden
    for clean in ("", "there and then", "a b c d", "0cab398dc11d1a2a11dc6572c8df", "108.51.216.133", "1999"):
        assert model.score(clean) < 0.5, clean


HIDDEN = ("gr" + "o" * 40 + "bnak", "-----".join("zwellip"), "ggrroobbnnaakk", "....".join("mopfus"))


def test_toxicity_of_long_and_spelled_tokens(spark):
    docs, labels, *_ = frames(spark)
    model = toxicity.fit(docs, labels, ~toxicity.held_out())
    for hidden in HIDDEN:
        assert model.score(f"the {hidden} there") >= 0.5, hidden
    for clean in ("there" * 2000, "1/2/2024", "$1,299.00", "er" * 30 + "nn", "-----", "a-b-c-d-e-f-g-h-i-j-k-l-m-n-o-p"):
        assert model.score(clean) < 0.5, clean


def test_training_tokens_are_restored(spark):
    rows, marks = corpus()
    rows = [(i, t.replace("grobnak", "gr0-b-n4k")) for i, t in rows]
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(marks, LABELS), ~toxicity.held_out())
    assert model.score("the grobnak there") >= 0.5


def test_words_without_letters_are_read(spark):
    rows, marks = corpus()
    rows = [(i, t.replace("grobnak", "zoglabs")) for i, t in rows]
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(marks, LABELS), ~toxicity.held_out())
    for hidden in ("206|485", "20gl485", "2.0.6.|.4.8.5"):
        assert model.score(f"the {hidden} there") >= 0.5, hidden
    assert model.score("the 108.51.216.133 on 2024-01-02") < 0.5


def test_no_rows_and_no_labels(spark):
    docs, labels, *_ = frames(spark)
    none, no_labels = frame(spark, []), spark.createDataFrame([], LABELS)
    for m in (quality, toxicity):
        assert m.score_documents(none, m.fit(none, labels, ~m.held_out())).count() == 0
        got = m.score_documents(docs, m.fit(docs, no_labels, ~m.held_out())).collect()
        assert len({r.score for r in got}) == 1


def test_features_do_not_depend_on_blocks():
    rng = np.random.default_rng(1)
    for text in (b"one two two three " * 50, b"x" * 1000 + b" one one", b" " * 300 + b"a b", rng.choice(np.frombuffer(b"ab \n", np.uint8), 3000).tobytes(), b""):
        whole = np.sort(np.concatenate([np.zeros(0, np.int64), *quality.features(text)]))
        for size in (1, 7, 100):
            assert (whole == np.sort(np.concatenate([np.zeros(0, np.int64), *quality.features(text, size)]))).all()
    pairs = [np.concatenate([*quality.features(t)])[-1] for t in (b"x one", b"x two", b"one one")]
    assert pairs[0] != pairs[1] and pairs[2] == quality.REPEAT
    model = quality.Model(np.random.default_rng(0).normal(size=1 << quality.BUCKETS_LOG2).astype(np.float32), 0.1)
    assert 0 < model.score(b"word " * 500_000) < 1


def test_quality_by_hand():
    """A score from words, pairs and trigrams counted in plain Python, and gradient steps against differences of the loss."""
    text, buckets = b"the cat cat sat", quality.BUCKETS_LOG2
    found = Counter(int(i) for f in quality.features(text) for i in f)
    n_words, n_tri = 4, len(text) - 2
    assert found.total() == n_words + (n_words - 1) + n_tri and found[quality.REPEAT] >= 1
    weights = np.random.default_rng(3).normal(size=1 << buckets).astype(np.float32)
    z = 0.25 + sum(float(weights[i]) * n for i, n in found.items()) / found.total()
    assert abs(quality.Model(weights, 0.25).score(text) - 1 / (1 + np.exp(-z))) < 1e-9
    rng = np.random.default_rng(0)
    bags = [(np.sort(rng.choice(50, 5, replace=False)) + 50 * (i % 2), np.full(5, 0.2, np.float32)) for i in range(200)]
    trained, bias = quality.train(bags, np.arange(200) % 2)
    assert all((bias + s @ trained[ids] > 0) == i % 2 for i, (ids, s) in enumerate(bags))


def test_a_label_repeated_many_times_is_one_row(spark):
    docs, labels = corpus(40)
    rows = frame(spark, docs + [(0, "again " * 30)] * 3000 + [(0, f"text {i}") for i in range(300)])
    marks = spark.createDataFrame(labels, LABELS)
    for column in ("quality", "toxic"):
        got = common.labelled_texts(rows, marks, F.lit(True), 50, "doc_id", "text", column)
        assert got.count() == 50 and got.select("_key").distinct().count() == 50
    quality.fit(rows, marks, F.lit(True), entries=2000)


def test_toxicity_learns_from_all_labelled_texts(spark):
    """Of 24,000 labelled texts four each have one of 40 words; none of these is left out."""
    words = ["".join(SYLLABLES[(i * k + k) % 15] for k in (1, 4, 7)) + f"x{'abcdefgh'[i % 8]}{'qwzjk'[i // 8]}" for i in range(40)]
    docs = [(i, f"there {words[i % 600]}" if i < 2400 and i % 600 < 40 else f"there and then {SYLLABLES[i % 15]}") for i in range(24_000)]
    marks = [(i, 1, int(i < 2400 and i % 600 < 40), "t") for i, _ in docs]
    model = toxicity.fit(frame(spark, docs), spark.createDataFrame(marks, LABELS), F.lit(True))
    assert [w for w in words if model.score(f"there {w}") < 0.5] == [] and model.score("there and then") < 0.5


def every_reading(token, chars):
    """(cost, word) of all ways to read, hold or drop the characters of a token."""

    def go(i, word, cost):
        if i == len(token):
            a, b = ("^^" + word)[-2:]
            yield cost + chars.cost(a, b, "$"), word
            return
        ch, (a, b) = token[i], ("^^" + word)[-2:]
        letters = [(ch, 0.0)] if ch.isalpha() else [(c, toxicity.READ_COST) for c in toxicity.READ_AS.get(ch, "")]
        for c, extra in letters:
            yield from go(i + 1, word + c, cost + extra + chars.cost(a, b, c))
            if c == b and i and token[i - 1] == ch:
                yield from go(i + 1, word, cost + extra + toxicity.REPEAT_COST)
        if ch in toxicity.DROPPED or not letters:
            yield from go(i + 1, word, cost + toxicity.DROP_COST)

    return go(0, "", 0.0)


def test_restored_words_are_the_likeliest_of_all():
    words = Counter(w for _, t in corpus(200)[0] for w in t.lower().split())
    chars = toxicity.CharModel(words)
    rng = np.random.default_rng(5)
    letters = list("aehnot0134*|.-_@$e")
    for _ in range(300):
        token = "".join(rng.choice(letters, rng.integers(1, 9)))
        best = min(every_reading(token, chars))
        cost = {w: c for c, w in sorted(every_reading(token, chars), reverse=True)}[toxicity.restore(token, chars)]
        assert abs(cost - best[0]) < 1e-9, token


def test_fits_hold_little_on_the_driver(spark):
    sizes = [(-5, 4), (-1, 4), (0, 9), (3, 1), (7, 1)]
    assert list(quality.ranges(sizes, 8)) == [(-5, -1), (0, 0), (3, 7)] and list(quality.ranges([], 8)) == []
    rows = spark.createDataFrame([(3, 1, [7, 9], [0.5, 0.5]), (-2, 0, [], []), (1, 0, [4], [1.0])], "_key long, _label int, ids array<int>, shares array<float>")
    got = list(quality.arrived(rows))
    assert [(x.tolist(), y.tolist(), label) for (x, y), label in got] == [([], [], 0), ([4], [1.0], 0), ([7, 9], [0.5, 0.5], 1)]
    assert all(x.dtype == np.int32 and x.base is None for (x, _), _ in got)
    names = toxicity.shared_names(spark.createDataFrame([(["abcd", "bcde"],), (["bcde"],)], "n array<string>").toArrow()["n"])
    assert sorted(names, key=len) == [["bcde"], ["abcd", "bcde"]] and len({id(n) for ns in names for n in ns}) == 2


def plainly(text, chars):
    """The features of a text, each token looked at by itself."""
    text, found = text.lower(), set()
    for token in text.split() + ["".join(m.group().split()) for m in toxicity.SPACED.finditer(text)]:
        inner = re.sub(r"^[^\w@$]+|[\W_]+$", "", token)
        words = [w for w in re.split(r"[\W\d_]+", token) if w]
        if inner and (not inner.isalpha() or any(a == b for a, b in zip(inner, inner[1:]))):
            words.append(toxicity.restore(inner, chars))
        for w in words:
            found |= {w[:k] for k in (4, 5, 6, 7) if len(w) >= k} | ({"=" + w} if 2 < len(w) <= 24 else set())
    return found


def test_tokens_that_hide_nothing_cost_nothing(monkeypatch):
    """Features, their counts and scores are those of every token looked at by itself, though most tokens aren't."""
    rng = np.random.default_rng(2)
    letters = list("abehnoooст漢ß²½01.-_@$*|,\t\n" + " " * 8)
    texts = ["".join(rng.choice(letters, rng.integers(0, 120))) for _ in range(400)] + [t for _, t in corpus(100)[0]]
    texts += ["", " ", "g r o b\ta  h", "a b", "a b c", "a\nb c", "x  y z!", "ab c d e f", "oo", "\ud800\ud800 oo", "--", "_a_ @@b$ $"]
    chars = toxicity.CharModel(Counter(w for t in texts for w in t.split()))
    by_token = [plainly(t, chars) for t in texts]
    scores = {n: float(rng.random()) for n in sorted(set().union(*by_token)) if rng.random() < 0.05}
    model = toxicity.Model(scores, chars, 0.01)
    assert [model.score(t) for t in texts] == [max([0.01, *(scores.get(n, 0.0) for n in f)]) for f in by_token]
    asked = []
    monkeypatch.setattr(toxicity, "core", lambda token: asked.append(token) or token)
    assert toxicity.Model({"=grobnak": 0.9, "zwel": 0.8}, chars, 0.01).score("the other grobnak was there") == 0.9 and asked == []
    monkeypatch.undo()
    tally, restored = toxicity.Tally(), toxicity.Restored(chars)
    for t in texts:
        tally.add(toxicity.restored_words(t, restored))
    assert tally.counts() == Counter(n for f in by_token for n in f)


def test_features_of_few_toxic_texts_are_held_at_a_time():
    """A batch's toxic texts are tallied in parts of bounded size: their features take many times the memory of their texts."""
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" * 40 for j in range(40)) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * len(texts)), pa.array(texts)], names=["label", "text"])
    made = [b for b in toxicity.tallied(iter([batch]), toxicity.CharModel(Counter())) if b.num_rows]
    assert sum(b.num_rows for b in made) == len(texts)
    assert len(made) == -(-sum(map(len, texts)) // common.AT_ONCE)
