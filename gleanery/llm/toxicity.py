"""Toxicity through a noisy channel: tokens are restored by a Viterbi search under a character model, then restored words are scored."""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import all_labelled_texts, crc32_of_id, discard, slices, table, written

#: Length of the word beginnings that are features besides whole words.
STEMS = (4, 5, 6, 7)
#: Scores of tokens that are remembered at a time; longest word that is a feature as a whole, or that the character model learns from.
REMEMBERED, LONGEST = 300_000, 24
#: The score of a text without any toxic feature.
FLOOR = 0.01
#: A clean document with a feature weighs against so many toxic ones.
AGAINST = 3
# What a character may stand for, with the channel's cost in nats. Letters stand for themselves at no cost.
READ_AS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
READ_COST, DROP_COST, REPEAT_COST = 1.0, 1.5, 0.3
DROPPED = set(".-_*~'`^,:;/\\")
#: Single characters set apart by spaces, three or more of them.
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S){2,}(?!\S)")
#: What is in each of these, and sooner searched for: the second and the third character.
TWO_SPACED = re.compile(r"[ \t]\S[ \t]+\S(?!\S)")


def trigrams(words: dict[str, int]) -> Counter:
    out: Counter = Counter()
    for word, n in words.items():
        for abc in zip("^^" + word, "^" + word, word + "$"):
            out[abc] += n
    return out


class CharModel:
    """A smoothed character trigram model of words."""

    def __init__(self, words: Counter, tri: Counter | None = None) -> None:
        """From words, or from counts of what they have of three characters running, ^ before and $ after them."""
        self.tri, self.bi = trigrams(words) if tri is None else tri, Counter()
        for (a, b, _), n in self.tri.items():
            self.bi[a, b] += n
        self.size = len({c for *_, c in self.tri}) + 1 + (not self.tri)  # $ is among them, ^ is not
        self.known: dict[tuple[str, str, str], float] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        if (found := self.known.get((a, b, c))) is None:
            found = -math.log((self.tri.get((a, b, c), 0) + 0.1) / (self.bi.get((a, b), 0) + 0.1 * self.size))
            if len(self.known) < REMEMBERED:
                self.known[a, b, c] = found
        return found


DOUBLED = re.compile(r"([^\W\d_])\1")
LETTERS = re.compile(r"[^\W\d_]+")


def core(token: str) -> str:
    """A token without the punctuation around it; a leading @ or $ may stand for a letter and stays."""
    i, j = 0, len(token)
    while i < j and not (token[i].isalnum() or token[i] in "_@$"):
        i += 1
    while j > i and not token[j - 1].isalnum():
        j -= 1
    return token[i:j]


def odd(word: str) -> bool:
    """Whether a token's core may hide a word: it has something other than letters, or a letter twice running."""
    return word != "" and (not word.isalpha() or DOUBLED.search(word) is not None)


def restore(token: str, model: CharModel) -> str:
    """The likeliest word behind a token, up to one letter more than LONGEST: each character is read as a letter, taken as the one before it held
    on to, or dropped as a separator. No state is pruned, and the time is linear in the token's length."""
    # best[(last two letters)] = (cost, word)
    best: dict[tuple[str, str], tuple[float, str]] = {("^", "^"): (0.0, "")}
    known, cost_of, before = model.known, model.cost, ""
    for ch in token:
        letters = ((ch, 0.0),) if ch.isalpha() else [(c, READ_COST) for c in READ_AS.get(ch, "")]
        drop, again = ch in DROPPED or not letters, ch == before
        after: dict[tuple[str, str], tuple[float, str]] = {}
        for (a, b), (cost, word) in best.items():
            for c, extra in letters:
                if (step := known.get((a, b, c))) is None:
                    step = cost_of(a, b, c)
                offer = (cost + extra + step, word + c if len(word) <= LONGEST else word)
                if (had := after.get((b, c))) is None or offer < had:
                    after[b, c] = offer
                if again and c == b:
                    offer = (cost + extra + REPEAT_COST, word)
                    if (had := after.get((a, b))) is None or offer < had:
                        after[a, b] = offer
            if drop:
                offer = (cost + DROP_COST, word)
                if (had := after.get((a, b))) is None or offer < had:
                    after[a, b] = offer
        best, before = after, ch
    return min((cost + model.cost(a, b, "$"), word) for (a, b), (cost, word) in best.items())[1]


def plain(tokens: Iterable[str]) -> set[str]:
    """The runs of letters of tokens as they stand."""
    return set(LETTERS.findall(" ".join(tokens)))


def names(word: str) -> list[str]:
    """Features of a restored word: itself, if not too long, and its beginnings."""
    found = [word[:k] for k in STEMS if len(word) >= k]
    if 2 < len(word) <= LONGEST:
        found.append("=" + word)
    return found


def hidden(token: str, chars: CharModel) -> str:
    """The word restored from a token if it may hide one, else an empty one."""
    inner = token if token.isalpha() else core(token)
    return restore(inner, chars) if odd(inner) else ""


class Restored(dict):
    """token -> hidden(token)."""

    def __init__(self, chars: CharModel) -> None:
        super().__init__()
        self.chars = chars

    def __missing__(self, token: str) -> str:
        if len(self) >= REMEMBERED:
            self.clear()
        word = self[token] = hidden(token, self.chars)
        return word


def may_hide(tokens: Iterable[str]) -> list[str]:
    """Of tokens those that may hide a word, and some that don't: with another character than letters, or a character twice running."""
    found, letters = [], []
    for t in tokens:
        (letters if t.isalpha() else found).append(t)
    line = np.frombuffer(" ".join(letters).encode("utf-32-le", "surrogatepass"), np.uint32)
    twice = np.flatnonzero(line[1:] == line[:-1])
    found += [letters[i] for i in np.unique(np.searchsorted(np.flatnonzero(line == ord(" ")), twice)).tolist()]
    return found


def restored_words(text: str, restored: Restored) -> set[str]:
    """The words of a whole text's tokens as they stand, and those restored from tokens that may hide one."""
    tokens = words_of(text)
    words = plain(tokens)
    words.update(map(restored.__getitem__, may_hide(tokens)))
    return words


class Tally:
    """How many documents have each feature. Features are numbered, so that those of a word seen before are not made again."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.of: dict[str, array] = {}
        self.n = np.zeros(1024, np.int64)

    def add(self, words: set[str]) -> None:
        """Counts one document of these words."""
        found = array("q")
        for word in words:
            if (mine := self.of.get(word)) is None:
                mine = self.of[word] = array("q", [self.numbers.setdefault(n, len(self.numbers)) for n in names(word)])
            found += mine
        if len(self.numbers) > len(self.n):
            self.n = np.concatenate([self.n, np.zeros(len(self.numbers), np.int64)])
        self.n[np.frombuffer(found, np.int64)] += 1  # a number that is repeated here counts once

    def counts(self) -> dict[str, int]:
        return dict(zip(self.numbers, self.n[: len(self.numbers)].tolist()))


def words_of(text: str) -> set[str]:
    """The distinct tokens of a whole text, lower case, with words put back together whose characters stood apart."""
    text = text.lower()
    tokens = set(text.split())
    if TWO_SPACED.search(text):
        tokens.update("".join(m.group().split()) for m in SPACED.finditer(text))
    return tokens


class Model(dict):
    """token -> score. A text scores as its worst token; a token as its surest feature, restored."""

    def __init__(self, scores: dict[str, float], chars: CharModel, floor: float) -> None:
        super().__init__()
        self.scores, self.chars, self.floor = scores, chars, floor
        self.heads = {n.removeprefix("=")[: STEMS[0]] for n in scores}  # what a word with a scored feature begins with

    def __reduce__(self):
        return Model, (self.scores, self.chars, self.floor)

    def __missing__(self, token: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        words = [token] if token.isalpha() else LETTERS.findall(token)
        words = [w for w in (*words, hidden(token, self.chars)) if w[: STEMS[0]] in self.heads]
        score = self[token] = max((self.scores.get(n, 0.0) for w in words for n in names(w)), default=0.0)
        return score

    def score(self, text: str) -> float:
        tokens, heads, k = words_of(text), self.heads, STEMS[0]
        asked = may_hide(tokens) + [t for t in tokens if t[:k] in heads]  # all others have no scored feature
        return max(self.floor, max(map(self.__getitem__, asked), default=0.0))

    def column(self, text: Column) -> Column:
        model = self

        @F.arrow_udf("double")
        def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for s in texts:
                parts = slices(pa.RecordBatch.from_arrays([s], names=["text"]), 0)  # Python's strings of a few texts at a time
                yield pa.array([model.score(t or "") for part in parts for t in part.column(0).to_pylist()], pa.float64())

        return score(text)


def support_of(toxic: int, docs: int, features: int) -> int:
    """So many toxic documents a feature must have: more than chance would give to any of all features."""
    rate = min(0.9, max(toxic / max(docs, 1), 1e-6))
    return max(3, math.ceil(math.log(features + 1) / -math.log(rate)))


def surest(documents: dict[tuple[str, ...], int], clean: dict[str, int], support: int) -> dict[str, float]:
    """Scores of the features that explain the toxic documents, given as their features and how many documents have these and no others.

    Feature after feature is chosen: the one with the most toxic documents not explained yet, AGAINST taken off for each clean document that has
    it. Words that merely stand beside a toxic one, as in copies of a toxic text, are so left with no document to explain. A feature must have
    `support`. Its score is the lower bound (Wilson, one deviation) of its toxic share.
    """
    holders: dict[str, list[int]] = {}
    sizes = list(documents.values())
    for i, names_ in enumerate(documents):
        for name in names_:
            holders.setdefault(name, []).append(i)
    total = {n: sum(sizes[i] for i in h) for n, h in holders.items()}
    gain = {n: t - AGAINST * clean.get(n, 0) for n, t in total.items()}
    gain = {n: g for n, g in gain.items() if g >= support}
    explained, out = set(), {}
    heap = [(-g, len(n), n) for n, g in gain.items()]
    heapq.heapify(heap)
    while heap:
        was, _, name = heapq.heappop(heap)
        now = sum(sizes[i] for i in holders[name] if i not in explained) - AGAINST * clean.get(name, 0)
        if now < support:
            continue
        if now < -was:  # gains only fall: the heap's top is best if it is up to date
            heapq.heappush(heap, (-now, len(name), name))
            continue
        explained.update(holders[name])
        t, n = total[name], total[name] + clean.get(name, 0)
        p = t / n
        out[name] = (p + 1 / (2 * n) - math.sqrt(p * (1 - p) / n + 1 / (4 * n * n))) / (1 + 1 / n)
    return out


def shared_names(lists: pa.ChunkedArray) -> list[list[str]]:
    """The lists of strings, each different string one object, so that a feature takes no more memory in many documents than in one."""
    one: dict[str, str] = {}
    return [[one.setdefault(n, n) for n in names_.as_py() or ()] for names_ in lists]


def tallied(batches: Iterator[pa.RecordBatch], chars: CharModel) -> Iterator[pa.RecordBatch]:
    """(kind, name, n, names) from rows (label, text): toxic documents as they are; the number of clean ones; counts of clean documents by feature."""
    clean = Tally()
    types = (pa.int32(), pa.string(), pa.int64(), pa.list_(pa.string()))

    def made_of(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "name", "n", "names"])

    def counted(counts: dict[str, int]) -> pa.RecordBatch:
        return made_of([2] * len(counts), list(counts), list(counts.values()), [None] * len(counts))

    restored = Restored(chars)
    for batch in (part for whole in batches for part in slices(whole, 1)):  # a toxic text's features take many times its memory
        found, others = [], 0
        for toxic, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            mine = restored_words(body or "", restored)
            if toxic:
                found.append(sorted({n for w in mine for n in names(w)}))
            else:
                clean.add(mine)
                others += 1
        yield made_of([1] * len(found), [None] * len(found), [1] * len(found), found)
        if others:
            yield made_of([0], [None], [others], [None])
        if len(clean.numbers) > REMEMBERED:
            yield counted(clean.counts())
            clean = Tally()
    yield counted(clean.counts())


def fit(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on all labelled texts that all_labelled_texts() gives for `learn`, a condition on doc_id: see surest(). The character model is of the same
    texts' words as they stand, and restores their tokens too. The driver gets the counts of three characters running, and of the toxic documents
    no more than the features that can be chosen: those that have the support before any document is explained, for gains only fall. Ties among features go to the shorter name, then by letters. Without toxic
    rows every score is the floor."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of documents by word."""
        words: Counter = Counter()
        for batch in batches:
            for part in slices(batch, 1):
                for body in part.column(1).to_pylist():
                    words.update({w for w in plain(words_of(body or "")) if len(w) <= LONGEST})
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["name", "n"])

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts += trigrams(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
        yield pa.RecordBatch.from_arrays([pa.array(["".join(abc) for abc in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["abc", "n"])

    rows = all_labelled_texts(docs, labels, learn, doc_id, text, label).select("_label", "_text")
    words = rows.mapInArrow(spell, "name string, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1")
    seen = words.mapInArrow(triples, "abc string, n long").groupBy("abc").agg(F.sum("n").alias("n")).toArrow()
    chars = CharModel(Counter(), Counter({tuple(abc): n for abc, n in zip(seen["abc"].to_pylist(), seen["n"].to_pylist())}))
    del seen
    spelled = docs.sparkSession.sparkContext.broadcast((dict(chars.tri), dict(chars.bi), chars.size))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = CharModel(Counter())
        here.tri, here.bi, here.size = spelled.value
        return tallied(batches, here)

    made = written(rows.mapInArrow(collect, "kind int, name string, n long, names array<string>"))
    counts = made.where("kind = 2").groupBy("name").agg(F.sum("n").alias("n"))
    toxic = made.where("kind = 1").select(F.monotonically_increasing_id().alias("doc"), "names")
    # Features of three toxic documents or more are all that can be chosen.
    often = toxic.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("t")).where("t > 2")
    seen = written(often.join(counts, "name", "left").select("name", "t", F.coalesce("n", F.lit(0)).alias("n")))
    kinds = {r.kind: r.n for r in made.where("kind < 2").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    support = support_of(kinds.get(1, 0), sum(kinds.values()), seen.count())
    chosen = seen.where(F.col("t") - AGAINST * F.col("n") >= support)
    kept = toxic.select("doc", F.explode("names").alias("name")).join(chosen, "name").groupBy("doc").agg(F.array_sort(F.collect_list("name")).alias("names"))
    kept = kept.groupBy("names").agg(F.count("*").alias("n")).toArrow()
    documents = dict(sorted(zip(map(tuple, shared_names(kept["names"])), kept["n"].to_pylist())))
    clean = {r.name: r.n for r in chosen.select("name", "n").collect()}
    model = Model(surest(documents, clean, support), chars, FLOOR)
    del documents, kept, clean
    discard(made, seen)
    spelled.unpersist()
    pa.default_memory_pool().release_unused()
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(crc32_of_id(doc_id), F.lit(5)) == 0, F.lit(False))


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted. Null and empty texts score the floor; texts and tokens of any length are read whole; equal texts
    have equal scores. Null and repeated ids keep a row each (null: not held out). An empty table gives an empty result. Other columns are left
    out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), model.column(F.col(text)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_documents(docs, fit(docs, labels, ~held_out()))
