"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

The pieces are those of a public SentencePiece model. Its scores are ranks of merges; a piece of rank r counts as log probability -ln(r + 2.7), as by
Zipf's law. The model's mark stands for a blank; characters that no piece covers, and the mark itself where a text holds it, go as byte
pieces. A unit is a blank with what follows up to the next blank. Forward probabilities are filtered once for each distinct unit; segmentations of
all occurrences are then drawn backwards together.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table

MARK = "▁"
#: Lattice nodes, one a character of a distinct unit, that are remembered at a time; the longest piece that is looked for.
REMEMBERED, LONGEST = 3_000_000, 16
ZIPF = 2.7


def _hashes(chars: np.ndarray) -> np.ndarray:
    """Running hashes of the prefixes of concatenated strings: one more than there are characters."""
    out = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * _powers(len(chars)), out=out[1:])
    return out


_STEP = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, step: int = _STEP) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), np.uint64(step))]))[:n]


class Pieces:
    """The vocabulary: ids of texts, log probabilities, byte pieces, and what each id decodes to."""

    def __init__(self, model_path: str | None = None) -> None:
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path or public_tokenizers.path("piece_bpe_32k.model"))
        self.ids: dict[str, tuple[int, float]] = {}
        self.bytes, self.text = np.zeros(256, np.int64), []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes[value] = i
                self.text.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"")
            else:
                piece = piece.replace(MARK, " ")
                self.text.append(piece.encode())
                if " " not in piece[1:]:  # no piece of a unit goes over a blank
                    self.ids[piece] = (i, -math.log(-min(sp.get_score(i), 0) + ZIPF))
        # Hashes of all pieces and of all their beginnings, in order, to look up many substrings at once.
        begins = {p[:n]: self.ids.get(p[:n], (-1, 0.0)) for p in self.ids for n in range(1, len(p) + 1)}
        chars = np.array([[ord(c) + 1 for c in p.ljust(LONGEST, "\0")] for p in begins if len(p) <= LONGEST], np.uint64)
        sizes = np.array([len(p) for p in begins if len(p) <= LONGEST])
        weights = np.where(np.arange(LONGEST)[None] < sizes[:, None], _powers(LONGEST)[None], np.uint64(0))
        found = (chars * weights).sum(1, dtype=np.uint64)
        order = np.argsort(found)
        self.hash = found[order]
        assert (np.diff(self.hash.view(np.int64)) != 0).all(), "two pieces have one hash"
        values = [v for p, v in begins.items() if len(p) <= LONGEST]
        self.id_of, self.weight = np.array([v[0] for v in values])[order], np.array([v[1] for v in values])[order]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))


class Lattices(dict):
    """unit -> its last node. A node stands for the place after a character of a unit; its ways in are edges, side by side from entry[node] on, the
    longest pieces first, with cumulative shares that end with 1: the first over a number drawn in [0, 1) is the edge that it stands for. An edge has
    a piece's id, or the negative of a character that goes as bytes, and the node that it comes from, -1 at a unit's beginning."""

    def __init__(self, pieces: Pieces, power: float) -> None:
        super().__init__()
        self.pieces, self.power = pieces, power
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.nodes, self.entry, self.upto, self.piece, self.source = 0, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def add(self, units: list[str]) -> None:
        """Forward filtering over units that are new, all at once: first all edges, then sums place after place."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        text = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n, first = len(text), np.cumsum(sizes) - sizes
        start = np.repeat(first, sizes)
        left = np.repeat(sizes, sizes) - (np.arange(n) - start)  # characters up to the unit's end
        sums = _hashes(text)
        inverse = _powers(n, pow(_STEP, -1, 1 << 64))
        at, froms, tos, ids, logs = np.arange(n), [], [], [], []
        single = np.zeros(n, bool)
        for size in range(1, LONGEST + 1):
            at = at[left[at] >= size]
            part = (sums[at + size] - sums[at]) * inverse[at]
            k = np.minimum(np.searchsorted(self.pieces.hash, part), len(self.pieces.hash) - 1)
            hit = self.pieces.hash[k] == part
            at, k = at[hit], k[hit]
            whole = self.pieces.id_of[k] >= 0
            froms.append(at[whole])
            tos.append(at[whole] + size - 1)
            ids.append(self.pieces.id_of[k][whole])
            logs.append(self.pieces.weight[k][whole] * self.power)
            if size == 1:
                single[at[whole]] = True
            if not len(at):
                break
        bare = np.flatnonzero(~single)  # characters that are no piece: bytes
        c = text[bare]
        octets = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        froms.append(bare)
        tos.append(bare)
        ids.append(np.where(c > 0x7F, -c, self.pieces.bytes[np.minimum(c, 0x7F)]))
        logs.append(-self.power * math.log(len(self.pieces.ids) + ZIPF) * octets)
        frm, to, piece, log = (np.concatenate(x) for x in (froms, tos, ids, logs))
        # Edges by the place in their unit where they end, then by node: a place's nodes need only those of earlier places.
        place = to - start[to]
        order = np.argsort((place * n + to) * LONGEST - (to - frm))
        frm, to, piece, log, place = (x[order] for x in (frm, to, piece, log, place))
        total, share = np.zeros(n), np.empty(len(to))
        cuts = np.searchsorted(place, np.arange(int(sizes.max(initial=0)) + 1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            f, t = frm[a:b], to[a:b]
            value = log[a:b] + np.where(f > start[f], total[f - 1], 0.0)
            heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            width = np.diff(np.append(heads, len(t)))
            top = np.maximum.reduceat(value, heads)
            e = np.exp(value - np.repeat(top, width))
            whole = np.add.reduceat(e, heads)
            total[t[heads]] = top + np.log(whole)
            upto = e / np.repeat(whole, width)  # summed within each node alone: what else is in the batch changes no digit
            at, more = heads, width
            for r in range(1, int(width.max(initial=0))):
                at, more = at[more > r], more[more > r]
                upto[at + r] += upto[at + r - 1]
            upto[np.append(heads[1:], len(t)) - 1] = 1.0
            share[a:b] = np.minimum(upto, 1.0)
        back = np.argsort(to * LONGEST - (to - frm))
        frm, to = frm[back], to[back]
        base = self.nodes
        self.entry = np.concatenate([self.entry, len(self.upto) + np.searchsorted(to, np.arange(n))])
        self.upto = np.concatenate([self.upto, share[back]])
        self.piece = np.concatenate([self.piece, piece[back].astype(np.int32)])
        self.source = np.concatenate([self.source, np.where(frm > start[frm], base + frm - 1, -1)])
        self.nodes += n
        self.update(zip(units, (base + first + sizes - 1).tolist()))


def units(text: str) -> list[str]:
    """A text's units: its parts between blanks, each but the first with the blank before it."""
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + p for p in rest]


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit keys."""
    with np.errstate(over="ignore"):
        x = key + np.uint64((0x9E3779B97F4A7C15 * (step + 1)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def draw(texts: list[str], seeds: list[int], lattices: Lattices) -> list[np.ndarray]:
    """The sampled ids of each text. A text's draws depend on its seed and on its own units alone."""
    if lattices.nodes > REMEMBERED:
        lattices.reset()
    parts = [units(t) for t in texts]
    every = list(chain.from_iterable(parts))
    if new := [u for u in dict.fromkeys(every) if u not in lattices]:
        lattices.add(new)
    ends = np.fromiter(map(lattices.__getitem__, every), np.int64, len(every))
    n, size = len(ends), np.array(list(map(len, parts)), np.int64)
    first = np.cumsum(size) - size
    within = (np.arange(n) - np.repeat(first, size)).astype(np.uint64)
    key = (np.repeat(np.array(seeds, np.uint64), size) ^ (within * np.uint64(0xD1B54A32D192ED03))) * np.uint64(0x2545F4914F6CDD1D)
    at, live = ends, np.arange(n)
    steps, length = [], np.zeros(n, np.int64)
    while len(live):
        edge = lattices.entry[at]
        drawn = _uniform(key[live], len(steps))
        over = np.arange(len(edge))
        while len(over := over[lattices.upto[edge[over]] <= drawn[over]]):
            edge[over] += 1
        steps.append((live, lattices.piece[edge]))
        length[live] += 1
        at = lattices.source[edge]
        on = at >= 0
        live, at = live[on], at[on]
    start = np.cumsum(length) - length
    out = np.empty(int(length.sum()), np.int64)
    for k, (who, what) in enumerate(steps):
        out[start[who] + length[who] - 1 - k] = what
    cuts = np.concatenate([start, [len(out)]])
    drawn = [out[cuts[f] : cuts[f + s]] for f, s in zip(first.tolist(), size.tolist())]
    if (out < 0).any():  # characters that go as bytes
        octets = lattices.pieces.bytes
        drawn = [np.array([i for x in d.tolist() for i in ([x] if x >= 0 else octets[list(chr(-x).encode())].tolist())], np.int64) if (d < 0).any() else d for d in drawn]
    return [d.astype(np.int32) for d in drawn]


#: Characters of text that are drawn at a time.
AT_ONCE = 2_000_000


def sample_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", power: float = 1.0, seed: int = 0, model_path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, n_pieces, ids_crc32 (of little-endian 32-bit ids), lossless (whether the ids decode to the text).

    Segmentations are drawn in proportion to the product of their pieces' probabilities to `power`; the draw depends on seed, doc_id and text alone,
    so that it is the same wherever and however often a row is worked on. Null and empty texts have no ids. Rows of null id are drawn as of
    id -1. Repeated rows get equal ids. An empty table gives an empty result. Other columns are left out.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model_path)
        lattices = Lattices(pieces, power)
        names = ["doc_id", "ids", "n_pieces", "ids_crc32", "lossless"]
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            i = 0
            while i < len(texts):
                j, total = i, 0
                while j < len(texts) and (j == i or total + len(texts[j]) <= AT_ONCE):
                    total += len(texts[j])
                    j += 1
                seeds = [zlib.crc32(b"%d %d" % (seed, -1 if k is None else k)) * 0x9E3779B1 + (k or 0) & (1 << 64) - 1 for k in keys[i:j]]
                drawn = draw(texts[i:j], seeds, lattices)
                same = [pieces.decode(d.tolist()) == t.encode() for d, t in zip(drawn, texts[i:j])]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(d) for d in drawn])]), pa.int32()), pa.array(np.concatenate(drawn) if drawn else [], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array([len(d) for d in drawn], pa.int64()), pa.array([zlib.crc32(np.ascontiguousarray(d, "<i4").tobytes()) for d in drawn], pa.int64()), pa.array(same)], names=names)
                i = j

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(go, "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, lossless boolean")


def decoded(ids: str, model_path: str | None = None) -> Column:
    """The text that a column of ids stands for, whatever segmentation they are; null for null, empty for no ids. Ids that the model lacks are an error."""

    @F.pandas_udf("string")
    def decode(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(model_path)
        for s in lists:
            yield pd.Series([None if x is None else pieces.decode(x.tolist()).decode() for x in s], dtype=object)

    return decode(F.col(ids))


def decode_pieces(rows: DataFrame, ids: str = "ids", text: str = "text", model_path: str | None = None) -> DataFrame:
    """The rows with their decoded text in column `text`, which replaces one of that name. All rows and other columns stay as they are."""
    return rows.withColumn(text, decoded(ids, model_path))


def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_pieces(table(spark, sf_dir, "documents"))
