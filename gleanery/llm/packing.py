"""Bounded-space online packing of tokenised texts into sequences of a fixed length."""

from __future__ import annotations

import base64
import itertools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import table, written

END = struct.pack("<I", 0)
#: Texts' parts whose ids are remembered at a time.
REMEMBERED = 300_000
#: Parts of the input whose last windows are merged in one task: at most so many sequences.
MERGED = 256
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Unsafe(Exception):
    pass


class Ids(dict):
    """Token ids of texts, as little-endian uint32 bytes, by the byte-level BPE vocabulary of the public file byte_bpe_50k.

    That vocabulary never joins a text's parts across a space that follows a character that is no white space, so such parts are encoded
    once each and remembered. A text with a space after white space is encoded whole. The vocabulary's added token is cut out first, as it is one id
    wherever it stands. The ids equal those that the library tokenizers gives with the file byte_bpe_50k.json (tested); that library itself encodes
    what is too much for the faster one, as a million blanks running are.
    """

    def __init__(self, ranks_path: str | None = None, json_path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        with open(self.json_path) as f:
            self.added = {t["content"]: struct.pack("<I", t["id"]) for t in json.load(f)["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.slow = None
        self.bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bytes:
        try:
            ids = self.bpe.encode_ordinary(text)
        except BaseException as e:  # the fast library's own panic isn't an Exception
            if type(e).__name__ != "PanicException":
                raise
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.json_path)
            ids = self.slow.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, part: str) -> bytes:
        if not part or part[-1].isspace():
            raise _Unsafe
        if len(self) >= REMEMBERED:
            self.clear()
        self[part] = ids = self.plain(" " + part)
        return ids

    def of(self, text: str) -> bytes:
        if self.cut and self.cut.search(text):
            return b"".join(self.added[t] if t in self.added else self.ordinary(t) for t in self.cut.split(text) if t)
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        first, *parts = text.split(" ")
        if parts and first and first[-1].isspace():
            return self.plain(text)
        try:
            rest = b"".join(map(self.__getitem__, parts))
        except _Unsafe:
            return self.plain(text)
        return self.plain(first) + rest


class Window:
    """An open sequence: pieces (doc_id, start, ids, doc_tokens) in order."""

    def __init__(self) -> None:
        self.fill, self.pieces = 0, []

    def put(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        self.pieces.append((doc_id, start, ids, doc_tokens))
        self.fill += len(ids) // 4


class Packer:
    """Packs one document after the other. At most `windows` sequences are open.

    A text of over `length` tokens gives full sequences first. What is left goes where it fits best; where it fits nowhere and no further window
    may be opened, the fullest is emitted, first filled from what is left if over `slack` places are free in it.
    """

    def __init__(self, length: int, windows: int, slack: int, first_id: int) -> None:
        self.length, self.windows, self.slack, self.next_id = length, windows, slack, first_id
        self.open: list[Window] = []
        self.rows: list[tuple] = []

    def emit(self, window: Window) -> None:
        at = 0
        for doc_id, start, ids, total in window.pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, at))
            at += len(ids) // 4
        self.next_id += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.length:
            full = Window()
            full.put(doc_id, start, ids[4 * start : 4 * (start + self.length)], total)
            self.emit(full)
            start += self.length
        while start < total:
            size = total - start
            best = min((w for w in self.open if w.fill + size <= self.length), key=lambda w: self.length - w.fill, default=None)
            if best is None:
                if len(self.open) < self.windows:
                    self.open.append(best := Window())
                else:
                    fullest = max(self.open, key=lambda w: w.fill)
                    free = self.length - fullest.fill
                    if free > self.slack:
                        fullest.put(doc_id, start, ids[4 * start : 4 * (start + free)], total)
                        start += free
                    self.open.remove(fullest)
                    self.emit(fullest)
                    continue
            best.put(doc_id, start, ids[4 * start :], total)
            start = total
            if best.fill == self.length:
                self.open.remove(best)
                self.emit(best)

    def merge(self) -> Window | None:
        """Merges all open windows into full ones, cutting pieces where needed; what can't fill a sequence is returned."""
        queue = sorted(self.open, key=lambda w: -w.fill)
        self.open = []
        now = Window()
        for window in queue:
            for doc_id, start, ids, total in window.pieces:
                while ids:
                    take = ids[: 4 * (self.length - now.fill)]
                    now.put(doc_id, start, take, total)
                    start, ids = start + len(take) // 4, ids[len(take) :]
                    if now.fill == self.length:
                        self.emit(now)
                        now = Window()
        return now if now.pieces else None


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 1024, windows: int = 64, slack: int = 4, ranks_path: str | None = None, json_path: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then id 0; null and empty texts are that id alone. Every id lies in exactly one piece; a sequence's pieces
    follow each other without gaps. Each part of the input is packed on its own with at most `windows` open sequences; its last windows are
    merged to full sequences, and what then is left of all parts is merged once more, MERGED parts to a task. So of a group of MERGED parts one
    sequence is partly filled at most; all others lack at most `slack` tokens. Null ids, repeated ids and rows are packed as they come. An empty
    table gives no row. Other columns are left out. The packed parts are written before the merge, so that a lost executor changes no result.
    """
    numbers = [pa.int64()] * len(NAMES)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        packer, ids = Packer(length, windows, slack, here << 33), Ids(ranks_path, json_path)
        names, types = [*NAMES, "part", "ids"], [*numbers, pa.int64(), pa.binary()]
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packer.add(key, ids.of(body or "") + END)
            yield _batch([(*r, None, None) for r in packer.rows], types, names)
            packer.rows.clear()
        left = packer.merge()
        rows = [(*r, None, None) for r in packer.rows]
        rows += [(d, s, len(i) // 4, None, n, None, None, here, i) for d, s, i, n in (left.pieces if left else [])]
        yield _batch(rows, types, names)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["part"], r["doc_id"] is None, r["doc_id"], r["start"]))
        packer = Packer(length, 1, 0, 0)
        for group, those in itertools.groupby(rows, key=lambda r: r["part"] // MERGED):  # one group of parts after the other
            packer.next_id = (1 << 62) | (group << 20)
            window = Window()
            for r in those:
                window.put(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
            packer.open = [window]
            if left := packer.merge():
                packer.emit(left)
        yield _batch(packer.rows, numbers, NAMES)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    done = written(rows.mapInArrow(part, f"{PIECE}, part long, ids binary"))
    rest = done.where("part is not null").select(*NAMES, "part", "ids")
    merged = rest.repartition(F.expr(f"part div {MERGED}")).mapInArrow(last, PIECE)
    return done.where("part is null").select(*NAMES).union(merged)


def op2_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
