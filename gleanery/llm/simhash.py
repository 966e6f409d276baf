"""SimHash near duplicates, found through a Golay code.

A document's fingerprint is the majority of its shingles' 64-bit hashes, bit by bit. Fingerprints are cut into segments, each a word of the
(23, 12) Golay code; the indices of the codewords near a segment are its keys. Documents that share a key meet in one bucket, where their
fingerprints are compared.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import golay
from gleanery.llm.common import components, discard, slices, table, written

SEED = 42
#: Shingles that are hashed at a time, so that memory stays bounded on very long texts.
AT_ONCE = 1 << 16
#: Members from which a bucket is dealt out again by finer keys.
LARGE = 20_000


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits from each hash; k = 0 gives the hash itself."""
    if not k:
        return h
    h = h + np.uint64((0x9E3779B97F4A7C15 * k) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bit_sums(text: bytes, words: int, n64: int) -> tuple[np.ndarray, int]:
    """How many shingles have each bit set, most significant bit of the first 64 first, and how many shingles there are; repeats count each time."""
    sums, total = np.zeros(64 * n64, np.int64), 0
    tokens = text.lower().split()
    if not tokens:
        return sums, 0
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(tokens) > words:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    line = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    blocks = (
        np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[i : i + AT_ONCE].tolist(), ends[i : i + AT_ONCE].tolist())), np.uint64, len(starts[i : i + AT_ONCE]))
        for i in range(0, len(starts), AT_ONCE)
    )
    for h in blocks:
        total += len(h)
        for k in range(n64):
            octets = _mixed(h, k).byteswap().view(np.uint8).reshape(len(h), 8)
            sums[64 * k : 64 * k + 64] += np.unpackbits(octets, axis=1).sum(0, dtype=np.int32)
    return sums, total


def _packed(bits: np.ndarray) -> np.ndarray:
    """uint64[n, k] of bool[n, 64 * k], first bit most significant."""
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every whole text, as a signed long. Null and empty texts get 0. Other columns are left out."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, 64), bool)
            for i, body in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                sums, n = bit_sums(body or b"", words, 1)
                out[i] = 2 * sums > n
            fp = _packed(out)[:, 0].view(np.int64) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(make, "doc_id long, fp long")


# --- keys -------------------------------------------------------------------------------------------------------------

#: The 64 bits as three Golay words (from, to): two of 21 bits and one of 22.
SEGMENTS = ((0, 21), (21, 42), (42, 64))


def exact_keys(fps: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, whether it is the row's own key) so that any two fingerprints of at most three differing bits share a key that is one's own.

    Three bits over three segments: two of the segments differ in at most one bit each; either one in each, all three segments being alike in
    that, or one of the two in none. A word that differs in one bit from another has that one's codeword among those nearest to its own
    one-bit neighbours: a single codeword, or six where the word is three bits from its own. So segments 0 and 1 get all pairs of such
    codewords, and the other pairs of segments those in which one of the two is the segment's own.
    """
    n = len(fps)
    own, around = [], []
    for a, b in SEGMENTS:
        seg = ((fps >> np.uint64(64 - b)) & np.uint64((1 << (b - a)) - 1)).astype(np.int64)
        flips = np.concatenate([[0], 1 << np.arange(b - a)])
        near = np.sort(golay.nearest(seg[:, None] ^ flips[None, :], code), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near = -np.sort(-near, axis=1)[:, :6]  # a one-bit ball meets one or six codewords; padding bits change nothing in this
        own.append(golay.nearest(seg, code))
        around.append(near)
    rows, keys, marks = [], [], []

    def put(pair: int, x: np.ndarray, y: np.ndarray, mark: np.ndarray) -> None:
        ok = (x >= 0) & (y >= 0)
        r = np.broadcast_to(np.arange(n)[:, None], x.shape)
        rows.append(r[ok])
        keys.append(((np.int64(pair) << 24) | (x.astype(np.int64) << 12) | y)[ok])
        marks.append(np.broadcast_to(mark, x.shape)[ok])

    for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        x, y, ci, cj = around[i], around[j], own[i][:, None], own[j][:, None]
        if pair == 0:
            bx, by = np.repeat(x, 6, axis=1), np.tile(y, (1, 6))
            put(pair, bx, by, (bx == ci) & (by == cj))
        else:
            put(pair, x, np.broadcast_to(cj, x.shape), x == ci)
            other = np.where(y == cj, -1, y)
            put(pair, np.broadcast_to(ci, y.shape), other, np.zeros(y.shape, bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(marks)


def finer_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): any two fingerprints of at most three differing bits agree in three of six slices; a key is three slices' place and bits."""
    cuts = (0, 11, 22, 33, 43, 54, 64)
    slices = [((fps >> np.uint64(64 - b)) & np.uint64((1 << (b - a)) - 1)) for a, b in itertools.pairwise(cuts)]
    keys = []
    for place, three in enumerate(itertools.combinations(range(6), 3)):
        key = np.full(len(fps), place, np.uint64)
        for s in three:
            key = (key << np.uint64(11)) | slices[s]
        keys.append(key.view(np.int64))
    return np.tile(np.arange(len(fps)), len(keys)), np.concatenate(keys)


def forest(prints: np.ndarray, nodes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links of at most `most` differing bits connect within one bucket, without listing all its links.

    prints: uint64[n, k]. Breadth first: a member is compared with those not yet reached, each reached once, so memory is in proportion to n.
    """
    left, a, b = np.arange(len(nodes)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[at]).sum(1, dtype=np.int64) <= most
            found = left[near]
            a.append(np.full(len(found), nodes[at]))
            b.append(nodes[found])
            queue.extend(found.tolist())
            left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def shortest(prints: np.ndarray, nodes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, differing bits) of a shortest spanning forest of the links of at most `most` differing bits within one bucket: each member is joined
    to the nearest of those joined before it. Memory is in proportion to the members."""
    left, a, b, bits = np.arange(1, len(nodes)), [], [], []
    best, by, at = np.full(len(left), 1 << 30), np.zeros(len(left), np.int64), 0
    while len(left):
        d = np.bitwise_count(prints[left] ^ prints[at]).sum(1, dtype=np.int64)
        nearer = d < best
        best[nearer], by[nearer] = d[nearer], at
        i = int(np.argmin(best))
        at = int(left[i])
        if best[i] <= most:
            a.append(nodes[by[i]])
            b.append(nodes[at])
            bits.append(best[i])
        else:  # nothing left is near what is joined: a new tree
            best[:] = 1 << 30
        keep = np.arange(len(left)) != i
        left, best, by = left[keep], best[keep], by[keep]
    return np.array(a, np.int64), np.array(b, np.int64), np.array(bits, np.int64)


def _runs(batches: Iterator[pa.RecordBatch], large: int) -> Iterator[tuple[dict[str, np.ndarray], bool]]:
    """Cuts rows sorted by key into tables of whole buckets; a bucket of over `large` rows comes alone, in pieces marked True."""
    held: list[dict[str, np.ndarray]] = []
    deep = None

    def join(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    for batch in batches:
        t = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
        if not len(t["key"]):
            continue
        t = join([*held, t]) if held else t
        held = []
        last = int(np.searchsorted(t["key"], t["key"][-1], "left"))  # from here on the bucket may go on
        if last:
            head = {k: v[:last] for k, v in t.items()}
            if deep is not None:
                stop = int(np.searchsorted(head["key"], deep, "right"))
                if stop:
                    yield {k: v[:stop] for k, v in head.items()}, True
                head, deep = {k: v[stop:] for k, v in head.items()}, None
            if len(head["key"]):
                yield head, False
        tail = {k: v[last:] for k, v in t.items()}
        if deep is not None or len(tail["key"]) > large:
            deep = tail["key"][0]
            yield tail, True
        else:
            held = [tail]
    if held:
        yield held[0], deep is not None and held[0]["key"][0] == deep


def _bucket_edges(t: dict[str, np.ndarray], most: int, names: list[str], need_own: bool, large: int, tree=forest) -> Iterator[tuple[np.ndarray, ...] | dict]:
    """Edges of all buckets of a table sorted by key; a bucket of over `large` members is given back as it is. tree: forest, or shortest, with
    which edges have their differing bits."""
    key = t["key"]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(cuts, len(key)))
    prints = np.stack([t[n] for n in names], axis=1).view(np.uint64)
    own = t["own"].astype(bool) if need_own else np.ones(len(key), bool)
    has = np.add.reduceat(own, cuts) > 0
    pairs = (sizes == 2) & has
    i = cuts[pairs]
    bits = np.bitwise_count(prints[i] ^ prints[i + 1]).sum(1, dtype=np.int64)
    near = bits <= most
    yield (t["node"][i[near]], t["node"][i[near] + 1], bits[near])[: 3 if tree is shortest else 2]
    for start, n in zip(cuts[(sizes > 2) & has].tolist(), sizes[(sizes > 2) & has].tolist()):
        if n > large:
            yield {k: v[start : start + n] for k, v in t.items()}
        else:
            yield tree(prints[start : start + n], t["node"][start : start + n], most)


def _meet(keyed: DataFrame, names: list[str], most: int, need_own: bool, large: int | None, tree=forest) -> DataFrame:
    """(a, b, bits, and the prints and key of members of buckets that are too large) from rows (key, node, prints..., own); bits: see shortest()."""
    prints, names = names, [*names, "key"]
    spill = ", ".join(f"{n} long" for n in names)
    limit = large or (1 << 62)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, whole in _runs(batches, limit):
            for found in [t] if whole else _bucket_edges(t, most, prints, need_own, limit, tree):
                if isinstance(found, dict):
                    none = pa.nulls(len(found["key"]), pa.int64())
                    cols = [pa.array(found["node"]), none, none, *(pa.array(found[n]) for n in names)]
                elif len(found[0]):
                    none = pa.nulls(len(found[0]), pa.int64())
                    cols = [pa.array(found[0]), pa.array(found[1]), pa.array(found[2]) if len(found) > 2 else none, *[none] * len(names)]
                else:
                    continue
                yield pa.RecordBatch.from_arrays(cols, names=["a", "b", "bits", *names])

    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(go, f"a long, b long, bits long, {spill}")


def links_of(nodes: DataFrame, large: int = LARGE, most: int = 3) -> DataFrame:
    """(a, b): edges between nodes (node, fp) that connect the same nodes as all pairs of fingerprints of at most three differing bits would.

    Buckets of over `large` members are dealt out again by twenty finer keys each, which is as exact.
    """
    if most > 3:
        raise ValueError("the keys are exact for up to three bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = golay.index_table()
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                node, fp = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                rows, keys, own = exact_keys(fp.view(np.uint64), code)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node[rows]), pa.array(fp[rows]), pa.array(own)], names=["key", "node", "fp", "own"])

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 65536):
                part = batch.slice(i, 65536)
                node, fp = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                rows, keys = finer_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node[rows]), pa.array(fp[rows])], names=["key", "node", "fp"])

    met = written(_meet(nodes.select("node", "fp").mapInArrow(spread, "key long, node long, fp long, own boolean"), ["fp"], most, True, large))
    edges = met.where("b is not null").select("a", "b")
    rest = met.where("b is null").select(F.col("a").alias("node"), "fp").distinct()
    if rest.isEmpty():
        return edges
    again = _meet(rest.mapInArrow(finer, "key long, node long, fp long"), ["fp"], most, False, None)
    return edges.union(again.select("a", "b"))


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, large: int = LARGE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links of at most three bits, itself included).

    Null and empty texts, and those of blanks, have fingerprint zero and link like any other. Rows with null doc_id get their fingerprint and a
    null component_id and link nothing. Repeated ids and rows are kept, each with its row. An empty table gives an empty result. Other columns
    are left out. Equal fingerprints are one node, named by the smallest id that has it, so that copies meet no bucket.
    """
    prints = written(fingerprints(docs, doc_id, text, words))
    nodes = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    parts = components(links_of(nodes, large))
    named = nodes.join(parts, "node", "left").select(F.col("fp").alias("k"), F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, prints.fp == named.k, "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def op1_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def _blocks_meet(members: DataFrame, names: list[str], most: int, block: int) -> DataFrame:
    """(a, b, bits): edges that connect what all links of at most `most` bits within each bucket connect, from rows (key, node, prints...) of large ones.

    Every two blocks of a bucket, of about `block` members each, are compared whole in a task of their own; nothing but the time of a bucket grows
    with its members' square. Where the buckets' pairs outnumber those of all their distinct members, these are taken as one bucket.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    alone = members.select("node", *names).distinct()
    of_keys, n = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0, alone.count()
    if of_keys > n * n:
        members = alone.withColumn("key", F.lit(0).cast("long"))
        sizes = members.groupBy("key").agg(F.count("*").alias("n"))
    cut = sizes.select(F.col("key").alias("of"), F.ceil(F.col("n") / F.lit(block)).cast("long").alias("m"))
    placed = members.join(cut, F.col("key") == F.col("of")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("m")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("j")
    both = placed.select("key", "m", "i", "node", *names, other).select("key", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "m", "node", *names).where("m = 1 or x != y").drop("m")

    def go(t: pa.Table) -> pa.Table:
        prints = np.stack([t[n].to_numpy() for n in names], axis=1).view(np.uint64)
        return pa.table(dict(zip(("a", "b", "bits"), map(pa.array, shortest(prints, t["node"].to_numpy(), most)))))

    return both.groupBy("key", "x", "y").applyInArrow(go, "a long, b long, bits long")


# --- near copies at a similarity, for the pipeline --------------------------------------------------------------------

#: 192 bits: eight Golay words of 23 bits; the words of a pair make one key.
WIDE = 3
WORD_PAIRS = ((0, 1), (2, 3), (4, 5))
#: Share of the bits by which candidates may agree less than texts of the wanted similarity do on average.
SPARE = 0.075
#: The least sure bits of a word, which are tried both ways, and the likeliest codeword pairs kept for a pair of words.
UNSURE, LIKELIEST = 4, 64
#: Bins that shingles are counted in to be put in order, and how many of them travel in one row.
BINS_LOG2, CHUNK = 20, 1 << 14
BIN_MASK = np.uint32((1 << BINS_LOG2) - 1)


def likely_keys(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) from float[n, 192] margins, whose signs are the bits.

    Bits that differ between near copies are nearly always bits of small margin. Each word is decoded with every choice of its UNSURE smallest
    margins; of the pairs of codewords so found the LIKELIEST by flipped margin are keys.
    """
    n = len(margins)
    rows, keys = [], []
    tries = np.arange(1 << UNSURE)
    chosen = ((tries[:, None] >> np.arange(UNSURE)) & 1).astype(np.int64)  # [tries, UNSURE]

    def decode(word: int) -> tuple[np.ndarray, np.ndarray]:
        m = margins[:, 23 * word : 23 * word + 23]
        bits = ((m > 0).astype(np.int64) << np.arange(23)).sum(1)
        weak = np.argsort(np.abs(m), axis=1, kind="stable")[:, :UNSURE]
        flips = (chosen[None] << weak[:, None, :]).sum(2)
        cost = (chosen[None] * np.take_along_axis(np.abs(m), weak, 1)[:, None, :]).sum(2)
        return golay.nearest(bits[:, None] ^ flips, code), cost

    for pair, (i, j) in enumerate(WORD_PAIRS):
        (x, cx), (y, cy) = decode(i), decode(j)
        both = (np.int64(pair) << 24) | (x[:, :, None] << 12) | y[:, None, :]
        cost = (cx[:, :, None] + cy[:, None, :]).reshape(n, -1)
        best = np.argpartition(cost, LIKELIEST - 1, axis=1)[:, :LIKELIEST]
        got = np.sort(np.take_along_axis(both.reshape(n, -1), best, 1), axis=1)
        new = np.concatenate([np.ones((n, 1), bool), got[:, 1:] != got[:, :-1]], axis=1)
        rows.append(np.broadcast_to(np.arange(n)[:, None], got.shape)[new])
        keys.append(got[new])
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order; a text of fewer words is one shingle, one of none has none."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(tokens) > words:
        starts, ends = starts[: len(tokens) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    line, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts)))


def _margins(h: np.ndarray) -> np.ndarray:
    """float[192]: by bit, how far the number of hashes that have it is from half of all."""
    sums = np.zeros(64 * WIDE, np.int64)
    for i in range(0, len(h), AT_ONCE):
        part = h[i : i + AT_ONCE]
        for k in range(WIDE):
            octets = _mixed(part, k).byteswap().view(np.uint8).reshape(len(part), 8)
            sums[64 * k : 64 * k + 64] += np.unpackbits(octets, axis=1).sum(0, dtype=np.int32)
    return (2.0 * sums - len(h)) / max(len(h), 1) ** 0.5


def similar(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose sets (node, hashes: binary of sorted distinct uint32) have a Jaccard similarity of at least `similarity`."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = both >= similarity * (len(x) + len(y) - both) - 1e-9
            yield batch.select([0, 1]).filter(pa.array(good))

    one = edges.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    both = one.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def shingle_counts(rows: DataFrame, words: int) -> np.ndarray:
    """int64[1 << BINS_LOG2]: how many texts of rows (text) have a shingle of each bin. It settles an order of shingles and nothing else."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << BINS_LOG2, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                for body in part.column(0).cast(pa.binary()).to_pylist():
                    bins, n = np.unique(short_hashes(shingle_hashes(body or b"", words)) & BIN_MASK, return_counts=True)
                    sums[bins] += n
        for i in range(0, len(sums), CHUNK):
            if sums[i : i + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK]), pa.array([pa.compress(sums[i : i + CHUNK].tobytes(), "zstd", asbytes=True)])], names=["chunk", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(pa.decompress(b.as_py(), CHUNK * 8, "zstd", asbytes=True), np.int64) for b in t["n"])
        return pa.table({"chunk": t["chunk"][:1], "n": pa.array([total.tobytes()], pa.binary())})

    sums = np.zeros(1 << BINS_LOG2, np.int64)
    for r in rows.mapInArrow(count, "chunk long, n binary").groupBy("chunk").applyInArrow(add, "chunk long, n binary").toArrow().to_pylist():  # the bins at most
        sums[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["n"], np.int64)
    return sums


def short_hashes(h: np.ndarray) -> np.ndarray:
    """The sorted distinct uint32 that a set of shingle hashes is compared by."""
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def prefix(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's hashes, those of the rarest bins first: two sets of at least that Jaccard similarity, which have that share of the larger
    one in common, share one of them."""
    n = len(hashes)
    if not n:
        return hashes
    k = n - int(np.ceil(similarity * n - 1e-6)) + 1
    order = (counts[hashes & BIN_MASK].astype(np.uint64) << np.uint64(32)) | hashes
    return np.sort(np.partition(order, k - 1)[:k]).astype(np.uint32)


def _met_in(t: dict[str, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, group, root) of the members of one bucket whose size and place of the shared hash allow the similarity to a member of another group.
    Members that such pairs, or groups, connect have the same root, the smallest of their groups; so no list of all pairs is made."""
    group, size, rest = t["group"], t["size"].astype(np.int64), t["size"].astype(np.int64) - t["at"]

    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        least = (similarity * (size[x, None] + size[None, y]) - 1e-6) / (1 + similarity)
        return (group[x, None] != group[None, y]) & (np.minimum(rest[x, None], rest[None, y]) >= least)

    n = len(group)
    step, every = max(1, (1 << 21) // n), np.arange(n)
    left = np.concatenate([every[i : i + step][alike(every[i : i + step], every).any(1)] for i in range(0, n, step)])
    met, root = left, np.zeros(n, np.int64)
    while len(left):
        ring, left, whole = left[:1], left[1:], [left[:1]]
        while len(ring) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(ring), step):
                x = ring[i : i + step]
                near |= (alike(x, left) | (group[x, None] == group[None, left])).any(0)
            ring, left = left[near], left[~near]
            whole.append(ring)
        whole = np.concatenate(whole)
        root[whole] = group[whole].min()
    return t["node"][met], group[met], root[met]


def _all_met_in(t: dict[str, np.ndarray], similarity: float) -> np.ndarray:
    """int64[3, n]: _met_in() over all buckets of a table sorted by key, each row once."""
    key, group = t["key"], t["group"]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(cuts, len(key)))
    low = np.minimum.reduceat(group, cuts)
    mixed = low != np.maximum.reduceat(group, cuts)
    i, size = cuts[mixed & (sizes == 2)], t["size"].astype(np.int64)
    rest = size - t["at"]
    ok = np.minimum(rest[i], rest[i + 1]) >= (similarity * (size[i] + size[i + 1]) - 1e-6) / (1 + similarity)
    i, root = i[ok], low[mixed & (sizes == 2)][ok]
    parts = [np.stack([t["node"][x], group[x], root]) for x in (i, i + 1)]
    more = mixed & (sizes > 2)
    parts += [np.stack(_met_in({k: v[start : start + n] for k, v in t.items()}, similarity)) for start, n in zip(cuts[more].tolist(), sizes[more].tolist())]
    return np.unique(np.concatenate(parts, axis=1), axis=1)


def prefix_mates(nodes: DataFrame, similarity: float, large: int = LARGE) -> DataFrame:
    """(node, group, root): the nodes (node, group, size, prefix) that share a hash of their prefixes with one of another group so that their sets can
    have the similarity (see prefix()); groups of which such nodes meet are connected over roots, which are groups. At most a row for each hash of
    a prefix, however many meet. Buckets of over `large` members are compared by pairs of blocks, each in a task of its own."""
    columns, out = ["key", "node", "group", "size", "at"], ["a", "of", "root"]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, whole in _runs(batches, large):
            large_ones = np.zeros(len(t["key"]), bool)
            if whole:
                large_ones[:] = True
            else:
                _, number, n = np.unique(t["key"], return_inverse=True, return_counts=True)
                large_ones = n[number] > large
            if not large_ones.all():
                met = _all_met_in({k: v[~large_ones] for k, v in t.items()}, similarity)
                yield pa.RecordBatch.from_arrays([*map(pa.array, met), *[pa.nulls(met.shape[1], pa.int64())] * 5], names=[*out, *columns])
            if large_ones.any():
                n = int(large_ones.sum())
                yield pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * 3, *(pa.array(t[c][large_ones]) for c in columns)], names=[*out, *columns])

    def compare(t: pa.Table) -> pa.Table:
        return pa.table(dict(zip(out, map(pa.array, _all_met_in({c: t[c].to_numpy() for c in columns}, similarity)))))

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select(F.posexplode("prefix").alias("at", "key"), "node", "group", "size").select(*(F.col(c).cast("long").alias(c) for c in columns))
    met = written(rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(go, ", ".join(f"{c} long" for c in [*out, *columns])))
    mates, members = met.where("a is not null").select(*out), met.where("a is null").select(*columns)
    if not members.isEmpty():
        cut = members.groupBy(F.col("key").alias("of")).agg(F.ceil(F.count("*") / F.lit(max(1, large // 2))).alias("m"))
        placed = members.join(cut, F.col("key") == F.col("of")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("m")))
        both = placed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).withColumn("x", F.least("i", "j")).withColumn("y", F.greatest("i", "j"))
        mates = mates.union(both.select(*columns, "x", "y").groupBy("key", "x", "y").applyInArrow(compare, ", ".join(f"{c} long" for c in out)))
    return mates.toDF("node", "group", "root")


#: Least number of bits that a set's hashes are counted in, even or odd, to tell how far two sets differ at least; larger sets have twice their size.
PARITIES = 1024
#: Nodes, and hashes of all of them, that a block of a set of mates has on average at most.
BLOCK, BLOCK_HASHES = 1000, 1 << 22


def _links_in(node: np.ndarray, group: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """(a, b): links of at least the similarity that connect the groups which all such links between these nodes connect; none within a group.

    Each pair of groups not yet one is compared, by sizes, then by parities (sets differ in at least as many hashes as parities), then whole.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    node, label, sets = node[order], np.unique(group[order], return_inverse=True)[1], [sets[i] for i in order]
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.searchsorted(similarity * size - 1e-6, size, "right")  # larger ones have no such share in common
    a, b, bits, start, odd = [], [], PARITIES // 2, 0, None
    for i in range(len(node) - 1):
        if odd is None or bits < 2 * size[i]:
            while odd is None or bits < 2 * size[i]:
                bits, odd = 2 * bits, ()
            start, last = i, int(ends[np.searchsorted(size, bits // 2, "right") - 1])  # all that those of these bits are compared with
            odd = np.stack([np.packbits((np.bincount(s & np.uint32(bits - 1), minlength=bits) & 1).astype(bool)) for s in sets[start:last]]).view(np.uint64)
        end = int(ends[i])
        j = np.arange(i + 1, max(end, i + 1))
        j = j[label[j] != label[i]]
        if not len(j):
            continue
        differ = np.bitwise_count(odd[j - start] ^ odd[i - start]).sum(1, dtype=np.int64)
        both = size[j] + size[i]
        near = differ <= both * (1 - similarity) / (1 + similarity) + 1e-6
        for k in j[near][np.argsort(differ[near], kind="stable")].tolist():
            if label[k] == label[i]:
                continue
            common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if common >= similarity * (size[i] + size[k] - common) - 1e-9:
                a.append(int(node[i]))
                b.append(int(node[k]))
                label[label == label[k]] = label[i]
    return a, b


def links_between(mates: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect what all pairs of at least the similarity connect, from mates (node, group, mates) and their sets (node, hashes: see
    similar()). Nodes of the same mates are compared in one task, or by pairs of blocks, so a set travels once for each block and not for each pair."""

    def go(t: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(v.as_buffer(), np.uint32) for v in t["hashes"]]
        a, b = _links_in(t["node"].to_numpy(), t["group"].to_numpy(), hashes, similarity)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = mates.join(sets.select(F.col("node").alias("n"), "hashes"), F.col("node") == F.col("n")).drop("n")
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(block), F.sum("size") / F.lit(BLOCK_HASHES))).cast("long")
    cut = mates.groupBy(F.col("mates").alias("of")).agg(blocks.alias("m")).where("m > 1")
    placed = rows.join(cut, F.col("mates") == F.col("of"), "left").withColumn("m", F.coalesce("m", F.lit(1).cast("long"))).withColumn("i", F.pmod(F.xxhash64("node"), F.col("m")))
    both = placed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1))).where("m = 1 or i != j")
    both = both.select("mates", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "node", "group", "hashes")
    return both.groupBy("mates", "x", "y").applyInArrow(go, "a long, b long")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, large: int = LARGE, row: str | None = None) -> DataFrame:
    """(row if named, doc_id, component_id, first): a row for each row of docs.

    Links join all texts whose sets of word shingles have a Jaccard similarity of at least `similarity`, checked on the sets. Candidates are texts whose
    192-bit SimHash agrees in nearly as many bits as such texts' do on average (SPARE fewer) and that share a key; within a key's bucket each
    text is paired with the nearest joined before it. First each text's nearest candidate is checked, then all that would join groups not
    yet one. What neither keys nor the nearest find is found exactly: pairs of groups not yet one that share a shingle of their prefixes, which
    two sets of that similarity always do, are checked as well. component_id is the smallest doc_id of the group that links connect; first marks one row of each group: that of smallest id (rows
    without an id last), then text, then row (a unique long; without it rows of equal id and text are all marked).

    Null and empty texts, and those of blanks, are copies of each other. Repeated ids are kept apart by their texts. Buckets of over `large`
    members are compared whole too, by pairs of blocks. An empty table gives an empty result. Other columns are left out.
    """
    names = [f"fp{k}" for k in range(WIDE)]
    cosine = 2 * similarity / (1 + similarity)  # of two sets of equal size
    most = int(64 * WIDE * (np.arccos(cosine) / np.pi + SPARE))
    key = F.col(row).cast("long") if row else F.lit(0).cast("long")
    rows = docs.select(key.alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(rows.select("text"), words))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = golay.index_table()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                margins, ids = np.zeros((part.num_rows, 64 * WIDE)), np.zeros((2, part.num_rows), np.uint64)
                sizes, firsts = np.zeros(part.num_rows, np.int32), []
                for r, body in enumerate(part.column(2).cast(pa.binary()).to_pylist()):
                    h = shingle_hashes(body or b"", words)
                    margins[r], ids[:, r] = _margins(h), (xxhash.xxh64_intdigest(h.tobytes()), xxhash.xxh64_intdigest(body or b""))
                    short = short_hashes(h)
                    sizes[r] = len(short)
                    firsts.append(prefix(short, counts.value, similarity).view(np.int32))
                prints = _packed(margins > 0).view(np.int64)
                rows, keys = likely_keys(margins, code)
                order = np.argsort(rows, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[order], np.arange(part.num_rows + 1)).astype(np.int32)), pa.array(keys[order].astype(np.int32)))
                columns = [*(pa.array(x.view(np.int64)) for x in ids), *(pa.array(np.ascontiguousarray(prints[:, k])) for k in range(WIDE)), lists, pa.array(sizes), pa.array(firsts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["row", "doc_id", "set", "body", *names, "keys", "size", "prefix"])

    made = written(rows.mapInArrow(make, f"row long, doc_id long, set long, body long, {', '.join(f'{n} long' for n in names)}, keys array<int>, size int, prefix array<int>"))
    counts.unpersist()
    # Equal sets are one node; its texts have the same fingerprint and keys. It is read again from the text of one of its rows.
    same = ["set", *names]
    nodes = made.groupBy(*same).agg(F.min(F.struct("doc_id", "row", "body")).alias("of"), *(F.first(c).alias(c) for c in ("keys", "size", "prefix")))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))
    keyed = nodes.select(F.explode(F.col("keys").cast("array<long>")).alias("key"), "node", *names)
    met = written(_meet(keyed, names, most, False, large, shortest))
    edges = met.where("b is not null").select("a", "b", "bits")
    rest = met.where("b is null").select("key", F.col("a").alias("node"), *names)
    if not rest.isEmpty():
        edges = edges.union(_blocks_meet(rest, names, most, max(1, large // 2)))
    edges = written(edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("bits").alias("bits")))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            found = [shingle_hashes(t or b"", words) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            sets = pa.array([short_hashes(h).tobytes() for h in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([xxhash.xxh64_intdigest(h.tobytes()) for h in found], pa.uint64()).view(pa.int64()), sets], names=["row", "doc_id", "set", "hashes"])

    def sets_of(some: DataFrame) -> DataFrame:
        """(node, hashes) of some nodes, each given once."""
        asked = some.join(nodes.select("node", "set", F.col("of.doc_id").alias("doc_id"), F.col("of.row").alias("row")), "node")
        texts = rows.join(asked.select(F.col("row").alias("r"), F.col("doc_id").alias("d")).distinct(), (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
        sets = texts.mapInArrow(hashes, "row long, doc_id long, set long, hashes binary").withColumnsRenamed({"row": "r", "doc_id": "d", "set": "s"})
        sets = sets.join(asked, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("set") == F.col("s")))
        return written(sets.groupBy("node").agg(F.first("hashes").alias("hashes")))

    # Each node's nearest candidate, then whatever else joins groups that aren't one yet.
    ends = edges.select("a", "b", F.explode(F.array("a", "b")).alias("node"), "bits")
    nearest = written(ends.groupBy("node").agg(F.min(F.struct("bits", "a", "b")).alias("e")).select("e.a", "e.b").distinct())
    sets = sets_of(nearest.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    links = written(similar(nearest, sets, similarity))
    label = written(components(links))
    grouped = nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("group"), "size", "prefix")
    alike = written(prefix_mates(grouped, similarity, large).distinct())
    connected = components(alike.select(F.col("group").alias("a"), F.col("root").alias("b")))
    mates = alike.select("node", "group").distinct().join(connected.select(F.col("node").alias("g"), "component"), F.col("group") == F.col("g"), "left")
    mates = written(mates.join(nodes.select(F.col("node").alias("n"), "size"), F.col("node") == F.col("n")).select("node", "group", F.coalesce("component", "group").alias("mates"), "size"))
    more = sets_of(mates.select("node"))
    label = components(links.union(links_between(mates, more, similarity)))
    named = nodes.join(label, "node", "left").select(*(F.col(n).alias(f"_{n}") for n in same), F.coalesce("component", "node").alias("group"))
    grouped = written(made.drop("keys", "size", "prefix").join(named, [made[n] == named[f"_{n}"] for n in same]).select("row", "doc_id", "body", "group"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "body", "row")
    firsts = grouped.groupBy(F.col("group").alias("g")).agg(F.min("doc_id").alias("component_id"), F.min(order).alias("order"))
    out = grouped.join(firsts, F.col("group") == F.col("g")).select("row", "doc_id", "component_id", (order == F.col("order")).alias("first"))
    discard(made, nodes, met, edges, nearest, sets, links, alike, mates, more)
    return out if row else out.drop("row")
