import numpy as np
import xxhash

from gleanery.llm import golay, simhash
from tests.llm.cases import ODD, docs_of, frame


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows):
    """[(doc_id, fingerprint, component)] by comparing all pairs."""
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    use = [i for i, (d, _) in enumerate(rows) if d is not None]
    for x in use:
        for y in use:
            if x < y and (prints[x] ^ prints[y]).bit_count() <= 3:
                root[find(x)] = find(y)
    least = {}
    for x in use:
        least[find(x)] = min(least.get(find(x), rows[x][0]), rows[x][0])
    return sorted(((d, f"{p:016x}", None if d is None else least[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def test_every_word_is_near_a_codeword():
    code = golay.index_table()
    words = np.arange(0, 1 << 23, 37)
    high = golay.nearest(words, code) << 11
    assert np.bitwise_count((high | golay._syndromes(high)) ^ words).max() == 3


def test_pairs_of_three_bits_share_an_own_key():
    rng = np.random.default_rng(3)
    code = golay.index_table()
    a = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
    (ra, ka, _), (rb, kb, ob) = simhash.exact_keys(a, code), simhash.exact_keys(b, code)
    assert {*range(5000)} == {r for r, _ in {*zip(ra.tolist(), ka.tolist())} & {*zip(rb[ob].tolist(), kb[ob].tolist())}}
    (ra, ka), (rb, kb) = simhash.finer_keys(a), simhash.finer_keys(b)
    assert {*range(5000)} == {r for r, _ in {*zip(ra.tolist(), ka.tolist())} & {*zip(rb.tolist(), kb.tolist())}}


def test_against_all_pairs(spark):
    rows = docs_of(spark) + [(i + 1000 if i is not None else None, t) for i, t in ODD]
    base = dict(docs_of(spark))[5]
    words = base.split()
    rows += [(2000 + i, " ".join(words[:i] + [f"w{i}"] + words[i + 1 :])) for i in range(0, 60, 3)]
    for large in (simhash.LARGE, 3):  # 3: buckets are dealt out again
        got = simhash.simhash_groups(frame(spark, rows), large=large).collect()
        assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == groups(rows)


def test_empty_table(spark):
    assert simhash.simhash_groups(frame(spark, [])).count() == 0
    assert simhash.near_copies(frame(spark, [])).count() == 0


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_copies(spark):
    docs = [(i, t) for i, t in docs_of(spark) if len(t.split()) > 60]
    rng = np.random.default_rng(0)
    rows, pairs = list(docs), []
    for i, t in docs[:120]:
        w = t.split()
        while True:  # changes single words for as long as five-word shingles stay alike
            c = w.copy()
            c[rng.integers(len(c))] = f"q{rng.integers(1e6)}"
            a, b = shingles(t), shingles(" ".join(c))
            if len(a & b) / len(a | b) < 0.8:
                break
            w = c
        rows += [(10_000 + i, " ".join(w)), (20_000 + i, t)]
        pairs += [(i, 10_000 + i), (i, 20_000 + i)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert np.mean([got[a] == got[b] for a, b in pairs]) > 0.97
    sets = {i: shingles(t) for i, t in docs}
    for i, t in docs:  # no group without a link of 0.8
        mates = [j for j in sets if j != i and got[j] == got[i]]
        assert not mates or max(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in mates) >= 0.8


def test_near_copies_of_odd_rows(spark):
    rows = ODD * 2
    for large in (simhash.LARGE, 2):
        got = [(r.doc_id, r.component_id) for r in simhash.near_copies(frame(spark, rows), large=large).collect()]
        assert len(got) == len(rows)
        assert {c for i, c in got if i in (1, 2, 3, 7)} == {1}
        assert {c for i, c in got if i is None} == {1, 5}
        assert {c for i, c in got if i in (5, 6)} == {5}


def test_large_buckets_lose_no_links(spark):
    """Pairs that differ in a bit or more of every 16 of the fingerprint, all in one large bucket, against all pairs."""
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 62, (400, simhash.WIDE)).astype(np.uint64)
    near = prints.copy()
    for k in range(simhash.WIDE):
        for at in (0, 16, 32, 48):
            near[:, k] ^= np.uint64(1) << (rng.integers(0, 16, 400) + at).astype(np.uint64)
    both = np.concatenate([prints, near])
    names = [f"fp{k}" for k in range(simhash.WIDE)]
    rows = [(key, node, *p) for key in (5, 6) for node, p in enumerate(both.view(np.int64).tolist())]
    members = spark.createDataFrame(rows, f"key long, node long, {', '.join(f'{n} long' for n in names)}")
    for frame_ in (members, members.where("key = 5 or node % 10 < 3")):
        got = {(min(r[:2]), max(r[:2])) for r in simhash._blocks_meet(frame_, names, 38, 60).collect()}
        assert got == {(i, i + 400) for i in range(400)}


def near_pairs(docs, seed):
    """Texts with a copy each of as many changed words as leave 0.8 of the five-word shingles alike."""
    rng, rows, pairs = np.random.default_rng(seed), [], []
    for i, t in docs:
        w = t.split()
        while True:
            c = w.copy()
            c[rng.integers(len(c))] = f"q{rng.integers(1e6)}"
            a, b = shingles(t), shingles(" ".join(c))
            if len(a & b) / len(a | b) < 0.8:
                break
            w = c
        rows += [(i, t), (10_000 + i, " ".join(w))]
        pairs.append((i, 10_000 + i))
    return rows, pairs


def test_large_buckets_link_as_small_ones_do(spark):
    rows, pairs = near_pairs([(i, t) for i, t in docs_of(spark) if 60 < len(t.split()) < 600][:120], 1)
    found = []
    for large in (simhash.LARGE, 3):
        got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows), large=large).collect()}
        found.append({p for p in pairs if got[p[0]] == got[p[1]]})
    print("near pairs alone", len(found[0]) / len(pairs), "with large buckets", len(found[1]) / len(pairs))
    assert found[0] <= found[1]


def test_no_link_is_left_out(spark):
    """Every pair of 0.8 or more is in one group, whether its fingerprints meet or not, and whatever the size of buckets."""
    for low, high, seed in ((60, 600, 1), (5, 60, 3)):
        rows, pairs = near_pairs([(i, t) for i, t in docs_of(spark) if low < len(t.split()) < high][:120], seed)
        sets = {i: shingles(t) for i, t in rows}
        pairs += [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        for large in (simhash.LARGE, 3):
            got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows), large=large).collect()}
            assert [p for p in pairs if got[p[0]] != got[p[1]]] == []


def test_short_near_copies(spark):
    """Texts of 9 to 40 words, whose copies lack their last or first word: 0.8 of the shingles or more are left."""
    rng = np.random.default_rng(2)
    rows, pairs = [], []
    for i in range(300):
        w = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(9, 41))]
        rows += [(i, " ".join(w)), (1000 + i, " ".join(w[:-1] if i % 2 else w[1:]))]
        pairs.append((i, 1000 + i))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()}
    found = np.mean([got[a] == got[b] for a, b in pairs])
    print("short near pairs", found)
    assert found > 0.9 and all(got[i] in (i, i - 1000) for i in got)


def test_similar_is_exact(spark):
    import struct

    sets = {i: list(range(i, i + 10)) for i in range(4)} | {9: []}
    rows = [(i, struct.pack(f"<{len(v)}I", *v)) for i, v in sets.items()]
    edges = [(a, b) for a in sets for b in sets if a < b]
    got = simhash.similar(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame(rows, "node long, hashes binary"), 0.8).collect()
    want = {(a, b) for a, b in edges if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})}
    assert {tuple(r) for r in got} == want and want


def rows_joined(spark, since):
    """The most rows that a join has made in the executions after number `since`, and the last execution's number."""
    store, most, last = spark._jsparkSession.sharedState().statusStore(), 0, since
    runs = store.executionsList().iterator()
    while runs.hasNext():
        number = runs.next().executionId()
        last = max(last, number)
        if number <= since:
            continue
        found, nodes = store.executionMetrics(number), store.planGraph(number).allNodes().iterator()
        while nodes.hasNext():
            node = nodes.next()
            if "Join" not in node.name():
                continue
            metrics = node.metrics().iterator()
            while metrics.hasNext():
                m = metrics.next()
                if m.name() == "number of output rows" and (v := found.get(m.accumulatorId())).isDefined():
                    most = max(most, int(v.get().replace(",", "")))
    return most, last


def test_rows_grow_with_a_group_and_not_with_its_pairs(spark):
    """Near copies of one text, most pairs of which are below 0.8, so that they aren't one group: twice the copies make no four times the rows."""
    rng, made = np.random.default_rng(5), []
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    for n in (100, 200):
        rows = []
        for i in range(n):
            w = base.copy()
            for _ in range(int(rng.integers(0, 16))):
                w[rng.integers(len(w))] = f"q{rng.integers(1e6)}"
            rows.append((i, " ".join(w)))
        since = rows_joined(spark, -1)[1]
        got = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows)).collect()}
        sets = {i: shingles(t) for i, t in rows}
        assert all(got[a] == got[b] for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
        assert 1 < len({*got.values()}) < n
        made.append(rows_joined(spark, since)[0])
    assert made[1] < 3 * made[0] and made[1] < 2000


def test_links_between_mates_connect_what_all_pairs_do(spark):
    """Sets of 0 to 3000 hashes, of whose pairs some are just below and some just above 0.8, in groups and alone."""
    rng = np.random.default_rng(6)
    for blocks in (False, False, False, True):
        sets = []
        for n in (0, 1, 8, 20, 150, 700, 3000):
            base = rng.integers(0, 1 << 32, n).astype(np.uint32)
            for _ in range(6):
                kept = base[rng.random(n) > 0.2 * rng.random()]
                sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 32, int(0.1 * rng.random() * n)).astype(np.uint32)])))
        node, group = rng.permutation(len(sets)), rng.integers(0, len(sets), len(sets))
        common = lambda x, y: len({*sets[x].tolist()} & {*sets[y].tolist()})
        want = {(x, y) for x in range(len(sets)) for y in range(x) if (c := common(x, y)) >= 0.8 * (len(sets[x]) + len(sets[y]) - c) - 1e-9}
        at = {int(v): i for i, v in enumerate(node)}
        if blocks:
            mates = spark.createDataFrame([(int(v), int(g), 7, len(x)) for v, g, x in zip(node, group, sets)], "node long, group long, mates long, size int")
            held = spark.createDataFrame([(int(v), x.tobytes()) for v, x in zip(node, sets)], "node long, hashes binary")
            found = [tuple(r) for r in simhash.links_between(mates, held, 0.8, block=12).collect()]
        else:
            found = list(zip(*simhash._links_in(node, group, sets, 0.8)))
        got = {(max(at[a], at[b]), min(at[a], at[b])) for a, b in found}

        def connected(links):
            label = group.copy()
            for x, y in links:
                label[label == label[x]] = label[y]
            return {(x, y) for x in range(len(sets)) for y in range(x) if label[x] == label[y]}

        assert got <= want and connected(got) == connected(want)
