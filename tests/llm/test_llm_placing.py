"""Virtual slots, residue products and the turn trie against plain versions."""

import hashlib
import random
import struct
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from srclens.llm import queries, residue_gemm, slots, turn_trie
from srclens.llm.common import shared_dir


# ---------------------------------------------------------------- slots
def _store(spark):
    return slots.MapStore(spark, f"{shared_dir(spark)}/maps-{uuid.uuid4().hex}")


def _hash(*values):
    """Spark's xxhash64 of longs and strings: each value's hash seeds the next, nulls are skipped."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v.encode(), seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def _deal(sizes, shards):
    """Slots dealt in turn, then edited: a shard keeps its largest up to the mean, the rest goes to the smallest."""
    mean, kept, loose = sum(sizes.values()) / shards, {}, []
    load = [0] * shards
    for shard in range(shards):
        upto = 0
        for slot in sorted(range(shard, slots.SLOTS, shards), key=lambda s: (-sizes.get(s, 0), s)):
            upto += sizes.get(slot, 0)
            if upto <= mean:
                kept[slot] = shard
                load[shard] += sizes.get(slot, 0)
            else:
                loose.append(slot)
    for slot in sorted(loose, key=lambda s: (-sizes.get(s, 0), s)):
        to = load.index(min(load))
        kept[slot], load[to] = to, load[to] + sizes.get(slot, 0)
    return kept


def _plain_slots(rows, shards):
    seen, found = Counter(), []
    for doc, text in rows:
        order = _hash(_hash(doc, text), seen[doc, text])
        seen[doc, text] += 1
        found.append((doc, len((text or "").encode()) + 1, zlib.crc32((text or "").encode()), order))
    sizes = Counter()
    for r in found:
        sizes[r[3] % slots.SLOTS] += r[1]
    to, out, nth = _deal(sizes, shards), [], Counter()
    for r in sorted(found, key=lambda r: (r[3] % slots.SLOTS, r[3])):
        shard = to[r[3] % slots.SLOTS]
        out.append((*r[:3], shard, nth[shard], r[3] % slots.SLOTS))
        nth[shard] += 1
    return sorted(out, key=str)


def test_slots_equal_plain_version(spark, prose, odd):
    for t in (prose, odd):
        rows = [(r.doc_id, r.text) for r in t.collect()]
        got = [tuple(r) for r in slots.assign(t.repartition(3), _store(spark), 16).collect()]
        assert sorted(got, key=str) == _plain_slots(rows, 16)


def test_slots_of_no_rows(spark, none):
    store = _store(spark)
    assert slots.assign(none, store, 4).count() == 0
    assert store.read(1).count() == slots.SLOTS


def test_copies_of_one_row_are_shared_out(spark):
    rows = [(7, "same text")] * 3000 + [(None, None)] * 50 + [(k, "x" * (k % 40)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    r = slots.assign(df, _store(spark), 16).collect()
    assert len(r) == len(rows)
    bytes_, places = Counter(), defaultdict(list)
    for x in r:
        bytes_[x.shard] += x["size"]
        places[x.shard].append(x.slot)
    assert max(bytes_.values()) - min(bytes_.values()) <= 100
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_a_very_long_text_is_one_record(spark):
    df = spark.createDataFrame([(1, "é" * 10_000_000), (2, "b")], "doc_id long, text string")
    got = {r.doc_id: r["size"] for r in slots.assign(df, _store(spark), 2).collect()}
    assert got == {1: 20_000_001, 2: 2}


def test_growth_moves_little_and_versions_stay(spark, prose):
    store = _store(spark)
    found = slots.records(prose)
    sizes = slots.slot_sizes(found).cache()
    slots.assign(prose, store, 8)
    store.edit(1, sizes, 9)
    was, now = ({r.slot: r.shard for r in store.read(v).collect()} for v in (1, 2))
    size = {r.slot: r["bytes"] for r in sizes.collect()}
    moved = [s for s in was if was[s] != now[s] and size[s]]
    assert set(now.values()) == set(range(9))
    total = sum(size.values())
    assert sum(size[s] for s in moved) <= total / 9 + 9 * max(size.values())
    store.edit(2, sizes, 5)
    assert set(r.shard for r in store.read(3).collect()) == set(range(5))
    with pytest.raises(Exception, match="(?i)exist"):
        store.edit(0, sizes, 5)


# ---------------------------------------------------------------- hard negatives
@pytest.mark.parametrize("most", [1, 77, 5000, 2**27])
def test_products_are_exact(most):
    rng = np.random.default_rng(most)
    a, b = rng.integers(-most, most + 1, (30, 200)), rng.integers(-most, most + 1, (40, 130))
    got = np.concatenate([s for _, s in residue_gemm.tiles(a, b)])
    assert (got == a[:, :130].astype(object) @ b.T.astype(object)).all()


def test_scores_that_may_not_fit_end_the_run():
    a = np.full((1, 8), (1 << 31) - 1)
    with pytest.raises(ValueError, match="2\\^63"):
        list(residue_gemm.tiles(a, a))


def _plain_negatives(rows, anchors, n_pos=5, n_neg=3, low=50, high=95):
    whole = []
    for i, e, label in rows:
        if e is not None and label is not None and all(x is not None and np.isfinite(x) for x in e):
            whole.append((i, [int(np.floor(256 * float(x))) for x in e], label))
    last = float("inf")
    out = []
    for a, (i, v, label) in enumerate(whole):
        if not anchors(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), last if j is None else j, m) for b, (j, w, m) in enumerate(whole) if b != a]
        for s, j in sorted((s, j) for s, j, m in scored if m == label)[:n_pos]:
            fit = sorted((t, k) for t, k, m in scored if m != label and low * -s <= 100 * -t <= high * -s)[:n_neg]
            out += [(i, None if j == last else j, n + 1, None if k == last else k, -s, -t) for n, (t, k) in enumerate(fit)]
    return sorted(out, key=str)


def _vectors(seed, n, dim=7):
    """Few levels, so scores tie; odd values; one label with a third of the rows; repeated rows and ids."""
    rng = random.Random(seed)
    rows = [(k % 90, [rng.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(dim)], rng.choice([0, 0, 1, 2, 3])) for k in range(n)]
    rows += rows[:20] + [(None, [1.0] * dim, 1), (None, [1.0] * dim, 0), (500, None, 1), (501, [1.0, None], 1), (502, [float("nan")], 0),
                         (503, [float("inf")] * dim, 0), (504, [], 1), (505, [1.0] * (dim + 3), 0), (506, [0.0] * dim, 2), (507, [1.0] * dim, None)]
    return rows


def test_negatives_equal_plain_version(spark, monkeypatch):
    rows = _vectors(1, 300)
    want = _plain_negatives(rows, lambda i: i is not None and i % 10 == 0)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, uid string, id int, rank int")
    for block in (8192, 64):
        monkeypatch.setattr(residue_gemm, "BLOCK", block)
        got = [tuple(r) for r in residue_gemm.mine(df.repartition(3), F.col("vec_id") % 10 == 0).collect()]
        assert sorted(got, key=str) == want and len(want) > 100


def test_negatives_when_partitions_are_not_coalesced(spark, monkeypatch):
    rows = _vectors(2, 200)
    want = _plain_negatives(rows, lambda i: i is not None and i % 10 == 0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(residue_gemm, "BLOCK", 64)
    was = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        got = [tuple(r) for r in residue_gemm.mine(df, F.col("vec_id") % 10 == 0).collect()]
    finally:
        spark.conf.set(conf, was)
    assert sorted(got, key=str) == want and len(want) > 100


def test_negatives_of_no_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert residue_gemm.mine(none, F.col("vec_id") % 50 == 0).count() == 0


# ---------------------------------------------------------------- turn trie
def _plain_trie(conv):
    nodes, ends, kids, below = defaultdict(list), defaultdict(list), defaultdict(list), {}
    for c, turns in conv.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    for n in nodes:
        if n:
            kids[n[:-1]].append(n)
    for n in sorted(nodes, key=len, reverse=True):
        size = len(n[-1][1].encode()) if n else 0
        below[n] = (sum(below[k][0] for k in kids[n]) or 1, (len(nodes[n]) - 1) * size + sum(below[k][1] for k in kids[n]))
    return sorted((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(kids[n]), *below[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in nodes.items())


def _turns(rows):
    conv = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}


def _rebuilt(conv):
    def h(c):
        return zlib.crc32(str(c).encode()) % 9
    return {c: conv.get(c - c % 5, [])[:h(c)] + turns[h(c):] for c, turns in conv.items()}


SCHEMA = "conv_id long, turn int, role string, text string, key string, node int"


def _random_turns(seed, convs, deep):
    """Few texts, so many prefixes meet; a system turn that most conversations share; one long conversation and many equal ones."""
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        rows.append((c, None if c % 3 else 0, "system", "be kind" if c % 4 else "é"))
        rows += [(c, t + 1, rng.choice(["user", None]), rng.choice(["a", "b", None, "éé", ""])) for t in range(rng.randrange(deep))]
    rows += [(convs, t, "user", "a") for t in range(60)]
    rows += [(convs + 1 + k, t, "user", "same") for k in range(150) for t in range(2)]
    return rows + [(None, 0, "user", "a"), (convs, 3, "user", "a")]


def test_trie_equals_plain_version(spark):
    rows = _random_turns(2, 200, 7)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA).repartition(3)
    keys = turn_trie.turn_keys(df)
    for t, want in ((keys, _turns(rows)), (queries.rebuilt(keys), _rebuilt(_turns(rows)))):
        for run in (turn_trie.RUN, 3000, 1):
            got = [tuple(r) for r in turn_trie.trie(t, run).drop("turn_id").collect()]
            assert sorted(got) == _plain_trie(want), run


def test_trie_of_none_and_of_one_turnless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turn_trie.trie(turn_trie.turn_keys(none)).count() == 0
    keys = spark.createDataFrame([(4, b"")], "conv_id long, key binary")
    got = [tuple(r) for r in turn_trie.trie(keys).collect()]
    assert got == [(4, 0, None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest(), None)]


def test_node_layouts_grow_and_keep_children():
    rng = random.Random(5)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randrange(4))) for _ in range(4000)}
    keys |= {k + bytes(30) + k for k in list(keys)[:300]}
    tree, kinds, found = turn_trie.Tree(), Counter(), []
    for n, k in enumerate(rng.sample(sorted(keys), len(keys))):
        tree.insert(k, n)
    todo = [tree.root]
    while todo:
        node = todo.pop()
        kinds[node.kind] += 1
        below = node.ordered()
        assert len(below) <= node.kind and (node is tree.root or len(node.ends) + len(below) != 1 or node.ends)
        assert [c.key[node.end] for c in below] == sorted({c.key[node.end] for c in below})
        found += [node.key[:node.end]] * len(node.ends)
        todo += below
    assert sorted(found) == sorted(keys) and set(kinds) == {4, 16, 48, 256}


def test_turn_ids_lead_back_to_the_texts(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "user", "x"), (2, 0, "user", "hello")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)
    got = {r.depth: r.turn_id for r in turn_trie.trie(turn_trie.turn_keys(df)).collect()}
    assert got == {0: None, 1: bytearray(hashlib.sha256(b"4:userhello").digest()[:16]), 2: bytearray(hashlib.sha256(b"4:userx").digest()[:16])}
