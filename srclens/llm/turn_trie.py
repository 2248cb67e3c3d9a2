"""Prefix trie of conversations by adaptive radix trees.

A turn's id has a fixed width of WIDTH bytes: the first 16 of the SHA-256 of
(role, text), then the text's UTF-8 length, big-endian. A conversation is the
string of its turns' ids, so a sequence of turns is a byte prefix and equal
sequences are equal bytes. Texts are read once and not moved.

The keys are sorted over all partitions (``repartitionByRange``). Each task
puts runs of up to RUN key bytes into an adaptive radix tree (``Tree``): nodes
grow through layouts of 4, 16, 48 and 256 children, bytes without a branch are
kept as one compressed path. Only depths that are a multiple of WIDTH are nodes
of the trie; branches inside an id and the other bytes of a path are not.

A run is contiguous, so a trie node that is a prefix of neither its first nor
its last key has all its conversations in this run: it is closed, and its
figures, subtree included, leave the task final. The others are open: their
parts (members, closed children and what lies below these) are added over the
runs, and sums over subtrees of open nodes follow by pointer doubling: after k
rounds a node holds what lies less than 2^k open levels below it. There are at
most two open nodes per run and depth, so that table is small, but it is
distributed all the same. Many conversations with one prefix, or wholly equal
ones, are many runs in many tasks.

The digest of a node's own conversations (those that end there) needs their
sorted ids in one stream: open nodes' ids leave the runs joined in pieces, and
the pieces of a node, in order, pass through one hash in one task.

Rows: a null conv_id takes no part; a null role or text is empty; turns follow
``turn``, null first, ties by role, then by id; repeated rows are repeated turns.
An empty table gives no rows, else there is a root. Extra columns are not read.
One conversation's ids (WIDTH bytes a turn, not its texts) are one value.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

WIDTH = 20
RUN = 1 << 25
SALTS = 16
PART = ("node string, parent string, depth long, turn_id binary, bytes long, conv_id long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, piece string")
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Node:
    """The bytes of ``key`` between the parent's end and ``end``, the conversations whose key ends here, and up to 256 children.

    The layout follows the number of children: up to 4 and up to 16 as sorted bytes beside the children, up to 48
    as an index of 256 slots beside them, else 256 places."""

    __slots__ = ("key", "end", "ends", "kind", "index", "children")

    def __init__(self, key: bytes, end: int):
        self.key, self.end, self.ends = key, end, []
        self.kind, self.index, self.children = 4, bytearray(), []

    def child(self, byte: int):
        if self.kind <= 16:
            at = bisect_left(self.index, byte)
            return self.children[at] if at < len(self.index) and self.index[at] == byte else None
        if self.kind == 48:
            return self.children[self.index[byte] - 1] if self.index[byte] else None
        return self.children[byte]

    def put(self, byte: int, node: "Node") -> None:
        """Sets the child for a byte, in the next larger layout if this one is full."""
        if self.kind <= 16:
            at = bisect_left(self.index, byte)
            if at < len(self.index) and self.index[at] == byte:
                self.children[at] = node
                return
            if len(self.index) < self.kind:
                self.index.insert(at, byte)
                self.children.insert(at, node)
                return
            if self.kind == 4:
                self.kind = 16
            else:
                slots = bytearray(256)
                for k, b in enumerate(self.index):
                    slots[b] = k + 1
                self.kind, self.index = 48, slots
        elif self.kind == 48:
            if self.index[byte]:
                self.children[self.index[byte] - 1] = node
                return
            if len(self.children) < 48:
                self.children.append(node)
                self.index[byte] = len(self.children)
                return
            self.kind, self.children = 256, [self.children[k - 1] if k else None for k in self.index]
            self.index = bytearray()
        if self.kind == 256:
            self.children[byte] = node
        else:
            self.put(byte, node)

    def ordered(self) -> list["Node"]:
        """Children by their byte."""
        if self.kind <= 16:
            return list(self.children)
        if self.kind == 48:
            return [self.children[k - 1] for k in self.index if k]
        return [c for c in self.children if c is not None]


class Tree:
    """An adaptive radix tree; keys may be prefixes of each other. The root's path is empty."""

    def __init__(self):
        self.root = Node(b"", 0)

    def insert(self, key: bytes, conv: int) -> None:
        node = self.root
        while node.end < len(key):
            at = node.end
            below = node.child(key[at])
            if below is None:
                below = Node(key, len(key))
                node.put(key[at], below)
            elif key[at:below.end] != below.key[at:below.end]:  # the path forks, or the key ends on it
                upper = Node(key, at + _shared(key[at:], below.key[at:below.end]))
                upper.put(below.key[upper.end], below)
                node.put(key[at], upper)
                below = upper
            node = below
        node.ends.append(conv)


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n if a[:n] == b[:n] else next(k for k in range(n) if a[k] != b[k])


def _names(key: bytes) -> list[str]:
    """The digest of every turn-aligned prefix, the empty one first."""
    h, out = hashlib.sha256(), []
    for k in range(0, len(key) + 1, WIDTH):
        out.append(h.hexdigest())
        h.update(key[k:k + WIDTH])
    return out


class _Below:
    """Of a radix node: members, the smallest; topmost trie nodes, leaves and saved bytes under its last trie node, and seen from above."""

    __slots__ = ("n", "low", "tops", "leaves", "saved", "all_tops", "all_leaves", "all_saved")


def _depths(node: Node, start: int) -> range:
    """The turn-aligned depths on the node's path; the root's is 0."""
    return range(start // WIDTH * WIDTH + WIDTH, node.end + 1, WIDTH) if node.end else range(1)


def _turn_bytes(node: Node, depth: int) -> int:
    return int.from_bytes(node.key[depth - 4:depth], "big") if depth else 0


def _measure(tree: Tree) -> list[tuple[Node, int, Node | None, _Below]]:
    """(node, start, parent, figures), parents first."""
    order, todo = [], [(tree.root, 0, None)]
    while todo:
        node, start, above = todo.pop()
        order.append((node, start, above, _Below()))
        todo.extend((c, node.end, node) for c in node.ordered())
    found: dict[int, _Below] = {id(node): b for node, _, _, b in order}
    for node, start, _, b in reversed(order):
        below = [found[id(c)] for c in node.ordered()]
        b.n = len(node.ends) + sum(x.n for x in below)
        b.low = min([*node.ends, *(x.low for x in below)])
        b.tops, b.leaves, b.saved = (sum(v) for v in (([x.all_tops for x in below]), [x.all_leaves for x in below], [x.all_saved for x in below]))
        depths = _depths(node, start)
        b.all_tops = 1 if depths else b.tops
        b.all_leaves = b.leaves or 1 if depths else b.leaves
        b.all_saved = b.saved + (b.n - 1) * sum(_turn_bytes(node, d) for d in depths)
    return order


def run_rows(keys: list[bytes], convs: list[int]) -> list[tuple]:
    """The rows (PART) of one run of sorted keys: closed trie nodes final, open ones (named) with what this run adds."""
    tree = Tree()
    for key, conv in zip(keys, convs):
        tree.insert(key, conv)
    edges = [(key, _names(key)) for key in (keys[0], keys[-1])]
    rows: list = []
    state: dict[int, tuple] = {}
    for node, start, above, b in _measure(tree):
        # last: (smallest member, name if open, closed sums if open) of the trie node above; on: edges this path still follows.
        last, on = state[id(above)] if above is not None else ((None, None, None), edges)
        reach = [(e, start + _shared(e[0][start:node.end], node.key[start:node.end])) for e in on]
        saved, depths = b.all_saved, _depths(node, start)
        for depth in depths:
            size, bottom = _turn_bytes(node, depth), depth + WIDTH > node.end
            ends = ",".join(map(str, sorted(node.ends))) if bottom and depth == node.end else ""
            name = next((e[1][depth // WIDTH] for e, to in reach if depth <= to), None)
            low, parent, sums = last
            turn = node.key[depth - WIDTH:depth - 4] if depth else None
            if name is not None:
                mine = [0, 0, 0]
                rows.append(((name, parent, depth // WIDTH, turn, size, b.low, None, b.n), mine, (None, ends or None)))
            else:
                mine = None
                if sums is not None:
                    for i, x in enumerate((1, b.all_leaves, saved)):
                        sums[i] += x
                rows.append(((None, parent, depth // WIDTH, turn, size, b.low, None if parent else low, b.n),
                             (b.tops if bottom else 1, b.all_leaves, saved), (hashlib.sha256(ends.encode()).hexdigest(), None)))
            last = (b.low, name, mine)
            saved -= (b.n - 1) * size
        state[id(node)] = (last, [e for e, to in reach if to == node.end])
    return [(*a, *m, *z) for a, m, z in rows]


def turn_keys(turns: DataFrame) -> DataFrame:
    """conv_id, key: a conversation's turn ids joined in order; turns: conv_id, turn, role, text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    size = F.lpad(F.hex(F.octet_length(text)), 8, "0")
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    each = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.concat(F.substring(digest, 1, 32), size).alias("id"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "id")))
    return each.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["id"]), "")).alias("key"))


def _runs(batches, most: int):
    """Batches of (conv_id, key) sorted by key, then id -> rows of PART, in runs of about ``most`` key bytes."""
    keys, convs, held = [], [], 0

    def flush():
        rows = run_rows(keys, convs)
        for at in range(0, len(rows), 10_000):
            columns = list(zip(*rows[at:at + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], NAMES)
    for batch in batches:
        for conv, key in zip(batch.column("conv_id").to_pylist(), batch.column("key").to_pylist()):
            keys.append(key)
            convs.append(conv)
            held += len(key) + 200
            if held >= most:
                yield from flush()
                keys, convs, held = [], [], 0
    if keys:
        yield from flush()


NAMES = [x.split()[0] for x in PART.split(", ")]
TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in PART.split(", ")]


def _ends(batches):
    """Batches of (node, first, piece) sorted by node, then first -> the digest of a node's pieces joined by commas."""
    node, h = None, None
    for batch in batches:
        done = []
        for n, piece in zip(batch.column("node").to_pylist(), batch.column("piece").to_pylist()):
            if n != node:
                if node is not None:
                    done.append((node, h.hexdigest()))
                node, h = n, hashlib.sha256()
            else:
                h.update(b",")
            h.update(piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([h.hexdigest()])], ["node", "ends_sha256"])


def _subtrees(own: DataFrame) -> DataFrame:
    """node, n_leaves, saved_tokens summed over the subtree; own: node, up, n_leaves, saved_tokens of the open nodes."""
    t = stage(own, "trie-open")
    while not t.filter("up is not null").isEmpty():
        add = t.filter("up is not null").groupBy(F.col("up").alias("to")).agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        jump = t.select(F.col("node").alias("at"), F.col("up").alias("next"))
        t = t.join(add, F.col("node") == F.col("to"), "left").join(jump, F.col("up") == F.col("at"), "left")
        t = stage(t.select("node", F.col("next").alias("up"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"),
                           (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")), "trie-open")
    return t.drop("up")


def trie(keys: DataFrame, run: int = RUN) -> DataFrame:
    """One row per trie node; keys: conv_id (distinct) and key (see ``turn_keys``).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    turn_id (of the node's last turn; null for the root). ``run``: key bytes of one tree."""
    keys = stage(keys.select("conv_id", "key"), "trie-keys")  # sampled for the ranges, then dealt
    dealt = keys.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = stage(dealt.mapInArrow(lambda batches: _runs(batches, run), PART), "trie-parts")
    open_ = parts.filter("node is not null").groupBy("node").agg(
        F.max("parent").alias("up"), F.max("depth").alias("depth"), F.max("turn_id").alias("turn_id"), F.max("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    open_ = stage(open_, "trie-merged")
    below = open_.filter("up is not null").groupBy(F.col("up").alias("at")).agg(F.count("*").alias("more"))
    open_ = open_.join(below, F.col("node") == F.col("at"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("at", "more")
    own = open_.select("node", "up", (F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
                       (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    pieces = parts.filter("piece is not null").select("node", F.substring_index("piece", ",", 1).cast("long").alias("first"), "piece")
    ends = pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_ends, "node string, ends_sha256 string")
    low = open_.select(F.col("node").alias("at"), F.col("conv_id").alias("low"))
    named = open_.drop("n_leaves", "saved_tokens").join(_subtrees(own), "node").join(ends, "node", "left").join(low, F.col("up") == F.col("at"), "left")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_id"]
    named = named.withColumn("parent_conv_id", F.col("low")).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).select(out)
    closed = parts.filter("node is null")
    inside = closed.filter("parent is null").select(out)
    # Many closed nodes may hang on one open node: they are dealt by salt, the open nodes repeated.
    top = closed.filter("parent is not null").withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))
    every = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("at", "parent")
    hung = top.join(every, ["parent", "salt"]).withColumn("parent_conv_id", F.col("low")).select(out)
    return inside.unionByName(hung).unionByName(named)
