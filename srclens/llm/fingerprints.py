"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text is cut at line ends and sentence marks; the set of the pieces' 64-bit
digests goes into a sketch of three sub-tables. Each digest adds one to the
count and itself and its check hash (XOR) to one cell of every sub-table.
Sketches of one size subtract cell by cell, which leaves the digests of one
side only. Peeling takes the cells of a sub-table that hold a single digest,
moves these digests out of their other cells and goes on with the next
sub-table until every cell is empty: the differing digests are recovered.
On failure both texts are sketched again with more cells; the last resort is
the plain difference of the digests.

The fingerprint is the first sketch (``CELLS`` cells) in hexadecimal.
Likeness is the share of common digests, (a + b - d) / (a + b + d) for a and
b pieces and d differing ones, and 1 for two texts without pieces.

Only SQL functions run here. Cells are rows: the first sketch and one in
proportion to the pieces are built, subtracted and peeled by grouped sums
and XORs, all inside the partitioning that the neighbour window made; the fingerprints
themselves are array functions on the row. The few pairs that neither sketch recovers are sketched
again, four and sixteen times larger, with array functions on their row.

Null texts count as empty. Equal texts have equal fingerprints; the order
and repetition of pieces do not show. The next document in descending id
(ties by text) follows the last one of its range of ids; the first of the
next range is put behind it, so no task sorts all documents. Null ids come
last. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, shuffle_partitions

CELLS, ROUNDS, CYCLES = 45, 14, 6
#: Bytes of text in a range of ids: its cells are many times as large.
PART = 4 << 20
#: Marks that end a piece, beside line ends.
MARKS = ".!?"
#: Place of the row that counts the digests peeled so far.
COUNT = 0xFFFFFFFF


def digests(text: Column) -> Column:
    pieces = F.filter(F.split(F.translate(text, MARKS, "\n" * len(MARKS)), "\n"), lambda p: (p != "") & (p != " "))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p)))


def check(k: Column) -> Column:
    return F.xxhash64(k, F.lit(77)).bitwiseAND(0xFFFFFFFF)


def _pairs(signed: Column, m: Column) -> Column:
    """(cell, sign, digest) of signed digests in all sub-tables, sorted by cell."""
    third = (m / 3).cast("long")
    cell = lambda x, i: (F.pmod(F.xxhash64(x["k"], F.lit(i)), third) + third * i).cast("int")
    return F.array_sort(F.flatten(F.transform(signed, lambda x: F.array(*(F.struct(cell(x, i).alias("c"), x["s"].alias("s"), x["k"].alias("k")) for i in range(3))))))


def _cells(pairs: Column) -> Column:
    """Struct (at: places of the filled cells in order, cells: their n, k, h)."""
    zero = F.struct(F.array(F.lit(0)).alias("n"), F.array(F.lit(0).cast("long")).alias("k"), F.array(F.lit(0).cast("long")).alias("h"))
    add = lambda a, p: F.struct(
        F.array_append(a["n"], F.element_at(a["n"], -1) + p["s"]).alias("n"),
        F.array_append(a["k"], F.element_at(a["k"], -1).bitwiseXOR(p["k"])).alias("k"),
        F.array_append(a["h"], F.element_at(a["h"], -1).bitwiseXOR(check(p["k"]))).alias("h"))

    def build(p):
        places = F.transform(p, lambda x: x["c"])
        v = F.struct(F.aggregate(p, zero, add).alias("r"), places.alias("c"), F.array_distinct(places).alias("at"))
        v = let(v, lambda v: F.struct(v["r"].alias("r"), v["at"].alias("at"), F.transform(v["at"], lambda x: (F.array_position(v["c"], x) - 1).cast("int")).alias("start")))
        return let(v, lambda v: F.struct(v["at"].alias("at"), F.transform(v["start"], lambda s, i: let(
            F.coalesce(F.get(v["start"], i + 1), F.size(v["r"]["k"]) - 1), lambda e: F.struct(
                (F.get(v["r"]["n"], e) - F.get(v["r"]["n"], s)).alias("n"),
                F.get(v["r"]["k"], e).bitwiseXOR(F.get(v["r"]["k"], s)).alias("k"),
                F.get(v["r"]["h"], e).bitwiseXOR(F.get(v["r"]["h"], s)).alias("h")))).alias("cells")))
    return let(pairs, build)


def _nothing() -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))


def sketch(signed: Column, m: Column) -> Column:
    """The m cells of signed digests (struct s, k)."""
    return let(_cells(_pairs(signed, m)), lambda v: F.transform(F.sequence(F.lit(0), m.cast("int") - 1), lambda c: let(
        F.array_position(v["at"], c), lambda p: F.when(p > 0, F.get(v["cells"], (p - 1).cast("int"))).otherwise(_nothing()))))


def signed(keys: Column, sign: int = 1) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(sign).alias("s"), k.alias("k")))


def peel(cells: Column, m: Column) -> Column:
    """The number of differing digests, or null where peeling does not empty the cells."""
    def step(a, _):
        pure = F.array_distinct(F.transform(F.filter(a["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["h"] == check(x["k"]))),
                                            lambda x: F.struct(x["n"].alias("s"), x["k"].alias("k"))))
        taken = lambda p: let(_cells(_pairs(p, m)), lambda v: F.struct(F.transform(a["cells"], lambda x, c: let(
            F.array_position(v["at"], c), lambda at: F.when(at > 0, let(F.get(v["cells"], (at - 1).cast("int")), lambda y: F.struct(
                (x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["h"].bitwiseXOR(y["h"]).alias("h")))).otherwise(x))).alias("cells"),
            (a["found"] + F.size(p)).alias("found")))
        return let(pure, lambda p: F.when(F.size(p) == 0, a).otherwise(taken(p)))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(cells.alias("cells"), F.lit(0).alias("found")), step)
    return let(end, lambda e: F.when(~F.exists(e["cells"], lambda x: (x["n"] != 0) | (x["k"] != 0)), e["found"]))


def again(a: Column, b: Column) -> Column:
    """Number of digests in one of two key sets only, from ever larger sketches."""
    both = F.concat(signed(a), signed(b, -1))  # the difference of two sketches is the sketch of the signed digests
    larger = lambda f: (F.ceil((F.size(a) + F.size(b)) * F.lit(f) / 3) * 3 + CELLS).cast("int")
    retry = lambda f: let(larger(f), lambda m: peel(sketch(both, m), m))
    return F.coalesce(retry(6), retry(24), F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)))


def likeness(n: Column, d: Column) -> Column:
    return F.when(n == 0, 1.0).otherwise((n - d) / (n + d)).cast("double")


def _place(g: Column) -> Column:
    return g.bitwiseAND(COUNT)


def _add(rows: DataFrame) -> DataFrame:
    """Cells from contributions, without the empty ones. g packs row, comparison and place."""
    cells = rows.groupBy("bucket", "g", "m3").agg(F.sum("n").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    return cells.filter("n <> 0 or k <> 0 or h <> 0")


def _cell(k: Column, i: int, m3: Column) -> Column:
    return F.pmod(F.xxhash64(k, F.lit(i)), m3) + m3 * i


def _peel_table(cells: DataFrame, i: int) -> DataFrame:
    """One step: the single digests of sub-table i leave their other cells and are counted."""
    k, m3, n = F.col("k"), F.col("m3"), F.col("n")
    place, base = _place(F.col("g")), F.col("g") - _place(F.col("g"))
    pure = (F.abs(n) == 1) & (place >= m3 * i) & (place < m3 * (i + 1)) & (F.col("h") == check(k))
    row = lambda g, n, k, h: F.struct(g.alias("g"), n.cast("long").alias("n"), k.alias("k"), h.alias("h"))
    zero = F.lit(0).cast("long")
    moved = [row(base + _cell(k, j, m3), -n, k, F.col("h")) for j in range(3) if j != i]
    out = F.when(pure, F.array(*moved, row(base + COUNT, F.lit(1), zero, zero))).otherwise(F.array(row(F.col("g"), n, k, F.col("h"))))
    return _add(cells.select("bucket", "m3", F.inline(out)))


def _contributions(rows: DataFrame) -> DataFrame:
    """rows: bucket, rn, c (comparison), m3, s (sign), k (digest) -> one row per sub-table."""
    base = F.shiftleft(F.col("rn").cast("long"), 35) + F.shiftleft(F.col("c").cast("long"), 32)
    places = F.array(*(_cell(F.col("k"), i, F.col("m3")) for i in range(3)))
    return rows.select("bucket", "m3", "s", "k", base.alias("base"), F.explode(places).alias("p")).select(
        "bucket", (F.col("base") + F.col("p")).alias("g"), "m3", F.col("s").cast("long").alias("n"), "k", check(F.col("k")).alias("h"))


def _sides(keys: DataFrame, sides: list[tuple[int, Column, int, str]]) -> DataFrame:
    """Signed digests of (comparison, sub-table size, sign, key column) sides."""
    all_ = F.array(*(F.struct(F.lit(c).alias("c"), m3.cast("long").alias("m3"), F.lit(s).alias("s"), F.col(x).alias("x")) for c, m3, s, x in sides))
    return keys.select("bucket", "rn", F.inline(all_)).select("bucket", "rn", "c", "m3", "s", F.explode("x").alias("k"))


def differences(keys: DataFrame) -> DataFrame:
    """bucket, rn, d_e, d_b: digests that a and e, a and b do not share; null where two sketches failed."""
    m3 = F.lit(CELLS // 3)
    own = lambda x: F.ceil((F.size("a") + F.size(x)) * 0.5) + CELLS // 3
    sides = [(c, m, s, x) for c, m, y in ((2, m3, "e"), (3, m3, "b"), (4, own("e"), "e"), (5, own("b"), "b")) for s, x in ((1, "a"), (-1, y))]
    cells = _add(_contributions(_sides(keys, sides)))
    for r in range(3 * CYCLES):
        cells = _peel_table(cells, r % 3)
    c, counted = F.shiftright("g", 32).bitwiseAND(7), _place(F.col("g")) == COUNT
    got = cells.groupBy("bucket", F.shiftright("g", 35).cast("int").alias("rn")).agg(
        *(x for k in (2, 3, 4, 5) for x in (F.max(F.when((c == k) & counted, F.col("n"))).alias(f"n{k}"), F.max(F.when((c == k) & ~counted, F.lit(1))).alias(f"f{k}"))))
    d = lambda k: F.when(F.col(f"f{k}").isNull(), F.coalesce(f"n{k}", F.lit(0).cast("long"))).when(F.col(f"f{k + 2}").isNull(), F.coalesce(f"n{k + 2}", F.lit(0).cast("long")))
    return got.select(F.col("bucket").alias("at_bucket"), F.col("rn").alias("at_rn"), d(2).alias("d_e"), d(3).alias("d_b"))


def fingerprint(keys: Column) -> Column:
    """The first sketch of a text's digests in hexadecimal: per cell count, digests and check hashes."""
    zero = F.lit(0).cast("long")

    def table(i):
        placed = F.transform(keys, lambda k: F.struct(F.pmod(F.xxhash64(k, F.lit(i)), F.lit(CELLS // 3)).alias("c"), k.alias("k"), check(k).alias("h")))
        cell = lambda x: F.concat(F.lpad(F.lower(F.hex(F.size(x))), 4, "0"), *(
            F.lpad(F.lower(F.hex(F.aggregate(x, zero, lambda a, y: a.bitwiseXOR(y[f])))), w, "0") for f, w in (("k", 16), ("h", 8))))
        return let(placed, lambda p: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(CELLS // 3 - 1)), lambda c: let(F.filter(p, lambda x: x["c"] == c), cell)), ""))
    return F.concat(*(table(i) for i in range(3)))


def with_next(d: DataFrame) -> DataFrame:
    """bucket, rn, key, text, a (its digests), and text and digests of the next document in descending key, round to the first."""
    spark = d.sparkSession
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(shuffle_partitions(spark), -(-total // PART))
    order = F.coalesce("key", F.lit(-2 ** 63))
    bounds = sorted(set(d.agg(F.percentile_approx(order, [k / n for k in range(1, n)], 10_000)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*[F.lit(int(b)).cast("long") for b in bounds]).cast("array<bigint>"), lambda b: b < order))
    d = d.withColumn("bucket", bucket)
    heads = sorted((r.bucket, r.top) for r in d.groupBy("bucket").agg(F.max(order).alias("top")).collect()) or [(0, 0)]
    # the head of each range goes behind the range above it, the first head behind the last range
    to = [x for k, (_, _) in enumerate(heads) for x in (F.lit(heads[k][1]).cast("long"), F.lit(heads[(k + 1) % len(heads)][0]))]
    head = d.filter(order.isin([top for _, top in heads])).withColumn("to", F.element_at(F.create_map(*to), order))
    # heads are few; of rows with one id the first in order
    head = head.groupBy("to").agg(F.min("text").alias("text"))
    extra = head.select(F.lit(None).cast("long").alias("key"), "text", F.col("to").alias("bucket"), F.lit(True).alias("extra"))
    w = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("key"), "text")
    rows = d.select("key", "text", "bucket", F.lit(False).alias("extra")).unionByName(extra).withColumn("a", digests(F.col("text"))).repartition(n, "bucket")
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("b", F.lead("a").over(w)).withColumn("rn", F.row_number().over(w))
    return rows.filter("not extra").drop("extra")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""
    d = with_next(docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    d = d.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    d = d.select("bucket", "rn", "key", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "a", digests(F.col("edited")).alias("e"), "b")
    # both sides of this join read one shuffle of the documents; a plain equality would add a null test to one side's scan and part them
    out = d.join(differences(d).withColumn("found", F.lit(True)), F.col("bucket").eqNullSafe(F.col("at_bucket")) & F.col("rn").eqNullSafe(F.col("at_rn")), "left")
    near = lambda x: likeness(F.size("a") + F.size(x), F.when(F.col("found").isNull(), 0).otherwise(F.coalesce(f"d_{x}", again(F.col("a"), F.col(x)))))
    return out.select(F.col("key").alias(key), "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"),
                      near("e").alias("near_edited"), near("b").alias("near_next"))
