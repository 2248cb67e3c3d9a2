"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is -ln(u) / w with u drawn from a hash of its id and text
and w its quality weight; the smallest keys of a source come first. A
source's target in words becomes whole epochs of all its documents and a
remainder, filled by the documents in key order while their running sum
stays within it. Documents too long for what is left are passed over: two
more rounds go on behind the last one taken with those that still fit, and
the last round takes one document more if that ends nearer to the target.

The running sum is cut in two: words per (source, key bucket) find the
bucket where the remainder ends, and only that bucket's documents are
ordered. So no task holds a source, and a decision is one comparison with
the cut of the document's source.

Null texts have size 0 and are never taken; a null source is a source of
its own, the last. Rows with equal id and text share one key and are counted
as one group, of which as many are taken as fit; which of them is open, so
reruns give the same rows but for their extra columns. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

BUCKETS, ROUNDS = 4096, 3
CUT = "struct<bucket:int,key:double,h:bigint,size:bigint>"
#: Stands for all rows of a group; rows of a block are numbered in one task.
ALL, BLOCK = 1 << 62, 1 << 14


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, target: one row a source; sizes has source and source_size."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("w", w).withColumn("full", F.col("source_size") * F.lit(most))
    order, everything = Window.orderBy(F.col("full") / F.col("w"), "rank"), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    rate = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    capped = ranked.withColumn("capped", rate * F.col("w") >= F.col("full"))
    free = ~F.col("capped")
    share = ((F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("full"))).over(everything), F.lit(0.0)))
             / F.sum(F.when(free, F.col("w"))).over(everything))
    return capped.select("source", "source_size", F.when(F.col("capped"), F.col("full")).otherwise(share * F.col("w")).cast("double").alias("target"))


def _round(rows: DataFrame, need: DataFrame, last: bool) -> DataFrame:
    """source, cut, m, took: the last group (bucket, key, h, size) taken in order within need.left, and how many of its n rows (ALL: the rest of it)."""
    need = need.select(F.col("source").alias("s"), "left")
    rows = rows.join(need, F.col("source").eqNullSafe(F.col("s"))).drop("s").filter("left > 0 and size > 0 and size <= left" + " * 2" * last)
    hist = rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.first("left").alias("left"))
    w = Window.partitionBy("source").orderBy("bucket")
    cum = hist.withColumn("upto", F.sum("size").over(w)).withColumn("before", F.col("upto") - F.col("size"))
    edge = cum.filter("before <= left").groupBy(F.col("source").alias("s")).agg(F.max(F.struct("bucket", "before", "upto", "left")).alias("e"))
    inside = rows.drop("left").join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("e.bucket")))
    order = Window.partitionBy("source").orderBy(F.struct("key", "h", "size"))
    all_of_it = F.col("size") * F.col("n")
    run = inside.withColumn("from", F.col("e.before") + F.sum(all_of_it).over(order) - all_of_it).withColumn("room", F.col("e.left") - F.col("from"))
    run = run.withColumn("m", F.least(F.col("n"), F.floor(F.greatest(F.col("room"), F.lit(0.0)) / F.col("size"))))
    if last:  # one more if nearer
        over = (F.col("m") + 1) * F.col("size") - F.col("room")
        run = run.withColumn("m", F.col("m") + ((F.col("m") < F.col("n")) & (over < F.col("room") - F.col("m") * F.col("size"))).cast("long"))
    some = F.when(F.col("m") == F.col("n"), F.lit(ALL)).otherwise(F.col("m")).cast("long").alias("m")
    got = run.filter("m > 0").groupBy("source").agg(F.max(F.struct("bucket", "key", "h", "size", (F.col("from") + F.col("m") * F.col("size")).alias("upto"), some)).alias("m"))
    most = F.lit(2 ** 63 - 1).cast("long")
    start = F.struct((F.col("e.bucket") - 1).cast("int").alias("bucket"), F.lit(float("inf")).alias("key"), most.alias("h"), most.alias("size"))
    return (edge.join(got, F.col("s").eqNullSafe(F.col("source")), "left")
            .select(F.col("s").alias("source"), F.when(F.col("m").isNull(), start).otherwise(F.struct("m.bucket", "m.key", "m.h", "m.size")).cast(CUT).alias("cut"),
                    F.coalesce(F.col("m.m"), F.lit(ALL)).cast("long").alias("m"), F.coalesce(F.col("m.upto"), F.col("e.before")).cast("double").alias("took")))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 17) -> DataFrame:
    """docs with __size (words) and __h (hash of id and text): all that mixing needs of the text."""
    h = F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return docs.select(*docs.columns, size_of(F.col(text)).alias("__size"), h.alias("__h"))


def mix(docs: DataFrame, quality: Column | None = None, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17,
        weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """docs with size, source_size, target, epochs (whole and fractional passes of the document), taken.

    quality: a column of docs with positive weights (null: 1)."""
    return mix_measured(measure(docs, key, text, seed), quality, source, weights)


def mix_measured(docs: DataFrame, quality: Column | None = None, source: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """As mix, of rows that went through measure(); the text itself may have been dropped since."""
    w = F.greatest(F.coalesce(quality, F.lit(1.0)).cast("double"), F.lit(1e-6)) if quality is not None else F.lit(1.0)
    u = (F.shiftrightunsigned("__h", 11).cast("double") + 0.5) / float(1 << 53)
    cols = [c for c in docs.columns if c not in ("size", "source_size", "target", "epochs", "taken", "__size", "__h")]
    d = docs.select(*cols, F.col("__size").alias("size"), "__h", (-F.log(u) / w).alias("__key"))
    d = d.withColumn("__bucket", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("__key"))) * BUCKETS)).cast("int"))
    narrow = stage(d.select(F.col(source).alias("source"), "size", F.col("__h").alias("h"), F.col("__key").alias("key"), F.col("__bucket").alias("bucket"))
                   .groupBy("source", "bucket", "key", "h", "size").agg(F.count("*").alias("n")), "mix")
    t = targets(narrow.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("int")
    plan = stage(t.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("picks", F.array().cast(f"array<struct<left:double,cut:{CUT},m:bigint>>")), "mix-plan")
    for k in range(ROUNDS):
        last = k == ROUNDS - 1
        rows = narrow
        if k:
            j = narrow.join(plan.select(F.col("source").alias("s"), "picks"), F.col("source").eqNullSafe(F.col("s")))
            rows = j.withColumn("n", F.col("n") - _picked(F.col("picks"), "bucket", "key", "h", "size", F.col("n"))).filter("n > 0").select(narrow.columns)
        cuts = _round(rows, plan, last)
        plan = stage(plan.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
                     .withColumn("picks", F.when(F.col("cut").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array(F.struct(
                         (F.col("left") * (2 if last else 1)).cast("double").alias("left"), "cut", "m")))))
                     .withColumn("left", F.col("left") - F.coalesce("took", F.lit(0.0))).drop("s", "cut", "m", "took"), "mix-plan")
    cut = not plan.filter(F.exists("picks", lambda p: p["m"] < ALL)).isEmpty()
    plan = plan.select(F.col("source").alias("__source"), "source_size", "target", F.col("whole").alias("__whole"), F.col("picks").alias("__picks"))
    out = d.join(plan, F.col(source).eqNullSafe(F.col("__source")))
    some = F.when(F.col("size") > 0, _picked(F.col("__picks"), "__bucket", "__key", "__h", "size", F.lit(ALL))).otherwise(0)
    out = out.withColumn("__some", some).withColumn("__more", (F.col("__some") > 0).cast("int"))
    if cut:
        in_part = (F.col("__some") > 0) & (F.col("__some") < ALL)
        out = out.filter(~in_part).unionByName(_numbered(out.filter(in_part)))
    return out.select(*cols, "size", "source_size", "target", (F.col("__whole") + F.col("__more")).alias("epochs"),
                      (F.col("size") * (F.col("__whole") + F.col("__more"))).cast("long").alias("taken"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of groups of which __some rows are taken, with __more for as many; numbered block by block, so no task holds a group."""
    group = ["__source", "__key", "__h", "size"]
    rows = stage(rows.withColumn("__rid", F.monotonically_increasing_id()), "mix-cut").withColumn("__block", F.floor(F.col("__rid") / BLOCK))
    blocks = rows.groupBy(*group, "__block").agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy(*group).orderBy("__block")) - F.col("__rows")
    blocks = blocks.select(*(F.col(c).alias(f"{c}_b") for c in [*group, "__block"]), before.alias("__before"))
    same = F.lit(True)
    for c in [*group, "__block"]:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_b"))
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*group, "__block").orderBy("__rid"))
    placed = rows.join(blocks, same).withColumn("__more", (place <= F.col("__some")).cast("int"))
    return placed.drop("__rid", "__block", "__before", *(f"{c}_b" for c in [*group, "__block"]))


def _picked(picks: Column, bucket: str, key: str, h: str, size: str, n: Column) -> Column:
    """How many of a group's n rows the rounds took: those before a cut and not too long for it, and as many as the cut says at it."""
    own = F.struct(F.col(bucket).alias("bucket"), F.col(key).alias("key"), F.col(h).alias("h"), F.col(size).alias("size")).cast(CUT)
    fits = lambda p: F.col(size) <= p["left"]
    return F.aggregate(picks, F.lit(0).cast("long"), lambda got, p: F.when(fits(p) & ((own < p["cut"]) | ((own == p["cut"]) & (p["m"] == ALL))), n.cast("long"))
                       .when(fits(p) & (own == p["cut"]), F.least(n.cast("long"), got + p["m"])).otherwise(got))
