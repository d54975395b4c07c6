"""Mix sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source starts with the same number of copies, target over
source size. The whole part is taken at once. The fractions are rounded by a
reduction tree: a node holds some 64 fractional documents and folds them pair by
pair, moving words of mass from one document to the other at random, without
changing either's expectation or the pair's sum of words, until one of the two is
integral. What is left of a node, at most one fractional document, goes to the
next level. So a source's words are kept exactly, down to the one document left at
the root; that one is taken in part (``last="partial"``: its first words) or
rounded to the nearer whole number of copies (``last="whole"``). Equal rows are
counted before they meet: of n such rows with fraction p, the whole part of n p get
a copy each and one goes into the tree with what is left.

Defined results: a null or blank text has size 0 and takes no words; null sources
form one source, the last; repeated rows are separate documents, and which of them
get a copy more depends on their values alone; an empty table gives an empty result.
Other columns of the input are not read, so their names cannot clash. Reruns agree:
all random numbers are hashes of the seed and the documents' keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tarnwick.session import stored

from .common import free, n_words, unit_hash

#: Documents that one node of the reduction tree folds, on average.
FAN_IN = 64
#: Sources up to this number are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
TINY = 1e-9
#: Buckets of ratios that one step of the search for the level sums, and equal rows that one step of their numbering makes.
BUCKETS, EQUAL_ROWS = 1024, 10_000
#: Salts among which the rows of one key are numbered.
SALTS = 256


def _numbered(per: DataFrame) -> DataFrame:
    """``per`` with ``place``, the number of sources before each by code point, null last: by ranges, then within them."""
    name = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))
    ranged = stored(per.withColumn("_name", name).repartitionByRange("_name").withColumn("_range", F.spark_partition_id()), "mix-sources")
    before = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # a row per range
    before = before.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_name"))
    return ranged.withColumn("_in", within).join(F.broadcast(before), "_range").withColumn("place", F.col("_base") + F.col("_in") - 1).drop("_range", "_in", "_base", "_name")


def _level(per: DataFrame, total: float) -> float:
    """The level at which all sources' smaller of cap and weight times level sum to ``total``.

    The level lies among the ratios of cap to weight. Sums per bucket of ratios,
    ``BUCKETS`` of them, tell the bucket; it is cut into buckets again until it holds one ratio.
    """
    ratio = F.col("cap") / F.col("w")
    low, high = per.agg(F.min(ratio), F.max(ratio)).head()
    full, rest = 0.0, None  # caps below the range looked at, weights above it
    while True:
        step = (high - low) / BUCKETS
        inside = per.filter((ratio >= low) & (ratio <= high))
        bucket = F.least(F.floor((ratio - low) / step), F.lit(BUCKETS - 1)) if step > 0 else F.lit(0)
        sums = inside.groupBy(bucket.cast("int").alias("b")).agg(
            F.sum("cap").alias("cap"), F.sum("w").alias("w"), F.min(ratio).alias("low"), F.max(ratio).alias("high")
        ).orderBy("b").collect()  # a row per bucket
        after = sum(r["w"] for r in sums) + (rest or 0.0)
        for r in sums:
            # With all of this bucket's sources at their caps, the level would be at least the bucket's largest ratio.
            if full + r["cap"] + r["high"] * (after - r["w"]) >= total or r is sums[-1]:
                break
            full, after = full + r["cap"], after - r["w"]
        if r["low"] == r["high"] or r["high"] - r["low"] >= high - low:
            return (total - full) / after
        low, high, rest = r["low"], r["high"], after - r["w"]


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Target words of each source: by weight, none above ``cap`` times its size.

    ``sizes`` has ``source`` and ``size``. Resharing the excess by weight until none
    is above its cap ends where every source has the smaller of its cap and its
    weight times one level.
    """
    per = _numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    all_words = per.agg(F.sum("source_size")).head()[0] or 0
    level = _level(per, share * all_words) if all_words else 0.0
    return per.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))


def _fold(seed: int) -> Column:
    """Fold column ``docs`` (array of key, u, size, p): struct of what is decided and the one document left."""
    none = "cast(null as struct<key:bigint,doc_id:bigint,size:bigint,p:double>)"
    # up: words that a can gain from b before either is integral; down: words it can give
    step = f"""
      case when acc.left is null then struct(acc.done as done, d as left) else
        transform(array(struct(
            least((1D - acc.left.p) * acc.left.size, d.p * d.size) as up,
            least(acc.left.p * acc.left.size, (1D - d.p) * d.size) as down,
            shiftrightunsigned(xxhash64({seed}L, acc.left.key, d.key), 11) / {float(1 << 53)!r} as u)),
          m -> transform(array(case when m.u * (m.up + m.down) < m.down then m.up else -m.down end), move ->
            transform(array(struct(
                acc.left.p + move / acc.left.size as pa, d.p - move / d.size as pb)),
              x -> case when abs(x.pa - round(x.pa)) <= abs(x.pb - round(x.pb))
                then struct(concat(acc.done, array(struct(acc.left.key, acc.left.doc_id, acc.left.size, round(x.pa) as p))) as done,
                  struct(d.key, d.doc_id, d.size, x.pb as p) as left)
                else struct(concat(acc.done, array(struct(d.key, d.doc_id, d.size, round(x.pb) as p))) as done,
                  struct(acc.left.key, acc.left.doc_id, acc.left.size, x.pa as p) as left)
                end)[0])[0])[0]
      end"""
    kind = "array<struct<key:bigint,doc_id:bigint,size:bigint,p:double>>"
    return F.expr(f"aggregate(docs, struct(cast(array() as {kind}) as done, {none} as left), (acc, d) -> {step})")


def row_key(docs: DataFrame, seed: int, names: Iterable[str]) -> Column:
    """A hash of these columns of a row, nulls told apart from nothing."""
    cols = [F.col(f"`{n}`") for n in names if not isinstance(docs.schema[n].dataType, MapType)]
    return F.xxhash64(F.lit(seed), *cols, F.concat(*[c.isNull().cast("string") for c in cols]))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 20240607,
    last: str = "partial",
    key: Column | None = None,
) -> DataFrame:
    """One row per document: key, doc_id, source, size, source_size, target, copies, partial_words, taken.

    ``docs`` needs ``doc_id``, ``text`` and ``source``. ``weights`` go to the sources
    by code point, null last, and repeat; together they get ``share`` of all words.
    ``key`` is a hash of the row, of its id, source and text unless given, for a join back to the rows.
    """
    sized = docs.select(
        (row_key(docs, seed, ("doc_id", "source", "text")) if key is None else key).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        n_words(F.col("text").cast("string")).alias("size"),
    )
    sized = stored(sized, "mix-sizes")
    n_rows = sized.count()
    targets = stored(source_targets(sized, weights, share, cap), "mix-targets", rows=n_rows)
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    same = sized["source"].eqNullSafe(targets["source"])
    rated = sized.join(targets, same).drop(targets["source"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = rated.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + TINY).cast("long"))
    rated = rated.withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    small = (F.col("size") == 0) | (F.col("p") <= TINY)
    about = ["source", "source_size", "target", "base"]
    out = rated.filter(small).select(
        "key", "doc_id", "size", *about,
        F.when(F.col("p") > TINY, (unit_hash(F.lit(seed), F.col("key")) < F.col("p")).cast("double")).otherwise(F.lit(0.0)).alias("p"),
    )
    live = rated.filter(~small).groupBy("key", "doc_id", "size", *about, "p").agg(F.count(F.lit(1)).alias("n"))
    live = stored(live.withColumn("whole", F.floor(F.col("n") * F.col("p") + TINY).cast("long")), "mix-live", rows=n_rows)
    most = live.groupBy("source").count().agg(F.max("count")).head()[0] or 0
    # Of n equal rows all but one are settled here, some at a time; the last one carries what is left.
    equal = live.filter("n > 1").withColumn("part", F.explode(F.expr(f"sequence(0L, (n - 2) div {EQUAL_ROWS})")))
    # The rows of one key are made by several tasks; a given number of partitions is left as it is, however small they look.
    equal = equal.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "part")
    equal = equal.withColumn("i", F.explode(F.expr(f"sequence(part * {EQUAL_ROWS} + 1, least(n - 1, (part + 1) * {EQUAL_ROWS}))")))
    out = out.unionByName(equal.select("key", "doc_id", "size", *about, (F.col("i") <= F.col("whole")).cast("double").alias("p")))
    left = F.greatest(F.col("n") * F.col("p") - F.col("whole"), F.lit(0.0))
    live = live.select("key", "doc_id", "size", *about, F.when(F.col("n") > 1, left).otherwise(F.col("p")).alias("p"))
    level = 0
    while most > 0:
        nodes = max(1, math.ceil(most / FAN_IN))
        node = F.pmod(F.xxhash64(F.lit(seed + level), "key", "doc_id"), F.lit(nodes)) if nodes > 1 else F.lit(0).cast("long")
        folded = (
            live.withColumn("node", node)
            .groupBy(*about, "node")
            .agg(F.sort_array(F.collect_list(F.struct("key", "doc_id", "size", "p"))).alias("docs"))
            .select(*about, _fold(seed + level).alias("f"))
        )
        folded = stored(folded, f"mix-level{level}", rows=n_rows)
        done = folded.select(*about, F.explode("f.done").alias("d"))
        out = out.unionByName(done.select("d.key", "d.doc_id", "d.size", *about, "d.p"))
        live = folded.filter("f.left is not null").select("f.left.key", "f.left.doc_id", "f.left.size", *about, "f.left.p")
        if nodes == 1:
            break
        most, level = nodes, level + 1
    out = out.unionByName(live)
    p = F.col("p")
    if last == "whole":
        p = F.round(p)
    whole = F.floor(p + TINY)
    out = out.withColumn("copies", (F.col("base") + whole).cast("long"))
    out = out.withColumn("partial_words", F.round((p - whole) * F.col("size")).cast("long"))
    out = out.withColumn("partial_words", F.greatest(F.col("partial_words"), F.lit(0).cast("long")))
    return out.select(
        "key", "doc_id", "source", "size", "source_size", "target", "copies", "partial_words",
        (F.col("copies") * F.col("size") + F.col("partial_words")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: int = 20240607, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, in whole copies."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    key, copies, rows_, n, nth, row, salt, base = (free(docs, f"_mix_{x}") for x in ("key", "copies", "rows", "n", "nth", "row", "salt", "base"))
    # Rows of one key are equal in every column, so it makes no difference which of them gets a copy more.
    whole_row = row_key(docs, seed, docs.columns)
    plan = mix(docs, seed=seed, last="whole", key=whole_row, **options)
    plan = stored(plan.groupBy(F.col("key").alias(key)).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows_)), "mix-plan")
    keyed = docs.withColumn(key, whole_row)
    out = keyed.join(plan.filter(F.col(rows_) == 1).filter(F.col(copies) > 0).select(key, F.col(copies).cast("int").alias(n)).hint("merge"), key)
    several = plan.filter(F.col(rows_) > 1)
    if not several.isEmpty():
        # Rows of one key share what the mix gave them, some get one more: numbers are given within salts, and the salts'
        # counts say how many come before. Rows are stored with their salts, so a lost task does not number them anew.
        same = keyed.join(several, key).withColumn(row, F.monotonically_increasing_id())
        same = stored(same.withColumn(salt, F.pmod(F.col(row), F.lit(SALTS))), "mix-equal")
        counts = same.groupBy(key, salt).agg(F.count(F.lit(1)).alias(n))
        before = F.coalesce(F.sum(n).over(Window.partitionBy(key).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select(key, salt, before.alias(base))
        order = Window.partitionBy(key, salt).orderBy(row)
        same = same.withColumn(nth, F.row_number().over(order)).join(counts, [key, salt])
        each = F.floor(F.col(copies) / F.col(rows_)) + (F.col(nth) + F.col(base) <= F.col(copies) % F.col(rows_)).cast("long")
        out = out.unionByName(same.select(*own, key, each.cast("int").alias(n)).filter(F.col(n) > 0))
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*own)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: the mix of all documents."""
    from .common import documents

    out = mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "partial_words")
