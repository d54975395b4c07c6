"""Grouped prefix join: components of documents whose word-shingle sets are similar.

Tokens of a document are its distinct shingles as 64-bit hashes, in one order for
all documents: first those that the sketch saw once, then those that may repeat,
then those that are frequent in some partition, by frequency; ties by hash. Two
similar sets share a token of their prefixes, the first n - ceil(t n) + 1 tokens.
Any fixed order is right; this one keeps frequent shingles out of prefixes.

1. Documents with equal sets are one node. Nodes with identical prefix and size are
   one group; only groups are posted, under the prefix tokens that may repeat.
2. Stars: under each token and size class the group with the fewest rarer tokens is
   the centre. Each member of the others, in its own and the next size classes, is
   paired with the centre's leader, and each member of a group with its own leader.
   Pairs that pass the size and position filters are verified.
3. What the links so far connect needs no more pairs. Under each token, groups form
   classes by size, position and component; where two such classes, of one size class or of
   neighbouring ones, pass the filters and are not of one component, their groups, and of these the members of
   different components, are paired and verified. So every similar pair is verified or already connected,
   and a large component never meets itself.
4. Components over all links; the smallest document id names each.

Sets are made again for the nodes that pairs can ask for, found by a bitmap of their
identities, so that no table holds the shingles of all documents.

Verification first bounds the overlap by counts of tokens in 256 cells, then
intersects the sets. No step holds all pairs of a group; postings, pairs and links
are joined by key, with hot keys left to adaptive splitting.

Defined results: null and blank texts have no shingles and are their own component;
a text with fewer words than a shingle has its whole word sequence as one shingle;
repeated rows have one set and so one component; null ids never name a component
unless it has no other; an empty table gives an empty result; extra columns are not
read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.session import drop_stored, stored

from .common import SPACE, documents, free, text_batches, trimmed
from .components import components, spread_join
from .repeats import build, cell_bits
from .scan import mix64, runs, words

#: A token that some partition holds so often is ordered by its frequency.
HEAVY = 3
CELLS = 256


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each row of a text column."""
    for w in words(column, lower=True):
        h = w.hashes()
        gram = runs(h, k)
        for r in range(w.n_rows):
            lo, hi = w.first[r], w.first[r + 1]
            if hi - lo >= k:
                yield w.row + r, np.unique(gram[lo : hi - k + 1])
            elif hi > lo:
                yield w.row + r, runs(h[lo:hi], int(hi - lo))[:1]
            else:
                yield w.row + r, np.zeros(0, dtype=np.uint64)


def _sketched(k: int):
    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        held, n = [], 0
        for _, s in _sets(batch.column("text"), k):
            held.append(s)
            n += len(s)
            if n > 200_000:
                yield np.concatenate(held)
                held, n = [], 0
        if n:
            yield np.concatenate(held)

    return values


def _digest(tokens: np.ndarray, n: int) -> bytes:
    """128 bits of a set of tokens and a number."""
    a = mix64(tokens).sum(dtype=np.uint64) + np.uint64(n)
    b = mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) ^ np.uint64(n)
    return mix64(np.array([a, b], dtype=np.uint64)).astype(">u8").tobytes()


_DOC = "doc_id long, tkey long, n long, node binary, grp binary, token array<long>, pos array<int>"
_SET = "node binary, n long, cells binary, tokens binary"


def _prefixes(k: int, percent: int, shared):
    """Per document its set's identity, size, group and posted prefix tokens (null if none)."""

    def find(batches):
        known, heavy, weight = shared.value
        level = np.floor(np.log2(weight)).astype(np.uint8) + 2 if len(weight) else None
        for batch in batches:
            ids = list(zip(batch.column("doc_id").to_pylist(), batch.column("tkey").to_pylist()))
            out = []
            for row, s in _sets(batch.column("text"), k):
                n = len(s)
                if not n:
                    out.append((*ids[row], 0, None, None, None, None))
                    continue
                rank = known.maybe(s).astype(np.uint8)
                if level is not None:
                    at = np.searchsorted(heavy, s)
                    at[at == len(heavy)] = 0
                    often = heavy[at] == s
                    rank[often] = level[at[often]]
                p = n + (-percent * n // 100) + 1
                order = np.argsort(rank, kind="stable")[:p]
                prefix, post = s[order], np.flatnonzero(rank[order] > 0)
                token, pos = (prefix[post].view(np.int64), post.astype(np.int32)) if len(post) else (None, None)
                out.append((*ids[row], n, _digest(s, n), _digest(prefix, n), token, pos))
                if len(out) >= 2000:
                    yield _doc_batch(out)
                    out = []
            if out:
                yield _doc_batch(out)

    return find


def _doc_batch(rows) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["doc_id", "tkey", "n", "node", "grp", "token", "pos"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)


def _node_values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The first 64 bits of node identities."""
    yield np.array([int.from_bytes(x[:8], "big") for x in batch.column(0).to_pylist()], dtype=np.uint64)


def _chosen_sets(k: int, known):
    """The sets of nodes that ``known`` may hold, each once per partition."""

    def some(held, members, seen):
        first = np.array([int.from_bytes(d[:8], "big") for d, _ in held], dtype=np.uint64)
        out = []
        for i in np.flatnonzero(members.maybe(first)):
            node, s = held[i]
            if node not in seen:
                seen.add(node)
                cells = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=CELLS).astype("<u4")
                cells = cells.astype(np.uint8).tobytes() if cells.max() <= 255 else cells.tobytes()
                out.append((node, len(s), cells, s.tobytes()))
        return [_set_batch(out)] if out else []

    def find(batches):
        members, seen = known.value, set()
        for batch in batches:
            held, size = [], 0
            for _, s in _sets(batch.column("text"), k):
                if len(s):
                    held.append((_digest(s, len(s)), s))
                    size += len(s)
                if size > 200_000:
                    yield from some(held, members, seen)
                    held, size = [], 0
            if held:
                yield from some(held, members, seen)

    return find


def _set_batch(rows) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["node", "n", "cells", "tokens"])


def _counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8 if len(raw) == CELLS else "<u4").astype(np.int64)


def _bound(percent: int):
    """Keep pairs (a, b, n1, n2, c1, c2) whose cell counts allow enough overlap."""

    def keep(batches):
        for batch in batches:
            n1, n2 = (batch.column(c).to_numpy() for c in ("n1", "n2"))
            most = np.fromiter(
                (np.minimum(_counts(x), _counts(y)).sum() for x, y in zip(batch.column("c1").to_pylist(), batch.column("c2").to_pylist())),
                dtype=np.int64, count=batch.num_rows,
            )
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * most >= percent * (n1 + n2)))

    return keep


def _similar(percent: int):
    """Keep pairs (a, b, s1, s2) whose sets are similar enough."""

    def keep(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("s1").to_pylist(), batch.column("s2").to_pylist()):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                same = int((large[at] == small).sum())
                good.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return keep


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of nodes that are similar, as a stored table."""
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    cells = sets.select("node", "n", "cells")
    for side in ("1", "2"):
        key = "a" if side == "1" else "b"
        pairs = spread_join(pairs, cells.select(F.col("node").alias(key), F.col("n").alias(f"n{side}"), F.col("cells").alias(f"c{side}")), [key])
    near = pairs.select("a", "b", "n1", "n2", "c1", "c2").mapInArrow(_bound(percent), "a binary, b binary")
    near = stored(near, f"{name}-near")
    joined = near
    for side in ("1", "2"):
        key = "a" if side == "1" else "b"
        joined = spread_join(joined, sets.select(F.col("node").alias(key), F.col("tokens").alias(f"s{side}")), [key])
    links = stored(joined.select("a", "b", "s1", "s2").mapInArrow(trimmed(_similar(percent)), "a binary, b binary"), f"{name}-links")
    drop_stored(near)
    return links


def _passes(percent: int, n1: str, p1: str, n2: str, p2: str) -> str:
    """SQL: sizes and positions of a shared token allow a similar pair."""
    return (
        f"100 * least({n1}, {n2}) >= {percent} * greatest({n1}, {n2}) and "
        f"{100 + percent} * (1 + least({n1} - {p1} - 1, {n2} - {p2} - 1)) >= {percent} * ({n1} + {n2})"
    )


def similar_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), tkey of each row of ``docs``.

    Documents link when 100 * overlap >= percent * union of their sets of ``k``-word
    shingles, words lower-cased in A-Z. ``tkey`` is Spark's xxhash64 of the text (null: empty).
    """
    spark = docs.sparkSession
    rows = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tkey"), F.col("text").cast("string").alias("text"))
    chars, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).head()
    bits = cell_bits(chars / 6, per_value=1.0)
    shared = spark.sparkContext.broadcast(build(rows.select("text"), _sketched(k), 1, bits, heavy=HEAVY))
    found = stored(rows.mapInArrow(trimmed(_prefixes(k, percent, shared)), _DOC), "sets")
    shared.destroy()
    posted = found.filter("token is not null")
    nodes = stored(posted.select("node", "grp").distinct(), "nodes", rows=n_rows)
    leads = stored(nodes.groupBy("grp").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("members")), "groups", rows=n_rows)
    # Nodes of a group have equal prefixes and sizes: any one stands for the group.
    groups = posted.groupBy("grp").agg(F.first("n").alias("n"), F.first("token").alias("token"), F.first("pos").alias("pos"))
    posts = groups.select("grp", "n", F.explode(F.arrays_zip("token", "pos")).alias("t")).select("grp", "n", "t.token", "t.pos")
    # Sizes that pass the size filter are of one class or of neighbouring ones, with a hundredth to spare.
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(max(percent - 1, 1) / 100))).cast("int")
    met = posts.groupBy("token").agg(F.count(F.lit(1)).alias("posts")).filter("posts > 1").select("token")
    posts = stored(spread_join(posts, met, ["token"]).withColumn("size_class", size_class), "posts")

    # Only sets that some pair can ask for are made and kept.
    asked = posts.select("grp").unionByName(leads.filter("members > 1").select("grp")).distinct()
    asked = stored(nodes.join(asked, "grp", "left_semi").select("node"), "asked", rows=n_rows)
    known = spark.sparkContext.broadcast(build(asked, _node_values, 1, cell_bits(asked.count(), per_value=16.0), least=1)[0])
    made = rows.select("text").mapInArrow(trimmed(_chosen_sets(k, known)), _SET)
    sets = stored(made.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "cells", "tokens")]), "chosen-sets")
    known.destroy()

    centres = posts.groupBy("token", "size_class").agg(F.min_by(F.struct("grp", "n", "pos"), F.struct("pos", "n", "grp")).alias("c"))
    spread = posts.withColumn("size_class", F.explode(F.array(F.col("size_class") - 1, F.col("size_class"), F.col("size_class") + 1)))
    stars = (
        spread_join(spread, centres, ["token", "size_class"]).filter("grp != c.grp")
        .filter(_passes(percent, "n", "pos", "c.n", "c.pos")).select("grp", F.col("c.grp").alias("centre")).distinct()
    )
    stars = spread_join(stars, leads.select(F.col("grp").alias("centre"), F.col("lead").alias("b")), ["centre"])
    pairs = stars.join(nodes, "grp").select(F.col("node").alias("a"), "b")
    own = spread_join(nodes, leads.filter("members > 1"), ["grp"]).select(F.col("node").alias("a"), F.col("lead").alias("b"))
    links = _verified(pairs.unionByName(own), sets, percent, "stars")
    roots = components(links, n_rows)

    rooted = nodes.select("node", "grp").join(roots, "node", "left").select("node", "grp", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "rooted", rows=n_rows)
    of = rooted.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    posts_rooted = left = stored(spread_join(posts, of, ["grp"]), "posts-rooted")
    several = left.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l != h").select("token")
    left = spread_join(left, several, ["token"])
    # A class is of one component, or (empty) of groups that hold several; classes of one component need not meet.
    left = left.withColumn("of", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(b"")))
    classes = left.select("token", "n", "pos", "size_class", "of").distinct()
    x, y = (classes.select("token", "size_class", *[F.col(c).alias(c + i) for c in ("n", "pos", "of")]) for i in "12")
    x = x.withColumn("size_class", F.explode(F.array(F.col("size_class"), F.col("size_class") + 1)))  # the larger one is here or next
    open_pairs = (
        x.join(y, ["token", "size_class"]).filter("n1 < n2 or (n1 = n2 and (pos1 < pos2 or (pos1 = pos2 and of1 <= of2)))")
        .filter("of1 != of2 or of1 = X''").filter(_passes(percent, "n1", "pos1", "n2", "pos2")).select("token", "n1", "pos1", "of1", "n2", "pos2", "of2")
    )
    open_pairs = stored(open_pairs, "open-classes")
    side = lambda i: left.select("token", *[F.col(c).alias(c + i) for c in ("n", "pos", "of", "grp")])
    cross = (
        side("1").join(open_pairs, ["token", "n1", "pos1", "of1"]).join(side("2"), ["token", "n2", "pos2", "of2"])
        .filter("grp1 != grp2").select(F.least("grp1", "grp2").alias("grp1"), F.greatest("grp1", "grp2").alias("grp2")).distinct()
    )
    inside = of.filter("low != high").select(F.col("grp").alias("grp1"), F.col("grp").alias("grp2"))
    # Of two groups, or one with itself, the members of different components meet; those of one component never do.
    parts = rooted.select("grp", "root").distinct()
    p1, p2 = (parts.select(F.col("grp").alias("grp" + i), F.col("root").alias("r" + i)) for i in "12")
    apart = cross.unionByName(inside).join(p1, "grp1").join(p2, "grp2").filter("if(grp1 = grp2, r1 < r2, r1 != r2)")
    m1, m2 = (rooted.select(F.col("grp").alias("grp" + i), F.col("node").alias("ab"[int(i) - 1]), F.col("root").alias("r" + i)) for i in "12")
    rest = apart.join(m1, ["grp1", "r1"]).join(m2, ["grp2", "r2"]).select("a", "b")
    more = _verified(rest, sets, percent, "rest")
    drop_stored(rooted, posts_rooted, open_pairs, posts, sets, asked, leads)
    if not more.isEmpty():
        roots = components(links.unionByName(more), n_rows)

    named = found.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("d")).join(roots, "node", "left")
    named = stored(named.select("node", F.coalesce("root", "node").alias("root"), "d"), "named", rows=n_rows)
    names = spread_join(named, named.groupBy("root").agg(F.min("d").alias("component_id")), ["root"]).select("node", "component_id", F.col("root").alias("component"))
    return (
        spread_join(found.select("doc_id", "tkey", "n", "node"), names, ["node"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "tkey", "component")
    )


def text_key():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without all but one of each component: that of the smallest id (null last).

    Rows without words are in no component and all stay.
    """
    rows = stored(similar_components(docs, k, percent), "components")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")
    chosen = rows.filter("component is not null").groupBy("component").agg(F.min(first).alias("f")).select(F.col("f.doc_id").alias("doc_id"), F.col("f.tkey").alias("tkey"))
    chosen = stored(chosen, "chosen")
    id_, key, chosen_key, own = free(docs, "_id"), free(docs, "_tkey"), free(docs, "_chosen"), [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, text_key())
    wordless = F.coalesce(F.regexp_replace(F.col("text").cast("string"), SPACE + "+", ""), F.lit("")) == ""
    match = (F.col("`doc_id`").cast("long").eqNullSafe(F.col(id_))) & (F.col(key) == F.col(chosen_key))
    kept = keyed.filter(~wordless).join(chosen.select(F.col("doc_id").alias(id_), F.col("tkey").alias(chosen_key)), match, "left_semi")
    if rows.filter("component is not null").groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", key])  # equal rows: either stands for both
    return kept.select(*own).unionByName(docs.filter(wordless).select(*own))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: components of all documents."""
    return similar_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


SQL = r"""
with recursive d as (select doc_id, row_number() over () as rid,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select rid, doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from d),
t as (select rid, unnest(s) as t from s),
o as (select a.rid as a, b.rid as b, count(*) as n from t a join t b on a.t = b.t and a.rid < b.rid group by all),
l as (select a, b from o join s x on x.rid = a join s y on y.rid = b where 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
e as (select a, b from l union all select b, a from l),
r as (select rid, doc_id as c from s union select e.b, r.c from r join e on r.rid = e.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, m.c as component_id
from s join (select rid, min(c) as c from r group by rid) m using (rid)
"""
