"""Remove word windows that also start earlier: count-min prefilter, exact second pass.

A window is ``size`` consecutive words. Each window is represented in the sketch by
its anchor, the smallest hash of the runs of ``ANCHOR`` words inside it. Equal
windows have equal anchors, so the sketch's count of the anchor is never below the
window's count: an overestimate, at a seventh of the insertions. Windows that
overlap an equal window by a run of words have one anchor for both; they show a
repeated run within one window and are always candidates.

The second pass hashes the candidate windows to 96 bits of their words and groups
them by these, in buckets of anchors. A partition first settles what repeats inside itself, so that a
window reaches the shuffle once per partition at most, however often it repeats.
The first occurrence, by document id and place, stays; each other window's words go.

Defined results: null and blank texts have no words and lose none; a null id sorts
before all others; rows with equal id and place are no earlier than each other, so
equal rows are treated alike (rows of one id with different texts are told apart by a
64-bit hash of the text); extra columns are not read, so names cannot clash; an
empty table gives an empty result. The words of one document are held at a
time, whatever its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.session import stored

from .common import documents, text_batches, trimmed
from .repeats import build, cell_bits
from .scan import join64, mix64, run_minimum, runs, words

#: Words of the runs from which a window takes its anchor.
ANCHOR = 8
NO_ID = -(2**63)
#: A partition's candidate windows that are settled at a time.
LOCAL_WINDOWS = 700_000
#: Buckets of anchors in the second pass: one per so many characters of text.
LEAST_BUCKETS, BUCKET_CHARS = 1024, 2_000_000


def _anchors(h: np.ndarray, room: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window's anchor, and whether a run of its words repeats within it."""
    gram = runs(h, anchor)
    low = run_minimum(gram, size - anchor + 1)
    again = np.zeros(len(h), dtype=bool)
    for d in range(1, size - anchor + 1):
        same = np.flatnonzero(gram[:-d] == gram[d:]) if len(gram) > d else []
        again[same] = True
        if len(same):
            again[np.asarray(same) + d] = True
    return low, again & room


def _sketched(size: int, anchor: int):
    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for w in words(batch.column("text")):
            room = w.room(size)
            at = np.flatnonzero(room)
            if not len(at):
                continue
            low = run_minimum(runs(w.hashes(), anchor), size - anchor + 1)[at]
            row = w.rows()[at]
            new = np.concatenate([[True], (low[1:] != low[:-1]) | (row[1:] != row[:-1])])
            start = np.flatnonzero(new)
            length = np.diff(np.append(start, len(low)))
            yield low[start]
            # One place serves as anchor for so many windows in a row; a longer run is of two.
            yield low[start[length > size - anchor + 1]]

    return values


#: A row is a bucket's windows from one partition (by runs: document, first place,
#: number of places; h1 and h2 hold each place's hash), or, in a bucket below 0, the
#: runs of one document that are already known to go.
_CANDIDATE = "bucket long, id array<long>, tkey array<long>, start array<int>, n array<int>, h1 binary, h2 binary"
_NAMES = ["bucket", "id", "tkey", "start", "n", "h1", "h2"]
_GONE = "id long, tkey long, gone array<int>"


def _run_starts(ids, keys, start, more=None) -> np.ndarray:
    """Where, in rows sorted by document and place, a run of neighbouring places begins."""
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]) | (start[1:] != start[:-1] + 1)
    if more is not None:
        new[1:] |= more[1:] != more[:-1]
    return np.flatnonzero(new)


def _different(*columns) -> np.ndarray:
    """Which of sorted rows differ from the one before."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _later(h1, h2, ids, start) -> tuple[np.ndarray, np.ndarray]:
    """The order in which rows were compared, and which of these rows start later than an equal window."""
    order = np.lexsort((start, ids, h2, h1))
    h1, h2, ids, start = h1[order], h2[order], ids[order], start[order]
    new = np.ones(len(h1), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, (ids != ids[first]) | (start != start[first])


def _gone_rows(ids, keys, start) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Per document the runs (first place, number) of the places given; equal rows are one document."""
    order = np.lexsort((start, keys, ids))
    order = order[_different(ids[order], keys[order], start[order])]
    ids, keys, start = ids[order], keys[order], start[order]
    at = _run_starts(ids, keys, start)
    n = np.diff(np.append(at, len(ids)))
    cut = np.flatnonzero(np.concatenate([[True], (ids[at][1:] != ids[at][:-1]) | (keys[at][1:] != keys[at][:-1])]))
    flat = np.stack([start[at], n], axis=1).astype(np.int32).ravel()
    return ids[at][cut], keys[at][cut], pa.ListArray.from_arrays(pa.array(2 * np.append(cut, len(at)), pa.int32()), pa.array(flat))


def _lists(cut: np.ndarray, end: int, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(cut, end), pa.int32()), pa.array(values))


def _candidates(size: int, anchor: int, buckets: int, sketch):
    """Candidate windows by bucket of their anchor; what repeats within the partition is settled here."""

    def settle(parts):
        low, h1, h2, ids, keys, start = (np.concatenate(x) for x in zip(*parts))
        order, later = _later(h1, h2, ids, start)
        go = order[later]
        if len(go):
            i, k, gone = _gone_rows(ids[go], keys[go], start[go])
            one = np.arange(len(i))
            none = pa.nulls(len(i), pa.binary())
            own = -1 - (mix64(i.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), _lists(one, len(i), i), _lists(one, len(i), k), gone, pa.nulls(len(i), pa.list_(pa.int32())), none, none], names=_NAMES
            )
        stay = order[~later]
        if len(stay):
            bucket = (mix64(low[stay]) % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((start[stay], keys[stay], ids[stay], bucket))
            by = by[_different(bucket[by], ids[stay[by]], keys[stay[by]], start[stay[by]])]  # equal rows send their windows once
            stay, bucket = stay[by], bucket[by]
            ids, keys, start = ids[stay], keys[stay], start[stay]
            at = _run_starts(ids, keys, start, bucket)
            n = np.diff(np.append(at, len(stay))).astype(np.int32)
            cut = np.flatnonzero(np.concatenate([[True], bucket[at][1:] != bucket[at][:-1]]))
            place = np.append(at[cut], len(stay))
            h1, h2 = h1[stay], h2[stay].astype(np.uint32)
            for lo in range(0, len(cut), 256):  # a few buckets a batch
                hi = min(lo + 256, len(cut))
                r = slice(cut[lo], cut[hi] if hi < len(cut) else len(at))
                where, end = cut[lo:hi] - cut[lo], r.stop - r.start
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[at[cut[lo:hi]]]), _lists(where, end, ids[at[r]]), _lists(where, end, keys[at[r]]),
                        _lists(where, end, start[at[r]]), _lists(where, end, n[r]),
                        pa.array([h1[place[j] : place[j + 1]].tobytes() for j in range(lo, hi)], pa.binary()),
                        pa.array([h2[place[j] : place[j + 1]].tobytes() for j in range(lo, hi)], pa.binary()),
                    ],
                    names=_NAMES,
                )

    def find(batches):
        known, parts, n = sketch.value, [], 0
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            keys = batch.column("tkey").to_numpy(zero_copy_only=False)
            for w in words(batch.column("text")):
                room = w.room(size)
                if not room.any():
                    continue
                a = w.hashes()
                low, again = _anchors(a, room, size, anchor)
                at = np.flatnonzero(room)
                at = at[again[at] | known.maybe(low[at])]
                if not len(at):
                    continue
                row = w.rows()[at]
                place = (at - w.first[row - w.row]).astype(np.int32)
                parts.append((low[at], runs(a, size)[at], runs(join64(w.hashes(1), a), size)[at] & np.uint64(0xFFFFFFFF), ids[row], keys[row], place))
                n += len(at)
                if n > LOCAL_WINDOWS:
                    yield from settle(parts)
                    parts, n = [], 0
        if parts:
            yield from settle(parts)

    return find


def _settle_bucket(table: pa.Table) -> pa.Table:
    """The windows of one bucket, from all partitions, that start later than an equal one."""
    if table.column("bucket")[0].as_py() < 0:
        first = pa.compute.list_element
        return pa.table({"id": first(table.column("id"), 0), "tkey": first(table.column("tkey"), 0), "gone": table.column("start")})
    flat = {c: pa.concat_arrays([x.flatten() for x in table.column(c).chunks]).to_numpy() for c in ("id", "tkey", "start", "n")}
    n = flat["n"]
    run = np.repeat(np.arange(len(n)), n)
    start = (flat["start"][run] + np.arange(len(run)) - (np.cumsum(n) - n)[run]).astype(np.int32)
    ids, keys = flat["id"][run], flat["tkey"][run]
    h1 = np.frombuffer(b"".join(table.column("h1").to_pylist()), dtype=np.uint64)
    h2 = np.frombuffer(b"".join(table.column("h2").to_pylist()), dtype=np.uint32)
    order, later = _later(h1, h2, ids, start)
    go = order[later]
    if not len(go):
        return pa.table({"id": pa.array([], pa.int64()), "tkey": pa.array([], pa.int64()), "gone": pa.array([], pa.list_(pa.int32()))})
    i, k, gone = _gone_rows(ids[go], keys[go], start[go])
    return pa.table({"id": i, "tkey": k, "gone": gone})


_KEYED = "doc_id long, id long, tkey long, text string"


def _keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    ids, keys = (batch.column(c).to_numpy().view(np.uint64) for c in ("id", "tkey"))
    yield mix64(join64(ids, keys))


def _split(losing, there: bool):
    """The rows whose id and text the bitmap may hold, or the others."""

    def keep(batches):
        for batch in batches:
            for key in _keys(batch):
                yield batch.filter(pa.array(losing.value.maybe(key) == there))

    return keep


def _kept(size: int):
    """Adds n_words, n_removed and the kept text to rows of id, text, gone (runs of windows that go: first place, number)."""

    def cut(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            gone = batch.column("gone").to_pylist()
            out = []
            for text, starts in zip(texts, gone):
                w = (text or b"").split()
                n = len(w)
                if starts:
                    edge = np.zeros(n + 1, dtype=np.int32)
                    at, many = np.asarray(starts).reshape(-1, 2).T
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + many - 1 + size, -1)
                    w = [w[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                out.append((n, n - len(w), b" ".join(w)))
            n, r, t = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(t, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return cut


def remove_repeats(docs: DataFrame, size: int = 20, anchor: int = ANCHOR, rows: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) of each row of ``docs``."""
    spark = docs.sparkSession
    anchor = max(1, min(anchor, size))
    rows_in = text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = rows_in.select(
        "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tkey"), "text"
    )
    # The sketch is sized by all characters: about six a word, a window's anchor lasts some places.
    chars = rows_in.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = cell_bits(2.0 * chars / 6 / (size - anchor + 2))
    sketch = spark.sparkContext.broadcast(build(rows_in.select("text"), _sketched(size, anchor), rows, bits)[0])
    buckets = max(LEAST_BUCKETS, -(-chars // BUCKET_CHARS))
    found = keyed.select("id", "tkey", "text").mapInArrow(trimmed(_candidates(size, anchor, buckets, sketch)), _CANDIDATE)
    later = (
        found.groupBy("bucket").applyInArrow(_settle_bucket, _GONE)
        .groupBy("id", "tkey").agg(F.flatten(F.collect_set("gone")).alias("gone"))  # equal rows of several partitions send equal lists
    )
    later = stored(later, "gone")
    sketch.destroy()
    # Texts that lose nothing are finished where they are; only the others move.
    losing = build(later.select("id", "tkey"), _keys, 1, cell_bits(later.count(), per_value=16.0), least=1)[0]
    losing = spark.sparkContext.broadcast(losing)

    def whole(batches):
        for batch in _split(losing, False)(batches):
            yield from _kept(size)([pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.nulls(batch.num_rows, pa.list_(pa.int32()))], names=["doc_id", "text", "gone"])])

    moved = keyed.select("doc_id", "id", "tkey", "text").mapInArrow(_split(losing, True), _KEYED).join(later, ["id", "tkey"], "left")
    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    return keyed.select("doc_id", "id", "tkey", "text").mapInArrow(whole, schema).unionByName(moved.select("doc_id", "text", "gone").mapInArrow(_kept(size), schema))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: what stays of all documents when repeated 20-word windows go."""
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL = rf"""
with d as (select doc_id, row_number() over () as rid, {_W} as w from documents),
p as (select rid, doc_id, i, array_to_string(w[i:i + 19], ' ') as s from d, unnest(range(1, len(w) - 18)) u(i)),
f as (select rid, i, doc_id, first_value((doc_id, i)) over (partition by s order by doc_id, i) as f from p),
g as (select distinct rid, unnest(range(i, i + 20)) as i from f where (doc_id, i) > f),
k as (select rid, count(*) as n, list(i) as gone from g group by rid)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed,
  sha256(array_to_string(case when n is null then w else list_filter(w, lambda x, j: not list_contains(gone, j)) end, ' ')) as kept_sha256
from d left join k using (rid)
"""
