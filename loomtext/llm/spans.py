"""Long exact spans shared between records: seed and extend, without pairs.

Seeds are winnowed k-gram anchors: every stretch of ``min_chars`` code points
holds at least one, so a span shared by two records has a common seed.  Seeds
that stand in one record only are dropped by an aggregation.  Around the others
the match is extended both ways, one code point at a time, by grouping equal
windows of ``min_chars`` instead of comparing pairs: overlapping shared windows
join to the maximal repeats.  A span common to very many records therefore
costs as much as its occurrences, never their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import small, table

MIN_CHARS = 100
#: Code points hashed together by Python at once.
BLOCK_CHARS = 2_000_000

#: Two independent hashes; together 128 bits tell windows, texts and records apart.
_BASE, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing of code points (splitmix)."""
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def gram_hashes(codes: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """Hash of the k-gram at each position of ``codes`` (len - k + 1 of them)."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(codes.astype(np.uint64) ^ np.uint64(base >> 32)) * _powers(base, n), out=prefix[1:])
    h = (prefix[k:] - prefix[:-k]) * _powers(pow(base, -1, 1 << 64), n - k + 1)
    return h ^ (h >> np.uint64(29))


def sliding(a: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over every window of ``w`` values (len - w + 1 of them), in linear time."""
    n = len(a)
    if n < w:
        return a[:0]
    pad = (-n) % w
    b = np.concatenate([a, np.full(pad, a[-1], a.dtype)]).reshape(-1, w)
    left = f.accumulate(b, axis=1).ravel()
    right = f.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(right[: n - w + 1], left[w - 1 : n])


def winnow(codes: np.ndarray, record: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of concatenated records.

    A k-gram is an anchor if it is smallest in some window of ``w`` k-grams
    that lies inside one record.
    """
    span = k + w - 1
    if len(codes) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(codes, k)
    least = sliding(h, w, np.minimum)
    inside = record[: len(least)] == record[span - 1 :]
    least = np.where(inside, least, np.uint64(0))
    edge = np.zeros(w - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), w, np.maximum)
    at = np.flatnonzero((most == h) & (most > 0))
    return at, h[at]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return codes, np.repeat(np.arange(len(texts)), size), np.concatenate(([0], np.cumsum(size)))


def _blocks(batches: Iterator[pa.RecordBatch], column: int, least: int):
    """Blocks of rows (as lists of columns) with bounded total length; shorter texts left out."""
    rows, chars = [], 0
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns]):
            if r[column] is not None and len(r[column]) >= least:
                rows.append(r)
                chars += len(r[column])
                if chars >= BLOCK_CHARS:
                    yield list(zip(*rows))
                    rows, chars = [], 0
    if rows:
        yield list(zip(*rows))


def _anchors(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, texts in _blocks(batches, 1, k + w - 1):
            codes, record, first = _codes(texts)
            at, h = winnow(codes, record, k, w)
            r = record[at]
            yield pa.record_batch(
                [pa.array(np.array(rid, np.int64)[r]), pa.array((at - first[r]).astype(np.int32)), pa.array(h.view(np.int64))], names=["rid", "pos", "h"])

    return run


def _windows(k: int, span: int):
    names = ["c", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *ids, texts, seeds in _blocks(batches, len(names), span):
            codes, record, first = _codes(texts)
            mark = np.zeros(len(codes) + 1, np.int64)
            for i, s in enumerate(seeds):
                s = np.array(s, np.int64)
                last = len(texts[i]) - span  # last start of a window
                np.add.at(mark, first[i] + np.maximum(s - (span - k), 0), 1)
                np.add.at(mark, first[i] + np.minimum(s, last) + 1, -1)
            at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            r = record[at]
            yield pa.record_batch(
                [pa.array(np.array(x, np.int64)[r]) for x in ids] + [pa.array((at - first[r]).astype(np.int32))]
                + [pa.array(gram_hashes(codes, span, b)[at].view(np.int64)) for b in (_BASE, _SECOND)],
                names=[*names, "pos", "h", "h2"])

    return run


def shared_spans(records: DataFrame, kind: str, key: str, text: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(kind, key, shared_chars): code points of a record in spans that another record also holds.

    A span counts if it has at least ``min_chars`` code points and stands
    exactly in a record of another (kind, key).  Records without one have no
    row.  Null keys and texts and shorter texts share nothing.  A repeated row
    counts once; a key given with several texts gets the largest of their
    values and is never its own partner.  Extra columns are ignored.  Windows of
    ``min_chars`` and texts are told apart by two 64-bit hashes each.  One is enough for anchors, which only
    propose where windows are compared, and for records, of which just those that share a window are compared.
    """
    k = min_chars // 2
    w = min_chars - k + 1
    rec = records.select(F.col(kind).alias("kind"), F.col(key).alias("key"), F.col(text).alias("text")).where(
        F.col("key").isNotNull() & (F.length("text") >= min_chars)
    ).withColumn("rid", F.xxhash64("kind", "key"))

    anchors = table(rec.select("rid", "text").mapInArrow(_anchors(k, w), "rid bigint, pos int, h bigint"), "anchors")
    common = table(anchors.groupBy("h").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi").select("h"), "common")
    seeds = table(anchors.join(small(common), "h", "left_semi").groupBy("rid").agg(F.collect_set("pos").alias("seeds")), "seeds")

    # Records with a seed; exact copies are one class that is extended once.
    same = ["th", "th2"]
    live = rec.join(small(seeds), "rid").withColumn("th", F.xxhash64("text", F.length("text"))).withColumn("th2", F.xxhash64(F.lit(_SECOND >> 1), "text"))
    classes = live.groupBy(*same).agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.max("text").alias("text"), F.max("seeds").alias("seeds"))
    classes = table(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    windows = table(
        classes.select("c", "lo", "hi", "text", "seeds").mapInArrow(_windows(k, min_chars), "c bigint, lo bigint, hi bigint, pos int, h bigint, h2 bigint"), "windows")
    repeated = windows.groupBy("h", "h2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("h", "h2")
    covered = (
        windows.select("c", "pos", "h", "h2").join(repeated.hint("merge"), ["h", "h2"], "left_semi").groupBy("c").agg(F.sort_array(F.collect_set("pos")).alias("p"))
        .select("c", F.expr(
            "aggregate(p, named_struct('n', 0L, 'e', 0L), (a, s) -> named_struct("
            f"'n', a.n + s + {min_chars} - greatest(a.e, cast(s as bigint)), 'e', cast(s + {min_chars} as bigint)), a -> a.n)"
        ).alias("shared_chars"))
    )
    covered = classes.select("c", *same).join(covered, "c").drop("c")
    return (
        live.select("kind", "key", *same).join(covered, same)
        .groupBy("kind", "key").agg(F.max("shared_chars").alias("shared_chars"))
        .select(F.col("kind").alias(kind), F.col("key").alias(key), "shared_chars")
    )
