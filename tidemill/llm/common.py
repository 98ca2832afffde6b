"""Shared helpers: scratch tables in the cluster's shared folder, word hashing, connected components."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parents[2]
#: Entries that a worker's word cache holds before it is emptied.
CACHE_WORDS = 300_000
#: Keys that hold more than one row in so many are joined by broadcast; there can't be more such keys than that.
HOT = 1024
#: Bits of the map that ``likely`` broadcasts (8 MB).
BITS = 1 << 26
#: Words are runs of anything but these six ASCII characters; bytes.split() uses the same six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, unless they find it by PYTHONPATH already."""
    sc = spark.sparkContext
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT) in known or getattr(sc, "_tidemill_shipped", False):
        return
    path = Path(tempfile.mkdtemp()) / "tidemill.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in (ROOT / "tidemill").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(path))
    sc._tidemill_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of our own only where that is unset."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        where = tempfile.mkdtemp(prefix="tidemill-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: a lost executor costs no earlier work."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more."""
    home = shared_dir(spark).split(":", 1)[-1].replace("//", "/")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if folder.split(":", 1)[-1].replace("//", "/").startswith(home):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


_LIVE: list[dict] = []


def sole(cache: dict) -> dict:
    """The cache, after the one that this worker filled for another operator is emptied: a worker that serves many stages holds one at a time."""
    if not _LIVE or _LIVE[0] is not cache:
        for other in _LIVE:
            other.clear()
        _LIVE[:] = [cache]
    return cache


def lean(work: Callable) -> Callable:
    """``work``, after which the Python worker gives freed memory back to the system; workers are reused by many stages and share a small budget."""

    def done(out):
        if hasattr(out, "__next__"):
            return _released(out)
        _release()
        return out

    def one(part):
        _mallopt()
        return done(work(part))

    def two(left, right):
        _mallopt()
        return done(work(left, right))

    return one if work.__code__.co_argcount == 1 else two  # Spark counts the arguments


def _released(parts: Iterator) -> Iterator:
    try:
        yield from parts
    finally:
        _release()


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: its own policy holds
        return None


@functools.cache
def _mallopt() -> None:
    if _libc():
        _libc().mallopt(-3, 8 << 20)  # M_MMAP_THRESHOLD: arrays from 8 MB on are unmapped as soon as they are freed


def _release() -> None:
    pa.default_memory_pool().release_unused()
    if _libc():
        _libc().malloc_trim(0)


class WordHash(dict):
    """Word to 64-bit hash, equal in all workers; emptied when full, so memory is bounded."""

    def __missing__(self, word: str | bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(sole(self).__getitem__, words), np.uint64, len(words))


#: Bytes hashed at once, and the longest word that is hashed this way; a longer one takes its xxh3.
BLOCK, LONG_WORD = 1 << 18, 1 << 16
#: Bytes of a run of short texts that are hashed together.
TOGETHER = 1 << 20


@functools.cache
def _word_tables() -> tuple[np.ndarray, ...]:
    """(which bytes part words, a random number for each byte, powers of an odd base, powers of its inverse); equal in all workers."""
    gap = np.zeros(256, bool)
    gap[[9, 10, 11, 12, 13, 32]] = True
    code = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    code[gap] = 0
    base = 0x9E3779B97F4A7C15
    power = lambda b: np.multiply.accumulate(np.r_[np.uint64(1), np.full(BLOCK, b, np.uint64)])
    return gap, code, power(base), power(pow(base, -1, 1 << 64))


def _words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, 64-bit hash) of every word of some bytes: differences of prefix sums of a polynomial modulo 2**64, scrambled."""
    gap, code, power, inverse = _word_tables()
    x = np.frombuffer(data, np.uint8)
    apart = np.empty(len(x) + 2, bool)
    apart[0] = apart[-1] = True
    np.take(gap, x, out=apart[1:-1])
    edge = np.flatnonzero(apart[1:] != apart[:-1])
    first, end = edge[::2], edge[1::2]
    out = np.empty(len(first), np.uint64)
    k = 0
    while k < len(first):
        at = int(first[k])
        stop = max(k + 1, int(np.searchsorted(end, at + BLOCK, "right")))
        if int(end[k]) - at > LONG_WORD:
            out[k] = xxhash.xxh3_64_intdigest(data[at : int(end[k])])
            k += 1
            continue
        sums = np.empty(int(end[stop - 1]) - at + 1, np.uint64)
        sums[0] = 0
        np.cumsum(code[x[at : at + len(sums) - 1]] * power[: len(sums) - 1], out=sums[1:])
        a, b = first[k:stop] - at, end[k:stop] - at
        h = (sums[b] - sums[a]) * inverse[a]
        out[k:stop] = mix64(h + (b - a).astype(np.uint64) * power[3])
        for j in np.flatnonzero(b - a > LONG_WORD).tolist():
            out[k + j] = xxhash.xxh3_64_intdigest(data[int(first[k + j]) : int(end[k + j])])
        k = stop
    return first, out


def word_ids(texts: Iterable[str | None], lower: bool = False) -> Iterator[np.ndarray]:
    """For every text the 64-bit hashes of its words (``WORD``), without a Python object for any word. Short texts are hashed together."""
    some: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        first, ids = _words_of(b"\n".join(some))
        starts = np.cumsum([0, *(len(x) + 1 for x in some)])
        cuts = np.searchsorted(first, starts).tolist()
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield ids[i:j]

    for text in texts:
        b = ((text.lower() if lower else text) if text else "").encode("utf-8", "surrogatepass")
        if some and size + len(b) > TOGETHER:
            yield from flush()
            some, size = [], 0
        some.append(b)
        size += len(b) + 1
    if some:
        yield from flush()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def rolling(ids: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all windows of ``width`` ids; empty if there are fewer."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(base)
        out += ids[k : k + n]
    return out


def crc_bucket(id_col: str, n: int):
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(n)


def join_hot(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``facts`` (one row for each key, not null, with its number of ``rows`` in column ``size``; the column is dropped).

    Keys that hold a ``HOT``-th of all rows or more, of which there are ``HOT`` at most, are broadcast; the others are shuffled, so no task gets more than
    a ``HOT``-th of the rows for one key."""
    least = max(2, -(-total // HOT))
    hot, cold = facts.filter(F.col(size) >= least).drop(size), facts.filter(F.col(size) < least).drop(size)
    mine = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return mine.unionByName(rest)


def likely(rows: DataFrame, keys: DataFrame, key: str, others: bool = False) -> DataFrame:
    """Rows whose key may be among the keys (with ``others``: those whose key surely isn't), by a bitmap of ``BITS`` hashed keys that is broadcast: it keeps most other rows
    out of a shuffle that follows. Its size is fixed, whatever the data; when it is full it tells nothing apart and all rows go into that exact join."""
    place = F.pmod(F.xxhash64(key), F.lit(BITS)) + F.lit(1)
    at = keys.select(F.bitmap_bucket_number(place).alias("__chunk"), F.bitmap_bit_position(place).alias("__bit"))
    bits = at.groupBy("__chunk").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    found = rows.withColumn("__chunk", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "__chunk", "left" if others else "inner")
    return found.filter(~met if others else met).select(*rows.columns)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of an undirected graph given as rows (a, b): rows (node, component) for all nodes
    that have an edge, component being the smallest node that can be reached.

    Alternates large-star and small-star steps (Kiveris et al., 2014), each a min-aggregate and a join; a node of
    any degree is aggregated map-side first. Each round's edges go to the shared folder. Converges in
    O(log n) rounds in practice; raises if ``rounds`` are not enough, so that no wrong result is returned.
    """
    spark = edges.sparkSession
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    e = stage(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b").distinct()
        after = stage(small, "cc")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        unstage(spark, e)
        e = after
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
