"""Bulk-synchronous best-fit packing of token sequences.

A document is its token ids and an end id; only documents over the capacity are cut, into pieces of the
capacity, the first of which may be shorter. Rounds: documents and gaps (room left in open sequences) are rows, range-sorted
by size, largest first, gaps before documents of the same size and equal sizes by key, so a hot size spreads over ranges. Every task sweeps its range: a document takes its
successor, the smallest gap passed that holds it and that no longer document has taken. What a range leaves, documents that passed no gap and gaps
that no document took, is told apart by rank: the k-th document left in a range takes the last gaps left in the
ranges before it. The driver sees two counts a range to deal out these ranks; rows meet by them in a join. So every sweep gives the
matching of one sequential pass, wherever the ranges are cut. Then all gaps are updated at once and the next round begins. Sequences are
opened for the tokens left before the first round, and again when nothing fits any more. Rows that make up one range are
swept by one task to the end, in the same rounds.

Defined results: null text is empty and gives one piece, the end id; repeated rows are packed one by one; null ids are
carried along; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import lean, ship, stage, unstage

CAPACITY, END_ID = 2048, 0
#: Rows, documents and gaps together, of one range of sizes: what one task sweeps.
RANGE_ROWS = 50_000
GAP, DOCUMENT, PLACED = 0, 1, 2
PIECES = "id {id}, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((k, capacity) for k in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Whole texts to pieces: id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tidemill.llm.tokens import encoder

        enc = encoder(tokenizer)
        for part in parts:
            out: list[tuple] = []
            for doc, text in zip(part["id"], part["text"], strict=True):
                ids = memoryview((enc.ids(text) if text else b"") + end)
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"]).astype({"id": part["id"].dtype})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(lean(work), PIECES.format(id=rows.schema["id"].dataType.simpleString()))


def sweep(rooms: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best fit of documents in gaps, both sorted from large to small; every gap is used once. (places of the gaps taken, of their
    documents): a document takes the last gap passed that is still free, which is the smallest that holds it."""
    free: list[tuple[int, int]] = []  # runs of free gaps, the smallest last
    gaps, docs, at = [], [], 0
    sizes, first, counts = np.unique(-lengths, return_index=True, return_counts=True)
    ends = np.searchsorted(-rooms, sizes, "right")
    for k, n, end in zip(first.tolist(), counts.tolist(), ends.tolist(), strict=True):
        if end > at:
            free.append((at, end))
            at = end
        while n and free:
            low, high = free.pop()
            m = min(n, high - low)
            gaps.append(np.arange(high - 1, high - 1 - m, -1))
            docs.append(np.arange(k, k + m))
            k, n = k + m, n - m
            if high - m > low:
                free.append((low, high - m))
    none = np.empty(0, np.int64)
    return (np.concatenate(gaps), np.concatenate(docs)) if gaps else (none, none)


def _sorted(part: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, keys) of one kind, largest first, then by key."""
    some = part[part["kind"] == kind]
    size, key = some["size"].to_numpy(np.int64), some["key"].to_numpy(np.int64)
    order = np.lexsort((key, -size))
    return size[order], key[order]


def _whole(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    held = list(parts)
    return pd.concat(held, ignore_index=True) if held else pd.DataFrame({"kind": [], "size": [], "key": []})


STATE = "kind int, size long, key long, seq long, room long, part int, rank long"


def _rows(kind: int, size: np.ndarray, key: np.ndarray, seq=0, room=0, part: int = 0, rank=0) -> pd.DataFrame:
    return pd.DataFrame({"kind": kind, "size": size, "key": key, "seq": seq, "room": room, "part": part, "rank": rank})


def _sweep_range(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sweep of one range: documents placed, and what is left, ranked."""
    part, number = _whole(parts), TaskContext.get().partitionId()
    (room, seq), (length, key) = _sorted(part, GAP), _sorted(part, DOCUMENT)
    g, d = sweep(room, length)
    yield _rows(PLACED, length[d], key[d], seq[g], room[g])
    for kind, size, k, used in ((GAP, room, seq, g), (DOCUMENT, length, key, d)):
        left = np.setdiff1d(np.arange(len(size)), used)
        yield _rows(kind, size[left], k[left], part=number, rank=np.arange(len(left)))


def _finish(capacity: int, opened: int):
    """All rounds that are left, over rows that are one range."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, new = _whole(parts), opened
        (room, seq), (length, key) = _sorted(part, GAP), _sorted(part, DOCUMENT)
        while len(length):
            g, d = sweep(room, length)
            if len(g):
                yield _rows(PLACED, length[d], key[d], seq[g], room[g])
                room[g] -= length[d]
                length, key = np.delete(length, d), np.delete(key, d)
            else:
                n = -(-int(length.sum()) // capacity)
                room, seq, new = np.append(room, np.full(n, capacity)), np.append(seq, np.arange(new, new + n)), new + n
            order = np.lexsort((seq, -room))
            room, seq = room[order], seq[order]

    return work


def _runs(left: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int, int, int]]:
    """From the rows left of each (range, kind): (kind, range, first rank, end rank, ticket of the first, step); a document and a gap of one ticket meet."""
    out, free, ticket = [], [], 0
    for part in sorted({p for p, _ in left}):
        k, n = 0, left.get((part, DOCUMENT), 0)
        while n and free:
            other, high = free.pop()
            m = min(n, high)
            out += [(DOCUMENT, part, k, k + m, ticket, 1), (GAP, other, high - m, high, ticket + m - 1, -1)]
            k, n, ticket = k + m, n - m, ticket + m
            if high > m:
                free.append((other, high - m))
        if left.get((part, GAP)):
            free.append((part, left[part, GAP]))
    return out


def _round(spark: SparkSession, state: DataFrame, ranges: int) -> DataFrame:
    """One sweep over all ranges and the update of all gaps."""
    ordered = state.repartitionByRange(ranges, F.col("size").desc(), "kind", "key")
    swept = stage(ordered.mapInPandas(lean(_sweep_range), STATE), "sweep")
    counts = swept.filter(F.col("kind") != PLACED).groupBy("part", "kind").agg(F.count("*").alias("n")).collect()  # two rows a range
    runs = _runs({(r["part"], r["kind"]): r["n"] for r in counts})
    table = spark.createDataFrame(runs, "r_kind int, r_part int, low long, high long, ticket long, step long")
    at = (F.col("kind") == F.col("r_kind")) & (F.col("part") == F.col("r_part")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    left = swept.filter(F.col("kind") != PLACED).join(F.broadcast(table), at, "left")  # at most two runs a range and one for each it meets
    left = left.withColumn("t", F.col("ticket") + F.col("step") * (F.col("rank") - F.col("low")))
    gaps = left.filter((F.col("kind") == GAP) & F.col("t").isNotNull()).select("t", F.col("key").alias("g_seq"), F.col("size").alias("g_room"))
    docs = left.filter((F.col("kind") == DOCUMENT) & F.col("t").isNotNull()).select("t", "size", "key")
    met = docs.join(gaps, "t").select(F.lit(PLACED).alias("kind"), "size", "key", F.col("g_seq").alias("seq"), F.col("g_room").alias("room"))
    columns = ["kind", "size", "key", "seq", "room"]
    after = stage(swept.filter(F.col("kind") == PLACED).select(columns).unionByName(left.filter("t is null").select(columns)).unionByName(met), "round")
    unstage(spark, swept)
    return after


def _gaps_of(placed: DataFrame) -> DataFrame:
    return placed.select(F.lit(GAP).alias("kind"), (F.col("room") - F.col("size")).alias("size"), F.col("seq").alias("key"))


def best_fit(docs: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """From (key, size), keys unique and sizes from 1 to the capacity: (key, sequence, offset). Sequences are numbered from 0."""
    spark = docs.sparkSession
    state = docs.select(F.lit(DOCUMENT).alias("kind"), F.col("size").cast("long").alias("size"), F.col("key").cast("long").alias("key"))
    placed: list[DataFrame] = []
    opened, stuck = 0, True
    while True:
        doc = F.col("kind") == DOCUMENT
        seen = state.agg(F.count(F.when(doc, 1)).alias("n"), F.sum(F.when(doc, F.col("size"))).alias("tokens"), F.min(F.when(doc, F.col("size"))).alias("least")).first()
        if not seen["n"]:
            break
        state = state.filter(doc | (F.col("size") >= seen["least"]))
        if stuck:
            new = -(-seen["tokens"] // capacity)
            state = state.unionByName(spark.range(opened, opened + new).select(F.lit(GAP).alias("kind"), F.lit(capacity).cast("long").alias("size"), F.col("id").alias("key")))
            opened += new
        ranges = -(-state.count() // range_rows)
        if ranges == 1:
            done = stage(state.repartition(1).mapInPandas(lean(_finish(capacity, opened)), STATE).select("kind", "size", "key", "seq", "room"), "round")
            placed.append(done)
            break
        after = _round(spark, state, ranges)
        now = after.filter(F.col("kind") == PLACED)
        stuck = now.isEmpty()
        placed.append(now)
        state = after.filter(F.col("kind") != PLACED).select("kind", "size", "key").unionByName(_gaps_of(now).filter("size > 0"))
    schema = "key long, sequence long, offset long"
    out = spark.createDataFrame([], schema)
    for some in placed:
        out = out.unionByName(some.select("key", F.col("seq").alias("sequence"), (F.lit(capacity) - F.col("room")).cast("long").alias("offset")))
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset. A piece of the whole capacity is a sequence of its own (odd numbers)."""
    rows = stage(pieces(docs, tokenizer, id_col, text_col, capacity, end_id).withColumn("key", F.monotonically_increasing_id()), "pieces")
    full = F.col("length") == capacity
    found = best_fit(rows.filter(~full).select("key", F.col("length").alias("size")), capacity, range_rows)
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32"]
    alone = rows.filter(full).select(*columns, (F.col("key") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(rows.filter(~full).join(found, "key").select(*columns, (F.col("sequence") * 2).alias("sequence_id"), "offset"))
