"""Removal of repeated passages: every window of 20 words that started earlier already, behind a count-min prefilter.

Pass 1. Each task sketches its documents. A window is counted under its minimizer, the smallest hash of the 8-word grams
within it: equal windows have equal minimizers, so the count of a minimizer is never below that of the window.
The sketch has ``ROWS`` rows of ``shards`` x 2**32 counters that stop at two; shards grow with the text (``SHARD_BYTES``), so no task merges more than
its share. It is sent sparsely: for each row and shard the cells counted once and those counted
more often. Merged over all tasks, the estimate of a minimizer is the least of its cells in all rows; it never falls short.
The cells counted at least twice are folded into a bitmap a row, of bounded size (at most ``MAX_BITS`` together; if a corpus outgrows it, more windows pass
and the result stays the same).

Pass 2. Windows whose minimizer is hot are grouped exactly by a 96-bit hash. Each task keeps its first occurrence of
a window and marks all later ones of its own as repeated, so a window of any frequency sends one row for each
task; over these rows the first start wins. Marked windows are joined to the documents, and the words they cover go.

Defined results: null text has no words; documents of fewer than 20 words lose nothing; rows with equal id and
equal text are one document and get equal results; null ids come last in the order of documents; equal ids with different texts are ordered by
digest; an empty table gives an empty result. Columns other than id and text pass through ``remove_repeats`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import lean, mix64, rolling, ship, stage, unstage, word_ids

WINDOW, GRAM = 20, 8
#: Rows of the sketch; bytes of text for each shard, of which there is a power of two between the two bounds.
ROWS, SHARD_BYTES, LEAST_SHARDS, MOST_SHARDS = 2, 1 << 24, 32, 1 << 20
#: Windows that a task holds before it sends the first of each.
SEND_ROWS = 1_500_000
MIN_BITS, MAX_BITS, BITS_PER_HOT = 1 << 20, 1 << 30, 64
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # odd multipliers (fixed values)
LAST = (1 << 63) - 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` values, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def minimizers(ids: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all grams, minimizer of every window); empty below one window."""
    if len(ids) < window:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    grams = mix64(rolling(ids, GRAM, BASES[0]))
    return grams, sliding_min(grams, window - GRAM + 1)


def _cells(v: np.ndarray, row: int, shards: int) -> np.ndarray:
    """Shard and cell (low 32 bits) of minimizers in a row of the sketch, as one number."""
    shard = (v >> np.uint64(32)) & np.uint64(shards - 1)
    cell = v if row == 0 else mix64(v + np.uint64(row) * np.uint64(BASES[1]))
    return (shard << np.uint64(32)) | (cell & np.uint64(0xFFFFFFFF))


def shards_for(size: int) -> int:
    shards = LEAST_SHARDS
    while shards < min(MOST_SHARDS, size // SHARD_BYTES):
        shards *= 2
    return shards


def sketch(rows: DataFrame, shards: int) -> DataFrame:
    """Merged sketch of (text): (row, shard, n, cells), the cells counted at least twice, sorted."""

    def part_sketch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, often = [], []
        for part in parts:
            for ids in word_ids(part["text"]):
                grams, low = minimizers(ids)
                if len(low):
                    grams.sort()
                    u = np.unique(low)
                    again = np.searchsorted(grams, u, "right") - np.searchsorted(grams, u) > 1
                    once.append(u)
                    often.append(u[again])
        if not once:
            return
        once, often = np.concatenate(once), np.concatenate(often)
        edges = np.arange(shards + 1, dtype=np.uint64) << np.uint64(32)
        for row in range(ROWS):
            cells = _cells(once, row, shards)
            cells.sort()
            many = np.union1d(cells[1:][cells[1:] == cells[:-1]], _cells(often, row, shards))
            new = np.ones(len(cells), bool)
            new[1:] = cells[1:] != cells[:-1]
            cells = np.setdiff1d(cells[new], many, assume_unique=True)
            a, b = np.searchsorted(cells, edges), np.searchsorted(many, edges)
            cells, many = cells.astype("<u4"), many.astype("<u4")
            some = np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist()
            yield pd.DataFrame({"row": row, "shard": some, "once": [cells[a[k] : a[k + 1]].tobytes() for k in some], "often": [many[b[k] : b[k + 1]].tobytes() for k in some]})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        v = np.frombuffer(b"".join(part["once"]), "<u4").copy()
        v.sort()
        hot = np.union1d(v[1:][v[1:] == v[:-1]], np.frombuffer(b"".join(part["often"]), "<u4")).astype("<u4")
        return pd.DataFrame({"row": part["row"][:1], "shard": part["shard"][:1], "n": [len(hot)], "cells": [hot.tobytes()]})

    sent = rows.mapInPandas(lean(part_sketch), "row int, shard int, once binary, often binary")
    return sent.groupBy("row", "shard").applyInPandas(lean(merge), "row int, shard int, n long, cells binary")


def hot_bitmap(hot: DataFrame, shards: int) -> tuple[int, bytes]:
    """(bits of a shard's slice, bitmap): for each row a bitmap of hot cells, in which each shard owns one slice; the driver gets just the bits."""
    total = hot.agg(F.sum("n")).first()[0] or 0
    bits = MIN_BITS
    while bits < min(MAX_BITS, total * BITS_PER_HOT):
        bits *= 2
    each = max(8, bits // ROWS // shards)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row, shard, cells in zip(part["row"], part["shard"], part["cells"], strict=True):
                flags = np.zeros(each, np.uint8)
                flags[np.frombuffer(cells, "<u4") % each] = 1
                yield pd.DataFrame({"slot": [row * shards + shard], "slice": [np.packbits(flags, bitorder="little").tobytes()]})

    out = bytearray(ROWS * shards * each // 8)
    for r in hot.select("row", "shard", "cells").mapInPandas(fold, "slot long, slice binary").toLocalIterator():
        out[r["slot"] * each // 8 : (r["slot"] + 1) * each // 8] = r["slice"]
    return each, bytes(out)


def passing(low: np.ndarray, flags: np.ndarray, each: int, shards: int) -> np.ndarray:
    """Which minimizers the sketch estimates as repeated: their cells are hot in all rows."""
    out = np.ones(len(low), bool)
    for row in range(ROWS):
        c = _cells(low, row, shards)
        bit = (row * shards + (c >> np.uint64(32)).astype(np.int64)) * each + ((c & np.uint64(0xFFFFFFFF)) % np.uint64(each)).astype(np.int64)
        out &= (flags[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
    return out


def repeated_windows(rows: DataFrame) -> DataFrame:
    """From (id, tie, text): (id, tie, starts, more): the starts of windows whose words also start earlier, as numbers and as blobs of numbers."""
    spark = rows.sparkSession
    ship(spark)
    shards = shards_for(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    hot = stage(sketch(rows.select("text"), shards), "hot")
    each, bitmap = hot_bitmap(hot, shards)
    unstage(spark, hot)
    shared = spark.sparkContext.broadcast(bitmap)

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags = np.frombuffer(shared.value, np.uint8)
        kind = np.dtype([("hi", "<i8"), ("lo", "<i4"), ("id", "<i8"), ("tie", "<i4"), ("start", "<i4")])

        def send(found: list[np.ndarray]) -> Iterator[pd.DataFrame]:
            x = np.concatenate(found)
            x = x[np.lexsort((x["start"], x["tie"], x["id"], x["lo"], x["hi"]))]
            new = np.ones(len(x), bool)
            new[1:] = (x["hi"][1:] != x["hi"][:-1]) | (x["lo"][1:] != x["lo"][:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
            same = (x["id"] == x["id"][lead]) & (x["tie"] == x["tie"][lead]) & (x["start"] == x["start"][lead])
            late, x = x[~same], x[new]
            for k in range(0, len(x), 50_000):
                yield pd.DataFrame({c: x[c][k : k + 50_000] for c in kind.names} | {"starts": None})
            late = late[np.lexsort((late["tie"], late["id"]))]
            cuts = np.flatnonzero((late["id"][1:] != late["id"][:-1]) | (late["tie"][1:] != late["tie"][:-1])) + 1
            for one in np.split(late, cuts) if len(late) else []:
                doc = one[:1]
                yield pd.DataFrame({"hi": mix64(doc["id"].view(np.uint64)).view(np.int64), "lo": doc["tie"], "id": doc["id"], "tie": doc["tie"], "start": [-1], "starts": [one["start"].tobytes()]})

        found: list[np.ndarray] = []
        held = 0
        for part in parts:
            for doc, tie, ids in zip(part["id"], part["tie"], word_ids(part["text"]), strict=True):
                _, low = minimizers(ids)
                if not len(low):
                    continue
                starts = np.flatnonzero(passing(low, flags, each, shards))
                if len(starts):
                    x = np.empty(len(starts), kind)
                    x["hi"] = mix64(rolling(ids, WINDOW, BASES[1])[starts]).view(np.int64)
                    x["lo"] = (mix64(rolling(ids, WINDOW, BASES[2])[starts]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    x["id"], x["tie"], x["start"] = doc, tie, starts
                    found.append(x)
                    held += len(x)
                    if held >= SEND_ROWS:
                        yield from send(found)
                        found, held = [], 0
        if found:
            yield from send(found)

    found = rows.mapInPandas(lean(find), "hi long, lo int, id long, tie int, start int, starts binary")
    order = Window.partitionBy("hi", "lo").orderBy("id", "tie", "start")  # a row for each task that has the window
    late = found.withColumn("rank", F.rank().over(order)).filter("rank > 1 or starts is not null")
    return late.groupBy("id", "tie").agg(F.collect_list(F.when(F.col("start") >= 0, F.col("start"))).alias("starts"), F.collect_list("starts").alias("more"))


def keys(id_col: str, text_col: str) -> list:
    return [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("__id"), F.hash(F.col(f"`{text_col}`")).alias("__tie")]


def covered(n: int, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", measure: bool = False) -> DataFrame:
    """All columns of ``docs``, the text without repeated words (kept words joined by one space; a text that loses
    nothing stays as it is). With ``measure``: only id, n_words, n_removed, kept_sha256."""
    key = keys(id_col, text_col)
    rows = docs.select(key[0].alias("id"), key[1].alias("tie"), F.col(f"`{text_col}`").alias("text"))
    marks = repeated_windows(rows).withColumnsRenamed({"id": "__mid", "tie": "__mtie", "starts": "__starts", "more": "__more"})
    names = [id_col] if measure else [c for c in docs.columns if c != text_col]
    wide = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("__text"), *key)
    order = docs.columns
    joined = wide.join(marks, (F.col("__id") == F.col("__mid")) & (F.col("__tie") == F.col("__mtie")), "left").drop("__id", "__tie", "__mid", "__mtie")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, counts, gone, digests = [], [], [], []
            for text, starts, more in zip(part.pop("__text"), part.pop("__starts"), part.pop("__more"), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split() if measure or starts is not None else []
                n = len(words)
                if starts is not None:
                    keep = ~covered(n, np.concatenate((np.asarray(starts, np.int64), np.frombuffer(b"".join(more), "<i4"))))
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    text = b" ".join(words).decode("utf-8", "surrogatepass")
                if measure:
                    counts.append(n)
                    gone.append(n - len(words))
                    digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                else:
                    texts.append(text)
            yield part.assign(n_words=counts, n_removed=gone, kept_sha256=digests) if measure else part.assign(**{text_col: texts})[order]

    if measure:
        schema = docs.select(F.col(f"`{id_col}`")).withColumns({"n_words": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long"), "kept_sha256": F.lit("")}).schema
    else:
        schema = docs.schema
    return joined.mapInPandas(lean(work), schema)


REPEATS_SQL = r"""
with d as (select doc_id, case when text is null then [] else regexp_extract_all(text, '[^\x20\x09-\x0D]+') end as w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as k from (select *, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as n from win) where n > 1),
gone as (select doc_id, list(distinct p) as ps from (select doc_id, unnest(range(i, i + 20)) as p from late) group by doc_id),
kept as (select d.doc_id, len(w)::bigint as n_words,
                case when ps is null then w else list_filter(list_transform(w, lambda x, i: case when list_contains(ps, i) then null else x end), lambda x: x is not null) end as k
         from d left join gone on d.doc_id = gone.doc_id)
select doc_id, n_words, (n_words - len(k))::bigint as n_removed, sha256(coalesce(array_to_string(k, ' '), '')) as kept_sha256 from kept
"""
