"""SpotSigs document fingerprints.

A spot signature is an anchor with the chain of the next content words (words that are no
anchors; fewer at the end of the text). Anchors are common words; in a run of content words every ``RUN``-th one begins a signature without an anchor, and so does the first word of a text, so that
texts without common words have signatures by the same rule. The fingerprint of a text is the set of its signatures, hashed to 32 bits and written as sorted
hexadecimal; two fingerprints are compared by the Jaccard similarity of their sets. Sets belong to partitions by
length, whose bounds grow by 1 / ``FLOOR``: sets whose partitions aren't neighbours, or whose lengths alone keep them below the floor, are not compared,
and their likeness is 0.

Defined results: words are runs of letters and digits in lower case. A text without words has a single signature of all its characters;
null is the empty text, whose fingerprint is empty.
Two empty fingerprints have likeness 1, an empty and another one 0. Equal texts have equal fingerprints.
The next document is that with the next smaller id, the first one after the last; equal ids stand in the order of digests of their
texts, null ids come last; a single document is its own next; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import WordHash, lean, mix64, ship

#: Common words of four languages (fixed values; any list of frequent words serves).
ANCHORS = frozenset(
    "a an and are as at be been but by for from had has have he her his in is it its not of on or she so that the their there they this to was we were "
    "which who will with would you aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im in "
    "ist man mit nach nicht noch nur oder sich sie sind so um und uns vom von vor war wie wir zu zum zur au aux avec ce ces cette dans de des du elle en est et il "
    "ils je la le les leur mais ne nous on ou où par pas plus pour que qui sa se ses son sont sur un une vous al como con de del el ella en entre es esta este "
    "ha la las le lo los más me mi muy no nos o para pero por que se si sin sobre su sus un una y ya".split()
)
CHAIN, RUN = 2, 4
#: The similarity below which sets may be told apart by their lengths.
FLOOR = 0.1
_WORDS = re.compile(r"[^\W_]+")


class _Marked(WordHash):
    """Word hashes whose lowest bit marks anchors."""

    def __missing__(self, word: str) -> int:
        h = super().__missing__(word) & ~1 | (word in ANCHORS)
        self[word] = h
        return h


_HASH = _Marked()


def signatures(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit signatures."""
    if not text:
        return np.empty(0, np.uint32)
    ids = _HASH.of(_WORDS.findall(text.lower()))
    anchor = (ids & np.uint64(1)).astype(bool)
    content, before = ids[~anchor], np.cumsum(~anchor)  # before: content words up to each word, itself included
    last = np.maximum.accumulate(np.where(anchor, before, 0))
    nth = (before - 1 - last)[~anchor]  # place of each content word in its run
    begins = np.flatnonzero((nth % RUN == 0) & ((nth > 0) | (np.arange(len(content)) == 0) & ~anchor[:1].any()))
    after = np.concatenate((before[anchor], begins))  # the first content word of each chain
    s = np.concatenate((ids[anchor], np.zeros(len(begins), np.uint64)))
    padded = np.concatenate((content, np.zeros(CHAIN, np.uint64)))
    for k in range(CHAIN):
        s = mix64(s) + padded[after + k]
    if not len(s):
        s = np.frombuffer(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8], np.uint64)
    return np.unique((mix64(s) >> np.uint64(32)).astype(np.uint32))


def fingerprint(sigs: np.ndarray) -> str:
    return sigs.astype(">u4").tobytes().hex()


def length_partition(n: int) -> int:
    """Partition of sets of n signatures: bounds grow by 1 / FLOOR."""
    return 0 if n < 1 else 1 + int(math.log(n) / -math.log(FLOOR))


def likeness(a: np.ndarray, b: np.ndarray, floor: float = FLOOR) -> float:
    """Jaccard similarity of two sorted sets; 0 without comparison if their partitions or lengths alone keep it below ``floor`` (at least ``FLOOR``, or 0 for no pruning)."""
    if not len(a) and not len(b):
        return 1.0
    if floor and abs(length_partition(len(a)) - length_partition(len(b))) > 1:
        return 0.0
    if not len(a) or not len(b) or min(len(a), len(b)) < floor * max(len(a), len(b)):
        return 0.0
    both = np.concatenate((a, b))
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def edit(text: str, following: str) -> str:
    """The text with its last third (rounded down) replaced by the first as many code points of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (slot, guest, id, tie, text), each partition sorted so that the next row of a slot is the next document.

    Slots are ranges of ids between approximate quantiles. The last document of a slot is followed by a guest,
    the first document of the next slot that holds any: one small row for each slot."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    slots = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile("id", [k / slots for k in range(1, slots)], 0.1 / slots)))

    def pick(low: int, high: int):  # a balanced tree of comparisons: slot = number of cuts below or at the id
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("id") < F.lit(int(cuts[mid])), pick(low, mid)).otherwise(pick(mid + 1, high))

    rows = rows.withColumn("slot", F.when(F.col("id").isNull(), -1).otherwise(pick(0, len(cuts))))
    first = {r["slot"]: r["first"] for r in rows.groupBy("slot").agg(F.max(F.struct("id", "tie")).alias("first")).collect()}  # one row a slot
    order = sorted(first, reverse=True)
    follows = [(s, first[n]["id"], first[n]["tie"]) for s, n in zip(order, order[1:] + order[:1], strict=True)]
    schema = "g_slot int, g_id long, g_tie long"
    heads = F.broadcast(spark.createDataFrame(follows, schema))  # at most ``slots`` rows
    guests = rows.join(heads, F.col("id").eqNullSafe(F.col("g_id")) & (F.col("tie") == F.col("g_tie"))).select(F.col("g_slot").alias("slot"), F.lit(1).alias("guest"), "id", "tie", "text").dropDuplicates(["slot"])
    both = rows.select("slot", F.lit(0).alias("guest"), "id", "tie", "text").unionByName(guests)
    return both.repartition("slot").sortWithinPartitions("slot", "guest", F.col("id").desc_nulls_last(), F.col("tie").desc())


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    length_partition. The edited text ends in the beginning of the next document."""
    ship(docs.sparkSession)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (slot, id, text, signatures) of the row whose next one is still to come
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "length_partition"]
        for part in parts:
            out = []
            for slot, guest, doc, text in zip(part["slot"], part["guest"], part["id"], part["text"], strict=True):
                text = text or ""
                sigs = signatures(text)
                if held and held[0] == slot:
                    _, at, mine, own = held
                    changed = edit(mine, text)
                    other = signatures(changed)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((at, len(mine), digest, fingerprint(own), fingerprint(other), likeness(own, other), likeness(own, sigs), length_partition(len(own))))
                held = None if guest else (slot, doc, text, sigs)
            frame = pd.DataFrame(out, columns=names)
            yield frame.assign(id=frame["id"].astype("Int64"))

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, length_partition int"
    return _neighbours(docs, id_col, text_col).mapInPandas(lean(work), schema).withColumnRenamed("id", id_col)
