"""Near-duplicate embeddings by randomised-rotation binary codes (RaBitQ; Gao and Long, 2024).

Unit vectors are rotated at random; the signs are the code of a vector, <code, rotated vector> its correction factor. With the
other vector of a pair in 4-bit levels, the inner product is estimated without bias from bit counts, divided by the
factor. For any pair at or above the threshold the estimate falls short by more than ``EPSILON`` standard deviations practically
never, so pairs estimated lower are dropped and all others are computed again exactly, in double precision.

Candidates meet in buckets of random-hyperplane signatures; bits per signature grow with log2 of the number of vectors, the
number of tables is set so that a pair exactly at the threshold is met with probability ``RECALL`` (nearer pairs more
surely). Equal vectors are one node from the start. Buckets of more than ``TILE`` nodes are split into tiles, pairs of blocks, that are separate rows of work.

Defined results: null vectors, zero vectors and vectors with null or non-finite components link with nothing; vectors of
different lengths don't link; rows that share an id share a component and each counts the links of its own vector; null ids are no
one's partner: n_links 0, component null, kept. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import components, join_hot, lean, ship, stage

THRESHOLD, RECALL, EPSILON = 0.9, 0.99, 4.5
TILE = 2048
LEVELS = 15
LEAST_BITS, MOST_BITS = 6, 62  # a key is one signed 64-bit number; 2**66 vectors would ask for more


def unit(v) -> np.ndarray | None:
    """The vector in double precision, scaled to length 1; None if it can't link."""
    if v is None or len(v) == 0:
        return None
    x = np.array([np.nan if c is None else c for c in v] if any(c is None for c in v) else v, np.float64)
    if not np.isfinite(x).all():
        return None
    x = x / (np.abs(x).max() or 1.0)
    n = np.sqrt(x @ x)
    return x / n if n > 0 else None


def tables_for(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = int(min(MOST_BITS, max(LEAST_BITS, math.log2(max(n, 2)) - 4)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


class Coder:
    def __init__(self, dim: int, bits: int, tables: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.words = -(-dim // 64)
        self.dim = self.words * 64
        self.rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0][:dim]
        self.planes = rng.standard_normal((dim, bits * tables))
        self.dither = rng.random(self.dim)
        self.powers = 1 << np.arange(bits, dtype=np.int64)
        self.bits, self.tables = bits, tables

    def buckets(self, x: np.ndarray) -> np.ndarray:
        return ((x @ self.planes > 0).reshape(len(x), self.tables, self.bits) * self.powers).sum(2)

    def code(self, x: np.ndarray) -> list[bytes]:
        """For each row: sign bits, four bit planes of the levels, then factor, lowest level, step and sum."""
        y = x @ self.rotation
        signs = np.packbits(y > 0, axis=1, bitorder="little")
        low = y.min(1)
        step = np.maximum((y.max(1) - low) / LEVELS, 1e-12)
        level = np.clip(np.floor((y - low[:, None]) / step[:, None] + self.dither), 0, LEVELS).astype(np.uint8)
        planes = [np.packbits(level >> k & 1, axis=1, bitorder="little") for k in range(4)]
        numbers = np.stack((np.abs(y).sum(1) / math.sqrt(self.dim), low, step, y.sum(1)), 1).astype("<f4")
        return [b"".join((s.tobytes(), *(p[i].tobytes() for p in planes), numbers[i].tobytes())) for i, s in enumerate(signs)]


def unpack(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    words = np.ascontiguousarray(raw[:, :-16]).view("<u8").reshape(len(codes), 5, -1)
    return words[:, 0], words[:, 1:], np.ascontiguousarray(raw[:, -16:]).view("<f4")


def estimates(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products of data rows a with query rows b, how far each may fall short at the threshold)."""
    (signs, _, na), (_, planes, nb) = a, b
    dim = signs.shape[1] * 64
    hits = np.zeros((len(signs), len(planes)), np.float32)
    for w in range(signs.shape[1]):
        for k in range(4):
            hits += np.bitwise_count(signs[:, w, None] & planes[None, :, k, w]).astype(np.float32) * (1 << k)
    ones = np.bitwise_count(signs).sum(1, dtype=np.float32)
    dot = 2 * (hits * nb[:, 2] + ones[:, None] * nb[:, 1]) - nb[:, 3]
    factor = na[:, :1]
    short = EPSILON * np.sqrt((1 - factor**2).clip(0) / factor**2) * math.sqrt(1 - THRESHOLD**2) / math.sqrt(dim - 1)
    return dot / math.sqrt(dim) / factor, short + 3 * nb[:, 2] * math.sqrt(dim) / 4 / math.sqrt(dim) / factor


def similar(docs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each vector: id, n_links, component_id, kept."""
    spark = docs.sparkSession
    ship(spark)

    def clean(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"id": part["id"].astype("Int64"), "v": [None if (x := unit(v)) is None else x.astype("<f8").tobytes() for v in part["v"]]})

    rows = stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInPandas(lean(clean), "id long, v binary"), "vectors")
    good = rows.filter("v is not null and id is not null")
    nodes = stage(good.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("size")), "nodes")
    bits, tables = tables_for(nodes.count(), threshold)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coders: dict[int, Coder] = {}
        for part in parts:
            for dim, group in part.groupby(part["v"].map(len)):
                coder = coders.setdefault(dim, Coder(dim // 8, bits, tables))
                for k in range(0, len(group), 2048):
                    some = group.iloc[k : k + 2048]
                    x = np.frombuffer(b"".join(some["v"]), "<f8").reshape(len(some), -1)
                    keys = coder.buckets(x)
                    yield pd.DataFrame({"node": some["node"], "dim": int(dim), "code": coder.code(x), "keys": list(keys)})

    coded = nodes.select("node", "v").mapInPandas(lean(encode), "node long, dim int, code binary, keys array<long>")
    met = coded.select("node", "code", "dim", F.posexplode("keys").alias("t", "key")).select(F.xxhash64("dim", "t", "key").alias("bucket"), "node", "code")
    met = stage(met, "codes")
    crowds = met.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / TILE))
    block = F.pmod(F.xxhash64("node"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    tiles = F.transform(every, lambda k: F.struct(F.least(k, block).alias("i"), F.greatest(k, block).alias("j")))
    work = met.join(crowds, "bucket").select("bucket", "node", "code", block.alias("block"), F.explode(tiles).alias("tile")).select("bucket", "tile.i", "tile.j", "block", "node", "code")
    work = work.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "block", "node")

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs(group: pd.DataFrame) -> pd.DataFrame:
            own, other = (group["block"] == group["i"]).to_numpy(), (group["block"] == group["j"]).to_numpy()
            ids, packed = group["node"].to_numpy(), unpack(group["code"].tolist())
            a, b = np.flatnonzero(own), np.flatnonzero(other)
            out_a, out_b = [], []
            for k in range(0, len(a), 256):
                rows_a = a[k : k + 256]
                value, short = estimates(tuple(p[rows_a] for p in packed), tuple(p[b] for p in packed))
                hit = value >= threshold - short
                i, j = np.nonzero(hit)
                x, y = ids[rows_a[i]], ids[b[j]]
                once = x < y if group["i"].iloc[0] == group["j"].iloc[0] else x != y
                out_a.append(np.minimum(x, y)[once])
                out_b.append(np.maximum(x, y)[once])
            return pd.DataFrame({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

        held = None
        for part in parts:
            part = part if held is None else pd.concat((held, part), ignore_index=True)
            new = np.flatnonzero((part[["bucket", "i", "j"]].to_numpy()[1:] != part[["bucket", "i", "j"]].to_numpy()[:-1]).any(1)) + 1
            bounds = [0, *new.tolist()]
            for s, e in zip(bounds, bounds[1:], strict=False):
                if e - s > 1:
                    yield pairs(part.iloc[s:e])
            held = part.iloc[bounds[-1] :]
        if held is not None and len(held) > 1:
            yield pairs(held)

    candidates = work.mapInPandas(lean(meet), "a long, b long").distinct()

    def exact(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sim = [float(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8")) for x, y in zip(part["va"], part["vb"], strict=True)]
            yield part[["a", "b"]][np.array(sim) >= threshold] if sim else part[["a", "b"]]

    va, vb = nodes.select(F.col("node").alias("a"), F.col("v").alias("va")), nodes.select(F.col("node").alias("b"), F.col("v").alias("vb"))
    links = stage(candidates.join(va, "a").join(vb, "b").mapInPandas(lean(exact), "a long, b long"), "links")
    label = components(links)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = stage(both.groupBy("b").agg(F.count("*").alias("n")).join(nodes.select(F.col("node").alias("b"), "size"), "b"), "degree")
    partners = join_hot(both, degree, "b", "n", 2 * links.count()).groupBy(F.col("a").alias("node")).agg(F.sum("size").alias("others"))
    of_node = nodes.join(partners, "node", "left").join(label, "node", "left").select("v", F.col("size").alias("n"), (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    linked = join_hot(good, stage(of_node, "linked"), "v", "n", good.count()).select("id", "n_links", "component_id")
    alone = rows.filter("v is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


LINKS_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  and list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.9),
n as (select a, count(*) as n from l group by a),
reach(vec_id, r) as (select vec_id, vec_id from v union select reach.vec_id, l.b from reach join l on reach.r = l.a),
c as (select vec_id, min(r) as c from reach group by vec_id)
select x.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c.c, x.vec_id) as component_id, coalesce(coalesce(c.c, x.vec_id) = x.vec_id, true) as kept
from embeddings x left join n on n.a = x.vec_id left join c on c.vec_id = x.vec_id
"""
