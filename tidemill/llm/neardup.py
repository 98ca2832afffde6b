"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its 5-word shingles (words of the lower-case text between ASCII white space; a shorter text is one
shingle), weight tf x (1 + idf), idf = ln(N / df) / ln N between 0 and 1. Document frequencies are exact, for samples and
verification alike: texts are dealt into batches, batches send their distinct shingles to slices of the hash range, and
get back the frequencies of those that stand in more than one text. A text whose shingles that also stand in other texts
weigh less than 0.8 of the whole can't be similar to any of them, so it isn't sampled.
Each of 48 consistent weighted samples (Ioffe, 2010) is equal in two documents with probability the weighted Jaccard similarity;
12 bands of 4 samples name the buckets. Pairs are verified by the exact weighted Jaccard similarity, at least 0.8.

Equal texts are one node from the start, named by 64 bits of the text's digest; ids come in at the end only. Every node is first verified against one other only, of those that it shares a bucket
with the one in the most and fullest buckets (linear in the number of nodes); then, where a bucket still holds more than one component, the pairs across components
that agree well enough in 756 further samples are verified too, so that no link that could join two classes is lost.

Defined results: one row for each document: id, class_id (the smallest id of its class), class_size, kept (id =
class_id). Null texts and null ids stay alone (class_id = id); texts without words link to equal texts only;
rows that share an id share a class; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import components, join_hot, lean, likely, mix64, rolling, scratch_path, ship, stage, unstage, word_ids

WORDS, THRESHOLD = 5, 0.8
SAMPLES, BANDS = 48, 12
#: Characters of text in a batch; shingles are counted in as many slices as there are batches.
BATCH_CHARS = 8_000_000
#: Across components, nodes get so many samples more; pairs that agree in fewer than 4 standard deviations below the threshold are not verified.
MORE_SAMPLES = 756
#: Of each further sample one byte is kept, seven to a 64-bit number; LOW and HIGH are the bits below and at the top of each byte.
PER_LONG, LOW, HIGH = 7, 0x7F7F7F7F7F7F7F, 0x80808080808080
AGREE = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / MORE_SAMPLES) ** 0.5
#: Nodes in a block; a bucket of more is compared block by block.
TILE = 1024
#: Keys that the pairs of one node are spread over.
SALTS = 256
BASE = 0x9E3779B97F4A7C15


def shingles(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text (sorted distinct shingle hashes, how often each occurs); empty without words."""
    for ids in word_ids(texts, lower=True):
        if len(ids):
            s = mix64(rolling(ids, min(WORDS, len(ids)), BASE))
            yield _summed(s, np.ones(len(s), np.int64))
        else:
            yield np.empty(0, np.uint64), np.empty(0, np.int64)


class Weigher:
    """Weights of shingles from their document frequencies: tf x (1 + idf)."""

    def __init__(self, n_docs: int) -> None:
        self.log_n = np.log(max(n_docs, 2))

    def __call__(self, tf: np.ndarray, df: np.ndarray) -> np.ndarray:
        return tf * (1 + (1 - np.log(np.maximum(df, 1)) / self.log_n).clip(0, 1))


def _distinct(part: pd.DataFrame) -> pd.DataFrame:
    """One row for each text of (digest, text, copies): how many documents have the text."""
    return part.groupby("digest", as_index=False, sort=False).agg({"text": "first", "copies": "sum"})


def _summed(s: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sorted distinct hashes, sums of each of the counts)."""
    order = s.argsort()
    s = s[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    return s[first], *(np.add.reduceat(c[order], first) for c in counts)


def frequencies(texts: DataFrame, slices: int) -> DataFrame:
    """Exact document frequencies of (batch, digest, text, copies), for each batch: rows (batch, shingles, df) of sorted shingles that
    stand in more than one text. A shingle that isn't there stands in one text only, so its frequency is that text's copies.

    A batch sends each of its distinct shingles once, with its count, to a slice of the hash range; no task gets more of a common shingle."""

    def count(part: pd.DataFrame) -> pd.DataFrame:
        batch, part = part["batch"].iloc[0], _distinct(part)
        found = [s for s, _ in shingles(part["text"])]
        s, n = np.concatenate(found), np.repeat(part["copies"].to_numpy(np.int64), [len(x) for x in found])
        if not len(s):
            return pd.DataFrame({"slice": [], "batch": [], "shingles": [], "df": [], "texts": []})
        s, df, held = _summed(s, n, np.ones(len(s), np.int64))
        place = ((s >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        ends = [*first[1:].tolist(), len(s)]
        cut = lambda x: [x[i:j].tobytes() for i, j in zip(first.tolist(), ends, strict=True)]
        return pd.DataFrame({"slice": place[first].astype(np.int64), "batch": batch, "shingles": cut(s), "df": cut(df), "texts": cut(held)})

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        found = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
        s, df, held = _summed(np.concatenate(found), *(np.frombuffer(b"".join(part[k]), np.int64) for k in ("df", "texts")))
        s, df = s[held > 1], df[held > 1]
        out = []
        for batch, own in zip(part["batch"], found, strict=True):
            place = np.searchsorted(s, own).clip(max=max(len(s) - 1, 0))
            place = place[s[place] == own] if len(s) else place[:0]
            if len(place):
                out.append((batch, s[place].tobytes(), df[place].tobytes()))
        return pd.DataFrame(out, columns=["batch", "shingles", "df"])

    sent = texts.groupBy("batch").applyInPandas(lean(count), "slice long, batch long, shingles binary, df binary, texts binary")
    return sent.groupBy("slice").applyInPandas(lean(merge), "batch long, shingles binary, df binary")


class Sampler:
    """Consistent weighted samples. Each (shingle, sample) has r and c from Gamma(2, 1) and b from (0, 1)."""

    def __init__(self, samples: int = SAMPLES, seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(0, 1 << 63, (3, samples, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, (3, samples, 1), np.uint64)

    def _uniforms(self, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers of 32 bits, between 0 and 1, for each (sample, shingle)."""
        h = s * self.mul[k]
        h += self.add[k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h = h.view(np.uint32).astype(np.float32)
        h += np.float32(0.5)
        h *= np.float32(2.0**-32)
        return h[:, ::2], h[:, 1::2]

    def _gamma(self, s: np.ndarray, k: int) -> np.ndarray:
        """Gamma(2, 1) is the sum of two exponentials; both tails reach far beyond the number of shingles of any text."""
        u, v = self._uniforms(s, k)
        x = np.log(u * v)
        return np.maximum(np.negative(x, out=x), np.float32(1e-9), out=x)

    def __call__(self, s: np.ndarray, w: np.ndarray) -> np.ndarray:
        """One 32-bit number for each sample; s must not be empty."""
        n = self.mul.shape[1]
        best, out = np.full(n, np.inf, np.float32), np.zeros(n, np.uint64)
        log_w = np.log(w).astype(np.float32)
        rows = np.arange(n)
        for k in range(0, len(s), 512):
            x = s[k : k + 512]
            r, log_c, beta = self._gamma(x, 0), np.log(self._gamma(x, 1)), self._uniforms(x, 2)[0]
            t = np.floor(log_w[k : k + 512] / r + beta)
            a = log_c - r * (t - beta + np.float32(1))
            j = a.argmin(1)
            value = a[rows, j]
            better = value < best
            best[better] = value[better]
            picked = mix64(s[k + j] + t[rows, j].astype(np.int64).view(np.uint64) * np.uint64(BASE))
            out[better] = picked[better]
        return (out >> np.uint64(32)).astype(np.uint32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted shingles, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    place = np.searchsorted(a[0], b[0]).clip(max=len(a[0]) - 1)
    both = a[0][place] == b[0]
    low = float(np.minimum(a[1][place[both]], b[1][both]).sum(dtype=np.float64))
    return low / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - low)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: id, class_id, class_size, kept."""
    spark = docs.sparkSession
    ship(spark)
    all_rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = all_rows.filter("id is not null and text is not null")
    digest = F.unhex(F.md5("text"))
    ids = stage(rows.select("id", F.xxhash64(digest).alias("node")), "ids")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)
    batches = max(parts, -(-size["chars"] // BATCH_CHARS))
    weigh = Weigher(size["n"])

    def once(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:  # a common text leaves once for many rows
            yield _distinct(part.assign(copies=1))

    def sampled(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        s_known, df_known = (np.frombuffer(b"".join(known[k]), d) for k, d in (("shingles", np.uint64), ("df", np.int64)))
        order = s_known.argsort()
        s_known, df_known = s_known[order], df_known[order]
        sampler, out = Sampler(SAMPLES, 9), []
        if len(part) and len(s_known):
            part = _distinct(part)
            for x, (s, tf) in zip(part.itertuples(), shingles(part["text"]), strict=True):
                if not len(s):
                    continue
                place = np.searchsorted(s_known, s).clip(max=len(s_known) - 1)
                met = s_known[place] == s
                w = weigh(tf, np.where(met, df_known[place], x.copies))
                if w[met].sum() >= threshold * w.sum() * (1 - 1e-9):
                    out.append((x.digest, sampler(s, w).view(np.int32), x.text, w.tobytes()))
        return pd.DataFrame(out, columns=["digest", "samples", "text", "weights"])

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(MORE_SAMPLES, 10)
        for part in parts:
            found = zip(shingles(part.pop("text")), part.pop("weights"), strict=True)
            yield part.assign(samples=[_packed(sampler(s, np.frombuffer(w))) for (s, _), w in found])

    dealt = rows.select(digest.alias("digest"), "text").mapInPandas(lean(once), "digest binary, text string, copies long")
    dealt = dealt.withColumn("batch", F.pmod(F.xxhash64("digest"), F.lit(batches)))
    with _Bucketed(dealt, "batch", parts) as dealt:
        known = stage(frequencies(dealt, batches), "frequencies")
        _clean(spark)
        signed = dealt.groupBy("batch").cogroup(known.groupBy("batch")).applyInPandas(lean(sampled), "digest binary, samples array<int>, text string, weights binary")
        signed = stage(signed.select(F.xxhash64("digest").alias("node"), "samples", "text", "weights"), "samples")
        unstage(spark, known)
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.slice("samples", k * (SAMPLES // BANDS) + 1, SAMPLES // BANDS)))
    nodes = stage(signed.select("node", band.alias("bands")), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    full = stage(banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n")), "full")
    total = BANDS * nodes.count()
    filled = stage(join_hot(banded, full, "bucket", "n", total), "buckets")
    # The text that others were made from shares more buckets with them than they do with each other: it is the best one to compare them with.
    central = F.struct("central", "node")
    weighed = filled.join(filled.groupBy("node").agg(F.sum("size").alias("central")), "node")
    heads = stage(weighed.groupBy("bucket").agg(F.max(central).alias("head"), F.count("*").alias("n")), "heads")
    stars = join_hot(filled.select("bucket", "node"), heads, "bucket", "n", total).groupBy("node").agg(F.max("head")["node"].alias("a"))
    stars = stage(stars.filter("node <> a").select("a", F.col("node").alias("b")), "stars")
    met = filled.select(F.col("node").alias("id")).distinct()
    some = likely(signed.select(F.col("node").alias("id"), "text", "weights"), met, "id").join(met, "id")  # a semi join would be pushed below the bitmap
    with _Bucketed(some, "id", parts) as texts:
        links = stage(_verified(stars, texts, threshold), "links")

        label = components(links)
        placed = stage(filled.join(label, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part")), "placed")
        split = placed.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n")).filter("p < q").select("bucket", "n", F.ceil(F.col("n") / TILE).alias("blocks"))
        left = stage(join_hot(placed, stage(split, "split"), "bucket", "n", placed.count()), "left")
        finer = texts.join(left.select(F.col("node").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("node"), "text", "weights")
        finer = stage(finer.mapInPandas(lean(packed), "node long, samples array<long>"), "finer")
        left = left.join(finer, "node").join(nodes, "node").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)  # a crowded bucket is many tiles, pairs of blocks, each a key of its own
        x = left.withColumn("tile", F.explode(F.transform(every, lambda k: F.struct(F.col("block").alias("i"), k.alias("j"))))).alias("x")
        y = left.withColumn("tile", F.explode(F.transform(every, lambda k: F.struct(k.alias("i"), F.col("block").alias("j"))))).alias("y")
        differ = F.aggregate(F.zip_with("x.samples", "y.samples", _unequal_bytes), F.lit(0), lambda s, v: s + v)
        first = F.array_position(F.zip_with("x.bands", "y.bands", lambda p, q: p == q), True)
        met = F.col("x.bucket") == F.element_at("x.bands", first.cast("int"))  # of the buckets that two nodes share, the first one makes the pair
        crossing = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.tile") == F.col("y.tile")) & (F.col("x.part") < F.col("y.part")) & met & (differ <= (1 - AGREE) * MORE_SAMPLES))
        more = crossing.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        links = links.unionByName(stage(_verified(stage(more, "crossing"), texts, threshold), "links"))

    # Rows that share an id share a class, whatever their texts.
    repeated = ids.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("q"), F.count("*").alias("n")).filter("b < q").select("id", "b", "n")
    same = join_hot(ids, stage(repeated, "repeated"), "id", "n", size["n"]).select(F.col("node").alias("a"), "b").distinct()
    label = components(links.select("a", "b").unionByName(same))
    held = ids.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("n")).join(label, "node", "left")
    held = stage(held.select("node", "low", "n", F.coalesce("component", "node").alias("part")), "held")
    sizes = stage(held.groupBy("part").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("nodes")), "sizes")
    of_node = stage(join_hot(held, sizes, "part", "nodes", held.count()).select("node", "n", "class_id", "class_size"), "classes")
    out = join_hot(ids, of_node, "node", "n", size["n"]).select("id", "class_id", "class_size")
    alone = all_rows.filter("id is null or text is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "class_id", "class_size", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"))


def _packed(samples: np.ndarray) -> np.ndarray:
    """The top byte of each 32-bit sample, PER_LONG to a number."""
    out = np.zeros((len(samples) // PER_LONG, 8), np.uint8)
    out[:, :PER_LONG] = (samples >> np.uint32(24)).reshape(-1, PER_LONG)
    return out.view("<i8")[:, 0]


def _unequal_bytes(p: Column, q: Column) -> Column:
    """In how many of their low seven bytes two numbers differ."""
    v = p.bitwiseXOR(q)
    return F.bit_count((v.bitwiseAND(F.lit(LOW)) + F.lit(LOW)).bitwiseOR(v).bitwiseAND(F.lit(HIGH)))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of ids with similarity of at least the threshold, and that similarity."""

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = OrderedDict()

        def of(doc: int, text: str, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
            if doc not in seen:
                seen[doc] = next(shingles([text]))[0], np.frombuffer(weights)
                if len(seen) > 64:
                    seen.popitem(last=False)
            return seen[doc]

        for part in parts:
            sim = [similarity(of(a, p, v), of(b, q, w)) for a, b, p, q, v, w in zip(*(part[k] for k in ("a", "b", "ta", "tb", "wa", "wb")), strict=True)]
            out = part[["a", "b"]].assign(similarity=sim)
            yield out[out["similarity"] >= threshold]

    # A head's pairs are dealt out by salts, so that no task gets all partners of one head.
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    heads = salted.select("a", "salt").distinct()
    ta = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"), F.col("weights").alias("wa")).join(heads, "a")
    tb = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"), F.col("weights").alias("wb")).join(salted, "b")
    return tb.join(ta, ["a", "salt"]).mapInPandas(lean(check), "a long, b long, similarity double")


def _clean(spark: SparkSession) -> None:
    """Shuffle files that nothing reads any more go when the driver collects garbage, which may be long after; texts and shingles shouldn't wait."""
    spark._jvm.System.gc()


class _Bucketed:
    """Rows as a table in buckets of a key, in the shared folder: later joins and groups on the key don't move the rows again."""

    def __init__(self, rows: DataFrame, key: str, n: int) -> None:
        self.spark, self.rows, self.key, self.n = rows.sparkSession, rows, key, n
        self.name = f"mill_texts_{uuid.uuid4().hex}"

    def __enter__(self) -> DataFrame:
        rows = self.rows.repartition(self.n, self.key)
        rows.write.bucketBy(self.n, self.key).sortBy(self.key).option("path", scratch_path(self.spark, "texts")).saveAsTable(self.name)
        _clean(self.spark)
        return self.spark.table(self.name)

    def __exit__(self, *_: object) -> None:
        unstage(self.spark, self.spark.table(self.name))
        self.spark.sql(f"DROP TABLE {self.name}")
