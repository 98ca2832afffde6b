"""Quality classifier: attention-based multiple-instance learning (Ilse et al., 2018).

A text is a bag of passages of 512 code points. A passage is encoded by counts of bytes and of trigrams of character
classes (every ASCII punctuation mark is its own class), log-scaled, then by one learned layer. Gated attention weighs the passages, the
weighted mean is scored. Only document labels are used: the weights of the passages are learned from them.

Training takes at most ``SAMPLE`` labelled texts of at most ``SAMPLE_CHARS`` code points, those with the smallest hash of
their id (both are parameters); the driver fits the model on their passage counts. Every text is scored whole.

Defined results: null and empty texts are one passage without characters and get the score of that; without any
label, or with one kind only, the score is the share of label 1 (0.5 without any). Null labels teach nothing; several
labels for an id are all used. Texts of any length are scored whole, ``HELD`` passages at a time. Rows with null ids are held out. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import crc_bucket, lean, ship

PASSAGE = 512
BYTES, SHAPES = 128, 512
FEATURES = BYTES + SHAPES
SAMPLE, SAMPLE_CHARS = 4096, 60_000
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 32, 16, 30, 64, 0.01, 1e-4
ACCEPT = 0.7
#: Passages that are held at once; a longer text is encoded run by run.
HELD = 1024


def _classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, beyond ASCII, control, or itself."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        out[b] = 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else 4 if b > 127 else 5 if b < 32 and b != 10 else 6 + b
    return out


_CLASS = _classes()


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _counted(b: np.ndarray, start: int, end: int) -> np.ndarray:
    """Counts of the passages that bytes start to end make up; a trigram belongs to the passage that it begins in."""
    some = b[start : min(end + 2, len(b))]
    n = max(1, -(-(min(end, len(b)) - start) // PASSAGE))
    c = _CLASS[some]
    shape = (c[:-2] * 40_503 + c[1:-1] * 2_711 + c[2:] * 97) % 65_521 % SHAPES if len(c) > 2 else np.empty(0, np.int64)
    own = some[: end - start]
    at = np.arange(len(own)) // PASSAGE * FEATURES
    cells = np.concatenate((at + (own >> 1), at[: len(shape)] + BYTES + shape))
    return np.bincount(cells, minlength=n * FEATURES).reshape(n, FEATURES)


def passages(text: str | None) -> np.ndarray:
    """Counts of the whole text, one row for each passage (passages are cut by bytes of UTF-8)."""
    b = _bytes(text)
    return _counted(b, 0, len(b))


def scale(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts.astype(np.float32))


class Attention:
    """Gated attention over passage encodings; plain NumPy."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean.astype(np.float32), spread.astype(np.float32)
        init = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": init(FEATURES, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION, 1), "c": init(HIDDEN, 1), "d": np.zeros(1, np.float32)}

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """For scaled passages: (standardized input, encoding, both parts of the gated attention, its logit)."""
        p = self.p
        z = (x - self.mean) / self.spread
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return z, h, t, g, ((t * g) @ p["w"])[:, 0]

    def score_long(self, b: np.ndarray, held: int = HELD) -> float:
        """Score of the bytes of one text of any length: sums of the softmax are carried on over runs of passages."""
        most, weight, total = -np.inf, 0.0, np.zeros(HIDDEN)
        for start in range(0, max(1, len(b)), held * PASSAGE):
            _, h, _, _, e = self.encode(scale(_counted(b, start, min(len(b), start + held * PASSAGE))))
            top = max(most, float(e.max()))
            a, keep = np.exp(e - top), np.exp(most - top)
            weight, total, most = weight * keep + float(a.sum()), total * keep + a @ h, top
        s = float((total / weight) @ self.p["c"][:, 0] + self.p["d"][0])
        return 1 / (1 + float(np.exp(-s)))

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Scores of bags; x: scaled passages, starts: the first row of each bag (none is empty)."""
        p = self.p
        z, h, t, g, e = self.encode(x)
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        m = np.add.reduceat(a[:, None] * h, starts, axis=0)
        s = 1 / (1 + np.exp(-((m @ p["c"])[:, 0] + p["d"])))
        return s, (z, h, t, g, a, bag, m)

    def gradient(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        s, (z, h, t, g, a, bag, m) = self.forward(x, starts)
        ds = ((s - y) / len(y)).astype(np.float32)
        dm = ds[:, None] * p["c"].T
        da = (h * dm[bag]).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dtg = de[:, None] * p["w"].T
        dt, dg = dtg * g * (1 - t**2), dtg * t * g * (1 - g)
        dh = a[:, None] * dm[bag] + dt @ p["V"].T + dg @ p["U"].T
        dz = dh * (1 - h**2)
        return {"W": z.T @ dz, "b": dz.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de[:, None], "c": m.T @ ds[:, None], "d": ds.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            for rows in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // BATCH)):
                starts = np.cumsum([0, *(len(bags[i]) for i in rows[:-1])])
                grads = self.gradient(scale(np.concatenate([bags[i] for i in rows])), starts, y[rows])
                step += 1
                for k, g in grads.items():
                    g = g + DECAY * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> Attention | float:
    """The model, or a constant score where labels don't tell two kinds apart."""
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id is not null and y is not null")
    # The bound holds before texts move: at most ``sample`` ids are joined to the documents.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.coalesce(F.length("text"), F.lit(0)) <= sample_chars)
    chosen = known.join(texts.select("id"), "id", "left_semi").orderBy(F.xxhash64("id"), "id", "y").limit(sample)
    rows = texts.join(F.broadcast(chosen), "id")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"id": part["id"], "y": part["y"].astype(float), "counts": [passages(t).astype("<u2").tobytes() for t in part["text"]]})

    got = rows.mapInPandas(count, "id long, y double, counts binary").orderBy("id", "y").limit(2 * sample).toPandas()
    y = (got["y"].to_numpy() > 0.5).astype(np.float32)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    bags = [np.frombuffer(c, "<u2").reshape(-1, FEATURES) for c in got["counts"]]
    total, square, n = np.zeros(FEATURES), np.zeros(FEATURES), 0
    for bag in bags:
        x = scale(bag)
        total, square, n = total + x.sum(0), square + (x**2).sum(0), n + len(x)
    mean = total / n
    model = Attention(mean, np.sqrt(np.maximum(square / n - mean**2, 0)) + 0.1)
    model.fit(bags, y)
    return model


def score_texts(model: Attention | float, texts: list[str | None], batch: int = 512) -> list[float]:
    if isinstance(model, float):
        return [model] * len(texts)
    out = [0.0] * len(texts)
    held: list[np.ndarray] = []
    where: list[int] = []
    size = 0

    def flush() -> None:
        starts = np.cumsum([0, *(len(x) for x in held[:-1])])
        for i, v in zip(where, model.forward(scale(np.concatenate(held)), starts)[0].tolist(), strict=True):
            out[i] = v

    for i, t in enumerate(texts):
        b = _bytes(t)
        if len(b) > HELD * PASSAGE:
            out[i] = model.score_long(b)
            continue
        held.append(_counted(b, 0, len(b)))
        where.append(i)
        size += len(held[-1])
        if size >= batch:
            flush()
            held, where, size = [], [], 0
    if held:
        flush()
    return out


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, fold: int = 2) -> DataFrame:
    """One row for each document: id, held_out, score, predicted. Learns outside the held-out fold only."""
    held = F.coalesce(crc_bucket(id_col, folds) == fold, F.lit(True))
    model = train(docs.filter(~held), labels.filter(~held), id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            s = score_texts(shared.value, part.pop("text").tolist())
            yield part.assign(score=s, predicted=[int(x >= ACCEPT) for x in s])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(lean(work), f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
