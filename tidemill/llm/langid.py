"""Language identification with hyperdimensional n-gram profiles.

Every letter has a pseudo-random vector of +1 and -1 (seeded, equal everywhere). A trigram is bound as
rot2(first) * rot1(second) * third, where rotK permutes coordinates cyclically; a text is the bundle (sum) of
its trigrams; a language is the bundle of its training texts. A text goes to the language whose prototype has
the largest cosine with the text's bundle.

Defined results: a null text or one without any letter is ``und`` with score 0; so is every text when there is
nothing to learn from. Ties go to the language that sorts first. Rows with null ids or null languages are never
learnt from. Only the id, text and language columns are read, so extra columns can't clash. Rows are
scored one by one: repeated rows get equal predictions, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import crc_bucket, lean, ship

DIM = 1024
SYMBOLS = 64  # a to z, the gap between words, and 37 classes of all other letters
GAP = 26
UNDETERMINED = "und"
#: Code points scored as one batch, and texts in one batch.
BATCH_CHARS, BATCH_TEXTS = 1_500_000, 256


def _letters(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, dim))


def _symbol_table() -> np.ndarray:
    """Symbol of every code point of the basic plane; letters beyond it are classed by rule."""
    out = np.full(0x10000, GAP, np.int32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = c - 97 if 97 <= c <= 122 else 27 + c % 37
    return out


_TABLE: np.ndarray | None = None


def symbols(text: str) -> np.ndarray:
    """Symbols of a text in lower case, runs of non-letters taken as one gap, with a gap at either end."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _symbol_table()
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(codes) and codes.max() >= 0x10000:
        high = codes >= 0x10000
        s = _TABLE[np.where(high, 0, codes)]
        s[high] = [27 + c % 37 if chr(c).isalpha() else GAP for c in codes[high].tolist()]
    else:
        s = _TABLE[codes]
    s = np.concatenate(([GAP], s, [GAP]))
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
    return s[keep]


def trigrams(text: str | None) -> np.ndarray:
    """Codes of all trigrams; empty if the text has no letter."""
    s = symbols(text or "")
    if len(s) < 3:
        return np.empty(0, np.int32)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def bind(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The vectors of trigram codes."""
    first, second = np.roll(letters, 2, 1), np.roll(letters, 1, 1)
    return (first[codes // SYMBOLS**2] * second[codes // SYMBOLS % SYMBOLS] * letters[codes % SYMBOLS]).astype(np.float32)


def bundles(grams: list[np.ndarray], letters: np.ndarray) -> np.ndarray:
    """One bundle for each text, exact sums, by one matrix product over the trigrams that occur."""
    seen = np.zeros(SYMBOLS**3, bool)
    for g in grams:
        seen[g] = True
    active = np.flatnonzero(seen)
    place = np.zeros(SYMBOLS**3, np.int32)
    place[active] = np.arange(len(active))
    counts = np.zeros((len(grams), len(active)), np.float32)
    for row, g in zip(counts, grams, strict=True):
        row[:] = np.bincount(place[g], minlength=len(active))
    out = np.zeros((len(grams), letters.shape[1]), np.float32)
    for k in range(0, len(active), 8192):
        out += counts[:, k : k + 8192] @ bind(active[k : k + 8192], letters)
    return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dim: int = DIM, seed: int = 8) -> tuple[list[str], np.ndarray]:
    """Prototypes of all languages of ``docs``: (sorted names, one unit row each). Each task bundles its own
    texts, Spark sums the bundles; the driver gets one vector for each language."""
    ship(docs.sparkSession)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, np.ndarray] = {}
        for part in parts:
            for lang, text in zip(part["lang"], part["text"], strict=True):
                if len(g := trigrams(text)):
                    if lang not in counts:
                        counts[lang] = np.zeros(SYMBOLS**3, np.int64)
                    if len(g) > 20_000:
                        counts[lang] += np.bincount(g, minlength=SYMBOLS**3)
                    else:
                        np.add.at(counts[lang], g, 1)
        letters = _letters(dim, seed)
        for lang, c in counts.items():
            active, total = np.flatnonzero(c), np.zeros(dim, np.float64)
            for k in range(0, len(active), 8192):
                total += c[active[k : k + 8192]] @ bind(active[k : k + 8192], letters).astype(np.float64)
            yield pd.DataFrame({"lang": lang, "i": np.arange(dim), "v": total.astype(np.int64)})

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    sums = rows.mapInPandas(lean(work), "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    got = sums.toPandas()  # languages x dim numbers
    langs = sorted(got["lang"].unique())
    protos = np.zeros((len(langs), dim))
    protos[[langs.index(x) for x in got["lang"]], got["i"].to_numpy(int)] = got["v"]
    protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
    return langs, protos


def scorer(langs: list[str], protos: np.ndarray, dim: int = DIM, seed: int = 8):
    """A function from texts to (language, score) lists."""

    def score(texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        letters, batch, where, size = _letters(dim, seed), [], [], 0

        def flush() -> None:
            b = bundles(batch, letters)
            cos = (b @ protos.T.astype(np.float32)) / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
            for i, row in zip(where, cos, strict=True):
                k = int(row.argmax())
                names[i], scores[i] = langs[k], float(min(1.0, max(0.0, row[k])))

        for i, t in enumerate(texts):
            if langs and len(g := trigrams(t)):
                batch.append(g)
                where.append(i)
                size += len(g)
                if size >= BATCH_CHARS or len(batch) >= BATCH_TEXTS:
                    flush()
                    batch, where, size = [], [], 0
        if batch:
            flush()
        return names, scores

    return score


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of every row, with lang_pred and score in place of any so named."""
    ship(docs.sparkSession)
    score = scorer(*model)
    names = [c for c in (keep or docs.columns) if c not in ("lang_pred", "score")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("__text"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lang, s = score(part.pop("__text").tolist())
            yield part.assign(lang_pred=lang, score=s)

    schema = docs.select(*names).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return rows.mapInPandas(lean(work), schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, fold: int = 0) -> DataFrame:
    """Learns from the rows outside the held-out fold and predicts every row: id, held_out, lang_pred, score."""
    held = F.coalesce(crc_bucket(id_col, folds) == fold, F.lit(True))
    model = learn(docs.filter(~held), text_col, lang_col)
    rows = docs.select(F.col(id_col), F.col(text_col), held.alias("held_out"))
    return predict(rows, model, text_col, keep=(id_col, "held_out"))
