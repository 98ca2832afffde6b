"""Operators on small fixtures: edge rows, brute force, round trips, held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from tidemill.llm import embeddings, fingerprints, langid, mixing, neardup, packing, preferences, quality, substrings, tokens, warc
from tidemill.llm.common import components
from tidemill.llm.queries import bpe_path

DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, id string, tie int, size int, node int, similarity double"


def rows_of(*texts):
    return [(i, t, "en", "s", 0, 0.0, 1, "c", 2, 3, 4, 0.5) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls, empties, a long text, repeated rows, columns that clash with inner names."""
    base = rows_of("the cat sat on the mat and the dog ran to the house of it", None, "", "   \n", "### $$$ !!!", LONG, "b c", "der hund ist in dem haus und die katze ist auf der matte")
    more = [base[0], base[0], (None, "no id here at all is the text", None, None, None, None, None, None, None, None, None, None), (9, base[0][1], None, None, 0, 0.0, 1, "c", 2, 3, 4, 0.5)]
    return spark.createDataFrame(base + more, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_edges_and_empty(spark, edges):
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    for f in (
        fingerprints.compare_with_next,
        lambda d: quality.quality(d, labels),
        lambda d: packing.pack(d, bpe_path()),
        lambda d: substrings.remove_repeats(d, measure=True),
        substrings.remove_repeats,
        langid.language_id,
        neardup.classes,
        mixing.mix,
    ):
        n = f(edges).toPandas()
        assert len(n) >= 12 and len(f(edges.limit(0)).toPandas()) == 0
    lang = langid.language_id(edges).toPandas()
    assert (lang[lang.doc_id.isin([1, 2, 3, 4])].lang_pred == "und").all()
    cut = substrings.remove_repeats(edges, measure=True).toPandas()
    assert cut[cut.doc_id == 5].n_words.tolist() == [30_000] and cut[cut.doc_id == 1].n_words.tolist() == [0]
    near = neardup.classes(edges).toPandas()
    assert near[near.doc_id == 9].class_id.tolist() == [0] and near[near.doc_id.isna()].kept.all()
    mixed = mixing.mix(edges).toPandas()
    assert (mixed.taken <= 2 * mixed["size"]).all() and mixed.taken.sum() > 0


def test_substrings_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"v{i}" for i in range(40)]
    base = [rng.choice(words, 90).tolist() for _ in range(6)]
    texts = [base[0], base[1][:30] + base[0][10:55] + base[2][:20], ["a", "b", "c"] * 30, base[0], base[3] + base[3][:25], ["z"] * 50, base[4][:19], base[4][:20], base[4][:20]]
    got = substrings.remove_repeats(spark.createDataFrame(rows_of(*map(" ".join, texts)), DOCS), measure=True).toPandas().set_index("doc_id")
    seen, want = set(), []
    for t in texts:
        gone = set()
        for i in range(len(t) - 19):
            w = tuple(t[i : i + 20])
            if w in seen:
                gone |= set(range(i, i + 20))
            seen.add(w)
        want.append((len(t), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(t) if i not in gone).encode()).hexdigest()))
    assert [tuple(got.loc[i, ["n_words", "n_removed", "kept_sha256"]]) for i in range(len(texts))] == want


def test_near_duplicates_brute_force(docs):
    got = neardup.classes(docs).toPandas().set_index("doc_id").class_id
    rows = docs.toPandas().set_index("doc_id").text
    df = Counter(x for s, _ in neardup.shingles(rows) for x in s.tolist())
    n = len(rows)
    sets = {}
    for i, (s, tf) in zip(rows.index, neardup.shingles(rows), strict=True):
        sets[i] = s, tf * (1 + np.array([1 - np.log(df[x]) / np.log(n) for x in s.tolist()]))
    clear, linked = 0, 0
    for i in rows.index:
        for j in rows.index:
            if i < j and len(np.intersect1d(sets[i][0], sets[j][0])):
                sim = neardup.similarity(sets[i], sets[j])
                if sim >= 0.83:
                    clear += 1
                    linked += got[i] == got[j]
                assert sim >= 0.5 or got[i] != got[j] or rows[i] == rows[j] or any(neardup.similarity(sets[i], sets[k]) >= 0.78 for k in rows.index if k != i)
    assert clear > 3 and linked == clear


def test_document_frequencies_are_exact_at_the_border(spark):
    """Filler texts bring 4 million shingles; a pair's similarity must not depend on them but by N and df."""
    shared = [f"p{i}" for i in range(1000)]
    tails = [68, 68, 58, 58]
    texts = [" ".join([*shared, *(f"t{k}x{i}" for i in range(n))]) for k, n in enumerate(tails)]
    texts += [" ".join([*shared, *(f"f{k}x{i}" for i in range(40_000))]) for k in range(100)]
    got = neardup.classes(spark.createDataFrame(rows_of(*texts), DOCS)).toPandas().set_index("doc_id").class_id
    # Shared shingles stand in all texts and weigh 1, others 2: 996 / (996 + 2 * 136) = 0.785 below, 996 / (996 + 2 * 116) = 0.811 above.
    assert got[0] != got[1] and got[2] == got[3]


def test_samples_estimate_similarity():
    rng = np.random.default_rng(3)
    s = np.unique(rng.integers(0, 1 << 63, 900, np.uint64))
    w = rng.uniform(1, 3, len(s))
    a, b = (s[:600], w[:600]), (s[100:700], w[100:700] * 1.1)
    sampler = neardup.Sampler(2048, 1)
    assert abs((sampler(*a) == sampler(*b)).mean() - neardup.similarity(a, b)) < 0.05


def test_near_duplicates_of_texts_that_share_an_id(spark):
    texts = [" ".join(f"{k}x{i}" for i in range(300)) for k in "ab"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0] + " end"), (3, texts[1] + " end"), (4, "another text of no class at all")]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert sorted(zip(got.doc_id, got.class_id, got.class_size, strict=True)) == [(1, 1, 4), (1, 1, 4), (2, 1, 4), (3, 1, 4), (4, 4, 1)]


@pytest.mark.parametrize("n", [900, 200_000])
def test_samples_are_unbiased_in_long_texts(n):
    s = np.unique(np.random.default_rng(5).integers(0, 1 << 63, n, np.uint64))
    tf = np.where(np.arange(len(s)) % 2, 2.0, 4.0)
    a, b = (s, tf), (s, tf * 1.2)
    sampler = neardup.Sampler(neardup.MORE_SAMPLES, 10)
    assert abs((sampler(*a) == sampler(*b)).mean() - 1 / 1.2) < 0.045


def test_tokens_match_library():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(bpe_path()), tokens.Encoder(bpe_path())
    for t in ["", " ", "a", " a", "a  b", "a   b", "   a", "a ", "a  ", "a\n", "a \n b", "a\n  b", "\n \n", "it's 's don't", "é ñ ç", "漢字 かな", "x <|endoftext|> y", "a  b", "a\t\tb  ", "12 345,6 !!", "emoji 😀 ok", LONG[:3000]]:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(docs):
    got = packing.pack(docs, bpe_path()).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    for _, g in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(bpe_path())
    for i, t in docs.select("doc_id", "text").limit(20).toPandas().itertuples(index=False):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 0]
        for p in got[got.doc_id == i].itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        assert got[got.doc_id == i].length.sum() == len(ids)


def bulk_best_fit(lengths, capacity):
    """(rounds of) brute force: in each round the longest first, every document takes the smallest unused gap that holds it."""
    left, gaps, where = sorted(((n, i) for i, n in enumerate(lengths)), key=lambda x: (-x[0], x[1])), {}, {}
    moved = False
    while left:
        if not moved:
            gaps |= {len(gaps) + k: capacity for k in range(-(-sum(n for n, _ in left) // capacity))}
        unused, rest, moved = dict(gaps), [], False
        for n, i in left:
            # Of equal gaps the one with the largest number is the last that the sweep passed.
            fits = [(room, -seq) for seq, room in unused.items() if room >= n]
            if fits:
                room, seq = min(fits)
                del unused[-seq]
                where[i] = -seq, capacity - room
                gaps[-seq] = room - n
                moved = True
            else:
                rest.append((n, i))
        left = rest
    return where


@pytest.mark.parametrize("range_rows", [40, 1000])
def test_best_fit_rounds_equal_brute_force(spark, range_rows):
    rng = np.random.default_rng(0)
    lengths = [*rng.integers(1, 100, 120).tolist(), *[37] * 60, *[99] * 20]  # a hot length in many ranges
    docs = spark.createDataFrame(list(enumerate(lengths)), "key long, size long")
    got = {r["key"]: (r["sequence"], r["offset"]) for r in packing.best_fit(docs, 100, range_rows).collect()}
    want = bulk_best_fit(lengths, 100)
    assert {i: x[1] for i, x in got.items()} == {i: x[1] for i, x in want.items()} and len({x[0] for x in got.values()}) == len({x[0] for x in want.values()})
    used = Counter()
    for i, (seq, _) in got.items():
        used[seq] += lengths[i]
    assert max(used.values()) <= 100
    assert packing.best_fit(docs.limit(0), 100).count() == 0


def test_rounds_are_close_to_best_fit_decreasing(spark):
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2048, 3000)
    free, opened = [], 0
    for n in np.sort(lengths)[::-1].tolist():
        fits = [g for g in free if g >= n]
        if fits:
            g = min(fits)
            free.remove(g)
        else:
            g, opened = 2048, opened + 1
        free.append(g - n)
    docs = spark.createDataFrame(list(enumerate(lengths.tolist())), "key long, size long")
    assert packing.best_fit(docs).select("sequence").distinct().count() <= opened * 1.02


def test_learned_models(docs, spark):
    lang = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = lang[lang.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    q = quality.quality(spark.read.parquet(f"{big}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (q.predicted == q.quality).mean() > 0.93 and q.score.between(0, 1).all()


def test_fingerprints(docs):
    got = fingerprints.compare_with_next(docs).toPandas().set_index("doc_id")
    texts = docs.toPandas().set_index("doc_id").text
    order = sorted(texts.index, reverse=True)
    for d, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, third = texts[d], len(texts[d]) // 3
        e = t[: len(t) - third] + texts[nxt][:third]
        assert got.loc[d, "edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got.loc[d, "n_chars"] == len(t)
        a, b = (set(re.findall("." * 8, fingerprints.fingerprint(fingerprints.signatures(x)))) for x in (t, e))
        assert abs(got.loc[d, "near_edited"] - len(a & b) / len(a | b)) < 1e-12


def plain_signatures(text):
    """The rule of spot signatures word by word: sets of (anchor or none, content words of the chain)."""
    words = re.findall(r"[^\W_]+", text.lower())
    out, run = set(), 0
    for i, w in enumerate(words):
        rest = [x for x in words[i if w not in fingerprints.ANCHORS else i + 1 :] if x not in fingerprints.ANCHORS][: fingerprints.CHAIN]
        if w in fingerprints.ANCHORS:
            out.add((w, *rest))
            run = 0
        else:
            if run % fingerprints.RUN == 0 and (run > 0 or i == 0):
                out.add((None, *rest))
            run += 1
    return out


def test_spot_signatures_brute_force(docs):
    texts = [*docs.toPandas().text, "the", "the of", "zq", "zq wq xq vq uq the rq", "the zq of wq", "!!", ""]
    plain = [plain_signatures(t) for t in texts]
    hashed = [fingerprints.signatures(t) for t in texts]
    for t, a, b in zip(texts, plain, hashed, strict=True):
        assert len(b) == (len(a) or bool(t))
    for k in range(1, len(texts) - 3):
        a, b = plain[k - 1], plain[k]
        want = len(a & b) / len(a | b)
        assert fingerprints.likeness(hashed[k - 1], hashed[k], 0.0) == pytest.approx(want)
        pruned = fingerprints.likeness(hashed[k - 1], hashed[k])
        assert pruned == pytest.approx(want) or pruned == 0 and want < fingerprints.FLOOR


def test_attention_forward_gradient_and_long_texts():
    rng = np.random.default_rng(1)
    model = quality.Attention(np.zeros(quality.FEATURES), np.ones(quality.FEATURES))
    texts = ["".join(rng.choice(list("abc de.\n"), n)) for n in (3, 700, 5000)]
    bags = [quality.scale(quality.passages(t)) for t in texts]

    def naive(bag):
        p = model.p
        h = [np.tanh(x @ p["W"] + p["b"]) for x in bag]
        e = [float((np.tanh(v @ p["V"]) / (1 + np.exp(-(v @ p["U"])))) @ p["w"][:, 0]) for v in h]
        a = np.exp(e) / np.exp(e).sum()
        return 1 / (1 + np.exp(-float(sum(w * v for w, v in zip(a, h, strict=True)) @ p["c"][:, 0] + p["d"][0])))

    want = [naive(b) for b in bags]
    assert quality.score_texts(model, texts) == pytest.approx(want, abs=1e-5)
    assert model.score_long(quality._bytes(texts[2]), held=2) == pytest.approx(want[2], abs=1e-5)
    starts, x, y = np.cumsum([0, *map(len, bags[:-1])]), np.concatenate(bags), np.array([1, 0, 1], np.float32)
    loss = lambda: float(-np.mean(np.where(y > 0, np.log(s := model.forward(x.astype(np.float64), starts)[0]), np.log(1 - s))))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    grads = model.gradient(x, starts, y)
    for k in model.p:
        i = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        model.p[k][i] += 1e-4
        up = loss()
        model.p[k][i] -= 2e-4
        down = loss()
        model.p[k][i] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(float(grads[k][i]), rel=0.02, abs=1e-5)


def test_bundles_brute_force():
    letters = langid._letters(64, 3)
    texts = ["abc", "the cat sat", "ünder 12 z"]
    got = langid.bundles([langid.trigrams(t) for t in texts], letters)
    for t, b in zip(texts, got, strict=True):
        s, want = langid.symbols(t).tolist(), np.zeros(64)
        for i in range(len(s) - 2):
            want += np.roll(letters[s[i]], 2) * np.roll(letters[s[i + 1]], 1) * letters[s[i + 2]]
        assert (b == want).all()


def test_embeddings_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 64))
    x[100:160] = x[:60] + 0.25 * rng.standard_normal((60, 64))
    x[160:200] = x[5] + 0.1 * rng.standard_normal((40, 64))
    x[200] = x[201] = x[7]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [None] + [1.0] * 63, 1), (904, [1.0], 1), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int")
    got = embeddings.similar(df).toPandas()
    assert len(got) == len(rows) and len(embeddings.similar(df.limit(0)).toPandas()) == 0
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((u @ u.T) >= 0.9).sum(1) - 1
    have = got[got.vec_id < 300].sort_values("vec_id").n_links.to_numpy()
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
    assert (got[got.vec_id >= 900].n_links == 0).all()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert {got[i] for i in range(61)} == {0} and got[101] == 100 and 200 not in got


def test_warc(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" * 200
    pages = spark.createDataFrame([(1, "u", big), (2, "u\r\nX: y", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (2, "u\r\nX: y", big)], "page_id long, url string, html string")
    warc.write(warc.plan(pages), str(tmp_path / "w"))
    got = warc.resolve(warc.read(spark, str(tmp_path / "w"))).toPandas()
    assert Counter(got.record_type) == {"response": 5, "revisit": 2} and set(got[got.record_type == "revisit"].refers_to) == {2}
    assert sorted(got.payload) == sorted([big] * 4 + ["small"] * 2 + [""])
    assert len(warc.round_trip(pages.limit(0)).toPandas()) == 0


def test_warc_query_of_planted_revisits(spark):
    rng = np.random.default_rng(6)
    body = lambda k, n: f"<p>{k}</p>\r\n\r\n" * n
    rows = [(i, f"http://h/{i}", body(int(rng.integers(0, 9)), int(rng.integers(40, 160)) // 40 * 40)) for i in range(300)]
    rows += [(1000 + i, None, body("hot", 300)) for i in range(150)] + [(2000, "u", None), (2001, "u", ""), (2002, "u", "x" * 5_000_000), (2003, "u", "é" * 600)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, original long")
    got = warc.round_trip(pages).toPandas().set_index("page_id").sort_index()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i, last.get(h or "", i))
    for i, _, h in rows:
        b = (h or "").encode()
        to = last[h or ""] if len(b) >= 1000 and last[h or ""] != i else None
        r = got.loc[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type) == (len(b), hashlib.sha1(b).hexdigest(), "revisit" if to else "response")
        assert pd.isna(r.refers_to) if to is None else r.refers_to == to
    assert (got.record_type == "revisit").sum() > 250


def test_preferences(spark):
    turn = lambda r, t: {"turn": 0, "role": r, "text": t}
    schema = "id long, chosen array<struct<turn long, role string, text string>>, rejected array<struct<turn long, role string, text string>>"
    a, b = [turn("user", "q"), turn("assistant", "x")], [turn("user", "q"), turn("assistant", "y"), turn("user", "z")]
    got = preferences.format_pairs(spark.createDataFrame([(1, a, b), (2, a, a), (3, a, a[:1]), (4, a, [turn("system", "s")])], schema)).toPandas().set_index("id")
    assert got.loc[1].tolist() == [1, "<|user|>\nq\n<|assistant|>\n", "x\n", "y\n<|user|>\nz\n", "1:2", "1:2,0:9,0:2"]
    assert got.loc[2, "chosen"] == "" and got.loc[3, "rejected"] == "" and got.loc[3, "chosen"] == "<|assistant|>\nx\n"
    assert got.loc[4, "n_prompt_turns"] == 0 and got.loc[4, "prompt"] == ""
    turns = spark.createDataFrame([(1, 0, None, None, 1), (1, 1, "assistant", None, 1), (None, 0, "assistant", "a", 1), (2, 0, "user", "only", 1)], "conv_id long, turn long, role string, text string, n int")
    assert len(preferences.stale_reply_preferences(turns).toPandas()) == 2
    assert len(preferences.stale_reply_preferences(turns.limit(0)).toPandas()) == 0


def naive_pair(chosen, rejected):
    """Prefix, prompt, completions and masks of two lists of (role, text), turn by turn."""
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    safe = lambda x: x.replace("<|", "< |")
    head = lambda t: f"<|{safe(t[0])}|>\n"
    prompt = "".join(head(t) + safe(t[1]) + "\n" for t in chosen[:n])
    bare = n < min(len(chosen), len(rejected)) and chosen[n][0] == rejected[n][0]
    texts, masks = [], []
    for side in (chosen, rejected):
        parts = []
        for k, t in enumerate(side[n:]):
            parts += [] if bare and k == 0 else [("0", head(t))]
            parts += [("1" if t[0] == "assistant" else "0", safe(t[1]) + "\n")]
        texts.append("".join(x for _, x in parts))
        masks.append(",".join(f"{b}:{len(x)}" for b, x in parts))
    return [n, prompt + (head(chosen[n]) if bare else ""), *texts, *masks]


def test_preferences_brute_force(spark):
    rng = np.random.default_rng(8)
    said = ["yes", "no", "", "é 漢", "x <|assistant|>\nforged", "<<||"]
    talk = lambda n: [(["system", "user", "assistant", "<|a"][rng.integers(0, 4)], said[rng.integers(0, 6)]) for _ in range(n)]
    pairs = {}
    for i in range(150):
        a = talk(rng.integers(0, 7))
        k = int(rng.integers(0, len(a) + 1))
        pairs[i] = a, a[:k] + talk(rng.integers(0, 4))
    schema = "id long, chosen array<struct<turn long, role string, text string>>, rejected array<struct<turn long, role string, text string>>"
    rows = [(i, *([(k, *t) for k, t in enumerate(side)] for side in p)) for i, p in pairs.items()]
    got = preferences.format_pairs(spark.createDataFrame(rows, schema)).toPandas().set_index("id")
    assert all(got.loc[i].tolist() == naive_pair(*p) for i, p in pairs.items()) and got.n_prompt_turns.nunique() > 4


def test_preference_query_and_its_sql(spark, tmp_path):
    import duckdb

    rows = [r[1:] for r in spark.read.parquet(f"{DIR}/conversations.parquet").toPandas().itertuples()]
    rows += [(-7, k, r, t) for k, (r, t) in enumerate([("assistant", "a <|user|>"), ("user", "b"), ("assistant", "c"), (None, None), ("assistant", "a <|user|>")])]
    rows += [(None, 0, "user", "q"), (None, None, "assistant", "first"), (99_999, 0, "user", "alone"), (70_000, 0, "assistant", ""), (70_000, 1, "user", "z")]
    turns = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    turns.to_parquet(tmp_path / "c.parquet")
    got = preferences.stale_reply_preferences(spark.read.parquet(str(tmp_path / "c.parquet"))).toPandas()
    con = duckdb.connect()
    con.execute(f"create view conversations as from '{tmp_path}/c.parquet'")
    key = lambda x: (x[0] is None or x[0] != x[0], 0 if x[0] is None or x[0] != x[0] else int(x[0]))
    both = [sorted((tuple(r) for r in rs), key=key) for rs in (got.itertuples(index=False), con.execute(preferences.PREFERENCE_SQL).fetchall())]
    assert [(key(r), *r[1:]) for r in both[0]] == [(key(r), *r[1:]) for r in both[1]]
    ids = {c for c, _, r, _ in rows if r == "assistant"}
    assert len(got) == len(ids) and got.n_prompt_turns.nunique() > 3
    for c in [i for i in ids if i is not None and 0 <= i < 50]:
        own = [(r, t) for i, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        at = [k for k, t in enumerate(own) if t[0] == "assistant"]
        other = list(own)
        other[at[c % len(at)]] = "assistant", "" if c % len(at) == 0 else own[at[0]][1]
        assert got[got.conv_id == c].iloc[0, 1:].tolist() == naive_pair(own, other)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    n = [docs.count()]
    for name, step in p.STAGES[:-1]:
        docs = step(spark, docs, DIR).persist()
        assert docs.columns == p.COLUMNS
        n.append(docs.count())
    assert n[1] >= 0.97 * n[0] and n[2] < n[1] and n[3] >= 0.9 * n[2]
    assert docs.selectExpr("sum(regexp_count(text, '[^ \\\\t-\\\\r]+')) as w").first()["w"] > 0
    out = p.pack(spark, docs, DIR).toPandas()
    assert isinstance(out, pd.DataFrame) and out.groupby("sequence_id").length.sum().max() <= 2048


def test_mix_stage_emits_whole_documents(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{k}\n" for k in range(50 + 37 * i)), "en", f"s{i % 3}", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    want = {r["doc_id"]: r for r in mixing.mix(docs, source_col="source").collect()}
    whole = docs.toPandas().set_index("doc_id").text
    got = p.mix_sources(spark, docs, DIR).toPandas()
    assert all(whole[d] == t for d, t in zip(got.doc_id, got.text, strict=True))
    n = Counter(got.doc_id)
    assert all(abs(n[d] * r["size"] - r["taken"]) * 2 <= r["size"] for d, r in want.items())


def test_language_stage_rejects_random_letters_and_keeps_clean_texts(spark):
    import corpus_pipeline as p

    rng = np.random.default_rng(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(p.COLUMNS)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(60)) for _ in range(300)]
    rows = [(-1 - i, t, None, "s", len(t)) for i, t in enumerate([*noise, "Osra\u00f1."])]
    got = p.language_id(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), DIR).toPandas().doc_id
    clean = docs.filter("text rlike '[A-Za-z]'").count()
    assert (got < 0).sum() <= 0.1 * len(noise) and (got >= 0).sum() >= 0.99 * clean
    print((got < 0).sum(), (got >= 0).sum(), clean)
