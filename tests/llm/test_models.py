"""Learned models, spectral features and the pipeline's stages against plain recomputations."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.llm import decontaminate, media, mixing, quality, simhash, toxicity
from tests.llm.test_operators import WORDS, bench_rows, brute_contamination, labelled


def plain_words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def plain_toxicity(model, text):
    """1 less the product of all sentences' chances of being harmless."""
    harmless, any_words = 1.0, False
    for sentence in re.split(r"[.!?\n]", text):
        words = plain_words(sentence)
        if not words:
            continue
        any_words = True
        z = model.bias
        for w in words:
            data = w.encode()
            z += model.weights.get(b"=" + data, 0.0) + sum(model.weights.get(b"^" + data[:k], 0.0) for k in (4, 5, 6, 8) if len(data) > k)
        harmless *= 1 - 1 / (1 + np.exp(-z))
    return 1 - harmless if any_words else 1 / (1 + np.exp(-model.bias))


def test_toxicity_scores_are_noisy_or():
    rows = labelled(4)
    model = toxicity.fit(rows)
    odd = ["", " \n..", "!!! vile", "Ünï nastyx. nastyq? ok", "one", "VILE\nvile", "a.b.c nastyq"]
    for text in [t.decode() for t, _ in rows[:80]] + odd:
        assert model.score(text.encode()) == pytest.approx(plain_toxicity(model, text), abs=1e-9)


def test_toxicity_fit_is_a_minimum():
    rows = labelled(5)[:300]
    model = toxicity.fit(rows)

    def loss(weights, bias):
        moved = toxicity.SentenceModel(weights, bias)
        p = np.clip([moved.score(t) for t, _ in rows], 1e-12, 1 - 1e-12)
        y = np.array([y for _, y in rows])
        return -np.mean(np.where(y > 0, np.log(p), np.log(1 - p))) + toxicity.DECAY / 2 * sum(w * w for w in weights.values())

    best, rng = loss(model.weights, model.bias), random.Random(1)
    assert best < 0.2 * loss({f: 0.0 for f in model.weights}, -1.4)
    for f in rng.sample(sorted(model.weights), min(8, len(model.weights))):
        for step in (-0.5, 0.5):
            assert loss(model.weights | {f: model.weights[f] + step}, model.bias) > best - 2e-3


def test_dual_descent_reaches_the_least_objective():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, 8)) for _ in range(120)]
    values = [rng.normal(size=len(r)) for r in rows]
    y = np.where(rng.random(120) < 0.4, 1.0, -1.0)
    w = quality._descend(rows, values, y, 30)

    def objective(u):
        margins = np.array([u[r] @ v + u[30] for r, v in zip(rows, values)])
        return u @ u / 2 + quality.COST * np.maximum(0, 1 - y * margins).sum()

    # a plain subgradient descent, slow and sure
    u, best = np.zeros(31), objective(np.zeros(31))
    for step in range(1, 6000):
        margins = np.array([u[r] @ v + u[30] for r, v in zip(rows, values)])
        g = u.copy()
        for i in np.flatnonzero(y * margins < 1):
            g[rows[i]] -= quality.COST * y[i] * values[i]
            g[30] -= quality.COST * y[i]
        u = u - g / (step + 5)
        best = min(best, objective(u))
    assert objective(w) <= best * 1.002


def test_quality_indicators_and_scores():
    def classes(data):
        marks = {b".,;:": 6, b"!?": 8, b"|": 9, b"#$%&*": 10, b"-_=+/": 11, b"<>()[]{}\"'": 12}
        for c in data:
            yield 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c >= 128 else 4 if c == 32 else 5 if c == 10 else next((k for m, k in marks.items() if c in m), 7)

    rng = random.Random(6)
    texts = [b"", b"ab", "Ünï ab ab 12!!".encode(), *[" ".join(rng.choices([*WORDS, "X|y", "##", "1-2", "(z)"], k=rng.randint(1, 40))).encode() for _ in range(40)]]
    for text in texts:
        own = list(classes(text))
        counts = collections.Counter(zip(own, own[1:], own[2:]))
        total = max(1, sum(counts.values()))
        wanted = {((a * 13 + b) * 13 + c) * 5 + i for (a, b, c), n in counts.items() for i, s in enumerate(quality.SHARES) if n / total > s}
        assert set(quality.shape_indicators(text).tolist()) == wanted
    model = quality.fit([(t, i % 2) for i, t in enumerate(texts * 3)])
    for text in texts:
        words = text.split()
        grams = set(words) | {b" ".join(p) for p in zip(words, words[1:])}
        known = [model.grams[g] for g in grams if g in model.grams]
        shapes = [*quality.shape_indicators(text).tolist(), *quality.repeat_indicators(words)]
        margin = model.bias + (sum(model.shapes[i] for i in shapes) + sum(known)) / np.sqrt(max(1, len(shapes) + len(known)))
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30))), abs=1e-9)


def test_scores_of_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, "vile thing. ok", "x"), (2, "vile " * 60_000, "x"), (3, "fine words", "x"), (3, "fine words", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string")
    one, two = toxicity.fit(labelled(7)), quality.fit([(t, 1 - y) for t, y in labelled(8)])
    for found, model in ((toxicity.toxicity(table, one), one), (quality.quality(table, two), two)):
        got = sorted((str(r.doc_id), round(r.score, 9)) for r in found.collect())
        assert got == sorted((str(i), round(model.score((t or "").encode()), 9)) for i, t, _ in rows)
    kept = toxicity.remove_toxic(table, one)
    assert kept.columns == table.columns
    wanted = sorted(str(r) for r in rows if one.score((r[1] or "").encode()) < toxicity.THRESHOLD)
    assert sorted(str(tuple(r)) for r in kept.collect()) == wanted
    assert toxicity.remove_toxic(table.where("false"), one).count() == 0


def plain_peaks(data):
    """Every frame's spectrum by its sum, and the highest bin of each band that stands out."""
    samples = np.concatenate([np.full(media.FRAME - media.HOP, 128.0), np.frombuffer(data, np.uint8).astype(float)]) - 128
    window, found = np.hanning(media.FRAME), []
    for k in range(max(1, -(-len(samples) // media.HOP))):
        part = samples[k * media.HOP :][: media.FRAME]
        part = np.concatenate([part, np.zeros(media.FRAME - len(part))]) * window
        power = np.array([abs(np.exp(-2j * np.pi * b * np.arange(media.FRAME) / media.FRAME) @ part) for b in range(128)])
        for low, high in zip(media.BANDS, media.BANDS[1:]):
            b = low + int(power[low:high].argmax())
            if power[b] > 2 * power[low:high].mean() and power[b] > 1:
                found.append((k, b))
    return found


def test_media_features_by_sums():
    rng = random.Random(2)
    for n in (1, 40, 260, 700):
        payload = media.payload_of(" ".join(rng.choices(WORDS, k=n // 6 + 1)).encode()[:n])
        peaks = plain_peaks(payload)
        frames, bins = media.peaks_of(np.frombuffer(payload, np.uint8))
        assert list(zip(frames.tolist(), bins.tolist())) == peaks
        pairs = []
        for i, (k, b) in enumerate(peaks):
            later = [p for p in peaks if p[0] > k][: media.PAIRS]
            pairs += [k << 24 | b << 16 | c << 8 | (m - k) for m, c in later if m - k <= media.SPAN]
        if not pairs:
            pairs = [k << 24 | b << 16 | c << 8 for (k, b), (m, c) in zip(peaks, peaks[1:]) if k == m]
        assert media.landmarks_of(frames, bins).tolist() == sorted(pairs)


def test_media_index_finds_passages(spark):
    rng = random.Random(3)
    passage = " ".join(rng.choices(WORDS, k=200))
    texts = [" ".join(rng.choices(WORDS, k=300)) for _ in range(12)]
    texts[4] = texts[4][:640] + passage
    table = media.media_columns(spark.createDataFrame(list(enumerate([*texts, passage])), "doc_id long, text string"), keep_media=False)
    index = media.media_index(table)
    asked = index.where("doc_id = 12").select("pair", F.col("frame").alias("asked"))
    votes = index.where("doc_id < 12").join(asked, "pair").groupBy("doc_id", (F.col("frame") - F.col("asked")).alias("shift")).count().orderBy(F.col("count").desc()).first()
    assert (votes.doc_id, votes["shift"]) == (4, 10)


def test_stages_on_odd_tables(spark, sf_dir):
    rng = random.Random(11)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(30, 60))) for _ in range(12)]
    items = bench_rows()
    texts = [*base, base[0], base[1], base[1] + " coda", None, None, "", " ", items[3][1] + " x", base[2] + " " + items[4][1], "word " * 20_000]
    rows = [(i if i % 7 else None, t, "en" if i % 2 else None, f"s{i % 3}", 0, "clash", i, "p") for i, t in enumerate(texts)] + [(1, base[5], "en", "s1", 0, "clash", 99, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, times long, root string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    model = toxicity.fit(labelled(9))
    clean = toxicity.remove_toxic(docs, model)
    single = simhash.keep_representatives(clean)
    pure = decontaminate.remove_contaminated(single, bench)
    mixed = mixing.mix(pure, 0.6, 1)
    for df in (clean, single, pure, mixed):
        assert df.columns == docs.columns
    kept = [tuple(r) for r in single.collect()]
    prints = {r[6]: simhash.fingerprint((r[1] or "").encode()) for r in rows}
    up = {r[6]: r[6] for r in rows}
    for _ in rows:
        for a in rows:
            for b in rows:
                if bin(prints[a[6]] ^ prints[b[6]]).count("1") <= 4:
                    up[a[6]] = min(up[a[6]], up[b[6]])
    groups = collections.defaultdict(list)
    for r in rows:
        if model.score((r[1] or "").encode()) < toxicity.THRESHOLD:
            groups[up[r[6]]].append(r)
    assert len(kept) == len(groups)
    for own in groups.values():
        first = min(own, key=lambda r: (r[0] is None, r[0] or 0))
        assert any(r in kept and (r[0], r[0] is None) == (first[0], first[0] is None) for r in own)
    left = sorted(str(tuple(r)) for r in pure.collect())
    assert left == sorted(str(r) for r in kept if not brute_contamination(r[1] or "", items)[4])
    assert set(map(str, mixed.collect())) < {str(r) for r in pure.collect()}
    none = docs.where("false")
    for df in (toxicity.remove_toxic(none, model), simhash.keep_representatives(none), decontaminate.remove_contaminated(none, bench), mixing.mix(none)):
        assert df.count() == 0 and df.columns == docs.columns
