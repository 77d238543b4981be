"""Vector codes, packing and ranking against brute force, on odd small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from chalkline.llm import packing, ranking, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(3)
    rows = [(i, [round(rng.gauss(0, 0.3), 2) for _ in range(16)], rng.choice([1, 2, None]), "clash") for i in range(100)]
    rows += [(100 + i, rows[7][1], 1, "copy") for i in range(30)]  # copies and ties
    rows += [(200, None, 1, ""), (201, [0.1, None] * 8, 2, ""), (202, [float("nan")] * 16, 1, ""), (203, [float("inf")] + [0.0] * 15, 1, ""), (-5, [float("-inf")] * 16, 1, "")]
    rows += [(3, rows[3][1], 2, "repeated"), (None, rows[4][1], None, "no id"), (300, [0.5] * 3, 2, "short"), (301, [], 1, "empty"), (302, [1e30] * 16, 1, "large"), (303, [-0.0001] * 16, 1, "floor")]
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(r.vec_id, r.label, [math.floor(max(-(2.0**26), min(2.0**26, 4096 * x))) for x in r.embedding]) for r in rows if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    size = -(-max(len(v) for *_, v in kept) // parts)
    kept = [(i, label, [(v + [0] * parts * size)[p * size : (p + 1) * size] for p in range(parts)]) for i, label, v in kept]
    first = {}
    for i, _, v in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        first.setdefault(i, v)
    books = [[v[p] for v in list(first.values())[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            held = {}
            for *_, v in kept:
                held.setdefault(near(p, v[p])[1], []).append(v[p])
            new.append([[sum(c) // len(held[k]) for c in zip(*held[k])] if k in held else e for k, e in enumerate(books[p])])
        books = new
    found = [(i, label, "".join(f"{near(p, v[p])[1]:02x}" for p in range(parts)), sum(near(p, v[p])[0] for p in range(parts))) for i, label, v in kept]
    totals = Counter()
    for _, label, _, error in found:
        totals[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(i), code, error, totals[label], digest) for i, label, code, error in found)


def test_vector_codes(vectors, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 7)
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.vector_codes(vectors).collect())
    assert got == brute_codes(vectors.collect())
    assert vectors.sparkSession.sql("SHOW DATABASES LIKE 'chalkline*'").count() == 0


def test_vector_codes_of_few_and_none(vectors):
    few = vectors.where("vec_id in (1, 2, 5)")
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.vector_codes(few).collect())
    assert got == brute_codes(few.collect()) and {g[2] for g in got} == {0}
    assert vector_codes.vector_codes(vectors.where("vec_id = 200")).collect() == []
    rows, books = vector_codes.learn_codes(few)
    x = rows.where("vec_id = 2").first().code
    assert vector_codes.decoded(x, books) == [math.floor(4096 * c) / 4096 for c in few.where("vec_id = 2").first().embedding]


def test_only_changes_are_counted():
    import numpy as np

    books = np.array([[[0], [10]]])
    v = np.array([[[1]], [[9]], [[2]]])
    entries, distances = vector_codes.nearest(v, books)
    assert entries.ravel().tolist() == [0, 1, 0] and distances.ravel().tolist() == [1, 1, 4]
    assert vector_codes.contributions(v, entries, entries, books) == []
    before = np.array([[0], [0], [0]], np.uint8)
    assert vector_codes.contributions(v, entries, before, books) == [{"part": 0, "entry": 0, "n": -1, "sums": [-9]}, {"part": 0, "entry": 1, "n": 1, "sums": [9]}]
    tied, _ = vector_codes.nearest(np.array([[[5]]]), books)
    assert tied.tolist() == [[0]]


def test_nearest_of_large_numbers():
    import numpy as np

    v, b = np.array([[[1 << 26] * 8]]), np.array([[[-(1 << 26)] * 8, [(1 << 26) - 1] * 8]])
    entries, distances = vector_codes.nearest(v, b)
    assert entries.tolist() == [[1]] and distances.tolist() == [[8]]


def fewest(items, capacity):
    best, items = [len(items)], sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) < best[0]:
            if i == len(items):
                best[0] = len(bins)
                return
            for j in {b: j for j, b in enumerate(bins)}.values():
                if bins[j] >= items[i]:
                    go(i + 1, [*bins[:j], bins[j] - items[i], *bins[j + 1 :]])
            go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_packing_is_optimal_on_small_sets():
    rng, better = random.Random(1), 0
    for _ in range(300):
        capacity = rng.choice([10, 20, 50, 100])
        items = [rng.randint(max(1, capacity // 7), capacity // 2) if rng.random() < 0.7 else rng.randint(1, capacity) for _ in range(rng.randint(1, 11))]
        found, proved = packing.solve(Counter(items), capacity)
        packed = Counter()
        for filling, copies in found:
            assert sum(x * n for x, n in filling) <= capacity
            for x, n in filling:
                packed[x] += n * copies
        count = sum(n for _, n in found)
        assert packed == Counter(items) and proved and count == fewest(items, capacity), items
        better += count < sum(n for _, n in packing.best_fit(Counter(items), capacity))
    assert better  # the search finds more than its incumbent


def test_bounds_and_dominance():
    assert packing.lower_bound({6: 3, 4: 3}, 10) == 3 and packing.lower_bound({6: 3}, 10) == 3
    assert packing.dominates(((5, 1),), ((3, 1), (2, 1))) and not packing.dominates(((3, 1), (2, 1)), ((5, 1),))
    assert packing.fillings({5: 1, 3: 1, 2: 1}, 5, 5) == ([((5, 1),)], True)
    assert packing.solve({}) == ([], True)
    runs = packing.runs_of([(((4, 2), (2, 1)), 3), (((4, 1),), 1)])
    assert runs == [(2, 0, 1, 0, 8), (4, 0, 2, 0, 0), (4, 6, 1, 3, 0)]


def test_packed_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(2)
    words = "Alpha beta, GAMMA don't l'été ünï 12a3 x.y;z <|endoftext|> naïve! ΣΑΣ İi é ́ ok".split(" ")
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)] + [None, "", " \n\t ", "a b c\x85d", "solo " * 9000, "x" * 3000, "two\n\nlines "]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(0, texts[0], "repeated", 1), (None, "no id", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int").repartition(3)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for p, a in enumerate(range(0, len(ids), 256)):
            part = ids[a : a + 256]
            wanted[(i, p, a, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))] += 1
    pieces = packing.write_pieces(docs, f"{spark.conf.get('spark.checkpoint.dir')}/pieces-test", capacity=256, keep_ids=True)
    placed = packing.place_pieces(pieces, 256).cache()
    got = placed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == wanted
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 256
    numbers = Counter(r.length for r in got)
    assert len(bins) == packing.lower_bound(numbers, 256)
    sequences = packing.packed_sequences(pieces, placed).collect()
    assert len(sequences) == len(bins)
    for r in sequences:
        for s in r.segments:
            ids = r.ids[s.offset :][: dict(bins[r.sequence_id])[s.offset]]
            assert any(k[0] == s.doc_id and k[1] == s.piece and k[4] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)) for k in wanted)
    assert packing.packed_documents(docs.where("false")).collect() == []


def brute_ranking(docs, items, top=10):
    terms = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 25 + 75 * c.total() * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows, fan, size", [(4096, 16, 8 << 20), (9, 2, 60), (1, 3, 8 << 20)])
def test_ranking(spark, monkeypatch, rows, fan, size):
    monkeypatch.setattr(ranking, "SHARD_ROWS", rows)
    monkeypatch.setattr(ranking, "FAN", fan)
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(200)] + ["Ünï", "E-mail", "x_y", "don't"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(150)]
    docs += [(200 + i, docs[5][1]) for i in range(25)] + [(5, docs[5][1]), (None, docs[5][1]), (300, None), (301, ""), (302, " \x00!?"), (303, "w1 " * 20_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)] + [(12, docs[5][1]), (13, None), (14, "unheard"), (3, "w2 w2 w2"), (None, "w3 X_Y")]
    table = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, shard string, score long").repartition(3)
    asked = spark.createDataFrame([(*d, "clash") for d in items], "item_id long, text string, doc_id string")
    index = ranking.write_index(table, f"{spark.conf.get('spark.checkpoint.dir')}/index-{rows}-{fan}")
    got = sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranking.search(index, asked, size=size).collect()), key=str)
    assert got == brute_ranking(docs, items)
    assert index.count() > len(docs) // rows / 2


def test_row_groups_of_an_index_stay_small_however_many_ranges_a_file_has(spark, tmp_path, monkeypatch):
    """Spark reads a row group at once; ten ranges of one task came in one group of 12 MB before."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    monkeypatch.setattr(ranking, "SHARD_ROWS", 1)
    words = F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.substring(F.md5((i * 1000 + F.col("id")).cast("string")), 1, 9))
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text")).coalesce(1)
    index = ranking.write_index(docs, str(tmp_path / "index"))
    (file,) = (tmp_path / "index").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert index.count() == meta.num_rows == 10
    assert max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) <= 2 * ranking.GROUP_BYTES


def test_ranking_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.ranked_documents(spark, docs.where("false"), items).collect() == []
    assert ranking.ranked_documents(spark, docs, items.where("false")).collect() == []
    assert [tuple(r) for r in ranking.ranked_documents(spark, docs, items).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 800)))]
