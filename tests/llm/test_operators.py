"""Operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chalkline.llm import chat, decontaminate, licences, media, mixing, quality, simhash, tokens, toxicity, urls

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(1, 80))) for _ in range(40)]
    near = [b.replace("alpha", "omega", 1) for b in base[:10]] + [b + " coda" for b in base[:10]]
    odd = [None, "", " \t\n", "One", "one two THREE", "a  b   c\u00a0d e", "ünï çödé Ünï", "x " * 50_000, "word\x00 nul", "'s ''s!! 12 3\n\n end ", " lead", "trail "]
    return [*base, *base[:5], *near, *odd]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", 0, "clash", i) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s0", 0, "clash", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, score long").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_in_pieces(texts, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 37)
    for text in texts:
        if len(text or "") < 5000:
            assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_near_duplicates(docs, texts):
    prints = [brute_fingerprint(t) for t in texts]
    up = list(range(len(texts)))
    for _ in up:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= 4:
                    up[i] = min(up[i], up[j])
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", up[r.doc_id])


def test_representatives_are_single(docs):
    kept = sorted(r.doc_id for r in simhash.keep_representatives(docs).collect())
    wanted = sorted({r.component_id for r in simhash.near_duplicates(docs).collect()})
    assert kept == wanted


def brute_links(codes):
    up = np.arange(len(codes))
    while True:
        close = np.bitwise_count(codes[:, None] ^ codes[None]) <= 4
        new = np.where(close, up[None], len(codes)).min(1)
        if (new == up).all():
            return up
        up = new


@pytest.mark.parametrize("kind", ["random", "ball", "chain"])
def test_index_node(kind):
    rng = np.random.default_rng(1)
    if kind == "random":
        codes = rng.integers(0, 1 << 20, 700, np.uint64)
    elif kind == "ball":
        codes = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, 3, False).astype(np.uint64)) for _ in range(700)], np.uint64)
    else:
        codes = np.cumsum(rng.integers(1, 1 << 12, 700)).astype(np.uint64)
    codes = np.unique(codes)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    assert (simhash.node_forest(codes) == brute_links(codes)).all()


@pytest.mark.parametrize("bits", [24, 64])
def test_links_with_lower_nodes(spark, monkeypatch, bits):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(simhash, "NODE_ROWS", 64)
    codes = np.unique(np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.choice(bits, 4 if bits < 64 else 3, False).astype(np.uint64)) for _ in range(900)], np.uint64))
    rows = spark.createDataFrame([(int(c.view(np.int64)),) for c in codes], "fp long")
    roots = {r.fp: r.root for r in simhash.connected(simhash.near_links(rows)).collect()}
    sets = collections.defaultdict(set)
    for c, u in zip(codes.view(np.int64).tolist(), brute_links(codes).tolist()):
        sets[u].add(c)
    for own in sets.values():
        assert len({roots.get(c, c) for c in own}) == 1
        assert len(own) > 1 or own.isdisjoint(roots)


def test_masks_leave_no_pair_out():
    rng = random.Random(3)
    for rows in (100, 1 << 24, 1 << 30):
        masks = simhash.block_masks(rows)
        for _ in range(300):
            bits = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not bits & m for m in masks)
            lower = simhash.lower_masks(masks[-1], 6)
            assert bits & masks[-1] or any(not bits & m for m in lower)
            assert all(m & masks[-1] == masks[-1] and m.bit_count() > masks[-1].bit_count() for m in lower)


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "<turn user>\n", "</turn>\n<turn+>", "\\l\\g\\\\", "", None, "<", "a<turn", "\\", "Ω😀 ünï", "<turn+>" * 50]
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "odd>\nrole", None]), rng.choice(hard), "extra") for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "no conversation", "x"), (99, None, "assistant", "no turn", "x"), (99, 1, "assistant", "b", "x"), (99, 1, "assistant", "b", "x"), (99, 1, "assistant", "a", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string").repartition(4)
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(table)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, own in by.items():
        own.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, _, r, x in own]
        assert got[c].loss_text == "".join(x for _, _, r, x in own if r == "assistant")
    merged = {r.conv_id: r for r in chat.format_chats(table).collect()}[99]
    assert (merged.n_turns, merged.n_blocks) == (4, 1)
    assert merged.formatted == "<turn assistant>\nno turn<turn+>a<turn+>b<turn+>b</turn>\n"
    assert chat.format_chats(table.where("false")).count() == 0


def test_tokens_equal_whole_texts(docs, spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    plain, at = Tokenizer.from_file(path), 0
    out = str(tmp_path / "ids")
    got = sorted(tokens.stored_tokens(docs, out, partitions=3).collect(), key=lambda r: r.start)
    for r, (i, text) in zip(got, sorted((r.doc_id, r.text or "") for r in docs.collect()), strict=True):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    import pyarrow.parquet as pq

    part = next(tmp_path.glob("ids/part-*.parquet"))
    column = pq.ParquetFile(part).metadata.row_group(0).column(4)
    assert any("DICTIONARY" in e for e in column.encodings) and column.has_offset_index
    assert tokens.stored_tokens(docs.where("false"), str(tmp_path / "none")).count() == 0


def test_pieces_equal_whole_texts_at_random():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    plain, own, rng = Tokenizer.from_file(path), tokens.PieceEncoder(path), random.Random(4)
    chars = ["a", "B", "ü", " ", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "'", "s", "1", "!", "日", "<|endoftext|>", "\r\n", "😀"]
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 30))) for _ in range(3000)] + ["ab. cd, ef\nGh ü! x1 y.z A" * 3, "One two\nthree. Four"]
    flat, sizes = own.encode(pa.array(texts))
    assert flat.tolist() == [i for t in texts for i in [*plain.encode(t, add_special_tokens=False).ids, 0]]
    assert sizes.sum() == len(flat)


def test_pieces_of_other_tokenizers():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    plain, own = Tokenizer.from_file(path), tokens.PieceEncoder(path)
    texts = ["", "Hello  World", "a b c\nd", "x" * 5000, "ÜNÏ <|endoftext|> it's", "one two"]
    flat, sizes = own.encode(pa.array(texts))
    assert flat.tolist() == [i for t in texts for i in [*plain.encode(t, add_special_tokens=False).ids, 0]] and len(sizes) == len(texts)


def test_tokens_of_repeated_ids_over_shards(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rows = [(7, f"text number {i % 90}") for i in range(200)] + [(None, f"none {i}") for i in range(80)] + [(i, None) for i in range(5)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    path = str(tmp_path / "ids")
    tokens.write_tokens(table, path, partitions=5)
    stored = tokens.read_tokens(spark, path)
    found = sorted(stored.collect(), key=lambda r: r.start)
    hashed = {r.text: r.h for r in table.select("text", F.xxhash64(F.col("text").cast("binary")).alias("h")).distinct().collect()}
    wanted = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]], r[1] or ""))
    at = 0
    for r, (doc_id, text) in zip(found, wanted, strict=True):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.ids) == (doc_id, at, ids)
        at += len(ids)
    # metadata alone doesn't read the ids, and a filter of doc_ids reaches the files
    plan = stored.select("doc_id", "n_tokens").where("doc_id = 3")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,3)" in plan and "ReadSchema: struct<doc_id:bigint,n_tokens:int>" in plan.replace("shard:int,", "").replace("shard_start:bigint,", "")


def brute_contamination(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    words, hit, found = find(text), set(), set()
    for item, t in items:
        own = find(t)
        n = min(13, len(own))
        for j in range(len(own) - n + 1 if own else 0):
            for k in range(len(words) - n + 1):
                if words[k : k + n] == own[j : j + n]:
                    hit |= set(range(k, k + n))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


def bench_rows():
    rng = random.Random(8)
    items = [(i, " ".join(rng.choices(WORDS[:6], k=k))) for i, k in enumerate([3, 1, 13, 20, 40, 12, 14, 2, 5])]
    return [*items, (20, None), (21, ""), (22, "..."), (2, items[4][1]), (10, items[3][1]), (30, "Ünï-çödé"), (3, items[3][1])]


def test_contamination(spark, docs):
    items = bench_rows()
    rng = random.Random(6)
    extra = [f"{' '.join(rng.choices(WORDS[:6], k=9))} {items[rng.randint(0, 6)][1].upper()}, {' '.join(rng.choices(WORDS, k=rng.randint(0, 300)))}" for _ in range(40)]
    table = docs.select("doc_id", "text").where("length(text) < 5000 or text is null").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {r.doc_id: r.text for r in table.collect()}
    for r in decontaminate.contamination(table, bench).collect():
        assert tuple(r)[1:] == brute_contamination(rows[r.doc_id], items)
    assert decontaminate.contamination(table, bench.where("false")).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.contamination(table.where("false"), bench).count() == 0


def test_contamination_in_blocks(spark, docs):
    bench = spark.createDataFrame(bench_rows(), "item_id long, text string")
    table = docs.select("doc_id", "text")
    whole = sorted(map(str, decontaminate.contamination(table, bench).collect()))
    assert sorted(map(str, decontaminate.contamination(table, bench, size=100).collect())) == whole
    left = [sorted(map(str, decontaminate.remove_contaminated(docs, bench, size=n).collect())) for n in (100, 1 << 20)]
    assert left[0] == left[1] and 0 < len(left[0]) < docs.count()


def test_contamination_by_rows_of_one_item(spark):
    words = [f"w{i}" for i in range(20)]
    items = [(2, "x w1 w2"), (2, " ".join(words)), (None, "only here"), (2, "x w1 w2")]
    rows = [(1, "a b x " + " ".join(words[1:])), (1, None), (1, "x w1 w2"), (None, "not only here"), (3, "")]
    table, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 10):
        got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(table, bench, size).collect())
        assert got == [(0, 3, 2, 0), (1, 0, 0, 0), (1, 3, 3, 1), (1, 22, 20, 1), (3, 0, 0, 0)]
    kept = decontaminate.remove_contaminated(table.withColumn("n_hit", F.lit("clash")), bench)
    assert kept.columns == ["doc_id", "text", "n_hit"] and sorted(map(str, (r.text for r in kept.collect()))) == ["", "None"]


def test_longest_matches():
    index = decontaminate.BenchmarkIndex([(1, b" ".join(b"w%d" % i for i in range(30)))])
    text = b"x w0 " + b" ".join(b"w%d" % i for i in range(5, 25)) + b" y"
    _, (where, row, start, place, length) = index.search([b"none", text])
    assert (where.tolist(), index.item_ids[row].tolist(), start.tolist(), place.tolist(), length.tolist()) == ([1], [1], [5], [2], [20])


def labelled(kind):
    rng = random.Random(kind)
    rows = []
    for i in range(600):
        sentences = [" ".join(rng.choices(WORDS, k=8)) for _ in range(rng.randint(1, 12))]
        y = i % 5 == 0
        if y:
            k = rng.randrange(len(sentences))
            sentences[k] = sentences[k].replace(" ", " " + rng.choice(["nastyx", "nastyq", "vile"]) + " ", 1)
        rows.append((". ".join(sentences).encode(), int(y)))
    return rows


def test_toxicity_learns_sentences(spark):
    rows = labelled(1)
    model = toxicity.fit(rows[:450])
    predicted = [int(model.score(t) >= toxicity.THRESHOLD) for t, _ in rows[450:]]
    assert np.mean([p == y for p, (_, y) in zip(predicted, rows[450:])]) > 0.97
    found = toxicity.offending_sentences(spark.createDataFrame([(1, "All is well. You vile alpha! Bye."), (2, None)], "doc_id long, text string"), model).collect()
    assert [(r.doc_id, r.sentence.strip()) for r in found] == [(1, "You vile alpha")]
    assert 0 <= model.score(b"") < toxicity.THRESHOLD


def test_toxicity_without_both_labels(docs, spark, none):
    assert toxicity.fit([]).score(b"anything") == pytest.approx(0.5)
    assert toxicity.fit([(b"a", 0), (b"b", 0)]).score(b"") < 0.3
    model = toxicity.fit([])
    assert toxicity.toxicity(docs, model).count() == docs.count()
    assert toxicity.toxicity(none, model).count() == 0


def test_held_out_rows_are_not_learned(spark, docs):
    from chalkline.llm.samples import learning_rows

    ids = [r.doc_id for r in docs.select("doc_id").distinct().collect()]
    labels = spark.createDataFrame([(i, i % 2, None) for i in ids] + [(None, 1, 1), (0, None, 1)], "doc_id long, toxic int, quality int")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    wanted = [(texts[i], i % 2) for i in ids if zlib.crc32(str(i).encode()) % 4 != 2]
    got = learning_rows(docs, labels, "toxic")
    assert set(got) == set(wanted)
    assert learning_rows(docs, labels, "quality") == [(texts[0], 1)] * (zlib.crc32(b"0") % 4 != 2)
    assert len(learning_rows(docs, labels, "toxic", rows=5)) <= 6


def test_long_texts_leave_the_sample_to_others(spark):
    from chalkline.llm.samples import learning_rows

    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, "x" * 5000 if k % 3 == 0 else f"text {i}") for k, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    got = learning_rows(docs, labels, "toxic", size=4000)
    assert sorted(got) == sorted((f"text {i}".encode(), i % 2) for k, i in enumerate(ids) if k % 3)
    assert len(learning_rows(docs, labels, "toxic", size=8000)) == len(got) + 1


def test_quality_learns_shapes():
    rng = random.Random(2)
    rows = []
    for i in range(600):
        words = rng.choices(WORDS, k=rng.randint(5, 60))
        bad = i % 4 == 0
        text = "!! ".join(words).upper() if bad and i % 8 else " ".join(w + "###" for w in words) if bad else ". ".join(words).capitalize()
        rows.append((text.encode(), int(not bad)))
    model = quality.fit(rows[:400])
    assert np.mean([(model.score(t) >= quality.THRESHOLD) == y for t, y in rows[400:]]) > 0.97
    assert 0 <= model.score(b"") <= 1 and quality.fit([]).score(b"x") == pytest.approx(0.5)


def test_quality_rows(docs, none):
    model = quality.fit([])
    rows = quality.quality(docs, model).collect()
    assert len(rows) == docs.count() and quality.quality(none, model).count() == 0
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_media_round_trip(docs, none, texts):
    rows = media.media_columns(docs).collect()
    assert len(rows) == len(texts) + 1 and media.media_columns(none).count() == 0
    by_text = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert media.read_back(bytes(r.media)) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
        assert by_text.setdefault(data, r.feature) == r.feature


def test_media_peaks_in_pieces(monkeypatch):
    samples = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(9000)), np.uint8)
    whole = [x.tolist() for x in media.peaks_of(samples)]
    monkeypatch.setattr(media, "PIECE", 3)
    assert [x.tolist() for x in media.peaks_of(samples)] == whole


def test_media_finds_a_tone():
    t = np.arange(4096)
    frames, bins = media.peaks_of((128 + 100 * np.sin(2 * np.pi * t * 32 / 256)).astype(np.uint8))
    assert set(bins[(bins >= 16) & (bins < 48)]) == {32}


URLS = ["http://A.Example.org/en/1", "https://example.org/es/x?y", "http://x.example.org/es", "ftp://b.com/fr/1#z", "http://com/de/", "http://notorg/x", "nourl", None, "", "http://host.net?q=/en", "://#", "a://b://c/d", "http://q.example.org:80/a", "http://sub.com/fr/\nx"]


def test_url_parts_and_rules(spark):
    table = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    outcomes = spark.createDataFrame([(i, 1) for i in range(6)], "page_id long, good int")
    rows = {r.page_id: r for r in urls.url_verdicts(table, outcomes).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = "", ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u[u.index("://") + 3 :])
            host, path = lowered(m[1]), m[2]
        fits = [(len(r), r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, max(fits)[1] if fits else None)
        assert rows[i].verdict == max(fits)[2] if fits else rows[i].verdict in ("allow", "block")


def test_reputation_shrinks(spark):
    pages = [(i, f"http://h{i % 4}.d{i % 2}.net/{i}") for i in range(400)] + [(1000, "http://new.d0.net/"), (1001, "http://other.zone/"), (1002, "http://few.d1.net/")]
    outcomes = [(i, int(i % 4 != 1)) for i in range(400)] + [(1002, 1)]
    found = {r.host: r for r in urls.reputation(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int")).collect()}
    assert found["h1.d1.net"].lower_bound < found["few.d1.net"].mean < 1 and found["few.d1.net"].mean < found["h0.d0.net"].mean
    assert found["new.d0.net"].lower_bound < found["h0.d0.net"].lower_bound and found["new.d0.net"].mean > found["h1.d1.net"].mean
    assert 0 < found["other.zone"].mean < 1
    empty = spark.createDataFrame([], "page_id long, good int")
    assert {r.mean for r in urls.reputation(spark.createDataFrame(pages, "page_id long, url string"), empty).collect()} == {0.5}


def test_budgets_go_to_siblings_first(spark):
    rows = [("web", "en", "a", 100), ("web", "en", "b", 1000), ("web", "de", "c", 1000), ("books", "en", "d", 100), ("forums", "en", "e", 1000)]
    counted = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.leaf_budgets(counted, 0.5, 1).collect()}
    # 1600: books is short by 380, which web and forums share by weight; a is short and b takes its rest
    web = 800 + 380 * 5 / 7
    assert got["d"] == 100 and got["a"] == 100
    assert got["b"] == int(web / 2 - 100 + 1e-6) and got["c"] == int(web / 2 + 1e-6)
    assert got["e"] == int(320 + 380 * 2 / 7 + 1e-6)
    assert sum(got.values()) <= 1600


def test_budgets_by_weights_of_every_level(spark):
    rows = [("a", "en", "x", 1000), ("a", "en", "y", 1000), ("a", "de", "x", 1000), ("a", None, "z", 1000), ("b", "en", "x", 1000), ("c", "en", "x", 1000)]
    counted = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    weights = {("a",): 3, ("b",): 1, ("a", "en"): 2, ("a", None): 0, ("a", "en", "y"): 3}
    got = {tuple(r)[:3]: r.budget for r in mixing.leaf_budgets(counted, 0.2, 1, weights).collect()}
    # 1200: a 900 (en 600: x 150, y 450; de 300), b 300; c isn't named and has nothing
    assert got == {("a", "en", "x"): 150, ("a", "en", "y"): 450, ("a", "de", "x"): 300, ("a", None, "z"): 0, ("b", "en", "x"): 300, ("c", "en", "x"): 0}
    full = {tuple(r)[:3]: r.budget for r in mixing.leaf_budgets(counted, 1.0, 1, weights).collect()}
    assert sum(full.values()) == 4000 and full["a", None, "z"] == full["c", "en", "x"] == 0


def test_mix_judges_rows_by_their_own_leaf(spark):
    rng = random.Random(3)
    rows = [(i % 40, " ".join(rng.choices(WORDS, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3"])) for i in range(200)]
    rows += [(None, "no id", "en", "s1"), (50, None, "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("times", F.lit(9)).repartition(3)
    for share, epochs in ((0.4, 1), (0.9, 3)):
        ids = collections.Counter((r.doc_id, r.lang, r.source, r.n_tokens) for r in mixing.mixed_ids(docs, share, epochs).collect())
        mixed = mixing.mix(docs, share, epochs)
        assert mixed.columns == docs.columns
        assert ids == collections.Counter((r.doc_id, r.lang, r.source, len((r.text or "").split())) for r in mixed.collect())
    own = mixing.mix(docs, 0.5, 1, weights={("L-de",): 1}, domain=F.concat(F.lit("L-"), F.col("lang")))
    assert {r.lang for r in own.collect() if r.text} == {"de"}


def test_mixing_prefixes(spark, docs, none):
    found = mixing.mixed_ids(docs, 0.6, 2).collect()
    assert found and mixing.mixed_ids(none).count() == 0
    whole = docs.count()
    kept = mixing.mix(docs, 0.6, 1)
    assert kept.columns == docs.columns and kept.count() < whole
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    for r in found:
        assert r.n_tokens == words[r.doc_id]
    # an epoch's part of a leaf is a prefix of its order
    leaf = collections.defaultdict(list)
    for r in docs.withColumn("domain", mixing.domain_of(F.col("source"))).collect():
        leaf[r.domain, r.source].append(r.doc_id)
    taken = collections.defaultdict(set)
    for r in found:
        taken[r.domain, r.source, r.epoch].add(r.doc_id)
    for (domain, source, epoch), own in taken.items():
        order = sorted(set(leaf[domain, source]), key=lambda i: hashlib.md5(f"42:{epoch}:{i}".encode()).hexdigest())
        assert set(order[: len(own)]) == own


def test_licences(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.\nhello", "a/LICENSE"),
        (2, "text\nReleased under the MIT License.", "a/b/x.txt"),
        (3, "nothing here", "a/b/c/y.txt"),
        (4, "nothing at all", "z/y.txt"),
        (5, None, "a/n.txt"),
        (6, "", None),
        (7, "This work is licensed under the GNU General Public License, version 3.", "a/b/COPYING"),
        (8, "the license of version public", "w/y.txt"),
        (9, "nothing", "top.txt"),
    ]
    table = spark.createDataFrame([(*r, "clash") for r in [*rows, rows[2]]], "doc_id long, text string, path string, licence string")
    got = {r.doc_id: (r.own_licence, r.licence, r.inherited_from) for r in licences.licences(table, F.col("path")).collect()}
    assert got[1] == ("Apache-2.0", "Apache-2.0", None) and got[2] == ("MIT", "MIT", None) and got[7] == ("GPL-3.0", "GPL-3.0", None)
    assert got[3] == (None, "GPL-3.0", "a/b") and got[5] == (None, "Apache-2.0", "a")
    assert got[4] == got[6] == got[8] == got[9] == (None, None, None)
    assert licences.licences(table.where("false"), F.col("path")).count() == 0


def test_licence_terms_count_over_all_documents(spark):
    notice = "Copyright Foo. Licensed under the Apache License, Version 2.0."
    rows = [(0, notice), *[(i, "copyright foo " + "bar " * (i % 3)) for i in range(1, 400)]]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r.doc_id: r for r in licences.licences(table).collect()}[0]
    sets = [set(licences.local_terms(t)) for _, t in rows]
    idf = lambda w: math.log((1 + len(rows)) / (1 + sum(w in s for s in sets)))
    unit = {w: licences.local_terms(notice).count(w) * idf(w) for w in licences.local_terms(notice)}
    cosines = []
    for name, text in licences.TEMPLATES:
        own = licences.local_terms(text)
        other = {w: own.count(w) * idf(w) for w in own}
        cosines.append((sum(x * unit.get(w, 0) for w, x in other.items()) / math.hypot(*unit.values()) / math.hypot(*other.values()), name))
    assert terms.own_licence == max(cosines)[1] == "Apache-2.0"
    assert terms.own_score == pytest.approx(max(cosines)[0], abs=2e-6) and terms.own_score > 0.99


def wrapped(text, mark=""):
    return "\n".join(mark + line for line in textwrap.wrap(text, 72 - len(mark)))


def test_wrapped_notices(spark):
    texts_of = {name: text for name, text in licences.WRAPPED}
    mit = "MIT License\n\nCopyright (c) 2020 Foo Bar\n\n" + "\n\n".join(wrapped(x) for x in re.split(r" (?=The above copyright|THE SOFTWARE IS PROVIDED)", texts_of["MIT"], flags=re.M))
    gpl = [wrapped(x, " * ") for x in re.split(r" (?=This program is distributed|You should have)", texts_of["GPL-3.0"])]
    rows = [
        (0, mit, "m/LICENSE", "MIT"),
        (1, "int main;", "m/x.c", "MIT"),
        (2, "/*\n" + "\n *\n".join(gpl) + "\n */\nint main;\nint other;", "g/x.c", "GPL-3.0"),
        (3, "int main;\n\n/*\n" + gpl[0] + "\n */\nint other;", "g/y.c", "GPL-3.0"),
        (4, "#!/bin/sh\n# Copyright Foo\n#\n" + wrapped(texts_of["Apache-2.0"], "# ") + "\nset -e\nls", "a/x.sh", "Apache-2.0"),
        (5, wrapped(texts_of["BSD-3-Clause"], "// ") + "\n\ncode", "b/x.go", "BSD-3-Clause"),
        (6, "// " + wrapped(licences._MIT_GRANT, "// ")[3:] + "\ncode", "c/x.js", "MIT"),
        (7, wrapped(texts_of["LGPL-3.0"], "# "), "l/x.py", "LGPL-3.0"),
        (8, "the use of the software\nis the license of version\npublic", "n/x.txt", None),
    ]
    rows += [(i, " ".join(random.Random(i).choices("the of software is use and in to any or copy file version".split(), k=12)), "z/x.txt", None) for i in range(9, 300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, path string, wanted string")
    got = {r.doc_id: r.licence for r in licences.licences(table, F.col("path")).collect()}
    assert got == {r[0]: r[3] for r in rows}


@pytest.mark.parametrize("shift", [64, 128, 192])
def test_media_finds_a_passage_elsewhere(shift):
    rng = random.Random(3)
    text = " ".join(rng.choices(WORDS, k=600)).encode()
    pairs = [{m & (1 << 24) - 1 for m in media.media_row(data)[-2].tolist()} for data in (text, b"x" * shift + text)]
    assert len(pairs[0] & pairs[1]) >= 0.97 * len(pairs[0])


def test_media_short_texts_have_landmarks():
    rng = random.Random(4)
    for n in range(4, 60):
        assert len(media.media_row(" ".join(rng.choices(WORDS, k=n)).encode()[:256])[-2])
        assert len(media.media_row(" ".join(rng.choices(WORDS, k=n)).encode()[:n])[-2])


def test_representatives_with_null_and_repeated_ids(spark):
    rng = random.Random(9)
    text = [" ".join(rng.choices(WORDS, k=60)) for _ in range(6)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (7, text[2]), (7, text[3]), (7, text[3]), (8, text[4]), (None, text[4]), (9, text[5])]
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int").repartition(3)
    kept = simhash.keep_representatives(table)
    assert kept.columns == table.columns
    wanted = [(None, text[0]), (None, text[1]), (7, text[2]), (7, text[3]), (8, text[4]), (9, text[5])]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, wanted))


def test_long_conversation_grows_with_its_turns(spark):
    import time

    took = []
    for n in (1000, 4000, 8000):
        rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} </turn> \\ " + "x" * 50) for i in range(n)]
        table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        began = time.time()
        (r,) = chat.read_chats(chat.format_chats(table)).collect()
        took.append(time.time() - began)
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in rows] and r.loss_text == "".join(x[3] for x in rows if x[2] == "assistant")
    assert took[2] < 2.5 * took[1] + 1


def test_domains_of_odd_hosts(spark):
    wanted = {
        "a.co.uk": ("a.co.uk", "co.uk"), "x.b.co.uk": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "10.0.0.7": ("10.0.0.7", "10.0.0.7"), "10.0.0.7:80": ("10.0.0.7", "10.0.0.7"), "ex.com:8080": ("ex.com", "com"),
        "w.ex.com.": ("ex.com", "com"), "me:pw@ex.com": ("ex.com", "com"), "[::1]:8080": ("[::1]", "[::1]"), "localhost": ("localhost", "localhost"), "": ("", ""), "a.b.example.org": ("example.org", "org"), "1.2.3.com": ("3.com", "com"),
    }
    site = urls.site_of(F.col("h"))
    got = {r.h: (r.d, r.s) for r in spark.createDataFrame([(h,) for h in wanted], "h string").select("h", urls.domain_of(site).alias("d"), urls.suffix_of(site).alias("s")).collect()}
    assert got == wanted
    pages = spark.createDataFrame([(1, "http://a.co.uk/"), (2, "http://b.co.uk:80/x"), (3, "http://b.co.uk./y"), (4, None)], "page_id long, url string")
    seen = {r.host: (r.n, r.good) for r in urls.reputation(pages, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "page_id long, good int")).collect()}
    assert seen == {"a.co.uk": (1, 1), "b.co.uk": (2, 0), "": (0, 0)}
    assert {r.page_id: r.host for r in urls.url_verdicts(pages, spark.createDataFrame([], "page_id long, good int")).collect()} == {1: "a.co.uk", 2: "b.co.uk:80", 3: "b.co.uk.", 4: ""}
    assert urls.url_verdicts(pages.where("false"), spark.createDataFrame([(1, 1)], "page_id long, good int")).collect() == []


def test_dropped_ids_keep_rows_without_one(spark, monkeypatch):
    from chalkline.llm import common

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "doc_id long, text string")
    for bound in (0, 10):
        monkeypatch.setattr(common, "BROADCAST_IDS", bound)
        assert sorted(r.text for r in common.drop_ids(docs, spark.createDataFrame([(2,)], "x long")).collect()) == ["a", "c"]
