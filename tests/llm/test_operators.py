"""Each corpus operator against a brute-force version, and on nulls, empty tables, repeated rows, long texts and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartlines.llm import ann, batches, components, decontaminate, jaccard_join, language_id, line_dedup, minhash, mixing, periodic, prefix_trie, quality, token_counts, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [(1, None, None, None, None), (2, "", "en", "b", 0), (3, " \n\t ", "en", None, 3), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (None, "no id here at all my friend", None, "a", 1), (6, LONG, "en", "b", None)]


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


# --- word hashes


def test_word_hashes_agree_with_words():
    import pyarrow as pa

    texts = ["Ab ab\tAB", None, "", "x\x0by\x0cz é é", "a" * 5000, " lead and trail "]
    hashes, starts = batches.word_hashes(pa.array(texts))
    for i, t in enumerate(texts):
        assert starts[i + 1] - starts[i] == len(words(t))
    assert len(set(hashes[:3].tolist())) == 1
    flat = [low(w) for t in texts for w in words(t)]
    for a, b in itertools.combinations(range(len(flat)), 2):
        assert (flat[a] == flat[b]) == (hashes[a] == hashes[b])


# --- op 1


def test_nearest_matches_brute_force_and_skips_unusable(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 7)).astype(np.float32)
    x[50:60] = x[10]  # ties
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    bad = [(900, None, 0), (901, [0.0] * 7, 0), (1000, [float("nan")] * 7, 0), (903, [1.0, None] + [0.0] * 5, 0), (904, [float("inf")] * 7, 0), (905, [1.0], 0), (None, [1.0] * 7, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("clash"))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 10 == 0, rerank=12, block_rows=100, block_queries=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 400, 10))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(400), d))[:10]
        hits += len(set(best) & {v for _, v, _ in found})
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
        assert all(abs(d[v] - s) < 1e-12 for _, v, s in found)
    assert hits >= 0.95 * 10 * len(got)


def test_nearest_with_repeated_ids_and_ties(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(1, 90)] + [(5, [9.0, 9.0]), (5, [9.0, 9.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("rank", F.lit(1))
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") % 100 == 0, rerank=11).collect())
    # of a repeated id the smaller vector counts; 29 others tie at distance 0
    assert got == [(n + 1, 3 * (n + 1), 0.0) for n in range(10)]


def test_nearest_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    few = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0)], schema), F.col("vec_id") % 100 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 1)]
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0


def test_nearest_in_a_dense_group(spark):
    rng = np.random.default_rng(31)
    x = rng.normal(size=(3_000, 16))
    x[:1_000] = x[0] + rng.normal(scale=0.003, size=(1_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for block_rows in (8_192, 500):
        got = {}
        for r in ann.nearest(df, F.col("vec_id") % 100 == 0, block_rows=block_rows).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        assert len(got) == 30
        for q, found in got.items():
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            assert [v for _, v in sorted(found)] == np.argsort(d, kind="stable")[:10].tolist()


def test_scan_measures_few_rows_and_codes_are_least_errors():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(6_000, 32))
    book = ann.fit(x[:2_000], 32)
    codes = book.encode(x)
    parts, words = book.pad(x), book.words
    unit = (parts.reshape(len(x), -1) / np.linalg.norm(parts.reshape(len(x), -1), axis=1, keepdims=True)).reshape(parts.shape)

    def cost(i, c):  # the anisotropic error of row i coded by c
        rest = parts[i] - words[np.arange(len(words)), c]
        return (rest**2).sum() + (book.parallel - 1) * (rest * unit[i]).sum() ** 2

    better = 0
    for i in range(40):
        for j in range(len(words)):
            mine = cost(i, codes[i])
            for w in range(ann.CODEWORDS):
                other = codes[i].copy()
                other[j] = w
                better += cost(i, other) < mine - 1e-9
    assert better <= 40 * len(words) * ann.CODEWORDS * 0.01  # two sweeps come near a minimum by single changes
    lost = np.sqrt(((parts - words[np.arange(len(words)), codes]) ** 2).sum((1, 2)))
    half = ((x - book.centre) ** 2).sum(1) / 2
    hits, shares = {}, {}
    for deviations in (4.0, 100.0):
        scan = ann.Scan(book, np.arange(0, 6_000, 200), x[::200], 10, 50, deviations)
        for a in range(0, 6_000, 1_000):
            at = slice(a, a + 1_000)
            scan.show(np.arange(6_000)[at], x[at], ann.pack(codes)[at], half[at], lost[at])
        hits[deviations] = 0
        for i, q in enumerate(range(0, 6_000, 200)):
            d = np.sqrt(((x - x[q]) ** 2).sum(1))
            d[q] = np.inf
            hits[deviations] += len(set(np.argsort(d, kind="stable")[:10]) & set(scan.ids[i].tolist()))
        shares[deviations] = scan.measured / (30 * 6_000)
    assert hits[100.0] == 300 and hits[4.0] >= 290 and shares[4.0] < 0.35


# --- op 2


def brute_components(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = words(low(t))
        sets.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)))
    top = list(range(len(rows)))
    find = lambda i: i if top[i] == i else find(top[i])
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            top[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in groups[find(i)] if rows[j][0] is not None]
        out.append((rows[i][0], len(sets[i]), min(ids, default=None)))
    return out


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(spark, k):
    rng, vocab = random.Random(3), vocabulary(3)
    rows = []
    for _ in range(8):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 120))]
        for _ in range(12):
            copy = base[:]
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((len(rows) * 3 + 1, " ".join(copy)))
    rows += [(r[0], r[1]) for r in ODD] + [(900, "a b"), (901, "A  b"), (902, "a b c")]
    rng.shuffle(rows)
    df = docs(spark, [(a, b, None, None, None) for a, b in rows]).withColumn("kept", F.lit("clash")).withColumn("cls", F.lit(1))
    got = minhash.near_duplicates(df, k=k).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    expected = brute_components(rows, k)
    # a document without an id stands for itself unless it is linked
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(expected, key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    assert minhash.near_duplicates(docs(spark, [(1, None, None, None, None)])).first()["component_id"] == 1


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    b = np.concatenate([a[:400], np.unique(rng.integers(0, 2**63, 100, dtype=np.uint64))])
    one = a[:1]
    sk = minhash.sketches(np.concatenate([a, b, one]), np.array([0, len(a), len(a) + len(b), len(a) + len(b) + 1]))
    assert abs((sk[0] == sk[1]).mean() - 400 / 600) < 0.15
    assert len(set(sk[2].tolist())) > 100  # every coordinate is filled


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 200), (None, 3), (5, 4)]
    got = {r["node"]: r["comp"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and len({got[i] for i in range(100, 160)}) == 1
    assert got[200] == 200 and len(set(got.values())) == 3


# --- op 3


def test_token_counts_equal_the_library(spark):
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    path = tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(0)
    parts = ["a", "the", " ", "  ", "▁", "\n", "\t", "é", "中", "😀", "ing", "</s>", "<unk>", "123", "\x00", "."]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))), None, None, None) for i in range(300)] + ODD
    got = token_counts.count_tokens(docs(spark, rows).withColumn("n_tokens", F.lit("clash")), path, limit=4).collect()
    assert len(got) == len(rows)
    expected = sorted((len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows)
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 4) for r in got)
    assert token_counts.count_tokens(docs(spark, []), path).count() == 0


# --- op 4 and 5


def test_toxicity_learns_words_and_pairs(spark):
    rng, vocab = random.Random(5), vocabulary(5)
    rows, labels = [], []
    for i in range(1200):
        text = [rng.choice(vocab) for _ in range(30)]
        pair = rng.random()
        if pair < 0.3:
            text[rng.randrange(30)] = "zulu"
        elif pair < 0.6:
            text[rng.randrange(30)] = "xray"
        elif pair < 0.9:
            text[0], text[9] = "zulu", "xray"
        rows.append((i, " ".join(text), None, None, None))
        labels.append((i, 1, int(pair >= 0.6 and pair < 0.9)))
    df, lab = docs(spark, rows + ODD), spark.createDataFrame(labels + [(None, None, None), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab)
    got = {r["doc_id"]: r for r in toxicity.score(df.withColumn("score", F.lit("clash")), model).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.9  # needs both words together
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_finds_pairs_without_a_trace_of_their_own(spark):
    rng, vocab = random.Random(55), vocabulary(55)
    rows, labels = [], []
    for i in range(3000):
        text = [rng.choice(vocab) for _ in range(30)]
        both, one = rng.random() < 0.5, rng.random() < 0.5
        if both == one:
            text[3] = "zulu"
        if one:
            text[20] = "xray"
        rows.append((i, " ".join(text), None, None, None))
        labels.append((i, 1, int(both)))  # both words or neither: each alone tells nothing
    df = docs(spark, rows)
    labels = [(i, 1, int(("zulu" in r[1].split()) == ("xray" in r[1].split()))) for i, r in enumerate(rows)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, toxicity.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] == labels[i][2] for i in held]) > 0.9


def test_machine_scores_and_slopes_match_brute_force():
    rng = np.random.default_rng(4)
    has = rng.random((9, 6)) < 0.5
    text_of, term = np.nonzero(has)
    labels = rng.integers(0, 2, 9).astype(float)
    m = toxicity.FactorizationMachine(np.arange(6), rng.normal(size=6), rng.normal(size=(6, 3)), 0.3)

    def raw(m):
        return [m.bias + sum(m.weights[i] for i in np.flatnonzero(r)) + sum(m.factors[i] @ m.factors[j] for i, j in itertools.combinations(np.flatnonzero(r), 2)) for r in has]

    assert np.allclose(m.raw(term, text_of, 9), raw(m))
    loss = lambda m: float(np.mean(np.logaddexp(0, raw(m)) - labels * np.array(raw(m))))
    gw, gv, gb = m.slopes(term, text_of, labels)
    nudge = lambda w, v, b: toxicity.FactorizationMachine(m.buckets, m.weights + w, m.factors + v, m.bias + b)
    for j in range(6):
        e = 1e-6 * np.eye(6)[j]
        assert abs((loss(nudge(e, 0, 0)) - loss(nudge(-e, 0, 0))) / 2e-6 - gw[j]) < 1e-6
        for f in range(3):
            d = np.zeros((6, 3))
            d[j, f] = 1e-6
            assert abs((loss(nudge(0, d, 0)) - loss(nudge(0, -d, 0))) / 2e-6 - gv[j, f]) < 1e-6
    assert abs((loss(nudge(0, 0, 1e-6)) - loss(nudge(0, 0, -1e-6))) / 2e-6 - gb) < 1e-6


def test_classifiers_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs(spark, ODD)
    assert {r["score"] for r in toxicity.score(df, toxicity.train(df, none)).collect()} == {0.5}
    assert {r["score"] for r in quality.score(df, quality.train(df, none)).collect()} == {0.5}
    assert quality.score(docs(spark, []), quality.train(df, none)).count() == 0
    assert toxicity.score(docs(spark, []), toxicity.train(df, none)).count() == 0


def test_quality_tells_junk_from_prose(spark):
    rng, vocab = random.Random(6), vocabulary(6)
    rows, labels = [], []
    for i in range(1500):
        text = [rng.choice(vocab) for _ in range(rng.randint(20, 60))]
        good = i % 4 != 0
        if not good:
            text = [w + rng.choice(["%%%", "&&&", "$$$"]) for w in text]
        rows.append((i, " ".join(text) + ".", None, None, None))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(good), 0))
    df = docs(spark, rows)
    model = quality.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in quality.score(df, model).collect()}
    assert np.mean([got[i] == int(i % 4 != 0) for i in range(1500)]) > 0.95
    assert 0.5 < model.prior < 0.95


def test_quality_learns_words_and_takes_odd_rows(spark):
    rng, good_words, bad_words = random.Random(66), vocabulary(66), vocabulary(67)
    rows, labels = [], []
    for i in range(1500):
        good = i % 3 != 0
        rows.append((i, " ".join(rng.choice(good_words if good else bad_words) for _ in range(40)), None, None, None))
        if good and i % 2:
            labels.append((i, 1, 0))
    df = docs(spark, rows + ODD + [(7, None, None, None, None)] * 3).withColumn("kind", F.lit("clash")).withColumn("score", F.lit("clash"))
    model = quality.train(df, spark.createDataFrame(labels + [(None, None, None), (4, None, 1)], "doc_id long, quality int, toxic int"))
    got = quality.score(df, model).collect()
    assert len(got) == len(rows) + len(ODD) + 3 and all(0 <= r["score"] <= 1 for r in got)
    seen = {r["doc_id"]: r["score"] for r in got}
    held = [i for i in range(10, 1500) if zlib.crc32(str(i).encode()) % 5 == 0]
    # the numbers of both kinds are alike: only the words tell them apart
    assert np.mean([(seen[i] >= 0.5) == (i % 3 != 0) for i in held]) > 0.9


def test_risk_and_its_slopes_match_brute_force():
    rng = np.random.default_rng(9)

    def texts(n):
        has = rng.random((n, 4)) < 0.6
        text_of, bucket = np.nonzero(has)
        return quality.Texts(rng.normal(size=(n, len(quality.FEATURES))).astype(np.float32), bucket, text_of), has

    (pos, has_p), (unl, has_u) = texts(7), texts(11)
    edges = np.stack([np.linspace(-1, 1, 3)] * len(quality.FEATURES))
    model = quality.BinnedModel(edges, np.zeros(edges.shape[0] * 4), np.zeros(4), 0.0, 0.5)
    risk = quality.Risk(model, pos, unl, words=True)
    for prior, scale in ((0.4, 0.3), (0.95, 3.0)):
        w = rng.normal(size=risk.size) * scale

        def margin(t, has):
            return [w[-1] + sum(w[j * 4 + int((edges[j] < t.x[i, j]).sum())] for j in range(len(edges))) + sum(w[-5:-1][has[i]]) / np.sqrt(max(has[i].sum(), 1)) for i in range(len(t.x))]

        log1 = lambda v: float(np.mean(np.log1p(np.exp(v))))
        up, down = prior * log1(-np.array(margin(pos, has_p))), log1(np.array(margin(unl, has_u))) - prior * log1(np.array(margin(pos, has_p)))
        assert np.allclose(risk.value(w, prior), (up, down))

        def goal(v):
            u, d = risk.value(v, prior)
            return u + d if down >= 0 else -d

        for j in rng.choice(risk.size, 20, replace=False):
            e = 1e-6 * (np.arange(risk.size) == j)
            assert abs((goal(w + e) - goal(w - e)) / 2e-6 - risk.slopes(w, prior)[j]) < 1e-6


# --- op 6


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e\r\nX: y", "é" * 50_000), (6, "f", "own"), (6, "f", "own"), (None, "g", "own"), (None, "h", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    index = warc.write_archives(pages, f"file://{tmp_path}/w")
    assert index.count() == len(rows)
    got = warc.read_records(index, gap=0, size=64).collect()
    assert len(got) == len(rows) and all(r["intact"] for r in got)
    by_id = {r["page_id"]: r for r in got if r["page_id"] is not None}
    assert by_id[1]["record_type"] == "revisit" and by_id[1]["refers_to"] == 2 and by_id[2]["record_type"] == "response"
    assert by_id[3]["refers_to"] == 4 and by_id[4]["payload"] == b""
    assert by_id[5]["payload"].decode() == "é" * 50_000 and by_id[1]["payload_bytes"] == 8
    assert by_id[1]["payload_digest"] == base64.b32encode(hashlib.sha1(b"<p>x</p>").digest()).decode()
    assert [r["record_type"] for r in got if r["page_id"] == 6] == ["response"] * 2
    chosen = warc.read_records(index.where("page_id = 5")).collect()
    assert [r["page_id"] for r in chosen] == [5]
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


# --- op 7


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        rest = total - sum(out.values())
        level = rest / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= set(over)
    return out


def check_mix(spark, rows, block=16):
    df = docs(spark, rows).withColumn("p", F.lit("clash")).withColumn("size", F.lit("clash"))
    got = mixing.mix_sources(df, block=block).collect()
    sizes, largest = {}, {}
    for r in rows:
        n = len(words(r[1]))
        sizes[r[3]] = sizes.get(r[3], 0) + n
        largest[r[3]] = max(largest.get(r[3], 0), n)
    want = brute_targets(sizes)
    assert sum(r["n_rows"] for r in got) == len(rows)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] and 0 <= r["copies"] + (r["extra"] > 0) <= 2 for r in mine)
        assert all(0 <= r["extra"] <= r["n_rows"] for r in mine)
        assert abs(sum((r["copies"] * r["n_rows"] + r["extra"]) * r["size"] for r in mine) - want[s]) <= largest[s] + 1e-6
    again = mixing.mix_sources(df.repartition(7), block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    each = mixing.each_row(mixing.mix_sources(df, block=block), repeats=7).collect()
    assert len(each) == len(rows)
    for s in sizes:
        assert sum(r["taken"] for r in each if r["source"] == s) == sum((r["copies"] * r["n_rows"] + r["extra"]) * r["size"] for r in got if r["source"] == s)
    mixed = mixing.mixed_documents(df.repartition(5), block=block)
    counts = {(r["doc_id"], r["source"]): r["n"] for r in mixed.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n")).collect()}
    planned = {}
    for r in got:
        n = r["copies"] * r["n_rows"] + r["extra"]
        if n:
            planned[r["doc_id"], r["source"]] = planned.get((r["doc_id"], r["source"]), 0) + n
    assert counts == planned and mixed.columns == [*df.columns, "copy_no"]


def test_mix_meets_its_targets(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), None, rng.choice(["a", "a", "a", "a", "b", "Z", "é", None]), None) for i in range(900)]
    rows += [(5000, "one two", None, "a", None)] * 3 + [(None, "one two three", None, "b", None), (5001, None, None, "b", None)]
    check_mix(spark, rows)
    assert mixing.mix_sources(docs(spark, [])).count() == 0 and mixing.mixed_documents(docs(spark, [])).count() == 0


def test_mix_of_hot_repeats(spark):
    fifty = " ".join(["w"] * 50)
    rows = [(i, fifty, None, "a", None) for i in range(100)] + [(1_000, fifty, None, "a", None)] * 300 + [(2_000 + i, fifty, None, "b", None) for i in range(200)]
    check_mix(spark, rows)
    check_mix(spark, [(1, " ".join(["w"] * 9), None, None, None)] * 41)


def test_targets_of_many_sources(spark):
    rng = random.Random(17)
    sizes = {f"s{i:03}": rng.choice([0, 1, 5, 50, 4000]) * rng.randint(1, 9) for i in range(211)}
    df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_units long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)


# --- op 8


def slid_leaks(rows, items, k=5):
    """Best window of each document and item, of those from every start: similarity and first word."""

    def cut(w, n):
        return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = {}
    for item, text in items:
        iw = words(low(text))
        n = min(k, len(iw))
        ish = cut(iw, n)
        for doc, body in rows:
            dw = words(low(body))
            hits = [p for p in range(len(dw) - n + 1) if n and " ".join(dw[p : p + n]) in ish]
            for s in sorted({s for p in hits for s in range(p - len(iw) + n, p + 1)}):
                win = cut(dw[max(s, 0) : min(s + len(iw), len(dw))], n)
                both = sum(map(len, win & ish))
                whole = sum(map(len, win)) + sum(map(len, ish)) - both
                if both and 100 * both >= 80 * whole:
                    out[doc, item] = min(out.get((doc, item), (0, 0)), (-both / whole, max(s, 0)))
    return out


def test_leaks_match_brute_force(spark):
    rng, vocab = random.Random(8), vocabulary(8)
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 12, 25, 40])))) for i in range(20)] + [(50, None), (51, " "), (52, "only")]
    rows = []
    for i in range(120):
        text = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            leak = words(rng.choice(items[:20])[1].upper())
            for _ in range(i % 4):
                leak[rng.randrange(len(leak))] = "changed"
            text[len(text) // 2 : len(text) // 2] = leak
        rows.append((i, " ".join(text)))
    rows += [(r[0], r[1]) for r in ODD]
    df = docs(spark, [(a, b, None, None, None) for a, b in rows]).withColumn("item_id", F.lit("clash")).withColumn("fp", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("k", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == set(slid_leaks(rows, items))
    several = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(df, bench, broadcast_shingles=100).collect()}
    assert several == got
    clean = {r["doc_id"] for r in decontaminate.drop_leaks(df, bench).collect()}
    assert clean == {a for a, _ in rows} - {d for d, _ in got}
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def test_leaks_from_every_start(spark):
    rng, vocab = random.Random(80), vocabulary(80)
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([30, 40, 60])))) for i in range(12)] + [(20, "three words only"), (21, "a b a b a b a b a b a b")]
    rows = []
    for i in range(72):
        before, after = ([rng.choice(vocab) for _ in range(rng.choice([0, 3, 30]))] for _ in range(2))
        leak = words(items[i % 12][1])
        at = len(leak) // (2 + i % 2)
        leak = leak[at:] + leak[:at] if i < 48 else leak[:at] + ["put", "in"] + leak[at:]
        rows.append((i, " ".join(before + leak + after)))
    rows += [(100, "a b " * 40), (101, "Three words only"), (102, None), (103, " ".join(rng.choice(vocab) for _ in range(90)))]
    df = docs(spark, [(a, b, None, None, None) for a, b in rows] + [(0, rows[0][1], None, None, None)])
    found = decontaminate.find_leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    want = slid_leaks(rows, items)
    assert len([d for d, i in want if d < 48]) > 10  # parts swapped
    assert {(r["doc_id"], r["item_id"]): (round(-r["similarity"], 9), r["start"]) for r in found} == {k: (round(s, 9), t) for k, (s, t) in want.items()}
    assert len(found) == len(want)


def test_no_short_leak_is_lost_and_halves_may_swap(spark):
    rng, vocab = random.Random(81), vocabulary(81, 3000)
    items = [(i, " ".join(rng.choice(vocab) for _ in range(9))) for i in range(2_000)]
    rows = [(i, " ".join(words(t)[:8]), None, None, None) for i, t in items]
    halves = [[rng.choice(vocab) for _ in range(60)] for _ in range(2)]
    items.append((9_000, " ".join(halves[0] + halves[1])))
    rows.append((9_000, " ".join([rng.choice(vocab) for _ in range(500)] + halves[1] + halves[0] + [rng.choice(vocab)] * 70), None, None, None))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set(slid_leaks([(9_000, rows[-1][1])], items[-1:]))
    for (i, text), (_, body, *_) in zip(items[:2_000], rows):
        want |= set(slid_leaks([(i, body)], [(i, text)]))
    assert (9_000, 9_000) in found and len(want) > 1_000 and want <= found


# --- op 9


def brute_lines(rows, m=8):
    seen, out = {}, {}
    for doc, text in sorted(rows):
        lines = (text or "").split("\n")
        solid = [i for i, x in enumerate(lines) if words(x)]
        gone = set()
        spans = set()
        for a in range(len(solid)):
            for step in (1, -1):
                b, total = a, 0
                while 0 <= b < len(solid):
                    total += len(words(lines[solid[b]]))
                    if total >= m:
                        spans.add((min(a, b), max(a, b)))
                        break
                    b += step
        for a, b in sorted(spans):
            key = tuple(lines[i] for i in solid[a : b + 1])
            if seen.setdefault(key, (doc, solid[a])) < (doc, solid[a]):
                gone |= set(range(solid[a], solid[b] + 1))
        out[doc] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_line_dedup_matches_brute_force(spark):
    rng, vocab = random.Random(9), vocabulary(9, 60)
    pool = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 9, 60]))) for _ in range(40)]
    rows = []
    for i in range(150):
        lines = [rng.choice(pool + ["", " "]) if rng.random() < 0.5 else " ".join(rng.choice(vocab) for _ in range(5)) for _ in range(rng.randint(1, 14))]
        rows.append((i, "\n".join(lines)))
    rows += [(1000, None), (1001, ""), (1002, LONG), (1003, LONG), (1004, "\n".join([pool[0]] * 3000))]
    df = docs(spark, [(a, b, None, None, None) for a, b in rows]).withColumn("n_lines", F.lit("clash")).withColumn("rid", F.lit(1)).withColumn("at", F.lit(2))
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    want = brute_lines(rows)
    assert {d: r["text"] for d, r in got.items()} == want
    assert got[1003]["text"] == "" and got[1003]["n_removed"] == 1 and got[1000]["n_lines"] == 0
    twice = docs(spark, [(1, pool[-1] + " " + pool[-2] + " a b c d e f g h", None, None, None)] * 2 + [(None, "x", None, None, None)])
    assert {r["n_removed"] for r in line_dedup.dedup_lines(twice).collect()} == {0}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


# --- op 10


def test_language_by_compression(spark):
    rng = random.Random(10)
    vocab = {g: vocabulary(g, 120) for g in ("aa", "bb", "cc")}
    rows = []
    for i in range(300):
        g = rng.choice(list(vocab))
        rows.append((i, " ".join(rng.choice(vocab[g]) for _ in range(40)), g, None, None))
    odd = [(900, None, None, None, None), (901, "", "aa", None, None), (902, "12 34 !!", None, None, None), (None, rows[0][1], None, None, None), (903, LONG, None, None, None)]
    df = docs(spark, rows + odd).withColumn("score", F.lit("clash"))
    learnt = language_id.learn_dictionaries(df)
    assert sorted(learnt) == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in language_id.identify_languages(df, learnt).collect()}
    assert np.mean([got[i]["lang_pred"] == g for i, _, g, _, _ in rows]) > 0.98
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[None]["lang_pred"] == rows[0][2] and 0 <= got[903]["score"] <= 1
    assert language_id.learn_dictionaries(df.limit(0)) == {} and language_id.identify_languages(df.limit(0), {}).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_languages(df.limit(5), {}).collect()} == {"und"}


def test_language_sizes_match_a_plain_loop_and_ties_go_by_name(spark):
    import zstandard

    rng = random.Random(101)
    vocab = {g: vocabulary(100 + i, 80) for i, g in enumerate(("bb", "aa"))}
    vocab["cc"] = ["".join(rng.choice("дежзик") for _ in range(6)) for _ in range(80)]
    long_texts = [(i, "Header the same for all. " * 80 + " ".join(rng.choice(vocab[g]) for _ in range(900)), g, None, None) for i, g in enumerate(list(vocab) * 40)]
    df = docs(spark, long_texts + long_texts[:3] * 2 + [(5_000, "QXQXQX", "bb", None, None)])
    learnt = language_id.learn_dictionaries(df)
    assert learnt == language_id.learn_dictionaries(df.repartition(5))
    sizes = {g: len(d) for g, d in learnt.items()}
    assert sizes["cc"] == max(sizes.values()) and min(sizes.values()) > 0.6 * language_id.SAMPLE_DOCUMENTS * language_id.SAMPLE_BYTES
    assert all(d.count(b"header the same") < 0.6 * len(d) / 25 for d in learnt.values())  # not from the beginnings alone
    texts = [long_texts[0][1], long_texts[1][1], "Some short one", "xyxyxy", long_texts[2][1][-700:]]
    got = {r["doc_id"]: r for r in language_id.identify_languages(docs(spark, [(i, t, None, None, None) for i, t in enumerate(texts)] * 2), learnt).collect()}
    most = max(map(len, learnt.values()))
    for i, text in enumerate(texts):
        raw, found = text.lower().encode(), {}
        for g in sorted(learnt):
            params = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, source_size=language_id.PIECE_BYTES, dict_size=most, min_match=language_id.MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(learnt[g], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
            found[g] = sum(len(coder.compress(raw[a : a + language_id.PIECE_BYTES])) for a in range(0, len(raw), language_id.PIECE_BYTES))
        assert got[i]["lang_pred"] == min(found, key=lambda g: (found[g], g))
    tie = language_id.identify_languages(docs(spark, [(1, "zz", None, None, None)] * 2), {"b": b"aaaa bbbb", "a": b"aaaa bbbb"}).collect()
    assert [(r["lang_pred"], r["margin"], r["rejected"]) for r in tie] == [("a", 0.0, True)] * 2
    with pytest.raises(ValueError, match="languages"):
        most, language_id.MOST_LANGUAGES = language_id.MOST_LANGUAGES, 2
        try:
            language_id.learn_dictionaries(df)
        finally:
            language_id.MOST_LANGUAGES = most


# --- pipeline


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "benchmark decontamination", "mixing sources"]
    sf = "/root/testdata/sf0.001"
    first = spark.read.parquet(f"{sf}/documents.parquet")
    seen = first
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, seen, sf)
        assert kept.columns == first.columns
        assert kept.count() >= 0.6 * seen.count(), name
        assert kept.select("doc_id").subtract(seen.select("doc_id")).count() == 0
        seen = kept


def test_pipeline_of_odd_and_of_no_documents(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rng = random.Random(77)
    vocab = {g: vocabulary(70 + i, 150) for i, g in enumerate(("aa", "bb"))}
    rows = []
    for i in range(60):
        g = "ab"[i % 2] * 2
        rows.append((100 + i, "\n".join(" ".join(rng.choice(vocab[g]) for _ in range(12)) for _ in range(6)), g if i % 5 else None, rng.choice(["x", "y", None]), 7))
    rows += [rows[3], rows[3], (300, rows[5][1], "bb", "x", 7)]  # repeated rows, and a copy under another id
    df = docs(spark, rows + ODD).withColumn("kept", F.lit("clash")).withColumn("copy_no", F.lit(9)).withColumn("score", F.lit("clash"))
    seen, sizes = df, []
    for name, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, sf)
        found = seen.collect()
        sizes.append(len(found))
        if name != "mixing sources":
            assert seen.columns == df.columns, name
            assert {r["doc_id"] for r in found} >= {r[0] for r in rows[:60]} - {105}, name  # clean documents stay
    left = {r["doc_id"] for r in found}
    assert None not in left and not left & {1, 2, 3} and 300 not in left  # no text, and the copy
    words_in = sum(len(words(r["text"])) for r in found)
    once = {(r["doc_id"], r["text"]): len(words(r["text"])) for r in stage_input(corpus_pipeline, spark, df, sf)}
    assert sum(once.values()) <= words_in <= 2 * sum(once.values()) * 3 and set(seen.columns) == set(df.columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), sf).count() == 0


def stage_input(pipeline, spark, docs_in, sf):
    for name, stage in pipeline.STAGES[:-1]:
        docs_in = stage(spark, docs_in, sf)
    return docs_in.collect()


# --- op 13


def brute_runs(w, least, exponent):
    """start, length, period of the maximal runs, by every shift."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def test_runs_match_every_shift():
    rng = random.Random(5)
    for _ in range(400):
        n, k = rng.randint(1, 60), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randint(1, k) for _ in range(n)]
        if rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, 12)
            w = [w[i if i < a else min(a + (i - a) % p, n - 1)] for i in range(n)]
        known = {}
        ids = [known.setdefault(x, len(known) + 1) for x in w]
        for least, exponent in ((2, 2), (4, 3), (24, 3)):
            assert [tuple(r) for r in periodic._ordered(periodic.runs_of(ids, least, exponent)).tolist()] == brute_runs(w, least, exponent)


def test_ranges_of_minima():
    rng = np.random.default_rng(2)
    for n in (1, 5, 16, 17, 300):
        values = rng.integers(0, 50, n).astype(np.int32)
        a, b = rng.integers(0, n, 400), rng.integers(0, n, 400)
        want = [values[min(x, y) : max(x, y) + 1].min() for x, y in zip(a, b)]
        assert periodic.Minima(values).least(a, b).tolist() == want


def test_periodic_runs_on_texts_and_odd_rows(spark):
    rng = random.Random(11)
    vocab = [*vocabulary(3, 12), "Ab", "ab", "é"]
    rows = []
    for i in range(150):
        ws = [rng.choice(vocab[: rng.choice([2, 3, 15])]) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            unit = [rng.choice(vocab) for _ in range(rng.randint(1, 14))]
            at = rng.randint(0, len(ws))
            ws[at:at] = (unit * 9)[: rng.randint(20, 70)]
        rows.append((10 + i, rng.choice([" ", "\n", " \t"]).join(ws), None, None, 0))
    rows += [(500, " ".join(["same"] * 30_000), None, None, 0), (501, " ".join(f"u{i % 700}" for i in range(9_000)), None, None, 0)]
    found = periodic.find_runs(docs(spark, [*rows, *ODD]).withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x"))).collect()
    texts = {r[0]: r[1] for r in [*rows, *ODD]}
    assert len(found) == len(rows) + len(ODD)
    assert sum(len(r["runs"]) > 0 for r in found) > 60
    for r in found:
        w = words(texts[r["doc_id"]])
        assert r["n_words"] == len(w)
        if len(w) < 2_000:
            want = brute_runs(w, 24, 3)
        elif r["doc_id"] == 6:
            want = [(0, 60_000, 977)]
        else:
            want = [(0, 30_000, 1)] if r["doc_id"] == 500 else [(0, 9_000, 700)]
        got = [(x["start"], x["length"], x["period"]) for x in r["runs"]]
        assert got == want
        gone = {i for s, n, q in got for i in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert periodic.find_runs(docs(spark, [])).count() == 0


# --- op 12

TALK = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    """The nodes that a plain trie of the conversations has."""
    talks = {}
    for c, t, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    talks = {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in talks.items()}
    built = {}
    for c, ts in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple([*talks.get(c - int(np.fmod(c, 100)), [])[:h], *ts[h:]])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for path in members:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    for path, of in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in children)
            saved[path[:d]] = saved.get(path[:d], 0) + (len(of) - 1) * (len(path[-1][1]) if path else 0)
    ends = lambda path, of: hashlib.sha256(",".join(str(c) for c in sorted(of) if built[c] == path).encode()).hexdigest()
    return sorted((min(of), len(path), min(members[path[:-1]]) if path else -1, len(of), children.get(path, 0), leaves[path], saved[path], ends(path, of)) for path, of in members.items())


def trie_of(frame):
    from chartlines.llm import entries

    found = prefix_trie.prefix_nodes(*entries.shared_beginnings(prefix_trie.ordered_turns(frame)))
    out = [tuple(r) for r in found.collect()]
    return sorted((c, d, -1 if p is None else p, *rest) for c, d, p, *rest in out)


def talk_rows(rng):
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(210, 220)]:
        for t in range(rng.randint(1, 7)):
            turn = rng.choice([t, t, t, None, 0])
            rows.append((c, turn, rng.choice(["user", "system", None]), rng.choice(["a", "b", "é long one", "", None])))
    rows += [(400, t, "user", f"turn {t}") for t in range(90)] + [(401, t, "user", f"turn {t}") for t in range(40)]
    return [*rows, *rows[:20], (None, 1, "user", "no id"), (None, None, None, None), (-7, 0, "user", "a"), (-107, 0, "user", "a")]


@pytest.mark.parametrize("crowded", [False, True])
def test_prefix_trie_matches_a_plain_trie(spark, monkeypatch, crowded):
    if crowded:  # nearly all prefixes look shared, and conversations are cut into segments
        for name, value in (("TILE_BITS", 4), ("LEAST_BITS", 5), ("MOST_BITS", 5), ("SEGMENT", 7)):
            monkeypatch.setattr(prefix_trie, name, value)
    rows = talk_rows(random.Random(3))
    rng = random.Random(4)
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], TALK + ", total long, depth string")
    assert trie_of(frame) == brute_trie(rows)


def test_prefix_trie_of_nothing_and_of_one_turn(spark):
    assert trie_of(spark.createDataFrame([], TALK)) == []
    for rows in ([(5, None, None, None)], [(c, 0, "user", "same") for c in range(300, 420)]):
        assert trie_of(spark.createDataFrame(rows, TALK)) == brute_trie(rows)


def test_the_sketch_counts_no_prefix_too_low(spark):
    rows = [(c, d, 0, 1, hash((c // (1 + d % 3), d)) % (1 << 60), d, 7, 7) for c in range(200) for d in range(1, 5)]
    frame = spark.createDataFrame(rows, "conv_id long, depth long, size long, total long, a long, b long, pa long, pb long")
    count = {}
    for r in rows:
        count[r[4:6]] = count.get(r[4:6], 0) + 1
    for n in (1, 100_000):
        got = prefix_trie.screened(frame, n).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["state"] == 1:
                assert count[(r["a"], r["b"])] == 1


# --- op 11


def brute_groups(rows, k, percent):
    """n_shingles and smallest reachable id of each row, by every pair."""
    sets = []
    for _, text, *_ in rows:
        w = low(text)
        w = words(w)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted(((-1 if r[0] is None else r[0]), len(sets[i]), least.get(top(i), -1)) for i, r in enumerate(rows))


def grouped_rows():
    rng, vocab = random.Random(8), vocabulary(8)
    base = [[rng.choice(vocab) for _ in range(rng.randint(3, 120))] for _ in range(25)]
    passage = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w = passage + [rng.choice(vocab) for _ in range(rng.randint(5, 40))]  # much in common, but not enough
        if rng.random() < 0.2:
            w += [rng.choice(vocab) for _ in range(rng.randint(1, 8))]
        rows.append((10 + i, " ".join(w).title() if rng.random() < 0.2 else " ".join(w), None, None, 0))
    return [*rows, *rows[:10], *ODD]


@pytest.mark.parametrize("crowded,block,percent", [(256, 1024, 80), (2, 3, 80), (8, 5, 60)])
def test_jaccard_join_matches_every_pair(spark, crowded, block, percent):
    rows = grouped_rows()
    got = jaccard_join.similar_sets(docs(spark, rows).withColumn("n", F.lit(1)).withColumn("cls", F.lit("x")), percent=percent, crowded=crowded, block=block).collect()
    flat = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in got)
    assert flat == brute_groups(rows, 5, percent)


def test_bitmaps_never_bound_too_low():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x, y = rng.integers(0, 2**62, rng.integers(1, 300)), rng.integers(0, 2**62, rng.integers(1, 300))
        a, b = (np.unique(np.concatenate([v, x[: rng.integers(0, len(x) + 1)]])).astype(np.uint64) for v in (x, y))
        maps = jaccard_join.bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        assert jaccard_join._apart(*maps) <= apart and jaccard_join._apart(maps[0], maps[0]) == 0


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.similar_sets(docs(spark, [])).count() == 0


# --- op 1, vectors whose variance lies in few components; op 4 and op 5, samples past long texts


def _spectra(rng, n, d):
    z = rng.normal(size=(n, d))
    few = z * 1e-2
    few[:, [3, 4]] = z[:, [3, 4]]
    return {"even": z, "1/i": z / np.arange(1, d + 1), "1/i^1.5": z / np.arange(1, d + 1) ** 1.5, "two of 64": few}


@pytest.mark.parametrize("name", ["even", "1/i", "1/i^1.5", "two of 64"])
def test_recall_at_the_default_by_spectrum(name):
    rng = np.random.default_rng(21)
    n, d = 20_000, 64
    x = _spectra(rng, n, d)[name]
    book = ann.fit(x[rng.choice(n, ann.SAMPLE_ROWS, replace=False)], d)
    scan = ann.Scan(book, np.arange(60), x[:60], 10, ann.RERANK, ann.DEVIATIONS)
    for a in range(0, n, ann.BLOCK_ROWS):
        y = x[a : a + ann.BLOCK_ROWS]
        codes = book.encode(y)
        lost = np.sqrt(((book.pad(y) - book.words[np.arange(len(book.words)), codes]) ** 2).sum((1, 2)))
        scan.show(np.arange(a, a + len(y)), y, ann.pack(codes), ((y - book.centre) ** 2).sum(1) / 2, lost)
    query, found, _ = scan.found()
    hits = 0
    for i in range(60):
        gap = ((x - x[i]) ** 2).sum(1)
        gap[i] = np.inf
        hits += len(set(np.argsort(gap)[:10]) & set(found[query == i]))
    assert hits >= 0.95 * 600 and scan.measured < 0.15 * 60 * n


def test_a_text_beyond_the_bound_is_left_out_and_the_rest_learnt(spark):
    from chartlines.llm import common

    assert common.fitting(np.array([5, 100, 4, 2]), 10).tolist() == [True, False, True, False]
    rng, vocab = random.Random(4), vocabulary(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 2
        w = [rng.choice(vocab) for _ in range(20)] + (["zzfoul", "zzfoul2"] if bad else ["zzkind"])
        rows.append((i, " ".join(w), "en", "a", 0))
        labels.append((i, bad, 1 - bad))
    rows += [(1000 + i, " ".join(f"long{i}x{j}" for j in range(40_000)), "en", "a", 0) for i in range(3)]
    labels += [(1000 + i, 1, 1) for i in range(3)]
    tagged = spark.createDataFrame([(d, t, q) for d, t, q in labels], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs(spark, rows), tagged, sample_terms=20_000)
    told = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, rows[:400]), model).collect()}
    assert np.mean([told[i] for i in range(1, 400, 2)]) > np.mean([told[i] for i in range(0, 400, 2)]) + 0.3
    model = quality.train(docs(spark, rows), tagged, sample_terms=20_000)
    told = {r["doc_id"]: r["score"] for r in quality.score(docs(spark, rows[:400]), model).collect()}
    assert np.mean([told[i] for i in range(0, 400, 2)]) > np.mean([told[i] for i in range(1, 400, 2)]) + 0.2
