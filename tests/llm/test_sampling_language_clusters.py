"""Importance resampling, language identification and centroid clustering against plain versions, with the odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewright.llm import importance, language_id, queries, vector_clusters
from ratewright.llm.importance import ImportanceResampler
from ratewright.llm.vector_clusters import VectorClusters

SF = "/root/testdata/sf0.001"
CLASHES = "label string, score string, n string, bucket string, lang string, x string, part string, rank string, cluster string, key string, fit string"


def frame(spark, rows, schema):
    extra = len(CLASHES.split(","))
    return spark.createDataFrame([(*r, *["keep"] * extra) for r in rows], f"{schema}, {CLASHES}")


# --- importance resampling ---

LONG = " ".join(f"w{i % 4001}" for i in range(250_000))
TEXTS = [None, "", " \n ", "One, two-three", "one TWO three", "ÄÖ straße x9 ß" * 9, "a" * 2_500_000, LONG, *[" ".join(f"v{(i * j) % 97}" for j in range(15 + i)) for i in range(40)]]


def features_by_force(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def draw_by_force(rows, target, percent=5):
    own = [(i, *features_by_force(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features_by_force(x)[1])
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    gain = {b: math.floor(1000 * math.log(((t[b] + 1.0) * (all_s + 10_000)) / ((s[b] + 1.0) * (all_t + 10_000)))) for b in s}
    scored = []
    for i, n_words, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        scored.append((i, n_words >= 20, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in scored if r[1]), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = Counter()
    out = []
    for place, r in enumerate(order, 1):
        out.append((r[0], r[2], r[3], r[4], place if place <= percent * len(order) // 100 else None))
        drawn[r] += 1
    return out + [(r[0], r[2], r[3], r[4], None) for r in scored if not r[1]]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("percent", [5, 60])
def test_draw_is_that_of_the_plain_version(spark, percent):
    rows = [*enumerate(TEXTS), (None, "no id " * 30), (3, TEXTS[30]), (20, TEXTS[20]), (20, TEXTS[20])]
    target = ["one two three v1 v2 v3", None, "v5 v10 v15 v20"]
    documents, benchmark = frame(spark, rows, "doc_id long, text string"), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = [tuple(r) for r in ImportanceResampler(percent=percent).draw(documents, benchmark).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert in_order(got) == in_order(draw_by_force(rows, target, percent))


def test_ring_is_exact_across_pieces(monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 7)
    for text in ("a bb ccc dddd eeeee ffffff ggggggg hhhhhhhh i", " x  y ", "z" * 30, "ä ö ü " * 5):
        for n in (1, 2, 3, 5):
            w = text.split()
            want = Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 101 for k in range(1, n + 1) for i in range(len(w) - k + 1))
            count, got = importance.ring_buckets(text.encode(), n, 101)
            assert (count, Counter(got)) == (len(w), want)


def test_empty_tables_are_drawn_from(spark):
    documents, none = frame(spark, [(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert ImportanceResampler().draw(documents.limit(0), none).count() == 0
    assert [r.rank for r in ImportanceResampler(percent=100, least_words=1).draw(documents, none).collect()] == [1]


# --- language identification ---


def test_counts_are_those_of_ngrams_within_words():
    texts = ["", "1 2", "Ab, ab?\ncäd", "a" * 50 + " b", "Der die DAS"]
    block = language_id.counts(texts)
    for text, row in zip(texts, block):
        padded = [f" {w} " for w in re.findall(r"[^\W\d_]+", text.lower())]
        grams = [p[i : i + n] for p in padded for n in language_id.LENGTHS for i in range(len(p) - n + 1) if p[i : i + n].strip()]
        assert row.sum() == len(grams)
        single = [language_id.counts([" ".join(["_"] * k) + text])[0] for k in (0, 3)]
        assert (single[0] == row).all() and (single[1] == row).all()


def test_long_texts_are_counted_whole(monkeypatch):
    text = " ".join(f"Wort{chr(97 + i % 26)} ñandú, 12" for i in range(500))
    whole = language_id._counts([text])
    monkeypatch.setattr(language_id, "PIECE", 40)
    assert "".join(language_id.pieces(text)) == text and len(list(language_id.pieces(text))) > 100
    assert (language_id.counts([text]) == whole).all()


def test_nearest_centroid_is_that_of_the_plain_version():
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(60, language_id.DIMS))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c, radius = language_id.cluster(x, k=3)
    assert np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5) and len(radius) == 3
    before = language_id.cluster(x, k=3, rounds=0)[0]
    assert (x @ c.T).max(1).sum() >= (x @ before.T).max(1).sum()
    texts = ["der hund und die katze", "the dog and the cat", "", "日本語"]
    model = language_id.Model(["a", "b"], np.array([0, 0, 1]), c, radius, np.ones(language_id.DIMS, np.float32))
    lang, near, far = model.judge(texts)
    for k, text in enumerate(texts):
        v = np.log1p(language_id.counts([text])[0].astype(float))
        cosine = [float(v @ y) / max(np.sqrt(v @ v), 1e-12) for y in c]
        assert lang[k] == model.of[int(np.argmax(cosine))] and abs(near[k] - max(cosine)) < 1e-5
        assert far[k] == (1 - max(cosine) > radius[int(np.argmax(cosine))] + language_id.SLACK)


DE, EN = "der hund und die katze gehen nicht über den fluss {}", "the dog and the cat do not walk over the river {}"


def known(n=40):
    return [(i, (DE if i % 2 else EN).format("".join(chr(97 + (i * k) % 26) for k in range(1, 9))), "de" if i % 2 else "en") for i in range(n)]


def test_odd_texts_have_a_language_or_none(spark):
    schema = "doc_id long, text string, lang string, label string, score string, x string, bucket string, n string, text_ string"
    rows = [*known(), (50, "the river", None), (51, None, "en"), (52, "12 34 !", "de"), (None, "die katze", "en"), (3, DE.format("x"), "de"), (3, DE.format("x"), "de"), (53, "日本語の文", None), (54, "", None), (55, "und der fluss " * 60_000, None)]
    documents = spark.createDataFrame([(*r, *["keep"] * 6) for r in rows], schema)
    got = language_id.identify(documents, language_id.fit(documents)).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    assert (of[50].lang_pred, of[55].lang_pred, of[3].lang_pred) == ("en", "de", "de")
    assert [of[k].lang_pred for k in (51, 52, 54)] == ["und"] * 3 and all(of[k].score == 0 and of[k].rejected for k in (51, 52, 54))
    assert of[53].lang_pred in ("de", "en") and of[53].rejected
    assert all(0 <= r.score <= 1 for r in got) and sum(r.doc_id == 3 for r in got) == 3
    assert language_id.identify(documents.limit(0), language_id.fit(documents)).count() == 0
    none = language_id.fit(documents.limit(0))
    assert {r.lang_pred for r in language_id.identify(documents, none).collect()} == {"und"}


def test_sample_is_bounded_and_repeatable(spark):
    documents = spark.createDataFrame([(i % 700, EN.format(i), "en") for i in range(1500)] + [(5, DE.format(1), "de")] * 50, "doc_id long, text string, lang string")
    idf = np.ones(language_id.DIMS, np.float32)
    picked = [sorted(map(tuple, language_id.sample(documents.repartition(p), 40, idf).select("lang", F.hash("x")).collect())) for p in (2, 7)]
    assert picked[0] == picked[1] and Counter(r[0] for r in picked[0])["en"] == 40 and Counter(r[0] for r in picked[0])["de"] <= 40


def test_held_out_languages_are_found(spark):
    got = queries.op12_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95


# --- centroid clustering ---


def clusters_by_force(vectors, k, rounds):
    kept = [(i, [math.floor(256 * v) for v in x]) for i, x in vectors if x is not None and len(x) == 3 and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in first[:k]]
    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids)) for _, x in kept]
    for _ in range(rounds):
        of = [j for _, j in assign()]
        for j in range(len(centroids)):
            rows = [x for (_, x), o in zip(kept, of) if o == j]
            if rows:
                centroids[j] = [sum(c) // len(rows) for c in zip(*rows)]
    found = assign()
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    fits = lambda v: v if v < 2**63 else None
    return [(i, j, fits(d), fits(inertia[j]), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, found)]


RNG = np.random.default_rng(3)
ORDINARY = [(i, RNG.normal(size=3).astype(np.float32).tolist()) for i in range(300)]
ODD = [(400, None), (401, [1.0, None, 2.0]), (402, [1.0, 2.0]), (403, [float("nan"), 0.0, 0.0]), (404, [float("inf"), 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (7, [0.0, 0.0, 0.0]), *[(500 + i, [0.25, -0.25, 0.125]) for i in range(150)], (405, [])]


@pytest.mark.parametrize("vectors", [ORDINARY + ODD, [(i, [x * 3e5 for x in v]) for i, v in ORDINARY[:60]], [(i, [x * 1e10 for x in v]) for i, v in ORDINARY[:30]], ODD[:4], ORDINARY[:2]])
def test_clusters_are_those_of_the_plain_version(spark, vectors):
    table = frame(spark, vectors, "vec_id long, embedding array<float>")
    vectors = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in vectors]
    got = VectorClusters(k=7, dims=3, rounds=4).clusters(table).collect()
    assert in_order(map(tuple, got)) == in_order(clusters_by_force(vectors, 7, 4))


def test_every_branch_gives_the_same_distances():
    for scale in (100, 10**6, 10**8, 10**12):
        x = np.floor(RNG.normal(size=(50, 8)) * scale)
        c = [[int(v) for v in row] for row in np.floor(RNG.normal(size=(5, 8)) * scale)]
        want = [[sum((int(a) - b) ** 2 for a, b in zip(row, k)) for k in c] for row in x.tolist()]
        assert vector_clusters.squared_distances(x, c).tolist() == want
        cluster = np.arange(50) % 5
        sums = vector_clusters.exact_sums(x, cluster, 5)
        assert sums.tolist() == [[sum(int(v) for v in col) for col in x[cluster == j].T.tolist()] for j in range(5)]


def test_inertia_does_not_rise(spark):
    seen = []
    model = VectorClusters(k=5, dims=3, rounds=5, scale=1 << 12)
    table = model.kept(spark.createDataFrame(ORDINARY, "vec_id long, embedding array<float>"))
    model.fit(table, lambda number, inertia: seen.append(inertia))
    assert len(seen) == 5 and seen[-1] < seen[0]
