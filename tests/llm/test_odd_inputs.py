"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ratewright.llm import decontaminate, license_scan, line_crf, packing, pairwise_quality, pii, token_attribution, toxicity, url_reputation
from ratewright.llm.ngram_join import NgramJaccardJoin

RANKS, PATTERN, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use themselves.
CLASHES = ["label", "score", "n", "id", "cells", "text_", "base", "spans", "row", "k", "kept", "items", "gram", "part"]
LONG = " ".join(f"w{i % 4001}y{i % 17}" for i in range(150_000)) + " bob@example.com"
WORD = "x" * 300_000


def frame(spark, rows, id_col="doc_id", text_col="text"):
    schema = f"{id_col} long, {text_col} string, " + ", ".join(f"{c} string" for c in CLASHES if c not in (id_col, text_col))
    extra = len(schema.split(",")) - 2
    return spark.createDataFrame([(i, t, *(["keep"] * extra)) for i, t in rows], schema)


def labels(spark, rows, key="doc_id"):
    return spark.createDataFrame(rows, f"{key} long, quality int, toxic int")


GOOD = "The calm river walks slowly past the green bank number {}."
BAD = "BUY!! $$$ NOW!! vile hateful scum ### {} !!!"
KNOWN = [(i, (GOOD if i % 2 else BAD).format(i) + "\n" + (GOOD if i % 2 else BAD).format(i + 1)) for i in range(40)]


def operators(spark, models):
    """Name, and a function of (documents, labels, id column, text column) that gives a row or more per document."""
    return {
        "join": lambda d, y, i, t: NgramJaccardJoin(n=3, threshold=0.9, id_col=i, text_col=t).components(d),
        "packing": lambda d, y, i, t: packing.pack(d, WORDS, id_col=i, text_col=t),
        "pii": lambda d, y, i, t: pii.detect(d, models, id_col=i, text_col=t),
        "tokens": lambda d, y, i, t: token_attribution.section_tokens(d, RANKS, PATTERN, id_col=i, text_col=t),
        "quality": lambda d, y, i, t: line_crf.quality_rules(d, y, id_col=i, text_col=t),
        "toxicity": lambda d, y, i, t: toxicity.toxicity(d, y, id_col=i, text_col=t),
        "licences": lambda d, y, i, t: license_scan.scan(d, id_col=i, text_col=t),
        "ranking": lambda d, y, i, t: pairwise_quality.quality_scores(d, y, id_col=i, text_col=t),
    }


NAMES = ["join", "packing", "pii", "tokens", "quality", "toxicity", "licences", "ranking"]
#: Operators that give a document without text no row.
WITHOUT_TEXT = {"tokens"}


@pytest.mark.parametrize("name", NAMES)
def test_odd_documents(spark, models, name):
    run = operators(spark, models)[name]
    rows = [*KNOWN, (100, None), (101, ""), (102, " \n\t "), (None, "no id here at all"), (103, KNOWN[1][1]), (103, KNOWN[1][1])]
    known = labels(spark, [(i, i % 2, 1 - i % 2) for i, _ in KNOWN] + [(None, 1, 1), (0, None, None), (1, 1, 0), (999, 0, 1)])
    out = run(frame(spark, rows), known, "doc_id", "text").collect()
    key = "doc_id"
    got = [r[key] for r in out]
    want = {i for i, t in rows if t is not None and t.strip() or name not in WITHOUT_TEXT and i is not None}
    assert want <= set(got)
    if name in ("pii", "quality", "toxicity", "licences", "ranking"):
        assert len(got) == len(rows) and got.count(103) == 2 and got.count(None) == 1
        twice = [tuple(r) for r in out if r[key] == 103]
        assert twice[0] == twice[1]
    # the same under other names
    other = run(frame(spark, rows, "n", "items"), known.withColumnRenamed("doc_id", "n"), "n", "items").collect()
    shown = lambda rows_: sorted(str(tuple(r)[:2]) for r in rows_)
    if name != "packing":  # where texts go depends on the order of rows
        assert shown(other) == shown(out)
    assert len(other) == len(out) or name == "packing"


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, models, name):
    run, some = operators(spark, models)[name], labels(spark, [(1, 1, 0)])
    assert run(frame(spark, []), some, "doc_id", "text").collect() == []
    assert run(frame(spark, []), some.limit(0), "doc_id", "text").collect() == []
    assert run(frame(spark, KNOWN[:2]), some.limit(0), "doc_id", "text").count() >= 2


@pytest.mark.parametrize("name", NAMES)
def test_very_long_texts(spark, models, name):
    run = operators(spark, models)[name]
    rows = [(1, LONG), (2, WORD), (3, LONG), (4, "a " * 100_000)]
    out = {}
    for r in run(frame(spark, rows), labels(spark, [(1, 1, 0), (2, 0, 1)]), "doc_id", "text").collect():
        out.setdefault(r.doc_id, []).append(r)
    assert set(out) == {1, 2, 3, 4}
    if name == "join":
        assert out[1][0].component_id == out[3][0].component_id == 1 and out[2][0].n_shingles == 1 and out[4][0].n_shingles == 1
    if name == "pii":
        assert [s.kind for s in out[1][0].spans] == ["email"] and LONG[out[1][0].spans[0].start : out[1][0].spans[0].end] == "bob@example.com"
    if name == "quality":
        assert out[4][0].n_repeat_words == 100_000 and out[1][0].n_words == 150_001
    if name == "tokens":
        assert sum(r.n_chars for r in out[2]) == len(WORD)


def test_empty_fits(spark, models):
    """Models fitted on no texts: base spans stay, and lines are content."""
    nothing = frame(spark, [])
    found = pii.detect(frame(spark, [(1, "a@b.co 10.0.0.1")]), models).first()
    assert [s.kind for s in found.base] == ["email", "ip"]
    crf = line_crf.fit(nothing, labels(spark, []))
    assert crf.decode(np.zeros((3, len(line_crf.S.LINE_FEATURES))) + 1).all()


def test_odd_benchmarks(spark):
    item = "seven wizards quietly boil green tea near an old harbour"
    texts = [(1, None), (2, ""), (3, f"x {item} y"), (3, f"x {item} y"), (None, item), (None, "a clean text without an id"), (None, None), (4, f"{item} {item}"), (4, "a clean text of the same id"), (5, LONG + " " + item)]
    items = spark.createDataFrame([(7, item, "k"), (7, item, "k"), (8, item, None), (None, item, "k"), (9, None, "k"), (10, "", "k")], "item_id long, text string, score string")
    found = decontaminate.contaminated(frame(spark, texts), items).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found) == sorted((d, i) for d in (0, 3, 3, 4, 5) for i in (7, 8))
    left = decontaminate.drop_contaminated(frame(spark, texts), items)
    assert sorted(((r.doc_id or 0), (r.text or "")[:7]) for r in left.collect()) == [(0, ""), (0, "a clean"), (1, ""), (2, ""), (4, "a clean")]
    # of two equal copies in a text the first is given
    assert {r.start_word for r in found if r.doc_id == 4} == {0}


def test_long_secrets_are_covered_whole(spark, models):
    long = "aZ9" * 4000
    secrets = [f"password={long}", f"token = {long[:800]}", f"xoxb-{long[:300]}", f"eyJ{long}.{long[:900]}.{long[:700]}", f"github_pat_{long[:70]}", f"sk-{long[:48]}", f"{long[:200]} (at) {long[:90]}.a1.b2.c3.d4.e5.f6.com"]
    rows = pii.detect(frame(spark, [(k, f"see {x} there") for k, x in enumerate(secrets)]), models).collect()
    for r in rows:
        assert [(s.start, s.end) for s in r.spans] == [(4, 4 + len(secrets[r.doc_id]))], secrets[r.doc_id][:20]


def test_ties_in_ranking(spark):
    """Equal texts score the same, whatever their labels; a score on the threshold is a half."""
    rows = [(i, "same words in every text of this table") for i in range(20)]
    scores = {r.score for r in pairwise_quality.quality_scores(frame(spark, rows), labels(spark, [(i, i % 2, 0) for i in range(20)])).collect()}
    assert scores == {0.5}


def test_odd_pages(spark):
    rows = [(1, None, "h"), (1, "http://a.org/x", "h"), (None, "http://a.org/x", None), (2, "http://", "h"), (3, "http://a.org/" + "y" * 100_000, "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(1, 0), (1, 0), (None, 1), (9, 1)], "page_id long, good int")
    out = url_reputation.judge(pages, outcomes).collect()
    assert len(out) == 5 and all(r.verdict in ("allow", "block") for r in out)


def test_hosts_beyond_the_broadcast_are_dealt_out(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/p{i}") for i in range(200)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i % 7 > 2)) for i in range(0, 200, 2)], "page_id long, good int")
    plain = {tuple(r) for r in url_reputation.judge(pages, outcomes).collect()}
    monkeypatch.setattr(url_reputation, "BROADCAST_HOSTS", 0)
    assert {tuple(r) for r in url_reputation.judge(pages, outcomes).collect()} == plain


def test_classes_beyond_the_broadcast_are_dealt_out(spark, monkeypatch):
    from ratewright.llm import ngram_join

    rows = [(i, f"alpha beta gamma delta {i % 3} epsilon") for i in range(60)]
    plain = sorted(tuple(r) for r in NgramJaccardJoin().components(frame(spark, rows)).collect())
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    assert sorted(tuple(r) for r in NgramJaccardJoin().components(frame(spark, rows)).collect()) == plain


def test_shared_folder_is_asked_for_on_a_cluster(spark):
    from ratewright.llm import storage

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError):
        storage.shared_dir(Session())


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (1, None), (2, ""), (None, "x")]])
def test_pipeline_stages_on_odd_tables(spark, tmp_path, rows):
    """Stages keep the columns of documents, also further ones, and hold on tables of nothing much."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, spans string"
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "keep") for i, t in rows], schema)
    labels(spark, [(1, 1, 0), (None, 0, 1)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema, name
        if name != "quality_rules":  # which rejects texts of under 20 words, all of these
            assert out.count() == len(rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(pieces) == len(rows)


def test_links_of_sizes_and_cells(spark):
    """Sets of every size meet the sets they are linked with, also where crowded cells are left."""
    rng = np.random.default_rng(33)
    shared = [f"s{i}" for i in range(120)]  # a passage that most texts hold
    texts = []
    for g in range(25):
        own = [f"g{g}w{i}" for i in range(int(rng.integers(4, 400)))]
        for _ in range(4):
            copy = list(own)
            for at in rng.integers(0, len(copy), max(0, int(len(copy) * rng.random() * 0.04))):
                copy[at] = f"e{rng.integers(10**6)}"
            texts.append(" ".join([*copy[: len(copy) // 2], *(shared if g % 2 else []), *copy[len(copy) // 2 :]]))
    from test_operators import components_by_force

    for n, t in ((3, 0.9), (5, 0.8), (2, 0.6)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in NgramJaccardJoin(n=n, threshold=t).components(frame(spark, list(enumerate(texts)))).collect()}
        assert got == components_by_force(texts, n, t)
    assert len({c for _, c in got.values()}) < len(texts)


def test_fresh_columns(spark):
    """No operator hands on a column of its own to the caller's table."""
    docs = frame(spark, KNOWN)
    assert decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "x y z")], "item_id long, text string")).columns == docs.columns
    assert NgramJaccardJoin().representatives(docs).columns == docs.columns
    assert line_crf.keep_content(docs, labels(spark, [])).columns == docs.columns
    assert docs.select(F.count("*")).first()[0] == len(KNOWN)
