"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import embedding_dedup, language_id, lm_score, mixing, near_dedup, packing, quality, token_counts, toxicity, url_rules
from waymark.llm.queries import tokenizer

#: Names that operators use for columns of their own.
CLASHING = ["fp", "own", "size", "copies", "times", "cluster", "piece", "shard", "bin", "score", "kept", "language", "posterior", "f_text", "f_evidence", "f_best", "f_odds", "h", "hd", "chunk", "sure", "is_label", "wanted", "hot_id", "nth", "node", "root", "again", "mixed_id", "kept_id", "quality", "toxic", "url", "html", "label", "n", "held_out", "chosen"]
LONG = "river stone " * 150_000


def _texts():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("riv", "sto", "wal", "tab", "lig", "mor", "gra", "pen") for b in ("er", "ne", "k", "le", "ht", "ing", "ss", "cil")]
    plain = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 120))) + "." for _ in range(40)]
    return [*plain, plain[0], plain[0], None, "", " \n\t ", "one", LONG]


@pytest.fixture(scope="module")
def docs(spark):
    texts = _texts()
    rows = [(None if i % 13 == 5 else i if i < 38 else 7, t, (None, "en", "de")[i % 3], (None, "a", "b", "c")[i % 4], None) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *[F.lit(f"x {c}").alias(c) for c in CLASHING]).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 4 and 1, int(i % 5 == 0), "x") for i in range(38)] * 2 + [(None, 1, 1, "x"), (3, None, None, "x"), (999, 1, 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def folder(docs, labels, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


def _ids(rows):
    return collections.Counter(r.doc_id for r in rows)


def test_operators_return_a_row_per_document(spark, docs, labels):
    want = _ids(docs.select("doc_id").collect())
    outs = {
        "near": near_dedup.near_groups(docs, 4),
        "toxicity": toxicity.toxicity(docs, labels),
        "lm": lm_score.score(docs, labels),
        "quality": quality.quality(docs, labels),
        "mix": mixing.mix(docs),
        "tokens": token_counts.token_counts(docs, *tokenizer()),
    }
    for name, out in outs.items():
        rows = out.collect()
        assert _ids(rows) == want, name
    assert len(outs["tokens"].columns) == len(docs.columns)
    judged = language_id.document_languages(docs, language_id.fit(docs), docs.columns).select("kept.*")
    assert judged.columns == docs.columns and _ids(judged.collect()) == want


def test_long_texts_count_in_whole(spark, docs, labels):
    n = len(LONG.split())
    assert max(r.n_words for r in lm_score.score(docs, labels).collect()) == n
    assert max(r.n_words for r in quality.quality(docs, labels).collect()) == n
    assert max(r.size for r in mixing.mix(docs).collect()) == n
    pieces = packing.pack(docs).collect()
    assert sum(r.n_tokens for r in pieces) == sum(len(t.split()) for t in _texts() if t)
    ranks, pattern = tokenizer()
    counted = token_counts.token_counts(docs, ranks, pattern).where(F.col("doc_id").isNull() | (F.col("doc_id") == 7))
    assert counted.agg(F.max("tokens")).first()[0] >= n


def test_repeated_rows_spread_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 50)
    monkeypatch.setattr(packing, "LOT", 16)
    same = spark.createDataFrame([(1, "a b c", "s")] * 400, "doc_id long, text string, source string")
    rows = packing.pack(same).collect()
    most = max(collections.Counter(r.shard for r in rows).values())
    # One cluster, so a bin for each; eight shards of about fifty.
    assert len(rows) == 400 and len({(r.shard, r.bin) for r in rows}) == 400 and most < 90
    nulls = spark.createDataFrame([(None, f"w{i} x y", "s") for i in range(300)], "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "SHARD_WORDS", 100)
    assert sum(r.taken for r in mixing.mix(nulls).collect()) == pytest.approx(1.5 * 900, abs=200)


def test_an_id_that_many_rows_repeat_is_scored_alike(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "LEAST_HOT", 20)
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 400)
    rows = [(1, f"the cat {i} sat") for i in range(60)] + [(i, f"a dog {i} ran") for i in range(2, 40)] + [(None, "the cat sat")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    spread = {(r.doc_id, r.n_words, round(r.score, 9)) for r in lm_score.score(docs, labels).collect()}
    monkeypatch.setattr(lm_score, "LEAST_HOT", 10**9)
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 1 << 22)
    assert spread == {(r.doc_id, r.n_words, round(r.score, 9)) for r in lm_score.score(docs, labels).collect()}


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns_and_cope_with_all_rows(spark, docs, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    rows, want = out.collect(), _ids(docs.select("doc_id").collect())
    got = _ids(rows)
    assert rows and set(got) <= set(want)
    if name == "mix_sources":
        assert all(got[i] <= 2 * want[i] for i in got) and all((r.text or "").split() for r in rows)
    else:
        assert all(got[i] <= want[i] for i in got)
    if name == "near_dedup":
        # Empty texts stay; of the three copies of the first text one does.
        assert sum(r.text is None or not r.text.split() for r in rows) == 3
        assert sum(r.text == _texts()[0] for r in rows) == 1
    assert all(r.fp == "x fp" and r.kept == "x kept" for r in rows)


def test_last_stage_and_whole_pipeline(spark, docs, folder):
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_no_rows_give_none(spark, docs, labels, folder):
    none, no_labels = docs.limit(0), labels.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    outs = [
        toxicity.toxicity(none, no_labels),
        lm_score.score(none, no_labels),
        quality.quality(none, no_labels),
        mixing.mix(none),
        packing.pack(none, clusters=packing.near_clusters(none)),
        token_counts.token_counts(none, *tokenizer()),
        language_id.page_languages(pages, none),
        url_rules.url_verdicts(pages, url_rules.labelled_urls(pages, no_labels)),
    ]
    assert [out.count() for out in outs] == [0] * len(outs)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_pages_of_all_kinds(spark, docs):
    extra = [F.lit("x").alias(c) for c in ("text", "host", "path", "rule", "verdict", "token", "found_url", "blocked", "markup", "language")]
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (2, "", ""), (3, "http://A.com/en/1", "<html lang=en>" + LONG), (None, "http://b.net/es/", "x")], "page_id long, url string, html string").select("*", *extra)
    labelled = url_rules.labelled_urls(pages, spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int"))
    verdicts = url_rules.url_verdicts(pages, labelled).collect()
    assert collections.Counter(r.page_id for r in verdicts) == {1: 2, 2: 1, 3: 1, None: 1}
    assert {r.page_id: r.verdict for r in verdicts} == {1: "allow", 2: "allow", 3: "allow", None: "block"}
    found = language_id.page_languages(pages, docs).collect()
    assert collections.Counter(r.page_id for r in found) == {1: 2, 2: 1, 3: 1, None: 1}
    # Without documents to learn from there is only und.
    assert {r.language for r in language_id.page_languages(pages, docs.limit(0)).collect()} == {"und"}


def test_vectors_of_all_kinds(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.001], 0), (None, [2.0, 0.0], 0), (3, None, 0), (4, [0.0, 0.0], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", *[F.lit(1).alias(c) for c in ("node", "dim", "codes", "bucket", "copies", "i", "j", "own", "n")])
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.near_vectors(frame).collect())
    assert got == [("1", 3, "1", True), ("1", 3, "1", True), ("2", 3, "1", False), ("3", 0, "3", True), ("4", 0, "4", True), ("None", 3, "1", False)]


def test_a_posterior_is_bayes_rule_on_counts_without_the_row_itself(spark):
    """The fusion against a plain recomputation."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(2)
    say = {"en": ["the", "and", "that", "with"], "de": ["der", "und", "nicht", "mit"]}
    rows = [(i, " ".join(rng.choice(say[lang]) for _ in range(6)), rng.choice([lang, lang, None, "en"]), rng.choice(["x", "y", None])) for i, lang in enumerate([rng.choice(["en", "de"]) for _ in range(60)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit(docs)
    got = {r.kept.doc_id: r for r in language_id.document_languages(docs, model, ["doc_id"]).collect()}
    evidence = np.pad(model.evidence(pa.array([r[1] for r in rows])), ((0, 0), (0, 1)))
    k = evidence.shape[1]
    best = [k - 1 - int(np.argmax(e[::-1])) for e in evidence]
    total = np.ones(k) + np.bincount(best, minlength=k)
    shares = total / total.sum()

    def drawn(rest, above):
        own = np.bincount(rest, minlength=k)
        return (own + language_id.STRENGTH * above) / (own.sum() + language_id.STRENGTH)

    for i, r in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i]
        odds = evidence[i] + np.log(drawn([best[j] for j in others if rows[j][3] == r[3]], shares) if r[3] else shares)
        if r[2]:
            odds = odds + np.log(drawn([best[j] for j in others if rows[j][2] == r[2]], shares) / shares)
        p = np.exp(odds - odds.max())
        assert got[i].language == [*model.languages, "und"][int(np.argmax(odds))]
        assert got[i].posterior == pytest.approx(p.max() / p.sum())


def test_paths_equal_a_plain_isolation_forest():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 3))
    forests = quality.grow(x)

    def path(g, t, row):
        node = 0
        while forests.column[g, t, node] >= 0:
            right = row[forests.column[g, t, node]] >= forests.split[g, t, node]
            node = forests.child[g, t, node] + int(right)
        return forests.path[g, t, node]

    got = forests.paths(x[:40])
    for i in range(40):
        for g in range(4):
            assert got[i, g] == pytest.approx(np.mean([path(g, t, x[i]) for t in range(quality.TREES)]))
    # The forest of one statistic splits at that one only, and a far row has a short path there.
    assert all(set(np.unique(forests.column[g])) <= {-1, g - 1} for g in range(1, 4))
    far = np.vstack([x, [[9.0, 0.0, 0.0]]])
    grown = quality.grow(far)
    assert grown.paths(far)[-1, 1] < np.quantile(grown.paths(far)[:, 1], 0.05)


def test_the_forest_finds_most_poor_rows_that_pass_the_base_rules(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    unseen = labels.where("doc_id % 2 = 0")
    judged = quality.quality(docs.join(unseen.select("doc_id"), "doc_id").select("doc_id", "text").unionByName(docs.join(labels.where("doc_id % 2 = 1").select("doc_id"), "doc_id").select("doc_id", "text")), labels.where("doc_id % 2 = 1"))
    passed = judged.where("not base_failed").join(unseen, "doc_id")
    found = {r.quality: r.gone / r.n for r in passed.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("gone")).collect()}
    assert found[0] > 0.5 and found[1] < 0.02


def test_every_labelled_row_counts_in_fitting(spark):
    rng = random.Random(8)
    usual = [" ".join(f"word{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 90))) for _ in range(400)]
    odd = [t.replace("word", "#|$") for t in usual]
    ids = [r.id for r in spark.range(23_000).orderBy(F.xxhash64("id"), "id").collect()]
    # Poor rows are only among the last 3,000 in the order of the hash.
    poor = set(ids[20_000::2])
    fresh = range(23_000, 23_400)
    rows = [(i, rng.choice(odd if i in poor or i in fresh and i % 2 else usual)) for i in [*ids, *fresh]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in poor), 0) for i in ids], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.quality(docs, labels).where("doc_id >= 23000").collect()}
    assert len(got) == 400 and all(got[i] == (i % 2 == 0) for i in fresh)


def test_trees_draw_from_all_rows_and_copies_count(spark):
    """Each draw is without replacement; the rows of an id count each, in the draws and beside their label."""
    import numpy as np

    texts = [" ".join(f"w{(i * 7 + k) % 911}" for k in range(60 + i)) for i in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), *[(7, texts[7])] * 299, (7, texts[0] + " more"), (None, texts[1]), (8, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i != 7), 0) for i in range(300)] + [(3, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.labelled(quality.measured(docs), labels).cache()
    assert sorted((r.good, r.times) for r in rows.collect()) == [(False, 1), (False, 300)] + [(True, 1)] * 299
    drawn = quality.draw(rows, 600, 40)
    assert {d.shape for d in drawn} == {(256, 8)}
    words = [np.rint(np.exp(d[:, 0])).astype(int).tolist() for d in drawn]
    assert all(max(collections.Counter(w for w in ws if w != 67).values()) <= 2 for ws in words)
    assert {w for ws in words for w in ws} == {60 + i for i in range(300)}
    assert sum(ws.count(67) for ws in words) / (40 * 256) == pytest.approx(0.5, abs=0.03)
    assert all((a == b).all() for a, b in zip(drawn, quality.draw(rows.repartition(5), 600, 40), strict=True))
    assert {d.shape for d in quality.draw(rows.where("not good"), 301, 3)} == {(256, 8)}


def test_best_cut_equals_a_plain_loop(spark):
    rng = random.Random(5)
    for most in (3, 60, 5000):
        rows = [(rng.choice((-2, -1, 1, 1, 3)), *[rng.randint(0, most) / 97 * k for k in range(3)]) for _ in range(400)]
        want = []
        for k in range(3):
            levels = sorted({r[k + 1] for r in rows})
            cuts = [(sum(r[0] for r in rows if r[k + 1] <= a), -i, (a + b) / 2) for i, (a, b) in enumerate(zip(levels[:-1], levels[1:], strict=True))]
            want += [(max(cuts)[0], max(cuts)[2], -k)] if cuts else []
        got = quality.best_cuts(spark.createDataFrame(rows, "gain long, p0 double, p1 double, p2 double"), [0, 1, 2])
        assert sorted(got) == sorted(want)
    assert quality.best_cuts(spark.createDataFrame([], "gain long, p0 double"), [0]) == []


def test_block_selection_equals_listed_blocks():
    """The closed form of what a shard's choice takes, against its blocks one by one."""
    rng = random.Random(6)
    for _ in range(50):
        n, block = rng.randint(1, 12), rng.randint(1, 9)
        q, u = rng.randint(0, 2 * n), rng.randint(0, n - 1)
        times = [((k + 1) * q + u) // n - (k * q + u) // n for k in range(n)]
        assert sum(times) == q and max(times) - min(times) <= 1
        before = lambda at: block * ((at // block * q + u) // n) + (at % block) * times[at // block] if at < n * block else block * ((n * q + u) // n)
        for at in range(n * block + 1):
            assert before(at) - before(0) == sum(times[w // block] for w in range(at))
