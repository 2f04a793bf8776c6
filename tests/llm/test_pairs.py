"""Near duplicates of texts and vectors against brute force, and their edges."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow as pa

from waymark.llm.components import components
from waymark.llm.embedding_dedup import near_vectors, shape_of
from waymark.llm.near_dedup import near_groups, one_of_each
from waymark.llm.shingles import shingle_sets

FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def _set(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def _roots(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(n)]


def _texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(1, 150))]
        out.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(("\n" if rng.random() < 0.5 else "  ").join(copy).upper())
    return [*out, "", None, "  \n ", "one", "ONE", "É one", "é one", "long " + "x" * 100_000]


def test_groups_equal_brute_force(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for width in (4, 5):
        sets = [_set(t, width) for t in texts]
        roots = _roots(len(sets), lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
        got = {r.doc_id: r for r in near_groups(docs, width).collect()}
        for i, s in enumerate(sets):
            assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), roots[i], roots[i] == i), (i, texts[i][:40] if texts[i] else texts[i])


def test_ids_that_are_null_or_repeat(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (7, "x y z u v w"), (7, "q r s t u v"), (7, "q r s t u v"), (None, None)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, fp string, root string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_groups(docs).collect())
    assert got == sorted([("None", "5", False), ("5", "5", True), ("7", "7", True), ("7", "7", True), ("7", "7", True), ("None", "None", True)])
    kept = one_of_each(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["5", "7", "7", "None"]
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp", "root"}


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_groups(none).count() == 0 and one_of_each(none).count() == 0


def test_texts_without_any_word_in_a_whole_batch():
    assert [len(s) for s in shingle_sets(pa.array([" \n", None, "", "\t"]), 5)] == [0] * 4


def test_blocks_of_a_large_group(spark, monkeypatch):
    from waymark.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base = [f"v{i}" for i in range(120)]
    rng = random.Random(9)
    texts = []
    for k in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(120)] = f"n{k}"
        texts.append(" ".join(copy))
    sets = [_set(t, 4) for t in texts]
    roots = _roots(60, lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()}
    assert [got[i] for i in range(60)] == roots


def test_components(spark):
    edges = [(9, 8), (8, 7), (7, 6), (6, 5), (1, 2), (2, 1), (3, 3), (None, 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {9: 5, 8: 5, 7: 5, 6: 5, 2: 1}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_are_planned_in_small_parts(spark, monkeypatch):
    from waymark.llm import components as module

    nodes, write = [], module.materialize
    # A node a line; the driver lists them all again after every stage.
    monkeypatch.setattr(module, "materialize", lambda df: (nodes.append(df._jdf.queryExecution().executedPlan().toString().count("\n")), write(df))[1])
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}}
    assert max(nodes) < 70, nodes


def test_vectors_equal_brute_force(spark, monkeypatch):
    from waymark.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(12):
        base = rng.standard_normal(16)
        for _ in range(12):
            rows.append((base + rng.standard_normal(16) * rng.choice([0.0, 0.03, 0.05, 0.3])).astype(np.float32))
    vectors = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(rows)]
    n = len(vectors)
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [1.0, None] * 8, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, vectors[0][1], None), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>, label int")).collect()}
    unit = [np.float64(v) / np.linalg.norm(np.float64(v)) for v in rows]
    linked = lambda a, b: a % 2 == b % 2 and unit[a] @ unit[b] >= 0.98
    roots = _roots(n, linked)
    for i in range(n):
        assert got[i] == (sum(linked(i, j) for j in range(n) if j != i), roots[i], roots[i] == i)
    assert all(got[n + k] == (0, n + k, True) for k in range(6))
    assert got[n + 6] == (1, n + 6, True) and got[n + 7] == (1, n + 6, False)


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert shape_of(0, 0.98)[0] >= 1


def _shuffled(spark, run):
    """Bytes that the jobs of ``run`` write to shuffles."""

    def written():
        time.sleep(0.3)
        spark.range(1).count()  # the store takes in what came before
        time.sleep(0.3)
        return sum(e.totalShuffleWrite() for e in (lambda found: [found.apply(i) for i in range(found.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))

    before = written()
    run()
    return written() - before


def test_sets_are_shuffled_once_by_fingerprint_and_once_a_group(spark, monkeypatch):
    from waymark.llm import near_dedup

    # Groups of several chunks, so that both passes over a group are run, and equal texts under one id.
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "join_hot", lambda rows, facts, key, n, total: rows.join(facts.drop(n), key))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng, texts = random.Random(4), []
        for g in range(40):
            base = [f"g{g}w{i}" for i in range(1500)]
            for _ in range(12 if g == 0 else 3):
                copy = list(base)
                copy[rng.randrange(1500)] = f"n{len(texts)}"
                texts.append(" ".join(copy))
        rows = [*enumerate(texts), (0, texts[0]), (0, texts[0])]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
        got = []
        moved = _shuffled(spark, lambda: got.extend(near_groups(docs).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {r.doc_id: r.component_id for r in got} == {i: 0 if i < 12 else 12 + (i - 12) // 3 * 3 for i in range(len(texts))}
    sets = 8 * sum(len(_set(t, 5)) for t in texts)
    # Once by fp, once to the 1 or 2 groups that a node is in; before, each set went to four shuffles and more.
    assert moved < 3.5 * sets


def test_keys_of_one_node_are_not_shuffled_again(spark):
    texts = [" ".join(f"d{i}w{k}" for k in range(20)) for i in range(4000)]
    texts += [f"{t} more" for t in texts[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = []
    try:
        moved = _shuffled(spark, lambda: got.extend(near_groups(docs).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {r.doc_id: r.component_id for r in got} == {i: i % 4000 for i in range(4040)}
    # 32 keys a node, each once and without its node; before, twice and with it.
    assert moved < 25 * 32 * len(texts), moved / 32 / len(texts)


def test_sets_are_made_again_only_of_texts_that_share_a_key(spark, monkeypatch):
    from waymark.llm import near_dedup

    made = spark.sparkContext.accumulator(0)

    def counting(make):
        def run(texts, width):
            made.add(len(texts))
            return make(texts, width)

        return run

    for name in ("counted_sets", "shingle_sets"):
        if hasattr(near_dedup, name):
            monkeypatch.setattr(near_dedup, name, counting(getattr(near_dedup, name)))
    texts = [" ".join(f"d{i}w{k}" for k in range(20)) for i in range(1000)]
    texts += [f"{t} more" for t in texts[:40]]
    rows = [*enumerate(texts), (None, texts[50]), (None, ""), (7, "something else under the id of a text that is wanted")]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id not in (None, 7)} == {i: i % 1000 for i in range(1040) if i != 7}
    assert sorted(r.component_id for r in got if r.doc_id == 7) == [7, 7] and sum(r.component_id == 7 for r in got) == 3
    # Each text once, and again the 80 of 1,043 that share a key and the few that the bitmap lets through; before, each twice.
    assert len(rows) + 80 <= made.value < 1.2 * len(rows)
