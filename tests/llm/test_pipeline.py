"""The pipeline's stages and a whole run, against plain code over all rows in one process."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from platterlake.llm import quality
from platterlake.llm.shared import fold
from tests.llm.test_operators import DOCS, brute_hits, brute_lines, brute_near, empty, filled, frame, words

ITEM = "what is the name of the tallest hill that stands in the middle of this old island"


def rows_of(texts):
    return [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in texts]


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of the three tables the pipeline reads, and the document rows."""
    rng = random.Random(21)
    good = lambda n: " ".join(f"w{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.choice('rstuv')}" for _ in range(n)) + "."
    texts = [(i, "\n".join(good(rng.randrange(9, 30)) for _ in range(4))) for i in range(120)]
    texts += [(200 + i, "$$ %% ## 77 88 99 || == " * rng.randrange(4, 30)) for i in range(40)]
    texts += [(300, texts[5][1]), (301, texts[5][1].replace("\n", " ")), (302, good(60) + " " + ITEM), (302, good(60)), (303, ""), (304, None)]
    texts += [(None, ITEM + " " + good(40)), (None, good(40)), (305, texts[7][1]), (305, texts[7][1])]
    rows = rows_of(texts)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(200 + i, 0, 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i1", ITEM)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_run_equals_plain_code(spark, tables):
    sf_dir, rows = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id")) != 0)
    kept = []
    for r in rows:
        raw = np.frombuffer((r[1] or "").encode(), np.uint8)
        if model.score(quality.features(raw, np.array([0, len(raw)])).astype(np.float64))[0] >= 0.3:
            kept.append(r)
    assert sum((r[0] or 999) < 120 for r in kept) > 105 and not any(200 <= (r[0] or 0) < 240 for r in kept)
    assert plain(corpus_pipeline.classify_quality(spark, docs, sf_dir).collect()) == plain(kept)

    lines = {}
    for i, t in {(r[0], r[1]) for r in kept}:
        lines[i, t] = None
    keyed = [(k, t) for k, (i, t) in enumerate(sorted(lines, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")))]  # shared ids are told apart by text
    order = sorted(lines, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    left = brute_lines(keyed)
    shared_first = {order[k]: left[k] if t is not None else None for k, t in keyed}
    after = [(r[0], shared_first[r[0], r[1]], *r[2:4], len(shared_first[r[0], r[1]] or "") if r[1] is not None else None) for r in kept]
    after = [a for a, r in zip(after, kept, strict=True) if a[1] == r[1] or a[1].strip()]
    got = corpus_pipeline.dedup_lines(spark, spark.createDataFrame(kept, DOCS), sf_dir)
    assert plain(got.collect()) == plain(after)

    distinct = list(dict.fromkeys((r[0], r[1]) for r in after))
    numbered = sorted(range(len(distinct)), key=lambda k: (distinct[k][0] is None, distinct[k][0] or 0))
    near = brute_near([(n, distinct[k][1]) for n, k in enumerate(numbered)])
    stays = {distinct[numbered[n]] for n, _, _, own in near if own}
    once = [r for r in dict.fromkeys(after) if (r[0], r[1]) in stays]
    assert plain(corpus_pipeline.join_near_copies(spark, spark.createDataFrame(after, DOCS), sf_dir).collect()) == plain(once)

    clean = [r for r in once if not brute_hits([(r[0], r[1])], [("i1", ITEM)])[0][-1]]
    assert len(clean) < len(once)
    assert plain(corpus_pipeline.decontaminate(spark, spark.createDataFrame(once, DOCS), sf_dir).collect()) == plain(clean)

    result = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in result) == sorted((str(r[0]), len((r[1] or "").split())) for r in clean)
    sizes: dict = {}
    for r in clean:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    target = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()), 2.0)
    for s in sizes:
        assert all(r["target"] == pytest.approx(target[s]) for r in result if r["source"] == s)


def test_join_keeps_one_row_of_each_group(spark):
    text = words(random.Random(1), 50)
    rows = rows_of([(None, text), (None, text), (7, text), (7, text), (8, text + " more"), (9, ""), (9, ""), (7, words(random.Random(2), 50)), (None, None)])
    got = corpus_pipeline.join_near_copies(spark, frame(spark, rows), "").select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(7, text), (9, ""), (9, ""), (7, rows[7][1]), (None, None)]))
    only_null = corpus_pipeline.join_near_copies(spark, frame(spark, rows[:2]), "").collect()
    assert [(r["doc_id"], r["text"]) for r in only_null] == [(None, text)]


def test_stages_on_empty_tables(spark, tables):
    sf_dir, _ = tables
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), sf_dir).collect() == []


def test_stages_return_the_columns_of_documents(spark, tables):
    sf_dir, rows = tables
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
