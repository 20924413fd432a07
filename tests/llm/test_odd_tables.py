"""Every operator and stage on odd tables: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, decontaminate, jaccard, pieces, pii, quality, secrets, simhash, toxicity, trees, urls
from lodestone.llm.common import labelled_sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named as operators name theirs.
CLASHING = [
    "items", "hits", "n_words", "found", "found_", "kept_id", "kept_tie", "kept_place", "input_ids", "decoded", "n_tokens", "round_trip", "id", "tie", "n", "digest", "label", "half",
    "score", "range", "bare", "key", "packed", "extra", "component", "cell", "rule", "verdict", "base", "added", "formatted", "loss_mask", "held_out", "Text2", "log_chars",
]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n))


LONG = prose(50, 40_000)


@pytest.fixture(scope="module")
def tables(spark):
    texts = [None, "", " \n ", "one", "one", LONG, LONG + " x", "say jo@mail.example.com password=abcdef1", prose(1, 30), prose(1, 30), "7" * 30_000]
    rows = [(k, t, None if k % 3 else "en", None, None) for k, t in enumerate(texts)] + [(3, "one", None, None, None), (None, prose(2, 20), None, None, None), (None, None, None, None, None), (None, "", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame([(k % 11, k % 2, k % 2) for k in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(1, 30)), (1, prose(1, 30)), (2, None), (None, " ".join(LONG.split()[:20])), (4, "")], "item_id long, text string")
    return docs, labels, bench


def clashing(df):
    taken = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit("clash") for c in CLASHING if c.lower() not in taken})


def operators(tagger):
    return {
        "op1": lambda d, labels, bench: quality.op1(d, labels),
        "op4": lambda d, labels, bench: secrets.op4(d),
        "op5": lambda d, labels, bench: pieces.op5(d),
        "op6": lambda d, labels, bench: jaccard.op6(d),
        "op7": lambda d, labels, bench: pii.op7(d, tagger),
        "op8": lambda d, labels, bench: simhash.op8(d),
        "op9": lambda d, labels, bench: decontaminate.op9(d, bench),
        "op10": lambda d, labels, bench: toxicity.op10(d, labels),
    }


@pytest.fixture(scope="module")
def tagger():
    return pii.train(steps=60)


@pytest.mark.parametrize("name", ["op1", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_document_operators(name, tables, tagger):
    docs, labels, bench = tables
    run = operators(tagger)[name]
    plain = sorted(map(repr, run(docs, labels, bench).collect()))
    assert len(plain) == docs.count()
    assert sorted(map(repr, run(clashing(docs), clashing(labels), clashing(bench)).collect())) == plain
    assert run(docs.limit(0), labels.limit(0), bench.limit(0)).collect() == []
    assert run(docs, labels.limit(0), bench.limit(0)).count() == docs.count()
    only = docs.where("doc_id = 0").unionByName(docs.where("doc_id = 0"))  # the same row twice, its text null
    assert len(run(only, labels, bench).collect()) == 2


def test_conversations_and_pages(spark):
    talk = spark.createDataFrame([(1, 0, "user", LONG), (1, 0, "user", LONG), (1, None, None, None), (None, 1, "assistant", ""), (2, 1, "assistant", LONG)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.op2(talk).collect()}
    assert got == {r.conv_id: r for r in chat.op2(clashing(talk)).collect()}
    assert got[1].n_turns == 3 and got[2].loss_chars == len(LONG) and got[None].loss_chars == 0
    assert [r.conv_id for r in chat.op2(talk.limit(0)).collect()] == [-7]
    pages = spark.createDataFrame([(1, "http://a.com/" + "casino/" * 20_000), (1, None), (None, ""), (2, "http://x.net/es/" + "z" * 200_000)], "page_id long, url string")
    rows = sorted(map(repr, urls.op3(pages).collect()))
    assert rows == sorted(map(repr, urls.op3(clashing(pages)).collect())) and len(rows) == 4
    assert urls.op3(pages.limit(0)).collect() == []


def test_url_vocabulary_of_a_table(spark):
    table = spark.createDataFrame([("Bad", 1.0), ("a", 0.4), ("b", 0.4), ("c", 0.3), ("a", 0.1), (None, 1.0), ("d", None)], "term string, weight double")
    terms = urls.vocabulary_of(table)
    words = urls.Vocabulary(terms)
    assert [words.rejects(u) for u in (b"x/bad", b"x/badly", b"a/b", b"a/b/c", b"a/a/a")] == [True, False, False, True, False]
    with pytest.raises(ValueError):
        urls.vocabulary_of(table, most=3)
    pages = spark.createDataFrame([(1, "http://x.org/a/b/c"), (2, "http://x.org/a")], "page_id long, url string")
    assert [r.verdict for r in urls.judge(pages, terms).orderBy("page_id").collect()] == ["block", "allow"]


def test_stages(spark, tables, tmp_path, monkeypatch):
    import corpus_pipeline

    docs, labels, bench = tables
    for name, case in (("plain", docs), ("clash", clashing(docs)), ("none", docs.limit(0)), ("nulls", docs.where("text IS NULL"))):
        for table, df in (("documents", case), ("labels", labels.limit(0) if name == "nulls" else labels), ("benchmark", bench)):
            df.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        now = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns = now.columns
            now = stage(spark, now, f"{tmp_path}/{name}")
            assert now.columns == columns
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        rows = out.collect()
        assert set(case.columns) - {"text"} <= set(out.columns)
        if name == "none":
            assert rows == []
        if name == "nulls":
            assert sorted(map(str, (r.doc_id for r in rows))) == ["0", "None"]
        if name == "clash":
            assert all(r.input_ids == "clash" and r.found == "clash" and r.round_trip_ for r in rows)


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k % 50, f"t{k % 60}") for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 50, k % 2) for k in range(3000)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", 3, 1, 20).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 20
    texts = {}
    for k in range(300):
        texts.setdefault(k % 50, []).append(f"t{k % 60}")
    assert all(r.text == min(texts[r.doc_id]) for r in rows)
    again = labelled_sample(docs.repartition(4), labels.repartition(3), "quality", 3, 1, 20).collect()
    assert sorted(rows) == sorted(again)


def test_rules_against_plain_evaluation(spark):
    """The compiled column, rule by rule in plain Python."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit_on(documents, labels)
    assert rules.rules and len(rules.rules) == len(rules.weights)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in quality.score(documents, rules).collect():
        x = dict(zip(quality.STATISTICS, quality.statistics((texts[r.doc_id] or "").encode()), strict=True))
        total = rules.intercept
        for rule, weight in zip(rules.rules, rules.weights, strict=True):
            if all(x[quality.STATISTICS[j]] <= at if left else x[quality.STATISTICS[j]] > at for j, left, at in rule):
                total += weight
        assert r.score == pytest.approx(1 / (1 + 2.718281828459045**-total), abs=1e-9)


def test_trees_against_plain_evaluation(spark):
    """Scores of the boosted trees and their calibration, node by node in plain Python."""
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_on(documents, labels)
    texts = {r.doc_id: r.text for r in documents.collect()}
    base, grown = model.trees
    at, value = model.knots
    assert grown and list(at) == sorted(at) and list(value) == sorted(value)

    def leaf(node: trees.Node, x):
        while node.left is not None:
            node = node.left if x[node.feature] <= node.threshold else node.right
        return node.value

    def plain_near(text):
        words = toxicity.tokens(text)
        hits = [i for i, w in enumerate(words) if model.lexicon.weigh(w)[0]]
        you = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
        return sum(any(abs(i - k) <= toxicity.NEAR for k in you) for i in hits)

    for r in toxicity.score(documents, model).collect():
        text = (texts[r.doc_id] or "").encode()
        x = toxicity.features(text, model.lexicon, {})
        assert x[toxicity.FEATURES.index("near_you")] == plain_near(text)
        margin = base + 0.2 * sum(leaf(t, x) for t in grown)
        below = [i for i in range(len(at)) if at[i] <= margin]
        i = below[-1] if below else 0
        j = min(i + 1, len(at) - 1)
        part = 0 if not below or at[i] == at[j] else min(1.0, (margin - at[i]) / (at[j] - at[i]))
        assert r.score == pytest.approx(value[i] + part * (value[j] - value[i]), abs=1e-9)


def test_decontamination_in_blocks_and_passes(spark, tables, monkeypatch):
    docs, _, bench = tables
    whole = sorted(map(repr, decontaminate.op9(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 130)
    assert len(list(decontaminate.passes(bench))) > 1
    assert sorted(map(repr, decontaminate.op9(docs, bench).collect())) == whole
    kept = decontaminate.remove(docs, bench)
    assert all(r.n_hit == 0 for r in decontaminate.op9(kept, bench).collect())


def test_shared_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    from lodestone.llm import common

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://far:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Far)
