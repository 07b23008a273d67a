"""Every operator on odd rows and on empty tables: defined results, no crash."""

import hashlib

import pytest

import corpus_pipeline
from pagetally.llm import decontaminate, katz, lines, mixing, passages, quality, simhash, tools, topk, toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "every way and a SECOND line of it the same text"), (2, "One!"), (3, None), (None, "one"), (4, "?"), (1, "one")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(6, 1, 0), (6, 1, 1), (4, 0, None), (None, 1, 1), (99, 0, 1), (5, None, 0)], LABELS)


def by_id(frame):
    return {row.doc_id: row for row in frame.collect()}


def test_simhash(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 10
    found = {r.doc_id: r for r in rows}
    assert {found[i].component_id for i in (1, 2, 3)} == {1} and found[2].fingerprint == "0" * 16
    assert {found[i].component_id for i in (6, 7, 8)} == {6} and sum(r.doc_id == 6 for r in rows) == 2
    assert found[None].component_id is None
    assert simhash.near_duplicates(no_docs).count() == 0


def test_keep_one(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 5, 6, None]
    assert simhash.keep_one(no_docs).count() == 0


def test_decontaminate(odd_docs, no_docs, items):
    rows = by_id(decontaminate.report(odd_docs, items))
    none = hashlib.sha256(b"").hexdigest()
    assert rows[1].n_words == rows[2].n_words == rows[3].n_words == 0 and rows[1].items_sha256 == none
    assert rows[4].contaminated and rows[4].n_items == 2 and rows[4].items_sha256 == hashlib.sha256(b"1,2").hexdigest()
    assert not rows[6].contaminated  # the item goes on where the text ends
    left = decontaminate.decontaminate(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == 9
    assert decontaminate.decontaminate(odd_docs, items.limit(0)).count() == 10
    assert decontaminate.report(no_docs, items).count() == 0
    pieces = decontaminate.report(odd_docs, items, item_bytes=8, shard_words=3)
    assert sorted(map(str, pieces.collect())) == sorted(map(str, decontaminate.report(odd_docs, items).collect()))


def test_mixture(odd_docs, no_docs):
    mixed = mixing.poisson_mixture(odd_docs, size=400)
    assert mixed.columns == [*odd_docs.columns, "_copy", "_shuffle_key"]
    assert 300 < mixed.count() < 500 and mixed.where("source is null").count() > 90
    assert mixing.poisson_mixture(odd_docs, weights={"t": 1.0}).where("source <> 't' or source is null").count() == 0
    assert mixing.poisson_mixture(odd_docs, weights={}).count() == 0
    assert mixing.poisson_mixture(no_docs).count() == 0
    big = mixing.poisson_mixture(odd_docs.where("doc_id = 4"), size=5000)  # a mean beyond one table
    assert 4600 < big.count() < 5400


@pytest.mark.parametrize("score", [quality.quality, toxicity.toxicity])
def test_classifiers(score, odd_docs, no_docs, labels):
    rows = score(odd_docs, labels).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert all(r.score == 0.5 for r in score(odd_docs, labels.limit(0)).collect())
    assert score(no_docs, labels).count() == 0


def test_lines(odd_docs, no_docs):
    frame = lines.dedup_lines(odd_docs)
    assert frame.columns == [*odd_docs.columns, "n_removed"]
    rows = by_id(frame)
    assert rows[1].text is None and rows[2].text == "" and rows[3].text == " \n\t "
    assert rows[6].n_removed == 0 and rows[7].text == "" and rows[7].n_removed == 2
    assert rows[8].text == "THE SAME text in every way"  # two edits away
    assert frame.count() == 10 and lines.dedup_lines(no_docs).count() == 0


def test_katz(odd_docs, no_docs):
    rows = katz.score_texts(odd_docs).collect()
    assert len(rows) == 10 and all(r.score <= 0 for r in rows)
    found = {r.doc_id: r for r in rows}
    assert found[1].n_tokens == found[2].n_tokens == 1 and found[1].score == found[2].score
    assert found[5].n_tokens == 20_001
    assert katz.score_texts(no_docs).count() == 0


def test_passages(odd_docs, no_docs):
    from pyspark.sql import functions as F

    words = "the same text " + " ".join(f"word{i}" for i in range(27))
    odd_docs = odd_docs.withColumn("text", F.when(F.col("doc_id") < 6, F.col("text")).otherwise(F.lit(words)))
    assert {r.doc_id for r in passages.repeated_passages(odd_docs, least_words=24).collect()} == {7, 8, None}
    with pytest.raises(ValueError):
        passages.repeated_passages(odd_docs, least_words=10)
    left = by_id(passages.drop_passages(odd_docs, least_words=24))
    assert left[7].text == "" and left[1].text is None and left[6].text.startswith("the same")
    assert passages.repeated_passages(no_docs).count() == 0
    assert passages.drop_passages(no_docs).columns == no_docs.columns


def test_top_k(spark):
    nan = float("nan")
    rows = [
        *((0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [None, 1.0]), (4, None), (5, [nan, 1.0])),
        *((6, []), (None, [9.0, 9.0]), (7, [float("inf"), 1.0]), (50, [2.0, 2.0, 2.0]), (100, [-1.0, 0.0])),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = vectors.withColumns({c: vectors.vec_id for c in ("id", "norm", "part", "score")})
    from pyspark.sql import functions as F

    found = topk.top_k(vectors, F.col("id") % 50 == 0, k=3).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == {
        0: [(1, 1, 65536), (2, 2, 65536), (3, 2, 65536)],
        100: [(1, 0, -65536), (2, 1, -65536), (3, 2, -65536)],
    }  # 50 has no other row of its length
    assert topk.top_k(vectors.limit(0), F.col("id") % 50 == 0).count() == 0


CALLS = "conv_id long, turn long, call_no int, call_id string, name string, arguments string, level int"
RESULTS = "conv_id long, turn long, call_id string, content string, status string"


def test_tools(spark):
    schemas = {"f": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}}
    calls = spark.createDataFrame(
        [
            (1, 1, 0, "b", "f", '{"x": {"$call": "a"}, "é": "\\n"}', 9),
            (1, 3, 0, "a", "f", ' { "x" : 1 } ', 9),
            (1, 4, 0, "a", "f", '{"x": 2}', 9),  # repeats an identifier
            (1, 5, 0, "c", "f", '{"x": {"$call": "c"}}', 9),
            (1, 6, 0, "d", "f", '{"x": {"$call": "c"}}', 9),
            (1, 7, 0, "e", "f", '{"x": {"$call": "z"}}', 9),
            (1, 8, 0, "f", "f", "{}", 9),
            (1, 8, 1, "g", "g", None, 9),
            (1, 8, 2, "h", "f", "{", 9),
            (2, 1, 0, "a", "f", '{"x": 1.5}', 9),
            (2, 2, 0, "n", "f", '{"x": 1}', 9),
            (None, 1, 0, "a", "f", "{}", 9),
            (1, 1, 0, None, "f", "{}", 9),
        ],
        CALLS,
    )
    results = spark.createDataFrame(
        [(1, 2, "b", "late", ""), (1, 1, "b", "first", ""), (1, 4, "a", None, ""), (1, 9, "nobody", "x", ""), (None, 1, "a", "x", "")],
        RESULTS,
    )
    rows = {(r.conv_id, r.call_id): r for r in tools.link_calls(calls, results, schemas).collect()}
    assert len(rows) == 10
    assert {k: (r.level, r.status) for k, r in rows.items()} == {
        (1, "a"): (0, "ok"),
        (1, "b"): (1, "ok"),
        (1, "c"): (None, "circular"),
        (1, "d"): (None, "circular"),
        (1, "e"): (0, "dangling"),
        (1, "f"): (0, "invalid"),
        (1, "g"): (0, "invalid"),
        (1, "h"): (0, "invalid"),
        (2, "a"): (0, "invalid"),
        (2, "n"): (0, "unanswered"),
    }
    assert rows[1, "b"].json == '{"arguments":{"x":{"$call":"a"},"é":"\\n"},"id":"b","name":"f","result":"first","status":"ok"}'
    assert rows[1, "a"].json == '{"arguments":{"x":1},"id":"a","name":"f","result":null,"status":"ok"}'
    assert [rows[1, c].detail for c in "fgh"] == ["x: missing", "unknown tool", "arguments: not JSON"]
    assert tools.link_calls(calls.limit(0), results, schemas).count() == 0


def test_unknown_tools_are_ordered(spark):
    """A tool without schema comes after the calls it uses too, and can be in a circle."""
    schemas = {"f": {"type": "object"}}
    calls = spark.createDataFrame(
        [
            (1, 1, 0, "a", "f", "{}", 0),
            (1, 2, 0, "b", "f", '{"x": {"$call": "a"}}', 0),
            (1, 3, 0, "c", "new", '{"x": [{"$call": "b"}, {"$call": "b"}]}', 0),
            (1, 4, 0, "d", "f", '{"x": {"$call": "c"}}', 0),
            (1, 5, 0, "e", "new", '{"x": {"$call": "e"}}', 0),
            (1, 6, 0, "g", "f", '{"x": {"$call": "e"}}', 0),
            (1, 7, 0, "h", "new", '{"x": {"$call": "nobody"}}', 0),
        ],
        CALLS,
    )
    results = spark.createDataFrame([(1, 9, i, "r", "") for i in "abcdegh"], RESULTS)
    rows = {r.call_id: (r.level, r.status, r.detail) for r in tools.link_calls(calls, results, schemas).collect()}
    assert rows == {
        "a": (0, "ok", None),
        "b": (1, "ok", None),
        "c": (2, "invalid", "unknown tool"),
        "d": (3, "ok", None),
        "e": (None, "circular", None),
        "g": (None, "circular", None),
        "h": (0, "invalid", "unknown tool"),
    }


def test_pipeline_stages(spark, odd_docs, no_docs, sf_dir):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == start.columns and set(names) <= set(docs.columns)
        mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert mixed.count() >= 0


def test_arguments_that_are_no_json(spark):
    texts = ["[" * 200_000 + "]" * 200_000, '{"a": "\\ud800"}', '{"a": NaN}', '{"a": 1e999}', '{"a": -Infinity}', '{"a": 1}']
    calls = spark.createDataFrame(
        [(1, i, 0, f"c{i}", "tool", text) for i, text in enumerate(texts)],
        "conv_id long, turn long, call_no int, call_id string, name string, arguments string",
    )
    results = spark.createDataFrame([(1, 9, "c5", "done")], "conv_id long, turn long, call_id string, content string")
    rows = {r.call_id: r for r in tools.link_calls(calls, results, {"tool": {"type": "object"}}).collect()}
    assert [rows[f"c{i}"].detail for i in range(5)] == ["arguments: not JSON"] * 5 and rows["c5"].status == "ok"
