"""The pipeline against brute-force versions of its stages, each over all that the one before kept."""

import collections
import hashlib

import pytest

import corpus_pipeline
from terrafold.llm import bpe
from tests.llm.test_operators import brute_hits, brute_spans, components

SF = "/root/testdata/sf0.001"


def test_stages(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "encode":
            assert out.columns == docs.columns
            out = corpus_pipeline.keep(out, f"test-{name}")
        seen[name] = (docs, out)
        docs = out
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}

    before, after = map(rows, seen["language"])
    assert set(after) >= {i for i, t in before.items() if t and sum(c.isalpha() for c in t) > 50}

    before, after = map(rows, seen["near_duplicates"])
    _, comp = components(list(before.items()))
    assert set(after) == {i for i, c in comp.items() if i == c}

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    monkeypatch.setattr("tests.llm.test_operators.BENCH", bench)
    before, after = map(rows, seen["benchmark"])
    assert set(after) == {i for i, t in before.items() if not brute_hits(t)[1]}

    before, after = map(rows, seen["secrets"])
    assert set(before) == set(after)
    for i, t in before.items():
        assert (t == after[i]) or brute_spans(t) or "://" in t
        assert not brute_spans(after[i])

    before, out = rows(seen["encode"][0]), {r.doc_id: r for r in seen["encode"][1].collect()}
    assert {i: r.decoded_sha256 for i, r in out.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in before.items()}
    assert collections.Counter(out.keys()) == collections.Counter(before.keys()) and bpe.default_path()


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, blob0 int, salt0 string, spans string, key0 int"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
ITEM = "one two three four five six seven eight nine ten eleven"


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty, wordless and long texts, copies, ties and columns whose names the stages use themselves."""
    near = LONG.replace("w5x", "changed", 40)
    texts = [None, "", " \n", "... !", "ab cd ef", "ab cd ef", LONG, near, f"before {ITEM} after", "key: password = hunter2hunter2", "key: password = hunter2hunter2", "tail"]
    rows = [(i, t, "en" if t else None, None, None, i, "s", None, i) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id but letters", "en", "s", 1, 1, "s", "t", 1), (None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame([(1, ITEM), (None, None), (2, "")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.createDataFrame(rows, SCHEMA), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, str(tmp_path)), "odd")
        kept[name] = sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is None, i or 0))
        if name == "secrets":
            text = {r.doc_id: r for r in docs.collect()}
        assert name == "encode" or docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert kept["language"] == [4, 4, 5, 6, 7, 8, 9, 10, 11, None]
    assert kept["near_duplicates"] == [4, 4, 6, 8, 9, 11, None]
    assert kept["benchmark"] == kept["secrets"] == kept["encode"] == [4, 4, 6, 9, 11, None]
    assert text[9].text == "key: <assign>" and text[6].text == LONG and text[9].blob0 == 9 and text[9].salt0 == "s"


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, str(tmp_path)), "empty")
        assert docs.count() == 0


def test_run_gives_the_last_stage(spark):
    df = corpus_pipeline.run(spark, SF)
    assert df.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and df.count() > 100


@pytest.mark.parametrize("name", ["op1_quality", "op2_neardup", "op3_urls", "op4_warc", "op5_secrets", "op6_licences", "op10_decontaminate"])
def test_queries_equal_their_sql(spark, name):
    from tests.oracle import same
    from terrafold.llm import registry

    same(spark, registry.QUERIES[name], registry.SQL[name], SF)
