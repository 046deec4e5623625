import importlib
import re
import sys

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from evidentia.llm import queries

SF = "/root/testdata/sf0.001"


def test_each_operator_has_one_query():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()


def test_the_trie_holds_every_conversation(spark):
    rows = {(r.conv_id, r.depth): r for r in queries.QUERIES["op12_centroid_rollup"](spark, SF).collect()}
    ids = {r.conv_id for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").collect()}
    assert rows[min(ids), 0].n_convs == len(ids) and rows[min(ids), 0].n_leaves == sum(r.n_children == 0 for r in rows.values())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op12_centroid_rollup"}))
def test_queries_return_a_row_per_row(spark, name):
    found = queries.QUERIES[name](spark, SF)
    rows = found.count()
    number = name.split("_")[0]
    table = {"op6": ("embeddings", "vec_id"), "op10": ("pages", "page_id"), "op13": ("embeddings", "vec_id")}.get(number, ("documents", "doc_id"))
    ids = spark.read.parquet(f"{SF}/{table[0]}.parquet").select(table[1])
    assert found.select(table[1]).distinct().count() == ids.count()
    assert rows == ids.count() or number in ("op9", "op11") and rows > ids.count() or number == "op13" and rows == 16 * ids.count()


def test_the_entry_works_without_the_operators(monkeypatch):
    real = importlib.import_module

    def missing(name, *rest):
        if name == "corpus_pipeline" or name.startswith("evidentia.llm"):
            gone = "evidentia.llm" if name.startswith("evidentia.llm") else name
            raise ModuleNotFoundError(f"No module named {gone!r}", name=gone)
        return real(name, *rest)

    monkeypatch.setattr(importlib, "import_module", missing)
    assert entry.queries() and not any(n.startswith("op1_") or n == "pipeline" for n in entry.queries())


def test_a_missing_library_takes_out_the_operators_alone(monkeypatch):
    real = importlib.import_module

    def broken(name, *rest):
        if name.startswith("evidentia.llm"):
            raise ModuleNotFoundError("No module named 'zstandard'", name="zstandard")
        return real(name, *rest)

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.warns(UserWarning, match="zstandard"):
        assert "hybrid_retrieval" in entry.queries()


PHRASE = "pack my box with five dozen liquor jugs and then some more words"
BODY = {
    "en": "the quick brown fox number {k} jumps over lazy dog {k} while seven wizards {k} quietly watch the river flow past them {k}",
    "fr": "le petit chat noir {k} dort sur la grande chaise {k} pendant que les enfants {k} jouent dehors sous la pluie froide {k}",
}


def planted():
    docs = [(k, BODY[lang].format(k=f"{'abcdefghij'[k % 10]}{'qrstuvwxyz'[k // 10 % 10]}x"), lang) for k in range(40) for lang in (("en", "fr")[k % 2],)]
    docs = [(k, "\n".join([t, f"own closing line of {k} here"]), lang) for k, t, lang in docs]
    docs += [(100, docs[3][1], "fr"), (101, "1234 %% 5678", "en"), (102, None, "en"), (103, f"something quite new and {PHRASE} then the end of this text", "en")]
    docs += [(104, "a line shared by two texts\nfirst unique body text about some rivers", "en"), (105, "a line shared by two texts\nsecond body with other words about hills", "en")]
    return docs


def test_pipeline_on_planted_cases(spark, documents, tmp_path):
    docs = planted()
    documents(docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PHRASE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = current.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path)).cache()
        assert current.columns == columns
        kept[name] = {r.doc_id: r.text for r in current.collect()}
    everything = {k for k, _, _ in docs}
    assert set(kept["language_id"]) == everything - {101, 102}
    assert set(kept["line_dedup"]) == everything - {101, 102} and kept["line_dedup"][105] == "second body with other words about hills"
    assert kept["line_dedup"][104].startswith("a line shared") and kept["line_dedup"][100] == ""
    assert 103 not in kept["decontamination"] and set(kept["near_duplicates"]) - set(kept["decontamination"]) == {103}
    lengths = {r.doc_id: r.n_chars for r in current.collect()}
    assert all(lengths[k] == len(t) for k, t in kept["decontamination"].items())
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in final.collect()} == set(kept["decontamination"])


def test_stages_take_empty_tables_and_clashing_names(spark, tmp_path):
    spark.createDataFrame([(1, PHRASE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, _gone int, _id long, bitmap string"
    full = spark.createDataFrame([(1, "hello big world of words", "en", "s", 5, "q", 2, 3, "b"), (None, None, None, None, None, None, None, None, None)], schema)
    for docs in (spark.createDataFrame([], schema), full):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, str(tmp_path))
            assert found.columns == docs.columns and found.count() <= docs.count()
        assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() == docs.count()
    assert "corpus_pipeline" in sys.modules
