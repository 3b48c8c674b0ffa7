"""What a Python worker holds at once is bounded, whatever the table's size, and nothing of the results depends on it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textloom.functions.unicode import arrow_values, lower
from textloom.operators import chunking, coref, masking, pii, segment, subwords
from textloom.session import BATCH_BYTES, BATCH_ROWS
from textloom.sources import conllu, docjson, marked
from textloom.sources.documents import Sentence, Token, Word, documents_of, sentence_array, sentences_of

SETTINGS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
FILE = "# text = no se\n1-2\tnose\t_\t_\t_\t_\t_\t_\t_\tstart_char=0|end_char=4|ner=S-X\n1\tno\tno\tADV\t_\t_\t2\tadvmod\t_\tcoref_chains=unit-repr-id3\n2\tse\t_\tPRON\t_\ta=b\t0\troot\t_\t_\n2.1\tx\ty\t_\t_\t_\t_\t_\t_\t_\n\n1\tb\tb\tX\tY\t_\t0\troot\t_\tSpaceAfter=No\n"


def widened(spark) -> list[str]:
    before = [spark.conf.get(k) for k in SETTINGS]
    for k, v in zip(SETTINGS, ("10000", str(64 << 20)), strict=True):
        spark.conf.set(k, v)
    return before


def made(spark):
    """By name, what makes each of these steps."""
    w = spark.createDataFrame([(1, 1, "a", "X", 0, "root", 0, 1)], "doc_id long, word_id int, text string, upos string, head int, deprel string, start_char int, end_char int")
    s, f = conllu.from_words(w), spark.createDataFrame([(1, FILE)], "doc_id long, value string")
    t = f.withColumnRenamed("value", "text")
    return {
        "rendered": lambda: conllu.rendered(s, "doc_id"),
        "sentences": lambda: conllu.sentences(f, "doc_id"),
        "read json": lambda: conllu.sentences(f, "doc_id", reader=docjson.read),
        "dependencies": lambda: s.select(conllu.dependencies_string(F.col("sentence"))),
        "chains": lambda: coref.chains_of(s),
        "values": lambda: f.select(arrow_values(len, "int")(F.col("value"))),
        "chunks": lambda: chunking.chunks(t, 20),
        "subwords": lambda: subwords.piece_counter(t, 9),
        "personal data": lambda: pii.find_pii(t),
        "masks": lambda: masking.masked(t),
        "cues": lambda: marked.cue_rows(f, key="doc_id"),
        "segments": lambda: segment.annotated(t),
        "strings": lambda: f.select(lower(F.col("value"))),
    }


@pytest.mark.parametrize("name", ["rendered", "sentences", "read json", "dependencies", "chains", "values", "strings", "chunks", "subwords", "personal data", "masks", "cues", "segments"])
def test_python_gets_small_batches(spark, name):
    before = widened(spark)
    try:
        made(spark)[name]()
        assert [int(spark.conf.get(k).removesuffix("b")) for k in SETTINGS] == [BATCH_ROWS, BATCH_BYTES]
    finally:
        for k, v in zip(SETTINGS, before, strict=True):
            spark.conf.set(k, v)


def test_nested_rows_come_in_batches_of_few_bytes(spark):
    def sizes(values):
        import pyarrow as pa

        return pa.array([values.nbytes] * len(values), pa.int64())

    import pyarrow as pa

    from textloom.functions.unicode import bounded_udf

    sizes.__annotations__ = {"values": pa.Array, "return": pa.Array}
    rows = spark.range(0, 3000, 1, 1).select(F.array_repeat(F.struct(F.lit("word").alias("a"), F.array_repeat(F.lit("x" * 20), 20).alias("b")), 50).alias("v"))
    most = rows.select(bounded_udf(sizes, "long")(F.col("v")).alias("n")).agg(F.max("n")).first()[0]
    assert most < 2 * BATCH_BYTES


def test_sentences_by_column_equal_those_read():
    import pyarrow as pa

    read = conllu.read(FILE)
    assert read[0].tokens[0].is_mwt and read[0].empty and read[0].tokens[0].ner == "S-X"
    many = [*read, Sentence(), Sentence("i", "t", None, 2, [Token("z", words=[])], [Word(0, "e", empty_index=1)])] * 40
    values = sentence_array(many)
    assert sentences_of(values) == many
    assert sentences_of(values.slice(1, 7)) == many[1:8]
    kind = pa.struct([("sent_idx", pa.int32()), ("sentence", values.type)])
    places = pa.array([len(many) - i for i in range(len(many))], pa.int32())
    lists = pa.ListArray.from_arrays(pa.array([0, 3, 3, 100, len(many)], pa.int32()), pa.StructArray.from_arrays([places, values], fields=list(kind)))
    assert list(documents_of(lists)) == [many[:3][::-1], [], many[3:100][::-1], many[100:][::-1]]
    assert list(documents_of(lists.slice(2, 1))) == [many[3:100][::-1]]


def test_sentences_of_one_file_are_passed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(conllu, "WORDS", 5)
    text = "\n".join("".join(f"{i}\tw{n}-{i}\t_\t_\t_\t_\t{i - 1}\tdep\t_\t_\n" for i in range(1, 4)) for n in range(9))
    found = conllu.words(conllu.sentences(spark.createDataFrame([(1, text), (2, None), (3, text)], "doc_id long, value string"), "doc_id")).collect()
    assert sorted((r.doc_id, r.sent_idx, r.word_id, r.text) for r in found) == [(d, n, i, f"w{n}-{i}") for d in (1, 3) for n in range(9) for i in range(1, 4)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_search_in_pieces_equals_all_pairs(spark, monkeypatch, kind):
    import numpy as np

    from textloom.operators import retrieval

    rng = np.random.default_rng(3)
    # few directions, so that many scores tie and the least ids must win; ids in no order, of different lengths
    vectors = [[float(x) for x in rng.integers(-1, 2, 3)] for _ in range(400)]
    ids = [int(i) for i in rng.permutation(400) * 7]
    name = (lambda i: i) if kind == "long" else str
    rows = spark.createDataFrame([(name(i), v) for i, v in zip(ids, vectors, strict=True)], f"id {kind}, v array<double>")
    queries = rows.where("cast(id as long) % 20 = 0").withColumnRenamed("id", "q")
    unit = np.array(vectors) / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    at = {i: n for n, i in enumerate(ids)}
    expected = {(name(i), j) for i in ids if i % 20 == 0 for _, j in sorted((-round(float(unit[at[i]] @ unit[n]), 6), name(j)) for j, n in at.items())[:5]}
    monkeypatch.setattr(retrieval, "SCORES", 64)
    assert {(r.q, r.id) for r in retrieval.search(queries, rows, 5).collect()} == expected
    best = retrieval._Best(3, 2)
    for n in range(4):
        best.offer(np.zeros((3, 5)), np.arange(5) + 5 * (3 - n))
    assert [x[:2] for x in best.parts(100)] == [([0, 0, 1, 1, 2, 2], [0, 1] * 3)]
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 100)
    assert [len(i) for i, _ in retrieval._blocks(queries.select("q", "v"))] == [4] * (queries.count() // 4) + [queries.count() % 4] * bool(queries.count() % 4)


def test_texts_that_differ_in_a_word_have_different_vectors(spark):
    from textloom.operators.retrieval import hashed_terms

    rows = spark.range(1, 3000).select(F.concat(F.lit("# Part "), "id").alias("t")).select(hashed_terms(4096)(F.col("t")).alias("v"))
    assert rows.distinct().count() == 2999


def test_letters_of_customers_are_dealt_over_the_cores(spark):
    from textloom.plans import catalog

    # one file of one row group; the work is in the text made of each row
    assert catalog.QUERIES["pii_spans"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_languages_by_broadcast_equal_those_by_join(spark, monkeypatch):
    from textloom.operators import langid

    texts = [(1, "en", "the cat sat on the mat"), (2, "de", "die Katze saß auf der Matte"), (3, None, "on the mat \U0001f600 x"), (4, None, "ab"), (5, None, None), (6, None, "auf der"), (6, None, "the cat sat"), (None, None, "Katze İ")]
    d = spark.createDataFrame(texts, "doc_id long, lang string, text string")
    model = langid.fit(d)
    monkeypatch.setattr(langid, "CHARS", 4)
    near = {tuple(r) for r in langid.identify(d, model).collect()}
    assert "Join" not in langid.identify(d, model)._jdf.queryExecution().toString()
    monkeypatch.setattr(langid, "CELLS", 0)
    assert near == {tuple(r) for r in langid.identify(d, model).collect()}
    assert {x for x, _ in near} == {1, 2, 3, 6, None}


@pytest.mark.parametrize("repeated", [False, True])
def test_heaviest_terms_shuffle_texts_and_not_terms(spark, tmp_path, monkeypatch, repeated):
    from tests.oracle import both
    from textloom.plans import catalog, text_queries

    rows = [(i, f"common word w{i % 7 * 'x'} " + "often " * (i % 3)) for i in range(40)] + [(40, None), (41, ""), (3 if repeated else 42, "word common common"), (None, "alone"), *([(None, "word alone")] if repeated else [])]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    sql = catalog.ORACLE_SQL["tfidf_top"]
    found, expected = both(spark, catalog.QUERIES["tfidf_top"], sql, str(tmp_path))
    assert found == expected
    plan = catalog.QUERIES["tfidf_top"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "BroadcastHashJoin" in plan
    monkeypatch.setattr(text_queries, "BROADCAST_TERMS", 0)
    found, expected = both(spark, catalog.QUERIES["tfidf_top"], sql, str(tmp_path))
    assert found == expected
