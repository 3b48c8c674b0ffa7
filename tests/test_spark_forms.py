"""Operators in their DataFrame form against their plain functions, on small tables with nulls and empty values."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import annotate, decode, segment, subtitles
from textloom.operators.pii import Words, near_context
from textloom.sources.marked import Cue

TEXTS = [
    None,
    "",
    "  \n\n ",
    "One. Two! three? \"Four.\" (Five.) six… Seven",
    "A first line\nand more. B\n\n\nMail a.b@c.se or www.x.org/a?b=1, now. 'End.' next. 12.5 and 3,000.",
    "Ünïcode «Oui.» Ça va ?! non",
    "e.g. this. That) . ] Then     x. New",
    "x" * 3000 + " y. " * 50,
    "don't stop. l’eau. 1. 2. ªb. ºc. Éa",
]


def test_sentence_counts_equal_the_rule(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "One. Two.")], "doc_id long, text string")
    found = {r.doc_id: (r.n_sentences, r.n_tokens) for r in segment.sentence_counts(docs).collect()}
    expected = {i: (len(s), sum(len(x.tokens) for x in s)) for i, t in [*enumerate(TEXTS), (None, "One. Two.")] if (s := segment.segment(t))}
    assert found == expected
    rows = segment.annotated(docs).groupBy("doc_id").agg(F.count("*").alias("s"), F.sum(F.size("sentence.tokens")).alias("t")).collect()
    assert {r.doc_id: (r.s, r.t) for r in rows} == expected


def test_expansion_of_tokens(spark):
    table = {"im": ["in", "dem"], "zur": ["zu", "der"], "AM": ["x", "y"]}
    for w in ("im", "Im", "IM", "zur", "Zur", "am", "AM", "other", "Über"):
        row = spark.createDataFrame([(1, 1, w)], "doc_id long, token int, text string")
        t = spark.createDataFrame(list(table.items()), "text string, parts array<string>")
        found = [r.word for r in annotate.word_rows(annotate.expanded(row, t), ["doc_id"], "token").orderBy("word_id").collect()]
        assert found == (segment.expansion(w, table) or [w])


def test_constrained_trees(spark):
    rng = np.random.default_rng(4)
    names = ["root", "nsubj", "obj", "det"]
    rows = []
    for i in range(6):
        n = 4
        arcs, labels = rng.normal(size=(n, n)), rng.normal(size=(n, n, len(names)))
        rows.append((i, (arcs.tolist(), labels.tolist())))
    df = spark.createDataFrame(rows, "k long, x struct<arcs:array<array<double>>,labels:array<array<array<double>>>>")
    for r in df.select("k", decode.constrained_trees(names)(F.col("x")).alias("y")).collect():
        heads, relations = decode.constrained(np.array(rows[r.k][1][0]), np.array(rows[r.k][1][1]), names)
        assert (list(r.y.heads), list(r.y.relations)) == (heads, relations)


class Lengths:
    """A scorer without a model: long words are B, others O."""

    def load(self) -> None:
        self.ready = True

    def score(self, sentences):
        return [np.array([[0.0, len(w) - 3.5] for w in s], np.float64).reshape(len(s), 2) for s in sentences]


def test_any_scorer_can_be_plugged_in(spark):
    rows = [(1, ["a", "long", "word", "is"]), (2, []), (3, None), (4, ["abcd"])]
    df = spark.createDataFrame(rows, "doc_id long, words array<string>")
    out = {r.doc_id: r.tags for r in decode.scored(df, Lengths(), np.zeros((2, 2)), ["O", "B"]).collect()}
    assert out == {1: ["O", "B", "B", "O"], 2: [], 3: [], 4: ["B"]}


@pytest.mark.parametrize(("size", "overlap"), [(10, 4), (7, 2), (50, 10), (5, 0)])
def test_windows_leave_local_scores_as_they_are(size, overlap):
    items = list(range(43))
    assert decode.windowed(lambda xs: np.array(xs, float)[:, None] * 2, items, size, overlap).ravel().tolist() == [2.0 * x for x in items]


def test_beam_copies_from_the_source():
    """Against the sum over all sequences of both ways to each symbol."""
    step = lambda prefix: [("a", math.log(0.6)), ("$", math.log(0.4))]
    copy = lambda prefix: (0.9, [0.8, 0.2]) if len(prefix) == 1 else (0.0, [0.5, 0.5])
    found, score = decode.beam("^", step, "$", width=5, source=["z", "a"], copy=copy)
    # z by copying alone 0.72; a by both ways 0.06 + 0.18; then the end
    assert found == ["z"] and abs(score - math.log(0.72 * 0.4)) < 1e-9
    assert decode.beam("^", step, "$", width=5)[0] == []


def test_cue_lines_equal_the_transcript(spark):
    cues = [Cue(1, "", ("- Hello <i>there</i>", "", "-- no speaker")), Cue(2, "", ("{\\an8}Up", "–Who?")), Cue(3, "", ("<b></b>",)), Cue(4, "", (" plain ",))]
    df = spark.createDataFrame([("f", i, list(c.lines)) for i, c in enumerate(cues)], "path string, cue_idx int, lines array<string>")
    _, placed = subtitles.transcript(cues)
    expected = [(i, k, x.start, x.text, x.dialogue) for i, own in enumerate(placed) for k, x in enumerate(own)]
    assert sorted((r.cue_idx, r.line_idx, r.start, r.text, r.dialogue) for r in subtitles.cue_lines(df).collect()) == expected


def test_context_in_time_linear_in_the_text():
    import time

    text = "bankgiro 123-4567 och mer text om annat här, " * 3000
    began = time.process_time()
    words = Words(text)
    assert all(near_context(words, i * 45 + 9, i * 45 + 17, ("bankgiro", "org nr")) for i in range(3000))
    assert time.process_time() - began < 5
    assert not near_context("bankgiro a b c d e 123 f", 19, 22, ("bankgiro",)) and near_context("bankgiro b c d e 123 f", 17, 20, ("bankgiro",))
    assert near_context("se org nr: 12", 11, 13, ("org nr",)) and not near_context("xorg nr 12", 8, 10, ("org nr",)) and not near_context("a 1", 2, 3, ())


def test_a_sentence_without_tags_fails(spark):
    rows = [(1, 1, "NOUN", None), (1, 2, None, None), (2, 1, None, None)]
    w = spark.createDataFrame(rows, "doc_id long, word_id int, upos string, xpos string")
    assert annotate.with_tags(w.where("doc_id = 1"), ["doc_id"]).count() == 2
    with pytest.raises(Exception, match="no tags"):
        annotate.with_tags(w, ["doc_id"]).collect()


def test_labels_without_sentence_ends_and_with_inner_blanks(spark):
    units = [(0, p, c, x) for p, (c, x) in enumerate(zip(" ab c. d\t e", [0, 0, 1, 0, 3, 2, 1, 1, 0, 0, 1], strict=True))]
    df = spark.createDataFrame(units, "doc_id long, place int, char string, label int")
    plain = lambda **k: [(r.sent_idx, r.token_idx, r.text, r.start, r.end, r.is_mwt) for r in segment.decoded(df, ["doc_id"], **k).orderBy("start").collect()]
    assert plain() == [(0, 0, "ab", 1, 3, False), (0, 1, "c", 4, 5, True), (0, 2, ".", 5, 6, False), (1, 0, "d", 7, 8, False), (1, 1, "e", 10, 11, False)]
    assert {x[0] for x in plain(ssplit=False)} == {0} and [x[2] for x in plain(longest=1)] == ["<UNK>", "c", ".", "d", "e"]
    assert [x[0] for x in plain(enders=("c",))] == [0, 0, 1, 2, 2]


def test_files_are_converted(spark, tmp_path):
    from textloom import convert
    from textloom.sources import conllu

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One two. Three!")
    convert.main(str(tmp_path / "in"), str(tmp_path / "out"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect() if r.value.strip())
    assert [[w.text for w in s.words()] for s in conllu.read(text.strip("\n") + "\n")] == [["One", "two", "."], ["Three", "!"]]
