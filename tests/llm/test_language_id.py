from __future__ import annotations

import math
import zlib
from collections import Counter

from textloom.llm.language_id import BUCKETS, SMOOTHING, LanguageModel, identify, op4_language_id, with_language

from .helpers import docs, none, odd, odd_rows

MEDIUM = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in docs(spark, MEDIUM).collect()}
    found = op4_language_id(spark, MEDIUM).collect()
    assert len(found) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    unseen = [r for r in found if r.held_out and truth[r.doc_id][0] is not None and len(truth[r.doc_id][1]) >= 40]
    assert len(unseen) > 50
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in unseen) / len(unseen) >= 0.95


def test_held_out_labels_are_never_read(spark):
    df = docs(spark)
    a = LanguageModel.fit(df)
    changed = df.selectExpr("doc_id", "text", "source", "CASE WHEN crc32(cast(doc_id as string)) % 5 = 0 THEN 'xx' ELSE lang END AS lang")
    b = LanguageModel.fit(changed)
    assert a.languages == b.languages and (a.log_prob == b.log_prob).all()


def test_texts_score_alone_as_together(spark):
    model = LanguageModel.fit(docs(spark))
    texts = [r.text for r in docs(spark).limit(40).collect()] + [None, "", "123", "a"]
    names, scores = model.score(texts)
    for t, n, s in zip(texts, names, scores, strict=True):
        one, score = model.score([t])
        assert one == [n] and abs(score[0] - s) < 1e-6
    assert names[-4:-1] == ["und"] * 3 and names[-1] != "und"


def test_odd_rows(spark):
    model = LanguageModel.fit(odd(spark))
    found = identify(odd(spark), model).collect()
    assert len(found) == len(odd_rows())
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3, 10))
    kept = with_language(odd(spark), model)
    assert kept.columns == odd(spark).columns and kept.count() == len(odd_rows()) - 5
    empty = LanguageModel.fit(none(spark))
    assert identify(none(spark), empty).count() == 0
    assert {r.lang_pred for r in identify(odd(spark), empty).collect()} == {"und"}


def _plain_grams(text: str) -> list[int]:
    """The buckets of a text's n-grams, one by one."""
    points = [ord(c) for c in text.lower()]
    symbols = [p if chr(p).isalpha() else 32 for p in points]
    out = []
    for n in (1, 2, 3):
        for i in range(len(points) - n + 1):
            if any(chr(p).isalpha() for p in points[i : i + n]):
                h = 0
                for s in symbols[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + (s + 1) * 0xBF58476D1CE4E5B9) % 2**64
                h = (h ^ (h >> 29)) * 0x94D049BB133111EB % 2**64
                out.append((h >> 40) % BUCKETS)
    return out


def test_equals_plain_naive_bayes(spark):
    """Counts, smoothing and scores of every document, with dictionaries; the sample takes all labelled rows of so small a table."""
    rows = [(r.doc_id, r.lang, r.text) for r in docs(spark).collect()] + [(10**6 + i, lang, text) for i, (_, text, lang, *_) in enumerate(odd_rows()) if lang]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    counts: dict[str, Counter] = {}
    for i, lang, text in rows:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(lang, Counter()).update(_plain_grams(text))
    totals = {x: sum(c.values()) + SMOOTHING * BUCKETS for x, c in counts.items()}
    found = {r.doc_id: r for r in identify(df, LanguageModel.fit(df, rows=1 << 20)).collect()}
    for i, _, text in rows:
        if not any(c.isalpha() for c in text or ""):
            assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
            continue
        grams = Counter(_plain_grams(text))
        score = {x: sum(n * math.log((counts[x][g] + SMOOTHING) / totals[x]) for g, n in grams.items()) for x in sorted(counts)}
        best = max(score.values())
        near = [x for x, s in score.items() if s > best - 1e-3 - 1e-6 * abs(best)]
        assert found[i].lang_pred in near
        if len(near) == 1:
            assert abs(found[i].score - 1 / sum(math.exp(s - best) for s in score.values())) < 1e-3
