from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.functions.unicode import from_utf16, to_utf16
from textloom.operators import chunking, decode, masking, segment
from textloom.sources import conllu, docjson
from textloom.sources.documents import Sentence, Token, Word
from textloom.sources.marked import parse_markdown, parse_srt, parse_tagged

#: Pieces that break tokenizers: controls, many kinds of line break and blank, joiners, direction marks, emoji, full width.
PIECES = ["\x00", "\x1c", "\x85", "\u2028", "\r\n", "\n \n", "\u00a0", "\u200b", "\u200d", "\u202e", "\U0001f468\u200d\U0001f469", "e\u0301", "\U00010348", "Ａ１", "...", "?!?", "“x”", "a@b.se", "https://x.y/z?q=1.", "www.", "it's", "3.5", "-", "(", ")", "Hello", "world", " ", " ", "\t", "å", "İ", "ß"]
texts = st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_segments_cover_the_text(text):
    tokens = [t for s in segment.segment(text) for t in s.tokens]
    assert all(text[t.start_char : t.end_char] == t.text for t in tokens)
    if tokens:
        assert tokens[0].spaces_before + "".join(t.text + t.space_after for t in tokens) == text
    assert [s.text for s in segment.segment(text)] == segment.sentence_texts(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \t\r\n|\\\u00a0spntu0A", max_size=20))
def test_escapes_round_trip(space):
    assert conllu.unescape_space(conllu.escape_space(space)) == space


words = st.text(alphabet="abåß😀-.", min_size=1, max_size=6)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(words, st.sampled_from(["O", "B-X", "E-X", "S-Y"]), st.sampled_from(["", " ", "  ", "\n"])), min_size=1, max_size=6), max_size=4))
def test_formats_round_trip(rows):
    sentences = []
    for i, row in enumerate(rows):
        tokens = [Token(w, ner=t, space_after=sp, words=[Word(j + 1, w, head=0 if j == 0 else 1, deprel="root" if j == 0 else "dep")]) for j, (w, t, sp) in enumerate(row)]
        sentences.append(Sentence(str(i), " ".join(w for w, _, _ in row), tokens=tokens))
    text = conllu.write(sentences)
    assert conllu.write(conllu.read(text)) == text
    assert docjson.write(docjson.read(docjson.write(sentences))) == docjson.write(sentences)


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(0, 40))
def test_offsets_convert_both_ways(text, at):
    at = min(at, len(text))
    assert from_utf16(text, to_utf16(text, at)) == at


@settings(max_examples=150, deadline=None)
@given(texts, st.integers(1, 12), st.integers(0, 6))
def test_chunks_hold_every_word_in_order(text, most, overlap):
    for s in chunking.sections(parse_markdown(text)):
        if s.context and chunking.count_words(s.context) >= most:
            continue
        found = chunking.pack(s, most, 0)
        assert " ".join(c.content for c in found) == " ".join(s.units)
        assert all(chunking.count_words(c.content) <= most for c in chunking.pack(s, most, min(overlap, most - 1)) if " " in c.content.strip())


@settings(max_examples=150, deadline=None)
@given(texts)
def test_masks_are_apart_and_inside(text):
    spans = masking.find(text)
    assert all(a.end <= b.start for a, b in zip(spans, spans[1:], strict=False)) and all(text[s.start : s.end] == s.text for s in spans)
    masking.apply(text, spans)
    parse_srt(text)
    parse_tagged(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["O", "B-A", "I-A", "E-A", "S-A", "B-B", "I-B", "E-B", "S-B"]), max_size=8))
def test_repaired_tags_fit_together(tags):
    out = decode.repair_tags(tags)
    for before, after in zip(["O", *out], [*out, "O"], strict=True):
        assert (before[:1] in "BI") == (after[:1] in "IE") and (before[:1] not in "BI" or before[2:] == after[2:])
    assert decode.repair_tags(out) == out
