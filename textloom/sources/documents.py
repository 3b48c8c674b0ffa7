"""The annotated document in Python, and its schema in Spark: sentences of tokens of words, all keyed by doc_id."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, fields

import pyarrow as pa
import pyarrow.compute as pc

WORD = "struct<id:int,empty_index:int,text:string,lemma:string,upos:string,xpos:string,feats:string,head:int,deprel:string,start_char:int,end_char:int,coref:string>"
TOKEN = f"struct<text:string,start_char:int,end_char:int,space_after:string,spaces_before:string,ner:string,is_mwt:boolean,words:array<{WORD}>>"
SENTENCE = f"struct<sent_id:string,text:string,constituency:string,sentiment:int,tokens:array<{TOKEN}>,empty:array<{WORD}>>"


@dataclass(slots=True)
class Word:
    id: int
    text: str
    lemma: str | None = None
    upos: str | None = None
    xpos: str | None = None
    feats: str | None = None
    head: int | None = None
    deprel: str | None = None
    start_char: int | None = None
    end_char: int | None = None
    coref: str | None = None
    empty_index: int | None = None


@dataclass(slots=True)
class Token:
    text: str
    start_char: int | None = None
    end_char: int | None = None
    space_after: str = " "
    spaces_before: str = ""
    ner: str | None = None
    is_mwt: bool = False
    words: list[Word] = field(default_factory=list)


@dataclass(slots=True)
class Sentence:
    sent_id: str | None = None
    text: str | None = None
    constituency: str | None = None
    sentiment: int | None = None
    tokens: list[Token] = field(default_factory=list)
    empty: list[Word] = field(default_factory=list)

    def words(self) -> list[Word]:
        return [w for t in self.tokens for w in t.words]

    def in_order(self):
        """(token or None, word): each word after its token, each empty word i.m after word i."""
        empty = sorted(self.empty, key=lambda w: (w.id, w.empty_index))
        at = 0
        while at < len(empty) and empty[at].id == 0:
            yield None, empty[at]
            at += 1
        for t in self.tokens:
            for w in t.words:
                yield t, w
                while at < len(empty) and empty[at].id == w.id:
                    yield None, empty[at]
                    at += 1
        for w in empty[at:]:
            yield None, w


@dataclass
class Entity:
    text: str
    type: str
    start_char: int | None
    end_char: int | None
    start_token: int
    end_token: int


def entities(sentence: Sentence, doc_text: str | None = None) -> list[Entity]:
    """Spans of the tokens' BIOES tags. An I- or E- without a B- opens a span; the last I- or E- names its type; a tag of another shape does nothing."""
    found, tokens = [], sentence.tokens
    start = end = -1
    kind = ""

    def close() -> None:
        nonlocal start
        if start >= 0:
            a, b = tokens[start].start_char, tokens[end].end_char
            inner = "".join(t.text + t.space_after for t in tokens[start:end]) + tokens[end].text
            found.append(Entity(doc_text[a:b] if doc_text is not None and a is not None and b is not None else inner, kind, a, b, start, end))
        start = -1

    for i, t in enumerate(tokens):
        tag = t.ner or "O"
        mark = tag[:2]
        if tag == "O":
            close()
        elif mark in ("B-", "S-"):
            close()
            start, end, kind = i, i, tag[2:]
            if mark == "S-":
                close()
        elif mark in ("I-", "E-"):
            start, end, kind = start if start >= 0 else i, i, tag[2:]
            if mark == "E-":
                close()
    close()
    return found


_WORD_TYPES = [("id", pa.int32()), ("empty_index", pa.int32()), ("text", pa.string()), ("lemma", pa.string()), ("upos", pa.string()), ("xpos", pa.string()), ("feats", pa.string()), ("head", pa.int32()), ("deprel", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("coref", pa.string())]
_TOKEN_TYPES = [("text", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("space_after", pa.string()), ("spaces_before", pa.string()), ("ner", pa.string()), ("is_mwt", pa.bool_())]
_SENTENCE_TYPES = [("sent_id", pa.string()), ("text", pa.string()), ("constituency", pa.string()), ("sentiment", pa.int32())]


def _columns(rows: Sequence, types: list[tuple[str, pa.DataType]]) -> dict[str, pa.Array]:
    return {name: pa.array([getattr(r, name) for r in rows], kind) for name, kind in types}


def _lists(rows: Sequence[list], values: pa.Array) -> pa.ListArray:
    offsets = [0]
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _struct(columns: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns))


def _words(rows: Sequence[list[Word]]) -> pa.ListArray:
    return _lists(rows, _struct(_columns([w for r in rows for w in r], _WORD_TYPES)))


def sentence_array(sentences: Sequence[Sentence]) -> pa.StructArray:
    """SENTENCE structs, column by column: no row is built as a dictionary."""
    tokens = [t for s in sentences for t in s.tokens]
    token_array = _struct(_columns(tokens, _TOKEN_TYPES) | {"words": _words([t.words for t in tokens])})
    return _struct(_columns(sentences, _SENTENCE_TYPES) | {"tokens": _lists([s.tokens for s in sentences], token_array), "empty": _words([s.empty for s in sentences])})


def _objects(kind: type, values: pa.StructArray, **made: Callable[[pa.Array], list]) -> list:
    """Objects of a dataclass from structs of its fields; made: how a field that is no plain value becomes a list."""
    columns = dict(zip((f.name for f in values.type), values.flatten(), strict=True))
    return [kind(*row) for row in zip(*(made.get(f.name, pa.Array.to_pylist)(columns[f.name]) for f in fields(kind)), strict=True)]


def _pieces(lists: pa.ListArray, items: Callable[[pa.Array], list]) -> list[list]:
    flat, out, at = items(lists.flatten()), [], 0
    for n in pc.fill_null(pc.list_value_length(lists), 0).to_pylist():
        out.append(flat[at : at + n])
        at += n
    return out


def sentences_of(values: pa.StructArray) -> list[Sentence]:
    """The sentences of SENTENCE structs, column by column: no row becomes a dictionary."""

    def words(lists: pa.ListArray) -> list[list[Word]]:
        return _pieces(lists, lambda x: _objects(Word, x))

    return _objects(Sentence, values, tokens=lambda lists: _pieces(lists, lambda x: _objects(Token, x, words=words)), empty=words)


#: Documents that become Python objects at once.
AT_ONCE = 32


def documents_of(rows: pa.ListArray) -> Iterator[list[Sentence]]:
    """Each document's sentences in order, from lists of struct<sent_idx, sentence>."""
    for at in range(0, len(rows), AT_ONCE):
        for own in _pieces(rows.slice(at, AT_ONCE), lambda x: list(zip(x.field("sent_idx").to_pylist(), sentences_of(x.field("sentence")), strict=True))):
            yield [s for _, s in sorted(own, key=lambda x: x[0])]
