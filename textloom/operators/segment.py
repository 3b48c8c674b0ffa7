"""Segmentation by rule: paragraphs, sentences, tokens, and multi-word tokens, row by row.

A text becomes sentences of tokens with code-point offsets, as the readers of annotated files give them. The scorer of
a trained tokenizer can take the rule's place: anything that maps a paragraph to token spans and sentence ends.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.unicode import TOKEN_SPACE
from ..session import bounded_batches
from ..sources.documents import SENTENCE, Sentence, Token, Word, sentence_array

#: Where a paragraph ends.
BREAK = rf"\n[{TOKEN_SPACE}]*\n"
_BREAK = regex.compile(r"\n[\s\x1c-\x1f\x80-\x9f]*\n")
_SPACE = r"\s\x1c-\x1f\x80-\x9f"
MASKED = r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+|(?:https?://|www\.)[^\s<>\"]*[^\s<>\".,;:!?)\]]"
_PLAIN = rf"\p{{L}}[\p{{L}}\p{{M}}]*(?:['’]\p{{L}}+)*|\p{{N}}+(?:[.,]\p{{N}}+)*|([?!.])\1*|[^{_SPACE}]"
_TOKEN, _UNMASKED = regex.compile(rf"(?:{MASKED})|{_PLAIN}"), regex.compile(_PLAIN)
_END = regex.compile(r"[.!?…。！？]+$")
_CLOSING = frozenset("\"'’”»)]}")

#: Sentences a worker holds before it passes them on.
ROWS = 1024
#: A scorer: the spans of a paragraph's tokens, each with whether a sentence ends there.
Splitter = Callable[[str], list[tuple[int, int, bool]]]


def rule(paragraph: str) -> list[tuple[int, int, bool]]:
    """Tokens by pattern (e-mails and URLs whole); a sentence ends at closing punctuation before a blank and a capital, digit or quote."""
    # few paragraphs hold a literal that the masks need
    pattern = _TOKEN if "@" in paragraph or "http" in paragraph or "www." in paragraph else _UNMASKED
    spans = [m.span() for m in pattern.finditer(paragraph)]
    out = []
    for i, (a, b) in enumerate(spans):
        end = False
        if i + 1 == len(spans):
            end = True
        elif spans[i + 1][0] > b:
            j = i
            while j >= 0 and paragraph[spans[j][0] : spans[j][1]] in _CLOSING:
                j -= 1
            after = paragraph[spans[i + 1][0]]
            end = j >= 0 and bool(_END.search(paragraph[spans[j][0] : spans[j][1]])) and not after.islower()
        out.append((a, b, end))
    return out


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    """(start, paragraph) of the parts between blank lines, without white space at their ends; empty ones are left out."""
    at = 0
    for stop, begin in [*((m.start(), m.end()) for m in _BREAK.finditer(text)), (len(text), len(text))]:
        part = text[at:stop]
        bare = regex.sub(rf"^[{_SPACE}]+|[{_SPACE}]+$", "", part)
        if bare:
            yield at + part.index(bare), bare
        at = begin


def segment(text: str | None, split: Splitter = rule, ssplit: bool = True, max_token: int | None = None) -> list[Sentence]:
    """The sentences of a text. Without ssplit a paragraph is one sentence; a longer token than max_token reads <UNK>."""
    out: list[Sentence] = []
    for at, part in paragraphs(text or ""):
        tokens: list[Token] = []
        spans = split(part)
        for i, (a, b, end) in enumerate(spans):
            word = part[a:b] if max_token is None or b - a <= max_token else "<UNK>"
            tokens.append(Token(word, at + a, at + b, words=[Word(len(tokens) + 1, word, start_char=at + a, end_char=at + b)]))
            if i + 1 == len(spans) or ssplit and end:
                out.append(Sentence(str(len(out)), (text or "")[tokens[0].start_char : at + b], tokens=tokens))
                tokens = []
    mark_spaces(out, text or "")
    return out


def sentence_texts(text: str | None, split: Splitter = rule) -> list[str]:
    """The texts of segment(text)'s sentences, without their tokens."""
    out = []
    for _, part in paragraphs(text or ""):
        start = None
        for a, b, end in split(part):
            start = a if start is None else start
            if end:
                out.append(part[start:b])
                start = None
        if start is not None:
            out.append(part[start:b])
    return out


def mark_spaces(sentences: Iterable[Sentence], text: str) -> None:
    """space_after from the text between tokens, spaces_before for the first."""
    tokens = [t for s in sentences for t in s.tokens]
    for i, t in enumerate(tokens):
        t.space_after = text[t.end_char : tokens[i + 1].start_char if i + 1 < len(tokens) else len(text)]
    if tokens:
        tokens[0].spaces_before = text[: tokens[0].start_char]


def pretokenized(sentences: list[list[str]]) -> list[Sentence]:
    """Tokens as given, their text joined by blanks. An empty sentence or a blank token raises ValueError."""
    out, at = [], 0
    for i, words in enumerate(sentences):
        if not words or any(not w.strip() for w in words):
            raise ValueError(f"sentence {i} is empty or has a blank token")
        tokens = []
        for w in words:
            tokens.append(Token(w, at, at + len(w), words=[Word(len(tokens) + 1, w, start_char=at, end_char=at + len(w))]))
            at += len(w) + 1
        out.append(Sentence(str(i), " ".join(words), tokens=tokens))
    return out


def regrouped(sentences: list[Sentence], text: str, groups: list[list[tuple[str, list[str] | None]]]) -> list[Sentence]:
    """Sentences of a user's own tokens (text, expansion or None), each found in the text after the one before."""
    out, at = [], 0
    for i, group in enumerate(groups):
        if not group:
            raise ValueError(f"sentence {i} is empty")
        tokens = []
        for word, parts in group:
            start = text.find(word, at)
            if start < 0:
                raise ValueError(f"{word!r} is not in the text after {at}")
            at = start + len(word)
            t = Token(word, start, at)
            set_words(t, parts or [word])
            tokens.append(t)
        out.append(Sentence(str(i), text[tokens[0].start_char : at], tokens=tokens))
    mark_spaces(out, text)
    renumber(out)
    return out


def set_words(token: Token, words: list[str]) -> None:
    """The token's words; they get offsets only if they stand in the token one after another, blanks aside."""
    token.is_mwt = len(words) > 1
    m = regex.fullmatch(r"\s*".join(f"({regex.escape(w)})" for w in words), token.text)
    at = token.start_char
    token.words = [Word(i + 1, w, start_char=at + m.start(i + 1) if m and at is not None else None, end_char=at + m.end(i + 1) if m and at is not None else None) for i, w in enumerate(words)]


def renumber(sentences: Iterable[Sentence]) -> None:
    for s in sentences:
        for i, w in enumerate(s.words()):
            w.id = i + 1


def expansion(word: str, table: Mapping[str, list[str]]) -> list[str] | None:
    """The words of a multi-word token by a table: as written, all capitals, or with a capital."""
    if word in table:
        return table[word]
    low = table.get(word.lower())
    if low is None:
        return None
    if word.isupper():
        return [w.upper() for w in low]
    return [low[0][:1].upper() + low[0][1:], *low[1:]] if word[:1].isupper() else low


def expand(sentences: list[Sentence], table: Mapping[str, list[str]]) -> list[Sentence]:
    for s in sentences:
        for t in s.tokens:
            if parts := expansion(t.text, table):
                set_words(t, parts)
    renumber(sentences)
    return sentences


def annotated(docs: DataFrame, run: Callable[[str | None], list[Sentence]] = segment, key: str = "doc_id") -> DataFrame:
    """key, sent_idx, sentence of docs(key, text). Rows are mapped alone: neighbours never change a result."""
    out = f"{key} {docs.schema[key].dataType.simpleString()}, sent_idx int, sentence {SENTENCE}"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            places: list[int] = []
            held: list[Sentence] = []

            def flush(batch=batch, owner=owner, places=places, held=held) -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(places, pa.int32()), sentence_array(held)], names=[key, "sent_idx", "sentence"])
                for x in (owner, places, held):
                    x.clear()
                return out

            for n, t in enumerate(batch.column(1).to_pylist()):
                own = run(t)
                owner += [n] * len(own)
                places += range(len(own))
                held += own
                if len(held) >= ROWS:
                    yield flush()
            if held:
                yield flush()

    bounded_batches(docs.sparkSession)
    return docs.select(key, "text").mapInArrow(each, out)


def expanded_rows(docs: DataFrame, table: Mapping[str, list[str]], key: str = "doc_id") -> DataFrame:
    """annotated() with multi-word tokens expanded by a table."""
    return annotated(docs, lambda t: expand(segment(t), table), key)


def pretokenized_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sent_idx, sentence of docs(key, words array<array<string>>): tokens as given, in their order. An empty sentence or a blank token fails."""
    return annotated(docs.select(key, F.to_json("words").alias("text")), lambda t: pretokenized(json.loads(t)) if t else [], key)


def paragraph_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Paragraphs in the JVM: key, par_idx, paragraph."""
    parts = F.filter(F.transform(F.split("text", f"(?U){BREAK}"), lambda x: F.regexp_replace(x, f"(?U)^[{TOKEN_SPACE}]+|[{TOKEN_SPACE}]+$", "")), lambda x: x != "")
    return docs.select(key, F.posexplode(parts).alias("par_idx", "paragraph"))


def decoded(units: DataFrame, keys: Sequence[str], inner_spaces: bool = True, longest: int | None = None, ssplit: bool = True, enders: Sequence[str] = ()) -> DataFrame:
    """keys, sent_idx, token_idx, text, start, end, is_mwt from units(keys, place, char, label), gaps and islands in the JVM.

    A label of 1 or more ends a token at its unit, 2 and 4 a sentence too, 3 and 4 mark a multi-word token. White space
    before a token is not part of it and a token of white space alone is none; without inner_spaces (Chinese, Japanese,
    Korean) that within goes as well; a longer token than longest reads <UNK>; units among enders end sentences whatever
    their label; units after the last label belong to no token.
    """
    order = Window.partitionBy(*keys).orderBy("place")
    label = F.when(F.col("char").isin(*enders), F.lit(2)).otherwise(F.col("label")) if enders else F.col("label")
    u = units.withColumn("_l", label)
    u = u.withColumn("_t", F.coalesce(F.sum((F.col("_l") >= 1).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    solid = ~F.col("char").rlike(f"(?U)^[{TOKEN_SPACE}]$")
    tokens = u.groupBy(*keys, "_t").agg(F.min(F.when(solid, F.col("place"))).alias("start"), (F.max("place") + 1).alias("end"), F.max_by("_l", "place").alias("_l"), F.array_sort(F.collect_list(F.struct("place", "char"))).alias("_c"))
    tokens = tokens.where("start is not null and _l >= 1")
    chars = F.filter("_c", lambda x: x["place"] >= F.col("start"))
    if not inner_spaces:
        chars = F.filter(chars, lambda x: x["char"] != " ")
    text = F.array_join(F.transform(chars, lambda x: x["char"]), "")
    if longest is not None:
        text = F.when(F.length(text) > longest, F.lit("<UNK>")).otherwise(text)
    before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.coalesce(F.sum(F.col("_l").isin(2, 4).cast("int")).over(before), F.lit(0)) if ssplit else F.lit(0)
    placed = tokens.select(*keys, ends.cast("int").alias("sent_idx"), text.alias("text"), "start", "end", (F.col("_l") >= 3).alias("is_mwt"))
    place = F.row_number().over(Window.partitionBy(*keys, "sent_idx").orderBy("start")) - 1
    return placed.select(*keys, "sent_idx", place.alias("token_idx"), "text", "start", "end", "is_mwt")


def _tokens_and_gaps(paragraph: Column) -> Column:
    """Each token of a paragraph, by the rule's patterns, with the code points of it and of the white space after it."""
    masks = F.contains(paragraph, F.lit("@")) | F.contains(paragraph, F.lit("http")) | F.contains(paragraph, F.lit("www."))
    plain = _PLAIN.replace(r"([?!.])\1*", r"\?+|!+|\.+")
    lists = [F.when(masks, F.regexp_extract_all(paragraph, F.lit(f"(?U)((?:{MASKED})|{plain})[{TOKEN_SPACE}]*"), F.lit(k))).otherwise(F.regexp_extract_all(paragraph, F.lit(f"(?U)({plain})[{TOKEN_SPACE}]*"), F.lit(k))) for k in (1, 0)]
    return F.zip_with(*lists, lambda token, whole: F.struct(token.alias("token"), (F.length(whole) > F.length(token)).alias("gap")))


def sentence_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_sentences, n_tokens of docs(key, text), as annotated() would give them, folded where the row lies in the JVM.

    A sentence ends at closing punctuation, quotes and brackets after it aside, before a blank and what is no small letter.
    """
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(False).alias("live"), F.lit(False).alias("open"))

    def step(at: Column, x: Column) -> Column:
        ends = at["open"] & ~F.substring(x["token"], 1, 1).rlike(r"\p{IsLowercase}")
        live = F.when(x["token"].isin(*sorted(_CLOSING)), at["live"]).otherwise(F.substring(x["token"], -1, 1).isin(*".!?…。！？"))
        return F.struct((at["n"] + 1).alias("n"), (at["s"] + ends.cast("long")).alias("s"), live.alias("live"), (live & x["gap"]).alias("open"))

    parts = F.filter(F.transform(F.split("text", f"(?U){BREAK}"), lambda x: F.regexp_replace(x, f"(?U)^[{TOKEN_SPACE}]+|[{TOKEN_SPACE}]+$", "")), lambda x: x != "")
    folded = F.transform(parts, lambda p: F.aggregate(_tokens_and_gaps(p), start, step))
    total = F.aggregate(folded, F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct((a["s"] + x["s"] + 1).alias("s"), (a["n"] + x["n"]).alias("n")))
    return docs.select(key, total.alias("_t")).where("_t.s > 0").select(key, F.col("_t.s").alias("n_sentences"), F.col("_t.n").alias("n_tokens"))


def char_features(c: Column) -> Column:
    """For each code point: space_before, capitalized, numeric, start_of_para, end_of_para."""
    chars = F.split(c, "")
    n = F.size(chars)
    return F.transform(
        chars,
        lambda x, i: F.struct(
            x.alias("char"),
            F.coalesce(F.when(i > 0, F.get(chars, i - 1).rlike(f"(?U)[{TOKEN_SPACE}]")), F.lit(False)).alias("space_before"),
            x.rlike(r"\p{Lu}").alias("capitalized"),
            x.rlike(r"\p{N}").alias("numeric"),
            (i == 0).alias("start_of_para"),
            (i == n - 1).alias("end_of_para"),
        ),
    )


#: Shapes that a character classifier may see: fields with a label, telephone numbers, dates, amounts.
SHAPES = {
    "labeled_field": r"(?U)\b\p{L}[\p{L} ]{0,20}: ",
    "phone_id": r"\+?[0-9][0-9 ()./-]{6,}[0-9]",
    "date_pattern": r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4})\b",
    "currency": r"(?:[$€£¥] ?[0-9][0-9.,]*|[0-9][0-9.,]* ?(?:[$€£¥]|(?:kr|EUR|USD|SEK)\b))",
}


def shape_flags(c: Column) -> list[Column]:
    return [c.rlike(p).alias(name) for name, p in SHAPES.items()]


def lexicon_lengths(c: Column, lexicon: Column, longest: int = 8) -> Column:
    """For each code point: the length of the longest word of the lexicon (an array) that starts there, 0 if none."""
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array_max(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.when(F.array_contains(lexicon, F.substring(c, i, n)) & (i + n - 1 <= F.length(c)), n).otherwise(0))))


def register(spark: SparkSession) -> None:
    """segment_count(text) for SQL."""

    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(segment(t)) for t in texts.to_pylist()], pa.int32())

    count.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    spark.udf.register("segment_count", F.arrow_udf(count, "int"))
