"""CoNLL-U: a reader and a writer of its ten columns, and DataFrames of files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.unicode import bounded_udf
from ..session import bounded_batches
from . import trees
from .documents import AT_ONCE, SENTENCE, WORD, Sentence, Token, Word, documents_of, sentence_array, sentences_of

#: Sentences, and words, that a worker holds before it passes them on.
ROWS, WORDS = 1024, 16_384
_ESCAPES = {" ": "\\s", "\t": "\\t", "\r": "\\r", "\n": "\\n", "|": "\\p", "\\": "\\\\", " ": "\\u00A0"}
_UNESCAPES = {v: k for k, v in _ESCAPES.items()}
_ESCAPED = re.compile(r"\\u00A0|\\[strnp\\]")


def escape_space(space: str) -> str:
    return "".join(_ESCAPES.get(c, c) for c in space)


def unescape_space(space: str) -> str:
    return _ESCAPED.sub(lambda m: _UNESCAPES[m[0]], space)


def escape_space_column(c: Column) -> Column:
    for k, v in sorted(_ESCAPES.items(), key=lambda x: x[0] != "\\"):
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def sort_feats(feats: str | None) -> str | None:
    return None if feats is None else "|".join(sorted(feats.split("|"), key=str.lower))


def sort_feats_column(c: Column) -> Column:
    parts = F.transform(F.split(c, r"\|"), lambda x: F.struct(F.lower(x).alias("k"), x.alias("v")))
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x["v"]), "|")


def parse_misc(misc: str) -> dict:
    """space_after, spaces_before, start_char, end_char, ner, coref; unknown keys are left out."""
    out: dict = {"space_after": " ", "spaces_before": "", "start_char": None, "end_char": None, "ner": None, "coref": None}
    for piece in [] if misc == "_" else misc.split("|"):
        key, eq, value = piece.partition("=")
        if not eq:
            continue
        if key == "SpaceAfter" and value == "No":
            out["space_after"] = ""
        elif key == "SpacesAfter":
            out["space_after"] = unescape_space(value)
        elif key == "SpacesBefore":
            out["spaces_before"] = unescape_space(value)
        elif key in ("start_char", "end_char"):
            out[key] = int(value)
        elif key == "ner":
            out["ner"] = value
        elif key == "coref_chains":
            out["coref"] = value
    return out


def format_misc(space_after: str = " ", spaces_before: str = "", start: int | None = None, end: int | None = None, ner: str | None = None, coref: str | None = None) -> str:
    pieces = []
    if space_after != " ":
        pieces.append("SpacesAfter=" + escape_space(space_after) if space_after else "SpaceAfter=No")
    if spaces_before:
        pieces.append("SpacesBefore=" + escape_space(spaces_before))
    pieces += [f"{k}={v}" for k, v in (("start_char", start), ("end_char", end), ("ner", ner), ("coref_chains", coref)) if v is not None and v != ""]
    return "|".join(pieces) or "_"


def _field(value: str) -> str | None:
    return None if value == "_" else value


def read(text: str) -> list[Sentence]:
    """The sentences of a file. A line that has not ten columns raises ValueError."""
    out: list[Sentence] = []
    sentence: Sentence | None = None
    range_, range_end = None, 0
    for line in text.split("\n"):
        line = line.rstrip("\r")
        if not line:
            sentence = None
            continue
        if sentence is None:
            sentence = Sentence()
            out.append(sentence)
        if line[0] == "#":
            key, eq, value = line[1:].partition(" = ")
            key = key.strip()
            if eq and key in ("text", "sent_id"):
                setattr(sentence, key, value)
            elif eq and key == "constituency":
                sentence.constituency = trees.write(trees.parse(value))
            elif eq and key == "sentiment":
                sentence.sentiment = int(value)
            continue
        cols = line.split("\t")
        if len(cols) != 10:
            raise ValueError(f"not ten columns: {line}")
        misc = parse_misc(cols[9])
        own = {k: misc[k] for k in ("start_char", "end_char", "space_after", "spaces_before", "ner")}
        first, dash, last = cols[0].partition("-")
        if dash:
            range_, range_end = Token(cols[1], is_mwt=True, **own), int(last)
            sentence.tokens.append(range_)
            continue
        number, dot, sub = cols[0].partition(".")
        word = Word(int(number), cols[1], cols[2] if cols[1] == "_" else _field(cols[2]), *(_field(c) for c in cols[3:6]), None if cols[6] == "_" else int(cols[6]), _field(cols[7]), misc["start_char"], misc["end_char"], misc["coref"], int(sub) if dot else None)
        if dot:
            sentence.empty.append(word)
        elif range_ is not None and word.id <= range_end:
            range_.words.append(word)
            range_ = None if word.id == range_end else range_
        else:
            sentence.tokens.append(Token(cols[1], words=[word], **own))
    return out


def _line(w: Word, number: str, head: str, misc: str) -> str:
    return "\t".join([number, w.text, w.lemma or "_", w.upos or "_", w.xpos or "_", sort_feats(w.feats) or "_", head, w.deprel or "_", "_", misc])


def write(sentences: list[Sentence]) -> str:
    """The file of these sentences: comments text, sent_id, constituency, sentiment; a word without head gets the one before it."""
    blocks = []
    for s in sentences:
        lines = []
        if s.text is not None:
            lines.append("# text = " + " ".join(s.text.split()))
        for key in ("sent_id", "constituency", "sentiment"):
            if getattr(s, key) is not None:
                lines.append(f"# {key} = {getattr(s, key)}")
        for t, w in s.in_order():
            if t is None:
                lines.append(_line(w, f"{w.id}.{w.empty_index}", "_" if w.head is None else str(w.head), format_misc(start=w.start_char, end=w.end_char, coref=w.coref)))
                continue
            if t.is_mwt and w is t.words[0]:
                lines.append("\t".join([f"{w.id}-{t.words[-1].id}", t.text, *"_" * 7, format_misc(t.space_after, t.spaces_before, t.start_char, t.end_char, t.ner)]))
            spacing = (" ", "") if t.is_mwt else (t.space_after, t.spaces_before)
            lines.append(_line(w, str(w.id), str(w.id - 1 if w.head is None else w.head), format_misc(*spacing, w.start_char, w.end_char, None if t.is_mwt else t.ner, w.coref)))
        blocks.append("".join(x + "\n" for x in lines))
    return "\n".join(blocks)


def sentences(files: DataFrame, key: str = "path", content: str = "value", reader=read) -> DataFrame:
    """key, sent_idx, sentence (a SENTENCE struct) of every sentence of files(key, content)."""
    kind = files.schema[key].dataType.simpleString()
    out = f"{key} {kind}, sent_idx int, sentence {SENTENCE}"

    def passed(batch: pa.RecordBatch, owner: list[int], places: list[int], held: list[Sentence]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(places, pa.int32()), sentence_array(held)], names=[key, "sent_idx", "sentence"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            places: list[int] = []
            held: list[Sentence] = []
            size = 0
            for n, t in enumerate([*batch.column(1).to_pylist(), None]):
                for k, s in enumerate(reader(t) if t else ()):
                    owner.append(n)
                    places.append(k)
                    held.append(s)
                    size += len(s.tokens)
                    if len(held) >= ROWS or size >= WORDS:
                        yield passed(batch, owner, places, held)
                        owner, places, held, size = [], [], [], 0
            if held:
                yield passed(batch, owner, places, held)

    bounded_batches(files.sparkSession)
    return files.select(key, content).mapInArrow(run, out)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sent_idx, sentence of every sentence of the files at path, one file a row of the scan."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return sentences(files)


def words(parsed: DataFrame) -> DataFrame:
    """One row a word, with its place, its token's text and its tag."""
    keep = [c for c in parsed.columns if c != "sentence"]
    toks = parsed.select(*keep, F.posexplode("sentence.tokens").alias("token_idx", "t"))
    return toks.select(*keep, "token_idx", F.col("t.text").alias("token"), F.col("t.ner").alias("ner"), F.explode("t.words").alias("w")).select(*keep, "token_idx", "token", "ner", *[F.col(f"w.{c}").alias({"id": "word_id"}.get(c, c)) for c in ("id", "text", "lemma", "upos", "xpos", "feats", "head", "deprel", "start_char", "end_char")])


def from_words(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sent_idx, sentence of rows(key, word_id, text, start_char, end_char, ...): words() backwards, in the JVM.

    Each key is one sentence of one-word tokens in the order of word_id, a blank between them; of a word's further fields
    (lemma, upos, xpos, feats, head, deprel, ner, coref) those that rows has are taken.
    """
    have = {c for c in rows.columns}
    pick = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
    word = F.struct(F.col("word_id").cast("int").alias("id"), F.lit(None).cast("int").alias("empty_index"), F.col("text"), *[pick(c, "string") for c in ("lemma", "upos", "xpos", "feats")], pick("head", "int"), pick("deprel", "string"), *[pick(c, "int") for c in ("start_char", "end_char")], pick("coref", "string"))
    token = F.struct(F.col("text"), *[pick(c, "int") for c in ("start_char", "end_char")], F.lit(" ").alias("space_after"), F.lit("").alias("spaces_before"), pick("ner", "string"), F.lit(False).alias("is_mwt"), F.array(word).alias("words"))
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("word_id", token.alias("t")))), lambda x: x["t"])
    whole = rows.groupBy(key).agg(tokens.alias("tokens"))
    fields = [F.lit(None).cast("string").alias("sent_id"), F.array_join("tokens.text", " ").alias("text"), F.lit(None).cast("string").alias("constituency"), F.lit(None).cast("int").alias("sentiment"), F.col("tokens"), F.array().cast(f"array<{WORD}>").alias("empty")]
    return whole.select(key, F.lit(0).alias("sent_idx"), F.struct(*fields).alias("sentence"))


def feats_map(c: Column) -> Column:
    return F.str_to_map(c, F.lit("\\|"), F.lit("="))


def rendered(parsed: DataFrame, key: str = "path", writer=write) -> DataFrame:
    """key, value: each document's sentences written in order."""

    def text(rows: pa.Array) -> pa.Array:
        return pa.array((writer(own) for own in documents_of(rows)), pa.string())

    return parsed.groupBy(key).agg(F.collect_list(F.struct("sent_idx", "sentence")).alias("_s")).select(key, bounded_udf(text, "string")(F.col("_s")).alias("value"))


def first_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, line, left, right, differing of two tables of files (path, value): the first line that differs and how many do."""

    def numbered(x: DataFrame, name: str) -> DataFrame:
        return x.select("path", F.posexplode(F.split("value", "\n")).alias("line", name))

    both = numbered(a, "left").join(numbered(b, "right"), ["path", "line"], "full").where(~F.col("left").eqNullSafe(F.col("right")))
    return both.groupBy("path").agg(F.min(F.struct("line", "left", "right")).alias("d"), F.count("*").alias("differing")).select("path", (F.col("d.line") + 1).alias("line"), "d.left", "d.right", "differing")


def _word_line(w: Column) -> Column:
    number = F.when(w["empty_index"].isNotNull(), F.concat(F.lit("("), w["id"], F.lit(", "), w["empty_index"], F.lit(")"))).otherwise(w["id"].cast("string"))
    fields = [F.concat(F.lit("id="), number), *(F.concat(F.lit(f"{c}="), w[c]) for c in ("text", "lemma", "upos", "xpos", "feats", "head", "deprel"))]
    return F.concat(F.lit("<Word "), F.concat_ws(";", *fields), F.lit(">"))


def words_string(sentence: Column) -> Column:
    """A sentence's words, a line each, with the fields that are set."""
    return F.array_join(F.transform(F.flatten(F.transform(sentence["tokens"], lambda t: t["words"])), _word_line), "\n")


def tokens_string(sentence: Column) -> Column:
    """A sentence's tokens, a line each, with their words."""

    def line(t: Column) -> Column:
        n = F.size(t["words"])
        first, last = F.get(t["words"], F.lit(0))["id"], F.get(t["words"], n - 1)["id"]
        number = F.when(n == 0, F.lit("")).when(n == 1, first.cast("string")).otherwise(F.concat(first, F.lit("-"), last))
        return F.concat(F.lit("<Token id="), number, F.lit(";words=["), F.array_join(F.transform(t["words"], _word_line), ", "), F.lit("]>"))

    return F.array_join(F.transform(sentence["tokens"], line), "\n")


def dependencies_string(sentence: Column) -> Column:
    """A sentence's dependencies, a tuple of text, head and relation a line; empty unless its words are numbered in order and all have a head and a relation. A head that is no word fails."""

    def lines(s: Sentence) -> str:
        own = s.words()
        if [w.id for w in own] != list(range(1, len(own) + 1)) or any(w.head is None or w.deprel is None for w in own):
            return ""
        if bad := [w for w in own if not 0 <= w.head <= len(own)]:
            raise ValueError(f"no word {bad[0].head}")
        return "\n".join(f"({w.text!r}, {w.head}, {w.deprel!r})" for w in own)

    def run(values: pa.Array) -> pa.Array:
        parts = (values.slice(at, AT_ONCE) for at in range(0, len(values), AT_ONCE))
        return pa.array((lines(s) if ok else None for x in parts for ok, s in zip(x.is_valid().to_pylist(), sentences_of(x), strict=True)), pa.string())

    return bounded_udf(run, "string")(sentence)
