"""Annotation of words by tables learned from annotated text, and the interface of any other scorer."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Scorer(Protocol):
    """What a decoder needs of a model: one score matrix for each sentence. Built once a worker, used batch by batch."""

    def load(self) -> None: ...

    def score(self, sentences: Sequence[Sequence[str]]) -> list[np.ndarray]: ...


#: Words of a learned table that may be broadcast; larger tables join by shuffle.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def lemma_table(words: DataFrame) -> DataFrame:
    """(upos, text, lemma): the most frequent lemma of each word and tag, and of each word under any tag (`*`)."""
    real = words.where("lemma is not null")
    both = real.select("upos", "text", "lemma").unionByName(real.select(F.lit("*").alias("upos"), "text", "lemma"))
    counted = both.groupBy("upos", "text", "lemma").agg(F.count("*").alias("n"))
    return counted.groupBy("upos", "text").agg(F.min(F.struct((-F.col("n")).alias("n"), "lemma")).alias("m")).select("upos", "text", "m.lemma")


def lemmatized(words: DataFrame, table: DataFrame, fallback: Callable[[Column], Column] | None = None, identity: bool = False) -> DataFrame:
    """words(text, upos, ...) with lemma: by tag and word, else by word, else the fallback, else the word itself."""
    if identity:
        return words.withColumn("lemma", F.nullif("text", F.lit("")))
    own = _small(table.where("upos <> '*'").select("upos", "text", F.col("lemma").alias("_by_tag")))
    any_ = _small(table.where("upos = '*'").select("text", F.col("lemma").alias("_by_word")))
    joined = words.drop("lemma").join(own, ["upos", "text"], "left").join(any_, "text", "left")
    last = fallback(F.col("text")) if fallback else F.col("text")
    chosen = F.coalesce("_by_tag", "_by_word", last, F.col("text"))
    kept = F.when((chosen == "_") & (F.col("text") != "_"), F.lit(None)).when((chosen == "") | (chosen == "<UNK>"), F.col("text")).otherwise(chosen)
    return joined.withColumn("lemma", kept).select(*[c for c in words.columns if c != "lemma"], "lemma")


def tag_table(words: DataFrame, suffix: int = 3) -> DataFrame:
    """(key, upos): the most frequent tag of each word in lower case, and of each ending (`-ing`), for words not seen."""
    low = F.lower("text")
    keys = F.array(low, F.concat(F.lit("-"), F.substring(low, -suffix, suffix)))
    counted = words.where("upos is not null").select(F.explode(keys).alias("key"), "upos").groupBy("key", "upos").agg(F.count("*").alias("n"))
    return counted.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "upos")).alias("m")).select("key", "m.upos")


def tagged(words: DataFrame, table: DataFrame, suffix: int = 3, default: str = "NOUN") -> DataFrame:
    """words with upos by word, then by ending, then the default. A labelled baseline, not a parser's tags."""
    t = _small(table)
    low = F.lower("text")
    keyed = words.drop("upos").withColumns({"_k": low, "_s": F.concat(F.lit("-"), F.substring(low, -suffix, suffix))})
    a = t.select(F.col("key").alias("_k"), F.col("upos").alias("_a"))
    b = t.select(F.col("key").alias("_s"), F.col("upos").alias("_b"))
    rest = [c for c in words.columns if c != "upos"]
    return keyed.join(a, "_k", "left").join(b, "_s", "left").select(*rest, F.coalesce("_a", "_b", F.lit(default)).alias("upos"))


def xpos_parts(c: Column, separator: str | None = None) -> Column:
    """A composite tag's parts: by separator, or character by character."""
    return F.split(c, f"\\Q{separator}\\E") if separator else F.filter(F.split(c, ""), lambda x: x != "")


def dependencies(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each word beside its head (null for the root): an equi self-join within a sentence."""
    heads = words.select(*keys, F.col("word_id").alias("head"), F.col("text").alias("head_text"), F.col("upos").alias("head_upos"))
    return words.join(heads, [*keys, "head"], "left")


def repeated_arguments(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Heads with more than one dependent of a group of which they keep one."""
    from .decode import ONCE

    group = F.lit(None).cast("string")
    for name, relations in ONCE.items():
        group = F.when(F.col("deprel").isin(*relations), F.lit(name)).otherwise(group)
    return words.withColumn("group", group).where("group is not null").groupBy(*keys, "head", "group").agg(F.count("*").alias("n")).where("n > 1")


def gazetteer(entities: DataFrame) -> DataFrame:
    """(text, type): the most frequent type of each entity text."""
    counted = entities.groupBy("text", "type").agg(F.count("*").alias("n"))
    return counted.groupBy("text").agg(F.min(F.struct((-F.col("n")).alias("n"), "type")).alias("m")).select("text", "m.type")


def entity_spans(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entities of BIOES tags in the JVM: keys, start_token, end_token (inclusive), type, text of tokens(keys, token_idx, token, ner).

    A B- or S- opens a span, as does an I- or E- after O, E- or S-; the last tag names the type; a tag of another shape
    does nothing.
    """
    mark = F.when(F.col("ner").rlike("^[BIES]-"), F.substring("ner", 1, 1)).otherwise(F.when(F.coalesce("ner", F.lit("O")) == "O", F.lit("O")))
    w = Window.partitionBy(*keys).orderBy("token_idx")
    live = tokens.withColumn("_m", mark).where("_m is not null").withColumn("_before", F.lag("_m", 1, "O").over(w))
    opens = F.col("_m").isin("B", "S") | F.col("_m").isin("I", "E") & F.col("_before").isin("O", "E", "S")
    spans = live.withColumn("_n", F.sum(opens.cast("int")).over(w)).where("_m <> 'O'")
    parts = F.array_sort(F.collect_list(F.struct("token_idx", "token")))
    out = spans.groupBy(*keys, "_n").agg(F.min("token_idx").alias("start_token"), F.max("token_idx").alias("end_token"), F.max_by(F.substring("ner", 3, 1000), "token_idx").alias("type"), parts.alias("_t"))
    return out.select(*keys, "start_token", "end_token", "type", F.array_join("_t.token", " ").alias("text"))


def routed(docs: DataFrame, processors: dict[str, Callable[[DataFrame], DataFrame]], lang: str = "lang") -> DataFrame:
    """docs through the function of their language; rows of other languages come back with nothing added. nb and no are one."""
    alias = {"nb": "no"}
    named = docs.withColumn("_l", F.coalesce(*[F.when(F.col(lang) == a, F.lit(b)) for a, b in alias.items()], F.col(lang)))
    known = {alias.get(k, k): f for k, f in processors.items()}
    out = named.where(~F.coalesce(F.col("_l").isin(*known), F.lit(False))).drop("_l")
    for k, f in known.items():
        out = out.unionByName(f(named.where(F.col("_l") == k).drop("_l")), allowMissingColumns=True)
    return out


def sentiment_table(sentences: DataFrame) -> DataFrame:
    """(term, label, weight): smoothed log-probabilities of words by label, from sentences(text, sentiment)."""
    counted = sentences.where("sentiment is not null").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("term"), F.col("sentiment").alias("label")).groupBy("term", "label").agg(F.count("*").alias("n"))
    totals = counted.groupBy("label").agg(F.sum("n").alias("total"), F.countDistinct("term").alias("types"))
    return counted.join(F.broadcast(totals), "label").select("term", "label", F.log((F.col("n") + 1) / (F.col("total") + F.col("types"))).alias("weight"))


def entity_sentiment(sentences: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and sentiment: the label whose words weigh most, 1 (neutral) where no word is known."""
    terms = sentences.select(*keys, F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("term"))
    scored = terms.join(_small(table), "term", "left").groupBy(*keys, "label").agg(F.sum(F.col("weight") + 12).alias("w"))
    return scored.groupBy(*keys).agg(F.max(F.when(F.col("label").isNotNull(), F.struct("w", (-F.col("label")).alias("l")))).alias("m")).select(*keys, F.coalesce(-F.col("m.l"), F.lit(1)).cast("int").alias("sentiment"))


def expanded(words: DataFrame, table: DataFrame) -> DataFrame:
    """words(text, ...) with parts: the words of a multi-word token by table(text, parts), null where it has none.

    A word is looked up as it is, else in lower case, when its parts take its capitals: all of them, or the first
    letter's. The table is broadcast if it is small.
    """
    t = table.groupBy("text").agg(F.min("parts").alias("parts"))
    own = _small(t.select(F.col("text").alias("_t"), F.col("parts").alias("_own")))
    low = _small(t.select(F.col("text").alias("_l"), F.col("parts").alias("_low")))
    joined = words.join(own, words["text"] == F.col("_t"), "left").join(low, F.lower(words["text"]) == F.col("_l"), "left")
    word = words["text"]
    capitals = (F.upper(word) == word) & (F.lower(word) != word)
    first = F.substring(word, 1, 1)
    opened = F.transform("_low", lambda x, i: F.when(i == 0, F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))).otherwise(x))
    cased = F.when(capitals, F.transform("_low", F.upper)).when((F.upper(first) == first) & (F.lower(first) != first), opened).otherwise(F.col("_low"))
    return joined.select(*[words[c] for c in words.columns], F.coalesce("_own", cased).alias("parts"))


def word_rows(expanded_words: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a word of expanded(): the parts, or the word itself, numbered from 1 within keys in the order of the tokens."""
    parts = F.coalesce("parts", F.array("text"))
    each = expanded_words.select(*keys, order, F.posexplode(parts).alias("_part", "word"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "_part"))
    return each.select(*keys, order, place.alias("word_id"), "word")


def looked_up(tokens: DataFrame, vocabulary: DataFrame, column: str = "text", unknown: int = 1) -> DataFrame:
    """tokens with id: of the token as it is, else in lower case, else unknown. vocabulary(entry, id)."""
    v = vocabulary.groupBy("entry").agg(F.min("id").alias("id"))
    own = _small(v.select(F.col("entry").alias("_o"), F.col("id").alias("_own")))
    low = _small(v.select(F.col("entry").alias("_l"), F.col("id").alias("_low")))
    kept = [tokens[c] for c in tokens.columns if c != "id"]
    joined = tokens.join(own, tokens[column] == F.col("_o"), "left").join(low, F.lower(tokens[column]) == F.col("_l"), "left")
    return joined.select(*kept, F.coalesce("_own", "_low", F.lit(unknown)).alias("id"))


def disambiguated(words: DataFrame, targets: Sequence[str], table: DataFrame, keys: Sequence[str], order: str = "word_id") -> DataFrame:
    """words with the lemma of each of the target words chosen by its neighbour's part of speech, from table(text, next_upos, lemma).

    A word that is no target, or whose case the table lacks, keeps its lemma.
    """
    after = F.lead("upos").over(Window.partitionBy(*keys).orderBy(order))
    named = words.withColumns({"_after": F.coalesce(after, F.lit("")), "_low": F.lower("text")})
    t = _small(table.select(F.col("text").alias("_low"), F.col("next_upos").alias("_after"), F.col("lemma").alias("_lemma")))
    joined = named.join(t, ["_low", "_after"], "left")
    return joined.withColumn("lemma", F.when(F.col("_low").isin(*targets), F.coalesce("_lemma", "lemma")).otherwise(F.col("lemma"))).select(*words.columns)


def neighbour_table(words: DataFrame, targets: Sequence[str], keys: Sequence[str], order: str = "word_id") -> DataFrame:
    """(text, next_upos, lemma): the most frequent lemma of each target word before each part of speech."""
    after = F.lead("upos").over(Window.partitionBy(*keys).orderBy(order))
    seen = words.select(F.lower("text").alias("text"), F.coalesce(after, F.lit("")).alias("next_upos"), "lemma").where(F.col("text").isin(*targets))
    counted = seen.groupBy("text", "next_upos", "lemma").agg(F.count("*").alias("n"))
    return counted.groupBy("text", "next_upos").agg(F.min(F.struct((-F.col("n")).alias("n"), "lemma")).alias("m")).select("text", "next_upos", "m.lemma")


def with_tags(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """words as they are; the query fails if a sentence has no upos and no xpos at all, as a parser that needs them would."""
    some = F.max((F.col("upos").isNotNull() | F.col("xpos").isNotNull()).cast("int")).over(Window.partitionBy(*keys))
    checked = F.when(some == 1, F.col("upos")).otherwise(F.raise_error(F.lit("a sentence has no tags")).cast("string"))
    return words.withColumn("upos", checked)
