"""Queries through white space, character features, span joins, pooling, chunk entities, personal data and numbered streams."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import unicode
from ..operators import chunking, pii, retrieval, segment, spans, subtitles
from ..session import shared_dir, spread
from ..sources import conllu, marked
from ..streaming import stream
from .annotated_queries import WORDS_SQL, words
from .text_queries import docs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Unicode white space as RE2 writes it.
_WS = r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@query(rf"SELECT doc_id, md5(regexp_replace(text, '[{_WS}\x80-\x9f]+', ' ', 'g')) AS spaced, md5(regexp_replace(replace(text, chr(10), ''), '[{_WS}\x80-\x9f]+', ' ', 'g')) AS joined FROM documents")
def token_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space as a tokenizer sees it: single blanks, or line breaks gone first."""
    md5 = lambda c: F.md5(c.cast("binary"))
    return docs(spark, sf_dir).select("doc_id", md5(unicode.token_space(F.col("text"))).alias("spaced"), md5(unicode.token_space(F.col("text"), skip_newline=True)).alias("joined"))


@query(r"""WITH c AS (SELECT c_custkey, c_name || ' ' || coalesce(c_mktsegment, '') || ' 7é' AS t FROM customer), x AS (SELECT c_custkey, t, unnest(range(1, length(t) + 1)) AS i FROM c)
SELECT c_custkey, count(*) AS n, count(*) FILTER (WHERE i > 1 AND substr(t, i - 1, 1) = ' ') AS after_space, count(*) FILTER (WHERE regexp_matches(substr(t, i, 1), '\p{Lu}')) AS capitals, count(*) FILTER (WHERE regexp_matches(substr(t, i, 1), '\p{N}')) AS digits,
  count(*) FILTER (WHERE i = 1) AS starts, count(*) FILTER (WHERE i = length(t)) AS ends FROM x GROUP BY c_custkey""")
def char_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a character classifier sees of every customer's name and segment, counted."""
    c = docs(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" "), F.coalesce("c_mktsegment", F.lit("")), F.lit(" 7é")).alias("t"))
    each = c.select("c_custkey", F.explode(segment.char_features(F.col("t"))).alias("f"))
    counts = [F.sum(F.col(f"f.{a}").cast("long")).alias(b) for a, b in (("space_before", "after_space"), ("capitalized", "capitals"), ("numeric", "digits"), ("start_of_para", "starts"), ("end_of_para", "ends"))]
    return each.groupBy("c_custkey").agg(F.count("*").alias("n"), *counts)


@query(r"""WITH t AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' Namn och ort: x' WHEN 1 THEN ' ring 070-123 45 67' WHEN 2 THEN ' den 2024-05-17 ja' WHEN 3 THEN ' för 125,50 kr nu' ELSE '' END AS text FROM documents)
SELECT doc_id, regexp_matches(text, '(^|[^\p{L}\p{N}_])\p{L}[\p{L} ]{0,20}: ') AS labeled_field, regexp_matches(text, '\+?[0-9][0-9 ()./-]{6,}[0-9]') AS phone_id, regexp_matches(text, '\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{2,4})\b') AS date_pattern,
  regexp_matches(text, '(?:[$€£¥] ?[0-9][0-9.,]*|[0-9][0-9.,]* ?(?:[$€£¥]|(kr|EUR|USD|SEK)([^\p{L}\p{N}_]|$)))') AS currency FROM t""")
def shape_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text holds a labelled field, a number like a telephone's, a date or an amount."""
    k = F.col("doc_id") % 5
    end = F.when(k == 0, " Namn och ort: x").when(k == 1, " ring 070-123 45 67").when(k == 2, " den 2024-05-17 ja").when(k == 3, " för 125,50 kr nu").otherwise("")
    return docs(spark, sf_dir).select("doc_id", F.concat("text", end).alias("text")).select("doc_id", *segment.shape_flags(F.col("text")))


@query(r"""WITH n AS (SELECT c_custkey, c_name || 'xabcde#' AS t FROM customer), x AS (SELECT c_custkey, t, unnest(range(1, length(t) + 1)) AS i FROM n)
SELECT c_custkey, i AS place, CAST(coalesce(list_max([k FOR k IN range(1, 9) IF i + k - 1 <= length(t) AND list_contains(['Cust', 'Customer', 'abc', 'abcd', '#', '0', '000'], substr(t, i, k))]), 0) AS INTEGER) AS longest FROM x""")
def lexicon_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest word of a lexicon at each place of every customer's name."""
    lexicon = F.array(*[F.lit(x) for x in ("Cust", "Customer", "abc", "abcd", "#", "0", "000")])
    t = F.concat("c_name", F.lit("xabcde#"))
    each = docs(spark, sf_dir, "customer").select("c_custkey", F.posexplode(segment.lexicon_lengths(t, lexicon)).alias("i", "longest"))
    return each.select("c_custkey", (F.col("i") + 1).cast("long").alias("place"), F.col("longest").cast("int").alias("longest"))


@query(rf"""WITH p AS (SELECT doc_id, list_filter([regexp_replace(regexp_replace(x, '^[{_WS}\x80-\x9f]+', ''), '[{_WS}\x80-\x9f]+$', '') FOR x IN string_split_regex(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\n[{_WS}\x80-\x9f]*\n')], lambda x: x <> '') AS ps FROM documents),
u AS (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p) SELECT doc_id, CAST(i - 1 AS INTEGER) AS par_idx, length(ps[i]) AS n_chars FROM u""")
def line_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of every document with each line a paragraph of its own."""
    spaced = docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n \n")))
    return segment.paragraph_rows(spaced).select("doc_id", "par_idx", F.length("paragraph").cast("long").alias("n_chars"))


@query(f"""WITH {WORDS_SQL} SELECT doc_id, CAST((word_id - 1) // 6 AS INTEGER) AS sent_idx, count(*) AS n, min((word_id - 1) % 6 + 1) AS first_id, CAST(max(end_char) - min(start_char) AS BIGINT) AS n_chars FROM a GROUP BY ALL""")
def pretokenized_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every turn as given tokens, six a sentence."""
    w = words(spark, sf_dir).groupBy("doc_id", F.floor((F.col("word_id") - 1) / 6).alias("s")).agg(F.array_sort(F.collect_list(F.struct("word_id", "text"))).alias("ws"))
    listed = w.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("s", F.col("ws.text").alias("ws")))).alias("ss")).select("doc_id", F.col("ss.ws").alias("words"))
    each = conllu.words(segment.pretokenized_rows(listed))
    return each.groupBy("doc_id", "sent_idx").agg(F.count("*").alias("n"), F.min("word_id").cast("long").alias("first_id"), (F.max("end_char") - F.min("start_char")).cast("long").alias("n_chars"))


_SPAN_SQL = f"{WORDS_SQL}, s AS (SELECT doc_id, word_id AS start, word_id + 2 AS \"end\" FROM a WHERE upos = 'PROPN'), c AS (SELECT doc_id, word_id AS start, word_id + 1 + word_id % 3 AS \"end\", text AS name FROM a WHERE word_id % 2 = 0)"


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    w = words(spark, sf_dir)
    s = w.where("upos = 'PROPN'").select("doc_id", F.col("word_id").alias("start"), (F.col("word_id") + 2).alias("end"))
    c = w.where("word_id % 2 = 0").select("doc_id", F.col("word_id").alias("start"), (F.col("word_id") + 1 + F.col("word_id") % 3).alias("end"), F.col("text").alias("name"))
    return w, s, c


@query(f"""WITH {_SPAN_SQL}, j AS (SELECT s.doc_id, s.start, s."end", c.name, row_number() OVER (PARTITION BY s.doc_id, s.start, s."end" ORDER BY least(s."end", c."end") - greatest(s.start, c.start) DESC, c.start) AS k FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND s.start < c."end" AND c.start < s."end")
SELECT doc_id, start, "end", name FROM j WHERE k = 1""")
def best_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with the name of the span that overlaps them most."""
    _, s, c = _spans(spark, sf_dir)
    return spans.best_cover(s, c, ["doc_id"], "name")


@query(f"""WITH {_SPAN_SQL} SELECT a.doc_id, a.word_id, s.start FROM a JOIN s ON s.doc_id = a.doc_id AND a.word_id >= s.start AND a.word_id < s."end" """)
def covered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words beside the spans that hold them."""
    w, s, _ = _spans(spark, sf_dir)
    return spans.covered(w.select("doc_id", "word_id"), s, ["doc_id"], "word_id").select("doc_id", "word_id", "start")


@query(f"""WITH {_SPAN_SQL}, f AS (SELECT *, CASE WHEN start < max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s)
SELECT doc_id, start, "end", CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS BIGINT) AS island FROM f""")
def span_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of overlapping spans."""
    return spans.islands(_spans(spark, sf_dir)[1], ["doc_id"]).select("doc_id", "start", "end", F.col("island").cast("long").alias("island"))


@query("""WITH m AS (SELECT label, i AS dim, avg(CAST(embedding[i] AS DOUBLE)) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i),
n AS (SELECT label, sqrt(sum(mean * mean)) AS size FROM m GROUP BY label) SELECT label, dim - 1 AS dim, round(mean / greatest(size, 1e-12), 6) AS x FROM m JOIN n USING (label)""")
def pooled_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of every label, of length one."""
    pooled = retrieval.pooled(docs(spark, sf_dir, "embeddings").select("label", "embedding"), ["label"], "embedding")
    return pooled.select("label", F.posexplode("embedding").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


_CHUNK_SQL = """c AS (SELECT s_suppkey AS k, 1 + s_suppkey % 7 AS n FROM supplier),
u AS (SELECT k, n, unnest(range(0, CAST(ceil(n / 2) AS BIGINT))) AS j FROM c)"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one header and 1 to 7 sentences of four words."""
    k = F.col("s_suppkey")
    each = F.transform(F.sequence(F.lit(1), (1 + k % 7).cast("int")), lambda i: F.concat(F.lit("Alpha number "), i, F.lit(" ends.")))
    return docs(spark, sf_dir, "supplier").select(k.alias("doc_id"), F.concat(F.lit("# Part "), k, F.lit("\n\n"), F.array_join(each, " ")).alias("text"))


@query(f"""WITH {_CHUNK_SQL} SELECT k AS doc_id, CAST(j AS INTEGER) AS chunk_idx, '# Part ' || k AS context, 'Alpha number ' || (2 * j + 1) || ' ends.' || CASE WHEN 2 * j + 2 <= n THEN ' Alpha number ' || (2 * j + 2) || ' ends.' ELSE '' END AS content FROM u""")
def chunked_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections packed into chunks of twelve words, header included."""
    return chunking.chunks(_sections(spark, sf_dir), 12)


@query(f"""WITH {_CHUNK_SQL}, e AS (SELECT k, j, unnest(list_distinct(['Part ' || k, 'Alpha'])) AS entity FROM u)
SELECT entity, count(*) AS n FROM e GROUP BY entity ORDER BY n DESC, entity LIMIT 12""")
def chunk_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names that most chunks hold, in context or content: a report of twelve."""
    import re

    rows = chunking.enriched(chunking.chunks(_sections(spark, sf_dir), 12), re.compile(r"Part [0-9]+|Alpha").findall)
    return retrieval.most_named(rows)


@query(f"""WITH {_CHUNK_SQL} SELECT k AS doc_id, CAST(j AS INTEGER) AS chunk_idx FROM u WHERE k = 3""")
def chunks_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that name one thing."""
    import re

    rows = chunking.enriched(chunking.chunks(_sections(spark, sf_dir), 12), re.compile(r"Part [0-9]+|Alpha").findall)
    return retrieval.having(rows, "Part 3").select("doc_id", "chunk_idx")


@query(r"""WITH b AS (SELECT c_custkey AS k, 1 + c_custkey % 12 AS mo, 1 + c_custkey % 28 AS da, '80' || lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS nine FROM customer),
d AS (SELECT *, CAST((10 - list_sum([CASE WHEN x > 9 THEN x - 9 ELSE x END FOR x IN [CAST(nine[i] AS INTEGER) * (1 + i % 2) FOR i IN range(1, 10)]]) % 10) % 10 AS INTEGER) AS digit FROM b),
p AS (SELECT *, CASE WHEN k % 3 = 0 THEN (digit + 1) % 10 ELSE digit END AS last, ['ABC', 'MLB', 'SEK'][k % 3 + 1] || ' ' || (100 + k % 900) AS plate, (1 + k % 80) AS house, lpad(CAST(100 + k % 880 AS VARCHAR), 3, '0') || ' ' || lpad(CAST(10 + k % 80 AS VARCHAR), 2, '0') AS code FROM d),
t AS (SELECT *, nine[1:6] || '-' || nine[7:9] || last AS pnr FROM p),
o AS (SELECT *, 13 AS a1, 13 + length(pnr) + 8 AS a2 FROM t), q AS (SELECT *, a2 + length(plate) + 13 AS a3, 'Storgatan ' || house AS street FROM o), r AS (SELECT *, a3 + length(street) + 2 AS a4 FROM q),
z AS (SELECT *, a4 + length(code) + 19 AS a5, da || ' maj 19' || (50 + k % 40) AS born FROM r)
SELECT k AS doc_id, a1 AS start, a1 + length(pnr) AS "end", 'SE_PERSONNUMMER' AS kind, pnr AS text, 1.0 AS score FROM z WHERE k % 3 <> 0
UNION ALL SELECT k, a2, a2 + length(plate), 'SE_VEHICLE_REGISTRATION', plate, 0.65 FROM z WHERE plate[1:3] <> 'SEK'
UNION ALL SELECT k, a3, a3 + length(street), 'ADDRESS', street, 0.95 FROM z
UNION ALL SELECT k, a4, a4 + length(code), 'SE_POSTNUMMER', code, 0.95 FROM z
UNION ALL SELECT k, a5, a5 + length(born), 'DATE_OF_BIRTH', born, 1.0 FROM z""")
def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in a letter for every customer: numbers of persons (every third invalid) and cars, addresses and days of birth."""
    k = F.col("c_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    nine = F.concat(F.lit("80"), two(1 + k % 12), two(1 + k % 28), F.lpad((k % 1000).cast("string"), 3, "0"))
    digit = lambda i: F.substring(nine, i, 1).cast("int") * (1 + i % 2)
    total = sum((F.when(digit(i) > 9, digit(i) - 9).otherwise(digit(i)) for i in range(1, 10)), F.lit(0))
    check = (10 - total % 10) % 10
    pnr = F.concat(F.substring(nine, 1, 6), F.lit("-"), F.substring(nine, 7, 3), F.when(k % 3 == 0, (check + 1) % 10).otherwise(check))
    plate = F.concat(F.get(F.array(*[F.lit(x) for x in ("ABC", "MLB", "SEK")]), (k % 3).cast("int")), F.lit(" "), 100 + k % 900)
    code = F.concat(F.lpad((100 + k % 880).cast("string"), 3, "0"), F.lit(" "), two(10 + k % 80))
    born = F.concat(1 + k % 28, F.lit(" maj 19"), 50 + k % 40)
    text = F.concat(F.lit("Personnummer "), pnr, F.lit(". Bilen "), plate, F.lit(", gatuadress Storgatan "), 1 + k % 80, F.lit(", "), code, F.lit(" Umeå. Hon är född "), born, F.lit("."))
    # one file of few row groups, and much work a row
    return pii.find_pii(spread(docs(spark, sf_dir, "customer").select("c_custkey")).select(k.alias("doc_id"), text.alias("text")), today=datetime.date(2025, 1, 1))


@query("""SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS running_id FROM conversations""")
def stream_running_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns read as a stream, with numbers that run on from batch to batch."""
    turns = spark.readStream.schema(docs(spark, sf_dir, "conversations").schema).parquet(f"{sf_dir}/conversations*.parquet").select("conv_id", "turn")
    out = f"{shared_dir(spark)}/numbered-{uuid.uuid4().hex}"
    stream.numbered(turns, ["conv_id", "turn"], "running_id", out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).select("conv_id", "turn", "running_id")


@query(r"""WITH s AS (SELECT s_suppkey AS k, 1 + s_suppkey % 4 AS n FROM supplier), u AS (SELECT k, n, unnest(range(0, n)) AS i FROM s)
SELECT k, CAST(3 * i + 0 AS INTEGER) AS place, 'header' AS kind, '## Part ' || i || ' ##' AS text, 2 AS level FROM u UNION ALL SELECT k, 3 * i + 1, 'paragraph', 'Words of ' || k, 0 FROM u UNION ALL SELECT k, 3 * i + 2, 'table', '| a | ' || i || ' |', 0 FROM u""")
def markdown_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, paragraphs and tables of Markdown texts, a row each."""
    k = F.col("s_suppkey")
    parts = F.transform(F.sequence(F.lit(0), (k % 4).cast("int")), lambda i: F.concat(F.lit("## Part "), i, F.lit(" ##\nWords of "), k, F.lit("\n\n| a | "), i, F.lit(" |\n\n")))
    texts = docs(spark, sf_dir, "supplier").select(k.alias("k"), F.array_join(parts, "").alias("value"))
    return marked.element_rows(texts, "k").select("k", "place", "kind", "text", "level")


_SENTENCE_END = "[.!?…。！？]"
_TOKEN_SQL = r"\p{L}[\p{L}\p{M}]*(?:[''’]\p{L}+)*|\p{N}+(?:[.,]\p{N}+)*|\?+|!+|\.+|[^" + _WS + r"\x80-\x9f]"
_MASK_SQL = r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+|(?:https?://|www\.)[^" + _WS + r"<>\"]*[^" + _WS + r"<>\".,;:!?)\]]"


@query(rf"""WITH p AS (SELECT doc_id, list_filter([regexp_replace(regexp_replace(x, '^[{_WS}\x80-\x9f]+', ''), '[{_WS}\x80-\x9f]+$', '') FOR x IN string_split_regex(coalesce(text, ''), '\n[{_WS}\x80-\x9f]*\n')], lambda x: x <> '') AS ps FROM documents),
q AS (SELECT doc_id, ps[i] AS par, i AS par_no FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)),
k AS (SELECT doc_id, par_no, unnest(regexp_extract_all(par, '(?:{_MASK_SQL}|{_TOKEN_SQL})[{_WS}\x80-\x9f]*')) AS piece, unnest(range(1, 1 + len(regexp_extract_all(par, '(?:{_MASK_SQL}|{_TOKEN_SQL})[{_WS}\x80-\x9f]*')))) AS i FROM q),
m AS (SELECT *, regexp_replace(piece, '[{_WS}\x80-\x9f]+$', '') AS tok, regexp_matches(piece, '[{_WS}\x80-\x9f]$') AS gap FROM k),
e AS (SELECT *, CASE WHEN tok IN ('"', '''', '’', '”', '»', ')', ']', '}}') THEN NULL ELSE regexp_matches(tok, '{_SENTENCE_END}$') END AS closes, lead(tok) OVER (PARTITION BY doc_id, par_no ORDER BY i) AS after FROM m),
f AS (SELECT *, coalesce(last_value(closes IGNORE NULLS) OVER (PARTITION BY doc_id, par_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS live FROM e)
SELECT doc_id, count(*) FILTER (WHERE after IS NULL OR gap AND live AND NOT regexp_matches(after, '^[\p{{Ll}}ªº]')) AS n_sentences, count(*) AS n_tokens FROM f GROUP BY doc_id""")
def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and tokens of every document by the rule tokenizer, counted in the JVM."""
    from ..session import spread

    return segment.sentence_counts(spread(docs(spark, sf_dir).select("doc_id", "text")))


@query(r"""WITH c AS (SELECT conv_id * 1000 + turn AS doc_id, text, unnest(range(0, length(text))) AS place FROM conversations),
u AS (SELECT doc_id, place, text[place + 1] AS ch, CASE WHEN text[place + 1] = ';' THEN 2 WHEN place + 1 = length(text) OR text[place + 2] = ' ' AND place % 3 > 0 THEN CASE WHEN text[place + 1] = '.' THEN 2 WHEN place % 7 = 0 THEN 3 ELSE 1 END ELSE 0 END AS label FROM c),
t AS (SELECT *, coalesce(sum(CASE WHEN label >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tok FROM u),
g AS (SELECT doc_id, tok, min(CASE WHEN NOT regexp_matches(ch, '^[\s\x1c-\x1f\x80-\x9f]$') THEN place END) AS start, max(place) + 1 AS "end", max_by(label, place) AS label FROM t GROUP BY ALL),
k AS (SELECT g.doc_id, g.tok, g.start, g."end", g.label, string_agg(ch, '' ORDER BY place) FILTER (WHERE place >= g.start AND ch <> ' ') AS text FROM g JOIN t ON t.doc_id = g.doc_id AND t.tok = g.tok WHERE g.start IS NOT NULL AND g.label >= 1 GROUP BY ALL),
s AS (SELECT *, coalesce(sum(CASE WHEN label IN (2, 4) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_idx FROM k)
SELECT doc_id, CAST(sent_idx AS INTEGER) AS sent_idx, CAST(row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY start) - 1 AS INTEGER) AS token_idx, CASE WHEN length(text) > 12 THEN '<UNK>' ELSE text END AS text, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", label >= 3 AS is_mwt FROM s""")
def decoded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and sentences from a label for each character of every turn; blanks within tokens go, long ones are unknown."""
    c = docs(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.posexplode(F.split("text", "")).alias("place", "char"), F.col("text"))
    after = F.substring(F.col("text"), F.col("place") + 2, F.lit(1))
    last = (F.col("place") + 1 == F.length("text")) | ((after == " ") & (F.col("place") % 3 > 0))
    label = F.when(last, F.when(F.col("char") == ".", 2).when(F.col("place") % 7 == 0, 3).otherwise(1)).otherwise(0)
    return segment.decoded(c.where("char <> ''").select("doc_id", "place", "char", label.alias("label")), ["doc_id"], inner_spaces=False, longest=12, enders=(";",))


@query(rf"""WITH {WORDS_SQL}, l AS (SELECT doc_id, word_id, text, '<Word id=' || word_id || ';text=' || text || ';lemma=' || lemma || ';upos=' || upos || ';head=' || head || ';deprel=' || deprel || '>' AS line,
  '(' || chr(39) || text || chr(39) || ', ' || head || ', ' || chr(39) || deprel || chr(39) || ')' AS dep FROM a)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY word_id)) AS words, md5(string_agg('<Token id=' || word_id || ';words=[' || line || ']>', chr(10) ORDER BY word_id)) AS tokens, md5(string_agg(dep, chr(10) ORDER BY word_id)) AS dependencies
FROM l GROUP BY doc_id HAVING NOT bool_or(contains(text, chr(39)) OR contains(text, chr(92)))""")
def pretty_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, tokens and dependencies of every turn written out, but for turns with quotes, which Python writes in its own way."""
    s = conllu.from_words(words(spark, sf_dir)).where(~F.col("sentence.text").rlike(r"['\\]"))
    md5 = lambda c: F.md5(c.cast("binary"))
    x = F.col("sentence")
    return s.select("doc_id", md5(conllu.words_string(x)).alias("words"), md5(conllu.tokens_string(x)).alias("tokens"), md5(conllu.dependencies_string(x)).alias("dependencies"))


@query(f"""WITH {WORDS_SQL} SELECT doc_id, word_id, CASE WHEN h = 0 THEN 0 WHEN deprel = 'case' THEN 8 WHEN deprel IN ('det', 'amod') AND word_id < h THEN 10 ELSE 0 END AS cost FROM (SELECT *, CASE WHEN word_id % 3 = 0 THEN word_id + 1 ELSE head END AS h FROM a)""")
def break_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a break between every word and its head would cost."""
    w = words(spark, sf_dir).withColumn("head", F.when(F.col("word_id") % 3 == 0, F.col("word_id") + 1).otherwise(F.col("head")))
    return subtitles.relation_costs(w).select("doc_id", "word_id", "cost")


@query(f"""WITH {_CHUNK_SQL} SELECT k AS doc_id, CAST(j AS INTEGER) AS chunk_idx, k AS query_id, 1.0 AS score FROM u WHERE j = 0 AND k % 20 = 1""")
def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks stored with their vectors, and the nearest of each of some of them: itself."""
    rows = chunking.chunks(_sections(spark, sf_dir), 12).withColumn("id", F.col("doc_id") * 100 + F.col("chunk_idx"))
    path, vector = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", retrieval.hashed_terms(4096)
    retrieval.store(rows, path, vector(F.concat_ws(" ", "context", "content")))
    queries = spark.read.parquet(path).where("chunk_idx = 0 and doc_id % 20 = 1").select(F.col("doc_id").alias("query_id"), "embedding")
    return retrieval.search_store(queries, path, "id", 1).select("doc_id", "chunk_idx", "query_id", F.round("score", 3).alias("score"))
