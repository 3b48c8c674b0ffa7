"""Queries through the decoders, masking and its evaluation, name linking, coreference marks and the subtitle checker.

Their input is made from the tables by rules that SQL can repeat.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import unicode
from ..operators import constituency, coref, decode, linking, masking, subtitles
from ..sources import conllu
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


@query("""
WITH RECURSIVE c AS (SELECT c_custkey AS k, c_name AS s, length(c_name) AS n FROM customer),
r AS (SELECT k, s, n, 1 AS i, [CAST((ascii(s[1]) * (t + 3) + 7 * (t + 1)) % 11 AS INTEGER) FOR t IN [0, 1, 2]] AS tot, [[0], [1], [2]] AS paths FROM c
UNION ALL SELECT k, s, n, i + 1,
  [CAST(list_max([tot[f + 1] + (f * 5 + t * 3) % 7 - 3 FOR f IN [0, 1, 2]]) + (ascii(s[i + 1]) * (t + 3) + (i + 1) * 7 * (t + 1)) % 11 AS INTEGER) FOR t IN [0, 1, 2]],
  [list_append(paths[list_position([tot[f + 1] + (f * 5 + t * 3) % 7 - 3 FOR f IN [0, 1, 2]], list_max([tot[f + 1] + (f * 5 + t * 3) % 7 - 3 FOR f IN [0, 1, 2]]))], t) FOR t IN [0, 1, 2]]
  FROM r WHERE i < n)
SELECT k AS c_custkey, array_to_string(paths[list_position(tot, list_max(tot))], '') AS path FROM r WHERE i = n
""")
def viterbi_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tag path through the letters of every customer's name; ties go to the lowest tag."""
    letters = F.split("c_name", "")
    scores = F.transform(letters, lambda x, i: F.array(*[((F.ascii(x) * (t + 3) + (i + 1) * 7 * (t + 1)) % 11).cast("double") for t in range(3)]))
    transitions = np.array([[(f * 5 + t * 3) % 7 - 3 for t in range(3)] for f in range(3)], np.float64)
    path = decode.tag_paths(transitions)(scores)
    return docs(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.transform(path, lambda x: x.cast("string")), "").alias("path"))


_TAGS = ("O", "B-X", "I-X", "E-X", "S-X", "I-Y", "E-Y")


@query("""
WITH RECURSIVE c AS (SELECT c_custkey AS k, [['O', 'B-X', 'I-X', 'E-X', 'S-X', 'I-Y', 'E-Y'][CAST((c_custkey * 7919 + i * i * 31 + i * 17) % 97 % 7 + 1 AS INTEGER)] FOR i IN range(1, 13)] AS tags FROM customer),
r AS (SELECT k, tags, 0 AS i, CAST([] AS VARCHAR[]) AS done FROM c
UNION ALL SELECT k, tags, i + 1, list_append(done, CASE WHEN tags[i + 1][1:2] IN ('I-', 'E-') AND NOT (i > 0 AND done[i][1:2] IN ('B-', 'I-') AND done[i][3:] = tags[i + 1][3:]) THEN CASE tags[i + 1][1] WHEN 'I' THEN 'B-' ELSE 'S-' END || tags[i + 1][3:] ELSE tags[i + 1] END) FROM r WHERE i < 12)
SELECT k AS c_custkey, array_to_string(tags, ' ') AS tags, array_to_string([CASE WHEN done[i][1:2] IN ('B-', 'I-') AND NOT (i < 12 AND done[i + 1][1:2] IN ('I-', 'E-') AND done[i + 1][3:] = done[i][3:]) THEN CASE done[i][1] WHEN 'B' THEN 'S-' ELSE 'E-' END || done[i][3:] ELSE done[i] END FOR i IN range(1, 13)], ' ') AS repaired FROM r WHERE i = 12
""")
def repaired_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken BIOES tags made whole."""
    pick = lambda i: F.get(F.array(*[F.lit(t) for t in _TAGS]), ((F.col("c_custkey") * 7919 + i * i * 31 + i * 17) % 97 % 7).cast("int"))
    tags = F.transform(F.sequence(F.lit(1), F.lit(12)), pick)
    return docs(spark, sf_dir, "customer").select("c_custkey", F.array_join(tags, " ").alias("tags"), F.array_join(decode.repaired(tags), " ").alias("repaired"))


@query("""
WITH s AS (SELECT s_suppkey AS k, d, h, (k * 7919 + d * 10007 + h * 31337 + d * h * k * 97 + d * d * h * 1009) % 99991 AS w FROM supplier, range(1, 4) a(d), range(0, 4) b(h)),
t AS (SELECT x.k, x.h AS h1, y.h AS h2, z.h AS h3, x.w + y.w + z.w AS total FROM s x JOIN s y ON y.k = x.k AND y.d = 2 JOIN s z ON z.k = x.k AND z.d = 3 WHERE x.d = 1 AND x.h <> 1 AND y.h <> 2 AND z.h <> 3
  AND (CASE x.h WHEN 0 THEN 1 ELSE 0 END + CASE y.h WHEN 0 THEN 1 ELSE 0 END + CASE z.h WHEN 0 THEN 1 ELSE 0 END) = 1
  AND NOT (x.h = 2 AND y.h = 1) AND NOT (x.h = 3 AND z.h = 1) AND NOT (y.h = 3 AND z.h = 2))
SELECT k AS s_suppkey, h1 || ' ' || h2 || ' ' || h3 AS heads FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY total DESC) = 1
""")
def tree_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best tree with one root over three words, for every supplier's scores; the SQL tries all."""
    k = F.col("s_suppkey")
    weight = lambda d, h: ((k * 7919 + d * 10007 + h * 31337 + d * h * k * 97 + d * d * h * 1009) % 99991).cast("double")
    scores = F.array(*[F.array(*[weight(d, h) for h in range(4)]) for d in range(4)])
    heads = decode.tree_heads(scores)
    return docs(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(F.transform(F.slice(heads, 2, 3), lambda x: x.cast("string")), " ").alias("heads"))


@query("""SELECT vec_id, unnest(range(0, 5)) AS place, unnest(list_sort([struct_pack(s := -embedding[i], at := i - 1) FOR i IN range(1, 65)])[1:5]).at AS dim FROM embeddings""")
def top_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest dimensions of every vector, ties by place."""
    top = decode.top_places(5)(F.col("embedding"))
    return docs(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(top).alias("place", "dim")).select("vec_id", F.col("place").cast("long").alias("place"), F.col("dim").cast("long").alias("dim"))


@query(f"""WITH {WORDS_SQL} SELECT doc_id, word_id, CAST(CASE WHEN word_id < 5 THEN word_id - 1 WHEN word_id < 8 THEN 4 WHEN word_id < 16 THEN 5 WHEN word_id < 32 THEN 6 WHEN word_id < 64 THEN 7 ELSE 8 END AS INTEGER) AS bucket FROM a""")
def distance_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("doc_id", "word_id", decode.distance_buckets(F.col("word_id")).alias("bucket"))


@query(f"""WITH {WORDS_SQL}, s AS (SELECT doc_id, count(*) AS n, string_agg('(' || upos || ' ' || translate(text, '()', '[]') || ')', ' ' ORDER BY word_id) AS inner_text FROM a GROUP BY doc_id)
SELECT doc_id, 'shift S ' || repeat('shift ', n - 1) || 'close ROOT close' AS steps, '(ROOT (S ' || inner_text || '))' AS tree FROM s""")
def constituency_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transitions that build every turn's tree, and the tree that they build."""
    pair = F.struct(F.translate("text", "()", "[]").alias("word"), F.col("upos").alias("tag"))
    w = words(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word_id", pair.alias("p")))).alias("ps")).select("doc_id", F.col("ps.p").alias("words"))
    text = F.concat(F.lit("(ROOT (S "), F.array_join(F.transform("words", lambda x: F.concat(F.lit("("), x["tag"], F.lit(" "), x["word"], F.lit(")"))), " "), F.lit("))"))
    steps = w.select("doc_id", "words", constituency.transitions()(text).alias("steps"))
    return steps.select("doc_id", F.array_join("steps", " ").alias("steps"), constituency.built()(F.struct("words", "steps")).alias("tree"))


_NUMBER_SQL = """n AS (SELECT c_custkey AS k, 'k' || (c_custkey % 7) || '@a.se' AS m1, 'k' || (c_custkey % 5) || '@a.se' AS m2, '070-123 45 ' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS phone,
  '80' || lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || (c_custkey // 3 % 10) AS digits FROM customer),
l AS (SELECT *, list_sum([CASE WHEN x > 9 THEN x - 9 ELSE x END FOR x IN [CAST(digits[i] AS INTEGER) * (1 + i % 2) FOR i IN range(1, 11)]]) % 10 = 0 AS valid, digits[1:6] || '-' || digits[7:10] AS pnr FROM n)"""


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text: two e-mail addresses, a telephone number and a personal number, valid in some rows."""
    k = F.col("c_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    m1, m2 = (F.concat(F.lit("k"), k % n, F.lit("@a.se")) for n in (7, 5))
    pnr = F.concat(F.lit("80"), two(1 + k % 12), two(1 + k % 28), F.lit("-"), F.lpad((k % 1000).cast("string"), 3, "0"), F.floor(k / 3) % 10)
    text = F.concat(F.lit("Mejla "), m1, F.lit(" eller "), m2, F.lit(", ring 070-123 45 "), two(k % 100), F.lit(". Nummer: "), pnr, F.lit("; klart."))
    return docs(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text"))


@query(f"""WITH {_NUMBER_SQL} SELECT k AS doc_id, 'Mejla [EMAIL-1] eller [EMAIL-' || CASE WHEN m1 = m2 THEN 1 ELSE 2 END || '], ring [PHONE-1]. Nummer: ' || CASE WHEN valid THEN '[PNR-1]' ELSE pnr END || '; klart.' AS masked, CAST(CASE WHEN valid THEN 4 ELSE 3 END AS BIGINT) AS n_spans FROM l""")
def masked_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses, telephone numbers and valid personal numbers under numbered placeholders."""
    return masking.masked(_people(spark, sf_dir))


@query(f"""WITH {_NUMBER_SQL}, p AS (SELECT *, 6 AS a1, 6 + length(m1) + 7 AS a2 FROM l), q AS (SELECT *, a2 + length(m2) + 7 AS a3 FROM p), r AS (SELECT *, a3 + length(phone) + 10 AS a4 FROM q)
SELECT k AS doc_id, a1 AS start, a1 + length(m1) AS "end", 'EMAIL' AS type, 'email' AS source, m1 AS text FROM r UNION ALL SELECT k, a2, a2 + length(m2), 'EMAIL', 'email', m2 FROM r
UNION ALL SELECT k, a3, a3 + length(phone), 'PHONE', 'phone', phone FROM r UNION ALL SELECT k, a4, a4 + length(pnr), 'PNR', 'personnummer', pnr FROM r WHERE valid""")
def people_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.spans_of(_people(spark, sf_dir))


@query("""WITH m AS (SELECT c_custkey AS k, i, ['Anna', 'Bo', 'Anna', 'Dan'][i + 1] AS name, [0, 5, 8, 13][i + 1] AS a, [1, 2, 1, 3][i + 1] AS person, (c_custkey // CAST(pow(2, i) AS BIGINT)) % 2 = 1 AS hidden FROM customer, range(0, 4) r(i)),
x AS (SELECT k, max(CASE WHEN i = 0 THEN hidden END) AS h0, max(CASE WHEN i = 1 THEN hidden END) AS h1, max(CASE WHEN i = 2 THEN hidden END) AS h2, max(CASE WHEN i = 3 THEN hidden END) AS h3 FROM m GROUP BY k)
SELECT k AS doc_id, 4 AS gold, CAST(NOT h0 AS INTEGER) + CAST(NOT h1 AS INTEGER) + CAST(NOT h2 AS INTEGER) + CAST(NOT h3 AS INTEGER) AS leaked, CAST(h0 AS INTEGER) + CAST(h1 AS INTEGER) + CAST(h2 AS INTEGER) + CAST(h3 AS INTEGER) + 1 AS masks, 1 AS over_masked,
  1 AS same_pairs, CAST(h0 AND h2 AS INTEGER) AS same_agree, 5 AS other_pairs, 5 AS other_agree, 3 AS people, CAST(h0 AND h2 AS INTEGER) + CAST(h1 AS INTEGER) + CAST(h3 AS INTEGER) AS people_whole FROM x""")
def masking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of some of four names, and of a word that is none, held against labels."""
    names, starts, ids = ("Anna", "Bo", "Anna", "Dan"), (0, 5, 8, 13), ("1", "2", "1", "3")
    spans = [F.struct(F.lit(a).alias("start"), F.lit(a + len(n)).alias("end"), F.lit("PER").alias("type"), F.lit(i).alias("id"), F.lit(n).alias("text")) for n, a, i in zip(names, starts, ids, strict=True)]
    mask = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"), x["text"].alias("text"))
    hidden = [F.when(F.floor(F.col("c_custkey") / 2**i) % 2 == 1, mask(x)) for i, x in enumerate(spans)]
    extra = F.struct(F.lit(17).alias("start"), F.lit(20).alias("end"), F.lit("LOC").alias("type"), F.lit("och").alias("text"))
    d = docs(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("Anna Bo Anna Dan och").alias("text"), F.array(*spans).alias("gold"), F.filter(F.array(*hidden, extra), lambda x: x.isNotNull()).alias("masks"))
    return masking.evaluated(d)


@query("""SELECT measure, max(CASE WHEN run = 0 THEN v END) AS run_0, max(CASE WHEN run = 1 THEN v END) AS run_1, max(CASE WHEN run = 2 THEN v END) AS run_2 FROM (
SELECT o_orderstatus AS measure, o_custkey % 3 AS run, CAST(count(*) AS BIGINT) AS v FROM orders GROUP BY ALL) GROUP BY measure""")
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of runs side by side."""
    s = docs(spark, sf_dir, "orders").groupBy(F.concat(F.lit("run_"), F.col("o_custkey") % 3).alias("run"), F.col("o_orderstatus").alias("measure")).agg(F.count("*").alias("value"))
    return masking.report(s)


_NAMES = ("Anna Berg", "Bo Ek", "Cia Dahl", "Erik Falk")
_LINK_SQL = """n AS (SELECT c_custkey AS k, ['Anna', 'Bo', 'Cia', 'Erik'][c_custkey % 4 + 1] AS a, ['Berg', 'Ek', 'Dahl', 'Falk'][c_custkey % 4 + 1] AS b, ['Umeå', 'Lund'][c_custkey % 2 + 1] AS p FROM customer),
f AS (SELECT *, length(a) + 1 + length(b) AS full_len FROM n), g AS (SELECT *, full_len + 10 AS at_place, full_len + 10 + length(p) + 2 AS at_first FROM f), h AS (SELECT *, at_first + length(a) + 5 AS at_last FROM g)"""


@query(f"""WITH {_LINK_SQL} SELECT k AS doc_id, 0 AS start, full_len AS "end", 'PERSON' AS type, 1 AS person, false AS added FROM h
UNION ALL SELECT k, at_place, at_place + length(p), 'LOCATION', NULL, false FROM h UNION ALL SELECT k, at_first, at_first + length(a), 'PERSON', 1, true FROM h
UNION ALL SELECT k, at_last, at_last + length(b) + 1, 'PERSON', 1, true FROM h UNION ALL SELECT k, at_last + length(b) + 8, at_last + length(b) + 8 + length(p), 'LOCATION', NULL, true FROM h""")
def linked_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagged full name and place, and the mentions of them that the tagger missed."""
    k = F.col("c_custkey")
    at = lambda values, m: F.get(F.array(*[F.lit(v) for v in values]), (k % m).cast("int"))
    a, b, p = at([n.split()[0] for n in _NAMES], 4), at([n.split()[1] for n in _NAMES], 4), at(("Umeå", "Lund"), 2)
    text = F.concat(a, F.lit(" "), b, F.lit(" kom från "), p, F.lit(". "), a, F.lit(" och "), b, F.lit("s hus i "), p, F.lit("."))
    full = F.length(a) + F.length(b) + 1
    span = lambda s, e, t: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(t).alias("type"))
    spans = F.array(span(F.lit(0), full, "PERSON"), span(full + 10, full + 10 + F.length(p), "LOCATION"))
    return linking.linked(docs(spark, sf_dir, "customer").select(k.alias("doc_id"), text.alias("text"), spans.alias("spans")))


_CHAINS_SQL = f"""{WORDS_SQL}, m AS (SELECT doc_id, word_id % 3 AS chain, word_id - 1 AS start, word_id AS "end", lower(text) AS text FROM a WHERE upos = 'PROPN'
UNION ALL SELECT a.doc_id, 7, a.word_id - 1, a.word_id + 1, a.text || ' ' || b.text FROM a JOIN a b ON b.doc_id = a.doc_id AND b.word_id = a.word_id + 1 WHERE a.word_id % 4 = 1)"""


def _mentions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words, and mentions: each capitalized word in one of three chains, and pairs of words in another; a chain's first is its representative."""
    w = words(spark, sf_dir)
    one = w.where("upos = 'PROPN'").select("doc_id", (F.col("word_id") % 3).cast("int").alias("chain"), (F.col("word_id") - 1).alias("start"), F.col("word_id").alias("end"))
    last = Window.partitionBy("doc_id")
    two = w.withColumn("n", F.count("*").over(last)).where("word_id % 4 = 1 and word_id < n").select("doc_id", F.lit(7).alias("chain"), (F.col("word_id") - 1).alias("start"), (F.col("word_id") + 1).alias("end"))
    m = one.unionByName(two)
    return w, m.withColumn("is_representative", F.row_number().over(Window.partitionBy("doc_id", "chain").orderBy("start")) == 1)


@query(f"""WITH {_CHAINS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chain ORDER BY start) = 1 AS is_representative FROM m),
x AS (SELECT a.doc_id, a.word_id, r.chain, r.start, r."end", CASE WHEN r."end" - r.start = 1 THEN 'unit-' WHEN a.word_id - 1 = r.start THEN 'start-' ELSE 'end-' END || CASE WHEN is_representative THEN 'repr-' ELSE '' END || 'id' || chain AS mark FROM a JOIN r ON r.doc_id = a.doc_id AND a.word_id > r.start AND a.word_id <= r."end")
SELECT a.doc_id, a.word_id, string_agg(mark, ',' ORDER BY chain, start, "end") AS coref FROM a LEFT JOIN x ON x.doc_id = a.doc_id AND x.word_id = a.word_id GROUP BY a.doc_id, a.word_id""")
def coref_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marks of chains on the words they cover."""
    w, m = _mentions(spark, sf_dir)
    return coref.attached(w, m, ["doc_id"]).select("doc_id", "word_id", "coref")


@query(f"""WITH {_CHAINS_SQL.replace('lower(text) AS text', 'text')} SELECT doc_id, CAST(chain AS INTEGER) AS chain, first_value(text) OVER w AS representative_text, 0 AS sentence, start, "end", row_number() OVER w = 1 AS is_representative FROM m WINDOW w AS (PARTITION BY doc_id, chain ORDER BY start)""")
def coref_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains that a file's marks say, after writing and reading it."""
    w, m = _mentions(spark, sf_dir)
    files = conllu.rendered(conllu.from_words(coref.attached(w, m, ["doc_id"])), "doc_id")
    return coref.chains_of(conllu.sentences(files, "doc_id"))


@query("""WITH s AS (SELECT s_suppkey, 1 + s_suppkey % 9 AS size, 20 // (1 + s_suppkey % 9) AS per FROM supplier)
SELECT s_suppkey, unnest(range(0, CAST(ceil(30 / per) AS BIGINT))) * per * size AS start, least((unnest(range(0, CAST(ceil(30 / per) AS BIGINT))) + 1) * per, 30) * size AS "end" FROM s""")
def coref_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of at most twenty subwords over thirty sentences of equal size."""
    sizes = F.array_repeat((1 + F.col("s_suppkey") % 9).cast("int"), 30)
    w = docs(spark, sf_dir, "supplier").select("s_suppkey", F.explode(coref.size_windows(20)(sizes)).alias("w"))
    return w.select("s_suppkey", F.col("w.start").cast("long").alias("start"), F.col("w.end").cast("long").alias("end"))


_CUES_SQL = f"""{WORDS_SQL.replace("list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> '') AS ws", "list_filter(string_split_regex(translate(text, '<>{{}}-', '[]()~'), '[ \\t\\n]+'), lambda x: x <> '') AS ws").replace("['nsubj', 'det', 'obj', 'amod', 'case']", "['nsubj', 'case', 'obj', 'amod', 'det']")},
f AS (SELECT doc_id // 1000 AS conv_id, doc_id % 1000 AS turn, doc_id, word_id, text, deprel, length(text) AS n FROM a WHERE word_id <= 10),
b AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM f),
p AS (SELECT *, sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn, word_id) - n - 1 AS s FROM b WHERE k = 10)"""


def _cues(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two lines of five words of every turn with ten words, and their words with places in the transcript."""
    c = docs(spark, sf_dir, "conversations").withColumn("text", F.translate("text", "<>{}-", "[]()~"))
    ws = F.filter(F.split("text", r"[ \t\n]+"), lambda x: x != "")
    listed = c.select("conv_id", "turn", ws.alias("ws")).where(F.size("ws") >= 10)
    cues = listed.select("conv_id", F.col("turn").cast("int").alias("cue_idx"), F.array(F.array_join(F.slice("ws", 1, 5), " "), F.array_join(F.slice("ws", 6, 5), " ")).alias("lines"))
    w = listed.select("conv_id", F.col("turn").cast("int").alias("sent_idx"), F.posexplode(F.slice("ws", 1, 10)).alias("i", "text"))
    start = (F.sum(F.length("text") + 1).over(Window.partitionBy("conv_id").orderBy("sent_idx", "i")) - F.length("text") - 1).cast("int")
    relation = F.when(F.col("i") == 0, "root").otherwise(F.get(F.array(*[F.lit(r) for r in ("nsubj", "case", "obj", "amod", "det")]), (F.col("i") + 1) % 5))
    w = w.withColumns({"start_char": start, "word_id": F.col("i") + 1, "upos": F.lit("NOUN"), "head": F.col("i"), "deprel": relation})
    return cues, w.withColumn("end_char", F.col("start_char") + F.length("text"))


@query(f"""WITH {_CUES_SQL} SELECT conv_id, CAST(turn AS INTEGER) AS cue_idx, CAST((word_id - 1) // 5 AS INTEGER) AS line_idx, CAST(min(s) AS INTEGER) AS start, string_agg(text, ' ' ORDER BY word_id) AS text FROM p GROUP BY ALL""")
def cue_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of subtitles and their places in the transcript."""
    return subtitles.cue_lines(_cues(spark, sf_dir)[0], "conv_id").select("conv_id", "cue_idx", "line_idx", "start", "text")


_OPTIONS_SQL = f"""{_CUES_SQL}, g AS (SELECT conv_id, turn, min(s) AS s0, sum(n) + 9 AS size FROM p GROUP BY ALL),
o AS (SELECT p.conv_id, p.turn, p.word_id AS i, p.s + p.n - s0 AS len1, size - (p.s + p.n - s0) - 1 AS len2, p.text, q.deprel AS after, CASE WHEN q.deprel = 'case' THEN 8 ELSE 0 END AS torn, size FROM p JOIN g USING (conv_id, turn) JOIN p q ON q.doc_id = p.doc_id AND q.word_id = p.word_id + 1),
z AS (SELECT *, torn + abs(len1 - len2) / 4 + CASE WHEN len1 > len2 THEN 1 ELSE 0 END + CASE WHEN i IN (1, 9) THEN 3 ELSE 0 END + 5 * (greatest(0, len1 - 42) + greatest(0, len2 - 42)) - CASE WHEN right(text, 1) IN ('.', ',', ';', ':', '!', '?', '…') THEN 4 ELSE 0 END - CASE WHEN after = 'case' THEN 2 ELSE 0 END AS score FROM o),
best AS (SELECT conv_id, turn, i, torn, len1 FROM z QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score, i) = 1),
mid AS (SELECT conv_id, turn, torn FROM z QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY abs(2 * len1 - (size - 1)), i) = 1)"""


@query(f"""WITH {_OPTIONS_SQL} SELECT conv_id, CAST(count(*) AS INTEGER) AS cues, CAST(count(*) FILTER (WHERE own.torn > 0) AS INTEGER) AS own_flagged, CAST(count(*) FILTER (WHERE mid.torn > 0) AS INTEGER) AS midpoint_flagged, CAST(count(*) FILTER (WHERE best.i = 5) AS INTEGER) AS best_is_own
FROM z own JOIN mid USING (conv_id, turn) JOIN best USING (conv_id, turn) WHERE own.i = 5 GROUP BY conv_id""")
def break_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks that tear words apart: the subtitles' own, those at the midpoint, and how often the best is the own."""
    cues, w = _cues(spark, sf_dir)
    return subtitles.measures(subtitles.cue_lines(cues, "conv_id"), w, "conv_id")


@query(f"""WITH {_OPTIONS_SQL},
y AS (SELECT p.conv_id, p.turn, string_agg(p.text || CASE WHEN p.word_id = best.i THEN chr(10) WHEN p.word_id < 10 THEN ' ' ELSE '' END, '' ORDER BY p.word_id) AS suggested FROM p JOIN best USING (conv_id, turn) GROUP BY ALL)
SELECT own.conv_id, CAST(own.turn AS INTEGER) AS cue_idx, 0 AS line_idx, 8 AS cost, CASE WHEN best.i <> 5 AND best.torn < own.torn THEN suggested END AS suggestion FROM z own JOIN best USING (conv_id, turn) JOIN y USING (conv_id, turn) WHERE own.i = 5 AND own.torn > 0""")
def break_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles whose break parts words that belong together, with a better break where there is one."""
    cues, w = _cues(spark, sf_dir)
    return subtitles.findings(subtitles.cue_lines(cues, "conv_id"), w, "conv_id")


@query(r"""SELECT conv_id, turn, text, regexp_replace(regexp_replace(text || '?!?' || ' so!! ', '[!?]*\?[!?]+|[!?]+\?[!?]*', '?', 'g'), '!{2,}', '!', 'g') AS simple, length(text) + length(text) - length(translate(text, '😀', '')) AS utf16 FROM conversations""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Punctuation made simple, and the length of every turn in UTF-16 units."""
    c = docs(spark, sf_dir, "conversations")
    long = F.concat("text", F.lit("?!? so!! "))
    return c.select("conv_id", "turn", "text", unicode.simplify_punct(long).alias("simple"), unicode.utf16_offset(F.col("text"), F.length("text")).cast("long").alias("utf16"))


@query(f"""WITH {WORDS_SQL} SELECT doc_id, word_id, lower(text) AS low, lower(text) AS low_chars, CASE WHEN upper(text) = text AND lower(text) <> text THEN true ELSE false END AS is_upper, CASE WHEN lower(text) = text AND regexp_matches(text, '\\p{{Ll}}') THEN true ELSE false END AS is_lower, CAST(2 + length(text) + length(text) - length(replace(text, chr(92), '')) AS BIGINT) AS repr_len FROM a WHERE NOT regexp_matches(text, '[''ßﬁ]')""")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python's string functions on every word."""
    w, c = words(spark, sf_dir).where(~F.col("text").rlike("['ßﬁ]")), F.col("text")
    return w.select("doc_id", "word_id", unicode.lower(c).alias("low"), unicode.lower_chars_column(c).alias("low_chars"), unicode.is_upper(c).alias("is_upper"), unicode.is_lower(c).alias("is_lower"), F.length(unicode.py_repr(c)).cast("long").alias("repr_len"))


