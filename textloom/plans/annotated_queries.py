"""Queries through the readers, writers and annotation operators.

Their annotated text is made from the turns of conversations by rules that SQL can repeat: each turn is a sentence of the
words between blanks, tagged by shape, each hanging from the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import annotate, pii
from ..sources import conllu, docjson, marked, trees
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


RELATIONS = ("nsubj", "det", "obj", "amod", "case")
#: The words of every turn with their tags, as a list of common table expressions that ends in `a`.
WORDS_SQL = r"""
t AS (SELECT conv_id * 1000 + turn AS doc_id, list_filter(string_split_regex(text, '[ \t\n]+'), lambda x: x <> '') AS ws FROM conversations),
w AS (SELECT doc_id, CAST(i AS INTEGER) AS word_id, ws[i] AS text FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM t)),
u AS (SELECT *, CASE WHEN regexp_matches(text, '^[0-9]') THEN 'NUM' WHEN regexp_matches(text, '^\p{Lu}') THEN 'PROPN' WHEN length(text) <= 3 THEN 'DET' ELSE 'NOUN' END AS upos,
  CAST(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY word_id) - length(text) - 1 AS INTEGER) AS start_char FROM w),
a AS (SELECT *, lower(text) AS lemma, start_char + CAST(length(text) AS INTEGER) AS end_char, word_id - 1 AS head, CASE WHEN word_id = 1 THEN 'root' ELSE ['nsubj', 'det', 'obj', 'amod', 'case'][word_id % 5 + 1] END AS deprel,
  CASE WHEN upos <> 'PROPN' THEN NULL ELSE CASE WHEN lag(upos, 1, '') OVER p = 'PROPN' THEN CASE WHEN lead(upos, 1, '') OVER p = 'PROPN' THEN 'I' ELSE 'E' END WHEN lead(upos, 1, '') OVER p = 'PROPN' THEN 'B' ELSE 'S' END || '-PER' END AS ner
  FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY word_id))
"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, word_id, text, lemma, upos, head, deprel, start_char, end_char, ner of every word of every turn."""
    listed = docs(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.filter(F.split("text", r"[ \t\n]+"), lambda x: x != "").alias("ws"))
    w = listed.select("doc_id", F.posexplode("ws").alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("word_id"), "text")
    upos = F.when(F.col("text").rlike("^[0-9]"), "NUM").when(F.col("text").rlike(r"^\p{Lu}"), "PROPN").when(F.length("text") <= 3, "DET").otherwise("NOUN")
    order = Window.partitionBy("doc_id").orderBy("word_id")
    u = w.withColumns({"upos": upos, "start_char": (F.sum(F.length("text") + 1).over(order) - F.length("text") - 1).cast("int")})
    before, after = F.lag("upos", 1, "").over(order) == "PROPN", F.lead("upos", 1, "").over(order) == "PROPN"
    mark = F.when(before, F.when(after, "I").otherwise("E")).otherwise(F.when(after, "B").otherwise("S"))
    relation = F.when(F.col("word_id") == 1, "root").otherwise(F.get(F.array(*[F.lit(r) for r in RELATIONS]), F.col("word_id") % 5))
    return u.withColumns({"lemma": F.lower("text"), "end_char": F.col("start_char") + F.length("text"), "head": F.col("word_id") - 1, "deprel": relation, "ner": F.when(F.col("upos") == "PROPN", F.concat(mark, F.lit("-PER")))})


_LINES_SQL = r"""l AS (SELECT doc_id, word_id, word_id || chr(9) || text || chr(9) || lemma || chr(9) || upos || chr(9) || '_' || chr(9) || '_' || chr(9) || head || chr(9) || deprel || chr(9) || '_' || chr(9) || 'start_char=' || start_char || '|end_char=' || end_char || CASE WHEN ner IS NULL THEN '' ELSE '|ner=' || ner END || chr(10) AS line FROM a),
f AS (SELECT doc_id, '# text = ' || string_agg(a.text, ' ' ORDER BY word_id) || chr(10) || string_agg(line, '' ORDER BY word_id) AS value FROM a JOIN l USING (doc_id, word_id) GROUP BY doc_id)"""


@query(f"WITH {WORDS_SQL}, {_LINES_SQL} SELECT doc_id, length(value) AS n_chars, md5(value) AS digest FROM f")
def conllu_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn written as CoNLL-U."""
    text = conllu.rendered(conllu.from_words(words(spark, sf_dir)), "doc_id")
    return text.select("doc_id", F.length("value").cast("long").alias("n_chars"), F.md5(F.col("value").cast("binary")).alias("digest"))


_COLUMNS = ("doc_id", "word_id", "text", "lemma", "upos", "head", "deprel", "start_char", "end_char", "ner")


@query(f"WITH {WORDS_SQL} SELECT {', '.join(_COLUMNS)} FROM a")
def conllu_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn written as CoNLL-U and read back, a row a word."""
    files = conllu.rendered(conllu.from_words(words(spark, sf_dir)), "doc_id")
    return conllu.words(conllu.sentences(files, "doc_id")).select(*_COLUMNS)


@query(f"WITH {WORDS_SQL} SELECT {', '.join(_COLUMNS)} FROM a")
def docjson_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn written as JSON and read back, a row a word."""
    files = conllu.rendered(conllu.from_words(words(spark, sf_dir)), "doc_id", docjson.write)
    return conllu.words(conllu.sentences(files, "doc_id", reader=docjson.read)).select(*_COLUMNS)


@query(f"""WITH {WORDS_SQL}, {_LINES_SQL},
g AS (SELECT doc_id, count(*) AS n, min(CASE WHEN word_id % 7 = 0 THEN word_id END) AS first, count(*) FILTER (WHERE word_id % 7 = 0) AS differing FROM a GROUP BY doc_id)
SELECT doc_id AS path, first + 1 AS line, differing FROM g WHERE differing > 0""")
def conllu_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's file beside one whose every seventh word has another tag: the first line that differs, and how many do."""
    w = words(spark, sf_dir)
    other = w.withColumn("upos", F.when(F.col("word_id") % 7 == 0, "X").otherwise(F.col("upos")))
    a, b = (conllu.rendered(conllu.from_words(x), "doc_id").withColumnRenamed("doc_id", "path") for x in (w, other))
    return conllu.first_difference(a, b).select("path", "line", "differing")


@query(f"""WITH {WORDS_SQL}, s AS (SELECT doc_id, count(*) AS n FROM a GROUP BY doc_id),
n AS (SELECT doc_id, 0 AS node_id, NULL AS parent_id, 'ROOT' AS label, 0 AS depth, 0 AS first_leaf, n - 1 AS last_leaf FROM s
UNION ALL SELECT doc_id, 1, 0, 'S', 1, 0, n - 1 FROM s
UNION ALL SELECT doc_id, 2 * word_id, 1, upos, 2, word_id - 1, word_id - 1 FROM a
UNION ALL SELECT doc_id, 2 * word_id + 1, 2 * word_id, translate(text, '()', '[]'), 3, word_id - 1, word_id - 1 FROM a)
SELECT doc_id, CAST(node_id AS INTEGER) AS node_id, CAST(parent_id AS INTEGER) AS parent_id, label, CAST(depth AS INTEGER) AS depth, CAST(first_leaf AS INTEGER) AS first_leaf, CAST(last_leaf AS INTEGER) AS last_leaf FROM n""")
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of every turn's bracketed tree."""
    spark.udtf.register("tree_nodes", trees.TreeNodes)
    leaf = F.concat(F.lit("("), "upos", F.lit(" "), F.translate("text", "()", "[]"), F.lit(")"))
    text = words(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word_id", leaf.alias("x")))).alias("xs"))
    text = text.select("doc_id", F.concat(F.lit("(ROOT (S "), F.array_join("xs.x", " "), F.lit("))")).alias("tree"))
    text.createOrReplaceTempView("_tree_texts")
    return spark.sql("SELECT doc_id, n.* FROM _tree_texts, LATERAL tree_nodes(tree) n")


_TURN_LINES = r"list_filter(string_split(replace(replace(text, '-->', '->'), chr(13), ' '), chr(10)), lambda x: trim(x, ' ' || chr(9)) <> '')"
_CUE_SQL = f"""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cue_idx, {_TURN_LINES} AS ls FROM conversations)"""


def _turn_lines():
    plain = F.replace(F.replace("text", F.lit("-->"), F.lit("->")), F.lit("\r"), F.lit(" "))
    return F.filter(F.split(plain, "\n"), lambda x: F.trim(F.translate(x, "\t", " ")) != "")


@query(_CUE_SQL + " SELECT conv_id, CAST(cue_idx AS INTEGER) AS cue_idx, CAST(turn + 1 AS INTEGER) AS number, CAST(len(ls) AS BIGINT) AS n_lines, md5(array_to_string(list_transform(ls, lambda x: rtrim(x, ' ' || chr(9))), chr(10))) AS digest FROM c")
def srt_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation written as subtitles, a turn a cue, and read back."""
    block = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n00:00:01,000 --> 00:00:02,000\n"), F.array_join(_turn_lines(), "\n"), F.lit("\n\n"))
    files = docs(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))).alias("bs")).select("conv_id", F.array_join("bs.b", "").alias("value"))
    return marked.cue_rows(files, key="conv_id").select("conv_id", "cue_idx", "number", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("digest"))


@query(r"""WITH c AS (SELECT conv_id, turn, list_filter(string_split_regex(translate(text, '<>', '[]'), '[ \t\n\r]+'), lambda x: x <> '') AS ws FROM conversations),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cue_idx, ws FROM c WHERE len(ws) > 0)
SELECT conv_id, CAST(cue_idx AS INTEGER) AS cue_idx, CAST(CASE WHEN len(ws) > 5 THEN 2 ELSE 1 END AS BIGINT) AS n_lines, array_to_string(ws[1:5], ' ') AS first_line FROM n""")
def tagged_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with marks after a turn's fifth word and at its end, read as subtitles."""
    ws = F.filter(F.split(F.translate("text", "<>", "[]"), r"[ \t\n\r]+"), lambda x: x != "")
    row = F.concat(F.array_join(F.slice(ws, 1, 5), " "), F.lit(" <eol> "), F.array_join(F.slice(ws, 6, 1 << 30), " "), F.lit(" <eob>\n"))
    files = docs(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", row.alias("b")))).alias("bs")).select("conv_id", F.array_join("bs.b", "").alias("value"))
    return marked.cue_rows(files, marked.parse_tagged, "conv_id").select("conv_id", "cue_idx", F.size("lines").cast("long").alias("n_lines"), F.get("lines", F.lit(0)).alias("first_line"))


@query(f"""WITH {WORDS_SQL} SELECT doc_id, start_char AS start, end_char AS "end", 'PER' AS type, CAST(length(text) AS VARCHAR) AS id, text FROM (SELECT * REPLACE (translate(text, '{{}}', '[]') AS text) FROM a) WHERE upos = 'PROPN'""")
def labelled_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of every turn with its capitalized words marked up, in the places of the plain text."""
    text = F.translate("text", "{}", "[]")
    piece = F.when(F.col("upos") == "PROPN", F.concat(F.lit("{PER#"), F.length("text").cast("string"), F.lit(":"), text, F.lit("}"))).otherwise(text)
    files = words(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word_id", piece.alias("x")))).alias("xs")).select("doc_id", F.array_join("xs.x", " ").alias("value"))
    return marked.gold_rows(files, "doc_id")


@query(f"WITH {WORDS_SQL} SELECT a.doc_id, a.word_id, a.deprel, h.text AS head_text, h.upos AS head_upos FROM a LEFT JOIN a h ON h.doc_id = a.doc_id AND h.word_id = a.head")
def dependency_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word beside its head."""
    return annotate.dependencies(words(spark, sf_dir), ["doc_id"]).select("doc_id", "word_id", "deprel", "head_text", "head_upos")


@query(f"""WITH {WORDS_SQL}, d AS (SELECT doc_id, word_id // 6 AS head, CASE WHEN deprel = 'nsubj' THEN 'subj' WHEN deprel = 'obj' THEN 'obj' END AS grp FROM a)
SELECT doc_id, head, grp AS "group", count(*) AS n FROM d WHERE grp IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def repeated_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of six words each that have more than one subject or object."""
    w = words(spark, sf_dir).withColumn("head", (F.floor(F.col("word_id") / 6)).cast("int"))
    return annotate.repeated_arguments(w, ["doc_id"])


@query(f"""WITH {WORDS_SQL}, m AS (SELECT upos, lower(text) AS text, text AS lemma FROM a), b AS (SELECT upos, text, lemma FROM m UNION ALL SELECT '*', text, lemma FROM m),
k AS (SELECT upos, text, lemma, count(*) AS n FROM b GROUP BY ALL)
SELECT upos, text, lemma FROM k QUALIFY row_number() OVER (PARTITION BY upos, text ORDER BY n DESC, lemma) = 1""")
def lemma_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent spelling of every word, by tag and under any."""
    return annotate.lemma_table(words(spark, sf_dir).select("upos", F.lower("text").alias("text"), F.col("text").alias("lemma")))


@query(f"""WITH {WORDS_SQL}, m AS (SELECT upos, lower(text) AS text, '<' || lower(text) || '>' AS lemma FROM a WHERE doc_id % 2 = 0),
b AS (SELECT upos, text, min(lemma) AS lemma FROM m GROUP BY ALL), c AS (SELECT text, min(lemma) AS lemma FROM m GROUP BY ALL)
SELECT a.doc_id, a.word_id, coalesce(b.lemma, c.lemma, reverse(lower(a.text))) AS lemma FROM a LEFT JOIN b ON b.upos = a.upos AND b.text = lower(a.text) LEFT JOIN c ON c.text = lower(a.text)""")
def lemma_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas of all words by a table learned from every second turn, the rest by a fallback."""
    w = words(spark, sf_dir).withColumn("text", F.lower("text"))
    table = annotate.lemma_table(w.where("doc_id % 2 = 0").withColumn("lemma", F.concat(F.lit("<"), "text", F.lit(">"))))
    return annotate.lemmatized(w, table, fallback=F.reverse).select("doc_id", "word_id", "lemma")


@query(f"""WITH {WORDS_SQL}, m AS (SELECT lower(text) AS k, upos FROM a WHERE doc_id % 2 = 0 UNION ALL SELECT '-' || right(lower(text), 3), upos FROM a WHERE doc_id % 2 = 0),
c AS (SELECT k, upos, count(*) AS n FROM m GROUP BY ALL), b AS (SELECT k, upos FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, upos) = 1)
SELECT a.doc_id, a.word_id, coalesce(x.upos, y.upos, 'NOUN') AS upos FROM a LEFT JOIN b x ON x.k = lower(a.text) LEFT JOIN b y ON y.k = '-' || right(lower(a.text), 3)""")
def pos_by_ending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of all words by a table of words and endings learned from every second turn."""
    w = words(spark, sf_dir)
    return annotate.tagged(w, annotate.tag_table(w.where("doc_id % 2 = 0"))).select("doc_id", "word_id", "upos")


@query(f"""WITH {WORDS_SQL}, p AS (SELECT *, word_id - row_number() OVER (PARTITION BY doc_id ORDER BY word_id) AS island FROM a WHERE upos = 'PROPN')
SELECT doc_id, min(word_id) AS start_token, max(word_id) AS end_token, 'PER' AS type, string_agg(text, ' ' ORDER BY word_id) AS text FROM p GROUP BY doc_id, island""")
def entity_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that the words' BIOES tags say."""
    w = words(spark, sf_dir).select("doc_id", F.col("word_id").alias("token_idx"), F.col("text").alias("token"), "ner")
    return annotate.entity_spans(w, ["doc_id"])


@query(f"""WITH {WORDS_SQL}, c AS (SELECT lower(text) AS text, upos AS type, count(*) AS n FROM a GROUP BY ALL)
SELECT text, type FROM c QUALIFY row_number() OVER (PARTITION BY text ORDER BY n DESC, type) = 1""")
def gazetteer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.gazetteer(words(spark, sf_dir).select(F.lower("text").alias("text"), F.col("upos").alias("type")))


@query(f"""WITH {WORDS_SQL}, x AS (SELECT doc_id, word_id, upos || '-' || deprel || '-' || length(text) AS xpos FROM a)
SELECT doc_id, word_id, xpos, string_split(xpos, '-')[1] AS first, string_split(xpos, '-')[3] AS third, CAST(length(xpos) AS BIGINT) AS n_letters FROM x""")
def xpos_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite tags in parts: by a separator, and letter by letter."""
    x = words(spark, sf_dir).select("doc_id", "word_id", F.concat_ws("-", "upos", "deprel", F.length("text")).alias("xpos"))
    by, letters = annotate.xpos_parts(F.col("xpos"), "-"), annotate.xpos_parts(F.col("xpos"))
    return x.select("doc_id", "word_id", "xpos", F.get(by, F.lit(0)).alias("first"), F.get(by, F.lit(2)).alias("third"), F.size(letters).cast("long").alias("n_letters"))


@query(f"""WITH {WORDS_SQL} SELECT doc_id, word_id, 'Case=' || upos || '|len=' || length(text) || '|Rel=' || deprel AS feats, 'Case=' || upos || '|len=' || length(text) || '|Rel=' || deprel AS sorted_feats, CAST(length(text) AS VARCHAR) AS len FROM a""")
def feats_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature lists put in order of their names, and one feature of each."""
    feats = F.concat(F.lit("Rel="), "deprel", F.lit("|len="), F.length("text"), F.lit("|Case="), "upos")
    w = words(spark, sf_dir).select("doc_id", "word_id", feats.alias("raw"))
    back = F.array_join(F.reverse(F.split("raw", r"\|")), "|")
    return w.select("doc_id", "word_id", back.alias("feats"), conllu.sort_feats_column(F.col("raw")).alias("sorted_feats"), conllu.feats_map(F.col("raw"))["len"].alias("len"))


@query(f"""WITH {WORDS_SQL}, s AS (SELECT conv_id * 1000 + turn AS doc_id, text, CAST(conv_id % 3 AS INTEGER) AS sentiment FROM conversations),
x AS (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term, sentiment AS label FROM s WHERE doc_id % 2 = 0), c AS (SELECT term, label, count(*) AS n FROM x GROUP BY ALL),
g AS (SELECT label, sum(n) AS total, count(*) AS types FROM c GROUP BY label), z AS (SELECT term, label, ln((n + 1) / (total + types)) AS weight FROM c JOIN g USING (label)),
y AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS term FROM s), r AS (SELECT doc_id, label, round(sum(weight + 12), 6) AS w FROM y JOIN z USING (term) GROUP BY ALL),
b AS (SELECT doc_id, label FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, label) = 1)
SELECT doc_id, coalesce(b.label, 1) AS sentiment FROM s LEFT JOIN b USING (doc_id)""")
def sentiment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for every turn by words weighed in every second turn."""
    s = docs(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", (F.col("conv_id") % 3).cast("int").alias("sentiment"))
    return annotate.entity_sentiment(s, annotate.sentiment_table(s.where("doc_id % 2 = 0")), ["doc_id"])


@query("""SELECT doc_id, lang, CASE lang WHEN 'de' THEN 'one' WHEN 'fr' THEN 'two' END AS route, CASE lang WHEN 'de' THEN length(text) END AS n FROM documents""")
def routed_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the function of their language; others come back as they are."""
    d = docs(spark, sf_dir).select("doc_id", "lang", "text")
    out = annotate.routed(d, {"de": lambda x: x.withColumns({"route": F.lit("one"), "n": F.length("text").cast("long")}), "fr": lambda x: x.withColumn("route", F.lit("two"))})
    return out.select("doc_id", "lang", "route", "n")


@query(f"""WITH {WORDS_SQL}, c AS (SELECT lower(text) AS text, lemma, upos, count(*) AS n FROM a GROUP BY ALL), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY text ORDER BY n DESC, lemma DESC, upos DESC) = 1)
SELECT text, lemma, upos IN ('DET', 'ADP', 'PRON', 'AUX', 'CCONJ', 'SCONJ', 'PART') AS is_stop, upos = 'PUNCT' AS is_punct FROM b""")
def normalized_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.normalized_tokens(words(spark, sf_dir).select(F.lower("text").alias("text"), "lemma", "upos"))


@query(f"""WITH {WORDS_SQL}, e AS (SELECT doc_id, word_id, ['PER', 'GPE', 'ORG', 'DATE', 'EVENT'][word_id % 5 + 1] AS type FROM a)
SELECT doc_id, word_id, CASE type WHEN 'PER' THEN 'PERSON' WHEN 'GPE' THEN 'LOCATION' WHEN 'ORG' THEN 'ORGANIZATION' ELSE 'DATE_TIME' END AS kind, 0.85 AS score FROM e WHERE type IN ('PER', 'GPE', 'DATE')""")
def entity_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities under the kinds of personal data they stand for, of those that are asked for."""
    kind = F.get(F.array(*[F.lit(x) for x in ("PER", "GPE", "ORG", "DATE", "EVENT")]), F.col("word_id") % 5)
    return pii.entity_kinds(words(spark, sf_dir).select("doc_id", "word_id", kind.alias("type")), ["PERSON", "LOCATION", "DATE_TIME"]).select("doc_id", "word_id", "kind", "score")


@query(f"""WITH {WORDS_SQL}, d AS (SELECT lower(text) AS low, [left(lower(text), 2), substr(lower(text), 3)] AS parts FROM a WHERE length(text) = 5 AND doc_id % 2 = 0 GROUP BY ALL),
x AS (SELECT doc_id, word_id, CASE WHEN low IS NULL THEN [text] WHEN upper(text) = text AND lower(text) <> text THEN [upper(parts[1]), upper(parts[2])] WHEN upper(left(text, 1)) = left(text, 1) AND lower(left(text, 1)) <> left(text, 1) THEN [upper(left(parts[1], 1)) || substr(parts[1], 2), parts[2]] ELSE parts END AS ps FROM a LEFT JOIN d ON low = lower(text)),
r AS (SELECT doc_id, word_id AS token, unnest(range(1, len(ps) + 1)) AS i, ps FROM x)
SELECT doc_id, token, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY token, i) AS INTEGER) AS word_id, ps[i] AS word FROM r""")
def mwt_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-word tokens by a dictionary (words of five letters, cut after the second), in the token's capitals."""
    w = words(spark, sf_dir).select("doc_id", F.col("word_id").alias("token"), "text")
    low = F.lower("text")
    table = w.where((F.length("text") == 5) & (F.col("doc_id") % 2 == 0)).select(low.alias("text"), F.array(F.substring(low, 1, 2), F.substring(low, 3, 1 << 30)).alias("parts")).distinct()
    return annotate.word_rows(annotate.expanded(w, table), ["doc_id"], "token")


@query(f"""WITH {WORDS_SQL}, v AS (SELECT text AS entry, min(doc_id) + 2 AS id FROM a WHERE doc_id % 2 = 0 GROUP BY text)
SELECT a.doc_id, a.word_id, coalesce(x.id, y.id, 1) AS id FROM a LEFT JOIN v x ON x.entry = a.text LEFT JOIN v y ON y.entry = lower(a.text)""")
def vocabulary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by the vocabulary of every second turn: as written, else in lower case, else unknown."""
    w = words(spark, sf_dir).select("doc_id", "word_id", "text")
    v = w.where("doc_id % 2 = 0").groupBy(F.col("text").alias("entry")).agg((F.min("doc_id") + 2).alias("id"))
    return annotate.looked_up(w, v).select("doc_id", "word_id", "id")


_TARGETS = "'the', 'la', 'der', 'der', 'le', 'to', 'of', 'de'"


@query(f"""WITH {WORDS_SQL}, n AS (SELECT *, coalesce(lead(upos) OVER (PARTITION BY doc_id ORDER BY word_id), '') AS next_upos, lower(text) || length(text) || '-' || word_id % 3 AS case_lemma FROM a),
c AS (SELECT lower(text) AS low, next_upos, case_lemma, count(*) AS k FROM n WHERE doc_id % 2 = 0 AND lower(text) IN ({_TARGETS}) GROUP BY ALL), b AS (SELECT low, next_upos, case_lemma FROM c QUALIFY row_number() OVER (PARTITION BY low, next_upos ORDER BY k DESC, case_lemma) = 1)
SELECT n.doc_id, n.word_id, CASE WHEN lower(n.text) IN ({_TARGETS}) THEN coalesce(b.case_lemma, n.lemma) ELSE n.lemma END AS lemma FROM n LEFT JOIN b ON b.low = lower(n.text) AND b.next_upos = n.next_upos""")
def lemma_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas of some words chosen by what stands after them, as seen in every second turn."""
    w, targets = words(spark, sf_dir), ("the", "la", "der", "le", "to", "of", "de")
    seen = w.where("doc_id % 2 = 0").withColumn("lemma", F.concat(F.lower("text"), F.length("text"), F.lit("-"), F.col("word_id") % 3))
    return annotate.disambiguated(w, targets, annotate.neighbour_table(seen, targets, ["doc_id"]), ["doc_id"]).select("doc_id", "word_id", "lemma")
