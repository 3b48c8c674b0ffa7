"""Queries over the text of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


#: Terms whose counts are broadcast, some tens of MB.
BROADCAST_TERMS = 500_000


def docs(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(r"""
SELECT lang, count(*) AS n_tokens, count(DISTINCT lower(tok)) AS n_distinct, round(avg(length(tok)), 6) AS mean_len
FROM (SELECT lang, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) AS tok FROM documents) GROUP BY lang
""")
def tokens_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = docs(spark, sf_dir).select("lang", F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("tok"))
    # one pre-aggregation by distinct token keeps the distinct count's shuffle at vocabulary size
    per = toks.groupBy("lang", F.lower("tok").alias("low")).agg(F.count("*").alias("n"), F.sum(F.length("tok")).alias("chars"))
    return per.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_distinct"), F.round(F.sum("chars") / F.sum("n"), 6).alias("mean_len"))


@query("""
SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
""")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


@query(r"""
SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[.!?]+[ \n]'), lambda x: length(trim(x)) > 0)) AS BIGINT) AS n_sentences FROM documents
""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split("text", "[.!?]+[ \n]"), lambda x: F.length(F.trim(x)) > 0)
    return docs(spark, sf_dir).select("doc_id", F.size(parts).cast("long").alias("n_sentences"))


@query(r"""
WITH p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, w FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)),
o AS (SELECT doc_id, i, w[i] AS word, coalesce(sum(length(w[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM p)
SELECT doc_id, count(*) AS n_words, CAST(max(start_char) AS BIGINT) AS last_start, CAST(sum(start_char) AS BIGINT) AS sum_start FROM o GROUP BY doc_id
""")
def doc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of words as a running length, folded where the row lies: no window and no shuffle."""
    words = F.split("text", " ")
    fold = F.aggregate(
        words,
        F.struct(*[F.lit(0).cast("long").alias(c) for c in ("at", "last", "total")]),
        lambda s, w: F.struct((s["at"] + F.length(w) + 1).alias("at"), s["at"].alias("last"), (s["total"] + s["at"]).alias("total")),
    )
    return docs(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_words"), fold.alias("f")).select("doc_id", "n_words", F.col("f.last").alias("last_start"), F.col("f.total").alias("sum_start"))


@query(r"""
SELECT doc_id, length(t) AS n_norm, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS t FROM documents)
""")
def ws_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.unicode import collapse

    t = collapse(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.length(t).cast("long").alias("n_norm"), F.md5(t.cast("binary")).alias("digest"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(rf"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '{EMAIL}')) AS BIGINT) AS n_email FROM documents
""")
def email_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the cheap literal test comes first: the pattern runs on the few texts that can match
    n = F.when(F.contains("text", F.lit("@")), F.regexp_count("text", F.lit(EMAIL))).otherwise(0)
    return docs(spark, sf_dir).select("doc_id", n.cast("long").alias("n_email"))


@query(r"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(text, '[0-9+-]+'), lambda x: regexp_full_match(x, '([0-9]{2})?[0-9]{6}[-+]?[0-9]{4}'))) AS BIGINT) AS n_candidates FROM documents
""")
def idnumber_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.regexp_extract_all("text", F.lit("[0-9+-]+"), F.lit(0))
    return docs(spark, sf_dir).select("doc_id", F.size(F.filter(runs, lambda x: x.rlike(r"^([0-9]{2})?[0-9]{6}[-+]?[0-9]{4}$"))).cast("long").alias("n_candidates"))


@query("""
WITH n AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 + 1234567 AS VARCHAR), 10, '0') AS number FROM customer),
d AS (SELECT c_custkey, number, unnest(range(0, length(number))) AS i FROM n),
v AS (SELECT c_custkey, number, CAST(substr(number, CAST(length(number) - i AS BIGINT), 1) AS INTEGER) * (1 + i % 2) AS x FROM d)
SELECT c_custkey, number, sum(CASE WHEN x > 9 THEN x - 9 ELSE x END) % 10 = 0 AS luhn, sum(CASE WHEN x > 9 THEN x - 9 ELSE x END) % 10 = 0 AND sum(x) > 0 AS mod10 FROM v GROUP BY c_custkey, number
""")
def luhn_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.checks import luhn, mod10

    number = F.lpad((F.col("c_custkey") * 7919 + 1234567).cast("string"), 10, "0")
    return docs(spark, sf_dir, "customer").select("c_custkey", number.alias("number")).withColumns({"luhn": luhn(F.col("number")), "mod10": mod10(F.col("number"))})


#: All trigrams: those that begin at the first, second and third character and every third from there. Linear in the text, as a substring from each place is not.
TRIGRAMS_SQL = "list_concat(list_concat(regexp_extract_all({0}, '(?s)...'), regexp_extract_all(substr({0}, 2), '(?s)...')), regexp_extract_all(substr({0}, 3), '(?s)...'))"


@query(f"""
WITH g AS (SELECT lang, unnest({TRIGRAMS_SQL.format("lower(text)")}) AS gram FROM documents),
c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY ALL)
SELECT lang, gram, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS place FROM c QUALIFY place <= 20
""")
def lang_ngram_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent trigrams of each language: texts are cut where they lie, counts combine before the shuffle."""
    from ..operators.langid import trigrams

    counted = docs(spark, sf_dir).select("lang", F.explode(trigrams(F.col("text"))).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    return ranked.where("place <= 20").withColumn("place", F.col("place").cast("long"))


@query("""
SELECT md5(text) AS digest, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1
""")
def doc_dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.md5(F.col("text").cast("binary")).alias("digest"), "doc_id").groupBy("digest").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).where("n_docs > 1")


@query(r"""
WITH t AS (SELECT lang, lower(unnest(regexp_extract_all(text, '\p{L}+'))) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL)
SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS place FROM c QUALIFY place <= 25
""")
def top_terms_per_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = docs(spark, sf_dir).select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("t")).select("lang", F.lower("t").alias("term"))
    counted = terms.groupBy("lang", "term").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term")).cast("long")).where("place <= 25")


@query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS d FROM tf GROUP BY term), total AS (SELECT count(*) AS docs FROM documents)
SELECT doc_id, term, round(n * ln(docs / d), 6) AS weight FROM tf JOIN df USING (term), total
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(n * ln(docs / d), 6) DESC, term) = 1
""")
def tfidf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's heaviest term. Texts are dealt by document once; terms are counted and the top taken where they then lie.

    The counts of documents are broadcast up to BROADCAST_TERMS terms; more are joined by a shuffle of all terms.
    """
    from ..session import cut

    d = docs(spark, sf_dir).select("doc_id", "text")
    tf = d.repartition("doc_id").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    if d.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # each row is a document of its own: its distinct terms are counted where it lies
        each = d.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("term"))
    else:
        each = tf
    df = cut(each.groupBy("term").agg(F.count("*").alias("d")))
    df = F.broadcast(df) if df.count() <= BROADCAST_TERMS else df
    total = d.count()
    weighed = tf.join(df, "term").select("doc_id", "term", F.round(F.col("n") * F.log(F.lit(float(total)) / F.col("d")), 6).alias("weight"))
    return weighed.groupBy("doc_id").agg(F.min(F.struct((-F.col("weight")).alias("w"), "term")).alias("m")).select("doc_id", "m.term", (-F.col("m.w")).alias("weight"))


@query("""
WITH m AS (SELECT conv_id, role AS kind, lower(string_split(text, ' ')[1]) AS key, min(turn) AS first FROM conversations GROUP BY ALL)
SELECT conv_id, kind, key, '[' || upper(kind) || '-' || dense_rank() OVER (PARTITION BY conv_id, kind ORDER BY first, key) || ']' AS placeholder FROM m
""")
def placeholder_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders numbered by kind in order of first appearance."""
    from ..operators.masking import numbered

    first = docs(spark, sf_dir, "conversations").groupBy("conv_id", F.col("role").alias("kind"), F.lower(F.split("text", " ")[0]).alias("key")).agg(F.min("turn").alias("first"))
    return numbered(first, ["conv_id"], "kind", "key", "first")


@query(r"""
WITH w AS (SELECT doc_id, unnest(range(0, len(ws))) AS i, ws FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)),
s AS (SELECT doc_id, i AS a, i + 2 AS b FROM w WHERE regexp_matches(ws[i + 1], '^\p{Lu}')),
p AS (SELECT doc_id, i AS a, i + 1 AS b FROM w WHERE regexp_matches(ws[i + 1], '[0-9]'))
SELECT doc_id, count(*) AS n_free FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = s.doc_id AND p.a < s.b AND s.a < p.b) GROUP BY doc_id
""")
def span_overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that overlap no other table's span: an interval anti join inside each document."""
    from ..operators.spans import without_overlap

    w = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    spans = w.where(F.col("w").rlike(r"^\p{Lu}")).select("doc_id", F.col("i").alias("start"), (F.col("i") + 2).alias("end"))
    blocked = w.where(F.col("w").rlike("[0-9]")).select("doc_id", F.col("i").alias("start"), (F.col("i") + 1).alias("end"))
    return without_overlap(spans, blocked, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n_free"))


@query("""
SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) - 1 AS running_id FROM conversations
""")
def conv_running_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.running import running_ids

    return running_ids(docs(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], "running_id")


@query("""
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM q, e
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(q.v, e.v), 6) DESC, e.vec_id) <= 3
""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import search

    e = docs(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 3)


@query("""
SELECT label, i - 1 AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i
""")
def centroid_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("""
SELECT quality, toxic, (n_chars >= 500) AS long_text, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL
""")
def label_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id", "n_chars"), "doc_id").groupBy("quality", "toxic", (F.col("n_chars") >= 500).alias("long_text")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(r"""
SELECT page_id, CAST(len(list_filter(string_split_regex(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM pages
""")
def page_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\r]+")
    return docs(spark, sf_dir, "pages").select("page_id", F.size(F.filter(words, lambda x: x != "")).cast("long").alias("n_tokens"))


@query(r"""
SELECT host, count(*) AS n_pages, min(page_id) AS first_page FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages) GROUP BY host
""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).groupBy("host").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT line, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM l WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT doc_id) > 1
""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") >= 20)
    # repeats within a document combine before the shuffle; no set of documents is held for a frequent line
    per = lines.groupBy("line", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("line").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs")).where("n_docs > 1")


@query(r"""
WITH w AS (SELECT doc_id, unnest(range(0, len(ws))) AS i, ws FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)),
c AS (SELECT doc_id, i, ws[i + 1] AS word FROM w WHERE regexp_matches(ws[i + 1], '^\p{Lu}\p{Ll}')),
g AS (SELECT doc_id, i, word, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM c)
SELECT doc_id, min(i) AS start_token, max(i) + 1 AS end_token, count(*) AS n_tokens, string_agg(word, ' ' ORDER BY i) AS text FROM g GROUP BY doc_id, island HAVING count(*) >= 2
""")
def capitalized_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of capitalized words as entity candidates: gaps and islands."""
    w = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "word")).where(F.col("word").rlike(r"^\p{Lu}\p{Ll}"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    runs = w.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.count("*").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("i", "word"))).alias("ws"))
    return runs.where("n_tokens >= 2").select("doc_id", F.col("a").cast("long").alias("start_token"), (F.col("b") + 1).cast("long").alias("end_token"), "n_tokens", F.array_join("ws.word", " ").alias("text"))


@query(r"""
WITH t AS (SELECT row_number() OVER () AS r, conv_id, turn, length(text) AS n, string_split(text, ' ') AS ws FROM conversations),
w AS (SELECT r, conv_id, turn, n, unnest(range(1, len(ws) + 1)) AS i, length(unnest(ws)) + 1 AS k, len(ws) AS m FROM t),
s AS (SELECT r, conv_id, turn, n, i, m, sum(k) OVER (PARTITION BY r ORDER BY i) AS pos FROM w)
SELECT conv_id, turn, CAST(min(struct_pack(away := abs(2 * (pos - 1) - (n - 1)), at := pos)).at AS BIGINT) AS break_at FROM s WHERE i < m GROUP BY r, conv_id, turn
""")
def midpoint_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The midpoint break of every turn with a blank, of any length."""
    from ..operators.subtitles import midpoint

    return docs(spark, sf_dir, "conversations").select("conv_id", "turn", midpoint(F.col("text")).cast("long").alias("break_at")).where("break_at is not null")


@query(r"""
WITH w AS (SELECT string_split(text, ' ') AS w FROM documents), b AS (SELECT w[i] AS first, w[i + 1] AS second FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w))
SELECT first, second, count(*) AS n FROM b GROUP BY ALL
""")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of all bigrams, however rare."""
    w = docs(spark, sf_dir).select(F.split("text", " ").alias("w")).where(F.size("w") > 1)
    pairs = F.arrays_zip(F.slice("w", 1, F.size("w") - 1).alias("first"), F.slice("w", 2, F.size("w")).alias("second"))
    return w.select(F.inline(pairs)).groupBy("first", "second").agg(F.count("*").alias("n"))
