"""Queries through the segmentation, masking and chunking operators. Those that SQL cannot say are held by tests alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, coref, langid, masking, pii
from ..operators.segment import paragraph_rows
from ..session import spread
from ..streaming import stream
from .text_queries import ORACLE_SQL as TEXT_SQL
from .text_queries import TRIGRAMS_SQL, capitalized_runs, docs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Unicode white space and the C1 controls as RE2 writes them.
_WS = r"\s\x0b\x1c-\x1f\x80-\x9f\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


@query(rf"""
WITH p AS (SELECT doc_id, list_filter([regexp_replace(regexp_replace(x, '^[{_WS}]+', ''), '[{_WS}]+$', '') FOR x IN string_split_regex(text, '\n[{_WS}]*\n')], lambda x: x <> '') AS ps FROM documents),
u AS (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p) SELECT doc_id, CAST(i - 1 AS INTEGER) AS par_idx, length(ps[i]) AS n_chars FROM u
""")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of every document."""
    p = paragraph_rows(docs(spark, sf_dir))
    return p.select("doc_id", "par_idx", F.length("paragraph").cast("long").alias("n_chars"))


@query()
def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.masked(docs(spark, sf_dir).select("doc_id", "text"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(spread(docs(spark, sf_dir).select("doc_id", "text")), 200, 20)


@query(f"""
WITH g AS (SELECT doc_id, lang, unnest({TRIGRAMS_SQL.format("lower(text)")}) AS gram FROM documents),
c AS (SELECT lang, gram, count(*) AS n FROM g WHERE lang IS NOT NULL AND doc_id % 5 <> 0 GROUP BY ALL), v AS (SELECT count(DISTINCT gram) AS size FROM c),
t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang), d AS (SELECT doc_id, gram, count(*) AS k FROM g GROUP BY ALL),
s AS (SELECT d.doc_id, t.lang, round(sum(k * ln((coalesce(c.n, 0) + 1) / (t.total + v.size))), 3) AS score FROM d CROSS JOIN t CROSS JOIN v LEFT JOIN c ON c.gram = d.gram AND c.lang = t.lang GROUP BY ALL)
SELECT doc_id, lang AS lang_pred FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1
""")
def langid_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by trigrams; every fifth document is held out of what the model learns from."""
    d = docs(spark, sf_dir).select("doc_id", "lang", "text")
    return langid.identify(d, langid.fit(d.where("doc_id % 5 <> 0")))


@query(f"""
WITH e AS ({TEXT_SQL["capitalized_runs"]}), k AS (SELECT doc_id, lower(text) AS name, min(start_token) AS first, count(*) AS n FROM e GROUP BY ALL HAVING count(*) > 1),
c AS (SELECT doc_id, name, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS chain FROM k)
SELECT e.doc_id, e.start_token, c.chain FROM e JOIN c ON c.doc_id = e.doc_id AND c.name = lower(e.text)
""")
def name_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalized runs with equal names in a document as chains of one mention after another."""
    e = capitalized_runs(spark, sf_dir).select("doc_id", F.lit("NAME").alias("type"), "text", F.col("start_token").alias("start_char"))
    return coref.exact_name_chains(e).select("doc_id", F.col("start_char").alias("start_token"), F.col("chain").cast("long").alias("chain"))


@query("""
SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL
""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table read as a stream to its end: hourly counts of every window."""
    events = spark.readStream.schema(docs(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    out = stream.to_the_end(stream.tumbling(events))
    return out.select(F.col("start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("""
SELECT user_id, first_ts, n FROM (
  WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
  SELECT user_id, session, min(ts) AS first_ts, count(*) AS n FROM s GROUP BY user_id, session)
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session windows as a stream would build them, over the whole table."""
    return stream.sessions(docs(spark, sf_dir, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("first_ts"), "n")


@query("""
WITH l AS (SELECT s_suppkey, 5000 + s_suppkey * 37 % 5000 AS clearing, s_suppkey % 3 AS pick FROM supplier)
SELECT s_suppkey, clearing, CASE WHEN clearing BETWEEN 5000 AND 5999 OR clearing BETWEEN 7000 AND 7999 THEN '1.1' WHEN clearing BETWEEN 6000 AND 6999 THEN '2.2' WHEN clearing BETWEEN 8000 AND 8999 THEN '2.3' ELSE 'other' END AS kind FROM l
""")
def clearing_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range join with the table of clearing numbers."""
    n = docs(spark, sf_dir, "supplier").select("s_suppkey", (5000 + F.col("s_suppkey") * 37 % 5000).alias("clearing"))
    kind = F.when(F.col("clearing") < 9000, F.concat_ws(".", "type", "comment")).otherwise(F.lit("other"))
    return pii.with_clearing(n, "clearing").select("s_suppkey", "clearing", kind.alias("kind"))


@query("""
WITH w AS (SELECT doc_id, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS n FROM documents),
r AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT doc_id, CAST(n AS BIGINT) AS n, CAST(before AS BIGINT) AS before FROM r WHERE before < 10000
""")
def benchmark_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents that together have ten thousand words: a running sum over the whole table, range by range."""
    from ..operators.running import running_sum

    n = F.size(F.filter(F.split("text", " "), lambda x: x != "")).cast("long")
    return running_sum(docs(spark, sf_dir).select("doc_id", n.alias("n")), ["doc_id"], "n", "before").where("before < 10000")


@query()
def subword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of each document under a vocabulary of the corpus's 2,000 most frequent word beginnings, longest piece first."""
    from ..operators.subwords import piece_counter

    return piece_counter(docs(spark, sf_dir).select("doc_id", "text"), 2000)
