"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import ship
from . import ann, htmltext, langid, linededup, media, packing, sentencepiece, simhash, toxicity, warc
from .common import held_out

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dicts = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    out = langid.identify(docs, dicts)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected", "margin")


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


ORACLE["op8_line_dedup"] = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls, text FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM split),
counted AS (SELECT *, len(regexp_extract_all(line, '\S+')) AS w FROM lines),
filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS m,
    sum(w) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM counted WHERE w > 0),
starts AS (SELECT a.doc_id, a.m AS lo, min(b.m) AS hi FROM filled a JOIN filled b ON a.doc_id = b.doc_id AND b.m >= a.m AND b.upto - a.upto + a.w >= 50 GROUP BY ALL),
ends AS (SELECT b.doc_id, max(a.m) AS lo, b.m AS hi FROM filled a JOIN filled b ON a.doc_id = b.doc_id AND b.m >= a.m AND b.upto - a.upto + a.w >= 50 GROUP BY b.doc_id, b.m),
blocks AS (SELECT doc_id, lo, hi FROM starts UNION SELECT doc_id, lo, hi FROM ends),
content AS (SELECT k.doc_id, k.lo, k.hi, string_agg(f.line, chr(10) ORDER BY f.m) AS c FROM blocks k JOIN filled f ON f.doc_id = k.doc_id AND f.m BETWEEN k.lo AND k.hi GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY doc_id, lo) AS copy FROM content),
gone AS (SELECT DISTINCT f.doc_id, f.m FROM ordered o JOIN filled f ON f.doc_id = o.doc_id AND f.m BETWEEN o.lo AND o.hi WHERE o.copy > 1),
runs AS (SELECT doc_id, min(m) AS lo, max(m) AS hi FROM (SELECT *, m - row_number() OVER (PARTITION BY doc_id ORDER BY m) AS g FROM gone) GROUP BY doc_id, g),
spans AS (SELECT r.doc_id, a.n AS lo, b.n AS hi FROM runs r JOIN filled a ON a.doc_id = r.doc_id AND a.m = r.lo JOIN filled b ON b.doc_id = r.doc_id AND b.m = r.hi),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.n) AS t, count(*) AS k FROM lines l WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = l.doc_id AND l.n BETWEEN s.lo AND s.hi) GROUP BY l.doc_id)
SELECT s.doc_id, CASE WHEN EXISTS (SELECT 1 FROM spans x WHERE x.doc_id = s.doc_id) THEN coalesce(t, '') ELSE s.text END AS text,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(k, 0) AS BIGINT) AS n_removed
FROM split s LEFT JOIN kept USING (doc_id)
"""


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
