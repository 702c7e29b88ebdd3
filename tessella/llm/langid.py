"""Language identification by compression with per-language dictionaries.

A text is encoded with each language's zstandard raw-content dictionary; the
language whose dictionary gives the fewest bytes is chosen.  Texts are cut into
blocks, so that a long text meets the dictionary again and again instead of
only its own past, and every block follows a primer, a piece of the dictionary
whose own size is taken off: without one, zstandard stores short blocks as they
are.  Every block of every text counts, short texts and long ones alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, release, text_of, worker_state

UNDETERMINED = "und"


@dataclass(frozen=True)
class LangIdParams:
    """dict_bytes and rows_per_lang bound the labelled sample that is fitted;
    piece_chars: as much of one text goes into a dictionary, so that none
    consists of a few texts, which may be long, repetitive or mislabelled.

    group: languages whose dictionaries are fitted and sent together; more
    languages are several groups.  block_chars: texts are compressed in blocks
    of so many characters.  A text is rejected if its two best languages are
    closer than margin_bytes, or than margin_share of the smaller size.
    """

    dict_bytes: int = 32_768
    rows_per_lang: int = 200
    piece_chars: int = 512
    group: int = 256
    block_chars: int = 1_024
    level: int = 6
    primer_bytes: int = 256
    margin_bytes: float = 1.0
    margin_share: float = 0.02


def letters(text: Column) -> Column:
    """Lower case, every run of non-letters as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text_of(text)), r"[^\p{L}]+", " "))


def fit(docs: DataFrame, params: LangIdParams = LangIdParams()) -> dict[str, bytes]:
    """Dictionaries from ``text`` and non-null ``lang``, the language with most rows first (ties: by name).

    The sample: of each language the rows_per_lang rows whose id hashes lowest
    (Spark prunes this rank before its shuffle), then a piece of each text, from
    a place that its hash tells, up to dict_bytes.  Ties and repeated rows are ordered by the text's hash.  A
    language without any letter has no dictionary.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    langs = [r.lang for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]  # a row for each language
    made: dict[str, bytes] = {}
    for at in range(0, len(langs), params.group):
        made |= _fit_some(rows, langs[at : at + params.group], params)
    return made


def _fit_some(rows: DataFrame, langs: list[str], params: LangIdParams) -> dict[str, bytes]:
    # ranks of ids and hashes alone; Spark cuts each task's rows to rows_per_lang before the shuffle
    hashed = rows.where(F.col("lang").isin(langs)).withColumn("h", F.xxhash64("doc_id")).withColumn("t", F.xxhash64("text"))
    by_hash = Window.partitionBy("lang").orderBy("h", "t")
    chosen = hashed.select("lang", "h", "t").withColumn("rn", F.row_number().over(by_hash)).where(F.col("rn") <= params.rows_per_lang)
    sample = (
        hashed.join(F.broadcast(chosen.drop("rn").distinct()), ["lang", "h", "t"], "left_semi")  # at most group * rows_per_lang rows
        .dropDuplicates(["lang", "h", "t"])
        .select("lang", "h", "t", letters(F.col("text")).alias("s"))
    )
    start = F.pmod(F.col("t"), F.greatest(F.lit(1), F.length("s") - params.piece_chars)).cast("int") + 1
    sample = sample.withColumn("s", F.substring("s", start, F.lit(params.piece_chars)))
    # of each language, only as many of those rows as fill its dictionary reach the driver
    before = F.sum(F.octet_length("s") + 1).over(by_hash) - F.octet_length("s") - 1
    some = sample.withColumn("before", before).where(F.col("before") < params.dict_bytes)
    parts: dict[str, list[bytes]] = {}
    for r in some.orderBy("lang", "h", "t").collect():
        parts.setdefault(r.lang, []).append(r.s.encode())
    made = {k: b" ".join(parts.get(k, ()))[: params.dict_bytes] for k in langs}
    return {k: v for k, v in made.items() if v.strip()}


def sizer(contents: list[bytes], params: LangIdParams = LangIdParams()):
    """Function from a text's letters to its size in bytes under each dictionary."""
    import zstandard as zstd

    coders = []
    for content in contents:
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=params.level)
        c = zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        at = len(content) // 16
        primer = content[at : at + params.primer_bytes] + b" "
        coders.append((c.compress, primer, len(c.compress(primer))))

    def sizes(s: str) -> list[int]:
        out = [0] * len(coders)
        for at in range(0, len(s), params.block_chars):
            b = s[at : at + params.block_chars].encode()
            for i, (compress, primer, own) in enumerate(coders):
                out[i] += len(compress(primer + b)) - own
        return out

    return sizes


def decide(names: list[str], sizes: Column, params: LangIdParams = LangIdParams()) -> dict[str, Column]:
    """lang_pred, score, rejected and margin in bytes from the array of sizes.  Equal sizes: the first name."""
    least = F.array_min(sizes)
    lang = F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(sizes, least).cast("int"))
    if len(names) == 1:
        return {"lang_pred": lang, "score": F.lit(1.0), "rejected": F.lit(False), "margin": F.lit(float(params.margin_bytes))}
    margin = (F.array_sort(sizes)[1] - least).cast("double")
    share = F.aggregate(sizes, F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), -F.least((x - least) / 4.0, F.lit(500.0))))
    close = (margin < params.margin_bytes) | (margin < params.margin_share * least)
    return {"lang_pred": lang, "score": 1.0 / share, "rejected": close, "margin": margin}


def identify(docs: DataFrame, dicts: dict[str, bytes], params: LangIdParams = LangIdParams(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred, score, rejected and margin.

    Null text, or one without letters: ``und``, score 0, rejected.  The same
    without any dictionary.  Repeated rows give repeated results; other columns
    of ``docs`` are not looked at.  Texts stay in the JVM; Python gets their
    letters and returns sizes.
    """
    nothing = {"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "rejected": F.lit(True), "margin": F.lit(0.0)}
    if not dicts:
        return docs.select(*keep, *[c.alias(k) for k, c in nothing.items()])
    spark, names = bounded(docs.sparkSession), list(dicts)

    def measured(group: list[str]) -> Column:
        sent = spark.sparkContext.broadcast([dicts[k] for k in group])  # at most group * dict_bytes

        @F.pandas_udf("array<int>")
        def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            key = ("langid", params, tuple(map(hash, sent.value)))
            f = worker_state(key, lambda: sizer(sent.value, params))
            for b in batches:
                yield pd.Series([np.array(f(s), np.int32) for s in b], dtype=object)
            release()

        return sizes.asNondeterministic()(F.col("_letters"))  # once a row, whatever is asked of it

    groups = [names[at : at + params.group] for at in range(0, len(names), params.group)]
    out = docs.select(*keep, letters(F.col("text")).alias("_letters"))
    out = out.select(*keep, (F.col("_letters") != "").alias("_any"), *[measured(g).alias(f"_s{i}") for i, g in enumerate(groups)])
    out = out.select(*keep, "_any", F.concat(*[F.col(f"_s{i}") for i in range(len(groups))]).alias("_sizes"))
    said = decide(names, F.col("_sizes"), params)
    return out.select(*keep, *[F.when(F.col("_any"), c).otherwise(nothing[k]).alias(k) for k, c in said.items()])
