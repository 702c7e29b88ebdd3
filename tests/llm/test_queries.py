"""The registered queries and the pipeline on the smallest driver tables."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.conftest import duck, rows
from tests.llm.test_llm import brute_components, brute_lines, plain_score
from tessella.llm import htmltext, langid, linededup, simhash, toxicity
from tessella.llm.common import DOC_COLUMNS, held_out
from tessella.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op3_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op4_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5_simhash": "doc_id fingerprint component_id",
    "op6_nearest": "query_id rank vec_id score",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op9_toxicity": "doc_id held_out score predicted",
    "op10_html_text": "page_id url text n_chars",
}


def test_all_are_registered():
    found = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(found)
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    assert set(COLUMNS.get(name, "").split()) <= set(got.columns)
    if name in ORACLE:
        assert rows(got.toPandas()) == rows(duck(SF).sql(ORACLE[name]).df())
    else:
        assert got.count() > 0


def plain_language(text, dicts, p=langid.LangIdParams()):
    """Language and whether it is rejected, by plain zstandard."""
    import re

    import zstandard

    letters = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    if not letters:
        return None, True
    sizes = []
    for content in dicts.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=p.level)
        coder = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        primer = content[len(content) // 16 :][: p.primer_bytes] + b" "
        sizes.append(sum(len(coder.compress(primer + letters[k : k + p.block_chars].encode())) - len(coder.compress(primer)) for k in range(0, len(letters), p.block_chars)))
    best, second = sorted(sizes)[:2]
    return [*dicts][sizes.index(best)], second - best < max(p.margin_bytes, p.margin_share * best)


def plain_groups(texts):
    """Smallest id of each document's near-duplicate group: op5's links, and five-word shingle sets with a similarity of at least 0.8."""
    fps = {i: simhash.fingerprint(t) for i, t in texts.items()}
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, b in enumerate(ids):
        for a in ids[:n]:
            common = len(sets[a] & sets[b])
            if (fps[a] ^ fps[b]).bit_count() <= 2 or common and 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_stages(spark, tmp_path):
    """Every stage against plain Python, each on what its predecessor kept."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, was = docs, {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, before, SF)
        assert docs.columns == list(DOC_COLUMNS)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        texts = {r.doc_id: r.text for r in docs.collect()}
        now = set(texts)
        assert docs.count() == len(now) and now <= kept
        if name == "language_id":
            dicts = langid.fit(before.where(~held_out(before.doc_id)))
            assert now == {i for i, t in was.items() if not plain_language(t, dicts)[1]}
        if name == "toxicity":
            model = toxicity.fit(before, labels.where(~held_out(labels.doc_id)))
            assert now == {i for i, t in was.items() if plain_score(t or "", model) < 0.7}
        if name == "line_dedup":
            assert now == kept
            order = sorted(was)
            assert [texts[i] for i in order] == brute_lines([was[i] for i in order], linededup.MIN_WORDS)
        if name == "simhash_near_dedup":
            assert now == set(plain_groups(was).values())
        kept = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(map(tuple, packed[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(want)
    for _, b in packed.sort_values("offset").groupby("sequence_id"):
        assert (b.offset.to_numpy() == np.concatenate([[0], np.cumsum(b.length)[:-1]])).all() and b.length.sum() <= 2048
    assert corpus_pipeline.run(spark, SF).count() == len(packed)


ODD_DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_tables(spark, tmp_path):
    """Null ids, texts and languages, repeated rows, empty texts, clashing columns; tables without rows."""
    real = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, "no id", "en", "s", 5), (None, None, None, None, None), (9_001, None, "en", "s", 0), (9_002, "", "en", "s", 0), (9_003, "...", "en", "s", 3)], ODD_DOCS)
    rows = real.limit(60).union(real.limit(3)).union(odd)
    folder = str(tmp_path)
    extra = {c: F.lit(1) for c in ("h", "rn", "fp", "th", "pid", "m", "toxic", "score", "_text", "_letters", "length", "salt")}
    rows.withColumns(extra).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            got = stage(spark, some, folder)
            n = got.count()
            assert n >= some.count() if name == "best_fit_packing" else n <= some.count()
            if name != "best_fit_packing":
                assert got.columns == list(DOC_COLUMNS)
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_contract_values(spark):
    """Held-out marks, folds and ids of the queries, row by row."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for name in ("op7_language_id", "op9_toxicity"):
        got = QUERIES[name](spark, SF).collect()
        assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
        if name == "op9_toxicity":
            assert all(r.predicted == (r.score >= 0.7) for r in got)
        else:
            learned = {d.lang for i, d in docs.items() if d.lang and zlib.crc32(str(i).encode()) % 3 != 1}
            assert {r.lang_pred for r in got} <= learned | {"und"}
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i] or "", i)
    for r in QUERIES["op3_warc"](spark, SF).collect():
        raw = (pages[r.page_id] or "").encode()
        own = first[pages[r.page_id] or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if own == r.page_id else ("revisit", own))
    for r in QUERIES["op2_media"](spark, SF).collect():
        raw = (docs[r.doc_id].text or "").encode()
        pay = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
    rows = QUERIES["op5_simhash"](spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{simhash.fingerprint(d.text):016x}" for i, d in docs.items()}
    want = brute_components({i: simhash.fingerprint(d.text) for i, d in docs.items()})
    assert {r.doc_id: r.component_id for r in rows} == want
    for r in QUERIES["op10_html_text"](spark, SF).collect():
        assert r.n_chars == len(r.text) and r.text == htmltext.main_text(pages[r.page_id])
