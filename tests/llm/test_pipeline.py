from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from catsim.llm import langid, mixing, neardup, pii
from catsim.llm.storage import write_table

WORDS = {
    "en": "the of and to in is that for it with as was on be by this had not are but from or have an they which one you were all her she there would their".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am".split(),
}
CLASHING = ("_key", "score", "lang_pred", "class_id", "hash", "n", "id", "ids", "words", "size", "target", "taken", "spans", "start", "length", "sequence_id", "text_")


def _documents(spark):
    """Distinct texts in two languages, near and exact copies, and rows with nulls, no letters or very long texts."""
    import random

    r = random.Random(5)
    rows = [(i, " ".join(r.choice(WORDS[lang]) + r.choice(["", "s", "en", "x"]) for _ in range(60 + i % 40)), lang, f"s{i % 3}") for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(1000 + i, rows[4][1] + f" tail{i}", "en", "s0") for i in range(20)]
    rows += [(1100 + i, rows[7][1], "de", None) for i in range(20)]
    rows += [(2000, None, "en", "s0"), (2001, "", "en", "s0"), (2002, "12 34 !?", "en", "s0"), (2003, "write to ann@example.com " + rows[10][1], None, "s1"), (2004, "the of and to " * 8000, "en", "s2"), (None, rows[12][1] + " the end of it", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    return docs.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3)


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = write_table(_documents(spark), "documents")
    columns = docs.columns
    told = langid.keep_known(docs)
    kept = {r.doc_id for r in told.collect()}
    assert told.columns == columns and not kept & {2000, 2001, 2002} and {None, 2003, 2004} <= kept and len(kept) >= 160
    told = write_table(told, "told")
    single = neardup.keep_one(told)
    assert single.columns == columns
    ids = Counter(r.doc_id for r in single.collect())
    assert max(ids.values()) == 1 and sum(i in ids for i in (4, *range(1000, 1020))) == 1 and sum(i in ids for i in (7, *range(1100, 1120))) == 1
    assert set(range(0, 120)) - {4, 7, 10, 12} <= set(ids)
    single = write_table(single, "single")
    clean = pii.redact_documents(single)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == columns and texts.keys() == ids.keys() and not any("@" in t for t in texts.values())
    mixed = mixing.mix_documents(write_table(clean, "clean"))
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(copies) <= set(texts) and max(copies.values()) <= 2


def test_run(spark, tmp_path):
    docs = _documents(spark)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    held = {p.doc_id for p in pieces}
    assert len([i for i in held if i in (4, *range(1000, 1020))]) <= 1 and not held & {2000, 2001, 2002}
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in by_sequence.values():
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0 and sum(spans[-1]) <= 4096
    again = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert Counter((p.doc_id, p.length) for p in again)[None, -1] == 0 and sum(p.length for p in again) == sum(p.length for p in pieces)


def test_stages_on_an_empty_table(spark):
    docs = _documents(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
