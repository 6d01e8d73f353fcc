"""Cases that all operators share: odd column names, text ids, shared ids, slices of odd texts, the session's settings."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catsim.llm import langid, media, mixing, neardup, packing, pii, quality, storage, substring, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "pack": lambda d: packing.pack_documents(d, PATH),
    "judge": quality.judge,
    "identify": langid.identify,
    "media": lambda d: media.media_digests(media.media_columns(d)),
    "substring": substring.removal_digests,
    "full": substring.remove_repeats,
    "near": neardup.near_duplicate_classes,
    "mix": mixing.mix_report,
    "pii": pii.span_digests,
}
STAGES = {"known": langid.keep_known, "one": neardup.keep_one, "redact": pii.redact_documents, "mixed": mixing.mix_documents}
ODD = ("a.b", "_copy", "_plan", "doc", "of", "key", "row", "draw", "told", "extra", "way", "Text`s", "copies", "known")


def _docs(spark, rows, kind="long"):
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string")


def _rows(n=40):
    r = random.Random(3)
    words = "the of and to in is that for it with".split()
    return [(i, " ".join(r.choice(words) for _ in range(r.randint(5, 80))), "en", f"s{i % 3}") for i in range(n)]


@pytest.mark.parametrize("name", OPERATORS)
def test_text_ids_keep_their_type(spark, name):
    docs = _docs(spark, [(f"doc-{i}", *rest) for i, *rest in _rows()] + [(None, "a b", None, None), ("", None, "en", "s0")], "string")
    got = OPERATORS[name](docs)
    assert dict(got.dtypes)["doc_id"] == "string" and {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_odd_columns(spark, name):
    docs = _docs(spark, _rows()).withColumns({c: F.concat(F.lit(c), "doc_id") for c in ODD})
    got = STAGES[name](docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) >= 10 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in ODD)


def test_operators_leave_the_session_alone(spark):
    before = spark.conf.getAll
    docs = _docs(spark, _rows(10))
    for run in (*OPERATORS.values(), *STAGES.values()):
        run(docs)
    assert spark.conf.getAll == before


@pytest.mark.parametrize("texts", [[None], [""], ["日本語 テキスト"], [None, "", " \n"], ["中文文本 没有 拉丁 词", "中文"], ["🙂"]])
def test_slices_without_a_plain_word(spark, texts):
    docs = _docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]).coalesce(1)
    tok = Tokenizer.from_file(PATH)
    got = {p.doc_id: p.doc_tokens for p in packing.pack_documents(docs, PATH).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_either_tokenizer(name):
    path = public_tokenizers.path(name)
    words, tok = packing.WordIds(path), Tokenizer.from_file(path)
    texts = ["Hello  World's\tnaïve x1y2", "日本語", "", "a\nb  c ", "<|endoftext|> it's"]
    assert [np.frombuffer(b, "<u4").tolist() for b in words.ids([t.encode() for t in texts])] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert words.by_word == (name == "word_bpe_49k.json")


def test_best_fit_against_a_plain_simulation(spark):
    """One task, windows of 8 tokens, three open: the plain rule places every document where the operator does."""
    r = random.Random(6)
    rows = [(i, " ".join(["a"] * r.randint(0, 6)), "en", "s") for i in range(60)]
    got = packing.pack_documents(_docs(spark, rows).coalesce(1), PATH, 8, 3).collect()
    open_, closed = [], []
    for i, text, *_ in rows:
        n = len(text.split()) + 1
        room = [w for w in open_ if sum(x[1] for x in w) + n <= 8]
        if not room:
            if len(open_) == 3:
                full = max(open_, key=lambda w: sum(x[1] for x in w))
                open_.remove(full)
                closed.append(full)
            open_.append([])
            room = [open_[-1]]
        best = max(room, key=lambda w: sum(x[1] for x in w))
        best.append((i, n))
        if sum(x[1] for x in best) == 8:
            open_.remove(best)
            closed.append(best)
    sequences = defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.doc_id))
    made = {tuple(i for _, i in sorted(s)) for s in sequences.values()}
    assert {tuple(i for i, _ in w) for w in closed} <= made and len(made) <= len(closed) + len(open_)


@pytest.mark.parametrize("unit", ["x://", "token", "secret=", "://", "a@b.", "1.", "+1", "account ", "x://@", "a@"])
def test_a_megabyte_of_anchors_takes_linear_time(unit):
    def seconds(n):
        text = unit * (n // len(unit))
        return min(_timed(pii.find_spans, text) for _ in range(2))

    assert seconds(400_000) < 5 * seconds(100_000) + 0.5


def _timed(fn, *args):
    began = time.perf_counter()
    fn(*args)
    return time.perf_counter() - began


def test_cues_and_ibans():
    text = "apiKey = 'abcd1234efgh' IBAN: GB29 NWBK 6016 1331 9268 19, account token only, iban DE00 1234"
    got = {text[a:b] for k, a, b in pii.find_spans(text) if k == "account"}
    assert got == {"abcd1234efgh", "GB29 NWBK 6016 1331 9268 19"}
    assert pii.iban("DE44500105175407324931") and not pii.iban("DE44500105175407324932")


def test_numbers_that_no_card_starts_with_stay():
    text = "order 1232810148878564 card 4111 1111 1111 1111 and 2223000048400011"
    assert [k for k, *_ in pii.find_spans(text)] == ["card"] * 3
    assert pii.redact(text) == "order 1232810148878564 card <CARD> and <CARD>"


@pytest.mark.parametrize("same_text", [True, False])
@pytest.mark.parametrize("ids", ["null", "one", "own"])
def test_targets_where_ids_are_shared(spark, ids, same_text):
    """Sources of 1000 rows with one id, none, or one each, and equal or different texts, come within 2 % of their targets."""
    r = random.Random(9)
    text = lambda: " ".join(r.choice("abcdefgh") for _ in range(10))
    one = text()
    rows = [({"null": None, "one": 7, "own": i}[ids], one if same_text else text() + f" {i}", "en", s) for i, s in enumerate("abc" * 1000)]
    docs = _docs(spark, rows).repartition(4)
    report = mixing.mix_report(docs).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(g.taken - g.target) <= 0.02 * g.target for g in report) and len(report) >= 2
    mixed = mixing.mix_documents(docs)
    assert mixed.count() * (10 + (not same_text)) == sum(g.taken for g in report)


def test_extra_copies_are_fair(spark):
    """Over many ids, a document's extra copy comes with the probability of the fraction, short or long."""
    rows = [(i, " ".join(["w"] * (1 + i % 5)), "en", "ab"[i % 2]) for i in range(20000)]
    got = mixing.mix_report(_docs(spark, rows), weights=(1, 1), share=1.3).collect()
    by = defaultdict(list)
    for g in got:
        by[g.size].append(g.taken / g.size)
    assert set(Counter(x for v in by.values() for x in v)) == {1.0, 2.0}
    assert all(abs(sum(v) / len(v) - 1.3) < 0.025 for v in by.values())


def test_many_sources(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("host"), F.col("id") % 10000).alias("source"))
    report = mixing.mix_report(docs).agg(F.sum("taken").alias("t"), F.count("*").alias("n")).first()
    assert report.n == 20000 and abs(report.t - 1.5 * 60000) < 0.02 * 90000


def test_keep_one_keeps_every_text(spark):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base, "en", "s"), (1, "other words of the same id here", "en", "s"), (1, "yet another quite different text", "en", "s"), (2, base, "en", "s"), (2, base, "en", "s"), (3, None, "en", "s"), (3, "", "en", "s")]
    kept = neardup.keep_one(_docs(spark, rows).repartition(3)).collect()
    assert Counter((k.doc_id, k.text) for k in kept) == Counter({(1, rows[0][1]): 1, (1, rows[1][1]): 1, (1, rows[2][1]): 1, (3, None): 1, (3, ""): 1})


def test_samples_are_bounded(spark):
    rows = spark.range(5000).select(F.lit(1).alias("doc_id"), F.when(F.col("id") % 2 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = storage.bounded_sample(rows.repartition(3), ["doc_id", "text"], 200)
    again = storage.bounded_sample(rows.repartition(5), ["doc_id", "text"], 200)
    assert got.count() == 200 and {r.text for r in got.collect()} == {r.text for r in again.collect()}
    assert storage.bounded_sample(rows.limit(0), ["doc_id"], 5).count() == 0


def test_equal_rows_do_not_thin_a_sample(spark):
    """3000 different rows and a million equal ones."""
    rows = spark.range(1_003_000).select(F.lit(1).alias("doc_id"), F.greatest("id", F.lit(1_000_000)).cast("string").alias("text"))
    got = storage.bounded_sample(rows, ["doc_id", "text"], 2000)
    assert got.count() == 2000 == got.distinct().count()
    hashes = sorted(spark.range(1_000_000, 1_003_000).select((F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col("id").cast("string"), F.lit(0)), 11) * F.lit(2.0**-53)).alias("h"), "id").collect())
    assert {r.text for r in got.collect()} == {str(r.id) for r in hashes[:2000]}


def test_languages_are_known_where_one_row_is_repeated(spark):
    """Four languages of 60 texts each, and one of the texts 200,000 times."""
    r = random.Random(8)
    words = {"en": "the and with of that", "de": "der und ung schön für", "fr": "le et avec été pour", "es": "el y con año para"}
    rows = [(i, " ".join(r.choice(w.split()) for _ in range(12)), x, "s") for i, (x, w) in enumerate(sorted(words.items()) * 60)]
    docs = _docs(spark, rows)
    many = docs.unionByName(docs.limit(1).withColumn("text", F.explode(F.array_repeat("text", 200_000))))
    windows, labels, langs = langid.training_windows(many)
    assert langs == sorted(words) and len(labels) == 4 * len(windows) // 4 and min(np.bincount(labels)) >= 200


def test_the_model_does_not_hang_on_the_partitioning(spark):
    docs = _docs(spark, [(None, t, "en" if i % 2 else "de", "s") for i, t, *_ in _rows(60)])
    one, two = (langid.training_windows(docs.repartition(n)) for n in (1, 5))
    assert np.array_equal(one[0], two[0]) and np.array_equal(one[1], two[1]) and one[2] == ["de", "en"]


def test_languages_are_chosen_and_filled_in(spark):
    r = random.Random(2)
    words = {"en": "the and with ing tion of that".split(), "de": "der und ung schön für keit über".split()}
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(40)), x if i % 10 else None, "s") for i in range(200) for x in [r.choice(list(words))]]
    kept = langid.keep_known(_docs(spark, rows), ["de"]).collect()
    assert {k.lang for k in kept} == {"de"} and 60 < len(kept) < 140


def test_contradicting_labels_teach_nothing(spark):
    docs = _docs(spark, _rows(30))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(i, 1 - i % 2) for i in range(10)] + [(None, 1)], "doc_id long, toxic int")
    texts, toxic = toxicity.training_sample(docs, labels)
    assert len(texts) == 10 and toxic.sum() == 5
    assert len(toxicity.training_sample(docs, labels, max_docs=4)[0]) == 4


def test_pages_of_one_template_cost_no_comparison(spark):
    """Pages that share less than the threshold are never dealt to a block, however many a bucket holds."""
    r = random.Random(1)
    template = [f"t{i}" for i in range(200)]
    page = lambda i: " ".join(template[:100] + [f"u{i}x{r.random()}" for _ in range(30)] + template[100:])
    near = [" ".join([*(f"n{i}" for i in range(200)), "end", str(k)]) for k in range(3)]
    docs = spark.createDataFrame([(i, page(i)) for i in range(300)] + [(1000 + k, t) for k, t in enumerate(near)], "doc_id long, text string")
    vectors = neardup._vectors(docs, 5, 0.8, 20, 5).where("fp is not null")
    assert vectors.count() >= 300
    named = vectors.select(F.lit(0).alias("band"), F.lit(0).alias("key"), F.struct("doc_id", "fp").alias("id"), "total", (F.col("shared") * 2.25 - F.col("total")).alias("cap"), F.lit(7).cast("long").alias("group"))
    alone = named.where("id.doc_id < 1000")
    assert neardup._meetings(alone, 0.8).count() == 0 and neardup._meetings(named, 0.8).count() == 1
    classes = {c.doc_id: c.class_id for c in neardup.near_duplicate_classes(docs).collect()}
    assert all(classes[i] == i for i in range(300)) and {classes[1000 + k] for k in range(3)} == {1000}
