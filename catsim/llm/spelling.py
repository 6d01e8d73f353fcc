"""Spelling variants: words one edit apart, the more frequent one as the form of the rarer.

A word is cut into two segments. If one code point is inserted, deleted or replaced, one segment stays whole, at its own
end of the other word. So shards, each an Aho-Corasick automaton, hold the segments of every word; all words are scanned
for them, and a hit counts if the segment lies at its end of the scanned word, the lengths differ by one at most, and the
distance is one. A word is scanned by the shards that may hold a segment of its, found by hashing its beginnings and ends
of the few lengths that such segments have.

Where very many words of one length share a segment, they hold it together with one half of their other segment instead, in
two shards, and are scanned accordingly; the edit then lies in the half that is left. That changes where pairs are found
and not which. What the segments of a word leave open is looked up by its own text and by that without one code point, so
words that share a segment are not compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catsim.llm.crc_sql import TABLE, crc32
from catsim.llm.storage import bounded, drop_table, write_table
from catsim.operators.joins import spread_join

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LETTERS, MIN_COUNT, RATIO, EVERY = 6, 5, 5, 199
#: Segments of a shard, and words of one length that may share one before it is held in two longer parts.
SHARD_SEGMENTS, COMMON = 20_000, 5_000
ENTRY = "struct<head: int, tail: int>"


def with_slips(docs: DataFrame, every: int = EVERY) -> DataFrame:
    """(word) for every run of letters of each text, lower-cased in A-Z; runs whose CRC-32 with the id is a multiple of ``every``
    lack one code point. A null text has none, and a null id counts as an empty one."""
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    # Shorter runs and, without a code point, those of MIN_LETTERS are no words; they go before the digest is made.
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.where(F.length("run") >= MIN_LETTERS).select(F.when(h % every == 0, slipped).otherwise(F.col("run")).alias("word"))


def count_words(words: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words of enough code points and occurrences. Each task counts before anything is shuffled."""
    return words.where(F.length("word") >= min_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _shapes(length: Column, deep: bool) -> list[Column]:
    """(head, tail): how many code points at both ends of a word of ``length`` a shard holds; the rest may differ."""
    half = F.call_function("div", length, F.lit(2)).cast("int")
    rest = length - half
    pair = lambda head, tail: F.struct(head.cast("int").alias("head"), tail.cast("int").alias("tail"))
    none = F.lit(0)
    if not deep:
        return [pair(half, none), pair(none, rest)]
    part = lambda n: F.call_function("div", n, F.lit(2))
    return [pair(half + part(rest), none), pair(half, rest - part(rest)), pair(part(half), rest), pair(none, rest + half - part(half))]


def _key(word: Column, length: Column, shape: Column) -> Column:
    """What decides the shard: the length and the two held ends."""
    n = F.length(word)
    return F.concat_ws("/", length, F.substring(word, F.lit(1), shape["head"]), F.substring(word, n - shape["tail"] + 1, shape["tail"]))


def _held(words: DataFrame, common: int) -> tuple[DataFrame, DataFrame]:
    """(word, n, shapes) with the shapes in which each word is held, and the keys that too many words of one length share."""
    n = F.length("word")
    keys = [_key(F.col("word"), n, s) for s in _shapes(n, False)]
    sides = words.select("word", "n", F.explode(F.array(*keys)).alias("key"))
    hot = write_table(sides.groupBy("key").agg(F.count("*").alias("words")).where(F.col("words") > common).select("key"), "common")
    found = words.select("word", "n", keys[0].alias("first"), keys[1].alias("second"))
    for side in ("first", "second"):
        known = hot.select(F.col("key").alias(side), F.lit(True).alias(f"{side}_hot"))
        found = spread_join(found, known, [side], "word", "left")
    plain, deep = _shapes(n, False), _shapes(n, True)
    pick = lambda hot, i: F.when(F.col(hot), F.array(*deep[2 * i : 2 * i + 2])).otherwise(F.array(plain[i]))
    return found.select("word", "n", F.concat(pick("first_hot", 0), pick("second_hot", 1)).alias("shapes")), hot


def _asked(words: DataFrame, shards: int, common: DataFrame) -> DataFrame:
    """(shard, word): each word with the shards that may hold a segment of one that is near it. Where there are common keys
    both kinds of shapes are asked for, since which of them a near word has hangs on how common its segments are."""
    n = F.length("word")
    kinds = (False,) if common.isEmpty() else (False, True)
    keys = [_key(F.col("word"), n + d, s) for d in (-1, 0, 1) for deep in kinds for s in _shapes(n + d, deep)]
    return words.select("word", F.explode(F.array_distinct(F.transform(F.array(*keys), lambda k: _shard(k, shards)))).alias("shard"))


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point lies between two texts."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _without_one(text: str) -> list[str]:
    return list(dict.fromkeys(text[:i] + text[i + 1 :] for i in range(len(text))))


class Shard:
    """An automaton over segments; each leads to the words that hold it, by length and shape and by what the shape leaves open."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        self.segments: dict[str, dict[tuple[int, int, int], tuple[dict, dict]]] = {}

    def add(self, word: str, n: int, head: int, tail: int, earlier: list[tuple[int, int]]) -> None:
        """Hold ``word`` by its longer end of this shape. Pairs that an ``earlier`` shape of the word finds are left to it."""
        size = len(word)
        segment = word[:head] if head >= tail else word[size - tail :]
        whole, shorter = self.segments.setdefault(segment, {}).setdefault((size, head, tail), ({}, {}))
        entry, open_part = (word, n, earlier), word[head : size - tail]
        whole.setdefault(open_part, []).append(entry)
        for part in _without_one(open_part):
            shorter.setdefault(part, []).append(entry)

    def close(self) -> None:
        for segment, held in self.segments.items():
            self.automaton.add_word(segment, (segment, held))
        if self.segments:
            self.automaton.make_automaton()

    def near(self, word: str) -> list[tuple[str, int]]:
        """(word, n) of the held words one edit from ``word`` that this shard has to report."""
        if not self.segments:
            return []
        size, found = len(word), {}
        for end, (segment, held) in self.automaton.iter(word):
            first, last = end + 1 == len(segment), end + 1 == size
            if not first and not last:
                continue
            for (length, head, tail), (whole, shorter) in held.items():
                if abs(length - size) > 1 or head + tail > size or not (first if head >= tail else last):
                    continue
                part = word[head : size - tail]
                if length < size:
                    entries = [e for p in _without_one(part) for e in whole.get(p, ())]
                elif length > size:
                    entries = shorter.get(part, ())
                else:
                    entries = [e for p in _without_one(part) for e in shorter.get(p, ())]
                for other, n, earlier in entries:
                    kept = lambda h, t, o=other: h + t <= size and word.startswith(o[:h]) and word.endswith(o[len(o) - t :])
                    if kept(head, tail) and not any(kept(*shape) for shape in earlier) and one_edit(word, other):
                        found[other] = n
        return list(found.items())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of shard and kind: the segments of a shard and then the words that it scans."""
    number, shard, ready = None, Shard(), False
    for batch in bounded(batches, 2):
        columns: tuple[list, ...] = ([], [], [], [])
        for at, kind, word, n, head, tail, earlier in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != number:
                number, shard, ready = at, Shard(), False
            if not kind:
                shard.add(word, n, head, tail, [(s["head"], s["tail"]) for s in earlier])
                continue
            if not ready:
                shard.close()
                ready = True
            found = shard.near(word)
            if found:
                best_n = max(n for _, n in found)
                for column, value in zip(columns, (word, len(found), best_n, min(w for w, n in found if n == best_n)), strict=True):
                    column.append(value)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, shard_segments: int = SHARD_SEGMENTS, common: int = COMMON) -> DataFrame:
    """(word, n_near, best_n, best) of each word of ``words`` (word, n), all different, that has near ones: their number, and the
    most frequent of them (of equals the least by code point)."""
    held, keys = _held(words, common)
    held = write_table(held, "held")
    shards = max(1, -(-(held.agg(F.sum(F.size("shapes"))).first()[0] or 0) // shard_segments))
    parts = held.select("word", "n", "shapes", F.posexplode("shapes").alias("nth", "shape"))
    earlier = F.slice("shapes", F.lit(1), F.col("nth"))
    segments = parts.select(_shard(_key(F.col("word"), F.length("word"), F.col("shape")), shards).alias("shard"), F.lit(0).alias("kind"), "word", "n", "shape.head", "shape.tail", earlier.alias("earlier"))
    empty = F.lit(None)
    asked = _asked(words, shards, keys).select("shard", F.lit(1).alias("kind"), "word", empty.cast("long").alias("n"), empty.cast("int").alias("head"), empty.cast("int").alias("tail"), empty.cast(f"array<{ENTRY}>").alias("earlier"))
    dealt = segments.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(_scan, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def follow_forms(words: DataFrame) -> DataFrame:
    """(word, root) of ``words`` (word, form), all different: the end of the chain of forms, which has no cycle.

    Each round jumps twice as far as the one before; a root that many words share is dealt many ways.
    """
    roots = write_table(words.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        # A word that is its own root leads nowhere; only the others are looked up.
        up = roots.where("root <> word").select(F.col("word").alias("root"), F.col("root").alias("top"))
        new = write_table(spread_join(roots, up, ["root"], "word", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        drop_table(roots)
        roots = new.select("word", "root")
        if new.where("moved").isEmpty():
            return roots


def spelling_forms(words: DataFrame, ratio: int = RATIO, shard_segments: int = SHARD_SEGMENTS, common: int = COMMON) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word, n): the words of a vocabulary, all different.

    The form of a word is the most frequent word one edit away (of equals the least by code point), if it is ``ratio`` times
    as frequent as the word, and else null. root is where following the forms ends: the word itself if it has none. Words
    that are null take no part, words of fewer than four code points have no near ones looked for, and none gives no rows.
    """
    known = words.select("word", "n").where("word is not null")
    near = near_words(known.where(F.length("word") > 3), shard_segments, common)
    told = known.join(near, "word", "left")
    enough = F.col("best_n") >= F.col("n") * ratio
    forms = write_table(told.select("word", F.when(enough, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best_n")).alias("form_n")), "forms")
    return forms.join(follow_forms(forms), "word").select("word", "form", "root", "n", "n_near", "form_n")


def variant_report(docs: DataFrame) -> DataFrame:
    """`spelling_forms` of the words of all texts of ``docs`` (doc_id, text), with slips made in some (`with_slips`).

    Null and empty texts have no words; a very long text is split into rows where it is read. Rows that share an id slip
    alike, equal rows count as often as they are there, and further columns are ignored.
    """
    return spelling_forms(write_table(count_words(with_slips(docs)), "words"))


#: Words near each other agree in what is left of both without one code point at the same place, or one is the other without one.
ORACLE_SQL = rf"""
WITH RECURSIVE {TABLE}, run AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents
), counted AS (
    SELECT doc_id, run, count(*) AS times FROM run GROUP BY doc_id, run
), hashed AS (
    SELECT run, times, {crc32("doc_id || ':' || run")} AS h FROM counted, crc
), slipped AS (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed
), word AS (
    SELECT word, sum(times)::BIGINT AS n FROM slipped GROUP BY word HAVING length(word) >= 6 AND sum(times) >= 5
), gap AS (
    SELECT word, n, i, left(word, i::INT) || substring(word, i::INT + 2) AS rest FROM word, LATERAL (SELECT unnest(range(length(word))) AS i)
), pair AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM gap a JOIN gap b USING (i, rest) WHERE a.word <> b.word
    UNION SELECT gap.word, word.word, word.n FROM gap JOIN word ON rest = word.word
    UNION SELECT word.word, gap.word, gap.n FROM gap JOIN word ON rest = word.word
), best AS (
    SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pair GROUP BY word
), formed AS (
    SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
    FROM word LEFT JOIN best USING (word)
), path AS (
    SELECT word, word AS at FROM formed
    UNION ALL SELECT path.word, formed.form FROM path JOIN formed ON path.at = formed.word WHERE formed.form IS NOT NULL
)
SELECT formed.word, formed.form, path.at AS root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN path ON path.word = formed.word JOIN formed AS ends ON ends.word = path.at WHERE ends.form IS NULL
"""
