"""Mixing sources to target weights by repeating documents.

Sources are ordered by code point, null last, and weigh 5, 2, 1, 5, 2, 1 and so on. Together they get ``share`` times all
words; a target stops at ``cap`` times its source's words and the excess goes to the others by weight. A document is
emitted floor(rate) times, rate = target / words of the source, and once more by a Bernoulli draw whose probability is the
fraction. The draw's number is made of a hash of doc_id and text and of the source's seed. Each source takes the one of
``seeds`` seeds whose draws bring its words nearest to its target, as a few long documents can carry a source far off; all
seeds are tried in the one pass that counts the words. Of n rows that agree in id and text, the share of extra copies is
drawn together, n times the fraction rounded up or down, and given to the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catsim.llm.storage import column, write_table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEEDS = 32


def n_words(text: str = "text") -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key() -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary"))


def _number(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 digest in hexadecimal."""
    return F.conv(F.left(key, F.lit(13)), 16, 10).cast("long") * F.lit(2.0**-52)


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size): one row for each source, which is all that the windows see.

    Filling in the order of cap / weight, a source is capped if what is left gives it its cap or more. The windows hold
    all sources in one task: some million rows of a name and a few numbers at most, however many documents there are.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    limit = F.col("source_size") * F.lit(cap)
    order = Window.orderBy("ratio", "rank")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = totals.withColumn("rank", rank).withColumn("weight", weight).withColumn("ratio", limit / F.col("weight"))
    before = F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("level", (F.lit(share) * F.sum("source_size").over(whole) - before) / left)
    level = F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), ignorenulls=True).over(whole)
    found = filled.withColumn("final", level)
    target = F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("final")), limit).otherwise(F.col("final") * F.col("weight"))
    return found.select("source", "source_size", target.alias("target"))


def _extras(key: Column, n: Column, part: Column, shift: Column) -> Column:
    """How many of n rows of a key get an extra copy: a Bernoulli draw for one, their share rounded up or down for more."""
    number = _number(key) + shift
    return F.floor(n * part + (number - F.floor(number))).cast("long")


def mixing_plan(sized: DataFrame, seeds: int = SEEDS, **params) -> tuple[DataFrame, DataFrame]:
    """What (key, source, size) of all documents says of their copies, as two written tables.

    (source, source_size, target, whole, part, shift) of each source, shift being its seed's; and (key, source, extras), the
    number of extra copies of the rows of a key that several rows have.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = write_table(source_targets(sized, **params).withColumn("whole", F.floor(rate)).withColumn("part", rate - F.floor(rate)), "rates")
    # Rows of one key but different sources are drawn apart.
    keys = write_table(sized.groupBy("key", "source").agg(F.first("size").alias("size"), F.count("*").alias("n")), "keys")
    of_source = rated.select(F.col("source").alias("of"), "part")
    tried = keys.where("size > 0").join(of_source, F.col("source").eqNullSafe(F.col("of")))
    taken = lambda k: F.sum(F.col("size") * _extras(F.col("key"), F.col("n"), F.col("part"), F.lit(k / seeds)))
    sums = tried.groupBy(F.col("source").alias("of")).agg(F.array(*map(taken, range(seeds))).alias("taken"))
    off = F.transform("taken", lambda x, k: F.struct(F.abs(x - F.col("part") * F.col("source_size")).alias("off"), k.alias("k")))
    shift = F.coalesce(F.array_min(off)["k"] / F.lit(float(seeds)), F.lit(0.0))
    chosen = rated.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
    plan = write_table(chosen.select("source", "source_size", "target", "whole", "part", shift.alias("shift")), "plan")
    of_source = plan.select(F.col("source").alias("of"), "part", "shift")
    extras = _extras(F.col("key"), F.col("n"), F.col("part"), F.col("shift")).alias("extras")
    many = keys.where("n > 1").join(of_source, F.col("source").eqNullSafe(F.col("of"))).select("key", "source", extras)
    return plan, write_table(many, "many")


def _same(left: DataFrame, right: DataFrame) -> Column:
    return (left["key"] == right["key"]) & left["source"].eqNullSafe(right["source"])


def _first_rows(rows: DataFrame, many: DataFrame) -> DataFrame:
    """(key, source, upto): the last of a key's rows that gets an extra copy, -1 for none, from a written table (key, source, row).

    Rows are counted by key and task first, so that only the rows of one task are ever ranked together.
    """
    group = ["key", "source", "task"]
    known = rows.join(many, _same(rows, many)).select(rows["key"], rows["source"], "row", "extras", F.shiftright("row", 33).alias("task"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = known.groupBy(*group).agg(F.first("extras").alias("extras"), F.count("*").alias("n")).withColumn("before", before)
    last = tasks.where("extras <= before + n and (before < extras or before = 0 and extras = 0)").select(*group, (F.col("extras") - F.col("before")).alias("nth"))
    last = last.select(*[F.col(c).alias(f"l_{c}") for c in last.columns])
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("row"))
    own = (F.col("key") == F.col("l_key")) & F.col("source").eqNullSafe(F.col("l_source")) & (F.col("task") == F.col("l_task"))
    ranked = known.join(last, own).withColumn("rank", rank).where("rank = greatest(l_nth, 1)")
    return ranked.select("key", "source", F.when(F.col("l_nth") > 0, F.col("row")).otherwise(F.lit(-1)).alias("upto"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size"), _key().alias("key"), F.monotonically_increasing_id().alias("row"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (key, source, ...) with ``of``, the plan of their source."""
    of = plan.select(F.col("source").alias("of_source"), F.struct("source_size", "target", "whole", "part", "shift").alias("of"))
    return rows.join(of, rows["source"].eqNullSafe(F.col("of_source"))).drop("of_source")


def _copies() -> Column:
    return (F.col("of.whole") + _extras(F.col("key"), F.lit(1), F.col("of.part"), F.col("of.shift"))).cast("int")


def _copies_of_equals() -> Column:
    return (F.col("of.whole") + (F.col("row") <= F.col("upto")).cast("int")).cast("int")


def _settle_equals(stored: DataFrame, many: DataFrame) -> DataFrame:
    """Stored rows of keys that several rows have, with ``upto``."""
    upto = _first_rows(stored, many).select(F.col("key").alias("up_key"), F.col("source").alias("up_source"), "upto")
    return stored.join(upto, (stored["key"] == F.col("up_key")) & stored["source"].eqNullSafe(F.col("up_source"))).drop("up_key", "up_source")


def mix_report(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs`` (doc_id, text, source).

    A null text has size 0 and a null source is a source of its own. Rows that share an id, or have none, are drawn by
    their texts; equal rows share their extra copies out. A source without words has target 0; a very long text is one
    document, so it may carry a small source off its target. An empty table gives no rows; further columns are ignored.
    """
    sized = write_table(_sized(docs), "sizes")
    plan, many = mixing_plan(sized, **params)
    rows = _with_plan(sized, plan)
    single, equal = rows.withColumn("copies", _copies()), None
    if not many.isEmpty():
        single = single.join(many, _same(single, many), "left_anti")
        equal = _settle_equals(rows.join(many, _same(rows, many), "left_semi"), many).withColumn("copies", _copies_of_equals())
    both = single if equal is None else single.unionByName(equal, allowMissingColumns=True)
    return both.select("doc_id", "size", F.col("of.source_size").alias("source_size"), F.col("of.target").alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with unchanged columns, whatever their names.

    Nulls, shared ids, equal rows, very long texts and empty tables are as in `mix_report`.
    """
    plan, many = mixing_plan(write_table(_sized(docs), "sizes"), **params)
    row = F.struct(*map(column, docs.columns)).alias("doc")
    keyed = docs.select(row, F.col("source").cast("string").alias("source"), _key().alias("key"))
    single, equal = keyed, None
    if not many.isEmpty():
        single = keyed.join(many, _same(keyed, many), "left_anti")
        # Rows have no order of their own: they are numbered once, and the numbers written with them.
        stored = write_table(keyed.join(many, _same(keyed, many), "left_semi").withColumn("row", F.monotonically_increasing_id()), "equal")
        equal = _with_plan(_settle_equals(stored, many), plan).select("doc", _copies_of_equals().alias("copies"))
    made = _with_plan(single, plan).select("doc", _copies().alias("copies"))
    both = made if equal is None else made.unionByName(equal)
    return both.select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc.*")


#: All ids differ in `documents`, so the SQL knows no equal rows.
ORACLE_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')) AS key
    FROM documents
), total AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM total
), weighed AS (
    SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rank - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked
), filled AS (
    SELECT *, cap / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed WINDOW w AS (ORDER BY cap / weight, rank)
), plan AS (
    SELECT source AS of, source_size, CASE WHEN final IS NULL OR ratio <= final THEN cap ELSE final * weight END AS target,
        CASE WHEN source_size > 0 THEN CASE WHEN final IS NULL OR ratio <= final THEN cap ELSE final * weight END / source_size ELSE 0.0::DOUBLE END AS rate
    FROM (SELECT *, (SELECT level FROM filled WHERE ratio > level ORDER BY ratio, rank LIMIT 1) AS final FROM filled)
), rated AS (
    SELECT doc_id, size, source, source_size, target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part, ('0x' || key[1:13])::BIGINT * power(2.0::DOUBLE, -52) AS number
    FROM sized JOIN plan ON source IS NOT DISTINCT FROM of
), tried AS (
    SELECT *, k, floor(part + (number + k / 32.0::DOUBLE - floor(number + k / 32.0::DOUBLE)))::BIGINT AS extra FROM rated, range(32) AS seed(k)
), off AS (
    SELECT source, k, abs(sum(size * extra)::BIGINT - any_value(part) * any_value(source_size)) AS off FROM tried GROUP BY source, k
), seed AS (
    SELECT source, arg_min(k, (off, k)) AS best FROM off GROUP BY source
)
SELECT doc_id, size, source_size, target, size * (whole + extra) AS taken
FROM tried JOIN seed ON tried.source IS NOT DISTINCT FROM seed.source AND k = best
"""
