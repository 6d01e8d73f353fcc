"""Near-duplicate classes: weighted minwise samples of TF-IDF word shingles, banded, verified by weighted Jaccard.

1. Spark counts the documents of every shingle of the corpus (`packs.count_hashes`), so that weights are
   tf * idf with idf = 1 + 0.25 * ln((1 + N) / (1 + df)) / ln(1 + N), from 1 for a shingle of all documents to 1.25 for a
   new one. The damping keeps a large group of copies, whose common shingles are frequent because of that very group,
   from falling below the threshold.
2. A document whose shingles of df >= 2 hold less than ``threshold`` of its weight has no partner: the weighted Jaccard
   similarity is at most that share. Only the others go on; nothing is lost.
3. Improved consistent weighted sampling draws ``bands * rows`` samples. Equal vectors become one node, which is named by
   its least doc_id, so that the least name of a component is its class.
4. Documents that agree on a band are candidates. Each band bucket first tests its members against its most central
   one. Where a bucket then still holds several components, the nodes outside its largest one are compared with the
   whole bucket, block by block, by matrix products, which return one link for each pair of components. Nodes are dealt
   to blocks by weight, and blocks whose weights and shared weights rule the threshold out never meet: pages of one
   template that share less than the threshold cost no comparison. So the components are those of all candidate pairs
   that reach the threshold, without a row for each pair of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from catsim.llm.graph import connected_components
from catsim.llm.packs import _from_planes, _planes, count_hashes, decode_count, pack_documents, with_counts
from catsim.llm.storage import bounded, column, doc_type, drop_table, free_name, write_table
from catsim.llm.tokens import doc_windows, hash_spans, mix, split_words
from catsim.operators.joins import spread_join

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity 0.8 meets in at least one band with odds of 0.9996.
BANDS = 20
ROWS = 5
BITS = 56
IDF_DAMPING = 0.25
#: Nodes of a bucket that are compared with as many others at once, and columns of the matrices.
BLOCK = 256
COLUMNS = 4096
#: Members of a bucket that meet a copy of its most central node's vector.
HUB_PART = 1024
_MASK = np.uint64((1 << BITS) - 1)
#: Numbers of groups and blocks of a bucket's largest component start here.
_MAIN = 1 << 60
_TABLE = 1 << 16
#: Weights of one class of a bucket differ by less than this factor.
WEIGHT_CLASS = 1.1
VECTOR_SCHEMA = "fp binary, central double, total double, shared double, bands array<long>, n int, vec binary"


def _shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each shingle; a text of fewer words has one shingle of all its words."""
    words = split_words(texts)
    codes = hash_spans(words.buf, words.starts, words.ends)
    h, at = doc_windows(words, codes, width)
    hs, docs = [h & _MASK], [words.doc[at]]
    for n in range(1, width):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            h, at = doc_windows(words, codes, n)
            own = np.isin(words.doc[at], short)
            hs.append(mix(h[own] + np.uint64(n)) & _MASK)
            docs.append(words.doc[at][own])
    return np.concatenate(hs), np.concatenate(docs)


def sampling_tables(seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Draws of Gamma(2, 1), and their logarithms for a second set; made once, so that all tasks use the same bits."""
    rng = np.random.default_rng(seed)
    return rng.gamma(2.0, 1.0, _TABLE), np.log(rng.gamma(2.0, 1.0, _TABLE))


def weighted_samples(h: np.ndarray, weight: np.ndarray, first: np.ndarray, k: int, tables: tuple) -> np.ndarray:
    """Improved consistent weighted sampling: (documents, k) samples as 64-bit values.

    ``first`` has the start of each document. With r, c of Gamma(2, 1) and b of U(0, 1) drawn by (shingle, sample):
    t = floor(ln w / r + b), and the sample is the shingle of least ln c - r (t - b + 1), with its t. That least value is
    a function of shingle, t and sample alone, so its bits stand for the sample.
    """
    gamma, log_c = tables
    log_w = np.log(weight)
    out = np.empty((len(first), k), np.uint64)
    for j in range(k):
        x = mix(h ^ np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & (2**64 - 1)))
        r = gamma[(x & np.uint64(_TABLE - 1)).astype(np.intp)]
        b = ((x >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float64) * 2.0**-24
        t = np.floor(log_w / r + b)
        a = log_c[(x >> np.uint64(48)).astype(np.intp)] - r * (t - b + 1)
        out[:, j] = np.minimum.reduceat(a, first).view(np.uint64)
    return out


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Sum of minima over sum of maxima of two vectors, given as sorted hashes, term frequencies and idf."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float((np.minimum(a[1][i], b[1][j]) * a[2][i]).sum())
    return both / max(float((a[1] * a[2]).sum()) + float((b[1] * b[2]).sum()) - both, 1e-300)


def _encode(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> bytes:
    return _planes(h) + tf.astype("<u4").tobytes() + idf.astype("<f4").tobytes()


def _decode(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tf, idf = np.frombuffer(blob, "<u4", n, 7 * n), np.frombuffer(blob, "<f4", n, 11 * n)
    return _from_planes(blob[: 7 * n], n), tf.astype(np.int64), idf.astype(np.float64)


def _vectors(docs: DataFrame, width: int, threshold: float, bands: int, rows: int) -> DataFrame:
    packs = pack_documents(docs)
    n_docs = packs.agg(F.sum(F.size("doc_ids"))).first()[0] or 0


    def hasher(texts: list[bytes]) -> tuple[np.ndarray, None, np.ndarray]:
        h, doc = _shingles(texts, width)
        return h, None, doc

    counts = count_hashes(packs, hasher, BITS, per_document=True)
    kind, tables = to_arrow_type(docs.schema["doc_id"].dataType), sampling_tables()
    log_n = np.log1p(max(n_docs, 1))

    def vectors(ids: list, texts: list[bytes], codes: np.ndarray) -> pa.Table:
        h, doc = _shingles(texts, width)
        known, which = np.unique(h, return_inverse=True)
        df = decode_count(codes)
        order = np.lexsort((h, doc))
        h, doc, which = h[order], doc[order], which[order]
        at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.empty(0, np.int64)
        tf = np.diff(np.append(at, len(h)))
        h, doc, df = h[at], doc[at], df[which[at]]
        idf = (1 + IDF_DAMPING * (log_n - np.log1p(df)) / log_n).astype(np.float32).astype(np.float64)
        weight = tf * idf
        lo, hi = np.searchsorted(doc, np.arange(len(ids))), np.searchsorted(doc, np.arange(len(ids)), "right")
        total = np.bincount(doc, weight, len(ids))
        shared = np.bincount(doc, weight * (df > 1), len(ids))
        central = np.bincount(doc, weight * np.log2(df), len(ids)) / np.maximum(total, 1e-300)
        live = np.flatnonzero((hi > lo) & (shared >= (threshold - 1e-9) * total) & np.array([i is not None for i in ids], bool))
        fps: list = [None] * len(ids)
        keys: list = [None] * len(ids)
        vecs: list = [None] * len(ids)
        if len(live):
            pick = np.concatenate([np.arange(a, b) for a, b in zip(lo[live], hi[live], strict=True)])
            sizes = (hi - lo)[live]
            first = np.cumsum(sizes) - sizes
            own_h, own_w, own_tf, own_idf = h[pick], weight[pick], tf[pick], idf[pick]
            x = mix(own_h ^ (own_tf.astype(np.uint64) << np.uint64(56)))
            print_1, print_2 = np.add.reduceat(x, first), np.add.reduceat(mix(x + np.uint64(1)), first)
            samples = weighted_samples(own_h, own_w, first, bands * rows, tables).reshape(len(live), bands, rows)
            key = samples[:, :, 0]
            for r in range(1, rows):
                key = mix(key) ^ samples[:, :, r]
            key = mix(key).view(np.int64)
            for n, d in enumerate(live.tolist()):
                s = slice(first[n], first[n] + sizes[n])
                fps[d] = int(print_1[n]).to_bytes(8, "big") + int(print_2[n]).to_bytes(8, "big")
                keys[d] = key[n].tolist()
                vecs[d] = _encode(own_h[s], own_tf[s], own_idf[s])
        return pa.table(
            {
                "doc_id": pa.array(ids, kind),
                "fp": pa.array(fps, pa.binary()),
                "central": pa.array(central, pa.float64()),
                "total": pa.array(total, pa.float64()),
                "shared": pa.array(shared, pa.float64()),
                "bands": pa.array(keys, pa.list_(pa.int64())),
                "n": pa.array(hi - lo, pa.int32()),
                "vec": pa.array(vecs, pa.binary()),
            }
        )

    return write_table(with_counts(packs, counts, vectors, f"doc_id {doc_type(docs)}, {VECTOR_SCHEMA}"), "vectors")


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) among ``pairs`` (id, top, ways): those whose vectors reach the threshold.

    A node is the ``id`` of at most one pair a band, but may be the ``top`` of very many. Such a top meets its members in
    ``ways`` parts, about one for ``HUB_PART`` of them, and its vector is sent once to each. Joined rows come in order of
    their tops, so that a task decodes a top's vector once a part.
    """

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, top = None, None
        for whole in batches:
            for batch in bounded([whole], text=whole.schema.get_field_index("vec")):
                keep, columns = [], [batch.column(c) for c in ("id", "n", "vec", "n_top", "vec_top")]
                for row in zip(*columns, strict=True):
                    member, blob = _decode(row[2].as_py(), row[1].as_py()), row[4].as_buffer()
                    if held is None or not held.equals(blob):
                        held, top = blob, _decode(row[4].as_py(), row[3].as_py())
                    keep.append(weighted_jaccard(member, top) >= threshold - 1e-9)
                links = batch.select(["id", "top"]).filter(pa.array(keep, pa.bool_()))
                yield links.rename_columns(["a", "b"])

    members = nodes.select("id", "n", "vec")
    tops = pairs.select("top", "ways").distinct().join(nodes.select(F.col("id").alias("top"), F.col("n").alias("n_top"), F.col("vec").alias("vec_top")), "top")
    parts = tops.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    met = pairs.join(members, "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("ways")).cast("int")).join(parts, ["top", "ways", "part"])
    kind = nodes.schema["id"].dataType.simpleString()
    return met.select("id", "n", "vec", "top", "n_top", "vec_top").mapInArrow(test, f"a {kind}, b {kind}")


def _overlaps(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """Sum of minima for every node of ``left`` with every node of ``right``, as products of 0/1 matrices.

    A shingle of term frequency f is f columns, so that the product of two columns is the minimum; columns that only
    one node has are left out, and the rest is taken some thousand at a time.
    """

    def cells(nodes: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.concatenate([n[0] for n in nodes])
        tf = np.concatenate([n[1] for n in nodes])
        row = np.repeat(np.arange(len(nodes)), [len(n[0]) for n in nodes])
        level = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
        idf = np.repeat(np.concatenate([n[2] for n in nodes]), tf)
        return mix(np.repeat(h, tf) ^ (level.astype(np.uint64) << np.uint64(56))), np.repeat(row, tf), idf

    (h_l, row_l, idf_l), (h_r, row_r, _) = cells(left), cells(right)
    columns, at = np.unique(h_l, return_index=True)
    common = np.isin(columns, h_r)
    columns, value = columns[common], idf_l[at][common]
    out = np.zeros((len(left), len(right)))

    def placed(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(columns, h)
        k[k == len(columns)] = 0
        own = columns[k] == h
        order = np.argsort(k[own], kind="stable")
        return k[own][order], row[own][order]

    if len(columns):
        (k_l, row_l), (k_r, row_r) = placed(h_l, row_l), placed(h_r, row_r)
        for lo in range(0, len(columns), COLUMNS):
            hi = min(lo + COLUMNS, len(columns))
            a, b = np.zeros((len(left), hi - lo), np.float32), np.zeros((len(right), hi - lo), np.float32)
            i, j = np.searchsorted(k_l, [lo, hi]), np.searchsorted(k_r, [lo, hi])
            a[row_l[i[0] : i[1]], k_l[i[0] : i[1]] - lo] = value[k_l[i[0] : i[1]]]
            b[row_r[j[0] : j[1]], k_r[j[0] : j[1]] - lo] = 1
            out += a @ b.T
    return out


def _meetings(named: DataFrame, threshold: float) -> DataFrame:
    """Which blocks of a bucket have to be compared: (band, key, group, blocks, other, other_blocks, low), both ways round.

    A group is a weight class of a bucket's largest component, or of the other nodes. Two nodes of weights x and y whose
    overlap is at most z reach the threshold t only if z >= t / (1 + t) * (x + y); as z is at most what each shares with
    any other document, ``cap`` = shared * (1 + t) / t - x is the greatest weight of a partner. Groups of which no two nodes
    can be partners, and those inside the largest component, don't meet. The numbers of groups of a bucket don't grow with it.
    """
    stats = named.groupBy("band", "key", "group").agg(
        F.count("*").alias("n"), F.max("cap").alias("cap"), F.min("total").alias("low"), F.max("total").alias("high")
    )
    own = stats.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    other = own.select("band", "key", *[F.col(c).alias(f"o_{c}") for c in ("group", "blocks", "cap", "low", "high")])
    near = (F.col("cap") >= F.col("o_low")) & (F.col("o_cap") >= F.col("low"))
    near &= (F.col("high") >= threshold * (1 - 1e-9) * F.col("o_low")) & (F.col("o_high") >= threshold * (1 - 1e-9) * F.col("low"))
    inside = F.col("group") >= _MAIN
    pairs = own.join(other, ["band", "key"]).where(near & ~(inside & (F.col("o_group") >= _MAIN)))
    return pairs.select("band", "key", "group", "blocks", F.col("o_group").alias("other"), F.col("o_blocks").alias("other_blocks"), F.col("o_low").alias("low"))


def _crossing(named: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links between different components inside the buckets of ``named`` (band, key, id, total, shared, comp).

    One task takes two blocks of at most about ``BLOCK`` nodes and returns one link for each pair of components, so
    neither the pairs nor a whole bucket are rows of one task. Nodes of the largest component don't meet each other.
    """
    sizes = named.groupBy("band", "key", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("band", "key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("n"), F.count("*").alias("comps"))
    # The two nodes of a pair were compared already.
    main = main.where("comps > 1 and n > 2").select("band", "key", F.col("top.comp").alias("main"))
    cap = F.col("shared") * ((1 + threshold) / threshold * (1 + 1e-9)) - F.col("total") + 1e-6
    weight = F.floor(F.log(F.greatest("total", F.lit(1e-9))) / float(np.log(WEIGHT_CLASS))) + 10_000
    group = F.shiftleft(weight.cast("long"), 32) + F.when(F.col("comp") == F.col("main"), F.lit(_MAIN)).otherwise(F.lit(0))
    placed = spread_join(named, main, ["band", "key"], "id").select("band", "key", "id", "comp", "total", cap.alias("cap"), group.alias("group"))
    placed = write_table(placed, "placed")
    vectors = nodes.select("id", F.col("n").alias("size"), "vec")
    met = spread_join(placed, _meetings(placed, threshold), ["band", "key", "group"], "id").where("cap >= low")
    own = F.col("group") + F.pmod(F.xxhash64("id"), F.col("blocks"))
    # A node may meet very many blocks, so it takes its vector along before it is dealt to them.
    dealt = met.join(vectors, "id").withColumn("own", own).withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1))).withColumn("to", F.col("other") + F.col("nth"))
    dealt = dealt.select("band", "key", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), "own", "id", "size", "vec", F.col("comp.fp").alias("comp"))
    kind = nodes.schema["id"].dataType
    arrow = to_arrow_type(kind)

    def test(table: pa.Table) -> pa.Table:
        rows = table.select(["own", "i", "j", "id", "comp", "size", "vec"]).to_pylist()
        left = [r for r in rows if r["own"] == r["i"]]
        right = [r for r in rows if r["own"] == r["j"]]
        a_out, b_out = [], []
        if left and right and any(r["comp"] != rows[0]["comp"] for r in rows):
            vec_l, vec_r = ([_decode(r["vec"], r["size"]) for r in side] for side in (left, right))
            name = {c: k for k, c in enumerate(dict.fromkeys(r["comp"] for r in rows))}
            comp_l, comp_r = (np.array([name[r["comp"]] for r in side]) for side in (left, right))
            sum_l, sum_r = (np.array([float((v[1] * v[2]).sum()) for v in side]) for side in (vec_l, vec_r))
            both = _overlaps(vec_l, vec_r)
            near = both / np.maximum(sum_l[:, None] + sum_r[None, :] - both, 1e-300)
            x, y = np.nonzero((near >= threshold - 1e-6) & (comp_l[:, None] != comp_r[None, :]))
            done: set[tuple[int, int]] = set()
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                pair = (min(comp_l[p], comp_r[q]), max(comp_l[p], comp_r[q]))
                if pair not in done and weighted_jaccard(vec_l[p], vec_r[q]) >= threshold - 1e-9:
                    done.add(pair)
                    a_out.append(left[p]["id"])
                    b_out.append(right[q]["id"])
        return pa.table({"a": pa.array(a_out, arrow), "b": pa.array(b_out, arrow)})

    return dealt.groupBy("band", "key", "i", "j").applyInArrow(test, f"a {kind.simpleString()}, b {kind.simpleString()}")


def _components(nodes: DataFrame, threshold: float) -> DataFrame:
    """(id, comp) of the nodes that have a partner."""
    members = nodes.select("id", "central", "total", "shared", F.posexplode("bands").alias("band", "key"))
    centre = members.groupBy("band", "key").agg(F.max(F.struct("central", "id")).alias("top"), F.count("*").alias("n")).where("n > 1").select("band", "key", F.col("top.id").alias("top"), "n")
    buckets = write_table(spread_join(members.drop("central"), centre, ["band", "key"], "id"), "buckets")
    # The most central node has the same rank in every bucket, so no pair comes both ways round. Ways are powers of two.
    ways = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.max("n") / HUB_PART, F.lit(1))))).cast("int")
    pairs = write_table(buckets.where("id <> top").groupBy("id", "top").agg(ways.alias("ways")), "pairs")
    links = write_table(_verified(pairs, nodes, threshold), "links")
    labels = connected_components(links)
    named = buckets.join(labels, "id", "left").select("band", "key", "id", "total", "shared", F.coalesce("comp", "id").alias("comp"))
    crossing = write_table(_crossing(named, nodes, threshold), "links")
    drop_table(buckets)
    return labels if crossing.isEmpty() else connected_components(links.union(crossing))


def near_duplicate_classes(
    docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """(doc_id, class_id) for each row of ``docs``; the class is the least doc_id of the component.

    Two texts are linked if their weighted Jaccard similarity is ``threshold`` or more. A text of fewer than ``width``
    words has one shingle of all its words, so equal short texts are linked. A null or empty text, or one without words,
    is in a class of its own; very long texts are taken whole. Rows without doc_id get a null class. Equal texts, repeated
    rows included, share a class; columns other than doc_id and text are ignored; an empty table gives no rows.
    """
    vectors = _vectors(docs, width, threshold, bands, rows)
    live = vectors.where("fp is not null")
    rest = [F.first(c).alias(c) for c in ("central", "total", "shared", "bands", "n", "vec")]
    named = live.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), *rest)
    nodes = write_table(named.select(F.struct("doc_id", "fp").alias("id"), "central", "total", "shared", "bands", "n", "vec"), "nodes")
    labels = _components(nodes, threshold)
    of_fp = nodes.select("id").join(labels, "id", "left").select(F.col("id.fp").alias("fp"), F.coalesce("comp.doc_id", "id.doc_id").alias("class_id"))
    classes = spread_join(live.select("doc_id", "fp"), of_fp, ["fp"], "doc_id").select("doc_id", "class_id")
    return classes.unionByName(vectors.where("fp is null").select("doc_id", F.col("doc_id").alias("class_id")))


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """One row of each near-duplicate class: that of the least doc_id. Columns, whatever their names, are unchanged.

    Rows are told apart by a 128-bit digest of doc_id and text, not by doc_id: rows that share an id but hold different
    texts are different documents, each in the class of its own text, and of rows equal in both one is taken. Where the
    least id of a class is that of several texts, the text of least digest stays. Rows without doc_id stay, as do null and
    empty texts, one for each id; very long texts and empty tables are as in `near_duplicate_classes`.
    """
    row = free_name("row", docs)
    digest = F.md5(F.concat(F.col("doc_id").cast("string"), F.coalesce(F.concat(F.lit("="), "text"), F.lit("-"))).cast("binary"))
    named = docs.where("doc_id is not null").withColumn(row, digest)
    classes = near_duplicate_classes(named.select(F.col(row).alias("doc_id"), "text"), **params).distinct()
    members = named.select(F.col("doc_id").alias("_id"), F.col(row).alias("_row")).distinct().join(classes.select(F.col("doc_id").alias("_row"), "class_id"), "_row")
    least = members.groupBy("class_id").agg(F.min(F.struct("_id", "_row")).alias("least"))
    kept = write_table(least.select(F.col("least._row").alias(row)), "kept")
    single = named.join(kept, row, "left_semi").dropDuplicates([row])
    return single.select(*map(column, docs.columns)).unionByName(docs.where("doc_id is null"))
