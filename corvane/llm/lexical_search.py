"""Ranked lexical search: postings, joined with the terms of the items, scored in integers.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters, only
A-Z lower-cased. A posting is (document, term, tf, n): how often the document
holds the term, and how many terms it has in all.

1. Arrow tasks cut the texts into postings, each document's terms once. Only
   terms that some item asks for are kept; they are written in term buckets,
   sorted by bucket and term within each writer's share of the documents, so
   that a reader of a few terms skips the other row groups.
2. Document frequencies are sums over the postings, N and L over the documents.
3. The terms of the items, with their weights, join the postings by bucket and
   term. A match's score depends on term and document only, so it is computed
   once for each posting, in 64-bit integers.
4. Postings are dealt out by document, so that the sums of each (item,
   document) need no further shuffle, and the top k of every task are taken
   before the ranks of an item are.

The items are taken in blocks of a bounded size, each block broadcast; an item
lies in one block, so its ranks are final there.

Defined results: null and empty texts have no terms and are in no result; every
row of ``docs`` is a document of its own, rows that share an id or are equal
too, and equal scores go by ascending doc_id, nulls last; rows that share an
item_id are one item with the terms of all of them; a null item_id is an item;
other columns of either input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import kernels as K
from corvane.sources.shared import materialize

TERM_BUCKETS = 64
#: Bytes of item texts whose terms are broadcast at once.
BLOCK_BYTES = 4 << 20
TOP = 50
#: A document's row of its own in the postings has this for a term, which no term is, and n for tf.
WHOLE = ""
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_POSTING = "row long, doc_id long, term string, tf long, n long"


def terms_of(text: Column) -> Column:
    """All terms of a text, in order."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(_TERM), F.lit(0))


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as an Arrow column of strings."""
    lengths = ends - starts
    offsets = np.r_[0, np.cumsum(lengths)]
    at = np.arange(int(offsets[-1])) + np.repeat(starts - offsets[:-1], lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, ids = batch.column("row").to_numpy(), batch.column("doc_id")
        data, offsets = K.utf8(batch.column("text"))
        for a, b in K.chunks(offsets):
            raw = K.LOWER[data[offsets[a] : offsets[b]]]
            starts, ends, bounds = K.words(raw, offsets[a : b + 1] - offsets[a], K.PLAIN_WORD)
            n = np.diff(bounds)
            owner = np.repeat(np.arange(b - a), n)
            hashes = K.word_hashes(raw, starts, ends)
            order = np.lexsort((hashes, owner))
            new = np.ones(len(order), bool)
            new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
            first = np.flatnonzero(new)
            tf, one = np.diff(np.append(first, len(order))), order[new]
            whole = np.flatnonzero(n)  # a row for the document itself
            of = np.r_[owner[one], whole]
            terms = pa.concat_arrays([_strings(raw, starts[one], ends[one]), pa.array([WHOLE] * len(whole), pa.string())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[a:b][of]), ids.slice(a, b - a).take(pa.array(of)), terms, pa.array(np.r_[tf, n[whole]]), pa.array(n[of])], names=["row", "doc_id", "term", "tf", "n"]
            )


def postings(docs: DataFrame) -> DataFrame:
    """(row, doc_id, term, tf, n): a row for each document and term, and one for each document with terms, whose term is ``WHOLE``."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(_cut, _POSTING)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def index(docs: DataFrame, wanted: DataFrame | None = None, small: bool = False) -> DataFrame:
    """The written postings in their term buckets; of the terms in ``wanted`` (term) alone, if given.

    ``small``: the caller has measured ``wanted``, and it may be broadcast, so
    that no posting is shuffled; otherwise Spark chooses.
    """
    rows = postings(docs)
    if wanted is not None:
        terms = wanted.select("term").distinct().unionByName(docs.sparkSession.createDataFrame([(WHOLE,)], "term string"))
        rows = rows.join(F.broadcast(terms) if small else terms, "term", "left_semi")
    return materialize(rows.withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term"), "postings")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) of every item, once each."""
    return items.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct()


def weights(posted: DataFrame) -> DataFrame:
    """(bucket, term, w) of every posted term, and the corpus's N and L with each."""
    total = posted.where(F.col("term") == WHOLE).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("tf"), F.lit(0)).alias("length")).first()
    n, length = total["docs"], total["length"]
    df = posted.where(F.col("term") != WHOLE).groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    w = F.floor(1000 * F.ln(F.lit(2 * n + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    return df.select("bucket", "term", w.alias("w"), F.lit(n).cast("long").alias("all_docs"), F.lit(length).cast("long").alias("all_terms"))


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k highest-scoring documents with a score above 0."""
    asked = materialize(item_terms(items), "item-terms")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0)).alias("b")).first()["b"]
    posted = index(docs, asked, 2 * size <= block_bytes)
    known = materialize(weights(posted), "weights")
    n_blocks = max(1, -(-2 * size // block_bytes))
    parts = [_scored(posted, known, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == i), k) for i in range(n_blocks)]
    return reduce(DataFrame.unionByName, parts)


def _scored(posted: DataFrame, known: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    # All items of a term in one row, at most a block of them in all: the broadcast is bounded by the block.
    wanted = asked.join(known, "term").groupBy("bucket", "term", "w", "all_docs", "all_terms").agg(F.collect_list(F.struct("item_id")).alias("items"))
    partitions = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = posted.where(F.col("term") != WHOLE).repartition(partitions, "row")
    matched = dealt.join(F.broadcast(wanted), ["bucket", "term"])
    m = F.expr("100 - 50 + (50 * n * all_docs) div all_terms")
    score = F.expr("w * ((1000000000 * tf) div (1000 * tf + 20 * m))")
    each = matched.withColumn("m", m).select("row", "doc_id", score.alias("score"), F.explode("items").alias("item")).where("score > 0")
    summed = each.groupBy("row", "doc_id", F.col("item.item_id").alias("item_id")).agg(F.sum("score").alias("score"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return summed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
