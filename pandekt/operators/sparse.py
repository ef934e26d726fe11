"""BM25 index and search: in place for few questions, over blocked postings otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from pandekt.functions.text import WORD_RE, words
from pandekt.operators.dense import BLOCK_ROWS, merge_topk, select_topk
from pandekt.operators.ordered import top_k
from pandekt.operators.postings import B, K1, idf, posting_blocks, saturation, search_blocks
from pandekt.session import cut_lineage

MAX_BLOCK_TERMS = 1_000_000
MAX_PAIRS = 4_000_000


def doc_length(text: Column) -> Column:
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(WORD_RE)), F.lit(0)).cast("long")


def bm25_index(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "text",
               carry: tuple[str, ...] = ()) -> DataFrame:
    """Postings (chunk_id, [carry...], dl, term, tf).

    All words of a chunk sit in one input row, so they are counted there:
    no posting is shuffled.
    """
    w = chunks.select(F.col(chunk_id).alias("chunk_id"), *carry, words(F.col(text)).alias("_w"))
    kept = ["chunk_id", *carry]
    schema = StructType([*(w.schema[c] for c in kept), StructField("dl", LongType()), StructField("term", StringType()), StructField("tf", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_w")
            dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            size = max(1, len(coded.dictionary))
            key, tf = np.unique(np.repeat(np.arange(len(dl)), dl) * size + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            row = pa.array(key // size)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(row) for c in kept), pa.array(dl[key // size]), coded.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(tf.astype(np.int64))], names=schema.names)

    return w.mapInArrow(count, schema)


def corpus_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of chunks and average chunk length in words."""
    return chunks.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(doc_length(F.col(text))).alias("avgdl"))


def document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame, qid: str = "qid", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Distinct words of every question."""
    return queries.select(F.col(qid).alias("qid"), *carry, F.explode(F.array_distinct(words(F.col(text)))).alias("term"))


def sparse_topk(queries: DataFrame, chunks: DataFrame, k: int, qid: str = "qid", qtext: str = "text",
                chunk_id: str = "chunk_id", text: str = "text", filter_doc: str | None = None,
                doc_urn: str = "doc_urn", postings: DataFrame | None = None, stats: DataFrame | None = None,
                frequencies: DataFrame | None = None, digits: int = 6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top-k chunks per question by BM25.

    Up to ``block_rows`` questions with at most ``MAX_BLOCK_TERMS`` words
    (checked by a limited collect) travel with the tasks: every chunk is scored
    where it is read and only the k best per question and task are shuffled.
    More questions, or a stored index (``postings`` as made by
    ``posting_blocks``, ``stats`` and ``frequencies``), search blocked postings.
    Where all questions are restricted to a document, only the chunks of those
    documents are scored. Weights of a chunk are added word by word in byte
    order in both ways, so scores are the same to the last bit.
    """
    if k <= 0:
        raise ValueError(f"k must be > 0 (got {k})")
    q = queries.select(F.col(qid).alias("qid"), F.col(qtext).alias("text"),
                       (F.col(filter_doc) if filter_doc else F.lit(None).cast("string")).alias("_want"))
    c = chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(text).alias("text"),
                      (F.col(doc_urn) if filter_doc else F.lit(None).cast("string")).alias("_doc"))
    scored = None
    if postings is None:
        terms = query_terms(q, carry=("_want",))
        asked = terms.limit(MAX_BLOCK_TERMS + 1).toPandas()
        if len(asked) <= MAX_BLOCK_TERMS and asked["qid"].nunique() <= block_rows:
            scored = _score_in_place(asked, terms.schema["qid"].dataType, c, k, bool(filter_doc), digits)
        else:
            postings = cut_lineage(posting_blocks(c, doc_urn="_doc"))
    if scored is None:
        asked = q.select("qid", F.col("_want").alias("want"), F.array_distinct(F.coalesce(words(F.col("text")), F.array())).alias("terms"))
        scored = search_blocks(asked, postings, k, frequencies, stats, bool(filter_doc), digits, block_rows)
    return top_k(scored, ["qid"], [F.desc("score"), F.asc("chunk_id")], k).select("qid", "rank", "chunk_id", "score")


def _score_in_place(asked: pd.DataFrame, qid_type, c: DataFrame, k: int, filtered: bool, digits: int) -> DataFrame:
    """Score chunks inside their tasks against a bounded block of (qid, term) rows."""
    q_ids = asked["qid"].drop_duplicates()
    q_want = asked.drop_duplicates("qid")["_want"].tolist() if filtered else None
    q_ids = q_ids.to_numpy()
    vocabulary = np.unique(asked["term"].to_numpy().astype(str)) if len(asked) else np.zeros(0, dtype=str)
    vocab, size = pa.array(vocabulary.astype(object), pa.string()), len(vocabulary)
    schema = StructType([StructField("qid", qid_type), StructField("chunk_id", c.schema["chunk_id"].dataType), StructField("score", DoubleType())])
    if not size:
        return c.sparkSession.createDataFrame([], schema)
    tokens = c.select("chunk_id", "_doc", words(F.col("text")).alias("_w"))

    def term_counts(lists: pa.Array):
        """(row, term, tf) of the asked words in a batch, and the row lengths."""
        dl = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        term = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocab), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(dl)), dl)
        hit = term >= 0
        key, tf = np.unique(row[hit] * size + term[hit], return_counts=True)
        return key // size, key % size, tf, dl

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            _, term, _, dl = term_counts(batch.column("_w"))
            df += np.bincount(term, minlength=size)
            n, total = n + len(dl), total + int(dl.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[seen, [-1, -2]], pa.int64()), pa.array(np.r_[df[seen], [n, total]], pa.int64())], names=["t", "n"])

    # Document frequencies of the asked words, corpus size (-1) and total length (-2) in one pass.
    counted = dict(tokens.select("_w").mapInArrow(count, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False))
    n_docs = counted.pop(-1, 0)
    total = counted.pop(-2, 0)
    if not n_docs:
        return c.sparkSession.createDataFrame([], schema)
    avgdl = total / n_docs
    df = np.zeros(size)
    df[list(counted)] = list(counted.values())
    factor = idf(n_docs, df)
    # Questions per term, as offsets into one array.
    t_of = np.searchsorted(vocabulary, asked["term"].to_numpy().astype(str))
    q_of = pd.Index(q_ids).get_indexer(asked["qid"])
    order = np.argsort(t_of, kind="stable")
    q_sorted, q_ptr = q_of[order], np.r_[0, np.cumsum(np.bincount(t_of, minlength=len(vocabulary)))]
    fan = np.diff(q_ptr)

    def score(batch: pa.RecordBatch):
        row, term, tf, dl = term_counts(batch.column("_w"))
        weight = factor[term] * saturation(tf, dl[row], avgdl)
        # Cut the batch so that neither the pairs nor the score matrix get large.
        cost = np.cumsum(np.bincount(row, weights=fan[term], minlength=len(dl)) + len(q_ids))
        cuts = np.searchsorted(cost, np.arange(MAX_PAIRS, cost[-1] + MAX_PAIRS, MAX_PAIRS)) if len(cost) else []
        start = 0
        for end in sorted({min(int(x) + 1, len(dl)) for x in cuts} | {len(dl)}):
            if end <= start:
                continue
            a, b = np.searchsorted(row, [start, end])
            each = fan[term[a:b]]
            first = np.repeat(q_ptr[term[a:b]] - np.r_[0, np.cumsum(each)[:-1]], each) if b > a else np.zeros(0, dtype=np.int64)
            qq = q_sorted[first + np.arange(each.sum())] if b > a else np.zeros(0, dtype=np.int64)
            width = end - start
            cell = qq * width + np.repeat(row[a:b] - start, each)
            s = np.bincount(cell, weights=np.repeat(weight[a:b], each), minlength=len(q_ids) * width).reshape(len(q_ids), width)
            yield start, end, np.where(s > 0, np.round(s, digits), -np.inf)
            start = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            docs = batch.column("_doc").to_pylist() if filtered else None
            for start, end, s in score(batch):
                part = select_topk(s, ids[start:end], k, q_want, docs[start:end] if filtered else None)
                best = merge_topk(best, part, k)
        if best is not None and len(best[0]):
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"qid": q_ids[best[0]], "chunk_id": best[2], "score": best[1]}), preserve_index=False)

    scan = tokens
    if filtered and all(w is not None for w in q_want):
        # At most one value per question of the block: pushed down to the scan.
        scan = c.filter(F.col("_doc").isin(sorted(set(q_want)))).select("chunk_id", "_doc", words(F.col("text")).alias("_w"))
    return scan.mapInArrow(run, schema)
