"""Occurrences and documents of every distinct term, by a range-partitioned external sort of (term, document) pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import is_blank, letter_terms
from palimpsest.operators.lineage import materialize
from palimpsest.operators.snapshots import current_texts

#: The pseudo-term that each document with text has once; real terms are never empty.
_ANY = ""


def term_pairs(docs: DataFrame, key: list[str], doc: str, terms: Column, times: Column) -> DataFrame:
    """(term, doc, n) with the occurrences of one row combined before anything is moved.

    ``key`` must identify a row and be what the rows are hash-partitioned on, so that the first sum needs no shuffle.
    """
    flat = docs.select(*key, times.alias("_m"), F.explode(F.concat(F.array(F.lit(_ANY)), terms)).alias("term"))
    n = F.sum(F.when(F.col("term") != _ANY, F.col("_m")).otherwise(0))
    return flat.groupBy(*key, "term").agg(n.alias("n")).select("term", F.col(doc).alias("doc"), "n")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of pairs sorted by (term, doc): one row per term and partition. Holds one batch at a time."""
    schema = pa.schema([("term", pa.string()), ("n_total", pa.int64()), ("n_docs", pa.int64())])
    open_term, open_doc, total, docs = None, None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        ree = pc.run_end_encode(b.column("term"))
        ends = np.asarray(ree.run_ends)
        starts = np.concatenate(([0], ends[:-1]))
        doc = b.column("doc").to_numpy()
        new = np.empty(len(doc), bool)
        new[0] = True
        new[1:] = doc[1:] != doc[:-1]
        new[starts] = True
        sums = np.add.reduceat(b.column("n").to_numpy(), starts)
        counts = np.add.reduceat(new.astype(np.int64), starts)
        terms = ree.values.to_pylist()
        if terms[0] == open_term:
            sums[0] += total
            counts[0] += docs - int(doc[0] == open_doc)
        elif open_term is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_term]), pa.array([total]), pa.array([docs])], schema=schema)
        if len(terms) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(terms[:-1]), pa.array(sums[:-1]), pa.array(counts[:-1])], schema=schema)
        open_term, open_doc, total, docs = terms[-1], doc[-1], int(sums[-1]), int(counts[-1])
    if open_term is not None:
        yield pa.RecordBatch.from_arrays([pa.array([open_term]), pa.array([total]), pa.array([docs])], schema=schema)


def count_pairs(pairs: DataFrame, partitions: int | None = None) -> DataFrame:
    """term, n_total, n_docs of (term, doc, n) pairs, each (term, doc) in any number of rows.

    The pairs are range-partitioned and sorted by (term, doc): equal pairs meet in one partition, while a term that
    holds a third of all pairs spreads over as many partitions as it fills. Each partition's scan gives one partial
    row per term; these add up, as no pair is in two partitions.
    """
    parts = partitions or int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pairs.repartitionByRange(parts, "term", "doc").sortWithinPartitions("term", "doc")
    partial = ordered.mapInArrow(_runs, "term string, n_total bigint, n_docs bigint")
    return partial.groupBy("term").agg(F.sum("n_total").alias("n_total"), F.sum("n_docs").alias("n_docs"))


def snapshot_term_counts(snapshot: DataFrame, rare: int = 2, common: float = 0.5) -> DataFrame:
    """term, n_total, n_docs, mark of the non-blank current rows.

    n_total counts over all current rows, n_docs the distinct bare docids. mark: ``rare`` up to ``rare`` documents,
    ``common`` above the share ``common`` of the documents with text, else ``kept``. A text that stays current over
    several snapshots is split once and counted as often as it is current. Null and blank texts count nowhere; an
    empty table gives no rows.
    """
    texts = current_texts(snapshot).filter(~is_blank(F.col("text")))
    pairs = materialize(term_pairs(texts, ["docid", "fp"], "docid", letter_terms(F.col("text")), F.size("seen").cast("bigint")), "p4-pairs")
    docs = pairs.filter(F.col("term") == _ANY).agg(F.countDistinct("doc").alias("d")).scalar()
    mark = F.when(F.col("n_docs") <= rare, "rare").when(F.col("n_docs") > docs * F.lit(common), "common").otherwise("kept")
    return count_pairs(pairs).filter(F.col("term") != _ANY).select("term", "n_total", "n_docs", mark.alias("mark"))
