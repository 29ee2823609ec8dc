"""Nearest vectors of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.ordering import ranked
from graphloom.sources.shared import materialise
from graphloom.sources.tables import table


#: Query vectors broadcast at once, and vectors that meet them at once: 32 MB of similarities.
QUERIES = 4_096
SLICE = 1_000


def _nearest(at, ids, near, k: int):
    """Of rows (query position, vec_id, similarity) the ``k`` best of each query: largest similarity (NaN first), then least vec_id."""
    import numpy as np

    order = np.lexsort((ids, -np.where(np.isnan(near), np.inf, near), at))
    at, ids, near = at[order], ids[order], near[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], ids[keep], near[keep]


def search(spark: SparkSession, d: str, every: int = 20, k: int = 5, block: int = QUERIES) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the ``k`` nearest of every vector whose vec_id is divisible by ``every``.

    Inner products of all vectors with all queries, by numpy in Arrow batches.
    Queries are numbered and broadcast ``block`` at a time; a task keeps its k
    best of a query, and the tasks' bests are merged.  The work is
    (vectors) x (queries).  Rows without id or vector are neither.
    """
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding").filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    chosen = materialise(ranked(vectors.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding"), [], ["vec_id"], "at"), "queries")
    schema = "query_id long, vec_id long, similarity double"

    def block_of(b: int) -> DataFrame:
        rows = chosen.filter(F.floor(F.col("at") / block) == b).collect()
        shared = spark.sparkContext.broadcast(([r["vec_id"] for r in rows], [r["embedding"] for r in rows]))

        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            names, wanted = np.array(shared.value[0], "i8"), np.array(shared.value[1], "f8")
            best = (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    part = batch.slice(start, SLICE)
                    ids = part.column(0).to_numpy(zero_copy_only=False)
                    held = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(ids), -1)
                    near = np.round(wanted @ held.T, 6)
                    own = names[:, None] == ids[None, :]
                    key = np.where(own, -np.inf, np.where(np.isnan(near), np.inf, near))
                    # all that tie with a query's k-th best stay until they are ordered
                    least = np.partition(key, max(len(ids) - k, 0), axis=1)[:, max(len(ids) - k, 0)]
                    at, column = np.nonzero((key >= least[:, None]) & ~own)
                    best = _nearest(*(np.concatenate(x) for x in zip(best, (at, ids[column], near[at, column]), strict=True)), k)
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(names[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "vec_id", "similarity"])

        return vectors.mapInArrow(run, schema)

    blocks = max(1, -(-chosen.count() // block))
    found = reduce(DataFrame.unionByName, [materialise(block_of(b), "nearest") if blocks > 1 else block_of(b) for b in range(blocks)])
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
