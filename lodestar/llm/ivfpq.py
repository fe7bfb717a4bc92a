"""Approximate nearest neighbours: inverted lists, product-quantised residuals, exact reranking.

The index is fitted on a bounded sample (distinct vectors, SAMPLED for each list, TRAIN_ROWS at
least and MOST_ROWS at most) and holds every row: its list, the codes of its residual to the
list's centre, and the vector for reranking. Lists follow the square root of the rows as far as the
sample goes. A query visits its nearest lists; per list an asymmetric distance table scores the
codes, the rows of each block's RERANK best distinct scores are measured exactly, and a
query's best k over all blocks are kept. Large lists are dealt into blocks of BLOCK_ROWS rows and
turns of TURN_QUERIES queries, so no task holds a whole hot list. Vectors of each length have an index of their own.

How many lists a query visits is measured, not guessed: for up to CALIBRATION queries the true
neighbours among all rows are found in one pass, and enough lists are visited to hold TARGET of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scope, scope, written
from .vectors import TRAIN_ROWS, kmeans, matrix, nearest, sample, valid_vectors

SAMPLED, MOST_ROWS = 8, 131_072
LEAST_PROBES = 8
CALIBRATION, TARGET = 128, 0.98
RERANK = 128
#: Rows and queries of a list that one task compares.
BLOCK_ROWS, TURN_QUERIES = 8_192, 8_192
SUBSPACES = 16
CODES = 64


@dataclass
class Index:
    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[tuple[int, int]]

    def codes(self, residual: np.ndarray) -> np.ndarray:
        return np.stack([nearest(residual[:, a:b], book)[:, 0] for (a, b), book in zip(self.cuts, self.books)], 1).astype(np.uint8)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances of a query's residual parts to every code: subspaces x codes."""
        out = np.full((len(self.books), CODES), np.inf)
        for i, ((a, b), book) in enumerate(zip(self.cuts, self.books)):
            out[i, : len(book)] = ((book - residual[a:b]) ** 2).sum(1)
        return out


def fit(train: np.ndarray, n_rows: int) -> Index:
    dim = train.shape[1]
    lists = int(max(1, min(len(train) // SAMPLED, n_rows**0.5)))
    centres = kmeans(train, lists)
    residual = train - centres[nearest(train, centres)[:, 0]]
    edges = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
    cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return Index(centres, [kmeans(residual[:, a:b], CODES) for a, b in cuts], cuts)


def _probes(coded: DataFrame, index: Index, k: int) -> int:
    """Lists to visit, so that the sampled queries' true neighbours are in them with share TARGET."""
    asked = coded.where("is_query").groupBy("id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("id")).limit(CALIBRATION).toPandas()
    if not len(asked):
        return LEAST_PROBES
    ids, x = asked["id"].to_numpy(), matrix(asked["v"])

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[tuple[float, int, int]]] = [[] for _ in ids]
        for f in frames:
            own, lists, y = f["id"].to_numpy(), f["list"].to_numpy(), matrix(f["v"])
            for i, (qid, v) in enumerate(zip(ids, x)):
                d = ((y - v) ** 2).sum(1)
                d[own == qid] = np.inf
                few = np.argpartition(d, min(k, len(d)) - 1)[:k]
                held[i] = sorted([*held[i], *((d[j], int(own[j]), int(lists[j])) for j in few if np.isfinite(d[j]))])[:k]
        rows = [(i, *r) for i, h in enumerate(held) for r in h]
        yield pd.DataFrame(rows, columns=["q", "d", "id", "list"])

    found = coded.select("id", "list", "v").mapInPandas(near, "q int, d double, id bigint, list int")
    order = Window.partitionBy("q").orderBy("d", "id")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("q", "list").toPandas()  # CALIBRATION * k rows
    if not len(best):
        return LEAST_PROBES
    place = np.argsort(nearest(x, index.centres, len(index.centres)), axis=1)
    ranks = np.sort(place[best["q"].to_numpy(), best["list"].to_numpy()])
    return max(LEAST_PROBES, int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))) - 1)]) + 1)


RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def search(table: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each id of a row where `queries` holds.

    Euclidean distance in double precision on the vectors as they are, ties to the smaller id; rows
    of the query's own id are no candidates. Vectors that are null, zero, or hold null or
    non-finite components take no part; those of another length than the query's are no candidates. Rows with
    the same id are one query, by the least of their vectors, and a candidate each, as are
    repeated vectors. Null ids take no part. probes, if given, is the number of lists to visit. Fewer than k
    candidates give fewer rows; an empty table gives an empty result.
    """
    rows = valid_vectors(table.withColumn("is_query", F.coalesce(queries, F.lit(False))), id_col, vector_col, "is_query").where("id is not null")
    sizes = {r["dim"]: r["count"] for r in rows.groupBy(F.size("v").alias("dim")).count().collect()}  # one row a length
    found = [_search(rows.where(F.size("v") == dim), n, k, probes) for dim, n in sorted(sizes.items())]
    return reduce(DataFrame.unionByName, found) if found else table.sparkSession.createDataFrame([], RESULT)


def _search(rows: DataFrame, n: int, k: int, probes: int | None) -> DataFrame:
    with scope() as held:
        return _ranked(rows, n, k, probes, held)


def _ranked(rows: DataFrame, n: int, k: int, probes: int | None, held: Scope) -> DataFrame:
    spark = rows.sparkSession
    train = sample(rows, int(min(MOST_ROWS, max(TRAIN_ROWS, SAMPLED * n**0.5))))
    index = spark.sparkContext.broadcast(fit(train, n))
    array = rows.schema["v"].dataType.simpleString()

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for f in frames:
            x = matrix(f["v"])
            own = nearest(x, ix.centres)[:, 0]
            yield pd.DataFrame({"id": f["id"], "is_query": f["is_query"], "list": own, "codes": [c.tobytes() for c in ix.codes(x - ix.centres[own])], "v": f["v"]})

    coded = written(rows.select("id", "v", "is_query").mapInPandas(encode, f"id bigint, is_query boolean, list int, codes binary, v {array}"), "ivf")
    held.keep(coded)
    if probes is None:
        probes = _probes(coded, index.value, k)

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for f in frames:
            order = nearest(matrix(f["v"]), ix.centres, min(probes, len(ix.centres)))
            many = order.shape[1]
            yield pd.DataFrame({"list": order.ravel(), "id": np.repeat(f["id"].to_numpy(), many), "v": [v for v in f["v"] for _ in range(many)]})

    queries = coded.where("is_query").groupBy("id").agg(F.min("v").alias("v"))
    asked = written(queries.mapInPandas(visit, f"list int, id bigint, v {array}"), "ivf-queries")
    held.keep(asked)
    # a list is dealt into blocks of rows and turns of queries: one row a list, MOST_ROWS / SAMPLED at most
    count = lambda df, n, of: df.groupBy("list").agg(F.ceil(F.count("*") / of).cast("int").alias(n))
    parts = count(coded, "blocks", BLOCK_ROWS).join(count(asked, "turns", TURN_QUERIES), "list").toPandas()
    if not len(parts):
        return spark.createDataFrame([], RESULT)
    parts = F.broadcast(spark.createDataFrame(parts))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    none = F.lit(None).cast("binary")
    data = coded.join(parts, "list").select("list", own("blocks").alias("block"), every("turns").alias("turn"), "id", "codes", "v", F.lit(False).alias("is_query"))
    sent = asked.join(parts, "list").select("list", every("blocks").alias("block"), own("turns").alias("turn"), "id", none.alias("codes"), "v", F.lit(True).alias("is_query"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        ix = index.value
        q, d = group[group["is_query"]], group[~group["is_query"]]
        if not len(q) or not len(d):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        d = d.sort_values("id", kind="stable")
        ids, x = d["id"].to_numpy(), matrix(d["v"])
        codes = np.stack([np.frombuffer(c, np.uint8) for c in d["codes"]])
        centre, parts = ix.centres[int(d["list"].iloc[0])], np.arange(codes.shape[1])
        out = []
        for qid, v in zip(q["id"], matrix(q["v"])):
            tables = ix.tables(v - centre)
            about = tables[parts, codes].sum(1)
            about[ids == qid] = np.inf
            levels = np.unique(about)  # copies share one, so they can't keep others out
            near = np.nonzero((about <= levels[min(RERANK, len(levels)) - 1]) & (ids != qid))[0]
            score = np.sqrt(((x[near] - v) ** 2).sum(1))
            best = np.lexsort((ids[near], score))[:k]
            out += [(qid, ids[near[i]], score[i]) for i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = data.unionByName(sent).groupBy("list", "block", "turn").applyInPandas(compare, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
