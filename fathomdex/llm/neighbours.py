"""Approximate nearest neighbours by a permutation index.

A vector is represented by its POSTED nearest of PIVOTS pivots, in order. Vectors are dealt by
hash of the id over parts, each with inverted files of its own: the file of a pivot lists the
part's vectors that have it among their nearest, with the place it has there. A query goes
through the files of its own nearest pivots and adds up, for every vector that it meets, the
lesser of the two places counted from the end; what the footrule distance of the two truncated
orders has less than its most is twice that sum. Each part's best SHARE by this rank is
compared exactly. A part is many vectors and many queries in one task; every query part meets
every vector part, so files that hold many rows, such as copies of one vector, are spread.

Nearness is the largest inner product. Vectors are lengthened by one component that makes
all of them equally long, which makes the order by inner product one by angle.

Bounds of the model: PIVOTS pivots, those of the least hash of the id. All rows are indexed.
A query compares at least LEAST_RANKED of the rows of a part, and SHARE of them; vectors that
lie evenly in many dimensions, as those of the test tables do, need so large a share.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows without an id. Fewer rows than asked for:
all of them. Ties go to the smaller id; copies of a vector have exactly equal scores. A
query's own row is the one of its id. Repeated rows count once. An empty table gives no rows.
Only the id and vector columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIVOTS = 512
POSTED = 48
SHARE = 0.2
LEAST_RANKED = 256
PART_ROWS = 20_000
PART_QUERIES = 1_000
NEAREST = 20
EVERY = 20


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    x = x.filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(~bad & F.exists("v", lambda e: e != 0))
    sizes = x.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), "k").first()
    return x.filter(F.size("v") == (sizes["k"] if sizes else 0))


def _norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e)


class InvertedFiles:
    """For each pivot the vectors that have it among their nearest, and the weight of its place."""

    def __init__(self, orders: np.ndarray, pivots: int) -> None:
        self.rows, self.posted = orders.shape
        by = np.argsort(orders.ravel(), kind="stable")
        self.row = by // self.posted
        self.weight = (self.posted - by % self.posted).astype(np.int16)
        self.start = np.searchsorted(orders.ravel()[by], np.arange(pivots + 1))

    def best(self, order: np.ndarray, ranked: int) -> np.ndarray:
        """The `ranked` vectors of the least footrule distance, ties to the first."""
        if ranked >= self.rows:
            return np.arange(self.rows)
        shared = np.zeros(self.rows, dtype=np.int16)
        for place, pivot in enumerate(order.tolist()):
            file = slice(self.start[pivot], self.start[pivot + 1])
            shared[self.row[file]] += np.minimum(self.weight[file], np.int16(self.posted - place))
        limit = np.partition(shared, self.rows - ranked)[self.rows - ranked]
        near = np.flatnonzero(shared > limit)
        return np.concatenate((near, np.flatnonzero(shared == limit)[: ranked - len(near)]))


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score; is_query is a condition on vec_id."""
    spark = vectors.sparkSession
    x = usable(vectors, id_col, vector_col)
    head = x.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max(_norm(F.col("v"))).alias("most")).first()
    rows, queries, most = head["n"], head["q"], head["most"] or 0.0
    pivots = np.array([[*r["v"], np.sqrt(max(most - float(np.dot(r["v"], r["v"])), 0.0))] for r in x.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").limit(PIVOTS).collect()])  # PIVOTS vectors
    if not rows or not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    posted = min(POSTED, len(pivots))

    def permute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            v = np.array(batch["v"].tolist())
            extra = np.where(batch["is_query"], 0.0, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0.0)))
            order = np.argsort(-(np.c_[v, extra] @ pivots.T), axis=1, kind="stable")[:, :posted]
            yield batch.assign(order=[o.tobytes() for o in order.astype("<u2")])

    both = F.when(is_query, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    roles = x.withColumn("is_query", F.explode(both))
    placed = roles.mapInPandas(permute, "vec_id long, v array<double>, is_query boolean, order binary")
    of_rows, of_queries = -(-rows // PART_ROWS), -(-queries // PART_QUERIES)
    mine = F.pmod(F.xxhash64("vec_id"), F.when(F.col("is_query"), F.lit(of_queries)).otherwise(F.lit(of_rows))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("is_query"), F.lit(of_rows)).otherwise(F.lit(of_queries)) - 1))
    posts = placed.withColumn("mine", mine).withColumn("other", other)
    row_part = F.when(F.col("is_query"), F.col("other")).otherwise(F.col("mine"))
    query_part = F.when(F.col("is_query"), F.col("mine")).otherwise(F.col("other"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(bits=[np.asarray(x).tobytes() for x in group["v"]]).drop_duplicates(["is_query", "vec_id", "bits"]).sort_values("vec_id", kind="stable")
        wanted, stock = group[group["is_query"]], group[~group["is_query"]]
        if not len(wanted) or not len(stock):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        # Of copies only the smallest ids, and one more for a query's own, can be in an answer.
        stock = stock[stock.groupby("bits", sort=False).cumcount() <= nearest]
        ids, v = stock["vec_id"].to_numpy(), np.array(stock["v"].tolist())
        files = InvertedFiles(np.frombuffer(b"".join(stock["order"]), dtype="<u2").reshape(len(ids), posted), len(pivots))
        ranked = min(len(ids), max(LEAST_RANKED, nearest + 1, int(np.ceil(SHARE * len(ids)))))
        out = []
        for q, vector, order in zip(wanted["vec_id"], wanted["v"], wanted["order"], strict=True):
            near = files.best(np.frombuffer(order, dtype="<u2"), ranked)
            near = near[ids[near] != q]
            score = np.einsum("ij,j->i", v[near], np.asarray(vector))
            best = np.lexsort((ids[near], -score))[:nearest]
            out.append(pd.DataFrame({"query_id": q, "vec_id": ids[near][best], "score": score[best]}))
        return pd.concat(out)

    posts = posts.select(row_part.alias("row_part"), query_part.alias("query_part"), "vec_id", "v", "is_query", "order")
    found = posts.groupBy("row_part", "query_part").applyInPandas(compare, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % EVERY == 0)
