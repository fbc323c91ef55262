"""Embedding near-duplicates by collision counting.

Every vector is projected onto many random lines. Two unit vectors of cosine c differ on a line by a normal deviate of
variance 2 - 2c, so a query-centred window of that many deviations catches a near pair on nearly every line and others
on few. A pair is verified by its exact cosine if it collides on at least the calibrated number of lines, the largest
count that pairs at the threshold reach with probability `recall`.

To compare only likely pairs, the first lines' signs group the vectors into cells, in several tables. The number of signs
follows the logarithm of the row count, so that a cell of scattered vectors stays small at any size, and the number of
tables follows from the recall wanted of pairs at the threshold. A pair belongs to the first table in which it shares a
cell, so links are counted once. Cells are cut into blocks of bounded size and each pair of blocks is one group of
work; blocks give back counts and a spanning forest, never pairs. Equal vectors enter once, with their number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import connected_components, forest

LINES = 16
BLOCK = 1024


def unit(vectors: list) -> np.ndarray:
    """Unit vectors in double precision, of vectors of one length that are finite and not zero."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps tiny and huge vectors in range
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def calibrate(threshold: float, recall: float = 0.995, lines: int = LINES, deviations: float = 2.0) -> tuple[float, int]:
    """(half width of the window, least number of collisions)."""
    width = deviations * math.sqrt(2 - 2 * threshold)
    p = math.erf(deviations / math.sqrt(2))
    tail, least = 0.0, lines + 1
    while tail < recall and least > 0:
        least -= 1
        tail += math.comb(lines, least) * p**least * (1 - p) ** (lines - least)
    return width, least


def plan_tables(rows: int, threshold: float, recall: float = 0.995, cell: int = 128) -> tuple[int, int]:
    """(signs in a cell's name, tables)."""
    signs = max(1, math.ceil(math.log2(max(2, rows) / cell))) if rows > cell else 0
    same = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, 1 if same >= recall else math.ceil(math.log(1 - recall) / math.log(1 - same))


def _compare(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, width: float, least: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the pairs that collide often enough and whose cosine reaches the threshold.

    Line by line: y sorted by its projection, a window around each x found by bisection, and the window's rows counted
    by marking where it begins and ends.
    """
    count = np.zeros((len(x), len(y)), dtype=np.int16)
    row = np.arange(len(x))
    for k in range(px.shape[1]):
        order = np.argsort(py[:, k], kind="stable")
        line = py[order, k]
        lo, hi = np.searchsorted(line, px[:, k] - width, "left"), np.searchsorted(line, px[:, k] + width, "right")
        marks = np.zeros((len(x), len(y) + 1), dtype=np.int8)
        np.add.at(marks, (row, lo), 1)
        np.add.at(marks, (row, hi), -1)
        count[:, order] += np.cumsum(marks[:, :-1], axis=1, dtype=np.int8)
    i, j = np.nonzero(count >= least)
    cos = np.zeros(len(i))
    for a in range(0, len(i), 1 << 16):
        b = slice(a, a + (1 << 16))
        cos[b] = np.einsum("ij,ij->i", x[i[b]], y[j[b]])
    near = cos >= threshold
    return i[near], j[near]


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.995, seed: int = 7) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row whose id is not null.

    Vectors link at cosine >= threshold (double precision, verified); pairs at the threshold are found with probability
    recall in the tables and again by the count, closer pairs more surely, equal vectors always. Null or zero vectors and those
    with null or non-finite components link with nothing; vectors of another length are compared among their own. Ids are whole
    numbers. Rows that repeat an id and its vector are each other's links; different vectors under one id fall into one
    component. Other columns are ignored.
    """
    table = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null")
    sound = (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    marked = table.withColumn("ok", F.coalesce(sound, F.lit(False)))
    # -0.0 equals 0.0; copies share one row from here on.
    each = scratch.cut(marked.where("ok").select("id", F.transform("v", lambda c: c + F.lit(0.0)).alias("v")).groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("at", F.xxhash64("v")), "vectors")
    total = each.count()
    signs, tables = plan_tables(total, threshold, recall)
    width, least = calibrate(threshold, recall)

    def drawn(dim: int) -> tuple[np.ndarray, np.ndarray]:
        """The lines to project on and the directions whose signs name cells, for vectors of this length."""
        rng = np.random.default_rng([seed, dim])
        return rng.standard_normal((dim, LINES)), rng.standard_normal((dim, max(1, signs * tables)))

    def cells(batches):
        for whole in batches:
            for dim, df in whole.groupby(whole["v"].map(len)):
                x, cuts = unit(df["v"].tolist()), drawn(dim)[1]
                bits = (x @ cuts > 0)[:, : signs * tables].reshape(len(df), tables, signs) if signs else np.zeros((len(df), tables, 0), dtype=bool)
                code = (bits * (1 << np.arange(signs, dtype=np.int64))).sum(axis=2).astype(np.int64)
                for t in range(tables):
                    yield pd.DataFrame({"t": np.int32(t), "dim": np.int32(dim), "cell": code[:, t], "rep": df["rep"], "n": df["n"], "v": df["v"], "codes": list(code[:, :t])})

    placed = each.mapInPandas(cells, "t int, dim int, cell long, rep long, n long, v array<double>, codes array<long>")
    full = scratch.cut(placed.groupBy("t", "dim", "cell").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")), "cells")
    dealt = placed.join(F.broadcast(full) if full.count() <= 500_000 else full, ["t", "dim", "cell"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = dealt.withColumn("other", other).select("t", "dim", "cell", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), "mine", "rep", "n", "v", "codes")

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("rep", ignore_index=True)
        x = unit(df["v"].tolist())
        lines, _ = drawn(x.shape[1])
        p, t, rep, n = x @ lines, int(df["t"][0]), df["rep"].to_numpy(), df["n"].to_numpy()
        codes = np.array(df["codes"].tolist(), dtype=np.int64).reshape(len(df), t)
        b1, b2 = df["b1"][0], df["b2"][0]
        left, right = np.nonzero(df["mine"].to_numpy() == b1)[0], np.nonzero(df["mine"].to_numpy() == b2)[0]
        links, ends = np.zeros(len(df), dtype=np.int64), []
        for a in range(0, len(left), BLOCK):
            for b in range(0, len(right), BLOCK):
                r, s = left[a : a + BLOCK], right[b : b + BLOCK]
                i, j = _compare(x[r], x[s], p[r], p[s], width, least, threshold)
                i, j = r[i], s[j]
                own = (i < j if b1 == b2 else np.ones(len(i), dtype=bool)) & ~(codes[i] == codes[j]).any(axis=1)
                i, j = i[own], j[own]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                root = forest(len(df), i, j)
                ends.append((np.nonzero(root != np.arange(len(df)))[0], root[root != np.arange(len(df))]))
        some = np.nonzero(links)[0]
        src, dst = (np.concatenate(c) for c in zip(*ends)) if ends else (np.zeros(0, int), np.zeros(0, int))
        return pd.DataFrame({"rep": np.concatenate([rep[some], rep[src]]), "links": np.concatenate([links[some], np.zeros(len(src), np.int64)]), "root": np.concatenate([np.full(len(some), -1, np.int64), rep[dst]]), "edge": np.concatenate([np.zeros(len(some), bool), np.ones(len(src), bool)])})

    found = scratch.cut(spread.groupBy("t", "dim", "cell", "b1", "b2").applyInPandas(compare, "rep long, links long, root long, edge boolean"), "links")
    counts = found.where("not edge").groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("edge").select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    reps = each.join(counts, "rep", "left").join(groups, each.rep == groups.node, "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = marked.where("ok").select("id", F.transform("v", lambda c: c + F.lit(0.0)).alias("v")).join(reps, "v").select("id", "n_links", "component_id")
    alone = marked.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
