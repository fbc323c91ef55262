"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are 0 (clean), 1 and 2 (toxic, and toxic with more marking terms than the median toxic text). The model has one
weight vector w for all thresholds t0 < t1: P(grade > k) = s(w.x - t_k). The expected severity is the sum of these.
Features are words and word beginnings that far more toxic than clean training texts contain, valued log(1 + count).
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from . import scratch, worker

WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6)
#: At most this many labelled rows are learned from, the ones whose ids hash lowest.
SAMPLE_ROWS = 12_000
_REMEMBERED = 1 << 18


def features_of(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:n] for n in STEMS if len(word) >= n)]


def count_words(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


@dataclass
class Model:
    index: dict[str, int]
    weight: np.ndarray
    thresholds: np.ndarray

    def exceed(self, x: float) -> np.ndarray:
        """P(grade > k) for every k."""
        return 1 / (1 + np.exp(-np.clip(x - self.thresholds, -40, 40)))


class Scorer:
    """Scores texts; remembers which features a word has."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def features(self, text: str | None) -> dict[int, int]:
        found: dict[int, int] = {}
        seen, index = self.seen, self.model.index
        for word, n in count_words(text).items():
            ids = seen.get(word)
            if ids is None:
                ids = tuple(index[f] for f in features_of(word) if f in index)
                if len(seen) >= _REMEMBERED:
                    seen.clear()
                if len(word) <= 64:
                    seen[word] = ids
            for i in ids:
                found[i] = found.get(i, 0) + n
        return found

    def severity(self, text: str | None) -> tuple[float, float]:
        """(expected severity, probability of grade 1 or more)."""
        x = sum(self.model.weight[i] * np.log1p(n) for i, n in self.features(text).items())
        p = self.model.exceed(x)
        return float(p.sum()), float(p[0])


def fit_ordinal(rows: list[np.ndarray], values: list[np.ndarray], grade: np.ndarray, width: int, ridge: float = 1e-5, rounds: int = 600, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by full-batch Adam on the mean log-likelihood. rows and values are sparse rows."""
    levels = max(2, int(grade.max(initial=1)) + 1)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(doc) else np.zeros(0, np.int64)
    val = np.concatenate(values) if len(doc) else np.zeros(0)
    above = np.array([max((grade > k).mean(), 1e-3) for k in range(levels - 1)])
    first = np.log((1 - above) / above)
    # Thresholds are t0 and the logarithms of the steps to the next ones, so they stay in order.
    p = np.concatenate([np.zeros(width), first[:1], np.log(np.maximum(np.diff(first), 0.1))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    onehot = np.arange(levels)[None, :] == grade[:, None]
    for step in range(1, rounds + 1):
        t = np.cumsum(np.concatenate([p[width : width + 1], np.exp(p[width + 1 :])]))
        x = np.bincount(doc, val * p[col], len(rows))
        s = 1 / (1 + np.exp(-np.clip(x[:, None] - t, -40, 40)))  # P(grade > k)
        edge = np.hstack([np.ones((len(rows), 1)), s, np.zeros((len(rows), 1))])
        prob = np.maximum((edge[:, :-1] - edge[:, 1:])[onehot], 1e-12)
        slope = np.hstack([np.zeros((len(rows), 1)), s * (1 - s), np.zeros((len(rows), 1))])
        up, down = slope[:, :-1][onehot], slope[:, 1:][onehot]  # by the threshold below and above the grade
        dx = -(up - down) / prob / len(rows)
        dt = np.zeros(levels - 1)
        np.add.at(dt, np.maximum(grade - 1, 0), np.where(grade > 0, up / prob / len(rows), 0))
        np.add.at(dt, np.minimum(grade, levels - 2), np.where(grade < levels - 1, -down / prob / len(rows), 0))
        tail = np.cumsum(dt[::-1])[::-1]
        g = np.concatenate([np.bincount(col, val * dx[doc], width) + ridge * p[:width], tail[:1], tail[1:] * np.exp(p[width + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:width], np.cumsum(np.concatenate([p[width : width + 1], np.exp(p[width + 1 :])]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, least_texts: int = 3, least_share: float = 0.004, least_ratio: float = 10.0, least_g: float = 12.0) -> Model:
    """Learns from at most sample_rows labelled rows, equal texts once: as toxic if any of them is labelled so, which also holds for
    labels that repeat an id. Unlabelled rows, null labels and labels without a document do not count; without any toxic row the
    model finds every text clean. A feature is in least_texts toxic texts and in least_share of them at least; all such features
    enter. The same rows give the same model, bit for bit, however they are dealt."""
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("y")).where(F.col(id_col).isNotNull() & F.col("y").isNotNull())
    chosen = known.groupBy(id_col).agg(F.max("y").alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    texts = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(chosen), id_col)
    sample = texts.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("r")).agg(F.max("y").alias("y"), F.first("text").alias("text"))

    def counted(batches):
        worker.release()
        for batch in batches:
            for r, y, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = count_words(text)
                feats: dict[str, int] = {}
                for w, n in words.items():
                    for f in features_of(w):
                        feats[f] = feats.get(f, 0) + n
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.string()), pa.array([y], pa.int32()), pa.array([list(feats)], pa.list_(pa.string())), pa.array([list(feats.values())], pa.list_(pa.int32()))], names=["r", "y", "f", "n"])

    rows = scratch.cut(sample.select("r", F.col("y").cast("int"), "text").mapInArrow(counted, "r string, y int, f array<string>, n array<int>"), "labelled")
    n = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("y") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    pos, neg = max(n.get(True, 0), 1), max(n.get(False, 0), 1)
    share = rows.select((F.col("y") > 0).cast("int").alias("y"), F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("t")).where(F.col("a") >= max(least_texts, least_share * pos))
    b = F.col("t") - F.col("a")
    share = share.withColumn("ratio", (F.col("a") / pos) / ((b + 0.5) / neg))
    expect_a, expect_b = F.col("t") * pos / (pos + neg), F.col("t") * neg / (pos + neg)
    share = share.withColumn("g", 2 * (F.col("a") * F.log(F.col("a") / expect_a) + F.when(b > 0, b * F.log(b / expect_b)).otherwise(0)))
    best = share.where((F.col("ratio") >= least_ratio) & (F.col("g") >= least_g)).orderBy("f")
    index = {r["f"]: i for i, r in enumerate(best.collect())}
    if not index:
        return Model({}, np.zeros(0), np.array([40.0, 41.0]))
    # Only the chosen features of the bounded sample come to the driver.
    picked = rows.select("y", "r", F.expr("arrays_zip(f, n)").alias("z")).select("y", "r", F.explode_outer("z").alias("z")).select("y", "r", F.col("z.f").alias("f"), F.col("z.n").alias("n"))
    wanted = picked.join(F.broadcast(best.select("f")), "f").groupBy("r").agg(F.max("y").alias("y"), F.array_sort(F.collect_list(F.struct("f", "n"))).alias("fs")).orderBy("r").collect()
    grade, at, values = [], [], []
    for r in wanted:
        at.append(np.array([index[x["f"]] for x in r["fs"]], dtype=np.int64))
        values.append(np.log1p(np.array([x["n"] for x in r["fs"]], dtype=np.float64)))
        grade.append(1 if r["y"] > 0 else 0)
    total = {k: n.get(k, 0) for k in (True, False)}
    for k, g in ((True, 1), (False, 0)):  # texts without any feature
        missing = total[k] - sum(x == g for x in grade)
        at += [np.zeros(0, np.int64)] * missing
        values += [np.zeros(0)] * missing
        grade += [g] * missing
    mass = np.array([np.expm1(v).sum() for v in values])
    grade = np.array(grade)
    middle = np.median(mass[grade > 0]) if (grade > 0).any() else 0
    grade = np.where((grade > 0) & (mass > middle), 2, grade)
    weight, thresholds = fit_ordinal(at, values, grade, len(index))
    return Model(index, weight, thresholds)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_probability: float = 0.5) -> DataFrame:
    """(id_col, severity, probability, toxic), row for row. Null and wordless texts score as texts without features.
    toxic: the probability of grade 1 or more reaches least_probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([docs.schema[id_col], StructField("severity", DoubleType()), StructField("probability", DoubleType()), StructField("toxic", BooleanType())])

    def run(batches):
        worker.release()
        scorer = Scorer(shared.value)
        for batch in batches:
            out = [scorer.severity(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[1] >= least_probability for o in out], pa.bool_())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", least_probability: float = 0.5) -> DataFrame:
    """The rows of docs whose texts are not toxic, with all their columns."""
    shared, schema, at = docs.sparkSession.sparkContext.broadcast(model), docs.schema, docs.columns.index(text_col)

    def run(batches):
        worker.release()
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.severity(x.as_py())[1] < least_probability for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, schema)
