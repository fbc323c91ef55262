"""Language ID by cross-parsing entropy.

A suffix automaton holds all substrings of a language's training text. A text is parsed from its first letter to its last into
phrases, each the longest match with the training text (or one unseen character), whatever words it spans. A language's figure
is phrases x log2(training size) / characters; the least wins.

Letters of any script (and the marks on them) count, lower-cased; what lies between words is one space. The automata's
transitions lie in one table, so that many texts are parsed at once, a character of each at a time; long texts, when few are
left, and alphabets too large for the table go character by character.
"""

from __future__ import annotations

import math
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Labelled rows that are learned from, for each language.
SAMPLE_ROWS = 20
#: Numbers in the table of transitions; beyond it (large alphabets) they stay in dictionaries.
TABLE_CELLS = 48 << 20
#: Texts that are parsed at once, by characters, and so few that the rest goes one by one.
_AT_ONCE, _FEW = 8 << 20, 24
_SPACE = 1


class SuffixAutomaton:
    """All substrings of a sequence of small numbers. next[s] maps numbers to states; 0 is the root."""

    def __init__(self, codes: list[int]):
        length, link, out = [0], [-1], [{}]
        last = 0
        for c in codes:
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            out.append({})
            p = last
            while p >= 0 and c not in out[p]:
                out[p][c] = new
                p = link[p]
            if p >= 0:
                q = out[p][c]
                if length[q] != length[p] + 1:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    out.append(dict(out[q]))
                    while p >= 0 and out[p].get(c) == q:
                        out[p][c] = copy
                        p = link[p]
                    link[q] = copy
                    q = copy
                link[new] = q
            last = new
        self.next = out

    def phrases(self, codes: list[int]) -> int:
        """The number of phrases of the greedy longest-match parse."""
        n, state, step = 0, 0, self.next
        for c in codes:
            to = step[state].get(c, 0)
            if not to:
                n += state != 0
                to = step[0].get(c, 0)
                n += to == 0
            state = to
        return n + (state != 0)


_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """For each code point: 2 for letters, 1 for marks, 0 for the rest."""
    global _kinds
    if _kinds is None:
        kind = {"L": 2, "M": 1}
        _kinds = np.fromiter((kind.get(unicodedata.category(chr(i))[0], 0) for i in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
    return _kinds


def points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Identifier:
    def __init__(self, texts: dict[str, str], table_cells: int = TABLE_CELLS):
        self.names = sorted(texts)
        learned = [points(texts[n]) for n in self.names]
        letters = np.unique(np.concatenate(learned)) if learned else np.zeros(0, np.uint32)
        letters = letters[kinds()[letters] > 0]
        self.code = np.where(kinds() > 0, 0, _SPACE).astype(np.int32)  # 0: a letter of no training text
        self.code[letters] = np.arange(2, len(letters) + 2)
        codes = [self.codes(x) for x in learned]
        self.bits = np.array([math.log2(len(c) + 1) for c in codes])
        automata = [SuffixAutomaton(c.tolist()) for c in codes]
        width = len(letters) + 2
        sizes = [len(a.next) for a in automata]
        self.table, self.automata, self.width = None, automata, width
        if automata and sum(sizes) * width <= table_cells:
            # One row for each state, languages one after another. A cell holds where the row to go to begins, and in the lowest two
            # bits the phrases that end: where there is no transition, the open phrase does and a new one begins at the root.
            self.table, self.automata = np.empty(sum(sizes) * width, dtype=np.int32), []
            self.root = (np.cumsum([0, *sizes])[:-1] * width).astype(np.int32)
            for base, a, size in zip(self.root.tolist(), automata, sizes):
                first = np.array([a.next[0].get(c, 0) for c in range(width)], dtype=np.int64)
                rows = self.table[base : base + size * width].reshape(size, width)
                rows[:] = ((first * width + base) << 2) + 1 + (first == 0)
                rows[0] = base * 4 + 1
                at = np.fromiter((s * width + c for s, edges in enumerate(a.next) for c in edges), dtype=np.int64)
                rows.reshape(-1)[at] = (np.fromiter((t for edges in a.next for t in edges.values()), dtype=np.int64) * width + base) << 2

    def codes(self, text: np.ndarray) -> np.ndarray:
        """The letters' numbers, one space before, between and after words; empty without letters."""
        c = np.concatenate([[_SPACE], self.code[text], [_SPACE]])
        c = c[np.concatenate([[True], (c[1:] != _SPACE) | (c[:-1] != _SPACE)])]
        return c if len(c) > 1 and (kinds()[text] == 2).any() else c[:0]

    def _one(self, codes: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Phrases of a text for each language, from these rows on."""
        table, out, codes = memoryview(self.table), [], codes.tolist()
        for s in row.tolist():
            n = 0
            for c in codes:
                s = table[s + c]
                n += s & 3
                s >>= 2
            out.append(n + (s not in self.roots))
        return np.array(out)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(text, language) numbers of phrases."""
        out = np.zeros((len(texts), len(self.names)), dtype=np.int64)
        if self.table is None:
            for i, codes in enumerate(texts):
                out[i] = [a.phrases(codes.tolist()) for a in self.automata]
            return out
        self.roots = set(self.root.tolist())
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        size = np.array([len(texts[i]) for i in order], dtype=np.int64)
        flat = np.concatenate([texts[i] for i in order]) if order else np.zeros(0, np.int32)
        begin = np.cumsum(size) - size
        row = np.repeat(self.root[:, None], len(order), axis=1)
        n = np.zeros(row.shape, dtype=np.int32)
        left, at, table = len(order), 0, self.table
        while left > _FEW:
            # All texts go on up to the end of the shortest that is left.
            end, s, k, spot = int(size[left - 1]), row[:, :left].copy(), n[:, :left].copy(), begin[:left] + at
            for _ in range(at, end):
                v = table.take(s + flat.take(spot))
                k += v & 3
                s = v >> 2
                spot += 1
            row[:, :left], n[:, :left], at = s, k, end
            while left and size[left - 1] == at:
                left -= 1
        n[:, left:] += row[:, left:] != self.root[:, None]
        for i in range(left):
            n[:, i] += self._one(flat[begin[i] + at : begin[i] + size[i]], row[:, i])
        out[order] = n.T
        return out

    def identify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language or und, score) of each: the score is how much smaller the best figure is than the next, from 0 to 1."""
        codes = [self.codes(points(t)) for t in texts]
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        some = [i for i, c in enumerate(codes) if len(c)] if self.names else []
        at = 0
        while at < len(some):
            to, chars = at, 0
            while to < len(some) and (to == at or chars + len(codes[some[to]]) <= _AT_ONCE):
                chars += len(codes[some[to]])
                to += 1
            part = some[at:to]
            figure = self.phrases([codes[i] for i in part]) * self.bits / np.array([len(codes[i]) for i in part])[:, None]
            for i, f in zip(part, figure):
                best = int(f.argmin())  # the first of equals
                out[i] = self.names[best], float(1 - f[best] / np.partition(f, 1)[1]) if len(f) > 1 else 1.0
            at = to
        return out


def training_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> dict[str, str]:
    """A text for each language: the whole texts of the sample_rows labelled rows whose ids hash lowest. Rows without a language, id
    or letter do not count; every language that has others is learned."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("id is not null and lang is not null").where(F.regexp_like("text", F.lit(r"\p{L}")))
    order = [F.xxhash64("id", F.lit("language")), F.col("id").cast("string"), F.col("text")]
    some = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("n") <= sample_rows)
    texts: dict[str, list] = {}
    for r in some.select("lang", "n", "text").collect():  # sample_rows for each language
        texts.setdefault(r["lang"], []).append((r["n"], r["text"]))
    return {k: "\n".join(t for _, t in sorted(v)) for k, v in texts.items()}


_made: dict[int, Identifier] = {}


def identify(docs: DataFrame, texts: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score), row for row: und and score 0 where the text is null or has no letter, or where nothing
    was learned. Equal figures go to the first name by spelling."""
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    schema = StructType([docs.schema[id_col], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    stamp = hash(tuple(sorted(texts.items())))

    def run(batches):
        if stamp not in _made:
            _made.clear()
            _made[stamp] = Identifier(shared.value)
        find = _made[stamp].identify
        for batch in batches:
            out = find(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
