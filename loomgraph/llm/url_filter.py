"""URL filters: a broadcast trie over reversed host labels, then path segments; the longest match decides.

A list too large for a broadcast is joined instead: on the page's host suffixes, then on (host, beginning of the path)
for the lengths that the host's rules have. Both ways give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import scratch

#: Bytes that the trie may take to be broadcast: RULE_BYTES a rule and four for each of its characters.
BROADCAST_BYTES, RULE_BYTES = 64 << 20, 1500


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path). Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: then up to ?, # or the
    end. Both are empty for null and for what has no ://."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


@dataclass
class _Path:
    next: dict[str, "_Path"] = field(default_factory=dict)
    #: Rules that end inside a segment: its beginning -> (rule, verdict). The empty beginning fits any segment.
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: The lengths of these beginnings, longest first: no others need to be tried, however long a segment is.
    lengths: list[int] = field(default_factory=list)


@dataclass
class _Host:
    next: dict[str, "_Host"] = field(default_factory=dict)
    path: _Path | None = None


def checked(rule: tuple[str, str, str]) -> tuple[str, str, str]:
    """The rule with its host's A-Z lower-cased."""
    verdict, host, path = rule
    if verdict not in ("allow", "block") or path and path[0] != "/":
        raise ValueError(f"not a rule: {rule}")
    return verdict, split_url(f"://{host}")[0], path


class Trie:
    """Rules are (verdict, host, path): verdict is allow or block, path a prefix that begins with / or is empty."""

    def __init__(self, rules):
        self.root = _Host()
        for verdict, host, path in map(checked, rules):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.next.setdefault(label, _Host())
            node.path = step = node.path or _Path()
            *inner, last = path.split("/")
            for segment in inner:
                step = step.next.setdefault(segment, _Path())
            old = step.ends.get(last)
            if not old or verdict == "allow":  # of two equal rules, allow holds
                step.ends[last] = (host + path, verdict)
                step.lengths = sorted({*step.lengths, len(last)}, reverse=True)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits: the longer host first, then the longer path."""
        node, tops = self.root, []
        for label in reversed(host.split(".")):
            node = node.next.get(label)
            if node is None:
                break
            if node.path:
                tops.append(node.path)
        segments = path.split("/")
        for step in reversed(tops):
            best = None
            for segment in segments:
                if step is None:
                    break
                best = next((step.ends[segment[:n]] for n in step.lengths if n <= len(segment) and segment[:n] in step.ends), best)
                step = step.next.get(segment)
            if best:
                return best
        return None


def judge(pages: DataFrame, rules, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict), row for row. rule is null and the verdict `otherwise` where no rule fits.

    rules: (verdict, host, path) tuples, or a table with these columns for lists of any size. Of equal rules, allow holds.
    Null urls and ids, repeats and extra columns are no special cases. An empty host takes only rules without a host.
    """
    listed = not isinstance(rules, DataFrame)
    if listed:
        rules = [tuple(r) for r in rules]
        size = sum(RULE_BYTES + 4 * (len(host) + len(path)) for _, host, path in rules)
    else:
        rules = rules.select("verdict", "host", "path")
        size = rules.agg(F.sum(F.lit(RULE_BYTES) + 4 * (F.length("host") + F.length("path")))).first()[0] or 0
    if size > BROADCAST_BYTES:
        return _joined(pages, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string") if listed else rules, id_col, url_col, otherwise)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules if listed else map(tuple, rules.collect())))
    schema = StructType([pages.schema[id_col], *(StructField(n, StringType()) for n in ("host", "path", "rule", "verdict"))])

    def run(batches):
        find = trie.value.match
        for batch in batches:
            parts = [split_url(x.as_py()) for x in batch.column(1)]
            found = [find(*p) or (None, otherwise) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in ([p[0] for p in parts], [p[1] for p in parts], [f[0] for f in found], [f[1] for f in found]))], names=schema.names)

    return pages.select(id_col, url_col).mapInArrow(run, schema)


def _joined(pages: DataFrame, rules: DataFrame, id_col: str, url_col: str, otherwise: str) -> DataFrame:
    """judge() by joins, for lists that are not broadcast."""

    def parted(batches):
        for batch in batches:
            parts = [split_url(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in ([p[0] for p in parts], [p[1] for p in parts]))], names=[id_col, "host", "path"])

    def sound(batches):
        for batch in batches:
            rows = [checked(tuple(r.values())) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else ([], [], []))], names=["verdict", "h", "p"])

    urls = pages.select(id_col, url_col).mapInArrow(parted, StructType([pages.schema[id_col], StructField("host", StringType()), StructField("path", StringType())]))
    rows = scratch.cut(scratch.cut(urls, "urls").withColumn("_row", F.monotonically_increasing_id()), "urls")
    known = scratch.cut(rules.select("verdict", "host", "path").mapInArrow(sound, "verdict string, h string, p string").groupBy("h", "p").agg(F.min("verdict").alias("verdict")), "rules")
    deep = known.agg(F.max(F.size(F.split("h", r"\.")))).first()[0] or 0
    lengths = known.groupBy("h").agg(F.collect_set(F.length("p")).alias("lengths"))
    suffix = F.expr(f"transform(sequence(1, least(size(labels), {max(deep, 1)})), k -> array_join(slice(labels, -k, k), '.'))")
    of = rows.withColumn("labels", F.split("host", r"\.")).select("_row", "path", F.explode(suffix).alias("h"))
    begun = of.join(lengths, "h").select("_row", "h", "path", F.explode("lengths").alias("n")).where("n <= length(path)").select("_row", "h", F.expr("substring(path, 1, n)").alias("p"))
    best = begun.join(known, ["h", "p"]).groupBy("_row").agg(F.max_by(F.struct(F.concat("h", "p").alias("rule"), "verdict"), F.struct(F.length("h"), F.length("p"))).alias("m"))
    return rows.join(best, "_row", "left").select(id_col, "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", F.lit(otherwise)).alias("verdict"))
