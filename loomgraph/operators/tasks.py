"""Task extraction around a language model: batch planning, JSON repair, ownership repair, merging of batches."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

OUTPUT_TOKENS, PROMPT_TOKENS, BATCH = 250, 30_000, 16


def needs_split(chunks: DataFrame, session: str = "session_id", tokens: str = "tokens") -> DataFrame:
    """(session, n_chunks, total, split): chunk tokens plus the expected output against the prompt budget."""
    total = F.sum(F.greatest(F.col(tokens), F.lit(0))) + F.count("*") * OUTPUT_TOKENS
    return chunks.groupBy(session).agg(F.count("*").alias("n_chunks"), total.alias("total")).withColumn("split", F.col("total") > PROMPT_TOKENS)


def plan_batches(chunks: DataFrame, session: str = "session_id", pos: str = "turn_index", tokens: str = "tokens", size: int = BATCH, budget: int = PROMPT_TOKENS) -> DataFrame:
    """(session, pos, batch_id): greedily `size` chunks at a time, halved (rounded up) until they fit the budget or one is left.

    A fold over the session's ordered sizes in the JVM: the state holds where the current batch begins, so only the array
    of sizes, one number for each chunk, is ever held together.
    """
    listed = chunks.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.greatest(F.col(tokens), F.lit(0)).cast("long").alias("t")))).alias("xs"))
    cost = f"aggregate(slice(xs, s.i + 1, s.m), 0L, (a, x) -> a + x.t + {OUTPUT_TOKENS}L)"
    tries = max(1, size.bit_length() + 1)
    fit = f"struct(s.i as i, least({size}, size(xs) - s.i) as m)"
    for _ in range(tries):
        fit = f"transform(array({fit}), s -> if(s.m > 1 and {cost} > {budget}L, struct(s.i as i, cast(ceil(s.m / 2) as int) as m), s))[0]"
    step = f"(st, x) -> if(st.i >= size(xs), st, transform(array(transform(array(struct(st.i as i)), s -> {fit})[0]), s -> struct(s.i + s.m as i, concat(st.out, array_repeat(st.n, s.m)) as out, st.n + 1 as n))[0])"
    folded = listed.select(session, "xs", F.expr(f"aggregate(xs, struct(0 as i, cast(array() as array<int>) as out, 1 as n), {step}).out").alias("b"))
    return folded.select(session, F.explode(F.arrays_zip(F.col("xs")["p"].alias("p"), F.col("b").alias("b"))).alias("z")).select(session, F.col("z.p").alias(pos), F.col("z.b").alias("batch_id"))


def format_prompts(chunks: DataFrame, chunk_tokens: int = 3000, budget: int = PROMPT_TOKENS) -> DataFrame:
    """(session_id, batch_id, prompt, tokens): the chunks of a batch in order, each under a line with its number. A prompt over the
    budget is put together again from chunks cut to max(200, budget / number of chunks - 100) tokens.

    chunks(session_id, batch_id, turn_index, user_message, assistant_messages, tool_calls, mcp_calls).
    """
    from loomgraph.functions import text

    block = lambda most: F.concat(F.lit("--- c"), F.col("turn_index").cast("string"), F.lit(" ---\n"), text.truncate_chunk("user_message", "assistant_messages", "tool_calls", "mcp_calls", most)["text"])
    key = ["session_id", "batch_id"]
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "block"))), lambda x: x["block"]), "\n\n")
    size = chunks.withColumn("block", block(chunk_tokens)).groupBy(*key).agg(put.alias("prompt"), F.count("*").alias("n")).withColumn("tokens", text.count_tokens("prompt"))
    over = size.where(F.col("tokens") > budget).select(*key, F.greatest(F.lit(200), F.floor(F.lit(budget) / F.col("n")) - 100).cast("int").alias("most"))
    again = chunks.join(over, key).withColumn("block", block(F.col("most"))).groupBy(*key).agg(put.alias("prompt")).withColumn("tokens", text.count_tokens("prompt"))
    return size.where(F.col("tokens") <= budget).select(*key, "prompt", "tokens").unionByName(again)


def call_model(prompts: DataFrame, model: Callable[[str], str | dict], column: str = "prompt", attempts: int = 3, wait: float = 2.0, rate_wait: float = 30.0, valid: Callable[[str], bool] = lambda reply: extract_json(reply) is not None) -> DataFrame:
    """prompts with reply, attempts and error. The model is any function of the prompt; it is called again, after waits that
    double, when it raises or its reply is not valid; the waits are longer when the error tells of a rate limit. A reply may be a
    dict with content and reasoning: the reasoning stands in for empty content. What still fails gives a null reply and the error."""
    schema = StructType([*prompts.schema.fields, StructField("reply", StringType()), StructField("attempts", IntegerType()), StructField("error", StringType())])
    kept = prompts.columns

    def one(prompt: str) -> tuple[str | None, int, str | None]:
        error = None
        for n in range(1, attempts + 1):
            try:
                reply = model(prompt)
                if isinstance(reply, dict):
                    reply = reply.get("content") or reply.get("reasoning") or ""
                if valid(reply):
                    return reply, n, None
                error = "the reply is not valid"
            except Exception as e:  # noqa: BLE001  whatever a model raises is a failed attempt
                error = str(e) or type(e).__name__
            if n < attempts:
                limited = bool(error and re.search(r"\b429\b|rate.?limit|too many requests", error, re.I))
                time.sleep((rate_wait if limited else wait) * 2 ** (n - 1))
        return None, attempts, error

    def run(batches):
        for df in batches:
            got = [one(p) for p in df[column]]
            yield df.assign(reply=[g[0] for g in got], attempts=[g[1] for g in got], error=[g[2] for g in got])[[*kept, "reply", "attempts", "error"]]

    return prompts.mapInPandas(run, schema)


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def repair_json(text: str, least: int = 0) -> str:
    """Closes what a cut-off JSON text left open, after dropping the unfinished part behind the last comma; at least so many
    characters stay."""
    stack, in_string, escaped, commas = [], False, False, []
    for i, c in enumerate(text):
        if in_string:
            escaped, in_string = (not escaped and c == "\\"), escaped or c != '"'
        elif c == '"':
            in_string = True
        elif c in "{[":
            stack.append(c)
        elif c in "}]" and stack:
            stack.pop()
        elif c == "," and i >= least:
            commas.append((i, list(stack)))
    close = lambda s: "".join("}" if c == "{" else "]" for c in reversed(s))
    for candidate in [text + ('"' if in_string else "") + close(stack), *(text[:i] + close(s) for i, s in reversed(commas))]:
        try:
            json.loads(candidate)
        except ValueError:
            continue
        return candidate
    return text


def extract_json(reply: str | None) -> str | None:
    """The JSON in a model's reply, as compact text: whole, fenced, the longest decodable part, between the outermost braces, or
    repaired. A decodable part inside a cut-off text counts only if that cannot be repaired. Null where there is none."""
    if not reply or not reply.strip():
        return None
    dump = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    for part in [reply.strip(), *(m.strip() for m in _FENCE.findall(reply))]:
        try:
            return dump(json.loads(part))
        except ValueError:
            pass
    decoder, best, behind = json.JSONDecoder(), (0, None), 0
    at = 0
    while (m := re.compile(r"[{\[]").search(reply, at)) is not None:
        try:
            value, end = decoder.raw_decode(reply, m.start())
        except ValueError:
            at = m.start() + 1
            continue
        if end - m.start() > best[0]:
            best, behind = (end - m.start(), value), end
        at = end
    begin = re.search(r"[{\[]", reply)
    short = begin and best[0] < (len(reply) - begin.start()) / 2
    if begin and (short or behind - best[0] > begin.start()):
        try:
            fixed = json.loads(repair_json(reply[begin.start() :].split("```")[0].strip(), 0 if short else behind - begin.start()))
            if fixed:
                return dump(fixed)
        except ValueError:
            pass
    return dump(best[1]) if best[1] is not None else None


def extract_json_udf(replies: Column) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(extract_json)

    return F.pandas_udf(run, "string")(replies)


TASKS_JSON = "struct<chunk_summaries:array<struct<chunk_id:string,summary:string>>,tasks:array<struct<task_id:string,task_label:string,task_summary:string,chunk_ids:array<string>>>>"
TRIPLES_JSON = "struct<triples:array<struct<head:string,relation:string,tail:string,confidence:double>>>"


def parse_triples(replies: DataFrame, reply: str = "reply", task: str = "task") -> DataFrame:
    parsed = F.from_json(extract_json_udf(F.col(reply)), TRIPLES_JSON)
    return replies.select(F.col(task).alias("source_task"), F.explode(parsed["triples"]).alias("t")).select("t.*", "source_task")


def parse_tasks(replies: DataFrame, reply: str = "reply", session: str = "session_id") -> DataFrame:
    """(session, task_pos, task_label, task_summary, chunk_id): short chunk ids completed by the session's."""
    from loomgraph.functions import text

    parsed = F.from_json(extract_json_udf(F.col(reply)), TASKS_JSON)
    tasks = replies.select(session, F.posexplode(parsed["tasks"]).alias("task_pos", "t"))
    return tasks.select(session, "task_pos", "t.task_label", "t.task_summary", F.explode_outer("t.chunk_ids").alias("c")).withColumn("chunk_id", text.full_chunk_id("c", F.col(session).cast("string"))).drop("c")


def parse_entities(replies: DataFrame, reply: str = "reply", task: str = "task", checked: bool = True) -> DataFrame:
    """(entity, source_task) of replies {"entities": [...]} or a bare list; names are stripped, and (checked) empty and generic ones go."""
    from loomgraph.functions import text

    body = extract_json_udf(F.col(reply))
    listed = F.when(F.startswith(body, F.lit("[")), F.from_json(body, "array<string>")).otherwise(F.from_json(body, "struct<entities:array<string>>")["entities"])
    rows = replies.select(F.col(task).alias("source_task"), F.explode(listed).alias("e")).select(text.strip("e").alias("entity"), "source_task").where("entity is not null")
    return rows.where(text.valid_name("entity")) if checked else rows.where("entity <> ''")


def validate_ids(parsed: DataFrame, chunks: DataFrame, session: str = "session_id", most: int = 5) -> tuple[DataFrame, DataFrame]:
    """parse_tasks() rows checked against chunks(session, chunk_id): (rows whose chunk id is known, with null chunks for tasks that
    are left without; a row for each session: n_tasks, n_unknown, odd: fewer than one task or more than `most`)."""
    known = chunks.select(session, "chunk_id", F.lit(True).alias("_known")).distinct()
    marked = parsed.join(known, [session, "chunk_id"], "left")
    good = marked.where("_known").drop("_known")
    alone = marked.select(session, "task_pos", "task_label", "task_summary").distinct().join(good.select(session, "task_pos").distinct(), [session, "task_pos"], "left_anti").withColumn("chunk_id", F.lit(None).cast("string"))
    n = F.count_distinct("task_pos")
    report = marked.groupBy(session).agg(n.alias("n_tasks"), F.count_if(F.col("_known").isNull() & F.col("chunk_id").isNotNull()).alias("n_unknown")).withColumn("odd", (F.col("n_tasks") < 1) | (F.col("n_tasks") > most))
    return good.select(session, "task_pos", "task_label", "task_summary", "chunk_id").unionByName(alone), report


def schedule(batches: DataFrame, session: str = "session") -> DataFrame:
    """(session, batch_id, phase): 0 for all where there is one session only; else 1 for sessions of one batch, then 2 for every batch
    of the others. Within a phase Spark runs them as its tasks come; results are ordered by (session, batch_id) afterwards."""
    sizes = batches.groupBy(session).agg(F.count("*").alias("_n"))
    several = sizes.limit(2).count() > 1
    return batches.join(sizes, session).select(session, "batch_id", (F.when(F.col("_n") == 1, 1).otherwise(2) if several else F.lit(0)).alias("phase"))


def confirmations(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """(a, b, merge) of a model's replies on pairs: a JSON list [{"pair": [a, b], "action": "merge" or "keep"}], an object
    {"results": [...]} of them, or for a row with columns a and b one object {"action": ...} or the words yes and no."""
    item = "array<struct<pair:array<string>,action:string>>"
    body = extract_json_udf(F.col(reply))
    listed = F.when(F.startswith(body, F.lit("[")), F.from_json(body, item)).otherwise(F.from_json(body, f"struct<results:{item}>")["results"])
    rows = replies.withColumn("_l", listed).withColumn("_one", F.coalesce(F.from_json(body, "struct<action:string>")["action"], F.regexp_extract(F.lower(reply), r"\b(yes|no|merge|keep)\b", 1)))
    many = rows.where("_l is not null").select(F.explode("_l").alias("x")).select(F.col("x.pair")[0].alias("a"), F.col("x.pair")[1].alias("b"), F.lower("x.action").alias("said"))
    single = rows.where("_l is null").select("a", "b", F.lower("_one").alias("said"))
    return many.unionByName(single).select("a", "b", F.col("said").isin("merge", "yes").alias("merge"))


def repair_owners(owned: pd.DataFrame, turns: dict[str, int]) -> pd.DataFrame:
    """(task_pos, chunk_id) in which every chunk of a session has one owner.

    owned(task_pos, chunk_id) are the claims. A chunk claimed twice goes to the task whose other chunks are nearest; a task
    without others comes before all of these; the first of equals holds. Unclaimed chunks, by spelling, go to the task with the nearest
    turn, and count for the chunks after them.
    """
    tasks = sorted(owned["task_pos"].unique().tolist())
    has: dict[int, list[str]] = {t: [c for c in owned.loc[owned["task_pos"] == t, "chunk_id"].dropna().drop_duplicates() if c in turns] for t in tasks}
    for chunk in sorted(turns, key=lambda c: (turns[c], c)):
        owners = [t for t in tasks if chunk in has[t]]
        if len(owners) > 1:
            far = [min((abs(turns[o] - turns[chunk]) for o in has[t] if o != chunk), default=float("-inf")) for t in owners]
            keep = owners[far.index(min(far))]
            for t in owners:
                if t != keep:
                    has[t].remove(chunk)
    for chunk in sorted(set(turns) - {c for cs in has.values() for c in cs}):
        if not tasks:
            break
        best = min((t for t in tasks if has[t]), key=lambda t: (min(abs(turns[o] - turns[chunk]) for o in has[t]), tasks.index(t)), default=tasks[0])
        has[best].append(chunk)
    rows = [(t, c) for t in tasks for c in has[t]]
    return pd.DataFrame(rows, columns=["task_pos", "chunk_id"])


def repair_ownership(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """(session_id, task_pos, chunk_id) from claims(session_id, task_pos, chunk_id) and chunks(session_id, chunk_id, turn_index).
    One session is one group; its chunks are bounded by its conversation."""
    both = claims.select("session_id", "task_pos", "chunk_id", F.lit(None).cast("int").alias("turn_index")).unionByName(chunks.select("session_id", F.lit(None).cast("int").alias("task_pos"), "chunk_id", F.col("turn_index").cast("int")))

    def one(df: pd.DataFrame) -> pd.DataFrame:
        turns = {c: int(t) for c, t in df.loc[df["turn_index"].notna(), ["chunk_id", "turn_index"]].itertuples(index=False)}
        owned = df.loc[df["task_pos"].notna(), ["task_pos", "chunk_id"]].astype({"task_pos": int})
        out = repair_owners(owned, turns)
        out.insert(0, "session_id", df["session_id"].iloc[0])
        return out

    return both.groupBy("session_id").applyInPandas(one, f"session_id {claims.schema['session_id'].dataType.simpleString()}, task_pos int, chunk_id string")


def merge_batches(tasks: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks renumbered T1.. within their session over its successful batches, session status). tasks(session, batch_id, pos, ...),
    batches(session, batch_id, status, attempts)."""
    good = batches.where(F.col("status") == "success").select("session", "batch_id")
    order = Window.partitionBy("session").orderBy("batch_id", "pos")
    numbered = tasks.join(good, ["session", "batch_id"], "left_semi").withColumn("task_id", F.concat(F.col("session").cast("string"), F.lit("_T"), F.row_number().over(order).cast("string")))
    n_good = F.count_if(F.col("status") == "success")
    status = F.when(n_good == F.count("*"), "success").when(n_good > 0, "partial").otherwise("failed")
    return numbered, batches.groupBy("session").agg(status.alias("status"), F.max("attempts").alias("attempts"), F.count("*").alias("n_batches"))


def status_rollup(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("attempts") > 1).alias("n_retried"))


def nearest_owner(uncovered: DataFrame, owned: DataFrame) -> DataFrame:
    """The relational form for one pass: each uncovered chunk's nearest owned chunk decides its task."""
    joined = uncovered.select("session_id", F.col("chunk_id").alias("c"), F.col("turn_index").alias("t")).join(owned, "session_id")
    best = F.struct(F.abs(F.col("t") - F.col("turn_index")), F.col("task_pos"))
    return joined.groupBy("session_id", F.col("c").alias("chunk_id")).agg(F.min_by("task_pos", best).alias("task_pos"))


def quality(extracted: DataFrame) -> DataFrame:
    """One row: label and summary lengths, chunks covered and claimed more than once."""
    return extracted.agg(F.avg(F.length("task_label")).alias("avg_label"), F.avg(F.length("task_summary")).alias("avg_summary"), F.count_distinct("chunk_id").alias("n_covered"), (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("n_duplicate"))
