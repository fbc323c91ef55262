"""Text expressions: cleaning, token counts, rendering, staged truncation, entity types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNCATED = "\n\n[...TRUNCATED...]\n\n"
#: Tokens kept free when blocks are put together after truncation.
SLACK = 4


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without any Unicode white space at both ends; trim() takes spaces only."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def first_filled(*cs: Column | str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs])


def clean_user_text(c: Column | str) -> Column:
    """A user message without system reminders."""
    return strip(F.regexp_replace(col(c), r"(?s)<system-reminder>.*?</system-reminder>", ""))


def tool_summary(kind: Column, cmd: Column, action: Column, target: Column) -> Column:
    """What a tool call did, in one line, by its type."""
    return (
        F.when(kind == "bash", F.coalesce(first_filled(cmd), F.lit("(empty cmd)")))
        .when(kind == "mcp_call", F.coalesce(first_filled(target, action), F.lit("(empty target)")))
        .otherwise(F.coalesce(first_filled(action, cmd, target), F.lit("(unknown)")))
    )


def summarize_error(c: Column | str, most: int = 200) -> Column:
    text = strip(c)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("...[truncated, total "), F.length(text).cast("string"), F.lit(" chars]"))).otherwise(text)


def collapse_command(c: Column | str) -> Column:
    """An injected slash command or mention is folded to its first token; absolute paths and plain text stay."""
    text = F.regexp_replace(col(c), r"(?U)^\s+", "")

    def take(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    wrapped = F.coalesce(take(r"(?U)#\s*(/[A-Za-z][\w-]*)"), take(r"(?U)(/[A-Za-z][\w-]*)(?=\s|$)"), col(c))
    bare = F.coalesce(take(r"(?U)^(/[A-Za-z][\w-]*)(?=\s|$)"), take(r"(?U)^(@\S+)"), col(c))
    return F.when(F.startswith(text, F.lit("<auto-slash-command>")), wrapped).otherwise(bare)


def count_tokens(c: Column | str) -> Column:
    """The tokenizer-free estimate: three tokens for four characters, rounded down; null counts as empty."""
    return F.floor(F.coalesce(F.length(col(c)), F.lit(0)) * F.lit(0.75)).cast("int")


def safe_truncate(c: Column | str, max_tokens: Column | int, head_ratio: float = 0.7) -> Column:
    """Text over the budget keeps its head and tail: floor(budget / 0.75) characters with the marker, 70 % of them at the head; a
    budget that the marker alone would fill keeps the head only."""
    text, budget = col(c), max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens)
    chars = F.floor(budget / F.lit(0.75)).cast("int")
    head = F.least(F.floor(chars * F.lit(head_ratio)).cast("int"), F.greatest(chars - F.lit(len(TRUNCATED)), F.lit(0)))
    tail = F.greatest(chars - head - F.lit(len(TRUNCATED)), F.lit(0))
    cut = F.concat(F.substring(text, F.lit(1), head), F.lit(TRUNCATED), F.when(tail > 0, F.right(text, tail)).otherwise(F.lit("")))
    return F.when(count_tokens(text) <= budget, text).when(chars <= len(TRUNCATED), F.substring(text, F.lit(1), chars)).otherwise(cut)


def call_line(label: str, call: Column) -> Column:
    status = F.when(call["ok"], F.lit("OK")).otherwise(F.concat(F.lit("FAIL: "), F.coalesce(first_filled(call["error"]), F.lit("unknown"))))
    return F.concat(F.lit(f"\n[{label}:"), call["type"], F.lit("] "), call["summary"], F.lit(" ["), status, F.lit("]\n"))


def render_chunk(user: Column | str, assistant: Column | str, tools: Column | str, mcps: Column | str, note: Column | None = None) -> Column:
    """A chunk as readable text: user, assistant messages, tool calls, MCP calls and an optional note."""
    parts = [
        F.concat(F.lit("[User]\n"), F.coalesce(col(user), F.lit("")), F.lit("\n")),
        F.array_join(F.transform(col(assistant), lambda m: F.concat(F.lit("\n[Assistant]\n"), m, F.lit("\n"))), ""),
        F.array_join(F.transform(col(tools), lambda c: call_line("Tool", c)), ""),
        F.array_join(F.transform(col(mcps), lambda c: call_line("MCP", c)), ""),
    ]
    if note is not None:
        parts.append(F.when(note == "", F.lit("")).otherwise(F.concat(F.lit("\n"), note, F.lit("\n"))))
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def _note(dropped: Column) -> Column:
    return F.when(dropped > 0, F.concat(F.lit("[... "), dropped.cast("string"), F.lit(" tool/MCP calls omitted ...]"))).otherwise(F.lit(""))


def truncate_chunk(user: str, assistant: str, tools: str, mcps: str, max_tokens: Column | int) -> Column:
    """struct(stage, text): the first stage that fits. 0 whole; 1 without bash calls; 2 without tool calls either; 3 without
    any call; 4 the user message whole and the assistant's head and tail, or the user message alone, cut if need be."""
    message, calls = collapse_command(user), F.size(tools) + F.size(mcps)
    no_bash = F.filter(tools, lambda c: c["type"] != "bash")
    no_tool = F.filter(tools, lambda c: ~c["type"].isin("bash", "tool_call"))
    none = F.slice(F.col(tools), 1, 0)
    stages = [(F.col(tools), F.col(mcps)), (no_bash, F.col(mcps)), (no_tool, F.col(mcps)), (none, F.slice(F.col(mcps), 1, 0))]
    texts = [render_chunk(message, assistant, t, m, _note(calls - F.size(t) - F.size(m))) for t, m in stages]
    note = _note(calls)
    closing = F.when(note == "", F.lit("")).otherwise(F.concat(F.lit("\n"), note, F.lit("\n")))
    note_tokens = count_tokens(note) + F.when(note == "", 0).otherwise(2)
    block = F.concat(F.lit("[User]\n"), message, F.lit("\n"))
    left = (max_tokens if isinstance(max_tokens, Column) else F.lit(max_tokens)) - count_tokens(block) - note_tokens - SLACK
    joined = F.array_join(F.transform(assistant, lambda m: F.concat(F.lit("\n[Assistant]\n"), m, F.lit("\n"))), "")
    last = (
        F.when(left <= 0, safe_truncate(block, max_tokens))
        .when((F.size(assistant) == 0) | (left <= 20), F.concat(block, closing))
        .otherwise(F.concat(block, safe_truncate(joined, left), closing))
    )
    out = F.struct(F.lit(4).alias("stage"), last.alias("text"))
    for k in range(3, -1, -1):
        out = F.when(count_tokens(texts[k]) <= max_tokens, F.struct(F.lit(k).alias("stage"), texts[k].alias("text"))).otherwise(out)
    return out


#: The order and terms of entity typing, and the names that are no persons.
ENTITY_PATTERNS = [
    ("file", r"\.(py|js|ts|ya?ml|json|md|html|css)"),
    ("bug", r"(?U)\b(bug|issue|error|fix)\b|修复|问题|错误|异常"),
    ("tool", r"(?U)\b(tool|cli|command|api|sdk|framework)\b|工具|命令|框架"),
    ("project", r"(?U)\b(project|repo|app|application)\b|项目|仓库|应用"),
    ("module", r"(?U)\b(module|component|service|layer)\b|模块|组件|服务|层"),
]
NOT_CHINESE_NAMES = ["的", "了", "是", "在", "和", "与", "模型", "算法", "函数", "系统", "测试", "模块", "组件", "数据源", "缓存", "线程", "进程", "数据库"]
NOT_ENGLISH_NAMES = ["Web Server", "App Server", "Big Data", "Red Hat", "Domain Model", "Source Code", "Test Case", "User Interface", "Virtual Machine", "System Design", "Machine Learning", "Deep Learning", "Data Science", "Code Review", "Pull Request", "Merge Request"]
GENERIC = ["用户", "代码", "系统", "问题", "方法", "方式", "过程", "结果"]


def entity_type(c: Column | str) -> Column:
    name = strip(c)
    low = F.lower(name)
    chinese = F.rlike(name, F.lit("^[一-龥]{2,4}$")) & ~reduce(Column.__or__, [F.contains(name, F.lit(w)) for w in NOT_CHINESE_NAMES])
    english = F.rlike(name, F.lit("^[A-Z][a-z]+ [A-Z][a-z]+$")) & ~name.isin(NOT_ENGLISH_NAMES)
    out = F.when(F.lit(False), F.lit(""))
    for kind, pattern in ENTITY_PATTERNS:
        out = out.when(F.rlike(low, F.lit(pattern)), F.lit(kind))
    return out.when(chinese | english, F.lit("person")).otherwise(F.lit("concept"))


def valid_name(c: Column | str) -> Column:
    name = strip(c)
    return F.coalesce((name != "") & ~name.isin(GENERIC), F.lit(False))


def clamp_confidence(c: Column | str) -> Column:
    return F.least(F.greatest(F.coalesce(col(c).cast("double"), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


def tokens(c: Column | str) -> Column:
    """The default tokenizer: lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def preview(c: Column | str, most: int = 200) -> Column:
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most), F.lit("..."))).otherwise(col(c))


def session_of_chunk(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(c), r"^(.*)_c(\d+)$", 1), F.lit(""))


def full_chunk_id(c: Column | str, session: Column | str) -> Column:
    """c3 becomes <session>_c3; an id that names its session stays."""
    return F.when(F.startswith(col(c), F.lit("ses_")) | F.startswith(col(c), F.concat(col(session), F.lit("_"))), col(c)).otherwise(F.concat_ws("_", col(session), col(c)))


def retrieval_query(query: Column | str, instruction: str = "") -> Column:
    return F.concat(F.lit(instruction), col(query))


def in_time_range(c: Column | str, since: str | None, until: str | None) -> Column:
    """Both ends count; a missing end is open; a malformed range filters nothing; a bad timestamp is out of any range."""
    at, lo, hi = F.try_to_timestamp(col(c)), F.try_to_timestamp(F.lit(since)), F.try_to_timestamp(F.lit(until))
    if not since and not until:
        return F.lit(True)
    malformed = (F.lit(bool(since)) & lo.isNull()) | (F.lit(bool(until)) & hi.isNull())
    return malformed | F.coalesce((F.lit(not since) | (at >= lo)) & (F.lit(not until) | (at <= hi)), F.lit(False))
