"""Parsers for order text, user messages, tool calls, snippets and logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import _col, strip


# --- labelled lines and item lines ------------------------------------------------

def label_of(line: Column, labels: Mapping[str, Sequence[str]] = fv.LINE_LABELS) -> Column:
    """struct(field, value) of a line that starts with a known label, else null."""
    line = strip(line)
    words = [w for ws in labels.values() for w in ws]
    fields = F.create_map(*[F.lit(x) for f, ws in labels.items() for w in ws for x in (w, f)])
    label = F.regexp_extract(line, "^(?:" + "|".join(words) + ")", 0)
    value = strip(F.regexp_replace(F.substr(line, F.length(label) + 1), r"^[\s\p{Z}：:,，、]+", ""))
    return F.when(label != "", F.struct(fields[label].alias("field"), value.alias("value")))


def parse_items(lines: DataFrame, line: str = "line", units: Sequence[str] = fv.COUNT_UNITS,
                spec_markers: str = fv.SPEC_MARKERS) -> DataFrame:
    """Rows whose line reads 'n [code] name… [spec…] qty unit', with product_code, product_name, spec, quantity and unit.

    Step by step in columns, so that no step is computed twice.
    """
    keep = lines.columns
    number = r"^\d+(\.\d+)?$"
    none = F.array().cast("array<string>")
    d = lines.withColumn("_p", F.filter(F.split(strip(line), r"[\s\p{Z}]+"), lambda t: t != ""))
    d = d.where((F.size("_p") >= 3) & F.regexp_replace(F.get("_p", F.lit(0)), r"[.、]+$", "").rlike(r"^\d+$"))
    # last numeric token, never the first token
    d = d.withColumn("_at", F.array_max(F.filter(
        F.transform("_p", lambda t, i: F.when((i > 0) & t.rlike(number), i)), lambda i: i.isNotNull())))
    d = d.withColumn("quantity", F.floor(F.get("_p", F.col("_at")).try_cast("double")).cast("bigint"))
    d = d.withColumn("_code", F.get("_p", F.lit(1)).rlike(r"^[A-Za-z][A-Za-z0-9]{2,}$"))
    d = d.withColumn("_from", F.when(F.col("_code"), 2).otherwise(1))
    d = d.withColumn("_m", F.when(F.col("_at") > F.col("_from"), F.slice("_p", F.col("_from") + 1, F.col("_at") - F.col("_from"))).otherwise(none))
    d = d.withColumn("_cut", F.coalesce(F.array_min(F.filter(
        F.transform("_m", lambda t, i: F.when(t.rlike(spec_markers), i)), lambda i: i.isNotNull())), F.size("_m")))
    d = d.withColumn("product_name", F.array_join(F.slice("_m", F.lit(1), F.col("_cut")), ""))
    after = F.get("_p", F.col("_at") + 1)
    # the result leaves through a generator, so the last filter is not pushed into the steps and repeated there
    item = F.struct(
        F.when(F.col("_code"), F.get("_p", F.lit(1))).otherwise("").alias("product_code"), "product_name",
        F.array_join(F.slice("_m", F.col("_cut") + 1, F.size("_m") - F.col("_cut")), " ").alias("spec"), "quantity",
        F.when(after.isin(*units), after).otherwise(fv.DEFAULT_UNIT).alias("unit"))
    return d.select(*keep, F.inline(F.array(item))).where("quantity > 0 and product_name <> ''")


def explode_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per text line, numbered from 0."""
    keep = [c for c in df.columns if c != text_col]
    return df.select(*keep, F.posexplode(F.split(text_col, r"\r\n|\n|\r")).alias("line_no", "line"))


def labelled_fields(df: DataFrame, key: str, text_col: str = "text",
                    labels: Mapping[str, Sequence[str]] = fv.LINE_LABELS) -> DataFrame:
    """First non-empty value per document and field, one column per field."""
    lines = explode_lines(df.select(key, text_col), text_col).withColumn("hit", label_of(F.col("line"), labels))
    hits = lines.where(F.col("hit").isNotNull() & (F.col("hit.value") != "")).select(
        key, "line_no", F.col("hit.field").alias("field"), F.col("hit.value").alias("value"))
    return hits.groupBy(key).agg(*[
        F.coalesce(F.min_by(F.when(F.col("field") == f, F.col("value")),
                            F.when(F.col("field") == f, F.col("line_no"))), F.lit("")).alias(f)
        for f in labels])


def item_lines(df: DataFrame, key: str, text_col: str = "text",
               labels: Mapping[str, Sequence[str]] = fv.LINE_LABELS) -> DataFrame:
    """Item lines of each document; labelled lines are never items."""
    lines = explode_lines(df.select(key, text_col), text_col)
    # an item starts with its number, which a cheap test sees before the label and token work
    numbered = lines.where(F.col("line").rlike(r"^[\s\p{Z}]*\d"))
    return parse_items(numbered.where(label_of(F.col("line"), labels).isNull())).drop("line")


# --- structured payloads -----------------------------------------------------------

def salvage_json(c: Column | str) -> Column:
    """First fenced block that parses as JSON, else the text without think part and markup if that parses, else null."""
    c = _col(c)

    def body(block: Column) -> Column:
        block = strip(block)
        return strip(F.when(block.startswith("json"), F.substr(block, F.lit(5))).otherwise(block))

    def parses(block: Column) -> Column:
        return (block != "") & F.try_parse_json(block).isNotNull()

    blocks = F.filter(F.transform(F.split(c, "```"), body), parses)
    close = F.instr(c, "</think>")
    rest = F.when(close > 0, F.substr(c, close + 8)).otherwise(c)
    rest = strip(F.regexp_replace(rest, r"<[^>]+>", ""))
    return F.when(F.size(blocks) > 0, F.get(blocks, F.lit(0))).when(parses(rest), rest)


# --- user messages -------------------------------------------------------------------

def user_action(c: Column | str, rules: Sequence[tuple] = fv.USER_ACTIONS) -> Column:
    """Action named by the first rule that fits, else null. Rules look for parts of words, as listed."""
    c = _col(c)
    low = F.lower(c)
    out = None
    for action, lowered, exact in rules:
        hit = F.lit(False)
        for w in lowered:
            hit = hit | low.contains(w)
        for w in exact:
            hit = hit | c.contains(w)
        out = F.when(hit, action) if out is None else out.when(hit, action)
    return out


def edit_instruction(
    c: Column | str,
    confirm: Sequence[str] = fv.CONFIRM_WORDS, cancel: Sequence[str] = fv.CANCEL_WORDS,
    row_pattern: str = fv.EDIT_ROW, value_pattern: str = fv.EDIT_VALUE,
    fields: Sequence[tuple[str, str]] = tuple(fv.EDIT_FIELDS), all_fields: Sequence[tuple[str, str]] = tuple(fv.ALL_FIELDS),
    all_pattern: str = fv.EDIT_ALL,
) -> Column:
    """struct(action, edits): confirm, cancel, modify with an array of (row, field, new_value), or ask.

    Row 0 stands for 'all rows'.
    """
    msg = strip(c)

    def any_of(words: Sequence[str]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | msg.contains(w)
        return hit

    none = F.array().cast("array<struct<row:bigint,field:string,new_value:string>>")

    def named(found: Column, names: Sequence[tuple[str, str]]) -> Column:
        out = None
        for word, field in names:
            out = F.when(found == word, field) if out is None else out.when(found == word, field)
        return out

    field = named(F.regexp_extract(msg, "(" + "|".join(w for w, _ in fields) + ")", 1), fields)
    value = strip(F.regexp_extract(msg, value_pattern, 1))
    rows = F.regexp_extract_all(msg, F.lit(row_pattern), F.lit(1))
    row_edits = F.when(field.isNotNull() & (value != ""), F.transform(rows, lambda r: F.struct(
        r.cast("bigint").alias("row"), field.alias("field"), value.alias("new_value")))).otherwise(none)
    every = all_pattern.format("|".join(w for w, _ in all_fields))
    all_field = named(F.regexp_extract(msg, every, 1), all_fields)
    all_edit = F.when(all_field.isNotNull(), F.array(F.struct(
        F.lit(0).cast("bigint").alias("row"), all_field.alias("field"),
        strip(F.regexp_extract(msg, every, 2)).alias("new_value")))).otherwise(none)
    edits = F.concat(row_edits, all_edit)
    return (
        F.when(any_of(confirm), F.struct(F.lit("confirm").alias("action"), none.alias("edits")))
        .when(any_of(cancel), F.struct(F.lit("cancel").alias("action"), none.alias("edits")))
        .when(F.size(edits) > 0, F.struct(F.lit("modify").alias("action"), edits.alias("edits")))
        .otherwise(F.struct(F.lit("ask").alias("action"), none.alias("edits")))
    )


# --- traces -----------------------------------------------------------------------------

THINK_MARK = r"(?s)\*\*(?:思|思考)[^*]*(?:\*\*(.*?)\*\*|$)"
STEP_PATTERNS = [
    r"(?s)\*\*(?:思|思考|推理|分析|判断)[^*]*?\*\*(.*?)(?=\*\*|$)",
    r"(?s)(?:思|思考|推理|分析|判断)[：:]\s*(.*?)(?:\n|$)",
]


def _shown(c: Column, keep: int | None) -> Column:
    """The text, or as many characters as a report shows."""
    return c if keep is None else F.left(c, F.lit(keep))


def reasoning_blocks(c: Column | str, keep: int | None = None, keep_line: int | None = None) -> Column:
    """Marked reasoning segments, else lines that name reasoning."""
    c = _col(c)
    marked = F.filter(F.transform(F.regexp_extract_all(c, F.lit(THINK_MARK), F.lit(1)), strip), lambda t: t != "")
    lines = F.filter(F.split(c, "\n"), lambda s: s.contains("思") & s.rlike(r"\*\*|推理|判断"))
    return F.when(F.size(marked) > 0, F.transform(marked, lambda t: _shown(t, keep))).otherwise(
        F.transform(lines, lambda t: _shown(strip(t), keep_line)))


def reasoning_steps(c: Column | str, keep: int | None = None) -> Column:
    """Reasoning steps: marked segments longer than 5 characters, else numbered or bulleted lines."""
    c = _col(c)
    marked = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in STEP_PATTERNS])
    marked = F.filter(F.transform(marked, strip), lambda t: F.length(t) > 5)
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda s: s.rlike(r"^\d+[.)]\s+|^-\s+"))
    return F.transform(
        F.when(F.size(marked) > 0, marked).otherwise(F.transform(lines, lambda s: F.regexp_replace(s, r"^\d+[.)]\s+", ""))),
        lambda t: _shown(t, keep))


def args_summary(tool: Column, args: Column, store_tool: str = fv.STORE_TOOL, sku_tool: str = fv.SKU_TOOL,
                 output_tools: Sequence[str] = tuple(fv.OUTPUT_TOOLS),
                 keep_keys: int | None = None, keep_command: int | None = None) -> Column:
    """Short reading of a tool call's JSON arguments; a report may show only some keys and the beginning of a command."""
    def at(path: str, default: str) -> Column:
        return F.coalesce(F.get_json_object(args, path), F.lit(default))

    def count_at(path: str) -> Column:
        return F.coalesce(F.json_array_length(F.get_json_object(args, path)), F.lit(0)).cast("string")

    keys = F.coalesce(F.json_object_keys(args), F.array().cast("array<string>"))
    keys = keys if keep_keys is None else F.slice(keys, 1, keep_keys)
    command = F.coalesce(F.get_json_object(args, "$.command"), F.get_json_object(args, "$.cmd"), F.lit(""))
    return (
        F.when(tool.isin(*fv.PARSE_TOOLS), F.concat(F.lit("输入类型: "), at("$.order_type", "unknown")))
        .when(tool == store_tool, F.concat(F.lit("门店: "), at("$.store_name", "")))
        .when(tool == sku_tool, F.concat(F.lit("SKU数量: "), count_at("$.items")))
        .when(tool.isin(*output_tools), F.concat(
            F.lit("门店数: "), count_at("$.stores"), F.lit(", SKU数: "), at("$.sku_count", "0")))
        .when(tool.isin(*fv.COMMAND_TOOLS), F.concat(F.lit("命令: "), _shown(command, keep_command), F.lit("" if keep_command is None else "...")))
        .otherwise(F.concat(F.lit("参数: "), F.array_join(keys, ", ")))
    )


# --- snippets, titles and logs --------------------------------------------------------------

def plain_text(c: Column | str) -> Column:
    """Text without markup; three entities decoded in this order."""
    out = F.regexp_replace(_col(c), r"<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(out)


def listing_title(c: Column | str, suffixes: Sequence[str] = fv.TITLE_SUFFIXES, keep: int | None = None) -> Column:
    out = _col(c)
    for s in suffixes:
        out = F.regexp_replace(out, s, "")
    return _shown(strip(out), keep)


def first_email(c: Column | str, skip_domain: str = fv.PUBLIC_MAIL_DOMAIN) -> Column:
    """First e-mail, lower-cased; '' where it belongs to the public domain."""
    found = F.lower(F.regexp_extract(_col(c), fv.EMAIL, 0))
    return F.when(~found.contains("http") & ~found.contains(skip_domain) & (F.length(found) > 5), found).otherwise("")


def first_phone(c: Column | str) -> Column:
    c = _col(c)
    return F.coalesce(F.nullif(F.regexp_extract(c, fv.MOBILE, 0), F.lit("")), F.regexp_extract(c, fv.LANDLINE, 0))


def contact_name(c: Column | str, patterns: Sequence[str] = fv.CONTACT_PATTERNS) -> Column:
    c = _col(c)
    found = [strip(F.regexp_extract(c, p, 1)) for p in patterns]
    return F.coalesce(*[F.when(F.length(f) >= 2, f) for f in found], F.lit(""))


def fold_contacts(df: DataFrame, key: str, rank_col: str, text_col: str) -> DataFrame:
    """First e-mail, phone and contact over the ranked texts of each key."""
    parts = df.select(key, rank_col, *[
        F.nullif(f(text_col), F.lit("")).alias(n)
        for n, f in (("email", first_email), ("phone", first_phone), ("contact", contact_name))])
    return parts.groupBy(key).agg(*[
        F.coalesce(F.min_by(n, F.when(F.col(n).isNotNull(), F.col(rank_col))), F.lit("")).alias(n)
        for n in ("email", "phone", "contact")])


RECORD_DATE = r"202[56]-\d{2}-\d{2}"
EVIDENCE = [
    r"[0-9a-f]{7,40}", r"\b\w+\.(py|sh|md|sql|json|yaml|yml|pyc)\b", r"`[/~][^`]+`", r"https?://",
    r"✅|❌|⚠️|🎉", r"\d+%|\d+\.\d+",
]


def record_quality(c: Column | str, age_days: Column, date_pattern: str = RECORD_DATE,
                   fact_words: Sequence[str] = fv.FACT_WORDS, reason_words: Sequence[str] = fv.REASON_WORDS) -> Column:
    """struct(has_when, has_what, has_why, has_witness, quality, level) of a text record."""
    c = _col(c)
    flags = {
        "has_when": c.rlike(date_pattern),
        "has_what": c.rlike("|".join(fact_words)),
        "has_why": c.rlike("|".join(reason_words)),
        "has_witness": c.rlike("|".join(f"(?:{p})" for p in EVIDENCE)),
    }
    base = sum((f.cast("int") for f in flags.values()), F.lit(0)) / F.lit(4.0)
    freshness = F.when(age_days < 7, 1.0).when(age_days < 30, 0.7).otherwise(0.5)
    evidence = (
        F.when(c.rlike(r"[0-9a-f]{7,40}") | c.rlike(r"\d+%|测试 \d+/\d+"), 1.0)
        .when(c.rlike(r"`[^`]+\.(py|sh|md|sql|json|yaml|yml)`"), 0.8)
        .otherwise(0.7)
    )
    from .text import round_half_up

    quality = round_half_up(base * freshness * evidence, 3)
    level = F.when(quality >= 0.8, "high").when(quality >= 0.5, "medium").otherwise("low")
    return F.struct(*[f.alias(n) for n, f in flags.items()], quality.alias("quality"), level.alias("level"))


def log_headline(c: Column | str) -> Column:
    """First first-level heading, else null."""
    return F.nullif(F.regexp_extract(_col(c), r"(?m)^#[^\S\n]+(\S.*?)$", 1), F.lit(""))


BULLET_RULES = [
    ("done", r"^- \[x\]|^✅"), ("decision", r"^\*\*.*决定"), ("lesson", r"学到的教训|关键学习"),
    ("bug", r"(?i)bug.*修复|修复.*bug"),
]


def log_bullets(df: DataFrame, key: str, text_col: str, rules: Sequence[tuple[str, str]] = tuple(BULLET_RULES),
                top: int | None = None, keep: int | None = None) -> DataFrame:
    """Classified bullet lines of each log, all or the first `top` per log."""
    from ..operators.ranking import top_k

    lines = explode_lines(df.select(key, text_col), text_col).withColumn("line", strip("line"))
    kind = None
    for name, pattern in rules:
        hit = F.col("line").rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    body = F.when(F.col("kind") == "done", F.regexp_replace("line", r"^- \[x\] |^✅ ?", "")).otherwise(F.col("line"))
    found = lines.withColumn("kind", kind).where("kind is not null").select(
        key, "line_no", "kind", _shown(body, keep).alias("bullet"))
    return found if top is None else top_k(found, [key], [F.col("line_no")], top).drop("rank")


def index_tokens(c: Column | str, stop_words: Sequence[str] = fv.INDEX_STOP_WORDS) -> Column:
    """Distinct CJK runs (2+) and identifiers (3+) without stop words."""
    c = _col(c)
    cjk = F.regexp_extract_all(c, F.lit(r"([\x{4e00}-\x{9fff}]{2,})"), F.lit(1))
    ids = F.regexp_extract_all(c, F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1))
    return F.filter(F.array_distinct(F.concat(cjk, ids)), lambda w: ~F.lower(w).isin(*stop_words))
