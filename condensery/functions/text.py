"""Scalar text functions as Column expressions. Rounding is half-even throughout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .dims import CODE_KEYWORDS, FILLER_PATTERNS, PROFILES, STOP_WORDS

#: What strip() takes away: every character that counts as white space.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# Patterns of terms, numbers, records, timestamps and line breaks, of lines of code and logs, names, pull requests, and a judge's fallback reason.
CODE_LINE = r"(?md)^\s*(def |class |import |function |const |let |var |#include)"
LOG_LINE = r"(?md)^\s*\[?\d{4}-\d{2}-\d{2}|(?md)^\s*(INFO|DEBUG|WARN|ERROR)\b"
NAME = r"\b[A-Za-z_][A-Za-z0-9_]*\b"
PULL_ADDRESS, PULL_SHORT = r"github\.com/([^/\s]+)/([^/\s]+?)(?:\.git)?/pull/(\d+)", r"^([^/\s]+)/([^/#\s]+?)(?:\.git)?#(\d+)$"
NO_JSON = "judge response was not valid JSON; fell back to keyword match"
TERM = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\-.]*[\p{L}\p{N}_])?"
NUMBER = r"\b\d[\d:,.\-T]*\d\b|\b\d+\b"
RECORD_START = r"^\s*(\[?\d{4}-\d{2}-\d{2}|(INFO|DEBUG|WARN|WARNING|ERROR|CRITICAL|Traceback)\b)"
TIMESTAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?|\d{2}:\d{2}:\d{2}"
BREAKS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def token_count(text: Column, model: str = "default") -> Column:
    """Mean of a character and a word estimate; 0 only for empty text. A null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return tokens_of(text, word_count(text), model)


def tokens_of(text: Column, n_words: Column, model: str = "default") -> Column:
    """``token_count`` of a text that is not null and whose words are counted."""
    # Without branches, so that words are counted once: no characters give 0, and without words the mean is missing.
    chars = F.least(F.length(text).cast("double"), F.greatest(F.lit(1.0), F.bround(F.length(text) / F.lit(PROFILES.get(model, PROFILES["default"])), 0)))
    words = F.nullif(n_words, F.lit(0))
    return F.coalesce(F.bround((chars + F.bround(words * F.lit(1.3), 0)) / 2, 0), chars).cast("int")


def budget(tokens: Column, target: float | Column) -> Column:
    """Tokens that may stay."""
    return F.greatest(F.lit(1.0), F.bround(tokens * (F.lit(1.0) - target), 0)).cast("int")


def ratio(before: Column, after: Column) -> Column:
    return F.when(before > 0, 1 - after / before).otherwise(F.lit(0.0))


def content_type(text: Column) -> Column:
    code = F.regexp_count(text, F.lit(CODE_LINE))
    logs = F.regexp_count(text, F.lit(LOG_LINE))
    return F.when((logs > code) & (logs > 2), "logs").when(code > 2, "code").otherwise("prose")


def normalized_line(line: Column) -> Column:
    return F.regexp_replace(strip(line), NUMBER, "<N>")


def starts_record(line: Column) -> Column:
    return line.rlike(RECORD_START)


def split_lines(text: Column) -> Column:
    """Lines of a text; no empty one at the end."""
    parts = F.split(text, BREAKS, -1)
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def split_sentences(text: Column) -> Column:
    return F.filter(F.split(strip(text), r"(?<=[.!?])\s+", -1), lambda s: ~is_blank(s))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def references(text: Column) -> Column:
    return F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), F.lit(0))), F.array(*map(F.lit, CODE_KEYWORDS))))


def is_filler(text: Column, extra: tuple[str, ...] = ()) -> Column:
    out = F.lit(False)
    for pattern in (*FILLER_PATTERNS, *extra):
        out = out | text.rlike(rf"(?i)\A(?:{pattern})")
    return out


def is_trivial(text: Column) -> Column:
    return F.length(strip(text)) < 3


def html_escape(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def fit_target(tokens: Column, room: Column) -> Column:
    """Target compression that brings ``tokens`` into ``room``."""
    return F.least(F.greatest(1 - room / tokens, F.lit(0.05)), F.lit(0.95))


def cost(tokens: Column, price: Column) -> Column:
    """Dollars for ``tokens`` at ``price`` dollars a million."""
    return tokens / 1_000_000 * price


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def budget_percent(tokens: Column, budget: Column) -> Column:
    """Share of a budget in whole percent, halves upwards, 999 at most."""
    return F.least(F.lit(999), half_up(tokens / budget * 100)).cast("int")


def estimated_tokens(tokens: Column, target: float | Column) -> Column:
    """Tokens to expect after compression, halves upwards."""
    return F.greatest(F.lit(0), half_up(tokens * (F.lit(1.0) - target))).cast("int")


def judgement(raw: Column) -> Column:
    """(agrees, reason) of a judge's JSON reply; a reply that is no JSON object agrees if its first 20 characters hold "true". A null reply is an empty one."""
    raw = F.coalesce(raw, F.lit(""))
    reply = F.try_parse_json(raw)
    verdict = F.try_variant_get(reply, "$.agrees", "variant")
    kind, shown = F.schema_of_variant(verdict), F.try_variant_get(reply, "$.agrees", "string")
    # A value counts as it would in a condition: false, 0, null and whatever is empty do not agree.
    holds = F.when(kind == "STRING", shown != "").when(kind == "BOOLEAN", shown == "true").when(kind.rlike("^(OBJECT|ARRAY)"), ~F.to_json(verdict).isin("[]", "{}")).otherwise(shown.try_cast("double") != 0)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(reply), F.lit("OBJECT")), F.lit(False))
    return F.struct(
        F.when(is_object, F.coalesce(holds, F.lit(False))).otherwise(F.contains(F.left(F.lower(raw), F.lit(20)), F.lit("true"))).alias("agrees"),
        F.when(is_object, F.coalesce(F.try_variant_get(reply, "$.reason", "string"), F.lit(""))).otherwise(NO_JSON).alias("reason"),
    )


def short_count(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def pull_request(reference: Column) -> Column:
    """owner, repo and number of a pull-request address or ``owner/repo#n``; nulls if it is neither."""
    part = lambda k: F.coalesce(*(F.nullif(F.regexp_extract(strip(reference), p, k), F.lit("")) for p in (PULL_ADDRESS, PULL_SHORT)))
    return F.struct(part(1).alias("owner"), part(2).alias("repo"), part(3).cast("int").alias("number"))
