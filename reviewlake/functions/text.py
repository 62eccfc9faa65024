"""Text rules as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions import constants as K

WORD = r"[\p{L}\p{N}_]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def or_default(c: Column | str, default, falsy=None) -> Column:
    """``c`` unless it is null or falsy (``''`` or ``0``), then ``default``.

    Absent values arrive in three shapes (null, empty text, zero) and all take the default, so a
    plain ``coalesce`` is not enough.
    """
    c = col(c)
    if falsy is None:
        falsy = 0 if isinstance(default, (int, float)) and not isinstance(default, bool) else ""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.when(c.isNull() | (c == F.lit(falsy)), fallback).otherwise(c)


def trim_ws(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(K.WS_CHARS))


def squeeze_ws(c: Column | str) -> Column:
    return F.regexp_replace(trim_ws(c), f"[{K.WS}]+", " ")


def is_blank(c: Column | str) -> Column:
    return F.coalesce(trim_ws(c), F.lit("")) == ""


def contains_any(c: Column, terms) -> Column:
    """True when ``c`` contains any of the literal ``terms``; one regex, so the text is scanned once."""
    terms = list(terms)
    if not terms:
        return F.lit(False)
    return c.rlike("|".join(_quote(t) for t in terms))


def _quote(term: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch not in " _/<>\"'@=`," and ord(ch) < 128 else ch for ch in term)


quote_regex = _quote


def word_pattern(*alternatives: str) -> str:
    """Regex for whole words; ASCII word boundaries, which Java's ``\\b`` is not in every version."""
    return "(?<![A-Za-z0-9_])(?:" + "|".join(alternatives) + ")(?![A-Za-z0-9_])"


def words(c: Column | str) -> Column:
    """Search tokens: lower-cased runs of letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(f"({WORD})"), 1)


def estimate_tokens(c: Column | str) -> Column:
    return F.ceil(F.length(F.coalesce(col(c), F.lit(""))) / F.lit(K.CHARS_PER_TOKEN)).cast("long")


def short_hash(c: Column | str) -> Column:
    return F.substring(F.md5(col(c)), 1, 8)


def slugify(c: Column | str) -> Column:
    s = trim_ws(F.lower(F.coalesce(col(c), F.lit(""))))
    # The last step makes one of several marks.
    s = F.translate(s, K.WS_CHARS, "-" * len(K.WS_CHARS))
    s = F.regexp_replace(s, "[^A-Za-z0-9_-]+", "")
    return F.regexp_replace(s, "--+", "-")


def line_array(c: Column | str) -> Column:
    return F.split(col(c), "\n", -1)


def truncate_lines(c: Column | str, max_lines: int, style: str = "context") -> Column:
    """First ``max_lines`` lines plus a marker; ``style`` picks the marker of prompts or of embeddings."""
    c = col(c)
    lines = line_array(c)
    n = F.size(lines)
    if style == "context":
        marker = F.concat(F.lit("\n... (truncated, "), (n - max_lines).cast("string"), F.lit(" more lines)"))
    elif style == "embedding":
        marker = F.concat(F.lit("\n... (truncated from "), n.cast("string"), F.lit(" lines)"))
    else:
        raise ValueError(f"unknown style {style!r}")
    return F.when(n > max_lines, F.concat(F.array_join(F.slice(lines, 1, max_lines), "\n"), marker)).otherwise(c)


def clean_document(c: Column | str) -> Column:
    """Normalise newlines and re-join lines broken inside sentences, list items and bullets."""
    ws = f"[{K.WS}]*"
    c = F.regexp_replace(col(c), "\r\n", "\n")
    c = F.regexp_replace(c, "\r", "\n")
    blank_run = f"\n{ws}\n{ws}\n"
    c = F.regexp_replace(c, blank_run, "\n\n")
    for pattern in (
        "([a-z,;:])\n([a-z])",
        "([a-zA-Z])\n([a-zA-Z])",
        rf"([0-9]+\.)\n{ws}([A-Za-z])",
        rf"([a-z]\.)\n{ws}([A-Za-z])",
        rf"(-|\*|\+)\n{ws}([A-Za-z])",
        f"([a-z])\n[{K.WS}]+([a-z])",
    ):
        c = F.regexp_replace(c, pattern, "$1 $2")
    c = F.regexp_replace(c, " {2,}", " ")
    c = F.regexp_replace(c, blank_run, "\n\n")
    return trim_ws(c)


def numbered_lines(c: Column | str) -> Column:
    """Every line with its number, an empty text's only line too; a null stays null."""
    lines = line_array(c)
    width = F.length(F.size(lines).cast("string"))
    numbered = F.transform(
        lines, lambda line, i: F.concat(F.lpad((i + 1).cast("string"), width, " "), F.lit(" | "), line)
    )
    return F.array_join(numbered, "\n")


def add_line_numbers(c: Column | str) -> Column:
    """:func:`numbered_lines` for display: no content has no lines to number."""
    c = F.coalesce(col(c), F.lit(""))
    return F.when(c == "", F.lit("")).otherwise(numbered_lines(c))


def verification_text(comment: Column | str, code: Column | str) -> Column:
    comment = squeeze_ws(F.coalesce(col(comment), F.lit("")))
    code = squeeze_ws(F.coalesce(col(code), F.lit("")))
    tail = F.substring(comment, -100, 100)
    chosen = (
        F.when(F.length(comment) <= 500, comment)
        .when(tail.rlike("(?i)" + word_pattern(*K.VERIFY_TAIL_WORDS)), F.concat(F.substring(comment, 1, 300), F.lit("... "), tail))
        .otherwise(F.substring(comment, 1, 400))
    )
    code = F.when(F.length(code) > 400, F.concat(F.substring(code, 1, 400), F.lit("..."))).otherwise(code)
    return F.concat(F.lit("Comment: "), chosen, F.lit(" Code: "), code)


def truncate_tokens(c: Column | str, max_tokens: int = 450, chars_per_token: int = 3) -> Column:
    """Longest prefix within the token budget, cut back to the last space when that keeps over 80 %.

    Closed form for the character-based token estimate ``ceil(length / 3)``.
    """
    c = F.coalesce(col(c), F.lit(""))
    limit = max_tokens * chars_per_token
    prefix = F.substring(c, 1, limit)
    last_space = F.length(prefix) - F.instr(F.reverse(prefix), " ")
    cut = F.when(
        (F.instr(prefix, " ") > 0) & (last_space > limit * 0.8), F.substring(prefix, F.lit(1), last_space.cast("int"))
    ).otherwise(prefix)
    return F.when(F.length(c) <= limit, c).otherwise(cut)


def combined_text(comment: Column | str, code: Column | str) -> Column:
    return F.concat_ws(
        "\n\n--- CODE CONTEXT ---\n\n", F.nullif(col(comment), F.lit("")), F.nullif(col(code), F.lit(""))
    )


def document_title(title: Column | str, content: Column | str) -> Column:
    """First ``# `` heading; else a title-cased file name from ``…:./NAME.ext``; else the given title."""
    title, content = col(title), col(content)
    heading = trim_ws(F.regexp_extract(content, rf"(?m)^#[{K.WS}]+(.+)$", 1))
    stem = F.regexp_replace(F.regexp_extract(title, r":\./([^/]+)\.([a-zA-Z]+)$", 1), "_", " ")
    # Only the first letter of each word changes; the rest keeps its case.
    cased = F.array_join(
        F.transform(
            F.regexp_extract_all(stem, F.lit(r"(\w+|\W+)"), 1),
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)),
        ),
        "",
    )
    return F.when(F.length(heading) > 0, heading).when(F.length(stem) > 0, cased).otherwise(title)


def guideline_query(code: Column, area: Column, tech: Column, keywords: Column, language: Column) -> Column:
    lower_tech = F.transform(tech, F.lower)
    general = F.filter(keywords, lambda k: ~F.array_contains(lower_tech, F.lower(k)))
    return F.concat(
        F.lit("Retrieve technical documentation, architectural guidelines, and best practices. "),
        _named_area(area, "Specifically looking for ", " related information. "),
        _listed(tech, "Focus on technologies like: "),
        _listed(F.slice(general, 1, 3), "Consider relevance to concepts such as: "),
        F.lit("Relevant to the following "), language, F.lit(" code snippet context: \\n```"), language,
        F.lit("\\n"), F.substring(code, 1, K.QUERY_CONTEXT_CHARS), F.lit("...\\n```"),
    )


def guideline_test_query(code: Column, area: Column, tech: Column, keywords: Column, language: Column) -> Column:
    pattern = "|".join(K.TEST_QUERY_WORDS)
    relevant = F.filter(keywords, lambda k: F.lower(k).rlike(pattern))
    return F.concat(
        F.lit("Retrieve testing documentation, test patterns, and testing best practices. "),
        F.lit("Focus on test coverage, test naming conventions, assertion patterns, mocking strategies, "
              "and test organization. "),
        _named_area(area, "Specifically looking for ", " testing patterns and practices. "),
        _listed(tech, "Focus on testing frameworks and patterns for: "),
        _listed(F.slice(relevant, 1, 3), "Consider testing concepts such as: "),
        F.lit("Relevant to the following "), language, F.lit(" test file context: \\n```"), language,
        F.lit("\\n"), F.substring(code, 1, K.QUERY_CONTEXT_CHARS), F.lit("...\\n```"),
    )


def _named_area(area: Column, before: str, after: str) -> Column:
    named = ~area.isin("Unknown", "GeneralJS_TS", "General")
    return F.when(named, F.concat(F.lit(before), area, F.lit(after))).otherwise(F.lit(""))


def _listed(items: Column, before: str) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(before), F.array_join(items, ", "), F.lit(". "))).otherwise(
        F.lit("")
    )
