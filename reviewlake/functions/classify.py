"""Rule-based comment classification."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions import constants as K
from reviewlake.functions.text import col, contains_any, estimate_tokens


def _hits(text: Column, patterns) -> Column:
    """How many of the patterns occur.

    Nearly all are plain words: those are one loop over a literal array, which keeps the generated code
    small; only real patterns run a regex.
    """
    plain = [p.replace("\\+", "+") for p in patterns if not re.search(r"[.*?]", p)]
    found = F.size(F.filter(F.array(*[F.lit(p) for p in plain]), lambda p: F.contains(text, p)))
    return reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in patterns if re.search(r"[.*?]", p)], found)


def category_scores(comment: Column | str, code: Column | str, path: Column | str) -> dict[str, Column]:
    """Per category: two points per pattern found in the comment, one in the code, half in the path."""
    text, code, path = (F.lower(F.coalesce(col(c), F.lit(""))) for c in (comment, code, path))
    return {
        name: _hits(text, patterns) * 2.0 + _hits(code, patterns) * 1.0 + _hits(path, patterns) * 0.5
        for name, patterns in K.CATEGORY_PATTERNS.items()
    }


def issue_category(comment: Column | str, code: Column | str, path: Column | str) -> Column:
    """Highest score wins, the earlier category on a tie; code or paths about credentials mean security."""
    scores = category_scores(comment, code, path)
    # array_max on (score, -order, name) is the ordered argmax; it scores each category once.
    ranked = F.array(*[
        F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
        for i, (name, score) in enumerate(scores.items())
    ])
    best = F.array_max(ranked)
    credentials = contains_any(F.lower(F.coalesce(col(code), F.lit(""))), ("password", "token")) | F.lower(
        F.coalesce(col(path), F.lit(""))
    ).contains("auth")
    return F.when(best["score"] > 0, best["name"]).when(credentials, "security").otherwise("general")


def severity(comment: Column | str, category: Column | str) -> Column:
    text = F.lower(F.coalesce(col(comment), F.lit("")))
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, patterns in K.SEVERITY_PATTERNS.items():
        rule = rule.when(text.rlike("|".join(patterns)), name)
    return rule.when(col(category) == "security", "major").otherwise("minor")


def pattern_tags(comment: Column | str) -> Column:
    text = F.lower(F.coalesce(col(comment), F.lit("")))
    return F.array_compact(F.array(*[
        F.when(contains_any(text, keywords), F.lit(tag)) for tag, keywords in K.PATTERN_KEYWORDS.items()
    ]))


def comment_type(path: Column, position: Column, line: Column) -> Column:
    has_path = F.coalesce(F.length(path) > 0, F.lit(False))
    return F.when(has_path & position.isNotNull(), "review").when(has_path & line.isNotNull(), "inline").otherwise(
        "issue"
    )


def change_size(diff: Column | str) -> Column:
    lines = F.split(F.coalesce(col(diff), F.lit("")), "\n", -1)
    return F.size(F.filter(lines, lambda x: x.startswith("+") | x.startswith("-"))).cast("long")


def file_complexity(path: Column | str, diff: Column | str) -> Column:
    path, diff = F.lower(col(path)), F.coalesce(col(diff), F.lit(""))
    bonus = lambda cond, points: F.when(cond, F.lit(float(points))).otherwise(F.lit(0.0))
    return (
        F.least(F.length(diff) / 1000.0, F.lit(20.0))
        + bonus(contains_any(path, ("/src/", "/lib/")), 10)
        + bonus(contains_any(path, ("/test/", "/spec/")), 5)
        + bonus(contains_any(path, ("/config/", "/settings/")), 8)
        + bonus(contains_any(path, ("/main.", "/index.")), 15)
        + bonus(diff.contains("new file mode"), 12)
        + bonus(diff.contains("deleted file mode"), 8)
    )


def cap_content(content: Column, budget_tokens: Column, label: str = "file content") -> Column:
    """Fit text to a token budget: first 70 % and last 30 % of what is left beside the marker."""
    content = F.coalesce(content, F.lit(""))
    max_chars = F.floor(budget_tokens * K.CHARS_PER_TOKEN).cast("int")
    marker = F.concat(
        F.lit(f"\n... ({label} truncated for PR review token budget; original length "),
        F.length(content).cast("string"), F.lit(" characters) ...\n"),
    )
    room = budget_tokens * K.CHARS_PER_TOKEN - F.length(marker)
    head = F.ceil(room * 0.7).cast("int")
    tail = F.floor(F.greatest(room - head, F.lit(0.0))).cast("int")
    one = F.lit(1)
    return (
        F.when((content == "") | (budget_tokens <= 0), F.lit(""))
        .when(F.length(content) <= budget_tokens * K.CHARS_PER_TOKEN, content)
        .when(budget_tokens * K.CHARS_PER_TOKEN <= F.length(marker) + 20, F.substring(content, one, max_chars))
        .otherwise(F.concat(
            F.substring(content, one, head), marker,
            F.when(tail > 0, F.substring(content, F.length(content) - tail + 1, tail)).otherwise(F.lit("")),
        ))
    )


__all__ = [
    "category_scores", "issue_category", "severity", "pattern_tags", "comment_type", "change_size",
    "file_complexity", "cap_content", "estimate_tokens",
]
