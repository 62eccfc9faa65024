"""Row predicates. Each returns a boolean Column, so filters stay inside the scan's stage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions import constants as K
from reviewlake.functions import paths as P
from reviewlake.functions.text import col, contains_any, quote_regex


def is_test_file(path: Column | str) -> Column:
    return F.coalesce(F.lower(col(path)).rlike(K.TEST_PATH_PATTERN), F.lit(False))


def is_test_path_like(path: Column | str) -> Column:
    """The search filter's narrower definition; ``_`` is a LIKE wildcard and is kept as one."""
    path = col(path)
    return path.like("%.test.%") | path.like("%.spec.%") | path.like("%_test.py") | path.like("test_%.py")


def is_documentation(path: Column | str) -> Column:
    lower = F.lower(col(path))
    name, ext = P.basename(lower), P.extension(lower)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    return (
        F.when(ext.isin(*K.CODE_EXTENSIONS), False)
        .when(ext.isin(*K.DOCUMENT_EXTENSIONS), True)
        .otherwise(stem.isin(*K.DOC_FILENAMES) | contains_any(lower, K.DOC_DIRECTORIES) | contains_any(name, K.DOC_TERMS))
    )


def excluded_reason(
    path: Column | str, size: Column | str | None = None, exclude_globs=(), relative_path: Column | str | None = None,
    ignored: Column | None = None,
) -> Column:
    """Why a file is not processed, or null. ``ignored`` flags rows found in an ignored-paths table."""
    path = col(path)
    name = P.basename(path)
    relative = path if relative_path is None else col(relative_path)
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    if size is not None:
        rule = rule.when(col(size) > K.MAX_FILE_BYTES, "too_large")
    rule = (
        rule.when(F.lower(P.extension(path)).isin(*K.BINARY_EXTENSIONS), "binary")
        .when(contains_any(path, [f"/{d}/" for d in K.SKIP_DIRECTORIES]), "skip_directory")
        .when(name.isin(*K.SKIP_FILENAMES), "skip_filename")
        .when(path.rlike("|".join(K.SKIP_PATH_PATTERNS)) | name.rlike("|".join(K.SKIP_NAME_PATTERNS)), "generated")
    )
    if exclude_globs:
        rule = rule.when(P.matches_glob(relative, exclude_globs), "excluded")
    if ignored is not None:
        rule = rule.when(ignored, "ignored")
    return rule


def should_process(path: Column | str, size: Column | str | None = None, **rules) -> Column:
    return excluded_reason(path, size, **rules).isNull()


def detect_file_type(path: Column | str, content: Column | str | None = None) -> Column:
    """Struct of extension, language, type, framework and flags; the third, basename-only test rule."""
    path = col(path)
    name, ext = P.basename(path), P.extension(path)
    language = P.language_from_extension(ext)
    kind = (
        F.when(name.endswith(".d.ts"), "type-definition")
        .when(name.rlike(r"\.test\.|\.spec\.|_test\.|_spec\."), "test")
        .when(name.rlike(r"^test.*\.|^spec.*\."), "test")
        .when(name.rlike(r"config|conf|settings|\.rc$"), "config")
        .otherwise(language)
    )
    text = F.coalesce(col(content), F.lit("")) if content is not None else F.lit("")
    has = lambda *marks: contains_any(text, marks)
    framework = (
        F.when(text == "", F.lit(None).cast("string"))
        .when(ext.isin(".jsx", ".tsx") | has("import React", 'from "react"', "from 'react'"), "react")
        .when((ext == ".vue") | (text.contains("<template>") & text.contains("<script>")), "vue")
        .when(has("@Component", "@NgModule", 'from "@angular/core"', "from '@angular/core'"), "angular")
        .when(
            has("express()", 'require("express")', "require('express')", 'from "express"', "from 'express'"), "express"
        )
        .when(has('from "next"', "from 'next'", "next/app", "next/document"), "nextjs")
        .when((language == "python") & has("from django", "import django"), "django")
        .when((language == "python") & has("from flask import", "import flask"), "flask")
        .when((language == "ruby") & has("Rails", "ActiveRecord"), "rails")
        .when((language == "java") & has("@Controller", "@Service", "@Repository", "@SpringBootApplication"), "spring")
    )
    return F.struct(
        ext.alias("extension"), language.alias("language"), kind.alias("type"), framework.alias("framework"),
        (kind == "config").alias("is_config"), (kind == "test").alias("is_test"),
        (kind == "type-definition").alias("is_type_definition"),
    )


def is_generic_doc(path: Column | str, title: Column | str | None = None) -> Column:
    by_path = F.coalesce(col(path).rlike(K.GENERIC_DOC_PATTERN), F.lit(False))
    if title is None:
        return by_path
    has_path = F.coalesce(F.length(col(path)) > 0, F.lit(False))
    by_title = F.coalesce(contains_any(F.lower(col(title)), K.GENERIC_DOC_TITLES), F.lit(False))
    return by_path | (has_path & by_title)


def is_bot(author: Column | str) -> Column:
    author = col(author)
    known = F.lower(F.trim(author)).isin(*K.BOT_NAMES)
    return F.coalesce(known | author.rlike("(?i)" + "|".join(K.BOT_PATTERNS)), F.lit(False))


def keep_pull_request(
    merged_at: Column, author: Column, draft: Column, since: Column | None = None, until: Column | None = None,
    skip_dependency_bots: bool = True, include_drafts: bool = False,
) -> Column:
    keep = merged_at.isNotNull()
    if skip_dependency_bots:
        keep &= ~F.coalesce(F.lower(author).isin(*K.DEPENDENCY_BOTS), F.lit(False))
    if not include_drafts:
        keep &= ~F.coalesce(draft, F.lit(False))
    merged = F.try_to_timestamp(merged_at.cast("string"))
    if since is not None:
        keep &= F.coalesce(merged >= since, F.lit(True))
    if until is not None:
        keep &= F.coalesce(merged <= until, F.lit(True))
    return keep


def pr_changed(updated_at: Column, merged_at: Column, last: Column) -> Column:
    changed = (updated_at > last) | (F.coalesce(merged_at, updated_at) > last)
    return F.when(last.isNull(), True).otherwise(F.coalesce(changed, F.lit(False)))


def keeps_severity(severity: Column | str) -> Column:
    return F.lower(F.coalesce(col(severity), F.lit(""))) != "low"


def drop_low_severity(issues: Column | str) -> Column:
    """The nested form: an array of issue structs without the low ones."""
    return F.filter(col(issues), lambda i: keeps_severity(i["severity"]))


def is_other_file(path: Column, query_path: Column, project: Column) -> Column:
    """False for the reviewed file itself, by its absolute or project-relative path."""
    prefix = F.concat(F.regexp_replace(project, "/+$", ""), F.lit("/"))
    absolute = lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(prefix, p))
    return absolute(path) != absolute(query_path)


def inside_project(path: Column, project: Column) -> Column:
    """Relative paths resolve inside unless they climb out; absolute ones must lie below the project."""
    root = F.regexp_replace(project, "/+$", "")
    below = path.startswith(F.concat(root, F.lit("/"))) | (path == root)
    climbs = path.rlike(r"(^|/)\.\.(/|$)")
    return F.when(path.startswith("/"), below & ~climbs).otherwise(~climbs & (path != ""))


def matches_file_type(path: Column | str, name: Column | str, kind: str) -> Column:
    path = col(path)
    if kind == "docs":
        return is_documentation(path)
    if kind == "tests":
        return is_test_file(path)
    rule = K.FILE_TYPE_RULES.get(kind)
    if rule is None:
        return F.lit(False)
    lower_name, lower_path = F.lower(col(name)), F.lower(path)
    hit = lower_name.rlike("|".join(rule["name_patterns"]))
    if rule["path_marks"]:
        hit |= contains_any(lower_path, rule["path_marks"])
    if rule["keywords"]:
        hit |= contains_any(lower_name, rule["keywords"]) | contains_any(lower_path, rule["keywords"])
    if rule.get("not_test_or_doc"):
        hit &= ~is_test_file(path) & ~is_documentation(path)
    return hit


def comment_keywords(comment: Column | str, stopwords=K.ENGLISH_STOPWORDS) -> Column:
    """The distinct words of a comment that a code text is looked through for."""
    parts = F.split(F.lower(F.coalesce(col(comment), F.lit(""))), "[^a-zA-Z0-9_]+", -1)
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(F.array_distinct(parts), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def keyword_prefilter(comment: Column, code: Column, stopwords=K.ENGLISH_STOPWORDS) -> Column:
    """A comment passes when one of its keywords occurs in the code, or when it has no keywords."""
    return has_keyword(comment_keywords(comment, stopwords), F.lower(F.coalesce(code, F.lit(""))))


def has_keyword(keywords: Column | str, lowered: Column | str) -> Column:
    """The same of keywords and a code text that are worked out already."""
    keywords, lowered = col(keywords), col(lowered)
    return (F.size(keywords) == 0) | F.exists(keywords, lambda w: F.contains(lowered, w))


def file_roles(path: Column, comment: Column) -> Column:
    """The kinds of file a comment fits, as values of is_test."""
    path, comment = F.coalesce(path, F.lit("")), F.coalesce(comment, F.lit(""))
    for_tests = contains_any(path, (".test.", ".spec.")) | contains_any(F.lower(comment), ("test", "spec"))
    for_code = ~(path.contains(".test.") & contains_any(comment, ("describe(", "it(")))
    return F.array_compact(F.array(F.when(for_tests, True), F.when(for_code, False)))


def fits_test_role(is_test: Column, path: Column, comment: Column) -> Column:
    return F.array_contains(file_roles(path, comment), F.coalesce(is_test, F.lit(False)))


def is_component(content: Column | str) -> Column:
    return contains_any(F.coalesce(col(content), F.lit("")), ("export default", "export const", "export function"))


def is_dismissed(sentiment: Column, replies: Column, include_resolved: bool = True) -> Column:
    """``replies`` is an array of reply bodies."""
    phrases = K.DISMISSAL_PHRASES + ((K.DISMISSAL_RESOLVED,) if include_resolved else ())
    pattern = "|".join(quote_regex(p) for p in phrases)
    replied = F.exists(F.coalesce(replies, F.array().cast("array<string>")),
                       lambda r: F.coalesce(F.lower(r).rlike(pattern), F.lit(False)))
    return F.coalesce(sentiment == "negative", F.lit(False)) | replied


def passes_threshold(value: Column | str, threshold: float, rule: str) -> Column:
    """The three rules for a match: ``search`` takes a similarity from the threshold on, ``feedback`` one above it, and
    ``distance`` a distance up to it. A null never passes."""
    value = F.col(value) if isinstance(value, str) else value
    kept = {"search": value >= threshold, "feedback": value > threshold, "distance": value <= threshold}[rule]
    return F.coalesce(kept, F.lit(False))
