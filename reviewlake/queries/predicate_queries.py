"""Row predicates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewlake.functions import constants as K
from reviewlake.functions import predicates as B
from reviewlake.queries.function_queries import sql_ext, sql_language
from reviewlake.queries.inputs import (
    COMMENTS, FILES, FINDINGS, PULL_REQUESTS, REPLIES, SENTIMENTS, comments, files, findings, pick, pull_requests, quoted, sql_any,
    sql_pick, with_ctes,
)
from reviewlake.queries.registry import query


def sql_in(value: str, names) -> str:
    return f"{value} IN ({', '.join(quoted(n) for n in names)})"


SQL_IS_TEST = ("(" + " OR ".join(f"contains({{p}}, {quoted(x)})" for x in (
    "/__tests__/", "/test/", "/tests/", "/spec/", "/specs/", "_test.", "_spec.", ".test.", ".spec.")) + ")")


def sql_is_test(path: str) -> str:
    return SQL_IS_TEST.format(p=f"lower({path})")


def sql_is_doc(path: str) -> str:
    low, name = f"lower({path})", f"regexp_extract(lower({path}), '([^/]*)$', 1)"
    ext = sql_ext(low)
    return (f"CASE WHEN {sql_in(ext, K.CODE_EXTENSIONS)} THEN FALSE WHEN {sql_in(ext, K.DOCUMENT_EXTENSIONS)} THEN TRUE "
            f"ELSE {sql_in(f'left({name}, length({name}) - length({ext}))', K.DOC_FILENAMES)} OR {sql_any(low, K.DOC_DIRECTORIES)} "
            f"OR {sql_any(name, K.DOC_TERMS)} END")


@query("b1_project_filter", with_ctes(FILES) + """
SELECT file_id FROM files WHERE project_path IN ('/work/src1', '/work/src2')
  AND (CASE file_id // 20 % 4 WHEN 0 THEN starts_with(project_path || '/' || path, '/work/src1/')
       WHEN 1 THEN FALSE WHEN 2 THEN project_path = '/work/src1' ELSE TRUE END)""")
def b1(t):
    n = F.floor(F.col("file_id") / 20) % 4
    path = (
        F.when(n == 0, F.concat_ws("/", F.lit("/work/src1"), "path"))
        .when(n == 1, F.concat(F.lit("../"), "path")).when(n == 2, F.concat_ws("/", F.lit("/work/src1"), "path")).otherwise(F.col("path"))
    )
    kept = files(t.documents).where(F.col("project_path").isin("/work/src1", "/work/src2"))
    return kept.where(B.inside_project(path, F.col("project_path"))).select("file_id")


@query("b2_is_test_file", with_ctes(FILES) + f"SELECT file_id, {sql_is_test('path')} AS is_test FROM files")
def b2(t):
    return files(t.documents).select("file_id", B.is_test_file("path").alias("is_test"))


@query("b3_test_path_like", with_ctes(FILES) + """
SELECT file_id, path LIKE '%.test.%' OR path LIKE '%.spec.%' OR path LIKE '%_test.py' OR path LIKE 'test_%.py' AS is_test FROM files""")
def b3(t):
    return files(t.documents).select("file_id", B.is_test_path_like("path").alias("is_test"))


_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_FRAMEWORK = f"""CASE WHEN ext IN ('.jsx', '.tsx') OR {sql_any('content', ('import React', 'from "react"', "from 'react'"))} THEN 'react'
  WHEN ext = '.vue' OR (contains(content, '<template>') AND contains(content, '<script>')) THEN 'vue'
  WHEN {sql_any('content', ('@Component', '@NgModule', 'from "@angular/core"', "from '@angular/core'"))} THEN 'angular'
  WHEN {sql_any('content', ('express()', 'require("express")', "require('express')", 'from "express"', "from 'express'"))} THEN 'express'
  WHEN {sql_any('content', ('from "next"', "from 'next'", 'next/app', 'next/document'))} THEN 'nextjs'
  WHEN language = 'python' AND {sql_any('content', ('from django', 'import django'))} THEN 'django'
  WHEN language = 'python' AND {sql_any('content', ('from flask import', 'import flask'))} THEN 'flask'
  WHEN language = 'ruby' AND {sql_any('content', ('Rails', 'ActiveRecord'))} THEN 'rails'
  WHEN language = 'java' AND {sql_any('content', ('@Controller', '@Service', '@Repository', '@SpringBootApplication'))} THEN 'spring' END"""


@query("b4_detect_file_type", with_ctes(FILES, f"""f AS (SELECT *, {sql_ext('path')} AS ext, {_NAME} AS name,
  {sql_language(sql_ext('path'))} AS language FROM files)""") + f"""
SELECT file_id, ext AS extension, language, CASE WHEN suffix(name, '.d.ts') THEN 'type-definition'
  WHEN {sql_any('name', ('.test.', '.spec.', '_test.', '_spec.'))} THEN 'test'
  WHEN (starts_with(name, 'test') OR starts_with(name, 'spec')) AND contains(substr(name, 5), '.') THEN 'test'
  WHEN contains(name, 'conf') OR contains(name, 'settings') OR suffix(name, '.rc') THEN 'config' ELSE language END AS type,
  {_FRAMEWORK} AS framework FROM f""")
def b4(t):
    return files(t.documents).select("file_id", B.detect_file_type("path", "content").alias("k")).select(
        "file_id", "k.extension", "k.language", "k.type", "k.framework"
    )


@query("b5_is_documentation", with_ctes(FILES) + f"SELECT file_id, {sql_is_doc('path')} AS is_doc FROM files")
def b5(t):
    return files(t.documents).select("file_id", B.is_documentation("path").alias("is_doc"))


@query("b6_should_process", with_ctes(FILES, f"f AS (SELECT *, {_NAME} AS name, lower({sql_ext('path')}) AS ext FROM files)") + f"""
SELECT file_id, CASE WHEN n_chars * 100 > 1048576 THEN 'too_large' WHEN {sql_in('ext', K.BINARY_EXTENSIONS)} THEN 'binary'
  WHEN {sql_any('path', [f'/{d}/' for d in K.SKIP_DIRECTORIES])} THEN 'skip_directory'
  WHEN {sql_in('name', K.SKIP_FILENAMES)} THEN 'skip_filename'
  WHEN regexp_matches(path, '\\.(min|bundle)\\.(js|css)$|\\.generated\\.|\\.d\\.ts$|\\.snap$|\\.config\\.(js|ts|mjs|cjs)$')
    OR regexp_matches(name, '^\\..*rc(\\.json)?$') THEN 'generated'
  WHEN starts_with(path, 'scripts/') OR regexp_matches(path, '^src/api/(.*/)?[^/]*\\.java$') THEN 'excluded'
  WHEN file_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'ignored' END AS reason FROM f""")
def b6(t):
    ignored = t.labels.where("toxic = 1").select(F.col("doc_id").alias("file_id"), F.lit(True).alias("hit"))
    f = files(t.documents).join(ignored, "file_id", "left")
    reason = B.excluded_reason(
        "path", F.col("n_chars") * 100, exclude_globs=("scripts/**", "src/api/**/*.java"), ignored=F.coalesce("hit", F.lit(False))
    )
    return f.select("file_id", reason.alias("reason"))


@query("b7_is_generic_doc", with_ctes(FILES) + f"""
SELECT file_id, regexp_matches(path, '(?i)(README|RUNBOOK|CONTRIBUTING|CHANGELOG|LICENSE|SETUP|INSTALL)(\\.md|$)')
  OR {sql_any('lower(content)', K.GENERIC_DOC_TITLES)} AS generic FROM files""")
def b7(t):
    return files(t.documents).select("file_id", B.is_generic_doc("path", "content").alias("generic"))


@query("b8_filter_pull_requests", with_ctes(PULL_REQUESTS) + """
SELECT number FROM pull_requests WHERE merged_at IS NOT NULL AND lower(author) NOT IN ('dependabot[bot]', 'dependabot-preview[bot]')
  AND NOT draft AND merged_at >= '1996-01-01' AND merged_at <= '1999-06-30T00:00:00Z'""")
def b8(t):
    return pull_requests(t.orders).where(B.keep_pull_request(
        F.col("merged_at"), F.col("author"), F.col("draft"), F.lit("1996-01-01").cast("timestamp"),
        F.lit("1999-06-30").cast("timestamp"),
    )).select("number")


@query("b9_filter_bots", with_ctes(COMMENTS) + f"""
SELECT id FROM comments WHERE NOT coalesce({sql_in("lower(trim(author))", K.BOT_NAMES)}
  OR {' OR '.join(f"regexp_matches(author, {quoted('(?i)' + p)})" for p in K.BOT_PATTERNS)}, FALSE)""")
def b9(t):
    return comments(t.conversations).where(~B.is_bot("author")).select("id")


@query("b10_drop_low_severity", with_ctes(FINDINGS) + """
SELECT file_path, severity, count(*) AS n FROM findings WHERE lower(severity) <> 'low' GROUP BY ALL""")
def b10(t):
    return findings(t.lineitem).where(B.keeps_severity("severity")).groupBy("file_path", "severity").agg(F.count("*").alias("n"))


@query("b11_exclude_self", with_ctes(FILES) + """
SELECT a.file_id AS query_id, b.file_id FROM files a JOIN files b ON a.content_hash = b.content_hash
WHERE a.project_path || '/' || a.path <> a.project_path || '/' || b.path""")
def b11(t):
    f = files(t.documents)
    q = f.select(F.col("file_id").alias("query_id"), F.concat_ws("/", "project_path", "path").alias("q_path"),
                 F.col("project_path").alias("q_project"), "content_hash")
    return q.join(f, "content_hash").where(B.is_other_file(F.col("path"), F.col("q_path"), F.col("q_project"))).select("query_id", "file_id")


def sql_file_type(kind: str) -> str:
    rule = K.FILE_TYPE_RULES[kind]
    hits = [f"regexp_matches(lname, {quoted('|'.join(rule['name_patterns']))})"]
    if rule["path_marks"]:
        hits.append(sql_any("lpath", rule["path_marks"]))
    if rule["keywords"]:
        hits += [sql_any("lname", rule["keywords"]), sql_any("lpath", rule["keywords"])]
    out = "(" + " OR ".join(hits) + ")"
    if rule.get("not_test_or_doc"):
        out += f" AND NOT {sql_is_test('path')} AND NOT ({sql_is_doc('path')})"
    return f"({out})"


@query("b12_matches_file_type", with_ctes(FILES, f"f AS (SELECT *, lower({_NAME}) AS lname, lower(path) AS lpath FROM files)") + "\nSELECT file_id, "
       + ", ".join(f"{sql_file_type(k)} AS {k}" for k in K.FILE_TYPE_RULES)
       + f", {sql_is_doc('path')} AS docs, {sql_is_test('path')} AS tests FROM f")
def b12(t):
    from reviewlake.functions.paths import basename

    kinds = [*K.FILE_TYPE_RULES, "docs", "tests"]
    return files(t.documents).select("file_id", *[B.matches_file_type("path", basename("path"), k).alias(k) for k in kinds])


@query("b13_keyword_prefilter", with_ctes(COMMENTS, f"""w AS (SELECT id, lower(coalesce(role, '')) || ' use database.query() here' AS code,
  list_filter(regexp_split_to_array(lower(comment_text), '[^a-zA-Z0-9_]+'), lambda x: length(x) > 2 AND NOT x IN ({', '.join(quoted(w) for w in K.ENGLISH_STOPWORDS)})) AS kw FROM comments)""") + """
SELECT id FROM w WHERE len(kw) = 0 OR len(list_filter(kw, lambda x: contains(code, x))) > 0""")
def b13(t):
    code = F.concat("role", F.lit(" use database.query() here"))
    return comments(t.conversations).where(B.keyword_prefilter(F.col("comment_text"), code)).select("id")


@query("b14_test_aware_comment_filter", with_ctes(COMMENTS) + """
SELECT id FROM comments WHERE CASE WHEN turn % 2 = 0
  THEN contains(coalesce(file_path, ''), '.test.') OR contains(coalesce(file_path, ''), '.spec.') OR contains(lower(comment_text), 'test') OR contains(lower(comment_text), 'spec')
  ELSE NOT (contains(coalesce(file_path, ''), '.test.') AND (contains(comment_text, 'describe(') OR contains(comment_text, 'it('))) END""")
def b14(t):
    return comments(t.conversations).where(
        B.fits_test_role(F.col("turn") % 2 == 0, F.col("file_path"), F.col("comment_text"))
    ).select("id")


@query("b15_similarity_threshold", """
SELECT l_returnflag, count(*) FILTER (WHERE l_tax >= 0.04) AS searched, count(*) FILTER (WHERE l_tax > 0.04) AS matched,
  count(*) FILTER (WHERE l_discount <= 0.04) AS near FROM lineitem GROUP BY ALL""")
def b15(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_if(B.passes_threshold("l_tax", 0.04, "search")).alias("searched"), F.count_if(B.passes_threshold("l_tax", 0.04, "feedback")).alias("matched"),
        F.count_if(B.passes_threshold("l_discount", 0.04, "distance")).alias("near"),
    )


@query("b16_is_component", with_ctes(FILES) + f"""
SELECT file_id, {sql_any('content', ('export default', 'export const', 'export function'))} AS component FROM files""")
def b16(t):
    return files(t.documents).select("file_id", B.is_component("content").alias("component"))


@query("b17_dismissed_feedback", f"""
WITH f AS (SELECT item_id, {sql_pick(SENTIMENTS, 'item_id')} AS s, lower({sql_pick(REPLIES, 'item_id')} || '|' || {sql_pick(REPLIES, 'item_id // 7 + 1')}) AS r FROM benchmark)
SELECT item_id, s = 'negative' OR {sql_any('r', ('false positive', 'not relevant', 'ignore', 'resolved'))} AS skipped,
  s = 'negative' OR {sql_any('r', ('false positive', 'not relevant', 'ignore'))} AS pattern FROM f""")
def b17(t):
    replies = F.array(pick(REPLIES, F.col("item_id")), pick(REPLIES, F.floor(F.col("item_id") / 7) + 1))
    sentiment = pick(SENTIMENTS, F.col("item_id"))
    return t.benchmark.select(
        "item_id", B.is_dismissed(sentiment, replies).alias("skipped"),
        B.is_dismissed(sentiment, replies, include_resolved=False).alias("pattern"),
    )


@query("b18_changed_prs", with_ctes(PULL_REQUESTS) + """
SELECT number FROM pull_requests WHERE updated_at > '1998-01-01T00:00:00Z' OR coalesce(merged_at, updated_at) > '1998-01-01T00:00:00Z'""")
def b18(t):
    ts = lambda c: F.to_timestamp(c)
    return pull_requests(t.orders).where(
        B.pr_changed(ts("updated_at"), ts("merged_at"), F.lit("1998-01-01").cast("timestamp"))
    ).select("number")

