import math
import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import classify as C
from reviewlake.functions import constants as K
from reviewlake.functions import context as X
from reviewlake.functions import diffs as D
from reviewlake.functions import markdown as M
from reviewlake.functions import paths as P
from reviewlake.functions import predicates as B
from reviewlake.functions import text as T
from reviewlake.functions import vectors as V
from reviewlake.operators.similarity import word_jaccard


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize("a,b,want", [
    ((1, 2, 3), (1, 2, 3), 1.0), ((1, 2, 3), (2, 4, 6), 1.0), ((1, 0), (-1, 0), -1.0), ((1, 0), (0, 1), 0.0),
    ((1, 2), (1, 2, 3), 0.0), ((0, 0), (1, 1), 0.0),
])
def test_cosine(value, a, b, want):
    assert value(V.cosine_similarity(arr(*a), arr(*b))) == pytest.approx(want)


def test_cosine_missing(value):
    none = F.lit(None).cast("array<double>")
    assert value(V.cosine_similarity(none, arr(1, 2))) == 0
    assert value(V.cosine_similarity(F.array().cast("array<double>"), F.array().cast("array<double>"))) == 0


def test_score_conversions(value):
    assert value(V.document_similarity(F.lit(0.3))) == pytest.approx(0.7)
    assert value(V.document_similarity(F.lit(1.5))) == 0
    assert value(V.code_similarity(F.lit(0.5))) == pytest.approx(math.exp(-1))
    assert value(V.code_similarity(F.lit(None).cast("double"))) == 0.5
    assert value(V.score_similarity(F.lit(7.0))) == 1


@pytest.mark.parametrize("a,b,want", [
    ("src/a/x.js", "src/a/y.js", 1.0), ("src/a/x.js", "src/b/y.js", 0.5), ("x.js", "y.js", 1.0), ("a/x", "b/y", 0.0), ("", "a/b", 0.0),
    ("a/b/c/x", "a/y", 0.5),
])
def test_path_similarity(value, a, b, want):
    assert value(P.path_similarity(F.lit(a), F.lit(b))) == pytest.approx(want)


@pytest.mark.parametrize("a,b,want", [
    ("Unused Variable, found!", "unused variable found", 1.0), ("a cat", "an cat", 1.0), (None, "x", 0.0), ("of to", "of to", 0.0),
    ("alpha beta", "beta gamma", 1 / 3),
])
def test_word_jaccard(value, a, b, want):
    assert value(word_jaccard(F.lit(a).cast("string"), F.lit(b))) == pytest.approx(want)


def test_tokens(value):
    assert value(T.estimate_tokens(F.lit("x" * 300))) == 86
    assert value(T.estimate_tokens(F.lit("x" * 600))) == 172
    assert value(T.estimate_tokens(F.lit(None).cast("string"))) == 0


@pytest.mark.parametrize("text,want", [
    ("Hello World!", "hello-world"), ("  Multiple   Spaces  ", "multiple-spaces"), ("a--b", "a-b"), ("", ""),
])
def test_slugify(value, text, want):
    assert value(T.slugify(F.lit(text))) == want


def test_line_numbers(value):
    assert value(T.add_line_numbers(F.lit("const a = 1;\nconst b = 2;"))) == "1 | const a = 1;\n2 | const b = 2;"
    assert value(T.add_line_numbers(F.lit(""))) == ""
    ten = value(T.add_line_numbers(F.lit("\n".join("x" * 10))))
    assert ten.startswith(" 1 | x") and ten.endswith("10 | x")


def test_or_default(value):
    assert value(T.or_default(F.lit(""), "unknown")) == "unknown"
    assert value(T.or_default(F.lit(None).cast("string"), "unknown")) == "unknown"
    assert value(T.or_default(F.lit(0), 5)) == 5
    assert value(T.or_default(F.lit("x"), "unknown")) == "x"


@pytest.mark.parametrize("title,content,want", [
    ("given", "text\n# The Title \nmore", "The Title"), ("rules:./coding_style.md", "no heading", "Coding Style"), ("plain", "## sub", "plain"),
])
def test_document_title(value, title, content, want):
    assert value(T.document_title(F.lit(title), F.lit(content))) == want


def test_truncate_lines(value):
    text = F.lit("\n".join(str(i) for i in range(7)))
    assert value(T.truncate_lines(text, 5)) == "0\n1\n2\n3\n4\n... (truncated, 2 more lines)"
    assert value(T.truncate_lines(text, 5, "embedding")).endswith("... (truncated from 7 lines)")
    assert value(T.truncate_lines(text, 7)) == "0\n1\n2\n3\n4\n5\n6"


def test_verification_text(value):
    tail = "a" * 500 + " please fix it"
    got = value(T.verification_text(F.lit(tail), F.lit("x" * 401)))
    assert got == "Comment: " + "a" * 300 + "... " + tail[-100:] + " Code: " + "x" * 400 + "..."
    # No telling word near the end: only the beginning is kept.
    assert value(T.verification_text(F.lit("fix " + "a" * 600), F.lit(""))) == "Comment: " + ("fix " + "a" * 600)[:400] + " Code: "
    assert value(T.verification_text(F.lit(" a \n b "), F.lit("c"))) == "Comment: a b Code: c"


def test_truncate_tokens(value):
    text = "word " * 100
    got = value(T.truncate_tokens(F.lit(text), 10))
    # The longest prefix within the budget has 30 characters; it is cut back to its last space.
    assert got == text[:29]
    assert value(T.truncate_tokens(F.lit("x" * 100), 10)) == "x" * 30
    assert value(T.truncate_tokens(F.lit("short"), 10)) == "short"


def test_clean_document(value):
    assert value(T.clean_document(F.lit("one\r\ntwo\n\n\n\nThree  four\n-\nItem"))) == "one two\n\nThree four\n- Item"


@pytest.mark.parametrize("path,want", [
    ("src/__tests__/a.js", True), ("src/test/a.js", True), ("a/specs/b.rb", True), ("a_test.go", True), ("A.Spec.ts", True), ("src/contest.js", False),
])
def test_is_test(value, path, want):
    assert value(B.is_test_file(F.lit(path))) is want


@pytest.mark.parametrize("path,want", [
    ("README.md", True), ("docs/api.ts", False), ("LICENSE", True), ("a/docs/x", True), ("user-guide", True), ("src/main.go", False), ("notes.rst", True),
])
def test_is_documentation(value, path, want):
    assert value(B.is_documentation(F.lit(path))) is want


@pytest.mark.parametrize("path,size,want", [
    ("src/a.js", 10, None), ("src/a.js", 2 << 20, "too_large"), ("img/a.PNG", 1, "binary"), ("x/node_modules/a.js", 1, "skip_directory"),
    ("package.json", 1, "skip_filename"), ("a/b.min.js", 1, "generated"), ("a/.foorc", 1, "generated"), ("a/types.d.ts", 1, "generated"),
])
def test_excluded(value, path, size, want):
    assert value(B.excluded_reason(F.lit(path), F.lit(size))) == want


@pytest.mark.parametrize("path,kind", [
    ("a/b.d.ts", "type-definition"), ("a/b.test.js", "test"), ("a/test_x.py", "test"), ("a/app.config.js", "config"), ("a/x.py", "python"), ("a/x.zig", "unknown"),
])
def test_file_type(value, path, kind):
    assert value(B.detect_file_type(F.lit(path))["type"]) == kind


@pytest.mark.parametrize("author,want", [
    ("dependabot[bot]", True), ("My-Bot", True), ("bot-x", True), ("alice", False), (None, False), ("RENOVATE-thing", True), ("robot", False),
])
def test_bots(value, author, want):
    assert value(B.is_bot(F.lit(author).cast("string"))) is want


@pytest.mark.parametrize("path,position,line,want", [("a", 1, None, "review"), ("a", None, 3, "inline"), (None, None, None, "issue"), ("", 1, 1, "issue")])
def test_comment_type(value, path, position, line, want):
    assert value(C.comment_type(F.lit(path).cast("string"), F.lit(position).cast("int"), F.lit(line).cast("int"))) == want


@pytest.mark.parametrize("hunk,want", [
    ("@@ -10,5 +15,7 @@ fn", (15, 21, 7)), ("invalid", (None, None, 0)), ("@@ -1 +3 @@", (3, 3, 1)), ("@@ -1,0 +3,0 @@", (3, 3, 1)),
])
def test_hunk_range(value, hunk, want):
    assert tuple(value(D.hunk_range(F.lit(hunk)))) == want


def test_hunk_code(value):
    got = value(D.hunk_code(F.lit("@@ -1 +1 @@\n-old\n+new\n same\n\nx")))
    assert (got["original"], got["suggested"], got["context"]) == ("old", "new", "same\nx")


def test_classification(value):
    cat = lambda t, c=None, p=None: value(C.issue_category(F.lit(t), F.lit(c).cast("string"), F.lit(p).cast("string")))
    assert cat("possible SQL injection, sanitize it") == "security"
    assert cat("slow algorithm") == "performance"
    assert cat("hello") == "general"
    assert cat("hello", "let password = 1") == "security"
    assert cat("hello", None, "src/auth/x.js") == "security"
    # One comment hit each: the earlier category keeps the tie.
    assert cat("cache naming") == "performance"
    sev = lambda t, c: value(C.severity(F.lit(t), F.lit(c)))
    assert sev("this is critical and major", "logic") == "critical"
    assert sev("breaks things", "logic") == "major"
    assert sev("typo", "style") == "style"
    assert sev("hm", "security") == "major"
    assert sev("hm", "logic") == "minor"
    assert value(C.pattern_tags(F.lit("Add unit test for async error"))) == ["error_handling", "async_await", "testing"]


def test_code_context(value):
    ctx = value(X.code_context(F.lit("import React from 'react'; function a() {}"), F.lit("typescript")))
    assert (ctx["area"], ctx["dominant_tech"], ctx["keywords"]) == ("Frontend", ["React"], ["function"])
    assert value(X.code_context(F.lit("x = 1"), F.lit("python")))["area"] == "GeneralPython"
    assert value(X.code_context(F.lit("x"), F.lit("go")))["area"] == "Unknown"


def test_file_complexity_and_change_size(value):
    diff = F.lit("new file mode 100644\n+++ b\n+a\n-b\n c")
    assert value(C.change_size(diff)) == 3
    assert value(C.file_complexity(F.lit("a/src/x.js"), F.lit(""))) == 10
    assert value(C.file_complexity(F.lit("a/src/b/index.js"), F.lit("x" * 500))) == pytest.approx(0.5 + 10 + 15)


def test_cap_content(value):
    text = "h" * 500 + "t" * 500
    got = value(C.cap_content(F.lit(text), F.lit(100)))
    assert len(got) == 350 and got.startswith("h") and got.endswith("t") and "original length 1000 characters" in got
    assert value(C.cap_content(F.lit("abc"), F.lit(100))) == "abc"
    assert value(C.cap_content(F.lit("abc"), F.lit(0))) == ""


@pytest.mark.parametrize("glob,path,want", [
    ("**/*.js", "a/b/c.js", True), ("**/*.js", "c.js", True), ("src/**", "src/a/b", True), ("*.js", "a/c.js", False), ("**/.*/**", "a/.git/x", True),
    ("a?.{ts,js}", "ab.js", True), ("**/*.min.*", "x/a.min.css", True),
])
def test_globs(value, glob, path, want):
    assert value(P.matches_glob(F.lit(path), [glob])) is want


# --- state machines --------------------------------------------------------------------------------

DIFF = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,3 +10,4 @@ f\n keep\n-gone\n+new\n+more\n tail\n\\ No newline"


def _reference_lines(diff):
    """(mark, place, text) line by line, as a reader would number them."""
    at, out = None, []
    for line in diff.split("\n"):
        head = re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@", line)
        if line.startswith("diff --git "):
            at = None
        elif head:
            at = int(head[1])
        elif at is not None and line[:1] in ("+", "-", " ") and line:
            out.append((line[0], at, line[1:]))
            at += line[0] != "-"
    return out


def _random_diff(rng):
    out = ["diff --git a/x b/x\n--- a/x\n+++ b/x"] if rng.random() < 0.6 else []
    for _ in range(rng.randrange(0, 5)):
        out.append(f"@@ -{rng.randrange(60)},3 +{rng.randrange(60)} @@" + rng.choice(["", " fn"]))
        out += [rng.choice(["+", "-", " ", "\\ No", "", "@@ x"]) + "x" * rng.randrange(30) for _ in range(rng.randrange(12))]
        out += ["diff --git a/y b/y\n+++ q"] if rng.random() < 0.1 else []
    return "\n".join(out)


def test_parse_diff(value):
    parse = lambda d, *a: value(D.parse_diff(F.lit(d).cast("string"), *a))
    p = parse(DIFF)
    assert [tuple(r) for r in p["added"]] == [(11, "new"), (12, "more")]
    assert p["removed"] == ["gone"] and [c["line_number"] for c in p["context"]] == [10, 13]
    assert p["changed"] == [11, 12] and parse(DIFF, True)["changed"] == [11, 11, 12]
    assert parse("@@ -1 +0,0 @@\n keep", False, True)["changed"] == [1]
    assert parse(None)["changed"] == []


def test_diff_lines_match_a_reader(spark):
    rng = random.Random(3)
    rows = [(i, _random_diff(rng)) for i in range(120)]
    got = spark.createDataFrame(rows, "i int, d string").select("i", D.diff_lines("d").alias("x")).collect()
    assert {r.i: [(x.mark, x.line_number, x.content) for x in r.x] for r in got} == {i: _reference_lines(d) for i, d in rows}


def test_patch_code(value):
    at = lambda patch, n: tuple(value(D.patch_code_at_line(F.lit(patch).cast("string"), F.lit(n))))
    patch = "@@ -1,2 +1,2 @@\n a\n-old\n+new\n b"
    assert at(patch, 2) == ("old", None)  # the removed line stands in front
    assert at(patch, 3) == (None, None)
    assert at("@@ -1 +5 @@\n+x\n@@ -9 +6 @@\n+y", 6) == (None, "y")
    assert at("@@ -1 +5 @@\n+x", 5) == (None, "x")
    assert at(None, 1) == (None, None)


def test_white_space_is_taken_from_the_ends_only(value):
    """A last line end that is no white space here (U+0085) ends no text."""
    assert len(K.WS_CHARS) == 25 and all(re.fullmatch(f"[{K.WS}]", x) for x in K.WS_CHARS)
    assert value(T.trim_ws(F.lit(f"{K.WS_CHARS}a b{K.WS_CHARS}"))) == "a b"
    assert value(T.trim_ws(F.lit("a \x85"))) == "a \x85" and value(T.trim_ws(F.lit(None).cast("string"))) is None
    assert value(T.slugify(F.lit(f" A{K.WS_CHARS}\u00e9 b--c! "))) == "a-b-c"


def _split(value, diff, budget):
    return value(D.split_diff(F.lit(diff), F.lit(budget)))


def test_split_diff_keeps_every_line(value):
    hunks = [f"@@ -1,3 +{i * 10},3 @@\n" + "\n".join(f"+line {i} {j}" for j in range(20)) for i in range(1, 8)]
    diff = "diff --git a b\n" + "\n".join(hunks)
    parts = _split(value, diff, 150)
    assert len(parts) > 1 and all(len(p) <= 150 * 3.5 for p in parts)
    # No part could have taken in the first hunk of the next one.
    for p, q in zip(parts, parts[1:]):
        assert len(p) + 1 + len("@@" + q.split("@@ -", 1)[0]) + len(hunks[0]) > 150 * 3.5
    added = [line for p in parts for line in p.split("\n") if line.startswith("+")]
    assert added == [line for line in diff.split("\n") if line.startswith("+")]
    assert all(p.startswith("diff --git a b\n") for p in parts) and all(K.SPLIT_MARKER in p for p in parts[1:])
    assert _split(value, "short", 5) == ["short"] and _split(value, "", 1) == [""]


def test_split_diff_cuts_a_huge_hunk(value):
    lines = [f"+{'x' * 30}{i}" for i in range(200)]
    diff = "head\n@@ -1,1 +7,200 @@\n" + "\n".join(lines)
    parts = _split(value, diff, 200)
    assert all(len(p) <= 700 for p in parts)
    whole, starts = "", []
    for i, p in enumerate(parts):
        head = "head\n" if i == 0 else re.match(r"head\n[^\n]*\n@@ -1,1 \+(\d+),200 @@\n", p)
        if i:
            # The hunk line names the line in which the piece begins: the header's own line comes before the first.
            done = whole.split("\n")[1:]
            assert int(head[1]) == 7 + max(0, len(done) - 1)
            starts.append(int(head[1]))
            head = head[0]
        whole += p[len(head):]
    assert whole == diff[len("head\n"):] and starts == sorted(starts) and starts[-1] > 100


def test_split_diff_reads_its_text_a_bounded_number_of_times(value):
    """The split of the diff is worked out once, whatever refers to it; lines are counted from piece to piece."""
    assert str(D.split_diff("diff", F.lit(9))).count("(?=@@)") == 1
    lines = [f"+{'x' * 30}{i}" for i in range(2_000)]
    parts = _split(value, "head\n@@ -1,1 +7,200 @@\n" + "\n".join(lines), 200)
    assert len(parts) > 100 and int(re.match(r"head\n[^\n]*\n@@ -1,1 \+(\d+)", parts[-1])[1]) > 1_980


@pytest.mark.parametrize("lines,total,radius,want", [
    ([5, 7, 50], 100, 2, [(3, 9), (48, 52)]), ([1], 3, 10, [(1, 3)]), ([3, 8], 100, 2, [(1, 10)]), ([3, 9], 100, 2, [(1, 5), (7, 11)]), ([], 10, 2, []),
])
def test_line_windows(value, lines, total, radius, want):
    found = value(D.line_windows(F.array(*map(F.lit, lines)).cast("array<int>"), F.lit(total), F.lit(radius)))
    assert [tuple(w) for w in found] == want


def test_focused_context_respects_budget(spark):
    content = "\n".join(f"line {i} of the file" for i in range(1, 301))
    diff = "@@ -100,1 +100,2 @@\n+a\n+b\n@@ -200,1 +250,1 @@\n+c"

    def shown(cases, content=content, diff=diff):
        rows = spark.createDataFrame(cases, "radius int, budget double")
        text = D.focused_context(F.lit(content), F.lit("python"), F.array().cast("array<int>"), F.lit(diff), F.lit("big"), F.col("radius"), F.col("budget"))
        return {(r.radius, r.budget): r.text for r in rows.select("radius", "budget", text.alias("text")).collect()}

    free = {r: t for (r, _), t in shown([(r, None) for r in range(41)]).items()}
    full = free[40]
    assert "lines 60-141" in full and "lines 210-290" in full and "Included 163 of 300 lines" in full
    assert " 60 | line 60 of the file" in full
    cost = lambda text: math.ceil(len(text) / 3.5)
    for (_, budget), text in shown([(40, float(b)) for b in (60, 120, 300, 900, 5000)]).items():
        # Only the preamble itself may be above a budget that holds no window.
        assert cost(text) <= budget or "No focused file context windows fit" in text
        # Rounding up piece by piece costs a few tokens more than the text as a whole.
        sure = [r for r in free if cost(free[r]) + 6 <= budget]
        if sure:
            assert text in free.values() and len(text) >= len(free[max(sure)])
    assert "lines 1-1" in shown([(40, None)], "x", "")[40, None]


def test_markdown_titles():
    assert M.markdown_chunks_text("a/my-doc.md", "# My Document Title\ntext")[0] == "My Document Title"
    assert M.markdown_chunks_text("a/my-doc.md", "text")[0] == "my-doc"
    assert M.markdown_chunks_text("a/my-doc.md", "\n\n\n\n\n\n# Late")[0] == "my-doc"
    # A second-level heading near the top counts as the title and keeps its second mark.
    assert M.markdown_chunks_text("a/x.md", "## Sub\nt")[0] == "# Sub"


def test_markdown_sections():
    text = "# T\nintro\n## A\none\n```\n## not a heading\n```\n### B\n\n## C"
    _, chunks = M.markdown_chunks_text("x.md", text)
    assert [(c["heading"], c["start_line"]) for c in chunks] == [(None, 1), ("A", 3), ("B", 8), ("C", 10)]
    assert chunks[1]["content"] == "## A\none\n```\n## not a heading\n```"
    assert "\n".join(c["content"] for c in chunks).replace("\n", "") == text.replace("\n", "")
    assert M.markdown_chunks_text("x.md", "")[1] == [] and M.markdown_chunks_text("x.md", " \n ")[1] == []


def test_paragraphs():
    text = "\n\n".join(["p" * 400] * 5 + ["q" * 1500, "r" * 50])
    chunks = M.paragraph_chunks_text(text)
    assert [len(c["content"]) for c in chunks] == [802, 802, 400, 1500, 50]
    assert "\n\n".join(c["content"] for c in chunks) == text
    assert {c["total_chunks"] for c in chunks} == {5} and chunks[0]["section_start"]


def test_focused_context_looks_at_no_radius_beyond_the_file(spark):
    """Windows that are the whole file are priced once, however large the radius."""
    content = "\n".join(f"line {i}" for i in range(1, 41))
    diff = "@@ -1,2 +3,3 @@\n a\n+b\n-c\n@@ -9,2 +30,2 @@\n+d\n"
    df = spark.createDataFrame([(radius, budget) for radius in (26, 40, 20_000_000) for budget in (2000.0, 120.0, 40.0)], "radius int, budget double")
    text = D.focused_context(F.lit(content), F.lit("python"), F.array().cast("array<int>"), F.lit(diff), F.lit("big"), F.col("radius"), F.col("budget"))
    got = {}
    for r in df.select("radius", "budget", text.alias("t")).collect():
        got.setdefault(r["budget"], set()).add(r["t"])
    assert {b: len(t) for b, t in got.items()} == {2000.0: 1, 120.0: 1, 40.0: 1}
    assert "lines 1-40" in got[2000.0].pop() and "lines 1-40" not in got[120.0].pop()


def test_changed_numbers(value):
    for diff in (None, "", "no hunk", "@@ -1,2 +0,2 @@ fn\n a\n-b\n-c\n+d\n e\n\\ No newline\n+f", "@@ -1 +7 @@\n same\ndiff --git a b\n@@ -4 +9 @@\n x",
                 "diff --git a b\n@@ -1,2 +5,2 @@\n+a\n-b\n@@ -1,2 +50,2 @@\n+a\n-b\n-c\n+d", "@@ -1 +3 @@\n-gone\n-gone"):
        whole = value(D.parse_diff(F.lit(diff).cast("string"), True, True))["changed"]
        assert sorted(value(D.changed_numbers(F.lit(diff).cast("string")))) == sorted(whole)
