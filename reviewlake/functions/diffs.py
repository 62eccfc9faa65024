"""Unified-diff rules as Column expressions.

Line numbers need no running state: within a hunk, a line that stays is numbered by its rank among those that stay, and the
j-th removed line at place i has i - j such lines before it. Everything else follows from arrays of lines and hunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions import constants as K
from reviewlake.functions.text import add_line_numbers, col
from reviewlake.functions.text import let as _let

HEADER = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"
HUNK_ANYWHERE = r"@@ -(\d+),?(\d+)? \+(\d+),?(\d+)? @@"
NO_WINDOW = "_No focused file context windows fit within the chunk token budget; use the diff above for the exact change._"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _joined(*pieces: Column) -> Column:
    """The pieces that are not empty, a line break between them."""
    return F.array_join(F.filter(F.array(*pieces), lambda x: x != ""), "\n")


def _tokens(length: Column) -> Column:
    return F.ceil(length / F.lit(K.CHARS_PER_TOKEN)).cast("long")


def hunk_range(hunk: Column | str) -> Column:
    """Struct(start, end, n_lines) of the first hunk header's new side; nulls when there is none."""
    hunk = col(hunk)
    start = F.regexp_extract(hunk, HUNK_ANYWHERE, 3)
    count = F.regexp_extract(hunk, HUNK_ANYWHERE, 4)
    start_n = F.when(F.length(start) > 0, start.cast("int"))
    n = F.when(start_n.isNull(), 0).when((count == "") | (count.try_cast("int") == 0), 1).otherwise(count.try_cast("int"))
    return F.struct(start_n.alias("start"), (start_n + n - 1).alias("end"), n.alias("n_lines"))


def hunk_code(hunk: Column | str) -> Column:
    """Struct(original, suggested, context) from the removed, added and other lines of a hunk."""
    lines = F.split(col(hunk), "\n", -1)
    body = lambda x: F.substring(x, 2, 1 << 30)

    def joined(mark):
        kept = F.transform(F.filter(lines, lambda x: x.startswith(mark)), body)
        return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))

    other = F.filter(
        lines,
        lambda x: ~x.startswith("-") & ~x.startswith("+") & ~x.startswith("@@")
        & (F.regexp_replace(x, f"[{K.WS}]", "") != ""),
    )
    context = F.array_join(F.transform(other, lambda x: F.when(F.length(x) > 1, body(x)).otherwise(x)), "\n")
    return F.struct(joined("-").alias("original"), joined("+").alias("suggested"), context.alias("context"))


def _numbered(body: Column, start: Column) -> Column:
    """Array of struct(i, mark, line_number, content) for the lines of one hunk; a removed line stands at the place of the
    next line that stays."""
    placed = F.transform(body, lambda x, i: F.struct(x.alias("line"), i.alias("i")))

    def rows(part: Column, number: Callable[[Column, Column], Column]) -> Column:
        return F.transform(part, lambda p, rank: F.struct(
            p["i"].alias("i"), F.substring(p["line"], 1, 1).alias("mark"), number(p["i"], rank).cast("int").alias("line_number"),
            F.substring(p["line"], 2, 1 << 30).alias("content")))

    stays = rows(F.filter(placed, lambda p: ~p["line"].startswith("-")), lambda i, rank: start + rank)
    gone = rows(F.filter(placed, lambda p: p["line"].startswith("-")), lambda i, rank: start + i - rank)
    return F.array_sort(F.concat(stays, gone))


def _hunks(diff: Column) -> Column:
    """The texts of the hunks, each from its header to the next header or file."""
    parts = F.split(F.coalesce(diff, F.lit("")), rf"(?dm)^(?={HEADER})", -1)
    return F.transform(F.filter(parts, lambda h: h.rlike(f"^{HEADER}")), lambda h: F.split(h, "(?dm)^diff --git ", 2)[0])


def _hunk_start(hunk: Column) -> Column:
    return F.regexp_extract(hunk, HEADER, 1).cast("int")


def diff_lines(diff: Column | str) -> Column:
    """Array of struct(i, mark, line_number, content): the added, removed and unchanged lines of all hunks, in order."""
    return F.flatten(F.transform(_hunks(col(diff)), lambda h: _numbered(
        F.filter(_lines(h), lambda x: x.rlike("^[-+ ]")), _hunk_start(h))))


def parse_diff(diff: Column | str, removal_anchors: bool = False, hunk_fallback: bool = False) -> Column:
    """Struct(added, removed, context, changed); ``changed`` are line numbers of added (and removed) lines, or of the hunks."""
    marks = ("+", "-") if removal_anchors else ("+",)

    def parsed(rows: Column) -> Column:
        changed = F.transform(F.filter(rows, lambda r: r["mark"].isin(*marks)), lambda r: F.greatest(F.lit(1), r["line_number"]))
        if hunk_fallback:
            starts = F.transform(_hunks(col(diff)), lambda h: F.greatest(F.lit(1), _hunk_start(h)))
            changed = F.when(F.size(changed) > 0, changed).otherwise(starts)

        def numbered(mark: str, least: int) -> Column:
            return F.transform(F.filter(rows, lambda r: r["mark"] == mark), lambda r: F.struct(
                F.greatest(F.lit(least), r["line_number"]).alias("line_number"), r["content"].alias("content")))

        removed = F.transform(F.filter(rows, lambda r: r["mark"] == "-"), lambda r: r["content"])
        return F.struct(numbered("+", 1).alias("added"), removed.alias("removed"), numbered(" ", -1 << 31).alias("context"), changed.alias("changed"))

    return _let(diff_lines(diff), parsed)


def changed_numbers(diff: Column | str) -> Column:
    """The ``changed`` lines of ``parse_diff(diff, True, True)``, in no order: line numbers alone, without the lines' texts."""
    def numbers(hunk: Column) -> Column:
        marks = F.filter(F.transform(_lines(hunk), lambda x: F.substring(x, 1, 1)), lambda m: m.isin("-", "+", " "))

        def of(start: Column, placed: Column) -> Column:
            stays = F.transform(F.filter(placed, lambda p: p["mark"] != "-"), lambda p, rank: F.when(p["mark"] == "+", start + rank))
            gone = F.transform(F.filter(placed, lambda p: p["mark"] == "-"), lambda p, rank: start + p["i"] - rank)
            return F.concat(F.filter(stays, lambda n: n.isNotNull()), gone)

        placed = F.transform(marks, lambda m, i: F.struct(m.alias("mark"), i.alias("i")))
        return _let(_hunk_start(hunk), lambda start: _let(placed, lambda placed: of(start, placed)))

    def changed(hunks: Column) -> Column:
        found = _let(F.flatten(F.transform(hunks, numbers)), lambda n: F.when(F.size(n) > 0, n).otherwise(F.transform(hunks, _hunk_start)))
        return F.transform(found, lambda n: F.greatest(F.lit(1), n))

    return _let(_hunks(col(diff)), changed)


def patch_code_at_line(patch: Column | str, line: Column | str) -> Column:
    """Struct(original, suggested): the first patch line standing at ``line`` of the new file.

    A removed line does not move the place on, so it can stand in front of the line that replaces it.
    """
    def first(part: Column) -> Column:
        start = F.when(part.rlike(f"^(?=@@)[^\\n]*?{HUNK_ANYWHERE}"), F.regexp_extract(part, HUNK_ANYWHERE, 3).cast("int")).otherwise(0)
        body = F.filter(_lines(F.regexp_replace(part, r"\n\z", "")), lambda x: ~x.startswith("@@"))
        return F.get(F.filter(_numbered(body, start), lambda r: r["line_number"] == col(line)), F.lit(0))

    parts = F.split(col(patch), rf"(?dm)^(?=@@)(?=[^\n]*?{HUNK_ANYWHERE})", -1)
    found = F.get(F.filter(F.transform(parts, first), lambda r: r.isNotNull()), F.lit(0))
    return F.struct(F.when(found["mark"] == "-", found["content"]).alias("original"), F.when(found["mark"] == "+", found["content"]).alias("suggested"))


def changed_lines(declared: Column, parsed: Column, n_lines: Column) -> Column:
    """Sorted distinct line numbers from both sources, clamped into the file."""
    valid = F.filter(F.coalesce(declared, F.array().cast("array<int>")), lambda n: n > 0)
    both = F.concat(valid, F.coalesce(parsed, F.array().cast("array<int>")))
    clamped = F.transform(both, lambda n: F.least(F.greatest(n, F.lit(1)), n_lines.cast("int")))
    return F.when(n_lines > 0, F.array_sort(F.array_distinct(clamped))).otherwise(F.array().cast("array<int>"))


# --- splitting an oversized diff -------------------------------------------------------------------


def _lead(header: Column, options: list[Column], room: Column) -> Column:
    """What a cut piece begins with: the header, then the longest option that leaves room for text. The header gives way first."""
    after = F.get(F.filter(F.array(*options, F.lit("")), lambda t: (t == "") | (F.length(t) < room - 1)), F.lit(0))

    def lines(after: Column) -> Column:
        taken = F.length(after) + F.when(after == "", 2).otherwise(3)
        text = _joined(F.substring(header, F.lit(1), F.greatest(F.lit(0), F.floor(room - taken)).cast("int")), after)
        return F.when((text != "") & (room > 1), F.concat(text, F.lit("\n"))).otherwise("")

    return _let(after, lines)


def _cut(header: Column, unit: Column, room: Column, continued: Column) -> Column:
    """An oversized unit in pieces of ``room`` characters. Later pieces repeat the hunk's line, with the number of the line they begin in.

    Each piece begins with a text whose length its place alone decides but for the digits of that number, so places are folded
    first, as numbers, and the texts are taken from them. The fold counts the lines that end before a piece as it goes.
    """
    hunk = F.coalesce(F.get(F.filter(_lines(unit), lambda x: x.startswith("@@")), F.lit(0)), F.lit(""))
    head = lambda hunk: F.struct(
        hunk.alias("line"), hunk.rlike(r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@").alias("numbered"), F.length(F.regexp_extract(hunk, r"\+(\d+)", 1)).alias("digits"),
        F.coalesce(F.regexp_extract(hunk, f"^{HEADER}", 1).try_cast("int"), F.lit(1)).alias("from_line"), F.instr(hunk, "+").alias("at_plus"),
        # The longest lead leaves the shortest step, which bounds the number of pieces.
        F.length(_lead(header, [_joined(F.lit(K.SPLIT_MARKER), F.concat(hunk, F.lit("0" * 10))), F.concat(hunk, F.lit("0" * 10))], room)).alias("longest"))

    def pieces(h: Column) -> Column:
        def lead(at: Column, passed: Column) -> Column:
            line = F.when(h["numbered"], F.overlay(h["line"], F.greatest(F.lit(1), h["from_line"] + passed).cast("string"), h["at_plus"] + 1, h["digits"]))
            line = F.when(at > 0, line.otherwise(h["line"])).otherwise("")
            mark = F.when(continued | (at > 0), K.SPLIT_MARKER).otherwise("")
            return _lead(header, [_joined(mark, line), line], room)

        def place(state: Column, _: Column) -> Column:
            # Lines of the new file that end before a piece: of the text since the last line that was counted.
            at, since, passed = state["at"], state["since"], state["passed"]
            size = F.greatest(F.lit(1), F.floor(room - F.length(lead(at, passed)))).cast("int")

            def after(size: Column) -> Column:
                ended = F.substring(unit, at + 1, size).contains("\n")
                seen = F.substring(unit, since + 1, at + size - since)
                return F.struct(
                    (at + size).alias("at"),
                    F.when(ended, since + F.length(seen) - F.length(F.substring_index(seen, "\n", -1))).otherwise(since).alias("since"),
                    (passed + F.when(ended, F.regexp_count(seen, F.lit(r"(?m)^[+ ].*\n"))).otherwise(0)).alias("passed"),
                    F.concat(state["places"], F.array(F.struct(at.alias("at"), passed.alias("passed"), size.alias("size")))).alias("places"))

            return F.when(at < F.length(unit), _let(size, after)).otherwise(state)

        steps = F.ceil(F.length(unit) / F.greatest(F.lit(1), F.floor(room - h["longest"]))).cast("int") + 1
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("since"), F.lit(0).alias("passed"),
                         F.array().cast("array<struct<at:int,passed:int,size:int>>").alias("places"))
        folded = F.aggregate(F.sequence(F.lit(1), steps), start, place)
        return F.transform(folded["places"], lambda p: F.concat(lead(p["at"], p["passed"]), F.substring(unit, p["at"] + 1, p["size"])))

    return _let(_let(hunk, head), pieces)


def split_diff(diff: Column | str, token_budget: Column) -> Column:
    """Array of texts within the budget: hunks stay whole and share a part while it has room; a larger hunk is cut.

    Which part a hunk goes to depends on the lengths alone: they are folded to part numbers, and the texts follow.
    """
    diff, budget = F.coalesce(col(diff), F.lit("")), col(token_budget)
    room = budget * F.lit(K.CHARS_PER_TOKEN)

    def split(pieces: Column) -> Column:
        header = F.when(F.size(pieces) > 1, F.substring(pieces[0], 2, 1 << 30)).otherwise("")
        units = F.when(F.size(pieces) > 1, F.slice(pieces, F.lit(2), F.greatest(F.lit(1), F.size(pieces) - 1))).otherwise(F.array(diff))
        return _let(header, lambda header: _let(units, lambda units: parts(header, units)))

    def parts(header: Column, units: Column) -> Column:
        head = F.when(header != "", F.length(header) + 1).otherwise(0)
        # Part 0 has no mark of continuation.
        space = lambda k: room - head - F.when(k > 0, len(K.SPLIT_MARKER) + 1).otherwise(0)
        start = F.struct(F.lit(-1).alias("k"), F.lit(-1).alias("used"), F.array().cast("array<struct<k:int,cut:boolean>>").alias("places"))

        def place(state: Column, unit: Column) -> Column:
            size, k, used = F.length(unit), state["k"], state["used"]
            joins = (used >= 0) & (used + 1 + size <= space(k))
            cut = ~joins & (size > space(k + 1))
            number = F.when(joins, k).otherwise(k + 1)
            return F.struct(number.alias("k"), F.when(joins, used + 1 + size).when(cut, -1).otherwise(size).alias("used"),
                            F.concat(state["places"], F.array(F.struct(number.alias("k"), cut.alias("cut")))).alias("places"))

        def text(rows: Column, k: Column) -> Column:
            def of(own: Column) -> Column:
                body = F.array_join(F.transform(own, lambda r: r["unit"]), "\n")
                return F.when(own[0]["cut"], _let(own[0]["unit"], lambda unit: _cut(header, unit, room, k > 0))).otherwise(
                    F.array(_joined(header, F.when(k > 0, K.SPLIT_MARKER).otherwise(""), body)))

            return _let(F.filter(rows, lambda r: r["k"] == k), of)

        def texts(places: Column) -> Column:
            rows = F.zip_with(units, places, lambda u, p: F.struct(p["k"].alias("k"), p["cut"].alias("cut"), u.alias("unit")))
            return _let(rows, lambda rows: F.flatten(F.transform(F.sequence(F.lit(0), F.element_at(places, -1)["k"]), lambda k: text(rows, k))))

        return _let(F.aggregate(units, start, place)["places"], texts)

    return F.when(_tokens(F.length(diff)) <= budget, F.array(diff)).otherwise(_let(F.split(F.concat(F.lit("\n"), diff), r"\n(?=@@)", -1), split))


# --- focused context of a changed file --------------------------------------------------------------


def line_windows(lines: Column, total: Column, radius: Column) -> Column:
    """Array of struct(a, b): ``radius`` lines around each of the sorted distinct ``lines``, touching ones merged."""
    def merged(near: Column) -> Column:
        opens = F.filter(F.transform(near, lambda w, i: F.when((i == 0) | (w["a"] > F.get(near, i - 1)["b"] + 1), i)), lambda i: i.isNotNull())
        return _let(opens, lambda o: F.transform(o, lambda i, j: F.struct(
            F.get(near, i)["a"].alias("a"), F.get(near, F.coalesce(F.get(o, j + 1), F.size(near)) - 1)["b"].alias("b"))))

    return _let(F.transform(lines, lambda n: F.struct(
        F.greatest(F.lit(1), n - radius).cast("int").alias("a"), F.least(total, n + radius).cast("int").alias("b"))), merged)


def focused_context(
    content: Column | str, language: Column | str, declared: Column, diff: Column | str, reason: Column, radius: Column, budget: Column,
) -> Column:
    """Rendered windows around the changed lines; a null budget means no limit.

    The widest radius whose windows fit the budget is taken; if not even the bare lines fit, the first of them that do.
    """
    language, text = F.coalesce(col(language), F.lit("")), F.coalesce(col(content), F.lit(""))
    given = F.filter(F.coalesce(declared, F.array().cast("array<int>")), lambda n: n > 0)
    found = F.concat(given, changed_numbers(diff))

    def view(lines: Column, found: Column) -> Column:
        total = F.size(lines)
        anchors = F.array_sort(F.array_distinct(F.transform(
            F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(1))), lambda n: F.least(F.greatest(n, F.lit(1)), total))))

        def body(a: Column, b: Column) -> Column:
            return F.slice(lines, a, b - a + 1)

        def preamble(windows: Column) -> Column:
            shown = F.aggregate(windows, F.lit(0), lambda n, w: n + w["b"] - w["a"] + 1)
            return F.format_string(
                "### Focused File Context\nFull file content omitted to control prompt size. Included %d of %d lines around changed hunks; "
                "omitted %d unchanged lines.\nReason: %s.\n\n", shown, total, F.greatest(F.lit(0), total - shown), reason)

        def shell(i: Column, a: Column, b: Column, inner: Column) -> Column:
            return F.concat(F.lit("#### Context Window "), i.cast("string"), F.lit(": lines "), a.cast("string"), F.lit("-"), b.cast("string"),
                            F.lit("\n```"), language, F.lit("\n"), inner, F.lit("\n```"))

        def shown_window(w: Column, i: Column) -> Column:
            width = F.length(w["b"].cast("string"))
            rows = F.transform(body(w["a"], w["b"]), lambda x, j: F.concat(F.lpad((w["a"] + j).cast("string"), width, " "), F.lit(" | "), x))
            return shell(i + 1, w["a"], w["b"], F.array_join(rows, "\n"))

        def price(w: Column) -> Column:
            """Tokens of a window: its frame, and its lines with their numbers."""
            count = w["b"] - w["a"] + 1
            inner = F.length(F.array_join(body(w["a"], w["b"]), "\n")) + count * (F.length(w["b"].cast("string")) + 3)
            return _tokens(F.length(shell(F.lit(1), w["a"], w["b"], F.lit("")))) + _tokens(inner)

        def cost(windows: Column) -> Column:
            prices = F.aggregate(windows, F.lit(0).cast("long"), lambda n, w: n + price(w))
            return _tokens(F.length(preamble(windows))) + F.when(F.size(windows) > 0, prices).otherwise(_tokens(F.lit(len(NO_WINDOW))))

        none = F.array().cast("array<struct<a:int,b:int>>")

        def bare(anchors: Column) -> Column:
            """The first lines, each a window of its own, that fit together. A window costs ten tokens at the least."""
            singles = F.transform(F.slice(anchors, F.lit(1), F.greatest(F.lit(1), F.ceil(budget / 10).cast("int"))), lambda n: F.struct(
                n.cast("int").alias("a"), n.cast("int").alias("b")))

            def fitting(prices: Column, base: Column) -> Column:
                sums = F.transform(prices, lambda _, i: base + F.aggregate(F.slice(prices, F.lit(1), i + 1), F.lit(0).cast("long"), lambda n, x: n + x))
                fit = F.size(F.filter(sums, lambda n: n <= budget))
                return F.when(fit > 0, F.slice(singles, F.lit(1), F.greatest(F.lit(1), fit))).otherwise(none)

            return _let(F.transform(singles, price), lambda prices: _let(cost(none), lambda base: fitting(prices, base)))

        def first(over: Column, kind: str, make: Callable[[Column], Column]) -> Column:
            """The first of ``make`` that is not null; those behind it are not worked out."""
            return F.aggregate(over, F.lit(None).cast(kind), lambda made, x: F.when(made.isNotNull(), made).otherwise(make(x)))

        def chosen(anchors: Column) -> Column:
            # From this radius on the windows are the whole file.
            gaps = F.transform(anchors, lambda n, i: F.coalesce(F.floor((F.get(anchors, i + 1) - n) / 2).cast("int"), F.lit(0)))
            whole = F.greatest(anchors[0] - 1, total - F.element_at(anchors, -1), F.array_max(gaps))
            fitting = first(F.sequence(F.least(radius.cast("int"), whole), F.lit(0)), "array<struct<a:int,b:int>>", lambda r: _let(
                line_windows(anchors, total, r), lambda w: F.when(cost(w) <= budget, w)))
            return F.when(budget.isNull(), line_windows(anchors, total, radius)).when(budget <= 0, none).otherwise(F.coalesce(fitting, bare(anchors)))

        def rendered(windows: Column) -> Column:
            inner = F.array_join(F.transform(windows, shown_window), "\n\n")
            return F.concat(preamble(windows), F.when(F.size(windows) > 0, inner).otherwise(NO_WINDOW))

        def trimmed(windows: Column) -> Column:
            """Without the last windows while the text as a whole is over the budget."""
            head = lambda k: F.when(k > 0, F.slice(windows, F.lit(1), F.greatest(k, F.lit(1)))).otherwise(none)
            fits = first(F.sequence(F.size(windows), F.lit(0)), "string", lambda k: _let(
                rendered(head(k)), lambda t: F.when((_tokens(F.length(t)) <= budget) | (k == 0), t)))
            return F.when(budget.isNull(), rendered(windows)).otherwise(fits)

        return _let(_let(anchors, chosen), trimmed)

    return _let(_lines(text), lambda lines: _let(found, lambda found: view(lines, found)))


def full_context(content: Column | str, language: Column | str) -> Column:
    return F.concat(
        F.lit("### Full File Content (For Context - line numbers shown for reference):\n```"),
        F.coalesce(col(language), F.lit("")), F.lit("\n"), add_line_numbers(content), F.lit("\n```"),
    )
