"""Path and language rules as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions import constants as K
from reviewlake.functions.text import col, or_default, short_hash, slugify


def basename(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def directory_of(path: Column | str) -> Column:
    return F.when(col(path).contains("/"), F.regexp_replace(col(path), r"/[^/]*$", "")).otherwise(F.lit(""))


def path_depth(path: Column | str) -> Column:
    return F.size(F.split(F.coalesce(col(path), F.lit("")), "/", -1))


def extension(path: Column | str) -> Column:
    """Last extension with its dot; a leading dot alone (``.nvmrc``) is not an extension."""
    return F.regexp_extract(basename(path), r".(\.[^.]*)$", 1)


def language_from_extension(ext: Column | str) -> Column:
    ext = F.lower(col(ext))
    ext = F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
    mapping = F.create_map(*[F.lit(v) for v in chain.from_iterable(K.EXTENSION_LANGUAGE.items())])
    return F.coalesce(F.try_element_at(mapping, ext), F.lit("unknown"))


def directories(path: Column | str) -> Column:
    """Directory segments of a path, with ``.`` and empty segments dropped."""
    return F.filter(F.split(directory_of(path), "/", -1), lambda p: (p != "") & (p != "."))


def path_similarity(a: Column | str, b: Column | str) -> Column:
    """Common leading directories over the mean depth; both at the root gives 1, a missing path 0."""
    a, b = col(a), col(b)
    da, db = directories(a), directories(b)
    # Both sides prefix-match up to position i exactly when their first i segments are equal.
    equal = F.zip_with(da, db, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_gap = F.array_position(equal, False)
    common = F.when(first_gap == 0, F.size(equal)).otherwise(first_gap - 1)
    mean = (F.size(da) + F.size(db)) / F.lit(2.0)
    missing = a.isNull() | (a == "") | b.isNull() | (b == "")
    return F.when(missing, F.lit(0.0)).when(mean == 0, F.lit(1.0)).otherwise(common / mean)


def glob_to_regex(glob: str) -> str:
    """Anchored regex for a glob over relative paths with ``**``, ``*``, ``?`` and ``{a,b}``."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out.append("(?:" + "|".join(glob_to_regex(p)[1:-1] for p in glob[i + 1:end].split(",")) + ")")
            i = end + 1
        else:
            out.append("\\" + glob[i] if glob[i] in ".^$+()[]|{}\\" else glob[i])
            i += 1
    return "^" + "".join(out) + "$"


def matches_glob(path: Column | str, globs) -> Column:
    globs = list(globs)
    return col(path).rlike("|".join(glob_to_regex(g) for g in globs)) if globs else F.lit(False)


def chunk_id(path: Column | str, heading: Column | str, line: Column | str) -> Column:
    return F.concat(col(path), F.lit("#"), slugify(or_default(heading, "section")), F.lit("_"), col(line).cast("string"))


def file_id(path: Column | str, content_hash: Column | str) -> Column:
    return F.concat(col(path), F.lit("#"), col(content_hash))


def structure_id(project: Column | str) -> Column:
    return F.concat(F.lit("__project_structure__#"), short_hash(project))
