"""Path expressions (F1-F3, P1) and the ancestors() array behind the containment joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Catalogue extension and companion image extensions.
ITEM_EXTS = (".emb",)
COMPANION_EXTS = (".jpg", ".jpeg", ".png")
# Directory names a scan never enters (besides any starting with a dot).
EXCLUDED_DIRS = ("node_modules", ".git", ".cache", "__pycache__")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def basename(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def dirname(path: Column | str) -> Column:
    path = _c(path)
    head = F.left(path, F.length(path) - F.length(basename(path)) - F.lit(1))
    return (
        F.when(~path.contains("/"), F.lit("."))
        .when(head == "", F.lit("/"))
        .otherwise(head)
    )


def raw_ext(path: Column | str) -> Column:
    """Suffix of the last path element from its final dot, case kept, '' if none."""
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def ext(path: Column | str) -> Column:
    return F.lower(raw_ext(path))


def stem(path: Column | str) -> Column:
    base = basename(path)
    return F.left(base, F.length(base) - F.length(raw_ext(path)))


def path_parts(path: Column | str) -> list[Column]:
    """dirname, basename, stem and lower-case extension as four columns."""
    return [
        dirname(path).alias("dir"),
        basename(path).alias("file_name"),
        stem(path).alias("stem"),
        ext(path).alias("ext"),
    ]


def is_supported(path: Column | str, exts: Sequence[str] = ITEM_EXTS) -> Column:
    """Extension test, any letter case."""
    return ext(path).isin([e.lower() for e in exts])


def ancestors(path: Column | str, include_self: bool = False) -> Column:
    """All directories above ``path``, shortest first: '/a/b/c' -> ['/a', '/a/b'].

    Turns "path lies under folder" into an equality, so containment joins are
    hash joins instead of nested loops over a prefix test.
    """
    path = _c(path)
    parts = F.split(path, "/")
    top = F.size(parts) if include_self else F.size(parts) - 1
    chain = F.transform(
        F.sequence(F.lit(1), F.greatest(top, F.lit(1))),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )
    if not include_self:
        # a bare name has no directory above it
        chain = F.when(F.size(parts) > 1, chain).otherwise(F.array().cast("array<string>"))
    return F.filter(chain, lambda a: a != "")


def hidden_or_tool_dir(path: Column | str, root: Column | str) -> Column:
    """True when a directory from ``root`` (itself included) down to the file is excluded."""
    path, root = _c(path), _c(root)
    above = F.length(root) - F.length(basename(root))
    below = F.substring(path, above + F.lit(1), F.length(path))
    dirs = F.split(below, "/")
    return F.exists(
        F.slice(dirs, F.lit(1), F.greatest(F.size(dirs) - 1, F.lit(0))),
        lambda d: d.startswith(".") | d.isin(*EXCLUDED_DIRS),
    )


def folder_label(path: Column | str) -> Column:
    """'grandparent › parent'; the parent alone if both are equal or one is empty."""
    parts = F.split(_c(path), "/")
    parent = F.try_element_at(parts, F.lit(-2))
    grand = F.try_element_at(parts, F.lit(-3))
    return (
        F.when((F.size(parts) < 3) | (parent == ""), F.lit(""))
        .when((grand != "") & (grand != parent), F.concat(grand, F.lit(" › "), parent))
        .otherwise(parent)
    )


def root_label(path: Column | str) -> Column:
    """display name of a root; mounted media show only their last element."""
    path = _c(path)
    # Labels and mount prefixes.
    mounted = path.startswith("/media/") | path.startswith("/mnt/") | path.startswith("/run/media/")
    return (
        F.when(path == "/", F.lit("Root (/)"))
        .when(path == "/home", F.lit("Home (/home)"))
        .when(mounted, basename(path))
        .otherwise(path)
    )


def short_root_label(path: Column | str) -> Column:
    """F3, display variant: last non-empty element, the input itself if there is none."""
    path = _c(path)
    names = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.coalesce(F.try_element_at(names, F.lit(-1)), path)
