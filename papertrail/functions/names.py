"""File-name and path expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from papertrail import fixed_values as V
from papertrail.functions.text import is_blank, strip

OK, VALUE_ERROR, TRAVERSAL = "ok", "value_error", "traversal"


def _any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def name_class(name: Column, max_length: int = V.MAX_PATH_LENGTH) -> Column:
    """``ok`` / ``value_error`` / ``traversal``; the order of the tests is part of the contract."""
    sanitized = F.replace(name, F.lit("/"), F.lit("_"))
    return F.when(name.isNull() | (name == ""), VALUE_ERROR) \
        .when(is_blank(name), VALUE_ERROR) \
        .when(F.length(name) > max_length, TRAVERSAL) \
        .when(_any_of([F.contains(name, F.lit(p)) for p in V.DANGEROUS_NAME_PARTS]), TRAVERSAL) \
        .when(F.contains(name, F.lit("\\")), TRAVERSAL) \
        .when(name.rlike(r"[\x00-\x08\x0a-\x1f]"), TRAVERSAL) \
        .when(is_blank(sanitized), VALUE_ERROR) \
        .otherwise(OK)


def check_name(name: Column) -> Column:
    """STRUCT<ok, error_class, sanitized> for a client-supplied file name."""
    verdict = name_class(name)
    return F.struct(
        (verdict == OK).alias("ok"),
        F.when(verdict != OK, verdict).alias("error_class"),
        F.when(verdict == OK, F.replace(name, F.lit("/"), F.lit("_"))).alias("sanitized"))


def suffix(name: Column) -> Column:
    """Last suffix with its dot; '' for none, for a leading-dot-only name and for a trailing dot."""
    return F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1)


def storage_name(name: Column, document_id: Column | None = None) -> Column:
    """``{document_id}{suffix}``, or the sanitized name without an id; NULL when unsafe."""
    sanitized = check_name(name)["sanitized"]
    if document_id is None:
        return sanitized
    return F.when(sanitized.isNotNull(),
                  F.concat(document_id.cast("string"), suffix(sanitized)))


def path_parts(parts: Column) -> Column:
    """STRUCT<verdict, depth, path> of an ARRAY<STRING> of components joined below a base folder.

    Purely lexical: an offending component rejects the whole path.
    """
    given = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    bad_text = F.exists(given, lambda p: (F.length(p) > V.MAX_PATH_LENGTH) | _any_of(
        [F.contains(p, F.lit(x)) for x in V.DANGEROUS_NAME_PARTS + ["\\"]]))
    pieces = F.flatten(F.transform(given, lambda p: F.split(p, "/")))
    bad_piece = F.exists(pieces, lambda p: p.isin(V.DANGEROUS_PATH_COMPONENTS))
    kept = F.filter(F.transform(pieces, strip), lambda p: p != "")
    verdict = F.when(bad_text, "dangerous_pattern").when(bad_piece, "dangerous_component") \
        .when(F.size(kept) > V.MAX_DIRECTORY_DEPTH, "too_deep").otherwise(OK)
    return F.struct(
        verdict.alias("verdict"), F.size(kept).alias("depth"),
        F.when(verdict == OK, F.array_join(kept, "/")).alias("path"))


def base_name_if_absolute(path: Column) -> Column:
    """An absolute path is reduced to its last non-empty component."""
    leaf = F.try_element_at(F.array_remove(F.split(path, "/"), ""), F.lit(-1))
    return F.when(F.startswith(path, F.lit("/")), F.coalesce(leaf, F.lit(""))).otherwise(path)


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))
