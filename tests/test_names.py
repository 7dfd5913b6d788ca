"""File names and paths, generated from the rules."""

import pytest
from pyspark.sql import functions as F

from papertrail.functions import names as N

STEMS = ("quarterly", "q4 plan", "Zürich")
#: What a name must not hold, by the rule: parent and home marks, doubled and turned slashes, control characters but tab.
FORBIDDEN = ["..", "~", "//", "\\", *(chr(c) for c in range(0x20) if c != 0x09)]
ALLOWED = ["-", "_", " ", "/", "\t", "\x7f", "\u202e", "．．", "‥", "ñ", "\U0001f4c4"]


def placed(piece):
    """A piece before, inside, between and after stems."""
    return [f"{piece}{STEMS[0]}.pdf", f"{STEMS[1]}{piece}.png", f"{STEMS[0]}{piece}{STEMS[2]}", f"{STEMS[2]}.jpg{piece}"]


OK_NAMES = [n for piece in ALLOWED for n in placed(piece)] + ["x" * 4096]
TRAVERSAL = [n for piece in FORBIDDEN for n in placed(piece)] + ["x" * 4097]
BAD_VALUES = ["", None, "   ", "\t\n", "   "]


def test_name_classes(spark):
    rows = [(n, "ok") for n in OK_NAMES] + [(n, "traversal") for n in TRAVERSAL] + [(n, "value_error") for n in BAD_VALUES]
    df = spark.createDataFrame(rows, "name string, expected string")
    got = df.withColumn("got", N.name_class(F.col("name"))).collect()
    assert [(r.name, r.got) for r in got] == [(r.name, r.expected) for r in got]


def test_slash_becomes_underscore(spark):
    row = spark.createDataFrame([("in/file.pdf",)], "n string").select(N.check_name(F.col("n")).alias("c")).first().c
    assert (row.ok, row.error_class, row.sanitized) == (True, None, "in_file.pdf")


@pytest.mark.parametrize("parts,verdict,path", [
    (["a", "b c", "d.pdf"], "ok", "a/b c/d.pdf"),
    *[(["a", f"b{piece}c"], "dangerous_pattern", None) for piece in FORBIDDEN if piece not in ("\n", "\r", "\x00") and piece[0] > " "],
    *[([f"b{piece}"], "dangerous_pattern", None) for piece in ("\x00", "\r", "\n")],
    *[([first, "a"], "dangerous_component", None) for first in (".", "/a", "a/", "./a", "a/./b")],
    *[(["a"] * n, "ok", "/".join("a" * n)) for n in (1, 10)],
    *[(["a"] * n, "too_deep", None) for n in (11, 60)],
    (["/".join("ab" * 20)], "too_deep", None),
    ([" a / b "], "ok", "a/b"),
    (["", None, "x"], "ok", "x"),
    ([], "ok", ""),
])
def test_path_parts(spark, parts, verdict, path):
    row = spark.createDataFrame([(parts,)], "p array<string>").select(N.path_parts(F.col("p")).alias("r")).first().r
    assert (row.verdict, row.path) == (verdict, path)


def test_storage_names_and_paths(spark):
    cases = [("minutes.pdf", "k-17-x", "k-17-x.pdf"), ("bill_88.pdf", "row-9-z", "row-9-z.pdf"),
             ("a.tar.gz", "d", "d.gz"), (".hidden", "d", "d"), ("file.pdf.", "d", "d"), ("../x.pdf", "d", None)]
    df = spark.createDataFrame(cases, "n string, d string, e string")
    for r in df.select("n", "e", N.storage_name(F.col("n"), F.col("d")).alias("g")).collect():
        assert r.g == r.e, r.n
    paths = [("/etc/passwd", "passwd"), ("file.pdf", "file.pdf"), ("/", ""), ("/a/b/", "b")]
    df = spark.createDataFrame(paths, "p string, e string")
    for r in df.select("p", "e", N.base_name_if_absolute(F.col("p")).alias("g")).collect():
        assert r.g == r.e, r.p
    row = spark.createDataFrame([("folder\\sub\\file.pdf",)], "p string").select(N.forward_slashes(F.col("p")).alias("g")).first()
    assert row.g == "folder/sub/file.pdf"
