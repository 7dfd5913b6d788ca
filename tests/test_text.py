"""Text helpers against plain Python."""

import random
import re
import warnings

from hypothesis import HealthCheck, Phase, given, settings, strategies as st
from pyspark.sql import functions as F

from papertrail import fixed_values as V
from papertrail.functions import text as T

RUNS = settings(max_examples=3, deadline=None, derandomize=True, phases=[Phase.generate], suppress_health_check=list(HealthCheck))
SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85   "
TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab1 .$,:#-/@()\"|\n\t" + SPACES), st.characters(codec="utf-8", exclude_characters="\x00")), max_size=60)


def python_float(value):
    try:
        return float(value)
    except ValueError:
        return None


@RUNS
@given(st.lists(TEXT, min_size=50, max_size=200))
def test_strip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", T.strip(F.col("v")).alias("s")).collect():
        assert r.s == r.v.strip()


@RUNS
@given(st.lists(st.floats(allow_nan=False), min_size=50, max_size=200))
def test_float_text(spark, values):
    values = values + [0.0, 1100.0, 2.6e7, 1e16, 1e15, 123456789.25, 1e-5, 0.0001, 0.00012, float("inf"), 1e22, -3.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", T.float_text(F.col("v")).alias("s")).collect():
        assert float(r.s) == r.v
        if 1e-4 <= abs(r.v) < 1e16 and abs(r.v) == round(r.v, 2):
            assert r.s == str(r.v)


def test_parse_float(spark):
    values = ["1", " 24 ", "1e5", "1_000", "1d", "1f", "0x10", "", "nan", "-inf", "1.", ".5", "1,000", "abc", "12abc", "+3.5\n", "1__0"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", T.parse_float(F.col("v")).alias("n")).collect():
        want = python_float(r.v)
        assert (r.n == want) or (want is None and r.n is None) or (want != want and r.n != r.n), r.v


@RUNS
@given(st.lists(st.lists(st.sampled_from(
    ["Invoice", "INV", "#", ":", " ", "\n", " ", "A-1", "10/12/2024", "2024-1-5", "$", "1,234.50", "99", "a.b@c.io", "é@x.com", "555-123-4567",
     "PO", "possible", "tax id", "12-3", "%", "5.5%", "Ｉnv", "ſ", "٣", "\x1c",
     "①", "²", "Ⅷ", "\u0301", "_", "\u0903", "中", "  ", "\t"]), max_size=12), min_size=60, max_size=120))
def test_patterns_equal_python(spark, docs):
    texts = ["".join(d) for d in docs]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cols = [T.find_all(F.col("t"), p, int(n in V.GROUPED_PATTERNS), n in V.GROUPED_PATTERNS).alias(n) for n, p in V.PATTERNS.items()]
    for r in df.select("t", *cols).collect():
        for n, p in V.PATTERNS.items():
            want = [m.group(int(n in V.GROUPED_PATTERNS)) for m in re.finditer(p, r.t, re.I if n in V.GROUPED_PATTERNS else 0)]
            assert r[n] == want, (n, r.t)


def test_digits_of_other_scripts(spark):
    values = ["1٢", "٣.٥", "１２３", "x", None, "7"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [tuple(r) for r in df.select(T.ascii_digits(F.col("v")), T.parse_float(F.col("v"))).collect()]
    assert got == [("12", 12.0), ("3.5", 3.5), ("123", 123.0), ("x", None), (None, None), ("7", 7.0)]


def test_user_patterns():
    assert T.user_pattern("(") == T.BAD_PATTERN and T.user_pattern(None) is None
    assert T.user_pattern("(x)?(?(1)y|z)") == T.BAD_PATTERN   # Java has no conditionals


PATTERNS = [
    "(?P<a>x)(?P=a)", "(?P<a_b>x)(?P<ab>y)", "[[a]", "[]a]+", "[^]a]", "[a&&b]", "[a-c[d]", r"ab\Z", "ab$", "(?m)^b$", r"\Aab", "a{,2}b", "a{x}", "{a",
    "a{2", r"\v", r"[\b]", r"\N{LATIN SMALL LETTER A}", r"\x41\u0042", r"\101", r"\0", "(?x) a b # c", "(?x)[ #]b", "(?s)a.b", "a.b", r"\w+", r"\W",
    r"[^\W_]+", r"[\W\d]", r"\bab\b", r"a\Bb", "(?i)äB", "(?i:a)b", "a(?-i:B)", "(?a)\\w+", "(?a:\\d)\\d", r"\s+", r"[\s_]", "(?>a+)b", "a++b", "a*?b", "(a|b)\\1",
    "(?<=a)b", "(?<!a)b", "a(?=b)", "a(?!b)", "", "a|", "(?#c)a", "[+--]", r"[\]\[]", "é", "\U0001f600.", r"\.", "#", " a", "(?P<x1>a)(?P<x_1>b)(?P=x_1)", "x*", "(?:)",
    r"(a)(b)(c)(d)(e)(f)(g)(h)(i)(j)\10", "(x)?(?(1)y|z)", "(", "a**", "[z-a]", r"\q", "(?P<a>x", r"(?<=(a))\1", r"(a)(?<=\1)b"]
TEXTS = ["", "a", "ab", "ab\n", "b", "a\nb", "xx", "xy", "[", "]", "]a", "&", "a&", "aab", "a{x}", "{a", "a{2", "\x0b", "\x08", "A", "AB", "\0", "#b", " b", "a\rb", "äb",
         "ÄB", "aB", "_", "1", "١", "٣3", "\u00a0", "\x1c", "\u0085", "aa", "ba", "abb", "é", "e\u0301", "\U0001f600x", ".", "#", " a", "abcdefghijj", "-", ",", "a b", "中", "²", "yz"]


def test_user_patterns_mean_the_same(spark):
    """No pattern ends the job; those that Java can express give the answers of the dialect they are written in."""
    rows, want = [], {}
    rng = random.Random(3)
    pieces = [p for p in PATTERNS[:60] if p and T.user_pattern(p) != T.BAD_PATTERN and not p.startswith("(?") and "\\1" not in p]
    made = ["".join(rng.choice(["{}", "({})", "(?:{})?", "{}|", "[^x]{}"]).format(rng.choice(pieces)) for _ in range(rng.randrange(1, 4))) for _ in range(150)]
    for pattern in PATTERNS + made:
        java = T.user_pattern(pattern)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                python = re.compile(pattern)
            except re.error:
                python = None
        assert java != T.BAD_PATTERN or python is None or "(?(" in pattern or "(?<=" in pattern, pattern
        if java != T.BAD_PATTERN:
            for text in TEXTS:
                rows.append((pattern, java, text))
                want[pattern, text] = bool(python.match(text))
    df = spark.createDataFrame(rows, "pattern string, java string, text string")
    got = df.select("pattern", "text", F.regexp_like("text", F.concat(F.lit(r"(?Ud)\A(?:"), "java", F.lit(")"))).alias("hit")).collect()
    assert {(r.pattern, r.text): r.hit for r in got} == want and len(want) > 5000


def test_ascii_patterns_match_as_the_general_ones(spark):
    """On ASCII texts every pattern finds the same with plain classes and borders."""
    rng = random.Random(11)
    pieces = ["$ 1,234.50", " 12/03/2024", "2024-01-02", "a.b@c-d.org", "(555) 123-4567", "+1 555.123.4567", "12.5%", "Key: value", "\n", "\t", "\x1c",
              "\x1f", "\x0b", "_", "x", "7", " ", ":", "By: Jane Doe", "Invoice No: A-77", "PO# 9", "tax id 12-3456789", "\x00", "\x7f"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["", "é 12", "áb 12/03/2024", "x² 5%"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    patterns = [*V.PATTERNS.values(), V.FORM_PAIR_PATTERN, *V.NDA_SIGNATURE_PATTERNS]
    for fold in (False, True):
        found = df.select(*[T.find_all(F.col("t"), p, 0, fold).alias(f"a{i}") for i, p in enumerate(patterns)],
                          *[F.regexp_extract_all("t", F.lit(T.java_regex(p, fold)), F.lit(0)).alias(f"b{i}") for i, p in enumerate(patterns)])
        for row in found.collect():
            assert row[:len(patterns)] == row[len(patterns):]


def test_plain_forms_agree_on_ascii(spark):
    rnd = random.Random(5)
    words = ["Invoice", "PO", "tax", "total", "between", "and", "Name:", "By: __", "Title", "term", "years", "laws of", "purpose", "cash",
             "receipt", "3rd day of May, 2024", "12/3/2024", "$ 1,200.50", "9", "a@b.co", "(", '"Company"', "\x1c", "\x1f", "\t", "\x0b", "\n", ".", ","]
    texts = ["".join(rnd.choice(words) + rnd.choice(["", " ", " ", "\n"]) for _ in range(rnd.randrange(14))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    patterns = [*V.PATTERNS.values(), V.TAX_PATTERN, V.PARTY_PATTERN, V.FORM_PAIR_PATTERN, *V.NDA_TERM_PATTERNS, *V.NDA_SIGNATURE_PATTERNS,
                *V.NDA_JURISDICTION_PATTERNS, V.NDA_PURPOSE_PATTERN, V.NDA_PARTIES_PATTERN, V.CELL_SEPARATOR]

    def forms(plain):
        return F.struct(T.trimmed(t, plain).alias("strip"), *[f.alias(f"{k}{i}") for i, p in enumerate(patterns) for k, f in (
            ("s", T.search(t, p, 0, plain=plain)), ("d", T.search(t, p, 0, dotall=True, plain=plain)), ("f", T.found(t, p, plain=plain)))])

    amount = T.find_all(t, V.PATTERNS["amount"])
    rows = df.select(forms(True).alias("a"), forms(False).alias("b"), F.transform(amount, T.parse_ascii_amount).alias("x"),
                     F.transform(amount, T.parse_amount).alias("y")).collect()
    assert all(r.a == r.b and r.x == r.y for r in rows) and any(r.y for r in rows)
