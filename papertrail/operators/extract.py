"""Text to typed fields and tables.

One document is one row from text to verdict: a stage adds array columns to the
row, so nothing here shuffles.  The long forms are a plain ``inline`` away.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from papertrail import fixed_values as V
from papertrail.functions import text as T
from papertrail.functions.fence import fence
from papertrail.functions.memo import memoized

FIELD_TYPE = "array<struct<name:string,value:string,value_num:double,confidence:double>>"
TABLE_TYPE = ("array<struct<headers:array<string>,rows:array<map<string,string>>,"
              "confidence:double>>")
DEFAULT_THRESHOLD = 0.7


def pattern_hits(df: DataFrame, patterns: list[str] | None = None, text: str = "text") -> DataFrame:
    """Long form (…, pattern, n_hits, first_hit) of the pattern library over one scan.

    Only the patterns asked for are evaluated.
    """
    names = patterns or list(V.PATTERNS)
    hits = {n: T.find_all(F.col(text), V.PATTERNS[n], int(n in V.GROUPED_PATTERNS),
                          n in V.GROUPED_PATTERNS) for n in names}
    keep = [c for c in df.columns if c != text]
    found = df.select(*keep, *[h.alias(f"_{n}") for n, h in hits.items()])
    return found.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(n).alias("pattern"), F.size(f"_{n}").alias("n_hits"),
                 F.get(f"_{n}", F.lit(0)).alias("first_hit")) for n in names])))


def _field(name: str, value: Column, confidence: float | Column) -> Column:
    """A text field; a NULL value means "not found"."""
    return F.struct(
        F.lit(name).alias("name"), value.alias("value"),
        F.lit(None).cast("double").alias("value_num"), F.lit(confidence).alias("confidence"))


def _number(name: str, value: Column, confidence: float) -> Column:
    return F.struct(
        F.lit(name).alias("name"), F.lit(None).cast("string").alias("value"),
        value.alias("value_num"), F.lit(confidence).alias("confidence"))


def _numbered(prefix: str, values: Column, confidence: float) -> Column:
    """prefix_1, prefix_2, … over an array of texts."""
    return F.transform(values, lambda v, i: F.struct(
        F.concat(F.lit(prefix), (i + 1).cast("string")).alias("name"), v.alias("value"),
        F.lit(None).cast("double").alias("value_num"), F.lit(confidence).alias("confidence")))


def _present(*fields: Column) -> Column:
    """The fields that were found, each value computed once."""
    return F.filter(F.array(*fields), lambda f: f["value"].isNotNull() | f["value_num"].isNotNull())


@dataclass(frozen=True)
class Limits:
    """How many of each kind the field extractors take; None takes all.  The defaults are part of the contract."""

    form_pairs: int | None = 20
    form_name_chars: int | None = 50
    dates: int | None = 3
    amounts: int | None = 5
    emails: int | None = 2
    phones: int | None = 2
    invoice_head_lines: int | None = 5
    receipt_head_lines: int | None = 3


def _first(items: Column, n: int | None) -> Column:
    return items if n is None else F.slice(items, 1, n)


def _first_line(text: Column, of_first: int | None, longer_than: int = 3, plain: bool = False) -> Column:
    lines = F.transform(_first(F.split(text, "\n", -1 if of_first is None else of_first + 1), of_first),
                        lambda x: T.trimmed(x, plain))
    return F.get(F.filter(lines, lambda x: F.length(x) > longer_than), F.lit(0))


def invoice_fields(text: Column, dates: Column, amounts: Column, limits: Limits = Limits(), plain: bool = False) -> Column:
    """``plain`` here and below: the text is known to be ASCII."""
    tax = T.search(text, V.TAX_PATTERN, 1, plain=plain)
    return _present(
        _field("invoice_number", T.search(text, V.PATTERNS["invoice_number"], 1, plain=plain), 0.9),
        _field("vendor_name", _first_line(text, limits.invoice_head_lines, plain=plain), 0.7),
        _field("invoice_date", F.get(dates, F.lit(0)), 0.8),
        _field("due_date", F.get(dates, F.lit(1)), 0.7),
        _number("total_amount", F.array_max(amounts), 0.8),
        _number("subtotal", F.get(F.sort_array(amounts, asc=False), F.lit(1)), 0.6),
        _number("tax_amount", (tax if plain else T.ascii_digits(tax)).try_cast("double"), 0.7),
        _field("po_number", T.search(text, V.PATTERNS["po_number"], 1, plain=plain), 0.8))


def receipt_fields(text: Column, dates: Column, limits: Limits = Limits(), plain: bool = False) -> Column:
    payment = F.coalesce(*[F.when(T.found(text, p, plain=plain), F.lit(m)) for p, m in V.PAYMENT_PATTERNS])
    total = T.search(text, V.RECEIPT_TOTAL_PATTERN, 1, plain=plain)
    return _present(
        _field("merchant_name", _first_line(text, limits.receipt_head_lines, plain=plain), 0.8),
        _field("transaction_date", F.get(dates, F.lit(0)), 0.9),
        _number("total_amount", (total if plain else T.ascii_digits(total)).try_cast("double"), 0.9),
        _field("payment_method", payment, 0.8),
        _field("receipt_number", T.search(text, V.RECEIPT_NUMBER_PATTERN, 1, plain=plain), 0.8))


def contract_fields(text: Column) -> Column:
    amount = T.ascii_digits(F.replace(T.search(text, V.CONTRACT_VALUE_PATTERN, 1), F.lit(","), F.lit("")))
    return _present(
        _field("party1", T.strip(T.search(text, V.PARTY_PATTERN, 1)), 0.8),
        _field("party2", T.strip(T.search(text, V.PARTY_PATTERN, 2)), 0.8),
        _field("effective_date", T.search(text, V.EFFECTIVE_DATE_PATTERN, 1), 0.8),
        _field("end_date", T.search(text, V.END_DATE_PATTERN, 1), 0.7),
        _number("contract_value", amount.try_cast("double"), 0.7))


def form_fields(text: Column, emails: Column, phones: Column, limits: Limits = Limits(), plain: bool = False) -> Column:
    """The first key/value pairs, then the first e-mail and phone."""
    # One search for whole pairs; a pair taken alone matches in the same way, so only those kept are taken apart.
    whole = _first(T.find_all(text, V.FORM_PAIR_PATTERN, plain=plain), limits.form_pairs)
    regex = (T.ascii_regex if plain else T.java_regex)(V.FORM_PAIR_PATTERN)
    part = lambda pair, group: T.trimmed(F.regexp_extract(pair, regex, group), plain)
    pairs = F.transform(whole, lambda pair: F.struct(
        F.replace(F.lower(part(pair, 1)), F.lit(" "), F.lit("_")).alias("name"),
        part(pair, 2).alias("value"), F.lit(None).cast("double").alias("value_num"),
        F.lit(0.6).alias("confidence")))
    kept = F.filter(pairs, lambda p: (p["name"] != "") & (p["value"] != "")
                    & (F.lit(True) if limits.form_name_chars is None else F.length(p["name"]) < limits.form_name_chars))
    return F.concat(kept, _present(_field("email", F.get(emails, F.lit(0)), 0.9),
                                   _field("phone", F.get(phones, F.lit(0)), 0.8)))


def generic_fields(dates: Column, amounts: Column, emails: Column, phones: Column, limits: Limits = Limits()) -> Column:
    numbered = F.transform(_first(amounts, limits.amounts), lambda v, i: F.struct(
        F.concat(F.lit("amount_"), (i + 1).cast("string")).alias("name"),
        F.lit(None).cast("string").alias("value"), v.alias("value_num"),
        F.lit(0.5).alias("confidence")))
    return F.concat(
        _numbered("date_", _first(dates, limits.dates), 0.6),
        F.filter(numbered, lambda f: f["value_num"].isNotNull()),
        _present(_field("email", F.get(emails, F.lit(0)), 0.9),
                 _field("phone", F.get(phones, F.lit(0)), 0.7)))


def nda_fields(text: Column, giver: Column, taker: Column, emails: Column, phones: Column,
               limits: Limits = Limits(), plain: bool = False) -> Column:
    """``giver``/``taker`` are the two groups of the strict party pattern, NULL without a match."""
    sure = F.when(giver.isNotNull(), 0.95).otherwise(0.85)
    jurisdiction = F.regexp_replace(T.first_of(text, V.NDA_JURISDICTION_PATTERNS, plain=plain),
                                    (T.ascii_regex if plain else T.java_regex)(V.NDA_JURISDICTION_TAIL), "")
    signers = F.array_distinct(F.filter(
        F.transform(F.concat(*[T.find_all(text, p, 1, True, plain=plain) for p in V.NDA_SIGNATURE_PATTERNS]),
                    lambda x: T.trimmed(x, plain)), lambda s: s != ""))
    return F.concat(
        _present(
            _field("disclosing_party", T.trimmed(F.coalesce(
                giver, T.first_of(text, V.NDA_DISCLOSING_PATTERNS, plain=plain)), plain), sure),
            _field("receiving_party", T.trimmed(F.coalesce(
                taker, T.first_of(text, V.NDA_RECEIVING_PATTERNS, plain=plain)), plain), sure),
            _field("effective_date", T.first_of(text, V.NDA_DATE_PATTERNS, plain=plain), 0.85),
            _field("term_duration", T.first_of(text, V.NDA_TERM_PATTERNS, plain=plain), 0.8),
            _field("jurisdiction", jurisdiction, 0.75),
            _field("purpose", T.trimmed(T.search(text, V.NDA_PURPOSE_PATTERN, 1, plain=plain), plain), 0.7)),
        _numbered("contact_email_", _first(emails, limits.emails), 0.95),
        _numbered("contact_phone_", _first(phones, limits.phones), 0.8),
        _numbered("signatory_", signers, 0.7))


def is_nda_text(text: Column) -> Column:
    return _nda_phrases(F.lower(text))


def _nda_phrases(lowered: Column) -> Column:
    test = F.contains(lowered, F.lit(V.NDA_TEXT_PHRASES[0]))
    for phrase in V.NDA_TEXT_PHRASES[1:]:
        test = test | F.contains(lowered, F.lit(phrase))
    return test


@memoized
def _final_type(text: str, doc_type: str) -> Column:
    return F.when(_nda_phrases(F.col(text)), F.lit("nda")).otherwise(F.col(doc_type))


def override_type(df: DataFrame, text: str = "text", doc_type: str = "document_type") -> DataFrame:
    """The content test for an NDA beats the classified type."""
    # A column of its own: the phrases are alternatives, and each would lower the text again.
    return df.withColumn("_lowered", F.lower(F.col(text))).withColumn(doc_type, _final_type("_lowered", doc_type)).drop("_lowered")


@memoized
def _shared_matches(text: str, doc_type: str) -> dict[str, Column]:
    """Matches that several fields read, taken once per row and only for the types that need them."""
    t, kind, plain = F.col(text), F.col(doc_type), F.col("_ascii")
    generic = ~kind.isin("invoice", "receipt", "contract", "form", "nda")
    contacts = kind.isin("form", "nda") | generic
    nothing = F.array().cast("array<string>")

    def find(name: str) -> Column:
        return T.find_all(t, V.PATTERNS[name], ascii_only=plain)

    def party(group: int) -> Column:
        return F.when(kind == "nda", F.when(plain, T.search(t, V.NDA_PARTIES_PATTERN, group, dotall=True, plain=True))
                      .otherwise(T.search(t, V.NDA_PARTIES_PATTERN, group, dotall=True)))

    return {
        "_dates": F.when(kind.isin("invoice", "receipt") | generic, find("date")),
        "_amounts": F.when((kind == "invoice") | generic, F.when(plain, F.transform(
            T.find_all(t, V.PATTERNS["amount"], plain=True), T.parse_ascii_amount)).otherwise(
            F.transform(find("amount"), T.parse_amount))),
        "_emails": F.when(contacts, F.when(F.contains(t, F.lit("@")), find("email")).otherwise(nothing)),
        "_phones": F.when(contacts, find("phone")),
        "_giver": party(1),
        "_taker": party(2),
    }


@memoized
def _fields(text: str, doc_type: str, limits: Limits) -> Column:
    t, kind = F.col(text), F.col(doc_type)
    dates, amounts, emails, phones, giver, taker = (
        F.col(c) for c in ("_dates", "_amounts", "_emails", "_phones", "_giver", "_taker"))

    def by_type(plain: bool) -> Column:
        return F.when(kind == "nda", nda_fields(t, giver, taker, emails, phones, limits, plain)) \
            .when(kind == "invoice", invoice_fields(t, dates, amounts, limits, plain)) \
            .when(kind == "receipt", receipt_fields(t, dates, limits, plain)) \
            .when(kind == "form", form_fields(t, emails, phones, limits, plain)) \
            .otherwise(generic_fields(dates, amounts, emails, phones, limits))

    # Contracts have one form for all texts, so that their searches stand in the plan once.
    return F.when(kind == "contract", contract_fields(t)).when(F.col("_ascii"), by_type(True)) \
        .otherwise(by_type(False)).cast(FIELD_TYPE)


def extract_fields(df: DataFrame, text: str = "text", doc_type: str = "document_type",
                   output: str = "all_fields", override: bool = True, limits: Limits = Limits()) -> DataFrame:
    """Adds ``output``: the document's fields in order of emission, by final type.

    All types are served in this one pass over the text; texts of ASCII only take plain searches.
    """
    df = override_type(df, text, doc_type) if override else df
    shared = _shared_matches(text, doc_type)
    df = df.withColumn("_ascii", T.is_ascii(F.col(text))).withColumns(shared)
    return df.withColumn(output, _fields(text, doc_type, limits)).drop("_ascii", *shared)


@memoized
def _table_steps(text: str, output: str) -> list[dict[str, Column]]:
    t = F.col(text)

    def marked(x: Column) -> Column:
        return F.contains(x, F.lit("\t")) | F.contains(x, F.lit("  ")) | F.contains(x, F.lit("|"))

    def cells(plain: bool) -> Column:
        separator = (T.ascii_regex if plain else T.java_regex)(V.CELL_SEPARATOR)
        return F.transform(F.col("_lines"), lambda x: F.filter(
            F.transform(F.split(x, separator), lambda c: T.trimmed(c, plain)), lambda c: c != ""))

    header = F.get("_cells", F.lit(0))
    body = F.filter(F.slice("_cells", 2, F.greatest(F.size("_cells") - 1, F.lit(0))),
                    lambda c: F.size(c) == F.size(header))
    # A repeated header keeps its first place and takes the last cell.
    keys = F.array_distinct(header)
    last = F.transform(keys, lambda k: F.size(header) - F.array_position(F.reverse(header), k))
    return [
        {"_lines": F.when(marked(t), F.filter(F.split(t, "\n"), marked))},
        {"_cells": F.when(F.size("_lines") > 2, F.when(T.is_ascii(t), cells(True)).otherwise(cells(False)))},
        {"_body": F.when(F.size(header) > 1, body), "_keys": keys, "_last": last},
        {output: F.when(F.size("_body") > 0, F.array(F.struct(
            header.alias("headers"),
            F.transform(F.col("_body"), lambda row: F.map_from_arrays(
                F.col("_keys"), F.transform(F.col("_last"), lambda p: F.get(row, p.cast("int")))
            )).alias("rows"),
            F.lit(0.6).alias("confidence")))).otherwise(F.array()).cast(TABLE_TYPE)},
    ]


def extract_tables(df: DataFrame, text: str = "text", output: str = "tables") -> DataFrame:
    """Adds ``output``: at most one table, from every line with a tab, two spaces or a pipe."""
    for step in _table_steps(text, output):
        df = df.withColumns(step)
    return df.drop("_lines", "_cells", "_body", "_keys", "_last")


@memoized
def _metrics(threshold: float) -> list[dict[str, Column]]:
    total = F.aggregate("fields", F.lit(0.0), lambda acc, f: acc + f["confidence"])
    return [
        {"fields": F.filter("all_fields", lambda f: f["confidence"] >= threshold)},
        {"total_fields_extracted": F.size("all_fields"),
         "fields_above_threshold": F.size("fields"),
         "has_tables": F.size("tables") > 0,
         "extraction_confidence": F.when(F.size("fields") > 0, total / F.size("fields"))
         .otherwise(F.lit(0.0))},
    ]


def analyze(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, text: str = "text",
            doc_type: str = "document_type", keep_text: bool = False, limits: Limits = Limits()) -> DataFrame:
    """Adds fields (at or above the threshold), tables and the analysis metrics; drops the text."""
    df = extract_tables(extract_fields(df, text, doc_type, limits=limits), text)
    df = df if keep_text else df.drop(text)
    df = fence(df, "all_fields", "tables")
    for step in _metrics(threshold):
        df = df.withColumns(step)
    return df.drop("all_fields")


def unnest(df: DataFrame, column: str | Column, *keys: str) -> DataFrame:
    """(keys…, _item), one row per array element.

    The outer form plus a filter on its output: a plain ``explode`` makes the optimizer infer a
    ``size > 0`` filter, which it pushes below the projections that build the array and so has
    the array built twice.
    """
    return df.select(*keys, F.posexplode_outer(column).alias("_pos", "_item")) \
        .filter(F.col("_pos").isNotNull()).drop("_pos")


def long_fields(df: DataFrame, *keys: str, column: str = "fields") -> DataFrame:
    """(keys…, pos, name, value, value_num, confidence), one row per field."""
    exploded = df.select(*keys, F.posexplode_outer(column).alias("pos", "f")) \
        .filter(F.col("pos").isNotNull())
    return exploded.select(*keys, "pos", "f.name", "f.value", "f.value_num", "f.confidence")


def long_table_cells(df: DataFrame, *keys: str, column: str = "tables") -> DataFrame:
    """(keys…, row_no, header, cell), one row per table cell."""
    rows = unnest(df, column, *keys).select(*keys, F.posexplode("_item.rows").alias("row_no", "r"))
    return rows.select(*keys, "row_no", F.explode("r").alias("header", "cell"))
