"""Rule checks over a record's flat values, and the verdict.

All checks of one document are an array in its row; reports aggregate the long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from papertrail import fixed_values as V
from papertrail.functions import text as T
from papertrail.functions.fence import fence
from papertrail.functions.memo import memoized

PASSED = "Validation passed"
NOT_NUMERIC = "Value is not numeric"
RULE_TYPE = ("array<struct<position:int,field:string,rule:string,fmt:string,min_val:double,"
             "max_val:double,min_text:string,max_text:string,pattern:string,message:string,"
             "severity:string>>")


def rule_rows(rules: list[tuple] | None = None) -> list[tuple]:
    """The catalogue as (document_type, position, field, rule, fmt, min, max, min_text, max_text,
    pattern, message, severity) rows; ``*`` rules come after a type's own."""
    rows = []
    for position, (kind, field, rule, given, message, severity) in enumerate(
            rules or V.VALIDATION_RULES):
        low, high = given.get("min"), given.get("max")
        rows.append((kind, position, field, rule, given.get("format"),
                     None if low is None else float(low), None if high is None else float(high),
                     None if low is None else str(low), None if high is None else str(high),
                     T.user_pattern(given.get("pattern")), message, severity))
    return rows


def translated(rules: DataFrame) -> DataFrame:
    """The rule table (a few rows) with its patterns as ``user_pattern`` gives them."""
    def run(batches):
        for batch in batches:
            yield batch.assign(pattern=batch["pattern"].map(T.user_pattern, na_action="ignore"))
    return rules.mapInPandas(run, rules.schema)


def _rule_literals(rows: list[tuple]) -> Column:
    return F.array(*[F.struct(*[F.lit(v) for v in r[1:]]) for r in rows]).cast(RULE_TYPE)


def rules_for(kind: Column, rules: list[tuple] | None = None) -> Column:
    """The rules that apply to a document type, as a constant array."""
    rows = rule_rows(rules)
    general = [r for r in rows if r[0] == "*"]
    result = _rule_literals(general)
    for doc_type in dict.fromkeys(r[0] for r in rows if r[0] != "*"):
        result = F.when(kind == doc_type, _rule_literals(
            [r for r in rows if r[0] == doc_type] + general)).otherwise(result)
    return result


def attach_rules(df: DataFrame, rules: DataFrame, doc_type: str = "document_type") -> DataFrame:
    """Adds ``rules`` from a rule table (document_type, position, field, rule, fmt, min_val,
    max_val, pattern, message, severity).

    The table is configuration, grouped by type and joined once; the optimizer sizes the join.  A pattern that does not
    compile fails its check with a message.
    """
    rules = translated(rules)
    row = F.struct(
        F.col("position").cast("int").alias("position"), "field", "rule", "fmt", "min_val", "max_val",
        T.float_text(F.col("min_val")).alias("min_text"),
        T.float_text(F.col("max_val")).alias("max_text"), "pattern", "message", "severity")
    general = rules.filter(F.col("document_type") == "*") \
        .agg(F.sort_array(F.collect_list(row)).alias("r"))
    own = rules.filter(F.col("document_type") != "*").groupBy(
        F.col("document_type").alias(doc_type)).agg(F.sort_array(F.collect_list(row)).alias("_own"))
    return df.join(own, doc_type, "left").withColumn("rules", F.concat(
        F.coalesce(F.col("_own"), F.array().cast(RULE_TYPE)).cast(RULE_TYPE),
        general.scalar().cast(RULE_TYPE))).drop("_own")


def lookup_index(keys: Column, field: Column) -> Column:
    """1-based place of a rule's field among the flat keys, NULL when there is none.

    Exact candidates come first: the name, the name with ``_`` as ``.``, then below ``fields.`` and
    ``structured.``.  Otherwise the first key that ends with the candidate's last part, where the
    prefixed candidates beat the dotted one.
    """
    dotted = F.replace(field, F.lit("_"), F.lit("."))

    def exact(name: Column) -> Column:
        place = F.array_position(keys, name)
        return F.when(place > 0, place)

    def ending(part: Column) -> Column:
        return F.get(F.filter(F.transform(keys, lambda k, i: F.when(F.endswith(k, part), i + 1)),
                              lambda i: i.isNotNull()), F.lit(0)).cast("long")

    return F.coalesce(
        exact(field), exact(dotted), exact(F.concat(F.lit("fields."), field)),
        exact(F.concat(F.lit("structured."), field)),
        ending(F.substring_index(field, ".", -1)),
        F.when(F.contains(dotted, F.lit(".")), ending(F.substring_index(dotted, ".", -1))))


def matches_format(text: Column, fmt: Column) -> Column:
    """NULL for an unknown format."""
    result = F.when(F.lit(False), F.lit(None).cast("boolean"))
    for name, pattern in V.FORMAT_VALIDATORS.items():
        result = result.when(fmt == name, text.rlike(T.java_regex(rf"\A(?:{pattern})")))
    return result


def _check(position, field, rule, passed, message, severity, value, value_num) -> Column:
    return F.struct(
        position.cast("int").alias("position"), field.alias("field"), rule.alias("rule"),
        passed.alias("passed"), message.alias("message"), severity.alias("severity"),
        value.alias("value"), value_num.alias("value_num"))


CHECK_TYPE = ("array<struct<position:int,field:string,rule:string,passed:boolean,message:string,"
              "severity:string,value:string,value_num:double>>")


def rule_check(rule: Column, hit: Column, custom: dict | None = None) -> Column:
    value, number = hit["value"], hit["value_num"]
    present = value.isNotNull() | number.isNotNull()
    amount = T.as_number(value, number)
    text = T.as_text(value, number)
    failure = F.when(rule["rule"] == "required", F.when(
        ~present | F.coalesce(value == "", F.lit(False)), rule["message"])) \
        .when(rule["rule"] == "format", F.when(
            T.truthy(value, number) & ~F.coalesce(matches_format(text, rule["fmt"]), F.lit(True)),
            rule["message"])) \
        .when(rule["rule"] == "range", F.when(present, F.when(
            amount.isNull(), F.lit(NOT_NUMERIC)).when(
            ~F.isnan(amount) & (amount < rule["min_val"]), F.concat(F.lit("Value "), T.float_text(amount), F.lit(
                " is below minimum "), rule["min_text"])).when(
            ~F.isnan(amount) & (amount > rule["max_val"]), F.concat(F.lit("Value "), T.float_text(amount), F.lit(
                " exceeds maximum "), rule["max_text"])))) \
        .when(rule["rule"] == "regex", F.when(
            T.truthy(value, number) & rule["pattern"].isNotNull(),
            F.when(rule["pattern"] == T.BAD_PATTERN, F.lit(T.BAD_PATTERN)).when(
                ~F.regexp_like(text, F.concat(F.lit(r"(?Ud)\A(?:"), rule["pattern"], F.lit(")"))), rule["message"])))
    for name, passes in (custom or {}).items():  # the rule's format names the function
        failure = F.when((rule["rule"] == "custom") & (rule["fmt"] == name), F.when(
            present & ~F.coalesce(passes(value, number), F.lit(False)), rule["message"])).otherwise(failure)
    return F.struct(rule.alias("r"), failure.alias("failure"), hit.alias("hit"))


def rule_checks(flat: Column, keys: Column, rules: Column, custom: dict | None = None) -> Column:
    """One check per rule, in rule order."""
    hits = F.transform(rules, lambda r: F.struct(r.alias("r"), F.get(
        flat, (lookup_index(keys, r["field"]) - 1).cast("int")).alias("hit")))
    judged = F.transform(hits, lambda h: rule_check(h["r"], h["hit"], custom))
    return F.transform(judged, lambda j: _check(
        j["r"]["position"], j["r"]["field"], j["r"]["rule"], j["failure"].isNull(),
        F.coalesce(j["failure"], F.lit(PASSED)),
        F.when(j["failure"].isNull(), F.lit("info")).otherwise(j["r"]["severity"]),
        j["hit"]["value"], j["hit"]["value_num"]))


def _known_place(keys: Column, joined: Column, field: str | None) -> Column:
    """0-based place of a known field, as ``lookup_index`` finds it.

    ``joined`` holds all keys, each with a line feed: keys are only gone through one by one if one may end so.
    """
    if field is None:
        return F.lit(None).cast("int")
    dotted = field.replace("_", ".")

    def exact(name: str) -> Column:
        return F.nullif(F.array_position(keys, F.lit(name)), F.lit(0).cast("long"))

    def ending(part: str) -> Column:
        return F.when(F.contains(joined, F.lit(part + "\n")), F.get(F.filter(F.transform(
            keys, lambda k, i: F.when(F.endswith(k, F.lit(part)), i + 1)), lambda i: i.isNotNull()), F.lit(0)).cast("long"))

    found = [exact(n) for n in dict.fromkeys([field, dotted, f"fields.{field}", f"structured.{field}"])]
    found += [ending(p) for p in dict.fromkeys([field.rpartition(".")[2], *([dotted.rpartition(".")[2]] if "." in dotted else [])])]
    return (F.coalesce(*found) - 1).cast("int")


def _number_text(number: Column) -> Column:
    """``float_text``, bound: it is long, seldom needed, and written out several times it would be too much code to compile."""
    return F.get(F.transform(F.array(number), T.float_text), F.lit(0))


def _known_check(row: tuple, hit: Column, amount: Column, custom: dict | None) -> Column:
    """``rule_check`` of a known rule; ``amount`` is the value's number, for rules on ranges."""
    _, position, field, rule, fmt, low, high, low_text, high_text, pattern, message, severity = row
    value, number = hit["value"], hit["value_num"]
    present = value.isNotNull() | number.isNotNull()
    written = F.coalesce(value, _number_text(number))
    bad, text = F.lit(False), F.lit(message)
    if rule == "required":
        bad = ~present | F.coalesce(value == "", F.lit(False))
    elif rule == "format" and fmt in V.FORMAT_VALIDATORS:
        bad = T.truthy(value, number) & ~F.coalesce(matches_format(written, F.lit(fmt)), F.lit(True))
    elif rule == "range":
        number_text = _number_text(amount)
        below = ~F.isnan(amount) & (amount < low) if low is not None else F.lit(False)
        above = ~F.isnan(amount) & (amount > high) if high is not None else F.lit(False)
        bad = present & (amount.isNull() | below | above)
        text = F.when(amount.isNull(), F.lit(NOT_NUMERIC)) \
            .when(below, F.concat(F.lit("Value "), number_text, F.lit(f" is below minimum {low_text}"))) \
            .otherwise(F.concat(F.lit("Value "), number_text, F.lit(f" exceeds maximum {high_text}")))
    elif rule == "regex" and pattern == T.BAD_PATTERN:
        bad, text = T.truthy(value, number), F.lit(T.BAD_PATTERN)
    elif rule == "regex" and pattern is not None:
        bad = T.truthy(value, number) & ~F.coalesce(F.regexp_like(written, F.lit(rf"(?Ud)\A(?:{pattern})")), F.lit(True))
    elif rule == "custom" and fmt in (custom or {}):
        bad = present & ~F.coalesce(custom[fmt](value, number), F.lit(False))
    if message is None and not (rule == "range" or rule == "regex" and pattern == T.BAD_PATTERN):
        bad = F.lit(False)  # a failure is its message
    return _check(F.lit(position), F.lit(field), F.lit(rule), ~bad, F.when(bad, text).otherwise(F.lit(PASSED)),
                  F.when(bad, F.lit(severity)).otherwise(F.lit("info")), value, number)


#: Lists of up to so many rules are checked rule by rule, as plain columns; longer ones as an array.
WRITTEN_OUT = 64


def _known_steps(kind: Column, flat: Column, rows: list[tuple], custom: dict | None) -> list[dict[str, Column]]:
    """Steps to ``_rule_checks`` of known rules: the places of their fields, the numbers of those with a range, checks.

    The same checks as ``rule_checks``, without going through rules and keys as arrays in every document.
    """
    general = [r for r in rows if r[0] == "*"]
    by_type = {t: [r for r in rows if r[0] == t] for t in dict.fromkeys(r[0] for r in rows if r[0] != "*")}
    keys, joined = F.col("_keys"), F.col("_joined")

    def hit(i: int, places: str) -> Column:
        return F.get(flat, F.get(F.col(places), F.lit(i)))

    def places(some: list[tuple], _: str) -> list[Column]:
        return [_known_place(keys, joined, r[2]) for r in some]

    def amounts(some: list[tuple], side: str) -> list[Column]:
        return [T.as_number(hit(i, f"{side}_places")["value"], hit(i, f"{side}_places")["value_num"])
                for i, r in enumerate(some) if r[3] == "range"]

    def checks(some: list[tuple], side: str) -> list[Column]:
        ranges = [i for i, r in enumerate(some) if r[3] == "range"]
        return [_known_check(r, hit(i, f"{side}_places"),
                             F.get(F.col(f"{side}_amounts"), F.lit(ranges.index(i))) if i in ranges else None, custom)
                for i, r in enumerate(some)]

    def both(build, item: str) -> tuple[Column, Column]:
        own = F.array().cast(f"array<{item}>")
        for name, mine in by_type.items():
            own = F.when(kind == name, F.array(*build(mine, "_own")).cast(f"array<{item}>")).otherwise(own)
        return own, F.array(*build(general, "_all")).cast(f"array<{item}>")

    found, numbers = both(places, "int"), both(amounts, "double")
    item = CHECK_TYPE[len("array<"):-1]
    return [{"_own_places": found[0], "_all_places": found[1]}, {"_own_amounts": numbers[0], "_all_amounts": numbers[1]},
            {"_rule_checks": F.concat(*both(checks, item))}]


def structure_checks(present: dict[str, Column]) -> Column:
    none = F.lit(None)
    return F.array(*[_check(
        F.lit(1000 + i), F.lit(f"schema.{key}"), F.lit("structure"), present[key],
        F.concat(F.lit(f"Schema field {key} is "), F.when(present[key], "present").otherwise("missing")),
        F.when(present[key], "info").otherwise("error"), none.cast("string"), none.cast("double"))
        for i, key in enumerate(V.RECORD_KEYS)]).cast(CHECK_TYPE)


def _first_truthy(flat: Column, keys: Column, *names: str) -> Column:
    def first(name: str) -> Column:
        # Mostly the key is missing or its first value counts; later ones are looked through only if that does not.
        place = F.array_position(keys, F.lit(name))
        at = F.get(flat, (place - 1).cast("int"))
        return F.when(place == 0, F.lit(None)).when(T.truthy(at["value"], at["value_num"]), at).otherwise(
            F.get(F.filter(flat, lambda x: (x["key"] == name) & T.truthy(x["value"], x["value_num"])), F.lit(0)))

    return F.coalesce(*[first(n) for n in names])


def cross_field_checks(kind: Column, flat: Column, keys: Column | None = None) -> Column:
    """Invoices only: total against subtotal + tax, skipped unless all three are there."""
    keys = flat["key"] if keys is None else keys
    parts = F.transform(F.array(F.struct(
        _first_truthy(flat, keys, "subtotal", "amounts.subtotal").alias("s"),
        _first_truthy(flat, keys, "tax_amount", "amounts.tax").alias("t"),
        _first_truthy(flat, keys, "total_amount", "amounts.total").alias("a"))), lambda p: F.struct(
            T.as_number(p["s"]["value"], p["s"]["value_num"]).alias("sn"),
            T.as_number(p["t"]["value"], p["t"]["value_num"]).alias("tn"),
            T.as_number(p["a"]["value"], p["a"]["value_num"]).alias("an"),
            T.as_text(p["s"]["value"], p["s"]["value_num"]).alias("st"),
            T.as_text(p["t"]["value"], p["t"]["value_num"]).alias("tt")))
    usable = F.filter(parts, lambda p: p["sn"].isNotNull() & p["tn"].isNotNull() & p["an"].isNotNull())

    def judge(p: Column) -> Column:
        ok = F.abs(p["sn"] + p["tn"] - p["an"]) < 0.01
        return _check(
            F.lit(2000), F.lit("total_amount"), F.lit("cross_field"), ok,
            F.when(ok, F.lit("Total amount matches subtotal + tax")).otherwise(F.concat(
                F.lit("Total "), T.float_text(p["an"]), F.lit(" doesn't match subtotal "), p["st"],
                F.lit(" + tax "), p["tt"])),
            F.when(ok, "info").otherwise("warning"), F.lit(None).cast("string"),
            F.lit(None).cast("double"))

    return F.when(kind == "invoice", F.transform(usable, judge)) \
        .otherwise(F.array().cast(CHECK_TYPE)).cast(CHECK_TYPE)


def filled_share(flat: Column) -> Column:
    """Share of flat keys with a truthy value; 0 without keys."""
    filled = F.size(F.filter(flat, lambda x: T.truthy(x["value"], x["value_num"])))
    return F.when(F.size(flat) > 0, filled / F.size(flat)).otherwise(F.lit(0.0))


def quality_check(share: Column, threshold: float = 0.7) -> Column:
    ok = share >= threshold
    percent = F.bround(share * 100, 1).cast("decimal(18,1)").cast("string")
    return F.array(_check(
        F.lit(3000), F.lit("data_completeness"), F.lit("quality"), ok,
        F.concat(F.when(ok, "Data is ").otherwise("Data is only "), percent, F.lit("% complete")),
        F.when(ok, "info").otherwise("warning"), F.lit(None).cast("string"),
        F.lit(None).cast("double"))).cast(CHECK_TYPE)


@memoized
def _check_steps(document_id: str, doc_type: str, strict: bool, lenient_score: float) -> list[dict[str, Column]]:
    return _steps(document_id, doc_type, strict, lenient_score, None, rule_rows())


def _steps(document_id: str, doc_type: str, strict: bool, lenient_score: float,
           custom: dict | None, rows: list[tuple] | None) -> list[dict[str, Column]]:
    """``rows``: the rules if they are known and few, else each document has its own in ``rules``."""
    kind, flat = F.col(doc_type), F.col("flat")
    present = {"schema_version": F.lit(True), "document_id": F.col(document_id).isNotNull(),
               "document_type": kind.isNotNull(), "extracted_data": flat.isNotNull()}
    rule_failures = F.filter("_rule_checks", lambda c: ~c["passed"])

    def messages(severity: str) -> Column:
        return F.transform(F.filter(rule_failures, lambda c: c["severity"] == severity),
                           lambda c: c["message"])

    missing = F.transform(F.filter("_failed", lambda c: c["rule"] == "required"), lambda c: c["field"])
    suggestions = F.array_compact(F.array(
        F.when(F.size(missing) > 0, F.concat(F.lit(V.SUGGEST_MISSING), F.array_join(missing, ", "))),
        F.when(F.exists("_failed", lambda c: c["rule"] == "format"), F.lit(V.SUGGEST_FORMAT)),
        F.when((kind == "invoice") & _first_truthy(flat, F.col("_keys"), "line_items").isNull(),
               F.lit(V.SUGGEST_LINE_ITEMS)),
        F.when((kind == "contract") & _first_truthy(flat, F.col("_keys"), "terms").isNull(), F.lit(V.SUGGEST_TERMS))))
    score = (F.size("checks") - F.size("_failed")) / F.size("checks")
    valid = ~F.exists("_failed", lambda c: c["severity"] == "error") if strict \
        else score >= lenient_score
    return [
        {"_keys": flat["key"], "_joined": F.concat(F.array_join(flat["key"], "\n"), F.lit("\n")), "_share": filled_share(flat)},
        *([{"_rule_checks": rule_checks(flat, F.col("_keys"), F.col("rules"), custom)}] if rows is None
          else _known_steps(kind, flat, rows, custom)),
        {"checks": F.concat(F.col("_rule_checks"), structure_checks(present),
                            cross_field_checks(kind, flat, F.col("_keys")), quality_check(F.col("_share")))},
        {"_failed": F.filter("checks", lambda c: ~c["passed"])},
        {"total_checks": F.size("checks"), "failed_checks": F.size("_failed"),
         "passed_checks": F.size("checks") - F.size("_failed"), "validation_score": score,
         "is_valid": valid, "errors": messages("error"), "warnings": messages("warning"),
         "suggestions": suggestions},
    ]


def validate(df: DataFrame, rules: list[tuple] | DataFrame | None = None, strict: bool = True,
             lenient_score: float = 0.7, document_id: str = "document_id",
             doc_type: str = "document_type", custom: dict | None = None) -> DataFrame:
    """Adds checks, is_valid, validation_score, total/passed/failed_checks, errors, warnings and
    suggestions to rows that carry ``flat``.

    ``rules``: a rule list, a rule table, or nothing for the standard catalogue.
    ``custom``: name -> function of (value, number) Columns to a boolean Column; a ``custom`` rule names one in its
    format.  A custom rule without such a function passes.
    """
    known = None if isinstance(rules, DataFrame) else rule_rows(rules)
    if known is None:
        df = attach_rules(df, rules, doc_type)
    elif len(known) > WRITTEN_OUT:
        df, known = df.withColumn("rules", rules_for(F.col(doc_type), rules)), None
    steps = _check_steps(document_id, doc_type, strict, lenient_score) if rules is None and known and not custom \
        else _steps(document_id, doc_type, strict, lenient_score, custom, known)
    for step in steps:
        df = df.withColumns(step)
    return fence(df.drop("_rule_checks", "_failed", "rules", "_keys", "_joined", "_share", "_own_places", "_all_places",
                         "_own_amounts", "_all_amounts"), "checks", *steps[-1])


def long_checks(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode_outer("checks").alias("pos", "c")) \
        .filter(F.col("pos").isNotNull()).select(*keys, "pos", "c.*")


def failure_rollup(checks: DataFrame, doc_type: str = "document_type") -> DataFrame:
    """Check and failure counts per (type, field, rule) with sub-totals: counted once, then rolled up from the counts."""
    counted = checks.groupBy(doc_type, "field", "rule").agg(
        F.count(F.lit(1)).alias("n_checks"), F.count_if(~F.col("passed")).alias("n_failed"))
    return counted.rollup(doc_type, "field", "rule").agg(
        F.grouping_id().alias("level"), F.sum("n_checks").alias("n_checks"), F.sum("n_failed").alias("n_failed"))
