"""Fields to a structured record with automation triggers.  Row-wise: no shuffle."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from papertrail import fixed_values as V
from papertrail.functions import text as T
from papertrail.functions.memo import memoized
from papertrail.operators.extract import unnest

PAIR = "struct<value:string,value_num:double>"


def _pair(f: Column) -> Column:
    return F.struct(f["value"].alias("value"), f["value_num"].alias("value_num"))


def last_wins(fields: Column) -> Column:
    """One entry per name: first place, last value.  Repeats only occur in short lists."""
    names = F.array_distinct(fields["name"])
    unique = F.transform(names, lambda n: F.element_at(F.filter(fields, lambda f: f["name"] == n), -1))
    return F.when(F.size(names) < F.size(fields), unique).otherwise(fields)


@memoized
def _partition_steps(fields: str) -> list[dict[str, Column]]:
    # Most types have no identifiers, so that there is nothing to part.
    plain = ~F.arrays_overlap(F.col("_unique")["name"], F.array(*[F.lit(n) for n in V.METADATA_FIELDS]))
    return [{"_unique": last_wins(F.col(fields))}, {
        "record_fields": F.when(plain, F.col("_unique")).otherwise(
            F.filter("_unique", lambda f: ~f["name"].isin(V.METADATA_FIELDS))),
        "record_metadata": F.when(plain, F.slice("_unique", 1, 0)).otherwise(
            F.filter("_unique", lambda f: f["name"].isin(V.METADATA_FIELDS))),
    }]


def partition_fields(df: DataFrame, fields: str = "fields") -> DataFrame:
    """Adds ``record_fields`` / ``record_metadata``: identifiers go to the metadata part."""
    for step in _partition_steps(fields):
        df = df.withColumns(step)
    return df.drop("_unique")


def _as_map(fields: Column) -> Column:
    return F.map_from_arrays(fields["name"], fields)


def _pick(name: str) -> Column:
    """A record value by source field name, from the metadata part or from the fields."""
    return F.try_element_at(F.col("_meta" if name in V.METADATA_FIELDS else "_plain"), F.lit(name))


def condition_holds(condition: dict, lookup=_pick) -> Column:
    """AND over ``field: constraint``.  A constraint is a value or {$exists, $gte, $lte}.

    Bounds are skipped for a missing or falsy value; unknown operators are ignored.
    Identifier fields live in the metadata part and count as missing here.
    """
    result = F.lit(True)
    for field, constraint in condition.items():
        pair = F.lit(None).cast(PAIR) if field in V.METADATA_FIELDS else lookup(field)
        value, number = pair["value"], pair["value_num"]
        present = value.isNotNull() | number.isNotNull()
        if not isinstance(constraint, dict):
            if constraint is None:
                same = ~present
            elif isinstance(constraint, str):
                same = value == constraint
            else:
                same = number == float(constraint)
            result = result & F.coalesce(same, F.lit(False))
            continue
        if "$exists" in constraint:
            result = result & (present if constraint["$exists"] else ~present)
        for op in ("$gte", "$lte"):
            if op in constraint:
                bound, measured = float(constraint[op]), T.as_number(value, number)
                inside = measured >= bound if op == "$gte" else measured <= bound
                # No comparison with NaN fails.
                result = result & (~T.truthy(value, number) | F.coalesce(inside | F.isnan(measured), F.lit(False)))
    return result


def _trigger(action: str, endpoint: Column, condition: dict | None, position: int) -> Column:
    return F.struct(
        F.lit(position).alias("position"), F.lit(action).alias("action"),
        endpoint.alias("endpoint"), F.lit(V.TRIGGER_METHOD).alias("method"),
        F.lit(json.dumps(condition) if condition else None).cast("string").alias("condition"))


def _triggers(kind: Column, templates: list[tuple]) -> Column:
    result = None
    for doc_type in dict.fromkeys(t[0] for t in templates):
        mine = [t for t in templates if t[0] == doc_type]
        fired = F.array_compact(F.array(*[
            F.when(condition_holds(cond or {}), _trigger(action, F.lit(endpoint), cond, i))
            for i, (_, action, cond, endpoint) in enumerate(mine)]))
        result = F.when(kind == doc_type, fired) if result is None \
            else result.when(kind == doc_type, fired)
    return F.lit(None) if result is None else result


def _structured(kind: Column, build) -> Column:
    result = None
    for doc_type, layout in V.STRUCTURED_LAYOUT.items():
        value = build(doc_type, layout)
        result = F.when(kind == doc_type, value) if result is None \
            else result.when(kind == doc_type, value)
    return result


def required_present(kind: Column, required: dict[str, list[str]] = V.REQUIRED_FIELDS) -> Column:
    """Share of the type's required fields found among the record fields; NULL without any."""
    result = F.lit(None).cast("double")
    for doc_type, names in required.items():
        if names:
            hits = sum((F.map_contains_key("_plain", n).cast("int") for n in names), F.lit(0))
            result = F.when(kind == doc_type, hits / len(names)).otherwise(result)
    return result


def _freeze(templates: list[tuple] | None) -> tuple | None:
    """Templates in a hashable form (conditions as JSON text)."""
    return templates and tuple((k, a, json.dumps(c) if c else None, e) for k, a, c, e in templates)


@memoized
def _record_steps(doc_type: str, fields: str, tables: str, frozen: tuple | None) -> list[dict[str, Column]]:
    kind = F.col(doc_type)
    templates = [(k, a, json.loads(c) if c else None, e) for k, a, c, e in frozen] if frozen \
        else V.TRIGGER_TEMPLATES
    leaves = _structured(kind, lambda _, layout: F.array(*[
        F.struct(F.lit(f"{group}.{leaf}").alias("key"), _pick(source)["value"].alias("value"),
                 _pick(source)["value_num"].alias("value_num"))
        for group, members in layout.items() for leaf, source in members]))
    own = F.transform("record_fields", lambda f: F.struct(
        f["name"].alias("key"), f["value"].alias("value"), f["value_num"].alias("value_num")))
    fallback = F.array(_trigger("webhook", F.concat(F.lit(V.DEFAULT_TRIGGER_ENDPOINT), kind), None, 0))
    scores = F.aggregate(fields, F.lit(0.0), lambda a, f: a + f["confidence"]) \
        + F.aggregate(tables, F.lit(0.0), lambda a, t: a + t["confidence"]) \
        + F.coalesce("completeness", F.lit(0.0))
    count = F.size(fields) + F.size(tables) + F.col("completeness").isNotNull().cast("int")
    return [
        {"_plain": _as_map(F.col("record_fields")), "_meta": _as_map(F.col("record_metadata"))},
        {"record_tables": F.transform(tables, lambda t: F.struct(
            t["headers"].alias("headers"), t["rows"].alias("rows"),
            F.size(t["rows"]).alias("row_count"), t["confidence"].alias("confidence"))),
         "flat": F.concat(own, F.coalesce(leaves, F.array().cast(
             "array<struct<key:string,value:string,value_num:double>>"))),
         "line_items": F.when(kind.isin(list(V.LINE_ITEM_MEMBER)), F.coalesce(
             F.get(F.col(tables), F.lit(0))["rows"], F.array().cast("array<map<string,string>>"))),
         "_fired": _triggers(kind, templates), "completeness": required_present(kind)},
        {"triggers": F.when(F.size("_fired") > 0, F.col("_fired")).otherwise(fallback),
         "confidence_score": F.when(count > 0, scores / count).otherwise(F.lit(0.5))},
    ]


def build_records(df: DataFrame, doc_type: str = "document_type", fields: str = "fields",
                  tables: str = "tables", templates: list[tuple] | None = None) -> DataFrame:
    """Adds record_fields, record_metadata, record_tables, flat (dotted leaves), line_items,
    triggers, completeness and confidence_score."""
    df = partition_fields(df, fields)
    for step in _record_steps(doc_type, fields, tables, _freeze(templates)):
        df = df.withColumns(step)
    return df.drop("_fired", "_plain", "_meta")


def processing_metadata(df: DataFrame, fields: str = "fields", tables: str = "tables") -> Column:
    """STRUCT with the extraction facts; absent inputs take their defaults."""
    def given(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
    return F.struct(
        given("ocr_confidence", 0.0).alias("ocr_confidence"),
        given("extraction_method", "automatic").alias("extraction_method"),
        given("processing_time_ms", 0).alias("processing_time_ms"),
        given("page_count", 1).alias("page_count"),
        (F.size(tables) > 0).alias("has_tables"), F.size(fields).alias("field_count"))


def _variant(f: Column) -> Column:
    return F.coalesce(f["value_num"].cast("variant"), f["value"].cast("variant"))


def to_schema_json(df: DataFrame, document_id: str = "document_id",
                   doc_type: str = "document_type", as_of: Column | None = None) -> DataFrame:
    """Adds ``schema_json``, the assembled record; identifiers are derived, so reruns agree."""
    kind = F.col(doc_type)

    def structured(name: str, layout: dict) -> Column:
        # The leaves follow the record's own fields in ``flat``, in layout order.
        places = {(g, leaf): i for i, (g, leaf) in enumerate(
            (g, leaf) for g, members in layout.items() for leaf, _ in members)}
        groups = [F.struct(*[_variant(F.get("flat", F.size("record_fields") + places[g, leaf])).alias(leaf)
                             for leaf, _ in members]).alias(g) for g, members in layout.items()]
        if name in V.LINE_ITEM_MEMBER:
            groups.append(F.col("line_items").alias(V.LINE_ITEM_MEMBER[name]))
        return F.to_variant_object(F.struct(*groups))

    named = "array<struct<key:string,value:variant>>"
    trigger_id = F.sha2(F.concat_ws("|", F.col(document_id).cast("string"), F.lit("trigger")), 256)
    facts = [c for c in ("extraction_confidence", "total_fields_extracted", "fields_above_threshold",
                         "has_tables") if c in df.columns]
    df = df.withColumn("_structured", _structured(kind, structured))
    record = F.struct(
        F.lit(V.SCHEMA_VERSION).alias("schema_version"),
        F.sha2(F.concat_ws("|", F.col(document_id).cast("string"), F.lit("schema")), 256)
        .alias("schema_id"),
        F.col(document_id).cast("string").alias("document_id"), kind.alias("document_type"),
        *([as_of.alias("timestamp")] if as_of is not None else []),
        F.col("confidence_score"),
        F.struct(
            kind.alias("document_type"),
            F.map_from_entries(F.transform("record_metadata", lambda f: F.struct(
                f["name"].alias("key"), _variant(f).alias("value"))).cast(named)).alias("metadata"),
            F.map_from_entries(F.transform("record_fields", lambda f: F.struct(
                f["name"], F.struct(_variant(f).alias("value"), f["confidence"].alias("confidence"))
            ))).alias("fields"),
            F.col("record_tables").alias("tables"),
            *([F.struct(*facts).alias("raw_data")] if facts else []),
            F.col("_structured").alias("structured")).alias("extracted_data"),
        processing_metadata(df).alias("processing_metadata"),
        F.transform("triggers", lambda t: F.struct(
            F.concat_ws("-", trigger_id, t["position"].cast("string")).alias("trigger_id"),
            t["action"].alias("action"), t["endpoint"].alias("endpoint"),
            t["method"].alias("method"), F.parse_json(t["condition"]).alias("condition"),
            F.struct(F.col(document_id).cast("string").alias("document_id"),
                     kind.alias("document_type"), F.col("_structured").alias("data"))
            .alias("payload_template"))).alias("automation_triggers"),
        F.lit("pending").alias("validation_status"),
        F.array().cast("array<string>").alias("validation_errors"))
    return df.withColumn("schema_json", F.to_json(record)).drop("_structured")


def long_triggers(df: DataFrame, *keys: str) -> DataFrame:
    return unnest(df, "triggers", *keys).select(*keys, "_item.*")


def evaluate_conditions(df: DataFrame, *keys: str, doc_type: str = "document_type",
                        templates: list[tuple] | None = None) -> DataFrame:
    """(keys…, endpoint, passed) for every conditional template of the document's type."""
    df = df.withColumn("_plain", _as_map(F.col("record_fields")))
    tests = F.array_compact(F.array(*[
        F.when(F.col(doc_type) == kind, F.struct(
            F.lit(endpoint).alias("endpoint"), condition_holds(cond).alias("passed")))
        for kind, _, cond, endpoint in (templates or V.TRIGGER_TEMPLATES) if cond]))
    return unnest(df, tests, *keys).select(*keys, "_item.*")
