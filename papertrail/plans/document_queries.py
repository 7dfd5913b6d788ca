"""Registered queries over document text: patterns, fields, records, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from papertrail import fixed_values as V
from papertrail.functions.fence import fence
from papertrail.operators import extract as X, records as R, rule_join as J, validate as G
from papertrail.plans.fixtures import table, view
from papertrail.session import shared_dir


def rendered(spark: SparkSession, sf: str) -> DataFrame:
    return fence(view(spark, sf, "rendered"), "text").withColumnRenamed("doc_type", "document_type")


def raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.lit(V.DEFAULT_TYPE).alias("document_type"), "text")


def both_corpora(spark: SparkSession, sf: str) -> DataFrame:
    return rendered(spark, sf).withColumn("corpus", F.lit("rendered")).unionByName(
        raw_documents(spark, sf).withColumn("corpus", F.lit("documents")))


def analyzed(spark: SparkSession, sf: str, threshold: float = 0.7) -> DataFrame:
    return X.analyze(rendered(spark, sf), threshold)


def recorded(spark: SparkSession, sf: str, threshold: float = 0.7) -> DataFrame:
    return R.build_records(analyzed(spark, sf, threshold))


def validated(spark: SparkSession, sf: str, threshold: float = 0.7, **options) -> DataFrame:
    return G.validate(recorded(spark, sf, threshold), document_id="doc_id", **options)


def _r6(name: str):
    return F.round(name, 6).alias(name)


def pattern_query(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        hits = X.pattern_hits(both_corpora(spark, sf).drop("document_type"), [name])
        return hits.select("corpus", "doc_id", "n_hits", "first_hit")
    return run


def typed_fields(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = rendered(spark, sf).filter(F.col("document_type") == kind)
        return X.long_fields(X.extract_fields(docs, override=False), "doc_id", column="all_fields")
    return run


def extract_generic(spark: SparkSession, sf: str) -> DataFrame:
    docs = both_corpora(spark, sf).filter(F.col("document_type") == V.DEFAULT_TYPE)
    return X.long_fields(X.extract_fields(docs, override=False), "corpus", "doc_id",
                         column="all_fields")


def nda_fields(*prefixes: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = rendered(spark, sf).filter(F.col("document_type") == "nda")
        fields = X.long_fields(X.extract_fields(docs, override=False), "doc_id", column="all_fields")
        wanted = F.lit(False)
        for prefix in prefixes:
            wanted = wanted | F.startswith("name", F.lit(prefix))
        return fields.filter(wanted).select("doc_id", "pos", "name", "value", "confidence")
    return run


def nda_override(spark: SparkSession, sf: str) -> DataFrame:
    docs = both_corpora(spark, sf).withColumnRenamed("document_type", "given_type")
    final = X.override_type(docs.withColumn("document_type", F.col("given_type")))
    return final.select("corpus", "doc_id", "given_type", "document_type")


def extract_tables(spark: SparkSession, sf: str) -> DataFrame:
    found = X.unnest(X.extract_tables(both_corpora(spark, sf)), "tables", "corpus", "doc_id")
    return found.select("corpus", "doc_id", F.array_join("_item.headers", "|").alias("headers"),
                        F.size("_item.rows").alias("row_count"), F.col("_item.confidence").alias("confidence"))


def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    return X.long_table_cells(X.extract_tables(both_corpora(spark, sf)), "corpus", "doc_id")


def fields_long(spark: SparkSession, sf: str) -> DataFrame:
    return X.long_fields(analyzed(spark, sf), "doc_id", "document_type")


def analysis_summary(spark: SparkSession, sf: str) -> DataFrame:
    return analyzed(spark, sf).select(
        "doc_id", "document_type", "total_fields_extracted", "fields_above_threshold",
        "has_tables", _r6("extraction_confidence"))


def record_fields(spark: SparkSession, sf: str) -> DataFrame:
    df = R.partition_fields(analyzed(spark, sf, 0.5))
    parts = F.concat(*[F.transform(c, lambda f: F.struct(F.lit(p).alias("part"), f.alias("f")))
                       for c, p in (("record_fields", "fields"), ("record_metadata", "metadata"))])
    return X.unnest(df, parts, "doc_id").select("doc_id", "_item.part", "_item.f.*")


def record_tables(spark: SparkSession, sf: str) -> DataFrame:
    found = X.unnest(recorded(spark, sf), "record_tables", "doc_id")
    return found.select("doc_id", F.array_join("_item.headers", "|").alias("headers"),
                        F.col("_item.row_count").alias("row_count"), F.col("_item.confidence").alias("confidence"))


def structured_record(kind: str):
    """One row per record of the type: its dotted leaves side by side."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = rendered(spark, sf).filter(F.col("document_type") == kind)
        df = R.build_records(X.analyze(docs, 0.5))
        leaf = F.map_from_entries(F.transform("flat", lambda x: F.struct(
            x["key"], F.struct(x["value"].alias("value"), x["value_num"].alias("value_num")))))
        df = df.select("doc_id", leaf.alias("leaf"), F.size("line_items").alias("n_items"))
        columns = []
        for group, members in V.STRUCTURED_LAYOUT[kind].items():
            for name, source in members:
                numeric = source in ("subtotal", "tax_amount", "total_amount", "contract_value")
                value = F.try_element_at("leaf", F.lit(f"{group}.{name}"))
                columns.append(value["value_num" if numeric else "value"].alias(f"{group}_{name}"))
        items = ["n_items"] if kind in V.LINE_ITEM_MEMBER else []
        return df.select("doc_id", *columns, *items)
    return run


def trigger_conditions(spark: SparkSession, sf: str) -> DataFrame:
    return R.evaluate_conditions(recorded(spark, sf), "doc_id")


def triggers(spark: SparkSession, sf: str) -> DataFrame:
    return R.long_triggers(recorded(spark, sf), "doc_id", "document_type").select(
        "doc_id", "document_type", "position", "action", "endpoint", "method")


def record_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return recorded(spark, sf).select("doc_id", _r6("confidence_score"))


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    return recorded(spark, sf).select("doc_id", "document_type", _r6("completeness"))


def record_metadata(spark: SparkSession, sf: str) -> DataFrame:
    df = recorded(spark, sf)
    return df.select("doc_id", R.processing_metadata(df).alias("m")).select("doc_id", "m.*")


def schema_json(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON record read back: parsed once per row, then looked up by path."""
    df = R.to_schema_json(recorded(spark, sf), document_id="doc_id")
    df = df.select("doc_id", F.parse_json("schema_json").alias("record"))

    def path(p: str, kind: str = "string"):
        return F.try_variant_get("record", p, kind)
    return df.select(
        "doc_id", path("$.schema_version").alias("schema_version"),
        path("$.document_type").alias("document_type"),
        path("$.document_id").alias("document_id"),
        path("$.extracted_data.metadata.invoice_number").alias("invoice_number"),
        F.round(path("$.extracted_data.fields.total_amount.value", "double"), 6).alias("total_amount"),
        path("$.extracted_data.structured.vendor.name").alias("vendor"),
        path("$.automation_triggers[0].endpoint").alias("first_endpoint"),
        path("$.processing_metadata.field_count", "int").alias("field_count"),
        path("$.validation_status").alias("validation_status"))


def flat_data(spark: SparkSession, sf: str) -> DataFrame:
    return recorded(spark, sf).select("doc_id", F.posexplode_outer("flat").alias("ord", "x")) \
        .filter(F.col("ord").isNotNull()).select("doc_id", "ord", "x.*")


def rule_lookup(spark: SparkSession, sf: str) -> DataFrame:
    df = validated(spark, sf, 0.5)
    rules = F.filter("checks", lambda c: c["position"] < 1000)
    return X.unnest(df, rules, "doc_id").select("doc_id", "_item.*").select("doc_id", "position", "field", "rule", "value", "value_num")


def checks(spark: SparkSession, sf: str) -> DataFrame:
    return G.long_checks(validated(spark, sf), "doc_id", "document_type").select(
        "doc_id", "document_type", "pos", "field", "rule", "passed", "message", "severity")


def format_validators(spark: SparkSession, sf: str) -> DataFrame:
    values = X.long_fields(analyzed(spark, sf, 0.5), "doc_id").filter(F.col("value").isNotNull())
    return values.select("doc_id", "pos", "value", *[
        G.matches_format(F.col("value"), F.lit(f)).alias(f"is_{f}") for f in V.FORMAT_VALIDATORS])


# A caller's own rule table: every rule type, one rule for all types.
CUSTOM_RULES = [
    ("receipt", 0, "receipt_number", "regex", None, None, None, r"R-\d+$", "Odd receipt number", "error"),
    ("receipt", 1, "payment_method", "regex", None, None, None, r"c", "Not cash, card or check", "warning"),
    ("contract", 2, "contract_value", "range", None, 1000.0, 250000.0, None, "Value out of range", "warning"),
    ("contract", 3, "effective_date", "custom", None, None, None, None, "Never fails", "error"),
    ("nda", 4, "contact_email_1", "format", "email", None, None, None, "Bad e-mail", "error"),
    ("nda", 5, "term_duration", "required", None, None, None, None, "No term", "error"),
    ("*", 6, "total_amount", "required", None, None, None, None, "No total", "warning"),
]
CUSTOM_RULE_SCHEMA = ("document_type string, position int, field string, rule string, fmt string, "
                      "min_val double, max_val double, pattern string, message string, severity string")


def custom_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(CUSTOM_RULES, CUSTOM_RULE_SCHEMA)
    df = validated(spark, sf, rules=rules)
    own = F.filter("checks", lambda c: c["position"] < 1000)
    return X.unnest(df, own, "doc_id").select("doc_id", "_item.*").select("doc_id", "position", "field", "rule", "passed", "severity")


def stored_records(spark: SparkSession, sf: str) -> DataFrame:
    """Flat records as a table, for operators that read them twice."""
    path = shared_dir(spark, "flat-records")
    recorded(spark, sf).select("doc_id", "document_type", "flat").write.parquet(path)
    return spark.read.parquet(path)


def rule_table_checks(spark: SparkSession, sf: str) -> DataFrame:
    return J.rule_checks(stored_records(spark, sf), view(spark, sf, "supplier_rules"), "doc_id").drop("passed")


def rule_table_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return J.rule_verdicts(stored_records(spark, sf), view(spark, sf, "supplier_rules"), "doc_id")


def rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.override_type(rendered(spark, sf)).withColumn("n", F.size(G.rules_for(F.col("document_type"))))
    return docs.groupBy("document_type").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_rules"))


def check_rows(rule: str, threshold: float = 0.7, *columns: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = validated(spark, sf, threshold)
        mine = F.filter("checks", lambda c: c["rule"] == rule)
        return X.unnest(df, mine, "doc_id").select("doc_id", "_item.*").select("doc_id", "field", "passed", "message", "severity")
    return run


def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    return validated(spark, sf).select("doc_id", F.array_join("suggestions", " | ").alias("suggestions"))


def verdict(strict: bool, threshold: float = 0.7):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return validated(spark, sf, threshold, strict=strict).select(
            "doc_id", "document_type", "is_valid", _r6("validation_score"), "total_checks",
            "passed_checks", "failed_checks")
    return run


def validation_messages(spark: SparkSession, sf: str) -> DataFrame:
    return validated(spark, sf).select(
        "doc_id", F.array_join("errors", " | ").alias("errors"),
        F.array_join("warnings", " | ").alias("warnings"))


def failure_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return G.failure_rollup(G.long_checks(validated(spark, sf), "doc_id", "document_type"))


QUERIES = {
    **{f"pat_{name}": pattern_query(name) for name in V.PATTERNS},
    "nda_override": nda_override,
    "extract_invoice": typed_fields("invoice"),
    "extract_receipt": typed_fields("receipt"),
    "extract_contract": typed_fields("contract"),
    "extract_form": typed_fields("form"),
    "extract_generic": extract_generic,
    "nda_parties": nda_fields("disclosing_party", "receiving_party"),
    "nda_terms": nda_fields("effective_date", "term_duration", "jurisdiction", "purpose"),
    "nda_contacts": nda_fields("contact_"),
    "nda_signatories": nda_fields("signatory_"),
    "extract_tables": extract_tables,
    "table_rows": table_rows,
    "fields_long": fields_long,
    "analysis_summary": analysis_summary,
    "record_fields": record_fields,
    "record_tables": record_tables,
    "record_invoice": structured_record("invoice"),
    "record_receipt": structured_record("receipt"),
    "record_contract": structured_record("contract"),
    "trigger_conditions": trigger_conditions,
    "triggers": triggers,
    "record_confidence": record_confidence,
    "completeness": completeness,
    "record_metadata": record_metadata,
    "schema_json": schema_json,
    "flat_data": flat_data,
    "rule_lookup": rule_lookup,
    "checks": checks,
    "format_validators": format_validators,
    "custom_rules": custom_rules,
    "rule_table_checks": rule_table_checks,
    "rule_table_verdict": rule_table_verdict,
    "rule_counts": rule_counts,
    "structure_checks": check_rows("structure"),
    "cross_field": check_rows("cross_field", 0.5),
    "data_quality": check_rows("quality"),
    "suggestions": suggestions,
    "verdict_strict": verdict(True),
    "verdict_lenient": verdict(False),
    "validation_messages": validation_messages,
    "failure_rollup": failure_rollup,
}
