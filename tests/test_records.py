import json

from pyspark.sql import functions as F

from papertrail.operators import extract as X, records as R, validate as G

FIELDS = "doc_id int, document_type string, " + f"fields {X.FIELD_TYPE}, tables {X.TABLE_TYPE}"


def records(spark, rows):
    """rows: (doc_id, type, [(name, value, confidence)])"""
    data = [(i, k, [(n, v if isinstance(v, str) else None, None if isinstance(v, str) else float(v), c) for n, v, c in fs], []) for i, k, fs in rows]
    return spark.createDataFrame(data, FIELDS)


def checked(spark, rows, **options):
    return {r.doc_id: r for r in G.validate(R.build_records(records(spark, rows)), document_id="doc_id", **options).collect()}


def outcome(row, field, rule):
    return [c.passed for c in row.checks if (c.field, c.rule) == (field, rule)]


def test_last_value_keeps_first_place(spark):
    df = records(spark, [(1, "form", [("name", "A", 0.6), ("city", "X", 0.6), ("name", "B", 0.7)])])
    row = R.partition_fields(df).first()
    assert [(f.name, f.value, f.confidence) for f in row.record_fields] == [("name", "B", 0.7), ("city", "X", 0.6)]


def test_trigger_conditions(spark):
    def endpoints(kind, fields, templates=None):
        row = R.build_records(records(spark, [(1, kind, fields)]), templates=templates).first()
        return [t.endpoint for t in row.triggers]
    high, payable = "/api/invoices/high-value", "/api/invoices/payable"
    assert endpoints("invoice", [("total_amount", 1000, 0.8), ("due_date", "1/1/24", 0.7)]) == [high, payable]
    assert endpoints("invoice", [("total_amount", 999, 0.8)]) == ["/api/documents/invoice"]
    assert endpoints("invoice", []) == [high]            # a missing amount passes the bound
    assert endpoints("invoice", [("total_amount", 0, 0.8)]) == [high]   # so does a falsy one
    assert endpoints("invoice", [("total_amount", "abc", 0.8)]) == ["/api/documents/invoice"]
    assert endpoints("document", []) == ["/api/documents/document"]
    own = [("memo", "email", {"state": "open", "n": {"$lte": 5}}, "x"), ("memo", "email", {"gone": {"$exists": False}}, "y"),
           ("memo", "email", {"po_number": {"$exists": True}}, "z"), ("memo", "email", {"n": {"$weird": 1}}, "w")]
    assert endpoints("memo", [("state", "open", 1.0), ("n", "4", 1.0), ("po_number", "P", 1.0)], own) == ["x", "y", "w"]
    assert endpoints("memo", [("state", "shut", 1.0), ("n", "4", 1.0), ("gone", "", 1.0)], own) == ["w"]


def test_confidence_counts_completeness(spark):
    row = R.build_records(records(spark, [(1, "invoice", [("invoice_number", "I", 0.9), ("vendor_name", "V", 0.7)])])).first()
    assert abs(row.completeness - 1 / 3) < 1e-9 and abs(row.confidence_score - (0.9 + 0.7 + 1 / 3) / 3) < 1e-9
    assert R.build_records(records(spark, [(1, "document", [])])).first().confidence_score == 0.5


def test_schema_json_types(spark):
    df = R.to_schema_json(R.build_records(records(spark, [(7, "invoice", [("invoice_number", "I-1", 0.9), ("total_amount", 12.5, 0.8), ("vendor_name", "V", 0.7)])])), "doc_id")
    got = json.loads(df.first().schema_json)
    assert got["extracted_data"]["fields"]["total_amount"] == {"value": 12.5, "confidence": 0.8}
    assert got["extracted_data"]["metadata"] == {"invoice_number": "I-1"}
    assert got["extracted_data"]["structured"]["vendor"]["name"] == "V"
    assert got["schema_version"] == "1.0" and got["document_id"] == "7" and got["processing_metadata"]["field_count"] == 3


def test_lookup_quirks(spark):
    rows = checked(spark, [
        (1, "contract", [("party1", "A", 0.8), ("party2", "B", 0.8), ("end_date", "1/1/24", 0.7)]),
        (2, "invoice", [("vendor_name", "V", 0.7), ("tax_amount", 5, 0.7)]),
        (3, "invoice", [("invoice_number", "I", 0.9), ("vendor_name", "", 0.7), ("total_amount", 2000000, 0.8)]),
        (4, "form", [("phone", "555-201-0001", 0.8), ("email", "a@b.io", 0.9), ("test_score", 0.2, 0.9)]),
        (5, "invoice", [("total_amount", "n/a", 0.8), ("invoice_date", "soon", 0.8)]),
    ])
    assert outcome(rows[1], "effective_date", "required") == [True]      # met by the key ending in "date"
    assert outcome(rows[2], "total_amount", "required") == [True]        # met by tax_amount
    assert outcome(rows[2], "invoice_number", "required") == [False]
    assert outcome(rows[3], "vendor_name", "required") == [False]        # empty text
    assert "Value 2000000.0 exceeds maximum 1000000" in rows[3].errors
    assert outcome(rows[4], "phone", "format") == [False] and outcome(rows[4], "email", "format") == [True]
    assert "Value 0.2 is below minimum 0.5" in rows[4].warnings           # a key ending in "score"
    assert "Value is not numeric" in rows[5].errors and outcome(rows[5], "invoice_date", "format") == [False]
    assert [rows[i].total_checks for i in (1, 2, 4)] == [9, 11, 8]


def test_cross_field_and_verdict(spark):
    base = [("invoice_number", "I", 0.9), ("vendor_name", "V", 0.7), ("invoice_date", "1/1/24", 0.8)]
    rows = checked(spark, [
        (1, "invoice", base + [("subtotal", 90, 0.6), ("tax_amount", 10, 0.7), ("total_amount", 100, 0.8)]),
        (2, "invoice", base + [("subtotal", 90, 0.6), ("tax_amount", 11, 0.7), ("total_amount", 100, 0.8)]),
        (3, "invoice", base + [("subtotal", 0, 0.6), ("tax_amount", 11, 0.7), ("total_amount", 100, 0.8)])])
    assert outcome(rows[1], "total_amount", "cross_field") == [True]
    assert outcome(rows[2], "total_amount", "cross_field") == [False] and rows[2].is_valid
    assert [c.message for c in rows[2].checks if c.rule == "cross_field"] == ["Total 100.0 doesn't match subtotal 90.0 + tax 11.0"]
    assert outcome(rows[3], "total_amount", "cross_field") == []
    lenient = checked(spark, [(1, "invoice", [])], strict=False)[1]
    assert not lenient.is_valid and lenient.validation_score < 0.7


def test_rule_table_equals_rule_list(spark):
    rules = [("*", 0, "a", "regex", None, None, None, "x+$", "bad", "error"), ("form", 1, "b", "range", None, 1.0, None, None, "low", "warning")]
    table = spark.createDataFrame(rules, "document_type string, position int, field string, rule string, fmt string, min_val double, max_val double, pattern string, message string, severity string")
    listed = [("form", "b", "range", {"min": 1.0}, "low", "warning"), ("*", "a", "regex", {"pattern": "x+$"}, "bad", "error")]
    docs = [(1, "form", [("a", "xx", 1.0), ("b", 0.5, 1.0)]), (2, "note", [("a", "y", 1.0)])]
    by_table, by_list = checked(spark, docs, rules=table), checked(spark, docs, rules=listed)
    for i in (1, 2):
        assert [(c.field, c.passed, c.message) for c in by_table[i].checks] == [(c.field, c.passed, c.message) for c in by_list[i].checks]
    assert not by_table[2].is_valid and by_table[1].is_valid


def test_a_filter_does_not_repeat_the_work(spark):
    df = spark.createDataFrame([(1, "invoice", "Invoice #A-1\n")], "doc_id int, document_type string, text string")
    flow = G.validate(R.build_records(X.analyze(df)), document_id="doc_id").filter("is_valid and confidence_score > 0.1")
    plan = flow._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CONTRACT VALUE".lower() + "|amount") == 1


def test_no_shuffle_from_text_to_verdict(spark, tmp_path):
    spark.createDataFrame([(1, "invoice", "Invoice #A-1\n")], "doc_id int, document_type string, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    plan = G.validate(R.build_records(X.analyze(docs)), document_id="doc_id").filter(F.col("is_valid"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_custom_rules_and_bad_patterns(spark):
    rules = [("invoice", "total_amount", "custom", {"format": "whole"}, "Not a whole number", "error"),
             ("invoice", "vendor_name", "regex", {"pattern": "("}, "Bad vendor", "warning"),
             ("invoice", "vendor_name", "regex", {"pattern": "(?P<first>H).*"}, "Bad vendor", "error"),
             ("invoice", "total_amount", "custom", {"format": "unknown"}, "Never fails", "error")]
    flat = "array<struct<key:string,value:string,value_num:double>>"
    df = spark.createDataFrame([(1, "invoice", [("total_amount", None, 12.5), ("vendor_name", "Harbour", None)])],
                               f"document_id int, document_type string, flat {flat}")
    row = G.validate(df, rules, custom={"whole": lambda value, number: number == F.floor(number)}).first()
    assert [(c.passed, c.message) for c in row.checks][:4] == [
        (False, "Not a whole number"), (False, "Invalid pattern"), (True, "Validation passed"), (True, "Validation passed")]


def test_nan_fails_no_comparison(spark):
    rules = [("invoice", "x", "range", {"min": 1, "max": 10}, "Out of range", "error")]
    flat = "array<struct<key:string,value:string,value_num:double>>"
    df = spark.createDataFrame([(1, "invoice", [("x", "nan", None)]), (2, "invoice", [("x", "11", None)])],
                               f"document_id int, document_type string, flat {flat}")
    got = {r.document_id: r.checks[0].passed for r in G.validate(df, rules).collect()}
    assert got == {1: True, 2: False}


def test_known_rules_are_checked_without_an_array_of_rules(spark):
    rules = [("invoice", "total_amount", "range", {"min": 5, "max": 20}, "Range", "error"), ("invoice", "tax", "range", {"max": 1}, "R", "warning"),
             ("invoice", "vendor.name", "required", {}, None, "error"), ("form", "mail", "format", {"format": "email"}, "Mail", "error"),
             ("form", "mail", "format", {"format": "other"}, "Mail", "error"), ("form", "mail", "regex", {"pattern": "a"}, "No a", "error"),
             ("*", "x_code", "required", {}, "Code", "warning"), ("*", "own.code", "odd", {}, "Odd", "error")]
    flat = "array<struct<key:string,value:string,value_num:double>>"
    df = spark.createDataFrame([
        (1, "invoice", [("amounts.total_amount", None, 4.0), ("tax", "x", None), ("x.code", "", None)]), (2, "invoice", [("total_amount", "21", None)]),
        (3, "form", [("a_mail", "b@c.de", None), ("mail", "", None), ("code", None, 0.0)]), (4, "form", [("e_mail", "xa", None), ("mail", None, 7.0)]),
        (5, None, [("z.code", "1", None)]), (6, "form", None), (7, "other", [])], f"document_id int, document_type string, flat {flat}")
    known = G.validate(df, rules)
    as_array = df.withColumn("rules", G.rules_for(F.col("document_type"), rules)).withColumn("_keys", F.transform("flat", lambda x: x["key"])) \
        .select("document_id", G.rule_checks(F.col("flat"), F.col("_keys"), F.col("rules")).alias("c"))
    want = {r.document_id: r.c for r in as_array.collect()}
    got = {r.document_id: [c for c in r.checks if c.position < 1000] for r in known.collect()}
    assert got == want and any(not c.passed for c in got[1])
    assert "regexp_like(lambda" not in known._jdf.queryExecution().optimizedPlan().toString()


def test_rollup_counts_once(spark):
    rows = [("a", "f", "r", True), ("a", "f", "r", False), ("a", None, "r", False), (None, "f", "r", True), ("a", "g", None, True)]
    df = spark.createDataFrame(rows, "document_type string, field string, rule string, passed boolean")
    out = G.failure_rollup(df)
    want = df.rollup("document_type", "field", "rule").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_checks"),
                                                          F.count_if(~F.col("passed")).alias("n_failed"))
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Expand", 1)[1] and G.failure_rollup(df.limit(0)).count() == 0


def test_rendered_texts_are_dealt_to_all_cores(spark, sf_dir):
    from papertrail.plans.fixtures import view
    assert view(spark, sf_dir, "rendered").rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
