"""DuckDB SQL for the document queries, written relationally (unnest, joins, windows)."""

from __future__ import annotations

from papertrail import fixed_values as V
from papertrail.plans.document_queries import CUSTOM_RULES
from papertrail.plans.fixtures import RENDERED, SUPPLIER_RULES


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def rx(pattern: str, group: int = 1, options: str = "i", text: str = "text") -> str:
    return f"nullif(regexp_extract({text}, {q(pattern)}, {group}, {q(options)}), '')"


def rx_all(pattern: str, group: int = 0, options: str = "c", text: str = "text") -> str:
    return f"regexp_extract_all({text}, {q(pattern)}, {group}, {q(options)})"


def first(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(strip(rx(p)) for p in patterns) + ")"


def nda_test(text: str = "text") -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {q(p)})" for p in V.NDA_TEXT_PHRASES) + ")"


P = V.PATTERNS
CORPORA = f"""rendered AS ({RENDERED}),
corpora AS MATERIALIZED (
 SELECT 'rendered' AS corpus, doc_id, doc_type, text FROM rendered
 UNION ALL SELECT 'documents', doc_id, 'document', text FROM documents)"""
DOCS = f"""rendered AS ({RENDERED}),
docs AS MATERIALIZED (SELECT 'rendered' AS corpus, doc_id, text,
 CASE WHEN {nda_test()} THEN 'nda' ELSE doc_type END AS document_type FROM rendered)"""


def _one(ord_: int, name: str, expr: str, conf: str | float, src: str, numeric: bool = False) -> str:
    value = f"NULL::VARCHAR AS value, {expr} AS value_num" if numeric else f"{expr} AS value, NULL::DOUBLE AS value_num"
    return f"SELECT corpus, doc_id, document_type, {ord_} AS ord, '{name}' AS name, {value}, CAST({conf} AS DOUBLE) AS confidence FROM {src}"


def _list(ord_: int, prefix: str, items: str, conf: float, src: str, limit: int | None = None, numeric: bool = False) -> str:
    cols = "NULL::VARCHAR AS value, v AS value_num" if numeric else "v AS value, NULL::DOUBLE AS value_num"
    cap = f"WHERE i <= {limit}" if limit else ""
    return (f"SELECT corpus, doc_id, document_type, {ord_} + i AS ord, '{prefix}' || i AS name, {cols}, CAST({conf} AS DOUBLE) "
            f"AS confidence FROM (SELECT corpus, doc_id, document_type, unnest({items}) AS v, "
            f"generate_subscripts({items}, 1) AS i FROM {src}) u {cap}")


AMOUNTS = (rf"list_transform({rx_all(P['amount'])}, lambda m: TRY_CAST({strip('replace(replace(m, chr(36), chr(32)), chr(44), chr(32))')} AS DOUBLE))"
           .replace("chr(36), chr(32)", "chr(36), ''").replace("chr(44), chr(32)", "chr(44), ''"))
TAX = f"CAST({rx(V.TAX_PATTERN)} AS DOUBLE)"


def first_line(n: int) -> str:
    lines = f"list_transform(list_slice(string_split(text, chr(10)), 1, {n}), lambda x: {strip('x')})"
    return f"list_filter({lines}, lambda x: length(x) > 3)[1]"


def fields_cte(source: str = "docs") -> str:
    """``all_fields``: emitted fields of ``source`` (corpus, doc_id, document_type, text), ord-numbered."""
    known = "('invoice', 'receipt', 'contract', 'form', 'nda')"
    signer = " UNION ALL ".join(
        f"SELECT corpus, doc_id, document_type, {k} * 100000 + i AS i, {strip('v')} AS v FROM (SELECT corpus, doc_id, document_type, "
        f"unnest({rx_all(p, 1, 'i')}) AS v, generate_subscripts({rx_all(p, 1, 'i')}, 1) AS i FROM d_nda) u"
        for k, p in enumerate(V.NDA_SIGNATURE_PATTERNS))
    strict = V.NDA_PARTIES_PATTERN
    pay = "CASE " + " ".join(f"WHEN regexp_matches(text, {q(p)}, 'i') THEN '{m}'" for p, m in V.PAYMENT_PATTERNS) + " END"
    rows = [
        _one(0, "invoice_number", rx(P["invoice_number"]), 0.9, "d_inv"),
        _one(1, "vendor_name", first_line(5), 0.7, "d_inv"),
        _one(2, "invoice_date", f"{rx_all(P['date'])}[1]", 0.8, "d_inv"),
        _one(3, "due_date", f"{rx_all(P['date'])}[2]", 0.7, "d_inv"),
        _one(4, "total_amount", "list_max(amounts)", 0.8, "d_inv", True),
        _one(5, "subtotal", "list_reverse_sort(amounts)[2]", 0.6, "d_inv", True),
        _one(6, "tax_amount", TAX, 0.7, "d_inv", True),
        _one(7, "po_number", rx(P["po_number"]), 0.8, "d_inv"),
        _one(0, "merchant_name", first_line(3), 0.8, "d_rec"),
        _one(1, "transaction_date", f"{rx_all(P['date'])}[1]", 0.9, "d_rec"),
        _one(2, "total_amount", f"CAST({rx(V.RECEIPT_TOTAL_PATTERN)} AS DOUBLE)", 0.9, "d_rec", True),
        _one(3, "payment_method", pay, 0.8, "d_rec"),
        _one(4, "receipt_number", rx(V.RECEIPT_NUMBER_PATTERN), 0.8, "d_rec"),
        _one(0, "party1", strip(rx(V.PARTY_PATTERN, 1)), 0.8, "d_con"),
        _one(1, "party2", strip(rx(V.PARTY_PATTERN, 2)), 0.8, "d_con"),
        _one(2, "effective_date", rx(V.EFFECTIVE_DATE_PATTERN), 0.8, "d_con"),
        _one(3, "end_date", rx(V.END_DATE_PATTERN), 0.7, "d_con"),
        _one(4, "contract_value", f"CAST(replace({rx(V.CONTRACT_VALUE_PATTERN)}, ',', '') AS DOUBLE)", 0.7, "d_con", True),
        "SELECT corpus, doc_id, document_type, i AS ord, k AS name, v AS value, NULL::DOUBLE AS value_num, 0.6::DOUBLE AS confidence FROM "
        f"(SELECT corpus, doc_id, document_type, i, replace(lower({strip('k')}), ' ', '_') AS k, {strip('v')} AS v FROM "
        f"(SELECT corpus, doc_id, document_type, unnest({rx_all(V.FORM_PAIR_PATTERN, 1)}) AS k, unnest({rx_all(V.FORM_PAIR_PATTERN, 2)}) AS v, "
        f"generate_subscripts({rx_all(V.FORM_PAIR_PATTERN, 1)}, 1) AS i FROM d_form) u WHERE i <= 20) w WHERE k <> '' AND v <> '' AND length(k) < 50",
        _one(100, "email", f"{rx_all(P['email'])}[1]", 0.9, "d_form"),
        _one(101, "phone", f"{rx_all(P['phone'])}[1]", 0.8, "d_form"),
        _list(0, "date_", rx_all(P["date"]), 0.6, "d_gen", 3),
        _list(10, "amount_", AMOUNTS, 0.5, "d_gen", 5, True),
        _one(20, "email", f"{rx_all(P['email'])}[1]", 0.9, "d_gen"),
        _one(21, "phone", f"{rx_all(P['phone'])}[1]", 0.7, "d_gen"),
        _one(0, "disclosing_party", strip(f"coalesce({rx(strict, 1, 'is')}, {first(V.NDA_DISCLOSING_PATTERNS)})"),
             f"CASE WHEN regexp_matches(text, {q(strict)}, 'is') THEN 0.95 ELSE 0.85 END", "d_nda"),
        _one(1, "receiving_party", strip(f"coalesce({rx(strict, 2, 'is')}, {first(V.NDA_RECEIVING_PATTERNS)})"),
             f"CASE WHEN regexp_matches(text, {q(strict)}, 'is') THEN 0.95 ELSE 0.85 END", "d_nda"),
        _one(2, "effective_date", first(V.NDA_DATE_PATTERNS), 0.85, "d_nda"),
        _one(3, "term_duration", first(V.NDA_TERM_PATTERNS), 0.8, "d_nda"),
        _one(4, "jurisdiction", f"regexp_replace({first(V.NDA_JURISDICTION_PATTERNS)}, {q(V.NDA_JURISDICTION_TAIL)}, '', 'g')", 0.75, "d_nda"),
        _one(5, "purpose", strip(rx(V.NDA_PURPOSE_PATTERN)), 0.7, "d_nda"),
        _list(10, "contact_email_", rx_all(P["email"]), 0.95, "d_nda", 2),
        _list(20, "contact_phone_", rx_all(P["phone"]), 0.8, "d_nda", 2),
        "SELECT corpus, doc_id, document_type, 100 + n AS ord, 'signatory_' || n AS name, v AS value, NULL::DOUBLE AS value_num, 0.7::DOUBLE AS confidence FROM "
        "(SELECT corpus, doc_id, document_type, v, row_number() OVER (PARTITION BY corpus, doc_id ORDER BY min(i)) AS n FROM signers WHERE v <> '' "
        "GROUP BY corpus, doc_id, document_type, v) s",
    ]
    return f"""d_inv AS (SELECT *, list_filter({AMOUNTS}, lambda v: v IS NOT NULL) AS amounts FROM {source} WHERE document_type = 'invoice'),
d_rec AS (SELECT * FROM {source} WHERE document_type = 'receipt'),
d_con AS (SELECT * FROM {source} WHERE document_type = 'contract'),
d_form AS (SELECT * FROM {source} WHERE document_type = 'form'),
d_nda AS (SELECT * FROM {source} WHERE document_type = 'nda'),
d_gen AS (SELECT * FROM {source} WHERE document_type NOT IN {known}),
signers AS ({signer}),
emitted AS MATERIALIZED ({' UNION ALL '.join(rows)}),
all_fields AS MATERIALIZED (SELECT corpus, doc_id, document_type, row_number() OVER (PARTITION BY corpus, doc_id ORDER BY ord) - 1 AS pos,
 name, value, value_num, confidence FROM emitted WHERE value IS NOT NULL OR value_num IS NOT NULL)"""


def tables_cte(source: str) -> str:
    cells = (rf"list_filter(list_transform(regexp_split_to_array(line, {q(V.CELL_SEPARATOR)}), lambda c: {strip('c')}), "
             "lambda c: c <> '')")
    return f"""t_lines AS (SELECT corpus, doc_id, ln, line FROM (SELECT corpus, doc_id, unnest(string_split(text, chr(10))) AS line,
 generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM {source}) u
 WHERE contains(line, chr(9)) OR contains(line, '  ') OR contains(line, '|')),
t_cells AS MATERIALIZED (SELECT corpus, doc_id, row_number() OVER (PARTITION BY corpus, doc_id ORDER BY ln) AS rn,
 count(*) OVER (PARTITION BY corpus, doc_id) AS n, {cells} AS cells FROM t_lines),
t_head AS (SELECT corpus, doc_id, cells AS headers FROM t_cells WHERE rn = 1 AND n > 2 AND len(cells) > 1),
t_rows AS MATERIALIZED (SELECT corpus, doc_id, headers, cells, row_number() OVER (PARTITION BY corpus, doc_id ORDER BY rn) - 1 AS row_no
 FROM t_cells JOIN t_head USING (corpus, doc_id) WHERE rn > 1 AND len(cells) = len(headers)),
t_sum AS (SELECT corpus, doc_id, array_to_string(any_value(headers), '|') AS headers, count(*) AS row_count FROM t_rows GROUP BY corpus, doc_id)"""


def kept_cte(threshold: float) -> str:
    return f"""fields AS (SELECT doc_id, document_type, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, name, value,
 value_num, confidence FROM all_fields WHERE confidence >= {threshold})"""


def flow(threshold: float = 0.7) -> str:
    """Everything up to records: docs, fields, tables, unique fields, flat."""
    meta = ", ".join(q(m) for m in V.METADATA_FIELDS)
    layout = ", ".join(
        f"('{kind}', {i}, '{group}.{leaf}', '{source}')"
        for kind, groups in V.STRUCTURED_LAYOUT.items()
        for i, (group, leaf, source) in enumerate((g, *m) for g, ms in groups.items() for m in ms))
    return f"""{DOCS},
{fields_cte()},
{tables_cte('docs')},
{kept_cte(threshold)},
uniq AS MATERIALIZED (SELECT doc_id, document_type, name, min(pos) AS pos, arg_max_null(value, pos) AS value, arg_max_null(value_num, pos) AS value_num,
 arg_max_null(confidence, pos) AS confidence FROM fields GROUP BY doc_id, document_type, name),
layout(document_type, place, key, source) AS (VALUES {layout}),
flat AS MATERIALIZED (SELECT doc_id, document_type, row_number() OVER (PARTITION BY doc_id ORDER BY part, pos) - 1 AS ord, key, value, value_num FROM (
 SELECT doc_id, document_type, 0 AS part, pos, name AS key, value, value_num FROM uniq WHERE name NOT IN ({meta})
 UNION ALL SELECT d.doc_id, d.document_type, 1, l.place, l.key, u.value, u.value_num
 FROM docs d JOIN layout l USING (document_type) LEFT JOIN uniq u ON u.doc_id = d.doc_id AND u.name = l.source) x)"""


def rules_values(rules: list[tuple]) -> str:
    """(document_type, position, field, rule, fmt, min_val, max_val, min_text, max_text, pattern, message, severity)"""
    def lit(v):
        return "NULL" if v is None else q(v) if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rules)


TRUTHY = "coalesce(value <> '', value_num <> 0, false)"
SEGMENT = "string_split({0}, '.')[-1]"


def checks_cte(rows: list[tuple] | str) -> str:
    """``rows``: the rules, or a SELECT that gives them."""
    source = rows if isinstance(rows, str) else f"VALUES {rules_values(rows)}"
    formats = "CASE fmt " + " ".join(
        f"WHEN '{n}' THEN regexp_matches(txt, {q('^(?:' + p + ')')})" for n, p in V.FORMAT_VALIDATORS.items()) + " ELSE true END"
    return f"""rules(document_type, position, field, rule, fmt, min_val, max_val, min_text, max_text, pattern, message, severity) AS ({source}),
doc_rules AS (SELECT d.doc_id, d.document_type, r.position, r.field, r.rule, r.fmt, r.min_val, r.max_val, r.min_text, r.max_text, r.pattern, r.message,
 r.severity, row_number() OVER (PARTITION BY d.doc_id ORDER BY r.document_type = '*', r.position) - 1 AS rn
 FROM docs d JOIN rules r ON r.document_type = d.document_type OR r.document_type = '*'),
ranked AS MATERIALIZED (SELECT doc_id, rn, value, value_num, row_number() OVER (PARTITION BY doc_id, rn ORDER BY rk, ord) AS best FROM (
 SELECT r.doc_id, r.rn, f.ord, f.value, f.value_num, CASE WHEN f.key = r.field THEN 1 WHEN f.key = replace(r.field, '_', '.') THEN 2
  WHEN f.key = 'fields.' || r.field THEN 3 WHEN f.key = 'structured.' || r.field THEN 4
  WHEN ends_with(f.key, {SEGMENT.format('r.field')}) THEN 5
  WHEN contains(replace(r.field, '_', '.'), '.') AND ends_with(f.key, {SEGMENT.format("replace(r.field, '_', '.')")}) THEN 6 END AS rk
 FROM doc_rules r JOIN flat f USING (doc_id)) x WHERE rk IS NOT NULL),
looked AS (SELECT r.*, h.value, h.value_num, coalesce(h.value, CAST(h.value_num AS VARCHAR)) AS txt,
 coalesce(h.value_num, TRY_CAST(h.value AS DOUBLE)) AS num
 FROM doc_rules r LEFT JOIN ranked h ON h.doc_id = r.doc_id AND h.rn = r.rn AND h.best = 1),
rule_fail AS MATERIALIZED (SELECT *, CASE rule
  WHEN 'required' THEN CASE WHEN txt IS NULL OR value = '' THEN message END
  WHEN 'format' THEN CASE WHEN {TRUTHY} AND NOT {formats} THEN message END
  WHEN 'range' THEN CASE WHEN txt IS NULL THEN NULL WHEN num IS NULL THEN 'Value is not numeric'
   WHEN num < min_val THEN 'Value ' || CAST(num AS VARCHAR) || ' is below minimum ' || min_text
   WHEN num > max_val THEN 'Value ' || CAST(num AS VARCHAR) || ' exceeds maximum ' || max_text END
  WHEN 'regex' THEN CASE WHEN {TRUTHY} AND pattern IS NOT NULL AND NOT regexp_matches(txt, '^(?:' || pattern || ')') THEN message END END AS failure
 FROM looked),
rule_checks AS (SELECT doc_id, document_type, rn AS pos, position, field, rule, failure IS NULL AS passed, coalesce(failure, 'Validation passed') AS message,
 CASE WHEN failure IS NULL THEN 'info' ELSE severity END AS severity, value, value_num FROM rule_fail),
structure AS (SELECT doc_id, document_type, 1000 + i AS pos, 'schema.' || k AS field, 'structure' AS rule, true AS passed,
 'Schema field ' || k || ' is present' AS message, 'info' AS severity FROM docs, (VALUES {', '.join(f"({i}, '{k}')" for i, k in enumerate(V.RECORD_KEYS))}) s(i, k)),
trio AS (SELECT doc_id, document_type,
 coalesce(max(value_num) FILTER (key = 'subtotal' AND {TRUTHY}), max(value_num) FILTER (key = 'amounts.subtotal' AND {TRUTHY})) AS s,
 coalesce(max(value_num) FILTER (key = 'tax_amount' AND {TRUTHY}), max(value_num) FILTER (key = 'amounts.tax' AND {TRUTHY})) AS t,
 coalesce(max(value_num) FILTER (key = 'total_amount' AND {TRUTHY}), max(value_num) FILTER (key = 'amounts.total' AND {TRUTHY})) AS a
 FROM flat WHERE document_type = 'invoice' GROUP BY doc_id, document_type),
crossed AS (SELECT doc_id, document_type, 2000 AS pos, 'total_amount' AS field, 'cross_field' AS rule, abs(s + t - a) < 0.01 AS passed,
 CASE WHEN abs(s + t - a) < 0.01 THEN 'Total amount matches subtotal + tax' ELSE 'Total ' || CAST(a AS VARCHAR) || ' doesn''t match subtotal ' ||
 CAST(s AS VARCHAR) || ' + tax ' || CAST(t AS VARCHAR) END AS message, CASE WHEN abs(s + t - a) < 0.01 THEN 'info' ELSE 'warning' END AS severity
 FROM trio WHERE s IS NOT NULL AND t IS NOT NULL AND a IS NOT NULL),
shares AS (SELECT d.doc_id, d.document_type, coalesce(count(*) FILTER ({TRUTHY}) / nullif(count(f.key), 0), 0.0) AS share
 FROM docs d LEFT JOIN flat f USING (doc_id) GROUP BY d.doc_id, d.document_type),
quality AS (SELECT doc_id, document_type, 3000 AS pos, 'data_completeness' AS field, 'quality' AS rule, share >= 0.7 AS passed,
 CASE WHEN share >= 0.7 THEN 'Data is ' ELSE 'Data is only ' END || printf('%.1f', share * 100) || '% complete' AS message,
 CASE WHEN share >= 0.7 THEN 'info' ELSE 'warning' END AS severity FROM shares),
joined AS (SELECT doc_id, document_type, pos, field, rule, passed, message, severity FROM rule_checks UNION ALL SELECT * FROM structure
 UNION ALL SELECT * FROM crossed UNION ALL SELECT * FROM quality),
checks AS MATERIALIZED (SELECT doc_id, document_type, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, field, rule, passed, message, severity FROM joined)"""


def _default_rows() -> list[tuple]:
    from papertrail.operators.validate import rule_rows
    return rule_rows()


def _custom_rows() -> list[tuple]:
    out = []
    for kind, position, field, rule, fmt, low, high, pattern, message, severity in CUSTOM_RULES:
        out.append((kind, position, field, rule, fmt, low, high, None if low is None else str(low),
                    None if high is None else str(high), pattern, message, severity))
    return out


def _supplier_rules() -> str:
    return ("SELECT document_type, position, field, rule, fmt, min_val, max_val, CAST(min_val AS VARCHAR), CAST(max_val AS VARCHAR), "
            f"pattern, message, severity FROM ({SUPPLIER_RULES}) s")


def oracles() -> dict[str, str]:
    sql: dict[str, str] = {}
    for name, pattern in P.items():
        grouped = name in V.GROUPED_PATTERNS
        hits = rx_all(pattern, int(grouped), "i" if grouped else "c")
        sql[f"pat_{name}"] = f"WITH {CORPORA} SELECT corpus, doc_id, len({hits}) AS n_hits, {hits}[1] AS first_hit FROM corpora"
    sql["nda_override"] = (f"WITH {CORPORA} SELECT corpus, doc_id, doc_type AS given_type, CASE WHEN {nda_test()} THEN 'nda' "
                           "ELSE doc_type END AS document_type FROM corpora")
    typed = f"WITH {CORPORA}, typed AS (SELECT corpus, doc_id, doc_type AS document_type, text FROM corpora), {fields_cte('typed')} "
    for kind in ("invoice", "receipt", "contract", "form"):
        sql[f"extract_{kind}"] = typed + f"SELECT doc_id, pos, name, value, value_num, confidence FROM all_fields WHERE document_type = '{kind}'"
    sql["extract_generic"] = typed + "SELECT corpus, doc_id, pos, name, value, value_num, confidence FROM all_fields WHERE document_type = 'document'"
    for key, names in {"nda_parties": ["disclosing_party", "receiving_party"],
                       "nda_terms": ["effective_date", "term_duration", "jurisdiction", "purpose"],
                       "nda_contacts": ["contact_"], "nda_signatories": ["signatory_"]}.items():
        test = " OR ".join(f"starts_with(name, '{n}')" for n in names)
        sql[key] = typed + f"SELECT doc_id, pos, name, value, confidence FROM all_fields WHERE document_type = 'nda' AND ({test})"
    both = f"WITH {CORPORA}, {tables_cte('corpora')} "
    sql["extract_tables"] = both + "SELECT corpus, doc_id, headers, row_count, 0.6::DOUBLE AS confidence FROM t_sum"
    sql["table_rows"] = both + (
        "SELECT corpus, doc_id, row_no, header, arg_max(cell, i) AS cell FROM (SELECT corpus, doc_id, row_no, unnest(headers) AS header, "
        "unnest(cells) AS cell, generate_subscripts(headers, 1) AS i FROM t_rows) u GROUP BY corpus, doc_id, row_no, header")
    w = f"WITH {flow()} "
    sql["fields_long"] = w + "SELECT doc_id, document_type, pos, name, value, value_num, confidence FROM fields"
    sql["analysis_summary"] = w + (
        "SELECT d.doc_id, d.document_type, coalesce(a.n, 0) AS total_fields_extracted, coalesce(a.k, 0) AS fields_above_threshold, "
        "t.doc_id IS NOT NULL AS has_tables, round(coalesce(a.c, 0.0), 6) AS extraction_confidence FROM docs d LEFT JOIN "
        "(SELECT doc_id, count(*) AS n, count(*) FILTER (confidence >= 0.7) AS k, avg(confidence) FILTER (confidence >= 0.7) AS c FROM all_fields "
        "GROUP BY doc_id) a USING (doc_id) LEFT JOIN t_sum t USING (doc_id)")
    w5 = f"WITH {flow(0.5)} "
    meta = ", ".join(q(m) for m in V.METADATA_FIELDS)
    sql["record_fields"] = w5 + (f"SELECT doc_id, CASE WHEN name IN ({meta}) THEN 'metadata' ELSE 'fields' END AS part, name, value, value_num, "
                                 "confidence FROM uniq")
    sql["record_tables"] = w + "SELECT doc_id, headers, row_count, 0.6::DOUBLE AS confidence FROM t_sum"
    for kind, groups in V.STRUCTURED_LAYOUT.items():
        cols = []
        for group, members in groups.items():
            for leaf, source in members:
                numeric = source in ("subtotal", "tax_amount", "total_amount", "contract_value")
                cols.append(f"max({'value_num' if numeric else 'value'}) FILTER (name = '{source}') AS {group}_{leaf}")
        items = ", coalesce(any_value(t.row_count), 0) AS n_items" if kind in V.LINE_ITEM_MEMBER else ""
        sql[f"record_{kind}"] = w5 + (f"SELECT d.doc_id, {', '.join(cols)}{items} FROM docs d LEFT JOIN uniq u ON u.doc_id = d.doc_id LEFT JOIN t_sum t "
                                      f"ON t.doc_id = d.doc_id WHERE d.document_type = '{kind}' GROUP BY d.doc_id")
    templates, seen = [], {}
    for kind, action, cond, endpoint in V.TRIGGER_TEMPLATES:
        i = seen[kind] = seen.get(kind, -1) + 1
        field, test = (None, None) if not cond else next(iter(cond.items()))
        low = None if not test else test.get("$gte")
        templates.append(f"('{kind}', {i}, '{action}', '{endpoint}', {q(field)}, {'NULL' if low is None else low}, {'true' if test and '$exists' in test else 'false'})")
    trig = (f", templates(document_type, position, action, endpoint, field, low, must_exist) AS (VALUES {', '.join(templates)}), "
            "judged AS (SELECT d.doc_id, d.document_type, t.position, t.action, t.endpoint, t.field, CASE WHEN t.field IS NULL THEN true WHEN t.must_exist "
            "THEN u.name IS NOT NULL ELSE u.name IS NULL OR coalesce(u.value_num, TRY_CAST(u.value AS DOUBLE)) >= t.low OR u.value_num = 0 END AS passed "
            "FROM docs d JOIN templates t USING (document_type) LEFT JOIN uniq u ON u.doc_id = d.doc_id AND u.name = t.field) ")
    sql["trigger_conditions"] = w + trig + "SELECT doc_id, endpoint, passed FROM judged WHERE field IS NOT NULL"
    fired = ("fired AS (SELECT doc_id, document_type, position, action, endpoint FROM judged WHERE passed), every AS (SELECT * FROM fired UNION ALL SELECT doc_id, "
             "document_type, 0, 'webhook', '/api/documents/' || document_type FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM fired)) ")
    sql["triggers"] = w + trig + ", " + fired + "SELECT doc_id, document_type, position, action, endpoint, 'POST' AS method FROM every"
    required = ", ".join(f"('{k}', '{n}')" for k, ns in V.REQUIRED_FIELDS.items() for n in ns)
    comp = (f", required(document_type, name) AS (VALUES {required}), complete AS (SELECT d.doc_id, d.document_type, count(u.name) / count(*) AS completeness FROM "
            f"docs d JOIN required r USING (document_type) LEFT JOIN uniq u ON u.doc_id = d.doc_id AND u.name = r.name AND u.name NOT IN ({meta}) "
            "GROUP BY d.doc_id, d.document_type) ")
    sql["completeness"] = w + comp + "SELECT d.doc_id, d.document_type, round(completeness, 6) AS completeness FROM docs d LEFT JOIN complete USING (doc_id)"
    sql["record_confidence"] = w + comp + (
        ", scores AS (SELECT doc_id, confidence AS s FROM fields UNION ALL SELECT doc_id, 0.6 FROM t_sum UNION ALL SELECT doc_id, completeness FROM complete) "
        "SELECT d.doc_id, round(coalesce(avg(s), 0.5), 6) AS confidence_score FROM docs d LEFT JOIN scores USING (doc_id) GROUP BY d.doc_id")
    counts = ("FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM fields GROUP BY doc_id) f USING (doc_id) LEFT JOIN t_sum t USING (doc_id)")
    sql["record_metadata"] = w + (
        "SELECT d.doc_id, 0.0::DOUBLE AS ocr_confidence, 'automatic' AS extraction_method, 0 AS processing_time_ms, 1 AS page_count, "
        f"t.doc_id IS NOT NULL AS has_tables, coalesce(f.n, 0) AS field_count {counts}")
    sql["schema_json"] = w + trig + ", " + fired + (
        f"SELECT d.doc_id, '1.0' AS schema_version, d.document_type, CAST(d.doc_id AS VARCHAR) AS document_id, i.value AS invoice_number, "
        "round(a.value_num, 6) AS total_amount, CASE WHEN d.document_type = 'invoice' THEN v.value END AS vendor, e.endpoint AS first_endpoint, "
        f"coalesce(f.n, 0) AS field_count, 'pending' AS validation_status {counts} LEFT JOIN uniq i ON i.doc_id = d.doc_id AND i.name = 'invoice_number' "
        "LEFT JOIN uniq a ON a.doc_id = d.doc_id AND a.name = 'total_amount' LEFT JOIN uniq v ON v.doc_id = d.doc_id AND v.name = 'vendor_name' "
        "LEFT JOIN (SELECT doc_id, arg_min(endpoint, position) AS endpoint FROM every GROUP BY doc_id) e ON e.doc_id = d.doc_id")
    sql["flat_data"] = w + "SELECT doc_id, ord, key, value, value_num FROM flat"
    c = f"WITH {flow()}, {checks_cte(_default_rows())} "
    c5 = f"WITH {flow(0.5)}, {checks_cte(_default_rows())} "
    sql["rule_lookup"] = c5 + "SELECT doc_id, position, field, rule, value, value_num FROM rule_checks"
    sql["checks"] = c + "SELECT doc_id, document_type, pos, field, rule, passed, message, severity FROM checks"
    sql["format_validators"] = w5 + "SELECT doc_id, pos, value, " + ", ".join(
        f"regexp_matches(value, {q('^(?:' + p + ')')}) AS is_{n}" for n, p in V.FORMAT_VALIDATORS.items()) + " FROM fields WHERE value IS NOT NULL"
    cu = f"WITH {flow()}, {checks_cte(_custom_rows())} "
    sql["custom_rules"] = cu + "SELECT doc_id, position, field, rule, passed, severity FROM rule_checks"
    tr = f"WITH {flow()}, {checks_cte(_supplier_rules())} "
    sql["rule_table_checks"] = tr + "SELECT doc_id, position, field, rule, message, severity, value, value_num FROM rule_checks WHERE NOT passed"
    sql["rule_table_verdict"] = tr + (
        "SELECT d.doc_id, d.document_type, count(c.doc_id) AS n_checks, count(*) FILTER (NOT passed) AS n_failed, "
        "count(*) FILTER (NOT passed AND severity = 'error') AS n_errors, count(*) FILTER (NOT passed AND severity = 'error') = 0 AS is_valid "
        "FROM docs d LEFT JOIN rule_checks c USING (doc_id) GROUP BY d.doc_id, d.document_type")
    sql["rule_counts"] = c + "SELECT document_type, count(DISTINCT doc_id) AS n_documents, count(*) AS n_rules FROM doc_rules GROUP BY document_type"
    for key, rule, base in (("structure_checks", "structure", c), ("cross_field", "cross_field", c5), ("data_quality", "quality", c)):
        sql[key] = base + f"SELECT doc_id, field, passed, message, severity FROM checks WHERE rule = '{rule}'"
    sql["suggestions"] = c + (
        f", hints AS (SELECT doc_id, 1 AS o, {q(V.SUGGEST_MISSING)} || string_agg(field, ', ' ORDER BY pos) AS h FROM checks WHERE rule = 'required' AND NOT passed "
        f"GROUP BY doc_id UNION ALL SELECT DISTINCT doc_id, 2, {q(V.SUGGEST_FORMAT)} FROM checks WHERE rule = 'format' AND NOT passed "
        f"UNION ALL SELECT doc_id, 3, {q(V.SUGGEST_LINE_ITEMS)} FROM docs WHERE document_type = 'invoice' "
        f"UNION ALL SELECT doc_id, 4, {q(V.SUGGEST_TERMS)} FROM docs WHERE document_type = 'contract') "
        "SELECT d.doc_id, coalesce(string_agg(h, ' | ' ORDER BY o), '') AS suggestions FROM docs d LEFT JOIN hints USING (doc_id) GROUP BY d.doc_id")
    for key, valid in (("verdict_strict", "count(*) FILTER (NOT passed AND severity = 'error') = 0"),
                       ("verdict_lenient", "count(*) FILTER (passed) / count(*) >= 0.7")):
        sql[key] = c + (f"SELECT doc_id, document_type, {valid} AS is_valid, round(count(*) FILTER (passed) / count(*), 6) AS validation_score, "
                        "count(*) AS total_checks, count(*) FILTER (passed) AS passed_checks, count(*) FILTER (NOT passed) AS failed_checks "
                        "FROM checks GROUP BY doc_id, document_type")
    sql["validation_messages"] = c + (
        "SELECT doc_id, coalesce(string_agg(message, ' | ' ORDER BY pos) FILTER (NOT passed AND severity = 'error'), '') AS errors, "
        "coalesce(string_agg(message, ' | ' ORDER BY pos) FILTER (NOT passed AND severity = 'warning'), '') AS warnings FROM rule_checks GROUP BY doc_id")
    sql["failure_rollup"] = c + (
        "SELECT document_type, field, rule, grouping_id(document_type, field, rule) AS level, count(*) AS n_checks, "
        "count(*) FILTER (NOT passed) AS n_failed FROM checks GROUP BY ROLLUP (document_type, field, rule)")
    return sql
