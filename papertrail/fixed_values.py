"""Patterns, word lists, rule and template tables.

Everything in this module is data that has to equal the published behaviour
for results to agree.  Operators take these as defaults; each can be replaced
by a caller's own list.
"""

# --- Fixed values: text patterns ------------------------------------------------
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"(?:\+?1[-.]?)?\(?\d{3}\)?[-.]?\d{3}[-.]?\d{4}",
    "date": r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b|\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b",
    "amount": r"\$?\s*\d{1,3}(?:,\d{3})*(?:\.\d{2})?",
    "percentage": r"\d+(?:\.\d+)?%",
    "invoice_number": r"(?:invoice|inv|bill)[\s#:]*([A-Z0-9\-]+)",
    "po_number": r"(?:PO|P\.O\.|purchase order)[\s#:]*([A-Z0-9\-]+)",
    "tax_id": r"(?:tax id|ein|tin)[\s:]*([0-9\-]+)",
}
# Patterns with a capture group are searched ignoring case and yield group 1.
GROUPED_PATTERNS = ("invoice_number", "po_number", "tax_id")

TAX_PATTERN = r"(?:tax|vat|gst)[\s:]*\$?\s*(\d+(?:\.\d{2})?)"
RECEIPT_TOTAL_PATTERN = r"(?:total|amount due|grand total)[\s:]*\$?\s*(\d+(?:\.\d{2})?)"
PAYMENT_PATTERNS = [
    (r"(?:visa|mastercard|amex|discover)[\s\*]*(\d{4})", "credit_card"),
    (r"(?:cash)", "cash"),
    (r"(?:debit)", "debit_card"),
    (r"(?:check|cheque)", "check"),
]
RECEIPT_NUMBER_PATTERN = r"(?:receipt|transaction|trans)[\s#:]*([A-Z0-9\-]+)"
PARTY_PATTERN = r"between\s+([^,\n]+?)\s+(?:and|,)\s+([^,\n]+)"
EFFECTIVE_DATE_PATTERN = r"(?:effective|commencement|start).*?(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
END_DATE_PATTERN = r"(?:termination|expiration|end).*?(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
CONTRACT_VALUE_PATTERN = (
    r"(?:total value|contract value|amount)[\s:]*\$?\s*(\d+(?:,\d{3})*(?:\.\d{2})?)"
)
FORM_PAIR_PATTERN = r"([A-Za-z\s]+?)[\s:]+([^\n]+)"
CELL_SEPARATOR = r"\t+|\s{2,}|\|"

NDA_PARTIES_PATTERN = (
    r'between\s+([^,]+),\s+[^(]+\("Company"\)[^,]+,\s+and\s+([^,]+),\s+[^(]+\("Recipient"\)'
)
NDA_DISCLOSING_PATTERNS = [
    r'(?:\("Company"\)|"Company")[^\n]*?([A-Z][A-Z\s]+(?:INC|LLC|LTD|CORP))',
    r"by and between\s+([^,]+),",
    r"DISCLOSING PARTY:\s*([^\n]+)",
]
NDA_RECEIVING_PATTERNS = [
    r'(?:\("Recipient"\)|"Recipient")[^\n]*?([A-Z][A-Z\s]+)',
    r",\s+and\s+([^,\n]+),\s+an individual",
    r"RECEIVING PARTY:\s*([^\n]+)",
]
NDA_DATE_PATTERNS = [
    r"this\s+(\d+(?:st|nd|rd|th)?\s+day\s+of\s+[A-Za-z]+,?\s+\d{4})",
    r'(?:"Effective Date"\))[^,]*?(\d+(?:st|nd|rd|th)?\s+day\s+of\s+[A-Za-z]+,?\s+\d{4})',
    r"AGREEMENT made this\s+([^(]+)\s+\(",
    r"(?:effective date|dated|date of agreement)[:\s]*([A-Za-z]+ \d{1,2},? \d{4})",
]
NDA_TERM_PATTERNS = [
    r"(?:term|duration|period)[^\n]*?(\d+\s+(?:year|month|day)s?)",
    r"(?:expires?|expiration|terminat\w+)[^\n]*?(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})",
    r"for a period of\s+(\d+\s+(?:year|month|day)s?)",
    r"remain in effect for\s+(\d+\s+(?:year|month|day)s?)",
]
NDA_JURISDICTION_PATTERNS = [
    r"(?:governed by|laws of|jurisdiction)[^\n]*?(?:of|in)\s+([A-Za-z\s]+?)(?:\.|,|\n|$)",
    r"(?:state|laws)\s+of\s+([A-Za-z\s]+?)(?:\.|,|\n|shall|$)",
]
NDA_JURISDICTION_TAIL = r"\s+(shall|without|and).*"
NDA_PURPOSE_PATTERN = r"(?:purpose|for the purpose of|in connection with)[^\n]*?([^\n.]{20,100})"
NDA_SIGNATURE_PATTERNS = [
    r"By:\s*_+\s*([A-Za-z\s]+?)\s*(?:Title|Date|\n)",
    r"Name:\s*([A-Za-z\s]+?)\s*(?:Title|Date|\n)",
    r"Signature:\s*_+\s*([A-Za-z\s]+?)\s*(?:Title|Date|\n)",
]

FORMAT_VALIDATORS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?1?\d{9,15}$",
    "date": r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$|\d{4}[-/]\d{1,2}[-/]\d{1,2}$",
    "zipcode": r"^\d{5}(-\d{4})?$",
    "ssn": r"^\d{3}-?\d{2}-?\d{4}$",
}

# --- Fixed values: word lists -----------------------------------------------------
NDA_TEXT_PHRASES = [
    "non-disclosure agreement",
    "nondisclosure agreement",
    "confidentiality agreement",
    "proprietary information agreement",
    "nda",
    "disclosing party",
    "receiving party",
    "confidential information",
    "proprietary information",
]

# (document type, words looked for in the lower-cased file name), first hit wins.
NAME_KEYWORDS = [
    ("nda", ["nda", "non-disclosure", "nondisclosure"]),
    ("invoice", ["invoice", "bill", "statement", "total", "amount due"]),
    ("receipt", ["receipt", "payment", "transaction", "purchased"]),
    ("contract", ["agreement", "contract", "terms", "parties", "whereas"]),
    ("nda", ["non-disclosure", "nondisclosure", "nda", "confidentiality agreement",
             "proprietary information", "disclosing party", "receiving party"]),
    ("form", ["form", "application", "questionnaire", "checkbox"]),
    ("invoice", ["inv"]),
    ("receipt", ["rec", "rcpt"]),
]
DEFAULT_TYPE = "document"

ALLOWED_EXTENSIONS = [".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".bmp"]
SUPPORTED_MIME_TYPES = [
    "application/pdf", "image/png", "image/jpeg", "image/jpg", "image/tiff", "image/bmp",
]
EXTENSION_MIME = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".bmp": "image/bmp",
}
# Public file signatures: hex prefix of the content -> MIME type.
SIGNATURE_MIME = {
    "25504446": "application/pdf",
    "89504E470D0A1A0A": "image/png",
    "FFD8FF": "image/jpeg",
    "49492A00": "image/tiff",
    "4D4D002A": "image/tiff",
    "424D": "image/bmp",
}
DEFAULT_MIME = "application/octet-stream"

MAX_UPLOAD_BYTES = 50 * 1024 * 1024
MAX_EXTRACT_BYTES = 10 * 1024 * 1024
MAX_PATH_LENGTH = 4096
MAX_DIRECTORY_DEPTH = 10
DANGEROUS_NAME_PARTS = ["..", "~", "//", "\x00", "\r", "\n"]
DANGEROUS_PATH_COMPONENTS = ["..", ".", "~", ""]

# --- Fixed values: record templates -----------------------------------------------
METADATA_FIELDS = ["invoice_number", "receipt_number", "po_number"]
REQUIRED_FIELDS = {
    "invoice": ["invoice_number", "vendor_name", "total_amount"],
    "receipt": ["merchant_name", "total_amount", "transaction_date"],
    "contract": ["party1", "party2", "effective_date"],
    "form": [],
    "nda": ["disclosing_party", "receiving_party", "effective_date"],
}
# type, action, condition {field: constraint} or None, endpoint
TRIGGER_TEMPLATES = [
    ("invoice", "webhook", {"total_amount": {"$gte": 1000}}, "/api/invoices/high-value"),
    ("invoice", "webhook", {"due_date": {"$exists": True}}, "/api/invoices/payable"),
    ("receipt", "webhook", None, "/api/receipts/process"),
    ("contract", "webhook", None, "/api/contracts/new"),
    ("contract", "email", {"end_date": {"$exists": True}}, "legal@company.com"),
    ("form", "webhook", None, "/api/forms/submission"),
    ("nda", "webhook", None, "/api/contracts/nda/new"),
    ("nda", "webhook", None, "/api/compliance/confidentiality"),
    ("nda", "webhook", {"term_duration": {"$exists": True}},
     "/api/contracts/nda/expiration-tracking"),
]
DEFAULT_TRIGGER_ENDPOINT = "/api/documents/"
TRIGGER_METHOD = "POST"
SCHEMA_VERSION = "1.0"

# group -> [(leaf, source field)]
STRUCTURED_LAYOUT = {
    "invoice": {
        "invoice_details": [("number", "invoice_number"), ("date", "invoice_date"),
                            ("due_date", "due_date"), ("po_number", "po_number")],
        "vendor": [("name", "vendor_name"), ("tax_id", "tax_id")],
        "amounts": [("subtotal", "subtotal"), ("tax", "tax_amount"), ("total", "total_amount")],
    },
    "receipt": {
        "transaction": [("number", "receipt_number"), ("date", "transaction_date"),
                        ("merchant", "merchant_name")],
        "payment": [("method", "payment_method"), ("total", "total_amount")],
    },
    "contract": {
        "parties": [("party1", "party1"), ("party2", "party2")],
        "dates": [("effective", "effective_date"), ("termination", "end_date")],
        "terms": [("value", "contract_value")],
    },
}
# Structured member that carries the first table's rows.
LINE_ITEM_MEMBER = {"invoice": "line_items", "receipt": "items"}

# --- Fixed values: validation rules -----------------------------------------------
# type, field, rule, parameters, message, severity ("*" = every type, after the others)
VALIDATION_RULES = [
    ("invoice", "invoice_number", "required", {}, "Invoice number is required", "error"),
    ("invoice", "vendor_name", "required", {}, "Vendor name is required", "error"),
    ("invoice", "total_amount", "required", {}, "Total amount is required", "error"),
    ("invoice", "total_amount", "range", {"min": 0, "max": 1000000},
     "Total amount must be between 0 and 1,000,000", "error"),
    ("invoice", "invoice_date", "format", {"format": "date"},
     "Invoice date must be a valid date", "warning"),
    ("receipt", "merchant_name", "required", {}, "Merchant name is required", "error"),
    ("receipt", "total_amount", "required", {}, "Total amount is required", "error"),
    ("receipt", "transaction_date", "required", {}, "Transaction date is required", "error"),
    ("contract", "party1", "required", {}, "First party name is required", "error"),
    ("contract", "party2", "required", {}, "Second party name is required", "error"),
    ("contract", "effective_date", "required", {}, "Effective date is required", "error"),
    ("form", "email", "format", {"format": "email"}, "Email must be valid format", "warning"),
    ("form", "phone", "format", {"format": "phone"}, "Phone must be valid format", "warning"),
    ("*", "confidence_score", "range", {"min": 0.5, "max": 1.0},
     "Confidence score should be between 0.5 and 1.0", "warning"),
]
RECORD_KEYS = ["schema_version", "document_id", "document_type", "extracted_data"]
SUGGEST_MISSING = "Consider manual review to fill missing fields: "
SUGGEST_FORMAT = "Review and correct format issues in extracted data"
SUGGEST_LINE_ITEMS = "Consider extracting line items for detailed invoice analysis"
SUGGEST_TERMS = "Contract terms extraction could improve automation accuracy"

# --- Fixed values: lifecycle and delivery -----------------------------------------
STAGES = ["classification", "ocr", "analysis", "schema", "validation"]
STAGE_LABELS = {
    "classification": "Classification",
    "ocr": "OCR",
    "analysis": "Analysis",
    "schema": "Schema generation",
    "validation": "Validation",
}
STAGE_ATTEMPTS = {"classification": 2, "ocr": 3, "analysis": 2, "schema": 2, "validation": 2}
STATUS_MAP = {
    "PENDING": "processing",
    "STARTED": "processing",
    "RETRY": "processing",
    "SUCCESS": "completed",
    "FAILURE": "failed",
}
DOCUMENT_TTL_SECONDS = 86400
JOB_TTL_SECONDS = 3600
STUCK_AFTER_MINUTES = 5
DEFAULT_EVENTS = ["document.processed"]
PROCESSED_EVENT = "document.processed"
