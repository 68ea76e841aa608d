"""Fixed values of the domain: document types, their fields, labels and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Domain tables, in their natural order.
EXTRACT_TYPES = ["W-2", "1099-NEC", "1099-INT", "1099-MISC", "K-1", "1098"]
CLASSIFY_ONLY_TYPES = [
    "1099-DIV", "1099-B", "1099-R", "1099-G", "1098-T", "1098-E", "1095-A", "property tax statement",
    "charitable receipt", "brokerage statement", "W-9", "engagement letter",
]
UNRECOGNIZED = "UNRECOGNIZED"
STATUSES = ["pending", "extracted", "unrecognized", "confirmed", "error"]
FIELD_SCHEMA = {
    "W-2": ["employee_name", "ssn", "employer", "box1_wages", "box2_fed_withheld"],
    "1099-NEC": ["payer", "recipient_name", "recipient_tin", "box1_nonemployee_comp"],
    "1099-INT": ["payer", "recipient_name", "box1_interest_income"],
    "1099-MISC": ["payer", "recipient_name", "recipient_tin", "box3_other_income"],
    "K-1": ["partnership_name", "partner_name", "partnership_ein", "ordinary_income"],
    "1098": ["lender", "borrower_name", "box1_mortgage_interest"],
}
MONEY_TOKENS = ["box", "wage", "income", "comp", "interest", "withheld", "mortgage"]
CATEGORY_MONEY_TOKENS = ["box", "wage", "income", "comp", "interest"]
CATEGORIES = ["money", "tin_ssn", "names", "doc_type"]
# Display labels.
FIELD_LABELS = {
    "employer": "Employer", "ein": "EIN", "employee_name": "Employee", "ssn": "SSN", "box1_wages": "Wages (Box 1)",
    "box2_fed_withheld": "Fed. tax withheld (Box 2)", "payer": "Payer", "recipient": "Recipient", "recipient_tin": "Recipient TIN",
    "box1_interest": "Interest income (Box 1)", "box4_fed_withheld": "Fed. tax withheld (Box 4)",
    "box1_nonemployee_comp": "Nonemployee comp. (Box 1)", "lender": "Lender", "borrower": "Borrower", "borrower_tin": "Borrower TIN",
    "box1_mortgage_interest": "Mortgage interest (Box 1)", "recipient_name": "Recipient", "box1_interest_income": "Interest income (Box 1)",
    "box3_other_income": "Other income (Box 3)", "partnership_name": "Partnership", "partner_name": "Partner",
    "partnership_ein": "Partnership EIN", "ordinary_income": "Ordinary income", "borrower_name": "Borrower",
}
CSV_COLUMNS = ["client_id", "client_name", "doc_id", "doc_type", "received_at", "field_key", "field_label", "value", "corrected", "original_value", "low_confidence"]
PAYER_LABEL = "PAYER'S name street address city or town state or province country ZIP or foreign postal code and telephone no."
LENDER_LABEL = "RECIPIENT'S/LENDER'S name street address city or town state or province country ZIP or foreign postal code and telephone no."
# Regions of the forms.
#: (document type, field, box as fractions x0 y0 x1 y1, label)
REGIONS = [
    ("W-2", "ssn", (0.1755, 0.0860, 0.4931, 0.1805), "Employee's social security number"),
    ("W-2", "employer", (0.0500, 0.2077, 0.4500, 0.3163), "Employer's name, address, and ZIP code"),
    ("W-2", "employee_name", (0.0500, 0.4622, 0.4500, 0.5660), "Employee's first name and initial Last name"),
    ("W-2", "box1_wages", (0.4386, 0.1374, 0.7033, 0.2460), "Wages, tips, other compensation"),
    ("W-2", "box2_fed_withheld", (0.6513, 0.1374, 0.8925, 0.2460), "Federal income tax withheld"),
    ("1099-NEC", "payer", (0.0621, 0.0846, 0.4209, 0.2407), PAYER_LABEL),
    ("1099-NEC", "recipient_name", (0.0654, 0.4704, 0.4242, 0.5697), "RECIPIENT'S name"),
    ("1099-NEC", "recipient_tin", (0.2235, 0.3684, 0.4235, 0.4725), "RECIPIENT'S TIN"),
    ("1099-NEC", "box1_nonemployee_comp", (0.3980, 0.2928, 0.6510, 0.4016), "Nonemployee compensation"),
    ("1099-INT", "payer", (0.0621, 0.0926, 0.4209, 0.2488), PAYER_LABEL),
    ("1099-INT", "recipient_name", (0.0654, 0.4688, 0.4242, 0.5729), "RECIPIENT'S name"),
    ("1099-INT", "box1_interest_income", (0.3915, 0.1889, 0.6503, 0.3072), "Interest income"),
    ("1098", "lender", (0.0621, 0.0925, 0.4209, 0.2486), LENDER_LABEL),
    ("1098", "borrower_name", (0.0654, 0.4683, 0.4242, 0.5724), "PAYER'S/BORROWER'S name"),
    ("1098", "box1_mortgage_interest", (0.3948, 0.2470, 0.6536, 0.3700), "Mortgage interest received from payer(s)/borrower(s)"),
    ("K-1", "partnership_ein", (0.0657, 0.2022, 0.4039, 0.2462), "Partnership's employer identification number"),
    ("K-1", "partnership_name", (0.0657, 0.2437, 0.4275, 0.2900), "Partnership's name, address, city, state, and ZIP code"),
    ("K-1", "partner_name", (0.0657, 0.3737, 0.4275, 0.4247), "Name, address, city, state, and ZIP code for partner entered in E"),
    ("K-1", "ordinary_income", (0.4036, 0.0878, 0.6859, 0.1388), "Ordinary business income (loss)"),
]
# Phrases that stand on the forms.
ROLE_PHRASES = [
    "payer's name", "recipient's name", "lender's name", "borrower's name", "employer's name", "employee's name", "partner's name",
    "partnership's name", "payer", "recipient", "lender", "borrower", "employer", "employee", "name", "street address",
    "ordinary business income", "wages tips other compensation", "interest income", "nonemployee compensation", "employer identification number",
]
# What a new client is expected to send.
ORGANIZER_TEMPLATE = ["W-2", "1099-NEC", "1099-INT", "1099-MISC", "K-1", "1098", "1099-DIV", "charitable receipt", "brokerage statement"]
UPLOAD_EXTENSIONS = [".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp"]
INBOX_EXTENSIONS = [".png", ".jpg", ".jpeg", ".pdf"]
HAMMING_THRESHOLD, PIXEL_DELTA, PIXEL_CUTOFF = 16, 60, 6
REASK_CAP, REGION_CAP, NUDGE_MAX_CHARS, PDF_PAGE_CAP, RUNS_LIMIT = 3, 6, 900, 20, 100


def dim_doc_type(spark: SparkSession) -> DataFrame:
    rows = [(t, t in EXTRACT_TYPES, k) for k, t in enumerate(EXTRACT_TYPES + CLASSIFY_ONLY_TYPES)]
    return spark.createDataFrame(rows, "doc_type string, extract boolean, ord int")


def dim_field_schema(spark: SparkSession) -> DataFrame:
    rows = [(t, k, key) for t, keys in FIELD_SCHEMA.items() for k, key in enumerate(keys)]
    return spark.createDataFrame(rows, "doc_type string, pos int, key string")


def dim_field_label(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FIELD_LABELS.items()), "field_key string, field_label string")


def dim_region(spark: SparkSession) -> DataFrame:
    rows = [(t, f, *box, label) for t, f, box, label in REGIONS]
    return spark.createDataFrame(rows, "doc_type string, field string, x0 double, y0 double, x1 double, y1 double, label string")
