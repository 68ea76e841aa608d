"""Sample inputs that the rule queries take in turn, row by row."""

DOC_TYPE_ANSWERS = [
    "W-2", "Form W-2 Wage and Tax Statement", "1099-NEC", "Form 1099 INT", "1099 misc", "1099-DIV", "1099-R", "1099G", "1099 B form", "1098-T", "tuition bill", "1098E", "student loan interest", "Form 1098",
    "1095-A", "W9", "Request for Taxpayer Identification", "Schedule K", "k-1", "Property Tax bill", "charitable gift", "donation receipt", "Brokerage interest 1099", "consolidated 1099", "engagement letter",
    "pay stub", "", "   ", "unknown", "1099", "w 2", "aw-2x", "interest 1099",
]
KEYS = ["ssn", "SSN", "recipient_tin", "ein", "partnership_ein", "box1_wages", "ordinary_income", "payer", "employee_name", "Mortgage_total", "company_ein", "rating"]
VALUES = [
    "123-45-6789", "123456789", "12-3456789", "1234", "", "  ", "$1,234.50", "-5", "0.00", "abc", "1e3", "12.", ".5", "1_000", "Jane Doe", "Employer", "the payer's name", "co", "68,420.15", "Copperline Bank, N.A.",
    "State", "12 34", "99999.99", "EMPLOYEE'S NAME", "5.0d", "Interest income", "7", "+3", "$", "x-1",
]
PAGES = ["1", "2", " 3 ", "0", "-1", "1.0", "1.5", "true", "abc", "", "12", "007", "+4"]
NAMES = ["a.png", "b.PDF", ".hidden.png", "c.jpeg", "d.txt", "e", "f.tar.JPG", "g.webp", "h.gif", "i.", "_j.png"]
TIMES = ["2024-01-05T10:20:30Z", "2024-01-05 10:20:30", "2024-13-05T10:20:30Z", "", "2024-02-29T00:00:00Z", "2023-02-29T00:00:00Z", "nonsense", "2024-01-05T10:20:30"]
ANSWERS = [
    '{"doc_type": "W-2", "handwritten": true}', '```json\n{"doc_type": "Form 1099-INT"}\n```', 'Sure: {"doc_type": "K-1", "handwritten": "no"} done', "no object", '{"doc_type": "W-9"}', '{"doc_type": ', "", '{"doc_type": null}',
    '{"doc_type": "1098", "handwritten": "yes"}', "[1, 2]", '{"other": 1}',
]
FIELD_ANSWERS = [
    '{"employee_name": "Jane Doe", "ssn": "123-45-6789", "employer": "Acme", "box1_wages": "1,000.00", "box2_fed_withheld": "1,500"}', "not json",
    '{"payer": "Copperline Bank", "recipient_name": null, "box1_interest_income": "12.5"}', '{"partner_name": " Al ", "ordinary_income": "-3", "partnership_ein": "12-3456789"}', '{"lender": "Employer"}',
]
