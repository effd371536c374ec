"""Fixed values that results depend on: labels, negative words, units, windows, scores, severities, slabs.

Patterns are matched without regard to case.
"""

# Fields, their names in the contract, and confidence labels.
FIELDS = ("MRP", "NET_QUANTITY", "MANUFACTURER_ADDRESS", "MANUFACTURING_DATE", "CONSUMER_CARE")
CONTRACT_NAMES = {"MRP": "mrp", "NET_QUANTITY": "net_quantity", "MANUFACTURER_ADDRESS": "manufacturer", "MANUFACTURING_DATE": "mfg_date", "CONSUMER_CARE": "consumer_care"}
CONFIDENCE_VALUE = {"high": 0.9, "low": 0.4, "none": 0.0}
CONFIDENCE_RANK = {"high": 2, "low": 1, "none": 0}

# Label patterns with the names reported for them, in order of precedence.
MRP_LABELS = [(r"\bMaximum\s+Retail\s+Price\b", "Maximum Retail Price"), (r"\bMRP\b", "MRP"), (r"अधिकतम\s*खुदरा\s*मूल्य", "Maximum Retail Price (Hindi)")]
NET_QUANTITY_LABELS = [
    (r"\bNet\s*Quantity\b", "Net Quantity"), (r"\bNet\s*Qty\b", "Net Qty"), (r"\bNet\s*Weight\b", "Net Weight"), (r"\bNet\s*Wt\b", "Net Wt"),
    (r"\bNet\s*Vol\b", "Net Vol"), (r"\bQuantity\b", "Quantity"), (r"\bWeight\b", "Weight"), (r"\bContents\b", "Contents"),
]
MANUFACTURER_LABELS = [
    (r"\bManufactured\s*&\s*Marketed\s*by\b", "Manufactured & Marketed by"), (r"\bManufactured\s*and\s*Marketed\s*by\b", "Manufactured and Marketed by"),
    (r"\bBrand\s*Owned\s*and\s*Mkt\s*by\b", "Brand Owned and Mkt by"), (r"\bBrand\s*Owned\s*&\s*Mkt\s*by\b", "Brand Owned & Mkt by"),
    (r"\bManufactured\s*by\b", "Manufactured by"), (r"\bManufactured\s*for\b", "Manufactured for"), (r"\bMarketed\s*by\b", "Marketed by"),
    (r"\bMkt\.?\s*by\b", "Mkt. by"), (r"\bMfd\.?\s*by\b", "Mfd. by"), (r"\bMfg\.?\s*by\b", "Mfg. by"), (r"\bManufacturer\b", "Manufacturer"),
    (r"\bImported\s*by\b", "Imported by"), (r"\bPacked\s*by\b", "Packed by"), (r"\bPkd\.?\s*by\b", "Pkd. by"), (r"\bProduced\s*by\b", "Produced by"),
]
DATE_LABELS = [
    (r"\bDate\s*of\s*Manufacture\b", "Date of Manufacture"), (r"\bManufacturing\s*Date\b", "Manufacturing Date"), (r"\bManufactured\s*Date\b", "Manufactured Date"),
    (r"\bMfg\.?\s*Date\b", "Mfg Date"), (r"\bMfd\.?\s*Date\b", "Mfd Date"), (r"\bPacking\s*Date\b", "Packing Date"), (r"\bPacked\s*On\b", "Packed On"),
    (r"\bDate\s*of\s*Packaging\b", "Date of Packaging"), (r"\bPkd\.?\s*Date\b", "Pkd Date"), (r"\bMFD\b", "MFD"), (r"\bMFG\b", "MFG"), (r"\bPKD\b", "PKD"),
]
EXPIRY_LABELS = [
    (r"\bExpiry\s*Date\b", "Expiry Date"), (r"\bExpiration\s*Date\b", "Expiration Date"), (r"\bUse\s*By\b", "Use By"),
    (r"\bBest\s*Before\b", "Best Before"), (r"\bExp\.?\s*Date\b", "Exp. Date"), (r"\bExp\b", "Exp"),
]
CARE_LABELS = [
    (r"\bConsumer\s*Care\s*Details\b", "Consumer Care Details"), (r"\bConsumer\s*Care\s*No\.?\b", "Consumer Care No."),
    (r"\bConsumer\s*Care\s*Number\b", "Consumer Care Number"), (r"\bConsumer\s*Care\b", "Consumer Care"), (r"\bCustomer\s*Care\s*No\.?\b", "Customer Care No."),
    (r"\bCustomer\s*Care\s*Number\b", "Customer Care Number"), (r"\bCustomer\s*Care\b", "Customer Care"), (r"\bCustomer\s*Support\b", "Customer Support"),
    (r"\bContact[\s._-]+Us\b", "Contact Us"), (r"\bContact[\s._-]+Details\b", "Contact Details"), (r"\bConsumer\s*Relations\b", "Consumer Relations"),
    (r"\bContact\s*Consumer\s*Relations\b", "Contact Consumer Relations"), (r"\bFeedback\b", "Feedback"), (r"\bComplaints\b", "Complaints"),
    (r"\bQuestions\s*or\s*Comments\b", "Questions or Comments"), (r"\bToll\s*Free\b", "Toll Free"),
]

LABELS = {"MRP": MRP_LABELS, "NET_QUANTITY": NET_QUANTITY_LABELS, "MANUFACTURER_ADDRESS": MANUFACTURER_LABELS, "MANUFACTURING_DATE": DATE_LABELS, "CONSUMER_CARE": CARE_LABELS}

# Rewrites before matching, in order, and single characters that are replaced last.
REWRITES = [
    (r"[ \t]+", " "), (r"\n+", " \n "), (r"\bM\s*\.?\s*R\s*\.?\s*P\.?\b", "MRP"), (r"\bNet\s*Qty\.?\b", "Net Qty"), (r"\bNet\s*Wt\.?\b", "Net Wt"),
    (r"\bManuractured\b", "Manufactured"), (r"\bconlact\b", "contact"), (r"\bCuslomer\b", "Customer"), (r"\bNet\s*Vol\.?\b", "Net Qty"), (r"\bRs\s*\.\s*", "Rs "),
]
CHARACTERS = ("०१२३४५६७८९ः：", "0123456789::")

# Words that suppress a candidate or bound a window.
MRP_NEGATIVE = [r"\bOffer\s*Price\b", r"\bOffer\b", r"\bDiscount\b", r"\bSave\b", r"\bSpecial\s*Price\b", r"\bYou\s*Pay\b"]
NET_QUANTITY_NEGATIVE = [
    r"\bProtein\b", r"\bFat\b", r"\bCarbohydrate\b", r"\bServing\s*Size\b", r"\bPer\s*Serving\b", r"\bEnergy\b", r"\bCalories\b", r"\bPack\s*of\b", r"\bServings?\b",
]
BATCH_NEGATIVE = [r"\bBatch\b", r"\bBatch\s*No\.?\b", r"\bB\.?NO\.?\b", r"\bLOT\b"]
DATE_NEGATIVE = [p for p, _ in EXPIRY_LABELS] + BATCH_NEGATIVE
QUERY_BOUNDARIES = [r"\bfor\s+customer\s+queries\b", r"\bfor\s+consumer\s+queries\b", r"\bfor\s+queries\b", r"\bcustomer\s+queries\b", r"\bconsumer\s+queries\b"]

# Value patterns.  Groups are numbered, as the second-pass patterns are used by Java too, which has no names
# with underscores.
CURRENCY_AMOUNT = r"([+-])?\s*(₹|Rs\.?|INR|\?)\s*([+-])?\s*(\d[\d,]*(?:\.\d+)?)(/-)?([A-Za-z]+)?(?![A-Za-z0-9_]|-\w|%\w)"
AMOUNT_ONLY = r"^[\s:]*([+-])?(\d[\d,]*(?:\.\d+)?)(?!\w)"
BROKEN_AMOUNT = r"\bR\s*=\s*\.?\s*(\d{2,4})\s*[\.\s]+\s*(\d{2})\b"
UNIT = (
    r"(milligrams?|kilograms?|millilitres?|milliliters?|litres?|liters?|grams?|mg|kg|g|ml|l|"
    r"pieces?|pcs?|units?|u|n|numbers?|cigarettes?|sticks?|tablets?|pills?|pairs?)"
)
QUANTITY_VALUE = r"(?<![\d.,])([+-])?\s*(\d[\d,]*(?:\.\d+)?)\s*" + UNIT + r"\b"
INTEGER = r"(?:\d{1,3}(?:,\d{3})+|\d{1,3}(?:,\d{2})+,\d{3}|\d+)"
UNITS = {
    "l": "l", "litre": "l", "litres": "l", "liter": "l", "liters": "l", "ml": "ml", "millilitre": "ml", "millilitres": "ml", "milliliter": "ml", "milliliters": "ml",
    "g": "g", "gram": "g", "grams": "g", "kg": "kg", "kilogram": "kg", "kilograms": "kg", "mg": "mg", "milligram": "mg", "milligrams": "mg",
    "piece": "pieces", "pieces": "pieces", "pc": "pieces", "pcs": "pieces", "unit": "units", "units": "units", "u": "units", "n": "units", "number": "units", "numbers": "units",
    "cigarette": "cigarettes", "cigarettes": "cigarettes", "stick": "sticks", "sticks": "sticks", "tablet": "tablets", "tablets": "tablets", "pill": "pills", "pills": "pills", "pair": "pairs", "pairs": "pairs",
}
DATE_RANGE = r"\b(\d{1,2})[./\-](\d{2,4})\s*[\-–—]\s*(\d{1,2})[./\-](\d{2,4})\b"
DATE_DMY4 = r"\b(\d{1,2})[./\-](\d{1,2})[./\-](\d{4})\b"
DATE_YMD = r"\b(\d{4})[./\-](\d{1,2})[./\-](\d{1,2})\b"
DATE_DMONY = r"\b(\d{1,2})[\s./-]+([A-Za-z]{3,9})[,\s./-]+(\d{2,4})\b"
DATE_DMY2 = r"\b(\d{1,2})[./\-](\d{1,2})[./\-](\d{2})\b"
DATE_MY = r"\b(\d{1,2})[./\-](\d{4})\b"
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
PHONE = r"(?:\+?91[-\s]?)?\b\d{10}\b|\b\d{3,5}[-\s]\d{6,8}\b|\b\d{2,5}(?:[-\s]\d{2,5}){1,3}\b"
EMAIL = r"\b[\w.+-]+\s*@\s*[\w-]+(?:\s*\.\s*[\w.-]+)+\b"

# Windows in characters, and score parts.
WINDOW, AMOUNT_ONLY_WINDOW, RECOVERY_WINDOW, MANUFACTURER_WINDOW, DATE_WINDOW, CARE_WINDOW = 80, 15, 140, 120, 35, 180
LABEL_BASE, CURRENCY_BONUS, RECOVERY_BONUS, AMOUNT_BONUS, UNIT_BONUS = 0.5, 0.3, 0.15, 0.1, 0.2
HIGH_SCORE, LARGE_PRICE, LOW_OCR = 0.9, 1_000_000, 0.5

# Second-pass normalizers.
SECOND_PRICE = r"[\d,]+(?:\.\d{1,2})?"
SECOND_QUANTITY = r"(\d+(?:\.\d+)?)\s*(kg|g|mg|l|ml|cl|dl|pair(?:s)?|unit(?:s)?|number|nos?|pcs?|pieces?)\b"
SECOND_SINGULAR = {"pairs": "pair", "units": "unit", "nos": "no", "pcs": "pc", "pieces": "piece"}
SECOND_DATES = {"full": r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b", "month": r"\b(\d{1,2})/(\d{2,4})\b", "named": r"\b([A-Z]{3,})/?(\d{2,4})\b", "refused": r"^\d{6}$"}
SECOND_PHONE = r"(?:\+91[\s-]?)?(?:\(?\d{2,4}\)?[\s-]?)?\d{3,5}[\s-]?\d{3,5}[\s-]?\d{3,5}"
SECOND_EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
TOLL_FREE = r"(?:^|[\s(])1[-\s]?[789]"

# Second-pass patterns and spatial anchors.
SWEEP = {
    "MRP": r"(?:RS|INR|₹|MRP|USP|PRICE)[^\d]*?([\d,]+(?:\.\d{1,2})?)",
    "NET_QUANTITY": r"(\d+(?:\.\d+)?)\s*(g|kg|ml|l|liter|litre|pieces|units)\b",
    "DATE_STRICT": r"(?<!\d)(\d{2})\s*[\./-]\s*(\d{2}|[A-Z]{3})\s*[\./-]\s*(\d{2,4})(?!\d)",
    "DATE_MONTH_YEAR": r"\b(?:M|U|MFD\.?|EXP\.?|USE BY\.?|MFO:)?\s*(\d{2}|JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)\s*[\./-]?\s*(\d{2,4})\b",
    "CONSUMER_CARE": r"([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}|\b1800[- \s]?\d{3}[- \s]?\d{3,4}|\b\d{3,4}[- \s]?\d{6,8}\b)",
    "MANUFACTURER_ADDRESS": r"(?:MANUFACTURED|MARKETED|PACKED|MFD\.?|MKTD\.?)[\s\.]*BY[\s:,\-]+(.*?)(?=\b(?:FSSAI|LIC\b|CONSUMER|CUSTOMER|NET\b|MRP|BATCH|STORE|ALLERGEN|FOR\s|ISO\b|@|1800)|$)",
}
ANCHORS = {
    "MRP": ["MRP", "MAX.*RETAIL", "PRICE", "INCL.*TAXES", "USP"],
    "MANUFACTURING_DATE": ["MFD", "MFG", "MANUFACTURED", "MFO", r"^M\s+", "BATCH NO"],
    "EXPIRY_DATE": ["EXP", "USE BY", "BEST BEFORE", r"^U\s+"],
    "NET_QUANTITY": ["NET QTY", "NET WT", "WEIGHT", "VOLUME", "CONTENT"],
}
MAX_LEFT, MAX_RIGHT, MAX_DOWN, MAX_UP = 40, 400, 60, 40

# Rules.
MANDATORY = ("mrp", "net_quantity", "manufacturer", "mfg_date", "consumer_care", "FONT_SIZE")
PENALTY = "Section 36(1) of Legal Metrology Act, 2009"
VALID_UNITS = ["g", "kg", "ml", "l", "ltr", "pieces", "units", "cigarettes", "sticks", "pills", "tablets", "pairs", "capsules", "sachets", "packets", "bottles", "cans", "boxes"]
RULES = [
    ("RULE_6_1_A", "Rule 6(1)(a)", "manufacturer", "HIGH"), ("RULE_6_1_C", "Rule 6(1)(c)", "net_quantity", "HIGH"), ("RULE_6_1_D", "Rule 6(1)(d)", "mfg_date", "HIGH"),
    ("RULE_6_1_E", "Rule 6(1)(e)", "mrp", "CRITICAL"), ("RULE_6_1_H", "Rule 6(1)(h)", "consumer_care", "MEDIUM"), ("RULE_9_1", "Rule 9(1)", "font_size", "HIGH"),
]
SEVERITY = {"CRITICAL": "critical", "HIGH": "major", "MEDIUM": "minor", "WARNING": "minor"}
DEDUCTION = {"critical": 30, "major": 15, "minor": 5}

# Font size.
SLABS = [(0.0, 200.0, 1.0), (200.0, 500.0, 2.0), (500.0, float("inf"), 4.0)]
COIN_MM = {"1_rupee": 21.93, "2_rupee": 27.00, "5_rupee": 23.00, "10_rupee": 27.00}
BASE_UNITS = {"g": 1.0, "gm": 1.0, "gram": 1.0, "grams": 1.0, "ml": 1.0, "millilitre": 1.0, "millilitres": 1.0, "kg": 1000.0, "l": 1000.0, "ltr": 1000.0, "litre": 1000.0, "litres": 1000.0}

# Cleaners of expected values in evaluation.
PRICE_WORDS, EXPECTED_PRICE = r"\b(?:MRP|MAXIMUM\s+RETAIL\s+PRICE|RS\.?|INR)\b", r"\d[\d,]*(?:\.\d+)?"
UNIT_WORDS = {"millilitres": "ml", "milliliters": "ml", "kilograms": "kg", "kilogram": "kg", "grams": "g", "gram": "g", "litres": "l", "liters": "l"}
EXPECTED_QUANTITY, RECALL_LEAST = r"(\d+(?:\.\d+)?)\s*(mg|kg|ml|g|l)\b", 0.6

# Signals that the OCR passes look for.
ROTATION_WORDS = r"(?:mrp|₹|rs\.?|net|qty|mfd|exp|batch|date|manufactur)"
TRIGGER = r"(?:mrp|₹|rs\.?|mfd|exp|\d{2}[/.-]\d{2})"
