"""Labels, phrases and patterns that detections, filters and reports agree on."""

# --- Fixed values: label lists and maps -------------------------------------------------------------------------------
ZERO_SHOT_LABELS = (
    "person", "name", "first name", "last name", "date of birth",
    "aadhaar number", "pan number", "gst number", "national id", "tax id", "certificate license number",
    "medical record number", "health plan beneficiary number",
    "email address", "phone number",
    "street address", "address", "city", "state", "postcode", "country",
    "ipv4 address", "ipv6 address", "device identifier", "unique identifier",
    "employee id", "customer id",
    "account number", "bank routing number",
    "license plate number", "vehicle identifier",
    "biometric identifier",
)
SLM_LABELS = (
    "person", "name", "email", "phone number", "address", "organization", "date", "ssn", "passport number",
    "credit card number", "bank account number", "ip address", "username", "location", "aadhaar", "pan", "gst_number",
    "udyam_number", "date_of_birth",
)
SHARED_LABELS = {
    "PERSON": "person",
    "EMAIL_ADDRESS": "email address",
    "PHONE_NUMBER": "phone number",
    "LOCATION": "location",
    "DATE_TIME": "date",
    "US_SSN": "ssn",
    "US_PASSPORT": "passport number",
    "US_DRIVER_LICENSE": "driver license number",
    "IN_AADHAAR": "aadhaar number",
    "IN_PAN": "pan number",
    "IN_PASSPORT": "passport number",
    "IN_VEHICLE_REGISTRATION": "vehicle registration number",
    "CREDIT_CARD": "credit card number",
    "IBAN_CODE": "bank account number",
    "US_BANK_NUMBER": "bank account number",
    "IP_ADDRESS": "ip address",
    "MAC_ADDRESS": "mac address",
    "URL": "url",
    "MEDICAL_LICENSE": "medical license number",
    "CRYPTO": "crypto wallet address",
}
CANONICAL = {
    "aadhaar": "aadhaar number",
    "pan": "pan number",
    "gst_number": "gst number",
    "date_of_birth": "date of birth",
    "dob": "date of birth",
}
PROSE_LABELS = {
    "full name": "person", "name": "person", "date of birth": "date_of_birth", "dob": "date_of_birth",
    "email address": "email", "email": "email", "phone number": "phone number", "phone": "phone number",
    "address": "address", "aadhaar number": "aadhaar", "aadhaar": "aadhaar",
    "pan card number": "pan", "pan number": "pan", "pan": "pan",
    "gst number": "gst_number", "gstin": "gst_number", "gst": "gst_number",
    "state": "location", "location": "location", "city": "address", "country": "location",
}
NON_AUDIT_SOURCES = (
    "presidio", "gliner", "qwen", "qwen_cpu", "gliner_xlarge", "gliner_gretelai", "gliner_urchade", "gliner_arabic",
    "gretelai_gliner_large", "urchade_gliner_large_2.1_og",
)
#: Detectors by language, in the order in which they vote.
ROUTES = {
    "en": ("presidio", "gliner_xlarge", "gretelai_gliner_large", "urchade_gliner_large_2.1_og", "qwen"),
    "ar": ("gretelai_gliner_large", "urchade_gliner_large_2.1_og", "gliner_arabic", "qwen"),
}
TYPE_COLOURS = {
    "person": "#f59e0b", "name": "#f59e0b", "organization": "#8b5cf6", "phone number": "#06b6d4", "email": "#10b981",
    "address": "#6366f1", "date": "#ec4899", "location": "#14b8a6", "suspicious_token": "#64748b", "ssn": "#ef4444",
    "credit card number": "#ef4444", "bank account number": "#ef4444", "passport number": "#ef4444",
    "ip address": "#f97316", "username": "#a855f7",
}
OTHER_COLOUR = "#64748b"

# --- Fixed values: phrases --------------------------------------------------------------------------------------------
FORM_PHRASES = (
    "aadhaar number", "pan number", "pan card information name", "sample identity data", "gst information", "gstin",
    "business name", "father's name", "registration date", "business type", "pan card information",
    "aadhaar card information", "dob", "d.o.b.", "date of birth", "patient care coordination report", "coordination",
    "patient care", "care coordination", "coordination report", "metformin 500mg", "metformin 500", "identity data",
    "for testing purposes only",
)
TITLE_PHRASES = (
    "patient care coordination report", "sample identity data", "identity data (for testing purposes only)",
    "patient care", "care coordination", "coordination report", "for testing purposes only", "bid insurance",
)
COMMON_WORDS = (
    "coordination", "registration", "information", "report", "patient", "care", "clinical", "medical", "treatment",
    "therapy", "diagnosis", "prescription", "medication", "dosage", "administration", "documentation", "confidential",
    "summary", "review", "assessment", "classification", "implementation", "specification", "understanding",
    "illustrative", "provisioning", "clarifications", "requirements", "infrastructure", "organization",
    "organisations", "organizations", "functionality", "applicability", "identification", "authentication",
    "authorization", "confidentiality", "availability", "reconciliation", "recommendations", "considerations",
    "circumstances", "subsequently",
)

# --- Fixed values: patterns, in Java's spelling; (?U) makes its classes those of Unicode -------------------------------
AADHAAR = r"(?U)\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"
PAN = r"(?U)\b[A-Z]{5}\d{4}[A-Z]\b"
GST = r"(?U)\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z]\d\b"
UDYAM = r"(?Ui)\bUDYAM-[A-Z]{2}-\d{2}-\d{6,7}\b"
INDIAN_IDS = ((AADHAAR, "aadhaar"), (PAN, "pan"), (GST, "gst_number"), (UDYAM, "udyam_number"))
#: Supplementary patterns in order of priority, with label and score.
SUPPLEMENT = (
    *((p, label, 0.9) for p, label in INDIAN_IDS),
    (r"(?Ui)\b\d{1,2}-(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*-\d{4}\b", "date_of_birth", 0.85),
    (r"(?U)\b\d{4}-\d{2}-\d{2}\b", "date", 0.85),
    (r"(?U)\b\d{3}-\d{2}-\d{4}\b", "ssn", 0.9),
    (r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "email", 0.9),
)
AUDIT = {
    "long_number": r"(?U)\b\d{6,}\b",
    "card_like": r"(?U)\b(?:\d[ -]?){12,20}\b",
    "uuid": r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    "alphanumeric": r"(?U)\b[A-Za-z0-9]{12,}\b",
    "base64": r"(?U)\b[A-Za-z0-9+/]{20,}={0,2}\b",
    "hex_32": r"(?U)\b[a-fA-F0-9]{32}\b",
    "hex_40": r"(?U)\b[a-fA-F0-9]{40}\b",
    "hex_64": r"(?U)\b[a-fA-F0-9]{64}\b",
    "obfuscated_email": r"(?Ui)\b\w+\s*(?:at|\(at\))\s*\w+\s*(?:dot|\.)\s*\w+\b",
}
MEDICATION = r"(?Ui)^[A-Za-z][A-Za-z\s\-]+\d+\s*(?:mg|ml|g|mcg|iu|units?)?$"
STATE_PIN = r"(?U)^[A-Za-z][A-Za-z\s]+-\s*\d{6}$"
TOKEN_EDGES = ".,;:()[]{}<>\"'"
#: Built-in recognisers: label, pattern, score. Card numbers must pass the Luhn test as well.
RECOGNISERS = {
    "email": ("EMAIL_ADDRESS", r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 1.0),
    "phone": ("PHONE_NUMBER", r"\+\d{1,3}[ -]?\(?\d{2,4}\)?(?:[ -]?\d{2,4}){2,4}", 0.75),
    "ip": ("IP_ADDRESS", r"(?U)\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", 0.95),
    "url": ("URL", r"https?://[A-Za-z0-9./?=&_%:#~-]+", 0.6),
    "card": ("CREDIT_CARD", r"(?U)\b(?:\d[ -]?){12,18}\d\b", 1.0),
}
