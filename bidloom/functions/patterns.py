"""Format patterns and code lists used by the quality checks."""

# Accepted formats of identifiers and contact fields.
FORMATS = {
    "gstin": r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z]{1}[1-9A-Z]{1}Z[0-9A-Z]{1}$",
    "pan": r"^[A-Z]{5}[0-9]{4}[A-Z]{1}$",
    "email": r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$",
    "phone": r"^[6-9]\d{9}$",
    "ifsc": r"^[A-Z]{4}0[A-Z0-9]{6}$",
    "pincode": r"^\d{6}$",
}
STRICT_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_SEPARATORS = r"[\s\-()+]"
PHONE_BY_COUNTRY = {"IN": r"^(91)?[6-9]\d{9}$", "US": r"^(1)?[2-9]\d{9}$"}
PHONE_ELSEWHERE = r"^\d{10,15}$"
KNOWN_CURRENCIES = ["INR", "USD", "EUR", "GBP", "AED"]
KEY_COLUMNS = ["vendor_id", "contract_id", "invoice_id", "bid_id", "rfq_id"]
DROP_EXTENSIONS = [".csv", ".xlsx", ".xls", ".pdf"]
MAX_FILE_BYTES = 50 * 1024 * 1024
