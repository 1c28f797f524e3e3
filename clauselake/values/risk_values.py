"""Region risk, data types and breach classes."""

# These lists must stay as they are for results to agree.

# (data type, category, risk)
DATA_TYPES = (
    ("Email addresses", "Identity", "medium"),
    ("Email", "Identity", "medium"),
    ("Names", "Identity", "low"),
    ("Name", "Identity", "low"),
    ("Full name", "Identity", "low"),
    ("Phone numbers", "Identity", "medium"),
    ("Phone number", "Identity", "medium"),
    ("Date of birth", "Identity", "medium"),
    ("Age", "Identity", "low"),
    ("Location", "Location", "medium"),
    ("Physical addresses", "Location", "high"),
    ("IP Address", "Location", "medium"),
    ("IP addresses", "Location", "medium"),
    ("Precise location", "Location", "high"),
    ("GPS data", "Location", "high"),
    ("Credit cards", "Financial", "high"),
    ("Payment information", "Financial", "high"),
    ("Bank account numbers", "Financial", "high"),
    ("Purchase history", "Financial", "medium"),
    ("Transaction history", "Financial", "medium"),
    ("Biometric data", "Biometric", "high"),
    ("Face recognition", "Biometric", "high"),
    ("Fingerprints", "Biometric", "high"),
    ("Voice data", "Biometric", "high"),
    ("Health data", "Sensitive", "high"),
    ("Medical information", "Sensitive", "high"),
    ("Passwords", "Sensitive", "high"),
    ("Social security numbers", "Sensitive", "high"),
    ("Browsing history", "Behavioral", "medium"),
    ("Search history", "Behavioral", "medium"),
    ("Usage data", "Behavioral", "low"),
    ("Device information", "Behavioral", "low"),
    ("Cookies", "Behavioral", "low"),
)
