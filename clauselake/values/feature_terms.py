"""Term lists behind the link features."""

# These lists must stay as they are for results to agree.

PRIVACY_WORDS = (
    "privacy", "privacy policy", "data protection", "personal data", "your data",
    "personal information", "data privacy", "privacy notice", "privacy statement", "datenschutz",
    "datenschutzerklärung", "datenschutzrichtlinie", "datenschutzhinweise", "privatsphäre",
    "personenbezogene daten", "confidentialité", "politique de confidentialité",
    "données personnelles", "privacidad", "política de privacidad", "datos personales", "gdpr",
    "ccpa", "dsgvo", "rgpd",
)

TERMS_WORDS = (
    "terms", "terms of service", "terms of use", "terms and conditions", "conditions of use",
    "user agreement", "service agreement", "nutzungsbedingungen", "agb",
    "allgemeine geschäftsbedingungen", "conditions générales", "condiciones de uso",
    "términos y condiciones",
)

COOKIE_WORDS = (
    "cookie", "cookies", "cookie policy", "cookie notice", "cookie-richtlinie", "cookies policy",
    "use of cookies", "politique cookies", "política de cookies",
)

LEGAL_WORDS = (
    "legal", "legal notice", "legal information", "impressum", "rechtliche hinweise",
    "mentions légales", "aviso legal",
)

URL_WORDS = (
    "privacy", "privacy-policy", "privacypolicy", "privacy_policy", "datenschutz",
    "datenschutzerklaerung", "data-protection", "terms", "terms-of-service", "tos", "terms-of-use",
    "termsofservice", "legal", "policies", "policy", "cookie", "cookies", "nutzungsbedingungen",
    "agb", "impressum", "gdpr", "ccpa",
)

STRUCTURE_WORDS = (
    "data collection", "information we collect", "how we use", "your rights", "third parties",
    "cookies", "security", "retention", "updates to this policy", "contact us", "datenerhebung",
    "ihre rechte", "dritte",
)

JARGON_WORDS = (
    "pursuant to", "hereby", "notwithstanding", "liability", "indemnify", "consent", "processing",
    "controller", "processor", "gemäß", "hiermit", "verarbeitung", "verantwortlicher",
)
