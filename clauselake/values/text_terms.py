"""Term lists and patterns matched against document text."""

# These lists must stay as they are for results to agree.

# Privacy words by language and concept. Languages that a top-level domain maps to; pass a
# larger table to the operators to cover more.
PRIVACY_TERMS = {
    "en": {"privacy": "privacy", "policy": "policy", "data_protection": "data protection", "legal": "legal", "terms": "terms", "cookies": "cookies", "notice": "notice"},
    "de": {"privacy": "datenschutz", "policy": "richtlinie", "data_protection": "datenschutz", "legal": "rechtliches", "terms": "nutzungsbedingungen", "cookies": "cookies", "notice": "hinweis", "impressum": "impressum"},
    "nl": {"privacy": "privacy", "policy": "beleid", "data_protection": "gegevensbescherming", "legal": "juridisch", "terms": "voorwaarden", "cookies": "cookies"},
    "sv": {"privacy": "integritet", "policy": "policy", "data_protection": "dataskydd", "legal": "juridisk", "terms": "villkor", "cookies": "cookies"},
    "da": {"privacy": "privatliv", "policy": "politik", "data_protection": "databeskyttelse", "legal": "juridisk", "terms": "vilkår", "cookies": "cookies"},
    "no": {"privacy": "personvern", "policy": "retningslinjer", "data_protection": "personvern", "legal": "juridisk", "terms": "vilkår", "cookies": "cookies"},
    "fr": {"privacy": "confidentialité", "policy": "politique", "data_protection": "protection des données", "legal": "mentions légales", "terms": "conditions", "cookies": "cookies", "vie_privee": "vie privée"},
    "es": {"privacy": "privacidad", "policy": "política", "data_protection": "protección de datos", "legal": "legal", "terms": "términos", "cookies": "cookies", "aviso": "aviso"},
    "pt": {"privacy": "privacidade", "policy": "política", "data_protection": "proteção de dados", "legal": "legal", "terms": "termos", "cookies": "cookies"},
    "it": {"privacy": "privacy", "policy": "informativa", "data_protection": "protezione dati", "legal": "legale", "terms": "termini", "cookies": "cookies", "riservatezza": "riservatezza"},
    "ru": {"privacy": "конфиденциальность", "policy": "политика", "data_protection": "защита данных", "legal": "правовая", "terms": "условия", "cookies": "куки"},
    "pl": {"privacy": "prywatność", "policy": "polityka", "data_protection": "ochrona danych", "legal": "prawne", "terms": "warunki", "cookies": "ciasteczka"},
    "cs": {"privacy": "soukromí", "policy": "zásady", "data_protection": "ochrana údajů", "legal": "právní", "terms": "podmínky", "cookies": "cookies"},
    "sk": {"privacy": "súkromie", "policy": "zásady", "data_protection": "ochrana údajov", "legal": "právne", "terms": "podmienky", "cookies": "cookies"},
    "zh": {"privacy": "隐私", "policy": "政策", "data_protection": "数据保护", "legal": "法律", "terms": "条款", "cookies": "cookies", "notice": "声明"},
    "zh-tw": {"privacy": "隱私", "policy": "政策", "data_protection": "資料保護", "legal": "法律", "terms": "條款", "cookies": "cookies"},
    "ja": {"privacy": "プライバシー", "policy": "ポリシー", "data_protection": "データ保護", "legal": "法的", "terms": "利用規約", "cookies": "クッキー", "kojin": "個人情報"},
    "ko": {"privacy": "개인정보", "policy": "정책", "data_protection": "데이터 보호", "legal": "법적", "terms": "약관", "cookies": "쿠키", "boho": "보호"},
    "ar": {"privacy": "الخصوصية", "policy": "سياسة", "data_protection": "حماية البيانات", "legal": "قانوني", "terms": "الشروط", "cookies": "ملفات تعريف الارتباط"},
    "he": {"privacy": "פרטיות", "policy": "מדיניות", "data_protection": "הגנת מידע", "legal": "משפטי", "terms": "תנאים", "cookies": "עוגיות"},
    "tr": {"privacy": "gizlilik", "policy": "politika", "data_protection": "veri koruma", "legal": "yasal", "terms": "koşullar", "cookies": "çerezler", "kvkk": "kvkk", "aydinlatma": "aydınlatma"},
    "el": {"privacy": "απόρρητο", "policy": "πολιτική", "data_protection": "προστασία δεδομένων", "legal": "νομικά", "terms": "όροι", "cookies": "cookies", "prosopika": "προσωπικά"},
    "fi": {"privacy": "yksityisyys", "policy": "käytäntö", "data_protection": "tietosuoja", "legal": "oikeudellinen", "terms": "ehdot", "cookies": "evästeet"},
    "hu": {"privacy": "adatvédelem", "policy": "szabályzat", "data_protection": "adatvédelem", "legal": "jogi", "terms": "feltételek", "cookies": "sütik"},
}

DETECTOR_TERMS = {
    "core": (
        "privacy policy", "privacy notice", "data protection", "personal data",
        "personal information", "data subject", "data controller", "data processor",
        "terms of service", "terms of use", "terms and conditions", "user agreement",
        "cookie policy", "cookie notice",
    ),
    "legal": (
        "gdpr", "ccpa", "cpra", "lgpd", "pipeda", "dpa", "vcdpa",
        "general data protection regulation", "california consumer privacy act",
        "virginia consumer data protection act", "colorado privacy act", "data protection act",
        "privacy act", "electronic communications", "e-privacy", "coppa",
        "children's online privacy protection",
    ),
    "dataHandling": (
        "collect", "collection", "process", "processing", "store", "storage", "retain",
        "retention", "delete", "deletion", "anonymize", "anonymization", "pseudonymize",
        "pseudonymization", "aggregate", "aggregation", "transfer", "disclose", "disclosure",
        "share", "sharing",
    ),
    "rights": (
        "consent", "withdraw consent", "opt-out", "opt out", "opt-in", "opt in", "right to access",
        "right to rectification", "right to erasure", "right to delete", "right to portability",
        "right to object", "data subject rights", "your rights", "user rights",
        "exercise your rights", "request deletion", "request access", "do not sell",
        "do not share",
    ),
    "thirdParty": (
        "third party", "third parties", "service provider", "service providers",
        "business partner", "affiliate", "affiliates", "vendor", "vendors", "advertising partner",
        "analytics provider", "subprocessor",
    ),
    "security": (
        "encryption", "encrypted", "ssl", "tls", "secure", "security measures", "data breach",
        "breach notification", "unauthorized access", "security safeguards", "protect your data",
        "protect your information",
    ),
    "cookies": (
        "cookie", "cookies", "tracking technology", "tracking technologies", "pixel", "pixels",
        "web beacon", "web beacons", "local storage", "session storage", "fingerprint",
        "fingerprinting", "device identifier",
    ),
    "structure": (
        "effective date", "last updated", "last modified", "revision date", "table of contents",
        "definitions", "scope", "applicability", "contact us", "how to contact",
        "questions about this", "changes to this", "updates to this", "modifications to this",
        "governing law", "jurisdiction", "dispute resolution", "arbitration",
        "limitation of liability", "indemnification", "warranty", "disclaimer",
    ),
}

DOCUMENT_TYPE_TERMS = {
    "privacy_policy": (
        "privacy policy", "privacy notice", "privacy statement", "data protection",
        "personal data", "personal information", "information we collect", "how we use your",
        "how we collect",
    ),
    "terms_of_service": (
        "terms of service", "terms of use", "terms and conditions", "user agreement",
        "service agreement", "acceptable use", "prohibited conduct", "your responsibilities",
        "account termination",
    ),
    "cookie_policy": (
        "cookie policy", "cookie notice", "use of cookies", "cookie statement", "cookies we use",
        "types of cookies", "cookie preferences",
    ),
    "data_processing_agreement": (
        "data processing agreement", "data processing addendum", "dpa", "subprocessor",
        "data processor", "standard contractual clauses",
    ),
}

HIGH_CONFIDENCE_TERMS = (
    "information", "data", "personal", "privacy", "cookies", "consent", "rights", "access",
    "legal", "collect", "security", "third-party", "protection", "processing", "law", "share",
    "delete", "control", "collected", "protect", "laws", "party", "parties", "daten",
    "datenschutz", "verarbeitung", "personenbezogenen", "einwilligung", "nutzung", "informationen",
    "speichern", "gespeichert", "rechte", "widerspruch", "löschung",
)

POLICY_BIGRAMS = (
    "personal data", "personal information", "data protection", "privacy policy", "data privacy",
    "applicable law", "privacy framework", "intellectual property", "legal obligations",
    "legitimate interest", "legitimate interests", "credit card", "social media",
    "contact information", "privacy rights", "law enforcement", "third party", "third parties",
    "information collect", "data collect", "share personal", "data collected",
    "personenbezogenen daten", "personenbezogene daten", "personenbezogener daten",
)

REQUIRED_TOPICS = {
    "en": (
        "personal data", "personal information", "data we collect", "information we collect",
        "how we use", "data processing", "data protection", "your rights", "third parties",
        "cookies", "retention", "security", "contact us", "data controller", "lawful basis",
        "consent",
    ),
    "de": (
        "personenbezogene daten", "daten erheben", "datenverarbeitung", "ihre rechte", "dritte",
        "cookies", "datenspeicherung", "datensicherheit", "kontakt", "verantwortlicher",
        "einwilligung", "widerspruch", "auskunft",
    ),
    "fr": (
        "données personnelles", "données collectées", "traitement des données", "vos droits",
        "tiers", "cookies", "conservation des données", "sécurité", "contact",
        "responsable du traitement", "consentement", "droit d'accès",
    ),
    "es": (
        "datos personales", "datos recogidos", "tratamiento de datos", "sus derechos", "terceros",
        "cookies", "conservación de datos", "seguridad", "contacto", "responsable del tratamiento",
        "consentimiento",
    ),
    "it": (
        "dati personali", "dati raccolti", "trattamento dei dati", "i tuoi diritti", "terzi",
        "cookies", "conservazione dei dati", "sicurezza", "contatto", "titolare del trattamento",
        "consenso",
    ),
    "pt": (
        "dados pessoais", "dados coletados", "tratamento de dados", "seus direitos", "terceiros",
        "cookies", "retenção de dados", "segurança", "contato", "controlador de dados",
        "consentimento",
    ),
    "nl": (
        "persoonsgegevens", "gegevens verzamelen", "gegevensverwerking", "uw rechten", "derden",
        "cookies", "bewaartermijn", "beveiliging", "contact", "verwerkingsverantwoordelijke",
        "toestemming",
    ),
    "ru": (
        "персональные данные", "собираемые данные", "обработка данных", "ваши права",
        "третьи лица", "cookies", "хранение данных", "безопасность", "контакты", "оператор данных",
        "согласие",
    ),
    "ja": (
        "個人情報", "収集する情報", "情報の利用", "お客様の権利", "第三者", "クッキー", "データ保持", "セキュリティ", "お問い合わせ", "データ管理者",
        "同意",
    ),
    "zh": (
        "个人信息", "收集的信息", "信息使用", "您的权利", "第三方", "cookies", "数据保留", "安全", "联系我们", "数据控制者", "同意",
    ),
    "ko": (
        "개인정보", "수집하는 정보", "정보의 이용", "귀하의 권리", "제3자", "쿠키", "데이터 보존", "보안", "문의", "데이터 관리자", "동의",
    ),
    "ar": (
        "البيانات الشخصية", "البيانات المجمعة", "معالجة البيانات", "حقوقك", "أطراف ثالثة",
        "ملفات تعريف الارتباط", "الاحتفاظ بالبيانات", "الأمان", "اتصل بنا", "مراقب البيانات",
        "الموافقة",
    ),
    "tr": (
        "kişisel veriler", "toplanan veriler", "veri işleme", "haklarınız", "üçüncü taraflar",
        "çerezler", "veri saklama", "güvenlik", "iletişim", "veri sorumlusu", "onay", "kvkk",
    ),
}

NEGATIVE_PATTERNS = (
    r"(?i)followers?\s*:\s*\d+", r"(?i)following\s*:\s*\d+", r"(?i)posts?\s*:\s*\d+",
    r"(?i)connections?\s*:\s*\d+", r"(?im)^\s*about\s+[A-Z][a-z]+\s+[A-Z][a-z]+\s*$",
    r"(?im)^\s*[A-Z][a-z]+\s+[A-Z][a-z]+\s*\|\s*LinkedIn", r"(?i)company\s+size\s*:\s*",
    r"(?i)industry\s*:\s*", r"(?i)headquarters\s*:\s*", r"(?i)founded\s*:\s*\d{4}",
    r"(?i)^(breaking|latest|news|article|story)\s*:",
    r"(?i)published\s+(on\s+)?\w+\s+\d{1,2},\s+\d{4}", r"(?im)by\s+[A-Z][a-z]+\s+[A-Z][a-z]+\s*$",
    r"(?i)min\s+read", r"(?i)share\s+(this\s+)?(article|story|post)", r"(?i)add\s+to\s+cart",
    r"(?i)buy\s+now", r"(?i)price\s*:\s*[$€£¥]", r"(?i)in\s+stock", r"(?i)out\s+of\s+stock",
    r"(?i)customer\s+reviews?\s*\(\d+\)", r"(?i)sign\s+in\s+with", r"(?i)log\s+in\s+to\s+continue",
    r"(?i)create\s+(an?\s+)?account", r"(?i)forgot\s+(your\s+)?password",
    r"(?i)don't\s+have\s+an?\s+account", r"(?i)similar\s+companies", r"(?i)related\s+companies",
    r"(?i)competitors", r"(?i)company\s+profile", r"(?i)business\s+profile",
)

POSITIVE_PATTERNS = (
    r"(?i)last\s+updated\s*:?\s*", r"(?i)effective\s+date\s*:?\s*", r"(?i)version\s*:?\s*\d",
    r"(?i)gdpr", r"(?i)general\s+data\s+protection\s+regulation", r"(?i)article\s+\d{1,2}",
    r"(?i)data\s+subject", r"(?i)lawful\s+basis", r"(?i)legitimate\s+interest",
    r"(?i)data\s+controller", r"(?i)data\s+processor", r"(?i)supervisory\s+authority",
    r"(?i)dpo|data\s+protection\s+officer", r"(?i)ccpa", r"(?i)california\s+consumer\s+privacy",
    r"(?i)do\s+not\s+sell", r"(?i)shine\s+the\s+light", r"(?i)california\s+resident", r"(?i)dsgvo",
    r"(?i)bundesdatenschutzgesetz", r"(?i)bdsg", r"(?i)telemediengesetz", r"(?i)tmg",
    r"(?i)what\s+information\s+(do\s+)?we\s+collect",
    r"(?i)how\s+(do\s+)?we\s+use\s+(your\s+)?information",
    r"(?i)how\s+(do\s+)?we\s+share\s+(your\s+)?information",
    r"(?i)your\s+(privacy\s+)?(rights|choices)", r"(?i)how\s+to\s+contact\s+us",
    r"(?i)data\s+retention", r"(?i)security\s+measures", r"(?i)children('s)?\s+privacy",
    r"(?i)international\s+transfers?", r"(?i)cookies?\s+(and|&)\s+tracking",
    r"(?i)table\s+of\s+contents", r"(?im)^\s*\d+\.\s+(introduction|scope|definitions)",
)

EVIDENCE_TERMS = (
    "privacy policy", "privacy notice", "data protection policy", "datenschutzerklärung",
    "datenschutzrichtlinie", "datenschutzhinweise", "politique de confidentialité",
    "política de privacidad", "informativa sulla privacy", "privacybeleid", "integritetspolicy",
    "we collect", "we may collect", "personal information", "personenbezogene daten",
    "datenerhebung", "datenverarbeitung", "your rights", "ihre rechte", "right to access",
    "right to erasure", "gdpr", "dsgvo", "ccpa", "lgpd", "pipeda", "data controller",
    "data processor", "personal data", "cookies we use", "information we collect",
    "how we protect",
)

EVIDENCE_PATTERNS = (
    r"(?i)what (information|data) (we|do we) collect", r"(?i)how we use your (data|information)",
    r"(?i)third.?part(y|ies)", r"(?i)cookie(s)? (policy|notice)", r"(?i)data retention",
    r"(?i)contact us.*privacy", r"(?i)welche daten.*erheben", r"(?i)wie.*verwenden.*daten",
    r"(?i)your (privacy )?choices", r"(?i)opt.?out", r"(?i)do not sell", r"(?i)effective date",
    r"(?i)last (updated|modified)",
)

DIRECT_PAGE_TERMS = (
    "privacy", "personal data", "personal information", "data protection", "collect information",
    "data we collect", "information we collect", "how we use", "your data", "your information",
    "datenschutz", "datenschutzerklärung", "datenschutzerklaerung", "datenschutzhinweise",
    "personenbezogene daten", "privacidad", "política de privacidad", "datos personales",
    "protección de datos", "confidentialité", "politique de confidentialité",
    "données personnelles", "protection des données", "privacy", "informativa privacy",
    "dati personali", "protezione dei dati", "privacidade", "política de privacidade",
    "dados pessoais", "privacybeleid", "privacyverklaring", "persoonsgegevens",
    "polityka prywatności", "dane osobowe", "конфиденциальность", "политика конфиденциальности",
    "персональные данные", "隐私", "隐私政策", "個人資料", "プライバシー", "プライバシーポリシー", "個人情報", "개인정보",
    "개인정보처리방침", "الخصوصية", "سياسة الخصوصية",
)

LOGIN_MARKERS = (
    "<input type=\"password\"", "sign in to continue", "log in to continue", "please log in",
    "login required", "authentication required", "enter your password",
)

LOGIN_MARKERS_PAIR = (
    "enter your password", "sign in to continue", "log in to continue", "create an account",
    "<input type=\"password\"", "forgot password",
)

GARBAGE_PHRASES = (
    "enable javascript", "browser not supported", "please update your browser", "access denied",
    "403 forbidden", "404 not found", "captcha", "verify you are human", "click here to continue",
)

ACTUAL_POLICY_TERMS = (
    "datenschutzerklaerung", "datenschutzerklarung", "datenschutzerklärung", "datenschutzhinweise",
    "datenschutzrichtlinie", "personenbezogene daten", "wir erheben", "wir verarbeiten",
    "verantwortlich", "betroffenenrechte", "datenverarbeitung", "rechtsgrundlage", "art. 6",
    "art. 13", "dsgvo", "auskunftsrecht", "löschung", "berichtigung", "privacy policy",
    "privacy statement", "privacy notice", "personal data", "we collect", "we process",
    "data controller", "your rights", "data subject", "gdpr", "article 6", "article 13",
    "right to access", "right to erasure", "right to rectification",
    "politique de confidentialité", "données personnelles", "nous collectons",
    "traitement des données", "droits des personnes", "rgpd", "política de privacidad",
    "datos personales", "recopilamos", "tratamiento de datos", "derechos de los usuarios", "rgpd",
)

HUB_PAGE_TERMS = (
    "übersicht", "uebersicht", "überblick", "ueberblick", "wählen sie", "waehlen sie", "auswahl",
    "themen", "overview", "select", "choose", "hub", "landing", "aperçu", "sélectionner",
    "choisir", "descripción general", "seleccionar",
)

TYPE_TERMS = {
    "privacy": (
        "collect", "personal data", "personal information", "information we collect",
        "data we collect", "privacy", "cookies", "third parties", "share", "your rights",
        "data protection", "processing", "consent", "datenschutz", "personenbezogene daten",
        "erheben", "verarbeitung", "einwilligung", "ihre rechte", "dritte", "speichern",
        "betroffene", "datos personales", "recopilar", "privacidad", "consentimiento",
        "données personnelles", "collecte", "traitement", "consentement",
    ),
    "terms": (
        "agreement", "license", "prohibited", "termination", "liability", "warranty", "indemnify",
        "governing law", "dispute", "arbitration", "user conduct", "acceptable use",
        "intellectual property", "nutzungsbedingungen", "haftung", "gewährleistung", "kündigung",
        "vereinbarung", "verboten", "streitigkeiten", "geistiges eigentum", "términos",
        "condiciones", "acuerdo", "responsabilidad", "conditions", "utilisation", "responsabilité",
        "accord",
    ),
    "cookies": (
        "cookie", "cookies", "tracking", "analytics", "advertising cookies", "session",
        "persistent", "third-party cookies", "opt-out", "consent", "tracking", "analyse",
        "werbecookies", "einwilligung",
    ),
    "security": (
        "security", "encryption", "protect", "secure", "vulnerability", "authentication",
        "access control", "safeguards", "breach", "incident", "sicherheit", "verschlüsselung",
        "schutz", "zugriff",
    ),
    "gdpr": (
        "gdpr", "european", "data subject", "right to erasure", "portability",
        "legitimate interest", "lawful basis", "processing", "controller", "processor", "dsgvo",
        "betroffenenrechte", "löschung", "datenübertragbarkeit",
    ),
    "ccpa": (
        "ccpa", "california", "do not sell", "opt-out", "consumer rights", "shine the light",
        "personal information", "categories", "disclosed",
    ),
    "ai": (
        "artificial intelligence", "machine learning", "ai", "model", "training data", "automated",
        "algorithm", "generative",
    ),
    "acceptable_use": (
        "acceptable use", "prohibited", "abuse", "spam", "harassment", "content policy",
        "community guidelines", "violations", "enforcement",
    ),
}

KEYWORD_INDICATORS = (
    "data", "privacy", "personal", "information", "consent", "collect", "process", "share",
    "third", "party", "cookie", "tracking", "gdpr", "ccpa", "right", "access", "delete",
    "retention", "security", "protect", "breach", "encrypt", "legal", "law", "regulation",
    "compliance", "controller", "processor", "transfer", "jurisdiction",
)

GATE_TEXT_TERMS = (
    "privacy", "personal data", "information we collect", "data protection", "gdpr", "datenschutz",
    "personenbezogene daten", "daten", "dsgvo", "personendaten", "confidentialité",
    "confidentialite", "données personnelles", "donnees personnelles", "rgpd", "privacidad",
    "datos personales", "protección de datos", "proteccion de datos", "privacyverklaring",
    "persoonsgegevens", "gegevensbescherming", "informativa sulla privacy", "dati personali",
    "privacidade", "dados pessoais",
)
