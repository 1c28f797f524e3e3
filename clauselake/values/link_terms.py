"""Paths, URL patterns and link texts that point to policies."""

# These lists must stay as they are for results to agree.

PRIVACY_PATHS = (
    "/privacy", "/privacy-policy", "/privacy-notice", "/privacy-statement", "/legal/privacy",
    "/policies/privacy", "/about/privacy", "/datenschutz", "/datenschutzerklaerung",
    "/datenschutzerklarung", "/datenschutz/datenschutzerklaerung",
    "/datenschutz/datenschutzerklarung", "/datenschutz/datenschutzhinweise",
    "/datenschutz/datenschutzrichtlinie", "/rechtliches/datenschutz",
    "/rechtliches/datenschutzerklaerung", "/legal/datenschutz", "/legal/datenschutzerklaerung",
    "/impressum/datenschutz", "/datenschutzhinweise", "/de/datenschutz",
    "/de/datenschutzerklaerung", "/de/privacy", "/de/privacy-policy", "/confidentialite",
    "/politique-de-confidentialite", "/vie-privee", "/mentions-legales", "/donnees-personnelles",
    "/privacidad", "/politica-de-privacidad", "/aviso-de-privacidad", "/legal/privacidad",
    "/proteccion-de-datos", "/privacy", "/informativa-privacy", "/riservatezza", "/privacy-policy",
    "/protezione-dati", "/privacidade", "/politica-de-privacidade", "/protecao-de-dados",
    "/privacy", "/privacybeleid", "/gegevensbescherming", "/privacy",
    "/politika-konfidencialnosti", "/konfidencialnost", "/privacy", "/kojin-joho",
    "/privacy-policy", "/privacy", "/yinsi", "/yinsi-zhengce", "/privacy", "/gaeinjeongbo",
    "/privacy-policy", "/privacy", "/siyasat-alkhususiya", "/gizlilik", "/gizlilik-politikasi",
    "/kvkk", "/aydinlatma-metni", "/prywatnosc", "/polityka-prywatnosci", "/ochrona-danych",
    "/integritet", "/integritetspolicy", "/dataskydd", "/personvern", "/personvernerklaering",
    "/privatliv", "/privatlivspolitik", "/databeskyttelse", "/tietosuoja", "/tietosuojaseloste",
    "/yksityisyys", "/soukromi", "/ochrana-osobnich-udaju", "/zasady-ochrany", "/adatvedelem",
    "/adatvedelmi-tajekoztato", "/privacy", "/aporreto", "/prostasia-dedomenon", "/privacy",
    "/mediniyut-fartiyut", "/privacy", "/นโยบายความเป็นส่วนตัว", "/quyen-rieng-tu",
    "/chinh-sach-bao-mat", "/privasi", "/kebijakan-privasi", "/privacy", "/gopaniyata-niti",
)

PRIVACY_URL_PATTERNS = (
    r"(?i)/privacy", r"(?i)/data[_-]?protection", r"(?i)/legal/privacy", r"(?i)/policies/privacy",
    r"(?i)/personal[_-]?data", r"(?i)/your[_-]?privacy", r"(?i)/datenschutz", r"(?i)/rechtlich",
    r"(?i)/impressum", r"(?i)/confidentialite", r"(?i)/mentions[_-]?legales",
    r"(?i)/vie[_-]?privee", r"(?i)/donnees[_-]?personnelles", r"(?i)/privacidad",
    r"(?i)/aviso[_-]?legal", r"(?i)/proteccion[_-]?datos", r"(?i)/riservatezza",
    r"(?i)/informativa", r"(?i)/protezione[_-]?dati", r"(?i)/privacidade",
    r"(?i)/protecao[_-]?dados", r"(?i)/privacybeleid", r"(?i)/gegevensbescherming",
    r"(?i)/integritet", r"(?i)/personvern", r"(?i)/privatliv", r"(?i)/tietosuoja",
    r"(?i)/dataskydd", r"(?i)/prywatnosc", r"(?i)/soukromi", r"(?i)/adatvedelem",
    r"(?i)/ochrana[_-]?udaju", r"(?i)/gizlilik", r"(?i)/kvkk", r"(?i)/aydinlatma",
    r"(?i)/aporreto", r"(?i)/prostasia", r"(?i)/kojin[_-]?joho", r"(?i)/gaein[_-]?jeongbo",
    r"(?i)/yinsi", r"(?i)/legal[/\?#]", r"(?i)[?&]page=privacy", r"(?i)[?&]p=privacy",
)

LINK_TEXTS = (
    "privacy policy", "privacy", "data protection", "data privacy", "privacy notice",
    "privacy statement", "your privacy", "legal", "terms & privacy", "privacy & terms",
    "privacy & cookies", "personal data", "personal information", "information we collect",
    "how we use information", "data we collect", "your rights", "third parties", "third-party",
    "cookies policy", "cookie policy", "data processing", "data controller", "data subject rights",
    "consent", "consent preferences", "privacy preferences", "gdpr", "ccpa", "california privacy",
    "do not sell", "datenschutz", "datenschutzerklärung", "datenschutzrichtlinie", "rechtliches",
    "impressum", "rechtliche hinweise", "personenbezogene daten", "verarbeitung",
    "datenverarbeitung", "einwilligung", "ihre rechte", "betroffenenrechte", "nutzung",
    "informationen", "datenschutzhinweise", "widerspruch", "löschung", "auskunft", "berichtigung",
    "verantwortlicher", "dsgvo", "cookies", "speicherung", "confidentialité",
    "politique de confidentialité", "vie privée", "mentions légales", "données personnelles",
    "protection des données", "privacidad", "política de privacidad", "aviso de privacidad",
    "aviso legal", "protección de datos", "datos personales", "privacy", "informativa privacy",
    "informativa sulla privacy", "protezione dei dati", "riservatezza", "note legali",
    "privacidade", "política de privacidade", "proteção de dados", "dados pessoais",
    "termos legais", "privacy", "privacybeleid", "privacyverklaring", "gegevensbescherming",
    "persoonsgegevens", "конфиденциальность", "политика конфиденциальности", "защита данных",
    "персональные данные", "プライバシー", "プライバシーポリシー", "個人情報", "個人情報保護", "個人情報の取り扱い", "隐私", "隐私政策",
    "隐私声明", "个人信息", "隱私", "隱私政策", "個人資料", "개인정보", "개인정보처리방침", "개인정보보호", "프라이버시", "정보보호",
    "الخصوصية", "سياسة الخصوصية", "حماية البيانات", "gizlilik", "gizlilik politikası",
    "kişisel verilerin korunması", "kvkk", "aydınlatma metni", "prywatność",
    "polityka prywatności", "ochrona danych", "integritet", "integritetspolicy", "dataskydd",
    "personvern", "personvernerklæring", "privatliv", "privatlivspolitik", "databeskyttelse",
    "tietosuoja", "tietosuojaseloste", "yksityisyys", "soukromí", "ochrana osobních údajů",
    "zásady ochrany", "adatvédelem", "adatvédelmi tájékoztató", "απόρρητο", "πολιτική απορρήτου",
    "προστασία δεδομένων", "פרטיות", "מדיניות פרטיות", "הגנת מידע", "นโยบายความเป็นส่วนตัว",
    "ความเป็นส่วนตัว", "quyền riêng tư", "chính sách bảo mật", "privasi", "kebijakan privasi",
)

FOOTER_LINK_TEXTS = (
    "privacy policy", "privacy", "data protection", "datenschutz", "privacidad", "confidentialité",
    "privacy notice", "privacy statement", "your privacy", "our privacy", "privacy & cookies",
    "privacy and cookies", "legal", "terms & privacy", "terms and privacy",
)

FOOTER_URL_PATTERNS = (
    r"(?i)/privacy", r"(?i)/privacypolicy", r"(?i)/privacy[_-]?policy",
    r"(?i)/data[_-]?protection", r"(?i)/legal/privacy", r"(?i)/policies/privacy",
    r"(?i)/about/privacy", r"(?i)/help/privacy", r"(?i)/datenschutz", r"(?i)/privacidad",
    r"(?i)/confidentialite", r"(?i)/privacy[_-]?notice", r"(?i)/privacy[_-]?statement",
    r"(?i)[?&]page=privacy", r"(?i)[?&]p=privacy", r"(?i)/legal[?&#]",
)

HOMEPAGE_TERMS = (
    "privacy", "data protection", "personal data", "data policy", "datenschutz",
    "datenschutzerklärung", "datenschutzrichtlinie", "impressum", "confidentialité", "vie privée",
    "données personnelles", "mentions légales", "privacidad", "protección de datos",
    "datos personales", "aviso legal", "privacy", "riservatezza", "protezione dei dati",
    "informativa", "privacidade", "proteção de dados", "dados pessoais", "privacy",
    "gegevensbescherming", "privacybeleid", "конфиденциальность", "защита данных",
    "персональные данные", "プライバシー", "個人情報", "個人情報保護", "隐私", "隐私政策", "个人信息", "隱私", "隱私政策", "개인정보",
    "개인정보처리방침", "프라이버시", "gizlilik", "kişisel veriler", "kvkk", "aydınlatma", "prywatność",
    "ochrona danych", "polityka prywatności", "integritet", "dataskydd", "personuppgifter",
    "personvern", "personopplysninger", "privatliv", "databeskyttelse", "persondata", "tietosuoja",
    "yksityisyys", "henkilötiedot", "soukromí", "ochrana údajů", "osobní údaje", "adatvédelem",
    "személyes adatok", "απόρρητο", "προστασία δεδομένων", "الخصوصية", "حماية البيانات", "פרטיות",
    "הגנת מידע", "ความเป็นส่วนตัว", "นโยบายความเป็นส่วนตัว", "quyền riêng tư", "bảo mật",
    "privasi", "perlindungan data",
)

EXACT_LINK_TEXTS = (
    "privacy policy", "privacy", "datenschutz", "confidentialité", "privacidad", "プライバシーポリシー",
    "隐私政策", "개인정보처리방침",
)

STANDARD_PATHS = (
    "/privacy", "/privacy-policy", "/legal/privacy", "/legal/privacy-policy", "/about/privacy",
    "/policies/privacy", "/policy", "/privacy/policy", "/terms", "/data-protection", "/security",
    "/privacypolicy", "/privacy_policy", "/datenschutz", "/politique-de-confidentialite",
    "/privacidad",
)

PRIORITY_PATHS = (
    "/privacy", "/privacy-policy", "/privacy/policy", "/legal/privacy", "/about/privacy",
    "/policies/privacy", "/privacy/center", "/privacycenter", "/help/privacy", "/privacypolicy",
    "/privacy_policy",
)

NESTED_PATHS = (
    "/datenschutzerklaerung", "/datenschutzerklarung", "/datenschutzhinweise",
    "/datenschutzrichtlinie", "/privacy-policy", "/details", "/vollstaendig", "/komplett",
    "/informationen", "/privacy-policy", "/privacy-statement", "/privacy-notice", "/full-policy",
    "/details", "/complete", "/politique-de-confidentialite", "/declaration-de-confidentialite",
    "/politica-de-privacidad", "/aviso-de-privacidad",
)

POLICY_TYPE_NAMES = {
    "privacy": "Privacy Policy",
    "terms": "Terms of Service",
    "cookies": "Cookie Policy",
    "security": "Security Policy",
    "gdpr": "GDPR Notice",
    "ccpa": "CCPA Notice",
    "ai": "AI/ML Terms",
    "acceptable_use": "Acceptable Use Policy",
}

POLICY_TYPE_PATHS = {
    "privacy": (
        "/privacy", "/privacy-policy", "/legal/privacy", "/legal/privacy-policy",
        "/data-protection", "/privacypolicy", "/about/privacy", "/policies/privacy",
        "/privacy/policy", "/help/privacy", "/policy/privacy", "/privacy_policy", "/info/privacy",
        "/customer/privacy", "/corporate/privacy", "/site/privacy",
    ),
    "terms": (
        "/terms", "/tos", "/terms-of-service", "/legal/terms", "/terms-and-conditions",
        "/termsofservice", "/user-agreement", "/policies/terms", "/about/terms", "/legal/tos",
        "/terms_of_service", "/terms-of-use", "/terms_and_conditions", "/eula",
    ),
    "cookies": (
        "/cookies", "/cookie-policy", "/legal/cookies", "/cookiepolicy", "/cookie-notice",
        "/policies/cookies", "/help/cookies", "/cookie_policy", "/cookies-policy",
    ),
    "security": (
        "/security", "/security-policy", "/legal/security", "/trust", "/trust-center",
        "/about/security", "/security-center", "/data-security",
    ),
    "gdpr": (
        "/gdpr", "/legal/gdpr", "/eu-privacy", "/european-privacy", "/privacy/gdpr", "/privacy-eu",
        "/europe-privacy",
    ),
    "ccpa": (
        "/ccpa", "/california-privacy", "/legal/ccpa", "/ca-privacy", "/your-privacy-choices",
        "/privacy/ccpa", "/do-not-sell", "/privacy-rights",
    ),
    "ai": (
        "/ai-terms", "/ai-policy", "/machine-learning-policy", "/legal/ai", "/ai-guidelines",
        "/generative-ai-terms", "/ai-usage", "/ml-policy",
    ),
    "acceptable_use": (
        "/acceptable-use", "/aup", "/legal/acceptable-use", "/usage-policy",
        "/community-guidelines", "/policies/community", "/community-standards", "/code-of-conduct",
    ),
}

PROBE_PATHS = {
    "privacy": (
        "/privacy", "/privacy-policy", "/privacypolicy", "/datenschutz",
    ),
    "terms": (
        "/terms", "/tos", "/terms-of-service", "/nutzungsbedingungen",
    ),
    "cookies": (
        "/cookies", "/cookie-policy",
    ),
    "security": (
        "/security", "/trust",
    ),
    "gdpr": (
        "/gdpr",
    ),
    "ccpa": (
        "/ccpa", "/privacy-rights",
    ),
    "ai": (
        "/ai-policy", "/ai-terms",
    ),
    "acceptable_use": (
        "/acceptable-use", "/aup",
    ),
}

TYPE_LINK_PATTERNS = {
    "privacy": (
        r"(?i)privacy\s*(policy|notice|statement)?", r"(?i)data\s*(protection|policy)",
        r"(?i)personal\s*(data|information)", r"(?i)datenschutz", r"(?i)privacidad",
        r"(?i)confidentialit[eé]",
    ),
    "terms": (
        r"(?i)terms\s*(of\s*)?(service|use|agreement)?", r"(?i)user\s*agreement",
        r"(?i)legal\s*(terms|agreement)", r"(?i)conditions?\s*(of\s*)?(use|service)?",
        r"(?i)subscriber\s*agreement", r"(?i)eula|end\s*user", r"(?i)nutzungsbedingungen",
        r"(?i)agb",
    ),
    "cookies": (
        r"(?i)cookie\s*(policy|notice|settings)?", r"(?i)cookies", r"(?i)tracking",
    ),
    "security": (
        r"(?i)security\s*(policy|center|info)?", r"(?i)trust\s*(center)?", r"(?i)data\s*security",
    ),
    "gdpr": (
        r"(?i)gdpr", r"(?i)eu\s*privacy", r"(?i)european?\s*(privacy|data)",
    ),
    "ccpa": (
        r"(?i)ccpa", r"(?i)california\s*(privacy|consumer)", r"(?i)do\s*not\s*sell",
        r"(?i)your\s*privacy\s*choices",
    ),
    "ai": (
        r"(?i)ai\s*(policy|terms|guidelines)?", r"(?i)machine\s*learning",
        r"(?i)artificial\s*intelligence",
    ),
    "acceptable_use": (
        r"(?i)acceptable\s*use", r"(?i)aup", r"(?i)community\s*(guidelines|standards)",
        r"(?i)user\s*guidelines", r"(?i)content\s*policy",
    ),
}

CRAWL_LINK_PATTERNS = {
    "privacy": (
        r"(?i)privacy\s*(policy|notice|statement)?", r"(?i)data\s*(protection|policy)",
        r"(?i)datenschutz", r"(?i)privacidad", r"(?i)confidentialit[eé]",
    ),
    "terms": (
        r"(?i)terms\s*(of\s*)?(service|use)?", r"(?i)user\s*agreement", r"(?i)nutzungsbedingungen",
        r"(?i)agb",
    ),
    "cookies": (
        r"(?i)cookie\s*(policy|notice)?", r"(?i)cookies",
    ),
    "security": (
        r"(?i)security\s*(policy)?", r"(?i)trust",
    ),
    "gdpr": (
        r"(?i)gdpr", r"(?i)eu\s*privacy",
    ),
    "ccpa": (
        r"(?i)ccpa", r"(?i)california", r"(?i)do\s*not\s*sell",
    ),
    "ai": (
        r"(?i)ai\s*(policy|terms)?", r"(?i)machine\s*learning",
    ),
    "acceptable_use": (
        r"(?i)acceptable\s*use", r"(?i)aup", r"(?i)community\s*guidelines",
    ),
}

HUB_URL_PATTERNS = (
    r"(?i)/legal/?$", r"(?i)/policies/?$", r"(?i)/legal/index", r"(?i)/about/legal/?$",
    r"(?i)/company/legal/?$",
)

TLD_LANGUAGES = {
    ".de": ("de",),
    ".at": ("de",),
    ".ch": ("de", "fr", "it",),
    ".fr": ("fr",),
    ".es": ("es",),
    ".it": ("it",),
    ".pt": ("pt",),
    ".br": ("pt",),
    ".nl": ("nl",),
    ".be": ("nl", "fr",),
    ".pl": ("pl",),
    ".ru": ("ru",),
    ".jp": ("ja",),
    ".cn": ("zh",),
    ".tw": ("zh-tw",),
    ".kr": ("ko",),
    ".se": ("sv",),
    ".dk": ("da",),
    ".no": ("no",),
    ".fi": ("fi",),
    ".cz": ("cs",),
    ".sk": ("sk",),
    ".hu": ("hu",),
    ".gr": ("el",),
    ".tr": ("tr",),
    ".ae": ("ar",),
    ".sa": ("ar",),
    ".il": ("he",),
}
