"""Fixed values.

Everything in this module is a lookup table, word list, pattern, threshold or message
whose exact value defines the result of an operator.  There is no logic here; the
operators compile these values into ``Column`` expressions.

Patterns are plain text.  They are written in the common subset of Java, RE2 and
Python regular expressions and are matched without regard to case.
"""

# Categories, in the order that breaks score ties -------------------
CATEGORIES = [
    "Privacy & Data",
    "Payment",
    "Account",
    "Dispute",
    "Liability",
    "User Content",
    "Changes",
]
GENERAL = "General"

# Attention levels, strongest first ---------------------------------
HIGH = "High Attention"
MEDIUM = "Medium Attention"
LOW = "Low Attention"
INFORMATIONAL = "Informational"
LEVELS = [HIGH, MEDIUM, LOW, INFORMATIONAL]

# Relationship types ------------------------------------------------
RELATIONSHIP_TYPES = [
    "SUPPORTS",
    "QUALIFIES",
    "EXCEPTS",
    "OVERRIDES",
    "DEPENDS_ON",
    "TEMPORAL",
    "POTENTIAL_TENSION",
]

# Thresholds and limits ---------------------------------------------
CATEGORY_THRESHOLD = 0.32
SECONDARY_THRESHOLD = 0.28
SECONDARY_MARGIN = 0.18
HIGH_MIN_STRONG = 2
MEDIUM_MIN_STRONG = 1
RETRIEVAL_THRESHOLD = 0.35
RETRIEVAL_TOP_K = 5
SEMANTIC_PAIR_THRESHOLD = 0.55
MAX_PAIRS_PER_CLAUSE = 10
MAX_PAIRS_PER_DOCUMENT = 500
MIN_CONFIDENCE = 0.50
MAX_RELATIONSHIPS = 100
MAX_WORDS_PER_CLAUSE = 250
SWEEP_THRESHOLDS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55]

# Category affinity, read in both directions ------------------------
CATEGORY_AFFINITY = {
    "Payment": ["Account", "Changes"],
    "Account": ["Payment", "Privacy & Data", "User Content", "Dispute", "Changes"],
    "Privacy & Data": ["Account", "User Content"],
    "User Content": ["Account", "Privacy & Data", "Liability"],
    "Dispute": ["Liability", "Account"],
    "Liability": ["Dispute", "User Content"],
    "Changes": ["Payment", "Account", "Privacy & Data", "User Content", "Dispute", "Liability"],
}

# Category seed phrases ---------------------------------------------
CATEGORY_SEEDS = {
    "Privacy & Data": [
        "collection, gathering, and recording of personal user information and data",
        "sharing personal data, telemetry, and analytics with third party partners",
        "retention, storage, and deletion of user records and profile details",
        "cookies, tracking technologies, analytics, and privacy policy compliance",
        "processing personal data, behavioral monitoring, and data subjects",
    ],
    "Payment": [
        "subscription fees, billing schedules, and recurring payment charges",
        "automatic renewal of subscription and auto-renewing billing cycle",
        "non-refundable payments, refund policies, and transaction charges",
        "cancellation notice period, billing deadline, and payment terms",
        "credit card billing, invoicing, and unilateral price modifications",
        "monetary fees, financial consideration, and recurring payment cycles for access",
    ],
    "Account": [
        "user account registration, passwords, and security credentials",
        "immediate suspension or termination of user account and platform access",
        "account closure, cancellation of account, and permanent record deletion",
        "unauthorized access, compromised credentials, and account responsibility",
        "maintaining confidentiality of login details and user profile",
    ],
    "Dispute": [
        "mandatory binding arbitration and individual dispute resolution procedure",
        "class action lawsuit waiver and jury trial waiver agreement",
        "governing law, jurisdiction, venue, and legal dispute forum",
        "informal dispute negotiation, legal claims, and statute of limitations",
        "arbitration tribunal, dispute forum, and resolution of legal claims",
    ],
    "Liability": [
        "limitation of liability, damage cap, and maximum monetary liability",
        "disclaimer of warranties, as is basis, and as available service",
        "indemnification, defense, and hold harmless obligations by user",
        "exclusion of consequential, indirect, special, or punitive damages",
        "sole and exclusive remedy and limitation of recoverable damages",
    ],
    "User Content": [
        "ownership, copyright, and intellectual property rights in user content",
        "worldwide, perpetual, irrevocable, royalty-free license to use user content",
        "right to modify, adapt, publish, reproduce, and distribute user submissions",
        "user posted materials, submissions, and content infringement policy",
        "granting license to company to commercialize and display content",
    ],
    "Changes": [
        "unilateral modification and right to change these terms at any time",
        "updates, revisions, and amendments to terms without prior notice",
        "continued use of service constitutes binding acceptance of modified terms",
        "right to modify, alter, suspend, or discontinue services and features",
        "revisions and amendments effective immediately upon posting",
    ],
}

# Category keyword patterns -----------------------------------------
CATEGORY_PATTERNS = {
    "Privacy & Data": [
        r"\b(personal\s+(data|information)|privacy\s+policy|cookies|track(ing)?)\b",
        r"\b(third-part(y|ies)|data\s+retention|collect(ion|s)?\s+(of\s+)?(personal\s+)?data)\b",
        r"\b(usage\s+(logs|data)|telemetry|geolocation|biometric|data\s+subject)\b",
    ],
    "Payment": [
        r"\b(subscri(ption|be|ptions)|bill(ing)?|fee(s)?|auto-renew(al)?)\b",
        r"\b(renew(s|ed|al)?\s+automatic(ally)?|non-refundable|refund(s)?|charg(e|es|ed|ing))\b",
        r"\b(payment(s)?|credit\s+card|invoice|pricing|price\s+increase)\b",
    ],
    "Account": [
        r"\b(account(s)?|password(s)?|login|credentials)\b",
        r"\b(terminat(e|ion)\s+(of\s+)?(your\s+)?account|suspend\s+(your\s+)?account|suspension)\b",
        r"\b(unauthorized\s+access|delet(e|ion)\s+(of\s+)?(your\s+)?account|register\s+an\s+account)\b",
    ],
    "Dispute": [
        r"\b(arbitrat(e|ion|or|ors)|class\s+action\s+waiver|dispute(s)?)\b",
        r"\b(governing\s+law|jurisdiction|venue|court(s)?|litigat(e|ion))\b",
        r"\b(jury\s+trial\s+waiver|claim(s)?\s+shall\s+be\s+resolved|binding\s+individual\s+arbitration)\b",
    ],
    "Liability": [
        r"\b(limit(ation)?\s+of\s+liability|indemnif(y|ication)|hold\s+harmless)\b",
        r"\b(disclaim(er)?\s+of\s+warrant(y|ies)|consequential\s+damages|punitive\s+damages)\b",
        r"\b(as-is|as\s+is|aggregate\s+liability|maximum\s+liability|sole\s+remedy)\b",
    ],
    "User Content": [
        r"\b(user\s+content|user\s+submissions?|posted\s+content)\b",
        r"\b(perpetual|irrevocable|royalty-free|license\s+to\s+(use|reproduce|modify|distribute))\b",
        r"\b(grant\s+(us|the\s+company)\s+a\s+license|intellectual\s+property|copyright\s+infringement)\b",
    ],
    "Changes": [
        r"\b(modify\s+(these\s+)?terms|change(s)?\s+to\s+(these\s+)?terms|unilateral(ly)?)\b",
        r"\b(without\s+(prior\s+)?(individual\s+)?notice|at\s+any\s+time\s+without\s+notice)\b",
        r"\b(continued\s+use\s+constitutes\s+acceptance|amend(ment|s)?|right\s+to\s+modify)\b",
    ],
}

# Strong attention indicators (pattern, reason), in report order ----
STRONG_INDICATORS = [
    (r"\b(auto(matic(ally)?)?[\s\-]*renew(al|s|ed)?|recurring\s+bill(ing)?)\b",
     "Contains automatic renewal or recurring subscription billing"),
    (r"\b(non-refundable|no\s+refund(s)?|all\s+fees\s+are\s+final)\b",
     "Specifies that paid fees and charges are non-refundable"),
    (r"\b(at\s+least\s+\d+\s+days\s+prior|cancell(ation)?\s+notice\s+window|prior\s+to\s+(the\s+)?(expiration|renewal|billing))\b",
     "Imposes a specific advance notice deadline to prevent automatic renewal"),
    (r"\b(modify\s+pricing|change\s+(the\s+)?(fees|price|pricing)\s+at\s+any\s+time)\b",
     "Reserves the right to change fees or pricing unilaterally"),
    (r"\b(terminat(e|ion)\s+.*without\s+(prior\s+)?notice|suspend\s+.*without\s+(prior\s+)?notice|immediate(ly)?\s+.*without\s+notice)\b",
     "Allows immediate account suspension or termination without prior notice"),
    (r"\b(terminat(e|ion)\s+(of\s+)?(your\s+)?account\s+at\s+(our\s+sole\s+discretion|any\s+time)|suspend\s+(or\s+terminate\s+)?(your\s+)?account\s+at\s+any\s+time)\b",
     "Permits the company to terminate or suspend user accounts at any time"),
    (r"\b(without\s+(any\s+)?liability|for\s+any\s+reason\s+whatsoever|at\s+our\s+sole\s+discretion)\b",
     "Permits account action without liability or at sole company discretion"),
    (r"\b(permanently\s+delete|forfeit(ure)?\s+of\s+account|destroy\s+all\s+data)\b",
     "Specifies permanent account deletion or forfeiture upon termination"),
    (r"\b(binding\s+(individual\s+)?arbitrat(ion|or)|exclusive(ly)?\s+through\s+.*arbitrat(ion|or))\b",
     "Mandates binding individual arbitration in place of court proceedings"),
    (r"\b(class\s+action\s+waiver|waive\s+(any\s+right\s+to\s+participate\s+in\s+)?a\s+class\s+action|collective\s+arbitration|representative\s+action)\b",
     "Includes a waiver of the right to participate in class action lawsuits"),
    (r"\b(exclusive\s+jurisdiction\s+of|venue\s+in\s+[A-Za-z]+|courts\s+of\s+[A-Za-z]+)\b",
     "Restricts legal proceedings to a specific exclusive jurisdiction or venue"),
    (r"\b(aggregate\s+liability|liability\s+(shall\s+)?(not\s+)?exceed|limited\s+to\s+(\$?\d+|the\s+amount\s+paid)|exceed\s+\$?\d+)\b",
     "Caps maximum recoverable liability to a nominal amount or fees paid"),
    (r"\b(in\s+no\s+event\s+shall\s+.*be\s+liable\s+for\s+any\s+(special|indirect|consequential|punitive)\s+damages)\b",
     "Broadly disclaims liability for consequential, indirect, or punitive damages"),
    (r"\b(indemnify,\s+defend,\s+and\s+hold\s+harmless|agree\s+to\s+indemnify)\b",
     "Obligates user to indemnify and hold the company harmless from claims"),
    (r"\b(perpetual|irrevocable|royalty-free|worldwide,\s+perpetual)\b",
     "Grants a perpetual, irrevocable, or royalty-free license to user content"),
    (r"\b(sublicensable|transferable\s+license|right\s+to\s+(commercialize|exploit|modify|distribute))\b",
     "Permits the service to sublicense, modify, or commercially distribute user submissions"),
    (r"\b(share\s+(your\s+)?(personal\s+)?(data|information)\s+with\s+third\s+parties|disclose\s+to\s+(our\s+)?(partners|affiliates|third\s+parties))\b",
     "Permits sharing personal data with third-party partners or commercial affiliates"),
    (r"\b(retain\s+.*(after|following)\s+(account\s+)?(closure|termination)|indefinite(ly)?\s+retain|retain\s+.*for\s+up\s+to\s+\d+\s+years)\b",
     "Provides for prolonged or post-termination retention of personal data"),
    (r"\b(cross-site\s+tracking|behavioral\s+advertising|profile\s+your\s+activity)\b",
     "Discloses persistent user activity tracking or behavioral profiling"),
    (r"\b(modify\s+(or\s+replace\s+)?these\s+terms\s+.*without\s+(prior\s+)?(individual\s+)?notice|at\s+any\s+time\s+without\s+notice)\b",
     "Reserves the right to unilaterally modify terms without advance notice"),
    (r"\b(continued\s+use\s+.*constitutes\s+(binding\s+)?acceptance)\b",
     "Deems continued service use as binding acceptance of revised terms"),
]

# Weak attention indicators, looked at only without a strong one ----
WEAK_INDICATORS = [
    (r"\b(as-is|as\s+is|without\s+warranty\s+of\s+any\s+kind)\b",
     "Standard 'as-is' warranty disclaimer"),
    (r"\b(terms\s+may\s+be\s+updated|periodic(ally)?\s+review)\b",
     "General advice to review terms periodically for updates"),
    (r"\b(cookies\s+to\s+improve\s+experience|standard\s+cookies)\b",
     "Standard cookie notice for service functionality"),
]
NO_INDICATOR_REASON = "Standard informational clause without high-attention contractual indicators."

# Structure of a contract text --------------------------------------
SUBSECTION_LINE = r"^\s*(\d+\.\d+(?:\.\d+)*)\.?\s*[:\-\.]?\s*(.*)$"
MAJOR_LINE = r"^\s*(?:(?:SECTION|Section|ARTICLE|Article)\s+)?(\d+)\.?\s*[:\-\.]?\s*(.*)$"
LETTERED_LINE = r"^\s*([A-Z])\.\s+([A-Z0-9].*)$"
PAREN_LINE = r"^\s*\(([a-z0-9]+)\)\s*(.*)$"
UPPERCASE_LINE = r"^[A-Z0-9\s,\-\'&/]{4,60}$"
DOCUMENT_TITLE = r"\b(terms\s+of\s+service|terms\s+of\s+use|user\s+agreement|terms\s+and\s+conditions)\b"
INLINE_TITLE = r"^([A-Z][A-Za-z0-9\s/&,-]{2,45})[:\-]\s+(.*)$"
PAGE_NUMBER_LINE = r"^(?:page\s+\d+(?:\s+of\s+\d+)?|-?\s*\d+\s*-?)$"
MAX_MAJOR_WORDS = 12
MAX_SUB_WORDS = 10
MAX_LETTERED_WORDS = 10
MAX_TITLE_WORDS = 15
MAX_INLINE_TITLE_WORDS = 6

# Characters that cleaning and matching unify -----------------------
ZERO_WIDTH = "\u200b-\u200d\u2060\ufeff\u00ad\u200e\u200f\u202a-\u202e\u2066-\u2069"
EXOTIC_SPACES = "\u00a0\u2000-\u200a\u202f\u205f\u3000"
SINGLE_QUOTES = "\u2018\u2019\u201a\u201b`\u00b4"
DOUBLE_QUOTES = "\u201c\u201d\u201e\u201f\u00ab\u00bb"
LONG_DASHES = "\u2013\u2014"
ALL_HYPHENS = "\u2010-\u2015\u2212"

# References between sections ---------------------------------------
SECTION_REFERENCE = r"\b(?:Section|Article|Clause|Paragraph)\s+(\d+(?:\.\d+)*(?:\([a-zA-Z0-9]+\))?)"
SECTION_HEADING_NUMBER = r"^\s*(?:(?:SECTION|Section|ARTICLE|Article)\s+)?(\d+(?:\.\d+)*)\.?"

# Keywords that link clauses, in alphabetical order ------------------
DOMAIN_KEYWORDS = [
    "account", "arbitration", "billing", "cancel", "cancellation", "change", "content",
    "damage", "damages", "data", "dispute", "fee", "fees", "governing law", "liability",
    "license", "modification", "modify", "notice", "notify", "payment",
    "personal information", "privacy", "refund", "remedy", "renew", "renewal", "retain",
    "retention", "subscription", "suspend", "terminate", "termination", "waiver",
]

# Directed relationship triggers ------------------------------------
OVERRIDES = (
    r"\b(?:in the event of (?:any )?conflict|in case of conflict|in the event of inconsistency|"
    r"this (?:section|provision|agreement) shall (?:control|prevail|supersede|take precedence)|"
    r"supersedes (?:all )?(?:prior|other)|prevails over|shall control over)\b"
)
EXCEPTS = (
    r"\b(?:except (?:as|for|that|in)|with the exception of|"
    r"save for|unless otherwise (?:expressly )?stated|other than as provided)\b"
)
DEPENDS_ON = (
    r"\b(?:subject to (?:the terms of|section)?|conditional upon|conditioned upon|"
    r"contingent (?:on|upon)|only if|depending on|as (?:described|set forth|specified) in|"
    r"in accordance with (?:section)?|pursuant to (?:section)?)\b"
)
QUALIFIES = (
    r"\b(?:to the (?:maximum )?extent permitted by(?: applicable)? law|"
    r"without limiting (?:the generality of)?|"
    r"provided(?:, however,)? that|subject to applicable law|solely for the purpose of|"
    r"limited to)\b"
)
TEMPORAL = (
    r"\b(?:at least \d+ days prior|prior to (?:the )?(?:expiration|renewal|billing)|"
    r"suspend or terminate|terminate (?:your )?account|upon (?:account )?(?:termination|closure)|"
    r"after (?:account )?closure|retain (?:your )?(?:personal )?data|"
    r"for a period of (?:up to )?\d+|notice period|recurring (?:monthly|annual)|billing cycle)\b"
)

# Triggers of opposite statements -----------------------------------
CANCEL_ANYTIME = (
    r"\b(?:terminate your account at any time|cancel (?:your )?(?:subscription|account) at any time|"
    r"may cancel at any time|at any time through your account settings)\b"
)
STRICT_RENEWAL = (
    r"\b(?:automatically renew|billed in advance|at least \d+ days prior|non-refundable|"
    r"all (?:subscription )?fees.*non-refundable)\b"
)
MODIFY_NO_NOTICE = (
    r"\b(?:modify.*without (?:prior )?(?:individual )?notice|replace these terms.*without (?:prior )?notice|"
    r"without (?:prior )?notice or liability)\b"
)
NOTIFY_CHANGES = (
    r"\b(?:will notify (?:users|you)|prior notice before (?:material )?changes|"
    r"notice of (?:any )?(?:material )?change|\d+ days (?:prior )?notice of changes)\b"
)
IMMEDIATE_TERMINATION = (
    r"\b(?:suspend or terminate.*immediately, without notice|without notice or liability, for any reason)\b"
)
CURE_PERIOD = (
    r"\b(?:upon \d+ days (?:written )?notice|opportunity to cure|prior written notice of termination)\b"
)
NON_REFUNDABLE = r"\b(?:non-refundable|all fees (?:paid )?are final|no refunds)\b"
REFUND_ELIGIBLE = (
    r"\b(?:eligible for (?:a )?refund|money-back guarantee|prorated refund|refund will be issued)\b"
)

# Directed rules (type, confidence, rationale), {s} source, {t} target, {g} trigger
DIRECTED_RULES = [
    ("OVERRIDES", 0.85,
     "{s} contains explicit supremacy language ('{g}') establishing that it takes precedence over conflicting provisions in {t}."),
    ("EXCEPTS", 0.80,
     "{s} creates an explicit exception ('{g}') limiting the scope or applicability of provisions in {t}."),
    ("DEPENDS_ON", 0.78,
     "{s} contains an operational or conditional dependency ('{g}') governed by terms in {t}."),
    ("QUALIFIES", 0.72,
     "{s} qualifies or limits the scope of obligations or rights ('{g}') described in {t}."),
    ("TEMPORAL", 0.75,
     "{s} and {t} interact along a timeline ('{g}'), establishing sequential notice requirements, billing cycles, or post-termination retention horizons."),
]
SUPPORTS_RULE = ("SUPPORTS", 0.68, "{s} explicitly references and provides supporting details for {t}.")
SUPPORTS_TRIGGER = "Section reference in text"

# Opposite statements (first flag, second flag, confidence, trigger, rationale)
TENSION_RULES = [
    ("cancel", "renewal", 0.76, "cancel at any time vs advance renewal notice requirement",
     "{s} and {t} describe different cancellation timing conditions: one provision allows cancellation at any time while the other requires advance notice prior to auto-renewal."),
    ("modify", "notify", 0.82, "unilateral modification without notice vs notification of changes",
     "{s} states that the company reserves the right to modify terms without prior notice, while {t} references notifying users of material changes."),
    ("immediate", "cure", 0.78, "immediate termination without notice vs notice/cure period",
     "{s} and {t} describe differing procedures for account termination: immediate termination without notice alongside provisions indicating an advance notice or cure window."),
    ("final_fee", "refundable", 0.79, "non-refundable fee statement vs refund eligibility condition",
     "{s} specifies that fees are non-refundable, while {t} outlines circumstances for refund eligibility."),
]

# Titles and categories that carry no information -------------------
GENERIC_TITLES = ["general", "pasted text", "terms of service", "unknown"]
GENERIC_CATEGORIES = ["general", "unknown"]

# Words that a query token must not be ------------------------------
STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at",
    "be", "because", "been", "before", "being", "below", "between", "both", "but", "by", "can", "could", "did",
    "do", "does", "doing", "down", "during", "each", "few", "for", "from", "further", "had", "has", "have",
    "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "if", "in", "into", "is",
    "it", "its", "itself", "just", "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off",
    "on", "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "related",
    "relating", "same", "should", "so", "some", "such", "than", "that", "the", "their", "theirs", "them",
    "themselves", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until",
    "up", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will",
    "with", "would", "you", "your", "yours", "yourself",
]

# Query synonyms ----------------------------------------------------
SYNONYMS = {
    "safe": ["secure", "security", "protect", "protection", "safeguard", "confidential"],
    "safety": ["secure", "security", "protect", "protection", "safeguard"],
    "secure": ["safe", "security", "protect", "safeguard", "confidential"],
    "security": ["safe", "secure", "protect", "protection", "safeguard"],
    "protect": ["safe", "secure", "security", "safeguard"],
    "protection": ["safe", "secure", "security", "safeguard"],
    "data": ["information", "privacy", "personal", "content", "records"],
    "privacy": ["data", "information", "personal", "confidential"],
    "private": ["privacy", "data", "confidential"],
    "money": ["refund", "fee", "payment", "charge", "price", "billing", "cost"],
    "refund": ["money", "reimburse", "return", "payment", "charge", "fee"],
    "refunds": ["money", "reimburse", "return", "payment", "charge", "fee"],
    "pay": ["payment", "fee", "charge", "billing", "subscription", "cost"],
    "payment": ["fee", "charge", "billing", "subscription", "price", "refund"],
    "cancel": ["terminate", "discontinue", "end", "stop", "close", "cancellation"],
    "cancellation": ["cancel", "terminate", "discontinue", "end", "stop"],
    "delete": ["remove", "erase", "purge", "retention", "deletion"],
    "deletion": ["delete", "remove", "erase", "purge", "retention"],
    "sue": ["arbitration", "dispute", "court", "jury", "class action", "litigation"],
    "lawsuit": ["arbitration", "dispute", "court", "jury", "class action", "litigation"],
    "court": ["arbitration", "dispute", "jury", "class action", "litigation"],
}

# Conclusions that generated text must not draw ---------------------
FORBIDDEN_CONCLUSIONS = [
    r"\b(?:is|are)\s+(?:clearly\s+|definitely\s+|strictly\s+)?(?:illegal|unlawful)\b",
    r"\b(?:violates|in violation of)\s+(?:the\s+law|gdpr|statute|regulation)\b",
    r"\b(?:is|are)\s+(?:legally\s+)?(?:unenforceable|invalid|void(?:\s+and\s+without\s+effect)?)\b",
    r"\bbreaking\s+the\s+law\b",
    r"\bcourt\s+will\s+(?:strike\s+down|invalidate)\b",
]

# Messages ----------------------------------------------------------
REJECTED_EXPLANATION = "The generated explanation could not be validated against the supplied document evidence."
REJECTED_ANSWER = "The generated answer could not be validated against the supplied document evidence."
INSUFFICIENT = "The supplied Terms do not contain enough evidence to answer this question."

# Exposure domains (id, category, keywords) -------------------------
EXPOSURE_DOMAINS = [
    ("unilateral", "Changes", ["modify", "replace", "change", "discretion", "without notice"]),
    ("dispute", "Dispute", ["arbitration", "waive", "class action", "jury", "dispute"]),
    ("content", "User Content", ["license", "royalty-free", "perpetual", "sublicense", "derivative works"]),
    ("liability", "Liability", ["limitation of liability", "damages", "as is", "consequential"]),
]

# Words one of which every match of a pattern holds ------------------
# They let a cheap substring test rule a pattern out.  A pattern without an entry is
# always tried.
ANCHORS = {
    pattern: anchors for pattern, anchors in [
        *zip([p for p, _ in STRONG_INDICATORS], [
            ["renew", "recurring"], ["refund", "final"], ["prior", "window"], ["pric", "fees"], ["notice"],
            ["account"], ["liability", "whatsoever", "discretion"], ["permanently", "forfeit", "destroy"],
            ["arbitrat"], ["action", "collective"], ["jurisdiction", "venue", "courts"],
            ["liability", "limited", "exceed"], ["damages"], ["indemnify"],
            ["perpetual", "irrevocable", "royalty-free"], ["sublicensable", "transferable", "right"],
            ["share", "disclose"], ["retain"], ["cross-site", "behavioral", "profile"], ["notice"], ["acceptance"],
        ]),
        (WEAK_INDICATORS[1][0], ["updated", "review"]),
        (WEAK_INDICATORS[2][0], ["cookies"]),
        *zip(CATEGORY_PATTERNS["Privacy & Data"], [
            ["personal", "privacy", "cookies", "track"], ["third-part", "retention", "collect"],
            ["usage", "telemetry", "geolocation", "biometric", "subject"],
        ]),
        *zip(CATEGORY_PATTERNS["Payment"], [
            ["subscri", "bill", "fee", "auto-renew"], ["renew", "refund", "charg"],
            ["payment", "credit", "invoice", "pric"],
        ]),
        *zip(CATEGORY_PATTERNS["Account"], [
            ["account", "password", "login", "credentials"], ["account", "suspension"], ["unauthorized", "account"],
        ]),
        *zip(CATEGORY_PATTERNS["Dispute"], [
            ["arbitrat", "class", "dispute"], ["governing", "jurisdiction", "venue", "court", "litigat"],
            ["jury", "claim", "binding"],
        ]),
        *zip(CATEGORY_PATTERNS["Liability"][:2], [["liability", "indemnif", "harmless"], ["disclaim", "damages"]]),
        *zip(CATEGORY_PATTERNS["User Content"], [
            ["content", "submission"], ["perpetual", "irrevocable", "royalty-free", "license"],
            ["license", "intellectual", "copyright"],
        ]),
        *zip(CATEGORY_PATTERNS["Changes"], [
            ["terms", "unilateral"], ["notice"], ["acceptance", "amend", "modify"],
        ]),
        (CANCEL_ANYTIME, ["any time"]),
        (STRICT_RENEWAL, ["automatically renew", "billed in advance", "days prior", "non-refundable"]),
        (MODIFY_NO_NOTICE, ["notice"]),
        (NOTIFY_CHANGES, ["notify", "notice"]),
        (IMMEDIATE_TERMINATION, ["notice"]),
        (CURE_PERIOD, ["notice", "cure"]),
        (NON_REFUNDABLE, ["refund", "final"]),
        (REFUND_ELIGIBLE, ["refund", "money-back"]),
        (OVERRIDES, ["conflict", "inconsistency", "shall", "supersedes", "prevails"]),
        (EXCEPTS, ["except", "save for", "unless otherwise", "other than as provided"]),
        (DEPENDS_ON, [
            "subject to", "upon", "contingent", "only if", "depending on", "described in", "set forth in",
            "specified in", "in accordance with", "pursuant to",
        ]),
        (QUALIFIES, ["permitted by", "without limiting", "provided", "applicable law", "solely", "limited to"]),
        (TEMPORAL, [
            "days prior", "prior to", "terminate", "upon", "closure", "retain", "period", "recurring", "billing cycle",
        ]),
        (SECTION_REFERENCE, ["section", "article", "clause", "paragraph"]),
        (DOCUMENT_TITLE, ["terms", "agreement"]),
    ]
}
