"""Word lists, weights and patterns that results depend on."""

# Property types.
NON_RESIDENTIAL = ("parking", "garage", "land", "commercial", "office", "storage")
HOUSE_LIKE = (
    "house",
    "terraced",
    "detached",
    "semi detached",
    "semi-detached",
    "town house",
    "mews",
    "cottage",
    "bungalow",
    "end of terrace",
    "link detached house",
    "detached bungalow",
    "country house",
)
FLAT_LIKE = (
    "studio",
    "apartment",
    "apartments",
    "flat",
    "flats",
    "ground flat",
    "maisonette",
    "duplex",
    "penthouse",
    "serviced apartments",
    "serviced apartment",
    "flat share",
    "block of apartments",
    "block of apartment",
)
OTHER_TYPES = (
    "ask agent",
    "house share",
    "house of multiple occupation",
    "retirement property",
    "parking",
    "land",
    "private halls",
    "barn conversion",
    "barn",
    "garages",
    "hotel room",
    "off-plan",
    "park home",
    "retail property (high street)",
    "office",
)

# What counts as unknown.
UNKNOWN_TEXT = ("", "nan", "none", "ask agent")
UNKNOWN_CATEGORY = ("ask agent", "ask the agent", "unknown", "not provided", "not known", "n/a", "na")
BLANK_FIELD = ("ask agent", "", "none", "[]")
NOW_WORDS = ("now", "available now", "immediately", "immediate")

# Boolean signals (field, patterns for yes, patterns for no).
BOOL_SIGNALS = {
    "pets_allowed": ("pets_allowed", (r"\bpets?\s*(?:allowed|considered|friendly|welcome|accepted)\b", r"\bpet[- ]?friendly\b"), (r"\bno\s*pets?\b", r"\bpets?\s*not\s*(?:allowed|accepted|permitted)\b")),
    "garden": ("garden", (r"\b(?:private\s+)?garden\b", r"\brear\s+garden\b", r"\bcommunal\s+garden\b"), (r"\bno\s+garden\b",)),
    "parking": ("parking", (r"\b(?:off[- ]?street\s+)?parking\b", r"\bgarage\b", r"\bdriveway\b"), (r"\bno\s+parking\b",)),
    "bills_included": ("bills_included", (r"\bbills?\s*incl(?:uded)?\b", r"\ball\s*bills?\b"), (r"\bbills?\s*(?:not\s+included|excluded|extra|separate)\b", r"\bexcluding\s+bills?\b")),
    "student_friendly": ("student_friendly", (r"\bstudents?\s*(?:welcome|friendly|accepted|can\s+enquire)\b", r"\bstudent[- ]?friendly\b"), (r"\bno\s+students?\b", r"\bstudents?\s*not\s*(?:accepted|allowed)\b")),
    "families_allowed": (
        "families_allowed",
        (r"\bfamil(?:y|ies)\s*(?:welcome|friendly|accepted|allowed)\b", r"\bfamily[- ]?friendly\b"),
        (r"\bno\s+famil(?:y|ies)\b", r"\bfamil(?:y|ies)\s*not\s*(?:accepted|allowed)\b"),
    ),
    "smokers_allowed": ("smokers_allowed", (r"\bsmok(?:ing|ers?)\s*(?:allowed|permitted|ok)\b",), (r"\bno\s+smok(?:ing|ers?)\b", r"\bnon[- ]?smok(?:ing|ers?)\b")),
    "dss_accepted": (
        "dss_income_accepted",
        (r"\bdss\s*(?:accepted|welcome|ok|considered)\b", r"\bhousing\s*benefit\s*(?:accepted|welcome)\b", r"\buniversal\s*credit\s*(?:accepted|welcome)\b"),
        (r"\bno\s+dss\b", r"\bdss\s*not\s*(?:accepted|allowed)\b", r"\bhousing\s*benefit\s*not\b"),
    ),
}
SYNTHETIC_PHRASES = {
    "pets_allowed": ("pets allowed", "pet friendly"),
    "garden": ("has garden", "garden"),
    "parking": ("parking available", "off-street parking"),
    "bills_included": ("bills included", "all bills included"),
    "student_friendly": ("student friendly",),
    "families_allowed": ("family friendly", "families welcome"),
    "smokers_allowed": ("smoking allowed",),
    "dss_accepted": ("DSS accepted", "housing benefit accepted"),
}

# Red flags (boolean field, patterns that clear the flag, patterns that raise it).
RED_FLAGS = {
    "No DSS": (
        "dss_allowed",
        (
            r"(?<!\bno\s)dss\s*(welcome|accepted|ok|okay|considered|friendly)",
            r"(?<!\bno\s)housing\s+benefit\s*(welcome|accepted|ok|okay|considered)",
            r"(?:accept|welcome)s?\s+(?:dss|housing\s+benefit)",
            r"(?<!\bno\s)universal\s+credit\s*(welcome|accepted|ok|okay|considered)",
        ),
        (
            r"\bno\s+dss\b",
            r"dss\s+not\s+(?:accepted|considered|permitted)",
            r"\bno\s+housing\s+benefit",
            r"housing\s+benefit\s+not\s+(?:accepted|considered)",
            r"(?:cannot|can'?t|unable\s+to)\s+accept\s+(?:dss|housing\s+benefit)",
            r"\bno\s+(?:universal\s+credit|uc)\b",
        ),
    ),
    "No pets": (
        "pets_allowed",
        (r"(?<!\bno\s)pets?\s*(welcome|friendly|allowed|accepted|ok|okay|considered|negotiable)", r"(?:accept|welcome|allow)s?\s+pets?", r"pet[- ]friendly"),
        (r"\bno\s+pets?\b", r"pets?\s+not\s+(?:allowed|permitted|accepted|considered)", r"(?:cannot|can'?t|unable\s+to)\s+(?:accept|allow|accommodate)\s+pets?", r"unfortunately.*pets?\b"),
    ),
    "No deposit protection": (
        None,
        (r"deposit\s+(?:protected|registered|held)\s+(?:with|by|in)\s+(?:tds|dps|mydeposits|tenancy\s+deposit\s+scheme)",),
        (r"deposit\s+(?:not\s+)?protected", r"(?:unprotected|no\s+protection)\b.*deposit", r"deposit\s+held\s+by\s+(?:landlord|agent)", r"\bno\s+(?:tenancy\s+)?deposit\s+(?:scheme|protection)"),
    ),
    "Guarantor required": (None, (), (r"\bguarantor\s+(?:required|needed|essential|must|necessary)", r"(?:must|need\s+to|required\s+to)\s+(?:provide|have)\s+(?:a\s+)?(?:uk\s+)?guarantor")),
}

# Feature bullets for boolean fields (yes, no), and amenity names for embedding texts.
FEATURE_LABELS = (
    ("garden", "Garden", "No Garden"),
    ("parking", "Parking", "No Parking"),
    ("fireplace", "Fireplace", "No Fireplace"),
    ("bills_included", "Bills Included", "Bills Not Included"),
    ("pets_allowed", "Pets Allowed", "No Pets Allowed"),
    ("student_friendly", "Student Friendly", "Students Not Accepted"),
    ("families_allowed", "Families Allowed", "Families Not Accepted"),
    ("smokers_allowed", "Smokers Allowed", "No Smoking"),
    ("dss_covers_rent", "DSS/Housing Benefit Accepted", "DSS/Housing Benefit Not Accepted"),
)
AMENITY_LABELS = (
    ("pets_allowed", "pets allowed"),
    ("garden", "garden"),
    ("parking", "parking"),
    ("fireplace", "fireplace"),
    ("bills_included", "bills included"),
    ("student_friendly", "student friendly"),
    ("families_allowed", "families allowed"),
    ("dss_covers_rent", "DSS accepted"),
)

# Record merging.
EXTRA_FIELDS = ("bills_included", "student_friendly", "families_allowed", "pets_allowed", "smokers_allowed", "dss_covers_rent", "garden", "parking", "fireplace", "epc_rating")
BACKFILL_FIELDS = ("deposit", "deposit_amount", "available_from", "min_tenancy", "furnish_type", "let_type", "council_tax", "stations", "description", "image_url", "image_urls")
MATCH_METRES, MATCH_PRICE = 10.0, 100

# Ranking.
UNKNOWN_PENALTIES = {
    "price": 0.20,
    "bedrooms": 0.16,
    "bathrooms": 0.12,
    "available_from": 0.14,
    "furnish_type": 0.08,
    "let_type": 0.10,
    "min_tenancy_months": 0.08,
    "min_size_sqm": 0.10,
    "property_type": 0.12,
}
UNKNOWN_PENALTY_CAP = 0.60
DEPOSIT_WEIGHT, FRESHNESS_WEIGHT, HEADROOM_WEIGHT, BOOL_WEIGHT = 0.05, 0.06, 0.10, 0.12
MISSING_SCORE, DEPOSIT_TAU, DEPOSIT_RATIO_TAU, HALF_LIFE_DAYS = 0.40, 3000.0, 2.0, 14.0
SQM_PER_SQFT, WEEKS_PER_YEAR, MONTHS_PER_YEAR = 0.092903, 52, 12
EARTH_KM, EARTH_M, KM_PER_DEGREE = 6371.0, 6_371_000.0, 111.32
BM25_K1, BM25_B = 1.5, 0.75
FIELD_WEIGHTS = {"schools": 1.00, "stations": 1.00, "features": 0.80, "description": 0.60}
INTENT_TOP_K, INTENT_HIT = 4, 0.45
#: The namespace of listing ids.
UUID_NAMESPACE = "a3b2c1d0e5f67890abcdef1234567890"

# Fields of high risk in arbitration, and what reviews look for.
HIGH_RISK_FIELDS = ("max_rent_pcm", "available_from", "let_type", "layout_options", "min_tenancy_months", "min_size_sqm")
ACROSS_PATTERN = r"\bwhich\s+(one|listing|property|of)\b"
UNSTATED_FEATURE = ("ask agent", "n/a", "none")
GOOD_NO_PATTERN = r"^no\s+((agent|admin|application|reference)\s+fee|deposit)"
FORBIDS_PATTERN = r"^no\s+|not\s+accepted|not\s+allowed"
DEPOSIT_PATTERN = r"deposit|upfront"
POINT_WEIGHTS = {
    "bedrooms": 4,
    "bathrooms": 4,
    "available_from": 3,
    "min_tenancy": 3,
    "deposit": 3,
    "council_tax": 2,
    "furnish_type": 2,
    "size": 1,
    "property_type": 1,
}
UNKNOWN_POINT = ("", "ask agent", "unknown", "n/a", "na", "not provided", "not known")

# Least letters of an alias, of a run of an alias' words, and of a name whose trailing digits are dropped.
LEAST_ALIAS, LEAST_RUN, LEAST_DIGITS = 3, 6, 6

# Short forms of stations, and the names they stand for.
STATION_ABBREVIATIONS = {
    "kings x": "kings cross st pancras",
    "kings cross": "kings cross st pancras",
    "st pancras": "kings cross st pancras",
    "liverpool st": "liverpool street",
    "paddington stn": "paddington",
    "waterloo stn": "waterloo",
    "euston stn": "euston",
    "victoria stn": "victoria",
    "bank stn": "bank",
    "old st": "old street",
    "tottenham ct rd": "tottenham court road",
    "tcr": "tottenham court road",
    "elephant": "elephant & castle",
    "the city": "bank",
    "canary whf": "canary wharf",
}

# Headings of the second portal's sections, and the section of a label where a page has no such heading.
SECTIONS = {
    "price_bills": ("price & bills", "price and bills", "price"),
    "availability": ("availability",),
    "tenant_preference": ("tenant preference", "tenant preferences"),
    "features": ("features", "property features"),
}
SECTION_LABELS = {
    "price_bills": ("deposit", "rent_pcm", "bills_included", "broadband"),
    "availability": ("available_from", "available", "minimum_tenancy", "min_tenancy"),
    "tenant_preference": ("student_friendly", "families_allowed", "pets_allowed", "smokers_allowed", "dss_lha_covers_rent", "dss_covers_rent"),
    "features": ("garden", "parking", "fireplace", "furnishing", "epc_rating"),
}
# Labels that a listing's fields are read from; all others are extras.
KNOWN_LABELS = (
    "deposit", "rent_pcm", "bills_included", "broadband",
    "available_from", "available", "minimum_tenancy", "min_tenancy", "min__tenancy",
    "student_friendly", "families_allowed", "pets_allowed", "smokers_allowed",
    "dss_lha_covers_rent", "dss_covers_rent", "dss_income_accepted",
    "online_viewings", "live_in_landlord",
    "garden", "parking", "fireplace", "furnishing", "epc_rating", "epc_not_required",
    "council_tax", "council_tax_band",
)
# What ticks and crosses in a cell, and marks that a child holds no label.
TICK_CLASSES, CROSS_CLASSES = ("fa-check-circle", "fa-check", "glyphicon-ok", "icon-check"), ("fa-times-circle", "fa-times", "glyphicon-remove", "icon-times")
TICK_CHARS, CROSS_CHARS = ("✓", "✔", "☑"), ("✗", "✘", "☒")
TICK_IMAGES, CROSS_IMAGES = ("tick", "check", "yes", "true"), ("cross", "times", "no", "false")
TICK_WORDS, CROSS_WORDS = ("yes", "true", "included", "allowed"), ("no", "false", "not included", "not allowed")
TOOLTIP_ATTRS = ("data-content", "data-toggle", "data-tip", "data-placement", "data-original-title", "data-html", "data-bs-toggle", "data-bs-content", "data-bs-content-id")
TOOLTIP_CLASSES = ("d-none", "tooltip", "info-icon", "help", "hint", "popover", "or-icon")
# Texts of the second portal that mean unknown.
UNKNOWN_CELL = ("ask agent", "ask the agent", "not provided", "not known", "unknown", "n/a", "na", "-", "—", "tbc", "tba", "", "none")
# Texts of the first portal's controls, what separates paragraphs, and where the description and a field end.
DESCRIPTION_NOISE = ("read full description", "read more", "show more", "show less", "read less", "collapse", "expand")
PARAGRAPH = " <PARA> "
LONGEST_FEATURE = 200
# Lines that stand among places nearby, and how they begin or end.
NEARBY_STOPS = ("show more on map", "my places", "stations", "schools", "nearest stations", "nearest schools")
NEARBY_KINDS = ("type:", "rating:", "ofsted:", "state school", "independent school")
MILES_PER_MINUTE = 0.05
# Where the second portal's pages hold a description, and the least letters of one.
DESCRIPTION_PLACES = (".description-text", "#description", "[itemprop='description']", ".property-description", ".desc", ".listing-description", "[data-description]", ".more-text", ".full-description")
DESCRIPTION_SPANS = ("more-text", "read-more-text", "description-more", "full-text")
DESCRIPTION_AREAS = (".description-text", "#description", ".property-description", ".listing-description")

# Evidence of a category, the fields that it may come from, and values that count as empty there.
EVIDENCE_TOP = 4
CATEGORY_FIELDS = {
    "school": ("schools", "description"),
    "transit": ("stations", "description"),
    "amenity": ("features", "description"),
    "general": ("features", "description", "schools", "stations"),
}
EMPTY_VALUES = ("", "none", "null", "n/a", "na", "unknown", "not provided", "ask agent")
UNSTRUCTURED_FIELDS = ("description", "features")

# How requests name layouts, budgets of layouts, property types and dates, and how far a budget may stand from its layout.
LAYOUT_PAIR = r"\b(\d+(?:\.\d+)?)\s*(?:bed(?:room)?s?|bd|br|b)\s*[/,-]?\s*(\d+(?:\.\d+)?)\s*(?:bath(?:room)?s?|ba|b)\b"
LAYOUT_BEDS = r"\b(\d+(?:\.\d+)?)\s*[- ]?\s*(?:bed(?:room)?s?|bd|br|b)\b"
LAYOUT_BATHS = r"\b(\d+(?:\.\d+)?)\s*[- ]?\s*(?:bath(?:room)?s?|ba)\b"
LAYOUT_BUDGETS = (
    r"(?:under|below|max(?:imum)?|up\s*to|within|at\s*most|budget)\s*£?\s*([0-9][0-9,]*(?:\.\d+)?)",
    r"£\s*([0-9][0-9,]*(?:\.\d+)?)\s*(?:pcm|per\s*month|p/?m|pm)\b",
    r"\b([0-9][0-9,]*(?:\.\d+)?)\s*(?:pcm|per\s*month|p/?m|pm)\b",
)
LAYOUT_SEPARATOR = r"\b(?:and|or)\b|[,;]"
LAYOUT_REACH = 48
REMOVE_WORDS = r"\b(?:remove|drop|delete|clear)\b"
FLAT_WORDS = r"\b(?:flats?|apartments?|apts?)\b"
HOUSE_WORDS = r"\b(?:house|detached|semi[- ]?detached|town\s*house|terraced|mews|cottage|bungalow)\b"
DATE_PREFIXES = r"by|before|no\s+later\s+than|latest(?:\s+move[- ]?in|\s+start)?(?:\s+date)?|available\s*from|starting\s*from|start(?:ing)?\s*from|starting|start\s*date|from"
MONTHS = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*"

# Weights of a side table's fields.
SEGMENT_WEIGHTS = {"features": 0.80, "description": 0.60}

# How requests name where somebody works or travels, what ends such a name, list marks, and terms that amenities cover.
DESTINATION_END = r"(?:\s*[,.]|\s+and\s+|\s+under\s+|\s+below\s+|\s+max\s+|\s+budget|\s+for\s+|\s+with\s+|\s*$)"
DESTINATIONS = (
    r"\b(?:i\s+)?work\s+(?:at|near|in|around|by|close\s+to)\s+(.+?)" + DESTINATION_END,
    r"\bcommut(?:e|ing)\s+to\s+(.+?)" + DESTINATION_END,
    r"\boffice\s+(?:at|near|in|around)\s+(.+?)" + DESTINATION_END,
    r"\btravel(?:ling)?\s+to\s+(.+?)(?:\s+(?:every|daily|for work))(?:\s*[,.]|\s*$)",
)
LIST_MARK = r"^[\-–•]\s*"
SKIPPED_FEATURES = ("ask agent", "n/a", "none", "")
COVERED_TERMS = {
    "pets_allowed": r"\bpets?\b|pet.?friendly",
    "garden": r"\bgarden\b",
    "parking": r"\bparking\b|\bgarage\b|\bdriveway\b",
    "bills_included": r"\bbills?\b",
    "student_friendly": r"\bstudent",
    "families_allowed": r"\bfamil",
    "smokers_allowed": r"\bsmok",
    "dss_accepted": r"\bdss\b|\bhousing.benefit\b|\buniversal.credit\b",
}
DAYS_LATER = 14
