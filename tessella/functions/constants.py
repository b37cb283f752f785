"""Word lists, weights and limits that results depend on."""

# Query parameters that only track visitors.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ["fbclid", "gclid", "ref", "ref_src", "mc_cid", "mc_eid"]

# Ids in paths.
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"

# Navigation vocabulary.
NAV_IGNORE = ["www", "com", "org", "net", "home", "about", "contact", "press", "blog", "news", "post", "article", "resource", "resources", "privacy", "policy", "terms", "code", "ethics", "staff", "membership", "partnerships", "education", "advocacy", "conference", "conferences", "event", "events"]
NAV_SIGNAL = ["program", "agenda", "session", "sessions", "speaker", "speakers", "faculty", "presenter", "presenters", "abstract", "abstracts", "plenary", "poster", "posters", "oral", "schedule", "workshop", "workshops", "symposium", "symposia"]
NAV_EXCLUDE = ["housing", "hotel", "travel", "venue", "sponsor", "sponsors", "sponsorship", "exhibitor", "exhibit", "register", "registration", "book", "room", "donate", "press", "media", "career", "careers", "job", "jobs", "advertise", "advertising", "cookie"]
GENERIC_ANCHORS = ["view archives", "view archive", "view details", "learn more", "read more", "details"]
STOPWORDS = ["the", "and", "for", "with", "from", "this", "that", "your", "about", "home", "menu", "more", "page", "view", "read", "click", "here", "link", "site", "annual", "meeting", "conference", "conferences"]

# Words of an event's name.
EVENT_TERMS = ["annual meeting", "meeting", "summit", "conference", "congress", "forum", "symposium", "assembly", "expo", "workshop", "program"]

# Page intents.
GATEKEEPER = ["program", "agenda", "speaker", "speakers", "faculty", "presenter", "presenters", "session", "sessions", "cme", "abstract", "abstracts", "plenary", "scientific"]
UTILITY = ["travel", "hotel", "housing", "sponsor", "sponsorship", "exhibits", "registration", "faq", "about", "contact", "policy", "privacy"]
ARCHIVE = ["archive", "archives", "past", "previous", "history"]

# Sources.
SPEAKER_TERMS = ["speaker", "faculty", "presenter"]
PROGRAM_TERMS = ["program", "agenda", "schedule", "session"]
PLATFORM_CATEGORY = ["cvent", "swapcard", "whova", "eventsair", "mapyourshow", "rainfocus"]
PLATFORM_HOSTS = ["cvent", "swapcard", "whova", "grip.events", "eventsair", "mapyourshow", "rainfocus"]
LINK_WEIGHTS = {"speakers": 12, "speaker": 12, "faculty": 12, "presenters": 11, "presenter": 11, "agenda": 10, "program": 10, "schedule": 9, "sessions": 9, "session": 9, "abstract": 8, "symposium": 7, "workshop": 7, "scientific-program": 8, "brochure": 6, "pdf": 5}
SEED_WEIGHTS = {"speakers": 10, "speaker": 10, "faculty": 10, "presenter": 8, "agenda": 8, "program": 8, "schedule": 8, "sessions": 8, "session": 7, "abstract": 7, "symposium": 6, "workshop": 6}

# Searches and documents linked from a page.
SEARCH_SUFFIXES = ["speakers", "faculty", "program agenda schedule", "filetype:pdf program OR agenda OR brochure", "keynote plenary speakers"]
PDF_HINTS = ["pdf", "program", "agenda", "brochure", "abstract"]

# Blocks, roles and pages with folded parts.
NAV_NOISE = ["terms and conditions", "cancellation policy", "become a supporter", "hotel information", "conference program", "register now", "privacy policy"]
BLOCK_CREDENTIAL = r"\b([A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){1,3}),\s*(M\.?D\.?|D\.?O\.?|O\.?D\.?|Ph\.?D\.?|MBBS|MPH|MS|NP|PA-C|PA|RN|MSN|DNP|PharmD|FIDSA|FAAO|AAHIVS)\b"
TIME_MARKER = r"(?i)\b\d{1,2}:\d{2}\s*(AM|PM)\b"
SPEAKING_ROLES = ["speaker", "panelist", "moderator", "presenter", "chair", "cochair", "co-chair", "expert", "faculty"]
EXPANDABLE_INTENTS = ["gatekeeper", "listing", "session_detail"]
DYNAMIC_HINTS = ["aria-expanded", "aria-controls", 'role="tab"', "role='tab'", "accordion", "expand", "collapse", "toggle", "view session", "view faculty", "load more", "show more", "session-toggle", "speaker-toggle"]

# People.
PERSON_HINTS = ["md", "do", "od", "mbbs", "dr ", "dr.", "physician", "surgeon", "doctor", "ophthalm", "cardi", "neurolog", "hiv"]
CREDENTIALS = ["md", "do", "od", "mbbs", "phd", "facs", "faao", "frcs", "mph", "ms", "dnp", "rn", "np", "pa", "pac", "pharmd", "fidsa", "aahivs", "faahivs", "msph"]
DESIGNATIONS = {"MD": "MD", "M.D": "MD", "M.D.": "MD", "DO": "DO", "D.O": "DO", "D.O.": "DO", "OD": "OD", "O.D": "OD", "O.D.": "OD", "PHD": "PhD", "PH.D": "PhD", "PH.D.": "PhD", "MBBS": "MBBS", "MPH": "MPH", "MS": "MS", "MSC": "MSc", "RN": "RN", "DNP": "DNP", "NP": "NP", "PA": "PA", "PA-C": "PA-C", "PAC": "PA-C", "PHARMD": "PharmD", "FIDSA": "FIDSA", "AAHIVS": "AAHIVS", "FAAHIVS": "FAAHIVS", "FAAO": "FAAO", "FACS": "FACS", "FRCS": "FRCS", "MSPH": "MSPH"}
NAME_NOISE = ["hiv", "treatment", "session", "track", "workshop", "panel", "agenda", "program", "course", "lecture"]
NAME_NOISE_PAIRS = [("hiv", "treatment"), ("hiv", "the"), ("welcome", "from"), ("session", "overview")]
NAME_TOKEN = r"[A-Za-z][A-Za-z'\-\.]*"
CAPITAL_WORD = r"^[A-Z][A-Z0-9\-\.]{1,10}$"
NAME_WORD = r"^[A-Z][a-zA-Z'\-]+$"
NAME_STOPWORDS = ["conference", "program", "session", "agenda", "workshop", "panel", "track", "time", "zone"]
NON_PERSON = ["conference program", "general guidelines", "eastern standard", "central daylight", "time zone", "abstract submission", "conference registration", "program schedule"]
CREDENTIAL_NAME = r"\b([A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){1,3}),\s*(MD|M\.D\.?|DO|D\.O\.?|OD|O\.D\.?|PhD|Ph\.D\.?|MBBS|NP|PA-C|PA|RN|DNP|PharmD|MPH)\b"
DOCTOR_NAME = r"\bDr\.?\s+([A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){1,3})\b"
CONTEXT_NOISE = ["privacy policy", "terms and conditions", "all rights reserved", "copyright", "cookie policy", "advertisement", "sponsor", "sponsorship", "exhibitor", "exhibit hall", "housing", "hotel", "travel", "venue", "register now", "book your room", "newsletter", "donate", "press release"]

# Sessions and speakers in page text.
NON_NAME = ["session", "program", "agenda", "abstract", "workshop", "symposium", "moderator", "panel", "prevention", "treatment", "care", "landscape", "services", "service", "delivery", "strategies", "options", "discussion", "join", "login", "log", "membership", "education", "research", "practice", "privacy", "policy", "contact", "home", "event", "events", "resource", "resources", "programming", "explore", "learn", "connect", "guidelines", "compensation", "commercial", "interest", "entity", "bureau", "safety", "time", "central"]
NON_SESSION = ["join", "login", "log", "membership", "education", "research", "practice", "contact", "home", "search", "events", "event", "resources", "resource", "chat", "guidelines", "compensation", "commercial", "interest", "deadline", "submission", "upload", "instructions"]
NAME_SHAPE = r"(?:[A-Z]\.\s+)?[A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+)"
COLON_NAME_SHAPE = r"(?:[A-Z]\.?\s+)?[A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+)"
PERSON_NAME = r"^(?:[A-Z]\.\s+)?[A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){1,4}$"
SESSION_WORD = r"(?i)\b(session|keynote|plenary|symposium|workshop|lecture|panel|remarks|address)\b"
# JSON nodes; names in lower case.
PERSON_NAMES = [["name"], ["firstname", "lastname"]]
PERSON_FIELDS = ["bio", "title", "designation", "credentials", "affiliation", "organization", "company", "role"]
SESSION_NAMES = [["title"], ["sessiontitle"]]
SESSION_FIELDS = ["abstract", "description", "speakers", "presenters", "faculty", "agenda", "time"]
SIGNAL_KEYS = ["speakers", "presenters", "faculty", "sessions", "agenda", "bio", "abstract", "session", "speaker", "presenter"]

# HTML. (start tags, open tags that they end, tags that hide open ones from them).
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
RAW_TAGS = ["script", "style", "title", "textarea"]
BLOCK_TAGS = ["address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]
IMPLIED_ENDS = [
    (["address", "article", "aside", "blockquote", "center", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"], ["p"], ["button", "table", "td", "th", "caption"]),
    (["li"], ["li"], ["ul", "ol", "menu"]),
    (["dt", "dd"], ["dt", "dd"], ["dl"]),
    (["option"], ["option"], ["select", "datalist"]),
    (["optgroup"], ["optgroup", "option"], ["select"]),
    (["tr"], ["tr"], ["table"]),
    (["td", "th"], ["td", "th"], ["tr", "table"]),
    (["thead", "tbody", "tfoot"], ["thead", "tbody", "tfoot"], ["table"]),
]

# Main content and text blocks of a page.
MAIN_TAGS = ["main", "article"]
MAIN_IDS = ["content", "main"]
MAIN_CLASSES = ["content", "main-content", "event-content", "program-content"]
BLOCK_SELECTORS = ["*speaker", "*faculty", "*presenter", "*profile", "*bio", "*agenda", "*session", "article", "li"]
SPEAKER_HINTS = ["speaker", "faculty", "presenter", "moderator", "chair", "keynote", "physician", "doctor"]
SESSION_HINTS = ["session", "agenda", "program", "abstract", "workshop", "symposium", "panel", "lecture"]
ASSET_YEAR_URL = r"(?i)https?://[^\s)]*(?:wp-content|uploads|static|assets)[^\s)]*/(?:19\d{2}|20\d{2})/"
URL_TOKEN = r"(?i)https?://[^\s)]+"

# JSON in scripts; marker and source.
ASSIGNMENTS = [("__NUXT__", "nuxt"), ("__APOLLO_STATE__", "apollo_state"), ("drupalSettings", "drupal_settings"), ("dataLayer", "data_layer")]

# Speaker records.
NON_PERSON_PHRASES = ["conference program", "program committee", "eastern standard", "session objectives", "terms and conditions", "hotel information", "register now"]
CREDENTIAL_WORD = r"(?i)\b(MD|M\.D\.?|DO|D\.O\.?|OD|O\.D\.?|PhD|Ph\.D\.?|MBBS|NP|PA-C|PA|RN|DNP|PharmD|MPH)\b"

# Run metrics; counters and the metric that each one is shown as; stages of a run's state.
RUN_METRICS = ["pages_visited", "pages_enqueued", "unique_url_states", "frontier_size", "branch_count", "adaptive_budget_current", "adaptive_budget_max", "interaction_actions_total", "high_yield_branches", "pages_skipped_budget", "template_clusters_discovered", "speaker_candidates_found", "speaker_candidates_new", "normalized_speakers", "physicians_linked", "appearances_linked", "unresolved_attributions", "llm_calls", "llm_failures", "llm_calls_saved", "llm_batches_started", "llm_batches_completed", "llm_batches_timed_out", "stalls_recovered", "stalls_terminal", "repeated_state_skips", "gatekeeper_links_found", "modal_breaker_attempts", "modal_breaker_successes", "dynamic_pages_detected", "pathfinder_llm_calls", "pathfinder_llm_failures", "novelty_windows_without_progress", "markdown_pages_processed", "markdown_chars_processed", "markdown_segments_used", "memory_templates_hit", "memory_templates_promoted", "legacy_fallback_pages", "attribution_resolved_count", "attribution_reconcile_resolved_count", "attribution_final_unresolved_count", "pages_with_zero_speakers_nonzero_links", "branches_closed_no_links", "nav_reask_attempts", "nav_reask_successes"]
COUNTED_METRICS = {"linked_appearances": "appearances_linked", "unresolved_attributions": "unresolved_attributions", "llm_attempts": "llm_calls", "llm_failures": "llm_failures", "llm_calls_saved": "llm_calls_saved", "llm_batches_started": "llm_batches_started", "llm_batches_completed": "llm_batches_completed", "llm_batches_timed_out": "llm_batches_timed_out", "stalls_recovered": "stalls_recovered", "stalls_terminal": "stalls_terminal", "pathfinder_llm_attempts": "pathfinder_llm_calls", "pathfinder_llm_failures": "pathfinder_llm_failures", "attribution_resolved_count": "attribution_resolved_count", "attribution_reconcile_resolved_count": "attribution_reconcile_resolved_count", "attribution_final_unresolved_count": "attribution_final_unresolved_count"}
RUNNING_STAGES = ["run_start", "fetch_route", "crawl_fetch_start"]
TERMINAL_STAGES = ["complete", "partial", "error", "cancelled"]
CONTENT_SIGNALS = ["program", "agenda", "session", "speaker", "faculty", "presenter", "plenary", "abstract", "schedule", "workshop", "symposium"]

# Stages that may have a model of their own.
MODEL_STAGES = ["preflight", "identity", "triage", "extraction", "talk_brief", "navigation", "attribution", "enrichment"]
