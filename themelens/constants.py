"""Fixed values.

Everything in this module must equal the behaviour we reproduce, so it is written out plainly, in its
natural order, and used as-is. Change nothing here to make a test pass.
"""

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: PII patterns (applied email -> phone -> card, in this order) and their masks.
# Java needs the (?U) flag so that \b, \d and \s are Unicode-aware like the original patterns.
# ---------------------------------------------------------------------------------------------
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE_PATTERN = r"\b(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
CARD_PATTERN = r"\b(?:\d[ -]*?){13,16}\b"
EMAIL_MASK = "[EMAIL_REDACTED]"
PHONE_MASK = "[PHONE_REDACTED]"
CARD_MASK = "[CARD_REDACTED]"

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: tokens are lower-cased runs of at least 5 word characters (letter, number, "_").
# ---------------------------------------------------------------------------------------------
TOKEN_PATTERN = r"[\p{L}\p{N}_]{5,}"

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: stop words, as listed (81 literals, 74 distinct; repeats are harmless).
# ---------------------------------------------------------------------------------------------
STOP_WORDS = (
    "about", "there", "their", "would", "could", "should", "please", "thanks",
    "thank", "groww", "application", "platform", "really", "useful", "helpful",
    "good", "great", "nice", "best", "fantastic", "goooooood", "awesome",
    "perfect", "superb", "love", "happy", "cool", "fine", "excellent", "super",
    "first", "second", "using", "every", "other", "another", "people", "users",
    "app", "apps", "very", "much", "more", "most", "some", "many", "just", "even",
    "like", "than", "this", "that", "with", "from", "your", "their", "them",
    "nice", "good", "fine", "okay", "star", "stars", "rate", "rating", "give",
    "given", "five", "four", "three", "two", "one", "zero", "would", "should",
    "could", "cannot", "cant", "wont", "dont", "doesnt",
)

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: word -> formal theme name (32 entries, in order).
# ---------------------------------------------------------------------------------------------
FUNCTIONAL_MAP = (
    ("useless", "Feature Maturity and Utility Concerns"),
    ("bad", "User Experience Friction Points"),
    ("excellent", "High General User Satisfaction"),
    ("fantastic", "High General User Satisfaction"),
    ("great", "High General User Satisfaction"),
    ("goooooood", "High General User Satisfaction"),
    ("good", "High General User Satisfaction"),
    ("awesome", "High General User Satisfaction"),
    ("superb", "High General User Satisfaction"),
    ("charges", "Transparency Regarding Transaction Fees"),
    ("charge", "Transparency Regarding Transaction Fees"),
    ("trading", "Platform Stability during Market Hours"),
    ("brokerage", "Transparency Regarding Transaction Fees"),
    ("option", "Friction in Derivative Trading Features"),
    ("options", "Friction in Derivative Trading Features"),
    ("update", "Post-Release App Performance Stability"),
    ("updates", "Post-Release App Performance Stability"),
    ("worst", "Technical Glitches and App Downtime"),
    ("waste", "Value Proposition and Utility Grievances"),
    ("slow", "App Performance and Latency Issues"),
    ("account", "Account Opening and Verification Hurdles"),
    ("accounts", "Account Opening and Verification Hurdles"),
    ("money", "Transaction Failures and Payment Concerns"),
    ("deposit", "Payment Gateway and Deposit Inquiries"),
    ("withdrawal", "Withdrawal Processing Latency Concerns"),
    ("withdraw", "Withdrawal Processing Latency Concerns"),
    ("support", "Customer Service and Query Resolution Efficiency"),
    ("interface", "User Interface Design and Aesthetics"),
    ("feature", "Functional Capabilities and Enhancement Requests"),
    ("features", "Functional Capabilities and Enhancement Requests"),
    ("loading", "Interface Rendering and Latency Issues"),
    ("server", "Backend Connectivity and Server Stability"),
)

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: keyword fallback groups, tested by substring of the lower-cased text, first match
# wins: group 0, then group 1, else group 2.
# ---------------------------------------------------------------------------------------------
FEE_WORDS = ("charge", "fee", "money", "cost", "brokerage", "payment")
STABILITY_WORDS = ("slow", "speed", "server", "update", "crash", "glitch", "login", "loading")
DEFAULT_KEYWORD_GROUPS = (FEE_WORDS, STABILITY_WORDS)

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: texts of the model-free theme path and of the fallback theme.
# ---------------------------------------------------------------------------------------------
UNMAPPED_NAME = "Analysis of {word} and Product Operations"        # {word} is title-cased
NO_WORD_NAME = "General Feedback and User Experience"
NO_WORD_PRIMARY = "App"
GROUP_SUFFIX = " (Group {letter})"                                   # A, B, C, ...
SENTENCE_1 = "Users frequently highlight issues and experiences related to {word} on the platform."
SENTENCE_2 = "Analysis indicates functional concerns and usability patterns around features like {words}."
NO_SECOND_WORDS = "overall app workflow"
IDEA_TITLE = "Optimize {word} Flow"
IDEA_DESCRIPTION = "Conduct a detailed review of usability and technical logs for the {word} component."
DEFAULT_THEME_NAME = "General Feedback"
DEFAULT_THEME_SUMMARY = "Analysis in progress..."
STRING_IDEA_TITLE = "Action Item"
FALLBACK_THEME_NAME = "General Feedback"
FALLBACK_THEME_SUMMARY = ("Analyzed {n} reviews. Common topics include app performance and user "
                          "experience.")
FALLBACK_IDEA_TITLE = "Review Performance"
FALLBACK_IDEA_DESCRIPTION = "Monitor app stability based on user volume."
THEME_NAME_MIN, THEME_NAME_MAX = 3, 100
TOP_THEMES = 5
TOP_TERMS = 10
PROMPT_REVIEWS = 40

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: report and message layout.
# ---------------------------------------------------------------------------------------------
REPORT_TITLE = "# Weekly Review Pulse — {product} — {week}"
REPORT_PERIOD = "**Period:** {window}"
REPORT_TOTAL = "**Total Reviews Analyzed:** {n}"
REPORT_ID = "**ID:** `{anchor}`"
REPORT_RULE = "\n---"
REPORT_TOP = "\n## Top Themes\n"
REPORT_NO_THEMES = "_No specific themes identified for this period._"
REPORT_THEME_HEAD = "### {i}. {name} ({n} reviews)"
REPORT_QUOTES_HEAD = "**Representative Quotes:**"
REPORT_QUOTE = '> "{text}"'
REPORT_IDEAS_HEAD = "**Product Action Ideas:**"
REPORT_IDEA = "- **{title}**: {description}"
LINES_ID = "ID: {anchor}\n"
LINES_TITLE = "Weekly Review Pulse — {product} — {week}\n"
LINES_META = "Period: {window}\nTotal Reviews Analyzed: {n}\n"
LINES_TOP = "\n--- Top Themes ---\n"
LINES_THEME_HEAD = "{i}. {name} ({n} reviews)\n"
LINES_QUOTES_HEAD = "Representative Quotes:\n"
LINES_QUOTE = '" {text} "\n'
LINES_IDEAS_HEAD = "Action Ideas:\n"
LINES_IDEA = "• {title}: {description}\n"
EMAIL_SUBJECT = "[Weekly Pulse] {product} — {week} — {top}"
EMAIL_NO_TOP = "General Updates"
EMAIL_TEXT_HEAD = "Weekly Pulse for {product} ({week})\n\nTotal Reviews: {n}\n\n"
EMAIL_TEXT_THEME = "{i}. {name}: {summary}\n"
EMAIL_TEXT_TAIL = "\nRead full report at: {link}"
DEFAULT_DATA_WINDOW = "Last 4 weeks"
