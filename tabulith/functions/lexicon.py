"""Fixed values of the bulletin domain: word lists, phrases, patterns and weights.  Other domains bring their own."""

from __future__ import annotations

# Month names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]

# Words that are no keywords.
STOPWORDS = """the a an and or of to in for from on by what which when where how much many was were is are did does do with at as that this these
those using based according reported specifically only calendar monthly individual values between fiscal year years month months treasury bulletin table amount
value number nominal dollars millions billions trillions report question given reporting date provided all associated activities activity corresponding
rounded nearest hundredths place just each inclusive including not""".split()

# If the pattern is found, the phrases become keywords.
EXPANSIONS = [
    (r"\btreasury balance\b", ["treasury balance", "operating cash balance", "status of treasury", "cash balance"]),
    (r"\bpublic debt\b", ["public debt", "debt outstanding", "interest-bearing debt", "public debt outstanding"]),
    (r"\b(receipts?|federal receipts|budget receipts)\b", ["federal receipts", "budget receipts", "receipts by source", "total receipts"]),
    (r"\b(outlays?|budget outlays)\b", ["budget outlays", "federal outlays", "outlays by function", "total outlays"]),
    (r"\bexchange stabilization fund\b|\besf\b", ["exchange stabilization fund", "esf", "foreign currency holdings"]),
    (r"\boptions? positions?\b", ["options positions", "net options positions"]),
    (r"\bsecurities\b", ["securities outstanding", "marketable securities", "treasury securities"]),
]

# Phrases that name a table's subject, in order of preference.
FOCUS = [
    r"\bnational defense expenditures\b",
    r"\bnational defense and related activities\b",
    r"\bnational defense\b",
    r"\bveterans administration\b",
    r"\bpublic works\b",
    r"\bgross federal debt\b",
    r"\bpublic debt\b",
    r"\bdebt outstanding\b",
    r"\bsummary of public debt\b",
    r"\bindividual income tax receipts\b",
    r"\binternal revenue collections\b",
    r"\bfederal receipts\b",
    r"\bbudget outlays\b",
    r"\bnet options positions\b",
    r"\bforeign exchange and securities investments\b",
    r"\bjapanese yen\b",
    r"\bbritish pound\b",
    r"\bexchange stabilization fund\b",
    r"\b13-week\b",
    r"\b26-week\b",
    r"\b2-year treasury notes?\b",
    r"\btreasury[- ]bill rates?\b",
    r"\baccepted tenders\b",
    r"\bamount of bids accepted\b",
    r"\bnoncash rollover tenders\b",
    r"\bcompetitive\b",
    r"\bnoncompetitive\b",
    r"\baverage issuing rate\b",
    r"\binvestment rate\b",
    r"\bdiscount rate\b",
    r"\bequivalent coupon issue yield\b",
    r"\bofferings of bills\b",
    r"\bdescription of securities\b",
    r"\ball other investors\b",
    r"\bamount outstanding\b",
    r"\bmarketable securities\b",
    r"\binterest[- ]bearing marketable public debt securities\b",
    r"\bclaims owed\b",
    r"\bclaims on foreigners\b",
    r"\btotal claims by type and country\b",
    r"\btotal liabilities by type and country\b",
    r"\bpublic offerings of marketable securities other than regular weekly treasury bills\b",
]

# If a question has one of the phrases, the words are no keywords.
NEGATIVE = [
    (["revolving fund"], ["revolving", "funds", "fund"]),
    (["trust fund accounts", "trust accounts", "transfers to trust"], ["trust", "accounts", "account", "transfers"]),
    (["territories"], ["territories"]),
    (["regional aggregate"], ["regional", "aggregate", "aggregates"]),
]

# Question features that hold if the lowered question contains one of the phrases.
FEATURES = {
    "expects_list": ["list the", "provide the list", "inside square brackets", "enclosed brackets", "containing 2 numbers", "containing 12 numbers"],
    "expects_regression": ["ordinary least squares", "linear regression", "fit a regression", "slope and intercept"],
    "expects_series_math": ["geometric mean", "arithmetic mean", "weighted average", "weighted mean", "average", "mean", "median", "variance", "standard deviation", "std. dev", "std dev", "correlation", "volatility"],
    "asks_date": ["which date", "what date", "issue date", "report your answer in the u.s. long date format", "which march", "which month", "what month", "which year", "what year"],
    "expects_percent": ["percent", "percentage", "%"],
    "expects_difference": ["difference", "gap", "spread", "minus", "absolute change"],
    "expects_sum": ["sum of", "sum the", "total sum", "using all monthly values", "all individual calendar months", "add up", "combined total from all"],
    "no_lookup": ["sum of", "difference", "gap", "regression", "geometric mean", "average", "mean", "weighted average", "median", "correlation", "standard deviation", "variance", "list the", "inside square brackets", "containing", "which date"],
    "wants_full_number": ["full number"],
    "mentions_veterans_admin": ["veterans administration", "veterans' administration"],
    "include_public_works": ["public works"],
    "exclude_revolving": ["revolving fund"],
    "exclude_trust_accounts": ["trust fund accounts", "trust accounts", "transfers to trust"],
    "exclude_territories": ["territories"],
    "exclude_regional_aggregates": ["regional aggregate"],
    "wants_calendar_year": ["calendar year", "calendar yr"],
    "asks_monthly": ["all individual calendar months", "monthly values", "each year from", "comma separated list", "each month", "for each month", "month from"],
    "wants_auction_bid_data": ["accepted tenders", "amount of bids accepted", "bids submitted", "rollover tenders", "noncash rollover tenders", "competitive", "noncompetitive", "investors submitted"],
    "bill_term": ["13-week", "26-week", "91-day", "182-day"],
    "bill_word": ["rate", "yield", "discount"],
    "bill_phrase": ["treasury-bill rates", "treasury bill rates", "average issuing rate", "investment rate", "discount rate", "equivalent coupon issue yield"],
    "schedule_phrase": ["held by all other investors", "held by federal reserve banks", "amount outstanding", "description of securities", "maturity schedule"],
    "regression_words": ["ordinary least squares", "linear regression", "slope and intercept"],
    "series_words": ["list the", "comma separated list", "inclusive"],
    "claims_words": ["highest amount", "highest", "owed by a country"],
    "precision": ["rounded to the nearest", "specifically only", "inclusive", "monthly values", "taking only the monthly values", "for each month", "each month from", "geometric mean", "ordinary least squares"],
}

# Table families that a pattern in the lowered question suggests.
FAMILY_PATTERNS = {
    "fd": r"\b(public debt|gross federal debt|debt outstanding|debt subject to statutory limitation|fha)\b",
    "ffo": r"\b(receipts?|budget outlays|federal interest cost|net of refunds|budget receipts)\b",
    "tax_receipts": r"\b(individual income tax receipts|income tax receipts|net of refunds|internal revenue)\b",
    "individual_income_tax": r"\bindividual income tax receipts\b",
    "cm": r"\b(claims owed|claims on foreigners|country-level|capital movements|foreigners reported by banks)\b",
    "esf": r"\b(exchange stabilization fund|esf)\b",
    "fcp": r"\b(japanese yen|british pound|foreign exchange and securities investments|options positions?|foreign currency)\b",
    "auction": r"\b(13-week|26-week|treasury-bill|auction|accepted tenders|issue date|maturing)\b",
    "agency_expense": r"\b(veterans administration|national defense|public works|expenditures?)\b",
    "national_defense": r"\bnational defense\b",
    "general_expenditures": r"\b(expenditures?|departments and agencies|general expenditures)\b",
    "veterans_public_works": r"\b(veterans administration|public works)\b",
}
# The order in which families are named.
FAMILY_ORDER = ["fd", "ffo", "tax_receipts", "individual_income_tax", "cm", "esf", "fcp", "auction", "bill_rates", "auction_results", "maturity_schedule", "agency_expense", "calendar_defense", "general_expenditures", "national_defense", "veterans_public_works"]

# Terms that tell rows and columns of tables apart.
DIMENSIONS = ["competitive", "noncompetitive", "accepted tenders", "amount of bids accepted", "bids submitted", "rollover tenders", "noncash rollover tenders", "all other investors", "held by u.s. govt. accounts", "held by federal reserve banks", "amount outstanding", "description of securities", "outlays", "receipts", "actual", "calendar year", "calendar yr", "fiscal year", "grand total", "total outstanding", "gross federal debt", "summary of public debt", "debt outstanding"]
# Terms that a question feature implies.
IMPLIED_DIMENSIONS = [
    (("wants_calendar_year", "wants_monthly_series"), ["calendar year", "calendar yr"]),
    (("wants_bill_rate_data",), ["average rate", "average issuing rate", "investment rate", "discount rate", "equivalent coupon issue yield", "91-day", "182-day"]),
    (("wants_auction_bid_data",), ["accepted tenders", "amount of bids accepted", "competitive", "noncompetitive", "rollover tenders"]),
    (("wants_maturity_schedule",), ["description of securities", "amount outstanding", "all other investors", "held by u.s. govt. accounts"]),
]

# Patterns of headings, months and numbers.
HEADING_START = r"^(table|chart|statement|summary|account|securities|receipts|outlays|cash|income|outgo|debt|balance|assets|liabilities|net|gross|holdings|position|exchange stabilization|federal|budget)\b"
HEADING_WORD = r"\b(total|gross|net|fiscal year|calendar year|outstanding|millions?|billions?|trillions?|public debt|balances?|receipts|outlays|cash|income|outgo|expenditures?|major classifications|holdings|positions?)\b"
MONTH_WORD = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b"
NUMBER = r"-?[0-9][0-9,]*\.?[0-9]*"
# Units, and a scalar with its marks.
UNIT_WORDS = ["trillion", "billion", "million", "thousand"]
SCALAR = r"[-+]?\$?[0-9][0-9,]*\.?[0-9]*(?:\s*(?:%|percent|billion|million|trillion|thousand|dollars))?"
# Texts that are no answers, that hedge, echo a prompt or deny an answer.
PLACEHOLDERS = [r"\[?\s*unable to determine\s*\]?", r"\[?\s*not found(?: in the provided reference data)?\s*\]?", r"\[?\s*not available\s*\]?", r"\[?\s*cannot be determined(?: from provided data)?\s*\]?", r"\[?\s*not possible to calculate\s*\]?", r"\[?\s*no answer found\s*\]?", r"\bno\s+.*?data\b"]
PLACEHOLDER_VALUES = ["", "nan", "+nan", "-nan", "none", "null", "n/a", "na"]
HEDGES = [r"\beither\b.*\bor\b", r"\bcould be\b.*\bor\b", r"\bpossibly\b.*\bor\b", r"\bmaybe\b.*\bor\b", r"\bone possibility is\b", r"\balternatively\b"]
ECHOES = ["if the answer is numeric", "output only", "output format", "final_answer", "you must use", "you may not", "rules:", "<reasoning>", "</reasoning>", "<final_answer>", "</final_answer>"]
NEGATIVE_CONTEXT = ["does not contain", "not possible", "unable to determine", "cannot be determined", "not available", "not found", "impossible to calculate", "cannot provide"]
# Words before an answer.
PREAMBLES = [
    r"^(?:the\s+)?answer\s+is\s*:?\s*",
    r"^(?:the\s+)?(?:final\s+)?(?:value|result)\s+is\s*:?\s*",
    r"^based\s+on\s+.*?,\s*",
    r"^according\s+to\s+.*?,\s*",
    r"^the\s+total\s+.*?\s+(?:was|is|were)\s+",
    r"^i\s+need\s+to\s+(?:verify|audit|double-check|identify).*?(?:\n\s*\n|\n)",
    r"^the\s+(?:provided|reference)\s+data\s+does\s+not\s+contain.*?(?:\n\s*\n|\n)",
    r"^no\s+.*?data.*?(?:\n\s*\n|\n)",
]
# The pattern of questions about bulletins.
BULLETIN_FORMAT = r"treasury bulletin|final_answer|treasury.*expenditure|fiscal year.*(?:million|billion|thousand)|public debt.*outstanding"

# Patterns and keys of output formats, the first that is found counts.  The directives are ours.
FORMATS = [
    (BULLETIN_FORMAT, "xml_final_answer", "Reason first; then close with the bare value in <FINAL_ANSWER></FINAL_ANSWER>."),
    (r"return json|return.*json.*format|answer.*json|provide.*json", "json_generic", "Answer with one JSON object of the structure asked for and nothing around it."),
    (r"risk[_\s-]*classification|classif(?:y|ication).*(?:risk|risks)", "json_risk_classification", "Answer with a JSON object that has the field risk_classification at its top."),
    (r"trading decision|stop[_\s-]*loss|take[_\s-]*profit|position size|confidence score", "json_trading_decision", "Answer with a JSON object of the trading fields, named as the task names them."),
    (r"\bcot\b|chain of thought|reasoning and answer|\"cot\"", "json_cot_answer", "Answer with a JSON object that holds the reasoning and the answer in fields of their own."),
    (r"options?|greeks|delta|gamma|theta|vega|implied volatility", "json_options", "Answer with the JSON object that the options task describes, nested as it is there."),
    (r"return.*csv|output.*csv|csv.*format", "csv_output", "Answer in CSV: a line of column names, then a line for each row."),
    (r"portfolio allocation|allocate.*portfolio|weights? across|target weights?", "portfolio_allocation", "Give each allocation a line of its own in the form that the task asks for."),
    (r"business summary|industry.*products.*geography|business overview", "json_business_summary", "Answer with a JSON object of the summary's fields."),
    (r"consistency check|inconsisten|contradiction", "json_consistency_check", "Answer with a JSON object that follows the check's schema."),
]

# Phrases anywhere in a text, and words of it, by which a task is told from others.
ROUTE_PHRASES = {
    "strong": ["treasury bulletin", "u.s. treasury bulletin", "treasury department bulletin"],
    "context": ["public debt outstanding", "federal receipts", "treasury balance", "national debt", "u.s. treasury"],
    "weak": ["fiscal year", "treasury department"],
}
ROUTE_WORDS = {
    "fiscal": ["expenditures", "receipts", "appropriation", "disbursements"],
    "crm": ["crm", "contact", "account", "opportunity", "lead", "pipeline", "salesforce", "deal", "revenue", "customer", "sales stage", "closed won", "closed lost", "prospect", "funnel"],
    "financial": ["treasury", "bulletin", "fiscal", "budget", "debt", "bond", "yield", "inflation", "gdp", "deficit", "surplus", "securities", "receipts", "expenditures", "appropriation", "federal"],
    "bwim": ["create", "build", "generate", "write", "convert", "transform", "rewrite", "format", "produce", "make", "compose", "draft", "translate", "restructure", "reorganize"],
}
# The first condition that holds names the task.
ROUTES = [
    ("strong >= 1", "officeqa"),
    ("context >= 2", "officeqa"),
    ("weak >= 1 AND fiscal >= 1", "officeqa"),
    ("crm >= 2", "crm"),
    ("bwim >= 2 OR (bwim >= 1 AND financial = 0)", "bwim"),
    ("financial >= 2", "financial"),
]

# Fixed values: (profile flag, pattern in a window of lines, points).
WINDOW_CUES = [
    ("wants_bill_rate_data", r"\b(average rate|average issuing rate|investment rate|discount rate|equivalent coupon issue yield)\b", 12),
    ("wants_auction_bid_data", r"\b(accepted tenders|amount of bids accepted|competitive|noncompetitive|rollover tenders)\b", 12),
    ("wants_maturity_schedule", r"\b(description of securities|amount outstanding|all other investors)\b", 12),
    ("wants_calendar_year", r"\bcalendar yr\b|\bcalendar year\b", 10),
    ("expects_date", r"\bdate\b|\bissue\b", 12),
    ("expects_percent", r"%|percent", 8),
]
WINDOW_TOTALS = r"\b(total|sum|gross|net|difference|balance|outstanding|cost|receipts|outlays)\b"

# Hints for solving a question: always, by the first shape that holds, or else, and by conditions.
HINTS_FIRST = ["Treat the reference data as Treasury tables, not free-form prose.", "Identify the exact table title, target row, target column, and unit before choosing an answer."]
HINTS_BY_SHAPE = {
    "expects_regression": ["This is a series/regression task.", "Extract the full ordered series first, then compute the final slope/intercept.", "Do not answer with a single year, label, or intermediate value."],
    "expects_series_math": [
        "This is a series/statistics task.",
        "Extract the full ordered monthly or yearly series first, then compute the requested mean, average, median, variance, standard deviation, correlation, or other statistic.",
        "Do not answer with a single year, label, or partial subtotal.",
    ],
    "expects_list": ["This question expects a multi-value list.", "Collect every requested value in order and preserve the full list in the final answer.", "Do not collapse the list into a single scalar."],
    "expects_sum": ["This is an aggregation task.", "Locate the full monthly/annual series and combine all requested values, not just one row."],
    "expects_difference": ["This is a comparison task.", "Find both operands from the same table context before computing the difference or spread."],
    "expects_percent": ["This is a percentage task.", "Use the exact numerator and denominator from the reference data and output one final percentage only."],
    "expects_date": ["This is a date-selection task.", "Choose the exact reporting or issue date from the table and return only the final date."],
}
HINTS_OTHERWISE = ["This is an exact cell-lookup task.", "Prefer the row/column intersection that best matches the requested entity, year, month, and unit."]
HINTS_MORE = [
    ("wants_bill_rate_data", "Prefer Treasury-bill rate or yield tables over accepted-tenders or amount-submitted tables."),
    ("wants_auction_bid_data", "Prefer auction-result tables with accepted tenders, competitive, noncompetitive, or rollover columns."),
    ("wants_maturity_schedule", "Prefer maturity-schedule tables with amount outstanding, description of securities, and investor-holding columns."),
    ("wants_calendar_year", "Prefer calendar-year tables or rows over fiscal-year summary tables unless the question explicitly asks for fiscal year."),
    ("wants_monthly_series", "Prefer month-by-month tables over annual summary rows when the question asks for monthly values or a statistic computed from months."),
    (
        "is_national_defense AND (wants_calendar_year OR wants_monthly_series)",
        "For national-defense calendar questions, prefer the month-by-month national-defense table over generic fiscal summary tables. If the bulletin only gives monthly values, compute the requested total or statistic from those monthly values.",
    ),
    ("first_month > 0", "Month cues are important here; prefer rows and columns that explicitly mention the requested month names."),
    ("year_count >= 2", "Multiple years are involved; ensure you use the exact requested year range, not a nearby year."),
    ("wants_full_number", "Return the fully expanded number, not a shortened million/billion shorthand."),
]

# Phrases around percentages, dates and scalars in questions and responses.
PERCENT_SIGN = ["percent value", "percentage value", "reported as a percent value", "report your answer as a percent"]
DATE_ASKED = ["what year", "which year", "what date", "which date", "what month", "which month", "what day", "which day", "reporting date", "month and year", "year and month"]
PERCENT_CUES = ["percent", "percentage", "change", "increase", "decrease", "growth", "difference"]
SCALAR_CUES = ["total", "amount", "value", "sum", "highest", "lowest", "outstanding", "balance", "cost", "receipts", "outlays", "expenditures", "bids", "accepted", "weighted average", "listed as", "totaled", "at "]
AUDITED = r"calculate|difference|sum|total|ratio|percent|percentage|average|mean|median|growth|change|increase|decrease"
# What repeated runs of a question are told to look at.
PERSPECTIVES = [
    "",
    "Double-check calendar year versus fiscal year before choosing a table. Prefer the later bulletin only when it revises the same data point.",
    "For monthly-series or aggregate questions, extract the full ordered series first and compute from those values instead of trusting a generic summary row.",
]
