"""Rule tables of the bulletin domain: what a table, heading or date is worth for which question.  Other domains bring their own rows.

A rule counts for a question if its condition, SQL over the columns of ``scoring.with_conditions``, holds, and for a table or file if its
field has the pattern often enough and the pattern in ``unless`` not at all.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    when: str
    field: str
    pattern: str
    points: int
    unless: str = ""
    least: int = 1


# Codes and keywords of each table family.
FAMILIES: dict[str, tuple[list[str], list[str]]] = {
    "fd": (["fd"], ["federal debt", "gross federal debt", "public debt", "debt outstanding", "debt subject to statutory limitation", "interest-bearing marketable public debt securities", "gross debt", "summary of federal debt", "summary of public debt and guaranteed agency securities"]),
    "ffo": (["ffo"], ["receipts by source", "budget outlays by function", "federal receipts", "budget receipts", "outlays by function", "interest cost", "net of refunds", "fiscal operations"]),
    "cm": (["cm"], ["claims on foreigners", "claims owed by a country", "country breakdown", "capital movements", "reported by banks", "liabilities to foreigners"]),
    "esf": (["esf"], ["exchange stabilization fund", "esf", "foreign currency holdings", "special drawing rights"]),
    "fcp": (["fcp"], ["foreign exchange and securities investments", "net options positions", "japanese yen", "british pound", "euro", "foreign currency", "options positions"]),
    "auction": (["pdo", "tso"], ["13-week", "26-week", "treasury-bill rates", "treasury bill rates", "auction", "accepted tenders", "issue date", "maturing", "2-year treasury notes", "offerings of bills", "offerings of notes", "public debt operations"]),
    "bill_rates": (["pdo"], ["13-week", "26-week", "91-day", "182-day", "treasury-bill rates", "average rate", "average issuing rate", "investment rate", "discount rate", "equivalent coupon issue yield"]),
    "auction_results": (["pdo"], ["accepted tenders", "amount of bids accepted", "bids submitted", "competitive", "noncompetitive", "rollover tenders", "offerings of notes", "offerings of bills", "public offerings of marketable securities other than regular weekly treasury bills"]),
    "maturity_schedule": (["tso"], ["maturity schedule", "maturing", "description of securities", "amount outstanding", "held by u.s. govt. accounts", "held by federal reserve banks", "all other investors", "interest-bearing marketable public debt securities"]),
    "agency_expense": ([], ["veterans administration", "national defense", "public works", "expenditures", "federal government expenditures", "budget expenditures", "analysis of national defense expenditures", "budget receipts and expenditures", "general government expenditures"]),
    "calendar_defense": ([], ["analysis of national defense expenditures", "expenditures for national defense and related activities", "cash income and outgo of the treasury, by major classifications", "budget expenditures classified as general, by major functions", "calendar yr", "calendar year", "individual calendar months"]),
    "general_expenditures": ([], ["analysis of general expenditures", "departments and agencies", "budget expenditures", "general government expenditures", "public works"]),
    "national_defense": ([], ["analysis of national defense expenditures", "national defense expenditures", "national defense"]),
    "veterans_public_works": ([], ["veterans administration", "public works", "analysis of general expenditures", "general expenditures", "departments and agencies", "budget receipts and expenditures"]),
    "tax_receipts": ([], ["individual income tax receipts", "net of refunds", "internal revenue collections", "income tax receipts", "tax receipts"]),
    "individual_income_tax": ([], ["individual income tax receipts", "internal revenue collections", "summary by principal sources", "net of refunds"]),
}

YEAR = r"\b(?:19|20)[0-9]{2}\b"
MONTH = r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z.]*\b"
NUMBERS = r"-?[0-9][0-9,]*\.?[0-9]*"
CALENDAR = r"\bcalendar yr\b|\bcalendar year\b"
RATES = r"\b(average rate|average issuing rate|investment rate|discount rate|equivalent coupon issue yield)\b"
DEBT_SUMMARY = r"\bsummary of federal debt\b|\bsummary of public debt\b|\bgross federal debt\b"

# Points of a table.  Fields: title, text, unit, both (title and text), all (title, text and unit), marks (title, and whether the text has a percent sign).
TABLE_RULES = [
    Rule("expects_sum", "both", r"\b(total|sum|gross|net|outstanding|balance|receipts|outlays|expenditures?)\b", 20),
    Rule("expects_difference", "both", r"\b(net|gross|difference|spread|less|minus)\b", 16),
    Rule("expects_percent", "marks", r"percent|%|ratio", 14),
    Rule("expects_regression", "text", YEAR, 22, least=6),
    Rule("expects_series_math", "text", YEAR, 18, least=4),
    Rule("expects_series_math", "text", MONTH, 18, least=6),
    Rule("expects_list", "text", NUMBERS, 16, least=8),
    Rule("expects_date", "both", r"\bdate\b|\bissue\b|\bmaturity\b", 18),
    Rule("wants_calendar_year", "all", CALENDAR, 26),
    Rule("wants_calendar_year", "all", r"\bcomplete fiscal years?\b|\bfiscal year\b", -18, unless=CALENDAR),
    Rule("wants_monthly_series", "all", MONTH, 20, least=6),
    Rule("says_million", "unit", "million", 12),
    Rule("says_billion", "unit", "billion", 12),
    Rule("says_trillion", "unit", "trillion", 12),
    Rule("says_thousand", "unit", "thousand", 12),
    Rule("is_fd", "all", r"\bownership of federal securities\b", -32),
    Rule("is_fd AND expects_list", "all", r"\bownership of federal securities\b", -18),
    Rule("is_fd", "all", r"\b(summary of public debt|summary of federal debt|debt outstanding)\b", 26),
    Rule("is_auction AND says_notes", "all", r"\bofferings of bills\b", -34),
    Rule("is_auction AND says_notes", "all", r"\bnotes?\b", 10),
    Rule("is_auction AND says_notes", "all", r"\b(public offerings of marketable securities other than regular weekly treasury bills|marketable securities other than regular weekly treasury bills)\b", 42),
    Rule("is_cm", "all", r"\bnet foreign transactions\b", -24),
    Rule("is_cm", "all", r"\b(total claims by type and country|total liabilities by type and country|claims on foreigners|liabilities to foreigners)\b", 28),
    Rule("is_tax_receipts", "all", r"\bcorporation income tax returns\b", -10),
    Rule("is_tax_receipts", "all", r"\b(individual income tax receipts|internal revenue collections|net of refunds)\b", 18),
    Rule("wants_tax_regression", "all", r"\b(individual income tax receipts|summary by principal sources|analysis of receipts from internal revenue)\b", 44),
    Rule("wants_tax_regression", "all", r"\bcorporation income tax returns\b", -68),
    Rule("is_agency_expense", "all", r"\banalysis of national defense expenditures\b", 24),
    Rule("is_agency_expense", "all", r"\b(veterans administration|public works|departments and agencies)\b", 20),
    Rule("is_agency_expense", "all", r"\b(assets and liabilities of governmental corporations and credit agencies|receipts and expenditures for trust accounts)\b", -18),
    Rule("is_agency_expense AND says_exclud", "all", r"\b(revolving funds|trust accounts|transfers to trust accounts)\b", -40),
    Rule("mentions_veterans_admin AND include_public_works", "all", r"\banalysis of general expenditures\b", 34),
    Rule("mentions_veterans_admin AND include_public_works", "all", r"\bveterans[' ]administration\b", 28),
    Rule("mentions_veterans_admin AND include_public_works", "all", r"\bpublic works\b", 24),
    Rule("mentions_veterans_admin AND include_public_works", "all", r"\btable\s+3\.- analysis of general expenditures\b", 24),
    Rule("mentions_veterans_admin AND include_public_works", "all", r"\bincludes public works undertaken by the veterans[' ]administration\b", 70),
    Rule("mentions_veterans_admin AND include_public_works", "all", r"\bdoes not include expenditures for \(1\) revolving funds or \(2\) transfers to trust accounts\b", 80),
    Rule("exclude_revolving", "title", r"\btable\s+5\b|\banalysis of expenditures for \(1\) revolving funds\b|\brevolving funds\b", -95),
    Rule("exclude_trust_accounts", "title", r"\btransfers to trust accounts\b|\btrust accounts\b", -75),
    Rule("is_national_defense", "all", r"\banalysis of national defense expenditures\b", 36),
    Rule("is_national_defense", "all", r"\b(summary of fiscal statistics|analysis of general expenditures|budget receipts and expenditures)\b", -18),
    Rule("is_veterans_public_works", "all", r"\b(veterans administration|public works|analysis of general expenditures|departments and agencies)\b", 34),
    Rule("is_veterans_public_works", "all", r"\b(revolving funds|trust accounts|transfers to trust accounts|assets and liabilities of governmental corporations and credit agencies)\b", -52),
    Rule("wants_january_debt_series", "all", DEBT_SUMMARY, 40),
    Rule("wants_january_debt_series", "all", r"\bownership of federal securities\b|\bmaturity distribution\b", -48),
    Rule("is_individual_income_tax", "all", r"\b(individual income tax receipts|internal revenue collections|summary by principal sources|net of refunds)\b", 36),
    Rule("is_individual_income_tax", "all", r"\bcorporation income tax returns\b", -42),
    Rule("prefers_country_claims", "all", r"\btotal claims by country\b", 68),
    Rule("prefers_country_claims", "all", r"\bclaims on foreigners by type and country\b", -18),
    Rule("prefers_country_claims", "all", r"\btotal claims by type and country\b", -24),
    Rule("prefers_country_claims", "all", r"\bliabilities to foreigners\b|\btotal liabilities\b", -62),
    Rule("prefers_country_claims", "all", r"\bcountry\b", 10),
    Rule("exclude_territories OR exclude_regional_aggregates", "all", r"\btype and country\b", -10),
    Rule("is_fcp", "all", r"\b(japanese yen positions|british pound positions|foreign currency positions)\b", 20),
    Rule("is_fcp", "all", r"\b(statement of net cost|assets, liabilities, and net position of the fund)\b", -16),
    Rule("is_bill_rates", "all", r"\b(average rate|average issuing rate|investment rate|discount rate|equivalent coupon issue yield|91-day|182-day)\b", 42),
    Rule("is_bill_rates", "all", r"\b(accepted tenders|amount of bids accepted|competitive|noncompetitive|rollover tenders)\b", -38),
    Rule("is_auction_results", "all", r"\b(accepted tenders|amount of bids accepted|competitive|noncompetitive|rollover tenders|bids submitted)\b", 44),
    Rule("is_auction_results", "all", r"\b(maturity schedule|description of securities|amount outstanding|all other investors)\b", -42),
    Rule("is_maturity_schedule", "all", r"\b(maturity schedule|description of securities|amount outstanding|all other investors|held by federal reserve banks)\b", 42),
    Rule("is_maturity_schedule", "all", r"\b(accepted tenders|amount of bids accepted|average issuing rate|investment rate|discount rate)\b", -42),
    Rule("is_calendar_defense", "all", r"\b(analysis of national defense expenditures|expenditures for national defense and related activities)\b", 54),
    Rule("is_calendar_defense", "all", r"\b(cash income and outgo of the treasury, by major classifications|budget expenditures classified as general, by major functions)\b", 40),
    Rule("is_calendar_defense", "all", r"\b(summary table on budget receipts and expenditures|budget receipts and expenditures|summary of fiscal statistics)\b", -30),
    Rule("(is_calendar_defense OR is_national_defense) AND wants_monthly_series", "all", r"\bsummary of budget results by months and years\b", -28),
    Rule("(is_calendar_defense OR is_national_defense) AND wants_monthly_series", "all", r"\bbusiness-type activities\b", -70),
    Rule("is_general_expenditures", "all", r"\b(analysis of general expenditures|departments and agencies)\b", 26),
    Rule("is_general_expenditures", "all", r"\bsummary table on budget receipts and expenditures\b", -14),
    Rule("is_bill_rates", "all", r"\b(offerings of bills|public debt operations.*offerings)\b", -45),
    Rule("is_auction AND says_notes", "all", r"\bofferings of bills\b", -50, unless=r"\bnotes?\b"),
    Rule("is_auction_results", "all", RATES, -40),
]

# Points of a file by its heading summary (heading) or whole text (content), for questions with a family.
FILE_RULES = [
    Rule("is_fd", "heading", "summary of public debt|summary of federal debt", 24),
    Rule("is_fd", "heading", "ownership of federal securities", -16),
    Rule("is_fd AND expects_list", "heading", "ownership of federal securities", -14),
    Rule("is_fd AND wants_january_debt_series", "heading", "summary of federal debt|summary of public debt", 40),
    Rule("is_fd AND wants_january_debt_series", "heading", "ownership of federal securities|maturity distribution", -54),
    Rule("is_auction AND says_notes", "heading", "public offerings of marketable securities other than regular weekly treasury bills", 36),
    Rule("is_auction AND says_notes", "heading", "offerings of bills", -24, unless="notes"),
    Rule("is_bill_rates", "heading", RATES, 30),
    Rule("is_bill_rates", "heading", r"\b(accepted tenders|amount of bids accepted|competitive|noncompetitive)\b", -34),
    Rule("is_auction_results", "heading", r"\b(accepted tenders|amount of bids accepted|competitive|noncompetitive|rollover tenders)\b", 34),
    Rule("is_auction_results", "heading", r"\b(maturity schedule|description of securities|amount outstanding|all other investors)\b", -38),
    Rule("is_maturity_schedule", "heading", r"\b(maturity schedule|description of securities|amount outstanding|all other investors)\b", 34),
    Rule("is_maturity_schedule", "heading", r"\b(accepted tenders|amount of bids accepted|average rate|investment rate|discount rate)\b", -38),
    Rule("is_cm", "heading", "total claims by type and country|total liabilities by type and country", 26),
    Rule("is_cm", "heading", "net foreign transactions", -18),
    Rule("has_family AND prefers_country_claims", "heading", "total claims by country", 56),
    Rule("has_family AND prefers_country_claims", "heading", "total claims by type and country", -20),
    Rule("has_family AND prefers_country_claims", "heading", "liabilities to foreigners|total liabilities by type and country", -48),
    Rule("is_agency_expense", "heading", "analysis of national defense expenditures", 18),
    Rule("is_agency_expense", "heading", "veterans administration|public works|departments and agencies", 18),
    Rule("is_agency_expense AND says_exclud", "heading", "revolving funds|trust accounts", -26),
    Rule("has_family AND mentions_veterans_admin AND include_public_works", "heading", "analysis of general expenditures|veterans administration|public works", 26),
    Rule("has_family AND mentions_veterans_admin AND include_public_works", "content", "includes public works undertaken by the veterans administration", 110),
    Rule("has_family AND mentions_veterans_admin AND include_public_works", "content", r"does not include expenditures for \(1\) revolving funds or \(2\) transfers to trust accounts", 130),
    Rule("has_family AND exclude_revolving", "heading", r"analysis of expenditures for \(1\) revolving funds|\btable\s+5\b", -54),
    Rule("has_family AND exclude_trust_accounts", "heading", "transfers to trust accounts|trust accounts", -44),
    Rule("is_national_defense", "heading", "analysis of national defense expenditures", 30),
    Rule("is_national_defense", "heading", "summary of fiscal statistics|analysis of general expenditures", -16),
    Rule("is_calendar_defense", "heading", "analysis of national defense expenditures|expenditures for national defense and related activities", 40),
    Rule("is_calendar_defense", "heading", "summary table on budget receipts and expenditures|budget receipts and expenditures", -24),
    Rule("is_general_expenditures", "heading", "analysis of general expenditures|departments and agencies", 22),
    Rule("is_general_expenditures", "heading", "summary table on budget receipts and expenditures", -12),
    Rule("is_veterans_public_works", "heading", "veterans administration|public works|departments and agencies|analysis of general expenditures", 24),
    Rule("is_veterans_public_works", "heading", "revolving funds|trust accounts|assets and liabilities of governmental corporations and credit agencies", -36),
    Rule("is_fcp", "heading", "foreign currency positions|japanese yen positions", 16),
    Rule("is_fcp", "heading", "statement of net cost", -12),
    Rule("is_tax_receipts", "heading", "individual income tax receipts|internal revenue collections", 18),
    Rule("is_tax_receipts AND wants_tax_regression", "heading", "corporation income tax returns", -52),
    Rule("is_individual_income_tax", "heading", "individual income tax receipts|internal revenue collections|summary by principal sources", 30),
    Rule("is_individual_income_tax", "heading", "corporation income tax returns", -34),
    Rule("is_individual_income_tax AND wants_tax_regression", "heading", "totals by months, beginning with 1933", 26),
]

# Months m after the first issue that may print a year's figures: (from, to, top, from where it falls, in steps of, least), so
# greatest(least, top - (m - where) div step).
PUBLICATION = [(0, 6, 28, 0, 1, 0), (7, 18, 22, 0, 1, 8), (19, 48, 10, 18, 4, 2), (-6, -1, 6, -6, 1, 6)]
# Points for a file's year (fy) and month (fm).
DATE_RULES = [
    "CASE WHEN month_asked THEN CASE WHEN is_fd AND expects_list THEN 2 ELSE 10 END ELSE 0 END",
    "CASE WHEN NOT wants_january_debt_series THEN 0 WHEN fm = 10 THEN 44 + CASE WHEN fy = first_year THEN 72 WHEN fy = first_year + 1 THEN 6 ELSE 0 END WHEN fm = 11 THEN -12 - CASE WHEN fy = first_year THEN 18 ELSE 0 END ELSE -12 END",
    "CASE WHEN (is_national_defense OR is_agency_expense) AND NOT says_fiscal AND fy = last_year + 1 THEN 14 + CASE WHEN fm <= 4 THEN 8 ELSE 0 END ELSE 0 END",
    "CASE WHEN is_calendar_defense AND NOT says_fiscal THEN CASE WHEN fy BETWEEN last_year AND last_year + 2 THEN 22 ELSE 0 END + CASE WHEN fy >= last_year AND fm <= 4 THEN 10 ELSE 0 END ELSE 0 END",
    "CASE WHEN NOT (is_veterans_public_works AND mentions_veterans_admin) THEN 0 WHEN fy = last_year + 10 AND fm = 1 THEN 120 WHEN fy = last_year + 10 AND fm = 2 THEN 88 WHEN fy = last_year + 10 AND fm BETWEEN 3 AND 6 THEN 20 WHEN fy > last_year + 10 THEN -least(40, (fy - last_year - 10) * 12 + fm) ELSE 0 END",
    "CASE WHEN prefers_country_claims AND fm = 12 THEN 8 + CASE WHEN fy >= last_year + 2 THEN 10 ELSE 0 END + CASE WHEN fy = last_year + 3 THEN 18 ELSE 0 END ELSE 0 END",
    "CASE WHEN is_auction AND expects_date AND first_month > 0 AND fy = last_year THEN CASE WHEN fm = first_month + 1 THEN 28 WHEN fm = first_month THEN 10 ELSE 0 END ELSE 0 END",
    "CASE WHEN NOT is_auction OR issue_month IS NULL THEN 0 WHEN fy * 12 + fm = issue_month THEN 90 WHEN abs(fy * 12 + fm - issue_month) = 1 THEN 32 ELSE 0 END",
]
#: Likewise for questions without a year, too.
OTHER_DATE_RULES = [
    "CASE WHEN expects_regression AND n_years >= 4 AND fy BETWEEN first_year AND last_year + 2 THEN 8 ELSE 0 END",
    "CASE WHEN expects_regression AND (is_tax_receipts OR is_individual_income_tax) AND fy IN (last_year, last_year + 1) THEN 18 + CASE WHEN fm BETWEEN 6 AND 9 THEN 6 ELSE 0 END ELSE 0 END",
    "CASE WHEN NOT (expects_regression AND (is_tax_receipts OR is_individual_income_tax) AND wants_tax_regression) THEN 0 WHEN fm = 7 THEN 48 WHEN fm = 6 THEN 12 WHEN fm = 8 THEN 18 ELSE -10 END",
]

# Issues that a question's families and years point to: (condition, years after, month).
ANCHORS = [
    ("is_national_defense", [(1, 1), (1, 2)]),
    ("mentions_veterans_admin", [(10, 1), (10, 2), (8, 1), (8, 2), (9, 1), (9, 2), (11, 1), (11, 2)]),
    ("prefers_country_claims", [(1, 12), (2, 12), (3, 12)]),
    ("wants_tax_regression AND is_individual_income_tax", [(0, 7), (1, 7), (0, 6), (1, 6)]),
    ("NOT wants_tax_regression AND expects_regression AND is_individual_income_tax", [(0, 7), (1, 7)]),
    ("wants_january_debt_series AND is_fd", [(0, 10), (0, 11), (1, 10)]),
    ("NOT wants_january_debt_series AND expects_list AND is_fd", [(0, 10), (0, 11)]),
]
# How many years after a question's year issues are candidates.
FOLLOWING = """CASE WHEN earliest < 1950 THEN greatest(base, 10) ELSE base END"""


def following_base(years: int = 6) -> str:
    """How many years after a named one its issues are candidates, before the rule for early years; ``years`` where no family says otherwise."""
    some = f"CASE WHEN is_auction THEN least({years}, 2) WHEN is_fd OR is_fcp OR is_cm THEN least({years}, 3) ELSE {years} END"
    return f"CASE WHEN is_agency_expense OR is_tax_receipts THEN greatest({some}, 12) ELSE {some} END"

