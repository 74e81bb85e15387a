"""Small inline inputs: questions, answers and votes that exercise the domain's rules."""

from __future__ import annotations

QUESTIONS = [
    ("q01", "List the January total gross federal debt values from 1969 to 1980 inclusive."),
    ("q02", "Which March 1977 issue date has the smallest gap between the 13-week and 26-week treasury-bill rates?"),
    ("q03", "For the 2-year U.S. Treasury notes maturing at the end of July 1984, what is the total of bids submitted, and what percent of rollover tenders was accepted?"),
    ("q04", "What amount outstanding was held by all other investors for notes maturing in July 1984, in millions of dollars?"),
    ("q05", "What was the total national defense expenditure in calendar year 1940, in millions of dollars?"),
    ("q06", "What is the sum of all individual calendar months in 1953 of expenditures for national defense and associated activities?"),
    ("q07", "What is the geometric mean of monthly budget expenditures from March 1942 to October 1948, rounded to the nearest hundredths place?"),
    ("q08", "Fit a linear regression of individual income tax receipts between 1950 and 1960, and give slope and intercept inside square brackets."),
    ("q09", "According to table FFO-3 and the 'Summary of Fiscal Operations', what were budget outlays in fiscal year 1985? UID0042"),
    ("q10", "Which country had the highest amount of claims on foreigners in the June 1992 Treasury Bulletin, excluding territories and the revolving fund?"),
    ("q11", "Provide the list containing 12 numbers: net options positions for Japanese Yen and British Pound, 1994-1996."),
    ("q12", ""),
    ("q13", "How much did the Veterans Administration spend on Public Works, reported in billions? The provided reference data follows."),
]

#: Subjects and shapes of questions: ``questions`` fills them for each row of the benchmark table.
SUBJECTS = ["national defense expenditures", "gross federal debt", "public debt outstanding", "individual income tax receipts", "budget outlays", "claims on foreigners by country", "treasury-bill rates of 13-week bills", "accepted tenders for 2-year U.S. Treasury notes", "public works of the Veterans Administration", "Japanese Yen and British Pound options positions", "receipts of the Exchange Stabilization Fund"]
SHAPES = [
    "What was the total {s} in {m} {y}, in millions of dollars?",
    "List the monthly values of {s} for each month from {y} to {z}, inclusive, inside square brackets.",
    "What percent did {s} change between {y} and {z}, excluding trust accounts?",
    "Fit a linear regression of {s}, net of refunds, from {y} to {z}, and give slope and intercept.",
    "According to the {m} {y} Treasury Bulletin, which date had the highest {s}? UID{n}",
    "What is the difference of {s} in fiscal year {y} and calendar year {z}, without the revolving fund, reported in billions?",
    "What is the geometric mean of January {s} in {y}, {y1} and {z}?",
]
ASKED_MONTHS = ["January", "March", "June", "October", "December"]

ANSWERS = [
    ("a01", "What percent is it?", "14"),
    ("a02", "How much money, in dollars?", "1,234.50"),
    ("a03", "In billions?", "129,124 million"),
    ("a04", "in billions", "129124"),
    ("a05", "in millions", "$2.5 trillion"),
    ("a06", "in thousand dollars", "n/a"),
    ("a07", "", "[10102000000, 4.73]"),
    ("a08", "containing 2 numbers", "10102000000, 4.73"),
    ("a09", "third value", "Not found in the provided reference data"),
    ("a10", "slope and intercept", "either 3 or 4"),
    ("a11", "", "The answer is: 2602."),
    ("a12", "", "(1,234)"),
    ("a13", "", "| a | b | c |"),
    ("a14", "which year", "1984"),
    ("a15", "percentage", "the total receipts were 14.0%"),
    ("a16", "", ""),
    ("a17", "", "nan"),
    ("a18", "", "Output only the value"),
    ("a19", "", "`March 1977`"),
    ("a20", "second number", "FD-1"),
]

#: Questions and shapes of answers: ``answers`` fills them for each turn of the conversations table.
ASKED = ["What percent is it?", "in millions of dollars", "Which year was it?", "containing 3 numbers", "What percentage value changed, in billions?", "the full number, in thousands", "", "How much money?", "slope and intercept", "Which date?"]
GIVEN = ["The answer is {n},500 million.", "{n}.25", "0.{n}", "[{n}, 2.5%, $3]", "19{n}", "based on the table, {n}%", "$ {n} dollars", "Total outlays were {n} billion in May 1950", "not available", "{n}, {n}5, 1,2{n}", "`-{n}.50`", "Step one.\nThe total was {n}.\n{n},000 thousand", "FD-{n}", "It could be {n} or {n}1", "{t}", "The total in {t} was {n} million."]

VOTES = [
    ("v1", 1, "100"), ("v1", 2, "101"), ("v1", 3, "250"), ("v1", 4, "100.5"),
    ("v2", 1, "March 1977"), ("v2", 2, "march 1977"), ("v2", 3, "April 1977"),
    ("v3", 1, "(1,234)"), ("v3", 2, "-1,240"), ("v3", 3, "7 million"),
    ("v4", 1, "0"), ("v4", 2, "0.4"), ("v4", 3, "0.9"), ("v4", 4, "1.0"),
    ("v5", 1, "only one"),
    ("v6", 1, "b"), ("v6", 2, "a"), ("v6", 3, "A"), ("v6", 4, "B"),
]
#: Shapes of votes: a figure with two decimals, or whole.
VOTE_SHAPES = ["{v}", "{w}", "${v}", "({v})", "{v} million", "text {w}"]

RULES = [("national_defense", 1, 1), ("national_defense", 1, 2), ("fd", 0, 10), ("fd", 0, 11), ("fd", 1, 10), ("individual_income_tax", 0, 7), ("individual_income_tax", 1, 7)]

#: Shapes of expressions over a number.
EXPRESSIONS = ["sqrt({n}) + 2 ** 3", "round(sum([{n}, 2, 3]) / 7, 4)", "__import__('os').getpid({n})", "{n} / 0", "max({n}, 9) % 4"]


def sql_values(rows: list[tuple], names: str) -> str:
    """The rows as a SQL table."""
    cell = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"
