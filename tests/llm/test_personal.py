"""Account numbers among other words, and context on either side."""

from aerolake.llm import pii

IBAN = "DE89 3704 0044 0532 0130 00"


def _found(text, kind):
    return [text[s[1] : s[2]] for s in pii.spans(text) if s[0] == kind]


def test_account_number_before_other_capitals_or_digits():
    for after in (" BIC COBADEFF", " 50 EUR", " 2024", " OK", ", paid", ""):
        assert _found(f"IBAN {IBAN}{after}", "iban") == [IBAN]
    assert _found(f"AB12 CODE OF {IBAN} AND GB82 WEST 1234 5698 7654 32 TOO", "iban") == [IBAN, "GB82 WEST 1234 5698 7654 32"]
    assert _found(f"{IBAN}X", "iban") == [] and _found(f"x{IBAN}", "iban") == []
    assert pii.redacted(f"pay {IBAN} 50 EUR") == "pay [IBAN] 50 EUR"


def test_context_after_a_span():
    assert _found("123-45-6789 is my social security number", "ssn") == ["123-45-6789"]
    assert _found("123-45-6789 is the lot" + " of paint" * 9 + " not social security", "ssn") == []
