import pytest

from catsim.llm import pii


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("account number: 12345678.", ["12345678"]),
        ("my passport no. 12345678 here", ["12345678"]),
        ("Account No. is 12345678", ["12345678"]),
        ("ACCOUNT_ID=12345678", ["12345678"]),
        ("IBAN: GB29 NWBK 6016 1331 9268 19 and more", ["GB29 NWBK 6016 1331 9268 19"]),
        ("iban GB29 NWBK 6016 1331 9268 19 2024", ["GB29 NWBK 6016 1331 9268 19"]),
        ("account 1234 5678 9012 in 2024", ["1234 5678 9012"]),
        ("passport: AB 1234567", ["AB 1234567"]),
        ("Api_Key = a1b2c3d4e5, tOkEn: a1b2c3d4e6", ["a1b2c3d4e5", "a1b2c3d4e6"]),
        ("\u0130\u0130 Api_Key = a1b2c3d4e5", ["a1b2c3d4e5"]),
        ("account 12 of 1234 5678", []),
        ("token 1024 2048 4096, the account is closed, account 1234", []),
        ("IBAN: GB29 NWBK 6016 1331 9268 18", []),
    ],
)
def test_account_values(text, want):
    assert [text[a:b] for k, a, b in pii.find_spans(text) if k == "account"] == want
