import pytest
from pyspark.sql import functions as F

from goldweave.functions import cleansing as c
from goldweave.functions.semantic import get_type, infer_type, is_valid
from goldweave.operators import masking, ruleset
from goldweave.operators.column_types import infer_column_types, pii_report
from goldweave.operators.normalize import align_union, contains_anywhere, header_names

NBSP = " "


@pytest.mark.parametrize("rule, values, expected", [
    ("clean_text", [None, "", " \t ", "O'Brien,  JR.\n x", f"a{NBSP}b", "Zoë"], [None, "", "", "obrien jr x", "ab", "zo"]),
    ("clean_phone", [None, "", "abc", "(212) 555-0101"], [None, None, None, "2125550101"]),
    ("soundex", [None, "", "123", "Robert", "rupert", "Tymczak", "-x"], [None, None, None, "R163", "R163", "T522", None]),
    ("phone", [None, "12-34", "(212) 555-0101", "+1 212 555 0101 ext"], [None, None, "212555-0101", "+12125550101"]),
    ("email", [None, " A.B+c@X-y.ORG ", "a@b", ""], [None, "a.b+c@x-y.org", None, None]),
    ("website", [None, " ", "Example.com", " HTTP://x.org "], [None, None, "https://example.com", "http://x.org"]),
    ("npi", ["123-456-7890", "123456789", None, "0000000001"], ["1234567890", None, None, "0000000001"]),
    ("dea", [" ab1 ", " ", None], ["AB1", None, None]),
    ("license", ["md-12/x 3", "--", None], ["MD12X3", None, None]),
    ("person_name", ["  o'BRIEN-SMITH \t jr ", None], ["O'brien-smith Jr", None]),
    ("postal_code", [" 0 2108 ", "02108-1234", None], ["02108", "02108-1234", None]),
    ("state", [" ny ", None], ["NY", None]),
    ("default_country", [None, "CA"], ["US", "CA"]),
    ("e164", ["(212) 555-0101", "+1 212-555-0101", "112-555-0101", None], ["+12125550101", "+12125550101", None, None]),
])
def test_rules(column, rule, values, expected):
    assert column(values, c.NAMED_RULES[rule](F.col("v"))) == expected


@pytest.mark.parametrize("rule", sorted(set(c.NAMED_RULES) - {"soundex", "e164"}))
def test_rules_are_idempotent(column, rule):
    values = [None, "", "  ", "a", " Mixed  CASE text\n", "(212) 555-0101", "A.b@C.org", "x.org", "md-1/2", f"é{NBSP}ü", "12 345"]
    once = c.NAMED_RULES[rule](F.col("v"))
    assert column(values, once) == column(column(values, once), once)


def test_casts_dates_and_cases(column):
    assert column(["12", "x", None, "007"], c.convert(F.col("v"), "Integer")) == [12, None, None, 7]
    assert column(["1.25", "y"], c.decimal_places(c.convert(F.col("v"), "Float"), 1)) == [1.3, None]
    assert column(["ab cd"], c.text_case(F.col("v"), "Title Case")) == ["Ab Cd"]
    assert column(["01/31/2024", "31/31/2024"], F.date_format(c.parse_date(F.col("v"), "MM/DD/YYYY"), "yyyy-MM-dd")) == ["2024-01-31", None]
    for call in (lambda: c.convert(F.col("v"), "blob"), lambda: c.decimal_places(F.col("v"), 11), lambda: c.text_case(F.col("v"), "odd"),
                 lambda: c.format_date(F.col("v"), "YY")):
        with pytest.raises(ValueError):
            call()


def test_semantic_types(column):
    cases = {
        "NPI": (["1234567890"], ["123456789"]),
        "SSN": (["123-45-6789"], ["000-12-3456", "666-12-3456", "900-12-3456", "123-00-6789", "123-45-0000"]),
        "EMAIL": (["a.b+c@x-y.org"], ["a@b"]),
        "PHONE_US": (["(212) 555-0101", "+1 212-555-0101"], ["112-555-0101"]),
        "ZIP_CODE": (["02108", "02108-1234"], ["2108"]),
        "TAX_ID": (["12-3456789"], ["123456789"]),
    }
    for name, (good, bad) in cases.items():
        assert column([*good, *bad, None, ""], is_valid(F.col("v"), name.lower())) == [True] * len(good) + [False] * (len(bad) + 2)
    assert column(["x"], is_valid(F.col("v"), "NOPE")) == [False]
    assert column(["2125550101", "212-555-0101", "x", None], infer_type(F.col("v"))) == ["NPI", "PHONE_US", None, None]
    assert get_type("ssn").is_pii and get_type("nope") is None


def test_column_types_and_pii(spark):
    df = spark.createDataFrame([("02108", "a@b.co", "x"), ("02109", "c@d.co", None), ("n/a", "e@f.co", "y")],
                               "zip string, mail string, other string")
    assert {(r.column_name, r.type_name) for r in infer_column_types(df, 0.6).collect()} == {("zip", "ZIP_CODE"), ("mail", "EMAIL")}
    assert [r.column_name for r in pii_report(df).collect()] == ["mail"]


def test_masking(spark, column):
    text = "mail a.b@c.org, ssn 123-45-6789, call (212) 555-0101."
    assert column([text, None], masking.mask_free_text(F.col("v"))) == ["mail [EMAIL], ssn [SSN], call [PHONE].", None]
    assert column(["ABC-D-1234", "12", "AB-1234"], masking.mask_all_but(F.col("v"), 4)) == ["XXX-X-1234", "99", "XX-9999"]
    with pytest.raises(ValueError):
        masking.hipaa_policy({"ssn": "ssn", "shoe_size": None})
    assert masking.hipaa_policy({"ssn": "ssn", "shoe_size": None}, safe={"shoe_size"}) == {"ssn": "hash"}
    df = spark.createDataFrame([("x", "02108", "s")], "name string, zip string, note string")
    row = masking.apply_policy(df, {"name": "hash", "zip": "zip3", "note": "drop"}, "salt").first()
    assert len(row.name) == 64 and row.zip == "021" and "note" not in row.asDict()
    with pytest.raises(ValueError):
        masking.apply_policy(df, {"name": "rot13"}, "salt")


def test_headers_and_alignment(spark):
    assert header_names([" First Name ", "First-Name", "FirstName", "__", "a%%b", "first_name_2"]) == [
        "first_name", "first_name_2", "firstname", "col_4", "a_b", "first_name_2_2"]
    a = spark.createDataFrame([(1, "x", 2.0)], "b int, a string, only_a double")
    b = spark.createDataFrame([("y", 3)], "a string, b int")
    assert align_union([a, b]).columns == ["b", "a"]
    assert align_union([a, b], keep_all=True).columns == ["b", "a", "only_a"]
    found = a.filter(contains_anywhere("X", ["a", "b"])).count()
    assert found == 1 and a.filter(contains_anywhere(".", ["a", "b"])).count() == 0


def test_ruleset_order_nulls_and_errors(spark):
    df = spark.createDataFrame([(" new  york ", " 02 108", None, "7.126"), ("x", None, " a@B.co ", "bad")],
                               "city string, zip_code string, email string, amount string")
    config = {"cleansing_rules": [
        {"column_name": "amount", "rule_type": "DATATYPE_CONVERSION", "rule_parameters": {"desired_datatype": "Float"}},
        {"column_name": "amount", "rule_type": "DECIMAL_PRECISION", "rule_parameters": {"scale": 2}},
        {"rule_type": "NEW_COLUMN", "rule_parameters": {"new_column_name": "place", "expression": "concat(city, ' ', zip_code)"}},
    ], "global_settings": {"null_handling": "replace"}}
    rows = {r.city: r for r in ruleset.apply_ruleset(df, config).collect()}
    assert rows["New York"].place == "New York 02108" and rows["New York"].amount == 7.13 and rows["New York"].email == ""
    assert rows["X"].email == "a@b.co" and rows["X"].amount == 0.0
    assert ruleset.apply_ruleset(df, {"global_settings": {"null_handling": "remove"}}).count() == 0
    with pytest.raises(ValueError):
        ruleset.apply_rules(df, {"city": "no such rule"})
    with pytest.raises(ValueError):
        ruleset.apply_ruleset(df, {"cleansing_rules": [{"rule_type": "NEW_COLUMN", "rule_parameters": {
            "new_column_name": "n", "expression": "no_such_column + 1"}}]})


def test_cleansing_is_native(spark):
    df = spark.createDataFrame([("x",)], "v string").select(*[r(F.col("v")).alias(n) for n, r in c.NAMED_RULES.items()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
