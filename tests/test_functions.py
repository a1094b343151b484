"""Text, number and date expressions against plain Python on the same values."""

import random
import re
import string
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowassay.functions import dates, numbers, presets, text
from rowassay.functions.patterns import OnlyPython, java_regex

ALPHABET = (
    string.printable + "àÉöñßÆøИЖяΩσ東京あ٣५€£¥ ​  　\x00\x07\x1c\x1f\x85\xad‘’…—🙂‎"
)
random.seed(7)
TEXTS = ["", " ", "o'neil 3rd a-b ÉCOLE", "東京tokyo mcDonald's", "a\x00b\tc d e​", " \tx "] + [
    "".join(random.choice(ALPHABET) for _ in range(random.randint(0, 14))) for _ in range(1500)
]


def test_strip(column):
    assert column(TEXTS, text.strip) == [t.strip() for t in TEXTS]


def test_printable(column):
    want = ["".join(c for c in t if c.isprintable() or c in "\t\n\r") for t in TEXTS]
    assert column(TEXTS, text.printable) == want


def test_title_case(column):
    # final sigma depends on its neighbours in both languages; left out
    plain = [t for t in TEXTS if not set("σΩß") & set(t)]
    assert column(plain, text.title_case) == [t.title() for t in plain]


@pytest.mark.parametrize("keep", ["", ".-", string.punctuation])
def test_drop_punctuation(column, keep):
    gone = set(string.punctuation) - set(keep)
    want = ["".join(c for c in t if c not in gone) for t in TEXTS]
    assert column(TEXTS, lambda c: text.drop_punctuation(c, keep)) == want


def test_escape_formula(column):
    values = ["=1+1", "-5", "+x", "@y", "plain", "", None]
    assert column(values, text.escape_formula) == ["'=1+1", "'-5", "'+x", "'@y", "plain", "", None]


NUMBERS = [
    "5", "+5", " 5 ", "-7", "1_000", "1__0", "_1", "12.0", "1e5", "1,234", "$5", "1.5f", "1d", "", "abc", ".5", "5.",
    "1_0.5", "inf", "-Infinity", "nan", "1e", "e5", "0x10", "٣", "--5", "5 5", "1e+3", "1E-3", "+.5e2", " 5 ",
    "12345678901234567890123", "infinit", ".", "-", "1_000.25",
] + ["".join(random.choice("0123456789+-._eE ,$f") for _ in range(random.randint(1, 6))) for _ in range(800)]


def accepts(kind, value):
    try:
        kind(value)
        return True
    except ValueError:
        return False


def test_looks_integer(column):
    want = [accepts(int, v.strip().replace(",", "")) for v in NUMBERS]
    assert column(NUMBERS, numbers.looks_integer) == want


def test_looks_float(column):
    want = [accepts(float, v.strip().replace(",", "").replace("$", "")) for v in NUMBERS]
    assert column(NUMBERS, numbers.looks_float) == want


def test_to_double(column):
    plain = [v for v in NUMBERS if v != "٣"]
    got = column(plain, lambda c: numbers.to_double(c, ",$"))
    for v, g in zip(plain, got):
        clean = v.replace(",", "").replace("$", "")
        if not accepts(float, clean):
            assert g is None, v
        else:
            assert g == float(clean) or (g != g and float(clean) != float(clean)), v


def test_float_text(column):
    values = [0.0, -0.0, 5.0, 12345678.9, 0.0005, 1e16, 2e-5, 1e15, 123456789012345.6, -1234.5, 1.5e300, 1e-7, 9999999.0, 1e22, 0.1]
    got = column(values, text.float_text, "i int, v double")
    assert got == [repr(v) for v in values]


def test_booleans(column):
    values = ["TRUE", " yes ", "1", "t", "Y", "on", "False", "no", "0", "f", "N", "off", "maybe", ""]
    assert column(values, numbers.looks_boolean) == [True] * 12 + [False, False]


STRPTIME = {
    "YYYY-MM-DD": "%Y-%m-%d", "YYYY/MM/DD": "%Y/%m/%d", "YYYYMMDD": "%Y%m%d", "MM/DD/YYYY": "%m/%d/%Y",
    "DD/MM/YYYY": "%d/%m/%Y", "MM-DD-YYYY": "%m-%d-%Y", "DD-MM-YYYY": "%d-%m-%Y", "DD-MMM-YYYY": "%d-%b-%Y",
    "MMM DD, YYYY": "%b %d, %Y", "MMMM DD, YYYY": "%B %d, %Y", "YYYY-MM-DD HH:mm:ss": "%Y-%m-%d %H:%M:%S",
    "YYYY-MM-DDTHH:mm:ssZ": "%Y-%m-%dT%H:%M:%SZ", "MM/DD/YY": "%m/%d/%y", "DD/MM/YY": "%d/%m/%y",
    "MMDDYY": "%m%d%y", "DDMMYY": "%d%m%y", "M/D/YYYY": "%m/%d/%Y", "YYYY.MM.DD": "%Y.%m.%d",
}
DATES = [
    "1/5/2024", "2024-1-5", "224-01-01", "2024-02-30", "jan 15, 2024", "Jan  15, 2024", "2024115", "01/05/68", "01/05/69",
    "January 5, 2024", "may 5, 2024", "Sept 5, 2024", "05-JAN-2024", "2024-01-05 7:8:9", "2024-01-05T07:08:09Z",
    "2024-01-05t07:08:09z", "2024-13-01", "31/12/1999", "12/31/1999", "010524", "311299", "1124", "2024/2/29", "2023/2/29",
    "2024.1.5", "0000-01-01", "2024-01-05 24:00:00", "", "x", "29-Feb-2023", "20240229", "  2024-01-05 ", "2024 -01-05",
]


@pytest.mark.parametrize("fmt", STRPTIME)
def test_parse_like_strptime(column, fmt):
    made = [datetime(random.randint(1970, 2060), random.randint(1, 12), random.randint(1, 28)).strftime(STRPTIME[fmt]) for _ in range(40)]
    values = DATES + made

    def read(v):
        try:
            return datetime.strptime(v.strip(), STRPTIME[fmt])
        except ValueError:
            return None

    got = column(values, lambda c: dates.parse_any(c, [fmt]))
    assert dict(zip(values, got)) == {v: read(v) for v in values}


def test_excel_serial(column):
    got = column(["45321", "1.5", "0.5", "2958466", "x"], lambda c: dates.parse_any(c, [], excel=True))
    assert got == [datetime(2024, 1, 30), datetime(1899, 12, 31, 12), None, None, None]
    assert column([0.0], lambda c: dates.excel_serial(c, "1904"), "i int, v double") == [datetime(1904, 1, 1)]


@pytest.mark.parametrize("fmt", STRPTIME)
def test_render_like_strftime(column, fmt):
    days = [datetime(2024, 1, 5, 7, 8, 9), datetime(1999, 12, 31)]
    want = {"M/D/YYYY": ["1/5/2024", "12/31/1999"]}.get(fmt, [d.strftime(STRPTIME[fmt]) for d in days])
    assert column(days, lambda c: dates.render(c, fmt), "i int, v timestamp") == want


def test_guess(column):
    values = ["2024-01-05", "2024-1-5 7:08", "2024-01-05T07:08:09.5Z", "1/2/2024", "13/2/2024", "Jan 5, 2024", "nope", "2024-02-30"]
    got = column(values, dates.guess)
    assert got == [
        datetime(2024, 1, 5), datetime(2024, 1, 5, 7, 8), datetime(2024, 1, 5, 7, 8, 9, 500000), datetime(2024, 1, 2),
        datetime(2024, 2, 13), datetime(2024, 1, 5), None, None,
    ]


SAMPLES = [
    "a.b+c@mail.example.org", "mail.example.org", "a@b", "a@b.c", "@mail.example.org", "a b@mail.example.org", "a@@mail.example.org", "ä@mail.example.org",
    "(614) 555-0198", "614.555.0198", "+1-614-555-0198", "5550198", "55-50198", "614 5550198 7", "911", "61455501980", "(614 555-0198",
    "43215", "43215-0001", "43215-1", "4321", "http://q.r/s?t=u", "https://v", "gopher://w", "http:///x", "0f9e8d7c-6b5a-4c3d-2e1f-001122334455",
    "0f9e8d7c6b5a4c3d2e1f001122334455", "10.20.30.40", "10.20.30.400", "::", "fe80::a%eth0", "2001:db8:0:1::5", "qrs", "QRS789", "٦٧٨٩٠", "43215\n", "q\nr", "", "q r",
]


@pytest.mark.parametrize("name", presets.PATTERNS)
def test_presets_like_re(column, name):
    pattern = presets.PATTERNS[name]
    got = column(SAMPLES, lambda c: c.rlike(java_regex(pattern)))
    assert dict(zip(SAMPLES, got)) == {s: bool(re.match(pattern, s)) for s in SAMPLES}


@pytest.mark.parametrize(
    "pattern", [r"(?P<a>\w)(?P=a)", r"[[a]b", r"[]x]+", r"a.c$", r"\d+\Z", r"[&&x]+", r"^$", r"[^\[]+$", r"(?i)ABC", r"x{2,}|y"]
)
def test_python_dialect(column, pattern):
    values = SAMPLES + ["aab", "ab", "[b", "]x", "a\nc", "abc\n", "12", "12\n", "&&x", "[", "xx", "y"]
    got = column(values, lambda c: c.rlike(java_regex(pattern)))
    assert dict(zip(values, got)) == {s: bool(re.match(pattern, s)) for s in values}


@pytest.mark.parametrize(
    "pattern",
    [
        r"\[[0-9]+\]", r"\[ERROR\] [a-z]+", r"\[\d{4}-\d\d\] \[[A-Z]+\]", r"\\Z", r"(?i)école", r"[\]\[]+x", r"\\[ab]", r"(?i:É)cole", r"[^]\\]+$",
    ],
)
def test_escapes_like_python(column, pattern):
    values = ["[12]", "[x]", "[ERROR] x", "[2024-01] [INFO]", "\\Z", "\\z", "ÉCOLE", "école", "][x", "\\a", "\\[ab]", "éCole", "ab]", ""]
    got = column(values, lambda c: c.rlike(java_regex(pattern)))
    assert dict(zip(values, got)) == {s: bool(re.match(pattern, s)) for s in values}


def test_random_patterns_like_python(column):
    parts = [r"\[", r"\]", r"\\", "[a-c]", "[^x]", r"[\[\]]", r"[\\z]", "[]a]", r"\d", r"\w", "é", "Z", r"\.", ".", "a?", "b*", "(?:ab|É)", r"[&&a]", "[[b]"]
    chars = "ab[]\\zZé É1.&x"
    rng = random.Random(17)
    values = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 5))) for _ in range(300)]
    for _ in range(25):
        pattern = rng.choice(["", "(?i)"]) + "".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + rng.choice(["", "$", r"\Z"])
        got = column(values, lambda c: c.rlike(java_regex(pattern)))
        assert (pattern, dict(zip(values, got))) == (pattern, {s: bool(re.match(pattern, s)) for s in values})


def agree(spark, patterns, values):
    """Which values each pattern matches, in one job, against re.match."""
    rows = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    got = rows.select("v", F.array(*[F.col("v").rlike(java_regex(p)) for p in patterns]).alias("hits")).collect()
    assert len(got) == len(values)
    for p, i in zip(patterns, range(len(patterns)), strict=True):
        found = re.compile(p)
        wrong = [(r["v"], r["hits"][i]) for r in got if r["hits"][i] != bool(found.match(r["v"]))]
        assert not wrong, (p, java_regex(p), wrong[:5])


ODD = ["", "\n", "a\n", "\n\n", "a\vb", "a\nb", "a\x85b", "a\u2028b", "a\rb", "a\x1cb", " ", "\xa0", "٣", "ß", "ẞ", "ſ", "s", "S", "K", "k", "K", "İ", "ı", "i", "I", "é", "É",
       "µ", "μ", "Σ", "ς", "σ", "_", "-", "a-b", "猫", "🙂", "\x00", "1", "²", "Ⅷ", "aa", "aab", "abab", "foo bar", "x&&y", "[a]", "]", "^", "\\", "ab\ncd\n", "cd", "ǅ", "ǆ", "Ǆ", "́"]


def test_every_kind_of_node(spark):
    patterns = [
        r"a\vb", r"a[\v]b", r"a[^\v]b", r"a.b", r"(?s)a.b", r"(?s:a.)b|c", r"\s", r"[\s\d]", r"[^\s\d]", r"[^\W\d]", r"[\S\n]", r"\S", r"\w+\Z", r"\W", r"\D", r"(?a)\w", r"(?a)\s|\d", r"(?a:\w)x|(?u:é)",
        r"(?i)s", r"(?i)ß", r"(?i)ẞ", r"(?i)k", r"(?i)i", r"(?i)İ", r"(?i)ı", r"(?i)σ", r"(?i)ς", r"(?i)µ", r"(?i)ǅ", r"(?ai)k", r"(?ai)É", r"(?i)[a-z]$", r"(?i)[^k-s]", r"(?i)[^s]", r"(?i:É)", r"(?i:a(?-i:B))|(?-i:I)",
        r"^", r"$", r"a$", r"(?m)a$", r"(?m).*\n^cd$", r"(?m)(?s:.)*^$", r"a\Z", r"\A\Z", r"\b", r"\B", r"\w+\b.", r"\B\w|.\B", r"(?a)\b.", r"[^\n]*\b\S",
        r"(a)(b)?\2", r"(?P<x>a)(?P=x)b", r"(ab)\1", r"(?:(a)|b)*\1", r"a*?b", r"a*+b", r"a++a", r"(?>a+)b", r"(?:a|b){2,3}$", r"(?:a?){3}", r"a{,2}$", r"a{2}", r"x*",
        r"(?=a)a", r"(?!a)", r"(?=.*b)a", r".*(?<=b)$", r".(?<!a)", r"(?<=x)a", r".(?<=[a\s])", r"(?!)", r"(?x) a  # b\n b", r"[]a]", r"[^]a]", r"[[]a", r"[&&x]+", r"[x&&[y]", r"[a\-b]+", r"[-a]+", r"[\^]", r"\\", r"[\\]", r"[\x00-\x1f]",
        r"\u00e9|\U0001F642", r"[\U0001F600-\U0001F64F]", r".$", r"\.|\[", r"#|~|&&", r"foo\ bar", r"\t|\r|\f", r"\012", r"|a", r"(?:)", r"()\1a",
    ]
    agree(spark, patterns, ODD)


def test_random_patterns(spark):
    rng = random.Random(29)
    atoms = ["a", "b", "É", "k", ".", r"\d", r"\w", r"\s", r"\v", r"\W", r"[ab]", r"[^a\s]", r"[\w-]", r"[^\d_]", r"[a-k]", r"\b", r"\B", "^", "$", r"(?=a)", r"(?<!b)", r"(a|b)", r"\n", r"[\n\v]", "(?:ab|k)"]
    patterns = []
    while len(patterns) < 150:
        p = rng.choice(["", "", "(?i)", "(?s)", "(?m)", "(?a)", "(?im)"]) + "".join(rng.choice(atoms) + rng.choice(["", "", "", "?", "*", "+?", "{2}", "{0,2}", "*+"]) for _ in range(rng.randint(1, 5)))
        try:
            re.compile(p)
            patterns.append(p)
        except re.error:
            pass
    values = ["".join(rng.choice("abkKÉé1 _-\n\v\x85K") for _ in range(rng.randint(0, 6))) for _ in range(200)]
    agree(spark, patterns, list(dict.fromkeys([*values, *ODD])))


def test_bad_pattern_is_none():
    assert java_regex("(") is None and java_regex(r"[z-a]") is None and java_regex("a**") is None


def test_only_python():
    for pattern in (r"(a)?b(?(1)c|d)", r"(?i)(a)\1", r"(a)b(?<=\1b)", r"(?i)[\u0100-\uffff]"):
        with pytest.raises(OnlyPython):
            java_regex(pattern)


def test_value_lists(spark):
    assert len(presets.value_list("us_state_2_letter")) == 51
    assert len(presets.value_list("us_state_full_name")) == 51
    assert len(presets.value_list("us_state_code_or_name")) == 102
    assert len(set(presets.value_list("uom_ansi_packaging"))) == 26
    countries = presets.value_list("country_iso3166_alpha2")
    assert len(countries) == 249 and {"AD", "GB", "TW", "ZW", "BQ", "SS"} <= set(countries)
    assert presets.value_list("unknown") is None


def test_missing_covers_nan(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    flags = rows.select(text.is_missing(F.col("v"), T.DoubleType())).collect()
    assert [f[0] for f in flags] == [False, True, True]
