import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.sources import lines
from tests.conftest import rows

SIZES = {"chr1": 1000, "chrM": 50}
GOOD = "chr1\t10\t11\tm\t4\t+\t10\t11\t255,0,0\t4\t25.00\t1\t2\t1\t0\t0\t0\t0"


def edit(k, value, line=GOOD):
    f = line.split("\t")
    f[k - 1] = value
    return "\t".join(f)


def spaced(line):
    f = line.split("\t")
    return "\t".join(f[:10]) + " " + " ".join(f[10:])


VALID = [
    GOOD,
    spaced(GOOD),
    GOOD + "\t",
    GOOD + "\r",
    GOOD + "\t\r",
    edit(1, '"chr1"'),
    edit(4, '"m,CG,0"'),
    edit(4, "21839"),
    edit(4, "a,DRACH,2"),
    edit(11, "25.01"),
    edit(3, "011", edit(2, "010")),
    spaced(edit(12, '"1"')),
]
INVALID = [
    (edit(1, "chr9"), "unknown chrom"),
    (edit(3, "12"), "chromEnd is not chromStart + 1"),
    (edit(8, "1001", edit(7, "1000", edit(3, "1001", edit(2, "1000")))), "beyond the end of chrom"),
    (edit(4, "z"), "unknown modification code"),
    (edit(4, "m,CG"), "unknown modification code"),
    (edit(4, ""), "unknown modification code"),
    (edit(6, "*"), "invalid strand"),
    (edit(7, "9"), "thickStart differs"),
    (edit(8, "12"), "thickEnd differs"),
    (edit(9, "0,0,255"), "invalid color"),
    (edit(5, "5"), "score differs from valid_coverage"),
    (edit(12, "2"), "valid_coverage is not the sum of its counts"),
    (edit(11, "25.0"), "percent_modified is not written with two decimals"),
    (edit(11, "25.02"), "percent_modified differs from its counts"),
    (edit(11, "nan"), "percent_modified is not written with two decimals"),
    (edit(18, "-1"), "not a number"),
    (edit(18, "١"), "not a number"),
    (edit(18, str(2**63)), "number too large"),
    (edit(17, ""), "empty value"),
    (GOOD + "\t0", "too many fields"),
    (GOOD.rsplit("\t", 1)[0], "too few fields"),
    ("chr1", "too few fields"),
    ('"' + GOOD, "quote not closed"),
    (edit(4, 'm"'), "quote inside a field"),
    (edit(4, '"m"x'), "text after a closing quote"),
    (GOOD.replace("\t", " "), "too few fields"),
    (spaced(GOOD).replace(" 2 ", "\t2 "), "wrong separator"),
]


@pytest.mark.parametrize("line", VALID)
def test_valid(line):
    records, errors = lines.parse(line, SIZES)
    assert len(records) == 1 and not errors


@pytest.mark.parametrize("line,reason", INVALID)
def test_invalid(line, reason):
    records, errors = lines.parse(line, SIZES)
    assert not records and [e[2] for e in errors] == [reason]


def test_skipped():
    assert lines.parse(f"\n   \n# x\n{lines.HEADER}\n{lines.HEADER}\r\n", SIZES) == ([], [])


def test_recovers_after_a_broken_quote():
    text = "\n".join([GOOD, '"' + GOOD, GOOD, edit(4, '"m'), GOOD])
    records, errors = lines.parse(text, SIZES)
    assert len(records) == 3 and [(e[0], e[2]) for e in errors] == [(2, "quote not closed"), (4, "quote not closed")]


SWALLOWED = [GOOD, edit(4, '"m'), "a note that the quote began", 'chr9\t10\t11\tm"', "chr1\t10\t12\tm", "# a comment", "chr1\t999\t1000\tbad", GOOD, "bad", GOOD]


def test_a_quote_over_several_lines_ends_at_a_validated_anchor():
    records, errors = lines.parse("\n".join(SWALLOWED), SIZES)
    assert len(records) == 3
    # line 7 begins like a record of chr1 and is no better for it: there the quote has ended
    assert [(e[0], e[2]) for e in errors] == [(2, lines.BROKEN_QUOTE), (3, lines.SWALLOWED), (4, lines.SWALLOWED), (5, lines.SWALLOWED), (7, "too few fields"), (9, "too few fields")]


@pytest.mark.parametrize("anchor", [lambda self: False, lambda self: True])
def test_without_validated_anchors_the_result_is_another(monkeypatch, anchor):
    want = lines.parse("\n".join(SWALLOWED), SIZES)
    monkeypatch.setattr(lines.Parser, "anchor", anchor)
    got = lines.parse("\n".join(SWALLOWED), SIZES)
    assert got != want and (len(got[0]) < len(want[0])) == (not anchor(None))


def test_lines_of_a_file_are_one_text_in_any_layout(spark):
    data = [(k, f, n, t) for f in ("a", "b") for n, t in enumerate(SWALLOWED) for k in [n + 100 * (f == "b")]]
    data += [(500, None, 3, edit(4, '"m')), (501, None, 4, "bad"), (502, "c", None, "bad"), (503, "c", 7, None)]
    df = spark.createDataFrame(data, "line_id long, file_name string, line_no int, line string")
    contigs = spark.createDataFrame(list(SIZES.items()), "chrom string, size long")
    got = []
    for n in (1, 5):
        for errors in (True, False):
            parsed = lines.parse_lines(df.repartition(n), contigs, ["line_id"], file="file_name", number="line_no", only_errors=errors)
            got.append(rows(lines.errors(parsed, ["line_id"])))
        assert parsed.where("reason is null").count() == 6
    assert got[0] == got[1] == got[2] == got[3]
    reason = {r[0]: r[1] for r in got[0]}
    assert [reason[k] for k in (1, 2, 3, 4, 6, 102)] == [lines.BROKEN_QUOTE, lines.SWALLOWED, lines.SWALLOWED, lines.SWALLOWED, "too few fields", lines.SWALLOWED]
    assert reason[501] == reason[502] == "too few fields" and reason[503] == "null line"
    # a block is as far as a quote reaches
    small = lines.parse_lines(df, contigs, ["line_id"], file="file_name", number="line_no", block=3)
    reason = {r["line_id"]: r["reason"] for r in lines.errors(small, ["line_id"]).collect()}
    assert reason[2] == lines.SWALLOWED and reason[3] == "quote inside a field"


def test_locates_the_fault():
    (line, column, reason, field), = lines.parse("# c\n" + edit(6, "?"), SIZES)[1]
    assert (line, field, reason) == (2, 6, "invalid strand") and edit(6, "?")[column - 1] == "?"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='chr1\t "m,0\r\n+5.', max_size=80))
def test_any_text_is_parsed(text):
    records, errors = lines.parse(text, SIZES)
    shown = [x for x in text.split("\n") if x.strip() and x[0] != "#"]
    assert len(records) + len(errors) == len(shown)


def test_table(spark):
    data = [(1, "f", GOOD), (2, "f", None), (3, "f", ""), (4, "f", "x" * 100_000), (5, "f", GOOD), (6, None, GOOD + "\n" + GOOD)]
    df = spark.createDataFrame(data, "line_id long, chrom_file string, line string")
    contigs = spark.createDataFrame([*SIZES.items(), (None, 5)], "chrom string, size long")
    parsed = lines.parse_lines(df, contigs, ["line_id"])
    assert rows(lines.records(parsed), "line_id") == [(1,), (5,), (6,), (6,)]
    assert rows(lines.errors(parsed, ["line_id"]), "line_id", "reason") == [(2, "null line"), (4, "too few fields")]
    assert lines.parse_lines(df.limit(0), contigs, []).count() == 0
