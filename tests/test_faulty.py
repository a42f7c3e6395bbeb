"""Faulty lines against a plain scanner of single lines."""

import random

import pytest

from spanloom.operators import faulty

GOOD = "chr1\t10\t20\tname\t5"


def scan(line):
    """('row', fields), ('fault', reason) or None."""
    x = line[:-1] if line.endswith("\r") else line
    if not x.strip(" \t") or x.startswith(("#", "track ", "browser ")):
        return None
    fields, i = [], 0
    while True:
        if i < len(x) and x[i] == '"':
            value, i = "", i + 1
            while True:
                if i >= len(x):
                    return "fault", "quoting"
                if x[i] == '"':
                    if x[i + 1 : i + 2] != '"':
                        break
                    i += 1
                value, i = value + x[i], i + 1
            i += 1
            if i < len(x) and x[i] != "\t":
                return "fault", "quoting"
        else:
            j = x.find("\t", i)
            value, i = (x[i:], len(x)) if j < 0 else (x[i:j], j)
            if '"' in value:
                return "fault", "quoting"
        fields.append(value)
        if i >= len(x):
            break
        i += 1
    if len(fields) != 5:
        return "fault", "columns"
    c, s, e, d, v = fields
    if not c.startswith("chr") or len(c) >= 40:
        return "fault", "contig"
    digits = lambda t: t != "" and all("0" <= ch <= "9" for ch in t)
    if not digits(s) or not digits(e) or int(s) > 2147483647 or int(e) > 2147483647 or int(e) == 0 or int(s) > int(e):
        return "fault", "coordinate"
    if v not in ("", ".") and not (digits(v.removeprefix("-")) and -2147483648 <= int(v) <= 2147483647):
        return "fault", "value"
    return "row", (c, int(s), int(e), d, None if v in ("", ".") else int(v))


def lines():
    r = random.Random(5)
    out = [GOOD, GOOD + "\r", "", " \t ", "#x", "track x", "browser y", "tracker", "\r", GOOD + "\t", "chr1\t10", '"chr1"\t10\t20\t"a\tb"\t5', '"chr1\t10\t20\tname\t5']
    out += ['chr1\t"10"\t20\t"na""me"\t"5"', 'chr1\t10\t20\t"a"b\t5', 'chr1\t10\t20\ta"b\t5', 'chr1\t10\t20\t"a""\t5', 'chr1\t10\t20\t""\t5', 'chr1\t10\t20\t"""\t5', 'chr1\t10\t20\t""""\t5']
    out += [f"chr1\t{s}\t{e}\tn\t{v}" for s, e, v in (("+1", 5, 5), (" 1", 5, 5), ("1", "2147483648", 5), ("0", "0", 5), ("9", "3", 1), ("00000000000007", "8", "-0"), ("٣", "8", 1), ("1", "9" * 60, 1), ("", "", ""))]
    out += [f"chr1\t1\t2\tn\t{v}" for v in ("", ".", "-", "--1", "1.5", "2147483647", "2147483648", "-2147483648", "-2147483649", "1e3", "+4", " 4", "x", "0" * 30 + "7")]
    out += ["chr" + "x" * 36 + "\t1\t2\tn\t1", "chr" + "x" * 37 + "\t1\t2\tn\t1", "Chr1\t1\t2\tn\t1", "\t".join("abc"), "\t" * 200, '"' * 5001, "chr1\t1\t2\t" + "n" * 300000 + "\t1", '"' + "a\t" * 20000 + '"\t1', "chr1\t1\t2\ta\nb\t1"]
    # The character that other readers take for "nothing" is a character like any other.
    out += ["chr1\t1\t2\ta\0b\t1", 'chr1\t1\t2\t"a\0b"\t1', 'chr1\t1\t2\t"\0"\t1', 'chr1\t1\t2\t"a\0""b"\t1', 'chr1\t1\t2\t"a\0\0"x\t1', "\0chr1\t1\t2\ta\t1", "chr\0\t1\t2\ta\t1", "chr1\t1\t2\ta\t1\0", "\0"]
    alphabet = ["chr1", "10", "20", '"', '""', "\t", "\t", "\t", "a", ".", "-3", "\r", " "]
    out += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 14))) for _ in range(1500)]
    pieces = ["chr1", '"chr1"', "10", '"10"', "7", "x", '"a\tb"', '"a"c', "", "."]
    out += ["\t".join(r.choice(pieces) for _ in range(r.choice([4, 5, 5, 5, 6]))) for _ in range(1500)]
    return out


def test_against_scanner(spark):
    text = lines() + [None]
    df = spark.createDataFrame([(i, t, "f", "k", "r") for i, t in enumerate(text)], "line_id int, line string, contig string, kind string, reason string")
    got = {r.line_id: r for r in faulty.classified(df).collect()}
    for i, t in enumerate(text):
        want = None if t is None else scan(t)
        if want is None:
            assert got[i].kind == "ignored" and got[i].reason is None, t
        elif want[0] == "fault":
            assert (got[i].kind, got[i].reason) == want, repr(t)[:200]
        else:
            assert got[i].kind == "row" and tuple(got[i].parsed) == want[1], repr(t)[:200]
    rows, faults = faulty.split_lines(df)
    assert rows.columns == ["line_id", "contig", "start", "end", "dataset", "value"]
    assert rows.count() + faults.count() == sum(t is not None and scan(t) is not None for t in text)


@pytest.mark.parametrize("schema", ["line_id int, line string, file string"])
def test_empty(spark, schema):
    df = spark.createDataFrame([], schema)
    assert faulty.classified(df).count() == 0 and faulty.faults_per_file(df).count() == 0
