"""Column data quality: each finding, and the edges."""

import math
from datetime import datetime as D
from fractions import Fraction

import pytest

from columnscout.operators import quality

CELLS = "nid long, source_name string, load_no int, row_no long, value string, received_at timestamp, number string, n int"
PROFILE = "id long, load_no int, dataType string, totalValues long, uniqueValues long, minValue double, updated_at timestamp, received_at timestamp, nid string"
T0, T1 = D(2024, 1, 1), D(2024, 1, 2)


def cells(spark, rows):
    return spark.createDataFrame([(nid, "s", load, i, v, t, "x", 1) for nid, load, i, v, t in rows], CELLS)


def stored(spark, rows):
    return spark.createDataFrame([(*r, T0, T0, "x") for r in rows], PROFILE)


def found(c, p, **kw):
    return sorted(map(tuple, quality.findings(c, p, **kw).collect()))


def test_each_finding(spark):
    rows = [(1, 1, i, str(i), T0) for i in range(40)] + [(1, 2, i, str(i + 20), T0) for i in range(40)] + [(1, 3, i, str(i + 20) if i < 30 else " NaN ", T0) for i in range(40)]
    p = stored(spark, [(1, 1, "N", 40, 40, 0.0), (1, 2, "T", 41, 40, 20.5), (1, 3, None, None, 30, 20.0)])
    assert found(cells(spark, rows), p) == [(1, 2, "count"), (1, 2, "drift"), (1, 2, "range"), (1, 2, "type"), (1, 3, "blank"), (1, 3, "count"), (1, 3, "type")]


def test_latest_row_counts_and_repeats_dont(spark):
    rows = [(1, 1, 0, "5", T0), (1, 1, 0, "7", T1), (1, 1, 0, "7", T1), (1, 1, 0, None, None), (1, 1, 1, "1,000.5", T0), (None, 1, 1, "x", T0)]
    p = quality.column_profile(quality.value_counts(cells(spark, rows))).collect()
    assert [(r.nid, r.total, r.blanks, r.uniques, r.data_type, r.min_value, r.max_value) for r in p] == [(1, 2, 0, 2, "N", 7.0, 1000.5)]


def test_all_blank_load_is_text(spark):
    p = quality.column_profile(quality.value_counts(cells(spark, [(1, 1, i, v, T0) for i, v in enumerate([None, "", "  ", "nan", "NAN"])]))).first()
    assert (p.total, p.blanks, p.uniques, p.data_type, p.min_value) == (0, 5, 0, "T", None)


def test_missing_stored_row_has_no_stored_findings(spark):
    assert found(cells(spark, [(1, 1, 0, "5", T0)]), stored(spark, [])) == []


def test_empty(spark):
    assert found(cells(spark, []), stored(spark, [])) == []


@pytest.mark.parametrize("numeric", [True, False])
def test_ranges_give_the_same_distance(spark, numeric):
    """A column sorted in ranges has the distance that one sort gives."""
    put = (lambda i: str(i * 7 % 1000)) if numeric else (lambda i: f"v{i * 7 % 1000}é")
    rows = [(1, 1, i, put(i), T0) for i in range(900)] + [(1, 2, i, put(i * 3 + 11), T0) for i in range(500)]
    counts = quality.value_counts(cells(spark, rows)).cache()
    loads = quality.with_previous(quality.column_profile(counts))
    one, many = (quality.distribution_distance(counts, loads, range_values=r).first().distance for r in (None, 100))
    assert one == pytest.approx(many, abs=1e-12) and one > 0


def test_equal_numbers_are_one_step(spark):
    rows = [(1, 1, i, "1", T0) for i in range(40)] + [(1, 2, i, "1.0" if i % 2 else "+1", T0) for i in range(40)]
    assert "drift" not in {f for _, _, f in found(cells(spark, rows), stored(spark, []))}


def loads_of(spark, *values, **kw):
    """A column whose loads have these values, with sums, and its counts."""
    rows = [(1, load + 1, i, v, T0) for load, vs in enumerate(values) for i, v in enumerate(vs)]
    counts = quality.value_counts(cells(spark, rows))
    return quality.column_profile(counts).join(quality.power_sums(counts), ["nid", "load_no"], "left")


def difference(spark, a, b):
    return quality.shift(quality.with_previous(loads_of(spark, a, b))).first().difference


def expected(a, b):
    """The definition, in whole numbers."""
    def moments(vs):
        xs = [Fraction(v.replace(",", "")) for v in vs]
        mean = sum(xs) / len(xs)
        return mean, sum(x * x for x in xs) / len(xs) - mean * mean
    (m, v), (n, w) = moments(b), moments(a)
    return float(m - n) / math.sqrt((v + w) / 2)


@pytest.mark.parametrize("a, b", [
    ([f"0.000{i}" for i in range(1, 5)], [f"0.001{i}" for i in range(1, 5)]),
    ([f"0.0000{i}7" for i in range(10, 40)], [f"0.0000{i}1" for i in range(12, 50)]),
    ([f"10000000000{i}" for i in range(5)], [f"1000000000{i}1" for i in range(7)]),
    ([str(10**12 + i) for i in range(9)], [str(10**12 + 2 * i) for i in range(9)]),
    (["-1,000.5", "7", "0", "0.25"], ["+3", "1" + "0" * 40, "2"]),
    (["999999999999999", "999999999999998"], ["-999999999999999", "0.000000000000001"])])
def test_differences_at_any_magnitude(spark, a, b):
    assert difference(spark, a, b) == pytest.approx(expected(a, b), rel=1e-9)


def test_differences_that_are_none(spark):
    assert difference(spark, ["5", "5"], ["5", "5"]) is None and difference(spark, ["1", "3"], ["3", "1"]) == 0.0


def test_power_sums_merge(spark):
    values = [f"{i}.25" for i in range(10)] + ["0.0001", "123456789012345", "-7"]
    both = loads_of(spark, values[:6], values[6:])
    merged = quality.merge_sums(both.select("nid", "sums"), ["nid"]).first().sums
    assert merged == loads_of(spark, values).first().sums
    count, mean, var = quality._moments([x.asDict() for x in merged])
    xs = [Fraction(v) for v in values]
    assert count == len(xs) and mean == sum(xs) / len(xs) and var == sum(x * x for x in xs) / len(xs) - mean * mean


def test_patterns(spark):
    """Any pattern may be asked for; cells that match a pattern of other than numbers are no numbers."""
    c = cells(spark, [(1, 1, i, v, T0) for i, v in enumerate(["AB-12", "12", "2024-01-02", "x y", "", None, "1.5"])])
    p = quality.column_profile(quality.value_counts(c), quality.PATTERNS).first()
    assert (p.total, p.not_integer, p.not_number, p.not_date, p.not_code, p.not_words) == (5, 4, 3, 4, 4, 4)
    p = quality.column_profile(quality.value_counts(c, "^[A-Z]+-[0-9]+$")).first()
    assert (p.total, p.violations, p.min_value) == (5, 5, None)


@pytest.mark.parametrize("n", [150, 4000])
def test_many_splitters(spark, n):
    """Ranges by more splitters than one step has."""
    counts = quality.value_counts(cells(spark, [(1, load, i, str(i * load), T0) for load in (1, 2) for i in range(n)])).cache()
    loads = quality.with_previous(quality.column_profile(counts))
    one, many = (quality.distribution_distance(counts, loads, range_values=r).first().distance for r in (None, 10))
    assert one == pytest.approx(many, abs=1e-9)
