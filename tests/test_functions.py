"""Scalar functions: small goldens, boundaries and quirks."""

import math

import pytest
from lanternway.functions import geo, parsing, timefn, wkt
from lanternway.functions.constants import PI, RESOLUTION, TIME_BIN
from pyspark.sql import functions as F


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def L(*v):
    return [F.lit(float(x)) for x in v]


def test_constants_are_widened_singles():
    assert RESOLUTION == 0.009999999776482582 and 0.05 < TIME_BIN < 0.0500001 and PI == 3.1415


def test_cells_lose_the_sign_and_indexes_keep_it(spark):
    a, b, i = one(spark, geo.cell_id(*L(-111.936576, 33.414725)), geo.cell_id(*L(111.936576, -33.414725)), geo.cell_index(*L(-111.936576, -112)))
    assert a == b == 11193003341 and i == 7
    assert one(spark, geo.cell_id(*L(0.01, 0.0)))[0] == 1_000_000  # the border is below 0.01


@pytest.mark.parametrize(("to", "want"), [((1, 0), 0), ((1, 1), 45), ((0, 1), 90), ((-1, 0), 180), ((0, -1), 271), ((1, -1), 316), ((0.000001, 1), 90)])
def test_angles_are_whole_degrees_cut_toward_zero(spark, to, want):
    raw = int(math.atan2(0 if abs(to[1]) < 1e-5 else to[1], 0 if abs(to[0]) < 1e-5 else to[0]) * 180 / PI + 0.5)
    assert one(spark, geo.angle(*L(0, 0, *to)))[0] == raw % 360 == want


@pytest.mark.parametrize(("a", "b", "want"), [(10, 55, 45), (10, 56, 46), (0, 180, 180), (180, 0, -180), (350, 10, 20), (10, 350, -20)])
def test_relative_angles(spark, a, b, want):
    assert one(spark, geo.relative_angle(F.lit(a), F.lit(b)), geo.turn(F.lit(a), F.lit(b))) == (want, abs(want))


def test_point_to_line(spark):
    on = one(spark, geo.point_line(*L(0.5, 0.2, 0, 0, 1, 0), False))[0]
    off = one(spark, geo.point_line(*L(1.5, 0.2, 0, 0, 1, 0), False), geo.point_line(*L(1.5, 0.2, 0, 0, 1, 0), True))
    assert on == pytest.approx(0.2) and off == (RESOLUTION, pytest.approx(0.2))
    edge = one(spark, geo.point_line(*L(1, 0.2, 0, 0, 1, 0), False))[0]
    assert edge == pytest.approx(0.2)
    assert one(spark, geo.point_line(*L(1, 1, 0, 0, 0, 0), False))[0] is None
    assert one(spark, geo.point_line(*L(1, 1, 0, 0, 0, 0), True))[0] == pytest.approx(math.sqrt(2))


def test_hits(spark):
    along, across, beyond = (one(spark, geo.hits_line(*L(*p, 0, 0, 1, 0)))[0] for p in ((0.2, 0.1, 0.6, 0.1), (0.4, 0, 0.4, 0.2), (1.3, 0.1, 1.5, 0.1)))
    assert (along, across, beyond) == (True, False, False)
    assert one(spark, geo.hits_line(*L(0, 0, 1, 1, 0, 0, 0, 0)))[0] is False


def test_conditioning_is_strict(spark):
    assert one(spark, *[geo.well_conditioned(F.lit(a), F.lit(b)) for a, b in ((1.0, 1.0), (3.0, 1.0), (1.0, 3.1), (1.0, 0.0))]) == (True, False, False, False)


def test_wkt_round_trip(spark):
    text = F.lit("LINESTRING(1.5 -2, 3 4)")
    got = one(spark, wkt.kind(text), wkt.points(text), wkt.linestring(wkt.points(text)), wkt.kind(F.lit("MULTIPOINT (1 2)")), wkt.kind(F.lit("x")), F.size(wkt.points(F.lit("LINESTRING ()"))), wkt.point(*L(1, 2)))
    assert got[0] == "LINESTRING" and [tuple(p) for p in got[1]] == [(1.5, -2.0), (3.0, 4.0)]
    assert got[2:] == ("LINESTRING (1.500000 -2.000000,3.000000 4.000000,)", "POINT", "UNKNOWN", 0, "POINT (1.000000 2.000000)")
    assert [tuple(p) for p in one(spark, wkt.points(F.lit("POLYGON ((0 0, 1 0, 1 1))")))[0]] == [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]


def test_times(spark):
    got = one(spark, timefn.clock_to_seconds(F.lit("0730:15")), timefn.seconds_to_clock(F.lit(27015)), timefn.clock_list(F.lit("0730;010730:15_0730:15:500")), timefn.time_bin(F.lit(1.0), F.lit(0.0), F.lit(15)), timefn.time_bin(F.lit(0.5), F.lit(0.0), F.lit(15)), timefn.bins_of_range(F.lit(0.0), F.lit(0.1)))
    assert got == (27015, "0730:15", [27000.0, 27015.0 + 86400, 27045.0], 14, 10, 10)
    assert one(spark, timefn.kmph(F.lit(-1.0), F.lit(0)))[0] == pytest.approx(-3.6)


@pytest.mark.parametrize(("text", "i", "f"), [("12.7", 12, 12.7), ("12abc", 12, 12.0), ("  -3", -3, -3.0), ("x", None, None), ("", None, None), (None, None, None), ("1e3", 1, 1000.0)])
def test_lenient_numbers(spark, text, i, f):
    t = F.lit(text).cast("string")
    assert one(spark, parsing.to_int(t), parsing.to_double(t)) == (i, f)
