"""Fixed values of the map-matching semantics. Single-precision numbers are kept widened to double."""

import struct


def widened(x: float) -> float:
    """A single-precision number as a double."""
    return struct.unpack("f", struct.pack("f", x))[0]


#: Grid resolution in degrees, time bin in minutes, and pi: fixed values that decide cell and bin borders.
RESOLUTION = widened(0.01)
TIME_BIN = widened(0.05)
PI = 3.1415
EARTH_M, EARTH_MILES = 6371000.0, 3958.8
CELL_SPAN = 1_000_000
#: Label of an unreachable node; cost of a link that no point touches; cost of a forbidden type.
UNREACHABLE, INACTIVE, FORBIDDEN = 999999.0, 999.0, 999999 / 100.0
LIKELY_BELOW = 998.0
MPH = 0.621371
NONHIT_RATIO = 10.0
#: Steps of the adaptive grid resolution, fixed values.
RESOLUTION_STEPS = (
    0.00005, 0.0001, 0.0002, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0,
)
