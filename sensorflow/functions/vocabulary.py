"""Names, units and ranges that configs, events and results are written in."""

from __future__ import annotations

# Fixed values ---------------------------------------------------------------

UNITS = {
    "temperature": "Celsius",
    "pressure": "hPa",
    "humidity": "percent",
    "air_quality": "AQI",
    "light": "lux",
    "noise": "dB",
}
DEFAULT_UNIT = "units"

RANGES = {
    "temperature": (-30.0, 70.0),
    "pressure": (950.0, 1080.0),
    "humidity": (20.0, 90.0),
    "air_quality": (0.0, 200.0),
    "light": (50.0, 1000.0),
    "noise": (30.0, 80.0),
}

DEFAULT_WINDOW_SECONDS = 10
