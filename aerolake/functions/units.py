"""Unit conversion, standard atmosphere and formatting.

A conversion by a factor is given once, as (from, to, factor), and makes two functions: to
multiplies, back divides.
"""

from __future__ import annotations

from .sqlfn import SqlFunction, fn

# fixed values: conversion factors and constants of the standard atmosphere
_FACTORS = [
    ("nautical_miles", "kilometers", "1.852"),
    ("nautical_miles", "statute_miles", "1.150779448"),
    ("nautical_miles", "meters", "1852"),
    ("nautical_miles", "feet", "6076.11549"),
    ("statute_miles", "kilometers", "1.609344"),
    ("kilometers", "meters", "1000"),
    ("statute_miles", "meters", "1609.344"),
    ("statute_miles", "feet", "5280"),
    ("feet", "meters", "0.3048"),
    ("knots", "kilometers_per_hour", "1.852"),
    ("knots", "miles_per_hour", "1.150779448"),
    ("knots", "meters_per_second", "0.514444"),
    ("miles_per_hour", "kilometers_per_hour", "1.609344"),
    ("miles_per_hour", "meters_per_second", "0.44704"),
    ("kilometers_per_hour", "meters_per_second", "(1 / 3.6D)"),
    ("inches_of_mercury", "hectopascals", "33.8639"),
    ("inches_of_mercury", "millibars", "33.8639"),
    ("inches_of_mercury", "millimeters_of_mercury", "25.4"),
    ("hectopascals", "millimeters_of_mercury", "(760 / 1013.25D)"),
    ("millibars", "millimeters_of_mercury", "(760 / 1013.25D)"),
    ("kilopascals", "hectopascals", "10"),
    ("kilopascals", "millibars", "10"),
    ("hectopascals", "millibars", "1"),
    ("gallons", "liters", "3.785411784"),
    ("pounds", "kilograms", "0.45359237"),
]
_EXPONENT = "(9.80665D / (287.05287D * 0.0065D))"
_DENSITY = "density STRUCT<kgPerL: DOUBLE, lbPerGal: DOUBLE>"


def _literal(factor: str) -> str:
    return factor if factor.startswith("(") else f"{factor}D"


def _conversions() -> list[SqlFunction]:
    out = []
    for source, target, factor in _FACTORS:
        out.append(fn(f"{source}_to_{target}", "x", f"x * {_literal(factor)}"))
        out.append(fn(f"{target}_to_{source}", "x", f"x / {_literal(factor)}"))
    return out


def _fuel() -> list[SqlFunction]:
    """Volume to mass and back at a density: through kilograms per liter."""
    volume = {"gallons": "3.785411784D", "liters": "1D"}
    mass = {"pounds": "0.45359237D", "kilograms": "1D"}
    out = [fn("density_to_kg_per_l", _DENSITY, "coalesce(density.kgPerL, density.lbPerGal * 0.45359237D / 3.785411784D)")]
    for v, liters in volume.items():
        for m, kilograms in mass.items():
            out.append(fn(f"{v}_to_{m}", f"x, {_DENSITY}", f"x * {liters} * density_to_kg_per_l(density) / {kilograms}"))
            out.append(fn(f"{m}_to_{v}", f"x, {_DENSITY}", f"try_divide(x * {kilograms}, density_to_kg_per_l(density)) / {liters}"))
    return out


def _isa_ratio(feet: str) -> str:
    return f"power(1 - (0.0065D * ({feet} * 0.3048D)) / 288.15D, {_EXPONENT})"


_OTHER = [
    fn("kilometers_to_feet", "x", "(x * 1000D) / 0.3048D"),
    fn("feet_to_kilometers", "x", "(x * 0.3048D) / 1000D"),
    fn("inches_of_mercury_to_kilopascals", "x", "(x * 33.8639D) / 10D"),
    fn("kilopascals_to_inches_of_mercury", "x", "(x * 10D) / 33.8639D"),
    fn("kilopascals_to_millimeters_of_mercury", "x", "x * 10D * (760 / 1013.25D)"),
    fn("millimeters_of_mercury_to_kilopascals", "x", "x / (760 / 1013.25D) / 10D"),
    fn("celsius_to_fahrenheit", "x", "x * (9 / 5D) + 32D"),
    fn("fahrenheit_to_celsius", "x", "(x - 32D) * (5 / 9D)"),
    fn("celsius_to_kelvin", "x", "x + 273.15D"),
    fn("kelvin_to_celsius", "x", "x - 273.15D"),
    fn("fahrenheit_to_kelvin", "x", "celsius_to_kelvin(fahrenheit_to_celsius(x))"),
    fn("kelvin_to_fahrenheit", "x", "celsius_to_fahrenheit(kelvin_to_celsius(x))"),
    fn("degrees_to_radians", "x", "x * (pi() / 180)"),
    fn("radians_to_degrees", "x", "x * (180 / pi())"),
    fn("qnh_to_qfe", "qnh_hpa, elevation_ft", f"qnh_hpa * {_isa_ratio('elevation_ft')}"),
    fn("qfe_to_qnh", "qfe_hpa, elevation_ft", f"qfe_hpa / {_isa_ratio('elevation_ft')}"),
    fn(
        "pressure_altitude_ft",
        "indicated_ft, qnh_inhg",
        f"(288.15D / 0.0065D) * (1 - power(qnh_inhg * 33.8639D * {_isa_ratio('indicated_ft')} / 1013.25D, 1 / {_EXPONENT})) / 0.3048D",
    ),
    fn("isa_temperature_celsius", "pressure_altitude", "CASE WHEN pressure_altitude <= 36089.24D THEN 15 - 1.98122D * (pressure_altitude / 1000) ELSE -56.5D END"),
    fn(
        "pressure_at_altitude_hpa",
        "altitude_ft, sea_level_hpa DOUBLE DEFAULT 1013.25D",
        f"""CASE WHEN altitude_ft <= 36089.24D THEN sea_level_hpa * {_isa_ratio('altitude_ft')}
            ELSE sea_level_hpa * {_isa_ratio('36089.24D')} * exp((-9.80665D * ((altitude_ft - 36089.24D) * 0.3048D)) / (287.05287D * 216.65D)) END""",
    ),
    fn(
        "density_altitude_ft",
        "pressure_altitude, oat_celsius",
        f"""(288.15D - 288.15D * power(power((isa_temperature_celsius(pressure_altitude) + 273.15D) / 288.15D, {_EXPONENT})
            * (288.15D / (oat_celsius + 273.15D)), 1 / ({_EXPONENT} - 1))) / 0.0065D / 0.3048D""",
    ),
    fn("speed_of_sound_kt", "celsius", "661.4788D * sqrt((celsius + 273.15D) / 288.15D)"),
    fn(
        "tas_from_cas_kt",
        "cas_kt, pressure_altitude, oat_celsius DOUBLE DEFAULT NULL",
        """speed_of_sound_kt(coalesce(oat_celsius, isa_temperature_celsius(pressure_altitude))) * sqrt(5 * (power(
            1013.25D * (power(1 + power(cas_kt / 661.4788D, 2) / 5, 3.5D) - 1) / pressure_at_altitude_hpa(pressure_altitude) + 1, 2 / 7D) - 1))""",
    ),
    fn(
        "cas_from_tas_kt",
        "tas_kt, pressure_altitude, oat_celsius DOUBLE DEFAULT NULL",
        """661.4788D * sqrt(5 * (power(pressure_at_altitude_hpa(pressure_altitude) * (power(
            power(tas_kt / speed_of_sound_kt(coalesce(oat_celsius, isa_temperature_celsius(pressure_altitude))), 2) / 5 + 1, 3.5D) - 1) / 1013.25D + 1, 2 / 7D) - 1))""",
    ),
    fn("mach_from_tas_kt", "tas_kt, oat_celsius", "tas_kt / speed_of_sound_kt(oat_celsius)"),
    fn("tas_from_mach_kt", "mach, oat_celsius", "mach * speed_of_sound_kt(oat_celsius)"),
]


def _grouped(value: str, digits: str) -> str:
    """A number with thousands separators, halves away from zero, as number formats show it."""
    return f"format_number(sign({value}) * floor(abs({value}) * power(10, {digits}) + 0.5) / power(10, {digits}), {digits})"


def _formats() -> list[SqlFunction]:
    out = [
        fn("is_flight_level", "altitude_ft", "altitude_ft >= 18000D", "BOOLEAN"),
        fn("format_flight_level", "altitude_ft", "concat('FL', CASE WHEN floor(altitude_ft / 100 + 0.5) < 1000 THEN lpad(cast(floor(altitude_ft / 100 + 0.5) AS STRING), 3, '0') ELSE cast(floor(altitude_ft / 100 + 0.5) AS STRING) END)", "STRING"),
        fn("format_altitude", "altitude_ft, digits INT DEFAULT 0", f"CASE WHEN is_flight_level(altitude_ft) THEN format_flight_level(altitude_ft) ELSE concat({_grouped('altitude_ft', 'digits')}, ' ft') END", "STRING"),
    ]
    # fixed values: decimals shown by default for each unit
    shown = {
        "format_speed": {"kt": 0, "km/h": 0, "mph": 0, "m/s": 1},
        "format_qnh": {"inHg": 2, "hPa": 0, "mmHg": 0, "mb": 0, "kPa": 2},
        "format_distance": {"nm": 1, "sm": 1, "km": 1, "m": 0, "ft": 0},
        "format_fuel": {"gal": 1, "L": 1, "lb": 0, "kg": 0},
    }
    for name, units in shown.items():
        cases = " ".join(f"WHEN '{u}' THEN {d}" for u, d in units.items())
        body = f"concat({_grouped('value', f'coalesce(digits, CASE unit {cases} END)')}, ' ', unit)"
        if name == "format_speed":
            body = f"CASE WHEN unit = 'mach' THEN concat('M', replace({_grouped('value', 'coalesce(digits, 2)')}, ',', '')) ELSE {body} END"
        out.append(fn(name, "value, unit STRING, digits INT DEFAULT NULL", body, "STRING"))
    deviation = "floor(value - isa_temperature_celsius(altitude_ft) + 0.5)"
    note = f"CASE WHEN unit = 'C' AND altitude_ft IS NOT NULL THEN concat(' (', CASE WHEN {deviation} >= 0 THEN '+' ELSE '' END, cast(cast({deviation} AS BIGINT) AS STRING), ' ISA)') ELSE '' END"
    out.append(
        fn(
            "format_temperature",
            "value, unit STRING, digits INT DEFAULT 0, altitude_ft DOUBLE DEFAULT NULL",
            f"concat({_grouped('value', 'digits')}, CASE WHEN unit = 'K' THEN 'K' ELSE concat('°', unit) END, {note})",
            "STRING",
        )
    )
    return out


FUNCTIONS = [*_conversions(), *_OTHER, *_fuel(), *_formats()]
