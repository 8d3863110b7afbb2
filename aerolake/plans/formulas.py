"""Queries over the scalar functions, each with its formula written out in plain SQL."""

from __future__ import annotations

from ..functions import units
from . import views

_R = "3440.065"


def _mod(x: str) -> str:
    return f"(({x}) - 360 * floor(({x}) / 360))"


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * {_R} * asin(sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


_LEG = "lat1, lon1, lat2, lon2"
_DIST = _hav("lat1", "lon1", "lat2", "lon2")
_BEARING = _mod("degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1))))")
_WCA = "degrees(asin(greatest(-1, least(1, windKt / tas * sin(radians(windDeg - course))))))"
_HDG = _mod(f"course + {_WCA}")
_GS = f"sqrt(pow(tas * sin(radians({_HDG})) - windKt * sin(radians(windDeg)), 2) + pow(tas * cos(radians({_HDG})) - windKt * cos(radians(windDeg)), 2))"
_N = "(9.80665 / (287.05287 * 0.0065))"
_ISA = "(case when altitude <= 36089.24 then 15 - 1.98122 * altitude / 1000 else -56.5 end)"
_P = f"(1013.25 * pow(1 - 0.0065 * altitude * 0.3048 / 288.15, {_N}))"
_SOUND = "(661.4788 * sqrt((oat + 273.15) / 288.15))"
_TAS = f"({_SOUND} * sqrt(5 * (pow(1013.25 * (pow(1 + pow(tas / 661.4788, 2) / 5, 3.5) - 1) / {_P} + 1, 2e0 / 7) - 1)))"
_DA = f"((288.15 - 288.15 * pow(pow(({_ISA} + 273.15) / 288.15, {_N}) * (288.15 / (oat + 273.15)), 1 / ({_N} - 1))) / 0.0065 / 0.3048)"
_PA = f"((288.15 / 0.0065) * (1 - pow(qnh * 33.8639 * pow(1 - 0.0065 * altitude * 0.3048 / 288.15, {_N}) / 1013.25, 1 / {_N})) / 0.3048)"
_E = f"(({_DIST}) * sin(radians({_BEARING})) - tas * sin(radians(course)))"
_FPS = "(tas * 6076.11549 / 3600)"
_HOLD = f"(case when rightTurns then {_mod('windDeg - course - 180')} else {_mod('course + 180 - windDeg')} end)"
_DN = f"{_R}"
_DLAT = f"asin(sin(radians(lat1)) * cos(nm / {_DN}) + cos(radians(lat1)) * sin(nm / {_DN}) * cos(radians(course)))"


def _east(x: str) -> str:
    """Degrees of longitude from -180 to below 180."""
    return f"({x} + 180 - 360 * floor(({x} + 180) / 360) - 180)"


#: query: (view, keys, {column: (with this library's functions, written out)}); numbers are rounded to 6 places.
FORMULAS: dict[str, tuple[str, str, dict[str, tuple[str, str]]]] = {
    "gc_distance": ("flights", "route_id, leg", {"nm": (f"distance_nm({_LEG})", _DIST)}),
    "gc_bearing": ("flights", "route_id, leg", {"deg": (f"bearing_deg({_LEG})", _BEARING), "nm": (f"bearing_and_distance({_LEG}).distanceNm", _DIST)}),
    "gc_midpoint": (
        "flights",
        "route_id, leg",
        {
            "lat": (f"midpoint({_LEG}).lat", "degrees(atan2(sin(radians(lat1)) + sin(radians(lat2)), sqrt(pow(cos(radians(lat1)) + cos(radians(lat2)) * cos(radians(lon2 - lon1)), 2) + pow(cos(radians(lat2)) * sin(radians(lon2 - lon1)), 2))))"),
            "lon": (f"midpoint({_LEG}).lon", _east("degrees(radians(lon1) + atan2(cos(radians(lat2)) * sin(radians(lon2 - lon1)), cos(radians(lat1)) + cos(radians(lat2)) * cos(radians(lon2 - lon1))))")),
        },
    ),
    "gc_destination": (
        "flights",
        "route_id, leg",
        {
            "lat": ("destination(lat1, lon1, course, nm).lat", f"degrees({_DLAT})"),
            "lon": ("destination(lat1, lon1, course, nm).lon", _east(f"degrees(radians(lon1) + atan2(sin(radians(course)) * sin(nm / {_DN}) * cos(radians(lat1)), cos(nm / {_DN}) - sin(radians(lat1)) * sin({_DLAT})))")),
        },
    ),
    "isa_atmosphere": ("flights", "route_id, leg", {"celsius": ("isa_temperature_celsius(altitude + 1e0 / 3)", _ISA.replace("altitude", "(altitude + 1e0 / 3)")), "hpa": ("pressure_at_altitude_hpa(altitude)", _P), "sound": ("speed_of_sound_kt(oat)", _SOUND)}),
    "pressure_altitude": ("flights", "route_id, leg", {"ft": ("pressure_altitude_ft(altitude, qnh)", _PA), "qfe": ("qnh_to_qfe(1000D, altitude)", f"1000 * {_P} / 1013.25"), "qnh": ("qfe_to_qnh(1000D, altitude)", f"1000 / ({_P} / 1013.25)")}),
    "density_altitude": ("flights", "route_id, leg", {"ft": ("density_altitude_ft(altitude, oat)", _DA)}),
    "tas_from_cas": ("flights", "route_id, leg", {"tasKt": ("tas_from_cas_kt(tas, altitude, oat)", _TAS), "casKt": ("cas_from_tas_kt(tas_from_cas_kt(tas, altitude, oat), altitude, oat)", "tas")}),
    "mach": ("flights", "route_id, leg", {"mach": ("mach_from_tas_kt(tas, oat)", f"tas / {_SOUND}"), "kt": ("tas_from_mach_kt(0.8D, oat)", f"0.8 * {_SOUND}")}),
    "wind_triangle": ("flights", "route_id, leg", {"headingDeg": ("wind_triangle(tas, course, windDeg, windKt).trueHeadingDeg", _HDG), "wcaDeg": ("wind_triangle(tas, course, windDeg, windKt).windCorrectionAngleDeg", _WCA), "gsKt": ("wind_triangle(tas, course, windDeg, windKt).groundSpeedKt", _GS)}),
    "headwind_crosswind": ("flights", "route_id, leg", {"headKt": ("headwind_crosswind(windDeg, windKt, course).headwindKt", "windKt * cos(radians(windDeg - course))"), "crossKt": ("headwind_crosswind(windDeg, windKt, course).crosswindKt", "windKt * sin(radians(windDeg - course))"), "sideKt": ("crosswind_component(windDeg, windKt, course)", "abs(windKt * sin(radians(windDeg - course)))")}),
    "find_wind": ("flights", "route_id, leg", {"kt": ("find_wind(nm, tas, course, windDeg).speedKt", "sqrt(pow(nm * sin(radians(windDeg)) - tas * sin(radians(course)), 2) + pow(nm * cos(radians(windDeg)) - tas * cos(radians(course)), 2))")}),
    "true_altitude": ("flights", "route_id, leg", {"ft": ("true_altitude(altitude, qnh, oat, 500D)", f"500 + (altitude - 500) * (oat + 273.15) / ((case when {_PA} <= 36089.24 then 15 - 1.98122 * {_PA} / 1000 else -56.5 end) + 273.15)")}),
    "top_of_descent": ("flights", "route_id, leg", {"nm": ("top_of_descent(altitude, 1000D, angle)", "(altitude - 1000) / (tan(radians(angle)) * 6076.11549)"), "byRateNm": ("top_of_descent_from_rate(altitude, 1000D, 900D, tas)", "tas * ((altitude - 1000) / 900 / 60)")}),
    "climb_rate": ("flights", "route_id, leg", {"down": ("required_descent_rate(nm, altitude, 1000D, tas)", "(altitude - 1000) / (nm / tas * 60)"), "up": ("required_climb_rate(nm, 1000D, altitude, tas)", "(altitude - 1000) / (nm / tas * 60)"), "gradient": ("vertical_speed_to_gradient(700D, tas)", "degrees(atan(700 / (tas * (6076.11549 / 60))))"), "fpm": ("gradient_to_vertical_speed(angle, tas)", "tan(radians(angle)) * tas * 6076.11549 / 60")}),
    "glide_wind": ("flights", "route_id, leg", {"nm": ("glide_distance(altitude, 9.5D)", "altitude * 9.5 / 6076.11549"), "windNm": ("glide_distance_with_wind(altitude, 9.5D, tas, windKt)", "altitude * 9.5 / 6076.11549 * (tas - windKt) / tas"), "vdpNm": ("visual_descent_point(angle, altitude)", "altitude / (tan(radians(angle)) * 6076.11549)"), "pivotalFt": ("pivotal_altitude(tas)", "tas * tas / 11.3")}),
    "turn_radius": ("flights", "route_id, leg", {"nm": ("turn_radius(tas, bank)", f"pow({_FPS}, 2) / (32.174 * tan(radians(bank))) / 6076.11549"), "bankDeg": ("standard_rate_bank_angle(tas)", f"degrees(atan({_FPS} * radians(3) / 32.174))"), "standardNm": ("standard_rate_turn_radius(tas)", f"{_FPS} / radians(3) / 6076.11549"), "sec": ("time_to_turn(windDeg)", "windDeg / 3")}),
    "load_factor": ("flights", "route_id, leg", {"g": ("load_factor(bank)", "1 / cos(radians(bank))")}),
    "holding_entry": ("flights", "route_id, leg", {"entry": ("holding_pattern_entry(course, windDeg, rightTurns)", f"case when {_HOLD} < 70 then 'parallel' when {_HOLD} < 180 then 'teardrop' else 'direct' end")}),
    "dme_arc_lead": ("flights", "route_id, leg", {"deg": ("dme_arc_lead_radial(nm, tas)", f"degrees(asin(least(pow({_FPS}, 2) / (32.174 * tan(radians(25))) / 6076.11549 / nm, 1)))"), "correction": ("correction_angle(burn, nm)", "60 * burn / nm"), "off": ("off_course_distance(burn, nm)", "burn / 60 * nm")}),
    "point_of_no_return": ("flights", "route_id, leg", {"nm": ("point_of_no_return(fuel, burn, tas + 1e0 / 3, nm).distanceNm", "fuel / burn * ((tas + 1e0 / 3) * nm / (tas + 1e0 / 3 + nm))"), "hrs": ("point_of_no_return(fuel, burn, tas + 1e0 / 3, nm).timeHrs", "fuel / burn * (nm / (tas + 1e0 / 3 + nm))")}),
    "equal_time_point": ("flights", "route_id, leg", {"nm": ("equal_time_point(nm, tas, tas + windKt).distanceNm", "nm * (tas + windKt) / (tas + tas + windKt)"), "hrs": ("equal_time_point(nm, tas, tas + windKt).timeHrs", "nm * (tas + windKt) / (tas + tas + windKt) / tas")}),
    "fuel_required": ("flights", "route_id, leg", {"fuelUsed": ("fuel_required(nm, tas, burn)", "nm / tas * burn"), "hrs": ("endurance(fuel, burn)", "fuel / burn"), "nm": ("endurance_distance_nm(fuel, burn, tas)", "fuel / burn * tas")}),
    "flight_levels": ("flights", "route_id, leg", {"isLevel": ("is_flight_level(altitude)", "altitude >= 18000"), "shown": ("format_altitude(altitude)", "case when altitude >= 18000 then concat('FL', lpad(cast(cast(floor(altitude / 100 + 0.5) as bigint) as string), 3, '0')) when altitude >= 1000 then concat(cast(cast(altitude as bigint) // 1000 as string), ',', lpad(cast(cast(altitude as bigint) % 1000 as string), 3, '0'), ' ft') else concat(cast(cast(altitude as bigint) as string), ' ft') end")}),
    "unit_temperature": ("flights", "route_id, leg", {"f": ("celsius_to_fahrenheit(oat)", "oat * 1.8 + 32"), "c": ("fahrenheit_to_celsius(oat)", "(oat - 32) * 5e0 / 9"), "k": ("celsius_to_kelvin(oat)", "oat + 273.15"), "fk": ("fahrenheit_to_kelvin(oat)", "(oat - 32) * 5e0 / 9 + 273.15"), "kf": ("kelvin_to_fahrenheit(oat)", "(oat - 273.15) * 1.8 + 32")}),
    "unit_fuel": ("flights", "route_id, leg", {"lb": ("gallons_to_pounds(fuel, named_struct('kgPerL', cast(NULL as double), 'lbPerGal', 6.0D))", "fuel * 6"), "kg": ("liters_to_kilograms(fuel, named_struct('kgPerL', 0.8D, 'lbPerGal', cast(NULL as double)))", "fuel * 0.8"), "gal": ("pounds_to_gallons(fuel, named_struct('kgPerL', cast(NULL as double), 'lbPerGal', 6.0D))", "fuel / 6"), "l": ("gallons_to_liters(fuel)", "fuel * 3.785411784")}),
}

#: What one of each unit is in a unit of its table, written out here and not taken from the functions.
_UNITS = {
    "unit_distance": {"nautical_miles": "1852e0", "statute_miles": "1609.344e0", "kilometers": "1000e0", "meters": "1e0", "feet": "0.3048e0"},
    "unit_speed": {"knots": "1.852e0", "kilometers_per_hour": "1e0", "miles_per_hour": "1.609344e0", "meters_per_second": "3.6e0"},
    "unit_pressure": {"inches_of_mercury": "33.8639e0", "hectopascals": "1e0", "millibars": "1e0", "millimeters_of_mercury": "(1013.25e0 / 760)", "kilopascals": "10e0"},
}
#: Pairs whose published factor is a rounded one.
_ROUNDED = {("nautical_miles", "feet"): "6076.11549e0", ("nautical_miles", "statute_miles"): "1.150779448e0", ("knots", "meters_per_second"): "0.514444e0", ("knots", "miles_per_hour"): "1.150779448e0", ("inches_of_mercury", "millimeters_of_mercury"): "25.4e0"}
for _name, _members in _UNITS.items():
    _columns = {}
    for _source, _target, _ in units._FACTORS:
        if _source in _members and _target in _members:
            _plain = _ROUNDED.get((_source, _target), f"({_members[_source]} / {_members[_target]})")
            _columns[f"{_source}_{_target}"] = (f"{_source}_to_{_target}(tas)", f"tas * {_plain}")
            _columns[f"{_target}_{_source}"] = (f"{_target}_to_{_source}(tas)", f"tas / {_plain}")
    FORMULAS[_name] = ("flights", "route_id, leg", _columns)

_FUEL = "named_struct('kgPerL', 0.8D, 'lbPerGal', cast(NULL as double))"
FORMULAS["unit_others"] = ("flights", "route_id, leg", {
    "kmFt": ("kilometers_to_feet(tas)", "tas * 1000 / 0.3048e0"), "ftKm": ("feet_to_kilometers(tas)", "tas * 0.3048e0 / 1000"), "inKpa": ("inches_of_mercury_to_kilopascals(tas)", "tas * 33.8639e0 / 10"), "kpaIn": ("kilopascals_to_inches_of_mercury(tas)", "tas * 10 / 33.8639e0"),
    "kpaMm": ("kilopascals_to_millimeters_of_mercury(tas)", "tas * 7600 / 1013.25e0"), "mmKpa": ("millimeters_of_mercury_to_kilopascals(tas)", "tas * 1013.25e0 / 7600"), "rad": ("degrees_to_radians(course)", "course * pi() / 180"), "deg": ("radians_to_degrees(course)", "course * 180 / pi()"),
    "turned": ("normalize_deg(course - 400)", _mod("course - 400")), "kgL": (f"density_to_kg_per_l({_FUEL})", "0.8e0"), "galKg": (f"gallons_to_kilograms(fuel, {_FUEL})", "fuel * 3.785411784e0 * 0.8e0"), "kgGal": (f"kilograms_to_gallons(fuel, {_FUEL})", "fuel / 0.8e0 / 3.785411784e0"),
    "lLb": (f"liters_to_pounds(fuel, {_FUEL})", "fuel * 0.8e0 / 0.45359237e0"), "lbL": (f"pounds_to_liters(fuel, {_FUEL})", "fuel * 0.45359237e0 / 0.8e0"), "kgLit": (f"kilograms_to_liters(fuel, {_FUEL})", "fuel / 0.8e0"), "lGal": ("liters_to_gallons(fuel)", "fuel / 3.785411784e0"),
    "lbKg": ("pounds_to_kilograms(fuel)", "fuel * 0.45359237e0"), "kgLb": ("kilograms_to_pounds(fuel)", "fuel / 0.45359237e0"),
})
FORMULAS["formats"] = ("flights", "route_id, leg", {
    "shownSpeed": ("format_speed(tas, 'kt')", "concat(cast(cast(tas as bigint) as string), ' kt')"), "shownQnh": ("format_qnh(tas + 600, 'hPa')", "concat(case when tas + 600 >= 1000 then '1,' else '' end, case when tas + 600 >= 1000 then lpad(cast(cast(tas + 600 as bigint) % 1000 as string), 3, '0') else cast(cast(tas + 600 as bigint) as string) end, ' hPa')"),
    "shownFuel": ("format_fuel(fuel, 'kg')", "concat(cast(cast(fuel as bigint) as string), ' kg')"), "shownDistance": ("format_distance(nm, 'nm')", "concat(cast(cast(nm as bigint) as string), '.0 nm')"), "shownKelvin": ("format_temperature(tas, 'K')", "concat(cast(cast(tas as bigint) as string), 'K')"),
})

_TEXT = {"entry", "shown", "isLevel", "shownSpeed", "shownQnh", "shownFuel", "shownDistance", "shownKelvin"}


def _select(which: int, view: str, keys: str, columns: dict) -> str:
    shown = [f"{both[which]} as {name}" if name in _TEXT else f"round({both[which]}, 6) + 0e0 as {name}" for name, both in columns.items()]
    return f"select {keys}, {', '.join(shown)} from {view}"


def _query(view: str, keys: str, columns: dict):
    def run(spark, sf_dir):
        views.prepare(spark, sf_dir)
        views.view(spark, view).createOrReplaceTempView(view)
        return spark.sql(_select(0, view, keys, columns))

    return run


QUERIES = {name: _query(*spec) for name, spec in FORMULAS.items()}
ORACLE_SQL = {name: views.oracle(name, _select(1, *spec), spec[0]) for name, spec in FORMULAS.items()}
