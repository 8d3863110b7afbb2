"""Flight mathematics: wind, vertical profile, turns, holding, planning, sun."""

from __future__ import annotations

from .sqlfn import fn

_WIND_ANGLE = "degrees(asin(greatest(-1D, least(1D, try_divide(wind_kt, tas_kt) * sin(radians(wind_deg - course_deg))))))"
_PLAN = "STRUCT<distanceNm: DOUBLE, timeHrs: DOUBLE>"
_TIMES = "STRUCT<sunrise: TIMESTAMP, sunset: TIMESTAMP, civilTwilightBegin: TIMESTAMP, civilTwilightEnd: TIMESTAMP>"

_WIND = [
    fn("wind_correction_deg", "tas_kt, course_deg, wind_deg, wind_kt", _WIND_ANGLE),
    fn("wind_heading_deg", "tas_kt, course_deg, wind_deg, wind_kt", "pmod(course_deg + wind_correction_deg(tas_kt, course_deg, wind_deg, wind_kt), 360D)"),
    fn(
        "wind_ground_speed_kt",
        "tas_kt, heading_deg, wind_deg, wind_kt",
        """sqrt(pow(tas_kt * sin(radians(heading_deg)) - wind_kt * sin(radians(wind_deg)), 2)
            + pow(tas_kt * cos(radians(heading_deg)) - wind_kt * cos(radians(wind_deg)), 2))""",
    ),
    fn(
        "wind_triangle",
        "tas_kt, course_deg, wind_deg, wind_kt",
        """named_struct('trueHeadingDeg', wind_heading_deg(tas_kt, course_deg, wind_deg, wind_kt),
            'windCorrectionAngleDeg', wind_correction_deg(tas_kt, course_deg, wind_deg, wind_kt),
            'groundSpeedKt', wind_ground_speed_kt(tas_kt, wind_heading_deg(tas_kt, course_deg, wind_deg, wind_kt), wind_deg, wind_kt))""",
        "STRUCT<trueHeadingDeg: DOUBLE, windCorrectionAngleDeg: DOUBLE, groundSpeedKt: DOUBLE>",
    ),
    fn(
        "headwind_crosswind",
        "wind_deg, wind_kt, heading_deg",
        "named_struct('headwindKt', wind_kt * cos(radians(wind_deg - heading_deg)), 'crosswindKt', wind_kt * sin(radians(wind_deg - heading_deg)))",
        "STRUCT<headwindKt: DOUBLE, crosswindKt: DOUBLE>",
    ),
    fn("wind_drift_east", "gs_kt, tas_kt, heading_deg, track_deg", "gs_kt * sin(radians(track_deg)) - tas_kt * sin(radians(heading_deg))"),
    fn("wind_drift_north", "gs_kt, tas_kt, heading_deg, track_deg", "gs_kt * cos(radians(track_deg)) - tas_kt * cos(radians(heading_deg))"),
    fn(
        "find_wind",
        "gs_kt, tas_kt, heading_deg, track_deg",
        """named_struct('directionDeg', pmod(degrees(atan2(wind_drift_east(gs_kt, tas_kt, heading_deg, track_deg),
                wind_drift_north(gs_kt, tas_kt, heading_deg, track_deg))) + 180, 360D),
            'speedKt', sqrt(pow(wind_drift_east(gs_kt, tas_kt, heading_deg, track_deg), 2) + pow(wind_drift_north(gs_kt, tas_kt, heading_deg, track_deg), 2)))""",
        "STRUCT<directionDeg: DOUBLE, speedKt: DOUBLE>",
    ),
    fn("crosswind_component", "wind_deg, wind_kt, runway_deg", "abs(headwind_crosswind(wind_deg, wind_kt, runway_deg).crosswindKt)"),
]

_VERTICAL = [
    fn("density_altitude", "elevation_ft, altimeter_inhg, oat_celsius", "density_altitude_ft(pressure_altitude_ft(elevation_ft, altimeter_inhg), oat_celsius)"),
    fn(
        "true_altitude",
        "indicated_ft, altimeter_inhg, oat_celsius, station_ft DOUBLE DEFAULT NULL",
        """coalesce(station_ft, 0D) + (indicated_ft - coalesce(station_ft, 0D)) * try_divide(oat_celsius + 273.15D,
            isa_temperature_celsius(pressure_altitude_ft(indicated_ft, altimeter_inhg)) + 273.15D)""",
    ),
    fn("top_of_descent", "current_ft, target_ft, angle_deg", "try_divide(current_ft - target_ft, tan(radians(angle_deg)) * 6076.11549D)"),
    fn("top_of_descent_from_rate", "current_ft, target_ft, rate_fpm, gs_kt", "gs_kt * (try_divide(current_ft - target_ft, rate_fpm) / 60)"),
    fn("required_descent_rate", "nm, current_ft, target_ft, gs_kt", "try_divide(current_ft - target_ft, try_divide(nm, gs_kt) * 60)"),
    fn("required_climb_rate", "nm, current_ft, target_ft, gs_kt", "try_divide(target_ft - current_ft, try_divide(nm, gs_kt) * 60)"),
    fn("vertical_speed_to_gradient", "fpm, gs_kt", "degrees(atan(try_divide(fpm, gs_kt * (6076.11549D / 60))))"),
    fn("gradient_to_vertical_speed", "gradient_deg, gs_kt", "tan(radians(gradient_deg)) * (gs_kt * (6076.11549D / 60))"),
    fn("visual_descent_point", "angle_deg, crossing_ft", "try_divide(crossing_ft, tan(radians(angle_deg)) * 6076.11549D)"),
    fn("glide_distance", "agl_ft, ratio", "agl_ft * ratio / 6076.11549D"),
    fn("glide_distance_with_wind", "agl_ft, ratio, tas_kt, headwind_kt", "glide_distance(agl_ft, ratio) * try_divide(tas_kt - headwind_kt, tas_kt)"),
    fn("pivotal_altitude", "gs_kt", "(gs_kt * gs_kt) / 11.3D"),
]

_HOLD_TURN = "CASE WHEN right_turns THEN heading_deg - inbound_deg - 180 ELSE inbound_deg + 180 - heading_deg END"
_TURNS = [
    fn("knots_to_fps", "kt", "kt * (6076.11549D / 3600)"),
    fn("turn_radius", "tas_kt, bank_deg", "try_divide(pow(knots_to_fps(tas_kt), 2), 32.174D * tan(radians(bank_deg))) / 6076.11549D"),
    fn("standard_rate_bank_angle", "tas_kt", "degrees(atan(knots_to_fps(tas_kt) * radians(3D) / 32.174D))"),
    fn("standard_rate_turn_radius", "tas_kt", "turn_radius(tas_kt, standard_rate_bank_angle(tas_kt))"),
    fn("time_to_turn", "turn_deg, rate DOUBLE DEFAULT 3D", "try_divide(abs(turn_deg), rate)"),
    fn("load_factor", "bank_deg", "try_divide(1D, cos(radians(bank_deg)))"),
    # not pmod: it turns an angle a hair below zero, which lies below a whole turn, into zero
    fn("hold_angle", "inbound_deg, heading_deg, right_turns BOOLEAN", f"({_HOLD_TURN}) - 360 * floor(({_HOLD_TURN}) / 360)"),
    fn(
        "holding_pattern_entry",
        "inbound_deg, heading_deg, right_turns BOOLEAN DEFAULT true",
        """CASE WHEN hold_angle(inbound_deg, heading_deg, right_turns) < 70 THEN 'parallel'
            WHEN hold_angle(inbound_deg, heading_deg, right_turns) < 180 THEN 'teardrop' ELSE 'direct' END""",
        "STRING",
    ),
    fn("dme_arc_lead_radial", "arc_nm, tas_kt, bank_deg DOUBLE DEFAULT 25D", "degrees(asin(least(try_divide(turn_radius(tas_kt, bank_deg), arc_nm), 1D)))"),
    fn("correction_angle", "off_nm, flown_nm", "60 * try_divide(off_nm, flown_nm)"),
    fn("off_course_distance", "error_deg, flown_nm", "(error_deg / 60) * flown_nm"),
]

_PLANNING = [
    fn("fuel_required", "nm, gs_kt, burn", "try_divide(nm, gs_kt) * burn"),
    fn("endurance", "fuel, burn", "try_divide(fuel, burn)"),
    fn("endurance_distance_nm", "fuel, burn, gs_kt", "endurance(fuel, burn) * gs_kt"),
    fn("no_return_nm", "fuel, burn, out_kt, back_kt", "endurance(fuel, burn) * try_divide(out_kt * back_kt, out_kt + back_kt)"),
    fn("equal_time_nm", "nm, out_kt, back_kt", "nm * try_divide(back_kt, out_kt + back_kt)"),
    fn(
        "point_of_no_return",
        "fuel, burn, out_kt, back_kt",
        "named_struct('distanceNm', no_return_nm(fuel, burn, out_kt, back_kt), 'timeHrs', try_divide(no_return_nm(fuel, burn, out_kt, back_kt), out_kt))",
        _PLAN,
    ),
    fn(
        "equal_time_point",
        "nm, out_kt, back_kt",
        "named_struct('distanceNm', equal_time_nm(nm, out_kt, back_kt), 'timeHrs', try_divide(equal_time_nm(nm, out_kt, back_kt), out_kt))",
        _PLAN,
    ),
]

# fixed values: the low-precision solar position series, t in Julian centuries from 2000
_SUN = [
    fn("julian_day", "d DATE", "datediff(d, DATE'2000-01-01') + 2451544.5D"),
    fn("julian_century", "jd", "(jd - 2451545) / 36525"),
    fn("sun_longitude", "t", "(280.46646D + t * (36000.76983D + 0.0003032D * t)) % 360"),
    fn("sun_anomaly", "t", "radians(357.52911D + t * (35999.05029D - 0.0001537D * t))"),
    fn("sun_node", "t", "radians(125.04D - 1934.136D * t)"),
    fn(
        "sun_apparent",
        "t",
        """radians(sun_longitude(t) + sin(sun_anomaly(t)) * (1.914602D - t * (0.004817D + 0.000014D * t))
            + sin(2 * sun_anomaly(t)) * (0.019993D - 0.000101D * t) + sin(3 * sun_anomaly(t)) * 0.000289D - 0.00569D - 0.00478D * sin(sun_node(t)))""",
    ),
    fn(
        "sun_obliquity",
        "t",
        "radians(23 + (26 + (21.448D - t * (46.815D + t * (0.00059D - t * 0.001813D))) / 60) / 60 + 0.00256D * cos(sun_node(t)))",
    ),
    fn("sun_declination_deg", "t", "degrees(asin(sin(sun_obliquity(t)) * sin(sun_apparent(t))))"),
    fn(
        "equation_of_time_min",
        "t",
        """4 * degrees(pow(tan(sun_obliquity(t) / 2), 2) * sin(2 * radians(sun_longitude(t))) - 2 * sun_eccentricity(t) * sin(sun_anomaly(t))
            + 4 * sun_eccentricity(t) * pow(tan(sun_obliquity(t) / 2), 2) * sin(sun_anomaly(t)) * cos(2 * radians(sun_longitude(t)))
            - 0.5D * pow(tan(sun_obliquity(t) / 2), 4) * sin(4 * radians(sun_longitude(t))) - 1.25D * pow(sun_eccentricity(t), 2) * sin(2 * sun_anomaly(t)))""",
    ),
    fn(
        "solar_geometry",
        "t",
        "named_struct('declinationDeg', sun_declination_deg(t), 'eqOfTimeMin', equation_of_time_min(t))",
        "STRUCT<declinationDeg: DOUBLE, eqOfTimeMin: DOUBLE>",
    ),
    fn(
        "hour_angle_deg",
        "zenith_deg, lat, declination_deg",
        """degrees(acos(CASE WHEN abs(hour_cosine(zenith_deg, lat, declination_deg)) <= 1 THEN hour_cosine(zenith_deg, lat, declination_deg) END))""",
    ),
    fn("solar_noon_min", "lon, d DATE", "720 - 4 * lon - equation_of_time_min(julian_century(julian_day(d)))"),
    fn("solar_offset_min", "zenith_deg, lat, d DATE", "4 * hour_angle_deg(zenith_deg, lat, sun_declination_deg(julian_century(julian_day(d))))"),
    fn(
        "minutes_to_time",
        "d DATE, minutes",
        "timestampadd(SECOND, cast(floor(minutes) * 60 + floor((minutes - floor(minutes)) * 60 + 0.5) AS BIGINT), cast(d AS TIMESTAMP))",
        "TIMESTAMP",
    ),
    fn(
        "solar_times",
        "lat, lon, d DATE",
        """named_struct('sunrise', minutes_to_time(d, solar_noon_min(lon, d) - solar_offset_min(90.833D, lat, d)),
            'sunset', minutes_to_time(d, solar_noon_min(lon, d) + solar_offset_min(90.833D, lat, d)),
            'civilTwilightBegin', minutes_to_time(d, solar_noon_min(lon, d) - solar_offset_min(96D, lat, d)),
            'civilTwilightEnd', minutes_to_time(d, solar_noon_min(lon, d) + solar_offset_min(96D, lat, d)))""",
        _TIMES,
    ),
    fn(
        "is_daytime",
        "lat, lon, at TIMESTAMP",
        """coalesce(at BETWEEN minutes_to_time(cast(at AS DATE), solar_noon_min(lon, cast(at AS DATE)) - solar_offset_min(96D, lat, cast(at AS DATE)))
                AND minutes_to_time(cast(at AS DATE), solar_noon_min(lon, cast(at AS DATE)) + solar_offset_min(96D, lat, cast(at AS DATE))),
            90 - abs(lat - sun_declination_deg(julian_century(julian_day(cast(at AS DATE))))) > -6)""",
        "BOOLEAN",
    ),
    fn("decimal_year", "at TIMESTAMP", "year(at) + (unix_millis(at) - unix_millis(date_trunc('YEAR', at))) / (unix_millis(date_trunc('YEAR', at) + INTERVAL 1 YEAR) - unix_millis(date_trunc('YEAR', at)))"),
    fn("airac_date", "yy INT, nn INT", "CASE WHEN yy BETWEEN 24 AND 57 AND nn BETWEEN 1 AND 13 THEN date_add(DATE'2024-01-25', 28 * ((yy - 24) * 13 + nn - 1)) END", "DATE"),
]
_SUN.insert(0, fn("sun_eccentricity", "t", "0.016708634D - t * (0.000042037D + 0.0000001267D * t)"))
_SUN.insert(0, fn("hour_cosine", "zenith_deg, lat, declination_deg", "try_divide(cos(radians(zenith_deg)) - sin(radians(lat)) * sin(radians(declination_deg)), cos(radians(lat)) * cos(radians(declination_deg)))"))

FUNCTIONS = [*_WIND, *_VERTICAL, *_TURNS, *_PLANNING, *_SUN]
