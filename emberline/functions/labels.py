"""Labels and small conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
METHANE_GWP, HOURS_A_YEAR = 28, 8760
NUMBER_MARKS = ("", "-", "–", "N/A", "n/a")


def number(text: Column) -> Column:
    """A double, or null for what isn't one and for NaN."""
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))


def reported_number(text: Column) -> Column:
    """A number with thousands separators or a currency sign; null for blank marks and what isn't one."""
    plain = F.trim(F.regexp_replace(text, "[,$]", ""))
    return F.when(~plain.isin(*NUMBER_MARKS), plain.try_cast("double"))


def association(point_km: Column, any_km: Column, any_layer: Column) -> Column:
    """Band of the nearest infrastructure within 10 km: of a point feature by distance, else of a line."""
    return (
        F.when(point_km.isNull() & any_km.isNull(), F.lit("none within 10 km"))
        .when(point_km.isNull(), F.lit("linear-only"))
        .when(point_km <= 1, F.lit("high"))
        .when(point_km <= 3, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def watch_status(detections: Column, overpasses: Column) -> Column:
    """In this order: emitting, unknown, blind spot, watched, under-observed."""
    return (
        F.when(detections > 0, F.lit("emitting"))
        .when(overpasses.isNull(), F.lit("unknown"))
        .when(overpasses == 0, F.lit("blind spot"))
        .when(overpasses >= 10, F.lit("watched, no plume"))
        .otherwise(F.lit("under-observed"))
    )


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def iso_week_label(day: Column) -> Column:
    """ISO year and week, like 2026-W53."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), day).cast("int"), F.extract(F.lit("WEEK"), day).cast("int"))


def tonnes_to_kg_hr(rate: Column) -> Column:
    return rate * 1000


def reported_kg_hr(tco2e: Column) -> Column:
    """A year's tonnes of CO2 equivalent as kilograms of methane an hour, rounded half to even."""
    return F.bround(tco2e / METHANE_GWP * 1000 / HOURS_A_YEAR, 0)


def wind_toward(wind_from: Column) -> Column:
    """The modulus comes first and the rounding last, so 360 can occur."""
    return F.bround((wind_from + 180) % 360, 0)


def compass(degrees: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(names, (F.floor(((degrees + 22.5) % 360) / 45) + 1).cast("int"))


def circle_radius(rate: Column, near: bool) -> Column:
    """Radius of a detection's circle, at zoom 9 if near, else at zoom 3."""
    top, base, step, none = (22, 7, 150, 9) if near else (9, 3, 400, 4)
    return F.when(rate.isNotNull(), F.least(F.lit(float(top)), base + rate / step)).otherwise(F.lit(float(none)))


def html_escape(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def iso_date(stamp: Column) -> Column:
    """YYYY-MM-DD of YYYYMMDD, else the text itself."""
    return F.when(F.length(stamp) == 8, F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2))).otherwise(stamp)


def age_days(stamp: Column, as_of: str) -> Column:
    """Whole days from a timestamp's text to as_of; null for a bad one."""
    return F.datediff(F.lit(as_of).cast("date"), stamp.try_cast("timestamp").cast("date"))


def token_expiry(token: Column) -> Column:
    """exp of a web token's payload, seconds since 1970; null if there is none."""
    part = F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.rpad(part, (F.ceil(F.length(part) / 4) * 4).cast("int"), F.lit("="))
    return F.get_json_object(F.try_to_binary(padded, F.lit("base64")).cast("string"), "$.exp").try_cast("bigint")


def expiry_note(exp: Column, now: Column) -> Column:
    days = F.floor((exp - now) / 86400)
    return F.when(exp < now, F.lit("expired")).when(days <= 7, F.concat(F.lit("expires in "), days, F.lit(" d"))).otherwise(F.concat(F.lit("valid "), days, F.lit(" d")))


def config_value(text: Column) -> Column:
    """Without blanks around it and without quotes; blank is null."""
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.nullif(bare(F.regexp_replace(bare(text), "^[\"']|[\"']$", "")), F.lit(""))


def days_ago(stamp: Column, now: Column) -> Column:
    """Whole days of 86,400 seconds from a timestamp's text to now, a timestamp; null for a bad one."""
    return F.floor((F.unix_millis(now) - F.unix_millis(stamp.try_cast("timestamp"))) / 86_400_000)


def image_corners(bounds: Column) -> Column:
    """Corners of an image from its west, south, east and north, clockwise from the upper left."""
    w, s, e, n = (F.element_at(bounds, k) for k in (1, 2, 3, 4))
    return F.array(F.array(w, n), F.array(e, n), F.array(e, s), F.array(w, s))


def composite_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), key)


def placed_id(prefix: str, day: Column, lat: Column, lon: Column) -> Column:
    """An id of a date and a place to three decimals."""
    return F.concat(F.lit(prefix + ":"), day, F.lit("-"), F.format_string("%.3f", lat), F.lit("-"), F.format_string("%.3f", lon))


def month_periods(start: Column, end: Column) -> Column:
    """label, first and last (exclusive) of each month from that of start on to end; the first may begin before start."""
    firsts = F.sequence(F.trunc(start, "month"), F.date_sub(end, 1), F.expr("interval 1 month"))
    return F.transform(firsts, lambda d: F.struct(month_label(d).alias("label"), d.alias("first"), F.least(F.add_months(d, 1), end).alias("last")))


def week_periods(start: Column, end: Column) -> Column:
    """The same for weeks from Monday, with ISO labels."""
    firsts = F.sequence(F.trunc(start, "week"), F.date_sub(end, 1), F.expr("interval 7 days"))
    return F.transform(firsts, lambda d: F.struct(iso_week_label(d).alias("label"), d.alias("first"), F.least(F.date_add(d, 7), end).alias("last")))
