"""Scalar column functions: shifts, text folding, parsing, calendar, ranks by the rules of the checks."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: The names of the four shifts.
SHIFTS = ("Mañana", "Tarde", "Noche", "Madrugada")
#: Accented letters and what they fold to.
ACCENTED, PLAIN = "áéíóúàèìòùäëïöüâêîôûñçÁÉÍÓÚÀÈÌÒÙÄËÏÖÜÂÊÎÔÛÑÇ", "aeiouaeiouaeiouaeiouncAEIOUAEIOUAEIOUAEIOUNC"


def hour_of(value: Column) -> Column:
    """Hour from a number or from text `HH:MM:SS`, value by value; null if neither."""
    text = value.cast("string")
    return F.coalesce(text.try_cast("double"), F.split(text, ":").getItem(0).try_cast("double"))


def shift_of(hour: Column) -> Column:
    """The shift of an hour: [6, 14) Mañana, [14, 22) Tarde, [22, 2) Noche, [2, 6) Madrugada; null stays null."""
    h = F.pmod(hour, F.lit(24))
    return F.when(h.isNull(), None).when((h >= 6) & (h < 14), SHIFTS[0]).when((h >= 14) & (h < 22), SHIFTS[1]).when((h >= 22) | (h < 2), SHIFTS[2]).otherwise(SHIFTS[3])


def fold_name(text: Column) -> Column:
    """Accents dropped, everything but letters and digits one space, upper case, trimmed."""
    return F.upper(F.trim(F.regexp_replace(F.translate(text, ACCENTED, PLAIN), "[^A-Za-z0-9]+", " ")))


def tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct sorted tokens of a folded name without stop words."""
    words = F.filter(F.split(fold_name(text), " "), lambda t: (t != "") & ~t.isin(*stop) if stop else t != "")
    return F.array_sort(F.array_distinct(words))


def number_in(text: Column) -> Column:
    """The first whole number in a text."""
    return F.regexp_extract(text, r"([0-9]+)", 1).try_cast("long")


def thousands(text: Column) -> Column:
    """A number written with dots for thousands and a comma for decimals."""
    return F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".").try_cast("double")


def single_date(text: Column) -> Column:
    """The d/M/yyyy date in a text, if there is just one."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"), 1)
    return F.when(F.size(found) == 1, F.try_to_date(F.get(found, F.lit(0)), "d/M/yyyy"))


def day_first(text: Column) -> Column:
    """A timestamp written day first, with or without seconds."""
    formats = ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def period_date(period: Column, day: Column) -> Column:
    """The date of a yyyyMM period and a day; null where there is no such day."""
    return F.try_to_date(F.concat_ws("-", F.substring(period.cast("string"), 1, 4), F.substring(period.cast("string"), 5, 2), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def wkt_point(text: Column) -> tuple[Column, Column]:
    """x and y of `POINT (x y)`."""
    pattern = r"POINT\s*\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s*\)"
    return F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2).try_cast("double")


def week_start(date: Column) -> Column:
    """The Monday of the week."""
    return F.to_date(F.date_trunc("week", date))


def rate_per_100k(count: Column, people: Column) -> Column:
    """Cases per 100,000 people; null without people."""
    return F.when(people > 0, count * 100000.0 / people)


def one_every(count: Column, days: Column) -> tuple[Column, Column]:
    """How often something occurs: the unit (minutes, hours, days) and how many units between two cases, to a tenth."""
    minutes = days * 24 * 60.0 / count
    unit = F.when(count <= 0, None).when(minutes < 60, "minutes").when(minutes < 1440, "hours").otherwise("days")
    value = F.when(minutes < 60, minutes).when(minutes < 1440, minutes / 60).otherwise(minutes / 1440)
    return unit, F.when(count > 0, F.bround(value, 1))


def regional_number(value: Column, digits: int = 0) -> Column:
    """A number with dots for thousands and a comma for decimals."""
    return F.translate(F.format_number(value, digits), ",.", ".,")


def percent_rank_average(value: Column, *by: str | Column) -> Column:
    """Average rank over the number of non-null values of each partition; ties share the mean of their ranks."""
    part, same = Window.partitionBy(*by), Window.partitionBy(*by, value)
    rank = F.rank().over(part.orderBy(value.asc_nulls_last()))
    return F.when(value.isNotNull(), (rank + (F.count("*").over(same) - 1) / 2) / F.count(value).over(part))


def share_top(n: Column, k: float) -> Column:
    """How many of n make up the top share k: half-even rounding, one at least."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(k)).cast("int"))


def slug(text: Column) -> Column:
    """A key of a name: folded, lower case, words joined by underscores."""
    return F.replace(F.lower(fold_name(text)), F.lit(" "), F.lit("_"))


def as_list(text: Column) -> Column:
    """A JSON list of texts, or a single value, as an array; null is an empty one."""
    listed = F.from_json(text, "array<string>")
    return F.when(text.isNull(), F.array().cast("array<string>")).when(text.startswith("["), listed).otherwise(F.array(text))


def capacity(text: Column) -> Column:
    """The first number in a text, dots taken for thousands; null if there is none."""
    return F.replace(F.regexp_extract(text, r"([0-9][0-9.]*)", 1), F.lit("."), F.lit("")).try_cast("double")


def crown_radius(trunk_cm: Column, height_m: Column) -> Column:
    """A tree's drawn crown: by its trunk, or by its height where that is unknown; within fixed bounds."""
    return F.when(trunk_cm > 0, F.least(F.lit(6.0), F.greatest(F.lit(1.2), 0.08 * trunk_cm))).otherwise(F.least(F.lit(5.0), F.greatest(F.lit(1.2), 0.22 * height_m)))
