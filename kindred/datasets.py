"""Tables to try rules on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PEOPLE_SCHEMA = (
    "id long, address string, email string, account string, birth_country string, marital_status string, number_children long, property_type string, "
    "property_height double, property_area_sq_ft long, property_sea_level_elevation_m long, property_num_rooms long"
)

# The ten people that expected results of the rules are stated for.
PEOPLE = [
    (1, "123ab, OL5 9PL, UK", "bbab@example.com", "reddit", "spain", "married", 1, "rental", None, 545, 5, 3),
    (2, "99 Ambleside avenue park Road, ED3 3RT, Edinburgh, United Kingdom", "awesome_surfer_77@yahoo.com", "reddit", "spain", "married", 1, "rental", None, 452, 6, 3),
    (3, "Calle Ancho, 12, 05688, Rioja, Navarra, Espana", "a@example.com", "facebook", "germany", "single", 2, "rental", 2.5, 623, 5, 3),
    (4, "Calle Sueco, 56, 05688, Rioja, Navarra", "hellothere@example.com", "pinterest", "japan", "married", 0, "owner", 4.0, 2077, 305, 6),
    (5, None, "b@example.com", "linkedin", "france", "married", 1, "rental", 2.7, 1045, 42, 4),
    (6, "C. Ancho 49, 05687, Navarra", "b@example.com", "reddit", "japan", "married", 1, "rental", 2.5, 1323, 132, 4),
    (7, "Ambleside avenue Park Road ED3, UK", "hellthere@example.com", "reddit", "germany", "married", 0, "owner", 2.5, 509, 200, 2),
    (8, "123ab, OL5 9PL, UK", "hellathere@example.com", "facebook", "japan", "single", 3, "owner", 2.5, 500, 300, 3),
    (9, None, "yet.another.email@msn.com", "flickr", "germany", "married", 1, "rental", 2.5, 345, 22, 3),
    (10, "66b Porters street, OL5 9PL, Newark, United Kingdom", "bab@example.com", "flickr", "malaysia", "single", 0, "owner", 2.5, 4000, 25, 8),
]

_FIRST = "Ada Ben Cleo Dan Eva Finn Gia Hugo Ines Jan Kara Leo Mia Nils Olga Pia Quinn Rosa Sam Tara Uma Vera Will Yara Zoe".split()
_LAST = "Abel Brown Costa Dumas Engel Fischer Grant Huber Ivanov Jones Keller Lopez Meyer Novak Olsen Perez Quist Rossi Silva Torres Unger Vogel Weber Young Zimmer".split()
_STREETS = "Oak Elm Mill Park Lake Hill High Church Station River Garden Bridge School North South West East King Queen Market".split()
_CITIES = "Lisbon Oslo Turin Lyon Ghent Graz Malmo Porto Bern Cork Leeds Gdansk Brno Riga Utrecht".split()
_COUNTRIES = "Portugal Norway Italy France Belgium Austria Sweden Switzerland Ireland Poland Latvia Netherlands".split()
_FORMS = "Ltd Inc LLC GmbH AG SA BV".split()
_JOBS = "baker teacher nurse pilot lawyer miner tailor farmer clerk editor welder chemist".split()


def fake_10(spark: SparkSession) -> DataFrame:
    """The ten people."""
    return spark.createDataFrame(PEOPLE, PEOPLE_SCHEMA).coalesce(1)


def fake(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n people with 14 columns, the last one a copy of the one before.

    Every value is a hash of (row, column, seed), so the table doesn't depend on how it is partitioned. Nulls are about 2 % of
    every column but id and is_active.
    """
    if n < 0:
        raise ValueError("n must be 0 at least")
    row = F.greatest(F.least(F.col("id"), F.lit(n - 2)), F.lit(0)).alias("row")

    def draw(column: str, size: int) -> Column:
        digits = F.substring(F.md5(F.concat_ws("|", "row", F.lit(column), F.lit(seed)).cast("binary")), 1, 15)
        return F.conv(digits, 16, 10).cast("long") % size

    def pick(column: str, words: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (draw(column, len(words)) + 1).cast("int"))

    def gap(column: str, value: Column) -> Column:
        return F.when(draw(f"{column} null", 100) >= 2, value).alias(column)

    first, last, city = pick("first_name", _FIRST), pick("last_name", _LAST), pick("city", _CITIES)
    day = lambda column, size, start: F.date_add(F.lit(start).cast("date"), draw(column, size).cast("int"))
    return spark.range(n).select(row).select(
        F.substring(F.sha2(F.concat_ws("-", "row", F.lit(seed)), 256), 1, 56).alias("id"),
        gap("first_name", first),
        gap("last_name", last),
        gap("email", F.lower(F.concat(first, F.lit("."), last, draw("email", 1000).cast("string"), F.lit("@example.com")))),
        gap("phone", F.concat(F.lit("+1-555-"), F.lpad(draw("phone", 10_000_000).cast("string"), 7, "0"))),
        gap("address", F.concat((draw("number", 300) + 1).cast("string"), F.lit(" "), pick("street", _STREETS), F.lit(" Street, "), city)),
        gap("city", city),
        gap("country", pick("country", _COUNTRIES)),
        gap("company", F.concat(pick("company", _LAST), F.lit(" "), pick("form", _FORMS))),
        gap("job", pick("job", _JOBS)),
        gap("date_of_birth", day("date_of_birth", 20_000, "1945-01-01")),
        gap("signup_date", day("signup_date", 3000, "2016-01-01").cast("timestamp")),
        gap("salary", draw("salary", 12_000_000) / 100 + 20_000),
        (draw("is_active", 2) == 1).alias("is_active"),
    )


def fake_1K(spark: SparkSession) -> DataFrame:
    return fake(spark, 1000)


def fake_100K(spark: SparkSession) -> DataFrame:
    return fake(spark, 100_000)


def fake_1M(spark: SparkSession) -> DataFrame:
    return fake(spark, 1_000_000)
