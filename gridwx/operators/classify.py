"""Weather summaries: classes per interval, dominant class, categories, insight and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwx.functions import values as V


def _insight() -> Column:
    """The first rule that holds."""
    n = F.col("n")
    dry, moderate, heavy = 100.0 * F.col("dry") / n, 100.0 * F.col("n_moderate") / n, 100.0 * (F.col("n_heavy") + F.col("n_violent")) / n
    return (
        F.when(moderate > 50, "Rainfall was predominantly moderate, with occasional heavy events.")
        .when(dry > 50, "The period was largely dry, with limited rainfall activity.")
        .when(100.0 - dry > 50, "Frequent wet conditions indicate a consistently rainy period.")
        .when(heavy > 50, "Rainfall intensity was frequently heavy, suggesting elevated runoff risk periods.")
        .otherwise("Rainfall distribution was mixed, with no single intensity class dominating the selected period.")
    )


def rain_summary(series: DataFrame, keys: list[str], value: str, aggregation: str = "daily", units: str = "mm") -> DataFrame:
    """Counts per class, wet coverage, dominant class (of equals the first declared), category, insight and the summary's text."""
    v = V.finite(F.col(value))
    rows = series.select(*keys, v.alias("v")).where("v IS NOT NULL").withColumn("class", V.rain_class(F.col("v"), aggregation))
    short = ["n_none", "n_light", "n_moderate", "n_heavy", "n_violent"]
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.count_if(F.col("v") > 0).alias("wet"),
        *[F.count_if(F.col("class") == c).alias(s) for c, s in zip(V.RAIN_CLASSES, short)],
    )
    found = found.withColumn("dry", F.col("n") - F.col("wet")).withColumn("wet_pct", 100.0 * F.col("wet") / F.col("n"))
    ranked = F.array(*[F.struct(F.col(s).alias("c"), F.lit(-i).alias("r"), F.lit(c).alias("name")) for i, (c, s) in enumerate(zip(V.RAIN_CLASSES, short))])
    found = found.withColumn("dominant", F.array_max(ranked)["name"])
    category = (
        F.when(F.col("wet_pct") < 20, "largely dry")
        .when(F.col("wet_pct") < 50, "intermittently wet")
        .when(F.col("dominant").isin("heavy rain", "violent rain"), "persistently heavy rainfall")
        .when(F.col("dominant") == "moderate rain", "moderate rainfall")
        .when(F.col("dominant") == "light rain", "light rainfall")
        .otherwise("mixed rainfall")
    )
    found = found.withColumn("category", category).withColumn("insight", _insight())
    return found.withColumn("summary", _rain_text(aggregation, units))


# Per aggregation the opening, the scope line and the header of the text.
RAIN_TEXT = {
    "daily": ("During the selected period, %s conditions were observed, with an average rainfall of %s %s.", "Out of %d days:", "Rainfall intensity distribution:"),
    "weekly": ("Over the selected period, rainfall patterns indicate %s conditions, with an average weekly rainfall of %s %s.", "Across %d weeks:", "Weekly intensity breakdown:"),
    "monthly": ("For the selected time range, the region experienced %s rainfall conditions, with an average of %s %s.", "Summary across %d months:", "Monthly distribution:"),
    "yearly": ("Over the analyzed years, rainfall trends show %s conditions, with an annual average of %s %s.", "Across %d years:", "Yearly breakdown:"),
    "other": ("Across the selected period, %s conditions were observed, with average rainfall of %s %s.", "Across %d periods:", "Intensity distribution:"),
}


def _rain_text(aggregation: str, units: str) -> Column:
    opening, scope, header = RAIN_TEXT.get(aggregation, RAIN_TEXT["other"])
    unit = V.UNIT_LABELS.get(aggregation, "period")
    title = (aggregation if aggregation in V.UNIT_LABELS else "selected").capitalize() + " Summary"
    heavy = F.col("n_heavy") + F.col("n_violent")

    def line(count: Column, word: str) -> Column:
        return F.when(count > 0, F.format_string(f"%d {word} rainfall {unit}s", count))

    classes = F.array_compact(F.array(line(heavy, "heavy"), line(F.col("n_moderate"), "moderate"), line(F.col("n_light"), "light")))
    none = F.array(F.lit(f"No light, moderate, or heavy rainfall {unit}s were recorded."))
    note = F.format_string(
        f"Technical note: dominant interval class = %s; min = %s {units}, max = %s {units}, total = %s {units}, wet coverage = %s%%.",
        "dominant", V.number_text(F.col("min")), V.number_text(F.col("max")), V.number_text(F.col("total")), V.number_text(F.col("wet_pct")),
    )
    top = F.array(
        F.lit(title), F.format_string(opening, "category", V.number_text(F.col("mean")), F.lit(units)), F.lit(""), F.format_string(scope, "n"),
        F.format_string(f"%d {unit}s recorded rainfall", "wet"), F.format_string(f"%d {unit}s remained dry", "dry"), F.lit(""), F.lit(header),
    )
    rest = F.array(F.lit(""), F.concat(F.lit("1-line insight: "), "insight"), F.lit(""), note)
    return F.array_join(F.concat(top, F.when(F.size(classes) > 0, classes).otherwise(none), rest), "\n")


def variable_summary(long: DataFrame, variables: DataFrame) -> DataFrame:
    """code, value -> mean, min, max, mean in the reference unit, and the band; wind is judged by its maximum.

    variables: code, units (the fixed table). Variables without thresholds have a null band.
    """
    v = V.finite(F.col("value"))
    found = long.select("code", v.alias("v")).where("v IS NOT NULL").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    found = found.join(F.broadcast(variables.select("code", "units")), "code", "left").withColumn("units", F.coalesce("units", F.lit("")))
    code, units, mean = F.col("code"), F.col("units"), F.col("mean")
    celsius, fahrenheit, kwh = V.to_celsius(mean, units), V.to_fahrenheit(mean, units), V.to_kwh(mean, units)
    converted = (
        F.when(code.isin("TMAX", "TMIN", "T2M"), celsius).when(code == "WIND", V.to_mph(F.col("max"), units)).when(code == "TDEW", fahrenheit).when(code == "SRAD", kwh).otherwise(mean)
    )
    band = (
        F.when(code.isin("TMAX", "TMIN", "T2M"), V.temperature_band(celsius))
        .when(code == "WIND", V.wind_hazard(V.to_mph(F.col("max"), units)))
        .when(code == "TDEW", V.dew_point_comfort(fahrenheit))
        .when(code == "SRAD", V.solar_band(kwh))
        .when(code == "RH2M", V.humidity_state(mean))
    )
    return found.withColumn("converted", converted).withColumn("band", band)


# What a variable's text is about, its second sentence, and the sources it names.
OPENING = "At %s aggregation for %s, the %s was %s %s (range %s to %s %s; %d intervals). "
SUBJECTS = {"wind": "mean wind", "dew": "mean dew point"}
CLOSINGS = {
    "temperature": "On a Celsius reference scale, this corresponds to mean %s C (range %s to %s C), classified as %s for this aggregation.",
    "wind": "Converted to mph, mean was %s mph and max was %s mph; %s based on NWS advisory/watch/warning thresholds.",
    "dew": "Converted to Fahrenheit, mean dew point was %s F, indicating %s conditions for this aggregation.",
    "humidity": "Relative humidity state for this aggregation is %s based on mean RH.",
    "solar": "Converted to kWh/m2/day-equivalent, mean was %s (range %s to %s), which is classified as %s solar irradiation for this aggregation.",
    "other": "No specialized meteorological threshold set is currently mapped for %s.",
}
NO_DATA = "No valid observations are available for this selection yet."
KINDS = {"T2M": "temperature", "TMAX": "temperature", "TMIN": "temperature", "WIND": "wind", "WS2M": "wind", "TDEW": "dew", "RH2M": "humidity", "SRAD": "solar", "RAIN": "rain", "RAIN1": "rain"}
PERIODS = ("daily", "weekly", "monthly", "yearly")
SOURCES = {
    "rain": [
        ("Rain Intensity Definitions", "https://wgntv.com/weather/weather-blog/do-meteorologists-have-specific-definitions-for-drizzle-light-rain-steady-rain-heavy-rain-downpour/"),
        ("NWS Heavy Glossary", "https://forecast.weather.gov/glossary.php?word=heavy"),
    ],
    "temperature": [("Temperature Category Bands", "https://thinkmetric.uk/basics/temperature/")],
    "wind": [
        (
            "NWS Wind Advisory/Warning Thresholds",
            "https://www.weather.gov/dmx/dsswind#:~:text=Wind%20Information%20Page&text=A%20Wind%20Advisory%20means%20that,power%20lines%20and%20small%20structures.&text=Click%20each%20image%20above%20to,from%206pm%20to%206am%20CST.",
        )
    ],
    "dew": [("NWS Dew Point Comfort Guidance", "https://www.weather.gov/arx/why_dewpoint_vs_humidity#:~:text=less%20than%20or%20equal%20to,in%20the%20air%2C%20becoming%20oppressive")],
    "humidity": [("NWS Humidity Definition", "https://forecast.weather.gov/glossary.php?word=humidity")],
    "solar": [("Solar Irradiation Classes", "https://energypedia.info/wiki/SPIS_Toolbox_-_Solar_Irradiation")],
}
SOURCE_LIST = "array<struct<label:string,url:string>>"


def unique_sources(sources: Column) -> Column:
    """The sources (label, url) with another url than those before them."""
    urls = F.transform(sources, lambda x: x["url"])
    return F.filter(sources, lambda x, i: F.array_position(urls, x["url"]) == i + 1)


def source_list(kind: Column) -> Column:
    lists = F.create_map(*[x for k, pairs in SOURCES.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("url")) for a, b in pairs]))])
    return F.coalesce(F.element_at(lists, kind), F.array().cast(SOURCE_LIST))


def variable_texts(long: DataFrame, variables: DataFrame, aggregation: str = "daily") -> DataFrame:
    """code, value -> code, summary, sources: the text for each variable, by its kind, and where its classes come from.

    A variable without finite values gets a text that says so, and no sources. variables: code, description, units.
    """
    known = F.broadcast(variables.select("code", "description", "units"))
    v = V.finite(F.col("value"))
    found = long.groupBy("code").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")).join(known, "code", "left")
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    found = found.withColumn("units", F.coalesce("units", F.lit(""))).withColumn("kind", F.coalesce(F.element_at(kinds, F.col("code")), F.lit("other")))
    units, text = F.col("units"), V.number_text
    period = F.lit(aggregation if aggregation in PERIODS else "selected")
    subject = F.when(F.col("kind") == "wind", SUBJECTS["wind"]).when(F.col("kind") == "dew", SUBJECTS["dew"]).otherwise("mean")
    opening = F.format_string(OPENING, period, F.coalesce("description", "code"), subject, text(F.col("mean")), units, text(F.col("min")), text(F.col("max")), units, F.col("n"))
    celsius, mph, kwh = ([f(F.col(c), units) for c in ("mean", "min", "max")] for f in (V.to_celsius, V.to_mph, V.to_kwh))
    fahrenheit = V.to_fahrenheit(F.col("mean"), units)
    closings = {
        "temperature": [*map(text, celsius), V.temperature_band(celsius[0])],
        "wind": [text(mph[0]), text(mph[2]), V.wind_hazard(mph[2])],
        "dew": [text(fahrenheit), V.dew_point_comfort(fahrenheit)],
        "humidity": [V.humidity_state(F.col("mean"))],
        "solar": [*map(text, kwh), V.solar_band(kwh[0])],
        "other": [F.col("code")],
    }
    closing = F.coalesce(*[F.when(F.col("kind") == k, F.format_string(CLOSINGS[k], *parts)) for k, parts in closings.items()])
    rain = long.join(known, "code", "left").where(F.element_at(kinds, F.col("code")) == "rain")
    rain_units = {r["code"]: r["units"] for r in variables.where(F.col("code").isin("RAIN", "RAIN1")).select("code", "units").collect()}
    rain = rain_summary(rain, ["code"], "value", aggregation, rain_units.get("RAIN", "mm")).select("code", F.col("summary").alias("rain_text"))
    summary = F.when(F.col("n") == 0, NO_DATA).when(F.col("kind") == "rain", F.col("rain_text")).otherwise(F.concat(opening, closing))
    sources = F.when(F.col("n") == 0, F.array().cast(SOURCE_LIST)).otherwise(unique_sources(source_list(F.col("kind"))))
    return found.join(rain, "code", "left").select("code", summary.alias("summary"), sources.alias("sources"))


def source_matrix(rows: DataFrame, choices: list[tuple[str, str]], by_variable: dict[str, list[str]], external: dict[str, str]) -> DataFrame:
    """rows (column code, and others) by source: label, available, external name, and what stands in for an equal choice."""
    spark = rows.sparkSession
    pairs = [(v, s, label, s in have, external.get(v), next((x for x in have if x != s), have[0])) for v, have in by_variable.items() for s, label in choices]
    table = spark.createDataFrame(pairs, "code string, source string, label string, available boolean, external_name string, fallback string")
    return rows.join(F.broadcast(table), "code")
