"""Fixed-width weather files for crop models, one per point, assembled by Spark; names, manifest and readme of a package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwx import catalog
from gridwx.functions.values import day_of_year, one_decimal_text
from gridwx.operators.points import join_places
from gridwx.workspace import staged

# Widths of the site table, reference heights, and what each rain source is described as.
SITE_WIDTHS = [("INSI", 6), ("WTHLAT", 9), ("WTHLONG", 10), ("WELEV", 10), ("TAV", 7), ("AMP", 6), ("REFHT", 7), ("WNDHT", 7)]
REFERENCE_HEIGHT = WIND_HEIGHT = 2
DESCRIPTIONS = {"chirps": "CHIRPS + NASA POWER (Rain: CHIRPS)", "nasa_power": "NASA POWER", "both": "CHIRPS + NASA POWER (Dual Rain)"}
OTHER_DESCRIPTION = "CHIRPS + NASA POWER"


def source_text(rain_source: str, in_package: bool = True) -> str:
    """What a file says about its source; only the files of a package name the two rain columns."""
    if rain_source == "both" and not in_package:
        return OTHER_DESCRIPTION
    return DESCRIPTIONS.get(rain_source, OTHER_DESCRIPTION)


def usable_variables(columns: list[str], selected: list[str] | None = None) -> list[str]:
    """The variables of the data, in its order, that are selected; none is an error."""
    skip = {"point_seq", "point_id", "lat", "lon", "obs_date", "elev", "tav", "amp"}
    found = [c for c in columns if c not in skip and (not selected or c in selected)]
    if not found:
        raise ValueError("no variable is left for the file")
    return found


def one_decimal(value: Column, width: int) -> Column:
    return F.lpad(one_decimal_text(value), width, " ")


def data_lines(series: DataFrame, variables: list[str], keys: list[str] = ["point_seq"]) -> DataFrame:
    """keys, obs_date, line: day of year and right-aligned values; missing ones get the variable's default."""
    defaults = {code: default for code, _, _, _, default, _ in catalog.VARIABLES}
    cells = [one_decimal(F.coalesce(F.col(v).cast("double"), F.lit(defaults.get(v, -99.0))), 8) for v in variables]
    return series.select(*keys, "obs_date", F.concat(F.lpad(day_of_year(F.col("obs_date")), 7, " "), *cells).alias("line"))


def site_header() -> str:
    (first, width), *rest = SITE_WIDTHS
    return f"@ {first:<{width}}" + "".join(f"{name:>{w}}" for name, w in rest)


def site_rows(points: DataFrame, site_code: str = "UFLC", keys: list[str] = ["point_seq"]) -> DataFrame:
    """points: point_seq, lat, lon, elev, tav, amp -> point_seq, other keys, site_row."""
    widths = dict(SITE_WIDTHS)
    cells = [one_decimal(F.col(c), widths[n]) for c, n in (("lat", "WTHLAT"), ("lon", "WTHLONG"), ("elev", "WELEV"), ("tav", "TAV"), ("amp", "AMP"))]
    heights = F.lit(f"{REFERENCE_HEIGHT:>{widths['REFHT']}.0f}{WIND_HEIGHT:>{widths['WNDHT']}.0f}")
    others = [k for k in keys if k != "point_seq"]
    return points.select("point_seq", *others, F.concat(F.lit("  " + site_code.ljust(widths["INSI"])), *cells, heights).alias("site_row"))


def file_content(series: DataFrame, points: DataFrame, rain_source: str = "both", selected: list[str] | None = None, site_code: str = "UFLC", in_package: bool = True, keys: list[str] = ["point_seq"]) -> DataFrame:
    """point_seq, content: header, variable list, site row, one line per day. The series belong to the points' keys: to the
    points themselves, or to the places of `merge.places`, whose lines are put together once for all points there."""
    variables = usable_variables([c for c in series.columns if c not in keys], selected)
    described = {code: text for code, text, *_ in catalog.VARIABLES}
    head = f"$WEATHER DATA : {source_text(rain_source, in_package)}\n\n"
    head += "".join(f"! {v:<6} {described[v]}\n" for v in variables if v in described) + "\n" + site_header() + "\n"
    columns = "\n\n@  DATE" + "".join(f"{v:>8}" for v in variables) + "\n"
    body = data_lines(series, variables, keys).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("obs_date", "line"))), lambda x: x["line"]), "\n").alias("body")
    )
    content = F.concat(F.lit(head), "site_row", F.lit(columns), "body", F.lit("\n"))
    sites = site_rows(points, site_code, keys)
    found = sites.join(body, keys) if keys == ["point_seq"] else join_places(sites, body, keys)
    return found.select("point_seq", content.alias("content"))


def rain_only_content(series: DataFrame, points: DataFrame, site_code: str = "UFLC") -> DataFrame:
    """The older format with precipitation alone."""
    value = one_decimal(F.coalesce(F.col("RAIN").cast("double"), F.lit(0.0)), 6)
    lines = series.select("point_seq", "obs_date", F.concat(day_of_year(F.col("obs_date")), F.lit("   "), value).alias("line"))
    body = lines.groupBy("point_seq").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("obs_date", "line"))), lambda x: x["line"]), "\n").alias("body"))
    head = F.concat(
        F.lit(f"$WEATHER DATA: {site_code}\n\n! RAIN     Precipitation (mm/day)\n\n@ INSI   WTHLAT  WTHLONG\n  {site_code}     "),
        one_decimal_text(F.col("lat")), F.lit("    "), one_decimal_text(F.col("lon")), F.lit("\n\n@  DATE   RAIN\n"),
    )
    return points.join(body, "point_seq").select("point_seq", F.concat(head, "body", F.lit("\n")).alias("content"))


def file_names(points: DataFrame, first: str, last: str) -> DataFrame:
    """point_seq, file_name: the id, or the coordinates where there is none."""
    lat = F.format_string("%.4f%s", F.abs("lat"), F.when(F.col("lat") >= 0, "N").otherwise("S"))
    lon = F.format_string("%.4f%s", F.abs("lon"), F.when(F.col("lon") >= 0, "E").otherwise("W"))
    plain = F.concat(F.lit("weather_"), lat, F.lit("_"), lon, F.lit(f"_{first.replace('-', '')}_{last.replace('-', '')}.WTH"))
    return points.select("point_seq", F.coalesce(F.concat("point_id", F.lit(".WTH")), plain).alias("file_name"))


def unique_names(names: DataFrame, most_rounds: int = 20) -> DataFrame:
    """A suffix _2, _3 ... for all but the first of equal names, again where a suffixed name meets another."""
    rows = names.withColumn("_stem", F.regexp_replace("file_name", r"\.[^.]*$", "")).withColumn("_ext", F.regexp_extract("file_name", r"(\.[^.]*)$", 1))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("file_name").orderBy("point_seq"))).withColumn("_first", F.col("_k"))
    name = F.when(F.col("_k") > 1, F.concat("_stem", F.lit("_"), F.col("_k").cast("string"), "_ext")).otherwise(F.col("file_name"))
    rows = rows.withColumn("_name", name)
    for _ in range(most_rounds):
        w = Window.partitionBy("_name").orderBy(F.col("_first") > 1, "point_seq")
        marked = staged(rows.withColumn("_bump", F.row_number().over(w) > 1), "names")
        if marked.where("_bump").isEmpty():
            return marked.select("point_seq", F.col("_name").alias("file_name"))
        rows = marked.withColumn("_k", F.when(F.col("_bump"), F.greatest(F.col("_k"), F.lit(1)) + 1).otherwise(F.col("_k"))).withColumn("_name", name).drop("_bump")
    raise RuntimeError(f"file names still meet after {most_rounds} rounds")


def _number(value: Column, digits: int) -> Column:
    """Plain digits without trailing zeros, as JSON numbers are read everywhere."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", value), r"\.?0+$", "")


def features(points: DataFrame) -> DataFrame:
    """point_seq, feature: a GeoJSON feature per point, coordinates with seven decimals, properties with eight."""
    name = F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col("point_id").cast("string").alias("x"))), r"^\{\"x\":(.*)\}$", 1), F.lit(""))
    name = F.when(name == "", F.lit("null")).otherwise(name)
    parts = [
        F.lit('{"type":"Feature","properties":{"ID":'), name, F.lit(',"Latitude":'), _number(F.col("lat"), 8), F.lit(',"Longitude":'), _number(F.col("lon"), 8),
        F.lit('},"geometry":{"type":"Point","coordinates":['), _number(F.col("lon"), 7), F.lit(","), _number(F.col("lat"), 7), F.lit("]}}"),
    ]
    return points.select("point_seq", F.concat(*parts).alias("feature"))


def feature_collections(points: DataFrame, most: int = 1000) -> DataFrame:
    """file_no, collection: GeoJSON texts of the points, each of those whose point_seq falls into one stretch of `most` numbers."""
    rows = features(points).withColumn("file_no", F.floor(F.col("point_seq") / most).cast("long"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("point_seq", "feature"))), lambda x: x["feature"])
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(each, ","), F.lit("]}"))
    return rows.groupBy("file_no").agg(text.alias("collection"))


def package_summary(names: DataFrame, series: DataFrame, variables: list[str], rain_source: str) -> DataFrame:
    """One readme text: number of files, days, points, variables, source."""
    counts = names.agg(F.count(F.lit(1)).alias("files"))
    days = series.agg(F.min("obs_date").alias("a"), F.max("obs_date").alias("b"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Total ICASA Files: "), F.col("files").cast("string")), F.concat(F.lit("Date Range: "), F.coalesce(F.col("a").cast("string"), F.lit("-")), F.lit(" to "), F.coalesce(F.col("b").cast("string"), F.lit("-"))),
        F.concat(F.lit("Total Coordinates: "), F.col("files").cast("string")), F.lit("Variables: " + ", ".join(variables)), F.lit(f"Data Source: {source_text(rain_source, in_package=False)}"),
    )
    return counts.join(F.broadcast(days)).select(text.alias("readme"))


def write_package(files: DataFrame, path: str) -> None:
    """file_name, content: one folder of text per file, written by the executors through Spark's own committer.

    Time goes with the number of files, not with their bytes, so files are dealt to as many tasks as a shuffle has partitions,
    and each task moves its own to their place (second algorithm): the driver would move them one by one.
    """
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = files.select("file_name", "content").repartition(n, "file_name").write.partitionBy("file_name").mode("overwrite")
    out.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


def read_package(spark: SparkSession, path: str) -> DataFrame:
    """file_name, content of a written package; names are texts, whatever they look like."""
    files = spark.read.schema("value string, file_name string").text(path, wholetext=True)
    return files.select("file_name", F.regexp_replace("value", "\n\\z", "").alias("content"))
