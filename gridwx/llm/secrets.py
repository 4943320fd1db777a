"""Secret scan with multipart credential linking, in DataFrame functions only.

Parts of credentials are access identifiers, secrets and endpoints. Three kinds are reported wherever they match (assign,
access, hex). Weaker parts (a login name, a short or bare secret, an endpoint) are reported only when complementary parts
lie within the same scope, a stretch of SCOPE code points around them: an identifier needs a secret, a secret an
identifier, an endpoint both. The interval join of the parts is one ordered pass in each direction: a part needs the
largest end before it and the smallest start after it of each class, so many parts in one scope make no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwx.llm.common import stage

#: Code points between parts of one credential.
SCOPE = 200

# The kinds in the order in which spans at one place are listed. Per kind: pattern, class of the part,
# whether it stands alone.
ASSIGN = r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
KINDS = [
    ("assign", ASSIGN, "secret", True),
    ("access", "AKIA[A-Z0-9]{12,}", "identifier", True),
    ("hex", "[0-9a-f]{32,}", "secret", True),
    ("weak_login", r"(?:[uU][sS][eE][rR](?:[nN][aA][mM][eE])?|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[aA][cC][cC][eE][sS][sS]_?[kK][eE][yY](?:_?[iI][dD])?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}", "identifier", False),
    ("weak_secret", r"(?<![A-Za-z0-9])[A-Za-z0-9]++[+/=][A-Za-z0-9+/=]{23,}", "secret", False),
    ("weak_assign", ASSIGN, "secret", False),
    ("weak_endpoint", r"(?:https?|jdbc:[a-z]+|postgres|mysql|redis|mongodb|amqp)://[A-Za-z0-9._~:@/-]+", "endpoint", False),
]
#: A value of an assignment stands alone from this length on; a shorter one of WEAK_VALUE or more is a weak part.
FULL_VALUE, WEAK_VALUE = 8, 4


def _parts(text: Column, rank: int, pattern: str, value: bool) -> Column:
    """One entry per match: the lengths of the gap before it, of its text, and of group 2 where value asks for it.

    Splitting and extracting see the same matches.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), lambda g: F.length(g))
    sizes = F.transform(matches, lambda m: F.length(m))
    if value:
        values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda v: F.length(v))
        zipped = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), values.alias("value"))
    else:
        zipped = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), sizes.alias("value"))
    entry = F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(rank).alias("rank"), i.alias("nth"), z["gap"].alias("gap"), z["size"].alias("size"), z["value"].alias("value")
        ),
    )
    none = F.array().cast("array<struct<rank:int,nth:int,gap:int,size:int,value:int>>")
    return F.when(text.rlike(pattern), entry).otherwise(none)


def all_parts(text: Column) -> Column:
    """The parts of every kind of a text (null: empty), each pattern matched once."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_parts(text, r, pattern, kind == "assign") for r, (kind, pattern, _, _) in enumerate(KINDS) if kind != "weak_assign"])


def link_parts(rows: DataFrame, keys: list[str], scope: int = SCOPE) -> DataFrame:
    """keys, spans: array of (start, rank, kind, end) in order, one row per row of keys, parts (keys must tell rows apart).

    Starts and ends count code points of the whole text, end exclusive.
    """
    rows = rows.select(*keys, "parts").repartition(*keys)
    rows = rows.select(*keys, F.explode_outer("parts").alias("p")).select(*keys, "p.*")

    # place: everything before the match is gaps and matches of its own pattern
    so_far = Window.partitionBy(*keys, "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far).cast("long")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    weak_rank = [k for k, *_ in KINDS].index("weak_assign")
    rows = rows.withColumn("rank", F.when((F.col("rank") == 0) & (F.col("value") < FULL_VALUE), F.lit(weak_rank)).otherwise(F.col("rank")))
    rows = rows.withColumn("start", F.when((F.col("rank") != weak_rank) | (F.col("value") >= WEAK_VALUE), F.col("start")))

    info = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("class"), F.lit(s).alias("alone")) for k, _, c, s in KINDS])
    rows = rows.withColumn("k", F.get(info, F.col("rank"))).select(*keys, "start", "end", "rank", "k.kind", "k.class", "k.alone")

    before = Window.partitionBy(*keys).orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("start"), F.desc("rank")).rowsBetween(Window.unboundedPreceding, -1)
    here = F.col("start").isNotNull()
    for c in ("identifier", "secret"):
        own = here & (F.col("class") == c)
        left = F.col("start") - F.max(F.when(own, F.col("end"))).over(before) <= scope
        right = F.min(F.when(own, F.col("start"))).over(after) - F.col("end") <= scope
        rows = rows.withColumn(f"near_{c}", F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False)))
    linked = (
        F.when(F.col("class") == "identifier", F.col("near_secret"))
        .when(F.col("class") == "secret", F.col("near_identifier"))
        .otherwise(F.col("near_secret") & F.col("near_identifier"))
    )
    span = F.when(here & (F.col("alone") | linked), F.struct("start", "rank", "kind", "end"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and spans of every row of docs, repeated and null ids included; an empty table gives no rows.

    Other columns are not read. Rows are told apart by their place in the scan.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), all_parts(F.col("text")).alias("parts"))
    return link_parts(rows, ["row", "doc_id"], scope).drop("row")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """docs with every span of its texts replaced by mask (overlapping spans by one), n_chars counted again where present.

    The parts are located once and written with the rows. Texts without any pass unchanged and are not shuffled; null
    texts stay null; repeated rows are masked alike; an empty table gives no rows. Other columns keep their names and values.
    """
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row"), all_parts(F.col("text")).alias("parts"))
    rows = stage(rows, "secret-rows")
    clean = rows.where(F.size("parts") == 0).select("doc.*")
    held = rows.where(F.size("parts") > 0)
    spans = link_parts(held, ["row"], scope)
    # merged, non-overlapping spans by a running end
    cut = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("to"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("keep")),
        lambda acc, s: F.struct(
            F.greatest(acc["to"], s["end"]).alias("to"),
            F.when(s["start"] >= acc["to"], F.concat(acc["keep"], F.array(F.struct(acc["to"].alias("a"), s["start"].alias("b"))))).otherwise(acc["keep"]).alias("keep"),
        ),
    )
    text = F.col("doc.text")
    keep = F.concat(F.col("cut.keep"), F.array(F.struct(F.col("cut.to").alias("a"), F.length(text).cast("long").alias("b"))))
    masked = F.array_join(F.transform(keep, lambda k: F.substring(text, (k["a"] + 1).cast("int"), (k["b"] - k["a"]).cast("int"))), mask)
    found = held.select("row", "doc").join(spans, "row").withColumn("cut", cut).select("doc", F.when(F.size("spans") > 0, masked).otherwise(text).alias("masked"))
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("masked").cast(docs.schema["n_chars"].dataType)
    return clean.unionByName(found.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns]))
