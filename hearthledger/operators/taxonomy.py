"""Document labels against a taxonomy, a table: label, aliases (array), category, family, routes (array), hud_only, confirms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORE = "ignore"
#: Suffixes that make a label one of the past. Fixed values.
SUFFIXES = (" (Previous)", " (Superseded)")
#: Programmes of the housing authority, as whole words. Fixed values.
HUD_PROGRAMMES = r"(?i)\b(hud|usda|rural\s+development|rd|rad|prac|pbra|pbv|public\s+housing|section\s*(8|202|811|236|221|515))\b"
#: A dimension is broadcast up to so many rows.
DIMENSION_ROWS = 100_000


def dimension(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= DIMENSION_ROWS else df


def base_of(label: Column) -> Column:
    """A label without its suffix."""
    out = F.trim(label)
    for s in SUFFIXES:
        out = F.when(F.endswith(out, F.lit(s)), F.left(out, F.length(out) - len(s))).otherwise(out)
    return out


def suffix_of(label: Column) -> Column:
    out = F.lit("")
    for s in SUFFIXES:
        out = F.when(F.endswith(F.trim(label), F.lit(s)), s).otherwise(out)
    return out


def names_of(taxonomy: DataFrame) -> DataFrame:
    """name (lower case), canonical, fit: a label's own name before an alias, the first label of a shared alias."""
    own = taxonomy.select(F.lower("label").alias("name"), F.lit(0).alias("place"), "label")
    more = taxonomy.select(F.explode("aliases").alias("alias"), "label").select(F.lower("alias").alias("name"), F.lit(1).alias("place"), "label")
    best = own.union(more).groupBy("name").agg(F.min(F.struct("place", "label")).alias("b"))
    return best.select("name", F.col("b.label").alias("canonical"), F.when(F.col("b.place") == 0, "exact").otherwise("alias").alias("fit"))


def labelled(rows: DataFrame, column: str, taxonomy: DataFrame) -> DataFrame:
    """``rows`` with canonical (suffix kept), fit, category, family, hud_only, confirms; unknown labels are ``Unknown``, labels of the past ignored."""
    found = rows.withColumn("_base", F.lower(base_of(F.col(column)))).join(dimension(names_of(taxonomy)).withColumnsRenamed({"name": "_base", "canonical": "_label"}), "_base", "left")
    known = found.join(dimension(taxonomy.select(F.col("label").alias("_label"), "category", "family", "hud_only", "confirms")), "_label", "left")
    past = suffix_of(F.col(column)) != ""
    return known.select(
        *rows.columns, F.coalesce(F.concat("_label", suffix_of(F.col(column))), F.lit("Unknown")).alias("canonical"), F.coalesce("fit", F.lit("none")).alias("fit"),
        F.when(past | F.col("category").isNull(), IGNORE).otherwise(F.col("category")).alias("category"), F.coalesce("family", F.lit(IGNORE)).alias("family"),
        F.coalesce("hud_only", F.lit(False)).alias("hud_only"), "confirms",
    )


def on_route(taxonomy: DataFrame, route: str) -> DataFrame:
    return taxonomy.filter(F.array_contains("routes", route)).select("label")


def hud_programme(programme: Column) -> Column:
    return F.coalesce(programme.rlike(HUD_PROGRAMMES), F.lit(False))


def hud_cases(cases: DataFrame, groups: DataFrame, form: str) -> DataFrame:
    """case, hud: the programme is one, or the case holds a current ``form``. cases: case, programme; groups: case, label."""
    current = groups.groupBy("case").agg(F.bool_or(F.contains("label", F.lit(form)) & ~F.contains("label", F.lit(SUFFIXES[0].strip()))).alias("form"))
    return cases.join(current, "case", "left").select("case", (hud_programme(F.col("programme")) | F.coalesce("form", F.lit(False))).alias("hud"))


def demoted(groups: DataFrame, hud: DataFrame) -> DataFrame:
    """``groups`` (case, fit, hud_only, canonical) of other programmes lose a label of the housing authority that was not exact."""
    lost = F.col("hud_only") & (F.col("fit") != "exact") & ~F.coalesce("hud", F.lit(False))
    return groups.join(hud, "case", "left").select(*groups.columns, F.when(lost, "Unknown").otherwise(F.col("canonical")).alias("label"))


def page_rows(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """case, page, label, confidence: pages of groups (case, label, fit, pages), and those that no group holds as Unknown."""
    held = groups.select("case", F.explode("pages").alias("page"), "label", F.when(F.col("fit") == "exact", 0.90).otherwise(0.60).alias("confidence"))
    first = held.groupBy("case", "page").agg(F.max_by(F.struct("label", "confidence"), F.struct("confidence", "label")).alias("b")).select("case", "page", "b.*")
    gaps = pages.join(first, ["case", "page"], "left_anti").select("case", "page", F.lit("Unknown").alias("label"), F.lit(0.0).alias("confidence"))
    return first.unionByName(gaps)


def superseded(groups: DataFrame) -> DataFrame:
    """``groups`` (case, label, file, day, g_id) with ``current``: of a label in several files only the newest file's counts."""
    newest = groups.groupBy("case", "label").agg(F.max(F.struct("day", "file")).alias("_m")).select("case", "label", F.col("_m.file").alias("_file"))
    return groups.join(newest, ["case", "label"]).select(*groups.columns, (F.col("file") == F.col("_file")).alias("current"))
