"""What is learned about ingredients: aliases from mappings and fuzzy matches, seeds, and repairs of wrong ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.fmt import alias_key
from larder.functions.lines import parse_lines, plausible_match
from larder.operators.matcher import match
from larder.operators.state import insert_ignore
from larder.plans.shared import numbered, written


@dataclass
class Mapped:
    ingredients: DataFrame
    aliases: DataFrame
    lines: DataFrame
    outcomes: DataFrame


def clean_decisions(decisions: DataFrame) -> DataFrame:
    """alias, canonical, aisle: one decision per normalised name, the first by position.

    decisions has position, input_name, canonical_name and aisle. A canonical name takes the aisle of its first
    decision. Rows with an empty name are left out.
    """
    rows = decisions.select("position", alias_key(F.col("input_name")).alias("alias"), alias_key(F.col("canonical_name")).alias("canonical"), "aisle").where("alias != '' AND canonical != ''")
    first = rows.groupBy("alias").agg(F.min_by("canonical", "position").alias("canonical"))
    return first.join(rows.groupBy("canonical").agg(F.min_by("aisle", "position").alias("aisle")), "canonical").select("alias", "canonical", "aisle")


def contradictions(decisions: DataFrame) -> DataFrame:
    """alias and n of names with several decisions, which must not be applied unseen."""
    rows = decisions.select(alias_key(F.col("input_name")).alias("alias"), F.struct(alias_key(F.col("canonical_name")), "aisle").alias("d"))
    return rows.groupBy("alias").agg(F.count_distinct("d").alias("n")).where("n > 1")


def guarded(decisions: DataFrame) -> DataFrame:
    """decisions with action: a claim of an existing ingredient that shares no telling word with the name becomes a new one of the name itself."""
    bad = (F.col("action") == "existing") & ~plausible_match(F.col("input_name"), F.col("canonical_name"))
    return decisions.withColumns({"canonical_name": F.when(bad, alias_key(F.col("input_name"))).otherwise(F.col("canonical_name")), "action": F.when(bad, "new").otherwise(F.col("action"))})


def apply_mappings(ingredients: DataFrame, aliases: DataFrame, lines: DataFrame, refs: DataFrame, decisions: DataFrame) -> Mapped:
    """Ingredients, aliases and lines after decisions on parsed lines (refs: dish_id, position, raw_text, parsed_name), and each ref's outcome.

    Outcomes: mapped, conflict (mapped to the alias' owner, which is another than was meant), stale (the line is gone,
    changed or mapped) or undecided. An alias that is stored keeps its owner. A canonical name that is an ingredient or
    an alias means that ingredient, and is a new one otherwise, with the next free id. Stale refs teach nothing.
    """
    wanted = refs.withColumn("alias", alias_key(F.col("parsed_name"))).join(clean_decisions(decisions), "alias", "left")
    open_ = lines.where("ingredient_id IS NULL").select("dish_id", "position", F.col("raw_text").alias("now")).withColumn("there", F.lit(True))
    wanted = wanted.join(open_, ["dish_id", "position"], "left")
    stale = F.col("there").isNull() | ~F.col("now").eqNullSafe(F.col("raw_text"))
    wanted = wanted.withColumn("state", F.when(F.col("canonical").isNull(), "undecided").when(stale, "stale").otherwise("live")).drop("now", "there")
    wanted = written(wanted, "wanted")
    owners = aliases.select(F.col("alias").alias("known"), F.col("ingredient_id").alias("owner"))
    names = ingredients.select(F.col("name").alias("known"), F.col("ingredient_id").alias("owner")).unionByName(owners.join(ingredients.select(F.col("name").alias("known")), "known", "left_anti"))
    live = wanted.where("state = 'live'").select("alias", "canonical", "aisle").distinct()
    live = live.join(owners.withColumnRenamed("known", "alias").withColumnRenamed("owner", "kept"), "alias", "left").join(names.withColumnRenamed("known", "canonical").withColumnRenamed("owner", "meant"), "canonical", "left")
    live = written(live, "live")
    fresh = live.where("kept IS NULL AND meant IS NULL").groupBy("canonical").agg(F.first("aisle").alias("aisle"))
    top = ingredients.agg(F.coalesce(F.max("ingredient_id"), F.lit(0)).alias("top"))
    fresh = numbered(fresh, "canonical").join(top)  # with one row
    fresh = fresh.select((F.col("top") + F.col("k")).cast("long").alias("ingredient_id"), F.col("canonical").alias("name"), "aisle")
    live = live.join(fresh.select(F.col("name").alias("canonical"), F.col("ingredient_id").alias("made")), "canonical", "left")
    live = live.withColumn("intended", F.coalesce("meant", "made")).withColumn("target", F.coalesce("kept", "intended"))
    learned = live.where("kept IS NULL").select(F.explode(F.array("canonical", "alias")).alias("alias"), F.col("target").alias("ingredient_id"))
    learned = learned.groupBy("alias").agg(F.min("ingredient_id").alias("ingredient_id")).join(aliases.select("alias"), "alias", "left_anti")
    told = wanted.join(live.select("alias", "target", (~F.col("target").eqNullSafe(F.col("intended"))).alias("other")), "alias", "left")
    outcome = F.when(F.col("state") != "live", F.col("state")).when(F.col("other"), "conflict").otherwise("mapped")
    outcomes = told.select("dish_id", "position", outcome.alias("outcome"), F.when(F.col("state") == "live", F.col("target")).alias("ingredient_id"))
    new = outcomes.where("ingredient_id IS NOT NULL").select("dish_id", "position", F.col("ingredient_id").alias("to")).dropDuplicates(["dish_id", "position"])
    rows = lines.join(new, ["dish_id", "position"], "left").withColumn("ingredient_id", F.coalesce("ingredient_id", "to")).select(lines.columns)
    keep = [c for c in ingredients.columns if c in ("ingredient_id", "name", "aisle")]
    return Mapped(ingredients.select(keep).unionByName(fresh.select(keep)), aliases.select("alias", "ingredient_id").unionByName(learned), rows, outcomes)


def match_and_learn(names: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What match finds, and the aliases with each accepted fuzzy match as an exact one for the next time."""
    found = match(names, aliases)
    learned = found.where("how = 'fuzzy'").select(alias_key(F.col("name")).alias("alias"), "ingredient_id")
    return found, insert_ignore(aliases.select("alias", "ingredient_id"), learned, ["alias"])


def seed(ingredients: DataFrame, aliases: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ingredients and aliases after seeds (position, name, aisle, default_unit): names are normalised, the last of equal ones counts.

    A known name takes the seed's aisle and unit and keeps its id; aliases that exist keep their owner.
    """
    rows = seeds.withColumn("name", alias_key(F.col("name"))).groupBy("name").agg(F.max_by(F.struct("aisle", "default_unit"), "position").alias("s")).select("name", "s.*")
    both = ingredients.alias("i").join(rows.withColumn("seeded", F.lit(True)).alias("s"), "name", "full_outer")
    top = ingredients.agg(F.coalesce(F.max("ingredient_id"), F.lit(0)).alias("top"))
    number = numbered(rows.select("name").join(ingredients.select("name"), "name", "left_anti"), "name").join(top)  # with one row
    both = both.join(number, "name", "left")
    pick = lambda c: F.when(F.col("seeded"), F.col(f"s.{c}")).otherwise(F.col(f"i.{c}")).alias(c)
    out = both.select(F.coalesce("i.ingredient_id", F.col("top") + F.col("k")).cast("long").alias("ingredient_id"), "name", pick("aisle"), pick("default_unit"))
    own = out.join(rows.select("name"), "name", "left_semi").select(F.col("name").alias("alias"), "ingredient_id")
    return out, insert_ignore(aliases.select("alias", "ingredient_id"), own, ["alias"])


def seed_sources(sources: DataFrame, seeds: DataFrame) -> DataFrame:
    """sources after seeds of the same columns, by base_url: all columns are the seed's, but a reddit source's `enabled`, once stored, is its keeper's."""
    rows = sources.alias("o").join(seeds.withColumn("seeded", F.lit(True)).alias("s"), "base_url", "full_outer")

    def pick(c: str):
        new = F.when(F.col("seeded"), F.col(f"s.{c}")).otherwise(F.col(f"o.{c}"))
        keeps = F.col("o.enabled").isNotNull() & F.coalesce(F.col("s.kind") == "reddit", F.lit(False))
        return F.col("base_url") if c == "base_url" else F.when(keeps, F.col("o.enabled")).otherwise(new).alias(c) if c == "enabled" else new.alias(c)

    return rows.select(*map(pick, sources.columns))


def repair(aliases: DataFrame, lines: DataFrame, wrong: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Aliases without the wrong ones (alias), lines whose name, parsed again, is one of them without an ingredient, and those lines.

    To look first, use the third and leave the others.
    """
    bad = wrong.select(alias_key(F.col("alias")).alias("alias")).distinct()
    parsed = parse_lines(lines.where("ingredient_id IS NOT NULL").select("dish_id", "position", "raw_text"))
    hits = parsed.withColumn("alias", alias_key(F.col("parsed.name"))).join(bad, "alias", "left_semi").select("dish_id", "position", "raw_text")
    marked = lines.join(hits.select("dish_id", "position").withColumn("hit", F.lit(True)), ["dish_id", "position"], "left")
    mended = marked.withColumn("ingredient_id", F.when(F.col("hit").isNull(), F.col("ingredient_id"))).select(lines.columns)
    return aliases.join(bad, "alias", "left_anti"), mended, hits
