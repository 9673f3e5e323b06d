"""Reported figures matched to facilities by the words of their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.labels import METHANE_GWP, reported_kg_hr

#: Words of names that say nothing of which one it is.
NOISE = (
    "facility", "operations", "operation", "colliery", "mine", "mines", "mining", "coal", "project", "the", "pty", "ltd",
    "limited", "no", "joint", "venture", "complex", "site", "plant", "station", "power", "and", "of",
)

ACCEPT, REVIEW = 0.95, 0.6


def tokens(name: Column) -> Column:
    """Distinct words of a name, without a leading site code, parentheses, noise words and words of up to two letters."""
    out = F.regexp_replace(F.trim(name), r"^[A-Z]{2,4}\d{2,3}\b[\s-]*", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\([^)]*\)", " "), "[^A-Za-z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(out)), " +"), lambda t: (F.length(t) > 2) & ~t.isin(*NOISE)))


#: What a pair's states and industry add to its overlap, and how it is told from both sides: by equal states, by one that is blank.
SAME, DIFFERENT, INDUSTRY, SHORT = 0.25, -0.6, 0.2, 0.3
STATES = {"same": SAME, "left blank": 0.0, "right blank": 0.0, "different": DIFFERENT}


def _by_rarity(rows: DataFrame, key: str, tokens: str, counts: DataFrame) -> DataFrame:
    """rows that have words, with rare, their words from the least frequent on."""
    each = rows.select(key, F.explode(tokens).alias("word")).distinct().join(counts, "word")
    lists = each.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]).alias("every"))
    return rows.join(lists, key).withColumn("rare", F.filter("every", lambda w: F.array_contains(tokens, w))).drop("every")


def _prefix(least: float) -> Column:
    """So many of the rarest words that a pair which scores least, of this side's name as the smaller one, shares one of them; by mode and gate."""
    need = F.lit(None).cast("int")
    for mode, bonus in STATES.items():
        for gate in (True, False):
            share = least - bonus - INDUSTRY * gate
            own = F.greatest(F.lit(1), F.ceil(F.size("rare") * share - 1e-9).cast("int"))
            need = F.when((F.col("mode.mode") == mode) & ((F.col("gate") != "") == F.lit(gate)), own).otherwise(need)
    return F.slice("rare", 1, F.greatest(F.size("rare") - need + 1, F.lit(0)))


def _sides(rows: DataFrame, modes: Column, gates: Column, smaller: str, larger: str, least: float) -> DataFrame:
    """Rows once for each mode, gate, and word by which a partner may be met: the rarest as the smaller name, all as the larger."""
    each = rows.withColumn("mode", F.explode(modes)).withColumn("gate", F.explode(gates))
    each = each.withColumn("prefix", _prefix(least)).withColumn("role", F.explode(F.array(F.lit(smaller), F.lit(larger))))
    return each.withColumn("word", F.explode(F.when(F.col("role") == smaller, F.col("prefix")).otherwise(F.col("rare")))).withColumn("kind", F.col("mode.mode")).withColumn("where", F.col("mode.state")).drop("mode")


def candidates(facilities: DataFrame, reported: DataFrame, least: float) -> DataFrame:
    """The pairs that are held against each other, each once, with the columns of both sides.

    Names meet by rare words only: where a pair needs k words of the smaller name's n to score least, one of its n - k + 1 rarest
    is shared. How many it needs depends on what the states and the industry add, so those are parts of the key, and pairs that
    can't reach least with any overlap don't meet.
    """
    words = facilities.select(F.explode("a_tokens").alias("word")).unionAll(reported.select(F.explode("b_tokens").alias("word")))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    upper = lambda c: F.upper(F.coalesce(c, F.lit("")))
    mode = lambda name, state="": F.struct(F.lit(name).alias("mode"), (upper(state) if state else F.lit("")).alias("state"))
    named = F.when(F.col("layer") == "coal_mines", "coal").when(F.col("layer") == "gas_plants", "gas").otherwise("")
    coal, gas = _industries()
    gates = F.filter(F.array(F.lit(""), F.when(coal, "coal"), F.when(gas, "gas")), lambda g: g.isNotNull())
    a_modes = F.when(upper("a_state") == "", F.array(mode("left blank"))).otherwise(F.array(mode("same", "a_state"), mode("right blank"), mode("different")))
    b_modes = F.when(upper("b_state") == "", F.array(mode("left blank"), mode("right blank"))).otherwise(F.array(mode("same", "b_state"), mode("left blank"), mode("different")))
    left = _sides(_by_rarity(facilities, "a", "a_tokens", counts), a_modes, F.array(named), "a", "b", least).withColumnsRenamed({"prefix": "a_prefix", "rare": "a_rare"})
    right = _sides(_by_rarity(reported, "b", "b_tokens", counts), b_modes, gates, "b", "a", least).withColumnsRenamed({"prefix": "b_prefix", "rare": "b_rare"})
    met = left.join(right, ["role", "kind", "where", "gate", "word"])
    by_a = (F.col("role") == "a") & (F.size("a_rare") <= F.size("b_rare")) & (F.get(F.array_intersect("a_prefix", "b_rare"), F.lit(0)) == F.col("word"))
    by_b = (F.col("role") == "b") & (F.size("b_rare") < F.size("a_rare")) & (F.get(F.array_intersect("b_prefix", "a_rare"), F.lit(0)) == F.col("word"))
    told = (F.col("kind") != "different") | (upper("a_state") != upper("b_state"))
    return met.where((by_a | by_b) & told).drop("role", "kind", "where", "gate", "word", "a_prefix", "b_prefix", "a_rare", "b_rare")


def score_pairs(facilities: DataFrame, reported: DataFrame, least: float = REVIEW) -> DataFrame:
    """a, b, a_ord, b_ord and score of each pair with a score of at least least, which is over 0.

    facilities: a, a_ord, a_tokens, a_state, layer. reported: b, b_ord, b_tokens, b_state, industry. Pairs that share no
    word score 0. The score is the overlap by the smaller name, with a bonus or a fine for the state where both have one,
    nothing if the industry can't be the layer's, a bonus if it can, and a fine for a single short word.
    """
    met = candidates(facilities, reported, least).withColumn("shared", F.array_intersect("a_tokens", "b_tokens"))
    met = met.withColumns({"overlap": F.size("shared"), "longest": F.array_max(F.transform("shared", F.length)), "size": F.least(F.size("a_tokens"), F.size("b_tokens"))})
    return met.select("a", "b", "a_ord", "b_ord", pair_score().alias("score")).where(F.col("score") >= least)


def _industries() -> tuple[Column, Column]:
    """Whether a reported industry can be that of a mine, and of a plant."""
    industry = F.lower(F.coalesce("industry", F.lit("")))
    return industry.contains("coal"), industry.contains("gas") | industry.contains("electricity") | industry.contains("petroleum")


def pair_score() -> Column:
    """The score of a pair by overlap, size, longest, a_state, b_state, layer and industry."""
    coal, gas = _industries()
    gate = F.when(F.col("layer") == "coal_mines", coal).when(F.col("layer") == "gas_plants", gas)
    one, two = (F.upper(F.coalesce(c, F.lit(""))) for c in ("a_state", "b_state"))
    both = (one != "") & (two != "")
    state = F.when(both & (one == two), SAME).when(both, DIFFERENT).otherwise(0.0)
    short = F.when((F.col("overlap") == 1) & (F.col("longest") <= 4), SHORT).otherwise(0.0)
    bonus = F.when(gate.isNotNull(), INDUSTRY).otherwise(0.0)
    return F.when(gate.isNotNull() & ~gate, 0.0).otherwise(F.col("overlap") / F.col("size") + state + bonus - short)


def in_period(plumes: DataFrame, low: str = "2024-07-01", high: str = "2025-06-30") -> DataFrame:
    """Detections and peak rate of each facility within days that are compared as text; an empty day is never inside."""
    day = F.substring("datetime_utc", 1, 10)
    held = plumes.where(day.between(low, high) & F.col("facility_name").isNotNull())
    return held.groupBy("facility_name", "facility_layer").agg(F.count("*").alias("detections_in_period"), F.max(F.when(F.col("rate") != 0, F.col("rate"))).alias("peak_in_period"))


def silent_reporters(facilities: DataFrame, least: float = 500.0) -> DataFrame:
    """Facilities that report at least so many kilograms an hour, are watched, and showed nothing in the period."""
    return facilities.where((F.col("reported_kg_hr") >= least) & (F.coalesce("detections_in_period", F.lit(0)) == 0) & (F.col("watch_status") == "watched, no plume"))


def apply_matches(facilities: DataFrame, accepted: DataFrame, reported: DataFrame) -> DataFrame:
    """facilities (layer, name, operator) with the reported figures of their accepted match.

    accepted: layer, name, cer_name, score. reported: cer_name, operator, methane_tco2e, covered_tco2e, baseline. The
    reported operator replaces the facility's if it isn't blank; methane counts if it is over 0.
    """
    figures = reported.select("cer_name", F.col("operator").alias("r_operator"), "methane_tco2e", F.col("covered_tco2e").alias("covered_emissions_tco2e"), F.col("baseline").alias("baseline_tco2e"))
    held = accepted.select("layer", "name", "cer_name", F.bround("score", 2).alias("cer_match_score")).join(figures, "cer_name")
    t = F.when(F.col("methane_tco2e") > 0, F.col("methane_tco2e"))
    out = facilities.join(held, ["layer", "name"], "left").withColumn("operator", F.coalesce(F.nullif("r_operator", F.lit("")), "operator"))
    return out.withColumns({"reported_methane_tco2e": F.bround(t, 0), "reported_ch4_tonnes_yr": F.bround(t / METHANE_GWP, 0), "reported_avg_kg_hr": reported_kg_hr(t)}).drop("r_operator", "methane_tco2e")
