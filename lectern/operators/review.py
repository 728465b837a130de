"""Normalising what models answer: tags, readings of works, names of regions; measured models; prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from .neighbours import top_k


def normal_tags(tags: Column, vocabulary: Column, most: int = 6) -> Column:
    """Known tags, each once, at most six."""
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: F.array_contains(vocabulary, t))), 1, most)


def normal_proposals(proposals: Column, vocabulary: Column, most: int = 2) -> Column:
    """New tags, lower-cased with dashes for white space, none known already, at most two."""
    slugs = F.transform(proposals, lambda p: F.replace(tx.squeeze(F.lower(p)), F.lit(" "), F.lit("-")))
    return F.slice(F.array_distinct(F.filter(slugs, lambda s: (F.length(s) > 0) & ~F.array_contains(vocabulary, s))), 1, most)


def register_proposals(proposals: DataFrame, tags: DataFrame, least: float = fixed.MERGE_SIMILARITY) -> DataFrame:
    """(slug, outcome, canonical): the tag that exists, an alias of the most similar one if at least 0.90 alike, or a new one to review.

    Both inputs have slug and v.
    """
    numbered = lambda df: df.select(F.xxhash64("slug").alias("id"), "v")
    near = top_k(numbered(proposals), numbered(tags), 1, skip_self=False).select(F.col("i").alias("id"), F.col("j").alias("other_id"), "similarity")
    names = tags.select(F.xxhash64("slug").alias("other_id"), F.col("slug").alias("other"))
    out = proposals.select("slug", F.xxhash64("slug").alias("id")).join(near, "id", "left").join(names, "other_id", "left").join(tags.select("slug", F.lit(True).alias("exists")), "slug", "left")
    alike = F.col("similarity") >= least
    outcome = F.when(F.col("exists"), "existing").when(alike, "merged").otherwise("pending_review")
    return out.select("slug", outcome.alias("outcome"), F.when(F.col("exists"), F.col("slug")).when(alike, F.col("other")).alias("canonical"))


ANSWER_CHARS, BRIDGE_CHARS = 320, 420
READING = "struct<genre: string, question: string, argument: string, significance: string, claims: array<string>, entities: array<struct<name: string, kind: string>>, grounded: boolean>"


def normal_reading(answer: Column) -> Column:
    """A model's reading of a work, from JSON.

    A genre off the list is "other"; answers are cut to sentences and blanked when they echo the
    instructions; at most four distinct claims of four words; at most eight things of known
    kinds, each name once; grounded only if all three questions are answered.
    """
    return tx.once(F.from_json(answer, READING), _reading)


def _reading(a: Column) -> Column:
    line = lambda c: F.coalesce(tx.squeeze(c), F.lit(""))
    cut = lambda c: tx.once(line(c), lambda text: tx.sentence_cut(text, ANSWER_CHARS))
    names = ("question", "argument", "significance")

    def said(name: str) -> Column:
        return tx.once(cut(a[name]), lambda text: F.when(F.lower(text).rlike("|".join(fixed.ECHOES)), F.lit("")).otherwise(text))

    claims = F.transform(F.coalesce(a["claims"], F.array().cast("array<string>")), cut)
    claims = F.array_distinct(F.filter(claims, lambda c: F.size(F.split(c, " ")) >= 4))
    things = F.transform(F.coalesce(a["entities"], F.array().cast("array<struct<name: string, kind: string>>")), lambda e: F.struct(line(e["name"]).alias("name"), F.lower(line(e["kind"])).alias("kind")))
    things = F.filter(things, lambda e: (F.length(e["name"]) > 0) & e["kind"].isin(*fixed.THINGS))

    def first_of_name(things: Column) -> Column:
        return tx.once(F.transform(things, lambda e: F.lower(e["name"])), lambda names: F.filter(things, lambda e, k: F.array_position(names, F.lower(e["name"])) == k + 1))

    genre = tx.once(line(a["genre"]), lambda g: F.when(g.isin(*fixed.GENRES), g).otherwise("other"))

    def whole(answers: Column) -> Column:
        answered = reduce(lambda x, y: x & y, (F.length(answers[n]) > 0 for n in names), F.lit(True))
        entities = F.slice(tx.once(things, first_of_name), 1, 8)
        return F.struct(genre.alias("genre"), *[answers[n].alias(n) for n in names], F.slice(claims, 1, 4).alias("claims"), entities.alias("entities"), (F.coalesce(a["grounded"], F.lit(True)) & answered).alias("grounded"))

    return tx.once(F.struct(*[said(n).alias(n) for n in names]), whole)


def genre_label(genre: Column) -> Column:
    cells = [x for pair in fixed.GENRE_LABELS.items() for x in map(F.lit, pair)]
    return F.try_element_at(F.create_map(*cells), genre)


def entity_groups(entities: Column) -> Column:
    """Names by kind, in the order of kinds; kinds without names are left out."""
    groups = [F.struct(F.lit(k).alias("kind"), F.transform(F.filter(entities, _of_kind(k)), lambda e: e["name"]).alias("names")) for k in fixed.THINGS]
    return F.filter(F.array(*groups), lambda g: F.size(g["names"]) > 0)


def _of_kind(kind: str):
    return lambda e: e["kind"] == kind


def placement_sentence(region: Column, confidence: Column, drift: Column) -> Column:
    """How a work sits on the map, in words; null if nothing can be said."""
    where = F.when(region.isNull(), None).when(confidence.isNull(), F.concat(F.lit("Sits in "), region)).when(confidence < 0.5, F.concat(F.lit("Sits between "), region, F.lit(" and its neighbours"))).otherwise(F.concat(F.lit("Sits firmly in "), region))
    return tx.blank_to_null(F.concat_ws(" · ", where, F.when(drift > 1.6, "Unlike most of the library")))


def stop_caption(place: Column, year: Column, label: Column) -> Column:
    return tx.concat_present(" · ", place.cast("string"), year.cast("string"), label)


def region_name(raw: Column) -> Column:
    """At most five words and sixty characters, without quotes and points at the ends; null if nothing is left."""
    text = tx.squeeze(F.regexp_replace(F.coalesce(tx.strip(raw), F.lit("")), r"^[\"'.]+|[\"'.]+$", ""))
    return tx.blank_to_null(F.substring(F.array_join(F.slice(F.split(text, " "), 1, 5), " "), 1, 60))


def bridge_summary(connected: Column, raw: Column) -> Column:
    """What links two regions, if the model says they are linked and in six words at least; else null."""
    text = F.coalesce(tx.squeeze(raw), F.lit(""))
    return F.when(F.coalesce(connected, F.lit(False)) & (F.size(F.split(text, " ")) >= 6), tx.sentence_cut(text, BRIDGE_CHARS))


def model_verdict(total: Column, on_card: Column) -> Column:
    return F.when(total <= 0, "unproven").when(on_card / total > 0.9, "gpu").when(on_card > 0, "partial").otherwise("cpu_only")


def resolved_models(tasks: DataFrame, pins: DataFrame) -> DataFrame:
    """The pinned model of a task, else its default."""
    return tasks.join(pins.select("task", "pinned"), "task", "left").select("task", F.coalesce("pinned", "default_model").alias("model"))


def query_instruction(model_id: Column) -> Column:
    """What a family of encoders wants before a query."""
    low = F.lower(model_id)
    return (
        F.when(F.contains(low, F.lit("qwen")), "Instruct: Given a search query, retrieve relevant passages\nQuery: ")
        .when(F.contains(low, F.lit("e5")), "query: ")
        .when(F.contains(low, F.lit("bge")), "Represent this sentence for searching relevant passages: ")
        .otherwise("")
    )


def naming_prompt(terms: Column, titles: Column) -> Column:
    """The question for a region's name: its terms and a sample of titles."""
    return F.concat_ws("\n", F.lit("Name the subject these works share in two to four words."), F.concat(F.lit("Frequent terms: "), F.array_join(terms, ", ")), F.lit("Titles:"), F.array_join(F.transform(titles, lambda t: F.concat(F.lit("- "), F.substring(t, 1, 120))), "\n"))


def upsert_measurements(profiles: DataFrame, measured: DataFrame) -> DataFrame:
    """Measurements by reference: newer ones replace, missing ones are added, others stay."""
    m = measured.select("reference", F.col("total").alias("_t"), F.col("on_card").alias("_c"))
    out = profiles.join(m, "reference", "full")
    return out.select("reference", F.coalesce("_t", "total").alias("total"), F.coalesce("_c", "on_card").alias("on_card")).withColumn("verdict", model_verdict(F.col("total"), F.col("on_card")))


def best_attempt(attempts: DataFrame, key: str) -> DataFrame:
    """Of parsing attempts (tier, passed, text): the lowest tier that passed, else the highest tier tried with the longest text, as degraded."""
    good = F.min_by(F.struct("tier", "text"), F.when(F.col("passed"), F.col("tier")))
    agg = attempts.groupBy(key).agg(good.alias("good"), F.max("tier").alias("highest"), F.max_by("text", F.struct(F.length("text"), "tier")).alias("longest"))
    passed = F.col("good.tier").isNotNull()
    return agg.select(key, F.when(passed, F.col("good.tier")).otherwise(F.col("highest")).alias("tier"), F.when(passed, F.col("good.text")).otherwise(F.col("longest")).alias("text"), (~passed).alias("degraded"))


def lease_state(leases: DataFrame, now: Column) -> DataFrame:
    """Whether a pause is in force: it hasn't run out; and whether the worker has acknowledged it."""
    live = F.col("until") > now
    return leases.select("nonce", live.alias("active"), (live & F.col("acked").eqNullSafe(F.col("nonce"))).alias("acknowledged"))
