"""Where to begin in a set of papers, and in which order to go on."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..functions.vectors import dot, mean_columns, unit
from .catalog import rank_share


def intro_cue(title: Column, abstract: Column) -> tuple[Column, Column]:
    """How strongly a paper announces itself as an introduction (1, 0.5 or 0), and the words that do."""
    by_title = F.lower(tx.first_match(title, "(?i)" + fixed.TITLE_CUES))
    by_abstract = F.lower(tx.first_match(F.substring(abstract, 1, fixed.ABSTRACT_WINDOW), "(?i)" + fixed.ABSTRACT_CUES))
    return F.when(by_title.isNotNull(), 1.0).when(by_abstract.isNotNull(), 0.5).otherwise(0.0), F.coalesce(by_title, by_abstract)


def length_score(pages: Column) -> Column:
    low, high = fixed.SHORT_PAGES, fixed.LONG_PAGES
    return F.when(pages.isNull(), 0.5).when(pages <= low, 1.0).when(pages >= high, 0.0).otherwise(1 - (pages - low) / float(high - low))


def rank_entry_points(papers: DataFrame, key: str = "cluster", dim: int = 64) -> DataFrame:
    """Papers of each set scored as a place to begin, with reasons and their rank.

    Input: key, id, title, abstract, year, pages, v.  Sets of one paper have no entry point.
    """
    w = Window.partitionBy(key)
    sized = papers.withColumn("u", unit(F.col("v")))
    means = sized.groupBy(key).agg(F.count(F.lit(1)).alias("size"), *mean_columns(dim, "u")).where("size > 1")
    centres = means.select(key, unit(F.array(*[F.col(f"_m{k}") for k in range(dim)])).alias("centre"))
    rows = sized.join(centres, key).withColumn("raw", F.round(dot(F.col("u"), F.col("centre")), 12))
    rows = rows.withColumn("rank_share", rank_share("raw", [key]))
    first, last = F.min("year").over(w), F.max("year").over(w)
    rows = rows.withColumn("spread", F.coalesce(first < last, F.lit(False)))
    rows = rows.withColumn("year_score", F.when(F.col("spread") & F.col("year").isNotNull(), 1 - (F.col("year") - first) / (last - first)).otherwise(0.5))
    intro, cue = intro_cue(F.col("title"), F.col("abstract"))
    rows = rows.withColumn("intro", intro).withColumn("cue", cue).withColumn("brevity", length_score(F.col("pages")))
    g = fixed.ENTRY_WEIGHTS
    score = g["centrality"] * F.col("rank_share") + g["intro"] * F.col("intro") + g["year"] * F.col("year_score") + g["length"] * F.col("brevity")
    rows = rows.withColumn("score", F.bround(score, 4)).withColumn("centrality", F.bround("raw", 4)).withColumn("reasons", reasons())
    order = w.orderBy(F.desc("score"), F.desc("centrality"), F.asc_nulls_last("year"), "id")
    return rows.withColumn("place", F.row_number().over(order)).select(key, "id", "title", "year", "score", "centrality", "reasons", "place", "u")


def reasons() -> Column:
    """What speaks for a paper, in words; only what is true of it."""
    c, i, y, b = F.col("rank_share"), F.col("intro"), F.col("year_score"), F.col("brevity")
    dated = F.col("spread") & F.col("year").isNotNull()
    paged = F.col("pages").isNotNull()
    parts = [
        F.when(c >= 1, "closest to the centre of this region").when(c >= 0.5, "near the centre of this region"),
        F.when(i >= 1, F.concat(F.lit("reads as an introduction — the title says '"), "cue", F.lit("'"))).when(i >= 0.5, F.concat(F.lit("reads as an introduction — the abstract says '"), "cue", F.lit("'"))),
        F.when(dated & (y >= 1), F.format_string("among the earliest here (%d)", "year")).when(dated & (y >= 0.5), F.format_string("from the earlier half of this region (%d)", "year")),
        F.when(paged & (F.col("pages") <= fixed.SHORT_PAGES), F.format_string("short (%d pages)", "pages")).when(paged & (b >= 0.5), F.format_string("not a long read (%d pages)", "pages")),
    ]
    return F.array_compact(F.array(*parts))


def reading_order(scored: DataFrame, key: str = "cluster", limit: int = fixed.MAX_READING_ORDER) -> DataFrame:
    """(key, step, id): from the entry point on, always to the paper most like the last one and best in itself.

    A walk is sequential; each set is walked in one task.  Input is the result of rank_entry_points.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        u, score = np.stack(rows["u"].to_numpy()), rows["score"].to_numpy()
        route = [int(rows["place"].to_numpy().argmin())]
        free = np.ones(len(rows), bool)
        free[route] = False
        while len(route) < min(limit, len(rows)):
            pull = np.where(free, fixed.WALK_SIMILARITY * (u @ u[route[-1]]) + fixed.WALK_SCORE * score, -np.inf)
            route.append(int(pull.argmax()))
            free[route[-1]] = False
        return pd.DataFrame({key: rows[key].iloc[0], "step": range(len(route)), "id": rows["id"].to_numpy()[route]})

    kind = dict(scored.dtypes)[key]
    return scored.select(key, "id", "score", "place", "u").groupBy(key).applyInPandas(walk, f"{key} {kind}, step int, id long")


def curriculum(papers: DataFrame, key: str = "cluster", dim: int = 64, alternatives: int = 2) -> DataFrame:
    """Entry point and alternatives of each set, of papers that can be recommended by their titles."""
    usable = papers.where(F.col("v").isNotNull() & tx.presentable(F.col("title")))
    return rank_entry_points(usable, key, dim).where(F.col("place") <= 1 + alternatives)
