"""Removal of repeated lines, sentences or paragraphs across the corpus.

A text is cut into units behind a pattern, so that its units in a row are the
text. A unit is normalised (A-Z in lower case, runs of white space as one
blank, none at the ends) and known by the MD5 of that; units of white space
alone are known by nothing. Of all occurrences of a digest the one ranked
first, by document id, text hash and position, is kept, and the others are
repeats. What is removed are runs: repeats that are neighbours but for units of
white space, and hold ``run_words`` words or more together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetloom.plans.shared import materialise, release

from .common import columns_of

SEPARATOR = "\n"
MIN_WORDS = 5
#: Behind a sentence's end and behind a line feed.
SENTENCES = r"(?<=[.!?])(?=[\x09-\x0D\x20])|(?<=[\n\u3002\uFF01\uFF1F])"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(unit: Column) -> Column:
    return F.translate(F.trim(F.regexp_replace(unit, r"[\x09-\x0D\x20]+", " ")), _UPPER, _LOWER)


def _tag(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _behind(separator: str) -> str:
    return "(?<=\\Q" + separator + "\\E)"


def repeats(docs: DataFrame, id_col: str, text_col: str, pattern: str, min_words: int, run_words: int, single: bool = False) -> DataFrame:
    """``id, tag, runs array<struct<first, last>>``: for each document that has some the positions (from 0) of its runs of repeated units (``single``: each a run of its own)."""
    own = docs.select(F.col(id_col).alias("id"), _tag(F.col(text_col)).alias("tag"), F.col(text_col).alias("text")).where("text is not null")
    units = F.transform(F.split("text", pattern, -1), lambda u, i: F.struct(i.alias("place"), normalised(u).alias("unit")))
    # Positions among the units that are not blank tell neighbours.
    units = own.select("id", "tag", F.posexplode(F.filter(units, lambda u: u["unit"] != "")).alias("at", "u"))
    units = units.select("id", "tag", "at", F.col("u.place").alias("place"), F.size(F.split("u.unit", " ")).alias("words"), F.unhex(F.md5("u.unit")).alias("digest"))
    units = materialise(units.where(F.col("words") >= min_words))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "tag", "place")
    first = units.groupBy("digest").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1").select("digest", "first")
    later = units.join(first.hint("rebalance"), "digest").where(rank != F.col("first")).select("id", "tag", "at", "place", "words")
    # The repeats of one document at a time: rows that share id and text repeat each other's positions.
    at = F.array_sort(F.collect_set(F.struct("at", "place", "words")))
    later = later.groupBy("id", "tag").agg(at.alias("found"))
    if single:
        grown = F.transform("found", lambda u: F.struct(u["at"].alias("at"), u["place"].alias("first"), u["place"].alias("last"), u["words"].alias("words")))
    else:
        grown = F.aggregate("found", F.expr("cast(array() as array<struct<at:int,first:int,last:int,words:int>>)"), _grow)
    runs = F.transform(F.filter(grown, lambda r: r["words"] >= run_words), lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last")))
    out = materialise(later.select("id", "tag", runs.alias("runs")).where(F.size("runs") > 0))
    release(units)
    return out


def _grow(runs: Column, u: Column) -> Column:
    """Runs with one more repeat, which goes on with the last run or begins another."""
    end = F.try_element_at(runs, F.lit(-1))
    longer = F.struct(u["at"].alias("at"), end["first"].alias("first"), u["place"].alias("last"), (end["words"] + u["words"]).alias("words"))
    other = F.struct(u["at"].alias("at"), u["place"].alias("first"), u["place"].alias("last"), u["words"].alias("words"))
    return F.when(end["at"] == u["at"] - 1, F.array_append(F.slice(runs, 1, F.size(runs) - 1), longer)).otherwise(F.array_append(runs, other))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", separator: str = SEPARATOR, min_words: int = MIN_WORDS, kept_text: bool = True, pattern: str | None = None, run_words: int = 0,
) -> DataFrame:
    """Every row of ``docs`` without its runs of repeated units.

    Returns the columns of ``docs`` (``text_col`` with what is left; only with
    ``kept_text``) and ``n_units, n_removed, removed array<struct<start,stop>>``:
    code points of the original text. Columns of ``docs`` with those names are
    replaced; others may have any name.

    With ``separator`` units are what lies between, a run is one unit (and
    ``run_words`` words at least), and what is left is joined by the separator.
    With a ``pattern`` (such as :data:`SENTENCES`) units begin where it matches
    the empty string, runs go over neighbours, and what is left is put together.

    Units of fewer than ``min_words`` words are never repeats. Null texts have
    no unit and stay null; an empty text has one, which stays. Rows that share
    id and text count as one row. Null ids rank last.
    """
    columns_of(docs, id_col, text_col)
    by_line = pattern is None
    found = repeats(docs, id_col, text_col, _behind(separator) if by_line else pattern, min_words, run_words, by_line)
    added = ["n_units", "n_removed", "removed"]
    kept = [c for c in docs.columns if c not in added and (kept_text or c != text_col)]
    # All columns travel in one struct, so that none of their names can meet those used here.
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("own"), _tag(F.col(f"`{text_col}`")).alias("own_tag"))
    joined = left.join(found, left["own"].eqNullSafe(found["id"]) & (left["own_tag"] == found["tag"]), "left")
    text = F.col("row").getField(text_col)
    with_units = joined.select("row", "runs", F.split(text, _behind(separator) if by_line else pattern, -1).alias("units"))
    size = lambda units: F.aggregate(units, F.lit(0).cast("long"), lambda n, u: n + F.length(u))
    units, own_end = F.col("units"), F.lit(len(separator) if by_line else 0)

    def span(r: Column) -> Column:
        # A line's own end is no part of it; the last line has none.
        tail = F.when(r["last"] < F.size(units) - 1, own_end).otherwise(F.lit(0))
        return F.struct(size(F.slice(units, 1, r["first"])).alias("start"), (size(F.slice(units, 1, r["last"] + 1)) - tail).alias("stop"))

    stays = F.filter(units, lambda u, i: ~F.exists("runs", lambda r: (r["first"] <= i) & (i <= r["last"])))
    rest = F.array_join(stays, "")
    if by_line:  # if the last line goes, the one before it loses its end
        rest = F.when(F.exists("runs", lambda r: r["last"] == F.size(units) - 1) & (F.size(stays) > 0), F.substring(rest, F.lit(1), F.length(rest) - len(separator))).otherwise(rest)
    hit = F.col("runs").isNotNull()
    gone = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    spans = F.when(hit, F.transform("runs", span)).otherwise(F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)"))
    # Named in a struct of its own first: a column of ``docs`` called like one used above must not be taken for it.
    done = with_units.select("row", F.struct(
        F.when(hit, rest).otherwise(text).alias("text"), F.when(units.isNull(), 0).otherwise(F.size(units)).cast("long").alias("n_units"),
        F.coalesce(F.when(hit, gone), F.lit(0)).cast("long").alias("n_removed"), spans.alias("removed"),
    ).alias("done"))
    values = [(F.col("done.text") if c == text_col else F.col("row").getField(c)).alias(c) for c in kept]
    return done.select(*values, *(F.col(f"done.{c}").alias(c) for c in added))
