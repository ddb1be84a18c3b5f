"""Text expressions (Column to Column). A null text gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The page furniture that extraction replaces by a space, in this order, ignoring case.
BOILERPLATE = (
    r".*?Close Menu.*?x x اردو.*?",
    r".*?Connect with us.*?Share.*?",
    r".*?Login Register.*?",
    r".*?Select.*?Select.*?",
    r"facebook linkedin whatsapp email print",
    r"©.*?all rights reserved",
)


def collapse(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """The words between white space; an empty array for blank texts."""
    flat = collapse(text)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def strip_boilerplate(text: Column) -> Column:
    """Collapsed text without its boilerplate.

    A pattern that begins by skipping can only match where the last match ended, so it is tied to that place: a text
    without the marker is then passed over once, not once from every position.
    """
    for p in BOILERPLATE:
        tied = r"\G" + p.removesuffix(".*?") if p.startswith(".*?") else p
        text = F.regexp_replace(text, f"(?iu){tied}", " ")
    return text


def drop_adjacent(text: Column) -> Column:
    """A word right before the same word goes, letter case aside."""
    return F.regexp_replace(text, r"(?iuU)\b(\w+)\s+(?=\1\b)", "")


def count_of(text: Column, characters: str) -> Column:
    """How many of the given characters a text holds."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def quality(text: Column) -> Column:
    """length, word_count, avg_word_length (0 if empty), sentence_count, paragraph_count of a text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    w = words(t)
    letters = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    return F.struct(
        F.length(t).alias("length"),
        F.size(w).alias("word_count"),
        F.coalesce(F.try_divide(letters, F.size(w)), F.lit(0.0)).alias("avg_word_length"),
        count_of(t, ".!?").alias("sentence_count"),
        F.size(F.filter(F.split(t, "\n", -1), lambda p: collapse(p) != "")).alias("paragraph_count"),
    )


def preview(text: Column, most: int) -> Column:
    """The first characters, with an ellipsis where the text is longer."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def file_name(title: Column) -> Column:
    """A title as a file name: without reserved characters, trimmed, at most 100 characters, `page` if nothing is left."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r'[<>:"/\\|?*]', "")
    return F.coalesce(F.nullif(F.left(F.regexp_replace(bare, r"(?U)^\s+|\s+$", ""), F.lit(100)), F.lit("")), F.lit("page"))


def file_key(title: Column, url: Column) -> Column:
    """The file of a page: name, ten characters of the md5 of its url, .json."""
    return F.concat(file_name(title), F.lit("_"), F.left(F.md5(F.coalesce(url, F.lit("")).cast("binary")), F.lit(10)), F.lit(".json"))
