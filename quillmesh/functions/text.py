"""Text column functions shared by all operators; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that Unicode counts as white space, for trimming.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"

WORD = r"[\p{L}\p{N}]+"

#: Words that say nothing in a quiz clue, beside the usual stop words of a language.
QUIZ_WORDS = ("name", "one", "points", "ftp", "10", "man", "another", "", "whose", "named", "include", "used", "ten", "called", "identify")


def stripped(c: Column) -> Column:
    """Text without Unicode white space at either end; null stays null."""
    return F.btrim(c, F.lit(WHITE))


def clean_feature(c: Column) -> Column:
    """Trimmed, lower-cased value; null where nothing is left."""
    v = F.lower(stripped(c))
    return F.when(v != "", v)


def words(c: Column) -> Column:
    """Longest runs of letters and digits, lower-cased, in text order.

    A null text gives null, an empty one an empty array.
    """
    return F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), lambda w: F.lower(w))


def ftp_rewrite(c: Column) -> Column:
    """``For 10 points`` and ``for 10 points`` become ``FTP``."""
    return F.regexp_replace(c, "[fF]or 10 points", "FTP")


def reduced_category(c: Column) -> Column:
    """Category in lower case, reduced to one level.

    With ``--`` the part before it, or the part after it when the part before
    is ``science``; trimmed. Null, empty, ``unknown`` and ``non selected``
    become ``unknown``.
    """
    low = stripped(F.lower(c))
    parts = F.split(low, "--", 2)
    head = stripped(F.element_at(parts, 1))
    picked = F.when(
        F.contains(low, F.lit("--")),
        F.when(head == "science", stripped(F.element_at(parts, -1))).otherwise(head),
    ).otherwise(low)
    return F.when(picked.isNull() | picked.isin("", "unknown", "non selected"), "unknown").otherwise(picked)


def tokenized(c: Column) -> Column:
    """Words and runs of punctuation, in text order."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0))


def entities(c: Column) -> Column:
    """Runs of capitalised words, in text order: the default named-entity extractor.

    It stands in for a trained chunker, with the same shape of result; pass
    another Column builder to the operators to replace it.
    """
    return F.regexp_extract_all(c, F.lit(r"\p{Lu}\p{Ll}+(?:\s\p{Lu}\p{Ll}+)*"), F.lit(0))


def referer(phrase: Column) -> Column:
    """Text of a noun phrase without its first word and without the word ``FTP``."""
    w = F.split(phrase, r"\s+")
    return F.array_join(F.filter(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda x: x != "FTP"), " ")


def referers(c: Column, prepositions: bool = False) -> Column:
    """Distinct texts of phrases that begin with ``this``: the default noun-phrase extractor.

    With ``prepositions`` a phrase may go on after ``of``, ``in``, ``on``,
    ``by``, ``for``, ``from``, ``to`` or ``with``, as the wider grammar has it.
    """
    more = r"(?:\s(?:of|in|on|by|for|from|to|with)(?:\s(?!(?:of|in|on|by|for|from|to|with)\b)\p{Ll}+){1,3})*" if prepositions else ""
    word = r"\s(?!(?:of|in|on|by|for|from|to|with)\b)\p{Ll}+" if prepositions else r"\s\p{Ll}+"
    found = F.regexp_extract_all(c, F.lit(rf"\bthis(?:{word}){{1,3}}{more}"), F.lit(0))
    return F.array_distinct(F.transform(found, referer))


def category(c: Column) -> Column:
    """Category with its sub-category reduced, in its own letter case.

    Without ``--`` it stays, and ``Unknown``, ``Non Selected`` and an empty one
    are ``Unknown``; with it the main part, or the sub-category of ``Science``,
    trimmed. More than two parts raise an error; null gives ``Unknown``.
    """
    parts = F.split(c, "--")
    main, sub = F.trim(F.element_at(parts, 1)), F.trim(F.try_element_at(parts, F.lit(2)))
    return (
        F.when(c.isNull() | c.isin("Unknown", "Non Selected", ""), F.lit("Unknown"))
        .when(F.size(parts) == 1, c)
        .when(F.size(parts) > 2, F.raise_error(F.concat(F.lit("category with more than two parts: "), c)).cast("string"))
        .otherwise(F.when(main == "Science", sub).otherwise(main))
    )


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def ngrams(c: Column, size: int = 3, mark: str = "~") -> Column:
    """Runs of ``size`` tokens joined by a mark; none for a shorter text."""
    t = tokenized(c)
    last = F.size(t) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.array_join(F.slice(t, k + 1, size), mark))).otherwise(F.array().cast("array<string>"))
