"""Problem 6: page boilerplate mixed with main content.

Equivalence-class template deduction, fitted by ``pages``: lines with equal occurrence vectors over the pages
of a host are classes, valid classes nest into the host's template, and what is left fills its slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcred.llm.pages import Marker, pages_of


def boilerplate_lines(news: DataFrame, most_keys: int | None = None) -> DataFrame:
    """(id, line_no) of every non-blank line that holds nothing of the article's own body.

    Null or blank content gives no rows. Repeated rows give their lines once per row of the input.
    Lines count from 1 over ``content`` split at ``\\n``.
    """
    pages = pages_of(news)
    marker = Marker(pages, **({} if most_keys is None else {"most_keys": most_keys}))

    def make(model):
        return lambda row, lines, marks: ((row.id, n) for n, m in enumerate(marks, 1) if m == 1)

    return marker.apply(pages.filter("content is not null"), make, "id long, line_no int")


def bodies(news: DataFrame, *more: str) -> DataFrame:
    """(id, body, ...): each record's content without the lines of the page around it.

    Null content gives a null body; a page without any body line gives ''.
    """
    pages = pages_of(news, *more)
    marker = Marker(pages)
    types = dict(news.dtypes)

    def make(model):
        return lambda row, lines, marks: [(row.id, None if row.content is None else "\n".join(x for x, m in zip(lines, marks) if m == 0), *[getattr(row, c) for c in more])]

    return marker.apply(pages, make, ", ".join(["id long, body string", *[f"{c} {types[c]}" for c in more]]))


def templates(news: DataFrame) -> DataFrame:
    """The template of each host, one row per class: (host, cls, parent, n_lines, pages, n_sentences, n_page_slots).

    ``parent`` is the class between whose lines it stands, 0 for the page itself. Lines of a class of their
    own come one row each. ``n_page_slots`` counts lines after which the page goes on.
    """
    t = Marker(pages_of(news)).template
    name = F.when(F.col("cls") != 0, F.col("cls")).otherwise(F.xxhash64("host", "key"))
    return t.groupBy("host", name.alias("cls")).agg(
        F.max("parent").alias("parent"), F.count("*").cast("int").alias("n_lines"), F.max("pages").alias("pages"),
        F.sum(F.col("sentence").cast("int")).cast("int").alias("n_sentences"), F.sum("slot").cast("int").alias("n_page_slots"),
    )
