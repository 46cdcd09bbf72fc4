"""Queries over the operators for training data, and their SQL where SQL can express them."""

from __future__ import annotations

from sparkcred.llm import boilerplate, language, leakage, mixing, near_duplicates, new_batches, repeated_lines, splitting, truncation
from sparkcred.session import table


def _news(spark, d):
    return table(spark, d, "realtime_news")


def _documents(spark, d):
    return table(spark, d, "documents")


def queries():
    return {
        "p1_found": lambda s, d: language.language_cases(_news(s, d), _documents(s, d)),
        "p1_languages": lambda s, d: language.languages(_news(s, d), _documents(s, d)),
        "p2_found": lambda s, d: truncation.truncated(_news(s, d)),
        "p2_shares": lambda s, d: truncation.shares(_news(s, d)),
        "p3_found": lambda s, d: near_duplicates.near_pairs(_news(s, d)),
        "p3_groups": lambda s, d: near_duplicates.near_groups(_news(s, d)),
        "p4_found": lambda s, d: new_batches.known_articles(_news(s, d)),
        "p4_articles": lambda s, d: new_batches.article_ids(_news(s, d)),
        "p5_found": lambda s, d: repeated_lines.repeated_lines(_news(s, d)),
        "p5_blocks": lambda s, d: repeated_lines.repeated_blocks(_news(s, d)),
        "p5_clean": lambda s, d: repeated_lines.without_repeated(_news(s, d)),
        "p6_found": lambda s, d: boilerplate.boilerplate_lines(_news(s, d)),
        "p6_body": lambda s, d: boilerplate.bodies(_news(s, d)),
        "p6_templates": lambda s, d: boilerplate.templates(_news(s, d)),
        "p7_found": lambda s, d: leakage.leaked_pairs(_documents(s, d), table(s, d, "eval_items")),
        "p7_spans": lambda s, d: leakage.leaks(_documents(s, d), table(s, d, "eval_items")),
        "p7_clean": lambda s, d: leakage.without_leaks(_documents(s, d), table(s, d, "eval_items")),
        "p8_mix": lambda s, d: mixing.selection(_documents(s, d), table(s, d, "mix_targets")),
        "p8_shares": lambda s, d: mixing.report(_documents(s, d), table(s, d, "mix_targets")),
        "p9_found": lambda s, d: splitting.oversized(_documents(s, d), table(s, d, "split_limits")),
        "p9_pieces": lambda s, d: splitting.pieces(_documents(s, d), table(s, d, "split_limits")),
    }


def oracle_sql():
    return {
        "p5_found": r"""
WITH lines AS (
  SELECT id, trim(media) AS media, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no
  FROM realtime_news WHERE content IS NOT NULL AND trim(media) <> ''),
keyed AS (SELECT id, media, line_no, lower(upper(regexp_replace(line, '[^\p{L}]+', '', 'g'))) AS k FROM lines),
often AS (SELECT media, k FROM keyed WHERE k <> '' GROUP BY media, k HAVING count(DISTINCT id) >= 8)
SELECT id, CAST(line_no AS INTEGER) AS line_no FROM keyed JOIN often USING (media, k)""",
    }
