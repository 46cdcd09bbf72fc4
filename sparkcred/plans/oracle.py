"""DuckDB SQL of the catalogue's queries, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from sparkcred.functions import lexicons as L
from sparkcred.functions.text import WS, keyword_regex

META = ("emo_count", "emo_ratio", "quote_count", "quote_ratio", "ellipsis_count", "ellipsis_ratio", "excl_count", "excl_ratio", "quest_count", "quest_ratio", "title_len", "content_len")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), {q(WS)}, ' ', 'g'))"


def clean(x: str) -> str:
    tags = f"regexp_replace(lower(coalesce({x}, '')), '<[^>]+>', ' ', 'g')"
    return strip(f"regexp_replace({tags}, {q(r'[^가-힣a-zA-Z0-9\s\x{85}\x1c-\x1f\p{Z}]')}, ' ', 'g')")


def n_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), {q(pattern)}))"


def flag_cols(x: str, lexicon: dict, case: bool) -> str:
    return ", ".join(f"CAST(regexp_matches({x}, {q(('' if case else '(?i)') + keyword_regex(w))}) AS INTEGER) AS {f}" for f, w in lexicon.items())


TEXT = "coalesce(title, '') || ' ' || coalesce(content, '')"
PREPARED = f"prepared AS (SELECT * EXCLUDE (clean_message, {', '.join(L.FLAGS)}), {flag_cols('m', L.ETL_LEXICON, False)}, m AS clean_message FROM (SELECT *, {clean(TEXT)} AS m FROM articles))"
SPECIAL = lambda x: f"(CASE WHEN length(coalesce({x}, '')) = 0 THEN 1.0 ELSE length(regexp_replace(coalesce({x}, ''), {q('[' + L.STANDARD_CHARS + ']')}, '', 'g')) / length({x}) END)"
FOREIGN = lambda x: f"(CASE WHEN length(coalesce({x}, '')) = 0 THEN 0.0 ELSE {n_of(x, r'[\x{4E00}-\x{9FFF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}]')} / length({x}) END)"
REST = f"length(trim(regexp_replace(regexp_replace(coalesce(content, ''), {q('(?i)' + '|'.join(L.BOILERPLATE))}, '', 'g'), {q(f'^{WS}|{WS}$')}, '', 'g')))"
SCORE = " + ".join(f"coalesce({f}, 0)" for f in L.FLAGS)
STEPS = {
    "length": f"length(coalesce(content, '')) >= {L.LEAST_CONTENT}",
    "special": f"{SPECIAL('content')} <= {L.SPECIAL_MAX}",
    "boilerplate": f"{REST} >= {L.BOILERPLATE_REST}",
    "foreign": f"{FOREIGN('content')} <= {L.FOREIGN_MAX}",
    "flags": f"NOT (coalesce(label = 1, false) AND ({SCORE}) = 0)",
}
HASH = "md5(lower(coalesce(title, '') || coalesce(content, '')))"
SEEDED = lambda k: f"md5(CAST({k} AS VARCHAR) || '|42')"
DATE = """coalesce(strftime(coalesce(try_strptime(trim({x}), '%B %d, %Y'), try_strptime(trim({x}), '%b %d, %Y'), try_strptime(trim({x}), '%Y-%m-%d'), try_strptime(trim({x}), '%m/%d/%Y')), '%Y-%m-%d'),
  CASE WHEN regexp_extract(coalesce({x}, ''), '(\\d{{4}})', 1) <> '' THEN regexp_extract({x}, '(\\d{{4}})', 1) || '-01-01' END, '')"""
TOKENS = lambda x: f"list_filter(regexp_extract_all(lower(coalesce({x}, '')), '([가-힣]+|[a-z]+|[0-9]+)', 1), lambda w: length(w) > 1)"
IN = lambda words: ", ".join(q(w) for w in words)
META_SQL = {
    "emo_count": n_of("title", L.EMOTION_PATTERN), "quote_count": n_of("content", "[\"']"), "ellipsis_count": n_of("title", r"\.\.\."),
    "excl_count": n_of("title", "!") + " + " + n_of("content", "!"), "quest_count": n_of("title", r"\?") + " + " + n_of("content", r"\?"),
    "title_len": "length(coalesce(title, ''))", "content_len": "length(coalesce(content, ''))",
}
META_RATIO = {"emo_ratio": ("emo_count", "title_len"), "quote_ratio": ("quote_count", "content_len"), "ellipsis_ratio": ("ellipsis_count", "title_len"), "excl_ratio": ("excl_count", "title_len + content_len"), "quest_ratio": ("quest_count", "title_len + content_len")}
META_CTE = lambda t: f"c AS (SELECT id, {', '.join(f'{v} AS {k}' for k, v in META_SQL.items())} FROM {t}), m AS (SELECT *, {', '.join(f'({a}) / (({b}) + 1) AS {k}' for k, (a, b) in META_RATIO.items())} FROM c)"

RATED = "rated AS (SELECT DISTINCT key, CAST(label AS INTEGER) AS label, model, score FROM scores WHERE model IS NOT NULL AND score IS NOT NULL AND label IN (0, 1))"
COUNT4 = "CAST(sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn, CAST(sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp"
RATIO = lambda a, b: f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END)"
_P1, _R1, _P0, _R0 = RATIO("tp", "tp + fp"), RATIO("tp", "tp + fn"), RATIO("tn", "tn + fn"), RATIO("tn", "tn + fp")
_F1, _F0 = RATIO("2 * tp", "2 * tp + fp + fn"), RATIO("2 * tn", "2 * tn + fn + fp")
_W = lambda a, b: RATIO(f"{a} * (tn + fp) + {b} * (fn + tp)", "tn + fp + fn + tp")
METRICS = ", ".join(
    f"round({x}, 6) AS {n}"
    for n, x in {
        "accuracy": RATIO("tp + tn", "tn + fp + fn + tp"), "macro_precision": f"({_P0} + {_P1}) / 2", "macro_recall": f"({_R0} + {_R1}) / 2", "macro_f1": f"({_F0} + {_F1}) / 2",
        "weighted_precision": _W(_P0, _P1), "weighted_recall": _W(_R0, _R1), "weighted_f1": _W(_F0, _F1), "fp_rate": RATIO("fp", "tn + fp"), "fn_rate": RATIO("fn", "fn + tp"),
    }.items()
)
METRICS = "tn, fp, fn, tp, " + METRICS
SWEEP = "sweep AS (SELECT model, CAST(t AS DOUBLE) AS threshold, label, CASE WHEN score >= t THEN 1 ELSE 0 END AS pred FROM rated, (SELECT unnest([0.25, 0.3, 0.35, 0.4, 0.45, 0.5]::DOUBLE[]) AS t)), counts AS (SELECT model, threshold, " + COUNT4 + " FROM sweep GROUP BY ALL), swept AS (SELECT model, threshold, " + METRICS + " FROM counts)"
VOTE = "w AS (SELECT key, model, max(label) AS label, avg(score) AS score, max(CASE model " + " ".join(f"WHEN {q(m)} THEN {x}" for m, x in L.VOTE_WEIGHTS.items()) + " END) AS w FROM rated GROUP BY ALL), vote AS (SELECT key, max(label) AS label, round(sum(w * score) / sum(w), 6) AS score FROM w WHERE w IS NOT NULL GROUP BY key)"
VIEW = f"view AS (SELECT id, category, batch_no, {', '.join(L.FLAGS)}, CASE WHEN fake_score IS NULL THEN 'fallback' ELSE 'model' END AS score_source, coalesce(fake_score, round(CAST(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 4)) AS BIGINT) / 65535 * 100, 1)) AS score FROM realtime_news), viewed AS (SELECT *, CASE WHEN score >= 50 THEN 1 ELSE 0 END AS predicted_label, CASE WHEN score >= 50 THEN 'fake' ELSE 'real' END AS result_text FROM view)"
PAGED = lambda where, order, page: f"WITH {VIEW}, rows_ AS (SELECT id, score, row_number() OVER (ORDER BY {order}) AS position, greatest(1, CAST(ceil(count(*) OVER () / {L.PAGE_SIZE}) AS INTEGER)) AS pages FROM viewed WHERE {where}) SELECT id, score, position, greatest(1, least({page}, pages)) AS page, pages FROM rows_ WHERE ceil(position / {L.PAGE_SIZE}) = greatest(1, least({page}, pages))"

NGRAMS = f"""docs AS (SELECT id, list_filter({TOKENS('content')}, lambda w: w NOT IN ({IN(L.STOPWORDS)})) AS t FROM articles),
grams AS (SELECT id, unnest(list_concat(t, CASE WHEN len(t) > 1 THEN list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM docs)"""


def tfidf_cte(min_df: int, max_df: float, n: str, sub: bool = True, table: str = "grams", most: int | None = 50_000) -> str:
    tf = "(ln(tf) + 1)" if sub else "tf"
    top = f"QUALIFY row_number() OVER (ORDER BY sum(tf) DESC, term) <= {most}" if most else ""
    return f"""tf AS (SELECT id AS key, term, count(*) AS tf FROM {table} GROUP BY ALL), nd AS (SELECT count(*) AS n FROM {n}),
df AS (SELECT term, ln((1.0 + any_value(n)) / (1.0 + count(*))) + 1 AS idf FROM tf, nd GROUP BY term HAVING count(*) >= {min_df} AND count(*) <= {max_df} * any_value(n) {top}),
raw AS (SELECT key, term, {tf} * idf AS w FROM tf JOIN df USING (term)),
weights AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS weight FROM raw)"""


MASS = "mass AS (SELECT term, sum(CASE WHEN label = 0 THEN weight ELSE 0 END) AS w0, sum(CASE WHEN label = 1 THEN weight ELSE 0 END) AS w1 FROM weights JOIN articles ON key = id WHERE label IN (0, 1) GROUP BY term)"
VERDICT_KEY = "CASE " + " ".join(f"WHEN contains({{x}}, {q(k)}) THEN {q(k)}" for k, _ in L.VERDICTS) + " END"
VERDICT_LABEL = "CASE " + " ".join(f"WHEN contains({{x}}, {q(k)}) THEN {v}" for k, v in L.VERDICTS) + " END"

SQL = {
    "etl_flag_summary": f"WITH {PREPARED} SELECT label, count(*) AS n, {', '.join(f'CAST(sum({f}) AS BIGINT) AS {f}' for f in L.FLAGS)} FROM prepared WHERE {' AND '.join(STEPS[k] for k in ('length', 'special', 'boilerplate', 'foreign'))} GROUP BY label",
    "clean_text": f"WITH {PREPARED} SELECT id, clean_message FROM prepared",
    "clean_text_compact": f"SELECT id, lower(regexp_replace(coalesce(content, ''), {q(r'[^가-힣a-zA-Z0-9\s\x{85}\x1c-\x1f\p{Z}]')}, '', 'g')) AS clean_message FROM realtime_news",
    "meta_features": f"WITH {META_CTE('realtime_news')} SELECT id, {', '.join(f'round(CAST({k} AS DOUBLE), 6) AS {k}' for k in META)} FROM m",
    "char_ratios": f"SELECT doc_id, round({SPECIAL('text')}, 6) AS special, round({FOREIGN('text')}, 6) AS foreign_share FROM documents",
    "lang_detect": f"SELECT doc_id, CASE WHEN length(coalesce(text, '')) < 10 THEN 'korean' WHEN {n_of('text', '[가-힣]')} / length(text) >= {L.KOREAN_SHARE} THEN 'korean' ELSE 'english' END AS language FROM documents",
    "factcheck_flags": f"SELECT url, {flag_cols(chr(99) + 'oalesce(content, ' + q('') + ')', L.FACTCHECK_LEXICON, True)} FROM factcheck_raw",
    "live_flags": f"SELECT id, {flag_cols('(' + TEXT + ')', L.LIVE_LEXICON, True)} FROM realtime_news",
    "etl_flags": f"WITH {PREPARED} SELECT id, {', '.join(L.FLAGS)} FROM prepared",
    "admission_exact_dedup": f"WITH a AS (SELECT id, {strip('title')} AS title, {strip('content')} AS content, CASE WHEN {strip('media')} = '' THEN 'Unknown' ELSE {strip('media')} END AS media, {DATE.format(x='date')} AS date FROM realtime_news) SELECT id, media, date, {HASH} AS text_key FROM a WHERE length(content) >= {L.MIN_CONTENT} QUALIFY row_number() OVER (PARTITION BY {HASH} ORDER BY id) = 1",
    "title_dedup_first": "SELECT id, title FROM articles QUALIFY row_number() OVER (PARTITION BY title ORDER BY id) = 1",
    "serving_dedup": f"SELECT min(id) AS id FROM realtime_news GROUP BY regexp_replace(coalesce(title, ''), {q(f'^{WS}|{WS}$')}, '', 'g')",
    "near_dup_titles": r"""WITH RECURSIVE base AS (SELECT id, coalesce(CAST(label AS VARCHAR), '') AS lab, trim(lower(coalesce(title, ''))) AS norm FROM articles),
g AS (SELECT *, regexp_replace(norm, '[^가-힣a-z0-9]', '', 'g') AS k, row_number() OVER (ORDER BY lab, norm, id) AS n FROM base),
h AS (SELECT id, lab, n, CASE WHEN k = '' THEN [] WHEN length(k) < 3 THEN [k] ELSE list_distinct(list_transform(range(1, length(k) - 1), lambda i: substr(k, i, 3))) END AS s FROM g),
r AS (SELECT n, id, true AS keep, lab AS klab, s AS kset FROM h WHERE n = 1
 UNION ALL SELECT h.n, h.id, NOT d, CASE WHEN d THEN klab ELSE h.lab END, CASE WHEN d THEN kset ELSE h.s END FROM r JOIN h ON h.n = r.n + 1,
 LATERAL (SELECT h.lab = r.klab AND len(r.kset) > 0 AND len(list_intersect(h.s, r.kset)) >= 0.9 * (len(h.s) + len(r.kset) - len(list_intersect(h.s, r.kset))) - 1e-9 AS d))
SELECT id FROM r WHERE keep""",
    "quality_filter_funnel": f"WITH {PREPARED}, k AS (SELECT " + ", ".join(f"({' AND '.join(list(STEPS.values())[: i + 1])}) AS s{i}" for i in range(len(STEPS))) + " FROM prepared) SELECT 0 AS step_no, 'all' AS step, count(*) AS rows_left FROM k " + " ".join(f"UNION ALL SELECT {i + 1}, {q(name)}, count(*) FILTER (WHERE s{i}) FROM k" for i, name in enumerate(STEPS)),
    "truncated_content": f"WITH {PREPARED} SELECT id, least(length(content), {L.MAX_CONTENT}) AS content_len, CASE WHEN length(content) > {L.MAX_CONTENT} THEN least(length(clean_message), {L.MAX_CONTENT}) ELSE length(clean_message) END AS clean_len FROM prepared",
    "content_fallback": "SELECT id, md5(c) AS content_key FROM (SELECT id, CASE WHEN length(coalesce(content, '')) < 10 THEN coalesce(title, '') ELSE content END AS c FROM realtime_news) WHERE length(c) >= 10",
    "mode_impute": "SELECT id, " + ", ".join(f"coalesce({c}, (SELECT {c} FROM articles WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)) AS {c}" for c in ("media", "date", "label")) + " FROM articles",
    "no_flag_positive_filter": f"SELECT id, {SCORE} AS flag_score FROM articles WHERE {STEPS['flags']}",
    "undersample_balanced": f"WITH r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN label = 1 THEN -({SCORE}) ELSE 0 END, {SEEDED('id')}, id) AS rk FROM articles WHERE label IN (0, 1)), t AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM articles WHERE label IN (0, 1) GROUP BY label)) SELECT id, label FROM r, t WHERE rk <= n",
    "balanced_subsets": f"WITH r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {SEEDED('id')}, id) AS rk FROM articles WHERE label IN (0, 1)), t AS (SELECT min(n) AS per FROM (SELECT count(*) AS n FROM articles WHERE label IN (0, 1) GROUP BY label)), f AS (SELECT per, greatest(CASE WHEN per % 30 BETWEEN 1 AND 29 THEN per // 30 - 1 ELSE per // 30 END, 0) AS nf FROM t) SELECT id, label, CAST(least((rk - 1) // 30, nf) + 1 AS INTEGER) AS subset_no FROM r, f WHERE rk <= per",
    "stratified_split": f"WITH r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {SEEDED('id')}, id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM articles) SELECT id, label, CASE WHEN rk <= floor(n * 0.72 + 0.5) THEN 'train' WHEN rk <= floor(n * 0.8 + 0.5) THEN 'val' ELSE 'test' END AS split FROM r",
    "kfold_assign": f"SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {SEEDED('id')}, id) - 1) % 5 AS INTEGER) AS fold FROM articles",
    "id_assign": "SELECT id AS old_id, row_number() OVER (ORDER BY id) AS new_id FROM realtime_news",
    "merge_incremental": "WITH b AS (SELECT title, content, label, date, lpad(CAST(id AS VARCHAR), 12, '0') AS ord, 0 AS src FROM articles UNION ALL SELECT title, content, label, date, url, 1 FROM factcheck_raw) SELECT title, md5(coalesce(content, '')) AS content_key, label, date FROM b QUALIFY row_number() OVER (PARTITION BY title ORDER BY src, ord) = 1",
    "token_cache_delta": f"SELECT id FROM realtime_news WHERE {HASH} NOT IN (SELECT {HASH} FROM articles)",
    "token_match_rate": f"WITH c AS (SELECT DISTINCT {HASH} AS k, 1 AS hit FROM articles WHERE len({TOKENS('content')}) > 0) SELECT count(*) AS n, count(hit) AS matched, count(hit) / count(*) < 0.5 AS recompute FROM realtime_news LEFT JOIN c ON k = {HASH}",
    "media_semi": f"SELECT id FROM articles WHERE media IN ({IN(L.ENGLISH_MEDIA)})",
    "media_anti": f"SELECT id FROM articles WHERE media IS NULL OR media NOT IN ({IN(L.ENGLISH_MEDIA)})",
    "label_counts": "SELECT label, count(*) AS n FROM articles GROUP BY label",
    "flag_counts": " UNION ALL ".join(f"SELECT {q(f)} AS flag, CAST(sum({f}) AS BIGINT) AS n FROM articles WHERE label = 1" for f in L.FLAGS),
    "source_distribution": "SELECT source, count(*) AS n FROM factcheck_raw WHERE label = 1 GROUP BY source",
    "source_cap": "SELECT source, url FROM (SELECT DISTINCT source, url FROM factcheck_raw WHERE label = 1) QUALIFY row_number() OVER (PARTITION BY source ORDER BY url) <= 10",
    "factcheck_dedup": "SELECT source, url, title, label, verdict FROM factcheck_raw QUALIFY row_number() OVER (PARTITION BY url ORDER BY title) = 1",
    "term_frequency_topn": f"SELECT term, count(*) AS n FROM (SELECT unnest({TOKENS('text')}) AS term FROM documents) WHERE term NOT IN ({IN(L.STOPWORDS + L.SERVING_STOPWORDS)}) GROUP BY term ORDER BY n DESC, term LIMIT 50",
    "tfidf_vectors": f"WITH {NGRAMS}, {tfidf_cte(2, 0.7, 'articles')} SELECT key, term, round(weight, 5) AS weight FROM weights",
    "tfidf_top_terms": r"WITH grams AS (SELECT id, unnest(list_filter(regexp_split_to_array(coalesce(content, ''), '[ \t\r\n]+'), lambda w: w <> '')) AS term FROM articles), " + tfidf_cte(2, 1.0, "articles", False) + " SELECT term, round(sum(weight) / any_value(n), 7) AS mean_weight FROM weights, nd GROUP BY term ORDER BY mean_weight DESC, term LIMIT 50",
    "char_wb_tfidf": r"""WITH words AS (SELECT id, ' ' || unnest(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '\s+'), lambda w: w <> '')) || ' ' AS w FROM articles),
grams AS (SELECT id, substr(w, i, n) AS term FROM words, (SELECT unnest([2, 3, 4]) AS n), LATERAL (SELECT unnest(range(1, greatest(length(w) - n + 1, 1) + 1)) AS i) WHERE length(w) >= n OR length(w) > n - 1), """ + tfidf_cte(3, 1.0, "articles", most=None) + " SELECT key, term, round(weight, 5) AS weight FROM weights",
    "chi2_topk": f"WITH {NGRAMS}, {tfidf_cte(2, 0.7, 'articles')}, {MASS}, p AS (SELECT avg(label) AS p1 FROM articles WHERE label IN (0, 1)) SELECT term, round((w0 - (1 - p1) * (w0 + w1)) ** 2 / ((1 - p1) * (w0 + w1)) + (w1 - p1 * (w0 + w1)) ** 2 / (p1 * (w0 + w1)), 7) AS chi2 FROM mass, p WHERE w0 + w1 > 0 ORDER BY chi2 DESC, term LIMIT 200",
    "nb_log_ratio": f"WITH {NGRAMS}, {tfidf_cte(2, 0.7, 'articles')}, {MASS}, t AS (SELECT sum(w1 + 1) AS sp, sum(w0 + 1) AS sq FROM mass) SELECT term, round(ln(((w1 + 1) / sp) / ((w0 + 1) / sq)), 6) AS ratio FROM mass, t",
    "meta_scaled": f"WITH {META_CTE('articles')} SELECT id, {', '.join(f'round(({k} - avg({k}) OVER ()) / (CASE WHEN stddev_pop({k}) OVER () > 0 THEN stddev_pop({k}) OVER () ELSE 1 END), 6) AS {k}' for k in META)} FROM m",
    "confusion": f"WITH {RATED}, c AS (SELECT model, {COUNT4} FROM (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM rated) GROUP BY model) SELECT model, {METRICS} FROM c",
    "class_report": f"WITH {RATED}, c AS (SELECT model, {COUNT4} FROM (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM rated) GROUP BY model) SELECT model, 0 AS class, round({_P0}, 6) AS precision, round({_R0}, 6) AS recall, round({_F0}, 6) AS f1, tn + fp AS support FROM c UNION ALL SELECT model, 1, round({_P1}, 6), round({_R1}, 6), round({_F1}, 6), fn + tp FROM c",
    "roc_auc": f"WITH {RATED}, r AS (SELECT model, label, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2 AS rk FROM rated) SELECT model, round((sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) AS auc FROM r GROUP BY model",
    "threshold_sweep": f"WITH {RATED}, {SWEEP} SELECT * FROM swept",
    "best_threshold": f"WITH {RATED}, {SWEEP} SELECT model, threshold, macro_f1 FROM swept QUALIFY row_number() OVER (PARTITION BY model ORDER BY macro_f1 DESC, accuracy DESC, threshold) = 1",
    "flag_slice_metrics": f"WITH {RATED}, j AS (SELECT model, r.label, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred, {', '.join('n.' + f for f in L.FLAGS)} FROM rated r JOIN realtime_news n ON r.key = CAST(n.id AS VARCHAR)) " + " UNION ALL ".join(f"SELECT model, {q(f)} AS flag, count(*) AS n, round(avg(pred), 6) AS flagged_positive_rate, round(avg(pred) FILTER (WHERE label = 1), 6) AS flagged_recall FROM j WHERE {f} = 1 GROUP BY model" for f in L.FLAGS),
    "ensemble_vote": f"WITH {RATED}, {VOTE} SELECT * FROM vote",
    "ensemble_metrics": f"WITH {RATED}, {VOTE}, u AS (SELECT model, label, score FROM rated UNION ALL SELECT 'ensemble', label, score FROM vote), c AS (SELECT model, {COUNT4} FROM (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM u) GROUP BY model) SELECT model, {METRICS} FROM c",
    "scores_contract": f"WITH {RATED} SELECT count(*) AS n, list_sort(list(DISTINCT label)) = [0, 1] AS labels_ok, min(score) >= 0 AS score_ok FROM rated",
    "timeline_sort": r"""WITH k AS (SELECT id, coalesce(pub_time, '') AS t FROM realtime_news), m AS (SELECT id, t, CASE
 WHEN regexp_matches(t, '^오후\s*\d+:\d+') THEN (CASE WHEN CAST(regexp_extract(t, '^오후\s*(\d+):', 1) AS INTEGER) = 12 THEN 12 ELSE 12 + CAST(regexp_extract(t, '^오후\s*(\d+):', 1) AS INTEGER) END) * 60 + CAST(regexp_extract(t, '^오후\s*\d+:(\d+)', 1) AS INTEGER)
 WHEN regexp_matches(t, '^(?:오전\s*)?\d+:\d+') THEN CAST(regexp_extract(t, '^(?:오전\s*)?(\d+):', 1) AS INTEGER) * 60 + CAST(regexp_extract(t, '^(?:오전\s*)?\d+:(\d+)', 1) AS INTEGER) END AS mi FROM k)
SELECT id, row_number() OVER (ORDER BY CASE WHEN mi IS NULL THEN 0 ELSE 1 END DESC, coalesce(mi, CASE WHEN regexp_matches(t, '^\d{4}\.\d{2}\.\d{2}') THEN CAST(replace(substr(t, 1, 10), '.', '') AS INTEGER) END, 0) DESC, id) AS position FROM m""",
    "display_order": "SELECT id, row_number() OVER (ORDER BY CASE WHEN coalesce(fake_score, 0) < 50 THEN 0 ELSE 1 END, coalesce(fake_score, 0), id) AS position FROM realtime_news",
    "result_labels": f"WITH {VIEW} SELECT id, score_source, score, predicted_label, result_text FROM viewed",
    "view_page": PAGED("predicted_label = 1 AND causal_error = 1", "predicted_label, score, id", 2),
    "section_view": PAGED("category = '경제' AND predicted_label = 1", "score, id", 1),
    "view_counts": f"WITH {VIEW} SELECT count(*) AS total, count(*) FILTER (WHERE predicted_label = 0) AS real, count(*) FILTER (WHERE predicted_label = 1) AS fake, {', '.join(f'count(*) FILTER (WHERE predicted_label = 1 AND {f} = 1) AS {f}' for f in L.FLAGS)} FROM viewed",
    "status": "SELECT b AS batch_no, count(id) = 0 AS loading, count(id) AS total, count(*) FILTER (WHERE coalesce(body_ready, false)) AS body_ready FROM (SELECT unnest(list_append(list(DISTINCT batch_no), coalesce(max(batch_no), 0) + 1)) AS b FROM realtime_news WHERE batch_no IS NOT NULL) LEFT JOIN realtime_news ON b = batch_no GROUP BY b",
    "stale_sources": f"WITH m AS (SELECT trim(media) AS media, ingest_ts FROM realtime_news WHERE media IS NOT NULL) SELECT media FROM m GROUP BY media HAVING floor(epoch((SELECT max(ingest_ts) FROM m))) - floor(epoch(max(ingest_ts))) > {L.TTL_SECONDS}",
    "page_cutoff": "WITH f AS (SELECT batch_no, id FROM realtime_news QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1), p AS (SELECT b.batch_no AS page, (SELECT count(*) FROM f WHERE f.batch_no = b.batch_no) AS n_new FROM (SELECT DISTINCT batch_no FROM realtime_news) b), t AS (SELECT *, CASE WHEN n_new = 0 AND coalesce(lag(n_new) OVER (ORDER BY page), 1) = 0 THEN 1 ELSE 0 END AS tw FROM p) SELECT page, n_new FROM (SELECT *, coalesce(sum(tw) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM t) WHERE st = 0",
    "article_text": "SELECT id, md5(concat_ws(' ', nullif(title, ''), nullif(summary, ''), nullif(content, ''))) AS text_key, (length(coalesce(title, '')) + 1) * 5 + length(coalesce(content, '')) AS boosted_len FROM realtime_news",
    "enrich_bodies": "WITH b AS (SELECT url, max(content) AS body FROM realtime_news WHERE body_ready AND url IS NOT NULL GROUP BY url) SELECT id, md5(coalesce(nullif(body, ''), summary, '')) AS content_key, true AS body_ready FROM realtime_news LEFT JOIN b USING (url) WHERE NOT realtime_news.body_ready",
    "parse_date": f"SELECT id, {DATE.format(x='date')} AS date FROM articles",
    "verdict_extract": f"WITH t AS (SELECT url, coalesce('판정: ' || verdict || chr(10), '') || coalesce(content, '') AS x FROM factcheck_raw), s AS (SELECT url, x, trim(regexp_extract(x, {q(L.VERDICT_PATTERN)}, 1)) AS st FROM t), k AS (SELECT url, x, st, {VERDICT_LABEL.format(x='st')} AS l1, {VERDICT_KEY.format(x='x')} AS v2, {VERDICT_LABEL.format(x='x')} AS l2 FROM s) SELECT url, CASE WHEN st <> '' AND l1 IS NOT NULL THEN st ELSE coalesce(v2, '') END AS found_verdict, CASE WHEN st <> '' AND l1 IS NOT NULL THEN l1 ELSE coalesce(l2, -1) END AS found_label FROM k",
    "id_harvest": r"SELECT url, array_to_string(list_distinct(regexp_extract_all(coalesce(url, ''), 'ncd=(\d{7,8})', 1)), ',') AS ids FROM factcheck_raw",
    "date_extract": r"SELECT id, CASE WHEN regexp_extract(coalesce(pub_time, ''), '(\d{4}[.-]\d{2}[.-]\d{2})', 1) = '' THEN '2024-01-01' ELSE replace(regexp_extract(pub_time, '(\d{4}[.-]\d{2}[.-]\d{2})', 1), '.', '-') END AS day FROM realtime_news",
    "allowed_hosts": r"SELECT id FROM realtime_news WHERE regexp_matches(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z]+://([^/?#:]+)', 1)), '^(.*\.)?neoulmok\.example$')",
    "html_listing": "WITH k AS (SELECT id // 20 AS page, id, trim(title) AS title, trim(url) AS url, trim(coalesce(media, '')) AS m FROM realtime_news), r AS (SELECT *, trim(html_title) AS t FROM (SELECT *, title AS html_title FROM k)) SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY id) AS INTEGER) AS pos, t AS title, url, m AS press FROM r WHERE coalesce(t, '') <> '' AND coalesce(url, '') <> ''",
    "html_body": f"SELECT doc_id, md5(regexp_replace(coalesce(text, ''), {q(f'^{WS}|{WS}$')}, '', 'g')) AS body_key FROM documents",
    "html_links": "SELECT id, CASE WHEN trim(url) = 'https://list.example/a' THEN 'https://list.example/a' ELSE 'https://list.example/a ' || trim(url) END AS links FROM realtime_news WHERE url LIKE 'http%'",
    "csv_roundtrip": "SELECT id, md5(coalesce(content, '')) AS content_key, coalesce(CAST(label AS INTEGER), -1) AS label FROM articles",
    "embedding_blocks": "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, label, len(v) AS dims, round(list_sum(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS unit_sum FROM v",
    "stream_score_dedup": "SELECT DISTINCT url FROM realtime_news WHERE url IS NOT NULL",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "listing_dedup": """WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY id) AS rn, id, hash(coalesce(url, '')) AS u, hash(coalesce(title, '')) AS t FROM realtime_news),
walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST([] AS UBIGINT[]) AS us, CAST([] AS UBIGINT[]) AS ts UNION ALL
  SELECT o.rn, CASE WHEN list_contains(us, u) OR list_contains(ts, t) THEN NULL ELSE o.id END, CASE WHEN list_contains(us, u) OR list_contains(ts, t) THEN us ELSE list_append(us, u) END, CASE WHEN list_contains(us, u) OR list_contains(ts, t) THEN ts ELSE list_append(ts, t) END
  FROM walk JOIN o ON o.rn = walk.rn + 1) SELECT id FROM walk WHERE id IS NOT NULL""",
    "stream_model_scores": "SELECT id, true AS scored, true AS same FROM realtime_news",
    "top_signed_ratios": f"WITH {NGRAMS}, {tfidf_cte(2, 0.7, 'articles')}, {MASS}, t AS (SELECT sum(w1 + 1) AS sp, sum(w0 + 1) AS sq FROM mass), r AS (SELECT term, round(ln(((w1 + 1) / sp) / ((w0 + 1) / sq)), 6) AS ratio FROM mass, t) (SELECT 'positive' AS side, term, ratio FROM r WHERE ratio > 0 ORDER BY ratio DESC, term LIMIT 15) UNION ALL (SELECT 'negative', term, ratio FROM r WHERE ratio < 0 ORDER BY ratio, term LIMIT 15)",
    "threshold_summary": f"WITH {RATED}, {SWEEP}, b AS (SELECT * FROM swept QUALIFY row_number() OVER (PARTITION BY model ORDER BY macro_f1 DESC, accuracy DESC, threshold) = 1) SELECT b.model, o.threshold AS old_threshold, b.threshold AS new_threshold, o.macro_f1 AS old_f1, b.macro_f1 AS new_f1, round(b.macro_f1 - o.macro_f1, 6) AS f1_gain, o.fn AS old_missed, b.fn AS new_missed FROM b JOIN swept o ON o.model = b.model AND o.threshold = 0.5",
    "model_ranking": f"WITH {RATED}, c AS (SELECT model, {COUNT4} FROM (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS pred FROM rated) GROUP BY model), m AS (SELECT model, {METRICS} FROM c) SELECT CAST(row_number() OVER (ORDER BY macro_f1 DESC, model) AS INTEGER) AS place, model, macro_f1, weighted_f1 FROM m",
    "all_sources": f"""WITH u AS (SELECT 0 AS source_no, lpad(CAST(id AS VARCHAR), 12, '0') AS ord, title, content, media, date, label FROM articles
  UNION ALL SELECT DISTINCT 1, url, title, content, source, date, label FROM factcheck_raw UNION ALL SELECT 2, lpad(CAST(id AS VARCHAR), 12, '0'), title, content, media, date, label FROM realtime_news),
a AS (SELECT source_no, ord, label, {strip('title')} AS title, {strip('content')} AS content, CASE WHEN {strip('media')} = '' THEN 'Unknown' ELSE {strip('media')} END AS media, {DATE.format(x='date')} AS date FROM u)
SELECT source_no, media, date, coalesce(CAST(label AS INTEGER), -1) AS label, {HASH} AS text_key FROM a WHERE length(content) >= {L.MIN_CONTENT} QUALIFY row_number() OVER (PARTITION BY {HASH} ORDER BY source_no, ord) = 1""",
    "document_stream": f"SELECT id, md5(text) AS text_key FROM (SELECT id, array_to_string(list_filter({TOKENS('content')}, lambda w: w NOT IN ({IN(L.STOPWORDS)})), ' ') AS text FROM articles WHERE label = 1) WHERE text <> ''",
    "fake_samples": "SELECT url, title, md5(CASE WHEN coalesce(verdict, '') <> '' THEN '[' || verdict || '] ' ELSE '' END || substr(coalesce(content, ''), 1, 200)) AS summary_key FROM (SELECT DISTINCT source, url, title, content, verdict, label FROM factcheck_raw) WHERE label = 1 ORDER BY md5(coalesce(url, '') || '|' || coalesce(title, '') || '|' || coalesce(verdict, '') || '|' || coalesce(content, '') || '|42') LIMIT 60",
    "date_labels": f"""WITH p AS (SELECT id, label, try_cast({DATE.format(x='date')} AS DATE) AS day FROM articles)
SELECT id, strftime(day, '%m.%d') || '(' || ['월', '화', '수', '목', '금', '토', '일'][CAST(isodow(day) AS INTEGER)] || ')' AS label_text, 'id=' || id || coalesce('&label=' || CAST(label AS INTEGER), '') AS query FROM p""",
    "page_depth": "SELECT batch_no AS page, count(*) AS n FROM realtime_news WHERE batch_no <= 2 GROUP BY batch_no",
}
SQL["result_articles"] = f"""WITH f AS (SELECT min(id) AS id FROM realtime_news GROUP BY regexp_replace(coalesce(title, ''), {q(f'^{WS}|{WS}$')}, '', 'g')),
ts AS ({SQL['timeline_sort']}) SELECT id, CASE WHEN lower(image_url) <> 'nan' THEN image_url END AS image_url, fake_score, coalesce(CAST(causal_error AS INTEGER), 0) AS causal_error, row_number() OVER (ORDER BY ts.position) AS position FROM f JOIN realtime_news USING (id) JOIN ts USING (id)"""
