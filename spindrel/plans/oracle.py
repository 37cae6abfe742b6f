"""DuckDB SQL that gives the rows of the registered queries.

``PARTS`` are common table expressions; a query's text is the parts that it
names, directly or through others, and its own SELECT.
"""

from __future__ import annotations

import re

from ..functions.text import CAPITALS, COMMON, ENTITIES, TOKEN, WORD
from ..operators.features import TERM
from ..operators.mentions import LEADING
from . import demo


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _fix(x: str) -> str:
    for a, b in ENTITIES:
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
    return x


def _all(x: str, pattern: str) -> str:
    pattern = pattern.replace("\t", "\\t").replace("\n", "\\n").replace("\f", "\\f").replace("\r", "\\r")
    return f"regexp_extract_all({x}, {_quoted(pattern)})"


_BLANKS = r"[ \t\n\f\r]+"
_TRIM = lambda x: f"regexp_replace({x}, '^{_BLANKS}|{_BLANKS}$', '', 'g')"
_STRIP = lambda x: "CASE " + " ".join(f"WHEN contains({x}, {_quoted(s)}) THEN {_TRIM(f'replace({x}, {_quoted(s)}, {_quoted("")})')}" for s in COMMON) + f" ELSE {x} END"
_NORM = lambda x: _all(f"lower({_fix(x)})", WORD)
_RANK = lambda kind: "r BETWEEN {} AND {}".format(*demo.RANKS[kind])


def _leading(x: str) -> str:
    for w in LEADING:
        x = f"(SELECT CASE WHEN starts_with(v, '{w}') THEN ltrim(v, '{w}') ELSE v END FROM (SELECT {x} AS v))"
    return x


def _top(pattern: str, n: int) -> str:
    return f"""
        SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM (
            SELECT w, count(*) AS n FROM (
                SELECT doc_id, unnest(list_distinct({_all("text", pattern)})) AS w FROM documents)
            GROUP BY w HAVING count(*) >= 2)
        ORDER BY n DESC, w LIMIT {n}"""


PARTS = {
    "stories": """
        SELECT doc_id AS story_id, split_part(t, chr(10), 1) AS headline,
               CASE WHEN contains(t, chr(10)) THEN substr(t, length(split_part(t, chr(10), 1)) + 2) ELSE '' END AS body, source
        FROM (SELECT doc_id, coalesce(text, '') AS t, source FROM documents)""",
    "ranked": _top(demo.WORD, demo.RANKS["city"][1]),
    "phrases": _top(demo.PHRASE, demo.PHRASES),
    "companies": f"""
        SELECT i AS id, n AS name, p.w AS domicile, i AS ord FROM (
            SELECT r AS i, CASE r % 4 WHEN 0 THEN w WHEN 1 THEN w || ' Inc' WHEN 2 THEN w || ' Holdings' ELSE w || ' & Co' END AS n
            FROM ranked WHERE {_RANK("company")}
            UNION ALL SELECT 1000 + r, w FROM phrases) c
        LEFT JOIN ranked p ON p.r = {demo.RANKS["name"][0]} + c.i % 25 AND p.{_RANK("name")}""",
    "company": f"SELECT *, {_STRIP('name')} AS stripped, list_aggregate(list_transform({_NORM('name')}, lambda x: upper(substr(x, 1, 1))), 'string_agg', '') AS ini FROM companies",
    "surface_forms": f"SELECT (r - 300) * 4 AS id, w AS form FROM ranked WHERE {_RANK('surface')}",
    "ticker_list": f"SELECT (r - 360) * 7 AS id, w AS ticker FROM ranked WHERE {_RANK('ticker')}",
    "gazetteer": f"""
        SELECT 'name' AS kind, lower(w) AS key, 'C' || (r - {demo.RANKS["name"][0]}) AS code FROM ranked WHERE {_RANK("name")}
        UNION ALL SELECT 'city', lower(w), 'C' || (r - {demo.RANKS["city"][0]}) FROM ranked WHERE {_RANK("city")}""",
    "blacklist": f"SELECT lower(w) AS black FROM ranked WHERE r IN {demo.BLACK}",
    "story_tags": f"""
        SELECT d.doc_id AS story_id, r AS coid, CASE WHEN toxic = 0 THEN 'H' ELSE 'L' END AS relevance
        FROM (SELECT doc_id, unnest(list_distinct({_all("text", demo.WORD)})) AS w FROM documents) d
        JOIN labels USING (doc_id) JOIN ranked USING (w) WHERE quality = 1 AND {_RANK("company")}""",
    "pars": """
        SELECT story_id, len(p) AS par_count, i - 1 AS par_idx, p[i] AS paragraph
        FROM (SELECT story_id, p, unnest(range(1, len(p) + 1)) AS i
              FROM (SELECT story_id, list_concat([headline], string_split(body, chr(10))) AS p FROM stories))""",
    "sents": rf"""
        SELECT story_id, par_idx, par_count, len(s) AS sent_count, i - 1 AS sent_idx, s[i] AS sentence
        FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (
            SELECT *, list_filter(string_split(regexp_replace(paragraph, '([.!?]){_BLANKS}', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s
            FROM pars))""",
    "black_pars": "SELECT story_id, par_idx, paragraph FROM pars WHERE " + " OR ".join(f"starts_with(paragraph, {_quoted(p)})" for p in demo.DISCLAIMERS),
    "sent_tokens": f"""
        SELECT story_id, par_idx, sent_idx, CASE WHEN par_count > 1 THEN par_idx / (par_count - 1) ELSE par_idx END AS paragraph,
               CASE WHEN sent_count > 1 THEN sent_idx / (sent_count - 1) ELSE sent_idx END AS sentence, {_all("sentence", TOKEN)} AS t
        FROM sents""",
    "clean_tokens": "SELECT * FROM sent_tokens ANTI JOIN black_pars USING (story_id, par_idx)",
    "name_token": f"SELECT ord, i - 1 AS pos, t[i] AS token FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM (SELECT ord, {_all('name', TOKEN)} AS t FROM company))",
    "token_freq": "SELECT token, n / max(n) OVER () AS freq FROM (SELECT token, count(*) AS n FROM name_token GROUP BY token)",
    "whitelist": """
        SELECT DISTINCT token, prev, next FROM (
            SELECT token, lag(token, 1, 'NONE') OVER w AS prev, lead(token, 1, 'NONE') OVER w AS next FROM name_token
            WINDOW w AS (ORDER BY ord, pos))
        WHERE NOT regexp_matches(token, '^\\p{Lu}')""".replace("\\\\", "\\"),
    "full_names": "SELECT lower(name) AS key, arg_max(id, ord) AS id FROM company GROUP BY 1",
    "stripped_names": "SELECT lower(stripped) AS key, arg_max(id, ord) AS id FROM company GROUP BY 1",
    "inis": "SELECT ini AS key, arg_max(id, ord) AS id FROM company GROUP BY 1",
    "surface": "SELECT form, id FROM surface_forms UNION SELECT stripped, id FROM company UNION SELECT ini, id FROM company",
    "tickers": "SELECT DISTINCT ticker, id FROM ticker_list",
    "name_index": f"SELECT DISTINCT unnest({_all('name', WORD)}) AS token, id AS coid FROM company",
    "form_index": f"SELECT DISTINCT unnest({_all(_fix('form'), WORD)}) AS token, id AS coid FROM surface",
    "token_coid": "SELECT token, coid FROM name_index UNION SELECT key, id FROM inis UNION SELECT token, coid FROM form_index UNION SELECT ticker, id FROM tickers",
    "ltoken": """
        SELECT DISTINCT lower(t) AS ltok FROM (
            SELECT token AS t FROM token_freq UNION SELECT key FROM inis UNION SELECT token FROM form_index UNION SELECT ticker FROM tickers)""",
    "plain_ltoken": "SELECT DISTINCT lower(t) AS ltok FROM (SELECT token AS t FROM token_freq UNION SELECT key FROM inis)",
    "ltoken_coid": "SELECT DISTINCT lower(token) AS ltok, coid FROM token_coid",
    "each": """
        SELECT story_id, par_idx, sent_idx, paragraph, sentence, len(t) AS len, i - 1 AS i, t[i] AS token,
               CASE WHEN i > 2 THEN t[i - 2] ELSE 'NONE' END AS prev2, CASE WHEN i > 1 THEN t[i - 1] ELSE 'NONE' END AS prev,
               coalesce(t[i + 1], 'NONE') AS next, coalesce(t[i + 2], 'NONE') AS next2
        FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM clean_tokens)""",
}


def _mentions(ltoken: str) -> str:
    return rf"""
        SELECT * FROM (
            SELECT {_leading("raw")} AS text, * EXCLUDE (raw, len),
                   CASE WHEN len > token_cnt THEN tok_idx / (len - token_cnt) ELSE tok_idx END AS pos_in_sentence
            FROM (
                SELECT story_id, par_idx, sent_idx, min(i) AS tok_idx, count(*) AS token_cnt, string_agg(token, ' ' ORDER BY i) AS raw,
                       arg_min(prev2, i) AS previous_word2, arg_min(prev, i) AS previous_word, arg_max(next, i) AS next_word,
                       arg_max(next2, i) AS next_word2, any_value(paragraph) AS paragraph, any_value(sentence) AS sentence, any_value(len) AS len
                FROM (
                    SELECT e.*, e.i - row_number() OVER (PARTITION BY story_id, par_idx, sent_idx ORDER BY e.i) AS run
                    FROM each e SEMI JOIN {ltoken} l ON lower(e.token) = l.ltok
                    LEFT JOIN whitelist w ON w.token = e.token AND w.prev = e.prev AND w.next = e.next
                    WHERE regexp_matches(e.token, '^\p{{Lu}}') OR w.token IS NOT NULL)
                GROUP BY story_id, par_idx, sent_idx, run))
        ANTI JOIN blacklist ON lower(text) = black"""


_DOUBLED = "body || body"
_KEYS = "story_id, par_idx, sent_idx, tok_idx, candidate"
PARTS |= {
    "ments": _mentions("ltoken"),
    "plain_ments": _mentions("plain_ltoken"),
    "texts": "SELECT DISTINCT text FROM ments",
    "r_exact": "SELECT text, id AS coid, 10.0::DOUBLE AS weight FROM texts JOIN full_names ON key = lower(text)",
    "r_stripped": "SELECT text, id AS coid, 2.0::DOUBLE AS weight FROM texts JOIN stripped_names ON key = lower(text)",
    "r_surface": "SELECT text, id AS coid, 1.0::DOUBLE AS weight FROM texts JOIN surface ON form = text",
    "r_initials": "SELECT text, id AS coid, 1.0::DOUBLE AS weight FROM texts JOIN inis ON key = text",
    "r_ticker": "SELECT text, id AS coid, 1.0::DOUBLE AS weight FROM texts JOIN tickers ON ticker = text",
    "r_token": f"""
        SELECT text, coid, weight FROM (
            SELECT *, row_number() OVER (PARTITION BY text ORDER BY weight DESC, coid) AS k, max(weight) OVER (PARTITION BY text) AS most
            FROM (SELECT text, coid, round(sum(w), 9) AS weight
                  FROM (SELECT text, unnest({_all("lower(text)", WORD)}) AS word FROM texts)
                  JOIN (SELECT ltok, coid, 1 / count(*) OVER (PARTITION BY ltok) AS w FROM ltoken_coid) ON word = ltok
                  GROUP BY text, coid))
        WHERE k <= 3 AND weight > 0.80::DOUBLE * most""",
    "casc": "SELECT text, coid, weight, route FROM (SELECT *, min(prio) OVER (PARTITION BY text) AS first FROM ("
    + " UNION ALL ".join(f"SELECT *, '{n}' AS route, {i} AS prio FROM r_{n}" for i, n in enumerate(("exact", "stripped", "surface", "initials", "ticker", "token")))
    + ")) WHERE prio = first",
    "cands": """
        SELECT m.*, c.coid AS candidate, c.weight AS candidate_weight, k.name AS candidate_name, k.domicile, k.stripped
        FROM ments m JOIN casc c USING (text) JOIN company k ON k.id = c.coid""",
    "story_freq": f"""
        SELECT token, n / max(n) OVER () AS freq FROM (
            SELECT lower(token) AS token, count(*) AS n FROM (SELECT unnest({_all("body", TOKEN)}) AS token FROM stories) GROUP BY 1)""",
    "country": f"""
        SELECT story_id, code, n / sum(n) OVER (PARTITION BY story_id) AS share FROM (
            SELECT story_id, coalesce(a.code, b.code) AS code, count(*) AS n
            FROM (SELECT story_id, lower(unnest({_all(_DOUBLED, CAPITALS)})) AS p FROM stories)
            LEFT JOIN gazetteer a ON a.kind = 'name' AND a.key = p LEFT JOIN gazetteer b ON b.kind = 'city' AND b.key = p
            WHERE coalesce(a.code, b.code) IS NOT NULL GROUP BY 1, 2)""",
}
PARTS["rel"] = "SELECT c.*, coalesce(t.relevance, 'NO') AS relevance FROM cands c LEFT JOIN story_tags t ON t.story_id = c.story_id AND t.coid = c.candidate"

_FIELDS = (
    "text, previous_word2, previous_word, next_word, next_word2, round(pos_in_sentence, 9) AS pos_in_sentence, round(paragraph, 9) AS paragraph, "
    "round(sentence, 9) AS sentence, token_cnt, story_id, par_idx, sent_idx, tok_idx"
)
_SCORED = f"""(
    SELECT text, avg(coalesce(k.freq, 0) / coalesce(d.freq, 1)) AS score
    FROM (SELECT text, unnest({_NORM("text")}) AS token FROM texts) w
    LEFT JOIN token_freq k USING (token) LEFT JOIN story_freq d USING (token) GROUP BY text)"""
_plain = lambda x: f"coalesce(nullif(trim(regexp_replace({x}, '[^A-Za-z0-9,. ]', '', 'g')), ''), 'None')"
_shown = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _vector(texts: str) -> str:
    terms = lambda x: _all(f"lower({x})", TERM)
    return f"""(
        SELECT x, term, v / sqrt(sum(v * v) OVER (PARTITION BY x)) AS w FROM (
            SELECT x, term, count(*) * any_value(idf) AS v FROM (SELECT x, unnest({terms("x")}) AS term FROM ({texts}))
            JOIN (SELECT term, ln((1 + (SELECT count(*) FROM company)) / (1 + count(*))) + 1 AS idf
                  FROM (SELECT unnest(list_distinct({terms("name")})) AS term FROM company) GROUP BY term) USING (term)
            GROUP BY x, term))"""


_NEXT, _PREV = "next_word || next_word2", "previous_word || previous_word2"
_NUMBERS = "regexp_extract_all(body, '[0-9]+[.|,][0-9]+')"

FINAL = {
    "doc_paragraphs": "SELECT story_id, par_count, par_idx, paragraph FROM pars",
    "doc_sentences": "SELECT story_id, par_idx, par_count, sent_count, sent_idx, sentence FROM sents",
    "disclaimer_paragraphs": "SELECT story_id, par_idx, paragraph FROM black_pars",
    "normalized_tokens": f"SELECT story_id, array_to_string({_NORM('body')}, ' ') AS tokens FROM stories",
    "token_windows": """
        SELECT ord AS id, pos, concat_ws('|', lag(token, 2, 'NONE') OVER w, lag(token, 1, 'NONE') OVER w, token,
               lead(token, 1, 'NONE') OVER w, lead(token, 2, 'NONE') OVER w) AS around
        FROM name_token WINDOW w AS (PARTITION BY ord ORDER BY pos)""",
    "token_freqs": "SELECT token, round(freq, 9) AS freq FROM story_freq",
    "token_frequencies": """
        SELECT token, sum(n)::BIGINT AS freq FROM (
            SELECT token, count(*) AS n FROM (SELECT unnest(t) AS token FROM sent_tokens) GROUP BY token
            UNION ALL SELECT unnest(['SENTENCE_START', 'SENTENCE_END']), n FROM (SELECT count(*) AS n FROM sent_tokens))
        GROUP BY token""",
    "fixed_text": f"SELECT page_id, {_fix('html')} AS fixed FROM pages",
    "strip_common": "SELECT id, stripped FROM company",
    "initials": "SELECT id, ini AS initials FROM company",
    "kb_name_tokens": "SELECT ord, pos, token FROM name_token",
    "kb_token_freq": "SELECT token, round(freq, 9) AS freq FROM token_freq",
    "kb_token_coid": "SELECT token, coid FROM token_coid",
    "kb_whitelist": "SELECT token, prev, next FROM whitelist",
    "kb_full_names": "SELECT key, id FROM full_names",
    "kb_stripped": "SELECT key, id FROM stripped_names",
    "kb_initials": "SELECT key, id FROM inis",
    "kb_surface_forms": "SELECT form, id FROM surface",
    "kb_surface_inverted": "SELECT form, array_to_string(list_sort(list(DISTINCT id)), ' ') AS keys FROM surface GROUP BY form",
    "kb_vocabulary": "SELECT ltok FROM ltoken",
    "kb_ltoken_coid": "SELECT ltok, coid FROM ltoken_coid",
    "mentions": f"SELECT {_FIELDS} FROM ments",
    "mention_counts": """
        SELECT story_id, par_idx, sent_idx, tok_idx, text, round(n / sum(n) OVER (PARTITION BY story_id), 9) AS mention_count
        FROM (SELECT *, count(*) OVER (PARTITION BY story_id, text) AS n FROM ments)""",
    "mention_labels": "SELECT story_id, par_idx, sent_idx, tok_idx, concat_ws('|', previous_word2, previous_word, text, next_word, next_word2) AS label FROM ments",
    "unique_mentions_per_word": "SELECT previous_word AS word, count(DISTINCT text) AS n_mentions FROM ments GROUP BY 1",
    **{f"candidates_{n}": f"SELECT text, coid, weight FROM r_{n}" for n in ("exact", "stripped", "surface", "ticker", "token")},
    "candidates_initials": "SELECT text, id AS coid, 1.0::DOUBLE AS weight FROM (SELECT DISTINCT text FROM plain_ments) JOIN inis ON key = text",
    "candidates_cascade": "SELECT text, coid, weight, route FROM casc",
    "candidates_all": f"SELECT {_KEYS}, text, candidate_weight, candidate_name FROM cands",
    "candidates_by_name_token": f"""
        SELECT DISTINCT text, coid, token FROM (SELECT text, unnest({_NORM("text")}) AS token FROM texts) JOIN token_coid USING (token)""",
    "relevance_labels": f"SELECT {_KEYS}, relevance FROM rel",
    "is_tagged_candidate": f"SELECT {_KEYS}, relevance <> 'NO' AS is_tagged FROM rel",
    "is_tagged_mention": """
        SELECT story_id, par_idx, sent_idx, tok_idx, text, EXISTS (
            SELECT 1 FROM casc c JOIN story_tags t ON t.coid = c.coid WHERE c.text = m.text AND t.story_id = m.story_id) AS is_tagged
        FROM ments m""",
    "mention_features": f"""
        SELECT {_FIELDS}, upper(text) IN (SELECT ticker FROM tickers) AS mention_is_ticker, token_cnt = 1 AS mention_is_one_word,
               length(text) AS mention_character_length, regexp_matches({_PREV}, '^©[ \\t\\n\\f\\r]?[1|2][0-9]{{3}}') AS mention_follows_copyright,
               previous_word = 'About' AS mention_prev_is_about, previous_word2 = 'SYMBOL' AS "mention_prev2_is_SYMBOL",
               previous_word2 = 'ISSUER' AS "mention_prev2_is_ISSUER", paragraph = 0 AND contains({_NEXT}, '8-K') AS "mention_followed_by_8K",
               contains({_NEXT}, 'logo') AS mention_followed_by_logo, {_NEXT} = 'orthe' AS mention_followed_by_orthe,
               round(score, 9) AS mention_token_score, text IN (SELECT name FROM company) AS mention_is_exact_match,
               lower(text) IN (SELECT key FROM full_names) AS mention_is_lowercase_match, text IN (SELECT form FROM surface) AS mention_is_surface_form,
               {_NORM("text")} IN (SELECT {_NORM("name")} FROM company) AS mention_is_token_match,
               round(n / sum(n) OVER (PARTITION BY story_id), 9) AS mention_count
        FROM (SELECT *, count(*) OVER (PARTITION BY story_id, text) AS n FROM ments) LEFT JOIN {_SCORED} USING (text)""",
    "doc_features": f"""
        SELECT story_id, len({_all("lower(headline || body)", WORD)}) AS doc_token_cnt, length(body) AS doc_character_length,
               len({_NUMBERS}) AS doc_number_count,
               round(len({_NUMBERS}) / nullif(len({_all("lower(headline || body)", WORD)}), 0), 9) AS doc_number_ratio,
               contains(body, 'Form 4') AS doc_contains_form4,
               CASE WHEN starts_with(headline, 'DJ') AND NOT contains(body, 'Form 4') AND NOT contains(headline, '8-K') THEN 0 ELSE 1 END::BIGINT AS "doc_DJ_headline",
               source AS doc_source
        FROM stories""",
    "mention_doc_features": f"""
        SELECT story_id, par_idx, sent_idx, tok_idx, len({_all("lower(headline || body)", WORD)}) AS doc_token_cnt, length(body) AS doc_character_length,
               len({_NUMBERS}) AS doc_number_count,
               round(len({_NUMBERS}) / nullif(len({_all("lower(headline || body)", WORD)}), 0), 9) AS doc_number_ratio,
               contains(body, 'Form 4') AS doc_contains_form4,
               CASE WHEN starts_with(headline, 'DJ') AND NOT contains(body, 'Form 4') AND NOT contains(headline, '8-K') THEN 0 ELSE 1 END::BIGINT AS "doc_DJ_headline",
               source AS doc_source, coalesce(c, '') AS doc_countries
        FROM ments JOIN stories USING (story_id) LEFT JOIN (
            SELECT story_id, string_agg(code || ':' || round(share * 1e9)::BIGINT, ' ' ORDER BY code) AS c FROM country GROUP BY story_id) USING (story_id)""",
    "mention_json": """
        SELECT story_id, par_idx, sent_idx, tok_idx, text || ' {"mention_character_length":' || length(text)
               || ',"mention_is_one_word":' || (token_cnt = 1) || ',"token_cnt":' || token_cnt || '}' AS shown FROM ments""",
    "mention_html": f"""
        SELECT story_id, par_idx, sent_idx, tok_idx,
               '<table><tr><th>text</th><th>previous_word</th><th>next_word</th><th>token_cnt</th></tr><tr><td>'
               || {_shown("text")} || '</td><td>' || {_shown("previous_word")} || '</td><td>' || {_shown("next_word")} || '</td><td>' || token_cnt
               || '</td></tr></table>' AS shown FROM ments""",
    "doc_countries": "SELECT story_id, code, round(share, 9) AS share FROM country",
    "mc_features": f"""
        SELECT {_KEYS}, round(CASE WHEN domicile IS NULL THEN NULL ELSE coalesce(share, 0) END, 9) AS mc_country,
               round(jaro_similarity(lower(text), lower(candidate_name)), 9) AS mc_jaro_distance,
               lower(text) = lower(candidate_name) AS mc_is_exact_match, jaro_winkler_similarity(text, stripped) > 0.95 AS mc_is_close_match,
               round(n / max(n) OVER (PARTITION BY story_id), 9) AS mc_count
        FROM (SELECT *, count(*) OVER (PARTITION BY story_id, candidate) AS n FROM cands)
        LEFT JOIN gazetteer g ON g.kind = 'name' AND g.key = lower(domicile) LEFT JOIN country USING (story_id, code)""",
    "mc_features_only": f"""
        SELECT story_id, text, candidate, round(CASE WHEN domicile IS NULL THEN NULL ELSE coalesce(share, 0) END, 9) AS mc_country,
               round(jaro_similarity(lower(text), lower(candidate_name)), 9) AS mc_jaro_distance,
               lower(text) = lower(candidate_name) AS mc_is_exact_match, jaro_winkler_similarity(text, stripped) > 0.95 AS mc_is_close_match,
               round(n / max(n) OVER (PARTITION BY story_id), 9) AS mc_count
        FROM (SELECT *, count(*) OVER (PARTITION BY story_id, candidate) AS n FROM cands)
        LEFT JOIN gazetteer g ON g.kind = 'name' AND g.key = lower(domicile) LEFT JOIN country USING (story_id, code)""",
    "mc_tfidf": f"""
        SELECT {_KEYS}, round(w, 9) AS mc_tfidf, round(CASE WHEN s <> 0 THEN w / s ELSE 0 END, 9) AS mc_tfidf_share
        FROM (SELECT *, sum(w) OVER (PARTITION BY story_id, text) AS s FROM (
            SELECT c.*, coalesce(d.w, 0) AS w FROM cands c LEFT JOIN (
                SELECT p.text, p.candidate_name, sum(a.w * b.w) AS w
                FROM (SELECT DISTINCT text, candidate_name FROM cands) p
                JOIN {_vector("SELECT text AS x FROM texts")} a ON a.x = p.text
                JOIN {_vector("SELECT DISTINCT name AS x FROM company")} b ON b.x = p.candidate_name AND a.term = b.term
                GROUP BY 1, 2) d ON d.text = c.text AND d.candidate_name = c.candidate_name))""",
    "mc_optional_features": f"""
        SELECT {_KEYS}, round(len(list_intersect({_NORM("text")}, {_NORM("candidate_name")})) / nullif(len(list_distinct({_NORM("candidate_name")})), 0), 9) AS mc_common_tokens,
               round(jaro_winkler_similarity(text, candidate_name), 9) AS mc_jaro_winkler, levenshtein(text, candidate_name) AS mc_levenshtein_distance,
               EXISTS (SELECT 1 FROM surface s WHERE s.form = text AND s.id = candidate) AS mc_is_surfaceform
        FROM cands""",
    "tag_freqs": f"""
        SELECT {_KEYS}, coalesce(n, 0) AS tagged_cnt FROM cands LEFT JOIN (
            SELECT coid, count(*) AS n FROM story_tags SEMI JOIN (SELECT story_id FROM stories ORDER BY story_id LIMIT 100) USING (story_id) GROUP BY coid) ON coid = candidate""",
    "class_weights": f"""
        SELECT {_KEYS}, relevance, (relevance = 'H')::BIGINT AS "is_H", (relevance = 'L')::BIGINT AS "is_L", (relevance = 'NO')::BIGINT AS "is_NO",
               round(min(n) OVER () / n, 9) AS sample_weight
        FROM (SELECT *, count(*) OVER (PARTITION BY relevance) AS n FROM rel)""",
    "numerized": f"SELECT {_KEYS}, "
    + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END, 9) AS {c}"
        for c in ("token_cnt", "pos_in_sentence", "paragraph", "sentence", "candidate_weight")
    )
    + " FROM cands",
    "f1_by_story": """
        SELECT story_id, round(CASE WHEN len(list_intersect(p, t)) > 0 THEN 2 * len(list_intersect(p, t)) / (len(p) + len(t)) ELSE 0 END, 9) AS f1
        FROM (SELECT story_id, coalesce(p, []) AS p, coalesce(t, []) AS t
              FROM (SELECT story_id, list(DISTINCT candidate) AS p FROM cands GROUP BY 1)
              FULL JOIN (SELECT story_id, list(DISTINCT coid) AS t FROM story_tags GROUP BY 1) USING (story_id))""",
    "f1_of_corpus": """
        SELECT n_predicted, n_true, n_both, round(n_both / n_predicted, 9) AS precision, round(n_both / n_true, 9) AS recall,
               round(2 * n_both / (n_predicted + n_true), 9) AS f1
        FROM (SELECT count(p.coid) AS n_predicted, count(t.coid) AS n_true, count(CASE WHEN p.coid IS NOT NULL AND t.coid IS NOT NULL THEN 1 END) AS n_both
              FROM (SELECT DISTINCT story_id, candidate AS coid FROM cands) p
              FULL JOIN (SELECT DISTINCT story_id, coid FROM story_tags) t ON p.story_id = t.story_id AND p.coid = t.coid)""",
    "normalized_scores": """
        SELECT story_id, candidate, round(w / max(w) OVER (PARTITION BY story_id), 9) AS score
        FROM (SELECT story_id, candidate, sum(candidate_weight) AS w FROM cands GROUP BY 1, 2)""",
    "train_data": """
        SELECT story_id, par_idx, sent_idx, tok_idx, text, EXISTS (
            SELECT 1 FROM casc c JOIN story_tags t ON t.coid = c.coid WHERE c.text = m.text AND t.story_id = m.story_id) AS y
        FROM ments m""",
    "stories_xml": f"""
        SELECT story_id, '2012-01-02' AS date, {_plain("headline")} AS headline, {_plain("body")} AS text, source, coalesce(tags, '') AS tags
        FROM stories LEFT JOIN (
            SELECT story_id, array_to_string(list_transform(list_sort(list(DISTINCT (coid, relevance))), lambda x: x[1] || ':' || x[2]), ' ') AS tags
            FROM story_tags GROUP BY story_id) USING (story_id)""",
    "companies_xml": "SELECT id, name, domicile FROM company",
    "list_lines": "SELECT name AS line FROM company",
    "surface_forms_json": "SELECT id, form FROM surface_forms",
    "tickers_parquet": "SELECT id, ticker FROM ticker_list",
    "gazetteer_parquet": "SELECT kind, key, code FROM gazetteer",
    "xml_roundtrip": "SELECT t.story_id, t.coid, name AS company, 'H' AS relevance FROM story_tags t JOIN company ON id = t.coid",
}


def _named(sql: str) -> list[str]:
    words = set(re.findall(r"\w+", sql))
    return [p for p in PARTS if p in words]


def _with(sql: str) -> str:
    order: list[str] = []

    def add(text: str, above: tuple[str, ...]) -> None:
        for p in _named(text):
            if p not in order and p not in above:
                add(PARTS[p], (*above, p))
                order.append(p)

    add(sql, ())
    parts = ",\n".join(f"{p} AS MATERIALIZED ({PARTS[p]})" for p in order)
    return f"WITH {parts}\n{sql}" if parts else sql


ORACLE = {name: _with(sql) for name, sql in FINAL.items()}
