"""The same results in SQL, written independently of the Spark code.

Folds are list reductions, scores are taken over exploded cells, cleaned text comes
from regular expressions. The derivations of the input views are repeated in SQL.
"""

from __future__ import annotations

import json

from leafmill import fixed_values as fv
from leafmill.plans import views

ORACLE: dict[str, str] = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(*items) -> str:
    return ", ".join(q(i) for i in items)


def at(index: str, *items) -> str:
    """The item of a literal list at a zero-based index."""
    shown = ", ".join("NULL" if i is None else q(i) if isinstance(i, str) else str(i).lower() for i in items)
    return f"([{shown}])[({index})::BIGINT + 1]"


def contains_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SCORE = "least(floor(value * 2 + 0.5), 1000)::DOUBLE / 1000.0::DOUBLE"
DOMAIN = "'d' || (user_id % 50) || '.example.org'"
URL_DOMAIN = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"


def r3(x: str) -> str:
    """Three decimals, correctly rounded from the exact value of the double."""
    return f"printf('%.3f', ({x})::DOUBLE)::DOUBLE"


# --- sources and sinks ---------------------------------------------------------
ORACLE["page_scan"] = "SELECT page_id, url, length(html)::BIGINT AS html_chars FROM pages"

_catalog = " UNION ALL ".join(
    f"SELECT {q(k)} AS schema_key, {q(','.join(f))} AS fields, {q('_'.join(sorted(f)[:4]))} AS schema_name"
    for k, f in fv.SCHEMAS.items()
)
ORACLE["schema_lookup"] = f"""
WITH c AS ({_catalog}),
asked AS (SELECT page_id, upper(replace(replace({at("page_id % 6", "articles", "Real-Estate agents", "job listings", "LINKS", "nothing", "real_estate-AGENTS")}, '-', '_'), ' ', '_')) AS schema_key FROM pages)
SELECT page_id, asked.schema_key, coalesce(fields, '') AS fields, coalesce(schema_name, '') AS schema_name
FROM asked LEFT JOIN c USING (schema_key)"""

_rows = [(k, i, f, d, None, False, None, None) for k, s in fv.SCHEMAS.items() for i, (f, d) in enumerate(s.items())]
_rows += [
    ("TYPED_ROWS", 0, "name", "What it is called", None, False, None, None),
    ("TYPED_ROWS", 1, "price", "What it costs", "number", True, 0.0, 99.5),
    ("TYPED_ROWS", 2, "seen", "", "date", False, None, None),
    ("TYPED_ROWS", 3, "stock", "Pieces left", "integer", False, 1.0, None),
]
_sql = lambda v: "NULL" if v is None else q(v) if isinstance(v, str) else str(v)
_rows = ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in _rows)
ORACLE["schema_catalog_fields"] = f"""
SELECT page_id, schema_key, ordinal::INTEGER AS ordinal, field, description, spec_type, required::BOOLEAN AS required,
  min_val::DOUBLE AS min_val, max_val::DOUBLE AS max_val
FROM (SELECT page_id, {at("page_id % 4", "LINKS", "TYPED_ROWS", "REAL_ESTATE_AGENTS", "NOTHING")} AS schema_key FROM pages)
JOIN (VALUES {_rows}) AS c(schema_key, ordinal, field, description, spec_type, required, min_val, max_val) USING (schema_key)"""

ORACLE["custom_schema_fields"] = """
WITH l AS (SELECT p_partkey, CASE WHEN p_size = 1 THEN ' , '
  ELSE ' , ' || replace(p_name, ' ', ' ,') || ', ,' || lower(p_type) END AS names FROM part),
f AS (SELECT DISTINCT p_partkey, trim(unnest(string_split(names, ','))) AS field FROM l),
g AS (SELECT * FROM f WHERE field <> '')
SELECT l.p_partkey, field, 'The ' || field || ' value' AS description
FROM l LEFT JOIN g ON l.p_partkey = g.p_partkey"""

RECORDS = """recs AS (
SELECT p_partkey AS k,
  CASE WHEN p_partkey % 50 = 0 THEN p_partkey + 1000000000 ELSE p_partkey // 4 END AS small,
  regexp_extract(p_brand, '([0-9]+)', 1)::BIGINT AS brand,
  CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN 'Placeholder item'
       WHEN p_partkey % 13 = 0 THEN ' TITLE ' ELSE p_name END AS title,
  CASE WHEN p_partkey % 9 = 0 THEN 'call us' WHEN p_partkey % 10 = 0 THEN 'now - 5.00'
       ELSE '$' || floor(p_retailprice)::BIGINT END AS price,
  CASE WHEN p_partkey % 17 = 0 THEN 'n/a' WHEN p_partkey % 21 = 0 THEN '-' ELSE p_size::VARCHAR END AS rating,
  CASE WHEN p_partkey % 8 = 0 THEN '/p/' || p_partkey WHEN p_partkey % 23 = 0 THEN 'N/A'
       ELSE 'https://shop.example.com/p/' || (p_partkey // 2) END AS url,
  CASE WHEN p_partkey % 6 = 0 THEN 'not an email' ELSE 'sales@' || lower(p_type) || '.example' END AS contact_email,
  (['2024-01-15', 'soon', '12/31/99', '20240115', '1850-02-30'])[p_partkey % 5 + 1] AS updated,
  CASE WHEN p_partkey % 12 = 0 THEN '-3 rooms' ELSE (p_size % 5)::VARCHAR END AS rooms,
  p_partkey % 29 = 0 AS no_title, p_partkey % 19 = 0 AS no_rating
FROM part)"""

ORACLE["csv_field_order"] = f"""
WITH {RECORDS}, seen AS (
  SELECT -small AS page_id, k AS rec_ord, unnest(['title', 'price', 'rating', 'url', 'contact_email', 'updated', 'rooms']) AS field, no_title, no_rating FROM recs),
ok AS (SELECT * FROM seen WHERE NOT (field = 'title' AND no_title) AND NOT (field = 'rating' AND no_rating))
SELECT field, page_id, rec_ord FROM (
  SELECT *, row_number() OVER (PARTITION BY field ORDER BY page_id, rec_ord) AS rn FROM ok) WHERE rn = 1"""

ORACLE["csv_sink"] = f"""
WITH {RECORDS}
SELECT updated, count(*) AS records, count(CASE WHEN no_title THEN NULL ELSE title END) AS titles,
  count(CASE WHEN no_rating THEN NULL ELSE rating END) AS ratings, max(url) AS max_url
FROM recs GROUP BY updated"""

ORACLE["json_sink"] = f"""
WITH {RECORDS}
SELECT CASE WHEN no_rating THEN NULL ELSE rating END AS rating, count(*) AS records,
  count(CASE WHEN no_title THEN NULL ELSE title END) AS titles, min(url) AS min_url
FROM recs GROUP BY 1"""

HIST = f"""h AS (
SELECT event_id AS id, {DOMAIN} AS domain, event_type, ts, {SCORE} AS q,
  CASE event_type WHEN 'error' THEN ['NO_RESULTS'] WHEN 'view' THEN ['LOW_FILL_RATE', 'LOW_VALIDITY']
    WHEN 'click' THEN ['GARBAGE_CONTENT'] ELSE [] END AS issues
FROM events)"""

PROFILES = f"""p AS (
SELECT domain,
  list_reduce(list_prepend(2.0::DOUBLE, list(q ORDER BY ts, id)), lambda w, x:
    CASE WHEN x < 0.35 THEN least(w + 2.0, 15.0) WHEN x >= 0.85 THEN greatest(w - 0.5, 1.0) ELSE w END::DOUBLE) AS wait_seconds,
  list_reduce(list(q ORDER BY ts, id), lambda a, x: {r3("0.3::DOUBLE * x + 0.7::DOUBLE * a")}) AS avg_quality,
  count(*) AS total_scrapes, count(*) FILTER (q >= 0.35) AS total_successes,
  count(*) FILTER (q < 0.35) AS total_failures, epoch_us(max(ts)) AS last_us
FROM h GROUP BY domain)"""

ORACLE["history_table"] = f"""
WITH {HIST}
SELECT domain, count(*) AS n, count(*)::DOUBLE AS uncertainty, sum(len(issues))::BIGINT AS issues,
  sum(round(q * 1000))::BIGINT AS milli_quality, epoch_us(max(ts)) AS last_us
FROM h GROUP BY domain"""
ORACLE["legacy_history_import"] = f"""
WITH {HIST} SELECT domain, count(*) AS n, sum(len(issues))::BIGINT AS issues, sum(round(q * 1000))::BIGINT AS milli_quality,
  (epoch_us(min(ts)) // 1000000)::BIGINT AS first_second, count(*)::DOUBLE AS uncertainty FROM h GROUP BY domain"""
ORACLE["domain_profiles"] = f"WITH {HIST}, {PROFILES} SELECT * FROM p"
ORACLE["strategy_table_versions"] = ORACLE["domain_profiles"]
ORACLE["streaming_profiles"] = ORACLE["domain_profiles"]
ORACLE["streaming_profiles_ordered"] = ORACLE["domain_profiles"]

ORACLE["table_upgrade"] = """
SELECT o_orderkey AS id, 'c' || (o_custkey % 100) || '.example.org' AS domain, 1::INTEGER AS version,
  'candidate' AS status, 0.0::DOUBLE AS baseline_quality, true AS unmeasured,
  0.05::DOUBLE AS minimum_improvement, 0::BIGINT AS input_tokens, epoch_us(o_orderdate::TIMESTAMP) AS us
FROM orders"""

ORACLE["feedback_to_rules"] = f"""
WITH f AS (SELECT event_id AS id, {DOMAIN} AS domain, event_id % 5 AS k, event_type
  FROM events WHERE event_type <> 'click'),
made AS (SELECT domain, CASE k WHEN 0 THEN 'class' ELSE 'id' END AS rule_type, event_type AS selector, count(*) AS n
  FROM f WHERE k IN (0, 4) GROUP BY ALL)
SELECT domain, rule_type, selector, 'active' AS status, greatest(n, 2)::BIGINT AS evidence_count,
  1.0::DOUBLE AS confidence, 'Explicit user feedback' AS reason, 'explicit-feedback' AS evidence FROM made
UNION ALL
SELECT domain, '', '', 'rejected', count(*), 0.0::DOUBLE, '', '' FROM f WHERE k IN (1, 2, 3) GROUP BY domain"""
# A rule's first explicit row counts twice, every later one once.
ORACLE["feedback_to_rules"] = ORACLE["feedback_to_rules"].replace(
    "greatest(n, 2)::BIGINT", "(n + 1)::BIGINT"
)

_cells = ["title", "price", "rating", "url", "contact_email", "updated"]
ORACLE["result_preview"] = f"""
WITH {RECORDS}
SELECT small AS page_id, k AS rec_ord,
  CASE WHEN no_title THEN '' ELSE left(coalesce(title, 'None'), 40) END AS title, left(price, 40) AS price,
  CASE WHEN no_rating THEN '' ELSE left(rating, 40) END AS rating, left(url, 40) AS url,
  left(contact_email, 40) AS contact_email, left(updated, 40) AS updated
FROM recs ORDER BY small, k LIMIT 25"""


# --- page cleaning -------------------------------------------------------------
def block_out(html: str, tag: str, attrs: str = r"\b[^>]*", flags: str = "gis") -> str:
    return f"regexp_replace({html}, {q(f'<{tag}{attrs}>.*?</{tag}>')}, '<x>', {q(flags)})"


def visible(html: str) -> str:
    """Text pieces between tags, trimmed, joined by line ends."""
    out = f"regexp_replace({html}, '<!--.*?-->', '<x>', 'gs')"
    for tag in fv.DROPPED_TAGS:
        out = block_out(out, tag)
    decode = "s"
    for name, char in (("copy", "©"), ("middot", "·"), ("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        decode = f"replace({decode}, '&{name};', {q(char)})"
    pieces = f"list_transform(string_split_regex({out}, '<[^>]*>'), lambda s: trim({decode}, {SPACE}))"
    joined = f"array_to_string(list_filter({pieces}, lambda s: s <> ''), chr(10))"
    return f"regexp_replace({joined}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


ORACLE["clean_page_text"] = f"""
WITH t AS (SELECT page_id, {URL_DOMAIN} AS domain, {visible("html")} AS text FROM pages)
SELECT page_id, domain, length(text)::BIGINT AS chars, md5(text) AS text_md5 FROM t"""

MARKED = f"""marked AS (
SELECT page_id, url, CASE WHEN page_id % 8 = 7 THEN '<html><body>x</body></html>'
  ELSE replace(html, '<article>', '<article>' || {at("page_id % 8", *views.BLOCKS)}) END AS html FROM pages)"""
_hidden = lambda html: block_out(html, "div", r' style="[^"]*display\s*:\s*none[^"]*"')
_cookie = lambda html: block_out(html, "div", r' class="[^"]*cookie[^"]*"')
_banner = lambda html: block_out(html, "div", r' class="[^"]*banner[^"]*"')
# Pages with a challenge are not cleaned.
_checked = "CASE WHEN contains(lower(html), 'g-recaptcha') THEN NULL ELSE {} END"

ORACLE["clean_marked_pages"] = f"""
WITH {MARKED}, t AS (SELECT page_id, {_checked.format(visible(_cookie(_hidden("html"))))} AS text FROM marked)
SELECT page_id, length(text)::BIGINT AS chars, md5(text) AS text_md5 FROM t"""
_compat_hidden = lambda html: block_out(html, "div", r' style="[^"]*display\s*:\s*none[^"]*"', "gs")
ORACLE["clean_marked_pages_compat"] = f"""
WITH {MARKED}, t AS (SELECT page_id, {_checked.format(visible(_banner(_cookie(_compat_hidden("html")))))} AS text FROM marked)
SELECT page_id, length(text)::BIGINT AS chars, md5(text) AS text_md5 FROM t"""

PAGE_RULES = f"""base AS (SELECT {URL_DOMAIN} AS domain, min(page_id) * 10 AS base FROM pages GROUP BY 1)"""
_no_ad = lambda html: f"regexp_replace({html}, '<div class=\"ad\">.*?</div>', '<x>', 'gs')"
_no_promo = lambda html: f"regexp_replace({html}, '<section id=\"promo\">.*?</section>', '<x>', 's')"
_no_h1 = lambda html: f"regexp_replace({html}, '<h1>.*?</h1>', '<x>', 'gs')"
ORACLE["clean_with_learned_rules"] = f"""
WITH {MARKED}, {PAGE_RULES},
j AS (SELECT m.*, base, base % 20 <> 0 AS tag_rule, {_cookie(_hidden("html"))} AS html1
  FROM (SELECT *, {URL_DOMAIN} AS domain FROM marked) m JOIN base USING (domain)),
s AS (SELECT *, {_no_promo(_no_ad("html1"))} AS html2 FROM j),
t AS (SELECT *, CASE WHEN tag_rule THEN {_no_h1("html2")} ELSE html2 END AS html3 FROM s)
SELECT page_id,
  CASE WHEN contains(lower(html), 'g-recaptcha') THEN '' ELSE array_to_string(list_filter([
    CASE WHEN contains(html1, 'class="ad"') THEN base + 1 END,
    CASE WHEN contains(html1, 'id="promo"') THEN base + 2 END,
    CASE WHEN tag_rule AND contains(html1, '<h1>') THEN base + 3 END], lambda x: x IS NOT NULL), ',') END AS applied_rule_ids,
  md5({_checked.format(visible("html3"))}) AS text_md5
FROM t"""

ORACLE["challenge_pages"] = f"""
WITH {MARKED}, t AS (SELECT page_id, lower(html || {at("page_id % 5", "", "<i>HCaptcha</i><b>CF-CHL-1</b>", "<i>awsWAF-captcha</i>", "challenge-platform", "")}) AS h FROM marked),
m AS (SELECT page_id, CASE WHEN contains(h, 'awswaf-captcha') THEN 'awswaf-captcha'
  WHEN contains(h, 'challenge-platform') THEN 'challenge-platform' WHEN contains(h, 'cf-chl-') THEN 'cf-chl-'
  WHEN contains(h, 'g-recaptcha') THEN 'g-recaptcha' WHEN contains(h, 'hcaptcha') THEN 'hcaptcha' END AS marker FROM t)
SELECT page_id, CASE marker WHEN 'awswaf-captcha' THEN 'aws_waf' WHEN 'challenge-platform' THEN 'cloudflare'
  WHEN 'cf-chl-' THEN 'cloudflare' ELSE 'captcha' END AS type, marker FROM m WHERE marker IS NOT NULL"""

ORACLE["page_failures"] = f"""
WITH {MARKED}, t AS (SELECT page_id, url, html, {visible(_cookie(_hidden("html")))} AS text FROM marked)
SELECT page_id, url, 'UnsupportedChallengeError' AS error_type, 'captcha' AS challenge, 'browser' AS component
FROM t WHERE contains(lower(html), 'g-recaptcha')
UNION ALL
SELECT page_id, url, 'EmptyPageError', '', 'browser' FROM t
WHERE NOT contains(lower(html), 'g-recaptcha') AND length(text) < 50"""

_limits = {"standard": 50000, "reduced": 25000, "question": 30000, "sample": 5000, "prompt": 3000}
ORACLE["bounded_content"] = (
    "SELECT doc_id, "
    + ", ".join(f"least(length(text), {n})::BIGINT AS {k}_chars, length(text) > {n} AS {k}_cut" for k, n in _limits.items())
    + ", md5(substring(text, 1, 3000)) AS prompt_md5 FROM documents"
)

# --- requests and responses ----------------------------------------------------
TEXTS = f"""t AS (SELECT page_id, url, {URL_DOMAIN} AS domain, {visible("html")} AS text FROM pages)"""
_prompt = fv.EXTRACTION_PROMPT + json.dumps(fv.SCHEMAS["ARTICLES"], indent=2)
ORACLE["extraction_requests"] = f"""
WITH {TEXTS}, i AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'Keep prices.' ELSE '' END AS own,
  CASE WHEN page_id % 3 = 0 THEN 'Look below ' || domain ELSE '' END AS learned,
  CASE WHEN page_id % 5 = 0 THEN 1000 ELSE 50000 END AS n FROM t),
told AS (SELECT *, CASE WHEN learned = '' THEN own ELSE trim(own || chr(10) || chr(10) || '[Accepted domain-specific refinement]' || chr(10) || learned, {SPACE}) END AS told FROM i)
SELECT page_id, 'extract' AS kind,
  md5({q(_prompt)} || CASE WHEN told = '' THEN '' ELSE chr(10) || chr(10) || 'Additional instructions:' || chr(10) || told END) AS prompt_md5,
  md5(substring(text, 1, n)) AS content_md5, least(length(text), n)::BIGINT AS content_chars, length(text) > n AS truncated
FROM told"""
ORACLE["question_requests"] = f"""
WITH {TEXTS}, c AS (SELECT page_id, 'Answer the question using only the supplied page content.' || chr(10) || chr(10) || 'Question: What does ' || domain || ' say?' || chr(10) || chr(10) || 'Page content:' || chr(10) || substring(text, 1, 30000) AS content FROM t)
SELECT page_id, 'ask' AS kind, md5(content) AS content_md5, length(content)::BIGINT AS content_chars FROM c"""

_obj = """printf('{"title": "%s", "url": "/p/%d", "price": %d, "stock": {"left": %d, "ok": true}}', p_name, p_partkey, floor(p_retailprice)::BIGINT, p_size)"""
RESPONSES = f"""o AS (SELECT *, p_partkey AS page_id, {_obj} AS obj FROM part),
r AS (SELECT page_id, p_size, p_type, p_brand, p_name, p_retailprice, ([
  '[' || obj || ']', '```json' || chr(10) || '[' || obj || ']' || chr(10) || '```' || chr(10), obj, 'not json: ' || p_name,
  ' ' || chr(10) || ' ', '[1, ' || obj || ']', '[]', ' [' || obj || ', ' || replace(obj, '/p/', 'https://cdn.example.com/') || ']',
  obj || ' trailing', '```' || obj || '```'])[page_id % 10 + 1] AS raw FROM o),
f AS (SELECT *, trim(raw, {SPACE}) AS s FROM r),
g AS (SELECT *, CASE WHEN s LIKE '```%' THEN trim(regexp_replace(regexp_replace(s, '^```[^\\n{{]*', ''), '```$', ''), {SPACE}) ELSE s END AS body FROM f),
c AS (SELECT *, CASE WHEN s = '' THEN 'LLMExtractionError' WHEN NOT json_valid(body) THEN 'LLMParseError'
  WHEN json_type(body) = 'OBJECT' THEN ''
  WHEN json_type(body) = 'ARRAY' AND len(list_filter(json_extract(body, '$[*]'), lambda x: json_type(x) <> 'OBJECT')) = 0 THEN ''
  ELSE 'LLMExtractionError' END AS error_type FROM g),
d AS (SELECT *, CASE WHEN error_type <> '' THEN NULL WHEN json_type(body) = 'OBJECT' THEN [body::JSON]
  ELSE json_extract(body, '$[*]') END AS items FROM c)"""
ORACLE["parsed_responses"] = f"""
WITH {RESPONSES} SELECT page_id, error_type, coalesce(len(items), -1)::BIGINT AS n_records FROM d"""
ORACLE["response_records"] = f"""
WITH {RESPONSES}, e AS (SELECT page_id, p_brand, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS rec_ord FROM d WHERE error_type = '')
SELECT page_id, rec_ord::BIGINT AS rec_ord, item->>'title' AS title,
  CASE WHEN item->>'url' LIKE '/%' THEN 'https://' || replace(lower(p_brand), '#', '') || '.example.com' || (item->>'url') ELSE item->>'url' END AS url,
  item->>'price' AS price, item->>'stock' AS stock FROM e"""
ORACLE["usage_tally"] = """
SELECT replace(lower(p_brand), '#', '') || '.example.com' AS domain, lower(p_type) AS model, count(*) AS requests,
  sum(CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size * 10 END)::BIGINT AS input_tokens,
  sum(p_partkey % 100)::BIGINT AS output_tokens
FROM part GROUP BY 1, 2"""
ORACLE["text_answers"] = f"""
WITH {RESPONSES} SELECT page_id, CASE WHEN s = '' THEN '' ELSE md5(s) END AS answer_md5,
  CASE WHEN s = '' THEN 'LLMExtractionError' ELSE '' END AS error_type, length(s) > 20 AS candidate FROM f"""

LINKS = r"""l AS (SELECT page_id, url, html, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>')) AS a,
  generate_subscripts(regexp_extract_all(html, '(?i)<a\s[^>]*href="[^"]*"[^>]*>[^<]*</a>'), 1) - 1 AS rec_ord FROM pages),
k AS (SELECT page_id, url, rec_ord, regexp_extract(a, '>([^<]*)<', 1) AS text, regexp_extract(a, 'href="([^"]*)"', 1) AS href,
  regexp_extract(url, '^(https?://[^/]*)', 1) AS site, regexp_extract(html, '(?is)<title>([^<]*)</title>', 1) AS title FROM l),
links AS (SELECT *, CASE WHEN href LIKE '/%' THEN site || href ELSE href END AS link FROM k)"""
# The anchors that the query's input adds after the navigation.
ADDED_LINKS = """(VALUES (0, 'one', '/single'), (1, 'two', '/bare'), (2, 'three & four', '/nested?q=1&r=2'),
  (3, 'five', '/aside'), (4, '', '/empty')) AS a(n, text, path)"""
ORACLE["resolved_links"] = f"""
WITH {LINKS}, site AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]*)', 1) AS site FROM pages),
own AS (SELECT page_id, count(*) AS n FROM links GROUP BY page_id)
SELECT page_id, rec_ord::BIGINT AS rec_ord, text, link FROM links
UNION ALL
SELECT page_id, (coalesce(own.n, 0) + a.n)::BIGINT, a.text, site || a.path
FROM site LEFT JOIN own USING (page_id) CROSS JOIN {ADDED_LINKS}"""
ORACLE["resolved_links_compat"] = """
SELECT page_id, regexp_extract(url, '^(https?://[^/]*)', 1) || '/about/' || page_id AS website,
  'https:relative' AS link, '' AS image_url FROM pages"""

RUN = f"""{MARKED},
t AS (SELECT page_id, url, {URL_DOMAIN} AS domain, html, {visible(_cookie(_hidden("html")))} AS text FROM marked),
ok AS (SELECT *, string_split(text, chr(10)) AS lines FROM t WHERE NOT contains(lower(html), 'g-recaptcha') AND length(text) >= 50),
rec AS (SELECT page_id, url, domain, lines[1] AS headline, lines[len(lines)] AS summary,
  regexp_extract(url, '^(https?://[^/]*)', 1) || '/a' AS link FROM ok)"""
ORACLE["batch_run_records"] = f"""
WITH {RUN} SELECT page_id, 0::BIGINT AS rec_ord, url AS source_url, link, md5(headline) AS headline_md5 FROM rec"""
ORACLE["batch_run_failures"] = "SELECT page_id, url, error_type FROM (" + ORACLE["page_failures"] + ")"
# One record per page: headline, summary and url are there, author, date and category are not.
_present = lambda c: f"(trim({c}, {SPACE}) NOT IN ({values(*fv.ABSENT_TEXTS)}))::INTEGER"
_telling = lambda c: f"({_present(c)} = 1 AND length(trim({c}, {SPACE})) > 1 AND lower(trim({c}, {SPACE})) <> {q(c)})::INTEGER"
RUN_SCORE = f"""m AS (SELECT page_id, domain, ({_present("headline")} + {_present("summary")} + 1) / 6 AS fill,
  ({_telling("headline")} + {_telling("summary")} + 1) / 6 AS basic,
  ({contains_any("lower(headline || ' | ' || summary || ' | ' || link)", fv.GARBAGE_PHRASES)})::INTEGER AS garbage,
  (trim(headline, {SPACE}) <> '')::INTEGER / 1 AS uniq FROM rec),
s AS (SELECT *, {r3("fill * 0.25 + basic * 0.20 + uniq * 0.15 + (1 - garbage / 1) * 0.10 + 1.0::DOUBLE * 0.20 + 0.2::DOUBLE * 0.10")} AS score FROM m)"""
_run_issues = "array_to_string(list_filter([CASE WHEN fill < 0.3 THEN 'LOW_FILL_RATE' END, CASE WHEN basic < 0.3 THEN 'LOW_VALIDITY' END, CASE WHEN uniq < 0.5 THEN 'MANY_DUPLICATES' END, CASE WHEN garbage = 1 THEN 'GARBAGE_CONTENT' END, 'ONLY_ONE_RESULT'], lambda x: x IS NOT NULL), ',')"
ORACLE["batch_run_quality"] = f"""
WITH {RUN}, {RUN_SCORE}
SELECT page_id, domain, 'author_category_headline_published_date' AS schema_name, 1::BIGINT AS results_count, score, {_run_issues} AS issues FROM s"""
ORACLE["batch_run_strategy"] = f"""
WITH {RUN}, {RUN_SCORE}, h AS (SELECT page_id AS id, domain, TIMESTAMP '2024-02-01' AS ts, score AS q FROM s),
{PROFILES} SELECT * FROM p"""
ORACLE["run_prompt_usage"] = f"""
WITH {RUN}, known AS (SELECT {URL_DOMAIN} AS domain, min(page_id) AS k FROM pages GROUP BY 1),
asked AS (SELECT domain, count(*) AS n FROM ok GROUP BY 1)
SELECT k * 2 AS id, domain, 'accepted' AS status, (3 + coalesce(n, 0))::BIGINT AS times_used FROM known LEFT JOIN asked USING (domain)
UNION ALL SELECT k * 2 + 1, domain, 'rejected', 3::BIGINT FROM known"""
# The same run with learned rules: the text, and so the thin-page check, comes after them.
RULED = f"""{MARKED}, {PAGE_RULES},
j AS (SELECT m.*, base, base % 20 <> 0 AS tag_rule, {_cookie(_hidden("html"))} AS html1
  FROM (SELECT *, {URL_DOMAIN} AS domain FROM marked) m JOIN base USING (domain)),
j2 AS (SELECT *, {_no_promo(_no_ad("html1"))} AS html2 FROM j),
j3 AS (SELECT *, CASE WHEN tag_rule THEN {_no_h1("html2")} ELSE html2 END AS html3 FROM j2),
t AS (SELECT *, {visible("html3")} AS text FROM j3),
ok AS (SELECT *, string_split(text, chr(10)) AS lines FROM t WHERE NOT contains(lower(html), 'g-recaptcha') AND length(text) >= 50),
rec AS (SELECT page_id, url, domain, lines[1] AS headline, lines[len(lines)] AS summary,
  regexp_extract(url, '^(https?://[^/]*)', 1) || '/a' AS link FROM ok)"""
ORACLE["batch_run_rules"] = f"""
WITH {RULED}, {RUN_SCORE},
h AS (SELECT page_id AS id, domain, TIMESTAMP '2024-01-01' AS ts, 0.9::DOUBLE AS q FROM s),
{PROFILES},
old AS (SELECT base + 1 AS id, domain, base, 'class' AS rule_type, 'ad' AS selector, 'active' AS status FROM base
  UNION ALL SELECT base + 2, domain, base, 'id', 'promo', 'active' FROM base
  UNION ALL SELECT base + 3, domain, base, 'tag', 'h1', CASE WHEN base % 20 = 0 THEN 'candidate' ELSE 'active' END FROM base),
use_ AS (SELECT o.id, o.status, ok.page_id FROM old o JOIN (SELECT page_id, domain, html1 AS html FROM ok) ok USING (domain)
  WHERE o.status = 'active' AND ((selector = 'ad' AND contains(html, 'class="ad"')) OR (selector = 'promo' AND contains(html, 'id="promo"')) OR (selector = 'h1' AND contains(html, '<h1>')))),
outc AS (SELECT use_.id, page_id, s.score AS quality, p.avg_quality AS base_quality FROM use_ JOIN s USING (page_id) JOIN p USING (domain)),
fold AS (SELECT id, count(*) AS n, count(*) FILTER (quality < base_quality - 0.05) AS down, arg_max(quality, page_id) AS last_quality FROM outc GROUP BY id),
ev AS (SELECT domain, count(*) AS n FROM ok WHERE page_id % 8 = 6 GROUP BY domain)
SELECT domain, rule_type, selector, CASE WHEN status = 'active' AND down >= 2 THEN 'disabled' ELSE status END AS status,
  0::BIGINT AS evidence_count, 0.0::DOUBLE AS confidence, coalesce(n, 0)::BIGINT AS times_applied,
  coalesce(down, 0)::BIGINT AS negative_outcomes, last_quality FROM old LEFT JOIN fold USING (id)
UNION ALL
SELECT domain, 'class', 'promo-card', CASE WHEN n >= 2 THEN 'active' ELSE 'candidate' END, n::BIGINT,
  CASE WHEN n = 1 THEN 0.55::DOUBLE ELSE 1 - pow(1 - 0.55::DOUBLE, n) END, 0::BIGINT, 0::BIGINT, NULL FROM ev"""

# First answer: one record with the headline "x", present but not telling. Second: six
# fields, one or two records, none for every fifth page.
REFINED = f"""{TEXTS}, ok AS (SELECT *, string_split(text, chr(10)) AS lines FROM t WHERE length(text) >= 50),
b AS (SELECT page_id, domain, lines[1] AS headline, lines[len(lines)] AS summary,
  {r3("1 / 6 * 0.25 + 0 * 0.20 + 1.0::DOUBLE * 0.15 + 1.0::DOUBLE * 0.10 + 1.0::DOUBLE * 0.20 + 0.2::DOUBLE * 0.10")} AS base, 1 + page_id % 2 AS n FROM ok),
m AS (SELECT *, ({_present("headline")} + {_present("summary")} + 4) * n / (6 * n) AS fill,
  ({_telling("headline")} + {_telling("summary")} + 4) * n / (6 * n) AS basic,
  ({contains_any("lower(headline || ' | ' || summary)", fv.GARBAGE_PHRASES)})::INTEGER AS garbage,
  (trim(headline, {SPACE}) <> '')::INTEGER / n AS uniq FROM b),
s AS (SELECT *, CASE WHEN page_id % 5 = 0 THEN NULL ELSE
  {r3("fill * 0.25 + basic * 0.20 + uniq * 0.15 + (1 - garbage / 1) * 0.10 + 1.0::DOUBLE * 0.20 + n / 5 * 0.10")} END AS cand FROM m),
v AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS version FROM s WHERE cand IS NOT NULL)"""
ORACLE["refined_run"] = f"""
WITH {REFINED}
SELECT s.page_id, s.base AS baseline_quality, coalesce(s.cand, -1.0::DOUBLE) AS candidate_quality, coalesce(s.cand - s.base >= 0.05, false) AS accepted,
  CASE WHEN s.cand - s.base >= 0.05 THEN s.n ELSE 1 END::BIGINT AS n_records, coalesce(version, 0)::BIGINT AS version,
  CASE WHEN s.cand IS NULL THEN '' WHEN s.cand - s.base >= 0.05 THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN s.cand IS NULL THEN 0.0::DOUBLE ELSE 6.0::DOUBLE END AS latency_ms, CASE WHEN s.cand IS NULL THEN 0 ELSE 27 END::BIGINT AS input_tokens,
  md5({q(_prompt)} || chr(10) || chr(10) || 'Additional instructions:' || chr(10) || '[Candidate retry instructions]' || chr(10) || 'Look for the headline of ' || s.domain) AS prompt_md5
FROM s LEFT JOIN v USING (page_id)"""

ORACLE["refined_run_strategy"] = f"""
WITH {REFINED}, rows AS (SELECT domain, page_id AS id, TIMESTAMP '2024-02-01' AS ts, base AS q, true AS first_try FROM s
  UNION ALL SELECT domain, page_id, TIMESTAMP '2024-02-02', cand, false FROM s WHERE cand IS NOT NULL),
h AS (SELECT domain, id, ts, q FROM rows), {PROFILES},
w AS (SELECT domain, list_reduce(list_prepend(2.0::DOUBLE, list(q ORDER BY ts, id)), lambda w, x:
    CASE WHEN x < 0.35 THEN least(w + 2.0, 15.0) WHEN x >= 0.85 THEN greatest(w - 0.5, 1.0) ELSE w END::DOUBLE) AS wait_seconds
  FROM rows WHERE first_try GROUP BY domain)
SELECT p.* REPLACE (w.wait_seconds AS wait_seconds) FROM p JOIN w USING (domain)"""

# --- scalar functions ----------------------------------------------------------
ORACLE["url_domains"] = f"SELECT page_id, {URL_DOMAIN} AS domain FROM pages"
ORACLE["redacted_urls"] = r"""
WITH u AS (SELECT page_id % 7 AS k, page_id, url, regexp_extract(url, '^(https?)://', 1) AS scheme,
  regexp_extract(url, '^https?://([^/]*)', 1) AS host, regexp_replace(url, '^https?://[^/]*', '') AS rest FROM pages),
v AS (SELECT *, regexp_extract(rest, '^([^?#]*)', 1) AS path FROM u)
SELECT page_id, CASE k WHEN 0 THEN 'http://' || lower(host) || ':8080' || path
  WHEN 1 THEN 'https://' || lower(host) || path WHEN 2 THEN '<invalid-url>'
  WHEN 3 THEN 'https://2001:db8::1:443' || path WHEN 4 THEN path WHEN 5 THEN '<invalid-url>'
  ELSE scheme || '://' || lower(host) || path END AS safe_url FROM v"""

# Word boundaries and digits beyond ASCII do not occur next to the patterns in the
# tables; the SQL is plain.
_b = lambda t: f"regexp_replace({t}, {q('(?i)' + fv.BEARER)}, 'Bearer <redacted>', 'g')"
_a = lambda t: f"regexp_replace({t}, {q('(?i)' + fv.SECRET_ASSIGNMENT)}, '\\1=<redacted>', 'g')"
_p = lambda t: f"regexp_replace({t}, {q(fv.SECRET_PREFIX)}, '<redacted>', 'g')"
_hits = lambda t, p: f"len(regexp_extract_all({t}, {q(p)}))::BIGINT"


def redaction(source: str) -> str:
    return f"""
WITH d AS (SELECT doc_id, {source} AS t0 FROM documents), x AS (SELECT *, {_b("t0")} AS t1 FROM d),
y AS (SELECT *, {_a("t1")} AS t2 FROM x)
SELECT doc_id, md5({_p("t2")}) AS safe_md5, {_hits("t0", "(?i)" + fv.BEARER)} AS bearer_hits,
  {_hits("t1", "(?i)" + fv.SECRET_ASSIGNMENT)} AS assignment_hits, {_hits("t2", fv.SECRET_PREFIX)} AS prefix_hits FROM y"""


ORACLE["redacted_documents"] = redaction("text")
ORACLE["redacted_secrets"] = redaction(
    "text || ' ' || "
    + at("doc_id % 6", "Authorization: BEARER abc.def-1", "token = t0k; x", "API_KEY:k,l", "sk-abcdefgh12345678", "ghp_abcdefgh123456", "no secret")
    + " || ' cookie= c' || chr(10) || text"
)

FIELDS = ["title", "price", "rating", "url", "contact_email", "updated", "rooms"]
_missing = {"title": "no_title", "rating": "no_rating"}
CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT small, brand, k, {q(f)} AS f, {f} AS v, {_missing.get(f, 'false')} AS missing FROM recs" for f in FIELDS
) + f"""),
seen AS (SELECT *, trim(v, {SPACE}) AS s, NOT missing AND v IS NOT NULL AND trim(v, {SPACE}) NOT IN ({values(*fv.ABSENT_TEXTS)}) AS present FROM cells),
checked AS (SELECT *, CASE
  WHEN NOT present THEN CASE WHEN f IN ('rating', 'url') THEN 'required' END
  WHEN f = 'url' THEN CASE WHEN NOT regexp_matches(s, '^https?://[^/]') THEN 'invalid_url' END
  WHEN f = 'contact_email' THEN CASE WHEN NOT regexp_full_match(s, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') THEN 'invalid_email' END
  WHEN f = 'updated' THEN CASE WHEN NOT (regexp_matches(s, '\\b(?:19|20)[0-9]{{2}}\\b|\\b[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}\\b')
     OR try_strptime(s, '%Y-%m-%d') IS NOT NULL OR try_strptime(s, '%Y%m%d') IS NOT NULL) THEN 'implausible_date' END
  WHEN f = 'price' THEN CASE WHEN NOT regexp_matches(s, '[0-9]') THEN 'missing_number' WHEN regexp_matches(s, '(^|\\s)-\\s*[0-9]') THEN 'negative_value' END
  WHEN f = 'rating' THEN CASE WHEN try_cast(s AS DOUBLE) IS NULL THEN 'invalid_number' WHEN s::DOUBLE < 1 THEN 'below_minimum' WHEN s::DOUBLE > 45 THEN 'above_maximum' END
  WHEN f = 'rooms' THEN CASE WHEN regexp_extract(s, '-?[0-9]+') LIKE '-%' THEN 'negative_value' END
  END AS error FROM seen)"""
CELLS = CELLS.replace("{{", "{").replace("}}", "}")
ORACLE["present_values"] = (
    f"WITH {RECORDS}, {CELLS} SELECT "
    + ", ".join(f"(count(*) FILTER (f = {q(f)} AND present))::BIGINT AS {f}" for f in FIELDS)
    + " FROM checked"
)
ORACLE["field_errors"] = f"""
WITH {RECORDS}, {CELLS} SELECT f AS field, coalesce(error, '') AS error, count(*) AS n FROM checked GROUP BY 1, 2"""


# --- quality -------------------------------------------------------------------
def quality(page: str, n_fields: int = 7, identity: str = "title") -> str:
    """Rates, score and issues per page from ``checked`` and ``ids``."""
    return f"""
sums AS (SELECT {page} AS page_id, count(DISTINCT k) AS n, sum(present::INTEGER)::BIGINT AS filled,
  sum((present AND length(s) > 1 AND lower(s) <> f)::INTEGER)::BIGINT AS basic,
  sum((error IS NULL)::INTEGER)::BIGINT AS sound,
  count(DISTINCT CASE WHEN NOT missing AND {contains_any("lower(coalesce(v, ''))", fv.GARBAGE_PHRASES)} THEN k END) AS garbage,
  array_to_string(list_sort(list(DISTINCT f || ':' || error) FILTER (error IS NOT NULL)), ',') AS validation_errors
  FROM checked GROUP BY 1),
u AS (SELECT page_id, count(DISTINCT nullif(identity, '')) AS ids FROM ids GROUP BY 1),
rates AS (SELECT *, filled / (n * {n_fields}) AS fr, basic / (n * {n_fields}) AS bv, ids / n AS un, 1 - garbage / n AS cq,
  sound / (n * {n_fields}) AS dv, least(n / 5, 1.0::DOUBLE) AS rc FROM sums JOIN u USING (page_id)),
scored AS (SELECT *, {r3("least(greatest(fr * 0.25 + bv * 0.20 + un * 0.15 + cq * 0.10 + dv * 0.20 + rc * 0.10, 0), 1)")} AS score,
  {r3("least(1.0::DOUBLE, 0.35 + 0.35 * rc + 0.30 * dv)")} AS conf FROM rates)"""


QUALITY_COLUMNS = f"""SELECT page_id, n AS results_count, score, {r3("fr")} AS fill_rate, {r3("bv")} AS basic_validity,
  {r3("un")} AS uniqueness, {r3("cq")} AS content_quality, {r3("dv")} AS deterministic_validation, {r3("rc")} AS result_count,
  conf AS confidence, {r3("1 - conf")} AS uncertainty, coalesce(validation_errors, '') AS validation_errors,
  array_to_string(list_filter([CASE WHEN fr < 0.3 THEN 'LOW_FILL_RATE' END, CASE WHEN bv < 0.3 THEN 'LOW_VALIDITY' END,
    CASE WHEN un < 0.5 THEN 'MANY_DUPLICATES' END, CASE WHEN cq < 0.5 THEN 'GARBAGE_CONTENT' END,
    CASE WHEN dv < 0.7 THEN 'SCHEMA_VALIDATION_FAILED' END, CASE WHEN n = 1 THEN 'ONLY_ONE_RESULT' END], lambda x: x IS NOT NULL), ',') AS issues
FROM scored"""
_ids = lambda page: f"ids AS (SELECT {page} AS page_id, CASE WHEN no_title THEN '' ELSE lower(trim(coalesce(title, 'None'), {SPACE})) END AS identity FROM recs)"
ORACLE["brand_quality_scores"] = f"WITH {RECORDS}, {CELLS}, {_ids('brand')}, {quality('brand')} {QUALITY_COLUMNS}"
_zeros = ", ".join(["0.0::DOUBLE"] * 8)
ORACLE["page_quality_scores"] = f"""
WITH {RECORDS}, {CELLS}, {_ids('small')}, {quality('small')}
{QUALITY_COLUMNS}
UNION ALL SELECT DISTINCT -brand, 0::BIGINT, {_zeros}, 1.0::DOUBLE, '', 'NO_RESULTS' FROM recs WHERE -brand NOT IN (SELECT small FROM recs)"""
ORACLE["quality_without_identity"] = f"""
WITH {RECORDS}, {CELLS.replace("checked AS (", "all_checked AS (")},
checked AS (SELECT * FROM all_checked WHERE f IN ('price', 'rooms')),
ids AS (SELECT brand AS page_id, price || chr(0) || rooms AS identity FROM recs),
{quality('brand', 2)} {QUALITY_COLUMNS}"""

_product_cells = ", ".join(f"{q(f)}: {f if f in ('price', 'url') else 'NULL'}" for f in fv.SCHEMAS["PRODUCTS"])
_part_records = ORACLE["response_records"].removeprefix(f"\nWITH {RESPONSES}, ")
_rates = [("fill_rate", "fill_rate"), ("validity_rate", "basic_validity"), ("uniqueness_rate", "uniqueness"), ("content_quality", "content_quality"), ("deterministic_validation_rate", "deterministic_validation")]
_components = ["fill_rate", "basic_validity", "uniqueness", "content_quality", "deterministic_validation", "result_count"]
_listed = lambda x: f"""CASE WHEN {x} = '' THEN '[]' ELSE '[{{nl}}    "' || replace({x}, ',', '",{{nl}}    "') || '"{{nl}}  ]' END"""
_diagnosis = (
    """'{{nl}  "score_kind": "extraction_quality_proxy",{nl}  "semantic_correctness_guaranteed": false,{nl}  "results_count": ' || results_count || ',{nl}  "components": {{nl}'"""
    + " || ',{nl}'".join(f""" || '    "{c}": ' || {c}::DOUBLE""" for c in _components)
    + " || '{nl}  }'"
    + "".join(f""" || ',{{nl}}  "{name}": ' || {c}::DOUBLE""" for name, c in [*_rates, ("confidence", "confidence"), ("uncertainty", "uncertainty")])
    + f""" || ',{{nl}}  "validation_errors": ' || {_listed("validation_errors")} || ',{{nl}}  "issues": ' || {_listed("issues")} || '{{nl}}}}'"""
)
_record = """'  {{nl}    "title": "' || title || '",{nl}    "url": "' || url || '",{nl}    "price": "' || price || '",{nl}    "stock": "' || replace(stock, '"', chr(92) || '"') || '"{nl}  }'"""
ORACLE["refinement_requests"] = f"""
WITH {RESPONSES}, rec_e AS (WITH {_part_records}),
checked AS (SELECT *, CASE WHEN f = 'url' AND present AND NOT regexp_matches(s, '^https?://[^/]') THEN 'invalid_url'
    WHEN f = 'price' AND present AND NOT regexp_matches(s, '[0-9]') THEN 'missing_number' END AS error
  FROM (SELECT *, trim(v, {SPACE}) AS s, v IS NULL AS missing, v IS NOT NULL AND trim(v, {SPACE}) NOT IN ({values(*fv.ABSENT_TEXTS)}) AS present
    FROM (SELECT page_id, page_id * 100 + rec_ord AS k, unnest(map_entries(MAP {{{_product_cells}}}), recursive := true) FROM rec_e) t(page_id, k, f, v))),
ids AS (SELECT page_id, '' AS identity FROM rec_e), {quality("page_id", len(fv.SCHEMAS["PRODUCTS"]))},
rated AS ({QUALITY_COLUMNS}
  UNION ALL SELECT page_id, 0::BIGINT, {_zeros}, 1.0::DOUBLE, '', 'NO_RESULTS' FROM d WHERE error_type = '' AND len(items) = 0),
sample AS (SELECT page_id, '[{{nl}}' || string_agg({_record}, ',{{nl}}' ORDER BY rec_ord) || '{{nl}}]' AS sample FROM rec_e WHERE rec_ord < 3 GROUP BY 1),
paged AS (SELECT p_partkey AS page_id, substr(coalesce(text, 'https://' || replace(lower(p_brand), '#', '') || '.example.com/list/' || p_partkey), 1, 5000) AS page
  FROM part LEFT JOIN documents ON doc_id = p_partkey % (SELECT greatest(1, count(*)) FROM documents)),
told AS (SELECT page_id, {q(fv.REFINEMENT_PROMPT_OPENING + chr(10) * 2 + "Schema:" + chr(10) + json.dumps(fv.SCHEMAS["PRODUCTS"], indent=2))}
  || '{{nl}}{{nl}}Sample output:{{nl}}' || coalesce(sample, '[]') || '{{nl}}{{nl}}Proxy diagnostics:{{nl}}' || {_diagnosis}
  || '{{nl}}{{nl}}Page sample:{{nl}}' || substr(page, 1, 3000) || '{{nl}}{{nl}}' || {q(fv.REFINEMENT_PROMPT_CLOSING)} AS user_content
  FROM rated JOIN paged USING (page_id) LEFT JOIN sample USING (page_id) WHERE fill_rate < 0.5 AND page <> '')
SELECT page_id, 'refine' AS kind, NULL::VARCHAR AS system_prompt, user_content, length(user_content)::INTEGER AS content_chars FROM told""".replace("{nl}", chr(10))

_mixed = "page_id, results_count, score, confidence, validation_errors, issues"
ORACLE["mixed_schema_scores"] = f"""
SELECT 'PARTS' AS schema_key, {_mixed} FROM ({ORACLE["brand_quality_scores"]}) WHERE page_id % 2 = 1
UNION ALL SELECT 'PRICES', {_mixed} FROM ({ORACLE["quality_without_identity"]}) WHERE page_id % 2 = 0"""

_issue_case = " ".join(f"WHEN list_contains(issues, {q(i)}) THEN {q(t)}" for i, t in fv.RETRY_INSTRUCTIONS.items())
PAGE_QUALITY = """pq AS (SELECT page_id, (page_id * 7 % 100) / 100 AS score, (page_id * 3 % 100) / 100 AS fill_rate,
  CASE page_id % 3 WHEN 0 THEN ['GARBAGE_CONTENT', 'LOW_VALIDITY'] WHEN 1 THEN ['LOW_FILL_RATE', 'MANY_DUPLICATES'] ELSE [] END AS issues FROM pages)"""
ORACLE["retry_strategies"] = f"""
WITH {PAGE_QUALITY} SELECT page_id, CASE {_issue_case} ELSE '' END AS extra_instructions,
  CASE WHEN list_contains(issues, 'NO_RESULTS') THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS wait_seconds_adjust, true AS retry
FROM pq WHERE score < 0.6"""

_base = f"WITH {RECORDS}, {CELLS}, {_ids('small')}, {quality('small')} SELECT page_id, score, n FROM scored"
_better_recs = RECORDS + f""",
better AS (SELECT * REPLACE ('$1' AS price, '5' AS rating) FROM recs)"""
_better_cells = CELLS.replace("FROM recs", "FROM better")
_retry = f"WITH {_better_recs}, {_better_cells}, {_ids('small')}, {quality('small')} SELECT page_id, score FROM scored"
ORACLE["refinement_choice"] = f"""
SELECT page_id, b.score AS baseline_quality, r.score AS candidate_quality, r.score - b.score >= 0.05 AS accepted,
  CASE WHEN r.score - b.score >= 0.05 THEN b.n ELSE 0 END::BIGINT AS new_prices
FROM ({_base}) b JOIN ({_retry}) r USING (page_id)"""

ORACLE["link_quality_by_domain"] = f"""
WITH {LINKS},
readable AS (SELECT page_id, {URL_DOMAIN} AS domain FROM pages WHERE length({visible("html")}) >= 50),
per AS (SELECT page_id, count(*) AS n,
  sum({_present("text")} + {_present("link")} + {_present("title")}) / (3 * count(*)) AS fr,
  sum(({_present("text")} = 1 AND length(trim(text)) > 1 AND lower(trim(text)) <> 'text')::INTEGER
    + ({_present("link")} = 1 AND length(link) > 1)::INTEGER
    + ({_present("title")} = 1 AND length(trim(title)) > 1 AND lower(trim(title)) <> 'context')::INTEGER) / (3 * count(*)) AS bv,
  count(DISTINCT lower(trim(link))) / count(*) AS un,
  1 - count(*) FILTER ({contains_any("lower(text || ' | ' || link || ' | ' || title)", fv.GARBAGE_PHRASES)}) / count(*) AS cq
  FROM links GROUP BY page_id),
s AS (SELECT domain, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 0 ELSE
  {r3("fr * 0.25 + bv * 0.20 + un * 0.15 + cq * 0.10 + 1.0::DOUBLE * 0.20 + least(n / 5, 1.0::DOUBLE) * 0.10")} END AS score
  FROM readable LEFT JOIN per USING (page_id))
SELECT domain, count(*) AS pages, sum(n)::BIGINT AS records, sum(round(score * 1000)::BIGINT)::BIGINT / (1000.0::DOUBLE * count(*)) AS avg_quality,
  count(*) FILTER (score >= 0.35) AS successes FROM s GROUP BY domain"""

# --- profiles and reports ------------------------------------------------------
ORACLE["learned_waits"] = f"""
WITH {HIST}, {PROFILES} SELECT event_id, coalesce(wait_seconds, 2.0::DOUBLE) AS wait_seconds
FROM events LEFT JOIN p ON p.domain = 'd' || (user_id % 60) || '.example.org'"""
ORACLE["success_rates"] = f"WITH {HIST}, {PROFILES} SELECT domain, total_successes / total_scrapes AS success_rate FROM p"
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id DESC) AS rank FROM h)"
ORACLE["domain_last_rows"] = f"WITH {HIST}, {RANKED} SELECT domain, id, rank, q AS quality_score FROM ranked WHERE rank <= 20"
ISSUES = lambda src: f"""ic AS (SELECT domain, issue, count(*) AS n FROM (SELECT domain, unnest(issues) AS issue FROM {src}) GROUP BY ALL),
ir AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY n DESC, issue) AS rank FROM ic)"""
ORACLE["issue_frequency"] = f"WITH {HIST}, {ISSUES('h')} SELECT * FROM ir"
ORACLE["domain_diagnosis"] = f"""
WITH {HIST}, {PROFILES}, {RANKED}, last50 AS (SELECT * FROM ranked WHERE rank <= 50), {ISSUES('last50')},
il AS (SELECT domain, string_agg(issue || ':' || n, ',' ORDER BY rank) AS common_issues, bool_or(issue = 'LOW_FILL_RATE') AS low FROM ir GROUP BY domain),
d AS (SELECT domain, count(*) AS n, sum(round(q * 1000))::BIGINT AS total,
  sum(CASE WHEN rank <= 5 THEN round(q * 1000) ELSE 0 END)::BIGINT AS new, sum(CASE WHEN rank BETWEEN 6 AND 10 THEN round(q * 1000) ELSE 0 END)::BIGINT AS old
  FROM last50 GROUP BY domain)
SELECT d.domain, n AS total_attempts, total_successes / total_scrapes AS success_rate, total / (1000.0::DOUBLE * n) AS avg_quality,
  CASE WHEN n < 10 THEN 'unknown' WHEN new - old > 500 THEN 'improving' WHEN new - old < -500 THEN 'declining' ELSE 'stable' END AS trend,
  coalesce(common_issues, '') AS common_issues,
  array_to_string(list_filter([CASE WHEN total_successes / total_scrapes < 0.5 THEN {q(fv.ADVICE_LOW_SUCCESS)} END,
    CASE WHEN low THEN {q(fv.ADVICE_LOW_FILL)} END], lambda x: x IS NOT NULL), '|') AS recommendations
FROM d JOIN p USING (domain) LEFT JOIN il USING (domain)"""
ORACLE["top_domains"] = f"""
WITH {HIST}, {PROFILES} SELECT domain, total_scrapes, avg_quality, total_successes, total_failures
FROM p ORDER BY total_scrapes DESC, domain LIMIT 10"""

# --- prompts -------------------------------------------------------------------
PROMPTS = """pr AS (SELECT o_orderkey AS id, o_orderdate AS ts, 'c' || (o_custkey % 100) || '.example.org' AS domain,
  o_orderpriority AS schema_name, 'Prefer list ' || o_orderkey AS extra_instructions,
  (floor(o_totalprice)::BIGINT % 600) / 1000 AS baseline, (floor(floor(o_totalprice)::BIGINT / 7)::BIGINT % 1000) / 1000 AS quality,
  o_orderstatus AS st FROM orders),
versions AS (SELECT *, row_number() OVER (PARTITION BY domain, schema_name ORDER BY ts, id) AS version FROM pr),
judged AS (SELECT *, CASE WHEN st = 'O' THEN 'candidate' WHEN quality - baseline >= 0.05 THEN 'accepted' ELSE 'rejected' END AS status FROM versions),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY domain, schema_name ORDER BY quality DESC, version DESC) AS place FROM judged WHERE status = 'accepted') WHERE place = 1)"""
ORACLE["prompt_versions"] = f"""
WITH {PROMPTS} SELECT id, domain, schema_name, row_number() OVER (PARTITION BY domain, schema_name ORDER BY (st = 'F') DESC, ts, id) AS version, 'candidate' AS status FROM pr"""
ORACLE["prompt_decisions"] = f"""
WITH {PROMPTS} SELECT id, status, CASE WHEN st = 'O' THEN -1.0::DOUBLE ELSE quality END AS candidate_quality FROM judged"""
ORACLE["best_prompts"] = f"WITH {PROMPTS} SELECT domain, schema_name, id, version, quality AS candidate_quality, extra_instructions FROM best"
ORACLE["prompt_rollback"] = f"""
WITH {PROMPTS} SELECT id, CASE WHEN st = 'F' AND status = 'accepted' THEN 'rolled_back' ELSE status END AS status FROM judged"""
ORACLE["prompt_usage"] = f"""
WITH {PROMPTS}, uses AS (SELECT domain, schema_name, count(*) AS n FROM pr GROUP BY ALL)
SELECT judged.id, CASE WHEN best.id IS NOT NULL THEN uses.n ELSE 0 END::BIGINT AS times_used
FROM judged LEFT JOIN best ON best.id = judged.id LEFT JOIN uses ON uses.domain = best.domain AND uses.schema_name = best.schema_name"""
ORACLE["prompt_import"] = f"""
WITH {PROMPTS}, v AS (SELECT *, row_number() OVER (PARTITION BY domain, schema_name ORDER BY (st = 'P'), ts, id) AS place FROM pr)
SELECT id, place AS version, 'accepted' AS status, quality AS baseline_quality, quality AS candidate_quality, 0.0::DOUBLE AS minimum_improvement
FROM v WHERE st = 'P'"""

# --- cleaning rules ------------------------------------------------------------
EVIDENCE = f"""ev AS (SELECT {DOMAIN} AS domain, {at("event_id % 7", "class", "class", "id", "class", "tag", "class", "xpath")} AS rule_type,
  event_type AS selector, ts, event_id AS id, 'seen ' || (event_id % 13) AS reason, 'count=' || floor(value / 8)::BIGINT AS evidence,
  0.05::DOUBLE + (event_id % 5) * 0.1::DOUBLE AS confidence, event_type = 'signup' AND user_id % 4 = 0 AS explicit FROM events),
grp AS (SELECT domain, rule_type, selector, count(*) AS n, list(confidence ORDER BY ts, id) AS cs, bool_or(explicit) AS any_explicit,
  first(explicit ORDER BY ts, id) AS first_explicit, last(reason ORDER BY ts, id) AS reason, list([evidence] ORDER BY ts, id) AS es,
  min(ts) AS created, first(id ORDER BY ts, id) AS first_id FROM ev WHERE rule_type <> 'xpath' GROUP BY ALL),
folded AS (SELECT *, list_reduce(cs, lambda a, c: 1 - (1 - a) * (1 - c)) AS conf,
  n + first_explicit::INTEGER AS evidence_count,
  list_reduce(es, lambda l, e: CASE WHEN list_contains(l, e[1]) THEN l WHEN len(l) < 10 THEN l || e ELSE l[2:] || e END) AS kept,
  row_number() OVER (ORDER BY created, first_id) AS id FROM grp),
made AS (SELECT *, CASE WHEN any_explicit THEN 'active' WHEN n >= 2 AND conf >= 0.7 THEN 'active' ELSE 'candidate' END AS status FROM folded)"""
ORACLE["rule_evidence"] = f"""
WITH {EVIDENCE} SELECT id, domain, rule_type, selector, round(conf, 6) AS confidence, evidence_count::BIGINT AS evidence_count, status, reason,
  array_to_string(kept, ',') AS evidence, epoch_us(created) AS created_us FROM made"""
ORACLE["legacy_rules_import"] = f"""
WITH {EVIDENCE} SELECT id, domain, rule_type, selector, 'candidate' AS status, 0::BIGINT AS evidence_count,
  CASE WHEN id % 11 = 5 THEN '' ELSE evidence || '|' || reason END AS evidence,
  (epoch_us(ts) // 1000000)::BIGINT AS created_second, true AS never_updated,
  CASE WHEN rule_type NOT IN ('class', 'id', 'tag') THEN 'unsupported rule type' WHEN id % 11 = 5 THEN 'evidence is no list' END AS rejected FROM ev"""
ORACLE["rule_evidence_continued"] = ORACLE["rule_evidence"]
ORACLE["recovered_run"] = """
SELECT page_id, CASE WHEN k IN (0, 4) THEN 3 WHEN k IN (1, 2, 3) THEN 2 ELSE 1 END::BIGINT AS asks,
  CASE WHEN k IN (0, 1, 3, 4) THEN 25000 ELSE 50000 END::BIGINT AS content_limit, CASE WHEN k IN (2, 4) THEN 'second-model' END AS model,
  CASE k WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END::BIGINT AS failures,
  CASE k WHEN 0 THEN 'partial_recovery:1,partial_recovery:2,escalation_required' WHEN 4 THEN 'partial_recovery:1,recovered:1'
    WHEN 1 THEN 'recovered:1' WHEN 2 THEN 'recovered:1' WHEN 3 THEN 'recovered:1' ELSE '' END AS results,
  -- A try is opened, its steps (two, or three at the provider) are taken, and it ends; a spent budget makes two events.
  CASE k WHEN 0 THEN 4 + 4 + 2 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 3 THEN 4 WHEN 4 THEN 4 + 5 ELSE 0 END::BIGINT AS events,
  CASE WHEN k = 0 THEN 0 ELSE 1 END::BIGINT AS records, CASE WHEN k = 0 THEN 'LLMParseError' END AS error_type
FROM (SELECT page_id, page_id % 7 AS k FROM pages)"""
_hint = "'Look for the author below the headline.'"
ORACLE["refinement_chain"] = f"""
WITH {TEXTS}, p AS (SELECT page_id, domain, page_id % 6 <> 0 AS weak, page_id % 5 AS k FROM t WHERE length(text) >= 50),
c AS (SELECT *, weak AND k NOT IN (2, 3) AS tried, weak AND k IN (0, 4) AS good FROM p),
v AS (SELECT page_id, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS version FROM c WHERE good)
SELECT page_id, weak, tried, good AS accepted,
  CASE WHEN weak THEN CASE k WHEN 1 THEN 'Look closer.' WHEN 2 THEN 'LLMExtractionError' WHEN 3 THEN 'LLMProviderError' ELSE {_hint} END END AS written,
  CASE WHEN good THEN {_hint} WHEN tried THEN {q(fv.RETRY_INSTRUCTIONS["LOW_FILL_RATE"])} END AS told, version::BIGINT AS version,
  CASE WHEN good THEN 'accepted' END AS status, CASE WHEN good THEN {_hint} END AS extra_instructions, CASE WHEN good THEN 6.0::DOUBLE END AS latency_ms,
  CASE WHEN good THEN 27 END::BIGINT AS input_tokens, CASE WHEN good THEN 5 END::BIGINT AS output_tokens,
  CASE WHEN NOT weak THEN 4 WHEN good THEN 3 ELSE 1 END::BIGINT AS fields
FROM c LEFT JOIN v USING (page_id)"""
ORACLE["rejected_evidence"] = f"""
WITH {EVIDENCE} SELECT domain, rule_type, count(*) AS n FROM ev WHERE rule_type = 'xpath' GROUP BY ALL"""
ORACLE["active_rules"] = f"""
WITH {EVIDENCE} SELECT id, domain, rule_type, selector FROM made WHERE status = 'active'"""

ORACLE["rule_outcomes"] = f"""
WITH RECURSIVE r AS (SELECT DISTINCT user_id AS id, {at("user_id % 4", "active", "candidate", "active", "active")} AS status, user_id % 3 AS times,
  CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS pos, user_id % 3 AS neg FROM events),
o AS (SELECT user_id AS id, {SCORE} AS q, (event_id * 37 % 300) / 1000 AS b, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk AS (SELECT id, 0::BIGINT AS rn, status, times::BIGINT AS times, pos::BIGINT AS pos, neg::BIGINT AS neg, NULL::DOUBLE AS last FROM r
  UNION ALL
  SELECT walk.id, o.rn, CASE WHEN walk.status = 'active' AND walk.times + 1 >= 2 AND walk.pos + (q >= b + 0.02)::INTEGER = 0
      AND walk.neg + (q < b - 0.05)::INTEGER >= 2 THEN 'disabled' ELSE walk.status END,
    walk.times + 1, walk.pos + (q >= b + 0.02)::INTEGER, walk.neg + (q < b - 0.05)::INTEGER, q
  FROM walk JOIN o ON o.id = walk.id AND o.rn = walk.rn + 1)
SELECT id, arg_max(status, rn) AS status, max(times) AS times_applied, max(pos) AS positive_outcomes, max(neg) AS negative_outcomes,
  arg_max(last, rn) AS last_quality FROM walk GROUP BY id"""
ORACLE["disabled_rules"] = f"""
WITH r AS (SELECT DISTINCT user_id AS id, {at("user_id % 4", "active", "candidate", "active", "active")} AS status FROM events),
bad AS (SELECT DISTINCT user_id AS id FROM events WHERE {SCORE} > 0.5)
SELECT id, CASE WHEN id IN (SELECT id FROM bad) THEN 'disabled' ELSE status END AS status FROM r"""

ORACLE["rule_proposals"] = f"""
SELECT page_id, {URL_DOMAIN} AS domain, 'promo-card' AS selector, 'class=promo-card;count=2' AS evidence,
  0.45::DOUBLE + 2 * 0.05::DOUBLE AS confidence, {q(fv.NOISE_REASON)} AS reason
FROM pages WHERE page_id % 8 = 6 AND page_id % 3 = 0 AND contains(html, '<article>')"""
_ads = """len(regexp_extract_all(html, 'class="ad"'))"""
ORACLE["rule_proposals_single"] = f"""
SELECT page_id, {URL_DOMAIN} AS domain, 'ad' AS selector, 'class=ad;count=' || {_ads} AS evidence,
  least(0.8::DOUBLE, 0.45::DOUBLE + {_ads} * 0.05::DOUBLE) AS confidence FROM pages WHERE page_id % 3 = 0 AND {_ads} > 0"""
ORACLE["rule_learning"] = f"""
WITH f AS ({ORACLE["rule_proposals_single"]})
SELECT domain, selector, count(*) AS evidence_count,
  round(list_reduce(list(confidence ORDER BY page_id), lambda a, c: 1 - (1 - a) * (1 - c)), 6) AS confidence,
  CASE WHEN count(*) >= 2 AND list_reduce(list(confidence ORDER BY page_id), lambda a, c: 1 - (1 - a) * (1 - c)) >= 0.7 THEN 'active' ELSE 'candidate' END AS status
FROM f GROUP BY domain, selector"""
ORACLE["rule_outcome_rows"] = f"""
WITH {PAGE_QUALITY}, used AS (
  SELECT page_id, domain, unnest(string_split(applied_rule_ids, ','))::BIGINT AS rule_id
  FROM ({ORACLE["clean_with_learned_rules"]}) JOIN (SELECT page_id, {URL_DOMAIN} AS domain FROM pages) USING (page_id) WHERE applied_rule_ids <> ''),
before AS (SELECT {URL_DOMAIN} AS domain, count(*) / 100 AS avg_quality FROM pages GROUP BY 1 HAVING count(*) > 3)
SELECT rule_id, page_id, score AS quality, coalesce(avg_quality, score) AS baseline_quality
FROM used JOIN pq USING (page_id) LEFT JOIN before USING (domain)"""

ORACLE["memory_stats"] = f"""
WITH {HIST}, {PROMPTS}, {EVIDENCE}
SELECT (SELECT count(*) FROM h) AS total_scrapes, (SELECT count(DISTINCT domain) FROM h) AS unique_domains,
  (SELECT sum(round(q * 1000)::BIGINT)::BIGINT / (1000.0::DOUBLE * count(*)) FROM h) AS avg_quality,
  (SELECT count(*) FROM judged WHERE status = 'accepted') AS total_refinements,
  (SELECT count(*) FROM judged WHERE status = 'candidate') AS candidate_refinements,
  (SELECT count(*) FROM made WHERE status = 'active') AS active_cleaning_rules,
  (SELECT count(*) FROM events WHERE event_type = 'purchase') AS total_feedback"""

ORACLE["page_settings"] = f"""
WITH {HIST}, {PROFILES}, {PROMPTS}, {EVIDENCE.replace("id, 'seen '", "id, 'seen '")},
pg AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'd' || (user_id % 60) || '.example.org' ELSE 'c' || (user_id % 120) || '.example.org' END AS domain FROM events),
nr AS (SELECT domain, count(*) AS n FROM made WHERE status = 'active' GROUP BY domain)
SELECT event_id, coalesce(wait_seconds, 4.0::DOUBLE) AS wait_seconds, p.domain IS NOT NULL AS learned,
  coalesce(best.extra_instructions, '') AS extra_instructions, coalesce(nr.n, 0)::BIGINT AS n_rules
FROM pg LEFT JOIN p USING (domain) LEFT JOIN (SELECT * FROM best WHERE schema_name = '1-URGENT') best USING (domain) LEFT JOIN nr USING (domain)"""

# --- failures ------------------------------------------------------------------
_types = [
    "TimeoutError", "RateLimitError", "LLMParseError", "LLMExtractionError", "LLMProviderError",
    "UnsupportedChallengeError", "EmptyPageError", "BrowserCrashedError", "HTTPError",
    "ConnectionResetError", "RuntimeError",
]
_recipes = " UNION ALL ".join(
    f"SELECT {q(s)} AS scenario, {n} AS max_attempts, {q(policy)} AS policy, {q(','.join(x for x, _, _ in steps))} AS steps"
    for s, (n, policy, steps) in fv.RECIPES.items()
)
FAILURES = f"""fa AS (SELECT 'job-' || user_id AS job_id, event_id AS id, ts, {at("event_id % 11", *_types)} AS error_type,
  CASE WHEN event_id % 11 IN (8, 10) THEN ([NULL, 429, 408, 503, 404, NULL])[event_id % 6 + 1] END AS status,
  (['cloudflare', 'captcha', 'aws_waf'])[event_id % 3 + 1] AS challenge, (['llm', 'browser'])[event_id % 2 + 1] AS component,
  ([true, false, NULL, true])[event_id % 4 + 1] AS retry_ok, event_id % 5 = 1 AS large FROM events WHERE event_type = 'error'),
recipes AS ({_recipes}),
sc AS (SELECT *, CASE error_type
  WHEN 'TimeoutError' THEN 'network_timeout' WHEN 'ConnectionResetError' THEN 'network_timeout' WHEN 'RateLimitError' THEN 'rate_limited'
  WHEN 'LLMParseError' THEN 'json_parse_error' WHEN 'LLMExtractionError' THEN 'llm_extraction_failed' WHEN 'LLMProviderError' THEN 'llm_provider_error'
  WHEN 'EmptyPageError' THEN 'empty_page' WHEN 'BrowserCrashedError' THEN 'browser_crash'
  WHEN 'UnsupportedChallengeError' THEN CASE challenge WHEN 'cloudflare' THEN 'cloudflare_challenge' ELSE 'captcha_blocked' END
  ELSE CASE WHEN status = 429 THEN 'rate_limited' WHEN status = 408 THEN 'network_timeout'
    WHEN status = 503 AND component = 'llm' THEN 'llm_provider_error' ELSE 'unknown' END END AS scenario FROM fa),
pl AS (SELECT *, steps LIKE 'skip%' AS skipped, scenario = 'llm_provider_error' AND large AS stuck FROM sc JOIN recipes USING (scenario)),
-- A verified success starts a new count; a count that passed the maximum never ends.
g AS (SELECT *, NOT skipped AND NOT stuck AND coalesce(retry_ok, false) AS resets FROM pl),
g2 AS (SELECT *, coalesce(sum(resets::INTEGER) OVER (PARTITION BY job_id, scenario ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM g),
g3 AS (SELECT *, row_number() OVER (PARTITION BY job_id, scenario, turn ORDER BY ts, id) AS place FROM g2),
g4 AS (SELECT *, bool_or(place > max_attempts) OVER (PARTITION BY job_id, scenario ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spent FROM g3),
tried AS (SELECT *, CASE WHEN spent THEN 0 ELSE place END AS attempt FROM g4),
plan AS (SELECT *,
  CASE WHEN attempt = 0 THEN 0.0 WHEN scenario = 'network_timeout' THEN least(2 * pow(2, attempt - 1), 30)
    WHEN scenario = 'llm_provider_error' THEN least(pow(2, attempt - 1), 15) WHEN scenario = 'rate_limited' THEN 60 ELSE 0 END::DOUBLE AS delay,
  CASE WHEN attempt = 0 OR skipped THEN 'escalation_required' WHEN stuck THEN 'partial_recovery' WHEN retry_ok THEN 'recovered'
    WHEN NOT retry_ok THEN 'partial_recovery' ELSE 'retry_ready' END AS result,
  CASE WHEN attempt = 0 THEN 'Max attempts (' || max_attempts || ') exhausted for ' || scenario
    WHEN skipped THEN 'Automatic challenge handling is disabled by policy' WHEN stuck THEN 'Fallback model is already active'
    WHEN NOT coalesce(retry_ok, true) THEN 'Retry failed with RuntimeError' ELSE '' END AS reason FROM tried)"""
ORACLE["failure_scenarios"] = f"WITH {FAILURES} SELECT id, coalesce(CASE WHEN error_type IN ('HTTPError', 'RuntimeError') THEN status END, 0)::BIGINT AS status, scenario FROM sc"
ORACLE["failure_recipes"] = f"WITH {FAILURES} SELECT id, scenario, max_attempts::BIGINT AS max_attempts, policy, steps FROM pl"
ORACLE["recovery_attempts"] = f"WITH {FAILURES} SELECT id, scenario, attempt::BIGINT AS attempt FROM plan"
ORACLE["recovery_delays"] = f"WITH {FAILURES} SELECT id, delay FROM plan"
ORACLE["recovery_settings"] = f"""
WITH {FAILURES} SELECT id, CASE WHEN attempt > 0 AND scenario = 'empty_page' THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS wait_added,
  CASE WHEN attempt > 0 AND scenario IN ('json_parse_error', 'llm_extraction_failed') THEN 25000 ELSE 0 END::BIGINT AS content_chars,
  CASE WHEN attempt > 0 AND scenario = 'llm_provider_error' AND NOT large THEN 'large' ELSE '' END AS next_model FROM plan"""
ORACLE["recovery_results"] = f"""
WITH {FAILURES} SELECT id, result, CASE WHEN attempt = 0 OR skipped THEN 0 WHEN stuck THEN 1 ELSE len(string_split(steps, ',')) END::BIGINT AS steps_taken,
  CASE WHEN attempt > 0 AND stuck THEN 1 ELSE 0 END::BIGINT AS steps_remaining, reason FROM plan"""

_detail = f"""CASE step WHEN 'retry_with_backoff' THEN printf('Waited %.1fs', delay) WHEN 'wait_cooldown' THEN printf('Waited %.1fs', delay)
  WHEN 'retry_with_fallback_model' THEN CASE WHEN stuck THEN 'Fallback model is already active' ELSE 'Fallback model selected' END
  {" ".join(f"WHEN {q(s)} THEN {q(t)}" for s, t in fv.STEP_DETAILS.items() if s != "retry_with_fallback_model")} END"""
EVENTS = f"""{FAILURES},
walked AS (SELECT *, unnest(string_split(steps, ',')) AS step, generate_subscripts(string_split(steps, ','), 1) AS pos FROM plan WHERE attempt > 0),
taken AS (SELECT * FROM walked WHERE NOT (stuck AND pos > 2)),
evs AS (
  SELECT ts, id, 0 AS seq, 'recovery.attempted' AS event, scenario, '' AS step, CASE WHEN attempt = 0 THEN result ELSE '' END AS result,
    CASE WHEN attempt = 0 THEN reason ELSE 'Attempt ' || attempt || '/' || max_attempts || ' for job ' || job_id END AS detail FROM plan
  UNION ALL SELECT ts, id, 1, 'recovery.escalated', scenario, '', result, policy FROM plan WHERE attempt = 0
  UNION ALL SELECT ts, id, pos, CASE WHEN skipped THEN 'recovery.step.skipped_by_policy' WHEN stuck AND pos = 2 THEN 'recovery.step.unsupported' ELSE 'recovery.step.applied' END,
    scenario, step, '', {_detail} FROM taken
  UNION ALL SELECT ts, id, CASE WHEN stuck THEN 3 ELSE len(string_split(steps, ',')) + 1 END,
    CASE result WHEN 'recovered' THEN 'recovery.succeeded' WHEN 'partial_recovery' THEN 'recovery.failed' ELSE 'recovery.escalated' END,
    scenario, '', result, CASE result WHEN 'recovered' THEN 'Subsequent retry completed successfully' ELSE reason END
    FROM plan WHERE attempt > 0 AND result <> 'retry_ready')"""
ORACLE["recovery_events"] = f"WITH {EVENTS} SELECT id, seq::BIGINT AS seq, event, scenario, step, result, detail FROM evs"
ORACLE["recovery_stats"] = f"""
WITH {EVENTS} SELECT count(*) AS total_events, count(*) FILTER (event = 'recovery.succeeded') AS verified_recoveries,
  count(*) FILTER (event = 'recovery.escalated') AS escalations FROM evs"""
ORACLE["latest_recovery_events"] = f"""
WITH {EVENTS} SELECT id, seq::BIGINT AS seq, event, detail FROM evs ORDER BY ts DESC, id DESC, seq DESC LIMIT 10"""

# --- command audit -------------------------------------------------------------
# One line per kind of command in the log: text, first word, intent, and the verdict
# (action, check, reason) in each mode.
_K = fv.AUDIT_REASONS
_ok = ("allow", "", "")


def _block(check, reason):
    return ("block", check, reason)


def _same(check, reason):
    return [("block", check, reason), ("block", check, reason), ("warn", check, reason)]


_destroys = lambda reason: _same("destructive_check", reason)
_pattern = lambda i: _destroys(_K["destructive_pattern"].format(fv.DESTRUCTIVE_PATTERNS[i][1]))
_ro = lambda key, *a: _block("read_only_check", _K[key].format(*a))
AUDIT = [
    ("git status", "git", "read_only", [_ok] * 3),
    ("touch notes-{u}.txt", "touch", "write", [_ro("write_command", "touch"), _ok, _ok]),
    ("rm -rf /", "rm", "destructive", _pattern(0)),
    ("ls -la | grep {u}", "ls", "read_only", [_ok] * 3),
    ("sudo -E apt-get install pkg{u}", "sudo", "package_management", [_ro("state_command", "apt-get"), _ok, _ok]),
    ("env A=1 B={u} python run.py", "python", "unknown", [_ok] * 3),
    ("cp a ../up-{u}", "cp", "write", [_ro("write_command", "cp"), _block("path_validation", _K["traversal"]), ("warn", "path_validation", _K["traversal"])]),
    ("cat ~/file-{u}", "cat", "read_only", _same("path_validation", _K["home"])),
    ("sed -i s/a/b/ f{u}", "sed", "write", [_block("sed_validation", _K["sed_in_place"]), _ok, _ok]),
    ("curl https://example.org/{u} > out", "curl", "network", [_ro("redirection", ">"), _ok, _ok]),
    ("kill {u}", "kill", "process_management", [_ro("state_command", "kill"), _ok, _ok]),
    ("git commit -m 'fix {u}'", "git", "write", [_ok] * 3),
    ("git -p push origin", "git", "network", [_ok] * 3),
    ("shred disk{u}", "shred", "destructive", _destroys(_K["always_destructive"].format("shred"))),
    ("echo {u} && rm x", "echo", "read_only", [_ok] * 3),
    ("'my tool' --n {u}", "my tool", "unknown", [_ok] * 3),
    ("cp /etc/hosts h{u}", "cp", "write", [_ro("write_command", "cp"), _block("workspace_boundary", _K["system_path"].format("/etc/")), _ok]),
    ("  ", "", "read_only", [("allow", "", _K["empty"])] * 3),
    ("node app{u}.js", "node", "unknown", [_block("custom_blocklist", _K["custom_blocklist"].format("node"))] * 3),
    ("dd if=/dev/zero of=f{u}", "dd", "write", _pattern(5)),
    ("sudo cat /etc/passwd", "sudo", "read_only", [_ok] * 3),
    ('echo "open {u}', "echo", "read_only", [_ok] * 3),
    ("find . -name f{u} -delete; ls", "find", "read_only", [_ok] * 3),
    ("rm -r -f dir{u}", "rm", "destructive", _destroys(_K["recursive_deletion"])),
    ("chmod -R 777 d{u}", "chmod", "write", _pattern(7)),
    ("head ../../shared/{u}", "head", "read_only", _same("path_validation", _K["traversal"])),
    ("sudo", "sudo", "system_admin", [_ok] * 3),
    ("git", "git", "read_only", [_ok] * 3),
]
_verdict_rows = " UNION ALL ".join(
    f"SELECT {i} AS kind, {q(mode)} AS mode, {q(first)} AS first_command, {q(intent)} AS plain_intent, "
    f"{q('destructive' if v[1] == 'destructive_check' else intent)} AS intent, "
    f"{q(v[0])} AS action, {q(v[1])} AS failed_check, {q(v[2])} AS reason"
    for i, (_, first, intent, verdicts) in enumerate(AUDIT)
    for mode, v in zip(("read_only", "workspace_write", "full"), verdicts)
)
COMMANDS = f"""known AS ({_verdict_rows}),
log AS (SELECT event_id AS id, event_id % 28 AS kind, (['read_only', 'workspace_write', 'full'])[floor(event_id / 28)::BIGINT % 3 + 1] AS mode FROM events),
v AS (SELECT * FROM log JOIN known USING (kind, mode))"""
# An empty command is read-only to the verdict and unknown to the plain classifier.
ORACLE["command_intents"] = f"""
WITH {COMMANDS} SELECT id, first_command, CASE WHEN first_command = '' THEN 'unknown' ELSE plain_intent END AS intent FROM v"""
ORACLE["command_verdicts"] = f"WITH {COMMANDS} SELECT id, intent, action, failed_check, reason FROM v"
ORACLE["command_totals"] = f"""
WITH {COMMANDS} SELECT mode, count(*) AS total_validations, count(*) FILTER (action = 'block') AS blocked,
  count(*) FILTER (action = 'warn') AS warnings, count(*) FILTER (action = 'allow') AS allowed FROM v GROUP BY mode"""
