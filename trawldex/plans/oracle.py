"""The registered queries as DuckDB SQL, built on shared WITH clauses."""

from __future__ import annotations

from trawldex.operators.analyzer import lexicon_rows

#: The settings and patterns that the queries are to follow, spelled out here so that a wrong one in the code shows.
QUERY, MOST, RADIUS = "the is that zzzz", 0.95, 3
STOP_POS = ["PREP", "CONJ", "INTJ"]
_HIDDEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
_TAG = r"<[^>]*>"
_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
_LINK = '(?i)<a\\s(?:[^>]*[\\s\\"\'])?href\\s*=\\s*(?:\\"([^\\"]*)\\"|\'([^\']*)\'|([^\\s\\"\'>]+))'
_INLINE = r"</?(?:b|i|t|em|strong|font|a|br)(?:>| [^>]+>)"
_HTTP_URL = r"^https?://(www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b([-a-zA-Z0-9()@:%_\+.~#?&//=]*)$"
_ENTITIES = [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&#39;", "'"), ("&amp;", "&")]


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _decode(x: str) -> str:
    for name, value in _ENTITIES:
        x = f"replace({x}, {_text(name)}, {_text(value)})"
    return x


_TOKENS = r"""list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace({0}, '[^\p{{L}} -]', '', 'g'), '[^\p{{L}}]-[^\p{{L}}]', '', 'g'), ' {{2,}}', ' ', 'g')), ' '), lambda w: w NOT IN ('', '-', '--'))"""
_FILE = r"[.](?:[^h/][^/]*|h|h[^t/][^/]*|ht|ht[^m/][^/]*)$"
_STOP = ", ".join(map(_text, STOP_POS))

_ENDINGS = "(VALUES ('s', 'NOUN'), ('e', 'ADJ'), ('n', 'VERB'), ('en', 'VERB'), ('er', 'NOUN'), ('er', 'ADJ'), ('ment', 'ADV')) AS e(e, pos_tag)"

_CTE = {
    "raw": ("", "SELECT *, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site FROM pages"),
    "pg": ("raw", rf"""SELECT site, page_id, url, CASE WHEN url = site THEN '/' ELSE replace(url, site, '') END AS path,
        {_decode(f"regexp_extract(html, {_text(_TITLE)}, 1)")} AS title, html,
        ltrim(regexp_replace(translate({_decode(f"regexp_replace(regexp_replace(html, {_text(_HIDDEN)}, '', 'g'), {_text(_TAG)}, ' ', 'g')")}, chr(10) || chr(9), '  '), ' {{2,}}', ' ', 'g'), ' ') AS content FROM raw"""),
    "ok": ("pg", "SELECT * FROM pg WHERE site <> '' AND content <> ''"),
    "tk": ("ok", f"SELECT site, page_id, {_TOKENS.format('content')} AS words FROM ok"),
    "w": ("tk", "SELECT site, page_id, CAST(unnest(range(len(words))) AS INTEGER) AS pos, unnest(words) AS word FROM tk"),
    "lex": ("", "SELECT * FROM (VALUES " + ", ".join(f"({_text(a)}, {_text(b)}, {_text(c)})" for a, b, c in lexicon_rows()) + ") AS t(word, base_form, pos_tag)"),
    "an": ("w lex", "SELECT w.*, coalesce(base_form, w.word) AS lemma, coalesce(pos_tag, '') AS pos_tag FROM w LEFT JOIN lex ON lex.word = w.word"),
    "lm": ("an", f"SELECT site, page_id, pos, word, lemma FROM an WHERE pos_tag NOT IN ({_STOP})"),
    "tf": ("lm", "SELECT site, page_id, lemma, CAST(count(*) AS DOUBLE) AS rank FROM lm GROUP BY ALL"),
    "df": ("tf", "SELECT site, lemma, count(*) AS frequency FROM tf GROUP BY ALL"),
    "qt": ("", f"SELECT unnest({_TOKENS.format(_text(QUERY))}) AS word"),
    "q": ("qt lex", f"SELECT DISTINCT coalesce(base_form, qt.word) AS lemma FROM qt LEFT JOIN lex ON lex.word = qt.word WHERE coalesce(pos_tag, '') NOT IN ({_STOP})"),
    "np": ("ok", "SELECT site, count(*) AS n_pages FROM ok GROUP BY site"),
    "kept": ("df np q", f"SELECT site, lemma FROM df JOIN np USING (site) WHERE lemma IN (SELECT lemma FROM q) AND CAST(frequency AS DOUBLE) / n_pages <= {MOST}"),
    "hit": ("tf kept", "SELECT site, page_id, count(*) AS n, sum(rank) AS total, max(rank) AS top FROM tf JOIN kept USING (site, lemma) GROUP BY site, page_id"),
    "sc": ("hit kept", "SELECT site, page_id, total / top AS relevance FROM hit JOIN (SELECT site, count(*) AS k FROM kept GROUP BY site) USING (site) WHERE n = k"),
    "res": ("sc ok", "SELECT sc.site, sc.page_id, path AS uri, title, floor(relevance * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS relevance FROM sc JOIN ok USING (page_id)"),
    "one": ("raw", "SELECT arg_min(site, page_id) AS site, min(page_id) AS page_id FROM raw"),
    "ln": ("raw", rf"""SELECT site, page_id, url, unnest(list_transform(regexp_extract_all(html, {_text(_LINK)}, 0), lambda x: regexp_extract(x, {_text(_LINK)}, 1) || regexp_extract(x, {_text(_LINK)}, 2) || regexp_extract(x, {_text(_LINK)}, 3))) AS href FROM raw"""),
    "nl": ("ln", rf"""SELECT *, CASE WHEN contains(l, '?') THEN split_part(l, '?', 1) WHEN strpos(l, '#') > 1 THEN split_part(l, '#', 1) ELSE l END AS link FROM (
        SELECT *, CASE WHEN starts_with(h, '/') THEN regexp_replace(site, '/$', '') || h ELSE h END AS l FROM (
        SELECT *, CASE WHEN href = '/' OR regexp_matches(href, '{_FILE}') THEN site ELSE href END AS h FROM ln))"""),
    "bd": ("", f"SELECT page_id, replace(regexp_replace(html, {_text(_INLINE)}, '', 'g'), chr(10), ' ') AS body FROM pages"),
    "mw": ("lm q", "SELECT page_id, word, min(pos) AS first_pos FROM lm WHERE lemma IN (SELECT lemma FROM q) GROUP BY page_id, word"),
    "cfg": ("raw", "SELECT url, regexp_replace(url, '^https?://', '') AS name FROM (SELECT DISTINCT site AS url FROM raw UNION ALL SELECT 'http://never.example.com')"),
    "rv": ("ok", "SELECT site, page_id, concat_ws(' ', title, title) AS content FROM ok WHERE (site, page_id) IN (SELECT (site, min(page_id)) FROM ok GROUP BY site)"),
    "rw": ("rv", f"SELECT site, page_id, unnest({_TOKENS.format('content')}) AS word FROM rv"),
    "rt": ("rw lex", f"SELECT site, page_id, coalesce(base_form, rw.word) AS lemma, CAST(count(*) AS DOUBLE) AS rank FROM rw LEFT JOIN lex ON lex.word = rw.word WHERE coalesce(pos_tag, '') NOT IN ({_STOP}) GROUP BY ALL"),
    "dk": ("", f"SELECT source AS site, doc_id AS page_id, unnest({_TOKENS.format('text')}) AS word FROM documents WHERE text <> ''"),
    "vw": ("dk", "SELECT DISTINCT word FROM dk"),
    "dl": ("vw", f"SELECT v.word, b.word AS base_form, pos_tag FROM vw v JOIN {_ENDINGS} ON ends_with(v.word, e) JOIN vw b ON b.word = left(v.word, length(v.word) - length(e)) WHERE length(b.word) >= 4"),
    "dt": ("dk lex", f"SELECT site, page_id, coalesce(base_form, dk.word) AS lemma, CAST(count(*) AS DOUBLE) AS rank FROM dk LEFT JOIN lex ON lex.word = dk.word WHERE coalesce(pos_tag, '') NOT IN ({_STOP}) GROUP BY ALL"),
}


def _with(uses: str, body: str, recursive: str = "") -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in _CTE[name][0].split():
                visit(other)
            order.append(name)

    for name in uses.split():
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({_CTE[n][1]})" for n in order] + ([recursive] if recursive else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body if parts else body



def _taught(lexicon: str) -> str:
    """CTEs `nd` (suffix, rules) that the entries of a relation teach."""
    return f"""ru AS (SELECT word, length(word) - stem AS strip, substr(base_form, stem + 1) AS ending, pos_tag FROM (SELECT DISTINCT word, base_form, pos_tag,
        len(list_filter(range(1, least(length(word), length(base_form)) + 1), lambda i: substr(word, 1, i) = substr(base_form, 1, i))) AS stem FROM {lexicon}) WHERE stem >= 2 AND length(word) - stem <= 8),
    sx AS (SELECT *, unnest(range(greatest(strip, 1), least(length(word), 8) + 1)) AS k FROM ru),
    ct AS (SELECT right(word, k) AS suffix, strip, ending, pos_tag, count(*) AS n FROM sx GROUP BY ALL),
    kp AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY suffix) AS most FROM ct) WHERE n >= 2 AND n >= most * 0.25),
    nx AS (SELECT suffix, list({{'strip': strip, 'ending': ending, 'pos_tag': pos_tag}} ORDER BY strip, ending, pos_tag) AS rules FROM kp GROUP BY suffix),
    nd AS MATERIALIZED (SELECT a.suffix, a.rules FROM nx a LEFT JOIN nx b ON b.suffix = right(a.suffix, length(a.suffix) - 1) WHERE b.rules IS NULL OR b.rules <> a.rules)"""


def _guessed(words: str) -> str:
    """CTE `gs` (word, lemma, pos_tag) of distinct words."""
    return f"""cd AS (SELECT word, unnest(range(1, least(length(word), 8) + 1)) AS k FROM {words}),
    bs AS (SELECT word, arg_max(rules, k) AS rules FROM cd JOIN nd ON nd.suffix = right(word, k) GROUP BY word),
    us AS (SELECT u.word, list_filter(coalesce(rules, []), lambda r: length(u.word) - r.strip >= 2) AS rules FROM {words} u LEFT JOIN bs USING (word)),
    gs AS MATERIALIZED (SELECT word, substr(word, 1, length(word) - r.strip) || r.ending AS lemma, r.pos_tag AS pos_tag FROM (SELECT word, unnest(rules) AS r FROM us) UNION ALL SELECT word, word, NULL FROM us WHERE len(rules) = 0)"""


def _key(u: str) -> str:
    return f"CASE WHEN length({u}) <= 1 OR ends_with({u}, '/') THEN {u} ELSE {u} || '/' END"


def sql() -> dict[str, str]:
    at = "CAST(1704164645000 AS BIGINT)"
    page = "SELECT site, page_id, uri, title, relevance FROM res"
    order = "ORDER BY relevance DESC, site, page_id"
    return {
        "build_index": _with("ok df tf", "SELECT 'pages' AS name, count(*) AS n FROM ok UNION ALL SELECT 'lemmas', count(*) FROM df UNION ALL SELECT 'postings', count(*) FROM tf"),
        "crawl_links": _with("nl", "SELECT site, node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY site, node", f"""ed AS MATERIALIZED (SELECT DISTINCT site, {_key('url')} AS src, {_key('link')} AS dst FROM nl WHERE contains(link, site) AND {_key('url')} <> {_key('link')}),
            r(site, node, depth) AS (SELECT site, {_key('arg_min(url, page_id)')}, 0 FROM raw GROUP BY site UNION SELECT r.site, dst, depth + 1 FROM r JOIN ed ON ed.site = r.site AND src = node WHERE depth < 30)"""),
        "scan_pages": "SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS n_bytes FROM pages",
        "pages_of_site": _with("raw one", "SELECT site, page_id, url FROM raw WHERE site = (SELECT site FROM one)"),
        "site_by_url": _with("raw one", "SELECT DISTINCT site FROM raw WHERE site = (SELECT site FROM one)"),
        "page_path": _with("pg", "SELECT page_id, path FROM pg"),
        "page_by_path": _with("pg one", "SELECT site, path, page_id FROM pg WHERE (site, path) = (SELECT (site, path) FROM pg WHERE page_id = (SELECT page_id FROM one))"),
        "page_title": _with("pg", "SELECT page_id, title FROM pg"),
        "page_text": _with("ok", "SELECT page_id, content FROM ok"),
        "markup_text": _with("ok", "SELECT page_id, content AS text, title FROM ok"),
        "page_markup": "SELECT page_id, replace(replace(replace(replace(replace(html, '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&#39;', chr(39)) AS markup FROM pages",
        "strip_inline_tags": f"SELECT page_id, replace(regexp_replace(html, {_text(_INLINE)}, '', 'g'), chr(10), ' ') AS stripped FROM pages",
        "extract_links": _with("ln", "SELECT page_id, href FROM ln"),
        "normalize_url": _with("nl", "SELECT page_id, href, link FROM nl"),
        "is_file_link": _with("ln", f"SELECT href, regexp_matches(href, '{_FILE}') AS is_file FROM (SELECT href FROM ln UNION SELECT url FROM raw)"),
        "valid_site_url": _with("raw", f"SELECT page_id, regexp_matches(site, {_text(_HTTP_URL)}) AS valid, regexp_matches(url, {_text(_HTTP_URL)}) AS url_valid FROM raw"),
        "dedupe_urls": _with("raw", f"SELECT {_key('url')} AS url_key, min(page_id) AS page_id, count(*) AS n FROM raw GROUP BY 1"),
        "resolve_links": _with("nl", f"SELECT DISTINCT site, page_id, url AS src, link AS dst FROM nl WHERE contains(link, site) AND {_key('url')} <> {_key('link')}"),
        "site_routing": _with("raw", "SELECT page_id, (SELECT min(c.site) FROM (SELECT DISTINCT site FROM raw WHERE site <> '') c WHERE contains(raw.url, c.site)) AS routed_to FROM raw"),
        "crawl_reach": _with("raw", "SELECT site, node, min(depth) AS depth FROM r GROUP BY site, node", """nd AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY page_id) AS k FROM raw),
            r(site, node, depth) AS (SELECT site, k, CAST(0 AS BIGINT) FROM nd WHERE k = 1 UNION ALL
            SELECT r.site, nd.k, r.depth + 1 FROM r JOIN nd ON nd.site = r.site AND (nd.k = 2 * r.node OR nd.k = 2 * r.node + 1))"""),
        "tokenize_docs": _with("dk", "SELECT page_id, count(*) AS n_tokens, count(DISTINCT word) AS n_distinct FROM dk GROUP BY page_id"),
        "lemmatize": _with("an", "SELECT site, page_id, pos, word, lemma, pos_tag FROM an"),
        "stop_filter": _with("lm", "SELECT page_id, pos, lemma FROM lm"),
        "morph_rules": _with("dl", "SELECT suffix, r.strip AS strip, r.ending AS ending, r.pos_tag AS pos_tag FROM (SELECT suffix, unnest(rules) AS r FROM nd)", _taught("dl")),
        "morph_pages": _with("dl w lex", "SELECT word, lemma, coalesce(pos_tag, '') AS pos_tag FROM gs UNION ALL SELECT word, base_form, pos_tag FROM lex WHERE word IN (SELECT word FROM w)",
            f"{_taught('dl')}, uw AS (SELECT DISTINCT word FROM w WHERE word NOT IN (SELECT word FROM lex)), {_guessed('uw')}"),
        "morph_terms": _with("dl dk lex", f"""SELECT site, lemma, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS frequency FROM (SELECT site, page_id, lemma, count(*) AS n FROM dk JOIN an2 USING (word) WHERE coalesce(pos_tag, '') NOT IN ({_STOP})
            GROUP BY site, page_id, lemma) GROUP BY site, lemma""", f"{_taught('dl')}, uw AS (SELECT DISTINCT word FROM dk WHERE word NOT IN (SELECT word FROM lex)), {_guessed('uw')}, an2 AS (SELECT * FROM gs UNION ALL SELECT word, base_form, pos_tag FROM lex)"),
        "morph_accuracy": _with("dl", """SELECT count(*) AS words, CAST(count(*) FILTER (list_has_any(wl, gl)) AS BIGINT) AS hits, CAST(count(*) FILTER (wa = ga) AS BIGINT) AS exact FROM
            (SELECT word, list(DISTINCT base_form) AS wl, list_sort(list(DISTINCT base_form || ' ' || pos_tag)) AS wa FROM dl WHERE unicode(word) % 5 = 0 GROUP BY word) JOIN
            (SELECT word, list(DISTINCT lemma) AS gl, list_sort(list(DISTINCT lemma || ' ' || coalesce(pos_tag, '?'))) AS ga FROM gs GROUP BY word) USING (word)""",
            f"tr AS (SELECT * FROM dl WHERE unicode(word) % 5 <> 0), {_taught('tr')}, uw AS (SELECT DISTINCT word FROM dl WHERE unicode(word) % 5 = 0), {_guessed('uw')}"),
        "query_lemmas": _with("ok lex", f"SELECT DISTINCT page_id, coalesce(base_form, tt.word) AS lemma FROM tt LEFT JOIN lex ON lex.word = tt.word WHERE coalesce(pos_tag, '') NOT IN ({_STOP})", f"tt AS (SELECT page_id, unnest({_TOKENS.format('title')}) AS word FROM ok)"),
        "matched_words": _with("mw", "SELECT page_id, word, first_pos FROM mw"),
        "term_freq": _with("tf", "SELECT site, page_id, lemma, rank FROM tf"),
        "doc_freq": _with("df", "SELECT site, lemma, frequency FROM df"),
        "postings": _with("tf df", "SELECT site, page_id, lemma, rank, frequency FROM tf JOIN df USING (site, lemma)"),
        "doc_postings": _with("dt", "SELECT site, lemma, sum(rank) AS occurrences, count(*) AS frequency FROM dt GROUP BY site, lemma"),
        "lemmas_of_site": _with("df one", "SELECT site, lemma, frequency FROM df WHERE site = (SELECT site FROM one)"),
        "lemma_in_list": _with("df q", "SELECT site, lemma, frequency FROM df WHERE lemma IN (SELECT lemma FROM q)"),
        "postings_of_page": _with("tf one", "SELECT page_id, lemma, rank FROM tf WHERE page_id = (SELECT page_id FROM one)"),
        "postings_semi": _with("tf q one", "SELECT site, page_id, lemma, rank FROM tf WHERE site = (SELECT site FROM one) AND lemma IN (SELECT lemma FROM q)"),
        "lemmas_of_page": _with("tf df one", "SELECT site, lemma, frequency FROM df WHERE (site, lemma) IN (SELECT (site, lemma) FROM tf WHERE page_id = (SELECT page_id FROM one))"),
        "pages_per_site": _with("np", "SELECT site, n_pages FROM np"),
        "lemmas_per_site": _with("df", "SELECT site, count(*) AS n_lemmas FROM df GROUP BY site"),
        "total_stats": _with("cfg ok df", "SELECT (SELECT count(*) FROM cfg) AS sites, (SELECT count(*) FROM ok) AS pages, (SELECT count(*) FROM df) AS lemmas, false AS indexing"),
        "site_stats": _with("cfg np df", f"""SELECT url, name, CASE WHEN url LIKE '%never%' THEN 'NOT INDEXED' ELSE 'INDEXED' END AS status, {at} AS status_time, '' AS error,
            coalesce(n_pages, 0) AS pages, coalesce(n_lemmas, 0) AS lemmas FROM cfg LEFT JOIN np ON np.site = url LEFT JOIN (SELECT site, count(*) AS n_lemmas FROM df GROUP BY site) l ON l.site = url"""),
        "fmt_status_time": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS status_time, epoch_us(ts) // 1000 AS millis FROM events",
        "high_freq_filter": _with("df np", f"SELECT site, lemma, frequency FROM df JOIN np USING (site) WHERE CAST(frequency AS DOUBLE) / n_pages <= {MOST}"),
        "rare_first": _with("df q", "SELECT site, lemma, frequency FROM df WHERE lemma IN (SELECT lemma FROM q) ORDER BY frequency, lemma, site"),
        "pages_all_lemmas": _with("sc", "SELECT site, page_id FROM sc"),
        "relevance": _with("sc", "SELECT site, page_id, relevance FROM sc"),
        "round_relevance": _with("res", "SELECT page_id, relevance FROM res"),
        "search_all": _with("res", page),
        "search": _with("res", f"{page} {order} LIMIT 20"),
        "search_site": _with("res one", f"{page} WHERE site = (SELECT site FROM one)"),
        "search_page2": _with("res", f"{page} {order} LIMIT 20 OFFSET 20"),
        "search_count": _with("sc", "SELECT count(*) AS n FROM sc"),
        "word_positions": _with("mw ok", "SELECT page_id, word, strpos(lower(content), word) - 1 AS at FROM mw JOIN ok USING (page_id) WHERE strpos(lower(content), word) > 0"),
        "snippet_window": _with("mw tk", f"SELECT page_id, word, array_to_string(words[greatest(first_pos + 1 - {RADIUS}, 1):first_pos + 1 + {RADIUS}], ' ') AS win FROM mw JOIN tk USING (page_id)"),
        "merge_intervals": _with("mw", f"""SELECT page_id, min(a) AS start, max(b) AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM (
            SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY page_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (
            SELECT page_id, CAST(greatest(first_pos + 1 - {RADIUS}, 1) AS BIGINT) AS a, CAST(first_pos + 1 + {RADIUS} AS BIGINT) AS b FROM mw))) GROUP BY page_id, i"""),
        "highlight": _with("mw ok", """SELECT page_id, word, CASE WHEN strpos(content, word) > 0 THEN substr(content, 1, strpos(content, word) - 1) || '<b>' || word || '</b>'
            || substr(content, strpos(content, word) + length(word)) ELSE content END AS marked FROM mw JOIN ok USING (page_id)"""),
        "snippets": _with("res mw bd", f"""SELECT site, page_id, uri, title, relevance, CASE WHEN pieces IS NULL THEN '' ELSE list_reduce(words, lambda t, w: CASE WHEN strpos(lower(t), w) = 0 THEN t ELSE
            substr(t, 1, strpos(lower(t), w) - 1) || '<b>' || substr(t, strpos(lower(t), w), length(w)) || '</b>' || substr(t, strpos(lower(t), w) + length(w)) END, '... ' || pieces || ' ...') END AS snippet
            FROM tw LEFT JOIN pc USING (page_id)""", rf"""top AS ({page} {order} LIMIT 20),
            tw AS MATERIALIZED (SELECT site, page_id, uri, title, relevance, body, list(word ORDER BY first_pos, word) FILTER (word IS NOT NULL) AS words FROM top JOIN bd USING (page_id) LEFT JOIN mw USING (page_id) GROUP BY ALL),
            oc AS (SELECT page_id, body, w, strpos(lower(body), w) - 1 AS p FROM (SELECT page_id, body, unnest(words) AS w FROM tw)),
            sd AS (SELECT *, regexp_extract(substr(body, 1, greatest(p - 1, 0) + 1), '[^>]*\z') AS l, regexp_extract(substr(body, p + length(w) + 1), '^[^<]*') AS r FROM oc WHERE p >= 0),
            we AS (SELECT *, regexp_extract(l, '(?:^|[^\p{{L}}-])[\p{{L}}-]+(?:[^\p{{L}}-]+[\p{{L}}-]+){{{RADIUS - 1}}}[^\p{{L}}-]*\z') AS lw, regexp_extract(r, '^[^\p{{L}}-]*[\p{{L}}-]+(?:[^\p{{L}}-]+[\p{{L}}-]+){{{RADIUS - 1}}}') AS rw FROM sd),
            iv AS (SELECT page_id, body, greatest(p - 1, 0) + 1 - length(CASE WHEN lw <> '' THEN lw ELSE l END) AS a, p + length(w) + length(CASE WHEN rw <> '' THEN rw ELSE r END) AS b FROM we),
            fr AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY page_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM iv),
            il AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM fr),
            pc AS (SELECT page_id, string_agg(substr(body, a + 1, b - a), ' ... <...> ... ' ORDER BY a) AS pieces FROM (SELECT page_id, any_value(body) AS body, i, min(a) AS a, max(b) AS b FROM il GROUP BY page_id, i) GROUP BY page_id)"""),
        "search_blocks": _with("tf kept df", """SELECT site, lemma, count(*) AS n_blocks, CAST(count(*) FILTER (r.block IS NOT NULL) AS BIGINT) AS n_read, CAST(count(*) FILTER (r.block IS NULL) AS BIGINT) AS n_skipped
            FROM bl LEFT JOIN ra r USING (site, block) GROUP BY site, lemma""", """bl AS MATERIALIZED (SELECT DISTINCT site, lemma, page_id // 256 AS block FROM tf JOIN kept USING (site, lemma)),
            fi AS (SELECT site, arg_min(lemma, (frequency, lemma)) AS lemma FROM df JOIN kept USING (site, lemma) GROUP BY site),
            ra AS MATERIALIZED (SELECT site, block FROM bl JOIN fi USING (site, lemma))"""),
        "reindex_cleanup": _with("tf raw", "SELECT site, page_id, lemma, rank FROM tf WHERE site NOT IN (SELECT site FROM raw ORDER BY page_id LIMIT 10)"),
        "upsert_page": _with("tf rv rt", "SELECT site, page_id, lemma, rank FROM tf WHERE (site, page_id) NOT IN (SELECT (site, page_id) FROM rv) UNION ALL SELECT site, page_id, lemma, rank FROM rt"),
        "upsert_lemma_df": _with("tf rv rt", "SELECT site, lemma, count(*) AS frequency FROM (SELECT site, page_id, lemma FROM tf WHERE (site, page_id) NOT IN (SELECT (site, page_id) FROM rv) UNION ALL SELECT site, page_id, lemma FROM rt) GROUP BY site, lemma"),
    }
