"""The same results in DuckDB's SQL, written apart from the DataFrame code, to check it."""

from __future__ import annotations

from scriptorium import samples as sa
from scriptorium.functions import lexicons as lx


def lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (int, float)):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


def among(values) -> str:
    return "(" + ", ".join(lit(v) for v in dict.fromkeys(values)) + ")"


def rows(table: list[tuple], columns: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in table) + f") AS v({columns}))"


def compact(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def slug(x: str) -> str:
    return rf"trim(regexp_replace(trim(replace(replace(replace(lower({x}), 'c++', 'cpp'), 'c#', 'c-sharp'), '&', 'and'), '.-_/'), '[^a-z0-9]+', '-', 'g'), '-')"


def tok(x: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9+#./-]*'), lambda t: {slug('t')}), lambda t: t <> '')"


def kept(x: str, least: int, *banned, digits: bool = False) -> str:
    no = "".join(f" AND t NOT IN {among(b)}" for b in banned)
    return f"list_filter({tok(x)}, lambda t: length(t) >= {least}{no}{'' if digits else ''' AND NOT regexp_full_match(t, '[0-9]+')'''})"


def qterms(x: str) -> str:
    return kept(x, 2, lx.STOPWORDS, digits=True)


def informative(x: str) -> str:
    return kept(x, 3, lx.STOPWORDS, lx.SUMMARY_GENERIC)


def phrase_tok(x: str) -> str:
    return kept(x, 3, lx.STOPWORDS)


def keyword_tok(x: str) -> str:
    return kept(x, 3, lx.STOPWORDS, lx.SUMMARY_GENERIC, lx.WEAK_KEYWORDS)


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {compact('l')}), lambda l: l <> '')"


def preview(x: str) -> str:
    first = f"coalesce({lines(x)}[1], '')"
    return f"CASE WHEN length({first}) > 160 THEN rtrim(substring({first}, 1, 157)) || '...' ELSE {first} END"


def has_any(x: str, fragments) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(f)})" for f in dict.fromkeys(fragments)) + ")"


def count_of(x: str, fragments) -> str:
    return "(" + " + ".join(f"contains({x}, {lit(f)})::INT" for f in fragments) + ")"


def upper_(x: str) -> str:
    return f"(upper({x}) = {x} AND lower({x}) <> {x})"


def noisy(p: str) -> str:
    """p: a compacted, lower-case preview."""
    return f"({p} IN {among(lx.NOISY_PREVIEWS)} OR regexp_full_match({p}, '[0-9]+') OR regexp_full_match({p}, '[ivxlcdm]+') OR {p} LIKE 'contents%' OR {p} LIKE 'table of contents%')"


def signal2(p: str) -> str:
    """p: a compacted preview."""
    return f"""(CASE WHEN {p} = '' THEN 8 ELSE (lower({p}) IN {among(lx.FRONT_MATTER)})::INT * 10
        + (regexp_full_match({p}, '[0-9]+') OR regexp_full_match(lower({p}), '[ivxlcdm]+'))::INT * 8 + (length({p}) <= 4)::INT * 4 + ({upper_(p)} AND length({p}) <= 16)::INT * 3 END)"""


def noise2(p: str, t: str) -> str:
    """p, t: compacted preview and text, of a document that is no book."""
    low = f"lower({t})"
    return f"""(CASE WHEN {t} = '' THEN {signal2(p)} + 20 ELSE {signal2(p)} + {noisy(f"lower({p})")}::INT * 16 + 8 * {count_of(low, lx.BOILERPLATE)}
        + ({low} LIKE 'contents %' OR {low} LIKE 'table of contents%')::INT * 16 + contains({low}, 'series editors')::INT * 16 + contains({low}, 'library of congress')::INT * 12
        + contains({low}, 'all rights reserved')::INT * 16 + contains({low}, 'printed and bound')::INT * 10 END)"""


def score2(query: str, terms: list[str], x: str) -> str:
    parts = []
    for term in terms:
        n = f"len(list_filter({tok(x)}, lambda u: u = {lit(term)}))"
        parts.append(f"(CASE WHEN {n} > 0 THEN 2 + least({n} - 1, 4) ELSE 0 END)")
    return "(" + " + ".join(parts) + f" + contains(lower({x}), {lit(query.lower())})::INT * 6)"


DOCS = f"""d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, source, text, coalesce(source, 'none') || '-' || doc_id || '.txt' AS filename, sha256(text) AS sha, {preview('text')} AS title, len({lines('text')}) AS page_count FROM d)"""


def class_of(name: str, title: str, pages: str) -> str:
    out = "CASE"
    for label, hints in lx.CLASS_WORDS:
        out += f" WHEN {has_any(f'lower({name})', hints)} OR {has_any(f'lower({title})', hints)} THEN {lit(label)}"
    return out + f" WHEN {pages} >= 150 THEN 'book' WHEN {pages} BETWEEN 1 AND 80 THEN 'paper' WHEN {pages} BETWEEN 81 AND 149 THEN 'reference' ELSE 'unknown' END"


def copy_rank(name: str, words, *missing: str) -> str:
    more = "".join(f" + ({m})::INT" for m in missing)
    return f"{{'a': {count_of(f'lower({name})', words)} + (lower({name}) LIKE '%2.pdf')::INT{more}, 'b': length({name}), 'c': lower({name})}}"


EXACT = f"""{DOCS}, k AS (SELECT sha, min({{'r': {copy_rank('filename', lx.COPY_WORDS_EXACT)}, 'id': doc_id}}).id AS canonical, count(*) AS n FROM c GROUP BY sha),
x AS (SELECT c.*, k.canonical, CASE WHEN n > 1 AND canonical <> doc_id THEN 'duplicate' ELSE {class_of('filename', 'title', 'page_count')} END AS cls FROM c JOIN k USING (sha))"""

PAGES = f"""{DOCS}, p AS (SELECT doc_id, i AS page_no, l[i] AS text, CASE WHEN length(l[i]) > 160 THEN rtrim(substring(l[i], 1, 157)) || '...' ELSE l[i] END AS preview
FROM (SELECT doc_id, {lines('text')} AS l FROM d), unnest(range(1, len(l) + 1)) AS u(i))"""

ORACLES: dict[str, str] = {}
ORACLES["tokenize_counts"] = f"WITH {DOCS} SELECT token, count(*) AS n FROM (SELECT unnest({tok('text')}) AS token FROM d) GROUP BY token"
ORACLES["slugify_titles"] = f"WITH {DOCS} SELECT doc_id, {slug('title')} AS slug FROM c"
ORACLES["page_previews"] = f"WITH {DOCS} SELECT doc_id, title AS preview FROM c"
ORACLES["text_lines_pages"] = f"WITH {PAGES} SELECT doc_id, page_no::BIGINT AS page_no, length(text)::BIGINT AS char_count, text FROM p"
ORACLES["informative_tokens"] = f"WITH {DOCS} SELECT doc_id, array_to_string({informative('title')}, ' ') AS tokens FROM c"
ORACLES["query_terms"] = f"WITH {DOCS} SELECT doc_id, array_to_string({qterms('title')}, ' ') AS terms FROM c"
ORACLES["score_text_topk"] = f"WITH {DOCS}, s AS (SELECT doc_id, {score2(sa.QUERY, sa.TERMS, 'text')}::BIGINT AS score2 FROM d) SELECT doc_id, score2 FROM s WHERE score2 > 0 ORDER BY score2 DESC, doc_id LIMIT 10"
MATCHES = f"""m AS (SELECT doc_id, page_no, score2, row_number() OVER (PARTITION BY doc_id ORDER BY score2 DESC, page_no) AS rank
FROM (SELECT doc_id, page_no, ({score2(sa.QUERY, sa.TERMS, 'text')} - {signal2('preview')}) AS score2 FROM p) WHERE score2 > 0)"""
ORACLES["page_matches_topk"] = f"WITH {PAGES}, {MATCHES} SELECT doc_id, page_no::BIGINT AS page_no, score2::BIGINT AS score2, rank::BIGINT AS rank FROM m WHERE rank <= 3"
ORACLES["page_penalties"] = f"WITH {PAGES} SELECT doc_id, page_no::BIGINT AS page_no, {signal2('preview')}::BIGINT AS signal2, {noise2('preview', 'text')}::BIGINT AS noise2, {noisy('lower(preview)')} AS noisy FROM p"
ORACLES["exact_duplicates"] = f"WITH {EXACT} SELECT doc_id, canonical AS canonical_doc_id, cls AS source_class, CASE WHEN cls = 'duplicate' THEN 'exact_duplicate_of' END AS kind FROM x"
ORACLES["catalog_class_counts"] = f"WITH {EXACT} SELECT v.s AS source_class, count(x.doc_id) AS documents FROM {rows([(c,) for c in lx.SOURCE_CLASSES], 's')} v LEFT JOIN x ON x.cls = v.s GROUP BY v.s"
ORACLES["catalog_statistics"] = f"WITH {EXACT} SELECT (SELECT count(*) FROM x) AS document_count, (SELECT count(*) FROM k WHERE n > 1) AS duplicate_group_count"
ORACLES["unique_ids"] = "SELECT doc_id, CASE WHEN n = 1 THEN source ELSE source || '-' || n END AS id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)"
ORACLES["source_classes"] = f"SELECT filename, {class_of('filename', 'title', 'pages')} AS source_class FROM {rows(sa.CLASSED, 'filename, title, pages')}"
ORACLES["doc_ids"] = rf"""SELECT path, {slug('stem')} AS doc_id, CASE WHEN regexp_matches(stem, '^[0-9]{{4}}-') THEN stem[1:4]::INT ELSE 0 END AS year
FROM (SELECT path, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\.[^.]*$', '\1') AS stem FROM {rows([(p,) for p in sa.PATHS], 'path')})"""
ORACLES["override_overlay"] = "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' ELSE d.lang END AS lang, coalesce(l.quality, -1)::BIGINT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)"
SAMPLED = f"(CASE WHEN length({compact('text')}) <= 15000 THEN {compact('text')} ELSE substring({compact('text')}, 1, 5000) || chr(10) || substring({compact('text')}, length({compact('text')}) // 2 - 2500 + 1, 5000) || chr(10) || right({compact('text')}, 5000) END)"
SHINGLES = f"""t AS (SELECT doc_id, {phrase_tok(SAMPLED)} AS t FROM d),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(t) < 3 THEN t ELSE list_transform(range(1, len(t) - least(5, greatest(3, len(t))) + 2), lambda i: array_to_string(t[i:i + least(5, greatest(3, len(t))) - 1], ' ')) END) AS g FROM t)"""
ORACLES["shingle_counts"] = f"WITH {DOCS}, {SHINGLES} SELECT doc_id, len(g)::BIGINT AS n, list_min(g) AS first_shingle FROM g"
ALIKE = f"""{EXACT}, e AS (SELECT doc_id, title, page_count, cls, filename, list_distinct({phrase_tok("CASE WHEN title = '' THEN doc_id::VARCHAR ELSE title END")}) AS tt FROM x WHERE cls <> 'duplicate'),
{SHINGLES}, f AS (SELECT g.doc_id, unnest(g) AS s FROM g JOIN e USING (doc_id)), sizes AS (SELECT doc_id, len(g) AS n FROM g),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM f a JOIN f b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
j AS (SELECT i.*, sa.n + sb.n - inter AS total, ea.cls = eb.cls AS same,
  CASE WHEN len(ea.tt) = 0 OR len(eb.tt) = 0 THEN 0 ELSE len(list_intersect(ea.tt, eb.tt)) / len(list_distinct(list_concat(ea.tt, eb.tt))) END AS ts,
  (ea.page_count = 0 OR eb.page_count = 0 OR abs(ea.page_count - eb.page_count) <= greatest(2, round_even(greatest(ea.page_count, eb.page_count) * 0.02, 0))) AS near
  FROM i JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b JOIN e ea ON ea.doc_id = a JOIN e eb ON eb.doc_id = b),
m AS (SELECT a, b, inter, total, CASE WHEN near AND inter / total >= 0.9 THEN 'very_high_text_similarity' WHEN near AND inter / total >= 0.82 AND (ts >= 0.5 OR same) THEN 'high_text_similarity'
  WHEN near AND inter / total >= 0.75 AND ts >= 0.8 THEN 'title_and_text_alignment' END AS reason FROM j)"""
ORACLES["near_dup_pairs"] = f"WITH {ALIKE} SELECT a, b, inter::BIGINT AS inter, total::BIGINT AS total, reason FROM m WHERE reason IS NOT NULL"
ORACLES["near_dup_clusters"] = f"""WITH RECURSIVE {ALIKE}, q AS (SELECT * FROM m WHERE reason IS NOT NULL), both_ AS (SELECT a, b, inter, total, reason FROM q UNION ALL SELECT b, a, inter, total, reason FROM q),
reach(n, r) AS (SELECT a, a FROM both_ UNION SELECT both_.b, reach.r FROM reach JOIN both_ ON both_.a = reach.n),
comp AS (SELECT n, min(r) AS comp FROM reach GROUP BY n),
best AS (SELECT comp, min({{'r': {copy_rank('filename', lx.COPY_WORDS_NEAR, "title = ''", 'true')}, 'id': doc_id}}).id AS near FROM comp JOIN c ON c.doc_id = comp.n GROUP BY comp),
mem AS (SELECT n AS doc_id, near FROM comp JOIN best USING (comp)),
det AS (SELECT doc_id, near, row_number() OVER (PARTITION BY doc_id ORDER BY (b = near) DESC, inter / total DESC, b) AS rn, inter, total, reason FROM mem JOIN both_ ON a = doc_id WHERE doc_id <> near)
SELECT x.doc_id, coalesce(det.near, x.canonical) AS canonical_doc_id, CASE WHEN det.near IS NOT NULL THEN 'near_duplicate' WHEN cls = 'duplicate' THEN 'exact_duplicate' ELSE 'canonical' END AS status,
  coalesce(floor(inter * 10000 / total + 0.5)::BIGINT, -1) AS similarity_1e4, reason FROM x LEFT JOIN det ON det.doc_id = x.doc_id AND rn = 1"""
GENERIC = f"""ev AS (SELECT doc_id, 0 AS seq, 5 AS w, {keyword_tok('title')} AS t FROM c UNION ALL
  SELECT doc_id, page_no + 2, 1, {keyword_tok('substring(text, 1, 3000)')} FROM p WHERE page_no <= 20 AND {noise2('preview', 'text')} < 20),
ex AS (SELECT doc_id, seq, w, i AS pos, t[i] AS keyword FROM ev, unnest(range(1, len(t) + 1)) AS u(i)),
kc AS (SELECT doc_id, keyword, sum(w)::BIGINT AS weight, min({{'s': seq, 'p': pos}}) AS first FROM ex GROUP BY ALL),
kw AS (SELECT doc_id, keyword, weight, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, first) AS rank FROM kc)"""
ORACLES["keywords_generic"] = f"WITH {PAGES}, {GENERIC} SELECT doc_id, keyword, weight, rank::BIGINT AS rank FROM kw WHERE rank <= 12"


def valid_phrase(g: str, title: str) -> str:
    edge = lambda t: f"({t} IN {among(lx.PHRASE_GENERIC)} AND {t} NOT IN {among(lx.PHRASE_EDGES)})"
    return f"""(NOT {edge(f'{g}[1]')} AND NOT {edge(f'{g}[-1]')} AND len(list_filter({g}, lambda w: w IN {among(lx.DOMAIN_TOKENS)} OR list_contains({title}, w))) > 0
      AND len(list_filter({g}, lambda w: w NOT IN {among(lx.PHRASE_GENERIC)})) >= 2)"""


def phrase2(g: str, title: str) -> str:
    return f"(5 * len(list_filter({g}, lambda w: w IN {among(lx.DOMAIN_TOKENS)})) + 4 * len(list_filter({g}, lambda w: list_contains({title}, w))) + 2 + ({g}[-1] IN {among(lx.METHOD_ENDS)})::INT * 2)"


GRAMS = " UNION ALL ".join(f"SELECT doc_id, w2, title, t[i:i + {n - 1}] AS g FROM src, unnest(range(1, len(t) - {n} + 2)) AS u(i)" for n in (2, 3, 4))
ORACLES["phrase_keywords"] = f"""WITH {PAGES}, tt AS (SELECT doc_id, title AS raw, list_distinct({phrase_tok('title')}) AS title FROM c),
src AS (SELECT doc_id, 20 AS w2, title, {phrase_tok('raw')} AS t FROM tt UNION ALL SELECT p.doc_id, 10, tt.title, {phrase_tok('p.text')} FROM p JOIN tt USING (doc_id) WHERE page_no = 1),
grams AS (SELECT DISTINCT * FROM ({GRAMS})),
ok AS (SELECT doc_id, array_to_string(g, ' ') AS phrase, len(g) AS n, w2 + {phrase2('g', 'title')} AS w2 FROM grams WHERE {valid_phrase('g', 'title')}),
sums AS (SELECT doc_id, phrase, any_value(n) AS n, sum(w2)::BIGINT AS w2 FROM ok GROUP BY doc_id, phrase),
sig AS (SELECT *, list_transform(string_split(phrase, ' '), lambda t: CASE WHEN t LIKE '%s' AND length(t) > 4 THEN t[:-2] ELSE t END) AS sig FROM sums),
one AS (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY doc_id, sig ORDER BY w2 DESC, n DESC, phrase) = 1)
SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY w2 DESC, n DESC, phrase)::BIGINT AS rank FROM one QUALIFY rank <= 12"""
PROFILE = f"""pe AS (SELECT doc_id, 8 AS w, {informative('title')} AS t FROM c UNION ALL SELECT doc_id, 1, {informative('substring(text, 1, 2000)')} FROM p WHERE page_no <= 20 AND {noise2('preview', 'text')} < 20 AND length(text) >= 120),
prof AS (SELECT doc_id, token, sum(w)::BIGINT AS weight FROM (SELECT doc_id, w, unnest(t) AS token FROM pe) GROUP BY ALL)"""
ORACLES["topic_profile"] = f"WITH {PAGES}, {PROFILE} SELECT doc_id, token, weight FROM prof"
SENTENCES = f"""{PROFILE}, ti AS (SELECT doc_id, title, list_distinct({informative('title')}) AS tt FROM c),
pt AS (SELECT p.*, ti.title, ti.tt, list_distinct({informative('substring(p.text, 1, 2000)')}) AS terms FROM p JOIN ti USING (doc_id)),
pk AS (SELECT pt.doc_id, page_no, sum(least(weight, 5)) AS known FROM (SELECT doc_id, page_no, unnest(terms) AS token FROM pt) pt JOIN prof USING (doc_id, token) GROUP BY ALL),
ps AS (SELECT pt.*, CASE WHEN length(text) < 140 THEN -20000 ELSE -10 * {noise2('preview', 'text')} + 60 * len(list_intersect(tt, terms)) + 7 * coalesce(known, 0)
  + CASE WHEN page_no <= 3 THEN 100 WHEN page_no <= 8 THEN 40 ELSE 0 END END AS ps FROM pt LEFT JOIN pk USING (doc_id, page_no)),
top AS (SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ps DESC, page_no) <= 8),
raw AS (SELECT doc_id, page_no, title, tt, {compact('s')} AS s FROM (SELECT doc_id, page_no, title, tt, unnest(string_split(regexp_replace(text, '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1))) AS s FROM top)),
cut AS (SELECT doc_id, page_no, tt, CASE WHEN title <> '' AND starts_with(lower(s), lower(title) || ' ') THEN {compact('substring(s, length(title) + 1)')} ELSE s END AS sentence FROM raw WHERE length(s) BETWEEN 60 AND 320 AND lower(s) <> lower(title)),
st AS (SELECT row_number() OVER () AS id, *, list_distinct({informative('sentence')}) AS terms, lower(sentence) AS low FROM cut),
sk AS (SELECT id, sum(least(weight, 6)) AS known FROM (SELECT id, doc_id, unnest(terms) AS token FROM st) z JOIN prof USING (doc_id, token) GROUP BY ALL),
ss AS (SELECT st.doc_id, page_no, sentence, terms, CASE WHEN len(terms) = 0 THEN -20000 ELSE 80 * len(list_intersect(tt, terms)) + 9 * coalesce(known, 0) + 3 * least(len(terms), 14) + 60 * {count_of('low', lx.SUMMARY_CUES)}
  - 240 * {has_any('low', lx.BOILERPLATE)}::INT - 120 * {has_any('low', lx.FIGURE_WORDS)}::INT - 160 * (contains(sentence, '@') OR contains(low, 'http') OR contains(low, 'www.'))::INT
  - 80 * {upper_('sentence')}::INT - 100 * (length(regexp_replace(sentence, '[^0-9]', '', 'g')) >= 8)::INT - 60 * (len(terms) < 5)::INT END::BIGINT AS score20 FROM st LEFT JOIN sk USING (id))"""
ORACLES["sentence_scores"] = f"WITH {PAGES}, {SENTENCES} SELECT doc_id, page_no::BIGINT AS page_no, sentence, score20 FROM ss"
SUMMARY = f"""{SENTENCES}, cand AS (SELECT doc_id, sentence, terms, row_number() OVER (PARTITION BY doc_id ORDER BY score20 DESC, sentence) AS i FROM ss WHERE score20 > 0),
walk(doc_id, i, chosen, covered) AS (SELECT doc_id, 0::BIGINT, []::VARCHAR[], []::VARCHAR[] FROM c UNION ALL
  SELECT doc_id, next, CASE WHEN no THEN chosen ELSE list_append(chosen, sentence) END, CASE WHEN no THEN covered ELSE list_distinct(list_concat(covered, terms)) END
  FROM (SELECT w.doc_id, chosen, covered, sentence, terms, k.i AS next, len(covered) > 0 AND len(list_intersect(terms, covered)) >= greatest(5, len(terms) // 2) AS no FROM walk w JOIN cand k ON k.doc_id = w.doc_id AND k.i = w.i + 1 WHERE len(chosen) < 4)),
sm AS (SELECT c.doc_id, coalesce(nullif(array_to_string(max_by(chosen, i), ' '), ''), nullif(any_value(title), ''), 'No summary available yet.') AS summary FROM walk JOIN c USING (doc_id) GROUP BY c.doc_id)"""
ORACLES["summaries_generic"] = f"WITH RECURSIVE {PAGES}, {SUMMARY} SELECT doc_id, summary FROM sm"
INDEX = f"""{GENERIC}, ka AS (SELECT doc_id, list(keyword ORDER BY rank) AS keywords FROM kw WHERE rank <= 12 GROUP BY doc_id),
pv AS (SELECT doc_id, list(preview ORDER BY page_no) AS pv FROM p WHERE page_no <= 8 GROUP BY doc_id),
ix AS (SELECT c.doc_id, CASE WHEN title = '' THEN c.doc_id::VARCHAR ELSE title END AS title, coalesce(keywords, []) AS keywords, summary, coalesce(pv, []) AS pv, cls
  FROM c JOIN sm USING (doc_id) LEFT JOIN ka USING (doc_id) LEFT JOIN pv USING (doc_id) JOIN (SELECT doc_id, cls FROM x) USING (doc_id)),
idx AS (SELECT *, title || chr(10) || '' || chr(10) || array_to_string(keywords, ' ') || chr(10) || summary || chr(10) || array_to_string(pv, chr(10)) AS search_text, CASE WHEN cls = 'duplicate' THEN 1 ELSE 0 END AS dup FROM ix)"""


def fields2(query: str, terms: list[str]) -> str:
    return f"(4 * {score2(query, terms, 'title')} + 3 * {score2(query, terms, '''array_to_string(keywords, ' ')''')} + 2 * {score2(query, terms, 'summary')} + {score2(query, terms, 'search_text')})"


BASE = EXACT + ", p AS" + PAGES.split(", p AS", 1)[1]
ORACLES["search_two_stage"] = f"""WITH RECURSIVE {BASE}, {SUMMARY}, {INDEX}, {MATCHES},
f AS (SELECT doc_id, dup, {fields2(sa.QUERY, sa.TERMS)} AS s FROM idx), sc AS (SELECT doc_id, CASE WHEN dup = 1 THEN (s * 50 * 125 * 2 + 10000) // 20000 ELSE s * 50 END AS s100 FROM f WHERE s > 0),
short AS (SELECT * FROM sc WHERE s100 > 0 ORDER BY s100 DESC, doc_id::VARCHAR LIMIT 20), ev2 AS (SELECT doc_id, sum(score2) * 50 AS e FROM m WHERE rank <= 3 GROUP BY doc_id),
tot AS (SELECT doc_id, s100 + coalesce(e, 0) AS t FROM short LEFT JOIN ev2 USING (doc_id))
SELECT 'source' AS kind, doc_id::VARCHAR AS id, t::BIGINT AS score100, row_number() OVER (ORDER BY t DESC, doc_id::VARCHAR)::BIGINT AS rank FROM tot QUALIFY rank <= 5"""
CONCEPTS = f"""nt AS (SELECT doc_id, {qterms('title')} AS t FROM c JOIN (SELECT doc_id AS id FROM x WHERE cls <> 'duplicate') ON id = doc_id WHERE title <> '' AND NOT {has_any(f"lower({compact('title')})", lx.CONCEPT_NOISE)}),
cg AS ({' UNION ALL '.join(f"SELECT doc_id, t[i:i + {n - 1}] AS g, {n + 4} AS w FROM nt, unnest(range(1, len(t) - {n} + 2)) AS u(i)" for n in (2, 3))}),
ce AS (SELECT doc_id, array_to_string(g, ' ') AS phrase, w, len(g) AS n FROM cg WHERE g[1] NOT IN {among(lx.CONCEPT_GENERIC)} AND g[-1] NOT IN {among(lx.CONCEPT_GENERIC)}
  AND len(list_filter(g, lambda t: regexp_full_match(t, '[0-9]+') OR t IN {among(lx.CONCEPT_GENERIC_INNER)})) = 0 AND array_to_string(g, ' ') NOT IN {among(lx.CONCEPT_GENERIC_PHRASES)}
  UNION ALL SELECT pk.doc_id, lower(phrase), 5, len(string_split(phrase, ' ')) FROM ({ORACLES["phrase_keywords"]}) pk JOIN x USING (doc_id) WHERE cls <> 'duplicate' AND len(string_split(phrase, ' ')) >= 2),
cc AS (SELECT phrase, count(DISTINCT doc_id) AS support, (2 * sum(w) + 8 * count(DISTINCT doc_id) + 3 * any_value(n))::BIGINT AS score2 FROM ce GROUP BY phrase HAVING count(DISTINCT doc_id) BETWEEN 2 AND 24)"""
ORACLES["concept_candidates"] = f"WITH {EXACT}, {CONCEPTS} SELECT phrase, support, score2 FROM cc"
TITLED = f"array_to_string(list_transform(string_split(phrase, ' '), lambda u: CASE u {' '.join(f'WHEN {lit(a)} THEN {lit(b)}' for a, b in lx.DISPLAY_WORDS.items())} ELSE upper(u[1]) || lower(u[2:]) END), ' ')"
CONCEPT_FIELDS = (("title", 10), ("array_to_string(keywords, ' ')", 6), ("summary", 4), ("search_text", 3))
ORACLES["concept_search"] = f"""WITH {EXACT}, {CONCEPTS}, cs AS (SELECT phrase, list(DISTINCT doc_id ORDER BY doc_id) AS ids FROM ce JOIN cc USING (phrase) GROUP BY phrase),
ct AS (SELECT {slug('phrase')} AS concept_id, {TITLED} AS title, list_distinct(string_split(phrase, ' ')) AS kd, string_split(phrase, ' ') AS ks, ids FROM cs),
cu AS (SELECT concept_id, title, list_filter(ks, lambda w, i: list_position(ks, w) = i) AS keywords, len(ids) AS n, 'This concept aggregates sources related to ' || lower(title) || '. Key supporting materials include ' || array_to_string(list_transform(ids[1:4], lambda q: '[[source/' || q || ']]'), ', ') || '.' AS summary FROM ct),
cv AS (SELECT *, {compact("title || chr(10) || array_to_string(keywords, ' ') || chr(10) || summary")} AS search_text FROM cu)
SELECT concept_id, summary, (25 * ({' + '.join(f"{w} * {score2(sa.CONCEPT_QUERY, sa.CONCEPT_TERMS, f)}" for f, w in CONCEPT_FIELDS)}) + 25 * least(n, 8))::BIGINT AS score100 FROM cv"""
ORACLES["related_concepts"] = f"""WITH {EXACT}, {CONCEPTS}, cd AS (SELECT DISTINCT phrase, doc_id FROM ce JOIN cc USING (phrase)),
n AS (SELECT a.phrase AS concept_id, b.phrase AS other, count(*) AS overlap FROM cd a JOIN cd b ON a.doc_id = b.doc_id AND a.phrase <> b.phrase GROUP BY ALL HAVING count(*) >= 2)
SELECT concept_id, other, overlap, row_number() OVER (PARTITION BY concept_id ORDER BY overlap DESC, other)::BIGINT AS rank FROM n QUALIFY rank <= 6"""
ORACLES["compare_keywords"] = f"""WITH {PAGES}, {GENERIC}, ka AS (SELECT doc_id, list(keyword ORDER BY rank) AS k FROM kw WHERE rank <= 12 GROUP BY doc_id), a AS (SELECT k FROM ka WHERE doc_id = 1), b AS (SELECT k FROM ka WHERE doc_id = 2)
SELECT array_to_string(list_filter(a.k, lambda t: list_contains(b.k, t))[1:8], ' ') AS shared, array_to_string(list_filter(a.k, lambda t: NOT list_contains(b.k, t))[1:6], ' ') AS only_a, array_to_string(list_filter(b.k, lambda t: NOT list_contains(a.k, t))[1:6], ' ') AS only_b FROM a, b"""
ORACLES["identifiers"] = rf"""SELECT text, nullif(regexp_replace(regexp_extract(text, '(?i)10\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]+'), '\.+$', ''), '') AS doi,
nullif(regexp_replace(upper(regexp_extract(text, '(?i)(^|[^0-9])((97[89][- ]?)?([0-9][- ]?){{9}}[0-9X])($|[^0-9])', 2)), '[^0-9X]', '', 'g'), '') AS isbn FROM {rows([(t,) for t in sa.IDENTIFIED], 'text')}"""
ORACLES["authors"] = rf"""WITH v AS (SELECT authors, list_filter(list_transform(string_split(authors, ';'), lambda a: {compact('a')}), lambda a: a <> '') AS l FROM {rows([(t,) for t in sa.AUTHORS], 'authors')}),
w AS (SELECT authors, list_transform(l, lambda a: CASE WHEN len(string_split(a, ',')) = 2 THEN trim(string_split(a, ',')[2]) || ' ' || trim(string_split(a, ',')[1]) ELSE a END) AS l FROM v)
SELECT authors, nullif(array_to_string(list_transform(l, lambda a: regexp_replace(regexp_replace(a, '([A-Z]\.)([A-Z][a-z])', '\1 \2', 'g'), '([A-Z]\.)([A-Z]\.)', '\1 \2', 'g')), '; '), '') AS normal FROM w"""
ORACLES["bibtex_escape"] = "SELECT text, " + "array_to_string(list_transform(string_split(text, ''), lambda c: CASE c " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in lx.BIBTEX_ESCAPES.items()) + f" ELSE c END), '') AS escaped FROM {rows([(t,) for t in sa.SPECIAL], 'text')}"
ORACLES["front_matter"] = f"""WITH {EXACT} SELECT doc_id, '---' || chr(10) || 'doc_id: "' || doc_id || '"' || chr(10) || 'title: "' || replace(title, '"', '\\"') || '"' || chr(10) || 'author: null' || chr(10) || 'year: null' || chr(10)
|| 'source_class: "' || cls || '"' || chr(10) || 'aliases:' || chr(10) || '  - "' || filename || '"' || chr(10) || '---' AS block FROM x"""
ORACLES["link_rewrite"] = f"SELECT text, regexp_replace(text, '\\[\\[source/old\\.id(#[A-Za-z0-9-]+)?\\]\\]', '[[source/new-id\\1]]', 'g') AS rewritten FROM {rows([(t,) for t in sa.LINKED], 'text')}"
ORACLES["extraction_plan"] = f"WITH {EXACT} SELECT doc_id, CASE WHEN cls = 'duplicate' THEN 'skipped_duplicate' WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'skip' ELSE 'extract' END AS action FROM x"
ORACLES["incremental_skip"] = "WITH n AS (SELECT * FROM documents WHERE doc_id % 7 <> 0), o AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 11 <> 0) SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL THEN 'remove' WHEN o.n_chars = n.n_chars THEN 'reuse' ELSE 'build' END AS action FROM n FULL JOIN o ON n.doc_id = o.doc_id"
ORACLES["clean_orphans"] = "SELECT p.page_id AS doc_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.page_id)"
SYNC = """s AS (SELECT c_custkey AS k, sha256(c_name) AS sha256, c_mktsegment AS fp FROM customer), l AS (SELECT * FROM s WHERE k % 5 <> 0), m AS (SELECT sha256, CASE WHEN k % 7 = 0 THEN NULL ELSE 'key' || k END AS key, CASE WHEN k % 3 = 0 THEN 'stale' ELSE fp END AS last FROM s WHERE k % 4 <> 0),
pl AS (SELECT * FROM (SELECT coalesce(l.sha256, m.sha256) AS sha256, CASE WHEN l.sha256 IS NULL THEN 'delete' WHEN key IS NULL THEN 'create' WHEN fp IS DISTINCT FROM last THEN 'update' END AS action FROM l FULL JOIN m ON l.sha256 = m.sha256) WHERE action IS NOT NULL)"""
ORACLES["sync_plan"] = f"WITH {SYNC} SELECT sha256, action FROM pl"
ORACLES["trim_plan"] = f"WITH {SYNC} SELECT sha256, action FROM pl ORDER BY CASE action WHEN 'create' THEN 0 WHEN 'update' THEN 1 ELSE 2 END, sha256 LIMIT 25"
ORACLES["topk_per_group_scale"] = "SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3"
ORACLES["class_counts_scale"] = "SELECT l_returnflag, l_linestatus, count(*) AS lines, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY ALL"
ORACLES["form_feed_pages"] = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS page_no, 'p' || i AS page_key, p[i] AS text FROM (SELECT doc_id, string_split(text, chr(12)) AS p FROM {rows(sa.PAGED, 'doc_id, text')}), unnest(range(1, len(p) + 1)) AS u(i) WHERE {compact('p[i]')} <> ''"
ORACLES["redundancy_overlay"] = f"""SELECT doc_id, canonical_doc_id, CASE status WHEN 'near_duplicate' THEN 'near_duplicate_of' WHEN 'exact_duplicate' THEN 'exact_duplicate_of' END AS dedupe_kind, status <> 'canonical' AND canonical_doc_id <> doc_id AS is_redundant, similarity_1e4
FROM ({ORACLES["near_dup_clusters"]})"""
ORACLES["clean_previews"] = rf"""WITH {DOCS} SELECT doc_id, {compact(rf"translate(regexp_replace(regexp_replace({compact('title')}, '(?i)^chapter\s+\d+\s*', ''), '^\d+(\.\d+)*\s*', ''), '–—', '  ')")} AS preview FROM c"""
ORACLES["headings"] = rf"""WITH v AS (SELECT text, {compact('text')} AS t FROM {rows([(t,) for t in sa.HEADINGS], 'text')}) SELECT text, coalesce(try_cast(nullif(regexp_extract(lower(t), '^chapter\s+(\d+)\b', 1), '') AS BIGINT), -1) AS chapter,
CASE WHEN regexp_matches(t, '^\d+\.\d+\s+.+$') THEN regexp_extract(t, '^(\d+)\.', 1)::BIGINT ELSE -1 END AS section_chapter, CASE WHEN regexp_matches(t, '^\d+\.\d+\s+.+$') THEN regexp_extract(t, '^\d+\.\d+\s+(.+)$', 1) END AS title FROM v"""


def singular(t: str) -> str:
    return f"CASE WHEN {t} LIKE '%ies' AND length({t}) > 4 THEN {t}[:-4] || 'y' WHEN {t} LIKE '%s' AND length({t}) > 4 AND NOT regexp_matches({t}, '(ss|us|is)$') THEN {t}[:-2] ELSE {t} END"


ORACLES["token_forms"] = f"""WITH {DOCS}, t AS (SELECT DISTINCT unnest({tok('text')}) AS token FROM d) SELECT token, {singular('token')} AS singular, CASE WHEN token LIKE '%s' AND length(token) > 4 THEN token[:-2] ELSE token END AS plural_signature,
CASE token {' '.join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in lx.DISPLAY_WORDS.items())} ELSE upper(token[1]) || lower(token[2:]) END AS titled FROM t"""
ORACLES["structural_noise"] = rf"""WITH {DOCS}, s AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, string_split(regexp_replace({compact('text')}, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)) AS l FROM d))
SELECT doc_id, i::BIGINT AS i, regexp_matches(sentence, '^\d+(\.\d+)*\b') OR {has_any('lower(sentence)', (*lx.BOILERPLATE, *lx.STRUCTURAL_NOISE, *lx.STRUCTURE_WORDS))}
  OR length(regexp_replace(sentence, '[^:]', '', 'g')) >= 3 OR length(regexp_replace(sentence, '[^0-9]', '', 'g')) >= 8 AS noise FROM s"""
ORACLES["content_types"] = f"""SELECT doc_id, CASE lower((['pdf', 'MD', 'html', 'epub', 'xyz', '', 'txt'])[doc_id % 7 + 1]) {' '.join(f"WHEN {lit(a.lstrip('.'))} THEN {lit(b)}" for a, b in lx.MIME_TYPES.items())} ELSE 'application/octet-stream' END AS content_type FROM documents"""
CITED = f"""{EXACT}, ci AS (SELECT *, CASE WHEN doc_id % 4 <> 0 THEN 1990 + doc_id % 30 END AS year, CASE WHEN doc_id % 3 = 0 THEN '10.1000/' || doc_id END AS doi, CASE WHEN doc_id % 5 = 0 THEN '9783161484100' END AS isbn, CASE WHEN doc_id % 2 = 0 THEN 'Journal' END AS journal,
  doc_id % 7 = 0 AS cite, CASE WHEN doc_id % 6 <> 0 THEN source || ', Ann; Bo Ray' END AS author FROM x), cb AS (SELECT *, title <> '' AND year IS NOT NULL AND (cite OR doi IS NOT NULL OR isbn IS NOT NULL) AS citeable FROM ci)"""


def entry_kind(article: str, book: str, other: str) -> str:
    return f"CASE WHEN doi IS NOT NULL AND journal IS NOT NULL THEN '{article}' WHEN isbn IS NOT NULL OR cls = 'book' THEN '{book}' WHEN doi IS NOT NULL THEN '{article}' ELSE '{other}' END"


def escaped(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE c " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in lx.BIBTEX_ESCAPES.items()) + " ELSE c END), '')"


def people(x: str) -> str:
    """Structs last, first, name of a list with semicolons."""
    listed = f"list_filter(list_transform(string_split({x}, ';'), lambda a: {compact('a')}), lambda a: a <> '')"
    comma = "list_filter(list_transform(string_split(a, ','), lambda q: trim(q)), lambda q: q <> '')"
    parts = f"list_transform({listed}, lambda a: {{'a': a, 'c': CASE WHEN contains(a, ',') AND len({comma}) >= 2 THEN {comma} ELSE [] END, 's': string_split(a, ' ')}})"
    last = "CASE WHEN len(p.c) > 0 THEN p.c[1] WHEN len(p.s) >= 2 THEN p.s[-1] END"
    first = "CASE WHEN len(p.c) > 0 THEN array_to_string(p.c[2:], ' ') WHEN len(p.s) >= 2 THEN array_to_string(p.s[:-2], ' ') END"
    return f"list_transform({parts}, lambda p: {{'last': {last}, 'first': {first}, 'name': CASE WHEN len(p.c) = 0 AND len(p.s) < 2 THEN p.a END}})"


def bib_authors(x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') = '' THEN 'Unknown' ELSE array_to_string(list_transform({people(x)}, lambda m: coalesce(m.name, m.last || ', ' || m.first)), ' and ') END"


def bib_entry(kind: str) -> str:
    line = lambda name, v: f"CASE WHEN coalesce({v}, '') <> '' THEN '  {name} = {{' || {escaped(v)} || '}},' END"
    return f"""concat_ws(chr(10), '@' || {kind} || '{{' || doc_id || ',', {line('title', 'title')}, '  author = {{' || {escaped(bib_authors('author'))} || '}},', '  year = {{' || year || '}},', {line('journal', 'journal')}, {line('publisher', 'publisher')}, {line('doi', 'doi')}, {line('isbn', 'isbn')}, {line('file', 'path')}, '}}')"""


ORACLES["citeable_items"] = f"WITH {CITED} SELECT doc_id, citeable, {entry_kind('article', 'book', 'misc')} AS entry, {entry_kind('journalArticle', 'book', 'document')} AS item FROM cb"
ORACLES["bibtex_corpus"] = f"WITH {CITED}, z AS (SELECT *, NULL AS publisher, 'library/' || filename AS path FROM cb) SELECT doc_id, {bib_entry(entry_kind('article', 'book', 'misc'))} AS entry FROM z WHERE citeable AND cls <> 'duplicate'"
ORACLES["bibtex_entries"] = f"""WITH z AS (SELECT *, source_class AS cls FROM {rows([(*r[:9], r[9]) for r in sa.CITED], 'doc_id, title, author, year, doi, isbn, journal, publisher, path, source_class')})
SELECT doc_id, {bib_entry(entry_kind('article', 'book', 'misc'))} AS entry FROM z WHERE title <> '' AND year IS NOT NULL AND (doi IS NOT NULL OR isbn IS NOT NULL) AND cls <> 'duplicate'"""
JS = "coalesce(to_json({})::VARCHAR, 'null')".format
ORACLES["sync_records"] = f"""WITH {CITED}, r AS (SELECT * FROM cb WHERE citeable AND cls <> 'duplicate' QUALIFY row_number() OVER (PARTITION BY sha ORDER BY doc_id DESC) = 1)
SELECT sha AS sha256, doc_id, sha256('{{"author":' || {JS('author')} || ',"doc_id":' || doc_id || ',"doi":' || {JS('doi')} || ',"isbn":' || {JS('isbn')} || ',"journal":' || {JS('journal')} || ',"path":"library/' || filename || '","publisher":null,"source_class":"' || cls || '","title":' || {JS('title')} || ',"year":' || year || '}}') AS fingerprint,
sha256('{{"filename":"' || filename || '","path":"library/' || filename || '"}}') AS attachment_fingerprint FROM r"""
ORACLES["fingerprints"] = f"""WITH {EXACT} SELECT doc_id, sha256('{{"author":null,"canonical_doc_id":' || canonical || ',"filename":' || {JS('filename')} || ',"mode":"deterministic","page_count":' || page_count || ',"relationship":'
|| CASE WHEN cls = 'duplicate' THEN '{{"kind":"exact_duplicate_of","target_doc_id":' || canonical || '}}' ELSE 'null' END || ',"sha256":"' || sha || '","source_class":"' || cls || '","title":' || {JS('title')} || ',"version":"1","year":null}}') AS fingerprint FROM x"""
ORACLES["creators"] = f"""WITH a AS (SELECT c_custkey AS k, c_name || ', ' || c_mktsegment || ' Jr; ' || lower(c_mktsegment) || '  ' || c_name || ';; solo' || c_custkey AS authors FROM customer)
SELECT k, array_to_string(list_transform({people('authors')}, lambda m: coalesce(m.last, '-') || '|' || coalesce(m.first, '-') || '|' || coalesce(m.name, '-')), ';') AS creators, {bib_authors('authors')} AS bibtex FROM a"""
ORACLES["whole_texts"] = f"WITH {PAGES} SELECT doc_id, sha256(string_agg(text, chr(10) ORDER BY page_no)) AS whole, sha256(substring(string_agg(text, chr(10) ORDER BY page_no) FILTER (page_no <= 10), 1, 25000)) AS excerpt FROM p GROUP BY doc_id"
ORACLES["quality_flags"] = f"""WITH {PAGES} SELECT doc_id, count(*) AS page_count, sum(strlen(text))::BIGINT AS text_bytes, CASE WHEN doc_id IN (SELECT l.doc_id FROM labels l WHERE toxic = 1) THEN 'ocr_extracted' ELSE '' END AS flags, avg(length(text)) < 50 AS needs_ocr FROM p GROUP BY doc_id"""
ORACLES["stub_pages"] = f"""WITH {EXACT}, s AS (SELECT *, CASE WHEN title = '' THEN doc_id::VARCHAR ELSE title END AS t FROM x WHERE cls = 'duplicate') SELECT doc_id, concat_ws(chr(10), '---', 'doc_id: "' || doc_id || '"', 'title: "' || replace(t, '"', '\\"') || '"', 'source_class: "duplicate"',
'canonical_doc_id: "' || canonical || '"', 'keywords: []', 'aliases:', '  - "' || filename || '"', 'related:', '  - "exact_duplicate_of: [[source/' || canonical || ']]"', '---', '', '# ' || t, '', '## Status', '', 'Exact duplicate of [[source/' || canonical || ']].') || chr(10) AS markdown FROM s"""
ORACLES["relationship_lines"] = f"WITH {EXACT} SELECT doc_id, CASE WHEN cls = 'duplicate' THEN 'exact_duplicate_of: [[source/' || canonical || ']]' ELSE '' END AS line FROM x"
ORACLES["canonical_filenames"] = rf"""WITH v AS (SELECT *, list_filter(list_transform(string_split(coalesce(author, ''), ';'), lambda a: trim(a)), lambda a: a <> '') AS who FROM {rows(sa.NAMED, 'year, title, author, doc_id, suffix')}),
l AS (SELECT *, list_transform(who, lambda p: trim(CASE WHEN contains(p, ',') THEN split_part(p, ',', 1) ELSE regexp_extract(p, '[^ ]*$') END)) AS names FROM v),
n AS (SELECT *, CASE len(names) WHEN 0 THEN NULL WHEN 1 THEN names[1] WHEN 2 THEN names[1] || '-' || names[2] ELSE names[1] || '-etal' END AS makers,
  nullif(array_to_string(list_filter(regexp_split_to_array(coalesce(title, ''), '[^\p{{L}}\p{{N}}_]+'), lambda w: lower(w) NOT IN {among(lx.TITLE_SMALL_WORDS)})[1:4], ' '), '') AS short, CASE WHEN year <> 0 THEN year::VARCHAR END AS y FROM l),
r AS (SELECT *, CASE WHEN makers IS NULL AND short IS NULL THEN nullif(CASE WHEN y IS NOT NULL AND starts_with(doc_id, y) THEN ltrim(substring(doc_id, length(y) + 1), '-_ ') ELSE doc_id END, '') END AS rest FROM n),
q AS (SELECT *, string_split({slug("concat_ws('-', y, makers, short, rest)")}, '-') AS parts FROM r)
SELECT doc_id, CASE WHEN coalesce(y, makers, short, rest) IS NULL THEN 'untitled-document' ELSE array_to_string(list_filter(parts, lambda p, i: i = 1 OR p <> parts[i - 1]), '-') END || suffix AS filename FROM q"""
ORACLES["markdown_sections"] = rf"""WITH m AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(#+\s+.*)$', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS l FROM {rows(sa.MARKDOWN, 'doc_id, text')}),
s AS (SELECT doc_id, unnest(l) AS part, generate_subscripts(l, 1) - 1 AS i FROM m),
b AS (SELECT doc_id, i, CASE WHEN i = 0 THEN 'Frontmatter' ELSE trim(regexp_replace(split_part(part, chr(2), 1), '^[#\s]+|[#\s]+$', '', 'g')) END AS section_title,
  regexp_replace(CASE WHEN i = 0 THEN part ELSE substring(part, instr(part, chr(2)) + 1) END, '^\s+|\s+$', '', 'g') AS text FROM s)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::INT AS page_no, {slug('section_title')} AS page_key, section_title, text, length(text) AS char_count, {preview('text')} AS preview FROM b WHERE text <> '' OR i = 0"""


def unescaped(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x


PLAIN = unescaped(compact("regexp_replace(q, '(?s)<[^>]*>', ' ', 'g')"))
ORACLES["html_sections"] = rf"""WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g') AS h FROM pages),
a AS (SELECT page_id, h, regexp_extract(h, '(?is)<article[^>]*>(.*?)</article>', 1) AS art FROM b),
l AS (SELECT page_id, list_concat(list_transform(regexp_extract_all(h, '(?is)<title[^>]*>(.*?)</title>', 1)[1:1], lambda q: {{'kind': 'title', 'text': {PLAIN}}}), list_transform(regexp_extract_all(art, '(?is)<h1[^>]*>(.*?)</h1>', 1), lambda q: {{'kind': 'h1', 'text': {PLAIN}}}),
  list_transform(regexp_extract_all(art, '(?is)<p\b[^>]*>(.*?)</p>', 1), lambda q: {{'kind': 'p', 'text': {PLAIN}}})) AS f FROM a),
e AS (SELECT page_id, unnest(f) AS s, generate_subscripts(f, 1) - 1 AS i FROM l)
SELECT page_id, i::INT AS section_no, s.kind AS kind, s.text AS text FROM e WHERE s.text <> ''"""
