"""DuckDB SQL for the queries that SQL can express.

Texts of one doc_id are taken to be one row, as in the given tables.
"""

from __future__ import annotations

from . import licenses, mixing, secrets


def _spans(kind: str, order: int, pattern: str, keep: str = "true") -> str:
    """(doc_id, start_at, ord, end_at, kind, hit) of the matches of one kind."""
    p = pattern.replace("'", "''")
    return f"""SELECT * FROM (SELECT doc_id, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::BIGINT AS start_at, {order} AS ord, hits[i] AS hit, '{kind}' AS kind
    FROM (SELECT doc_id, hits, pieces, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS hits, string_split_regex(t, '{p}') AS pieces FROM d WHERE regexp_matches(t, '{p}')))) WHERE {keep}"""


def secret_scan() -> str:
    value = secrets.ASSIGN_VALUE.replace("'", "''")
    allowed = " AND ".join("NOT regexp_matches(hit, '" + p + "')" for p in secrets.ALLOWED)
    bits = "CASE " + " ".join(f"WHEN regexp_matches(hit, '{shape}') THEN {least}" for _, shape, _, least in secrets.CLASSES) + " END"
    entropy = f"list_max(list_transform(range(1, length(hit) - {secrets.WINDOW - 2}), lambda i: list_aggregate(string_split(substr(hit, i::INT, {secrets.WINDOW}), ''), 'entropy')))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS ({_spans("assign", 0, secrets.ASSIGN, f"length(regexp_extract(hit, '{value}', 1)) >= 6")} UNION ALL {_spans("access", 1, secrets.ACCESS)} UNION ALL {_spans("hex", 2, secrets.HEX)}),
runs AS ({_spans("entropy", 3, secrets.CANDIDATE, f"regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND {allowed}")}),
random AS (SELECT * FROM runs r WHERE {entropy} >= {bits} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start_at < r.start_at + length(r.hit) AND r.start_at < b.start_at + length(b.hit))),
every AS (SELECT *, kind || ':' || start_at || ':' || (start_at + length(hit)) AS said FROM (SELECT * FROM base UNION ALL SELECT * FROM random))
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY start_at, ord) FILTER (WHERE ord < 3), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY start_at, ord), '') AS spans
FROM d LEFT JOIN every USING (doc_id) GROUP BY d.doc_id"""


def license_scan() -> str:
    k = licenses.K
    rows = [(i, base, label, t.split()) for i, (t, label, base) in enumerate([(p, lab, True) for p, lab in licenses.PHRASES.items()] + [(t, lab, False) for t, lab in licenses.TEMPLATES])]
    values = ", ".join(f"({i}, {base}, '{label}', {len(w) - k + 1}, {j}, '{' '.join(w[j : j + k])}')" for i, base, label, w in rows for j in range(len(w) - k + 1))
    return f"""WITH tm(tmpl, base, label, grams, tpos, gram) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS dpos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
hit AS (SELECT DISTINCT doc_id, tmpl, base, label, grams, tpos, dpos - tpos AS diag FROM g JOIN tm USING (gram)),
diag AS (SELECT DISTINCT doc_id, tmpl, base, diag FROM hit),
marked AS (SELECT *, CASE WHEN base OR lag(diag) OVER w IS NULL OR diag - lag(diag) OVER w > {licenses.NEAR} THEN 1 ELSE 0 END AS fresh FROM diag WINDOW w AS (PARTITION BY doc_id, tmpl ORDER BY diag)),
spanned AS (SELECT doc_id, tmpl, diag, sum(fresh) OVER (PARTITION BY doc_id, tmpl ORDER BY diag ROWS UNBOUNDED PRECEDING) AS span FROM marked),
s AS (SELECT doc_id, tmpl, base, label, grams, span, min(diag) AS start_at, count(DISTINCT tpos) AS got, bool_or(tpos = grams - 1) AS ended FROM hit JOIN spanned USING (doc_id, tmpl, diag) GROUP BY ALL),
f AS (SELECT *, base AND got = grams AS place, got / grams AS cover FROM s)
SELECT d.doc_id, any_value(len(w)) AS n_words, count(*) FILTER (WHERE place) AS n_base, min(start_at) FILTER (WHERE place) AS first_word, max(start_at) FILTER (WHERE place) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE place OR (NOT base AND cover >= {licenses.COVER} AND ended)), '') AS labels, coalesce(max(cover), 0.0)::DOUBLE AS score
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


def curriculum() -> str:
    passes = lambda asked: "CASE WHEN size > 0 THEN " + " + ".join(f"(CASE WHEN {p} * qs + middle <= {asked} THEN 1 ELSE 0 END)" for p in range(mixing.MOST_PASSES)) + " ELSE 0 END"
    pick = lambda xs: "[" + ", ".join(f"{x}::DOUBLE" for x in xs) + "][(i % 3 + 1)::INT]"
    return f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, count(*) AS n, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, {pick(mixing.WEIGHTS)} AS weight, {pick(mixing.SLOPES)} AS slope, ss * {float(mixing.MOST_PASSES)}::DOUBLE AS cap, (sum(ss) OVER ())::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM w WINDOW f AS (ORDER BY cap / weight, source IS NULL, source)),
t AS (SELECT *, CASE WHEN level * weight >= cap THEN cap ELSE max(CASE WHEN level * weight < cap THEN level END) OVER () * weight END AS target FROM l),
q AS (SELECT d.*, ss, target, slope, size > ss / n / 2 AS large FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
m AS (SELECT *, sum(size) OVER (PARTITION BY source, large ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - size + size / 2::DOUBLE AS middle, sum(size) OVER (PARTITION BY source, large) AS qs FROM q),
big AS (SELECT *, target * qs / ss AS asked FROM m WHERE large),
taken AS (SELECT *, {passes("asked")} AS copies FROM big),
got AS (SELECT source, sum(copies * size) AS got FROM taken GROUP BY source),
few AS (SELECT m.*, target - coalesce(got, 0) AS asked FROM m LEFT JOIN got ON m.source IS NOT DISTINCT FROM got.source WHERE NOT large),
every AS (SELECT * FROM taken UNION ALL SELECT *, {passes("asked")} AS copies FROM few),
x AS (SELECT *, least(greatest(middle / asked, 0::DOUBLE), 1::DOUBLE) AS x, 1::DOUBLE - slope AS b FROM every)
SELECT doc_id, size, ss AS source_size, target, copies * size AS taken, source, copies::INT AS copies, CASE WHEN copies > 0 THEN (sqrt(b * b + 4::DOUBLE * slope * x) - b) / (2::DOUBLE * slope) END AS position FROM x"""


SUBSTRINGS = """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
earliest AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
lost AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN earliest USING (g) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN lost USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

NEIGHBOURS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank, vec_id, score FROM p QUALIFY rank <= 10"""


#: The given pages put the main text in one article of headings and paragraphs, so SQL can name it without a model.
MAIN_TEXT = """WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|\\z)', 1), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS parts FROM a)
SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text, length(coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '')) AS n_chars FROM b"""


def all_sql() -> dict[str, str]:
    return {"op2_secret_scan": secret_scan(), "op3_license_scan": license_scan(), "op4_substring_dedup": SUBSTRINGS, "op6_nearest_neighbours": NEIGHBOURS, "op7_curriculum_mix": curriculum(), "op10_html_extraction": MAIN_TEXT}
