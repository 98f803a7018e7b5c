"""DuckDB SQL of the corpus queries that SQL can express over whole tables."""

_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

BBIT_MINHASH = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(id, to_) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.to_),
c AS (SELECT id, min(to_) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id"""

BLOCK_ANCHORS = rf"""
WITH w AS (SELECT doc_id, {_SPACED} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS m FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (h) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (SELECT count(*) FROM gone g WHERE g.doc_id = w.doc_id) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

#: Bytes as two hexadecimal digits each.
BWT_MERGE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(h) // 2)) AS i, h FROM d),
win AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS g FROM p WHERE 2 * i + 100 <= len(h)),
f AS (SELECT g, min(doc_id) AS m FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN f USING (g) WHERE m < doc_id),
n AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (first) AS n_spans FROM (SELECT doc_id, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) <> i - 1, true) AS first FROM gone) GROUP BY 1),
k AS (SELECT doc_id, string_agg(substr(h, 2 * i + 1, 2), '' ORDER BY i) AS kept FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""

SUFFIX_ARRAYS = rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item_id, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item_id, w, least(len(w), 8) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
sizes AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, i, k FROM dw JOIN iw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)"""


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def credential_links() -> str:
    """Spans of all kinds, weak ones where their complementary parts start within the scope."""
    from . import credentials as c

    kinds = ((0, c.ASSIGN), (1, c.ACCESS), (2, c.HEX), (3, c.LOGIN), (5, c.MIXED), (6, c.ENDPOINT))
    raw = " UNION ALL ".join(f"SELECT rid, {k} AS k, regexp_extract_all(t, {_sql(p)}) AS m, string_split_regex(t, {_sql(p)}) AS s FROM t" for k, p in kinds)
    names = "[" + ", ".join(f"'{k}'" for k in c.KINDS) + "]"
    near = f"EXISTS (SELECT 1 FROM parts p WHERE p.rid = w.rid AND abs(p.a - w.a) <= {c.SCOPE} AND p.role = '{{}}')"
    return f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({raw}),
sp AS (SELECT rid, k, m[i] AS x, list_sum([len(z) FOR z IN s[1:i]]) + coalesce(list_sum([len(z) FOR z IN m[1:i - 1]]), 0) AS a FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM raw)),
v AS (SELECT *, a + len(x) AS b, CASE WHEN k = 0 THEN len(regexp_extract(x, {_sql(c.ASSIGN)}, 2)) END AS n FROM sp),
base AS (SELECT rid, k, a, b FROM v WHERE k = 0 AND n >= {c.LEAST_VALUE} OR k = 1 AND len(x) >= {c.LEAST_ACCESS} OR k = 2 AND len(x) >= {c.LEAST_HEX}),
weak AS (SELECT rid, CASE WHEN k = 0 THEN 4 ELSE k END AS k, a, b FROM v WHERE (k IN (3, 6) OR k = 0 AND n < {c.LEAST_VALUE} OR k = 5 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]'))
         AND NOT EXISTS (SELECT 1 FROM base y WHERE y.rid = v.rid AND y.a < v.b AND v.a < y.b)),
parts AS (SELECT *, CASE WHEN k IN (1, 3) THEN 'identifier' WHEN k = 6 THEN 'endpoint' ELSE 'secret' END AS role FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
linked AS (SELECT DISTINCT rid, k, a, b FROM parts w WHERE k >= 3 AND CASE role WHEN 'identifier' THEN {near.format('secret')} WHEN 'secret' THEN {near.format('identifier')} ELSE {near.format('identifier')} AND {near.format('secret')} END),
named AS (SELECT rid, k, a, true AS is_base, {names}[k + 1] || ':' || a::BIGINT || ':' || b::BIGINT AS s FROM base UNION ALL SELECT rid, k, a, false, {names}[k + 1] || ':' || a::BIGINT || ':' || b::BIGINT FROM linked),
agg AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(s, ',' ORDER BY a, k) FILTER (is_base) AS base, string_agg(s, ',' ORDER BY a, k) AS spans, count(*) FILTER (NOT is_base) AS n_linked FROM named GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked FROM t LEFT JOIN agg USING (rid)"""


#: Quotes are linked by an as-of join; threads by recursion.
QUOTATION_THREADS = r"""
WITH RECURSIVE m AS (SELECT DISTINCT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM conversations),
keyed AS MATERIALIZED (SELECT row_number() OVER () AS key, * FROM m),
ln AS (SELECT key, conv_id, turn, i, l[i] AS line, regexp_extract(l[i], '^(?:\x20{0,2}>)+') AS mk FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, string_split_regex(coalesce(text, ''), '\r?\n') AS l FROM keyed))),
dp AS (SELECT key, conv_id, turn, i, line, len(mk) - len(replace(mk, '>', '')) AS depth, trim(substring(line, len(mk) + 1)) AS body FROM ln),
an AS (SELECT *, regexp_matches(body, '(?i)^.{0,200}(wrote|writes|a écrit|schrieb|escribió)\x20*:\x20*$') AND coalesce(lead(depth) OVER o > depth, false) AS ann FROM dp WINDOW o AS (PARTITION BY key ORDER BY i)),
rn AS (SELECT *, sum(coalesce(lag_depth <> depth OR lag_ann OR ann OR (depth = 0 AND lag_body = ''), true)::INT) OVER (PARTITION BY key ORDER BY i) AS run FROM (SELECT *, lag(depth) OVER o AS lag_depth, lag(ann) OVER o AS lag_ann, lag(body) OVER o AS lag_body FROM an WINDOW o AS (PARTITION BY key ORDER BY i))),
ps AS (SELECT key, conv_id, turn, run, any_value(depth) AS depth, lower(trim(regexp_replace(string_agg(body, ' ' ORDER BY i), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS h FROM rn WHERE depth > 0 AND NOT ann GROUP BY 1, 2, 3, 4 HAVING trim(string_agg(body, ' ' ORDER BY i)) <> ''),
own AS (SELECT * FROM rn WHERE depth = 0 AND NOT ann AND body <> ''),
said AS (SELECT DISTINCT conv_id, turn, lower(trim(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS h FROM (SELECT conv_id, turn, string_agg(body, ' ' ORDER BY i) AS t FROM own GROUP BY key, conv_id, turn UNION ALL SELECT conv_id, turn, string_agg(body, ' ' ORDER BY i) FROM own GROUP BY key, conv_id, turn, run UNION ALL SELECT conv_id, turn, body FROM own)),
og AS (SELECT ps.*, (SELECT max(s.turn) FROM said s WHERE s.conv_id = ps.conv_id AND s.h = ps.h AND s.turn < ps.turn) AS original FROM ps),
rp AS (SELECT key, max(depth) AS quote_depth, count(*) AS n_passages, count(original) AS n_linked, max(original) FILTER (depth = 1) AS reply_to FROM og GROUP BY 1),
cl AS (SELECT key, trim(regexp_replace(string_agg(line, chr(10) ORDER BY i), '\n{3,}', chr(10) || chr(10), 'g'), ' ') AS clean FROM rn WHERE depth = 0 AND NOT ann GROUP BY 1),
ds AS (SELECT conv_id, turn, role, CASE WHEN contains(text, '>') THEN coalesce(clean, '') ELSE coalesce(text, '') END AS text, coalesce(quote_depth, 0)::INT AS quote_depth, coalesce(n_passages, 0) AS n_passages, coalesce(n_linked, 0) AS n_linked, reply_to FROM keyed LEFT JOIN rp USING (key) LEFT JOIN cl USING (key)),
pt AS (SELECT conv_id, turn, max(reply_to) AS parent FROM ds GROUP BY 1, 2),
th(conv_id, turn, root, reply_depth) AS (SELECT conv_id, turn, turn, 0 FROM pt WHERE parent IS NULL UNION ALL SELECT p.conv_id, p.turn, th.root, th.reply_depth + 1 FROM pt p JOIN th ON th.conv_id = p.conv_id AND th.turn = p.parent)
SELECT ds.*, root, reply_depth FROM ds LEFT JOIN th USING (conv_id, turn)"""
