"""DuckDB SQL for the queries whose results plain SQL can state."""

from __future__ import annotations

from . import decontaminate, infill, jaccard, merkle, quality, urls

_WORD, _BENCH_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _low(text: str) -> str:
    return f"translate({text}, '{urls.UPPER}', '{urls.LOWER}')"


def _strength(level: str) -> str:
    """Prior strength of a level (n, k, m), see `urls`."""
    return f"""(SELECT (1 - rho) / rho FROM (SELECT least(0.5::DOUBLE, greatest(0.0001::DOUBLE, CASE WHEN coalesce(w, 0) = 0
      THEN 0.0001::DOUBLE ELSE (s - v) / w END)) AS rho FROM (SELECT sum((k - n * m) * (k - n * m)) AS s,
      sum(n * m * (1 - m)) AS v, sum(n * m * (1 - m) * (n - 1)) AS w FROM {level})))"""


def _rules(column: int) -> str:
    whens = []
    for text, decision in sorted(urls.RULES, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        whens.append(f"WHEN (host = '{name}' OR host LIKE '%.{name}') AND starts_with(path, '/{rest}') "
                     f"THEN '{(text, decision)[column]}'")
    return f"CASE {' '.join(whens)} END"


_SECOND = ", ".join(f"'{s}'" for s in urls.SECOND_LEVEL)

OP3 = rf"""
WITH parts AS (
  SELECT page_id, coalesce({_low("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
counts AS (
  SELECT host, count(bad) AS n, sum(bad) AS k FROM parts
  JOIN (SELECT doc_id, CAST(quality = 0 OR toxic = 1 AS INTEGER) AS bad FROM labels) ON page_id = doc_id GROUP BY host),
named AS (SELECT DISTINCT host, string_split(host, '.') AS l FROM parts),
domained AS (
  SELECT host, CASE WHEN len(l) > 2 AND l[-2] IN ({_SECOND}) AND length(l[-1]) = 2 THEN array_to_string(l[len(l) - 2:], '.')
    WHEN len(l) > 2 THEN array_to_string(l[len(l) - 1:], '.') ELSE host END AS domain FROM named),
hosts AS (
  SELECT host, domain, CASE WHEN instr(domain, '.') > 0 THEN substr(domain, instr(domain, '.') + 1) ELSE domain END AS suffix,
    coalesce(n, 0)::DOUBLE AS n, coalesce(k, 0)::DOUBLE AS k FROM domained LEFT JOIN counts USING (host)),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k,
    (SELECT coalesce(sum(k) / nullif(sum(n), 0), 0) FROM hosts) AS m FROM domains GROUP BY suffix),
s1 AS (SELECT suffix, (k + s * m) / (n + s) AS mean FROM (SELECT *, {_strength("s0")} AS s FROM s0)),
d0 AS (SELECT domain, n, k, mean AS m FROM domains JOIN s1 USING (suffix)),
d1 AS (SELECT domain, (k + s * m) / (n + s) AS mean FROM (SELECT *, {_strength("d0")} AS s FROM d0)),
h0 AS (SELECT host, n, k, mean AS m FROM hosts JOIN d1 USING (domain)),
h1 AS (SELECT host, n, s, (k + s * m) / (n + s) AS mean FROM (SELECT *, {_strength("h0")} AS s FROM h0)),
h2 AS (SELECT host, mean, sqrt(mean * (1 - mean) / (n + s + 1)) AS sd FROM h1)
SELECT page_id, host, path, {_rules(0)} AS rule,
  coalesce({_rules(1)}, CASE WHEN mean - {urls.Z}::DOUBLE * sd > {urls.LIMIT}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
  mean AS bad_rate, sd AS bad_rate_sd
FROM parts LEFT JOIN h2 USING (host)"""

_K = decontaminate.WINDOW

OP5 = rf"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({_low("text")}, '{_BENCH_WORD}') AS ws
  FROM benchmark WHERE text IS NOT NULL),
p AS (
  SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (
    SELECT item, ws, least(len(ws), {_K}) AS k, unnest(range(1, greatest(len(ws) - {_K - 1}, 1) + 1)) AS i
    FROM b WHERE len(ws) > 0)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_BENCH_WORD}') AS ws
  FROM documents),
g AS (
  SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (
    SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d JOIN (SELECT DISTINCT k FROM p) ON len(ws) >= k)),
h AS (SELECT r, i, k, item FROM g JOIN p USING (k, g)),
words AS (SELECT r, count(DISTINCT w) AS n FROM (SELECT r, unnest(range(i, i + k)) AS w FROM h) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM h GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AND {decontaminate.HIT_PERCENT_INVERSE} * coalesce(words.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

_R = quality.REPEAT_WINDOW
_PLAIN = f"translate(l, '{urls.UPPER}0123456789', '{urls.LOWER}0000000000')"

OP6 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
grams AS (
  SELECT r, i, array_to_string(ws[i:i + {_R - 1}], ' ') AS g FROM (
    SELECT r, ws, unnest(range(1, len(ws) - {_R - 2})) AS i FROM w WHERE len(ws) >= {_R})),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + {_R})) AS x FROM twice) GROUP BY r),
raw AS (
  SELECT r, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS p FROM d),
lines AS (
  SELECT r, p, l, len(ws) AS words, array_to_string(ws, ' ') AS line FROM (
    SELECT r, p, l, regexp_extract_all({_PLAIN}, '{_WORD}') AS ws FROM raw) WHERE len(ws) > 0),
placed AS (SELECT r, host, t, line, words FROM lines JOIN d USING (r)),
sized AS (SELECT host, count(DISTINCT t) * {quality.SHARE} AS share FROM d GROUP BY host),
counts AS (SELECT host, line, count(DISTINCT t) AS docs FROM placed GROUP BY ALL),
over AS (SELECT host, line FROM counts JOIN sized USING (host) WHERE docs > greatest({quality.MIN_DOCS}, share)),
lost AS (SELECT r, sum(words) AS words, count(*) AS n FROM placed SEMI JOIN over USING (host, line) GROUP BY r),
dups AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
figures AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dups.n, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed_lines,
    coalesce(lost.words, 0)::BIGINT AS n_removed_words
  FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN dups USING (r) LEFT JOIN lost USING (r)),
failed AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed
  FROM figures)
SELECT *, NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {quality.MIN_WORDS}
  OR 100 * (n_words - n_removed_words) < {quality.MIN_LEFT_PERCENT} * n_words)) AS kept FROM failed"""

# Base32 takes five bits a character; ten hexadecimal digits are eight characters.
OP9 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
s AS (SELECT *, sha1(body) AS sha, max(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(sha, 1 + 10 * (c // 8), 10) AS BIGINT)
    >> (35 - 5 * (c % 8))) & 31) AS BIGINT), 1) FOR c IN range(32)], '') AS payload_digest,
  CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM s"""

_S = jaccard.SIZE

OP10 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_low("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents),
grams AS (
  SELECT DISTINCT r, array_to_string(ws[i:i + {_S - 1}], ' ') AS g FROM (
    SELECT r, ws, unnest(range(1, greatest(len(ws) - {_S - 1}, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
pairs AS (
  SELECT a.r AS a, b.r AS b, count(*) AS common FROM grams AS a JOIN grams AS b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes AS x ON x.r = a JOIN sizes AS y ON y.r = b
  WHERE 100 * common >= {jaccard.PERCENT} * (x.n + y.n - common)),
reach AS (
  SELECT r AS a, r AS b FROM d
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN sizes USING (r)
JOIN (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a) AS c USING (r)"""


def _field(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(count: str) -> str:
    return "sha256(" + " || ".join(_field(count if f == "n_chars" else f) for f in merkle.FIELDS) + ")"


def _levels(name: str, leaves: str) -> str:
    """All levels of the trees of (tree, idx, h)."""
    return f"""{name} AS (
  SELECT 0 AS level, tree, idx, h, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
  UNION ALL
  SELECT level + 1, tree, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 1) // 2)
  FROM {name} WHERE n > 1 GROUP BY level, tree, idx // 2)"""


def _steps(nodes: str, levels: str) -> str:
    """Steps (r, level, slot, h) from the nodes (r, tree, idx) to the roots of their trees; h is the sibling, if any."""
    return f"""SELECT x.r, l.level, (x.idx >> l.level) & 1 AS slot, s.h FROM {nodes} AS x
  JOIN (SELECT DISTINCT tree, level FROM {levels} WHERE n > 1) AS l ON l.tree = x.tree
  LEFT JOIN {levels} AS s ON s.tree = x.tree AND s.level = l.level AND s.idx = xor(x.idx >> l.level, 1::BIGINT)"""


# The table of crc32 has an entry for each byte, eight steps from its number.
OP12 = f"""
WITH RECURSIVE crc(i, k, c) AS (
  SELECT i, 0, i FROM range(256) AS t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM crc WHERE k < 8),
d AS (SELECT row_number() OVER () AS r, coalesce('=' || lang, '') AS tree, doc_id, {_leaf("n_chars")} AS leaf,
  {_leaf("n_chars + 1")} AS changed FROM documents),
sums(r, rest, c) AS (
  SELECT r, CAST(doc_id AS VARCHAR), 4294967295::BIGINT FROM d WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT r, substr(rest, 2), xor(crc.c, sums.c >> 8) FROM sums
  JOIN crc ON crc.k = 8 AND crc.i = xor(sums.c, ascii(rest)::BIGINT) & 255 WHERE rest <> ''),
chosen AS (SELECT r FROM sums WHERE rest = '' AND xor(c, 4294967295::BIGINT) % 7 = 0),
leaves AS (SELECT r, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS h FROM d),
{_levels("up", "leaves")},
subroots AS (SELECT tree AS name, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, h FROM up WHERE n = 1),
{_levels("top", "subroots")},
height AS (SELECT tree AS name, level AS high FROM up WHERE n = 1),
named AS (SELECT name AS r, tree, idx FROM subroots),
steps AS (
  SELECT r, level, slot, h FROM ({_steps("leaves", "up")})
  UNION ALL
  SELECT leaves.r, high + s.level, s.slot, s.h FROM ({_steps("named", "top")}) AS s
  JOIN height ON height.name = s.r JOIN leaves ON leaves.tree = s.r),
proofs AS (SELECT r, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof FROM steps GROUP BY r),
folded(r, level, h) AS (
  SELECT d.r, 0, CASE WHEN chosen.r IS NOT NULL THEN changed ELSE leaf END FROM d LEFT JOIN chosen ON chosen.r = d.r
  UNION ALL
  SELECT f.r, f.level + 1, sha256(CASE WHEN slot = 0 THEN f.h || coalesce(s.h, '') ELSE coalesce(s.h, '') || f.h END)
  FROM folded AS f JOIN steps AS s ON s.r = f.r AND s.level = f.level),
ends AS (SELECT r, max(level) AS level FROM folded GROUP BY r)
SELECT d.doc_id, d.leaf, subroots.h AS subroot, root.h AS root, coalesce(proof, sha256('')) AS proof_sha256,
  folded.h AS folded_root, folded.h = root.h AS verified
FROM d JOIN subroots ON subroots.name = d.tree JOIN (SELECT h FROM top WHERE n = 1) AS root ON true
JOIN ends ON ends.r = d.r JOIN folded ON folded.r = d.r AND folded.level = ends.level
LEFT JOIN proofs ON proofs.r = d.r"""

def _number(group: int) -> str:
    return f"CAST('0x' || substr(digest, {1 + 8 * group}, 8) AS BIGINT)"


_MARKED = " OR ".join(f"contains(t, '{m.decode()}')" for m in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE))
_P, _S_, _M = (m.decode() for m in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE))

OP11 = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
    sha256('{infill.SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
c AS (
  SELECT *, least({_number(0)} % (n + 1), {_number(1)} % (n + 1)) AS lo, greatest({_number(0)} % (n + 1), {_number(1)} % (n + 1)) AS hi,
    CASE WHEN n = 0 OR {_MARKED} OR {_number(2)} % 100 >= {infill.RATE} THEN 'plain'
      WHEN {_number(3)} % 100 < {infill.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(t, 1, lo) AS a, substr(t, lo + 1, hi - lo) AS b, substr(t, hi + 1) AS c FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{_P}' || a || '{_S_}' || c || '{_M}' || b
    ELSE '{_S_}' || c || '{_P}' || a || '{_M}' || b END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""

QUERIES = {"op3_url_reputation": OP3, "op5_decontaminate": OP5, "op6_quality_rules": OP6, "op9_warc": OP9,
           "op10_jaccard_join": OP10, "op11_fill_in_middle": OP11,
           "op12_merkle_manifest": OP12}
