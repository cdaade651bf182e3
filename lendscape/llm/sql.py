"""DuckDB answers to the registered queries that SQL can express.

None for SimHash, personal data, token ids, language, fertility and packing: XXH64, spans with checks,
tokenisers and learnt vectors are beyond it. Their tests compare with brute force.
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
h AS (SELECT d, n, max(page_id) AS head FROM p WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, p.n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM p LEFT JOIN h ON p.d = h.d AND p.n = h.n
"""

MIXING = r"""
WITH s AS (
  SELECT doc_id, source AS src, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5('mix|' || doc_id || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS draw
  FROM documents),
g AS (SELECT src, sum(size) AS total, row_number() OVER (ORDER BY src NULLS LAST) - 1 AS nth FROM s GROUP BY src),
w AS (SELECT *, CAST([5, 2, 1][nth % 3 + 1] AS DOUBLE) AS weight, 3.0 * CAST(total AS DOUBLE) AS cap FROM g),
l AS (
  SELECT *, (CAST(sum(total) OVER () AS DOUBLE) - coalesce(sum(cap) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT src, nth, total, least(cap, max(level) OVER () * weight) AS target, CAST(ceil(total / 32) AS BIGINT) AS blocks FROM l),
due AS (SELECT *, CASE WHEN total > 0 THEN target / CAST(total AS DOUBLE) * blocks ELSE 0.0 END AS due FROM t),
upto AS (
  SELECT *, sum(due) OVER (ORDER BY nth) / sum(due) OVER () AS upto, sum(due) OVER () AS slots, nth = max(nth) FILTER (due > 0) OVER () AS last
  FROM due),
share AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY nth), 0.0) AS after FROM upto),
points AS (SELECT slot, slot * 0.6180339887498949::DOUBLE - floor(slot * 0.6180339887498949::DOUBLE) AS point
  FROM (SELECT unnest(range(CAST((SELECT coalesce(ceil(max(slots)), 0) FROM upto) AS BIGINT))) AS slot)),
slots AS (SELECT slot, src, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS k FROM points JOIN share
  ON after <= point AND (point < upto OR last) AND due > 0),
used AS (SELECT t.*, least(coalesce(had, 0), 3 * blocks) AS used FROM t
  LEFT JOIN (SELECT src, count(*) AS had FROM slots GROUP BY src) c ON t.src IS NOT DISTINCT FROM c.src),
q AS (
  SELECT s.*, total, target, blocks, used, sum(size) OVER (PARTITION BY s.src ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS begins
  FROM s JOIN used ON s.src IS NOT DISTINCT FROM used.src),
x AS (
  SELECT *, CAST(CASE WHEN size = 0 THEN 0 ELSE used // blocks * size + greatest(0, least(begins + size, used % blocks * 32) - begins) END AS BIGINT) AS taken
  FROM q)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(total AS BIGINT) AS source_size, target, taken, CASE WHEN taken > 0 THEN slot END AS first_slot
FROM x LEFT JOIN slots ON x.src IS NOT DISTINCT FROM slots.src AND slots.k = begins // 32
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fit AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, links.y FROM reach JOIN links ON reach.r = links.x),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""



def _draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 13) AS BIGINT)"


def _cost(child: str, weight: int) -> str:
    return f"-ln(({_draw("'tree-1'", 'doc_id', f"'{child}'")} + 1) / 4503599627370497.0) / {weight}"


def _lighter(a: str, b: str, weight: int, then: str, other: str) -> str:
    return f"CASE WHEN {_cost(a, weight)} <= {_cost(b, weight)} THEN {then} ELSE {other} END"


_RACKS = [_lighter(f"shard{k}", f"shard{k + 1}", 1, str(k), str(k + 1)) for k in (0, 2, 4, 6)]
_REGIONS = [_lighter("rack0", "rack1", 2, *_RACKS[:2]), _lighter("rack2", "rack3", 2, *_RACKS[2:])]
SHARDING = f"""
WITH step AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
      lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc,
    {_lighter("region0", "region1", 4, *_REGIONS)} AS shard,
    {_cost("region+8", 1)} < least({_cost("region0", 4)}, {_cost("region1", 4)}) AS moves,
    {_draw("'slot'", "doc_id")} AS draw
  FROM documents, step)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY draw, doc_id, crc, size) - 1 AS slot,
  CAST(CASE WHEN moves THEN 8 ELSE shard END AS INT) AS grown_shard
FROM d
"""

# crc32 byte by byte over a text's hex digits, with the table of the reversed polynomial 0xEDB88320.
_CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"""


def _crc32(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'),
      lambda x: CAST('0x' || x AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""


TRIE = rf"""
WITH step AS ({_CRC_TABLE}),
s AS (
  SELECT conv_id, turn, substr(sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))), 1, 32) AS said,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) - 1 AS pos FROM s),
n AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM n, step),
l AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN n b ON b.conv_id = c.base),
r AS (
  SELECT l.conv_id, pos + 1 AS d, said, words FROM l JOIN t ON t.conv_id = l.base AND pos < taken
  UNION ALL SELECT conv_id, taken + pos - h + 1, said, words FROM l JOIN t USING (conv_id) WHERE pos >= h
  UNION ALL SELECT conv_id, 0, '', 0 FROM l),
p AS (SELECT conv_id, d, words, string_agg(said, ',') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r),
q AS (SELECT *, lag(k) OVER conv AS up, lead(d) OVER conv IS NULL AS ends FROM p WINDOW conv AS (PARTITION BY conv_id ORDER BY d)),
v AS (SELECT k, any_value(up) AS up, min(conv_id) AS conv_id, any_value(d) AS d, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY k),
m AS (SELECT up AS k, count(*) AS n_children FROM v GROUP BY up),
w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN m USING (k)),
u AS (SELECT q.k, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved
  FROM w JOIN q ON q.conv_id = w.conv_id AND q.d <= w.d GROUP BY q.k)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, above.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN u USING (k) LEFT JOIN v above ON above.k = w.up
"""

URLS = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
o AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, string_split(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '.') AS parts
  FROM p LEFT JOIN o ON doc_id = page_id GROUP BY host),
f AS (
  SELECT *, array_to_string(parts, '.') AS name, CASE WHEN regexp_matches(array_to_string(parts, '.'), '^[0-9.]*$|^\[') THEN len(parts)
      WHEN len(parts) > 2 AND len(parts[-1]) = 2 AND parts[-2] IN ('ac', 'co', 'com', 'edu', 'go', 'gov', 'mil', 'ne', 'net', 'or', 'org') THEN 2
      ELSE 1 END AS k
  FROM h),
g AS (SELECT *, array_to_string(parts[-k:], '.') AS suffix, array_to_string(parts[-k - 1:], '.') AS domain FROM f),
s AS (SELECT suffix, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM g GROUP BY suffix),
d AS (SELECT suffix, domain, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM g GROUP BY suffix, domain),
s1 AS (SELECT *, (sum(bad) OVER () + 0.5) / (sum(n) OVER () + 1) AS m FROM s),
s2 AS (SELECT (sum((bad - n * m) ** 2) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0) AS rho FROM s1),
s3 AS (SELECT suffix, (m * w + bad) / (n + w) AS rate FROM s1, (SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 2.0), 1000.0) ELSE 1000.0 END AS w FROM s2)),
d1 AS (SELECT d.*, rate AS m FROM d JOIN s3 USING (suffix)),
d2 AS (SELECT (sum((bad - n * m) ** 2) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0) AS rho FROM d1),
d3 AS (SELECT domain, (m * w + bad) / (n + w) AS rate FROM d1, (SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 2.0), 1000.0) ELSE 1000.0 END AS w FROM d2)),
h1 AS (SELECT host, CAST(n AS DOUBLE) AS n, CAST(bad AS DOUBLE) AS bad, rate AS m FROM g JOIN d3 USING (domain)),
h2 AS (SELECT (sum((bad - n * m) ** 2) - sum(n * m * (1 - m))) / nullif(sum(n * (n - 1) * m * (1 - m)), 0) AS rho FROM h1),
h3 AS (SELECT host, n, w, (m * w + bad) / (n + w) AS rate FROM h1, (SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 2.0), 1000.0) ELSE 1000.0 END AS w FROM h2)),
j AS (SELECT host, CAST(n AS BIGINT) AS n_labelled, rate - 1.645 * sqrt(rate * (1 - rate) / (n + w + 1)) AS low FROM h3),
rules(of, start, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
x AS (SELECT host, path, arg_max(of || start, len(of || start)) AS rule, arg_max(verdict, len(of || start)) AS said
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, n_labelled, round(low, 6) AS low
FROM p JOIN j USING (host) LEFT JOIN x USING (host, path)
"""


def _codes() -> str:
    """Four rounds of assigning and moving, then the last assignment, each a step of the query."""

    def assigned(k: int) -> str:
        return f"""
a{k} AS MATERIALIZED (
  SELECT id, part, min(CAST(list_dot_product(w, w) + list_dot_product(c, c) - 2 * list_dot_product(w, c) AS BIGINT) * 256 + entry) AS best
  FROM v JOIN b{k} USING (part) GROUP BY id, part)"""

    def moved(k: int) -> str:
        return f"""
m{k} AS (SELECT part, best % 256 AS entry, i, floor(sum(w[i]) / count(*)) AS x FROM a{k} JOIN v USING (id, part), places GROUP BY part, best % 256, i),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(list(x ORDER BY i) FILTER (x IS NOT NULL), any_value(c)) AS c
  FROM b{k} LEFT JOIN m{k} USING (part, entry) GROUP BY part, entry)"""

    rounds = ",".join(f"{assigned(k)},{moved(k)}" for k in range(4))
    return f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, vec_id, label, list_transform(e, lambda x: floor(1024 * x)) AS z FROM e
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT id, part, z[part * (len(z) // 4) + 1 : (part + 1) * (len(z) // 4)] AS w FROM kept, (SELECT unnest(range(4)) AS part)),
places AS (SELECT unnest(range(1, (SELECT any_value(len(w)) FROM v) + 1)) AS i),
b0 AS MATERIALIZED (SELECT part, id AS entry, w AS c FROM v WHERE id < 256),{rounds},{assigned(4)},
f AS (SELECT id, string_agg(lower(lpad(to_hex(best % 256), 2, '0')), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a4 GROUP BY id),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN f USING (id), s
"""


ANSWERS: dict[str, str] = {
    "op3_warc": WARC, "op6_mixing": MIXING, "op8_embeddings": EMBEDDINGS, "op10_sharding": SHARDING,
    "op11_prefix_trie": TRIE, "op12_url_filter": URLS, "op13_vector_codes": _codes(),
}
