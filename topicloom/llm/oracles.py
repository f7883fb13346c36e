"""DuckDB SQL for what it can say of the training-data operators."""

from __future__ import annotations

from topicloom.llm import embed_dedup, lm, mixing, spelling, url_filter, whitening
from topicloom.llm.common import LOWER, UPPER


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _words(text: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT)"


def embeddings(cosine: float = embed_dedup.COSINE) -> str:
    """All pairs of usable vectors, and what each reaches by links."""
    return f"""
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS i, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS s, b.vec_id AS t FROM e a JOIN e b ON a.i <> b.i AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {cosine}),
r(node, root) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.t, r.root FROM r JOIN l ON r.node = l.s),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
n AS (SELECT s, count(*) AS n FROM l GROUP BY s)
SELECT x.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.root, x.vec_id) AS component_id, coalesce(coalesce(c.root, x.vec_id) = x.vec_id, true) AS kept
FROM embeddings x LEFT JOIN c ON c.node = x.vec_id LEFT JOIN n ON n.s = x.vec_id"""


def chat() -> str:
    """Digests of the turns themselves, and the length of the template around them."""
    marks = ("<s>", "</s>", "[INST]", "[/INST]", "\\")
    escaped = " + ".join(["length({0})", *(f"(length({{0}}) - length(replace({{0}}, {_sql(m)}, ''))) // {len(m)}" for m in marks)])
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (
  SELECT *, role = 'assistant' AS reply, {len("<s>[INST][/INST]</s>")} + {escaped.format("role")} + {escaped.format("text")} AS shown,
    row_number() OVER w AS nr, count(*) OVER (PARTITION BY conv_id) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY nr) AS upto FROM s)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256,
  CAST(length(coalesce(string_agg(text, '' ORDER BY nr) FILTER (reply), '')) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nr) FILTER (reply), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (reply OR nr = n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id"""


def urls(rules=url_filter.RULES) -> str:
    """Rules and the list itself, without a filter before it."""
    case = {"rule": "", "verdict": ""}
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = f"(host = {_sql(host)} OR ends_with(host, {_sql('.' + host)})) AND starts_with(path, {_sql(path)})"
        case["rule"] += f" WHEN {fits} THEN {_sql(host + path)}"
        case["verdict"] += f" WHEN {fits} THEN {_sql(verdict)}"
    lists = [f"unnest([{', '.join(map(_sql, v))}])" for v in (url_filter.LISTED_SITES, url_filter.LISTED_SECTIONS, ("", "?page=2"))]
    return f"""
WITH listed AS (
  SELECT site || '/' || section || '/' || n || q AS key FROM (SELECT {lists[0]} AS site) CROSS JOIN (SELECT {lists[1]} AS section)
  CROSS JOIN (SELECT CAST(range AS VARCHAR) AS n FROM range({url_filter.LISTED_PAGES})) CROSS JOIN (SELECT {lists[2]} AS q)),
u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, rest,
    array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda f: f <> '' AND NOT starts_with(f, 'utm_') AND NOT starts_with(f, 'ref=')), '&') AS query FROM u),
k AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html)?/*\\z', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS key FROM p)
SELECT page_id, host, path, CASE{case["rule"]} END AS rule, CASE{case["verdict"]} WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, l.key IS NOT NULL AS listed
FROM k LEFT JOIN listed l ON l.key = k.key"""


def mixing_targets(weights=mixing.WEIGHTS, total: float = mixing.TOTAL, cap: float = mixing.CAP) -> str:
    """Sizes and targets: with sources by limit over weight, the level is the largest that results from a capped prefix."""
    case = " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(weights))
    return f"""
WITH d AS (SELECT doc_id, source, {_words("text")} AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {case} END AS weight, {cap}::DOUBLE * source_size AS cap FROM s),
b AS (SELECT *, {total}::DOUBLE * sum(source_size) OVER () AS budget, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nr FROM w),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b),
t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM l)
SELECT d.doc_id, d.size, t.source_size, round(t.target, 3) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""


def _crc32_of_hex(digits: str) -> str:
    """Checksum of bytes written as hexadecimal digits, bit by bit."""
    octets = f"[('0x' || substr({digits}, 2 * i - 1, 2))::BIGINT for i in range(1, length({digits}) // 2 + 1)]"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {step}), 4294967295)"


def _crc32(blob: str) -> str:
    return _crc32_of_hex(f"hex({blob})")


def media_payloads(unit: int = 64) -> str:
    """Sizes and digests of padded texts, and the checksum of their last bytes."""
    return f"""
SELECT doc_id, n_bytes, n_bytes + pad AS payload_bytes, sha256(coalesce(text, '') || repeat(chr(0), CAST(pad AS INTEGER))) AS payload_sha256, {_crc32_of_hex("tail")} AS tail_crc32
FROM (SELECT *, right(hex(encode(coalesce(text, ''))) || repeat('00', CAST(pad AS INTEGER)), {2 * unit}) AS tail
  FROM (SELECT doc_id, text, n_bytes, CASE WHEN n_bytes = 0 THEN {unit} ELSE ({unit} - n_bytes % {unit}) % {unit} END AS pad
    FROM (SELECT doc_id, text, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents)))"""


def whitening_deviations(scale: int = whitening.SCALE, components: int = whitening.COMPONENTS) -> str:
    """Exact deviations of usable vectors; a component has a row where the vectors' rank allows one."""
    return f"""
WITH e AS (SELECT row_number() OVER () AS i, vec_id, [CAST(floor({scale} * c::DOUBLE) AS BIGINT) FOR c IN embedding] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
f AS (SELECT DISTINCT x FROM e),
s AS (SELECT d, CAST(sum(c) AS BIGINT) AS total, count(*) AS n FROM (SELECT unnest(x) AS c, unnest(range(len(x))) AS d FROM f) GROUP BY d),
v AS (SELECT i, any_value(vec_id) AS vec_id, any_value(n) AS n, CAST(sum((n * c - total) * (n * c - total)) AS BIGINT) AS deviation
  FROM (SELECT i, vec_id, unnest(x) AS c, unnest(range(len(x))) AS d FROM e) JOIN s USING (d) GROUP BY i)
SELECT vec_id, CAST(k AS INTEGER) AS component, n, deviation FROM v, range(1, {components} + 1) t(k) WHERE k < n"""


def spelling_variants() -> str:
    """Near words by their remains without one letter; forms by count; roots by recursion."""
    of, least, enough, ratio = spelling.DAMAGE, spelling.LEAST_LETTERS, spelling.LEAST_COUNT, spelling.RATIO
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{spelling.RUN}')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM t WHERE length(run) >= {least} GROUP BY doc_id, run),
h AS (SELECT run, n, {_crc32("encode(id || ':' || run)")} AS h FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, run, n FROM g)),
c AS (SELECT CASE WHEN h % {of} = 0 THEN substr(run, 1, k) || substr(run, k + 2) ELSE run END AS word, n FROM (SELECT *, CAST(h % length(run) AS INTEGER) AS k FROM h)),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= {least} GROUP BY word HAVING sum(n) >= {enough}),
p AS MATERIALIZED (SELECT word, n, substr(word, 1, CAST(i AS INTEGER) - 1) AS l, substr(word, CAST(i AS INTEGER) + 1) AS r FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
d AS (SELECT DISTINCT p.word AS a, p.n AS na, w.word AS b, w.n AS nb FROM p JOIN w ON w.word = p.l || p.r),
near AS MATERIALIZED (SELECT a.word, b.word AS near, b.n AS near_n FROM p a JOIN p b ON a.l = b.l AND a.r = b.r AND a.word <> b.word UNION SELECT a, b, nb FROM d UNION SELECT b, a, na FROM d),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS rank FROM near),
x AS MATERIALIZED (SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN near_n >= {ratio} * w.n THEN near END AS form, CASE WHEN near_n >= {ratio} * w.n THEN near_n END AS form_n FROM w LEFT JOIN best ON best.word = w.word AND rank = 1),
f(word, root) AS (SELECT word, word FROM x UNION ALL SELECT f.word, x.form FROM f JOIN x ON x.word = f.root WHERE x.form IS NOT NULL)
SELECT x.word, x.form, f.root, x.n, x.n_near, x.form_n FROM x JOIN f USING (word) JOIN x AS e ON e.word = f.root WHERE e.form IS NULL"""


def lm_base_scores() -> str:
    """Counts of the training documents' tokens, and what they say of each document."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), ' ') AS ws,
    {_crc32("encode(coalesce(CAST(doc_id AS VARCHAR), ''))")} % {lm.OF} = {lm.HELD_OUT} AS held_out FROM documents),
t AS MATERIALIZED (SELECT i, held_out, unnest(ws) AS w FROM d),
c AS MATERIALIZED (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
s AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
p AS (SELECT i, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)))) AS base FROM t LEFT JOIN c USING (w) CROSS JOIN s GROUP BY i)
SELECT d.doc_id, d.held_out, p.n_tokens, p.n_known, CAST(s.n AS BIGINT) AS train_tokens, round(p.base, 3) AS base_score FROM d JOIN p USING (i) CROSS JOIN s"""


ORACLES: dict[str, str] = {
    "op2_embedding_near_dedup": embeddings(),
    "op4_chat_formatting": chat(),
    "op5_url_filter": urls(),
    "shard_sizes": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size, 'bytes' AS law FROM documents",
    "mixing_targets": mixing_targets(),
    "op12_spelling_variants": spelling_variants(),
    "whitening_deviations": whitening_deviations(),
    "lm_base_scores": lm_base_scores(),
    "media_payloads": media_payloads(),
}
