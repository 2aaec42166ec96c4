"""DuckDB SQL for the operators' queries that SQL can express. The others are tested
against brute force, an exact round trip or held-out accuracy."""

from __future__ import annotations

from meterwise.llm.licenses import LEAST_COSINE, LEAST_SHARE, MENTIONS, TEMPLATES, TERM

CHAT = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), conflicts AS (
  SELECT *, bool_or(contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|'))
    OVER (PARTITION BY conv_id) AS odd FROM given
), sums AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>' || role || chr(10) || '<|im_end|>' || chr(10))
      + length(CASE WHEN odd THEN regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') ELSE text END)) AS formatted_chars
  FROM conflicts GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, true AS round_trip
FROM sums
"""

DECONTAMINATION = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents
), item AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM benchmark
), item_at AS (
  SELECT item_id, words, least(13, len(words)) AS n, unnest(range(1, len(words) - least(13, len(words)) + 2)) AS pos
  FROM item WHERE len(words) > 0
), known AS (
  SELECT DISTINCT n, array_to_string(words[pos:pos + n - 1], ' ') AS gram, item_id FROM item_at
), sizes AS (SELECT DISTINCT n FROM known
), doc_at AS (
  SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM doc, sizes WHERE len(words) >= n
), hit AS (
  SELECT doc_id, pos, n, item_id FROM (SELECT doc_id, n, pos, array_to_string(words[pos:pos + n - 1], ' ') AS gram FROM doc_at)
  JOIN known USING (n, gram)
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS place FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def licenses() -> str:
    rows = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
    n = len(TEMPLATES)
    return rf"""
WITH template(t, name, notice) AS (VALUES {rows}
), template_term AS (
  SELECT t, term, count(*) AS tf FROM (SELECT t, unnest(regexp_extract_all(lower(notice), '{TERM}')) AS term FROM template) GROUP BY t, term
), idf AS (SELECT term, ln((1.0 + {n}) / (1 + count(*))) + 1 AS idf FROM template_term GROUP BY term
), weight AS (
  SELECT t, term, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY t)) AS w FROM template_term JOIN idf USING (term)
), file AS (
  SELECT doc_id, concat_ws('/', source, lang, doc_id || '.txt') AS path, coalesce(text, '') AS text FROM documents
), line AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM file)
  WHERE regexp_matches(lower(line), '{MENTIONS}')
), line_term AS (
  SELECT line, term, count(*) AS tf FROM (SELECT line, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM (SELECT DISTINCT line FROM line))
  GROUP BY line, term
), line_weight AS (
  SELECT line, term, tf * coalesce(idf, ln(1.0 + {n}) + 1) AS w FROM line_term LEFT JOIN idf USING (term)
), norm AS (SELECT line, sqrt(sum(w * w)) AS norm FROM line_weight GROUP BY line
), cosine AS (
  SELECT line, t, round(sum(a.w * b.w) / any_value(norm), 6) AS cosine
  FROM line_weight a JOIN weight b USING (term) JOIN norm USING (line) GROUP BY line, t
), best AS (
  SELECT line, name, cosine FROM cosine JOIN template USING (t)
  QUALIFY row_number() OVER (PARTITION BY line ORDER BY cosine DESC, name) = 1
), found AS (
  SELECT doc_id, name, cosine, len(regexp_extract_all(lower(line), '{TERM}')) AS words FROM line JOIN best USING (line) WHERE cosine >= {LEAST_COSINE}
), own AS (
  SELECT doc_id, first(name ORDER BY cosine DESC, name) AS license, max(cosine) AS cosine, sum(words) AS words FROM found GROUP BY doc_id
), judged AS (
  SELECT doc_id, path, license, coalesce(cosine, 0.0) AS cosine, regexp_replace(path, '/[^/]*$', '') AS dir,
    license IS NOT NULL AND words / len(regexp_extract_all(lower(text), '{TERM}')) >= {LEAST_SHARE} AS is_file
  FROM file LEFT JOIN own USING (doc_id)
), licensed AS (
  SELECT dir AS license_dir, first(license ORDER BY cosine DESC, path) AS inherited FROM judged WHERE is_file GROUP BY dir
), folder AS (SELECT DISTINCT dir, string_split(dir, '/') AS parts FROM judged
), above AS (
  SELECT dir, array_to_string(parts[1:n], '/') AS license_dir FROM (SELECT dir, parts, unnest(range(0, len(parts) + 1)) AS n FROM folder)
), nearest AS (
  SELECT dir, license_dir, inherited FROM above JOIN licensed USING (license_dir)
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(license_dir) DESC) = 1
)
SELECT doc_id, path, coalesce(license, inherited) AS license, cosine,
  CASE WHEN license IS NOT NULL AND is_file THEN 'file' WHEN license IS NOT NULL THEN 'header' WHEN inherited IS NOT NULL THEN 'inherited' ELSE 'none' END AS evidence,
  CASE WHEN license IS NULL THEN license_dir END AS license_dir
FROM judged LEFT JOIN nearest USING (dir)
"""


FILTER_AUDIT = r"""
WITH doc AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents
), failing AS (
  SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails FROM doc
), judged AS (
  SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failing LEFT JOIN judged USING (doc_id) GROUP BY part, fails
), letter AS (SELECT unnest([1, 2, 3, 4, 5]) AS l
), orders AS (
  SELECT [a.l, b.l, c.l, d.l, e.l] AS filters FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT array_to_string(list_transform(filters, lambda f: 'ABCDE'[f]), '') AS filter_order, step, filters[step] AS own, filters[:step - 1] AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), met AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS f, len(list_filter(earlier, lambda e: fails[e])) > 0 AS gone,
    len(list_filter(fails, lambda x: x)) AS n_fails
  FROM counted, steps
), summed AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT f AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (f AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (f AND gone), 0) AS redundant, coalesce(sum(n) FILTER (f AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (f AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (f AND NOT gone), 0) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""


def centroids(rounds: int = 5) -> str:
    """The rounds one after the other, each over all pairs of a vector and a centroid."""

    def pairs(r: int) -> str:
        distance = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"""a{r} AS MATERIALIZED (
  SELECT rn, min({{'distance': CAST({distance} AS BIGINT), 'cluster': c.cluster}}) AS best FROM kept k, c{r} c GROUP BY rn
)"""

    def moved(r: int) -> str:
        return f"""m{r} AS (
  SELECT cluster, i, (s - ((s % n) + n) % n) // n AS x FROM (
    SELECT best.cluster AS cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r} JOIN kept USING (rn), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL
  )
), c{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(new.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT cluster, list(CAST(x AS BIGINT) ORDER BY i) AS v FROM m{r} GROUP BY cluster) new USING (cluster)
)"""

    steps = ",\n".join(f"{pairs(r)}, {moved(r)}" for r in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (
    SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT 40
  )
), {steps}, {pairs(rounds)}, found AS (
  SELECT vec_id, best.cluster AS cluster, best.distance AS distance FROM a{rounds} JOIN kept USING (rn)
)
SELECT vec_id, CAST(found.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY found.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM found JOIN c{rounds} c ON c.cluster = found.cluster
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat": CHAT,
        "op8_licenses": licenses(),
        "op10_decontamination": DECONTAMINATION,
        "op11_centroids": centroids(),
        "op12_filter_audit": FILTER_AUDIT,
    }
