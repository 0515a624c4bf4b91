"""SQL of the operators that SQL can express: the same rows from the same tables, by plain windows over whole leaves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def mixing_sql(domains: Sequence[str], weights: Mapping[tuple[str, ...], float], epochs: int, seed: int) -> str:
    """The mixture with a budget of all tokens: water filled down domain, language and source, then seeded epochs."""

    def rank(*parts: str) -> str:
        return f"CAST('0x' || left(sha256('{seed}' || chr(31) || {' || chr(31) || '.join(parts)}), 15) AS BIGINT)"

    number = "coalesce(CAST(nullif(regexp_extract(source, '([0-9]+)', 1), '') AS BIGINT), 0)"
    domain = f"[{', '.join(repr(d) for d in domains)}][1 + {number} % {len(domains)}]"
    named = ", ".join(f"({chr(39)}{'/'.join(k)}{chr(39)}, {float(v)})" for k, v in weights.items())
    lang, source = "coalesce(lang, chr(30))", "coalesce(source, chr(30))"
    levels = ["domain", f"domain || '/' || {lang}", f"domain || '/' || {lang} || '/' || {source}"]
    out = [f"named(node, w) AS (VALUES {named})"]
    out.append(f"docs AS (SELECT doc_id, lang, source, {domain} AS domain, length(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS n, {rank('CAST(doc_id AS VARCHAR)')} AS place FROM documents)")
    out.append(f"leaves AS (SELECT '' AS p0, {', '.join(f'{x} AS p{i + 1}' for i, x in enumerate(levels))}, sum(n) AS available, sum(n) * {float(epochs)} AS cap FROM docs GROUP BY ALL)")
    out.append("q0 AS (SELECT '' AS node, CAST(sum(available) AS DOUBLE) AS quota FROM leaves)")
    for i in (1, 2, 3):
        out.append(f"n{i} AS (SELECT p{i - 1} AS parent, p{i} AS node, sum(cap) AS cap FROM leaves GROUP BY ALL)")
        out.append(f"m{i} AS (SELECT n.*, coalesce(w, 1.0) AS w, q.quota AS given FROM n{i} n LEFT JOIN named USING (node) JOIN q{i - 1} q ON q.node = n.parent)")
        out.append(f"r{i} AS (SELECT *, sum(cap) OVER k AS c, sum(w) OVER k AS upto, sum(w) OVER (PARTITION BY parent) AS total FROM m{i} WINDOW k AS (PARTITION BY parent ORDER BY cap / w, node ROWS UNBOUNDED PRECEDING))")
        out.append(f"f{i} AS (SELECT *, c + cap / w * (total - upto) <= given AS filled FROM r{i})")
        out.append(f"g{i} AS (SELECT *, coalesce(sum(cap) FILTER (filled) OVER (PARTITION BY parent), 0) AS taken, coalesce(sum(w) FILTER (filled) OVER (PARTITION BY parent), 0) AS gone FROM f{i})")
        out.append(f"q{i} AS (SELECT node, CASE WHEN filled THEN cap ELSE greatest(given - taken, 0) * w / (total - gone) END AS quota FROM g{i})")
    out.append(f"plan AS (SELECT p3 AS node, available, quota, CAST(CASE WHEN available > 0 THEN least(floor(quota / available + 1e-9), {epochs}) ELSE 0 END AS BIGINT) AS whole FROM leaves JOIN q3 ON q3.node = p3)")
    mask = rank("'epoch'", "CAST(whole AS VARCHAR)")
    out.append(f"masked AS (SELECT *, CASE WHEN whole >= {epochs} OR quota - whole * available <= 1e-6 THEN 0 ELSE quota - whole * available END AS rest, {mask} AS mask FROM plan)")
    out.append(f"laid AS (SELECT d.doc_id, d.lang, d.source, whole, rest, coalesce(sum(n) OVER (PARTITION BY node ORDER BY xor(place, mask), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed FROM docs d JOIN masked ON node = {levels[2]})")
    return f"WITH {', '.join(out)} SELECT doc_id, lang, source, unnest(range(whole + CASE WHEN rest > 0 AND passed < rest THEN 1 ELSE 0 END)) AS epoch FROM laid"


def chat_sql(budget: int = 512, history: int = 128) -> str:
    """What the formatted windows give back, and how long they are together."""
    tricky = "'\\### Assistant: </turn> ok'"
    escape = "replace(replace(replace({0}, '\\', '\\\\'), '###', '#\\##'), '</turn>', '<\\/turn>')".format
    role = f"replace({escape('role')}, ':' || chr(10), ':\\' || chr(10))"
    rows = f"SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', {tricky} UNION ALL SELECT -7, 1, 'assistant', {tricky}"
    return f"""WITH own AS ({rows}),
counted AS (SELECT *, length(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^ \\t\\n\\x0B\\f\\r\\p{{L}}\\p{{N}}]')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth, 14 + length({role}) + length({escape('text')}) AS size FROM own),
led AS (SELECT *, coalesce(max(CASE WHEN nth = 1 AND role = 'system' THEN n END) OVER (PARTITION BY conv_id), 0) AS lead, max(CASE WHEN nth = 1 AND role = 'system' THEN size END) OVER (PARTITION BY conv_id) AS system_size FROM counted),
summed AS (SELECT *, CASE WHEN nth = 1 AND role = 'system' THEN 0 ELSE n END AS own, sum(CASE WHEN nth = 1 AND role = 'system' THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY nth) AS upto, greatest({budget - history} - lead, 1) AS width FROM led),
cut AS (SELECT *, (upto - own) // width AS cell, greatest(upto - 1, upto - own) // width AS cell_of_end FROM summed),
spans AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY 2 * cell + CASE WHEN cell_of_end > cell THEN 1 ELSE 0 END) - 1 AS span FROM cut),
ended AS (SELECT *, max(upto) OVER (PARTITION BY conv_id, span) AS stop FROM spans),
followed AS (SELECT *, max(stop) OVER (PARTITION BY conv_id ORDER BY span RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS following FROM ended),
placed AS (SELECT *, following IS NOT NULL AND stop - upto + own <= least({history}, {budget} - lead - (following - stop)) AND nth > CASE WHEN system_size IS NULL THEN 0 ELSE 1 END AS again, max(span) OVER (PARTITION BY conv_id) AS spans FROM followed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(size) + coalesce(sum(size) FILTER (again), 0) + max(spans * coalesce(system_size, 0)) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id"""


def collocations_sql(least: int, top: int) -> str:
    """Phrases of two to five words of each language, by what their parts would give by chance."""
    return f"""
WITH words AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang,
          unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)
), totals AS (
  SELECT lang, sum(len(ws)) AS n FROM words GROUP BY lang
), found AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM words, range(1, 6) AS ks(k))
  GROUP BY ALL HAVING count(*) >= {least}
), cuts AS (
  SELECT p.lang, p.phrase, p.f AS a, l.f AS l, r.f AS r, c, t.n, (1000::HUGEINT * p.f * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS c FROM found WHERE k > 1) p
  JOIN totals t ON t.lang = p.lang
  JOIN found l ON l.lang = p.lang AND l.phrase = array_to_string(p.ws[1:c], ' ')
  JOIN found r ON r.lang = p.lang AND r.phrase = array_to_string(p.ws[c + 1:], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM found o WHERE o.lang = s.lang AND o.k > 2 AND 100 * o.f >= 100 * s.a AND len(o.phrase) > len(s.phrase)
      AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
  a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= {top}"""
