"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_MARKS = r"'^[ \t]*((?:>[ \t]?)+)'"
_QUOTES = r"regexp_matches(text, '(^|\n)[ \t]*>')"
_NORMAL = r"lower(trim(regexp_replace({0}, '[ \t\r\n\f\v]+', ' ', 'g')))"


def _units(text: str) -> str:
    """The normalised text, marked if it is short, and the lines that are long enough."""
    lines = f"list_filter(list_transform(string_split({text}, chr(10)), lambda l: {_NORMAL.format('l')}), lambda u: length(u) >= 8)"
    whole = _NORMAL.format(text)
    return f"unnest(list_distinct(list_concat(CASE WHEN length({whole}) >= 8 THEN [{whole}] WHEN length({whole}) > 0 THEN [chr(1) || {whole}] ELSE [] END, {lines})))"


def _quoted(messages: str) -> str:
    """SQL over a table of conversations."""
    return OP7.replace("FROM conversations)", f"FROM {messages})", 1)


OP7 = f"""WITH RECURSIVE m AS (SELECT conv_id, turn, role, text FROM conversations),
 q AS (SELECT DISTINCT conv_id, turn, text FROM m WHERE {_QUOTES}),
 l AS (SELECT conv_id, turn, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM q),
 d AS (SELECT conv_id, turn, text, pos, length(regexp_replace(regexp_extract(line, {_MARKS}, 1), '[ \\t]', '', 'g')) AS depth, regexp_replace(line, {_MARKS}, '') AS line FROM l),
 g AS (SELECT *, CASE WHEN depth = lag(depth) OVER (PARTITION BY conv_id, turn, text ORDER BY pos) THEN 0 ELSE 1 END AS new FROM d),
 r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn, text ORDER BY pos) AS run FROM g),
 p AS (SELECT conv_id, turn, text, depth, min(pos) AS start, string_agg(line, chr(10) ORDER BY pos) AS passage FROM r GROUP BY conv_id, turn, text, run, depth),
 own AS (SELECT conv_id, turn, text, trim(string_agg(passage, chr(10) ORDER BY start)) AS own FROM p WHERE depth = 0 GROUP BY 1, 2, 3),
 cnt AS (SELECT conv_id, turn, text, count(*) FILTER (depth > 0) AS n_quoted, max(depth) AS depth FROM p GROUP BY 1, 2, 3),
 qu AS (SELECT conv_id, turn, text, start, depth, {_units('passage')} AS unit FROM p WHERE depth > 0),
 said AS (SELECT conv_id, turn, {_units('text')} AS unit FROM m WHERE text IS NOT NULL AND NOT {_QUOTES} UNION ALL SELECT conv_id, turn, {_units('own')} FROM own),
 here AS (SELECT unit, conv_id, min(turn) AS pt FROM said GROUP BY 1, 2),
 fst AS (SELECT unit, conv_id AS c, pt AS t FROM here QUALIFY row_number() OVER (PARTITION BY unit ORDER BY conv_id, pt) = 1),
 f AS (SELECT qu.*, CASE WHEN h.pt < qu.turn THEN h.pt END AS pt, CASE WHEN fst.c <> qu.conv_id AND NOT starts_with(qu.unit, chr(1)) THEN fst.c END AS c, CASE WHEN fst.c <> qu.conv_id AND NOT starts_with(qu.unit, chr(1)) THEN fst.t END AS t
  FROM qu LEFT JOIN here h ON h.unit = qu.unit AND h.conv_id = qu.conv_id LEFT JOIN fst ON fst.unit = qu.unit),
 lnk AS (SELECT conv_id, turn, text, (min((depth, -length(unit), pt)) FILTER (pt IS NOT NULL))[3] AS reply_to, (min((depth, -length(unit), c, t)) FILTER (c IS NOT NULL))[3] AS c, (min((depth, -length(unit), c, t)) FILTER (c IS NOT NULL))[4] AS t,
  count(DISTINCT start) FILTER (pt IS NOT NULL OR c IS NOT NULL) AS n_linked FROM f GROUP BY 1, 2, 3),
 up AS (SELECT conv_id, turn, min(reply_to) AS above FROM lnk WHERE reply_to IS NOT NULL GROUP BY 1, 2),
 walk AS (SELECT conv_id, turn, above FROM up UNION ALL SELECT w.conv_id, w.turn, u.above FROM walk w JOIN up u ON u.conv_id = w.conv_id AND u.turn = w.above),
 root AS (SELECT conv_id, turn, min(above) AS thread FROM walk GROUP BY 1, 2)
 SELECT m.conv_id, m.turn, m.role, CASE WHEN cnt.n_quoted > 0 THEN coalesce(own.own, '') ELSE m.text END AS body, coalesce(root.thread, m.turn) AS thread, lnk.reply_to, CASE WHEN lnk.reply_to IS NULL THEN lnk.c END AS source_conv,
 CASE WHEN lnk.reply_to IS NULL THEN lnk.t END AS source_turn, coalesce(cnt.n_quoted, 0)::BIGINT AS n_quoted, coalesce(lnk.n_linked, 0)::BIGINT AS n_linked, coalesce(cnt.depth, 0)::BIGINT AS depth
 FROM m LEFT JOIN cnt ON cnt.conv_id = m.conv_id AND cnt.turn = m.turn AND cnt.text = m.text LEFT JOIN own ON own.conv_id = m.conv_id AND own.turn = m.turn AND own.text = m.text
 LEFT JOIN lnk ON lnk.conv_id = m.conv_id AND lnk.turn = m.turn AND lnk.text = m.text LEFT JOIN root ON root.conv_id = m.conv_id AND root.turn = m.turn"""

#: The given conversations, every third message quoting the one before, every sixth that and the one before it, on two levels.
QUOTED = """(SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 AND turn % 6 = 5 AND b IS NOT NULL AND c IS NOT NULL THEN '>> ' || replace(c, chr(10), chr(10) || '>> ') || chr(10) || '> ' || replace(b, chr(10), chr(10) || '> ') || chr(10) || text
 WHEN turn % 3 = 2 AND b IS NOT NULL THEN '> ' || replace(b, chr(10), chr(10) || '> ') || chr(10) || text ELSE text END AS text
 FROM (SELECT *, lag(text) OVER w AS b, lag(text, 2) OVER w AS c FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)))"""



def _clusters(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """All vectors in integers, k of them to begin with, and each round from the one before."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR)) - 1)::INTEGER AS c, v AS m FROM v QUALIFY c < {k})""",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (SELECT r, (min(p)).d AS d, (min(p)).c AS c FROM (SELECT r, {{'d': d, 'c': c}} AS p FROM
  (SELECT r, c, list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{n})) GROUP BY r)"""
        )
        if n < rounds:
            steps += [
                f"""m{n} AS MATERIALIZED (SELECT c, list(x ORDER BY i) AS m FROM (SELECT c, i, CASE WHEN sum(x) % count(*) < 0 THEN sum(x) // count(*) - 1 ELSE sum(x) // count(*) END::BIGINT AS x
  FROM (SELECT a.c, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS i FROM a{n} a JOIN v ON v.r = a.r) GROUP BY c, i) GROUP BY c)""",
                f"c{n + 1} AS MATERIALIZED (SELECT c0.c, coalesce(n.m, c0.m) AS m FROM c{n} c0 LEFT JOIN m{n} n ON n.c = c0.c)",
            ]
    return "WITH " + ",\n ".join(steps) + f"""
 SELECT v.vec_id, a.c AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.m, ',')) AS centroid_sha256
 FROM v JOIN a{rounds} a ON a.r = v.r JOIN c{rounds} c ON c.c = a.c"""


SQL = {"op12_centroid_clusters": _clusters(), "op7_chat_formatting": OP7, "op7_quoted_conversations": _quoted(QUOTED)}
