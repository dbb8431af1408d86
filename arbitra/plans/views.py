"""SQL of the derived views, for oracles. Each entry is a list of common table expressions."""

H = "('0x' || substr(sha256({0}), 1, 8))::BIGINT"


def keyed(key: str, salt: str, most: int) -> str:
    text = f"{key}::VARCHAR || ':{salt}'"
    return f"({H.format(text)} % {most})"


DRAFTS = f"""drafts AS (SELECT doc_id, provider, h, h / 10000.0::DOUBLE AS p, h >= 5000 AS value, h / 10.0::DOUBLE AS latency_ms, h % 17 <> 0 AS schema_valid, h % 23 = 0 AS abstained,
 h % 19 = 0 AS repaired, h % 512 AS tokens FROM (SELECT doc_id, provider, {H.format("doc_id::VARCHAR || ':' || provider")} % 10001 AS h FROM documents, (VALUES ('a'), ('b')) v(provider)))"""
BINARY = DRAFTS + """, pred AS (SELECT provider, d.doc_id, quality = 1 AS label, p, greatest(p, 1 - p) AS confidence, (h >= 5000) = (quality = 1) AS correct FROM drafts d JOIN labels l ON l.doc_id = d.doc_id)"""
CHOICE = f"""w AS (SELECT event_id, event_type AS label, class, 1 + {H.format("event_id::VARCHAR || ':' || class")} % 1000 AS w FROM events, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) v(class)),
 lng AS (SELECT event_id, label, class, w::DOUBLE / sum(w) OVER (PARTITION BY event_id) AS p, w FROM w),
 o AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY w DESC, class) AS k FROM lng),
 rws AS (SELECT event_id, label, max(CASE WHEN k = 1 THEN class END) AS selected, max(CASE WHEN k = 2 THEN class END) AS second, max(CASE WHEN class = label THEN p END) AS p_label,
  sum(power(p - CASE WHEN class = label THEN 1 ELSE 0 END, 2)) AS squares, max(p) AS confidence FROM o GROUP BY 1, 2)"""
SCORE = """sc AS (SELECT l_orderkey, l_linenumber, l_returnflag AS grp, round(l_discount * 10, 4) AS target, round(l_tax * 10, 4) AS value,
 greatest(0.0, round(round(l_tax * 10, 4) - 0.1, 4)) AS lower, least(1.0, round(round(l_tax * 10, 4) + 0.1, 4)) AS upper FROM lineitem)"""
REVIEWS = f"""rv AS (SELECT doc_id, quality, CASE WHEN ha < 5 THEN NULL WHEN ha < 15 THEN 1 - quality ELSE quality END AS a, CASE WHEN hb < 5 THEN NULL WHEN hb < 15 THEN 1 - quality ELSE quality END AS b
 FROM (SELECT doc_id, quality, {keyed('doc_id', 'reviewer_a', 100)} AS ha, {keyed('doc_id', 'reviewer_b', 100)} AS hb FROM labels))"""
FEEDBACK = f"""fb AS (SELECT event_id AS seq, user_id AS sample_id, {keyed('event_id', 'correction', 2)} = 1 AS correction, event_type AS reviewer FROM events)"""
TRAFFIC = f"""tr AS (SELECT event_id AS request_id, ts, CASE event_type WHEN 'view' THEN 'rule' WHEN 'click' THEN 'qwen' WHEN 'purchase' THEN 'gemma' ELSE 'human' END AS route, event_type = 'error' AS abstained,
 {keyed('event_id', 'confidence', 1001)} / 1000.0::DOUBLE AS confidence FROM events)"""
OBSERVATIONS = f"""ob AS (SELECT event_id AS observation_id, epoch_us(ts) / 1000.0::DOUBLE AS timestamp_ms, epoch_us(ts) / 1000.0::DOUBLE + {keyed('event_id', 'clock', 205)} - 5 AS now_ms, event_type = 'error' AS emergency_stop,
 {keyed('event_id', 'abstain', 10)} = 0 AS abstained, {keyed('event_id', 'confidence', 1001)} / 1000.0::DOUBLE AS confidence, {keyed('event_id', 'ttl', 120)} AS ttl_ms FROM events)"""
