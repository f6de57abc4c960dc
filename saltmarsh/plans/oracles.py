r"""DuckDB SQL of the registered queries, written independently of the Spark plans."""

from __future__ import annotations

from saltmarsh import lexicons
from saltmarsh.functions import wording
from saltmarsh.lexicons import CONFUSABLES, HOSTILITY_MILD, HOSTILITY_SEV1, HOSTILITY_SEV2, INTENT_CHANNEL, LEET, MESSENGER_DOMAINS, PAYMENT_DOMAINS, RISKY_TLDS, SHORTENERS
from saltmarsh.plans import cascade_sql as judged

ZEROS = [0x0660, 0x06F0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0E50, 0x0ED0, 0x0F20, 0x1040, 0xFF10]
DIGITS = "".join(chr(z + k) for z in ZEROS for k in range(10))
ONE = {k: v for k, v in CONFUSABLES.items() if len(v) == 1}
TWO = {k: v for k, v in CONFUSABLES.items() if len(v) == 2}
COUNTED = DIGITS + "".join(k for k, v in CONFUSABLES.items() if k.strip() and v not in "-._ " and k != v)
LEETABLE = "".join(LEET)


def listed(terms) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in terms)


def classes(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


SYNTH = """
synth AS (
  SELECT o_orderkey AS message_id, o_custkey AS conversation_id, CASE WHEN (o_orderkey // 8) % 2 = 0 THEN 'guest' ELSE 'host' END AS sender_role,
    CASE WHEN (o_orderkey // 8) % 5 = 0 THEN 'post_booking' ELSE 'pre_booking' END AS booking_stage, o_orderkey % 8 AS k,
    (6000000000 + (o_orderkey * 7919) % 3999999999)::VARCHAR AS mobile,
    CASE o_orderkey % 8 WHEN 0 THEN 'call me on ' || mobile WHEN 1 THEN 'the price is ' || (o_orderkey % 9000 + 1000) || ' per night for 2 guests'
      WHEN 2 THEN 'pay me on user' || o_orderkey || '@okaxis' WHEN 3 THEN 'thanks see you soon' WHEN 4 THEN 'write to guest' || o_orderkey || '@gmail.com'
      WHEN 5 THEN 'see wa.me/91' || mobile WHEN 6 THEN 'you stupid clown' ELSE 'house no 4 near the temple' END AS text
  FROM orders)
"""

SINGLE = [t for t in dict.fromkeys([*INTENT_CHANNEL, *HOSTILITY_MILD, *HOSTILITY_SEV1, *HOSTILITY_SEV2]) if t.isalpha()]
INSULTS = [t for t in dict.fromkeys([*HOSTILITY_SEV1, *HOSTILITY_SEV2]) if t.isalpha()]
SPLIT = r"[^\p{L}\p{N}]+"
FOLDED = f"translate(text, '{DIGITS}{''.join(ONE)}', '{'0123456789' * len(ZEROS)}{''.join(ONE.values())}')"
for _k, _v in TWO.items():
    FOLDED = f"replace({FOLDED}, '{_k}', '{_v}')"
LEET_OK = f"(len(regexp_extract_all(t, '\\p{{L}}')) > 0 AND len(regexp_extract_all(t, '\\p{{L}}')) >= len(regexp_extract_all(t, '{classes(LEETABLE)}')))"
RULE = f"""
judged AS (
  SELECT d.doc_id, lang, toxic = 1 AS expected, len(list_intersect(string_split_regex(lower(text), '{SPLIT}'), [{listed(INSULTS)}])) > 0 AS hit
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
TOKENS = r"""
cleaned AS (
  SELECT unnest(string_split(trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')), ' ')) AS token FROM documents),
counted AS (
  SELECT trigram, count(*) AS n FROM (
    SELECT unnest(list_transform(range(1, len(token) + 1), lambda i: substring(' ' || token || ' ', i, 3))) AS trigram FROM cleaned WHERE token <> '') GROUP BY trigram),
totals AS (SELECT sum(n)::BIGINT + 37 * 37 * 37 AS space FROM counted),
model AS (SELECT trigram, n, ln((n + 1) / space::DOUBLE) AS logp, ln(1.0 / space) AS unseen FROM counted, totals)"""


def scores(tokens: str) -> str:
    return f"""
  SELECT token, -avg(coalesce(logp, (SELECT max(unseen) FROM model))) AS score FROM (
    SELECT token, unnest(list_transform(range(1, len(token) + 1), lambda i: substring(' ' || token || ' ', i, 3))) AS trigram FROM (SELECT DISTINCT token FROM {tokens}))
  LEFT JOIN model USING (trigram) GROUP BY token"""


ORACLES = {
    "moderate_report": judged.cascade(judged.source_synth()) + " SELECT booking_stage, sender_role, band, verdict, resolved_by, count(*) AS n, sum(round(score, 6)::DECIMAL(18, 6))::DOUBLE AS score FROM scored GROUP BY ALL",
    "moderate_messages": judged.cascade(judged.source_synth()) + " SELECT message_id, round(score, 6) AS score, band, verdict, n_detections, round(confidence, 6) AS confidence FROM scored",
    "policy_actions": judged.cascade(judged.source_synth()) + judged.FAMILIES + "," + judged.masked() + f""", acted AS (SELECT s.message_id, s.text, masked, {judged.FAMILY} AS family,
        CASE WHEN verdict = 'allow' THEN 'deliver' WHEN verdict = 'block' AND family = 'contact' AND masked IS NOT NULL THEN 'mask' ELSE verdict END AS action FROM scored s LEFT JOIN hidden USING (message_id) LEFT JOIN kinds USING (message_id))
      SELECT message_id, action, CASE action WHEN 'deliver' THEN text WHEN 'mask' THEN masked END AS delivered_text, false AS cooldown FROM acted""",
    "io11_wording": judged.cascade(judged.source_techniques()) + judged.FAMILIES + f""" SELECT label, tone, summary, count(*) AS n FROM (
      SELECT CASE verdict WHEN 'allow' THEN 'Delivered' WHEN 'block' THEN 'Held back' ELSE 'Being checked' END AS label, CASE verdict WHEN 'allow' THEN 'good' WHEN 'block' THEN 'stop' ELSE 'caution' END AS tone,
        CASE WHEN verdict = 'allow' THEN 'Nothing found.' WHEN categories IS NULL THEN 'The score alone is high.' ELSE
          CASE {" ".join(f"WHEN starts_with(string_split(categories, ',')[1], {judged.lit(k)}) THEN {judged.lit(v)}" for k, v in wording.SENTENCES.items())} ELSE string_split(categories, ',')[1] END
          || CASE WHEN len(string_split(categories, ',')) > 1 THEN ', and ' || (len(string_split(categories, ',')) - 1) || ' more.' ELSE '.' END END AS summary FROM scored LEFT JOIN kinds USING (message_id)) GROUP BY ALL""",
    "moderate_conversations": "WITH rows AS (SELECT row_number() OVER () AS message_id, conv_id AS conversation_id, CASE role WHEN 'user' THEN 'guest' ELSE 'host' END AS sender_role, 'pre_booking' AS booking_stage, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant'))"
      + f",{judged.views()},{judged.runs()},{judged.found()},{judged.best()},{judged.scored()} SELECT sender_role, verdict, resolved_by, count(*) AS n FROM scored GROUP BY ALL",
    "e6_replayed": "SELECT length, count(*) AS conversations FROM (SELECT unnest(CASE WHEN n % 12 > 0 THEN list_append(list_transform(range(0, n // 12), lambda i: 12), n % 12) ELSE list_transform(range(0, n // 12), lambda i: 12) END)::BIGINT AS length FROM (SELECT count(*) AS n FROM orders)) GROUP BY length",
    "d29_terms": "WITH views AS (SELECT row_number() OVER () AS message_id, conv_id, turn, lower(text) AS deleet FROM conversations WHERE text IS NOT NULL), words AS (SELECT message_id, deleet FROM views), "
      + judged.terms("any_term", {"a": [*lexicons.INTENT_CHANNEL, *lexicons.INTENT_ACTION, *lexicons.INTENT_OFFPLATFORM, *lexicons.INTENT_PAYMENT, *lexicons.HOSTILITY_MILD, *lexicons.HOSTILITY_SEV1, *lexicons.HOSTILITY_SEV2, *lexicons.HOSTILITY_SEV3, *lexicons.EXTORTION_DEMAND,
          *lexicons.EXTORTION_CONDITIONAL, *lexicons.EXTORTION_LEVERAGE, *lexicons.SCAM_URGENCY, *lexicons.SCAM_PAYMENT, *lexicons.SCAM_TOO_GOOD, "the", "for the", "you", "a", "of the"]}).strip()
      + " SELECT conv_id, turn, m AS term, s AS start FROM any_term JOIN views USING (message_id)",
    "io2_validation": """SELECT reason, count(*) AS n FROM (
      SELECT CASE WHEN conv_id % 7 = 0 THEN 'message_id is required' WHEN text IS NULL THEN 'text is required' WHEN length(text) > 8000 THEN 'text exceeds 8000 characters'
        WHEN role IS DISTINCT FROM 'user' THEN 'sender_role is unknown' WHEN turn % 5 = 4 THEN 'booking_stage is unknown' ELSE 'valid' END AS reason FROM conversations) GROUP BY reason""",
    "synth_messages": f"WITH {SYNTH} SELECT message_id, conversation_id, sender_role, booking_stage, text FROM synth",
    "n3_n6_folded": f"""SELECT doc_id, length(f) AS n, md5(f) AS digest, c AS confusables FROM (
      SELECT doc_id, lower({FOLDED}) AS f, len(regexp_extract_all(text, '{classes(COUNTED)}'))::BIGINT AS c FROM documents)""",
    "n2_invisible": """SELECT doc_id, text AS visible, CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 0 END::BIGINT AS n FROM documents""",
    "n7_n8_deleet": f"""SELECT conv_id, turn,
        coalesce(array_to_string(list_transform(regexp_extract_all(lower(text), '\\S+|\\s+'), lambda t: CASE WHEN {LEET_OK} THEN translate(t, '{LEETABLE}', '{"".join(LEET.values())}') ELSE t END), ''), '') AS deleet,
        coalesce(list_sum(list_transform(regexp_extract_all(lower(text), '\\S+'), lambda t: CASE WHEN {LEET_OK} THEN len(regexp_extract_all(t, '{classes(LEETABLE)}')) ELSE 0 END)), 0)::BIGINT AS leet
      FROM conversations""",
    "n9_n10_denoised": """SELECT o_orderkey, d AS denoised, (length(t) - length(d))::BIGINT AS noise FROM (
      SELECT o_orderkey, t, CASE WHEN o_custkey < 1000 THEN 'abcd ' ELSE 'ab' || o_custkey || 'cd ' END || o_orderkey || 'xyz' AS d FROM (
        SELECT o_orderkey, o_custkey, 'ab' || o_custkey || 'cd ' || o_orderkey || 'x7y8z' AS t FROM orders))""",
    "n12_n18_digit_runs": """SELECT o_orderkey, 1::BIGINT AS n, digits, 4::BIGINT AS start, (4 + length(a || ' ' || w || ' double ' || b))::BIGINT AS "end", 1::BIGINT AS word_n, 2::BIGINT AS num_n,
      true AS mixed, 'ref ' || digits || ' ok' AS digitized FROM (
        SELECT o_orderkey, (o_orderkey % 100)::VARCHAR AS a, (['zero', 'three', 'five', 'six', 'seven', 'nine'])[o_orderkey % 6 + 1] AS w, (o_custkey % 10)::VARCHAR AS b,
          a || (['0', '3', '5', '6', '7', '9'])[o_orderkey % 6 + 1] || b || b AS digits FROM orders)""",
    "w7_w8_trigrams": f"WITH {TOKENS} SELECT trigram, n, round(logp, 6) AS logp FROM model",
    "w1_w5_weird_tokens": rf"""WITH {TOKENS},
      long AS (SELECT token, count(*) AS times FROM (SELECT unnest(string_split_regex(token, '{SPLIT}')) AS token FROM cleaned) WHERE length(token) >= 4 AND regexp_matches(token, '\p{{L}}') GROUP BY token),
      trained AS ({scores("long")}),
      edge AS (SELECT round(quantile_cont(score, 0.995), 3) AS threshold FROM trained JOIN long USING (token), range(times)),
      turns AS (SELECT DISTINCT ON (id) id, folded FROM (SELECT conv_id || '-' || turn || CASE WHEN row_number() OVER w > 1 THEN '#' || row_number() OVER w ELSE '' END AS id, lower(coalesce(text, '')) AS folded FROM conversations WINDOW w AS (PARTITION BY conv_id, turn ORDER BY lower(coalesce(text, ''))))),
      found AS (SELECT id, token, regexp_replace(token, '[^\p{{L}}]', '', 'g') AS letters FROM (SELECT id, unnest(string_split_regex(folded, '{SPLIT}')) AS token FROM turns)
        WHERE length(token) >= 4 AND regexp_matches(token, '\p{{L}}')),
      every AS (SELECT token FROM found UNION ALL SELECT letters FROM found WHERE length(letters) >= 4),
      own AS ({scores("every")}),
      marks AS (SELECT f.id, a.score, CASE WHEN regexp_matches(f.token, '\p{{L}}[0-9]+\p{{L}}') OR NOT regexp_matches(f.token, '[0-9]') THEN a.score
          WHEN length(f.letters) >= 4 AND f.letters <> f.token THEN b.score END > threshold AS weird
        FROM found f JOIN own a ON a.token = f.token LEFT JOIN own b ON b.token = f.letters, edge)
      SELECT t.id, coalesce(round(max(score), 6), 0) AS weird_score, count(*) FILTER (weird) AS weird_tokens FROM turns t LEFT JOIN marks m ON m.id = t.id GROUP BY t.id""",
    "d8_emails": r"""SELECT * FROM (SELECT doc_id, len(h)::BIGINT AS n, array_to_string(h, ',') AS found FROM (
      SELECT doc_id, regexp_extract_all(lower(text), '\b[a-z0-9._%+-]{1,64}@[a-z0-9.-]{1,255}\.[a-z]{2,24}\b') AS h FROM documents)) WHERE n > 0""",
    "d10_url_classes": f"""SELECT kind, count(*) AS n, max(sure)::DOUBLE AS confidence FROM (
      SELECT CASE WHEN m THEN 'contact.url.messenger' WHEN s THEN 'contact.url.shortener' WHEN p THEN 'contact.url.payment' WHEN r THEN 'contact.url.risky_tld' ELSE 'contact.url' END AS kind,
             CASE WHEN m THEN 0.97 WHEN s THEN 0.8 WHEN p THEN 0.9 WHEN r THEN 0.7 ELSE 0.6 END AS sure FROM (
        SELECT list_bool_or(list_transform([{listed(MESSENGER_DOMAINS)}], lambda d: host = d OR ends_with(host, '.' || d))) AS m,
               list_bool_or(list_transform([{listed(SHORTENERS)}], lambda d: host = d OR ends_with(host, '.' || d))) AS s,
               list_bool_or(list_transform([{listed(PAYMENT_DOMAINS)}], lambda d: host = d OR ends_with(host, '.' || d))) AS p,
               string_split(host, '.')[-1] IN ({listed(RISKY_TLDS)}) AS r
        FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages))) GROUP BY kind""",
    "d22_d25_lexicon": f"SELECT term, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '{SPLIT}')) AS term FROM documents) WHERE term IN ({listed(SINGLE)}) GROUP BY term",
    "d30_keep_longest": """WITH e AS (SELECT user_id, event_id, event_id % 97 AS a, event_id % 97 + event_id % 11 + 1 AS b FROM events)
      SELECT user_id, event_id, a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.user_id = e.user_id AND o.event_id <> e.event_id AND o.a <= e.a AND o.b >= e.b
        AND (o.a < e.a OR o.b > e.b OR o.event_id < e.event_id))""",
    "r11_saturation": """SELECT 'allow' AS band, floor(0.35 * 6 * (1 - exp(-l_quantity / 12)))::BIGINT AS whole, count(*) AS n,
      round(sum(0.35 * 6 * (1 - exp(-l_quantity / 12))), 4) AS value FROM lineitem GROUP BY 1, 2""",
    "s1_s2_pressure": """SELECT e.event_id, round(coalesce(sum(abs(o.value) * power(2, -((epoch_us(e.ts) // 1000) - (epoch_us(o.ts) // 1000)) / 3600000::DOUBLE)), 0), 6) AS pressure
      FROM events e LEFT JOIN events o ON o.user_id = e.user_id AND ((epoch_us(o.ts) // 1000), o.event_id) < ((epoch_us(e.ts) // 1000), e.event_id) GROUP BY e.event_id""",
    "s4_s5_last_messages": """WITH m AS (SELECT conv_id || '-' || turn || CASE WHEN row_number() OVER v > 1 THEN '#' || row_number() OVER v ELSE '' END AS message_id, conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant')
        WINDOW v AS (PARTITION BY conv_id, turn ORDER BY CASE role WHEN 'user' THEN 'guest' ELSE 'host' END, text)),
      w AS (SELECT *, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id::VARCHAR ORDER BY turn, message_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l FROM m),
      o AS (SELECT *, list_filter(l, lambda x: x.role = w.role) AS own FROM w)
      SELECT message_id, CASE WHEN len(own) > 0 THEN array_to_string(list_transform(own[greatest(len(own) - 2, 1):], lambda x: x.text), ' ') || ' ' || text END AS rescan_text FROM o""",
    "s13_rate_limit": """SELECT event_id, strikes::BIGINT AS strikes, coalesce(recent, 0)::BIGINT AS recent_blocks, coalesce(recent, 0) >= 3 AS cooldown FROM (
      SELECT event_id, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS strikes,
        sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 600000 PRECEDING AND 1 PRECEDING) AS recent FROM events)""",
    "c2_fnv1a": """SELECT word, hash::BIGINT AS hash, (hash % 16384)::BIGINT AS cell FROM (
      SELECT word, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(word, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS hash
        FROM (SELECT n_name AS word FROM nation UNION SELECT c_mktsegment FROM customer))""",
    "c3_hashed_trigrams": """WITH grams AS (SELECT item_id, unnest(list_transform(range(1, length(text) + 1), lambda i: substring(' ' || lower(text) || ' ', i, 3))) AS g FROM benchmark),
      hashed AS (SELECT g, list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(g, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) % 16384 AS cell
        FROM (SELECT DISTINCT g FROM grams)),
      cells AS (SELECT item_id, cell, count(*)::DOUBLE AS n FROM grams JOIN hashed USING (g) GROUP BY item_id, cell)
      SELECT item_id, count(*) AS cells, round(sum(n * n) / sum(n * n), 6) AS norm, round(sum(n) / sqrt(sum(n * n)), 6) AS total FROM cells GROUP BY item_id""",
    "c5_c6_scores": """SELECT event_id, round(p, 6) AS p, CASE WHEN round(p, 9) < 0.3 THEN 'allow' WHEN round(p, 9) > 0.85 THEN 'block' ELSE 'escalate' END AS decision FROM (
      SELECT event_id, 1 / (1 + exp(-(value / 100 - 1))) AS p FROM events)""",
    "l1_cache_keys": r"SELECT sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS cache_key, count(*) AS n FROM conversations GROUP BY 1",
    "l2_evicted": "SELECT event_id::VARCHAR AS key FROM events ORDER BY ts DESC, event_id::VARCHAR LIMIT 100",
    "l4_parsed": """SELECT event_id, event_id % 2 = 0 AS contact, CASE WHEN event_id % 3 = 0 THEN 'phone' END AS contact_type, false AS safety,
      CASE WHEN event_id % 5 = 0 THEN 1.0 ELSE 0.25 END::DOUBLE AS confidence FROM events""",
    "l6_cost": """SELECT month, i AS tokens_in, o AS tokens_out, round((i * 0.05 + o * 0.08) / 1000000, 8)::DOUBLE AS dollars FROM (
      SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_orderkey % 400)::BIGINT AS i, sum(o_orderkey % 70)::BIGINT AS o FROM orders GROUP BY 1)""",
    "e1_confusion": f"""WITH {RULE}, c AS (SELECT count(*) FILTER (expected AND hit) AS tp, count(*) FILTER (NOT expected AND hit) AS fp, count(*) FILTER (expected AND NOT hit) AS fn,
        count(*) FILTER (NOT expected AND NOT hit) AS tn FROM judged)
      SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
        round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS friction FROM c""",
    "e2_by_group": f"WITH {RULE} SELECT lang AS grp, expected, count(*) AS n, count(*) FILTER (hit) AS actioned, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM judged GROUP BY ALL",
    "e3_shares": "SELECT source AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM documents GROUP BY source",
    "e4_cost": "SELECT event_type AS value, round((count(*) / sum(count(*)) OVER ())::DOUBLE * 100000 * (320 * 0.05 + 60 * 0.08)::DOUBLE / 1000000, 6) AS dollars FROM events GROUP BY event_type",
    "e5_percentiles": """SELECT round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99,
      round(max(l_extendedprice), 4) AS max FROM lineitem""",
    "e7_mined": f"WITH c AS (SELECT lower(coalesce(text, '')) AS folded FROM conversations), {judged.phrases('c')}",
    "p3_masked": """SELECT o_orderkey, substring(t, 1, k) || '•••' || substring(t, k + 3, 2) || '•••' || substring(t, k + 4 + o_orderkey % 3 + 2) AS masked FROM (
      SELECT o_orderkey, o_orderkey % 5 AS k, 'order ' || o_orderkey || ' is here and on its way' AS t FROM orders)""",
}
