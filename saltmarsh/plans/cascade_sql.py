r"""DuckDB SQL that judges messages from their text: views, digit runs, detections, scores and verdicts.

It is another formulation than the engine's: characters, tokens and terms are rows or lists, neighbours are window functions, terms are found by a join
on the words that begin in a text, and runs are islands. Lexicons and patterns are fixed values and shared; a word edge is RE2's.
"""

from __future__ import annotations

from saltmarsh import lexicons as lex
from saltmarsh.functions import detectors as d
from saltmarsh.functions import score as sc
from saltmarsh.sources.messages import HINDI, TECHNIQUES, WORDS

EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
ZEROS = [0x0660, 0x06F0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0E50, 0x0ED0, 0x0F20, 0x1040, 0xFF10]
DIGITS = "".join(chr(z + k) for z in ZEROS for k in range(10))
ONE = {k: v for k, v in lex.CONFUSABLES.items() if len(v) == 1}
TWO = {k: v for k, v in lex.CONFUSABLES.items() if len(v) == 2}
COUNTED = DIGITS + "".join(k for k, v in lex.CONFUSABLES.items() if k.strip() and v not in "-._ " and k != v)
LEETABLE = "".join(lex.LEET)
HIDDEN = r"[\x{200B}-\x{200F}\x{FEFF}\x{2060}\x{00AD}\x{180E}\x{202A}-\x{202E}\x{2066}-\x{2069}]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(terms) -> str:
    return ", ".join(map(lit, terms))


def re2(pattern: str) -> str:
    """A pattern of the engine with RE2's word edge, as a literal."""
    return lit(pattern.replace(EDGE, r"\b"))


def folded(text: str) -> str:
    out = f"translate({text}, {lit(DIGITS + ''.join(ONE))}, {lit('0123456789' * len(ZEROS) + ''.join(ONE.values()))})"
    for k, v in TWO.items():
        out = f"replace({out}, {lit(k)}, {lit(v)})"
    return f"lower({out})"


def counted(chars: str, text: str) -> str:
    return f"(length({text}) - length(translate({text}, {lit(chars)}, '')))"


def located(text: str, pattern: str, name: str = "h") -> str:
    """A list of (s, e, m) for the matches of a pattern, by the lengths between them."""
    found, gaps = f"regexp_extract_all({text}, {pattern})", f"string_split_regex({text}, {pattern})"
    before = f"coalesce(list_sum(list_transform(list_slice({gaps}, 1, i), lambda g: length(g))), 0) + coalesce(list_sum(list_transform(list_slice({found}, 1, i - 1), lambda g: length(g))), 0)"
    return f"list_transform(range(1, len({found}) + 1), lambda i: {{'s': ({before})::BIGINT, 'e': ({before} + length({found}[i]))::BIGINT, 'm': {found}[i]}})"


def hits(view: str, pattern: str, source: str = "views") -> str:
    """Rows (message_id, s, e, m) of a pattern's matches in a view."""
    return f"SELECT message_id, x.s AS s, x.e AS e, x.m AS m FROM (SELECT message_id, unnest({located(view, pattern)}) AS x FROM {source})"


def source_synth() -> str:
    return """
rows AS (
  SELECT o_orderkey AS message_id, o_custkey AS conversation_id, CASE WHEN (o_orderkey // 8) % 2 = 0 THEN 'guest' ELSE 'host' END AS sender_role,
    CASE WHEN (o_orderkey // 8) % 5 = 0 THEN 'post_booking' ELSE 'pre_booking' END AS booking_stage, (6000000000 + (o_orderkey * 7919) % 3999999999)::VARCHAR AS mobile,
    CASE o_orderkey % 8 WHEN 0 THEN 'call me on ' || mobile WHEN 1 THEN 'the price is ' || (o_orderkey % 9000 + 1000) || ' per night for 2 guests'
      WHEN 2 THEN 'pay me on user' || o_orderkey || '@okaxis' WHEN 3 THEN 'thanks see you soon' WHEN 4 THEN 'write to guest' || o_orderkey || '@gmail.com'
      WHEN 5 THEN 'see wa.me/91' || mobile WHEN 6 THEN 'you stupid clown' ELSE 'house no 4 near the temple' END AS text, epoch_ms(o_orderdate) AS ms
  FROM orders)"""


def source_techniques() -> str:
    spell = lambda words: "array_to_string(list_transform(string_split(mobile, ''), lambda c: ([" + listed(words) + "])[c::INT + 1]), ' ')"
    made = {
        "m": "mobile", "s": "array_to_string(string_split(mobile, ''), ' ')", "w": spell(WORDS), "h": spell(HINDI), "v": "array_to_string(string_split(mobile, ''), chr(8203))",
        "f": "translate(mobile, '0123456789', '０１２３４５６７８９')", "n": "mobile[2:10]", "5": "mobile[1:5]", "t": "mobile[6:10]", "4": "mobile[7:10]", "k": "o_orderkey::VARCHAR",
    }
    text = f"([{listed(TECHNIQUES)}])[o_orderkey % {len(TECHNIQUES)} + 1]"
    for name, value in made.items():
        text = f"replace({text}, '<{name}>', {value})"
    return f"""
rows AS (
  SELECT o_orderkey AS message_id, o_orderkey // 96 AS conversation_id, CASE WHEN (o_orderkey // 8) % 2 = 0 THEN 'guest' ELSE 'host' END AS sender_role,
    CASE WHEN (o_orderkey // 8) % 5 = 0 THEN 'post_booking' ELSE 'pre_booking' END AS booking_stage, (6000000000 + (o_orderkey * 7919) % 3999999999)::VARCHAR AS mobile,
    {text} AS text, 1700000000000 + o_orderkey * 300000 AS ms
  FROM orders)"""


def views() -> str:
    """views: by rows, the text's views, counters, and lists that tell a view's places in the message (wide) and the denoised view's in the folded one (kept)."""
    wide = f"CASE WHEN regexp_matches(c, '^{HIDDEN}$') THEN 0 WHEN c IN ('ﬁ', {listed(TWO)}) THEN 2 ELSE 1 END"
    left, right = r"regexp_extract(folded[1:i], '(\p{L}?)([0-9]+)$', ['l', 'd'])", r"regexp_extract(folded[i + 1:], '^([0-9]*)(\p{L}?)', ['d', 'l'])"
    leet = f"(length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) > 0 AND length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) >= {counted(LEETABLE, 't')})"
    return f"""
seen AS (SELECT *, replace(translate(text, '０１２３４５６７８９', '0123456789'), 'ﬁ', 'fi') AS whole FROM rows),
plain AS (SELECT *, regexp_replace(whole, '{HIDDEN}', '', 'g') AS nfkc FROM seen),
fold AS (SELECT *, length(whole) - length(nfkc) AS zero_width, {folded("nfkc")} AS folded, {counted(COUNTED, "nfkc")} AS confusables,
    CASE WHEN text = '' THEN [] ELSE list_transform(string_split(text, ''), lambda c: {wide}) END AS widths FROM plain),
marks AS (SELECT *, list_transform(range(1, length(folded) + 1), lambda i: NOT (regexp_matches(folded[i], '[0-9]') AND {left}.l <> '' AND {right}.l <> '' AND length({left}.d) + length({right}.d) <= 3)) AS stays FROM fold),
views AS (SELECT *, array_to_string(list_transform(range(1, length(folded) + 1), lambda i: CASE WHEN stays[i] THEN folded[i] ELSE '' END), '') AS denoised,
    list_filter(range(0, length(folded)), lambda i: stays[i + 1]) AS kept, length(folded) - length(denoised) AS noise,
    list_transform(range(1, len(widths) + 1), lambda i: list_sum(widths[1:i])::BIGINT) AS wide,
    CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform(regexp_extract_all(folded, '\\S+|\\s+'), lambda t: CASE WHEN {leet} THEN translate(t, {lit(LEETABLE)}, {lit("".join(lex.LEET.values()))}) ELSE t END), '') END AS deleet
  FROM marks)"""


def raw(s: str, e: str) -> str:
    """Columns s and e of the folded view as places in the message; the row has wide."""
    return f"len(list_filter(wide, lambda w: w <= {s}))::BIGINT AS s, (len(list_filter(wide, lambda w: w <= {e} - 1)) + 1)::BIGINT AS e"


def runs() -> str:
    """runs: (message_id, digits, start, end of the denoised view, word_n, num_n, odd: a separator that is no blank, mixed, s, e in the message)."""
    sep = r"[^ \t\n\r\f_\-.,;:]+"
    words = ", ".join(f"({lit(k)}, {lit(v)})" for k, v in lex.NUM_WORDS.items())
    times = ", ".join(f"({lit(k)}, {v})" for k, v in lex.MULTIPLIERS.items())
    return f"""
cut AS (SELECT message_id, unnest(list_transform({located("denoised", lit(sep))}, lambda h, k: {{'k': k, 's': h.s, 'm': h.m, 'sep': string_split_regex(denoised, {lit(sep)})[k]}})) AS x FROM views),
lead_ AS (SELECT message_id, x.k AS k, x.sep AS sep, length(regexp_extract(x.m, '^[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Sc}}]*')) AS skip, x.s AS pos, x.m AS m FROM cut),
core AS (SELECT message_id, k, sep, pos + skip AS pos, regexp_replace(m[skip + 1:], '[^\\p{{L}}\\p{{M}}\\p{{N}}]+$', '') AS token FROM lead_),
keyed AS (SELECT *, lower(token) AS low, regexp_replace(lower(token), '[^\\p{{L}}\\p{{M}}]', '', 'g') AS key FROM core),
known AS (SELECT a.*, w.v AS word, n.v AS many FROM keyed a LEFT JOIN (VALUES {words}) w(key, v) ON w.key = a.key LEFT JOIN (VALUES {times}) n(key, v) ON n.key = a.key),
after AS (SELECT *, lag(many) OVER (PARTITION BY message_id ORDER BY k) AS times, regexp_full_match(low, '[a-z]+[0-9]+|[0-9]+[a-z]+') AS glued, regexp_full_match(low, '[0-9]+') AS numeral FROM known),
pieces AS (
  SELECT message_id, 2 * k AS k, sep, pos, pos + length(token) AS til, times IS NOT NULL AND NOT (glued AND NOT numeral AND word IS NULL) AS rep, CASE WHEN numeral OR (glued AND word IS NULL) THEN NULL WHEN glued AND regexp_matches(low, '^[0-9]') THEN NULL ELSE word END AS word, key,
    CASE WHEN numeral THEN repeat(low, coalesce(times, 1)) WHEN glued AND word IS NOT NULL THEN CASE WHEN regexp_matches(low, '^[a-z]') THEN word ELSE regexp_replace(low, '[^0-9]', '', 'g') END
      WHEN word IS NOT NULL THEN repeat(word, coalesce(times, 1)) WHEN glued THEN regexp_replace(low, '[^0-9]', '', 'g') END AS digits FROM after WHERE many IS NULL
  UNION ALL
  SELECT message_id, 2 * k + 1, '', pos, pos + length(token), false, CASE WHEN regexp_matches(low, '^[0-9]') THEN word END, key, CASE WHEN regexp_matches(low, '^[a-z]') THEN regexp_replace(low, '[^0-9]', '', 'g') ELSE word END
  FROM after WHERE many IS NULL AND glued AND word IS NOT NULL),
beside AS (SELECT *, word IS NOT NULL AND key IN ({listed(lex.AMBIGUOUS_WORDS)}) AS amb, word IS NOT NULL AND key IN ({listed(lex.HIGH_RISK_AMBIGUOUS)}) AS risk,
    lag(digits) OVER w AS p, lead(digits) OVER w AS n, lag(length(digits) = 1 OR rep) OVER w AS pd, lead(length(digits) = 1 OR rep) OVER w AS nd FROM pieces WINDOW w AS (PARTITION BY message_id ORDER BY k)),
judged AS (SELECT *, digits IS NOT NULL AND (NOT amb OR CASE WHEN risk THEN coalesce(p IS NOT NULL AND pd AND n IS NOT NULL AND nd, false)
    ELSE (p IS NOT NULL OR n IS NOT NULL) AND (p IS NULL OR pd) AND (n IS NULL OR nd) END) AS ok FROM beside),
islands AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY message_id ORDER BY k) AS island FROM judged),
firsts AS (SELECT *, row_number() OVER (PARTITION BY message_id, island ORDER BY k) AS nth FROM islands WHERE ok),
grouped AS (SELECT message_id, island, string_agg(digits, '' ORDER BY k) AS digits, min(pos) AS start, max(til) AS "end", count(word) AS word_n, count(*) - count(word) AS num_n,
    coalesce(bool_or(nth > 1 AND regexp_matches(sep, '[_\\-.,;:]')), false) AS odd, bool_or(NOT amb) AS sure FROM firsts GROUP BY message_id, island),
runs AS (SELECT message_id, digits, start, "end", word_n, num_n, odd, word_n > 0 AND num_n > 0 AS mixed, {raw('kept[start + 1]', '(kept["end"] + 1)')} FROM grouped JOIN views USING (message_id) WHERE sure)"""


def terms(name: str, lists: dict[str, list[str]]) -> str:
    """name: (message_id, s, e, m, tag) where terms stand as words, without those inside one that begins before or is longer."""
    tags: dict[str, str] = {}
    for tag, words in lists.items():
        for t in words:
            tags.setdefault(t, tag)
    sizes = sorted({len(t) for t in tags})
    return f"""
{name}_list AS (SELECT * FROM (VALUES {", ".join(f"({lit(t)}, {lit(g)})" for t, g in tags.items())}) v(m, tag)),
{name}_all AS (
  SELECT message_id, s, s + n AS e, m, tag, deleet FROM (
    SELECT message_id, deleet, s, n, deleet[s + 1:s + n] AS m FROM (SELECT message_id, deleet, unnest(range(0, length(deleet))) AS s FROM words), (SELECT unnest({sizes}) AS n) WHERE s + n <= length(deleet)) JOIN {name}_list USING (m)
  WHERE NOT (regexp_matches(m[1], '[\\p{{L}}\\p{{N}}]') AND s > 0 AND regexp_matches(deleet[s], '[\\p{{L}}\\p{{N}}]')) AND NOT (regexp_matches(m[-1], '[\\p{{L}}\\p{{N}}]') AND regexp_matches(deleet[s + n + 1], '[\\p{{L}}\\p{{N}}]'))),
{name} AS (SELECT message_id, s, e, m, tag FROM {name}_all a WHERE NOT EXISTS (SELECT 1 FROM {name}_all o WHERE o.message_id = a.message_id AND o.s <= a.s AND o.e >= a.e AND (o.s < a.s OR o.e > a.e)))"""


def domain(host: str, names) -> str:
    return "(" + " OR ".join(f"array_to_string(list_slice(string_split({host}, '.'), -{k}, -1), '.') IN ({listed(names)})" for k in (2, 3, 4)) + f" OR {host} IN ({listed(names)}))"


def link(host: str) -> tuple[str, str]:
    cases = [(domain(host, lex.MESSENGER_DOMAINS), "contact.url.messenger", 0.97), (domain(host, lex.SHORTENERS), "contact.url.shortener", 0.8), (domain(host, lex.PAYMENT_DOMAINS), "contact.url.payment", 0.9),
             (f"string_split({host}, '.')[-1] IN ({listed(lex.RISKY_TLDS)})", "contact.url.risky_tld", 0.7)]
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for c, n, _ in cases) + " ELSE 'contact.url' END", "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, _, v in cases) + " ELSE 0.6 END"


HOSTED = "contains(host, '.') AND length(string_split(host, '.')[-1]) >= 2 AND NOT regexp_full_match(string_split(host, '.')[-1], '[0-9]+')"


def found() -> str:
    """One table for each detector, of (message_id, detector, type, s, e, confidence, evidence) with places in the message."""
    out = []

    def add(name: str, select: str, mapped: bool = True) -> None:
        places = raw("s", "e") if mapped else "s, e"
        out.append(f"det_{name} AS (SELECT message_id, '{name}' AS detector, type, {places}, confidence::DOUBLE AS confidence, evidence FROM ({select}) JOIN (SELECT message_id, wide FROM views) USING (message_id))")

    before = lambda n, at="start": f"denoised[greatest({at} - {n}, 0) + 1:{at}]"
    benign = rf"""(regexp_matches({before(24)} || digits || denoised["end" + 1:"end" + 24], {re2(d.BENIGN)}) OR regexp_matches({before(3)}, '(?i)[a-z]\s?$') OR regexp_matches(denoised["end" + 1:"end" + 3], '(?i)^\s?[a-z]'))"""
    kind = "CASE WHEN hidden THEN 'contact.phone.obfuscated' ELSE 'contact.phone' END"
    add("phone", rf"""SELECT * FROM (SELECT message_id, s, e, CASE WHEN full_ OR abroad THEN {kind} WHEN part THEN 'contact.phone.partial' END AS type,
        CASE WHEN full_ THEN least(0.99, 0.95 + CASE WHEN mixed THEN 0.04 WHEN word_n > 0 THEN 0.02 ELSE 0 END) WHEN abroad THEN 0.8 WHEN part THEN least(0.6, 0.2 + length(digits) / 10 * 0.4) END AS confidence,
        CASE WHEN regexp_matches(digits, '^[6-9][0-9]{{9}}$') THEN 'mobile of ten digits' WHEN full_ THEN 'mobile behind its country code' WHEN abroad THEN 'calling code and length of a number' WHEN part THEN length(digits) || ' digits' END AS evidence
      FROM (SELECT *, regexp_matches(digits, '^(91)?[6-9][0-9]{{9}}$') AS full_,
          length(digits) BETWEEN 11 AND 13 AND regexp_matches(digits, {re2(d.INTERNATIONAL)}) AND NOT regexp_matches(digits, {re2(d.DATED)}) AND (hidden OR NOT regexp_matches({before(24)}, {re2(d.EXPLAINING)})) AS abroad,
          length(digits) BETWEEN 5 AND 9 AND (hidden OR NOT (regexp_matches(digits, '^[1-8][0-9]{{5}}$') OR {benign})) AS part
        FROM (SELECT r.*, v.denoised, r.mixed OR r.word_n > 0 OR r.odd OR v.noise > 0 OR v.zero_width > 0 OR v.confusables > 0 AS hidden FROM runs r JOIN views v USING (message_id)))) WHERE type IS NOT NULL""", False)  # fmt: skip
    out.append(f"mail AS ({hits('folded', re2(d.EMAIL))})")
    out.append(f"""spelled AS (SELECT message_id, s, e, trim(m) AS m, NOT regexp_matches(trim(m), '^[^\\s@]+@[^\\s@]+$') AS swapped, lower(regexp_extract(m, {re2(d.SPELLED_EMAIL)}, 2)) IN ({listed(lex.EMAIL_DOMAINS)}) AS known
      FROM ({hits('folded', re2(d.SPELLED_EMAIL))}))""")
    add("email", """SELECT message_id, 'contact.email' AS type, s, e, 0.97 AS confidence, m AS evidence FROM mail UNION ALL
      SELECT message_id, CASE WHEN swapped THEN 'contact.email.obfuscated' ELSE 'contact.email' END, s, e, CASE WHEN known THEN 0.96 WHEN swapped THEN 0.9 ELSE 0.93 END, m
      FROM spelled a WHERE NOT EXISTS (SELECT 1 FROM mail b WHERE b.message_id = a.message_id AND b.s = a.s AND b.e = a.e)""")
    out.append(f"links AS (SELECT * FROM (SELECT *, lower(regexp_extract(m, {re2(d.URL)}, 1)) AS host, regexp_extract(m, {re2(d.URL)}, 2) AS path FROM ({hits('folded', re2(d.URL))})) WHERE {HOSTED})")
    out.append(f"spoken AS (SELECT * FROM (SELECT *, lower(regexp_extract(m, {re2(d.SPOKEN_URL)}, 1) || '.' || regexp_extract(m, {re2(d.SPOKEN_URL)}, 2)) AS host FROM ({hits('folded', re2(d.SPOKEN_URL))})) WHERE {HOSTED})")
    named, sure = link("host")
    add("url", f"""SELECT message_id, {named} AS type, s, e, {sure} AS confidence, host AS evidence FROM links UNION ALL
      SELECT message_id, 'contact.phone', s, e, 0.96, n FROM (SELECT *, list_filter(regexp_extract_all(path, '[0-9]{{10,15}}'), lambda x: length(x) >= 11 OR regexp_matches(x, '^[6-9][0-9]{{9}}$'))[1] AS n FROM links WHERE {domain("host", lex.MESSENGER_DOMAINS)}) WHERE n IS NOT NULL
      UNION ALL SELECT message_id, {named}, s, e, least(0.95, {sure} + 0.05), trim(m) FROM spoken""")
    scripts = " + ".join(f"regexp_matches(host, '\\p{{{s[2:]}}}')::INT" for s in d.SCRIPTS)
    out.append(f"""det_homograph AS (SELECT message_id, 'homograph' AS detector, 'contact.url.homograph' AS type, s, e, 0.9::DOUBLE AS confidence, host AS evidence
      FROM (SELECT *, lower(regexp_extract(m, {re2(d.URL)}, 1)) AS host FROM ({hits('nfkc', re2(d.URL))})) WHERE {HOSTED} AND {scripts} > 1)""")
    add("handle", rf"""SELECT message_id, 'contact.handle' AS type, s + length(p) AS s, e, 0.85 AS confidence, lower(m[length(p) + 1:]) AS evidence
        FROM (SELECT *, regexp_extract(m, '(?i)^[^a-z0-9_.@]') AS p FROM ({hits('folded', lit(r"(?i)(?:^|[^a-z0-9_.])@[a-z0-9._]{3,30}\b"))})) WHERE NOT regexp_matches(m, '(?i)\.[a-z]{{2,}}$')
      UNION ALL SELECT message_id, type, s, e, confidence, CASE WHEN type = 'contact.handle' THEN name ELSE n END FROM (
        SELECT *, regexp_replace(name, '[^0-9]', '', 'g') AS n FROM (SELECT *, lower(regexp_extract(m, {re2(d.PLATFORM)}, 2)) AS name FROM ({hits('folded', re2(d.PLATFORM))})) WHERE name NOT IN ({listed(lex.NOT_A_HANDLE)})),
        (VALUES ('contact.handle', 0.9, 0), ('contact.handle.embedded_digits', 0.8, 4)) t(type, confidence, least_) WHERE length(n) >= least_
      UNION ALL SELECT message_id, 'contact.handle.implicit', s, e, 0.75, trim(m) FROM ({hits('folded', re2(d.NAME_POINTER))})""")
    add("handle_run", f"""SELECT message_id, 'contact.handle.embedded_digits' AS type, s, e, CASE WHEN mixed THEN 0.88 ELSE 0.75 END AS confidence, digits AS evidence
      FROM runs JOIN (SELECT message_id FROM views WHERE regexp_matches(folded, {re2(d.PLATFORMS)})) USING (message_id) WHERE length(digits) >= 4""", False)
    out.append(rf"""vpa AS (SELECT * FROM (SELECT message_id, s, e - length(dot) AS e, m[1:length(m) - length(dot)] AS m, dot FROM (SELECT *, CASE WHEN ends_with(m, '.') THEN '.' ELSE '' END AS dot
      FROM ({hits('folded', lit(r"(?i)\b[A-Za-z0-9_.\-]{3,64}@[a-z]{2,20}\b\.?"))}))) WHERE dot = '' AND lower(string_split(m, '@')[-1]) IN ({listed(lex.UPI_PSP_HANDLES)}))""")
    add("upi", """SELECT message_id, 'payment.upi' AS type, s, e, 0.95 AS confidence, lower(m) AS evidence FROM vpa UNION ALL
      SELECT message_id, 'contact.phone', s, e, 0.95, lower(string_split(m, '@')[1]) FROM vpa WHERE regexp_matches(string_split(m, '@')[1], '^[6-9][0-9]{9}$')""")
    out.append("words AS (SELECT message_id, deleet FROM views)")
    out.append(terms("access", {"a": lex.ACCESS_TERMS}).strip())
    out.append(terms("places", {"a": lex.ADDRESS_TERMS}).strip())
    out.append(f"told AS (SELECT message_id FROM views WHERE NOT regexp_matches(deleet, {re2(d.QUESTION)}))")
    add("address", """SELECT message_id, 'contact.address.access_code' AS type, s, e, 0.85 AS confidence, m AS evidence FROM access JOIN told USING (message_id) UNION ALL
      SELECT message_id, 'contact.address', s, e, 0.75, m FROM places JOIN told USING (message_id)""")
    out.append(terms("meant", {"intent.channel": lex.INTENT_CHANNEL, "intent.contact": lex.INTENT_ACTION, "intent.offplatform": lex.INTENT_OFFPLATFORM, "intent.payment": lex.INTENT_PAYMENT}).strip())
    out.append(f"""calm AS (SELECT message_id, x.s AS s, x.s + length(t) AS e FROM (SELECT message_id, t, unnest(list_filter(list_transform(range(0, length(deleet)), lambda i: {{'s': i, 'on': starts_with(deleet[i + 1:], t)}}), lambda z: z.on)) AS x
      FROM views, (SELECT unnest([{listed(lex.INTENT_NEGATIVE_CONTEXT)}]) AS t) WHERE contains(deleet, t)))""")
    inside = "EXISTS (SELECT 1 FROM calm c WHERE c.message_id = a.message_id AND c.s <= a.s AND c.e >= a.e)"
    out.append(f"stated AS (SELECT * FROM meant a WHERE NOT {inside})")
    out.append(f"""move AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY s) AS nth FROM ({hits('deleet', re2(d.CHANNEL))})) a JOIN (SELECT message_id, deleet FROM views) USING (message_id)
      WHERE nth = 1 AND regexp_matches(deleet[greatest(s - 40, 0) + 1:s], {re2(d.MOVE)}) AND NOT regexp_matches(deleet, {re2(d.REPORTED)}) AND NOT {inside}
        AND message_id NOT IN (SELECT message_id FROM stated WHERE tag = 'intent.offplatform'))""")
    add("intent", """SELECT message_id, tag AS type, s, e, CASE tag WHEN 'intent.channel' THEN 0.7 WHEN 'intent.contact' THEN 0.8 WHEN 'intent.offplatform' THEN 0.9 ELSE 0.75 END AS confidence, m AS evidence FROM stated
      UNION ALL SELECT message_id, 'intent.offplatform', s, e, 0.85, m FROM move""")
    out.append(terms("rude", {"0": lex.HOSTILITY_MILD, "1": lex.HOSTILITY_SEV1, "2": lex.HOSTILITY_SEV2, "3": lex.HOSTILITY_SEV3}).strip())
    masked = " UNION ALL ".join(f"SELECT message_id, s, e, m, '{level}' AS tag FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY s) AS nth FROM ({hits('deleet', re2(p))})) WHERE nth = 1" for p, level in d.MASKED)
    out.append(f"""hostile AS (SELECT *, true AS known FROM rude UNION ALL SELECT *, false FROM ({masked}) a WHERE NOT EXISTS (SELECT 1 FROM rude r WHERE r.message_id = a.message_id AND r.s <= a.s AND r.e > a.s))""")
    add("hostility", f"""SELECT message_id, 'safety.hostility.sev' || level AS type, s, e, CASE level WHEN '3' THEN 0.95 WHEN '2' THEN CASE WHEN known THEN 0.9 ELSE 0.85 END WHEN '1' THEN 0.7 ELSE 0.4 END AS confidence, m AS evidence
      FROM (SELECT h.*, CASE WHEN tag = '0' AND regexp_matches(deleet[greatest(s - 16, 0) + 1:s], {re2(d.AIMED)}) THEN '2' ELSE tag END AS level FROM hostile h JOIN (SELECT message_id, deleet FROM views) USING (message_id))""")
    out.append(terms("threat", {"demand": lex.EXTORTION_DEMAND, "condition": lex.EXTORTION_CONDITIONAL, "leverage": lex.EXTORTION_LEVERAGE}).strip())
    near = "o.message_id = l.message_id AND greatest(o.s - l.e, l.s - o.e, 0) <= 160"
    first = lambda tag: f"(SELECT arg_min({{'s': o.s, 'e': o.e, 'm': o.m}}, o.s) FROM threat o WHERE o.tag = '{tag}' AND {near})"
    add("extortion", f"""SELECT message_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'safety.extortion' ELSE 'safety.extortion.implied' END AS type,
        least(s, coalesce(a.s, s), CASE WHEN a IS NULL OR b IS NOT NULL THEN coalesce(b.s, s) ELSE s END) AS s, greatest(e, coalesce(a.e, e), coalesce(b.e, e)) AS e,
        CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 0.95 ELSE 0.75 END AS confidence, concat_ws(' + ', a.m, b.m, m) AS evidence
      FROM (SELECT l.*, {first("demand")} AS a, {first("condition")} AS b FROM threat l WHERE l.tag = 'leverage') WHERE a IS NOT NULL OR b IS NOT NULL""")
    out.append(terms("cue", {"urgency": lex.SCAM_URGENCY, "payment": lex.SCAM_PAYMENT, "too_good": lex.SCAM_TOO_GOOD}).strip())
    add("scamlink", """SELECT message_id, 'safety.scamlink' AS type, s, e, least(0.93, 0.6 + n * 0.12) AS confidence, evidence FROM (SELECT * FROM det_url UNION ALL SELECT * FROM det_homograph) JOIN (SELECT message_id, count(DISTINCT tag) AS n FROM cue GROUP BY 1) USING (message_id)""", False)
    return ",\n".join(out)


NAMES = ["phone", "email", "url", "homograph", "handle", "handle_run", "upi", "address", "intent", "hostility", "extortion", "scamlink"]


def best(names=NAMES, into: str = "best") -> str:
    union = " UNION ALL ".join(f"SELECT * FROM det_{n}" for n in names)
    return f"""{into} AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY message_id, type, s, e ORDER BY confidence DESC, evidence) AS nth FROM ({union})) WHERE nth = 1)"""


#: The terms of a score by name, in order; those after the first six see the sum of these as so_far.
FIRST = {
    "validPhone": "CASE WHEN phone THEN 9.0 END", "partialPhone": "CASE WHEN part THEN 2.5 * (least(1.0, longest / 10) + CASE WHEN longest >= 8 THEN 1 ELSE 0 END) END", "mixedForm": "3.0 * mixed_n",
    "noiseDigitsRemoved": "0.45 * noise", "weirdnessFlags": "0.9 * weird", "intentHits": "CASE WHEN coalesce(meant_n, 0) + carried > 0 THEN 1.1 * (coalesce(meant_n, 0) + carried + coalesce(off, 0)) END",
}
LATER = {
    "offPlatformFloor": f"CASE WHEN (off > 0 OR (channel > 0 AND asked > 0) OR asks) AND NOT regexp_matches(folded, {re2(sc.REPORT)}) THEN greatest(3.6 - so_far, 0) END",
    "unvalidatedNumber": "CASE WHEN longest >= 10 AND asked > 0 AND phones = 0 THEN 6.75 END", "handle": "CASE WHEN handle THEN 2.6 END", "address": "CASE WHEN address THEN 4.2 END", "upi": "CASE WHEN upi THEN 8.5 END",
    "riskyUrl": "3.2 * least(2, coalesce(risky, 0))", "digitPressure": "CASE WHEN pressure > 0 THEN 0.35 * 6 * (1 - exp(-pressure / 12)) END", "zeroWidthCount": "0.8 * zero_width", "email": "CASE WHEN email THEN 8.5 END",
    "confusablesFolded": "0.4 * confusables",
}
SAFE = {
    "hostility": "CASE WHEN sev3 THEN 9.0 WHEN sev2 THEN 4.0 WHEN sev1 THEN 3.5 WHEN sev0 THEN 0.6 END", "extortion": "CASE WHEN forced THEN 8.0 WHEN implied THEN 4.5 END", "scamlink": "CASE WHEN scam THEN 7.0 END",
}


def _summed() -> str:
    columns = lambda table: ", ".join(f"coalesce({v}, 0)::DOUBLE AS t_{k}" for k, v in table.items())
    total = lambda table: " + ".join(f"t_{k}" for k in table)
    return f"""
running AS (SELECT *, {columns(FIRST)}, {total(FIRST)} AS so_far FROM joined),
summed AS (SELECT *, {columns(LATER)}, {columns(SAFE)}, so_far + {total(LATER)} AS contact, {total(SAFE)} AS safety,
    (CASE booking_stage WHEN 'post_booking' THEN 0.35 ELSE 1 END)::DOUBLE * (CASE sender_role WHEN 'host' THEN 1.25 ELSE 1 END)::DOUBLE AS factor, contact * factor + safety AS total_score,
    (contact - t_digitPressure - 1.1 * carried) * factor + safety AS own FROM running),"""


def scored(evidence: str = "best", extra: str = "") -> str:
    """scored: (message_id, ..., contact, safety, score, band) by the detections. extra: a table with digit_pressure, session_intent of messages."""
    has = lambda *t: f"coalesce(bool_or(type IN ({listed(t)})), false)"
    n = lambda p: f"count(*) FILTER (starts_with(type, '{p}'))"
    carried = "least(session_intent, 3.0)" if extra else "0.0"
    pressure = "digit_pressure" if extra else "0.0"
    return f"""
facts AS (SELECT message_id, {has('contact.phone', 'contact.phone.obfuscated')} AS phone, {n('contact.phone.partial')} > 0 AS part, {n('contact.phone')} AS phones, {n('intent.channel')} AS channel, {n('intent.contact')} AS asked,
    {n('intent.offplatform')} AS off, {n('intent.')} AS meant_n, {n('contact.handle')} > 0 AS handle, {n('contact.address')} > 0 AS address, {n('payment.upi')} > 0 AS upi, {n('contact.url.')} AS risky, {n('contact.url')} AS urls, {n('contact.email')} > 0 AS email,
    {has('safety.hostility.sev3')} AS sev3, {has('safety.hostility.sev2')} AS sev2, {has('safety.hostility.sev1')} AS sev1, {has('safety.hostility.sev0')} AS sev0, {has('safety.extortion')} AS forced, {has('safety.extortion.implied')} AS implied, {n('safety.scamlink')} > 0 AS scam,
    coalesce(bool_or(starts_with(type, 'intent.contact') AND regexp_matches(evidence, {re2(sc.THING)}) AND regexp_matches(evidence, {re2(sc.ASK)})), false) AS asks, {has(*sc.HARD)} OR {n('contact.email')} > 0 OR {n('payment.upi')} > 0 AS hard, count(*) AS n_detections, max(confidence) AS top
  FROM {evidence} GROUP BY message_id),
lengths AS (SELECT message_id, max(length(digits)) AS longest, count(*) FILTER (mixed) AS mixed_n, sum(length(digits)) AS total, count(*) AS run_n FROM runs GROUP BY message_id),
joined AS (SELECT v.message_id, v.conversation_id, v.sender_role, v.booking_stage, v.text, v.folded, v.noise, v.zero_width, v.confusables, coalesce(longest, 0) AS longest, coalesce(mixed_n, 0) AS mixed_n, coalesce(total, 0) AS total, coalesce(run_n, 0) AS run_n,
    coalesce(f.n_detections, 0) AS n_detections, f.* EXCLUDE (message_id, n_detections), {carried} AS carried, {pressure} AS pressure, 0 AS weird{", x.* EXCLUDE (message_id)" if extra else ""}
  FROM views v LEFT JOIN facts f USING (message_id) LEFT JOIN lengths USING (message_id){f" JOIN {extra} x USING (message_id)" if extra else ""}),
{_summed()}
scored AS (SELECT *, CASE WHEN own < 3 AND total_score >= 3 THEN least(total_score, 2.99) ELSE total_score END AS score, CASE WHEN score < 3 THEN 'allow' WHEN score > 8 THEN 'block' ELSE 'escalate' END AS band,
    CASE band WHEN 'escalate' THEN 'review' ELSE band END AS verdict, CASE WHEN band = 'allow' AND n_detections = 0 THEN 'tier1.normalize' ELSE 'tier3.risk' END AS resolved_by,
    greatest(coalesce(top, 0), CASE band WHEN 'allow' THEN 1 ELSE 0 END)::DOUBLE AS confidence FROM summed)"""


def cascade(source: str) -> str:
    return f"WITH {source},{views()},{runs()},\n{found()},\n{best()},{scored()}"


def masked() -> str:
    """hidden: (message_id, masked): the text with each stretch of covered characters replaced."""
    mark = "CASE WHEN length(f[i]) < 3 THEN '•••' ELSE repeat('•', least(length(f[i]), 12)) END"
    return f"""
cover AS (SELECT message_id, list(DISTINCT p) AS places FROM (SELECT message_id, unnest(range(s, e)) AS p FROM best WHERE NOT starts_with(type, 'intent.')) GROUP BY message_id),
flags AS (SELECT message_id, text, array_to_string(list_transform(range(0, length(text)), lambda i: CASE WHEN list_contains(places, i) THEN 'x' ELSE 'o' END), '') AS w FROM views JOIN cover USING (message_id)),
spots AS (SELECT *, regexp_extract_all(w, 'x+') AS f, {located("w", "'x+'")} AS h FROM flags),
hidden AS (SELECT message_id, array_to_string(list_transform(range(1, len(h) + 1), lambda i: text[CASE WHEN i = 1 THEN 0 ELSE h[i - 1].e END + 1:h[i].s] || {mark}), '') || text[h[-1].e + 1:] AS masked FROM spots)"""


def _all(name: str, tail: str, names=NAMES) -> str:
    """SQL over the techniques' texts; name is that of the last table needed."""
    parts = [source_techniques(), views()]
    if name != "views":
        parts.append(runs())
    if name not in ("views", "runs"):
        parts += [found(), best(names)]
    if name not in ("views", "runs", "best"):
        parts.append(scored())
    return "WITH " + ",".join(parts) + tail


LISTED = ' SELECT message_id, type, s AS start, e AS "end", round(confidence, 6) AS confidence, evidence FROM best'
VERDICTS = ", verdicts AS (SELECT *, CASE WHEN message_id % 3 = 0 THEN 'async' ELSE 'sync' END AS mode FROM scored)"
FAMILY = "CASE WHEN safe_ THEN 'safety' WHEN touch THEN 'contact' ELSE 'default' END"
FAMILIES = """, kinds AS (SELECT message_id, bool_or(starts_with(type, 'safety.')) AS safe_, bool_or(starts_with(type, 'contact.') OR starts_with(type, 'payment.') OR starts_with(type, 'intent.')) AS touch,
    array_to_string(list_sort(list(DISTINCT type)), ',') AS categories FROM best GROUP BY message_id)"""


def _features() -> str:
    """Named features of rows of scored, by their number."""
    from saltmarsh.operators.classifier import DENSE

    flag = lambda c: f"coalesce({c}, false)::INT"
    some = lambda c: f"coalesce({c}, 0)"
    values = {
        "validPhone": flag("phone"), "partialPhone": flag("part"), "partialLength": "longest / 10", "mixedForm": "mixed_n", "noiseDigits": "noise", "intentChannel": some("channel"), "intentContact": some("asked"), "intentOffplatform": some("off"),
        "intentPayment": "coalesce(meant_n - channel - asked - off, 0)", "handle": flag("handle"), "handleDigits": flag("carried_digits"), "upi": flag("upi"), "email": flag("email"), "url": flag("urls > 0"), "riskyUrl": some("risky"),
        "zeroWidth": "zero_width", "confusables": "confusables", "hostility": flag("sev0 OR sev1 OR sev2 OR sev3"), "extortion": flag("forced OR implied"), "scamlink": flag("scam"), "digitRunCount": "run_n", "maxDigitRunLength": "longest", "totalDigits": "total",
        "textLength": "ln(1 + length(folded))", "digitRatio": "CASE WHEN length(folded) > 0 THEN total / length(folded) ELSE 0 END", "isHost": "(sender_role = 'host')::INT", "isPostBooking": "(booking_stage = 'post_booking')::INT",
    }
    rows = ", ".join(f"{{'idx': {DENSE.index(k)}, 'value': ({v})::DOUBLE}}" for k, v in values.items())
    return f""", carrying AS (SELECT DISTINCT message_id, true AS carried_digits FROM best WHERE type = 'contact.handle.embedded_digits'),
features AS (SELECT message_id, x.idx::BIGINT AS idx, x.value AS value FROM (SELECT message_id, unnest([{rows}]) AS x FROM scored LEFT JOIN carrying USING (message_id) WHERE band = 'escalate') WHERE x.value <> 0)"""


def _chances() -> str:
    from saltmarsh.operators.classifier import DENSE
    from saltmarsh.plans.cascade_queries import BIAS, WEIGHTS

    weights = ", ".join(f"({DENSE.index(k)}, {w}::DOUBLE)" for k, w in WEIGHTS.items() if k in DENSE)
    return f"""{_features()},
odds AS (SELECT message_id, 1 / (1 + exp(-({BIAS} + coalesce(sum(value * w), 0)))) AS p FROM (SELECT message_id FROM scored WHERE band = 'escalate') LEFT JOIN features USING (message_id) LEFT JOIN (VALUES {weights}) v(idx, w) USING (idx) GROUP BY message_id),
decided AS (SELECT message_id, p, CASE WHEN round(p, 9) < 0.3 THEN 'allow' WHEN round(p, 9) > 0.85 THEN 'block' ELSE 'escalate' END AS four FROM odds)"""


#: Fixed values, typed apart from the engine's: words that carry no meaning of their own.
STOP = "a an and are at bhi but hai hain hello hi i if in is it just ka kar ke ki ko me my of on or par pe please se that the then this to us was we will with you your be can for".split()
SPLIT = r"[^\p{L}\p{N}]+"
KEY = r"sha256(trim(regexp_replace(folded, '\s+', ' ', 'g')))"


def phrases(rows: str) -> str:
    return f"""t AS (SELECT list_filter(string_split_regex(folded, '{SPLIT}'), lambda w: length(w) > 1 AND NOT list_contains([{listed(STOP)}], w)) AS w FROM {rows}),
      p AS (SELECT unnest(list_distinct(list_filter(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), lambda x: length(x) >= 4))) AS phrase FROM t)
      SELECT phrase, count(*) AS n FROM p GROUP BY phrase HAVING count(*) >= 2"""


#: Where a detector's own query takes in more than one table.
DETECTORS = {
    "d1_d7_phones": ["phone"], "d8_d9_addresses_of_mail": ["email"], "d10_d12_d28_links": ["url", "homograph", "scamlink"], "d13_homographs": ["homograph"], "d14_d16_d18_handles": ["handle"], "d17_handle_runs": ["handle_run"],
    "d19_payment_addresses": ["upi"], "d20_d21_places": ["address"], "d22_d24_intents": ["intent"], "d25_d26_hostility": ["hostility"], "d27_extortion": ["extortion"], "d31_detections": NAMES,
}
ORACLES = {name: _all("best", LISTED, names) for name, names in DETECTORS.items()} | {
    "technique_messages": f"WITH {source_techniques()} SELECT message_id, conversation_id, sender_role, booking_stage, text FROM rows",
    "n1_n11_views": _all("views", """ SELECT message_id, nfkc, folded, deleet, denoised, zero_width::BIGINT AS zero_width, confusables::BIGINT AS confusables, noise::BIGINT AS noise, array_to_string(kept, ',') AS denoised_at,
      array_to_string(list_transform(range(0, length(folded)), lambda i: len(list_filter(wide, lambda w: w <= i))), ',') AS folded_at FROM views"""),
    "n12_n20_runs": _all("runs", ' SELECT message_id, digits, start::BIGINT AS start, "end"::BIGINT AS "end", word_n, num_n, s AS raw_start, e AS raw_end, odd, mixed FROM runs'),
    "r1_r17_terms": _all("scored", " SELECT * FROM (" + " UNION ALL ".join(f"SELECT message_id, '{k}' AS term, round(t_{k}, 6) AS value FROM scored WHERE t_{k} <> 0" for k in [*FIRST, *LATER, *SAFE]) + ")"),
    "r14_r16_scores": _all("scored", """ SELECT message_id, round(contact, 6) AS contact, round(safety, 6) AS safety, CASE booking_stage WHEN 'post_booking' THEN 0.35 ELSE 1 END::DOUBLE AS stage_modifier,
      CASE sender_role WHEN 'host' THEN 1.25 ELSE 1 END::DOUBLE AS role_modifier, round(score, 6) AS score, band FROM scored"""),
    "v1_v3_verdicts": _all("scored", FAMILIES + " SELECT message_id, verdict, resolved_by, round(confidence, 6) AS confidence, coalesce(categories, '') AS categories, floor(round(score, 9) * 1000 + 0.5) / 1000 AS score FROM scored LEFT JOIN kinds USING (message_id)"),
    "v4_pending": _all("scored", " SELECT message_id, message_id % 3 = 0 AS pending, CASE WHEN message_id % 3 = 0 THEN 'allow' ELSE verdict END AS verdict FROM scored"),
    "v5_signals": _all("scored", """ SELECT message_id, floor(score * 1000 + 0.5) / 1000 AS risk_score, floor(contact * 1000 + 0.5) / 1000 AS contact_score, floor(safety * 1000 + 0.5) / 1000 AS safety_score, CASE booking_stage WHEN 'post_booking' THEN 0.35 ELSE 1 END::DOUBLE AS stage_modifier,
      CASE sender_role WHEN 'host' THEN 1.25 ELSE 1 END::DOUBLE AS role_modifier, noise::BIGINT AS noise_digits_removed, zero_width::BIGINT AS zero_width_count, confusables::BIGINT AS confusables_folded, run_n::BIGINT AS digit_runs, n_detections::BIGINT AS detections, NULL::VARCHAR AS classifier_p FROM scored"""),
    "p1_p3_policy": _all("scored", FAMILIES + "," + masked() + f""", acted AS (SELECT s.message_id, s.text, masked, len(h) AS n, {FAMILY} AS family, CASE WHEN verdict = 'allow' THEN 'deliver' WHEN verdict = 'block' AND family = 'contact' AND masked IS NOT NULL THEN 'mask' ELSE verdict END AS action
        FROM scored s LEFT JOIN hidden USING (message_id) LEFT JOIN spots USING (message_id) LEFT JOIN kinds USING (message_id))
      SELECT message_id, action, CASE action WHEN 'deliver' THEN text WHEN 'mask' THEN masked END AS delivered_text, CASE action WHEN 'mask' THEN n ELSE 0 END::BIGINT AS n_masked FROM acted"""),
    "p2_actions": _all("scored", FAMILIES + f" SELECT {FAMILY} AS family, CASE verdict WHEN 'allow' THEN 'deliver' ELSE verdict END AS action, count(*) AS n FROM scored LEFT JOIN kinds USING (message_id) GROUP BY ALL"),
    "c1_features": _all("scored", _features() + " SELECT message_id, idx, round(value, 6) AS value FROM features"),
    "c4_c5_probabilities": _all("scored", _chances() + " SELECT message_id, round(p, 6) AS probability, four AS decision FROM decided"),
    "v1_all_tiers": _all("scored", _chances() + """, first_ AS (SELECT s.message_id, s.band, s.resolved_by, s.booking_stage, s.folded, p, four, coalesce(hard, false) AS hard, s.band = 'escalate' AND (four = 'escalate' OR (four = 'allow' AND coalesce(hard, false))) AS asked FROM scored s LEFT JOIN decided USING (message_id))
      SELECT message_id, CASE WHEN band <> 'escalate' THEN band WHEN NOT asked THEN four WHEN contains(folded, 'review') THEN CASE booking_stage WHEN 'pre_booking' THEN 'block' ELSE 'review' END WHEN contains(folded, 'direct') THEN 'block' ELSE 'allow' END AS verdict,
        CASE WHEN band <> 'escalate' THEN resolved_by WHEN NOT asked THEN 'tier4.classifier' ELSE 'tier5.llm' END AS resolved_by, round(p, 6) AS probability, CASE WHEN asked THEN 'llm' END AS source FROM first_"""),
    "l5_l7_adjudicated": _all("views", f""" SELECT key, CASE WHEN held THEN 'cache' ELSE 'llm' END AS source, held OR NOT contains(folded, 'review') AS ok, held OR (contains(folded, 'direct') AND NOT contains(folded, 'review')) AS contact
      FROM (SELECT {KEY} AS key, min(folded) AS folded, bool_or(message_id % 2 = 0) AS held FROM views GROUP BY 1)"""),
    "s13_cooldowns": _all("scored", FAMILIES + "," + masked() + f""", acted AS (SELECT s.message_id, s.conversation_id, s.sender_role, ms, (verdict = 'block' AND NOT ({FAMILY} = 'contact' AND masked IS NOT NULL))::INT AS hit
        FROM scored s JOIN (SELECT message_id, ms FROM rows) USING (message_id) LEFT JOIN hidden USING (message_id) LEFT JOIN kinds USING (message_id))
      SELECT message_id, coalesce(sum(hit) OVER (PARTITION BY conversation_id, sender_role ORDER BY ms RANGE BETWEEN 600000 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS recent_blocks FROM acted"""),
    "io4_stats": _all("scored", """, timed AS (SELECT verdict, resolved_by, (message_id * 37 % 1000) / 100 AS ms, (message_id % 5) / 1000000 AS usd FROM scored)
      SELECT 'verdict' AS kind, verdict AS name, count(*) AS n, round(count(*) / (SELECT count(*) FROM timed), 6) AS share, NULL::DOUBLE AS p50, NULL::DOUBLE AS p95, NULL::DOUBLE AS p99, NULL::DOUBLE AS per_100k FROM timed GROUP BY verdict
      UNION ALL SELECT 'tier', resolved_by, count(*), round(count(*) / (SELECT count(*) FROM timed), 6), NULL, NULL, NULL, NULL FROM timed GROUP BY resolved_by
      UNION ALL SELECT 'all', NULL, count(*), 1.0, round(quantile_cont(ms, 0.5), 6), round(quantile_cont(ms, 0.95), 6), round(quantile_cont(ms, 0.99), 6), round(sum(usd) / count(*) * 100000, 6) FROM timed"""),
    "io3_health": "SELECT 'ok' AS status, true AS deterministic, false AS trigrams, true AS classifier, false AS adjudicator, 'open' AS fail_post_booking, 'closed' AS fail_pre_booking",
    "e7_uncaught": _all("best", f", missed AS (SELECT folded FROM views v WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.message_id = v.message_id AND regexp_matches(type, '^(contact|safety|payment)[.]'))), {phrases('missed')}"),
    "e8_self_play": _all("scored", " SELECT count(*) AS n, count(*) FILTER (c) AS caught FROM (SELECT lower(text) AS t, bool_or(verdict <> 'allow') AS c FROM scored GROUP BY 1)"),
}


def sessions(source: str) -> str:
    """Tables up to `settled`: conversations with state. Fragments are merged by a recursion over each conversation's messages that have some."""
    from saltmarsh.operators.session import EXPLAINED

    near = lambda part: f"regexp_matches({part}, {re2(EXPLAINED)})"
    before, after = "denoised[greatest(start - 20, 0) + 1:start]", 'denoised["end" + 1:"end" + 20]'
    joint = f"WITH rows AS (SELECT message_id, conversation_id, sender_role, booking_stage, again AS text FROM sess WHERE again IS NOT NULL AND message_id IN (SELECT message_id FROM runs)),{views()},{runs()},\n{found()},\n{best(['phone', 'email', 'url', 'upi'])} SELECT * FROM best"
    return f"""WITH RECURSIVE {source},{views()},{runs()},
{found()},
{best()},
amounts AS (SELECT v.message_id, v.conversation_id, v.sender_role, v.ms, v.text, coalesce(d.n, 0) * CASE v.booking_stage WHEN 'post_booking' THEN 0.2 ELSE 1 END AS amount, coalesce(i.n, 0) AS meant, coalesce(k.types, []) AS types
  FROM views v LEFT JOIN (SELECT message_id, sum(length(digits)) AS n FROM runs GROUP BY 1) d USING (message_id) LEFT JOIN (SELECT message_id, count(*) AS n FROM best WHERE starts_with(type, 'intent.') GROUP BY 1) i USING (message_id)
  LEFT JOIN (SELECT message_id, list(DISTINCT type) AS types FROM best GROUP BY 1) k USING (message_id)),
decayed AS (SELECT a.message_id, coalesce(sum(b.amount * power(2, -(a.ms - b.ms) / 3600000::DOUBLE)), 0) AS digit_pressure, coalesce(sum(b.meant * power(2, -(a.ms - b.ms) / 3600000::DOUBLE)), 0) AS session_intent
  FROM amounts a LEFT JOIN amounts b ON b.conversation_id = a.conversation_id AND (b.ms, b.message_id) < (a.ms, a.message_id) GROUP BY a.message_id),
held AS (SELECT *, list({{'who': sender_role, 'text': text, 'types': types}}) OVER (PARTITION BY conversation_id ORDER BY ms, message_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS last FROM amounts),
mine AS (SELECT *, list_filter(last, lambda x: x.who = held.sender_role) AS own FROM held),
sess AS (SELECT m.*, v.booking_stage, CASE WHEN len(own) > 0 THEN array_to_string(list_transform(own[greatest(len(own) - 2, 1):], lambda x: x.text), ' ') || ' ' || m.text END AS again, list_concat(m.types, flatten(list_transform(own, lambda x: x.types))) AS seen
  FROM mine m JOIN (SELECT message_id, booking_stage FROM views) v USING (message_id)),
joint AS ({joint}),
crossed AS (SELECT j.* FROM joint j JOIN sess s USING (message_id) WHERE regexp_matches(type, '^(contact\\.phone|payment\\.upi|contact\\.email)') AND NOT list_contains(seen, type) AND j.e > length(again) - length(text)),
evidence AS (SELECT * FROM best UNION ALL SELECT * FROM crossed),
loose AS (SELECT message_id, list(digits ORDER BY start) AS digits FROM (SELECT r.*, denoised FROM runs r JOIN views USING (message_id)) r WHERE NOT regexp_matches(digits, '^(91)?[6-9][0-9]{{9}}$') AND NOT regexp_matches({before}, '(?i)[a-z]$')
  AND NOT regexp_matches({after}, '(?i)^[a-z]') AND NOT {near(before)} AND NOT {near(after)}
  AND NOT EXISTS (SELECT 1 FROM best b WHERE b.message_id = r.message_id AND NOT starts_with(b.type, 'contact.phone') AND NOT starts_with(b.type, 'intent.') AND b.s <= r.s AND b.e >= r.e) GROUP BY message_id),
fr AS (SELECT conversation_id, message_id, ms, sender_role, digits, row_number() OVER (PARTITION BY conversation_id ORDER BY ms, message_id) AS k FROM loose JOIN amounts USING (message_id)),
fold_ AS (
  SELECT DISTINCT conversation_id, 0::BIGINT AS k, NULL::BIGINT AS message_id, []::STRUCT(ms BIGINT, who VARCHAR, d VARCHAR)[] AS buffer, NULL::VARCHAR AS merged FROM fr
  UNION ALL
  SELECT conversation_id, k, message_id, CASE WHEN got IS NULL THEN buffer ELSE list_transform(list_filter(range(1, len(buffer) + 1), lambda i: NOT list_contains(own[got.a:-got.b], i)), lambda i: buffer[i]) END, got.j
  FROM (SELECT *, list_sort(list_filter(flatten(list_transform(range(1, len(own)), lambda a: list_transform(range(a + 1, len(own) + 1), lambda b:
        {{'l': -length(array_to_string(list_transform(own[a:b], lambda i: buffer[i].d), '')), 'a': a, 'b': -b, 'j': array_to_string(list_transform(own[a:b], lambda i: buffer[i].d), '')}}))), lambda c: regexp_full_match(c.j, '(91)?[6-9][0-9]{{9}}')))[1] AS got
    FROM (SELECT *, list_filter(range(1, len(buffer) + 1), lambda i: buffer[i].who = z.sender_role) AS own
      FROM (SELECT f.conversation_id, f.k, f.message_id, f.sender_role,
          list_slice(list_concat(list_filter(p.buffer, lambda x: f.ms - x.ms <= 1800000), list_transform(f.digits, lambda d: {{'ms': f.ms::BIGINT, 'who': f.sender_role, 'd': d}})), -10, -1) AS buffer
        FROM fold_ p JOIN fr f ON f.conversation_id = p.conversation_id AND f.k = p.k + 1) z))),{scored("evidence", "decayed")},
settled AS (SELECT s.message_id, s.conversation_id, f.merged, CASE WHEN f.merged IS NOT NULL THEN greatest(s.score, 9) ELSE s.score END AS score, CASE WHEN f.merged IS NOT NULL THEN 'block' ELSE s.band END AS band
  FROM scored s LEFT JOIN (SELECT message_id, merged FROM fold_ WHERE merged IS NOT NULL) f USING (message_id))"""


ORACLES["s1_s12_sessions"] = sessions(source_techniques()) + """
SELECT message_id, round(digit_pressure, 4) AS digit_pressure, round(session_intent, 4) AS session_intent, md5(coalesce(again, '')) AS rescan, coalesce(c.crossed, '') AS crossed, merged, round(score, 4) AS score, band,
  (sum((band = 'block')::INT) OVER (PARTITION BY t.conversation_id ORDER BY ms, message_id ROWS UNBOUNDED PRECEDING))::BIGINT AS strikes
FROM settled t JOIN decayed USING (message_id) JOIN (SELECT message_id, again, ms FROM sess) USING (message_id) LEFT JOIN (SELECT message_id, array_to_string(list_sort(list(DISTINCT type)), ',') AS crossed FROM crossed GROUP BY 1) c USING (message_id)"""
ORACLES["stateful_messages"] = sessions(source_synth()) + """
SELECT message_id, round(score, 4) AS score, CASE band WHEN 'escalate' THEN 'review' ELSE band END AS verdict, merged, round(digit_pressure, 4) AS digit_pressure,
  (sum((band = 'block')::INT) OVER (PARTITION BY t.conversation_id ORDER BY ms, message_id ROWS UNBOUNDED PRECEDING))::BIGINT AS strikes,
  coalesce(sum((band = 'block')::INT) OVER (PARTITION BY t.conversation_id, sender_role ORDER BY ms RANGE BETWEEN 600000 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS recent_blocks
FROM settled t JOIN decayed USING (message_id) JOIN (SELECT message_id, sender_role, ms FROM sess) USING (message_id)"""


def _presets() -> str:
    from saltmarsh.sources.corpus import PRESETS

    rows = ", ".join(f"({k}::BIGINT, {lit(t)}, {lit(r)}, {lit(g)}, {lit(group)})" for k, (t, group, r, g, _) in enumerate(PRESETS))
    return f"rows AS (SELECT *, 0 AS conversation_id FROM (VALUES {rows}) v(message_id, text, sender_role, booking_stage, kind))"


#: Typed apart: the techniques of the generated corpus, in order, but for split numbers.
MADE = (
    "verbatim-benchmark digit-splitting word-numbers-en word-numbers-hinglish word-numbers-devanagari noise-injection leet unicode-confusables zero-width separators mixed-form spelled-email handle-smuggling upi spoken-url "
    "shortener arithmetic-hint pure-intent extortion hostility scam-link prompt-injection"
).split()
ORACLES |= {
    "io5_io6_json_lines": f"WITH {source_techniques()} SELECT message_id::VARCHAR AS message_id, sender_role, text FROM rows",
    "io7_io8_config": """SELECT * FROM (VALUES ('bands', 'low', '2.5'), ('bands', 'high', '8.0'), ('policy', 'blockCooldownThreshold', '4.0'), ('policy', 'blockCooldownWindowMs', '600000.0'),
      ('failMode', 'pre_booking', 'open'), ('failMode', 'post_booking', 'open')) v(section, name, value)""",
    "io10_presets": cascade(_presets()) + " SELECT message_id, round(score, 6) AS score, verdict FROM scored",
    "io12_smoke": f"WITH {_presets()} SELECT text, wanted, flagged, ok, 'llm' AS source, CASE WHEN ok THEN 'cache' ELSE 'llm' END AS again, flagged = wanted AS as_wanted FROM (SELECT text, kind <> 'innocent' AS wanted, NOT contains(lower(text), 'review') AS ok, ok AND contains(lower(text), 'direct') AS flagged FROM rows)",
    "e9_corpus": f"""SELECT technique, label, count(*) AS n FROM (SELECT unnest(CASE k % 3 WHEN 0 THEN [([{listed(MADE)}])[k // 3 % 22 + 1]] WHEN 1 THEN ['split-across-messages', 'split-across-messages'] ELSE ['calm'] END) AS technique,
      CASE k % 3 WHEN 2 THEN 'negative' ELSE 'adversarial' END AS label FROM range(660) t(k)) GROUP BY ALL""",
}
