"""Detectors: each takes text views and gives an array of detections (type, start, end, confidence, evidence).

Terms of a lexicon are looked for on whole words; hits that overlap only in part all count. Detectors give places in the view that they read;
with_detections() turns them into places in the message. All offsets count code points.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh import lexicons as lex
from saltmarsh.config import RiskConfig
from saltmarsh.functions.normalize import raw_place
from saltmarsh.functions.digitruns import placed
from saltmarsh.functions.spans import DETECTION, alternation, ascii_words, best_per_span, detection, empty, constants, inside_any, let, located, looked_up, moved, one_of, terms_in

# Shapes of numbers, and the patterns of the detectors.
MOBILE, PREFIXED, POSTAL = r"^[6-9][0-9]{9}$", r"^91[6-9][0-9]{9}$", r"^[1-8][0-9]{5}$"
EMAIL = ascii_words(r"(?i)\b[a-z0-9._%+-]{1,64}@[a-z0-9.-]{1,255}\.[a-z]{2,24}\b")
AT = r"(?:@|\(\s*at\s*\)|\[\s*at\s*\]|\{\s*at\s*\}|\s+at\s+the\s+rate(?:\s+of)?\s+|\s+at\s+|\s*_at_\s*|\s*-at-\s*|\s+attherate\s+)"
DOT = r"(?:\.|\(\s*dot\s*\)|\[\s*dot\s*\]|\{\s*dot\s*\}|\s+d\s*o\s*t\s+|\s*_dot_\s*|\s*-dot-\s*)"
SPELLED_EMAIL = ascii_words(rf"(?i)\b([a-z0-9._%+-]{{2,64}}(?:{DOT}[a-z0-9._%+-]{{1,64}})?)\s*{AT}\s*([a-z0-9-]{{2,64}})\s*{DOT}\s*([a-z]{{2,24}})\b")
LABEL = r"[a-z0-9¡-￿](?:[a-z0-9¡-￿-]*[a-z0-9¡-￿])?"
URL = ascii_words(rf"(?i)\b(?:https?://|www\.)?({LABEL}(?:\.{LABEL})+)(/[^\s]*)?")
SPOKEN_URL = ascii_words(r"(?i)\b([a-z0-9-]{2,32})\s+dot\s+([a-z]{2,24})\b(?:\s+slash\s+([a-z0-9_.-]{1,64}))?")
SCRIPTS = ["IsLatin", "IsCyrillic", "IsGreek", "IsDevanagari", "IsArabic", "IsHan"]
MENTION = ascii_words(r"(?i)(?<![A-Za-z0-9_.])@([a-z0-9._]{3,30})\b")
PLATFORM = ascii_words(
    r"(?i)\b(insta|instagram|ig|telegram|tg|whatsapp|wsp|snapchat|snap|facebook|fb|discord|signal|twitter)\b\s*(?:id|handle|username|user|is|at|:|-|=)*\s*@?([a-z0-9._]{3,30})\b"
)
PLATFORMS = ascii_words(
    r"(?i)\b(?:insta|instagram|ig|igdm|telegram|tg|tele|whatsapp|whats\s?app|wsp|wapp|watsapp|snapchat|snap|sc|facebook|fb|messenger|twitter|x|discord|signal)\b"
)
NAME_POINTER = ascii_words(
    r"(?i)\b(?:(?:handle|username|user\s*id|id|name)\s+(?:is\s+)?(?:the\s+)?same\s+as\s+my\s+[A-Za-z0-9_]+|same\s+(?:handle|username|id|name)\s+as"
    r"|(?:handle|username|id)\s+is\s+my\s+name|search\s+(?:for\s+)?my\s+name\s+on|find\s+me\s+by\s+my\s+name)\b"
)
VPA = ascii_words(r"(?i)\b([A-Za-z0-9_.\-]{3,64})@([a-z]{2,20})\b(?!\.)")
QUESTION = ascii_words(
    r"(?i)\b(?:what(?:'?s| is)|which|where|how many|how long|can i get|could i get|do you have|is there|may i|please send|could you send|can you send|mentioned|forgot|lost|edited?|by mistake)\b"
)
MOVE = ascii_words(
    r"\b(?:chat|chatting|talk|talking|speak|speaking|text|texting|message|messaging|msg|connect|continue|move|switch|shift|take (?:this|it)|do (?:this|it))\b"
)
REPORTED = ascii_words(
    r"\b(?:someone|somebody|a stranger|another guest|another host|some guy|this guy|scammer|fraudster)\b|\bi (?:got|received|had)\b|\bclaiming to be\b|\bpretending to be\b"
    r"|\b(?:was|were|had been) (?:messaged|texted|contacted|called)\b"
)
AIMED = ascii_words(
    r"(?i)\b(?:you|your|ur|u|yours|urself|yourself|thou)\b(?:\s+(?:are|is|r|were|was|being|such|a|an|so|absolute|total|complete|fucking|bloody|damn))*\s*$"
)
_MASKED = [
    (r"f(?:[^a-z0-9\s]|[uc]){1,3}k(?:[^a-z0-9\s]?(?:ing|in|er|ed|s))?", 2), (r"s(?:[^a-z0-9\s]|h){1,2}[^a-z0-9\s]?t(?:ty|s)?", 0), (r"b(?:[^a-z0-9\s]|i){1,2}tch(?:es)?", 2),
    (r"a[^a-z0-9\s]{2}hole", 2), (r"c(?:[^a-z0-9\s]|u){1,2}nt", 2),
]
MASKED = [(ascii_words(rf"(?i)\b{p}\b"), level) for p, level in _MASKED]
#: Where any of them is.
ANY_MASKED = ascii_words(rf"(?i)(?=[fsbac])\<(?:{'|'.join(p for p, _ in _MASKED)})\b")
CHANNEL = ascii_words(r"\b(?:" + "|".join(lex.INTENT_CHANNEL) + r")\b")
#: Calling codes by their plan: zones of one digit, codes of two, and tens of codes of three; then a number that doesn't begin with 0.
INTERNATIONAL = (
    "^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[7-9][0-9]|8[058][0-9]|9[679][0-9])[1-9][0-9]{7,}$"
)
#: A date at the beginning of a number.
DATED = "^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])"
CONTEXT, MOVE_REACH, AIM_REACH, THREAT_REACH = 24, 40, 16, 160
INTENT_CONFIDENCE = {"intent.channel": 0.7, "intent.contact": 0.8, "intent.offplatform": 0.9, "intent.payment": 0.75}
#: Words before a long number that say what it is.
EXPLAINING = r"(?i)(?:^|[^a-z])(?:ref|reference|booking|order|invoice|pnr|gst|ticket|tracking|id|txn|transaction|account|confirmation)(?:$|[^a-z])"
BENIGN = "(?i)(?:^|[^a-z])(?:" + "|".join(lex.BENIGN_CONTEXT_TERMS) + ")(?:$|[^a-z])"


def _group(hit: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(hit["match"], pattern, k)


def _before(text: Column, hit: Column, reach: int) -> Column:
    start = F.greatest(hit["start"] - reach, F.lit(0))
    return F.substring(text, start + 1, hit["start"] - start)


def _after(text: Column, hit: Column, reach: int) -> Column:
    return F.substring(text, hit["end"] + 1, F.lit(reach))


def obfuscated(run: Column, signals: Column) -> Column:
    """signals: whether the message as a whole hides something (noise digits, invisible or confusable characters)."""
    return run["mixed"] | (run["word_n"] > 0) | signals | F.exists(run["seps"], lambda s: ~s.isin("none", "space"))


def _raw(run: Column) -> Column:
    """A run as a hit in the message."""
    return F.struct(run["raw_start"].alias("start"), run["raw_end"].alias("end"), run["digits"].alias("match"))


def phones(runs: Column, text: Column, signals: Column) -> Column:
    """Full and partial numbers of the runs, placed in the message; text is the view that the runs come from."""

    def one(r: Column) -> Column:
        n, hidden = F.length(r["digits"]), obfuscated(r, signals)
        bump = F.when(r["mixed"], 0.04).when(r["word_n"] > 0, 0.02).otherwise(0.0)
        sure = F.least(F.lit(0.99), F.lit(0.95) + bump)
        kind = F.when(hidden, "contact.phone.obfuscated").otherwise("contact.phone")
        benign = (
            F.concat(_before(text, r, CONTEXT), r["digits"], _after(text, r, CONTEXT)).rlike(BENIGN)
            | _before(text, r, 3).rlike(r"(?i)[a-z]\s?$") | _after(text, r, 3).rlike(r"(?i)^\s?[a-z]")
        )
        part = n.between(5, 9) & (hidden | ~(r["digits"].rlike(POSTAL) | benign))
        # without tables of national plans: a calling code, a length that plans have, and nothing beside it that explains a long number
        abroad = n.between(11, 13) & r["digits"].rlike(INTERNATIONAL) & ~r["digits"].rlike(DATED) & (hidden | ~(_before(text, r, CONTEXT).rlike(EXPLAINING)))
        at = _raw(r)
        return (
            F.when(r["digits"].rlike(MOBILE), detection(kind, at, sure, F.lit("mobile of ten digits")))
            .when(r["digits"].rlike(PREFIXED), detection(kind, at, sure, F.lit("mobile behind its country code")))
            .when(abroad, detection(kind, at, F.lit(0.8), F.lit("calling code and length of a number")))
            .when(part, detection("contact.phone.partial", at, F.least(F.lit(0.6), 0.2 + n / 10 * 0.4), F.concat(n.cast("string"), F.lit(" digits"))))
        )

    return F.filter(F.transform(runs, one), lambda d: d.isNotNull())


def emails(folded: Column) -> Column:
    def spelled(h: Column) -> Column:
        swapped = ~F.trim(h["match"]).rlike(r"^[^\s@]+@[^\s@]+$")
        known = one_of(F.lower(_group(h, SPELLED_EMAIL, 2)), lex.EMAIL_DOMAINS)
        kind = F.when(swapped, "contact.email.obfuscated").otherwise("contact.email")
        return detection(kind, h, F.when(known, 0.96).when(swapped, 0.9).otherwise(0.93), F.trim(h["match"]))

    def with_spelled(plain: Column) -> Column:
        more = F.transform(located(folded, SPELLED_EMAIL), spelled)
        return F.concat(plain, F.filter(more, lambda d: ~F.exists(plain, lambda p: (p["start"] == d["start"]) & (p["end"] == d["end"]))))

    plain = F.when(folded.contains("@"), F.transform(located(folded, EMAIL), lambda h: detection("contact.email", h, 0.97))).otherwise(empty(DETECTION))
    return F.when(folded.rlike("@|at") & folded.rlike(r"\.|d\s*o\s*t"), let(plain, with_spelled)).otherwise(empty(DETECTION))


def _of_domains(host: Column, domains: Iterable[str]) -> Column:
    return F.arrays_overlap(F.array(host, *[F.substring_index(host, ".", -k) for k in (2, 3, 4)]), constants(domains))


def _hostname(host: Column) -> Column:
    last = F.substring_index(host, ".", -1)
    return host.contains(".") & (F.length(last) >= 2) & ~last.rlike("^[0-9]+$")


def classified(host: Column) -> Column:
    """Kind and confidence of a hostname."""
    last = F.substring_index(host, ".", -1)
    kinds = [
        (_of_domains(host, lex.MESSENGER_DOMAINS), "contact.url.messenger", 0.97), (_of_domains(host, lex.SHORTENERS), "contact.url.shortener", 0.8),
        (_of_domains(host, lex.PAYMENT_DOMAINS), "contact.url.payment", 0.9), (one_of(last, lex.RISKY_TLDS), "contact.url.risky_tld", 0.7),
    ]
    as_struct = lambda name, sure: F.struct(F.lit(name).alias("kind"), F.lit(sure).alias("sure"))
    out = as_struct("contact.url", 0.6)
    for condition, name, sure in reversed(kinds):
        out = F.when(condition, as_struct(name, sure)).otherwise(out)
    return out


def _hosted(hits: Column, host_of) -> Column:
    """Hits with their hosts, of those that have one."""
    held = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["match"].alias("match"), F.lower(host_of(h)).alias("host")))
    return F.filter(held, lambda h: _hostname(h["host"]))


def urls(folded: Column, allowlist: tuple[str, ...] = ()) -> Column:
    """Links by class, those that are spoken too, and numbers in links to messengers."""
    allowed = lambda host: host.isin(*allowlist) if allowlist else F.lit(False)

    def number(h: Column) -> Column:
        digits = F.filter(F.regexp_extract_all(_group(h, URL, 2), F.lit("[0-9]{10,15}"), F.lit(0)), lambda d: (F.length(d) >= 11) | d.rlike(MOBILE))
        return detection("contact.phone", h, 0.96, F.try_element_at(digits, F.lit(1)))

    def of_links(found: Column) -> Column:
        plain = F.transform(F.filter(found, lambda h: ~allowed(h["host"])), lambda h: let(classified(h["host"]), lambda c: detection(c["kind"], h, c["sure"], h["host"])))
        messengers = F.filter(found, lambda h: _group(h, URL, 2).rlike("[0-9]{10}") & _of_domains(h["host"], lex.MESSENGER_DOMAINS))
        return F.concat(plain, F.filter(F.transform(messengers, number), lambda d: d["evidence"].isNotNull()))

    def said(h: Column) -> Column:
        return let(classified(h["host"]), lambda c: detection(c["kind"], h, F.least(F.lit(0.95), c["sure"] + 0.05), F.trim(h["match"])))

    links = F.when(folded.contains("."), let(_hosted(located(folded, URL), lambda h: _group(h, URL, 1)), of_links)).otherwise(empty(DETECTION))
    spoken = _hosted(located(folded, SPOKEN_URL), lambda h: F.concat_ws(".", _group(h, SPOKEN_URL, 1), _group(h, SPOKEN_URL, 2)))
    spoken = F.transform(F.filter(spoken, lambda h: ~allowed(h["host"])), said)
    return F.concat(links, F.when(folded.rlike(r"\sdot\s"), spoken).otherwise(empty(DETECTION)))


def homographs(nfkc: Column) -> Column:
    """Links whose host has letters of more than one script."""
    scripts = lambda host: sum((host.rlike(rf"\p{{{s}}}").cast("int") for s in SCRIPTS), F.lit(0))
    mixed = F.filter(_hosted(located(nfkc, URL), lambda h: _group(h, URL, 1)), lambda h: scripts(h["host"]) > 1)
    return F.when(nfkc.rlike(r"[^\x00-\x7F]"), F.transform(mixed, lambda h: detection("contact.url.homograph", h, 0.9, h["host"]))).otherwise(empty(DETECTION))


def handles(folded: Column) -> Column:
    named = F.filter(located(folded, MENTION), lambda h: ~F.lower(_group(h, MENTION, 1)).rlike(r"\.[a-z]{2,}$"))
    mentions = F.transform(named, lambda h: detection("contact.handle", h, 0.85, F.lower(h["match"])))
    mentions = F.when(folded.contains("@"), mentions).otherwise(empty(DETECTION))

    def of_platforms(hits: Column) -> Column:
        name_of = lambda h: F.lower(_group(h, PLATFORM, 2))
        digits = lambda h: F.regexp_replace(name_of(h), "[^0-9]", "")
        found = F.filter(hits, lambda h: ~one_of(name_of(h), lex.NOT_A_HANDLE))
        inside = F.filter(found, lambda h: F.length(digits(h)) >= 4)
        return F.concat(F.transform(found, lambda h: detection("contact.handle", h, 0.9, name_of(h))), F.transform(inside, lambda h: detection("contact.handle.embedded_digits", h, 0.8, digits(h))))

    pointers = F.transform(located(folded, NAME_POINTER), lambda h: detection("contact.handle.implicit", h, 0.75, F.trim(h["match"])))
    return F.concat(mentions, let(located(folded, PLATFORM), of_platforms), pointers)


def handle_runs(folded: Column, runs: Column) -> Column:
    """Runs in a text that names a platform, placed in the message."""
    long_runs = F.filter(runs, lambda r: F.length(r["digits"]) >= 4)
    beside = F.transform(long_runs, lambda r: detection("contact.handle.embedded_digits", _raw(r), F.when(r["mixed"], 0.88).otherwise(0.75), r["digits"]))
    return F.when((F.size(runs) > 0) & folded.rlike(PLATFORMS), beside).otherwise(empty(DETECTION))


def upis(folded: Column) -> Column:
    local, psp = (lambda h: F.lower(_group(h, VPA, 1))), (lambda h: F.lower(_group(h, VPA, 2)))
    found = F.filter(located(folded, VPA), lambda h: one_of(psp(h), lex.UPI_PSP_HANDLES))
    rails = F.transform(found, lambda h: detection("payment.upi", h, 0.95, F.lower(h["match"])))
    numbers = F.transform(F.filter(found, lambda h: local(h).rlike(MOBILE)), lambda h: detection("contact.phone", h, 0.95, local(h)))
    return F.when(folded.contains("@"), F.concat(rails, numbers)).otherwise(empty(DETECTION))


def addresses(deleet: Column) -> Column:
    codes = F.transform(terms_in(deleet, lex.ACCESS_TERMS), lambda h: detection("contact.address.access_code", h, 0.85))
    places = F.transform(terms_in(deleet, lex.ADDRESS_TERMS), lambda h: detection("contact.address", h, 0.75))
    return F.when(deleet.rlike(QUESTION), empty(DETECTION)).otherwise(F.concat(codes, places))


def _by_term(lists: dict[str, Iterable[str]]) -> dict[str, str]:
    """The first list that has a term names it."""
    out: dict[str, str] = {}
    for tag, terms in lists.items():
        for t in terms:
            out.setdefault(t, tag)
    return out


INTENT_TERMS = _by_term({"intent.channel": lex.INTENT_CHANNEL, "intent.contact": lex.INTENT_ACTION, "intent.offplatform": lex.INTENT_OFFPLATFORM, "intent.payment": lex.INTENT_PAYMENT})


def intents(deleet: Column) -> Column:
    # a benign phrase needs no boundary, so that its inflections count as well
    benign = terms_in(deleet, lex.INTENT_NEGATIVE_CONTEXT, whole=False)

    def listed(calm: Column) -> Column:
        hits = F.filter(terms_in(deleet, INTENT_TERMS), lambda h: ~inside_any(h, calm))
        named = F.transform(hits, lambda h: let(looked_up(INTENT_TERMS, h["match"]), lambda t: detection(t, h, _tagged_confidence(t))))
        channel = F.slice(located(deleet, CHANNEL), 1, 1)
        moves = F.filter(channel, lambda h: _before(deleet, h, MOVE_REACH).rlike(MOVE) & ~deleet.rlike(REPORTED) & ~inside_any(h, calm))
        proposed = F.transform(moves, lambda h: detection("intent.offplatform", h, 0.85))
        return let(named, lambda all_: F.when(F.exists(all_, lambda d: d["type"] == "intent.offplatform"), all_).otherwise(F.concat(all_, proposed)))

    return F.when(deleet.rlike(alternation(INTENT_TERMS) + "|" + CHANNEL), let(benign, listed)).otherwise(empty(DETECTION))


def _tagged_confidence(kind: Column) -> Column:
    return looked_up({k: str(v) for k, v in INTENT_CONFIDENCE.items()}, kind).cast("double")


HOSTILE = _by_term({"0": lex.HOSTILITY_MILD, "1": lex.HOSTILITY_SEV1, "2": lex.HOSTILITY_SEV2, "3": lex.HOSTILITY_SEV3})


def hostility(deleet: Column) -> Column:
    aimed = lambda h: _before(deleet, h, AIM_REACH).rlike(AIMED)

    def rated(h: Column, severity: Column, listed: bool) -> Column:
        level = F.when((severity == "0") & aimed(h), F.lit("2")).otherwise(severity)
        sure = F.when(level == "3", 0.95).when(level == "2", 0.9 if listed else 0.85).when(level == "1", 0.7).otherwise(0.4)
        return detection(F.concat(F.lit("safety.hostility.sev"), level), h, sure)

    words = F.transform(terms_in(deleet, HOSTILE), lambda h: rated(h, looked_up(HOSTILE, h["match"]), True))

    def with_masked(known: Column) -> Column:
        more = [F.transform(F.slice(located(deleet, p), 1, 1), _rater(rated, level)) for p, level in MASKED]
        return F.when(deleet.rlike(ANY_MASKED), F.concat(known, F.filter(F.concat(*more), lambda d: ~F.exists(known, lambda k: (k["start"] <= d["start"]) & (k["end"] > d["start"]))))).otherwise(known)

    return let(words, with_masked)


def _rater(rated, level: int):
    return lambda h: rated(h, F.lit(str(level)), False)


THREAT = _by_term({"demand": lex.EXTORTION_DEMAND, "condition": lex.EXTORTION_CONDITIONAL, "leverage": lex.EXTORTION_LEVERAGE})
SCAM = _by_term({"urgency": lex.SCAM_URGENCY, "payment": lex.SCAM_PAYMENT, "too_good": lex.SCAM_TOO_GOOD})


def extortion(deleet: Column) -> Column:
    """Leverage near a demand, a condition, or both: an interval join within the message."""
    apart = lambda a, b: F.greatest(b["start"] - a["end"], a["start"] - b["end"], F.lit(0))
    near = lambda others, h: F.try_element_at(F.filter(others, lambda o: apart(o, h) <= THREAT_REACH), F.lit(1))

    def judge(hits: Column) -> Column:
        of = lambda tag: F.filter(hits, lambda h: looked_up(THREAT, h["match"]) == tag)

        def one(h: Column) -> Column:
            def told(x: Column) -> Column:
                full = x["demand"].isNotNull() & x["condition"].isNotNull()
                other = F.when(full | x["demand"].isNull(), x["condition"])
                words = F.concat_ws(" + ", x["demand"]["match"], other["match"], h["match"])
                span = F.struct(F.least(h["start"], x["demand"]["start"], other["start"]).alias("start"), F.greatest(h["end"], x["demand"]["end"], other["end"]).alias("end"), words.alias("match"))
                some = x["demand"].isNotNull() | x["condition"].isNotNull()
                return F.when(some, detection(F.when(full, "safety.extortion").otherwise("safety.extortion.implied"), span, F.when(full, 0.95).otherwise(0.75)))

            return let(F.struct(near(of("demand"), h).alias("demand"), near(of("condition"), h).alias("condition")), told)

        return F.filter(F.transform(of("leverage"), one), lambda d: d.isNotNull())

    return F.when(deleet.rlike(alternation(lex.EXTORTION_LEVERAGE)), let(terms_in(deleet, THREAT), judge)).otherwise(empty(DETECTION))


def scam_links(deleet: Column, links: Column) -> Column:
    """Links beside words of urgency, payment or too good an offer, by how many of these there are."""
    cues = F.size(F.array_distinct(F.transform(terms_in(deleet, SCAM), lambda h: looked_up(SCAM, h["match"]))))
    found = let(cues, lambda n: F.when(n > 0, F.transform(links, lambda u: detection("safety.scamlink", u, F.least(F.lit(0.93), 0.6 + n * 0.12), u["evidence"]))).otherwise(empty(DETECTION)))
    return F.when(F.size(links) > 0, found).otherwise(empty(DETECTION))


#: Detectors by name: the view whose places they give (None: the message's own), and a function of the views' columns and the configuration.
REGISTRY = {
    "phone": (None, lambda c: phones(F.col("runs"), F.col("denoised"), (F.col("noise") > 0) | (F.col("zero_width") > 0) | (F.col("confusables") > 0))),
    "email": ("folded", lambda c: emails(F.col("folded"))),
    "url": ("folded", lambda c: urls(F.col("folded"), c.allowlist)),
    "homograph": ("nfkc", lambda c: homographs(F.col("nfkc"))),
    "handle": ("folded", lambda c: handles(F.col("folded"))),
    "handle_run": (None, lambda c: handle_runs(F.col("folded"), F.col("runs"))),
    "upi": ("folded", lambda c: upis(F.col("folded"))),
    "address": ("folded", lambda c: addresses(F.col("deleet"))),
    "intent": ("folded", lambda c: intents(F.col("deleet"))),
    "hostility": ("folded", lambda c: hostility(F.col("deleet"))),
    "extortion": ("folded", lambda c: extortion(F.col("deleet"))),
}


@cache
def _column(name: str, allowlist: tuple[str, ...]) -> Column:
    """A detector's expression, made once: it is of many parts, and hangs on names of columns alone."""
    return REGISTRY[name][1](RiskConfig(allowlist=allowlist)).cast(DETECTION)


def with_detections(df: DataFrame, config: RiskConfig | None = None, names: Iterable[str] | None = None) -> DataFrame:
    """Adds detections to rows with views, places and runs (see normalize.with_views): the union of the detectors, one per type and span,
    with places in the message."""
    config = config or RiskConfig()
    names = list(REGISTRY if names is None else names)
    df = df.withColumn("runs", placed(F.col("runs"), raw_place))
    df = df.withColumns({f"__{n}": _column(n, config.allowlist) for n in names})
    views = {n: REGISTRY[n][0] for n in names}
    if "url" in names:
        df = df.withColumn("__scamlink", scam_links(F.col("deleet"), F.concat(*[F.col(f"__{n}") for n in ("url", "homograph") if n in names])).cast(DETECTION))
        views["scamlink"] = "folded"
    raw = {"folded": ("starts", "ends"), "nfkc": ("nfkc_starts", "nfkc_ends")}
    parts = [F.col(f"__{n}") if v is None else moved(F.col(f"__{n}"), *[F.col(f"raw_at.{k}") for k in raw[v]]) for n, v in views.items()]
    return df.withColumn("detections", best_per_span(F.concat(*parts))).drop(*[f"__{n}" for n in views])
