"""Personal data by weak supervision.

Patterns give candidate spans: the base kinds, which always stay where their
rule holds, and looser kinds.  Base matches that break their rule (no Luhn
check, parts over 255, too few digits) are candidates too, as are account and
identity numbers that do not check: never spans, but known negatives to learn
from.  Rule, pattern, gazetteer, context and shape labelers vote on every
candidate or abstain.  Expectation-maximisation over the counts of equal vote
patterns (a table bounded by 3^labelers x kinds) estimates each kind's share
of personal data and each labeler's reliability; the posteriors then train a
hashed log-linear span classifier on what a candidate and its neighbourhood
look like, whose verdict decides on candidates of the looser kinds that check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bagwise.llm.spans import apart, matches, place, report, scan
from bagwise.llm.weak_labels import estimate
from bagwise.session import materialize

#: Base kinds in order and their patterns.  The look-behinds
#: start a match where a run starts or the last match ended (\G), which is
#: where the leftmost match starts anyway, so long runs are read once.
BASE = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Looser kinds.
LOOSE = {
    "handle": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++"
              r"\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z]{2,24}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Madame|Monsieur)\.?\x20\p{Lu}\p{Ll}+"
            r"(?:\x20\p{Lu}\p{Ll}+)?",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}

#: Gazetteers: fixed lists.
TLDS = ["com", "org", "net", "edu", "gov", "mil", "info", "io", "biz", "de", "fr", "es", "uk", "it", "nl", "ch",
        "at", "be", "pt", "pl", "se", "no", "dk", "fi", "ie", "us", "ca", "mx", "br", "ar", "jp", "cn", "in", "au"]
COUNTRY_CODES = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46",
                 "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "64", "65", "66", "81", "82",
                 "86", "90", "91"]
IBAN_COUNTRIES = ["AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "NL", "NO", "PL", "PT", "SE"]
CUES = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "handle": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|login|address|adresse",
    "card": "card|visa|pay|credit|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|ruf|llam|appel",
    "local_phone": "phone|call|tel|mobile|fax|ruf|llam|appel",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "name": "by|contact|dear|signed|von|por|par",
    "national_id": "ssn|social|security|id|insurance",
}
COUNTER_CUES = r"(?i)(version|release|chapter|section|page|isbn|order|invoice|serial|build|part|v)\.?\x20?(no\.?|number|#)?[:\x20]*$"

HASHED = 1 << 12
SMOOTH = 1.0


def find(text: Column) -> list[Column]:
    digits = text.rlike("[0-9]{3}[\\x20.)-]")
    maybe = {"handle": text.contains("(at)") | text.contains("[at]"), "national_id": digits, "local_phone": digits}
    found = [matches(text, "email", EMAIL, context=True, maybe=text.contains("@")),
             matches(text, "ip", IP, context=True), matches(text, "card", CARD, context=True),
             matches(text, "phone", PHONE, context=True, maybe=text.contains("+"))]
    return found + [matches(text, k, p, context=True, maybe=maybe.get(k)) for k, p in LOOSE.items()]


def digits_of(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum"))

    def step(s, c):
        d = c.cast("int") * F.when(s["i"] % 2 == 1, 2).otherwise(1)
        return F.struct((s["i"] + 1).alias("i"), (s["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"))

    return F.aggregate(F.split(F.reverse(digits), ""), start, step)["sum"] % 10 == 0


def iban_checks(token: Column) -> Column:
    """Whether the digits of an IBAN, letters as 10 to 35, are 1 modulo 97."""
    plain = F.upper(F.regexp_replace(token, "\x20", ""))
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def step(rest, c):
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(v < 10, rest * 10 + v).otherwise(rest * 100 + v) % 97

    return F.aggregate(turned, F.lit(0), step) == 1


def base_holds() -> Column:
    """The rule of each base kind on its match."""
    token, digits = F.col("token"), digits_of(F.col("token"))
    octets = F.transform(F.split(token, "\\."), lambda p: p.try_cast("bigint"))
    n = F.length(digits)
    return (F.when(F.col("kind") == "email", F.lit(True))
            .when(F.col("kind") == "ip", F.coalesce(F.array_max(F.transform(octets, lambda p: F.coalesce(p, F.lit(999)))) <= 255,
                                                     F.lit(False)))
            .when(F.col("kind") == "card", F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False)))
            .when(F.col("kind") == "phone", n.between(9, 15)).otherwise(F.lit(True)))


def votes() -> dict[str, Column]:
    """Labeler: 1 (personal), 0 (not) or null (abstains)."""
    kind, token = F.col("kind"), F.col("token")
    digits, n = digits_of(token), F.length(digits_of(token))
    tld = F.lower(F.regexp_extract(token, "([A-Za-z]+)$", 1))
    is_ = lambda *names: kind.isin(*names)
    yes = lambda c: F.when(c, 1).otherwise(0)
    pattern = (F.when(is_("email", "handle"), yes(tld.rlike("^[a-z]{2,24}$") & token.rlike("^[^@]*[A-Za-z]")))
               .when(is_("ip"), yes(~token.rlike("(^|\\.)0[0-9]") & ~token.rlike("^0\\.")))
               .when(is_("card"), yes(token.rlike("^[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}$")))
               .when(is_("phone", "local_phone"), yes(n.between(10, 15)))
               .when(is_("iban"), yes(token.rlike("^[A-Z]{2}[0-9 ]+$"))).when(is_("name"), F.lit(1)))
    country = F.regexp_extract(token, "^\\+([0-9]{1,3})", 1)
    codes = reduce(lambda a, b: a | b, [F.substring(country, 1, i).isin(*COUNTRY_CODES) for i in (1, 2)])
    gazetteer = (F.when(is_("email", "handle"), F.when(tld.isin(*TLDS), 1))
                 .when(is_("phone"), yes(codes))
                 .when(is_("card"), yes(F.substring(digits, 1, 1).isin("3", "4", "5", "6")))
                 .when(is_("ip"), F.when(token.rlike("^(127|0|255)\\."), 0))
                 .when(is_("iban"), yes(F.substring(token, 1, 2).isin(*IBAN_COUNTRIES)))
                 .when(is_("name"), F.lit(1)))
    cue = F.create_map(*[F.lit(x) for k, c in CUES.items() for x in (k, f"(?i)(?<![a-z])({c})")])[kind]
    context = F.when(F.col("context").rlike(COUNTER_CUES), 0).when(F.regexp_like("context", cue), 1)
    glued = F.col("context").rlike("[A-Za-z0-9]$")
    shape = F.when(glued, 0).when(F.col("context") == "", F.lit(None)).otherwise(1)
    rule = (F.when(is_(*BASE), yes(base_holds())).when(is_("iban"), yes(iban_checks(token)))
            .when(is_("national_id"), yes(~token.rlike("^(000|666|9)") & ~token.rlike("-00-|-0000$"))))
    return {k: v.cast("int") for k, v in
            {"rule": rule, "pattern": pattern, "gazetteer": gazetteer, "context": context, "shape": shape}.items()}


def features() -> Column:
    """Hashed features of a candidate that has its votes."""
    kind, token = F.col("kind"), F.col("token")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    last = F.lower(F.regexp_extract("context", "(\\p{L}+)\\P{L}*$", 1))
    cues = F.when(F.col("v_context") == 1, "for").when(F.col("v_context") == 0, "against").otherwise("none")
    held = F.coalesce(F.col("v_pattern").cast("string"), F.lit("?"))
    # Without the kind in their names, features learn from all kinds at once.
    named = [kind, F.concat(F.lit("cues|"), cues), F.concat(F.lit("last|"), last), F.concat(F.lit("held|"), held),
             F.concat(kind, F.lit("|cues|"), cues), F.concat(kind, F.lit("|held|"), held),
             F.concat(kind, F.lit("|shape|"), shape), F.concat(kind, F.lit("|last|"), last),
             F.concat(kind, F.lit("|size|"), F.floor(F.length(token) / 4).cast("string")),
             F.concat(kind, F.lit("|digits|"), F.length(digits_of(token)).cast("string")),
             F.concat(kind, F.lit("|glued|"), F.col("context").rlike("[A-Za-z0-9]$").cast("string"))]
    return F.array(*[F.pmod(F.xxhash64(f), F.lit(HASHED)).cast("int") for f in named])


def classify(candidates: DataFrame) -> DataFrame:
    """Candidates with ``posterior`` (labelers) and ``score`` (classifier)."""
    labelers = votes()
    voted = materialize(candidates.withColumns({f"v_{k}": v for k, v in labelers.items()}).withColumn("f", features()))
    names = [f"v_{k}" for k in labelers]
    # At most 3^labelers vote patterns of each kind.
    counted = voted.groupBy("kind", *names).agg(F.count(F.lit(1)).alias("n")).collect()
    votes_of = [(r["kind"], tuple(r[n] for n in names), r["n"]) for r in counted]
    post = estimate(votes_of, never={(k, v) for k, v, _ in votes_of if v[names.index("v_rule")] == 0})
    if not post:
        return voted.withColumn("posterior", F.lit(0.0)).withColumn("score", F.lit(0.0))
    pattern = F.concat_ws("|", "kind", *[F.coalesce(F.col(n).cast("string"), F.lit("?")) for n in names])
    key = {"|".join([k, *("?" if x is None else str(x) for x in v)]): p for (k, v), p in post.items()}
    voted = voted.withColumn("posterior", F.create_map(*[F.lit(x) for kp in key.items() for x in kp])[pattern])
    both = voted.select(F.explode("f").alias("f"), F.col("posterior").alias("p")).groupBy("f").agg(
        F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    every = Window.partitionBy()  # over HASHED rows at most
    # One row per hashed feature (HASHED at most), so the weights fit any task.
    even = F.lit(SMOOTH / HASHED)
    weights = both.withColumns({"y": F.sum("yes").over(every) + SMOOTH, "n": F.sum("no").over(every) + SMOOTH})
    weights = weights.select("f", F.struct("f", (F.log((F.col("yes") + even) / F.col("y"))
                                            - F.log((F.col("no") + even) / F.col("n"))).alias("w")).alias("fw"), "y", "n")
    table = weights.agg(F.map_from_entries(F.collect_list("fw")).alias("w"),
                        F.first(F.log(F.col("y") / F.col("n"))).alias("prior"),
                        F.min(F.pmod("f", F.lit(1))).cast("long").alias("zero"))
    # One row, joined on a key that is 0 on both sides.
    scored = voted.withColumn("zero", F.pmod("row", F.lit(1))).join(F.broadcast(table), "zero")
    total = F.aggregate("f", F.col("prior"), lambda s, f: s + F.coalesce(F.col("w")[f], F.lit(0.0)))
    return scored.withColumn("score", total).drop("zero", "w", "prior")


def find_personal_data(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scanned texts, spans).  Spans: row, kind, start, end; the base kinds
    and those of LOOSE that the classifier accepts, apart from base spans."""
    scanned = scan(docs, find)
    judged = classify(place(scanned).select("row", "kind", "start", "end", "token", "context"))
    base = judged.where(F.col("kind").isin(*BASE) & (F.col("v_rule") == 1)).select("row", "kind", "start", "end")
    holds = F.coalesce(F.col("v_rule"), F.lit(1)) == 1
    loose = judged.where(~F.col("kind").isin(*BASE) & holds & (F.col("score") > 0))
    return scanned, base.unionByName(apart(loose.select("row", "kind", "start", "end"), base))


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone,
    base_sha256, spans.

    A null or empty text has no spans (base_sha256 is that of the empty
    string).  Repeated rows are scanned and counted each; doc_id may be null;
    an empty table gives an empty result; other columns are not read."""
    scanned, spans = find_personal_data(docs)
    return report(scanned, spans, BASE)
