"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Built-in functions only. Emails, IP addresses, card numbers (Luhn) and phone numbers are the base kinds; account
numbers (IBAN, mod-97) and grouped social-security numbers that a context word supports are added by the method.

Defined results: a null text counts as empty and has no spans; rows repeat as given; every other column may be
null; columns of the input beside ``doc_id`` and ``text`` are not returned by the query and untouched by ``redacted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import built, let, once, table
from .spans import chunked, listed, piece, replaced, spans

#: The possessive forms match what the plain greedy ones do, without recursion; a match can only begin where a run
#: begins or the match before it ended, which keeps long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3}+)?+)(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: Confidence of a confirmed span without context, and the words near it that raise it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.95, "ssn": 0.4}
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": r"\bip\b|address|host|server|login|client",
    "card": "card|visa|master|amex|credit|debit|payment|pay",
    "phone": "phone|call|tel|mobile|cell|fax|sms",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security|tax",
}
#: Code points before and after a span in which context words count, and what they add.
NEAR, BOOST = 48, 0.3


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum")),
        lambda a, c: let(
            c.cast("int") * (F.lit(1) + a["i"] % 2),
            lambda d: F.struct((a["i"] + 1).alias("i"), (a["sum"] + d - F.when(d > 9, 9).otherwise(0)).alias("sum")),
        ),
        lambda a: a["sum"],
    )
    return total % 10 == 0


def mod97(m: Column) -> Column:
    """Whether an IBAN's check digits hold: letters count from 10, the first four characters go last."""
    flat = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97),
    )
    return rest == 1


def detected(text: Column) -> dict[str, Column]:
    """Confirmed spans of each kind, as arrays of (start, end, m)."""
    value = lambda m: F.regexp_replace(m, "^0+(?=.)", "")
    octet = lambda p: (F.length(value(p)) < 3) | ((F.length(value(p)) == 3) & (value(p) <= "255"))
    count = lambda s: F.length(_digits(s["m"]))
    return {
        "email": spans(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(spans(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda s: F.forall(F.split(s["m"], r"\."), octet)),
        "card": F.filter(spans(text, CARD), lambda s: (count(s) <= 19) & luhn(_digits(s["m"]))),
        "phone": F.filter(spans(text, PHONE, F.contains(text, F.lit("+"))), lambda s: count(s).between(9, 15)),
        "iban": F.filter(spans(text, IBAN, text.rlike("[A-Z][A-Z][0-9][0-9]")), lambda s: mod97(s["m"])),
        "ssn": spans(text, SSN, text.rlike("[0-9]-[0-9][0-9]-[0-9]")),
    }


def scored(chunks: Column, found: Column, kind: str) -> Column:
    """Spans with a confidence: the kind's prior, raised where a context word stands nearby, before or after."""

    def score(s: Column) -> Column:
        before, after = piece(chunks, F.greatest(s["start"] - NEAR, F.lit(0)), s["start"]), piece(chunks, s["end"], s["end"] + NEAR)
        near = F.lower(F.concat(before, F.lit("\n"), after)).rlike(CONTEXT[kind])
        return F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near, BOOST).otherwise(0.0))

    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), score(s).alias("score")))


def _stages(text: str, least: float, into: str) -> list[Column]:
    """What ``into`` holds after each stage: confirmed spans, the text's chunks beside them, and the spans with their scores."""
    body = F.coalesce(F.col(text), F.lit(""))
    some = F.greatest(*[F.size(f"{into}.{k}") for k in KINDS]) > 0
    spots = {k: scored(F.col(f"{into}.chunks"), F.col(f"{into}.{k}"), k) for k in KINDS}
    return [
        F.struct(*[v.alias(k) for k, v in detected(body).items()]),
        F.struct(*[F.col(f"{into}.{k}").alias(k) for k in KINDS], F.when(some, chunked(body)).alias("chunks")),
        F.struct(*[(v if k in BASE else F.filter(v, lambda s: s["score"] >= least)).alias(k) for k, v in spots.items()]),
    ]


def find_pii(df: DataFrame, text: str = "text", least: float = 0.5, into: str = "pii") -> DataFrame:
    """Adds ``into``: struct of scored spans by kind. Base kinds are kept whatever their score, others from ``least``."""
    for stage in built(df.sparkSession, ("pii", text, least, into), lambda: _stages(text, least, into)):
        df = once(df, into, stage)
    return df


def redacted(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """``df`` with every confirmed span of the text replaced by its kind in brackets; a null text stays null.

    Overlapping spans merge; the label is that of the first."""
    into = "__quirekit_pii"

    def clean() -> Column:
        every = [F.transform(F.col(f"{into}.{kind}"), _labelled(F.lit(f"[{kind.upper()}]"))) for kind in KINDS]
        return F.when(F.col(text).isNotNull(), replaced(F.coalesce(F.col(text), F.lit("")), F.sort_array(F.concat(*every))))

    columns = df.columns
    return find_pii(df, text, least, into).withColumn(text, built(df.sparkSession, ("redacted", text), clean)).select(*[F.col(f"`{c}`") for c in columns])


def _labelled(label: Column):
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label.alias("label"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of ``find_pii`` over all documents."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    label = {k: listed(F.col(f"pii.{k}"), k) for k in KINDS}
    base = F.concat(*[label[k] for k in BASE])
    scores = F.concat(*[F.transform(F.col(f"pii.{k}"), lambda s: s["score"]) for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*[label[k] for k in KINDS]), ",").alias("spans"),
        F.round(F.coalesce(F.array_max(scores), F.lit(0.0)), 3).alias("max_score"),
    )
