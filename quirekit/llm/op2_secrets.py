"""Secret scan: known shapes, and a randomness test battery on every long token.

Built-in functions only. Tokens of 20 characters and more are candidates. The encoding inferred from a token's
characters (hex, base32, base36 of either case, base62, base64) gives the alphabet on which three tests of uniform randomness run: chi-squared over
equal classes of the alphabet (4, 8 or 16 of them, by length), runs above and below its middle, and lag-one serial correlation. Their p-values combine
by Fisher's method; a token that this rejects is not random. For the others the probability that non-random writing
passes falls with length: the likelihood ratio of character classes under writing and under uniform draws bounds it
(Markov's inequality). A Benjamini-Hochberg procedure keeps the false-discovery rate of each document's list; its weights are the token's
length times the battery's combined p-value, so that long tokens and those the three tests agree with need less.

Defined results: a null text counts as empty and has no spans; repeated rows repeat; what base spans cover is no
candidate, what reaches beyond them by 20 characters is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import built, let, once, table
from .spans import blanked, spans, tagged

ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so the length bound inside the pattern drops what the check after it would.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?:\G|(?<![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{20,}+={0,2}+"
KINDS = ("assign", "access", "hex", "random")

#: Alphabets by inferred encoding: each character's index in it is its symbol.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base32_lower": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base36_lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_SHAPES = (
    ("hex", "^[0-9a-f]+$"),
    ("hex_upper", "^[0-9A-F]+$"),
    ("base32", "^[A-Z2-7]+$"),
    ("base32_lower", "^[a-z2-7]+$"),
    ("base36", "^[0-9A-Z]+$"),
    ("base36_lower", "^[0-9a-z]+$"),
    ("base62", "^[0-9A-Za-z]+$"),
    ("base64", "^[0-9A-Za-z+/]+$"),
    ("base64url", "^[0-9A-Za-z_-]+$"),
)
#: In writing, a character keeps its class (lower, upper, digit, other) with this probability.
KEEPS = 0.9
#: Level of the battery and of the false-discovery control.
ALPHA, FDR = 0.01, 0.01


def _upper_normal(z: Column) -> Column:
    """P(Z > z) of the standard normal, by a rational approximation (absolute error below 1e-7)."""

    def tail(a: Column) -> Column:
        poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * let(1 / (1 + 0.2316419 * a), poly)

    return let(z, lambda z: let(F.abs(z), lambda a: let(tail(a), lambda p: F.when(z >= 0, p).otherwise(1 - p))))


def _upper_chi2(x: Column, df: Column) -> Column:
    """P(X > x) of chi-squared, by the Wilson-Hilferty cube root."""
    return let(2 / (9 * df), lambda v: _upper_normal((F.pow(x / df, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v)))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_normal(F.abs(z)))


def _steps(x: Column, of) -> Column:
    """``of`` each value and the next one."""
    return F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), of)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def battery(token: Column) -> Column:
    """Struct of the encoding, the three p-values, Fisher's combination and the bound on writing passing it."""

    def of(t: Column) -> Column:
        found = F.lit(None).cast("struct<kind:string,alphabet:string>")
        for name, shape in reversed(_SHAPES):
            found = F.when(t.rlike(shape), F.struct(F.lit(name).alias("kind"), F.lit(ALPHABETS[name]).alias("alphabet"))).otherwise(found)
        return let(F.struct(t.alias("t"), found.alias("code")), measured)

    def measured(s: Column) -> Column:
        size = F.length(s["code"]["alphabet"]).cast("double")
        places = F.transform(F.split(s["t"], ""), lambda c: (F.instr(s["code"]["alphabet"], c) - 0.5) / size)
        classes = F.split(F.translate(s["t"], "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-", "l" * 26 + "u" * 26 + "d" * 10 + "oooo"), "")
        n = F.length(s["t"])
        return let(F.struct(s["code"]["kind"].alias("kind"), size.alias("size"), n.cast("double").alias("n"), F.when(n < 40, 4).when(n < 80, 8).otherwise(16).alias("k"), places.alias("u"), classes.alias("c")), counted)

    def counted(s: Column) -> Column:
        k, size = s["k"], s["size"]
        upto = lambda j: F.ceil(size * j / k - 0.5)  # symbols below class j
        share = lambda j: (upto(j + 1) - upto(j)) / size
        held = lambda j: F.size(F.filter(s["u"], lambda x: F.floor(x * k) == j))
        departs = F.transform(F.sequence(F.lit(0), k - 1), lambda j: let(s["n"] * share(j), lambda e: F.pow(held(j) - e, F.lit(2.0)) / e))
        turns = _total(_steps(s["u"], lambda a, b: F.when((a >= 0.5) != (b >= 0.5), 1.0).otherwise(0.0))) + 1
        products = _total(_steps(s["u"], lambda a, b: (a - 0.5) * (b - 0.5)))
        symbols = F.create_map(
            F.lit("l"), F.when(s["kind"] == "hex", 6.0).otherwise(26.0), F.lit("u"), F.when(s["kind"] == "hex_upper", 6.0).otherwise(26.0), F.lit("d"), F.when(s["kind"].isin("base32", "base32_lower"), 6.0).otherwise(10.0), F.lit("o"), F.lit(2.0)
        )
        # log2 of the likelihood of the class sequence under uniform draws over that under writing
        gain = let(symbols, lambda m: _total(_steps(s["c"], lambda a, b: F.log2(m[b] / size) - F.when(a == b, math.log2(KEEPS)).otherwise(math.log2((1 - KEEPS) / 3)))))
        high = F.size(F.filter(s["u"], lambda x: x >= 0.5)).cast("double")
        kept = [s[c].alias(c) for c in ("kind", "n", "k")]
        return let(F.struct(*kept, _total(departs).alias("chi"), turns.alias("runs"), high.alias("high"), (products * 12 / F.sqrt(s["n"] - 1)).alias("serial"), gain.alias("gain")), tested)

    def tested(s: Column) -> Column:
        n, mean = s["n"], 2 * s["high"] * (s["n"] - s["high"]) / s["n"] + 1
        p_runs = let(mean, lambda m: _two_sided((s["runs"] - m) / F.sqrt(F.greatest((m - 1) * (m - 2) / (n - 1), F.lit(1e-9)))))
        return let(
            F.struct(
                s["kind"].alias("kind"),
                n.cast("int").alias("n"),
                _upper_chi2(s["chi"], (s["k"] - 1).cast("double")).alias("p_chi2"),
                p_runs.alias("p_runs"),
                _two_sided(s["serial"]).alias("p_serial"),
                F.least(F.lit(1.0), F.pow(F.lit(2.0), -s["gain"])).alias("p_writing"),
            ),
            combined,
        )

    def combined(s: Column) -> Column:
        half = -sum((F.log(F.greatest(s[p], F.lit(1e-300))) for p in ("p_chi2", "p_runs", "p_serial")), F.lit(0.0))
        whole = let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))  # exact upper tail of chi-squared with six degrees of freedom
        return F.struct(*[s[k].alias(k) for k in ("kind", "n", "p_chi2", "p_runs", "p_serial", "p_writing")], whole.alias("p_random"))

    return let(F.regexp_replace(token, "=+$", ""), of)


def discoveries(found: Column) -> Column:
    """Candidates kept by weighted Benjamini-Hochberg over the tokens of one text that the battery does not reject."""
    tried = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), battery(s["m"]).alias("b")))

    def weighed(t: Column) -> Column:
        weight = lambda s: F.when(s["b"]["p_random"] >= ALPHA, s["b"]["n"] * s["b"]["p_random"]).otherwise(0.0)
        mean = F.aggregate(t, F.lit(0.0), lambda a, s: a + weight(s)) / F.size(t)
        levels = let(mean, lambda m: F.transform(t, lambda s: F.when(weight(s) > 0, s["b"]["p_writing"] * m / weight(s)).otherwise(F.lit(2.0))))

        def chosen(q: Column) -> Column:
            bound = F.aggregate(
                F.array_sort(q),
                F.struct(F.lit(0).alias("k"), F.lit(-1.0).alias("cut")),
                lambda a, x: F.struct((a["k"] + 1).alias("k"), F.when(x <= FDR * (a["k"] + 1) / F.size(t), x).otherwise(a["cut"]).alias("cut")),
                lambda a: a["cut"],
            )
            return let(bound, lambda cut: F.filter(t, lambda s, i: q[i] <= cut))

        return let(levels, chosen)

    return F.when(F.size(found) > 0, let(tried, weighed))


def _stages(text: str) -> list[Column]:
    """What ``secrets`` holds after each stage: base spans, the text without them, its tokens, and those that are random."""
    body = F.coalesce(F.col(text), F.lit(""))
    value = lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 1)) >= 6
    kept = [F.col(f"secrets.{k}").alias(k) for k in KINDS[:3]]
    known = F.concat(*[F.transform(F.col(f"secrets.{k}"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("").alias("label"))) for k in KINDS[:3]])
    return [
        F.struct(
            F.filter(spans(body, ASSIGN, body.rlike("[:=]")), value).alias("assign"),
            spans(body, ACCESS, F.contains(body, F.lit("AKIA"))).alias("access"),
            spans(body, HEX).alias("hex"),
        ),
        F.struct(*kept, blanked(body, F.sort_array(known)).alias("free")),
        F.struct(*kept, spans(F.col("secrets.free"), TOKEN).alias("token")),
        F.struct(*kept, discoveries(F.col("secrets.token")).alias("random")),
    ]


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``secrets``: struct of spans by kind; those of ``random`` carry the battery's figures."""
    for stage in built(df.sparkSession, ("secrets", text), lambda: _stages(text)):
        df = once(df, "secrets", stage)
    return df


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of ``find_secrets`` over all documents."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    label = {k: tagged(F.col(f"secrets.{k}"), k, i) for i, k in enumerate(KINDS)}
    joined = lambda *kinds: F.array_join(F.transform(F.sort_array(F.concat(*[F.coalesce(label[k], F.array().cast("array<struct<start:int,rank:int,end:int,label:string>>")) for k in kinds])), lambda s: s["label"]), ",")
    return found.select(
        "doc_id",
        *[F.size(f"secrets.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(*KINDS[:3]), 256).alias("base_sha256"),
        joined(*KINDS).alias("spans"),
        F.coalesce(F.greatest(F.size("secrets.random"), F.lit(0)), F.lit(0)).cast("long").alias("n_random"),
    )
