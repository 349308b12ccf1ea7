"""Text functions as nested built-in expressions: redaction, keyed tokens, indicator mining, number coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and their order in the compatible mode.
PII = (
    ("[ACCOUNT]", r"\b(?:ACC)?\d{9,18}\b"),
    ("[VPA]", r"\b[a-zA-Z0-9._-]{3,64}@[a-zA-Z]{2,32}\b"),
    ("[IFSC]", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("[PAN]", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("[AADHAAR]", r"\b\d{4}\s?\d{4}\s?\d{4}\b"),
    ("[PHONE]", r"\b(?:\+91[\s-]?)?[6-9]\d{9}\b"),
    ("[EMAIL]", r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b"),
    ("[CARD]", r"\b(?:\d{4}[\s-]?){3}\d{4}\b"),
    ("[IP]", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
)
#: The stricter mode takes the longer forms first, so that no end of a card or an address is left over.
STRICT = ("[CARD]", "[EMAIL]", "[AADHAAR]", "[ACCOUNT]", "[VPA]", "[IFSC]", "[PAN]", "[PHONE]", "[IP]")
# What is mined, and hosts of mail, which no payment address has.
MAIL_HOSTS = ("gmail", "yahoo", "outlook", "hotmail", "example", "android", "google", "apache", "github", "googlemail", "live", "protonmail", "icloud")
MINED = {"vpa": PII[1][1], "ipv4": PII[8][1], "ifsc": PII[2][1], "account": r"\b\d{11,18}\b", "phone": r"\b(?:\+91|91)?[6-9]\d{9}\b", "url": r"https?://[a-zA-Z0-9._~:/?#\[\]@!$&'()*+,;=%-]{4,200}"}


def redact(text: Column, strict: bool = True) -> Column:
    patterns = dict(PII)
    for mask in STRICT if strict else patterns:
        text = F.regexp_replace(text, patterns[mask], mask)
    return text


def hmac_sha256(message: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256, composed of sha2, as Spark has no keyed hash."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = F.lit(bytes(b ^ 0x36 for b in block)), F.lit(bytes(b ^ 0x5C for b in block))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def token(value: Column, key: bytes, length: int = 12) -> Column:
    return F.concat(F.lit("TKN_"), F.upper(F.substring(hmac_sha256(value, key), 1, length)))


def mine(text: Column, kind: str) -> Column:
    """Distinct matches in order; addresses only with octets up to 255 and not of the ranges 0, 127 and 255."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(MINED[kind]), F.lit(0))))
    if kind == "ipv4":
        octets = lambda x: F.transform(F.split(x, r"\."), lambda o: o.cast("int"))
        found = F.filter(found, lambda x: F.forall(octets(x), lambda o: o <= 255) & ~F.element_at(octets(x), 1).isin(0, 127, 255))
    if kind == "vpa":
        handle = lambda x: F.lower(F.substring_index(x, "@", -1))
        found = F.filter(found, lambda x: ~handle(x).isin(*MAIL_HOSTS) & F.length(handle(x)).between(3, 12))
    if kind == "account":
        # a run of digits is an account only beside a bank's code or a payment address
        found = F.when((F.size(mine(text, "ifsc")) > 0) | (F.size(mine(text, "vpa")) > 0), found).otherwise(F.array().cast("array<string>"))
    return found


def short_names(text: Column, least: int = 50) -> Column:
    """Share of class names (Lpath/Name;) of one or two characters, 0 where there are fewer than least: a mark of obfuscation."""
    names = F.regexp_extract_all(text, F.lit(r"L[a-zA-Z0-9/$_]{1,40};"), F.lit(0))
    short = F.filter(names, lambda x: F.length(F.regexp_replace(F.substring_index(x, "/", -1), ";$", "")) <= 2)
    return F.when(F.size(names) >= least, F.round(F.size(short) / F.size(names), 4)).otherwise(0.0)


# Columns that identify a person.
SENSITIVE = ("account", "customer", "src", "dst", "vpa", "src_vpa", "dst_vpa", "beneficiary", "victim", "device", "ip", "home_device", "home_ip", "beneficiary_vpa")


def redact_frame(df: DataFrame, key: bytes, columns: list[str] | None = None, drop: bool = False) -> DataFrame:
    """df with its identifying columns (those of SENSITIVE, or the given) as keyed tokens, nulls kept, or without them."""
    which = [c for c in df.columns if c in (SENSITIVE if columns is None else columns)]
    return df.drop(*which) if drop else df.withColumns({c: token(F.col(c).cast("string"), key) for c in which})


# What stands for no number.
NULLS = ("", "na", "n/a", "nan", "null", "none", "-", "#n/a")


def to_number(text: Column) -> Column:
    """A number from text with separators, percent signs and (x) for -x; null for null tokens and what is no number."""
    t = F.trim(text)
    plain = F.regexp_replace(F.regexp_replace(t, r"[,%]", ""), r"^\((.*)\)$", "-$1")
    return F.when(~F.lower(t).isin(*NULLS), plain.try_cast("double"))


def coerce_numeric(df: DataFrame, columns: list[str], least: float = 0.9) -> DataFrame:
    """Columns of text become numbers where at least that share of their filled values parses; one pass decides for all."""
    filled = {c: ~F.lower(F.trim(F.col(c))).isin(*NULLS) for c in columns}
    shares = df.agg(*((F.count(F.when(filled[c], to_number(F.col(c)))) / F.greatest(F.count_if(filled[c]), F.lit(1))).alias(c) for c in columns)).first()
    return df.select(*(to_number(F.col(c)).alias(c) if c in columns and shares[c] >= least else F.col(c) for c in df.columns))
