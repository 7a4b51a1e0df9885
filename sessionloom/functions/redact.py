"""Redaction of credentials in a fixed order, with a count of what was replaced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[REDACTED]"

# Fixed values: (family, pattern, replacement), in the order in which they are applied.
FAMILIES = (
    ("private_key", r"(?s)-----BEGIN[ A-Z]*PRIVATE KEY-----.*?-----END[ A-Z]*PRIVATE KEY-----", MARK),
    ("auth_header", r"(?iU)\b(authorization|proxy-authorization)\s*:\s*\S+(?:[ \t]+\S+)?", f"$1: {MARK}"),
    ("cookie", r"(?iU)\b(set-cookie|cookie)\s*:\s*\S+", f"$1: {MARK}"),
    (
        "key_value",
        r"(?iU)\b(api[-_]?key|apikey|access[-_]?token|refresh[-_]?token|auth[-_]?token|client[-_]?secret|secret[-_]?key|token|secret|password|passwd|pwd|passphrase)"
        r"(\"?\s*[=:]\s*\"?)([^\s\"',;&)}\]]{4,})",
        f"$1$2{MARK}",
    ),
    ("sk_ant", r"(?U)\bsk-ant-[A-Za-z0-9_\-]{12,}", MARK),
    ("sk", r"(?U)\bsk-[A-Za-z0-9_\-]{16,}", MARK),
    ("github", r"(?U)\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}", MARK),
    ("github_pat", r"(?U)\bgithub_pat_[A-Za-z0-9_]{20,}", MARK),
    ("slack", r"(?U)\bxox[baprs]-[A-Za-z0-9-]{10,}", MARK),
    ("aws", r"(?U)\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", MARK),
    ("google", r"(?U)\bAIza[0-9A-Za-z_\-]{30,}", MARK),
    ("jwt", r"(?U)\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}", MARK),
)
#: Lower-case texts of which every match of a family has one: a cheap test before its pattern.
_NEEDS = {
    "private_key": ("private key-----",),
    "auth_header": ("authorization",),
    "cookie": ("cookie",),
    "key_value": ("key", "token", "secret", "passw", "pwd", "passphrase"),
    "sk_ant": ("sk-ant-",),
    "sk": ("sk-",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "github_pat": ("github_pat_",),
    "slack": ("xox",),
    "aws": ("akia", "asia"),
    "google": ("aiza",),
    "jwt": ("eyj",),
}
#: The one letter beyond ASCII that patterns without case take for an ASCII letter and that has no ASCII lower case.
_LONG_S = "\u017f"


#: What a match needs besides: a separator, or a run of characters of a token.
_BY_SEPARATOR = ("auth_header", "cookie", "key_value")
_TOKEN_RUN = r"[A-Za-z0-9_.\-]{14}"


def _may_match(text: Column, low: Column) -> Column:
    """Is there any family's needed text? Tests that most texts fail at once come first."""

    def some(families: tuple[str, ...] | list[str]) -> Column:
        out = low.contains(_LONG_S)
        for need in dict.fromkeys(n for f in families for n in _NEEDS[f]):
            out = out | low.contains(need)
        return out

    tokens = [f for f, _, _ in FAMILIES if f not in _BY_SEPARATOR and f != "private_key"]
    separated = (text.contains(":") | text.contains("=")) & some(_BY_SEPARATOR)
    return text.contains("-----BEGIN") | separated | (text.rlike(_TOKEN_RUN) & some(tokens))


def scrub(c: Column) -> Column:
    """STRUCT<text, hits>: the text with credentials replaced, and how many were; each family sees what the last one left."""
    text = F.coalesce(c, F.lit(""))
    return F.when(_may_match(text, F.lower(text)), _scrubbed(text)).otherwise(F.struct(text.alias("text"), F.lit(0).cast("long").alias("hits")))


def _scrubbed(text: Column) -> Column:
    # one-element arrays bind each step's text once, so that it is not computed anew for its count and its replacement
    step = F.array(F.struct(text.alias("text"), F.lit(0).cast("long").alias("hits"), F.lower(text).alias("low")))
    for family, pattern, replacement in FAMILIES:

        def apply(s: Column, family: str = family, pattern: str = pattern, replacement: str = replacement) -> Column:
            # replacements bring none of the needed texts, so the first text's lower case serves all steps
            there = s["low"].contains(_LONG_S)
            for need in _NEEDS[family]:
                there = there | s["low"].contains(need)
            hits = s["hits"] + F.regexp_count(s["text"], F.lit(pattern))
            return F.when(there, F.struct(F.regexp_replace(s["text"], pattern, replacement).alias("text"), hits.alias("hits"), s["low"].alias("low"))).otherwise(s)

        step = F.transform(step, _one(apply))
    return F.element_at(F.transform(step, lambda s: F.struct(s["text"].alias("text"), s["hits"].alias("hits"))), 1)


def _one(f):
    """A function of exactly one parameter, as Spark's lambdas count parameters."""
    return lambda s: f(s)


def scrub_text(c: Column) -> Column:
    return scrub(c)["text"]


def count_secrets(c: Column) -> Column:
    return scrub(c)["hits"]
