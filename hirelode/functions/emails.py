"""Finding and screening email addresses, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.functions.text import UNICODE, any_of, col, let, quote, unquote, utrim

# What counts as an address (fixed values). Quantifiers are possessive where the next part could
# not begin with anything they would give back.
NAME = r"[A-Za-z0-9._%+-]"
PLAIN = UNICODE + rf"\b{NAME}++@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b"
OBFUSCATED = (
    r"(?iUd)\b[a-z0-9._%+-]++\s*+(?:@|\(at\)|\[at\]|(?<=\s)at\s)\s*+"
    r"[a-z0-9.-]+\s*(?:\.|\(dot\)|\[dot\]|\sdot\s)\s*[a-z]{2,}\b"
)
# A spelled at-sign; it or "@" is in every text OBFUSCATED finds something in, and looking for
# the two costs a fraction.
AT_SIGN = r"(?Us)[aA][tT][)\]\s](?<=[(\[\s]..[)\]\s])"
# Applied in this order (fixed values).
SPELLED = (
    ("(at)", "@"), ("[at]", "@"), (" at ", "@"),
    ("(dot)", "."), ("[dot]", "."), (" dot ", "."), (" ", ""),
)
INVISIBLE = "\u2028\u2029\u200b\ufeff"


def undo_obfuscation(value: Column | str) -> Column:
    plain = F.lower(utrim(value))
    for written, meant in SPELLED:
        plain = F.replace(plain, F.lit(written), F.lit(meant))
    return plain


def find_emails(text: Column | str) -> Column:
    """Plain and obfuscated addresses of a text, as written or with the obfuscation undone."""
    none = F.array().cast("array<string>")

    def found(text: Column) -> Column:
        plain = F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(f"({PLAIN})")))
        spelled = F.when(
            text.contains("@") | text.rlike(AT_SIGN),
            F.regexp_extract_all(text, F.lit(f"({OBFUSCATED})")),
        )
        undone = F.transform(F.coalesce(spelled, none), undo_obfuscation)
        return F.array_distinct(F.concat(F.coalesce(plain, none), undone))

    return let(col(text), found)


def mailto_address(href: Column | str) -> Column:
    """Address of a mailto link in any letter case; null for other links."""
    address = F.regexp_extract(col(href), r"(?is)^mailto:([^?]*)", 1)
    found = utrim(unquote(address))
    return F.when(found != "", undo_obfuscation(found))


def is_asset_email(email: Column | str) -> Column:
    """File names, placeholder domains and tracking ids that only look like addresses."""
    return F.lower(col(email)).rlike(
        rf"(?:{any_of(rules.ASSET_SUFFIXES)})\z"
        rf"|(?:^|@)(?:{any_of(rules.PLACEHOLDER_DOMAINS)})\z"
        rf"|{rules.TRACKING_ID}"
    )


def _glob(pattern: str) -> str:
    return "^" + ".*".join(quote(part) for part in pattern.split("*")) + r"\z"


# A local part ends at the first "@"; the domain is all that follows.
REJECT_LOCAL = "(?s)^(?:{})@".format(
    "|".join(
        (
            "[^@]?",
            f"(?:{any_of(rules.BLOCKED_LOCALPARTS)})",
            f"(?:{any_of(rules.BLOCKED_LOCAL_PREFIXES)})[^@]*",
            f"[^@]*(?:{any_of(rules.BLOCKED_LOCAL_FRAGMENTS)})[^@]*",
            rules.PLACEHOLDER_LOCAL,
        )
    )
)
REJECT_DOMAIN = r"(?s)^[^@]*@(?:{})\z".format(
    "|".join(
        (
            r"[^.]*",
            r".*\.\..*",
            r".*\.",
            r".*[/\\].*",
            f"(?:{any_of(rules.BLOCKED_DOMAINS)})",
            f".*(?:{any_of(rules.BLOCKED_DOMAIN_SUFFIXES + rules.BLOCKED_FILE_SUFFIXES)})",
        )
    )
)
REJECT_GLOB = "(?s)" + "|".join(_glob(p) for p in rules.BLOCKED_GLOBS)
NOT_PLAIN_ASCII = r"[^\x00-\x7f]|[\t-\r\x1c-\x20]"


def tidy_email(value: Column | str) -> Column:
    """Lower-case text without outer blanks, invisible characters and a leading scheme."""
    raw = F.regexp_replace(col(value), r"(?i)\Ahttp://", "")
    return F.lower(F.translate(utrim(raw), INVISIBLE, ""))


def is_rejected(email: Column) -> Column:
    """Whether any screening rule rejects a tidied address."""
    return (
        ~email.contains("@")
        | email.rlike(NOT_PLAIN_ASCII)
        | email.rlike(REJECT_LOCAL)
        | email.rlike(REJECT_DOMAIN)
        | email.rlike(REJECT_GLOB)
    )


def normalize_email(value: Column | str) -> Column:
    """Lower-case address, or null if any screening rule rejects it."""
    return let(tidy_email(value), lambda email: F.when(~is_rejected(email), email))


def screened(emails: Column) -> Column:
    """Distinct normalized addresses of an array, without assets and rejected ones."""
    tidy = F.transform(F.filter(emails, lambda e: ~is_asset_email(e)), tidy_email)
    return F.array_distinct(F.filter(tidy, lambda e: ~is_rejected(e)))
