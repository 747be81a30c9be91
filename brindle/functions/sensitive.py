"""Sensitive data: classes, redaction and previews of texts, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of a secret, as the patterns below have them.
_LABELS = r"(密码|口令|私钥|密钥|api[_ -]?key|access[_ -]?key|token|secret|password)"

# The patterns in the order in which they are tried, with class, reason and replacement.
PATTERNS = (
    (r"(?s)-----BEGIN(?: [A-Z0-9]+)? PRIVATE KEY-----.*?-----END(?: [A-Z0-9]+)? PRIVATE KEY-----", "private_key", "private_key_block", "[PRIVATE_KEY_REDACTED]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{12,}", "credential", "bearer_token", "Bearer [REDACTED]"),
    (r"(?i)\b(postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:/]+:[^\s@]+@", "credential", "connection_string_credentials", "$1://[REDACTED]@"),
    (r"(?i)([?&](?:api[_-]?key|key|token|secret|access[_-]?token|access[_-]?key|ticket)=)([^&\s]+)", "credential", "url_credentials", "$1[REDACTED]"),
    (r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|AIza[0-9A-Za-z_-]{30,})", "credential", "provider_secret", "[SECRET_REDACTED]"),
    (r"\b[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{12,}\b", "credential", "jwt", "[TOKEN_REDACTED]"),
    (r"(?i)\b(?:sk|rk|pk)-[A-Za-z0-9_-]{12,}\b", "credential", "prefixed_secret", "[SECRET_REDACTED]"),
    (rf"(?i){_LABELS}\s*(?:是|为|[:：=])\s*([^\s，。；;]{{4,}})", "credential", "credential_label_with_value", "$1：[REDACTED]"),
    (rf"(?i){_LABELS}\s+(?=[^\s，。；;]{{8,}})(?=[^\s，。；;]*\d)([^\s，。；;]{{8,}})", "credential", "credential_label_with_space_value", "$1 [REDACTED]"),
    (r"(?:身份证(?:号)?|银行卡(?:号)?|卡号|银行账号|账号)\s*(?:是|为|[:：=])?\s*(?:\d[ -]?){12,19}[0-9Xx]", "identifier", "high_risk_identifier", "[IDENTIFIER_REDACTED]"),
)


#: Of each pattern, in order, a cheap test that every text with it passes.
_LABEL_WORDS = ("密码", "口令", "私钥", "密钥", "key", "token", "secret", "password")


def _may_have(text: Column) -> tuple[Column, ...]:
    low = F.lower(text)
    has = lambda c, *words: reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])
    labels = has(low, *_LABEL_WORDS)
    return (
        has(text, "PRIVATE KEY-----"), has(low, "bearer"), has(text, "://"), has(text, "="), has(text, "AKIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"), text.rlike(r"[A-Za-z0-9_-]{12}\.[A-Za-z0-9_-]{12}"),
        has(low, "sk-", "rk-", "pk-"), labels, labels, has(text, "身份证", "银行卡", "卡号", "账号"),
    )


def sensitive_reason(text: Column) -> Column:
    """The reason of the first pattern that a text has; null if none."""
    found = F.lit(None).cast("string")
    for (pattern, _, reason, _), may in reversed(list(zip(PATTERNS, _may_have(text)))):
        found = F.when(may & text.rlike(pattern), F.lit(reason)).otherwise(found)
    return found


def category_of(reason: Column) -> Column:
    """The class that a reason belongs to."""
    found = F.lit(None).cast("string")
    for _, category, name, _ in PATTERNS:
        found = F.when(reason == name, F.lit(category)).otherwise(found)
    return found


def sensitive_category(text: Column) -> Column:
    """The class of the first pattern that a text has; null if none."""
    return category_of(sensitive_reason(text))


def is_sensitive(text: Column) -> Column:
    """Whether any pattern occurs; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, [may & text.rlike(p[0]) for p, may in zip(PATTERNS, _may_have(text))]), F.lit(False))


def redacted(text: Column) -> Column:
    """The text with every pattern replaced, in order."""
    for pattern, _, _, replacement in PATTERNS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def safe_preview(text: Column, n: int = 80) -> Column:
    """One line of at most `n` characters, or a notice if the text is sensitive."""
    line = F.substring(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), 1, n)
    return F.when(is_sensitive(text), F.lit("[sensitive content redacted]")).otherwise(line)
