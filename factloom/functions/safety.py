"""Column -> Column functions of security and safety: redaction, classes of sensitivity, injected instructions, hidden and high-entropy text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Secrets and personal numbers, in the order in which they are replaced.
SECRETS = [(r"(?i)(?:api[_-]?key|apikey|secret|token|password|auth)\s*[:=]\s*\S+", "[SECRET_REDACTED]"), (r"(?i)Bearer\s+\S+", "Bearer [REDACTED]"), (r"sk-[A-Za-z0-9]{20,}", "sk-[REDACTED]")]
PERSONAL = [("ID_MASKED", r"\b\d{14}(\d{3}[\dXx])\b"), ("PHONE_MASKED", r"\b1[3-9]\d{5}(\d{4})\b"), ("CARD_MASKED", r"\b\d{12,15}(\d{4})\b"), ("ID_TAIL_MASKED", r"\b[1-9]\d{5}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(\d{4})\b")]
# Keys under which a value is a secret. They are looked for in keys without underscores and hyphens, so those written with one never match.
SECRET_KEYS = ("api_key", "apikey", "secret", "token", "password", "auth", "license_key", "private_key", "signing_key", "access_key")
# Invisible characters by name.
INVISIBLE = {
    "200b": "ZERO_WIDTH_SPACE", "200c": "ZERO_WIDTH_NON_JOINER", "200d": "ZERO_WIDTH_JOINER", "200e": "LEFT_TO_RIGHT_MARK", "200f": "RIGHT_TO_LEFT_MARK", "feff": "BOM_ZERO_WIDTH_NO_BREAK_SPACE", "2060": "WORD_JOINER",
    "2061": "FUNCTION_APPLICATION", "2062": "INVISIBLE_TIMES", "2063": "INVISIBLE_SEPARATOR", "2064": "INVISIBLE_PLUS", "2066": "LEFT_TO_RIGHT_ISOLATE", "2067": "RIGHT_TO_LEFT_ISOLATE", "2068": "FIRST_STRONG_ISOLATE", "2069": "POP_DIRECTIONAL_ISOLATE",
}
# Forms of injected instructions and code, by name.
INJECTIONS = {
    "ignore_previous_instructions": r"ignore\s+(all\s+)?(previous|prior|above)\s+(instructions|commands|directives|prompts?)",
    "forget_knowledge": r"forget\s+(everything|all)\s+(you\s+)?(know|learned|have)",
    "role_assumption": r"you\s+(are\s+)?(now|must\s+act\s+as|will\s+act\s+as)\s+",
    "secret_extraction": r"output\s+(the\s+)?(password|key|token|secret|flag|api[-_\s]?key)",
    "system_prompt_reference": r"(system\s+(prompt|message|instruction))",
    "chat_template_marker": r"<\|im_start\|>|<\|im_end\|>",
    "instruction_marker": r"\[\s*(INST|SYS|SYSTEM)\s*\]",
    "markdown_section_injection": r"###\s*(system|user|assistant|instruction)",
    "base64_payload": r"(begin\s+base64|base64\s+encoded|decode\s+and\s+execute)",
    "delimiter_injection": r"[-=]{3,}\s*(begin|end)\b",
    "direct_command": r"say\s+['\"].+['\"]\s*(and|without|then)",
    "jailbreak_attempt": r"(DAN|jailbreak|do\s+anything\s+now|unlimited\s+mode)",
    "unicode_override": r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]",
    "template_injection": r"\{\{\s*\w+\s*\.\w+\s*\}\}|\{%\s*(include|extends|block|for|if)\s|\$\{\s*\w+\s*\}",
    "sql_injection": r"('\s*OR\s*'\s*'\s*=\s*'|'\s*OR\s*1\s*=\s*1|UNION\s+SELECT\s+|DROP\s+TABLE\s+|DELETE\s+FROM\s+)",
    "json_injection": r"__proto__|prototype\s*:\s*\{|constructor\s*:\s*\{|\[\$\w+\]",
    "path_traversal": r"(\.\.(\\|/))+[\w\-. ]+|file:\\/+|file:[A-Za-z]:",
    "command_injection": r"(;\s*\b(cat|ls|dir|whoami|id|pwd|echo|curl|wget|rm|mv|cp|bash|sh|powershell|cmd)\b|`[^`]+`|\$\([^)]+\))",
    "xss_injection": r"<script[^>]*>.*?</script>|onerror\s*=|onload\s*=|onclick\s*=|javascript\s*:|<img[^>]+onerror|<svg[^>]+onload",
    "high_entropy_encoded": r"[A-Za-z0-9+/]{40,}={0,2}",
}
# Marks of the insides of a file that don't belong in its metadata.
FILE_MARKS = ("%%EOF", "endobj", "endstream", "stream", "/Type", "/Page", "/Root", "/Info", "/Metadata", "obj<", ">>")


def redact_secrets(c: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, *p), SECRETS, c)


def redact_personal(c: Column) -> Column:
    """Personal numbers as LABEL(...last four); the patterns run in order over the text already replaced."""
    return reduce(lambda x, p: F.regexp_replace(x, p[1], f"{p[0]}(...$1)"), PERSONAL, c)


def redact_text(c: Column) -> Column:
    return redact_personal(redact_secrets(c))


def redact_map(m: Column) -> Column:
    """A map of texts with the values of secret keys withheld and the others redacted."""
    plain = lambda k: F.regexp_replace(F.lower(k), "[_-]", "")
    secret = lambda k: reduce(lambda a, b: a | b, [F.contains(plain(k), F.lit(s)) for s in SECRET_KEYS])
    return F.transform_values(m, lambda k, v: F.when(secret(k), "[SECRET_REDACTED]").otherwise(redact_text(v)))


def redaction_of(c: Column) -> Column:
    """(has_secrets, has_pii, pii_types): what redaction would find."""
    types = F.array_compact(F.array(*[F.when(c.rlike(p), label) for label, p in PERSONAL]))
    secrets = reduce(lambda a, b: a | b, [c.rlike(p) for p, _ in SECRETS])
    return F.struct(secrets.alias("has_secrets"), (F.size(types) > 0).alias("has_pii"), F.array_join(types, ",").alias("pii_types"))


def sensitivity(c: Column, personal: Column) -> Column:
    """0 public, 1 internal, 2 confidential, 3 restricted."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).when(personal, 3).when(F.length(c) > 200, 2).otherwise(1)


def entropy(chars: Column) -> Column:
    """Bits a character of an array of characters; 0 if it is empty."""
    n = F.size(chars)
    part = lambda ch: F.size(F.filter(chars, lambda x: x == ch)) / n
    bits = F.aggregate(F.transform(F.array_distinct(chars), part), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(n > 0, bits).otherwise(0.0)


def high_entropy(c: Column, threshold: float = 4.5, whole: int = 256, window: int = 128, step: int = 64) -> Column:
    """Array of (start, end, entropy): the beginning of a text if it is of high entropy, else each such window over the whole text."""
    n = F.length(c)
    chars = lambda start, size: F.split(F.substring(c, start + 1, size), "")
    first = entropy(chars(F.lit(0), F.lit(whole)))
    lone = F.array(F.struct(F.lit(0).alias("start"), F.least(n, F.lit(whole)).alias("end"), F.round(first, 2).alias("entropy")))
    starts = F.transform(F.sequence(F.lit(0), F.floor((n - window) / step).cast("int")), lambda i: i * step)
    windows = F.transform(starts, lambda s: F.struct(s.alias("start"), (s + window).alias("end"), entropy(chars(s, F.lit(window))).alias("entropy")))
    windows = F.transform(F.filter(windows, lambda w: w["entropy"] >= threshold), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.round(w["entropy"], 2).alias("entropy")))
    nothing = F.array().cast("array<struct<start:int,end:int,entropy:double>>")
    return F.when(F.coalesce(n, F.lit(0)) < 8, nothing).when(first >= threshold, lone).when(n < window, nothing).otherwise(windows)


def injections(c: Column) -> Column:
    """Names of the injected forms that a text holds."""
    return F.array_compact(F.array(*[F.when(c.rlike("(?i)" + p), name) for name, p in INJECTIONS.items()]))


def metadata_injected(c: Column) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(m) for m in FILE_MARKS])


def hidden_reason(opacity: Column, mode: Column, size: Column) -> Column:
    """Why a text can't be seen, or null."""
    return F.when(opacity < 0.01, "zero_opacity").when(mode == 3, "invisible_rendering_mode").when(size < 0.5, "zero_font_size")
