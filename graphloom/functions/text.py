"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a secret, in the order in which it is replaced.
SECRET_PATTERNS = (
    (r"\b(AKIA[0-9A-Z]{16})\b", "[REDACTED_AWS_KEY]"),
    (r"\b(gh[pousr]_[A-Za-z0-9_]{36,255})\b", "[REDACTED_GITHUB_TOKEN]"),
    (r"\b(xox[baprs]-[0-9a-zA-Z]{10,48})\b", "[REDACTED_SLACK_TOKEN]"),
    (r"-----BEGIN (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----[\s\S]+?-----END (?:RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
    (r"""(?i)\b(api_key|apikey|secret_key|client_secret|auth_token|access_token|password)\b\s*[:=]\s*['"][a-zA-Z0-9_\-.~!@#$%^&*()+=]{8,}['"]""", "$1='[REDACTED_SECRET]'"),
    (r"(?i)(postgres(?:ql)?|mysql|mongodb(?:\+srv)?)://[^\s:]+:[^\s@]+@[^\s/]+", "$1://[USER]:[REDACTED_PASSWORD]@[HOST]"),
)
# Words that identifiers' vectors leave out.
STOP_WORDS = "a an the and or in on at to for with by of from as is are was were it this that".split()


def redact_secrets(text: Column) -> Column:
    """Text with secrets replaced; null gives ''."""
    out = F.coalesce(text, F.lit(""))
    for pattern, put in SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, put)
    return out


def normalise_name(name: Column) -> Column:
    """Letters and digits in lower case, without component suffixes, which are
    stripped one after the other where something is left before them."""
    out = F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), "[^a-zA-Z0-9]", ""))
    for suffix in ("service", "controller", "manager", "component", "module"):
        out = F.when(out.endswith(suffix) & (F.length(out) > len(suffix)), F.substring(out, F.lit(1), F.length(out) - len(suffix))).otherwise(out)
    return out


def slug(text: Column) -> Column:
    """Lower-case words joined by dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def identifier(text: Column) -> Column:
    """A safe identifier: other characters become _, a leading digit gets one before it."""
    out = F.regexp_replace(text, "[^A-Za-z0-9_]", "_")
    return F.when(out.rlike("^[0-9]"), F.concat(F.lit("_"), out)).otherwise(out)


def pascal(text: Column) -> Column:
    """Words of letters and digits joined, each capitalised; Operation for none."""
    words = F.filter(F.split(F.regexp_replace(text, "[^a-zA-Z0-9]", " "), " +"), lambda w: w != "")
    out = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), "")
    return F.when(out == "", "Operation").otherwise(out)


def file_name(text: Column) -> Column:
    """A name that every file system takes: other characters become _."""
    return F.regexp_replace(text, r'[\\/:*?"<>|#^\[\]]', "_")


def token_cost(text: Column, per: float = 3.7) -> Column:
    """Estimated model tokens: ceil(length / per), 1 at least; 0 for empty."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(n / F.lit(per)))).cast("int")


def word_set(text: Column) -> Column:
    """Distinct lower-case words, split at white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column, floor: float = 0.05) -> Column:
    """Jaccard similarity of two arrays, at least floor."""
    union = F.size(F.array_union(a, b))
    return F.greatest(F.lit(floor), F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0))


def terms(text: Column) -> Column:
    """Identifier terms with repetition: ^word$ for each word and its 3- and
    4-grams, as array<struct<term, w>> with weights 2, 0.8 and 1."""
    camel = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.split(F.regexp_replace(camel, r"[^a-zA-Z0-9_\-\.]", " "), r"\s+")
    words = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[._\-]+|[._\-]+$", ""))
    words = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(STOP_WORDS))

    def grams(w: Column, n: int, weight: float) -> Column:
        make = lambda i: F.struct(F.substring(w, i, F.lit(n)).alias("term"), F.lit(weight).alias("w"))
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), make)).otherwise(F.array().cast("array<struct<term:string,w:double>>"))

    one = lambda w: F.array(F.struct(F.concat(F.lit("^"), w, F.lit("$")).alias("term"), F.lit(2.0).alias("w")))
    return F.flatten(F.transform(words, lambda w: F.concat(one(w), grams(w, 3, 0.8), grams(w, 4, 1.0))))


def hash_place(term: Column, dimension: int = 128) -> tuple[Column, Column]:
    """(bucket, sign) of a term: its md5 as a little-endian number modulo
    dimension (a power of two up to 256), and the sign from bit 32."""
    digest = F.md5(term.cast("binary"))
    bucket = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % dimension
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return bucket, sign
