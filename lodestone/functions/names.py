"""Function-name expressions: tokens, equality, overlap scores, trivial answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Behind which characters a name is cut, besides at _ and -; the answers that
# say nothing, and their shapes.
TOKEN_END = r"([a-z](?=[A-Z0-9])|[A-Z](?=[0-9]|[A-Z][a-z])|[0-9](?=[a-zA-Z]))"
TRIVIAL_NAMES = ("", "unknown", "func", "function", "unnamed", "sub", "fn", "proc", "routine", "handler", "callback")
TRIVIAL_SHAPES = (r"^fun_[0-9a-f]+$", r"^sub_[0-9a-f]+$", r"^0x[0-9a-f]+$", r"^fcn\.[0-9a-f]+$", r"^_*func_?[0-9]*_*$")
VERSION_SUFFIX = "@@GLIBC_"


def strip(c: Column) -> Column:
    """Without white space at both ends, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(name: Column) -> Column:
    """Lower-case parts of a name in any case style; none for null.

    Cuts become underscores and the text is split at those: a replacement keeps its
    compiled pattern where a split would compile it for each row, and no lambda runs over
    the parts."""
    marked = F.lower(F.translate(F.regexp_replace(F.coalesce(name, F.lit("")), TOKEN_END, "$1_"), "-", "_"))
    return F.array_remove(F.split(marked, "_", -1), "")


def flat(name: Column) -> Column:
    return F.translate(F.lower(F.coalesce(name, F.lit(""))), "_-", "")


def exact_match(predicted: Column, truth: Column) -> Column:
    return flat(predicted) == flat(truth)


def set_scores(both: Column, p: Column, g: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, F1) from the sizes of two sets and of what they share; 0 where
    a set is empty. F1 straight from them: 2pr / (p + r) = 2 both / (|p| + |g|)."""
    share = lambda n: F.when(n > 0, both / n).otherwise(F.lit(0.0))
    return share(p), share(g), F.when(both > 0, 2 * both / (p + g)).otherwise(F.lit(0.0))


def token_scores(predicted: Column, truth: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, F1) of two token arrays as sets."""
    p, g = F.array_distinct(predicted), F.array_distinct(truth)
    return set_scores(F.size(F.array_intersect(p, g)), F.size(p), F.size(g))


def overlap_scores(predicted: Column, truth: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, F1) of two names' tokens."""
    return token_scores(tokens(predicted), tokens(truth))


def is_trivial(name: Column) -> Column:
    said = F.lower(strip(F.coalesce(name, F.lit(""))))
    shaped = F.lit(False)
    for s in TRIVIAL_SHAPES:
        shaped = shaped | said.rlike(s)
    return said.isin(*TRIVIAL_NAMES) | shaped


def without_version(name: Column) -> Column:
    """Cut at a version suffix."""
    return F.substring_index(name, VERSION_SUFFIX, 1)


def normalised(name: Column) -> Column:
    return F.lower(strip(name))


def display_or_anonymous(name: Column, function_id: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("<anon@"), function_id.cast("string"), F.lit(">")))


def split_function_key(key: Column) -> Column:
    """``tu:start:end:hash`` from the right: the path itself may hold colons."""
    part = lambda n: F.regexp_extract(key, r"^(.*):(\d+):(\d+):([0-9a-f]+)$", n)
    number = lambda n: F.nullif(part(n), F.lit("")).cast("bigint")
    return F.struct(F.nullif(part(1), F.lit("")).alias("tu"), number(2).alias("start_byte"), number(3).alias("end_byte"), F.nullif(part(4), F.lit("")).alias("hash"))


def title_case(code: Column) -> Column:
    """``NEAR_TIE`` as ``Near Tie``."""
    return F.initcap(F.lower(F.replace(code, F.lit("_"), F.lit(" "))))


def job_id(*parts: Column) -> Column:
    """16 hex digits of a key's sha256; all parts of the key count."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)
