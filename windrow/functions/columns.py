"""Scalar functions as column expressions; nothing here needs Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Protocol numbers and names.
PROTO_NAMES = {6: "TCP", 17: "UDP", 1: "ICMP"}
QC_PROTO_NAMES = PROTO_NAMES | {2: "IGMP"}


def clean_label(c: Column) -> Column:
    """Trimmed; null is empty; U+0096, en dash, em dash and minus become a hyphen."""
    return F.translate(F.trim(F.coalesce(c, F.lit(""))), "\u0096–—−", "----")


def flag(c: Column) -> Column:
    """0 for null, empty, 0 and false; else 1."""
    return F.when(F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "0", "false"), 0).otherwise(1)


def finite(c: Column) -> Column:
    """The double, or null if it is NaN or infinite."""
    d = c.try_cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def safe_int(c: Column, default: int = 0) -> Column:
    """Integer part of a number or of its text; default where there is none."""
    return F.coalesce(finite(c).try_cast("long"), F.lit(default))


def safe_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(finite(c), F.lit(default))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den; num itself where den is 0."""
    return F.when(den == 0, num.cast("double")).otherwise(num / den)


def _named(c: Column, names: dict[int, str], default: Column) -> Column:
    out = F.when(F.lit(False), "")
    for number, name in names.items():
        out = out.when(c == number, name)
    return out.otherwise(default)


def proto_name(c: Column) -> Column:
    return _named(c, PROTO_NAMES, c.cast("string"))


def proto_display(c: Column) -> Column:
    """`6 (TCP)`; the number alone where it has no name."""
    return _named(c, {k: f"{k} ({v})" for k, v in QC_PROTO_NAMES.items()}, c.cast("string"))


def human_bytes(c: Column) -> Column:
    unit = lambda power, name: F.format_string(f"%.2f {name}", c / F.lit(float(1024**power)))
    return F.when(c >= 1024**3, unit(3, "GiB")).when(c >= 1024**2, unit(2, "MiB")).when(c >= 1024, unit(1, "KiB")).otherwise(F.format_string("%.0f B", c.cast("double")))


def display_text(hex_col: Column) -> Column:
    """Bytes given in hex as text: printable ASCII as it is, white space as a blank, the rest as dots."""
    raw = F.decode(F.unhex(hex_col), "ISO-8859-1")
    return F.regexp_replace(F.regexp_replace(raw, r"[\x09-\x0D]", " "), r"[^\x20-\x7E]", ".")


def hash_key(seed: int, *parts: Column) -> Column:
    """md5 text of seed and parts: the order of all seeded shuffles and samples."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def hash01(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of hash_key."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def pair_display(a: Column, b: Column) -> Column:
    return F.concat_ws("↔", a, b)


def metric_from_text(text: Column, key: str) -> Column:
    """`"key": number`, else `key words : number`, any case, first hit; null where there is none."""
    number = r"([-+]?[0-9]*\.?[0-9]+)"
    quoted = F.regexp_extract(text, rf'(?i)"{key}"\s*:\s*{number}', 1)
    spoken = F.regexp_extract(text, rf"(?i){key.replace('_', '[ _]')}\s*[:=]\s*{number}", 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(spoken, F.lit(""))).try_cast("double")
