"""Text expressions: name keys and tokens, path parts, numbers and JSON as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_non_empty(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols])


def name_key(col: Column, suffix: str = "") -> Column:
    """Lower-cased name without white space, full-width parentheses as ASCII, one trailing ``suffix`` dropped."""
    key = F.translate(F.regexp_replace(F.lower(F.trim(col)), r"\s+", ""), "（）", "()")
    if suffix:
        cut = F.substring(key, F.lit(1), F.length(key) - len(suffix))
        key = F.when(F.endswith(key, F.lit(suffix)) & (F.length(key) > len(suffix)), cut).otherwise(key)
    return key


def name_tokens(col: Column, suffix: str = "") -> Column:
    """The name's key, its parts in parentheses, and the key without them; distinct and not empty."""
    key = name_key(col, suffix)
    inner = F.regexp_extract_all(key, F.lit(r"\(([^()]*)\)"), F.lit(1))
    outer = F.regexp_replace(key, r"\([^()]*\)", "")
    return F.array_distinct(F.filter(F.concat(F.array(key), inner, F.array(outer)), lambda t: t != ""))


def safe_part(col: Column, default: str = "unknown") -> Column:
    """Letters, digits, ``_`` and ``-`` as they are, all else ``_``; no ``_`` at the ends; ``default`` if nothing is left."""
    clean = F.regexp_replace(col, r"[^\p{L}\p{N}_-]", "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, "^_+|_+$", ""), F.lit("")), F.lit(default))


def with_suffix(col: Column, suffix: str) -> Column:
    return F.when(F.endswith(col, F.lit(suffix)), col).otherwise(F.concat(col, F.lit(suffix)))


def without_suffix(col: Column, suffix: str) -> Column:
    return F.when(F.endswith(col, F.lit(suffix)), F.substring(col, F.lit(1), F.length(col) - len(suffix))).otherwise(col)


def compact_number(col: Column) -> Column:
    """Six decimals at most, no trailing zeros or point, no negative zero."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", col.cast("double")), r"0+$", ""), r"\.$", "")
    return F.when(text == "-0", F.lit("0")).otherwise(text)


def url_part(col: Column) -> Column:
    """Percent-encoded path part."""
    return F.regexp_replace(F.url_encode(col), r"\+", "%20")


def door_parts(col: Column) -> tuple[Column, Column]:
    """(car, door) numbers of "c-d"; null where the text does not parse."""
    pattern = r"^\s*(\d+)\s*-\s*(\d+)\s*$"
    number = lambda k: F.nullif(F.regexp_extract(col, pattern, k), F.lit("")).cast("int")
    return number(1), number(2)


def door_ordinal(car: Column, door: Column, doors_per_car: int) -> Column:
    return ((car - 1) * doors_per_car + door).cast("int")


def ordinal_door(ordinal: Column, doors_per_car: int) -> tuple[Column, Column]:
    before = ordinal - 1
    return (F.floor(before / doors_per_car) + 1).cast("int"), (before % doors_per_car + 1).cast("int")


def json_value(col: Column, path: str, fallback: Column | None = None) -> Column:
    value = F.get_json_object(F.nullif(col, F.lit("")), path)
    return value if fallback is None else F.coalesce(value, fallback)


def xml_error(col: Column, tags: tuple[str, ...]) -> Column:
    """The first text of each tag, joined by " / "."""
    return F.array_join(F.filter(F.array(*[F.nullif(F.xpath_string(col, F.lit(f"//{t}")), F.lit("")) for t in tags]), lambda t: t.isNotNull()), " / ")


def preferences(col: Column) -> Column:
    """Comma list of route preferences as an ordered distinct array; all or both stand for both, unknown ones go, none at all is "none"."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), ","), lambda p: F.lower(F.trim(p)))
    every = F.exists(parts, lambda p: p.isin("all", "both"))
    known = F.array_distinct(F.filter(parts, lambda p: p.isin("none", "elevator")))
    return F.when(every, F.array(F.lit("none"), F.lit("elevator"))).when(F.size(known) > 0, known).otherwise(F.array(F.lit("none")))


def toilet_subtypes(col: Column) -> Column:
    """Subtypes that serve a requested gender; null stands for no filter."""
    want = F.lower(F.coalesce(col, F.lit("")))
    lit = lambda *v: F.array(*[F.lit(x) for x in v])
    return F.when(want == "male", lit("male", "both")).when(want == "female", lit("female", "both")).when(want == "accessible", lit("accessible"))


def resolved_path(col: Column) -> Column:
    """An absolute path without "." and empty parts, each ".." taking the part before it away."""
    step = lambda s, p: F.when(p.isin("", "."), s).when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p)))
    parts = F.aggregate(F.split(col, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def within_roots(col: Column, roots: tuple[str, ...]) -> Column:
    """Whether a path, resolved, is one of the roots or lies below one; false for null and relative paths."""
    path = resolved_path(col)
    inside = [(path == r.rstrip("/")) | F.startswith(path, F.lit(r.rstrip("/") + "/")) for r in roots]
    below = inside[0]
    for test in inside[1:]:
        below |= test
    return F.coalesce(F.startswith(col, F.lit("/")) & below, F.lit(False))


def save_status(expected: Column, active: Column) -> Column:
    """200 where the writer saw the active version, or named none; 409 where it has changed since."""
    return F.when(F.coalesce(F.nullif(expected, F.lit("")) == active, F.lit(True)), 200).otherwise(409)


def key_values(col: Column) -> Column:
    """Map of "k=v" parts of a comma list, trimmed; parts without a key or "=" go."""
    parts = F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), ","), lambda p: F.trim(p)), lambda p: F.regexp_like(p, F.lit("^[^=]+=")))
    entry = lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("value"))
    return F.map_from_entries(F.transform(parts, entry))


def share(col: Column) -> Column:
    """A threshold as a share: numbers above one are percentages."""
    return F.when(col > 1, col / 100.0).otherwise(col)
