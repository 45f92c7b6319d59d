"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted_labels(line) -> Column:
    """Everything between double quotes, in order; there are no escapes."""
    return F.regexp_extract_all(_col(line), F.lit('"([^"]*)"'), 1)


def common_prefix(a, b) -> Column:
    """The longest common start of two strings, trailing blanks included."""
    a, b = _col(a), _col(b)
    sizes = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
    return F.substring(a, F.lit(1), F.array_max(F.filter(sizes, lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))))


def strip_last_word(name) -> Column:
    """The name before its last blank; without one, all but the last character, as slicing up to -1 gives."""
    name = _col(name)
    return F.when(F.instr(name, " ") > 0, F.regexp_replace(name, " [^ ]*$", "")).otherwise(F.substring(name, F.lit(1), F.greatest(F.length(name) - 1, F.lit(0))))


def expand_ints(text) -> Column:
    """'2,3,8-9' as [2, 3, 8, 9]; empty items are left out, a range that runs backwards is empty."""

    def item(t):
        ends = F.split(F.trim(t), "-")
        lo, hi = F.element_at(ends, 1).cast("int"), F.element_at(ends, -1).cast("int")
        return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(F.filter(F.split(_col(text), ","), lambda t: F.trim(t) != ""), item))


def find_all(text, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(pattern), group)


def rewrite(text, rules: list[tuple[str, str]]) -> Column:
    """The rules (pattern, replacement) one after the other."""
    out = _col(text)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def replace_matches(df: DataFrame, id_col: str, text_col: str, pattern: str, mapping: DataFrame, default: Column | None = None) -> DataFrame:
    """Each match of the pattern replaced by mapping's value for it (columns key, value), else by default or itself.

    The text falls into what stands between matches and the matches; pieces meet
    their value in a join and come together by position.
    """
    between = F.split(F.col(text_col), pattern)
    found = find_all(F.col(text_col), pattern)
    pieces = df.select(F.col(id_col), F.posexplode(F.arrays_zip(between.alias("plain"), found.alias("key"))).alias("at", "piece")).select(id_col, "at", "piece.plain", "piece.key")
    joined = pieces.join(mapping.select("key", "value"), "key", "left")
    value = F.coalesce(F.col("value"), default if default is not None else F.col("key"), F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("at", F.concat(F.coalesce("plain", F.lit("")), value).alias("text"))))
    return joined.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias(text_col))


def citation_handle(item) -> Column:
    """Surname of the first author and the four characters before the last ')': Smith2010."""
    item = _col(item)
    cut = F.length(item) - F.instr(F.reverse(item), ")")
    return F.concat(F.element_at(F.split(F.trim(F.substring_index(item, ",", 1)), " "), 1), F.substring(item, cut - 3, F.lit(4)))


def first_token(name, pattern: str) -> Column:
    """The first comma-separated token that matches, trimmed; a name of one token as it is; null without a match."""
    tokens = F.split(_col(name), ",")
    return F.when(F.size(tokens) == 1, _col(name)).otherwise(F.trim(F.get(F.filter(tokens, lambda t: F.rlike(t, F.lit(pattern))), F.lit(0))))


def first_match(text, cases: list[tuple[str, str]], default: str) -> Column:
    """The value of the first pattern found anywhere in the text."""
    out = F
    for pattern, value in cases:
        out = out.when(F.rlike(_col(text), F.lit(pattern)), value)
    return out.otherwise(default)


def search(text, query: str) -> Column:
    """A query that begins with / is a regular expression to search for, another a substring; the empty query holds always."""
    if not query:
        return F.lit(True)
    return F.rlike(_col(text), F.lit(query[1:])) if query[0] == "/" else F.contains(_col(text), F.lit(query))


def search_either(a, b, pattern: str) -> Column:
    """The pattern is found in one of two columns; an empty pattern holds always."""
    return F.coalesce(F.rlike(_col(a), F.lit(pattern)), F.lit(False)) | F.coalesce(F.rlike(_col(b), F.lit(pattern)), F.lit(False)) if pattern else F.lit(True)


def clock_seconds(text) -> Column:
    """'s', 's.ms' and 'm.s.ms' as 's' or 's.ms': '3.24.56' is '204.56'. Null stays null."""
    parts = F.split(_col(text).cast("string"), r"\.")
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(F.size(parts) == 3, F.concat_ws(".", (at(0).cast("int") * 60 + at(1).cast("int")).cast("string"), at(2))).otherwise(_col(text).cast("string"))


def clock_interval(start, end) -> Column:
    """(start, duration) in seconds of two clock texts."""
    a, b = clock_seconds(start).cast("double"), clock_seconds(end).cast("double")
    return F.struct(a.alias("start"), (b - a).alias("duration"))


def coordinates_label(x, y, z) -> Column:
    return F.format_string("%.2f::%.2f::%.2f", _col(x), _col(y), _col(z))


def now_minutes() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm")


def base_name(path) -> Column:
    return F.substring_index(_col(path), "/", -1)
