"""Path algebra on ``array<string>`` columns: Column -> Column, planned by Catalyst.

A path is an array of components; list positions are digit strings. ``split_path`` and
``join_path`` convert from and to delimited text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DELIMITER = "."
#: Delimiters in the order in which they are looked for.
KNOWN_DELIMITERS = ("<>", "//", "/", ">", "<", "\\", "%", ".")
#: Characters of which a delimiter needs one.
DELIMITER_CHARS = frozenset("\\/:<>|.%")
#: Components that say nothing about a path's content.
UNINFORMATIVE = ("i", "value")
_EMPTY = "cast(array() as array<string>)"


def check_delimiter(delimiter: str) -> str:
    if not delimiter or not delimiter.strip() or not DELIMITER_CHARS & set(delimiter):
        raise ValueError(f"not a delimiter: {delimiter!r}")
    return delimiter


def split_path(text: Column, delimiter: str = DELIMITER) -> Column:
    quoted = "".join("\\" + c if not c.isalnum() else c for c in check_delimiter(delimiter))
    return F.split(text, quoted, -1)


def join_path(path: Column, delimiter: str = DELIMITER) -> Column:
    return F.array_join(path, check_delimiter(delimiter))


def infer_delimiter(text: Column) -> Column:
    found = None
    for d in KNOWN_DELIMITERS:
        found = F.when(text.contains(d), d) if found is None else found.when(text.contains(d), d)
    return found


def is_index(part: Column) -> Column:
    """Whether a part is digits only; the first character decides for most names before the pattern is tried."""
    return (part >= "0") & (part < ":") & part.rlike(r"\A\d+\z")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once and not again for each element that looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def depth(path: Column) -> Column:
    """Number of components; 0 for the root, which is one empty component."""
    return F.when(is_root(path), 0).otherwise(F.size(path))


def is_root(path: Column) -> Column:
    return (F.size(path) == 0) | ((F.size(path) == 1) & (F.get(path, F.lit(0)) == ""))


def record_index(path: Column) -> Column:
    return F.get(path, F.lit(0)).try_cast("int")


def append(path: Column, part: Column) -> Column:
    return F.array_append(path, part.cast("string"))


def concat(left: Column, right: Column) -> Column:
    return F.when(is_root(left), right).when(is_root(right), left).otherwise(F.concat(left, right))


def starts_with(path: Column, prefix: Column) -> Column:
    """The prefix itself or a descendant of it."""
    return (F.size(path) >= F.size(prefix)) & (F.slice(path, F.lit(1), F.size(prefix)) == prefix)


def is_ancestor_of(path: Column, other: Column) -> Column:
    return starts_with(other, path) & (F.size(other) > F.size(path))


def has_ancestor(path: Column, other: Column) -> Column:
    return is_ancestor_of(other, path)


def replace(path: Column, old: str, new: str) -> Column:
    return F.transform(path, lambda p: F.when(p == old, F.lit(new)).otherwise(p))


def replace_prefix(path: Column, old: Column, new: Column) -> Column:
    rest = F.slice(path, F.size(old) + 1, F.greatest(F.size(path) - F.size(old), F.lit(0)))
    return F.when(starts_with(path, old), F.concat(new, rest)).otherwise(path)


def remove(path: Column, *parts: str) -> Column:
    return F.filter(path, lambda p: ~p.isin(*parts))


def remove_indices(path: Column, num: int | None = None, *, reverse: bool = False) -> Column:
    """Without list positions: all, or the first ``num`` of them (the last ones in reverse)."""
    if num is None:
        return F.filter(path, lambda p: ~is_index(p))
    ordered = F.reverse(path) if reverse else path
    found = F.filter(F.transform(ordered, lambda p, i: F.when(is_index(p), i)), lambda i: i.isNotNull())
    dropped = F.slice(found, F.lit(1), F.lit(num))
    kept = _let(dropped, lambda own: F.filter(ordered, lambda p, i: ~F.array_contains(own, i)))
    return F.reverse(kept) if reverse else kept


def remove_by_type(path: Column, types: Column, *dropped: str) -> Column:
    """Without the parts whose type (one for each part) is dropped."""
    kept = F.filter(F.arrays_zip(path.alias("p"), types.alias("t")), lambda s: ~F.coalesce(s["t"].isin(*dropped), F.lit(False)))
    return F.transform(kept, lambda s: s["p"])


def valid_path(path: Column) -> Column:
    """Whether no part is blank."""
    return F.coalesce(~F.exists(path, lambda p: p.isNull() | (F.trim(p) == "")), F.lit(False))


def update_delimiter(text: Column, delimiter: str, old: str | None = None) -> Column:
    """A path's text with another delimiter; the old one is inferred if it isn't given."""
    check_delimiter(delimiter)
    if old is not None:
        return join_path(split_path(text, old), delimiter)
    return F.coalesce(F.replace(text, infer_delimiter(text), F.lit(delimiter)), text)


def replace_indices(path: Column, constant: str = "i") -> Column:
    return F.transform(path, lambda p: F.when(is_index(p), F.lit(constant)).otherwise(p))


def drop_parts(path: Column, indexed: Column, names: tuple[str, ...] = ("value",)) -> Column:
    """Without list positions (``indexed`` tells which parts are) and the named parts."""
    kept = F.filter(F.arrays_zip(path.alias("p"), indexed.alias("x")), lambda s: ~s["x"] & ~s["p"].isin(*names))
    return F.transform(kept, lambda s: s["p"])


def informative(path: Column) -> Column:
    return F.filter(path, lambda p: ~is_index(p) & ~p.isin(*UNINFORMATIVE))


def info_content(path: Column) -> Column:
    return F.size(informative(path))


def parent(path: Column, step: int = 1) -> Column:
    return F.slice(path, F.lit(1), F.greatest(F.size(path) - step, F.lit(0)))


def ancestors(path: Column) -> Column:
    """All proper ancestors, the shortest first."""
    return F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda n: F.slice(path, F.lit(1), n))).otherwise(F.expr("cast(array() as array<array<string>>)"))


def last_parts(path: Column, count: int | Column) -> Column:
    n = F.least(F.lit(count), F.size(path))
    return F.when(n > 0, F.slice(path, F.size(path) - n + 1, n)).otherwise(F.expr(_EMPTY))


def name(path: Column, delimiter: str = DELIMITER) -> Column:
    """The last component that is no list position; positions only are joined."""
    named = remove_indices(path)
    return F.when(F.size(path) == 0, "").when(F.size(named) == 0, F.array_join(path, delimiter)).otherwise(F.element_at(named, -1))


def group(path: Column) -> Column:
    """The path without a last list position, other positions masked; empty paths have none."""
    last = F.element_at(path, -1)
    cut = F.when(is_index(last), parent(path)).otherwise(path)
    return F.when(F.size(path) > 0, replace_indices(cut))


def sort_key(path: Column) -> Column:
    """Natural order: depth as text, then the parts with digits padded to 8."""
    padded = F.transform(path, lambda p: F.when(is_index(p), F.lpad(p, 8, "0")).otherwise(p))
    return F.concat_ws(DELIMITER, F.size(path).cast("string"), padded)


def _number_code(digits: Column, *, bare: bool = False) -> Column:
    """Digits as text whose order is that of the numbers, however long: their count (9 for each nine and the rest), then they; bare ones have no leading zeros."""
    bare = digits if bare else F.regexp_replace(digits, r"\A0+(?=\d)", "")
    return F.concat(F.repeat(F.lit("9"), F.floor(F.length(bare) / 9).cast("int")), (F.length(bare) % 9).cast("string"), bare)


def order_key(path: Column, *, depth_first: bool = True) -> Column:
    """Text whose order is the natural one of paths: numbers by value, of any length, also behind a name (``item12``).

    Unlike ``sort_key`` it needs no padding width, and depths are numbers too. Stored beside a path, it lets ranges of
    paths prune a scan: ``order_key(path, depth_first=False)`` of all paths below a prefix starts with that of the prefix and a delimiter.
    """
    number = r"\A([a-zA-Z_.\-]*)(\d+)\z"
    last = lambda p: F.substring(p, -1, 1).between("0", "9")  # noqa: E731 - tells most names from numbers before the pattern is tried
    short = lambda p: (F.length(p) < 9) & (~p.startswith("0") | (p == "0")) & is_index(p)  # noqa: E731 - list positions, whose code needs no pattern
    plain = lambda p: F.concat(F.lit("'''"), F.length(p).cast("string"), p, F.lit("'"))
    coded = F.transform(path, lambda p: F.when(short(p), plain(p)).when(last(p) & p.rlike(number), F.concat(F.lit("'"), F.regexp_extract(p, number, 1), F.lit("''"), _number_code(F.regexp_extract(p, number, 2)), F.lit("'"))).otherwise(p))
    key = F.array_join(coded, DELIMITER)
    return F.concat_ws(DELIMITER, _number_code(depth(path).cast("string"), bare=True), key) if depth_first else key


def contains(path: Column, part: Column) -> Column:
    """Whether a path's text holds that of another one, cut at no particular component."""
    return F.coalesce(F.array_join(path, "<<>>").contains(F.array_join(part, "<<>>")), F.lit(False))


def sort_parts(path: Column) -> Column:
    return F.array_sort(path)


def reverse(path: Column) -> Column:
    return F.reverse(path)
