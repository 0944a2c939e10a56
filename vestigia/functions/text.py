"""Expressions over text, paths and URLs."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType


def has_any(col: Column, words: Iterable[str]) -> Column:
    """True where ``col`` contains one of the words as they are; null counts as empty."""
    text = F.coalesce(col, F.lit(""))
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def tagged(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that hold, in rule order; a null condition does not hold."""
    return F.filter(F.array(*(F.when(cond, F.lit(name)) for name, cond in rules)), lambda x: x.isNotNull())


def basename(path: Column) -> Column:
    return F.substring_index(path, "\\", -1)


def netloc(url: Column) -> Column:
    """Authority of a URL with user and port; empty where there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def clipped(col: Column, size: int) -> Column:
    return F.when(F.length(col) > size, F.concat(F.left(col, F.lit(size)), F.lit("..."))).otherwise(col)


def defang(value: Column, kind: Column) -> Column:
    """An indicator that can't be followed by accident; hashes stay."""
    dots = F.replace(value, F.lit("."), F.lit("[.]"))
    return (
        F.when(kind.isin("ip", "domain"), dots)
        .when(kind == "url", F.replace(F.replace(dots, F.lit("http://"), F.lit("hxxp://")), F.lit("https://"), F.lit("hxxps://")))
        .when(kind == "email", F.replace(dots, F.lit("@"), F.lit("[@]")))
        .otherwise(value)
    )


def key_values(col: Column, between: str = ",", equals: str = "=") -> Column:
    """Map of ``k=v`` parts; the first equals sign splits and the last of equal keys wins."""
    parts = F.filter(F.split(col, between), lambda p: F.contains(p, F.lit(equals)))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, equals, 1)), F.trim(F.substr(p, F.locate(equals, p) + 1)))))


def all_text(data: Column, schema: DataType) -> Column:
    """All strings of a record in the order of its fields, joined by spaces; lists of strings and records count, lists of lists don't."""

    def parts(col: Column, kind: DataType) -> list[Column]:
        if isinstance(kind, StringType):
            return [col]
        if isinstance(kind, StructType):
            return [p for f in kind.fields for p in parts(col[f.name], f.dataType)]
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType):
            return [F.array_join(col, " ")]
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            return [F.array_join(F.transform(col, lambda x: all_text(x, kind.elementType)), " ")]
        return []

    return F.concat_ws(" ", *parts(data, schema))


def program(path: Column) -> Column:
    """First word of a path's last part; null where that is blank."""
    return F.nullif(F.get(F.split(F.trim(basename(path)), r"\s+"), F.lit(0)), F.lit(""))


def user_of(path: Column) -> Column:
    """The folder below ``users``; null without one."""
    return F.nullif(F.regexp_extract(path, "(?i)(?:^|/)users/([^/]+)", 1), F.lit(""))


def package_of(app_id: Column) -> Column:
    """The package of ``Platform_Package!App``."""
    bare = F.substring_index(app_id, "!", 1)
    return F.when(F.contains(bare, F.lit("_")), F.substr(bare, F.locate("_", bare) + 1)).otherwise(bare)


def record_id(*parts: Column) -> Column:
    """Parts joined by colons; a missing one reads None."""
    return F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))


def hex8(value: Column) -> Column:
    return F.lpad(F.hex(value), 8, "0")


def typed_domain(url: Column) -> Column:
    return F.regexp_extract(url, "://([^/:]+)", 1)
