"""JSON files to ``key: value`` lines by VARIANT, in expressions only.

A file is parsed once.  Its containers are then unfolded level by level: a step of a
fold replaces every object by its members and every array by its elements, each with
its path and its place, until nothing nested is left.  The number of steps is the
nesting of the file, which its brackets tell.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.binding import let
from lodestone.functions.text import trim_unicode

NODE = "struct<place: array<struct<n: bigint, key: string>>, path: string, value: variant>"
NODES = f"array<{NODE}>"
# Digits that a double keeps, so that a decimal number of no more is printed as it was written.
EXACT_DIGITS = 15


def nesting(text: Column) -> Column:
    """How deep the brackets outside strings are nested."""
    brackets = F.regexp_replace(text, r'"(?:[^"\\]++|\\.)*+"|[^\[\]{}"]++', "")
    # Neighbours that hold nothing are as deep as one of them.
    brackets = F.regexp_replace(brackets, r"(?:\{\}|\[\])++", "[]")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)
        return let(now, lambda n: F.struct(n.alias("now"), F.greatest(acc["most"], n).alias("most")))

    return F.aggregate(F.split(brackets, ""), start, step, lambda acc: acc["most"])


def plain_digits(number: Column) -> Column:
    """A double in decimal digits, without exponent and trailing zeros."""
    shown = number.cast("string")
    parts = r"^(-?)(\d+)\.(\d+)E(-?\d+)$"
    whole, fraction = F.regexp_extract(shown, parts, 2), F.regexp_replace(F.regexp_extract(shown, parts, 3), "0+$", "")
    digits = F.concat(whole, fraction)
    point = F.length(whole) + F.regexp_extract(shown, parts, 4).try_cast("int")
    spread = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.rpad(digits, point, "0"))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    )
    exponent = F.concat(F.regexp_extract(shown, parts, 1), spread)
    return F.when(number == 0, "0").when(shown.contains("E"), exponent).otherwise(F.regexp_replace(shown, r"\.0$", ""))


def _number(value: Column, decimal: Column) -> Column:
    """A number as a double prints; decimals of few digits are told by their own."""
    written = F.when(decimal.contains("."), F.regexp_replace(decimal, r"\.?0+$", "")).otherwise(decimal)
    digits = F.length(F.regexp_replace(F.regexp_replace(written, r"[-.]", ""), "^0+", ""))
    plain = ~decimal.contains("E") & (digits <= EXACT_DIGITS)
    zero = F.try_variant_get(value, "$", "double") == 0
    return F.when(zero, "0").when(plain, written).otherwise(plain_digits(F.try_variant_get(value, "$", "double")))


def _scalar(value: Column) -> Column:
    """The text of a scalar; numbers that are short as they stand take no regular expression."""

    def told(kind: Column, text: Column) -> Column:
        short = (F.length(text) <= EXACT_DIGITS) & ~text.contains("E")
        return (
            F.when(kind.isin("STRING", "BOOLEAN"), text)
            .when(kind == "VOID", "")
            .when(short & (kind == "BIGINT"), text)
            .when(short & kind.startswith("DECIMAL") & text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")))
            .otherwise(_number(value, text))
        )

    # Only scalars get here: of a container the schema would be made from all that is in it.
    return let(F.schema_of_variant(value), lambda kind: let(F.try_variant_get(value, "$", "string"), lambda text: told(kind, text)))


def _children(node: Column) -> Column:
    """The node's members or elements one level down, or the node itself."""

    def below(n: Column, key: Column, value: Column) -> Column:
        path = F.when(node["path"] == "", key).otherwise(F.concat(node["path"], F.lit("."), key))
        place = F.concat(node["place"], F.array(F.struct(n.cast("bigint").alias("n"), key.alias("key"))))
        return F.struct(place.alias("place"), path.alias("path"), value.alias("value"))

    # A value of another kind is NULL as a map or an array.
    members = F.map_entries(F.try_variant_get(node["value"], "$", "map<string, variant>"))
    elements = F.try_variant_get(node["value"], "$", "array<variant>")
    of_object = F.transform(members, lambda m: below(F.lit(0), m["key"], m["value"]))
    of_array = F.transform(elements, lambda v, i: below(i, i.cast("string"), v))
    return F.coalesce(of_object, of_array, F.array(node))


def element_lines(value: Column, levels: Column) -> Column:
    """``path: text`` of every scalar below ``value``, members by key and elements by place, as one text."""
    nowhere = F.array().cast("array<struct<n: bigint, key: string>>")
    start = F.array(F.struct(nowhere.alias("place"), F.lit("").alias("path"), value.alias("value"))).cast(NODES)
    step = lambda nodes, _: F.flatten(F.transform(nodes, _children))
    nodes = F.aggregate(F.sequence(F.lit(1), levels), start, step)
    told = F.transform(nodes, lambda n: F.struct(n["place"].alias("place"), n["path"].alias("path"), _scalar(n["value"]).alias("text")))
    told = F.sort_array(F.filter(told, lambda n: F.coalesce(n["text"], F.lit("")) != ""))
    return F.array_join(F.transform(told, lambda n: F.concat(n["path"], F.lit(": "), n["text"])), "\n")


def parsed_json(text: Column) -> Column:
    return F.try_parse_json(text)


def json_texts(text: Column, value: Column) -> Column:
    """The texts of a file's elements (of the whole file, if it is no array), empty ones left out."""
    listed = F.try_variant_get(value, "$", "array<variant>")
    # The elements of an array are one level down already; a step too many would look at every scalar once more.
    below = nesting(text) - F.when(F.substring(F.ltrim(text), 1, 1) == "[", 1).otherwise(0)
    of = lambda levels: F.transform(F.coalesce(listed, F.array(value)), lambda e: trim_unicode(element_lines(e, levels)))
    return F.filter(let(F.greatest(below, F.lit(1)), of), lambda t: t != "")


def json_error(text: Column, value: Column) -> Column:
    """Why a file is no JSON, or null."""
    return F.when(text.isNotNull() & value.isNull(), "JSONDecodeError: the file is not valid JSON")
