"""Values as canonical JSON: sorted keys, ``", "`` and ``": "`` between them, ASCII escapes, floats in Python's form.

Floats get the shortest digits that are the same double.  Where two such forms
exist, which happens from about 1e17 on, the one taken may not be Python's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHORT = {"0022": '\\"', "005C": "\\\\", "000A": "\\n", "000D": "\\r", "0009": "\\t", "0008": "\\b", "000C": "\\f"}


def _escaped(s: Column) -> Column:
    """Every UTF-16 unit for itself: printable ASCII stays, others become ``\\uXXXX`` or their short form."""
    units = F.regexp_extract_all(F.hex(F.encode(s, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))

    def unit(u: Column) -> Column:
        out = F.when(u.between("0020", "007E"), F.char(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), F.lower(u)))
        for code, short in _SHORT.items():
            out = F.when(u == code, F.lit(short)).otherwise(out)
        return out

    return F.array_join(F.transform(units, unit), "")


def _string(s: Column) -> Column:
    """Few strings need an escape; the others are quoted as they are."""
    return F.concat(F.lit('"'), F.when(s.rlike(r'[^\x20-\x7E]|["\\]'), _escaped(s)).otherwise(s), F.lit('"'))


def _digits(s: Column) -> Column:
    """``(digits, e)`` of a positive decimal string ``d.ddd``, with or without ``Exx``: its value is ``d.igits * 10 ** e``."""
    bare, raised = F.substring_index(s, "E", 1), F.when(s.contains("E"), F.substring_index(s, "E", -1).cast("int")).otherwise(0)
    whole, part = F.ltrim(F.substring_index(bare, ".", 1), F.lit("0")), F.rtrim(F.substring_index(bare, ".", -1), F.lit("0"))
    e = F.when(whole != "", F.length(whole) - 1).otherwise(F.length(F.ltrim(part, F.lit("0"))) - F.length(part) - 1)
    return F.struct(F.rtrim(F.ltrim(F.concat(whole, part), F.lit("0")), F.lit("0")).alias("digits"), (e + raised).alias("e"))


def _shorter(x: Column, d: Column) -> Column:
    """The digits rounded to one less, if they still are this double: older Java writes one too many at times."""
    n = F.length(d["digits"])
    fewer = F.floor((d["digits"].cast("decimal(20,0)") + 5) / 10).cast("decimal(20,0)").cast("string")
    same = F.concat(fewer, F.lit("E"), (d["e"] - n + 2).cast("string")).cast("double") == x
    better = F.struct(F.rtrim(fewer, F.lit("0")).alias("digits"), (d["e"] + F.length(fewer) - n + 1).alias("e"))
    return F.when((n > 1) & F.coalesce(same, F.lit(False)), better).otherwise(d)


def _float(x: Column) -> Column:
    """The shortest digits, without an exponent from 1e-4 up to 1e16."""
    size = F.abs(x)
    d = F.aggregate(F.sequence(F.lit(1), F.lit(2)), _digits(size.cast("string")), lambda d, _: _shorter(size, d))

    def shown(d: Column) -> Column:
        digits, e = d["digits"], d["e"]
        n = F.length(digits)
        plain = F.when(n <= e + 1, F.concat(F.rpad(digits, F.greatest(e + 1, n), F.lit("0")), F.lit(".0"))).otherwise(F.concat(F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        power = F.abs(e).cast("string")
        raised = F.concat(
            F.substr(digits, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.when(e < 0, "e-").otherwise("e+"), F.lpad(power, F.greatest(F.length(power), F.lit(2)), F.lit("0"))
        )
        return F.when(e.between(0, 15), plain).when(e.between(-4, -1), small).otherwise(raised)

    text = F.get(F.transform(F.array(d), shown), F.lit(0))
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    return F.when(x.cast("string").isin("NaN", "Infinity", "-Infinity"), x.cast("string")).when(x == 0, F.concat(sign, F.lit("0.0"))).otherwise(F.concat(sign, text))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """The JSON of a column of a type made of structs, arrays, strings, numbers and booleans; null is ``null``."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(f'"{f.name}": '), canonical_json(value[f.name], f.dataType)) for f in fields]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.StringType):
        body = _string(value)
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        body = _float(value.cast("double"))
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        body = value.cast("string")
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical JSON")
    return F.when(value.isNull(), F.lit("null")).otherwise(body)
