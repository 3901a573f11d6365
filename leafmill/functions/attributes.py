"""Typed access to document attributes.

An attribute is a column of the table if there is one of that name, else a top-level key of the
VARIANT column ``attrs``. The type of a VARIANT value differs from row to row, so an
``Attribute`` offers one Column per kind; each is null where the value is of another kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.globs import glob_to_regex

# Python float() accepts these spellings; Spark's cast alone would also accept '1.0d'.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def false_if_null(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def _step(key: str) -> str:
    if "'" in key and '"' in key:
        raise ValueError(f"an attribute name may hold single or double quotes, not both: {key}")
    return f'["{key}"]' if "'" in key else f"['{key}']"


def variant_path(key: str) -> str:
    """JSON path of one flat key, whatever characters it holds (dots included) but both kinds of quotes."""
    return "$" + _step(key)


def dotted_path(path: str) -> str:
    """JSON path of a nested value: every dot steps one object down."""
    return "$" + "".join(map(_step, path.split(".")))


def try_json(text: Column) -> Column:
    """JSON text as VARIANT, null if it is none. Spark's own parser stops after the first value and
    ignores what follows, so the text has to parse as an array item and as an object member."""
    item = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    one = F.size(F.try_variant_get(item, "$", "array<variant>")) == 1
    return F.when(one & member.isNotNull(), F.try_variant_get(item, "$[0]", "variant"))


def try_number(text: Column) -> Column:
    """Text to double the way Python's float() reads it; NaN and bad text give null."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


class Attribute:
    """One attribute, split by kind. Each form is given as a function and made when it is first asked for, since
    most of the expressions are long and a check needs one or two."""

    present: Column  # not null (a VARIANT null counts as null)
    string: Column  # value if it is text
    number: Column  # value as double if it is a number or a boolean (true = 1)
    boolean: Column  # value if it is a boolean
    kind: Column  # 'string', 'number', 'boolean', 'list', 'object' or null
    list_has: Callable[..., Column]  # literal, fold case -> Column, true if a list holds the literal
    text: Column  # text form of a scalar or list, as Python prints it
    truthy: Column
    json: Column  # compact JSON text, for structural equality

    def __init__(self, **forms: Callable):
        self._forms = forms

    def __getattr__(self, name: str):
        if name.startswith("_") or name not in self._forms:
            raise AttributeError(name)
        made = self._forms[name]()
        setattr(self, name, made)
        return made


def attribute(df: DataFrame, name: str, path: str | None = None) -> Attribute:
    """Resolve ``name``; ``path`` gives a nested JSON path inside ``attrs`` instead of a flat key."""
    if path is None and name in df.columns:
        return _from_column(F.col(f"`{name}`"), df.schema[name].dataType)
    if "attrs" not in df.columns:
        return _from_column(F.lit(None).cast("string"), T.StringType())
    return _from_variant(F.try_variant_get("attrs", path or variant_path(name), "variant"))


def _python_bool(b: Column) -> Column:
    return F.when(b, F.lit("True")).otherwise(F.lit("False"))


def _python_float(number: Column) -> Column:
    """A double as Python prints it: plain from 0.0001 up to 1e16, else with an exponent of two digits."""
    text = number.cast("string")
    size = F.abs(number)
    mantissa, power = F.split_part(text, F.lit("E"), F.lit(1)), F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    short = F.regexp_replace(F.regexp_replace(mantissa, "^-", ""), r"\.0$", "")
    digits = F.replace(short, F.lit("."), F.lit(""))
    whole = F.rpad(digits, F.greatest(power + 1, F.lit(1)), "0")
    rest = F.substr(digits, power + 2)
    large = F.concat(sign, F.substr(whole, F.lit(1), power + 1), F.lit("."), F.when(rest != "", rest).otherwise("0"))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    exponent = F.concat(sign, short, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    # Spark leaves out the exponent from 0.001 up to 1e7
    spelled = F.when(~text.contains("E"), text).when((size >= 1e-4) & (size < 1e16), F.when(power > 0, large).otherwise(small)).otherwise(exponent)
    return F.when(F.isnan(number), "nan").when(size == float("inf"), F.concat(F.when(number < 0, "-").otherwise(""), F.lit("inf"))).otherwise(spelled)


def _python_text(s: Column) -> Column:
    """A text as Python shows it inside a list."""
    plain = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    single = F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(s.contains("'") & ~s.contains('"'), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(single)


def _python_list(strings: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(strings, lambda s: F.coalesce(_python_text(s), F.lit("None"))), ", "), F.lit("]"))


def _python_items(items: Column) -> Column:
    """A list of VARIANT values as Python prints it; lists and objects in it keep their JSON form."""

    def shown(x: Column) -> Column:
        t = F.schema_of_variant(x)
        return (
            F.when(t.isNull() | (t == "VOID"), "None").when(t == "BOOLEAN", _python_bool(F.try_variant_get(x, "$", "boolean")))
            .when(t.rlike("^(BIGINT|INT|SMALLINT|TINYINT)"), F.try_variant_get(x, "$", "bigint").cast("string"))
            .when(t.rlike("^(FLOAT|DOUBLE|DECIMAL)"), _python_float(F.try_variant_get(x, "$", "double")))
            .when(t.startswith("ARRAY") | t.startswith("OBJECT"), F.to_json(x)).otherwise(_python_text(F.try_variant_get(x, "$", "string"))))

    return F.concat(F.lit("["), F.array_join(F.transform(items, shown), ", "), F.lit("]"))


def _from_column(c: Column, dtype: T.DataType) -> Attribute:
    nothing = lambda t: lambda: F.lit(None).cast(t)
    never = lambda: F.lit(False)
    shared = {"present": c.isNotNull, "list_has": lambda: lambda value, fold: never(),
              "string": nothing("string"), "number": nothing("double"), "boolean": nothing("boolean")}
    kind = lambda word: lambda: F.when(c.isNotNull(), F.lit(word))
    if isinstance(dtype, T.VariantType):
        return _from_variant(c)
    if isinstance(dtype, T.BooleanType):
        return Attribute(**shared | {"number": lambda: c.cast("double"), "boolean": lambda: c, "kind": kind("boolean"), "text": lambda: _python_bool(c),
                                     "truthy": lambda: false_if_null(c), "json": lambda: F.to_json(F.array(c))})
    if isinstance(dtype, T.NumericType):
        is_float = isinstance(dtype, (T.DoubleType, T.FloatType))
        return Attribute(**shared | {"number": lambda: c.cast("double"), "kind": kind("number"),
                                     "text": lambda: _python_float(c.cast("double")) if is_float else c.cast("string"),
                                     "truthy": lambda: false_if_null(c != 0), "json": lambda: c.cast("string")})
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StringType):

        def has(value, fold):
            if not isinstance(value, str):
                return F.exists(c, lambda x: x.isNull()) if value is None else never()
            wanted = F.lit(value.lower() if fold else value)
            return F.exists(c, lambda x: (F.lower(x) if fold else x).eqNullSafe(wanted))

        return Attribute(**shared | {"kind": kind("list"), "list_has": lambda: has, "text": lambda: _python_list(c),
                                     "truthy": lambda: F.coalesce(F.size(c) > 0, never()), "json": lambda: F.to_json(c)})
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        word = "list" if isinstance(dtype, T.ArrayType) else "object"
        return Attribute(**shared | {"kind": kind(word), "text": lambda: F.to_json(c), "truthy": c.isNotNull, "json": lambda: F.to_json(c)})
    s = c.cast("string")  # text; dates and timestamps compare in ISO form
    return Attribute(**shared | {"string": lambda: s, "kind": kind("string"), "text": lambda: s,
                                 "truthy": lambda: false_if_null(s != ""), "json": lambda: F.to_json(F.array(s))})


_WHOLE, _REAL, _TEXT = "^(BIGINT|INT|SMALLINT|TINYINT)", "^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL)", "^(STRING|DATE|TIMESTAMP)"


def _from_variant(v: Column) -> Attribute:
    t = F.schema_of_variant(v)
    get = lambda kind: F.try_variant_get(v, "$", kind)
    items = lambda: F.when(t.startswith("ARRAY"), get("array<variant>"))

    def has(value, fold):
        return F.exists(items(), lambda x: _variant_equals(x, value, fold))

    def text() -> Column:
        return F.when(
            a.present,
            F.when(t.rlike(_TEXT), a.string).when(t == "BOOLEAN", _python_bool(a.boolean)).when(t.rlike(_WHOLE), get("bigint").cast("string"))
            .when(t.rlike(_REAL), _python_float(get("double"))).when(t.startswith("ARRAY"), _python_items(get("array<variant>"))).otherwise(F.to_json(v)))

    def truthy() -> Column:
        return false_if_null(
            F.when(t.rlike(_TEXT), a.string != "").when(t == "BOOLEAN", a.boolean).when(t.rlike(_REAL), get("double") != 0)
            .when(t.startswith("ARRAY"), F.size(get("array<variant>")) > 0).when(t.startswith("OBJECT"), t != "OBJECT<>"))

    a = Attribute(
        present=lambda: false_if_null(v.isNotNull() & (t != "VOID")),
        string=lambda: F.when(t.rlike(_TEXT), get("string")),  # dates and timestamps compare in ISO form
        boolean=lambda: F.when(t == "BOOLEAN", get("boolean")),
        number=lambda: F.when(t.rlike(_REAL), get("double")).when(t == "BOOLEAN", get("boolean").cast("double")),
        kind=lambda: (
            F.when(t.rlike(_TEXT), "string").when(t == "BOOLEAN", "boolean").when(t.rlike(_REAL), "number")
            .when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "object")),
        list_has=lambda: has, text=text, truthy=truthy, json=lambda: F.to_json(v))
    return a


def _variant_equals(item: Column, value, fold: bool) -> Column:
    t = F.schema_of_variant(item)
    if value is None:
        return t.isNull() | (t == "VOID")
    if isinstance(value, str):
        text = F.when(t == "STRING", F.try_variant_get(item, "$", "string"))
        return (F.lower(text) if fold else text).eqNullSafe(F.lit(value.lower() if fold else value))
    if isinstance(value, (bool, int, float)):
        number = F.when(t == "BOOLEAN", F.try_variant_get(item, "$", "boolean").cast("double")).when(
            t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL)"), F.try_variant_get(item, "$", "double"))
        return number.eqNullSafe(F.lit(float(value)))
    raise TypeError(f"a list check compares with text, numbers, booleans or null, not {type(value).__name__}")


def matches_glob(text: Column, pattern: str) -> Column:
    return false_if_null(text.rlike(glob_to_regex(pattern)))
