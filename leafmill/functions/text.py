"""Small text functions as Columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.attributes import try_json

# HTML entities that pages use, and the text they stand for. ``&amp;`` comes last.
ENTITIES = (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
)


def word_count(text: Column) -> Column:
    """Number of blank-separated words."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("bigint")


def split_count(text: Column) -> Column:
    """Number of pieces between single spaces; empty text has one."""
    return F.size(F.split(text, " ", -1)).cast("bigint")


def slug(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit(" "), F.lit("-")))


def url_domain(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def unquote(text: Column) -> Column:
    """Drop blanks, then double, then single quotes around the text."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), '^"+|"+$', ""), "^'+|'+$", "")


def split_kv(text: Column) -> tuple[Column, Column]:
    """Property and value at the first ``=``; both null without one."""
    has = F.instr(text, "=") > 0
    parts = F.split(text, "=", 2)
    return F.when(has, F.trim(parts[0])), F.when(has, unquote(F.get(parts, F.lit(1))))


def literal_kind(text: Column) -> Column:
    """number, boolean, null, list, object, string (quoted) or text."""
    low = F.lower(text)
    # lists and objects are told by their first sign; all other text is not parsed
    parsed = F.when(text.rlike(r"^\s*[\[{]"), F.schema_of_variant(try_json(F.translate(text, "'", '"'))))
    return (
        F.when(text.rlike(r"^[+-]?(0+(_?0)*|[1-9](_?\d)*)$") | text.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+(?=[eE]))([eE][+-]?\d+)?$"), "number")
        .when(low.isin("true", "false"), "boolean")
        .when(low.isin("null", "none"), "null")
        .when(parsed.startswith("ARRAY"), "list")
        .when(parsed.startswith("OBJECT"), "object")
        .when(text.rlike("""^("[^"]*"|'[^']*')$"""), "string")
        .otherwise("text")
    )


def parse_literal(text: Column) -> Column:
    """Text as a typed VARIANT: the Python-style literal it spells, else the text itself."""
    kind = literal_kind(text)
    bare = F.replace(text, F.lit("_"), F.lit(""))
    whole = text.rlike(r"^[+-]?[0-9_]+$")
    return (
        F.when((kind == "number") & whole, bare.try_cast("bigint").cast("variant"))
        .when(kind == "number", bare.try_cast("double").cast("variant"))
        .when(kind == "boolean", (F.lower(text) == "true").cast("variant"))
        .when(kind == "null", F.parse_json(F.lit("null")))
        .when(kind.isin("list", "object"), try_json(F.translate(text, "'", '"')))
        .when(kind == "string", F.regexp_replace(text, "^.|.$", "").cast("variant"))
        .otherwise(text.cast("variant"))
    )


def requirement_name(spec: Column) -> Column:
    """Package name of a requirement: without marker, version and bracket."""
    head = F.trim(F.split_part(spec, F.lit(";"), F.lit(1)))
    name = F.trim(F.regexp_replace(head, r"(==|>=|<=|~=|!=|>|<).*$", ""))
    return F.regexp_replace(name, r"\[.*$", "")


def requires_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Metadata lines ``Requires-Dist: pkg; extra == 'x'`` as (extra, requirement), other lines dropped."""
    field, line = "Requires-Dist:", F.col(column)
    content = F.substr(line, F.lit(len(field) + 1))
    requirement = F.trim(F.split_part(content, F.lit(";"), F.lit(1)))
    marker = F.substr(content, F.length(F.split_part(content, F.lit(";"), F.lit(1))) + 2)
    # without blanks and with one kind of quotes, the name stands between extra==' and the next quote
    plain = F.translate(marker, '"\t ', "'")
    sign = "extra=='"
    at = F.instr(F.lower(plain), sign)
    extra = F.split_part(F.substr(plain, at + len(sign)), F.lit("'"), F.lit(1))
    rest = [c for c in lines.columns if c != column]
    named = lines.where(line.startswith(field) & (at > 0))
    return named.select(*rest, extra.alias("extra"), requirement.alias("requirement")).where("extra <> ''")


def topics(text: Column, keywords: list[str]) -> Column:
    """The keywords that occur in the text, upper or lower case, in list order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k.lower())), F.lit(k)) for k in keywords]))


# -- prompts --------------------------------------------------------------------------------


def render_prompt(template: str, variables: dict[str, Column]) -> Column:
    """Fill ``{name}`` places. A name without a Column is an error at once; a null value makes the prompt null."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in variables:
                raise ValueError(f"Missing prompt variable: '{name}'")
            parts.append(variables[name].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def stop_sequences(stop: Column) -> Column:
    """VARIANT text, list or object as a list of texts; null stays null."""
    kind = F.schema_of_variant(stop)
    return (
        F.when(kind == "STRING", F.array(F.try_variant_get(stop, "$", "string")))
        .when(kind.startswith("ARRAY"), F.try_variant_get(stop, "$", "array<string>"))
        .when(kind.startswith("OBJECT"), F.map_values(F.try_variant_get(stop, "$", "map<string,string>")))
    )


def completion_request(model: Column, prompt: Column, temperature=None, top_p=None, max_tokens=None, stop=None) -> Column:
    """JSON request for a completion provider; options that are null are left out."""
    options = {"temperature": temperature, "top_p": top_p, "max_tokens": max_tokens, "stop": stop}
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    given = [c.alias(k) for k, c in options.items() if c is not None]
    return F.to_json(F.struct(model.alias("model"), F.array(message).alias("messages"), *given))


# -- pages ----------------------------------------------------------------------------------


def unescape(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def page_title(html: Column) -> Column:
    return F.trim(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def page_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments, the head and tags go; blanks collapse."""
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?is)<title[^>]*>.*?</title>", r"(?s)<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(F.regexp_replace(unescape(html), r"\s+", " "))
