"""Secrets in texts, with weak finds linked to their other parts, in DataFrame functions only.

Some forms are secrets by themselves and always reported: ``assign`` (a word such as password or token, a sign and a value
of 8 or more characters), ``access`` (access key ids of 16 or more characters) and ``hex`` (32 or more hex digits). A credential in several parts
has weak parts: an ``identifier`` (user, login, client id), a ``key`` (a value after a vaguer word such as auth or key),
a ``blob`` (40 or more characters of base64 with upper case, lower case and digits) and an ``endpoint`` (a URL, or a host
after its word). These are reported only beside what completes them:

* ``key`` and ``blob``: an access key id, an identifier or an endpoint;
* ``identifier``: a secret of any kind;
* ``endpoint``: both an identifier (or access key id) and a secret.

Two parts belong together when no blank line is between them (the scope) and at most ``REACH`` code points. The parts
are rows; a scope is cut into buckets of ``REACH`` code points, in which each role is reduced to its least start and greatest end, and weak
parts are joined with the buckets that they reach, so the join grows with the number of parts and not with their pairs. Only
texts that hold complementary parts at all take part in it.

Matches of one kind are leftmost and do not overlap; those of different kinds may. Positions are code points, the end is
exclusive. A null text counts as empty; an empty text has no spans; a null id is an id like others; rows that repeat
are reported as often as they occur; columns besides id and text are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.session import materialise

REACH = 200
_SIGN = r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = r"([A-Za-z0-9+/_.=-]+)"


@dataclass(frozen=True)
class Form:
    """What a part looks like. ``least`` bounds its length, or that of its second group, from below."""

    kind: str
    role: str
    pattern: str
    hint: str
    least: int
    group: int = 0
    strong: bool = False
    needs: tuple[str, ...] = ()  # signs that the text must hold too


#: In the order of spans that start at one place. The first three stand alone.
FORMS = (
    Form("assign", "secret", rf"((?i:password|passwd|secret|token|api_?key)){_SIGN}{_VALUE}", "(?i)passw|secret|token|api_?key", 8, 2, True),
    Form("access", "identifier", "AKIA[A-Z0-9]+", "AKIA", 16, 0, True),
    Form("hex", "secret", "[0-9a-f]{32,}", "[0-9a-f]{32}", 32, 0, True),
    Form("identifier", "identifier", rf"((?i:access_?key_?id|client_?id|user_?name|user_?id|user|login)){_SIGN}([A-Za-z0-9+/_.@=-]+)",
         "(?i)access_?key_?id|client_?id|user|login", 3, 2),
    Form("key", "secret", rf"((?i:passphrase|pass|pwd|credentials?|private_?key|access_?key|auth|bearer|signature|key)){_SIGN}{_VALUE}",
         "(?i)pass|pwd|credential|key|auth|bearer|signature", 8, 2),
    Form("blob", "secret", "[A-Za-z0-9+/]{40,}", "[A-Za-z0-9+/]{40}", 40, 0, needs=("[A-Z]", "[a-z]", "[0-9]")),
    Form("endpoint", "endpoint", rf"((?i:https?|ftps?|sftp|ssh|jdbc:[a-z0-9]{{1,20}}|postgres|postgresql|mysql|mongodb|redis|amqps?|s3)://|(?i:host|hostname|endpoint|server){_SIGN})([A-Za-z0-9][A-Za-z0-9.:-]+)",
         "://|(?i)host|endpoint|server", 4, 2),
)
CUT = r"\n[ \t\r]*\n"
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
_BLOCK = 256


def _none() -> Column:
    return F.array().cast(_SPAN)


def _bound(value: Column, use) -> Column:
    """use(value) with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _running(steps: Column) -> Column:
    """The running sums of a non-empty array of numbers, in blocks, so that long arrays are not copied at each step."""
    starts = F.sequence(F.lit(1), F.size(steps), F.lit(_BLOCK))

    def add(state: Column, x: Column) -> Column:
        total = state["total"] + x
        return F.struct(total.alias("total"), F.array_append(state["sums"], total).alias("sums"))

    def shift(state: Column, block: Column) -> Column:
        return F.struct((state["total"] + block["total"]).alias("total"),
                        F.array_append(state["sums"], F.transform(block["sums"], lambda x: x + state["total"])).alias("sums"))

    first = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<bigint>").alias("sums"))
    blocks = F.transform(starts, lambda s: F.aggregate(F.slice(steps, s, _BLOCK), first, add))
    outer = F.struct(F.lit(0).cast("bigint").alias("total"), F.array().cast("array<array<bigint>>").alias("sums"))
    return F.flatten(F.aggregate(blocks, outer, shift)["sums"])


def _places(text: Column, pattern: str, hint: str, number: int, keep) -> Column:
    """The spans of all matches that ``keep`` accepts; the text between matches gives their places."""

    def spans(found: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found,
                           lambda gap, m: (F.length(gap) + F.length(m)).cast("bigint"))
        both = F.zip_with(found, _bound(steps, _running), lambda m, e: F.struct(m.alias("m"), e.alias("e")))
        return F.transform(F.filter(both, lambda s: keep(s["m"])), lambda s: F.struct(
            (s["e"] - F.length(s["m"])).alias("start"), F.lit(number).alias("kind"), s["e"].alias("end")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hits = _bound(found, lambda f: F.when(F.size(f) > 0, spans(f)))
    return F.coalesce(F.when(text.rlike(hint), hits), _none())


def _form_places(text: Column, number: int) -> Column:
    form = FORMS[number]

    def keep(match: Column) -> Column:
        value = F.regexp_extract(match, form.pattern, form.group) if form.group else match
        good = F.length(value) >= form.least
        for sign in form.needs:
            good = good & match.rlike(sign)
        return good

    return _places(text, form.pattern, form.hint, number, keep)


def _of(role: str, strong: bool | None = None) -> list[int]:
    return [i for i, f in enumerate(FORMS) if f.role == role and strong in (None, f.strong)]


def _any(parts: Column, kinds: list[int]) -> Column:
    return F.exists(parts, lambda p: p["kind"].isin(kinds))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """doc_id, base (the spans that stand alone), linked (the weak ones that are completed): arrays of (start, kind, end)
    in the order of start and kind, where kind is a place in ``FORMS``. One row per row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    strong = [i for i, f in enumerate(FORMS) if f.strong]
    blob = next(i for i, f in enumerate(FORMS) if f.kind == "blob")
    plain = [i for i, f in enumerate(FORMS) if not f.strong and i != blob]
    rows = (
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
        .withColumn("base", F.concat(*[_form_places(text, i) for i in strong]))
        .withColumn("weak", F.concat(*[_form_places(text, i) for i in plain])))
    # a bare blob needs an identifier or an endpoint, so most texts are not searched for one
    near_blob = _any(F.col("base"), _of("identifier")) | _any(F.col("weak"), _of("identifier") + _of("endpoint"))
    rows = rows.withColumn("weak", F.concat("weak", F.when(near_blob, _form_places(text, blob)).otherwise(_none())))
    every = F.concat("base", "weak")
    open_ = (F.size("weak") > 0) & _any(every, _of("secret")) & (_any(every, _of("identifier")) | _any(every, _of("endpoint")))
    cuts = _places(text, CUT, CUT, len(FORMS), lambda m: F.lit(True))
    found = materialise(rows.select(
        "doc_id", "base", F.when(open_, F.col("weak")).otherwise(_none()).alias("weak"), F.when(open_, cuts).otherwise(_none()).alias("cuts"),
        F.when(open_, F.struct("doc_id", F.sha2(text.cast("binary"), 256).alias("digest"))).alias("key")), "secret-parts")
    linked = _linked(found.where(F.col("key").isNotNull()).dropDuplicates(["key"]), reach)
    whole = F.array_sort("base").alias("base")
    alone = found.where(F.col("key").isNull()).select("doc_id", whole, _none().alias("linked"))
    joined = found.where(F.col("key").isNotNull()).join(linked, "key", "left")
    return alone.unionByName(joined.select("doc_id", whole, F.coalesce("linked", _none()).alias("linked")))


def _linked(texts: DataFrame, reach: int) -> DataFrame:
    """key, linked: the weak spans that are completed, per text."""
    part = texts.select("key", F.explode(F.concat("base", "weak", "cuts")).alias("p")).select("key", "p.*")
    is_cut = F.col("kind") == len(FORMS)
    scope = F.sum(is_cut.cast("bigint")).over(Window.partitionBy("key").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, 0))
    part = part.withColumn("scope", scope).where(~is_cut)

    def bucket(place: Column) -> Column:
        return F.floor(place / reach).cast("bigint")

    roles = {r: F.col("kind").isin(_of(r)) for r in ("identifier", "secret", "endpoint")}
    role = F.when(roles["identifier"], "identifier").when(roles["secret"], "secret").otherwise("endpoint")
    sides = (
        part.withColumn("role", role).withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("end") - 1))))
        .groupBy("key", "scope", "bucket", "role").agg(F.min("start").alias("first"), F.max("end").alias("last")))
    weak = part.where(F.col("kind").isin([i for i, f in enumerate(FORMS) if not f.strong])).withColumn(
        "bucket", F.explode(F.sequence(bucket(F.col("start") - reach - 1), bucket(F.col("end") + reach))))
    before, after = F.col("bucket") < bucket(F.col("start")), F.col("bucket") > bucket(F.col("end") - 1)
    near = F.when(before, F.col("start") - F.col("last") <= reach).when(after, F.col("first") - F.col("end") <= reach).otherwise(True)
    has = {r: F.bool_or(F.col("role") == r).alias(f"has_{r}") for r in roles}
    beside = weak.join(sides, ["key", "scope", "bucket"]).where(near).groupBy("key", "start", "kind", "end").agg(*has.values())
    complete = (
        F.when(roles["secret"], F.col("has_identifier") | F.col("has_endpoint"))
        .when(roles["identifier"], F.col("has_secret")).otherwise(F.col("has_identifier") & F.col("has_secret")))
    return beside.where(complete).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(f.kind) for f in FORMS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    number = next(i for i, f in enumerate(FORMS) if f.kind == kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("bigint")
