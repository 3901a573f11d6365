"""Stage definitions and their requirements as boolean Columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.attributes import Attribute, attribute, false_if_null, matches_glob
from leafmill.functions.globs import java_regex
from leafmill.operators.filters import equals, everything

LIST_HAS = ("HAS", "CONTAINS", "INCLUDES")
LIST_HAS_NOT = ("NOT_HAS", "NOT_CONTAINS", "NOT_INCLUDES")
RANGE = ("GT", "LT", "GTE", "LTE")
COMPARE = ("EQ", "NE", *RANGE)


@dataclass(frozen=True)
class Workflow:
    name: str
    version: int | None = None
    when: str = "true"
    inputs: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class FilePresence:
    key: str
    count: int = 1
    count_operator: str = ">="


@dataclass(frozen=True)
class AttributeCheck:
    attribute: str
    operator: str
    value: Any
    case_sensitive: bool = True


@dataclass(frozen=True)
class ListCheck:
    attribute: str
    operator: str
    value: Any
    case_sensitive: bool = True


@dataclass(frozen=True)
class Requirements:
    file_presence: FilePresence | None = None
    stages: dict[str, str] = field(default_factory=dict)  # stage name -> required status
    attribute_checks: tuple[AttributeCheck, ...] = ()
    list_checks: tuple[ListCheck, ...] = ()
    extras: tuple[str, ...] = ()
    tasks: tuple[str, ...] = ()


@dataclass(frozen=True)
class StageDefinition:
    name: str
    active: bool = True
    workflows: tuple[Workflow, ...] = ()
    requirements: Requirements | None = None
    multiple_callable: bool = False
    no_eval: bool = False


# -- single checks --------------------------------------------------------------------------


def attribute_check(docs: DataFrame, check: AttributeCheck) -> Column:
    """One attribute check. A missing attribute fails every operator, the negated ones too."""
    attr = attribute(docs, check.attribute)
    operator = check.operator.upper()
    value = check.value
    fold = not check.case_sensitive and isinstance(value, str)
    string = F.lower(attr.string) if fold else attr.string
    if fold:
        value = value.lower()
    if operator in COMPARE and isinstance(value, (str, bool, int, float)):
        is_text = isinstance(value, str)
        return _compared(attr, string if is_text else attr.number, operator, F.lit(value if is_text else float(value)), is_text)
    if operator in ("EQ", "NE", "IS", "IS_NOT"):
        same = _identical(attr, check.value) if operator.startswith("IS") else F.lit(False) if value is None else equals(attr, value)
        hit = ~same if operator in ("NE", "IS_NOT") else same
    elif operator in RANGE:
        hit = F.lit(False)  # neither text nor a number
    elif operator in ("CP", "NP"):
        glob = matches_glob(string, value) if isinstance(value, str) else F.lit(False)
        hit = ~glob if operator == "NP" else glob
    elif operator in ("REGEX", "NOT_REGEX"):
        # A pattern that does not compile matches nothing. Folding lowers the pattern as well as the text.
        pattern = java_regex(value) if isinstance(value, str) else None
        found = F.lit(False) if pattern is None else false_if_null(string.rlike(("(?iu)" if fold else "") + pattern))
        hit = ~found if operator == "NOT_REGEX" else found
    else:
        raise ValueError(f"unknown attribute operator {check.operator!r}")
    return false_if_null(attr.present & hit)


def _compared(attr: Attribute, left: Column, operator: str, value: Column, is_text: bool) -> Column:
    """One of ``COMPARE`` between the attribute's text or number and a value of the same kind."""
    outcome = {"EQ": left.__eq__, "NE": left.__eq__, "GT": left.__gt__, "LT": left.__lt__, "GTE": left.__ge__, "LTE": left.__le__}[operator](value)
    if operator in RANGE and not is_text:
        outcome = outcome & ~F.isnan(left)
    hit = false_if_null(outcome)
    return attr.present & (~hit if operator == "NE" else hit)


def _identical(attr: Attribute, value) -> Column:
    """Booleans and null by identity; other values by equality of the same type."""
    if value is None:
        return F.lit(False)
    if isinstance(value, bool):
        return false_if_null(attr.boolean == value)
    if isinstance(value, (int, float)):
        return false_if_null((attr.kind == "number") & (attr.number == float(value)))
    return equals(attr, value)


def type_conflict(docs: DataFrame, check: AttributeCheck) -> Column:
    """A range check whose attribute has a type that does not compare with the value."""
    if check.operator.upper() not in RANGE:
        return F.lit(False)
    attr = attribute(docs, check.attribute)
    comparable = attr.string if isinstance(check.value, str) else attr.number
    return false_if_null(attr.present & comparable.isNull())


def list_check(docs: DataFrame, check: ListCheck) -> Column:
    """A missing attribute or one that is not a list fails all six operators."""
    attr = attribute(docs, check.attribute)
    operator = check.operator.upper()
    has = false_if_null(attr.list_has(check.value, not check.case_sensitive and isinstance(check.value, str)))
    is_list = false_if_null(attr.kind == "list")
    if operator in LIST_HAS:
        return is_list & has
    if operator in LIST_HAS_NOT:
        return is_list & ~has
    raise ValueError(f"unknown list operator {check.operator!r}")


def file_presence(check: FilePresence) -> Column:
    """Number of file references with the key against the count; an unknown operator passes."""
    n = F.coalesce(F.size(F.filter("file_refs", lambda r: r["key"] == check.key)), F.lit(0))
    n = F.greatest(n, F.lit(0))
    outcomes = {">=": n.__ge__, "==": n.__eq__, ">": n.__gt__, "<=": n.__le__, "<": n.__lt__, "!=": n.__ne__}
    compare = outcomes.get(check.count_operator)
    return F.lit(True) if compare is None else compare(check.count)


def extras_gate(required: tuple[str, ...], installed: set[str]) -> Column:
    """All required extras installed. An extra without packages never counts as installed here."""
    return F.lit(all(extra in installed for extra in required))


def workflow_condition(workflow: Workflow) -> Column:
    """The ``when`` text of a workflow, a Spark SQL boolean over the document columns."""
    return false_if_null(F.expr(workflow.when or "true").try_cast("boolean"))


# -- existing stages ------------------------------------------------------------------------


def stage_state_column(name: str, status: str) -> str:
    return f"_has:{name}:{status}"


def needed_states(definitions: list[StageDefinition]) -> list[tuple[str, str]]:
    """Every (stage name, status) pair that some definition requires."""
    pairs = {(n, s) for d in definitions if d.requirements for n, s in d.requirements.stages.items()}
    return sorted(pairs)


def with_stage_states(docs: DataFrame, stages: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """One boolean per (stage name, status): does the document have such a stage?

    One aggregation with map-side combine and one join on the document, whatever the number of pairs.
    """
    if not pairs:
        return docs
    wanted = stages.where(F.col("name").isin(sorted({n for n, _ in pairs})))
    flags = [
        F.max((F.col("name") == n) & (F.col("status") == s)).alias(stage_state_column(n, s)) for n, s in pairs
    ]
    joined = docs.join(wanted.groupBy("doc_id").agg(*flags), "doc_id", "left")
    return joined.na.fill(False, [stage_state_column(n, s) for n, s in pairs])


def stage_requirement(docs: DataFrame, stages: DataFrame, required: dict[str, str]) -> DataFrame:
    """Documents that have, for every named stage, an instance with the required status."""
    for name, status in required.items():
        hits = stages.where((F.col("name") == name) & (F.col("status") == status)).select("doc_id").distinct()
        docs = docs.join(hits, "doc_id", "left_semi")
    return docs


# -- the whole requirement ------------------------------------------------------------------


def requirements_met(
    docs: DataFrame,
    definition: StageDefinition,
    installed: set[str] = frozenset(),
    stage_has=None,
) -> Column:
    """Compile a definition to one predicate.

    ``stage_has(name, status)`` gives the Column for a stage prerequisite; by default the flags of
    ``with_stage_states``.
    """
    if definition.no_eval:
        return F.lit(False)
    req = definition.requirements
    if req is None:
        return F.lit(True)
    stage_has = stage_has or (lambda n, s: F.col(f"`{stage_state_column(n, s)}`"))
    parts = []
    if req.extras:
        parts.append(extras_gate(req.extras, installed))
    if req.file_presence:
        parts.append(file_presence(req.file_presence))
    parts += [stage_has(n, s) for n, s in req.stages.items()]
    parts += [attribute_check(docs, c) for c in req.attribute_checks]
    parts += [list_check(docs, c) for c in req.list_checks]
    return everything(parts)


def sql_text(value: str) -> str:
    """A text as a literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _each(values: list, test: Callable[[Column], Column]) -> Column:
    return F.transform(F.lit(values), lambda v: test(v))


def quoted(column: str) -> str:
    """A column name in Spark SQL."""
    return "`" + column.replace("`", "``") + "`"


class RuleTable:
    """The checks of many definitions as data: equal checks count once, and comparisons of one attribute by one operator are
    one expression over the array of their values. ``hits`` has the outcome of every check as an array of booleans."""

    def __init__(self, docs: DataFrame, definitions: list[StageDefinition]):
        known: dict[str, Attribute] = {}
        groups: dict[tuple, list] = {}
        single: list = []
        # by their text, since True, 1 and 1.0 are equal but other values to a check
        for check in {repr(c): c for d in definitions for c in self._checks(d)}.values():
            if isinstance(check, AttributeCheck) and check.operator.upper() in COMPARE and isinstance(check.value, (str, bool, int, float)):
                is_text = isinstance(check.value, str)
                groups.setdefault((check.attribute, check.operator.upper(), is_text, is_text and not check.case_sensitive), []).append(check)
            else:
                single.append(check)
        parts: list[Column] = []
        self.places: dict[str, int] = {}
        for (name, operator, is_text, fold), checks in groups.items():
            attr = known.setdefault(name, attribute(docs, name))
            left = (F.lower(attr.string) if fold else attr.string) if is_text else attr.number
            values = [(c.value.lower() if fold else c.value) if is_text else float(c.value) for c in checks]
            compared = partial(_compared, attr, left, operator, is_text=is_text)
            parts.append(_each(values, compared))
            self._place(checks)
        if single:
            makers = {AttributeCheck: lambda c: attribute_check(docs, c), ListCheck: lambda c: list_check(docs, c), FilePresence: file_presence}
            parts.append(F.array(*[makers[type(c)](c) for c in single]))
            self._place(single)
        self.hits = F.concat(*parts) if parts else F.array().cast("array<boolean>")

    def _place(self, checks: list) -> None:
        for check in checks:
            self.places[repr(check)] = len(self.places)

    @staticmethod
    def _checks(definition: StageDefinition) -> list:
        req = definition.requirements
        if req is None or definition.no_eval:
            return []
        return [*([req.file_presence] if req.file_presence else []), *req.attribute_checks, *req.list_checks]

    def met(self, definition: StageDefinition, hits: str, installed: set[str]) -> str:
        """SQL text: whether the checks of a definition hold, without its stage prerequisites. ``hits`` names the column of the outcomes."""
        req = definition.requirements
        if definition.no_eval or (req and not all(extra in installed for extra in req.extras)):
            return "false"
        return " AND ".join([f"{hits}[{self.places[repr(c)]}]" for c in self._checks(definition)]) or "true"


def requirement_matrix(
    docs: DataFrame, stages: DataFrame, definitions: list[StageDefinition], installed: set[str] = frozenset()
) -> DataFrame:
    """Every document against every active definition: ``(doc_id, definition, met)``."""
    active = [d for d in definitions if d.active]
    base = with_stage_states(docs, stages, needed_states(active))
    cells = F.array(
        *[
            F.struct(F.lit(d.name).alias("definition"), requirements_met(base, d, installed).alias("met"))
            for d in active
        ]
    )
    return base.select("doc_id", F.inline(cells))


def type_conflicts(docs: DataFrame, definitions: list[StageDefinition]) -> DataFrame:
    """Rejects: documents whose attribute type makes a range check meaningless."""
    cells = [
        F.when(type_conflict(docs, c), F.struct(F.lit(d.name).alias("definition"), F.lit(c.attribute).alias("attribute")))
        for d in definitions
        if d.requirements
        for c in d.requirements.attribute_checks
    ]
    if not cells:
        cells = [F.lit(None).cast("struct<definition:string,attribute:string>")]
    return docs.select("doc_id", F.inline(F.array_compact(F.array(*cells))))
