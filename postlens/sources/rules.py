"""Checks compiled from a nested schema of items.

A rule tree is a dict as in JSON schema (``properties``, ``required``, ``pattern``,
``enum``, ``unique``, ``items``); :func:`compile_rules` walks it together with the type of
the column and makes one Column per rule, named by its path.  The tree below is the
contract of batch documents: item, the whole analysis, and the collection fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.sources import schema as S


def _numbers(names: list[str]) -> dict:
    return {"properties": {n: {} for n in names}, "required": names}


ANALYSIS_RULES = {
    "required": S.ANALYSIS_REQUIRED,
    "properties": {
        "classification": {"properties": {"label": {}, "score": {}}}, "language_score": {}, "sentiment": {}, "source_type": {},
        "embedding": {"items": {}}, "gender": _numbers(S.GENDERS), "text_type": _numbers(S.TEXT_TYPES),
        "emotion": _numbers(S.EMOTIONS), "irony": _numbers(S.IRONY), "age": _numbers(S.AGES),
        "top_keywords": {"items": {}, "unique": True}}}
ITEM_RULES = {
    "required": S.ITEM_REQUIRED,
    "properties": {**{f: {} for f in S.ITEM_FIELDS}, "created_at": {"pattern": S.ISO_PATTERN}, "url": {"pattern": S.URL_PATTERN},
                   "picture": {"pattern": S.URL_PATTERN}}}
PROCESSED_RULES = {
    "required": S.PROCESSED_REQUIRED,
    "properties": {"item": ITEM_RULES, "analysis": ANALYSIS_RULES, "collection_client_version": {}, "collection_module": {},
                   "collected_at": {"pattern": S.ISO_PATTERN}}}
BATCH_ITEM_RULES = {**PROCESSED_RULES, "required": [*S.PROCESSED_REQUIRED, "kind"],
                    "properties": {**PROCESSED_RULES["properties"], "kind": {"enum": S.BATCH_KINDS}}}


def compile_rules(rules: dict, value: Column, kind: T.DataType, path: str = "") -> list[Column]:
    """One Column per rule: the rule's name and path where it is broken, else null.

    A rule on a field counts only where the object that holds it is there; a required field
    that the type doesn't have is missing in every object.
    """
    at = f"{path}." if path else ""
    there = value.isNotNull() if path else F.lit(True)
    out: list[Column] = []

    def broken(condition: Column, name: str) -> None:
        out.append(F.when(F.coalesce(condition, F.lit(False)), F.lit(name)))
    if "pattern" in rules:
        broken(~value.rlike(rules["pattern"]), f"pattern:{path}")
    if "enum" in rules:
        broken(~value.isin(rules["enum"]), f"enum:{path}")
    if rules.get("unique"):
        broken(F.size(F.array_distinct(value)) != F.size(value), f"unique:{path}")
    if "items" in rules and isinstance(kind, T.ArrayType):
        broken(F.exists(value, lambda x: x.isNull()), f"null:{path}[]")
        for c in ("pattern", "enum"):
            if c in rules["items"]:
                test = (lambda x: ~x.rlike(rules["items"][c])) if c == "pattern" else (lambda x: ~x.isin(rules["items"][c]))
                broken(F.exists(value, test), f"{c}:{path}[]")
    fields = {f.name: f.dataType for f in kind.fields} if isinstance(kind, T.StructType) else {}
    for name in rules.get("required", []):
        child = value[name] if name in fields else F.lit(None)
        broken(there & child.isNull(), f"missing:{at}{name}")
    for name, inner in rules.get("properties", {}).items():
        if name in fields:
            out += compile_rules(inner, value[name], fields[name], f"{at}{name}")
    return out


def with_violations(df: DataFrame, rules: dict = BATCH_ITEM_RULES, out: str = "violations") -> DataFrame:
    """``df`` with the sorted array of all rules that a row breaks, by path (empty: valid).

    The row itself is the object that ``rules`` describe, its columns the properties.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    checks = compile_rules(rules, row, df.schema)
    return df.withColumn(out, F.array_sort(F.filter(F.array(*checks), lambda x: x.isNotNull())))
