"""The whole schema of batch documents over items with one planted fault each."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.plans.registry import register
from postlens.sources import rules
from postlens.sources import schema as S
from postlens.tables import Tables
from postlens.views import v_items

KIND = T.StructType([*S.PROCESSED.fields, T.StructField("kind", T.StringType())])


def _required(rule: dict, path: str = "") -> list[str]:
    own = [f"{path}{n}" for n in rule.get("required", [])]
    return own + [p for n, inner in rule.get("properties", {}).items() for p in _required(inner, f"{path}{n}.")]


#: A fault for every rule: required fields are taken out, the others get a value that breaks them.
MISSING = _required(rules.BATCH_ITEM_RULES)
BROKEN = {"pattern:item.created_at": "2024-01-01 00:00:00", "pattern:item.url": "ftp://x.com/p", "pattern:item.picture": "no picture",
          "pattern:collected_at": "yesterday", "enum:kind": "BOGUS", "unique:analysis.top_keywords": ["a", "b", "a"],
          "null:analysis.embedding[]": [0.5, None], "null:analysis.top_keywords[]": ["a", None]}
FAULTS = [*(f"missing:{p}" for p in MISSING), *BROKEN]
EVERY = len(FAULTS) + 5  # the rest of each round is valid


def planted(items, key: str = "item_id"):
    """Batch items of full shape whose key modulo EVERY names the fault, if any."""
    k = F.col(key) % EVERY
    plain = {"item.created_at": F.lit("2024-01-02T03:04:05.123Z"), "item.url": F.col("url"), "item.language": F.col("language"),
             "item.domain": F.col("domain"), "item.author": F.col("author"), "item.picture": F.lit("https://x.com/a.png"),
             "collected_at": F.lit("2024-01-02T03:04:06Z"), "kind": F.lit("SPOTTING"), "analysis.source_type": F.lit("news"),
             "analysis.classification.label": F.lit("topic"), "analysis.top_keywords": F.array("domain", "author", "language"),
             "collection_client_version": F.lit("v1"), "collection_module": F.lit("m")}

    def build(kind: T.DataType, path: str):
        if path in plain:
            value = plain[path].cast(kind)
        elif isinstance(kind, T.StructType):
            value = F.struct(*[build(f.dataType, f"{path}.{f.name}" if path else f.name).alias(f.name) for f in kind.fields])
        elif isinstance(kind, T.ArrayType):
            value = F.array(F.lit(0.25), F.lit(0.5)).cast(kind)
        elif isinstance(kind, T.DoubleType):
            value = (F.col(key) % 100 / 100).cast(kind)
        else:
            value = F.lit(None).cast(kind)
        for no, fault in enumerate(FAULTS):
            name, at = fault.split(":")
            if at.removesuffix("[]") == path:
                bad = F.lit(None) if name == "missing" else F.array(*map(F.lit, BROKEN[fault])) if isinstance(kind, T.ArrayType) else F.lit(BROKEN[fault])
                value = F.when(k == no, bad.cast(kind)).otherwise(value)
        return value
    return items.select(key, *[build(f.dataType, f.name).alias(f.name) for f in KIND.fields])


@register("validate_processed", f"""
SELECT doc_id AS item_id, CASE doc_id % {EVERY} {" ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FAULTS))} ELSE '' END AS violations
FROM documents""")
def _validate_processed(spark, sf):
    items = planted(v_items(Tables(spark, sf)))
    return rules.with_violations(items).select("item_id", F.array_join("violations", ",").alias("violations"))
