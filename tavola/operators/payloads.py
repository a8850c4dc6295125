"""Nested JSON payloads as typed columns, with what does not fit reported by path.

A payload is parsed once into a VARIANT and its fields are cut out by path, so payloads need no common
shape. What is not declared and what has another type is listed by path, sorted.

Defined results: a null text, or one that is no JSON, has null fields, empty lists and `is_json` false; a field
that is missing or a JSON null is null and not ill-typed; a value that is no object where fields are
declared below it is ill-typed at its own path, and the fields below are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OBJECT = "map<string,variant>"
NONE = "array<string>"


def _under(parent: str, names: Column) -> Column:
    """Paths of names below `parent` ('' for the top)."""
    return F.transform(names, lambda k: F.concat(F.lit(f"{parent}." if parent else ""), k))


def typed_payload(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """`df` with its JSON `column` replaced by a column for each field, `unknown_paths`, `ill_typed` and `is_json`.

    `fields` maps paths (`a`, `a.b`) to SQL types; a field's column has the path with `_` for `.`.
    """
    parents = sorted({p.rsplit(".", n)[0] for p in fields for n in range(1, p.count(".") + 1)})
    overlap = set(parents) & set(fields)
    if overlap:
        raise ValueError(f"declared both as value and as object: {sorted(overlap)}")
    v = F.col("_v")

    def at(path: str, kind: str) -> Column:
        return F.try_variant_get(v, f"$.{path}", kind)

    def present(path: str) -> Column:
        found = at(path, "variant")
        return found.isNotNull() & ~F.is_variant_null(found)

    ill = [F.when(present(p) & at(p, kind).isNull(), F.lit(p)) for p, kind in fields.items()]
    ill += [F.when(present(p) & at(p, OBJECT).isNull(), F.lit(p)) for p in parents]
    children: dict[str, set[str]] = {}
    for path in [*fields, *parents]:
        parent, _, name = path.rpartition(".")
        children.setdefault(parent, set()).add(name)
    unknown = []
    for parent, names in sorted(children.items()):
        held = at(parent, OBJECT) if parent else F.try_variant_get(v, "$", OBJECT)
        strange = F.array_except(F.coalesce(F.map_keys(held), F.array().cast(NONE)), F.array(*[F.lit(n) for n in sorted(names)]))
        unknown.append(_under(parent, strange))
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.try_parse_json(column).alias("_v")).select(
        *others,
        *[at(p, kind).alias(p.replace(".", "_")) for p, kind in fields.items()],
        F.array_sort(F.concat(*unknown)).alias("unknown_paths"),
        F.array_sort(F.array_compact(F.array(*ill))).alias("ill_typed"),
        v.isNotNull().alias("is_json"),
    )
