"""Row-wise operators: schema fitting, nested records, dictionaries, prefixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graintable.functions import columns as C


def ensure_columns(df: DataFrame, schema: str, alias: Mapping[str, str] | None = None) -> DataFrame:
    """df renamed by alias and fitted to schema: missing columns are null, others are cast, further ones go."""
    df = df.withColumnsRenamed(dict(alias or {}))
    wanted = StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def validate_structs(df: DataFrame, column: str, spec: Mapping[str, tuple]) -> DataFrame:
    """Fields of an array of structs by spec: ('range', lo, hi) nulls others, ('enum', values) makes others 'other', ('text', words) cleans."""
    def one(s: Column) -> Column:
        for name, (kind, *args) in spec.items():
            c = s[name]
            if kind == "range":
                new = C.null_outside(c, *args)
            elif kind == "enum":
                new = F.when(c.isin(args[0]), c).when(c.isNotNull(), "other")
            else:
                new = C.clean_null(c, args[0])
            s = s.withField(name, new)
        return s

    return df.withColumn(column, F.transform(column, one))


def flatten(df: DataFrame, structs: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in structs], *[F.col(f"{s}.*") for s in structs])


def drop_by_prefix(df: DataFrame, column: str, prefixes: Sequence[str]) -> DataFrame:
    """Rows whose text begins, in any case and after spaces, tabs and line feeds, with one of the words go; null texts stay.

    A word ends before anything but an ASCII letter, digit or underscore, on every Java version (its \\b isn't the same on all).
    """
    pattern = r"(?i)^[ \t\n]*(?:" + "|".join(prefixes) + r")(?:[^a-z0-9_]|$)"
    return df.where(~F.lower(F.coalesce(F.col(column), F.lit(""))).rlike(pattern))


def extract_dictionary(df: DataFrame, column: str, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """df with labels: the sorted distinct names whose terms occur in the text."""
    return df.withColumn("labels", F.array_sort(C.tag_keywords(F.col(column), list(rules.items()))))


def extract_named(df: DataFrame, column: str, entries: Sequence[tuple[str, str, Sequence[str]]], endings: str) -> DataFrame:
    """df with labels and names (sorted distinct arrays) of the entries (label, name, patterns) found in a text, in any case.

    The name is put together from what was found: if the first pattern's match holds one of the endings (a pattern of one group), the entry's first word
    and that ending; else the entry's own name. Null texts give empty arrays. For dictionaries of any size in a table, see phrase_spans().
    """
    text = F.coalesce(F.col(column), F.lit(""))
    cells = []
    for label, name, patterns in entries:
        found = F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?i){p}", 0), F.lit("")) for p in patterns])
        ending = F.nullif(F.lower(F.regexp_extract(found, f"(?i){endings}", 1)), F.lit(""))
        cells.append(F.when(found.isNotNull(), F.struct(F.lit(label).alias("label"), F.coalesce(F.concat(F.lit(name.split()[0] + " "), ending), F.lit(name)).alias("name"))))
    hits = F.array_compact(F.array(*cells))
    return df.withColumns({"labels": F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["label"]))), "names": F.array_sort(F.array_distinct(F.transform(hits, lambda x: x["name"])))})
