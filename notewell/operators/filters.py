"""Row filters of a result list. All are column predicates; what they keep on nulls is part of their meaning."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name

HIDDEN = ("inactive", "hidden")


def min_score(rows: DataFrame, least: float, score: str = "similarity") -> DataFrame:
    return rows.filter(F.coalesce(F.col(score), F.lit(0.0)) >= least)


def visible(rows: DataFrame, status: str = "status") -> DataFrame:
    """Drops inactive and hidden rows; rows without a status stay."""
    return rows.filter(~F.coalesce(F.col(status), F.lit("active")).isin(*HIDDEN))


@dataclass(frozen=True)
class Wanted:
    """Values to keep (any of them, if given) and values to drop."""

    include: Sequence = ()
    exclude: Sequence = ()

    def __bool__(self) -> bool:
        return bool(self.include or self.exclude)

    def predicate(self, any_of) -> Column:
        keep = any_of(self.include) if self.include else F.lit(True)
        return keep & ~any_of(self.exclude) if self.exclude else keep


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def type_is(wanted: Wanted, types: str = "types") -> Column:
    own = F.coalesce(F.col(types), F.array().cast("array<string>"))
    return wanted.predicate(lambda values: F.arrays_overlap(own, _strings(values)))


def tag_is(wanted: Wanted, tags: str = "tags") -> Column:
    """Without leading #, in lower case on both sides."""
    own = F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: F.lower(F.regexp_replace(t, "^#+", "")))
    return wanted.predicate(lambda values: F.arrays_overlap(own, _strings([v.lstrip("#").lower() for v in values])))


def property_is(wanted: Wanted, properties: str = "frontmatter") -> Column:
    """(name, value) pairs; incomplete pairs never match, so that nothing but those to include keeps nothing."""

    def any_of(pairs: Sequence[tuple[str, str]]) -> Column:
        return _any([F.coalesce(F.lower(F.col(properties)[p]) == str(v).lower(), F.lit(False)) for p, v in pairs if p and v])

    return wanted.predicate(any_of)


def path_has(wanted: Wanted, path: str = "relative_path") -> Column:
    return wanted.predicate(lambda parts: _any([F.contains(F.col(path), F.lit(p)) for p in parts]))


def file_has(wanted: Wanted, path: str = "relative_path") -> Column:
    return wanted.predicate(lambda parts: _any([F.contains(base_name(path), F.lit(p)) for p in parts]))


@dataclass(frozen=True)
class QueryFilter:
    types: Wanted = Wanted()
    properties: Wanted = Wanted()
    tags: Wanted = Wanted()
    paths: Wanted = Wanted()
    files: Wanted = Wanted()

    def steps(self) -> list[tuple[str, Column]]:
        every = (
            ("types", self.types, type_is),
            ("properties", self.properties, property_is),
            ("tags", self.tags, tag_is),
            ("paths", self.paths, path_has),
            ("files", self.files, file_has),
        )
        return [(name, make(wanted)) for name, wanted, make in every if wanted]


def apply_filter(rows: DataFrame, wanted: QueryFilter) -> DataFrame:
    return reduce(lambda df, step: df.filter(step[1]), wanted.steps(), rows)


def allowed_files(docs: DataFrame, paths: Sequence[str] = (), files: Sequence[str] = ()) -> DataFrame | None:
    """Ids of notes whose path and name match what is to be included; None when nothing is."""
    if not paths and not files:
        return None
    rows = docs.filter(F.col("relative_path").endswith(".md"))
    rows = rows.filter(path_has(Wanted(paths))) if paths else rows
    rows = rows.filter(file_has(Wanted(files))) if files else rows
    return rows.select("doc_id")
