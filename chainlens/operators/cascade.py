"""Q5 for any foreign-key graph: what a deletion takes with it.

Foreign keys are (child, column, parent, parent column, action) as in ``schema.FOREIGN_KEYS``, and
refer to primary keys.  The graph is closed table by table, parents first: a row goes if it is asked for or if *any* of its
cascading parents goes, so diamonds need no case of their own.  Tables that refer to each other in
a circle (or to themselves) are closed together, round after round, until no new row goes.
``set_null`` columns of rows that stay lose their value; rows that stay and still refer to a
deleted row by a ``no_action`` key are reported, for in the source system they would forbid the
deletion.

Rows with a NULL or dangling reference have no parent that goes, and stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainlens.session import written


def closure_order(foreign_keys: list[tuple]) -> list[list[str]]:
    """The tables of the cascading keys in groups, parents first; a group is a circle or one table."""
    parents: dict[str, set[str]] = {}
    for child, _, parent, _, action in foreign_keys:
        parents.setdefault(parent, set())
        parents.setdefault(child, set())
        if action == "cascade":
            parents[child].add(parent)

    def above(t: str) -> set[str]:
        seen, todo = set(), [t]
        while todo:
            for p in parents[todo.pop()] - seen:
                seen.add(p)
                todo.append(p)
        return seen

    reach = {t: above(t) for t in parents}
    groups = {t: frozenset({t} | {u for u in reach[t] if t in reach[u]}) for t in parents}
    # with itself, a table has more ancestors than each ancestor outside its circle
    return [sorted(g) for g in sorted(set(groups.values()), key=lambda g: (len(g | reach[min(g)]), min(g)))]


def _children_of(rows: DataFrame, fk: str, gone: DataFrame) -> DataFrame:
    return rows.join(gone.select(F.col(gone.columns[0]).alias(fk)), fk, "left_semi")


def cascade(tables: dict[str, DataFrame], foreign_keys: list[tuple], keys: dict[str, str],
            asked: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """(the tables after the deletion, blocked), by the primary keys ``keys`` of the ``asked`` rows.

    Only tables that change are in the result.  ``blocked``: (child_table, fk_column, rows) of the
    ``no_action`` keys, those without such rows included; None without such a key.
    """
    known = [k for k in foreign_keys if k[0] in tables and k[2] in tables]
    spark = next(iter(tables.values())).sparkSession
    has_children = {parent for _, _, parent, _, _ in known}
    gone: dict[str, DataFrame] = {}

    def keep(table: str, frames: list[DataFrame]) -> DataFrame:
        return written(spark, reduce(lambda a, b: a.unionByName(b), frames).distinct(), f"gone-{table}")

    def found(table: str, by: dict[str, DataFrame]) -> list[DataFrame]:
        """Keys of the rows of ``table`` that go with the parents' rows in ``by``."""
        return [_children_of(tables[table], fk, by[parent]).select(keys[table])
                for child, fk, parent, _, action in known if child == table and action == "cascade" and parent in by]

    for group in closure_order(known):
        new = {}
        for table in group:
            start = found(table, gone)
            if table in asked:
                start.append(tables[table].join(asked[table].select(keys[table]), keys[table], "left_semi").select(keys[table]))
            if start and (table in has_children or len(group) > 1):
                new[table] = keep(table, start)
        gone |= new
        circle = any(child in group and parent in group and action == "cascade" for child, _, parent, _, action in known)
        while circle and new:
            step = {t: found(t, new) for t in group}
            new = {t: keep(t, [f.join(gone[t], keys[t], "left_anti") if t in gone else f for f in frames])
                   for t, frames in step.items() if frames}
            new = {t: df for t, df in new.items() if not df.isEmpty()}
            gone |= {t: gone[t].unionByName(df) if t in gone else df for t, df in new.items()}

    after = {t: df.join(asked[t].select(keys[t]).distinct(), keys[t], "left_anti") if t in asked else df for t, df in tables.items()}
    changed = set(asked)
    blocked = []
    for child, fk, parent, _, action in known:
        if parent not in gone:
            continue
        lost = gone[parent].select(F.col(keys[parent]).alias(fk)).distinct()
        rows = after[child]
        if action == "cascade":
            after[child] = rows.join(lost, fk, "left_anti").select(*rows.columns)
            changed.add(child)
        elif action == "set_null":
            kind = rows.schema[fk].dataType
            after[child] = rows.join(lost.withColumn("_gone", F.lit(True)), fk, "left").select(
                *[F.when(F.col("_gone"), F.lit(None).cast(kind)).otherwise(F.col(fk)).alias(fk) if c == fk else F.col(c)
                  for c in rows.columns])
            changed.add(child)
    for child, fk, parent, _, action in known:
        if action not in ("cascade", "set_null"):
            lost = (_children_of(after[child], fk, gone[parent]) if parent in gone else after[child].limit(0))
            blocked.append(lost.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(child).alias("child_table"), F.lit(fk).alias("fk_column"), "rows"))
    return ({t: after[t].select(*tables[t].columns) for t in changed},
            reduce(lambda a, b: a.unionByName(b), blocked) if blocked else None)
