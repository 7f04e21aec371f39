"""Units and the spaces that hold them: closure, filters, set operations, changes.

Tables: units (``uid`` and payload columns), members (``space, uid``), children (``parent, child``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def space_name(name: Column) -> Column:
    """A space's name without the prefix that marks it as a graph node."""
    return F.regexp_replace(name, "^ms:", "")


def closure(children: DataFrame, max_depth: int = 32) -> DataFrame:
    """``ancestor, space, depth``: every space below every parent, itself at depth 0, each once at its least depth.
    A cycle ends where it comes back; a child that isn't a space of its own is one without members."""
    links = children.select("parent", "child").where("parent is not null and child is not null and parent <> child").distinct()
    names = links.select(F.col("parent").alias("space")).unionByName(links.select(F.col("child").alias("space"))).distinct()
    found = names.select(F.col("space").alias("ancestor"), "space", F.lit(0).alias("depth"))
    front = found
    for depth in range(1, max_depth + 1):
        step = front.join(links, front.space == links.parent).select("ancestor", F.col("child").alias("space"), F.lit(depth).alias("depth")).distinct()
        front = step.join(found.select("ancestor", "space"), ["ancestor", "space"], "left_anti")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def units_in_spaces(units: DataFrame, members: DataFrame, names: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """Units of any of the spaces ``names`` (``space``) and, with ``children``, of those below them, each once; unknown names are skipped."""
    wanted = names.select(space_name(F.col("space")).alias("space")).distinct()
    if children is not None:
        wanted = _below(wanted, children)
    return units.join(members.join(wanted, "space", "left_semi").select("uid"), "uid", "left_semi")


def _below(wanted: DataFrame, children: DataFrame) -> DataFrame:
    lower = closure(children).select(F.col("ancestor"), F.col("space").alias("below"))
    return wanted.unionByName(wanted.join(lower, wanted.space == lower.ancestor).select(F.col("below").alias("space"))).distinct()


def candidates(units: DataFrame, members: DataFrame, names: DataFrame | None, uids: DataFrame | None) -> DataFrame | None:
    """What a search may find: the union of the spaces intersected with the candidate uids; None if neither is given. An
    empty list of candidates or spaces finds nothing."""
    out = None
    if names is not None:
        out = units_in_spaces(units, members, names).select("uid")
    if uids is not None:
        known = units.join(uids.select("uid").distinct(), "uid", "left_semi").select("uid")
        out = known if out is None else out.join(known, "uid", "left_semi")
    return out


def space_statistics(members: DataFrame, children: DataFrame) -> DataFrame:
    """By space: units in it and below it, in it directly, and spaces directly below."""
    tree = closure(children)
    recursive = tree.join(members, "space").groupBy(F.col("ancestor").alias("space")).agg(F.count_distinct("uid").alias("recursive_units"))
    direct = members.groupBy("space").agg(F.count_distinct("uid").alias("direct_units"))
    below = children.groupBy(F.col("parent").alias("space")).agg(F.count_distinct("child").alias("child_spaces"))
    every = tree.select("space").unionByName(members.select("space")).distinct()
    out = every.join(recursive, "space", "left").join(direct, "space", "left").join(below, "space", "left")
    return out.select("space", F.coalesce("recursive_units", "direct_units", F.lit(0)).alias("recursive_units"), F.coalesce("direct_units", F.lit(0)).alias("direct_units"), F.coalesce("child_spaces", F.lit(0)).alias("child_spaces"))


Condition = dict[str, dict[str, object]]


def condition(conditions: Condition, columns: set[str], payload: str | None = None) -> Column:
    """All conditions together: field -> {operator: value} with eq, ne, in, nin, gt, gte, lt, lte, contain, not_contain; unknown
    operators are ignored. A field is a column, else a key of the map ``payload``. Missing values: ne, nin and not_contain hold, the others don't."""
    tests: list[Column] = []
    for field, ops in conditions.items():
        c = F.col(field) if field in columns else F.try_element_at(F.col(payload), F.lit(field)) if payload else F.lit(None).cast("string")
        for op, v in ops.items():
            if op in ("eq", "ne"):
                same = c.eqNullSafe(F.lit(v))
                tests.append(same if op == "eq" else ~same)
            elif op in ("in", "nin"):
                inside = F.coalesce(c.isin(*v), F.lit(False))
                tests.append(inside if op == "in" else ~inside)
            elif op in ("gt", "gte", "lt", "lte"):
                value = c if field in columns else c.try_cast("double") if isinstance(v, (int, float)) else c
                test = {"gt": value > v, "gte": value >= v, "lt": value < v, "lte": value <= v}[op]
                tests.append(F.coalesce(test, F.lit(False)))
            elif op in ("contain", "not_contain"):
                inside = F.coalesce(F.contains(c.cast("string"), F.lit(str(v))), F.lit(False))
                tests.append(inside if op == "contain" else ~inside)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filter_units(units: DataFrame, conditions: Condition, payload: str | None = None, members: DataFrame | None = None, names: DataFrame | None = None, children: DataFrame | None = None) -> DataFrame:
    """Units that meet all conditions, of the given spaces if any."""
    inside = units_in_spaces(units, members, names, children) if members is not None and names is not None else units
    return inside.where(condition(conditions, set(units.columns), payload))


def deduplicated(units: DataFrame, order: str, key: str = "uid") -> DataFrame:
    """The first row of each key along ``order``."""
    w = Window.partitionBy(key).orderBy(order)
    return units.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def union(*parts: DataFrame) -> DataFrame:
    """Each unit once: from the first part that has it."""
    tagged = reduce(lambda a, b: a.unionByName(b), [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    return deduplicated(tagged, "_part").drop("_part")


def intersection(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Units of the first part whose uid is in all others."""
    return reduce(lambda a, b: a.join(b.select("uid"), "uid", "left_semi"), others, first)


def difference(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of the first part, repeats kept, whose uid is in no other."""
    return reduce(lambda a, b: a.join(b.select("uid"), "uid", "left_anti"), others, first)


def by_spaces(units: DataFrame, members: DataFrame, names: list[str], mode: str = "union") -> DataFrame:
    """Units of several spaces: in any (union, and any unknown mode), in all (intersection), or in the first only (difference)."""
    spark = units.sparkSession
    part = lambda n: units_in_spaces(units, members, spark.createDataFrame([(n,)], "space string"))
    if not names:
        return units.limit(0)
    if mode == "intersection":
        return intersection(part(names[0]), *map(part, names[1:]))
    if mode == "difference":
        return difference(part(names[0]), *map(part, names[1:]))
    return units_in_spaces(units, members, spark.createDataFrame([(n,) for n in names], "space string"))


def upsert(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """The stored units with incoming ones put in their place or added; the last of several incoming rows of a uid along ``order`` counts. Columns of ``stored``."""
    last = incoming.withColumn("_i", F.row_number().over(Window.partitionBy("uid").orderBy(F.col(order).desc_nulls_last()))).where("_i = 1").select(*stored.columns)
    return stored.join(last.select("uid"), "uid", "left_anti").unionByName(last)


def upsert_report(stored: DataFrame, incoming: DataFrame, payload: list[str]) -> DataFrame:
    """One row: incoming rows, and how many are new, changed and equal to what is stored (those are skipped)."""
    old = stored.select("uid", F.struct(*payload).alias("_old"), F.lit(True).alias("_there"))
    seen = incoming.select("uid", F.struct(*payload).alias("_new")).join(old, "uid", "left")
    equal = F.col("_there").isNotNull() & F.col("_old").eqNullSafe(F.col("_new"))
    return seen.agg(F.count("*").alias("total"), F.count_if(F.col("_there").isNull()).alias("added"), F.count_if(F.col("_there").isNotNull() & ~equal).alias("changed"), F.count_if(equal).alias("skipped"))


def delete_units(uids: DataFrame, tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Every table without the rows that name a deleted uid in one of the given columns: payloads, memberships, vectors, postings, nodes, incident edges."""
    gone = uids.select(F.col("uid").alias("_gone")).distinct()
    out = {}
    for name, (df, columns) in tables.items():
        for c in columns:
            df = df.join(gone, df[c] == F.col("_gone"), "left_anti")
        out[name] = df
    return out


def delete_edges(edges: DataFrame, src: str, dst: str, kind: str | None = None) -> DataFrame:
    """Edges without those from ``src`` to ``dst``: with a kind only the first of that kind goes, else all."""
    match = (F.col("src") == src) & (F.col("dst") == dst)
    if kind is None:
        return edges.where(~match)
    first = edges.where(match & (F.col("type") == kind)).agg(F.min("edge_id").alias("edge_id"))
    return edges.join(first, "edge_id", "left_anti")


def add_edges(edges: DataFrame, nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with the new ones whose ends are both nodes; equal edges may be repeated."""
    ids = nodes.select("id")
    ok = new.join(ids, new.src == ids.id, "left_semi").join(ids, new.dst == ids.id, "left_semi")
    return edges.unionByName(ok.select(*edges.columns))


def get_units(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """The units asked for (``pos, uid``), in the order of ``pos``, with ``found``; an unknown uid is a row of nulls, one asked for twice comes twice."""
    return wanted.select("pos", "uid").join(units.withColumn("found", F.lit(True)), "uid", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def put_members(members: DataFrame, units: DataFrame, new: DataFrame) -> DataFrame:
    """Members with new ones (``space, uid``) that are units; a space that is new comes into being, and putting again changes nothing."""
    known = new.select("space", "uid").where("space is not null").join(units.select("uid").distinct(), "uid", "left_semi")
    return members.unionByName(known.select(*members.columns)).distinct()


def take_members(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Members without the given ones (``space, uid``); unknown ones are skipped."""
    return members.join(gone.select("space", "uid").distinct(), ["space", "uid"], "left_anti")


def nest_spaces(children: DataFrame, new: DataFrame) -> DataFrame:
    """Nested spaces with new ones (``parent, child``), each once; none is put into itself."""
    return children.unionByName(new.where("parent is not null and child is not null and parent <> child").select(*children.columns)).distinct()


def drop_spaces(members: DataFrame, children: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members and nested spaces without the spaces ``names`` (``space``); units and spaces below stay."""
    gone = names.select(space_name(F.col("space")).alias("space")).distinct()
    left = children.join(gone.withColumnRenamed("space", "parent"), "parent", "left_anti").join(gone.withColumnRenamed("space", "child"), "child", "left_anti")
    return members.join(gone, "space", "left_anti"), left.select(*children.columns)


def operand_uids(operands: DataFrame, units: DataFrame, members: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """``uid`` of mixed operands (``operand``: an array of uids as text and names of spaces): a name of a space, with or without its prefix, stands for its units and those below it, and comes before a uid of the same
    text; anything else is skipped."""
    said = operands.select(F.explode("operand").alias("said")).where("said is not null").distinct().withColumn("space", space_name(F.col("said")))
    spaces = members.select("space").distinct() if children is None else members.select("space").unionByName(children.select(F.col("parent").alias("space"))).distinct()
    named = said.join(spaces, "space", "left_semi")
    plain = said.join(spaces, "space", "left_anti").select("said")
    by_uid = units.select("uid").join(plain, F.col("uid").cast("string") == F.col("said"), "left_semi")
    return units_in_spaces(units, members, named.select("space"), children).select("uid").unionByName(by_uid).distinct()


def merged_graphs(units: list[tuple[str, DataFrame]], edges: list[tuple[str, DataFrame]], members: list[tuple[str, DataFrame]]) -> dict[str, DataFrame]:
    """Several stores' graphs in one: ``units`` as ``merged_stores``; ``edges`` (src, dst, type) and ``members`` (space, uid) with the new names of their ends, each once and without those whose end is missing; and
    one row of ``counts``: units, edges, members, collisions of uids, edges with a missing end."""
    every = merged_stores(units)
    names = every.select("store", F.col("uid").cast("string").alias("_old"), F.col("new_uid").alias("_new"))
    tagged = lambda parts: reduce(lambda a, b: a.unionByName(b), [df.withColumn("store", F.lit(n)) for n, df in parts])

    def renamed(df: DataFrame, column: str) -> DataFrame:
        return df.withColumn("_old", F.col(column).cast("string")).join(names, ["store", "_old"], "left").withColumn(column, F.col("_new")).drop("_old", "_new")

    ends = renamed(renamed(tagged(edges), "src"), "dst").select("src", "dst", "type")
    whole = ends.where("src is not null and dst is not null").distinct()
    inside = renamed(tagged(members), "uid").where("uid is not null").select("space", "uid").distinct()
    counts = (
        every.agg(F.count("*").alias("units"), F.count_if(F.col("new_uid") != F.col("uid").cast("string")).alias("collisions"))
        .crossJoin(whole.agg(F.count("*").alias("edges"))).crossJoin(inside.agg(F.count("*").alias("members")))  # one row each
        .crossJoin(ends.agg(F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("missing_ends")))
    )
    return {"units": every, "edges": whole, "members": inside, "counts": counts}


def merged_stores(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """Units of several stores in one: ``store, uid, new_uid, ...``. The first store keeps the uid; a later one's becomes
    ``store::uid``, with a number if that is taken too."""
    tagged = reduce(lambda a, b: a.unionByName(b), [p.withColumn("_at", F.lit(i)).withColumn("store", F.lit(n)) for i, (n, p) in enumerate(parts)])
    w = Window.partitionBy("uid").orderBy("_at")
    named = tagged.withColumn("_first", F.row_number().over(w) == 1).withColumn("new_uid", F.when(F.col("_first"), F.col("uid").cast("string")).otherwise(F.concat_ws("::", "store", F.col("uid").cast("string"))))
    again = Window.partitionBy("new_uid").orderBy("_at")
    i = F.row_number().over(again)
    return named.withColumn("new_uid", F.when(i > 1, F.concat_ws("::", "new_uid", i.cast("string"))).otherwise(F.col("new_uid"))).drop("_first", "_at")


def field_names(units: DataFrame, members: DataFrame, payload: str) -> DataFrame:
    """By space, the distinct fields of its direct members' payloads."""
    keys = units.select("uid", F.explode(F.map_keys(payload)).alias("field"))
    return members.join(keys, "uid").groupBy("space").agg(F.array_sort(F.collect_set("field")).alias("fields"))
