"""Fields that drift between the files of a stream.

The schemas of all files are fused into a tagged union: per field name the set of JSON types that its non-null values
take in a file.  Neighbouring files of a stream are compared name by name, renames are recognised by equal values of
the items that both files record, and fields with several types are split into a canonical column and a branch that
keeps what does not convert.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.plans.lineage import cut

#: Type tags of a JSON value, with the type of a column of them; a null has none, arrays and objects stay JSON text.
TYPES = {"string": "string", "integer": "bigint", "decimal": "double", "boolean": "boolean", "array": None, "object": None}
TAGS = tuple(TYPES)

def json_objects(lines: DataFrame, payload: str = "payload") -> DataFrame:
    """The lines that are one complete JSON object, with column ``object`` (variant).

    Null and blank lines, scalars, arrays, lines cut short, lines with anything behind the object and objects that
    give one name twice are left out.  A line is parsed once, inside a list that its own digest closes: that the digest
    comes second shows that the line is one value and nothing else.
    """
    text = F.col(payload)
    closed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), F.xxhash64(text), F.lit("]")))
    return (
        lines.where(F.ltrim(text).startswith("{") | text.rlike(r"^\s*\{"))
        .withColumn("_closed", closed)
        .where(F.try_variant_get("_closed", "$[1]", "bigint") == F.xxhash64(text))
        .withColumn("object", F.try_variant_get("_closed", "$[0]", "variant"))
        .drop("_closed")
    )


def type_tag(value: Column) -> Column:
    """Tag of a variant: a whole number is ``integer``, one written with a point or exponent is ``decimal``."""
    kind = F.schema_of_variant(value)
    wide = F.regexp_extract(kind, r"^DECIMAL\((\d+),0\)$", 1)
    return (
        F.when(kind == "VOID", None)
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when((kind == "BIGINT") | ((wide != "") & (F.length(wide) == 2) & (wide >= "19")), "integer")
        .otherwise("decimal")
    )


def fields(objects: DataFrame) -> DataFrame:
    """One row per top-level field of each object: the other columns, ``item``, ``name``, ``tag`` and ``value`` (JSON text).

    Equal numbers have equal text however they are written; names that differ in letter case stay apart.
    """
    spark = objects.sparkSession
    wide = objects.withColumn("item", F.try_variant_get("object", "$.uid", "string"))
    each = wide.lateralJoin(spark.tvf.variant_explode(F.col("object").outer()))
    value, keep = F.col("value"), [c for c in objects.columns if c not in ("object", "payload")]
    return each.select(
        *keep,
        "item",
        F.col("key").alias("name"),
        type_tag(value).alias("tag"),
        F.regexp_replace(F.to_json(value), r"^(-?\d+)\.0$", "$1").alias("value"),
    )


def file_profiles(lines: DataFrame) -> DataFrame:
    """Tagged union per file: (file_id, name, tags, n_lines), ``tags`` the sorted types of the non-null values."""
    return fields(json_objects(lines.select("file_id", "payload"))).groupBy("file_id", "name").agg(F.sort_array(F.collect_set("tag")).alias("tags"), F.count("*").alias("n_lines"))


def _neighbours(lines: DataFrame) -> DataFrame:
    """(earlier, later) file ids of each pair of files next to each other in their stream."""
    files = lines.select("stream", "file_seq", "file_id").distinct()
    before = files.select("stream", (F.col("file_seq") + 1).alias("file_seq"), F.col("file_id").alias("earlier"))
    return before.join(files.withColumnRenamed("file_id", "later"), ["stream", "file_seq"]).select("earlier", "later")


def changes(lines: DataFrame) -> DataFrame:
    """Every change of a field from one file of a stream to the next.

    Columns file_id (the later file), old_field, new_field and change_kind (renamed, removed, added, retyped).  A
    rename needs at least one item that both files record, and equal values for all such items; values of lines
    without ``uid`` tell nothing about renames.  A file without any complete line carries no name.  Empty input gives no rows.
    """
    lines = lines.select("stream", "file_seq", "file_id", "payload")
    profiles = cut(file_profiles(lines))
    pairs = cut(_neighbours(lines))
    old = pairs.join(profiles, pairs.earlier == profiles.file_id).select("earlier", "later", "name", F.col("tags").alias("old_tags"))
    new = pairs.join(profiles, pairs.later == profiles.file_id).select("earlier", "later", "name", F.col("tags").alias("new_tags"))
    both = cut(old.join(new, ["earlier", "later", "name"], "full_outer"))
    gone, come = F.col("new_tags").isNull(), F.col("old_tags").isNull()

    # Values are read again only for names that left or came between two files where both happened.
    open_pairs = both.groupBy("later").agg(F.max(gone).alias("g"), F.max(come).alias("c")).where("g and c").select("later")
    moved = both.where(gone | come).join(open_pairs, "later").select("later", "name", gone.alias("gone"), F.when(gone, F.col("earlier")).otherwise(F.col("later")).alias("file_id"))
    told = fields(json_objects(lines.select("file_id", "payload").join(moved.select("file_id").distinct(), "file_id", "left_semi"))).where(F.col("item").isNotNull())
    values = cut(told.join(moved, ["file_id", "name"]).groupBy("later", "gone", "name", "item").agg(F.min("value").alias("low"), F.max("value").alias("high")))
    left = values.where("gone").select("later", "item", F.col("name").alias("old_field"), F.col("low").alias("old_low"), F.col("high").alias("old_high"))
    right = values.where("not gone").select("later", "item", F.col("name").alias("new_field"), "low", "high")
    same = F.col("old_low").eqNullSafe(F.col("low")) & F.col("old_high").eqNullSafe(F.col("high"))
    renamed = cut(left.join(right, ["later", "item"]).groupBy("later", "old_field", "new_field").agg(F.min(same).alias("same")).where("same").select("later", "old_field", "new_field"))

    out = ["file_id", "old_field", "new_field", "change_kind"]
    row = lambda df, a, b, kind: df.select(F.col("later").alias("file_id"), a.alias("old_field"), b.alias("new_field"), F.lit(kind).alias("change_kind"))
    name, none = F.col("name"), F.lit("")
    was = renamed.select("later", F.col("old_field").alias("name")).distinct()
    now = renamed.select("later", F.col("new_field").alias("name")).distinct()
    retyped = both.where((F.size("old_tags") > 0) & (F.size("new_tags") > 0) & (F.col("old_tags") != F.col("new_tags")))
    return (
        row(renamed, F.col("old_field"), F.col("new_field"), "renamed")
        .unionByName(row(both.where(gone).join(was, ["later", "name"], "left_anti"), name, none, "removed"))
        .unionByName(row(both.where(come).join(now, ["later", "name"], "left_anti"), none, name, "added"))
        .unionByName(row(retyped, name, name, "retyped"))
        .select(out)
    )


def alternatives(lines: DataFrame) -> DataFrame:
    """Tagged union over all files: per name and type the number of files and lines and the first file that has it."""
    each = fields(json_objects(lines.select("file_id", "written_at", "payload")))
    per_file = each.where(F.col("tag").isNotNull()).groupBy("name", "tag", "file_id").agg(F.count("*").alias("n_lines"), F.min("written_at").alias("written_at"))
    return per_file.groupBy("name", "tag").agg(
        F.count("*").alias("n_files"),
        F.sum("n_lines").alias("n_lines"),
        F.min(F.struct("written_at", "file_id"))["file_id"].alias("first_file_id"),
    )


def paths(objects: DataFrame) -> DataFrame:
    """One row per value at each path of each object, nested ones included: the other columns, ``field`` (top-level name), ``path`` and ``tag``.

    A member is ``parent.name``, an element of an array ``parent[]``.  Only values that hold others are looked into,
    one level at a time, so that any depth is reached.
    """
    spark = objects.sparkSession
    keep = [c for c in objects.columns if c not in ("object", "payload")]
    level = objects.lateralJoin(spark.tvf.variant_explode(F.col("object").outer())).select(*keep, F.col("key").alias("field"), F.col("key").alias("path"), "value")
    out = level.select(*keep, "field", "path", type_tag(F.col("value")).alias("tag"))
    while True:
        held = cut(level.withColumn("tag", type_tag(F.col("value"))).where("tag IN ('array', 'object')").select(*keep, "field", "path", F.to_json("value").alias("held")))
        if held.isEmpty():
            return out
        inner = held.lateralJoin(spark.tvf.variant_explode(F.parse_json(F.col("held").outer())))
        step = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat("path", F.lit("."), "key"))
        level = inner.select(*keep, "field", step.alias("path"), "value")
        out = out.unionByName(level.select(*keep, "field", "path", type_tag(F.col("value")).alias("tag")))


def path_alternatives(lines: DataFrame) -> DataFrame:
    """Tagged union over all files by path: per path and type the number of files and values and the first file that has it."""
    each = paths(json_objects(lines.select("file_id", "written_at", "payload")))
    per_file = each.where(F.col("tag").isNotNull()).groupBy("path", "tag", "file_id").agg(F.count("*").alias("n_values"), F.min("written_at").alias("written_at"))
    return per_file.groupBy("path", "tag").agg(F.count("*").alias("n_files"), F.sum("n_values").alias("n_values"), F.min(F.struct("written_at", "file_id"))["file_id"].alias("first_file_id"))


def path_changes(lines: DataFrame) -> DataFrame:
    """Changes inside fields that neighbouring files of a stream both carry: file_id (the later), path and change_kind (added, removed, retyped).

    What happens to whole fields is told by ``changes``.
    """
    lines = lines.select("stream", "file_seq", "file_id", "payload")
    profiles = cut(paths(json_objects(lines.select("file_id", "payload"))).groupBy("file_id", "field", "path").agg(F.sort_array(F.collect_set("tag")).alias("tags")))
    pairs = cut(_neighbours(lines))
    old = pairs.join(profiles, pairs.earlier == profiles.file_id).select("later", "field", "path", F.col("tags").alias("old_tags"))
    new = pairs.join(profiles, pairs.later == profiles.file_id).select("later", "field", "path", F.col("tags").alias("new_tags"))
    both = cut(old.join(new, ["later", "field", "path"], "full_outer"))
    whole = both.where("field = path AND old_tags IS NOT NULL AND new_tags IS NOT NULL").select("later", "field")
    kind = F.when(F.col("new_tags").isNull(), "removed").when(F.col("old_tags").isNull(), "added").when((F.size("old_tags") > 0) & (F.size("new_tags") > 0) & (F.col("old_tags") != F.col("new_tags")), "retyped")
    return both.where("field <> path").join(whole, ["later", "field"]).select(F.col("later").alias("file_id"), "path", kind.alias("change_kind")).where("change_kind IS NOT NULL")


def folded(name: str) -> str:
    """A name without letter case and signs, so that ``src_key``, ``srcKey`` and ``SRC_KEY`` are one; a name of signs only stays."""
    return "".join(c for c in name.casefold() if c.isalnum()) or name


def canonical_names(links: Iterable[tuple[str, str]], seen: dict[str, int]) -> dict[str, str]:
    """Canonical name of each name: linked names, and names that fold alike, share the one that most lines carry (ties: the first in order)."""
    root = {n: n for n in seen}

    def find(n: str) -> str:
        while root[n] != n:
            n = root[n]
        return n

    first: dict[str, str] = {}
    for a, b in [*links, *((first.setdefault(folded(n), n), n) for n in sorted(seen))]:
        x, y = find(a), find(b)
        if x != y:
            keep, drop = sorted((x, y), key=lambda n: (-seen[n], n))
            root[drop] = keep
    return {n: find(n) for n in seen}


def _single(value: Column) -> Column:
    """A variant out of its list where it is the only element."""
    return F.when(F.try_variant_get(value, "$[1]", "variant").isNull(), F.coalesce(F.try_variant_get(value, "$[0]", "variant"), value)).otherwise(value)


def same_values(objects: DataFrame, scope: Column, least: int = 3) -> DataFrame:
    """Pairs of names (a, b) that record the same under different names, whatever the type they write it in.

    Two names that no object carries together are one field if all items (``scope`` and uid) that are recorded under both
    have equal values there, ``least`` items and ``least`` different values or more.  An item counts where a name has one
    value throughout; numbers in strings and single elements of lists count as what they hold.
    """
    spark = objects.sparkSession
    each = objects.select(scope.alias("scope"), F.try_variant_get("object", "$.uid", "string").alias("item"), "object").where("scope IS NOT NULL AND item IS NOT NULL")
    told = each.lateralJoin(spark.tvf.variant_explode(F.col("object").outer())).where("key <> 'uid'").withColumn("plain", F.try_variant_get(_single(F.col("value")), "$", "string"))
    one = told.groupBy("scope", "item", F.col("key").alias("name")).agg(F.min("plain").alias("plain"), F.max("plain").alias("top")).where("plain = top").drop("top")
    values = cut(one.withColumn("plain", F.coalesce(F.col("plain").try_cast("double").cast("string"), "plain")))
    alike = values.groupBy("scope", "item", "plain").agg(F.sort_array(F.collect_set("name")).alias("names")).where("size(names) > 1")
    two = lambda c: F.flatten(F.transform(c, lambda x: F.transform(F.filter(c, lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    likely = alike.select("plain", F.explode(two(F.col("names"))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.count_distinct("plain").alias("v")).where((F.col("n") >= least) & (F.col("v") >= least))
    shapes = objects.select(F.array_sort(F.map_keys(F.try_variant_get("object", "$", "map<string,variant>"))).alias("names")).distinct()
    met = shapes.select(F.explode(two(F.col("names"))).alias("p")).select("p.a", "p.b").distinct()
    open_pairs = cut(likely.select("a", "b").join(met, ["a", "b"], "left_anti"))
    left = open_pairs.join(values.select("scope", "item", F.col("name").alias("a"), F.col("plain").alias("x")), "a")
    both = left.join(values.select("scope", "item", F.col("name").alias("b"), F.col("plain").alias("y")), ["scope", "item", "b"])
    return both.groupBy("a", "b").agg(F.bool_and(F.col("x") == F.col("y")).alias("same")).where("same").select("a", "b")


def telling_members(objects: DataFrame) -> DataFrame:
    """For each field with objects as values the member that tells them apart best (name, member): the one with most different values, ties by name."""
    spark = objects.sparkSession
    each = objects.select("object").lateralJoin(spark.tvf.variant_explode(F.col("object").outer())).where(type_tag(F.col("value")) == "object").select(F.col("key").alias("name"), F.to_json("value").alias("held"))
    inner = each.lateralJoin(spark.tvf.variant_explode(F.parse_json(F.col("held").outer()))).select("name", F.col("key").alias("member"), F.to_json("value").alias("v"))
    counted = inner.groupBy("name", "member").agg(F.count_distinct("v").alias("n"))
    return counted.groupBy("name").agg(F.min_by("member", F.struct(-F.col("n"), "member")).alias("member"))


def unified_records(lines: DataFrame, renames: DataFrame, max_fields: int = 5000) -> DataFrame:
    """All complete records of ``lines`` (stream, file_id and payload at least) as one table with one set of typed columns.

    Names become one column where a rename links them (rows of ``changes``), where they differ in letter case and signs
    only, or where all items have the same values under them (``same_values``).  The column has the name and the type
    that most lines have.  A field with several types has in addition one branch per other type (``<field>_string``,
    ``_integer``, ``_decimal``, ``_boolean``, and ``_array`` and ``_object`` as JSON text) that holds every value of
    that type as it was recorded; the column itself has it too where it converts without loss: a number in a string,
    a flag as 0 or 1, the element of a list of one, the member that tells an object's values apart.  Where records have
    several names of one field, the column has the canonical name's value and ``<field>_others`` (name to JSON text)
    the other values that differ.  So no value is lost.  The schema, not the data, goes through the driver: more than
    ``max_fields`` names raise an error.  Columns of ``lines`` other than the payload (and one named ``object``) come
    first; a field or branch whose name is taken, also in other letter case, gets the suffix ``_field``.
    """
    objects = json_objects(lines)
    union = fields(objects.select("file_id", "object")).groupBy("name", "tag").count().limit(max_fields * len(TAGS) + 1).collect()
    if len(union) > max_fields * len(TAGS):
        raise ValueError(f"more than {max_fields} field names")
    seen: dict[str, int] = {}
    for r in union:
        seen[r["name"]] = seen.get(r["name"], 0) + r["count"]
    plain = objects.select("stream", "object")
    linked = renames.where("change_kind = 'renamed'").select(F.col("old_field").alias("a"), F.col("new_field").alias("b")).unionByName(same_values(plain, F.split("stream", "/")[0])).distinct().collect()
    names = canonical_names([(r["a"], r["b"]) for r in linked if r["a"] in seen and r["b"] in seen], seen)
    members = {r["name"]: r["member"] for r in telling_members(plain).collect()}
    tags: dict[str, dict[str, int]] = {}
    for r in union:
        if r["tag"]:
            t = tags.setdefault(names[r["name"]], {})
            t[r["tag"]] = t.get(r["tag"], 0) + r["count"]
    meta = [c for c in lines.columns if c not in ("payload", "object")]
    out, taken = [F.col(c) for c in meta], {c.lower() for c in meta}
    classes: dict[str, list[str]] = {}
    for n in sorted(names, key=lambda n: (n != names[n], -seen[n], n)):
        classes.setdefault(names[n], []).append(n)

    def free(label: str) -> str:
        while label.lower() in taken:
            label += "_field"
        taken.add(label.lower())
        return label

    labels = {field: free(field or "field") for field in sorted(classes)}
    several = {field: sum((_named(n).isNotNull().cast("int") for n in aliases), F.lit(0)) > 1 for field, aliases in classes.items() if len(aliases) > 1}
    meet = objects.agg(F.lit(0).alias("_"), *[F.bool_or(c).alias(f"c{i}") for i, c in enumerate(several.values())]).first()
    met = {field for i, field in enumerate(several) if meet[i + 1]}
    for field, aliases in sorted(classes.items()):
        kinds = tags.get(field, {"string": 0})
        main = min(kinds, key=lambda k: (-kinds[k], TAGS.index(k)))
        value = F.coalesce(*[_named(n) for n in aliases])
        bare = _single(value)
        for n in aliases:
            if main != "object" and n in members and _path(members[n]):
                bare = F.coalesce(F.try_variant_get(value, _path(members[n]), "variant"), bare)
        out.append(_converted(value, bare, main).alias(labels[field]))
        out += [F.when(type_tag(value) == k, F.to_json(value) if TYPES[k] is None else F.try_variant_get(value, "$", TYPES[k])).alias(free(f"{labels[field]}_{k}")) for k in TAGS if k in kinds and k != main]
        if field in met:
            told = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.to_json(_named(n)).alias("v")) for n in aliases]), lambda e: e["v"].isNotNull() & (e["v"] != F.to_json(value))))
            out.append(F.when(F.size(told) > 0, told).alias(free(f"{labels[field]}_others")))
    return objects.select(*out)


def _path(name: str) -> str | None:
    """Path of a member; None for a name that no path can address."""
    return None if not name or ("'" in name and '"' in name) else f'$["{name}"]' if "'" in name else f"$['{name}']"


def _named(name: str) -> Column:
    """The value that an object has under ``name``; null where it has none or JSON's null."""
    path = _path(name)
    found = F.try_variant_get("object", path, "variant") if path else F.try_element_at(F.try_variant_get("object", "$", "map<string,variant>"), F.lit(name))
    return F.when(~F.is_variant_null(found), found)


def _converted(value: Column, bare: Column, main: str) -> Column:
    """A value in the type of its column, null where that would lose something."""
    if main in ("array", "object"):
        return F.to_json(value)
    kind = F.schema_of_variant(bare)
    if main == "integer":
        number = F.try_variant_get(bare, "$", "double")
        return F.when(kind == "BOOLEAN", F.try_variant_get(bare, "$", "boolean").cast("bigint")).otherwise(F.when(number == F.floor(number), F.try_variant_get(bare, "$", "bigint")))
    if main == "boolean":
        return F.when((kind == "BOOLEAN") | (kind == "STRING") | F.try_variant_get(bare, "$", "double").isin(0.0, 1.0), F.try_variant_get(bare, "$", "boolean"))
    held = F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), None).otherwise(bare)
    return F.try_variant_get(held, "$", TYPES[main])
