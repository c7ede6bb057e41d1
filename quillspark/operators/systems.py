"""System-access analysis: signatures to accesses by a small type parser, conflicts by a self-join."""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import shared_dir, ship

# Parameter types without tracked access.
FREE = {"Local", "Commands", "Deferred", "In", "EventReader", "EventWriter", "MessageReader", "MessageWriter", "RemovedComponents"}
RESOURCES = {"Res": ("resource", False), "ResMut": ("resource", True), "NonSend": ("non_send", False), "NonSendMut": ("non_send", True)}

ACCESS = "system string, idx int, owner int, grp int, kind string, name string, mutable boolean, withs array<string>, withouts array<string>, ors array<array<struct<w:array<string>,wo:array<string>>>>, param string"

#: Types whose parse a worker remembers; what they give is only read.
CACHED = 10_000
#: Sources whose accesses leave a worker in one batch.
BATCH = 500


def _strip(code: str) -> str:
    """Code without comments and with empty strings."""
    return re.sub(r'//[^\n]*|/\*.*?\*/|r#*"(?:.*?)"#*|"(?:\\.|[^"\\])*"', lambda m: " " if m[0][0] == "/" else '""', code, flags=re.S)


def split_top(text: str, sep: str = ",") -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "<([{":
            depth += 1
        elif c in ">)]}" and not (c == ">" and text[i - 1 : i] == "-"):
            depth -= 1
        elif c == sep and depth == 0:
            out.append(text[start:i])
            start = i + 1
    out.append(text[start:])
    return [x.strip() for x in out if x.strip()]


def functions(code: str) -> list[tuple[str, list[str]]]:
    """Names and parameter types of all fn items."""
    code, out = _strip(code), []
    for m in re.finditer(r"\bfn\s+([A-Za-z_]\w*)\s*(<)?", code):
        at = m.end() - (1 if m[2] else 0)
        depth, i = 0, at
        while i < len(code) and (depth or code[i] != "("):
            depth += 1 if code[i] == "<" else -1 if code[i] == ">" and code[i - 1] != "-" else 0
            i += 1
        depth, j = 0, i
        while j < len(code):
            depth += {"(": 1, ")": -1}.get(code[j], 0)
            j += 1
            if depth == 0:
                break
        params = [p.split(":", 1)[1].strip() if ":" in p else p for p in split_top(code[i + 1 : j - 1]) if not re.match(r"&?\s*(mut\s+)?self\b", p)]
        out.append((m[1], params))
    return out


@lru_cache(CACHED)
def parts(ty: str) -> tuple[str, list[str]]:
    """Last identifier of a path type and its type arguments (lifetimes left out)."""
    m = re.match(r"(?:[\w:]*::)?(\w+)\s*(?:<(.*)>)?$", ty.strip(), re.S)
    if not m:
        return "", []
    return m[1], [a for a in split_top(m[2] or "") if not a.startswith("'")]


@lru_cache(CACHED)
def _reference(ty: str) -> tuple[bool, str] | None:
    m = re.match(r"&\s*(?:'\w+\s+)?(mut\s+)?(.+)$", ty.strip(), re.S)
    return (bool(m[1]), m[2].strip()) if m else None


@lru_cache(CACHED)
def _items(ty: str) -> list[str] | None:
    ty = ty.strip()
    return split_top(ty[1:-1]) if ty.startswith("(") and ty.endswith(")") else None


@lru_cache(CACHED)
def filter_atoms(ty: str) -> tuple[set, set, list]:
    """With, Without, and the branches of each Or as (with, without) pairs."""
    if (inner := _items(ty)) is not None:
        w, wo, ors = set(), set(), []
        for x in inner:
            a, b, c = filter_atoms(x)
            w, wo, ors = w | a, wo | b, ors + c
        return w, wo, ors
    name, args = parts(ty)
    if name in ("With", "Without") and args:
        found = set(_items(args[0]) or [args[0]])
        return (found, set(), []) if name == "With" else (set(), found, [])
    if name == "Or" and args:
        return set(), set(), [[filter_atoms(b)[:2] for b in _items(args[0]) or [args[0]]]]
    return set(), set(), []


@lru_cache(CACHED)
def _data(ty: str, need: bool = True):
    """(component, mutable, required) of query data."""
    if (inner := _items(ty)) is not None:
        return [x for t in inner for x in _data(t, need)]
    if ref := _reference(ty):
        return [(ref[1], ref[0], need)]
    name, args = parts(ty)
    if name in ("Ref", "Mut") and args:
        return [(args[0], name == "Mut", need)]
    if name in ("Option", "AnyOf") and args:
        return _data(args[0], False)
    return []


def accesses(code: str) -> list[tuple]:
    """Rows of ACCESS; kind unsupported marks what isn't understood."""
    out: list[tuple] = []
    for system, params in functions(code or ""):
        groups, idx = [0], [0]

        def add(owner, grp, kind, name, mutable, w=(), wo=(), ors=(), param=""):
            out.append((system, idx[0], owner, grp, kind, name, mutable, sorted(w), sorted(wo), [[(sorted(a), sorted(b)) for a, b in o] for o in ors], param))  # noqa: B023
            idx[0] += 1  # noqa: B023

        def visit(ty, owner, grp):
            if (inner := _items(ty)) is not None:
                for x in inner:
                    visit(x, owner, grp)  # noqa: B023
                return
            ref = _reference(ty)
            if ref and parts(ref[1])[0] == "World":
                add(owner, grp, "world", "World", ref[0], param=ty)  # noqa: B023
                return
            name, args = parts(ty)
            if name in ("Query", "Single", "Populated") and args:
                data = _data(args[0])
                w, wo, ors = filter_atoms(args[1]) if len(args) > 1 else (set(), set(), [])
                w = w | {c for c, _, need in data if need}
                for c, mutable, _ in data:
                    add(owner, grp, "component", c, mutable, w, wo, ors, ty)  # noqa: B023
            elif name in ("ParamSet", "SystemParamSet") and args:
                groups[0] += 1  # noqa: B023
                visit(args[0], owner, groups[0])  # noqa: B023
            elif name in RESOURCES and args:
                kind, mutable = RESOURCES[name]
                add(owner, grp, kind, args[0], mutable, param=ty)  # noqa: B023
            elif name not in FREE:
                add(owner, grp, "unsupported", name or ty, False, param=ty)  # noqa: B023

        for owner, ty in enumerate(params):
            visit(ty, owner, None)
    return out


def extract(sources: DataFrame, code: str) -> DataFrame:
    """Rows of ACCESS of every source, parsed in Arrow batches."""
    ship(sources.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(ACCESS))

    def parse(batches):
        import pyarrow as pa

        pairs = lambda ors: [[{"w": w, "wo": wo} for w, wo in o] for o in ors]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), BATCH):
                rows = [(*a[:9], pairs(a[9]), a[10]) for x in texts[at : at + BATCH] for a in accesses(x)]
                columns = zip(*rows, strict=True) if rows else [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return sources.select(code).mapInArrow(parse, ACCESS)


def disjoint(a: str, b: str) -> Column:
    """No entity can match both: With of one meets Without of the other, or an Or all of whose branches are disjoint."""
    c = lambda p, f: F.col(f"{p}.{f}")
    plain = F.arrays_overlap(c(a, "withs"), c(b, "withouts")) | F.arrays_overlap(c(b, "withs"), c(a, "withouts"))
    branches = lambda p, q: F.exists(c(p, "ors"), lambda o: F.forall(o, lambda x: F.arrays_overlap(x["w"], c(q, "withouts")) | F.arrays_overlap(x["wo"], c(q, "withs"))))
    return plain | branches(a, b) | branches(b, a)


def conflicts(rows: DataFrame) -> DataFrame:
    """system, rule, code, name, owner_a, owner_b: pairs of accesses of one system to one thing, joined on it.

    The rows are written once, so that each source is parsed once and not for each side of a join. Both sides are dealt by
    the system and sorted: how many rows a source gives can't be told from its size, and a side taken for small would go
    through the driver whole.
    """
    spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/accesses-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    a, b = rows.alias("a"), rows.alias("b").hint("merge")
    c = F.col
    same = (c("a.system") == c("b.system")) & (c("a.kind") == c("b.kind")) & (c("a.name") == c("b.name")) & (c("a.idx") < c("b.idx"))
    free = F.coalesce(c("a.grp") == c("b.grp"), F.lit(False))
    own = (c("a.owner") == c("b.owner")) & (c("a.kind") != "component")
    both, any_ = c("a.mutable") & c("b.mutable"), c("a.mutable") | c("b.mutable")
    rule = (
        F.when((c("a.kind") == "component") & ~disjoint("a", "b") & both, "R2").when((c("a.kind") == "component") & ~disjoint("a", "b") & any_, "R1")
        .when((c("a.kind") == "resource") & any_, "R3").when((c("a.kind") == "non_send") & any_, "R4")
    )
    pairs = a.join(b, same).where(~free & ~own).select("a.system", rule.alias("rule"), c("a.name").alias("name"), c("a.owner").alias("owner_a"), c("b.owner").alias("owner_b")).where("rule IS NOT NULL")
    world = rows.where("kind = 'world' AND mutable").alias("a").join(b, (c("a.system") == c("b.system")) & (c("a.owner") != c("b.owner")))
    world = world.select("a.system", F.lit("R5").alias("rule"), F.lit("World").alias("name"), c("a.owner").alias("owner_a"), c("b.owner").alias("owner_b"))
    every = pairs.unionByName(world).distinct()
    return every.withColumn("code", F.when(F.col("rule").isin("R1", "R2"), "B0001").otherwise("B0002"))


def generic_argument(text: Column, name: str) -> Column:
    """What stands between the angle brackets after a name, nested to any depth; null where they are empty or don't close."""
    opened = F.regexp_extract(text, rf"(?s)(?<![A-Za-z0-9_]){name}<(.*)$", 1)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("depth"))

    def step(a: Column, ch: Column) -> Column:
        depth = a["depth"] + F.when(ch == "<", 1).when(ch == ">", -1).otherwise(0)
        return F.when(a["depth"] == 0, a).otherwise(F.struct(F.when(depth == 0, a["out"]).otherwise(F.concat(a["out"], ch)).alias("out"), depth.alias("depth")))

    read = F.aggregate(F.split(opened, ""), start, step)
    return F.when(opened != "", F.when(read["depth"] == 0, F.nullif(read["out"], F.lit(""))))


def parse_error(message: Column | str) -> Column:
    """struct<code, severity, resource_type, access> of a pasted message."""
    m = F.col(message) if isinstance(message, str) else message
    boxed = r"(?<![A-Za-z0-9_])(error|warning)\[(B\d{4})\]"
    alone = r"(?<![\p{L}\p{N}_])(B\d{4})(?![\p{L}\p{N}_])"
    code = F.when(m.rlike(boxed), F.regexp_extract(m, boxed, 2)).when(m.rlike(alone), F.regexp_extract(m, alone, 1))
    before = F.lower(F.right(F.regexp_extract(m, r"^(.*?)" + alone, 1), F.lit(32)))
    severity = F.when(m.rlike(boxed), F.when(F.regexp_extract(m, boxed, 1) == "error", "panic").otherwise("warning")).when(before.contains("warning"), "warning").when(before.contains("error") | before.contains("panic"), "panic").otherwise("unknown")
    mut, shared = generic_argument(m, "ResMut"), generic_argument(m, "Res")
    access = F.array_compact(F.array(F.when(mut.isNotNull(), "ResMut").when(shared.isNotNull(), "Res"), F.when(m.contains("&mut"), "&mut").when(m.contains("&"), "&")))
    known = code.isNotNull()
    return F.struct(code.alias("code"), F.when(known, severity).alias("severity"), F.when(known, F.coalesce(mut, shared)).alias("resource_type"), F.when(known, F.array_join(access, ",")).alias("access"))


def short_guide(text: Column | str) -> Column:
    """What a guide says of fixing: the body of its first second-level section about a fix or a solution, else its first 2000 characters."""
    t = F.col(text) if isinstance(text, str) else text
    section = r"(?ims)^##[^#\n][^\n]*(?:fix|solution)[^\n]*\n(.*?)(?=^## |\z)"
    body = F.regexp_replace(F.regexp_extract(t, section, 1), r"^\s+|\s+$", "")
    return F.when(body != "", body).otherwise(F.left(t, F.lit(2000)))


def anti_patterns(code: Column | str) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.array_compact(F.array(F.when(c.contains("is_changed"), "is_changed()"), F.when(c.contains("is_added"), "is_added()")))
