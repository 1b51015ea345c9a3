"""Nested JSON into flat tables by columnar shredding.

Each document is striped into one column per leaf path, every entry with a repetition level
(which list on the path went on) and a definition level (how far the path exists), as
columnar stores keep nested records. The flat tables are then rebuilt from the level
sequences alone: every object on a path is owned by its first leaf column, whose levels tell
where each instance begins, so each object comes out once, without a shuffle.

A path is a list of steps: ``.key`` (an optional field), ``{`` (the value is an object), ``[``
(the value is a list), ``*`` (an element of the list). Each step is one definition level and
``*`` also one repetition level, so values of mixed kinds under one key keep apart.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _refuse(name: str) -> None:
    raise ValueError(name)


@contextmanager
def _deep():
    """Lets records of any depth that the parser takes be walked; calls of Python functions use no machine stack."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(1_000_000)
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def parse(text: str | None):
    """(True, value) for strict JSON, else (False, None); numbers are the strings they are written as, marked by their type."""
    if not text:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_refuse, parse_int=Number, parse_float=Number)
    except (ValueError, RecursionError):
        return False, None


class Number(str):
    """A JSON number as written, so that none is too long or loses digits."""


def printable(text: str) -> str:
    """The text with surrogates that stand alone, which no table can hold, written as ``\\udXXX``."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "backslashreplace").decode()


def _shape(values: list) -> dict:
    """What occurs at one path over all its values: fields of objects, elements, scalars."""
    out, objects = {}, [v for v in values if isinstance(v, dict)]
    if objects:
        fields: dict[str, list] = {}
        for o in objects:
            for k, v in o.items():
                fields.setdefault(k, []).append(v)
        out["{"] = {k: _shape(v) for k, v in fields.items()}
    lists = [v for v in values if isinstance(v, list)]
    if lists:
        elements = [e for v in lists for e in v]
        out["["] = _shape(elements) if elements else {}
    if len(objects) + len(lists) < len(values):
        out["="] = True
    return out


def shred(value, with_values: bool = True) -> list[tuple[list[str], list[int], list[int], list[str | None], list[int]]]:
    """Columns (path, repetition levels, definition levels, values, owned) of one document.

    ``owned`` are the definition levels of the object steps whose first leaf this column is.
    """
    columns: list[tuple[list[str], list[int], list[int], list[str | None], list[int]]] = []

    def plan(shape: dict, path: list[str], open_objects: list[int]) -> dict:
        """Columns below a path; ``open_objects`` are levels no column owns yet."""
        node: dict = {"cols": []}

        def column(p: list[str]) -> int:
            columns.append((p, [], [], [], list(open_objects)))
            open_objects.clear()
            return len(columns) - 1

        if "=" in shape:
            node["="] = column(path)
            node["cols"].append(node["="])
        if "{" in shape:
            here = [*path, "{"]
            open_objects.append(len(here))
            node["{"] = {k: plan(s, [*here, f".{printable(k)}"], open_objects) for k, s in shape["{"].items()}
            own = [c for s in node["{"].values() for c in s["cols"]]
            if not own:
                node["{only"] = column(here)
                own = [node["{only"]]
            node["{cols"] = own
            node["cols"] += own
        if "[" in shape:
            here = [*path, "[", "*"]
            if shape["["]:
                node["["] = plan(shape["["], here, open_objects)
                node["[cols"] = node["["]["cols"]
            else:
                node["[only"] = column([*path, "["])
                node["[cols"] = [node["[only"]]
            node["cols"] += node["[cols"]
        return node

    def null(cols: list[int], r: int, d: int) -> None:
        for c in cols:
            columns[c][1].append(r)
            columns[c][2].append(d)
            columns[c][3].append(None)

    def write(node: dict, v, r: int, d: int, depth: int) -> None:
        """Write a value at definition level ``d`` below ``depth`` lists."""
        if isinstance(v, dict):
            for k, s in node["{"].items():
                if k in v:
                    write(s, v[k], r, d + 2, depth)
                else:
                    null(s["cols"], r, d + 1)
            if "{only" in node:
                null([node["{only"]], r, d + 1)
        elif "{cols" in node:
            null(node["{cols"], r, d)
        if isinstance(v, list):
            if not v or "[" not in node:
                null(node["[cols"], r, d + 1)
            else:
                for n, e in enumerate(v):
                    write(node["["], e, r if n == 0 else depth + 1, d + 2, depth + 1)
        elif "[cols" in node:
            null(node["[cols"], r, d)
        if "=" in node:
            scalar = not isinstance(v, (dict, list))
            path, reps, defs, values, _ = columns[node["="]]
            reps.append(r)
            defs.append(d if scalar else d - 1 if d else -1)
            values.append((printable(v) if isinstance(v, str) else json.dumps(v)) if with_values and scalar else None)

    # A scalar at the outermost place is its own column at level 0; -1 marks its absence.
    with _deep():
        write(plan(_shape([value]), [], []), value, 0, 0, 0)
    return columns


def assemble(path: list[str], reps: list[int], defs: list[int], owned: list[int]) -> list[tuple[str, str, str]]:
    """(table, node_path, parent_path) of each object that the column owns, from its levels."""
    if not owned:
        return []
    stars = [n for n, s in enumerate(path) if s == "*"]
    own = set(owned)
    index = [0] * (len(stars) + 1)
    out = []
    for r, d in zip(reps, defs):
        if r:
            index[r] += 1
            for k in range(r + 1, len(index)):
                index[k] = 0
            fresh = stars[r - 1] + 1  # levels up to here were there before
        else:
            fresh = 0
        if d <= fresh and d < max(own):
            continue
        node, parent, table, k = "$", "", "$", 0
        for level, step in enumerate(path[:d], 1):
            if step[0] == ".":
                node += "/" + step[1:]
                table += "/" + step[1:]
            elif step == "*":
                k += 1
                node += f"/{index[k]}"
                table += "/*"
            elif step == "{":
                if level in own and level > fresh:
                    out.append((table, node, parent))
                parent = node
    return out


def shred_levels(docs: DataFrame, id_col: str, json_col: str, with_values: bool = False) -> DataFrame:
    """(id, path, reps, defs, values, owned): one row for each document and leaf path.

    Texts that are null, empty or not valid JSON as a whole give no rows (so do those nested
    deeper than the interpreter's parser goes, about ten thousand levels); of a key that
    occurs twice in one object the last value counts, as in the usual parsers. Numbers keep
    the digits they are written with, however many; a surrogate that stands alone in a key or
    value is written as its escape.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(json_col).alias("json"))
    id_type = docs.schema["id"].dataType.simpleString()
    names = ["id", "path", "reps", "defs", "values", "owned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cols = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ok, value = parse(text)
                if ok:
                    mine = shred(value, with_values)
                    cols += mine
                    ids += [i] * len(mine)
            arrays = [pa.array(ids, b.schema.field(0).type)]
            kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()))
            for n, kind in enumerate(kinds):
                none = n == 3 and not with_values
                arrays.append(pa.nulls(len(cols), kind) if none else pa.array([c[n] for c in cols], kind))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.where(F.col("json").isNotNull()).mapInArrow(run, f"id {id_type}, path array<string>, reps array<int>, defs array<int>, values array<string>, owned array<int>")


def objects(levels: DataFrame) -> DataFrame:
    """(id, table_path, node_path, parent_path): every object, rebuilt from the level sequences."""
    id_type = levels.schema["id"].dataType.simpleString()
    names = ["id", "table_path", "node_path", "parent_path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = [], []
            for i, path, reps, defs, owned in zip(*(c.to_pylist() for c in b.columns)):
                mine = assemble(path, reps, defs, owned)
                rows += mine
                ids += [i] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), *(pa.array([r[n] for r in rows], pa.string()) for n in range(3))], names)

    owning = levels.where(F.size("owned") > 0).select("id", "path", "reps", "defs", "owned")
    return owning.mapInArrow(run, f"id {id_type}, table_path string, node_path string, parent_path string")


def fields(levels: DataFrame) -> DataFrame:
    """(id, table_path, node_path, field, value): the scalars of each object's row.

    ``field`` is the path from the object down to the scalar, with list positions, so the
    rows of one ``table_path`` are the cells of one flat table. A JSON null has the value
    ``null``. A scalar below no object belongs to the document itself (``node_path`` is empty).
    """
    id_type = levels.schema["id"].dataType.simpleString()
    names = ["id", "table_path", "node_path", "field", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, path, reps, defs, values in zip(*(c.to_pylist() for c in b.columns)):
                stars = sum(s == "*" for s in path)
                index = [0] * (stars + 1)
                for r, d, v in zip(reps, defs, values):
                    if r:
                        index[r] += 1
                        index[r + 1 :] = [0] * (stars - r)
                    if d < len(path) or v is None:
                        continue
                    node, table, at, k = "$", "$", (0, 0), 0
                    for step in path:
                        if step[0] == ".":
                            node, table = f"{node}/{step[1:]}", f"{table}/{step[1:]}"
                        elif step == "*":
                            k += 1
                            node, table = f"{node}/{index[k]}", f"{table}/*"
                        elif step == "{":
                            at = (len(node), len(table))
                    rows.append((i, table[: at[1]], node[: at[0]], node[at[0] :].lstrip("/"), v))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), *(pa.array([r[n] for r in rows], pa.string()) for n in range(1, 5))], names)

    return levels.select("id", "path", "reps", "defs", "values").mapInArrow(run, f"id {id_type}, table_path string, node_path string, field string, value string")


def wide_table(cells: DataFrame, found: DataFrame, table_path: str, columns: list[str]) -> DataFrame:
    """(id, node_path, parent_path, *columns): one flat table, a row for each object of ``table_path``.

    ``cells`` are from ``fields`` and ``found`` from ``objects``. An object without a field has a null there, one
    with none of the fields still has its row. The columns are named by the caller, as the
    fields of a whole collection have no bound; a column called like a key keeps its name with
    an underscore behind it. Children link by ``id`` and their ``parent_path``.
    """
    named = {c: f"{c}_" if c in ("id", "node_path", "parent_path") else c for c in columns}
    mine = cells.where((F.col("table_path") == table_path) & F.col("field").isin(columns))
    # One cell a field and object, so nothing is gathered; the same record given twice counts once.
    rows = mine.groupBy("id", "node_path").agg(*(F.max(F.when(F.col("field") == c, F.col("value"))).alias(n) for c, n in named.items()))
    keys = found.where(F.col("table_path") == table_path).select("id", "node_path", "parent_path").distinct()
    return keys.join(rows, ["id", "node_path"], "left").select("id", "node_path", "parent_path", *(F.col(f"`{n}`") for n in named.values()))
