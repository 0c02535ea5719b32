"""Type inference over (source, line, name) rows: a cascade of strategies, the first hit wins.

Strategies whose pattern depends on a column run in one Arrow-batched Python function; imports, self and confidences are column
expressions. Between assignment and duck typing stands what flows in from other functions and files (``operators.flow``), where that was worked out.
"""

from __future__ import annotations

import builtins
import keyword
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Confidence of each strategy.
CONFIDENCE = {"explicit_hint": 0.95, "import_mapping": 0.90, "self_inference": 0.85, "assignment": 0.70, "data_flow": 0.60, "duck_typing": 0.40}
LOOK_BACK = 50


def is_valid_type(text: Column) -> Column:
    """No part of the type is a keyword of the language (so None and True are refused)."""
    parts = F.filter(F.split(F.trim(text), r"[^a-zA-Z0-9_]"), lambda p: p != "")
    return (F.trim(text) != "") & ~F.arrays_overlap(parts, F.array(*[F.lit(k) for k in keyword.kwlist]))


def _valid(text: str | None) -> str | None:
    t = (text or "").strip()
    return t if t and not any(keyword.iskeyword(p) for p in re.split(r"\W", t, flags=re.A) if p) else None


def _hint(lines: list[str], line: int, name: str) -> str | None:
    if not 1 <= line <= len(lines):
        return None
    code = lines[line - 1]
    if not name or re.search(rf"def\s+{re.escape(name)}\b", code):
        found = re.search(r"->\s*([\w\[\],\s\.]+)\s*:", code)
    elif ":" in code and "(" in code:
        found = re.search(rf"\b{re.escape(name)}\s*:\s*([\w\[\],\s\.]+?)(?:,|\)|=)", code)
    else:
        return None
    return _valid(found[1]) if found else None


def _assigned(lines: list[str], line: int, name: str) -> str | None:
    """The constructor last assigned to the name, on this line or the 49 before."""
    pattern = re.compile(rf"\b{re.escape(name)}\s*=\s*(\w+)\s*\(")
    for code in reversed(lines[max(0, line - LOOK_BACK):max(0, line)]):
        found = pattern.search(code)
        if found and (found[1][0].isupper() or hasattr(builtins, found[1])):
            return found[1]
    return None


def _indent(text: str) -> int:
    return len(text) - len(text.lstrip())


def enclosing_block(lines: list[str], line: int) -> list[str]:
    """The def around a line with its deeper-indented body; all lines if there is none."""
    if not 1 <= line <= len(lines):
        return lines
    heads = [i for i in range(line) if re.match(r"\s*def\s+\w+", lines[i])]
    if not heads:
        return lines
    top = heads[-1]
    stop = next((i for i in range(top + 1, len(lines)) if lines[i].strip() and _indent(lines[i]) <= _indent(lines[top])), len(lines))
    return lines[top:stop]


def _ducks(lines: list[str], line: int, name: str) -> str | None:
    pattern = re.compile(rf"\b{re.escape(name)}\.(\w+)\(")
    code = [x.split("#", 1)[0] for x in enclosing_block(lines, line) if x.strip()[:1] not in ("#", "'", '"')]
    called = sorted({m for x in code for m in pattern.findall(x)})
    return f"DuckType({', '.join(called)})" if called else None


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("hint", "assigned", "ducks")]))
def _by_name(source: pd.Series, line: pd.Series, name: pd.Series) -> pd.DataFrame:
    rows = []
    for s, n, x in zip(source, line, name):
        lines, n, x = (s or "").split("\n"), int(n), x or ""
        rows.append((_hint(lines, n, x), _assigned(lines, n, x) if x else None, _ducks(lines, n, x) if x else None))
    return pd.DataFrame(rows, columns=["hint", "assigned", "ducks"])


def imported_type(source: Column, name: Column) -> Column:
    """The first imported name equal to ``name``, case folded."""
    names = F.regexp_extract_all(source, F.lit(r"(?U)from\s+[\w.]+\s+import\s+(\w+)"), F.lit(1))
    return F.try_element_at(F.filter(names, lambda x: F.lower(x) == F.lower(name)), F.lit(1))


def self_type(source: Column, line: Column, name: Column) -> Column:
    """For ``self``: the nearest unindented class above, 49 lines back at most."""
    first = F.greatest(F.lit(1), line - 49)
    above = F.slice(F.split(source, "\n"), first, F.greatest(F.lit(0), line - first))
    heads = F.filter(F.transform(above, lambda x: F.regexp_extract(x, r"^class\s+(\w+)", 1)), lambda x: x != "")
    return F.when(name == "self", F.try_element_at(heads, F.lit(-1)))


def infer(rows: DataFrame, flowing: DataFrame | None = None) -> DataFrame:
    """Add type_name, confidence, strategy to rows of (source, line, name). With ``flowing`` (slot, type_name) rows have a ``slot`` too."""
    s, n, x = F.col("source"), F.col("line"), F.coalesce("name", F.lit(""))
    own = rows.withColumn("_u", _by_name(s, n, x))
    own = own.withColumn("_f", F.lit(None).cast("string")) if flowing is None else own.join(flowing.select("slot", F.col("type_name").alias("_f")), "slot", "left")
    found = {"explicit_hint": F.col("_u.hint"), "import_mapping": imported_type(s, x), "self_inference": self_type(s, n, x), "assignment": F.col("_u.assigned"), "data_flow": F.col("_f"), "duck_typing": F.col("_u.ducks")}
    best = F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("type_name"), F.lit(CONFIDENCE[k]).alias("confidence"), F.lit(k).alias("strategy"))) for k, c in found.items()],
                      F.struct(F.lit(None).cast("string").alias("type_name"), F.lit(0.0).alias("confidence"), F.lit("none").alias("strategy")))
    return own.withColumn("_t", best).select(*rows.columns, "_t.type_name", "_t.confidence", "_t.strategy")


def type_info(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """type_info rows of all symbols whose type is known. sources: (path, content)."""
    rows = symbols.join(sources.select(F.col("path").alias("file_path"), F.col("content").cast("string").alias("source")), "file_path").select("symbol_id", "source", F.col("start_line").alias("line"), "name")
    return infer(rows).filter("type_name is not null").select("symbol_id", F.lit(None).cast("string").alias("parameter_name"), F.lit(None).cast("string").alias("type_annotation"), F.col("type_name").alias("inferred_type"), "confidence", F.col("strategy").alias("inference_strategy"), F.lit(None).cast("string").alias("evidence"))
