"""Relations of an index, as explicit Spark types (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S, B, D = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


FILES = _struct(file_id=L, path=S, hash=S, language=S, line_count=I, size_bytes=L)
SYMBOLS = _struct(symbol_id=L, file_id=L, file_path=S, name=S, type=S, qualified_name=S, start_line=I, end_line=I, docstring=S, signature=S, is_exported=B, parent_class=S, parent_class_id=L)
IMPORTS = _struct(file_id=L, path=S, module_path=S, imported_name=S, alias=S, is_relative=B, relative_level=I, line_number=I)
CALLS = _struct(caller_id=L, callee_id=L, call_type=S, confidence=D, line_number=I)
INHERITS = _struct(child_id=L, parent_id=L, parent_name=S)
TYPE_INFO = _struct(symbol_id=L, parameter_name=S, type_annotation=S, inferred_type=S, confidence=D, inference_strategy=S, evidence=S)
EMBEDDINGS = _struct(symbol_id=L, embedding=T.ArrayType(T.FloatType()))
NODES = _struct(qualified_name=S, type=S, file_path=S, line_count=I)
EDGES = _struct(src=S, dst=S, relation_type=S, line_number=I, weight=D, confidence=D, resolution=S, phase=I, ord=L)
SYMBOL_TYPES = ("class", "function", "method", "variable", "module", "interface", "enum", "property")

PARSED = T.StructType([
    T.StructField("path", S), T.StructField("hash", S), T.StructField("line_count", I), T.StructField("size_bytes", L), T.StructField("error", S),
    T.StructField("symbols", T.ArrayType(_struct(name=S, type=S, qualified_name=S, start_line=I, end_line=I, docstring=S, signature=S, is_exported=B, parent_class=S))),
    T.StructField("imports", T.ArrayType(_struct(module_path=S, imported_name=S, alias=S, is_relative=B, relative_level=I, line_number=I))),
    T.StructField("calls", T.ArrayType(_struct(target=S, call_type=S, caller_class=S, caller_qname=S, line_number=I, chain=S))),
    T.StructField("bases", T.ArrayType(_struct(child=S, parent=S, line_number=I))),
    T.StructField("flows", T.ArrayType(_struct(dst=S, kind=S, src=S, member=S, line_number=I))),
])
POSTINGS = _struct(token=S, doc_id=L, tf=I, size=I)
TERMS = _struct(token=S, df=L)
BM25_STATS = _struct(n=L, size=L)  # documents and tokens of a bucket
NAMES = _struct(name=S, qname=S, path=S, pos=I, type=S, symbol_id=L)
MENTIONS = _struct(path=S, name=S)
LISTING = _struct(path=S, size_bytes=L, modified=T.TimestampType(), listed=T.TimestampType())
_CALL = dict(path=S, pos=I, target=S, call_type=S, caller_class=S, caller_qname=S, line_number=I)
RESOLVED = _struct(**_CALL, caller=S, callee=S, resolution=S, confidence=D, caller_id=L, callee_id=L)
RESOLVED_BASES = _struct(path=S, pos=I, child=S, parent=S, line_number=I, parent_qname=S, child_id=L, parent_id=L)
RESOLVED_IMPORTS = _struct(path=S, pos=I, module_path=S, imported_name=S, alias=S, line_number=I, dst=S, known=B)
ERRORS = _struct(path=S, error=S)
TABLES = {"files": FILES, "symbols": SYMBOLS, "imports": IMPORTS, "calls": CALLS, "inherits": INHERITS, "type_info": TYPE_INFO, "embeddings": EMBEDDINGS, "nodes": NODES, "edges": EDGES, "parsed": PARSED, "errors": ERRORS, "bm25_postings": POSTINGS, "bm25_terms": TERMS, "bm25_stats": BM25_STATS,
          "listing": LISTING, "names": NAMES, "mentions": MENTIONS, "resolved": RESOLVED, "resolved_bases": RESOLVED_BASES, "resolved_imports": RESOLVED_IMPORTS}
CASES = T.StructType([T.StructField("case_id", S), T.StructField("type", S), T.StructField("query", S), T.StructField("expected_files", T.ArrayType(S)), T.StructField("expected_functions", T.ArrayType(S))])
