"""Symbols, imports and references of source files in four languages, from a binary file scan."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import fixed
from tessera.functions import text
from tessera.sources import scopes
from tessera.sources.scopes import Row

EXTRACTION = "path string, language string, kind string, name string, names array<string>, line int, end_line int, signature string, detail string"


def repository_files(spark: SparkSession, root: str, exclude: tuple[str, ...] = ("node_modules", "target", "dist", "build", "vendor")) -> DataFrame:
    """(path, language, content binary) of text files of known languages below a root: no dot names or excluded folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split("://")[-1].rstrip("/")
    parts = F.split(F.element_at(F.split(F.col("path"), base + "/", 2), -1), "/")
    files = files.withColumn("path", F.array_join(parts, "/")).where(F.col("length") <= fixed.MAX_FILE_BYTES)
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith(".") | p.isin(*exclude))
    return files.where(~hidden & text.language_of(F.col("path")).isNotNull() & text.is_likely_text(F.col("content"))).select("path", text.language_of(F.col("path")).alias("language"), "content")


def _python(source: str) -> Iterator[Row]:
    try:
        tree = ast.parse(source)
    except SyntaxError as e:
        yield "error", "syntax", None, e.lineno or 1, None, None, e.msg
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield "import", a.name, None, node.lineno, None, None, "direct"
        elif isinstance(node, ast.ImportFrom):
            yield "import", "." * node.level + (node.module or ""), [a.name for a in node.names], node.lineno, None, None, "direct"
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield "symbol", node.name, None, node.lineno, node.end_lineno, f"def {node.name}({ast.unparse(node.args)})", "function"
        elif isinstance(node, ast.ClassDef):
            yield "symbol", node.name, None, node.lineno, node.end_lineno, f"class {node.name}", "class"
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                yield "reference", name, None, node.lineno, None, None, "call"


#: Extractors by language; a grammar-based one may be put in its place.
EXTRACTORS: dict[str, Callable[[str], Iterator[Row]]] = {"python": _python, **scopes.GRAMMARS}


def extract(files: DataFrame) -> DataFrame:
    """EXTRACTION rows of (path, language, content): kind import, symbol, reference or error.

    Python is read by its own grammar; the brace languages by tokens and their scopes (scopes.py). What can't be read is an
    error row with its line; the rest of the file counts, but for Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, lang, *r) for p, lang, c in zip(pdf["path"], pdf["language"], pdf["content"], strict=True) if lang in EXTRACTORS for r in EXTRACTORS[lang](bytes(c).decode("utf-8", "replace"))]
            yield pd.DataFrame(rows, columns=["path", "language", "kind", "name", "names", "line", "end_line", "signature", "detail"]).astype({"line": "Int32", "end_line": "Int32"})

    return files.select("path", "language", "content").mapInPandas(run, EXTRACTION)


def file_hashes(extracted: DataFrame) -> DataFrame:
    """(path, hash): SHA-256 of path, symbol names with kinds, and import targets; bodies and lines are not part of it."""
    part = F.when(F.col("kind") == "symbol", F.struct(F.lit(0).alias("o"), "line", "name", F.concat("name", "detail").alias("s"))).when(F.col("kind") == "import", F.struct(F.lit(1).alias("o"), "line", "name", F.col("name").alias("s")))
    parts = F.transform(F.array_sort(F.collect_list(part)), lambda p: p["s"])
    return extracted.groupBy("path").agg(F.sha2(F.concat("path", F.array_join(parts, "")), 256).alias("hash"))
