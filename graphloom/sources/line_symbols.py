"""Symbols and imports of languages without a parser here, told line by line; files are rows, and lines stay where their file is.

What a pattern says of a line is taken: strings, comments in the middle of lines and
declarations that run over lines are not understood.  For Python use python_ast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules

_TS = [
    ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"), ("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"),
    ("type_alias", r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*[=<]"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
    ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"),
    ("method", r"^\s+(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|constructor\b)([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*(?::\s*[^{;]+)?\{\s*$"),
    ("constructor", r"^\s+(constructor)\s*\("),
]
_JAVA = [
    ("class", r"^\s*(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|record)\s+(\w+)"), ("interface", r"^\s*(?:(?:public|private|protected)\s+)*interface\s+(\w+)"), ("enum", r"^\s*(?:(?:public|private|protected)\s+)*enum\s+(\w+)"),
    ("method", r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?!return\b|new\b|else\b|throw\b)[\w<>\[\],.?]+\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w,.\s]+)?\{\s*$"),
]
_GO = [("method", r"^func\s*\([^)]*\)\s*(\w+)\s*\("), ("function", r"^func\s+(\w+)\s*[(\[]"), ("struct", r"^type\s+(\w+)\s+struct\b"), ("interface", r"^type\s+(\w+)\s+interface\b"), ("type_alias", r"^type\s+(\w+)\s+\w")]

#: Declarations by language: kind and a pattern whose first group is the name; the first that fits a line decides.
SYMBOLS = {"typescript": _TS, "javascript": _TS, "java": _JAVA, "go": _GO}
#: Imports by language: a pattern whose first group is the module.
IMPORTS = {
    "typescript": [r"^\s*(?:import|export)\b.*?\bfrom\s+['\"]([^'\"]+)['\"]", r"^\s*import\s+['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)"],
    "java": [r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"], "go": [r"^\s*import\s+(?:\w+\s+)?\"([^\"]+)\"", r"^\t(?:\w+\s+)?\"([^\"]+)\"\s*$"],
}
IMPORTS["javascript"] = IMPORTS["typescript"]


def _lines(files: DataFrame) -> DataFrame:
    rows = files.withColumn("language", rules.language(F.col("file_path"))).where(F.col("language").isin(*SYMBOLS))
    rows = rows.select("file_path", "language", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    return rows.where(~F.col("text").rlike(r"^\s*(?://|\*|/\*)")).select("file_path", "language", (F.col("pos") + 1).alias("line"), "text")


def symbols(files: DataFrame) -> DataFrame:
    """file_path, name, kind, line of declarations in files (file_path, content) of SYMBOLS' languages."""
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for language, patterns in SYMBOLS.items():
        first = F.when(F.lit(False), found)
        for kind, p in patterns:
            first = first.when(F.col("text").rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("text", p, 1).alias("name")))
        found = F.when(F.col("language") == language, first).otherwise(found)
    return _lines(files).withColumn("s", found).where("s IS NOT NULL").select("file_path", "s.name", "s.kind", "line")


def imports(files: DataFrame) -> DataFrame:
    """file_path, source, line of imports in files (file_path, content)."""
    found = F.lit(None).cast("string")
    for language, patterns in IMPORTS.items():
        first = F.when(F.lit(False), found)
        for p in patterns:
            first = first.when(F.col("text").rlike(p), F.regexp_extract("text", p, 1))
        found = F.when(F.col("language") == language, first).otherwise(found)
    return _lines(files).withColumn("source", found).where("source IS NOT NULL").select("file_path", "source", "line")
