"""Chunking files: languages, line blocks, overlapping slices and symbols."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from quaerix.functions import vocab

DEFINITION = re.compile(rf"\s*(?:{'|'.join(vocab.DEFINITION_WORDS)}) ")
CHUNK = "symbol_name string, symbol_type string, line_start int, line_end int, signature string, content string, parser string"
CHUNK_FIELDS = tuple(tuple(x.split()) for x in CHUNK.split(", "))
#: Bytes of files that a task turns into chunks at once.
HELD = 1 << 21


def detect_language(path: Column) -> Column:
    """By the last suffix in lower case; ``text`` for all others."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in sorted(vocab.LANGUAGES.items()) for x in kv])
    return F.coalesce(F.try_element_at(known, suffix), F.lit("text"))


def fallback_blocks(source: str, name: str, language: str) -> list[dict]:
    """Blocks of lines that end with a heading (text) or a definition (code) after more than 8 lines, or at 60 or 80 lines.

    Lines, of which a block's first is its signature, are parted as `str.splitlines` does.
    """
    lines, out, first = source.splitlines(), [], 0

    def flush(end: int) -> None:
        part = lines[first:end]
        body = "\n".join(part).strip()
        if body:
            out.append({"symbol_name": f"{name}:{first + 1}", "symbol_type": "fallback_chunk", "line_start": first + 1, "line_end": end, "signature": part[0].strip(), "content": body, "parser": "fallback"})

    for i, line in enumerate(lines, 1):
        held = i - first
        marked = line.startswith("#") if language == "text" else DEFINITION.match(line) is not None
        if held >= (60 if language == "text" else 80) or (marked and held > 8):
            flush(i)
            first = i
    if first < len(lines):
        flush(len(lines))
    return out


def _python_symbols(source: str) -> list[tuple[str, str, int, int]]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple[str, str, int, int]] = []

    def visit(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) and child.end_lineno > child.lineno:
                kind = "class_definition" if isinstance(child, ast.ClassDef) else "function_definition"
                out.append((child.name, kind, child.lineno, child.end_lineno))
            else:
                visit(child)

    visit(tree)
    return out


#: What is a chunk in languages with braces: (kind, head of the declaration, how it ends). Kinds are fixed values. A head stands at the
#: start of a line, after its modifiers; "block" ends with its braces or a semicolon, "statement" where brackets are closed and the line does not go on.
_JS_NAME = r"(?P<name>[\w$]+)"
_JS_METHOD = r"(?:(?:public|private|protected|static|readonly|override|async|get|set)\s+|\*\s*)*(?!(?:if|for|while|switch|catch|function|return|with|do|else)\b)#?(?P<name>[\w$]+)\s*(?:<[^>]*>)?\([^;]*$"
_TS = (
    ("function_declaration", rf"(?:async\s+)?function\s+{_JS_NAME}", "block"), ("class_declaration", rf"class\s+{_JS_NAME}", "block"),
    ("interface_declaration", rf"interface\s+{_JS_NAME}", "block"), ("type_alias_declaration", rf"type\s+{_JS_NAME}[^=]*=", "statement"),
    ("lexical_declaration", r"(?:const|let)\s+(?P<name>[\w$]+)?", "statement"), ("method_definition", _JS_METHOD, "block"),
)
_HEADS = {
    "javascript": (
        ("function_declaration", rf"(?:async\s+)?function\s+{_JS_NAME}", "block"), ("generator_function_declaration", rf"(?:async\s+)?function\s*\*\s*{_JS_NAME}", "block"),
        ("class_declaration", rf"class\s+{_JS_NAME}", "block"), ("lexical_declaration", r"(?:const|let)\s+(?P<name>[\w$]+)?", "statement"),
        ("variable_declaration", r"var\s+(?P<name>[\w$]+)?", "statement"), ("method_definition", _JS_METHOD, "block"),
    ),
    "typescript": _TS,
    "tsx": _TS,
    "java": (
        ("class_declaration", r"class\s+(?P<name>\w+)", "block"), ("interface_declaration", r"interface\s+(?P<name>\w+)", "block"), ("enum_declaration", r"enum\s+(?P<name>\w+)", "block"),
        ("method_declaration", r"(?:<[^>]*>\s*)?(?!(?:return|new|else|throw|record)\b)[\w.<>\[\], ?]+\s+(?P<name>\w+)\s*\([^;]*$", "block"),
    ),
    "go": (("method_declaration", r"func\s+\([^)]*\)\s*(?P<name>\w+)", "block"), ("function_declaration", r"func\s+(?P<name>\w+)", "block"), ("type_declaration", r"type\s+\(?\s*(?P<name>\w+)?", "statement")),
    "rust": (
        ("function_item", r"(?:(?:async|unsafe|const|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(?P<name>\w+)", "block"), ("struct_item", r"struct\s+(?P<name>\w+)", "block"),
        ("enum_item", r"enum\s+(?P<name>\w+)", "block"), ("trait_item", r"(?:unsafe\s+)?trait\s+(?P<name>\w+)", "block"),
        ("impl_item", r"(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+!?(?:[\w]+::)*(?P<name>\w+)", "block"),
    ),
}
_MODIFIERS = {
    "javascript": r"(?:export\s+(?:default\s+)?)?", "typescript": r"(?:export\s+(?:default\s+)?)?(?:declare\s+)?", "tsx": r"(?:export\s+(?:default\s+)?)?(?:declare\s+)?",
    "java": r"(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|static|final|abstract|sealed|synchronized|native|default|strictfp)\s+)*", "go": "", "rust": r"(?:pub(?:\([^)]*\))?\s+)?",
}
_COMPILED = {lang: tuple((kind, re.compile(r"\s*" + _MODIFIERS[lang] + head), end) for kind, head, end in heads) for lang, heads in _HEADS.items()}
_QUIET = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
#: For Rust, where a quote may begin a lifetime: strings, characters and comments.
_QUIET_RUST = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\\n])'""", re.S)
_GOES_ON = re.compile(r"(?:[=,+\-*/%&|?:<(\[{.]|=>)\s*$")
_CONTINUES = re.compile(r"\s*(?:[.?:+*/%&|,)\]}=]|=>|-(?!-))")


def _extent(lines: list[str], first: int, end: str) -> int:
    """The last line of a declaration that begins on line *first*: by balanced brackets."""
    depth, opened = 0, False
    for i in range(first, len(lines)):
        line = lines[i]
        depth += sum(line.count(c) for c in "{([") - sum(line.count(c) for c in "})]")
        opened = opened or "{" in line
        if depth > 0:
            continue
        if line.rstrip().endswith(";") or depth < 0:
            return i
        if end == "block" and opened:
            return i
        following = next((x for x in lines[i + 1 :] if x.strip()), "")
        if end == "statement" and not _GOES_ON.search(line) and not (_CONTINUES.match(following) and not following.strip().startswith("}")):
            return i
    return len(lines) - 1


def _brace_symbols(source: str, language: str) -> list[tuple[str, str, int, int]]:
    """Declarations of the language's kinds by their heads and balanced brackets; strings and comments do not count.

    What is inside a chunk is no chunk of its own; what is inside anything else may be, also inside a declaration of a single line.
    """
    quiet = _QUIET_RUST if language == "rust" else _QUIET
    plain = quiet.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)
    lines, out, i = plain.split("\n"), [], 0
    while i < len(lines):
        hit = next(((kind, m, end) for kind, head, end in _COMPILED[language] if (m := head.match(lines[i]))), None)
        if hit:
            kind, m, end = hit
            last = _extent(lines, i, end)
            body = "\n".join(lines[i : last + 1])
            # A call or a heading looks like a method, but has no body.
            if last > i and (kind not in ("method_definition", "method_declaration") or "{" in body):
                first = i
                while language == "java" and first and lines[first - 1].strip().startswith("@"):
                    first -= 1
                out.append((m.group("name") or "", kind, first + 1, last + 1))
                i = last
        i += 1
    return out


def symbol_blocks(source: str, name: str, language: str) -> list[dict]:
    """A chunk for each outermost symbol of two lines or more; line blocks where there is none."""
    if not source.strip():
        return []
    found = _python_symbols(source) if language == "python" else _brace_symbols(source, language) if language in _HEADS else []
    lines, out = source.split("\n"), []
    for symbol, kind, a, b in found:
        body = "\n".join(lines[a - 1 : b]).strip()
        out.append({"symbol_name": symbol or name, "symbol_type": kind, "line_start": a, "line_end": b, "signature": lines[a - 1].strip(), "content": body, "parser": "symbols"})
    return out or fallback_blocks(source, name, language)


def overlap_slices(text: str, size: int = 1200, overlap: int = 150) -> list[str]:
    """Slices of *size* characters that end at a paragraph, sentence or line where one is near, and overlap."""
    if not 0 <= overlap < 0.4 * size:
        raise ValueError("overlap must be at least 0 and below 0.4 of the size, or slices would not advance")
    out, start = [], 0
    while start < len(text):
        part = text[start : start + size]
        step = size
        if start + size < len(text):
            for mark, least in (("\n\n", 0.4), (".", 0.5), ("\n", 0.4)):
                at = part.rfind(mark)
                if at > least * size:
                    step = at + 1
                    break
        body = part[:step].strip()
        if body:
            out.append(body)
        start += step - overlap
    return out


def overlap_chunks(rows: DataFrame, text: str = "text", size: int = 1200, overlap: int = 150) -> DataFrame:
    """Other columns, chunk_no from 0, and content."""
    overlap_slices("", size, overlap)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: overlap_slices(t or "", size, overlap))

    keep = [c for c in rows.columns if c != text]
    return rows.select(*keep, F.posexplode(cut(F.col(text))).alias("chunk_no", "content")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


def parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to at most *most*, or of one row that is larger."""
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("content")), 0).to_pylist()
        for a, b in parts(sizes, HELD):
            part = batch.slice(a, b - a)
            at, ordinals, found = [], [], []
            for i in range(b - a):
                path, language, body = (part.column(c)[i].as_py() for c in ("file_path", "language", "content"))
                blocks = symbol_blocks(body or "", path.rsplit("/", 1)[-1], language)
                at += [i] * len(blocks)
                ordinals += range(len(blocks))
                found += blocks
            own = part.select(["repository", "file_path", "language"]).take(pa.array(at, pa.int64()))
            columns = [pa.array([x[c] for x in found], pa.int32() if t == "int" else pa.string()) for c, t in CHUNK_FIELDS]
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(ordinals, pa.int64()), *columns], names=[*own.schema.names, "chunk_ordinal", *(c for c, _ in CHUNK_FIELDS)])


def chunk_files(files: DataFrame) -> DataFrame:
    """files: repository, file_path, content (text) -> chunks with ids, ordinals and searchable text; narrow, one file at a time.

    A task holds an Arrow batch of files, and chunks and Python objects of HELD characters of them, whatever the batch's size.
    """
    kept = ("repository", "file_path", "language")
    named = files.select("repository", "file_path", detect_language(F.col("file_path")).alias("language"), "content")
    schema = StructType([named.schema[c] for c in kept] + [StructField("chunk_ordinal", LongType())] + [StructField(c, IntegerType() if t == "int" else StringType()) for c, t in CHUNK_FIELDS])
    rows = named.mapInArrow(_cut, schema)
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    named = F.when(F.col("parser") == "fallback", F.concat_ws("\n", "file_path", "content")).otherwise(F.concat_ws("\n", "file_path", blank("symbol_name"), blank("signature"), blank("content")))
    return rows.withColumn("searchable_text", named).withColumn("id", F.sha2(F.concat_ws("\x1f", F.col("repository").cast("string"), "file_path", F.col("chunk_ordinal").cast("string")), 256))
