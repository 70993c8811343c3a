"""Source trees: files of a repository or library, their tokens, digests and patches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names

#: Languages by file extension.
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "c": "c", "h": "c", "zig": "zig"}
#: Extensions whose files are compared with one another.
DOMAINS = {"typescript": "ecmascript", "javascript": "ecmascript"}


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, diagnostics): files of known languages as path, language, domain, text,
    content_sha256; diagnostics: path, message of those that are no UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(re.sub("^file:/*", "/", base)), "")
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    own = raw.select(path.alias("path"), "content").withColumn("language", known[F.regexp_extract("path", r"\.([^./]+)$", 1)]).where("language is not null")
    own = own.withColumn("text", F.when(F.expr("is_valid_utf8(content)"), F.decode("content", "UTF-8")))
    domain = F.coalesce(F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv])[F.col("language")], F.col("language"))
    files = own.where("text is not null").select("path", "language", domain.alias("domain"), "text", F.sha2("content", 256).alias("content_sha256"))
    return files, own.where("text is null").select("path", F.lit("not UTF-8").alias("message"))


def library(files: DataFrame) -> DataFrame:
    """Files that are library source: no tests, benches, build output, declarations."""
    script = F.col("domain") == "ecmascript"
    return files.where(F.when(script, names.is_library_source(F.col("path"), "ecmascript")).otherwise(names.is_library_source(F.col("path"))))


#: Lexemes: comments and white space are dropped, others classed.
_LEXER = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/|#(?![\[!])[^\n]*)"
    r"|(?P<string>'''.*?'''|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)"
    r"|(?P<number>\d[\w.]*)|(?P<identifier>[A-Za-z_$][\w$]*)|(?P<operator>[-+*/%=<>!&|^~?:]+|\S)",
    re.S,
)
#: Identifiers that are words of a language.
KEYWORDS = set("as async await break case catch class const continue def default do elif else enum except export extends fn for from function if impl import in interface let loop match mod move mut new pass pub raise ref return self static struct super switch this throw trait try type use var void where while with yield".split())


def lex(text: str) -> list[tuple[str, str, str, int, int, int, int]]:
    """(kind, lexeme, class, start_byte, end_byte, start_line, end_line) of a text."""
    out, line, byte = [], 1, 0
    for m in _LEXER.finditer(text):
        kind, lexeme = m.lastgroup, m[0]
        size, lines = len(lexeme.encode()), lexeme.count("\n")
        if kind != "skip":
            cls = "other"
            if kind == "identifier":
                kind, cls = ("keyword", "other") if lexeme in KEYWORDS else (kind, "identifier")
            elif kind in ("string", "number"):
                cls = "literal"
            out.append((kind, lexeme, cls, byte, byte + size, line, line + lines))
        byte, line = byte + size, line + lines
    return out


TOKENS = "file_id long, path string, domain string, ordinal int, kind string, lexeme string, class string, start_byte long, end_byte long, start_line int, end_line int"


def tokenize(files: DataFrame) -> DataFrame:
    """TOKENS of files (path, domain, text); a file's id is the hash of its path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, p, d, n, *t) for i, p, d, text in zip(*(batch.column(c).to_pylist() for c in range(4))) for n, t in enumerate(lex(text or ""))]
            if rows:
                types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[x.split()[0] for x in TOKENS.split(", ")])

    return files.select(F.xxhash64("path").alias("file_id"), "path", "domain", "text").mapInArrow(run, TOKENS)


def identity_digest(tokens: list[tuple[str, str, str]], rename: tuple[str, ...] = ()) -> str:
    """SHA-256 of (kind, lexeme, class) rows, each length-prefixed; of classes in
    rename the ordinal by first appearance stands for the lexeme."""
    h, seen = hashlib.sha256(), {}
    for kind, lexeme, cls in tokens:
        k = kind.encode()
        h.update(len(k).to_bytes(8, "little") + k)
        if cls in rename:
            own = seen.setdefault(cls, {})
            h.update(cls[:1].encode() + own.setdefault((kind, lexeme), len(own)).to_bytes(8, "little"))
        else:
            x = lexeme.encode()
            h.update(b"e" + len(x).to_bytes(8, "little") + x)
    return h.hexdigest()


def tree_digest(root: str | Path, tag: bytes = b"source-tree\0") -> str:
    """SHA-256 over a tree's sorted paths and contents, length-prefixed. Symbolic
    links are refused: what they point to is not part of the tree."""
    root = Path(root)
    h = hashlib.sha256(tag)
    for p in sorted(root.rglob("*")):
        if p.is_symlink():
            raise ValueError(f"{p} is a symbolic link")
        if p.is_file():
            for part in (p.relative_to(root).as_posix().encode(), p.read_bytes()):
                h.update(len(part).to_bytes(8, "big") + part)
    return h.hexdigest()


_CODE = re.compile(rb"//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|\\\\[^\n]*|(?<![\w@])#(?=[A-Za-z_])")


def patch_private_fields(source: bytes) -> bytes:
    """`#name` in code as `_name`, of the same length; strings and comments stay."""
    return _CODE.sub(lambda m: b"_" if m[0] == b"#" else m[0], source)


def package_sources(registries: list[str], package: str, version: str) -> tuple[list[str], list[str]]:
    """(sources, unreadable): where registries hold package-version; a registry that
    can't be read is named, which is not the same as a missing package."""
    found, unreadable = [], []
    for r in map(Path, registries):
        try:
            found += sorted(str(p) for p in r.iterdir() if p.is_dir() and p.name == f"{package}-{version}")
        except OSError:
            unreadable.append(str(r))
    return found, unreadable
