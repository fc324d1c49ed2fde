"""Languages, labels and module paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispan.functions.spans import as_column

#: File name extensions, case-sensitive, and their languages.
EXTENSIONS = {
    "rs": "rust", "py": "python", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
}

#: Kinds of symbols and the labels of their nodes; another kind is a function.
LABELS = {
    "function": "symbol_function", "method": "symbol_method", "class": "symbol_class", "struct": "symbol_class",
    "interface": "symbol_interface", "enum": "symbol_enum", "impl": "symbol_impl", "trait": "symbol_trait",
    "module": "symbol_module", "namespace": "symbol_module", "variable": "symbol_variable", "field": "symbol_variable",
    "const": "symbol_variable", "static": "symbol_variable", "constructor": "symbol_constructor", "type_alias": "symbol_type_alias",
}


#: Entity labels of a symbol beside its language.
SHORT_KINDS = {"function": "fn", "type_alias": "typealias"}


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a small constant table; null where it has none. Folded into the plan, so no join."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def extension(path: Column | str) -> Column:
    """What follows the last dot of the file name; empty for none and for names that only begin with a dot."""
    return F.regexp_extract(F.substring_index(as_column(path), "/", -1), r"^.+\.([^.]*)$", 1)


def detect_language(path: Column | str) -> Column:
    return lookup(EXTENSIONS, extension(path))


def language_of(path: str) -> str | None:
    """As detect_language, for one path on the driver."""
    name = path.rsplit("/", 1)[-1]
    stem, dot, ext = name.rpartition(".")
    return EXTENSIONS.get(ext) if dot and stem else None


def kind_label(kind: Column | str) -> Column:
    return F.coalesce(lookup(LABELS, as_column(kind)), F.lit("symbol_function"))


def module_path(root: str, path: Column | str) -> Column:
    """Module path of a file of a workspace: src/a/b.rs is crate::a::b, a/mod.rs is crate::a, lib.rs and main.rs the crate itself."""
    p = F.regexp_replace(as_column(path), "^\\Q" + root.rstrip("/") + "\\E/?", "")
    p = F.regexp_replace(F.regexp_replace(p, r"\.rs$", ""), r"^src/", "")
    p = F.regexp_replace(p, r"(^|/)mod$", "")
    p = F.when(p.isin("lib", "main", "", "src"), F.lit("")).otherwise(p)
    return F.concat_ws("::", F.lit("crate"), F.when(p != "", F.replace(p, F.lit("/"), F.lit("::"))))


def parent_module(module: Column | str, sep: str = "::") -> Column:
    """What stands before the last separator; null at the root."""
    m = as_column(module)
    return F.when(F.contains(m, F.lit(sep)), F.regexp_extract(m, "^(.*)\\Q" + sep + "\\E", 1))


def remediation(code: Column | str) -> Column:
    """Documentation of a compiler's code: E and four digits, or TS and digits."""
    c = as_column(code)
    return F.when(c.rlike("^E[0-9]{4}$"), F.concat(F.lit("https://doc.rust-lang.org/error-index.html#"), c)).when(c.rlike("^TS[0-9]+$"), F.concat(F.lit("https://www.typescriptlang.org/errors/"), c))


def nonzero(c: Column | str) -> Column:
    return F.nullif(as_column(c), F.lit(0))
