"""Schemas of the fact tables. Offsets are bytes, spans half-open; ``ordinal`` keeps the order of the source."""

SOURCE_FILES = "file_path string, language string, content string, n_bytes bigint, sha256 string"
SYMBOLS = (
    "file_path string, language string, name string, kind string, byte_start bigint, byte_end bigint, line_start bigint, line_end bigint, "
    "col_start bigint, col_end bigint, container_path string, fully_qualified string, parameters array<string>, "
    "visibility struct<level:string,scope:string>, flags struct<is_async:boolean,is_exported:boolean,is_public:boolean,is_static:boolean,is_template:boolean>, ordinal bigint"
)
IMPORTS = "file_path string, ordinal bigint, import_kind string, path array<string>, imported_names array<string>, is_glob boolean, is_reexport boolean, byte_start bigint, byte_end bigint"
SCOPES = "file_path string, scope_id bigint, parent_id bigint, byte_start bigint, byte_end bigint"
SCOPE_SYMBOLS = "file_path string, scope_id bigint, name string, declaration_pos bigint"
IDENTIFIERS = "file_path string, name string, node_kind string, parent_kind string, byte_start bigint, byte_end bigint, is_qualified boolean, qualified_text string"
SYNTAX_NODES = "file_path string, node_id bigint, kind string, depth int, byte_start bigint, byte_end bigint"
DIAGNOSTICS = "tool string, level string, message string, file string, line bigint, column bigint, code string, note string, tool_path string, tool_version string, remediation string"
REPLACEMENTS = "batch_no bigint, ordinal bigint, file_path string, byte_start bigint, byte_end bigint, content string"
PLAN = "steps array<struct<file:string,symbol:string,kind:string,with:string>>"
BATCHES = "batches array<struct<replacements:array<struct<file:string,start:bigint,end:bigint,content:string,with:string>>>>"
MANIFEST = "operation_id string, timestamp string, files array<struct<original_path:string,hash:string,size:bigint>>"
