"""Record shapes and enumerations."""

from __future__ import annotations

# Spellings of the enumerations.
STATUSES = ("legacy", "migrated", "partial", "no_models")
STATUS_LABELS = {"legacy": "Legacy", "migrated": "Migrated", "partial": "Partial", "no_models": "No Models"}
STATUS_MARKS = {"legacy": "[L]", "migrated": "[M]", "partial": "[P]", "no_models": "[-]"}
LEGACY, MODERN = "shared_legacy", "shared2023"
SOURCE_DIRS = {LEGACY: "shared", MODERN: "shared_2023"}
IMPORT_KINDS = ("named", "default", "namespace", "side_effect", "type_only", "dynamic")
EXPORT_KINDS = ("class", "interface", "named", "re_export")
CATEGORY_SUFFIXES = {
    "interface": "Model",
    "model": "",
    "code_gen": "CodeGen",
    "code_gen_for_api": "CodeGenForApi",
    "code_gen_form": "CodeGenForm",
    "code_gen_form_array": "CodeGenFormArray",
}
SCAN_ERRORS = ("walk", "read", "parse", "config", "non_utf8_path", "registry")
RECOVERABLE_SCAN_ERRORS = ("read", "parse")
WATCH_ERRORS = ("notify", "path_not_found", "channel_closed", "non_utf8_path", "io")
RECOVERABLE_WATCH_ERRORS = ("non_utf8_path",)

LOCATION = "struct<line:int,column:int,byte_offset:int>"
PARSED_IMPORT = f"struct<path:string,kind:string,names:array<string>,location:{LOCATION}>"
IMPORT = f"struct<path:string,kind:string,names:array<string>,source:string,location:{LOCATION}>"
EXPORT = f"struct<name:string,kind:string,location:{LOCATION},reexport_source:string>"
MODEL_REF = "struct<name:string,category:string,source:string>"

SOURCE_FILE = "path string, rel_path string, content binary, mtime bigint"
SCAN_ERROR = "path string, error_kind string, message string"
FILE_EVENT = "path string, ts timestamp"
