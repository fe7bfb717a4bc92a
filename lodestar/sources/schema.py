"""Column contracts of the relations.

The parse stage returns one row a file with one array of structs for each relation; the flat
relations add file_ord, and a location struct made of the file's path and the fact's line and column.
"""

from __future__ import annotations

from pyspark.sql.types import StructType, _parse_datatype_string

KIND = "struct<kind:string,self_ty:string,trait_ty:string,trait_name:string>"
USE_KIND = "struct<kind:string,alias:string>"
_HERE = "module_path:array<string>,line:bigint,column:bigint"
_SCOPE = "enclosing_fn:string,enclosing_public:boolean"

#: The fields of each relation's struct in the facts row.
RELATIONS: dict[str, str] = {
    "functions": "ord:bigint,name:string,fq_name:string,is_public:boolean,has_docs:boolean,is_async:boolean,is_unsafe:boolean,is_const:boolean,is_generic:boolean,"
    f"args:array<string>,return_ty:string,kind:{KIND},attrs:array<string>,signature:string,{_HERE}",
    "imports": f"ord:bigint,root:string,segments:array<string>,is_internal:boolean,is_public_use:boolean,kind:{USE_KIND},full_path:string,is_absolute:boolean,"
    f"listed:boolean,raw_segments:array<string>,self_name:boolean,{_HERE}",
    "exports": f"ord:bigint,exported_as:string,source_path:string,{_HERE}",
    "macros_def": f"ord:bigint,name:string,{_HERE}",
    "macros_inv": f"ord:bigint,name:string,path:string,position:string,{_HERE},{_SCOPE}",
    "paths": f"ord:bigint,path:string,keep:boolean,{_HERE},{_SCOPE}",
    "calls": f"ord:bigint,callee:string,callee_path:string,{_HERE},{_SCOPE}",
    "fn_spans": f"ord:bigint,fq_name:string,is_public:boolean,kind:{KIND},start_line:bigint,start_col:bigint,end_line:bigint,end_col:bigint",
}

FILE = "path string, modified timestamp, file_ord bigint, is_no_std_crate_root boolean, _error struct<kind:string,path:string,message:string>"
FINDING = "severity string, code string, message string, location struct<path:string,line:bigint,column:bigint>, extra string, rule_ord int, ord bigint, file_ord bigint"


def facts_schema(relations: list[str] | None = None) -> StructType:
    names = list(RELATIONS) if relations is None else relations
    return _parse_datatype_string(FILE + "".join(f", {n} array<struct<{RELATIONS[n]}>>" for n in names))
