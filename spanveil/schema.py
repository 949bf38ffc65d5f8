"""Types and the closed label domain."""

from __future__ import annotations

from pyspark.sql import types as T

# Label names, their order and the sets they form are part of the results.
CORPUS_LABELS = ("NAME_STUDENT", "EMAIL", "USERNAME", "ID_NUM", "PHONE_NUM", "URL_PERSONAL", "STREET_ADDRESS")
RULE_LABELS = ("SSN", "DATE", "NAME_RELATED", "SCHOOL", "LOCATION", "AGE", "IP_ADDRESS", "DEVICE_ID", "GEO")
ALL_LABELS = CORPUS_LABELS + RULE_LABELS
AUTHORITY_LABELS = ("NAME_STUDENT", "ID_NUM", "STREET_ADDRESS")
NAME_LABELS = ("NAME_STUDENT", "NAME_RELATED")

#: Class ids of token classification: O, then B and I of each corpus label.
CLASS_IDS = {"O": 0} | {f"{p}-{l}": 2 * k + i for k, l in enumerate(CORPUS_LABELS) for i, p in ((1, "B"), (2, "I"))}

SPAN_DDL = "struct<label:string,text:string,start:int,end:int,confidence:double,source:string,seq:int>"
SPANS_DDL = f"array<{SPAN_DDL}>"
SPAN = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("seq", T.IntegerType()),
    ]
)
CORPUS_DDL = "document bigint, full_text string, tokens array<string>, trailing_whitespace array<boolean>, labels array<string>"
LABEL_RULE_DDL = "struct<enabled:boolean,method:string,mask:string,min_confidence:double>"
POLICY_DDL = (
    "name string, description string, default_method string, min_confidence double, allow_method_override boolean, "
    f"date_shift_days int, labels map<string,{LABEL_RULE_DDL}>"
)
MANIFEST_DDL = (
    "name string, hf_id string, base string, task string, params string, status string, local_path string, "
    "runtime array<string>, quant array<string>, eval string, labels array<string>"
)
